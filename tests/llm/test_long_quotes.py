"""Quoted passages of many lines of which only a short one is verbatim."""

from lawspark.llm import quotes


def test_short_lines_of_long_quotes_link(spark):
    quote = "\n".join([f"> rewrapped and edited line number {k} of the quote" for k in range(30)] + ["> see you"])
    rows = [(1, 0, "a", "Long talk\nsee you"), (1, 1, "b", "Something else"), (1, 2, "a", quote + "\nAgreed.")]
    out = {r.turn: r for r in quotes.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (out[2].n_quotes, out[2].n_linked, out[2].reply_to, out[2].branch) == (1, 1, 0, 2)
    assert (out[2].top, out[2].depth, out[2].place) == (0, 1, 2) and out[2].body == "Agreed."
