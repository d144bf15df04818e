"""The pipeline's quality stage hands on texts without the lines that fail."""

import corpus_pipeline
from lawspark.llm import quality

PROSE = [" ".join(f"word{a}x{k}" for k in range(20)) for a in range(5)]


def test_failing_lines_are_removed(spark, sf):
    texts = {
        1: "\n".join(["Home", PROSE[0], "a | b | c | d", "", PROSE[1], "!! *** !!", PROSE[2], "See our cookie policy"]),
        2: "\n".join(PROSE) + "\n \n",
        3: "\n".join(PROSE[:3] + ["privacy policy " + PROSE[3], "terms of use " + PROSE[4], "lorem ipsum " + PROSE[0]]),
        4: None,
        5: "too short",
    }
    df = spark.createDataFrame([(k, t, "en", "s", len(t or ""), "own") for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long, _w string")
    out = corpus_pipeline.quality_rules(spark, df, sf)
    assert out.schema == df.schema
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == {1, 2} and got[1].text == "\n".join([PROSE[0], "", PROSE[1], PROSE[2]]) and got[2].text == texts[2]
    assert all(r.n_chars == len(r.text) and r._w == "own" for r in got.values())


def test_cleaning_keeps_the_documents_that_pass(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in docs.where(quality.passes(docs["text"])).collect()}
    assert {r.doc_id for r in quality.cleaned(docs).collect()} == kept
    judged = quality.with_quality(quality.cleaned(docs)).selectExpr("count_if(kept_words < n_words)").first()[0]
    assert judged == 0
