"""Quality rules, line first: lines that fail a rule are removed, then documents that lose too much text are rejected.

All rules are Column expressions over one row: no shuffle, no Python, memory bounded by the longest text. What a rule needs
twice is bound once in a lambda, since Catalyst would otherwise compute it again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document is rejected when less than this share of its words stands in lines that passed.
MIN_KEPT_PERCENT = 60
#: So many windows that come again are looked for one by one; of more, all windows are sorted with their places.
FEW = 32

# Patterns of the line rules, over lower-cased text, in the subset that Java's engine and RE2 read alike.
#: Navigation: so many separators of cells or crumbs on one line.
SEPARATORS = "|\u00bb\u203a>"
MAX_SEPARATORS = 2
#: Navigation: a short line that starts with the wording of a menu.
MENU = (
    "^(home|menu|skip to content|skip to main content|log ?in|sign in|sign up|register|search|next|next page|previous|previous page"
    "|back to top|read more|click here|share|share this|subscribe|contact|contact us|about us)([ :,.!][^\\n]{0,30})?\\z"
)
#: Boilerplate of web pages.
BOILERPLATE = "lorem ipsum|enable javascript|cookie policy|privacy policy|terms of use|terms of service|accept cookies|accept all cookies|sign up for our newsletter"
#: Punctuation: marks that pile up, as in "!!" or "***"; and all marks, of which a line has this share at most.
PILED = "!!|[?][?]|[#*$%&<>]{3}"
MARK = "[!-/:-@\\[-`{-~]"
MAX_MARKS_PERCENT = 40
LETTER = "[\\p{L}\\p{N}]"
# End of fixed values.

# The same patterns as Java's engine finds them fast: it tries all alternatives at every place, so one character that all of them
# need leads, and what stands before it is looked back at. A-Z alone fold under (?i), as ascii_lower() has it.
BOILERPLATE_FAST = "(?i) (?:" + "|".join(f"(?<={a} ){b}" for a, _, b in (x.partition(" ") for x in BOILERPLATE.split("|"))) + ")"
PILED_FAST = "[!?#*$%&<>](?:(?<=!)!|(?<=[?])[?]|(?<=[#*$%&<>])[#*$%&<>]{2})"
SEPARATORS_FAST = "[^{0}]*".join(["[{0}]"] * (MAX_SEPARATORS + 1)).replace("{0}", SEPARATORS)


def bound(value: Column, use) -> Column:
    """use(value) with value computed once: a lambda over an array of one."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, common.SPACES), lambda w: w != "")


def repeat_words(words: Column) -> Column:
    """Words that stand in a 3-word window found twice or more. Windows are told apart by 64-bit hashes of their words:
    sorted with their places, equal ones are neighbours; the places found cover up to three words each, counted once."""
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def places(s: Column) -> Column:
        again = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def few(h: Column, twice: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), n - 3), lambda i: F.array_contains(twice, F.get(h, i)))

    def repeated(h: Column) -> Column:
        numbered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = bound(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, k: F.get(s, k - 1) == x)))
        found = bound(twice, lambda x: bound(F.when(F.size(x) <= FEW, few(h, x)).otherwise(bound(numbered, places)), covered))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(found)

    return F.when(n < 4, F.lit(0)).otherwise(bound(windows, repeated))


def line_passes(line: Column) -> Column:
    """Whether a line with words passes: it has a letter or digit, not too many marks, none that pile up on every other word or
    more, it isn't navigation, and no boilerplate."""
    marks = F.regexp_count(line, F.lit(MARK))
    piled = F.regexp_count(line, F.lit(PILED))
    return ~(
        ~line.rlike(LETTER)
        | line.rlike("(?i)" + MENU)
        | line.rlike(SEPARATORS_FAST)
        | line.rlike(BOILERPLATE_FAST)
        | line.rlike(PILED_FAST) & (piled >= 2) & (piled * 2 >= F.size(words_of(line)))
        | (marks * 100 > F.length(line) * MAX_MARKS_PERCENT) & (marks * 100 > word_chars(line) * MAX_MARKS_PERCENT)
    )


def word_chars(text: Column) -> Column:
    """The characters that aren't white space."""
    return F.length(F.array_join(F.split(text, common.SPACES), ""))


def has_words(line: Column) -> Column:
    return line.rlike("[^\\x20\\x09-\\x0D]")


def _words_and_lines(t: Column) -> tuple[Column, Column]:
    """(n, chars, repeat) of the words and (n, dup, lost: words of lines that fail) of the lines of a text."""
    of_words = bound(words_of(t), lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), repeat_words(w).alias("repeat")))
    of_lines = bound(
        F.filter(F.split(t, "\n"), has_words),
        lambda s: F.struct(
            F.size(s).alias("n"),
            (F.size(s) - F.size(F.array_distinct(s))).alias("dup"),
            F.size(words_of(F.array_join(F.filter(s, lambda x: ~line_passes(x)), "\n"))).alias("lost"),
        ),
    )
    return of_words, of_lines


def kept_enough(n_words: Column, lost: Column) -> Column:
    return (n_words - lost) * 100 >= n_words * MIN_KEPT_PERCENT


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (n_repeat_words * 100 > n_words * MAX_REPEAT_PERCENT)


def passes(text: Column) -> Column:
    """The verdict alone, as a condition: false for null texts."""
    words, lines = _words_and_lines(F.coalesce(text, F.lit("")))
    return bound(
        F.struct(words.alias("w"), lines.alias("l")),
        lambda s: ~base_failed(s["w"]["n"], s["w"]["repeat"]) & kept_enough(s["w"]["n"], s["l"]["lost"]),
    )


def cleaned(docs: DataFrame, text: str = "text", chars: str = "n_chars") -> DataFrame:
    """The documents that pass, their text without the lines that fail, and its length in chars if docs has that column.

    Lines without words stay, so a text whose lines all pass is unchanged. A null or empty text has no words, so its document
    goes. Repeated rows are judged one by one and stay repeated; an empty table gives no rows. All columns of docs stay as they
    are, whatever their names."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = bound(words_of(t), lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("repeat")))
    stay = F.array_join(F.filter(F.split(t, "\n"), lambda s: ~has_words(s) | line_passes(s)), "\n")
    # lines are judged only where the words pass; a generator, so that the filter isn't computed apart from the text
    w, n, out = common.fresh(docs.columns, "_w", "_n", "_out")
    all_stay = F.octet_length(t)
    lines = bound(stay, lambda s: F.when((F.octet_length(s) == all_stay) | (F.size(words_of(s)) * 100 >= F.col(n) * MIN_KEPT_PERCENT), s))
    found = docs.select("*", F.inline(F.filter(F.array(words), lambda s: ~base_failed(s["n"], s["repeat"]))).alias(n, w))
    found = found.select("*", F.explode(F.filter(F.array(lines), lambda s: s.isNotNull())).alias(out))
    new = {text: F.col(out)} | ({chars: F.length(out).cast(docs.schema[chars].dataType)} if chars in docs.columns else {})
    return found.withColumns(new).select(*(f"`{c}`" for c in docs.columns))


def with_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, kept_words (words of lines that
    pass), base_failed and kept. Columns of docs with these names are replaced. A null text counts as empty: it has no
    words, so it fails. Empty and repeated rows are judged one by one; no row is dropped here."""
    t = F.coalesce(F.col(text), F.lit(""))
    of_words, of_lines = _words_and_lines(t)
    w, ln = common.fresh(docs.columns, "_w", "_l")
    columns = {
        "n_words": F.col(f"{w}.n"),
        "word_chars": F.col(f"{w}.chars"),
        "n_symbols": F.regexp_count(t, F.lit(f"[{SYMBOLS}]")),
        "n_dup_lines": F.col(f"{ln}.dup"),
        "n_repeat_words": F.col(f"{w}.repeat"),
        "n_lines": F.col(f"{ln}.n"),
        "kept_words": F.col(f"{w}.n") - F.col(f"{ln}.lost"),
    }
    return (
        docs.withColumns({w: of_words, ln: of_lines})
        .withColumns({n: c.cast("long") for n, c in columns.items()})
        .drop(w, ln)
        .withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
        .withColumn("kept", ~F.col("base_failed") & kept_enough(F.col("n_words"), F.col("n_words") - F.col("kept_words")))
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its base statistics and verdict."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_quality(docs).drop("text")


OP10_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 3)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r),
l AS (
  SELECT r, line, translate(line, '{common.UPPER}', '{common.LOWER}') AS low,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, len(regexp_extract_all(line, '{PILED}')) AS piled,
         len(regexp_extract_all(line, '{MARK}')) AS marks
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
ls AS (
  SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dup,
         sum(CASE WHEN NOT regexp_matches(line, '{LETTER}') OR (piled >= 2 AND piled * 2 >= n)
                    OR marks * 100 > {MAX_MARKS_PERCENT} * length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))
                    OR length(line) - length(translate(line, '{SEPARATORS}', '')) > {MAX_SEPARATORS}
                    OR regexp_matches(low, '{MENU}') OR regexp_matches(low, '{BOILERPLATE}') THEN 0 ELSE n END) AS kept
  FROM l GROUP BY r),
s AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(ls.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(ls.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(ls.kept, 0) AS BIGINT) AS kept_words
  FROM w LEFT JOIN rep USING (r) LEFT JOIN ls USING (r)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM s)
SELECT *, NOT base_failed AND 100 * kept_words >= {MIN_KEPT_PERCENT} * n_words AS kept FROM f
"""
