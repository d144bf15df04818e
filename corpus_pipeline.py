"""The corpus pipeline: quality rules, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next stage's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lawspark.llm import common, mixing, packing, quality, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: lines that the quality rules reject go, and documents that lose too much by it or fail the base rules.

    Null and empty texts fail. Repeated rows are judged one by one; an empty table gives no rows; columns of any name stay."""
    return quality.cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each group of near-duplicates (5-word shingles, Jaccard similarity of 0.8 or more) stays, the one
    with the smallest doc_id.

    Null and empty texts are copies of each other; a null doc_id comes after all others; repeated rows are one; an empty table
    gives no rows; columns of any name stay."""
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the sources in their target shares, documents taken several times, once, in part or not at all. Blocks of 256 words,
    so that parts of documents keep some context; a source misses its target by half a block at most.

    Documents without words (null and empty texts) aren't taken; a null source is a source; repeated rows count each; an empty
    table gives no rows; columns of any name stay."""
    return mixing.mix_documents(docs, block=256)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: all pieces of the mix in sequences of at most 1024 tokens.

    A null or empty text is one piece, the end id; null ids and repeated rows are documents like any other; an empty table gives
    no rows; other columns are ignored."""
    return packing.packed_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the components, the permutations and the packing; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. A stage's tables are deleted when the next has read them; the last stage's stay until the
    driver's Python ends, as the result reads them."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        if k + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        with common.temporary():
            new = common.kept(common.saved(stage(spark, docs, sf_dir), "stage"))
        if k:
            common.drop_saved(docs)
        docs = new
