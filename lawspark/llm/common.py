"""What the operators of this subpackage share: tables, saved intermediates, connected components."""

from __future__ import annotations

from pathlib import Path

import numpy as np

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..saved import drop_saved, kept, saved, shared_dir, temporary

__all__ = ["drop_saved", "kept", "saved", "shared_dir", "temporary"]

#: White space that separates words: space and the characters 9 to 13.
SPACES = "[\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z alone, as the contracts ask; lower() would also change other letters."""
    return F.translate(col, UPPER, LOWER)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, lengthened until they clash with no column."""
    taken = {c.lower() for c in columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """Connected components of an undirected graph: (node, component) for each node with a link, component being its
    smallest reachable node.

    links has two long columns a and b. Alternating large-star and small-star steps (Kiveris et al., 2014): each step is a
    grouped minimum, which Spark combines before the shuffle, and an equi-join back, which adaptive execution splits on a
    hot node. Needs about log(n) rounds. Each round's links are a table in the shared folder, the one before is deleted.
    """
    edges = saved(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u is not null and v is not null and u <> v")
        .distinct(),
        "links",
    )

    def state(df: DataFrame):
        return df.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
        ).first()

    before = state(edges)  # the last round's links stay: the result reads them
    if before.n == 0:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(rounds):
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        after_df = saved(small, "links")
        after = state(after_df)
        drop_saved(edges)
        edges, same = after_df, after == before
        before = after
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        roots.select("node", F.col("node").alias("component"))
    )


#: Rows that a worker takes of an Arrow batch at a time: texts are long, and functions hold their rows as Python values as well.
SLICE = 512


def on_workers(module: str, function: str, **params):
    """A function for mapInArrow that imports `function` on the worker, where what the module keeps is shared by its tasks."""
    root = str(Path(__file__).resolve().parents[2])

    def sliced(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                yield batch.slice(at, SLICE)

    def run(batches):
        import importlib
        import sys

        if root not in sys.path:
            sys.path.append(root)
        yield from getattr(importlib.import_module(module), function)(sliced(batches), **params)

    return run


def stars(hit: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between rows (named left) and columns (named right) that hit marks: each member of a
    connected group with the group's smallest name. Every row and column is visited once."""
    rows = np.flatnonzero(hit.any(axis=1))
    todo = np.zeros(len(left), bool)
    todo[rows] = True
    ends: list[np.ndarray] = []
    tops: list[np.ndarray] = []
    for r in rows:
        if not todo[r]:
            continue
        front, members, seen = np.array([r]), [], np.zeros(len(right), bool)
        while len(front):
            todo[front] = False
            members.append(front)
            new = hit[front].any(axis=0) & ~seen
            seen |= new
            front = np.flatnonzero(hit[:, new].any(axis=1) & todo)
        names = np.concatenate([left[np.concatenate(members)], right[seen]])
        top = names.min()
        names = np.unique(names[names != top])
        ends.append(names)
        tops.append(np.full(len(names), top))
    if not ends:
        return left[:0], left[:0]
    return np.concatenate(ends), np.concatenate(tops)


def bit_set(marks: DataFrame, words: int = 1 << 19) -> np.ndarray:
    """A set of marks as bits by their last digits, of one size whatever their number: it only spares rows that a join would drop."""
    bit = F.col("mark").bitwiseAND(words * 64 - 1)
    word = F.bit_or(F.expr("shiftleft(1L, cast(x & 63 as int))")).alias("b")
    found = marks.select(bit.alias("x")).groupBy(F.shiftright("x", 6).alias("w")).agg(word).toArrow()
    bits = np.zeros(words, np.uint64)
    bits[found["w"].to_numpy()] = found["b"].to_numpy().view(np.uint64)
    return bits


def in_bits(marks: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which marks are in a set from bit_set(), and perhaps a few others."""
    at = marks.view(np.uint64) % np.uint64(len(bits) * 64)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)
