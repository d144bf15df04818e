"""Mixing sources to target weights.

The words of a source, document after document, are packed into blocks of a fixed length. Each source is to give so many
blocks (its target); the slots of the output shards are dealt to the sources by multinomial draws, without exceeding what is
left for a source, so that its total is met. Slot x of a source reads the block that a pseudorandom permutation of the
source's block numbers gives for x, a new permutation each time round; blocks and slots are joined by source and number.

Scale: a document's place in its source is a prefix sum over (source, hash bucket), so a hot source is summed and sorted by
many tasks; rows that are equal throughout are one row with a count there. The driver holds a number for each source, and of the
draws what isn't zero: at most SHARDS rows a source; slots are made on the executors in bounded chunks. Slots and blocks meet in
an equi-join on (source, block), uniform by construction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
BLOCK = 64
SHARDS = 64
SEED = 1234
#: Hash buckets of a source, and rows of all of them together for each bucket at most on average.
BUCKETS, BUCKET_ROWS = 1024, 1 << 17
#: Slots that one row of the plan stands for at most.
CHUNK = 1 << 15
WORD = "[^\\x20\\x09-\\x0D]+"


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: float = MOST_TIMES) -> list[float]:
    """Target of each source: all sizes shared by weight, none above `most` times its size, the excess shared again among
    the others by weight until none is above."""
    out, open_ = [0.0] * len(sizes), [k for k, s in enumerate(sizes) if s]
    total = float(sum(sizes))
    while open_:
        unit = total / sum(weights[k % len(weights)] for k in open_)
        over = [k for k in open_ if weights[k % len(weights)] * unit > most * sizes[k]]
        if not over:
            for k in open_:
                out[k] = weights[k % len(weights)] * unit
            break
        for k in over:
            out[k] = float(most * sizes[k])
            total -= out[k]
        open_ = [k for k in open_ if k not in set(over)]
    return out


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key & (2**64 - 1))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def permuted(x: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of range(n) at x (or its inverse): a Feistel network over the next power of four, walked
    until it is back below n."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    h, mask = np.uint64(half), np.uint64((1 << half) - 1)
    x = x.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        v = x[todo]
        left, right = v >> h, v & mask
        for r in reversed(range(4)) if back else range(4):
            if back:
                left, right = right ^ (_mix(left, key * 4 + r) & mask), left
            else:
                left, right = right, left ^ (_mix(right, key * 4 + r) & mask)
        x[todo] = (left << h) | right
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def draw(quotas: list[int], shards: int, seed: int):
    """Yields for each shard the sources that fill slots of it, how many, and how many they have filled before: multinomial draws by
    what is left of the quotas. What a draw gives a source beyond its rest is drawn again among the others."""
    left = np.array(quotas, np.int64)
    full, total, rng = left.copy(), int(left.sum()), np.random.default_rng(seed)
    for j in range(shards):
        need, before = total // shards + (j < total % shards), full - left
        while need:
            got = np.minimum(rng.multinomial(need, left / left.sum()), left)
            left -= got
            need -= int(got.sum())
        n = full - left - before
        some = np.flatnonzero(n)
        yield some, n[some], before[some]


def key_of(source: int, epoch: int, seed: int) -> int:
    return (seed * 1_000_003 + source) * 1_000_003 + epoch


def quota(size: int, target: float, block: int, source: int, seed: int) -> int:
    """Blocks that a source gives: whole rounds, and of the next round's permutation so many that the words come nearest to the
    target, the short last block reckoned with."""
    n = -(-size // block)
    if not n:
        return 0
    rounds = int(target / size + 1e-9)
    rest = max(0.0, target - rounds * size)
    short = n * block - size
    at = int(permuted(np.array([n - 1]), n, key_of(source, rounds, seed), back=True)[0])
    best = min((abs(k * block - short * (k > at) - rest), k) for k in {min(n, max(0, int(rest // block) + d)) for d in (-1, 0, 1, 2)})
    return rounds * n + best[1]


def slotted(batches, seed: int):
    """Plan rows (sid, shard, n, first, last) to slots (sid, shard, epoch, block)."""
    for batch in batches:
        for r in batch.to_pylist():
            x = np.arange(r["first"], r["last"])
            epochs, at = x // r["n"], x % r["n"]
            block = np.empty(len(x), np.int64)
            for e in np.unique(epochs):
                own = epochs == e
                block[own] = permuted(at[own], r["n"], key_of(r["sid"], int(e), seed))
            full = lambda v: pa.array(np.full(len(x), v, np.int32))
            yield pa.RecordBatch.from_arrays([full(r["sid"]), full(r["shard"]), pa.array(epochs.astype(np.int32)), pa.array(block)], ["sid", "shard", "epoch", "block"])


def positions(docs: DataFrame, text: str, source: str, keep: tuple[str, ...] = ()) -> tuple[DataFrame, list[tuple[str | None, int]]]:
    """One narrow row a document, saved: _rid, the hashes _h and _h2 of the whole row, _size, _sid and _at (words before it in
    its source), and the columns to keep; no text. And the sources with their sizes."""
    spark = docs.sparkSession
    rows = docs.select(
        *keep,
        F.col(source).cast("string").alias("_name"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
        *hashes(docs),
    )
    rows = common.saved(rows.groupBy(*keep, "_name", "_size", "_h", "_h2").agg(F.count(F.lit(1)).alias("_copies")), "sizes")
    buckets = max(BUCKETS, -(-rows.count() // BUCKET_ROWS))
    rows = rows.withColumns({"_bucket": F.pmod("_h", F.lit(buckets)).cast("int"), "_all": F.col("_size") * F.col("_copies")})
    sums = rows.groupBy("_name", "_bucket").agg(F.sum("_all").alias("n"))
    sums = common.saved(sums, "sums")  # at most as many rows a source as there are buckets
    found = [(r[0], r[1]) for r in sums.groupBy("_name").agg(F.sum("n")).collect()]  # a row for each source
    found.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sids = spark.createDataFrame([(s, k) for k, (s, _) in enumerate(found)], "_source string, _sid int")
    numbered = sids, F.col("_name").eqNullSafe(F.col("_source"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("_name").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = sums.withColumn("_base", before).join(*numbered).select("_sid", "_bucket", "_base")
    own = F.coalesce(F.sum("_all").over(W.partitionBy("_sid", "_bucket").orderBy("_h", "_h2").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = (
        rows.join(*numbered)
        .withColumn("_at", own)
        .join(base.hint("merge"), ["_sid", "_bucket"])
        .withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
        .select(*keep, "_h", "_h2", "_size", "_sid", (F.col("_at") + F.col("_base") + F.col("_copy") * F.col("_size")).alias("_at"), F.monotonically_increasing_id().alias("_rid"))
    )
    return common.saved(rows, "placed"), found


def _has_map(kind) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType)


def hashes(docs: DataFrame) -> list:
    """96 bits that tell rows apart. Spark doesn't hash maps: columns that hold some are hashed as JSON."""
    names = [f"`{f.name}`" if not _has_map(f.dataType) else F.to_json(F.struct(f"`{f.name}`")) for f in sorted(docs.schema, key=lambda f: f.name)]
    return [F.xxhash64(*names).alias("_h"), F.hash(*names).alias("_h2")]


def mixed(placed: DataFrame, sources: list[tuple[str | None, int]], block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> tuple[DataFrame, list[float]]:
    """placed: from positions(). Returns the mix, one row for each document in a slot's block (_rid, shard, epoch, block, first,
    last: words of the document), and the sources' targets."""
    spark = placed.sparkSession
    goal = targets([n for _, n in sources])
    quotas = [quota(n, t, block, k, seed) for k, ((_, n), t) in enumerate(zip(sources, goal))]
    size = np.array([-(-n // block) for _, n in sources], np.int64)
    plan = [(some.astype(np.int32), np.full(len(some), j, np.int32), size[some], before, before + n) for j, (some, n, before) in enumerate(draw(quotas, shards, seed))]
    plan = pa.table([np.concatenate(c) for c in zip(*plan)], ["sid", "shard", "n", "first", "last"])
    plan = spark.createDataFrame(plan)
    plan = plan.withColumn("first", F.explode(F.sequence("first", F.col("last") - 1, F.lit(CHUNK)))).withColumn("last", F.least(F.col("first") + CHUNK, "last"))
    slots = plan.repartition(F.xxhash64("sid", "shard", "first")).mapInArrow(
        common.on_workers(__name__, "slotted", seed=seed), "sid int, shard int, epoch int, block long"
    )
    size, at = F.col("_size"), F.col("_at")
    parts = (
        placed.where("_size > 0").select("_rid", "_sid", "_size", "_at", F.explode(F.sequence(F.expr(f"_at div {block}"), F.expr(f"(_at + _size - 1) div {block}"))).alias("block"))
        .select(
            "_rid", F.col("_sid").alias("sid"), "block",
            F.greatest(F.lit(0), F.col("block") * block - at).alias("first"),
            F.least(size, (F.col("block") + 1) * block - at).alias("last"),
        )
    )
    # the plan's few rows become many slots: a merge join, which no size estimate turns into a broadcast
    return slots.hint("merge").join(parts, ["sid", "block"]).select("_rid", "shard", "epoch", "block", "first", "last"), goal


def mix_report(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, size, source_size, target, taken) of every row: how many words of it the mix takes.

    A null text has size 0 and is never taken; a null source is a source, the last. Repeated rows are documents like any
    other. An empty table gives no rows. Other columns are ignored.
    """
    with common.temporary():
        placed, sources = positions(docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(source).alias("s")), "t", "s", ("k",))
        common.kept(placed)
    rows, goal = mixed(placed, sources)
    of = docs.sparkSession.createDataFrame([(k, n, t) for k, ((_, n), t) in enumerate(zip(sources, goal))], "_sid int, source_size long, target double")
    taken = rows.groupBy("_rid").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    return (
        placed.select("_rid", "k", "_size", "_sid").join(taken, "_rid", "left").join(of, "_sid")
        .select(F.col("k").alias(key), F.col("_size").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )


def cut(batches, names: list[str], text: str):
    """Rows with their runs (epoch, first, last) to one row for each run, its text cut at word bounds."""
    import re

    word = re.compile(r"[^\x20\x09-\x0d]+")
    for batch in batches:
        at, texts = [], []
        for k in range(batch.num_rows):
            t, bounds = batch.column(names.index(text))[k].as_py(), None
            for r in batch.column(len(names) + 1)[k].as_py():
                at.append(k)
                if r["first"] == 0 and r["last"] == batch.column(len(names))[k].as_py():
                    texts.append(t)
                else:
                    bounds = bounds or [m.span() for m in word.finditer(t)]
                    texts.append(t[bounds[r["first"]][0] : bounds[r["last"] - 1][1]])
        out = batch.select(names).take(pa.array(at, pa.int64()))
        cols = [pa.array(texts, pa.string()) if n == text else pa.array([len(t) for t in texts], pa.int64()) if n == "n_chars" else out.column(n) for n in names]
        for s in range(0, len(at), 512):
            yield pa.RecordBatch.from_arrays([c.slice(s, 512) for c in cols], names)


def mix_documents(docs: DataFrame, text: str = "text", source: str = "source", block: int = BLOCK) -> DataFrame:
    """The mix as documents, with the columns of docs (n_chars follows the text): a document that a round takes as a whole comes
    back whole, else in runs of neighbouring blocks. Documents without words don't come back. Columns of any name and kind stay.
    Otherwise as mix_report."""
    names = docs.columns
    with common.temporary():
        placed, sources = positions(docs, text, source)
        rows, _ = mixed(placed, sources, block)
        order = W.partitionBy("_rid", "epoch").orderBy("block")
        runs = (
            rows.withColumn("_run", F.col("block") - F.row_number().over(order))
            .groupBy("_rid", "epoch", "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
            .groupBy("_rid").agg(F.sort_array(F.collect_list(F.struct("epoch", "first", "last"))).alias("_runs"))  # at most MOST_TIMES times a document's blocks
            .join(placed.select("_rid", "_h", "_h2", "_size"), "_rid").select("_h", "_h2", "_size", "_runs")
        )
        runs = common.kept(common.saved(runs, "runs"))
    schema = ", ".join(f"`{f.name}` {'long' if f.name == 'n_chars' else f.dataType.simpleString()}" for f in docs.schema)
    own = common.fresh(names, "_h", "_h2", "_size", "_runs")
    whole = docs.select(*(f"`{n}`" for n in names), *(c.alias(n) for c, n in zip(hashes(docs), own)))
    whole = whole.dropDuplicates(own[:2]).join(runs.toDF(*own), own[:2])
    return whole.select(*(f"`{n}`" for n in names), *own[2:]).mapInArrow(common.on_workers(__name__, "cut", names=names, text=text), schema)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    return mix_report(common.table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
