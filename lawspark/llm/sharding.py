"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `vnodes` points of a 64-bit ring; a key belongs to the next point clockwise. No shard takes more than its
capacity: keys beyond it continue clockwise to the next point whose shard has room. Keys are settled in two passes, all own
keys first, then the overflow in ring order, so that a key moves only when its own shard is truly full.

Scale: rows meet the ring by a hash join on the top bits of their hash with a table of at most `2**ring_bits + shards *
vnodes` arc pieces, which is broadcast because that bound doesn't depend on the data. Counts per arc piece (the same bound)
are all that the driver sees. Ranks are taken inside arc pieces, thousands of groups of equal expected size whatever the
sources or texts; equal rows, which share a place on the ring, are one row with a count there. Two scans, shuffles of
(id, size, checksum) rows, no Python on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

SHARDS = 24
VNODES = 64
RING_BITS = 12


def arc_pieces(spark: SparkSession, shards: int, vnodes: int, ring_bits: int) -> DataFrame:
    """The ring as rows (piece, bucket, low, high, shard): keys with low < hash <= high in the bucket (top bits of the
    hash) belong to the shard. Pieces are numbered clockwise; each lies in one bucket."""
    width = 1 << (64 - ring_bits)
    points = spark.range(shards * vnodes).select(
        (F.col("id") % shards).cast("int").alias("shard"),
        F.xxhash64(F.lit("point"), F.col("id") % shards, F.floor(F.col("id") / shards)).alias("at"),
    )
    points = points.groupBy("at").agg(F.min("shard").alias("shard"))
    ring = points.collect()  # shards * vnodes rows at most, whatever the data
    ring = sorted((r["at"], r["shard"]) for r in ring)
    first = ring[0][1]
    lowest, pieces, low = -(1 << 63), [], -(1 << 63)
    for bucket in range(1 << ring_bits):
        end = lowest + (bucket + 1) * width - 1
        while ring and ring[0][0] <= end:
            at, shard = ring.pop(0)
            pieces.append((len(pieces), bucket, low, at, shard))
            low = at + 1
        if low <= end:
            pieces.append((len(pieces), bucket, low, end, ring[0][1] if ring else first))
            low = end + 1
    return spark.createDataFrame(pieces, "piece int, bucket int, low long, high long, home int")


def settle(counts: list[tuple[int, int, int]], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """counts: (piece, home shard, keys) of every piece, clockwise. Returns (piece, first rank, end rank, shard, first
    slot): which ranks of a piece go to which shard, no shard above its capacity. The capacities must hold all keys."""
    free, slot, plan, rest = list(capacity), [0] * len(capacity), [], []

    def give(piece: int, start: int, shard: int, n: int) -> None:
        plan.append((piece, start, start + n, shard, slot[shard]))
        slot[shard] += n
        free[shard] -= n

    for k, (piece, home, n) in enumerate(counts):
        if take := min(n, free[home]):
            give(piece, 0, home, take)
        if n > take:
            rest.append((k, take))
    for k, start in rest:
        piece, _, n = counts[k]
        step = k
        while start < n:
            step += 1
            if step > k + len(counts):  # every shard on the ring is full: the others take what is left
                shard = next(s for s, f in enumerate(free) if f)
            else:
                shard = counts[step % len(counts)][1]
            if take := min(n - start, free[shard]):
                give(piece, start, shard, take)
                start += take
    return plan


def capacities(n: int, shards: int, load: float | None) -> list[int]:
    """load None: exactly n keys, counts at most one apart. Else ceil(load * n / shards) for every shard (load >= 1)."""
    if load is None:
        return [n // shards + (s < n % shards) for s in range(shards)]
    if load < 1:
        raise ValueError("load must be 1 or more")
    return [-int(-load * n // shards)] * shards


def bounded_ring(
    rows: DataFrame,
    key_hash: Column,
    order_by: list[str],
    shards: int = SHARDS,
    vnodes: int = VNODES,
    load: float | None = None,
    ring_bits: int = RING_BITS,
    copies: str | None = None,
) -> DataFrame:
    """rows plus home_shard (by the plain ring), shard and slot (gapless from 0 in each shard).

    key_hash: the 64-bit ring position of a row; order_by: columns that rank rows inside a piece of the ring after the
    position. Rows equal in all of them are exchangeable. copies: a column that says how many rows a row stands for (it goes);
    rows that are equal throughout should be counted so before, as a piece of the ring is sorted by one task. Null or repeated
    keys are rows like any other; an empty table gives no rows; columns of rows keep their values whatever their names, but for
    those named home_shard, shard and slot, which are replaced.
    """
    spark = rows.sparkSession
    pieces = arc_pieces(spark, shards, vnodes, ring_bits)
    names = [c for c in rows.columns if c not in ("home_shard", "shard", "slot", copies)]
    (out,) = common.fresh(names, "_placed")
    low_bucket = 1 << (ring_bits - 1)
    position = F.struct(key_hash.alias("hash"), F.struct(*order_by).alias("order"), (F.col(copies) if copies else F.lit(1)).cast("long").alias("n"))
    placed = (
        rows.select(F.struct(*(f"`{c}`" for c in names)).alias("row"), position.alias("at"))
        .select("row", "at.*").withColumn("_bucket", (F.shiftright("hash", 64 - ring_bits) + low_bucket).cast("int"))
        .join(F.broadcast(pieces), (F.col("_bucket") == F.col("bucket")) & F.col("hash").between(F.col("low"), F.col("high")))
    )
    found = {r["piece"]: r["n"] for r in placed.groupBy("piece").agg(F.sum("n").alias("n")).collect()}  # <= pieces
    ring = [(r["piece"], r["home"], found.get(r["piece"], 0)) for r in pieces.orderBy("piece").collect()]
    plan = settle(ring, capacities(sum(found.values()), shards, load))
    plan = spark.createDataFrame(plan, "_piece int, _from long, _to long, shard int, _slot long")  # <= pieces + shards * pieces with overflow
    before = F.sum("n").over(W.partitionBy("piece").orderBy("hash", "order").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    ranked = placed.withColumn("first", before).select("row", "home", "piece", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("rank"))
    place = F.struct(F.col("home").alias("home_shard"), F.col("shard"), (F.col("_slot") + F.col("rank") - F.col("_from")).alias("slot"))
    return (
        ranked.join(F.broadcast(plan), (F.col("piece") == F.col("_piece")) & (F.col("rank") >= F.col("_from")) & (F.col("rank") < F.col("_to")))
        .select("row.*", place.alias(out)).select(*(f"`{c}`" for c in names), f"`{out}`.*")
    )


def op4_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards under the law `rows`: counts at most one apart.

    The ring's key is doc_id; a null doc_id is placed by its text's checksum. size: UTF-8 bytes plus 8; a null text has
    none, and the checksum of no bytes (0). Copies with ids of their own are placed apart: one group may exceed a shard.
    An empty table gives no rows. grown_shard is null, as the law isn't `key`.
    """
    docs = common.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
    )
    docs = docs.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    key = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit("none"), "text_crc32", "size")).otherwise(F.xxhash64("doc_id"))
    out = bounded_ring(docs, key, ["doc_id", "text_crc32", "size"], copies="copies")
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "home_shard",
    )
