"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, rerank with the original vectors.

A rotation learnt on a bounded sample turns each vector into 64 balanced bits. The code's four 16-bit parts are the tables;
vectors are candidates when some part differs in at most one bit, which holds for every pair of codes up to 7 bits apart
and for most pairs farther. When at most one bit of a part differs, one of its bytes is equal and one half of the other byte:
each part is looked up by these twelve bits, in four ways. So a code is stored sixteen times, not once for each of the 68
neighbouring keys of its parts. Another 64 bits of random directions spare candidates that are far apart: at cosine 0.95 some 10 %
of the bits differ, 13 of 128 with a deviation of 3.4, and at most FAR may. What is left is reranked by the cosine in double
precision; a pair counts in the first bucket that has it.

Scale: equal vectors are one class from the start. Only codes go through the tables, 24 bytes each; vectors are fetched once for the
classes that have candidates, and travel to the buckets where they have some. A bucket with more than BLOCK classes is dealt over
blocks by hash, and block pairs are compared by tasks of bounded size: nothing is capped. A block pair returns link counts and a
spanning forest, so a dense group costs its members, not its pairs, in the shuffle. A bucket holds 1/4096 of the classes when bits
are balanced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

COSINE = 0.95
#: The rotations are fitted on about so many vectors in all, those with the smallest hashes, at most twice as many.
SAMPLE = 8192
ROUNDS = 40
BITS, TABLES, WAYS, KEYS = 64, 4, 4, 4096
#: Bits that may differ of the first 64 and of all 128.
FAR = (18, 30)
BLOCK = 1024
SEED = 20240

Model = tuple[np.ndarray, np.ndarray]


def random_axes(d: int, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, d]).standard_normal((d, bits))


def fit(vectors: np.ndarray, bits: int = BITS, rounds: int = ROUNDS) -> Model:
    """(mean, projection) of the sign code: principal axes, turned so that signs lose least. With fewer dimensions than bits,
    random directions take the place of the axes."""
    x = units(vectors)
    mean = x.mean(axis=0)
    if x.shape[1] >= bits:
        _, _, axes = np.linalg.svd(x - mean, full_matrices=False)
        axes = axes[:bits].T
    else:
        axes = random_axes(x.shape[1], bits)
    v = (x - mean) @ axes
    turn, _ = np.linalg.qr(np.random.default_rng(SEED).standard_normal((bits, bits)))
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
        turn = right.T @ left.T
    return mean, axes @ turn


def words_of(model: Model | None, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two words of the codes; without a model all directions are random."""
    d = unit.shape[1]
    mean, axes = model or (np.zeros(d), random_axes(d))
    both = (unit - mean) @ np.hstack([axes, random_axes(d, seed=SEED + 1)]) >= 0
    packed = np.packbits(both, axis=1, bitorder="little").view("<u8")
    return packed[:, 0].copy(), packed[:, 1].copy()


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision; by their largest component first, so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def coded(batches, models: dict[int, Model]):
    """(k, h1, h2, embedding) of good vectors, null embedding for others, to (k, h1, h2, d, c0, c1)."""
    for batch in batches:
        given = batch.column(3)
        sizes = np.array([len(x) if x.is_valid else -1 for x in given])
        words = np.zeros((2, len(sizes)), np.uint64)
        for d in np.unique(sizes[sizes > 0]):
            at = np.flatnonzero(sizes == d)
            x = given.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64)
            words[:, at] = words_of(models.get(int(d)), units(x))
        none = sizes < 0
        cols = [pa.array(sizes, pa.int32(), mask=none), *(pa.array(w.view(np.int64), mask=none) for w in words)]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), *cols], ["k", "h1", "h2", "d", "c0", "c1"])


def key_column(code: Column, place: int) -> Column:
    """Twelve bits of a part: one byte, and one half of the other byte."""
    table, byte, half = place // WAYS, place // 2 % 2, place % 2
    one = F.shiftrightunsigned(code, 16 * table + 8 * byte).bitwiseAND(255)
    other = F.shiftrightunsigned(code, 16 * table + 8 * (1 - byte) + 4 * half).bitwiseAND(15)
    return one * 16 + other


def key_of(codes: np.ndarray, place: int) -> np.ndarray:
    """The same of an array."""
    table, byte, half = place // WAYS, place // 2 % 2, place % 2
    one = (codes >> np.uint64(16 * table + 8 * byte)) & np.uint64(255)
    other = (codes >> np.uint64(16 * table + 8 * (1 - byte) + 4 * half)) & np.uint64(15)
    return one << np.uint64(4) | other


def candidates(a: np.ndarray, b: np.ndarray, place: int) -> np.ndarray:
    """Pairs of codes in one bucket of a place that no earlier bucket has and whose part differs in at most one bit. Equal parts
    meet in all four ways and count in the first; parts with one differing bit meet in one way only."""
    x = a[:, None] ^ b[None, :]
    mine = (x >> np.uint64(16 * (place // WAYS))) & np.uint64(0xFFFF)
    hit = np.bitwise_count(mine) <= 1
    if place % WAYS:
        hit &= mine != 0
    for t in range(place // WAYS):
        hit &= np.bitwise_count((x >> np.uint64(16 * t)) & np.uint64(0xFFFF)) > 1
    return hit


def close(a: list[np.ndarray], b: list[np.ndarray], place: int) -> np.ndarray:
    """Candidates whose codes (two words each) aren't far apart."""
    hit = candidates(a[0], b[0], place)
    i, j = np.nonzero(hit)
    d = np.bitwise_count(a[0][i] ^ b[0][j]).astype(np.int32)
    far = (d > FAR[0]) | (d + np.bitwise_count(a[1][i] ^ b[1][j]) > FAR[1])
    hit[i[far], j[far]] = False
    return hit


def matched(batches):
    """Block pairs (bucket, block, other; cids, words; the same of the other block, null for pairs inside the block) to the members of
    candidate pairs (bucket, block, other, side, cid, c0, c1)."""
    names = ["bucket", "block", "other", "side", "cid", "c0", "c1"]

    def side(row):
        cid, *words = (x.values.to_numpy(zero_copy_only=False) for x in row)
        return cid, [w.view(np.uint64) for w in words]

    for batch in batches:
        out = []
        for k in range(batch.num_rows):
            row = [batch.column(c)[k] for c in range(9)]
            own = not row[6].is_valid
            if own and len(row[3]) < 2:
                continue
            bucket, block = row[0].as_py(), row[1].as_py()
            a = side(row[3:6])
            b = a if own else side(row[6:])
            hit = close(a[1], b[1], bucket // KEYS % (WAYS * TABLES))
            if own:
                np.fill_diagonal(hit, False)
            for n, (cid, words), some in ((0, a, hit.any(axis=1)), *([] if own else [(1, b, hit.any(axis=0))])):
                at = np.flatnonzero(some)
                if len(at):
                    out.append((np.full(len(at), bucket), np.full(len(at), block), np.full(len(at), -1 if own else row[2].as_py()), np.full(len(at), n), cid[at], *(w[at].view(np.int64) for w in words)))
        if out:
            cols = [np.concatenate(c) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32 if n in ("block", "other", "side") else np.int64)) for n, c in zip(names, cols)], names)


def chosen(batches, bits: np.ndarray):
    """(h1, h2, embedding) to (h1, h2, vec: the components as bytes) of the rows whose h1 is in the bit set, and perhaps a few others."""
    for batch in batches:
        rows = np.flatnonzero(common.in_bits(batch.column(0).to_numpy(), bits))
        vecs = [batch.column(2)[k].values.to_numpy(zero_copy_only=False).tobytes() for k in rows.tolist()]
        part = batch.select([0, 1]).take(pa.array(rows))
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vecs, pa.binary())], ["h1", "h2", "vec"])


def reranked(batches, cosine: float, kind: str):
    """Block pairs (bucket, other, members: side, cid, m, c0, c1, vec) to rows (a, b, n): link counts (a, null, n) and links of a
    spanning forest (a, b, null)."""
    for batch in batches:
        out = []
        for k in range(batch.num_rows):
            rows = batch.column(2)[k].values
            of = np.array(rows.field("side"))
            ids, m = np.array(rows.field("cid")), np.array(rows.field("m"))
            words = [np.array(rows.field(c)).view(np.uint64) for c in ("c0", "c1")]
            vecs = units(np.frombuffer(b"".join(rows.field("vec").to_pylist()), kind).reshape(len(ids), -1).astype(np.float64))
            own = batch.column(1)[k].as_py() < 0
            a = np.flatnonzero(of == 0)
            b = a if own else np.flatnonzero(of == 1)
            hit = close([w[a] for w in words], [w[b] for w in words], batch.column(0)[k].as_py() // KEYS % (WAYS * TABLES))
            if own:
                hit &= np.tri(len(a), dtype=bool).T
                np.fill_diagonal(hit, False)
            n = int(hit.sum())
            if n * 20 > hit.size:
                hit &= vecs[a] @ vecs[b].T >= cosine
            else:
                i, j = np.nonzero(hit)
                for at in range(0, n, 65536):
                    s = slice(at, at + 65536)
                    hit[i[s], j[s]] = np.einsum("ij,ij->i", vecs[a[i[s]]], vecs[b[j[s]]]) >= cosine
            if not hit.any():
                continue
            for at, sums in ((a, hit @ m[b]), (b, m[a] @ hit)):
                some = np.flatnonzero(sums)
                out.append((ids[at[some]], np.zeros(len(some), np.int64), sums[some], np.ones(len(some), bool)))
            e, t = common.stars(hit, ids[a], ids[b])
            out.append((e, t, np.zeros(len(e), np.int64), np.zeros(len(e), bool)))
        if out:
            x = [np.concatenate([o[c] for o in out]) for c in range(4)]
            cols = [pa.array(x[0].astype(np.int64)), pa.array(x[1].astype(np.int64), mask=x[3]), pa.array(x[2].astype(np.int64), mask=~x[3])]
            yield pa.RecordBatch.from_arrays(cols, ["a", "b", "n"])


def models_of(rows: DataFrame, sample: int = SAMPLE) -> dict[int, Model]:
    """rows: h1, embedding. A model for each length of vectors that the sample holds often enough, two samples for each bit; so there
    are at most sample / BITS models, whatever the lengths, made with two jobs."""
    n = rows.count()
    if not n:
        return {}
    few = F.pmod(F.xxhash64("h1", F.lit(SEED)), F.lit(1 << 20)) < F.lit(max(1, min(1 << 20, sample * (1 << 20) // n)))
    found = rows.where(few).select("embedding").limit(2 * sample).toArrow()["embedding"].to_pylist()  # at most 2 * sample rows
    by: dict[int, set] = {}
    for v in found:
        by.setdefault(len(v), set()).add(tuple(v))
    return {d: fit(np.array(sorted(x), np.float64)) for d, x in by.items() if len(x) >= 2 * BITS}


def block_pairs(classes: DataFrame, block: int) -> DataFrame:
    """classes: a saved table of cid, d, c0, c1. Block pairs of all buckets, those inside a block with null arrays on the right."""
    place = F.array(*(F.struct(((F.col("d") * (WAYS * TABLES) + p) * KEYS + key_column(F.col("c0"), p)).cast("long").alias("bucket")) for p in range(WAYS * TABLES)))
    rows = classes.select("cid", "c0", "c1", F.inline(place))
    large = common.saved(rows.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).where("blocks > 1"), "buckets")
    names = ["cid", "c0", "c1"]

    def gathered(dealt: DataFrame) -> DataFrame:
        return dealt.repartition("bucket", "block").groupBy("bucket", "block").agg(*(F.collect_list(c).alias(c) for c in names))

    dealt = rows.join(large, "bucket", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("cid"), "blocks"), F.lit(0)).cast("int")).drop("blocks")
    own = gathered(dealt).select("bucket", "block", F.lit(None).cast("int").alias("other"), *names, *(F.lit(None).cast("array<long>").alias(f"{c}_") for c in names))
    if large.isEmpty():
        return own
    split = common.saved(gathered(dealt.join(large.select("bucket"), "bucket", "left_semi")), "blocks")
    numbers = lambda low: F.explode(F.sequence(low, F.col("blocks") - 1))
    pairs = large.withColumn("block", numbers(F.lit(0))).where("block + 1 < blocks").withColumn("other", numbers(F.col("block") + 1)).drop("blocks")
    right = split.select("bucket", F.col("block").alias("other"), *(F.col(c).alias(f"{c}_") for c in names))
    across = pairs.join(split, ["bucket", "block"]).join(right, ["bucket", "other"])
    return own.unionAll(across.select(*own.columns))


def found_links(rows: DataFrame, classes: DataFrame, cosine: float, block: int, kind: str) -> DataFrame:
    """rows: h1, h2, embedding of all good vectors. classes: a saved table of cid, h1, h2, m, d, c0, c1. See reranked()."""
    schema = "bucket long, block int, other int, side int, cid long, c0 long, c1 long"
    hits = common.saved(block_pairs(classes, block).mapInArrow(common.on_workers(__name__, "matched"), schema), "hits")
    wanted = common.saved(hits.select("cid").distinct().join(classes.select("cid", "m", "h1", "h2"), "cid"), "wanted")
    bits = common.bit_set(wanted.select(F.col("h1").alias("mark")))
    vecs = rows.mapInArrow(common.on_workers(__name__, "chosen", bits=bits), "h1 long, h2 long, vec binary")
    vecs = common.saved(vecs.groupBy("h1", "h2").agg(F.first("vec").alias("vec")).join(wanted, ["h1", "h2"]).select("cid", "m", "vec"), "vectors")
    pairs = hits.join(vecs, "cid").groupBy("bucket", "block", "other").agg(F.collect_list(F.struct("side", "cid", "m", "c0", "c1", "vec")).alias("r"))
    return pairs.select("bucket", "other", "r").mapInArrow(common.on_workers(__name__, "reranked", cosine=cosine, kind=kind), "a long, b long, n long")


def near_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", cosine: float = COSINE, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """One row per vector: key, n_links (other rows linked directly), component_id (smallest key reachable) and kept.

    Vectors that are null, zero, or hold null or non-finite components link with nothing, nor do vectors of different lengths
    with each other. Equal vectors always link; they are told by 128 bits of hashes. A null key takes part like any other and is
    never the component's id unless all of it is null. Every row comes back once; an empty table gives no rows. Other columns are
    ignored.
    """
    x = F.col(column)
    good = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    hashes = F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(SEED), x, F.size(x)).alias("h2")
    element = vectors.schema[column].dataType.elementType.simpleString()
    kind, wide = ("<f4", "float") if element == "float" else ("<f8", "double")
    rows = vectors.select(F.col(key).alias("k"), *hashes, F.when(F.coalesce(good, F.lit(False)), x).cast(f"array<{wide}>").alias("embedding"))
    some = rows.where("embedding is not null")
    ids = f"k {vectors.schema[key].dataType.simpleString()}, h1 long, h2 long, d int, c0 long, c1 long"
    with common.temporary():
        codes = common.saved(rows.mapInArrow(common.on_workers(__name__, "coded", models=models_of(some, sample)), ids), "codes")
        grouped = codes.where("d is not null").groupBy("h1", "h2").agg(F.min("k").alias("low"), F.count(F.lit(1)).alias("m"), F.min(F.struct("d", "c0", "c1")).alias("c"))
        classes = common.saved(grouped.select("h1", "h2", "low", "m", "c.*", F.monotonically_increasing_id().alias("cid")), "classes")  # written at once: the numbers stay
        found = common.saved(found_links(some.select("h1", "h2", "embedding"), classes, cosine, block, kind), "found")
        counts = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
        groups = common.components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "cid")
        known = classes.join(counts, "cid", "left").join(groups, "cid", "left").select(
            "h1", "h2", "cid", "low", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("grp")
        )
        lowest = known.groupBy("grp").agg(F.min("low").alias("component_id"))
        known = common.kept(common.saved(known.join(lowest, "grp").select(F.lit(True).alias("good"), "h1", "h2", "n_links", "component_id"), "known"))
        common.kept(codes)
    out = codes.withColumn("good", F.col("d").isNotNull()).join(known, ["good", "h1", "h2"], "left").select(
        F.col("k").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("good"), F.col("component_id")).otherwise(F.col("k")).alias("component_id"),
    )
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings."""
    return near_vectors(common.table(spark, sf_dir, "embeddings"))


#: All pairs: for small tables, which the index must agree with.
OP9_SQL = f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS i, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT i, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.i AS a, b.i AS b FROM good a JOIN good b ON a.i <> b.i AND len(a.e) = len(b.e) AND CASE WHEN len(a.e) = len(b.e) THEN list_dot_product(a.e, b.e) / (a.n * b.n) ELSE 0 END >= {COSINE}),
reach AS (SELECT i, i AS j FROM v UNION SELECT reach.i, link.b FROM reach JOIN link ON link.a = reach.j),
c AS (SELECT reach.i, min(o.vec_id) AS component_id FROM reach JOIN v o ON o.i = reach.j GROUP BY reach.i),
n AS (SELECT a AS i, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN c USING (i) LEFT JOIN n USING (i)"""
