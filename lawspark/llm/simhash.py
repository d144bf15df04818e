"""SimHash near-duplicates by exact tiled comparison.

Two uses of one comparison. `near_duplicates` links 64-bit fingerprints of 3-word shingles within two bits. Distinct fingerprints
are tiles of the population counts of their four 16-bit parts. Counts that differ by more than the radius in sum rule a pair of
tiles out, since each differing bit changes one count by one; all other tile pairs are compared in full with numpy's exclusive-or
and bit counts. No candidate is missed, none is capped.

`one_of_each` keeps one text of each group whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more. A set's
fingerprint has 256 bits here: at similarity 0.8 some 15 % of the bits differ, 39 of 256 with a deviation of 6, while unrelated sets
differ in 128, so that a radius of 64 bits finds the similar pairs and next to nothing else. Tiles are those of the population
counts of the sets: of sizes that differ by more than a fifth no two are similar, and such tile pairs are skipped. Candidates that
are connected are then compared by their whole sets, so what is linked is exact.

Scale: copies fall together before anything is compared. There are at most 17^4 tiles of fingerprints whatever the data, and some
two hundred of sizes, their counts are therefore broadcast; a tile with more than a block of fingerprints is dealt over several
blocks by hash, so no task holds more than two blocks. Each block travels to the tiles within the radius, 8 bytes a fingerprint
(48 in the wide case); links leave a block pair as a spanning forest, so a dense group costs its members, not their pairs. Sets
aren't stored but made again of the texts of candidates alone. The work grows with the square of the distinct fingerprints.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RADIUS = 2
SHINGLE = 3
SEED = 42
BLOCK = 4096
PARTS, WIDTH = 4, 16
#: Shingles whose bits are counted at a time.
STEP = 1 << 15

#: Similar sets: shingles, least similarity, words of 64 bits, bits that may differ in the first, the first two and all of them.
SET_SHINGLE, PERCENT = 5, 80
SET_WORDS, SET_RADII = 4, (22, 38, 64)
SET_BLOCK = 1 << 14
#: Tiles of sets by powers of the fourth root of 100/80: similar sets are at most four tiles apart.
SET_STEPS = 4
#: Shingles of a block of whole sets, and cells of a block's matrix at a time.
WHOLE_BLOCK, CELLS = 1 << 15, 1 << 23


def shingles(text: str | None, n: int) -> np.ndarray:
    """Hashes of the n-word shingles in their order, A-Z lower-cased; a text of fewer words is one shingle."""
    import xxhash

    words = (text or "").encode().lower().split()  # on bytes: A-Z alone, and white space is 9 to 13 and 32
    if not words:
        return np.empty(0, np.uint64)
    joined, k = b" ".join(words), min(n, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist())), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """Each bit is one if it is set in over half the hashes; 0 of none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), STEP):
        ones += np.unpackbits(hashes[at : at + STEP].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of the 3-word shingles of the text, A-Z lower-cased; 0 without words."""
    return majority(shingles(text, SHINGLE))


def set_of(text: str | None) -> np.ndarray:
    """The sorted distinct 5-word shingles."""
    return np.unique(shingles(text, SET_SHINGLE))


def again(hashes: np.ndarray, k: int) -> np.ndarray:
    """Other hashes of the same shingles."""
    if not k:
        return hashes
    with np.errstate(over="ignore"):
        x = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(29))


def fingerprinted(batches):
    """Arrow batches of (key columns..., text) to (key columns..., fp), fp signed."""
    for batch in batches:
        n = batch.num_columns - 1
        fps = np.array([fingerprint(t.as_py()) for t in batch.column(n)], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n)), pa.array(fps)], [*batch.schema.names[:-1], "fp"])


def compared(batches, radius: int):
    """Block pairs (a, b: lists of fingerprints; same: whether they are one block) to links (a, b)."""
    for batch in batches:
        ends, tops = [], []
        for k in range(batch.num_rows):
            a, b = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in (0, 1))
            x, y = a.view(np.uint64), b.view(np.uint64)  # of signed numbers numpy counts the absolute value's bits
            hit = np.empty((len(a), len(b)), bool)
            for at in range(0, len(a), 256):
                hit[at : at + 256] = np.bitwise_count(x[at : at + 256, None] ^ y[None, :]) <= radius
            if batch.column(2)[k].as_py():
                np.fill_diagonal(hit, False)
            if hit.any():
                e, t = common.stars(hit, a, b)
                ends.append(e)
                tops.append(t)
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ends)), pa.array(np.concatenate(tops))], ["a", "b"])


def part_counts(fp: Column) -> list[Column]:
    return [F.bit_count(F.shiftrightunsigned(fp, WIDTH * k).bitwiseAND((1 << WIDTH) - 1)) for k in range(PARTS)]


def tile_of(counts: list[Column]) -> Column:
    out = F.lit(0)
    for c in counts:
        out = out * (WIDTH + 1) + c
    return out.cast("int")


def links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """distinct: one column fp, no repeats. Links (a, b) that connect exactly the fingerprints that are connected by pairs
    within the radius."""
    parts = [f"p{k}" for k in range(PARTS)]
    rows = distinct.withColumns(dict(zip(parts, part_counts(F.col("fp")))))
    rows = rows.withColumn("tile", tile_of([F.col(p) for p in parts]))
    tiles = common.saved(
        rows.groupBy("tile", *parts).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")), "tiles"
    )  # at most 17^4 rows
    blocks = common.saved(
        rows.select("fp", "tile").join(F.broadcast(tiles.select("tile", "blocks")), "tile")
        .withColumn("block", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
        .groupBy("tile", "block").agg(F.collect_list("fp").alias("fps")),
        "blocks",
    )
    steps = [s for s in itertools.product(range(-radius, radius + 1), repeat=PARTS) if sum(map(abs, s)) <= radius and s >= (0,) * PARTS]
    near = F.explode(F.array(*(F.struct(*(F.lit(x).alias(p) for x, p in zip(s, parts)), F.lit(not any(s)).alias("own")) for s in steps))).alias("s")
    moved = [F.col(p) + F.col(f"s.{p}") for p in parts]
    inside = F.lit(True)
    for m in moved:
        inside = inside & m.between(0, WIDTH)
    pairs = (
        tiles.select("tile", "blocks", *parts, near).where(inside)
        .select(F.col("tile").alias("ta"), F.col("blocks").alias("na"), tile_of(moved).alias("tb"), F.col("s.own").alias("own"))
        .join(F.broadcast(tiles.select(F.col("tile").alias("tb"), F.col("blocks").alias("nb"))), "tb")
        .withColumn("ba", F.explode(F.sequence(F.lit(0), F.col("na") - 1)))
        .withColumn("bb", F.explode(F.sequence(F.when(F.col("own"), F.col("ba")).otherwise(F.lit(0)), F.col("nb") - 1)))
        .select("ta", "ba", "tb", "bb", (F.col("own") & (F.col("ba") == F.col("bb"))).alias("same"))
    )
    left = blocks.select(F.col("tile").alias("ta"), F.col("block").alias("ba"), F.col("fps").alias("a"))
    right = blocks.select(F.col("tile").alias("tb"), F.col("block").alias("bb"), F.col("fps").alias("b"))
    return (
        pairs.join(left, ["ta", "ba"]).join(right, ["tb", "bb"]).select("a", "b", "same")
        .mapInArrow(common.on_workers(__name__, "compared", radius=radius), "a long, b long")
    )


def fingerprints(docs: DataFrame, text: str) -> DataFrame:
    """docs without its text, plus fp (signed 64 bits)."""
    keys = [c for c in docs.columns if c not in (text, "fp")]
    rows = docs.select(*(f"`{c}`" for c in keys), f"`{text}`")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]] + ["fp long"])
    return rows.mapInArrow(common.on_workers(__name__, "fingerprinted"), schema)


def groups(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """fps: a saved table with a column fp. One row per distinct fp with grp, the smallest fp connected to it."""
    with common.temporary():
        distinct = common.saved(fps.select("fp").distinct(), "distinct")
        found = common.components(links(distinct, radius, block))
        found = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("grp"))
        return common.kept(common.saved(found, "groups"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(key, fp, component_id): component_id is the smallest key among documents connected by fingerprints within the
    radius, itself included; null only where all of them are null.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows come back as often as they
    were given. An empty table gives no rows. Other columns are ignored.
    """
    fps = common.saved(fingerprints(docs.select(key, text), text), "fingerprints")
    by_fp = fps.groupBy("fp").agg(F.min(key).alias("low")).join(groups(fps, radius), "fp")
    low = by_fp.groupBy("grp").agg(F.min("low").alias("component_id"))
    ids = by_fp.select("fp", "grp").join(low, "grp").select("fp", "component_id")
    return fps.join(ids, "fp").select(key, "fp", "component_id")


# Similar sets ------------------------------------------------------------------------------------------------------------


def sid_of(found: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(found.tobytes(), SEED)


def coded(batches):
    """(key columns..., text) to (key columns..., sid: hash of the set, n: its size, c0, c1, ...: the words of its fingerprint; null
    for a set that the task has met before)."""
    met = set()
    for batch in batches:
        n, sids, sizes, codes = batch.num_columns - 1, [], [], []
        for t in batch.column(n):
            s = set_of(t.as_py())
            sids.append(sid := sid_of(s))
            sizes.append(len(s) if sid not in met else None)
            codes.append([majority(again(s, k)) if sid not in met else 0 for k in range(SET_WORDS)])
            met.add(sid)
        known = np.array([x is None for x in sizes], bool)
        words = np.array(codes, np.uint64).reshape(-1, SET_WORDS).view(np.int64)
        new = [pa.array(np.array(sids, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), *(pa.array(words[:, k].copy(), mask=known) for k in range(SET_WORDS))]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n)), *new], [*batch.schema.names[:-1], "sid", "n", *(f"c{k}" for k in range(SET_WORDS))])


def near(a: list[np.ndarray], b: list[np.ndarray], na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Which fingerprints (lists of their words) are within the radii, of sets whose sizes allow the similarity."""
    hit = np.zeros((len(a[0]), len(b[0])), bool)
    step = max(1, (1 << 17) // max(1, len(b[0])))
    x, count = np.empty((step, len(b[0])), np.uint64), np.empty((step, len(b[0])), np.uint8)
    for at in range(0, len(a[0]), step):
        k = min(step, len(a[0]) - at)
        np.bitwise_xor(a[0][at : at + k, None], b[0][None, :], out=x[:k])
        np.bitwise_count(x[:k], out=count[:k])
        i, j = np.divmod(np.flatnonzero(count[:k].reshape(-1) <= SET_RADII[0]), len(b[0]))
        d = count[i, j].astype(np.int32)
        i += at
        for w in range(1, SET_WORDS):
            d += np.bitwise_count(a[w][i] ^ b[w][j])
            ok = d <= SET_RADII[min(w, 2)]
            i, j, d = i[ok], j[ok], d[ok]
        ok = np.minimum(na[i], nb[j]) * 100 >= np.maximum(na[i], nb[j]) * PERCENT
        hit[i[ok], j[ok]] = True
    return hit


def compared_wide(batches):
    """Block pairs (sid, n, words; the same of another block, null for pairs inside the block) to links (a, b)."""
    half = 2 + SET_WORDS

    def side(row):
        sid, n, *codes = (x.values.to_numpy(zero_copy_only=False) for x in row)
        return sid, n.astype(np.int64), [c.view(np.uint64) for c in codes]

    for batch in batches:
        ends, tops = [], []
        for k in range(batch.num_rows):
            row = [batch.column(c)[k] for c in range(2 * half)]
            own = not row[half].is_valid
            a = side(row[:half])
            b = a if own else side(row[half:])
            hit = near(a[2], b[2], a[1], b[1])
            if own:
                np.fill_diagonal(hit, False)
            if hit.any():
                e, t = common.stars(hit, a[0], b[0])
                ends.append(e)
                tops.append(t)
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ends)), pa.array(np.concatenate(tops))], ["a", "b"])


def set_tile(n: Column) -> Column:
    return F.when(n > 0, F.floor(F.log(n.cast("double")) * (SET_STEPS / math.log(100 / PERCENT)) + 1e-9)).otherwise(-1).cast("int")


def candidate_links(sets: DataFrame, block: int = SET_BLOCK) -> DataFrame:
    """sets: a saved table of distinct sid, n, c0, c1, ... Links (a, b) that connect the sids whose fingerprints are near."""
    words = [f"c{k}" for k in range(SET_WORDS)]
    rows = sets.where("n > 0").withColumn("tile", set_tile(F.col("n")))
    tiles = common.saved(rows.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")), "tiles")  # some 200 rows
    blocks = common.saved(
        rows.join(F.broadcast(tiles), "tile").withColumn("block", F.pmod(F.xxhash64("sid"), "blocks").cast("int"))
        .groupBy("tile", "block").agg(F.collect_list(F.struct("sid", "n", *words)).alias("r"))
        .select("tile", "block", *(F.col(f"r.{c}").alias(c) for c in ("sid", "n", *words))),
        "blocks",
    )
    other = F.broadcast(tiles.select(F.col("tile").alias("tile2"), F.col("blocks").alias("blocks2")))
    pairs = (
        tiles.withColumn("tile2", F.explode(F.sequence(F.col("tile"), F.col("tile") + SET_STEPS))).join(other, "tile2")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("block2", F.explode(F.sequence(F.when(F.col("tile") == F.col("tile2"), F.col("block")).otherwise(F.lit(0)), F.col("blocks2") - 1)))
        .withColumn("own", (F.col("tile") == F.col("tile2")) & (F.col("block") == F.col("block2")))
        .select("tile", "block", F.when(~F.col("own"), F.col("tile2")).alias("tile2"), F.when(~F.col("own"), F.col("block2")).alias("block2"))
    )
    names = ["sid", "n", *words]
    right = blocks.select(F.col("tile").alias("tile2"), F.col("block").alias("block2"), *(F.col(c).alias(f"{c}_") for c in names))
    joined = pairs.join(blocks, ["tile", "block"]).join(right, ["tile2", "block2"], "left").select(*names, *(f"{c}_" for c in names))
    return joined.mapInArrow(common.on_workers(__name__, "compared_wide"), "a long, b long")


def chosen(batches, bits: np.ndarray):
    """(mark, text) to (mark, sid, shingles) of the rows whose mark is in the bit set, and perhaps a few others."""
    for batch in batches:
        rows = np.flatnonzero(common.in_bits(batch.column(0).to_numpy(), bits))
        sets = [set_of(batch.column(1)[k].as_py()) for k in rows.tolist()]
        ends = np.cumsum([0, *map(len, sets)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)))
        sids = pa.array(np.array([sid_of(s) for s in sets], np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), sids, lists], ["mark", "sid", "shingles"])


def similar(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which sets on the left and on the right are similar, exactly: shared shingles are counted by products of matrices."""
    sets = [*left, *right]
    sizes = np.array([len(s) for s in sets])
    names, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = np.cumsum(keep := np.bincount(at, minlength=len(names)) > 1) - 1
    row, at, width = row[keep[at]], shared[at[keep[at]]], int(keep.sum())
    both, step = np.zeros((len(left), len(right))), max(1, CELLS // len(sets))
    for low in range(0, width, step):
        here = (at >= low) & (at < low + step)
        cells = np.zeros((len(sets), min(step, width - low)), np.float32)
        cells[row[here], at[here] - low] = 1
        both += cells[: len(left)] @ cells[len(left) :].T
    return both * 100 >= PERCENT * (sizes[: len(left), None] + sizes[None, len(left) :] - both)


def compared_whole(batches):
    """Block pairs (a: list of sids, sa: their sets; b and sb of another block, null for pairs inside the block) to links (a, b)."""

    def side(row):
        sids = row[0].values.to_numpy(zero_copy_only=False)
        return sids, [s.values.to_numpy(zero_copy_only=False) for s in row[1].values]

    for batch in batches:
        ends, tops = [], []
        for k in range(batch.num_rows):
            row = [batch.column(c)[k] for c in range(4)]
            own = not row[2].is_valid
            a, sa = side(row[:2])
            if own and len(a) < 2:
                continue
            b, sb = (a, sa) if own else side(row[2:])
            hit = similar(sa, sb)
            if own:
                np.fill_diagonal(hit, False)
            if hit.any():
                e, t = common.stars(hit, a, b)
                ends.append(e)
                tops.append(t)
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ends)), pa.array(np.concatenate(tops))], ["a", "b"])


def similar_links(texts: DataFrame, sets: DataFrame, near: DataFrame, block: int = WHOLE_BLOCK) -> DataFrame:
    """texts: mark, t. sets: sid, n, mark (of one text). near: node, component of the candidates. Links (a, b) that connect exactly
    the candidates that are connected by pairs of similar sets. A group is one block, or, above `block` shingles, blocks by the
    size of its sets and by hash."""
    near = common.saved(near.select(F.col("node").alias("sid"), F.col("component").alias("grp")).join(sets.select("sid", "n", "mark"), "sid"), "near")
    bits = common.bit_set(near.select("mark"))
    whole = texts.select("mark", "t").mapInArrow(common.on_workers(__name__, "chosen", bits=bits), "mark long, sid long, shingles array<long>")
    large = near.groupBy("grp").agg((F.sum("n") > block).alias("large"))
    near = near.join(large, "grp").withColumn("size", F.when(F.col("large"), F.floor(set_tile(F.col("n")) / SET_STEPS).cast("int")).otherwise(0))
    parts = common.saved(near.groupBy("grp", "size").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"), F.count(F.lit(1)).alias("members")), "parts")
    near = near.join(parts, ["grp", "size"]).select("sid", "mark", "grp", "size", F.when(F.col("large"), F.pmod(F.xxhash64("sid"), "blocks")).otherwise(0).cast("int").alias("block"))
    rows = whole.join(near, ["sid", "mark"]).dropDuplicates(["sid"])
    blocks = common.saved(
        rows.groupBy("grp", "size", "block").agg(F.collect_list(F.struct("sid", "shingles")).alias("s")).select("grp", "size", "block", F.col("s.sid").alias("a"), F.col("s.shingles").alias("sa")),
        "sets",
    )
    none = "cast(null as array<bigint>) b", "cast(null as array<array<bigint>>) sb"
    inside = blocks.selectExpr("a", "sa", *none)
    other = parts.select("grp", F.col("size").alias("size2"), F.col("blocks").alias("blocks2"))
    numbers = lambda low, n: F.explode(F.sequence(low, n - 1))
    across = (
        parts.withColumn("size2", F.explode(F.array(F.col("size"), F.col("size") + 1))).join(other, ["grp", "size2"])
        .where((F.col("size") != F.col("size2")) | (F.col("blocks") > 1))
        .withColumn("block", numbers(F.lit(0), F.col("blocks")))
        .withColumn("block2", F.explode(F.when(F.col("size") != F.col("size2"), F.sequence(F.lit(0), F.col("blocks2") - 1)).when(F.col("block") + 1 < F.col("blocks2"), F.sequence(F.col("block") + 1, F.col("blocks2") - 1))))
        .select("grp", "size", "block", "size2", "block2")
    )
    right = blocks.select("grp", F.col("size").alias("size2"), F.col("block").alias("block2"), F.col("a").alias("b"), F.col("sa").alias("sb"))
    across = across.join(blocks, ["grp", "size", "block"]).join(right, ["grp", "size2", "block2"]).select("a", "sa", "b", "sb")
    return inside.unionAll(across).mapInArrow(common.on_workers(__name__, "compared_whole"), "a long, b long")


def similar_groups(coded: DataFrame, texts: DataFrame, block: int = SET_BLOCK, whole_block: int = WHOLE_BLOCK) -> DataFrame:
    """coded: a saved table (mark, sid, n, c0, ...; n null where a task met the set before). texts: mark, t. (sid, grp) of the sids
    that are similar to others, grp being the smallest sid connected to them."""
    words = [f"c{k}" for k in range(SET_WORDS)]
    one = F.min(F.when(F.col("n").isNotNull(), F.struct("mark", "n", *words))).alias("one")
    sets = common.saved(coded.groupBy("sid").agg(one).select("sid", "one.*"), "sets")
    near = common.components(candidate_links(sets, block))
    found = common.components(similar_links(texts, sets, near, whole_block))
    return found.select(F.col("node").alias("sid"), F.col("component").alias("grp"))


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", block: int = SET_BLOCK, whole_block: int = WHOLE_BLOCK) -> DataFrame:
    """docs with one row of each group of near-duplicates (5-word shingles, Jaccard similarity of 0.8 or more, and what is connected
    by such pairs): the smallest key (nulls last), of equal ones the smallest hash of key and text.

    All columns stay, whatever their names; rows equal in key and text count as one. Null and empty texts are copies of each
    other. An empty table gives no rows."""
    one, two, three = common.fresh(docs.columns, "_mark", "_mark2", "_key")
    with common.temporary():
        marks = F.xxhash64(F.col(key), F.col(text)).alias("mark"), F.hash(F.col(key), F.col(text)).alias("mark2")
        texts = docs.select(F.col(key).alias("k"), *marks, F.col(text).alias("t"))
        kind = docs.select(key).schema[0].dataType.simpleString()
        ids = f"k {kind}, mark long, mark2 int, sid long, n int, " + ", ".join(f"c{k} long" for k in range(SET_WORDS))
        ids = common.saved(texts.mapInArrow(common.on_workers(__name__, "coded"), ids), "coded")
        grp = similar_groups(ids.drop("k", "mark2"), texts, block, whole_block)
        first = F.min(F.struct(F.col("k").isNull().alias("none"), "k", "mark", "mark2")).alias("first")
        by_set = ids.groupBy("sid").agg(first).join(grp, "sid", "left").withColumn("grp", F.coalesce("grp", "sid"))
        stay = by_set.groupBy("grp").agg(F.min("first").alias("first")).select(F.col("first.mark").alias(one), F.col("first.mark2").alias(two), F.col("first.k").alias(three))
        stay = common.kept(common.saved(stay, "stay"))
    whole = docs.select("*", *(m.alias(n) for m, n in zip(marks, (one, two))))
    same = (whole[one] == stay[one]) & (whole[two] == stay[two]) & whole[key].eqNullSafe(stay[three])
    out = whole.join(stay, same, "left_semi").dropDuplicates([one, two, key])
    return out.select(*(f"`{c}`" for c in docs.columns))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fingerprints and components."""
    out = near_duplicates(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
