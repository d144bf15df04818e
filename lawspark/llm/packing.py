"""Best-fit packing by minimum bin slack.

Documents are tokenised and cut into pieces of at most CAPACITY tokens. What bins can hold depends on lengths alone, and there
are at most CAPACITY different ones: the plan is made from the histogram of lengths. Each bin starts with the longest piece
left; a bitset subset-sum over the available lengths finds the fullest feasible filling, and is removed as often as the
histogram allows at once, so the plan has a few thousand patterns whatever the data. Pieces then take the places of
their length in the order of their rank.

Scale: the driver sees only the histogram (at most CAPACITY rows) and its plan is broadcast with a bound that depends on
CAPACITY alone. Ranks within a length are prefix sums over hash buckets, so a length that a third of all pieces share is
ranked by many tasks: n pieces in about sqrt(n) buckets of sqrt(n); pieces that are equal throughout are one with a count there. A piece finds its place by a hash join on its
length and the cell of its rank, of which each holds a few of the plan's rows.
"""

from __future__ import annotations

import json
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

CAPACITY = 1024
END = 2
VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
#: Cells of the ranks of a length.
CELLS = 64
#: Texts longer than this are tokenised in parts, cut where two letters have a space between them.
PART = 1 << 18

# The characters for which the two tokenising libraries were held against each other; others take the slower one.
USUAL = "[^\\x00-\\x1b\\x20-\\u024f\\u2010-\\u2027\\u20ac]"
# End of fixed values.

_coders: dict[tuple, "Coder"] = {}


class Coder:
    """Token ids as the `tokenizers` library gives them for the vocabulary, without special tokens added. tiktoken, several
    times as fast, reads the same merges as ranks and takes the texts for which the two agree: usual characters, and no
    stretch without a word boundary that is long enough to slow it down."""

    def __init__(self, vocabulary: str, ranks: str | None, pattern: str | None):
        self.vocabulary, self._slow, self.fast = vocabulary, None, None
        with open(vocabulary, encoding="utf-8") as f:
            self.special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self.cut = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.unusual = re.compile(f"{USUAL}|\\S{{1500}}|\\s{{1500}}")
        self.seam = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})

    @property
    def slow(self):
        """The library's own tokenizer, loaded when a text first needs it."""
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.vocabulary)
        return self._slow

    def part(self, text: str) -> list[int]:
        if self.fast is None or self.unusual.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        out, at = [], 0
        for m in self.cut.finditer(text) if self.cut else ():
            out += [*self.fast.encode_ordinary(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return out + self.fast.encode_ordinary(text[at:])

    def ids(self, text: str, size: int = PART) -> np.ndarray:
        out, at = [], 0
        while len(text) - at > size:
            m = self.seam.search(text, at + size)
            if not m:
                break
            out.append(np.array(self.part(text[at : m.start()]), np.uint32))
            at = m.start()
        out.append(np.array(self.part(text[at:]), np.uint32))
        return np.concatenate(out)


def coder(vocabulary: str, ranks: str | None, pattern: str | None) -> Coder:
    key = (vocabulary, ranks, pattern)
    if key not in _coders:
        _coders[key] = Coder(*key)
    return _coders[key]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all full but the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))] if n else []


def pieced(batches, vocabulary: str, ranks: str | None, pattern: str | None, capacity: int, end: int | None):
    """Arrow batches of (key, text) to pieces (key, piece, start, length, ids_crc32)."""
    c = coder(vocabulary, ranks, pattern)
    for batch in batches:
        keys, rows = [], []
        for k, t in enumerate(batch.column(1)):
            ids = c.ids(t.as_py() or "")
            if end is not None:
                ids = np.append(ids, np.uint32(end))
            for p, (start, n) in enumerate(cuts(len(ids), capacity)):
                keys.append(k)
                rows.append((p, start, n, zlib.crc32(ids[start : start + n].astype("<u4").tobytes())))
        table = np.array(rows, np.int64).reshape(-1, 4)
        cols = [pa.array(table[:, 0].astype(np.int32)), *(pa.array(np.ascontiguousarray(table[:, j])) for j in (1, 2, 3))]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), *cols], ["key", "piece", "start", "length", "ids_crc32"])


def fullest(counts: dict[int, int], gap: int) -> dict[int, int]:
    """The lengths, with how many of each, whose sum is the largest that fits in gap; longer ones are preferred."""
    reach, steps, all_bits = 1, [], (1 << (gap + 1)) - 1
    for n in sorted((n for n in counts if n <= gap), reverse=True):
        left, k = min(counts[n], gap // n), 1
        while left:
            k = min(k, left)
            steps.append((n, k, reach))
            reach |= (reach << (n * k)) & all_bits
            left -= k
            k *= 2
        if reach >> gap & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            at -= n * k
            out[n] = out.get(n, 0) + k
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(how often, lengths with how many of each) of every pattern; together they use up the histogram."""
    left, out = {n: c for n, c in histogram.items() if c}, []
    while left:
        top = max(left)
        left[top] -= 1
        items = fullest({n: c for n, c in left.items() if c}, capacity - top)
        left[top] += 1
        items[top] = items.get(top, 0) + 1
        times = min(left[n] // k for n, k in items.items())
        out.append((times, items))
        for n, k in items.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return out


def placed(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("key", "piece", "start", "ids_crc32")) -> DataFrame:
    """pieces (a saved table with a column length, all others in order) plus sequence_id and offset."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # <= capacity rows
    by, first, taken = {}, 0, {}
    for times, items in plan(histogram, capacity):
        at = 0
        for n in sorted(items, reverse=True):
            k, rank = items[n], taken.get(n, 0)
            by.setdefault(n, []).append((rank, rank + k * times, k, first, at))
            taken[n] = rank + k * times
            at += k * n
        first += times
    step = {n: -(-histogram[n] // min(CELLS, len(rows))) for n, rows in by.items()}
    slots = [(n, c, *r) for n, rows in by.items() for r in rows for c in range(r[0] // step[n], (r[1] - 1) // step[n] + 1)]
    slots = spark.createDataFrame(slots, "_length long, _cell long, _from long, _to long, _each long, _first long, _at long")  # plan's rows + capacity * CELLS at most
    sizes = spark.createDataFrame([(n, math.isqrt(histogram[n]), step[n]) for n in by], "length long, _buckets long, _step long")
    pieces = pieces.groupBy("length", *order).agg(F.count(F.lit(1)).alias("_copies")).join(F.broadcast(sizes), "length")
    pieces = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), "_buckets"))
    counts = common.saved(pieces.groupBy("length", "_bucket").agg(F.sum("_copies").alias("n")), "lengths")
    base = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("length", "_bucket", base.alias("_base"))
    before = F.sum("_copies").over(W.partitionBy("length", "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_copies")
    ranked = pieces.withColumn("_before", before).join(base, ["length", "_bucket"]).withColumn("_low", F.col("_before") + F.col("_base"))
    ranked = ranked.withColumn("_rank", F.explode(F.sequence("_low", F.col("_low") + F.col("_copies") - 1)))
    place = (F.col("length") == F.col("_length")) & (F.expr("_rank div _step") == F.col("_cell")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    return ranked.join(F.broadcast(slots), place).select(
        *order, "length", F.expr("_first + (_rank - _from) div _each").alias("sequence_id"), F.expr("_at + (_rank - _from) % _each * length").alias("offset")
    )


def pack(docs: DataFrame, key: str, text: str, vocabulary: str, ranks: str | None = None, pattern: str | None = None, capacity: int = CAPACITY, end: int | None = END) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty and gives one piece with the end id alone (none where end is None). Null keys and repeated
    rows are documents like any other. An empty table gives no rows. Other columns of docs are ignored.
    """
    pieces = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        common.on_workers(__name__, "pieced", vocabulary=vocabulary, ranks=ranks, pattern=pattern, capacity=capacity, end=end),
        f"key {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long",
    )
    return placed(common.saved(pieces, "pieces"), capacity).withColumnRenamed("key", key)


def packed_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers as tokenizers

    out = pack(docs, "doc_id", "text", tokenizers.path(VOCABULARY), tokenizers.path(RANKS), tokenizers.PATTERN)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return packed_documents(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
