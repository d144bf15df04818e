"""Exact quantiles of many columns at once in bounded memory.

Spark's percentile keeps every distinct value of a group in one buffer, which a large table breaks. Here each target keeps a
bracket of values and the rank it looks for inside. A pass counts values by BUCKETS equal slices of the bracket, with each
slice's own least and greatest value, combined before the shuffle; the slice that holds the rank is the next bracket. Once all
brackets hold few values they are collected and read off. Two or three passes settle any table in practice. All passes must see
the same values: where they don't (sums that are computed anew in another order), the search fails.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096
#: Values in a bracket that are collected for a target.
FEW = 4096
#: A bracket shrinks by BUCKETS in each pass, until its ends are neighbouring numbers.
MOST_PASSES = 100


def exact_quantiles(df: DataFrame, columns: Mapping[str, Column], q: float | tuple[float, ...] = 0.5) -> dict:
    """The quantiles of each column's non-null values, interpolated between neighbours; None where there are none. With one q a
    number for each name, with several a tuple."""
    names = list(columns)
    if not names:
        return {}
    cells = df.select(F.inline(F.array(*(F.struct(F.lit(k).alias("k"), columns[n].cast("double").alias("v")) for k, n in enumerate(names)))))
    found = quantiles_of(cells, q)
    return {n: found.get(k, None if isinstance(q, float) else (None,) * len(q)) for k, n in enumerate(names)}


def quantiles_of(cells: DataFrame, q: float | tuple[float, ...] = 0.5) -> dict:
    """The same of a table in long form: k (int), v (double); by k, without those that have no value."""
    wanted = (q,) if isinstance(q, float) else tuple(q)
    sizes: dict[int, int] = {}

    def ends(k: int, n: int) -> set[int]:
        sizes[k] = n
        return {r for p in wanted for r in (int(p * (n - 1)), min(int(p * (n - 1)) + 1, n - 1))}

    ranks = values_at(cells, ends)
    out = {}
    for k, n in sizes.items():
        got = []
        for p in wanted:
            at = p * (n - 1)
            a, b = ranks[(k, int(at))], ranks[(k, min(int(at) + 1, n - 1))]
            got.append(a + (b - a) * (at - int(at)))
        out[k] = got[0] if isinstance(q, float) else tuple(got)
    return out


def values_at(cells: DataFrame, ranks: Callable[[int, int], Iterable[int]]) -> dict[tuple[int, int], float]:
    """cells: k (int), v (double). The rank-th smallest values (from 0) of each k, by (k, rank); ranks gives those that are wanted of
    a k with so many values."""
    cells = cells.where("v is not null and not isnan(v)")
    span = {r["k"]: (r["n"], r["lo"], r["hi"]) for r in cells.groupBy("k").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    found: dict[tuple[int, int], float] = {}
    # a target (k, rank); bracket: low, high, values below it, values in it
    open_ = {(k, rank): (lo, hi, 0, n) for k, (n, lo, hi) in span.items() for rank in ranks(k, n)}
    for _ in range(MOST_PASSES):
        for target, (lo, hi, _, _) in list(open_.items()):
            if lo == hi:
                found[target] = lo
                del open_[target]
        brackets = sorted({(k, lo, hi, below, n) for (k, _), (lo, hi, below, n) in open_.items()})
        if not brackets:
            break
        table = F.broadcast(cells.sparkSession.createDataFrame([(i, k, lo, hi) for i, (k, lo, hi, *_) in enumerate(brackets)], "b int, bk int, lo double, hi double"))
        inside = cells.join(table, (F.col("k") == F.col("bk")) & F.col("v").between(F.col("lo"), F.col("hi")))
        few = [i for i, b in enumerate(brackets) if b[4] <= FEW]
        many = [i for i, b in enumerate(brackets) if b[4] > FEW]
        values: dict[int, list[float]] = {i: [] for i in few}
        if few:
            for r in inside.where(F.col("b").isin(few)).groupBy("b", "v").count().collect():  # <= FEW values a bracket
                values[r["b"]] += [r["v"]] * r["count"]
        slices: dict[int, list[tuple]] = {i: [] for i in many}
        if many:
            width = (F.col("v") / BUCKETS - F.col("lo") / BUCKETS) / (F.col("hi") / BUCKETS - F.col("lo") / BUCKETS)
            cut = F.least(F.floor(width * BUCKETS), F.lit(BUCKETS - 1))
            for r in inside.where(F.col("b").isin(many)).groupBy("b", cut.alias("s")).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
                slices[r["b"]].append((r["s"], r["n"], r["lo"], r["hi"]))
        number = {b[:3]: i for i, b in enumerate(brackets)}
        for (k, rank), (lo, hi, below, _) in list(open_.items()):
            i = number[(k, lo, hi)]
            if i in values:
                if rank - below >= len(values[i]):
                    raise RuntimeError("the values changed between two passes")
                found[(k, rank)] = sorted(values[i])[rank - below]
                del open_[(k, rank)]
                continue
            for _, n, low, high in sorted(slices[i]):
                if rank < below + n:
                    open_[(k, rank)] = (low, high, below, n)
                    break
                below += n
            else:
                raise RuntimeError("the values changed between two passes")
    if open_:
        raise RuntimeError("quantiles did not settle")
    return found
