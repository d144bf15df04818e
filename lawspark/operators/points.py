"""From snapshots to points: one row for each (snapshot, binding of a binder), with the values of the leaves that rules use.

Two routes give the same points. The wide route is one narrow transformation: an array of structs, one for each binding, is
inlined; nothing is shuffled. The long route unpivots the table to (t, column, value), joins a broadcast map of columns to
leaves (metadata, as many rows as the bindings' leaves have columns) and groups by snapshot and binding; it is for tables so
wide that the array's expression gets too large.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import folded
from ..plans.names import Names
from ..plans.rules import Col, Term
from ..sources.frames import TIME, Dataset

BINDING = "binding_id"


def leaf_names(leaves: Sequence[Term]) -> dict[Term, str]:
    return {x: f"leaf_{k}" for k, x in enumerate(leaves)}


def _leaf_value(ds: Dataset, binder: str, leaf: Term, binding) -> Column:
    columns = [ds.column(c) for c in ds.names.leaf(binder, leaf, binding)]
    if not columns:
        return F.lit(None).cast("double")
    return columns[0] if isinstance(leaf, Col) else folded(leaf.kind, columns)


def wide_points(ds: Dataset, binder: str, leaves: Sequence[Term]) -> DataFrame:
    """(t, binding_id, leaf_0, leaf_1, ...); a leaf out of a binding's scope is null."""
    names = leaf_names(leaves)
    rows = [
        F.struct(F.lit(k).alias(BINDING), *(_leaf_value(ds, binder, x, b).alias(n) for x, n in names.items()))
        for k, b in enumerate(ds.names.bindings(binder))
    ]
    if not rows:
        empty = ", ".join(f"cast(null as double) {n}" for n in names.values())
        return ds.frame.limit(0).selectExpr(TIME, f"0 {BINDING}", *([empty] if empty else []))
    return ds.frame.select(TIME, F.inline(F.array(*rows)))


def leaf_map(names: Names, binder: str, leaves: Sequence[Term]) -> list[tuple[int, int, str]]:
    """(binding, leaf, column) of every column that a leaf reads."""
    return [(k, j, c) for k, b in enumerate(names.bindings(binder)) for j, x in enumerate(leaves) for c in names.leaf(binder, x, b)]


def points_of_cells(cells: DataFrame, names: Names, binder: str, leaves: Sequence[Term], fill: float | None = None) -> DataFrame:
    """Points from a table in long form, (t, column, value). A leaf needs a value of each of its columns; without that it is null,
    or, with fill, what its columns give when absent values are fill. Points without any value come up only with fill."""
    spark = cells.sparkSession
    links = leaf_map(names, binder, leaves)
    sizes = Counter((k, j) for k, j, _ in links)
    wanted = spark.createDataFrame([(*link, sizes[link[:2]]) for link in links], f"{BINDING} int, leaf int, column string, size int")
    if fill is not None:
        # what is asked for comes up with each snapshot, as the definition of fill says: an array of columns for each
        columns = F.array(*map(F.lit, sorted({c for *_, c in links})))
        grid = cells.select(TIME).distinct().select(TIME, F.explode(columns).alias("column"))
        cells = grid.join(cells, [TIME, "column"], "left").withColumn("value", F.coalesce("value", F.lit(fill)))
    found = cells.join(wanted, "column")  # metadata: broadcast while it is small
    sums = found.groupBy(TIME, BINDING, "leaf", "size").agg(
        F.sum("value").alias("SUM"), F.min("value").alias("MIN"), F.max("value").alias("MAX"), F.avg("value").alias("AVG"), F.count("value").alias("n")
    )
    sums = sums.where("n = size")
    picks = []
    for j, x in enumerate(leaves):
        kind = "SUM" if isinstance(x, Col) else x.kind
        picks.append(F.max(F.when(F.col("leaf") == j, F.col(kind))).alias(f"leaf_{j}"))
    return sums.groupBy(TIME, BINDING).agg(*picks)


def long_points(ds: Dataset, binder: str, leaves: Sequence[Term]) -> DataFrame:
    """The same points by unpivoting the columns that the leaves read."""
    read = {c for *_, c in leaf_map(ds.names, binder, leaves)}
    if not read:
        return wide_points(ds, binder, leaves)
    renamed = ds.frame.select(TIME, *(ds.column(c).alias(c) for c in sorted(read)))
    return points_of_cells(renamed.unpivot([TIME], [F.col(f"`{c}`") for c in sorted(read)], "column", "value"), ds.names, binder, leaves)
