"""Running hold counts of fixed laws over a stream of snapshots.

Discovery is a batch matter: its median floors need the whole population. What a stream can keep exactly are sums: how many points
of a law were seen and how many held, for scales above a floor given beforehand (a batch run knows it). The state is a row for
each law, whatever the stream's length; snapshots may come in any order, so no watermark is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Evaluation
from ..functions import measures
from ..operators.holds import pair_columns, Pair, scale_of
from ..operators.points import leaf_names, wide_points
from ..plans.names import leaves_of
from ..plans.rules import Rule
from ..sources.frames import Dataset


def running_holds(data: Dataset, rules: Sequence[Rule], cfg: Evaluation = Evaluation(), floor: float = 0.0) -> DataFrame:
    """(law, n, k, lo, hi) of equalities and bounds of one binder, over a streaming (or batch) dataset; for output mode `complete`
    or `update`."""
    binders = {r.binder for r in rules}
    if len(binders) != 1 or any(r.op in ("!=", "<|>") for r in rules):
        raise ValueError("one binder, and equalities or bounds")
    leaves = leaves_of(rules)
    names = leaf_names(leaves)
    sides = pair_columns([Pair(r.left, r.right) for r in rules], names)
    cells = []
    for rule, (a, b) in zip(rules, sides):
        rho, scale = a - b, F.greatest(scale_of(a, b), F.lit(floor))
        good = measures.violation(rule.op, rho, scale) <= cfg.tolerance + measures.SLACK
        cells.append(F.struct(F.lit(rule.law).alias("law"), F.when(measures.finite(rho) & measures.finite(scale), good).alias("good")))
    points = wide_points(data, binders.pop(), leaves).select(F.inline(F.array(*cells))).where("good is not null")
    sums = points.groupBy("law").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("k"))
    low, high = measures.wilson_columns(F.col("k"), F.col("n"), measures.z_for_alpha(cfg.ci_alpha))
    return sums.select("law", "n", "k", low.alias("lo"), high.alias("hi"))
