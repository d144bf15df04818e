"""Bands fitted to residuals: the tolerance is read off where the sorted violations have their widest gap."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.measures import SLACK, violation
from ..saved import saved, temporary

BUCKETS = 4096
#: Slices of slices: 4096^5 of them are finer than the numbers.
MOST_ROUNDS = 5


@dataclass(frozen=True)
class Band:
    eps: float = 0.0
    cov_cal: float = 0.0
    cov_eval: float = 0.0
    n_eval: int = 0
    k_eval: int = 0


# On arrays: for residuals in memory ---------------------------------------------------------------------------------------


def violations(op: str, rho: np.ndarray, scale: np.ndarray) -> np.ndarray:
    r = np.asarray(rho, float) / np.asarray(scale, float)
    return np.maximum(r, 0) if op == "<=" else np.maximum(-r, 0) if op == ">=" else np.abs(r)


def knee(v: np.ndarray) -> tuple[int, float]:
    """(values up to the widest gap, the last of them) of sorted values; all of them without a gap. The first widest gap counts."""
    if len(v) < 2:
        return len(v), float(v[-1]) if len(v) else 0.0
    gaps = np.diff(v)
    n = int(gaps.argmax()) + 1 if gaps.max() > 0 else len(v)
    return n, float(v[n - 1])


def knee_coverage(v: np.ndarray) -> float:
    return knee(np.sort(v))[0] / len(v) if len(v) else 0.0


def fit(op: str, rho: np.ndarray, scale: np.ndarray, holdout: float, seed: int) -> tuple[Band, float]:
    """The band at the knee of a seeded calibration share, with its coverage there and on the rest; and the knee's share."""
    v = violations(op, rho, scale)
    if not len(v):
        return Band(), 0.0
    order = np.random.default_rng(seed).permutation(len(v))
    n = max(1, round((1 - holdout) * len(v)))
    cal, rest = v[order[:n]], v[order[n:]]
    core, eps = knee(np.sort(cal))
    inside = int((rest <= eps + SLACK).sum())
    at_home = float((cal <= eps + SLACK).mean())
    return Band(eps, at_home, inside / len(rest) if len(rest) else at_home, len(rest), inside), core / n


# On tables ----------------------------------------------------------------------------------------------------------------


def knee_of(values: DataFrame, column: str = "v", buckets: int = BUCKETS) -> DataFrame:
    """One row (n, core, eps, coverage) for the finite values of a column.

    No sort of more than `buckets` rows: values are counted by equal slices of their range, with each slice's ends. A gap is widest
    either between slices, where these ends show it, or inside one; a gap inside can't exceed the slice's span, so only slices whose
    span reaches the best gap so far are sliced again. Some gap is as wide as the range over the number of values, so a few rounds
    settle any table, and a slice that holds nearly all values costs another round, not a task.
    """
    v = values.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v) and abs(v) < double('infinity')")
    span = v.agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    spark, best, at = values.sparkSession, 0.0, span["hi"]
    rows, wide = v.withColumn("id", F.lit(0).cast("long")), spark.createDataFrame([(0, span["lo"], span["hi"])], "id long, lo double, hi double")
    with temporary():
        for _ in range(MOST_ROUNDS if span["n"] and span["lo"] < span["hi"] else 0):
            width = F.col("hi") / buckets - F.col("lo") / buckets
            slice_ = F.least(F.floor(F.try_divide(F.col("v") - F.col("lo"), width)), F.lit(buckets - 1))
            rows = rows.join(wide, "id").select("v", "id", slice_.cast("long").alias("slice"))
            slices = saved(rows.groupBy("id", "slice").agg(F.min("v").alias("lo"), F.max("v").alias("hi")), "slices")
            gap = F.lead("lo").over(W.partitionBy("id").orderBy("slice")) - F.col("hi")  # at most `buckets` rows an id
            top = slices.withColumn("gap", gap).where("gap > 0").agg(F.max(F.struct("gap", (-F.col("hi")).alias("at"))).alias("c")).first()["c"]
            if top is not None and (top["gap"], top["at"]) > (best, -at):
                best, at = top["gap"], -top["at"]
            inside = (F.col("hi") > F.col("lo")) & (F.col("hi") - F.col("lo") >= best)
            wide = saved(slices.where(inside).select((F.col("id") * buckets + F.col("slice")).alias("id"), "lo", "hi"), "wide")
            if wide.isEmpty():
                break
            rows = rows.select("v", (F.col("id") * buckets + F.col("slice")).alias("id"))
    core = v.where(F.col("v") <= F.lit(at)).count() if span["n"] else 0
    coverage = core / span["n"] if span["n"] else 0.0
    return spark.createDataFrame([(span["n"], core, at, coverage)], "n long, core long, eps double, coverage double")


def fit_on(points: DataFrame, op: str, rho: Column, scale: Column, calibrate: Column) -> DataFrame:
    """One row (eps, cov_cal, cov_eval, n_eval, k_eval, coverage): the knee of the points that `calibrate` marks, its coverage on
    them and on the others."""
    rows = points.select(violation(op, rho, scale).alias("v"), calibrate.alias("cal"))
    edge = knee_of(rows.where("cal")).first()
    inside = F.col("v") <= F.col("eps") + SLACK
    return (
        rows.withColumns({"eps": F.lit(edge["eps"]).cast("double"), "coverage": F.lit(edge["coverage"])})
        .groupBy("eps", "coverage")
        .agg(
            F.count_if("cal").alias("n_cal"), F.count_if(F.col("cal") & inside).alias("k_cal"),
            F.count_if(~F.col("cal")).alias("n_eval"), F.count_if(~F.col("cal") & inside).alias("k_eval"),
        )
        .select(
            "eps", (F.col("k_cal") / F.col("n_cal")).alias("cov_cal"),
            F.coalesce(F.try_divide(F.col("k_eval").cast("double"), F.col("n_eval")), F.col("k_cal") / F.col("n_cal")).alias("cov_eval"),
            "n_eval", "k_eval", "coverage",
        )
    )
