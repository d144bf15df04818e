"""Exploring snapshot tables: audits, distributions, matrices, and the fixed invariants of network telemetry.

Everything works on the cells of a table in long form, one row for each snapshot and column, made by one narrow
transformation; what follows are grouped sums that Spark combines before the shuffle. Quantiles are exact, in bounded memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.names import Names
from ..plans.spec import Schema
from ..sources.frames import decoded
from .quantiles import exact_quantiles

LOW, HIGH = "low", "high"

#: The order in which invariants are listed.
ORDER = ["I1", "I2", "I3", "I4", "I5", "I6", "I7", "I8", "I9", "I10"]
# End of fixed values.


def column_groups(columns: list[str], schema: Schema) -> dict[str, list[str]]:
    """Columns of the measured layer, of the other layers, and the rest."""
    names = Names.of(schema, columns)
    return {LOW: names.low, HIGH: names.high, "meta": [c for c in columns if c not in names.by_name]}


def field(cell: Column, kind: T.DataType, name: str) -> Column:
    """A field of a cell as a number; null for cells without it and for what isn't a number."""
    if isinstance(kind, T.StructType):
        return cell.getField(name).try_cast("double") if name in kind.names else F.lit(None).cast("double")
    if isinstance(kind, T.MapType):
        return F.try_element_at(cell, F.lit(name)).try_cast("double")
    return F.lit(None).cast("double")


def cells(df: DataFrame, schema: Schema, timestamp: str) -> DataFrame:
    """(t, name, layer, direction, source, destination, peer, observed, clean): clean is the hidden field of record cells, and
    null elsewhere. NaN is null."""
    names, kinds, codec = Names.of(schema, df.columns), {f.name: f.dataType for f in df.schema}, schema.spec.cell_codec
    low = set(names.low)
    rows = []
    for c, s in names.by_name.items():
        cell, text = F.col(f"`{c}`"), lambda x: F.lit(x).cast("string")
        clean = field(cell, kinds[c], codec.clean)
        rows.append(F.struct(
            text(c).alias("name"), text(LOW if c in low else HIGH).alias("layer"), text(s.direction).alias("direction"),
            text(s.source).alias("source"), text(s.destination).alias("destination"), text(s.peer).alias("peer"),
            decoded(cell, kinds[c], codec).alias("observed"), F.when(~F.isnan(clean), clean).alias("clean"),
        ))
    return df.select(F.col(f"`{timestamp}`").alias("t"), F.inline(F.array(*rows)))


def truth(layer: str = "layer") -> Column:
    """The clean value where there is one, else the observed one."""
    return F.coalesce("clean", "observed")


# Audits and distributions ------------------------------------------------------------------------------------------------


def group_counts(columns: list[str], schema: Schema) -> dict[str, int]:
    groups = column_groups(columns, schema)
    return {**{k: len(v) for k, v in groups.items()}, "total": len(columns)}


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_unique): distinct non-null values of each column."""
    rows = F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns)))
    return df.select(rows).groupBy("column").agg(F.count_distinct("v").alias("n_unique"))


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970, whole. Times without a zone count as they stand, whatever the session's zone."""
    t = F.col(column)
    if isinstance(df.select(t).schema[0].dataType, T.TimestampNTZType):
        since = (t - F.lit("1970-01-01").cast("timestamp_ntz")).cast("interval second")
        return (since.cast("decimal(19,6)") * 1000000).cast("long")
    return F.unix_micros(t.cast("timestamp"))


def cadence(times: DataFrame, column: str, within: list[str] | None = None) -> DataFrame:
    """(first, last, span_s, mode_gap_s, n_gaps) of the gaps between neighbouring times, for each group of `within`, null ones too.
    Gaps are counted as whole microseconds: as seconds, equal ones would differ in their last bits. A group's times are sorted by
    one task, without groups all of them: for tables with a row a snapshot, not a row an event. Of equally frequent gaps the least
    is the mode; a single time has none, and n_gaps is 0."""
    keys = within or []
    order = W.partitionBy(*keys).orderBy("_us")
    gaps = times.withColumn("_us", micros(times, column)).where("_us is not null").withColumn("_gap", F.col("_us") - F.lag("_us").over(order))
    counted = gaps.groupBy(*keys, "_gap").agg(
        F.count(F.lit(1)).alias("_n"), F.min(column).alias("_first"), F.max(column).alias("_last"), F.min("_us").alias("_from"), F.max("_us").alias("_to")
    )
    rank = F.when(F.col("_gap").isNotNull(), F.struct("_n", -F.col("_gap")))
    return counted.groupBy(*keys).agg(
        F.min("_first").alias("first"), F.max("_last").alias("last"), ((F.max("_to") - F.min("_from")) / 1e6).alias("span_s"),
        (F.max_by("_gap", rank) / 1e6).alias("mode_gap_s"), F.count("_gap").alias("n_gaps"),
    )


def missing(cell: DataFrame) -> DataFrame:
    """(layer, n, observed_missing_pct, clean_missing_pct)."""
    def share(c: str) -> Column:
        return F.round(F.avg(F.col(c).isNull().cast("int")) * 100, 3)

    return cell.groupBy("layer").agg(F.count(F.lit(1)).alias("n"), share("observed").alias("observed_missing_pct"), share("clean").alias("clean_missing_pct"))


def describe(cell: DataFrame, value: str = "observed") -> DataFrame:
    """(layer, n, mean, std, min, q25, q50, q75, max) over all cells of a layer."""
    layers = (LOW, HIGH)
    quartiles = exact_quantiles(cell, {x: F.when(F.col("layer") == x, F.col(value)) for x in layers}, (0.25, 0.5, 0.75))
    table = cell.sparkSession.createDataFrame([(x, *quartiles[x]) for x in layers], "layer string, q25 double, q50 double, q75 double")
    sums = cell.groupBy("layer").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    return sums.join(F.broadcast(table), "layer").select("layer", "n", "mean", "std", "min", "q25", "q50", "q75", "max")


def relative_noise() -> Column:
    return F.try_divide(F.col("observed") - F.col("clean"), F.when(F.col("clean") != 0, F.col("clean")))


def noise(cell: DataFrame) -> DataFrame:
    """One row (n, differing_pct, rel_mean, rel_std, rel_p99, band): how observed values of the measured layer depart from the
    clean ones; the band is five times the 99th percentile of the size of relative noise."""
    both = cell.where(f"layer = '{LOW}' and observed is not null and clean is not null").withColumn("rel", relative_noise())
    p99 = exact_quantiles(both, {"p": F.abs(F.col("rel"))}, 0.99)["p"]
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("observed") != F.col("clean")).cast("int")) * 100, 2).alias("differing_pct"),
        F.avg("rel").alias("rel_mean"), F.stddev_pop("rel").alias("rel_std"),
    ).withColumns({"rel_p99": F.lit(p99).cast("double"), "band": F.greatest(F.lit(p99).cast("double") * 5, F.lit(1e-6))})


def histogram(df: DataFrame, value: Column, bins: int, clip: tuple[float, float] | None = None) -> DataFrame:
    """(bin, low, high, n): equal bins over the range of the values, clipped to two quantiles if given."""
    rows = df.select(value.alias("v")).where("v is not null")
    if clip:
        low, high = exact_quantiles(rows, {"v": F.col("v")}, clip)["v"]
    else:
        low, high = rows.agg(F.min("v"), F.max("v")).first()
    if low is None:
        return rows.select(F.lit(0).alias("bin"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"), F.lit(0).cast("long").alias("n")).limit(0)
    width = (high - low) / bins or 1.0
    v = F.least(F.greatest(F.col("v"), F.lit(low)), F.lit(high))
    counted = rows.groupBy(F.least(F.floor((v - low) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("bin", (low + F.col("bin") * width).alias("low"), (low + (F.col("bin") + 1) * width).alias("high"), "n")


def log_values(cell: DataFrame, layer: str) -> DataFrame:
    """log10 of the positive values of a layer."""
    return cell.where((F.col("layer") == layer) & (F.col("observed") > 0)).select(F.log10("observed").alias("v"))


# Totals, matrices, rankings ------------------------------------------------------------------------------------------------


def totals(cell: DataFrame, source_direction: str) -> DataFrame:
    """(t, origination, demand): sums over the source counters and over all demands of a snapshot."""
    return cell.groupBy("t").agg(
        F.sum(F.when((F.col("layer") == LOW) & (F.col("direction") == source_direction), F.col("observed"))).alias("origination"),
        F.sum(F.when(F.col("layer") == HIGH, F.col("observed"))).alias("demand"),
    )


def diurnal(df: DataFrame, time: Column, value: Column) -> DataFrame:
    """(hour, mean, share): the mean by hour of day, and as a share of the mean of the hours' means."""
    by = df.groupBy(F.hour(time).alias("hour")).agg(F.avg(value).alias("mean"))  # 24 rows
    return by.withColumn("share", F.col("mean") / F.avg("mean").over(W.partitionBy()))


def demand_matrix(cell: DataFrame, nodes: list[str], at=None) -> DataFrame:
    """(source, one column a node): the mean demand, or that of one snapshot; zero where there is none."""
    rows = cell.where(F.col("layer") == HIGH)
    rows = rows if at is None else rows.where(F.col("t") == F.lit(at))
    return rows.groupBy("source").pivot("destination", nodes).agg(F.avg("observed")).na.fill(0.0)


def top_demands(cell: DataFrame, k: int) -> DataFrame:
    """The k largest mean demands between different nodes."""
    rows = cell.where((F.col("layer") == HIGH) & (F.col("source") != F.col("destination")))
    return rows.groupBy("source", "destination").agg(F.avg("observed").alias("mean")).orderBy(F.desc("mean"), "source", "destination").limit(k)


def node_means(cell: DataFrame, source_direction: str, destination_direction: str) -> DataFrame:
    """(node, origination, termination): mean counters of each node, zero where there is none."""
    def mean(direction: str) -> Column:
        return F.coalesce(F.avg(F.when(F.col("direction") == direction, F.col("observed"))), F.lit(0.0))

    rows = cell.where((F.col("layer") == LOW) & F.col("peer").isNull())
    return rows.groupBy(F.col("source").alias("node")).agg(mean(source_direction).alias("origination"), mean(destination_direction).alias("termination"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r): Pearson's r of each pair of columns, one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*(F.corr(F.col(f"`{a}`"), F.col(f"`{b}`")).alias(f"r{k}") for k, (a, b) in enumerate(pairs)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)))))


def comparison(cell: DataFrame, name: str) -> DataFrame:
    """One row: nodes, columns of each layer, snapshots, mean and peak of total demand. Union these for several tables."""
    counts = cell.agg(
        F.count_distinct("source").alias("nodes"), F.count_distinct(F.when(F.col("layer") == LOW, F.col("name"))).alias("low_vars"),
        F.count_distinct(F.when(F.col("layer") == HIGH, F.col("name"))).alias("high_vars"), F.count_distinct("t").alias("snapshots"),
    )
    demand = cell.where(F.col("layer") == HIGH).groupBy("t").agg(F.sum("observed").alias("d")).agg(F.avg("d").alias("mean_demand"), F.max("d").alias("peak_demand"))
    return counts.join(demand).withColumn("dataset", F.lit(name))


# Invariants ------------------------------------------------------------------------------------------------------------------


def relative_residual(a: Column, b: Column) -> Column:
    """|a - b| over the mean of their sizes; null where both are zero."""
    size = (F.abs(a) + F.abs(b)) * 0.5
    return F.try_divide(F.abs(a - b), F.when(size != 0, size))


def within(residual: Column, scale: Column, tolerance: Column, floor: float = 1.0) -> Column:
    """Share of points with |residual| <= tolerance * |scale| + floor."""
    return F.avg((F.abs(residual) <= tolerance * F.abs(scale) + floor).cast("int"))


def node_sums(cell: DataFrame, source_direction: str, destination_direction: str, out_direction: str, in_direction: str) -> DataFrame:
    """(t, node, o, e, x, i, row, col): clean origination, termination, sums of outgoing and incoming links, and demand sums."""
    low = cell.where(F.col("layer") == LOW).withColumn("v", truth())

    def total(direction: str) -> Column:
        return F.sum(F.when(F.col("direction") == direction, F.col("v")))

    own = low.groupBy("t", F.col("source").alias("node")).agg(
        total(source_direction).alias("o"), total(destination_direction).alias("e"),
        F.coalesce(total(out_direction), F.lit(0.0)).alias("x"), F.coalesce(total(in_direction), F.lit(0.0)).alias("i"),
    )
    high = cell.where(F.col("layer") == HIGH)
    row = high.groupBy("t", F.col("source").alias("node")).agg(F.coalesce(F.sum("observed"), F.lit(0.0)).alias("row"))
    col = high.groupBy("t", F.col("destination").alias("node")).agg(F.coalesce(F.sum("observed"), F.lit(0.0)).alias("col"))
    return own.join(row, ["t", "node"], "left").join(col, ["t", "node"], "left")


def continuity(cell: DataFrame, out_direction: str, in_direction: str) -> DataFrame:
    """One row (n, clean_max, noisy_mean): what a link's two ends count, cleanly and as observed."""
    a = cell.where(F.col("direction") == out_direction).select("t", "source", "peer", truth().alias("ca"), F.col("observed").alias("oa"))
    b = cell.where(F.col("direction") == in_direction).select("t", F.col("peer").alias("source"), F.col("source").alias("peer"), truth().alias("cb"), F.col("observed").alias("ob"))
    return a.join(b, ["t", "source", "peer"]).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("ca") - F.col("cb"))).alias("clean_max"), F.avg(F.abs(F.col("oa") - F.col("ob"))).alias("noisy_mean")
    )


def asymmetry(cell: DataFrame, out_direction: str) -> DataFrame:
    """One row (n, mean): how much the means of a link's two directions differ, relative to their mean."""
    means = cell.where(F.col("direction") == out_direction).groupBy("source", "peer").agg(F.avg(truth()).alias("m"))
    back = means.select(F.col("peer").alias("source"), F.col("source").alias("peer"), F.col("m").alias("back"))
    both = means.join(back, ["source", "peer"]).where(F.col("m") + F.col("back") != 0)
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("m") - F.col("back")) / ((F.col("m") + F.col("back")) * 0.5)).alias("mean"))


def node_ratios(sums: DataFrame) -> DataFrame:
    """(node, o_ratio, t_ratio): mean ratio of origination to row sum and of termination to column sum, in the order of the first."""
    def ratio(a: str, b: str) -> Column:
        return F.avg(F.try_divide(F.col(a), F.when(F.col(b) != 0, F.col(b))))

    return sums.groupBy("node").agg(ratio("o", "row").alias("o_ratio"), ratio("e", "col").alias("t_ratio")).orderBy("o_ratio", "node")


def invariants(cell: DataFrame, name: str, directions: tuple[str, str, str, str]) -> DataFrame:
    """The table of fixed invariants: (invariant, dataset, figure, value), in order. directions: of origination, termination,
    outgoing and incoming links. I9 needs capacities, which there are none of."""
    band = noise(cell).first()
    width = band["band"] if band["band"] is not None else 1e-6
    sums = node_sums(cell, *directions)

    def ratio(a: str, b: str) -> Column:
        return F.try_divide(F.col(a), F.when(F.col(b) != 0, F.col(b)))

    r4 = relative_residual(F.col("o") + F.col("i"), F.col("e") + F.col("x"))
    node = sums.agg(
        F.avg((r4 < width).cast("int")).alias("f"), F.avg(r4).alias("m"), F.max(r4).alias("x"),
        *(f(ratio(a, b)).alias(n) for a, b, f, n in (("o", "row", F.avg, "om"), ("o", "row", F.stddev_pop, "os"), ("e", "col", F.avg, "em"), ("e", "col", F.stddev_pop, "es"))),
    ).first()
    total = sums.groupBy("t").agg(*(F.sum(c).alias(c) for c in ("o", "e", "row", "col"))).agg(
        F.avg(ratio("o", "e")).alias("oe"), F.avg(ratio("o", "row")).alias("oh"), F.max(F.abs(F.col("row") - F.col("col"))).alias("d"),
        F.count_if((F.col("o") == 0) & (F.col("e") == 0)).alias("empty"),
    ).first()
    low = F.col("layer") == LOW
    sign = cell.agg(
        (F.count_if(low & (truth() < 0)) + F.count_if(F.col("observed") < 0)).alias("neg"),
        F.max(F.when(~low & (F.col("source") == F.col("destination")), F.abs("observed"))).alias("own"),
    ).first()
    ends, back = continuity(cell, *directions[2:]).first(), asymmetry(cell, directions[2]).first()
    found = [
        ("I1", "negative cells", sign["neg"]), ("I2", "max self-demand", sign["own"]), ("I3", "clean max", ends["clean_max"]), ("I3", "noisy mean", ends["noisy_mean"]),
        ("I4", "share in band", node["f"]), ("I4", "mean residual", node["m"]), ("I4", "max residual", node["x"]), ("I5", "mean ratio", node["om"]), ("I5", "std ratio", node["os"]),
        ("I6", "mean ratio", node["em"]), ("I6", "std ratio", node["es"]), ("I7", "origination to termination", total["oe"]), ("I7", "origination to demand", total["oh"]),
        ("I7", "row less column total", total["d"]), ("I7", "empty snapshots", total["empty"]), ("I8", "mean asymmetry", back["mean"]), ("I9", "untestable", None),
        ("I10", "differing percent", band["differing_pct"]), ("I10", "mean noise", band["rel_mean"]), ("I10", "std noise", band["rel_std"]), ("I10", "p99 noise", band["rel_p99"]),
    ]
    rows = [(i, name, f, None if v is None else float(v)) for i, f, v in found]
    out = cell.sparkSession.createDataFrame(rows, "invariant string, dataset string, figure string, value double")
    return out.orderBy(F.array_position(F.array(*map(F.lit, ORDER)), F.col("invariant")), "dataset", "figure")
