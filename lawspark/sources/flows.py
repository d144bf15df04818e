"""Snapshots from the order tables: monthly trade between customer and supplier places as a flow matrix with its counters.

The flow of (s, d) is the revenue of items that suppliers in d sold to customers in s, before tax; counters are taken after
tax, so that sums of flows fall short of them by a few percent.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..induce.completeness import alternation
from ..induce.contract import read_spec
from ..plans.spec import Spec

LEVELS = {"region": "r_name", "nation": "n_name"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, sf_dir: str, level: str) -> list[str]:
    """The names of regions or nations: a table of fixed size."""
    column = LEVELS[level]
    return [r[0] for r in read(spark, sf_dir, level).select(column).distinct().orderBy(column).collect()]


def flow_cells(spark: SparkSession, sf_dir: str, level: str = "region") -> DataFrame:
    """(t, s, d, v, g, q): month, places, revenue before and after tax, quantity.

    Places are joined to the small side of each pair first, suppliers' to items and customers' to orders: where they are small
    they are broadcast and items are shuffled once, for their orders; however large they are, items are shuffled twice. Sums are
    combined before the last, small shuffle.
    """
    where = read(spark, sf_dir, "nation")
    if level == "region":
        where = where.join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    where = where.select("n_nationkey", F.col(LEVELS[level]).alias("place"))
    customers = read(spark, sf_dir, "customer").join(F.broadcast(where), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("place").alias("s"))
    suppliers = read(spark, sf_dir, "supplier").join(F.broadcast(where), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("place").alias("d"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    orders = read(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.date_trunc("month", "o_orderdate").alias("t"), "s")
    items = (
        read(spark, sf_dir, "lineitem").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .select("l_orderkey", "d", net.alias("net"), (net * (1 + F.col("l_tax"))).alias("gross"), F.col("l_quantity").alias("quantity"))
    )
    return (
        items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("t", "s", "d").agg(F.sum("net").alias("v"), F.sum("gross").alias("g"), F.sum("quantity").alias("q"))
    )


@dataclass(frozen=True)
class Flow:
    """How the columns of flow snapshots are called."""

    tokens: tuple[str, ...]

    def flow(self, s: str, d: str) -> str:
        return f"flow_{s}_{d}"

    def source(self, s: str) -> str:
        return f"measurement_{s}_source"

    def destination(self, d: str) -> str:
        return f"measurement_{d}_destination"

    def to(self, s: str, d: str) -> str:
        return f"measurement_{s}_to_{d}"

    def from_(self, d: str, s: str) -> str:
        return f"measurement_{d}_from_{s}"

    def pairs(self) -> list[tuple[str, str]]:
        return [(s, d) for s in self.tokens for d in self.tokens]

    def columns(self) -> list[str]:
        off = [(s, d) for s, d in self.pairs() if s != d]
        ends = [f(x) for x in self.tokens for f in (self.source, self.destination)]
        return [self.flow(s, d) for s, d in self.pairs()] + ends + [c for s, d in off for c in (self.to(s, d), self.from_(d, s))]


def snapshots(spark: SparkSession, sf_dir: str, level: str = "region", fill: float | None = None, links: bool = True) -> DataFrame:
    """One row a month: all columns of Flow. A cell without trade is null, or `fill`; counters of an end are null, or sum up the
    rest, accordingly. One pivot with known values: a grouped sum, no second pass for the names."""
    names = Flow(tuple(places(spark, sf_dir, level)))
    keys = [f"{s}→{d}" for s, d in names.pairs()]
    cells = flow_cells(spark, sf_dir, level).withColumn("k", F.concat("s", F.lit("→"), "d"))
    wide = cells.groupBy("t").pivot("k", keys).agg(F.sum("v").alias("v"), F.sum("g").alias("g"))

    def cell(s: str, d: str, what: str):
        c = F.col(f"`{s}→{d}_{what}`")
        return c if fill is None else F.coalesce(c, F.lit(fill))

    def total(cells: list):
        return F.aggregate(F.array(*cells), F.lit(0.0), lambda a, x: a + x)

    out = [cell(s, d, "v").alias(names.flow(s, d)) for s, d in names.pairs()]
    for x in names.tokens:
        out.append(total([cell(x, d, "g") for d in names.tokens if d != x]).alias(names.source(x)))
        out.append(total([cell(s, x, "g") for s in names.tokens if s != x]).alias(names.destination(x)))
    if links:
        for s, d in names.pairs():
            if s != d:
                out += [cell(s, d, "v").alias(names.to(s, d)), cell(s, d, "g").alias(names.from_(d, s))]
    return wide.select("t", *out)


def answer(tokens) -> dict:
    """What a responder would say of these columns: patterns over whole tokens, which may hold separators and spaces."""
    one = alternation(tokens)

    def pattern(name, kind, direction, regex, ends):
        return {"name": name, "matcher": "regex", "kind": kind, "direction": direction, "regex": regex, "node_groups": list(ends.values()), **{f"{k}_group": v for k, v in ends.items()}}

    pair = {"source": "source", "peer": "peer"}
    return {
        "name": "flows", "noisy_kind": "measurement", "demand_kind": "flow",
        "patterns": [
            pattern("flow", "flow", "demand", f"^flow_(?P<source>{one})_(?P<destination>{one})$", {"source": "source", "destination": "destination"}),
            pattern("source", "measurement", "source", f"^measurement_(?P<source>{one})_source$", {"source": "source"}),
            pattern("destination", "measurement", "destination", f"^measurement_(?P<source>{one})_destination$", {"source": "source"}),
            pattern("to", "measurement", "to", f"^measurement_(?P<source>{one})_to_(?P<peer>{one})$", pair),
            pattern("from", "measurement", "from", f"^measurement_(?P<source>{one})_from_(?P<peer>{one})$", pair),
        ],
        "ontology": {"binders": [], "ref_roles": {}, "fam_roles": {}}, "ref_templates": [], "family_selectors": [], "binder_enumerate": {},
    }


def flow_spec(tokens) -> Spec:
    return read_spec(answer(tokens))
