"""Judging laws: all rules of a binder in one grouped aggregation over its points.

Rules that compare the same two sides share a pair; a pair's statistics answer all six operators and both directions. Each
point is inlined into one row for each pair, and Spark sums these by pair before the shuffle, so what moves is a row for each
pair and task. Only pairs with a positive scale below a millionth of their largest need the median that floors the scale (it
can't matter otherwise); only accepted laws need the median residual of the description length. Both come from
quantiles_of, in bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Evaluation
from ..functions import measures
from ..functions.terms import term, term_text
from ..plans import logic
from ..plans.names import leaves_of
from ..plans.rules import Rule, Term
from ..sources.frames import TIME, Dataset
from .points import BINDING, leaf_names, long_points, wide_points
from .quantiles import quantiles_of, values_at

#: The scale's floor as a share of the median scale, and texts of verdicts.
FLOOR = 1e-6
TRIVIAL = "solver-trivial tautology/contradiction"
NO_VARIATION = "existence has no observed presence/absence variation"
ABOVE = "hold-rate above Wilson threshold"
BELOW = "hold-rate Wilson lower bound below threshold"
STATISTIC = "hold_rate"
# End of fixed values.

#: Hashes of points: whole numbers that a double holds.
SEED, HASHES = 7919, 1 << 52

#: Bytes of code above which the JVM doesn't compile a method, and Spark's setting for it.
COMPILED_BYTES, METHOD_LIMIT = 8000, "spark.sql.codegen.hugeMethodLimit"

#: Bindings whose leaves read more columns than this take the long route.
WIDE_LIMIT = 20_000


@dataclass(frozen=True)
class Verdict:
    """What the data say about a rule."""

    rule: Rule
    accepted: bool
    reason: str
    eps: float = 0.0
    hold_rate: float = 0.0
    hold_rate_lo: float = 0.0
    hold_rate_hi: float = 0.0
    support: float = 0.0
    n_points: int = 0
    n_bindings: int = 0
    mdl_gain: float = 0.0
    strictness: str = "reject"
    statistic: str = STATISTIC
    stability_std: float = 0.0
    stability_min: float = 1.0

    # Names that older reports use for the same numbers.
    coverage = property(lambda self: self.hold_rate)
    coverage_lo = property(lambda self: self.hold_rate_lo)
    coverage_hi = property(lambda self: self.hold_rate_hi)
    operating_cov = property(lambda self: self.hold_rate)
    support_margin = property(lambda self: self.hold_rate_lo)
    stability_margin = property(lambda self: self.hold_rate_lo)

    @property
    def descriptor(self) -> tuple[str, int]:
        return self.rule.binder, self.rule.length

    def summary(self) -> str:
        band = f"hold={self.hold_rate:.3f}[{self.hold_rate_lo:.2f},{self.hold_rate_hi:.2f}]"
        return f"{self.rule.text:<54s} {self.strictness:<10s} {band} mdl={self.mdl_gain:+.2f} {self.reason}"


@dataclass(frozen=True)
class Pair:
    """Two sides, in the order of their texts."""

    left: Term
    right: Term

    @classmethod
    def of(cls, rule: Rule) -> tuple[Pair, bool]:
        """The rule's pair, and whether the rule has its sides the other way round."""
        turned = rule.right.text < rule.left.text
        return (cls(rule.right, rule.left) if turned else cls(rule.left, rule.right)), turned


def pair_columns(pairs: Sequence[Pair], names: dict[Term, str]) -> list[tuple[Column, Column]]:
    def leaf(x: Term) -> Column:
        return F.col(names[x])

    return [(term(p.left, leaf), term(p.right, leaf)) for p in pairs]


def scale_of(left: Column, right: Column) -> Column:
    return F.greatest(F.abs(left), F.abs(right))


def pair_cells(points: DataFrame, pairs: Sequence[Pair], names: dict[Term, str], some: Sequence[int], floors: dict[int, float] | None = None) -> DataFrame:
    """(h, k, a, b, floor): both sides of those pairs at each point where their difference and scale are finite, and a hash of the point."""
    leaf = lambda x: f"`{names[x]}`"
    cells = (f"named_struct('k', {k}, 'a', {term_text(pairs[k].left, leaf)}, 'b', {term_text(pairs[k].right, leaf)}, 'floor', double('{(floors or {}).get(k, 0.0)!r}'))" for k in some)
    rows = points.selectExpr(f"pmod(xxhash64(`{TIME}`, `{BINDING}`, {SEED}), {HASHES}) AS h", f"inline(array({', '.join(cells)}))")
    a, b = F.col("a"), F.col("b")
    return rows.where(measures.finite(a - b) & measures.finite(scale_of(a, b)))


def subsampled(cells: DataFrame, n: int, seed: int) -> DataFrame:
    """n points of each pair by the order of their hashes, or all if there are fewer; the same on every run. The n-th hash of each pair
    is found by counting, so no pair's points are sorted."""
    if not n:
        return cells
    cells = cells.withColumn("h", F.pmod(F.xxhash64("h", F.lit(seed)), F.lit(HASHES)))
    last = values_at(cells.select("k", F.col("h").cast("double").alias("v")), lambda _, size: [n - 1] if size > n else [])
    if not last:
        return cells
    last = cells.sparkSession.createDataFrame([(k, int(h)) for (k, _), h in last.items()], "k int, last long")  # a row for each pair
    return cells.join(F.broadcast(last), "k", "left").where("last is null or h <= last").drop("last")


def pair_statistics(points: DataFrame, pairs: Sequence[Pair], names: dict[Term, str], cfg: Evaluation, floors: dict[int, float] | None = None) -> dict[int, dict]:
    """The sums of each pair over its finite points, by the pair's number; only pairs in floors if these are given."""
    some = list(range(len(pairs))) if floors is None else sorted(floors)
    rows = subsampled(pair_cells(points, pairs, names, some, floors), cfg.subsample, cfg.seed)
    a, b = F.col("a"), F.col("b")
    rows = rows.select(F.col("k").alias("pair"), "a", "b", "floor", (a - b).alias("rho"), scale_of(a, b).alias("s0"))
    rows = rows.withColumn("s", F.greatest("s0", "floor"))
    rel = F.when(F.col("s") == 0, F.lit(0.0)).otherwise(F.try_divide("rho", "s"))
    least = F.greatest(F.col("s"), F.lit(1.0)) * cfg.presence_tolerance
    rows = rows.select("pair", "s0", rel.alias("r"), (F.abs(a) > least).alias("pa"), (F.abs(b) > least).alias("pb"))
    r, tol = F.col("r"), cfg.tolerance + measures.SLACK
    found = rows.groupBy("pair").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.abs(r) <= tol).alias("near"),
        F.count_if(r <= tol).alias("below"),
        F.count_if(-r <= tol).alias("above"),
        F.count_if(F.abs(r) > cfg.separation_tolerance).alias("apart"),
        F.count_if(F.col("pa") == F.col("pb")).alias("together"),
        F.count_if("pa").alias("pa"),
        F.count_if("pb").alias("pb"),
        F.max(F.abs(r)).alias("max_rel"),
        F.min(F.abs(r)).alias("min_rel"),
        F.min(F.when(F.col("s0") > 0, F.col("s0"))).alias("min_scale"),
        F.max("s0").alias("max_scale"),
    )
    return {row["pair"]: row.asDict() for row in found.collect()}  # a row for each pair


@contextmanager
def compiled(spark: SparkSession):
    """Lets Spark split the code of wide expressions over methods small enough for the JVM's compiler, which leaves larger ones to its
    interpreter. The session's limit is put back at the end."""
    before = spark.conf.get(METHOD_LIMIT)
    spark.conf.set(METHOD_LIMIT, min(int(before), COMPILED_BYTES))
    try:
        yield
    finally:
        spark.conf.set(METHOD_LIMIT, before)


@dataclass
class Judge:
    """Judges rules on a dataset. median_for: `accepted` finds the description length of accepted laws alone, `all` of all."""

    data: Dataset
    cfg: Evaluation = Evaluation()
    median_for: str = "accepted"
    route: str = "auto"

    def points(self, binder: str, leaves: Sequence[Term]) -> DataFrame:
        reads = sum(len(self.data.names.leaf(binder, x, b)) for b in self.data.names.bindings(binder) for x in leaves)
        wide = self.route == "wide" or self.route == "auto" and reads <= WIDE_LIMIT
        return (wide_points if wide else long_points)(self.data, binder, leaves)

    def judge(self, rules: Iterable[Rule]) -> list[Verdict]:
        """A verdict for each rule, in their order."""
        rules = list(rules)
        open_: dict[str, list[int]] = {}
        out: list[Verdict | None] = [None] * len(rules)
        for k, rule in enumerate(rules):
            if logic.is_trivial(rule):
                out[k] = Verdict(rule, False, TRIVIAL)
            else:
                open_.setdefault(rule.binder, []).append(k)
        with compiled(self.data.frame.sparkSession), ThreadPoolExecutor(max(1, len(open_))) as pool:  # binders don't wait for each other's jobs
            judged = pool.map(lambda binder: self._binder(binder, [rules[k] for k in open_[binder]]), open_)
            for numbers, verdicts in zip(open_.values(), judged):
                for k, v in zip(numbers, verdicts):
                    out[k] = v
        return out

    def _binder(self, binder: str, rules: list[Rule]) -> list[Verdict]:
        leaves = leaves_of(rules)
        names = leaf_names(leaves)
        bindings = self.data.names.bindings(binder)
        scopes = {x: {k for k, b in enumerate(bindings) if self.data.names.leaf(binder, x, b)} for x in leaves}

        def scope(rule: Rule) -> tuple[int, int]:
            inside = set(range(len(bindings)))
            for x in rule.leaf_set():
                inside &= scopes[x]
            return len(inside), len(bindings)

        pairs = list(dict.fromkeys(Pair.of(r)[0] for r in rules if scope(r)[0]))
        number = {p: k for k, p in enumerate(pairs)}
        stats: dict[int, dict] = {}
        points = None
        if pairs:
            points = self.points(binder, leaves)
            stats = pair_statistics(points, pairs, names, self.cfg)
            low = [k for k, s in stats.items() if s["min_scale"] is not None and s["min_scale"] < FLOOR * s["max_scale"]]
            if low:
                cells = subsampled(pair_cells(points, pairs, names, low), self.cfg.subsample, self.cfg.seed)
                scales = cells.select("k", scale_of(F.col("a"), F.col("b")).alias("v")).where("v > 0")
                floors = {k: FLOOR * m for k, m in quantiles_of(scales).items()}
                stats |= pair_statistics(points, pairs, names, self.cfg, floors)
                for k, f in floors.items():
                    stats[k]["floor"] = f
        verdicts = [self._verdict(r, stats.get(number.get(Pair.of(r)[0], -1)), scope(r)) for r in rules]
        wanted = [k for k, v in enumerate(verdicts) if v.n_points and (v.accepted or self.median_for == "all")]
        medians = self._medians(points, pairs, names, stats, {number[Pair.of(rules[k])[0]] for k in wanted if rules[k].op != "<|>"}) if wanted else {}
        for k in wanted:
            v, s = verdicts[k], stats[number[Pair.of(rules[k])[0]]]
            half = (0.0 if 2 * s["together"] > s["n"] else 0.5 if 2 * s["together"] == s["n"] else 1.0) if rules[k].op == "<|>" else medians[number[Pair.of(rules[k])[0]]]
            verdicts[k] = Verdict(**{**v.__dict__, "mdl_gain": measures.description_gain(rules[k].complexity, v.eps, half)})
        return verdicts

    def _medians(self, points: DataFrame, pairs: list[Pair], names: dict, stats: dict[int, dict], wanted: set[int]) -> dict[int, float]:
        """Median relative residual of pairs. Where all of them lie beyond the ends that the description length cuts at, either
        end is as good as the median."""
        out, open_ = {}, []
        for k in sorted(wanted):
            s = stats[k]
            if s["max_rel"] <= measures.SMALLEST or s["min_rel"] == s["max_rel"]:
                out[k] = s["max_rel"]
            elif s["min_rel"] >= 1:
                out[k] = 1.0
            else:
                open_.append(k)
        if open_:
            floors = {k: stats[k].get("floor", 0.0) for k in open_}
            cells = subsampled(pair_cells(points, pairs, names, open_, floors), self.cfg.subsample, self.cfg.seed)
            a, b = F.col("a"), F.col("b")
            s = F.greatest(scale_of(a, b), "floor")
            out |= quantiles_of(cells.select("k", F.when(s == 0, F.lit(0.0)).otherwise(F.try_divide(F.abs(a - b), s)).alias("v")))
        return out

    def _verdict(self, rule: Rule, s: dict | None, scope: tuple[int, int]) -> Verdict:
        inside, tried = scope
        if s is None:
            return Verdict(rule, False, f"grounded 0 points for binder {rule.binder!r} ({inside}/{tried} non-degenerate bindings)")
        cfg, n, turned = self.cfg, s["n"], Pair.of(rule)[1]
        if rule.op == "<|>":
            if s["pa"] in (0, n) and s["pb"] in (0, n):
                return Verdict(rule, False, NO_VARIATION)
            k, eps, strict = s["together"], cfg.presence_tolerance, "existence"
        elif rule.op == "!=":
            k, eps, strict = s["apart"], cfg.separation_tolerance, "separation"
        elif rule.op in ("<=", ">="):
            k, eps, strict = s["below" if (rule.op == "<=") != turned else "above"], cfg.tolerance, "one-sided"
        else:
            k, eps = s["near"], cfg.tolerance
            strict = "exact" if s["max_rel"] <= measures.EXACT else "soft" if k == n else "loose"
        low, high, rate = measures.wilson(k, n, measures.z_for_alpha(cfg.ci_alpha))
        ok = low >= cfg.hold_rate_threshold
        return Verdict(rule, ok, ABOVE if ok else BELOW, eps, rate, low, high, inside / tried, n, inside, 0.0, strict)


VERDICT_SCHEMA = (
    "binder string, law string, op string, accepted boolean, reason string, strictness string, n_points long, n_bindings long, "
    "support double, hold_rate double, hold_rate_lo double, hold_rate_hi double, eps double, mdl_gain double, length int"
)


def verdict_frame(spark: SparkSession, verdicts: Iterable[Verdict]) -> DataFrame:
    rows = [
        (v.rule.binder, v.rule.law, v.rule.op, v.accepted, v.reason, v.strictness, v.n_points, v.n_bindings, v.support, v.hold_rate, v.hold_rate_lo, v.hold_rate_hi, v.eps, v.mdl_gain, v.rule.length)
        for v in verdicts
    ]
    return spark.createDataFrame(rows, VERDICT_SCHEMA)
