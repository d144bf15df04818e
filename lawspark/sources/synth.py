"""Synthetic snapshots with planted laws, and their null counterpart."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: The families of laws that can be planted, and those planted by default.
FAMILIES = ("row_sum", "col_sum", "two_end", "self_zero", "offset_pair", "agg_ref_balance", "presence_pair")
DEFAULT_FAMILIES = ("row_sum", "col_sum", "two_end", "self_zero", "agg_ref_balance")
DEMAND_SCALE, LINK_SCALE, SHAPE = 10.0, 8.0, 2.0
# End of fixed values.


@dataclass(frozen=True)
class Vocabulary:
    """How the names of synthetic columns are spelt."""

    measured: str = "measurement"
    demand: str = "flow"
    source: str = "source"
    destination: str = "destination"
    to: str = "to"
    from_: str = "from"
    entity: str = "n"

    def entities(self, n: int) -> list[str]:
        return [f"{self.entity}{k}" for k in range(n)]

    def flow(self, i: str, j: str) -> str:
        return f"{self.demand}_{i}_{j}"

    def end(self, i: str, which: str) -> str:
        return f"{self.measured}_{i}_{which}"

    def link(self, i: str, word: str, j: str) -> str:
        return f"{self.measured}_{i}_{word}_{j}"


@dataclass
class Synthetic:
    columns: list[str]
    matrix: np.ndarray
    timestamps: np.ndarray
    planted: dict[str, set[frozenset]] = field(default_factory=dict)
    vocabulary: Vocabulary = field(default_factory=Vocabulary)
    entities: list[str] = field(default_factory=list)


def planted(v: Vocabulary, ents: list[str]) -> dict[str, set[frozenset]]:
    """The column sets of each family's laws; for balances the sets of both sides."""
    pairs = [(i, j) for i in ents for j in ents if i != j]
    row = {i: [v.flow(i, j) for j in ents if j != i] for i in ents}
    col = {j: [v.flow(i, j) for i in ents if i != j] for j in ents}
    two = {frozenset((v.link(i, v.to, j), v.link(j, v.from_, i))) for i, j in pairs}
    return {
        "row_sum": {frozenset((v.end(i, v.source), *row[i])) for i in ents},
        "col_sum": {frozenset((v.end(j, v.destination), *col[j])) for j in ents},
        "two_end": two,
        "offset_pair": set(two),
        "presence_pair": set(two),
        "self_zero": {frozenset((v.flow(i, i),)) for i in ents},
        "agg_ref_balance": {frozenset((frozenset((v.end(i, v.source), *col[i])), frozenset((v.end(i, v.destination), *row[i])))) for i in ents},
    }


def make_synthetic(
    n_entities: int = 6,
    n_snapshots: int = 400,
    noise: float = 0.0,
    seed: int = 0,
    vocabulary: Vocabulary | None = None,
    unstable_frac: float = 0.0,
    families: tuple[str, ...] | None = None,
    regime_factor: float = 1.6,
    offset_hold_rate: float = 0.67,
    offset_factor: float = 0.98,
    presence_rate: float = 0.6,
) -> Synthetic:
    """Demand D(i, j) and link counters, as gamma variables, bound by the families' laws.

    row_sum, col_sum: an entity's source and destination counters are its demand's row and column sums (off the diagonal).
    two_end: both ends of a link count the same; offset_pair: they do for a share of the snapshots, the others are off by a
    factor; presence_pair: both are zero together, else independent. self_zero: no demand to oneself. agg_ref_balance: source
    plus column sum equals destination plus row sum, with a common bias unless a sum is planted as well. unstable_frac of the
    last snapshots break the two ends. Noise is multiplicative, on measured columns alone, cut at zero.
    """
    v, rng, on = vocabulary or Vocabulary(), np.random.default_rng(seed), set(families or DEFAULT_FAMILIES)
    if unknown := on - set(FAMILIES):
        raise ValueError(f"no families {sorted(unknown)}")
    ents, n, t = v.entities(n_entities), n_entities, n_snapshots

    def gamma(scale: float, *shape: int) -> np.ndarray:
        return rng.gamma(SHAPE, scale, shape)

    demand = gamma(DEMAND_SCALE, t, n, n)
    off = demand * (1 - np.eye(n))
    if "self_zero" in on:
        demand = off
    sent = gamma(LINK_SCALE, t, n, n)  # sent[:, i, j]: i's counter towards j; got[:, i, j]: j's counter of what comes from i
    late = np.arange(t)[:, None, None]
    if "two_end" in on:
        got = np.where(late >= t - round(unstable_frac * t), sent * regime_factor, sent)
    elif "offset_pair" in on:
        got = np.where(late >= round(min(max(offset_hold_rate, 0.0), 1.0) * t), sent * offset_factor, sent)
    else:
        got = gamma(LINK_SCALE, t, n, n)
        if "presence_pair" in on:
            there = rng.random((t, n, n)) < presence_rate
            sent, got = sent * there, got * there
    row, col = off.sum(axis=2), off.sum(axis=1)
    if "agg_ref_balance" in on:
        bias = gamma(DEMAND_SCALE, t, n) * (not on & {"row_sum", "col_sum"})
        source, destination = row + bias, col + bias
    else:
        source = row if "row_sum" in on else gamma(DEMAND_SCALE, t, n)
        destination = col if "col_sum" in on else gamma(DEMAND_SCALE, t, n)
    columns: list[str] = []
    data: list[np.ndarray] = []

    def put(name: str, values: np.ndarray, noisy: bool) -> None:
        columns.append(name)
        data.append(np.maximum(values * (1 + noise * rng.standard_normal(t)), 0) if noisy and noise else values)

    for a, i in enumerate(ents):
        for b, j in enumerate(ents):
            put(v.flow(i, j), demand[:, a, b], False)
    for a, i in enumerate(ents):
        put(v.end(i, v.source), source[:, a], True)
        put(v.end(i, v.destination), destination[:, a], True)
    for a, i in enumerate(ents):
        for b, j in enumerate(ents):
            if a != b:
                put(v.link(i, v.to, j), sent[:, a, b], True)
                put(v.link(j, v.from_, i), got[:, a, b], True)
    return Synthetic(columns, np.stack(data, axis=1), np.arange(t), {f: p for f, p in planted(v, ents).items() if f in on}, v, ents)


def make_null(n_entities: int = 6, n_snapshots: int = 400, seed: int = 0, vocabulary: Vocabulary | None = None) -> Synthetic:
    """The same columns, each an independent gamma variable: no law holds."""
    like = make_synthetic(n_entities, 1, seed=seed, vocabulary=vocabulary, families=())
    matrix = np.random.default_rng(seed).gamma(SHAPE, DEMAND_SCALE, (n_snapshots, len(like.columns)))
    return Synthetic(like.columns, matrix, np.arange(n_snapshots), {}, like.vocabulary, like.entities)


def synthetic_frame(spark, n_entities: int = 6, n_snapshots: int = 400, seed: int = 0, vocabulary: Vocabulary | None = None):
    """The default families without noise, made on the executors, for any number of snapshots: a gamma variable of shape two is
    the sum of two exponential ones."""
    from pyspark.sql import functions as F

    v = vocabulary or Vocabulary()
    ents, seeds = v.entities(n_entities), iter(range(seed * 1_000_003, (seed + 1) * 1_000_003))

    def gamma(scale: float):
        return -scale * (F.log(1 - F.rand(next(seeds))) + F.log(1 - F.rand(next(seeds))))

    pairs = [(i, j) for i in ents for j in ents if i != j]
    df = spark.range(n_snapshots).withColumnRenamed("id", "t")
    df = df.withColumns({v.flow(i, j): gamma(DEMAND_SCALE) if i != j else F.lit(0.0) for i in ents for j in ents} | {v.link(i, v.to, j): gamma(LINK_SCALE) for i, j in pairs})

    def total(names: list[str]):
        return F.aggregate(F.array(*map(F.col, names)), F.lit(0.0), lambda a, x: a + x)

    ends = {v.end(i, v.source): total([v.flow(i, j) for j in ents if j != i]) for i in ents}
    ends |= {v.end(i, v.destination): total([v.flow(j, i) for j in ents if j != i]) for i in ents}
    return df.withColumns(ends | {v.link(j, v.from_, i): F.col(v.link(i, v.to, j)) for i, j in pairs})
