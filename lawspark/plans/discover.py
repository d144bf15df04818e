"""Discovery: induce a schema from column names, enumerate its rules, judge them on the data, keep the best."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..config import Evaluation, Search
from ..operators.holds import Judge, Verdict
from ..sources.frames import Dataset, dataset, dataset_from_matrix
from .grammar import Enumeration, Grammar, grammar_of
from .portfolio import Portfolio, bloated_bound, scaled_slack
from .rules import Rule
from .spec import Spec, compile_spec

MAX_DIAGNOSTICS = 20


@dataclass
class Discovery:
    portfolio: list[Verdict]
    archive: Portfolio
    dataset: Dataset
    grammar: Grammar
    verdicts: list[Verdict]
    rounds_run: int = 1
    progress_history: list[float] = field(default_factory=list)
    reinductions: int = 0
    diagnostics: list[str] = field(default_factory=list)

    def report(self) -> str:
        line = "-" * 78
        out = [f"Laws of {self.dataset.name!r} ({len(self.portfolio)} accepted, all rules within the bounds tried):", line]
        out += [f"  {v.summary()}" for v in self.portfolio] or ["  (none)"]
        if self.diagnostics:
            out += [line, "  diagnostics:", *(f"  - {d}" for d in self.diagnostics)]
        return "\n".join([*out, line, "  statistic: hold-rate with Wilson confidence interval"])


def diagnostics_of(verdicts: Sequence[Verdict]) -> list[str]:
    """Why rules had no points: one line for each (binder, reason), the first twenty."""
    first: dict[tuple[str, str], str] = {}
    for v in verdicts:
        if "grounded 0 points" in v.reason:
            first.setdefault((v.rule.binder, v.reason), f"{v.rule.text}: {v.reason}")
    return list(first.values())[:MAX_DIAGNOSTICS]


def run(data: Dataset, grammar: Grammar, evaluation: Evaluation | None = None, search: Search | None = None, proposer=None, evaluate_all: bool = False) -> Discovery:
    """Judges the proposed rules and builds the portfolio in the order of proposal.

    Bounds that the portfolio never takes aren't measured unless evaluate_all: they have no verdict then, and only the
    metadata part of their diagnostics, that no binding is in scope.
    """
    evaluation, search = evaluation or Evaluation(), search or Search()
    if proposer is None:
        if search.proposer != "enumeration":
            raise ValueError("the only proposer is 'enumeration'")
        proposer = Enumeration(grammar)
    rules: list[Rule] = proposer.propose(0, (), None)
    if search.max_rules > 0:
        rules = rules[: search.max_rules]
    if not evaluate_all:
        rules = [r for r in rules if not (scaled_slack(r) or bloated_bound(r)) or not data.names.scope(r)[0]]
    verdicts = Judge(data, evaluation).judge(rules)
    archive = Portfolio().extend(verdicts)
    return Discovery(archive.ranked(independent=True), archive, data, grammar, verdicts, progress_history=[archive.progress()], diagnostics=diagnostics_of(verdicts))


def _spec(columns: Sequence[str], inducer, spec: Spec | None) -> Spec:
    if spec is not None:
        return spec
    if inducer is None:
        raise RuntimeError("discovery needs a schema spec, or an inducer with a responder; names are never guessed")
    return inducer.induce(columns)


def discover_dataframe(df: DataFrame, *, inducer=None, spec: Spec | None = None, evaluation: Evaluation | None = None, search: Search | None = None, proposer=None, name: str = "dataframe", timestamp: str | None = None, evaluate_all: bool = False) -> Discovery:
    """Discovery on a Spark table, decoding only observed values."""
    search = search or Search()
    schema = compile_spec(_spec(df.columns, inducer, spec))
    data = dataset(df, schema, name, timestamp)
    return run(data, grammar_of(schema, search.max_complexity, search.max_add_arity), evaluation, search, proposer, evaluate_all)


def discover(spark: SparkSession, columns: Sequence[str], matrix, *, inducer=None, spec: Spec | None = None, evaluation: Evaluation | None = None, search: Search | None = None, proposer=None, name: str = "synthetic", timestamps=None, evaluate_all: bool = False) -> Discovery:
    """Discovery on a matrix in memory."""
    search = search or Search()
    schema = compile_spec(_spec(columns, inducer, spec))
    data = dataset_from_matrix(spark, columns, matrix, schema, name, timestamps)
    return run(data, grammar_of(schema, search.max_complexity, search.max_add_arity), evaluation, search, proposer, evaluate_all)


def discover_synthetic(spark: SparkSession, synth, **options) -> Discovery:
    return discover(spark, synth.columns, synth.matrix, timestamps=synth.timestamps, **{"name": "synthetic", **options})
