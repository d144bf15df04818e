"""What a discovery leaves behind: rules files, JSON reports, tables."""

from __future__ import annotations

import json
import re
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .operators.holds import verdict_frame
from .plans.discover import MAX_DIAGNOSTICS, Discovery
from .plans.rules import rule_to_dict


def rule_lines(result: Discovery) -> list[str]:
    return [
        f"{v.rule.text:<64s} # {v.strictness.upper():<10s} eps={v.eps:.4g} hold={v.hold_rate:.3f}[{v.hold_rate_lo:.2f},{v.hold_rate_hi:.2f}] "
        f"supp={v.support:.2f} mdl={v.mdl_gain:+.3f}"
        for v in result.portfolio
    ]


def rules_text(result: Discovery, name: str, *, seed: int = 0, proposer: str = "enumeration", git: str = "unknown", now: datetime | None = None) -> str:
    """A rules file: a law a line with its figures, then what made it."""
    facts = {
        "dataset": name,
        "run time": f"{now or datetime.now(timezone.utc):%Y-%m-%dT%H:%M:%SZ} (UTC)",
        "git": git,
        "proposer": f"{proposer}  seed={seed}  rounds={result.rounds_run}",
        "statistic": "hold-rate with Wilson confidence interval; MDL is tie-break only",
        "portfolio": f"{len(result.portfolio)} invariant(s)",
    }
    foot = ["", "# invariants of observed data", *(f"# {k:<10s} : {v}" for k, v in facts.items())]
    if result.diagnostics:
        foot += ["# diagnostics:", *(f"# - {d}" for d in result.diagnostics[:MAX_DIAGNOSTICS])]
    return "\n".join(rule_lines(result) + foot) + "\n"


def write_rules(result: Discovery, name: str, folder: str = "rules", **facts) -> str | None:
    """Writes <name>_<time>.dl and returns its path; None without a law."""
    if not result.portfolio:
        return None
    now = datetime.now(timezone.utc)
    path = Path(folder) / f"{re.sub(r'[^0-9A-Za-z_-]', '_', name)}_{now:%Y%m%dT%H%M%SZ}.dl"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(rules_text(result, name, now=now, **facts), encoding="utf-8")
    return str(path)


def payload(result: Discovery) -> dict:
    return {
        "dataset": result.dataset.name,
        "rounds": result.rounds_run,
        "progress": result.progress_history,
        "statistic": "hold_rate_wilson_ci",
        "diagnostics": list(result.diagnostics),
        "portfolio": [
            {
                "rule": v.rule.text,
                "strictness": v.strictness,
                "hold_rate": v.hold_rate,
                "hold_rate_ci": [v.hold_rate_lo, v.hold_rate_hi],
                "eps": v.eps,
                "mdl_gain": v.mdl_gain,
                "support": v.support,
                "n_bindings": v.n_bindings,
            }
            for v in result.portfolio
        ],
    }


def write_json(result: Discovery, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(payload(result), indent=2), encoding="utf-8")


def portfolio_frame(spark: SparkSession, result: Discovery) -> DataFrame:
    """The portfolio as a table, in its order, for any of Spark's writers."""
    from pyspark.sql import functions as F

    order = spark.createDataFrame([(v.rule.binder, v.rule.law, k + 1, json.dumps(rule_to_dict(v.rule))) for k, v in enumerate(result.portfolio)], "binder string, law string, rank int, rule string")
    return verdict_frame(spark, result.portfolio).join(F.broadcast(order), ["binder", "law"]).orderBy("rank")
