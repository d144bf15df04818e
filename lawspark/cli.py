"""Command line: discover laws, validate the engine on planted data, clean up its artifacts."""

from __future__ import annotations

import argparse
import json
import shutil
import subprocess
from dataclasses import replace
from pathlib import Path

from .config import Evaluation, Run, Search, run_from_yaml
from .induce.responders import FileResponder, available_backends, make_inducer
from .plans.discover import discover, discover_dataframe
from .recover import Harness
from .report import write_json, write_rules
from .sources.frames import read_table
from .sources.synth import make_synthetic

ARTIFACTS = "artifacts"


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("lawspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def git_hash() -> str:
    try:
        return subprocess.run(["git", "rev-parse", "--short", "HEAD"], capture_output=True, text=True, timeout=5).stdout.strip() or "unknown"
    except (OSError, subprocess.SubprocessError):
        return "unknown"


def _inducer(args):
    responder = FileResponder(args.spec_json) if args.spec_json else None
    options = {"harness": args.harness} if args.harness and args.schema_backend == "agent" and responder is None else {}
    return make_inducer(args.schema_backend, responder, **options)


def run_discover(args) -> int:
    run = run_from_yaml(Path(args.config).read_text(encoding="utf-8")) if args.config else Run()
    given = {k: v for k, v in vars(args).items() if v is not None}
    evaluation = replace(run.evaluation, **{f: given[a] for f, a in (("tolerance", "tolerance"), ("hold_rate_threshold", "hold_rate"), ("ci_alpha", "ci_alpha"), ("seed", "seed")) if a in given})
    search = replace(run.search, **{f: given[f] for f in ("max_complexity", "max_add_arity", "seed") if f in given})
    source = args.input or run.path
    spark, inducer = session(), _inducer(args)
    if source:
        name = args.name or (run.name if args.config else Path(source).stem)
        result = discover_dataframe(read_table(spark, source), inducer=inducer, evaluation=evaluation, search=search, name=name)
    else:
        data = make_synthetic(args.entities, args.snapshots, args.noise, evaluation.seed)
        result = discover(spark, data.columns, data.matrix, inducer=inducer, evaluation=evaluation, search=search, name=args.name or "synthetic", timestamps=data.timestamps)
    print(result.report())
    if args.json:
        write_json(result, args.json)
        print(f"\nwrote {args.json}")
    if not args.no_save_rules and (path := write_rules(result, result.dataset.name, args.rules_dir, seed=evaluation.seed, git=git_hash())):
        print(f"wrote {path}")
    return 0 if result.portfolio else 1


def run_validate(args) -> int:
    report = Harness(session(), _inducer(args)).run_all(args.seed or 0)
    print(json.dumps(report, indent=2))
    ok = report["proxy_ok"] and report["synthetic_recovery"]["ok"]
    print("\nVALIDATION:", "PASS" if ok else "FAIL")
    return 0 if ok else 1


def run_clean(args) -> int:
    """Removes our own artifact folders, and only such: below the artifact folder, or marked by a schema log."""
    own, removed = Path(ARTIFACTS).resolve(), []
    for folder in dict.fromkeys((Path(args.out), Path(ARTIFACTS) / "discovery")):
        full = folder.resolve()
        if full.is_dir() and (own in full.parents or (full / "schema_induction.jsonl").exists()):
            shutil.rmtree(full)
            removed.append(str(folder))
    print("removed:", removed or "(nothing)")
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lawspark", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    e, s = Evaluation(), Search()
    d = sub.add_parser("discover", help="induce a schema and find the laws of a table")
    d.add_argument("--config", help="run file in YAML; options given here override it")
    d.add_argument("--input", default="", help="a table: Parquet, ORC, CSV, JSON or a pickled frame; none makes synthetic data")
    d.add_argument("--entities", type=int, default=6)
    d.add_argument("--snapshots", type=int, default=400)
    d.add_argument("--noise", type=float, default=0.02)
    d.add_argument("--tolerance", type=float, help=f"default {e.tolerance}")
    d.add_argument("--hold-rate", type=float, help=f"default {e.hold_rate_threshold}")
    d.add_argument("--ci-alpha", type=float, help=f"default {e.ci_alpha}")
    d.add_argument("--max-complexity", type=int, help=f"default {s.max_complexity}")
    d.add_argument("--max-add-arity", type=int, help=f"default {s.max_add_arity}")
    d.add_argument("--name", default="")
    d.add_argument("--json", default="", help="where to write a JSON report")
    d.add_argument("--rules-dir", default="rules")
    d.add_argument("--no-save-rules", action="store_true")
    d.set_defaults(run=run_discover)
    v = sub.add_parser("validate", help="recover planted laws, and none from noise")
    v.set_defaults(run=run_validate)
    for x in (d, v):
        x.add_argument("--schema-backend", choices=available_backends(), default="agent")
        x.add_argument("--harness", help="name of a registered responder command")
        x.add_argument("--spec-json", help="a JSON file that answers instead of a command")
        x.add_argument("--seed", type=int)
    c = sub.add_parser("clean", help="remove artifacts")
    c.add_argument("--out", default=f"{ARTIFACTS}/discovery")
    c.set_defaults(run=run_clean)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    raise SystemExit(main())
