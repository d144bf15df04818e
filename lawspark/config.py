"""Settings of a discovery run, and run files in YAML."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class Evaluation:
    """How a law is judged: its hold-rate over all points, and the lower end of the rate's Wilson interval."""

    tolerance: float = 0.05
    separation_tolerance: float = 1e-6
    presence_tolerance: float = 1e-9
    hold_rate_threshold: float = 0.62
    ci_alpha: float = 0.05
    #: Points kept for a rule at most; 0 keeps all.
    subsample: int = 0
    seed: int = 0


@dataclass(frozen=True)
class Search:
    """Bounds of the rule language."""

    proposer: str = "enumeration"
    max_complexity: int = 10
    max_add_arity: int = 2
    #: Rules evaluated at most, in the order of enumeration; 0 evaluates all.
    max_rules: int = 0
    seed: int = 0


@dataclass(frozen=True)
class Run:
    name: str = "synthetic"
    evaluation: Evaluation = field(default_factory=Evaluation)
    search: Search = field(default_factory=Search)
    seed: int = 0
    path: str | None = None
    schema_backend: str = "agent"

    def reseeded(self, seed: int) -> Run:
        return replace(self, seed=seed, evaluation=replace(self.evaluation, seed=seed), search=replace(self.search, seed=seed))


def _known(kind: type, values: dict) -> dict:
    names = {f.name for f in fields(kind)}
    return {k: v for k, v in values.items() if k in names}


def parse_yaml(text: str) -> dict:
    """The YAML that run files use: nested maps of scalars by indentation, comments, inline lists."""
    try:
        import yaml

        return yaml.safe_load(text) or {}
    except ImportError:
        pass
    top: dict = {}
    stack: list[tuple[int, dict]] = [(-1, top)]
    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        indent = len(line) - len(line.lstrip())
        key, _, value = line.strip().partition(":")
        while stack[-1][0] >= indent:
            stack.pop()
        if value.strip():
            stack[-1][1][key] = _scalar(value.strip())
        else:
            stack[-1][1][key] = child = {}
            stack.append((indent, child))
    return top


def _scalar(text: str):
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x.strip()) for x in text[1:-1].split(",") if x.strip()]
    if text[:1] in "'\"" and text[-1:] == text[:1]:
        return text[1:-1]
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if text.lower() in ("null", "~"):
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def run_from_yaml(text: str) -> Run:
    """A run file: sections `dataset` (name, path), `schema` (backend), `eval` and `search`, and a top-level seed."""
    raw = parse_yaml(text)
    dataset = raw.get("dataset") if isinstance(raw.get("dataset"), dict) else {"name": raw.get("dataset")}
    schema = raw.get("schema") if isinstance(raw.get("schema"), dict) else {}
    evaluation = raw.get("eval") or raw.get("discovery") or {}
    run = Run(
        name=str(dataset.get("name") or raw.get("name") or "dataset"),
        path=dataset.get("path") or raw.get("path"),
        schema_backend=str(schema.get("backend") or raw.get("schema_backend") or "agent"),
        evaluation=Evaluation(**_known(Evaluation, evaluation)),
        search=Search(**_known(Search, raw.get("search") or {})),
    )
    return run.reseeded(int(raw["seed"])) if raw.get("seed") is not None else run
