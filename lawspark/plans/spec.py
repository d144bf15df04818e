"""Schema specs: what column names mean, which bindings there are, and how roles name columns. Declarations only, no code."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field

from .rules import AGGREGATES

# The closed vocabularies of a spec.
STRATEGIES = ("per_measured_col", "per_node", "per_directed_link", "singleton")
SLOTS = ("source", "destination", "peer", "local")
PREDICATE_OPS = ("==", "!=")
CODECS = ("dict_gt_hidden", "scalar")
DEFAULT_OPS = ("~=", "==", "!=", "<=", ">=", "<|>")
# End of fixed values.


class CompileError(ValueError):
    """The spec is malformed, or names something outside its closed vocabularies."""


@dataclass(frozen=True)
class Pattern:
    """How one kind of column name reads: a regular expression with named groups, or a prefix and two known tokens."""

    name: str
    matcher: str
    kind: str
    direction: str
    regex: str = ""
    node_groups: tuple[str, ...] = ()
    source_group: str = ""
    destination_group: str = ""
    peer_group: str = ""
    token_groups: tuple[str, ...] = ()
    prefix: str = ""
    sep: str = "_"
    split_slots: tuple[str, str] = ("source", "destination")

    def groups(self) -> set[str]:
        ends = (self.source_group, self.destination_group, self.peer_group)
        return {g for g in (*self.node_groups, *self.token_groups, *ends) if g}


@dataclass(frozen=True)
class Ontology:
    binders: tuple[str, ...]
    ref_roles: dict[str, tuple[str, ...]]
    fam_roles: dict[str, tuple[str, ...]]
    ops: tuple[str, ...] = DEFAULT_OPS
    agg_kinds: tuple[str, ...] = AGGREGATES
    ref_glyphs: dict[str, str] = field(default_factory=dict)
    fam_glyphs: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Template:
    """The column of a role: a text with {X}, {Y} or {col} for the binding's values."""

    binder: str
    role: str
    template: str


@dataclass(frozen=True)
class Family:
    """The columns of a family: those of a kind (and direction) whose slots satisfy all predicates (slot, op, value)."""

    binder: str
    family_role: str
    match_kind: str
    match_direction: str | None = None
    predicates: tuple[tuple[str, str, str], ...] = ()


@dataclass(frozen=True)
class Codec:
    """How a cell holds its number: as a number, or as a record of which `primary` is the observed one."""

    kind: str = "dict_gt_hidden"
    primary: str = "ground_truth"
    clean: str = "hidden_ground_truth"


@dataclass(frozen=True)
class Spec:
    name: str
    patterns: tuple[Pattern, ...]
    ontology: Ontology
    ref_templates: tuple[Template, ...]
    family_selectors: tuple[Family, ...]
    binder_enumerate: dict[str, str]
    cell_codec: Codec = field(default_factory=Codec)
    noisy_kind: str = "low"
    demand_kind: str = "high"
    link_marker_direction: str = "egress"
    notes: str = ""

    @staticmethod
    def cell_codec_default() -> Codec:
        return Codec()

    def to_json(self) -> dict:
        """The spec as plain JSON values, readable by induce.contract.read_spec and by Spec.from_json."""

        def plain(x):
            if isinstance(x, dict):
                return {k: plain(v) for k, v in x.items()}
            return [plain(v) for v in x] if isinstance(x, (list, tuple)) else x

        return plain(asdict(self))

    @classmethod
    def from_json(cls, raw: dict) -> Spec:
        """Reads what to_json wrote; induce.contract reads what models write."""

        def tuples(x):
            return tuple(tuples(v) for v in x) if isinstance(x, list) else {k: tuples(v) for k, v in x.items()} if isinstance(x, dict) else x

        raw = tuples(raw)
        parts = {"patterns": Pattern, "ref_templates": Template, "family_selectors": Family}
        built = {k: tuple(kind(**v) for v in raw[k]) for k, kind in parts.items()}
        return cls(**{**raw, **built, "ontology": Ontology(**raw["ontology"]), "cell_codec": Codec(**raw.get("cell_codec", {}))})


@dataclass(frozen=True)
class Schema:
    """A spec that passed compilation, with its lookups."""

    spec: Spec
    expressions: tuple[re.Pattern | None, ...]
    templates: dict[tuple[str, str], str]
    families: dict[tuple[str, str], Family]

    @property
    def binders(self) -> tuple[str, ...]:
        return self.spec.ontology.binders

    def refs_for(self, binder: str) -> tuple[str, ...]:
        return tuple(self.spec.ontology.ref_roles.get(binder, ()))

    def fams_for(self, binder: str) -> tuple[str, ...]:
        return tuple(self.spec.ontology.fam_roles.get(binder, ()))

    def ref_glyph(self, role: str) -> str:
        return self.spec.ontology.ref_glyphs.get(role, role)

    def fam_glyph(self, role: str) -> str:
        return self.spec.ontology.fam_glyphs.get(role, role)


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise CompileError(what)


def _expression(p: Pattern) -> re.Pattern | None:
    _need(p.matcher in ("regex", "split"), f"pattern {p.name!r}: matcher {p.matcher!r} isn't known")
    if p.matcher == "split":
        _need(bool(p.prefix), f"pattern {p.name!r}: a split needs a prefix")
        _need(len(p.split_slots) == 2 and set(p.split_slots) <= set(SLOTS), f"pattern {p.name!r}: split_slots must be two of {SLOTS}")
        return None
    _need(bool(p.regex), f"pattern {p.name!r}: the regex is empty")
    try:
        compiled = re.compile(p.regex)
    except re.error as e:
        raise CompileError(f"pattern {p.name!r}: bad regex: {e}") from e
    absent = p.groups() - set(compiled.groupindex)
    _need(not absent, f"pattern {p.name!r}: the regex has no group {sorted(absent)}")
    return compiled


def compile_spec(spec: Spec) -> Schema:
    """Checks a spec against the closed vocabularies and against itself; fails with CompileError."""
    known = spec.ontology
    _need(bool(spec.patterns), "the spec has no patterns")
    for binder, strategy in spec.binder_enumerate.items():
        _need(binder in known.binders, f"binder {binder!r} has a strategy but isn't declared")
        _need(strategy in STRATEGIES, f"binder {binder!r}: strategy {strategy!r} isn't known")
    for binder in known.binders:
        _need(binder in spec.binder_enumerate, f"binder {binder!r} has no strategy")
    _need(spec.cell_codec.kind in CODECS, f"codec {spec.cell_codec.kind!r} isn't known")
    for f in spec.family_selectors:
        for p in f.predicates:
            _need(len(p) == 3, f"family {f.family_role!r}: a predicate is [slot, op, value], not {p!r}")
            _need(p[0] in SLOTS, f"family {f.family_role!r}: slot {p[0]!r} isn't known")
            _need(p[1] in PREDICATE_OPS, f"family {f.family_role!r}: operator {p[1]!r} isn't known")
        _need(f.binder in known.binders, f"family {f.family_role!r}: binder {f.binder!r} isn't declared")
        _need(f.family_role in known.fam_roles.get(f.binder, ()), f"family {f.family_role!r} isn't a role of binder {f.binder!r}")
    for t in spec.ref_templates:
        _need(t.binder in known.binders, f"role {t.role!r}: binder {t.binder!r} isn't declared")
        _need(t.role in known.ref_roles.get(t.binder, ()), f"{t.role!r} isn't a role of binder {t.binder!r}")
    return Schema(
        spec=spec,
        expressions=tuple(_expression(p) for p in spec.patterns),
        templates={(t.binder, t.role): t.template for t in spec.ref_templates},
        families={(f.binder, f.family_role): f for f in spec.family_selectors},
    )
