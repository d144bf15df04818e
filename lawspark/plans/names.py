"""What column names mean under a schema: tokens, semantics, bindings, and the columns that roles name. Driver metadata."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from .rules import Col, Fold, Num, Rule, Term
from .spec import Family, Pattern, Schema

Binding = Mapping[str, str | None]

_FIELD = re.compile(r"\{(\w+)\}")


@dataclass(frozen=True)
class Semantics:
    name: str
    kind: str
    direction: str
    nodes: tuple[str, ...]
    source: str | None = None
    destination: str | None = None
    peer: str | None = None
    role = "volume"

    def slot(self, slot: str) -> str | None:
        if slot == "local":
            return self.nodes[0] if self.nodes else None
        return getattr(self, slot)


def split_known(body: str, tokens: Iterable[str], sep: str = "_") -> tuple[str, str] | None:
    """body as two known tokens around the separator; the longest first token wins."""
    known = set(tokens)
    ends = [k for k in range(len(body) - 1, 0, -1) if body.startswith(sep, k)]
    return next(((body[:k], body[k + len(sep) :]) for k in ends if body[:k] in known and body[k + len(sep) :] in known), None)


def _read(p: Pattern, expression: re.Pattern | None, column: str, tokens: frozenset[str]) -> Semantics | None:
    if expression is not None:
        m = expression.match(column)
        if m is None:
            return None
        ends = {s: m[g] if g else None for s, g in zip(("source", "destination", "peer"), (p.source_group, p.destination_group, p.peer_group))}
        return Semantics(column, p.kind, p.direction, tuple(m[g] for g in p.node_groups), **ends)
    if not column.startswith(p.prefix):
        return None
    pair = split_known(column[len(p.prefix) :], tokens)
    if pair is None:
        return None
    ends = {s: v for s, v in zip(p.split_slots, pair) if s != "local"}
    return Semantics(column, p.kind, p.direction, pair, **ends)


def tokens_of(schema: Schema, columns: Iterable[str]) -> frozenset[str]:
    """The node tokens: what the token groups of the first matching expression hold, over all columns."""
    found: set[str] = set()
    readers = [(p, e) for p, e in zip(schema.spec.patterns, schema.expressions) if e is not None and p.token_groups]
    for c in columns:
        for p, e in readers:
            if m := e.match(c):
                found |= {m[g] for g in p.token_groups if m[g]}
                break
    return frozenset(found)


@dataclass(frozen=True)
class Names:
    """All columns that the schema understands."""

    schema: Schema
    tokens: tuple[str, ...]
    by_name: dict[str, Semantics]

    @classmethod
    def of(cls, schema: Schema, columns: Sequence[str]) -> Names:
        tokens = tokens_of(schema, columns)
        read = {}
        for c in columns:
            for p, e in zip(schema.spec.patterns, schema.expressions):
                if (s := _read(p, e, c, tokens)) is not None:
                    read[c] = s
                    break
        return cls(schema, tuple(sorted(tokens)), read)

    @property
    def low(self) -> list[str]:
        """Columns of the measured (noisy) kind."""
        return [c for c, s in self.by_name.items() if s.kind == self.schema.spec.noisy_kind]

    @property
    def high(self) -> list[str]:
        return [c for c, s in self.by_name.items() if s.kind != self.schema.spec.noisy_kind]

    @property
    def columns(self) -> list[str]:
        return self.low + self.high

    # Bindings ----------------------------------------------------------------------------------------------------------

    def bindings(self, binder: str) -> list[Binding]:
        spec = self.schema.spec
        match spec.binder_enumerate.get(binder):
            case "per_measured_col":
                return [{"col": c} for c in self.columns]
            case "per_node":
                return [{"X": x} for x in self.tokens]
            case "per_directed_link":
                marked = [s for s in self.by_name.values() if s.kind == spec.noisy_kind and s.direction == spec.link_marker_direction]
                known = set(self.tokens)
                return [{"X": s.source, "Y": s.peer} for s in sorted((m for m in marked if m.source in known), key=lambda s: s.source)]
            case "singleton":
                return [{}]
        raise ValueError(f"binder {binder!r} has no strategy")

    def column_of(self, binder: str, role: str, binding: Binding) -> str | None:
        """The column that a role names in a binding; None if there is no such column. Only whole {names} are filled in."""
        template = self.schema.templates.get((binder, role))
        if template is None or any(f not in binding for f in _FIELD.findall(template)):
            return None
        name = _FIELD.sub(lambda m: str(binding[m[1]]), template)
        return name if name in self.by_name else None

    def family_of(self, binder: str, family: str, binding: Binding) -> tuple[str, ...]:
        """The columns of a family in a binding, sorted."""
        f = self.schema.families.get((binder, family))
        if f is None:
            return ()
        fit = (
            c for c, s in self.by_name.items()
            if s.kind == f.match_kind and f.match_direction in (None, s.direction) and all(_fits(p, s, binding) for p in f.predicates)
        )
        return tuple(sorted(fit))

    def leaf(self, binder: str, leaf: Term, binding: Binding) -> tuple[str, ...]:
        """The columns of a leaf; empty if the leaf is out of scope."""
        if isinstance(leaf, Col):
            c = self.column_of(binder, leaf.role, binding)
            return () if c is None else (c,)
        return self.family_of(binder, leaf.family, binding)

    def scope(self, rule: Rule) -> tuple[int, int]:
        """(bindings in which both sides have all their columns, bindings)."""
        all_ = self.bindings(rule.binder)
        return sum(all(self.leaf(rule.binder, x, b) for x in rule.leaf_set()) for b in all_), len(all_)

    def summary(self) -> dict:
        """Names and counts alone, nothing from the data."""
        return {"nodes": list(self.tokens), "n_nodes": len(self.tokens), "n_low": len(self.low), "n_high": len(self.high), "n_columns": len(self.by_name)}


def _fits(predicate: tuple[str, str, str], s: Semantics, binding: Binding) -> bool:
    slot, op, value = predicate
    left = s.slot(slot)
    if value == "*":
        right = left
    elif value.startswith("@"):
        right = s.slot(value[1:])
    else:
        right = binding.get(value, value)
    return (left == right) is (op == "==")


def leaves_of(rules: Iterable[Rule]) -> list[Term]:
    """Leaves in the order in which rules use them."""
    seen: dict[Term, None] = {}
    for r in rules:
        for side in (r.left, r.right):
            seen.update(dict.fromkeys(side.leaves()))
    return list(seen)


def measured(t: Term) -> bool:
    return not isinstance(t, Num)


__all__ = ["Binding", "Family", "Fold", "Names", "Semantics", "leaves_of", "measured", "split_known", "tokens_of"]
