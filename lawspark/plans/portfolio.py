"""From accepted laws to a portfolio: equivalent and implied laws are dropped, the rest are ranked."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from . import logic
from .rules import Col, Rule, Sum, Term, Times, is_zero

#: How much an operator says.
STRENGTH = {"==": 3, "~=": 3, "<|>": 3, "!=": 2, "<=": 1, ">=": 1}
# End of fixed values.


def _slack_term(t: Term) -> bool:
    if isinstance(t, Times):
        return t.factor < 0 or abs(t.factor) < 1
    return isinstance(t, Sum) and any(map(_slack_term, t.parts))


def scaled_slack(rule: Rule) -> bool:
    """A bound whose small or negative multiple makes it weaker than it looks."""
    return rule.op in ("<=", ">=") and (_slack_term(rule.left) or _slack_term(rule.right))


def bloated_bound(rule: Rule) -> bool:
    """A bound other than of a single column by zero."""
    if rule.op not in ("<=", ">="):
        return False
    sides = [s for s in (rule.left, rule.right) if not is_zero(s)]
    return len(sides) != 1 or not isinstance(sides[0], Col)


def rank(v) -> tuple:
    """Larger is better: the sure part of the hold-rate, the rate, what the operator says, brevity, description gain."""
    return v.hold_rate_lo, v.hold_rate, STRENGTH.get(v.rule.op, 0), -v.rule.length, v.mdl_gain


@dataclass
class Portfolio:
    """Laws kept so far, in the order of their places. A law that betters an equivalent one takes its place."""

    places: dict[tuple, object] = field(default_factory=dict)

    def add(self, v) -> bool:
        rule = v.rule
        if not v.accepted or scaled_slack(rule) or bloated_bound(rule):
            return False
        leaves = rule.leaf_set()
        rivals = [(p, k) for p, k in self.places.items() if k.rule.binder == rule.binder and k.rule.leaf_set() == leaves]
        for place, kept in rivals:
            forth = logic.implies(kept.rule, rule)
            back = logic.implies(rule, kept.rule)
            if forth and back:
                better = rank(v) > rank(kept)
                if better:
                    self.places[place] = v
                return better
            if forth and kept.rule.length <= rule.length:
                return False
            if back and rule.length <= kept.rule.length:
                del self.places[place]
        self.places[rule.identity] = v
        return True

    def extend(self, verdicts: Iterable) -> Portfolio:
        for v in verdicts:
            self.add(v)
        return self

    def representatives(self) -> list:
        return list(self.places.values())

    def signatures(self) -> set[str]:
        return {v.rule.signature for v in self.places.values()}

    def progress(self) -> float:
        return sum(v.hold_rate_lo for v in self.places.values())

    def front(self) -> list:
        """Laws that no other is at least as sure and as short as, and better in one of both: a sweep by length."""
        out, best = [], float("-inf")
        by_length: dict[int, list] = {}
        for v in self.places.values():
            by_length.setdefault(v.rule.length, []).append(v)
        for n in sorted(by_length):
            top = max(v.hold_rate_lo for v in by_length[n])
            if top > best:
                out += [v for v in by_length[n] if v.hold_rate_lo == top]
                best = top
        order = {id(v): k for k, v in enumerate(self.places.values())}
        return sorted(out, key=lambda v: order[id(v)])

    def ranked(self, independent: bool = False) -> list:
        """All laws, best first, ties in the order of their places; independent: without those that a better, no longer law
        over the same leaves implies."""
        ordered = sorted(self.places.values(), key=rank, reverse=True)
        if not independent:
            return ordered
        kept: list = []
        for v in ordered:
            rule, leaves = v.rule, v.rule.leaf_set()
            if not any(
                k.rule.binder == rule.binder and k.rule.length <= rule.length and k.rule.leaf_set() == leaves and logic.implies(k.rule, rule)
                for k in kept
            ):
                kept.append(v)
        return kept
