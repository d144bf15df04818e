"""What laws say regardless of data: triviality, equivalence, implication, in closed form.

Sides are linear in their leaves, each leaf an independent real number, so a law compares an affine form with zero, and
exact fractions decide every question; no solver is needed. `~=` and `==` are the same relation here. Presence pairing
`u <|> v` says that u is zero exactly where v is.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from .rules import Num, Rule, Sum, Term, Times


@dataclass(frozen=True)
class Form:
    """sum of weights times leaves, plus a constant; no weight is zero."""

    weights: tuple[tuple[Term, Fraction], ...]
    constant: Fraction

    def times(self, k: Fraction) -> Form:
        return form_of({t: w * k for t, w in self.weights}, self.constant * k)


def form_of(weights: dict[Term, Fraction], constant: Fraction) -> Form:
    return Form(tuple(sorted(((t, w) for t, w in weights.items() if w), key=lambda x: (type(x[0]).__name__, x[0].text))), constant)


def linear(t: Term) -> Form:
    if isinstance(t, Num):
        return Form((), Fraction(t.value))
    if isinstance(t, Times):
        return linear(t.of).times(Fraction(t.factor))
    if isinstance(t, Sum):
        weights: dict[Term, Fraction] = {}
        constant = Fraction(0)
        for p in map(linear, t.parts):
            constant += p.constant
            for leaf, w in p.weights:
                weights[leaf] = weights.get(leaf, Fraction(0)) + w
        return form_of(weights, constant)
    return Form(((t, Fraction(1)),), Fraction(0))


def difference(rule: Rule) -> Form:
    return linear(Sum((rule.left, Times(-1.0, rule.right))))


def _holds(c: Fraction, op: str) -> bool:
    return {"=": c == 0, "<=": c <= 0, ">=": c >= 0, "!=": c != 0}[op]


def _relation(op: str) -> str:
    return "=" if op in ("~=", "==") else op


def _sides(rule: Rule) -> tuple[Term | None, Term | None] | None:
    """The leaves of a presence pairing, None for a side that is zero; fails on other sides (they aren't admissible)."""
    out = []
    for f in (linear(rule.left), linear(rule.right)):
        if f.weights and (len(f.weights) > 1 or f.constant):
            raise NotImplementedError("presence pairing of compound terms")
        if not f.weights and f.constant:
            raise NotImplementedError("presence pairing with a constant")
        out.append(f.weights[0][0] if f.weights else None)
    return out[0], out[1]


def verdict(rule: Rule) -> bool | None:
    """True for a law that always holds, False for one that never does, None for the rest.

    Identical sides are decided at once; sides without a leaf in common count as open, constants included, since typing
    is what rejects those.
    """
    if rule.left == rule.right:
        return rule.op != "!="
    if not rule.left.leaves().keys() & rule.right.leaves().keys():
        return None
    if rule.op == "<|>":
        u, v = _sides(rule)
        return True if u == v else None
    f = difference(rule)
    return None if f.weights else _holds(f.constant, _relation(rule.op))


def is_tautology(rule: Rule) -> bool:
    return verdict(rule) is True


def is_contradiction(rule: Rule) -> bool:
    return verdict(rule) is False


def is_trivial(rule: Rule) -> bool:
    return verdict(rule) is not None


def _ratio(f: Form, g: Form) -> tuple[Fraction, Fraction] | None:
    """(k, c) with g = k f + c, k not zero; None if there are none."""
    if len(f.weights) != len(g.weights) or any(a[0] != b[0] for a, b in zip(f.weights, g.weights)):
        return None
    k = g.weights[0][1] / f.weights[0][1]
    if any(b[1] != k * a[1] for a, b in zip(f.weights, g.weights)):
        return None
    return k, g.constant - k * f.constant


def _zero_sets(a: Rule, b: Rule) -> bool:
    """Implication where b, or both, pair presence."""
    u, v = _sides(b)
    if u == v:
        return True
    if a.op == "<|>":
        x, y = _sides(a)
        return x != y and {x, y} == {u, v}
    f = difference(a)
    if not f.weights:
        return not _holds(f.constant, _relation(a.op))
    if _relation(a.op) == "=" and not f.constant:
        # weights on exactly u and v: one is zero with the other; on one leaf alone: that leaf is zero
        return {t for t, _ in f.weights} == {u, v} - {None}
    return False


def implies(a: Rule, b: Rule) -> bool:
    """Whether b holds wherever a does."""
    if a.binder != b.binder:
        return False
    if b.op == "<|>":
        return _zero_sets(a, b)
    g, op_b = difference(b), _relation(b.op)
    if not g.weights and _holds(g.constant, op_b):
        return True
    if a.op == "<|>":
        u, v = _sides(a)
        if u == v or None not in (u, v):
            return False
        # x <|> 0 says that x is zero
        f, op_a = Form(((u or v, Fraction(1)),), Fraction(0)), "="
    else:
        f, op_a = difference(a), _relation(a.op)
    if not f.weights:
        return not _holds(f.constant, op_a)
    if not g.weights:
        return False
    found = _ratio(f, g)
    if found is None:
        return False
    k, c = found
    if op_a == ">=":
        k, op_a = -k, "<="
    if op_a == "=":
        return _holds(c, op_b)
    if op_a == "!=":
        return op_b == "!=" and c == 0
    # f <= 0, so k f + c is at most c where k > 0 and at least c where k < 0
    if op_b == "<=":
        return k > 0 and c <= 0
    if op_b == ">=":
        return k < 0 and c >= 0
    return op_b == "!=" and (k > 0 and c < 0 or k < 0 and c > 0)


def equivalent(a: Rule, b: Rule) -> bool:
    return implies(a, b) and implies(b, a)


def subsumes(a: Rule, b: Rule) -> bool:
    return implies(a, b)
