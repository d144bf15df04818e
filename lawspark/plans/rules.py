"""The rule language: laws `for every binding of a binder: left op right` over a small linear algebra of columns."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

#: Operators and aggregates of the language.
OPS = ("~=", "==", "<=", ">=", "!=", "<|>")
AGGREGATES = ("SUM", "MIN", "MAX", "AVG")
SYMMETRIC = frozenset(("~=", "==", "!=", "<|>"))
# End of fixed values.


def number(x: float) -> str:
    return f"{x:g}" if x != int(x) else str(int(x))


@dataclass(frozen=True)
class Num:
    """A constant."""

    value: float
    size = 1

    @property
    def text(self) -> str:
        return number(self.value)

    def leaves(self) -> Counter:
        return Counter()


@dataclass(frozen=True)
class Col:
    """The column that a role names in a binding."""

    role: str
    size = 1

    @property
    def text(self) -> str:
        return self.role

    def leaves(self) -> Counter:
        return Counter([self])


@dataclass(frozen=True)
class Fold:
    """An aggregate over the columns of a family, row by row."""

    kind: str
    family: str
    size = 2

    @property
    def text(self) -> str:
        return f"{self.kind}({self.family})"

    def leaves(self) -> Counter:
        return Counter([self])


@dataclass(frozen=True)
class Times:
    """A multiple of a term."""

    factor: float
    of: Term

    @property
    def size(self) -> int:
        return 1 + self.of.size

    @property
    def text(self) -> str:
        return f"{number(self.factor)}*{self.of.text}"

    def leaves(self) -> Counter:
        return self.of.leaves()


@dataclass(frozen=True)
class Sum:
    """A sum of terms."""

    parts: tuple[Term, ...]

    @property
    def size(self) -> int:
        return 1 + sum(p.size for p in self.parts)

    @property
    def text(self) -> str:
        return " + ".join(p.text for p in self.parts)

    def leaves(self) -> Counter:
        return sum((p.leaves() for p in self.parts), Counter())


Term = Num | Col | Fold | Times | Sum
ZERO = Num(0.0)


def is_zero(t: Term) -> bool:
    return isinstance(t, Num) and t.value == 0


@dataclass(frozen=True)
class Rule:
    binder: str
    left: Term
    op: str
    right: Term
    label: str = ""

    @property
    def length(self) -> int:
        return 1 + self.left.size + self.right.size

    @property
    def complexity(self) -> int:
        return 1 + self.length

    @property
    def law(self) -> str:
        return f"{self.left.text} {self.op} {self.right.text}"

    @property
    def text(self) -> str:
        return f"[forall {self.binder}] {self.law}"

    @property
    def signature(self) -> str:
        return f"{self.binder}::{self.law}"

    @property
    def identity(self) -> tuple:
        """What makes two rules the same; the text alone can't tell a multiple of a sum from a sum with a multiple."""
        return self.binder, self.left, self.op, self.right

    def leaf_set(self) -> frozenset:
        return frozenset(self.left.leaves()) | frozenset(self.right.leaves())


# The stored form of terms, by class: the name under "k", then field by field its key.
STORED = {
    Num: ("Const", {"value": "value"}),
    Col: ("Ref", {"role": "role"}),
    Times: ("Scale", {"factor": "coeff", "of": "term"}),
    Sum: ("Add", {"parts": "terms"}),
    Fold: ("Agg", {"kind": "kind", "family": "family_role"}),
}
# End of fixed values.
_BY_NAME = {name: (cls, keys) for cls, (name, keys) in STORED.items()}


def stored(t: Term) -> dict:
    name, keys = STORED[type(t)]
    out: dict = {"k": name}
    for attribute, key in keys.items():
        v = getattr(t, attribute)
        out[key] = [stored(x) for x in v] if attribute == "parts" else stored(v) if attribute == "of" else v
    return out


def restored(d: dict) -> Term:
    if d.get("k") not in _BY_NAME:
        raise ValueError(f"no term of kind {d.get('k')!r}")
    cls, keys = _BY_NAME[d["k"]]
    values = {a: d[key] for a, key in keys.items()}
    if cls is Sum:
        return Sum(tuple(restored(x) for x in values["parts"]))
    if cls is Times:
        return Times(float(values["factor"]), restored(values["of"]))
    return Num(float(values["value"])) if cls is Num else cls(**values)


def rule_to_dict(r: Rule) -> dict:
    return {"binder": r.binder, "op": r.op, "left": stored(r.left), "right": stored(r.right), "tag": r.label}


def rule_from_dict(d: dict) -> Rule:
    return Rule(d["binder"], restored(d["left"]), d["op"], restored(d["right"]), d.get("tag", ""))
