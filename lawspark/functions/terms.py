"""Terms of the rule language as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.rules import Col, Fold, Num, Sum, Term, Times


def folded(kind: str, columns: Sequence[Column]) -> Column:
    """The aggregate of columns, row by row, left to right; null as soon as one is null."""
    cells = F.array(*columns)
    if kind == "SUM":
        return F.aggregate(cells, F.lit(0.0), lambda a, x: a + x)
    if kind == "AVG":
        return F.aggregate(cells, F.lit(0.0), lambda a, x: a + x) / len(columns)
    whole = F.forall(cells, lambda x: x.isNotNull())
    if kind == "MIN":
        return F.when(whole, F.array_min(cells))
    if kind == "MAX":
        return F.when(whole, F.array_max(cells))
    raise ValueError(f"no aggregate {kind!r}")


def term(t: Term, leaf: Callable[[Term], Column]) -> Column:
    """The Column of a term, given the Columns of its leaves."""
    match t:
        case Num(value):
            return F.lit(float(value))
        case Times(factor, of):
            return F.lit(float(factor)) * term(of, leaf)
        case Sum(parts):
            return reduce(lambda a, b: a + b, (term(p, leaf) for p in parts), F.lit(0.0))
        case Col() | Fold():
            return leaf(t)
    raise TypeError(f"no term: {t!r}")


def term_text(t: Term, leaf: Callable[[Term], str]) -> str:
    """The same as SQL, given the names of its leaves: thousands of terms reach the JVM in one call."""
    match t:
        case Num(value):
            return f"double('{float(value)!r}')"
        case Times(factor, of):
            return f"(double('{float(factor)!r}') * {term_text(of, leaf)})"
        case Sum(parts):
            return "(" + " + ".join(["0.0D", *(term_text(p, leaf) for p in parts)]) + ")"
        case Col() | Fold():
            return leaf(t)
    raise TypeError(f"no term: {t!r}")


def sum_of_present(columns: Sequence[str], present: Sequence[str]) -> Column:
    """The sum of those columns that exist; zero without any."""
    found = [F.col(f"`{c}`") for c in columns if c in set(present)]
    return folded("SUM", found) if found else F.lit(0.0)
