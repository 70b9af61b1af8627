"""Absent-value conventions: an empty string, NULL and a missing field mean the same thing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_SEPARATOR = "\u001f"


def c(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times inside ``body``.

    Filters and CASE branches do not share subexpressions, and a predicate on a computed column is inlined below it; an
    expression that reads its cleaned text ten times would clean it ten times. The lambda variable is bound once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def text(value: str | Column) -> Column:
    """NULL becomes an empty string."""
    return F.coalesce(c(value).cast("string"), F.lit(""))


def present(value: str | Column) -> Column:
    return F.length(F.trim(text(value))) > 0


def first_nonempty(*values: str | Column) -> Column:
    return F.coalesce(*[F.nullif(text(v), F.lit("")) for v in values], F.lit(""))


def joined(parts: list[str | Column], separator: str = " ") -> Column:
    """Join the non-empty parts."""
    return F.concat_ws(separator, *[F.nullif(text(p), F.lit("")) for p in parts])


def key_of(*parts: str | Column) -> Column:
    """A composite key that keeps empty parts in place."""
    return F.concat_ws(KEY_SEPARATOR, *[text(p) for p in parts])


def first_rule(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """The label of the first rule that holds."""
    (condition, label), *rest = rules
    chain = F.when(condition, F.lit(label))
    for condition, label in rest:
        chain = chain.when(condition, F.lit(label))
    return chain.otherwise(F.lit(otherwise))


def points(rules: list[tuple[Column, int]]) -> Column:
    """The sum of the points of all rules that hold."""
    total = F.lit(0)
    for condition, value in rules:
        total = total + F.when(condition, F.lit(value)).otherwise(F.lit(0))
    return total


def flags(rules: list[tuple[Column, str]]) -> Column:
    """The labels of all rules that hold, in rule order."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(label)) for condition, label in rules]))
