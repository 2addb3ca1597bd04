"""The atoms and connectives of a CHECK rule.

A condition is a small tree of frozen values: two conditions are the same if they say the
same, each renders as text, and calling one with a value column gives the Spark condition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

Predicate = Callable[[Column], Column]

_OPERATORS: dict[str, Callable[[Column, Any], Column]] = {
    "<": lambda c, x: c < x,
    ">": lambda c, x: c > x,
    "<=": lambda c, x: c <= x,
    ">=": lambda c, x: c >= x,
    "==": lambda c, x: c == x,
    "!=": lambda c, x: c != x,
}


@dataclass(frozen=True)
class Compare:
    op: str
    literal: Any

    def __call__(self, c: Column) -> Column:
        return _OPERATORS[self.op](c, self.literal)

    def __str__(self) -> str:
        return f"{self.op} {self.literal!r}"


@dataclass(frozen=True)
class OneOf:
    values: tuple

    def __call__(self, c: Column) -> Column:
        return c.isin(list(self.values))

    def __str__(self) -> str:
        return f"in ({', '.join(map(repr, self.values))})"


@dataclass(frozen=True)
class Between:
    low: Any
    high: Any

    def __call__(self, c: Column) -> Column:
        return c.between(self.low, self.high)

    def __str__(self) -> str:
        return f"between {self.low!r} and {self.high!r}"


@dataclass(frozen=True)
class Matches:
    pattern: str

    def __call__(self, c: Column) -> Column:
        return c.rlike(self.pattern)

    def __str__(self) -> str:
        return f"matches {self.pattern!r}"


@dataclass(frozen=True)
class Null:
    wanted: bool

    def __call__(self, c: Column) -> Column:
        return c.isNull() if self.wanted else c.isNotNull()

    def __str__(self) -> str:
        return "is null" if self.wanted else "is not null"


@dataclass(frozen=True)
class MaxLength:
    n: int

    def __call__(self, c: Column) -> Column:
        return F.length(c) <= self.n

    def __str__(self) -> str:
        return f"length <= {self.n}"


@dataclass(frozen=True)
class FitsDecimal:
    precision: int
    scale: int

    def __call__(self, c: Column) -> Column:
        return c.isNull() | c.try_cast(f"decimal({self.precision},{self.scale})").isNotNull()

    def __str__(self) -> str:
        return f"fits decimal({self.precision},{self.scale})"


@dataclass(frozen=True)
class All:
    tests: tuple[Predicate, ...]

    def __call__(self, c: Column) -> Column:
        out = self.tests[0](c)
        for t in self.tests[1:]:
            out = out & t(c)
        return out

    def __str__(self) -> str:
        return "(" + " and ".join(map(str, self.tests)) + ")"


@dataclass(frozen=True)
class AnyTest:
    tests: tuple[Predicate, ...]

    def __call__(self, c: Column) -> Column:
        out = self.tests[0](c)
        for t in self.tests[1:]:
            out = out | t(c)
        return out

    def __str__(self) -> str:
        return "(" + " or ".join(map(str, self.tests)) + ")"


@dataclass(frozen=True)
class Not:
    test: Predicate

    def __call__(self, c: Column) -> Column:
        return ~self.test(c)

    def __str__(self) -> str:
        return f"not {self.test}"


@dataclass(frozen=True)
class Raw:
    sql: str

    def __call__(self, c: Column) -> Column:
        return F.expr(self.sql)

    def __str__(self) -> str:
        return self.sql


def compare(op: str, literal: Any) -> Predicate:
    if op not in _OPERATORS:
        raise KeyError(op)
    return Compare(op, literal)


def one_of(values: Iterable[Any]) -> Predicate:
    return OneOf(tuple(values))


def between(low: Any, high: Any) -> Predicate:
    return Between(low, high)


def matches(pattern: str) -> Predicate:
    return Matches(pattern)


def is_null() -> Predicate:
    return Null(True)


def not_null() -> Predicate:
    return Null(False)


def max_length(n: int) -> Predicate:
    return MaxLength(n)


def fits_decimal(precision: int, scale: int) -> Predicate:
    """The value survives a cast to this decimal type; a null value passes."""
    return FitsDecimal(precision, scale)


def all_of(*tests: Predicate) -> Predicate:
    return All(tests)


def any_of(*tests: Predicate) -> Predicate:
    return AnyTest(tests)


def negate(test: Predicate) -> Predicate:
    return Not(test)


def raw(sql: str) -> Predicate:
    """SQL text over the row's columns."""
    return Raw(sql)


def violated(test: Predicate, col: Column) -> Column:
    """True where the condition is false; an unknown (null) outcome passes."""
    return ~F.coalesce(test(col), F.lit(True))
