"""Typed predicates, what buckets they allow, and how they are read back from an optimized plan.

Only what surely narrows is used: a conjunct, or a disjunction whose branches
all narrow one dimension. Everything else leaves a dimension open, so pruning
never loses a row; the exact filter always runs on what is read.
"""

from __future__ import annotations

import datetime
import decimal
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from skiplane.functions import routing
from skiplane.operators.layout import BUCKETS, Layout


INTEGERS = ("tinyint", "smallint", "int", "bigint")
#: Day 0 of Spark's dates, as Python counts.
EPOCH = datetime.date(1970, 1, 1).toordinal()


@dataclass(frozen=True)
class Values:
    """One of these values."""

    values: tuple


@dataclass(frozen=True)
class Range:
    """Between two ends; None is open."""

    low: float | None = None
    high: float | None = None
    low_strict: bool = False
    high_strict: bool = False


def numeric(kind: str) -> bool:
    return kind in INTEGERS or kind in ("float", "double") or kind.startswith("decimal")


def narrows(value: Any, dimension: str, kind: str) -> bool:
    """Whether all rows of a column of type ``kind`` that equal the value have its bucket. Text is hashed as it is, integers, dates and booleans in the one form they have; other types have several, and leave the dimension open."""
    if dimension == routing.MAGNITUDE:
        return numeric(kind) and isinstance(value, (int, float, decimal.Decimal)) and not isinstance(value, bool)
    own = {"string": str, "date": datetime.date, "boolean": bool} | dict.fromkeys(INTEGERS, int)
    return kind in own and type(value) is own[kind]


def _tighter(a: float | None, a_strict: bool, b: float | None, b_strict: bool, pick: Any) -> tuple[float | None, bool]:
    if a is None or b is None:
        return (b, b_strict) if a is None else (a, a_strict)
    return (a, a_strict or b_strict) if a == b else (a, a_strict) if pick(a, b) == a else (b, b_strict)


def _both(a: Range, b: Range) -> Range:
    low, low_strict = _tighter(a.low, a.low_strict, b.low, b.low_strict, max)
    high, high_strict = _tighter(a.high, a.high_strict, b.high, b.high_strict, min)
    return Range(low, high, low_strict, high_strict)


@dataclass
class Predicate:
    """Conditions by column; all hold."""

    conditions: dict[str, list[Values | Range]] = field(default_factory=dict)

    def where(self, column: str, condition: Values | Range) -> Predicate:
        self.conditions.setdefault(column, []).append(condition)
        return self

    def eq(self, column: str, *values: Any) -> Predicate:
        return self.where(column, Values(values))

    def between(self, column: str, low: float | None = None, high: float | None = None) -> Predicate:
        return self.where(column, Range(low, high))

    def above(self, column: str, low: float) -> Predicate:
        return self.where(column, Range(low=low, low_strict=True))

    def below(self, column: str, high: float) -> Predicate:
        return self.where(column, Range(high=high, high_strict=True))

    def of(self, column: str) -> list[Values | Range]:
        return self.conditions.get(column, [])

    def column(self) -> Column:
        """The exact filter. NaN is in no range."""
        out = F.lit(True)
        for name, conditions in self.conditions.items():
            c = F.col(f"`{name}`")
            for x in conditions:
                if isinstance(x, Values):
                    out = out & c.isin(*x.values)
                else:
                    if x.low is not None:
                        out = out & ((c > x.low) if x.low_strict else (c >= x.low)) & ~F.isnan(c.cast("double"))
                    if x.high is not None:
                        out = out & ((c < x.high) if x.high_strict else (c <= x.high))
        return out

    def values(self, column: str) -> list:
        """All values that equalities name for a column."""
        return [v for x in self.of(column) if isinstance(x, Values) for v in x.values]

    def range(self, column: str) -> Range | None:
        """The narrowest range that all ranges of a column make together."""
        out = None
        for x in self.of(column):
            if isinstance(x, Range):
                out = x if out is None else _both(out, x)
        return out

    def buckets(self, layout: Layout, kinds: dict[str, str]) -> dict[str, list[int] | None]:
        """Allowed buckets of each bucket column; None: all. ``kinds``: types of the table's columns.

        A range never narrows a hash dimension, and values narrow only where
        they are sure to have the bucket of the rows that equal them (``narrows``).
        """
        out: dict[str, list[int] | None] = {}
        for name, dim in zip(BUCKETS, layout.dimensions, strict=False):
            allowed: set[int] | None = None
            for x in self.of(dim.name):
                if isinstance(x, Values):
                    known = [v for v in x.values if v is not None]
                    if not all(narrows(v, dim.kind, kinds.get(dim.name, "")) for v in known):
                        continue
                    some = {routing.bucket_of(v, dim.kind, dim.buckets) for v in known}
                elif dim.kind == routing.MAGNITUDE and (numeric(kinds.get(dim.name, "")) or kinds.get(dim.name) == "string"):
                    some = set(routing.range_buckets(x.low, x.high, dim.buckets))
                else:
                    continue
                allowed = some if allowed is None else allowed & some
            out[name] = None if allowed is None else sorted(allowed)
        return out


def _value(kind: str, value: Any) -> tuple[bool, Any]:
    """What Catalyst holds for a value of a type, as Python's; not known for types that have no single form."""
    if kind in INTEGERS:
        return True, int(value)
    if kind in ("float", "double"):
        return True, float(value)
    if kind.startswith("decimal"):
        return True, decimal.Decimal(value.toString() if hasattr(value, "toString") else str(value))
    if kind == "boolean":
        return True, bool(value)
    if kind == "date" and 1 <= EPOCH + int(value) <= datetime.date.max.toordinal():
        return True, datetime.date.fromordinal(EPOCH + int(value))
    return (True, value if isinstance(value, str) else value.toString()) if kind == "string" else (False, None)


def _literal(e: Any) -> tuple[bool, Any]:
    if e.getClass().getSimpleName() != "Literal" or e.value() is None:
        return False, None
    return _value(e.dataType().simpleString(), e.value())


def _attribute(e: Any) -> str | None:
    return e.name() if e.getClass().getSimpleName() == "AttributeReference" else None


_RANGES = {"GreaterThan": ("low", True), "GreaterThanOrEqual": ("low", False), "LessThan": ("high", True), "LessThanOrEqual": ("high", False)}
_FLIPPED = {"GreaterThan": "LessThan", "GreaterThanOrEqual": "LessThanOrEqual", "LessThan": "GreaterThan", "LessThanOrEqual": "GreaterThanOrEqual"}


def read_condition(e: Any, out: Predicate) -> None:
    """Adds what a Catalyst condition surely demands of single columns."""
    kind = e.getClass().getSimpleName()
    if kind == "And":
        read_condition(e.left(), out)
        read_condition(e.right(), out)
    elif kind == "Or":
        sides = [Predicate(), Predicate()]
        read_condition(e.left(), sides[0])
        read_condition(e.right(), sides[1])
        for name in set(sides[0].conditions) & set(sides[1].conditions):
            both = [next((x for x in s.of(name) if isinstance(x, Values)), None) for s in sides]
            if all(both):
                out.eq(name, *both[0].values, *both[1].values)  # type: ignore[union-attr]
    elif kind in ("EqualTo", "EqualNullSafe", *_RANGES):
        left, right = e.left(), e.right()
        if _attribute(left) is None:
            left, right, kind = right, left, _FLIPPED.get(kind, kind)
        name, (known, value) = _attribute(left), _literal(right)
        if name is None or not known:
            return
        if kind.startswith("Equal"):
            out.eq(name, value)
        elif isinstance(value, (int, float, decimal.Decimal)) and not isinstance(value, bool):
            value = float(value) if isinstance(value, decimal.Decimal) else value
            end, strict = _RANGES[kind]
            out.where(name, Range(low=value, low_strict=strict) if end == "low" else Range(high=value, high_strict=strict))
    elif kind == "In":
        name, items = _attribute(e.value()), [e.list().apply(i) for i in range(e.list().size())]
        read = [_literal(i) for i in items]
        if name is not None and all(k for k, _ in read):
            out.eq(name, *[v for _, v in read])
    elif kind == "InSet":
        name, it, type_, read = _attribute(e.child()), e.hset().iterator(), e.child().dataType().simpleString(), []
        while it.hasNext():
            value = it.next()
            read.append((True, None) if value is None else _value(type_, value))
        if name is not None and all(k for k, _ in read):
            out.eq(name, *[v for _, v in read])


def read_plan(plan: Any, paths: dict[str, str]) -> dict[str, Predicate | None]:
    """Predicates by table from an optimized plan; ``paths`` gives each table's data folder. A table that is read twice, or without a filter, has None."""
    out: dict[str, Predicate | None] = {}
    seen: dict[str, int] = {}

    def table(node: Any) -> str | None:
        if node.getClass().getSimpleName() != "LogicalRelation":
            return None
        text = node.relation().location().rootPaths().mkString("\n") if hasattr(node.relation(), "location") else ""
        return next((name for name, path in paths.items() if f"{path.rstrip('/').removeprefix('file://')}/" in f"{text}/"), None)

    def walk(node: Any, condition: Any) -> None:
        kind = node.getClass().getSimpleName()
        name = table(node)
        if name is not None:
            seen[name] = seen.get(name, 0) + 1
            if condition is not None:
                out[name] = Predicate()
                read_condition(condition, out[name])
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i), node.condition() if kind == "Filter" else None)

    walk(plan, None)
    return {name: out.get(name) if n == 1 else None for name, n in seen.items()}
