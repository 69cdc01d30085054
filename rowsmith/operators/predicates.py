"""Predicates over raw columns: leaf comparisons joined by And, Or and Not.

A NULL never matches a leaf, and Not is the complement of each leaf, so it doesn't match NULL either. NaN
matches only `ne`. Literals are checked against the file's column type and cast to it, so the comparison
stays on the raw column and reaches the Parquet scan. On a list the first element is tested.
"""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FLIP = {"eq": "ne", "ne": "eq", "lt": "ge", "ge": "lt", "gt": "le", "le": "gt"}
_RANGE = {"ByteType": 7, "ShortType": 15, "IntegerType": 31, "LongType": 63}


class Predicate:
    def __and__(self, other: Predicate) -> Predicate:
        return And(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return Or(self, other)

    def __invert__(self) -> Predicate:
        return Not(self)


@dataclass(frozen=True)
class Leaf(Predicate):
    op: str
    path: tuple[str, ...]
    values: tuple[Any, ...]


@dataclass(frozen=True)
class Combined(Predicate):
    every: bool
    parts: tuple[Predicate, ...]


@dataclass(frozen=True)
class Negated(Predicate):
    part: Predicate


def And(*parts: Predicate) -> Predicate:
    """True where all parts are; with no part, everywhere."""
    return Combined(True, parts)


def Or(*parts: Predicate) -> Predicate:
    """True where any part is; with no part, nowhere."""
    return Combined(False, parts)


def Not(part: Predicate) -> Predicate:
    return Negated(part)


@dataclass(frozen=True)
class ColRef:
    path: tuple[str, ...]

    def equal(self, v: Any) -> Predicate:
        return Leaf("eq", self.path, (v,))

    def not_equal(self, v: Any) -> Predicate:
        return Leaf("ne", self.path, (v,))

    def less(self, v: Any) -> Predicate:
        return Leaf("lt", self.path, (v,))

    def less_or_equal(self, v: Any) -> Predicate:
        return Leaf("le", self.path, (v,))

    def greater(self, v: Any) -> Predicate:
        return Leaf("gt", self.path, (v,))

    def greater_or_equal(self, v: Any) -> Predicate:
        return Leaf("ge", self.path, (v,))

    def between(self, lo: Any, hi: Any) -> Predicate:
        return Leaf("between", self.path, (lo, hi))

    def isin(self, *values: Any) -> Predicate:
        return Leaf("in", self.path, values)


def col(*path: str) -> ColRef:
    """`col("stats", "p99")` names a nested column; it need not be among the fields read."""
    return ColRef(path)


def columns(p: Predicate) -> set[tuple[str, ...]]:
    """Paths that a predicate reads."""
    if isinstance(p, Leaf):
        return {p.path}
    if isinstance(p, Negated):
        return columns(p.part)
    return set().union(*map(columns, p.parts)) if p.parts else set()


def _resolve(schema: T.StructType, path: tuple[str, ...]) -> tuple[Column, T.DataType]:
    at: T.DataType = schema
    c: Column | None = None
    for name in path:
        found = {f.name: f.dataType for f in at.fields} if isinstance(at, T.StructType) else {}
        if name not in found:
            raise ValueError(f"predicate column {'.'.join(path)} is not in the file")
        at, c = found[name], F.col(f"`{name}`") if c is None else c[name]
    if c is None:
        raise ValueError("a predicate needs a column")
    if isinstance(at, T.ArrayType):
        return F.get(c, F.lit(0)), at.elementType
    return c, at


def _whole(v: Any) -> bool:
    return isinstance(v, int) and not isinstance(v, bool)


def _literal(v: Any, kind: T.DataType, path: tuple[str, ...]) -> Column:
    """The literal in the column's type; a literal of another kind is an error that names the column."""
    name = type(kind).__name__
    if name in _RANGE:
        if isinstance(v, dt.datetime) and name == "LongType":  # nanoseconds
            v = v if v.tzinfo else v.replace(tzinfo=dt.UTC)
            return F.lit((v - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(microseconds=1) * 1000).cast("bigint")
        if _whole(v):
            fits = -(2 ** _RANGE[name]) <= v < 2 ** _RANGE[name]
            return F.lit(v).cast(kind) if fits else F.lit(Decimal(v)).cast(T.DecimalType(38, 0))
    elif name in ("FloatType", "DoubleType"):
        if _whole(v) or isinstance(v, float):
            if math.isnan(v):
                raise ValueError(f"predicate column {'.'.join(path)}: NaN is not a literal")
            return F.lit(float(v)).cast(kind)
    elif name == "DecimalType":
        if _whole(v) or isinstance(v, Decimal):
            return F.lit(Decimal(v)).cast(kind)
    elif name == "BooleanType":
        if isinstance(v, bool):
            return F.lit(v)
    elif name in ("StringType", "BinaryType"):
        if isinstance(v, (str, bytes, bytearray)):
            as_text = v if isinstance(v, str) else bytes(v).decode()
            return F.lit(as_text) if name == "StringType" else F.lit(bytearray(as_text.encode()))
    elif name in ("TimestampType", "TimestampNTZType"):
        if isinstance(v, dt.datetime):
            utc = v.astimezone(dt.UTC).replace(tzinfo=None) if v.tzinfo else v
            return F.expr(f"TIMESTAMP_NTZ '{utc.isoformat(sep=' ')}'").cast(kind)
    elif name == "DateType":
        if isinstance(v, dt.datetime):
            return F.expr(f"TIMESTAMP_NTZ '{v.replace(tzinfo=None).isoformat(sep=' ')}'")
        if isinstance(v, dt.date):
            return F.lit(v)
    raise TypeError(f"predicate column {'.'.join(path)}: {v!r} doesn't compare with {kind.simpleString()}")


def compile_predicate(p: Predicate, schema: T.StructType, negate: bool = False) -> Column:
    """A Column; negation is pushed to the leaves first, so the NaN guard sits on the leaf that needs it."""
    if isinstance(p, Negated):
        return compile_predicate(p.part, schema, not negate)
    if isinstance(p, Combined):
        parts = [compile_predicate(x, schema, negate) for x in p.parts]
        every = p.every != negate
        if not parts:
            return F.lit(every)
        return reduce(lambda a, b: a & b if every else a | b, parts)
    if not isinstance(p, Leaf):
        raise TypeError(f"not a predicate: {p!r}")
    c, kind = _resolve(schema, p.path)
    values = [_literal(v, kind, p.path) for v in p.values]
    if p.op == "in":
        if not values:
            return F.lit(negate)
        return ~c.isin(*values) if negate else c.isin(*values)
    if p.op == "between":
        lo, hi = p.values
        if negate:
            return compile_predicate(Leaf("lt", p.path, (lo,)), schema) | compile_predicate(Leaf("gt", p.path, (hi,)), schema)
        return c.between(*values)
    op, v = _FLIP[p.op] if negate else p.op, values[0]
    out = {"eq": c == v, "ne": c != v, "lt": c < v, "le": c <= v, "gt": c > v, "ge": c >= v}[op]
    guarded = op in ("gt", "ge") and isinstance(kind, (T.FloatType, T.DoubleType))
    return out & ~F.isnan(c) if guarded else out
