"""Destination fields: what a row holds, the Spark schema that reads it, and the null policy of each field.

A field that is not nullable turns NULL (or a column missing from the file) into the zero value of its
kind; a nullable field keeps NULL. `null_mode="native"` keeps NULL everywhere.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: kind: (type that the bound column has, zero value as a SQL literal)
KINDS: dict[str, tuple[T.DataType, str]] = {
    "string": (T.StringType(), "''"),
    "bool": (T.BooleanType(), "false"),
    "int8": (T.ByteType(), "0"),
    "int16": (T.ShortType(), "0"),
    "int32": (T.IntegerType(), "0"),
    "int64": (T.LongType(), "0"),
    "uint8": (T.ShortType(), "0"),
    "uint16": (T.IntegerType(), "0"),
    "uint32": (T.LongType(), "0"),
    "uint64": (T.DecimalType(20, 0), "0"),
    "float32": (T.FloatType(), "0"),
    "float64": (T.DoubleType(), "0"),
    "bytes": (T.BinaryType(), "X''"),
    "timestamp": (T.TimestampType(), "TIMESTAMP '0001-01-01 00:00:00'"),
    "timestamp_ntz": (T.TimestampNTZType(), "TIMESTAMP_NTZ '0001-01-01 00:00:00'"),
    "date": (T.DateType(), "DATE '0001-01-01'"),
}
_INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_TIMES = (T.TimestampType, T.TimestampNTZType)


@dataclass(frozen=True)
class Scalar:
    kind: str
    nullable: bool = False
    unscaled: bool = False  # an integer kind over DECIMAL takes the unscaled digits

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind!r}; kinds are {', '.join(KINDS)}")


@dataclass(frozen=True)
class ListOf:
    """A list; NULL elements are dropped unless the element is nullable."""

    element: Spec


@dataclass(frozen=True)
class MapOf:
    key: Scalar
    value: Spec


@dataclass(frozen=True)
class Struct:
    fields: tuple[Field, ...]
    nullable: bool = False

    def __init__(self, *fields: Field, nullable: bool = False) -> None:
        object.__setattr__(self, "fields", tuple(fields))
        object.__setattr__(self, "nullable", nullable)


Spec = Scalar | ListOf | MapOf | Struct


@dataclass(frozen=True)
class Field:
    name: str
    spec: Spec


class Record(Struct):
    """The destination row."""


def field(name: str, spec: Spec | str, nullable: bool = False) -> Field:
    """`field("id", "int64")`; `field("tags", ListOf(Scalar("string")))`."""
    return Field(name, Scalar(spec, nullable) if isinstance(spec, str) else spec)


def out_type(spec: Spec) -> T.DataType:
    """The type of the bound column."""
    if isinstance(spec, Scalar):
        return KINDS[spec.kind][0]
    if isinstance(spec, ListOf):
        return T.ArrayType(out_type(spec.element))
    if isinstance(spec, MapOf):
        return T.MapType(out_type(spec.key), out_type(spec.value))
    return T.StructType([T.StructField(f.name, out_type(f.spec)) for f in spec.fields])


def _scalar_fits(spec: Scalar, found: T.DataType) -> bool:
    want = KINDS[spec.kind][0]
    if spec.unscaled:
        return isinstance(found, T.DecimalType)
    if type(want) is type(found):
        return True
    if isinstance(want, _INTS) and isinstance(found, _INTS):
        return _INTS.index(type(found)) <= _INTS.index(type(want)) or isinstance(found, T.IntegerType)
    if isinstance(want, T.DecimalType):
        return isinstance(found, (*_INTS, T.DecimalType))
    if isinstance(want, T.DoubleType):
        return isinstance(found, T.FloatType)
    if isinstance(want, _TIMES):  # bare INT64 is nanoseconds
        return isinstance(found, (*_TIMES, T.LongType))
    if isinstance(want, T.DateType):
        return isinstance(found, T.IntegerType)
    return isinstance(want, T.BinaryType) and isinstance(found, T.StringType)


def narrow(spec: Spec, found: T.DataType, path: str) -> T.DataType:
    """The part of the file's type that the field needs; the narrow schema is what prunes nested leaves."""
    if isinstance(spec, Scalar):
        if not _scalar_fits(spec, found):
            raise TypeError(f"column {path}: the file has {found.simpleString()}, which doesn't bind to {spec.kind}")
        return found
    if isinstance(spec, ListOf) and isinstance(found, T.ArrayType):
        return T.ArrayType(narrow(spec.element, found.elementType, f"{path}.element"), found.containsNull)
    if isinstance(spec, MapOf) and isinstance(found, T.MapType):
        return T.MapType(
            narrow(spec.key, found.keyType, f"{path}.key"), narrow(spec.value, found.valueType, f"{path}.value"), found.valueContainsNull
        )
    if isinstance(spec, Struct) and isinstance(found, T.StructType):
        have = {f.name: f for f in found.fields}
        kept = [T.StructField(f.name, narrow(f.spec, have[f.name].dataType, f"{path}.{f.name}")) for f in spec.fields if f.name in have]
        return T.StructType(kept or found.fields[:1])
    raise TypeError(f"column {path}: the file has {found.simpleString()}, which doesn't bind to {type(spec).__name__}")


def zero(spec: Spec, native: bool = False) -> Column:
    """What a field of a missing column holds."""
    nothing = F.lit(None).cast(out_type(spec))
    if native or getattr(spec, "nullable", False):
        return nothing
    if isinstance(spec, Scalar):
        return F.expr(KINDS[spec.kind][1]).cast(out_type(spec))
    if isinstance(spec, ListOf):
        return F.array().cast(out_type(spec))
    if isinstance(spec, MapOf):
        return F.create_map().cast(out_type(spec))
    return F.struct(*[zero(f.spec).alias(f.name) for f in spec.fields])


def nanos_to_timestamp(c: Column) -> Column:
    """Floors to microseconds, exactly, before 1970 too."""
    thousand = F.lit(1000).cast("bigint")
    return F.timestamp_micros(F.call_function("div", c - F.pmod(c, thousand), thousand))


def _convert(spec: Scalar, found: T.DataType, c: Column) -> Column:
    want = KINDS[spec.kind][0]
    if spec.unscaled:
        return (c * F.lit(Decimal(10) ** found.scale)).cast(want)
    if isinstance(want, _TIMES) and isinstance(found, T.LongType):
        return nanos_to_timestamp(c).cast(want)
    if isinstance(want, T.DateType) and isinstance(found, T.IntegerType):
        return F.date_from_unix_date(c)
    return c if found == want else c.cast(want)


def bind(spec: Spec, found: T.DataType | None, c: Column | None, native: bool = False) -> Column:
    """The bound column; `found` is the type of `c`, None where the file lacks the column."""
    if found is None:
        return zero(spec, native)
    if isinstance(spec, Scalar):
        value = _convert(spec, found, c)
        return value if native or spec.nullable else F.coalesce(value, zero(spec))
    if isinstance(spec, ListOf):
        if isinstance(spec.element, Scalar) and not spec.element.nullable and not native:
            c = F.array_compact(c)
        same = found.elementType == out_type(spec.element) and (native or isinstance(spec.element, Scalar))
        value = c if same else F.transform(c, lambda x: bind(spec.element, found.elementType, x, native))
    elif isinstance(spec, MapOf):
        value = F.map_from_entries(F.map_entries(c))  # LAST_WIN among repeated keys
        if found.valueType != out_type(spec.value) or not native:
            value = F.transform_values(value, lambda _, v: bind(spec.value, found.valueType, v, native))
        if found.keyType != out_type(spec.key):
            value = F.transform_keys(value, lambda k, _: _convert(spec.key, found.keyType, k))
    else:
        have = {f.name: f.dataType for f in found.fields}
        inner = F.struct(*[bind(f.spec, have.get(f.name), c[f.name] if f.name in have else None, native).alias(f.name) for f in spec.fields])
        return F.when(c.isNotNull(), inner) if native or spec.nullable else inner
    return value if native else F.coalesce(value, zero(spec))
