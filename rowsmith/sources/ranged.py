"""Parquet over a caller's ranged-read function, for stores that Hadoop has no connector for.

`read_at(offset, length) -> bytes` runs on the executors, so it must pickle. The footer is read once; one task reads one row group;
row groups that pushed comparisons exclude are not fetched, and only the leaf columns asked for are.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema

from rowsmith.functions.fields import Record
from rowsmith.operators.predicates import Predicate
from rowsmith.operators.relation import as_list, bind_frame
from rowsmith.session import configure
from rowsmith.sources.parquet import read_schema

ReadAt = Callable[[int, int], bytes]


class RangedFile(io.RawIOBase):
    """A seekable file over `read_at`."""

    def __init__(self, read_at: ReadAt, size: int) -> None:
        self.read_at, self.size, self.at = read_at, size, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = offset + (0, self.at, self.size)[whence]
        return self.at

    def read(self, n: int = -1) -> bytes:
        n = self.size - self.at if n is None or n < 0 else min(n, self.size - self.at)
        out = self.read_at(self.at, n) if n > 0 else b""
        self.at += len(out)
        return out


class Group(InputPartition):
    def __init__(self, number: int) -> None:
        self.number = number


_TESTS = {
    EqualTo: lambda lo, hi, v: lo <= v <= hi,
    GreaterThan: lambda lo, hi, v: hi > v,
    GreaterThanOrEqual: lambda lo, hi, v: hi >= v,
    LessThan: lambda lo, hi, v: lo < v,
    LessThanOrEqual: lambda lo, hi, v: lo <= v,
}


class RangedReader(DataSourceReader):
    def __init__(self, read_at: ReadAt, size: int, meta: pq.FileMetaData, schema: pa.Schema, leaves: list[str]) -> None:
        self.read_at, self.size, self.meta, self.schema, self.leaves = read_at, size, meta, schema, leaves
        self.tests: list[tuple[str, Callable, object]] = []

    def pushFilters(self, filters):
        """Used to skip row groups; Spark still tests every row."""
        for f in filters:
            if type(f) in _TESTS:
                self.tests.append((".".join(f.attribute), _TESTS[type(f)], f.value))
            elif isinstance(f, In):
                self.tests.append((".".join(f.attribute), lambda lo, hi, v: any(lo <= x <= hi for x in v), f.value))
            yield f

    def partitions(self) -> list[Group]:
        return [Group(g) for g in range(self.meta.num_row_groups) if self._may_match(self.meta.row_group(g))] or [Group(-1)]

    def _may_match(self, group) -> bool:
        stats = {group.column(i).path_in_schema: group.column(i).statistics for i in range(group.num_columns)}
        for name, may, v in self.tests:
            s = stats.get(name)
            try:
                if s is not None and s.has_min_max and not may(s.min, s.max, v):
                    return False
            except TypeError:
                continue
        return True

    def read(self, partition: Group) -> Iterator:
        if partition.number >= 0:
            file = pq.ParquetFile(RangedFile(self.read_at, self.size), metadata=self.meta)
            for batch in file.read_row_group(partition.number, columns=self.leaves).to_batches():
                yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type, safe=False) for f in self.schema], schema=self.schema)


def _narrowed(have: pa.DataType, want: T.DataType) -> pa.DataType:
    """An Arrow type without the struct fields that the Spark type lacks."""
    if isinstance(want, T.StructType):
        return pa.struct([pa.field(f.name, _narrowed(have.field(f.name).type, f.dataType)) for f in want.fields])
    if isinstance(want, T.ArrayType):
        return pa.list_(_narrowed(have.value_type, want.elementType))
    if isinstance(want, T.MapType):
        return pa.map_(_narrowed(have.key_type, want.keyType), _narrowed(have.item_type, want.valueType))
    return have


_WIDER = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0)}


def _plain(kind: pa.DataType) -> pa.DataType:
    """The type that Spark's own reader gives: nanoseconds are cut to microseconds, unsigned numbers widened."""
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, _plain(f.type)) for f in kind])
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        return pa.list_(_plain(kind.value_type))
    if pa.types.is_map(kind):
        return pa.map_(_plain(kind.key_type), _plain(kind.item_type))
    if pa.types.is_timestamp(kind) and kind.unit == "ns":
        return pa.timestamp("us", kind.tz)
    return _WIDER.get(kind, kind)


def _leaves(file: pq.ParquetFile, schema: pa.Schema) -> list[str]:
    """The file's leaf paths under the schema's fields; list and map levels between are left out when comparing."""
    wanted = set()

    def walk(at: str, kind: pa.DataType) -> None:
        if pa.types.is_struct(kind):
            for f in kind:
                walk(f"{at}.{f.name}", f.type)
        elif pa.types.is_list(kind):
            walk(at, kind.value_type)
        elif pa.types.is_map(kind):
            walk(f"{at}.key", kind.key_type)
            walk(f"{at}.value", kind.item_type)
        else:
            wanted.add(at)

    for f in schema:
        walk(f.name, f.type)
    paths = [file.metadata.schema.column(i).path for i in range(len(file.metadata.schema))]
    between = re.compile(r"\.(list|bag|key_value|map)\.(element|item|array_element|array)?\.?|\.array(?=\.|$)")
    plain = lambda p: between.sub(".", p).rstrip(".")
    return [p for p in paths if p in wanted or plain(p) in wanted]


def read_ranged(spark: SparkSession, read_at: ReadAt, size: int, record: Record | list[str] | None = None, where: Predicate | Iterable[Predicate] | None = None, null_mode: str = "zero") -> DataFrame:
    """The file that `read_at` serves, as the columns of a record with predicates, as `read` has them; or its raw
    columns, all or those named."""
    configure(spark)
    preds = as_list(where)
    file = pq.ParquetFile(RangedFile(read_at, size))
    arrow = file.schema_arrow
    arrow = pa.schema([pa.field(f.name, _plain(f.type)) for f in arrow])
    whole = from_arrow_schema(arrow)
    if isinstance(record, Record):
        schema = read_schema(whole, record, preds)
    else:
        schema = T.StructType([whole[n] for n in record or whole.names])
    own = pa.schema([pa.field(f.name, _narrowed(arrow.field(f.name).type, f.dataType)) for f in schema.fields])
    leaves, meta = _leaves(file, own), file.metadata
    label = f"ranged_{uuid.uuid4().hex}"

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return label

        def schema(self):
            return schema

        def reader(self, schema):
            return RangedReader(read_at, size, meta, own, leaves)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Source)
    df = spark.read.format(label).load()
    return bind_frame(df, record, preds, null_mode) if isinstance(record, Record) else df
