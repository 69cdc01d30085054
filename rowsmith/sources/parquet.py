"""Parquet as typed rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsmith.functions.fields import Record, narrow
from rowsmith.operators.predicates import Predicate, columns
from rowsmith.operators.relation import as_list, bind_frame
from rowsmith.session import configure, scratch_dir, with_knobs


def read_schema(file: T.StructType, record: Record, where: list[Predicate]) -> T.StructType:
    """The file's schema narrowed to the destination and the predicates' columns."""
    wanted = {f.name: f.spec for f in record.fields}
    tested: dict[str, list[tuple[str, ...]]] = {}
    for path in set().union(*map(columns, where)) if where else ():
        tested.setdefault(path[0], []).append(path)
    out = []
    for f in file.fields:
        kind = narrow(wanted[f.name], f.dataType, f.name) if f.name in wanted else None
        for path in tested.get(f.name, []):
            kind = _with_path(kind, f.dataType, path[1:])
        if kind is not None:
            out.append(T.StructField(f.name, kind))
    return T.StructType(out)


def _with_path(have: T.DataType | None, file: T.DataType, path: tuple[str, ...]) -> T.DataType:
    """`have` with the leaf that a predicate names added."""
    if not path or not isinstance(file, T.StructType):
        return file if have is None or not isinstance(file, T.StructType) else have
    kept = {f.name: f.dataType for f in have.fields} if have is not None else {}
    found = {f.name: f.dataType for f in file.fields}
    if path[0] in found:
        kept[path[0]] = _with_path(kept.get(path[0]), found[path[0]], path[1:])
    return T.StructType([T.StructField(n, kept[n]) for n in found if n in kept])


def file_schema(reader, paths: list[str]) -> T.StructType | None:
    """The columns of all the files' footers, which tasks read; None where files disagree on a column's type."""
    try:
        return reader.option("mergeSchema", "true").parquet(*paths).schema
    except Exception as e:
        if "CANNOT_MERGE" in str(e) or "merge schema" in str(e).lower() or "Failed merging schema" in str(e):
            return None
        raise


def _files(reader, paths: list[str], schema: T.StructType) -> list[str]:
    """The files of each path in order of their names, path by path."""
    return [f for p in paths for f in sorted(reader.schema(schema).parquet(p).inputFiles())]


def read(
    spark: SparkSession,
    path: str | list[str],
    record: Record,
    where: Predicate | Iterable[Predicate] | None = None,
    *,
    null_mode: str = "zero",
    ordered: bool = False,
    project: bool = True,
    options: Mapping[str, str] | None = None,
    concurrency: int | None = None,
    batch_rows: int | None = None,
) -> DataFrame:
    """Rows of one or many Parquet files as the record's columns.

    A column that only some files have is read from those; where a file lacks it, rows hold the field's zero
    value (NULL if nullable), and a predicate doesn't match them. A column that no file has is zero everywhere,
    and a predicate on it an error. Files that give a column different types are bound one by one; a type that
    doesn't bind raises TypeError.

    `ordered` puts partitions in the order of the files (path by path, then by name) and of the rows in them:
    splits of a file already stand so, and files are joined one behind the other, so nothing is sorted or
    shuffled. `project=False` reads all columns (for comparison only). `options` go to Spark's reader,
    `concurrency` and `batch_rows` are those of `with_knobs`.
    """
    spark = with_knobs(spark, concurrency, batch_rows)
    preds = as_list(where)
    paths = [path] if isinstance(path, str) else list(path)
    reader = lambda: spark.read.options(**dict(options or {}))
    file = file_schema(reader(), paths)
    if file is None:
        parts = [(f, reader().parquet(f).schema) for f in _files(reader(), paths, T.StructType())]
        frames = [_scan(reader(), [f], _with_missing(schema, preds, [s for _, s in parts]), record, preds, null_mode, project) for f, schema in parts]
    elif ordered and len(files := _files(reader(), paths, file)) > 1:
        frames = [_scan(reader(), [f], file, record, preds, null_mode, project) for f in files]
    else:
        return _scan(reader(), paths, file, record, preds, null_mode, project)
    return reduce(DataFrame.unionAll, frames)


def _scan(reader, paths: list[str], file: T.StructType, record: Record, preds: list[Predicate], null_mode: str, project: bool) -> DataFrame:
    df = reader.schema(read_schema(file, record, preds) if project else file).parquet(*paths)
    return bind_frame(df, record, preds, null_mode)


def _with_missing(schema: T.StructType, preds: list[Predicate], others: list[T.StructType]) -> T.StructType:
    """A file's schema with the predicates' columns that it lacks but other files have; they are NULL there."""
    have = set(schema.names)
    for name in {p[0] for p in set().union(*map(columns, preds))} - have if preds else ():
        found = next((s[name] for s in others if name in s.names), None)
        schema = T.StructType([*schema.fields, found]) if found else schema
    return schema


def read_bytes(spark: SparkSession, data: bytes, record: Record, where: Predicate | Iterable[Predicate] | None = None, **kwargs) -> DataFrame:
    """A Parquet file held in memory: it is spooled to the shared scratch folder, which executors see."""
    path = f"{scratch_dir(spark)}/spool-{uuid.uuid4().hex}.parquet"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return read(spark, path, record, where, **kwargs)


@dataclass(frozen=True)
class Footer:
    """What a file's footer says."""

    rows: int
    row_groups: list[int]  # rows of each
    metadata: dict[str, str]  # of the writer
    created_by: str
    schema: str  # Parquet's own notation


def footer(spark: SparkSession, path: str) -> Footer:
    """The footer of one file, read on the driver from any file system that Spark knows."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    file = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), conf)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file)
    try:
        found = reader.getFooter()
        groups = [b.getRowCount() for b in found.getBlocks()]
        meta = found.getFileMetaData()
        return Footer(sum(groups), groups, dict(meta.getKeyValueMetaData()), meta.getCreatedBy() or "", meta.getSchema().toString())
    finally:
        reader.close()


def row_count(spark: SparkSession, path: str) -> int:
    """From footers alone."""
    return spark.read.parquet(path).count()


def locate_rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Columns with `row_index`, the position of the row in its file."""
    return configure(spark).read.parquet(path).select(*columns, F.col("_metadata.row_index").alias("row_index"))
