"""The same typed relation over a growing folder, as Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from rowsmith.functions.fields import Record
from rowsmith.operators.predicates import Predicate
from rowsmith.operators.relation import as_list, bind_frame
from rowsmith.session import configure
from rowsmith.sources.parquet import file_schema, read_schema


def read_stream(spark: SparkSession, folder: str, record: Record, where: Predicate | Iterable[Predicate] | None = None, max_files: int = 100, null_mode: str = "zero") -> DataFrame:
    """New Parquet files of a folder as a streaming DataFrame, `max_files` to a micro-batch. The columns are those
    of all files that stand there at the start; later files may lack some but not change a type."""
    file = file_schema(configure(spark).read, [folder])
    if file is None:
        raise TypeError(f"the files of {folder} give a column different types")
    schema = read_schema(file, record, as_list(where))
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)
    return bind_frame(df, record, where, null_mode)
