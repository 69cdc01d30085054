"""Scan, filter, project and bind as one relation: raw columns are filtered first and bound afterwards."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.functions.fields import Record, bind, narrow
from rowsmith.operators.predicates import Predicate, compile_predicate


def as_list(where: Predicate | Iterable[Predicate] | None) -> list[Predicate]:
    return [] if where is None else [where] if isinstance(where, Predicate) else list(where)


def bind_frame(df: DataFrame, record: Record, where: Predicate | Iterable[Predicate] | None = None, null_mode: str = "zero") -> DataFrame:
    """The rows of any DataFrame that match all of `where`, as the record's columns.

    Predicates see raw values: a NULL that binds to zero doesn't match `equal(0)`, and the filter still
    reaches the scan.
    """
    if null_mode not in ("zero", "native"):
        raise ValueError(f"null_mode is 'zero' or 'native', not {null_mode!r}")
    have = {f.name: f.dataType for f in df.schema.fields}
    for p in as_list(where):
        df = df.filter(compile_predicate(p, df.schema))
    for f in record.fields:
        if f.name in have:
            narrow(f.spec, have[f.name], f.name)
    native = null_mode == "native"
    return df.select(
        *[bind(f.spec, have.get(f.name), F.col(f"`{f.name}`") if f.name in have else None, native).alias(f.name) for f in record.fields]
    )
