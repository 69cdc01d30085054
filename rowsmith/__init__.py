"""Typed, predicate-pruned Parquet reads on Spark: declare fields, filter raw columns, bind, deliver."""

from rowsmith.functions.fields import ListOf, MapOf, Record, Scalar, Struct, field
from rowsmith.operators.predicates import And, Not, Or, col
from rowsmith.operators.relation import bind_frame
from rowsmith.session import configure, get_session
from rowsmith.sources.parquet import read, read_bytes
from rowsmith.streaming.reader import Reader, open_reader

__all__ = [
    "And", "ListOf", "MapOf", "Not", "Or", "Reader", "Record", "Scalar", "Struct",
    "bind_frame", "col", "configure", "field", "get_session", "open_reader", "read", "read_bytes",
]
