"""Rounds of questions between chunks of texts and buckets of keys.

Texts are dealt into chunks of about CHUNK_BYTES by a hash that takes in a row's place in the scan, so neither
copies nor repeated rows decide where their members go. A chunk reduces what it has to ask to distinct keys,
sorts them, and sends each bucket (a range of the key space) that has any of them one packed array; a bucket thus
hears of a key once from each chunk, however often the key occurs, and answers each chunk with an array in the
order of its question. There are never more arrays than distinct keys of chunks, whatever the number of buckets,
which have BUCKET_BYTES of text to them. The exchange of the texts by chunk is the same in every round of one
plan, so Spark writes it once and reuses it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.llm.common import total_bytes, trim, write_table

CHUNK_BYTES = 8_000_000
BUCKET_BYTES = 16_000_000
#: chunk and bucket: who asks and who answers (a negative bucket is a note of a chunk to itself); kind tells
#: several sorts of blobs apart.
ROW = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])
CHUNK = "\x1fchunk"  # a name that no column of a file has
ROW_SQL = "bucket bigint, chunk bigint, kind int, blob binary"


def dealt(docs: DataFrame, columns: list[str], chunk_bytes: int | None = None) -> tuple[DataFrame, int]:
    """The columns with `chunk_`, and the number of buckets. What comes out of an exchange is written first: only
    in a scan does a row have the same place whenever it's read."""
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = write_table(docs, "dealt")
    size = total_bytes(docs)
    n = max(1, -(-size // (chunk_bytes or CHUNK_BYTES)))
    buckets = max(1, -(-size // (chunk_bytes or BUCKET_BYTES)))
    return docs.select(*columns, F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(n)).alias(CHUNK)), buckets


def row(bucket: int, chunk: int, kind: int, blob: bytes) -> dict:
    return {"bucket": bucket, "chunk": chunk, "kind": kind, "blob": blob}


def table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=ROW)


def ask(texts: DataFrame, f: Callable[[int, pa.Table], pa.Table]) -> DataFrame:
    """First round: f(chunk, texts) makes the questions."""

    def run(key, t):
        out = f(key[0].as_py(), t)
        trim()
        return out

    return texts.groupBy(CHUNK).applyInArrow(run, ROW_SQL)


def answer(questions: DataFrame, f: Callable[[list[dict]], list[dict]]) -> DataFrame:
    """f(all rows of a bucket) makes the answers; notes pass unchanged."""

    def run(key, t):  # Spark tells the arguments by their number
        if key[0].as_py() < 0:
            return t
        out = table(f(t.to_pylist()))
        trim()
        return out

    return questions.groupBy("bucket").applyInArrow(run, ROW_SQL)


def hear(texts: DataFrame, answers: DataFrame, f: Callable[[int, pa.Table, list[dict]], pa.Table], schema) -> DataFrame:
    """f(chunk, texts, answers) for each chunk."""

    def run(key, t, a):
        out = f(key[0].as_py(), t, a.to_pylist())
        trim()
        return out

    return texts.groupBy(CHUNK).cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def in_order(t: pa.Table) -> pa.Table:
    """A chunk's texts by doc_id (null first), then text: the same order in every round."""
    return t.take(pc.sort_indices(t, sort_keys=[("doc_id", "ascending"), ("text", "ascending")], null_placement="at_start"))


def buckets_of(sorted_keys: np.ndarray, n: int) -> np.ndarray:
    """Of 64-bit keys, which of n equal ranges each is in."""
    return ((sorted_keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def parts(sorted_keys: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """Bucket, first place and end for each bucket that has any of the keys."""
    b = buckets_of(sorted_keys, n)
    first = np.flatnonzero(new_class(b)) if len(b) else np.zeros(0, np.int64)
    return list(zip(b[first].tolist(), first.tolist(), [*first[1:].tolist(), len(b)], strict=False))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, one after the other, behind the length."""
    return b"".join([np.uint32(len(arrays[0])).tobytes(), *[np.ascontiguousarray(a).tobytes() for a in arrays]])


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(blob, np.uint32, 1)[0]), 4, []
    for kind in kinds:
        out.append(np.frombuffer(blob, kind, n, at))
        at += out[-1].nbytes
    return out


def new_class(*columns: np.ndarray) -> np.ndarray:
    """Where the rows of sorted columns differ from the row before."""
    first = np.ones(len(columns[0]), bool)
    if len(first) > 1:
        first[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return first
