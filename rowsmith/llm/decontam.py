"""Operator 4, benchmark decontamination: a prefix-filtered containment join over item-sized windows.

A window is WINDOW consecutive words of a benchmark item (a shorter item is one window). For a text to hold a
window it must hold every shingle of it, so one shingle, the rarest, is a sufficient prefix: shingles of all
windows are ordered by the number of texts that have them (counted over the whole corpus; ties by hash), and
each window is filed under its first. Texts' shingles join that file; where one meets, the window's place in the
text follows from the shingle's place in the window, windows that would stick out at either end fall (positional
and length bounds), and the words in between are compared exactly.

The texts are read twice, to count and to find, and don't move: a bitmap of fixed size, whatever the size of
the benchmark, leaves out most shingles that no window has; what passes is sent with the words around it to the
join, so the exact comparison needs no text. Windows, counts, items and hits are tables; nothing is collected
but the bitmap. Up to FEW windows are broadcast, more are joined by a shuffle of the shingles that met.

Defined cases: null or empty texts have no words; items without words have no window; equal windows of several
items count for each; a null item_id counts as an empty one; repeated rows each get a row; other columns are
ignored (`clean` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.llm.common import Bitmap, freed, raw, slices, write_table

WINDOW = 10
SHINGLE = 3
FEW = 100_000  # windows, or keys of texts, that are broadcast

_WORD = frozenset([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _WORD else 32 for c in range(256))


def normal(text: bytes | None) -> bytes:
    """Lower-cased words joined by one space."""
    return b" ".join((text or b"").translate(TABLE).split())


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(28))


class Texts:
    """Words of some texts in a row, with a hash of each; `n` words to a text, the first at `first`."""

    def __init__(self, texts: list[bytes | None]) -> None:
        joined = [normal(t) for t in texts]
        self.data = b" ".join([j for j in joined if j])
        self.n = np.array([j.count(b" ") + 1 if j else 0 for j in joined], np.int64)
        self.first = np.cumsum(self.n) - self.n
        self.owner = np.repeat(np.arange(len(texts)), self.n)
        if not self.data:
            self.start = self.end = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            return
        data = np.frombuffer(self.data, np.uint8)
        gaps = np.flatnonzero(data == 32)
        self.start, self.end = np.r_[0, gaps + 1], np.r_[gaps, len(data)]
        size = np.diff(np.r_[self.start, len(data) + 1])  # with the gap behind
        place = np.arange(len(data) + 1) - np.repeat(self.start, size)
        power = np.cumprod(np.full(int(size.max()), 0x9E3779B97F4A7C15, np.uint64))
        value = (data.astype(np.uint64) + np.uint64(1)) * power[place[:-1]]
        value[gaps] = 0
        self.hash = _mixed(np.add.reduceat(value, self.start))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of all runs of k words within a text, and their hashes."""
        at = np.arange(len(self.hash) - k + 1) if len(self.hash) >= k else np.zeros(0, np.int64)
        at = at[self.owner[at] == self.owner[at + k - 1]]
        h = np.full(len(at), k, np.uint64)
        for i in range(k):
            h = _mixed(h * np.uint64(0xD6E8FEB86659FD93) + self.hash[at + i])
        return at, h

    def words(self, first: int, upto: int) -> str:
        return self.data[self.start[first] : self.end[upto - 1]].decode()


def windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """item, w (the window's words), n (how many), grams (hashes of its shingles) of every window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                t = Texts(raw(part.column("text")))
                out = []
                for i, item in enumerate(part.column("item").to_pylist()):
                    n = min(int(t.n[i]), window)
                    for at in range(int(t.first[i]), int(t.first[i] + t.n[i]) - n + 1) if n else ():
                        out.append((item, at, n))
                grams = {k: dict(zip(*(x.tolist() for x in (at, h.view(np.int64))), strict=True)) for k in range(1, shingle + 1) for at, h in [t.shingles(k)]}
                rows = [{"item": item, "w": t.words(at, at + n), "n": n, "grams": [grams[k][at + j] for k in [min(shingle, n)] for j in range(n - k + 1)]} for item, at, n in out]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("item", pa.string()), ("w", pa.string()), ("n", pa.int32()), ("grams", pa.list_(pa.int64()))])
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return items.mapInArrow(freed(run), "item string, w string, n int, grams array<bigint>")


def _counted(docs: DataFrame, some: Bitmap, ks: list[int]) -> DataFrame:
    """g, texts: how many texts have a shingle, of those that may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                t = Texts(raw(part.column("text")))
                for k in ks:
                    at, h = t.shingles(k)
                    ok = some.may(h)
                    own, h = t.owner[at[ok]], h[ok]
                    order = np.lexsort((h, own))
                    own, h = own[order], h[order]
                    first = np.ones(len(h), bool)
                    first[1:] = (own[1:] != own[:-1]) | (h[1:] != h[:-1])
                    value, n = np.unique(h[first], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], names=["g", "texts"])

    return docs.select("text").mapInArrow(freed(run), "g bigint, texts bigint").groupBy("g").agg(F.sum("texts").alias("texts"))


_KEY = ["k1", "k2"]


def _keyed(docs: DataFrame) -> DataFrame:
    """With a key of 128 bits; rows that share it have the same result."""
    return docs.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64("text", F.lit(1), "doc_id")})


def _found(docs: DataFrame, some: Bitmap, ks: list[int], window: int) -> DataFrame:
    """doc_id, key, n_words and found (shingles that may be a window's prefix, with the words around) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                t = Texts(raw(part.column("text")))
                found: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for k in ks:
                    at, h = t.shingles(k)
                    ok = some.may(h)
                    for i, g in zip(at[ok].tolist(), h[ok].view(np.int64).tolist(), strict=True):
                        own = int(t.owner[i])
                        first, n = int(t.first[own]), int(t.n[own])
                        lo, hi = max(first, i - window + k), min(first + n, i + window)
                        found[own].append({"g": g, "place": i - first, "lead": i - lo, "around": t.words(lo, hi)})
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("k1"), part.column("k2"), pa.array(t.n), pa.array(found, kind)], names=["doc_id", "k1", "k2", "n_words", "found"])

    kind = pa.list_(pa.struct([("g", pa.int64()), ("place", pa.int64()), ("lead", pa.int32()), ("around", pa.string())]))
    return _keyed(docs.select("doc_id", "text")).mapInArrow(freed(run), f"doc_id {dict(docs.dtypes)['doc_id']}, k1 bigint, k2 bigint, n_words bigint, found array<struct<g:bigint,place:bigint,lead:int,around:string>>")


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables: doc_id, k1, k2, n_words of every row; k1, k2, first, n, w of every occurrence of a window; item, w."""
    every = write_table(windows(benchmark, window, shingle), "decontam-windows")
    ks = sorted({min(shingle, r[0]) for r in every.select("n").distinct().collect()})  # at most `window` values
    grams = every.groupBy("w").agg(F.first("n").alias("n"), F.first("grams").alias("grams")).select("w", "n", F.posexplode("grams").alias("at", "g"))
    counted = _counted(docs, Bitmap(grams, "g"), ks)
    file = grams.join(counted, "g", "left").groupBy("w", "n").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "g", "at")).alias("x"))
    file = write_table(file.select("w", "n", "x.g", "x.at"), "decontam-file")
    found = write_table(_found(docs, Bitmap(file, "g"), ks, window), "decontam-found")
    near = found.filter(F.size("found") > 0).select(*_KEY, F.explode("found").alias("f")).select(*_KEY, "f.*")
    met = near.join(F.broadcast(file) if file.count() <= FEW else file, "g").filter(F.col("lead") >= F.col("at"))
    words = F.slice(F.split("around", " "), F.col("lead") - F.col("at") + 1, F.col("n"))
    met = met.filter((F.size(words) == F.col("n")) & (F.array_join(words, " ") == F.col("w")))
    met = write_table(met.select(*_KEY, (F.col("place") - F.col("at")).alias("first"), "n", "w").distinct(), "decontam-hits")
    return found.drop("found"), met, every.select("item", "w").distinct()


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row; texts aren't shuffled."""
    rows, met, items = hits(docs, benchmark, window, shingle)
    spans = met.groupBy(*_KEY).agg(F.array_sort(F.collect_set(F.struct(F.col("first"), (F.col("first") + F.col("n")).alias("upto")))).alias("spans"))
    none = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("upto"))
    over = F.aggregate("spans", none, lambda a, s: F.struct((a["n"] + F.greatest(s["upto"] - F.greatest(a["upto"], s["first"]), F.lit(0))).alias("n"), F.greatest(a["upto"], s["upto"]).alias("upto")))
    named = met.select(*_KEY, "w").distinct().join(items, "w").select(*_KEY, "item").distinct().groupBy(*_KEY).agg(F.array_sort(F.collect_list("item")).alias("items"))
    result = spans.select(*_KEY, over["n"].alias("n_hit")).join(named, _KEY)
    out = rows.join(result, _KEY, "left")
    names = F.array_join(F.coalesce("items", F.array().cast("array<string>")), ",")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.greatest(F.coalesce(F.size("items"), F.lit(0)), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The rows of `docs`, all columns, whose text holds no window."""
    bad = write_table(hits(docs, benchmark, window, shingle)[1].select(*_KEY).distinct(), "decontam-bad")
    bad = bad.withColumnsRenamed({"k1": "bad_1_", "k2": "bad_2_"})
    near = (F.xxhash64(docs.doc_id, docs.text) == bad.bad_1_) & (F.xxhash64(docs.text, F.lit(1), docs.doc_id) == bad.bad_2_)
    return docs.join(F.broadcast(bad) if bad.count() <= FEW else bad, near, "left_anti")
