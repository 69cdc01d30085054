"""Operator 2, language ID: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, what isn't a letter counts as a space, and runs of 1 to 3 characters are hashed into
2**BITS buckets. Training counts n-grams of labelled rows, a bounded sample of them if there are more than
TRAIN_ROWS (chosen by a hash of the text, so each row is as likely); counting is a sum with partial sums on
each task, of the cells that occur. The log-probability matrix has labels x buckets cells, whatever the size of
the corpus, and goes to the executors with the function; with more labels than CELLS allows there are half, a
quarter ... as many buckets, and beyond 65,536 labels, which can't be languages, an error. Scoring is one pass
without a shuffle: n-grams of a batch index the matrix, and rows are sums over each text's run.

Defined cases: a text that is null or has no letter gets `und` and score 0; ties go to the first label in
order; with no labelled row every text gets `und`; repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsmith.llm.common import freed, slices

BITS = 16
CELLS = 1 << 24  # of the matrix, 8 bytes each
MAX_LABELS = 1 << 16
TRAIN_ROWS = 60_000
ALPHA = 0.05
UNKNOWN = "und"
CHARS = 400_000  # at once


@cache
def letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else a space."""
    n = 0x110000
    return np.array([c if chr(c).isalpha() else 32 for c in range(n)], np.uint32)


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Letters and spaces of all texts in a row, and where each text starts; a space stands before and after."""
    lowered = [f" {t.lower()} " if t else "  " for t in texts]
    at = np.cumsum([0, *map(len, lowered)])
    return letters()[np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)], at


def bits_for(labels: int) -> int:
    return min(BITS, max(8, (CELLS // max(1, labels)).bit_length() - 1))


def grams(chars: np.ndarray, bits: int) -> list[np.ndarray]:
    """Buckets of the 1-, 2- and 3-grams that start at each place; the last places have fewer."""
    c = chars.astype(np.uint64)
    out, h = [], np.zeros(len(c), np.uint64)
    for n in range(3):
        h = (h[: len(c) - n] + c[n:] + np.uint64(n + 1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        out.append((h >> np.uint64(64 - bits)).astype(np.intp))
    return out


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return slices(batch, limit=CHARS)


def _batches(df: DataFrame) -> list[pa.RecordBatch]:
    return df.toArrow().to_batches()


def train(labelled: DataFrame, sample: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Labels in order and the matrix: log P(bucket | label), with log P(label) as a last column. At most CELLS
    counts, if labels are as many as that, come to the driver."""
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().limit(MAX_LABELS + 1).collect()}
    if len(sizes) > MAX_LABELS:
        raise ValueError(f"over {MAX_LABELS} labels")
    rows = sum(sizes.values())
    if rows > sample:
        share = F.xxhash64("text").bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
        labelled = labelled.filter(share < sample / rows)
    names = sorted(sizes)
    place = {x: i for i, x in enumerate(names)}
    bits = bits_for(len(names))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                chars, at = code_points(part.column("text").to_pylist())
                label = np.repeat([place[x] for x in part.column("lang").to_pylist()], np.diff(at))
                same = np.repeat(np.arange(len(at) - 1), np.diff(at))
                cells = []
                for n, g in enumerate(grams(chars, bits)):
                    inside = same[: len(chars) - n] == same[n:]
                    cells.append((label[: len(g)] << bits | g)[inside])
                cell, n = np.unique(np.concatenate(cells), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n.astype(np.int64))], names=["cell", "n"])

    counted = labelled.select("text", "lang").mapInArrow(freed(count), "cell bigint, n bigint")
    total = np.zeros((len(names), 1 << bits))
    for got in _batches(counted.groupBy("cell").agg(F.sum("n").alias("n"))):
        total.ravel()[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    matrix = np.log((total + ALPHA) / (total.sum(1, keepdims=True) + ALPHA * (1 << bits))) if names else total
    prior = np.log(np.array([sizes[x] for x in names], float) / max(1, rows))
    return names, np.hstack([matrix, prior[:, None]])


def score(texts: list[str | None], names: list[str], matrix: np.ndarray) -> tuple[list[str], list[float]]:
    """The likeliest label of each text and its posterior probability."""
    chars, at = code_points(texts)
    run = np.maximum.reduceat(chars, at[:-1]) > 32 if len(texts) else np.zeros(0, bool)
    if not names:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    logs = np.empty((len(names), len(texts)))
    padded = [np.concatenate([g, np.full(len(chars) - len(g), -1, np.intp)]) for g in grams(chars, (matrix.shape[1] - 1).bit_length() - 1)]
    for n in (1, 2):  # runs over a text's end don't count
        for k in range(1, n + 1):
            padded[n][at[1:] - k] = -1
    for i in range(len(names)):
        row = np.append(matrix[i, :-1], 0.0)  # -1: nothing
        logs[i] = np.add.reduceat(row[padded[0]] + row[padded[1]] + row[padded[2]], at[:-1]) + matrix[i, -1]
    best = logs.argmax(0)
    top = 1 / np.exp(logs - logs.max(0)).sum(0)
    return [names[b] if ok else UNKNOWN for b, ok in zip(best, run, strict=True)], np.where(run, top, 0.0).tolist()


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], *carried: Column) -> DataFrame:
    """The carried columns with lang_pred and score; only `text` is read for the prediction."""
    names, matrix = model
    docs = docs.select(*carried, F.col("text"))
    keep = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                pred, value = score(part.column("text").to_pylist(), names, matrix)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(pred, pa.string()), pa.array(value, pa.float64())], names=[*keep, "lang_pred", "score"])

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(freed(run), ", ".join([*[f"{c} {kinds[c]}" for c in keep], "lang_pred string, score double"]))


def identify(docs: DataFrame, held_out: Column, sample: int = TRAIN_ROWS) -> DataFrame:
    """Trains on labelled rows that aren't held out and predicts all rows."""
    model = train(docs.filter(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull()), sample)
    return predict(docs, model, F.col("doc_id"), held_out.alias("held_out"))
