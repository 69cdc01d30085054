"""Operator 7, substring dedup over words with difference-cover anchors.

A window of `width` consecutive words is removed if the same words also start earlier: in a document with a
smaller doc_id, or in the same document before. Anchors are runs of width - period + 1 words at positions that
lie in a difference cover modulo the period. For any two equal windows some shift below the period puts both
on the cover, so they share an aligned anchor: a window without a repeated anchor is settled by hashing 4 of 13
positions. Around repeated anchors the match is extended to whole windows, which are compared by 128-bit hash.

Two rounds (see chunks.py): which anchors occur more than once in the corpus, then which of the remaining
windows have an earlier owner. A bucket hears of an anchor or a window once from each chunk, with the smallest
doc_id there, so a passage in a third of all documents costs each chunk one key; texts never meet each other.

Defined cases: null and empty texts have no words; a null doc_id counts as smallest; rows with one doc_id count
one after the other, in the order of their chunks; so of repeated rows all but one lose their windows; other
columns are kept on request, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

from rowsmith.llm import chunks
from rowsmith.llm.common import bounds, mark, raw

WIDTH = 20
#: Perfect difference sets, by period.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 6, 8, 18), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52)}


def cover_for(width: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors of about a third of the width."""
    period = max((p for p in COVERS if width - p + 1 >= max(1, width // 3)), default=0)
    if not period:
        raise ValueError("windows are too short for a difference cover")
    return period, COVERS[period]


class Words:
    """Texts of a chunk as words joined by one space."""

    def __init__(self, t: pa.Table) -> None:
        self.joined = [b" ".join((x or b"").split()) for x in raw(t.column("text"))]
        self.n = np.array([j.count(b" ") + 1 if j else 0 for j in self.joined], np.int64)
        self.first = np.cumsum(self.n) - self.n  # each text's first word in the chunk

    def anchors(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the anchors, and their places among the chunk's words."""
        period, cover = cover_for(width)
        size = width - period + 1
        hashes: list[int] = []
        places = []
        h = xxhash.xxh3_64_intdigest
        for joined, n, first in zip(self.joined, self.n.tolist(), self.first.tolist(), strict=True):
            if n >= width:
                starts, ends = bounds(joined)
                at = np.arange(n - size + 1)
                at = at[np.isin(at % period, cover)]
                hashes += [h(joined[starts[i] : ends[i + size - 1]]) for i in at.tolist()]
                places.append(at + first)
        return np.array(hashes, np.uint64), np.concatenate(places) if places else np.zeros(0, np.int64)

    def windows(self, candidates: np.ndarray, width: int) -> np.ndarray:
        """128-bit hashes, as two columns, of the windows that start where `candidates` is true."""
        out: list[bytes] = []
        h = xxhash.xxh3_128_digest
        for joined, n, first in zip(self.joined, self.n.tolist(), self.first.tolist(), strict=True):
            if n >= width and (at := np.flatnonzero(candidates[first : first + n - width + 1])).size:
                starts, ends = bounds(joined)
                out += [h(joined[starts[i] : ends[i + width - 1]]) for i in at.tolist()]
        return np.frombuffer(b"".join(out), ">u8").astype(np.uint64).reshape(-1, 2)


def _ask_anchors(width: int, n: int):
    def f(chunk: int, t: pa.Table) -> pa.Table:
        hashes, counts = np.unique(Words(chunks.in_order(t)).anchors(width)[0], return_counts=True)
        return chunks.table([chunks.row(b, chunk, 0, chunks.pack(hashes[s:e], counts[s:e] > 1)) for b, s, e in chunks.parts(hashes, n)])

    return f


def _repeated(rows: list[dict]) -> list[dict]:
    """For each chunk's keys: does the key occur elsewhere, or twice there?"""
    parts = [chunks.unpack(r["blob"], "u8", "?") for r in rows]
    keys = np.concatenate([p[0] for p in parts])
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    yes = (counts[inverse] > 1) | np.concatenate([p[1] for p in parts])
    ends = np.cumsum([len(p[0]) for p in parts])
    return [{**r, "blob": np.packbits(y).tobytes()} for r, y in zip(rows, np.split(yes, ends[:-1]), strict=True)]


def _ask_windows(width: int, n: int):
    period, _ = cover_for(width)

    def f(chunk: int, t: pa.Table, answers: list[dict]) -> pa.Table:
        t = chunks.in_order(t)
        words = Words(t)
        hashes, places = words.anchors(width)
        hashes, inverse = np.unique(hashes, return_inverse=True)
        at = {b: (s, e) for b, s, e in chunks.parts(hashes, n)}
        repeated = np.zeros(len(hashes), bool)
        for r in answers:
            s, e = at[r["bucket"]]
            repeated[s:e] = np.unpackbits(np.frombuffer(r["blob"], np.uint8), count=e - s)
        total = int(words.n.sum())
        seen = np.zeros(total + 1, np.int64)
        np.add.at(seen, places[repeated[inverse]] + 1, 1)
        seen = np.cumsum(seen)
        near = seen[np.minimum(np.arange(total) + period, total)] > seen[:total]
        last = np.zeros(total, bool)  # starts whose window would leave its text
        for k, m in zip(words.first.tolist(), words.n.tolist(), strict=True):
            last[max(k, k + m - width + 1) : k + m] = True
        near &= ~last
        place = np.flatnonzero(near)
        keys = words.windows(near, width)
        owner = np.repeat(pc.fill_null(t.column("doc_id").cast(pa.int64()), np.iinfo(np.int64).min).to_numpy(), words.n)[place]
        order = np.lexsort((keys[:, 1], keys[:, 0]))  # stable: the first of a class is the earliest
        keys, owner, place = keys[order], owner[order], place[order]
        first = chunks.new_class(keys[:, 0], keys[:, 1])
        note = chunks.pack(place[first].astype(np.uint32)) + chunks.pack(place[~first].astype(np.uint32))
        keys, owner = keys[first], owner[first]
        parts = chunks.parts(keys[:, 0], n)
        rows = [chunks.row(b, chunk, 1, chunks.pack(keys[s:e, 0], keys[s:e, 1], owner[s:e])) for b, s, e in parts]
        ends = chunks.pack(np.array([b for b, _, _ in parts], np.int64), np.array([s for _, s, _ in parts], np.uint32))
        return chunks.table([*rows, chunks.row(-1 - chunk, chunk, 2, ends + note)])

    return f


def _later(rows: list[dict]) -> list[dict]:
    """For each chunk's windows: does a smaller doc_id have it too? Ties go to the smaller chunk."""
    parts = [chunks.unpack(r["blob"], "u8", "u8", "i8") for r in rows]
    hi, lo, owner = (np.concatenate([p[i] for p in parts]) for i in range(3))
    size = [len(p[0]) for p in parts]
    chunk = np.repeat([r["chunk"] for r in rows], size)
    order = np.lexsort((chunk, owner, lo, hi))
    yes = np.empty(len(hi), bool)
    yes[order] = ~chunks.new_class(hi[order], lo[order])
    return [{**r, "blob": np.packbits(y).tobytes()} for r, y in zip(rows, np.split(yes, np.cumsum(size)[:-1]), strict=True)]


def _removed(words: Words, answers: list[dict], width: int) -> np.ndarray:
    """Which of the chunk's words go."""
    total = int(words.n.sum())
    starts = []
    note = next((r["blob"] for r in answers if r["kind"] == 2), None)
    if note is not None:
        buckets, at = chunks.unpack(note, "i8", "u4")
        rest = note[4 + buckets.nbytes + at.nbytes :]
        (first,) = chunks.unpack(rest, "u4")
        (again,) = chunks.unpack(rest[4 + first.nbytes :], "u4")
        starts.append(again)
        spans = dict(zip(buckets.tolist(), zip(at.tolist(), [*at[1:].tolist(), len(first)], strict=False), strict=True))
        for r in answers:
            if r["kind"] == 1:
                s, e = spans[r["bucket"]]
                starts.append(first[s:e][np.unpackbits(np.frombuffer(r["blob"], np.uint8), count=e - s).astype(bool)])
    return mark(total, np.concatenate([np.zeros(0, np.int64), *starts]).astype(np.int64), width)


def dedup(docs: DataFrame, width: int = WIDTH, keep_columns: bool = False, chunk_bytes: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; or, with keep_columns, all columns of `docs` with
    the kept words as the text (a text that loses nothing stays as it is) and its length as n_chars."""
    texts, n = chunks.dealt(docs, docs.columns if keep_columns else ["doc_id", "text"], chunk_bytes)
    repeated = chunks.answer(chunks.ask(texts, _ask_anchors(width, n)), _repeated)
    later = chunks.answer(chunks.hear(texts, repeated, _ask_windows(width, n), chunks.ROW_SQL), _later)

    def finish(_: int, t: pa.Table, answers: list[dict]) -> pa.Table:
        t = chunks.in_order(t)
        words = Words(t)
        gone = _removed(words, answers, width)
        n_removed, kept = [], []
        for joined, m, k in zip(words.joined, words.n.tolist(), words.first.tolist(), strict=True):
            lost = gone[k : k + m]
            n_removed.append(int(lost.sum()))
            kept.append(b" ".join([w for w, x in zip(joined.split(b" "), lost.tolist(), strict=True) if not x]) if n_removed[-1] else joined)
        if keep_columns:
            t = t.drop_columns([chunks.CHUNK])
            text = [x if not r else k.decode() for x, r, k in zip(t.column("text").to_pylist(), n_removed, kept, strict=True)]
            t = t.set_column(t.schema.get_field_index("text"), "text", pa.array(text, pa.string()))
            if "n_chars" in t.schema.names:
                i = t.schema.get_field_index("n_chars")
                t = t.set_column(i, "n_chars", pa.array([old if not r else len(x) for old, r, x in zip(t.column(i).to_pylist(), n_removed, text, strict=True)], t.schema.field(i).type))
            return t
        return pa.table({"doc_id": t.column("doc_id"), "n_words": pa.array(words.n), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())})

    schema = docs.schema if keep_columns else f"doc_id {dict(docs.dtypes)['doc_id']}, n_words bigint, n_removed bigint, kept_sha256 string"
    return chunks.hear(texts, later, finish, schema)
