"""Operator 3, suffix-array dedup over bytes.

A byte is removed if a string of `length` bytes that covers it also starts anywhere else, in the same document
or another. In a block of text all suffixes with `length` bytes to go are sorted to that depth (in pieces of
PIECE suffixes, cut by their first bytes); for each, the previous and the next smaller position in suffix order
are found, and the longer of the two common prefixes is its longest previous factor. A start whose factor
reaches `length` is a copy of the earlier start that it points to. Removing only copies keeps the first; here
both go.

A corpus is no block, so blocks are formed of the text that matters. The smallest GRAM-byte hash in each
window of `length` bytes is its mark; equal windows have equal marks. Consecutive windows of one mark are a
run. In a first round (see chunks.py) buckets of marks learn each chunk's distinct runs: a run that occurs twice is
repeated as a whole, a mark with a single distinct run settles that run as unique. What is left, one copy of each
distinct run of a mark that has several (or that recurs within its run), is sent to the mark's bucket, and
there the suffix array of the bucket's text decides.
A mark with too many distinct runs for a block (over HOT, or HOT_BYTES) has its windows compared by 128-bit
hash in a round of their own, each distinct window of a chunk once. So copies and hot passages, whatever their
share of the corpus, are compressed before anything is compared.

Defined cases: a null text is empty; texts shorter than `length` lose nothing; matches never cross documents;
repeated rows are copies; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame

from rowsmith.llm import chunks
from rowsmith.llm.common import mark, raw

LENGTH = 400
GRAM = 64  # bytes, a power of two
HOT = 1000
HOT_BYTES = 2_000_000
PIECE = 32_768  # suffixes sorted at once
SLICE = 500_000  # bytes at once when marks are computed
TWICE, INNER = 1, 2  # of a distinct run in its chunk: it occurs again; its mark's gram recurs in it
FULL, SEND, IS_HOT = 1, 2, 4  # of a distinct run in the corpus: it occurs again; its text is wanted; as windows


# Suffix arrays


def smaller(positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in suffix order the previous and the next place with a smaller position, or -1 and n."""

    def previous(a: np.ndarray) -> np.ndarray:
        out = np.arange(len(a)) - 1
        bad = np.arange(1, len(a))
        while len(bad):
            bad = bad[a[out[bad]] > a[bad]]
            out[bad] = out[out[bad]]
            bad = bad[out[bad] >= 0]
        return out

    n = len(positions)
    return previous(positions), n - 1 - previous(positions[::-1])[::-1]


def suffixes(data: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """The first `depth` bytes of the suffixes from the given starts, a row each, filled up to whole 8 bytes."""
    out = np.zeros((len(starts), -(-depth // 8) * 8), np.uint8)
    out[:, :depth] = np.lib.stride_tricks.sliding_window_view(data, depth)[starts]
    return out


def suffix_order(rows: np.ndarray) -> np.ndarray:
    """The order of the rows; equal ones as they stand."""
    n, width = rows.shape
    ends = pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int64))
    return pc.array_sort_indices(pa.Array.from_buffers(pa.large_binary(), n, [None, ends, pa.py_buffer(rows)])).to_numpy().astype(np.int64)


def common_prefix(words: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of rows i and j, which are given as little-endian 64-bit words."""
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), 8192):
        x, y = words[i[at : at + 8192]], words[j[at : at + 8192]]
        differ = x != y
        first = differ.argmax(axis=1)
        row = np.arange(len(x))
        bits = x[row, first] ^ y[row, first]
        below = np.bitwise_count((bits & (~bits + np.uint64(1))) - np.uint64(1)).astype(np.int64) // 8
        out[at : at + 8192] = np.where(differ[row, first], 8 * first + below, 8 * x.shape[1])
    return out


def longest_previous_factor(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the given starts (ascending, each with `depth` bytes to go) the longest match with a smaller one
    of them, up to `depth`, and that start (-1: none). The longest match with any smaller start is that with the
    previous or the next smaller one in suffix order."""
    rows = suffixes(data, starts, depth)
    order = suffix_order(rows)
    words = rows.view("<u8")
    before, after = smaller(order)
    lpf, source = np.zeros(len(starts), np.int64), np.full(len(starts), -1)
    for place in (before, after):
        has = np.flatnonzero((place >= 0) & (place < len(order)))
        mine, theirs = order[has], order[place[has]]
        got = np.minimum(common_prefix(words, mine, theirs), depth)
        better = got > lpf[mine]
        lpf[mine[better]], source[mine[better]] = got[better], starts[theirs[better]]
    return lpf, source


def pieces(data: np.ndarray, starts: np.ndarray, depth: int, at: int = 0) -> Iterator[np.ndarray]:
    """The starts in pieces of at most PIECE, cut in suffix order between suffixes that differ within `depth`
    bytes; only what is equal throughout makes a larger piece."""
    if len(starts) <= PIECE or at >= depth:
        yield starts
        return
    ahead = np.lib.stride_tricks.sliding_window_view(np.r_[data, np.zeros(8, np.uint8)], 8)
    key = np.ascontiguousarray(ahead[starts + min(at, depth - 8)]).view(">u8").ravel().astype(np.uint64)
    order = np.argsort(key, kind="stable")
    starts, cut = starts[order], np.r_[np.flatnonzero(chunks.new_class(key[order])), len(order)]
    low = 0
    while low < len(cut) - 1:
        high = max(low + 1, int(np.searchsorted(cut, cut[low] + PIECE, side="right")) - 1)
        yield from pieces(data, starts[cut[low] : cut[high]], depth, at + 8)
        low = high


def repeats(data: np.ndarray, valid: np.ndarray, length: int) -> np.ndarray:
    """Of the valid starts those whose longest previous factor reaches `length`, and those they copy."""
    out = np.zeros(len(data), bool)
    for own in pieces(data, np.flatnonzero(valid), length):
        if len(own) > PIECE:  # equal strings: each is a factor of the first
            out[own] = True
        elif len(own) > 1:
            own = np.sort(own)
            lpf, source = longest_previous_factor(data, own, length)
            out[own[lpf >= length]] = True
            out[source[lpf >= length]] = True
    return out


# Runs of a chunk


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM bytes from each position on."""
    h = _mixed(data.astype(np.uint64) + np.uint64(1))
    size, factor = 1, 0x9E3779B97F4A7C15
    while size < GRAM:
        h = h[:-size] * np.uint64(factor) + h[size:]
        factor = factor * factor % (1 << 64)
        size *= 2
    return _mixed(h)


def window_marks(h: np.ndarray, length: int) -> np.ndarray:
    """The smallest gram hash in the `length` bytes from each position on."""
    have, want = 1, length - GRAM + 1
    while have < want:
        step = min(have, want - have)
        h = np.minimum(h[: len(h) - step], h[step:])
        have += step
    return h


def recurs(h: np.ndarray, at: np.ndarray, windows: np.ndarray, marks: np.ndarray, length: int) -> np.ndarray:
    """Whether a run holds its mark's gram twice, without which no two of its windows can be equal."""
    known = np.unique(marks)
    low = np.zeros(1 << 16, bool)
    low[known & np.uint64(0xFFFF)] = True
    pos = np.flatnonzero(low[h & np.uint64(0xFFFF)])
    pos = pos[known[np.minimum(np.searchsorted(known, h[pos]), len(known) - 1)] == h[pos]]
    lo, hi = np.searchsorted(pos, at), np.searchsorted(pos, at + windows + length - GRAM)
    run = np.repeat(np.arange(len(at)), hi - lo)
    i = np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange(int((hi - lo).sum()))
    return np.bincount(run[h[pos[i]] == marks[run]], minlength=len(at)) > 1


class Runs:
    """The runs of a chunk's texts: document, start, number of windows, mark, and the text's hash."""

    def __init__(self, texts: list[bytes], length: int) -> None:
        self.texts, self.length = texts, length
        doc, start, count, marks, inner = [], [], [], [], []
        group: list[int] = []
        size = 0
        for i in [*range(len(texts)), -1]:
            if i < 0 or size > SLICE:
                if group:
                    data = np.frombuffer(b"".join([texts[g] for g in group]), np.uint8)
                    h = gram_hashes(data)
                    m = window_marks(h, length)
                    lens = np.array([len(texts[g]) for g in group])
                    first = np.cumsum(lens) - lens
                    owner = np.repeat(np.arange(len(group)), lens)[: len(m)]
                    inside = np.arange(len(m)) + length <= (first + lens)[owner]
                    change = inside.copy()
                    change[1:] &= (m[1:] != m[:-1]) | (owner[1:] != owner[:-1])
                    at = np.flatnonzero(change)
                    windows = np.add.reduceat(inside.astype(np.int64), at) if len(at) else at
                    doc.append(np.array(group)[owner[at]])
                    start.append(at - first[owner[at]])
                    count.append(windows)
                    marks.append(m[at])
                    inner.append(recurs(h, at, windows, m[at], length))
                group, size = [], 0
            if i >= 0 and len(texts[i]) >= length:
                group.append(i)
                size += len(texts[i])
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        self.doc, self.start, self.count = join(doc, np.int64), join(start, np.int64), join(count, np.int64)
        mark_ = _mixed(join(marks, np.uint64))  # the smallest of many hashes is small; this spreads them again
        h = xxhash.xxh3_128_digest
        ends = self.start + self.count + length - 1
        digests = [h(texts[d][s:e]) for d, s, e in zip(self.doc.tolist(), self.start.tolist(), ends.tolist(), strict=True)]
        key = np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).reshape(-1, 2)
        order = np.lexsort((key[:, 1], key[:, 0], mark_))
        self.doc, self.start, self.count = self.doc[order], self.start[order], self.count[order]
        mark_, key = mark_[order], key[order]
        first = chunks.new_class(mark_, key[:, 0], key[:, 1])
        self.entry = np.cumsum(first) - 1  # which distinct run each run is
        self.rep = np.flatnonzero(first)
        self.mark, self.key = mark_[first], key[first]
        twice = np.bincount(self.entry, minlength=len(self.rep)) > 1
        self.flags = (TWICE * twice + INNER * join(inner, bool)[order][first]).astype(np.uint8)

    def text(self, run: int) -> bytes:
        s = int(self.start[run])
        return self.texts[self.doc[run]][s : s + int(self.count[run]) + self.length - 1]




def _ask_runs(length: int, n: int):
    def f(chunk: int, t: pa.Table) -> pa.Table:
        runs = Runs([x or b"" for x in raw(chunks.in_order(t).column("text"))], length)
        size = (runs.count[runs.rep] + length - 1).astype(np.uint32)
        return chunks.table([chunks.row(b, chunk, 0, chunks.pack(runs.mark[s:e], runs.key[s:e, 0], runs.key[s:e, 1], size[s:e], runs.flags[s:e])) for b, s, e in chunks.parts(runs.mark, n)])

    return f


def _settle(hot: int, rows: list[dict]) -> list[dict]:
    parts = [chunks.unpack(r["blob"], "u8", "u8", "u8", "u4", "u1") for r in rows]
    mark_, hi, lo, size, flags = (np.concatenate([p[i] for p in parts]) for i in range(5))
    lens = [len(p[0]) for p in parts]
    chunk = np.repeat([r["chunk"] for r in rows], lens)
    order = np.lexsort((chunk, lo, hi, mark_))
    first = chunks.new_class(mark_[order], hi[order], lo[order])
    klass = np.cumsum(first) - 1
    many = np.bincount(klass, weights=1 + (flags[order] & TWICE)) > 1
    top = chunks.new_class(mark_[order])
    group = np.cumsum(top) - 1
    distinct = np.bincount(group, weights=first)
    bytes_ = np.bincount(group, weights=first * size[order])
    status = FULL * many[klass] + (SEND * first + IS_HOT * ((distinct > hot) | (bytes_ > HOT_BYTES))[group]) * ((distinct > 1)[group] | ((flags[order] & INNER) > 0))
    out = np.empty(len(order), np.uint8)
    out[order] = status
    return [{**r, "blob": x.tobytes()} for r, x in zip(rows, np.split(out, np.cumsum(lens)[:-1]), strict=True)]


def _send_runs(length: int, n: int):
    def f(chunk: int, t: pa.Table, answers: list[dict]) -> pa.Table:
        runs = Runs([x or b"" for x in raw(chunks.in_order(t).column("text"))], length)
        at = {b: (s, e) for b, s, e in chunks.parts(runs.mark, n)}
        status = np.zeros(len(runs.rep), np.uint8)
        for r in answers:
            s, e = at[r["bucket"]]
            status[s:e] = np.frombuffer(r["blob"], np.uint8)
        rows = []
        packer = zstandard.ZstdCompressor(level=1)
        send = np.flatnonzero((status & (SEND | IS_HOT)) == SEND)
        for b, s, e in chunks.parts(runs.mark[send], n):
            own = send[s:e]
            texts = [runs.text(runs.rep[x]) for x in own.tolist()]
            blob = chunks.pack(own.astype(np.uint32), np.array([len(x) for x in texts], np.uint32), (status[own] & FULL) > 0)
            rows.append(chunks.row(b, chunk, 1, packer.compress(blob + b"".join(texts))))
        whole = np.flatnonzero((status[runs.entry] & FULL) > 0)
        single = np.flatnonzero((status & FULL) == 0)
        single = single[(status[single] & SEND) > 0]
        at_single = runs.rep[single]
        rows.append(chunks.row(-1 - chunk, chunk, 2, chunks.pack(*[x[whole].astype(np.uint32) for x in (runs.doc, runs.start, runs.count)])))
        rows.append(chunks.row(-1 - chunk, chunk, 3, chunks.pack(single.astype(np.uint32), *[x[at_single].astype(np.uint32) for x in (runs.doc, runs.start, runs.count)])))
        hot = np.flatnonzero((status & (SEND | IS_HOT)) == SEND | IS_HOT)
        if len(hot):
            h, digests = xxhash.xxh3_128_digest, []
            for e in hot.tolist():
                x = runs.text(runs.rep[e])
                digests += [h(x[k : k + length]) for k in range(len(x) - length + 1)]
            key = np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).reshape(-1, 2)
            counts = runs.count[runs.rep[hot]]
            doc = np.repeat(runs.doc[runs.rep[hot]], counts)
            start = np.repeat(runs.start[runs.rep[hot]] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
            order = np.lexsort((key[:, 1], key[:, 0]))
            key = key[order]
            first = chunks.new_class(key[:, 0], key[:, 1])
            klass = np.cumsum(first) - 1
            key, twice = key[first], np.bincount(klass) > 1
            parts = chunks.parts(key[:, 0], n)
            rows += [chunks.row(n + b, chunk, 4, chunks.pack(key[s:e, 0], key[s:e, 1], twice[s:e])) for b, s, e in parts]
            at = chunks.pack(np.array([n + b for b, _, _ in parts], np.int64), np.array([s for _, s, _ in parts], np.uint32), np.array([e for _, _, e in parts], np.uint32))
            rows.append(chunks.row(-1 - chunk, chunk, 5, at + chunks.pack(klass.astype(np.uint32), doc[order].astype(np.uint32), start[order].astype(np.uint32))))
        return chunks.table(rows)

    return f


def _decide(length: int):
    """Suffix arrays over the runs of a bucket; or the windows of hot marks."""

    def windows(rows: list[dict]) -> list[dict]:
        parts = [chunks.unpack(r["blob"], "u8", "u8", "?") for r in rows]
        hi, lo, twice = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.lexsort((lo, hi))
        klass = np.cumsum(chunks.new_class(hi[order], lo[order])) - 1
        yes = np.empty(len(hi), bool)
        yes[order] = (np.bincount(klass) > 1)[klass]
        yes |= twice
        return [{**r, "blob": np.packbits(y).tobytes()} for r, y in zip(rows, np.split(yes, np.cumsum([len(p[0]) for p in parts])[:-1]), strict=True)]

    def f(rows: list[dict]) -> list[dict]:
        if rows[0]["kind"] == 4:
            return windows(rows)
        unpacker = zstandard.ZstdDecompressor()
        chunk, entry, size, full, texts = [], [], [], [], []
        for r in rows:
            blob = unpacker.decompress(r["blob"])
            e, s, w = chunks.unpack(blob, "u4", "u4", "?")
            body = blob[4 + 9 * len(e) :]
            end = np.cumsum(s.astype(np.int64))
            texts += [body[b - k : b] for b, k in zip(end.tolist(), s.tolist(), strict=True)]
            chunk.append(np.full(len(e), r["chunk"]))
            entry.append(e)
            size.append(s)
            full.append(w)
        chunk, entry, size, full = (np.concatenate(x) for x in (chunk, entry, size, full))
        data = np.frombuffer(b"".join(texts), np.uint8)
        lens = size.astype(np.int64)
        ends = np.cumsum(lens)
        yes = repeats(data, np.arange(len(data)) + length <= np.repeat(ends, lens), length)
        found: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        for i, b, k in zip(range(len(texts)), ends.tolist(), lens.tolist(), strict=True):
            if not full[i] and (own := yes[b - k : b - length + 1]).any():
                found[int(chunk[i])].append((int(entry[i]), np.packbits(own).tobytes()))
        out = []
        for c, answers in found.items():
            head = chunks.pack(np.array([e for e, _ in answers], np.uint32), np.array([len(b) for _, b in answers], np.uint32))
            out.append(chunks.row(rows[0]["bucket"], c, 1, head + b"".join([b for _, b in answers])))
        return out

    return f


def _removed(texts: list[bytes], answers: list[dict], length: int) -> list[np.ndarray]:
    """The start positions, for each text, of repeated strings."""
    lens = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(lens) - lens
    starts = [np.zeros(0, np.int64)]
    widths = [np.zeros(0, np.int64)]

    def add(doc, start, width) -> None:
        starts.append(first[doc.astype(np.int64)] + start.astype(np.int64))
        widths.append(width)

    notes = {r["kind"]: r["blob"] for r in answers if r["bucket"] < 0}
    if 2 in notes:
        doc, start, count = chunks.unpack(notes[2], "u4", "u4", "u4")
        add(doc, start, count.astype(np.int64) + length - 1)
    if 3 in notes:
        entry, doc, start, count = chunks.unpack(notes[3], "u4", "u4", "u4", "u4")
    if 5 in notes:
        buckets, at, end = chunks.unpack(notes[5], "i8", "u4", "u4")
        klass, hot_doc, hot_start = chunks.unpack(notes[5][4 + 16 * len(at) :], "u4", "u4", "u4")
        hot, spans = np.zeros(int(end[-1]), bool), dict(zip(buckets.tolist(), zip(at.tolist(), end.tolist(), strict=True), strict=True))
    for r in answers:
        if r["bucket"] >= 0 and r["kind"] == 1:
            e, size = chunks.unpack(r["blob"], "u4", "u4")
            body = 4 + 8 * len(e)
            for i, k in zip(np.searchsorted(entry, e).tolist(), size.tolist(), strict=True):
                yes = np.flatnonzero(np.unpackbits(np.frombuffer(r["blob"], np.uint8, k, body), count=int(count[i])))
                add(np.full(len(yes), doc[i]), int(start[i]) + yes, np.full(len(yes), length))
                body += k
        elif r["bucket"] >= 0:
            s, e = spans[r["bucket"]]
            hot[s:e] = np.unpackbits(np.frombuffer(r["blob"], np.uint8), count=e - s)
    if 5 in notes:
        yes = hot[klass]
        add(hot_doc[yes], hot_start[yes], np.full(int(yes.sum()), length))
    gone = mark(int(lens.sum()), np.concatenate(starts), np.concatenate(widths))
    return np.split(gone, np.cumsum(lens)[:-1])


def dedup(docs: DataFrame, length: int = LENGTH, hot: int = HOT, chunk_bytes: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    if length < 2 * GRAM:
        raise ValueError(f"strings of at least {2 * GRAM} bytes")
    texts, n = chunks.dealt(docs, ["doc_id", "text"], chunk_bytes)
    settled = chunks.answer(chunks.ask(texts, _ask_runs(length, n)), partial(_settle, hot))
    decided = chunks.answer(chunks.hear(texts, settled, _send_runs(length, n), chunks.ROW_SQL), _decide(length))

    def finish(_: int, t: pa.Table, answers: list[dict]) -> pa.Table:
        t = chunks.in_order(t)
        data = [x or b"" for x in raw(t.column("text"))]
        out = []
        for x, gone in zip(data, _removed(data, answers, length), strict=True):
            edge = np.diff(np.r_[0, gone.astype(np.int8), 0])
            kept = np.frombuffer(x, np.uint8)[~gone].tobytes() if gone.any() else x
            out.append((len(x), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*out, strict=True))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.table([t.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return chunks.hear(texts, decided, finish, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
