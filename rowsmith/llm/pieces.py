"""Operator 8, SentencePiece encoding and decoding with sampled segmentations.

The pieces of a model span a lattice over a text; a path's weight is the product of its pieces' weights, and
a segmentation's probability its weight over the sum of all paths. From this distribution k distinct
segmentations are drawn without replacement by Gumbel top-k: every path's log-probability is perturbed by a
Gumbel variate, and the k largest are found by A* search over the tree of prefixes without visiting the others.
A popped subtree yields its best leaf by sampling downwards; the subtrees left aside along the way get the
largest variate that they hold, drawn from a Gumbel distribution cut off at their parent's, and wait in the
queue under that bound. The (k+1)th value in the queue is the threshold for inclusion scores: a sample's chance
to be among the k, 1 - exp(-exp(log p - threshold)).

The model's pieces are of the byte-pair kind and carry ranks instead of log-probabilities: piece number r gets
the Zipf weight 1 / (r + 2), user pieces and byte pieces the weight of the last rank; a character without a
piece is its UTF-8 bytes. No piece has a space after another character, so the lattice falls apart at words:
forward and backward sums are made once for each distinct word of a slice, in numpy, and words are sampled
side by side; the search itself spans the whole text. Random numbers are hashes of (seed, row key, sample, word,
step), so a row's samples don't depend on partitions or retries. One pass, no shuffle.

Defined cases: a null or empty text has the one empty segmentation; fewer than k segmentations: all of them,
each with score 1; repeated rows have equal samples; a null key counts as 0; other columns are ignored. A
literal U+2581 decodes to a space, as the model has it.
"""

from __future__ import annotations

import heapq
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from rowsmith.llm.common import freed, gathered, slices, trim

SPACE = "▁"
WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
GATHER, SLICE = 2_500_000, 3_500_000  # bytes of text at once: about as much, and at most
BLOCK = 60_000  # characters of distinct words at once
FACTOR = np.uint64(0x9E3779B97F4A7C15)
GRAIN = float(1 << 40)  # of probabilities within a step


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1), from counters."""
    x = mix(x)
    x >>= np.uint64(11)
    u = x.astype(np.float64)
    u += 0.5
    u /= 1 << 53
    return u


class Vocabulary:
    """Pieces, their weights, and hashes to find them in texts."""

    def __init__(self, name: str) -> None:
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=name if os.path.isabs(name) else public_tokenizers.path(name))
        n = model.get_piece_size()
        self.strings = [model.id_to_piece(i) for i in range(n)]
        self.weight = np.zeros(n)
        self.bytes = np.zeros(256, np.int64)
        by_length: dict[int, list[tuple[int, int]]] = {}
        self.prefix: list[np.ndarray] = []
        prefixes: dict[int, set[int]] = {}
        self.raw: list[bytes] = []
        for i, s in enumerate(self.strings):
            self.weight[i] = -np.log(2.0 + min(-model.get_score(i), n))
            self.raw.append(b"" if model.is_control(i) or model.is_unknown(i) else s.replace(SPACE, " ").encode())
            if model.is_byte(i):
                self.bytes[int(s[3:5], 16)] = i
                self.weight[i] = -np.log(2.0 + n)
                self.raw[i] = bytes([int(s[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i)):
                h = 0
                for k, c in enumerate(s):
                    h = (h + ord(c) + 1) * int(FACTOR) % (1 << 64)
                    h ^= h >> 29
                    prefixes.setdefault(k + 1, set()).add(h)
                by_length.setdefault(len(s), []).append((h, i))
        self.size = np.array(list(map(len, self.raw)), np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(self.raw), np.uint8)
        self.longest = max(by_length)
        self.tables = []
        for k in range(1, self.longest + 1):
            own = sorted(by_length.get(k, []), key=lambda x: x[0] & 0x3FFFF)
            slots = np.zeros(1 << 18, np.int16 if len(own) < 1 << 15 else np.int32)  # 0: nothing starts so
            slots[np.array([h & 0x3FFFF for h in prefixes[k]], np.int64)] = -1
            for j in range(len(own), 0, -1):  # the first piece of the slot, from 1; others follow it
                slots[own[j - 1][0] & 0x3FFFF] = j
            most = int(np.bincount([h & 0x3FFFF for h, _ in own]).max()) if own else 0
            self.tables.append((slots, most, np.array([h for h, _ in own] + [0] * most, np.uint64), np.array([i for _, i in own], np.int32)))

    def decode(self, ids) -> str:
        """The text of ids; one leading space, the model's own, goes."""
        return self.joined(np.asarray(ids, np.int64)).decode("utf-8", "replace")

    def spell(self, ids: np.ndarray, offsets: np.ndarray, texts: list[bytes], take: list[int]) -> list[bool]:
        """Whether each run of ids spells its text."""
        size = self.size[ids]
        upto = np.cumsum(size)
        out = self.flat[np.repeat(self.at[ids] - upto + size, size) + np.arange(int(upto[-1]) if len(ids) else 0)].tobytes()
        ends = np.r_[0, upto][offsets].tolist()
        return [out[a + out.startswith(b" ", a, b) : b] == texts[i] for i, a, b in zip(take, ends[:-1], ends[1:], strict=True)]

    def joined(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        upto = np.cumsum(size)
        n = int(upto[-1]) if len(ids) else 0
        out = self.flat[np.repeat(self.at[ids] - upto + size, size) + np.arange(n)].tobytes()
        return out[1:] if out[:1] == b" " else out


@cache
def vocabulary(name: str) -> Vocabulary:
    return Vocabulary(name)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """The arrays as one; the list is emptied."""
    out = np.empty(sum(map(len, parts)), parts[0].dtype)
    at = len(out)
    while parts:
        x = parts.pop()
        at -= len(x)
        out[at : at + len(x)] = x
    return out


class Lattice:
    """The edges of distinct words, in a row, with the probability of each given its start."""

    def __init__(self, v: Vocabulary, words: pa.Array) -> None:
        size = pc.utf8_length(words).to_numpy().astype(np.int64)
        self.end = np.cumsum(size)
        self.begin = self.end - size
        n = int(self.end[-1])
        ends = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)
        text = words.buffers()[2].to_pybytes()[ends[0] : ends[-1]].decode()
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        left = (np.repeat(self.end, size) - np.arange(n)).astype(np.int32)
        self.spelled: list[np.ndarray] = []
        self.edges = np.zeros(n + 1, np.int64)  # the first edge from each place
        parts, at, n_edges = [], 0, 0
        while at < n:  # blocks of words that fit in the processor's cache
            to = int(self.end[min(np.searchsorted(self.end, at + BLOCK), len(words) - 1)])
            edges, first, width, piece, goal, logp, upto = self.block(v, code[at:to], left[at:to])
            self.edges[at:to] = edges + n_edges
            parts.append((first + n_edges, width, piece, np.where(goal == to - at, n, goal + at).astype(np.int32), logp, upto))
            at, n_edges = to, n_edges + len(piece)
        fields = [list(x) for x in zip(*parts, strict=True)]
        del parts
        self.first, self.width, self.piece, self.to, self.logp, self.upto = (_joined(x) for x in fields)
        self.done = self.to == n  # a word's end is place n

    def block(self, v: Vocabulary, code: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, ...]:
        """The edges of some words: first edge of each place; first edges and widths in order; piece, goal,
        log-probability and cumulated probability of each edge."""
        n = len(code)
        found: list[tuple[np.ndarray, np.ndarray]] = []  # for each length from 1: places, pieces
        at, h = np.arange(n, dtype=np.int32), np.zeros(n, np.uint64)
        for k, (slots, most, hashes, own) in enumerate(v.tables, 1):
            if k > 1:
                ok = left[at] >= k
                at, h = at[ok], h[ok]
            h = (h + code[at + (k - 1)] + np.uint64(1)) * FACTOR
            h ^= h >> np.uint64(29)
            slot = slots[(h & np.uint64(0x3FFFF)).astype(np.int32)]
            ok = np.flatnonzero(slot)
            at, h, slot = at[ok], h[ok], slot[ok]
            seek = np.flatnonzero(slot > 0)
            places, pieces = [at[:0]], [own[:0]]
            for turn in range(most):
                j = slot[seek].astype(np.int32) + (turn - 1)
                hit = hashes[j] == h[seek]
                places.append(at[seek[hit]])
                pieces.append(own[j[hit]])
                seek = seek[~hit]
            found.append((np.concatenate(places), np.concatenate(pieces)))
        single, piece_1 = found[0]
        first = np.zeros(n, np.int32)  # every place has one edge of one character: a piece, or its bytes
        first[single] = piece_1
        bare = np.ones(n, bool)
        bare[single] = False
        bare = np.flatnonzero(bare)
        first[bare] = -1 - len(self.spelled) - np.arange(len(bare))
        found[0] = (np.arange(n, dtype=np.int32), first)
        self.spelled += [v.bytes[np.frombuffer(chr(c).encode("utf-8", "surrogatepass"), np.uint8)] for c in code[bare].tolist()]
        # edges stand by the characters left in the word, by place, and long pieces first: most often taken
        order = np.argsort(left, kind="stable")
        width = np.zeros(n, np.int32)
        for at, _ in found:
            width[at] += 1
        free = width
        width = width[order]
        first = np.cumsum(width) - width
        edges = np.zeros(n, np.int64)
        edges[order] = first
        free = free + edges
        piece, goal = np.empty(int(width.sum()), np.int32), np.empty(int(width.sum()), np.int32)
        for k, (at, ids) in enumerate(found, 1):
            slot = free[at] - 1
            free[at] = slot
            piece[slot] = ids
            goal[slot] = np.where(left[at] == k, n, at + k)  # a word's end is place n
        weight = v.weight[np.maximum(piece, 0)]
        if len(bare):
            by_bytes = np.flatnonzero(piece < 0)
            weight[by_bytes] = [float(v.weight[self.spelled[i]].sum()) for i in (-1 - piece[by_bytes]).tolist()]
        logp, upto = weight, np.empty(len(weight))
        beta = np.zeros(n + 1)
        cut = np.cumsum(np.bincount(left))
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if i == j:
                continue
            s, e = int(first[i]), int(first[j]) if j < n else len(weight)
            own, many = first[i:j] - s, width[i:j]
            total = weight[s:e] + beta[goal[s:e]]
            top = np.maximum.reduceat(total, own)
            total -= np.repeat(top, many)
            p = np.exp(total)
            whole = np.add.reduceat(p, own)
            p *= np.repeat(GRAIN / whole, many)
            below = np.cumsum(p.astype(np.int64))  # whole numbers: no rounding from neighbours
            below -= np.repeat(np.r_[0, below[own[1:] - 1]], many)
            below[np.r_[own[1:], e - s] - 1] = 2 * GRAIN  # whatever rounding left
            np.divide(below, GRAIN, out=upto[s:e])
            whole = np.log(whole)
            total -= np.repeat(whole, many)
            np.minimum(total, 0.0, out=logp[s:e])
            beta[order[i:j]] = top + whole
        return edges, first, width, piece, goal, logp, upto

    def walk(self, at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Samples a path to the end from each place; the edges in order of the walkers, and their numbers."""
        who, step = np.arange(len(at)), 0
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        count = np.zeros(len(at), np.int64)
        while len(who):
            u = uniform(key[who] + np.uint64(step) * FACTOR)
            edge = self.edges[at]
            more = np.flatnonzero(u >= self.upto[edge])
            while len(more):
                edge[more] += 1
                more = more[u[more] >= self.upto[edge[more]]]
            taken.append((who, edge))
            count[who] += 1
            go = ~self.done[edge]
            who, at = who[go], self.to[edge[go]]
            step += 1
        out = np.empty(int(count.sum()), np.int64)
        base = np.cumsum(count) - count
        for k, (w, e) in enumerate(taken):
            out[base[w] + k] = e
        return out, count

    def siblings(self, edge: int) -> range:
        g = int(np.searchsorted(self.first, edge, side="right")) - 1
        return range(int(self.first[g]), int(self.first[g] + self.width[g]))


def bounded_gumbel(location: np.ndarray, limit: float, u: np.ndarray) -> np.ndarray:
    """Gumbel variates at the locations, given that they are below the limit."""
    return location - np.log(np.exp(np.minimum(location - limit, 700)) - np.log(u))


class Search:
    """One text's queue of subtrees: (bound, sample, place in its path, edges that are used up there). Sums of
    keys run over and logarithms reach minus infinity on purpose; `sample` silences both."""

    def __init__(self, key: np.uint64, k: int) -> None:
        self.key, self.k = key, k
        self.paths: list[tuple[np.ndarray, float]] = []
        self.queue: list[tuple[float, int, int, tuple[int, ...]]] = []
        self.bound = float(-np.log(-np.log(uniform(np.array([key ^ np.uint64(0xA5A5A5A5)], np.uint64))))[0])

    def add(self, lattice: Lattice, path: np.ndarray, base: int) -> None:
        """A new sample whose path differs from its parent's from `base` on; its side subtrees join the queue."""
        number = len(self.paths)
        self.paths.append((path, self.bound))
        logp = lattice.logp[path]
        prefix = np.cumsum(logp) - logp
        side = prefix[base:] + np.log(-np.expm1(logp[base:]))
        x = bounded_gumbel(side, self.bound, uniform(self.key + np.uint64(number + 1) * np.uint64(0xD1B54A32D192ED03) + np.arange(base, len(path), dtype=np.uint64)))
        x[~np.isfinite(side)] = -np.inf
        need = self.k + 1
        best = np.argpartition(-x, need)[:need] if len(x) > need else np.arange(len(x))
        for t in best.tolist():
            if x[t] > -np.inf:
                heapq.heappush(self.queue, (-float(x[t]), number, base + t, (int(path[base + t]),)))

    def pop(self, lattice: Lattice) -> tuple[np.ndarray, int] | None:
        """The prefix of the next sample, with its new edge; what is left of the subtree goes back."""
        if not self.queue:
            return None
        x, number, t, used = heapq.heappop(self.queue)
        self.bound = -x
        path = self.paths[number][0]
        rest = np.array([e for e in lattice.siblings(used[0]) if e not in used], np.int64)
        p = np.exp(lattice.logp[rest])
        u = uniform(self.key + np.uint64(len(self.paths) + 1) * np.uint64(0x8CB92BA72F3D8DD7) + np.arange(2, dtype=np.uint64))
        pick = min(int(np.searchsorted(np.cumsum(p), u[0] * p.sum(), side="right")), len(rest) - 1)
        left = float(p.sum() - p[pick])
        if len(rest) > 1 and left > 0:
            location = float(lattice.logp[path[:t]].sum()) + np.log(left)
            heapq.heappush(self.queue, (-float(bounded_gumbel(np.array([location]), self.bound, u[1:])[0]), number, t, (*used, int(rest[pick]))))
        return np.append(path[:t], rest[pick]), t


def words_of(texts: list[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of some texts, the number of each word in a row, and where each text's words begin."""
    column = pc.fill_null(pa.array(texts, pa.large_string()), "")
    split = pc.split_pattern(column, " ")
    plain = split.flatten()
    start = split.offsets.to_numpy().copy()
    size = np.diff(start)
    # where words aren't just what stands between single spaces
    odd = pc.match_substring_regex(column, f"^ |  | $|{SPACE}|^$").to_numpy(zero_copy_only=False)
    own = [[w[1:] for w in WORDS.findall(SPACE + texts[i].replace(" ", SPACE))] if texts[i] else [] for i in np.flatnonzero(odd).tolist()]
    size[odd] = list(map(len, own))
    start[:-1][odd] = len(plain) + np.cumsum([0, *map(len, own)])[:-1]
    row = np.r_[0, np.cumsum(size)]
    at = np.repeat(start[:-1] - row[:-1], size) + np.arange(row[-1])
    coded = pa.concat_arrays([plain, pa.array([w for s in own for w in s], pa.large_string())]).take(pa.array(at)).dictionary_encode()
    return pc.binary_join_element_wise(pa.scalar(SPACE, pa.large_string()), coded.dictionary, pa.scalar("", pa.large_string())), coded.indices.to_numpy().astype(np.int64), row


def sample(v: Vocabulary, texts: list[str | None], keys: np.ndarray, k: int, seed: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text its samples in order: ids, log-probability, perturbed log-probability, inclusion score."""
    distinct, word, row = words_of(texts)
    with np.errstate(over="ignore", divide="ignore"):
        key = mix(keys.astype(np.uint64) * FACTOR + np.uint64(seed))
        searches = [Search(x, k) for x in key]
        if not len(word):
            return [[(np.zeros(0, np.int64), 0.0, s.bound, 1.0)] for s in searches]
        lattice = Lattice(v, distinct)
        owner = np.repeat(np.arange(len(texts)), np.diff(row))
        inside = (np.arange(len(word)) - row[owner]).astype(np.uint64)
        word_key = mix(key[owner] + inside * np.uint64(0xA0761D6478BD642F))
        edges, n_edges = lattice.walk(lattice.begin[word], word_key)
        place = np.r_[0, np.cumsum(n_edges)]
        for i, s in enumerate(searches):
            s.add(lattice, edges[place[row[i]] : place[row[i + 1]]], 0)
        for turn in range(1, k):
            at, own_key, todo = [], [], []
            for i, s in enumerate(searches):
                if (got := s.pop(lattice)) is not None:
                    head, t = got
                    w = int(np.count_nonzero(lattice.done[head[:-1]]))  # the word that changes
                    open_ = not lattice.done[head[-1]]
                    first = row[i] + w + 1
                    at.append(np.r_[lattice.to[head[-1:]], lattice.begin[word[first : row[i + 1]]]] if open_ else lattice.begin[word[first : row[i + 1]]])
                    own_key.append(mix(word_key[first - open_ : row[i + 1]] + np.uint64(turn) * np.uint64(0xE7037ED1A0B428DB)))
                    todo.append((i, head, t, len(at[-1])))
            if not todo:
                break
            edges, n_edges = lattice.walk(np.concatenate(at).astype(np.int64), np.concatenate(own_key))
            place, base = np.r_[0, np.cumsum(n_edges)], 0
            for i, head, t, m in todo:
                searches[i].add(lattice, np.concatenate([head, edges[place[base] : place[base + m]]]), t + 1)
                base += m
        out = []
        for s in searches:
            limit = -s.queue[0][0] if s.queue and len(s.paths) == k else -np.inf
            mine = []
            for path, bound in s.paths:
                logp = float(lattice.logp[path].sum())
                mine.append((_ids(lattice, path), logp, bound, float(-np.expm1(-np.exp(min(700.0, logp - limit)))) if np.isfinite(limit) else 1.0))
            out.append(mine)
    return out


def _ids(lattice: Lattice, path: np.ndarray) -> np.ndarray:
    ids = lattice.piece[path]
    spelled = np.flatnonzero(ids < 0)
    if not len(spelled):
        return ids
    parts, last = [], 0
    for i in spelled.tolist():
        parts += [ids[last:i], lattice.spelled[-1 - int(ids[i])]]
        last = i + 1
    return np.concatenate([*parts, ids[last:]])


def encode(docs: DataFrame, k: int = 2, model: str = "piece_bpe_32k.model", seed: int = 0) -> DataFrame:
    """doc_id, sample (from 1), ids, log_prob, perturbed, inclusion and round_trip of every row and sample;
    round_trip tells whether the ids decode to the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in gathered(batches, GATHER):
            for part in slices(batch, limit=SLICE):
                texts = part.column("text").to_pylist()
                keys = part.column("doc_id").cast(pa.int64()).fill_null(0).to_numpy()
                samples = sample(v, texts, keys, k, seed)
                take = [i for i, own in enumerate(samples) for _ in own]
                number = [n for own in samples for n in range(1, len(own) + 1)]
                ids, logp, bound, score = zip(*[x for own in samples for x in own], strict=True)
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.concatenate(ids).astype(np.int32)
                same = v.spell(flat, offsets, [(t or "").replace(SPACE, " ").encode() for t in texts], take)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(take)), pa.array(number, pa.int32()), lists, pa.array(logp), pa.array(bound), pa.array(score), pa.array(same)],
                    names=["doc_id", "sample", "ids", "log_prob", "perturbed", "inclusion", "round_trip"],
                )
                del samples, ids, flat, lists
                trim()

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(freed(run), f"doc_id {kind}, sample int, ids array<int>, log_prob double, perturbed double, inclusion double, round_trip boolean")


def decode(encoded: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """All columns with `text` from `ids`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            text = [v.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], names=[*batch.schema.names, "text"])

    return encoded.mapInArrow(freed(run), ", ".join([f"`{c}` {t}" for c, t in encoded.dtypes] + ["text string"]))
