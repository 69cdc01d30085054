"""Operator 9, SimHash near-duplicates: fingerprints, a Gray-order hierarchical index, components.

A fingerprint has bit i if over half of the 64-bit hashes of the text's shingles have it. Fingerprints link at
`max_bits` or fewer differing bits. Equal fingerprints are one node, so exact copies never meet pairwise.

Links are found exactly: the 64 bits are cut into max_bits + 2 blocks, and two linked fingerprints agree on two
blocks at least, so each fingerprint goes to one group for each pair of blocks. In a group the fingerprints
stand in Gray order under a tree: a node holds the bits that all its members share and its parent's don't,
a search adds up the differences from the root on and leaves a node once they exceed the limit. A group with
more than GROUP members is dealt anew by the same rule over its free bits; what agrees on 48 of 64 bits has at
most 65,536 distinct members, so no task holds an unbounded group. A group reports a spanning forest of its
links, not all pairs. Components come from alternating large-star and small-star steps over tables in the
shared folder; nothing is collected.

`similar_groups`, the pipeline's stage, asks for a shingle similarity instead of differing bits. It has fingerprints
of 64 * WIDE bits and the same index over them (`GrayForest`, a tree for each group): every link between different
sets is a pair that a search of the index found and the shingles confirmed.

Defined cases: a null or empty text has fingerprint zero and links like any other; fewer words than a shingle:
the whole sequence is the one shingle; a null doc_id counts after all others; repeated rows each get a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.llm import chunks
from rowsmith.llm.common import Bitmap, bounds, drop_since, freed, join_copies, made, raw, slices, write_table

GROUP = 4096  # members of a group before it is dealt anew
BRUTE = 16  # groups up to this size are compared directly
FAN = 8  # children of a node of the index
QUERIES_AT_ONCE = 512
SIGN = 1 << 63


def shingle_hashes(text: bytes | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of `words` words (repeats included), A-Z lower-cased."""
    joined = b" ".join((text or b"").lower().split())
    if not joined:
        return np.zeros(0, np.uint64)
    starts, ends = bounds(joined)
    digest = xxhash.xxh64_digest
    got = [digest(joined[s:e], seed) for s, e in zip(starts, ends[words - 1 :] or ends[-1:], strict=False)]
    return np.frombuffer(b"".join(got), ">u8").astype(np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The majority of each bit, as an unsigned integer."""
    if not len(hashes):
        return 0
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        bits += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                fps = np.array([fingerprint(shingle_hashes(t, words, seed)) for t in raw(part.column("text"))], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(freed(run), f"doc_id {dict(docs.dtypes)['doc_id']}, fp bigint")


def signed(x: int) -> int:
    return x - (1 << 64) if x >= SIGN else x


def block_masks(bits: list[int], max_bits: int) -> list[int]:
    """One mask for each pair of the blocks that the given bit positions are cut into."""
    blocks = [sum(1 << int(b) for b in part) for part in np.array_split(bits, max_bits + 2)]
    return [a | b for a, b in combinations(blocks, 2)]


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The position of each fingerprint in the reflected Gray sequence."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class GrayIndex:
    """A tree over fingerprints in Gray order; see the module's text."""

    def __init__(self, fps: np.ndarray) -> None:
        self.fps = fps[np.argsort(gray_rank(fps), kind="stable")]
        self.levels = []  # from leaves' parents to the root: (start of each node, shared mask, pattern)
        ones, zeros = self.fps, ~self.fps
        while len(ones) > 1:
            cuts = np.arange(0, len(ones), FAN)
            ones, zeros = np.bitwise_and.reduceat(ones, cuts), np.bitwise_and.reduceat(zeros, cuts)
            self.levels.append((ones | zeros, ones))

    def search(self, queries: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions (query, member) of all pairs within max_bits."""
        at = np.arange(len(queries))
        node = np.zeros(len(at), np.int64)
        used, known = np.zeros(len(at), np.int64), np.zeros(len(at), np.uint64)
        for depth in range(len(self.levels) - 1, -1, -1):
            shared, pattern = self.levels[depth]
            used = used + np.bitwise_count((queries[at] ^ pattern[node]) & shared[node] & ~known)
            keep = used <= max_bits
            at, node, used, known = at[keep], node[keep], used[keep], shared[node[keep]]
            below = len(self.levels[depth - 1][0]) if depth else len(self.fps)
            child = (node[:, None] * FAN + np.arange(FAN)).ravel()
            at, used, known = (np.repeat(x, FAN) for x in (at, used, known))
            real = child < below
            at, node, used, known = at[real], child[real], used[real], known[real]
        used = used + np.bitwise_count((queries[at] ^ self.fps[node]) & ~known)
        keep = used <= max_bits
        return at[keep], node[keep]


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of the links a-b those that join what wasn't joined yet."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def group_links(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links in one group of distinct fingerprints."""
    index = GrayIndex(fps)
    out_a, out_b = [], []
    for at in range(0, len(fps), QUERIES_AT_ONCE):
        q, m = index.search(index.fps[at : at + QUERIES_AT_ONCE], max_bits)
        more = m > q + at
        links = forest(q[more] + at, m[more])
        out_a += [x for x, _ in links]
        out_b += [y for _, y in links]
    return [(int(index.fps[x]), int(index.fps[y])) for x, y in forest(np.array(out_a, np.int64), np.array(out_b, np.int64))]


def links(fps: DataFrame, max_bits: int) -> DataFrame:
    """a, b: links that join every pair of fingerprints in the same component; `fps` has distinct fp."""

    def dealt(df: DataFrame, masks: list[int], extra: list) -> DataFrame:
        keys = F.array(*[F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("v")) for i, m in enumerate(masks)])
        return df.select("fp", *extra, F.explode(keys).alias("key")).select("fp", *extra, "key.k", "key.v")

    masks = block_masks(list(range(64)), max_bits)
    once = dealt(fps, masks, [])
    sizes = once.groupBy("k", "v").agg(F.count("*").alias("size")).filter("size > 1")
    sized = once.join(sizes, ["k", "v"])
    cold = sized.filter(F.col("size") <= GROUP).select("fp", F.col("k"), F.col("v"), F.lit(-1).alias("k2"), F.lit(0).cast("bigint").alias("v2"))
    hot = None
    for i, mask in enumerate(masks):
        free = [b for b in range(64) if not mask >> b & 1]
        own = sized.filter((F.col("size") > GROUP) & (F.col("k") == i)).select("fp", F.col("k").alias("k1"), F.col("v").alias("v1"))
        own = dealt(own, block_masks(free, max_bits), ["k1", "v1"]).select("fp", F.col("k1").alias("k"), F.col("v1").alias("v"), F.col("k").alias("k2"), F.col("v").alias("v2"))
        hot = own if hot is None else hot.unionByName(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; small groups are compared together, the others one by one."""
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy() for c in ("k", "v", "k2", "v2", "fp")], axis=1))
            if sum(map(len, held)) >= 50_000:
                rows = np.concatenate(held)
                last = int(np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(axis=1))[-1]) + 1 if (rows[:, :4] != rows[-1, :4]).any() else 0
                held = [rows[last:]]
                yield from answer(rows[:last])
        if held:
            yield from answer(np.concatenate(held))

    def answer(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(rows):
            return
        cut = np.flatnonzero(np.r_[True, (rows[1:, :4] != rows[:-1, :4]).any(axis=1)])
        size = np.diff(np.r_[cut, len(rows)])
        fps = rows[:, 4].astype(np.int64).view(np.uint64)
        small = np.repeat(size <= BRUTE, size)
        group = np.repeat(np.arange(len(cut)), size)
        a, b = [], []
        for shift in range(1, BRUTE):
            x, y = fps[:-shift], fps[shift:]
            near = small[:-shift] & (group[:-shift] == group[shift:]) & (np.bitwise_count(x ^ y) <= max_bits)
            a.append(x[near])
            b.append(y[near])
        found = forest(np.concatenate(a), np.concatenate(b)) if a else []
        for g in np.flatnonzero(size > BRUTE).tolist():
            found += group_links(fps[cut[g] : cut[g] + size[g]], max_bits)
        if found:
            pairs = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    groups = cold.unionByName(hot).withColumn("k", F.col("k").cast("bigint")).withColumn("k2", F.col("k2").cast("bigint"))
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["k", "v", "k2", "v2"]
    return groups.repartition(n, *key).sortWithinPartitions(*key).select(*key, "fp").mapInArrow(freed(run), "a bigint, b bigint").distinct()


def components(edges: DataFrame, label: str = "component") -> DataFrame:
    """node, root: the smallest node of each node's component; nodes without an edge aren't in it."""
    edges = write_table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), label)
    spark, mark, state = edges.sparkSession, made() - 1, None
    while True:
        # large star: every larger neighbour of a node gets the node's smallest neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours get the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = write_table(small.filter("a <> b").distinct(), label)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_since(spark, mark, edges)
        if now == state:
            break
        state = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 2) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links reach."""
    fps = write_table(fingerprints(docs, words), "simhash")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    roots = components(links(nodes.select("fp"), max_bits))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root"))
    firsts = named.groupBy("root").agg(F.min("least").alias("component_id"))
    whole = write_table(named.join(firsts, "root").select("fp", "copies", "component_id"), "simhash-components")
    return join_copies(fps, whole, ["fp"]).select("doc_id", "fp", "component_id")


# Near duplicates by similarity: wider fingerprints, the index over them, verified on the shingles themselves.

WIDE = 4  # 64-bit words of a fingerprint
TABLES = 16
SAMPLED = 20  # bits of a table's key
DEAL = 16, 8  # tables and bits by which a group with over GROUP members is dealt anew
LOOSE = 1.5  # times the expected differing bits; verification decides
ALL_PAIRS = 16  # groups up to this size give all their close pairs, larger ones the closest spanning forest
SAMPLE_SETS = 16_000  # sets in which shingles are counted for the order of the exact join
COMMON = 100_000  # shingles that the order knows to be frequent
SURE = 6.8  # standard deviations beyond the expected differing bits at which a pair can't be similar
FEW_SHINGLES = 64  # pairs with a set under this size are near at any number of differing bits
PAIRS_AT_ONCE = 50_000  # arrays of a search stay under 2 MB, so that a worker gives them back


def wide_gray_ranks(fps: np.ndarray) -> np.ndarray:
    """`gray_rank` of rows of several words, the first word the highest."""
    ranks = gray_rank(fps)
    odd = ranks & np.uint64(1)  # the parity of each word
    above = np.bitwise_xor.accumulate(odd, axis=1) ^ odd
    return np.where(above == 1, ~ranks, ranks)


class GrayForest:
    """The index of `GrayIndex` over wide fingerprints, a tree for each of many groups; `group` numbers them from
    0 on. Wanted are pairs of a group with rank[i] < rank[j], so a node also holds its members' highest rank, and
    a search leaves it where none is wanted. A node's shared bits include its parent's, so the differences in
    them are the sum from the root on."""

    def __init__(self, fps: np.ndarray, group: np.ndarray, rank: np.ndarray) -> None:
        self.order = np.lexsort((*wide_gray_ranks(fps).T[::-1], group))
        self.fps, self.rank, self.group = fps[self.order], rank[self.order], group[self.order]
        self.levels = []  # from leaves' parents on: shared mask, pattern, highest rank, first child, children
        many = int(self.group[-1]) + 1 if len(fps) else 0
        self.root, self.depth, self.top = (np.zeros(many, np.int64) for _ in range(3))  # of each group
        ones, zeros, top, g, place = self.fps, ~self.fps, self.rank, self.group, np.arange(len(fps))
        while len(g):
            begin = np.flatnonzero(chunks.new_class(g))
            nth = np.arange(len(g)) - np.repeat(begin, np.diff(np.r_[begin, len(g)]))
            cuts = np.flatnonzero(nth % FAN == 0)
            ones, zeros, top = np.bitwise_and.reduceat(ones, cuts), np.bitwise_and.reduceat(zeros, cuts), np.maximum.reduceat(top, cuts)
            self.levels.append((ones | zeros, ones, top, place[cuts], np.diff(np.r_[cuts, len(g)])))
            g = g[cuts]
            fresh = chunks.new_class(g)
            alone = fresh & np.r_[fresh[1:], True]  # a group's only node is its root
            self.root[g[alone]], self.depth[g[alone]], self.top[g[alone]] = np.flatnonzero(alone), len(self.levels) - 1, top[alone]
            place = np.flatnonzero(~alone)
            ones, zeros, top, g = ones[place], zeros[place], top[place], g[place]

    def search(self, at: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places (query, member) of all wanted pairs of the queries at the places `at` within most[place] bits, and
        their differing bits."""

        def near(q: np.ndarray, x: np.ndarray, mask: np.ndarray | None, top: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, ...]:
            ok = top[of] > self.rank[q]
            q, of = q[ok], of[ok]
            differ = self.fps[q] ^ x[of]
            used = np.bitwise_count(differ if mask is None else differ & mask[of]).sum(axis=1, dtype=np.int64)
            ok = used <= most[q]
            return q[ok], of[ok], used[ok]

        depth = self.depth[self.group[at]]
        q = node = np.zeros(0, np.int64)
        for d in range(len(self.levels) - 1, -1, -1):
            shared, pattern, top, first, many = self.levels[d]
            q, node, _ = near(q, pattern, shared, top, node)
            start = at[depth == d]  # a query is a member of its group, so no bit differs at the root
            q, node = np.r_[q, start], np.r_[node, self.root[self.group[start]]]
            size = many[node]
            node = np.repeat(first[node] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            q = np.repeat(q, size)
        return near(q, self.fps, None, self.rank, node)

    def pairs(self, most: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows i, j as given, and differing bits, of all wanted pairs within most[i] bits, in parts."""
        at = np.flatnonzero(self.top[self.group] > self.rank)
        work, most, done = np.cumsum(np.bincount(self.group)[self.group[at]]), most[self.order], 0
        while done < len(at):
            upto = max(done + 1, int(np.searchsorted(work, (work[done - 1] if done else 0) + PAIRS_AT_ONCE)))
            i, j, used = self.search(at[done:upto], most)
            yield self.order[i], self.order[j], used
            done = upto


def wide_pairs(fps: np.ndarray, group: np.ndarray, rank: np.ndarray, most: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """`GrayForest.pairs` of the rows."""
    return GrayForest(fps, group, rank).pairs(most)


def _bit_sets(tables: int, bits: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.stack([rng.choice(64 * WIDE, bits, replace=False) for _ in range(tables)])


def _keys(fps: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """For each fingerprint (rows of WIDE words) and table the sampled bits, above them the table's number."""
    out = np.zeros((len(fps), len(sets)), np.int64)
    for t, places in enumerate(sets):
        for p in places.tolist():
            out[:, t] = out[:, t] << 1 | (fps[:, p // 64] >> np.uint64(p % 64) & np.uint64(1)).astype(np.int64)
        out[:, t] += t << sets.shape[1]
    return out


def most_bits(similarity: float) -> int:
    """Differing bits allowed to candidates for a Jaccard similarity."""
    cosine = 2 * similarity / (1 + similarity)
    return int(LOOSE * 64 * WIDE * np.arccos(cosine) / np.pi)


def shingle_table(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, the wide fingerprint f0.., the distinct shingles as sorted 32-bit hashes, and a hash of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                fps, sets, names = [], [], []
                for text in raw(part.column("text")):
                    h = np.unique(shingle_hashes(text, words))
                    fps.append([fingerprint(h), *[fingerprint(_stir(h, i)) for i in range(1, WIDE)]])
                    own = np.unique((h >> np.uint64(32)).astype(np.uint32)).tobytes()
                    sets.append(own)
                    names.append(xxhash.xxh3_64_intdigest(h.tobytes()))
                f = np.array(fps, np.uint64).reshape(-1, WIDE).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[pa.array(f[:, i].copy()) for i in range(WIDE)], pa.array(np.array(names, np.uint64).view(np.int64)), pa.array(sets, pa.binary())],
                    names=["doc_id", *[f"f{i}" for i in range(WIDE)], "set_id", "shingles"],
                )

    words_ = ", ".join(f"f{i} bigint" for i in range(WIDE))
    return docs.select("doc_id", "text").mapInArrow(freed(run), f"doc_id {dict(docs.dtypes)['doc_id']}, {words_}, set_id bigint, shingles binary")


def _stir(h: np.ndarray, i: int) -> np.ndarray:
    h = (h ^ np.uint64(0x9E3779B97F4A7C15 * i % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def candidates(nodes: DataFrame, similarity: float) -> DataFrame:
    """a, b: nodes (distinct shingle sets) whose wide fingerprints are close, by the index of each group of those that
    agree on a table's bits. Not all of them: groups are reduced and the largest cut, so that copies are settled cheaply before `exact_pairs`."""
    f = [f"f{i}" for i in range(WIDE)]
    most = most_bits(similarity)

    def spread(sets: np.ndarray, keep: str | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                fps = np.stack([b.column(c).to_numpy() for c in f], axis=1).view(np.uint64)
                keys = _keys(fps, sets)
                row = pa.array(np.repeat(np.arange(len(fps)), len(sets)))
                upper = b.column(keep) if keep else pa.array(np.zeros(len(fps), np.int64))
                yield pa.RecordBatch.from_arrays([upper.take(row), pa.array(keys.ravel()), *[b.column(c).take(row) for c in ("node", *f)]], names=["upper", "k", "node", *f])

        return run

    schema = "upper bigint, k bigint, node bigint, " + ", ".join(f"{c} bigint" for c in f)
    dealt = nodes.select("node", *f).mapInArrow(freed(spread(_bit_sets(TABLES, SAMPLED, 1), None)), schema)
    sizes = dealt.groupBy("k").agg(F.count("*").alias("size")).filter(F.col("size") > GROUP)
    # tables have 2**SAMPLED keys each; at most (rows / GROUP) of them are large
    large = write_table(sizes.select("k"), "simhash-large")
    cold = dealt.join(large, "k", "left_anti")
    hot = dealt.join(large, "k", "left_semi").select(F.col("k").alias("old"), "node", *f)
    hot = hot.mapInArrow(freed(spread(_bit_sets(*DEAL, 2), "old")), schema).withColumn("upper", F.col("upper") + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            held.append(np.stack([b.column(c).to_numpy() for c in ("upper", "k", "node", *f)], axis=1))
            if sum(map(len, held)) >= 50_000:
                rows = np.concatenate(held)
                other = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
                last = int(other[-1]) + 1 if len(other) else len(rows)  # of a larger group, what is held
                held = [rows[last:]]
                yield from close(rows[:last])
        if held:
            yield from close(np.concatenate(held))

    def close(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(rows):
            return
        cut = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
        size = np.diff(np.r_[cut, len(rows)])
        fps, node = np.ascontiguousarray(rows[:, 3:]).view(np.uint64), rows[:, 2]
        a, b = [node[:0]], [node[:0]]
        few = np.flatnonzero(np.repeat(size <= ALL_PAIRS, size))
        own = np.repeat(np.arange(int((size <= ALL_PAIRS).sum())), size[size <= ALL_PAIRS])
        for x, y, _ in wide_pairs(fps[few], own, np.arange(len(few)), np.full(len(few), most)):
            a.append(node[few[x]])
            b.append(node[few[y]])
        for g in np.flatnonzero(size > ALL_PAIRS).tolist():
            for at in range(int(cut[g]), int(cut[g] + size[g]), GROUP):  # exact_pairs has the pairs across
                x, y = _closest(fps[at : min(at + GROUP, cut[g] + size[g])], most)
                a.append(node[at + x])
                b.append(node[at + y])
        x, y = np.concatenate(a), np.concatenate(b)
        if len(x):
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = cold.unionByName(hot.select(cold.columns)).repartition(n, "upper", "k").sortWithinPartitions("upper", "k")
    return groups.select("upper", "k", "node", *f).mapInArrow(freed(run), "a bigint, b bigint").distinct()


def _closest(fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the close pairs, built from the closest pairs on, part by part."""
    kept = np.zeros((0, 3), np.int64)
    for x, y, d in wide_pairs(fps, np.zeros(len(fps), np.int64), np.arange(len(fps)), np.full(len(fps), most)):
        kept = np.concatenate([kept, np.stack([d, x, y], axis=1)])
        kept = kept[np.argsort(kept[:, 0], kind="stable")]
        pairs = forest(kept[:, 1], kept[:, 2])
        distance = {(int(p), int(q)): int(k) for k, p, q in kept}
        kept = np.array([(distance[p], *p) for p in pairs], np.int64).reshape(-1, 3)
    return kept[:, 1], kept[:, 2]


def common_shingles(nodes: DataFrame, table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles of a bounded sample of sets, sorted, and how many of the sets have each. They only give the
    order of `exact_pairs`, which is exact under any order."""
    share = min(1.0, SAMPLE_SETS / max(1, nodes.count()))
    chosen = table.filter(F.xxhash64("set_id", F.lit(1)).bitwiseAND(F.lit((1 << 53) - 1)) < share * (1 << 53))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            fresh = []
            for name, x in zip(b.column("set_id").to_pylist(), b.column("shingles").to_pylist(), strict=True):
                if name not in seen:
                    seen.add(name)
                    fresh.append(np.frombuffer(x, np.uint32))
            if fresh:
                value, n = np.unique(np.concatenate(fresh), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.astype(np.int64)), pa.array(n)], names=["shingle", "n"])

    counted = chosen.select("set_id", "shingles").mapInArrow(freed(run), "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    got = counted.filter("n > 2").orderBy(F.desc("n"), "shingle").limit(COMMON).toArrow()
    value, n = got.column("shingle").to_numpy().astype(np.uint32), got.column("n").to_numpy()
    at = np.argsort(value)
    return value[at], n[at]


def prefix(shingles: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The rarest shingles of a sorted set, as many as a similar set must share one of."""
    n = len(shingles)
    weight = np.zeros(n, np.int64)
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], shingles), len(common[0]) - 1)
        weight = np.where(common[0][at] == shingles, common[1][at], 0)
    first = np.argsort(weight << 32 | shingles.astype(np.int64), kind="stable")
    return shingles[first[: n - math.ceil(similarity * n - 1e-6) + 1]] if n else shingles


def sure_bits(similarity: float) -> int:
    """Differing bits over which a pair is taken for not similar. If each bit differs with the same chance,
    independently, as majorities of many hashes do nearly, a pair of similarity 0.8 has more with a chance of 2 in
    10**10 (the binomial tail); more similar pairs with a smaller one."""
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return math.ceil(64 * WIDE * p + SURE * math.sqrt(64 * WIDE * p * (1 - p)))


def shared_shingles(short: DataFrame) -> DataFrame:
    """k, node, place: prefix shingles that several nodes have. `short` has node and prefix."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.frombuffer(x, np.uint32) for x in b.column("prefix").to_pylist()]
            length = np.array([len(x) for x in sets], np.int64)
            row = np.repeat(np.arange(len(sets)), length)
            place = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
            key = np.concatenate([*sets, np.zeros(0, np.uint32)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key << 31 | place), b.column("node").take(pa.array(row))], names=["kp", "node"])

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by k; those whose k no neighbour has go."""
        held: np.ndarray | None = None  # the last row, whose successor isn't known yet
        before = -1  # the k before it
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.stack([b.column("kp").to_numpy(), b.column("node").to_numpy()], axis=1)
            rows = rows if held is None else np.concatenate([held, rows])
            k = rows[:, 0] >> 31
            twin = np.r_[k[0] == before, k[1:] == k[:-1]]
            ok = (twin | np.r_[twin[1:], False])[:-1]
            yield packed(rows[:-1][ok])
            held, before = rows[-1:], int(k[-2]) if len(k) > 1 else before
        if held is not None and held[0, 0] >> 31 == before:
            yield packed(held)

    def packed(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 0] >> 31), pa.array(rows[:, 0] & (1 << 31) - 1), pa.array(rows[:, 1].copy())], names=["k", "place", "node"])

    thin = short.select("node", "prefix").mapInArrow(freed(spread), "kp bigint, node bigint")
    n = int(short.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return thin.repartition(n, F.shiftright("kp", 31)).sortWithinPartitions("kp").mapInArrow(freed(several), "k bigint, place bigint, node bigint")


def exact_pairs(table: DataFrame, named: DataFrame, similarity: float) -> DataFrame:
    """a, b: pairs of nodes in different components, every pair of similar sets among them; `named` has node,
    set_id, root. Two sets of similarity t share at least t / (1 + t) of their sizes' sum, so under one order of
    all shingles their prefixes share one, and each shared shingle makes a group. The Gray-order index of a group
    finds the pairs whose fingerprints are near enough; places in the prefixes bound what these can share."""
    common = common_shingles(named, table)
    need, most = similarity / (1 + similarity), sure_bits(similarity)
    f = [f"f{i}" for i in range(WIDE)]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.frombuffer(x, np.uint32) for x in b.column("shingles").to_pylist()]
            own = [prefix(x, similarity, common).tobytes() for x in sets]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("set_id"), *[b.column(c) for c in f], pa.array([len(x) for x in sets], pa.int64()), pa.array(own, pa.binary())], names=["node", "set_id", *f, "n", "prefix"])

    short = table.select("doc_id", "set_id", *f, "shingles").mapInArrow(freed(prefixes), "node bigint, set_id bigint, " + ", ".join(f"{c} bigint" for c in f) + ", n bigint, prefix binary")
    short = write_table(short.join(named, ["node", "set_id"]).dropDuplicates(["node", "set_id"]).drop("set_id"), "prefixes")
    shared = write_table(shared_shingles(short), "prefixes-shared")
    groups = bounded_groups(shared.join(short.select("node", "root", "n", *f), "node"))
    columns = ["k", "part", "own", "node", "root", "n", "place", *f]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            held.append(np.stack([b.column(c).to_numpy() for c in columns], axis=1))
            if sum(map(len, held)) >= 50_000:
                rows = np.concatenate(held)
                other = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
                last = int(other[-1]) + 1 if len(other) else 0
                held = [rows[last:]]
                yield from compare(rows[:last])
        if held:
            yield from compare(np.concatenate(held))

    def compare(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group and root; the index gives the near pairs of a group with different roots. The
        query is of the root with fewer rows in the group, so those of a large component aren't paired."""
        if not len(rows):
            return
        first = chunks.new_class(rows[:, 0], rows[:, 1], rows[:, 4])  # of its group and root
        group = np.cumsum(chunks.new_class(rows[:, 0], rows[:, 1])) - 1
        several = np.bincount(group[first])[group] > 1
        rows, root = rows[several], (np.cumsum(first) - 1)[several]
        if not len(rows):
            return
        group = np.cumsum(chunks.new_class(rows[:, 0], rows[:, 1])) - 1
        rank = np.argsort(np.argsort(np.bincount(root), kind="stable"), kind="stable")[root]
        reach = np.where(similarity * rows[:, 5] < FEW_SHINGLES + 1e-6, 64 * WIDE, most)
        for i, j, differ in wide_pairs(np.ascontiguousarray(rows[:, 7:]).view(np.uint64), group, rank, reach):
            yield from emit(rows, i, j, differ)

    def emit(rows: np.ndarray, i: np.ndarray, j: np.ndarray, differ: np.ndarray) -> Iterator[pa.RecordBatch]:
        own, node, n, place = rows[:, 2], rows[:, 3], rows[:, 5], rows[:, 6]
        ok = (own[i] != own[j]) | (own[i] < 0)  # a group of two blocks compares across them only
        ok &= (differ <= most) | (np.minimum(n[i], n[j]) < FEW_SHINGLES)
        i, j = i[ok], j[ok]
        both = np.ceil(need * (n[i] + n[j]) - 1e-6)
        can = np.minimum(place[i], place[j]) + np.minimum(n[i] - place[i], n[j] - place[j])
        ok = (can >= both) & (place[i] <= n[i] - both) & (place[j] <= n[j] - both)
        pairs = np.unique(np.sort(np.stack([node[i[ok]], node[j[ok]]], axis=1), axis=1), axis=0)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    count = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = groups.select(*columns).repartition(count, "k", "part").sortWithinPartitions("k", "part", "root")
    return groups.mapInArrow(freed(run), "a bigint, b bigint").distinct()


def bounded_groups(dealt: DataFrame) -> DataFrame:
    """Rows with k, part and own: a group over GROUP members is dealt into blocks by a hash of the node, and each
    pair of blocks is a part of about GROUP members, so every pair of members meets in one; `own` is the block,
    -1 in a group that stays whole."""
    sizes = dealt.groupBy("k").agg(F.count("*").alias("size")).filter(F.col("size") > GROUP)
    large = write_table(sizes, "prefix-large")
    zero = F.lit(0).cast("bigint")
    cold = dealt.join(large, "k", "left_anti").withColumn("part", zero).withColumn("own", zero - 1)
    hot = dealt.join(large, "k").withColumn("blocks", F.ceil(F.col("size") * 2 / F.lit(GROUP)))
    hot = hot.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    hot = hot.withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    hot = hot.withColumn("part", F.least("own", "other") * F.col("blocks") + F.greatest("own", "other"))
    hot = hot.withColumn("own", F.when(F.col("own") == F.col("other"), zero - 1).otherwise(F.col("own")))
    return cold.unionByName(hot.select(cold.columns))


def verified(pairs: DataFrame, table: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs a, b of nodes those with similar sets. A bitmap of the pairs' nodes keeps most other sets where
    they are."""
    ids = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    some = Bitmap(ids.select(F.xxhash64("node").alias("h")), "h")

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(some.may(b.column("h").to_numpy().view(np.uint64)))).drop_columns(["h"])

    sets = table.select("doc_id", "set_id", "shingles", F.xxhash64("doc_id").alias("h")).mapInArrow(freed(wanted), "doc_id bigint, set_id bigint, shingles binary")
    sets = write_table(sets.join(ids, sets.doc_id == ids.node, "left_semi").dropDuplicates(["doc_id", "set_id"]).select("doc_id", "shingles"), "sets")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(both >= similarity * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(freed(verify), "a bigint, b bigint")


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, component_id of every row with a doc_id: documents whose sets of `words`-word shingles have a
    Jaccard similarity of at least `similarity`, directly or through others, share the smallest doc_id.

    Equal sets are one node. Nodes have fingerprints of 64 * WIDE bits and are dealt into groups; the Gray-order
    index of each group finds its near pairs, which are verified on the shingles. In a first round groups agree on
    sampled bits (TABLES ways); this finds most links but not all, and decides no pair against a link. In the
    second the members of a group share a rare shingle, so every pair of different components that can be similar
    meets in one, and the index is searched up to `sure_bits`, for sets that may pair with one under FEW_SHINGLES
    up to all bits. So no link is lost but by the chance that `sure_bits` gives. Null doc_ids have no row here.
    """
    f = [f"f{i}" for i in range(WIDE)]
    spark, mark = docs.sparkSession, made()
    table = write_table(shingle_table(docs.filter("doc_id IS NOT NULL"), words), "shingles")
    nodes = write_table(table.groupBy(*f, "set_id").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")), "shingle-nodes")
    pairs = write_table(candidates(nodes, similarity), "candidates")
    near = write_table(verified(pairs, table, similarity), "near")
    rough = components(near, "similar")
    named = write_table(nodes.join(rough, "node", "left").select("node", "set_id", F.coalesce("root", "node").alias("root")), "rough")
    rest = write_table(exact_pairs(table, named, similarity), "rest")
    roots = components(near.unionByName(verified(rest, table, similarity)), "similar")
    named = write_table(nodes.join(roots, "node", "left").select(*f, "set_id", "copies", F.coalesce("root", "node").alias("component_id")), "similar-nodes")
    out = write_table(join_copies(table.select("doc_id", *f, "set_id"), named, [*f, "set_id"]).select("doc_id", "component_id"), "similar-groups")
    drop_since(spark, mark, out)
    return out
