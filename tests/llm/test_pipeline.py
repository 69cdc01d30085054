import os
import random
import sys
from collections import Counter

sys.path[:0] = [os.path.dirname(__file__), os.path.dirname(os.path.dirname(__file__))]
import brute
import numpy as np
import pytest
from oracle import SF

import corpus_pipeline
from rowsmith.llm import simhash
from rowsmith.llm.common import documents, write_table


def shingles(text):
    w = text.translate(brute.LOWER).split()
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or {tuple(w)}


def test_similar_groups(spark):
    """All documents: every similar pair shares a group, and groups are no larger than the pairs make them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r[0]: r[1] for r in simhash.similar_groups(docs).collect()}
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    where = {}
    for i, x in sets.items():
        for k in x:
            where.setdefault(k, []).append(i)
    both = Counter((a, b) for ids in where.values() for n, a in enumerate(sorted(ids)) for b in sorted(ids)[n + 1 :])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in both.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in sets}
    assert 0 < sum(i != x for i, x in got.items()) < len(got)


def test_stages(spark):
    docs = documents(spark, SF)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = write_table(stage(spark, docs, SF), name)
        assert docs.columns == columns
        assert 0 < docs.count() <= before.count()
    left = [(r.doc_id, r.text) for r in docs.collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert not any(r[5] for r in brute.decontam(left, items))
    assert all(len(r.text) == r.n_chars for r in docs.collect())
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.select("doc_id").distinct().count() == len(left)


def test_odd_and_empty_rows(spark, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            docs = write_table(stage(spark, docs, SF), name)
        docs.count()


def similar_pairs(sets):
    return [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]


def test_links_beside_shared_boilerplate(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.getrandbits(40)}"
    texts = []
    for _ in range(12):
        frame = [word() for _ in range(170)]
        for _ in range(20):
            own = [word() for _ in range(30)]
            texts.append(frame + own)
            texts.append(frame + own[:9] + [word() for _ in range(21)])
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id bigint, text string")
    pairs = similar_pairs({r.doc_id: shingles(r.text) for r in docs.collect()})
    got = {r[0]: r[1] for r in simhash.similar_groups(docs).collect()}
    assert len(pairs) >= 240 and len(set(got.values())) > 200
    assert all(got[a] == got[b] for a, b in pairs)


def test_no_pair_at_the_threshold_is_lost(spark):
    rng = random.Random(6)
    word = lambda: f"w{rng.getrandbits(40)}"
    texts = []
    for _ in range(150):
        own = [word() for _ in range(100)]
        texts += [own, own[:90] + [word() for _ in range(10)]]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id bigint, text string")
    got = {r[0]: r[1] for r in simhash.similar_groups(docs).collect()}
    assert [i for i in range(0, 300, 2) if got[i + 1] != i] == []
    assert all(got[i] == i for i in range(0, 300, 2))


def test_large_groups_lose_no_pair(spark, monkeypatch):
    rng = random.Random(7)
    word = lambda: f"w{rng.getrandbits(40)}"
    frame, texts = [word() for _ in range(170)], []
    for _ in range(60):
        own = [word() for _ in range(30)]
        texts += [frame + own, frame + own[:9] + [word() for _ in range(21)]]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id bigint, text string")
    pairs = similar_pairs({r.doc_id: shingles(r.text) for r in docs.collect()})
    monkeypatch.setattr(simhash, "GROUP", 8)
    got = {r[0]: r[1] for r in simhash.similar_groups(docs).collect()}
    assert len(pairs) >= 60 and all(got[a] == got[b] for a, b in pairs)
    assert len(set(got.values())) == 60


@pytest.mark.parametrize("at_once", [10, simhash.PAIRS_AT_ONCE])
def test_gray_forest(monkeypatch, at_once):
    """The wide index gives all wanted pairs of every group within the limit, each once."""
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", at_once)
    rng = np.random.default_rng(1)
    sizes = [1, 2, 8, 9, 64, 65, 1, 150]
    group = rng.permutation(np.repeat(np.arange(len(sizes)), sizes))
    n = len(group)
    flips = rng.random((n, 64 * simhash.WIDE)) < rng.choice([0.02, 0.1, 0.2], n)[:, None]
    fps = rng.integers(0, 1 << 63, (2, simhash.WIDE)).astype(np.uint64)[rng.integers(0, 2, n)] ^ np.packbits(flips, axis=1).view(np.uint64)
    rank, most = rng.integers(0, 30, n), rng.choice([10, 58, 78, 64 * simhash.WIDE], n)
    got = [p for part in simhash.wide_pairs(fps, group, rank, most) for p in zip(*(x.tolist() for x in part), strict=True)]
    bits = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2, dtype=np.int64)
    want = np.argwhere((group[:, None] == group[None]) & (rank[:, None] < rank[None]) & (bits <= most[:, None]))
    assert sorted(got) == sorted((i, j, int(bits[i, j])) for i, j in want.tolist())
    assert 0 < len(got) < (group[:, None] == group[None]).sum() / 2


def test_the_gray_index_decides(spark, monkeypatch):
    """The stage's links come out of operator 9's index: without what it finds there are none."""
    rng = random.Random(9)
    word = lambda: f"w{rng.getrandbits(40)}"
    texts = []
    for _ in range(20):
        own = [word() for _ in range(100)]
        texts += [own, own[:95] + [word() for _ in range(5)]]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id bigint, text string")
    assert {r[0]: r[1] for r in simhash.similar_groups(docs).collect()} == {i: i - i % 2 for i in range(40)}
    monkeypatch.setattr(simhash, "wide_pairs", lambda *rows: iter(()))
    assert {r[0]: r[1] for r in simhash.similar_groups(docs).collect()} == {i: i for i in range(40)}
