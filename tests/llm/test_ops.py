import math
import os
import random
import sys
import textwrap
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

sys.path[:0] = [os.path.dirname(__file__), os.path.dirname(os.path.dirname(__file__))]
import brute
from oracle import SF, check
from pyspark.sql import functions as F

from rowsmith.llm import chunks, common, decontam, langid, licences, pieces, quality, simhash, substring, suffix, tokenfile, warc
from rowsmith.llm.catalogue import QUERIES, SQL


@pytest.fixture(scope="module")
def rows(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def got(spark, name):
    return {tuple(r) for r in QUERIES[name](spark, SF).collect()}


@pytest.mark.parametrize("name", list(SQL))
def test_sql(spark, name):
    check(spark, QUERIES, SQL, name)


@pytest.mark.parametrize(("direct", "hot"), [(simhash.BRUTE, common.HOT_ROWS), (1, 2)])
def test_simhash(spark, rows, monkeypatch, direct, hot):
    monkeypatch.setattr(simhash, "BRUTE", direct)  # 1: every group goes through the tree
    monkeypatch.setattr(common, "HOT_ROWS", hot)  # copies are joined apart
    assert got(spark, "op9_simhash") == brute.simhash(rows)


def test_decontam(spark, rows):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute.decontam(rows, items)
    assert any(r[5] for r in want)
    assert got(spark, "op4_decontamination") == want


def test_decontam_beyond_a_broadcast(spark, rows, monkeypatch):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = {tuple(r) for r in decontam.scan(docs, bench).collect()}
    clean = {r[0] for r in decontam.clean(docs, bench).select("doc_id").collect()}
    assert clean == {r[0] for r in want if not r[5]}
    monkeypatch.setattr(decontam, "FEW", 0)
    monkeypatch.setattr(common, "BITS", 12)  # and with a bitmap that lets nearly all pass
    assert {tuple(r) for r in decontam.scan(docs, bench).collect()} == want
    assert {r[0] for r in decontam.clean(docs, bench).select("doc_id").collect()} == clean


def test_decontam_of_repetitive_texts(spark):
    rng = random.Random(8)
    some = lambda n: " ".join(rng.choice(["a", "B", "é", "\U0001f600x", "10"]) for _ in range(n))
    items = [(i, some(rng.choice([0, 1, 2, 3, 9, 10, 11, 14]))) for i in range(40)] + [(40, None), (41, "...")]
    rows = [(i, some(rng.randint(0, 60)).replace(" ", rng.choice([" ", "-", " . "]))) for i in range(80)] + [(80, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert {tuple(r) for r in decontam.scan(docs, bench).collect()} == brute.decontam(rows, items)


def test_tokens(spark, rows):
    assert got(spark, "op6_bitplane_tokens") == brute.tokens(rows)


def test_substring(spark, rows):
    want = brute.substring(rows)
    assert sum(r[2] for r in want) > 0
    assert got(spark, "op7_substring_dedup") == want
    many = substring.dedup(spark.read.parquet(f"{SF}/documents.parquet"), chunk_bytes=300_000)
    assert {tuple(r) for r in many.collect()} == want


def test_suffix(spark, rows):
    want = brute.suffix(rows)
    assert got(spark, "op3_suffix_dedup") == want
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for hot in (suffix.HOT, 2):
        assert {tuple(r) for r in suffix.dedup(docs, hot=hot, chunk_bytes=300_000).collect()} == want


def test_suffix_on_repetitive_texts(spark):
    rng = random.Random(3)
    parts = ["".join(rng.choice("ab") for _ in range(n)) for n in (3, 50, 300, 450)]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))) for i in range(60)] + [(60, "z" * 1500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {tuple(r) for r in suffix.dedup(docs).collect()} == brute.suffix(rows)
    words = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 80)))) for i in range(60)]
    docs = spark.createDataFrame(words, "doc_id bigint, text string")
    assert {tuple(r) for r in substring.dedup(docs, chunk_bytes=500).collect()} == brute.substring(words)


def test_longest_previous_factor():
    rng = random.Random(1)
    for depth in (12, 16, 37):
        data = bytes(rng.choice(b"ab\0") for _ in range(300))
        starts = np.arange(300 - depth + 1)
        lpf, source = suffix.longest_previous_factor(np.frombuffer(data, np.uint8), starts, depth)
        for i in starts.tolist():
            best = max((next((k for k in range(depth) if data[i + k] != data[j + k]), depth) for j in range(i)), default=0)
            assert lpf[i] == best
            assert best == 0 or data[source[i] : source[i] + best] == data[i : i + best]


def blocks_of_text():
    rng = random.Random(2)
    part = [rng.randbytes(rng.randint(100, 900)) for _ in range(5)]
    return np.frombuffer(b"".join(rng.choice(part) for _ in range(60)) + b"z" * 900, np.uint8)


def test_suffixes_in_pieces(monkeypatch):
    data = blocks_of_text()
    valid = np.arange(len(data)) + 400 <= len(data)
    count = Counter(bytes(data[i : i + 400]) for i in np.flatnonzero(valid))
    want = [bool(valid[i]) and count[bytes(data[i : i + 400])] > 1 for i in range(len(data))]
    assert 0 < sum(want) < valid.sum()
    for piece in (1 << 20, 5000, 50, 1):
        monkeypatch.setattr(suffix, "PIECE", piece)
        assert suffix.repeats(data, valid, 400).tolist() == want


def test_the_suffix_order_decides(monkeypatch):
    data = blocks_of_text()
    valid = np.arange(len(data)) + 400 <= len(data)
    right = suffix.repeats(data, valid, 400)
    monkeypatch.setattr(suffix, "suffix_order", lambda rows: np.random.default_rng(0).permutation(len(rows)))
    assert suffix.repeats(data, valid, 400).sum() < 0.5 * right.sum()


def test_covers():
    for period, cover in substring.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_gray_index():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 50).astype(np.uint64)
    flip = lambda: np.uint64(1) << rng.integers(0, 64, 50).astype(np.uint64)
    x = np.unique(np.concatenate([base ^ flip() ^ flip() for _ in range(20)]))
    index = simhash.GrayIndex(x)
    q, m = index.search(index.fps, 2)
    want = np.argwhere(np.bitwise_count(index.fps[:, None] ^ index.fps[None]) <= 2)
    assert set(zip(q.tolist(), m.tolist(), strict=True)) == set(map(tuple, want.tolist()))


def test_large_groups_are_dealt_anew(spark, monkeypatch):
    rng = random.Random(2)
    fps = sorted({rng.getrandbits(7) | 5 << 40 for _ in range(90)} | {rng.getrandbits(62) for _ in range(50)})
    df = spark.createDataFrame([(x,) for x in fps], "fp bigint")
    monkeypatch.setattr(simhash, "GROUP", 8)
    roots = dict(tuple(r) for r in simhash.components(simhash.links(df, 2)).collect())
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 2:
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    assert all(roots.get(x, x) == find(x) for x in fps)


def test_chain_of_links(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    assert dict(tuple(r) for r in simhash.components(edges).collect()) == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_language(spark):
    df = QUERIES["op2_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = df[df.held_out]
    assert len(held) > 100 and (held.lang == held.lang_pred).mean() > 0.98
    assert df.score.between(0, 1).all()
    assert langid.score(["123 !", None, ""], ["a"], np.zeros((1, 257)))[0] == ["und"] * 3


@pytest.mark.parametrize("cells", [langid.CELLS, 2000])
def test_language_by_brute_force(spark, rows, monkeypatch, cells):
    monkeypatch.setattr(langid, "CELLS", cells)
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 60").withColumn("text", F.substring("text", 1, 400))
    docs = docs.unionByName(spark.createDataFrame([(900, "", "en", "s", 0), (901, None, "en", "s", 0), (902, "12 .", None, "s", 0), (903, "İ \U0001f3f4 日本", None, "s", 0)], docs.schema))
    table = [(r.doc_id, r.lang, r.text) for r in docs.collect()]
    learn = [(x, t) for i, x, t in table if i % 3 and x is not None and t is not None]
    bits = langid.bits_for(len({x for x, _ in learn}))
    want = dict(zip([i for i, _, _ in table], brute.naive_bayes(learn, [t for _, _, t in table], langid.ALPHA, bits), strict=True))
    got = langid.identify(docs, F.col("doc_id") % 3 == 0).collect()
    assert len(got) == len(want) and bits == (16 if cells > 2000 else 8)
    for r in got:
        assert r.lang_pred == want[r.doc_id][0] and math.isclose(r.score, want[r.doc_id][1], abs_tol=1e-9)


def test_language_of_any_code_point():
    texts = ["\U00030000\U000323af", "\U0001f3f4\U000e0067\U000e007f", "a\U000e0100 b", "\U0010ffff"]
    assert len(langid.letters()) == sys.maxunicode + 1
    assert langid.score(texts, ["a"], np.zeros((1, 257)))[0] == ["a", "und", "a", "und"]


def test_quality_counts_and_verdict(spark, rows):
    for _, t in rows[:300]:
        assert quality.counts(t.encode())[:5] == brute.base(t)
    df = QUERIES["op10_quality_rules"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("NOT base_failed").toPandas()
    assert df[df.quality == 1].kept.mean() > 0.99
    assert df[df.quality == 0].kept.mean() < 0.2
    assert math.isclose(quality.chi2_quantile(0.95, 2), -2 * math.log(0.05), rel_tol=1e-6)


def test_mcd_ignores_outliers():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (300, 6)), rng.normal(30, 1, (60, 6))])
    _, m, cov = quality.mcd(x)
    assert np.abs(m).max() < 0.3
    assert quality.distances(x[300:], m, quality.precision(cov)[0]).min() > quality.chi2_quantile(quality.QUANTILE, 6)


def verdicts(rows):
    """kept by doc_id, from brute force; rows of (doc_id, group, text)."""
    groups, out = {}, {}
    for i, g, t in rows:
        n, *_, repeats = brute.base(t)
        out[i] = not (n < 50 or 100 * repeats > 50 * n)
        if out[i]:
            groups.setdefault(g, []).append((i, brute.vector(t)))
    for members in groups.values():
        gone = brute.outliers(np.array([v for _, v in members]), quality.chi2_quantile(quality.QUANTILE, 6), quality.chi2_quantile(0.75, 6))
        out |= {i: not x for (i, _), x in zip(members, gone.tolist(), strict=True)}
    return out


def test_quality_verdict_is_the_mcd(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = verdicts([(r.doc_id, r.lang, r.text) for r in docs.collect()])  # no source has 50 texts: languages are the groups
    got = {r.doc_id: r.kept for r in quality.quality(docs).collect()}
    assert got == want and 0 < sum(got.values()) < len(got)


def prose(rng, size, marks):
    known = ["".join(rng.choice("abcdefghij") for _ in range(max(1, round(rng.gauss(size, size / 3))))) for _ in range(rng.randint(90, 150))]

    def word():
        w = rng.choice(known)
        return (w.capitalize() if rng.random() < 0.1 else w) + ("," if rng.random() < marks else "")

    return "\n".join(" ".join(word() for _ in range(rng.randint(8, 14))) for _ in range(rng.randint(12, 30)))


def test_no_fixed_rule_gives_the_verdict(spark, monkeypatch):
    """What is usual in one source is an outlier in the other; a large source is fitted beyond its sample."""
    rng = random.Random(4)
    rows = [(i, prose(rng, 4, 0.1), "en", "a") for i in range(300)] + [(1000 + i, prose(rng, 9, 0.3), "en", "b") for i in range(300)]
    rows += [(2000 + i, prose(rng, 9, 0.3), "en", "a") for i in range(5)] + [(3000 + i, prose(rng, 4, 0.1), "en", "b") for i in range(5)]
    rows += [(4000 + i, rows[0][1], "en", "a") for i in range(400)]  # copies don't shape their group
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    want = verdicts([(i, s, t) for i, t, _, s in rows])
    assert [i for i, ok in want.items() if not ok] == [*range(2000, 2005), *range(3000, 3005)]
    for sample in (quality.SAMPLE, 150):
        monkeypatch.setattr(quality, "SAMPLE", sample)
        assert {r.doc_id: r.kept for r in quality.quality(docs).collect()} == want


def test_constant_statistics(spark):
    """Without scatter in any direction nobody is rejected; in one direction, the others decide."""
    text = lambda i: " ".join(["aa", "b"] * 40 + [f"w{i:04d}"])
    same = [(i, " ".join(f"w{(i * 7 + k) % 1000:03d}" for k in range(60)), "x", "s") for i in range(80)]
    docs = spark.createDataFrame([(i, text(i), "x", "s") for i in range(60)] + [(100 + r[0], *r[1:]) for r in same], "doc_id bigint, text string, lang string, source string")
    assert quality.quality(docs).filter("NOT base_failed AND NOT kept").count() == 0


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [0, 1, 1000])
@pytest.mark.parametrize("top", [200, 40_000, 1 << 31])
def test_segments(bits, n, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype(np.uint32)
    data = tokenfile.write_segment(ids, chunk=300, bits=bits)
    assert (tokenfile.read_segment(data) == ids).all()
    if n > 300:
        assert (tokenfile.read_segment(data, only=1) == ids[300:600]).all()


@pytest.mark.parametrize(("name", "apart"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_encoder_is_the_library(name, apart, monkeypatch):
    e = tokenfile.Encoder(name)
    assert e.apart == apart
    rng = random.Random(1)
    parts = [*"aAbBzZ'sStT,.!?;:*$%&#|<>|/-_0129 éÉßΣσİẖḦ̱×÷日٣² \n\t\r\x0b\x0c\x1c\x85\xa0　", "<|endoftext|>", "<|ENDOFTEXT|>", "the", "'ll", "Straße,", "zoë."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(2000)] + ["", None, "  ", "\n", " a"]
    for cache in (tokenfile.CACHE, 50):
        monkeypatch.setattr(tokenfile, "CACHE", cache)
        ids, n = e.encode(pa.array(texts), 2)
        for t, part, want in zip(texts, np.split(ids, np.cumsum(n)[:-1]), e.library.encode_batch([t or "" for t in texts], add_special_tokens=False), strict=True):
            assert part.tolist() == [*want.ids, 2], t
        ids, n = e.encode(pa.array(texts).slice(7, 20), 2)
        assert (np.split(ids, np.cumsum(n)[:-1])[3].tolist()[:-1]) == e.library.encode(texts[10], add_special_tokens=False).ids


def test_sampling():
    v = pieces.vocabulary("piece_bpe_32k.model")
    ids = {x: i for i, x in enumerate(v.strings)}

    def every(s):
        if not s:
            yield (), 0.0
        for k in range(1, len(s) + 1):
            if s[:k] in ids:
                for rest, w in every(s[k:]):
                    yield (ids[s[:k]], *rest), v.weight[ids[s[:k]]] + w

    p = dict(every("▁the▁an"))
    total = np.logaddexp.reduce(list(p.values()))
    p = {k: math.exp(w - total) for k, w in p.items()}
    out = pieces.sample(v, ["the an"] * 8000, np.arange(8000), 3, 0)
    first, second = (Counter(tuple(o[i][0].tolist()) for o in out) for i in (0, 1))
    for s in p:
        assert abs(first[s] / 8000 - p[s]) < 0.02
        assert abs(second[s] / 8000 - sum(p[a] * p[s] / (1 - p[a]) for a in p if a != s)) < 0.02
    assert all(len({tuple(x[0].tolist()) for x in o}) == 3 and o[0][2] >= o[1][2] >= o[2][2] for o in out)
    assert abs(np.mean([sum(math.exp(x[1]) / x[3] for x in o) for o in out]) - 1) < 0.01  # inclusion scores
    assert [len(o) for o in pieces.sample(v, ["a", None, ""], np.arange(3), 50, 0)] == [2, 1, 1]


def test_probabilities_by_brute_force(spark, rows):
    """Of the query's rows, those of short texts: each is a segmentation of its text, with its probability."""
    every = brute.Segmentations("piece_bpe_32k.model")
    texts = dict(sorted(rows, key=lambda r: len(r[1] or ""))[:150])
    got = {}
    for r in QUERIES["op8_sentencepiece_sampling"](spark, SF).filter(F.col("doc_id").isin(list(texts))).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got.keys() == texts.keys()
    for i, samples in got.items():
        total = every.total(texts[i])
        samples.sort(key=lambda r: r.sample)
        assert len({tuple(r.ids) for r in samples}) == len(samples)
        assert [r.sample for r in samples] == list(range(1, len(samples) + 1))
        for r in samples:
            assert math.isclose(r.log_prob, sum(every.weight[x] for x in r.ids) - total, abs_tol=1e-6)
            assert 0 < r.inclusion <= 1
        assert all(a.perturbed >= b.perturbed for a, b in zip(samples, samples[1:], strict=False))


def test_samples_depend_on_the_row_key_only(spark):
    docs = spark.createDataFrame([(i, f"some text number {i % 7}, and éàü \U0001f600") for i in range(50)], "doc_id bigint, text string")
    one = {(r.doc_id, r.sample): (tuple(r.ids), r.perturbed) for r in pieces.encode(docs.coalesce(1), k=3).collect()}
    many = {(r.doc_id, r.sample): (tuple(r.ids), r.perturbed) for r in pieces.encode(docs.repartition(9), k=3).collect()}
    assert one == many
    assert one[0, 1] != one[7, 1] and one[0, 1] != {(r.doc_id, r.sample): (tuple(r.ids), r.perturbed) for r in pieces.encode(docs, k=3, seed=1).collect()}[0, 1]


def test_round_trip(spark, odd):
    out = QUERIES["op8_sentencepiece_sampling"](spark, SF)
    assert out.filter("NOT round_trip").count() == 0
    back = pieces.decode(pieces.encode(odd)).join(odd.select(F.col("doc_id").alias("d"), F.coalesce("text", F.lit("")).alias("t")).distinct(), F.col("doc_id") == F.col("d"))
    assert back.filter("text <> t").count() == 0 and back.count() > 20


def wrapped(text, mark, width=72):
    return "\n".join(f"{mark} {x}".rstrip() for x in textwrap.wrap(text, width))


@pytest.mark.parametrize("form", ["line", "sentence", "header", "paragraphs", "start", "end"])
def test_licences_are_found_in_texts(spark, form):
    code = "import os\n\ndef f(x):\n    return x + 1\n" * 40

    def put(t):
        return {
            "line": f"x\n{t}\ny z", "sentence": f"We say that {t} And so it is, or nearly so.", "header": f"#!/bin/sh\n#\n{wrapped(t, '#')}\n#\n{code}",
            "paragraphs": f"{code}\n/*\n{wrapped(t.replace('. ', '.' + chr(10)), ' *')}\n */\n{code}", "start": wrapped(t, "//") + "\n" + code, "end": code + wrapped(t, ""),
        }[form]

    docs = spark.createDataFrame([(i, put(t)) for i, (_, t) in enumerate(licences.TEMPLATES)], "doc_id bigint, text string")
    for r in licences.scan(docs).collect():
        assert r.license_id == licences.TEMPLATES[r.doc_id][0] and r.dice == 1.0


def test_licences_with_changes(spark, monkeypatch):
    mit = next(t for n, t in licences.TEMPLATES if n == "MIT" and len(t) > 500)
    rng = random.Random(3)
    changed = " ".join("changed" if rng.random() < 0.05 else w for w in mit.split())
    cut = " ".join(mit.split()[:60])
    docs = spark.createDataFrame([(1, changed), (2, cut), (3, "software license copyright notice " * 50), (4, f"Copyright (c) 2020 A B\n\n{mit} {mit}")], "doc_id bigint, text string")
    got = {r.doc_id: (r.license_id, r.n_licenses) for r in licences.scan(docs).collect()}
    assert got == {1: ("MIT", 1), 2: (None, 0), 3: (None, 0), 4: ("MIT", 1)}
    want = [tuple(r) for r in licences.scan(docs).orderBy("doc_id").collect()]
    monkeypatch.setattr(licences, "BATCH_WORDS", 100)
    assert [tuple(r) for r in licences.scan(docs).orderBy("doc_id").collect()] == want
    own = licences.table_templates(spark.createDataFrame([("own", "You may read this text but not write it."), (None, "x y")], "id string, text string"))
    docs = spark.createDataFrame([(1, "a b\n# You may read this\n# text but not write it. c")], "doc_id bigint, text string")
    assert licences.scan(docs, own).first().license_id == "own"


def test_revisits(spark, monkeypatch):
    h = lambda **k: {a.replace("_", "-"): b for a, b in k.items()}
    rows = [
        (1, "http://www.a.org/x/", 10, "response", h(etag='W/"1"', content_length="9", date="d1")),
        (2, "https://a.org/x#y", 20, "response", h(etag='"2"', content_length="8", last_modified="m")),
        (3, "https://a.org:443/x?utm_source=q", 20, "revisit", h(etag='"1"', content_length="0", date="d3")),
        (4, "https://A.org/x", 21, "revisit", h(etag='"1"')),
        (5, "https://a.org/x", 22, "revisit", h(last_modified="m", vary="v")),
        (6, "https://b.org/", 22, "revisit", h(etag="q")),
        (7, None, 22, "revisit", None),
    ]
    records = spark.createDataFrame(rows, "record_id bigint, url string, at bigint, kind string, headers map<string,string>")
    for block, few in ((50_000, 500), (1, 500), (1, 0)):
        monkeypatch.setattr(warc, "BLOCK_ROWS", block)
        monkeypatch.setattr(warc, "FEW", few)
        out = {r.record_id: r for r in warc.resolve(records).collect()}
        assert {k: (r.refers_to, r.status) for k, r in out.items()} == {3: (1, "resolved"), 4: (None, "validator_mismatch"), 5: (2, "resolved"), 6: (None, "no_response"), 7: (None, "no_response")}
        assert out[3].headers == h(etag='"1"', content_length="9", date="d3")
        assert out[5].headers == h(etag='"2"', content_length="8", last_modified="m", vary="v")


def latest(records):
    """What each revisit refers to, and its status, by the plain rule."""
    out = []
    for i, url, at, kind, h in records:
        if kind != "revisit":
            continue
        earlier = [(t, j, g or {}) for j, u, t, k, g in records if k == "response" and u == url and url is not None and at is not None and t is not None and t < at]
        _, j, g = max(earlier, key=lambda x: x[:2], default=(0, None, {}))
        mine = h or {}
        if "etag" in mine and "etag" in g:
            same = mine["etag"].removeprefix("W/") == g["etag"].removeprefix("W/")
        else:
            same = "last-modified" in mine and mine["last-modified"] == g.get("last-modified")
        out.append((i, j if j is not None and same else None, "no_response" if j is None else "resolved" if same else "validator_mismatch"))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [50_000, 20, 1])
def test_revisits_of_hot_urls_and_odd_rows(spark, monkeypatch, block):
    """A URL with most records, an instant with a third of them, one record long before all others, ties, nulls,
    repeated rows and columns whose names clash."""
    rng = random.Random(block)
    head = lambda: rng.choice([None, {}, {"etag": rng.choice(['"a"', 'W/"a"', '"b"'])}, {"last-modified": rng.choice("mn")}])
    rows = [(i, rng.choice(["u", "u", "u", "v", "w", None]), rng.choice([500, rng.randint(400, 600), None]) if i % 3 else 500, rng.choice(["response", "revisit", "revisit", None]), head()) for i in range(400)]
    rows += [(1000, "u", -(10**12), "response", {"etag": '"a"'}), rows[5], rows[6]]
    schema = "record_id bigint, url string, at bigint, kind string, headers map<string,string>"
    records = spark.createDataFrame(rows, schema)
    for c in ("block", "salt", "full", "cuts", "url_key", "last", "inside"):
        records = records.withColumn(c, F.lit("x"))
    monkeypatch.setattr(warc, "BLOCK_ROWS", block)
    monkeypatch.setattr(warc, "CUTS", 20)
    for few in (500, 0):
        monkeypatch.setattr(warc, "FEW", few)
        got = sorted(((r.record_id, r.refers_to, r.status) for r in warc.resolve(records).collect()), key=repr)
        assert got == latest(rows)
    assert warc.resolve(records.filter("false")).count() == 0


def runs(odd, bench):
    return {
        "1": lambda d: licences.scan(d), "2": lambda d: langid.identify(d, F.col("doc_id") % 5 == 0), "3": lambda d: suffix.dedup(d), "4": lambda d: decontam.scan(d, bench),
        "6": lambda d: tokenfile.read_back(tokenfile.encode(d)), "7": lambda d: substring.dedup(d), "8": lambda d: pieces.encode(d, k=1), "9": lambda d: simhash.near_duplicates(d), "10": lambda d: quality.quality(d),
    }


@pytest.mark.parametrize("name", "1 2 3 4 6 7 8 9 10".split())
def test_odd_rows(spark, odd, none, name):
    bench = spark.createDataFrame([(1, "one two three"), (2, None), (None, "")], "item_id bigint, text string")
    run = runs(odd, bench)[name]
    assert run(odd).count() == odd.count()
    assert run(none).count() == 0


CLASHING = "chunk_ bucket chunk kind blob fp node root least k k1 k2 found g w n salt own lang_ x0 d cut hits words dice ids sample score held_out shard segment start component_id n_words kept".split()


def test_odd_values(spark, odd):
    """Empty, null and long texts, copies, and columns named as the operators name theirs."""
    rows = [(i, t) for i, t in enumerate([r.text for r in odd.collect()])]
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else None, None if i % 3 else "s") for i, t in rows], "doc_id bigint, text string, lang string, source string")
    for c in CLASHING:
        docs = docs.withColumn(c, F.lit("x"))
    items = [(1, "one two three"), (2, None), (3, ""), (4, "same text of some words here same text of some words")]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("g", F.lit(1)).withColumn("w", F.lit(1))
    got = lambda df: {tuple(r) for r in df.collect()}
    assert got(suffix.dedup(docs)) == brute.suffix(rows)
    assert got(substring.dedup(docs)) == brute.substring(rows)
    assert got(decontam.scan(docs, bench)) == brute.decontam(rows, items)
    assert got(tokenfile.read_back(tokenfile.encode(docs))) == brute.tokens(rows)
    assert got(simhash.near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id")) == brute.simhash(rows)
    kept = substring.dedup(docs, keep_columns=True)
    assert kept.columns == docs.columns and kept.filter("chunk_ <> 'x'").count() == 0
    for r in quality.quality(docs).collect():
        n, chars, symbols, lines, repeats = brute.base(dict(rows)[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, symbols, lines, repeats, n < 50 or 100 * repeats > 50 * n)
    for r in langid.identify(docs, F.col("doc_id") % 5 == 0).collect():
        assert (r.lang_pred, r.score) == (("und", 0.0) if not any(c.isalpha() for c in dict(rows)[r.doc_id] or "") else ("en", 1.0))
    for r in pieces.decode(pieces.encode(docs, k=2)).collect():
        assert r.text == (dict(rows)[r.doc_id] or "") and r.round_trip
    assert {r.license_id for r in licences.scan(docs).collect()} == {None}
    for stage in (decontam.clean(docs, bench),):
        assert stage.columns == docs.columns and {r.doc_id for r in stage.collect()} == {r[0] for r in brute.decontam(rows, items) if not r[5]}


def test_parts_cover_all_keys():
    keys = np.sort(np.random.default_rng(0).integers(0, 2**64, 1000, dtype=np.uint64))
    for n in (1, 7, 5000, 1 << 31):
        parts = chunks.parts(keys, n)
        assert [s for _, s, _ in parts] == [0, *[e for _, _, e in parts[:-1]]] and parts[-1][2] == 1000
        assert all(0 <= b < n for b, _, _ in parts) and len({b for b, _, _ in parts}) == len(parts)
    assert chunks.parts(keys[:0], 7) == []


def test_repeated_rows_are_dealt_apart(spark):
    text = " ".join(f"w{i}" for i in range(300))
    docs = spark.createDataFrame([(1, text)] * 60 + [(2, "other")], "doc_id bigint, text string")
    dealt, _ = chunks.dealt(docs, ["doc_id"], 10_000)
    assert dealt.filter("doc_id = 1").select(chunks.CHUNK).distinct().count() > 4
    got = Counter((r.doc_id, r.n_removed) for r in substring.dedup(docs, chunk_bytes=10_000).collect())
    assert got == {(1, 0): 1, (1, 300): 59, (2, 0): 1}
    got = Counter((r.doc_id, r.n_removed) for r in suffix.dedup(docs.repartition(5), chunk_bytes=10_000).collect())
    assert got == {(1, len(text)): 60, (2, 0): 1}
