"""The contracts, word for word, in plain Python."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import xxhash

SPACES = "[^\x20\x09-\x0d]+"
LOWER = {c: c + 32 for c in range(65, 91)}


def simhash(rows):
    fps = {}
    for i, t in rows:
        w = re.findall(SPACES, (t or "").translate(LOWER))
        shingles = [" ".join(w[j : j + 3]) for j in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    ids = sorted(fps)
    f = np.array([fps[i] for i in ids], np.uint64)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[k]) <= 2).tolist():
            a, b = find(i), find(ids[j])
            parent[max(a, b)] = min(a, b)
    return {(i, f"{fps[i]:016x}", find(i)) for i in ids}


def decontam(rows, items):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    words = lambda t: word.findall((t or "").translate(LOWER))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[j : j + n])].add(str(i))
    out = set()
    for i, t in rows:
        w, found = words(t), set()
        hit = [False] * len(w)
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[j : j + n])):
                    found |= owners
                    hit[j : j + n] = [True] * n
        out.add((i, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)))
    return out


def tokens(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out, at = set(), 0
    for i, text in sorted(rows, key=lambda r: r[0]):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.add((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def substring(rows, width=20):
    seen, out = set(), set()
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = re.findall(SPACES, t or "")
        gone = [False] * len(w)
        for j in range(len(w) - width + 1):
            k = tuple(w[j : j + width])
            if k in seen:
                gone[j : j + width] = [True] * width
            seen.add(k)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.add((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def suffix(rows, length=400):
    texts = {i: (t or "").encode() for i, t in rows}
    starts = collections.Counter(xxhash.xxh3_128_digest(b[j : j + length]) for b in texts.values() for j in range(len(b) - length + 1))
    out = set()
    for i, b in texts.items():
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if starts[xxhash.xxh3_128_digest(b[j : j + length])] > 1:
                gone[j : j + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.add((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def base(text):
    w = re.findall(SPACES, text or "")
    lines = [x for x in (text or "").split("\n") if re.search(SPACES, x)]
    windows = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
    count = collections.Counter(windows)
    again = {j + k for j, x in enumerate(windows) if count[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def vector(text):
    w = re.findall(SPACES, text)
    chars, lines = sum(map(len, w)), sum(bool(re.search(SPACES, x)) for x in text.split("\n"))
    marks, upper = len(re.findall(r"[!-/:-@\[-`{-~]", text)), len(re.findall("[A-Z]", text))
    short = sum(len(x.encode()) <= 3 for x in w)
    n = len(w)
    return math.log(chars / n), math.sqrt(marks / chars), math.sqrt(upper / chars), math.sqrt(short / n), math.log(len(set(w))) / math.log(n), math.log(n / lines)


def outliers(x, cutoff, unit, share=0.75, starts=300):
    """Of the vectors of one group (rows of full rank) those that the determinant's smallest subset rejects."""
    kinds, back = np.unique(x, axis=0, return_inverse=True)
    n, p = kinds.shape
    h = math.ceil(share * n)
    rng, best = np.random.default_rng(99), (math.inf, None)
    for _ in range(starts):
        own = set(rng.choice(n, p + 1, replace=False).tolist())
        while True:
            y = kinds[sorted(own)]
            solved = np.linalg.solve(np.cov(y.T, bias=True) + (1e-12 if len(own) <= p + 1 else 0) * np.eye(p), (kinds - y.mean(0)).T)
            d = ((kinds - y.mean(0)).T * solved).sum(0)
            near = set(np.argsort(d, kind="stable")[:h].tolist())
            if near == own:
                break
            own = near
        det = np.linalg.det(np.cov(kinds[sorted(own)].T, bias=True))
        if det < best[0]:
            best = (det, d)
    d = best[1]
    return (d / np.sort(d)[h - 1] * unit > cutoff)[back.ravel()]


def naive_bayes(learn, texts, alpha, bits):
    """Label and probability of each text; learn has (label, text)."""

    def grams(text):
        c = [ord(x) if x.isalpha() else 32 for x in f" {(text or '').lower()} "]
        for i in range(len(c)):
            h = 0
            for n in range(3):
                if i + n < len(c):
                    h = (h + c[i + n] + n + 1) * 0x9E3779B97F4A7C15 % 2**64
                    h ^= h >> 29
                    yield h >> 64 - bits

    names = sorted({x for x, _ in learn})
    count = {x: collections.Counter(g for y, t in learn if y == x for g in grams(t)) for x in names}
    out = []
    for t in texts:
        if not any(x.isalpha() for x in (t or "").lower()):
            out.append(("und", 0.0))
            continue
        logs = {x: math.log(sum(y == x for y, _ in learn) / len(learn)) + sum(math.log((count[x][g] + alpha) / (count[x].total() + alpha * 2**bits)) for g in grams(t)) for x in names}
        best = max(names, key=lambda x: logs[x])
        out.append((best, 1 / sum(math.exp(v - logs[best]) for v in logs.values())))
    return out


class Segmentations:
    """All segmentations of a text into pieces, weighed as the operator says."""

    def __init__(self, model):
        import public_tokenizers
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        n = m.get_piece_size()
        plain = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
        self.ids = {m.id_to_piece(i): i for i in plain}
        self.weight = {i: -math.log(2 + min(-m.get_score(i), n)) for i in plain}
        self.bytes = {int(m.id_to_piece(i)[3:5], 16): i for i in range(n) if m.is_byte(i)}
        self.weight |= dict.fromkeys(self.bytes.values(), -math.log(2 + n))
        self.longest = max(map(len, self.ids))

    def total(self, text):
        """The logarithm of the sum over all segmentations."""
        s = "\u2581" + text.replace(" ", "\u2581") if text else ""
        at = [0.0] + [-math.inf] * len(s)
        for j in range(1, len(s) + 1):
            ways = [at[i] + self.weight[self.ids[s[i:j]]] for i in range(max(0, j - self.longest), j) if s[i:j] in self.ids]
            if s[j - 1] not in self.ids:
                ways.append(at[j - 1] + sum(self.weight[self.bytes[b]] for b in s[j - 1].encode()))
            at[j] = float(np.logaddexp.reduce(ways))
        return at[-1]
