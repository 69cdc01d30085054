"""Operator 10, quality rules: base counts, then robust multivariate outliers by language and source.

Each text gets counts (words, characters in words, symbols, repeated lines, repeated 3-word windows, and some
more for the statistics). A text fails the base rule if it is short or mostly repeats itself. The others are
judged by a vector of statistics that vary in any text (`vector`): per (lang, source) group a
minimum-covariance-determinant estimate gives location and scatter, and a vector is rejected if its squared
Mahalanobis distance exceeds the chi-square quantile QUANTILE. No constant of the statistics' own scale takes
part: location, scatter and the distances' unit all come from the group.

The estimate is the mean and covariance of the KEEP_SHARE of a group's distinct vectors that has the smallest
determinant, found by the fast MCD scheme: random starts on a bounded sample of each group (SAMPLE vectors by
hash; all of them in smaller groups), each concentrated until its subset stays the same; then concentration
steps over all vectors of all groups until no determinant falls by more than SETTLED any more. Those are
distributed aggregates with partial sums, so a group of any size is never gathered. Copies have one vector and
count once, so a large group of copies can't be taken for the shape of its group. The scatter is scaled so that
the KEEP_SHARE quantile of the group's distances is that of a chi-square.

QUANTILE: statistics of texts have heavier tails than Gaussian vectors, and a rejected text is lost; at 1e-9 a
rejection isn't chance in a corpus of any size, while what isn't prose lies beyond by orders of magnitude.

Defined cases: a direction without scatter in the kept share (a constant statistic, a group of one text) can't
tell how far is far: it is left out of the distance, and the quantile's degrees of freedom are those of the
others; groups with under LEAST vectors are pooled by language, then all together, and a pool under LEAST judges
nobody; a null or empty text has zero counts and fails the base rule; null lang or source is a group of its own;
repeated rows each get a row; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsmith.llm.common import bounds, drop_since, freed, made, raw, slices, write_table

SAMPLE = 600
STARTS = 30
LEAST = 50
KEEP_SHARE = 0.75  # of a group's vectors, the ones that the estimate rests on
SETTLED = 1e-3  # of the logarithm of a determinant
MOST_STEPS = 100
SALTS = 32
FEW = 10_000  # groups, of under 1 kB each
QUANTILE = 1 - 1e-9
NO_SCATTER = 1e-10  # a variance that is rounding only
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
SHORT = 3  # bytes
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_short", "n_distinct")
DIMS = ("x0", "x1", "x2", "x3", "x4", "x5")
P = len(DIMS)


def counts(text: bytes | None) -> tuple[int, ...]:
    """The COUNTS of a text."""
    text = text or b""
    words = text.split()
    joined = b" ".join(words)
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeats = 0
    if n >= 3:
        starts, ends = bounds(joined)
        windows = [joined[s:e] for s, e in zip(starts, ends[2:], strict=False)]
        if len(set(windows)) < len(windows):
            seen: dict[bytes, int] = {}
            for w in windows:
                seen[w] = seen.get(w, 0) + 1
            twice = np.fromiter((seen[w] > 1 for w in windows), bool, n - 2)
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= twice
            repeats = int(covered.sum())
    size = len(text)
    return (
        n,
        len(joined.decode()) - max(0, n - 1),
        size - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeats,
        len(lines),
        size - len(text.translate(None, UPPER)),
        size - len(text.translate(None, MARKS)),
        sum(len(w) <= SHORT for w in words),
        len(set(words)),
    )


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the COUNTS of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                columns = list(zip(*map(counts, raw(part.column("text"))), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in ("doc_id", "lang", "source")] + [pa.array(c, pa.int64()) for c in columns],
                    names=["doc_id", "lang", "source", *COUNTS],
                )

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in ("doc_id", "lang", "source")] + [f"{c} bigint" for c in COUNTS])
    return docs.select("doc_id", "lang", "source", "text").mapInArrow(freed(run), schema)


def vector() -> list[Column]:
    """The transformed statistics: mean word length, shares of marks and of capitals, of short words, how fast
    words recur, and words to a line."""
    one = F.lit(1)
    n, chars = F.greatest("n_words", one), F.greatest("word_chars", one)
    return [
        F.log(chars / n).alias("x0"),
        F.sqrt(F.col("n_marks") / chars).alias("x1"),
        F.sqrt(F.col("n_upper") / chars).alias("x2"),
        F.sqrt(F.col("n_short") / n).alias("x3"),
        (F.log(F.greatest("n_distinct", one)) / F.log(F.greatest("n_words", F.lit(3)))).alias("x4"),
        F.log(n / F.greatest("n_lines", one)).alias("x5"),
    ]


def chi2_cdf(x: float, k: float) -> float:
    """P(chi-square with k degrees <= x), by the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    term = total = 1 / a
    for i in range(1, 500):
        term *= z / (a + i)
        total += term
        if term < total * 1e-15:
            break
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


@cache
def chi2_quantile(p: float, k: float) -> float:
    lo, hi = 0.0, 400.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return hi


def precision(cov: np.ndarray) -> tuple[np.ndarray, float, int]:
    """The inverse of a scatter in the directions that have any, the logarithm of its determinant, and the number
    of those directions."""
    value, basis = np.linalg.eigh(cov)
    real = value > NO_SCATTER
    w = (basis[:, real] / value[real]) @ basis[:, real].T
    return w, float(np.log(np.maximum(value, NO_SCATTER)).sum()), int(real.sum())


def distances(x: np.ndarray, m: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.einsum("ij,jk,ik->i", x - m, w, x - m)


def concentrate(x: np.ndarray, pick: np.ndarray, h: int) -> tuple[float, np.ndarray, np.ndarray]:
    """From the rows `pick` on, the h nearest rows again and again until they stay the same: determinant, location
    and scatter."""
    last = None
    while True:
        m, cov = x[pick].mean(0), np.cov(x[pick].T, bias=True)
        w, det, _ = precision(cov)
        if last is not None and (det >= last or np.isclose(det, last, rtol=0, atol=1e-12)):
            return det, m, cov
        last = det if len(pick) == h else None
        pick = np.argsort(distances(x, m, w), kind="stable")[:h]


def mcd(x: np.ndarray, starts: int = STARTS, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """The best of some random starts."""
    rng, n = np.random.default_rng(seed), len(x)
    h = math.ceil(KEEP_SHARE * n)
    found = [concentrate(x, rng.choice(n, min(n, P + 1), replace=False), h) for _ in range(starts)]
    return min(found, key=lambda f: f[0])


_PARAMS = pa.schema([("g", pa.string()), ("m", pa.list_(pa.float64())), ("w", pa.list_(pa.float64())), ("det", pa.float64()), ("k", pa.int32())])
_PARAMS_SQL = "g string, m array<double>, w array<double>, det double, k int"


def _params(g: str, m: np.ndarray, cov: np.ndarray) -> dict:
    w, det, k = precision(cov)
    return {"g": g, "m": m.tolist(), "w": w.ravel().tolist(), "det": det, "k": k}


def _start(table: pa.Table) -> pa.Table:
    x = np.column_stack([table.column(d).to_numpy() for d in DIMS])
    x = x[np.lexsort(x.T)]  # rows come in any order
    return pa.Table.from_pylist([_params(table.column("g")[0].as_py(), *mcd(x)[1:])], schema=_PARAMS)


def _distance() -> Column:
    """Squared Mahalanobis distance of x0.. from the joined arrays m and w."""
    c = [F.col(d) - F.col("m")[i] for i, d in enumerate(DIMS)]
    total = F.lit(0.0)
    for i in range(P):
        inner = F.lit(0.0)
        for j in range(P):
            inner = inner + F.col("w")[i * P + j] * c[j]
        total = total + c[i] * inner
    return total


_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def _estimates(rows: DataFrame) -> DataFrame:
    """Location and precision of each group from sums over all its given rows; sums are taken from the place
    `o`, near the mean, so that squares don't cancel."""
    from_o = [F.col(d) - F.col("o")[i] for i, d in enumerate(DIMS)]
    sums = rows.groupBy("g").agg(
        F.count("*").alias("n"), F.first("o").alias("o"),
        *[F.sum(from_o[i]).alias(f"s{i}") for i in range(P)],
        *[F.sum(from_o[i] * from_o[j]).alias(f"s{i}_{j}") for i, j in _PAIRS],
    )

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                m = np.array([r[f"s{i}"] for i in range(P)]) / r["n"]
                cov = np.zeros((P, P))
                for i, j in _PAIRS:
                    cov[i, j] = cov[j, i] = r[f"s{i}_{j}"] / r["n"] - m[i] * m[j]
                out.append(_params(r["g"], m + np.array(r["o"]), cov))
            yield pa.RecordBatch.from_pylist(out, schema=_PARAMS)

    return sums.mapInArrow(freed(invert), _PARAMS_SQL)


def _meet(rows: DataFrame, few: DataFrame, key: str, groups: int) -> DataFrame:
    """Rows (with `salt`) joined with a row for each group: broadcast if there are at most FEW groups, else under
    SALTS keys, so that a group's rows meet it in as many tasks."""
    if groups <= FEW:
        return rows.join(F.broadcast(few), key, "left")
    few = few.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return rows.join(few, [key, "salt"], "left")


def _limits(judged: DataFrame, params: DataFrame, groups: int) -> tuple[DataFrame, DataFrame]:
    """The vectors with their distance, and the KEEP_SHARE quantile of each group's distances."""
    near = _meet(judged, params.select("g", "m", "w"), "g", groups).withColumn("d", _distance())
    return near, near.groupBy("g").agg(F.percentile_approx("d", KEEP_SHARE, 10_000).alias("limit"))


def fit(judged: DataFrame, groups: int) -> DataFrame:
    """g, m, w and cut (the largest distance that is kept) of each group; `judged` has g, salt, rows, x0.. ."""
    spark = judged.sparkSession
    chance = (F.xxhash64(*DIMS).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)) * F.col("rows")
    sample = judged.filter(chance < SAMPLE).select("g", *DIMS)
    mark = made()
    params = write_table(sample.groupBy("g").applyInArrow(_start, _PARAMS_SQL), "quality-fit")
    for _ in range(MOST_STEPS):
        near, limit = _limits(judged, params, groups)
        near = _meet(near.withColumnRenamed("m", "o"), limit, "g", groups).filter(F.col("d") <= F.col("limit"))
        after = write_table(_estimates(near), "quality-fit")
        fall = after.alias("a").join(params.alias("b"), "g").agg(F.max(F.col("b.det") - F.col("a.det"))).first()[0]
        params = after
        drop_since(spark, mark, params)
        if (fall or 0) <= SETTLED:
            break
    ks = range(P + 1)
    unit = F.element_at(F.array(*[F.lit(chi2_quantile(KEEP_SHARE, k) if k else 1.0) for k in ks]), F.col("k") + 1)
    top = F.element_at(F.array(*[F.lit(chi2_quantile(QUANTILE, k) if k else 1.0) for k in ks]), F.col("k") + 1)
    cut = write_table(params.join(_limits(judged, params, groups)[1], "g").select("g", "m", "w", (F.col("limit") / unit * top).alias("cut")), "quality-cut")
    drop_since(spark, mark, cut)
    return cut


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept and distance (in units of the cutoff; null where nobody judges)."""
    n = F.col("n_words")
    failed = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * n)
    stats = write_table(text_counts(docs).select("doc_id", "lang", "source", *COUNTS, failed.alias("base_failed"), *vector()), "quality")

    tag = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    stats = stats.withColumns({"lang_": tag("lang"), "own": F.concat_ws("\x1f", tag("lang"), tag("source"))})
    distinct = stats.filter(~F.col("base_failed")).select("lang_", "own", *DIMS).distinct()
    sizes = distinct.groupBy("lang_", "own").agg(F.count("*").alias("size"))
    small = F.col("size") < LEAST
    pooled = sizes.filter(small).groupBy("lang_").agg(F.sum("size").alias("size_lang"))
    keys = (
        sizes.join(pooled, "lang_", "left")
        .withColumn("g", F.when(~small, F.col("own")).when(F.col("size_lang") >= LEAST, F.concat_ws("\x1f", "lang_", F.lit("*"))).otherwise(F.lit("*")))
        .select("own", "g", "size")
    )
    keys = keys.join(keys.groupBy("g").agg(F.sum("size").alias("rows")), "g").filter(F.col("rows") >= LEAST)
    keys = write_table(keys.select("own", "g", "rows"), "quality-keys")
    salt = F.pmod(F.xxhash64(*DIMS), F.lit(SALTS)).alias("salt")
    groups = keys.count()
    judged = write_table(_meet(distinct.select("*", salt), keys, "own", groups).filter("g IS NOT NULL").select("g", "rows", "salt", *DIMS), "quality-vectors")
    found = keys.select("own", "g").join(fit(judged, groups), "g").select("own", "m", "w", "cut")
    spread = F.pmod(F.xxhash64("doc_id", *DIMS), F.lit(SALTS)).alias("salt")
    scored = _meet(stats.select("*", spread), found, "own", groups).withColumn("d", F.when(~F.col("base_failed"), _distance()))
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("d").isNull() | (F.col("d") <= F.col("cut")))).alias("kept"),
        (F.when(F.col("cut") > 0, F.col("d") / F.col("cut"))).alias("distance"),
    )
