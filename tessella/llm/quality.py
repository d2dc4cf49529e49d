"""Quality rules: robust multivariate outliers per language and source.

Each document becomes a vector of transformed statistics. For each (language, source) a regularised
minimum-covariance-determinant estimate of centre and scatter is found over all its documents:

* three deterministic starts a group: quartile ranges alone, and with the correlations of tanh scores
  or of spatial signs;
* concentration steps: the SUPPORT of the group with the least distances gives the next mean and
  covariance. After two steps the start of the least determinant goes on, until no determinant falls;
* the covariance is scaled to consistency by chi-square, and RHO of its weight is the variances of all
  documents, so that a statistic that never varies in a group doesn't make it singular;
* a reweighted estimate of all documents within the 0.975 quantile replaces the concentrated one.

A document is rejected beyond the QUANTILE of chi-square. A step is one aggregation: distances are
counted in fine logarithmic bins together with the sums of vectors and products, so what is gathered
is a few hundred rows a group, never documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, drop_written, ensure_columns, text_bytes, written

FEATURES = ("word_length", "word_length_spread", "other_signs", "capitals", "repeats", "pieces", "line_words")
SUPPORT = 0.75  # of a group determine the concentrated estimate
RHO = 0.25  # weight of all documents' variances in a group's scatter
QUANTILE = 0.99999  # of chi-square, beyond which a document is rejected
LEAST_GROUP = 21  # three times the features; smaller groups use their language's estimate, or that of all documents
STEPS = 30  # at most; a step that changes no group's log determinant by TOLERANCE is the last
TOLERANCE = 1e-3
BINS = 40  # a factor of e in squared distance
_PRIOR = 24  # words that every text is taken to have beside its own, so that short ones vary less
_KIND = np.zeros(256, np.uint8)  # 1 capital, 2 digit, 3 symbol, 4 letter
_KIND[65:91], _KIND[48:58] = 1, 2
_KIND[[*range(33, 39), *range(42, 44), 47, *range(60, 63), 64, *range(91, 97), *range(123, 127)]] = 3
_KIND[33] = _KIND[34] = _KIND[39] = _KIND[63] = 0
_KIND[97:123] = 4
_KIND[0xC3:0xF5] = 4


def statistics(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of words, vector) of each text. Shares are taken with a prior and square-rooted, sizes
    and the share of digits and symbols are logarithms; a text without words gets the vector of the
    prior alone."""
    words = Words(buf, offs)
    rows = len(words.count)
    kind = _KIND[buf]
    # capital letters beyond ASCII: C3 80..9E
    if len(buf) > 1:
        kind[:-1][(buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)] = 1
    width = np.diff(offs)
    row = np.repeat(np.arange(rows), width)
    seen = np.bincount(row * 5 + kind, minlength=rows * 5).reshape(rows, 5)
    lines = np.bincount(row[buf == 10], minlength=rows)
    n = words.count
    size = words.end - words.start
    total = np.bincount(words.doc, weights=size, minlength=rows)
    square = np.bincount(words.doc, weights=size.astype(float) ** 2, minlength=rows)
    h = words.hashes()
    same = np.zeros(len(h), bool)
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1])
    again = np.bincount(words.doc[same], minlength=rows)
    bare = kind == 3
    ends = np.bincount(words.doc[bare[words.end - 1]], minlength=rows) if len(h) else np.zeros(rows)
    m = n + _PRIOR
    mean = (total + _PRIOR * 5.5) / m
    spread = np.sqrt(np.maximum((square + _PRIOR * (5.5**2 + 9)) / m - mean**2, 0.01))
    letters = seen[:, 4] + seen[:, 1] + _PRIOR * 5.5
    other = (seen[:, 2] + seen[:, 3] + 0.1 * _PRIOR * 5.5) / (total + _PRIOR * 5.5)
    x = np.stack([
        np.log(mean), np.log(spread), np.log(other), np.sqrt(seen[:, 1] / letters), np.sqrt(again / m), np.sqrt(ends / m), np.log(m / (lines + 1.0 + _PRIOR / 40)),
    ], axis=1)
    return n, x


def chi2_cdf(x: float, df: int) -> float:
    """Of chi-square with df degrees of freedom, by the series of the incomplete gamma function."""
    a, h = df / 2, x / 2
    if h <= 0:
        return 0.0
    if h > a + 400:
        return 1.0
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= h / k
        total += term
    return min(1.0, total * math.exp(a * math.log(h) - h - math.lgamma(a)))


def chi2_quantile(p: float, df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, df) < p else (low, middle)
    return high


def consistency(share: float, df: int) -> float:
    """What the covariance of the nearest `share` of normal vectors lacks to theirs."""
    return share / chi2_cdf(chi2_quantile(share, df), df + 2)


_D = len(FEATURES)
_X = [f"x{i}" for i in range(_D)]
_PAIRS = [(i, j) for i in range(_D) for j in range(i, _D)]
_M, _P = [f"m{i}" for i in range(_D)], [f"p{i}_{j}" for i, j in _PAIRS]
_PARAMS = "e string, start int, det double, " + ", ".join(f"{x} double" for x in _M + _P)
_NONE = "\0"
WITHIN = 0.975  # quantile of chi-square within which documents count in the reweighted estimate


def regularised(scatter: np.ndarray, target: np.ndarray) -> np.ndarray:
    return RHO * np.diag(np.maximum(target, 1e-12)) + (1 - RHO) * scatter


def _params(e: str, start: int, centre: np.ndarray, scatter: np.ndarray) -> list:
    """A row of parameters: log determinant, centre and the inverse of the scatter."""
    inverse = np.linalg.inv(scatter)
    return [e, start, float(np.linalg.slogdet(scatter)[1]), *centre.tolist(), *[float(inverse[i, j]) for i, j in _PAIRS]]


def _table(rows: list[list]) -> pa.Table:
    names = [x.split()[0] for x in _PARAMS.split(", ")]
    kinds = [pa.string(), pa.int32(), *[pa.float64()] * (len(names) - 2)]
    return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(names, kinds))})


def _distance() -> str:
    z = [f"({x} - m{i})" for i, x in enumerate(_X)]
    return " + ".join(f"{'' if i == j else '2 * '}p{i}_{j} * {z[i]} * {z[j]}" for i, j in _PAIRS)


def _sums(weight: np.ndarray, table: pa.Table, prefix: str = "s") -> tuple[np.ndarray, np.ndarray]:
    """(mean, covariance) from rows of counts and sums, each row with a weight."""
    total = float((table.column("n").to_numpy() * weight).sum())
    mean = np.array([(table.column(f"{prefix}{i}").to_numpy() * weight).sum() for i in range(_D)]) / total
    cov = np.zeros((_D, _D))
    for i, j in _PAIRS:
        cov[i, j] = cov[j, i] = (table.column(f"{prefix}{i}_{j}").to_numpy() * weight).sum() / total - mean[i] * mean[j]
    return mean, cov


def starting_scatters(scale: np.ndarray, tanh: np.ndarray, signs: np.ndarray) -> list[np.ndarray]:
    """Scatters of the three starts: scale is each statistic's spread; tanh, signs are covariances of scores."""
    out = [np.eye(_D)]
    for c in (tanh, signs):
        d = np.sqrt(np.maximum(np.diag(c), 1e-12))
        r = c / np.outer(d, d)
        np.fill_diagonal(r, 1.0)
        out.append(0.99 * r + 0.01 * np.eye(_D))
    return [r * np.outer(scale, scale) for r in out]


def estimates(members: DataFrame, target: np.ndarray, steps: int = STEPS) -> DataFrame:
    """Parameters of each group e of `members` (e, x0, x1, ...); target: variances of all documents."""
    floor = [float(math.sqrt(RHO * max(t, 1e-12))) for t in target]
    products = lambda v, p: [F.sum(v[i] * v[j]).alias(f"{p}{i}_{j}") for i, j in _PAIRS]
    plain = lambda v, p: [F.sum(v[i]).alias(f"{p}{i}") for i in range(_D)]

    quartiles = [F.percentile_approx(x, [0.25, 0.5, 0.75], 10000).alias(f"q{i}") for i, x in enumerate(_X)]
    middle = members.groupBy("e").agg(*quartiles).select("e", *[F.col(f"q{i}")[1].alias(_M[i]) for i in range(_D)], *[F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(floor[i])).alias(f"s{i}") for i in range(_D)])
    middle = written(middle, "quality-middle")
    z = members.join(middle, "e").select("e", *_M, *[f"s{i}" for i in range(_D)], *[F.expr(f"(x{i} - m{i}) / s{i}").alias(f"z{i}") for i in range(_D)])
    z = z.withColumn("r", F.sqrt(F.expr("greatest(1e-24, " + " + ".join(f"z{i} * z{i}" for i in range(_D)) + ")")))
    tanh, signs = [F.tanh(f"z{i}") for i in range(_D)], [F.col(f"z{i}") / F.col("r") for i in range(_D)]
    scores = z.groupBy("e").agg(F.count("*").cast("double").alias("n"), *[F.first(f"s{i}").alias(f"scale{i}") for i in range(_D)], *[F.first(m).alias(m) for m in _M], *plain(tanh, "t"), *products(tanh, "t"), *plain(signs, "u"), *products(signs, "u"))

    def begin(group: pa.Table) -> pa.Table:
        r = group.to_pylist()[0]
        centre, scale = np.array([r[m] for m in _M]), np.array([r[f"scale{i}"] for i in range(_D)])
        found = starting_scatters(scale, *(_sums(np.ones(1), group, p)[1] for p in "tu"))
        return _table([_params(r["e"], k, centre, s) for k, s in enumerate(found)])

    def concentrate(group: pa.Table) -> pa.Table:
        """The nearest SUPPORT of the group; of the bin on its edge, a part."""
        group = group.sort_by("bin")
        n = group.column("n").to_numpy().astype(np.float64)
        most = math.ceil(SUPPORT * n.sum())
        weight = np.clip((most - (np.cumsum(n) - n)) / n, 0, 1)
        mean, cov = _sums(weight, group)
        return _table([_params(group.column("e")[0].as_py(), group.column("start")[0].as_py(), mean, regularised(consistency(SUPPORT, _D) * cov, target))])

    def reweight(group: pa.Table) -> pa.Table:
        mean, cov = _sums(np.ones(1), group)
        return _table([_params(group.column("e")[0].as_py(), 0, mean, regularised(consistency(WITHIN, _D) * cov, target))])

    moments = [F.count("*").cast("double").alias("n"), *plain([F.col(x) for x in _X], "s"), *products([F.col(x) for x in _X], "s")]

    def step(params: DataFrame, k: int) -> DataFrame:
        binned = members.join(params.drop("det"), "e").withColumn("bin", F.expr(f"int(floor(ln(greatest({_distance()}, 1e-9)) * {BINS}))"))
        return written(binned.groupBy("e", "start", "bin").agg(*moments).groupBy("e", "start").applyInArrow(concentrate, _PARAMS), f"quality-step{k}")

    params = written(scores.groupBy("e").applyInArrow(begin, _PARAMS), "quality-start")
    drop_written(middle)
    for k in range(steps):
        new = step(params, k)
        if k == 1:  # the best start of each group goes on
            best = new.groupBy("e").agg(F.min_by(F.struct(*[c for c in new.columns if c != "e"]), F.struct("det", "start")).alias("p"))
            new = written(best.select("e", "p.*"), "quality-best")
        moved = new.select("e", "det").join(params.select("e", F.col("det").alias("was")), "e").where(F.abs(F.col("det") - F.col("was")) > TOLERANCE)
        done = k > 1 and moved.isEmpty()
        drop_written(params)
        params = new
        if done:
            break
    within = members.join(params.drop("det"), "e").where(F.expr(_distance()) <= chi2_quantile(WITHIN, _D)).groupBy("e").agg(*moments)
    final = written(within.groupBy("e").applyInArrow(reweight, _PARAMS), "quality-estimates")
    drop_written(params)
    return final


def score(docs: DataFrame, steps: int = STEPS, least_group: int = LEAST_GROUP) -> DataFrame:
    """(doc_id, lang, source, n_words, distance) for every row; distance is the squared Mahalanobis
    distance, null for a text without words (null, empty, white space).

    A null language or source forms a group like any other. A group with fewer than least_group texts is
    judged by all texts of its language, or where those are too few by all. Rows with a null doc_id and
    repeated rows count like others. A very long text is one vector like any other. An empty table
    gives no rows. Other columns are ignored."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            n, x = statistics(*text_bytes(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), b.column("source"), pa.array(n), *[pa.array(np.ascontiguousarray(x[:, i])) for i in range(_D)]], ["doc_id", "lang", "source", "n_words", *_X])

    docs = ensure_columns(docs, doc_id="bigint", lang="string", source="string", text="string")
    stats = written(docs.mapInArrow(measure, "doc_id bigint, lang string, source string, n_words bigint, " + ", ".join(f"{x} double" for x in _X)), "quality-statistics")
    lang, source = F.coalesce("lang", F.lit(_NONE)), F.coalesce("source", F.lit(_NONE))
    keyed = stats.withColumn("narrow", F.concat(F.lit("2"), lang, F.lit("\1"), source)).withColumn("wide", F.concat(F.lit("1"), lang))
    counts = keyed.where("n_words > 0").groupBy("narrow", "wide").agg(F.count("*").alias("k"))
    wide = counts.groupBy("wide").agg(F.sum("k").alias("kw"))
    choice = counts.join(wide, "wide").select("narrow", F.when(F.col("k") >= least_group, F.col("narrow")).when(F.col("kw") >= least_group, F.col("wide")).otherwise(F.lit("0")).alias("e"))
    choice = written(choice, "quality-groups")
    needed = choice.select("e").distinct()
    worded = keyed.where("n_words > 0")
    members = worded.select(F.explode(F.array("narrow", "wide", F.lit("0"))).alias("e"), *_X).join(needed, "e", "left_semi")
    spread = worded.agg(*[F.coalesce(F.var_pop(x), F.lit(0.0)) for x in _X]).first()
    params = estimates(members, np.array(spread, float), steps)
    judged = keyed.join(choice, "narrow", "left").join(params, "e", "left")
    return judged.select("doc_id", "lang", "source", "n_words", F.when(F.col("n_words") > 0, F.expr(f"round({_distance()}, 4)")).alias("distance"))


def reject_outliers(docs: DataFrame, quantile: float = QUANTILE, **how) -> DataFrame:
    """The rows of score() that are kept: those with words and a squared distance of at most the
    quantile of chi-square (a distance equal to it is kept)."""
    return score(docs, **how).where(F.col("distance") <= chi2_quantile(quantile, _D))


def op7_quality_rules(spark, sf_dir):
    return reject_outliers(spark.read.parquet(f"{sf_dir}/documents.parquet"))
