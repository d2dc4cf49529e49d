"""Mixing sources to target weights by pivotal dependent rounding.

A source's rate is its target share of the tokens over the share it has. Each document gets the whole
part of the rate as copies, and the fraction is settled by pivotal sampling: two undecided documents
of a source fight, one takes as much probability from the other as makes one of them 0 or 1. Leaves
(documents of a source in a hash bucket) settle all but one document each; the residual documents
meet again up a reduction tree of fan-in 16 until one is left per source. So a source's copies sum to
its exact total, rounded up or down, whatever the partitioning, and every document keeps its rate as
its expectation. All randomness comes from hashes, so a lost task repeats its decisions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, group_bounds, mix, partitions, written

ALPHA, BUDGET, SEED = 0.7, 1.0, 42
LEAF, FAN_IN = 4096, 16
_STEP = "rid bigint, source string, bucket bigint, p double, done boolean"


def pivotal(p: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, int]:
    """Settle probabilities in order, one uniform number a fight: (p with all but one at 0 or 1, the
    index that is left or -1)."""
    p, left = p.tolist(), -1
    for i, draw in enumerate(u.tolist()):
        b = p[i]
        if not 1e-12 < b < 1 - 1e-12:
            p[i] = float(round(b))
            continue
        if left < 0:
            left = i
            continue
        a = p[left]
        s = a + b
        if s < 1:
            if draw * s < b:
                p[left], p[i], left = 0.0, s, i
            else:
                p[left], p[i] = s, 0.0
        elif draw * (2 - s) < 1 - b:
            p[left], p[i], left = 1.0, s - 1, i
            p[left] = s - 1
        else:
            p[i], p[left] = 1.0, s - 1
        if left >= 0 and not 1e-12 < p[left] < 1 - 1e-12:
            p[left] = float(round(p[left]))
            left = -1
    return np.array(p), left


def _uniform(rid: np.ndarray, level: int, seed: int) -> np.ndarray:
    return mix(rid.view(np.uint64) ^ mix(np.array([seed * 1000 + level], np.uint64))) / 2.0**64


def _settle(df: DataFrame, level: int, last: bool, seed: int) -> DataFrame:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        source, bucket, rid, p = (t.column(c).to_numpy() for c in ("source", "bucket", "rid", "p"))
        names, code = np.unique(np.array([("" if s is None else "=" + s) for s in source], object).astype(str), return_inverse=True)
        order = np.lexsort((rid, bucket, code))
        source, bucket, rid, p, code = source[order], bucket[order], rid[order].astype(np.int64), p[order].copy(), code[order]
        done = np.ones(len(p), bool)
        bounds = np.unique(np.concatenate([group_bounds(code), group_bounds(bucket)]))
        u = _uniform(rid, level, seed)
        for a, b in zip(bounds[:-1], bounds[1:]):
            p[a:b], left = pivotal(p[a:b], u[a:b])
            if left >= 0:
                if last:
                    p[a + left] = float(_uniform(rid[a + left : a + left + 1], level + 1, seed)[0] < p[a + left])
                else:
                    done[a + left] = False
        yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(source, pa.string()), pa.array(bucket, pa.int64()), pa.array(p), pa.array(done)], ["rid", "source", "bucket", "p", "done"])

    return df.repartition(partitions(df.sparkSession), "source", "bucket").mapInArrow(step, _STEP)


def source_rates(units: DataFrame, weights: dict[str, float] | None, alpha: float, budget: float) -> DataFrame:
    """(source, rate). Target weights: those given (others get none), else tokens to the power alpha."""
    totals = units.groupBy("source").agg(F.sum("size").cast("double").alias("tokens"))
    if weights is None:
        weight = F.when(F.col("tokens") > 0, F.pow("tokens", F.lit(alpha))).otherwise(0.0)
        totals = totals.withColumn("w", weight)
    else:
        given = units.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, w double")
        totals = totals.join(given, totals.source.eqNullSafe(given.source), "left").select(totals.source, "tokens", F.coalesce("w", F.lit(0.0)).alias("w"))
    whole = totals.agg(F.sum("tokens").alias("all_tokens"), F.sum("w").alias("all_w"))
    rate = F.when(F.col("tokens") > 0, F.expr(f"try_divide(w * all_tokens * {budget}D, all_w * tokens)")).otherwise(F.lit(1.0))
    return totals.crossJoin(whole).select("source", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def copies_table(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, budget: float = BUDGET, seed: int = SEED, leaf: int = LEAF) -> DataFrame:
    """(rid, doc_id, source, rate, copies), a row for each distinct row (doc_id, source, text).

    Sizes are bytes of text. A null source is a source of its own; a null or empty text has size 0 and
    follows its source's rate; a source without any text has rate 1. Repeated rows are decided once,
    and each of them gets the decision. An empty table gives no rows. Other columns are ignored."""
    spark = docs.sparkSession
    docs = docs.withColumns({c: (F.col(c) if c in docs.columns else F.lit(None)).cast(t) for c, t in (("doc_id", "bigint"), ("source", "string"), ("text", "string"))})
    units = docs.select(F.xxhash64("doc_id", "source", "text").alias("rid"), "doc_id", "source", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("size"))
    units = written(units, "mix-units")
    rates = source_rates(units, weights, alpha, budget)
    units = units.dropDuplicates(["rid"])
    rated = units.join(rates, units.source.eqNullSafe(rates.source)).select("rid", "doc_id", units.source, "rate", (F.col("rate") - F.floor("rate")).alias("p"))
    rated = written(rated, "mix-rated")
    levels = 0
    while leaf * FAN_IN**levels < rated.count():
        levels += 1
    step = rated.where("p > 0").select("rid", "source", "p", F.expr(f"pmod(xxhash64(rid, {seed}), {FAN_IN**levels})").alias("bucket"))
    settled = None
    for level in range(levels + 1):
        out = written(_settle(step, level, level == levels, seed), f"mix-level{level}")
        done = out.where("done").select("rid", F.col("p").cast("bigint").alias("take"))
        settled = done if settled is None else settled.unionByName(done)
        step = out.where("not done").select("rid", "source", "p", F.expr(f"bucket div {FAN_IN}").alias("bucket"))
    return rated.join(settled, "rid", "left").select("rid", "doc_id", "source", "rate", (F.floor("rate") + F.coalesce("take", F.lit(0))).cast("bigint").alias("copies"))


def mix_sources(docs: DataFrame, **how) -> DataFrame:
    """`docs` with each row as often as it has copies; columns as before. See copies_table()."""
    count = copies_table(docs, **how).where("copies > 0").select("rid", "copies")
    rid = F.xxhash64(*[(F.col(c) if c in docs.columns else F.lit(None)).cast(t) for c, t in (("doc_id", "bigint"), ("source", "string"), ("text", "string"))])
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), rid.alias("rid"))  # the row's columns can't clash with ours
    return keyed.join(count, "rid").select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).select("row.*")


def op8_mixing(spark, sf_dir):
    return copies_table(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("rid")
