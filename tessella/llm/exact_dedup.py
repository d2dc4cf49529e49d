"""Exact duplicates by distributed MSD radix partitioning.

Documents are split by successive stretches of their bytes ("digits", widening fourfold), most
significant first. A group that holds one document is finished at once; a group whose documents end
in the same digit holds equal texts. No digest is made: equality is equality of every byte.

Per round only (group, digit) counts are aggregated, with map-side combining, so a group of
millions of copies is as cheap as a group of two. Only members of groups with several documents go on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, ensure_columns, written

FIRST_DIGIT, WIDEN = 64, 4
BROADCAST_BYTES = 64 << 20


def exact_duplicates(docs: DataFrame, first_digit: int = FIRST_DIGIT, widen: int = WIDEN, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, keep_id, copies): a row for each document whose text occurs more than once.

    keep_id is the least doc_id that holds the text (null if none has an id). A null text is no
    document and never in the result; empty texts equal each other; repeated rows count as copies;
    rows with a null doc_id count and appear with a null doc_id. An empty table gives no rows; other
    columns are ignored, whatever their names."""
    spark = docs.sparkSession
    rest = ensure_columns(docs, doc_id="bigint", text="string").where("text is not null").select("doc_id", F.lit(0).cast("bigint").alias("gid"), F.col("text").cast("binary").alias("rest"))
    width, found, previous = first_digit, [], None
    while True:
        digits = rest.select("doc_id", "gid", F.expr(f"substring(rest, 1, {width})").alias("digit"), (F.octet_length("rest") <= width).alias("ended"), "rest")
        groups = digits.groupBy("gid", "digit", "ended").agg(F.count("*").alias("copies"), F.min("doc_id").alias("keep_id")).where("copies > 1")
        groups = written(groups.withColumn("next_gid", F.monotonically_increasing_id()), "radix-groups")
        size = groups.agg(F.count("*"), F.sum(F.octet_length("digit") + 40), F.count(F.when(~F.col("ended"), 1))).first()
        if not size[0]:
            drop_written(groups)
            break
        small = (size[1] or 0) <= broadcast_bytes  # else both sides are exchanged by their digits
        joined = digits.join(F.broadcast(groups) if small else groups, ["gid", "digit", "ended"])
        if not size[2]:
            found.append(joined.select("doc_id", "keep_id", "copies"))
            break
        joined = written(joined.select("doc_id", "keep_id", "copies", "ended", F.col("next_gid").alias("gid"), F.when(~F.col("ended"), F.expr(f"substring(rest, {width + 1})")).alias("rest")), "radix-rest")
        drop_written(groups)
        found.append(joined.where("ended").select("doc_id", "keep_id", "copies"))
        rest = joined.where("not ended").select("doc_id", "gid", "rest")
        width *= widen
    out = found[0] if found else spark.createDataFrame([], "doc_id bigint, keep_id bigint, copies bigint")
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def op5_exact_dedup(spark, sf_dir):
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
SELECT doc_id, keep_id, copies FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS copies
  FROM documents WHERE text IS NOT NULL) t
WHERE copies > 1
"""
