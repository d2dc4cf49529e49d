"""A cache of results by content.

cache(key, source_path, blob_hash, mode, data). The key is a hash of the parts that make a result, so a
changed file simply misses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CACHE = "key string, source_path string, blob_hash string, mode string, data string"


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the parts joined by a bar."""
    return F.sha2(F.concat_ws("|", *parts).cast("binary"), 256)


def keyed(sources: DataFrame, mode: str, root: str | None = None) -> DataFrame:
    """Sources (path, content) with blob_hash and key."""
    hashed = sources.withColumn("blob_hash", content_hash(F.col("content")))
    parts = [F.lit(root)] if root is not None else []
    return hashed.withColumn("key", cache_key(*parts, F.col("path"), F.col("blob_hash"), F.lit(mode)))


def get_or_compute(cache: DataFrame, sources: DataFrame, mode: str, compute: Callable[[DataFrame], DataFrame], root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(results (path, key, data, status), the cache with what was missing). compute takes the missing
    sources (path, content, blob_hash, key) and gives (key, data); a null datum is an error and not kept.
    Sources without content are skipped."""
    have = keyed(sources, mode, root)
    wanted = have.where("content is not null")
    hits = wanted.join(cache.select("key", "data"), "key").select("path", "key", "data", F.lit("cached").alias("status"))
    missing = wanted.join(cache, "key", "left_anti")
    made = missing.select("path", "blob_hash", "key").join(compute(missing), "key", "left")
    fresh = made.select("path", "key", "data", F.when(F.col("data").isNull(), "error").otherwise("computed").alias("status"))
    skipped = have.where("content is null").select("path", "key", F.lit(None).cast("string").alias("data"), F.lit("skipped").alias("status"))
    kept = made.where("data is not null").select("key", F.col("path").alias("source_path"), "blob_hash", F.lit(mode).alias("mode"), "data")
    return hits.unionAll(fresh).unionAll(skipped), cache.unionByName(kept)


def warm(results: DataFrame) -> DataFrame:
    """(status, count) of a run of get_or_compute."""
    return results.groupBy("status").agg(F.count("*").alias("count"))


def stats(cache: DataFrame) -> DataFrame:
    """(mode, entries, bytes)."""
    return cache.groupBy("mode").agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("bytes"))


def clear(cache: DataFrame) -> DataFrame:
    return cache.limit(0)


def index_status(cache: DataFrame, sources: DataFrame, mode: str, version: str) -> DataFrame:
    """(path, status): hit, stale (made by another version of the pipeline) or miss. The version is the
    part of a cache row's mode after the @."""
    hashed = sources.withColumn("blob_hash", content_hash(F.col("content")))
    base = F.split("mode", "@")
    held = cache.where(base[0] == mode).select(F.col("source_path").alias("path"), "blob_hash", F.try_element_at(base, F.lit(2)).alias("v"))
    found = hashed.join(held, ["path", "blob_hash"], "left").groupBy("path").agg(F.max(F.when(F.col("v") == version, 2).when(F.col("v").isNotNull(), 1).otherwise(0)).alias("s"))
    return found.select("path", F.when(F.col("s") == 2, "hit").when(F.col("s") == 1, "stale").otherwise("miss").alias("status"))


def manifest(cache: DataFrame) -> DataFrame:
    """(source_path, blob_hash, mode) of all entries, in order."""
    return cache.select("source_path", "blob_hash", "mode").orderBy("source_path", "mode")


def prune(cache: DataFrame, sources: DataFrame) -> DataFrame:
    """The cache without entries of paths or contents that are no longer there."""
    live = sources.select(F.col("path").alias("source_path"), content_hash(F.col("content")).alias("blob_hash"))
    return cache.join(live, ["source_path", "blob_hash"], "left_semi")


def estimate_seconds(sources: DataFrame, words_per_second: int = 10_000, workers: int = 1) -> DataFrame:
    """One row: files, words, seconds that indexing would take."""
    words = F.size(F.filter(F.split("content", r"\s+"), lambda w: w != ""))
    return sources.agg(F.count("*").alias("files"), F.coalesce(F.sum(words), F.lit(0)).alias("words")).withColumn("seconds", F.col("words") / F.lit(words_per_second * workers))


# What computes each mode: a tool's name and its arguments, the source's path last
MODES = {
    "skeleton": ("tree", "skeleton"), "signatures": ("tree", "signatures"), "metrics": ("tree", "parse_metrics"), "build": ("tree", "build"), "sentences": ("prose", "plain_sentences"), "statistics": ("prose", "statistics"),
    "requirements": ("prose", "requirements"), "questions": ("prose", "questions"), "discourse": ("prose", "discourse"),
}


def mode_function(mode: str) -> Callable[[DataFrame], DataFrame]:
    """The operator that a mode names; an unknown mode is an error."""
    from importlib import import_module

    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}; one of {', '.join(MODES)}")
    module, name = MODES[mode]
    return getattr(import_module(f"tessella.operators.{module}"), name)


def invalidated(cache: DataFrame, changed: DataFrame) -> DataFrame:
    """(path, entries): files of `changed` (path) that the cache holds something of. Nothing is deleted:
    contents are the keys, so what is out of date is never found again."""
    held = cache.groupBy(F.col("source_path").alias("path")).agg(F.count("*").alias("entries"))
    return changed.select("path").distinct().join(held, "path")
