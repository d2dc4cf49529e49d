"""Logs as they are written: filters, rates and templates over streams.

The same parsers and filters as for files; a stream's format is named, as it can't be sniffed from lines
that are yet to come. What a batch pipeline anchors at the first entry has a fixed origin here.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from tessella.operators.drain import THRESHOLD, Clusters
from tessella.plans import log_pipeline
from tessella.sources import logs


def read_stream(spark: SparkSession, folder: str, format: str, **options: str) -> DataFrame:
    """Entries of the files of a folder, now and to come. Lines have no numbers."""
    lines = spark.readStream.format("text").options(**options).load(folder)
    return entries(lines, format)


def entries(lines: DataFrame, format: str) -> DataFrame:
    """Entries of a stream (or table) of lines in column value."""
    chosen = logs.FORMAT_ALIASES.get(format, format)
    clean = logs.strip_ansi(F.col("value"))
    parsed = logs.with_prepared(lines.where(F.col("value").rlike(r"\S")), chosen, clean).withColumn("__e", logs.PARSERS[chosen](clean))
    return parsed.select("__e.timestamp", log_pipeline.level_name(F.col("__e.level_rank")).alias("level"), "__e.level_rank", "__e.source", "__e.message", "__e.fields", F.col("value").alias("raw"))


def follow(stream: DataFrame, query: str, strict: bool = True) -> DataFrame:
    """The entries that pass a pipeline's filters. Stages that aggregate have no meaning while following;
    they are refused, or left out if not strict."""
    plan = log_pipeline.parse(query)
    if plan.stages and strict:
        raise ValueError(f"following takes filters only, not {plan.stages[0].kind}")
    return stream.where(log_pipeline.condition(plan.filters))


def windowed_rate(stream: DataFrame, window: str, delay: str = "10 minutes", slide: str | None = None, origin: str | None = None) -> DataFrame:
    """(start, count) of each stretch of time, later entries than `delay` left out. Stretches start at the
    epoch, or as far off it as origin says; empty ones don't appear."""
    args = [window, slide or window] + ([origin] if origin else [])
    counted = stream.where("timestamp is not null").withWatermark("timestamp", delay).groupBy(F.window("timestamp", *args).alias("w")).agg(F.count("*").alias("count"))
    return counted.select(F.col("w.start").alias("start"), "count")


def sessions(stream: DataFrame, gap: str, delay: str = "10 minutes") -> DataFrame:
    """(source, start, end, count) of runs of entries with no gap longer than that."""
    grouped = stream.withWatermark("timestamp", delay).groupBy("source", F.session_window("timestamp", gap).alias("w")).agg(F.count("*").alias("count"))
    return grouped.select("source", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "count")


class _Mining(StatefulProcessor):
    """Clusters of one (length, first token), kept from batch to batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("clusters", "template array<array<string>>, counts array<bigint>, samples array<array<string>>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        c = Clusters(THRESHOLD)
        if self.state.exists():
            template, counts, samples = self.state.get()
            c.tokens, c.counts, c.samples = [list(t) for t in template], [int(n) for n in counts], [list(s) for s in samples]
        touched = {}
        for batch in rows:
            for m in batch["message"]:
                touched[c.add(m)] = True
        self.state.update((c.tokens, c.counts, c.samples))
        found = c.rows()
        yield pd.DataFrame([(*key, i, found[i][0], found[i][1], found[i][2]) for i in touched], columns=["length", "head", "cluster", "template", "count", "samples"])

    def close(self) -> None:
        pass


def mine_stream(stream: DataFrame) -> DataFrame:
    """(length, head, cluster, template, count, samples): after each batch the clusters that changed."""
    words = F.split(F.trim("message"), r"\s+")
    keyed = stream.where(F.col("message").rlike(r"\S")).select("message", F.size(words).alias("length"), words[0].alias("head"))
    schema = "length int, head string, cluster int, template string, count bigint, samples array<string>"
    return keyed.groupBy("length", "head").transformWithStateInPandas(_Mining(), schema, "Update", "None")


def until_budget(stream: DataFrame, tokens: int, sink) -> StreamingQuery:
    """Start a query that gives rows to sink(list of JSON lines) until about that many tokens are spent
    (a token is four bytes, one more a line; the first row always passes), then stops by itself."""
    spent = {"tokens": 0, "over": False}

    def batch(df: DataFrame, _: int) -> None:
        if spent["over"]:
            return
        out = []
        for r in df.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
            cost = len(r.j.encode()) // 4 + 1
            if spent["tokens"] and spent["tokens"] + cost > tokens:
                spent["over"] = True
                out.append('{"_budget_exhausted":true}')
                break
            spent["tokens"] += cost
            out.append(r.j)
        sink(out)

    query = stream.writeStream.foreachBatch(batch).trigger(processingTime="100 milliseconds").start()
    query.budget_spent = spent
    return query
