"""The log language: ``filters | stage | stage`` compiled to one DataFrame plan.

Entries have columns line_no, file, timestamp, level, level_rank, source, message, fields
(map<string,string> of JSON texts) and raw; see tessella.sources.logs. Filters hold together. Of the
aggregating stages (count, rate, patterns, timeline) the first in the text wins; context applies
only without one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.operators.drain import mine_patterns

LEVELS = ("trace", "debug", "info", "warn", "error", "fatal")
ALIASES = {
    **{name: rank for rank, name in enumerate(LEVELS)},
    "verbose": 0, "information": 2, "warning": 3, "err": 4, "critical": 5, "panic": 5,
    **{str(10 * (rank + 1)): rank for rank in range(6)},
}
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def level_rank(text: Column) -> Column:
    """Rank of a level's name, alias or number; null for anything else."""
    names = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.try_element_at(names, F.lower(text)).cast("tinyint")


def level_name(rank: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, LEVELS)), rank.cast("int") + 1)


@dataclass(frozen=True)
class Filter:
    kind: str  # level, source, text, since, until
    value: object


@dataclass(frozen=True)
class Stage:
    kind: str  # count, rate, context, patterns, timeline
    value: object = None


@dataclass
class Pipeline:
    filters: list[Filter] = field(default_factory=list)
    stages: list[Stage] = field(default_factory=list)


def _span(text: str, units: str) -> int | None:
    """Seconds of a duration such as 90s or 2h."""
    m = re.fullmatch(r"([+-]?\d+)([a-z])", text.strip())
    return int(m[1]) * UNITS[m[2]] if m and m[2] in units else None


def parse_time(text: str, now: datetime) -> datetime | None:
    """A moment: a duration before now, an RFC 3339 time with its offset, or a date."""
    ago = _span(text, "smhdw")
    if ago is not None:
        return now - timedelta(seconds=ago)
    try:
        if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
            return datetime.fromisoformat(text).replace(tzinfo=UTC)
        when = datetime.fromisoformat(text)
        return when.astimezone(UTC) if when.tzinfo else None
    except ValueError:
        return None


def _filter(token: str, now: datetime) -> Filter:
    kind, colon, value = token.partition(":")
    if colon:
        if kind == "level" and value.lower() in ALIASES:
            return Filter("level", ALIASES[value.lower()])
        if kind == "source":
            return Filter("source", value)
        if kind in ("since", "until") and (when := parse_time(value, now)):
            return Filter(kind, when)
    return Filter("text", token)


def _stage(text: str) -> Stage | None:
    head, *args = text.split()
    if head == "count":
        return Stage("count", args[1] if len(args) > 1 and args[0] == "by" else "level")
    if head == "rate":
        window = args[0] if args else "1m"
        seconds = _span(window, "smh")
        if seconds is None:
            return None
        if seconds <= 0:
            raise ValueError(f"rate needs a window longer than nothing: {window}")
        return Stage("rate", (window, seconds))
    if head in ("context", "ctx"):
        if not args:
            return Stage("context", 3)
        return Stage("context", int(args[0])) if args[0].isdigit() else None
    if head in ("patterns", "templates"):
        return Stage("patterns")
    return Stage("timeline") if head == "timeline" else None


def parse(text: str, now: datetime | None = None, strict: bool = False) -> Pipeline:
    """A pipeline's text. Pipes separate stages even within quotes. A level or time that can't be read
    is a text to search for. Stages that aren't known are passed over, or refused if strict."""
    now = now or datetime.now(UTC)
    first, *rest = text.split("|")
    out = Pipeline()
    for m in re.finditer(r'([^" \t]*)"([^"]*)"?|[^" \t]+', first.strip()):
        if m[2] is None:
            out.filters.append(_filter(m[0], now))
        else:
            # a token goes on after a quotation in its middle; only the quotation stands apart
            if m[1]:
                out.filters.append(_filter(m[1], now))
            if m[2]:
                out.filters.append(Filter("text", m[2]))
    for part in rest:
        if part.strip():
            stage = _stage(part.strip())
            if stage:
                out.stages.append(stage)
            elif strict:
                raise ValueError(f"no such stage: {part.strip()}")
    return out


def condition(filters: list[Filter]) -> Column:
    """What an entry must fulfil; never null, so that what is absent doesn't pass."""
    out = F.lit(True)
    for f in filters:
        if f.kind == "level":
            c = F.col("level_rank") >= f.value
        elif f.kind == "source":
            c = F.contains(F.lower("source"), F.lit(f.value.lower()))
        elif f.kind == "text":
            c = F.contains(F.lower("message"), F.lit(f.value.lower()))
        else:
            when = F.lit(f.value)
            c = F.col("timestamp") >= when if f.kind == "since" else F.col("timestamp") <= when
        out = out & F.coalesce(c, F.lit(False))
    return out


def count_by(entries: DataFrame, name: str) -> DataFrame:
    """(aggregation, field, group, count): how many entries have each value; absent ones are `unknown`."""
    key = F.col(name) if name in ("level", "source") else F.try_element_at("fields", F.lit(name))
    if name not in ("level", "source"):
        key = F.when(key.startswith('"'), F.from_json(F.concat(F.lit("["), key, F.lit("]")), "array<string>")[0]).otherwise(key)
    groups = entries.groupBy(F.coalesce(key, F.lit("unknown")).alias("group")).agg(F.count("*").alias("count"))
    return groups.select(F.lit("count").alias("aggregation"), F.lit(name).alias("field"), "group", "count")


def count_object(entries: DataFrame, name: str) -> DataFrame:
    """The same as one row {aggregation, field, total, groups}."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("group", "count"))))
    return count_by(entries, name).agg(F.lit("count").alias("aggregation"), F.lit(name).alias("field"), F.coalesce(F.sum("count"), F.lit(0)).alias("total"), pairs.alias("groups"))


def rate(entries: DataFrame, seconds: int, window: str) -> DataFrame:
    """(bucket, count, window): entries in each stretch of time from the first entry's on, empty
    stretches too. Entries without a time don't count; without any time there is no row.

    One aggregation to buckets; the spine comes from the buckets' own numbers, so nothing is read twice
    but the least time."""
    timed = entries.where("timestamp is not null").select(F.unix_micros(F.col("timestamp").cast("timestamp")).alias("us"))
    low = timed.agg(F.min("us").alias("low"))
    width = seconds * 1_000_000
    counts = timed.crossJoin(F.broadcast(low)).groupBy("low", F.expr(f"(us - low) div {width}").alias("k")).agg(F.count("*").alias("count"))
    # a gap up to the next bucket that has entries is filled by its predecessor
    after = F.lead("k").over(Window.partitionBy("low").orderBy("k"))
    filled = counts.withColumn("after", F.coalesce(after, F.col("k") + 1)).select("low", "k", "count", F.explode(F.sequence("k", F.col("after") - 1)).alias("at"))
    return filled.select(
        F.date_format(F.expr(f"timestampadd(MICROSECOND, low + at * {width}, TIMESTAMP_NTZ'1970-01-01 00:00:00')"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("bucket"),
        F.when(F.col("at") == F.col("k"), F.col("count")).otherwise(0).cast("bigint").alias("count"),
        F.lit(window).alias("window"),
    )


def context(entries: DataFrame, hit: Column, n: int) -> DataFrame:
    """Entries within n places of one that matches; an entry with the raw text of one that matches does.

    Places are line numbers within a file. Only lines near a match travel: matching line numbers widen
    to the lines around them, which meet the entries again by (file, line_no)."""
    texts = entries.where(hit).select("raw").distinct()
    matched = entries.join(texts, "raw", "left_semi").select("file", "line_no")
    near = matched.select("file", F.explode(F.sequence(F.col("line_no") - n, F.col("line_no") + n)).alias("line_no")).distinct()
    on = entries.file.eqNullSafe(near.file) & (entries.line_no == near.line_no)
    return entries.join(near, on, "left_semi")


def timeline(entries: DataFrame) -> DataFrame:
    """Entries by time, those without one first; ties as they were read."""
    return entries.orderBy(F.col("timestamp").asc_nulls_first(), "file", "line_no")


def run(entries: DataFrame, query: str | Pipeline, now: datetime | None = None) -> DataFrame:
    """Apply a pipeline to log entries."""
    plan = parse(query, now) if isinstance(query, str) else query
    keep = condition(plan.filters)
    for s in plan.stages:
        if s.kind == "context":
            continue
        found = entries.where(keep)
        if s.kind == "count":
            return count_by(found, s.value)
        if s.kind == "rate":
            return rate(found, s.value[1], s.value[0])
        if s.kind == "patterns":
            return mine_patterns(found)
        return timeline(found)
    for s in plan.stages:
        return context(entries, keep, s.value)
    return entries.where(keep)


def summary(entries: DataFrame) -> DataFrame:
    """One row: lines, first, last, by_level, error_rate (% of all lines), top_errors, sources."""
    short = F.when(F.length("message") > 80, F.concat(F.substring("message", 1, 77), F.lit("..."))).otherwise(F.col("message"))
    counts = entries.groupBy("level", "level_rank", "source", F.when(F.col("level_rank") >= 4, short).alias("error")).agg(
        F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")
    )
    whole = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("lines"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.coalesce(F.sum(F.when(F.col("level_rank") >= 4, F.col("n"))), F.lit(0)).alias("errors"), F.sort_array(F.collect_set("source")).alias("sources"),
    )
    levels = counts.where("level is not null").groupBy("level").agg(F.sum("n").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("level", "n")))).alias("by_level"))
    top = counts.where("error is not null").groupBy("error").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "error").limit(5)
    top = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "error", "n"))).alias("t")).select(F.expr("transform(t, x -> struct(x.error as message, x.n as count))").alias("top_errors"))
    out = whole.crossJoin(levels).crossJoin(top)
    rate_text = F.format_string("%.1f%%", F.coalesce(F.expr("try_divide(errors * 100.0D, lines)"), F.lit(0.0)))
    return out.select("lines", "first", "last", "by_level", rate_text.alias("error_rate"), "top_errors", "sources")
