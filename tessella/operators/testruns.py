"""Test results: totals, failures, flaky tests, differences of two runs, records.

Results are rows (run_id, ord, name, status, duration_ms, file, line, message, stdout, stderr, suite);
status is passed, failed, skipped or errored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAD = ("failed", "errored")


def _bad() -> Column:
    return F.col("status").isin(*BAD)


def totals(results: DataFrame) -> DataFrame:
    """(run_id, total, passed, failed, skipped, errored, duration_ms); no duration if it is 0."""
    counts = [F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("passed", "failed", "skipped", "errored")]
    return results.groupBy("run_id").agg(F.count("*").alias("total"), *counts, F.nullif(F.sum("duration_ms"), F.lit(0)).alias("duration_ms"))


def failures(results: DataFrame) -> DataFrame:
    return results.where(_bad())


def summary(results: DataFrame) -> DataFrame:
    """The totals of each run with failures, an array of {test, message} in order."""
    bad = F.array_sort(F.collect_list(F.when(_bad(), F.struct("ord", F.col("name").alias("test"), "message"))))
    found = results.groupBy("run_id").agg(F.transform(bad, lambda x: F.struct(x["test"].alias("test"), x["message"].alias("message"))).alias("failures"))
    return totals(results).join(found, "run_id")


def rates(results: DataFrame) -> DataFrame:
    """(name, runs, failures, fail_rate): a skipped test counts as a run."""
    out = results.groupBy("name").agg(F.count("*").alias("runs"), F.count(F.when(_bad(), 1)).alias("failures"))
    return out.withColumn("fail_rate", F.col("failures") / F.col("runs"))


def flaky(results: DataFrame) -> DataFrame:
    """Tests that fail in some runs, worst first."""
    return rates(results).where("failures > 0 and failures < runs").orderBy(F.desc("fail_rate"), "name")


def always_failing(results: DataFrame) -> DataFrame:
    return rates(results).where("failures = runs").select("name").orderBy("name")


def flaky_report(results: DataFrame) -> DataFrame:
    """One row: total_runs, flaky_tests, always_failing."""
    r = rates(results)
    tests = F.array_sort(F.collect_list(F.when(F.col("failures").between(1, F.col("runs") - 1), F.struct((-F.col("fail_rate")).alias("by"), "name", "runs", "failures", "fail_rate"))))
    always = F.sort_array(F.collect_list(F.when(F.col("failures") == F.col("runs"), F.col("name"))))
    shape = lambda x: F.struct(x["name"].alias("name"), x["runs"].alias("runs"), x["failures"].alias("failures"), x["fail_rate"].alias("fail_rate"))
    return results.agg(F.count_distinct("run_id").alias("total_runs")).crossJoin(r.agg(F.transform(tests, shape).alias("flaky_tests"), always.alias("always_failing")))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name, change): new_failures, new_passes, still_failing, added, removed. Of a name that repeats
    the last result counts; a test that neither fails nor failed is in no class."""
    last = lambda df, c: df.groupBy("name").agg(F.max_by("status", "ord").alias(c))
    both = last(before, "a").join(last(after, "b"), "name", "full_outer")
    bad_a, bad_b = F.col("a").isin(*BAD), F.col("b").isin(*BAD)
    change = (
        F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(bad_a & bad_b, "still_failing")
        .when(bad_b, "new_failures").when(bad_a, "new_passes")
    )
    return both.select("name", change.alias("change")).where("change is not null")


def diff_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row of five sorted arrays."""
    kinds = ("new_failures", "new_passes", "still_failing", "added", "removed")
    return diff(before, after).agg(*[F.sort_array(F.collect_list(F.when(F.col("change") == k, F.col("name")))).alias(k) for k in kinds])


_LANGUAGES = {"cargo": "rust", "libtest": "rust", "libtest_json": "rust", "pytest": "python", "jest": "javascript", "gotest": "go", "gotest_json": "go", "flutter": "dart"}


def records(results: DataFrame, format: str, runner: str | None = None, commit: str | None = None) -> DataFrame:
    """(schema_version, language, runner, commit, suite, name, status, duration_ms, message): names like
    a::b::c are split to suite a/b and name c; failed, errored and skipped read failed, errored, ignored."""
    parts = F.split("name", "::")
    suite = F.coalesce(F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), "/")), F.col("suite"))
    status = F.when(F.col("status") == "passed", "ok").when(F.col("status") == "skipped", "ignored").otherwise(F.col("status"))
    return results.select(
        F.lit(2).alias("schema_version"), F.lit(_LANGUAGES.get(format, "unknown")).alias("language"), F.lit(runner or format).alias("runner"), F.lit(commit).cast("string").alias("commit"),
        suite.alias("suite"), F.element_at(parts, -1).alias("name"), status.alias("status"), "duration_ms", "message",
    )
