"""Rows from JSON files, paths from globs and folders, and results as text.

Text is read by Spark, a line a row; only a file that is one JSON array is read whole, because an array
can't be split. Paths are found through the session's file system, whatever it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.relate import _row

PROSE = ("txt", "md", "rst", "adoc")


class InputError(ValueError):
    """An input that isn't there or can't be read."""


def expand_globs(spark: SparkSession, patterns: str | list[str]) -> list[str]:
    """The files of paths and globs, sorted and each once. A pattern that matches nothing is an error."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found: set[str] = set()
    for pattern in [patterns] if isinstance(patterns, str) else patterns:
        path = jvm.org.apache.hadoop.fs.Path(pattern)
        status = path.getFileSystem(conf).globStatus(path)
        files = [s.getPath().toString() for s in status or [] if s.isFile()]
        if not files:
            raise InputError(f"no file matches {pattern}")
        found.update(files)
    return sorted(found)


def discover(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = PROSE) -> list[str]:
    """The files below a folder with one of the suffixes, sorted. A folder that isn't there is an error."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        raise InputError(f"no such file or folder: {folder}")
    files, found = fs.listFiles(path, True), []
    while files.hasNext():
        name = files.next().getPath().toString()
        if name.rsplit("/", 1)[-1].rpartition(".")[2].lower() in suffixes and "." in name.rsplit("/", 1)[-1]:
            found.append(name)
    return sorted(found)


def json_values(texts: DataFrame) -> DataFrame:
    """(file, ord, value): the values in texts (file, line_no, raw) as JSON, in order; value is null for a
    line that isn't JSON. A line may hold an array, whose items are values; blank lines hold none."""
    lines = texts.where(F.col("raw").rlike(r"\S"))
    items = F.when(F.col("raw").rlike(r"^\s*\["), F.from_json("raw", "array<variant>")).otherwise(F.array(F.try_parse_json("raw")))
    each = lines.select("file", "line_no", F.posexplode(F.coalesce(items, F.array(F.lit(None).cast("variant")))).alias("k", "v"))
    return each.select("file", F.struct("line_no", "k").alias("ord"), F.to_json("v").alias("value"))


def read_json_rows(spark: SparkSession, path: str | list[str], strict: bool = False) -> DataFrame:
    """(file, ord, value): rows of JSON files, each an array, an object, or an object a line.

    An array over several lines is one text, read whole; otherwise lines are read apart, in splits.
    Strict, any value that isn't JSON is an error; else it is a null value. A missing path is an error."""
    paths = expand_globs(spark, path)
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__at"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("raw"))
    first = lines.where(F.col("raw").rlike(r"\S")).groupBy("file").agg(F.min_by("raw", F.struct("__at", "line_no")).alias("first"), F.count("*").alias("n"))
    whole = first.where(F.col("first").rlike(r"^\s*\[?\s*\{?\s*$") | (F.col("first").rlike(r"^\s*\[") & (F.col("n") > 1) & F.try_parse_json("first").isNull()))
    as_whole = [r["file"] for r in whole.select("file").collect()]  # files of one array each, named by the caller
    out = lines.where(~F.col("file").isin(as_whole)) if as_whole else lines
    out = out.select("file", "line_no", "raw")
    if as_whole:
        texts = spark.read.text(as_whole, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.lit(0).cast("bigint").alias("line_no"), F.col("value").alias("raw"))
        out = out.unionAll(texts)
    rows = json_values(out)
    if strict:
        rows = rows.withColumn("value", F.when(F.col("value").isNull(), F.raise_error(F.concat(F.lit("not JSON in "), F.col("file")))).otherwise(F.col("value")))
    return rows


def as_text(rows: DataFrame, form: str = "compact", of: str | None = None) -> DataFrame:
    """(line): rows as JSON, compact or pretty, or as text: a column's own value, strings without quotes."""
    if form == "text":
        return rows.select(F.col(of or rows.columns[0]).cast("string").alias("line"))
    if form not in ("compact", "pretty"):
        raise ValueError(f"no such form: {form}")
    value: Column = _row(rows) if of is None else F.col(of)
    return rows.select(F.to_json(value, {"pretty": "true"} if form == "pretty" else {}).alias("line"))


def save_run(results: DataFrame, folder: str) -> None:
    """Test results as JSON lines, to be read again by saved_run()."""
    results.write.mode("overwrite").json(folder)


def saved_run(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(folder)
