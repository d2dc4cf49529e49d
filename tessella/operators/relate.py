"""Joins, lookup, group and diff of two sets of rows by a key.

A key is compared by its text (see key_text), so absent keys equal each other. The right side is an
index: of rows with one key the last counts, so a left row meets at most one. "Last" needs an order,
which the caller names; the index is built by one aggregation, not by sorting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.jsonval import key_text

KINDS = ("inner", "left", "anti", "semi")


def _key(df: DataFrame, path: str | Column) -> Column:
    if isinstance(path, Column):
        return key_text(path, df.select(path.alias("k")).schema["k"].dataType)
    name = path.lstrip(".")
    try:
        kind = df.select(F.col(name).alias("k")).schema["k"].dataType
    except Exception as e:  # a path that no row has is null everywhere
        if "UNRESOLVED_COLUMN" not in str(e) and "FIELD_NOT_FOUND" not in str(e):
            raise
        return F.lit("null")
    return key_text(F.col(name), kind)


def _row(df: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def index_last(right: DataFrame, key: str | Column, order: list[str]) -> DataFrame:
    """(__key, _right): the last row of each key."""
    place = F.struct(*[F.col(c) for c in order])
    return right.select(_key(right, key).alias("__key"), place.alias("__at"), _row(right).alias("__row")).groupBy("__key").agg(F.max_by("__row", "__at").alias("_right"))


def join(left: DataFrame, right: DataFrame, left_key, right_key, order: list[str], how: str = "inner") -> DataFrame:
    """inner and left: (_left, _right); anti and semi: rows of the left side. `order` names columns of
    the right side, the last of them by it being a key's row."""
    if how not in KINDS:
        raise ValueError(f"no such join: {how}")
    keyed = left.select(_key(left, left_key).alias("__key"), _row(left).alias("_left"))
    if how in ("anti", "semi"):
        keys = right.select(_key(right, right_key).alias("__key"))  # which row is last doesn't matter here
        return keyed.join(keys, "__key", f"left_{how}").select("_left.*")
    return keyed.join(index_last(right, right_key, order), "__key", how).select("_left", "_right")


def lookup(left: DataFrame, right: DataFrame, left_key, right_key, order: list[str], default: Column | None = None) -> DataFrame:
    """The left rows with _lookup: the right row or the default."""
    keyed = left.withColumn("__key", _key(left, left_key))
    found = keyed.join(index_last(right, right_key, order), "__key", "left")
    return found.select(*[F.col(f"`{c}`") for c in left.columns], (F.col("_right") if default is None else F.coalesce("_right", default)).alias("_lookup"))


def group(rows: DataFrame, key, order: list[str], value: Column | None = None) -> DataFrame:
    """(key, count, items) or with a value (key, count, values), in order of key."""
    place = F.struct(*[F.col(c) for c in order])
    what = _row(rows) if value is None else value
    out = rows.select(_key(rows, key).alias("key"), F.struct(place.alias("at"), what.alias("x")).alias("item")).groupBy("key").agg(F.count("*").alias("count"), F.array_sort(F.collect_list("item")).alias("__i"))
    numeric = F.col("key").try_cast("double")
    return out.select("key", "count", F.transform("__i", lambda s: s["x"]).alias("items" if value is None else "values")).orderBy(numeric.asc_nulls_last(), "key")


def diff(left: DataFrame, right: DataFrame, left_key, right_key, order: list[str]) -> DataFrame:
    """(side, row_left, row_right), side being only_left, only_right or both: left rows keep
    their repeats, right rows appear in `both` by the last of a key, and all rows of a key that the left side
    lacks are there. Only the last row of a key is gathered, so a hot key is no group."""
    a = left.select(_key(left, left_key).alias("__key"), _row(left).alias("row_left"))
    place = F.struct(*[F.col(c) for c in order])
    b = right.select(_key(right, right_key).alias("__key"), place.alias("__at"), _row(right).alias("row_right"))
    last = b.groupBy("__key").agg(F.max_by("row_right", "__at").alias("last"), F.lit(1).alias("__b"))
    joined = a.join(last, "__key", "left").select(F.when(F.col("__b").isNull(), "only_left").otherwise("both").alias("side"), "row_left", F.col("last").alias("row_right"))
    alone = b.join(a.select("__key").distinct(), "__key", "left_anti").select(F.lit("only_right").alias("side"), F.lit(None).cast(a.schema["row_left"].dataType).alias("row_left"), "row_right")
    return joined.unionAll(alone)


def budget_rows(rows: DataFrame, tokens: int, order: list[str], mode: str = "stop") -> DataFrame:
    """Rows as JSON lines within a budget of tokens, in order, and a last line that says what was left out.

    stop: up to the first that doesn't fit, the first always (a token is four bytes, one more a line).
    skip: whatever still fits (tokens rounded up); only the running total is kept, on the driver.
    cut: all text up to four bytes a token."""
    text = F.to_json(_row(rows))
    if mode == "stop":
        from pyspark.sql.window import Window

        cost = F.expr("octet_length(json) div 4 + 1")
        # a row costs a token at least, so what is kept is among the first `tokens` rows: tasks find them, only they are summed up in one
        first = rows.select(*order, text.alias("json")).orderBy(*order, "json").limit(max(1, tokens)).withColumn("cost", cost)
        w = Window.orderBy(*order, "json").rowsBetween(Window.unboundedPreceding, 0)
        used = first.withColumn("used", F.sum("cost").over(w)).withColumn("before", F.col("used") - F.col("cost"))
        kept = used.where((F.col("used") <= tokens) | (F.col("before") == 0)).select("json")
        count = rows.agg(F.count("*").alias("total")).crossJoin(kept.agg(F.count("*").alias("shown")))
        note = count.where("shown < total").select(F.to_json(F.struct(F.lit(True).alias("_truncated"), "shown", "total")).alias("json"))
        return kept.unionAll(note)
    out, used, left, spark = [], 0, 0, rows.sparkSession
    for r in rows.orderBy(*order).select(text.alias("json")).toLocalIterator():
        if mode == "skip":
            cost = -(-len(r.json.encode()) // 4)
            if used + cost <= tokens:
                out.append(r.json)
                used += cost
            else:
                left += 1
        elif mode == "cut":
            room = tokens * 4 - used
            raw = r.json.encode()
            if room <= 0:
                left += 1
                break
            out.append(raw[:room].decode(errors="ignore"))
            used += len(raw) + 1
        else:
            raise ValueError(f"no such budget: {mode}")
    if left and mode == "skip":
        out.append(f'{{"_truncated":true,"shown":{len(out)},"total":{len(out) + left}}}')
    return spark.createDataFrame([(x,) for x in out], "json string")
