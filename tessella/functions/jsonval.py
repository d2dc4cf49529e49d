"""JSON values as keys and in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def key_text(col: Column, kind: T.DataType | None = None) -> Column:
    """The canonical text of a value as a key: 1, "1" and 1.0 are one key, and so are an absent value,
    null and the string "null"."""
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        text = F.to_json(col)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (col == F.floor(col)) & (F.abs(col) < 1e15)
        text = F.when(whole, col.try_cast("bigint").cast("string")).otherwise(col.cast("string"))
    else:
        text = col.cast("string")
    return F.coalesce(text, F.lit("null"))


def truthy(col: Column, kind: T.DataType | None = None) -> Column:
    """Anything but null and false."""
    if isinstance(kind, T.BooleanType):
        return F.coalesce(col, F.lit(False))
    return col.isNotNull()


def sort_key(json: Column) -> Column:
    """(rank, number, text) of a JSON text: null, false, true, numbers, strings, arrays, objects."""
    t = F.trim(json)
    rank = (
        F.when(t.isNull() | (t == "null"), 0).when(t == "false", 1).when(t == "true", 2)
        .when(t.startswith('"'), 4).when(t.startswith("["), 5).when(t.startswith("{"), 6).otherwise(3)
    )
    number = F.when(rank == 3, t.try_cast("double"))
    text = F.when(rank == 4, F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>")[0])
    return F.struct(rank.cast("tinyint").alias("rank"), number.alias("num"), text.alias("str"))


def blob_note(col: Column) -> Column:
    """How a binary value is shown."""
    return F.concat(F.lit("<blob "), F.octet_length(col).cast("string"), F.lit(" bytes>"))


def csv_line(col: Column) -> Column:
    """An array of strings as a CSV line; quotes only where a comma, quote, space or line feed asks for them."""
    quote = lambda x: F.when(x.rlike('[, "\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
    return F.array_join(F.transform(col, quote), ",", "")


def tsv_line(col: Column) -> Column:
    clean = lambda x: F.replace(F.replace(F.replace(x, F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    return F.array_join(F.transform(col, clean), "\t", "")
