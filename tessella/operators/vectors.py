"""Collections of vectors: search, fuzzy join, relate, classify, upkeep.

A query side that is small travels to every task and scoring is a product of matrices there, block by
block; nothing is sorted before the best k of each task are known. Where both sides are large, blocks
of both meet pairwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SMALL_BYTES = 64 << 20  # a side up to this size is sent to every task
BLOCK = 4096


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / F.when(norm != 0, norm))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p.cast("double") - q.cast("double")) ** 2), F.lit(0.0), lambda s, v: s + v))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows of length 1; a null one is zeros. Vectors of different widths are an error."""
    rows = column.to_pylist()
    widths = {len(r) for r in rows if r is not None}
    if len(widths) > 1:
        raise ValueError(f"vectors of different widths: {sorted(widths)}")
    m = np.zeros((len(rows), widths.pop() if widths else 0))
    for i, r in enumerate(rows):
        if r is not None:
            m[i, : len(r)] = r
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def size_bytes(df: DataFrame, vector: str) -> int:
    """Bytes of a side's vectors, counted from their number and width, not guessed."""
    return int(df.agg(F.coalesce(F.sum(F.size(vector).cast("bigint") * 8 + 64), F.lit(0))).first()[0])


def scored_pairs(left: DataFrame, right: DataFrame, threshold: float, k: int | None = None) -> DataFrame:
    """(left_key, right_key, score) of all pairs with a cosine of at least the threshold.

    left and right are (key, embedding). The smaller side is broadcast if its counted size allows;
    else every block of one side meets every block of the other. With k, each task only gives a left
    key's best k, which is enough to find the best k of all."""
    key_type = left.schema["key"].dataType.simpleString()
    right_type = right.schema["key"].dataType.simpleString()
    schema = f"left_key {key_type}, right_key {right_type}, score double"

    def pairs(lk, lm, rk, rm) -> Iterator[pa.RecordBatch]:
        lt, rt = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (lk, rk))
        if not lm.shape[1] or not rm.shape[1]:  # nulls only: a cosine of 0
            lm, rm = (np.zeros((len(x), 1)) for x in (lm, rm))
        if lm.shape[1] != rm.shape[1]:
            raise ValueError(f"vectors of different widths: {lm.shape[1]} and {rm.shape[1]}")
        for i in range(0, len(lm), 1024):
            s = lm[i : i + 1024] @ rm.T
            if k is not None and s.shape[1] > k:
                least = np.partition(s, s.shape[1] - k, axis=1)[:, -k]
                a, b = np.nonzero((s >= threshold) & (s >= least[:, None]))
            else:
                a, b = np.nonzero(s >= threshold)
            if len(a):
                yield pa.RecordBatch.from_arrays([lt.take(pa.array(a + i)), rt.take(pa.array(b)), pa.array(s[a, b])], ["left_key", "right_key", "score"])

    small = right.select("key", "embedding")
    if size_bytes(right, "embedding") <= SMALL_BYTES:
        rows = small.toArrow()
        held = left.sparkSession.sparkContext.broadcast((rows.column("key").combine_chunks(), _matrix(rows.column("embedding"))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rk, rm = held.value
            for b in batches:
                if b.num_rows and len(rk):
                    yield from pairs(b.column("key"), _matrix(b.column("embedding")), rk, rm)

        return left.select("key", "embedding").mapInArrow(run, schema)

    def blocks(df: DataFrame) -> tuple[DataFrame, int]:
        n = max(1, -(-df.count() // BLOCK))
        return df.select("key", "embedding", F.expr(f"pmod(xxhash64(key), {n})").alias("block")), n

    (a, na), (b, nb) = blocks(left), blocks(right)
    a = a.select("key", "embedding", "block", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("other")).withColumn("site", F.col("block") * nb + F.col("other"))
    b = b.select("key", "embedding", "block", F.explode(F.sequence(F.lit(0), F.lit(na - 1))).alias("other"))
    b = b.select(F.col("key").alias("right_key"), F.col("embedding").alias("right_embedding"), (F.col("other") * nb + F.col("block")).alias("right_site"))  # own names: both sides may be one table

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        out = []
        if x.num_rows and y.num_rows:
            out = list(pairs(x.column("key"), _matrix(x.column("embedding")), y.column("right_key"), _matrix(y.column("right_embedding"))))
        return pa.Table.from_batches(out) if out else pa.table({"left_key": pa.array([], x.schema.field("key").type), "right_key": pa.array([], y.schema.field("right_key").type), "score": pa.array([], pa.float64())})

    return a.groupBy("site").cogroup(b.groupBy("right_site")).applyInArrow(meet, schema)


def top_k(items: DataFrame, query: list[float], k: int = 5, threshold: float = 0.0) -> DataFrame:
    """(key, score): the k items most like the query."""
    wanted = F.array(*[F.lit(float(x)) for x in query])
    scored = items.select("key", F.round(cosine(F.col("embedding"), wanted), 6).alias("score"))
    return scored.where(F.col("score") >= threshold).orderBy(F.desc("score"), "key").limit(k)


search = top_k


def similar(items: DataFrame, key, k: int = 5, threshold: float = 0.0) -> DataFrame:
    """The k items most like a stored one, without it."""
    row = items.where(F.col("key") == F.lit(key)).select("embedding").first()
    if row is None:
        raise KeyError(key)
    return top_k(items.where(F.col("key") != F.lit(key)), list(row[0]), k, threshold)


def fuzzy_join(left: DataFrame, right: DataFrame, threshold: float = 0.75, digits: int = 3) -> DataFrame:
    """(left_key, right_key, score) of pairs at or above the threshold, by rounded score."""
    return scored_pairs(left, right, threshold).withColumn("score", F.round("score", digits))


def relate(left: DataFrame, right: DataFrame, k: int = 3, threshold: float = 0.5, digits: int = 3) -> DataFrame:
    """(left_key, matches): each left item's best k of the right side; those without any are left out."""
    pairs = scored_pairs(left, right, threshold, k)
    w = Window.partitionBy("left_key").orderBy(F.desc("score"), "right_key")
    best = pairs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    matches = F.array_sort(F.collect_list(F.struct("place", "right_key", F.round("score", digits).alias("score"))))
    return best.groupBy("left_key").agg(matches.alias("m")).select("left_key", F.transform("m", lambda s: F.struct(s["right_key"].alias("key"), s["score"].alias("score"))).alias("matches"))


def classify(items: DataFrame, categories: DataFrame, threshold: float = 0.3, digits: int = 3) -> DataFrame:
    """(key, category, score): the category most like each item, the first of equal ones, if like enough."""
    pairs = scored_pairs(items, categories, threshold)
    best = pairs.groupBy("left_key").agg(F.max("score").alias("score"), F.min_by("right_key", F.struct(-F.col("score"), "right_key")).alias("category"))
    return best.select(F.col("left_key").alias("key"), "category", F.round("score", digits).alias("score"))


def knn(items: DataFrame, query: list[float], k: int) -> DataFrame:
    """(key, distance): the k nearest by Euclidean distance."""
    wanted = F.array(*[F.lit(float(x)) for x in query])
    return items.select("key", F.round(euclidean(F.col("embedding"), wanted), 6).alias("distance")).orderBy("distance", "key").limit(k)


def hashed_embedding(text: Column, dims: int = 384) -> Column:
    """A stand-in for an embedding model: the count of each hashed word, so equal words give likeness."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dims)))
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("float"))


# Collections are folders of parquet: (key, embedding, text, metadata). A change writes a new version
# beside the old one and then names it, so that readers never see half of it.


class Collection:
    def __init__(self, spark: SparkSession, folder: str, name: str, model: str = "hashed", dims: int = 384):
        self.spark, self.path, self.name, self.model, self.dims = spark, f"{folder}/{name}", name, model, dims

    def _versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        done = [s.getPath() for s in fs.listStatus(path) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName()[1:]) for p in done)

    def exists(self) -> bool:
        return bool(self._versions())

    def load(self) -> DataFrame:
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], "key string, embedding array<float>, text string, metadata string")
        return self.spark.read.parquet(f"{self.path}/v{versions[-1]}")

    def save(self, items: DataFrame) -> None:
        versions = self._versions()
        items.select("key", "embedding", "text", "metadata").write.parquet(f"{self.path}/v{versions[-1] + 1 if versions else 0}")

    def index(self, rows: DataFrame, key: str = "key", text: str = "text", upsert: bool = False, order: list[str] | None = None) -> None:
        """Add rows by key; a key that is there stays unless upsert. Within one batch the last row counts."""
        whole = F.to_json(F.struct(*rows.columns))
        col = lambda c: F.coalesce(F.col(c).cast("string"), whole) if c in rows.columns else whole
        new = rows.select(col(key).alias("key"), col(text).alias("text"), whole.alias("metadata"), F.struct(*(order or rows.columns)).alias("at"))
        new = new.groupBy("key").agg(F.max_by(F.struct("text", "metadata"), "at").alias("r")).select("key", "r.*").withColumn("embedding", hashed_embedding(F.col("text"), self.dims))
        old = self.load()
        if upsert:
            old = old.join(new, "key", "left_anti")
        else:
            new = new.join(old, "key", "left_anti")
        self.save(old.unionByName(new))

    def invalidate(self, keys: DataFrame) -> dict[str, int]:
        """Take out the rows with these keys."""
        old = self.load()
        rest = old.join(keys.select("key"), "key", "left_anti")
        before = old.count()
        self.save(rest)
        after = self.load().count()
        return {"removed": before - after, "remaining": after}

    def stats(self) -> DataFrame:
        return collection_stats(self.load(), self.name, self.model)


def collection_stats(items: DataFrame, name: str, model: str) -> DataFrame:
    """(collection, items, model, dims, size_mb)."""
    n, dims = F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))
    return items.agg(F.lit(name).alias("collection"), n.alias("items"), F.lit(model).alias("model"), dims.alias("dims"), F.round(n * dims * 4 / 1048576.0, 2).alias("size_mb"))
