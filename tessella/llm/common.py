"""Helpers that the operators of this folder share.

Texts are handled as Arrow buffers: a chunk of rows becomes one byte array plus offsets, and numpy
works on all its words at once. Large exchanges between tasks travel as *blobs*: each task packs its
entries for one target partition into a few binary rows, so that the JVM moves bytes, not records.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 2 << 20  # text that numpy takes at once; temporaries are some ten times this
FLUSH_BYTES = 24 << 20  # packed entries that a task holds before it emits its blobs
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 12, 13, 32]] = True  # what \s means to RE2, so that SQL splits alike
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. On a cluster the session must name it; in local mode a
    temporary one is made where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def written(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage, outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete a table made by written(), once nothing will read it again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ensure_columns(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast; absent ones as nulls. Other columns can't clash with ours."""
    return df.select(*[(F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()])


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `most` bytes of text; a longer text comes alone, whole."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < b.num_rows:
            base = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, base + most, "right")))
            yield b.slice(start, stop - start)
            start = stop


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null reads as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if data is None or not len(col):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]], o - o[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POW = np.ones(256, np.uint64)
np.multiply.accumulate(np.full(255, _BASE, np.uint64), out=_POW[1:])


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out


class Words:
    """Words of a chunk of texts: maximal runs of bytes that aren't white space.

    start, end: byte positions; doc: the row; first: index of each row's first word (rows + 1)."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.buf, self.offs = buf, offs
        word = ~_SPACE[buf]
        edge = np.zeros(len(buf) + 1, bool)
        if len(buf):
            edge[0], edge[-1] = word[0], word[-1]
            edge[1:-1] = word[1:] != word[:-1]
            cut = offs[1:-1]
            cut = cut[(cut > 0) & (cut < len(buf))]
            both = np.unique(cut[word[cut] & word[cut - 1]])  # texts that touch: end one word, begin another
        else:
            both = np.zeros(0, np.int64)
        at = np.flatnonzero(edge)
        if len(both):
            at = np.sort(np.concatenate([at, both, both]))
        self.start, self.end = at[0::2], at[1::2]
        self.first = np.searchsorted(self.start, offs).astype(np.int64)
        self.first[-1] = len(self.start)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offs) - 1), self.count)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit name of each word's bytes, the same in every task."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        length = self.end - self.start
        longest = int(length.max())
        pw = _POW if longest <= 256 else powers(longest)
        total = np.zeros(len(self.start), np.uint64)
        pos = np.arange(int(length.sum()), dtype=np.int64)
        begin = np.cumsum(length) - length
        pos -= np.repeat(begin, length)
        b = self.buf[pos + np.repeat(self.start, length)].astype(np.uint64)
        b += np.uint64(1)
        b *= pw[pos]
        total = np.add.reduceat(b, begin)
        return mix(total + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def by_partition(part: np.ndarray, count: int, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(count + 1))
    sorted_ = [a[order] for a in arrays]
    for p in range(count):
        if bounds[p] < bounds[p + 1]:
            yield p, [a[bounds[p] : bounds[p + 1]] for a in sorted_]


class Packer:
    """Packs records (a numpy structured array) into blobs by target partition."""

    SCHEMA = "p int, blob binary"

    def __init__(self, count: int):
        self.count, self.parts, self.bytes = count, [], 0

    def add(self, part: np.ndarray, rec: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(rec):
            self.parts.append((part.astype(np.int32), rec))
            self.bytes += rec.nbytes
        if self.bytes >= FLUSH_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            part, rec = np.concatenate([p for p, _ in self.parts]), np.concatenate([r for _, r in self.parts])
            self.parts, self.bytes = [], 0
            ps, blobs = [], []
            for p, (r,) in by_partition(part, self.count, rec):
                ps.append(p)
                blobs.append(r.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ps, pa.int32()), pa.array(blobs, pa.binary())], ["p", "blob"])


def unpack(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> np.ndarray:
    """All records of a partition's blobs."""
    found = [np.frombuffer(x.as_buffer(), dtype) for b in batches for x in b.column("blob")]
    return np.concatenate(found) if found else np.zeros(0, dtype)


def exchange(df: DataFrame, count: int) -> DataFrame:
    """Send each blob to the partition it names."""
    return df.repartitionById(count, F.col("p"))


def group_bounds(key: np.ndarray) -> np.ndarray:
    """Start of each run of equal keys in a sorted array, and its length at the end."""
    if not len(key):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])


def range_within(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each n, end to end."""
    lengths = np.asarray(lengths, np.int64)
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
