"""Line deduplication through a sharded minimal perfect hash.

All distinct line hashes are split into shards of about SHARD_LINES lines. Each shard gets a minimal
perfect hash (bit arrays of falling size, an entry placed in the first level where nothing collides
with it), which indexes compact arrays: a 16-bit fingerprint, a count, and for repeated lines the
first document. Lines are never joined and their texts never exchanged: tasks hash the lines of their
documents, combine equal ones, and send counts; documents then probe the arrays.

While all arrays together stay within `resident_bytes` every task holds them and documents don't move.
Arrays that no task could hold stay where they are, a shard a task, and the documents' line hashes
(24 bytes for each distinct line of a document) are streamed past them; what comes back is which of a
document's lines are repeated. The most frequent lines, at most HOT_LINES of them because their counts
add up to the lines there are, have arrays of their own that every task holds, so no shard is asked
for one line by every document. Both ways probe the same arrays and give the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Packer, by_partition, chunks, drop_written, exchange, mix, partitions, written

MIN_COUNT = 10
RESIDENT_BYTES = 64 << 20
SHARD_LINES = 1_000_000  # lines of a shard, counted before equal ones are combined
HOT_LINES = 500_000  # at most so many lines are probed in place at any size
_MISSING = -(1 << 63)  # stands for a null doc_id: before all others
_BLANK = " \t\r\f\v"
LEVELS = 40


def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys ^ np.uint64((level * 0x9E3779B97F4A7C15 + 0x1F123BB5) & (2**64 - 1))) % np.uint64(size)).astype(np.int64)


def _prints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys + np.uint64(0x51ED270B)) >> np.uint64(48)).astype(np.uint16)


class PerfectHash:
    """A minimal perfect hash of 64-bit keys: about three bits a key."""

    def __init__(self, sizes: list[int], words: np.ndarray, rest: np.ndarray):
        self.sizes, self.words, self.rest = sizes, words, rest
        ones = np.bitwise_count(words).astype(np.int64)
        self.rank = np.cumsum(ones) - ones
        self.placed = int(ones.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, words = [], []
        while len(keys) and len(sizes) < LEVELS:
            size = -(-2 * len(keys) // 64) * 64
            at = _slot(keys, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            keys = keys[~alone[at]]
        return cls(sizes, np.concatenate(words) if words else np.zeros(0, np.uint64), np.sort(keys))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; of a key that was not built in, any place or -1."""
        out = np.full(len(keys), -1, np.int64)
        left, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = _slot(keys[left], level, size)
            word, bit = base + (at >> 6), (at & 63).astype(np.uint64)
            value = self.words[word]
            hit = (value >> bit) & np.uint64(1) == 1
            below = value[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.rank[word[hit]] + np.bitwise_count(below)
            left, base = left[~hit], base + size // 64
        if len(left) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            same = self.rest[at] == keys[left]
            out[left[same]] = self.placed + at[same]
        return out


_COUNT = np.dtype([("h", "<u8"), ("n", "<i8"), ("owner", "<i8")])
SHARD_SCHEMA = "shard int, sizes array<bigint>, words binary, rest binary, prints binary, counts binary, owners binary, hot binary"


def _build_shard(keys: np.ndarray, counts: np.ndarray, owners: np.ndarray, min_count: int, hot_count: int) -> list:
    mph = PerfectHash.build(keys)
    order, hot = np.argsort(mph.index(keys)), counts >= hot_count
    n = np.minimum(counts[order], 2**32 - 1).astype(np.uint32)  # more only says that it is repeated
    return [mph.sizes, mph.words.tobytes(), mph.rest.tobytes(), _prints(keys)[order].tobytes(), n.tobytes(), owners[order][n >= min_count].tobytes(), np.rec.fromarrays([keys[hot], counts[hot], owners[hot]], dtype=_COUNT).tobytes()]


class Shard:
    def __init__(self, row: dict, min_count: int):
        self.mph = PerfectHash(list(row["sizes"]), np.frombuffer(row["words"], np.uint64), np.frombuffer(row["rest"], np.uint64))
        self.prints, counts = np.frombuffer(row["prints"], np.uint16), np.frombuffer(row["counts"], np.uint32)
        self.many = counts >= min_count
        self.owners = np.frombuffer(row["owners"], np.int64)
        self.owner_at = np.cumsum(self.many, dtype=np.int32) - 1

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is it a repeated line, which document keeps it)."""
        if not len(self.many):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = self.mph.index(keys)
        many = (at >= 0) & (self.prints[at] == _prints(keys)) & self.many[at]
        owner = np.zeros(len(keys), np.int64)
        owner[many] = self.owners[self.owner_at[at[many]]]
        return many, owner


class Lines:
    """Lines of a batch: texts split at line feeds, hash, row and ink (more than white space) of each line."""

    def __init__(self, b: pa.RecordBatch):
        self.texts = b.column("text").to_pylist()
        self.ids = b.column("doc_id").fill_null(_MISSING).to_numpy(zero_copy_only=False)
        self.split = [t.split("\n") if t is not None else [] for t in self.texts]
        self.count = np.array([len(x) for x in self.split], np.int64)
        flat = [x for s in self.split for x in s]
        digest = xxhash.xxh64_intdigest
        self.keys = np.array([digest(x.encode(), 42) for x in flat], np.uint64)
        self.ink = np.array([bool(x.strip(_BLANK)) for x in flat], bool)
        self.row = np.repeat(np.arange(len(self.split)), self.count)
        self.first = np.cumsum(self.count) - self.count


_ASK = np.dtype([("h", "<u8"), ("d", "<i8"), ("rid", "<i8")])


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (keys % np.uint64(shards)).astype(np.int64)


def _combined(rec: np.ndarray) -> np.ndarray:
    """Entries of equal lines as one: counts added, least owner."""
    rec = rec[np.argsort(rec["h"], kind="stable")]
    at = np.flatnonzero(np.concatenate([[True], rec["h"][1:] != rec["h"][:-1]])) if len(rec) else np.zeros(0, np.int64)
    out = np.empty(len(at), _COUNT)
    if len(at):
        out["h"], out["n"], out["owner"] = rec["h"][at], np.add.reduceat(rec["n"], at), np.minimum.reduceat(rec["owner"], at)
    return out


def line_arrays(docs: DataFrame, shards: int, min_count: int, hot_count: int) -> DataFrame:
    """One row a shard: the perfect hash of its distinct line hashes and its arrays."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, held = Packer(shards), np.zeros(0, _COUNT)
        for b in chunks(batches):
            x = Lines(b)
            rec = np.empty(int(x.ink.sum()), _COUNT)
            rec["h"], rec["n"], rec["owner"] = x.keys[x.ink], 1, x.ids[x.row[x.ink]]
            held = np.concatenate([held, _combined(rec)])
            if len(held) > SHARD_LINES:
                held = _combined(held)
                if len(held) > SHARD_LINES // 2:
                    yield from packer.add(_shard_of(held["h"], shards), held)
                    held = held[:0]
        held = _combined(held)
        yield from packer.add(_shard_of(held["h"], shards), held)
        yield from packer.flush()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list[np.ndarray]] = {}
        size: dict[int, list[int]] = {}
        for b in batches:
            for p, blob in zip(b.column("p").to_pylist(), b.column("blob")):
                own = got.setdefault(p, [])
                own.append(np.frombuffer(blob.as_buffer(), _COUNT))
                fresh, merged = size.setdefault(p, [0, 0])
                size[p][0] = fresh + len(own[-1])
                if size[p][0] > max(SHARD_LINES, merged):  # frequent lines come from every task: keep one entry of each
                    own[:] = [_combined(np.concatenate(own))]
                    size[p] = [0, len(own[0])]
        for p in sorted(got):
            rec = _combined(np.concatenate(got.pop(p)))
            row = [p, *_build_shard(rec["h"], rec["n"], rec["owner"], min_count, hot_count)]
            names = [x.split()[0] for x in SHARD_SCHEMA.split(", ")]
            kinds = [pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names)

    counted = docs.select("doc_id", "text").mapInArrow(count, Packer.SCHEMA)
    return written(exchange(counted, shards).mapInArrow(build, SHARD_SCHEMA), "line-arrays")


def _drop(lines: list[str], keys: np.ndarray, repeated: np.ndarray, owned: np.ndarray) -> np.ndarray:
    """Which lines of one document go: repeated ones, but for the first in the document that keeps it."""
    drop = repeated.copy()
    seen = set()
    for i in np.flatnonzero(repeated & owned):
        if keys[i] not in seen:
            seen.add(keys[i])
            drop[i] = False
    return drop


def dedup_lines(docs: DataFrame, min_count: int = MIN_COUNT, resident_bytes: int = RESIDENT_BYTES, shards: int | None = None) -> DataFrame:
    """`docs` with its texts cleaned, and n_lines, n_dropped: the lines before and those dropped.

    A line (between line feeds, compared as it is) that occurs at least min_count times in the table
    stays only where it first stands in the document with the least doc_id. Lines of white space alone
    are never dropped. A null text stays null with 0 lines; an empty one has 1 line. A null doc_id
    comes before all others; rows that share a doc_id (or have none) are one document in this rule and
    each keeps the line. A very long line or text is taken whole. An empty table gives no rows. Other
    columns pass through; columns n_lines and n_dropped of the
    input are replaced."""
    spark = docs.sparkSession
    min_count = max(min_count, 2)
    docs = docs.drop("n_lines", "n_dropped")
    for c, kind in (("doc_id", "bigint"), ("text", "string")):
        docs = docs.withColumn(c, (F.col(c) if c in docs.columns else F.lit(None)).cast(kind))
    lines = docs.agg(F.sum(F.octet_length("text") - F.octet_length(F.expr("replace(text, '\n', '')")) + 1)).first()[0] or 0
    shards = shards or max(partitions(spark), -(-lines // SHARD_LINES))
    arrays = line_arrays(docs, shards, min_count, max(min_count, -(-lines // HOT_LINES)))
    total = arrays.agg(F.sum(F.expr("octet_length(words) + octet_length(rest) + octet_length(prints) + octet_length(counts) + octet_length(owners)"))).first()[0] or 0
    if total <= resident_bytes:
        rows = spark.sparkContext.broadcast({r["shard"]: r.asDict() for r in arrays.drop("hot").collect()})
        drop_written(arrays)
        return _probe_in_place(docs, rows, shards, min_count)
    return _probe_routed(docs, arrays, shards, min_count)


def _cleaned(b: pa.RecordBatch, x: Lines, repeated: np.ndarray, owned: np.ndarray) -> list[pa.Array]:
    """(text, n_lines, n_dropped) of a batch's rows."""
    dropped, texts = np.zeros(len(x.split), np.int64), list(x.texts)
    for d in np.unique(x.row[repeated]):
        s = slice(x.first[d], x.first[d] + x.count[d])
        drop = _drop(x.split[d], x.keys[s], repeated[s], owned[s])
        dropped[d] = drop.sum()
        if dropped[d]:
            texts[d] = "\n".join(y for y, gone in zip(x.split[d], drop) if not gone)
    return [pa.array(texts, pa.string()), pa.array(x.count), pa.array(dropped)]


def _probe_in_place(docs: DataFrame, rows, shards: int, min_count: int) -> DataFrame:
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {p: Shard(r, min_count) for p, r in rows.value.items()}
        for b in chunks(batches):
            x = Lines(b)
            repeated, owner = np.zeros(len(x.keys), bool), np.zeros(len(x.keys), np.int64)
            for p, (i,) in by_partition(_shard_of(x.keys, shards), shards, np.arange(len(x.keys))):
                if p in held:
                    repeated[i], owner[i] = held[p].probe(x.keys[i])
            text, n, dropped = _cleaned(b, x, repeated & x.ink, owner == x.ids[x.row])
            cols = b.columns
            cols[b.schema.get_field_index("text")] = text
            yield pa.RecordBatch.from_arrays([*cols, n, dropped], [*b.schema.names, "n_lines", "n_dropped"])

    schema = docs.withColumns({"n_lines": F.lit(0).cast("bigint"), "n_dropped": F.lit(0).cast("bigint")}).schema
    return docs.mapInArrow(clean, schema)


def _probe_routed(docs: DataFrame, arrays: DataFrame, shards: int, min_count: int) -> DataFrame:
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("doc_id", "text").alias("rid"))  # the row's columns can't clash with ours
    frequent = np.concatenate([np.zeros(0, _COUNT), *(np.frombuffer(r["hot"], _COUNT) for r in arrays.where("octet_length(hot) > 0").select("hot").collect())])
    names = ("sizes", "words", "rest", "prints", "counts", "owners")
    hot = docs.sparkSession.sparkContext.broadcast(dict(zip(names, _build_shard(frequent["h"], frequent["n"], frequent["owner"], min_count, 1 << 62))))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, held = Packer(shards), Shard(hot.value, min_count)
        for b in chunks(batches):
            x = Lines(b)
            send = x.ink & ~held.probe(x.keys)[0]
            rec = np.empty(int(send.sum()), _ASK)
            row = x.row[send]
            rec["h"], rec["d"], rec["rid"] = x.keys[send], x.ids[row], b.column("rid").to_numpy()[row]
            rec = np.unique(rec)
            yield from packer.add(_shard_of(rec["h"], shards), rec)
        yield from packer.flush()

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None  # a shard's arrays come before what is asked of it
        for b in batches:
            for i in range(b.num_rows):
                if b.column("sizes")[i].is_valid:
                    shard = Shard({c: b.column(c)[i].as_py() for c in names}, min_count)
                    continue
                asked = np.frombuffer(b.column("blob")[i].as_buffer(), _ASK)
                many, owner = shard.probe(asked["h"])
                hit = asked[many]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(hit["rid"])), pa.array(np.ascontiguousarray(hit["h"]).view(np.int64)), pa.array(owner[many] == hit["d"])], ["rid", "h", "own"])

    held = arrays.select(F.col("shard").alias("p"), *names, F.lit(None).cast("binary").alias("blob"))
    asked = base.select(F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), "rid").mapInArrow(ask, Packer.SCHEMA)
    asked = asked.select("p", F.lit(None).cast("array<bigint>").alias("sizes"), *[F.lit(None).cast("binary").alias(c) for c in names[1:]], "blob")
    both = exchange(held.unionAll(asked), shards).sortWithinPartitions("p", F.col("sizes").isNull())
    hits = both.mapInArrow(probe, "rid bigint, h bigint, own boolean").groupBy("rid").agg(F.collect_set(F.struct("h", "own")).alias("hits"))
    joined = base.join(hits, "rid", "left").select("row", F.col("hits.h").alias("hits"), F.col("hits.own").alias("own"))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fields = {f.name: c for f, c in zip(b.column("row").type, b.column("row").flatten())}
            yield pa.RecordBatch.from_arrays([fields["doc_id"], fields["text"], *b.columns], ["doc_id", "text", "row", "hits", "own"])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident = Shard(hot.value, min_count)
        for b in chunks(opened(batches)):
            x = Lines(b)
            repeated, owner = resident.probe(x.keys)
            owned = owner == x.ids[x.row]
            for d, (h, own) in enumerate(zip(b.column("hits").to_pylist(), b.column("own").to_pylist())):
                if h:
                    keys, o = np.array(h, np.int64).view(np.uint64), np.array(own, bool)
                    order = np.argsort(keys)
                    keys, o = keys[order], o[order]
                    s = slice(x.first[d], x.first[d] + x.count[d])
                    at = np.minimum(np.searchsorted(keys, x.keys[s]), len(keys) - 1)
                    hit = keys[at] == x.keys[s]
                    repeated[s] |= hit
                    owned[s] = np.where(hit, o[at], owned[s])
            row = b.column("row")
            text, n, dropped = _cleaned(b, x, repeated & x.ink, owned)
            cols = [text if f.name == "text" else c for f, c in zip(row.type, row.flatten())]
            yield pa.RecordBatch.from_arrays([*cols, n, dropped], [*(f.name for f in row.type), "n_lines", "n_dropped"])

    schema = docs.withColumns({"n_lines": F.lit(0).cast("bigint"), "n_dropped": F.lit(0).cast("bigint")}).schema
    return joined.mapInArrow(clean, schema)


def op10_line_dedup(spark, sf_dir):
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
c AS (
  SELECT line, count(*) AS n, min(doc_id) AS owner FROM l WHERE regexp_matches(line, '[^ \t\r\f\v]') GROUP BY line HAVING count(*) >= {MIN_COUNT}),
m AS (
  SELECT l.doc_id, l.line, l.pos, c.n IS NOT NULL AND NOT (l.doc_id = c.owner AND row_number() OVER (PARTITION BY l.doc_id, l.line ORDER BY l.pos) = 1) AS gone
  FROM l LEFT JOIN c ON l.line = c.line)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped
FROM m GROUP BY doc_id
"""
