"""All pairs of documents whose word n-gram sets have a Jaccard similarity of at least t.

Rare-first prefix filtering: every set is put in one global order (rarest n-gram first), and two sets
that are similar enough must share one of the first |x| - ceil(t|x|) + 1. Document frequencies are
exact and cover the corpus: all n-grams meet once by hash. An n-gram that no other document of a
fitting length has can't be shared, so only its number goes on, as the head of its document's order;
most documents have prefixes of nothing else and leave at this point. The rest meet on prefix n-grams, pass length and positional
filters, are reduced to one row a pair, and are verified once, behind a suffix filter.

Documents with equal sets have one key and are compared once, whatever their number. The result has one
row a document: the class that links connect it with, and how many documents it is linked to. So rows
grow with the documents, and no link between different texts is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, by_partition, chunks, drop_written, ensure_columns, exchange, group_bounds, mix, partitions, range_within, text_bytes, written

N, THRESHOLD = 3, 0.5
BLOCK = 256  # sets of one neighbourhood that are verified against one other such block
SIGNATURE = 64  # parts of a set whose sizes bound an overlap
HELD = 2_600_000  # n-grams that a task holds before it sends them
BROADCAST_BYTES = 32 << 20  # a table of keys that is sent to every task is no larger
PART_BYTES = 20 << 20  # n-grams that meet in one task: small enough for its memory, large enough that classes have several in it


def ngram_hashes(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each n-gram of each text. A text of 1 to n - 1 words has one, of all its words."""
    h = words.hashes()
    count = words.count
    full = np.maximum(count - n + 1, 0)
    start = np.repeat(words.first[:-1], full) + range_within(full)
    out = np.zeros(len(start), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * np.uint64(0xD1342543DE82EF95) + h[start + k]
        row = np.repeat(np.arange(len(count)), full)
        short = np.flatnonzero((count > 0) & (count < n))
        extra = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = count[short] > k
            extra[has] = extra[has] * np.uint64(0xD1342543DE82EF95) + h[words.first[short[has]] + k]
        extra += count[short].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    return mix(np.concatenate([out, extra])), np.concatenate([row, short])


def ngram_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams, sorted and distinct within each row; their row; class key and size of each row)."""
    g, row = ngram_hashes(words, n)
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    g, row = g[keep], row[keep]
    rows = len(words.count)
    size = np.bincount(row, minlength=rows)
    key = np.zeros(rows, np.uint64)
    has = size > 0
    if len(g):
        key[has] = np.add.reduceat(mix(g ^ np.uint64(0x2545F4914F6CDD1D)), (np.cumsum(size) - size)[has])
    return g, row, mix(key + size.astype(np.uint64)), size


def _six(x: np.ndarray) -> bytes:
    """The low 48 bits of each integer."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unsix(raw) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


_ROWS = "p int, source int, keys binary, sizes binary, counts binary, grams binary, extra binary"
_NAMES = [x.split()[0] for x in _ROWS.split(", ")]


def _blob(p: int, source: int, key: np.ndarray, size: np.ndarray, grams: np.ndarray, extra: np.ndarray | None = None) -> list:
    """n-grams of classes (rows in runs of equal key, cut at 255). With many partitions a class has few
    n-grams in each, so its own part is kept short: sizes take two bytes unless one needs four."""
    at = group_bounds(key)
    length = np.diff(at)
    if len(length) and length.max() > 255:
        parts = -(-length // 255)
        at = np.concatenate([np.repeat(at[:-1], parts) + 255 * range_within(parts), at[-1:]])
        length = np.diff(at)
    size = size[at[:-1]]
    return [p, source, key[at[:-1]].tobytes(), size.astype(np.uint16 if not len(size) or size.max() < 65536 else np.uint32).tobytes(), length.astype(np.uint8).tobytes(), _six(grams), b"" if extra is None else extra.astype(np.uint16).tobytes()]


def _batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], _NAMES)


def _read(batches: Iterator[pa.RecordBatch], extra: bool = False):
    """(key, size, n-gram[, extra]) of all the blobs; the n-gram has its partition in the top bits if it came from one."""
    parts = [[], [], [], []]
    for b in batches:
        for _, source, keys, sizes, counts, grams, more in zip(*[b.column(c) for c in _NAMES]):
            n = np.frombuffer(counts.as_buffer(), np.uint8)
            parts[0].append(np.repeat(np.frombuffer(keys.as_buffer(), np.uint64), n))
            parts[1].append(np.repeat(np.frombuffer(sizes.as_buffer(), np.uint16 if len(sizes.as_buffer()) == 2 * len(n) else np.uint32).astype(np.uint32), n))
            parts[2].append(_unsix(grams.as_buffer()) | (np.uint64(source.as_py()) << np.uint64(48)))
            if extra:
                parts[3].append(np.frombuffer(more.as_buffer(), np.uint16))
    if not parts[0]:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint64), np.zeros(0, np.uint16)
    return tuple(np.concatenate(x) if x else None for x in parts)


def _shared_grams(docs: DataFrame, n: int, t: float, count: int) -> DataFrame:
    """Per class (by partition of its key): the n-grams that other classes of a fitting length have too,
    with the number of classes that have them."""

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in chunks(batches):
            g, row, key, size = ngram_sets(Words(*text_bytes(b.column("text"))), n)
            held.append((g, key[row], size[row]))
            if sum(len(x[0]) for x in held) >= HELD:
                yield from send(held)
                held = []
        yield from send(held)

    def send(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if held:
            g, key, size = (np.concatenate(x) for x in zip(*held))
            part = ((g >> np.uint64(48)) % np.uint64(count)).astype(np.int32)
            rows = [_blob(p, 0, k, s, x) for p, (k, s, x) in by_partition(part, count, key, size, g)]
            for i in range(0, len(rows), 64):
                yield _batch(rows[i : i + 64])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        here = TaskContext.get().partitionId()
        key, size, g, _ = _read(batches)
        order = np.argsort(g)
        at = group_bounds(g[order])
        length = np.diff(at)
        order = order[np.repeat(length > 1, length)]
        key, size, g = key[order], size[order], g[order]
        order = np.lexsort((key, size, g))  # copies of a class count once
        key, size, g = key[order], size[order], g[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (key[1:] != key[:-1])
        key, size, g = key[new], size[new], g[new]
        length = np.diff(group_bounds(g))
        df = np.repeat(length, length)
        # whom no class of a fitting length shares the n-gram with, may as well be alone with it; the
        # nearest lengths are the neighbours in this order
        fits = (g[1:] == g[:-1]) & (size[:-1] >= t * size[1:] - 1e-9)
        many = np.zeros(len(g), bool)
        many[1:] |= fits
        many[:-1] |= fits
        key, size, g, df = key[many], size[many], g[many], df[many]
        order = np.argsort(key, kind="stable")
        key, size, g, df = key[order], size[order], g[order], np.minimum(df[order], 65535)
        rows = [_blob(p, here, k, s, x, d) for p, (k, s, x, d) in by_partition((key % np.uint64(count)).astype(np.int32), count, key, size, g, df)]
        if rows:
            yield _batch(rows)

    found = exchange(docs.select("text").mapInArrow(scatter, _ROWS), count).mapInArrow(meet, _ROWS)
    return exchange(found, count)


def _prefix_length(size: np.ndarray, t: float) -> np.ndarray:
    return size - np.ceil(t * size - 1e-9).astype(np.int64) + 1


def _candidates_of(shared: DataFrame, t: float) -> DataFrame:
    """(key, size, head, grams): classes with a shared n-gram in their prefix; grams in global order,
    after `head` that no other class has."""

    def order_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, size, g, df = _read(batches, extra=True)
        order = np.lexsort((g, df, key))
        key, size, g = key[order], size[order].astype(np.int64), g[order]
        at = group_bounds(key)
        length = np.diff(at)
        first = at[:-1]
        head = size[first] - length if len(g) else np.zeros(0, np.int64)
        keep = np.flatnonzero(_prefix_length(size[first], t) > head) if len(g) else []
        for i in range(0, len(keep), 2000):
            k = keep[i : i + 2000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[first[k]].view(np.int64)), pa.array(size[first[k]]), pa.array(head[k]), pa.array([g[at[x] : at[x + 1]].tobytes() for x in k], pa.binary())], ["key", "size", "head", "grams"]
            )

    return written(shared.mapInArrow(order_sets, "key bigint, size bigint, head bigint, grams binary"), "ngram-classes")


_PREFIX = np.dtype([("g", "<u8"), ("before", "<u8"), ("key", "<i8"), ("size", "<u4"), ("pos", "<u4")])  # before: the n-gram one place earlier, 0 at the start
_PAIR = np.dtype([("a", "<i8"), ("b", "<i8")])


def _least_overlap(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    return np.ceil(t / (1 + t) * (a + b) - 1e-9).astype(np.int64)


def _unique_pairs(rec: np.ndarray) -> np.ndarray:
    rec = rec[np.lexsort((rec["b"], rec["a"]))]
    new = np.ones(len(rec), bool)
    new[1:] = (rec["a"][1:] != rec["a"][:-1]) | (rec["b"][1:] != rec["b"][:-1])
    return rec[new]


def prefix_pairs(rec: np.ndarray, t: float) -> Iterator[np.ndarray]:
    """Pairs of classes that share a prefix n-gram and pass the length and positional filters.

    Two that have the same n-gram one place earlier have met there, with more room to the positional
    filter, so a pair is given where a run of shared n-grams begins."""
    rec = rec[np.lexsort((rec["key"], rec["size"], rec["g"]))]
    g, size, pos, key, before = rec["g"], rec["size"].astype(np.int64), rec["pos"].astype(np.int64), rec["key"], rec["before"]
    i = np.arange(len(rec))
    step = 0
    while len(i):
        step += 1
        i = i[i + step < len(rec)]
        j = i + step
        # sizes rise within an n-gram, so whoever is too short for j is too short for what follows
        fit = (g[i] == g[j]) & (size[i] >= t * size[j] - 1e-9)
        i, j = i[fit], j[fit]
        bound = np.minimum(size[i] - pos[i], size[j] - pos[j])  # this n-gram and what follows it
        ok = (bound >= _least_overlap(size[i], size[j], t)) & ((before[i] != before[j]) | (before[i] == 0))
        if ok.any():
            out = np.empty(int(ok.sum()), _PAIR)
            x, y = key[i[ok]], key[j[ok]]
            out["a"], out["b"] = np.minimum(x, y), np.maximum(x, y)
            yield out


_PAIRS = "p int, a binary, counts binary, b binary"


def _pair_blobs(rec: np.ndarray, count: int) -> Iterator[pa.RecordBatch]:
    """Unique pairs by partition of their first class, which is written once for all its partners."""
    rows = []
    for p, (r,) in by_partition((mix(rec["a"].view(np.uint64)) % np.uint64(count)).astype(np.int32), count, rec):
        at = group_bounds(r["a"])
        rows.append([p, r["a"][at[:-1]].tobytes(), np.diff(at).astype(np.uint32).tobytes(), np.ascontiguousarray(r["b"]).tobytes()])
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), [pa.int32(), *[pa.binary()] * 3])], ["p", "a", "counts", "b"])


def _candidate_pairs(sets: DataFrame, t: float, count: int) -> DataFrame:
    from .common import Packer, unpack

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(count)
        for b in batches:
            key, size, head = (b.column(c).to_numpy() for c in ("key", "size", "head"))
            grams = [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column("grams")]
            n = np.minimum(_prefix_length(size, t) - head, [len(x) for x in grams])
            rec = np.empty(int(n.sum()), _PREFIX)
            rec["g"] = np.concatenate([x[:k] for x, k in zip(grams, n)]) if len(n) else 0
            rec["before"] = np.concatenate([np.concatenate([np.zeros(1, np.uint64), x[: k - 1]]) for x, k in zip(grams, n) if k]) if len(rec) else 0
            rec["key"], rec["size"], rec["pos"] = np.repeat(key, n), np.repeat(size, n), np.repeat(head, n) + range_within(n)
            yield from packer.add(mix(rec["g"]) % np.uint64(count), rec)
        yield from packer.flush()

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for x in prefix_pairs(unpack(batches, _PREFIX), t):
            held.append(x)
            n += len(x)
            if n > 2_000_000:  # most are there again from other n-grams
                held = [_unique_pairs(np.concatenate(held))]
                n = len(held[0])
                if n > 1_000_000:
                    yield from _pair_blobs(held[0], count)
                    held, n = [], 0
        if held:
            yield from _pair_blobs(_unique_pairs(np.concatenate(held)), count)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.zeros(0, _PAIR)]
        for batch in batches:
            for a, n, b in zip(*[batch.column(c) for c in ("a", "counts", "b")]):
                x = np.empty(len(b.as_buffer()) // 8, _PAIR)
                x["a"], x["b"] = np.repeat(np.frombuffer(a.as_buffer(), np.int64), np.frombuffer(n.as_buffer(), np.uint32)), np.frombuffer(b.as_buffer(), np.int64)
                found.append(x)
        rec = _unique_pairs(np.concatenate(found))
        for i in range(0, len(rec), 50_000):
            x = rec[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x["a"])), pa.array(np.ascontiguousarray(x["b"]))], ["a", "b"])

    met = exchange(sets.mapInArrow(prefixes, Packer.SCHEMA), count).mapInArrow(pairs, _PAIRS)
    return written(exchange(met, count).mapInArrow(once, "a bigint, b bigint"), "ngram-pairs")


def overlaps(a: np.ndarray, b: np.ndarray, key: np.ndarray, size: np.ndarray, grams: list[np.ndarray], t: float) -> tuple[np.ndarray, np.ndarray]:
    """(index of each pair that is similar enough, its similarity)."""
    order = np.argsort(key)
    key, size, grams = key[order], size[order], [grams[i] for i in order]
    ia, ib = np.searchsorted(key, a), np.searchsorted(key, b)
    length = np.array([len(x) for x in grams], np.int64)
    names, gid = np.unique(np.concatenate(grams), return_inverse=True)
    start = np.cumsum(length) - length
    owner = np.repeat(np.arange(len(key)), length)
    sig = np.zeros((len(key), SIGNATURE), np.int32)
    np.add.at(sig, (owner, (mix(names) % np.uint64(SIGNATURE)).astype(np.int64)[gid]), 1)
    least = _least_overlap(size[ia], size[ib], t)
    live = []
    for i in range(0, len(a), 100_000):  # suffix filter: parts of the sets bound what they share
        s = slice(i, i + 100_000)
        live.append(i + np.flatnonzero(np.minimum(sig[ia[s]], sig[ib[s]]).sum(1) >= least[s]))
    live = np.concatenate(live) if live else np.zeros(0, np.int64)
    live = live[np.argsort(ia[live], kind="stable")]
    shared = np.zeros(len(live), np.int64)
    flag = np.zeros(len(names), np.int64)
    at = group_bounds(ia[live])
    for s, e in zip(at[:-1], at[1:]):
        if s == e:
            continue
        x = ia[live[s]]
        flag[gid[start[x] : start[x] + length[x]]] = 1
        for s2 in range(s, e, 4096):
            y = ib[live[s2 : min(e, s2 + 4096)]]
            n = length[y]
            hit = flag[gid[np.repeat(start[y], n) + range_within(n)]]
            shared[s2 : s2 + len(y)] = np.add.reduceat(hit, np.cumsum(n) - n)
        flag[gid[start[x] : start[x] + length[x]]] = 0
    j = shared / (size[ia[live]] + size[ib[live]] - shared)
    ok = j >= t
    return live[ok], j[ok]


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n vertices the least vertex that the edges (a, b) connect it with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verified(pairs: DataFrame, sets: DataFrame, t: float, count: int, copies: DataFrame | None = None) -> DataFrame:
    """(a, b, jaccard) of the pairs of keys that are similar enough. With `copies` (key, copies; absent keys
    have one) they are summed up where they are verified, to (key, others, root): how many copies a key's
    partners there have, and the least key that it is connected with there. That has a row or a few a key,
    while pairs grow with the square of a class.

    Classes that share neighbours are verified together: a class belongs to the cell of its least
    neighbour, cells are cut to blocks, and a pair goes where its two blocks meet, so a set travels
    once for each block that it has partners in, not once a partner."""
    ends = pairs.select(F.col("a").alias("key"), F.col("b").alias("other")).unionAll(pairs.select("b", "a"))
    cell = ends.groupBy("key").agg(F.least("key", F.min("other")).alias("cell"))
    width = cell.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    block = cell.join(width, "cell").select("key", F.expr("xxhash64(cell, pmod(xxhash64(key), blocks))").alias("block"))
    placed = pairs.join(block.select(F.col("key").alias("a"), F.col("block").alias("ba")), "a").join(block.select(F.col("key").alias("b"), F.col("block").alias("bb")), "b")
    buckets = 4 * count
    placed = placed.select("a", "b", F.expr(f"int(pmod(xxhash64(least(ba, bb), greatest(ba, bb)), {buckets}))").alias("site"))
    placed = written(placed, "ngram-sites")
    needed = placed.select(F.col("site").alias("at"), F.col("a").alias("key")).unionAll(placed.select("site", "b")).distinct()
    if copies is None:
        needed = needed.withColumn("copies", F.lit(1).cast("bigint"))
    else:
        needed = needed.join(copies, "key", "left").select("at", "key", F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies"))
    needed = written(needed, "ngram-needed")
    if needed.count() * 24 <= BROADCAST_BYTES:  # spares the sets an exchange
        needed = F.broadcast(needed)
    needed = sets.join(needed, "key")

    as_pairs = copies is None

    def verify(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = (left.column(c).to_numpy() for c in ("a", "b"))
        grams = [np.frombuffer(x.as_buffer(), np.uint64) for x in right.column("grams")]
        keys = right.column("key").to_numpy()
        i, j = overlaps(a, b, keys, right.column("size").to_numpy(), grams, t)
        if as_pairs:
            return pa.table({"a": a[i], "b": b[i], "jaccard": j})
        order = np.argsort(keys)
        keys, weight = keys[order], right.column("copies").to_numpy()[order]
        x, y = np.searchsorted(keys, a[i]), np.searchsorted(keys, b[i])
        others = np.zeros(len(keys), np.int64)
        np.add.at(others, x, weight[y])
        np.add.at(others, y, weight[x])
        on = np.flatnonzero(others)
        return pa.table({"key": keys[on], "others": others[on], "root": keys[_forest(x, y, len(keys))[on]]})

    schema = "a bigint, b bigint, jaccard double" if as_pairs else "key bigint, others bigint, root bigint"
    return placed.groupBy("site").cogroup(needed.groupBy("at")).applyInArrow(verify, schema)


def _joined(docs: DataFrame, n: int, threshold: float, as_pairs: bool) -> tuple[DataFrame, DataFrame]:
    """((doc_id, rid, key) of every document with n-grams, what _verified() gives), both written."""
    spark = docs.sparkSession
    docs = ensure_columns(docs, doc_id="bigint", text="string").where("doc_id is not null and text is not null")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            _, _, key, size = ngram_sets(Words(*text_bytes(b.column("text"))), n)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("rid"), pa.array(key.view(np.int64)), pa.array(size)], ["doc_id", "rid", "key", "size"])

    members = written(docs.withColumn("rid", F.xxhash64("text")).mapInArrow(keys, "doc_id bigint, rid bigint, key bigint, size bigint").where("size > 0"), "ngram-members")
    grams = members.agg(F.sum("size")).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-6 * grams // PART_BYTES))
    count = max(partitions(spark), parts)
    sets = _candidates_of(_shared_grams(docs, n, threshold, min(60_000, parts)), threshold)  # a partition's number takes 16 bits
    pairs = _candidate_pairs(sets, threshold, count)
    copies = None if as_pairs else members.select("doc_id", "key").distinct().groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1")
    near = written(_verified(pairs, sets, threshold, count, copies), "ngram-near")
    drop_written(pairs)
    drop_written(sets)
    return members.drop("size"), near


def similar_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, match_id, jaccard), doc_id < match_id, between representatives: equal n-gram sets are named
    by their least doc_id, with a row (that, member, 1.0) for each other member and one for each pair of
    similar sets. See similar_documents() for what is compared; rows that share a doc_id don't match."""
    members, near = _joined(docs, n, threshold, True)
    names = members.groupBy("key").agg(F.min("doc_id").alias("least"))
    equal = members.join(names, "key").where("doc_id > least").select(F.col("least").alias("doc_id"), F.col("doc_id").alias("match_id"), F.lit(1.0).alias("jaccard"))
    near = near.join(names.select(F.col("key").alias("a"), F.col("least").alias("x")), "a").join(names.select(F.col("key").alias("b"), F.col("least").alias("y")), "b")
    near = near.where("x <> y").select(F.least("x", "y").alias("doc_id"), F.greatest("x", "y").alias("match_id"), "jaccard")
    return equal.unionByName(near).groupBy("doc_id", "match_id").agg(F.max("jaccard").alias("jaccard"))


def _classes(members: DataFrame, near: DataFrame) -> DataFrame:
    """(key, root): each key that is similar to another with the key that names all connected ones."""
    return components(near.select(F.col("key").alias("a"), F.col("root").alias("b"))).select(F.col("v").alias("key"), "root")


def similar_documents(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, links): a row for each document that is similar to another.

    Two documents are linked if the Jaccard similarity of their n-gram sets is at least the threshold (a
    similarity equal to it counts); links is how many others a document is linked to, copies among them
    counted one by one. Links connect documents to classes; class_id is the least doc_id of a class.
    Words are runs without white space, compared as they are. A text of fewer than n words is one
    n-gram; null texts and texts without words have none and are linked to nothing; a very long text is
    taken whole. Rows with a null doc_id are left out; rows that share a doc_id and an n-gram set count
    once, with different sets they are documents of their own. An empty table gives no rows. Other
    columns are ignored."""
    members, near = _joined(docs, n, threshold, False)
    members = members.select("doc_id", "key").distinct()
    names = members.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    linked = near.groupBy("key").agg(F.sum("others").alias("others"))
    some = names.join(linked, "key", "left").withColumn("links", F.col("copies") - 1 + F.coalesce("others", F.lit(0))).where("links > 0")
    some = written(some.join(_classes(members, near), "key", "left").select("key", "least", "links", F.coalesce("root", "key").alias("root")), "ngram-classes")
    least = some.groupBy("root").agg(F.min("least").alias("class_id"))
    return members.join(some.join(least, "root").select("key", "class_id", "links"), "key").select("doc_id", "class_id", "links")


def components(edges: DataFrame) -> DataFrame:
    """(v, root): each vertex of the edges (a, b) with the least vertex of its component, by large-star
    and small-star rounds, each a pair of aggregations over the edges that are left."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        around = both if large else both.where("b < a")
        low = around.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        out = around.join(low, "a")
        out = out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else out.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    e, before = edges.select("a", "b").where("a <> b"), None
    while True:
        new = written(star(star(e, True), False), "components")
        sign = new.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", F.lit(1), "a"))).first()
        if before is not None:
            drop_written(e)
        if sign == before:
            return new.select(F.col("a").alias("v"), F.col("b").alias("root"))
        e, before = new, sign


def drop_near_copies(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without near copies: of each class that links connect one document stays, the one of the
    least doc_id; of several n-gram sets that share that id in the class, the one of the least hash.
    Columns as before.

    A row is judged by its own text, so of rows that share a doc_id only near copies go. Repeated rows
    stay or go together. Rows with a null doc_id or without words stay. An empty table stays empty."""
    members, near = _joined(docs, n, threshold, False)
    keyed = members.join(_classes(members, near), "key", "left").withColumn("root", F.coalesce("root", "key"))
    first = keyed.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    gone = keyed.join(first, "root").where("doc_id <> first.doc_id or key <> first.key").select(F.col("doc_id").alias("__gone_id"), F.col("rid").alias("__gone_rid")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[(F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(f"__{c}") for c, t in (("doc_id", "bigint"), ("text", "string"))])
    rows = rows.withColumn("__rid", F.xxhash64("__text")).drop("__text")
    return rows.join(gone, (F.col("__doc_id") == F.col("__gone_id")) & (F.col("__rid") == F.col("__gone_rid")), "left_anti").select("row.*")


def op6_ngram_jaccard_join(spark, sf_dir):
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\r\f]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
s AS (
  SELECT doc_id, CASE WHEN len(w) < {N} THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - {N} + 2), lambda i: {" || ' ' || ".join(f"w[i + {k}]" for k in range(N))}))) END AS grams
  FROM w WHERE len(w) > 0),
k AS (SELECT grams, min(doc_id) AS least, count(*) AS copies FROM s GROUP BY grams),
g AS (SELECT least, len(grams) AS size, unnest(grams) AS g FROM k),
o AS (
  SELECT a.least AS x, b.least AS y, any_value(a.size) AS sx, any_value(b.size) AS sy, count(*) AS n
  FROM g a JOIN g b ON a.g = b.g AND a.least < b.least GROUP BY a.least, b.least),
e AS (
  SELECT x, y FROM o WHERE n / (sx + sy - n) >= {THRESHOLD}
  UNION ALL SELECT y, x FROM o WHERE n / (sx + sy - n) >= {THRESHOLD}),
r AS (SELECT least AS v, least AS u FROM k UNION SELECT r.v, e.y FROM r JOIN e ON r.u = e.x),
c AS (SELECT v, min(u) AS class_id FROM r GROUP BY v),
l AS (SELECT e.x, sum(k.copies) AS others FROM e JOIN k ON e.y = k.least GROUP BY e.x)
SELECT s.doc_id, c.class_id, CAST(k.copies - 1 + coalesce(l.others, 0) AS BIGINT) AS links
FROM s JOIN k ON s.grams = k.grams JOIN c ON c.v = k.least LEFT JOIN l ON l.x = k.least
WHERE k.copies > 1 OR l.others > 0
"""
