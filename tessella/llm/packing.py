"""Order-preserving packing of documents into training windows by dynamic programming.

The documents of a block, in order of doc_id, are one run of sentences. Windows of `capacity` tokens
are cut from it at document or sentence boundaries so that padding plus penalties for cutting through
documents is least: f(j) = min over i with S(j)-S(i) <= capacity of f(i) + capacity - (S(j)-S(i)) +
penalty(j). As f(i)+S(i) is minimised over a sliding range of i, a monotone queue finds each minimum
in constant time, so a block takes time linear in its sentences.

A block is a fixed number of distinct doc_ids in order, whatever their values, so the windows don't
depend on the partitioning; a window always ends with its block, which costs half a window of padding
a block on average. Only sentence lengths
are exchanged, never texts: a window is a list of pieces (doc_id, start_word, n_words).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Words, chunks, ensure_columns, partitions, text_bytes

CAPACITY, BLOCK = 2048, 2048
SENTENCE_PENALTY, HARD_PENALTY = 32, 256
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?"]] = True


def best_cuts(lengths: list[int], penalties: list[int], capacity: int) -> tuple[int, list[int]]:
    """(least cost, ends of the windows) for units in order, none longer than the capacity. The cost
    of a window that ends after unit j is its padding plus penalties[j]. Of equal costs the longest
    window wins."""
    n = len(lengths)
    if not n:
        return 0, []
    f, back = [0] * (n + 1), [0] * (n + 1)
    s = [0] * (n + 1)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (f(i) + S(i), i), rising
    popleft, pop, append = queue.popleft, queue.pop, queue.append
    total = 0
    for j in range(1, n + 1):
        total += lengths[j - 1]
        s[j] = total
        while total - s[queue[0][1]] > capacity:
            popleft()
        best, i = queue[0]
        back[j] = i
        f[j] = cost = best + capacity - total + penalties[j - 1]
        cost += total
        while queue and queue[-1][0] > cost:
            pop()
        append((cost, j))
    ends, j = [], n
    while j:
        ends.append(j)
        j = back[j]
    return f[n], ends[::-1]


def _units(words: Words, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths of sentences in words, those over the capacity in parts of it; is each the last of its sentence; units a document)."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, bool), np.zeros(len(words.first) - 1, np.int64)
    feeds = np.concatenate([[0], np.cumsum(words.buf == 10)])
    ends = _END[words.buf[words.end - 1]]
    ends[:-1] |= feeds[words.start[1:]] > feeds[words.end[:-1]]
    ends[words.first[1:][words.count > 0] - 1] = True
    stop = np.flatnonzero(ends) + 1
    length = np.diff(np.concatenate([[0], stop]))
    doc = words.doc[stop - 1]
    parts = -(-length // capacity)
    if (parts > 1).any():
        last = np.cumsum(parts) - 1
        out = np.full(int(parts.sum()), capacity, np.int64)
        out[last] = length - (parts - 1) * capacity
        whole = np.zeros(len(out), bool)
        whole[last] = True
        length, doc = out, np.repeat(doc, parts)
    else:
        whole = np.ones(len(length), bool)
    return length.astype(np.int32), whole, np.bincount(doc, minlength=len(words.first) - 1)


def block_starts(docs: DataFrame, block: int) -> np.ndarray:
    """The first doc_id of each block: every block-th of the distinct ids in order."""
    ids = docs.where("doc_id is not null").select("doc_id")
    n = partitions(docs.sparkSession)
    bounds = sorted(set(ids.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.01))) if n > 1 else []
    ranges = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col("doc_id").cast("double"))) if bounds else F.lit(0)
    ids = ids.distinct().withColumn("range", ranges)
    count = {r["range"]: r["count"] for r in ids.groupBy("range").count().collect()}
    before = np.cumsum([0, *[count.get(i, 0) for i in range(len(bounds))]]).tolist()
    place = F.array(*[F.lit(x).cast("bigint") for x in before])[F.col("range")] + F.row_number().over(Window.partitionBy("range").orderBy("doc_id")) - 1
    return np.array(sorted(r[0] for r in ids.withColumn("place", place).where(F.col("place") % block == 0).select("doc_id").collect()), np.int64)


def pack(docs: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, sentence_penalty: int = SENTENCE_PENALTY, hard_penalty: int = HARD_PENALTY) -> DataFrame:
    """(block, window, piece, doc_id, start_word, n_words, padding): the pieces of each window in order.

    Tokens are words (runs without white space). A sentence ends with a word that ends in . ! or ?,
    before a line feed, and with its document; one longer than the capacity is cut to parts of it,
    and only there a cut costs hard_penalty. padding is what its window lacks to the capacity.
    Texts that are null or have no word are in no window. Rows with a null doc_id form blocks of
    their own, below 0, by a hash of their text, as many as blocks of ids would be; rows that share a doc_id stand next to each other, shorter first, and each is packed.
    Of equal costs the longest window wins. A very long text takes as many windows as it needs. An empty table gives no rows; other columns are ignored."""
    docs = ensure_columns(docs, doc_id="bigint", text="string")
    starts = block_starts(docs, block)
    unnamed = docs.where("doc_id is null").agg(F.count("*")).first()[0]
    buckets = max(1, -(-unnamed // block))
    docs = docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1 - F.pmod(F.xxhash64("text"), F.lit(buckets))))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            words = Words(*text_bytes(b.column("text")))
            length, whole, count = _units(words, capacity)
            rec = (length << 1 | whole).astype(np.uint16 if capacity < 1 << 15 else np.uint32)
            cut = np.cumsum(count)
            blobs = [rec[e - c : e].tobytes() for c, e in zip(count, cut)]
            keep = pa.array(count > 0)
            ids = b.column("doc_id")
            at = np.searchsorted(starts, ids.fill_null(0).to_numpy(zero_copy_only=False), "right") - 1
            at = np.where(ids.is_null().to_numpy(zero_copy_only=False), b.column("bucket").fill_null(0).to_numpy(zero_copy_only=False), at)
            out = pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), ids, pa.array(words.count, pa.int64()), pa.array(blobs, pa.binary())], ["block", "doc_id", "n", "units"])
            yield out.filter(keep)

    def windows(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("n", "ascending"), ("units", "ascending")])
        ids, dtype = group.column("doc_id").to_pylist(), np.uint16 if capacity < 1 << 15 else np.uint32
        each = [np.frombuffer(x, dtype) for x in group.column("units").to_pylist()]
        doc = np.repeat(np.arange(len(each)), [len(x) for x in each])
        rec = np.concatenate(each)
        length = (rec >> 1).astype(np.int64)
        penalty = np.where(rec & 1, sentence_penalty, hard_penalty)
        penalty[np.cumsum([len(x) for x in each]) - 1] = 0
        _, ends = best_cuts(length.tolist(), penalty.tolist(), capacity)
        # a piece is a run of units of one document in one window
        ends = np.array(ends)
        window = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
        new = np.concatenate([[True], (window[1:] != window[:-1]) | (doc[1:] != doc[:-1])])
        at = np.flatnonzero(new)
        n_words = np.add.reduceat(length, at)
        before = np.cumsum(length) - length
        doc_start = before[np.searchsorted(doc, doc[at])]
        used = np.bincount(window[at], weights=n_words).astype(np.int64)
        w = window[at]
        piece = np.arange(len(at)) - np.searchsorted(w, w)
        return pa.table({
            "block": pa.array([group.column("block")[0].as_py()] * len(at), pa.int64()), "window": w, "piece": piece, "doc_id": pa.array([ids[i] for i in doc[at]], pa.int64()),
            "start_word": before[at] - doc_start, "n_words": n_words, "padding": capacity - used[w],
        })

    lengths = docs.mapInArrow(measure, "block bigint, doc_id bigint, n bigint, units binary")
    return lengths.groupBy("block").applyInArrow(windows, "block bigint, window bigint, piece bigint, doc_id bigint, start_word bigint, n_words bigint, padding bigint")


def op1_packing(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
