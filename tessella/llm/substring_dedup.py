"""Long passages that occur more than once, by recompression.

Each text is a string of symbols, at first its words. Rounds replace runs of one symbol, and then
neighbouring pairs whose left symbol falls into one half of the alphabet and whose right symbol into
the other, by new symbols. A new symbol's name is a 64-bit hash of what it replaces, so all tasks
name alike without asking each other, and equal substrings are parsed alike except near their ends.
Only symbols that span at most 1, 2, then 4 words are replaced, so what a substring loses at an end
is bounded (14 words a side) and 50 equal words always hold whole symbols in common.

A Spark round then brings equal high-level symbols together (a few consecutive ones, of twelve words
or more; also long runs, whatever their length): one that occurs once in the corpus is dropped, and
with it nearly all text. Where shared ones lie the passages are verified: every window of min_words
that holds one is compared with all other such windows, in another round. A window is repeated if it
occurs twice; a passage is a maximal stretch of words that repeated windows cover.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, by_partition, chunks, ensure_columns, exchange, group_bounds, mix, partitions, powers, range_within, text_bytes, written

MIN_WORDS = 50
LEVELS = (1, 1, 2, 2, 4, 4)  # most words of a symbol that a round replaces
KEY_WORDS, RUN_WORDS = 12, 8
HELD = 2_000_000
BROADCAST_BYTES = 32 << 20
_A, _B = np.uint64(0xD1342543DE82EF95), np.uint64(0xA24BAED4963EE407)
_INVERSE = np.uint64(pow(int(_A), -1, 1 << 64))


def recompress(sym: np.ndarray, doc: np.ndarray) -> tuple[list[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """([symbols, their spans, starts, docs] after all rounds, (name, start, span) of long runs)."""
    span, start = np.ones(len(sym), np.int64), np.arange(len(sym))
    runs = []
    for k, most in enumerate(LEVELS):
        if len(sym) < 2:
            break
        same = (sym[1:] == sym[:-1]) & (doc[1:] == doc[:-1]) & (span[1:] <= most)
        if same.any():
            at = np.concatenate([[0], np.flatnonzero(~same) + 1])
            times = np.diff(np.concatenate([at, [len(sym)]]))
            base, sym, doc, start = sym[at], sym[at].copy(), doc[at], start[at]
            span = span[at] * times
            many = times > 1
            sym[many] = mix(sym[many] * _A + times[many].astype(np.uint64) * _B + np.uint64(k))
            long = many & (span >= RUN_WORDS)
            name, unit = mix(base[long] ^ np.uint64(0x5851F42D4C957F2D)), span[long] // times[long]
            runs.append((name, start[long], span[long]))
            self = span[long] >= MIN_WORDS + unit  # it repeats itself, one unit further on
            runs.append((name[self], start[long][self] + unit[self], span[long][self] - unit[self]))
        fit = span <= most
        right = (mix(sym ^ mix(np.array([k + 77], np.uint64))) >> np.uint64(63)) == 1
        left = np.zeros(len(sym), bool)
        left[:-1] = fit[:-1] & fit[1:] & ~right[:-1] & right[1:] & (doc[:-1] == doc[1:])
        i = np.flatnonzero(left)
        sym, span = sym.copy(), span.copy()
        sym[i] = mix(sym[i] * _A + sym[i + 1] * _B + np.uint64(k + 1000))
        span[i] += span[i + 1]
        keep = np.ones(len(sym), bool)
        keep[i + 1] = False
        sym, span, start, doc = sym[keep], span[keep], start[keep], doc[keep]
    found = tuple(np.concatenate(x) for x in zip(*runs)) if runs else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return [sym, span, start, doc], found


def _sums(x: np.ndarray) -> np.ndarray:
    """Prefix sums that give the polynomial hash of any stretch."""
    with np.errstate(over="ignore"):
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * powers(len(x), _A)[: len(x)], dtype=np.uint64)])


def stretch_hashes(x: np.ndarray, a: np.ndarray, b: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """A hash of x[a:b] for each a and b."""
    if not len(a):
        return np.zeros(0, np.uint64)
    sums = _sums(x) if sums is None else sums
    with np.errstate(over="ignore"):
        return mix((sums[b] - sums[a]) * powers(len(x) + 1, _INVERSE)[a] + (b - a).astype(np.uint64))


def shared_keys(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, doc, start word in the doc, span): a key for each high-level symbol with as many followers
    as make KEY_WORDS words; a run's key has bit 31 of its span set."""
    doc = words.doc
    (sym, span, start, owner), (run, run_start, run_span) = recompress(words.hashes(), doc)
    end = start + span
    j = np.searchsorted(end, start + KEY_WORDS)  # the first symbol that ends far enough
    ok = j < len(sym)
    i, j = np.flatnonzero(ok), j[ok]
    ok = owner[i] == owner[j]
    i, j = i[ok], j[ok]
    key = stretch_hashes(sym, i, j + 1)
    at = np.concatenate([start[i], run_start])
    spans = np.concatenate([end[j] - start[i], run_span | (1 << 31)]) if len(run) else end[j] - start[i]
    key = np.concatenate([key, run])
    d = doc[at] if len(at) else np.zeros(0, np.int64)
    return key, d, at - words.first[d], spans


_ROWS = "p int, docs binary, counts binary, hashes binary, a binary, b binary"
_NAMES = [x.split()[0] for x in _ROWS.split(", ")]


def _blob(p: int, ids: np.ndarray, h: np.ndarray | None, a: np.ndarray, b: np.ndarray | None) -> list:
    """Entries of documents; ids: (doc_id, rid), rows in runs of equal rid."""
    at = group_bounds(ids[:, 1])
    return [p, ids[at[:-1]].tobytes(), np.diff(at).astype(np.uint32).tobytes(), b"" if h is None else h.tobytes(), a.astype(np.uint32).tobytes(), b"" if b is None else b.astype(np.uint32).tobytes()]


def _send(count: int, part: np.ndarray, ids: np.ndarray, h, a, b) -> Iterator[pa.RecordBatch]:
    none = np.zeros(len(a), np.uint8)
    rows = [
        _blob(p, x, None if h is None else y, z, None if b is None else w)
        for p, (x, y, z, w) in by_partition(part.astype(np.int32), count, ids, none if h is None else h, a, none if b is None else b)
    ]
    for i in range(0, len(rows), 64):
        kinds = [pa.int32(), *[pa.binary()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows[i : i + 64]), kinds)], _NAMES)


def _read(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, hs, aa, bb = [], [], [], []
    for batch in batches:
        for _, d, c, h, a, b in zip(*[batch.column(x) for x in _NAMES]):
            ids.append(np.repeat(np.frombuffer(d.as_buffer(), np.int64).reshape(-1, 2), np.frombuffer(c.as_buffer(), np.uint32), axis=0))
            hs.append(np.frombuffer(h.as_buffer(), np.uint64))
            aa.append(np.frombuffer(a.as_buffer(), np.uint32))
            bb.append(np.frombuffer(b.as_buffer(), np.uint32))
    if not ids:
        return np.zeros((0, 2), np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    return tuple(np.concatenate(x) for x in (ids, hs, aa, bb))


def _of(h: np.ndarray, count: int) -> np.ndarray:
    return (h >> np.uint64(40)) % np.uint64(count)


def _ids(b: pa.RecordBatch) -> np.ndarray:
    return np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "rid")], axis=1)


def _keep_repeated(h: np.ndarray, *arrays: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Entries whose hash occurs more than once, in order of hash."""
    order = np.argsort(h)
    length = np.diff(group_bounds(h[order]))
    order = order[np.repeat(length > 1, length)]
    return h[order], [x[order] for x in arrays]


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start_word, n_words, later): stretches of words in windows of min_words that occur more
    than once in the table, whether in one text or in several.

    later tells whether the words are in a window that stood before, at a lesser (doc_id, position):
    cutting the stretches with later = true leaves each passage where it first stands. Words are runs
    without white space, compared as they are. Texts that are null or have fewer than min_words words
    have no windows; rows with a null doc_id are left out; repeated rows count once; different texts
    that share a doc_id are compared like others. An empty table gives no rows. Other columns are
    ignored. min_words is at least 50: see the module for why."""
    if min_words < MIN_WORDS:
        raise ValueError(f"min_words must be at least {MIN_WORDS}")
    spark = docs.sparkSession
    count = partitions(spark)
    docs = ensure_columns(docs, doc_id="bigint", text="string").where("doc_id is not null and text is not null").withColumn("rid", F.xxhash64("doc_id", "text"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in chunks(batches):
            key, d, start, span = shared_keys(Words(*text_bytes(b.column("text"))))
            order = np.argsort(d, kind="stable")
            held.append((_ids(b)[d[order]], key[order], start[order], span[order]))
            if sum(len(x[1]) for x in held) >= HELD:
                ids, key, start, span = (np.concatenate(x) for x in zip(*held))
                held = []
                yield from _send(count, _of(key, count), ids, key, start, span)
        if held:
            ids, key, start, span = (np.concatenate(x) for x in zip(*held))
            yield from _send(count, _of(key, count), ids, key, start, span)

    def reveal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, key, start, span = _read(batches)
        key, (ids, start, span) = _keep_repeated(key, ids, start, span)
        order = np.lexsort((start, ids[:, 1]))
        ids, start, span = ids[order], start[order], span[order]
        new = np.ones(len(start), bool)
        yield from _send(count, ids[new, 1].view(np.uint64) % np.uint64(count), ids[new], None, start[new], span[new])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, _, start, span = _read(batches)
        order = np.lexsort((start, ids[:, 1]))
        ids, start, span = ids[order], start[order], span[order]
        at = group_bounds(ids[:, 1])
        for i in range(0, len(at) - 1, 5000):
            cut = list(zip(at[i : i + 5000], at[i + 1 : i + 5001]))
            yield pa.RecordBatch.from_arrays([pa.array([ids[s, 1] for s, _ in cut], pa.int64()), pa.array([start[s:e].tobytes() for s, e in cut], pa.binary()), pa.array([span[s:e].tobytes() for s, e in cut], pa.binary())], ["rid", "starts", "spans"])

    named = exchange(docs.mapInArrow(name, _ROWS), count).mapInArrow(reveal, _ROWS)
    regions = written(exchange(named, count).mapInArrow(gather, "rid bigint, starts binary, spans binary"), "passage-regions")
    some = docs
    if regions.count() * 16 <= BROADCAST_BYTES:  # spares the other texts the exchange
        some = docs.join(F.broadcast(regions.select("rid")), "rid", "left_semi")
    some = some.join(regions, "rid").select("doc_id", "rid", "text", "starts", "spans")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in chunks(batches):
            words = Words(*text_bytes(b.column("text")))
            starts = [np.frombuffer(x.as_buffer(), np.uint32) for x in b.column("starts")]
            row = np.repeat(np.arange(b.num_rows), [len(x) for x in starts])
            start = np.concatenate(starts).astype(np.int64)
            span = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in b.column("spans")]).astype(np.int64)
            run, span = span >> 31 == 1, span & ((1 << 31) - 1)
            last = words.count[row] - min_words  # of the windows' places in the text
            low = np.clip(np.where(run, start - min_words + 1, start + span - min_words), 0, None)
            high = np.minimum(np.where(run, start + span - 1, start), last)
            ok = low <= high
            low, high, row = low[ok] + words.first[row[ok]], high[ok] + words.first[row[ok]], row[ok]
            mark = np.zeros(len(words) + 1, np.int32)
            np.add.at(mark, low, 1)
            np.add.at(mark, high + 1, -1)
            at = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
            doc = words.doc[at]
            held.append((_ids(b)[doc], stretch_hashes(words.hashes(), at, at + min_words), at - words.first[doc]))
            if sum(len(x[1]) for x in held) >= HELD:
                ids, h, pos = (np.concatenate(x) for x in zip(*held))
                held = []
                yield from _send(count, _of(h, count), ids, h, pos, None)
        if held:
            ids, h, pos = (np.concatenate(x) for x in zip(*held))
            yield from _send(count, _of(h, count), ids, h, pos, None)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, h, pos, _ = _read(batches)
        h, (ids, pos) = _keep_repeated(h, ids, pos)
        order = np.lexsort((ids[:, 1], pos, ids[:, 0], h))
        h, ids, pos = h[order], ids[order], pos[order]
        # a repeated row is there once
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (ids[1:, 1] != ids[:-1, 1]) | (pos[1:] != pos[:-1])
        h, ids, pos = h[new], ids[new], pos[new]
        length = np.diff(group_bounds(h))
        later = range_within(length) > 0
        many = np.repeat(length > 1, length)
        ids, pos, later = ids[many], pos[many], later[many]
        order = np.argsort(ids[:, 1], kind="stable")
        ids, pos, later = ids[order], pos[order], later[order]
        yield from _send(count, ids[:, 1].view(np.uint64) % np.uint64(count), ids, None, pos, later)

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, _, pos, later = _read(batches)
        order = np.lexsort((pos, ids[:, 1]))
        ids, pos, later = ids[order], pos[order].astype(np.int64), later[order]
        at = group_bounds(ids[:, 1])
        out: list[list[np.ndarray]] = [[], [], [], []]
        for s, e in zip(at[:-1], at[1:]):
            if s == e:
                continue
            low = pos[s]
            state = np.zeros(pos[e - 1] + min_words - low + 1, np.int8)
            for value, p in ((1, pos[s:e]), (2, pos[s:e][later[s:e] == 1])):
                edge = np.zeros(len(state), np.int32)
                np.add.at(edge, p - low, 1)
                np.add.at(edge, p - low + min_words, -1)
                state[np.cumsum(edge) > 0] = value
            cut = group_bounds(state)
            on = np.flatnonzero(state[cut[:-1]] > 0)
            out[0].append(np.full(len(on), ids[s, 0]))
            out[1].append(low + cut[on])
            out[2].append(cut[on + 1] - cut[on])
            out[3].append(state[cut[on]] == 2)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["doc_id", "start_word", "n_words", "later"])

    same = exchange(some.mapInArrow(windows, _ROWS), count).mapInArrow(compare, _ROWS)
    return exchange(same, count).mapInArrow(stretches, "doc_id bigint, start_word bigint, n_words bigint, later boolean")


def op9_substring_dedup(spark, sf_dir):
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = rf"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\r\f]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, w, unnest(range(0, len(w) - {MIN_WORDS} + 1)) AS pos FROM w WHERE len(w) >= {MIN_WORDS}),
g AS (SELECT doc_id, pos, array_to_string(w[pos + 1 : pos + {MIN_WORDS}], ' ') AS g FROM p),
r AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (PARTITION BY g ORDER BY doc_id, pos) AS k FROM g),
c AS (SELECT doc_id, word, bool_or(k > 1) AS later FROM (SELECT doc_id, k, unnest(range(pos, pos + {MIN_WORDS})) AS word FROM r WHERE n > 1) t GROUP BY doc_id, word),
i AS (SELECT doc_id, word, later, word - row_number() OVER (PARTITION BY doc_id, later ORDER BY word) AS island FROM c)
SELECT doc_id, min(word) AS start_word, count(*) AS n_words, later FROM i GROUP BY doc_id, later, island
"""
