"""Language of each word in code-switched text, by a linear-chain conditional random field.

Words are labelled with a language of the training rows, or `und` (no language we know). A word's
score comes from hashed affixes and byte n-grams, the word itself, and membership in the languages'
lexicons; learned transitions tie neighbours together; forward-backward gives each word's posterior.

Features are computed once for each distinct word of a chunk. The chain runs over all texts of a
chunk at once: the words are cut to equal stretches, the stretches' transfer matrices are multiplied
out side by side, which gives what enters each stretch from either end, and then all stretches run
forward and backward together. This is exact: a text's first word merely restarts the chain. As
transfer matrices take the cube of the number of labels, with many labels the texts themselves run
side by side instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import CHUNK_BYTES, Words, chunks, ensure_columns, group_bounds, mix, range_within, text_bytes

SAMPLE_DOCS = 150  # labelled rows a language that training reads: the bound of the sample
SAMPLE_ROWS = 64 * SAMPLE_DOCS  # bound of the whole sample; beyond 64 languages each has fewer rows, 1 at least
LEXICON = 300  # most frequent words of each language's sample
BUCKETS = 1 << 15
UND = "und"
MAX_UNKNOWN = 0.5  # a text with more than this share of `und` words is rejected
STRETCH = 256
MANY_LABELS = 64  # beyond these, texts are the lanes
FEW_LABELS = 16  # beyond these, less text is taken at once
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _folded(buf: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and Latin-1 letters, of the same length."""
    out = _LOWER[buf]
    if len(buf) > 1:
        latin = np.zeros(len(buf), bool)
        latin[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        out[latin] += 32
    return out


def word_features(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, where each word's begin, hash of each word): the features of each word."""
    length = end - start
    n = len(length)
    padded = length + 2
    begin = np.cumsum(padded) - padded
    flat = np.empty(int(padded.sum()), np.uint64)
    flat[begin], flat[begin + length + 1] = 1, 2
    inside = np.repeat(begin + 1, length) + range_within(length)
    flat[inside] = buf[np.repeat(start, length) + range_within(length)].astype(np.uint64) + np.uint64(3)
    owner = np.repeat(np.arange(n), padded)
    stop = begin + padded
    code, key, rows = flat.copy(), [], []
    salt = np.uint64(0x9E3779B1)
    grams = {1: flat}
    for k in (2, 3, 4):
        code = code[: len(flat) - k + 1] * np.uint64(1000003) + flat[k - 1 :]
        grams[k] = code
        fits = np.arange(len(code)) + k <= stop[owner[: len(code)]]
        if k < 4:
            key.append(mix(code[fits] + salt * np.uint64(k)))
            rows.append(owner[: len(code)][fits])
        has = np.flatnonzero(padded >= k + 1)
        for tag, at in ((10, begin[has]), (20, stop[has] - k)):
            key.append(mix(code[at] + salt * np.uint64(tag + k)))
            rows.append(has)
    powers = np.cumprod(np.full(int(padded.max()) if n else 1, 6364136223846793005, np.uint64))
    whole = mix(np.add.reduceat(flat * powers[range_within(padded)], begin)) if n else np.zeros(0, np.uint64)
    key.append(mix(whole + salt))
    rows.append(np.arange(n))
    key, rows = np.concatenate(key), np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    counts = np.bincount(rows, minlength=n)
    return (key[order] % np.uint64(BUCKETS)).astype(np.int32), np.cumsum(counts) - counts, whole


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # BUCKETS + one row a lexicon, by label
    transitions: np.ndarray
    first: np.ndarray
    lexicon: np.ndarray  # word hashes, sorted
    members: np.ndarray  # for each of them, which lexicons

    def scores(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Each word's score by label; 0 for words without letters, which tell nothing."""
        out = np.zeros((len(start), len(self.labels)), np.float32)
        if not len(start):
            return out
        size = np.concatenate([[0], np.cumsum(_LETTER[buf])])
        letters = size[end] > size[start]
        at_once = max(50_000 * FEW_LABELS // max(FEW_LABELS, len(self.labels)), 1)
        for i in range(0, len(start), at_once):
            s = slice(i, i + at_once)
            feature, at, whole = word_features(buf, start[s], end[s])
            out[s] = np.add.reduceat(self.weights[feature], at, axis=0)
            if len(self.lexicon):
                k = np.minimum(np.searchsorted(self.lexicon, whole), len(self.lexicon) - 1)
                known = self.lexicon[k] == whole
                out[s][known] += self.members[k[known]].astype(np.float32) @ self.weights[BUCKETS:]
        out[~letters] = 0
        return out

    def posteriors(self, score: np.ndarray, code: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """P(label of each word | its text); code: row of `score` for each word; starts: first words."""
        n, k = len(code), len(self.labels)
        if not n:
            return np.zeros((0, k), np.float32)
        if k > MANY_LABELS:
            return self._by_texts(score, code, starts)
        steps = min(STRETCH, max(1, int(np.sqrt(n))))
        lanes = -(-n // steps)
        e = np.ones((lanes * steps, k), np.float32)
        e[:n] = np.exp(score - score.max(1, keepdims=True))[code]
        begins = np.zeros(lanes * steps, bool)
        begins[starts[starts < n]] = True
        begins[n:] = True
        e, begins = e.reshape(lanes, steps, k), begins.reshape(lanes, steps)
        a, pi = np.exp(self.transitions).astype(np.float32), np.exp(self.first).astype(np.float32)
        a, pi = a / a.sum(), pi / pi.sum()
        m = np.broadcast_to(np.eye(k, dtype=np.float32), (lanes, k, k)).copy()
        for s in range(steps):
            new = (m.reshape(-1, k) @ a).reshape(lanes, k, k)
            b = np.flatnonzero(begins[:, s])
            if len(b):
                new[b] = m[b].sum(2, keepdims=True) * pi
            new *= e[:, s, None, :]
            m = new / new.sum((1, 2), keepdims=True)
        enter, leave = np.empty((lanes, k), np.float32), np.empty((lanes, k), np.float32)
        v, w = np.full(k, 1 / k, np.float32), np.full(k, 1 / k, np.float32)
        for i in range(lanes):
            enter[i] = v
            v = v @ m[i]
            v /= v.sum()
        for i in range(lanes - 1, -1, -1):
            leave[i] = w
            w = m[i] @ w
            w /= w.sum()
        out = np.empty((lanes, steps, k), np.float32)
        v = enter
        for s in range(steps):
            v = v @ a
            v[begins[:, s]] = pi
            v = v * e[:, s]
            v /= v.sum(1, keepdims=True)
            out[:, s] = v
        w = leave
        for s in range(steps - 1, -1, -1):
            out[:, s] *= w
            x = w * e[:, s]
            w = x @ a.T
            b = begins[:, s]
            if b.any():
                w[b] = (x[b] @ pi)[:, None]
            w /= w.sum(1, keepdims=True)
        out /= out.sum(2, keepdims=True)
        return out.reshape(-1, k)[:n]

    def _by_texts(self, score: np.ndarray, code: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """posteriors() with a lane for each text, the longest first."""
        k, first = len(self.labels), np.unique(np.concatenate([[0], starts[starts < len(code)]]))
        length = np.diff(np.concatenate([first, [len(code)]]))
        order = np.argsort(-length, kind="stable")
        first, length = first[order], length[order]
        lanes = np.searchsorted(-length, -np.arange(length[0]), "left")  # texts with more than so many words
        e = np.exp(score - score.max(1, keepdims=True))
        a, pi = np.exp(self.transitions).astype(np.float32), np.exp(self.first).astype(np.float32)
        a, pi = a / a.sum(), pi / pi.sum()
        out = np.empty((len(code), k), np.float32)
        v = np.broadcast_to(pi, (len(first), k))
        for s, n in enumerate(lanes):
            at = first[:n] + s
            v = (v[:n] @ a if s else v) * e[code[at]]
            v /= v.sum(1, keepdims=True)
            out[at] = v
        w = np.full((len(first), k), 1 / k, np.float32)
        back = np.ascontiguousarray(a.T)
        for s in range(len(lanes) - 1, -1, -1):
            n = lanes[s]
            at = first[:n] + s
            out[at] *= w[:n]
            x = (w[:n] * e[code[at]]) @ back
            w[:n] = x / x.sum(1, keepdims=True)
        out /= out.sum(1, keepdims=True)
        return out


def _noise(rng: np.random.Generator, n: int) -> list[bytes]:
    """Words of no language: hexadecimal and letter salad, symbols, other scripts."""
    pools = ["0123456789abcdef", "bcdfghjklmnpqrstvwxzQXZWKJ", "abcdefghijklmnopqrstuvwxyz0123456789_-+/=", "#$%&*@^~<>{}[]\\|xz", "абвгдежзиклмнопрстуф", "αβγδεζηθικλμνξοπρστ", "的一是不了人我在有他这中大来", "ابتثجحخدذرزسشص"]
    return ["".join(rng.choice(list(pools[rng.integers(len(pools))]), rng.integers(2, 16))).encode() for _ in range(n)]


def _train(texts: dict[str, list[str]], seed: int = 7, batches: int = 240, lanes: int = 64, length: int = 32, rate: float = 0.25) -> Model:
    """Fit on texts by language. Sequences are spliced from them, so that switches are seen; each 64
    languages take as many batches more, so that each language is seen as often."""
    rng = np.random.default_rng(seed)
    labels = [*sorted(texts), UND]
    k = len(labels)
    batches *= max(1, -(-(k - 1) // 64))
    streams = []
    for lang in labels[:-1]:
        streams.append([w for t in texts[lang] for w in t.encode().split()] or [b"-"])
    streams.append(_noise(rng, 6000))
    vocabulary: dict[bytes, int] = {}
    ids = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in s]) for s in streams]
    words = list(vocabulary)
    length_of = np.array([len(w) for w in words])
    buf = _folded(np.frombuffer(b"".join(words), np.uint8))
    end = np.cumsum(length_of)
    feature, at, whole = word_features(buf, end - length_of, end)
    per = np.diff(np.concatenate([at, [len(feature)]]))
    tops = []
    for i in range(k - 1):
        count = np.bincount(ids[i], minlength=len(words))
        top = np.argsort(-count, kind="stable")[:LEXICON]
        tops.append(np.unique(whole[top[count[top] > 1]]))
    lexicon = np.unique(np.concatenate(tops)) if tops else np.zeros(0, np.uint64)
    members = np.zeros((len(lexicon), k - 1), bool)
    for i, t in enumerate(tops):
        members[np.isin(lexicon, t), i] = True
    model = Model(labels, np.zeros((BUCKETS + k - 1, k), np.float32), np.eye(k) * 2.0, np.zeros(k), lexicon, members)
    seen = np.full_like(model.weights, 1e-2)
    trans_seen = np.full((k, k), 1e-2)
    size = np.concatenate([[0], np.cumsum(_LETTER[buf])])
    letters = size[end] > size[end - length_of]
    where = np.minimum(np.searchsorted(lexicon, whole), max(len(lexicon) - 1, 0))
    known = (lexicon[where] == whole) if len(lexicon) else np.zeros(len(whole), bool)
    for _ in range(batches):
        x, y = np.empty((lanes, length), np.int64), np.empty((lanes, length), np.int64)
        for b in range(lanes):
            t = 0
            while t < length:
                lang = int(rng.integers(k - 1)) if rng.random() > 0.12 else k - 1
                n = min(length - t, 1 + int(rng.geometric(1 / 16)))
                s = ids[lang]
                o = int(rng.integers(max(1, len(s) - n)))
                part = s[o : o + n]
                x[b, t : t + len(part)], y[b, t : t + len(part)] = part, lang
                t += len(part)
        flat = x.ravel()
        used, code = np.unique(flat, return_inverse=True)
        n = per[used]
        f = feature[np.repeat(at[used], n) + range_within(n)]
        score = np.add.reduceat(model.weights[f], np.cumsum(n) - n, axis=0)
        mem = np.where(known[used][:, None], members[where[used]] if len(lexicon) else 0, 0).astype(np.float32)
        score += mem @ model.weights[BUCKETS:]
        score[~letters[used]] = 0
        starts = np.arange(0, lanes * length, length)
        gold = np.eye(k)[y.ravel()]
        # gradients: what is seen less what is expected, for words and for transitions
        e = np.exp(score - score.max(1, keepdims=True))[code].reshape(lanes, length, k).astype(np.float64)
        a, pi = np.exp(model.transitions), np.exp(model.first)
        alpha, beta = np.empty_like(e), np.ones_like(e)
        v = pi * e[:, 0]
        alpha[:, 0] = v / v.sum(1, keepdims=True)
        for s in range(1, length):
            v = (alpha[:, s - 1] @ a) * e[:, s]
            alpha[:, s] = v / v.sum(1, keepdims=True)
        for s in range(length - 2, -1, -1):
            v = (beta[:, s + 1] * e[:, s + 1]) @ a.T
            beta[:, s] = v / v.sum(1, keepdims=True)
        post = alpha * beta
        post /= post.sum(2, keepdims=True)
        after = (beta * e)[:, 1:].reshape(-1, k)
        before = alpha[:, :-1].reshape(-1, k)
        pair = a * ((before / ((before @ a) * after).sum(1, keepdims=True)).T @ after)
        real = np.zeros((k, k))
        np.add.at(real, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        step = (real - pair) / lanes
        trans_seen += step**2
        model.transitions += rate * step / np.sqrt(trans_seen)
        by_word = np.zeros((len(used), k))
        np.add.at(by_word, code, gold - post.reshape(-1, k))
        by_word[~letters[used]] = 0
        by_word = (by_word / lanes).astype(np.float32)
        rows, inverse = np.unique(f, return_inverse=True)
        grad = np.zeros((len(rows), k), np.float32)
        np.add.at(grad, inverse, np.repeat(by_word, n, axis=0))
        seen[rows] += grad**2
        model.weights[rows] += rate * 0.3 * grad / np.sqrt(seen[rows])
        grad = mem.T @ by_word
        seen[BUCKETS:] += grad**2
        model.weights[BUCKETS:] += rate * grad / np.sqrt(seen[BUCKETS:])
    return model


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, seed: int = 7, max_languages: int | None = None, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Train on every value of column lang (with max_languages, on the most frequent ones): on at most
    sample_docs rows of each, and fewer where all together would pass sample_rows, but never none:
    those whose doc_id hashes lowest. None where no row has a label and a text."""
    docs = ensure_columns(docs, doc_id="bigint", text="string", lang="string").where("lang is not null and doc_id is not null and text is not null")
    if max_languages is None:
        count = docs.select("lang").distinct().count()
    else:
        langs = [r["lang"] for r in docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()]
        docs, count = docs.where(F.col("lang").isin(langs)) if langs else docs, len(langs)
    sample_docs = max(1, min(sample_docs, sample_rows // max(count, 1)))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = docs.select("doc_id", "lang").withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample_docs)
    chosen = sorted({r[0] for r in ids.select("doc_id").collect()})
    if not chosen:
        return None
    # an id may have many rows: each language's own are counted, so that none is crowded out
    own = Window.partitionBy("lang").orderBy("doc_id", "h")
    found = docs.where(F.col("doc_id").isin(chosen)).withColumn("h", F.xxhash64("text")).withColumn("place", F.row_number().over(own))
    texts: dict[str, list[str]] = {}
    for r in found.where(F.col("place") <= sample_docs).orderBy("doc_id", "h").collect():
        texts.setdefault(r["lang"], []).append(r["text"])
    return _train(texts, seed)


def _at_once(model: Model | None) -> int:
    """Bytes of text to take at once: what is held for them grows with the labels."""
    return CHUNK_BYTES * FEW_LABELS // max(FEW_LABELS, len(model.labels) if model else 0)


def label_words(model: Model, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(posteriors of each word, has the word letters)."""
    buf = _folded(words.buf)
    code, _ = pd.factorize(words.hashes())
    n = int(code.max()) + 1 if len(code) else 0
    at = np.zeros(n, np.int64)
    at[code[::-1]] = np.arange(len(code))[::-1]
    score = model.scores(buf, words.start[at], words.end[at])
    size = np.concatenate([[0], np.cumsum(_LETTER[buf])])
    return model.posteriors(score, code, words.first[:-1][words.count > 0]), size[words.end] > size[words.start]


def judge(model: Model | None, words: Words, max_unknown: float = MAX_UNKNOWN) -> dict[str, np.ndarray]:
    """For each text: language, share, keep, and its words' labels."""
    rows = len(words.count)
    size = np.concatenate([[0], np.cumsum(_LETTER[words.buf])])
    letters = size[words.end] > size[words.start]
    n_letters = np.bincount(words.doc[letters], minlength=rows)
    if model is None:
        return {"language": np.full(rows, None, object), "share": np.zeros(rows), "keep": n_letters > 0, "label": np.zeros(len(words), np.int64)}
    post, letters = label_words(model, words)
    k = len(model.labels)
    total = np.stack([np.bincount(words.doc[letters], weights=post[letters, i], minlength=rows) for i in range(k)], axis=1)
    best = total.argmax(1)
    share = total / np.maximum(n_letters, 1)[:, None]
    language = np.array([*model.labels, None], object)[np.where(n_letters > 0, best, k)]
    return {"language": language, "share": share[np.arange(rows), best], "keep": (n_letters > 0) & (share[:, -1] <= max_unknown), "label": post.argmax(1)}


_SEGMENTS = "array<struct<language:string,start_word:bigint,n_words:bigint>>"


def identify(docs: DataFrame, model: Model | None = None, max_unknown: float = MAX_UNKNOWN) -> DataFrame:
    """(doc_id, language, share, n_words, keep, segments) for every row.

    language has the largest expected share of the words with letters, share is that share; segments
    are the maximal runs of words with one label and hold every word. A text without a letter
    (null, empty, digits only) has no language and keep = false, as has one with more than
    max_unknown of its words in no known language (language may then be `und`). Without a labelled row
    to train on, language is null and texts with letters are kept. Null ids and repeated rows are
    labelled like others. An empty table gives no rows. Other columns are ignored."""
    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, most=_at_once(shared.value)):
            words = Words(*text_bytes(b.column("text")))
            got = judge(shared.value, words, max_unknown)
            label = got["label"]
            new = np.ones(len(words), bool)
            if len(words):
                new[1:] = (label[1:] != label[:-1]) | (words.doc[1:] != words.doc[:-1])
            at = np.flatnonzero(new)
            n = np.diff(np.concatenate([at, [len(words)]]))
            doc = words.doc[at]
            offsets = np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32)
            names = [*shared.value.labels] if shared.value else [None]
            kind = pa.struct([("language", pa.string()), ("start_word", pa.int64()), ("n_words", pa.int64())])
            dictionary = pa.DictionaryArray.from_arrays(pa.array(label[at], pa.int32()), pa.array(names, pa.string())).cast(pa.string())
            structs = pa.StructArray.from_arrays([dictionary, pa.array(at - words.first[doc]), pa.array(n)], fields=list(kind))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(list(got["language"]), pa.string()), pa.array(np.round(got["share"].astype(np.float64), 4)), pa.array(words.count), pa.array(got["keep"]), pa.ListArray.from_arrays(pa.array(offsets), structs)],
                ["doc_id", "language", "share", "n_words", "keep", "segments"],
            )

    return ensure_columns(docs, doc_id="bigint", text="string").mapInArrow(run, f"doc_id bigint, language string, share double, n_words bigint, keep boolean, segments {_SEGMENTS}")


def keep_known(docs: DataFrame, model: Model | None = None, max_unknown: float = MAX_UNKNOWN) -> DataFrame:
    """The rows of `docs` that identify() keeps; columns as before."""
    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    if "text" not in docs.columns:
        return docs.limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, most=_at_once(shared.value)):
            yield b.filter(pa.array(judge(shared.value, Words(*text_bytes(b.column("text"))), max_unknown)["keep"]))

    return docs.mapInArrow(run, docs.schema)


def op3_language_id(spark, sf_dir):
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
