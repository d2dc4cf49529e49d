"""Main content of web pages by a recurrent block labeller.

A page is its sequence of leaves: text nodes with the path of tags above them. A bidirectional LSTM
in numpy reads, for each leaf, the sum of learned vectors of the tags on its path, the mean of
learned vectors of its hashed words, and a few sizes; so each leaf is labelled content or not with
the whole page in view. All pages of a chunk run through the recurrence together.

It is trained here, on the driver, on a bounded sample: pages of the table in which an article or
main element says what the content is, and generated pages of other layouts. In half of the training
pages the telling tags are hidden, so that position, sizes and words must do.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, ensure_columns, range_within, text_bytes

SAMPLE_PAGES = 240  # pages of the table that training reads: the bound of the sample
SYNTHETIC_PAGES = 240
WORD_BUCKETS, TAG_BUCKETS = 4096, 1024
WORD_DIM, TAG_DIM, SIZES, HIDDEN = 8, 8, 5, 16
INPUT = WORD_DIM + 2 * TAG_DIM + SIZES
CHUNK = 2 << 20

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg)\b.*?(?:</\1\s*>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>|[^<]+|<",
    re.S | re.I,
)
_CLASS = re.compile(r"""(?:class|id|role)\s*=\s*["']?([^"'\s>]+)""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body div dl dt dd fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr td th ul".split())
_INLINE = frozenset("a abbr b bdi bdo cite code em font i kbd mark q s samp small span strong sub sup time u var".split())
_TELLING = frozenset("article main nav footer header aside".split())


def leaves(html: str) -> tuple[list[str], list[tuple[str, ...]], list[bool]]:
    """(texts, tag paths, does a new block begin) of the text nodes with ink outside head. Text of
    script, style and the like is no leaf. Tags that are never closed end with what holds them."""
    texts, paths, breaks = [], [], []
    stack: list[str] = []
    names: list[str] = []
    fresh, path, skip = True, (), 0
    for m in _TOKEN.finditer(html):
        s = m.group(0)
        if s[0] != "<" or s == "<":
            if not skip and not s.isspace():
                t = " ".join(unescape(s).split())
                if t:
                    texts.append(t)
                    paths.append(path)
                    breaks.append(fresh)
                    fresh = False
            continue
        tag = m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in _INLINE:
            fresh = True
        if m.group(2):
            if tag in names:
                while names.pop() != tag:
                    stack.pop()
                stack.pop()
                path = tuple(stack)
        elif tag not in _VOID and not m.group(4).endswith("/"):
            if tag in _BLOCK and "p" in names:
                while names.pop() != "p":
                    stack.pop()
                stack.pop()
            elif tag in ("li", "tr", "td", "th", "dt", "dd") and names and names[-1] == tag:
                names.pop()
                stack.pop()
            c = _CLASS.search(m.group(4)) if m.group(4) else None
            names.append(tag)
            stack.append(f"{tag}.{c.group(1).lower()}" if c else tag)
            path = tuple(stack)
        skip = "head" in names and "body" not in names
    return texts, paths, breaks


def _hash(s: str) -> int:
    h = 2166136261
    for c in s.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return h ^ h >> 15


def _hide(path: tuple[str, ...]) -> tuple[str, ...]:
    return tuple("div" if x.split(".")[0] in _TELLING or "." in x else x for x in path)


class Batch:
    """The leaves of some pages as arrays."""

    def __init__(self, pages: list[tuple[list[str], list[tuple[str, ...]]]], paths_seen: dict | None = None):
        seen = {} if paths_seen is None else paths_seen
        self.count = np.array([len(t) for t, _ in pages], np.int64)
        flat = [t for texts, _ in pages for t in texts]
        n = len(flat)
        words = Words(*text_bytes(pa.array(flat, pa.string())))
        self.word = (words.hashes() % np.uint64(WORD_BUCKETS)).astype(np.int32)
        self.words = words.count
        at, tags, tag_count, tail = np.empty(n, np.int64), [], [], []
        i, own = 0, {}
        for _, paths in pages:
            for p in paths:
                k = own.get(p)
                if k is None:
                    k = own[p] = len(own)
                    if p not in seen:
                        seen[p] = [_hash(x) % TAG_BUCKETS for x in p] or [0]
                    tags += seen[p]
                    tag_count.append(len(seen[p]))
                    tail.append(_hash("last " + (p[-1] if p else "")) % TAG_BUCKETS)
                at[i] = k
                i += 1
        self.path, self.tags, self.tag_count, self.tail = at, np.array(tags, np.int64), np.array(tag_count, np.int64), np.array(tail, np.int64)
        self.depth = self.tag_count
        size = np.diff(words.offs)
        ends = np.zeros(n)
        has = words.count > 0
        if n and len(words):
            ends[has] = np.isin(words.buf[words.end[words.first[1:][has] - 1] - 1], [46, 33, 63])
        place = range_within(self.count) / np.maximum(np.repeat(self.count, self.count) - 1, 1)
        self.size = np.stack([np.log1p(words.count) / 4, np.log1p(size) / 6, ends, place, (self.depth[at] if n else np.zeros(0)) / 8], axis=1).astype(np.float32) if n else np.zeros((0, SIZES), np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    def __init__(self, rng: np.random.Generator | None = None):
        rng = rng or np.random.default_rng(11)
        r = lambda *s, k=1.0: (rng.standard_normal(s) * k).astype(np.float32)
        self.p = {"word": r(WORD_BUCKETS, WORD_DIM, k=0.1), "tag": r(TAG_BUCKETS, TAG_DIM, k=0.3), "last": r(TAG_BUCKETS, TAG_DIM, k=0.3), "out": r(2 * HIDDEN + INPUT, k=0.1), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": r(INPUT + HIDDEN, 4 * HIDDEN, k=0.15), f"c{d}": np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)}

    def inputs(self, b: Batch) -> np.ndarray:
        n = len(b.words)
        x = np.zeros((n, INPUT), np.float32)
        has = b.words > 0
        if has.any():
            s = np.add.reduceat(self.p["word"][b.word], (np.cumsum(b.words) - b.words)[has], axis=0)
            x[has, :WORD_DIM] = s / b.words[has, None]
        if n:
            t = np.add.reduceat(self.p["tag"][b.tags], np.cumsum(b.tag_count) - b.tag_count, axis=0)
            x[:, WORD_DIM : WORD_DIM + TAG_DIM] = t[b.path]
            x[:, WORD_DIM + TAG_DIM : WORD_DIM + 2 * TAG_DIM] = self.p["last"][b.tail][b.path]
            x[:, -SIZES:] = b.size
        return x

    def _run(self, x: np.ndarray, count: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states of one direction for pages laid end to end; longest pages first inside."""
        order = np.argsort(-count, kind="stable")
        first = (np.cumsum(count) - count)[order]
        size = count[order]
        w, c0 = self.p[f"w{d}"], self.p[f"c{d}"]
        projected = x @ w[:INPUT] + c0
        out = np.zeros((len(x), HIDDEN), np.float32)
        h = c = np.zeros((len(size), HIDDEN), np.float32)
        for t in range(int(size.max()) if len(size) else 0):
            live = int(np.searchsorted(-size, -t, "left"))
            i = first[:live] + (t if d == "f" else size[:live] - 1 - t)
            h0, c0_ = h[:live], c[:live]
            z = projected[i] + h0 @ w[INPUT:]
            g = _sigmoid(z[:, : 3 * HIDDEN])
            a = np.tanh(z[:, 3 * HIDDEN :])
            c = g[:, HIDDEN : 2 * HIDDEN] * c0_ + g[:, :HIDDEN] * a
            tc = np.tanh(c)
            h = g[:, 2 * HIDDEN :] * tc
            out[i] = h
            if keep is not None:
                keep.append((i, h0, c0_, g, a, tc))
        return out

    def logits(self, x: np.ndarray, count: np.ndarray, keep: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        saved = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
        hidden = np.concatenate([self._run(x, count, "f", saved["f"]), self._run(x, count, "b", saved["b"]), x], axis=1)
        if keep is not None:
            keep |= saved
        return hidden @ self.p["out"] + self.p["bias"], hidden

    def probabilities(self, b: Batch) -> np.ndarray:
        return _sigmoid(self.logits(self.inputs(b), b.count)[0])

    def gradients(self, b: Batch, y: np.ndarray) -> dict[str, np.ndarray]:
        x = self.inputs(b)
        saved: dict = {}
        z, hidden = self.logits(x, b.count, saved)
        dz = ((_sigmoid(z) - y) / max(1, len(y))).astype(np.float32)
        g = {"out": hidden.T @ dz, "bias": np.array([dz.sum()])}
        dhid = dz[:, None] * self.p["out"]
        dx = dhid[:, 2 * HIDDEN :].copy()
        for k, d in enumerate("fb"):
            w = self.p[f"w{d}"]
            gw, gb = np.zeros_like(w), np.zeros(4 * HIDDEN, np.float32)
            dh = dc = np.zeros((0, HIDDEN), np.float32)
            for i, h0, c0, gate, a, tc in reversed(saved[d]):
                live = len(i)
                grow = np.zeros((live, HIDDEN), np.float32)
                grow[: len(dh)] = dh
                dh = grow + dhid[i, k * HIDDEN : (k + 1) * HIDDEN]
                grow = np.zeros((live, HIDDEN), np.float32)
                grow[: len(dc)] = dc
                ig, fg, og = gate[:, :HIDDEN], gate[:, HIDDEN : 2 * HIDDEN], gate[:, 2 * HIDDEN :]
                dc = grow + dh * og * (1 - tc**2)
                d4 = np.concatenate([dc * a * ig * (1 - ig), dc * c0 * fg * (1 - fg), dh * tc * og * (1 - og), dc * ig * (1 - a**2)], axis=1)
                gw += np.concatenate([x[i], h0], axis=1).T @ d4
                gb += d4.sum(0)
                back = d4 @ w.T
                dx[i] += back[:, :INPUT]
                dh, dc = back[:, INPUT:], dc * fg
            g[f"w{d}"], g[f"c{d}"] = gw, gb
        g["word"], g["tag"], g["last"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["tag"]), np.zeros_like(self.p["last"])
        per = dx[:, :WORD_DIM] / np.maximum(b.words, 1)[:, None]
        np.add.at(g["word"], b.word, np.repeat(per, b.words, axis=0))
        n = b.tag_count[b.path]
        start = (np.cumsum(b.tag_count) - b.tag_count)[b.path]
        np.add.at(g["tag"], b.tags[np.repeat(start, n) + range_within(n)], np.repeat(dx[:, WORD_DIM : WORD_DIM + TAG_DIM], n, axis=0))
        np.add.at(g["last"], b.tail[b.path], dx[:, WORD_DIM + TAG_DIM : WORD_DIM + 2 * TAG_DIM])
        return g


def synthetic_pages(rng: np.random.Generator, n: int) -> list[tuple[str, list[int]]]:
    """Pages of many layouts with the label of each leaf: running text is content; menus, teasers,
    notices and comments forms aren't."""
    vocab = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzéüñ"), rng.integers(2, 10))) for _ in range(1500)]
    say = lambda k: " ".join(vocab[int(i)] for i in rng.integers(0, len(vocab), k))
    out = []
    for _ in range(n):
        html, y = ["<html><head><title>x</title></head><body>"], []

        def block(wrap: str, items: list[tuple[str, str]], label: int) -> None:
            html.append(f"<{wrap}>" + "".join(f"<{t}>{s}</{t.split()[0]}>" for t, s in items) + f"</{wrap.split()[0]}>")
            y.extend([label] * len(items))

        menu = str(rng.choice(["nav", "div class=menu", "ul", "div", "header"]))
        block(menu, [(str(rng.choice(["a href=x", "li", "span"])), say(int(rng.integers(1, 4)))) for _ in range(int(rng.integers(2, 9)))], 0)
        if rng.random() < 0.5:
            block(str(rng.choice(["div class=ad", "aside", "div"])), [("p", say(int(rng.integers(2, 10))))], 0)
        body = str(rng.choice(["article", "main", "div class=content", "div", "section"]))
        items = [("h1", say(int(rng.integers(2, 12))))]
        for _ in range(int(rng.integers(1, 8))):
            items.append((str(rng.choice(["p", "p", "p", "div", "blockquote", "li", "h2"])), say(int(rng.integers(6, 120))) + str(rng.choice([".", ".", "!", ""]))))
        block(body, items, 1)
        if rng.random() < 0.5:
            block(str(rng.choice(["aside", "div class=related", "ul", "div"])), [("a href=y", say(int(rng.integers(2, 8)))) for _ in range(int(rng.integers(2, 7)))], 0)
        block(str(rng.choice(["footer", "div id=footer", "div"])), [("p", "&copy; " + say(int(rng.integers(1, 18)))) for _ in range(int(rng.integers(1, 4)))], 0)
        html.append("</body></html>")
        out.append(("".join(html), y))
    return out


def weak_labels(paths: list[tuple[str, ...]]) -> list[int]:
    return [int(any(x.split(".")[0] in ("article", "main") for x in p) and not any(x.split(".")[0] in ("nav", "footer", "aside") for x in p)) for p in paths]


def train(pages: list[str], seed: int = 11, rounds: int = 8, width: int = 24) -> Labeller:
    rng = np.random.default_rng(seed)
    cases = []
    for html in pages:
        texts, paths, _ = leaves(html)
        y = weak_labels(paths)
        if 0 < sum(y) < len(y):
            cases.append((texts, paths, y))
    for html, y in synthetic_pages(rng, SYNTHETIC_PAGES):
        texts, paths, _ = leaves(html)
        cases.append((texts, paths, y))
    model = Labeller(rng)
    first, second = ({k: np.zeros(v.shape) for k, v in model.p.items()} for _ in range(2))
    step = 0
    for r in range(rounds):
        order = rng.permutation(len(cases))
        for i in range(0, len(order), width):
            some = [cases[j] for j in order[i : i + width]]
            hidden = rng.random(len(some)) < 0.5
            b = Batch([(t, [_hide(p) for p in ps] if h else ps) for (t, ps, _), h in zip(some, hidden)])
            g = model.gradients(b, np.concatenate([np.array(y, np.float32) for _, _, y in some]))
            step += 1
            for k, v in g.items():
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                model.p[k] = (model.p[k] - 0.012 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Labeller:
    """Train on the sample_pages rows whose page_id hashes lowest, besides generated pages."""
    pages = ensure_columns(pages, page_id="bigint", html="string").where("html is not null and page_id is not null")
    ids = [r[0] for r in pages.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample_pages).collect()]
    rows = pages.where(F.col("page_id").isin(ids)).orderBy("page_id", F.xxhash64("html")).limit(sample_pages).collect() if ids else []
    return train([r["html"] for r in rows])


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """(page_id, text, n_blocks, n_content, labels): each page's content, leaf by leaf.

    labels holds a boolean for each leaf in order; text joins the content leaves, by a line feed where
    a block begins and by a space within one. A null page has null text and labels and 0 blocks; an
    empty page, or one without text, has an empty text. Markup that is broken or never closed is read
    as far as it goes. Null ids and repeated rows are labelled like others. An empty table gives no
    rows. Other columns are ignored."""
    model = model or fit(pages)
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for b in chunks(batches, "html", CHUNK):
            parsed = [leaves(h) if h is not None else ([], [], []) for h in b.column("html").to_pylist()]
            batch = Batch([(t, p) for t, p, _ in parsed], seen)
            if len(seen) > 100_000:
                seen.clear()
            yes = shared.value.probabilities(batch) >= 0.5
            texts, labels, kept, at = [], [], [], 0
            for (t, _, new), valid in zip(parsed, b.column("html").is_valid().to_pylist()):
                y = yes[at : at + len(t)].tolist()
                at += len(t)
                parts, fresh = [], True
                for s, f, keep in zip(t, new, y):
                    fresh |= f
                    if keep:
                        parts.append(("\n" if fresh else " ") + s)
                        fresh = False
                texts.append("".join(parts)[1:] if valid else None)
                labels.append(y if valid else None)
                kept.append(sum(y))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(texts, pa.string()), pa.array(batch.count), pa.array(kept, pa.int64()), pa.array(labels, pa.list_(pa.bool_()))], ["page_id", "text", "n_blocks", "n_content", "labels"])

    return ensure_columns(pages, page_id="bigint", html="string").mapInArrow(run, "page_id bigint, text string, n_blocks bigint, n_content bigint, labels array<boolean>")


def op2_html_extraction(spark, sf_dir):
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
