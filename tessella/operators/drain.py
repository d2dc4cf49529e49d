"""Mining of message templates.

Messages meet by (number of tokens, first token); within such a group they are taken in order of line,
each joining the first cluster most like it, if like enough, else founding one. Equal messages are
counted before they travel, so a group sees each distinct text once, at its first line, and all its
repeats go to the cluster of the first. Taken one by one a repeat could go to an older cluster that
has grown general enough since; otherwise the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import materialised

THRESHOLD, SAMPLES = 0.4, 3
FEW = 256  # words of all templates that are compared one by one; more are compared as arrays
INDEXED = 16384  # clusters from which on only those that share a rare word with the message are compared
_SCHEMA = "template string, count bigint, samples array<string>"
_ANY, _END = -1, -2


class Clusters:
    """The clusters of messages with one number of tokens and one first token."""

    def __init__(self, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.tokens: list[list[str | None]] = []
        self.counts: list[int] = []
        self.samples: list[list[str]] = []
        self._ids: dict[str, int] | None = None  # numbers of words, once there is a table
        self._table = np.empty((0, 0), np.int32)  # a row a position, a column a cluster
        self._places: dict[tuple[int, int], list[int]] | None = None  # clusters by position and word

    def _put(self, cluster: int) -> None:
        """The cluster's template into the table."""
        words = self.tokens[cluster]
        wide, room = self._table.shape
        if cluster >= room or len(words) > wide:
            grown = np.full((max(wide, len(words)), max(2 * room, cluster + 64)), _END, np.int32)
            grown[:wide, :room] = self._table
            self._table = grown
        ids = [_ANY if t is None else self._ids.setdefault(t, len(self._ids)) for t in words]
        if self._places is not None:
            old = self._table[: len(ids), cluster].tolist()
            for p, (x, y) in enumerate(zip(ids, old)):
                if x != y:  # what stood there before stays listed; candidates are compared anyway
                    self._places.setdefault((p, x), []).append(cluster)
        self._table[: len(ids), cluster] = ids
        self._table[len(ids) :, cluster] = _END

    def _candidates(self, ids: list[int]) -> np.ndarray | None:
        """Clusters that may be like enough; None for all. Who shares k of n words shares one of any n - k + 1."""
        n = len(ids)
        k = max(1, int(self.threshold * n))
        while k / n < self.threshold:
            k += 1
        while k > 1 and (k - 1) / n >= self.threshold:
            k -= 1
        none: list[int] = []
        found = sorted(([self._places.get((p, x), none), self._places.get((p, _ANY), none)] for p, x in enumerate(ids)), key=lambda x: len(x[0]) + len(x[1]))[: max(0, n - k + 1)]
        lists = [x for pair in found for x in pair if x]
        if sum(map(len, lists)) * 4 > len(self.tokens):
            return None
        return np.array(sorted(set(chain.from_iterable(lists))), np.int64)

    def _nearest(self, words: list[str]) -> tuple[int, int]:
        """The first of the clusters that share most places with the words, and how many; any where it is too few."""
        n = len(self.tokens)
        if self._ids is None and n * len(words) <= FEW:
            best, most = -1, 0
            for i, template in enumerate(self.tokens):
                same = sum(t is None or t == w for t, w in zip(template, words))
                if same > most:
                    best, most = i, same
            return best, most
        if self._ids is None:
            self._ids = {}
            for i in range(n):
                self._put(i)
        if self._places is None and n >= INDEXED:
            self._places = {}
            for i, template in enumerate(self.tokens):
                for p, t in enumerate(template):
                    self._places.setdefault((p, _ANY if t is None else self._ids[t]), []).append(i)
        ids = [self._ids.get(w, len(self._ids)) for w in words]
        some = None if self._places is None else self._candidates(ids)
        if some is not None and not len(some):
            return -1, 0
        table = self._table[: len(ids), :n] if some is None else self._table[: len(ids), some]
        column = np.array(ids[: len(table)], np.int32)[:, None]
        same = ((table == column) | (table == _ANY)).view(np.uint8).sum(0, dtype=np.uint8 if len(table) < 256 else np.int32)
        best = int(same.argmax())
        return (best if some is None else int(some[best])), int(same[best])

    def add(self, message: str, times: int = 1) -> int:
        """Count a message; the number of its cluster."""
        words = message.split()
        best, same = self._nearest(words)
        if best < 0 or not same or same / len(words) < self.threshold:
            self.tokens.append(list(words))
            self.counts.append(times)
            self.samples.append([message] * min(times, SAMPLES))
            best = len(self.tokens) - 1
            if self._ids is not None:
                self._put(best)
            return best
        old = self.tokens[best]
        self.tokens[best] = [t if t == w else None for t, w in zip(old, words)]
        if self._ids is not None and self.tokens[best] != old:
            self._put(best)
        self.counts[best] += times
        room = SAMPLES - len(self.samples[best])
        self.samples[best] += [message] * min(times, room)
        return best

    def rows(self) -> list[tuple[str, int, list[str]]]:
        return [(" ".join("<*>" if t is None else t for t in ts), n, s) for ts, n, s in zip(self.tokens, self.counts, self.samples)]


def mine(messages: Iterable[str], threshold: float = THRESHOLD) -> list[tuple[str, int, list[str]]]:
    """The same on one machine, message by message: what the distributed form is tested against."""
    groups: dict[tuple[int, str], Clusters] = {}
    for m in messages:
        words = m.split()
        if words:
            groups.setdefault((len(words), words[0]), Clusters(threshold)).add(m)
    return sorted((r for g in groups.values() for r in g.rows()), key=lambda r: (-r[1], r[0]))


def _clustered(batches: Iterable[pa.RecordBatch], threshold: float = THRESHOLD, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The clusters of messages that come group by group, in order; one group is held at a time."""
    schema = pa.schema([("template", pa.string()), ("count", pa.int64()), ("samples", pa.list_(pa.string()))])
    key, found, out = None, None, []
    for b in batches:
        for length, head, message, n in zip(*(b.column(c).to_pylist() for c in ("length", "head", "message", "n"))):
            if (length, head) != key:
                out += found.rows() if found else []
                key, found = (length, head), Clusters(threshold)
                while len(out) >= rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[:rows]), schema.types)], schema=schema)
                    out = out[rows:]
            if message.split():
                found.add(message, n)
    out += found.rows() if found else []
    for i in range(0, len(out), rows):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + rows]), schema.types)], schema=schema)


def mine_patterns(entries: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(template, count, samples) of the messages of log entries, most frequent first. Groups are many and most of
    them small, so a task takes its groups in one stream; the result is written, as sorting reads it twice."""
    words = F.split(F.regexp_replace(F.col("message"), r"^\s+|\s+$", ""), r"\s+")
    distinct = (
        entries.where(F.col("message").rlike(r"\S"))
        .groupBy("message").agg(F.count("*").alias("n"), F.min(F.struct("file", "line_no")).alias("at"))
        .withColumns({"length": F.size(words), "head": words[0], "file": F.coalesce("at.file", F.lit("")), "line_no": F.col("at.line_no")})
    )
    placed = distinct.repartition("length", "head").sortWithinPartitions("length", "head", "file", "line_no", "message").select("length", "head", "message", "n")
    return materialised(placed.mapInArrow(lambda batches: _clustered(batches, threshold), _SCHEMA), "templates").orderBy(F.desc("count"), "template")
