"""Substring dedup by suffix automata of reference shards.

Reference text is what anchors.py leaves: one representative of each different
segment around an anchor that occurs more than once. Segments are dealt by their
anchor's hash; each task cuts its part into shards of about ``SHARD`` words and
builds one suffix automaton of each. A shard's documents stream through it in
order of (doc_id, position): the matching statistics against what came earlier
give, for each word, the longest run ending there that occurred before, and
windows of ``WIDTH`` words or more go. An automaton of everything would grow
with the corpus, so a shard's automaton is shared by the task that streams the
shard and never sent whole to all tasks.

Words lie between ASCII white space and are compared unchanged; null text has
none. Ids must be unique: rows that repeat an id get each other's runs. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import anchors
from .anchors import Kind
from .blobs import opened

WIDTH, GRAM = 20, 5
SHARD = 20_000


class Automaton:
    """A suffix automaton of several word sequences, built word by word."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, link: int, edges: dict) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, q: int, word) -> int:
        """A copy of ``q`` for its strings that are no longer than ``p``'s and one word."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
            last = new

    def statistics(self, words: list) -> Iterator[int]:
        """For each word, the length of the longest run ending there that the automaton holds."""
        state = size = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.next[state]:
                state, size = self.next[state][word], size + 1
            yield size


def spans(words: list, automaton: Automaton, width: int) -> list[tuple[int, int]]:
    """Maximal runs of words covered by matches of ``width`` or more."""
    out: list[list[int]] = []
    for i, size in enumerate(automaton.statistics(words)):
        if size >= width:
            begin = i + 1 - size
            while out and out[-1][1] >= begin:
                begin = min(begin, out.pop()[0])
            out.append([begin, i + 1])
    return [(a, b) for a, b in out]


def resolve(docs: DataFrame, kind: Kind):
    def run(reps: DataFrame) -> DataFrame:
        tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        id_kind = docs.schema["doc_id"].dataType.simpleString()
        names = ["gram", "doc_id", "first", "words"]

        def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for doc, text, found in zip(batch.column(0).to_pylist(), opened(batch.column(1)), batch.column(2), strict=True):
                    words = text.split()
                    pos, extent, gram = (found.values.field(i).to_pylist() for i in range(3))
                    for p, e, g in zip(pos, extent, gram, strict=True):
                        first = p - (e >> 32)
                        rows.append((g, doc, first, b" ".join(words[first : p + (e & 0xFFFFFFFF)])))
                if rows:
                    g, doc, first, words_ = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(g, pa.int64()), pa.array(doc, pa.int64()), pa.array(first, pa.int64()), pa.array(words_, pa.binary())],
                        names=names,
                    )

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton, held, last = Automaton(), 0, None
            for batch in batches:
                out = []
                for g, doc, first, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    if g != last and held >= SHARD:
                        automaton, held = Automaton(), 0
                    last = g
                    words = text.split(b" ")
                    out += [(doc, first + a, first + b) for a, b in spans(words, automaton, kind.width)]
                    automaton.add(words)
                    held += len(words)
                if out:
                    columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "begin", "end"])

        rows = anchors.with_texts(reps, docs).select("doc_id", "blob", "found")
        rows = rows.mapInArrow(segments, f"gram long, doc_id {id_kind}, first long, words binary")
        dealt = rows.repartition(tasks, "gram").sortWithinPartitions("gram", "doc_id", "first")
        return dealt.mapInArrow(stream, f"doc_id {id_kind}, begin long, end long")

    return run


def _finish(text: bytes, runs: list[tuple[int, int]]) -> tuple:
    words, kept, at = text.split(), [], 0
    for begin, end in runs:
        kept += words[at:begin]
        at = end
    kept += words[at:]
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """One row per document: words, words that go, and a digest of what stays."""
    kind = Kind(width, gram, words=True)
    runs = anchors.repeated(docs, kind, True, resolve(docs, kind))
    return anchors.removed(docs, runs, _finish, "n_words long, n_removed long, kept_sha256 string")
