"""Repeated windows by sampled positions.

A window is ``width`` units (bytes or words) of one document. Its anchor is the
leftmost of its ``gram``-unit strings with the smallest hash; equal windows have
equal anchors at equal places, so windows can be equal only if their anchors'
hashes are. An anchor carries the run of windows that chose it, its segment: the
units from the first window's start to the last one's end.

Equal segments are one class, named by the anchor's and the segment's hash (128
bits), and grouped with partial aggregation. What remains are anchors met with
several different segments; one representative of each is resolved on its own
content by the operator (see suffixes.py and automata.py). The windows of anchors
with more than ``CROWD`` segments are grouped by Spark, by 128 bits of hash, so
that no task's group grows with the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stages import save
from .arrays import Spans, Texts, mix, parts
from .blobs import opened, squeezed


#: The operator resolves an anchor of at most so many different segments in one task.
CROWD = 1000


@dataclass(frozen=True)
class Kind:
    width: int
    gram: int
    words: bool

    def units(self, t: Texts) -> tuple[Spans, np.ndarray]:
        """Span hashes over the units, and each row's first unit."""
        return (Spans(t.word_hashes), t.word_bounds) if self.words else (t.spans, t.offsets)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values."""
    n = len(x)
    if n < w:
        return x[:0]
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def sample(t: Texts, kind: Kind) -> dict[str, np.ndarray]:
    """Anchors of a part: row, pos (unit in the row), left, reach, gram hash, segment hash."""
    spans, bounds = kind.units(t)
    n, w = int(bounds[-1]), kind.width - kind.gram + 1
    if n < kind.width:
        return {k: np.zeros(0, np.int64) for k in ("row", "pos", "left", "reach", "gram", "seg")}
    at = np.arange(n - kind.gram + 1)
    gram = spans.of(at, at + kind.gram)
    low = np.uint64((1 << max(n.bit_length(), 1)) - 1)
    chosen = sliding_min((gram & ~low) | at.astype(np.uint64), w) & low
    row = np.repeat(np.arange(t.n), np.diff(bounds))
    first = np.arange(len(chosen))
    inside = first + kind.width <= bounds[row[: len(chosen)] + 1]
    first, chosen = first[inside], chosen[inside].astype(np.int64)
    own = row[first]
    start = np.ones(len(first), bool)
    start[1:] = (chosen[1:] != chosen[:-1]) | (own[1:] != own[:-1])
    begin = np.flatnonzero(start)
    last = np.append(begin[1:], len(first)) - 1
    a, z, pos, own = first[begin], first[last] + kind.width, chosen[begin], own[begin]
    return {
        "row": own,
        "pos": pos - bounds[own],
        "left": pos - a,
        "reach": z - pos,
        "gram": gram[pos].view(np.int64),
        "seg": mix(spans.of(a, z) ^ mix((pos - a).astype(np.uint64) + np.uint64(1))).view(np.int64),
    }


def anchors(docs: DataFrame, kind: Kind) -> DataFrame:
    """(doc_id, pos, extent, gram, seg); extent packs left and reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in parts(batch.column(1), 1 << 20):
                s = sample(t, kind)
                columns = [batch.column(0).take(pa.array(s["row"] + t.first)), pa.array(s["pos"])]
                columns += [pa.array(s["left"] << 32 | s["reach"]), pa.array(s["gram"]), pa.array(s["seg"])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "pos", "extent", "gram", "seg"])

    kind_ = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind_}, pos long, extent long, gram long, seg long")


def repeated(docs: DataFrame, kind: Kind, keep_first: bool, resolve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc_id, begin, end) of runs of units covered by repeated windows; runs may overlap.

    ``resolve`` takes representatives (doc_id, pos, extent, gram) of different
    segments and returns covered runs. With ``keep_first`` the first occurrence
    of a class, by (doc_id, pos), is no repeat of the others.
    """
    every = anchors(docs, kind)
    often = every.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram")
    held = save(every.join(often, "gram"))
    first = F.min(F.struct("doc_id", "pos", "extent")).alias("first")
    classes = save(held.groupBy("gram", "seg").agg(F.count("*").alias("n"), first))
    several = classes.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").withColumnRenamed("n", "segments")
    reps = save(classes.join(several, "gram").select("gram", "first.doc_id", "first.pos", "first.extent", "segments"))
    few, many = (reps.filter(f"segments {sign} {CROWD}").select("gram", "doc_id", "pos", "extent") for sign in ("<=", ">"))
    full = held.join(classes.filter("n > 1").select("gram", "seg", "first"), ["gram", "seg"])
    if keep_first:
        full = full.filter((F.col("doc_id") != F.col("first.doc_id")) | (F.col("pos") != F.col("first.pos")))
    left, reach = F.shiftright("extent", 32), F.col("extent").bitwiseAND(F.lit(0xFFFFFFFF))
    full = full.select("doc_id", (F.col("pos") - left).alias("begin"), (F.col("pos") + reach).alias("end"))
    full = full.union(resolve(few).select("doc_id", "begin", "end"))
    return full if many.isEmpty() else full.union(crowded(docs, kind, keep_first, many))


def crowded(docs: DataFrame, kind: Kind, keep_first: bool, reps: DataFrame) -> DataFrame:
    """(doc_id, begin, end) of the representatives' repeated windows, each window grouped on its own.

    All windows of a segment chose its anchor, and equal windows choose equal anchors, so these are all that can be equal.
    """
    names = ["doc_id", "begin", "key_a", "key_b"]

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(whole.num_rows):
                batch = whole.slice(at, 1)
                text = next(iter(opened(batch.column(1))))
                units = text.split() if kind.words else text
                pos, extent = (batch.column(2).values.field(i).to_numpy() for i in range(2))
                lo, hi = batch.column(2).offsets[0].as_py(), batch.column(2).offsets[1].as_py()
                begin: list[int] = []
                for p, e in zip(pos[lo:hi].tolist(), extent[lo:hi].tolist(), strict=True):
                    begin += range(p - (e >> 32), p + (e & 0xFFFFFFFF) - kind.width + 1)
                for cut in range(0, len(begin), 20_000):
                    some = begin[cut : cut + 20_000]
                    made = (units[b : b + kind.width] for b in some)
                    keys = b"".join(hashlib.blake2b(b" ".join(u) if kind.words else u, digest_size=16).digest() for u in made)
                    key = np.frombuffer(keys, np.int64).reshape(-1, 2)
                    doc = batch.column(0).take(pa.array(np.zeros(len(some), np.int64)))
                    columns = [doc, pa.array(some, pa.int64()), pa.array(key[:, 0].copy()), pa.array(key[:, 1].copy())]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    id_kind = docs.schema["doc_id"].dataType.simpleString()
    rows = with_texts(reps, docs).select("doc_id", "blob", "found")
    every = save(rows.mapInArrow(windows, f"doc_id {id_kind}, begin long, key_a long, key_b long"))
    first = F.min(F.struct("doc_id", "begin")).alias("first")
    again = every.groupBy("key_a", "key_b").agg(F.count("*").alias("n"), first).filter("n > 1")
    found = every.join(again, ["key_a", "key_b"])
    if keep_first:
        found = found.filter((F.col("doc_id") != F.col("first.doc_id")) | (F.col("begin") != F.col("first.begin")))
    return found.select("doc_id", "begin", (F.col("begin") + kind.width).alias("end"))


def with_texts(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, blob, found) for documents with representatives; found lists them."""
    found = reps.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "extent", "gram")).alias("found"))
    return squeezed(docs).join(found, "doc_id")


def removed(docs: DataFrame, runs: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """``finish(text bytes, merged runs)`` -> a row of ``schema``, for every document."""
    spans = runs.groupBy("doc_id").agg(F.collect_list(F.struct("begin", "end")).alias("runs"))
    joined = squeezed(docs).join(spans, "doc_id", "left").select("doc_id", "blob", "runs")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs_ = batch.column(2)
            rows = [finish(text, merged(runs_[i])) for i, text in enumerate(opened(batch.column(1)))]
            columns = [pa.array(c) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(names)
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, {schema}")


def merged(runs: pa.ListScalar) -> list[tuple[int, int]]:
    """Overlapping and touching runs as maximal ones."""
    if not runs.is_valid or not len(runs.values):
        return []
    begin, end = (runs.values.field(i).to_numpy() for i in (0, 1))
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1]
    last = np.append(np.flatnonzero(new)[1:], len(begin)) - 1
    return list(zip(begin[new].tolist(), end[last].tolist(), strict=True))
