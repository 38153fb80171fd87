"""MinHash near-dedup: one-permutation hashing, optimal densification, bands, star candidates.

A document's set is its distinct word shingles (words between ASCII white
space, A-Z lower-cased; a shorter text is one shingle, no words are no set).
Each shingle is hashed once; the hash's top part names the bin, and a bin keeps
its smallest hash. Empty bins borrow from bins drawn by a hash of (bin,
attempt), the same for every document. Bands of bins are buckets.

Equal sets are one item from the start. Star-shaped candidate pairs of distinct
sets are confirmed on the full sets, computed from the whole texts. After the first
star of a bucket, only those are that their sizes and marks allow: a shingle flips one bit
of its set's mark, so two marks differ in at most as many bits as the sets in shingles. Documents
without words are linked with nothing. Ids must be unique; of rows that repeat
an id with one text, each is returned. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stages import save
from .arrays import Spans, Texts, lower_ascii, mix, parts
from .blobs import opened, squeezed
from .graph import linked

BANDS, ROWS = 32, 6
BINS = BANDS * ROWS
_EMPTY = np.uint64(2**64 - 1)
_ATTEMPTS = 64
#: 64-bit words of a set's mark.
MARK = 16
#: Bytes of text whose signatures are held at once: a short text's takes many times its size.
PART = 1 << 18


def shingle_sets(t: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): each row's distinct shingle hashes, sorted within the row."""
    t = lower_ascii(t)
    spans, bounds = Spans(t.word_hashes), t.word_bounds
    words = np.diff(bounds)
    take = np.minimum(words, width)
    n = np.where(words > 0, words - take + 1, 0)
    row = np.repeat(np.arange(t.n), n)
    first = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + bounds[row]
    hashes = spans.of(first, first + take[row])
    order = np.lexsort((hashes, row))
    hashes = hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=t.n))])


def signatures(hashes: np.ndarray, bounds: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One row of ``bins`` values for each set; rows of empty sets have no meaning."""
    n = len(bounds) - 1
    out = np.full((n, bins), _EMPTY)
    row = np.repeat(np.arange(n), np.diff(bounds))
    at = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64) + row * bins
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1]
    out.reshape(-1)[at[first]] = hashes[first]
    full = out != _EMPTY
    some = full.any(axis=1)
    source = np.where(full, np.arange(bins), -1)
    r, c = np.nonzero(~full & some[:, None])
    for attempt in range(_ATTEMPTS):
        if not len(r):
            break
        draw = mix(c.astype(np.uint64) * np.uint64(_ATTEMPTS) + np.uint64(attempt) + np.uint64(1 << 40))
        j = (draw >> np.uint64(32)).astype(np.int64) * bins >> 32
        hit = full[r, j]
        source[r[hit], c[hit]] = j[hit]
        r, c = r[~hit], c[~hit]
    step = 0
    while len(r):  # very small sets: the next filled bin
        step += 1
        j = (c + step) % bins
        hit = full[r, j]
        source[r[hit], c[hit]] = j[hit]
        r, c = r[~hit], c[~hit]
    return np.where(some[:, None], np.take_along_axis(out, np.maximum(source, 0), axis=1), _EMPTY)


def band_hashes(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    n, bins = signature.shape
    value = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)).copy()
    for k in range(bins // bands):
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) ^ signature[:, k :: bins // bands])
    return value.view(np.int64)


def marks(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """``MARK`` words for each set: the parity of its shingles on each bit."""
    out = np.zeros((len(bounds) - 1) * MARK, np.uint64)
    bit = mix(hashes ^ np.uint64(9)) % np.uint64(64 * MARK)
    word = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) * MARK + (bit >> np.uint64(6)).astype(np.int64)
    np.bitwise_xor.at(out, word, np.uint64(1) << (bit & np.uint64(63)))
    return out.view(np.int64)


def may_be_near(a: str, b: str, percent: int) -> Column:
    """False only for sets whose sizes or marks (columns ``a`` and ``b``: n, bits) rule the similarity out."""
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = sum((F.bit_count(F.col(f"{a}.bits")[i].bitwiseXOR(F.col(f"{b}.bits")[i])) for i in range(1, MARK)),
                 F.bit_count(F.col(f"{a}.bits")[0].bitwiseXOR(F.col(f"{b}.bits")[0])))
    sizes = 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)
    return sizes & ((100 + percent) * differ <= (100 - percent) * (n_a + n_b))


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands, bits): set_a and set_b together name the set."""
    names = ["doc_id", "n_shingles", "set_a", "set_b", "bands", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in parts(batch.column(1), PART):
                hashes, bounds = shingle_sets(t, width)
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(k)))]) for k in (3, 5 << 32)]
                sums = [(s[bounds[1:]] - s[bounds[:-1]]).view(np.int64) for s in sums]
                bands = band_hashes(signatures(hashes, bounds)).reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(t.first, t.n),
                        pa.array(np.diff(bounds)),
                        *(pa.array(s) for s in sums),
                        pa.ListArray.from_arrays(pa.array(np.arange(t.n + 1, dtype=np.int32) * BANDS), pa.array(bands)),
                        pa.ListArray.from_arrays(pa.array(np.arange(t.n + 1, dtype=np.int32) * MARK), pa.array(marks(hashes, bounds))),
                    ],
                    names=names,
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_shingles long, set_a long, set_b long, bands array<long>, bits array<long>"
    )


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * |intersection| >= percent * |union| of their full sets."""
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("blob").alias("blob_a")), "a")
    both = both.join(texts.select(F.col("doc_id").alias("b"), F.col("blob").alias("blob_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                where: dict = {}
                for ids, blobs in ((a, 2), (b, 3)):
                    for i, x in enumerate(ids):
                        where.setdefault(x, (blobs, i))
                sets = {}
                texts_ = pa.array((next(opened([batch.column(c)[i]])) for c, i in where.values()), pa.large_binary())
                order = list(where)
                for t in parts(texts_.cast(pa.large_string())):
                    hashes, bounds = shingle_sets(t, width)
                    for i in range(t.n):
                        sets[order[t.first + i]] = hashes[bounds[i] : bounds[i + 1]]
                keep = []
                for x, y in zip(a, b, strict=True):
                    s, r = sets[x], sets[y]
                    small, large = min(len(s), len(r)), max(len(s), len(r))
                    if not small or 100 * small < percent * large:
                        keep.append(False)
                        continue
                    same = len(np.intersect1d(s, r, assume_unique=True))
                    keep.append(100 * same >= percent * (len(s) + len(r) - same))
                yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return both.select("a", "b", "blob_a", "blob_b").mapInArrow(run, f"a {kind}, b {kind}")


def near(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: n_shingles, component_id (smallest id reachable) and kept."""
    found = save(sketches(docs, width))
    full = found.filter("n_shingles > 0")
    sets = full.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("item"))
    member = save(full.select("doc_id", "set_a", "set_b", "n_shingles").join(sets, ["set_a", "set_b", "n_shingles"]))
    items = full.join(member.filter("doc_id = item").select("doc_id"), "doc_id", "left_semi")
    buckets = items.select(F.explode("bands").alias("bucket"), F.col("doc_id").alias("id")).distinct()
    texts: list[DataFrame] = []

    def verify(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b"))).distinct()
        if texts:
            ids = ids.join(texts[0].select("doc_id"), "doc_id", "left_anti")
            if not ids.isEmpty():
                texts[0] = save(texts[0].union(squeezed(docs).join(ids.hint("merge"), "doc_id", "left_semi")))
        else:
            texts.append(save(squeezed(docs).join(ids.hint("merge"), "doc_id", "left_semi")))
        return confirmed(pairs, texts[0], width, percent)

    # written without the bands: the turns read it again
    held = save(items.select(F.col("doc_id").alias("id"), F.struct(F.col("n_shingles").alias("n"), "bits").alias("mark")).distinct())
    _, parts_ = linked(buckets, verify, marks=held, may=lambda a, b: may_be_near(a, b, percent))
    placed = member.join(parts_.withColumnRenamed("id", "item"), "item", "left")
    placed = placed.select("doc_id", "n_shingles", F.coalesce("component", "item").alias("component_id"))
    alone = found.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.union(alone).withColumn("kept", F.col("doc_id") == F.col("component_id"))
