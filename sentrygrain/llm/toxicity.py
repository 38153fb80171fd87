"""Toxicity by multiple-instance learning: a document is a bag of sentences.

A sentence is a logistic model of its distinct features: hashed words, their first
four and six bytes (inflections share them), and pairs of neighbours. A
document's score is the noisy-or of its sentences, 1 - product of (1 - p), so only labels of
documents are needed and the model itself finds which sentences they are due to;
``score`` also returns these. Training maximises the likelihood of the labels.

Sentences end at ``. ! ?`` and line ends; words are runs of letters and digits, A-Z and
Latin-1 capitals in lower case, other bytes outside ASCII as letters.

Training reads at most ``PER_CLASS`` labelled documents of each class, chosen by a hash of the
id, so one task fits it whatever the corpus. Every text is scored whole; null, empty and
wordless texts have no sentence and score 0, and so does every text if one of the classes is
missing. A document with several labels is toxic if one says so; of several texts
of one id the smallest is learned from, and each is scored. Extra columns never reach a
score. The model has a fixed size of ``DIMS`` numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import Spans, Texts, mix, parts

BITS = 18
DIMS = 1 << BITS
PER_CLASS = 2000
#: Weight of the toxic documents in training, all together.
SHARE = 0.25
LEAST = 3
STEPS = 200
RATE = 0.05
RIDGE = 1e-3
START = -4.0
_END = np.zeros(256, bool)
_END[list(b".!?\n")] = True
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


@dataclass
class Bags:
    """Sentences of some rows: feature numbers sorted by sentence, and where each sentence lies."""

    features: np.ndarray
    bounds: np.ndarray  # of features, per sentence
    rows: np.ndarray  # row of each sentence
    starts: np.ndarray  # bytes of the part
    ends: np.ndarray


def folded(t: Texts) -> np.ndarray:
    data = t.data + ((t.data >= 65) & (t.data <= 90)).astype(np.uint8) * np.uint8(32)
    if len(data) > 1:
        second = data[1:]
        capital = (data[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
        data[1:] = second + capital.astype(np.uint8) * np.uint8(32)
    return data


def bags(t: Texts) -> Bags:
    data = folded(t)
    word = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[t.offsets] = True
    begins, stops = word.copy(), word.copy()
    if len(data):
        begins[1:] &= ~word[:-1] | edge[1:-1]
        stops[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    row = np.searchsorted(t.offsets, starts, "right") - 1
    ended = np.concatenate([[0], np.cumsum(_END[data])])[starts] + row  # differs between sentences and between rows
    new = np.ones(len(starts), bool)
    new[1:] = (ended[1:] != ended[:-1]) | (row[1:] != row[:-1])
    sentence = np.cumsum(new) - 1
    spans = Spans(_BYTE[data])
    whole = spans.of(starts, ends)
    seen = [whole, *(spans.of(starts, np.minimum(starts + k, ends)) + np.uint64(k) for k in (4, 6))]
    together = np.flatnonzero(sentence[1:] == sentence[:-1]) if len(starts) else np.zeros(0, int)
    seen.append(mix(whole[together] + np.uint64(1)) + whole[together + 1])
    where = np.concatenate([sentence, sentence, sentence, sentence[together]]).astype(np.uint64)
    keys = where << np.uint64(BITS) | mix(np.concatenate(seen)) >> np.uint64(64 - BITS)
    keys.sort()
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    owner = (keys >> np.uint64(BITS)).astype(np.int64)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1 if len(first) else first
    bounds = np.searchsorted(owner, np.arange(len(first) + 1))
    return Bags((keys & np.uint64(DIMS - 1)).astype(np.int64), bounds, row[first], starts[first], ends[last])


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def chances(b: Bags, weights: np.ndarray) -> np.ndarray:
    """Probability of each sentence; every sentence has a feature."""
    if not len(b.rows):
        return np.zeros(0)
    return _logistic(np.add.reduceat(weights[b.features], b.bounds[:-1]) + weights[DIMS])


def noisy_or(p: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return -np.expm1(np.bincount(rows, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n))


def learn(texts: list[str], toxic: np.ndarray) -> np.ndarray:
    """Weights, the constant last, by Adam over the whole sample.

    A feature counts by the log ratio of its shares of toxic and other documents, so what few documents
    have cannot stand for their labels; what fewer than ``LEAST`` have is left out.
    """
    features, sizes, rows, n = [], [], [], len(texts)
    for t in parts(pa.array(texts, pa.large_string())):
        b = bags(t)
        features.append(b.features)
        sizes.append(np.diff(b.bounds))
        rows.append(b.rows + t.first)
    features, sizes, rows = np.concatenate(features), np.concatenate(sizes), np.concatenate(rows)
    pairs = np.unique(np.repeat(rows, sizes) * DIMS + features)
    counts = [np.bincount(pairs[toxic[pairs // DIMS] == k] % DIMS, minlength=DIMS) for k in (0, 1)]
    totals = [int((toxic == k).sum()) for k in (0, 1)]
    ratio = np.log((counts[1] + 1) / (totals[1] + 1)) - np.log((counts[0] + 1) / (totals[0] + 1))
    ratio[counts[0] + counts[1] < LEAST] = 0
    sentence = np.repeat(np.arange(len(rows)), sizes)
    used = ratio[features] != 0
    features, sentence = features[used], sentence[used]
    share = np.where(toxic == 1, SHARE / totals[1], (1 - SHARE) / totals[0])[rows]
    weights, mean, square = (np.zeros(DIMS + 1) for _ in range(3))
    weights[DIMS] = START
    for step in range(1, STEPS + 1):
        scaled = weights[:DIMS] * ratio
        z = np.bincount(sentence, scaled[features], minlength=len(rows)) + weights[DIMS]
        p = _logistic(z)
        whole = np.maximum(noisy_or(p, rows, n), 1e-9)[rows]
        # slope of the log-likelihood for each sentence's score
        slope = np.where(toxic[rows] == 1, p * (1 - whole) / whole, -p) * share
        slopes = np.append(np.bincount(features, slope[sentence], minlength=DIMS) * ratio, slope.sum())
        slopes[:DIMS] -= RIDGE * weights[:DIMS]
        mean = 0.9 * mean + 0.1 * slopes
        square = 0.999 * square + 0.001 * slopes**2
        weights += RATE * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    weights[:DIMS] *= ratio
    return weights.astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> np.ndarray | None:
    """Weights from the labelled ones of ``docs``, or None if a class is missing."""
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.join(docs.select("doc_id").filter("doc_id is not null").distinct(), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [known.filter(F.col("toxic") == k).orderBy(*order).limit(per_class) for k in (0, 1)]
    chosen = F.broadcast(chosen[0].union(chosen[1]))
    sample = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))]
        if len({toxic for _, toxic, _ in held}) == 2:
            held.sort()
            weights = learn([text for _, _, text in held], np.array([toxic for _, toxic, _ in held]))
            yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], names=["weights"])

    found = sample.repartition(1).mapInArrow(run, "weights binary").first()
    return np.frombuffer(bytes(found["weights"]), np.float32) if found else None


def score(docs: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """(doc_id, score, n_sentences, offending) of every row.

    ``offending`` are the sentences of probability 0.5 or more: start and end in code points, score.
    """
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, count = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            offending: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for t in parts(batch.column(1)) if weights is not None else ():
                b = bags(t)
                p = chances(b, weights)
                here = slice(t.first, t.first + t.n)
                total[here] = noisy_or(p, b.rows, t.n)
                count[here] = np.bincount(b.rows, minlength=t.n)
                found = np.flatnonzero(p >= 0.5)
                if len(found):
                    points = np.concatenate([[0], np.cumsum(t.data & 0xC0 != 0x80)])
                    for i in found.tolist():
                        zero = points[t.offsets[b.rows[i]]]
                        at = {"start": int(points[b.starts[i]] - zero), "end": int(points[b.ends[i]] - zero), "score": float(p[i])}
                        offending[t.first + int(b.rows[i])].append(at)
            columns = [batch.column(0), pa.array(np.clip(total, 0.0, 1.0)), pa.array(count), pa.array(offending, spans)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "n_sentences", "offending"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, score double, n_sentences long, offending array<struct<start: long, end: long, score: double>>"
    return docs.select("doc_id", "text").mapInArrow(run, shape)


def held_out() -> Column:
    """Whether a document's label is kept from training: crc32 of its id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = score(docs, fit(docs.filter(~held_out()), labels))
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0)
    return found.select("doc_id", held_out().alias("held_out"), "score", predicted.alias("predicted"), "n_sentences", "offending")
