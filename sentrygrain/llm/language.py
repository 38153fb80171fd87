"""Language ID by a blended-spectrum string kernel.

A text is the set of its byte n-grams (A-Z lower-cased), for each n of ``GRAMS``
hashed to ``DIMS`` places; presence, not frequency, counts. Two texts' kernel is
the mean over n of |shared| / sqrt(|a| |b|). Nystroem features from landmarks
turn one-versus-rest kernel ridge regression into one linear solve, and a batch
of texts is scored by two matrix products.

Training reads at most ``PER_LANGUAGE`` labelled texts a language, chosen by a
hash of the id; every text is scored whole. A text that is null or has no
letter is ``und`` with score 0, and so is every text if there is nothing to
learn from. The score is the winning regression value, moved from -1..1 to 0..1
and clipped. Other columns never reach a prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import Texts, lower_ascii, mix, parts

GRAMS = (2, 3, 4)
DIMS = 8192
PER_LANGUAGE = 300
LANDMARKS = 64
RIDGE = 1e-4
_ROWS = 128
_BUCKETS = 64
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # dims x landmarks
    weights: np.ndarray  # landmarks x languages

    def scores(self, features: np.ndarray) -> np.ndarray:
        return (features @ self.landmarks) @ self.weights


def features(t: Texts, first: int, last: int) -> np.ndarray:
    """Unit-length presence vectors of rows ``first`` to ``last``, blended over n."""
    begin, end = int(t.offsets[first]), int(t.offsets[last])
    data = t.data[begin:end].astype(np.uint64)
    bounds = t.offsets[first : last + 1] - begin
    n = last - first
    row = np.repeat(np.arange(n), np.diff(bounds))
    out = np.zeros((n, len(GRAMS), DIMS), np.float32)
    code = np.zeros(len(data), np.uint64)
    for g in range(1, max(GRAMS) + 1):
        code = (code[: len(data) - g + 1] << np.uint64(8)) | data[g - 1 :] if len(data) >= g else code[:0]
        if g in GRAMS and len(code):
            inside = np.arange(len(code)) + g <= bounds[row[: len(code)] + 1]
            place = code[inside] if g == 1 else mix(code[inside]) >> np.uint64(64 - DIMS.bit_length() + 1)
            out[row[: len(code)][inside], GRAMS.index(g), place.astype(np.int64)] = 1
    size = out.sum(axis=2, keepdims=True)
    out /= np.sqrt(np.maximum(size, 1) * len(GRAMS))
    return out.reshape(n, -1)


def lettered(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace")))


def _vectors(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, features) of slices of a column."""
    for t in parts(column, 1 << 20):
        low = lower_ascii(t)
        for at in range(0, t.n, _ROWS):
            yield t.first + at, features(low, at, min(at + _ROWS, t.n))


def sampled(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(doc_id, lang) of at most ``per_language`` rows of each language, by hash of the id."""
    rows = docs.filter("lang is not null").select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    for keys in (["lang", F.pmod("h", F.lit(_BUCKETS))], ["lang"]):
        rows = rows.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy("h", "doc_id"))).filter(f"at <= {per_language}")
    return rows.select("doc_id", "lang")


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> Model | None:
    """Learns from ``lang`` and ``text``. The driver gets per_language rows of features a language."""
    chosen = F.broadcast(sampled(docs, per_language))  # per_language rows of two fields for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _vectors(batch.column(1)):
                bits = [np.packbits(r > 0).tobytes() for r in x]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(x)), pa.array(bits, pa.binary())], names=["lang", "bits"])

    texts = docs.select("doc_id", "lang", "text").join(chosen, ["doc_id", "lang"], "left_semi")
    held = texts.filter("text is not null").select("lang", "text").mapInArrow(run, "lang string, bits binary").collect()
    held = sorted((r["lang"], bytes(r["bits"])) for r in held)
    if not held:
        return None
    languages = sorted({lang for lang, _ in held})
    x = np.unpackbits(np.frombuffer(b"".join(b for _, b in held), np.uint8).reshape(len(held), -1), axis=1).astype(np.float32)
    x = x.reshape(len(held), len(GRAMS), DIMS)
    x /= np.sqrt(np.maximum(x.sum(axis=2, keepdims=True), 1) * len(GRAMS))
    x = x.reshape(len(held), -1)
    y = np.array([[1.0 if lang == k else -1.0 for k in languages] for lang, _ in held])
    marks = []
    for k in languages:
        own = [i for i, (lang, _) in enumerate(held) if lang == k]
        marks += own[:: max(1, len(own) // landmarks)][:landmarks]
    z = x[marks]
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    phi = (x @ z.T).astype(np.float64) @ root
    ridge = phi.T @ phi + RIDGE * len(held) * np.eye(phi.shape[1])
    return Model(languages, np.ascontiguousarray(z.T), (root @ np.linalg.solve(ridge, phi.T @ y)).astype(np.float32))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            text = batch.column(1)
            for at, x in _vectors(text) if model else ():
                found = model.scores(x)
                for i, k in enumerate(found.argmax(axis=1)):
                    s = text[at + i]
                    if s.is_valid and lettered(s.as_buffer().to_pybytes()):
                        best[at + i] = model.languages[k]
                        score[at + i] = min(max((float(found[i, k]) + 1) / 2, 0.0), 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def held_out() -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    found = predict(docs, fit(docs.filter(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
