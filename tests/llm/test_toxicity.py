"""Noisy-or over sentences: slopes, held-out accuracy, and where the fault lies."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from sentrygrain.llm import toxicity
from sentrygrain.llm.arrays import parts

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("toxic", T.IntegerType()),  # clashes with the labels' column, and always says 1
        T.StructField("score", T.StringType()),
    ]
)
BAD = ("grumzel", "Fürklot", "snarvik")


def corpus(n=600):
    rng = random.Random(4)
    vocabulary = [f"{a}{b}{c}" for a in ("ta", "mo", "re", "li") for b in ("na", "so", "ver") for c in ("n", "da", "k", "é")]
    rows, labels, faults = [], [], {}
    for i in range(n):
        sentences = [" ".join(rng.choices(vocabulary, k=rng.randrange(4, 12))) for _ in range(rng.randrange(1, 8))]
        toxic = i % 3 == 0
        if toxic:
            at = rng.randrange(len(sentences))
            bad = rng.choice(BAD) + rng.choice(("", "s", "en"))
            sentences[at] += " " + bad
            faults[i] = sentences[at]
        rows.append((i, rng.choice((". ", "! ", "\n")).join(sentences) + "."))
        labels.append((i, int(toxic)))
    return rows, labels, faults


@pytest.fixture(scope="module")
def found(spark):
    rows, labels, faults = corpus()
    extra = [(900, None), (901, ""), (902, " . ! \n"), (903, "tanan. " * 300_000), (904, "tanan. " * 300_000 + "grumzel talk"), (0, rows[0][1]), (None, "snarvik grumzel.")]
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows + extra], SCHEMA).repartition(3)
    table = spark.createDataFrame(labels + [(0, 0), (0, 1), (None, 1), (5, None), (99999, 1)], "doc_id long, toxic int")
    return toxicity.toxicity(docs, table).collect(), rows, dict(labels), faults, docs


def test_held_out_documents_are_told_apart(found):
    out, rows, labels, faults, _ = found
    held = [r for r in out if r.doc_id is not None and r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 80 and all(r.held_out for r in held)
    assert sum(r.predicted == labels[r.doc_id] for r in held) / len(held) >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert len(out) == len(rows) + 7


def test_offending_sentences_are_the_faulty_ones(found):
    out, rows, labels, faults, _ = found
    texts = dict(rows)
    seen = right = 0
    for r in out:
        if r.doc_id in faults and r.held_out:
            spans = [texts[r.doc_id][o.start : o.end] for o in r.offending]
            seen += 1
            right += spans == [faults[r.doc_id]]
    assert seen > 20 and right / seen >= 0.9


def test_odd_texts_have_defined_scores(found):
    out = {r.doc_id: r for r in found[0]}
    for i in (900, 901, 902):
        assert (out[i].score, out[i].predicted, out[i].n_sentences, out[i].offending) == (0.0, 0, 0, [])
    assert out[903].n_sentences == 300_000 and out[904].n_sentences == 300_001
    assert out[904].predicted == 1 and any(o.end == len("tanan. " * 300_000 + "grumzel talk") for o in out[904].offending)
    assert out[None].predicted == 1 and out[None].held_out is False
    assert len([r for r in found[0] if r.doc_id == 0]) == 2


def test_one_class_or_nothing_to_learn_from(spark, found):
    docs = found[4]
    for labels in ([], [(1, 0), (2, 0)], [(1, 1)]):
        table = spark.createDataFrame(labels, "doc_id long, toxic int")
        assert toxicity.fit(docs, table) is None
    assert {(r.score, r.predicted) for r in toxicity.toxicity(docs.limit(5), table).collect()} == {(0.0, 0)}
    none = spark.createDataFrame([], SCHEMA)
    assert toxicity.toxicity(none, table).collect() == []


def test_noisy_or_and_features():
    p = np.array([0.2, 0.5, 0.9])
    assert toxicity.noisy_or(p, np.array([0, 0, 2]), 3) == pytest.approx([1 - 0.8 * 0.5, 0.0, 0.9])
    (t,) = parts(pa.array(["Über ÜBER. a", "a", None, "ein  wort"]))
    b = toxicity.bags(t)
    assert b.rows.tolist() == [0, 0, 1, 3]
    assert [bytes(t.data[s:e]).decode() for s, e in zip(b.starts, b.ends)] == ["Über ÜBER", "a", "a", "ein  wort"]
    first, second, third = (set(b.features[b.bounds[i] : b.bounds[i + 1]]) for i in range(3))
    assert second == third and len(first) <= 4  # one word, in two cases, with its beginnings, and one pair
