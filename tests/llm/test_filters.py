"""What keeps work and memory down must leave results as they are."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sentrygrain.llm import arrays, graph, minhash, pieces, quality


def sets_and_marks(texts, width=3):
    t = next(arrays.parts(pa.array(texts)))
    hashes, bounds = minhash.shingle_sets(t, width)
    bits = minhash.marks(hashes, bounds).reshape(-1, minhash.MARK)
    return [set(hashes[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], bits


def test_marks_rule_out_no_near_pair(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = []
    for changes in (0, 1, 2, 4, 5, 6, 8, 10, 20, 40, 200):
        for _ in range(4):
            own = list(base)
            for i in rng.sample(range(200), changes):
                own[i] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(own[: rng.choice((200, 190, 120))]))
    texts += ["", "one", "one two three", "one two three four"]
    sets, bits = sets_and_marks(texts)
    rows = [(i, (len(s), [int(x) for x in b])) for i, (s, b) in enumerate(zip(sets, bits, strict=True))]
    df = spark.createDataFrame(rows, "id long, mark struct<n: long, bits: array<long>>")
    both = df.withColumnsRenamed({"id": "a", "mark": "mark_a"}).crossJoin(df.withColumnsRenamed({"id": "b", "mark": "mark_b"}))
    kept = {(r.a, r.b) for r in both.filter(minhash.may_be_near("mark_a", "mark_b", 85)).select("a", "b").collect()}
    near = {
        (a, b)
        for a, x in enumerate(sets)
        for b, y in enumerate(sets)
        if x and y and 100 * len(x & y) >= 85 * len(x | y)
    }
    assert near <= kept
    far = {(a, b) for a, x in enumerate(sets) for b, y in enumerate(sets) if 100 * len(x & y) < 70 * len(x | y)}
    assert far and len(far & kept) < 0.02 * len(far)


def test_pairs_that_marks_rule_out_are_not_verified(spark):
    n, asked = 120, []
    buckets = spark.range(n).select((F.col("id") * 0).alias("bucket"), "id")
    marks = spark.range(n).select("id", F.expr("id div 2").alias("mark"))

    def verify(pairs):
        found = [(r.a, r.b) for r in pairs.collect()]
        asked.extend(found)
        return spark.createDataFrame([p for p in found if p[0] // 2 == p[1] // 2], "a long, b long")

    _, placed = graph.linked(buckets, verify, 2, marks, lambda a, b: F.col(a) == F.col(b))
    assert {r.id: r.component for r in placed.collect()} == {i: i // 2 * 2 for i in range(n)}
    assert len(asked) == len(set(asked)) <= 2 * n  # not n * (n - 1) / 2


def test_units_of_the_lattice_are_read_at_once():
    for raw in ([" a", "  b", " ▁c", " äö▁", " 漢字", " 😀x", " "], [b" a", b" \xff\xe4", b" \xe6\xbc", b" b"]):
        units = [u.encode() if isinstance(u, str) else u for u in raw]
        ends = np.cumsum([len(u) for u in units])
        starts = ends - [len(u) for u in units]
        text, lengths = pieces.lattice_texts(np.frombuffer(b"".join(units), np.uint8), starts, ends)
        want = [pieces.lattice_text(u) for u in units]
        assert text == "".join(want) and lengths.tolist() == [len(u) for u in want]


def test_vocabulary_finds_its_prefixes_by_their_top_bits():
    v = pieces.vocabulary(pieces.default_model())
    top = np.uint64(64 - pieces._TOP)
    assert (v.hashes[v.near[v.hashes[:-1] >> top]] <= v.hashes[:-1]).all()
    place, ids, size, _ = v.edges("▁the▁theory", np.array([4] * 4 + [11] * 7))
    found = {(p, i, s) for p, i, s in zip(place.tolist(), ids.tolist(), size.tolist(), strict=True)}
    text = "▁the▁theory"
    for p in range(11):
        for q in range(p + 1, 5 if p < 4 else 12):
            if text[p:q] in v.weights and q <= (4 if p < 4 else 11):
                assert (p, v.weights[text[p:q]][0], q - p) in found


def test_measuring_many_texts_holds_one_part_at_a_time(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(3000)]
    text = [" ".join(rng.choices(words, k=1000)) for _ in range(700)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "doc_id long, text string")
    runs = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: runs.append(run) or df.selectExpr("doc_id", *(f"0L as {m}" for m in quality.MEASURES)))
    monkeypatch.setattr(arrays, "_POWERS", {})
    monkeypatch.setattr(arrays, "_PRIME_POWERS", {})
    quality.with_ledger(df)
    batch = pa.RecordBatch.from_arrays([pa.array(range(700)), pa.array(text)], names=["doc_id", "text"])
    tracemalloc.start()
    out = list(runs[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert batch.nbytes > 4 << 20 and out[0].num_rows == 700
    assert peak < 130 << 20  # the measurements alone take 82 MiB, with parts of 2 MiB 196
