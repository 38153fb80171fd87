"""Strings made by doubling and swapping, whose sums modulo 2**64 are equal for every base, are told apart."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from sentrygrain.llm import automata, minhash, packing, pieces, quality
from sentrygrain.llm.arrays import Spans, parts

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def doubled(length):
    x, y = "a", "b"
    while len(x) < length:
        x, y = x + y, y + x
    return x, y


@pytest.fixture(scope="module", params=[1024, 2048])
def pair(request):
    return doubled(request.param)


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), SCHEMA)


def test_hashes_differ_and_equal_strings_have_equal_ones(pair):
    x, y = pair
    (t,) = parts(pa.array([f"{x} {y} {x}"]))
    first, second, third = t.word_hashes.tolist()
    assert first == third != second
    long = np.random.Generator(np.random.PCG64(1)).integers(0, 2**63, 5000, dtype=np.uint64)
    spans = Spans(np.concatenate([long, long]))
    starts = np.array([0, 17, 100])
    assert (spans.of(starts, starts + 3000) == spans.of(starts + 5000, starts + 8000)).all()


def test_near_copies(spark, pair):
    x, y = pair
    out = minhash.near(table(spark, [f"{x} one two", f"{y} one two", f"{x} one two"]), width=3, percent=85).collect()
    assert {r.doc_id: r.component_id for r in out} == {0: 0, 1: 1, 2: 0}


def test_repeated_lines_and_words(spark, pair):
    x, y = pair
    out = quality.quality(table(spark, [f"{x}\n{y}", f"{x}\n{x}\n{y}"])).collect()
    assert {r.doc_id: r.n_dup_lines for r in out} == {0: 0, 1: 1}


def test_token_ids(spark, pair):
    from tokenizers import Tokenizer

    import public_tokenizers

    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    texts = [f"{s} end" for s in (pair[0], pair[1], pair[0])]
    out = packing.pack(table(spark, texts)).collect()
    for i, text in enumerate(texts):
        ids = np.array([*encode(text, add_special_tokens=False).ids, 0], "<u4")
        for r in out:
            if r.doc_id == i:
                assert r.doc_tokens == len(ids)
                assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())


def test_windows_of_words(spark, pair):
    x, y = pair
    tail = " ".join(f"w{i}" for i in range(25))
    lone = " ".join(f"v{i}" for i in range(10))
    texts = [f"{lone} {x} {tail[:20]}", f"{lone} {y} {tail[:20]}", f"{x} {tail}", f"{y} {tail}"]
    out = {r.doc_id: r for r in automata.dedup(table(spark, texts)).collect()}
    words = [t.split(" ") for t in texts]
    seen, gone = set(), [set() for _ in texts]
    for i, ws in enumerate(words):
        for k in range(len(ws) - 19):
            window = tuple(ws[k : k + 20])
            if window in seen:
                gone[i] |= set(range(k, k + 20))
            seen.add(window)
    for i, ws in enumerate(words):
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone[i])
        assert (out[i].n_removed, out[i].kept_sha256) == (len(gone[i]), hashlib.sha256(kept.encode()).hexdigest())


def test_sampled_pieces_spell_their_own_text(spark, pair):
    out = pieces.sampled(table(spark, list(pair))).collect()
    assert out and all(r.decoded for r in out if "decoded" in r.__fields__)
