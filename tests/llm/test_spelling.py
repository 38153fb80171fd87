"""Spelling variants against all pairs, word by word."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import types as T

from sentrygrain.llm import spelling

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("word", T.StringType()),
        T.StructField("n", T.StringType()),
    ]
)


def one_edit(a, b):
    """Whether one insertion, deletion or replacement of a letter leads from a to b."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            own = "" if doc_id is None else str(doc_id)
            h = zlib.crc32(f"{own}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    form, near = {}, {}
    for w in n:
        others = [v for v in n if v != w and one_edit(w, v)]
        near[w] = len(others)
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n[w], near[w], n.get(form[w])) for w in n)


def got(spark, rows):
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA).repartition(3)
    out = spelling.variants(docs)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in out.collect())


def corpus():
    rng = random.Random(3)
    letters = "abé"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 9))) for _ in range(60)]
    base += ["international", "internationel", "internationele", "nternational", "Öffnungen", "öffnungen", "aaaaaa", "aaaaaaa", "aaaaaaaa", "a×b÷cd"]
    weights = [rng.choice((5, 6, 30, 160, 900)) for _ in base]
    words = rng.choices(base, weights, k=9000)
    words = [w.upper() if rng.random() < 0.05 and w.isascii() else w for w in words]
    rows = [(i, " ".join(words[100 * i : 100 * i + 100])) for i in range(80)]
    rows += [(80, "-".join(words[8000:])), (None, "international " * 3), (5, rows[5][1]), (6, None), (7, ""), (8, "1 2 3 ñ")]
    return rows


def test_equals_brute_force_over_all_pairs(spark):
    rows = corpus()
    want = expected(rows)
    assert sum(r[1] is not None for r in want) > 5
    assert got(spark, rows) == want


def test_every_edit_of_a_word_meets_it(spark):
    """No place of the edit is lost by the chunks, at any length and with letters of two bytes."""
    rng = random.Random(8)
    for word in ("straße", "garçon" + "s", "mississippi", "aabbaabbaabbaabb"):
        edits = {word[:i] + word[i + 1 :] for i in range(len(word))}
        edits |= {word[:i] + rng.choice("axé") + word[i:] for i in range(len(word) + 1)}
        edits |= {word[:i] + rng.choice("ayé") + word[i + 1 :] for i in range(len(word))}
        edits = sorted(w for w in edits if w != word and len(w) >= 6)
        words = spark.createDataFrame([(word, 100)] + [(w, 5) for w in edits], "word string, n long")
        pairs = {(r.a, r.b) for r in spelling.near_pairs(words).collect()}
        assert {frozenset((word, w)) for w in edits} <= {frozenset(p) for p in pairs}
        everything = [word, *edits]
        want = {frozenset((a, b)) for a in everything for b in everything if a < b and one_edit(a, b)}
        assert len(pairs) == len(want) and {frozenset(p) for p in pairs} == want


def test_ties_go_to_the_smaller_word_and_chains_to_their_end(spark):
    words = [("abcdef", 5), ("abcdeg", 25), ("abcdeh", 25), ("abcdegg", 125), ("abcdeggg", 700), ("zzzzzz", 5)]
    out = {r.word: r for r in spelling.grouped(spark.createDataFrame(words, "word string, n long")).collect()}
    assert (out["abcdef"].form, out["abcdef"].form_n, out["abcdef"].n_near) == ("abcdeg", 25, 2)
    assert out["abcdef"].root == "abcdeggg"
    assert (out["zzzzzz"].form, out["zzzzzz"].root, out["zzzzzz"].n_near) == (None, "zzzzzz", 0)


def test_empty_table(spark):
    assert got(spark, []) == [] and got(spark, [(1, None)]) == []
