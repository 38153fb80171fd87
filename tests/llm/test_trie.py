"""The conversation trie against a plain one, with shards down to a row or two."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from sentrygrain.llm import trie

SCHEMA = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("words", T.StringType()),
    ]
)
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """(conv_id -> rebuilt turns) by the definition."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((-1 if turn is None else turn, digest, role, text))
    own = {c: [(r[2], r[3]) for r in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = int(c / 20) * 20  # towards zero, as SQL divides
        out[c] = own.get(base, [])[:h] + ts[h:]
    return out


def expected(rows):
    convs = plain(rows)
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def below(node):
        leaves, saved = int(not children[node]), 0
        if node:
            saved = (len(members[node]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1]))
        for child in children[node]:
            more = below(child)
            leaves, saved = leaves + more[0], saved + more[1]
        return leaves, saved

    out = []
    for node, ids in members.items():
        ends = ",".join(str(c) for c in ids if len(convs[c]) == len(node))
        parent = members[node[:-1]][0] if node else None
        out.append((ids[0], len(node), parent, len(ids), len(children[node]), *below(node), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations():
    rng = random.Random(11)
    says = ["hi there", "", None, "one two  three\nfour", "x", "日本 語", "a" * 3000 + " b"]
    rows = []
    for c in range(120):
        if c == 40:
            continue  # a family without its first conversation
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t if t or c % 7 else None, rng.choice(("user", "assistant", None)), rng.choice(says)))
    for c in range(200, 260):  # copies of one conversation, some longer
        rows += [(c, t, "user", f"copy {t}") for t in range(3 + (c % 9 == 0))]
    for c in range(300, 303):  # deep, shared almost to the end
        rows += [(c, t, "user", "deep") for t in range(300)] + [(c, 300, "user", f"end {c // 2}")]
    rows += [(401, 0, "user", "x")] * 2 + [(401, 0, "a", "x")]  # turns of one number, repeated rows
    rows += [(None, 0, "user", "no id"), (3, 900, "user", "late"), (-5, 0, "user", "negative")]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize("most_rows, most_turns", [(1 << 16, 1 << 19), (1, 1 << 19), (3, 1 << 19), (1 << 16, 10)])
def test_equals_a_plain_trie(spark, most_rows, most_turns):
    rows = conversations()
    sequences = trie.rebuilt(trie.sequences(table(spark, rows)))
    out = trie.trie(sequences, most_rows, most_turns)
    assert out.columns == COLUMNS
    assert sorted((tuple(r) for r in out.collect()), key=str) == expected(rows)


def test_empty_and_turnless(spark):
    assert trie.conversation_trie(table(spark, [])).collect() == []
    alone = next(c for c in range(41, 60) if zlib.crc32(str(c).encode()) % 4)  # its only turn would come from the absent 40
    rows = [(alone, 0, "user", "x")]
    assert [tuple(r) for r in trie.conversation_trie(table(spark, rows)).collect()] == expected(rows)
    assert expected(rows)[0][1:6] == (0, None, 1, 0, 1)


def test_findclose_equals_a_stack():
    rng = random.Random(2)
    for n in (1, 2, 40, 3000):
        bits, depth = [], 0
        while len(bits) < 2 * n:
            opens = sum(bits)
            if opens < n and (depth <= 0 or rng.random() < 0.55):
                bits.append(1)
                depth += 1
            else:
                bits.append(0)
                depth -= 1
        want, stack = {}, []
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                want[stack.pop()] = i
        opens = np.flatnonzero(bits)
        found = trie.Parentheses(np.array(bits, np.int8)).findclose(opens)
        assert found.tolist() == [want[i] for i in opens.tolist()]


def test_deep_chain_closes_across_many_blocks():
    bits = np.array([1] * 5000 + [0] * 5000, np.int8)
    found = trie.Parentheses(bits).findclose(np.arange(5000))
    assert found.tolist() == list(range(9999, 4999, -1))
