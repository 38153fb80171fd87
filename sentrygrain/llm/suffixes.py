"""Suffix-array dedup: a distributed, common-prefix-aware merge sort of suffixes.

Suffixes are those that start at anchors (see anchors.py) whose string is met
with different surroundings. Each task sorts its own into runs and front-codes
them: a suffix is its common prefix length with the one before and the rest.
Runs are exchanged by the anchor's hash, so suffixes that share at least
``GRAM`` bytes meet, and combined with a loser tree whose nodes remember common
prefix lengths: characters known to agree are never compared again. Sorted
neighbours with a long common prefix form groups, in which the bytes left of the
anchor decide how far a match extends.

A byte goes if a ``WIDTH``-byte string that covers it starts anywhere else, in
the same document or another. Texts are UTF-8 bytes and null is empty; matches
never cross documents; texts shorter than ``WIDTH`` are untouched. Ids must be
unique: rows that repeat an id get each other's runs. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import anchors
from .anchors import Kind
from .blobs import opened

WIDTH, GRAM = 200, 50
RUN = 50_000
_HEAD = struct.Struct("<HHHqq")

Suffix = tuple[bytes, bytes, int, int]  # from the anchor on, left of it, doc_id, pos


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are known to agree."""
    n = min(len(a), len(b))
    while known < n:
        x, y = a[known : known + 32], b[known : known + 32]
        if x != y:
            m = min(len(x), len(y))
            d = int.from_bytes(x[:m]) ^ int.from_bytes(y[:m])
            return known + (m - (d.bit_length() + 7) // 8 if d else m)
        known += 32
    return n


def front_coded(suffixes: list[Suffix]) -> bytes:
    out, before = [], b""
    for text, left, doc, pos in sorted(suffixes):
        known = common(before, text)
        out += [_HEAD.pack(known, len(text) - known, len(left), doc, pos), text[known:], left]
        before = text
    return b"".join(out)


def decoded(run: bytes) -> Iterator[tuple[int, Suffix]]:
    """(common prefix length with the suffix before, suffix) in order."""
    at, text = 0, b""
    while at < len(run):
        known, rest, left, doc, pos = _HEAD.unpack_from(run, at)
        at += _HEAD.size
        text = text[:known] + run[at : at + rest]
        at += rest
        yield known, (text, run[at : at + left], doc, pos)
        at += left


def merge(runs: list[Iterator[tuple[int, Suffix]]]) -> Iterator[tuple[int, Suffix]]:
    """One sorted sequence, each suffix with its common prefix length with the one before.

    A contender's number is its common prefix length with the last winner; the
    larger is the smaller suffix, and only equal numbers need a look, from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    done: tuple = (-1, None)
    current = [next(r, done) for r in runs] + [done] * (k - len(runs))
    losers = [0] * k

    def play(x: int, y: int) -> tuple[int, int]:
        """(winner, loser)."""
        (h, s), (g, r) = current[x], current[y]
        if h != g:
            return (x, y) if h > g else (y, x)
        if h < 0:
            return x, y
        a, b = s[0], r[0]
        m = common(a, b, h)
        if m == len(a) or (m < len(b) and a[m] < b[m]):
            current[y] = (m, r)
            return x, y
        current[x] = (m, s)
        return y, x

    winners = list(range(k)) if k > 1 else [0]
    level = [*range(k)]
    node = k
    while len(level) > 1:
        node //= 2
        up = []
        for i in range(0, len(level), 2):
            w, losers[node + i // 2] = play(level[i], level[i + 1])
            up.append(w)
        level = up
    top = level[0] if winners else 0
    while current[top][0] >= 0:
        yield current[top]
        current[top] = next(runs[top], done)
        i = (top + k) // 2
        while i:
            top, losers[i] = play(top, losers[i])
            i //= 2


def covered(group: list[tuple[int, Suffix]], width: int = WIDTH) -> Iterator[tuple[int, int, int]]:
    """(doc_id, begin, end) of matches of ``width`` or more bytes between suffixes that share an anchor."""
    if len(group) <= 12:
        backward = [s[1][::-1] for _, s in group]
        for x in range(len(group)):
            shared = 1 << 60
            for y in range(x + 1, len(group)):
                shared = min(shared, group[y][0])
                left = common(backward[x], backward[y])
                if left + shared >= width:
                    for _, (_, _, doc, pos) in (group[x], group[y]):
                        yield doc, pos - left, pos + shared
        return
    most = max(len(s[1]) for _, s in group)
    for left in range(most + 1):
        seen: dict[bytes, int] = {}
        for i, (_, (text, before, doc, pos)) in enumerate(group):
            if len(before) >= left and len(text) + left >= width:
                window = before[len(before) - left :] + text[: width - left]
                j = seen.setdefault(window, i)
                if j != i:
                    yield doc, pos - left, pos - left + width
                    if j >= 0:
                        first = group[j][1]
                        yield first[2], first[3] - left, first[3] - left + width
                        seen[window] = -1


def groups(ordered: Iterable[tuple[int, Suffix]], gram: int) -> Iterator[list[tuple[int, Suffix]]]:
    group: list[tuple[int, Suffix]] = []
    for known, suffix in ordered:
        if known < gram and group:
            yield group
            group = []
        group.append((known, suffix))
    if group:
        yield group


def resolve(docs: DataFrame, kind: Kind):
    def run(reps: DataFrame) -> DataFrame:
        tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

        def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import zstandard

            pack = zstandard.ZstdCompressor(level=1)
            runs: dict[int, list[Suffix]] = {}
            held = 0

            def flush():
                to = list(runs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to, pa.int64()), pa.array([pack.compress(front_coded(runs[d])) for d in to], pa.binary())],
                    names=["part", "run"],
                )
                runs.clear()

            for batch in batches:
                for doc, text, found in zip(batch.column(0).to_pylist(), opened(batch.column(1)), batch.column(2), strict=True):
                    pos, extent, gram = (found.values.field(i).to_pylist() for i in range(3))
                    for p, e, g in zip(pos, extent, gram, strict=True):
                        runs.setdefault(g % tasks, []).append((text[p : p + (e & 0xFFFFFFFF)], text[p - (e >> 32) : p], doc, p))
                        held += 1
                    if held >= RUN:
                        yield from flush()
                        held = 0
            if runs:
                yield from flush()

        def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            runs = [decoded(r) for batch in batches for r in opened(batch.column(1))]
            if not runs:
                return
            out: list[tuple[int, int, int]] = []
            for group in groups(merge(runs), kind.gram):
                if len(group) > 1:
                    for row in covered(group, kind.width):
                        out.append(row)
                        if len(out) >= 20_000:
                            yield _table(out)
                            out = []
            yield _table(out)

        id_kind = docs.schema["doc_id"].dataType.simpleString()
        runs = anchors.with_texts(reps, docs).select("doc_id", "blob", "found").mapInArrow(sort, "part long, run binary")
        return runs.repartition(tasks, "part").mapInArrow(combine, f"doc_id {id_kind}, begin long, end long").distinct()

    return run


def _table(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["doc_id", "begin", "end"])


def _finish(text: bytes, runs: list[tuple[int, int]]) -> tuple:
    at, kept = 0, hashlib.sha256()
    for begin, end in runs:
        kept.update(text[at:begin])
        at = end
    kept.update(text[at:])
    return len(text), sum(e - b for b, e in runs), len(runs), kept.hexdigest()


def dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """One row per document: bytes, bytes and runs that go, and a digest of what stays."""
    kind = Kind(width, gram, words=False)
    runs = anchors.repeated(docs, kind, False, resolve(docs, kind))
    return anchors.removed(docs, runs, _finish, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
