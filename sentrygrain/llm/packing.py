"""Packing by minimum bin slack.

Documents are tokenised once and cut into full windows and one remainder. The
remainders' lengths form a histogram of at most ``WINDOW`` counts, whatever the
corpus. On it, the largest length left opens a window and a bitset subset-sum
dynamic program picks the multiset of lengths that fills it closest to
capacity; the pattern is used as often as its counts allow. A window's slots
are then handed out by each piece's rank among the pieces of its length.

Null text is empty and gives one piece, the end mark. Rows of one id are packed
one by one. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stages import save
from .arrays import Texts, parts

WINDOW = 1024
END = 0
RANK_ROWS = 50_000
_HELD = 1_200_000


@lru_cache(maxsize=2)
def ranked(path: str):
    """The vocabulary of a byte-level BPE file as ranks, and each id's length in bytes.

    Ids of such a file are ranks of merges, so the faster rank encoder gives the
    ids that the file's own tokenizer gives to texts without its added tokens; a
    test compares them. Texts with one go through the file's own tokenizer.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    tokenizer = Tokenizer.from_file(path)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    ranks = {bytes(byte_of[c] for c in w): i for w, i in tokenizer.get_vocab().items() if w not in special}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for word, i in ranks.items():
        sizes[i] = len(word)
    own = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return own, sizes


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids of whole texts, each distinct chunk encoded once.

    A chunk starts at a space before a printable ASCII character or a Latin-1
    letter. The tokenizer's own pattern always starts a piece there, so the
    chunks' ids in sequence are the text's ids.
    """

    def __init__(self, path: str):
        self.coder, self.sizes = ranked(path)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _add(self, keys: np.ndarray, chunks: list[bytes], spaced: np.ndarray) -> None:
        """Encodes chunks that start with a space in one call; ids fall to chunks by the bytes they stand for."""
        found = [np.array(self.coder.encode_ordinary(c.decode()), np.int32) for c, s in zip(chunks, spaced, strict=True) if not s]
        joined = [c for c, s in zip(chunks, spaced, strict=True) if s]
        ids = np.array(self.coder.encode_ordinary(b"".join(joined).decode()), np.int32)
        ends = np.cumsum([len(c) for c in joined], dtype=np.int64)
        count = np.zeros(len(chunks), np.int64)
        count[~spaced] = [len(f) for f in found]
        count[spaced] = np.diff(np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1, prepend=0)
        begin = np.zeros(len(chunks), np.int64)
        begin[spaced] = np.cumsum(count[spaced]) - count[spaced]
        begin[~spaced] = len(ids) + np.cumsum(count[~spaced]) - count[~spaced]
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.begin = np.insert(self.begin, place, begin + len(self.ids))
        self.count = np.insert(self.count, place, count)
        self.ids = np.concatenate([self.ids, ids, *found])

    def encode(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in sequence, and where each row's begin."""
        d = t.data
        if not len(d):
            return np.zeros(0, np.int32), np.zeros(t.n + 1, np.int64)
        inner = np.zeros(len(d) + 1, bool)
        after = d[1:]
        inner[: len(after)] = (d[:-1] == 0x20) & (((after > 0x20) & (after < 0x7F)) | (after == 0xC3))
        inner[t.offsets[1:] - 1] = False  # a space that ends a row stays with what is before it
        cut = inner.copy()
        cut[t.offsets] = True
        bounds = np.flatnonzero(cut)
        starts, ends = bounds[:-1], bounds[1:]
        keys, first, which = np.unique(t.spans.of(starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > _HELD:
            self.clear()
        place = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = place < len(self.keys)
        new[inside] = self.keys[place[inside]] != keys[inside]
        if new.any():
            raw = d.tobytes()
            begin, end = starts[first[new]], ends[first[new]]
            chunks = [raw[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
            self._add(keys[new], chunks, inner[begin])
        at = np.searchsorted(self.keys, keys)[which]
        begin, count = self.begin[at], self.count[at]
        total = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=total[1:])
        ids = self.ids[np.repeat(begin - total[:-1], count) + np.arange(total[-1])]
        return ids, total[np.searchsorted(bounds, t.offsets)]


@lru_cache(maxsize=2)
def own_tokenizer(path: str):
    """The file's tokenizer, and the contents of its added tokens."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return tokenizer, [t.content for t in tokenizer.get_added_tokens_decoder().values()]


def with_added(text: pa.Array, path: str) -> dict[int, np.ndarray]:
    """Ids of the rows that hold an added token; no other row's ids depend on added tokens."""
    tokenizer, added = own_tokenizer(path)
    rows: set[int] = set()
    for content in added:
        rows.update(np.flatnonzero(pc.match_substring(text, content).fill_null(False).to_numpy(zero_copy_only=False)).tolist())
    return {r: np.array(tokenizer.encode(text[r].as_py(), add_special_tokens=False).ids, "<u4") for r in sorted(rows)}


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row per cut of a document: full windows from its start, then the rest."""
    path = vocabulary or default_vocabulary()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            special = with_added(batch.column(1), path)
            for t in parts(batch.column(1)):
                ids, at = enc.encode(t)
                row, start, length, crc, tokens = [], [], [], [], []
                flat = ids.astype("<u4")
                for i in range(t.n):
                    own = special.get(t.first + i, flat[at[i] : at[i + 1]])
                    own = np.append(own, np.array([END], "<u4"))
                    n = len(own)
                    for s in range(0, n, window):
                        row.append(t.first + i)
                        start.append(s)
                        length.append(min(window, n - s))
                        crc.append(zlib.crc32(own[s : s + window].tobytes()))
                        tokens.append(n)
                ids_of = batch.column(0).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids_of, *(pa.array(c, pa.int64()) for c in (start, length, crc, tokens))], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    )


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, within ``counts``, whose sum is closest to ``capacity`` from below."""
    reach, goal = 1, 1 << capacity
    inside = (goal << 1) - 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted((n for n in counts if n <= capacity), reverse=True):
        left, k = min(counts[length], capacity // length), 1
        while left and not reach & goal:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << length * k) & inside
            left -= k
            k *= 2
        if reach & goal:
            break
    at, used = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + k
            at -= length * k
    return used


def patterns(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, dict[int, int]]]:
    """(how often, length -> how many) of each window, by minimum slack."""
    left = {n: c for n, c in counts.items() if c}
    out = []
    while left:
        largest = max(left)
        rest = left | {largest: left[largest] - 1}
        used = fill({n: c for n, c in rest.items() if c}, window - largest)
        used[largest] = used.get(largest, 0) + 1
        times = min(left[n] // k for n, k in used.items())
        out.append((times, used))
        for n, k in used.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return out


def slots(counts: dict[int, int], window: int = WINDOW) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces of this length in a window, offset of the first)."""
    rows, ranks, sequence = [], {}, 0
    for times, used in patterns(counts, window):
        offset = 0
        for length, k in sorted(used.items(), reverse=True):
            rows.append((length, ranks.get(length, 0), sequence, k, offset))
            ranks[length] = ranks.get(length, 0) + k * times
            offset += length * k
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW) -> DataFrame:
    cut = save(pieces(docs, vocabulary, window))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``window`` rows
    plan = slots(counts, window)
    buckets = max(8, sum(counts.values()) // RANK_ROWS)
    placed = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    sizes = placed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = placed.withColumn("at", F.row_number().over(inside)).join(sizes, ["length", "bucket"])
    ranked = ranked.select(*cut.columns, (F.col("before") + F.col("at") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (plan[:, 0] << 48) + plan[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 5))
            own = plan[np.searchsorted(keys, (length.astype(np.int64) << 48) + rank, "right") - 1]
            nth = rank - own[:, 1]
            columns = [*batch.columns[:5], pa.array(own[:, 2] + nth // own[:, 3]), pa.array(own[:, 4] + nth % own[:, 3] * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:5], "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(
        place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
