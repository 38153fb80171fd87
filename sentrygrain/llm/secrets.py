"""Secret scans: fixed patterns plus a token-efficiency test.

A vocabulary learnt from prose covers prose with few tokens. A run of key-like
characters that needs many tokens for its length is a random string. Of a run
that is none as a whole, segments (between + / _ = -) and windows of tokens are
tested too, and a window's segments go as a whole. Known digests (hexadecimal of
a digest's length), UUIDs and plain numbers are excluded first, as runs and as
segments, and so are a pattern's spans. Identifiers made of short parts (paths,
dates, phone numbers, class names) or mostly of digits are no random strings: each
short part costs a token whatever it says, while random base64 has a separator in 32 characters.

Spans are (kind, start, end) in code points, end exclusive, over the whole
text; null or empty text has none. Kinds in order: assign, access, hex, random.
A text is decoded and searched only where a byte-level test, which can't miss,
finds something to search for.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Texts, lower_ascii, parts

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_DIGEST = re.compile(r"[0-9a-fA-F]+")
_EDGE = re.compile(r"[+/_=-]")
_KNOWN = re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9a-fA-F]+)(?![A-Za-z0-9])")
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24

#: A run is random if it has at least so many characters, and fewer than so many of them for each token.
MIN_RUN, CHARS_PER_TOKEN = 20, 1.9
#: The same for windows within a run, and for letters of one case, of which at least so many must differ.
WINDOW_CHARS_PER_TOKEN, LOWER_CHARS_PER_TOKEN, UPPER_CHARS_PER_TOKEN, MIN_LETTERS = 1.7, 1.85, 1.7, 9

#: Fewer characters a part, separators included, or a smaller share of letters (percent) make a run an identifier.
MIN_PART, LETTERS_PERCENT = 6.5, 20


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_IS_HEX = _class(b"0123456789abcdef")
_IS_RUN = _class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")


@lru_cache(maxsize=2)
def encoding(ranks: str):
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def is_random(run: str, ranks: str) -> bool:
    """Whether a run of key-like characters is a random string."""
    if len(run) < MIN_RUN or _UUID.fullmatch(run) or run.isdigit():
        return False
    if len(run) in DIGEST_LENGTHS and _DIGEST.fullmatch(run):
        return False
    return _many_tokens(run, len(encoding(ranks).encode_ordinary(run)), CHARS_PER_TOKEN)


def _identifier(run: str) -> bool:
    """Whether a run consists of short parts, or of numbers."""
    parts_ = [p for p in _EDGE.split(run) if p]
    letters = sum(c.isalpha() for c in run)
    return len(run.strip("+/_=-")) < MIN_PART * len(parts_) or 100 * letters < LETTERS_PERCENT * len(run)


def _many_tokens(run: str, tokens: int, limit: float) -> bool:
    if _identifier(run):
        return False
    kinds = sum(bool(re.search(k, run[1:])) for k in ("[a-z]", "[A-Z]", "[0-9]", "[+/_=-]"))
    if kinds < 2:  # one case of letters, a word, capitalised or not, a rule of dashes
        if not run.isalpha() or len(set(run)) < MIN_LETTERS:
            return False
        limit = min(limit, UPPER_CHARS_PER_TOKEN if run[1:].isupper() else LOWER_CHARS_PER_TOKEN)
    return len(run) < limit * tokens


def random_parts(run: str, ranks: str) -> list[tuple[int, int]]:
    """(start, end) of random strings within a run that is not random as a whole: segments, and those that token windows touch."""
    edges = [-1, *(m.start() for m in _EDGE.finditer(run)), len(run)]
    segments = [(a + 1, b) for a, b in zip(edges, edges[1:], strict=False) if b > a + 1]
    found = [(a, b) for a, b in segments if is_random(run[a:b], ranks)]
    ends = np.cumsum([len(x) for x in encoding(ranks).decode_tokens_bytes(encoding(ranks).encode_ordinary(run))]).tolist()
    starts, last = [0, *ends[:-1]], 0
    for first, start in enumerate(starts):
        while last < len(ends) and ends[last] - start < MIN_RUN:
            last += 1
        if last == len(ends):
            break
        window = run[start : ends[last]]
        if re.search("[A-Za-z]", window) and _many_tokens(window, last - first + 1, WINDOW_CHARS_PER_TOKEN):
            found += [(a, b) for a, b in segments if a < ends[last] and start < b and min(b, ends[last]) - max(a, start) > 1]
    out: list[list[int]] = []
    for a, b in sorted(set(found)):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    found += [("hex", *m.span()) for m in _HEX.finditer(text) if len(m[0]) >= MIN_HEX]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def random_spans(text: str, base: list[tuple[str, int, int]], ranks: str) -> list[tuple[str, int, int]]:
    out = []
    for m in _RUN.finditer(text):
        if len(m[0]) < MIN_RUN:
            continue
        cuts = [(s, e) for _, s, e in base if s < m.end() and m.start() < e]
        if not cuts and is_random(m[0], ranks):
            out.append(("random", *m.span()))
            continue
        for k in _KNOWN.finditer(m[0]):
            if "-" in k[0] or k[0].isdigit() or len(k[0]) in DIGEST_LENGTHS:
                cuts.append((m.start() + k.start(), m.start() + k.end()))
        at = m.start()
        for s, e in [*sorted(cuts), (m.end(), m.end())]:
            if s - at >= MIN_RUN:
                out += [("random", at + a, at + b) for a, b in random_parts(text[at:s], ranks)]
            at = max(at, e)
    return out


def all_spans(text: str, ranks: str) -> tuple[list, list]:
    base = base_spans(text)
    return base, sorted(base + random_spans(text, base, ranks), key=lambda s: (s[1], KINDS.index(s[0])))


def _long_run(t: Texts, member: np.ndarray, least: int) -> np.ndarray:
    """Rows with a run of at least ``least`` member bytes."""
    out = np.zeros(t.n, bool)
    if len(t.data) >= least:
        total = np.zeros(len(t.data) + 1, np.int64)
        np.cumsum(member[t.data], out=total[1:])
        at = np.flatnonzero(total[least:] - total[:-least] == least)
        row = np.searchsorted(t.offsets, at, "right") - 1
        out[row[at + least <= t.offsets[row + 1]]] = True
    return out


def suspects(t: Texts) -> np.ndarray:
    """Rows that may hold a span; no row with one is left out."""
    out = _long_run(t, _IS_RUN, MIN_RUN) | _long_run(t, _IS_HEX, MIN_HEX)
    small, plain = lower_ascii(t).data.tobytes(), t.data.tobytes()
    for text, words in ((small, _WORDS), (plain, (b"AKIA",))):
        for w in words:
            at = text.find(w)
            while at >= 0:
                row = int(np.searchsorted(t.offsets, at, "right")) - 1
                out[row] = True
                at = text.find(w, max(at + 1, int(t.offsets[row + 1]) - len(w) + 1))
    return out


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def secrets(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """One row per document: counts by kind, a digest of the pattern spans, and all spans."""
    ranks = ranks or default_ranks()
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, text = batch.num_rows, batch.column(1)
            counts = np.zeros((4, n), np.int64)
            digest, spans = [nothing] * n, [""] * n
            for t in parts(text):
                for i in np.flatnonzero(suspects(t)):
                    row = t.first + int(i)
                    base, found = all_spans(text[row].as_py(), ranks)
                    for k, _, _ in found:
                        counts[KINDS.index(k), row] += 1
                    digest[row], spans[row] = hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found)
            columns = [batch.column(0), *(pa.array(c) for c in counts), pa.array(digest, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"
    )


def hide(text: str, spans: list[tuple[str, int, int]], mark: str = "[{}]") -> str:
    """``text`` with every maximal run of spans replaced by its first kind's mark."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], mark.format(kind)]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """``docs`` with secrets replaced in ``text``; all columns stay, null text stays null."""
    ranks = ranks or default_ranks()

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in texts:
            rows = [t.first + int(i) for t in parts(text) for i in np.flatnonzero(suspects(t))]
            mask = np.zeros(len(text), bool)
            mask[rows] = True
            new = [hide(s := text[r].as_py(), all_spans(s, ranks)[1]) for r in rows]
            yield pc.replace_with_mask(text, pa.array(mask), pa.array(new, text.type))

    return docs.withColumn("text", F.arrow_udf(run, "string")(F.col("text")))
