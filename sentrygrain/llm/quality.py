"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements
and one failure bit per rule. A policy is a versioned mask over these bits, so
applying one, comparing two, or asking what a rule alone costs are bitwise
operations on the ledger and never read a text again.

Null or empty text has no words and fails ``few_words``. Rows with the same id
are measured one by one. Extra columns, of any name, are carried by
``with_ledger`` unless they carry a ledger name, which then is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import Spans, Texts, mix, parts, per_row, windows

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
REPEAT_WIDTH = 8
#: Bytes of text that are measured at once: a worker holds over a hundred times as many.
PART = 1 << 20
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

#: name -> true where a document fails. The position in this table is the rule's bit.
RULES = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "2 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines and n_dup_lines >= 4",
    "short_words": "2 * word_chars < 3 * n_words",
    "long_words": "word_chars > 25 * n_words",
}


def bits(*names: str) -> int:
    order = list(RULES)
    return sum(1 << order.index(n) for n in set(names))


@dataclass(frozen=True)
class Policy:
    """A version's rules: a document that fails any of them goes."""

    version: int
    mask: int


BASE = Policy(1, bits("few_words", "repeated_words"))
CURRENT = Policy(2, bits(*RULES))


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def measure(t: Texts) -> dict[str, np.ndarray]:
    points = np.zeros(len(t.data) + 1, np.int64)
    np.cumsum((t.data & 0xC0) != 0x80, out=points[1:])
    starts, ends, bounds = t.word_starts, t.word_ends, t.word_bounds
    out = {
        "n_words": np.diff(bounds),
        "word_chars": per_row(points[ends] - points[starts], bounds),
        "n_symbols": per_row(_SYMBOL[t.data], t.offsets),
    }

    breaks = np.flatnonzero(t.data == 10)
    begins = np.sort(np.concatenate([t.offsets[:-1], breaks + 1]), kind="stable")
    row = np.concatenate([np.arange(t.n), np.searchsorted(t.offsets, breaks, "right") - 1])
    row = row[np.argsort(np.concatenate([t.offsets[:-1], breaks + 1]), kind="stable")]
    stops = np.sort(np.concatenate([breaks, t.offsets[1:]]), kind="stable")
    # a break belongs to the row before a bound at the same place, an empty row has one empty line
    order = np.lexsort((begins, row))
    begins, row = begins[order], row[order]
    stops = np.maximum(np.where(np.append(row[1:], -1) == row, np.append(begins[1:], 1) - 1, t.offsets[row + 1]), begins)
    used = np.searchsorted(starts, stops) > np.searchsorted(starts, begins)
    begins, stops, row = begins[used], stops[used], row[used]
    out["n_lines"] = np.bincount(row, minlength=t.n)
    keys = mix(t.spans.of(begins, stops) ^ mix(row.astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(keys, return_index=True)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(row[first], minlength=t.n)

    at, row = windows(t, REPEAT_WIDTH)
    keys = mix(Spans(t.word_hashes).of(at, at + REPEAT_WIDTH) ^ mix(row.astype(np.uint64) + np.uint64(1)))
    at = at[_repeated(keys)]
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + REPEAT_WIDTH, -1)
    out["n_repeat_words"] = per_row(np.cumsum(cover[:-1]) > 0, bounds)
    return out


def with_ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with all measurements and ``failed_bits``; the text column stays as it is."""
    kept = [c for c in docs.columns if c not in (*MEASURES, "failed_bits")]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), *(f"{m} long" for m in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(t) for t in parts(batch.column(kept.index(text)), PART)]
            columns = list(batch.columns)
            columns += [pa.array(np.concatenate([f[m] for f in found] or [np.zeros(0)]).astype(np.int64)) for m in MEASURES]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *MEASURES])

    failed = F.lit(0)
    for i, rule in enumerate(RULES.values()):
        failed = failed.bitwiseOR(F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)))
    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema).withColumn("failed_bits", failed)


def passes(policy: Policy) -> Column:
    return F.col("failed_bits").bitwiseAND(F.lit(policy.mask)) == 0


def apply_policy(ledger: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    return ledger.filter(passes(policy))


def ablation(ledger: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """What each rule of a policy rejects, and what only it rejects.

    One aggregation over distinct masks, of which there are at most
    2**len(RULES) whatever the size of the corpus.
    """
    masks = ledger.groupBy(F.col("failed_bits").bitwiseAND(F.lit(policy.mask)).alias("mask")).agg(F.count("*").alias("n"))
    rules = [(n, 1 << i) for i, n in enumerate(RULES) if policy.mask >> i & 1]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).alias("bit")) for n, b in rules])).alias("r")
    hit = F.col("mask").bitwiseAND(F.col("r.bit")) != 0
    return (
        masks.select("mask", "n", rows)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.lit(policy.version).alias("version"),
            F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("rejected"),
            F.sum(F.when(F.col("mask") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("rejected_alone"),
        )
    )


def quality(docs: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """One row per document with its measurements, bits, base verdict and verdict."""
    ledger = with_ledger(docs.select("doc_id", "text"))
    return ledger.select(
        "doc_id",
        *MEASURES,
        "failed_bits",
        (~passes(BASE)).alias("base_failed"),
        passes(Policy(policy.version, policy.mask | BASE.mask)).alias("kept"),
    )
