"""Spelling variants: words one edit apart, found by asymmetric chunks.

One word of a pair, the shorter or equally long one, contributes two disjoint
chunks, its halves; one edit leaves one of them as it is. The other word
contributes positional grams: of all its grams those that can equal a chunk of a
word of its length or one shorter, so they lie at the chunk's place or one to the
right (the difference of the lengths says which). What is left of both words
beside the shared chunk again differs by one edit and is cut in the same way.
Words that meet thus agree in about three quarters of their letters at the same
places, and a frequent beginning or ending alone makes no candidates. Every pair one
edit apart meets; edit distance then decides, so hashes of chunks can collide freely.

Null and empty texts have no words, a null id counts as an empty one, repeated rows
count again, long texts are read whole, other columns are ignored, and an empty table
gives no rows. Words of equal n are ordered by code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stages import save

RUN = "[A-Za-zÀ-ÿ]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def vocabulary(docs: DataFrame, *, drop_every: int = 199, min_chars: int = 6, min_count: int = 5) -> DataFrame:
    """(word, n): lower-cased runs of letters with their number of occurrences.

    A run whose crc32 with its document's id is divisible by ``drop_every`` loses one letter first.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("own"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.filter(F.char_length("run") >= min_chars)  # deletions only make words shorter
    runs = runs.select("own", F.translate("run", _UPPER, _UPPER.lower()).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("own", F.lit(":"), "run")).alias("h"))
    at = "cast(h % char_length(run) as int)"
    shorter = F.expr(f"concat(substr(run, 1, {at}), substr(run, {at} + 2))")
    words = runs.select(F.when(F.col("h") % drop_every == 0, shorter).otherwise(F.col("run")).alias("word"))
    words = words.filter(F.char_length("word") >= min_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def _cuts(text: str, size: str, shift: int) -> list[tuple[str, str, str]]:
    """SQL for the two kept chunks: (chunk, what is left, its length in the chunks' word).

    ``text`` is ``shift`` longer than the chunks' word, whose length is ``size``.
    """
    half = f"({size} div 2)"
    return [
        (f"substr({text}, 1, {half})", f"substr({text}, {half} + 1)", f"({size} - {half})"),
        (f"substr({text}, {half} + {1 + shift})", f"substr({text}, 1, {half} + {shift})", half),
    ]


def _keys(shift: int) -> Column:
    """Hashes of two nested chunks with their places, for words ``shift`` longer than the chunks' word."""
    size = f"cast(char_length(word) - {shift} as int)"
    keys = []
    for i, (chunk, rest, left) in enumerate(_cuts("word", size, shift)):
        for j, (inner, _, _) in enumerate(_cuts(rest, left, shift)):
            keys.append(f"xxhash64({size}, {2 * i + j}, {chunk}, {inner})")
    return F.expr(f"array({', '.join(keys)})")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b), each pair of words exactly one edit apart once; a is shorter, or as long and smaller.

    ``words`` has distinct words of at least four code points with their n.
    """
    chunks = words.select(F.explode(_keys(0)).alias("key"), F.col("word").alias("a"), F.col("n").alias("n_a"))
    grams = F.array_union(_keys(0), _keys(1))
    grams = words.select(F.explode(grams).alias("key"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    longer = F.char_length("b") > F.char_length("a")
    met = chunks.join(grams, "key").filter(longer | (F.col("a") < F.col("b")))
    met = met.filter(F.levenshtein("a", "b", 1) == 1)
    return met.dropDuplicates(["a", "b"]).select("a", "n_a", "b", "n_b")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words with a form; each round doubles the way, so rounds grow with the log of the chain's length."""
    roots = save(forms.select("word", F.col("form").alias("root")))
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        further = save(further)
        if further.filter("moved").isEmpty():
            return further.select("word", "root")
        roots = further.select("word", "root")


def grouped(words: DataFrame, *, ratio: int = 5) -> DataFrame:
    """Each of ``words`` (word, n) with its form, the most frequent near word of at least ``ratio`` times its n, and its root."""
    pairs = near_pairs(words)
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("other_n"))
    sides = sides.union(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("other_n")))
    best = F.min(F.struct((-F.col("other_n")).alias("rank"), "other"))
    near = sides.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    rows = words.join(near, "word", "left")
    is_form = -F.col("best.rank") >= ratio * F.col("n")
    rows = rows.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("best.other")).alias("form"),
        F.when(is_form, -F.col("best.rank")).alias("form_n"),
    )
    rows = save(rows)
    roots = _roots(rows.filter("form is not null"))
    rows = rows.join(roots, "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame) -> DataFrame:
    return grouped(save(vocabulary(docs)))
