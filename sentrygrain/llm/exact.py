"""Exact dedup: 128-bit content hash, smallest stable winner, bytes compared inside groups.

Texts are equal when they agree after ASCII white space is deleted; null
counts as empty. Hashes and ids are grouped first, with partial aggregation,
so a text is moved only where its hash occurs more than once. Among those,
grouping and the join back compare the normalised text itself: two texts of
one hash but other bytes fall into two groups.

Of equal texts the row with the most code points in the original text, then
the smallest ``doc_id``, stays. Rows that repeat a whole row, id included, are
each returned and counted. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stages import save

_BLANK = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _BLANK, "")


def _best() -> Column:
    """Smallest id among the longest originals."""
    return F.min(F.struct((-F.col("chars")).alias("short"), F.col("doc_id").alias("doc_id")))


def exact(docs: DataFrame) -> DataFrame:
    plain = normalised(F.col("text"))
    chars = F.coalesce(F.char_length("text"), F.lit(0)).alias("chars")
    named = F.unhex(F.md5("plain")).alias("hash")
    rows = docs.select("doc_id", F.explode(F.array(plain)).alias("plain"), chars)  # a generator's output is computed once
    keys = save(rows.select("doc_id", named, F.sha2("plain", 256).alias("text_sha256")))
    several = keys.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash")
    ids = keys.join(several, "hash", "left_semi").select("doc_id")
    texts = docs.select("doc_id", "text").join(ids.distinct(), "doc_id", "left_semi")
    texts = texts.select("doc_id", plain.alias("plain"), chars)
    shared = save(texts.select("*", named).join(several, "hash", "left_semi"))
    groups = shared.groupBy("hash", "plain").agg(F.count("*").alias("group_size"), _best().alias("best"))
    placed = shared.join(groups, ["hash", "plain"])
    grouped = placed.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", F.sha2("plain", 256).alias("text_sha256"))
    single = keys.join(several, "hash", "left_anti")
    single = single.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    out = single.unionByName(grouped)
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256")
