"""Links between items that share buckets, and their connected components.

Candidates are star shaped: within a bucket, members are compared with a hub,
so pairs grow with the members as long as these hang together. Afterwards buckets that
still hold several components draw other hubs, with which members of other components
are compared, until no pair of two components of a bucket is left; where a bucket's members
are not linked, that is every pair of them. Everything is aggregation and joins that Spark
can split; nothing of a bucket or component is gathered in one place.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stages import save


def _digest(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64(*df.columns)), F.sum(F.hash(*df.columns))).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every linked id; the component is its smallest id.

    ``edges`` has columns ``a`` and ``b`` in any order and may repeat rows. Each
    round hangs larger neighbours below the smallest one, then smaller ones.
    """
    edges = save(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = _digest(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = save(large.filter("a <> b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select("a", F.col("m").alias("b")).union(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = save(small.distinct())
        after = _digest(edges)
        if after == before:
            break
        before = after
    own = edges.select(F.col("b").alias("a"), "b")
    return edges.union(own).groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))


def linked(
    buckets: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    hubs: int = 8,
    marks: DataFrame | None = None,
    may: Callable[[str, str], Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Links (a, b), a > b, and (id, component) of every id that shares a bucket.

    ``buckets`` has (bucket, id). ``verify`` takes pairs (a, b) and returns those that are linked.
    Two members of a bucket that are linked always come to one component: a bucket is done when its
    members are in one component, or when every pair of them in different ones has been compared.
    A turn joins the components that its new links touch and leaves the others as they are.
    After the first turn, with one hub, a bucket draws ``hubs`` hubs and then each turn four times as many.
    A hub was compared with all members and leaves its bucket. Joins on a large bucket can be split by Spark.
    ``marks`` has (id, mark) of every id, and ``may`` is false of two marks only if their ids cannot be linked;
    such pairs count as compared and go no further than the join. Then each turn draws 16 times as many hubs.
    """
    # written, so that Spark knows how few they are when it chooses the join
    stars = save(buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("hub")).filter("n > 1"))
    members = buckets.join(stars, "bucket").filter("id <> hub")
    place = F.pmod(F.xxhash64("bucket", "id"), F.col("n") - 1)
    members = save(members.select("bucket", "id", "hub", place.alias("place")))
    tried = save(members.select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct())
    links = save(verify(tried))
    found = components(links)
    placed = members.select("id").union(members.select("hub")).distinct().join(found, "id", "left")
    placed = save(placed.select("id", F.coalesce("component", "id").alias("component")))
    reach = 0
    for turn in count():
        # places below ``reach`` were hubs; every place is below the bucket's members
        here = members.filter(F.col("place") >= reach).select("bucket", "id", "place").join(placed, "id")
        mixed = here.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
        members = save(here.join(mixed.select("bucket"), "bucket", "left_semi"))
        if members.isEmpty():
            return links, placed
        reach += hubs * (4 if marks is None else 16) ** turn
        held = members if marks is None else members.join(marks.select("id", "mark"), "id")
        drawn = held.filter(F.col("place") < reach).withColumnsRenamed({"id": "hub", "component": "of", "mark": "hub_mark"}).drop("place")
        pairs = held.join(drawn, "bucket").filter("component <> of").filter((F.col("place") >= reach) | (F.col("id") > F.col("hub")))
        if may is not None:
            pairs = pairs.filter(may("mark", "hub_mark"))
        pairs = pairs.select(F.greatest("id", "hub").alias("a"), F.least("id", "hub").alias("b")).distinct()
        fresh = save(pairs.join(tried, ["a", "b"], "left_anti"))
        if fresh.isEmpty():
            continue
        tried = tried.union(fresh)  # both are written; a turn adds its own pairs only
        more = save(verify(fresh))
        if more.isEmpty():
            continue
        links = links.union(more)
        ends = more
        for side in "ab":
            ends = ends.join(placed.select(F.col("id").alias(side), F.col("component").alias(f"of_{side}")), side)
        merged = components(ends.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))
        merged = merged.select(F.col("id").alias("component"), F.col("component").alias("into"))
        placed = placed.join(merged, "component", "left").select("id", F.coalesce("into", "component").alias("component"))
        placed = save(placed)
