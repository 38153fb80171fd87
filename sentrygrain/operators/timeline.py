"""Ordered per-key work that splits a hot key over many tasks.

A plain ``Window.partitionBy(entity_id)`` puts one entity's whole history into
one task. Here every timeline is cut into chunks: 28-day periods for ordinary
keys, and row-balanced slices of a period for keys above a row limit. Windows
run inside (key, chunk); one summary row per chunk carries what the next chunk
needs. The carried part is a window over chunk summaries, which is bounded by
rows / chunk_rows plus the number of periods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import stages

PERIOD_US = 28 * 86_400 * 1_000_000
SLOT_US = 60 * 1_000_000


def assign_chunks(
    rows: DataFrame, keys: list[str], at: str, chunk_rows: int, *, source: DataFrame | None = None, fan_out: int = 1
) -> DataFrame:
    """Add ``chunk``, increasing with ``at`` (microseconds) inside each key.

    Counting is one map-side combined aggregate on the key columns; if ``rows``
    is derived with at most ``fan_out`` rows per row of ``source``, the cheaper
    ``source`` is counted. The hot-key
    table holds at most rows / chunk_rows keys, so broadcasting it is bounded by
    construction; the slot table is written first, so that Spark sees its true
    size and picks the join accordingly.
    """
    period = F.floor(F.col(at) / PERIOD_US).cast("bigint")
    shifted = period * F.lit(1 << 32)
    counted = (rows if source is None else source).groupBy(*keys).agg((F.count(F.lit(1)) * fan_out).alias("_n"))
    counted = counted.where(F.col("_n") > chunk_rows)
    hot = stages.save(counted.select(*keys))
    if hot.isEmpty():
        return rows.withColumn("chunk", shifted)
    slot = F.floor(F.col(at) / SLOT_US).cast("bigint")
    slotted = rows.withColumn("_slot", slot)
    counts = (
        slotted.join(F.broadcast(hot), keys, "left_semi").groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    )
    # Per hot key one row per minute of its life: bounded by the calendar.
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.select(
        *keys, "_slot", F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / chunk_rows).alias("_part")
    )
    joined = slotted.join(stages.save(parts), [*keys, "_slot"], "left")
    return joined.withColumn("chunk", shifted + F.coalesce("_part", F.lit(0))).drop("_slot", "_part")


def carried_previous(
    rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str, *, following: bool = False
) -> DataFrame:
    """Add the previous (or following) row's ``value`` per key, across chunks.

    ``rows`` must hold ``chunk``; ``value`` must not be null.
    """
    rows = rows.withColumn("_value", value)
    pick, step = (F.min_by, -1) if following else (F.max_by, 1)
    edge = rows.groupBy(*keys, "chunk").agg(pick("_value", F.struct(*order)).alias("_edge"))
    by_chunk = Window.partitionBy(*keys).orderBy("chunk")
    carry = edge.select(*keys, "chunk", F.lag("_edge", step).over(by_chunk).alias("_carry"))
    inside = Window.partitionBy(*keys, "chunk").orderBy(*order)
    return (
        rows.join(carry, [*keys, "chunk"], "left")
        .withColumn(name, F.coalesce(F.lag("_value", step).over(inside), "_carry"))
        .drop("_value", "_carry")
    )
