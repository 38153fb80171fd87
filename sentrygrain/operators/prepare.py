"""Event preparation: ids, de-collision, merging, splits and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BENIGN, DEFAULTS, Config
from ..functions.scoring import micros
from .ranking import first_k, global_row_number, kth_values
from .timeline import assign_chunks, carried_previous


def assign_event_ids(events: DataFrame, *tie: str) -> DataFrame:
    """Reissue ``event_id`` as EVT-%09d in (timestamp, entity_id) order."""
    order = [F.col("timestamp"), F.col("entity_id"), *[F.col(c) for c in tie]]
    numbered = global_row_number(events, order, "_rn")
    return numbered.withColumn("event_id", F.format_string("EVT-%09d", "_rn")).drop("_rn")


def deconflict(events: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """At most one event per (entity, second); later ones move forward.

    In whole seconds the new time is ``i + max(t_j - j)`` over the rows up to i:
    a running maximum instead of repeated passes. Across chunks both the row
    count and the maximum are carried.
    """
    rows = events.withColumn("_at", micros(F.col("timestamp"))).withColumn("_sec", F.floor(F.col("_at") / 1_000_000))
    rows = assign_chunks(rows, ["entity_id"], "_at", config.chunk_rows)
    key = ["entity_id", "chunk"]
    inside = Window.partitionBy(*key).orderBy("_at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumn("_i", F.count(F.lit(1)).over(inside))
    ranked = ranked.withColumn("_lead", F.max(F.col("_sec") - F.col("_i")).over(inside))
    ends = ranked.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.max("_lead").alias("_top"))
    by_chunk = Window.partitionBy("entity_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_before", F.coalesce(F.sum("_n").over(by_chunk), F.lit(0)))
    ends = ends.withColumn("_carry", F.max(F.col("_top") - F.col("_before")).over(by_chunk))
    out = ranked.join(ends.select(*key, "_before", "_carry"), key)
    second = F.col("_i") + F.greatest(F.col("_lead"), F.col("_carry") + F.col("_before"))
    moved = F.when(second == F.col("_sec"), F.col("_at")).otherwise(second * 1_000_000)
    return out.withColumn("timestamp", F.timestamp_micros(moved.cast("bigint"))).select(*events.columns)


def merge_streams(benign: DataFrame, campaigns: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """Union labelled campaign events into the benign stream and reissue ids."""
    merged = deconflict(benign.unionByName(campaigns, allowMissingColumns=True), config)
    return assign_event_ids(merged, "event_id")


def anchors(events: DataFrame, minimum_gap_minutes: float = 90.0, config: Config = DEFAULTS) -> DataFrame:
    """Events followed by a quiet gap; an entity's last event waits for the horizon."""
    rows = events.select("event_id", "entity_id", "latitude", "longitude", micros(F.col("timestamp")).alias("_at"))
    horizon = rows.agg(F.max("_at").alias("_end"))
    rows = assign_chunks(rows, ["entity_id"], "_at", config.chunk_rows)
    rows = carried_previous(rows, ["entity_id"], ["_at", "event_id"], F.col("_at"), "_next", following=True)
    rows = rows.crossJoin(F.broadcast(horizon))  # one row
    gap = (F.coalesce("_next", "_end") - F.col("_at")) / 60e6
    return rows.select("event_id", "entity_id", "latitude", "longitude", gap.alias("next_gap_minutes")).where(
        F.col("next_gap_minutes") >= minimum_gap_minutes
    )


def experienced_entities(
    events: DataFrame, minimum: int = 20, *, entity_type: str | None = None, role: str | None = None
) -> DataFrame:
    """Entities with at least ``minimum`` events; all of them if none qualifies."""
    kept = events
    if entity_type is not None:
        kept = kept.where(F.col("entity_type") == entity_type)
    if role is not None:
        kept = kept.where(F.col("role") == role)
    counted = kept.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_events"))
    qualified = counted.agg(F.coalesce(F.bool_or(F.col("n_events") >= minimum), F.lit(False)).alias("_any"))
    return (
        counted.crossJoin(F.broadcast(qualified))  # one row
        .where((F.col("n_events") >= minimum) | ~F.col("_any"))
        .drop("_any")
    )


def dataset_summary(events: DataFrame) -> DataFrame:
    """Quality summary of an event table, one row.

    Distinct things are folded to small tables first, each with map-side combine;
    several distinct counts in one aggregate would multiply the rows instead.
    """
    n, day = F.count(F.lit(1)), F.to_date("timestamp")
    flags = events.agg(
        n.alias("total_rows"),
        F.date_format(F.min("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("date_min"),
        F.date_format(F.max("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("date_max"),
        (F.date_diff(F.max(day), F.min(day)) + 1).alias("span_days"),
        F.round(1.0 - F.avg(F.col("auth_success").cast("double")), 4).alias("auth_failure_rate"),
        F.count_if(F.col("label") != BENIGN).alias("attack_rows"),
        F.round(F.avg((F.col("label") != BENIGN).cast("double")), 5).alias("attack_prevalence"),
        F.count_if("is_attack").alias("malicious_rows"),
    )
    entities = events.select("entity_id", "entity_type").distinct()
    per_type = entities.agg(
        F.count_distinct("entity_id").alias("unique_entities"),
        F.count_if(F.col("entity_type") == "user").alias("users"),
        F.count_if(F.col("entity_type") == "service_account").alias("service_accounts"),
        F.count_if(F.col("entity_type") == "edge_device").alias("edge_devices"),
    )
    resources = events.select("resource_accessed").distinct().agg(F.count("resource_accessed").alias("distinct_resources"))
    campaigns = events.select("campaign_id").distinct().agg(F.count("campaign_id").alias("campaigns_present"))
    repeats = events.groupBy("entity_id", "timestamp").agg((n - 1).alias("again"))
    repeats = repeats.agg(F.coalesce(F.sum("again"), F.lit(0)).alias("duplicate_entity_timestamps"))
    out = flags
    for one_row in (per_type, resources, campaigns, repeats):
        out = out.crossJoin(one_row)  # one row each
    return out


def label_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def median_events_per_session(events: DataFrame, session: list[str]) -> DataFrame:
    """Median of the event counts per session, weighted over distinct counts."""
    sizes = events.groupBy(*session).agg(F.count(F.lit(1)).alias("size"))
    spread = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n_sessions"))
    return spread.agg(
        F.expr("percentile(size, 0.5, n_sessions)").alias("median_session_events"),
        F.sum("n_sessions").alias("n_sessions"),
    )


def campaign_summary(events: DataFrame, stealth: DataFrame) -> DataFrame:
    """Campaigns, events and stealthy campaigns per attack type, and in total."""
    sizes = events.where("campaign_id is not null").groupBy("campaign_id").agg(F.count(F.lit(1)).alias("n"))
    known = sizes.join(stealth, "campaign_id")
    return (
        known.rollup("attack_type")
        .agg(
            F.count(F.lit(1)).alias("campaigns"),
            F.sum("n").alias("events"),
            F.count_if("stealthy").alias("stealth_campaigns"),
        )
        .withColumn("attack_type", F.coalesce("attack_type", F.lit("TOTAL")))
    )


def cutoff_micros(events: DataFrame, fraction: float = DEFAULTS.train_fraction) -> int:
    """Timestamp of the last training row: row max(1, int(n * fraction)) in order."""
    rank = max(1, int(events.count() * fraction))
    return int(kth_values(events, micros(F.col("timestamp")), [rank])[rank])


def split_column(cutoff: int, timestamp: Column | None = None) -> Column:
    at = micros(F.col("timestamp") if timestamp is None else timestamp)
    return F.when(at <= cutoff, "train").otherwise("evaluation")


def fit_calibration_split(benign_train: DataFrame, fraction: float = DEFAULTS.fit_fraction) -> Column:
    """Predicate for the earlier part of the benign training rows (the fit part)."""
    n = benign_train.count()
    k = max(1, min(n - 1, int(n * fraction)))
    return first_k(benign_train, k, [micros(F.col("timestamp"))], "event_id")
