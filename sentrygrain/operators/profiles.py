"""Behaviour profiles per entity and per cohort, and their resolution."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BENIGN, DEFAULTS, Config
from ..functions.scoring import micros
from ..sources import stages
from .timeline import assign_chunks, carried_previous

START = "<START>"
KINDS = ("hour", "location", "device", "resource", "auth", "transition")


def location() -> Column:
    return F.concat_ws("|", "country", "city")


def fingerprint() -> Column:
    return F.concat_ws("|", "device_id", "device_mac")


def transition(previous: Column, current: Column | str = "resource_accessed") -> Column:
    return F.concat(F.coalesce(previous, F.lit(START)), F.lit("->"), F.col(current) if isinstance(current, str) else current)


def value_columns(step: Column) -> dict[str, Column]:
    """An event's value of every counted kind; ``step`` is its transition."""
    return {
        "hour": F.hour("timestamp").cast("string"),
        "location": location(),
        "device": fingerprint(),
        "resource": F.col("resource_accessed"),
        "auth": F.col("auth_method"),
        "transition": step,
    }


def fit_rows(events: DataFrame, cutoff: int) -> DataFrame:
    return events.where((micros(F.col("timestamp")) <= cutoff) & (F.col("label") == BENIGN))


def entity_key(config: Config = DEFAULTS) -> Column:
    return F.col("entity_id")


def cohort_key(config: Config = DEFAULTS) -> Column:
    return F.concat_ws("|", *config.cohort_keys)


def with_transitions(rows: DataFrame, key: Column, config: Config = DEFAULTS) -> DataFrame:
    """Add ``key`` and the transition from the key's previous resource.

    A cohort's order interleaves its members, so a cohort is the hottest key
    there is; the chunked timeline splits it.
    """
    keyed = rows.withColumn("key", key).withColumn("_at", micros(F.col("timestamp")))
    chunked = assign_chunks(keyed, ["key"], "_at", config.chunk_rows)
    previous = carried_previous(chunked, ["key"], ["_at", "event_id"], F.col("resource_accessed"), "_previous")
    return previous.withColumn("transition", transition(F.col("_previous"))).drop("_previous", "_at", "chunk")


def count_values(rows: DataFrame) -> DataFrame:
    """Long counts (key, kind, value, n): one map-side combined aggregate."""
    values = value_columns(F.col("transition"))
    pairs = F.array(*[F.struct(F.lit(kind).alias("kind"), values[kind].alias("value")) for kind in KINDS])
    return rows.select("key", F.inline(pairs)).groupBy("key", "kind", "value").agg(F.count(F.lit(1)).alias("n"))


def moments(rows: DataFrame) -> DataFrame:
    """Counts, means and population deviations per key."""
    return rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.avg("session_duration_s").alias("duration_mean"),
        F.stddev_pop("session_duration_s").alias("duration_std"),
        F.avg("bytes_transferred").alias("bytes_mean"),
        F.stddev_pop("bytes_transferred").alias("bytes_std"),
        F.avg((~F.col("auth_success")).cast("double")).alias("auth_failure_rate"),
        F.avg("latitude").alias("baseline_latitude"),
        F.avg("longitude").alias("baseline_longitude"),
        F.count(F.lit(1)).alias("total_transitions"),
    )


def count_maps(counts: DataFrame, config: Config = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Split long counts into one row of maps per key and a table of wide kinds.

    Only kinds with at most ``wide_profile_keys`` values become a map, so a row
    has a bounded size; the others stay rows and are looked up by join.
    """
    sizes = counts.groupBy("key", "kind").agg(F.count(F.lit(1)).alias("n_keys"))
    sized = counts.join(sizes, ["key", "kind"])
    narrow = F.col("n_keys") <= config.wide_profile_keys
    maps = [
        F.map_from_entries(
            F.collect_list(F.when(narrow & (F.col("kind") == kind), F.struct("value", "n")))
        ).alias(f"{kind}_counts")
        for kind in KINDS
    ]
    distinct = [F.max(F.when(F.col("kind") == kind, F.col("n_keys"))).alias(f"{kind}_keys") for kind in KINDS]
    return sized.groupBy("key").agg(*maps, *distinct), sized.where(~narrow).select("key", "kind", "value", "n")


def map_rows(counts: Column, kind: str) -> Column:
    """A count map as an array of (kind, value, n)."""
    return F.transform(
        F.map_entries(counts),
        lambda e: F.struct(F.lit(kind).alias("kind"), e["key"].alias("value"), e["value"].alias("n")),
    )


@dataclass
class Profiles:
    """Fitted profiles: one row per key, plus the wide kinds as rows."""

    entity: DataFrame
    cohort: DataFrame
    wide_entity: DataFrame | None
    wide_cohort: DataFrame | None
    cutoff: int
    #: What the live path has stored of them.
    live: dict = field(default_factory=dict, repr=False, compare=False)


def fit_key(rows: DataFrame, key: Column, config: Config = DEFAULTS) -> tuple[DataFrame, DataFrame | None]:
    """Profiles of all keys, written as a table, and the wide kinds if any."""
    counts = stages.save(count_values(with_transitions(rows, key, config)))
    maps, wide = count_maps(counts, config)
    profile = stages.save(moments(rows.withColumn("key", key)).join(maps, "key"))
    wide = stages.save(wide)
    return profile, None if wide.isEmpty() else wide


def fit_profiles(events: DataFrame, cutoff: int, config: Config = DEFAULTS) -> Profiles:
    rows = fit_rows(events, cutoff)
    entity, wide_entity = fit_key(rows, entity_key(config), config)
    cohort, wide_cohort = fit_key(rows, cohort_key(config), config)
    return Profiles(entity, cohort, wide_entity, wide_cohort, cutoff)


def as_struct(profile: DataFrame, name: str, key: str) -> DataFrame:
    """(key, struct of everything) so that a join adds one column."""
    fields = [c for c in profile.columns if c != "key"]
    return profile.select(F.col("key").alias(key), F.struct("key", *fields).alias(name))


def resolve(personal: Column, cohort: Column, config: Config = DEFAULTS) -> dict[str, Column]:
    """Hard switch between personal and cohort profile, with a confidence."""
    minimum = config.min_events_for_personal
    mature = F.coalesce(personal["n_events"] >= minimum, F.lit(False))
    seen = F.coalesce(personal["n_events"], F.lit(0))
    return {
        "profile": F.when(mature, personal).when(cohort.isNotNull(), cohort).otherwise(personal),
        "profile_source": F.when(mature, "entity").when(cohort.isNotNull(), "cohort").otherwise("none"),
        "profile_confidence": F.when(mature, 1.0)
        .when(cohort.isNotNull(), F.least(F.lit(1.0), seen / minimum))
        .otherwise(0.0),
    }


def join_profiles(events: DataFrame, profiles: Profiles, config: Config = DEFAULTS) -> DataFrame:
    """Events with their resolved ``profile``, source and confidence."""
    personal = as_struct(profiles.entity, "_personal", "entity_id")
    cohort = as_struct(profiles.cohort, "_cohort", "_cohort_key")
    joined = events.join(personal, "entity_id", "left").withColumn("_cohort_key", cohort_key(config))
    joined = joined.join(cohort, "_cohort_key", "left")
    resolved = resolve(F.col("_personal"), F.col("_cohort"), config)
    return joined.withColumns(resolved).drop("_personal", "_cohort", "_cohort_key")
