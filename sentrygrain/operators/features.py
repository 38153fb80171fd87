"""The 28 causal features of an event.

One timeline per entity carries three kinds of marks: the events, the moments at
which an event leaves a trailing window, and the moments at which a resource
enters or leaves the 24-hour breadth. Trailing counts are then running sums, so
a row costs O(1) however dense the window is, and one exchange on
(entity_id, chunk) serves every feature and the profile lookup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, FEATURES, Config
from ..functions.geo import haversine_km, velocity_kmh
from ..functions.scoring import micros, rarity, zscore
from ..sources import stages
from .profiles import KINDS, Profiles, as_struct, cohort_key, fingerprint, resolve, transition, value_columns
from .timeline import assign_chunks

HOUR_US = 3_600_000_000
STEPS = ("_d_count_a", "_d_count_b", "_d_fail_a", "_d_fail_b", "_d_breadth")
IDENTITY = ("event_id", "timestamp", "entity_id", "entity_type", "role")


def _marks(at: Column, tie: int, seq: Column, kind: int, **steps: Column) -> Column:
    return F.struct(
        at.cast("bigint").alias("_at"),
        F.lit(tie).alias("_tie"),
        seq.alias("_seq"),
        F.lit(kind).alias("_kind"),
        *[steps.get(s, F.lit(0)).cast("bigint").alias(s) for s in STEPS],
    )


def _breadth_marks(rows: DataFrame, window_us: int) -> DataFrame:
    """Where a resource starts and stops being among the recent ones.

    Occurrences are first folded to one row per (entity, resource, hour) with
    map-side combine; inside an hour only the first and last can matter.
    """
    slots = rows.groupBy("entity_id", "resource_accessed", F.floor(F.col("_at") / HOUR_US).alias("_slot")).agg(
        F.min(F.struct("_at", "event_id")).alias("first"), F.max("_at").alias("last")
    )
    order = Window.partitionBy("entity_id", "resource_accessed").orderBy("_slot")
    gap_before = F.col("first._at") - F.lag("last").over(order)
    gap_after = F.lead("first._at").over(order) - F.col("last")
    opens = F.coalesce(gap_before > window_us, F.lit(True))
    closes = F.coalesce(gap_after > window_us, F.lit(True))
    runs = slots.select("entity_id", "first", "last", opens.alias("opens"), closes.alias("closes"))
    pair = F.array(
        F.when(F.col("opens"), _marks(F.col("first._at"), 0, F.col("first.event_id"), 1, _d_breadth=F.lit(1))),
        F.when(F.col("closes"), _marks(F.col("last") + window_us, 1, F.lit(""), 2, _d_breadth=F.lit(-1))),
    )
    return runs.select("entity_id", F.inline(F.array_compact(pair)))


def timeline_features(events: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """Events with trailing counts, breadth and the previous event, plus ``chunk``."""
    rows, order, sums, previous = _timeline(events, config)
    return _finish(rows, _carry(rows, sums), order, sums, previous).drop("_carry_profile")


def _timeline(events: DataFrame, config: Config):
    rows = events.withColumn("_at", micros(F.col("timestamp")))
    failed = (~F.col("auth_success")).cast("bigint")
    one = F.lit(1)
    event_marks = _marks(
        F.col("_at"), 0, F.col("event_id"), 0, _d_count_a=one, _d_count_b=one, _d_fail_a=failed, _d_fail_b=failed
    )
    marked = rows.withColumn("_mark", event_marks).select(*events.columns, "_mark.*")
    # Windows of equal width share one leaving mark.
    leaving: dict[int, dict[str, Column]] = {}
    for name, width, step in (
        ("_d_count_a", config.count_windows_s[0], -one),
        ("_d_count_b", config.count_windows_s[1], -one),
        ("_d_fail_a", config.failed_windows_s[0], -F.col("_failed")),
        ("_d_fail_b", config.failed_windows_s[1], -F.col("_failed")),
    ):
        leaving.setdefault(width, {})[name] = step
    slim = rows.select("entity_id", "_at", failed.alias("_failed"))
    moments = []
    for width, steps in leaving.items():
        mark = _marks(F.col("_at") + width * 1_000_000, 1, F.lit(""), 2, **steps)
        only_failed = not any(name.startswith("_d_count") for name in steps)
        moments.append(F.when(F.col("_failed") == 1, mark) if only_failed else mark)
    leaves = slim.select("entity_id", F.inline(F.array_compact(F.array(*moments))))
    breadth = _breadth_marks(
        rows.select("entity_id", "event_id", "resource_accessed", "_at"), config.breadth_window_s * 1_000_000
    )
    timeline = marked.unionByName(leaves, allowMissingColumns=True).unionByName(breadth, allowMissingColumns=True)
    previous = F.struct(
        F.col("_at").alias("at"), "latitude", "longitude", fingerprint().alias("fp"), F.col("resource_accessed").alias("resource")
    )
    # Per event: itself, one mark per window width, two for the breadth.
    chunked = assign_chunks(
        timeline, ["entity_id"], "_at", config.chunk_rows, source=events, fan_out=3 + len(leaving)
    )
    return chunked, ["_at", "_tie", "_seq", "_kind"], STEPS, F.when(F.col("_kind") == 0, previous)


def _carry(timeline: DataFrame, sums) -> DataFrame:
    """Per chunk: totals and last event of everything before it."""
    last = F.struct(
        F.col("_at").alias("at"), "latitude", "longitude", fingerprint().alias("fp"), F.col("resource_accessed").alias("resource")
    )
    per_chunk = timeline.groupBy("entity_id", "chunk").agg(
        *[F.sum(s).alias(s) for s in sums],
        F.max(F.when(F.col("_kind") == 0, F.struct("_at", "_seq", last.alias("last")))).alias("_edge"),
    )
    before = Window.partitionBy("entity_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return per_chunk.select(
        "entity_id",
        "chunk",
        *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_c{s}") for s in sums],
        F.last("_edge.last", ignorenulls=True).over(before).alias("_carry_last"),
    )


def _finish(timeline: DataFrame, carry: DataFrame, order, sums, previous: Column) -> DataFrame:
    inside = Window.partitionBy("entity_id", "chunk").orderBy(*order)
    upto, earlier = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    run = timeline.withColumns(
        {f"_r{s}": F.sum(s).over(upto) - F.col(s) for s in sums}
        | {"_last": F.last(previous, ignorenulls=True).over(earlier)}
    ).where("_kind = 0")
    joined = run.join(carry, ["entity_id", "chunk"], "left")
    total = lambda s: (F.col(f"_r{s}") + F.col(f"_c{s}")).cast("double")
    out = joined.withColumns(
        {
            "event_count_5m": total("_d_count_a"),
            "event_count_60m": total("_d_count_b"),
            "failed_auth_5m": total("_d_fail_a"),
            "failed_auth_30m": total("_d_fail_b"),
            "recent_resource_breadth_24h": total("_d_breadth"),
            "_prev": F.coalesce("_last", "_carry_last"),
        }
    )
    unused = [f"{p}{s}" for s in sums for p in ("", "_r", "_c")]
    return out.drop("_last", "_carry_last", "_tie", "_seq", "_kind", *unused)


def _lookup(kind: str, value: Column, profile: Column, wide: Column | None) -> Column:
    """Count of ``value`` in the profile's map (0 if absent), null map safe."""
    count = F.try_element_at(profile[f"{kind}_counts"], value)
    return count if wide is None else F.coalesce(wide, count)


def profile_features(
    rows: DataFrame, sensitivity: Column, config: Config = DEFAULTS, wide: bool = False
) -> DataFrame:
    """Columns that compare an event with its resolved ``profile``.

    ``rows`` holds the event, ``_prev`` and ``profile``; without any profile the
    event's own values stand in for the baseline.
    """
    profile, prev = F.col("profile"), F.col("_prev")
    n_events = F.coalesce(profile["n_events"], F.lit(0))
    total = F.coalesce(profile["total_transitions"], F.lit(0))
    values = value_columns(transition(prev["resource"]))
    found = {k: _lookup(k, v, profile, F.col(f"_wide_{k}") if wide else None) for k, v in values.items()}
    rows = rows.withColumns({f"_n_{k}": F.coalesce(found[k], F.lit(0)) for k in KINDS})
    # A key may be known with a rounded count of 0, so presence is its own fact.
    rows = rows.withColumns({f"_k_{k}": found[k].isNotNull() for k in ("location", "device", "resource")})
    rar = lambda k: rarity(
        F.col(f"_n_{k}"), n_events, F.coalesce(profile[f"{k}_keys"], F.lit(0)), config.smoothing
    )
    own = lambda field, column: F.coalesce(profile[field], F.col(column))
    std = lambda field: F.coalesce(profile[field], F.lit(1.0))
    failed = (~F.col("auth_success")).cast("double")
    gap = F.when(prev.isNotNull(), (micros(F.col("timestamp")) - prev["at"]) / 1e6).otherwise(0.0)
    moved = haversine_km(prev["latitude"], prev["longitude"], F.col("latitude"), F.col("longitude"))
    from_previous = F.when(prev.isNotNull(), moved).otherwise(0.0)
    weekday = F.weekday("timestamp")
    probability = (F.col("_n_transition") + config.smoothing) / (
        total + config.smoothing * (F.coalesce(profile["transition_keys"], F.lit(0)) + 1)
    )
    rows = rows.withColumns(
        {
            "hour": F.hour("timestamp").cast("double"),
            "day_of_week": weekday.cast("double"),
            "is_weekend": (weekday >= 5).cast("double"),
            "inter_event_gap_s": gap,
            "login_hour_rarity": rar("hour"),
            "is_entity_off_hours": (F.col("_n_hour") == 0).cast("double"),
            "location_rarity": rar("location"),
            "is_new_location": (~F.col("_k_location")).cast("double"),
            "geo_distance_from_baseline_km": haversine_km(
                own("baseline_latitude", "latitude"),
                own("baseline_longitude", "longitude"),
                F.col("latitude"),
                F.col("longitude"),
            ),
            "geo_distance_from_previous_km": from_previous,
            "is_known_device": F.col("_k_device").cast("double"),
            "device_rarity": rar("device"),
            "fingerprint_changed": F.coalesce(prev["fp"] != fingerprint(), F.lit(False)).cast("double"),
            "is_known_resource": F.col("_k_resource").cast("double"),
            "resource_rarity": rar("resource"),
            "resource_sensitivity": F.coalesce(sensitivity, F.lit(1.0)),
            "auth_method_rarity": rar("auth"),
            "auth_failure_deviation": failed - F.coalesce(profile["auth_failure_rate"], F.lit(0.0)),
            "session_duration_zscore": zscore(
                F.col("session_duration_s"), own("duration_mean", "session_duration_s"), std("duration_std"), config.std_floor
            ),
            "transfer_volume_zscore": zscore(
                F.col("bytes_transferred"), own("bytes_mean", "bytes_transferred"), std("bytes_std"), config.std_floor
            ),
            "transition_probability": probability,
        }
    )
    speed = velocity_kmh(F.col("geo_distance_from_previous_km"), F.col("inter_event_gap_s"), config.velocity_cap_kmh)
    return rows.withColumns(
        {
            "geo_velocity_kmh": F.when(prev.isNotNull(), speed).otherwise(0.0),
            "sequence_anomaly_score": -F.ln("transition_probability"),
        }
    )


def _join_wide(rows: DataFrame, profiles: Profiles, config: Config = DEFAULTS) -> DataFrame:
    """Counts of kinds too wide for a map, one equi-join on (key, value) each.

    ``rows`` holds ``_own_events``, the size of the entity's own profile, instead of the profiles: their maps are larger
    than an event, and these joins may shuffle it. The key is the one that :func:`~.profiles.resolve` will choose.
    """
    cohorts = profiles.cohort.select(F.col("key").alias("_cohort_key"), F.lit(True).alias("_has_cohort"))
    rows = rows.join(cohorts, "_cohort_key", "left")
    own = F.col("_own_events")
    key = (
        F.when(own >= config.min_events_for_personal, F.col("entity_id"))
        .when(F.col("_has_cohort"), F.col("_cohort_key"))
        .when(own.isNotNull(), F.col("entity_id"))
    )
    tables = [t for t in (profiles.wide_entity, profiles.wide_cohort) if t is not None]
    counts = tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1])
    values = value_columns(transition(F.col("_prev")["resource"]))
    kinds = {r.kind for r in counts.select("kind").distinct().collect()}  # at most six kinds
    for kind, value in values.items():
        if kind not in kinds:
            rows = rows.withColumn(f"_wide_{kind}", F.lit(None).cast("bigint"))
            continue
        table = counts.where(F.col("kind") == kind).select(
            F.col("key").alias("_wide_key"), F.col("value").alias("_wide_value"), F.col("n").alias(f"_wide_{kind}")
        )
        rows = rows.withColumn("_wide_key", key).withColumn("_wide_value", value)
        rows = rows.join(table, ["_wide_key", "_wide_value"], "left").drop("_wide_key", "_wide_value")
    return rows


def build_features(
    events: DataFrame,
    profiles: Profiles,
    sensitivity: Column | None = None,
    config: Config = DEFAULTS,
    *,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Identity, 28 features, profile source, confidence, split and ``chunk``.

    Personal profiles ride on the per-chunk carry, so looking them up costs no
    exchange of the events. Cohort profiles are a table of a few rows; Spark
    picks the join from its written size. With wide kinds the profiles come
    after the joins with these, so that no exchange moves a profile per event.
    """
    timeline, order, sums, previous = _timeline(events, config)
    carry, personal = _carry(timeline, sums), as_struct(profiles.entity, "_personal", "entity_id")
    wide = profiles.wide_entity is not None or profiles.wide_cohort is not None
    if wide:
        sizes = profiles.entity.select(F.col("key").alias("entity_id"), F.col("n_events").alias("_own_events"))
        carry = stages.save(carry.join(sizes, "entity_id", "left"))
    else:
        carry = carry.join(personal, "entity_id", "left")
    rows = _finish(timeline, carry, order, sums, previous).withColumn("_cohort_key", cohort_key(config))
    if wide:
        rows = _join_wide(rows, profiles, config)
        held = carry.select("entity_id", "chunk").join(personal, "entity_id")
        rows = rows.join(held, ["entity_id", "chunk"], "left")
    rows = rows.join(as_struct(profiles.cohort, "_cohort", "_cohort_key"), "_cohort_key", "left")
    rows = rows.withColumns(resolve(F.col("_personal"), F.col("_cohort"), config))
    rows = profile_features(rows, F.lit(1.0) if sensitivity is None else sensitivity, config, wide)
    split = F.when(F.col("_at") <= profiles.cutoff, "train").otherwise("evaluation").alias("split")
    return rows.select(*IDENTITY, *FEATURES, "profile_source", "profile_confidence", split, "chunk", *keep)


def sensitivity_from_catalog(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """Add ``resource_sensitivity`` from a (resource_accessed, level) dimension."""
    from ..config import SENSITIVITY

    levels = F.create_map(*[F.lit(x) for kv in SENSITIVITY.items() for x in kv])
    ranked = catalog.select("resource_accessed", F.try_element_at(levels, "level").alias("resource_sensitivity"))
    joined = events.join(ranked, "resource_accessed", "left")
    return joined.withColumn("resource_sensitivity", F.coalesce("resource_sensitivity", F.lit(1.0)))
