"""Adaptive profiles: risk-gated, exponentially decayed, in closed form.

Replaying events one by one decays every count at every event. The same final
state is a weighted sum: a value seen at t_i counts 2^-((t_n - t_i)/H) when the
entity's last accepted event is at t_n. Sums are first taken per period with
map-side combine, so a hot entity or value shuffles a few partial rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BENIGN, DEFAULTS, INSIDER, MALICIOUS, Config
from ..contracts import ContractError
from ..functions.scoring import micros
from ..sources import stages
from .profiles import KINDS, Profiles, as_struct, cohort_key, map_rows, transition, value_columns
from .risk import decaying_state
from .timeline import assign_chunks, carried_previous

def half_life_us(config: Config) -> float:
    if config.ewma_halflife_days <= 0:
        raise ValueError("the half-life must be positive")
    return config.ewma_halflife_days * 86_400e6


def gate(events: DataFrame, risk: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """Events with ``risk_score`` and ``accepted``; every event needs a score.

    The joined table is written once: it is checked for missing scores and then
    read by every later step.
    """
    joined = stages.save(events.join(risk.select("event_id", "risk_score"), "event_id", "left"))
    if not joined.where("risk_score is null").isEmpty():
        raise ContractError("every replayed event needs a risk score")
    return joined.withColumn("accepted", F.col("risk_score") < config.baseline_update_max_risk)


def replayed(events: DataFrame, cutoff: int) -> DataFrame:
    """Only events after the profiles' cutoff take part."""
    return events.where(micros(F.col("timestamp")) > cutoff)


def accepted_steps(gated: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """Accepted events with their decay step and the transition they add.

    The first accepted event of an entity has no step (decay 1).
    """
    rows = gated.where("accepted").withColumn("_at", micros(F.col("timestamp")))
    rows = assign_chunks(rows, ["entity_id"], "_at", config.chunk_rows)
    last = F.struct(F.col("_at").alias("at"), F.col("resource_accessed").alias("resource"))
    rows = carried_previous(rows, ["entity_id"], ["_at", "event_id"], last, "_before")
    waited = F.coalesce(F.greatest(F.lit(0), F.col("_at") - F.col("_before.at")), F.lit(0))
    return rows.withColumns(
        {
            "is_first": F.col("_before").isNull(),
            "step": F.pow(F.lit(0.5), waited / half_life_us(config)),
            "transition": transition(F.col("_before.resource")),
        }
    ).drop("_before")


def spans(steps: DataFrame) -> DataFrame:
    """First and last accepted time and number of updates per entity."""
    return steps.groupBy("entity_id").agg(
        F.min("_at").alias("first_at"), F.max("_at").alias("last_at"), F.count(F.lit(1)).alias("n_updates")
    )


def _period(config: Config) -> Column:
    return F.floor(F.col("_at") / (64 * half_life_us(config))).cast("bigint")


def _period_end(period: Column, config: Config) -> Column:
    return (period + 1) * F.lit(64 * half_life_us(config))


def decayed_sums(
    rows: DataFrame, keys: list[str], sums: dict[str, Column], entity_spans: DataFrame, config: Config = DEFAULTS
) -> DataFrame:
    """Sums of columns weighted by 2^-((last_at - at)/H), per entity and ``keys``."""
    half = half_life_us(config)
    rows = rows.withColumn("_period", _period(config))
    weight = F.pow(F.lit(2.0), (F.col("_at") - _period_end(F.col("_period"), config)) / half)
    partial = rows.groupBy("entity_id", "_period", *keys).agg(*[F.sum(c * weight).alias(n) for n, c in sums.items()])
    joined = partial.join(entity_spans, "entity_id")
    fade = F.pow(F.lit(2.0), (_period_end(F.col("_period"), config) - F.col("last_at")) / half)
    return joined.groupBy("entity_id", *keys).agg(*[F.sum(F.col(n) * fade).alias(n) for n in sums])


def seeds(gated: DataFrame, profiles: Profiles, config: Config = DEFAULTS) -> DataFrame:
    """Starting profile per entity: its own, a clone of its cohort's, or zeros."""
    first = F.min_by(
        F.struct("latitude", "longitude", cohort_key(config).alias("cohort")), F.struct("timestamp", "event_id")
    )
    entities = gated.where("accepted").groupBy("entity_id").agg(first.alias("first"))
    rows = entities.select("entity_id", "first", F.col("first.cohort").alias("_cohort"))
    own = as_struct(profiles.entity, "own", "entity_id")
    cohort = as_struct(profiles.cohort, "of_cohort", "_cohort")
    rows = rows.join(own, "entity_id", "left").join(cohort, "_cohort", "left")
    return rows.select(
        "entity_id",
        F.coalesce("own", "of_cohort").alias("seed"),
        F.when(F.col("own").isNotNull(), "entity").when(F.col("of_cohort").isNotNull(), "cohort").otherwise("empty").alias("seeded_from"),
        F.col("first.latitude").alias("first_latitude"),
        F.col("first.longitude").alias("first_longitude"),
    )


def _seed_fade(config: Config) -> Column:
    return F.pow(F.lit(2.0), -(F.col("last_at") - F.col("first_at")) / half_life_us(config))


def decayed_counts(
    steps: DataFrame, seed: DataFrame, profiles: Profiles, config: Config = DEFAULTS
) -> DataFrame:
    """Long adaptive counts (entity_id, kind, value, ewma_count)."""
    span = spans(steps)
    values = value_columns(F.col("transition"))
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in values.items()])
    observed = steps.select("entity_id", "_at", F.inline(pairs))
    fresh = decayed_sums(observed, ["kind", "value"], {"c": F.lit(1.0)}, span, config)
    empty = F.create_map().cast("map<string,bigint>")
    maps = [map_rows(F.coalesce(F.col("seed")[f"{kind}_counts"], empty), kind) for kind in KINDS]
    old = seed.select("entity_id", F.inline(F.flatten(F.array(*maps))))
    wide = [t for t in (profiles.wide_entity, profiles.wide_cohort) if t is not None]
    for table in wide:
        keyed = seed.select("entity_id", F.col("seed.key").alias("key"))
        old = old.unionByName(keyed.join(table, "key").select("entity_id", "kind", "value", "n"))
    faded = old.join(span, "entity_id").select(
        "entity_id", "kind", "value", (F.col("n") * _seed_fade(config)).alias("c")
    )
    both = faded.unionByName(fresh).groupBy("entity_id", "kind", "value").agg(F.sum("c").alias("ewma_count"))
    return both.where("ewma_count > 1e-12")


def decayed_moments(steps: DataFrame, seed: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """Adaptive totals, means, variances, failure rate and baseline per entity.

    A mean moves by (1 - d) * v at each accepted event; its second moment grows
    by (1 - d) * d * (v - mean before)^2, which needs the running mean only.
    """
    values = {
        "duration": F.col("session_duration_s"),
        "bytes": F.col("bytes_transferred"),
        "failure": (~F.col("auth_success")).cast("double"),
        "latitude": F.col("latitude"),
        "longitude": F.col("longitude"),
    }
    firsts = steps.where("is_first").select(
        "entity_id", F.col("session_duration_s").alias("_v_duration"), F.col("bytes_transferred").alias("_v_bytes")
    )
    start = seed.join(firsts, "entity_id", "left")
    seeded = F.col("seed").isNotNull()
    s = lambda field, empty: F.when(seeded, F.col("seed")[field]).otherwise(empty)
    base = start.select(
        "entity_id",
        s("n_events", 0.0).cast("double").alias("n0"),
        s("total_transitions", 0.0).cast("double").alias("transitions0"),
        s("auth_failure_rate", 0.0).alias("failure"),
        s("baseline_latitude", F.col("first_latitude")).alias("latitude"),
        s("baseline_longitude", F.col("first_longitude")).alias("longitude"),
        *[
            column
            for name in ("duration", "bytes")
            for column in (
                s(f"{name}_mean", 0.0).alias(f"{name}_mean0"),
                F.pow(s(f"{name}_std", 1.0), 2).alias(f"{name}_m2"),
                F.col(f"_v_{name}"),
            )
        ],
    )
    # A mean and a second moment of exactly zero adopt the first value.
    base = base.withColumns(
        {
            name: F.when(
                (F.col(f"{name}_mean0") == 0) & (F.col(f"{name}_m2") == 0), F.col(f"_v_{name}")
            ).otherwise(F.col(f"{name}_mean0"))
            for name in ("duration", "bytes")
        }
    )
    moving = steps.withColumns({f"_x_{n}": (1.0 - F.col("step")) * v for n, v in values.items()})
    track = {n: f"_x_{n}" for n in ("duration", "bytes")}
    moving = decaying_state(moving, track, half_life_us(config), initial=base.select("entity_id", "duration", "bytes"))
    moving = moving.withColumn("_at", micros(F.col("timestamp")))
    growth = (1.0 - F.col("step")) * F.col("step")
    span = spans(steps)
    sums = {"n": F.lit(1.0)} | {n: F.col(f"_x_{n}") for n in values}
    for name in ("duration", "bytes"):
        sums[f"{name}_m2"] = growth * F.pow(values[name] - F.col(f"{name}_before"), 2)
    fresh = decayed_sums(moving, [], sums, span, config)
    fresh = fresh.withColumnsRenamed({c: f"_f_{c}" for c in sums})
    rows = base.join(fresh, "entity_id").join(span, "entity_id")
    fade = _seed_fade(config)
    total = lambda start, c: (F.col(start) * fade + F.col(f"_f_{c}"))
    return rows.select(
        "entity_id",
        "n_updates",
        "last_at",
        total("n0", "n").alias("n_events"),
        total("transitions0", "n").alias("total_transitions"),
        total("duration", "duration").alias("duration_mean"),
        F.greatest(F.lit(0.0), total("duration_m2", "duration_m2")).alias("duration_m2"),
        total("bytes", "bytes").alias("bytes_mean"),
        F.greatest(F.lit(0.0), total("bytes_m2", "bytes_m2")).alias("bytes_m2"),
        total("failure", "failure").alias("auth_failure_rate"),
        total("latitude", "latitude").alias("baseline_latitude"),
        total("longitude", "longitude").alias("baseline_longitude"),
    )


def snapshot(counts: DataFrame, totals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profiles as the feature code reads them: whole counts, deviations.

    A count that rounds to 0 keeps its key: the value is known, just faded.
    """
    whole = counts.withColumn("n", F.bround("ewma_count", 0).cast("bigint")).drop("ewma_count")
    rounded = {c: F.bround(c, 0).cast("bigint") for c in ("n_events", "total_transitions")}
    deviations = {f"{c}_std": F.sqrt(f"{c}_m2") for c in ("duration", "bytes")}
    return whole, totals.withColumns(rounded | deviations).drop("duration_m2", "bytes_m2")


def evaluate(gated: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """Gate counts and rates, poisoning resistance and adaptation, one row."""
    label, blocked = F.col("label"), ~F.col("accepted")
    high = F.col("risk_score") >= config.baseline_update_max_risk
    bad, insider, benign = label.isin(*MALICIOUS), label == INSIDER, label == BENIGN
    n = F.count_if
    counts = gated.agg(
        F.count(F.lit(1)).alias("n_considered"),
        n(~blocked).alias("n_updated"),
        n(blocked).alias("n_blocked"),
        n(high).alias("high_risk_events"),
        n(high & blocked).alias("high_risk_blocked"),
        n(bad).alias("malicious_events"),
        n(bad & blocked).alias("malicious_blocked"),
        n(bad & high).alias("malicious_high_risk"),
        n(bad & high & blocked).alias("malicious_high_risk_blocked"),
        n(benign & ~high).alias("low_risk_benign"),
        n(benign & ~high & ~blocked).alias("low_risk_benign_updated"),
        n(insider).alias("insider_drift_events"),
        n(insider & ~blocked).alias("insider_drift_updated"),
        n(insider & blocked).alias("insider_drift_blocked"),
        n(insider & ~high).alias("insider_low_risk"),
        n(insider & ~high & ~blocked).alias("insider_low_risk_updated"),
        n(high != blocked).alias("gate_disagreements"),
    )
    rate = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return counts.withColumns(
        {
            "update_rate": rate("n_updated", "n_considered"),
            "block_rate": rate("n_blocked", "n_considered"),
            "high_risk_block_rate": rate("high_risk_blocked", "high_risk_events"),
            "malicious_block_rate": rate("malicious_blocked", "malicious_events"),
            "malicious_high_risk_block_rate": rate("malicious_high_risk_blocked", "malicious_high_risk"),
            "low_risk_benign_update_rate": rate("low_risk_benign_updated", "low_risk_benign"),
            "insider_drift_update_rate": rate("insider_drift_updated", "insider_drift_events"),
            "insider_drift_low_risk_update_rate": rate("insider_low_risk_updated", "insider_low_risk"),
        }
    )


def insider_exhibits(gated: DataFrame, counts: DataFrame, top: int = 5) -> DataFrame:
    """Entities with insider drift: gate counts, mean risk, top decayed resources."""
    insiders = (
        gated.where(F.col("label") == INSIDER)
        .groupBy("entity_id")
        .agg(
            F.count(F.lit(1)).alias("n_insider_events"),
            F.count_if("accepted").alias("n_updated"),
            F.count_if(~F.col("accepted")).alias("n_blocked"),
            F.avg("risk_score").alias("mean_risk"),
        )
    )
    from .topk import top_per_key

    resources = counts.where("kind = 'resource'").join(insiders.select("entity_id"), "entity_id", "left_semi")
    # Sums differ in the last digits with the order of addition; ties must not.
    order = [F.round("ewma_count", 9).desc(), F.asc("value")]
    best = top_per_key(resources, ["entity_id"], order, top, "rank")
    return insiders.join(best.select("entity_id", "rank", F.col("value").alias("resource"), "ewma_count"), "entity_id")
