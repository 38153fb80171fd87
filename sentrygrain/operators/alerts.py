"""Alerts: severity gate, cooldown with escalation, enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, SEVERITIES, Config
from ..functions.scoring import micros, severity_rank
from ..sources import stages
from .ranking import global_row_number
from .risk import reasons_text
from .timeline import assign_chunks


def candidates(scored: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """Events severe enough to page: (entity_id, event_id, at, rank)."""
    rank = severity_rank(F.col("risk_severity"))
    gate = SEVERITIES.index(config.risk.min_severity) + 1
    return scored.where(rank >= gate).select(
        "entity_id", "event_id", micros(F.col("timestamp")).alias("at"), rank.alias("rank")
    )


def emitted(pages: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """event_ids that open an alert; all other candidates are suppressed.

    Each candidate points to the one that would follow it as an alert, and the
    chain from the entity's first candidate is marked by doubling those
    pointers, so an entity's candidates are never gathered.
    """
    return _chain(pages, config)


def _successors(pages: DataFrame, config: Config) -> DataFrame:
    """(event_id, next_id): the alert that follows if this candidate opens one."""
    cooldown_us = int(config.risk.cooldown_seconds * 1e6)
    here = F.struct("at", "event_id")
    rows = pages.select("entity_id", "at", F.lit(1).alias("after"), "event_id", "rank", here.alias("page"))
    # A probe sits right before the candidates at the end of the cooldown.
    probes = pages.select(
        "entity_id", (F.col("at") + cooldown_us).alias("at"), F.lit(0).alias("after"), "event_id", F.lit(0).alias("rank")
    )
    line = rows.unionByName(probes, allowMissingColumns=True)
    line = assign_chunks(line, ["entity_id"], "at", config.chunk_rows, source=pages, fan_out=2)
    levels = range(0, len(SEVERITIES)) if config.risk.escalation_bypasses_cooldown else (0,)
    above = {r: F.when(F.col("rank") > r, F.col("page")) for r in levels}
    per_chunk = line.groupBy("entity_id", "chunk").agg(*[F.min(c).alias(f"_first_{r}") for r, c in above.items()])
    later = Window.partitionBy("entity_id").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    carry = per_chunk.select(
        "entity_id", "chunk", *[F.last(f"_first_{r}", ignorenulls=True).over(later).alias(f"_carry_{r}") for r in above]
    )
    backwards = Window.partitionBy("entity_id", "chunk").orderBy(F.desc("at"), F.desc("after"), F.desc("event_id"))
    behind = backwards.rowsBetween(Window.unboundedPreceding, -1)
    line = line.withColumns({f"_next_{r}": F.last(c, ignorenulls=True).over(behind) for r, c in above.items()})
    line = line.join(carry, ["entity_id", "chunk"])
    following = F.coalesce("_next_0", "_carry_0")
    answer = F.when(F.col("after") == 0, following)
    for r in levels:
        if r:
            answer = F.when(
                (F.col("after") == 1) & (F.col("rank") == r), F.coalesce(f"_next_{r}", f"_carry_{r}")
            ).otherwise(answer)
    return line.groupBy("event_id").agg(F.min(answer).alias("next")).select("event_id", F.col("next.event_id").alias("next_id"))


def _chain(pages: DataFrame, config: Config) -> DataFrame:
    """Mark the alerts reachable from each entity's first candidate."""
    jump = stages.save(_successors(pages, config).where("next_id is not null"))
    first = pages.groupBy("entity_id").agg(F.min(F.struct("at", "event_id")).alias("page"))
    reached = stages.save(first.select(F.col("page.event_id").alias("event_id")))
    while True:
        # Round r marks the alerts 2^r .. 2^(r+1)-1 of every chain.
        fresh = stages.save(reached.join(jump, "event_id").select(F.col("next_id").alias("event_id")))
        if fresh.isEmpty():
            return reached
        reached = stages.save(reached.unionByName(fresh))
        onward = jump.select(F.col("event_id").alias("next_id"), F.col("next_id").alias("_to"))
        jump = stages.save(jump.join(onward, "next_id").select("event_id", F.col("_to").alias("next_id")))


def build_alerts(
    scored: DataFrame, classes: DataFrame | None = None, config: Config = DEFAULTS, checks: stages.Checks | None = None
) -> tuple[DataFrame, DataFrame]:
    """(alerts, one row with ``n_candidates``, ``n_alerts``, ``n_suppressed``).

    With ``checks`` the write of the alerts refuses events with several predictions.
    """
    pages = candidates(scored, config)
    opened = stages.save(emitted(pages, config))
    rows = scored.join(opened, "event_id", "left_semi")
    numbered = global_row_number(rows, [F.col("timestamp"), F.col("event_id")], "_rn")
    alert_id = F.format_string(
        "ALT-%s-%s-%05d", "entity_id", F.date_format("timestamp", "yyyyMMdd'T'HHmmss"), F.col("_rn") - 1
    )
    alerts = numbered.select(
        alert_id.alias("alert_id"),
        "timestamp",
        "entity_id",
        "entity_type",
        "event_id",
        "risk_score",
        F.col("risk_severity").alias("severity"),
        "reason_codes",
        F.col("reasons").alias("top_contributors"),
        "short_reason",
        reasons_text(F.col("reasons")).alias("reasons"),
        F.col("anomaly_activation").alias("anomaly_score"),
        F.col("sequence_activation").alias("sequence_score"),
        F.lit("UNKNOWN").alias("attack_type"),
        F.lit(0.0).alias("attack_confidence"),
    )
    if classes is not None:
        alerts = enrich(alerts, classes, checks)
    counts = pages.agg(F.count(F.lit(1)).alias("n_candidates")).crossJoin(
        opened.agg(F.count(F.lit(1)).alias("n_alerts"))
    )  # one row each
    return alerts, counts.withColumn("n_suppressed", F.col("n_candidates") - F.col("n_alerts"))


def enrich(alerts: DataFrame, classes: DataFrame, checks: stages.Checks | None = None) -> DataFrame:
    """Replace attack type and confidence where the event has a prediction."""
    named = classes.select(
        "event_id", F.col("predicted_label").alias("_label"), F.col("attack_confidence").alias("_confidence")
    )
    if checks is None:
        joined = alerts.join(named, "event_id", "left")
    else:
        joined = checks.join(alerts, named, ["event_id"], "alerts with their classes")
    joined = joined.withColumns(
        {
            "attack_type": F.coalesce("_label", "attack_type"),
            "attack_confidence": F.coalesce("_confidence", "attack_confidence"),
        }
    )
    return joined.select(*alerts.columns)


def predicted_class(events: DataFrame, classes: DataFrame) -> DataFrame:
    """Events with their predicted class, UNKNOWN at confidence 0 if none."""
    joined = events.join(classes.select("event_id", "predicted_label", "attack_confidence"), "event_id", "left")
    return joined.withColumns(
        {
            "predicted_label": F.coalesce("predicted_label", F.lit("UNKNOWN")),
            "attack_confidence": F.coalesce("attack_confidence", F.lit(0.0)),
        }
    )
