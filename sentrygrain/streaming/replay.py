"""Replays, what-if scoring and counters around the live scorer."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Config
from ..contracts import OBSERVATION_SCHEMA
from ..functions.scoring import micros
from ..operators import risk as risk_plan
from ..operators.detectors import display_score
from ..operators.profiles import KINDS, Profiles, fingerprint
from ..operators.ranking import exact_quantiles, first_k_many
from ..sources import stages
from .scorer import LiveModel, prepare, score_stream
from .state import BLOCK, MAPS, MOMENTS

#: Files a trigger reads at most, which bounds what one task holds of an entity.
FILES = 64
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Keyed state on disk: it may outgrow an executor's memory."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def explain_live(results: DataFrame, model: LiveModel, score_range: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """Stateless half after the operator: contributions, reasons, display score."""
    live = results.where(~F.col("late"))
    carried = (
        "decayed_state",
        "entity_evidence_state",
        "anomaly_score_raw",
        "baseline_rule",
        "alerted",
        "alert_suppressed",
        "profile_updated",
        "profile_source",
        "profile_confidence",
        "latency_ms",
    )
    rows = risk_plan.instantaneous(live, model.calibration, model.config, carried)
    out = risk_plan.explain_scores(rows, model.config, carried[2:])
    return out.withColumn("anomaly_score", display_score(F.col("anomaly_score_raw"), *score_range))


def flatten(explained: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """The flat result table of the live path."""
    if classes is None:
        named = explained.withColumns({"predicted_label": F.lit("UNKNOWN"), "attack_confidence": F.lit(0.0)})
    else:
        named = explained.join(classes.select("event_id", "predicted_label", "attack_confidence"), "event_id", "left")
    return named.select(
        "event_id",
        "entity_id",
        "entity_type",
        "timestamp",
        "anomaly_score_raw",
        "anomaly_score",
        "baseline_rule",
        "risk_score",
        F.col("risk_severity").alias("severity"),
        F.coalesce("predicted_label", F.lit("UNKNOWN")).alias("predicted_attack_type"),
        F.coalesce("attack_confidence", F.lit(0.0)).alias("attack_confidence"),
        "alerted",
        "alert_suppressed",
        "profile_updated",
        "profile_source",
        "profile_confidence",
        "entity_evidence_state",
        "latency_ms",
        "short_reason",
    )


def _scored_to_end(
    spark: SparkSession, path: str, profiles: Profiles, model: LiveModel, root: str, sensitivity, schema, max_files: int, watermark, initial
):
    """Run the live operator over all files below ``path`` that ``root``'s checkpoint has not seen."""
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
    if watermark:
        events = events.withWatermark("timestamp", watermark)
    with rocksdb_state(spark):
        results = score_stream(prepare(events, profiles, sensitivity), model, initial)
        query = (
            results.writeStream.outputMode("append")
            .format("parquet")
            .option("path", f"{root}/results")
            .option("checkpointLocation", f"{root}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    return query, spark.read.schema(results.schema).parquet(f"{root}/results")


def replay_table(
    spark: SparkSession,
    path: str,
    profiles: Profiles,
    model: LiveModel,
    *,
    sensitivity: Column | None = None,
    schema=OBSERVATION_SCHEMA,
    max_files: int = FILES,
    watermark: str | None = None,
    root: str | None = None,
    initial: DataFrame | None = None,
) -> DataFrame:
    """Feed a stored table through the live operator until it is used up.

    ``root`` holds checkpoint and sink; the checkpoint's offset is the cursor, so
    a replay given the same ``root`` goes on where the last one stopped, with its
    state. ``initial`` (``history_state`` or ``stored_state``) is what a run without a
    checkpoint starts from. Returns the sink table with scored and late rows.
    """
    root = root or f"{stages.stage_root(spark)}/replay-{uuid.uuid4().hex}"
    return _scored_to_end(spark, path, profiles, model, root, sensitivity, schema, max_files, watermark, initial)[1]


def stored_state(spark: SparkSession, root: str) -> DataFrame:
    """Everything the replay in ``root`` remembers, as rows (entity_id, part, payload) to start another one from."""

    def read(name: str) -> DataFrame:
        return spark.read.format("statestore").option("stateVarName", name).load(f"{root}/checkpoint")

    entity = F.col("key.entity_id").alias("entity_id")
    with rocksdb_state(spark):
        rows = read("head").select(entity, F.lit("head").alias("part"), F.to_json("value").alias("payload"))
        due = read("due")
        rows = rows.unionByName(due.select(entity, F.lit("due").alias("part"), F.to_json(due.columns[1]).alias("payload")))
        for name in MAPS:
            part = read(name)
            expiring = "ttlExpirationMs" in part.schema["user_map_value"].dataType.fieldNames()
            value = "user_map_value.value.*" if expiring else "user_map_value.*"
            payload = F.to_json(F.struct("user_map_key.*", value))
            rows = rows.unionByName(part.select(entity, F.lit(name).alias("part"), payload.alias("payload")))
        return stages.save(rows)


def history_state(events: DataFrame, config: Config = DEFAULTS, retention_hours: float = 0.0) -> DataFrame:
    """The state that unscored history leaves, as rows (entity_id, part, payload).

    Only what a window still reaches from an entity's last event is numbered; the rest of the history is
    read once for that last event. Evidence, alerts and learned profiles start empty.
    """
    keep_us = max(*config.count_windows_s, *config.failed_windows_s) * 1_000_000
    breadth_us = config.breadth_window_s * 1_000_000
    if retention_hours > 0:
        keep_us, breadth_us = (min(w, int(retention_hours * 3600e6)) for w in (keep_us, breadth_us))
    rows = events.select(
        "entity_id",
        "event_id",
        micros(F.col("timestamp")).alias("at"),
        "resource_accessed",
        (~F.col("auth_success")).cast("bigint").alias("failed"),
        "latitude",
        "longitude",
        fingerprint().alias("fp"),
    )
    order = F.struct("at", "event_id")
    last = rows.groupBy("entity_id").agg(F.max_by(F.struct("at", "event_id", "latitude", "longitude", "fp", "resource_accessed"), order).alias("last"))
    near = rows.join(last, "entity_id").withColumn("age", F.col("last.at") - F.col("at"))
    near = stages.save(near.where(F.col("age") <= max(keep_us, breadth_us)))
    in_order = Window.partitionBy("entity_id").orderBy("at", "event_id")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)

    def numbered(width: int) -> DataFrame:
        return near.where(F.col("age") <= width).withColumn("seq", F.row_number().over(in_order) - 1)

    def blocks(part: str, rows: DataFrame, column: str, names: tuple[str, str]) -> DataFrame:
        held = rows.groupBy("entity_id", F.floor(F.col("seq") / BLOCK).alias("block"))
        entry = F.sort_array(F.collect_list(F.struct("seq", "at", column))).alias("of")
        held = held.agg(entry)  # at most BLOCK rows each
        payload = F.struct("block", F.col("of.at").alias(names[0]), F.col(f"of.{column}").alias(names[1]))
        return held.select("entity_id", F.lit(part).alias("part"), F.to_json(payload).alias("payload"))

    window = numbered(keep_us).withColumn("failures", F.coalesce(F.sum("failed").over(before), F.lit(0)))
    sights = numbered(breadth_us)
    recent = sights.groupBy("entity_id", "resource_accessed").agg(F.max("seq").alias("seq"))
    counts = window.groupBy("entity_id").agg(F.count(F.lit(1)).alias("events"), F.sum("failed").alias("failures"))
    seen = recent.groupBy("entity_id").agg((F.max("seq") + 1).alias("seen"), F.count(F.lit(1)).alias("distinct"))
    zeros = lambda n, of: F.array(*[F.lit(of)] * n)
    head = last.join(counts, "entity_id").join(seen, "entity_id")
    head = head.select(
        "entity_id",
        F.lit("head").alias("part"),
        F.to_json(
            F.struct(
                F.col("last.at").alias("last_at"),
                F.col("last.event_id").alias("last_id"),
                *[F.col(f"last.{c}").alias(c) for c in ("latitude", "longitude", "fp")],
                F.col("last.resource_accessed").alias("resource"),
                F.lit(0.0).alias("evidence"),
                F.lit(0).alias("alert_rank"),
                "events",
                "failures",
                zeros(4, 0).alias("pointers"),
                "seen",
                F.lit(0).alias("seen_first"),
                "distinct",
                F.lit(0.0).alias("n"),
                F.lit(0.0).alias("total"),
                zeros(len(MOMENTS), 0.0).alias("moments"),
                zeros(len(KINDS), 0).alias("learned_keys"),
                zeros(len(KINDS), 0).alias("taken_keys"),
            )
        ).alias("payload"),
    )
    places = recent.select("entity_id", F.lit("recent").alias("part"), F.to_json(F.struct(F.col("resource_accessed").alias("resource"), "seq")).alias("payload"))
    parts = [blocks("window", window, "failures", ("ats", "failures")), blocks("sights", sights, "resource_accessed", ("ats", "resources")), places]
    for part in parts:
        head = head.unionByName(part)
    return stages.save(head)


OUTCOME = "success boolean, processed bigint, cursor bigint, total_events bigint, alerts_raised bigint, mean_latency_ms double, error string"


def replay_batch(
    events: DataFrame,
    profiles: Profiles,
    model: LiveModel,
    root: str,
    size: int,
    *,
    sensitivity: Column | None = None,
    max_files: int = FILES,
) -> DataFrame:
    """Score the next ``size`` events in (time, id) order; one row of ``OUTCOME``.

    The cursor is the number of rows that the runs in ``root`` have committed to their sink, at most all
    events, so it holds across restarts, and a slice that was written but not scored is taken up again.
    """
    spark = events.sparkSession
    total = events.count()

    def outcome(success, processed, cursor, alerts, latency, error) -> DataFrame:
        return spark.createDataFrame([(success, processed, cursor, total, alerts, latency, error)], OUTCOME)

    if total == 0:
        return outcome(False, 0, 0, 0, None, "there are no events to replay")
    try:
        done = spark.read.parquet(f"{root}/results").select("event_id")
        start = done.count()
    except AnalysisException:  # the first batch: no sink yet
        start = 0
    if start >= total:
        return outcome(True, 0, total, 0, None, None)
    size = min(max(1, size), total - start)
    part = cursor_slice(events, start, size).select(*OBSERVATION_SCHEMA.fieldNames())
    # a slice left by a run that failed is complete or not visible at all
    part.write.mode("ignore").parquet(f"{root}/feed/from={start}")
    fed = spark.read.schema(OBSERVATION_SCHEMA).parquet(f"{root}/feed/from={start}").select("event_id")
    try:
        query, results = _scored_to_end(
            spark, f"{root}/feed/*", profiles, model, root, sensitivity, OBSERVATION_SCHEMA, max_files, None, None
        )
    except StreamingQueryException as failure:
        return outcome(False, 0, start, 0, None, str(failure))
    processed = sum(p["numInputRows"] for p in query.recentProgress)
    here = results.join(fed, "event_id", "left_semi").agg(F.count_if("alerted").alias("alerts"), F.avg("latency_ms").alias("latency")).first()
    return outcome(True, processed, start + size, here.alerts, here.latency, None)


def timeline_table(
    spark: SparkSession, path: str, grouped: Callable[[DataFrame], DataFrame], schema: str, root: str, watermark: str
) -> DataFrame:
    """A windowed aggregation of the stored stream ``path`` as a table that only grows.

    A window is appended once, when the watermark has passed its end; the sink's log is kept by batch, so a
    restart adds nothing twice. Windows that are still open are not in the table.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(path)
    rows = grouped(stream.withWatermark("timestamp", watermark))
    writer = rows.writeStream.outputMode("append").format("parquet").option("path", f"{root}/table")
    writer.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{root}/table")


def late_events(results: DataFrame) -> DataFrame:
    """Events that came after newer ones of their entity; they are not scored."""
    return results.where("late").select("event_id", "entity_id", "timestamp")


def cursor_slice(events: DataFrame, cursor: int, size: int) -> DataFrame:
    """The ``size`` rows after the first ``cursor`` ones in (time, id) order."""
    order = [micros(F.col("timestamp"))]
    masks = first_k_many(events, [cursor, cursor + size], order, "event_id")
    return events.where(masks[cursor + size] & ~masks[cursor])


def latency_stats(results: DataFrame, latency: str = "latency_ms", wall_seconds: float | None = None) -> DataFrame:
    """Count, mean, p50, p95, p99 and throughput; nulls when nothing was measured."""
    p50, p95, p99 = exact_quantiles(results, {"l": F.col(latency)}, [0.5, 0.95, 0.99])["l"]
    wall = F.lit(wall_seconds) if wall_seconds is not None else F.sum(latency) / 1000.0
    return results.agg(
        F.count(latency).alias("n"),
        F.avg(latency).alias("mean_ms"),
        F.lit(p50).cast("double").alias("p50_ms"),
        F.lit(p95).cast("double").alias("p95_ms"),
        F.lit(p99).cast("double").alias("p99_ms"),
        wall.alias("wall_time_s"),
    ).withColumn("throughput_events_per_sec", F.try_divide(F.col("n"), F.col("wall_time_s")))


def run_counters(flat: DataFrame) -> DataFrame:
    return flat.agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if("alerted").alias("n_alerts"),
        F.count_if("alert_suppressed").alias("n_suppressed"),
        F.count_if("profile_updated").alias("n_profile_updates"),
    )


def history_of(events: DataFrame, injected: DataFrame) -> DataFrame:
    """Stored events of the involved entities, strictly before the injection."""
    involved = injected.select("entity_id").distinct()
    start = injected.agg(F.min(micros(F.col("timestamp")))).first()[0]
    return events.where(micros(F.col("timestamp")) < start).join(involved, "entity_id", "left_semi")


def what_if(
    events: DataFrame,
    injected: DataFrame,
    profiles: Profiles,
    model: LiveModel,
    *,
    sensitivity: Column | None = None,
) -> DataFrame:
    """Score only the injected events, after their entities' stored history.

    The history becomes the state that the run starts from (``history_state``); it is not scored.
    """
    spark = events.sparkSession
    path = f"{stages.stage_root(spark)}/what-if-{uuid.uuid4().hex}"
    injected.select(*OBSERVATION_SCHEMA.fieldNames()).write.parquet(path)
    past = history_state(history_of(events, injected), model.config, model.retention_hours)
    results = replay_table(spark, path, profiles, model, sensitivity=sensitivity, initial=past)
    return explain_live(results, model)


def last_alert(explained: DataFrame) -> DataFrame:
    """The last alert an injection raised, if any."""
    return explained.where("alerted").orderBy(F.desc("timestamp"), F.desc("event_id")).limit(1)
