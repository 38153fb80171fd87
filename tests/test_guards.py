"""Guards of the chain: what the stages' own writes count, and where columns come from."""

import pytest
from build import event
from pyspark.sql import Window
from pyspark.sql import functions as F

from sentrygrain import contracts
from sentrygrain.config import FEATURES
from sentrygrain.operators import alerts
from sentrygrain.plans.pipeline import Pipeline, labelled_features, save_features
from sentrygrain.sources import stages


def test_lineage_goes_through_projections_under_other_names(make_events):
    events = make_events([event(1, 0), event(2, 10)])
    hidden = events.select("event_id", "bytes_transferred", F.col("label").alias("note"))
    hidden = hidden.withColumn("x", F.length("note") + F.col("bytes_transferred")).select("event_id", F.col("x").alias("transfer_volume_zscore"))
    of = contracts.lineage(hidden)
    assert of == {"event_id": {"event_id"}, "transfer_volume_zscore": {"label", "bytes_transferred"}}
    with pytest.raises(contracts.LeakageError, match="transfer_volume_zscore.*label"):
        contracts.guard_lineage(hidden, ["transfer_volume_zscore"])
    contracts.guard_lineage(hidden, ["event_id"])


def test_lineage_goes_through_every_kind_of_operator(spark, make_events):
    events = make_events([event(1, 0), event(2, 10)])
    w = Window.partitionBy("entity_id").orderBy("timestamp")
    leaks = {
        "aggregate": events.groupBy("entity_id").agg(F.max(F.col("is_attack").cast("int")).alias("x")),
        "window": events.withColumn("x", F.lag("label").over(w)),
        "window order": events.withColumn("x", F.row_number().over(Window.orderBy("label"))),
        "generator": events.select("event_id", F.explode(F.array("label", "city")).alias("x")),
        "union": events.select(F.col("city").alias("x")).union(events.select("label")),
        "join": events.select("event_id", "city").join(events.select("event_id", F.upper("label").alias("x")), "event_id"),
        "python": events.select("event_id", "label").mapInPandas(lambda it: it, "event_id string, x string"),
    }
    for name, df in leaks.items():
        assert contracts.lineage(df)["x"] & set(contracts.LABEL_COLUMNS), name
        with pytest.raises(contracts.LeakageError):
            contracts.guard_lineage(df, ["x"])
    clean = events.join(events.where("label = 'BENIGN'").select("event_id"), "event_id", "left_semi")
    clean = clean.withColumn("x", F.sum("bytes_transferred").over(w)).where("is_attack is not null")
    assert contracts.lineage(clean)["x"] == {"bytes_transferred", "entity_id", "timestamp"}


def test_features_of_the_chain_come_from_observations(pipeline):
    from sentrygrain.config import LABEL_COLUMNS
    from sentrygrain.operators import features
    from sentrygrain.plans.pipeline import sensitivity_by_name

    rows = features.build_features(pipeline.events, pipeline.profiles, sensitivity_by_name(), pipeline.config, keep=LABEL_COLUMNS)
    of = contracts.lineage(rows)
    assert of["label"] == {"label"}
    assert of["geo_distance_from_previous_km"] >= {"latitude", "longitude"}
    assert all(of[c] and not of[c] & set(LABEL_COLUMNS) for c in FEATURES)
    tainted = rows.withColumn("hour", F.when(F.col("is_attack"), 0.0).otherwise(F.col("hour")))
    with pytest.raises(contracts.LeakageError, match="hour.*is_attack"):
        save_features(tainted)


def test_bad_events_fail_the_chain(spark, make_events):
    for rows, match in (
        ([event(1, 0), event(2, 10, label="WHAT")], "unknown_labels"),
        ([event(1, 10**7), event(2, 0)], "not in order of time"),
    ):
        with pytest.raises(contracts.ContractError, match=match):
            Pipeline(spark, "nowhere", events=make_events(rows)).events
    good = make_events([event(1, 0), event(2, 10)])
    assert Pipeline(spark, "nowhere", events=good).events.count() == 2


def test_features_that_are_no_numbers_or_lack_labels_fail_the_chain(pipeline):
    for change, match in (
        ({"geo_velocity_kmh": F.when(F.col("event_id").endswith("7"), float("nan")).otherwise(F.col("geo_velocity_kmh"))}, "NaN.*geo_velocity_kmh"),
        ({"hour": F.when(F.col("event_id").endswith("7"), float("inf")).otherwise(F.col("hour"))}, "NaN.*hour"),
        ({"label": F.when(~F.col("event_id").endswith("7"), F.col("label"))}, "without a label"),
    ):
        with pytest.raises(contracts.ContractError, match=match):
            save_features(pipeline.labelled.withColumns(change))


def test_joins_that_repeat_or_lose_rows_fail(spark, pipeline):
    checks = stages.Checks()
    some = pipeline.events.where("event_id not like '%7'")
    with pytest.raises(contracts.ContractError, match="without a label"):
        stages.save(labelled_features(pipeline.features, some, checks), checks=checks)
    checks = stages.Checks()
    with pytest.raises(contracts.ContractError, match="not unique"):
        stages.save(labelled_features(pipeline.features, some.union(some.limit(3)).union(pipeline.events), checks), checks=checks)
    classes = pipeline.events.select("event_id", F.lit("BRUTE_FORCE").alias("predicted_label"), F.lit(0.5).alias("attack_confidence"))
    checks = stages.Checks()
    rows, _ = alerts.build_alerts(pipeline.given_risk, classes, pipeline.config, checks)
    assert {r.attack_type for r in stages.save(rows, checks=checks).collect()} == {"BRUTE_FORCE"}
    checks = stages.Checks()
    rows, _ = alerts.build_alerts(pipeline.given_risk, classes.union(classes), pipeline.config, checks)
    with pytest.raises(contracts.ContractError, match="alerts with their classes.*not unique"):
        stages.save(rows, checks=checks)
