import json
import re

import pytest
from build import event
from pyspark.sql import functions as F

from sentrygrain import contracts
from sentrygrain.operators import analyst
from sentrygrain.sources import documents, tables

SHAPES = {
    "wrapped": {"entities": [{"entity_id": "A", "entity_type": "user", "devices": ["d1"]}, {"entity_id": "B", "entity_type": "user"}]},
    "list": [{"entity_id": "A", "entity_type": "user", "devices": ["d1"]}, {"entity_id": "B", "entity_type": "user"}],
    "map": {"A": {"entity_type": "user", "devices": ["d1"]}, "B": {"entity_type": "user"}},
}


@pytest.mark.parametrize("shape", SHAPES)
def test_roster_document_shapes(spark, tmp_path, shape):
    path = tmp_path / "roster.json"
    path.write_text(json.dumps(SHAPES[shape]))
    got = documents.read_roster(spark, str(path))
    assert got.columns[:6] == list(analyst.ENTITY_COLUMNS)
    assert {r.entity_id: (r.entity_type, r.department) for r in got.collect()} == {"A": ("user", None), "B": ("user", None)}
    assert "devices" in got.columns


def test_roster_of_many_ids_needs_no_columns_for_them(spark, tmp_path):
    path = tmp_path / "roster.json"
    path.write_text(json.dumps({f"ENT-{i}": {"entity_type": "user", "department": f"d{i % 7}"} for i in range(100_000)}))
    got = documents.read_roster(spark, str(path))
    assert got.columns == list(analyst.ENTITY_COLUMNS)
    assert got.count() == got.select("entity_id").distinct().count() == 100_000
    assert got.where("entity_id = 'ENT-99999'").first().department == "d4"


def test_campaigns_as_list_and_as_lines(spark, tmp_path):
    rows = [{"campaign_id": "C1", "attack_type": "X", "entity_ids": ["A", "B"], "stealthy": True}, {"campaign_id": "C2", "other": 1}]
    (tmp_path / "list.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n")
    want = [("C1", "X", ["A", "B"], True), ("C2", None, None, None)]
    assert sorted(map(tuple, documents.read_campaigns(spark, str(tmp_path / "list.json")).collect())) == want
    assert sorted(map(tuple, documents.read_campaigns(spark, str(tmp_path / "lines.json"), lines=True).collect())) == want


def test_roster_falls_back_to_events(spark, make_events, tmp_path):
    path = tmp_path / "roster.json"
    path.write_text(json.dumps({"profile": "dev"}))
    got = documents.read_roster(spark, str(path), make_events([event(1, 0), event(2, 1)]))
    assert [r.entity_id for r in got.collect()] == ["ENT-1"]


def test_bad_json_lists_become_empty(spark):
    df = spark.createDataFrame([('["A","B"]',), ("nonsense",), (None,)], "codes string")
    got = documents.lists_from_json(df, {"codes": "array<string>"}).collect()
    assert [r.codes for r in got] == [["A", "B"], [], []]


def test_metrics_are_strict_json(spark, tmp_path):
    df = spark.createDataFrame([(float("nan"), 1.0), (float("inf"), 2.0)], "a double, b double")
    path = str(tmp_path / "metrics")
    documents.write_metrics(documents.metrics_document({"detection": df}), path)
    got = documents.read_metrics(spark, path, "detection", "a double, b double").collect()
    assert sorted((r.a, r.b) for r in got if r.a is None) == [(None, 1.0), (None, 2.0)]
    raw = spark.read.text(path).first()[0]
    assert "NaN" not in raw and json.loads(raw)["seed"] == 42


def test_contract_violations(make_events):
    good = make_events([event(1, 0), event(2, 1)])
    assert contracts.validate_events(good, strict_order=True) is good
    with pytest.raises(contracts.ContractError):
        contracts.validate_events(good.drop("city"))
    with pytest.raises(contracts.ContractError):
        contracts.validate_events(good.withColumn("timestamp", F.col("timestamp").cast("string")))
    with pytest.raises(contracts.ContractError):
        contracts.validate_events(make_events([event(1, 0, label="WHAT")]))
    with pytest.raises(contracts.ContractError):
        contracts.validate_events(make_events([event(2, 0), event(1, 10**7)]), strict_order=True)
    assert contracts.check_columns(good.drop("label", "is_attack", "campaign_id"), require_labels=False)


def test_leakage_scopes():
    contracts.guard_leakage(["predicted_label"], "features")
    for column, scope in (("label", "features"), ("stealthy", "risk"), ("predicted_label", "inference")):
        with pytest.raises(contracts.LeakageError):
            contracts.guard_leakage([column], scope)


def test_features_do_not_read_labels(pipeline):
    from sentrygrain.operators import features

    plan = features.build_features(pipeline.events, pipeline.profiles)
    tree = plan._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", tree)
    assert scans and not any("label" in s or "is_attack" in s or "campaign_id" in s for s in scans)


def test_unique_guard(make_events):
    twice = make_events([event(1, 0), event(1, 1)])
    with pytest.raises(contracts.ContractError):
        contracts.guard_unique(twice, "event_id")


def test_partitioned_sink_round_trip(pipeline, spark, tmp_path):
    path = str(tmp_path / "features")
    tables.write_table(pipeline.features, path, partition_by=("split",))
    assert tables.read_table(spark, path).count() == pipeline.features.count()


def test_overlay_keeps_the_newest(make_events):
    base, live = make_events([event(1, 0)]), make_events([event(i, i) for i in range(2, 9)])
    got = analyst.overlay(base, live, [F.desc("timestamp")], 3)
    assert {r.event_id[-1] for r in got.collect()} == {"1", "6", "7", "8"}


def test_confidence_stages(make_events):
    rows = [event(1000 * n + i, i, f"ENT-{n}") for n in (4, 5, 59, 60) for i in range(n)]
    got = {r.entity_id: (round(r.profile_confidence, 4), r.profile_stage) for r in analyst.entity_confidence(make_events(rows)).collect()}
    assert got == {"ENT-4": (0.24, "cold-start"), "ENT-5": (0.3, "blending"), "ENT-59": (0.9873, "blending"), "ENT-60": (1.0, "mature")}
