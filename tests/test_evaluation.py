import random

import brute
import pytest
from build import START, event
from pyspark.sql import functions as F

from sentrygrain.operators import campaigns, evaluation
from sentrygrain.plans import catalog

SCHEMA = "event_id string, timestamp timestamp, s double, y boolean, label string, campaign_id string"


def frame(spark, scores, truth, labels=None):
    from datetime import timedelta

    rows = [
        (f"E{i:05d}", START + timedelta(seconds=i), float(s), bool(t), labels[i] if labels else ("BRUTE_FORCE" if t else "BENIGN"), None)
        for i, (s, t) in enumerate(zip(scores, truth))
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_budget_takes_exactly_the_top(spark):
    scores = list(range(1000))
    df = frame(spark, scores, [0] * 1000)
    mask = evaluation.budget_masks(df, "s", (0.01,))[0.01]
    assert sorted(r.s for r in df.where(mask).collect()) == list(range(990, 1000))
    assert evaluation.budget_size(101, 0.01) == 2


def test_budget_ties_prefer_earlier_rows(spark):
    df = frame(spark, [1.0] * 100, [0] * 100)
    mask = evaluation.budget_masks(df, "s", (0.1,))[0.1]
    assert sorted(r.event_id for r in df.where(mask).collect()) == [f"E{i:05d}" for i in range(10)]


@pytest.mark.parametrize("bad", [0.0, 1.5])
def test_budget_fraction_bounds(bad):
    with pytest.raises(ValueError):
        evaluation.budget_size(10, bad)


def test_ranking_metrics_with_ties(spark):
    rng = random.Random(4)
    scores = [rng.choice([0.1, 0.2, 0.2, 0.5, 0.9, rng.random()]) for _ in range(300)]
    truth = [rng.random() < 0.2 + 0.3 * s for s in scores]
    row = evaluation.ranking_metrics(frame(spark, scores, truth), "s", "y").first()
    assert row.pr_auc == pytest.approx(brute.average_precision(scores, truth))
    assert row.roc_auc == pytest.approx(brute.roc_auc(scores, truth))


@pytest.mark.parametrize("truth", [[0] * 6, [1] * 6])
def test_one_class_leaves_ranking_undefined(spark, truth):
    row = evaluation.ranking_metrics(frame(spark, [1, 2, 3, 4, 5, 6], truth), "s", "y").first()
    assert (row.pr_auc, row.roc_auc) == (None, None)


def test_detection_metrics_by_hand(spark):
    df = frame(spark, [0.9, 0.8, 0.1, 0.2, 0.3, 0.4], [1, 0, 1, 0, 0, 0])
    row = evaluation.detection_metrics(df, "s", "y", threshold=0.5).first()
    assert (row.tp, row.fn, row.fp, row.tn) == (1, 1, 1, 3)
    assert (row.precision, row.recall, row.fpr) == (0.5, 0.5, 0.25)
    with pytest.raises(ValueError):
        evaluation.detection_metrics(df, "s", "y")


def test_no_positives_gives_null_ratios(spark):
    row = evaluation.detection_metrics(frame(spark, [1, 2], [0, 0]), "s", "y", threshold=5.0).first()
    assert (row.precision, row.recall, row.f1, row.fpr) == (None, None, None, 0.0)


def test_roc_drops_collinear_points(spark):
    df = frame(spark, [6, 5, 4, 3, 2, 1], [1, 1, 0, 0, 1, 0])
    points = sorted((r.fpr, r.tpr) for r in evaluation.roc_curve(df, "s", "y").collect())
    third = 1 / 3
    # The first scored point is always kept, as the leading origin is.
    expected = [(0, 0), (0, third), (0, 2 * third), (2 * third, 2 * third), (2 * third, 1), (1, 1)]
    assert [x for p in points for x in p] == pytest.approx([x for p in expected for x in p])


def test_subset_budget_takes_benign_first_on_ties(spark):
    df = frame(spark, [1.0] * 10, [1] * 4 + [0] * 6).withColumn("is_attack", F.col("y"))
    row = evaluation.per_attack_type(df, "s", 0.7).where("attack_type = 'BRUTE_FORCE'").first()
    assert (row.n, row.recall_at_budget) == (4, 0.25)


def test_campaign_latency_by_hand(spark, make_events):
    hour = 3_600_000_000
    rows = [event(i, i * hour, campaign_id="C1", label="BRUTE_FORCE", is_attack=True) for i in range(4)]
    rows += [event(9, 9 * hour, campaign_id="C2", label="LATERAL_MOVEMENT", is_attack=True), event(10, 10 * hour)]
    found = campaigns.campaign_detection(make_events(rows), F.col("event_id") == "EVT-000000002")
    summary = campaigns.detection_summary(found).first()
    assert (summary.n_campaigns, summary.n_detected, summary.campaign_recall) == (2, 1, 0.5)
    assert (summary.median_latency_seconds, summary.median_events_before_detection) == (7200.0, 2.0)


def test_straddling_campaigns_leave_the_medians(spark, make_events):
    hour = 3_600_000_000
    rows = []
    for c, (first, detected) in enumerate([(0, True), (5, True), (5, False)]):
        rows += [event(10 * c + i, (first + i) * hour, campaign_id=f"C{c}", label="BRUTE_FORCE", is_attack=True) for i in range(4)]
    split = F.when(F.hour("timestamp") < 2, "train").otherwise("evaluation")
    timeline = make_events(rows).withColumn("split", split)
    meta = spark.createDataFrame([(f"C{i}", "BRUTE_FORCE", i == 1) for i in range(3)], "campaign_id string, attack_type string, stealthy boolean")
    alerted = F.col("event_id").isin("EVT-000000003", "EVT-000000012")
    report = campaigns.campaign_report(timeline.where("split = 'evaluation'"), timeline, alerted, meta)
    row = campaigns.subset_summary(report).where("subset = 'malicious'").first()
    assert (row.n_campaigns, row.n_detected, row.n_latency_excluded_straddling) == (3, 2, 1)
    assert row.median_latency_seconds == 7200.0
    assert [r.campaign_id for r in campaigns.missed_campaigns(report).collect()] == ["C2"]
    true_start = report.where("campaign_id = 'C0'").first()
    assert (true_start.latency_seconds, true_start.latency_seconds_true_start) == (3600.0, 10800.0)


def test_class_without_support_scores_zero(spark):
    df = spark.createDataFrame([("BENIGN", "BENIGN"), ("BRUTE_FORCE", "BENIGN")], "label string, predicted_label string")
    got = {r["class"]: r for r in evaluation.per_class(df).collect()}
    assert (got["BRUTE_FORCE"].recall, got["BRUTE_FORCE"].support) == (0.0, 1)
    assert (got["INSIDER_DRIFT"].f1, got["INSIDER_DRIFT"].support) == (0.0, 0)
    assert got["BENIGN"].precision == 0.5
    report = evaluation.classifier_report(df).first()
    assert report.macro_f1_present_classes == pytest.approx((2 / 3 + 0) / 2)
    assert report.insider_drift_recall is None


def _times_ordered(monkeypatch, build):
    """How often ``build`` puts a table into the order of its scores."""
    calls, ordered = [], evaluation.cumulative
    monkeypatch.setattr(evaluation, "cumulative", lambda *a, **k: calls.append(1) or ordered(*a, **k))
    build()
    return len(calls)


def test_event_level_report_orders_each_score_once(pipeline, monkeypatch):
    rows = catalog._eval(pipeline)
    points = {catalog.RAW: pipeline.given_thresholds}
    assert _times_ordered(monkeypatch, lambda: evaluation.event_level_report(rows, (catalog.RULE, catalog.RAW), points, 0.01)) == 2


def test_metrics_sections_order_the_scores_once_and_store_predictions(pipeline, monkeypatch):
    found = {}
    assert _times_ordered(monkeypatch, lambda: found.update(catalog._sections(pipeline))) == 1
    assert "Join" not in found["per_class"]._jdf.queryExecution().optimizedPlan().toString()


def test_matched_thresholds_read_a_joined_table(pipeline):
    train, rows = catalog._methods(pipeline)
    assert all("Join" not in df._jdf.queryExecution().optimizedPlan().toString() for df in (train, rows))
