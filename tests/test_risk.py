import random
from dataclasses import replace

import brute
import pytest
from build import event
from pyspark.sql import functions as F

from sentrygrain.config import DEFAULTS
from sentrygrain.functions import scoring
from sentrygrain.operators import alerts, risk
from sentrygrain.operators.timeline import assign_chunks

HOT = replace(DEFAULTS, chunk_rows=9)


def evidence_rows(seed=1, n=240):
    rng = random.Random(seed)
    rows, at = [], 0
    for i in range(n):
        at += rng.choice([0, 1, 10**6, 10**9, 10**10]) if rng.random() < 0.97 else 500 * 86_400 * 10**6
        rows.append(event(i, at, rng.choice(["ENT-1"] * 4 + ["ENT-2"])) | {"e": rng.choice([0.0, 0.1, 0.7, 2.5])})
    return rows


@pytest.mark.parametrize("config", [DEFAULTS, HOT], ids=["whole", "split"])
def test_evidence_state_matches_the_loop(spark, config):
    rows = evidence_rows()
    df = spark.createDataFrame([(r["event_id"], r["timestamp"], r["entity_id"], r["e"]) for r in rows], "event_id string, timestamp timestamp, entity_id string, e double")
    df = assign_chunks(df.withColumn("_at", scoring.micros(F.col("timestamp"))), ["entity_id"], "_at", config.chunk_rows)
    got = risk.evidence_state(df, "e", config.risk).collect()
    expected = brute.evidence(rows, config.risk.halflife_seconds, config.risk.state_cap)
    for r in got:
        assert (r.decayed_state, r.entity_evidence_state) == pytest.approx(expected[r.event_id], abs=1e-9)


def test_no_half_life_keeps_nothing(spark):
    df = spark.createDataFrame([("a", "E", 9.0)], "event_id string, entity_id string, e double")
    out = risk.evidence_state(df, "e", replace(DEFAULTS.risk, halflife_seconds=0.0)).first()
    assert (out.decayed_state, out.entity_evidence_state) == (0.0, 4.0)


@pytest.mark.parametrize("escalate", [True, False])
@pytest.mark.parametrize("chunk_rows", [9, 10**6])
def test_cooldown_and_escalation(spark, escalate, chunk_rows):
    rng = random.Random(8)
    pages, at = [], 0
    for i in range(300):
        at += rng.choice([0, 1, 600, 1799, 3599, 3600])
        pages.append((rng.choice(["A"] * 6 + ["B"]), at, f"E{i:04d}", rng.choice([3, 3, 3, 4])))
    df = spark.createDataFrame([(e, i, t * 1_000_000, r) for e, t, i, r in pages], "entity_id string, event_id string, at bigint, rank int")
    config = replace(HOT, chunk_rows=chunk_rows, risk=replace(DEFAULTS.risk, escalation_bypasses_cooldown=escalate))
    got = sorted(r.event_id for r in alerts.emitted(df, config).collect())
    assert got == brute.alerts(pages, 3600, escalate)


def test_severity_bands_use_upper_bounds(spark):
    scores = [(0.0,), (30.0,), (30.01,), (60.0,), (80.0,), (80.5,), (100.0,)]
    got = [r.s for r in spark.createDataFrame(scores, "x double").select(scoring.severity(F.col("x")).alias("s")).collect()]
    assert got == ["LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "CRITICAL", "CRITICAL"]


def test_saturation_and_its_inverse(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.5, 1.5, 9.0)], "e double")
    back = scoring.evidence_for_risk(scoring.saturating_risk(F.col("e"), 1.5), 1.5)
    for r in df.select("e", back.alias("b")).collect():
        assert r.b == pytest.approx(r.e, abs=1e-6)


def test_ramp_is_a_step_when_degenerate(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double")
    assert [r[0] for r in df.select(scoring.ramp(F.col("x"), 2.0, 2.0)).collect()] == [0.0, 0.0, 1.0]
    assert [r[0] for r in df.select(scoring.ramp(F.col("x"), 1.0, 3.0)).collect()] == [0.0, 0.5, 1.0]


def test_contributions_add_up_to_the_score(pipeline):
    parts = ("isolation_forest", "rule", "context", "persistence")
    for r in pipeline.given_risk.collect():
        assert sum(r[f"{p}_contribution"] for p in parts) == pytest.approx(r.risk_score, abs=1e-9)
        assert len(r.reasons) <= 6
        assert [x.contribution for x in r.reasons] == sorted((x.contribution for x in r.reasons), reverse=True)


def test_risk_rejects_ground_truth(pipeline):
    from sentrygrain.contracts import LeakageError

    frame = risk.scoring_frame(pipeline.features, pipeline.given_scores).withColumn("label", F.lit("BENIGN"))
    with pytest.raises(LeakageError):
        risk.score_events(frame, pipeline.given_calibration)


def test_calibration_survives_json(pipeline):
    cal = pipeline.given_calibration
    assert risk.Calibration.from_json(cal.to_json()) == cal


def test_unknown_signal_feature_is_rejected():
    from sentrygrain.config import Signal

    with pytest.raises(ValueError):
        replace(DEFAULTS.risk, signals=(Signal("x", "X", 1.0, "ramp", ("nonsense",)),))


def test_engine_fit_joins_the_labels_once(pipeline, monkeypatch):
    """Before, each pass of the quantiles joined frame and labels again."""
    seen, fit = [], risk.fit_calibration
    monkeypatch.setattr(risk, "fit_calibration", lambda rows, *rest: seen.append(rows._jdf.queryExecution().optimizedPlan().toString()) or fit(rows, *rest))
    got = risk.fit_engine(pipeline.given_frame, pipeline.given_scores, pipeline.given_thresholds, pipeline.config)
    assert "Join" not in seen[0] and got == pipeline.given_calibration
