import json
import math
from dataclasses import replace

import brute
import pytest
from build import START, event
from pyspark.sql import functions as F

from sentrygrain.config import DEFAULTS, FEATURES
from sentrygrain.contracts import OBSERVATION_SCHEMA
from sentrygrain.operators import drift, profiles
from sentrygrain.plans.pipeline import sensitivity_by_name
from sentrygrain.streaming import replay
from sentrygrain.streaming.scorer import ENTERS, LiveModel, _packed, prepare


@pytest.fixture(scope="module")
def source(pipeline, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stream") / "events")
    pipeline.events.select(*OBSERVATION_SCHEMA.fieldNames()).repartitionByRange(3, "timestamp").write.parquet(path)
    return path


def model(pipeline, **options):
    return LiveModel(pipeline.rule, pipeline.given_calibration, config=pipeline.config, **options)


def test_live_equals_batch_with_frozen_profiles(spark, pipeline, source):
    live = replay.replay_table(spark, source, pipeline.profiles, model(pipeline, adapt=False), sensitivity=sensitivity_by_name())
    got = {r.event_id: r for r in live.collect()}
    batch = {r.event_id: r for r in pipeline.features.collect()}
    scores = {r.event_id: r for r in pipeline.given_risk.collect()}
    opened = {r.event_id for r in pipeline.given_alerts[0].collect()}
    assert got.keys() == batch.keys()
    for key, row in batch.items():
        assert [got[key][c] for c in FEATURES] == pytest.approx([row[c] for c in FEATURES], rel=1e-9, abs=1e-9)
        assert got[key].risk_score == pytest.approx(scores[key].risk_score, rel=1e-9, abs=1e-9)
        assert got[key].alerted == (key in opened)


def test_adaptive_profiles_agree_with_the_closed_form(spark, pipeline, source):
    """What the live operator knows at the end is what the batch job computes."""
    live_model = model(pipeline, adapt=True)
    late = drift.replayed(pipeline.events, pipeline.cutoff)
    early = pipeline.events.where(~F.col("event_id").isin([r.event_id for r in late.select("event_id").collect()]))
    assert early.count() + late.count() == pipeline.events.count()
    columns = OBSERVATION_SCHEMA.fieldNames()
    rows = early.select(*columns, F.lit(True).alias("warm")).unionByName(late.select(*columns, F.lit(False).alias("warm")))
    path = source + "-warm"
    rows.write.parquet(path)
    live = replay.replay_table(
        spark, path, pipeline.profiles, live_model, sensitivity=sensitivity_by_name(), schema=rows.schema
    )
    assert live.count() == late.count()
    gated = drift.gate(late, live.select("event_id", "risk_score"))
    accepted = {r.event_id for r in gated.where("accepted").collect()}
    assert accepted == {r.event_id for r in live.where("profile_updated").collect()}
    # The last event of an entity was judged by the profile of all earlier accepted ones.
    ordered = brute.by_entity([r.asDict() for r in gated.collect()])
    fitted = brute.by_entity([r.asDict() for r in profiles.fit_rows(pipeline.events, pipeline.cutoff).collect()])
    got = {r.event_id: r for r in live.collect()}
    for entity, events in ordered.items():
        *before, last = events
        seen = [e for e in before if e["accepted"]]
        counts, moments, n, _ = brute.adaptive(seen, brute.frozen(fitted[entity]), DEFAULTS.ewma_halflife_days)
        row = got[last["event_id"]]
        table = counts["resource"]
        assert row.is_known_resource == float(last["resource_accessed"] in table)
        spread = max(moments["duration_m2"] ** 0.5, 1.0)
        z = (last["session_duration_s"] - moments["duration_mean"]) / spread
        assert row.session_duration_zscore == pytest.approx(z, rel=1e-6, abs=1e-6)
        k = round(table.get(last["resource_accessed"], 0.0))
        rarity = -math.log((k + 1) / (round(n) + len(table) + 1))
        assert row.resource_rarity == pytest.approx(rarity, rel=1e-9)


def test_wide_profiles_are_looked_up_like_narrow_ones(spark, make_events):
    """Counts, values per kind and levels are the same whether a kind is a map or rows."""
    seen = [event(i, i * 60_000_000, resource_accessed=f"view/{i % 5}", device_id=f"DEV-{i % 4}") for i in range(40)]
    rows = make_events(seen)
    got = {}
    for limit in (2_000, 3):
        fitted = profiles.fit_profiles(rows, 10**18, replace(DEFAULTS, wide_profile_keys=limit))
        assert (fitted.wide_entity is None) == (limit == 2_000)
        table = prepare(rows, fitted)
        got[limit] = {r.event_id: r.asDict() for r in table.collect()}
    assert got[3].keys() == got[2_000].keys()
    for key, wide in got[3].items():
        narrow = got[2_000][key]
        for side in ("own", "cohort"):
            levels = [json.loads(r.pop(f"{side}_levels")) for r in (wide, narrow)]
            assert levels[0] == levels[1]
            assert levels[0]["resource"] == {"8": 5} and levels[0]["device"] == {"10": 4}
        assert wide == narrow


def test_events_move_while_they_are_short(pipeline):
    """One exchange of the events, of the columns that are read, below the joins with the profiles; few columns enter Python."""
    rows = _packed(prepare(pipeline.events.drop("label", "is_attack", "campaign_id"), pipeline.profiles), False)
    assert rows.columns == ["entity_id", *ENTERS]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    above, _, below = plan.partition("RepartitionByExpression [entity_id")
    assert above.count("LeftOuter") == 2 and below.count("RepartitionByExpression") == 0
    moved = below.split("Project [", 1)[1].splitlines()[0]
    assert "device_id" in moved and not any(c in moved for c in ("source_ip", "arrivals", "counts", "levels"))


def tiny_run(spark, pipeline, make_events, path, deliveries, **options):
    root = path + "-run"
    for rows in deliveries:
        make_events(rows).select(*OBSERVATION_SCHEMA.fieldNames()).write.mode("append").parquet(path)
        out = replay.replay_table(spark, path, pipeline.profiles, model(pipeline, **options), root=root)
    return out


def test_late_events_are_set_aside_and_state_survives_restarts(spark, pipeline, make_events, tmp_path):
    first = [event(1, 10**9), event(2, 2 * 10**9)]
    second = [event(3, 10**9 + 5), event(0, 2 * 10**9), event(4, 2 * 10**9), event(5, 3 * 10**9)]
    out = tiny_run(spark, pipeline, make_events, str(tmp_path / "in"), [first, second], adapt=False)
    assert {r.event_id[-1] for r in replay.late_events(out).collect()} == {"3", "0"}
    gaps = {r.event_id[-1]: r.inter_event_gap_s for r in out.where("not late").collect()}
    assert gaps == {"1": 0.0, "2": 1000.0, "4": 0.0, "5": 1000.0}


def test_strict_mode_refuses_late_events(spark, pipeline, make_events, tmp_path):
    with pytest.raises(Exception, match="older than its entity"):
        tiny_run(
            spark, pipeline, make_events, str(tmp_path / "in"), [[event(2, 10**9)], [event(1, 5)]], adapt=False, strict=True
        )


def test_what_if_scores_only_the_injected(spark, pipeline, make_events):
    base = pipeline.events.where("entity_id = 'ENT-000003'")
    last = base.orderBy(F.desc("timestamp")).first()
    at = round((last.timestamp.timestamp() - START.timestamp()) * 1e6)
    extra = make_events([event(990 + i, at + 10**6 * (i + 1), "ENT-000003", auth_success=False) for i in range(5)])
    out = replay.what_if(pipeline.events, extra, pipeline.profiles, model(pipeline, adapt=False)).collect()
    assert len(out) == 5
    rows = sorted(out, key=lambda r: r.event_id)
    assert rows[-1].risk_score > rows[0].risk_score


def in_order(rows, path, n=2):
    """Write ``rows`` as ``n`` files, earlier events in earlier files, since a trigger reads the oldest file first."""
    rows = rows.select(*OBSERVATION_SCHEMA.fieldNames())
    cuts = [int(c) for c in rows.select(F.unix_micros("timestamp").alias("us")).approxQuantile("us", [(i + 1) / n for i in range(n)], 0.0)]
    for low, high in zip([0, *cuts[:-1]], cuts):
        some = rows.where(f"unix_micros(timestamp) > {low} and unix_micros(timestamp) <= {high}")
        some.coalesce(1).write.mode("append").parquet(path)
    return path


def halves(spark, pipeline, root, model_of):
    """A run over all events and one in two parts, the second of which starts from the first one's state."""
    late = F.unix_micros("timestamp") > pipeline.cutoff
    for name, rows in (("early", pipeline.events.where(~late)), ("late", pipeline.events.where(late)), ("all", pipeline.events)):
        in_order(rows, f"{root}/{name}")
    run = lambda name, **options: replay.replay_table(
        spark, f"{root}/{name}", pipeline.profiles, model_of, sensitivity=sensitivity_by_name(), max_files=1, root=f"{root}/run-{name}", **options
    )
    run("early")
    second = run("late", initial=replay.stored_state(spark, f"{root}/run-early"))
    return second, run("all")


def same_results(some, whole):
    rows = {r.event_id: r for r in whole.collect()}
    names = [c for c in some.columns if c not in ("timestamp", "latency_ms")]
    for r in some.collect():
        for c in names:
            want = rows[r.event_id][c]
            assert r[c] == (pytest.approx(want, rel=1e-9, abs=1e-9) if isinstance(want, float) else want), (r.event_id, c)


@pytest.mark.parametrize("adapt", [False, True])
def test_a_run_started_from_state_equals_one_run_over_all(spark, pipeline, tmp_path, adapt):
    second, whole = halves(spark, pipeline, str(tmp_path), model(pipeline, adapt=adapt))
    assert second.count() == pipeline.events.where(F.unix_micros("timestamp") > pipeline.cutoff).count()
    same_results(second, whole)


def test_unscored_history_gives_the_windows_of_a_warm_run(spark, pipeline, tmp_path):
    columns = OBSERVATION_SCHEMA.fieldNames()
    late = F.unix_micros("timestamp") > pipeline.cutoff
    frozen = model(pipeline, adapt=False)
    pipeline.events.where(late).select(*columns).write.parquet(f"{tmp_path}/late")
    state = replay.history_state(pipeline.events.where(~late))
    started = replay.replay_table(spark, f"{tmp_path}/late", pipeline.profiles, frozen, sensitivity=sensitivity_by_name(), initial=state)
    flagged = pipeline.events.select(*columns, (~late).alias("warm"))
    flagged.write.parquet(f"{tmp_path}/flagged")
    warm = replay.replay_table(
        spark, f"{tmp_path}/flagged", pipeline.profiles, frozen, sensitivity=sensitivity_by_name(), schema=flagged.schema
    )
    assert started.count() == warm.count() > 0
    same_results(started, warm)


def test_a_burst_of_failures_costs_the_same_per_event(spark, pipeline, make_events, tmp_path):
    """20,000 failures within the windows of one entity, read in two triggers."""
    path = str(tmp_path / "burst")
    for k in range(2):
        rows = [event(i, 10**5 * i, "ENT-BURST", auth_success=False) for i in range(10_000 * k, 10_000 * (k + 1))]
        make_events(rows).select(*OBSERVATION_SCHEMA.fieldNames()).coalesce(1).write.mode("append").parquet(path)
    out = replay.replay_table(spark, path, pipeline.profiles, model(pipeline, adapt=False), max_files=1).orderBy("event_id").collect()
    assert [out[i].failed_auth_5m for i in (0, 10, 5_000, 19_999)] == [0, 10, 3_000, 3_000]
    assert [out[i].event_count_60m for i in (1, 15_000, 19_999)] == [1, 15_000, 19_999]
    # the operator's own clock; a sum over the window at each event would take milliseconds
    assert sorted(r.latency_ms for r in out)[len(out) // 2] < 0.2


def test_learned_keys_fade_as_by_definition(spark, pipeline, make_events, tmp_path):
    """With a half-life of an hour keys are forgotten within two days."""
    quick = replace(DEFAULTS, ewma_halflife_days=1 / 24)
    everything = model(pipeline, adapt=True)
    everything = replace(everything, config=replace(quick, baseline_update_max_risk=1000.0, min_events_for_personal=0))
    # nine resources in turn, eight hours apart: each comes back after 72 half-lives
    hours = 3_600_000_000
    rows = [event(i, 8 * hours * i, "ENT-FADES", role="nobody", resource_accessed=f"view/{i % 9}") for i in range(60)]
    source = in_order(make_events(rows), f"{tmp_path}/in", 3)
    out = replay.replay_table(spark, source, pipeline.profiles, everything, sensitivity=sensitivity_by_name(), max_files=1)
    got = {r.event_id: r for r in out.collect()}
    names = ("hour", "location", "device", "resource", "auth", "transition")
    moments = {"duration_mean": 0.0, "duration_m2": 1.0, "bytes_mean": 0.0, "bytes_m2": 1.0, "auth_failure_rate": 0.0}
    moments |= {"baseline_latitude": rows[0]["latitude"], "baseline_longitude": rows[0]["longitude"]}
    seed = {"counts": {k: {} for k in names}, "moments": moments, "n": 0}
    checked = forgotten = 0
    for k in range(1, len(rows)):
        counts, _, n, _ = brute.adaptive(rows[:k], seed, 1 / 24)
        e, table = rows[k], counts["resource"]
        row = got[e["event_id"]]
        want = -math.log((round(table.get(e["resource_accessed"], 0.0)) + 1) / (round(n) + len(table) + 1))
        assert row.resource_rarity == pytest.approx(want, rel=1e-9)
        assert row.is_known_resource == float(e["resource_accessed"] in table)
        forgotten += len(table) < len({x["resource_accessed"] for x in rows[:k]})
        checked += 1
    assert checked > 30 and forgotten > 10
