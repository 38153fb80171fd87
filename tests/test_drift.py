import random
from dataclasses import replace

import brute
import pytest
from build import event

from sentrygrain.config import DEFAULTS
from sentrygrain.contracts import ContractError
from sentrygrain.operators import drift, profiles

HOT = replace(DEFAULTS, chunk_rows=8, wide_profile_keys=2)
CUT_US = 10**12


def history(seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(160):
        at = rng.randrange(0, CUT_US) if i < 60 else CUT_US + 1 + (i - 60) * rng.choice([1, 10**9, 40 * 10**9])
        entity = rng.choice(["ENT-1"] * 4 + ["ENT-2"]) if i < 120 else rng.choice(["ENT-1", "ENT-NEW"])
        rows.append(
            event(
                i,
                at,
                entity,
                resource_accessed=f"view/{rng.randrange(6)}",
                auth_success=rng.random() < 0.8,
                session_duration_s=rng.uniform(1, 90),
                latitude=rng.uniform(-50, 50),
                auth_method=rng.choice(["SSO", "MFA"]),
            )
            | {"risk": rng.choice([5.0, 39.9, 40.0, 90.0])}
        )
    return rows


@pytest.mark.parametrize("config", [DEFAULTS, HOT], ids=["whole", "split"])
def test_closed_form_equals_replay(spark, make_events, config):
    rows = history()
    cutoff = int(brute_start().timestamp() * 1e6) + CUT_US
    events = make_events(rows)
    fitted = profiles.fit_profiles(events, cutoff, config)
    scores = spark.createDataFrame([(r["event_id"], r["risk"]) for r in rows], "event_id string, risk_score double")
    gated = drift.gate(drift.replayed(events, cutoff), scores, config)
    steps = drift.accepted_steps(gated, config)
    seed = drift.seeds(gated, fitted, config)
    got = {}
    for r in drift.decayed_counts(steps, seed, fitted, config).collect():
        got.setdefault(r.entity_id, {}).setdefault(r.kind, {})[r.value] = r.ewma_count
    totals = {r.entity_id: r for r in drift.decayed_moments(steps, seed, config).collect()}

    early = [r for r in rows if us(r) <= cutoff]
    late = [r for r in rows if us(r) > cutoff and r["risk"] < 40]
    groups = brute.by_entity(late)
    assert set(totals) == set(groups)
    for entity, accepted in groups.items():
        own = brute.by_entity(early).get(entity)
        seed_rows = own or sorted(early, key=lambda r: (r["timestamp"], r["event_id"]))
        counts, m, n, total = brute.adaptive(accepted, brute.frozen(seed_rows), config.ewma_halflife_days)
        for kind, table in counts.items():
            assert got[entity][kind] == pytest.approx(table, rel=1e-9)
        t = totals[entity]
        assert (t.n_events, t.total_transitions) == pytest.approx((n, total))
        for name, value in m.items():
            assert t[name] == pytest.approx(value, rel=1e-8, abs=1e-8)


def brute_start():
    from build import START

    return START


def us(r):
    return round(r["timestamp"].timestamp() * 1e6)


def test_every_replayed_event_needs_a_score(spark, make_events):
    events = make_events([event(1, 0), event(2, 1)])
    scores = spark.createDataFrame([("EVT-000000001", 1.0)], "event_id string, risk_score double")
    with pytest.raises(ContractError):
        drift.gate(events, scores)


def test_labels_never_open_the_gate(spark, make_events):
    rows = [event(1, 0, label="BRUTE_FORCE", is_attack=True), event(2, 1)]
    scores = spark.createDataFrame([("EVT-000000001", 39.0), ("EVT-000000002", 40.0)], "event_id string, risk_score double")
    got = {r.event_id[-1]: r.accepted for r in drift.gate(make_events(rows), scores).collect()}
    assert got == {"1": True, "2": False}


def test_rates_without_denominator_are_null(spark, make_events):
    scores = spark.createDataFrame([("EVT-000000001", 1.0)], "event_id string, risk_score double")
    row = drift.evaluate(drift.gate(make_events([event(1, 0)]), scores)).first()
    assert row.malicious_block_rate is None and row.update_rate == 1.0
