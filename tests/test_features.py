import random
from dataclasses import replace


import brute
import pytest
from build import START, event

from sentrygrain.config import DEFAULTS, FEATURES
from sentrygrain.functions.scoring import micros
from sentrygrain.operators import features, prepare, profiles
from sentrygrain.plans import catalog
from sentrygrain.plans.pipeline import sensitivity_by_name

HOT = replace(DEFAULTS, chunk_rows=7, wide_profile_keys=2)
COLUMNS = ("event_count_5m", "event_count_60m", "failed_auth_5m", "failed_auth_30m", "recent_resource_breadth_24h")


def dense(seed=1, n=260):
    """One entity holds most rows, with ties, exact window edges and long gaps."""
    rng = random.Random(seed)
    rows, at = [], 0
    steps = [0, 0, 1, 250_000, 60_000_000, 300_000_000, 299_999_999, 300_000_001, 1_800_000_000, 3_600_000_000]
    for i in range(n):
        at += rng.choice(steps) if rng.random() < 0.97 else rng.choice([86_400_000_000, 86_400_000_001, 40 * 86_400_000_000])
        rows.append(
            event(
                rng.randrange(10**6) * 1000 + i,
                at,
                rng.choice(["ENT-1"] * 5 + ["ENT-2"]),
                auth_success=rng.random() < 0.5,
                resource_accessed=f"view/{rng.randrange(9)}",
                city=rng.choice(["Frankfurt", "London"]),
                latitude=rng.choice([50.1109, 51.5074]),
                device_mac=rng.choice(["mac-1", "mac-2"]),
                session_duration_s=rng.uniform(1, 500),
            )
        )
    return rows


@pytest.mark.parametrize("config", [DEFAULTS, HOT], ids=["whole", "split"])
def test_trailing_windows_match_definition(make_events, config):
    rows = dense()
    got = features.timeline_features(make_events(rows), config).collect()
    expected = brute.windows(rows)
    assert {r.event_id: tuple(r[c] for c in COLUMNS) for r in got} == {k: v[:5] for k, v in expected.items()}


def test_ties_and_inclusive_edges(make_events):
    rows = [event(i, 0, auth_success=False) for i in range(4)]
    rows += [event(4, 300_000_000), event(5, 300_000_001)]
    got = {r.event_id: r for r in features.timeline_features(make_events(rows)).collect()}
    counts = [got[f"EVT-{i:09d}"].event_count_5m for i in range(6)]
    assert counts == [0, 1, 2, 3, 4, 1]
    assert [got[f"EVT-{i:09d}"].failed_auth_30m for i in (3, 4, 5)] == [3, 4, 4]


def test_splitting_hot_keys_changes_nothing(make_events):
    rows = dense(seed=5)
    events = make_events(rows)
    cutoff = prepare.cutoff_micros(events)
    tables = []
    for config in (DEFAULTS, HOT):
        fitted = profiles.fit_profiles(events, cutoff, config)
        assert (fitted.wide_entity is not None) == (config is HOT)
        built = features.build_features(events, fitted, sensitivity_by_name(), config)
        tables.append({r.event_id: r for r in built.collect()})
    whole, split = tables
    assert whole.keys() == split.keys()
    for key, row in whole.items():
        assert [split[key][c] for c in FEATURES] == pytest.approx([row[c] for c in FEATURES], rel=1e-9, abs=1e-9)


def test_future_rows_change_no_earlier_feature(make_events):
    rows = dense(seed=9, n=120)
    rows.sort(key=lambda r: (r["timestamp"], r["event_id"]))
    events = make_events(rows)
    fitted = profiles.fit_profiles(events, prepare.cutoff_micros(events))
    late = [event(10**8 + i, 400 * 86_400_000_000 + i, "ENT-1", resource_accessed="x/1") for i in range(20)]
    before = {r.event_id: r for r in features.build_features(events, fitted).collect()}
    after = {r.event_id: r for r in features.build_features(make_events(rows + late), fitted).collect()}
    for key, row in before.items():
        assert [after[key][c] for c in FEATURES] == pytest.approx([row[c] for c in FEATURES], abs=1e-9)


def test_teleport_and_standstill(make_events):
    rows = [
        event(1, 0),
        event(2, 0, latitude=51.5074, longitude=-0.1278),
        event(3, 0, latitude=51.5074, longitude=-0.1278),
        event(4, 3_600_000_000),
    ]
    events = make_events(rows)
    none = profiles.fit_profiles(events, -1)
    got = {r.event_id[-1]: r for r in features.build_features(events, none).collect()}
    km = brute.haversine(50.1109, 8.6821, 51.5074, -0.1278)
    assert [got[i].geo_velocity_kmh for i in "123"] == [0.0, 100000.0, 0.0]
    assert got["4"].geo_velocity_kmh == pytest.approx(km)
    assert {r.profile_source for r in got.values()} == {"none"}
    assert all(r.session_duration_zscore == 0 for r in got.values())


def test_cold_start_uses_cohort_then_personal(make_events):
    rows = []
    for entity, n in (("ENT-0", 0), ("ENT-4", 4), ("ENT-5", 5)):
        rows += [event(len(rows) + i, i * 10_000_000, entity) for i in range(n)]
    rows += [event(900 + k, 10**12 + k, e) for k, e in enumerate(("ENT-0", "ENT-4", "ENT-5"))]
    rows += [event(950, 10**12 + 9, "ENT-X", role="unheard")]
    events = make_events(rows)
    fitted = profiles.fit_profiles(events, int(START.timestamp() * 1e6) + 10**9)
    got = features.build_features(events, fitted).where(micros_after(10**11)).collect()
    seen = {r.entity_id: (r.profile_source, r.profile_confidence) for r in got}
    assert seen == {"ENT-0": ("cohort", 0.0), "ENT-4": ("cohort", 0.8), "ENT-5": ("entity", 1.0), "ENT-X": ("none", 0.0)}


def micros_after(us):
    from pyspark.sql import functions as F

    return micros(F.col("timestamp")) > int(START.timestamp() * 1e6) + us


@pytest.mark.parametrize("config", [DEFAULTS, HOT], ids=["whole", "split"])
def test_deconflict_leaves_one_event_per_second(make_events, config):
    rng = random.Random(2)
    rows = [event(i, rng.randrange(60) * 1_000_000, rng.choice(["ENT-1"] * 4 + ["ENT-2"])) for i in range(150)]
    got = prepare.deconflict(make_events(rows), config).collect()
    assert len(got) == len({(r.entity_id, int(r.timestamp.timestamp())) for r in got}) == len(rows)
    for group in brute.by_entity(rows).values():
        free = 0
        times = {r.event_id: int(r.timestamp.timestamp()) for r in got}
        for r in group:
            free = max(free + 1, int(r["timestamp"].timestamp()))
            assert times[r["event_id"]] == free


def test_profile_counts_match_definition(make_events):
    rows = dense(seed=4, n=90)
    events = make_events(rows)
    for config in (DEFAULTS, HOT):
        keyed = profiles.with_transitions(events, profiles.cohort_key(), config)
        got = {(r.kind, r.value): r.n for r in profiles.count_values(keyed).collect()}
        ordered = sorted(rows, key=lambda r: (r["timestamp"], r["event_id"]))
        expected = brute.frozen(ordered)["counts"]
        assert got == {(k, v): n for k, table in expected.items() for v, n in table.items()}


def test_anchor_gaps_wait_for_the_horizon(make_events):
    rows = [event(1, 0), event(2, 60 * 90 * 1_000_000), event(3, 60 * 100 * 1_000_000, "ENT-2")]
    got = {r.event_id[-1]: r.next_gap_minutes for r in prepare.anchors(make_events(rows)).collect()}
    assert got == {"1": 90.0}



def test_joins_of_wide_kinds_move_no_profiles(make_events, monkeypatch):
    """Before, every event went through these joins with the maps of its profile."""
    events = make_events(dense(seed=6))
    fitted = profiles.fit_profiles(events, prepare.cutoff_micros(events), HOT)
    seen, joined = [], features._join_wide
    monkeypatch.setattr(features, "_join_wide", lambda rows, *rest: seen.append(rows.columns) or joined(rows, *rest))
    features.build_features(events, fitted, sensitivity_by_name(), HOT)
    assert seen and not {"profile", "_personal", "_cohort"} & set(seen[0])


def test_wide_kinds_of_a_cohort_reach_young_and_unknown_entities(make_events):
    """The key of the wide lookup is chosen as the profile is: own if mature, else the cohort's, else own or none."""
    train = [event(i, i * 10**9, "ENT-1", resource_accessed=f"view/{i % 5}") for i in range(40)]
    train += [event(40 + i, 40 * 10**9 + i * 10**9, "ENT-2", resource_accessed=f"view/{i}") for i in range(2)]
    late = [event(50 + i, 60 * 10**9 + i * 10**9, e, resource_accessed="view/1") for i, e in enumerate(["ENT-1", "ENT-2", "ENT-3"])]
    late.append(event(60, 90 * 10**9, "ENT-4", role="nobody", resource_accessed="view/1"))
    events = make_events(train + late)
    cutoff = 1_704_067_200_000_000 + 45 * 10**9
    tables = []
    for config in (DEFAULTS, HOT):
        fitted = profiles.fit_profiles(events, cutoff, config)
        assert (fitted.wide_cohort is not None) == (config is HOT)
        built = features.build_features(events, fitted, sensitivity_by_name(), config)
        tables.append({r.event_id: tuple(r[c] for c in (*FEATURES, "profile_source")) for r in built.collect()})
    assert tables[0] == tables[1]
    assert {r[-1] for r in tables[0].values()} == {"entity", "cohort", "none"}


def test_profile_rows_hold_wide_kinds(make_events):
    """A kind with more values than a map may hold is listed as a narrow one is, beside its profile's sizes."""
    rows = make_events([event(i, i * 60_000_000, f"ENT-{i % 2}", resource_accessed=f"view/{i % 5}") for i in range(40)])
    got = {}
    for config in (DEFAULTS, HOT):
        fitted = profiles.fit_profiles(rows, 10**18, config)
        for side, table, wide in (("entity", fitted.entity, fitted.wide_entity), ("cohort", fitted.cohort, fitted.wide_cohort)):
            assert (wide is not None) == (config is HOT)
            got[side, config is HOT] = sorted(map(tuple, catalog._map_rows(table, wide).collect()))
    assert got["entity", True] == got["entity", False] and got["cohort", True] == got["cohort", False]
    assert sum(n for *_, kind, _, n in got["cohort", True] if kind == "transition") == 40
