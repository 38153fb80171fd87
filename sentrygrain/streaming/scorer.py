"""Live scoring: one keyed stateful operator between two stateless plans.

Before it Catalyst looks up the frozen profiles; after it Catalyst explains the
scores with the batch expressions. Only the feedback loop is inside: features
depend on the adaptive profile, which depends on the risk of earlier events.
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import DEFAULTS, EARTH_RADIUS_KM, FEATURES, RULE_FEATURES, SEVERITIES, SEVERITY_UPPER, Config
from ..contracts import OBSERVATION_SCHEMA, check_columns, strip_labels
from ..functions.scoring import micros
from ..operators import risk as risk_plan
from ..operators.detectors import Scaler
from ..operators.forest import ForestScorer
from ..operators.profiles import KINDS, Profiles, as_struct, cohort_key, fingerprint, location
from ..sources import stages
from .state import DUE_SCHEMA, HEAD_FIELDS, HEAD_SCHEMA, MAPS, AdaptiveView, EntityMemory, Head, absorb, decoded, rounded, seeded_transition

SCALARS = (
    "n_events",
    "total_transitions",
    "duration_mean",
    "duration_m2",
    "bytes_mean",
    "bytes_m2",
    "auth_failure_rate",
    "baseline_latitude",
    "baseline_longitude",
)
VALUE_KINDS = tuple(k for k in KINDS if k != "transition")
RESULT_SCHEMA = (
    "event_id string, timestamp timestamp, entity_id string, entity_type string, "
    + ", ".join(f"{c} double" for c in FEATURES)
    + ", anomaly_score_raw double, baseline_rule double, decayed_state double, entity_evidence_state double, "
    "risk_score double, alerted boolean, alert_suppressed boolean, profile_updated boolean, "
    "profile_source string, profile_confidence double, late boolean, latency_ms double"
)
#: An event as it enters the operator: few columns, since each costs time for every entity and trigger.
PLAIN = ("latitude", "longitude", "session_duration_s", "bytes_transferred", "auth_success", "weekday", "sensitivity", "warm")
NULLABLE = [
    f"{side}_{name}"
    for side in ("own", "cohort")
    for name in (*SCALARS, *(f"keys_{k}" for k in KINDS), *(f"count_{k}" for k in VALUE_KINDS))
]
TEXTS = ("event_id", "entity_type", "v_hour", "v_location", "v_device", "v_resource", "v_auth")
LEVELS = ("own_levels", "cohort_levels")
ENTERS = ("at", "numbers", "texts", "own_arrivals", "cohort_arrivals")
#: A result as it leaves the operator: ``FEATURES`` and ``SCORES`` as numbers; flags are negative for a late event.
SCORES = ("anomaly_score_raw", "baseline_rule", "decayed_state", "entity_evidence_state", "risk_score", "profile_confidence", "latency_ms")
FLAGS = ("alerted", "alert_suppressed", "profile_updated")
LEAVES = "event_id string, at bigint, entity_id string, entity_type string, numbers array<double>, flags int, profile_source string"


class StreamOrderError(ValueError):
    """An event is older than what its entity already scored."""


@dataclass(frozen=True)
class LiveModel:
    """Fitted values the stateful operator needs; small and picklable."""

    rule: Scaler
    calibration: risk_plan.Calibration
    forest: ForestScorer | None = None
    config: Config = DEFAULTS
    adapt: bool = True
    strict: bool = False
    retention_hours: float = 0.0
    #: Learned keys that were not seen for so long, by the clock, leave the state; 0 keeps them until they fade.
    profile_ttl_hours: float = 0.0


def _arrivals(steps: DataFrame) -> DataFrame:
    """(key, resource, map of previous resource to count) of transitions (key, value, n)."""
    parts = F.split("value", "->", 2)
    steps = steps.select("key", parts[0].alias("before"), parts[1].alias("resource"), "n")
    return steps.groupBy("key", "resource").agg(F.map_from_entries(F.collect_list(F.struct("before", "n"))).alias("arrivals"))


def _levels(profile: DataFrame, wide: DataFrame | None) -> DataFrame:
    """(key, levels): JSON of kind -> count -> number of values with that count.

    With it the live path knows how many values of a faded profile are left, without their names.
    """

    def counted(kind: str) -> Column:  # a second argument of the lambda would be the element's index
        return F.transform(F.map_values(f"{kind}_counts"), lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("n")))

    counts = profile.select("key", F.inline(F.flatten(F.array(*map(counted, KINDS)))))
    if wide is not None:
        counts = counts.unionByName(wide.select("key", "kind", "n"))
    sizes = counts.groupBy("key", "kind", "n").agg(F.count(F.lit(1)).alias("keys"))
    entry = F.struct(F.col("n").cast("string"), "keys")
    kinds = sizes.groupBy("key", "kind").agg(F.map_from_entries(F.collect_list(entry)).alias("of"))
    return kinds.groupBy("key").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("kind", "of")))).alias("levels"))


@dataclass(frozen=True)
class _Lookup:
    """One side's profiles as the live path reads them, stored once."""

    #: Scalars, maps of the narrow kinds, levels, and resource -> previous resource -> count.
    rows: DataFrame
    #: Of each wide kind (key, value, found): an event's own count, or its resource's map of previous resources.
    wide: dict[str, DataFrame]


def _lookup(profile: DataFrame, wide: DataFrame | None) -> _Lookup:
    spread = profile.repartition("key")  # the groupings below then move nothing
    steps = _arrivals(spread.select("key", F.explode("transition_counts").alias("value", "n")))
    arrivals = steps.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("resource", "arrivals"))).alias("arrivals"))
    kept = profile.drop("transition_counts")
    rows = stages.save(kept.join(_levels(spread, wide), "key", "left").join(arrivals, "key", "left"))
    if wide is None:
        return _Lookup(rows, {})
    tables = {}
    for kind in [r.kind for r in wide.select("kind").distinct().collect()]:  # at most as many as KINDS
        own = wide.where(F.col("kind") == kind)
        if kind == "transition":
            tables[kind] = stages.save(_arrivals(own).toDF("key", "value", "found"))
        else:
            tables[kind] = own.select("key", "value", F.col("n").cast("double").alias("found"))
    return _Lookup(rows, tables)


def prepare(events: DataFrame, profiles: Profiles, sensitivity=None) -> DataFrame:
    """Stateless half: each event with its frozen profile's counts and moments.

    ``own_*`` is the entity's profile, ``cohort_*`` its cohort's; works on a
    static or a streaming table (stream-static joins). Events move to their entity's task
    while they are short, by the join with its profile; what the profiles add moves no more.
    """
    check_columns(events, require_labels=False)
    warm = [F.col("warm")] if "warm" in events.columns else [F.lit(False).alias("warm")]
    observed = strip_labels(events, "inference").select(*OBSERVATION_SCHEMA.fieldNames(), *warm)
    rows = observed.withColumns(
        {
            "at": micros(F.col("timestamp")),
            "v_hour": F.hour("timestamp").cast("string"),
            "v_location": location(),
            "v_device": fingerprint(),
            "v_resource": F.col("resource_accessed"),
            "v_auth": F.col("auth_method"),
            "cohort": cohort_key(),
            "weekday": F.weekday("timestamp"),
            "sensitivity": F.coalesce(F.lit(1.0) if sensitivity is None else sensitivity, F.lit(1.0)),
        }
    )
    if not profiles.live:
        profiles.live["own"] = _lookup(profiles.entity, profiles.wide_entity)
        profiles.live["cohort"] = _lookup(profiles.cohort, profiles.wide_cohort)
    sides = [(side, key, profiles.live[side]) for side, key in (("own", "entity_id"), ("cohort", "cohort"))]
    for side, key, held in sides:
        for kind, table in held.wide.items():
            value = "v_resource" if kind == "transition" else f"v_{kind}"
            table = table.withColumnsRenamed({"key": key, "value": value, "found": f"_{side}_{kind}"})
            rows = rows.join(table, [key, value], "left")
    rows = rows.repartition("entity_id")
    for side, key, held in sides:
        profile = as_struct(held.rows, "_p", key)
        # merged, so that only the short rows are put into the order of entities
        rows = rows.join(profile.hint("merge") if side == "own" else profile, key, "left")
        p = F.col("_p")
        looked = {f"{side}_{c}": p[c].cast("double") for c in SCALARS if not c.endswith("_m2")}
        looked |= {f"{side}_{m}_m2": F.pow(p[f"{m}_std"], 2) for m in ("duration", "bytes")}
        looked |= {f"{side}_keys_{k}": p[f"{k}_keys"] for k in KINDS} | {f"{side}_levels": p["levels"]}
        for k in VALUE_KINDS:
            looked[f"{side}_count_{k}"] = F.try_element_at(p[f"{k}_counts"], F.col(f"v_{k}")).cast("double")
        looked[f"{side}_arrivals"] = F.try_element_at(p["arrivals"], F.col("v_resource"))
        for kind in held.wide:
            name = f"{side}_arrivals" if kind == "transition" else f"{side}_count_{kind}"
            looked[name] = F.coalesce(looked[name], F.col(f"_{side}_{kind}"))
        rows = rows.withColumns(looked).drop("_p", *[f"_{side}_{kind}" for kind in held.wide])
    return rows


def _ramp(v: float, low: float, high: float) -> float:
    if high <= low:
        return 1.0 if v > low else 0.0
    return min(1.0, max(0.0, (v - low) / (high - low)))


def _evidence(f: dict, raw: float, rule: float, m: LiveModel) -> float:
    """Instantaneous evidence of one event; the same terms as the batch columns."""
    cal, risk = m.calibration, m.config.risk
    t = cal.thresholds
    if raw <= cal.forest_floor:
        forest = 0.0
    elif raw <= t["sensitive"]:
        forest = 0.25 * _ramp(raw, cal.forest_floor, t["sensitive"])
    elif raw <= t["balanced"]:
        forest = 0.25 + 0.25 * _ramp(raw, t["sensitive"], t["balanced"])
    elif raw <= t["strict"]:
        forest = 0.5 + 0.25 * _ramp(raw, t["balanced"], t["strict"])
    else:
        forest = 0.75 + 0.25 * (1.0 - math.exp(-(raw - t["strict"]) / max(t["strict"] - t["balanced"], 1e-9)))
    excess = max(0.0, rule - cal.rule_low) / max(cal.rule_high - cal.rule_low, 1e-9)
    total = risk.forest_weight * forest + risk.rule_weight * (1.0 - math.exp(-excess))
    for s in risk.signals:
        v = f[s.features[0]]
        if s.mode == "boolean":
            on = min(1.0, max(0.0, v))
        elif s.mode == "inverse_boolean":
            on = min(1.0, max(0.0, 1.0 - v))
        elif s.mode == "fixed_ramp":
            on = _ramp(v, s.low, s.high)
        elif s.mode == "abs_ramp":
            on = _ramp(abs(v), *cal.anchors[s.features[0]])
        else:
            on = min(_ramp(f[c], *cal.anchors[c]) for c in s.features)
        total += s.weight * on
    return total


def _km(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    a, b = math.radians(lat1), math.radians(lat2)
    h = math.sin(math.radians(lat2 - lat1) / 2) ** 2
    h += math.cos(a) * math.cos(b) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2.0 * EARTH_RADIUS_KM * math.asin(math.sqrt(min(1.0, max(0.0, h))))


class EntityScorer(StatefulProcessor):
    """Scores one entity's events in order and keeps its memory."""

    def __init__(self, model: LiveModel):
        self.model = model

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = {"learned": int(self.model.profile_ttl_hours * 3_600_000) or None}
        self.head = handle.getValueState("head", HEAD_SCHEMA)
        self.states = {name: handle.getMapState(name, *schemas, ttl.get(name)) for name, schemas in MAPS.items()}
        self.states["due"] = handle.getListState("due", DUE_SCHEMA)

    def close(self) -> None:
        pass

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        due = []
        for part, payload in zip(initialState["part"], initialState["payload"], strict=True):
            own, value = decoded(part, payload)
            if part == "head":
                self.head.update(value)
            elif part == "due":
                due.append(value)
            else:
                self.states[part].updateValue(own, value)
        if due:
            self.states["due"].appendList(due)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = _records(rows, self.model.adapt)
        kept = self.head.get()
        head = None if kept is None else Head(*[list(v) if isinstance(v, list) else v for v in kept])
        memory = EntityMemory(head, self.states)
        out = [(r[0], r[1], key[0], *r[2:]) for r in (self._one(memory, e) for e in events) if r is not None]
        memory.flush()
        self.head.update(tuple(getattr(memory.head, name) for name in HEAD_FIELDS))
        if out:
            yield pd.DataFrame(out, columns=[part.split()[0] for part in LEAVES.split(", ")])

    def _one(self, memory: EntityMemory, e: dict) -> tuple | None:
        began = time.perf_counter()
        m, config, h = self.model, self.model.config, memory.head
        late = h.last_at is not None and (e["at"], e["event_id"]) < (h.last_at, h.last_id)
        if late:
            if m.strict:
                raise StreamOrderError(f"event {e['event_id']} is older than its entity's last event")
            return e["event_id"], e["at"], e["entity_type"], None, -1, None
        recent = self._recent(memory, e)
        if e["warm"]:
            memory.commit(e)
            return None
        features, source, confidence, values = self._features(memory, e, recent)
        x = [features[c] for c in FEATURES]
        rule = sum((features[c] - m.rule.mean[c]) / m.rule.std[c] for c in RULE_FEATURES)
        raw = float(m.forest.score(np.array([x]))[0]) if m.forest else 1.0 / (1.0 + math.exp(-rule / 6.0))
        now = _evidence(features, raw, rule, m)
        risk = config.risk
        waited = 0 if h.last_at is None else max(0, e["at"] - h.last_at) / 1e6
        decayed = h.evidence * 0.5 ** (waited / risk.halflife_seconds) if risk.halflife_seconds > 0 else 0.0
        score = 100.0 * (1.0 - math.exp(-max(0.0, now + risk.persistence_weight * decayed) / risk.evidence_scale))
        h.evidence = min(decayed + now, risk.state_cap)
        rank = next((i for i, s in enumerate(SEVERITIES, 1) if score <= SEVERITY_UPPER[s]), len(SEVERITIES))
        alerted = suppressed = False
        if rank >= SEVERITIES.index(risk.min_severity) + 1:
            quiet = h.alert_at is None or e["at"] - h.alert_at >= risk.cooldown_seconds * 1e6
            alerted = quiet or (risk.escalation_bypasses_cooldown and rank > h.alert_rank)
            suppressed = not alerted
        if alerted:
            h.alert_at, h.alert_rank = e["at"], rank
        updated = m.adapt and score < config.baseline_update_max_risk
        if updated:
            absorb(memory, e, values, config, m.profile_ttl_hours > 0)
        memory.commit(e)
        flags = alerted + 2 * suppressed + 4 * updated
        numbers = [*x, raw, rule, decayed, h.evidence, score, confidence, (time.perf_counter() - began) * 1000.0]
        return e["event_id"], e["at"], e["entity_type"], numbers, flags, source

    def _recent(self, memory: EntityMemory, e: dict) -> list[float]:
        """Events and failures in their windows, distinct resources; forgets what no window reaches."""
        config = self.model.config
        keep_us = max(*config.count_windows_s, *config.failed_windows_s) * 1_000_000
        breadth_us = config.breadth_window_s * 1_000_000
        if self.model.retention_hours > 0:
            limit = int(self.model.retention_hours * 3600e6)
            keep_us, breadth_us = min(keep_us, limit), min(breadth_us, limit)
        widths = [w * 1_000_000 for w in (*config.count_windows_s, *config.failed_windows_s)]
        a, b, c, d = memory.counted(e["at"], widths, keep_us)
        breadth = memory.breadth(e["at"], config.breadth_window_s * 1_000_000, breadth_us)
        return [float(v) for v in (a[0], b[0], c[1], d[1], breadth)]

    def _features(self, memory: EntityMemory, e: dict, recent: list[float]):
        config, h = self.model.config, memory.head
        s, minimum = config.smoothing, config.min_events_for_personal
        previous = h.last_at is not None
        before = h.resource if previous else None
        view = AdaptiveView(memory, e, config)
        # Which profile judges this event, and how far it can be trusted.
        if self.model.adapt:
            personal = view.n_events() if view.exists() else None
        else:
            personal = e["own_n_events"]
        has_cohort = e["cohort_n_events"] is not None
        if personal is not None and personal >= minimum:
            source, confidence = "entity", 1.0
        elif has_cohort:
            source, confidence = "cohort", min(1.0, (personal or 0.0) / minimum)
        else:
            source, confidence = "none", 0.0
        values = {k: e[f"v_{k}"] for k in VALUE_KINDS} | {"transition": before}
        if source == "cohort":
            look = _Frozen(e, "cohort")
        elif personal is None:
            look = _Nothing(e)
        elif self.model.adapt:
            look = _Adaptive(view, e)
        else:
            look = _Frozen(e, "own")
        n, total = look.n_events(), look.total()
        found = {k: look.count(k, values[k]) for k in VALUE_KINDS}
        arrived = look.transition(before)
        rar = lambda k: -math.log(((found[k] or 0) + s) / (n + s * (look.keys(k) + 1)))
        probability = ((arrived or 0) + s) / (total + s * (look.keys("transition") + 1))
        gap = (e["at"] - h.last_at) / 1e6 if previous else 0.0
        moved = _km(h.latitude, h.longitude, e["latitude"], e["longitude"]) if previous else 0.0
        if gap > 0:
            speed = min(config.velocity_cap_kmh, moved * 3600.0 / gap)
        else:
            speed = config.velocity_cap_kmh if previous and moved > 0 else 0.0
        z = lambda name, v: (v - look.moment(f"{name}_mean")) / max(look.std(name), config.std_floor)
        features = {
            "hour": float(e["v_hour"]),
            "day_of_week": float(e["weekday"]),
            "is_weekend": float(e["weekday"] >= 5),
            "inter_event_gap_s": gap,
            "event_count_5m": recent[0],
            "event_count_60m": recent[1],
            "failed_auth_5m": recent[2],
            "failed_auth_30m": recent[3],
            "login_hour_rarity": rar("hour"),
            "is_entity_off_hours": float(not found["hour"]),
            "location_rarity": rar("location"),
            "is_new_location": float(found["location"] is None),
            "geo_distance_from_baseline_km": _km(
                look.moment("baseline_latitude"), look.moment("baseline_longitude"), e["latitude"], e["longitude"]
            ),
            "geo_distance_from_previous_km": moved,
            "geo_velocity_kmh": speed,
            "is_known_device": float(found["device"] is not None),
            "device_rarity": rar("device"),
            "fingerprint_changed": float(previous and h.fp != e["v_device"]),
            "is_known_resource": float(found["resource"] is not None),
            "resource_rarity": rar("resource"),
            "resource_sensitivity": e["sensitivity"],
            "recent_resource_breadth_24h": recent[4],
            "auth_method_rarity": rar("auth"),
            "auth_failure_deviation": float(not e["auth_success"]) - look.moment("auth_failure_rate"),
            "session_duration_zscore": z("duration", e["session_duration_s"]),
            "transfer_volume_zscore": z("bytes", e["bytes_transferred"]),
            "transition_probability": probability,
            "sequence_anomaly_score": -math.log(probability),
        }
        return features, source, confidence, values


class _Frozen:
    """A frozen profile as looked up for this event."""

    def __init__(self, e: dict, side: str):
        self.e, self.side = e, side

    def n_events(self):
        return self.e[f"{self.side}_n_events"]

    def total(self):
        return self.e[f"{self.side}_total_transitions"]

    def keys(self, kind):
        return self.e[f"{self.side}_keys_{kind}"] or 0

    def count(self, kind, value):
        return self.e[f"{self.side}_count_{kind}"]

    def transition(self, before):
        return seeded_transition(self.e, before, self.side)

    def moment(self, name):
        return self.e[f"{self.side}_{name}"]

    def std(self, name):
        return math.sqrt(max(0.0, self.e[f"{self.side}_{name}_m2"]))


class _Adaptive(_Frozen):
    """The adaptive profile rounded to whole counts, as a snapshot shows it."""

    def __init__(self, view: AdaptiveView, e: dict):
        super().__init__(e, "seed")
        self.view = view

    def n_events(self):
        return rounded(self.view.n_events())

    def total(self):
        return rounded(self.view.total())

    def keys(self, kind):
        return self.view.keys(kind)

    def count(self, kind, value):
        found = self.view.count(kind, value, self.e[f"seed_count_{kind}"])
        return None if found is None else rounded(found)

    def transition(self, before):
        name = f"{'<START>' if before is None else before}->{self.e['resource_accessed']}"
        found = self.view.count("transition", name, seeded_transition(self.e, before, "seed"))
        return None if found is None else rounded(found)

    def moment(self, name):
        return self.view.moment(name)

    def std(self, name):
        return math.sqrt(max(0.0, self.view.moment(f"{name}_m2")))


class _Nothing(_Frozen):
    """No profile at all: the event's own values are the baseline."""

    def __init__(self, e: dict):
        super().__init__(e, "none")
        self.own = {
            "duration_mean": e["session_duration_s"],
            "bytes_mean": e["bytes_transferred"],
            "auth_failure_rate": 0.0,
            "baseline_latitude": e["latitude"],
            "baseline_longitude": e["longitude"],
        }

    def n_events(self):
        return 0

    def total(self):
        return 0

    def keys(self, kind):
        return 0

    def count(self, kind, value):
        return None

    def transition(self, before):
        return None

    def moment(self, name):
        return self.own[name]

    def std(self, name):
        return 1.0


def _records(frames: Iterator[pd.DataFrame], adapt: bool) -> Iterator[dict]:
    """Events in order, as dicts with None for missing; ``seed_*`` is chosen if profiles adapt: own, else cohort."""
    rows = [row for frame in frames for row in zip(*[frame[c].tolist() for c in ENTERS], strict=True)]
    rows.sort(key=lambda row: (row[0], row[2][0]))
    texts = (*TEXTS, *(LEVELS if adapt else ()))
    for at, numbers, words, own, cohort in rows:
        e = dict(zip(texts, words, strict=True))
        numbers = numbers.tolist()
        e.update(zip(PLAIN, numbers))
        e.update(zip(NULLABLE, [None if v != v else v for v in numbers[len(PLAIN) :]], strict=True))  # NaN stands for NULL
        e["at"], e["fp"], e["resource_accessed"] = at, e["v_device"], e["v_resource"]
        e["own_arrivals"], e["cohort_arrivals"] = own, cohort
        if adapt:
            side = "own" if e["own_n_events"] is not None else "cohort"
            for seed, names in SEEDS.items():
                e[seed] = e[names[side]]
        yield e


SEEDS = {
    f"seed_{name}": {side: f"{side}_{name}" for side in ("own", "cohort")}
    for name in (*SCALARS, *(f"keys_{k}" for k in KINDS), *(f"count_{k}" for k in VALUE_KINDS), "arrivals", "levels")
}


def _packed(prepared: DataFrame, adapt: bool) -> DataFrame:
    """The columns ``ENTERS`` beside the entity."""
    known = F.coalesce("auth_success", F.lit(False)).cast("double")  # unknown counts as failed
    numbers = [known if c == "auth_success" else F.col(c).cast("double") for c in (*PLAIN, *NULLABLE)]
    texts = F.array(*TEXTS, *(LEVELS if adapt else ()))
    return prepared.select("entity_id", "at", F.array(*numbers).alias("numbers"), texts.alias("texts"), "own_arrivals", "cohort_arrivals")


def _unpacked(results: DataFrame) -> DataFrame:
    """Rows of ``RESULT_SCHEMA``."""
    late = F.col("flags") < 0
    named = {"timestamp": F.timestamp_micros("at"), "late": late}
    named |= {c: F.col("numbers")[i] for i, c in enumerate((*FEATURES, *SCORES))}
    named |= {c: F.when(~late, F.col("flags").bitwiseAND(1 << i) != 0) for i, c in enumerate(FLAGS)}
    return results.select(*[named[c].alias(c) if c in named else c for c in (part.split()[0] for part in RESULT_SCHEMA.split(", "))])


def score_stream(prepared: DataFrame, model: LiveModel, initial: DataFrame | None = None) -> DataFrame:
    """Stateful half: one result row per event, plus flagged late events.

    ``initial`` has rows of state (entity_id, part, payload) that a new run starts from.
    """
    results = _packed(prepared, model.adapt).groupBy("entity_id").transformWithStateInPandas(
        statefulProcessor=EntityScorer(model),
        outputStructType=LEAVES,
        outputMode="Append",
        timeMode="ProcessingTime" if model.profile_ttl_hours > 0 else "None",
        initialState=None if initial is None else initial.select("entity_id", "part", "payload").groupBy("entity_id"),
    )
    return _unpacked(results)
