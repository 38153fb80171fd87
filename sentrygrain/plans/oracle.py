"""ANSI SQL equal to the registered queries, for DuckDB on the same tables.

Each query is a SELECT over a few common table expressions, which restate the
semantics from the definitions (self joins, recursion), not from the Spark plans.
"""

from __future__ import annotations

from ..config import (
    ATTACKS,
    BUDGET_FRACTIONS,
    FEATURES,
    FPR_TARGETS,
    HARD_CATEGORIES,
    LABELS,
    MALICIOUS,
    OPERATING_POINTS,
    RULE_FEATURES,
    SEVERITIES,
)
from ..operators.analyst import (
    ATTACK_NAMES,
    COMPONENT_NAMES,
    ENTITY_TYPE_NAMES,
    REASON_NAMES,
    SCORE_NAMES,
)
from .catalog import FEATURE_IDS

CTES: dict[str, tuple[tuple[str, ...], str]] = {}
ORACLE: dict[str, str] = {}


def cte(name: str, needs: str, body: str) -> None:
    CTES[name] = (tuple(needs.split()), body)


def _chain(needs: tuple[str, ...], seen: list[str]) -> list[str]:
    for name in needs:
        if name not in seen:
            _chain(CTES[name][0], seen)
            seen.append(name)
    return seen


def sql(needs: str, body: str, recursive: str = "") -> str:
    names = _chain(tuple(needs.split()), [])
    # A recursive part cannot be materialised; everything before it is.
    parts = [
        f"{n} AS {CTES[n][1]}" if CTES[n][1].startswith("(WITH") else f"{n} AS MATERIALIZED ({CTES[n][1]})"
        for n in names
    ]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


def check(name: str, needs: str, body: str) -> None:
    ORACLE[name] = sql(needs, body)


def r(*columns: str, digits: int = 6) -> str:
    """Rounded columns; ``a=expr`` names an expression."""
    out = []
    for c in columns:
        alias, _, expression = c.partition("=")
        out.append(f"round({expression or alias}, {digits}) + 0.0 AS {alias}")
    return ", ".join(out)


def q(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def case(column: str, names: dict[str, str], otherwise: str | None = None) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in names.items())
    return f"CASE {column} {arms} ELSE {otherwise or column} END"


TS = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"
ts = TS.format
TS_COLUMN = f"{ts('timestamp')} AS timestamp"
BAD = f"({q(MALICIOUS)})"

# -- events ------------------------------------------------------------------------------------
cte(
    "ae",
    "",
    """
SELECT 'EVT-' || lpad(event_id::VARCHAR, 9, '0') AS event_id, ts AS timestamp, epoch_us(ts) AS us,
  'ENT-' || lpad(user_id::VARCHAR, 6, '0') AS entity_id,
  CASE WHEN user_id % 10 < 7 THEN 'user' WHEN user_id % 10 < 9 THEN 'service_account' ELSE 'edge_device' END AS entity_type,
  CASE user_id % 3 WHEN 0 THEN 'developer' WHEN 1 THEN 'finance' ELSE 'it_admin' END AS role,
  '10.' || (user_id % 250)::VARCHAR || '.' || site::VARCHAR || '.1' AS source_ip,
  CASE WHEN site < 2 THEN 'India' WHEN site < 4 THEN 'United States' WHEN site = 4 THEN 'United Kingdom' ELSE 'Germany' END AS country,
  CASE site WHEN 0 THEN 'Chennai' WHEN 1 THEN 'Bangalore' WHEN 2 THEN 'Atlanta' WHEN 3 THEN 'Charlotte' WHEN 4 THEN 'London' ELSE 'Frankfurt' END AS city,
  (CASE site WHEN 0 THEN 13.0827 WHEN 1 THEN 12.9716 WHEN 2 THEN 33.7490 WHEN 3 THEN 35.2271 WHEN 4 THEN 51.5074 ELSE 50.1109 END)::DOUBLE AS latitude,
  (CASE site WHEN 0 THEN 80.2707 WHEN 1 THEN 77.5946 WHEN 2 THEN -84.3880 WHEN 3 THEN -80.8431 WHEN 4 THEN -0.1278 ELSE 8.6821 END)::DOUBLE AS longitude,
  CASE user_id % 3 WHEN 0 THEN 'SSO' WHEN 1 THEN 'MFA' ELSE 'SSH_KEY' END AS auth_method,
  event_type <> 'error' AS auth_success,
  event_type || '/' || (k % 4)::VARCHAR AS resource_accessed,
  upper(event_type) AS action, upper(event_type) AS command_sequence,
  value::DOUBLE AS session_duration_s, (value * 1024)::DOUBLE AS bytes_transferred,
  'DEV-' || user_id::VARCHAR || '-' || CASE WHEN k % 25 = 0 THEN '2' ELSE '1' END AS device_id,
  'Linux' AS device_os, 'N/A' AS device_firmware, 'HTTPS' AS device_protocol,
  'mac-' || user_id::VARCHAR || '-' || CASE WHEN k % 25 = 0 THEN '2' ELSE '1' END AS device_mac,
  label, label NOT IN ('BENIGN', 'INSIDER_DRIFT') AS is_attack,
  CASE WHEN label <> 'BENIGN' THEN 'CMP-' || label || '-' || (user_id % 5)::VARCHAR END AS campaign_id,
  (user_id % 5) % 3 = 0 AS stealthy
FROM (SELECT *, CASE WHEN k < 90 THEN user_id % 6 ELSE (user_id + k) % 6 END AS site,
  CASE WHEN event_type = 'error' AND k >= 95 THEN 'BRUTE_FORCE'
       WHEN event_type = 'purchase' AND k >= 97 THEN 'LOW_AND_SLOW_EXFILTRATION'
       WHEN event_type = 'view' AND k >= 98 THEN 'LATERAL_MOVEMENT'
       WHEN event_type = 'click' AND k >= 98 THEN 'IMPOSSIBLE_TRAVEL'
       WHEN event_type = 'signup' AND k = 99 THEN 'INSIDER_DRIFT' ELSE 'BENIGN' END AS label
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))""",
)
cte("camp", "ae", "SELECT DISTINCT campaign_id, label AS attack_type, stealthy FROM ae WHERE campaign_id IS NOT NULL")
cte(
    "cut",
    "ae",
    """SELECT us AS cutoff FROM (SELECT us, row_number() OVER (ORDER BY us, event_id) AS rn, count(*) OVER () AS n FROM ae)
WHERE rn = greatest(1, floor(n * 0.7::DOUBLE)::BIGINT)""",
)
OBSERVED = (
    "event_id, {ts} AS timestamp, entity_id, entity_type, role, source_ip, country, city, "
    "round(latitude, 6) + 0.0 AS latitude, round(longitude, 6) + 0.0 AS longitude, auth_method, "
    "auth_success::BIGINT AS auth_success, resource_accessed, action, command_sequence, "
    "round(session_duration_s, 6) + 0.0 AS session_duration_s, round(bytes_transferred, 6) + 0.0 AS bytes_transferred, "
    "device_id, device_os, device_firmware, device_protocol, device_mac"
).format(ts=ts("timestamp"))
check("a01_event_scan", "ae", f"SELECT {OBSERVED}, label, is_attack::BIGINT AS is_attack, campaign_id FROM ae")
check(
    "a02_campaign_document",
    "ae",
    """SELECT DISTINCT campaign_id, label AS attack_type, stealthy::BIGINT AS stealthy, entity_id
FROM ae WHERE campaign_id IS NOT NULL""",
)
ORACLE["a02_campaign_list"] = ORACLE["a02_campaign_document"]
check(
    "a03_roster",
    "ae",
    """SELECT DISTINCT entity_id, entity_type, NULL::VARCHAR AS role, NULL::VARCHAR AS department,
NULL::VARCHAR AS home_city, NULL::VARCHAR AS home_country FROM ae""",
)
ORACLE |= {f"a03_roster_{form}": ORACLE["a03_roster"] for form in ("wrapped", "list", "map")}
check(
    "a04_normalise_events",
    "ae",
    f"""SELECT event_id, {ts("timestamp")} AS timestamp, entity_id, entity_type, source_ip, city, country, resource_accessed,
auth_method, auth_success::BIGINT AS auth_success, {r("session_duration=session_duration_s")}, device_id,
{r("latitude", "longitude", "bytes_transferred")}, device_mac, role FROM ae""",
)
check(
    "a05_feature_sink",
    "ae cut",
    "SELECT CASE WHEN us <= cutoff THEN 'train' ELSE 'evaluation' END AS split, count(*) AS n FROM ae, cut GROUP BY 1",
)
check(
    "a06_validate",
    "ae",
    f"""SELECT count(*) AS n_rows, count(*) FILTER (event_id IS NULL) AS null_event_ids,
count(*) FILTER (timestamp IS NULL) AS null_timestamps, count(*) FILTER (label NOT IN ({q(LABELS)})) AS unknown_labels,
max((us < before)::BIGINT) AS out_of_order
FROM (SELECT *, coalesce(lag(us) OVER (ORDER BY event_id), us) AS before FROM ae)""",
)
_OBSERVED_NAMES = (
    "event_id timestamp entity_id entity_type role source_ip country city latitude longitude auth_method auth_success "
    "resource_accessed action command_sequence session_duration_s bytes_transferred device_id device_os "
    "device_firmware device_protocol device_mac"
).split()
check(
    "a07_label_free_columns",
    "ae",
    " UNION ALL ".join(f"SELECT '{c}' AS observed_column, count({c}) AS n FROM ae" for c in _OBSERVED_NAMES),
)
check(
    "a11_live_overlay",
    "ae",
    f"""SELECT event_id, entity_id, {TS_COLUMN} FROM ae WHERE label = 'BENIGN' UNION ALL
SELECT event_id, entity_id, {TS_COLUMN} FROM (SELECT * FROM ae WHERE label <> 'BENIGN' ORDER BY ae.timestamp DESC, event_id DESC LIMIT 500)""",
)

# -- preparation ---------------------------------------------------------------------------------
check(
    "b01_event_ids",
    "ae",
    f"""SELECT event_id AS old_id, 'EVT-' || lpad((row_number() OVER (ORDER BY us, entity_id, event_id))::VARCHAR, 9, '0') AS event_id,
entity_id, {TS_COLUMN} FROM ae""",
)
cte(
    "crowded",
    "ae",
    """SELECT event_id, entity_id, label, sec + greatest(0, 0) AS sec0,
  i + max(sec - i) OVER (PARTITION BY entity_id ORDER BY i) AS sec
FROM (SELECT *, epoch_us(date_trunc('hour', timestamp)) // 1000000 AS sec,
  row_number() OVER (PARTITION BY entity_id ORDER BY date_trunc('hour', timestamp), event_id) AS i FROM ae)""",
)
check("b02_deconflict", "crowded", f"SELECT event_id, entity_id, {ts('make_timestamp(sec * 1000000)')} AS timestamp FROM crowded")
check(
    "b03_merge_streams",
    "crowded",
    f"""SELECT 'EVT-' || lpad((row_number() OVER (ORDER BY sec, entity_id, event_id))::VARCHAR, 9, '0') AS event_id,
entity_id, {ts("make_timestamp(sec * 1000000)")} AS timestamp, label FROM crowded""",
)
check(
    "b04_anchors",
    "ae",
    f"""SELECT event_id, entity_id, {r("latitude", "longitude", "next_gap_minutes")} FROM (
SELECT *, (coalesce(lead(us) OVER (PARTITION BY entity_id ORDER BY us, event_id), max(us) OVER ()) - us) / 60e6 AS next_gap_minutes
FROM ae WHERE label = 'BENIGN') WHERE next_gap_minutes >= 90""",
)
check(
    "b05_experienced_entities",
    "ae",
    """SELECT entity_id, n_events FROM (SELECT *, bool_or(n_events >= 65) OVER () AS a FROM (
SELECT entity_id, count(*) AS n_events FROM ae WHERE entity_type = 'user' AND role = 'finance' GROUP BY 1))
WHERE n_events >= 65 OR NOT a""",
)
check(
    "b06_dataset_summary",
    "ae",
    """SELECT count(*) AS total_rows, count(DISTINCT entity_id) AS unique_entities,
count(DISTINCT entity_id) FILTER (entity_type = 'user') AS users,
count(DISTINCT entity_id) FILTER (entity_type = 'service_account') AS service_accounts,
count(DISTINCT entity_id) FILTER (entity_type = 'edge_device') AS edge_devices,
strftime(min(timestamp), '%Y-%m-%d %H:%M:%S') AS date_min, strftime(max(timestamp), '%Y-%m-%d %H:%M:%S') AS date_max,
date_diff('day', min(timestamp)::DATE, max(timestamp)::DATE) + 1 AS span_days,
count(*) - count(DISTINCT (entity_id, timestamp)) AS duplicate_entity_timestamps,
round(1.0 - avg(auth_success::INT), 4) + 0.0 AS auth_failure_rate, count(DISTINCT resource_accessed) AS distinct_resources,
count(*) FILTER (label <> 'BENIGN') AS attack_rows, round(avg((label <> 'BENIGN')::INT), 5) + 0.0 AS attack_prevalence,
count(*) FILTER (is_attack) AS malicious_rows, count(DISTINCT campaign_id) AS campaigns_present FROM ae""",
)
check("b07_label_counts", "ae", "SELECT label, count(*) AS n FROM ae GROUP BY 1")
check(
    "b08_median_session_events",
    "ae",
    """SELECT quantile_cont(size, 0.5)::DOUBLE AS median_session_events, count(*) AS n_sessions
FROM (SELECT count(*) AS size FROM ae GROUP BY entity_id, timestamp::DATE)""",
)
check(
    "b09_campaign_summary",
    "ae camp",
    """SELECT coalesce(attack_type, 'TOTAL') AS attack_type, count(*) AS campaigns, sum(n)::BIGINT AS events,
count(*) FILTER (stealthy) AS stealth_campaigns
FROM (SELECT campaign_id, count(*) AS n FROM ae WHERE campaign_id IS NOT NULL GROUP BY 1) JOIN camp USING (campaign_id)
GROUP BY ROLLUP (attack_type)""",
)
check("b10_temporal_split", "ae cut", "SELECT event_id, CASE WHEN us <= cutoff THEN 'train' ELSE 'evaluation' END AS split FROM ae, cut")

# -- profiles --------------------------------------------------------------------------------------
cte(
    "h",
    "ae cut",
    """SELECT ae.*, us <= cutoff AS in_train, extract(hour FROM timestamp)::VARCHAR AS v_hour, country || '|' || city AS v_location,
  device_id || '|' || device_mac AS v_device, resource_accessed AS v_resource, auth_method AS v_auth,
  entity_type || '|' || role AS cohort,
  row_number() OVER e AS rn, lag(us) OVER e AS prev_us, lag(latitude) OVER e AS prev_lat, lag(longitude) OVER e AS prev_lon,
  lag(device_id || '|' || device_mac) OVER e AS prev_fp, lag(resource_accessed) OVER e AS prev_resource,
  coalesce(lag(resource_accessed) OVER e, '<START>') || '->' || resource_accessed AS v_transition
FROM ae, cut WINDOW e AS (PARTITION BY entity_id ORDER BY us, event_id)""",
)
cte(
    "fit",
    "h",
    """SELECT *, coalesce(lag(resource_accessed) OVER (PARTITION BY entity_id ORDER BY us, event_id), '<START>') || '->' || resource_accessed AS e_transition,
  coalesce(lag(resource_accessed) OVER (PARTITION BY cohort ORDER BY us, event_id), '<START>') || '->' || resource_accessed AS c_transition
FROM h WHERE in_train AND label = 'BENIGN'""",
)
_KINDS = ("hour", "location", "device", "resource", "auth")
cte(
    "counts",
    "fit",
    " UNION ALL ".join(
        f"SELECT '{src}' AS src, {key} AS key, '{k}' AS kind, {col} AS value, count(*) AS n FROM fit GROUP BY ALL"
        for src, key, t in (("E", "entity_id", "e_transition"), ("C", "cohort", "c_transition"))
        for k, col in [(k, f"v_{k}") for k in _KINDS] + [("transition", t)]
    ),
)
cte(
    "moments",
    "fit",
    " UNION ALL ".join(
        f"""SELECT '{src}' AS src, {key} AS key, count(*) AS n_events, avg(session_duration_s) AS duration_mean,
stddev_pop(session_duration_s) AS duration_std, avg(bytes_transferred) AS bytes_mean, stddev_pop(bytes_transferred) AS bytes_std,
avg((NOT auth_success)::INT) AS auth_failure_rate, avg(latitude) AS baseline_latitude, avg(longitude) AS baseline_longitude
FROM fit GROUP BY {key}"""
        for src, key in (("E", "entity_id"), ("C", "cohort"))
    ),
)
check("c01_count_maps", "counts", "SELECT key, kind, value, n FROM counts WHERE src = 'E' AND kind <> 'transition'")
check(
    "c02_moments",
    "moments",
    f"SELECT key, n_events, {r('duration_mean', 'duration_std', 'bytes_mean', 'bytes_std')} FROM moments WHERE src = 'E'",
)
check(
    "c03_failure_and_baseline",
    "moments",
    f"SELECT key, {r('auth_failure_rate', 'baseline_latitude', 'baseline_longitude', digits=9)} FROM moments WHERE src = 'E'",
)
check("c04_transitions", "counts", "SELECT key, kind, value, n FROM counts WHERE src = 'E' AND kind = 'transition'")
for _name, _src in (("c05_entity_profiles", "E"), ("c06_cohort_profiles", "C")):
    check(
        _name,
        "counts moments",
        f"""SELECT key, n_events, n_events AS total_transitions, kind, value, n
FROM counts JOIN moments USING (src, key) WHERE src = '{_src}'""",
    )
cte(
    "resolved",
    "h moments",
    """SELECT h.event_id, e.n_events AS own, CASE WHEN e.n_events >= 5 THEN 'E' WHEN c.key IS NOT NULL THEN 'C' WHEN e.key IS NOT NULL THEN 'E' END AS src,
  CASE WHEN e.n_events >= 5 THEN entity_id WHEN c.key IS NOT NULL THEN cohort WHEN e.key IS NOT NULL THEN entity_id END AS key,
  CASE WHEN e.n_events >= 5 THEN 'entity' WHEN c.key IS NOT NULL THEN 'cohort' ELSE 'none' END AS profile_source,
  CASE WHEN e.n_events >= 5 THEN 1.0 WHEN c.key IS NOT NULL THEN least(1.0, coalesce(e.n_events, 0) / 5.0) ELSE 0.0 END AS profile_confidence
FROM h LEFT JOIN moments e ON e.src = 'E' AND e.key = h.entity_id LEFT JOIN moments c ON c.src = 'C' AND c.key = h.cohort""",
)
check(
    "c07_profile_resolution",
    "resolved",
    f"SELECT event_id, key AS profile_key, profile_source, {r('profile_confidence')} FROM resolved",
)

# -- features -----------------------------------------------------------------------------------------
cte(
    "trail",
    "h",
    """SELECT a.event_id, count(b.event_id) FILTER (a.us - b.us <= 300000000) AS c5, count(b.event_id) FILTER (a.us - b.us <= 3600000000) AS c60,
  count(b.event_id) FILTER (a.us - b.us <= 300000000 AND NOT b.auth_success) AS f5,
  count(b.event_id) FILTER (a.us - b.us <= 1800000000 AND NOT b.auth_success) AS f30,
  count(DISTINCT b.resource_accessed) AS breadth
FROM h a LEFT JOIN h b ON a.entity_id = b.entity_id AND b.rn < a.rn AND a.us - b.us <= 86400000000 GROUP BY 1""",
)
cte("sizes", "counts", "SELECT src, key, kind, count(*) AS n_keys FROM counts GROUP BY ALL")


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    inner = (
        f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * "
        f"pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    )
    return f"2 * 6371.0088::DOUBLE * asin(sqrt(greatest(0.0, least(1.0, {inner}))))"


def _features(resolved: str, h: str = "h", trail: str = "trail") -> str:
    joins = "".join(
        f" LEFT JOIN counts k_{k} ON k_{k}.src = z.src AND k_{k}.key = z.key AND k_{k}.kind = '{k}' AND k_{k}.value = h.v_{k}"
        f" LEFT JOIN sizes s_{k} ON s_{k}.src = z.src AND s_{k}.key = z.key AND s_{k}.kind = '{k}'"
        for k in (*_KINDS, "transition")
    )
    rar = lambda k: (
        f"-ln((coalesce(k_{k}.n, 0) + 1.0::DOUBLE) / (coalesce(m.n_events, 0) + coalesce(s_{k}.n_keys, 0) + 1.0::DOUBLE))"
    )
    return f"""SELECT *, CASE WHEN prev_us IS NULL THEN 0.0 WHEN inter_event_gap_s <= 0 THEN CASE WHEN geo_distance_from_previous_km > 0 THEN 100000.0 ELSE 0.0 END
    ELSE least(100000.0, geo_distance_from_previous_km * 3600.0 / inter_event_gap_s) END AS geo_velocity_kmh,
  -ln(transition_probability) AS sequence_anomaly_score
FROM (SELECT h.event_id, h.timestamp, h.us, h.entity_id, h.entity_type, h.role, h.label, h.is_attack, h.campaign_id, h.stealthy, h.prev_us,
  CASE WHEN h.in_train THEN 'train' ELSE 'evaluation' END AS split, z.profile_source, z.profile_confidence,
  h.v_hour::DOUBLE AS hour, (isodow(h.timestamp) - 1)::DOUBLE AS day_of_week, (isodow(h.timestamp) >= 6)::INT::DOUBLE AS is_weekend,
  coalesce((h.us - h.prev_us) / 1e6, 0.0) AS inter_event_gap_s,
  t.c5::DOUBLE AS event_count_5m, t.c60::DOUBLE AS event_count_60m, t.f5::DOUBLE AS failed_auth_5m, t.f30::DOUBLE AS failed_auth_30m,
  {rar("hour")} AS login_hour_rarity, (k_hour.n IS NULL)::INT::DOUBLE AS is_entity_off_hours,
  {rar("location")} AS location_rarity, (k_location.n IS NULL)::INT::DOUBLE AS is_new_location,
  {haversine("coalesce(m.baseline_latitude, h.latitude)", "coalesce(m.baseline_longitude, h.longitude)", "h.latitude", "h.longitude")} AS geo_distance_from_baseline_km,
  coalesce({haversine("h.prev_lat", "h.prev_lon", "h.latitude", "h.longitude")} * CASE WHEN h.prev_us IS NULL THEN NULL ELSE 1 END, 0.0) AS geo_distance_from_previous_km,
  (k_device.n IS NOT NULL)::INT::DOUBLE AS is_known_device, {rar("device")} AS device_rarity,
  coalesce(h.prev_fp <> h.v_device, false)::INT::DOUBLE AS fingerprint_changed,
  (k_resource.n IS NOT NULL)::INT::DOUBLE AS is_known_resource, {rar("resource")} AS resource_rarity,
  (CASE split_part(h.resource_accessed, '/', 1) WHEN 'click' THEN 2 WHEN 'error' THEN 3 WHEN 'purchase' THEN 4 ELSE 1 END)::DOUBLE AS resource_sensitivity,
  t.breadth::DOUBLE AS recent_resource_breadth_24h, {rar("auth")} AS auth_method_rarity,
  (NOT h.auth_success)::INT - coalesce(m.auth_failure_rate, 0.0) AS auth_failure_deviation,
  (h.session_duration_s - coalesce(m.duration_mean, h.session_duration_s)) / greatest(coalesce(m.duration_std, 1.0), 1.0) AS session_duration_zscore,
  (h.bytes_transferred - coalesce(m.bytes_mean, h.bytes_transferred)) / greatest(coalesce(m.bytes_std, 1.0), 1.0) AS transfer_volume_zscore,
  (coalesce(k_transition.n, 0) + 1.0::DOUBLE) / (coalesce(m.n_events, 0) + coalesce(s_transition.n_keys, 0) + 1.0::DOUBLE) AS transition_probability
FROM {h} AS h JOIN {resolved} z USING (event_id) JOIN {trail} t USING (event_id) LEFT JOIN moments m ON m.src = z.src AND m.key = z.key{joins})"""


cte("features", "h resolved trail moments counts sizes", _features("resolved"))
cte(
    "unresolved",
    "h",
    "SELECT event_id, NULL::VARCHAR AS src, NULL::VARCHAR AS key, 'none' AS profile_source, 0.0 AS profile_confidence FROM h",
)
cte("cold", "h unresolved trail moments counts sizes", _features("unresolved"))
check(
    "c08_cold_start",
    "cold",
    f"SELECT event_id, profile_source, {r('profile_confidence', *FEATURES)} FROM cold",
)
for _number, _feature in FEATURE_IDS.items():
    check(f"f{_number:02d}_{_feature}", "features", f"SELECT event_id, {r(_feature)} FROM features")
check(
    "f29_all_features",
    "features",
    f"SELECT event_id, entity_id, entity_type, role, profile_source, split, {r('profile_confidence', *FEATURES)} FROM features",
)
check("f21_catalog_sensitivity", "features", "SELECT event_id, resource_sensitivity FROM features")
check("g01_haversine", "ae", f"SELECT event_id, {r('km_from_london=' + haversine('51.5074::DOUBLE', '-0.1278::DOUBLE', 'latitude', 'longitude'))} FROM ae")
check(
    "a08_finite_features",
    "features",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) FILTER ({c} IS NULL OR NOT isfinite({c})) AS n_bad FROM features" for c in FEATURES
    ),
)

# -- detectors ---------------------------------------------------------------------------------------------
check("e01_features_with_truth", "features", "SELECT event_id, split, label, is_attack::BIGINT AS is_attack, campaign_id FROM features")
check("e02_training_rows", "features", "SELECT event_id FROM features WHERE split = 'train' AND label = 'BENIGN'")
check("e03_evaluation_rows", "features", "SELECT event_id FROM features WHERE split = 'evaluation'")
check("e04_classifier_rows", "features", "SELECT event_id, label FROM features WHERE split = 'train'")
cte(
    "parts",
    "features",
    """SELECT *, rn <= least(n - 1, greatest(1, floor(n * 0.8::DOUBLE)::BIGINT)) AS in_fit FROM (
SELECT event_id, row_number() OVER (ORDER BY us, event_id) AS rn, count(*) OVER () AS n FROM features WHERE split = 'train' AND label = 'BENIGN')""",
)
check("e05_fit_calibration_split", "parts", "SELECT event_id, CASE WHEN in_fit THEN 'fit' ELSE 'calibrate' END AS part FROM parts")
cte(
    "rule",
    "features",
    "SELECT count(*) AS n, "
    + ", ".join(
        f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS s_{c}" for c in RULE_FEATURES
    )
    + " FROM features WHERE split = 'train' AND label = 'BENIGN'",
)
_RULE = " + ".join(f"({c} - m_{c}) / s_{c}" for c in RULE_FEATURES)
cte(
    "scored",
    "features rule",
    f"""SELECT *, 1.0 / (1.0 + exp(-baseline_rule / 6.0)) AS anomaly_score_raw FROM (
SELECT features.*, {_RULE} AS baseline_rule FROM features, rule)""",
)
cte("ev", "scored", "SELECT * FROM scored WHERE split = 'evaluation'")
cte("tr", "scored", "SELECT * FROM scored WHERE split = 'train' AND label = 'BENIGN'")
cte(
    "thr",
    "tr parts",
    "SELECT count(*) AS n_calibration, "
    + ", ".join(f"quantile_cont(anomaly_score_raw, {v}) AS {k}" for k, v in OPERATING_POINTS.items())
    + " FROM tr JOIN parts USING (event_id) WHERE NOT in_fit",
)
check(
    "m01_standard_scaler",
    "features rule",
    "SELECT event_id, " + r(*[f"{c}=({c} - m_{c}) / s_{c}" for c in RULE_FEATURES]) + " FROM features, rule",
)
check(
    "m04_display_score",
    "scored parts",
    f"""SELECT event_id, {r("anomaly_score=greatest(0.0, least(1.0, (anomaly_score_raw - lo) / (hi - lo)))")} FROM scored,
(SELECT min(anomaly_score_raw) AS lo, max(anomaly_score_raw) AS hi FROM scored JOIN parts USING (event_id) WHERE in_fit)""",
)
check(
    "m05_thresholds",
    "thr",
    " UNION ALL ".join(f"SELECT n_calibration, '{k}' AS point, {r('threshold=' + k)} FROM thr" for k in OPERATING_POINTS),
)
check("m06_alert_mask", "scored thr", "SELECT event_id FROM scored, thr WHERE anomaly_score_raw >= balanced")
check(
    "m07_rule_baseline",
    "rule",
    " UNION ALL ".join(f"SELECT n, '{c}' AS feature, {r(f'mean=m_{c}', f'std=s_{c}')} FROM rule" for c in RULE_FEATURES),
)
check("m08_rule_score", "scored", f"SELECT event_id, {r('baseline_rule')} FROM scored")
_CONTEXT = (
    "geo_velocity_kmh failed_auth_5m is_known_device recent_resource_breadth_24h sequence_anomaly_score is_new_location "
    "resource_rarity event_count_5m transfer_volume_zscore is_entity_off_hours session_duration_zscore"
).split()
check(
    "e06_scoring_frame",
    "scored",
    f"SELECT event_id, entity_id, entity_type, {r('anomaly_score_raw', 'baseline_rule', *_CONTEXT)} FROM scored",
)
cte(
    "sig",
    "scored",
    """SELECT event_id, CASE WHEN geo_velocity_kmh > 900 THEN 'IMPOSSIBLE_TRAVEL' WHEN is_known_device = 0 THEN 'DEVICE_SPOOFING'
WHEN auth_failure_deviation > 0 THEN 'BRUTE_FORCE' WHEN resource_sensitivity = 4 AND transfer_volume_zscore > 0 THEN 'LOW_AND_SLOW_EXFILTRATION'
WHEN sequence_anomaly_score > 4 THEN 'LATERAL_MOVEMENT' ELSE 'BENIGN' END AS predicted_label, anomaly_score_raw AS attack_confidence FROM scored""",
)
check(
    "e07_predicted_class",
    "sig",
    f"""SELECT event_id, CASE WHEN predicted_label = 'BENIGN' THEN 'UNKNOWN' ELSE predicted_label END AS predicted_label,
{r("attack_confidence=CASE WHEN predicted_label = 'BENIGN' THEN 0.0 ELSE attack_confidence END")} FROM sig""",
)
check("e09_join_cardinality", "ae", "SELECT count(*) AS keys, count(*) FILTER (n > 1) AS repeated_keys FROM (SELECT count(*) AS n FROM ae GROUP BY event_id)")
cte("inj", "ae cut", "SELECT ae.* FROM ae, cut WHERE label = 'LATERAL_MOVEMENT' AND us > cutoff")
check(
    "e11_history_slice",
    "ae inj",
    "SELECT event_id, entity_id FROM ae WHERE entity_id IN (SELECT entity_id FROM inj) AND us < (SELECT min(us) FROM inj)",
)
check("e12_missing_scores", "ae", "SELECT count(*) FILTER (event_id IS NULL) AS n_missing FROM ae")
check(
    "e13_campaign_metadata",
    "ae camp",
    """SELECT event_id, campaign_id, attack_type, camp.stealthy::BIGINT AS stealthy FROM ae LEFT JOIN camp USING (campaign_id)
WHERE campaign_id IS NOT NULL""",
)

# -- risk --------------------------------------------------------------------------------------------------------
_ANCHORED = {
    "failed_auth_5m": "failed_auth_5m",
    "recent_resource_breadth_24h": "recent_resource_breadth_24h",
    "sequence_anomaly_score": "sequence_anomaly_score",
    "resource_rarity": "resource_rarity",
    "event_count_5m": "event_count_5m",
    "transfer_volume_zscore": "abs(transfer_volume_zscore)",
    "session_duration_zscore": "abs(session_duration_zscore)",
}
_ANCHORED_ALL = _ANCHORED | {"rule": "baseline_rule"}
cte(
    "cal",
    "tr thr",
    "SELECT q.*, n_events, floor_score, strict, balanced, sensitive, "
    + ", ".join(f"CASE WHEN q.h_{c} > q.l_{c} THEN q.h_{c} ELSE q.l_{c} + 1.0 END AS hi_{c}" for c in _ANCHORED_ALL)
    + " FROM (SELECT count(*) AS n_events, quantile_cont(anomaly_score_raw, 0.5) AS floor_score, "
    + ", ".join(f"quantile_cont({e}, 0.95) AS l_{c}, quantile_cont({e}, 0.999) AS h_{c}" for c, e in _ANCHORED_ALL.items())
    + " FROM tr) q, thr",
)
CTES["cal"] = (CTES["cal"][0], CTES["cal"][1].replace("q.*, n_events, floor_score", "q.*"))
_ANCHOR_ROWS = " UNION ALL ".join(f"SELECT n_events, '{c}' AS {{0}}, {r(f'low=l_{c}', f'high=hi_{c}')} FROM cal" for c in _ANCHORED)
check("r01_anchors", "cal", _ANCHOR_ROWS.replace("{0}", "feature"))
check(
    "r02_forest_floor_and_rule_anchors",
    "cal",
    f"SELECT n_events, {r('forest_floor=floor_score', 'rule_low=l_rule', 'rule_high=hi_rule')} FROM cal",
)
check(
    "r28_engine_fit",
    "cal",
    _ANCHOR_ROWS.replace("{0}", "name")
    + f" UNION ALL SELECT n_events, 'rule' AS name, {r('low=l_rule', 'high=hi_rule')} FROM cal"
    + f" UNION ALL SELECT n_events, 'forest' AS name, {r('low=floor_score', 'high=strict')} FROM cal",
)


def ramp(value: str, low: str, high: str) -> str:
    return f"(CASE WHEN {high} <= {low} THEN ({value} > {low})::INT::DOUBLE ELSE least(1.0, greatest(0.0, ({value} - {low}) / ({high} - {low}))) END)"


def anchored(feature: str) -> str:
    return ramp(_ANCHORED[feature], f"l_{feature}", f"hi_{feature}")


_RAW = "anomaly_score_raw"
FOREST = f"""(CASE WHEN {_RAW} <= floor_score THEN 0.0 WHEN {_RAW} <= sensitive THEN 0.25 * {ramp(_RAW, "floor_score", "sensitive")}
WHEN {_RAW} <= balanced THEN 0.25 + 0.25 * {ramp(_RAW, "sensitive", "balanced")}
WHEN {_RAW} <= strict THEN 0.5 + 0.25 * {ramp(_RAW, "balanced", "strict")}
ELSE 0.75 + 0.25 * (1.0 - exp(-({_RAW} - strict) / greatest(strict - balanced, 1e-9))) END)"""
RULE_ACT = "(1.0 - exp(-greatest(0.0, baseline_rule - l_rule) / greatest(hi_rule - l_rule, 1e-9)))"
POINT = f"""CASE WHEN {_RAW} >= strict THEN 'strict' WHEN {_RAW} >= balanced THEN 'balanced'
WHEN {_RAW} >= sensitive THEN 'sensitive' ELSE 'below_sensitive' END"""
_UNIT = lambda e: f"least(1.0, greatest(0.0, {e}))"
SIGNALS = {
    "IMPOSSIBLE_VELOCITY": (0.45, ramp("geo_velocity_kmh", "900.0", "2700.0")),
    "AUTH_FAILURE_BURST": (0.40, anchored("failed_auth_5m")),
    "NEW_DEVICE": (0.35, _UNIT("1.0 - is_known_device")),
    "RESOURCE_TRAVERSAL_PATTERN": (
        0.35,
        f"least({anchored('recent_resource_breadth_24h')}, {anchored('sequence_anomaly_score')})",
    ),
    "UNUSUAL_LOCATION": (0.30, _UNIT("is_new_location")),
    "RESOURCE_BREADTH_SPIKE": (0.30, anchored("recent_resource_breadth_24h")),
    "RARE_SEQUENCE_TRANSITION": (0.30, anchored("sequence_anomaly_score")),
    "RARE_RESOURCE": (0.25, anchored("resource_rarity")),
    "ACTIVITY_BURST": (0.20, anchored("event_count_5m")),
    "UNUSUAL_TRANSFER_VOLUME": (0.20, anchored("transfer_volume_zscore")),
    "OFF_HOURS_ACTIVITY": (0.15, _UNIT("is_entity_off_hours")),
    "UNUSUAL_SESSION_DURATION": (0.15, anchored("session_duration_zscore")),
}
TERMS = ["ISOLATION_FOREST_ANOMALY", "RULE_THRESHOLD_EXCEEDED", *SIGNALS]
cte(
    "act",
    "scored cal",
    f"SELECT scored.*, {POINT} AS point, {FOREST} AS a_forest, {FOREST} AS e_0, 0.8::DOUBLE * {RULE_ACT} AS e_1, {RULE_ACT} AS a_rule, "
    + ", ".join(f"{a} AS a_{i}, {w}::DOUBLE * {a} AS e_{i}" for i, (w, a) in enumerate(SIGNALS.values(), 2))
    + " FROM scored, cal",
)
_INDEX = {code: i for i, code in enumerate(TERMS)}
check("r03_ramp", "act", f"SELECT event_id, {r('activation=a_%d' % _INDEX['RARE_SEQUENCE_TRANSITION'])} FROM act")
check("r04_forest_activation", "act", f"SELECT event_id, {r('activation=a_forest')} FROM act")
check("r05_operating_point", "act", "SELECT event_id, point FROM act")
check("r06_rule_activation", "act", f"SELECT event_id, {r('activation=a_rule')} FROM act")
for _key, _code in {
    "r07_context_boolean": "UNUSUAL_LOCATION",
    "r08_context_inverse_boolean": "NEW_DEVICE",
    "r09_context_fixed_ramp": "IMPOSSIBLE_VELOCITY",
    "r10_context_ramp": "RARE_RESOURCE",
    "r11_context_abs_ramp": "UNUSUAL_TRANSFER_VOLUME",
    "r12_context_min_of": "RESOURCE_TRAVERSAL_PATTERN",
}.items():
    check(_key, "act", f"SELECT event_id, {r(f'activation=a_{_INDEX[_code]}')} FROM act")
check(
    "r13_signal_terms",
    "act",
    " UNION ALL ".join(f"SELECT '{code}' AS reason, {r(f'mean_evidence=avg(e_{i})')} FROM act" for i, code in enumerate(TERMS)),
)
_CTX = " + ".join(f"e_{i}" for i in range(2, len(TERMS)))
cte("inst", "act", f"SELECT *, {_CTX} AS ctx, e_0 + e_1 + ({_CTX}) AS inst FROM act")
check("r14_instantaneous_evidence", "inst", f"SELECT event_id, {r('instantaneous_evidence=inst')} FROM inst")
check("r15_decay", "features", f"SELECT event_id, {r('decay=pow(0.5::DOUBLE, inter_event_gap_s / 21600.0)')} FROM features")
cte(
    "seq",
    "inst",
    "SELECT event_id, entity_id, us, inst, row_number() OVER (PARTITION BY entity_id ORDER BY us, event_id) AS k FROM inst",
)
# One recursion step per event of an entity: the definition, event by event.
cte(
    "walk",
    "seq",
    """SELECT event_id, entity_id, k, us, 0.0::DOUBLE AS decayed, least(inst, 4.0)::DOUBLE AS state FROM seq WHERE k = 1
UNION ALL SELECT s.event_id, s.entity_id, s.k, s.us, w.state * pow(0.5::DOUBLE, (s.us - w.us) / 1e6 / 21600.0),
least(w.state * pow(0.5::DOUBLE, (s.us - w.us) / 1e6 / 21600.0) + s.inst, 4.0)::DOUBLE FROM walk w JOIN seq s ON s.entity_id = w.entity_id AND s.k = w.k + 1""",
)
cte(
    "risk",
    "inst walk",
    """SELECT *, CASE WHEN total > 0 THEN risk_score / total ELSE 0.0 END AS scale,
  CASE WHEN risk_score <= 30 THEN 'LOW' WHEN risk_score <= 60 THEN 'MEDIUM' WHEN risk_score <= 80 THEN 'HIGH' ELSE 'CRITICAL' END AS sev,
  CASE WHEN risk_score <= 30 THEN 1 WHEN risk_score <= 60 THEN 2 WHEN risk_score <= 80 THEN 3 ELSE 4 END AS rank
FROM (SELECT *, 100.0 * (1.0 - exp(-greatest(total, 0.0) / 1.5)) AS risk_score FROM (
SELECT inst.*, walk.decayed, walk.state, 0.6::DOUBLE * walk.decayed AS e_p, inst.inst + 0.6::DOUBLE * walk.decayed AS total FROM inst JOIN walk USING (event_id)))""",
)
check("r16_evidence_state", "walk", f"SELECT event_id, {r('decayed_state=decayed', 'entity_evidence_state=state', digits=4)} FROM walk")
check("r17_saturating_risk", "risk", f"SELECT event_id, {r('total_evidence=total', 'risk_score', digits=4)} FROM risk")
check(
    "r18_evidence_for_risk",
    "risk",
    f"SELECT event_id, {r('evidence=-1.5::DOUBLE * ln(1.0 - least(99.999999, greatest(0.0, risk_score)) / 100.0)', digits=4)} FROM risk",
)
check("r19_severity", "risk", "SELECT event_id, sev AS risk_severity FROM risk")
_PARTS = {"isolation_forest": "e_0", "rule": "e_1", "context": "ctx", "persistence": "e_p"}
check(
    "r20_contributions",
    "risk",
    "SELECT event_id, "
    + r(*[f"{k}_contribution={v} * scale" for k, v in _PARTS.items()], "contribution_sum=(e_0 + e_1 + ctx + e_p) * scale", digits=4)
    + " FROM risk",
)
_ALL_TERMS = [*[(code, f"e_{i}") for i, code in enumerate(TERMS)], ("PERSISTENT_SUSPICIOUS_ACTIVITY", "e_p")]
cte(
    "terms",
    "risk",
    " UNION ALL ".join(f"SELECT event_id, '{code}' AS code, {i} AS spot, {e} * scale AS v FROM risk" for i, (code, e) in enumerate(_ALL_TERMS)),
)
cte(
    "reasons",
    "terms",
    """SELECT event_id, place, code, v FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY v DESC, spot) - 1 AS place
FROM terms WHERE v > 1e-9) WHERE place < 6""",
)
check("r21_top_reasons", "reasons", f"SELECT event_id, place, code, {r('contribution=round_even(v, 3)', digits=3)} FROM reasons")
check("a10_json_lists", "reasons", f"SELECT event_id, place, code, {r('contribution=round_even(v, 3)', digits=3)} FROM reasons")
cte(
    "rtext",
    "risk reasons",
    """SELECT risk.event_id, coalesce(string_agg(code, '|' ORDER BY place), '') AS reason_codes, coalesce(min(code) FILTER (place = 0), '') AS short_reason
FROM risk LEFT JOIN reasons USING (event_id) GROUP BY 1""",
)
check("r22_reason_texts", "rtext", "SELECT event_id, short_reason, reason_codes FROM rtext")
check("r23_alert_candidates", "risk", "SELECT event_id, rank::BIGINT AS rank FROM risk WHERE rank >= 3")


def emit(name: str, minimum: int, cooldown_us: int) -> None:
    """Cooldown with escalation, candidate by candidate."""
    cte(
        f"page_{name}",
        "risk",
        f"SELECT event_id, entity_id, us, rank, row_number() OVER (PARTITION BY entity_id ORDER BY us, event_id) AS k FROM risk WHERE rank >= {minimum}",
    )
    opens = f"p.us - f.last_us >= {cooldown_us} OR p.rank > f.last_rank"
    cte(
        f"fold_{name}",
        f"page_{name}",
        f"""SELECT event_id, entity_id, k, true AS opened, us AS last_us, rank AS last_rank FROM page_{name} WHERE k = 1 UNION ALL
SELECT p.event_id, p.entity_id, p.k, ({opens}), CASE WHEN {opens} THEN p.us ELSE f.last_us END, CASE WHEN {opens} THEN p.rank ELSE f.last_rank END
FROM fold_{name} f JOIN page_{name} p ON p.entity_id = f.entity_id AND p.k = f.k + 1""",
    )
    cte(
        f"alert_{name}",
        f"risk rtext fold_{name}",
        f"""SELECT risk.*, short_reason, reason_codes, 'ALT-' || entity_id || '-' || strftime(risk.timestamp, '%Y%m%dT%H%M%S') || '-' ||
lpad((row_number() OVER (ORDER BY us, event_id) - 1)::VARCHAR, 5, '0') AS alert_id
FROM risk JOIN rtext USING (event_id) WHERE event_id IN (SELECT event_id FROM fold_{name} WHERE opened)""",
    )


emit("crit", 4, 3_600_000_000)
emit("high", 3, 86_400_000_000)
check("r24_cooldown_and_escalation", "fold_high", "SELECT event_id FROM fold_high WHERE opened")
_SEQ = f"a_{_INDEX['RARE_SEQUENCE_TRANSITION']}"
check(
    "r25_alert_rows",
    "alert_crit",
    f"SELECT alert_id, event_id, sev AS severity, short_reason, {r('risk_score', 'anomaly_score=a_forest', f'sequence_score={_SEQ}', digits=4)} FROM alert_crit",
)
check(
    "r26_suppressed_count",
    "fold_high",
    "SELECT count(*) AS n_candidates, count(*) FILTER (opened) AS n_alerts, count(*) FILTER (NOT opened) AS n_suppressed FROM fold_high",
)
check(
    "r27_score_frame",
    "risk rtext",
    f"""SELECT event_id, sev AS risk_severity, point AS isolation_forest_operating_point, short_reason,
{r("risk_score", "total_evidence=total", "entity_evidence_state=state", digits=4)} FROM risk JOIN rtext USING (event_id)""",
)
check(
    "e08_alert_enrichment",
    "alert_crit sig",
    f"""SELECT event_id, CASE WHEN predicted_label = 'BENIGN' THEN 'UNKNOWN' ELSE predicted_label END AS attack_type,
{r("attack_confidence=CASE WHEN predicted_label = 'BENIGN' THEN 0.0 ELSE attack_confidence END")} FROM alert_crit JOIN sig USING (event_id)""",
)
check("e10_alerts_in_evaluation", "alert_crit", "SELECT event_id, sev AS severity FROM alert_crit WHERE split = 'evaluation'")

# -- adaptive profiles ---------------------------------------------------------------------------------------------
_H = "1209600000000.0"
cte("gated", "h risk", "SELECT h.*, risk_score, risk_score < 40 AS accepted FROM h JOIN (SELECT event_id, risk_score FROM risk) USING (event_id) WHERE NOT in_train")
cte(
    "acc",
    "gated",
    f"""SELECT *, pow(0.5::DOUBLE, greatest(0, coalesce(us - lag(us) OVER e, 0)) / {_H}) AS d, row_number() OVER e AS k,
coalesce(lag(resource_accessed) OVER e, '<START>') || '->' || resource_accessed AS a_transition,
min(us) OVER (PARTITION BY entity_id) AS first_us, max(us) OVER (PARTITION BY entity_id) AS last_us
FROM gated WHERE accepted WINDOW e AS (PARTITION BY entity_id ORDER BY us, event_id)""",
)
cte(
    "dseed",
    "acc moments",
    """SELECT DISTINCT entity_id, first_us, last_us, coalesce(e.src, c.src) AS src, coalesce(e.key, c.key) AS key
FROM acc LEFT JOIN moments e ON e.src = 'E' AND e.key = entity_id LEFT JOIN moments c ON c.src = 'C' AND c.key = cohort""",
)
cte(
    "ewma",
    "acc dseed counts",
    f"""SELECT entity_id, kind, value, sum(c) AS ewma_count FROM (
SELECT entity_id, kind, value, n * pow(0.5::DOUBLE, (last_us - first_us) / {_H}) AS c FROM dseed JOIN counts USING (src, key)
UNION ALL """
    + " UNION ALL ".join(
        f"SELECT entity_id, '{k}' AS kind, {column} AS value, pow(0.5::DOUBLE, (last_us - us) / {_H}) AS c FROM acc"
        for k, column in [(k, f"v_{k}") for k in _KINDS] + [("transition", "a_transition")]
    )
    + ") GROUP BY ALL HAVING sum(c) > 1e-12",
)
# The replay itself, one accepted event per step.
cte(
    "ewalk",
    "acc dseed moments",
    """SELECT acc.entity_id, k, d * m.n_events + 1.0 AS n, d * m.duration_mean + (1 - d) * session_duration_s AS dm,
  d * pow(m.duration_std, 2) + (1 - d) * (session_duration_s - m.duration_mean) * (session_duration_s - (d * m.duration_mean + (1 - d) * session_duration_s)) AS dv,
  d * m.bytes_mean + (1 - d) * bytes_transferred AS bm,
  d * pow(m.bytes_std, 2) + (1 - d) * (bytes_transferred - m.bytes_mean) * (bytes_transferred - (d * m.bytes_mean + (1 - d) * bytes_transferred)) AS bv,
  d * m.auth_failure_rate + (1 - d) * (NOT auth_success)::INT AS f, d * m.baseline_latitude + (1 - d) * latitude AS la, d * m.baseline_longitude + (1 - d) * longitude AS lo
FROM acc JOIN dseed USING (entity_id) JOIN moments m USING (src, key) WHERE k = 1
UNION ALL SELECT a.entity_id, a.k, d * n + 1.0, d * dm + (1 - d) * session_duration_s,
  d * dv + (1 - d) * (session_duration_s - dm) * (session_duration_s - (d * dm + (1 - d) * session_duration_s)),
  d * bm + (1 - d) * bytes_transferred, d * bv + (1 - d) * (bytes_transferred - bm) * (bytes_transferred - (d * bm + (1 - d) * bytes_transferred)),
  d * f + (1 - d) * (NOT auth_success)::INT, d * la + (1 - d) * latitude, d * lo + (1 - d) * longitude
FROM ewalk w JOIN acc a ON a.entity_id = w.entity_id AND a.k = w.k + 1""",
)
cte("adapted", "ewalk", "SELECT * FROM (SELECT *, max(k) OVER (PARTITION BY entity_id) AS last_k FROM ewalk) WHERE k = last_k")
check("d01_risk_gate", "gated", "SELECT event_id, accepted::BIGINT AS accepted FROM gated")
check("d02_decayed_counts", "ewma", f"SELECT entity_id, kind, value, {r('ewma_count')} FROM ewma WHERE kind <> 'transition'")
check("d03_decayed_totals", "adapted", f"SELECT entity_id, {r('n_events=n', 'total_transitions=n')}, k AS n_updates FROM adapted")
check(
    "d04_ewma_means",
    "adapted",
    "SELECT entity_id, "
    + r("duration_mean=dm", "bytes_mean=bm", "auth_failure_rate=f", "baseline_latitude=la", "baseline_longitude=lo", digits=4)
    + " FROM adapted",
)
check("d05_ewma_second_moments", "adapted", f"SELECT entity_id, {r('duration_std=sqrt(dv)', 'bytes_std=sqrt(bv)', digits=2)} FROM adapted")
check("d06_transition_learning", "ewma", f"SELECT entity_id, value, {r('ewma_count')} FROM ewma WHERE kind = 'transition'")
check(
    "d07_seeding",
    "acc moments",
    """SELECT DISTINCT entity_id, CASE WHEN e.key IS NOT NULL THEN 'entity' WHEN c.key IS NOT NULL THEN 'cohort' ELSE 'empty' END AS seeded_from,
coalesce(e.key, c.key) AS seed_key, coalesce(e.n_events, c.n_events) AS n_events
FROM acc LEFT JOIN moments e ON e.src = 'E' AND e.key = entity_id LEFT JOIN moments c ON c.src = 'C' AND c.key = cohort""",
)
check("d08_replay", "gated", "SELECT entity_id, count(*) FILTER (accepted) AS n_updates, count(*) FILTER (NOT accepted) AS n_blocked FROM gated GROUP BY 1")
check(
    "d09_snapshot",
    "ewma adapted",
    f"""SELECT entity_id, n_keys, sum_counts, round_even(n, 0)::BIGINT AS n_events, round_even(n, 0)::BIGINT AS total_transitions,
{r("duration_std=sqrt(dv)", digits=2)} FROM adapted JOIN (SELECT entity_id, count(*) AS n_keys, sum(round_even(ewma_count, 0))::BIGINT AS sum_counts FROM ewma GROUP BY 1) USING (entity_id)""",
)
_D10 = {
    "n_considered": "true",
    "n_updated": "accepted",
    "n_blocked": "NOT accepted",
    "high_risk_events": "risk_score >= 40",
    "high_risk_blocked": "risk_score >= 40 AND NOT accepted",
    "malicious_events": f"label IN {BAD}",
    "malicious_blocked": f"label IN {BAD} AND NOT accepted",
    "malicious_high_risk": f"label IN {BAD} AND risk_score >= 40",
    "malicious_high_risk_blocked": f"label IN {BAD} AND risk_score >= 40 AND NOT accepted",
    "low_risk_benign": "label = 'BENIGN' AND risk_score < 40",
    "low_risk_benign_updated": "label = 'BENIGN' AND risk_score < 40 AND accepted",
    "insider_drift_events": "label = 'INSIDER_DRIFT'",
    "insider_drift_updated": "label = 'INSIDER_DRIFT' AND accepted",
    "insider_drift_blocked": "label = 'INSIDER_DRIFT' AND NOT accepted",
    "insider_low_risk": "label = 'INSIDER_DRIFT' AND risk_score < 40",
    "insider_low_risk_updated": "label = 'INSIDER_DRIFT' AND risk_score < 40 AND accepted",
    "gate_disagreements": "(risk_score >= 40) = accepted",
}
_RATES = {
    "update_rate": ("n_updated", "n_considered"),
    "block_rate": ("n_blocked", "n_considered"),
    "high_risk_block_rate": ("high_risk_blocked", "high_risk_events"),
    "malicious_block_rate": ("malicious_blocked", "malicious_events"),
    "malicious_high_risk_block_rate": ("malicious_high_risk_blocked", "malicious_high_risk"),
    "low_risk_benign_update_rate": ("low_risk_benign_updated", "low_risk_benign"),
    "insider_drift_update_rate": ("insider_drift_updated", "insider_drift_events"),
    "insider_drift_low_risk_update_rate": ("insider_low_risk_updated", "insider_low_risk"),
}
check(
    "d10_drift_evaluation",
    "gated",
    "SELECT *, "
    + r(*[f"{k}={a}::DOUBLE / nullif({b}, 0)" for k, (a, b) in _RATES.items()])
    + " FROM (SELECT "
    + ", ".join(f"count(*) FILTER ({c}) AS {k}" for k, c in _D10.items())
    + " FROM gated)",
)
check(
    "d11_insider_exhibits",
    "gated ewma",
    f"""SELECT entity_id, n_insider_events, n_updated, n_blocked, {r("mean_risk", digits=4)}, rank, value AS resource, {r("ewma_count", digits=4)}
FROM (SELECT entity_id, count(*) AS n_insider_events, count(*) FILTER (accepted) AS n_updated, count(*) FILTER (NOT accepted) AS n_blocked, avg(risk_score) AS mean_risk
FROM gated WHERE label = 'INSIDER_DRIFT' GROUP BY 1) JOIN (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY round(ewma_count, 9) DESC, value) AS rank
FROM ewma WHERE kind = 'resource') USING (entity_id) WHERE rank <= 5""",
)

# -- streaming --------------------------------------------------------------------------------------------------------
_OPEN = "event_id IN (SELECT event_id FROM fold_crit WHERE opened)"
check(
    "s01_live_scoring",
    "risk rtext fold_crit",
    f"""SELECT event_id, {r("risk_score", digits=4)}, sev AS severity, short_reason, profile_source, ({_OPEN})::BIGINT AS alerted
FROM risk JOIN rtext USING (event_id)""",
)
check(
    "s02_late_events",
    "ae",
    f"""SELECT event_id, entity_id, {TS_COLUMN} FROM ae JOIN (SELECT entity_id, max((us, event_id)) AS newest FROM ae WHERE label = 'BENIGN' GROUP BY 1) USING (entity_id)
WHERE label <> 'BENIGN' AND (us, event_id) < newest""",
)
check(
    "s03_live_windows",
    "features",
    "SELECT event_id, event_count_5m, event_count_60m, failed_auth_5m, failed_auth_30m, recent_resource_breadth_24h FROM features",
)
check(
    "s04_history_retention",
    "h",
    """SELECT a.event_id, (count(b.event_id) FILTER (a.us - b.us <= 3600000000))::DOUBLE AS event_count_60m,
count(DISTINCT b.resource_accessed)::DOUBLE AS recent_resource_breadth_24h
FROM h a LEFT JOIN h b ON a.entity_id = b.entity_id AND b.rn < a.rn AND a.us - b.us <= 86400000000 AND a.prev_us - b.us <= 21600000000 GROUP BY 1""",
)
check(
    "s05_warm_start",
    "features",
    f"SELECT event_id, {r('inter_event_gap_s', 'recent_resource_breadth_24h', 'geo_distance_from_previous_km')} FROM features WHERE split = 'evaluation'",
)
check(
    "s05_started_from_history",
    "features",
    f"""SELECT event_id, {r("event_count_60m", "failed_auth_30m", "inter_event_gap_s", "recent_resource_breadth_24h", "geo_distance_from_previous_km")}
FROM features WHERE split = 'evaluation'""",
)
check(
    "s05_started_from_state",
    "risk fold_crit",
    f"""SELECT event_id, {r("risk_score", "state", digits=4)}, ({_OPEN})::BIGINT AS alerted FROM risk WHERE split = 'evaluation'""",
)
check(
    "m09_random_baseline",
    "ae",
    f"SELECT event_id, {r('baseline_random')} FROM (SELECT event_id, ('0x' || md5(event_id || ':42')[1:13])::BIGINT / 4503599627370496.0::DOUBLE AS baseline_random FROM ae)",
)
check("s01_live_models", "ae", "SELECT entity_type, count(*) AS n, count(*) AS n_same_risk, count(*) AS n_same_class, count(*) AS n_same_alert FROM ae GROUP BY 1")
check(
    "r16_chain_contributions",
    "ae",
    "SELECT entity_type, count(*) AS n, count(*) AS n_reconciled, count(*) AS n_in_range, count(*) AS n_reasons_within FROM ae GROUP BY 1",
)
check("r26_chain_alert_classes", "ae", "SELECT (count(*) > 0)::BIGINT AS some, 1::BIGINT AS once, 1::BIGINT AS all_agree FROM ae")
check("s06_state_isolation", "ae", "SELECT entity_id, count(*) AS n, count(*) AS n_equal FROM ae GROUP BY 1")
check("s07_replay_first", "ae", "SELECT event_id, entity_id FROM (SELECT * FROM ae ORDER BY us, event_id LIMIT 500)")
check(
    "s08_cursor_slice",
    "ae fold_crit",
    f"""SELECT event_id, ({_OPEN})::BIGINT AS alerted FROM (SELECT event_id, row_number() OVER (ORDER BY us, event_id) AS rn FROM ae) WHERE rn BETWEEN 251 AND 350""",
)
cte(
    "numbered",
    "ae fold_crit",
    f"SELECT ({_OPEN})::BIGINT AS opened, row_number() OVER (ORDER BY us, event_id) AS rn, count(*) OVER () AS n FROM ae",
)
check(
    "s08_replay_batches",
    "numbered",
    """SELECT step::BIGINT AS step, 1::BIGINT AS success, (high - low)::BIGINT AS processed, high::BIGINT AS cursor, n AS total_events,
(SELECT coalesce(sum(opened), 0) FROM numbered WHERE rn > low AND rn <= high)::BIGINT AS alerts_raised,
CASE WHEN high > low THEN 1::BIGINT END AS timed, NULL::VARCHAR AS error FROM (
SELECT step, least(low, n) AS low, least(high, n) AS high, n FROM (SELECT DISTINCT n FROM numbered),
(VALUES (1, 0, 250), (2, 250, 350), (3, 350, 9223372036854775807), (4, 9223372036854775807, 9223372036854775807)) v(step, low, high))""",
)
check(
    "s09_latency_stats",
    "ae",
    f"""SELECT n, {r("mean_ms", "p50_ms", "p95_ms", "p99_ms", "wall_time_s", "throughput_events_per_sec=n / wall_time_s")} FROM (
SELECT count(*) AS n, avg(l) AS mean_ms, quantile_cont(l, 0.5) AS p50_ms, quantile_cont(l, 0.95) AS p95_ms, quantile_cont(l, 0.99) AS p99_ms,
sum(l) / 1000.0 AS wall_time_s FROM (SELECT session_duration_s * 1000.0::DOUBLE AS l FROM ae))""",
)
_SUPPRESSED = "event_id IN (SELECT event_id FROM fold_crit WHERE NOT opened)"
check(
    "s10_flat_results",
    "risk rtext fold_crit",
    f"""SELECT event_id, entity_id, entity_type, {TS_COLUMN}, {r("anomaly_score_raw", "anomaly_score=anomaly_score_raw", "baseline_rule", "risk_score", digits=4)},
sev AS severity, 'UNKNOWN' AS predicted_attack_type, 0.0::DOUBLE AS attack_confidence, ({_OPEN})::BIGINT AS alerted, ({_SUPPRESSED})::BIGINT AS alert_suppressed,
0::BIGINT AS profile_updated, profile_source, {r("profile_confidence", "entity_evidence_state=state", digits=4)}, short_reason FROM risk JOIN rtext USING (event_id)""",
)
check(
    "s12_tumbling_alerts",
    "risk",
    f"SELECT {ts('time_bucket(INTERVAL 6 HOURS, timestamp, TIMESTAMP 1970-01-01)'.replace('1970-01-01', chr(39) + '1970-01-01' + chr(39)))} AS bucket, sev AS severity, count(*) AS n FROM risk GROUP BY ALL",
)
check(
    "s13_run_counters",
    "risk fold_crit",
    f"SELECT count(*) AS n_events, count(*) FILTER ({_OPEN}) AS n_alerts, count(*) FILTER ({_SUPPRESSED}) AS n_suppressed FROM risk",
)

# -- evaluation -----------------------------------------------------------------------------------------------------------
_F1 = "2 * precision * recall / nullif(precision + recall, 0)"


def ratios(inner: str, keep: str = "*") -> str:
    """Add precision, recall, fpr and f1 to rows with tp, fp, tn, fn."""
    return f"""SELECT {keep}, {r("precision", "recall", "fpr", f"f1={_F1}")} FROM (SELECT *, tp::DOUBLE / nullif(tp + fp, 0) AS precision,
tp::DOUBLE / nullif(tp + fn, 0) AS recall, fp::DOUBLE / nullif(fp + tn, 0) AS fpr FROM ({inner}))"""


def confusion(truth: str, predicted: str) -> str:
    return (
        f"count(*) FILTER ({truth} AND {predicted}) AS tp, count(*) FILTER (NOT {truth} AND {predicted}) AS fp, "
        f"count(*) FILTER (NOT {truth} AND NOT {predicted}) AS tn, count(*) FILTER ({truth} AND NOT {predicted}) AS fn"
    )


cte("ranked", "ev", "SELECT *, row_number() OVER (ORDER BY anomaly_score_raw DESC, us, event_id) AS pos, count(*) OVER () AS n FROM ev")


def budget(f: float) -> str:
    return f"pos <= greatest(1, ceil(n * {f}::DOUBLE))"


cte(
    "curve",
    "ev",
    """SELECT s, pos, neg, sum(pos) OVER w AS ctp, sum(neg) OVER w AS cfp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM (
SELECT anomaly_score_raw AS s, count(*) FILTER (is_attack) AS pos, count(*) FILTER (NOT is_attack) AS neg FROM ev GROUP BY 1) WINDOW w AS (ORDER BY s DESC)""",
)
_PR = "sum(pos * ctp / (ctp + cfp)::DOUBLE) / max(p)"
_ROC = "sum(neg * (ctp - pos / 2.0)) / (max(p)::DOUBLE * max(n))"
check("v01_budget_mask", "ranked", f"SELECT event_id FROM ranked WHERE {budget(0.01)}")
check("v02_confusion_counts", "ev thr", ratios(f"SELECT {confusion('is_attack', '(anomaly_score_raw >= sensitive)')} FROM ev, thr", "tp, fp, tn, fn"))
check("v03_average_precision", "curve", f"SELECT {r('pr_auc=' + _PR)} FROM curve")
check("v04_roc_auc", "curve", f"SELECT {r('roc_auc=' + _ROC)} FROM curve")


def detection(alert: str, edge: str, point: str) -> str:
    inner = f"""SELECT count(*) AS n_events, count(*) FILTER (is_attack) AS n_positives, avg(is_attack::INT) AS prevalence, {edge} AS threshold,
count(*) FILTER ({alert}) AS n_alerts, avg(({alert})::INT) AS alert_rate, {confusion("is_attack", f"({alert})")} FROM ranked, thr"""
    keep = f"n_events, n_positives, n_alerts, tp, fp, tn, fn, '{point}' AS operating_point, {r('prevalence', 'threshold', 'alert_rate')}"
    return f"SELECT * FROM ({ratios(inner, keep)}), (SELECT {r('pr_auc=' + _PR, 'roc_auc=' + _ROC)} FROM curve)"


_AT_BUDGET = detection(budget(0.01), f"min(anomaly_score_raw) FILTER ({budget(0.01)})", "budget_0.01")
check(
    "v05_detection_metrics",
    "ranked thr curve",
    _AT_BUDGET + " UNION ALL BY NAME " + detection("anomaly_score_raw >= sensitive", "max(sensitive)", "threshold"),
)
check(
    "v06_pr_curve",
    "curve",
    f"SELECT {r('recall=ctp::DOUBLE / p', 'precision=ctp::DOUBLE / (ctp + cfp)', 'threshold=s')} FROM curve WHERE p > 0",
)
_ROC_POINTS = f"""SELECT 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr, 'inf'::DOUBLE AS threshold UNION ALL
SELECT {r("fpr=cfp::DOUBLE / n", "tpr=ctp::DOUBLE / p", "threshold=s")} FROM (SELECT *, lead(pos) OVER w AS np, lead(neg) OVER w AS nn, row_number() OVER w AS i
FROM curve WINDOW w AS (ORDER BY s DESC)) WHERE i = 1 OR np IS NULL OR np <> pos OR nn <> neg"""
check("v07_roc_curve", "curve", _ROC_POINTS)


def _sweep(f: float) -> str:
    inner = f"""SELECT {f}::DOUBLE AS budget_fraction, count(*) FILTER ({budget(f)}) AS n_alerts, min(anomaly_score_raw) FILTER ({budget(f)}) AS threshold,
{confusion("is_attack", f"({budget(f)})")} FROM ranked"""
    return ratios(inner, f"budget_fraction, n_alerts, {r('threshold')}")


_SWEEP = " UNION ALL ".join(_sweep(f) for f in BUDGET_FRACTIONS)
check("v08_budget_sweep", "ranked", _SWEEP)
check("q24_budget_sweep", "ranked", _SWEEP)
check(
    "q24_performance_kpis",
    "ranked thr curve",
    f"SELECT pr_auc, roc_auc, recall, precision, fpr, prevalence, operating_point FROM ({_AT_BUDGET})",
)
cte("pred", "ev sig", "SELECT ev.*, predicted_label FROM ev JOIN sig USING (event_id)")


def _class(name: str) -> str:
    return f"""SELECT '{name}' AS class, count(*) FILTER (label = '{name}' AND predicted_label = '{name}') AS tp,
count(*) FILTER (predicted_label = '{name}') AS np, count(*) FILTER (label = '{name}') AS support FROM pred"""


_CLASSES = " UNION ALL ".join(_class(c) for c in LABELS)
_PER_CLASS = f"""SELECT class, coalesce(tp::DOUBLE / nullif(np, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(support, 0), 0) AS recall,
coalesce(2.0 * tp / nullif(np + support, 0), 0) AS f1, support FROM ({_CLASSES})"""
check("v09_per_class", "pred", f"SELECT class, support, {r('precision', 'recall', 'f1')} FROM ({_PER_CLASS})")
check(
    "v10_confusion_matrix",
    "pred",
    " UNION ALL ".join(
        f"SELECT '{t}' AS truth, "
        + ", ".join(f"count(*) FILTER (label = '{t}' AND predicted_label = '{c}') AS {c}" for c in LABELS)
        + " FROM pred"
        for t in LABELS
    ),
)


def campaign_cte(name: str, alerted: str) -> None:
    cte(
        name,
        "ev thr",
        f"""SELECT campaign_id, arg_min(label, (us, event_id)) AS label, count(*) AS n_events, min(us) AS start_us, first_us,
  first_us IS NOT NULL AS detected, (first_us - min(us)) / 1e6 AS latency_seconds,
  CASE WHEN first_us IS NOT NULL THEN count(*) FILTER (us < first_us) END AS events_before_detection
FROM (SELECT *, min(us) FILTER ({alerted}) OVER (PARTITION BY campaign_id) AS first_us FROM ev, thr WHERE campaign_id IS NOT NULL) GROUP BY campaign_id, first_us""",
    )


campaign_cte("found", "anomaly_score_raw >= sensitive")
campaign_cte("found_strict", "anomaly_score_raw >= strict")
check(
    "v11_campaign_detection",
    "found",
    f"SELECT campaign_id, label, n_events, detected::BIGINT AS detected, {r('latency_seconds')}, events_before_detection FROM found",
)
check(
    "v11_campaign_summary",
    "found",
    f"""SELECT count(*) AS n_campaigns, count(*) FILTER (detected) AS n_detected, {r("campaign_recall=avg(detected::INT)")},
{r("median_latency_seconds=quantile_cont(latency_seconds, 0.5) FILTER (detected)", "median_events_before_detection=quantile_cont(events_before_detection, 0.5) FILTER (detected)")} FROM found""",
)
check(
    "v12_recall_at_fpr",
    "ev",
    " UNION ALL ".join(
        f"""SELECT {f}::DOUBLE AS fpr_target, {r("threshold=t", "recall=avg((anomaly_score_raw >= t)::INT) FILTER (is_attack)", "achieved_fpr=avg((anomaly_score_raw >= t)::INT) FILTER (NOT is_attack)")}
FROM ev, (SELECT quantile_cont(anomaly_score_raw, {1.0 - f}) AS t FROM ev WHERE NOT is_attack) GROUP BY t"""
        for f in FPR_TARGETS
    ),
)
_Q = {"q50": 0.5, "q90": 0.9, "q95": 0.95, "q99": 0.99, "q100": 1.0}
check(
    "v13_score_distribution",
    "ev",
    " UNION ALL ".join(
        f"SELECT '{side}' AS side, count(*) AS n, "
        + r("mean=avg(s)", "std=stddev_pop(s)", "min=min(s)", *[f"{k}=quantile_cont(s, {v})" for k, v in _Q.items()])
        + f" FROM (SELECT anomaly_score_raw AS s FROM ev WHERE {where})"
        for side, where in (("benign", "NOT is_attack"), ("attack", "is_attack"))
    ),
)


def _subset(column: str, name: str, where: str, extra: str = "") -> str:
    """Benign rows plus one subset of attacks; benign first where scores tie at the edge."""
    base = f"SELECT anomaly_score_raw AS s, us, event_id, ({where}) AS y FROM ev WHERE label = 'BENIGN' OR ({where})"
    groups = f"SELECT s, count(*) FILTER (y) AS pos, count(*) FILTER (NOT y) AS neg FROM ({base}) GROUP BY 1"
    curve = f"""SELECT *, sum(pos) OVER w AS ctp, sum(neg) OVER w AS cfp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM ({groups})
WINDOW w AS (ORDER BY s DESC)"""
    top = f"""SELECT count(*) FILTER (y AND i <= greatest(1, ceil(m * 0.01::DOUBLE)))::DOUBLE / nullif(count(*) FILTER (y), 0) AS rb FROM (
SELECT y, row_number() OVER (ORDER BY s DESC, y, us, event_id) AS i, count(*) OVER () AS m FROM ({base}))"""
    return f"""SELECT '{name}' AS {column}, sum(pos)::BIGINT AS n, {r(f"pr_auc=CASE WHEN sum(pos) > 0 THEN {_PR} END", f"roc_auc=CASE WHEN sum(pos) > 0 THEN {_ROC} END")},
(SELECT {r("rb")} FROM ({top})) AS recall_at_budget{extra} FROM ({curve})"""


check(
    "v15_per_attack_type",
    "ev",
    " UNION ALL ".join(
        _subset("attack_type", a, f"label = '{a}'", f", {int(a == 'INSIDER_DRIFT')}::BIGINT AS is_edge_case") for a in ATTACKS
    ),
)
check(
    "v16_obvious_vs_stealth",
    "ev",
    _subset("subset", "obvious", "is_attack AND NOT stealthy") + " UNION ALL " + _subset("subset", "stealth", "is_attack AND stealthy"),
)


def report_cte(name: str, found: str) -> None:
    kinds = "string_agg(DISTINCT entity_type, '|' ORDER BY entity_type)"
    cte(
        name,
        f"{found} scored camp",
        f"""SELECT f.*, attack_type, stealthy, CASE WHEN stealthy THEN 'stealth' ELSE 'obvious' END AS difficulty, straddles_split, entity_type_group, entity_type_evaluation,
  (first_us - true_start_us) / 1e6 AS latency_seconds_true_start, events_before_detection::DOUBLE / n_events * 100.0 AS pct_events_before_detection
FROM {found} f JOIN camp USING (campaign_id) JOIN (SELECT campaign_id, min(us) AS true_start_us, bool_or(split = 'train') AS straddles_split,
  {kinds} AS entity_type_group FROM scored WHERE campaign_id IS NOT NULL GROUP BY 1) USING (campaign_id)
JOIN (SELECT campaign_id, {kinds} AS entity_type_evaluation FROM scored WHERE campaign_id IS NOT NULL AND split = 'evaluation' GROUP BY 1) USING (campaign_id)""",
    )


report_cte("report", "found")
report_cte("report_strict", "found_strict")
check(
    "v17_campaign_report",
    "report",
    f"""SELECT campaign_id, label, n_events, events_before_detection, detected::BIGINT AS detected, straddles_split::BIGINT AS straddles_split,
entity_type_group, entity_type_evaluation, attack_type, stealthy::BIGINT AS stealthy, difficulty,
{r("latency_seconds", "latency_seconds_true_start", "pct_events_before_detection")} FROM report""",
)
check(
    "v18_breakdown",
    "report",
    " UNION ALL ".join(
        f"""SELECT '{by}' AS by, {by} AS key, count(*) AS n_campaigns, count(*) FILTER (detected) AS n_detected, {r("detection_rate=avg(detected::INT)")},
{r("median_latency_seconds=quantile_cont(latency_seconds, 0.5) FILTER (detected)", "median_pct_events_before_detection=quantile_cont(pct_events_before_detection, 0.5) FILTER (detected)")}
FROM report WHERE label IN {BAD} GROUP BY {by}"""
        for by in ("label", "difficulty", "entity_type_group")
    ),
)
check(
    "v19_subset_summary",
    "report",
    f"""SELECT CASE WHEN label = 'INSIDER_DRIFT' THEN 'insider_drift' ELSE 'malicious' END AS subset, count(*) AS n_campaigns, count(*) FILTER (detected) AS n_detected,
{r("detection_rate=avg(detected::INT)", "median_latency_seconds=quantile_cont(latency_seconds, 0.5) FILTER (detected AND NOT straddles_split)")},
{r("median_events_before_detection=quantile_cont(events_before_detection, 0.5) FILTER (detected AND NOT straddles_split)")},
count(*) FILTER (detected AND straddles_split) AS n_latency_excluded_straddling FROM report GROUP BY 1""",
)
check("v19_missed_campaigns", "report_strict", "SELECT campaign_id, label, n_events FROM report_strict WHERE NOT detected")
_METHODS = {"anomaly_score_raw": "anomaly_score_raw", "baseline_rule": "baseline_rule", "risk_score": "risk_score"}
cte(
    "matched",
    "risk",
    "SELECT "
    + ", ".join(f"quantile_cont({s}, 0.99) AS t_{s}" for s in _METHODS)
    + " FROM risk WHERE split = 'train' AND label = 'BENIGN'",
)
_GATES = [(s, s, f"t_{s}") for s in _METHODS] + [
    ("hybrid_severity_high", "risk_score", "61.0::DOUBLE"),
    ("hybrid_deployed", "risk_score", "81.0::DOUBLE"),
]
check(
    "v20_matched_thresholds",
    "risk matched",
    " UNION ALL ".join(
        "SELECT method, tp, fp, tn, fn, round(threshold, 4) + 0.0 AS threshold, round(precision, 4) + 0.0 AS precision, "
        "round(recall, 4) + 0.0 AS recall, round(fpr, 4) + 0.0 AS fpr, round(f1, 4) + 0.0 AS f1 FROM ("
        + ratios(
            f"SELECT '{name}' AS method, max({t}) AS threshold, {confusion('is_attack', f'({s} >= {t})')} FROM risk, matched WHERE split = 'evaluation'",
            "method, threshold, tp, fp, tn, fn",
        )
        + ")"
        for name, s, t in _GATES
    ),
)
cte(
    "caught",
    "risk matched",
    """SELECT *, anomaly_score_raw >= t_anomaly_score_raw * 1.1::DOUBLE AS forest, baseline_rule >= t_baseline_rule AS rule_hit, risk_score >= t_risk_score AS hybrid
FROM risk, matched WHERE split = 'evaluation'""",
)
check(
    "v21_method_overlap",
    "caught",
    f"""SELECT campaign_id, label, CASE WHEN m = 0 THEN 'none' WHEN m = 3 THEN 'all_three' WHEN f AND r THEN 'if_and_rule_not_hybrid'
WHEN f AND h THEN 'if_and_hybrid_not_rule' WHEN r AND h THEN 'rule_and_hybrid_not_if' WHEN f THEN 'if_only' WHEN r THEN 'rule_only' ELSE 'hybrid_only' END AS overlap,
(m >= 2)::BIGINT AS multiple_methods FROM (SELECT *, f::INT + r::INT + h::INT AS m FROM (SELECT campaign_id, arg_min(label, (us, event_id)) AS label,
bool_or(forest) AS f, bool_or(rule_hit) AS r, bool_or(hybrid) AS h FROM caught WHERE campaign_id IS NOT NULL GROUP BY 1)) WHERE label IN {BAD}""",
)
check(
    "v22_hard_categories",
    "caught",
    f"""SELECT h.label, count(caught.label) AS n_events, {r("forest_recall=avg(forest::INT)", "rule_recall=avg(rule_hit::INT)", "hybrid_recall=avg(hybrid::INT)")}
FROM (SELECT unnest([{q(HARD_CATEGORIES)}]) AS label) h LEFT JOIN caught USING (label) GROUP BY 1""",
)
check(
    "v23_alert_burden",
    "alert_crit ev fold_crit",
    f"""SELECT n_alerts, n_high, n_critical, unique_entities_alerted, n_suppressed, {r("alerts_per_1000_benign=1000.0 * n_alerts / n_benign", digits=4)}
FROM (SELECT count(*) AS n_alerts, count(*) FILTER (sev = 'HIGH') AS n_high, count(*) FILTER (sev = 'CRITICAL') AS n_critical,
count(DISTINCT entity_id) AS unique_entities_alerted FROM alert_crit WHERE split = 'evaluation'),
(SELECT greatest(1, count(*)) AS n_benign FROM ev WHERE label = 'BENIGN'), (SELECT count(*) FILTER (NOT opened) AS n_suppressed FROM fold_crit)""",
)
_HIT = "(label = predicted_label)::INT"
check(
    "v24_classifier_report",
    "pred",
    f"""SELECT * FROM ({ratios(f"SELECT count(*) AS n_evaluation_events, avg({_HIT}) AS acc, avg({_HIT}) FILTER (label IN {BAD}) AS top1, avg({_HIT}) FILTER (label = 'INSIDER_DRIFT') AS insider, "
    + confusion(f"(label IN {BAD})", f"(predicted_label IN {BAD})") + " FROM pred",
    "n_evaluation_events, tp, fp, tn, fn, " + r("overall_accuracy=acc", "malicious_top1_accuracy=top1", "insider_drift_recall=insider"))}),
(SELECT {r("macro_f1_present_classes=avg(f1) FILTER (support > 0)")} FROM ({_PER_CLASS}))""",
)
check(
    "v25_metrics_document",
    "curve",
    f"""SELECT 'detection' AS section, 1 AS n_records UNION ALL SELECT 'pr_curve', count(*) FROM curve UNION ALL SELECT 'roc_curve', count(*) FROM ({_ROC_POINTS})
UNION ALL SELECT 'budget_sweep', 7 UNION ALL SELECT 'confusion_matrix', 8 UNION ALL SELECT 'per_class', 8 UNION ALL SELECT 'campaign_detection', 1""",
)

# -- analyst queries ---------------------------------------------------------------------------------------------------------
cte(
    "al",
    "alert_high sig",
    "SELECT alert_high.*, sev AS severity, predicted_label AS attack_type, attack_confidence, a_forest AS anomaly_score, "
    f"{_SEQ} AS sequence_score FROM alert_high JOIN sig USING (event_id)",
)
_MINUTE = "strftime(timestamp, '%Y-%m-%d %H:%M')"
_BUCKET = ts("time_bucket(INTERVAL 6 HOURS, timestamp, TIMESTAMP '1970-01-01')")
check(
    "q01_overview",
    "ae al",
    f"""SELECT *, {r("alert_rate=active_alerts::DOUBLE / events_processed")} FROM (SELECT count(*) AS events_processed, count(DISTINCT entity_id) AS entities_monitored FROM ae),
(SELECT count(*) AS active_alerts, count(*) FILTER (severity = 'CRITICAL') AS critical_alerts FROM al)""",
)
check("q02_alert_timeline", "al", f"SELECT {_BUCKET} AS bucket, severity, count(*) AS n FROM al GROUP BY ALL")
check(
    "q02_alert_timeline_wide",
    "al",
    f"SELECT {_BUCKET} AS bucket, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in SEVERITIES) + " FROM al GROUP BY ALL",
)
check("q03_threat_distribution", "al", f"SELECT {case('attack_type', ATTACK_NAMES)} AS threat, count(*) AS n FROM al GROUP BY ALL")
check("q04_severity_distribution", "risk", "SELECT sev AS severity, count(*) AS n, 'scored events' AS source FROM risk GROUP BY 1")
_TYPE = case("entity_type", ENTITY_TYPE_NAMES)
check("q05_entity_types", "ae", f"SELECT {_TYPE} AS entity_type, count(DISTINCT entity_id) AS n FROM ae GROUP BY ALL")
check("q05_entity_types_from_alerts", "al", f"SELECT {_TYPE} AS entity_type, count(DISTINCT entity_id) AS n FROM al GROUP BY ALL")
check(
    "q06_top_risk_entities",
    "al",
    f"""SELECT entity_id, entity_type AS type, {r("risk_score", digits=4)}, {case("attack_type", ATTACK_NAMES)} AS primary_signal FROM (
SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY risk_score DESC, event_id DESC) = 1 ORDER BY risk_score DESC, entity_id LIMIT 10)""",
)
check(
    "q07_recent_critical",
    "al",
    f"SELECT event_id, {TS_COLUMN}, severity, {r('risk_score', digits=4)} FROM (SELECT * FROM al WHERE severity = 'CRITICAL' ORDER BY us DESC, risk_score DESC LIMIT 8)",
)
check(
    "q08_filter_alerts",
    "al",
    f"""SELECT event_id, entity_id, attack_type, {r("risk_score", digits=4)} FROM al WHERE severity IN ('HIGH', 'CRITICAL') AND attack_type IN ('BRUTE_FORCE', 'IMPOSSIBLE_TRAVEL')
AND entity_type = 'user' AND risk_score >= 62.0 AND regexp_matches(entity_id, 'ent-0000[0-9]', 'i')""",
)
check(
    "q09_queue_summary",
    "al",
    f"""SELECT count(*) AS matching_alerts, count(*) FILTER (severity = 'CRITICAL') AS critical_alerts, {r("peak_risk=max(risk_score)", digits=4)},
count(DISTINCT entity_id) AS distinct_entities FROM al WHERE entity_type IN ('user', 'edge_device')""",
)
check(
    "q10_queue_table",
    "al",
    f"""SELECT {_MINUTE} AS timestamp, entity_id AS entity, {_TYPE} AS type, {case("attack_type", ATTACK_NAMES)} AS predicted_type,
round_even(attack_confidence * 100, 0)::INT::VARCHAR || '%' AS confidence, {r("risk=risk_score", digits=4)}, severity, short_reason AS top_reason
FROM (SELECT * FROM al ORDER BY risk_score DESC, us DESC, alert_id LIMIT 50)""",
)
check(
    "q11_alert_by_id",
    "al",
    f"SELECT alert_id, event_id, severity, {r('risk_score', digits=4)} FROM al WHERE alert_id = (SELECT max(alert_id) FROM al)",
)
check("q12_split_reasons", "al reasons", "SELECT alert_id, place, code FROM al JOIN reasons USING (event_id)")
_COMPONENTS = {f"{k}_contribution": f"{v} * scale" for k, v in _PARTS.items()}
_TITLED = "CASE code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in REASON_NAMES.items()) + " ELSE code END"
check(
    "q13_score_contributions",
    "al reasons",
    f"""SELECT alert_id, factor, {r("contribution", digits=3)} FROM (
SELECT alert_id, {_TITLED} AS factor, round_even(v, 3) AS contribution FROM al JOIN reasons USING (event_id) WHERE severity = 'CRITICAL' UNION ALL """
    + " UNION ALL ".join(
        f"SELECT alert_id, '{COMPONENT_NAMES[k]}' AS factor, {e} AS contribution FROM al WHERE severity <> 'CRITICAL' AND risk_score < 72 AND {e} > 0"
        for k, e in _COMPONENTS.items()
    )
    + " UNION ALL "
    + " UNION ALL ".join(
        f"SELECT alert_id, '{v}' AS factor, coalesce({k} / nullif(anomaly_score + sequence_score + attack_confidence, 0), {k}) AS contribution FROM al WHERE severity <> 'CRITICAL' AND risk_score >= 72"
        for k, v in SCORE_NAMES.items()
    )
    + ")",
)
check("q14_entity_ids", "ae", "SELECT DISTINCT entity_id FROM ae WHERE entity_type = 'user' AND entity_id LIKE '%1%'")
cte("worst", "al", "SELECT entity_id FROM al ORDER BY risk_score DESC, entity_id LIMIT 1")
check("q15_entity_lookup", "ae worst", "SELECT event_id, resource_accessed FROM ae JOIN worst USING (entity_id)")
_CONF = "CASE WHEN n < 5 THEN least(0.3, n / 5.0 * 0.3) WHEN n < 60 THEN least(1.0, 0.3 + 0.7 * (n - 5) / 55.0) ELSE 1.0 END"
_STAGE = "CASE WHEN n < 5 THEN 'cold-start' WHEN n < 60 THEN 'blending' ELSE 'mature' END"
check(
    "q16_profile_confidence",
    "ae",
    f"SELECT entity_id, n AS events_observed, {r('profile_confidence=' + _CONF)}, {_STAGE} AS profile_stage FROM (SELECT entity_id, count(*) AS n FROM ae GROUP BY 1)",
)
check(
    "q17_streamed_confidence",
    "features",
    f"""SELECT entity_id, {r("profile_confidence")}, CASE profile_source WHEN 'cohort' THEN 'cold-start' WHEN 'entity' THEN 'mature' ELSE profile_source END AS profile_stage
FROM features QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY us DESC, event_id DESC) = 1""",
)
check(
    "q18_entity_summaries",
    "ae al risk",
    f"""SELECT entity_id, entity_type, role, n AS events_observed, {ts("a")} AS first_seen, {ts("b")} AS last_seen, coalesce(open_alerts, 0) AS open_alerts,
{r("profile_confidence=" + _CONF, digits=4)}, {_STAGE} AS profile_stage, {r("peak_risk", "mean_risk", digits=4)}
FROM (SELECT entity_id, entity_type, role, count(*) AS n, min(timestamp) AS a, max(timestamp) AS b FROM ae GROUP BY ALL)
LEFT JOIN (SELECT entity_id, count(*) AS open_alerts FROM al GROUP BY 1) USING (entity_id)
LEFT JOIN (SELECT entity_id, max(risk_score) AS peak_risk, avg(risk_score) AS mean_risk FROM risk GROUP BY 1) USING (entity_id)""",
)
_CARDS = {
    "hour": ("lpad(extract(hour FROM timestamp)::VARCHAR, 2, '0') || ':00'", "n DESC, value", 4),
    "location": ("city || ', ' || country", "value", 8),
    "device": ("device_id", "value", 8),
    "resource": ("resource_accessed", "n DESC, value", 8),
    "auth": ("auth_method", "value", 6),
}
check(
    "q19_behaviour_cards",
    "ae",
    " UNION ALL ".join(
        f"""SELECT entity_id, '{item}' AS item, place, value, n FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY {order}) AS place FROM (
SELECT entity_id, {value} AS value, count(*) AS n FROM ae GROUP BY ALL)) WHERE place <= {k}"""
        for item, (value, order, k) in _CARDS.items()
    ),
)
check("q19_mean_session", "ae", f"SELECT entity_id, {r('avg_session_seconds=avg(session_duration_s)')} FROM ae GROUP BY 1")
check(
    "q20_event_history",
    "ae worst",
    f"""SELECT {_MINUTE} AS timestamp, resource_accessed AS resource, city, country, auth_method AS auth, CASE WHEN auth_success THEN 'yes' ELSE 'no' END AS success,
device_id AS device, {r("session_s=session_duration_s")} FROM (SELECT ae.* FROM ae JOIN worst USING (entity_id) ORDER BY us DESC, event_id DESC LIMIT 200)""",
)
check(
    "q21_alert_history",
    "al worst",
    f"""SELECT {_MINUTE} AS timestamp, severity, {case("attack_type", ATTACK_NAMES)} AS predicted_type, {r("risk=risk_score", digits=4)}, short_reason AS reason
FROM (SELECT al.* FROM al JOIN worst USING (entity_id) ORDER BY risk_score DESC, us DESC, alert_id LIMIT 8)""",
)
check("q22_risk_timeline", "risk", f"SELECT entity_id, {TS_COLUMN}, {r('risk_score', digits=4)} FROM risk")
check("q23_triggering_events", "al ae", "SELECT event_id, alert_id, resource_accessed, city, device_id FROM al JOIN ae USING (event_id)".replace("al JOIN ae", "(SELECT alert_id, event_id FROM al) JOIN ae"))
check(
    "q25_streaming_preview",
    "risk rtext fold_crit",
    f"""SELECT strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, entity_id AS entity, {r("risk=risk_score", digits=4)}, sev AS severity, 'UNKNOWN' AS predicted_type,
0.0::DOUBLE AS confidence, ({_OPEN})::BIGINT AS alerted, short_reason AS reason FROM (SELECT * FROM risk JOIN rtext USING (event_id) ORDER BY us DESC, event_id DESC LIMIT 25)""",
)
check(
    "q26_score_histogram",
    "ev",
    f"""SELECT is_attack::BIGINT AS is_attack, bin, count(*) AS n, {r("low=lo + (bin - 1) * w", "high=lo + bin * w")} FROM (
SELECT *, least(59, floor((anomaly_score_raw - lo) / w) + 1)::BIGINT AS bin FROM ev, (SELECT min(anomaly_score_raw) AS lo, (max(anomaly_score_raw) - min(anomaly_score_raw)) / 59 AS w FROM ev))
GROUP BY is_attack, bin, lo, w""",
)

# -- the rest of the reports ---------------------------------------------------------------------------------------------------
_REASON = "code || ' (+' || format('{:.1f}', round_even(round_even(v, 3), 1)) || ')'"
check(
    "a04_normalise_alerts",
    "alert_crit reasons",
    f"""SELECT alert_id, {TS_COLUMN}, entity_id, entity_type, event_id, {r("anomaly_score=a_forest", f"sequence_score={_SEQ}", "risk_score", digits=4)},
NULL::VARCHAR AS attack_type, 0.0::DOUBLE AS attack_confidence, sev AS severity, short_reason, reasons, reason_codes
FROM alert_crit JOIN (SELECT event_id, string_agg({_REASON}, ' + ' ORDER BY place) AS reasons FROM reasons GROUP BY 1) USING (event_id)""",
)
cte("ranked_rule", "ev", CTES["ranked"][1].replace("anomaly_score_raw DESC", "baseline_rule DESC"))
cte("curve_rule", "ev", CTES["curve"][1].replace("anomaly_score_raw AS s", "baseline_rule AS s"))


def _long(detector: str, section: str, inner: str, columns: tuple[str, ...]) -> str:
    """The columns of a one-row select as (detector, metric, value) rows."""
    casts = ", ".join(f"({c})::DOUBLE AS {c}" for c in columns)
    return f"""SELECT '{detector}' AS detector, '{section}.' || name AS metric, {r("value")} 
FROM (SELECT {casts} FROM ({inner})) UNPIVOT INCLUDE NULLS (value FOR name IN ({", ".join(columns)}))"""


_DETECTION = tuple("n_events n_positives prevalence threshold n_alerts alert_rate tp fp tn fn precision recall fpr f1 pr_auc roc_auc".split())


def _report(score: str, ranked: str, curve: str) -> list[str]:
    swap = lambda text: (
        text.replace("anomaly_score_raw", score).replace("FROM ranked", f"FROM {ranked}").replace("FROM curve", f"FROM {curve}")
    )
    parts = [_long(score, "budget", swap(_AT_BUDGET), _DETECTION)]
    if score == "anomaly_score_raw":
        for point in OPERATING_POINTS:
            text = detection(f"anomaly_score_raw >= {point}", f"max({point})", "threshold")
            parts.append(_long(score, f"point_{point}", text, _DETECTION))
    for f in BUDGET_FRACTIONS:
        parts.append(_long(score, f"sweep.{f}", swap(_sweep(f)), ("n_alerts", "threshold", "precision", "recall", "fpr", "f1")))
    for f in FPR_TARGETS:
        inner = f"""SELECT t AS threshold, avg(({score} >= t)::INT) FILTER (is_attack) AS recall, avg(({score} >= t)::INT) FILTER (NOT is_attack) AS achieved_fpr
FROM ev, (SELECT quantile_cont({score}, {1.0 - f}) AS t FROM ev WHERE NOT is_attack) GROUP BY t"""
        parts.append(_long(score, f"recall_at_fpr.{f}", inner, ("threshold", "recall", "achieved_fpr")))
    for side, where in (("benign", "NOT is_attack"), ("attack", "is_attack")):
        quantiles = ", ".join(f"quantile_cont(s, {v}) AS {k}" for k, v in _Q.items())
        inner = f"SELECT count(*) AS n, avg(s) AS mean, stddev_pop(s) AS std, min(s) AS min, {quantiles} FROM (SELECT {score} AS s FROM ev WHERE {where})"
        parts.append(_long(score, f"distribution.{side}", inner, ("n", "mean", "std", "min", *_Q)))
    return parts


check(
    "v14_event_level_report",
    "ranked ranked_rule curve curve_rule thr ev",
    " UNION ALL ".join(_report("baseline_rule", "ranked_rule", "curve_rule") + _report("anomaly_score_raw", "ranked", "curve")),
)

# What-if: the injected events after their entities' history, scored alone.
cte(
    "hist",
    "ae inj",
    """SELECT * FROM ae WHERE entity_id IN (SELECT entity_id FROM inj) AND us < (SELECT min(us) FROM inj)
UNION ALL SELECT inj.* FROM inj""",
)
cte("h_inj", "hist cut", CTES["h"][1].replace("SELECT ae.*", "SELECT hist.*").replace("FROM ae, cut", "FROM hist, cut"))
cte("trail_inj", "h_inj", CTES["trail"][1].replace("FROM h a LEFT JOIN h b", "FROM h_inj a LEFT JOIN h_inj b"))
cte("features_inj", "h_inj resolved trail_inj moments counts sizes", _features("resolved", "h_inj", "trail_inj"))
cte("scored_inj", "features_inj rule inj", CTES["scored"][1].replace("FROM features, rule", "FROM features, rule WHERE event_id IN (SELECT event_id FROM inj)").replace("features.*", "features_inj.*").replace("FROM features,", "FROM features_inj,"))
cte("act_inj", "scored_inj cal", CTES["act"][1].replace("scored.*", "scored_inj.*").replace("FROM scored,", "FROM scored_inj,"))
cte("inst_inj", "act_inj", CTES["inst"][1].replace("FROM act", "FROM act_inj"))
cte("seq_inj", "inst_inj", CTES["seq"][1].replace("FROM inst", "FROM inst_inj"))
cte("walk_inj", "seq_inj", CTES["walk"][1].replace("FROM seq WHERE", "FROM seq_inj WHERE").replace("FROM walk w JOIN seq s", "FROM walk_inj w JOIN seq_inj s"))
cte("risk_inj", "inst_inj walk_inj", CTES["risk"][1].replace("inst.", "inst_inj.").replace("inst_inj.inst +", "inst_inj.inst +").replace("walk.", "walk_inj.").replace("FROM inst JOIN walk", "FROM inst_inj JOIN walk_inj"))
cte("page_inj", "risk_inj", CTES["page_crit"][1].replace("FROM risk ", "FROM risk_inj "))
cte("fold_inj", "page_inj", CTES["fold_crit"][1].replace("page_crit", "page_inj").replace("fold_crit", "fold_inj"))
check(
    "s11_what_if",
    "risk_inj fold_inj",
    f"""SELECT event_id, {r("instantaneous_evidence=inst", "risk_score", digits=4)}, sev AS risk_severity,
(event_id IN (SELECT event_id FROM fold_inj WHERE opened))::BIGINT AS alerted FROM risk_inj""",
)

# Sections of the metrics document read back.
ORACLE["q24_pr_curve"] = ORACLE["v06_pr_curve"]
ORACLE["q24_confusion_matrix"] = ORACLE["v10_confusion_matrix"]
ORACLE["q24_campaign_performance"] = ORACLE["v11_campaign_summary"]
check("q24_roc_curve", "curve", f"SELECT fpr, tpr, CASE WHEN isfinite(threshold) THEN threshold END AS threshold FROM ({_ROC_POINTS})")
check(
    "q24_per_class",
    "pred",
    f"SELECT {case('class', ATTACK_NAMES)} AS class, support, {r('precision', 'recall', 'f1')} FROM ({_PER_CLASS})",
)
