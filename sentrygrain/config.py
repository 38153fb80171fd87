"""Defaults of the analytics, kept as plain values."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Label, feature and severity names every table is keyed on.
# ---------------------------------------------------------------------------
BENIGN = "BENIGN"
INSIDER = "INSIDER_DRIFT"
LABELS = (
    "BENIGN",
    "BRUTE_FORCE",
    "IMPOSSIBLE_TRAVEL",
    "CREDENTIAL_STUFFING",
    "LATERAL_MOVEMENT",
    "DEVICE_SPOOFING",
    "LOW_AND_SLOW_EXFILTRATION",
    "INSIDER_DRIFT",
)
ATTACKS = LABELS[1:]
MALICIOUS = tuple(name for name in ATTACKS if name != INSIDER)
HARD_CATEGORIES = ("DEVICE_SPOOFING", "IMPOSSIBLE_TRAVEL", "LATERAL_MOVEMENT")

FEATURES = (
    "hour",
    "day_of_week",
    "is_weekend",
    "inter_event_gap_s",
    "event_count_5m",
    "event_count_60m",
    "failed_auth_5m",
    "failed_auth_30m",
    "login_hour_rarity",
    "is_entity_off_hours",
    "location_rarity",
    "is_new_location",
    "geo_distance_from_baseline_km",
    "geo_distance_from_previous_km",
    "geo_velocity_kmh",
    "is_known_device",
    "device_rarity",
    "fingerprint_changed",
    "is_known_resource",
    "resource_rarity",
    "resource_sensitivity",
    "recent_resource_breadth_24h",
    "auth_method_rarity",
    "auth_failure_deviation",
    "session_duration_zscore",
    "transfer_volume_zscore",
    "transition_probability",
    "sequence_anomaly_score",
)
RULE_FEATURES = (
    "failed_auth_5m",
    "geo_velocity_kmh",
    "sequence_anomaly_score",
    "location_rarity",
    "device_rarity",
    "auth_failure_deviation",
)
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
# Upper bounds decide the band; lower bounds are the gates used in evaluation.
SEVERITY_UPPER = {"LOW": 30.0, "MEDIUM": 60.0, "HIGH": 80.0, "CRITICAL": 100.0}
SEVERITY_LOWER = {"LOW": 0.0, "MEDIUM": 31.0, "HIGH": 61.0, "CRITICAL": 81.0}
SENSITIVITY = {"low": 1.0, "medium": 2.0, "high": 3.0, "critical": 4.0}
OPERATING_POINTS = {"strict": 0.999, "balanced": 0.99, "sensitive": 0.95}
BUDGET_FRACTIONS = (0.001, 0.0025, 0.005, 0.01, 0.02, 0.05, 0.10)
FPR_TARGETS = (0.001, 0.01, 0.05)
EARTH_RADIUS_KM = 6371.0088

# Label columns are ground truth: they select rows, they are never inputs.
LABEL_COLUMNS = ("label", "is_attack", "campaign_id")
RISK_FORBIDDEN = LABEL_COLUMNS + ("attack_type", "stealthy", "difficulty", "split")
INFERENCE_FORBIDDEN = RISK_FORBIDDEN + ("predicted_label", "attack_confidence")


@dataclass(frozen=True)
class Signal:
    """One contextual risk signal and how its feature turns into [0, 1]."""

    name: str
    reason: str
    weight: float
    mode: str
    features: tuple[str, ...]
    low: float | None = None
    high: float | None = None


# The configured context signals, in their configured order.
CONTEXT_SIGNALS = (
    Signal("impossible_velocity", "IMPOSSIBLE_VELOCITY", 0.45, "fixed_ramp", ("geo_velocity_kmh",), 900.0, 2700.0),
    Signal("auth_failure_burst", "AUTH_FAILURE_BURST", 0.40, "ramp", ("failed_auth_5m",)),
    Signal("new_device", "NEW_DEVICE", 0.35, "inverse_boolean", ("is_known_device",)),
    Signal(
        "resource_traversal_pattern",
        "RESOURCE_TRAVERSAL_PATTERN",
        0.35,
        "min_of",
        ("recent_resource_breadth_24h", "sequence_anomaly_score"),
    ),
    Signal("unusual_location", "UNUSUAL_LOCATION", 0.30, "boolean", ("is_new_location",)),
    Signal("resource_breadth_spike", "RESOURCE_BREADTH_SPIKE", 0.30, "ramp", ("recent_resource_breadth_24h",)),
    Signal("rare_sequence_transition", "RARE_SEQUENCE_TRANSITION", 0.30, "ramp", ("sequence_anomaly_score",)),
    Signal("rare_resource", "RARE_RESOURCE", 0.25, "ramp", ("resource_rarity",)),
    Signal("activity_burst", "ACTIVITY_BURST", 0.20, "ramp", ("event_count_5m",)),
    Signal("unusual_transfer_volume", "UNUSUAL_TRANSFER_VOLUME", 0.20, "abs_ramp", ("transfer_volume_zscore",)),
    Signal("off_hours_activity", "OFF_HOURS_ACTIVITY", 0.15, "boolean", ("is_entity_off_hours",)),
    Signal("unusual_session_duration", "UNUSUAL_SESSION_DURATION", 0.15, "abs_ramp", ("session_duration_zscore",)),
)


@dataclass(frozen=True)
class RiskConfig:
    evidence_scale: float = 1.5
    low_quantile: float = 0.95
    high_quantile: float = 0.999
    halflife_seconds: float = 21600.0
    persistence_weight: float = 0.60
    state_cap: float = 4.0
    forest_weight: float = 1.00
    rule_weight: float = 0.80
    min_severity: str = "CRITICAL"
    cooldown_seconds: float = 3600.0
    escalation_bypasses_cooldown: bool = True
    max_reasons: int = 6
    forest_reason: str = "ISOLATION_FOREST_ANOMALY"
    rule_reason: str = "RULE_THRESHOLD_EXCEEDED"
    persistence_reason: str = "PERSISTENT_SUSPICIOUS_ACTIVITY"
    signals: tuple[Signal, ...] = CONTEXT_SIGNALS

    def __post_init__(self):
        unknown = {f for s in self.signals for f in s.features} - set(FEATURES)
        if unknown:
            raise ValueError(f"risk signals name unknown features: {sorted(unknown)}")

    def context_features(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(f for s in self.signals for f in s.features))


@dataclass(frozen=True)
class Config:
    train_fraction: float = 0.7
    seed: int = 42
    # features
    smoothing: float = 1.0
    std_floor: float = 1.0
    velocity_cap_kmh: float = 100000.0
    count_windows_s: tuple[int, int] = (300, 3600)
    failed_windows_s: tuple[int, int] = (300, 1800)
    breadth_window_s: int = 86400
    # profiles
    min_events_for_personal: int = 5
    maturity_events: int = 60
    cohort_keys: tuple[str, ...] = ("entity_type", "role")
    # adaptive profiles
    ewma_halflife_days: float = 14.0
    baseline_update_max_risk: float = 40.0
    rolling_window_days: float = 30.0
    # models
    forest_trees: int = 300
    forest_sample: int = 256
    fit_fraction: float = 0.80
    classifier_trees: int = 400
    classifier_depth: int = 18
    classifier_min_leaf: int = 3
    budget_fraction: float = 0.01
    risk: RiskConfig = field(default_factory=RiskConfig)
    # scale: rows of one entity beyond this are split over several tasks
    chunk_rows: int = 2_000_000
    # scale: profile maps beyond this many keys move to a joined table
    wide_profile_keys: int = 2_000


DEFAULTS = Config()
