"""Row detectors: rule baseline, seeded random baseline, scaler, thresholds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BENIGN, DEFAULTS, OPERATING_POINTS, RULE_FEATURES, Config
from .ranking import exact_quantiles


def training_rows(scored: DataFrame) -> DataFrame:
    return scored.where((F.col("split") == "train") & (F.col("label") == BENIGN))


def evaluation_rows(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("split") == "evaluation")


def classifier_rows(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("split") == "train")


@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation per column; a zero deviation counts as 1."""

    mean: dict[str, float]
    std: dict[str, float]

    def z(self, column: str) -> Column:
        return (F.col(column) - self.mean[column]) / self.std[column]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.z(c) for c in self.mean})


def fit_scaler(rows: DataFrame, columns: tuple[str, ...]) -> Scaler:
    stats = rows.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    ).first()
    if stats[f"m_{columns[0]}"] is None:
        raise ValueError("no rows to fit on")
    return Scaler({c: stats[f"m_{c}"] for c in columns}, {c: stats[f"s_{c}"] or 1.0 for c in columns})


def fit_rule_baseline(benign_train: DataFrame) -> Scaler:
    return fit_scaler(benign_train, RULE_FEATURES)


def rule_score(rule: Scaler) -> Column:
    """Sum of the standardised rule features."""
    total = rule.z(RULE_FEATURES[0])
    for column in RULE_FEATURES[1:]:
        total = total + rule.z(column)
    return total


def random_score(seed: int = DEFAULTS.seed, key: str = "event_id") -> Column:
    """Uniform in [0, 1), the same for the same event and seed in any order."""
    digest = F.md5(F.concat(F.col(key), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def display_score(raw: Column, low: float, high: float) -> Column:
    if high <= low:
        return F.lit(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (raw - low) / (high - low)))


def fit_thresholds(
    calibration_rows: DataFrame, score: str = "anomaly_score_raw", points: dict[str, float] = OPERATING_POINTS
) -> dict[str, float]:
    """Score thresholds at quantiles of benign calibration rows."""
    got = exact_quantiles(calibration_rows, {"s": F.col(score)}, list(points.values()))["s"]
    return dict(zip(points, got, strict=True))


def alert_mask(thresholds: dict[str, float], point: str, score: str = "anomaly_score_raw") -> Column:
    if point not in thresholds:
        raise KeyError(f"unknown operating point {point!r}; known: {sorted(thresholds)}")
    return F.col(score) >= thresholds[point]


def score_table(scored: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """Identity, labels and every detector's score per event."""
    return scored.select(
        "event_id",
        "timestamp",
        "entity_id",
        "entity_type",
        "split",
        "label",
        "is_attack",
        "campaign_id",
        "anomaly_score",
        "anomaly_score_raw",
        random_score(config.seed).alias("baseline_random"),
        "baseline_rule",
    )
