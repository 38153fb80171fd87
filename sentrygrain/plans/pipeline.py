"""The batch chain. Every stage is a table the next stages read.

Only fitted values (cutoff, thresholds, anchors, the forest) come to the driver.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS, FEATURES, LABEL_COLUMNS, SENSITIVITY, Config
from ..contracts import check_columns, event_faults, finite_faults, guard_leakage, guard_lineage, require_order
from ..operators import alerts as alerting
from ..operators import classifier, detectors, features, forest, prepare, profiles, risk
from ..sources import access_events as source
from ..sources import stages


def sensitivity_by_name() -> F.Column:
    """Sensitivity of a resource from the first part of its name."""
    table = {k: SENSITIVITY[v] for k, v in source.RESOURCE_SENSITIVITY.items()}
    named = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.try_element_at(named, F.substring_index("resource_accessed", "/", 1))


class Pipeline:
    """Lazily built stages over one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str, config: Config = DEFAULTS, events: DataFrame | None = None):
        self.spark, self.folder, self.config = spark, folder, config
        self._given = events

    @staticmethod
    def of(spark: SparkSession, folder: str, config: Config = DEFAULTS) -> "Pipeline":
        return stages.once(spark, ("pipeline", folder, config), lambda: Pipeline(spark, folder, config))

    @cached_property
    def events(self) -> DataFrame:
        given, checks = self._given, stages.Checks()
        rows = check_columns(source.access_events(self.spark, self.folder) if given is None else given)
        rows = checks.none(rows, "event table violates its contract", event_faults())
        return require_order(stages.save(rows, checks=checks))

    @cached_property
    def campaigns(self) -> DataFrame:
        return stages.save(source.campaigns(self.events))

    @cached_property
    def cutoff(self) -> int:
        return prepare.cutoff_micros(self.events, self.config.train_fraction)

    @cached_property
    def profiles(self) -> profiles.Profiles:
        return profiles.fit_profiles(self.events, self.cutoff, self.config)

    @cached_property
    def labelled(self) -> DataFrame:
        """Features, with the ground truth carried along as payload.

        No feature reads it; carrying it saves a join of two event-sized tables.
        """
        guard_leakage(FEATURES)
        rows = features.build_features(self.events, self.profiles, sensitivity_by_name(), self.config, keep=LABEL_COLUMNS)
        return save_features(rows)

    @cached_property
    def features(self) -> DataFrame:
        return self.labelled.drop(*LABEL_COLUMNS)

    # -- detectors with a closed form -------------------------------------------------
    @cached_property
    def rule(self) -> detectors.Scaler:
        return detectors.fit_rule_baseline(detectors.training_rows(self.labelled))

    @cached_property
    def given_rows(self) -> DataFrame:
        """Features and scores side by side, the squashed rule score standing in
        for the forest.

        It depends on the features only, so every later step has exact answers.
        """
        rows = self.labelled.withColumn("baseline_rule", detectors.rule_score(self.rule))
        rows = rows.withColumn("anomaly_score_raw", 1.0 / (1.0 + F.exp(-F.col("baseline_rule") / 6.0)))
        return stages.save(rows.withColumn("anomaly_score", F.col("anomaly_score_raw")))

    @cached_property
    def given_scores(self) -> DataFrame:
        return detectors.score_table(self.given_rows, self.config)

    @cached_property
    def given_frame(self) -> DataFrame:
        return self._frame(self.given_rows)

    def _frame(self, rows: DataFrame) -> DataFrame:
        """The risk engine's whitelist of a table that has features and scores."""
        wanted = (*risk.input_columns(self.config.risk), "chunk")
        guard_leakage(wanted, "risk")
        return rows.select(*wanted)

    def _fit_engine(self, rows: DataFrame, thresholds: dict[str, float]) -> risk.Calibration:
        train = self._frame(detectors.training_rows(rows))
        return risk.fit_calibration(train, thresholds, self.config.risk)

    @cached_property
    def given_thresholds(self) -> dict[str, float]:
        return self._thresholds(self.given_scores)

    def _thresholds(self, scores: DataFrame) -> dict[str, float]:
        train = detectors.training_rows(scores)
        fit = prepare.fit_calibration_split(train, self.config.fit_fraction)
        return detectors.fit_thresholds(train.where(~fit))

    @cached_property
    def given_calibration(self) -> risk.Calibration:
        return self._fit_engine(self.given_rows, self.given_thresholds)

    @cached_property
    def given_risk(self) -> DataFrame:
        return stages.save(risk.score_events(self.given_frame, self.given_calibration, self.config))

    @cached_property
    def given_alerts(self) -> tuple[DataFrame, DataFrame]:
        rows, counts = alerting.build_alerts(self.given_risk, None, self.config)
        return stages.save(rows), counts

    # -- detectors with a fitted model --------------------------------------------------
    @cached_property
    def fit_part(self):
        return prepare.fit_calibration_split(detectors.training_rows(self.labelled), self.config.fit_fraction)

    @cached_property
    def forest_nodes(self) -> DataFrame:
        train = detectors.training_rows(self.labelled)
        return stages.save(forest.fit_forest(train.where(self.fit_part), self.config))

    @cached_property
    def forest(self) -> forest.ForestScorer:
        n_fit = detectors.training_rows(self.labelled).where(self.fit_part).count()
        return forest.scorer(self.forest_nodes, n_fit, self.config)

    @cached_property
    def forest_rows(self) -> DataFrame:
        """Features with the isolation forest's and the rule's scores."""
        rows = self.labelled.withColumns(
            {
                "anomaly_score_raw": forest.raw_score_column(self.labelled, self.forest),
                "baseline_rule": detectors.rule_score(self.rule),
            }
        )
        return stages.save(rows)

    @cached_property
    def scores(self) -> DataFrame:
        """Event score table of the isolation forest, rule and random baseline."""
        fit = detectors.training_rows(self.forest_rows).where(self.fit_part)
        low, high = fit.agg(F.min("anomaly_score_raw"), F.max("anomaly_score_raw")).first()
        display = detectors.display_score(F.col("anomaly_score_raw"), low, high)
        return detectors.score_table(self.forest_rows.withColumn("anomaly_score", display), self.config)

    @cached_property
    def thresholds(self) -> dict[str, float]:
        train = detectors.training_rows(self.scores)
        return detectors.fit_thresholds(train.where(~self.fit_part))

    @cached_property
    def calibration(self) -> risk.Calibration:
        return self._fit_engine(self.forest_rows, self.thresholds)

    @cached_property
    def risk(self) -> DataFrame:
        return stages.save(risk.score_events(self._frame(self.forest_rows), self.calibration, self.config))

    @cached_property
    def classifier(self):
        return classifier.fit_classifier(detectors.classifier_rows(self.labelled), self.config)

    @cached_property
    def classifications(self) -> DataFrame:
        keep = ("event_id", "timestamp", "entity_id", "entity_type", "split", "label", "is_attack", "campaign_id")
        return stages.save(classifier.classify(self.classifier, self.labelled, keep))

    @cached_property
    def alerts(self) -> DataFrame:
        checks = stages.Checks()
        return stages.save(alerting.build_alerts(self.risk, self.classifications, self.config, checks)[0], checks=checks)


def save_features(rows: DataFrame) -> DataFrame:
    """The feature stage: no feature comes from ground truth, each is a finite number, each event has a label."""
    guard_lineage(rows, FEATURES)
    checks = stages.Checks()
    rows = checks.none(rows, "features hold NaN or infinite values", finite_faults())
    rows = checks.none(rows, "feature rows without a label", {"label": F.col("label").isNull()})
    return stages.save(rows, checks=checks)


def labelled_features(feature_table: DataFrame, events: DataFrame, checks: stages.Checks | None = None) -> DataFrame:
    truth = events.select("event_id", "label", "is_attack", "campaign_id")
    if checks is None:
        return feature_table.join(truth, "event_id", "left")
    rows = checks.join(feature_table, truth, ["event_id"], "features with their labels")
    return checks.none(rows, "feature rows without a label", {"label": F.col("label").isNull()})
