"""How soon and how often whole campaigns are caught."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import INSIDER, MALICIOUS
from ..functions.scoring import micros


def campaign_detection(rows: DataFrame, alerted: Column) -> DataFrame:
    """Per campaign: first alert, latency and events strictly before it.

    Both passes are map-side combined aggregates; the campaign table between
    them has one row per campaign and joins by its real size.
    """
    flagged = rows.where("campaign_id is not null").select(
        "campaign_id", "label", "event_id", micros(F.col("timestamp")).alias("at"), alerted.alias("alerted")
    )
    firsts = flagged.groupBy("campaign_id").agg(
        F.min_by("label", F.struct("at", "event_id")).alias("label"),
        F.count(F.lit(1)).alias("n_events"),
        F.min("at").alias("start_us"),
        F.min(F.when(F.col("alerted"), F.col("at"))).alias("first_us"),
    )
    caught = firsts.where("first_us is not null").select("campaign_id", "first_us")
    before = (
        flagged.join(caught, "campaign_id")
        .groupBy("campaign_id")
        .agg(F.count_if(F.col("at") < F.col("first_us")).alias("events_before_detection"))
    )
    return (
        firsts.join(before, "campaign_id", "left")
        .withColumn("detected", F.col("first_us").isNotNull())
        .withColumn("latency_seconds", (F.col("first_us") - F.col("start_us")) / 1e6)
    )


def detection_summary(per_campaign: DataFrame) -> DataFrame:
    caught = F.col("detected")
    return per_campaign.agg(
        F.count(F.lit(1)).alias("n_campaigns"),
        F.count_if(caught).alias("n_detected"),
        F.avg(caught.cast("double")).alias("campaign_recall"),
        F.percentile(F.when(caught, F.col("latency_seconds")), F.lit(0.5)).alias("median_latency_seconds"),
        F.percentile(F.when(caught, F.col("events_before_detection")), F.lit(0.5)).alias(
            "median_events_before_detection"
        ),
    )


def campaign_report(eval_rows: DataFrame, timeline: DataFrame, alerted: Column, campaigns: DataFrame) -> DataFrame:
    """Per campaign detection with true start, straddling, difficulty and types."""
    found = campaign_detection(eval_rows, alerted)
    known = timeline.where("campaign_id is not null")
    kinds = F.array_join(F.array_sort(F.collect_set("entity_type")), "|")  # a handful of entity types
    whole = known.groupBy("campaign_id").agg(
        F.min(micros(F.col("timestamp"))).alias("true_start_us"),
        F.bool_or(F.col("split") == "train").alias("straddles_split"),
        kinds.alias("entity_type_group"),
    )
    seen = eval_rows.where("campaign_id is not null").groupBy("campaign_id").agg(kinds.alias("entity_type_evaluation"))
    rows = found.join(whole, "campaign_id", "left").join(seen, "campaign_id", "left")
    rows = rows.join(campaigns, "campaign_id", "left")
    return rows.withColumns(
        {
            "straddles_split": F.coalesce("straddles_split", F.lit(False)),
            "difficulty": F.when(F.col("stealthy"), "stealth").when(~F.col("stealthy"), "obvious"),
            "latency_seconds_true_start": (F.col("first_us") - F.col("true_start_us")) / 1e6,
            "pct_events_before_detection": F.col("events_before_detection") / F.col("n_events") * 100.0,
        }
    )


def breakdown(report: DataFrame) -> DataFrame:
    """Malicious campaigns by label, by difficulty and by entity types."""
    caught = F.col("detected")
    half = F.lit(0.5)
    rows = report.where(F.col("label").isin(*MALICIOUS))
    dims = ["label", "difficulty", "entity_type_group"]
    grouped = rows.groupingSets([[F.col(d)] for d in dims], *dims).agg(
        F.count(F.lit(1)).alias("n_campaigns"),
        F.count_if(caught).alias("n_detected"),
        F.avg(caught.cast("double")).alias("detection_rate"),
        F.percentile(F.when(caught, F.col("latency_seconds")), half).alias("median_latency_seconds"),
        F.percentile(F.when(caught, F.col("pct_events_before_detection")), half).alias(
            "median_pct_events_before_detection"
        ),
        F.grouping_id().alias("_set"),
    )
    # grouping_id has a 0 bit at the grouped column: 3, 5, 6 for the three sets.
    by = F.when(F.col("_set") == 3, "label").when(F.col("_set") == 5, "difficulty").otherwise("entity_type_group")
    return (
        grouped.withColumn("by", by)
        .withColumn("key", F.coalesce(*dims))
        .where("key is not null")
        .drop("_set", *dims)
    )


def subset_summary(report: DataFrame) -> DataFrame:
    """Malicious and insider subsets; medians leave straddling campaigns out."""
    caught, straddles = F.col("detected"), F.col("straddles_split")
    eligible = caught & ~straddles
    subset = F.when(F.col("label").isin(*MALICIOUS), "malicious").when(F.col("label") == INSIDER, "insider_drift")
    return (
        report.withColumn("subset", subset)
        .where("subset is not null")
        .groupBy("subset")
        .agg(
            F.count(F.lit(1)).alias("n_campaigns"),
            F.count_if(caught).alias("n_detected"),
            F.avg(caught.cast("double")).alias("detection_rate"),
            F.percentile(F.when(eligible, F.col("latency_seconds")), F.lit(0.5)).alias("median_latency_seconds"),
            F.percentile(F.when(eligible, F.col("events_before_detection")), F.lit(0.5)).alias(
                "median_events_before_detection"
            ),
            F.count_if(caught & straddles).alias("n_latency_excluded_straddling"),
        )
    )


def missed_campaigns(report: DataFrame) -> DataFrame:
    """The campaigns behind ``n_campaigns - n_detected``, as rows."""
    return report.where(~F.col("detected")).select("campaign_id", "label", "n_events")


def method_overlap(rows: DataFrame, masks: dict[str, Column]) -> DataFrame:
    """Malicious campaigns by which of the three methods (forest, rule, hybrid) caught them."""
    per = (
        rows.where("campaign_id is not null")
        .groupBy("campaign_id")
        .agg(
            F.min_by("label", F.struct("timestamp", "event_id")).alias("label"),
            *[F.bool_or(m).alias(name) for name, m in masks.items()],
        )
        .where(F.col("label").isin(*MALICIOUS))
    )
    forest, rule, hybrid = (F.col(n) for n in ("forest", "rule", "hybrid"))
    how_many = forest.cast("int") + rule.cast("int") + hybrid.cast("int")
    group = (
        F.when(how_many == 0, "none")
        .when(how_many == 3, "all_three")
        .when(forest & rule, "if_and_rule_not_hybrid")
        .when(forest & hybrid, "if_and_hybrid_not_rule")
        .when(rule & hybrid, "rule_and_hybrid_not_if")
        .when(forest, "if_only")
        .when(rule, "rule_only")
        .otherwise("hybrid_only")
    )
    return per.select("campaign_id", "label", group.alias("overlap"), (how_many >= 2).cast("bigint").alias("multiple_methods"))
