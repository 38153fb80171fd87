"""Detection metrics under a fixed analyst budget.

``y`` is the boolean truth column, ``s`` the score column, and rows are ordered
by (timestamp, event_id) where scores tie. Undefined ratios are NULL.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ATTACKS, BENIGN, BUDGET_FRACTIONS, FPR_TARGETS, HARD_CATEGORIES, INSIDER, LABELS, MALICIOUS
from ..functions.scoring import micros
from ..sources import stages
from .ranking import cumulative, exact_quantiles, first_k_many
from .timeline import carried_previous



def _order(s: str) -> list[Column]:
    return [-F.col(s), micros(F.col("timestamp"))]


def budget_size(n: int, fraction: float) -> int:
    if not 0 < fraction <= 1:
        raise ValueError(f"budget fraction must be in (0, 1], got {fraction}")
    return max(1, math.ceil(n * fraction))


def budget_masks(df: DataFrame, s: str, fractions: tuple[float, ...]) -> dict[float, Column]:
    """Per fraction a predicate for exactly the top ceil(n * fraction) rows."""
    n = df.count()
    if n == 0:
        raise ValueError("no scored rows")
    ks = {f: budget_size(n, f) for f in fractions}
    masks = first_k_many(df, list(ks.values()), _order(s), "event_id")
    return {f: masks[k] for f, k in ks.items()}


def confusion(truth: Column, predicted: Column) -> list[Column]:
    """tp, fp, tn, fn as aggregates."""
    return [
        F.count_if(truth & predicted).alias("tp"),
        F.count_if(~truth & predicted).alias("fp"),
        F.count_if(~truth & ~predicted).alias("tn"),
        F.count_if(truth & ~predicted).alias("fn"),
    ]


def with_ratios(counts: DataFrame) -> DataFrame:
    """Add precision, recall, f1 and false-positive rate to confusion counts."""
    out = counts.withColumns(
        {
            "precision": F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")),
            "recall": F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")),
            "fpr": F.try_divide(F.col("fp"), F.col("fp") + F.col("tn")),
        }
    )
    return out.withColumn(
        "f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    )


def by_score(df: DataFrame, s: str, counts: dict[str, Column]) -> DataFrame:
    """Distinct scores, best first, with running totals ``cum_*`` of each count.

    The scores are folded before they are shuffled, so heavy ties cost nothing.
    """
    folded = df.groupBy((-F.col(s)).alias("minus")).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    return cumulative(folded, [F.col("minus")], {f"cum_{n}": n for n in counts}, keep_part="chunk")


def _truth_counts(y: str) -> dict[str, Column]:
    return {"pos": F.col(y), "neg": ~F.col(y)}


def stored_curve(df: DataFrame, s: str, y: str = "is_attack") -> DataFrame:
    """The running totals that rankings and curves of one score are made from, stored for several of them."""
    return stages.save(by_score(df, s, _truth_counts(y)))


def _ranking_aggregates(pos: str, neg: str) -> tuple[Column, Column]:
    """Average precision and tie-aware ROC-AUC over a :func:`by_score` table."""
    cum_pos, cum_neg = F.col(f"cum_{pos}"), F.col(f"cum_{neg}")
    steps = F.sum(F.try_divide(F.col(pos) * cum_pos, cum_pos + cum_neg))
    pairs = F.sum(F.col(neg) * (cum_pos - F.col(pos) / 2))
    n_pos, n_neg = F.sum(pos), F.sum(neg)
    both = (n_pos > 0) & (n_neg > 0)
    return F.when(both, steps / n_pos), F.when(both, pairs / (n_pos.cast("double") * n_neg))


def ranking_metrics(df: DataFrame, s: str, y: str = "is_attack", *, curve: DataFrame | None = None) -> DataFrame:
    """One row: average precision ``pr_auc`` and ``roc_auc``; ``curve`` may be a :func:`stored_curve` of the score."""
    pr, roc = _ranking_aggregates("pos", "neg")
    curve = by_score(df, s, _truth_counts(y)) if curve is None else curve
    return curve.agg(pr.alias("pr_auc"), roc.alias("roc_auc"))


def detection_metrics(
    df: DataFrame,
    s: str,
    y: str = "is_attack",
    *,
    threshold: float | None = None,
    budget_fraction: float | None = None,
    curve: DataFrame | None = None,
) -> DataFrame:
    """The full record at a threshold or at a budget; exactly one is given."""
    if (threshold is None) == (budget_fraction is None):
        raise ValueError("give either a threshold or a budget fraction")
    alert = F.col(s) >= threshold if budget_fraction is None else budget_masks(df, s, (budget_fraction,))[budget_fraction]
    edge = F.lit(threshold) if budget_fraction is None else F.min(F.when(alert, F.col(s)))
    counts = df.agg(
        F.count("*").alias("n_events"),
        F.count_if(F.col(y)).alias("n_positives"),
        F.avg(F.col(y).cast("double")).alias("prevalence"),
        edge.alias("threshold"),
        F.count_if(alert).alias("n_alerts"),
        F.avg(alert.cast("double")).alias("alert_rate"),
        *confusion(F.col(y), alert),
    )
    point = "threshold" if budget_fraction is None else f"budget_{budget_fraction}"
    return (
        with_ratios(counts).crossJoin(ranking_metrics(df, s, y, curve=curve)).withColumn("operating_point", F.lit(point))
    )  # one row each


def pr_curve(df: DataFrame, s: str, y: str = "is_attack", *, curve: DataFrame | None = None) -> DataFrame:
    """(recall, precision, threshold) per distinct score; empty without positives."""
    curve = by_score(df, s, _truth_counts(y)) if curve is None else curve
    totals = df.agg(F.count_if(F.col(y)).alias("p")).where("p > 0")
    return curve.crossJoin(F.broadcast(totals)).select(  # one row
        (F.col("cum_pos") / F.col("p")).alias("recall"),
        (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
        (-F.col("minus")).alias("threshold"),
    )


def roc_curve(df: DataFrame, s: str, y: str = "is_attack", *, curve: DataFrame | None = None) -> DataFrame:
    """(fpr, tpr, threshold) without collinear points, from (0, 0, inf)."""
    curve = by_score(df, s, _truth_counts(y)) if curve is None else curve
    step = F.struct("pos", "neg")
    curve = carried_previous(curve, [], ["minus"], step, "_next", following=True)
    totals = df.agg(F.count_if(F.col(y)).alias("p"), F.count_if(~F.col(y)).alias("n")).where("p > 0 and n > 0")
    curve = curve.crossJoin(F.broadcast(totals))  # one row
    first = (F.col("cum_pos") == F.col("pos")) & (F.col("cum_neg") == F.col("neg"))
    corner = F.col("_next").isNull() | (F.col("_next") != step) | first
    points = curve.where(corner).select(
        (F.col("cum_neg") / F.col("n")).alias("fpr"),
        (F.col("cum_pos") / F.col("p")).alias("tpr"),
        (-F.col("minus")).alias("threshold"),
    )
    origin = totals.select(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(float("inf")).alias("threshold"))
    return origin.unionByName(points)


def budget_sweep(
    df: DataFrame, s: str, y: str = "is_attack", fractions: tuple[float, ...] = BUDGET_FRACTIONS
) -> DataFrame:
    """Precision, recall, F1 and FPR per budget, all in one aggregate."""
    masks = budget_masks(df, s, fractions)
    records = [
        F.struct(
            F.lit(f).alias("budget_fraction"),
            F.count_if(m).alias("n_alerts"),
            F.min(F.when(m, F.col(s))).alias("threshold"),
            *confusion(F.col(y), m),
        )
        for f, m in masks.items()
    ]
    counts = df.agg(F.array(*records).alias("r")).select(F.inline("r"))
    return with_ratios(counts).drop("tp", "fp", "tn", "fn")


def recall_at_fpr(
    df: DataFrame, s: str, y: str = "is_attack", targets: tuple[float, ...] = FPR_TARGETS
) -> DataFrame:
    """Recall while the benign false-positive rate is held at each target."""
    benign = exact_quantiles(df.where(~F.col(y)), {"s": F.col(s)}, [1.0 - f for f in targets])["s"]
    score, truth = F.col(s), F.col(y)
    records = []
    for f, threshold in zip(targets, benign, strict=True):
        t = F.lit(threshold).cast("double")
        records.append(
            F.struct(
                F.lit(f).alias("fpr_target"),
                t.alias("threshold"),
                F.avg(F.when(truth, (score >= t).cast("double"))).alias("recall"),
                F.avg(F.when(~truth, (score >= t).cast("double"))).alias("achieved_fpr"),
            )
        )
    return df.agg(F.array(*records).alias("r")).select(F.inline("r"))


def score_distribution(df: DataFrame, s: str, y: str = "is_attack") -> DataFrame:
    """Count, mean, population deviation, minimum and quantiles per class."""
    sides = {"benign": ~F.col(y), "attack": F.col(y)}
    columns = {name: F.when(side, F.col(s)) for name, side in sides.items()}
    quantiles = exact_quantiles(df, columns, [0.5, 0.9, 0.95, 0.99, 1.0])
    records = [
        F.struct(
            F.lit(name).alias("side"),
            F.count(c).alias("n"),
            F.avg(c).alias("mean"),
            F.stddev_pop(c).alias("std"),
            F.min(c).alias("min"),
            *[
                F.lit(q).cast("double").alias(label)
                for label, q in zip(("q50", "q90", "q95", "q99", "q100"), quantiles[name], strict=True)
            ],
        )
        for name, c in columns.items()
    ]
    return df.agg(F.array(*records).alias("r")).select(F.inline("r"))


def score_histogram(df: DataFrame, s: str, y: str = "is_attack", bins: int = 59) -> DataFrame:
    """Equal-width histogram per class; the last bin includes its upper edge."""
    low, high = df.agg(F.min(s), F.max(s)).first()
    width = (high - low) / bins
    number = F.when(F.lit(width <= 0), 1).otherwise(
        F.least(F.lit(bins), F.width_bucket(F.col(s), F.lit(low), F.lit(high if high > low else low + 1), F.lit(bins)))
    )
    counted = df.groupBy(F.col(y).alias("is_attack"), number.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))
    return counted.withColumns({"low": low + (F.col("bin") - 1) * width, "high": low + F.col("bin") * width})


def subset_metrics(df: DataFrame, s: str, subsets: dict[str, Column], fraction: float) -> DataFrame:
    """PR-AUC, ROC-AUC and recall at budget of benign plus each subset of attacks.

    All subsets share one pass over the distinct scores: benign rows are counted
    once, every subset adds a count column. Where scores tie at the budget's
    edge benign rows are taken first.
    """
    counts = {"benign": F.col("label") == BENIGN} | {f"c_{name}": c for name, c in subsets.items()}
    curve = by_score(df, s, counts)
    totals = df.agg(*[F.count_if(c).alias(n) for n, c in counts.items()]).first()
    records = []
    for name in subsets:
        c = f"c_{name}"
        k = budget_size(max(1, totals["benign"] + totals[c]), fraction)
        pr, roc = _ranking_aggregates(c, "benign")
        room = k - (F.col("cum_benign") + F.col(f"cum_{c}") - F.col(c))  # left for these attacks
        taken = F.sum(F.greatest(F.lit(0), F.least(F.col(c), room)))
        records.append(
            F.struct(
                F.lit(name).alias("subset"),
                F.sum(c).alias("n"),
                pr.alias("pr_auc"),
                roc.alias("roc_auc"),
                F.try_divide(taken, F.sum(c)).alias("recall_at_budget"),
            )
        )
    return curve.agg(F.array(*records).alias("r")).select(F.inline("r"))


def per_attack_type(df: DataFrame, s: str, fraction: float) -> DataFrame:
    out = subset_metrics(df, s, {a: F.col("label") == a for a in ATTACKS}, fraction)
    return out.withColumnRenamed("subset", "attack_type").withColumn(
        "is_edge_case", (F.col("attack_type") == INSIDER).cast("bigint")
    )


def obvious_vs_stealth(df: DataFrame, s: str, campaigns: DataFrame, fraction: float) -> DataFrame:
    """Benign plus obvious against benign plus stealthy attacks."""
    flagged = df.join(campaigns.select("campaign_id", "stealthy"), "campaign_id", "left")
    subsets = {
        "obvious": F.coalesce(F.col("is_attack") & ~F.col("stealthy"), F.lit(False)),
        "stealth": F.coalesce(F.col("is_attack") & F.col("stealthy"), F.lit(False)),
    }
    return subset_metrics(flagged, s, subsets, fraction)


def event_level_report(
    df: DataFrame, detectors: tuple[str, ...], thresholds: dict[str, dict[str, float]], fraction: float
) -> DataFrame:
    """Long table (detector, metric, value) over V02-V05, V08, V12 and V13."""
    parts = []
    for s in detectors:
        curve = stored_curve(df, s)
        sections = {"budget": detection_metrics(df, s, budget_fraction=fraction, curve=curve).drop("operating_point")}
        for name, t in thresholds.get(s, {}).items():
            sections[f"point_{name}"] = detection_metrics(df, s, threshold=t, curve=curve).drop("operating_point")
        frames = [_long(section, frame) for section, frame in sections.items()]
        frames.append(_long("sweep", budget_sweep(df, s), "budget_fraction"))
        frames.append(_long("recall_at_fpr", recall_at_fpr(df, s), "fpr_target"))
        frames.append(_long("distribution", score_distribution(df, s), "side"))
        parts += [f.withColumn("detector", F.lit(s)) for f in frames]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("detector", "metric", "value")


def _long(section: str, frame: DataFrame, key: str | None = None) -> DataFrame:
    fields = [c for c in frame.columns if c != key]
    label = F.concat_ws(".", F.lit(section), F.col(key).cast("string") if key else F.lit(None).cast("string"))
    wide = frame.select(label.alias("_label"), *[F.col(c).cast("double").alias(c) for c in fields])
    long = wide.unpivot(["_label"], fields, "_field", "value")
    return long.select(F.concat_ws(".", "_label", "_field").alias("metric"), "value")


def per_class(df: DataFrame, labels: tuple[str, ...] = LABELS, truth: str = "label", predicted: str = "predicted_label"):
    """Precision, recall, F1 and support per class; 0 where undefined."""
    records = []
    for name in labels:
        is_true, is_pred = F.col(truth) == name, F.col(predicted) == name
        tp, n_pred, n_true = F.count_if(is_true & is_pred), F.count_if(is_pred), F.count_if(is_true)
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        records.append(
            F.struct(
                F.lit(name).alias("class"),
                zero(F.try_divide(tp, n_pred)).alias("precision"),
                zero(F.try_divide(tp, n_true)).alias("recall"),
                zero(F.try_divide(2 * tp, n_pred + n_true)).alias("f1"),
                n_true.alias("support"),
            )
        )
    return df.agg(F.array(*records).alias("r")).select(F.inline("r"))


def confusion_matrix(
    df: DataFrame, labels: tuple[str, ...] = LABELS, truth: str = "label", predicted: str = "predicted_label"
) -> DataFrame:
    """Truth by prediction with fixed rows and columns, zero-filled."""
    counted = df.groupBy(truth).pivot(predicted, list(labels)).count()
    zero = {name: F.coalesce(F.col(name), F.lit(0)).alias(name) for name in labels}
    known = df.sparkSession.createDataFrame([(name,) for name in labels], "truth string")  # the fixed labels
    return known.join(counted.withColumnRenamed(truth, "truth"), "truth", "left").select("truth", *zero.values())


def classifier_report(df: DataFrame) -> DataFrame:
    """Accuracy, macro F1, malicious top-1, the binary view and insider recall."""
    label, predicted = F.col("label"), F.col("predicted_label")
    bad, called = label.isin(*MALICIOUS), predicted.isin(*MALICIOUS)
    hit = (label == predicted).cast("double")
    counts = with_ratios(
        df.agg(
            F.count("*").alias("n_evaluation_events"),
            F.avg(hit).alias("overall_accuracy"),
            F.avg(F.when(bad, hit)).alias("malicious_top1_accuracy"),
            F.avg(F.when(label == INSIDER, hit)).alias("insider_drift_recall"),
            *confusion(bad, called),
        )
    )
    macro = per_class(df).agg(F.avg(F.when(F.col("support") > 0, F.col("f1"))).alias("macro_f1_present_classes"))
    return counts.crossJoin(macro)  # one row each


def matched_thresholds(benign_train: DataFrame, scores: tuple[str, ...], fpr: float = 0.01) -> dict[str, float]:
    """Per method the threshold with the same benign training FPR."""
    got = exact_quantiles(benign_train, {s: F.col(s) for s in scores}, [1.0 - fpr])
    return {s: got[s][0] for s in scores}


def hard_categories(df: DataFrame, masks: dict[str, Column], labels: tuple[str, ...] = HARD_CATEGORIES) -> DataFrame:
    """Catch rate per difficult label and method; a label without events has 0 of them and no rate."""
    counts = (
        df.where(F.col("label").isin(*labels))
        .groupBy("label")
        .agg(F.count("*").alias("n_events"), *[F.avg(m.cast("double")).alias(f"{name}_recall") for name, m in masks.items()])
    )
    every = df.sparkSession.createDataFrame([(label,) for label in labels], "label string")
    return every.join(counts, "label", "left").fillna(0, ["n_events"])


def alert_burden(alerts: DataFrame, eval_rows: DataFrame, n_suppressed: DataFrame) -> DataFrame:
    """Operational load of the alerts that fall into the evaluation rows."""
    inside = alerts.join(eval_rows.select("event_id"), "event_id", "left_semi")
    load = inside.agg(
        F.count("*").alias("n_alerts"),
        F.count_if(F.col("severity") == "HIGH").alias("n_high"),
        F.count_if(F.col("severity") == "CRITICAL").alias("n_critical"),
        F.count_distinct("entity_id").alias("unique_entities_alerted"),
    )
    benign = eval_rows.agg(F.greatest(F.lit(1), F.count_if(F.col("label") == BENIGN)).alias("n_benign"))
    both = load.crossJoin(benign).crossJoin(n_suppressed)  # one row each
    return both.withColumn("alerts_per_1000_benign", 1000.0 * F.col("n_alerts") / F.col("n_benign")).drop("n_benign")
