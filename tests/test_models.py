import tracemalloc
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrygrain.config import DEFAULTS, FEATURES, LABELS
from sentrygrain.operators import classifier, detectors, forest

SMALL_FOREST = replace(DEFAULTS, forest_trees=40, forest_sample=64, classifier_trees=8, classifier_depth=5)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    out = []
    for i in range(500):
        attack = i >= 460
        values = rng.normal(5.0 if attack else 0.0, 1.0, len(FEATURES))
        out.append((f"E{i:05d}", "train", "BRUTE_FORCE" if attack else "BENIGN", *map(float, values)))
    schema = "event_id string, split string, label string, " + ", ".join(f"{c} double" for c in FEATURES)
    return spark.createDataFrame(out, schema).repartition(3)


def scores(df, config):
    benign = detectors.training_rows(df)
    model = forest.scorer(forest.fit_forest(benign, config), benign.count(), config)
    return {r.event_id: r.s for r in df.select("event_id", forest.raw_score_column(df, model).alias("s")).collect()}


def test_forest_separates_and_repeats(rows):
    first, again = scores(rows, SMALL_FOREST), scores(rows.repartition(7), SMALL_FOREST)
    assert first == again
    assert all(0 < s < 1 for s in first.values())
    attack = [s for e, s in first.items() if e >= "E00460"]
    benign = [s for e, s in first.items() if e < "E00460"]
    assert min(attack) > np.median(benign) and np.mean(attack) > np.mean(benign) + 0.1


def test_another_seed_gives_another_forest(rows):
    assert scores(rows, SMALL_FOREST) != scores(rows, replace(SMALL_FOREST, seed=7))


def test_attack_rows_never_fit_the_forest(rows):
    benign_only = rows.where("label = 'BENIGN'")
    a, b = scores(rows, SMALL_FOREST), scores(benign_only, SMALL_FOREST)
    assert {e: s for e, s in a.items() if e in b} == b


def test_samples_are_bounded(rows):
    sampled = forest.sample_rows(rows, 10**7, replace(SMALL_FOREST, forest_trees=3))
    per_tree = [r["count"] for r in forest.sample_rows(rows, 500, SMALL_FOREST).groupBy("tree").count().collect()]
    assert sampled.count() <= 500 and len(per_tree) == 40 and max(per_tree) <= 4 * 64


def test_thresholds_leave_the_wanted_share(rows):
    scored = rows.withColumn("anomaly_score_raw", F.col("hour"))
    points = detectors.fit_thresholds(detectors.training_rows(scored))
    assert points["strict"] > points["balanced"] > points["sensitive"]
    share = detectors.training_rows(scored).where(detectors.alert_mask(points, "sensitive")).count() / 460
    assert share == pytest.approx(0.05, abs=0.005)
    with pytest.raises(KeyError):
        detectors.alert_mask(points, "nonsense")


def test_constant_columns_scale_by_one(rows):
    scaler = detectors.fit_scaler(rows.withColumn("hour", F.lit(3.0)), ("hour",))
    assert (scaler.mean["hour"], scaler.std["hour"]) == (3.0, 1.0)


def test_random_baseline_does_not_depend_on_order(rows):
    a = {r.event_id: r.s for r in rows.select("event_id", detectors.random_score().alias("s")).collect()}
    b = {r.event_id: r.s for r in rows.repartition(9).select("event_id", detectors.random_score().alias("s")).collect()}
    assert a == b and 0 <= min(a.values()) and max(a.values()) < 1 and 0.4 < np.mean(list(a.values())) < 0.6


def test_classifier_probabilities(rows):
    model = classifier.fit_classifier(rows, SMALL_FOREST)
    got = classifier.classify(model, rows, ("event_id", "label")).collect()
    for r in got:
        p = [r[f"proba_{name}"] for name in ("BENIGN", "BRUTE_FORCE", "INSIDER_DRIFT")]
        assert p[0] + p[1] == pytest.approx(1.0) and p[2] == 0.0
        assert r.attack_confidence == max(p)
    assert np.mean([r.label == r.predicted_label for r in got]) > 0.98


def test_display_score_clips(spark):
    df = spark.createDataFrame([(0.1,), (0.5,), (2.0,)], "s double")
    assert [r[0] for r in df.select(detectors.display_score(F.col("s"), 0.1, 0.9)).collect()] == pytest.approx([0, 0.5, 1])
    assert df.select(detectors.display_score(F.col("s"), 0.4, 0.4)).first()[0] == 0.0


def test_classifier_does_not_depend_on_where_nodes_are_grown(rows):
    mixed = rows.withColumn("label", F.when(F.col("hour") > 1.0, "INSIDER_DRIFT").otherwise(F.col("label")))

    def nodes(df, **how):
        return sorted(map(tuple, classifier.fit_classifier(df, SMALL_FOREST, **how).nodes.collect()))

    whole = nodes(mixed)  # every tree in one task
    assert len(whole) > 40 and {n[0] for n in whole} == set(range(8))
    assert nodes(mixed.repartition(7)) == whole
    assert nodes(mixed, local_rows=60) == whole  # upper nodes from added histograms
    assert nodes(mixed, local_rows=0) == whole  # all nodes


def test_classifier_importances(rows):
    model = classifier.fit_classifier(rows.withColumn("hour", F.lit(1.0)), SMALL_FOREST)
    assert sum(model.importances) == pytest.approx(1.0) and min(model.importances) >= 0.0
    assert model.importances[FEATURES.index("hour")] == 0.0


def test_histograms_take_little_memory():
    """A task may hold a million rows, so counting them may not take hundreds of bytes a row."""
    rng = np.random.default_rng(3)
    n, nodes = 200_000, 5
    rows = np.zeros(n, classifier.ROW)
    rows["x"], rows["y"], rows["times"] = rng.integers(0, classifier.BINS, (n, len(FEATURES))), rng.integers(0, 3, n), rng.integers(1, 4, n)
    subsets = classifier._subsets(1, 0, np.arange(1, nodes + 1))
    for at in (np.sort(rng.integers(0, nodes, n)), rng.integers(0, nodes, n)):
        tracemalloc.start()
        got = classifier._histograms(rows, at, subsets)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 60 * n
        for k in range(nodes):
            own = rows[at == k]
            for j, f in enumerate(subsets[k]):
                want = np.zeros((classifier.BINS, len(LABELS)))
                np.add.at(want, (own["x"][:, f], own["y"]), own["times"])
                assert (got[k, j] == want).all()


def test_trees_reach_the_driver_packed(rows):
    """One packed body a tree, smaller than its nodes' numbers, with the leaves' shares."""
    model = classifier.fit_classifier(rows, SMALL_FOREST)
    nodes = model.nodes.toPandas()
    assert [type(body) for body in model.trees] == [bytes] * 8
    assert sum(map(len, model.trees)) < 8 * nodes.size
    for number, body in enumerate(model.trees):
        own, tree = nodes[nodes["tree"] == number].sort_values("node"), classifier._Tree.of(body)
        assert tree.nodes["feature"].tolist() == own["feature"].tolist() and tree.nodes["threshold"].tolist() == own["threshold"].tolist()
        weights = own[own["feature"] < 0][list(classifier.WEIGHTS)].to_numpy()
        assert np.allclose(tree.shares, weights / weights.sum(axis=1, keepdims=True))
