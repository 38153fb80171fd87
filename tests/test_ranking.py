import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrygrain.operators import ranking


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(3)
    # A third of the rows share one value; the rest spread over many magnitudes.
    values = [7.5] * 400 + [rng.choice([-1, 1]) * 10 ** rng.uniform(-6, 6) for _ in range(800)]
    rng.shuffle(values)
    rows = [(f"R{i:05d}", v, i // 7) for i, v in enumerate(values)]
    return rows, spark.createDataFrame(rows, "id string, v double, t int")


def test_kth_values_match_sorting(numbers, monkeypatch):
    rows, df = numbers
    monkeypatch.setattr(ranking, "FEW", 5)
    monkeypatch.setattr(ranking, "BINS", 16)
    ordered = sorted(v for _, v, _ in rows)
    ranks = [1, 2, 17, 399, 600, 601, 1000, 1199, 1200]
    assert ranking.kth_values(df, F.col("v"), ranks) == {r: ordered[r - 1] for r in ranks}


def test_quantiles_interpolate_like_numpy(numbers):
    rows, df = numbers
    fractions = [0.0, 0.25, 0.5, 0.95, 0.999, 1.0]
    got = ranking.exact_quantiles(df, {"v": F.col("v")}, fractions)["v"]
    assert got == pytest.approx(list(np.quantile([v for _, v, _ in rows], fractions)), rel=1e-12)


def test_quantiles_of_nothing_are_null(numbers):
    _, df = numbers
    assert ranking.exact_quantiles(df.limit(0), {"v": F.col("v")}, [0.5])["v"] == [None]


def test_selection_ends_on_nan_and_infinity(spark, monkeypatch):
    monkeypatch.setattr(ranking, "FEW", 3)
    monkeypatch.setattr(ranking, "BINS", 8)
    rng = random.Random(5)
    finite = [rng.uniform(-1, 1) * 10.0 ** rng.randrange(-300, 308) for _ in range(300)] + [1.7e308, -1.7e308, 5e-324]
    values = finite + [math.inf] * 3 + [-math.inf] * 2 + [math.nan] * 4
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = ranking.kth_values(df, F.col("v"), list(range(1, len(values) + 1)))
    ordered = sorted(v for v in values if v == v)
    assert [got[i] for i in range(1, len(ordered) + 1)] == ordered
    assert all(math.isnan(got[i]) for i in range(len(ordered) + 1, len(values) + 1))


def test_selection_scans_do_not_grow_with_columns(numbers, spark):
    _, df = numbers
    columns = {f"c{i}": F.col("v") * (i + 1) for i in range(9)}
    calls = []
    kept = type(df).collect
    type(df).collect = lambda self: calls.append(1) or kept(self)
    try:
        ranking.exact_quantiles(df, columns, [0.1, 0.5, 0.9])
    finally:
        type(df).collect = kept
    assert len(calls) <= 6


def test_first_k_breaks_ties_by_time_then_id(numbers):
    rows, df = numbers
    ordered = [r[0] for r in sorted(rows, key=lambda r: (-r[1], r[2], r[0]))]
    ks = [0, 1, 250, 500, 777, 1200, 5000]
    masks = ranking.first_k_many(df, ks, [-F.col("v"), F.col("t")], "id")
    for k in ks:
        assert {r.id for r in df.where(masks[k]).collect()} == set(ordered[:k])


def test_cumulative_and_row_numbers(numbers, spark):
    rows, df = numbers
    numbered = ranking.global_row_number(df, [F.col("t"), F.col("id")], "rn").collect()
    expected = {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])), 1)}
    assert {r.id: r.rn for r in numbered} == expected
    per = df.groupBy("v").agg(F.count("*").alias("n"))
    got = {r.v: r.c for r in ranking.cumulative(per, [F.col("v")], {"c": "n"}).collect()}
    values = sorted(v for _, v, _ in rows)
    assert got == {v: sum(x <= v for x in values) for v in set(values)}
    assert math.isclose(max(got.values()), len(rows))


def test_selection_in_the_narrowest_ranges(spark):
    """Ranges whose halves are equal, or as wide as doubles go, each on its own."""
    for values in ([0.0, 5e-324], [1.0, 1.0000000000000002, 1.0], [-1.7e308, 1.7e308, 0.0], [5e-324, 1e-323, 0.0, -5e-324]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        got = ranking.kth_values(df, F.col("v"), list(range(1, len(values) + 1)))
        assert got == dict(enumerate(sorted(values), 1))
