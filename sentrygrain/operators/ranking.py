"""Exact global order: k-th values, quantiles, row numbers, cumulative sums.

None of it sorts the table into one task. Selection narrows a value range with
small histograms (a few aggregates); numbering and cumulative sums range-
partition the rows and add per-partition offsets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import stages

BINS = 1024
FEW = 4096


def kth_values(df: DataFrame, value: Column, ranks: list[int]) -> dict[int, float]:
    """The 1-based ``ranks``-th smallest values of a numeric column; nulls are left out."""
    return _select(df.select(F.lit("v").alias("c"), value.alias("v")), {"v": ranks})["v"]


def _select(melted: DataFrame, ranks: dict[str, list[int]]) -> dict[str, dict[int, float]]:
    """Wanted ranks of several columns, given as rows (c, v), at once.

    Infinite values and NaN, which is the largest, are counted apart. Each round
    is one aggregate over (column, open range, bin), and only bins that hold a
    wanted rank stay open; a range of different finite values always splits.
    """
    real = isinstance(melted.schema["v"].dataType, (T.DoubleType, T.FloatType))
    v = F.col("v")
    odd = (F.isnan(v) | (F.abs(v) == F.lit(math.inf))) if real else F.lit(False)
    rows = melted.where(v.isNotNull())
    below = F.count_if(v == F.lit(-math.inf)) if real else F.lit(0)
    above = F.count_if((v == F.lit(math.inf)) & ~F.isnan(v)) if real else F.lit(0)
    inside = F.when(~odd, v)
    spans = rows.groupBy("c").agg(
        below.alias("below"), above.alias("above"), F.count(inside).alias("n"), F.min(inside).alias("low"), F.max(inside).alias("high")
    )
    found: dict[str, dict[int, float]] = {c: {} for c in ranks}
    open_: list[tuple] = []  # (column, low, high, [(rank, rank inside)])
    few: list[tuple] = []
    for s in spans.collect():  # one row a column
        wanted = []
        for rank in sorted(set(ranks[s.c])):
            if rank <= s.below:
                found[s.c][rank] = -math.inf
            elif rank <= s.below + s.n:
                wanted.append((rank, rank - s.below))
            else:
                found[s.c][rank] = math.inf if rank <= s.below + s.n + s.above else math.nan
        if wanted:
            open_.append((s.c, s.low, s.high, wanted))
    finite = rows.where(~odd)

    def ranged(ranges: list[tuple]) -> DataFrame:
        which = F.lit(None).cast("int")
        for i, (c, low, high, _) in enumerate(ranges):
            which = F.when((F.col("c") == c) & (v >= F.lit(low)) & (v <= F.lit(high)), F.lit(i)).otherwise(which)
        return finite.withColumn("r", which).where("r is not null")

    while open_:
        for c, low, _, wanted in [o for o in open_ if o[1] == o[2]]:
            found[c].update({rank: low for rank, _ in wanted})
        open_ = [o for o in open_ if o[1] != o[2]]
        if not open_:
            break
        share = F.lit(None).cast("double")
        for i, (_, low, high, _) in enumerate(open_):
            wide = real and high - low == math.inf  # halves, so that the difference is finite
            part = (v / 2 - F.lit(low / 2)) / F.lit(high / 2 - low / 2) if wide else (v - F.lit(low)).cast("double") / F.lit(float(high - low))
            share = F.when(F.col("r") == i, part).otherwise(share)
        place = F.least(F.lit(BINS - 1), F.floor(share * BINS)).alias("bin")
        binned = ranged(open_).groupBy("r", place).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        seen, rounds = dict.fromkeys(range(len(open_)), 0), []
        for b in sorted(binned.collect(), key=lambda b: (b.r, b.bin)):  # at most BINS rows a range
            c, _, _, wanted = open_[b.r]
            here = [(rank, r - seen[b.r]) for rank, r in wanted if seen[b.r] < r <= seen[b.r] + b.n]
            if here:
                (few if b.n <= FEW and b.low < b.high else rounds).append((c, b.low, b.high, here))
            seen[b.r] += b.n
        open_ = rounds
    if few:
        seen = dict.fromkeys(range(len(few)), 0)
        for row in sorted(ranged(few).groupBy("r", "v").count().collect(), key=lambda x: (x.r, x.v)):  # at most FEW rows a range
            c, _, _, wanted = few[row.r]
            found[c].update({rank: row.v for rank, r in wanted if seen[row.r] < r <= seen[row.r] + row["count"]})
            seen[row.r] += row["count"]
    return found


def exact_quantiles(df: DataFrame, columns: dict[str, Column], fractions: list[float]) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of each column, exact at any size, all columns at once."""
    slim = df.select(*[c.cast("double").alias(name) for name, c in columns.items()])
    counts = slim.agg(*[F.count(name).alias(name) for name in columns]).first()
    places = {name: [(counts[name] - 1) * f for f in fractions] for name in columns if counts[name]}
    wanted = {name: [r for p in ps for r in (int(p) + 1, min(int(p) + 2, counts[name]))] for name, ps in places.items()}
    melted = slim.select(F.explode(F.array(*[F.struct(F.lit(n).alias("c"), F.col(n).alias("v")) for n in columns])).alias("e"))
    values = _select(melted.select("e.c", "e.v").where(F.col("c").isin(*wanted)), wanted) if wanted else {}
    out: dict[str, list[float | None]] = {name: [None] * len(fractions) for name in columns}
    for name, ps in places.items():
        pairs = [(values[name][int(p) + 1], values[name][min(int(p) + 2, counts[name])], p - int(p)) for p in ps]
        out[name] = [low if low == high or not part else low + (high - low) * part for low, high, part in pairs]
    return out


def first_k_many(df: DataFrame, ks: list[int], order: list[Column], tie: str) -> dict[int, Column]:
    """For each k a predicate true for exactly the first k rows.

    Rows are ordered by the numeric ``order`` columns ascending, then by the
    unique string ``tie``. A predicate compares with literals: using it needs no
    sort and no shuffle.
    """
    total = df.count()
    out: dict[int, Column] = {k: F.lit(k > 0) for k in ks if k <= 0 or k >= total}
    inner = sorted({k for k in ks if 0 < k < total})
    if not inner:
        return out
    column = order[0]
    edges = kth_values(df, column, inner)
    counts = df.agg(
        *[F.count_if(column < F.lit(edges[k])).alias(f"b{k}") for k in inner],
        *[F.count_if(column == F.lit(edges[k])).alias(f"e{k}") for k in inner],
    ).first()
    for k in inner:
        edge, left = F.lit(edges[k]), k - counts[f"b{k}"]
        if left == counts[f"e{k}"]:
            out[k] = column <= edge
            continue
        tied = df.where(column == edge)
        if len(order) > 1:
            among = first_k_many(tied, [left], order[1:], tie)[left]
        else:
            # Rows equal in every numeric key: numbered by the tie column.
            numbered = global_row_number(tied.select(tie), [F.col(tie)], "rn")
            among = F.col(tie) <= F.lit(numbered.where(F.col("rn") == left).first()[tie])
        out[k] = (column < edge) | ((column == edge) & among)
    return out


def first_k(df: DataFrame, k: int, order: list[Column], tie: str) -> Column:
    """A predicate true for exactly the first ``k`` rows by ``order``, then ``tie``."""
    return first_k_many(df, [k], order, tie)[k]


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows range-partitioned by ``order``, written with their partition number."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stages.save(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))


def cumulative(df: DataFrame, order: list[Column], sums: dict[str, str], *, keep_part: str | None = None) -> DataFrame:
    """Running totals over the whole table in ``order``; ``sums`` maps new -> column.

    Equal rows of ``order`` must already be one row (aggregate first).
    ``keep_part`` keeps the number of the range a row is in, increasing in order.
    """
    ranged = _ranged(df, order)
    totals = ranged.groupBy("_part").agg(*[F.sum(c).alias(f"_{new}") for new, c in sums.items()])
    # One row per partition, so this window and the broadcast are bounded.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(offsets), "_part")
    for new, column in sums.items():
        out = out.withColumn(new, F.sum(column).over(inside) + F.col(f"_{new}"))
    out = out.drop(*[f"_{n}" for n in sums])
    return out.withColumnRenamed("_part", keep_part) if keep_part else out.drop("_part")


def global_row_number(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """1-based position of each row in the total ``order``."""
    return cumulative(df.withColumn("_one", F.lit(1)), order, {name: "_one"}).drop("_one")
