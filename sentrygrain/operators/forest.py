"""Isolation forest (Liu, Ting, Zhou 2008): trees grow in parallel tasks.

Each tree sees a hash sample of at most ``2 * sample`` rows, so no group grows
with the table. The fitted forest is a node table of at most
``trees * 2 * sample`` rows, which bounds what is broadcast for scoring.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, FEATURES, Config

NODE_SCHEMA = "tree int, node int, feature int, threshold double, left_node int, right_node int, path double"


def average_path(n: float) -> float:
    """Expected path length of an unsuccessful search among ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649) - 2.0 * (n - 1.0) / n


def sample_rows(rows: DataFrame, n: int, config: Config = DEFAULTS) -> DataFrame:
    """(tree, order, x): the hash sample of every tree.

    A row enters the pool with one hash and serves each tree with another, so that a
    tree gets about twice its sample at every size and large tables are hashed once a row.
    """
    trees, psi = config.forest_trees, config.forest_sample
    x = F.array(*[F.col(c).cast("double") for c in FEATURES]).alias("x")
    space = float(1 << 32)
    draw = lambda salt: F.pmod(F.xxhash64("event_id", F.lit(config.seed), salt), F.lit(1 << 32))
    pool = min(1.0, 8.0 * trees * psi / max(n, 1))
    share = min(1.0, 2.0 * psi / max(n * pool, 1.0))
    picked = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < share * space)
    kept = rows.where(draw(F.lit("row")) < pool * space)
    exploded = kept.select("event_id", x, F.explode(picked).alias("tree"))
    return exploded.select("tree", draw(F.col("tree")).alias("order"), "x")


def _grow(sample: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """One isolation tree as (node, feature, threshold, left, right, path)."""
    nodes: list[tuple | None] = [None]
    todo = [(0, sample, 0)]
    while todo:
        here, rows, depth = todo.pop()
        spread = rows.max(axis=0) - rows.min(axis=0)
        usable = np.flatnonzero(spread > 0)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            nodes[here] = (here, -1, 0.0, here, here, depth + average_path(len(rows)))
            continue
        feature = int(rng.choice(usable))
        column = rows[:, feature]
        cut = float(rng.uniform(column.min(), column.max()))
        goes_left = column <= cut
        left, right = len(nodes), len(nodes) + 1
        nodes += [None, None]
        nodes[here] = (here, feature, cut, left, right, 0.0)
        todo += [(left, rows[goes_left], depth + 1), (right, rows[~goes_left], depth + 1)]
    return nodes


def fit_forest(benign_fit: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """Node table of a forest grown on benign fit rows."""
    n = benign_fit.count()
    psi = min(config.forest_sample, n)
    limit = max(1, math.ceil(math.log2(max(psi, 2))))
    seed = config.seed

    def build(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        chosen = group.sort_values("order", kind="stable").head(psi)
        nodes = _grow(np.stack(chosen["x"].to_numpy()), np.random.default_rng([seed, tree]), limit)
        frame = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "left_node", "right_node", "path"])
        frame.insert(0, "tree", tree)
        return frame

    return sample_rows(benign_fit, n, config).groupBy("tree").applyInPandas(build, NODE_SCHEMA)


class ForestScorer:
    """Vectorised traversal of all trees; small enough to ship to every task."""

    def __init__(self, nodes: pd.DataFrame, sample: int):
        nodes = nodes.sort_values(["tree", "node"])
        sizes = nodes.groupby("tree").size().to_numpy()
        base = np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        self.roots = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int32)
        self.feature = np.maximum(nodes["feature"].to_numpy(), 0).astype(np.int32)
        self.threshold = np.where(nodes["feature"] < 0, np.inf, nodes["threshold"])
        self.left = (nodes["left_node"].to_numpy() + base).astype(np.int32)
        self.right = (nodes["right_node"].to_numpy() + base).astype(np.int32)
        self.path = nodes["path"].to_numpy()
        self.levels = int(math.ceil(math.log2(max(sample, 2))))
        self.norm = average_path(sample) or 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for start in range(0, len(x), 2048):
            block = x[start : start + 2048]
            rows = np.arange(len(block))[:, None]
            at = np.broadcast_to(self.roots, (len(block), len(self.roots)))
            for _ in range(self.levels):
                goes_left = block[rows, self.feature[at]] <= self.threshold[at]
                at = np.where(goes_left, self.left[at], self.right[at])
            out[start : start + len(block)] = np.exp2(-self.path[at].mean(axis=1) / self.norm)
        return out


def scorer(nodes: DataFrame, n_fit: int, config: Config = DEFAULTS) -> ForestScorer:
    """Driver-side copy of the node table, at most trees * 2 * sample rows."""
    bound = config.forest_trees * 2 * config.forest_sample
    n = nodes.count()
    if n > bound:
        raise ValueError(f"{n} nodes, more than {config.forest_trees} trees of {config.forest_sample} rows can have")
    return ForestScorer(nodes.toPandas(), min(config.forest_sample, n_fit))


def raw_score_column(df: DataFrame, model: ForestScorer) -> Column:
    """Anomaly score in (0, 1), higher is worse, as an Arrow batch expression."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def raw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        forest = shared.value
        for batch in batches:
            yield pd.Series(forest.score(batch.to_numpy(dtype=float)))

    return raw(F.struct(*[F.col(c) for c in FEATURES]))
