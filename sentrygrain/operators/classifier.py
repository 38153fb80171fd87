"""Attack-type classifier on the features: a random forest whose nodes are grown where their rows are.

Nodes with more than ``LOCAL_ROWS`` drawn rows are split on histograms that tasks count and Spark adds up. The rows of
smaller nodes go to one task each, which grows the subtree. Draws, feature subsets and splits depend on ids only, so the
forest is the same however the rows are dealt and wherever a node is grown.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, FEATURES, LABELS, Config
from ..sources import stages

BINS = 32
#: Rows from which a feature's bins are found, about.
BIN_ROWS = 20_000
#: Drawn rows of a node that one task may hold (30 bytes each, a few times over). Nodes above it cost a pass over the table a
#: level; the forest does not depend on it.
LOCAL_ROWS = 1_000_000
#: Rows whose cells are counted at a time.
BLOCK_ROWS = 1 << 15
#: Nodes whose histograms are held at once.
AT_ONCE = 2_000
SUBSET = math.ceil(math.sqrt(len(FEATURES)))
WEIGHTS = tuple(f"weight_{name}" for name in LABELS)
NODE_SCHEMA = "tree int, node long, feature int, threshold double, gain double, " + ", ".join(f"{c} double" for c in WEIGHTS)
ROW = np.dtype([("x", np.uint8, len(FEATURES)), ("y", np.uint8), ("times", np.uint8)])
NODE = np.dtype([("threshold", np.float64), ("left", np.int32), ("feature", np.int32)])
#: Shares of rows that a tree draws at most 0, 1, 2 ... times.
DRAWS = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(12)])


def label_index(column: str = "label"):
    names = F.array(*[F.lit(name) for name in LABELS])
    return (F.array_position(names, F.col(column)) - 1).cast("double")


def _mix(v: np.ndarray) -> np.ndarray:
    """splitmix64 of unsigned numbers."""
    v = v + np.uint64(0x9E3779B97F4A7C15)
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def _drawn(ids: np.ndarray, tree: int) -> np.ndarray:
    """How often a tree draws each row, Poisson with mean 1."""
    share = (_mix(ids ^ _mix(np.array([tree], np.uint64))) >> np.uint64(11)) / float(1 << 53)
    return np.searchsorted(DRAWS, share, side="right").astype(np.uint8)


def _subsets(seed: int, tree: int, nodes: np.ndarray) -> np.ndarray:
    """The features that each node may split on, in order."""
    key = _mix(nodes.astype(np.uint64) ^ _mix(np.array([(seed << 32) + tree], np.uint64)))
    order = _mix(key[:, None] + np.arange(len(FEATURES), dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return np.sort(np.argsort(order, axis=1)[:, :SUBSET], axis=1)


def _histograms(rows: np.ndarray, at: np.ndarray, subsets: np.ndarray) -> np.ndarray:
    """(node, feature of its subset, bin, class): drawn rows. Rows in the order of nodes are counted fastest."""
    cells = BINS * len(LABELS)
    out = np.zeros((len(subsets), SUBSET * cells))
    first = np.arange(SUBSET) * cells
    for start in range(0, len(rows), BLOCK_ROWS):
        some, own = rows[start : start + BLOCK_ROWS], at[start : start + BLOCK_ROWS]
        low, high = int(own.min()), int(own.max()) + 1
        x = np.ascontiguousarray(some["x"]).ravel()
        cell = x.take(subsets[own] + (np.arange(len(own)) * len(FEATURES))[:, None]).astype(np.int64)
        cell *= len(LABELS)
        cell += first
        cell += ((own - low) * (SUBSET * cells) + some["y"])[:, None]
        found = np.bincount(cell.ravel(), np.repeat(some["times"], SUBSET), (high - low) * SUBSET * cells)
        out[low:high] += found.reshape(high - low, -1)
    return out.reshape(len(subsets), SUBSET, BINS, len(LABELS))


def _impurity(weights: np.ndarray) -> np.ndarray:
    """Gini impurity times the weight; classes are the last axis."""
    total = weights.sum(axis=-1)
    return total - np.divide((weights**2).sum(axis=-1), total, out=np.zeros_like(total), where=total > 0)


def _splits(counts: np.ndarray, class_weight: np.ndarray, min_leaf: int):
    """Per node: place in its subset (-1: a leaf), last bin of its left side, gain, classes of both sides."""
    left = counts.cumsum(axis=2)
    whole = left[:, :1, -1:]
    right = whole - left
    gain = _impurity(whole * class_weight) - _impurity(left * class_weight) - _impurity(right * class_weight)
    allowed = (left.sum(axis=-1) >= min_leaf) & (right.sum(axis=-1) >= min_leaf)
    gain = np.where(allowed, gain, 0.0).reshape(len(counts), -1)
    best, n = gain.argmax(axis=1), np.arange(len(counts))
    place, cut = np.divmod(best, BINS)
    enough = gain[n, best] > 1e-9 * (whole * class_weight).sum(axis=(1, 2, 3))
    return np.where(enough, place, -1), cut, gain[n, best], left[n, place, cut], right[n, place, cut]


def _grow(rows: np.ndarray, root: int, tree: int, thresholds: list, class_weight: np.ndarray, config: Config) -> Iterator[tuple]:
    """The nodes below ``root``, level by level."""
    ids, at = np.array([root], np.int64), np.zeros(len(rows), np.int64)
    while len(ids):
        deep = int(ids[0]).bit_length() - 1 >= config.classifier_depth
        order = np.argsort(at, kind="stable")
        rows, at = rows[order], at[order]
        onward, following = [], []
        for start in range(0, len(ids), AT_ONCE):
            some = ids[start : start + AT_ONCE]
            low, high = np.searchsorted(at, [start, start + len(some)])
            here, place_of = rows[low:high], at[low:high] - start
            totals = np.bincount(place_of * len(LABELS) + here["y"], here["times"], len(some) * len(LABELS))
            totals = totals.reshape(len(some), -1)
            place = np.full(len(some), -1)
            live = np.flatnonzero((totals > 0).sum(axis=1) > 1) if not deep else np.array([], int)
            feature, cut, gain = place.copy(), place.copy(), np.zeros(len(some))
            if len(live):
                to = np.full(len(some), -1)
                to[live] = np.arange(len(live))
                kept = to[place_of] >= 0
                subsets = _subsets(config.seed, tree, some[live])
                counts = _histograms(here[kept], to[place_of[kept]], subsets)
                place[live], cut[live], gain[live], _, _ = _splits(counts, class_weight, config.classifier_min_leaf)
                split = np.flatnonzero(place >= 0)
                feature[split] = subsets[to[split], place[split]]
            for node, f, c, g, w in zip(some.tolist(), feature.tolist(), cut.tolist(), gain.tolist(), (totals * class_weight).tolist()):
                yield (tree, node, f, thresholds[f][c] if f >= 0 else 0.0, g if f >= 0 else 0.0, *w)
            split = np.flatnonzero(feature >= 0)
            base = 2 * sum(map(len, following))
            rank = np.full(len(some), -1)
            rank[split] = np.arange(len(split))
            moved = feature[place_of] >= 0
            here, place_of = here[moved], place_of[moved]
            goes_right = here["x"][np.arange(len(here)), feature[place_of]] > cut[place_of]
            onward.append((here, base + 2 * rank[place_of] + goes_right))
            following.append(some[split])
        ids = np.concatenate([np.stack([2 * f, 2 * f + 1], axis=1).ravel() for f in following])
        rows, at = np.concatenate([r for r, _ in onward]), np.concatenate([a for _, a in onward])


class _Top:
    """A tree's nodes that are split on the driver, and where rows are among them."""

    def __init__(self):
        self.ids, self.feature, self.cut, self.left = [1], [-1], [0], [0]

    def split(self, at: int, feature: int, cut: int) -> tuple[int, int]:
        self.feature[at], self.cut[at], self.left[at] = feature, cut, len(self.ids)
        self.ids += [2 * self.ids[at], 2 * self.ids[at] + 1]
        self.feature += [-1, -1]
        self.cut += [0, 0]
        self.left += [0, 0]
        return len(self.ids) - 2, len(self.ids) - 1

    def places(self, x: np.ndarray) -> np.ndarray:
        feature, cut, left = np.array(self.feature), np.array(self.cut), np.array(self.left)
        at, todo = np.zeros(len(x), np.int64), np.arange(len(x) if self.feature[0] >= 0 else 0)
        while len(todo):
            here = at[todo]
            at[todo] = left[here] + (x[todo, feature[here]] > cut[here])
            todo = todo[feature[at[todo]] >= 0]
        return at


def _thresholds(train: DataFrame, n: int, config: Config) -> list[np.ndarray]:
    """Ends of each feature's bins, from about ``BIN_ROWS`` rows."""
    chance = F.pmod(F.xxhash64("event_id", F.lit(config.seed), F.lit("bins")), F.lit(1 << 32))
    found = train.where(chance < min(1.0, BIN_ROWS / max(n, 1)) * (1 << 32)).select(*[F.col(c).cast("double") for c in FEATURES])
    out = []
    for column in found.toPandas().to_numpy(dtype=float).T:
        values = np.unique(column)
        if len(values) > BINS:
            ends = np.quantile(column, np.arange(1, BINS) / BINS, method="inverted_cdf")
            at = np.unique(np.searchsorted(values, ends))
            at = at[at < len(values) - 1]
        else:
            at = np.arange(len(values) - 1)
        out.append((values[at] + values[at + 1]) / 2)  # between values, so that a last digit's difference moves no row
    return out


def _binned(frame: pd.DataFrame, thresholds: list[np.ndarray]) -> np.ndarray:
    rows = np.zeros(len(frame), ROW)
    for i, c in enumerate(FEATURES):
        rows["x"][:, i] = np.searchsorted(thresholds[i], frame[c].to_numpy(dtype=float))
    rows["y"] = frame["_y"].to_numpy()
    return rows


def fit_classifier(train: DataFrame, config: Config = DEFAULTS, local_rows: int = LOCAL_ROWS) -> "AttackForest":
    """Random forest with balanced class weights n / (classes * n_class)."""
    spark = train.sparkSession
    counts = {r.label: r["count"] for r in train.groupBy("label").count().collect()}  # at most 8 classes
    n = sum(counts.values())
    class_weight = np.array([n / (len(counts) * counts[name]) if name in counts else 0.0 for name in LABELS])
    thresholds = _thresholds(train, n, config)
    identity = F.xxhash64("event_id", F.lit(config.seed)).alias("_id")
    rows = train.select(identity, label_index().cast("int").alias("_y"), *[F.col(c).cast("double") for c in FEATURES])
    tops = [_Top() for _ in range(config.classifier_trees)]
    done: list[tuple] = []
    todo = [(t, 0, n, None) for t in range(len(tops))]  # tree, place, drawn rows (the root's: about), classes
    small = []

    def counted(some: list[tuple]) -> dict[tuple[int, int], np.ndarray]:
        wanted: dict[int, list[int]] = {}
        for t, at, _, _ in some:
            wanted.setdefault(t, []).append(at)
        shared = spark.sparkContext.broadcast({t: (tops[t], places) for t, places in wanted.items()})

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[tuple[int, int], np.ndarray] = {}
            for frame in batches:
                binned, ids = _binned(frame, thresholds), frame["_id"].to_numpy().astype(np.uint64)
                for t, (top, places) in shared.value.items():
                    binned["times"] = _drawn(ids, t)
                    drawn = binned[binned["times"] > 0]
                    rank = np.full(len(top.ids), -1)
                    rank[places] = np.arange(len(places))
                    at = rank[top.places(drawn["x"])]
                    subsets = _subsets(config.seed, t, np.array(top.ids)[places])
                    found = _histograms(drawn[at >= 0], at[at >= 0], subsets)
                    for place, h in zip(places, found):
                        sums[t, place] = sums.get((t, place), 0) + h
            for (t, place), h in sums.items():
                cells = np.flatnonzero(h)
                yield pd.DataFrame({"tree": t, "place": place, "cell": cells, "n": h.ravel()[cells].astype(np.int64)})

        cells = rows.mapInPandas(count, "tree int, place int, cell int, n long").groupBy("tree", "place", "cell").agg(F.sum("n").alias("n"))
        shape = (SUBSET, BINS, len(LABELS))
        out = {(t, at): np.zeros(math.prod(shape)) for t, at, _, _ in some}
        for (t, at), part in cells.toPandas().groupby(["tree", "place"]):  # at most AT_ONCE histograms
            out[t, at][part["cell"].to_numpy()] = part["n"].to_numpy()
        return {k: v.reshape(shape) for k, v in out.items()}

    while todo:
        large = []
        for t, at, drawn, classes in todo:
            if drawn <= local_rows:
                small.append((t, at))
            else:
                large.append((t, at, drawn, classes))
        todo = []
        for start in range(0, len(large), AT_ONCE):
            some = large[start : start + AT_ONCE]
            found = counted(some)
            for t, at, _, _ in some:
                top, node = tops[t], tops[t].ids[at]
                histogram = found[t, at]
                classes = histogram[0].sum(axis=0)
                place, cut, gain, left, right = (v[0] for v in _splits(histogram[None], class_weight, config.classifier_min_leaf))
                leaf = place < 0 or (classes > 0).sum() < 2 or node.bit_length() - 1 >= config.classifier_depth
                if not leaf:
                    feature = int(_subsets(config.seed, t, np.array([node]))[0, place])
                    for child, side in zip(top.split(at, feature, int(cut)), (left, right)):
                        todo.append((t, child, float(side.sum()), side))
                split = (-1, 0.0, 0.0) if leaf else (feature, float(thresholds[feature][cut]), float(gain))
                done.append((t, node, *split, *(classes * class_weight).tolist()))

    ends: dict[int, list[int]] = {}
    for t, at in small:
        ends.setdefault(t, []).append(at)
    shared = spark.sparkContext.broadcast({t: (tops[t], places) for t, places in ends.items()})

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The drawn rows of the nodes that tasks grow, packed by node."""
        for frame in batches:
            binned, ids = _binned(frame, thresholds), frame["_id"].to_numpy().astype(np.uint64)
            for t, (top, places) in shared.value.items():
                binned["times"] = _drawn(ids, t)
                drawn = binned[binned["times"] > 0]
                at = top.places(drawn["x"])
                nodes, packed = [], []
                for place in places:
                    part = drawn[at == place] if len(top.ids) > 1 else drawn
                    if len(part):
                        nodes.append(top.ids[place])
                        packed.append(part.tobytes())
                yield pd.DataFrame({"tree": np.int32(t), "node": np.array(nodes, np.int64), "rows": packed})

    names = [part.split()[0] for part in NODE_SCHEMA.split(", ")]

    def grown(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        own = np.frombuffer(b"".join(group["rows"]), ROW)
        return pd.DataFrame(list(_grow(own, int(key[1]), int(key[0]), thresholds, class_weight, config)), columns=names)

    nodes = rows.mapInPandas(dealt, "tree int, node long, rows binary").groupBy("tree", "node").applyInPandas(grown, NODE_SCHEMA)
    if done:
        nodes = nodes.unionByName(spark.createDataFrame(done, NODE_SCHEMA))
    return AttackForest(stages.save(nodes))


@dataclass(frozen=True)
class _Tree:
    """A tree as it is sent to tasks: ``left`` is an inner node's left child, a leaf's row in ``shares``."""

    nodes: np.ndarray
    shares: np.ndarray

    @staticmethod
    def packed(tree: pd.DataFrame) -> bytes:
        tree = tree.sort_values("node")
        node, feature, weights = tree["node"].to_numpy(), tree["feature"].to_numpy(), tree[list(WEIGHTS)].to_numpy()
        leaf = feature < 0
        nodes = np.zeros(len(tree), NODE)
        nodes["feature"], nodes["threshold"] = feature, tree["threshold"]
        nodes["left"] = np.where(leaf, np.cumsum(leaf) - 1, np.searchsorted(node, 2 * node))
        shares = weights[leaf] / weights[leaf].sum(axis=1, keepdims=True)
        return np.int64(len(tree)).tobytes() + nodes.tobytes() + shares.astype(np.float32).tobytes()

    @classmethod
    def of(cls, body: bytes) -> "_Tree":
        n = int(np.frombuffer(body, np.int64, 1)[0])
        shares = np.frombuffer(body, np.float32, offset=8 + n * NODE.itemsize)
        return cls(np.frombuffer(body, NODE, n, 8), shares.reshape(-1, len(LABELS)))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        feature, threshold, left = self.nodes["feature"], self.nodes["threshold"], self.nodes["left"]
        at, todo = np.zeros(len(x), np.int64), np.arange(len(x) if feature[0] >= 0 else 0)
        while len(todo):
            here = at[todo]
            at[todo] = left[here] + (x[todo, feature[here]] > threshold[here])
            todo = todo[feature[at[todo]] >= 0]
        return self.shares[left[at]]


class AttackForest:
    """A fitted forest: its table of nodes, and the trees that score."""

    def __init__(self, nodes: DataFrame):
        self.nodes = nodes

    @cached_property
    def importances(self) -> list[float]:
        """Share of each feature in the trees' gains, every tree counting the same."""
        gains = self.nodes.where("feature >= 0").groupBy("tree", "feature").agg(F.sum("gain").alias("gain")).toPandas()
        gains["share"] = gains["gain"] / gains.groupby("tree")["gain"].transform("sum")
        out = gains.groupby("feature")["share"].sum().reindex(range(len(FEATURES)), fill_value=0.0)
        return (out / (out.sum() or 1.0)).tolist()

    @cached_property
    def trees(self) -> list[bytes]:
        """Every tree, packed by the task that has its nodes; the driver takes them one partition at a time."""

        def pack(tree: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"tree": tree["tree"].iloc[:1], "body": [_Tree.packed(tree)]})

        bodies = stages.save(self.nodes.groupBy("tree").applyInPandas(pack, "tree int, body binary"))
        return [body for _, body in sorted((r.tree, bytes(r.body)) for r in bodies.toLocalIterator())]


def classify(model: AttackForest, features: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Predicted label, its probability and one probability column per class."""
    shared = features.sparkSession.sparkContext.broadcast(model.trees)

    @F.pandas_udf("array<double>")
    def probabilities(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        trees = [_Tree.of(body) for body in shared.value]
        for batch in batches:
            x = batch.to_numpy(dtype=float)
            total = np.zeros((len(x), len(LABELS)))
            for tree in trees:
                total += tree.probabilities(x)
            yield pd.Series(list(total / total.sum(axis=1, keepdims=True)))

    scored = features.withColumn("_p", probabilities(F.struct(*[F.col(c) for c in FEATURES])))
    p = {name: F.element_at("_p", i + 1) for i, name in enumerate(LABELS)}
    best = F.array_max("_p")
    names = F.array(*[F.lit(name) for name in LABELS])
    return scored.select(
        *keep,
        F.element_at(names, F.array_position("_p", best).cast("int")).alias("predicted_label"),
        best.alias("attack_confidence"),
        *[value.alias(f"proba_{name}") for name, value in p.items()],
    )
