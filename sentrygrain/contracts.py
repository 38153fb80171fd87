"""Table contracts and the guards checked at stage boundaries."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .config import FEATURES, INFERENCE_FORBIDDEN, LABEL_COLUMNS, LABELS, RISK_FORBIDDEN

_S, _D, _B = T.StringType(), T.DoubleType(), T.BooleanType()

OBSERVATION_SCHEMA = T.StructType(
    [
        T.StructField("event_id", _S, False),
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("entity_id", _S),
        T.StructField("entity_type", _S),
        T.StructField("role", _S),
        T.StructField("source_ip", _S),
        T.StructField("country", _S),
        T.StructField("city", _S),
        T.StructField("latitude", _D),
        T.StructField("longitude", _D),
        T.StructField("auth_method", _S),
        T.StructField("auth_success", _B),
        T.StructField("resource_accessed", _S),
        T.StructField("action", _S),
        T.StructField("command_sequence", _S),
        T.StructField("session_duration_s", _D),
        T.StructField("bytes_transferred", _D),
        T.StructField("device_id", _S),
        T.StructField("device_os", _S),
        T.StructField("device_firmware", _S),
        T.StructField("device_protocol", _S),
        T.StructField("device_mac", _S),
    ]
)
EVENT_SCHEMA = T.StructType(
    OBSERVATION_SCHEMA.fields
    + [T.StructField("label", _S), T.StructField("is_attack", _B), T.StructField("campaign_id", _S)]
)


class ContractError(ValueError):
    """A table does not satisfy its contract."""


class LeakageError(ContractError):
    """Ground truth reached a place where only observations may go."""


def check_columns(df: DataFrame, *, require_labels: bool = True) -> DataFrame:
    """Compare the columns and timestamp type with the event contract, at plan time."""
    wanted = EVENT_SCHEMA if require_labels else OBSERVATION_SCHEMA
    missing = [f.name for f in wanted if f.name not in df.columns]
    if missing:
        raise ContractError(f"event table lacks columns: {missing}")
    kind = df.schema["timestamp"].dataType
    if not isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        raise ContractError(f"timestamp must be a timestamp, not {kind.simpleString()}")
    return df


def out_of_order(df: DataFrame) -> DataFrame:
    """One row: does any later timestamp carry a smaller event_id?

    A table has no row order, so "sorted" means the two orders agree. Extremes
    are compared level by level (microseconds of a second, seconds of an hour,
    hours), so each window group is bounded by the calendar, not by the data.
    """
    micros = df.groupBy(F.unix_micros(F.col("timestamp").cast("timestamp")).alias("at")).agg(
        F.min("event_id").alias("low"), F.max("event_id").alias("high")
    )
    levels = micros.withColumn("broken", F.lit(False))
    for width in (1_000_000, 3_600_000_000, None):
        group = [F.floor(F.col("at") / width)] if width else []
        earlier = Window.partitionBy(*group).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        broken = F.col("broken") | F.coalesce(F.col("low") < F.max("high").over(earlier), F.lit(False))
        levels = levels.withColumn("broken", broken)
        if width:
            levels = levels.groupBy(F.floor(F.col("at") / width).alias("slot")).agg(
                F.min("low").alias("low"), F.max("high").alias("high"), F.bool_or("broken").alias("broken")
            )
            levels = levels.select((F.col("slot") * width).alias("at"), "low", "high", "broken")
    return levels.agg(F.coalesce(F.bool_or("broken"), F.lit(False)).cast("bigint").alias("out_of_order"))


def event_violations(df: DataFrame) -> DataFrame:
    """Contract violations of the rows, as one row of counts."""
    counts = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("event_id").isNull()).alias("null_event_ids"),
        F.count_if(F.col("timestamp").isNull()).alias("null_timestamps"),
        F.count_if(~F.coalesce(F.col("label"), F.lit("?")).isin(*LABELS)).alias("unknown_labels"),
    )
    return counts.crossJoin(out_of_order(df))  # one row each


def event_faults(require_labels: bool = True) -> dict[str, Column]:
    """Conditions that no row of an event table may fulfil."""
    faults = {"null_event_ids": F.col("event_id").isNull(), "null_timestamps": F.col("timestamp").isNull()}
    if require_labels:
        faults["unknown_labels"] = ~F.coalesce(F.col("label"), F.lit("?")).isin(*LABELS)
    return faults


def require_order(df: DataFrame) -> DataFrame:
    """Raise if ids and times of the events do not have the same order."""
    if out_of_order(df).first()[0]:
        raise ContractError("event table violates its contract: events are not in order of time")
    return df


def validate_events(df: DataFrame, *, require_labels: bool = True, strict_order: bool = False) -> DataFrame:
    """Return ``df`` if it satisfies the event contract, else raise."""
    check_columns(df, require_labels=require_labels)
    if not require_labels:
        return df
    found = event_violations(df).first().asDict()
    broken = ["null_event_ids", "null_timestamps", "unknown_labels"] + (["out_of_order"] if strict_order else [])
    bad = {k: found[k] for k in broken if found[k]}
    if bad:
        raise ContractError(f"event table violates its contract: {bad}")
    return df


_SCOPES = {"features": LABEL_COLUMNS, "risk": RISK_FORBIDDEN, "inference": INFERENCE_FORBIDDEN}


def guard_leakage(columns: Iterable[str], scope: str = "features") -> None:
    """Fail if ground truth (or, later, model output) is among ``columns``."""
    offenders = sorted(set(columns) & set(_SCOPES[scope]))
    if offenders:
        raise LeakageError(f"{scope} inputs must not contain {offenders}")


def strip_labels(df: DataFrame, scope: str = "features") -> DataFrame:
    return df.drop(*[c for c in _SCOPES[scope] if c in df.columns])


def _expressions(value) -> Iterable[list]:
    """Expression trees (lists of nodes, root first) among the fields of a plan node."""
    if isinstance(value, list):
        if value and isinstance(value[0], dict) and "num-children" in value[0]:
            yield value
        else:
            for item in value:
                yield from _expressions(item)


def _attribute(tree: list) -> int | None:
    return tree[0]["exprId"]["id"] if "exprId" in tree[0] else None


def lineage(df: DataFrame) -> dict[str, set[str]]:
    """For each column, the names of the source columns it is computed from.

    Follows expression ids through the analysed plan: projections, aggregates, windows, generators, unions
    and Python operators, whose every result counts as computed from their whole input. Sources are the columns
    of the tables and rows that the plan reads. What only filters or joins rows is not followed.
    """
    nodes = json.loads(df._jdf.queryExecution().analyzed().toJSON())
    made_of: dict[int, set[int]] = defaultdict(set)
    names: dict[int, str] = {}
    at = 0

    def visit() -> list[int]:
        """Expression ids that the next plan node puts out, in order."""
        nonlocal at
        node = nodes[at]
        at += 1
        children = [visit() for _ in range(node["num-children"])]
        kind = node["class"].rsplit(".", 1)[-1]
        trees = {field: list(_expressions(value)) for field, value in node.items()}
        for tree in (t for some in trees.values() for t in some):
            own = _attribute(tree)
            used = {e["exprId"]["id"] for e in tree if e["class"].endswith(".AttributeReference")}
            if own is not None:
                made_of[own] |= used - {own}
        below = [i for child in children for i in child]
        if not children:
            out = trees.get("output") or []
            names.update({_attribute(t): t[0]["name"] for t in out})
            return [_attribute(t) for t in out]
        if kind == "Project":
            return [_attribute(t) for t in trees["projectList"]]
        if kind == "Aggregate":
            return [_attribute(t) for t in trees["aggregateExpressions"]]
        if kind == "Window":
            return below + [_attribute(t) for t in trees["windowExpressions"]]
        if kind == "Generate":
            used = {e["exprId"]["id"] for t in trees["generator"] for e in t if e["class"].endswith(".AttributeReference")}
            made = [_attribute(t) for t in trees["generatorOutput"]]
            for i in made:
                made_of[i] |= used
            return below + made
        if kind == "Union":
            for child in children[1:]:
                for first, other in zip(children[0], child, strict=True):
                    made_of[first].add(other)
            return children[0]
        if kind == "Expand" or ("output" in trees and trees["output"]):
            made = [_attribute(t) for t in trees["output"]]
            for i in made:
                made_of[i] |= set(below) - {i}
            return made
        if kind == "Join" and node.get("joinType", {}).get("object", "").endswith(("LeftSemi$", "LeftAnti$")):
            return children[0]
        return below

    def sources(i: int, seen: set[int]) -> set[str]:
        found = {names[i]} if i in names else set()
        for j in made_of[i] - seen:
            seen.add(j)
            found |= sources(j, seen)
        return found

    out = visit()
    return {name: sources(i, {i}) for name, i in zip(df.columns, out, strict=True)}


def guard_lineage(df: DataFrame, columns: Iterable[str], scope: str = "features") -> DataFrame:
    """Fail if one of ``columns`` is computed from ground truth, by whatever name it goes."""
    forbidden, of = set(_SCOPES[scope]), lineage(df)
    offenders = {c: sorted(of[c] & forbidden) for c in columns if of[c] & forbidden}
    if offenders:
        raise LeakageError(f"{scope} inputs are computed from forbidden columns: {offenders}")
    return df


def finite_faults(columns: Iterable[str] = FEATURES) -> dict[str, Column]:
    return {c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")) for c in columns}


def non_finite_counts(features: DataFrame) -> DataFrame:
    """NaN, infinite or null values per model feature, in one pass, long form."""
    bad = [
        F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))).alias(c) for c in FEATURES
    ]
    return features.agg(*bad).unpivot([], list(FEATURES), "feature", "n_bad")


def require_finite(features: DataFrame) -> DataFrame:
    bad = non_finite_counts(features).where("n_bad > 0").collect()  # at most one row per feature
    if bad:
        raise ContractError(f"features hold NaN or infinite values: {[(r.feature, r.n_bad) for r in bad]}")
    return features


def guard_unique(df: DataFrame, *keys: str) -> DataFrame:
    """Raise if ``keys`` are not unique in ``df`` (join cardinality guard)."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).count()
    if twice:
        raise ContractError(f"{keys} must be unique")
    return df
