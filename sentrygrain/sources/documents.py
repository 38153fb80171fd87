"""JSON documents: campaigns, rosters, list columns and metric documents."""

from __future__ import annotations

import json
from dataclasses import asdict

import pyspark
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULTS, Config
from ..operators.analyst import ENTITY_COLUMNS, normalise_entities, roster_from_events

REASON_TYPE = "array<struct<code:string,contribution:double>>"
CAMPAIGN_FIELDS = {"campaign_id": "string", "attack_type": "string", "entity_ids": "array<string>", "stealthy": "boolean"}


def _entries(rows: DataFrame, column: str) -> DataFrame:
    """One row for each member of a list or object in a variant column: its ``pos``, ``key`` (null in a list) and ``value``."""
    held = rows.select(F.col(column).alias("_held"))
    return held.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_held").outer())).select("pos", "key", "value")


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """Each file below ``path`` as one variant; text that is no JSON is null."""
    return spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("doc"))


def _fields(record: str, fields: dict[str, str]) -> list[Column]:
    return [F.try_variant_get(record, f'$["{name}"]', kind).alias(name) for name, kind in fields.items()]


def read_campaigns(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """Campaigns, one row each, of files that hold a JSON list, or with ``lines`` one record a line."""
    if lines:
        records = spark.read.text(path).select(F.try_parse_json("value").alias("value"))
    else:
        records = _entries(_documents(spark, path), "doc")
    rows = records.select(*_fields("value", CAMPAIGN_FIELDS))
    return rows.where("campaign_id is not null")


def read_roster(spark: SparkSession, path: str, events: DataFrame | None = None) -> DataFrame:
    """Entities from ``{"entities": [..]}``, a list, or an id -> record map; files of one form each below ``path``.

    Documents stay variants, so an id is never taken for a column, whatever their number. Fields beyond
    the roster's contract are kept as JSON text; finding their names is one pass over the records.
    Documents without usable records fall back to the entities in ``events``.
    """
    top = _entries(_documents(spark, path), "doc")
    kind = F.schema_of_variant("value")
    found = top.agg(
        F.bool_or((F.col("key") == "entities") & kind.startswith("ARRAY")).alias("wrapped"),
        F.bool_or(F.col("key").isNull() & kind.startswith("OBJECT")).alias("listed"),
        F.bool_or(F.col("key") == "profile").alias("described"),
        F.bool_and(kind.startswith("OBJECT")).alias("records"),
    ).first()
    entity_id = F.try_variant_get("value", "$.entity_id", "string")
    if found.wrapped:
        records = _entries(top.where("key = 'entities'"), "value")
    elif found.listed:
        records = top.where("key is null")
    elif found.records and not found.described:
        records, entity_id = top, F.col("key")
    elif events is not None:
        return roster_from_events(events)
    else:
        raise ValueError(f"no entity records in {path}")
    names = {r.key for r in _entries(records, "value").where("key is not null").select("key").distinct().collect()}  # field names
    known = _fields("value", dict.fromkeys(ENTITY_COLUMNS[1:], "string"))
    more = [F.to_json(F.try_variant_get("value", f'$["{name}"]', "variant")).alias(name) for name in sorted(names - set(ENTITY_COLUMNS))]
    return normalise_entities(records.select(entity_id.alias("entity_id"), *known, *more).where("entity_id is not null"))


def lists_to_json(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.to_json(c) for c in columns})


def lists_from_json(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Parse JSON list columns; text that is no list becomes an empty list."""
    parsed = {c: F.coalesce(F.from_json(c, t), F.array().cast(t)) for c, t in types.items()}
    return df.withColumns(parsed)


def strict(df: DataFrame) -> DataFrame:
    """NaN and infinities become null, timestamps ISO text, as JSON requires."""

    def clean(name: str, kind: T.DataType) -> Column:
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            bad = F.isnan(name) | (F.abs(F.col(name)) == float("inf"))
            return F.when(~bad, F.col(name)).alias(name)
        if isinstance(kind, T.TimestampType):
            return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(name)
        return F.col(name)

    return df.select(*[clean(f.name, f.dataType) for f in df.schema])


def manifest(config: Config = DEFAULTS, notes: str = "") -> dict[str, Column]:
    """Seed, configuration, versions and creation time as columns."""
    return {
        "seed": F.lit(config.seed),
        "config": F.lit(json.dumps(asdict(config), sort_keys=True)),
        "versions": F.lit(json.dumps({"pyspark": pyspark.__version__})),
        "notes": F.lit(notes),
        "created_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"),
    }


def metrics_document(sections: dict[str, DataFrame], config: Config = DEFAULTS, notes: str = "") -> DataFrame:
    """(section, record, manifest...): one strict JSON record per metric row."""
    parts = [
        strict(df).select(F.lit(name).alias("section"), F.to_json(F.struct("*")).alias("record"))
        for name, df in sections.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumns(manifest(config, notes))


def write_metrics(document: DataFrame, path: str) -> None:
    document.write.mode("overwrite").partitionBy("section").json(path)


def read_metrics(spark: SparkSession, path: str, section: str, schema: str) -> DataFrame:
    """One section of a metrics document with typed columns."""
    raw = spark.read.schema("record string, section string").json(path).where(F.col("section") == section)
    return raw.select(F.from_json("record", schema).alias("r")).select("r.*")
