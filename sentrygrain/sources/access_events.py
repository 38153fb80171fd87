"""The access-event table, derived from the ``events`` table by plain arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import EVENT_SCHEMA

# Sites with country, city, latitude, longitude.
SITES = (
    ("India", "Chennai", 13.0827, 80.2707),
    ("India", "Bangalore", 12.9716, 77.5946),
    ("United States", "Atlanta", 33.7490, -84.3880),
    ("United States", "Charlotte", 35.2271, -80.8431),
    ("United Kingdom", "London", 51.5074, -0.1278),
    ("Germany", "Frankfurt", 50.1109, 8.6821),
)
# Sensitivity of a resource by the first part of its name.
RESOURCE_SENSITIVITY = {"signup": "low", "view": "low", "click": "medium", "error": "high", "purchase": "critical"}


def _by_remainder(number: Column, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (number % len(names) + 1).cast("int"))


def from_events(events: DataFrame) -> DataFrame:
    """Map (event_id, ts, user_id, event_type, value, props) to access events."""
    user, kind = F.col("user_id"), F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    base = events.select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"))
    k = F.col("k")
    number = F.when(k < 90, user % 6).otherwise((user + k) % 6)
    sites = F.array(
        *[
            F.struct(
                F.lit(c).alias("country"), F.lit(t).alias("city"), F.lit(la).alias("lat"), F.lit(lo).alias("lon")
            )
            for c, t, la, lo in SITES
        ]
    )
    site = F.element_at(sites, (number + 1).cast("int"))
    device = F.when(k % 25 == 0, "2").otherwise("1")
    label = (
        F.when((kind == "error") & (k >= 95), "BRUTE_FORCE")
        .when((kind == "purchase") & (k >= 97), "LOW_AND_SLOW_EXFILTRATION")
        .when((kind == "view") & (k >= 98), "LATERAL_MOVEMENT")
        .when((kind == "click") & (k >= 98), "IMPOSSIBLE_TRAVEL")
        .when((kind == "signup") & (k == 99), "INSIDER_DRIFT")
        .otherwise("BENIGN")
    )
    entity_type = F.when(user % 10 < 7, "user").when(user % 10 < 9, "service_account").otherwise("edge_device")
    out = base.select(
        F.concat(F.lit("EVT-"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("event_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("ENT-"), F.lpad(user.cast("string"), 6, "0")).alias("entity_id"),
        entity_type.alias("entity_type"),
        _by_remainder(user, ("developer", "finance", "it_admin")).alias("role"),
        F.concat(
            F.lit("10."), (user % 250).cast("string"), F.lit("."), number.cast("string"), F.lit(".1")
        ).alias("source_ip"),
        site["country"].alias("country"),
        site["city"].alias("city"),
        site["lat"].alias("latitude"),
        site["lon"].alias("longitude"),
        _by_remainder(user, ("SSO", "MFA", "SSH_KEY")).alias("auth_method"),
        (kind != "error").alias("auth_success"),
        F.concat(kind, F.lit("/"), (k % 4).cast("string")).alias("resource_accessed"),
        F.upper(kind).alias("action"),
        F.upper(kind).alias("command_sequence"),
        F.col("value").cast("double").alias("session_duration_s"),
        (F.col("value") * 1024).cast("double").alias("bytes_transferred"),
        F.concat(F.lit("DEV-"), user.cast("string"), F.lit("-"), device).alias("device_id"),
        F.lit("Linux").alias("device_os"),
        F.lit("N/A").alias("device_firmware"),
        F.lit("HTTPS").alias("device_protocol"),
        F.concat(F.lit("mac-"), user.cast("string"), F.lit("-"), device).alias("device_mac"),
        label.alias("label"),
        (user % 5).alias("_cell"),
    )
    out = out.withColumn("is_attack", ~F.col("label").isin("BENIGN", "INSIDER_DRIFT"))
    campaign = F.concat(F.lit("CMP-"), F.col("label"), F.lit("-"), F.col("_cell").cast("string"))
    out = out.withColumn("campaign_id", F.when(F.col("label") != "BENIGN", campaign))
    return out.select(*EVENT_SCHEMA.fieldNames())


def access_events(spark: SparkSession, folder: str) -> DataFrame:
    return from_events(spark.read.parquet(f"{folder}/events.parquet"))


def campaigns(events: DataFrame) -> DataFrame:
    """campaign_id, attack_type, stealthy and the sorted entities taking part."""
    cell = F.substring_index("campaign_id", "-", -1).cast("int")
    return (
        events.where("campaign_id is not null")
        .select("campaign_id", F.col("label").alias("attack_type"), (cell % 3 == 0).alias("stealthy"))
        .distinct()
    )


def campaign_entities(events: DataFrame) -> DataFrame:
    """(campaign_id, entity_id) pairs, kept as rows: a campaign may be large."""
    return events.where("campaign_id is not null").select("campaign_id", "entity_id").distinct()


def resource_catalog(events: DataFrame) -> DataFrame:
    """Distinct resources with their sensitivity level by name."""
    level = F.substring_index("resource_accessed", "/", 1)
    named = F.create_map(*[F.lit(x) for kv in RESOURCE_SENSITIVITY.items() for x in kv])
    return events.select("resource_accessed").distinct().withColumn("level", F.try_element_at(named, level))
