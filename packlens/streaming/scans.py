"""Scan streams: the same expressions over readStream, and repeated scans dropped within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.gtin import classified

SAME_SCAN_SECONDS = 10
LATE = "1 minute"


def scans_of(events: DataFrame) -> DataFrame:
    """``device, ts, code`` of an event stream whose properties carry digits of a code."""
    digits = F.regexp_replace(F.coalesce(F.get_json_object("props", "$.k"), F.lit("")), "[^0-9]", "")
    return events.select(F.col("event_id"), F.col("user_id").alias("device"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("890"), F.lpad(digits, 9, "0")).alias("code"))


def verified_scans(scans: DataFrame) -> DataFrame:
    """Stateless: each scan with the facts of its code; works on streams and tables."""
    return classified(scans, "code")


def first_scans(scans: DataFrame, late: str = LATE) -> DataFrame:
    """Of scans of one code on one device within a window, the first; state older than the watermark is dropped."""
    windowed = scans.withWatermark("ts", late).withColumn("slot", F.floor(F.unix_seconds("ts") / SAME_SCAN_SECONDS))
    return windowed.dropDuplicatesWithinWatermark(["device", "code", "slot"]) if scans.isStreaming else windowed.dropDuplicates(["device", "code", "slot"])


def scans_per_minute(scans: DataFrame, late: str = LATE) -> DataFrame:
    """Scans and devices by tumbling minute; late scans beyond the watermark don't reopen a minute."""
    return scans.withWatermark("ts", late).groupBy(F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("scans"), F.approx_count_distinct("device").alias("devices")).select(F.col("w.start").alias("minute"), "scans", "devices")
