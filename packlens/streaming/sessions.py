"""Scanning sessions by device, and scans that come late by their own device's clock.

Both run on streams and on tables. Sessions are Spark's session windows. Lateness is
custom state: a device's own watermark is the latest time it has sent, and a scan older
than that by more than a limit is late, whatever other devices send.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .scans import LATE

#: A device's session ends after so long without a scan.
GAP = "5 minutes"
LATE_SECONDS = 30
#: The state store that custom state needs: ``spark.sql.streaming.stateStore.providerClass``.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MARKED = "event_id long, device long, ts timestamp, behind long, late boolean"


def device_sessions(scans: DataFrame, gap: str = GAP, late: str = LATE) -> DataFrame:
    """``device, start, end, scans, codes``: runs of scans of a device with less than ``gap`` between them.

    ``end`` is ``gap`` after the last scan. On a stream a session is final once the
    watermark has passed its end. Devices combine their scans before the shuffle.
    """
    held = scans.withWatermark("ts", late).groupBy("device", F.session_window("ts", gap).alias("w"))
    return held.agg(F.count("*").alias("scans"), F.approx_count_distinct("code").alias("codes")).select("device", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "scans", "codes")


class LateByDevice(StatefulProcessor):
    """Marks each scan by how far it is behind the latest one its device sent before; keeps that time, one value a device."""

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "micros long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = self.latest.get()[0] if self.latest.exists() else None
        for frame in rows:
            frame = frame.sort_values("event_id", kind="stable")
            times = frame["ts"].astype("datetime64[us]").astype("int64")
            before = times.cummax().shift(1)
            if latest is not None:
                before = before.fillna(latest).clip(lower=latest)
            behind = ((before - times) // 1_000_000).where(before > times, 0).fillna(0).astype("int64")
            latest = int(times.max()) if latest is None else max(latest, int(times.max()))
            yield pd.DataFrame({"event_id": frame["event_id"], "device": key[0], "ts": frame["ts"], "behind": behind, "late": behind > self.limit})
        if latest is not None:
            self.latest.update((latest,))

    def close(self) -> None:
        pass


def late_scans(scans: DataFrame, limit: int = LATE_SECONDS) -> DataFrame:
    """``event_id, device, ts, behind, late``: whole seconds that each scan is behind its device's latest earlier one.

    Scans count in the order of event_id. On a stream the order holds within each
    batch, and a device's latest time is kept between batches and over restarts.
    """
    held = scans.select("event_id", "device", "ts")
    if scans.isStreaming:
        return held.groupBy("device").transformWithStateInPandas(LateByDevice(limit), MARKED, "Append", "None")
    before = F.max("ts").over(Window.partitionBy("device").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1))
    behind = F.greatest(F.coalesce(F.floor((F.unix_micros(before) - F.unix_micros("ts")) / 1_000_000), F.lit(0)), F.lit(0)).cast("long")
    return held.select("event_id", "device", "ts", behind.alias("behind"), (behind > limit).alias("late"))
