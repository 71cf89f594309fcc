"""Telemetry intake as a stream: strict casts and units row by row, the jump test with one remembered fix per mission."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from skyfold.functions.geo import EARTH_R
from skyfold.functions.parse import parse_dms, parse_iso, parse_number
from skyfold.operators.telemetry import KEY, SUSPECT_METRES, SUSPECT_SPEED, gps_status

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROWS = "mission_id long, source_row long, event_ts timestamp, ts_s double, lat double, lon double, alt_m double, gps_status string, gps_valid boolean, jump_m double"
FEET = 0.3048


def row_rules(raw: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """Typed rows with a status from text cells ``mission_id, source_row, event_ts, timestamp, latitude, longitude, altitude``.

    Cells are plain numbers, ISO times or degrees with a hemisphere letter; others give null.  ``units(mission_id, feet, lon360,
    time_factor)``, a static table, turns feet, longitudes up to 360 and other time units into metres, signed degrees and seconds.
    """
    degrees = lambda c: F.coalesce(parse_number(F.col(c)), parse_dms(F.col(c)))
    time = F.coalesce(parse_number(F.col("timestamp")), parse_iso(F.col("timestamp")))
    rows = raw.select(*KEY, "source_row", "event_ts", time.alias("ts_s"), degrees("latitude").alias("lat"), degrees("longitude").alias("lon"), parse_number(F.col("altitude")).alias("alt_m"))
    if units is not None:
        def fixed(name: str) -> Column:
            return {
                "ts_s": F.when(F.col("time_factor").isNotNull(), F.col("ts_s") * F.col("time_factor")).otherwise(F.col("ts_s")),
                "lon": F.when(F.col("lon360") & (F.col("lon") > 180), F.col("lon") - 360).otherwise(F.col("lon")),
                "alt_m": F.when(F.col("feet"), F.col("alt_m") * FEET).otherwise(F.col("alt_m")),
            }.get(name, F.col(name))

        rows = rows.join(units.select(*KEY, "feet", "lon360", "time_factor"), KEY, "left").select(*[fixed(c).alias(c) for c in rows.columns])
    return gps_status(rows)


def jumps(rows: pd.DataFrame, last: tuple[float, float, float] | None) -> tuple[pd.DataFrame, tuple[float, float, float] | None]:
    """Status after the jump test for rows of one mission in file order, from the last valid fix ``lat, lon, ts`` before them."""
    rows = rows.sort_values("source_row", kind="stable").reset_index(drop=True)
    ok = (rows["gps_status"] == "VALID").to_numpy()
    here = rows.loc[ok, ["lat", "lon", "ts_s"]].to_numpy(float)
    before = np.vstack([np.full((1, 3), np.nan) if last is None else np.array([last]), here[:-1]]) if len(here) else here
    p, q = np.radians(before[:, :2]), np.radians(here[:, :2])
    arc = np.sin((q[:, 0] - p[:, 0]) / 2) ** 2 + np.cos(p[:, 0]) * np.cos(q[:, 0]) * np.sin((q[:, 1] - p[:, 1]) / 2) ** 2
    metres = 2 * EARTH_R * np.arcsin(np.minimum(1.0, np.sqrt(arc)))
    seconds = here[:, 2] - before[:, 2]
    with np.errstate(invalid="ignore", divide="ignore"):
        far = (seconds > 0) & (metres > SUSPECT_METRES) & (metres / seconds > SUSPECT_SPEED)
    status = rows["gps_status"].to_numpy(object)
    status[np.flatnonzero(ok)[far]] = "SUSPECT"
    jump = np.full(len(rows), np.nan)
    jump[ok] = metres
    out = rows.assign(gps_status=status, gps_valid=ok, jump_m=pd.Series(jump).astype(object).where(~np.isnan(jump), None))
    return out, tuple(map(float, here[-1])) if len(here) else last


class LastFix(StatefulProcessor):
    """Keeps the last valid fix of a mission until no row came for ``idle_ms`` of event time."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fix = handle.getValueState("fix", "lat double, lon double, ts_s double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows), ignore_index=True)
        out, fix = jumps(got, self.fix.get() if self.fix.exists() else None)
        if fix is not None:
            self.fix.update(fix)
        newest = got["event_ts"].max()
        if pd.notna(newest):
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(int(newest.timestamp() * 1000) + self.idle_ms)
        yield out[[c.split()[0] for c in ROWS.split(", ")]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.fix.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_telemetry(raw: DataFrame, lateness: str = "10 minutes", idle_s: float = 3600.0, units: DataFrame | None = None) -> DataFrame:
    """Rows of a text stream with ``gps_status`` and ``jump_m`` as ``flag_suspect`` gives them for the whole log.

    Rows of a mission must arrive in file order from one micro-batch to the next; inside a batch they are sorted.  State is one fix per
    mission, dropped ``idle_s`` seconds of event time after its last row.  Rows older than the watermark of ``lateness`` are dropped by
    Spark and counted in the query's progress; ``late_rows`` finds them again.
    """
    timed = row_rules(raw.withWatermark("event_ts", lateness), units)
    return timed.groupBy(*KEY).transformWithStateInPandas(LastFix(int(idle_s * 1000)), ROWS, "append", "eventTime")


def run_intake(raw: DataFrame, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Process all that has arrived, append the rows under ``out``, and return the ended query; a restart goes on at ``checkpoint``."""
    spark = raw.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        query = stream_telemetry(raw, **options).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
    return query


def dropped_late(query: StreamingQuery) -> int:
    """Rows behind the watermark by the progress of an ended query."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])


def late_rows(raw: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of the arrived files that are not in the written result: those that came too late."""
    return raw.join(rows.select(*KEY, "source_row"), [*KEY, "source_row"], "left_anti")


def replay(telemetry: DataFrame, folder: str, out: str, checkpoint: str, parts: int, held: Column, start_s: float = 1.7e9, **options) -> tuple[DataFrame, int]:
    """The whole log as ``parts`` arrivals by time, each one taken in before the next comes; the rows that arrived, and how many Spark dropped.

    Rows marked ``held`` come with the last arrival; relative times start at ``start_s`` of event time.  Every arrival is a start of the query at the same checkpoint.
    """
    spark = telemetry.sparkSession
    first, top = telemetry.agg(F.min("ts_s"), F.max("ts_s")).first()
    step = ((top or 0.0) - (first or 0.0)) / parts or 1.0
    part = F.least(F.lit(parts - 1), F.floor((F.col("ts_s") - (first or 0.0)) / step))
    text = telemetry.select(
        *KEY, "source_row", F.timestamp_micros(((F.col("ts_s") + start_s) * 1e6).cast("long")).alias("event_ts"), F.col("ts_s").cast("string").alias("timestamp"),
        F.col("lat").cast("string").alias("latitude"), F.col("lon").cast("string").alias("longitude"), F.col("alt_m").cast("string").alias("altitude"),
        F.when(held, parts - 1).otherwise(F.coalesce(part, F.lit(0))).alias("part"),
    )
    dropped = 0
    for k in range(parts):
        text.filter(F.col("part") == k).drop("part").write.mode("append").parquet(folder)
        raw = spark.readStream.schema(text.drop("part").schema).parquet(folder)
        dropped += dropped_late(run_intake(raw, out, checkpoint, **options))
    return spark.read.parquet(folder), dropped
