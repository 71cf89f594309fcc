"""The telemetry stream: restarts, late rows, state that ends."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyfold.operators.telemetry import flag_suspect
from skyfold.streaming import intake

RAW = "mission_id long, source_row long, event_ts timestamp, timestamp string, latitude string, longitude string, altitude string"
START = 1_700_000_000


def rows(spark, items):
    """Rows ``mission, row, second, lat, lon``; strings as they stand in a log."""
    data = [(m, r, pd.Timestamp(START + s, unit="s").to_pydatetime(), str(s), "" if la is None else str(la), "" if lo is None else str(lo), "100") for m, r, s, la, lo in items]
    return spark.createDataFrame(data, RAW)


def run(spark, tmp_path, arrivals, **options):
    folder, out, state = (str(tmp_path / n) for n in ("raw", "rows", "state"))
    dropped = 0
    for items in arrivals:
        rows(spark, items).coalesce(2).write.mode("append").parquet(folder)
        query = intake.run_intake(spark.readStream.schema(RAW).parquet(folder), out, state, **options)
        dropped += intake.dropped_late(query)
    return spark.read.parquet(out), spark.read.parquet(folder), dropped


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    track = [(m, i, 10 * i, 24.5 + 0.0001 * i + (1.0 if i % 7 == 3 else 0.0), 120.9) for m in (1, 2) for i in range(40)]
    track = [(m, i, s, None if i % 11 == 5 else 0 if i % 13 == 6 else la, None if i % 11 == 5 else 0 if i % 13 == 6 else lo) for m, i, s, la, lo in track]
    got, raw, dropped = run(spark, tmp_path, [[t for t in track if t[2] // 140 == k] for k in range(3)], lateness="1 hour")
    want = flag_suspect(intake.row_rules(raw).drop("gps_status")).select("mission_id", "source_row", "gps_status", F.round("jump_m", 6).alias("jump_m"))
    key = lambda d: sorted(map(tuple, d.collect()), key=str)
    assert key(got.select("mission_id", "source_row", "gps_status", F.round("jump_m", 6).alias("jump_m"))) == key(want) and dropped == 0
    assert {r[0] for r in got.select("gps_status").distinct().collect()} == {"VALID", "SUSPECT", "MISSING", "INVALID"}


def test_late_rows_are_counted_and_state_ends(spark, tmp_path):
    first = [(1, 0, 0, 24.5, 120.9), (2, 0, 0, 24.5, 120.9)]
    second = [(2, i, 1000 * i, 24.5, 120.9) for i in (1, 2)]
    late_and_new = [(2, 3, 5, 24.5, 120.9), (2, 4, 2100, 24.6, 120.9), (1, 5, 2100, 25.5, 120.9)]
    got, raw, dropped = run(spark, tmp_path, [first, second, late_and_new], lateness="100 seconds", idle_s=500.0)
    assert dropped == 1 and [(r["mission_id"], r["source_row"]) for r in intake.late_rows(raw, got).collect()] == [(2, 3)]
    at = {(r["mission_id"], r["source_row"]): r for r in got.collect()}
    assert at[2, 4]["jump_m"] == pytest.approx(11119.5, abs=1) and at[2, 4]["gps_status"] == "VALID"
    assert at[1, 5]["jump_m"] is None  # the first fix of mission 1 was forgotten


def test_row_rules(spark):
    raw = spark.createDataFrame([(1, 0, None, "2024-01-01T00:00:10Z", "24°30'N", "200", "100"), (2, 0, None, "5000", "nan", "1e1", "7 m")], RAW)
    units = spark.createDataFrame([(1, True, True, None), (2, False, False, 0.001)], "mission_id long, feet boolean, lon360 boolean, time_factor double")
    a, b = intake.row_rules(raw, units).orderBy("mission_id").collect()
    assert (a["ts_s"], a["lat"], a["lon"], a["gps_status"]) == (1704067210, 24.5, -160, "VALID") and a["alt_m"] == pytest.approx(30.48)
    assert (b["ts_s"], b["lat"], b["lon"], b["alt_m"], b["gps_status"]) == (5, None, 10, None, "MISSING")
