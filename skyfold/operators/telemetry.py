"""Telemetry normalisation and quality, keyed by ``mission_id``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skyfold.functions.geo import haversine
from skyfold.kernels.ordered import with_adjacent
from skyfold.kernels.quantile import quantiles
from skyfold.session import once

KEY = ["mission_id"]
ROW_BLOCK = 100_000

# Jump limits of a suspect fix.
SUSPECT_METRES = 200.0
SUSPECT_SPEED = 200.0


def row_block(order: str = "source_row") -> Column:
    return F.floor(F.col(order) / ROW_BLOCK)


def gps_status(df: DataFrame) -> DataFrame:
    """MISSING, INVALID or VALID per row."""
    lat, lon = F.col("lat"), F.col("lon")
    bad = ((lat == 0) & (lon == 0)) | (F.abs(lat) > 90) | (F.abs(lon) > 180)
    return df.withColumn(
        "gps_status", F.when(lat.isNull() | lon.isNull(), "MISSING").when(bad, "INVALID").otherwise("VALID")
    )


def valid_fix(lat: Column, lon: Column, alt: Column | None = None) -> Column:
    """Strict test of an embedded fix: finite, not near 0,0 and in range."""
    ok = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    if alt is not None:
        ok = ok & alt.isNotNull() & ~F.isnan(alt)
    return ok & ~((F.abs(lat) < 1e-6) & (F.abs(lon) < 1e-6)) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180)


def _valid_steps(df: DataFrame) -> DataFrame:
    """Valid rows in file order with distance and time from the previous valid row."""
    v = gps_status(df).filter("gps_status = 'VALID'")
    v = with_adjacent(
        v, KEY, ["source_row"], row_block(),
        prev={"lat_p": F.col("lat"), "lon_p": F.col("lon"), "ts_p": F.col("ts_s")},
    )
    return v.withColumn("jump_m", haversine(F.col("lat_p"), F.col("lon_p"), F.col("lat"), F.col("lon"))).withColumn(
        "dt", F.col("ts_s") - F.col("ts_p")
    )


def flag_suspect(df: DataFrame) -> DataFrame:
    """Status with SUSPECT for impossible jumps; suspect rows stay valid fixes."""
    steps = _valid_steps(df).select(*KEY, "source_row", "jump_m", "dt")
    far = (F.col("dt") > 0) & (F.col("jump_m") > SUSPECT_METRES) & (F.col("jump_m") / F.col("dt") > SUSPECT_SPEED)
    return (
        gps_status(df)
        .join(steps, [*KEY, "source_row"], "left")
        .withColumn("gps_status", F.when(far, "SUSPECT").otherwise(F.col("gps_status")))
        .withColumn("gps_valid", F.col("gps_status").isin("VALID", "SUSPECT"))
        .drop("dt")
    )


def telemetry_quality(df: DataFrame) -> DataFrame:
    """One quality row per mission."""
    df = once(df)
    f = flag_suspect(df)
    timed = with_adjacent(df.filter("ts_s IS NOT NULL"), KEY, ["source_row"], row_block(), prev={"ts_p": F.col("ts_s")})
    timed = timed.withColumn("gap", F.col("ts_s") - F.col("ts_p"))
    time = timed.groupBy(*KEY).agg(
        F.bool_and(F.col("gap") > 0).alias("monotonic"),
        (F.max_by("ts_s", "source_row") - F.min_by("ts_s", "source_row")).alias("duration_sec"),
    )
    gap = quantiles(timed.filter("gap > 0"), KEY, median_interval_sec=("gap", 0.5))
    s = F.col("gps_status")
    valid = F.col("gps_valid")
    rows = f.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(valid).alias("valid_rows"),
        F.count_if(s == "INVALID").alias("invalid_rows"),
        F.count_if(s == "MISSING").alias("missing_rows"),
        F.count_if(s == "SUSPECT").alias("suspect_rows"),
        F.coalesce(F.sum(F.when(valid, F.col("jump_m"))), F.lit(0.0)).alias("trajectory_m"),
        F.coalesce(F.max(F.when(valid, F.col("jump_m"))), F.lit(0.0)).alias("max_jump_m"),
        *[g(F.when(valid, F.col(c))).alias(f"{c}_{n}") for c in ("lat", "lon") for n, g in (("min", F.min), ("max", F.max))],
        F.count("alt_m").alias("altitude_rows"),
        F.count("ts_s").alias("timed_rows"),
    )
    return rows.join(time, KEY, "left").join(gap, KEY, "left")


def capabilities(df: DataFrame) -> DataFrame:
    """Which capabilities the telemetry of a mission offers."""
    s = gps_status(df)
    return s.groupBy(*KEY).agg(
        F.count_if(F.col("gps_status") == "VALID").alias("gps_rows"),
        F.count("alt_m").alias("altitude_rows"),
        F.count("ts_s").alias("timed_rows"),
    ).select(
        "*",
        (F.col("gps_rows") > 0).alias("gps_available"),
        (F.col("altitude_rows") > 0).alias("altitude_available"),
        (F.col("timed_rows") >= 2).alias("temporal_available"),
    )


def derive_timestamps(df: DataFrame, video: DataFrame) -> DataFrame:
    """Times from frame numbers where every untimed row carries a usable one.

    ``df(mission_id, source_row, frame_number)`` holds the untimed rows,
    ``video(mission_id, fps, duration_s)`` one row per mission.
    """
    fn = F.col("frame_number").cast("double")
    rows = with_adjacent(df.withColumn("_fn", fn), KEY, ["source_row"], row_block(), prev={"fn_p": F.col("_fn")})
    gate = rows.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("_fn").alias("numbered"),
        F.min("_fn").alias("lowest"),
        F.coalesce(F.bool_and(F.col("_fn") >= F.col("fn_p")), F.lit(True)).alias("ordered"),
        F.max_by("_fn", "source_row").alias("last_fn"),
    ).join(video, KEY, "left")
    reason = (
        F.when(F.col("n") < 2, "too few rows")
        .when(F.col("numbered") < F.col("n"), "rows without frame number")
        .when(F.col("lowest") < 0, "negative frame number")
        .when(~F.col("ordered"), "frame numbers decrease")
        .when(F.col("fps").isNull() | (F.col("fps") <= 0), "no frame rate")
        .when(F.col("last_fn") / F.col("fps") > 1.05 * F.col("duration_s") + 0.5, "longer than the video")
    )
    gate = gate.withColumn("refused", reason).select(*KEY, "fps", "refused")
    return df.join(gate, KEY, "left").withColumn(
        "ts_s", F.when(F.col("refused").isNull(), fn / F.col("fps"))
    ).drop("fps")


def resolve_order(srt: DataFrame, container_fix: DataFrame) -> DataFrame:
    """Whether a log swaps latitude and longitude, judged by the container's own fix."""
    from pyspark.sql import Window

    w = Window.partitionBy(*KEY).orderBy("source_row")
    first = srt.withColumn("_i", F.row_number().over(w)).filter("_i <= 30")
    med = quantiles(first, KEY, mlat=("lat", 0.5), mlon=("lon", 0.5))
    j = med.join(container_fix, KEY)
    direct = F.greatest(F.abs(F.col("mlat") - F.col("fix_lat")), F.abs(F.col("mlon") - F.col("fix_lon")))
    swapped = F.greatest(F.abs(F.col("mlon") - F.col("fix_lat")), F.abs(F.col("mlat") - F.col("fix_lon")))
    return j.select(*KEY, direct.alias("direct_deg"), swapped.alias("swapped_deg")).withColumn(
        "swap", (F.col("swapped_deg") <= 0.05) & (F.col("swapped_deg") + 0.01 < F.col("direct_deg"))
    )


def telemetry_mode(missions: DataFrame, external: DataFrame, embedded: DataFrame) -> DataFrame:
    """External log wins over embedded fixes, embedded over video only."""
    e = external.select(*KEY).distinct().withColumn("_ext", F.lit(True))
    m = embedded.select(*KEY).distinct().withColumn("_emb", F.lit(True))
    return missions.select(*KEY).join(e, KEY, "left").join(m, KEY, "left").select(
        *KEY,
        F.when(F.col("_ext"), "video_with_external_telemetry").when(F.col("_emb"), "video_with_embedded_telemetry").otherwise("video_only").alias("mode"),
    )


def telemetry_grade(df: DataFrame) -> DataFrame:
    """Coarse grade from the count and span of valid rows in file order."""
    v = gps_status(df).filter("gps_status = 'VALID'")
    timed = F.col("ts_s").isNotNull()
    at = F.when(timed, F.col("source_row"))
    a = v.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("valid_rows"),
        F.count("ts_s").alias("timed_rows"),
        (F.max_by("ts_s", at) - F.min_by("ts_s", at)).alias("span_s"),
    )
    a = df.select(*KEY).distinct().join(a, KEY, "left").fillna(0, ["valid_rows", "timed_rows"])
    return a.withColumn(
        "grade",
        F.when(F.col("valid_rows") < 3, "insufficient")
        .when(F.col("timed_rows") < 2, "low")
        .when(F.col("span_s") <= 0, "insufficient")
        .when((F.col("valid_rows") < 10) | (F.col("span_s") < 5.0), "low")
        .otherwise("good"),
    )
