"""Geodesy and track analytics, keyed by ``mission_id``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skyfold.functions import geo
from skyfold.functions.stats import clip, grade, norm3, present
from skyfold.kernels.ordered import asof_neighbours, with_adjacent, with_running
from skyfold.kernels.quantile import quantiles
from skyfold.session import once
from skyfold.operators.telemetry import KEY, row_block

TIME_SLOT = 600.0
# Grade cut-offs shared by the score reports.
GRADES = [(85.0, "Excellent"), (70.0, "Good"), (50.0, "Fair")]


def time_slot(t: str = "ts_s") -> Column:
    return F.floor(F.col(t) / TIME_SLOT)


def anchors(df: DataFrame, order: str) -> DataFrame:
    """First fix of every mission."""
    a = df.groupBy(*KEY).agg(F.min_by(F.struct("lat", "lon", "alt_m"), order).alias("a"))
    return a.select(*KEY, F.col("a.lat").alias("lat0"), F.col("a.lon").alias("lon0"), F.col("a.alt_m").alias("alt0"))


def to_enu(df: DataFrame, anchor: DataFrame) -> DataFrame:
    """Add metres east, north and up of the mission anchor: ``e, n, u``."""
    args = [F.col(c) for c in ("lat", "lon", "alt_m", "lat0", "lon0", "alt0")]
    e, n, u = geo.enu(*args)
    return df.join(anchor, KEY).select(*df.columns, e.alias("e"), n.alias("n"), u.alias("u"))


def to_wgs84(df: DataFrame, anchor: DataFrame) -> DataFrame:
    """Replace ``e, n, u`` by ``lat, lon, alt_m``."""
    lat, lon, alt = geo.enu_to_geodetic(*[F.col(c) for c in ("e", "n", "u", "lat0", "lon0", "alt0")])
    keep = [c for c in df.columns if c not in ("e", "n", "u", "lat", "lon", "alt_m")]
    return df.join(anchor, KEY).select(*keep, lat.alias("lat"), lon.alias("lon"), alt.alias("alt_m"))


def utm_zone(df: DataFrame) -> DataFrame:
    return df.groupBy(*KEY).agg(geo.utm_epsg(F.avg("lat"), F.avg("lon")).alias("epsg"))


def collapse_stale(df: DataFrame, order: str = "source_row", chunk: Column | None = None) -> DataFrame:
    """Drop rows that repeat the fix of the previous row."""
    p = with_adjacent(
        df, KEY, [order], row_block(order) if chunk is None else chunk, prev={"_la": F.col("lat"), "_lo": F.col("lon")}
    )
    same = (F.col("lat") == F.col("_la")) & (F.col("lon") == F.col("_lo"))
    return p.filter(~F.coalesce(same, F.lit(False))).select(*df.columns)


def stale_report(df: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows before and after, with the log rate and the fix rate per second."""
    span = F.max("ts_s") - F.min("ts_s")
    a = df.groupBy(*KEY).agg(F.count(F.lit(1)).alias("rows_in"), span.alias("span_s"))
    b = kept.groupBy(*KEY).agg(F.count(F.lit(1)).alias("rows_out"))
    ok = F.col("span_s") > 0
    return a.join(b, KEY, "left").fillna(0, ["rows_out"]).select(
        *KEY, "rows_in", "rows_out",
        F.when(ok, (F.col("rows_in") - 1) / F.col("span_s")).alias("log_hz"),
        F.when(ok, (F.col("rows_out") - 1) / F.col("span_s")).alias("fix_hz"),
    )


def gps_quality(track: DataFrame, order: str = "idx", jump_m: float = 30.0) -> DataFrame:
    """Quality of a fix track ``(mission_id, idx, ts_s, lat, lon, alt_m)`` with dense ``idx`` from 0."""
    track = once(track)
    t = to_enu(track, anchors(track, order)).withColumn("_blk", row_block(order))
    t = with_adjacent(
        t, KEY, [order], "_blk", prev={"e1": F.col("e"), "n1": F.col("n"), "u1": F.col("u"), "t1": F.col("ts_s")}
    )
    dt = F.col("ts_s") - F.col("t1")
    t = t.withColumn("step", norm3(F.col("e") - F.col("e1"), F.col("n") - F.col("n1"), F.col("u") - F.col("u1")))
    t = t.withColumn("speed", F.col("step") / F.when(dt > 0, dt).otherwise(1.0))
    t = with_adjacent(t, KEY, [order], "_blk", prev={"speed1": F.col("speed")}).withColumn("dv", F.col("speed") - F.col("speed1"))
    t = with_adjacent(t, KEY, [order], "_blk", prev={"dv1": F.col("dv")}).withColumn("acc", F.abs(F.col("dv") - F.col("dv1")))
    t = once(t)
    pos = F.struct("e", "n", "u")
    g = t.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("points"),
        F.regr_slope("alt_m", order).alias("_s"), F.regr_intercept("alt_m", order).alias("_i"), F.avg("alt_m").alias("_m"),
        F.min_by(pos, order).alias("_p0"), F.max_by(pos, order).alias("_p1"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("path_length_m"),
    ).join(quantiles(t, KEY, med_step=("step", 0.5)), KEY)
    seg = {c: F.col(f"_p1.{c}") - F.col(f"_p0.{c}") for c in "enu"}
    g = g.withColumn("_len2", sum(s * s for s in seg.values()))
    j = t.join(g, KEY)
    off = {c: F.col(c) - F.col(f"_p0.{c}") for c in "enu"}
    along = clip(sum(off[c] * seg[c] for c in "enu") / F.col("_len2"))
    away = norm3(*[off[c] - along * seg[c] for c in "enu"])
    flat = F.sqrt("_len2") <= 1e-6
    resid = F.col("alt_m") - F.when(F.col("points") >= 3, F.col("_s") * F.col(order) + F.col("_i")).otherwise(F.col("_m"))
    limit = F.greatest(F.lit(jump_m), 5.0 * F.when(F.col("points") > 2, F.col("med_step")).otherwise(0.0))
    r = j.groupBy(*KEY).agg(
        F.first("points").alias("points"),
        F.first("path_length_m").alias("path_length_m"),
        F.avg("speed").alias("mean_speed_m_s"),
        F.max("speed").alias("max_speed_m_s"),
        F.sqrt(F.avg(resid * resid)).alias("altitude_std_m"),
        F.count_if(F.col("step") > limit).alias("discontinuities"),
        F.avg(F.when(~flat, away)).alias("_d1"),
        F.sqrt(F.avg(sum(o * o for o in off.values()))).alias("_d2"),
        F.avg("acc").alias("_acc"),
    )
    drift = F.when((F.col("points") < 3) | (F.col("path_length_m") <= 0), 0.0).otherwise(F.coalesce("_d1", "_d2"))
    smooth = F.when(F.col("points") < 4, 1.0).otherwise(clip(1 - F.col("_acc") / F.greatest(F.col("mean_speed_m_s") + 1e-6, F.lit(1e-6))))
    r = r.withColumn("drift_m", drift).withColumn("smoothness", smooth)
    path = F.col("path_length_m")
    score = 100.0 * (
        0.4 * clip(1 - F.col("drift_m") / F.greatest(path * 0.2, F.lit(1.0)))
        + 0.3 * clip(1 - F.col("discontinuities") / F.greatest(F.col("points") / 5.0, F.lit(1.0)))
        + 0.3 * clip(1 - F.col("altitude_std_m") / 20.0)
    )
    few = F.col("points") < 2
    r = r.withColumn("gps_score", F.when(~few, score))
    return r.select(
        *KEY, "points", "path_length_m", "mean_speed_m_s", "max_speed_m_s", "altitude_std_m", "discontinuities", "drift_m",
        "smoothness", "gps_score",
        F.when(~few, grade(F.col("gps_score"), GRADES, "Poor")).alias("grade"),
        F.when(few, F.array(F.lit("too few points"))).otherwise(
            present(
                (F.col("discontinuities") > 0, "jumps: check for signal loss"),
                (F.col("drift_m") > path * 0.1, "drift: consider RTK corrections"),
                (F.col("altitude_std_m") > 10, "altitude: calibrate the barometer"),
                (F.col("points") < 8, "few samples: raise the logging rate"),
            )
        ).alias("suggestions"),
    )


def sync_frames(frames: DataFrame, samples: DataFrame, max_offset: float = 1.0) -> DataFrame:
    """Nearest sample of every frame; ``dt_s`` is null when none is close enough.

    ``frames(mission_id, frame_num, timestamp_sec)``; ``samples`` are valid rows with ``ts_s``.
    """
    hit = asof_neighbours(frames.select(*KEY, "frame_num", "timestamp_sec"), samples, KEY, "timestamp_sec", "ts_s", TIME_SLOT)
    db, da = F.col("timestamp_sec") - F.col("before.ts_s"), F.col("after.ts_s") - F.col("timestamp_sec")
    near = F.when(da.isNull() | (db <= da), F.col("before")).otherwise(F.col("after"))
    hit = hit.withColumn("near", near).withColumn("dt_s", F.col("near.ts_s") - F.col("timestamp_sec"))
    ok = F.abs("dt_s") <= max_offset
    cols = [c for c in samples.columns if c not in KEY]
    return hit.select(
        *KEY, "frame_num", "timestamp_sec", F.when(ok, F.col("dt_s")).alias("dt_s"), *[F.when(ok, F.col("near")[c]).alias(c) for c in cols]
    )


def sync_report(matches: DataFrame, samples: DataFrame) -> DataFrame:
    """Matched and unmatched frames, offset and sample spacing per mission."""
    matches = once(matches)
    m = matches.groupBy(*KEY).agg(
        F.count("dt_s").alias("matched"),
        F.count_if(F.col("dt_s").isNull()).alias("unmatched"),
        F.count_distinct(F.when(F.col("dt_s").isNotNull(), F.col("frame_num"))).alias("distinct_frames"),
    )
    off = quantiles(matches, KEY, offset_s=("dt_s", 0.5))
    gaps = with_adjacent(samples, KEY, ["ts_s"], time_slot(), prev={"t1": F.col("ts_s")}).withColumn("gap", F.col("ts_s") - F.col("t1"))
    gap = quantiles(gaps.filter("gap > 0"), KEY, spacing_s=("gap", "upper"))
    return m.join(off, KEY, "left").join(gap, KEY, "left").withColumn(
        "overlap", F.when(F.col("matched") == 0, "no_overlap").otherwise("overlap")
    )


def sufficient_track(sync: DataFrame) -> DataFrame:
    """Whether the matches suffice for a georeference."""
    return sync.withColumn("sufficient", (F.col("matched") >= 3) & (F.col("distinct_frames") >= 3) & F.col("spacing_s").isNotNull())
