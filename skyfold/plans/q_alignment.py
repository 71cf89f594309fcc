"""Registered queries: track cleaning, fits and comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyfold.functions.attitude import with_quaternion
from skyfold.operators import alignment as al, track as tr
from skyfold.plans.q_telemetry import VALID, fix_track, valid
from skyfold.plans.registry import query
from skyfold.session import cut, once


@query("c6_reject_jumps")
def _(t):
    return al.reject_jumps(tr.collapse_stale(valid(t)))[1]


@query("c7_position_prior")
def _(t):
    return al.position_prior(valid(t))


SPAN = f"WITH v AS ({VALID}), s AS (SELECT *, lead(ts_s) OVER w AS t2, lead(alt_m) OVER w AS a2, min(ts_s) OVER (PARTITION BY mission_id) AS t0, max(ts_s) OVER (PARTITION BY mission_id) AS t1 FROM v WINDOW w AS (PARTITION BY mission_id ORDER BY ts_s))"


@query("c8_resample", f"""{SPAN}, g AS (SELECT mission_id, t0, t1, unnest(range(0, CAST(floor((t1-t0+1e-9)/0.5e0) AS BIGINT)+1)) AS i FROM (SELECT DISTINCT mission_id, t0, t1 FROM s))
 SELECT g.mission_id, g.i, any_value(alt_m + (a2-alt_m)*((g.t0+g.i*0.5e0)-ts_s)/(t2-ts_s)) AS z FROM g JOIN s ON s.mission_id=g.mission_id AND s.ts_s<=g.t0+g.i*0.5e0+1e-9 AND g.t0+g.i*0.5e0<=s.t2+1e-9 GROUP BY 1,2""", "z")
def _(t):
    v = valid(t).select("mission_id", "ts_s", F.col("lat").alias("x"), F.col("lon").alias("y"), F.col("alt_m").alias("z"))
    return al.resample(v).select("mission_id", "i", "z")


@query("c11_forward_sync", f"""WITH s AS ({VALID}), l AS (SELECT mission_id, max(ts_s) AS lt FROM s GROUP BY 1), c AS (SELECT f.mission_id, f.frame_num, f.timestamp_sec, s.ts_s AS ta FROM frames f ASOF LEFT JOIN s ON f.mission_id=s.mission_id AND f.timestamp_sec<=s.ts_s),
 d AS (SELECT c.*, coalesce(ta,lt) AS t, CASE WHEN abs(coalesce(ta,lt)-timestamp_sec)<=0.75 THEN abs(coalesce(ta,lt)-timestamp_sec) END AS dt FROM c LEFT JOIN l USING (mission_id))
 SELECT mission_id, count(*) AS frames, count(dt) AS matched, max(dt) AS max_dt_s, arg_min(t-timestamp_sec, timestamp_sec) AS global_offset_s, quantile_cont(dt,.5) AS median_dt_s, quantile_cont(dt,.95) AS p95_dt_s, count(dt)>=greatest(2,CAST(trunc(count(*)*0.8e0) AS INTEGER)) AS passed FROM d GROUP BY 1""", "max_dt_s global_offset_s median_dt_s p95_dt_s")
def _(t):
    return al.temporal_sync(t.frames, valid(t))


def attitude(t):
    r = F.col("source_row")
    d = t.telemetry.select("mission_id", "source_row", (r * 7 % 40 - 20).cast("double").alias("roll"), (r * 11 % 90 - 80).cast("double").alias("pitch"), (r * 13 % 360 - 180).cast("double").alias("yaw"), ((r * 13 + F.col("mission_id") % 3 * 4) % 360 - 180).cast("double").alias("yaw2"))
    return cut(with_quaternion(d, yaw="yaw2").select("mission_id", "source_row", "roll", "pitch", "yaw", "qw", "qx", "qy", "qz"))


@query("c13_yaw_course_offset")
def _(t):
    k = fix_track(t)
    shift = k.select("mission_id", "idx", "lat", "lon", "alt_m", F.degrees(F.atan2(F.lit(1.0), F.col("idx") + 1.0)).alias("yaw"))
    return al.yaw_course_offset(shift, 10.0)


@query("c14_gimbal_quaternion")
def _(t):
    return attitude(t).select("mission_id", "source_row", "qw", "qx", "qy", "qz")


# A turn by d about the vertical axis rotates the camera by exactly d.
@query("c15_attitude_cross_check", """SELECT mission_id, count(*) AS samples, (mission_id%3)*4.0e0 AS max_angle_deg, (mission_id%3)*4.0e0 AS median_angle_deg FROM telemetry GROUP BY 1 HAVING count(*)>=3""", "max_angle_deg median_angle_deg", 3)
def _(t):
    return al.cross_validate_rpy(attitude(t))


@query("c16_similarity_fit")
def _(t):
    f = al.fit_similarity(t.track, ["mission_id"])
    return f.select("mission_id", "n", "scale", "tx", "ty", "tz")


@query("c17_robust_fit")
def _(t):
    fit, rows = al.fit_similarity_robust(t.track)
    return fit.select("mission_id", "scale", "tx", "ty", "tz").join(rows.groupBy("mission_id").agg(F.count_if("inlier").alias("inliers"), F.count_if(~F.col("inlier")).alias("outliers")), "mission_id")


@query("c18_piecewise_fit")
def _(t):
    fit, cams = al.fit_piecewise(t.track)
    return cams.groupBy("mission_id").agg(F.count("win").alias("with_window"), F.count_if(F.col("win").isNull()).alias("global"), F.max("win").alias("last_window"))


@query("c19_apply_transform", "SELECT mission_id, point_id, 2*x+1 AS x, 2*y+2 AS y, 2*z+3 AS z FROM points", "x y z")
def _(t):
    ident = F.array(*[F.lit(1.0 if i % 4 == 0 else 0.0) for i in range(9)])
    fit = t.points.select("mission_id").distinct().select("mission_id", F.lit(2.0).alias("scale"), ident.alias("r"), F.lit(1.0).alias("tx"), F.lit(2.0).alias("ty"), F.lit(3.0).alias("tz"))
    return al.apply_transform(t.points, fit).select("mission_id", "point_id", "x", "y", "z")


def visual_track(t):
    k = fix_track(t)
    e = once(tr.to_enu(k, tr.anchors(k, "idx")))
    vis = e.select("mission_id", "ts_s", (F.col("n") * -0.5 + 3).alias("x"), (F.col("e") * 0.5 + 1).alias("y"), (F.col("u") * 0.5).alias("z"))
    return vis, e.select("mission_id", "ts_s", "e", "n", "u")


@query("c20_track_comparison")
def _(t):
    return al.compare_tracks(*visual_track(t))


@query("c21_pose_jumps")
def _(t):
    return al.pose_jumps(visual_track(t)[0])


@query("c22_trajectory_gate")
def _(t):
    vis, tel = visual_track(t)
    return al.trajectory_gate(al.temporal_sync(t.frames, valid(t)), al.compare_tracks(vis, tel), al.pose_jumps(vis))


@query("c23_trajectory_summary", """WITH d AS (SELECT *, cx-lag(cx) OVER w AS x, cy-lag(cy) OVER w AS y, cz-lag(cz) OVER w AS z FROM poses WINDOW w AS (PARTITION BY mission_id ORDER BY frame_id)), a AS (SELECT *, sqrt(pow(x-lag(x) OVER w,2)+pow(y-lag(y) OVER w,2)+pow(z-lag(z) OVER w,2)) AS acc FROM d WINDOW w AS (PARTITION BY mission_id ORDER BY frame_id))
 SELECT mission_id, count(*) AS points, coalesce(sum(sqrt(x*x+y*y+z*z)),0) AS total_length, coalesce(sum(sqrt(x*x+y*y+z*z)),0)/greatest(count(*)-1,1) AS mean_speed, coalesce(greatest(0,least(1,1-avg(acc)/10)),1) AS smoothness FROM a GROUP BY 1""", "total_length mean_speed smoothness")
def _(t):
    return al.trajectory_summary(t.poses)


@query("c24_metric_scale")
def _(t):
    return al.estimate_scale(t.track)


@query("c24_extent", "SELECT a.mission_id, max(sqrt(pow(a.dx-b.dx,2)+pow(a.dy-b.dy,2)+pow(a.dz-b.dz,2))) AS extent FROM track a JOIN track b ON a.mission_id=b.mission_id GROUP BY 1", "extent")
def _(t):
    return al.extent(t.track, ["dx", "dy", "dz"])


@query("c25_gps_stats", "SELECT mission_id, count(*) AS frames, count(lat) AS with_gps, min(lat) AS lat_min, max(lat) AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max, min(alt_m) AS alt_m_min, max(alt_m) AS alt_m_max FROM telemetry GROUP BY 1", "lat_min lat_max lon_min lon_max alt_m_min alt_m_max")
def _(t):
    return al.gps_stats(t.telemetry)


@query("c26_flight_facts", """WITH g AS (SELECT mission_id, min(z) AS ground_z FROM points GROUP BY 1) SELECT mission_id, min(cz-ground_z) AS agl_min, max(cz-ground_z) AS agl_max, avg(cz-ground_z) AS agl_mean, quantile_cont(60.0e0+frame_id%4,.5) AS focal, avg(cz-ground_z)/quantile_cont(60.0e0+frame_id%4,.5) AS gsd_m FROM poses JOIN g USING (mission_id) GROUP BY 1""", "agl_min agl_max agl_mean focal gsd_m")
def _(t):
    g = t.points.groupBy("mission_id").agg(F.min("z").alias("ground_z"))
    return al.flight_facts(t.poses.withColumn("z", F.col("cz")), g, t.poses.select("mission_id", (60.0 + F.col("frame_id") % 4).alias("focal_px")))


@query("c26_thin_track", "SELECT mission_id, source_row FROM (SELECT *, row_number() OVER (PARTITION BY mission_id ORDER BY source_row)-1 AS r, count(*) OVER (PARTITION BY mission_id) AS n FROM telemetry) WHERE r % greatest(1,CAST(floor(n/20) AS BIGINT))=0")
def _(t):
    return al.thin_track(t.telemetry, "source_row", 20).select("mission_id", "source_row")


@query("c27_placement_report")
def _(t):
    return al.placement_report(t.track)


@query("c28_attitude_gate", "SELECT mission_id, count(*) AS \"rows\", (mission_id%3)*4.0e0 AS median_angle_deg, (mission_id%3)*4.0e0<=5 AS ok FROM telemetry GROUP BY 1", "median_angle_deg", 3)
def _(t):
    return al.attitude_ok(attitude(t))
