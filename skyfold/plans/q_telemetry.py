"""Registered queries: telemetry and track basics."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyfold.functions import geo
from skyfold.operators import telemetry as te, track as tr
from skyfold.plans.registry import query
from skyfold.session import once


def sql_haversine(a, b, c, d, radius=geo.EARTH_R):
    h = f"(pow(sin(radians({c}-{a})/2),2)+cos(radians({a}))*cos(radians({c}))*pow(sin(radians({d}-{b})/2),2))"
    return f"2*{radius}e0*asin(sqrt(CASE WHEN {h}>1 THEN 1.0e0 ELSE {h} END))"


def sql_ecef(lat, lon, alt):
    n = f"({geo.WGS84_A}e0/sqrt(1-{geo.WGS84_E2:.20f}*pow(sin(radians({lat})),2)))"
    return [
        f"(({n}+{alt})*cos(radians({lat}))*cos(radians({lon})))",
        f"(({n}+{alt})*cos(radians({lat}))*sin(radians({lon})))",
        f"(({n}*(1-{geo.WGS84_E2:.20f})+{alt})*sin(radians({lat})))",
    ]


def sql_enu(src: str) -> str:
    """Rows of ``src(mission_id, idx, lat, lon, alt_m, lat0, lon0, alt0)`` with e, n, u."""
    x, x0 = sql_ecef("lat", "lon", "alt_m"), sql_ecef("lat0", "lon0", "alt0")
    dx = ", ".join(f"{a}-{b} AS d{i}" for i, (a, b) in enumerate(zip(x, x0)))
    return f"""SELECT * EXCLUDE (d0,d1,d2), -sin(radians(lon0))*d0 + cos(radians(lon0))*d1 AS e,
  -sin(radians(lat0))*cos(radians(lon0))*d0 - sin(radians(lat0))*sin(radians(lon0))*d1 + cos(radians(lat0))*d2 AS n,
  cos(radians(lat0))*cos(radians(lon0))*d0 + cos(radians(lat0))*sin(radians(lon0))*d1 + sin(radians(lat0))*d2 AS u
FROM (SELECT *, {dx} FROM ({src}))"""


STATUS = """CASE WHEN lat IS NULL OR lon IS NULL THEN 'MISSING'
  WHEN (lat=0 AND lon=0) OR abs(lat)>90 OR abs(lon)>180 THEN 'INVALID' ELSE 'VALID' END"""
VALID = f"SELECT * FROM telemetry WHERE {STATUS}='VALID'"
STEPS = f"""SELECT *, {sql_haversine('lat_p', 'lon_p', 'lat', 'lon')} AS jump_m, ts_s-ts_p AS dt FROM (
  SELECT *, lag(lat) OVER w AS lat_p, lag(lon) OVER w AS lon_p, lag(ts_s) OVER w AS ts_p FROM ({VALID})
  WINDOW w AS (PARTITION BY mission_id ORDER BY source_row))"""
SUSPECT = f"""SELECT t.*, CASE WHEN s.dt>0 AND s.jump_m>200 AND s.jump_m/s.dt>200 THEN 'SUSPECT' ELSE {STATUS.replace('lat', 't.lat').replace('lon', 't.lon')} END AS gps_status, s.jump_m
  FROM telemetry t LEFT JOIN ({STEPS}) s USING (mission_id, source_row)"""
COLLAPSED = f"""SELECT * FROM (SELECT *, lag(lat) OVER w AS pla, lag(lon) OVER w AS plo FROM ({VALID})
  WINDOW w AS (PARTITION BY mission_id ORDER BY source_row)) WHERE pla IS NULL OR NOT (lat=pla AND lon=plo)"""
TRACK = f"""SELECT mission_id, row_number() OVER (PARTITION BY mission_id ORDER BY source_row)-1 AS idx, source_row, ts_s, lat, lon, alt_m FROM ({COLLAPSED})"""
ANCHORED = f"""SELECT *, first_value(lat) OVER w AS lat0, first_value(lon) OVER w AS lon0, first_value(alt_m) OVER w AS alt0 FROM ({TRACK})
  WINDOW w AS (PARTITION BY mission_id ORDER BY idx)"""


def valid(t):
    return te.gps_status(t.telemetry).filter("gps_status = 'VALID'").drop("gps_status")


def fix_track(t):
    """Valid fixes, stale repeats collapsed, numbered from 0."""
    kept = tr.collapse_stale(valid(t))
    out = tr.with_running(kept, tr.KEY, ["source_row"], te.row_block(), rank="_r")
    return once(out.withColumn("idx", F.col("_r") - 1).drop("_r"))


@query("b5_cell_casts", r"""SELECT id, pos, CASE WHEN regexp_full_match(p,'[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') AND isfinite(try_cast(p AS DOUBLE)) THEN try_cast(p AS DOUBLE) END AS n, p
 FROM (SELECT doc_id AS id, unnest(range(len(c)))::INTEGER AS pos, unnest(c) AS p FROM (SELECT doc_id, regexp_extract_all(text,'[^ \t\n\x0B\f\r]+') AS c FROM documents))""", "n")
def _(t):
    from skyfold.functions.parse import parse_number

    cells = t.raw("documents").select(F.col("doc_id").alias("id"), F.posexplode(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")).alias("pos", "p"))
    return cells.filter("p <> ''").select("id", "pos", parse_number(F.col("p")).alias("n"), "p")


@query("b7_gps_status", f"SELECT mission_id, source_row, {STATUS} AS gps_status FROM telemetry")
def _(t):
    return te.gps_status(t.telemetry).select("mission_id", "source_row", "gps_status")


@query("b8_valid_fix", """SELECT mission_id, count(*) AS n FROM telemetry WHERE lat IS NOT NULL AND lon IS NOT NULL
  AND NOT (abs(lat)<1e-6 AND abs(lon)<1e-6) AND abs(lat)<=90 AND abs(lon)<=180 GROUP BY 1""")
def _(t):
    return t.telemetry.filter(te.valid_fix(F.col("lat"), F.col("lon"), F.col("alt_m"))).groupBy("mission_id").agg(F.count(F.lit(1)).alias("n"))


@query("b9_suspect_jumps", f"SELECT mission_id, source_row, gps_status, jump_m FROM ({SUSPECT})", "jump_m")
def _(t):
    return te.flag_suspect(t.telemetry).select("mission_id", "source_row", "gps_status", "jump_m")


@query("b10_telemetry_quality", f"""WITH f AS ({SUSPECT}), g AS (SELECT *, ts_s-lag(ts_s) OVER (PARTITION BY mission_id ORDER BY source_row) AS gap FROM telemetry),
 tm AS (SELECT mission_id, bool_and(gap>0) AS monotonic, arg_max(ts_s,source_row)-arg_min(ts_s,source_row) AS duration_sec, quantile_cont(gap,0.5) FILTER (gap>0) AS median_interval_sec FROM g GROUP BY 1)
 SELECT mission_id, count(*) AS total_rows, count(*) FILTER (gps_status IN ('VALID','SUSPECT')) AS valid_rows, count(*) FILTER (gps_status='INVALID') AS invalid_rows,
 count(*) FILTER (gps_status='MISSING') AS missing_rows, count(*) FILTER (gps_status='SUSPECT') AS suspect_rows,
 coalesce(sum(jump_m),0) AS trajectory_m, coalesce(max(jump_m),0) AS max_jump_m,
 min(lat) FILTER (gps_status IN ('VALID','SUSPECT')) AS lat_min, max(lat) FILTER (gps_status IN ('VALID','SUSPECT')) AS lat_max,
 min(lon) FILTER (gps_status IN ('VALID','SUSPECT')) AS lon_min, max(lon) FILTER (gps_status IN ('VALID','SUSPECT')) AS lon_max,
 count(alt_m) AS altitude_rows, count(ts_s) AS timed_rows, any_value(monotonic) AS monotonic, any_value(duration_sec) AS duration_sec, any_value(median_interval_sec) AS median_interval_sec
 FROM f JOIN tm USING (mission_id) GROUP BY 1""", "trajectory_m max_jump_m lat_min lat_max lon_min lon_max duration_sec median_interval_sec")
def _(t):
    return te.telemetry_quality(t.telemetry)


@query("b11_capabilities", f"""SELECT mission_id, count(*) FILTER ({STATUS}='VALID') AS gps_rows, count(alt_m) AS altitude_rows, count(ts_s) AS timed_rows,
 count(*) FILTER ({STATUS}='VALID')>0 AS gps_available, count(alt_m)>0 AS altitude_available, count(ts_s)>=2 AS temporal_available FROM telemetry GROUP BY 1""")
def _(t):
    return te.capabilities(t.telemetry)


VIDEO = "SELECT mission_id, 25.0e0 + mission_id%3*5 AS fps, (max(source_row)+1)/(25.0e0 + mission_id%3*5)*(CASE WHEN mission_id%5=0 THEN 0.2e0 ELSE 1.0e0 END) AS duration_s FROM telemetry GROUP BY mission_id"


@query("b12_derive_timestamps", f"""WITH v AS ({VIDEO}), r AS (SELECT mission_id, source_row, CASE WHEN mission_id%7=0 AND source_row%11=3 THEN NULL ELSE source_row - (CASE WHEN mission_id%13=0 AND source_row%5=2 THEN 3 ELSE 0 END) END AS fn FROM telemetry),
 l AS (SELECT *, lag(fn) OVER (PARTITION BY mission_id ORDER BY source_row) AS p FROM r),
 g AS (SELECT mission_id, CASE WHEN count(*)<2 THEN 'too few rows' WHEN count(fn)<count(*) THEN 'rows without frame number' WHEN min(fn)<0 THEN 'negative frame number'
  WHEN NOT coalesce(bool_and(fn>=p),true) THEN 'frame numbers decrease' WHEN arg_max(fn,source_row)/any_value(fps) > 1.05*any_value(duration_s)+0.5 THEN 'longer than the video' END AS refused, any_value(fps) AS fps
  FROM l JOIN v USING (mission_id) GROUP BY 1)
 SELECT mission_id, source_row, fn AS frame_number, refused, CASE WHEN refused IS NULL THEN fn/fps END AS ts_s FROM r JOIN g USING (mission_id)""", "frame_number ts_s")
def _(t):
    r, m = F.col("source_row"), F.col("mission_id")
    fps = F.lit(25.0) + m % 3 * 5
    video = t.telemetry.groupBy("mission_id").agg(F.max("source_row").alias("_x")).select(
        "mission_id", fps.alias("fps"), ((F.col("_x") + 1) / fps * F.when(m % 5 == 0, 0.2).otherwise(1.0)).alias("duration_s")
    )
    fn = F.when(~((m % 7 == 0) & (r % 11 == 3)), r - F.when((m % 13 == 0) & (r % 5 == 2), 3).otherwise(0))
    return te.derive_timestamps(t.telemetry.select("mission_id", "source_row", fn.alias("frame_number")), video)


@query("b13_coordinate_order", f"""WITH s AS (SELECT mission_id, CASE WHEN mission_id%2=0 THEN lon ELSE lat END AS lat, CASE WHEN mission_id%2=0 THEN lat ELSE lon END AS lon, source_row FROM ({VALID})),
 f AS (SELECT mission_id, 24.53e0 AS fix_lat, 120.93e0 AS fix_lon FROM telemetry GROUP BY mission_id),
 m AS (SELECT mission_id, quantile_cont(lat,.5) AS mlat, quantile_cont(lon,.5) AS mlon FROM (SELECT *, row_number() OVER (PARTITION BY mission_id ORDER BY source_row) AS i FROM s) WHERE i<=30 GROUP BY 1),
 d AS (SELECT mission_id, greatest(abs(mlat-fix_lat),abs(mlon-fix_lon)) AS direct_deg, greatest(abs(mlon-fix_lat),abs(mlat-fix_lon)) AS swapped_deg FROM m JOIN f USING (mission_id))
 SELECT *, swapped_deg<=0.05 AND swapped_deg+0.01<direct_deg AS swap FROM d""", "direct_deg swapped_deg")
def _(t):
    odd = F.col("mission_id") % 2 == 0
    srt = valid(t).select("mission_id", "source_row", F.when(odd, F.col("lon")).otherwise(F.col("lat")).alias("lat"), F.when(odd, F.col("lat")).otherwise(F.col("lon")).alias("lon"))
    fix = t.telemetry.select("mission_id").distinct().select("mission_id", F.lit(24.53).alias("fix_lat"), F.lit(120.93).alias("fix_lon"))
    return te.resolve_order(srt, fix)


@query("b15_telemetry_mode", f"""SELECT mission_id, CASE WHEN max(CASE WHEN {STATUS}='VALID' AND alt_m>350.9 THEN 1 ELSE 0 END)=1 THEN 'video_with_external_telemetry'
 WHEN max(alt_m)>350.7 THEN 'video_with_embedded_telemetry' ELSE 'video_only' END AS mode FROM telemetry GROUP BY 1""")
def _(t):
    part = t.telemetry
    ext = te.gps_status(part).filter("gps_status = 'VALID' AND alt_m > 350.9")
    return te.telemetry_mode(part.select("mission_id").distinct(), ext, part.filter("alt_m > 350.7"))


@query("b16_telemetry_grade", f"""WITH a AS (SELECT mission_id, count(*) AS valid_rows, count(ts_s) AS timed_rows, arg_max(ts_s,source_row)-arg_min(ts_s,source_row) AS span_s FROM ({VALID}) GROUP BY 1)
 SELECT mission_id, coalesce(valid_rows,0) AS valid_rows, coalesce(timed_rows,0) AS timed_rows, span_s, CASE WHEN coalesce(valid_rows,0)<3 THEN 'insufficient' WHEN timed_rows<2 THEN 'low' WHEN span_s<=0 THEN 'insufficient'
  WHEN valid_rows<10 OR span_s<5 THEN 'low' ELSE 'good' END AS grade FROM (SELECT DISTINCT mission_id FROM telemetry) LEFT JOIN a USING (mission_id)""", "span_s")
def _(t):
    return te.telemetry_grade(t.telemetry)


@query("c1_haversine", f"""SELECT mission_id, source_row, {sql_haversine('lat', 'lon', '24.53e0', '120.93e0')} AS d_telemetry, {sql_haversine('lat', 'lon', '24.53e0', '120.93e0', geo.EARTH_R_PAIRS)} AS d_pairs FROM ({VALID})""", "d_telemetry d_pairs")
def _(t):
    a = [F.col("lat"), F.col("lon"), F.lit(24.53), F.lit(120.93)]
    return valid(t).select("mission_id", "source_row", geo.haversine(*a).alias("d_telemetry"), geo.haversine(*a, geo.EARTH_R_PAIRS).alias("d_pairs"))


@query("c2_local_frame", f"SELECT mission_id, idx, e, n, u FROM ({sql_enu(ANCHORED)})", "e n u")
def _(t):
    k = fix_track(t)
    return tr.to_enu(k, tr.anchors(k, "idx")).select("mission_id", "idx", "e", "n", "u")


@query("c3_back_to_wgs84", f"SELECT mission_id, idx, lat, lon, alt_m FROM ({TRACK})", "lat lon alt_m")
def _(t):
    k = fix_track(t)
    a = tr.anchors(k, "idx")
    return tr.to_wgs84(tr.to_enu(k, a), a).select("mission_id", "idx", "lat", "lon", "alt_m")


@query("c4_utm_zone", f"SELECT mission_id, CAST((CASE WHEN avg(lat)>=0 THEN 32600 ELSE 32700 END) + floor((avg(lon)+180)/6)%60+1 AS BIGINT) AS epsg FROM ({VALID}) GROUP BY 1")
def _(t):
    return tr.utm_zone(valid(t))


@query("c5_collapse_stale", f"""WITH a AS (SELECT mission_id, count(*) AS rows_in, max(ts_s)-min(ts_s) AS span_s FROM ({VALID}) GROUP BY 1), b AS (SELECT mission_id, count(*) AS rows_out FROM ({COLLAPSED}) GROUP BY 1)
 SELECT mission_id, rows_in, rows_out, CASE WHEN span_s>0 THEN (rows_in-1)/span_s END AS log_hz, CASE WHEN span_s>0 THEN (rows_out-1)/span_s END AS fix_hz FROM a JOIN b USING (mission_id)""", "log_hz fix_hz")
def _(t):
    v = valid(t)
    return tr.stale_report(v, tr.collapse_stale(v))


QUALITY = f"""WITH p AS ({sql_enu(ANCHORED)}),
 s AS (SELECT *, sqrt(pow(e-lag(e) OVER w,2)+pow(n-lag(n) OVER w,2)+pow(u-lag(u) OVER w,2)) AS step, ts_s-lag(ts_s) OVER w AS dt FROM p WINDOW w AS (PARTITION BY mission_id ORDER BY idx)),
 v AS (SELECT *, step/(CASE WHEN dt>0 THEN dt ELSE 1 END) AS speed FROM s),
 a AS (SELECT *, abs(speed-2*lag(speed) OVER w+lag(speed,2) OVER w) AS acc FROM v WINDOW w AS (PARTITION BY mission_id ORDER BY idx)),
 g AS (SELECT mission_id, count(*) AS points, regr_slope(alt_m,idx) AS sl, regr_intercept(alt_m,idx) AS ic, avg(alt_m) AS am, arg_min(e,idx) AS e0, arg_min(n,idx) AS n0, arg_min(u,idx) AS u0,
   arg_max(e,idx)-arg_min(e,idx) AS se, arg_max(n,idx)-arg_min(n,idx) AS sn, arg_max(u,idx)-arg_min(u,idx) AS su, coalesce(sum(step),0) AS path_length_m, quantile_cont(step,.5) AS med FROM a GROUP BY 1),
 j AS (SELECT *, se*se+sn*sn+su*su AS l2, CASE WHEN points>=3 THEN alt_m-(sl*idx+ic) ELSE alt_m-am END AS res FROM a JOIN g USING (mission_id)),
 k AS (SELECT *, greatest(0,least(1,((e-e0)*se+(n-n0)*sn+(u-u0)*su)/(CASE WHEN l2>0 THEN l2 END))) AS al FROM j),
 r AS (SELECT mission_id, any_value(points) AS points, any_value(path_length_m) AS path_length_m, avg(speed) AS mean_speed_m_s, max(speed) AS max_speed_m_s, sqrt(avg(res*res)) AS altitude_std_m,
   count(*) FILTER (step>greatest(30, 5*(CASE WHEN points>2 THEN med ELSE 0 END))) AS discontinuities,
   CASE WHEN any_value(points)<3 OR any_value(path_length_m)<=0 THEN 0 WHEN sqrt(any_value(l2))>1e-6 THEN avg(sqrt(pow(e-e0-al*se,2)+pow(n-n0-al*sn,2)+pow(u-u0-al*su,2)))
     ELSE sqrt(avg(pow(e-e0,2)+pow(n-n0,2)+pow(u-u0,2))) END AS drift_m,
   CASE WHEN any_value(points)<4 THEN 1 ELSE greatest(0,least(1,1-avg(acc)/greatest(avg(speed)+1e-6,1e-6))) END AS smoothness FROM k GROUP BY 1),
 z AS (SELECT *, CASE WHEN points>=2 THEN 100*(0.4e0*greatest(0,least(1,1-drift_m/greatest(path_length_m*0.2e0,1)))+0.3e0*greatest(0,least(1,1-discontinuities/greatest(points/5.0e0,1)))+0.3e0*greatest(0,least(1,1-altitude_std_m/20))) END AS gps_score FROM r)
 SELECT *, CASE WHEN gps_score>=85 THEN 'Excellent' WHEN gps_score>=70 THEN 'Good' WHEN gps_score>=50 THEN 'Fair' WHEN points>=2 THEN 'Poor' END AS grade FROM z"""
QCOLS = "path_length_m mean_speed_m_s max_speed_m_s altitude_std_m drift_m smoothness gps_score"


@query("c9_gps_quality", QUALITY, QCOLS)
def _(t):
    return tr.gps_quality(fix_track(t)).drop("suggestions")


MATCH = f"""WITH s AS ({VALID}), b AS (SELECT f.mission_id, f.frame_num, f.timestamp_sec, s.ts_s AS tb, s.source_row AS rb FROM frames f ASOF LEFT JOIN s ON f.mission_id=s.mission_id AND f.timestamp_sec>s.ts_s),
 c AS (SELECT f.mission_id, f.frame_num, s.ts_s AS ta, s.source_row AS ra FROM frames f ASOF LEFT JOIN s ON f.mission_id=s.mission_id AND f.timestamp_sec<=s.ts_s),
 n AS (SELECT mission_id, frame_num, timestamp_sec, CASE WHEN ta IS NULL OR timestamp_sec-tb<=ta-timestamp_sec THEN tb ELSE ta END AS ts_s, CASE WHEN ta IS NULL OR timestamp_sec-tb<=ta-timestamp_sec THEN rb ELSE ra END AS source_row FROM b JOIN c USING (mission_id,frame_num))
 SELECT mission_id, frame_num, CASE WHEN abs(ts_s-timestamp_sec)<=1 THEN ts_s-timestamp_sec END AS dt_s, CASE WHEN abs(ts_s-timestamp_sec)<=1 THEN source_row END AS source_row FROM n"""
SYNC = f"""WITH m AS ({MATCH}), a AS (SELECT mission_id, count(dt_s) AS matched, count(*)-count(dt_s) AS unmatched, count(DISTINCT CASE WHEN dt_s IS NOT NULL THEN frame_num END) AS distinct_frames, quantile_cont(dt_s,.5) AS offset_s FROM m GROUP BY 1),
 g AS (SELECT mission_id, ts_s-lag(ts_s) OVER (PARTITION BY mission_id ORDER BY ts_s) AS gap FROM ({VALID})),
 h AS (SELECT mission_id, list_sort(list(gap))[len(list(gap))//2+1] AS spacing_s FROM g WHERE gap>0 GROUP BY 1)
 SELECT *, CASE WHEN matched=0 THEN 'no_overlap' ELSE 'overlap' END AS overlap, matched>=3 AND distinct_frames>=3 AND spacing_s IS NOT NULL AS sufficient FROM a LEFT JOIN h USING (mission_id)"""


@query("c10_nearest_sync", MATCH, "dt_s source_row")
def _(t):
    return tr.sync_frames(t.frames, valid(t)).select("mission_id", "frame_num", "dt_s", "source_row")


@query("c12_sync_sufficiency", SYNC, "offset_s spacing_s")
def _(t):
    v = valid(t)
    return tr.sufficient_track(tr.sync_report(tr.sync_frames(t.frames, v), v))


@query("flagship_track_report", f"""SELECT mission_id, points, path_length_m, gps_score, grade, matched, unmatched, offset_s, coalesce(sufficient,false) AS sufficient
 FROM ({QUALITY}) LEFT JOIN ({SYNC}) USING (mission_id)""", "path_length_m gps_score offset_s matched unmatched")
def _(t):
    v = valid(t)
    sync = tr.sufficient_track(tr.sync_report(tr.sync_frames(t.frames, v), v))
    return (
        tr.gps_quality(fix_track(t))
        .join(sync, "mission_id", "left")
        .select("mission_id", "points", "path_length_m", "gps_score", "grade", "matched", "unmatched", "offset_s", F.coalesce("sufficient", F.lit(False)).alias("sufficient"))
    )
