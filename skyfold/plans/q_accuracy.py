"""Registered queries: accuracy against references."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyfold.operators import accuracy as ac
from skyfold.plans.registry import query

NEAR = """n AS (SELECT a.mission_id, a.point_id, any_value(a.x) AS x, any_value(a.y) AS y, any_value(a.z) AS z, min({'d':pow(a.x-b.x,2)+pow(a.y-b.y,2)+pow(a.z-b.z,2),'i':b.point_id}) AS m FROM points a JOIN points b ON a.mission_id=b.mission_id AND a.epoch='current' AND b.epoch='baseline' GROUP BY 1,2),
 e AS (SELECT n.mission_id, n.point_id, n.x, n.y, n.z, sqrt(m.d) AS d, b.x AS rx, b.y AS ry, b.z AS rz, b.class FROM n JOIN points b ON b.mission_id=n.mission_id AND b.point_id=m.i)"""
STATS = lambda c, p="": f"count({c}) AS {p}n, avg({c}) AS {p}mean, sqrt(avg({c}*{c})) AS {p}rmse, max({c}) AS {p}max, quantile_cont({c},.5) AS {p}median, quantile_cont({c},.9) AS {p}p90, quantile_cont({c},.95) AS {p}p95"
SCOLS = "mean rmse max median p90 p95"


@query("g1_checkpoint_metrics", f"""SELECT mission_id, {STATS('err')}, sqrt(avg(h*h)) AS horizontal_rmse, sqrt(avg(v*v)) AS vertical_rmse, {', '.join(f'avg(CASE WHEN err<={w} THEN 1 ELSE 0 END) AS within_{int(w * 100)}cm' for w in ac.WITHIN)}
 FROM (SELECT mission_id, sqrt(pow(ex-x,2)+pow(ey-y,2)+pow(ez-z,2)) AS err, sqrt(pow(ex-x,2)+pow(ey-y,2)) AS h, abs(ez-z) AS v FROM gcp) GROUP BY 1""", SCOLS + " horizontal_rmse vertical_rmse within_25cm within_50cm within_100cm within_200cm within_500cm")
def _(t):
    return ac.checkpoint_metrics(t.gcp)


@query("g2_cloud_to_reference", f"""WITH {NEAR}, b AS (SELECT a.mission_id, a.point_id, min(sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)+pow(a.z-b.z,2))) AS d FROM points a JOIN points b ON a.mission_id=b.mission_id AND a.epoch='baseline' AND b.epoch='current' GROUP BY 1,2),
 bb AS (SELECT mission_id, min(x)-5 AS a, max(x)+5 AS b, min(y)-5 AS c, max(y)+5 AS d FROM points WHERE epoch='current' GROUP BY 1)
 SELECT * FROM (SELECT mission_id, {STATS('d', 'accuracy_')} FROM e GROUP BY 1) JOIN (SELECT mission_id, avg(CASE WHEN d<=1 THEN 1 ELSE 0 END) AS completeness_1m FROM b GROUP BY 1) USING (mission_id)
 JOIN (SELECT p.mission_id, 100*avg(CASE WHEN x BETWEEN a AND b AND y BETWEEN c AND d THEN 1 ELSE 0 END) AS bbox_share_pct FROM points p JOIN bb USING (mission_id) WHERE epoch='baseline' GROUP BY 1) USING (mission_id)""", " ".join("accuracy_" + c for c in SCOLS.split()) + " completeness_1m bbox_share_pct")
def _(t):
    return ac.cloud_to_reference(t.current, t.baseline)


@query("g3_error_decomposition", f"WITH {NEAR} SELECT mission_id, quantile_cont(sqrt(pow(x-rx,2)+pow(y-ry,2)),.5) AS horizontal_median, quantile_cont(abs(z-rz),.5) AS vertical_median, quantile_cont(z-rz,.5) AS signed_vertical_median FROM e GROUP BY 1", "horizontal_median vertical_median signed_vertical_median")
def _(t):
    return ac.error_decomposition(t.current, t.baseline)


@query("g3_error_by_height", f"""WITH {NEAR}, q AS (SELECT mission_id, quantile_cont(z,.25) AS a, quantile_cont(z,.5) AS b, quantile_cont(z,.75) AS c FROM e GROUP BY 1)
 SELECT mission_id, CAST(CASE WHEN z<=a THEN 0 WHEN z<=b THEN 1 WHEN z<=c THEN 2 ELSE 3 END AS INTEGER) AS band, count(*) AS points, CASE WHEN count(*)>=50 THEN quantile_cont(d,.5) END AS median FROM e JOIN q USING (mission_id) GROUP BY 1,2""", "median")
def _(t):
    return ac.error_by_height(t.current, t.baseline)


def by(part):
    return f"WITH {NEAR} SELECT mission_id, {part} AS part, count(*) AS n, CASE WHEN count(*)>=50 THEN quantile_cont(d,.5) END AS median, CASE WHEN count(*)>=50 THEN sqrt(avg(d*d)) END AS rmse, CASE WHEN count(*)>=50 THEN quantile_cont(d,.95) END AS p95 FROM e GROUP BY 1,2"


@query("g3_error_by_class", by("CAST(class AS VARCHAR)"), "median rmse p95")
def _(t):
    return ac.error_by_class(t.current, t.baseline)


@query("g4_accuracy_by_terrain", by("CASE WHEN class=2 THEN 'ground' ELSE 'rest' END"), "median rmse p95")
def _(t):
    return ac.error_by_class(t.current, t.baseline, ground_only=True)


@query("g6_camera_errors", "SELECT mission_id, count(*) FILTER (sx>30) AS common, sqrt(avg(CASE WHEN sx>30 THEN pow(sx-dx,2)+pow(sy-dy,2)+pow(sz-dz,2) END)/3) AS rmse, (count(*) FILTER (sx>30))*1.0e0/count(*) AS registration_rate FROM track GROUP BY 1", "rmse registration_rate")
def _(t):
    k = t.track
    gt = k.select("mission_id", "frame_id", *[F.col(f"d{a}").alias(a) for a in "xyz"])
    return ac.camera_errors(k.filter("sx > 30").select("mission_id", "frame_id", *[F.col(f"s{a}").alias(a) for a in "xyz"]), gt)


SPLIT = "SELECT * FROM gcp c WHERE role='check' AND NOT EXISTS (SELECT 1 FROM gcp k WHERE k.role='control' AND k.mission_id=c.mission_id AND k.id=c.id)"


@query("g7_check_split", f"SELECT mission_id, id, count(*) AS n FROM ({SPLIT}) GROUP BY 1,2")
def _(t):
    return ac.split_control(t.gcp).groupBy("mission_id", "id").agg(F.count(F.lit(1)).alias("n"))


@query("g8_check_errors", f"SELECT mission_id, {STATS('err')} FROM (SELECT mission_id, sqrt(pow(ex-x,2)+pow(ey-y,2)+pow(ez-z,2)) AS err FROM ({SPLIT})) GROUP BY 1", SCOLS)
def _(t):
    return ac.check_errors(ac.split_control(t.gcp))


@query("g9_distance_errors", """SELECT mission_id, avg(e) AS mae, sqrt(avg(e*e)) AS rmse, max(e) AS max, avg(e/distance_m*100) AS mean_pct, quantile_cont(e,.5) AS median FROM (SELECT mission_id, distance_m, abs(sqrt(pow(x-y,2)+pow(y-z,2)+pow(z-x,2))-distance_m) AS e FROM gcp) GROUP BY 1""", "mae rmse max mean_pct median")
def _(t):
    return ac.distance_errors(t.gcp.select("mission_id", F.array("x", "y", "z").alias("a"), F.array("y", "z", "x").alias("b"), "distance_m"))


@query("g10_depth_error", """WITH j AS (SELECT mission_id, z*2+(u%5)*0.1e0 AS p, z AS t FROM depth_px), m AS (SELECT mission_id, quantile_cont(p,.5) AS mp, quantile_cont(t,.5) AS mt FROM j GROUP BY 1)
 SELECT mission_id, count(*) AS pixels, avg(abs(p*(mt/mp)-t)) AS mae, sqrt(avg(pow(p*(mt/mp)-t,2))) AS rmse FROM j JOIN m USING (mission_id) GROUP BY 1""", "mae rmse")
def _(t):
    d = t.depth_px
    return ac.depth_error(d.withColumn("z", F.col("z") * 2 + F.col("u") % 5 * F.lit(0.1)), d)


STEP = """s AS (SELECT mission_id, sqrt(pow(sx-lag(sx) OVER w,2)+pow(sy-lag(sy) OVER w,2)+pow(sz-lag(sz) OVER w,2)) AS ls, sqrt(pow(dx-lag(dx) OVER w,2)+pow(dy-lag(dy) OVER w,2)+pow(dz-lag(dz) OVER w,2)) AS ld FROM track WINDOW w AS (PARTITION BY mission_id ORDER BY frame_id))"""


@query("g11_scale_error", f"WITH {STEP} SELECT mission_id, quantile_cont(abs(ls-ld)/ld,.5) AS p50, quantile_cont(abs(ls-ld)/ld,.9) AS p90, quantile_cont(abs(ls-ld)/ld,.95) AS p95 FROM s WHERE ld>0 GROUP BY 1", "p50 p90 p95")
def _(t):
    return ac.scale_error(t.track)


@query("g11_absolute_trajectory_error")
def _(t):
    return ac.ate(t.track)


@query("g12_path_scale", f"WITH {STEP} SELECT mission_id, coalesce(sum(ls),0) AS reconstructed_m, coalesce(sum(ld),0) AS reference_m, abs(sum(ls)-sum(ld))/sum(ld) AS scale_error, sum(ls)/sum(ld) AS scale_factor FROM s GROUP BY 1", "reconstructed_m reference_m scale_error scale_factor")
def _(t):
    return ac.path_scale(t.track)


@query("g12_registration")
def _(t):
    return ac.registration(t.track)


@query("g13_certification", """SELECT o_orderkey AS id, CASE WHEN o_orderkey%7=0 THEN 'no independent reference' WHEN o_orderkey%5=0 THEN 'insufficient georeferencing' WHEN o_orderkey%60>30 OR o_orderkey%40>25 THEN 'above 1 m' WHEN o_orderkey%100<80 THEN 'coverage limited' ELSE 'certified' END AS certification FROM orders""")
def _(t):
    o = F.col("o_orderkey")
    s = t.raw("orders").select(o.alias("id"), (o % 7 != 0).alias("has_reference"), (o % 5 != 0).alias("sufficient"), (o % 60 / 30.0).alias("rmse"), (o % 40 / 25.0).alias("p95"), (o % 100 * 1.0).alias("coverage_pct"))
    return ac.certify(s).select("id", "certification")


@query("g14_capability", """SELECT o_orderkey AS id, CASE WHEN o_orderkey%3=0 AND o_orderkey%2=0 THEN 'METRIC_VALIDATED' WHEN o_orderkey%5=0 THEN 'GPS_GEOREFERENCED' WHEN o_orderkey%4>0 THEN 'SCALED' WHEN o_orderkey%8=0 THEN 'RELATIVE_ONLY' ELSE 'NOT_MEASURED' END AS capability FROM orders""")
def _(t):
    o = F.col("o_orderkey")
    s = t.raw("orders").select(o.alias("id"), (o % 3 == 0).alias("reference_validated"), (o % 2 == 0).alias("has_reference"), (o % 5 == 0).alias("georeferenced"), (1 + o % 4 * 0.1).alias("scale_factor"), (o % 8 == 0).alias("relative_measured"))
    return ac.capability(s).select("id", "capability")


def _reports(t):
    o = F.col("o_orderkey")
    j = lambda **kv: F.to_json(F.struct(*[v.alias(k) for k, v in kv.items()]))
    px = o % 40 / 10.0
    return t.raw("orders").select(
        o.alias("mission_id"),
        F.when(o % 3 == 0, j(reprojection=F.struct(px.alias("median_px")))).when(o % 3 == 1, j(median_reprojection_error=px)).otherwise(j(mean_reproj_error=px)).alias("sparse"),
        F.when(o % 2 == 0, j(cross_view=F.struct((o % 50 / 10.0).alias("median_m")))).otherwise(j(cross_view_disagreement_median_m=o % 50 / 10.0)).alias("dense"),
    )


REL = "SELECT o_orderkey AS mission_id, (o_orderkey%40)/10.0e0 AS reprojection_median, (o_orderkey%50)/10.0e0 AS cross_view_median, CAST(NULL AS DOUBLE) AS sparse_dense_median, CASE WHEN o_orderkey%3=0 THEN 'nested' ELSE 'flat' END AS source FROM orders"


@query("g15_relative_consistency", REL, "reprojection_median cross_view_median sparse_dense_median")
def _(t):
    return ac.relative_consistency(_reports(t))


@query("g16_internal_checks", f"""WITH r AS ({REL}) SELECT mission_id, name, unit, criterion, value, value IS NOT NULL AS measured, CASE WHEN value<=criterion THEN 'yes' WHEN value>criterion THEN 'no' END AS passed FROM r, LATERAL (VALUES ('reprojection_median','px',2.0e0,reprojection_median),('cross_view_median','m',2.0e0,cross_view_median),('sparse_dense_median','m',2.0e0,sparse_dense_median),('trajectory_fit_median','m',5.0e0,(mission_id%9)*1.0e0),('scale_error_pct','%',1.0e0,CAST(NULL AS DOUBLE))) x(name,unit,criterion,value)""", "criterion value")
def _(t):
    r = ac.relative_consistency(_reports(t)).withColumn("trajectory_fit_median", F.col("mission_id") % 9 * F.lit(1.0)).withColumn("scale_error_pct", F.lit(None).cast("double"))
    c = ac.internal_checks(r)
    return c.withColumn("passed", F.when(F.col("passed"), "yes").when(~F.col("passed"), "no"))
