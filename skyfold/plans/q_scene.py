"""Registered queries: views, scene objects, terrain risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyfold.operators import scene as sc, views as vi
from skyfold.operators.concepts import SYNONYMS
from skyfold.plans.registry import query


def poses(t):
    r = F.array(*[F.lit(x) for x in (1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, -1.0)])
    return t.poses.select("*", r.alias("r"), F.lit(60.0).alias("f"), F.lit(64).alias("width"), F.lit(64).alias("height"))


def observations(t):
    return t.raw("lineitem").select((F.col("l_suppkey") % 8).alias("mission_id"), (F.col("l_partkey") * 8 + F.col("l_suppkey") % 8).alias("point_id"), F.col("l_suppkey").alias("frame_id")).distinct()


OBS = "obs AS (SELECT DISTINCT l_suppkey%8 AS mission_id, l_partkey*8+l_suppkey%8 AS point_id, l_suppkey AS frame_id FROM lineitem), sp AS (SELECT DISTINCT mission_id, point_id, (point_id%50)*1.0e0 AS x, (point_id*7%50)*1.0e0 AS y, (point_id%6)*0.5e0 AS z FROM obs)"


def sparse(t):
    p = F.col("point_id")
    return observations(t).select("mission_id", "point_id").distinct().select("mission_id", "point_id", (p % 50 * F.lit(1.0)).alias("x"), (p * 7 % 50 * F.lit(1.0)).alias("y"), (p % 6 * F.lit(0.5)).alias("z"))


@query("e16_layers")
def _(t):
    return vi.detect_layers(t.points, 0.2)


@query("e17_layer_origin", "SELECT o_orderkey AS id, CASE WHEN o_orderkey%20>=5 AND o_custkey%15>=5 THEN 'A' WHEN o_orderkey%20>=5 THEN 'B' WHEN o_custkey%15>=5 THEN 'C' ELSE 'D' END AS origin FROM orders")
def _(t):
    return t.raw("orders").select(F.col("o_orderkey").alias("id"), vi.layer_origin(F.col("o_orderkey") % 20, F.col("o_custkey") % 15).alias("origin"))


@query("e18_camera_range", "SELECT p.mission_id, p.point_id, min(sqrt(pow(x-cx,2)+pow(y-cy,2)+pow(z-cz,2))) AS range_m, greatest(0.08e0*min(sqrt(pow(x-cx,2)+pow(y-cy,2)+pow(z-cz,2))),0.5e0) AS budget_m FROM points p JOIN poses c ON c.mission_id=p.mission_id GROUP BY 1,2", "range_m budget_m")
def _(t):
    return vi.min_camera_range(t.points, poses(t))


@query("e19_unproject", """SELECT d.mission_id, d.frame_id, u, v, cx+(u+0.5-32)*z/60 AS x, cy-(v+0.5-32)*z/60 AS y, cz-z AS z, greatest(0.05e0,least(1,exp(-(z*z/60*0.5e0)/0.5e0))) AS confidence FROM depth_px d JOIN poses c ON c.frame_id=d.frame_id AND c.mission_id=d.mission_id""", "x y z confidence")
def _(t):
    return vi.unproject(t.depth_px, poses(t))


SEEN = """SELECT q.mission_id, q.epoch, q.point_id, q.frame_id, q.range_m, cz-z AS zc, CASE WHEN u BETWEEN 0 AND 63 AND v BETWEEN 0 AND 63 THEN u END AS u, CASE WHEN u BETWEEN 0 AND 63 AND v BETWEEN 0 AND 63 THEN v END AS v FROM
 (SELECT *, CAST(floor(60.0e0*(x-cx)/(cz-z)+32) AS BIGINT) AS u, CAST(floor(60.0e0*(-(y-cy))/(cz-z)+32) AS BIGINT) AS v FROM (SELECT p.mission_id, p.epoch, p.point_id, x, y, z, cx, cy, cz, frame_id, sqrt(pow(x-cx,2)+pow(y-cy,2)+pow(z-cz,2)) AS range_m,
 row_number() OVER (PARTITION BY p.point_id ORDER BY pow(x-cx,2)+pow(y-cy,2)+pow(z-cz,2), frame_id) AS rk FROM points p JOIN poses c ON c.mission_id=p.mission_id) WHERE rk<=8) q"""
EVID = f"""WITH s AS ({SEEN}), e AS (SELECT s.*, d.z AS zd, greatest(0.08e0*min(range_m) OVER (PARTITION BY s.point_id),0.5e0) AS budget, d.z-zc AS gap FROM s LEFT JOIN depth_px d ON d.mission_id=s.mission_id AND d.frame_id=s.frame_id AND d.u=s.u AND d.v=s.v),
 ev AS (SELECT mission_id, epoch, point_id, count(zd) AS observable, count(*) FILTER (abs(gap)<=budget) AS agree, count(*) FILTER (gap>budget) AS behind, count(*) FILTER (gap<-budget) AS closer, coalesce(max(-gap),0) AS max_shortfall, min(range_m) AS min_range FROM e GROUP BY 1,2,3)"""


@query("e20_cross_view_evidence", f"{EVID} SELECT * FROM ev", "max_shortfall min_range")
def _(t):
    return vi.cross_view_evidence(t.points, poses(t), t.depth_px, also=("epoch",))


@query("e21_cross_view_summary", f"{EVID} SELECT mission_id, epoch, count(*) AS points, count(*) FILTER (observable=0) AS unobservable, count(*) FILTER (agree>=1) AS corroborated, count(*) FILTER (closer>=1 AND agree<=0) AS contradicted, 100*avg(CASE WHEN agree>=1 THEN 1 ELSE 0 END) AS corroborated_pct FROM ev GROUP BY 1,2", "corroborated_pct")
def _(t):
    return vi.cross_view_summary(vi.cross_view_evidence(t.points, poses(t), t.depth_px, also=("epoch",)), ["mission_id", "epoch"])


@query("e22_sparse_dense")
def _(t):
    return vi.sparse_dense(sparse(t), t.points)


@query("e24_depth_pair_check", "SELECT mission_id, frame_id AS pair_id, quantile_cont(r,.5) AS median_rel, quantile_cont(r,.95) AS p95_rel, count(*) AS pixels, count(*)>=100 AND quantile_cont(r,.5)<=0.35 AND quantile_cont(r,.95)<=1 AS passed FROM (SELECT *, abs(z+(u%7)*0.5e0-z)/z AS r FROM depth_px) GROUP BY 1,2", "median_rel p95_rel")
def _(t):
    d = t.depth_px.withColumnRenamed("frame_id", "pair_id")
    return vi.depth_pair_check(d.withColumn("z", F.col("z") + F.col("u") % 7 * F.lit(0.5)), d)


@query("e25_inverse_depth_fit")
def _(t):
    return vi.fit_inverse_depth(t.depth_px.withColumn("d", 100.0 - F.col("z")))


@query("e26_fit_report")
def _(t):
    return vi.fit_report(vi.fit_inverse_depth(t.depth_px.withColumn("d", 100.0 - F.col("z"))))


@query("e28_depth_ceiling", "SELECT mission_id, greatest(50,1.1e0*quantile_cont(z,.995)) AS ceiling FROM depth_px GROUP BY 1", "ceiling")
def _(t):
    return vi.depth_ceiling(t.depth_px, 50.0)


COND = f"""WITH {OBS}, c AS (SELECT o.mission_id, o.point_id, o.frame_id, x-cx AS dx, y-cy AS dy, z-cz AS dz FROM obs o JOIN sp USING (mission_id,point_id) JOIN poses p ON p.mission_id=o.mission_id AND p.frame_id=o.frame_id),
 q AS (SELECT a.mission_id, a.point_id, sqrt(pow(a.dx-b.dx,2)+pow(a.dy-b.dy,2)+pow(a.dz-b.dz,2)) AS base, sqrt(a.dx*a.dx+a.dy*a.dy+a.dz*a.dz) AS la, sqrt(b.dx*b.dx+b.dy*b.dy+b.dz*b.dz) AS lb, a.dx*b.dx+a.dy*b.dy+a.dz*b.dz AS dot FROM c a JOIN c b ON a.mission_id=b.mission_id AND a.point_id=b.point_id AND a.frame_id<b.frame_id)
 SELECT mission_id, point_id, coalesce(min(base),0) AS min_baseline, min(CASE WHEN dot IS NOT NULL THEN degrees(acos(greatest(-1,least(1,dot/(la*lb))))) END) AS min_ray_angle_deg, min(least(la,lb)) AS depth, coalesce(min(base)>=0.05e0*min(least(la,lb)),false) AS conditioned FROM (SELECT DISTINCT mission_id, point_id FROM c) LEFT JOIN q USING (mission_id,point_id) GROUP BY 1,2"""


@query("e29_point_conditioning", COND, "min_baseline min_ray_angle_deg depth", 4)
def _(t):
    return vi.conditioned_points(observations(t), sparse(t), poses(t))


@query("e30_view_probe")
def _(t):
    return vi.probe_views(sparse(t), observations(t), poses(t))


@query("e31_track_stats", f"WITH {OBS}, n AS (SELECT mission_id, point_id, count(*) AS n FROM obs GROUP BY 1,2) SELECT mission_id, count(*) AS points, avg(n) AS mean_length, " + ", ".join(f"avg(CASE WHEN n={i} THEN 1 ELSE 0 END) AS share_{i}" for i in (2, 3, 4, 5)) + ", avg(CASE WHEN n>=6 THEN 1 ELSE 0 END) AS share_6plus, quantile_cont(n,.5) AS median_length, quantile_cont(n,.9) AS p90_length FROM n GROUP BY 1", "mean_length share_2 share_3 share_4 share_5 share_6plus median_length p90_length")
def _(t):
    return vi.track_stats(observations(t))


@query("e32_reprojection_summary", "SELECT mission_id, avg(residual) AS mean, max(residual) AS max, count(*) AS n, quantile_cont(residual,.5) AS median, quantile_cont(residual,.95) AS p95 FROM points GROUP BY 1", "mean max median p95")
def _(t):
    return vi.reprojection_summary(t.points)


@query("e33_detection_positions", """SELECT b.mission_id, b.frame_id, det, cx+(d.u+0.5-32)*d.z/60 AS x, cy-(d.v+0.5-32)*d.z/60 AS y, cz-d.z AS z FROM (SELECT mission_id, frame_id, o_orderkey AS det, o_orderkey%60 AS u0, o_custkey%60 AS v0 FROM orders JOIN poses ON frame_id=o_custkey%100) b
 LEFT JOIN depth_px d ON d.mission_id=b.mission_id AND d.frame_id=b.frame_id AND d.u=u0+2 AND d.v=v0+2 LEFT JOIN poses p ON p.frame_id=b.frame_id""", "x y z")
def _(t):
    o = t.raw("orders").select((F.col("o_custkey") % 100).alias("frame_id"), F.col("o_orderkey").alias("det"), (F.col("o_orderkey") % 60).alias("u0"), (F.col("o_custkey") % 60).alias("v0"))
    d = o.join(t.poses.select("mission_id", "frame_id"), "frame_id").select("mission_id", "frame_id", "det", "u0", (F.col("u0") + 4).alias("u1"), "v0", (F.col("v0") + 4).alias("v1"))
    return vi.locate_detections(d, t.depth_px, poses(t)).select("mission_id", "frame_id", "det", "x", "y", "z")


@query("e35_depth_fusion", """WITH p AS (SELECT d.mission_id, d.frame_id, u, v, cx+(u+0.5-32)*z/60 AS x, cy-(v+0.5-32)*z/60 AS y, cz-z AS z, greatest(0.05e0,least(1,exp(-(z*z/60*0.5e0)/2.0e0))) AS c FROM depth_px d JOIN poses k ON k.frame_id=d.frame_id AND k.mission_id=d.mission_id WHERE z>0),
 g AS (SELECT mission_id, CAST(floor(x/2.0e0) AS BIGINT) AS vx, CAST(floor(y/2.0e0) AS BIGINT) AS vy, CAST(floor(z/2.0e0) AS BIGINT) AS vz, sum(x*c)/sum(c) AS x, sum(y*c)/sum(c) AS y, sum(z*c)/sum(c) AS z, avg(c) AS confidence, count(*) AS observations, min({'c':-c,'f':frame_id,'u':u,'v':v}) AS s FROM p GROUP BY 1,2,3,4)
 SELECT mission_id, vx, vy, vz, x, y, z, confidence, observations, s.f AS frame_id, s.u AS u, s.v AS v, confidence*observations AS fusion_weight FROM g""", "x y z confidence fusion_weight")
def _(t):
    return vi.fuse_depth(t.depth_px, poses(t), 2.0)


@query("e36_ghost_rejection", f"{EVID} SELECT mission_id, epoch, count(*) AS kept FROM ev WHERE NOT (closer>=1 AND agree<=0) GROUP BY 1,2")
def _(t):
    return vi.reject_ghosts(t.points, poses(t), t.depth_px).groupBy("mission_id", "epoch").agg(F.count(F.lit(1)).alias("kept"))


@query("e37_depth_audit", "SELECT mission_id, frame_id, count(*) AS pixels, count(*) FILTER (z<0) AS negative, count(*) FILTER (z IS NULL) AS non_finite, min(z) AS z_min, max(z) AS z_max, avg(z) AS z_mean, stddev_pop(z) AS z_std, count(*) AS valid, quantile_cont(z,.5) AS z_median, 0.0e0 AS invalid_pct FROM depth_px GROUP BY 1,2", "z_min z_max z_mean z_std z_median invalid_pct")
def _(t):
    return vi.depth_stats(t.depth_px)


@query("j3_objects")
def _(t):
    return sc.extract_objects(t.vertices, t.faces, 2)


@query("j2_face_classes")
def _(t):
    return sc.class_coverage(sc.classify_faces(t.vertices, t.faces))


@query("j4_scene_graph", """WITH o AS (SELECT *, greatest(x1-x0,y1-y0,z1-z0) AS dim FROM objects), j AS (SELECT a.mission_id, a.object_id AS src, b.object_id AS dst, greatest(b.x0-a.x1,a.x0-b.x1,b.y0-a.y1,a.y0-b.y1,b.z0-a.z1,a.z0-b.z1,0) AS gap_m,
 greatest(0,least(a.z1,b.z1)-greatest(a.z0,b.z0)) AS overlap_m, greatest(a.dim,b.dim) AS m, [a.class,b.class] AS c FROM o a JOIN o b ON a.mission_id=b.mission_id AND a.object_id<b.object_id)
 SELECT mission_id, src, dst, gap_m, overlap_m, CASE WHEN c IN (['roof','wall'],['wall','roof']) THEN 'supports' WHEN c IN (['roof','structure'],['structure','roof'],['wall','structure'],['structure','wall']) THEN 'part_of'
 WHEN c IN (['structure','vegetation'],['vegetation','structure']) THEN 'adjacent' WHEN overlap_m>0 THEN 'touches' ELSE 'near' END AS relation FROM j WHERE gap_m<=0.2e0*m""", "gap_m overlap_m")
def _(t):
    return sc.scene_graph(t.objects)


FACES = """SELECT mission_id, class, object_id//4 AS component, (x0+x1)/2 AS x, (y0+y1)/2 AS y, (z0+z1)/2 AS z, area*4 AS area, (z0+z1)/2 AS height FROM objects"""


def surfaces(t):
    """Each object as one face; four neighbours in number form a connected surface."""
    mid = [((F.col(f"{a}0") + F.col(f"{a}1")) / 2).alias(a) for a in "xyz"]
    return t.objects.select("mission_id", "class", F.floor(F.col("object_id") / 4).alias("component"), *mid, (F.col("area") * 4).alias("area"), ((F.col("z0") + F.col("z1")) / 2).alias("height"))


@query("j5_flood", f"""WITH f AS ({FACES}), s AS (SELECT mission_id, component, sum(area) AS area FROM f WHERE class='water' GROUP BY 1,2 HAVING sum(area)>=8), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY mission_id ORDER BY area DESC, component)=1),
 n AS (SELECT w.mission_id, min(sqrt(pow(w.x-m.x,2)+pow(w.y-m.y,2)+pow(w.z-m.z,2))) AS d FROM f w JOIN b USING (mission_id,component) JOIN f m ON m.mission_id=w.mission_id AND w.class='water' AND m.class IN ('roof','wall','structure','vehicle') GROUP BY 1),
 r AS (SELECT b.mission_id, b.area, b.area/al AS share, coalesce(d<25,false) AS near FROM b JOIN (SELECT mission_id, sum(area) AS al FROM f GROUP BY 1) USING (mission_id) LEFT JOIN n USING (mission_id))
 SELECT *, CASE WHEN area>800 OR share>0.2 THEN 'Critical' WHEN area>200 OR (share>0.05 AND near) THEN 'High' WHEN area>8 OR near THEN 'Medium' ELSE 'Low' END AS severity, 0.6e0+0.35e0*least(area/400,1) AS confidence FROM r""", "area share confidence")
def _(t):
    return sc.assess_flood(surfaces(t))


DEBRIS = f"""WITH f AS ({FACES}), p AS (SELECT mission_id, component, sum(area) AS area, sum(x) AS x, sum(y) AS y, sum(z) AS z, count(*) AS n FROM f WHERE class IN ('structure','unclassified','wall') AND height>0.3 AND height<3 GROUP BY 1,2),
 o AS (SELECT mission_id, count(*) FILTER (area>=4) AS fragments, sum(area) FILTER (area>=4) AS area, sum(x)/sum(n) AS x, sum(y)/sum(n) AS y, sum(z)/sum(n) AS z FROM p GROUP BY 1 HAVING count(*) FILTER (area>=4)>0),
 debris AS (SELECT o.*, area/al AS share, CASE WHEN fragments>=12 THEN 'High' WHEN area>800 OR area/al>0.2 THEN 'Critical' WHEN area>200 THEN 'High' WHEN area>8 THEN 'Medium' ELSE 'Low' END AS severity, 0.5e0+0.4e0*least(fragments/15,1) AS confidence FROM o JOIN (SELECT mission_id, sum(area) AS al FROM f GROUP BY 1) USING (mission_id))"""


@query("j6_debris", f"{DEBRIS} SELECT * FROM debris", "area share x y z confidence")
def _(t):
    return sc.assess_debris(surfaces(t))


@query("j7_collapse", """SELECT d.mission_id, d.object_id AS debris_id, min(s.object_id) AS structure_id, 'High' AS severity, least(0.85e0, min(d.confidence)+0.15e0) AS confidence FROM objects d JOIN objects s ON s.mission_id=d.mission_id AND s.class IN ('structure','roof','wall') AND s.confidence>=0.3 AND d.class='unclassified'
 AND d.x0 BETWEEN s.x0-12 AND s.x1+12 AND d.y0 BETWEEN s.y0-12 AND s.y1+12 AND d.z1*3 BETWEEN s.z0-12 AND s.z1+12 GROUP BY 1,2""", "confidence")
def _(t):
    d = t.objects.filter("class = 'unclassified'").select("mission_id", F.col("object_id").alias("debris_id"), F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("z1") * 3).alias("z"), F.lit("High").alias("severity"), "confidence")
    return sc.assess_collapse(d, t.objects)


@query("j8_severity_counts", """SELECT mission_id, count(*) FILTER (s='Low') AS low, count(*) FILTER (s='Medium') AS medium, count(*) FILTER (s='High') AS high, count(*) FILTER (s='Critical') AS critical FROM (SELECT mission_id, CASE WHEN area*20>800 OR confidence/4>0.2 THEN 'Critical' WHEN area*20>200 OR (confidence/4>0.05 AND object_id%2=0) THEN 'High' WHEN area*20>8 OR object_id%2=0 THEN 'Medium' ELSE 'Low' END AS s FROM objects) GROUP BY 1""")
def _(t):
    return sc.severity_counts(t.objects.withColumn("severity", sc.severity(F.col("area") * 20, F.col("confidence") / 4, F.col("object_id") % 2 == 0)))


# The plane of least squares through the lowest tenth: its normal is the vector of the least eigenvalue of the covariance, here in closed form.
LOWEST = """lv AS (SELECT CAST(floor(vid/500) AS BIGINT) AS mission_id, x, y, z FROM vertices), lk AS (SELECT mission_id, least(count(*), greatest(20, floor(count(*)/10))) AS k FROM lv GROUP BY 1),
 lr AS (SELECT *, rank() OVER (PARTITION BY mission_id ORDER BY z) AS rk FROM lv), c AS (SELECT mission_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, var_pop(x) AS a, covar_pop(x,y) AS b, covar_pop(x,z) AS c, var_pop(y) AS d, covar_pop(y,z) AS e, var_pop(z) AS f FROM lr JOIN lk USING (mission_id) WHERE rk<=k GROUP BY 1),
 q AS (SELECT *, (a+d+f)/3 AS q FROM c), p AS (SELECT *, sqrt((pow(a-q,2)+pow(d-q,2)+pow(f-q,2)+2*(b*b+c*c+e*e))/6) AS p FROM q),
 l AS (SELECT *, q+2*p*cos(acos(greatest(-1,least(1,((a-q)*((d-q)*(f-q)-e*e)-b*(b*(f-q)-e*c)+c*(b*e-(d-q)*c))/(2*p*p*p))))/3+2*pi()/3) AS w FROM p),
 n AS (SELECT *, b*e-c*(d-w) AS n0, c*b-(a-w)*e AS n1, (a-w)*(d-w)-b*b AS n2 FROM l),
 plane AS (SELECT mission_id, s*n0 AS gx, s*n1 AS gy, s*n2 AS gz, -s*(n0*mx+n1*my+n2*mz) AS gd FROM (SELECT *, (CASE WHEN n2<0 THEN -1 ELSE 1 END)/sqrt(n0*n0+n1*n1+n2*n2) AS s FROM n))"""


@query("j9_infrastructure", f"""WITH {LOWEST}, o AS (SELECT *, (x0+x1)/2 AS x, (y0+y1)/2 AS y, (z0+z1)/2 AS z, greatest(x1-x0,y1-y0) AS wide, class IN ('structure','roof','wall') AS b, class IN ('tower','structure') AS t FROM objects),
 h AS (SELECT *, over>=1 AND class='vegetation' AS tr FROM (SELECT o.*, gx*x+gy*y+gz*z+gd AS over FROM o LEFT JOIN plane USING (mission_id))),
 g AS (SELECT u.mission_id, min(sqrt(pow(u.x-v.x,2)+pow(u.y-v.y,2)+pow(u.z-v.z,2))) AS min_tower_gap FROM o u JOIN o v ON u.mission_id=v.mission_id AND u.object_id<>v.object_id WHERE u.t AND v.t GROUP BY 1),
 s AS (SELECT mission_id, count(*) FILTER (b) AS buildings, max(height) FILTER (b) AS max_building_height, sum(area) FILTER (class='roof') AS roof_area, max(area) FILTER (b) AS largest_footprint,
 count(*) FILTER (tr) AS trees, avg(over) FILTER (tr) AS mean_tree_height, max(over) FILTER (tr) AS max_tree_height, min(height) FILTER (t) AS min_tower_height, count(*) FILTER (class='road') AS roads,
 count(*) FILTER (class='vehicle') AS vehicles, quantile_cont(wide,.5) FILTER (class='road' AND wide>0) AS road_width FROM h GROUP BY 1)
 SELECT * FROM s LEFT JOIN g USING (mission_id)""", "max_building_height roof_area largest_footprint mean_tree_height max_tree_height min_tower_height min_tower_gap road_width")
def _(t):
    v = t.vertices.select(F.floor(F.col("vid") / 500).alias("mission_id"), "x", "y", "z")
    return sc.infrastructure(t.objects, sc.lowest_plane(v))


def ground_findings(t, kind):
    """The objects of a class, laid on the ground of the point clouds."""
    i = F.col("object_id")
    return t.objects.filter(F.col("class") == kind).select((i % 8).alias("mission_id"), (i % 47 * F.lit(1.1)).alias("x"), (i * 7 % 53 * F.lit(0.9)).alias("y"), "area")


SLOPES = """sg AS (SELECT mission_id, CAST(floor(x/{s}e0) AS BIGINT) AS ix, CAST(floor(y/{s}e0) AS BIGINT) AS iy, avg(z) AS z FROM {src} GROUP BY 1,2,3),
 sd AS (SELECT c.mission_id, c.ix, c.iy, c.z, a.z AS xn, b.z AS xp, d.z AS yn, e.z AS yp FROM sg c LEFT JOIN sg a ON a.mission_id=c.mission_id AND a.ix=c.ix+1 AND a.iy=c.iy LEFT JOIN sg b ON b.mission_id=c.mission_id AND b.ix=c.ix-1 AND b.iy=c.iy LEFT JOIN sg d ON d.mission_id=c.mission_id AND d.ix=c.ix AND d.iy=c.iy+1 LEFT JOIN sg e ON e.mission_id=c.mission_id AND e.ix=c.ix AND e.iy=c.iy-1),
 slopes AS (SELECT mission_id, ix, iy, z, degrees(atan(sqrt(pow(CASE WHEN xn IS NOT NULL AND xp IS NOT NULL THEN (xn-xp)/(2*{s}e0) ELSE coalesce((xn-z)/{s}e0,(z-xp)/{s}e0,0) END,2)+pow(CASE WHEN yn IS NOT NULL AND yp IS NOT NULL THEN (yn-yp)/(2*{s}e0) ELSE coalesce((yn-z)/{s}e0,(z-yp)/{s}e0,0) END,2)))) AS slope_deg FROM sd)"""


@query("f13_slope_grid", f"WITH {SLOPES.format(s=2.0, src='points')} SELECT * FROM slopes", "z slope_deg")
def _(t):
    return sc.slope_grid(t.points, 2.0)


@query("f15_risk_zones")
def _(t):
    grid = sc.slope_grid(t.points, 2.0)
    return sc.risk_zones(sc.cell_causes(grid, ground_findings(t, "water"), ground_findings(t, "unclassified"), 2.0, 1.5, 1.5), 2.0)


@query("f19_coverage_raster", """SELECT mission_id, CAST(trunc((x-lx)/sx*47) AS BIGINT) AS ix, CAST(trunc((y-ly)/sy*47) AS BIGINT) AS iy, avg(conf) AS confidence, avg(conf)<0.4 AS blind FROM vertices JOIN (SELECT mission_id, min(x) AS lx, min(y) AS ly, greatest(max(x)-min(x),1e-9) AS sx, greatest(max(y)-min(y),1e-9) AS sy FROM vertices GROUP BY 1) USING (mission_id) GROUP BY 1,2,3""", "confidence")
def _(t):
    return sc.coverage_raster(t.vertices)


NEAR_VERTEX = "SELECT v.mission_id, v.vid, min({'d':sqrt(pow(v.x-p.x,2)+pow(v.y-p.y,2)+pow(v.z-p.z,2)),'id':p.point_id,'c':p.confidence}) AS n FROM (SELECT vid%8 AS mission_id, vid, x, y, z FROM vertices) v JOIN points p ON p.mission_id=v.mission_id GROUP BY 1,2"


@query("i10_mesh_support", f"SELECT mission_id, count(*) AS vertices, 100*avg(CASE WHEN n.d<=1 THEN 1 ELSE 0 END) AS supported_pct, quantile_cont(n.d,.5) AS median_m, quantile_cont(n.d,.95) AS p95_m FROM ({NEAR_VERTEX}) GROUP BY 1", "supported_pct median_m p95_m")
def _(t):
    v = t.vertices.select((F.col("vid") % 8).alias("mission_id"), "vid", "x", F.col("y"), "z")
    return sc.mesh_support(v, t.points, 1.0)


@query("f14_exposure", """WITH c AS (SELECT DISTINCT mission_id, CAST(floor(x/2.0e0) AS BIGINT) AS ix, CAST(floor(y/2.0e0) AS BIGINT) AS iy FROM points), f AS (SELECT object_id%8 AS mission_id, (object_id%47)*1.1e0 AS x, (object_id*7%53)*0.9e0 AS y, area FROM objects WHERE class='water')
 SELECT c.mission_id, ix, iy, bool_or(coalesce(sqrt(pow((ix+0.5e0)*2-x,2)+pow((iy+0.5e0)*2-y,2))<=sqrt(greatest(area,1)/3.141592653589793e0)+1.5e0,false)) AS exposed FROM c LEFT JOIN f ON f.mission_id=c.mission_id GROUP BY 1,2,3""")
def _(t):
    c = t.points.select("mission_id", F.floor(F.col("x") / 2).alias("ix"), F.floor(F.col("y") / 2).alias("iy")).distinct()
    return sc.exposure(c, ground_findings(t, "water"), 2.0, 1.5)


@query("f20_terrain_stats", "SELECT mission_id, max(z) AS z_max, avg(z) AS z_mean, quantile_cont(z,.1) AS z_p10, max(z)-quantile_cont(z,.1) AS elevation_range FROM vertices GROUP BY 1", "z_max z_mean z_p10 elevation_range")
def _(t):
    return sc.terrain_stats(t.vertices)


CONCEPT_WORDS = """(VALUES ('building','building'),('buildings','building'),('house','building'),('homes','building'),('structure','structure'),('structures','structure'),('roof','roof'),('roofs','roof'),('wall','wall'),('walls','wall'),
 ('bridge','bridge'),('bridges','bridge'),('tower','tower'),('towers','tower'),('pylon','tower'),('powerline','powerline'),('powerlines','powerline'),('road','road'),('roads','road'),('street','road'),
 ('streets','road'),('path','road'),('vehicle','vehicle'),('vehicles','vehicle'),('truck','vehicle'),('trucks','vehicle'),('car','car'),('cars','car'),('water','water'),('pond','water'),
 ('lake','water'),('river','water'),('flood','flood'),('flooding','flood'),('vegetation','vegetation'),('tree','tree'),('trees','tree'),('forest','tree'),('canopy','canopy'),('debris','debris'),
 ('rubble','debris'),('rubbish','debris'),('landslide','landslide'),('landslides','landslide'),('mudslide','landslide'),('ground','ground'),('field','ground'),('terrain','terrain')) w(word,concept)"""
CONCEPT_CLASS = """(VALUES ('building','roof'),('building','wall'),('building','structure'),('structure','structure'),('structure','roof'),('structure','wall'),('road','ground'),('water','water'),('flood','water'),('vegetation','vegetation'),
 ('tree','vegetation'),('canopy','vegetation'),('roof','roof'),('wall','wall'),('vehicle','vehicle'),('car','vehicle'),('bridge','structure'),('tower','structure'),('powerline','structure'),('debris','unclassified'),
 ('debris','structure'),('landslide','unclassified'),('landslide','structure'),('ground','ground'),('terrain','ground')) k(concept,class)"""


@query("j10_concept_evidence", f"""WITH p AS (SELECT conv_id*1000+turn AS prompt_id, text FROM conversations),
 a AS (SELECT DISTINCT prompt_id, concept FROM (SELECT prompt_id, unnest(string_split_regex(regexp_replace(lower(coalesce(text,'')||' '||(SELECT list(word ORDER BY word) FROM (SELECT * FROM {CONCEPT_WORDS}))[prompt_id%48+1]||', fields'),'[^\\p{{L}}\\p{{N}} ]',' ','g'),' +')) AS word FROM p) JOIN (SELECT * FROM {CONCEPT_WORDS}) USING (word)),
 e AS (SELECT concept, count(*) AS faces, count(*) FILTER (confidence>=0.3) AS instances, coalesce(sum(area) FILTER (confidence>=0.3),0) AS area, coalesce(sum(volume) FILTER (confidence>=0.3),0) AS volume FROM objects JOIN (SELECT * FROM {CONCEPT_CLASS}) USING (class) GROUP BY 1)
 SELECT concept, prompt_id, faces, faces/(SELECT count(*) FROM objects) AS face_share, instances, area, volume FROM a JOIN e USING (concept)""", "face_share area volume")
def _(t):
    """Whole conversation texts as prompts, each with one of the known words added."""
    i = F.col("conv_id") * 1000 + F.col("turn")
    word = F.get(F.array(*[F.lit(w) for w in sorted(SYNONYMS)]), (i % len(SYNONYMS)).cast("int"))
    prompts = t.raw("conversations").select(i.alias("prompt_id"), F.concat(F.coalesce("text", F.lit("")), F.lit(" "), word, F.lit(", fields")).alias("text"))
    return sc.concept_evidence(t.objects, prompts, t.objects.select("class"))


@query("i13_debris_prune")
def _(t):
    return sc.prune_debris(t.vertices, t.faces, 20, 1.0).groupBy("mission_id").agg(F.count(F.lit(1)).alias("faces"))


@query("i16_vertex_confidence", f"SELECT mission_id, vid, (CASE WHEN n.d<=1 THEN n.c ELSE 1 END)*(0.6e0+0.4e0*coalesce(q,100)/100) AS confidence FROM ({NEAR_VERTEX}) LEFT JOIN (SELECT mission_id, avg(cz) AS q FROM poses GROUP BY 1) USING (mission_id)", "confidence")
def _(t):
    v = t.vertices.select((F.col("vid") % 8).alias("mission_id"), "vid", "x", "y", "z")
    g = t.poses.groupBy("mission_id").agg(F.avg("cz").alias("gps_score"))
    return sc.vertex_confidence(v, t.points, g, 1.0)
