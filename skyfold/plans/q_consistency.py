"""Registered queries: agreement of views, bridges of meshes, best views of faces."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyfold.operators import consistency as co
from skyfold.plans.q_scene import poses
from skyfold.plans.registry import query

PAIRS = """px AS (SELECT d.mission_id, d.frame_id, cx+(u+0.5-32)*z/60 AS x, cy-(v+0.5-32)*z/60 AS y, cz-z AS z FROM depth_px d JOIN poses c ON c.frame_id=d.frame_id AND c.mission_id=d.mission_id WHERE z>0),
 n AS (SELECT mission_id, frame_id, count(*) AS n FROM px GROUP BY 1,2), o AS (SELECT p.mission_id, p.frame_id, cx, cy, cz, n, lead(p.frame_id) OVER w AS next_frame, lead(cx) OVER w AS x2, lead(cy) OVER w AS y2, lead(cz) OVER w AS z2, lead(n) OVER w AS n2 FROM poses p JOIN n USING (mission_id, frame_id) WINDOW w AS (PARTITION BY p.mission_id ORDER BY p.frame_id)),
 pr AS (SELECT mission_id, frame_id, next_frame, sqrt(pow(cx-x2,2)+pow(cy-y2,2)+pow(cz-z2,2)) AS separation_m FROM o WHERE n>=50 AND n2>=50),
 nn AS (SELECT pr.mission_id, pr.frame_id, a.x, a.y, a.z, min(sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)+pow(a.z-b.z,2))) AS d, count(DISTINCT (a.x,a.y,a.z)) AS c FROM pr JOIN px a ON a.mission_id=pr.mission_id AND a.frame_id=pr.frame_id JOIN px b ON b.mission_id=pr.mission_id AND b.frame_id=pr.next_frame GROUP BY 1,2,3,4,5),
 pairs AS (SELECT mission_id, frame_id, next_frame, separation_m, quantile_cont(d,.5) AS median_nn_m FROM pr JOIN nn USING (mission_id, frame_id) GROUP BY ALL)"""


@query("e23_view_pairs", f"WITH {PAIRS} SELECT * FROM pairs", "separation_m median_nn_m")
def _(t):
    return co.view_disagreement(t.depth_px, poses(t))


@query("e23_view_disagreement", f"""WITH {PAIRS} SELECT mission_id, count(*) AS pairs, quantile_cont(median_nn_m,.5) AS median_disagreement_m, quantile_cont(median_nn_m,.95) AS p95_disagreement_m, quantile_cont(median_nn_m,.5) FILTER (separation_m<5) AS sep_lt5m,
 quantile_cont(median_nn_m,.5) FILTER (separation_m>=5 AND separation_m<20) AS sep_5_20m, quantile_cont(median_nn_m,.5) FILTER (separation_m>=20) AS sep_gt20m FROM pairs GROUP BY 1""", "median_disagreement_m p95_disagreement_m sep_lt5m sep_5_20m sep_gt20m")
def _(t):
    return co.disagreement_summary(co.view_disagreement(t.depth_px, poses(t)))


GEOMETRY = """fg AS MATERIALIZED (SELECT *, sqrt(n0*n0+n1*n1+n2*n2) AS l FROM (SELECT *, (y1-y0)*(z2-z0)-(z1-z0)*(y2-y0) AS n0, (z1-z0)*(x2-x0)-(x1-x0)*(z2-z0) AS n1, (x1-x0)*(y2-y0)-(y1-y0)*(x2-x0) AS n2 FROM (SELECT f.mission_id, f.fid, f.v0, f.v1, f.v2, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1, c.x AS x2, c.y AS y2, c.z AS z2
 FROM mf f JOIN mv a ON a.mission_id=f.mission_id AND a.vid=f.v0 JOIN mv b ON b.mission_id=f.mission_id AND b.vid=f.v1 JOIN mv c ON c.mission_id=f.mission_id AND c.vid=f.v2)))"""
CLOUD = """cl AS MATERIALIZED (SELECT mission_id, point_id, x*0.8e0 AS x, y*0.5e0 AS y, z*0.2e0+(point_id%7)*0.01e0 AS z, CASE point_id%3 WHEN 0 THEN 0.6e0 ELSE 0.0e0 END AS nx, CASE point_id%3 WHEN 0 THEN 0.8e0 ELSE 1.0e0 END AS nz FROM points WHERE epoch='current' AND NOT (x>18 AND x<30)),
 mv AS MATERIALIZED (SELECT vid%8 AS mission_id, vid, x, y*0.5e0 AS y, z*0.2e0 AS z FROM vertices), mf AS MATERIALIZED (SELECT v0%8 AS mission_id, fid, v0, v0+8 AS v1, v0+48 AS v2 FROM faces WHERE v0+48<=(SELECT max(vid) FROM vertices))"""


def mesh(t):
    """Triangles over every eighth vertex."""
    v = t.vertices.select((F.col("vid") % 8).alias("mission_id"), "vid", "x", (F.col("y") * 0.5).alias("y"), (F.col("z") * 0.2).alias("z"))
    top = t.vertices.agg(F.max("vid")).first()[0]
    f = t.faces.select((F.col("v0") % 8).alias("mission_id"), "fid", "v0", (F.col("v0") + 8).alias("v1"), (F.col("v0") + 48).alias("v2")).filter(F.col("v2") <= top)
    return v, f


def cloud(t):
    """A cloud with a strip missing; it numbers all points, so it is made only where it is used."""
    i = F.col("point_id")
    return t.current.filter(~((F.col("x") > 18) & (F.col("x") < 30))).select("mission_id", "point_id", (F.col("x") * 0.8).alias("x"), (F.col("y") * 0.5).alias("y"), (F.col("z") * 0.2 + i % 7 * 0.01).alias("z"), F.when(i % 3 == 0, 0.6).otherwise(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.when(i % 3 == 0, 0.8).otherwise(1.0).alias("nz"))


@query("i14_bridge_faces", f"""WITH {CLOUD}, {GEOMETRY}, sp AS (SELECT mission_id, point_id, quantile_cont(d,.5) AS spacing FROM (SELECT mission_id, point_id, unnest(min(CASE WHEN d>0 THEN d ELSE 1e300 END, 4)) AS d FROM (SELECT a.mission_id, a.point_id, sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)+pow(a.z-b.z,2)) AS d FROM cl a JOIN cl b ON a.mission_id=b.mission_id AND a.point_id<>b.point_id) GROUP BY 1,2) GROUP BY 1,2),
 vn AS (SELECT v.mission_id, v.vid, min((pow(v.x-c.x,2)+pow(v.y-c.y,2)+pow(v.z-c.z,2), point_id, nx, nz)) AS n FROM mv v JOIN cl c USING (mission_id) GROUP BY 1,2),
 le AS (SELECT mission_id, fid, e, CASE WHEN e=d0 THEN (x0+x1)/2 WHEN e=d1 THEN (x1+x2)/2 ELSE (x2+x0)/2 END AS x, CASE WHEN e=d0 THEN (y0+y1)/2 WHEN e=d1 THEN (y1+y2)/2 ELSE (y2+y0)/2 END AS y, CASE WHEN e=d0 THEN (z0+z1)/2 WHEN e=d1 THEN (z1+z2)/2 ELSE (z2+z0)/2 END AS z FROM (SELECT *, greatest(d0,d1,d2) AS e FROM (SELECT *, sqrt(pow(x1-x0,2)+pow(y1-y0,2)+pow(z1-z0,2)) AS d0, sqrt(pow(x2-x1,2)+pow(y2-y1,2)+pow(z2-z1,2)) AS d1, sqrt(pow(x0-x2,2)+pow(y0-y2,2)+pow(z0-z2,2)) AS d2 FROM fg))),
 mm AS (SELECT l.mission_id, l.fid, min(sqrt(pow(l.x-c.x,2)+pow(l.y-c.y,2)+pow(l.z-c.z,2))) AS mid_distance, min((pow(l.x-c.x,2)+pow(l.y-c.y,2)+pow(l.z-c.z,2), c.point_id, spacing))[3] AS mid_spacing FROM le l JOIN cl c USING (mission_id) JOIN sp USING (mission_id, point_id) GROUP BY 1,2),
 nn AS (SELECT g.mission_id, g.fid, avg(v.n[3]) AS nx, avg(v.n[4]) AS nz FROM (SELECT mission_id, fid, unnest([v0,v1,v2]) AS vid FROM fg) g JOIN vn v USING (mission_id, vid) GROUP BY 1,2)
 SELECT mission_id, fid, longest, cosine, mid_distance, mid_spacing, longest>7 AND cosine<0.97e0 AND mid_distance>0.75e0*mid_spacing AS bridge FROM (SELECT g.mission_id, g.fid, e AS longest, abs(CASE WHEN l>1e-12 THEN (n0*nx+n2*nz)/l ELSE 0 END)/(sqrt(nx*nx+nz*nz)+1e-30) AS cosine, mid_distance, mid_spacing FROM fg g JOIN le USING (mission_id, fid) JOIN mm USING (mission_id, fid) JOIN nn USING (mission_id, fid))""", "longest cosine mid_distance mid_spacing", 5)
def _(t):
    return co.bridge_faces(*mesh(t), cloud(t), 7.0, cos=0.97)


@query("i15_best_views", f"""WITH {CLOUD}, {GEOMETRY}, k AS (SELECT mission_id, avg(cx) AS kx, avg(cy) AS ky, avg(cz) AS kz FROM poses GROUP BY 1),
 g AS (SELECT *, (x0+x1+x2)/3 AS x, (y0+y1+y2)/3 AS y, (z0+z1+z2)/3 AS z FROM fg), h AS (SELECT *, CASE WHEN (kx-x)*n0+(ky-y)*n1+(kz-z)*n2<0 THEN -1 ELSE 1 END AS s FROM g JOIN k USING (mission_id)),
 c AS (SELECT h.mission_id, fid, frame_id, cz-z AS d, 60*(x-cx)/(cz-z)+32 AS u, 60*(-(y-cy))/(cz-z)+32 AS v, sqrt(pow(cx-x,2)+pow(cy-y,2)+pow(cz-z,2)) AS far, s*((cx-x)*n0+(cy-y)*n1+(cz-z)*n2)/l AS up FROM h JOIN poses p ON p.mission_id=h.mission_id WHERE l>1e-12),
 w AS (SELECT *, up/far AS cosine FROM c WHERE d>0.01 AND far<500 AND u>=0 AND u<63 AND v>=0 AND v<63), o AS (SELECT w.*, m.frame_id IS NULL AS free, p.z AS zd FROM w LEFT JOIN (SELECT DISTINCT mission_id, frame_id FROM depth_px) m ON m.mission_id=w.mission_id AND m.frame_id=w.frame_id LEFT JOIN depth_px p ON p.mission_id=w.mission_id AND p.frame_id=w.frame_id AND p.u=floor(w.u) AND p.v=floor(w.v)),
 b AS (SELECT mission_id, fid, frame_id, cosine/(1+d/500) AS score, row_number() OVER (PARTITION BY mission_id, fid ORDER BY cosine/(1+d/500) DESC, frame_id) AS rk FROM o WHERE cosine>0.1 AND (free OR d<=zd*1.02e0+0.05e0))
 SELECT f.mission_id, f.fid, coalesce(b.frame_id,-1) AS frame_id, coalesce(b.score,0) AS score FROM mf f LEFT JOIN b ON b.mission_id=f.mission_id AND b.fid=f.fid AND rk=1""", "score")
def _(t):
    return co.best_views(*mesh(t), poses(t), t.depth_px, cell=20.0)
