"""Registered queries: verticals, ground bands, corridors."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyfold.operators import orient as ori
from skyfold.plans.q_scene import poses
from skyfold.plans.registry import query

# The vector of the least eigenvalue of a covariance, in closed form; normals face the cameras above.
SHELL = """c AS (SELECT mission_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, var_pop(x) AS a, covar_pop(x,y) AS b, covar_pop(x,z) AS c, var_pop(y) AS d, covar_pop(y,z) AS e, var_pop(z) AS f FROM points GROUP BY 1),
 q AS (SELECT *, (a+d+f)/3 AS q FROM c), p AS (SELECT *, sqrt((pow(a-q,2)+pow(d-q,2)+pow(f-q,2)+2*(b*b+c*c+e*e))/6) AS p FROM q),
 ph AS (SELECT *, acos(greatest(-1,least(1,((a-q)*((d-q)*(f-q)-e*e)-b*(b*(f-q)-e*c)+c*(b*e-(d-q)*c))/(2*p*p*p))))/3 AS ph FROM p), l AS (SELECT *, q+2*p*cos(ph+2*pi()/3) AS w, q+2*p*cos(ph) AS top, 3*q-(q+2*p*cos(ph+2*pi()/3))-(q+2*p*cos(ph)) AS mid FROM ph),
 n AS (SELECT *, b*e-c*(d-w) AS n0, c*b-(a-w)*e AS n1, (a-w)*(d-w)-b*b AS n2 FROM l), u AS (SELECT *, n0/sqrt(n0*n0+n1*n1+n2*n2) AS v0, n1/sqrt(n0*n0+n1*n1+n2*n2) AS v1, n2/sqrt(n0*n0+n1*n1+n2*n2) AS v2 FROM n),
 cams AS (SELECT mission_id, avg(cx) AS kx, avg(cy) AS ky, avg(cz) AS kz FROM poses GROUP BY 1),
 shell AS (SELECT mission_id, s*v0 AS ux, s*v1 AS uy, s*v2 AS uz, 1-w/greatest(mid,1e-12) AS planarity, abs(v2) AS facing FROM (SELECT *, CASE WHEN (kx-mx)*v0+(ky-my)*v1+(kz-mz)*v2<0 THEN -1 ELSE 1 END AS s FROM u JOIN cams USING (mission_id)))"""


@query("j12_scene_vertical", f"""WITH {SHELL} SELECT mission_id, CASE WHEN mission_id%4=1 THEN 0.6e0 WHEN facing>=0.8 THEN ux ELSE 0 END AS ux, CASE WHEN mission_id%4=1 THEN 0 WHEN facing>=0.8 THEN uy ELSE 1 END AS uy, CASE WHEN mission_id%4=1 THEN 0.8e0 WHEN facing>=0.8 THEN uz ELSE 0 END AS uz,
 CASE WHEN mission_id%4=1 THEN 'enu_vertical' WHEN facing>=0.8 THEN 'camera_facing_surface' ELSE 'camera_image_up' END AS prior, planarity, facing FROM shell""", "ux uy uz planarity facing", 5)
def _(t):
    """Every fourth mission has an alignment (turned and scaled), one more a mirrored one that must not count."""
    m = F.col("mission_id")
    turned = [1.6, 0.0, -1.2, 5.0, 0.0, 2.0, 0.0, 6.0, 1.2, 0.0, 1.6, 7.0, 0.0, 0.0, 0.0, 1.0]
    mirror = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    arr = lambda v: F.array(*[F.lit(x) for x in v])
    a = t.points.select("mission_id").distinct().filter(m % 4 < 2).select("mission_id", F.when(m % 4 == 1, arr(turned)).otherwise(arr(mirror)).alias("m"))
    return ori.scene_vertical(t.points, poses(t), a)


@query("j1_band_plane")
def _(t):
    return ori.band_plane(t.points, ori.scene_vertical(t.points, poses(t)))


@query("j11_corridor_axis", """WITH f AS (SELECT mission_id, frame_id, cx+frame_id*0.3e0*(mission_id%3) AS a, CASE WHEN mission_id%2=0 THEN cy ELSE cz END AS b, row_number() OVER (PARTITION BY mission_id ORDER BY frame_id) AS i, count(*) OVER (PARTITION BY mission_id) AS n FROM poses),
 c AS (SELECT mission_id, count(*) AS cameras, var_pop(a) AS p, covar_pop(a,b) AS q, var_pop(b) AS r, avg(a) FILTER (i>n//2)-avg(a) FILTER (i<=n//2) AS sa, avg(b) FILTER (i>n//2)-avg(b) FILTER (i<=n//2) AS sb FROM f GROUP BY 1),
 w AS (SELECT *, (p+r)/2+sqrt(pow((p-r)/2,2)+q*q) AS hi, (p+r)/2-sqrt(pow((p-r)/2,2)+q*q) AS lo FROM c), v AS (SELECT *, CASE WHEN abs(hi-r)>=abs(hi-p) THEN hi-r ELSE q END AS va, CASE WHEN abs(hi-r)>=abs(hi-p) THEN q ELSE hi-p END AS vb FROM w),
 s AS (SELECT *, (CASE WHEN va*sa+vb*sb<0 THEN -1 ELSE 1 END)/sqrt(va*va+vb*vb) AS s, CASE WHEN cameras>=5 THEN hi/greatest(lo,1e-12) END AS ratio FROM v)
 SELECT mission_id, cameras, ratio, CASE WHEN ratio>=1.8 THEN s*va END AS hx, CASE WHEN ratio>=1.8 THEN CASE WHEN mission_id%2=0 THEN s*vb ELSE 0 END END AS hy, CASE WHEN ratio>=1.8 THEN CASE WHEN mission_id%2=0 THEN 0 ELSE s*vb END END AS hz FROM s""", "ratio hx hy hz", 5)
def _(t):
    m = F.col("mission_id")
    cams = t.poses.withColumn("cx", F.col("cx") + F.col("frame_id") * 0.3 * (m % 3))
    normal = t.poses.select("mission_id").distinct().select("mission_id", F.lit(0.0).alias("nx"), F.when(m % 2 == 0, 0.0).otherwise(1.0).alias("ny"), F.when(m % 2 == 0, 1.0).otherwise(0.0).alias("nz"))
    return ori.corridor_axis(cams, normal)
