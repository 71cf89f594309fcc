"""Registered queries: mesh tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyfold.operators import mesh as me
from skyfold.plans.registry import query

CORNER = """SELECT f.*, a.x AS x0,a.y AS y0,a.z AS z0,b.x AS x1,b.y AS y1,b.z AS z1,c.x AS x2,c.y AS y2,c.z AS z2 FROM faces f JOIN vertices a ON a.vid=v0 JOIN vertices b ON b.vid=v1 JOIN vertices c ON c.vid=v2"""
GEO = f"""SELECT *, sqrt(gx*gx+gy*gy+gz*gz)/2 AS area, CASE WHEN sqrt(gx*gx+gy*gy+gz*gz)>1e-12 THEN gx/sqrt(gx*gx+gy*gy+gz*gz) ELSE 0 END AS nx, CASE WHEN sqrt(gx*gx+gy*gy+gz*gz)>1e-12 THEN gy/sqrt(gx*gx+gy*gy+gz*gz) ELSE 0 END AS ny, CASE WHEN sqrt(gx*gx+gy*gy+gz*gz)>1e-12 THEN gz/sqrt(gx*gx+gy*gy+gz*gz) ELSE 0 END AS nz,
 (x0+x1+x2)/3 AS cx, (y0+y1+y2)/3 AS cy, (z0+z1+z2)/3 AS cz, greatest(sqrt(pow(x0-x1,2)+pow(y0-y1,2)+pow(z0-z1,2)),sqrt(pow(x2-x1,2)+pow(y2-y1,2)+pow(z2-z1,2)),sqrt(pow(x0-x2,2)+pow(y0-y2,2)+pow(z0-z2,2))) AS longest FROM (
 SELECT *, (y1-y0)*(z2-z0)-(z1-z0)*(y2-y0) AS gx, (z1-z0)*(x2-x0)-(x1-x0)*(z2-z0) AS gy, (x1-x0)*(y2-y0)-(y1-y0)*(x2-x0) AS gz FROM ({CORNER}))"""
FE = "SELECT mission_id, fid, least(s,e) AS a, greatest(s,e) AS b FROM (SELECT mission_id, fid, unnest([v0,v1,v2]) AS s, unnest([v1,v2,v0]) AS e FROM faces)"
EDGES = f"SELECT mission_id, a, b, count(*) AS faces FROM ({FE}) GROUP BY 1,2,3"


@query("i1_face_geometry", f"SELECT mission_id, fid, area, nx, ny, nz, cx, cy, cz, longest FROM ({GEO})", "area nx ny nz cx cy cz longest")
def _(t):
    return me.face_geometry(t.vertices, t.faces).select("mission_id", "fid", "area", "nx", "ny", "nz", "cx", "cy", "cz", "longest")


@query("i2_vertex_normals", f"""WITH s AS (SELECT mission_id, vid, sum(nx*area) AS x, sum(ny*area) AS y, sum(nz*area) AS z FROM (SELECT mission_id, unnest([v0,v1,v2]) AS vid, nx, ny, nz, area FROM ({GEO})) GROUP BY 1,2)
 SELECT mission_id, vid, x/sqrt(x*x+y*y+z*z) AS nx, y/sqrt(x*x+y*y+z*z) AS ny, z/sqrt(x*x+y*y+z*z) AS nz FROM s""", "nx ny nz")
def _(t):
    return me.vertex_normals(t.vertices, t.faces)


@query("i3_edges", EDGES)
def _(t):
    return me.edges(t.faces)


@query("i3_topology", f"""SELECT mission_id, vertices, faces, edges, boundary_edges, nonmanifold_edges, boundary_edges=0 AND nonmanifold_edges=0 AND faces>0 AS watertight, vertices-edges+faces AS euler FROM
 (SELECT mission_id, count(*) AS vertices FROM vertices GROUP BY 1) LEFT JOIN (SELECT mission_id, count(*) AS faces FROM faces GROUP BY 1) USING (mission_id)
 LEFT JOIN (SELECT mission_id, count(*) AS edges, count(*) FILTER (faces=1) AS boundary_edges, count(*) FILTER (faces>2) AS nonmanifold_edges FROM ({EDGES}) GROUP BY 1) USING (mission_id)""")
def _(t):
    return me.topology(t.vertices, t.faces)


FACE_CC = f"""WITH RECURSIVE fe AS ({FE}), lk AS (SELECT DISTINCT x.mission_id, x.fid AS u, y.fid AS v FROM fe x JOIN fe y USING (mission_id,a,b) WHERE x.fid<>y.fid),
 r(u,v) USING KEY (u) AS (SELECT fid AS u, fid AS v FROM faces UNION SELECT lk.u, min(r.v) FROM r JOIN lk ON lk.v=r.u JOIN recurring.r o ON o.u=lk.u WHERE r.v<o.v GROUP BY lk.u)"""


@query("i4_face_components", f"{FACE_CC} SELECT mission_id, fid, r.v AS component FROM faces JOIN r ON r.u=fid")
def _(t):
    return me.face_components(t.faces).select("mission_id", "fid", "component")


@query("i4_vertex_components", f"""WITH RECURSIVE e AS (SELECT a AS u, b AS v FROM ({EDGES}) UNION ALL SELECT b, a FROM ({EDGES})),
 r(u,v) USING KEY (u) AS (SELECT vid AS u, vid AS v FROM vertices UNION SELECT e.u, min(r.v) FROM r JOIN e ON e.v=r.u JOIN recurring.r o ON o.u=e.u WHERE r.v<o.v GROUP BY e.u)
 SELECT mission_id, vid, r.v AS component FROM vertices JOIN r ON r.u=vid""")
def _(t):
    return me.vertex_components(t.vertices, t.faces).select("mission_id", "vid", "component")


@query("i5_submesh", "SELECT mission_id, vid FROM vertices WHERE vid IN (SELECT unnest([v0,v1,v2]) FROM faces WHERE label<=2)")
def _(t):
    return me.submesh(t.vertices, t.faces, F.col("label") <= 2)[0].select("mission_id", "vid")


@query("i6_weld", """WITH k AS (SELECT mission_id, vid, min(vid) OVER (PARTITION BY mission_id, CAST(round(x/3) AS BIGINT), CAST(round(y/3) AS BIGINT), CAST(round(z/3) AS BIGINT)) AS keep FROM vertices)
 SELECT f.mission_id, fid, a.keep AS v0, b.keep AS v1, c.keep AS v2 FROM faces f JOIN k a ON a.vid=v0 JOIN k b ON b.vid=v1 JOIN k c ON c.vid=v2""")
def _(t):
    return me.weld(t.vertices, t.faces, 3.0)[1].select("mission_id", "fid", "v0", "v1", "v2")


@query("i7_mesh_quality", f"""WITH g AS ({GEO}), e AS (SELECT mission_id, a, b, count(*) AS c, min(fid) AS f, max(fid) AS h FROM ({FE}) GROUP BY 1,2,3),
 t AS (SELECT e.mission_id, 100*avg(CASE WHEN x.nx*y.nx+x.ny*y.ny+x.nz*y.nz < -1e-12 THEN 1 ELSE 0 END) AS conflict_percent FROM e JOIN g x ON x.fid=e.f JOIN g y ON y.fid=e.h WHERE c=2 GROUP BY 1),
 d AS (SELECT mission_id, count(*) AS faces, count(*) FILTER (v0=v1 OR v1=v2 OR v0=v2 OR 2*area<=1e-12) AS degenerate FROM g GROUP BY 1)
 SELECT mission_id, faces, degenerate, conflict_percent, extent_x, extent_y, extent_z FROM d LEFT JOIN t USING (mission_id) JOIN (SELECT mission_id, max(x)-min(x) AS extent_x, max(y)-min(y) AS extent_y, max(z)-min(z) AS extent_z FROM vertices GROUP BY 1) USING (mission_id)""", "conflict_percent extent_x extent_y extent_z")
def _(t):
    return me.mesh_quality(t.vertices, t.faces)


@query("i8_volume", f"""{FACE_CC}, p AS (SELECT c.*, r.v AS component FROM ({CORNER}) c JOIN r ON r.u=fid),
 cl AS (SELECT component, bool_and(c=2) AS closed FROM (SELECT r.v AS component, a, b, count(*) AS c FROM fe JOIN r ON r.u=fid GROUP BY 1,2,3) GROUP BY 1)
 SELECT mission_id, component, count(*) AS faces, CASE WHEN any_value(closed) THEN sum(x0*(y1*z2-z1*y2)+y0*(z1*x2-x1*z2)+z0*(x1*y2-y1*x2))/6 END AS volume FROM p JOIN cl USING (component) GROUP BY 1,2""", "volume")
def _(t):
    return me.volume(t.vertices, t.faces)


@query("i9_vertex_majority", "SELECT mission_id, vid, CAST(arg_max(label, c*1000-label) AS BIGINT) AS label FROM (SELECT mission_id, vid, label, count(*) AS c FROM (SELECT mission_id, unnest([v0,v1,v2]) AS vid, label FROM faces) GROUP BY 1,2,3) GROUP BY 1,2")
def _(t):
    return me.vertex_majority(t.faces)


@query("i12_mesh_audit", f"""{FACE_CC}, g AS ({GEO}), p AS (SELECT mission_id, r.v AS component, count(*) AS c FROM faces JOIN r ON r.u=fid GROUP BY 1,2),
 q AS (SELECT mission_id, count(*) AS patches, max(c)/sum(c) AS largest_share, coalesce(sum(c) FILTER (c<50),0)/sum(c) AS small_share FROM p GROUP BY 1)
 SELECT mission_id, count(*) AS faces, max(longest) AS edge_max, count(*) FILTER (longest>10*0.2e0) AS long_faces, avg(CASE WHEN nz>0.5 THEN 1 ELSE 0 END) AS up_share, avg(CASE WHEN nz<-0.5 THEN 1 ELSE 0 END) AS down_share,
 count(*) FILTER (greatest(z0,z1,z2)-least(z0,z1,z2)>10) AS tall_faces, quantile_cont(longest,.5) AS edge_median, quantile_cont(longest,.95) AS edge_p95, any_value(patches) AS patches, any_value(largest_share) AS largest_share, any_value(small_share) AS small_share
 FROM g JOIN q USING (mission_id) GROUP BY 1""", "edge_max up_share down_share edge_median edge_p95 largest_share small_share")
def _(t):
    return me.mesh_audit(t.vertices, t.faces, 0.2)


@query("i11_component_classes", f"""WITH RECURSIVE e AS (SELECT a AS u, b AS v FROM ({EDGES}) UNION ALL SELECT b, a FROM ({EDGES})),
 r(u,v) USING KEY (u) AS (SELECT vid AS u, vid AS v FROM vertices UNION SELECT e.u, min(r.v) FROM r JOIN e ON e.v=r.u JOIN recurring.r o ON o.u=e.u WHERE r.v<o.v GROUP BY e.u),
 s AS (SELECT a.mission_id, a.vid, min(sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)+pow(a.z-b.z,2))) AS d FROM vertices a JOIN points b ON a.mission_id=b.mission_id GROUP BY 1,2),
 g AS (SELECT q.mission_id, r.v AS component, count(*) AS vertices, min(x) AS lo_x, max(x) AS hi_x, min(y) AS lo_y, max(y) AS hi_y, min(z) AS lo_z, max(z) AS hi_z, quantile_cont(d,.5) AS median_support_m FROM vertices q JOIN r ON r.u=q.vid LEFT JOIN s ON s.mission_id=q.mission_id AND s.vid=q.vid GROUP BY 1,2)
 SELECT *, CASE WHEN median_support_m IS NULL THEN 'unclassified (no support distances)' WHEN vertices<10 AND median_support_m>0.4e0 THEN 'noise_candidate' WHEN median_support_m<=0.4e0 THEN CASE WHEN vertices>=100 THEN 'supported_large' ELSE 'supported_small' END WHEN median_support_m>0.8e0 THEN 'unsupported' ELSE 'weakly_supported' END AS class FROM g""", "lo_x hi_x lo_y hi_y lo_z hi_z median_support_m", 5)
def _(t):
    return me.classify_components(t.vertices, t.faces, t.points, 0.4)
