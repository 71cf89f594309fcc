"""Registered queries: merges that keep surfaces apart."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyfold.operators import surfaces as su
from skyfold.plans.q_scene import poses
from skyfold.plans.registry import query

SIZE = 4.0
SEEDS, REFINED = 5, 3  # rounds written out; tests hold them against loops without an end

OFF = f"(nx*sx+ny*sy+nz*sz<0.5e0 OR abs((x-px)*sx+(y-py)*sy+(z-pz)*sz)>{SIZE / 2}e0)"


def seeded_sql(name: str, src: str) -> str:
    """CTE ``name``: rows of ``src(.., base)`` with their sibling, plane after plane."""
    parts, rest = [], src
    for k in range(SEEDS):
        parts.append(f"""{name}{k} AS (SELECT r.*, {OFF} AS off FROM {rest} r JOIN (SELECT * FROM (SELECT mission_id, vx, vy, vz, x AS px, y AS py, z AS pz, nx AS sx, ny AS sy, nz AS sz, row_number() OVER (PARTITION BY mission_id,vx,vy,vz ORDER BY confidence DESC, point_id) AS rk FROM {rest}) WHERE rk=1) USING (mission_id,vx,vy,vz)),
 {name}{k}r AS (SELECT * EXCLUDE (off) FROM {name}{k} WHERE off)""")
        rest = f"{name}{k}r"
    cols = "mission_id,vx,vy,vz,point_id,x,y,z,confidence,nx,ny,nz"
    every = " UNION ALL ".join(f"SELECT {cols}, base+{k} AS sib FROM {name}{k} WHERE NOT off" for k in range(SEEDS))
    return ",\n ".join(parts) + f",\n {name} AS ({every})"


def refine_sql(k: int) -> str:
    src, cols = f"s{k}", "mission_id,vx,vy,vz,point_id,x,y,z,confidence,nx,ny,nz"
    plane = f"""p{k} AS (SELECT mission_id,vx,vy,vz,sib, px, py, pz, a/l AS sx, b/l AS sy, c/l AS sz, l>1e-6 AS has FROM (SELECT *, sqrt(a*a+b*b+c*c) AS l FROM (SELECT mission_id,vx,vy,vz,sib, sum(x*confidence)/(CASE WHEN sum(confidence)>0 THEN sum(confidence) ELSE 1 END) AS px, sum(y*confidence)/(CASE WHEN sum(confidence)>0 THEN sum(confidence) ELSE 1 END) AS py,
 sum(z*confidence)/(CASE WHEN sum(confidence)>0 THEN sum(confidence) ELSE 1 END) AS pz, coalesce(sum(nx*confidence),0) AS a, coalesce(sum(ny*confidence),0) AS b, coalesce(sum(nz*confidence),0) AS c FROM (SELECT {cols}, sib FROM {src} UNION ALL SELECT {cols}, 0 FROM rows WHERE nx IS NULL) GROUP BY ALL)))"""
    met = f"m{k} AS (SELECT s.*, has AND {OFF} AS off FROM {src} s JOIN p{k} USING (mission_id,vx,vy,vz,sib)), b{k} AS (SELECT mission_id,vx,vy,vz, max(sib)+1 AS base FROM {src} GROUP BY ALL), l{k} AS (SELECT m.* EXCLUDE (sib,off), base FROM m{k} m JOIN b{k} USING (mission_id,vx,vy,vz) WHERE off)"
    return f"{plane}, {met}, {seeded_sql(f'n{k}', f'l{k}')}, s{k + 1} AS (SELECT {cols}, sib FROM m{k} WHERE NOT off UNION ALL SELECT {cols}, sib FROM n{k})"


SURFACES = f"""rows AS (SELECT mission_id, CAST(floor(x/{SIZE}e0) AS BIGINT) AS vx, CAST(floor(y/{SIZE}e0) AS BIGINT) AS vy, CAST(floor(z/{SIZE}e0) AS BIGINT) AS vz, point_id, x, y, z, confidence, CASE class WHEN 2 THEN 0.6e0 WHEN 5 THEN 0.0e0 END AS nx, CASE WHEN class IN (2,5) THEN 0.0e0 END AS ny, CASE class WHEN 2 THEN 0.8e0 WHEN 5 THEN -1.0e0 END AS nz FROM points),
 sided AS (SELECT *, 0 AS base FROM rows WHERE nx IS NOT NULL), {seeded_sql('s0', 'sided')}, {', '.join(refine_sql(k) for k in range(REFINED))},
 fin AS (SELECT * FROM s{REFINED} UNION ALL SELECT mission_id,vx,vy,vz,point_id,x,y,z,confidence,nx,ny,nz,0 FROM rows WHERE nx IS NULL)"""


def sided(t):
    """The clouds with normals by class: sloping, facing down, and none (of zero length)."""
    c = F.col("class")
    n = [F.when(c == 2, F.lit(a)).when(c == 5, F.lit(b)).otherwise(0.0).alias(k) for k, a, b in zip(su.NORMAL, (1.2, 0.0, 1.6), (0.0, 0.0, -1.0))]
    return t.points.select("mission_id", "point_id", "x", "y", "z", "confidence", *n)


@query("e3_surface_merge", f"""WITH {SURFACES}, g AS (SELECT mission_id,vx,vy,vz,sib, sum(x*confidence)/(CASE WHEN sum(confidence)>0 THEN sum(confidence) ELSE 1 END) AS x, sum(y*confidence)/(CASE WHEN sum(confidence)>0 THEN sum(confidence) ELSE 1 END) AS y, sum(z*confidence)/(CASE WHEN sum(confidence)>0 THEN sum(confidence) ELSE 1 END) AS z,
 coalesce(sum(nx*confidence),0) AS a, coalesce(sum(ny*confidence),0) AS b, coalesce(sum(nz*confidence),0) AS c, greatest(0,least(1,sum(confidence)/count(*))) AS confidence, count(*) AS observations, sqrt(var_pop(x)+var_pop(y)+var_pop(z)) AS residual, sum(confidence) AS w FROM fin GROUP BY mission_id,vx,vy,vz,sib)
 SELECT mission_id,vx,vy,vz,sib, CASE WHEN w>0 THEN x ELSE vx*{SIZE}e0 END AS x, CASE WHEN w>0 THEN y ELSE vy*{SIZE}e0 END AS y, CASE WHEN w>0 THEN z ELSE vz*{SIZE}e0 END AS z, CASE WHEN l>1e-9 THEN a/l ELSE 0 END AS nx, CASE WHEN l>1e-9 THEN b/l ELSE 0 END AS ny, CASE WHEN l>1e-9 THEN c/l ELSE 0 END AS nz, confidence, observations, residual FROM (SELECT *, sqrt(a*a+b*b+c*c) AS l FROM g)""", "x y z nx ny nz confidence residual", 5)
def _(t):
    return su.voxel_merge_surfaces(sided(t), SIZE)


@query("e35_surface_fusion")
def _(t):
    return su.fuse_depth_surfaces(t.depth_px, poses(t), 2.0)
