"""Registered queries: accessibility and risk of sites."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyfold.operators import access as ac, scene as sc
from skyfold.plans.q_scene import SLOPES
from skyfold.plans.registry import query

SIZE, FLOOD_M = 2.0, 1.0

# Rolling ground whose waves grow with the mission, with cells missing along one line; findings and structures of the objects table laid on it.
Z = "(0.6e0+0.35e0*mission_id)*sin(x/3.1e0)*cos(y/4.3e0)+0.002e0*z"
CELLS = f"""ground AS (SELECT mission_id, x, y, {Z} AS z FROM points WHERE NOT (x>=30 AND x<32 AND y>=10 AND y<40)), {SLOPES.format(s=SIZE, src='ground')},
 laid AS (SELECT object_id%8 AS mission_id, object_id AS structure_id, (object_id%47)*1.1e0 AS x, (object_id*7%53)*0.9e0 AS y, area, class, CASE object_id%4 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' ELSE 'Critical' END AS severity FROM objects),
 wet AS (SELECT mission_id, x, y, sqrt(greatest(area/40,1)/pi())+{FLOOD_M}e0 AS r FROM laid WHERE class='water' AND structure_id%3=0),
 cells AS (SELECT *, slope_deg<=15 AND NOT flooded AS passable FROM (SELECT c.mission_id, c.ix, c.iy, c.slope_deg, bool_or(coalesce(sqrt(pow((ix+0.5e0)*{SIZE}e0-x,2)+pow((iy+0.5e0)*{SIZE}e0-y,2))<=r,false)) AS flooded FROM slopes c LEFT JOIN wet w ON w.mission_id=c.mission_id GROUP BY ALL)),
 box AS (SELECT mission_id, min(ix) AS i0, max(ix) AS i1, min(iy) AS j0, max(iy) AS j1 FROM cells GROUP BY 1),
 free AS (SELECT c.mission_id, ix, iy FROM cells c JOIN box USING (mission_id) WHERE passable AND (ix IN (i0,i1) OR iy IN (j0,j1)) UNION SELECT c.mission_id, c.ix, c.iy FROM free f JOIN cells c ON c.mission_id=f.mission_id AND abs(c.ix-f.ix)+abs(c.iy-f.iy)=1 AND c.passable),
 flags AS (SELECT c.*, f.ix IS NOT NULL AS reachable FROM cells c LEFT JOIN free f ON f.mission_id=c.mission_id AND f.ix=c.ix AND f.iy=c.iy),
 st AS (SELECT * FROM laid WHERE class IN ('roof','wall','structure')),
 near AS (SELECT s.mission_id, structure_id, ix, iy, slope_deg, flooded, reachable, row_number() OVER (PARTITION BY s.mission_id, structure_id ORDER BY sqrt(pow((ix+0.5e0)*{SIZE}e0-x,2)+pow((iy+0.5e0)*{SIZE}e0-y,2)), ix, iy) AS rk FROM st s JOIN flags c ON c.mission_id=s.mission_id AND abs(c.ix-floor(x/{SIZE}e0))<=4 AND abs(c.iy-floor(y/{SIZE}e0))<=4 WHERE sqrt(pow((ix+0.5e0)*{SIZE}e0-x,2)+pow((iy+0.5e0)*{SIZE}e0-y,2))<=6),
 acc AS (SELECT s.mission_id, s.structure_id, CASE WHEN n.ix IS NULL THEN 'outside' WHEN reachable THEN 'reachable' ELSE 'blocked' END AS state, CASE WHEN n.ix IS NULL OR reachable THEN NULL WHEN flooded THEN 'flooded_access' WHEN slope_deg>15 THEN 'slope_exceeds_vehicle_access' ELSE 'isolated_by_terrain' END AS cause, coalesce(flooded,false) AS flooded FROM st s LEFT JOIN (SELECT * FROM near WHERE rk=1) n USING (mission_id, structure_id)),
 grade AS (SELECT mission_id, total, reached, blocked, reached/greatest(total,1) AS share, CASE WHEN total=0 OR reached=total THEN 'Low' WHEN reached/greatest(total,1)>=0.6 THEN 'Medium' ELSE 'High' END AS level, CASE WHEN total=0 THEN 'not_applicable_no_structures' WHEN reached=total THEN 'Good' WHEN reached/greatest(total,1)>=0.6 THEN 'Limited' ELSE 'Restricted' END AS grade
 FROM (SELECT mission_id, coalesce(total,0) AS total, coalesce(reached,0) AS reached, coalesce(blocked,0) AS blocked FROM box LEFT JOIN (SELECT mission_id, count(*) AS total, count(*) FILTER (state='reachable') AS reached, count(*) FILTER (state='blocked') AS blocked FROM acc GROUP BY 1) USING (mission_id)))"""


def site(t):
    """Access cells, structures and findings of the rolling ground."""
    x, y, m, i = F.col("x"), F.col("y"), F.col("mission_id"), F.col("object_id")
    z = (0.6 + 0.35 * m) * F.sin(x / 3.1) * F.cos(y / 4.3) + 0.002 * F.col("z")
    grid = sc.slope_grid(t.points.filter(~((x >= 30) & (x < 32) & (y >= 10) & (y < 40))).withColumn("z", z), SIZE)
    level = F.element_at(F.array(*[F.lit(v) for v in ac.LEVELS]), (i % 4 + 1).cast("int"))
    laid = t.objects.select((i % 8).alias("mission_id"), i.alias("structure_id"), (i % 47 * F.lit(1.1)).alias("x"), (i * 7 % 53 * F.lit(0.9)).alias("y"), "area", "class", level.alias("severity"))
    water = laid.filter("class = 'water' AND structure_id % 3 = 0").withColumn("area", F.col("area") / 40)
    cells = ac.access_cells(grid, water, SIZE, flood_m=FLOOD_M)
    kind = F.when((F.col("class") == "water") & (F.col("structure_id") % 3 == 0), "flood").when(F.col("class") == "unclassified", "debris_field")
    return cells, laid.filter(F.col("class").isin("roof", "wall", "structure")), laid.withColumn("kind", kind).filter("kind IS NOT NULL")


@query("f16_accessibility", f"WITH RECURSIVE {CELLS} SELECT mission_id, structure_id, state, cause FROM acc")
def _(t):
    cells, structures, _ = site(t)
    return ac.accessibility(cells, structures, SIZE)


@query("f16_access_grade", f"WITH RECURSIVE {CELLS} SELECT * FROM grade", "share")
def _(t):
    cells, structures, _ = site(t)
    return ac.access_grade(ac.accessibility(cells, structures, SIZE), cells)


@query("f17_exposed_structures", f"WITH RECURSIVE {CELLS} SELECT mission_id, structure_id FROM acc WHERE flooded")
def _(t):
    cells, structures, _ = site(t)
    return ac.exposed_structures(cells, structures, SIZE)


NAME = "CASE least(greatest({n},1),4) WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' WHEN 3 THEN 'High' ELSE 'Critical' END"


@query("f18_risk_report", f"""WITH RECURSIVE {CELLS}, f AS (SELECT mission_id, coalesce(max(n) FILTER (class='water' AND structure_id%3=0),0) AS flood_n, coalesce(max(n) FILTER (class='unclassified'),0) AS debris_n FROM (SELECT *, structure_id%4+1 AS n FROM laid) GROUP BY 1),
 g AS (SELECT mission_id, avg(slope_deg) AS mean_slope_deg, max(slope_deg) AS max_slope_deg, quantile_cont(slope_deg,.9) AS p90_slope_deg, avg(CASE WHEN passable THEN 0 ELSE 1 END) AS impassable_share, avg(CASE WHEN flooded THEN 1 ELSE 0 END) AS flooded_share, avg(CASE WHEN slope_deg>25 THEN 1 ELSE 0 END) AS steep_share FROM flags GROUP BY 1),
 e AS (SELECT mission_id, count(*) AS exposed FROM acc WHERE flooded GROUP BY 1), j AS (SELECT g.*, coalesce(flood_n,0) AS flood_n, coalesce(debris_n,0) AS debris_n, coalesce(exposed,0) AS exposed, total, blocked, level, grade FROM g LEFT JOIN f USING (mission_id) LEFT JOIN e USING (mission_id) JOIN grade USING (mission_id)),
 n AS (SELECT *, CASE WHEN flood_n>0 THEN least(4,flood_n+(CASE WHEN exposed>0 THEN 1 ELSE 0 END)) END AS a, CASE WHEN steep_share>0 THEN CASE WHEN steep_share>=0.15 THEN 3 WHEN steep_share>=0.05 THEN 2 ELSE 1 END END AS b, CASE WHEN debris_n>0 THEN least(4,debris_n+(CASE WHEN blocked>0 THEN 1 ELSE 0 END)) END AS c, CASE WHEN total>0 AND blocked>0 THEN CASE WHEN level='Low' THEN 1 ELSE 3 END END AS d FROM j)
 SELECT mission_id, CASE WHEN a IS NOT NULL THEN {NAME.format(n='a')} END AS flood_risk, CASE WHEN b IS NOT NULL THEN {NAME.format(n='b')} END AS landslide_risk, CASE WHEN c IS NOT NULL THEN {NAME.format(n='c')} END AS debris_risk, CASE WHEN d IS NOT NULL THEN {NAME.format(n='d')} END AS access_risk,
 {NAME.format(n='greatest(coalesce(a,0),coalesce(b,0),coalesce(c,0),coalesce(d,0))')} AS overall, exposed, blocked, grade, mean_slope_deg, max_slope_deg, p90_slope_deg, impassable_share, flooded_share, steep_share FROM n""", "mean_slope_deg max_slope_deg p90_slope_deg impassable_share flooded_share steep_share")
def _(t):
    cells, structures, findings = site(t)
    return ac.risk_report(cells, findings, ac.accessibility(cells, structures, SIZE), ac.exposed_structures(cells, structures, SIZE))
