"""Registered queries: placement on height rasters, registration of clouds."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyfold.operators import placement as pl, raster as ra
from skyfold.plans.registry import query

#: Steps and reach of the search on lattices of 50 m.
LEVELS = ((4.0, 12.0), (2.0, 4.0), (1.0, 2.0))

# A wavy ground under the baseline cloud; the current cloud shows it moved by a few metres and lifted by ten, in three of eight missions as loose noise.
WAVES = "5*sin({x}/7)*cos({y}/9)+2*sin({x}/3+{y}/5)"
GROUND = f"""fix AS (SELECT mission_id, x, y, {WAVES.format(x='x', y='y')}+z*0.02e0 AS z FROM points WHERE epoch='baseline'),
 rec AS (SELECT mission_id, x+tx AS x, y+ty AS y, CASE WHEN mission_id%3=2 THEN z*2 ELSE {WAVES.format(x='x', y='y')}+z*0.02e0+10 END AS z FROM (SELECT *, (mission_id%3)*2.0e0-1 AS tx, 3.0e0-(mission_id%4)*2 AS ty FROM points WHERE epoch='current')),
 meta AS (SELECT mission_id, min(x) AS x0, max(y) AS y1, CAST(floor(max(y)-min(y)) AS BIGINT)+1 AS rows, CAST(floor(max(x)-min(x)) AS BIGINT)+1 AS cols FROM fix GROUP BY 1),
 grid AS (SELECT mission_id, least(rows-1,greatest(0,CAST(trunc(y1-y) AS BIGINT))) AS row, least(cols-1,greatest(0,CAST(trunc(x-x0) AS BIGINT))) AS col, max(z) AS height FROM fix JOIN meta USING (mission_id) GROUP BY 1,2,3),
 patch AS (SELECT a.mission_id, a.row, a.col, a.height AS h0, b.height AS h1, c.height AS h2, d.height AS h3 FROM grid a JOIN grid b ON b.mission_id=a.mission_id AND b.row=a.row AND b.col=a.col+1 JOIN grid c ON c.mission_id=a.mission_id AND c.row=a.row+1 AND c.col=a.col JOIN grid d ON d.mission_id=a.mission_id AND d.row=a.row+1 AND d.col=a.col+1)"""
HEIGHT = "h0*(1-(c-col))*(1-(r-row))+h1*(c-col)*(1-(r-row))+h2*(1-(c-col))*(r-row)+h3*(c-col)*(r-row)"


def level_sql(k: int, step: float, span: float) -> str:
    reach, before = int(span // step), f"best{k - 1}"
    floor = f"(SELECT mission_id, 0.6e0*max(cov) AS floor FROM cov{k} GROUP BY 1)" if k == 0 else f"(SELECT mission_id, floor FROM best{k - 1})"
    start = "(SELECT mission_id, count(*) AS total, 0.0e0 AS sx, 0.0e0 AS sy, 0.0e0 AS floor FROM rec GROUP BY 1)" if k == 0 else before
    return f"""cell{k} AS (SELECT mission_id, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS n FROM rec GROUP BY mission_id, floor(x/{step / 2}e0), floor(y/{step / 2}e0)),
 try{k} AS (SELECT s.mission_id, i, j, z, n, (x+sx+i*{step}e0-x0) AS c, (y1-(y+sy+j*{step}e0)) AS r, rows, cols FROM cell{k} s JOIN {start} b USING (mission_id) JOIN meta USING (mission_id), (SELECT unnest(range(-{reach},{reach + 1})) AS i), (SELECT unnest(range(-{reach},{reach + 1})) AS j)),
 hit{k} AS (SELECT t.mission_id, i, j, n, round((z-({HEIGHT}))/0.01e0+1.234e-7) AS v FROM (SELECT *, CAST(floor(r) AS BIGINT) AS r0, CAST(floor(c) AS BIGINT) AS c0 FROM try{k} WHERE c>=0 AND c<cols-1 AND r>=0 AND r<rows-1) t JOIN patch p ON p.mission_id=t.mission_id AND p.row=r0 AND p.col=c0),
 all{k} AS (SELECT mission_id, i, j, v FROM (SELECT *, unnest(range(n)) FROM hit{k})),
 mid{k} AS (SELECT mission_id, i, j, count(*) AS hits, quantile_cont(v,.5) AS mid FROM all{k} GROUP BY 1,2,3 HAVING count(*)>=500),
 cov{k} AS (SELECT m.mission_id, m.i, m.j, quantile_cont(abs(v-mid),.5)*0.01e0 AS mad, any_value(hits)/any_value(total) AS cov FROM all{k} a JOIN mid{k} m USING (mission_id,i,j) JOIN (SELECT mission_id, count(*) AS total FROM rec GROUP BY 1) USING (mission_id) GROUP BY 1,2,3),
 win{k} AS (SELECT mission_id, min(struct_pack(mad:=mad, i:=i, j:=j, cov:=cov, floor:=floor)) AS w FROM cov{k} JOIN {floor} USING (mission_id) WHERE cov>=floor GROUP BY 1),
 best{k} AS (SELECT b.mission_id, total, sx+coalesce(w.i*{step}e0,0) AS sx, sy+coalesce(w.j*{step}e0,0) AS sy, {'w.mad' if k == 0 else 'coalesce(w.mad,mad)'} AS mad, {'w.cov' if k == 0 else 'coalesce(w.cov,cov)'} AS cov, {'w.floor' if k == 0 else 'floor'} AS floor FROM {start} b LEFT JOIN win{k} USING (mission_id))"""


SHIFT = f"{GROUND}, " + ",\n ".join(level_sql(k, *x) for k, x in enumerate(LEVELS))


def waves(t):
    """Raster with its meta rows from the baseline cloud, and the moved cloud."""
    x, y, m = F.col("x"), F.col("y"), F.col("mission_id")
    z = 5 * F.sin(x / 7) * F.cos(y / 9) + 2 * F.sin(x / 3 + y / 5) + F.col("z") * 0.02
    grid, meta = ra.rasterise(t.baseline.withColumn("z", z), 1.0)
    rec = t.current.withColumn("z", F.when(m % 3 == 2, F.col("z") * 2).otherwise(z + 10)).withColumn("x", x + (m % 3) * 2.0 - 1).withColumn("y", y + 3.0 - (m % 4) * 2)
    return rec, grid, meta


@query("f5_coregistration", f"WITH {SHIFT} SELECT mission_id, sx AS dx, sy AS dy, mad, coalesce(cov,0) AS coverage FROM best{len(LEVELS) - 1} WHERE mad IS NOT NULL", "dx dy mad coverage")
def _(t):
    rec, grid, meta = waves(t)
    return pl.coregister(rec, grid, meta, LEVELS).filter("mad IS NOT NULL")


@query("f6_null_gate", f"""WITH {SHIFT}, laid AS (SELECT mission_id, x+sx-x0 AS c, y1-(y+sy) AS r, z, rows, cols FROM rec JOIN best{len(LEVELS) - 1} USING (mission_id) JOIN meta USING (mission_id) WHERE mad IS NOT NULL),
 steps AS (SELECT mission_id, roll, rows, cols, (rows//4+(roll*(rows//2-rows//4))//5)*(CASE WHEN roll%2=0 THEN 1 ELSE -1 END) AS dr, (cols//4+(roll*(cols//2-cols//4))//5)*(CASE WHEN roll%4<2 THEN 1 ELSE -1 END) AS dc FROM meta, (SELECT unnest(range(5)) AS roll)),
 turned AS (SELECT mission_id, -1 AS roll, row, col, height FROM grid UNION ALL SELECT mission_id, roll, ((row+dr)%rows+rows)%rows, ((col+dc)%cols+cols)%cols, height FROM grid JOIN steps USING (mission_id)),
 tp AS (SELECT a.mission_id, a.roll, a.row, a.col, a.height AS h0, b.height AS h1, c.height AS h2, d.height AS h3 FROM turned a JOIN turned b ON b.mission_id=a.mission_id AND b.roll=a.roll AND b.row=a.row AND b.col=a.col+1 JOIN turned c ON c.mission_id=a.mission_id AND c.roll=a.roll AND c.row=a.row+1 AND c.col=a.col JOIN turned d ON d.mission_id=a.mission_id AND d.roll=a.roll AND d.row=a.row+1 AND d.col=a.col+1),
 s AS (SELECT t.mission_id, roll, z-({HEIGHT}) AS res FROM (SELECT *, CAST(floor(r) AS BIGINT) AS r0, CAST(floor(c) AS BIGINT) AS c0 FROM laid WHERE c>=0 AND c<cols-1 AND r>=0 AND r<rows-1) t JOIN tp ON tp.mission_id=t.mission_id AND tp.row=r0 AND tp.col=c0),
 o AS (SELECT mission_id, roll, quantile_cont(res,.5) AS offset_m, count(*) AS hits FROM s GROUP BY 1,2 HAVING count(*)>=500), e AS (SELECT mission_id, roll, any_value(offset_m) AS offset_m, any_value(hits) AS hits, avg(abs(res-offset_m)) AS mae FROM s JOIN o USING (mission_id, roll) GROUP BY 1,2),
 n AS (SELECT mission_id, quantile_cont(mae,.5) AS null_mae_m, count(*) AS nulls FROM e WHERE roll>=0 GROUP BY 1)
 SELECT mission_id, mae AS mae_m, offset_m, hits, null_mae_m, coalesce(nulls,0) AS nulls, CASE WHEN mae IS NULL THEN 'insufficient_coverage' WHEN mae>0.8e0*null_mae_m THEN 'alignment_gate_failed' ELSE 'ok' END AS status
 FROM (SELECT DISTINCT mission_id FROM rec) LEFT JOIN (SELECT * FROM e WHERE roll=-1) USING (mission_id) LEFT JOIN n USING (mission_id)""", "mae_m offset_m null_mae_m hits")
def _(t):
    rec, grid, meta = waves(t)
    return pl.null_gate(rec, grid, meta, pl.coregister(rec, grid, meta, LEVELS))
