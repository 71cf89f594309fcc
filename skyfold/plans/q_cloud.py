"""Registered queries: point clouds, rasters, change."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyfold.operators import change as ch, cloud as cl, raster as ra
from skyfold.plans.registry import query

# The two epochs of a mission are clouds of their own: no neighbour is taken from the other.
CLOUD = ["mission_id", "epoch"]

VOX = "CAST(floor(x/0.5e0) AS BIGINT) AS vx, CAST(floor(y/0.5e0) AS BIGINT) AS vy, CAST(floor(z/0.5e0) AS BIGINT) AS vz"


@query("e1_voxel_merge", f"""SELECT mission_id, vx, vy, vz, sum(x*confidence)/s AS x, sum(y*confidence)/s AS y, sum(z*confidence)/s AS z, greatest(0,least(1,sum(confidence)/count(*))) AS confidence,
 count(*) AS observations, sqrt(greatest(avg(x*x+y*y+z*z)-pow(avg(x),2)-pow(avg(y),2)-pow(avg(z),2),0)) AS residual
 FROM (SELECT *, CASE WHEN sum(confidence) OVER (PARTITION BY mission_id,vx,vy,vz)>0 THEN sum(confidence) OVER (PARTITION BY mission_id,vx,vy,vz) ELSE 1 END AS s FROM (SELECT *, {VOX} FROM points)) GROUP BY mission_id,vx,vy,vz,s""".replace("0.5e0", "2.0e0"), "x y z confidence residual", 5)
def _(t):
    return cl.voxel_merge(t.points, 2.0)


@query("e2_voxel_downsample", f"""WITH p AS (SELECT *, {VOX.replace('0.5e0', '2.0e0')} FROM points), c AS (SELECT mission_id,vx,vy,vz, sum(x*confidence)/sum(confidence) AS cx, sum(y*confidence)/sum(confidence) AS cy, sum(z*confidence)/sum(confidence) AS cz, sum(confidence)/count(*) AS cf, sum(observations) AS o FROM p GROUP BY ALL)
 SELECT mission_id,vx,vy,vz, any_value(cx) AS x, any_value(cy) AS y, any_value(cz) AS z, any_value(cf) AS confidence, CAST(any_value(o) AS BIGINT) AS observations, sqrt(avg(residual*residual+pow(x-cx,2)+pow(y-cy,2)+pow(z-cz,2))) AS residual
 FROM p JOIN c USING (mission_id,vx,vy,vz) GROUP BY mission_id,vx,vy,vz""", "x y z confidence residual")
def _(t):
    return cl.voxel_downsample(t.points, 2.0)


@query("e4_statistical_outliers", """WITH n AS (SELECT a.mission_id, a.epoch, a.point_id, min(sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)+pow(a.z-b.z,2)), 8) AS d FROM points a JOIN points b ON a.mission_id=b.mission_id AND a.epoch=b.epoch AND a.point_id<>b.point_id GROUP BY 1,2,3),
 m AS (SELECT mission_id, epoch, point_id, list_avg(d) AS mean_nn FROM n), s AS (SELECT mission_id, epoch, avg(mean_nn) AS mu, stddev_pop(mean_nn) AS sd FROM m GROUP BY 1,2)
 SELECT mission_id, epoch, point_id, mean_nn, mean_nn<=mu+2*sd AS keep FROM m JOIN s USING (mission_id, epoch)""", "mean_nn")
def _(t):
    return cl.statistical_outliers(t.points, 8, keys=CLOUD).select(*CLOUD, "point_id", "mean_nn", "keep")


@query("e5_radius_outliers", """WITH p AS (SELECT mission_id, x, y, z, count(*) AS c FROM points GROUP BY ALL), n AS (SELECT a.mission_id, a.x, a.y, a.z, sum(b.c) AS near FROM p a JOIN p b ON a.mission_id=b.mission_id
  AND b.x BETWEEN a.x-0.4 AND a.x+0.4 AND abs(a.y-b.y)<=0.4 AND abs(a.z-b.z)<=0.4 AND pow(a.x-b.x,2)+pow(a.y-b.y,2)+pow(a.z-b.z,2)<=0.4e0*0.4e0 GROUP BY ALL)
 SELECT mission_id, point_id, near>=3 AS keep FROM points JOIN n USING (mission_id,x,y,z)""")
def _(t):
    return cl.radius_outliers(t.points, 0.4, 3).select("mission_id", "point_id", "keep")


@query("e6_confidence_floor", "SELECT mission_id, count(*) AS points, sum(z) AS z FROM points WHERE confidence>=0.5e0 GROUP BY 1", "z")
def _(t):
    return cl.min_confidence(t.points, 0.5).groupBy("mission_id").agg(F.count(F.lit(1)).alias("points"), F.sum("z").alias("z"))


@query("e7_filter_chain")
def _(t):
    return cl.filter_cloud(t.points, 0.5, 8, 2.0, 1.0, 2, 0.3)[1]


FOOT = "SELECT mission_id, CAST(floor(x/1.0e0) AS BIGINT) AS ix, CAST(floor(y/1.0e0) AS BIGINT) AS iy, count(*) AS points FROM points GROUP BY ALL"


@query("e8_footprint", f"SELECT *, ix+0.5e0 AS cx, iy+0.5e0 AS cy FROM ({FOOT})", "cx cy")
def _(t):
    return cl.footprint(t.points, 1.0)


@query("e9_dense_quality")
def _(t):
    return cl.dense_quality(t.points, 1.0)


@query("e10_weak_regions", f"""WITH f AS ({FOOT}), m AS (SELECT mission_id, greatest(1,0.5*median(points)) AS th, count(*) AS n FROM f GROUP BY 1),
 r AS (SELECT mission_id, row_number() OVER (PARTITION BY mission_id ORDER BY points,ix,iy) AS rank, ix+0.5e0 AS cx, iy+0.5e0 AS cy, points FROM f JOIN m USING (mission_id) WHERE n>=8 AND points<th)
 SELECT mission_id, CAST(rank AS INTEGER) AS rank, cx, cy, points FROM r WHERE rank<=10""", "cx cy")
def _(t):
    return cl.weak_regions(t.points, 1.0)


CONF = "0.6e0*(1-exp(-observations/3.0e0))+0.4e0*exp(-residual/0.05e0)"


@query("e11_confidence_classes", f"""SELECT mission_id, count(*) FILTER (c>=0.7) AS high, count(*) FILTER (c>=0.45 AND c<0.7) AS medium, count(*) FILTER (c>=0.25 AND c<0.45) AS low, count(*) FILTER (c<0.25) AS very_low
 FROM (SELECT mission_id, {CONF} AS c FROM points) GROUP BY 1""")
def _(t):
    return cl.confidence_classes(cl.dense_confidence(t.points, 0.05))


@query("e12_twin_measurements", """SELECT mission_id, count(*) AS points, avg(confidence) AS mean_confidence, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z,
 max(x)-min(x) AS length, max(y)-min(y) AS width, max(z)-min(z) AS height, (max(x)-min(x))*(max(y)-min(y)) AS footprint_area FROM points GROUP BY 1""", "mean_confidence min_x max_x min_y max_y min_z max_z length width height footprint_area")
def _(t):
    return cl.twin_measurements(t.points)


NN1 = "SELECT a.mission_id, a.point_id, min(sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)+pow(a.z-b.z,2))) AS d FROM points a JOIN points b ON a.mission_id=b.mission_id AND a.point_id<>b.point_id GROUP BY 1,2"


@query("e13_spacing_percentiles", f"SELECT mission_id, quantile_cont(d,.5) AS p50, quantile_cont(d,.9) AS p90, quantile_cont(d,.95) AS p95, quantile_cont(d,.99) AS p99 FROM ({NN1}) GROUP BY 1", "p50 p90 p95 p99")
def _(t):
    return cl.spacing_stats(t.points)


NN6 = "SELECT mission_id, epoch, point_id, quantile_cont(d,.5) AS spacing FROM (SELECT mission_id, epoch, point_id, unnest(min(d2,6)) AS d FROM (SELECT a.mission_id, a.epoch, a.point_id, sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)+pow(a.z-b.z,2)) AS d2 FROM points a JOIN points b ON a.mission_id=b.mission_id AND a.epoch=b.epoch AND a.point_id<>b.point_id) GROUP BY 1,2,3) WHERE d>0 GROUP BY 1,2,3"


@query("e13_spacing_field", NN6, "spacing")
def _(t):
    return cl.spacing_field(t.points, 6, CLOUD)


@query("e14_spacing_summary", f"""WITH f AS ({NN6}), q AS (SELECT mission_id, epoch, quantile_cont(spacing,.05) AS p05, quantile_cont(spacing,.5) AS median, quantile_cont(spacing,.95) AS p95, quantile_cont(spacing,.005) AS lo, quantile_cont(spacing,.995) AS hi, avg(spacing) AS mean, count(*) AS points FROM f GROUP BY 1,2)
 SELECT mission_id, epoch, p05, median, p95, mean, points, min(spacing) AS robust_min, max(spacing) AS robust_max, 1/pow(median,3) AS density FROM f JOIN q USING (mission_id, epoch) WHERE spacing BETWEEN lo AND hi GROUP BY ALL""", "p05 median p95 robust_min robust_max mean density")
def _(t):
    return cl.spacing_summary(cl.spacing_field(t.points, 6, CLOUD), CLOUD)


@query("e15_normals")
def _(t):
    return cl.estimate_normals(t.points, 12, keys=CLOUD).select(*CLOUD, "point_id", "nx", "ny", "nz")


RASTER = """SELECT mission_id, least(rows-1,greatest(0,CAST(trunc((y1-y)/2.0e0) AS BIGINT))) AS row, least(cols-1,greatest(0,CAST(trunc((x-x0)/2.0e0) AS BIGINT))) AS col, max(z) AS height, count(*) AS n
 FROM pts JOIN meta USING (mission_id) GROUP BY ALL"""
META = """pts AS (SELECT * FROM points WHERE epoch='baseline'), meta AS (SELECT mission_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, CAST(floor((max(y)-min(y))/2.0e0) AS BIGINT)+1 AS rows, CAST(floor((max(x)-min(x))/2.0e0) AS BIGINT)+1 AS cols FROM pts GROUP BY 1)"""


@query("f1_height_raster", f"WITH {META} {RASTER}", "height")
def _(t):
    return ra.rasterise(t.baseline, 2.0)[0]


@query("f2_ground_spacing", """WITH p AS (SELECT DISTINCT mission_id, x, y FROM points), d AS (SELECT a.mission_id, a.x, a.y, min(sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2))) AS d FROM p a JOIN p b ON a.mission_id=b.mission_id AND (a.x<>b.x OR a.y<>b.y) GROUP BY 1,2,3),
 n AS (SELECT mission_id, x, y, count(*) AS c FROM points GROUP BY ALL) SELECT mission_id, coalesce(quantile_cont(d,.5),1) AS spacing FROM points JOIN n USING (mission_id,x,y) LEFT JOIN d ON d.mission_id=points.mission_id AND d.x=points.x AND d.y=points.y AND c=1 GROUP BY mission_id""", "spacing")
def _(t):
    return ra.ground_spacing(t.points)


SAMPLE = f"""WITH {META}, g AS ({RASTER}), c AS (SELECT point_id, mission_id, z, (x-x0)/2.0e0 AS c, (y1-y)/2.0e0 AS r, rows, cols FROM points JOIN meta USING (mission_id) WHERE epoch='current'),
 o AS (SELECT *, CAST(floor(c) AS BIGINT) AS c0, CAST(floor(r) AS BIGINT) AS r0, c-floor(c) AS fc, r-floor(r) AS fr FROM c WHERE c>=0 AND c<cols-1 AND r>=0 AND r<rows-1),
 s AS (SELECT o.mission_id, o.point_id, o.z, a.height*(1-fc)*(1-fr)+b.height*fc*(1-fr)+d.height*(1-fc)*fr+e.height*fc*fr AS ground FROM o
 JOIN g a ON a.mission_id=o.mission_id AND a.row=r0 AND a.col=c0 JOIN g b ON b.mission_id=o.mission_id AND b.row=r0 AND b.col=c0+1
 JOIN g d ON d.mission_id=o.mission_id AND d.row=r0+1 AND d.col=c0 JOIN g e ON e.mission_id=o.mission_id AND e.row=r0+1 AND e.col=c0+1)"""


@query("f3_sample_grid", f"{SAMPLE} SELECT mission_id, point_id, z, ground FROM s", "z ground")
def _(t):
    grid, meta = ra.rasterise(t.baseline, 2.0)
    return ra.sample_grid(t.current, grid, meta)


@query("f4_dsm_error", f"""{SAMPLE}, q AS (SELECT mission_id, quantile_cont(z-ground,.5) AS offset_m FROM s GROUP BY 1), e AS (SELECT mission_id, count(*) AS hits, any_value(offset_m) AS offset_m, avg(abs(z-ground-offset_m)) AS mae_m, quantile_cont(abs(z-ground-offset_m),.95) AS p95_m FROM s JOIN q USING (mission_id) GROUP BY 1)
 SELECT mission_id, coalesce(hits,0) AS hits, coalesce(hits,0)/n AS coverage, CASE WHEN hits>=500 THEN offset_m END AS offset_m, CASE WHEN hits>=500 THEN mae_m END AS mae_m, CASE WHEN hits>=500 THEN p95_m END AS p95_m, CASE WHEN hits>=500 THEN 'measured' ELSE 'insufficient' END AS status
 FROM (SELECT mission_id, count(*) AS n FROM points WHERE epoch='current' GROUP BY 1) LEFT JOIN e USING (mission_id)""", "coverage offset_m mae_m p95_m")
def _(t):
    grid, meta = ra.rasterise(t.baseline, 2.0)
    return ra.dsm_error(t.current, grid, meta)


OCC = """SELECT mission_id, least(nx-1,CAST(trunc((x-x0)/1.0e0) AS BIGINT)) AS ix, least(ny-1,CAST(trunc((y-y0)/1.0e0) AS BIGINT)) AS iy, any_value(nx) AS nx, any_value(ny) AS ny, count(*) AS points FROM points
 JOIN (SELECT mission_id, min(x) AS x0, min(y) AS y0, greatest(1,CAST(ceil(max(x)-min(x)) AS BIGINT)) AS nx, greatest(1,CAST(ceil(max(y)-min(y)) AS BIGINT)) AS ny FROM points GROUP BY 1) USING (mission_id) GROUP BY ALL"""
OCC = OCC.replace(", any_value(nx) AS nx, any_value(ny) AS ny", ", nx, ny")


@query("f7_occupancy", f"""SELECT mission_id, count(*) FILTER (points>=3) AS occupied_cells, count(*) FILTER (points>=3)*1.0e0 AS area_m2, count(*) FILTER (points>=3)/1e4 AS area_ha, count(*) FILTER (points>=3)/1e6 AS area_km2, count(*)*1.0e0 AS any_point_area_m2 FROM ({OCC}) GROUP BY 1""", "area_m2 area_ha area_km2 any_point_area_m2")
def _(t):
    return ra.occupancy(t.points)


@query("f8_coarse_occupancy", f"""SELECT mission_id, CAST(floor(ix/5) AS BIGINT) AS ix, CAST(floor(iy/5) AS BIGINT) AS iy, CAST(sum(points) AS BIGINT) AS points, 5.0e0 AS cell_m FROM ({OCC}) GROUP BY 1,2,3 HAVING sum(points)>=3""", "cell_m")
def _(t):
    return ra.coarse_occupancy(t.points, 1.0, 110)


@query("f9_hull")
def _(t):
    return ra.hull(t.points)


@query("f11_elevation", """SELECT mission_id, count(*) AS points, min(z) AS z_min, max(z) AS z_max, max(z)-min(z) AS relief, avg(z) AS z_mean, quantile_cont(z,.5) AS z_median, quantile_cont(z,.005) AS z_p005, quantile_cont(z,.995) AS z_p995,
 min({'z':z,'x':x,'y':y}).x AS low_x, min({'z':z,'x':x,'y':y}).y AS low_y, max({'z':z,'x':x,'y':y}).x AS high_x, max({'z':z,'x':x,'y':y}).y AS high_y FROM points GROUP BY 1""", "z_min z_max relief z_mean z_median z_p005 z_p995 low_x low_y high_x high_y")
def _(t):
    return ra.elevation(t.points)


@query("f11_elevation_histogram", """SELECT mission_id, CASE WHEN w>0 THEN least(23,CAST(floor((z-lo)/w) AS BIGINT)) ELSE 0 END AS bin, count(*) AS points FROM points JOIN (SELECT mission_id, min(z) AS lo, (max(z)-min(z))/24 AS w FROM points GROUP BY 1) USING (mission_id) GROUP BY ALL""")
def _(t):
    return ra.elevation_histogram(t.points)


ERR = """WITH b AS (SELECT mission_id, min(x) AS x0, min(y) AS y0, greatest(max(x)-min(x),1)*greatest(max(y)-min(y),1)*4/count(*) AS target FROM points GROUP BY 1),
 s AS (SELECT *, greatest(2.0e0, CASE WHEN 4>=target THEN 2.0e0 WHEN 25>=target THEN 5.0e0 WHEN 100>=target THEN 10.0e0 WHEN 400>=target THEN 20.0e0 WHEN 625>=target THEN 25.0e0 WHEN 2500>=target THEN 50.0e0 ELSE 100.0e0 END) AS cell_m FROM b),
 g AS (SELECT mission_id, CAST(floor((x-x0)/cell_m) AS BIGINT) AS ix, CAST(floor((y-y0)/cell_m) AS BIGINT) AS iy, count(*) AS points, cell_m, quantile_cont(residual,.5) AS median_m, quantile_cont(residual,.95) AS p95_m FROM points JOIN s USING (mission_id) GROUP BY ALL)"""


@query("f12_error_grid", f"{ERR} SELECT * FROM g", "median_m p95_m cell_m")
def _(t):
    return ra.error_grid(t.points)


@query("f12_error_summary", f"""{ERR} SELECT mission_id, count(*) FILTER (points>=3) AS measured_cells, count(*) FILTER (points<3) AS dropped_cells, min(median_m) FILTER (points>=3) AS min_median_m, max(median_m) FILTER (points>=3) AS max_median_m,
 quantile_cont(median_m,.5) FILTER (points>=3) AS p50_median_m, quantile_cont(median_m,.95) FILTER (points>=3) AS p95_median_m, quantile_cont(median_m,.99) FILTER (points>=3) AS p99_median_m FROM g GROUP BY 1""", "min_median_m max_median_m p50_median_m p95_median_m p99_median_m")
def _(t):
    return ra.error_grid_summary(ra.error_grid(t.points))


@query("f10_site_summary", f"""WITH o AS ({OCC}), c AS (SELECT mission_id, count(*) FILTER (points>=3) AS occupied_cells, count(*)*1.0e0 AS any_point_area_m2, any_value(nx)*any_value(ny) AS extent_cells, avg(ix) FILTER (points>=3)+0.5 AS gx, avg(iy) FILTER (points>=3)+0.5 AS gy FROM o GROUP BY 1),
 b AS (SELECT mission_id, min(x) AS lo_x, min(y) AS lo_y, max(x) AS hi_x, max(y) AS hi_y, count(*) AS points, min(z) AS z_min, max(z) AS z_max, avg(z) AS z_mean, quantile_cont(z,.5) AS z_median, quantile_cont(z,.005) AS robust_min, quantile_cont(z,.995) AS robust_max FROM points GROUP BY 1)
 SELECT mission_id, occupied_cells, extent_cells, occupied_cells*1.0e0 AS area_m2, occupied_cells/1e4 AS area_ha, any_point_area_m2, lo_x, lo_y, hi_x, hi_y, hi_x-lo_x AS size_x, hi_y-lo_y AS size_y, lo_x+gx AS centre_x, lo_y+gy AS centre_y, points, z_min, z_max, z_max-z_min AS relief, z_mean, z_median, robust_min, robust_max, robust_max-robust_min AS robust_relief,
 points/occupied_cells AS points_per_m2, CASE WHEN mission_id%2=0 THEN 'meters' ELSE 'reconstruction_units' END AS units, mission_id%2=0 AS placed FROM c JOIN b USING (mission_id)""", "area_m2 area_ha any_point_area_m2 lo_x lo_y hi_x hi_y size_x size_y centre_x centre_y z_min z_max relief z_mean z_median robust_min robust_max robust_relief points_per_m2")
def _(t):
    """Outlines are those of f9_hull; every second mission has an anchor."""
    m = t.points.select("mission_id").distinct()
    anchor = m.filter(F.col("mission_id") % 2 == 0).select("mission_id", F.lit(24.5).alias("lat0"), F.lit(120.9).alias("lon0"), F.lit(100.0).alias("alt0"))
    s = ra.site_summary(t.points, 1.0, anchor)
    return s.withColumn("placed", F.coalesce(F.abs(F.col("lat") - 24.5) < 0.001, F.lit(False))).drop("outline_area_m2", "lat", "lon")


@query("f21_density", f"SELECT mission_id, CAST(sum(points) AS BIGINT) AS points, count(*) FILTER (points>=3)*1.0e0 AS area_m2, sum(points)/(count(*) FILTER (points>=3)) AS points_per_m2 FROM ({OCC}) GROUP BY 1", "area_m2 points_per_m2")
def _(t):
    return ra.density(t.points)


KEYED = """WITH o AS (SELECT mission_id, min(x) AS ox, min(y) AS oy, min(z) AS oz, greatest(max(x)-min(x),max(y)-min(y),max(z)-min(z)) AS extent FROM points GROUP BY 1),
 k AS (SELECT points.*, CAST(floor((x-ox)/0.5e0) AS BIGINT) AS kx, CAST(floor((y-oy)/0.5e0) AS BIGINT) AS ky, CAST(floor((z-oz)/0.5e0) AS BIGINT) AS kz FROM points JOIN o USING (mission_id))"""
DIFF = f"""{KEYED}, d AS (SELECT mission_id, CASE WHEN max(epoch)='current' THEN 'added' ELSE 'removed' END AS kind, kx, ky, kz FROM k GROUP BY mission_id,kx,ky,kz HAVING count(DISTINCT epoch)=1)"""


@query("h1_voxel_diff", f"{DIFF} SELECT * FROM d")
def _(t):
    return ch.voxel_diff(t.baseline, t.current)


def change_clusters(t):
    b, c = t.baseline, t.current
    return ch.change_clusters(ch.voxel_diff(b, c), ch.joint_origin(b, c)), ch.joint_origin(b, c)



@query("h2_change_clusters")
def _(t):
    return change_clusters(t)[0]


@query("h3_change_index")
def _(t):
    return ch.change_index(*change_clusters(t))


@query("h4_semantic_change", f"""{KEYED}, m AS (SELECT mission_id, epoch, kx, ky, kz, arg_max(class, c*1000-class) AS l FROM (SELECT mission_id, epoch, kx, ky, kz, class, count(*) AS c FROM k GROUP BY ALL) GROUP BY ALL),
 j AS (SELECT coalesce(a.mission_id,b.mission_id) AS mission_id, CASE WHEN a.l IS NULL THEN 'added' WHEN b.l IS NULL THEN 'removed' WHEN a.l<>b.l THEN 'converted' END AS kind, coalesce(b.l,a.l) AS label FROM (SELECT * FROM m WHERE epoch='baseline') a FULL JOIN (SELECT * FROM m WHERE epoch='current') b USING (mission_id,kx,ky,kz))
 SELECT mission_id, kind, label, count(*) AS voxels, count(*)/sum(count(*)) OVER (PARTITION BY mission_id, kind) AS share FROM j WHERE kind IS NOT NULL GROUP BY 1,2,3""", "share")
def _(t):
    return ch.semantic_change(t.baseline, t.current)
