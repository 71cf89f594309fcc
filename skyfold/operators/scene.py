"""Semantics, objects, damage and terrain risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skyfold.functions.stats import clip
from skyfold.kernels.components import grid_components
from skyfold.kernels.knn import knn
from skyfold.kernels.moments import covariance3, eigen_sym3
from skyfold.kernels.ordered import with_running
from skyfold.kernels.quantile import quantiles, with_quantiles
from skyfold.operators.concepts import CONCEPT_CLASSES, SYNONYMS
from skyfold.operators.mesh import corners, face_components, face_geometry
from skyfold.operators.telemetry import KEY
from skyfold.session import cut, once

# Class ids by position, relation and severity limits.
RELATIONS = {"roof+wall": "supports", "roof+structure": "part_of", "structure+wall": "part_of", "structure+vegetation": "adjacent"}
CLASS_ID = {n: i for i, n in enumerate(["ground", "structure", "roof", "wall", "vegetation", "water", "vehicle", "unclassified"])}


def severity(area: Column, share: Column, near: Column) -> Column:
    return (
        F.when((area > 800) | (share > 0.20), "Critical").when((area > 200) | ((share > 0.05) & near), "High").when((area > 8) | near, "Medium").otherwise("Low")
    )


PLANE = ["gx", "gy", "gz", "gd"]


def over_plane(x: Column, y: Column, z: Column) -> Column:
    """Signed distance from the joined plane ``gx, gy, gz, gd``."""
    return F.col("gx") * x + F.col("gy") * y + F.col("gz") * z + F.col("gd")


def _fit_plane(v: DataFrame, least: int) -> DataFrame:
    """Plane ``gx, gy, gz, gd`` of least squares with its normal up, for missions of at least ``least`` rows."""
    c = cut(covariance3(v.select(*KEY, "x", "y", "z"), KEY).filter(F.col("n") >= least).withColumn("_e", eigen_sym3("cov")))
    n = [F.when(F.col("_e.vectors")[2] < 0, -1.0).otherwise(1.0) * F.col("_e.vectors")[i] for i in range(3)]
    return c.select(*KEY, *[e.alias(g) for e, g in zip(n, PLANE)], (-(n[0] * F.col("mx") + n[1] * F.col("my") + n[2] * F.col("mz"))).alias("gd"))


def ground_plane(v: DataFrame, tol: float) -> DataFrame:
    """Ground plane ``gx, gy, gz, gd`` of each mission from its lowest quarter, without the farthest quarter of the rest in each of four rounds.

    A plane that is not mostly level gives way to that of all vertices; one still tilted, or of fewer than 8 vertices, to the level
    of the twentieth percentile.
    """
    at = ["x", "y", "z"]
    v = once(v.select(*KEY, *at))
    low = with_quantiles(v, KEY, _q=("z", 0.25)).filter(F.col("z") <= F.col("_q")).select(*KEY, *at)
    for i in range(4):
        low = once(low)
        fit = _fit_plane(low, 8)
        if i < 3:
            far = low.join(fit, KEY).withColumn("_d", F.abs(over_plane(*[F.col(a) for a in at]))).select(*KEY, *at, "_d")
            low = with_quantiles(far, KEY, _q=("_d", 0.75)).filter(F.col("_d") <= F.col("_q")).select(*KEY, *at)
    tilted = fit.filter(F.col("gz") < 0.85).select(*KEY)
    fit = fit.filter(F.col("gz") >= 0.85).unionByName(_fit_plane(v.join(tilted, KEY, "left_semi"), 1))
    if tol < 1.0:
        fit = fit.filter(F.col("gz") >= 0.8)
    level = quantiles(v, KEY, _z=("z", 0.05)).join(fit, KEY, "left")
    return level.select(*KEY, *[F.coalesce(g, F.lit(d)).alias(g) for g, d in zip(PLANE, (0.0, 0.0, 1.0))], F.coalesce("gd", -F.col("_z")).alias("gd"))


def lowest_plane(v: DataFrame, least: int = 20, part: int = 10) -> DataFrame:
    """Plane of each mission's lowest vertices: one of ``part``, at least ``least``, and those as low as the last of them."""
    v = once(v.select(*KEY, "x", "y", "z"))
    level = v.groupBy(*KEY, "z").agg(F.count(F.lit(1)).alias("_c"))
    run = with_running(level, KEY, ["z"], F.floor(F.col("z") * 16), {"_upto": F.col("_c")})
    want = v.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n")).select(*KEY, F.least("_n", F.greatest(F.lit(least), F.floor(F.col("_n") / part))).alias("_k"))
    top = run.join(want, KEY).filter(F.col("_upto") >= F.col("_k")).groupBy(*KEY).agg(F.min("z").alias("_z"))
    return _fit_plane(v.join(top, KEY).filter(F.col("z") <= F.col("_z")), 1)


def classify_faces(v: DataFrame, f: DataFrame, tol: float = 0.5) -> DataFrame:
    """Rule label ``cls`` and ``confidence`` per face from height over the ground plane, facing and mean colour; grey without ``r, g, b``."""
    rgb = ["r", "g", "b"]
    key = [*KEY, "fid"]
    g = face_geometry(v, f.select(*key, "v0", "v1", "v2")).join(ground_plane(v, tol), KEY)
    if set(rgb) <= set(v.columns):
        mean = [((F.col(f"{c}0") + F.col(f"{c}1") + F.col(f"{c}2")) / 3).alias(f"_{c}") for c in rgb]
        g = g.join(corners(v, f.select(*key, "v0", "v1", "v2"), tuple(rgb)).select(*key, *mean), key)
    else:
        g = g.select("*", *[F.lit(150.0).alias(f"_{c}") for c in rgb])
    red, green, blue = F.col("_r"), F.col("_g"), F.col("_b")
    g = once(g.select("*", over_plane(F.col("cx"), F.col("cy"), F.col("cz")).alias("_h"), ((2 * green - red - blue) / F.greatest(red + green + blue, F.lit(1e-6))).alias("_eg")))
    h, eg, up, side = F.col("_h"), F.col("_eg"), F.abs("nz") > 0.7, F.abs("nz") < 0.35
    near, above = F.abs(h) <= 1.5 * tol, h > 0.5 * tol
    greenish, blueish = eg > 0.06, (blue > red + 15) & (blue > green + 15)
    high = above & ~near
    lab = (
        F.when(~above & blueish & ~greenish, "water").when(near & up, "ground").when(high & greenish & ~blueish, "vegetation")
        .when(high & ~greenish & ~blueish & up, "roof").when(high & ~greenish & ~blueish & side, "wall").otherwise("unclassified")
    )
    sure = {"water": F.lit(0.6), "ground": clip(1 - F.abs(h) / max(tol * 2, 1e-6), 0.35, 1.0), "vegetation": clip((eg - 0.06) * 6, 0.4, 0.95), "roof": F.lit(0.75), "wall": F.lit(0.7)}
    conf = F.coalesce(*[F.when(F.col("cls") == k, c) for k, c in sure.items()], F.lit(0.0))
    return g.withColumn("cls", lab).select(*KEY, "fid", "area", "cls", conf.alias("confidence"))


def class_coverage(labels: DataFrame) -> DataFrame:
    return labels.groupBy(*KEY, "cls").agg(F.count(F.lit(1)).alias("faces"), F.sum("area").alias("area"), F.avg("confidence").alias("confidence")).withColumn("share", F.col("area") / F.sum("area").over(Window.partitionBy(*KEY)))


def extract_objects(v: DataFrame, f: DataFrame, least: int = 6) -> DataFrame:
    """Connected faces of one label as objects with box, height, area and mean confidence."""
    c = face_components(f, ("label",))
    g = face_geometry(v, c)
    o = g.groupBy(*KEY, "label", "component").agg(
        F.count(F.lit(1)).alias("faces"), F.sum("area").alias("area"), F.avg("conf").alias("confidence"),
        *[F.min(f"lo_{a}").alias(f"{a}0") for a in "xyz"], *[F.max(f"hi_{a}").alias(f"{a}1") for a in "xyz"],
    )
    return o.filter(F.col("faces") >= least).withColumn("height", F.col("z1") - F.col("z0")).withColumnRenamed("component", "object_id")


def scene_graph(objects: DataFrame, share: float = 0.2) -> DataFrame:
    """Object pairs whose boxes are close: the largest axis gap is at most ``share`` of the larger dimension.

    Boxes are entered in coarse cells, widened by their own reach, so only
    neighbours meet.
    """
    dim = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("z1") - F.col("z0"))
    o = once(objects.withColumn("dim", dim))
    size = o.groupBy(*KEY).agg(F.greatest(F.max("dim") * (1 + share), F.lit(1e-6)).alias("cell"))
    o = o.join(size, KEY)
    span = lambda a, r: F.sequence(F.floor((F.col(f"{a}0") - r) / F.col("cell")), F.floor((F.col(f"{a}1") + r) / F.col("cell")))
    cols = ["object_id", "class", "dim", "x0", "x1", "y0", "y1", "z0", "z1"]
    r = F.col("cell") * share
    home = o.select(*KEY, *cols, F.floor(F.col("x0") / F.col("cell")).alias("gx"), F.floor(F.col("y0") / F.col("cell")).alias("gy"))
    wide = o.withColumn("gx", F.explode(F.sequence(F.floor((F.col("x0") - F.col("cell") - r) / F.col("cell")), F.floor((F.col("x1") + r) / F.col("cell"))))).withColumn("gy", F.explode(F.sequence(F.floor((F.col("y0") - F.col("cell") - r) / F.col("cell")), F.floor((F.col("y1") + r) / F.col("cell")))))
    b = wide.select(*KEY, "gx", "gy", *[F.col(c).alias(f"b_{c}") for c in cols])
    j = home.join(b.hint("merge"), [*KEY, "gx", "gy"]).filter("object_id < b_object_id")  # exploded rows look small to the planner, which would broadcast them
    gap = [F.greatest(F.col(f"b_{a}0") - F.col(f"{a}1"), F.col(f"{a}0") - F.col(f"b_{a}1"), F.lit(0.0)) for a in "xyz"]
    j = j.withColumn("gap_m", F.greatest(*gap)).filter(F.col("gap_m") <= share * F.greatest("dim", "b_dim"))
    over = F.greatest(F.lit(0.0), F.least("z1", "b_z1") - F.greatest("z0", "b_z0"))
    kind = F.array_join(F.array_sort(F.array("class", "b_class")), "+")
    relation = F.coalesce(F.create_map(*[F.lit(x) for pair in RELATIONS.items() for x in pair])[kind], F.when(over > 0, "touches").otherwise("near"))
    return j.select(*KEY, F.col("object_id").alias("src"), F.col("b_object_id").alias("dst"), "gap_m", over.alias("overlap_m"), relation.alias("relation"))


def assess_flood(faces: DataFrame, near_m: float = 25.0, least: float = 8.0) -> DataFrame:
    """The largest connected water surface of at least ``least`` m2, its severity, and whether anything built or parked is near.

    ``faces(mission_id, class, component, x, y, z, area)``: face centres with the number of their connected surface.
    """
    f = once(faces.withColumn("_id", F.monotonically_increasing_id()))
    surface = f.filter("class = 'water'").groupBy(*KEY, "component").agg(F.sum("area").alias("area"))
    big = surface.groupBy(*KEY).agg(F.max(F.struct("area", (-F.col("component")).alias("c"))).alias("b")).select(*KEY, F.col("b.area").alias("area"), (-F.col("b.c")).alias("component"))
    big = once(big.filter(F.col("area") >= least))
    at = ["_id", "x", "y", "z"]
    wet = f.filter("class = 'water'").join(big.select(*KEY, "component"), [*KEY, "component"], "left_semi").select(*KEY, *at)
    made = f.filter(F.col("class").isin("roof", "wall", "structure", "vehicle")).select(*KEY, *at)
    near = knn(wet, made, KEY, qid="_id", tid="_id").groupBy(*KEY).agg(F.min("distance").alias("d"))
    total = f.groupBy(*KEY).agg(F.sum("area").alias("all_area"))
    j = big.join(total, KEY).join(near, KEY, "left")
    close = F.coalesce(F.col("d") < near_m, F.lit(False))
    share = F.col("area") / F.greatest("all_area", F.lit(1e-9))
    return j.select(*KEY, "area", share.alias("share"), close.alias("near"), severity(F.col("area"), share, close).alias("severity"), (0.6 + 0.35 * F.least(F.col("area") / 400, F.lit(1.0))).alias("confidence"))


def infrastructure(objects: DataFrame, plane: DataFrame, tree_min: float = 1.0, road: str = "road") -> DataFrame:
    """Buildings, trees, towers, roads and vehicles per mission.

    A tree is vegetation whose box centre stands ``tree_min`` or more over the ground ``plane`` (``gx, gy, gz, gd``).  Towers have
    their least height and the least distance between two centres; a road is as wide as the longer side of its box.
    """
    o = objects.join(plane.select(*KEY, *PLANE), KEY, "left")
    o = once(o.select(*KEY, "object_id", "class", "height", "area", (F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("_w"), *PLANE, *[((F.col(f"{a}0") + F.col(f"{a}1")) / 2).alias(a) for a in "xyz"]))
    b, tower, way = F.col("class").isin("structure", "roof", "wall"), F.col("class").isin("tower", "structure"), F.col("class") == road
    over = over_plane(F.col("x"), F.col("y"), F.col("z"))
    t = (F.col("class") == "vegetation") & (over >= tree_min)
    out = o.groupBy(*KEY).agg(
        F.count_if(b).alias("buildings"), F.max(F.when(b, F.col("height"))).alias("max_building_height"), F.sum(F.when(F.col("class") == "roof", F.col("area"))).alias("roof_area"),
        F.max(F.when(b, F.col("area"))).alias("largest_footprint"), F.count_if(t).alias("trees"), F.avg(F.when(t, over)).alias("mean_tree_height"), F.max(F.when(t, over)).alias("max_tree_height"),
        F.min(F.when(tower, F.col("height"))).alias("min_tower_height"), F.count_if(way).alias("roads"), F.count_if(F.col("class") == "vehicle").alias("vehicles"),
    )
    towers = o.filter(tower).select(*KEY, "object_id", "x", "y", "z")
    gap = knn(towers, towers, KEY, qid="object_id", tid="object_id", exclude_self=True).groupBy(*KEY).agg(F.min("distance").alias("min_tower_gap"))
    width = quantiles(o.filter(way & (F.col("_w") > 0)), KEY, road_width=("_w", 0.5))
    return out.join(gap, KEY, "left").join(width, KEY, "left")


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy(*KEY).agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("Low", "Medium", "High", "Critical")])


def assess_collapse(debris: DataFrame, objects: DataFrame, margin: float = 12.0) -> DataFrame:
    """Debris ``debris_id, x, y, z, severity, confidence`` inside the widened box of a confident structure; boxes enter a coarse grid."""
    s = objects.filter(F.col("class").isin("structure", "roof", "wall") & (F.col("confidence") >= 0.3))
    cell = 50.0
    span = lambda a: F.sequence(F.floor((F.col(f"{a}0") - margin) / cell), F.floor((F.col(f"{a}1") + margin) / cell))
    box = [f"{a}{i}" for a in "xyz" for i in (0, 1)]
    s = s.withColumn("gx", F.explode(span("x"))).withColumn("gy", F.explode(span("y"))).select(*KEY, "gx", "gy", *box, F.col("object_id").alias("structure_id"))
    d = debris.withColumn("gx", F.floor(F.col("x") / cell)).withColumn("gy", F.floor(F.col("y") / cell))
    inside = [F.col(a).between(F.col(f"{a}0") - margin, F.col(f"{a}1") + margin) for a in "xyz"]
    j = d.join(s, [*KEY, "gx", "gy"]).filter(inside[0] & inside[1] & inside[2])
    j = j.groupBy(*KEY, "debris_id").agg(F.min("structure_id").alias("structure_id"), F.min("severity").alias("severity"), F.min("confidence").alias("_c"))
    return j.select(*KEY, "debris_id", "structure_id", "severity", F.least(F.lit(0.85), F.col("_c") + 0.15).alias("confidence"))


def assess_debris(faces: DataFrame, least: float = 4.0, low: float = 0.3, high: float = 3.0) -> DataFrame:
    """One debris row per mission: fragments of built or unclassified surface just above the ground.

    ``faces(mission_id, class, component, x, y, z, area, height)``, height over the ground plane.  A fragment is what a connected
    surface has between ``low`` and ``high``, of at least ``least`` m2; twelve fragments make it High.
    """
    f = once(faces)
    good = f.filter(F.col("class").isin("structure", "unclassified", "wall") & (F.col("height") > low) & (F.col("height") < high))
    part = good.groupBy(*KEY, "component").agg(F.sum("area").alias("area"), *[F.sum(a).alias(a) for a in "xyz"], F.count(F.lit(1)).alias("n"))
    own = part.groupBy(*KEY).agg(F.count_if(F.col("area") >= least).alias("fragments"), F.sum(F.when(F.col("area") >= least, F.col("area"))).alias("area"), *[(F.sum(a) / F.sum("n")).alias(a) for a in "xyz"])
    total = f.groupBy(*KEY).agg(F.sum("area").alias("all_area"))
    j = own.filter("fragments > 0").join(total, KEY)
    share = F.col("area") / F.greatest("all_area", F.lit(1e-9))
    level = F.when(F.col("fragments") >= 12, "High").otherwise(severity(F.col("area"), share, F.lit(False)))
    return j.select(*KEY, "fragments", "area", share.alias("share"), *"xyz", level.alias("severity"), (0.5 + 0.4 * F.least(F.col("fragments") / 15, F.lit(1.0))).alias("confidence"))


def coverage_raster(vertices: DataFrame, n: int = 48, blind: float = 0.4) -> DataFrame:
    """Mean confidence on an n x n raster whose index scales with n - 1."""
    b = vertices.groupBy(*KEY).agg(F.min("x").alias("lx"), F.min("y").alias("ly"), F.greatest(F.max("x") - F.min("x"), F.lit(1e-9)).alias("sx"), F.greatest(F.max("y") - F.min("y"), F.lit(1e-9)).alias("sy"))
    ix = ((F.col("x") - F.col("lx")) / F.col("sx") * (n - 1)).cast("long")
    iy = ((F.col("y") - F.col("ly")) / F.col("sy") * (n - 1)).cast("long")
    return vertices.join(b, KEY).groupBy(*KEY, ix.alias("ix"), iy.alias("iy")).agg(F.avg("conf").alias("confidence")).withColumn("blind", F.col("confidence") < blind)


def cell_causes(grid: DataFrame, flood: DataFrame, debris: DataFrame, size: float, flood_m: float = 25.0, debris_m: float = 15.0, steep_deg: float = 25.0) -> DataFrame:
    """Risky cells ``ix, iy`` with their ``cause``: near a flood, else near debris, else steep.

    ``grid`` is the slope grid; findings ``x, y, area`` reach all cells of its box, occupied or not, as water covers what no camera saw.
    """
    box = grid.groupBy(*KEY).agg(*[f(a).alias(f"{n}_{a}") for a in ("ix", "iy") for n, f in (("lo", F.min), ("hi", F.max))])
    near = _reached(flood, size, flood_m).withColumn("k", F.lit(1)).unionByName(_reached(debris, size, debris_m).withColumn("k", F.lit(2)))
    near = near.join(box, KEY).filter("ix BETWEEN lo_ix AND hi_ix AND iy BETWEEN lo_iy AND hi_iy").select(*KEY, "ix", "iy", "k")
    steep = grid.filter(F.col("slope_deg") > steep_deg).select(*KEY, "ix", "iy", F.lit(3).alias("k"))
    cause = F.element_at(F.array(*[F.lit(c) for c in ("flood", "debris", "slope")]), F.min("k"))
    return near.unionByName(steep).groupBy(*KEY, "ix", "iy").agg(cause.alias("cause"))


def risk_zones(cells: DataFrame, size: float, least: int = 2) -> DataFrame:
    """4-connected zones of risky cells ``ix, iy, cause`` with the dominant cause."""
    rank = F.when(F.col("cause") == "flood", 3).when(F.col("cause") == "debris", 2).otherwise(1)
    c = once(grid_components(once(cells), KEY, ["ix", "iy"]))
    n = c.groupBy(*KEY, "component", "cause").agg(F.count(F.lit(1)).alias("n"))
    dom = n.groupBy(*KEY, "component").agg(F.max_by("cause", F.struct("n", rank)).alias("cause"))
    z = c.groupBy(*KEY, "component").agg(F.count(F.lit(1)).alias("cells"), ((F.avg("ix") + 0.5) * size).alias("cx"), ((F.avg("iy") + 0.5) * size).alias("cy"))
    return z.join(dom, [*KEY, "component"]).filter(F.col("cells") >= least).withColumn("area_m2", F.col("cells") * size * size).drop("component")


def slope_grid(vertices: DataFrame, size: float) -> DataFrame:
    """Slope in degrees of occupied cells by central differences, one-sided at gaps."""
    c = once(vertices.groupBy(*KEY, F.floor(F.col("x") / size).alias("ix"), F.floor(F.col("y") / size).alias("iy")).agg(F.avg("z").alias("z")))
    out = c
    for a, o in (("ix", "iy"), ("iy", "ix")):
        for s, n in ((1, "n"), (-1, "p")):
            out = out.join(c.select(*KEY, (F.col(a) - s).alias(a), o, F.col("z").alias(f"{a}{n}")), [*KEY, a, o], "left")
    d = lambda a: F.when(F.col(f"{a}n").isNotNull() & F.col(f"{a}p").isNotNull(), (F.col(f"{a}n") - F.col(f"{a}p")) / (2 * size)).otherwise(F.coalesce((F.col(f"{a}n") - F.col("z")) / size, (F.col("z") - F.col(f"{a}p")) / size, F.lit(0.0)))
    return out.select(*KEY, "ix", "iy", "z", F.degrees(F.atan(F.sqrt(d("ix") ** 2 + d("iy") ** 2))).alias("slope_deg"))


def mesh_support(v: DataFrame, points: DataFrame, voxel: float) -> DataFrame:
    """Share of vertices with a dense point within one voxel."""
    n = once(knn(v, points, KEY, qid="vid"))
    a = n.groupBy(*KEY).agg(F.count(F.lit(1)).alias("vertices"), (100 * F.avg((F.col("distance") <= voxel).cast("int"))).alias("supported_pct"))
    return a.join(quantiles(n, KEY, median_m=("distance", 0.5), p95_m=("distance", 0.95)), KEY)


def _reached(findings: DataFrame, size: float, buffer: float) -> DataFrame:
    """Cells whose centre lies within ``sqrt(max(area, 1) / pi) + buffer`` of a finding ``x, y, area``."""
    r = F.sqrt(F.greatest("area", F.lit(1.0)) / F.lit(3.141592653589793)) + buffer
    f = findings.withColumn("r", r)
    span = lambda a: F.sequence(F.floor((F.col(a) - F.col("r")) / size), F.floor((F.col(a) + F.col("r")) / size))
    f = f.withColumn("ix", F.explode(span("x"))).withColumn("iy", F.explode(span("y")))
    hit = F.sqrt(((F.col("ix") + 0.5) * size - F.col("x")) ** 2 + ((F.col("iy") + 0.5) * size - F.col("y")) ** 2) <= F.col("r")
    return f.filter(hit).select(*KEY, "ix", "iy").distinct()


def exposure(cells: DataFrame, findings: DataFrame, size: float, buffer: float = 25.0) -> DataFrame:
    """Cells ``ix, iy`` within ``sqrt(max(area, 1) / pi) + buffer`` of a finding ``x, y, area``.

    A finding enters the cells of its own disc, so the join is by cell.
    """
    hot = _reached(findings, size, buffer).withColumn("exposed", F.lit(True))
    return cells.join(hot, [*KEY, "ix", "iy"], "left").withColumn("exposed", F.coalesce("exposed", F.lit(False)))


def terrain_stats(vertices: DataFrame) -> DataFrame:
    """Elevation range above the tenth percentile and mean height per mission."""
    a = vertices.groupBy(*KEY).agg(F.max("z").alias("z_max"), F.avg("z").alias("z_mean"))
    return a.join(quantiles(vertices, KEY, z_p10=("z", 0.1)), KEY).withColumn("elevation_range", F.col("z_max") - F.col("z_p10"))


def concept_evidence(objects: DataFrame, prompts: DataFrame, faces: DataFrame, least: float = 0.3) -> DataFrame:
    """Evidence behind each concept of a prompt: ``prompts(prompt_id, text)``, ``faces(class)``, ``objects(class, area, volume, confidence)``.

    Classes are summed first, so the join meets a handful of rows.
    """
    words = F.split(F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N} ]", " ")), " +")
    asked = prompts.select("prompt_id", F.explode(words).alias("word")).distinct()
    spark = objects.sparkSession
    syn = spark.createDataFrame(list(SYNONYMS.items()), "word string, concept string")
    classes = spark.createDataFrame([(c, k) for c, ks in CONCEPT_CLASSES.items() for k in ks], "concept string, class string")
    f = classes.join(faces.groupBy("class").agg(F.count(F.lit(1)).alias("n")), "class", "left").groupBy("concept").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("faces"))
    o = objects.filter(F.col("confidence") >= least).groupBy("class").agg(F.count(F.lit(1)).alias("i"), F.sum("area").alias("a"), F.sum("volume").alias("v"))
    o = classes.join(o, "class", "left").groupBy("concept").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("i", "instances"), ("a", "area"), ("v", "volume"))])
    total = faces.agg(F.count(F.lit(1)).alias("all"))
    per = f.join(o, "concept").join(total).select("concept", "faces", F.coalesce(F.col("faces") / F.col("all"), F.lit(0.0)).alias("face_share"), "instances", "area", "volume")
    return asked.join(syn, "word").select("prompt_id", "concept").distinct().join(per, "concept")


def concept_instances(objects: DataFrame, least: float = 0.3, top: int = 12) -> DataFrame:
    """The ``top`` largest confident objects of each concept."""
    classes = objects.sparkSession.createDataFrame([(c, k) for c, ks in CONCEPT_CLASSES.items() for k in ks], "concept string, class string")
    w = Window.partitionBy("concept").orderBy(F.desc("area"), "object_id")
    return objects.filter(F.col("confidence") >= least).join(classes, "class").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def prune_debris(v: DataFrame, f: DataFrame, max_faces: int = 50, factor: float = 5.0) -> DataFrame:
    """Faces without small patches that lie far from the main patch of their mission."""
    c = once(face_components(f))
    n = once(c.groupBy(*KEY, "component").agg(F.count(F.lit(1)).alias("n")))
    main = n.groupBy(*KEY).agg((-F.max(F.struct("n", (-F.col("component")).alias("c")))["c"]).alias("main"))
    small = n.join(main, KEY).filter((F.col("component") != F.col("main")) & (F.col("n") <= max_faces)).select(*KEY, "component")
    at = lambda d: d.select(*KEY, "component", F.explode(F.array("v0", "v1", "v2")).alias("vid")).distinct().join(v.select(*KEY, "vid", "x", "y", "z"), [*KEY, "vid"])
    q = at(c.join(small, [*KEY, "component"], "left_semi"))
    t = at(c.join(main.select(*KEY, F.col("main").alias("component")), [*KEY, "component"], "left_semi"))
    edge = quantiles(face_geometry(v, f), KEY, edge=("longest", 0.5))
    near = knn(q.select(*KEY, "vid", "x", "y", "z").distinct(), t.select(*KEY, "vid", "x", "y", "z").distinct(), KEY, qid="vid", tid="vid")
    far = q.join(near.select(*KEY, "vid", "distance"), [*KEY, "vid"]).groupBy(*KEY, "component").agg(F.min("distance").alias("d")).join(edge, KEY).filter(F.col("d") > factor * F.col("edge")).select(*KEY, "component")
    return c.join(far, [*KEY, "component"], "left_anti").select(*f.columns)


def vertex_confidence(v: DataFrame, points: DataFrame, gps: DataFrame, reach: float) -> DataFrame:
    """Cloud confidence (nearest point within ``reach``, else 1) times the GPS factor ``.6 + .4 q / 100``."""
    near = knn(v, points, KEY, qid="vid", carry=["confidence"])
    c = near.select(*KEY, "vid", F.when(F.col("distance") <= reach, F.col("confidence")).otherwise(1.0).alias("cloud"))
    return c.join(gps, KEY, "left").select(*KEY, "vid", (F.col("cloud") * (0.6 + 0.4 * F.coalesce("gps_score", F.lit(100.0)) / 100)).alias("confidence"))
