"""Mesh tables: ``vertices(mission_id, vid, x, y, z)`` and ``faces(mission_id, fid, v0, v1, v2)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from skyfold.functions.stats import norm3
from skyfold.kernels.components import label_components
from skyfold.operators.telemetry import KEY
from skyfold.session import once


def corners(v: DataFrame, f: DataFrame, extra: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Faces with the coordinates of their three corners; vertices lie so dense in files that the planner would broadcast millions of them."""
    out = f
    for i in range(3):
        out = out.join(v.select(*KEY, F.col("vid").alias(f"v{i}"), *[F.col(c).alias(f"{c}{i}") for c in extra]).hint("merge"), [*KEY, f"v{i}"])
    return out


def face_geometry(v: DataFrame, f: DataFrame) -> DataFrame:
    """Area, unit normal (zero when degenerate), centroid and longest edge per face."""
    c = corners(v, f)
    a = {x: F.col(f"{x}1") - F.col(f"{x}0") for x in "xyz"}
    b = {x: F.col(f"{x}2") - F.col(f"{x}0") for x in "xyz"}
    n = [a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"]]
    length = norm3(*n)
    edge = [norm3(*[F.col(f"{x}{i}") - F.col(f"{x}{j}") for x in "xyz"]) for i, j in ((0, 1), (1, 2), (2, 0))]
    return c.select(
        *f.columns, (length / 2).alias("area"),
        *[F.when(length > 1e-12, e / F.when(length > 0, length)).otherwise(0.0).alias(k) for e, k in zip(n, ("nx", "ny", "nz"))],
        *[((F.col(f"{x}0") + F.col(f"{x}1") + F.col(f"{x}2")) / 3).alias(f"c{x}") for x in "xyz"],
        F.greatest(*edge).alias("longest"),
        *[F.least(*[F.col(f"{x}{i}") for i in range(3)]).alias(f"lo_{x}") for x in "xyz"],
        *[F.greatest(*[F.col(f"{x}{i}") for i in range(3)]).alias(f"hi_{x}") for x in "xyz"],
    )


def vertex_normals(v: DataFrame, f: DataFrame) -> DataFrame:
    """Area-weighted vertex normals."""
    g = face_geometry(v, f).select(*KEY, F.explode(F.array("v0", "v1", "v2")).alias("vid"), *[(F.col(n) * F.col("area")).alias(n) for n in ("nx", "ny", "nz")])
    s = g.groupBy(*KEY, "vid").agg(*[F.sum(n).alias(n) for n in ("nx", "ny", "nz")])
    length = norm3(F.col("nx"), F.col("ny"), F.col("nz"))
    return s.select(*KEY, "vid", *[F.when(length > 1e-12, F.col(n) / length).otherwise(0.0).alias(n) for n in ("nx", "ny", "nz")])


def face_edges(f: DataFrame) -> DataFrame:
    """Three sorted edges per face."""
    pair = lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    return f.select(*KEY, "fid", F.explode(F.array(pair("v0", "v1"), pair("v1", "v2"), pair("v2", "v0"))).alias("e")).select(*KEY, "fid", "e.a", "e.b")


def edges(f: DataFrame) -> DataFrame:
    """Edges with the number of faces on them."""
    return face_edges(f).groupBy(*KEY, "a", "b").agg(F.count(F.lit(1)).alias("faces"))


def topology(v: DataFrame, f: DataFrame) -> DataFrame:
    e = edges(f).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("edges"), F.count_if(F.col("faces") == 1).alias("boundary_edges"), F.count_if(F.col("faces") > 2).alias("nonmanifold_edges")
    )
    n = v.groupBy(*KEY).agg(F.count(F.lit(1)).alias("vertices")).join(f.groupBy(*KEY).agg(F.count(F.lit(1)).alias("faces")), KEY, "left")
    j = n.join(e, KEY, "left").fillna(0)
    return j.select("*", ((F.col("boundary_edges") == 0) & (F.col("nonmanifold_edges") == 0) & (F.col("faces") > 0)).alias("watertight"), (F.col("vertices") - F.col("edges") + F.col("faces")).alias("euler"))


def _edge_links(f: DataFrame, extra: list[str]) -> DataFrame:
    """Each face linked to the lowest face on every edge: a chain, never all pairs of an edge."""
    keys = [*KEY, *extra]
    e = face_edges(f.select(*KEY, "fid", "v0", "v1", "v2")).join(f.select("fid", *keys), [*KEY, "fid"]) if extra else face_edges(f)
    e = once(e)
    low = e.groupBy(*keys, "a", "b").agg(F.min("fid").alias("low"))
    return e.join(low, [*keys, "a", "b"]).filter("fid <> low").select(F.struct(*keys, "fid").alias("a"), F.struct(*keys, F.col("low").alias("fid")).alias("b")).distinct()


def face_components(f: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Faces with the smallest face id of their edge-connected patch, optionally within ``by``."""
    keys = [*KEY, *by]
    return label_components(f, _edge_links(f, list(by)), F.struct(*keys, "fid")).withColumn("component", F.col("component.fid"))


def vertex_components(v: DataFrame, f: DataFrame) -> DataFrame:
    """Vertices with the smallest vertex id of their connected part."""
    e = edges(f).select(F.struct(*KEY, F.col("a").alias("vid")).alias("a"), F.struct(*KEY, F.col("b").alias("vid")).alias("b"))
    return label_components(v, e, F.struct(*KEY, "vid")).withColumn("component", F.col("component.vid"))


def submesh(v: DataFrame, f: DataFrame, cond) -> tuple[DataFrame, DataFrame]:
    """Faces under a condition and the vertices they use."""
    kept = f.filter(cond)
    used = kept.select(*KEY, F.explode(F.array("v0", "v1", "v2")).alias("vid")).distinct()
    return v.join(used, [*KEY, "vid"], "left_semi"), kept


def weld(v: DataFrame, f: DataFrame, eps: float) -> tuple[DataFrame, DataFrame]:
    """Vertices that share a rounded position become the first of them."""
    v = once(v)
    key = [F.round(F.col(c) / eps).cast("long").alias(f"k{c}") for c in "xyz"]
    k = v.select(*KEY, "vid", *key)
    first = k.groupBy(*KEY, "kx", "ky", "kz").agg(F.min("vid").alias("keep"))
    remap = once(k.join(first, [*KEY, "kx", "ky", "kz"]).select(*KEY, "vid", "keep"))
    out = f
    for i in range(3):
        out = out.join(remap.select(*KEY, F.col("vid").alias(f"v{i}"), F.col("keep").alias(f"_k{i}")), [*KEY, f"v{i}"]).drop(f"v{i}").withColumnRenamed(f"_k{i}", f"v{i}")
    return v.join(remap.filter("vid = keep").select(*KEY, "vid"), [*KEY, "vid"], "left_semi"), out.select(*f.columns)


def mesh_quality(v: DataFrame, f: DataFrame) -> DataFrame:
    """Degenerate faces, normal conflicts over shared edges and extents."""
    g = once(face_geometry(v, f))
    same = (F.col("v0") == F.col("v1")) | (F.col("v1") == F.col("v2")) | (F.col("v0") == F.col("v2"))
    base = g.groupBy(*KEY).agg(F.count(F.lit(1)).alias("faces"), F.count_if(same | (2 * F.col("area") <= 1e-12)).alias("degenerate"))
    n = face_edges(f).join(g.select(*KEY, "fid", "nx", "ny", "nz"), [*KEY, "fid"])
    # two-face edges: |n1 + n2|^2 = |n1|^2 + |n2|^2 + 2 n1.n2, so sums give the dot product
    two = n.groupBy(*KEY, "a", "b").agg(
        F.count(F.lit(1)).alias("c"), *[F.sum(x).alias(f"s{x}") for x in ("nx", "ny", "nz")], F.sum(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2).alias("q")
    ).filter("c = 2")
    dot = (F.col("snx") ** 2 + F.col("sny") ** 2 + F.col("snz") ** 2 - F.col("q")) / 2
    conf = two.groupBy(*KEY).agg((100.0 * F.avg((dot < -1e-12).cast("int"))).alias("conflict_percent"))
    ext = v.groupBy(*KEY).agg(*[(F.max(a) - F.min(a)).alias(f"extent_{a}") for a in "xyz"])
    return base.join(conf, KEY, "left").join(ext, KEY)


def volume(v: DataFrame, f: DataFrame) -> DataFrame:
    """Signed volume of closed patches, null for open ones."""
    lab = once(face_components(f))
    c = corners(v, lab)
    p = {i: [F.col(f"{a}{i}") for a in "xyz"] for i in range(3)}
    triple = (
        p[0][0] * (p[1][1] * p[2][2] - p[1][2] * p[2][1]) + p[0][1] * (p[1][2] * p[2][0] - p[1][0] * p[2][2]) + p[0][2] * (p[1][0] * p[2][1] - p[1][1] * p[2][0])
    ) / 6
    vol = c.groupBy(*KEY, "component").agg(F.sum(triple).alias("v"), F.count(F.lit(1)).alias("faces"))
    e = face_edges(lab).join(lab.select(*KEY, "fid", "component"), [*KEY, "fid"]).groupBy(*KEY, "component", "a", "b").agg(F.count(F.lit(1)).alias("c"))
    closed = e.groupBy(*KEY, "component").agg(F.bool_and(F.col("c") == 2).alias("closed"))
    return vol.join(closed, [*KEY, "component"]).select(*KEY, "component", "faces", F.when(F.col("closed"), F.col("v")).alias("volume"))


def vertex_majority(f: DataFrame, label: str = "label") -> DataFrame:
    """Most frequent face label per vertex, ties to the lowest."""
    n = f.select(*KEY, F.explode(F.array("v0", "v1", "v2")).alias("vid"), F.col(label).alias("l")).groupBy(*KEY, "vid", "l").agg(F.count(F.lit(1)).alias("c"))
    return n.groupBy(*KEY, "vid").agg((-F.max(F.struct("c", (-F.col("l")).alias("m")))["m"]).alias("label"))


def mesh_audit(v: DataFrame, f: DataFrame, voxel: float, small: int = 50) -> DataFrame:
    """Edge lengths, patch shares and facing of a mesh."""
    from skyfold.kernels.quantile import quantiles

    g = once(face_geometry(v, face_components(f)))
    q = quantiles(g, KEY, edge_median=("longest", 0.5), edge_p95=("longest", 0.95))
    patches = g.groupBy(*KEY, "component").agg(F.count(F.lit(1)).alias("c"))
    p = patches.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("patches"), (F.max("c") / F.sum("c")).alias("largest_share"), (F.coalesce(F.sum(F.when(F.col("c") < small, F.col("c"))), F.lit(0)) / F.sum("c")).alias("small_share")
    )
    a = g.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("faces"), F.max("longest").alias("edge_max"), F.count_if(F.col("longest") > 10 * voxel).alias("long_faces"),
        F.avg((F.col("nz") > 0.5).cast("int")).alias("up_share"), F.avg((F.col("nz") < -0.5).cast("int")).alias("down_share"), F.count_if(F.col("hi_z") - F.col("lo_z") > 10).alias("tall_faces"),
    )
    return a.join(q, KEY).join(p, KEY)


# Vertices of a large component, and below which a far one counts as noise.
LARGE, TINY = 100, 10


def classify_components(v: DataFrame, f: DataFrame, cloud: DataFrame, threshold: float) -> DataFrame:
    """``component, vertices``, box, ``median_support_m`` and ``class`` of every connected part; nothing is removed.

    Support is the median distance of a part's vertices to the cloud: within the threshold a part is supported (large or small), beyond
    twice of it unsupported, between them weakly supported; a tiny part beyond the threshold is a noise candidate.  Without a cloud a
    part is unclassified.
    """
    from skyfold.kernels.knn import knn
    from skyfold.kernels.quantile import quantiles

    own = once(vertex_components(v.select(*KEY, "vid", *"xyz"), f))
    near = knn(own, cloud, KEY, qid="vid").select(*KEY, "vid", "distance")
    part = [*KEY, "component"]
    box = own.groupBy(*part).agg(F.count(F.lit(1)).alias("vertices"), *[g(a).alias(f"{n}_{a}") for a in "xyz" for n, g in (("lo", F.min), ("hi", F.max))])
    med = quantiles(own.join(near, [*KEY, "vid"]), part, median_support_m=("distance", 0.5))
    n, d = F.col("vertices"), F.col("median_support_m")
    kind = (
        F.when(d.isNull(), "unclassified (no support distances)").when((n < TINY) & (d > threshold), "noise_candidate")
        .when((d <= threshold) & (n >= LARGE), "supported_large").when(d <= threshold, "supported_small").when(d > 2 * threshold, "unsupported").otherwise("weakly_supported")
    )
    return box.join(med, part, "left").withColumn("class", kind)
