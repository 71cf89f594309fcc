"""Accuracy against references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skyfold.functions.stats import norm3
from skyfold.kernels.knn import knn
from skyfold.kernels.moments import fit_similarity, moved
from skyfold.kernels.ordered import with_adjacent
from skyfold.kernels.quantile import quantiles
from skyfold.operators.telemetry import KEY
from skyfold.session import once

# Certification and sanity limits.
CERT_RMSE = 1.0
CERT_P95 = 1.0
CERT_COVERAGE = 80.0
ROW_PAIRING_TRUST_M = 25.0
WITHIN = [0.25, 0.5, 1.0, 2.0, 5.0]
CHECKS = [("reprojection_median", "px", 2.0), ("cross_view_median", "m", 2.0), ("sparse_dense_median", "m", 2.0), ("trajectory_fit_median", "m", 5.0), ("scale_error_pct", "%", 1.0)]


def rmse(c: Column) -> Column:
    return F.sqrt(F.avg(c * c))


def error_stats(df: DataFrame, keys: list[str], col: str, prefix: str = "") -> DataFrame:
    """n, mean, median, RMSE, p90, p95, max of an error column."""
    df = once(df)
    a = df.groupBy(*keys).agg(F.count(col).alias(f"{prefix}n"), F.avg(col).alias(f"{prefix}mean"), rmse(F.col(col)).alias(f"{prefix}rmse"), F.max(col).alias(f"{prefix}max"))
    return a.join(quantiles(df, keys, **{f"{prefix}median": (col, 0.5), f"{prefix}p90": (col, 0.9), f"{prefix}p95": (col, 0.95)}), keys)


def checkpoint_metrics(pairs: DataFrame) -> DataFrame:
    """Errors of paired points ``x,y,z`` against ``ex,ey,ez``."""
    d = [F.col(f"e{a}") - F.col(a) for a in "xyz"]
    p = once(pairs.select(*KEY, norm3(*d).alias("err"), F.sqrt(d[0] * d[0] + d[1] * d[1]).alias("h"), F.abs(d[2]).alias("v")))
    s = error_stats(p, KEY, "err")
    hv = p.groupBy(*KEY).agg(rmse(F.col("h")).alias("horizontal_rmse"), rmse(F.col("v")).alias("vertical_rmse"), *[F.avg((F.col("err") <= w).cast("int")).alias(f"within_{int(w * 100)}cm") for w in WITHIN])
    return s.join(hv, KEY)


def nearest_errors(recon: DataFrame, ref: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Each reconstruction point with its nearest reference point and the offsets."""
    near = knn(recon, ref, KEY, carry=["x", "y", "z", *(carry or [])])
    near = near.select(*KEY, "point_id", "distance", *[F.col(a).alias(f"r{a}") for a in "xyz"], *(carry or []))
    return recon.select(*KEY, "point_id", "x", "y", "z").join(near, [*KEY, "point_id"])


def cloud_to_reference(recon: DataFrame, ref: DataFrame) -> DataFrame:
    """Accuracy (recon to ref), completeness (ref to recon within 1 m) and bounding-box share."""
    recon, ref = once(recon), once(ref)
    acc = error_stats(knn(recon, ref, KEY), KEY, "distance", "accuracy_")
    back = once(knn(ref, recon, KEY))
    cov = back.groupBy(*KEY).agg(F.avg((F.col("distance") <= 1).cast("int")).alias("completeness_1m"))
    box = recon.groupBy(*KEY).agg(*[f(a).alias(f"{n}{a}") for a in "xy" for n, f in (("lo", F.min), ("hi", F.max))])
    share = ref.join(box, KEY).groupBy(*KEY).agg((100 * F.avg((F.col("x").between(F.col("lox") - 5, F.col("hix") + 5) & F.col("y").between(F.col("loy") - 5, F.col("hiy") + 5)).cast("int"))).alias("bbox_share_pct"))
    return acc.join(cov, KEY).join(share, KEY)


def error_decomposition(recon: DataFrame, ref: DataFrame) -> DataFrame:
    """Horizontal, vertical and signed vertical medians."""
    n = once(nearest_errors(recon, ref))
    n = n.select(*KEY, F.sqrt((F.col("x") - F.col("rx")) ** 2 + (F.col("y") - F.col("ry")) ** 2).alias("h"), F.abs(F.col("z") - F.col("rz")).alias("v"), (F.col("z") - F.col("rz")).alias("s"))
    return quantiles(n, KEY, horizontal_median=("h", 0.5), vertical_median=("v", 0.5), signed_vertical_median=("s", 0.5))


def error_by_height(recon: DataFrame, ref: DataFrame, least: int = 50) -> DataFrame:
    """Median error per quartile of height."""
    n = once(nearest_errors(recon, ref))
    q = quantiles(n, KEY, q1=("z", 0.25), q2=("z", 0.5), q3=("z", 0.75))
    band = F.when(F.col("z") <= F.col("q1"), 0).when(F.col("z") <= F.col("q2"), 1).when(F.col("z") <= F.col("q3"), 2).otherwise(3)
    b = once(n.join(q, KEY).select(*KEY, band.alias("band"), "distance"))
    c = b.groupBy(*KEY, "band").agg(F.count(F.lit(1)).alias("points"))
    return c.join(quantiles(b, [*KEY, "band"], median=("distance", 0.5)), [*KEY, "band"]).withColumn("median", F.when(F.col("points") >= least, F.col("median")))


def error_by_class(recon: DataFrame, ref: DataFrame, ground_only: bool = False, least: int = 50) -> DataFrame:
    """Errors per reference class, or ground (class 2) against the rest."""
    n = once(nearest_errors(recon, ref, ["class"]))
    g = F.when(F.col("class") == 2, "ground").otherwise("rest") if ground_only else F.col("class").cast("string")
    n = n.select(*KEY, g.alias("part"), "distance")
    s = error_stats(n, [*KEY, "part"], "distance")
    return s.select(*KEY, "part", "n", *[F.when(F.col("n") >= least, F.col(c)).alias(c) for c in ("median", "rmse", "p95")])


def camera_errors(est: DataFrame, gt: DataFrame) -> DataFrame:
    """Component-mean RMSE on common frames and the registration rate; ``x,y,z`` on both sides."""
    j = gt.join(est.select(*KEY, "frame_id", *[F.col(a).alias(f"e{a}") for a in "xyz"]), [*KEY, "frame_id"], "left")
    sq = sum(((F.col(f"e{a}") - F.col(a)) ** 2 for a in "xyz"), F.lit(0.0))
    return j.groupBy(*KEY).agg(F.count("ex").alias("common"), F.sqrt(F.avg(sq) / 3).alias("rmse"), (F.count("ex") / F.count(F.lit(1))).alias("registration_rate"))


def split_control(gcp: DataFrame) -> DataFrame:
    """Check points whose id is no control point of the mission."""
    return gcp.filter("role = 'check'").join(gcp.filter("role = 'control'").select(*KEY, "id"), [*KEY, "id"], "left_anti")


def check_errors(checks: DataFrame) -> DataFrame:
    """Per-point norm errors of the check points."""
    d = checks.select(*KEY, norm3(*[F.col(f"e{a}") - F.col(a) for a in "xyz"]).alias("err"))
    return error_stats(d, KEY, "err")


def distance_errors(kd: DataFrame) -> DataFrame:
    """Errors of declared distances; ``a, b`` arrays and ``distance_m``."""
    span = F.sqrt(F.aggregate(F.zip_with("a", "b", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    e = once(kd.select(*KEY, F.abs(span - F.col("distance_m")).alias("err"), (F.abs(span - F.col("distance_m")) / F.col("distance_m") * 100).alias("pct")))
    a = e.groupBy(*KEY).agg(F.avg("err").alias("mae"), rmse(F.col("err")).alias("rmse"), F.max("err").alias("max"), F.avg("pct").alias("mean_pct"))
    return a.join(quantiles(e, KEY, median=("err", 0.5)), KEY)


def depth_error(pred: DataFrame, ref: DataFrame, relative: bool = True) -> DataFrame:
    """MAE and RMSE over common valid pixels after median-scale alignment."""
    k = [*KEY, "frame_id", "u", "v"]
    j = pred.filter("z > 0").select(*k, F.col("z").alias("p")).join(ref.filter("z > 0").select(*k, F.col("z").alias("t")), k)
    j = once(j)
    med = quantiles(j, KEY, mp=("p", 0.5), mt=("t", 0.5))
    s = F.col("mt") / F.col("mp") if relative else F.lit(1.0)
    d = j.join(med, KEY).select(*KEY, (F.col("p") * s - F.col("t")).alias("d"))
    return d.groupBy(*KEY).agg(F.count(F.lit(1)).alias("pixels"), F.avg(F.abs("d")).alias("mae"), rmse(F.col("d")).alias("rmse"))


def fit_residuals(pairs: DataFrame, fit: DataFrame) -> DataFrame:
    """Distance of every moved source position from its target."""
    p = [F.col(f"s{a}") for a in "xyz"]
    m = moved(*p)
    return pairs.join(fit.drop("n"), KEY).select(*pairs.columns, norm3(*[m[i] - F.col(f"d{a}") for i, a in enumerate("xyz")]).alias("residual"))


def ate(pairs: DataFrame) -> DataFrame:
    """Absolute trajectory error after a similarity fit."""
    pairs = once(pairs)
    return error_stats(fit_residuals(pairs, fit_similarity(pairs, KEY)), KEY, "residual")


def scale_error(pairs: DataFrame) -> DataFrame:
    """Percentiles of relative segment-length errors between consecutive frames."""
    p = _steps(pairs)
    return quantiles(p.filter("ld > 0").withColumn("err", F.abs(F.col("ls") - F.col("ld")) / F.col("ld")), KEY, p50=("err", 0.5), p90=("err", 0.9), p95=("err", 0.95))


def _steps(pairs: DataFrame) -> DataFrame:
    names = ["sx", "sy", "sz", "dx", "dy", "dz"]
    p = with_adjacent(pairs.select(*KEY, "frame_id", *names), KEY, ["frame_id"], F.floor(F.col("frame_id") / 100_000), prev={f"p_{n}": F.col(n) for n in names})
    length = lambda s: norm3(*[F.col(f"{s}{a}") - F.col(f"p_{s}{a}") for a in "xyz"])
    return p.select(*KEY, "frame_id", length("s").alias("ls"), length("d").alias("ld"))


def path_scale(pairs: DataFrame) -> DataFrame:
    """Scale error from the flight-path length."""
    a = _steps(pairs).groupBy(*KEY).agg(F.coalesce(F.sum("ls"), F.lit(0.0)).alias("reconstructed_m"), F.coalesce(F.sum("ld"), F.lit(0.0)).alias("reference_m"))
    ok = F.col("reference_m") > 0
    return a.select("*", F.when(ok, F.abs(F.col("reconstructed_m") - F.col("reference_m")) / F.col("reference_m")).alias("scale_error"), F.when(ok, F.col("reconstructed_m") / F.col("reference_m")).alias("scale_factor"))


def registration(pairs: DataFrame) -> DataFrame:
    """Similarity registration with residuals and the row-pairing guard."""
    pairs = once(pairs)
    fit = once(fit_similarity(pairs, KEY))
    s = error_stats(fit_residuals(pairs, fit), KEY, "residual", "residual_")
    j = fit.join(s, KEY)
    suspect = F.col("residual_median") > ROW_PAIRING_TRUST_M
    return j.select(*KEY, F.col("n").alias("matched"), "scale", (F.abs(F.col("scale") - 1) < 0.01).alias("scale_is_identity"), "residual_median", "residual_p95", "residual_rmse", ((F.col("n") >= 10) & ~suspect).alias("sufficient"), suspect.alias("row_pairing_suspect"))


def certify(stats: DataFrame) -> DataFrame:
    """Ordered refusals; ``has_reference, sufficient, rmse, p95, coverage_pct``."""
    return stats.withColumn(
        "certification",
        F.when(~F.col("has_reference"), "no independent reference")
        .when(~F.col("sufficient"), "insufficient georeferencing")
        .when(F.col("rmse").isNull(), "no independent reference")
        .when((F.col("rmse") > CERT_RMSE) | (F.col("p95") > CERT_P95), "above 1 m")
        .when(F.col("coverage_pct") < CERT_COVERAGE, "coverage limited")
        .otherwise("certified"),
    )


def capability(facts: DataFrame) -> DataFrame:
    return facts.withColumn(
        "capability",
        F.when(F.col("reference_validated") & F.col("has_reference"), "METRIC_VALIDATED")
        .when(F.col("georeferenced"), "GPS_GEOREFERENCED")
        .when(F.abs(F.col("scale_factor") - 1) > 1e-4, "SCALED")
        .when(F.col("relative_measured"), "RELATIVE_ONLY")
        .otherwise("NOT_MEASURED"),
    )


def relative_consistency(reports: DataFrame) -> DataFrame:
    """Flat consistency figures from nested report texts ``mission_id, sparse, dense`` with fallback keys."""
    def pick(*paths):
        return F.coalesce(*[F.get_json_object(c, p).try_cast("double") for c, p in paths])

    return reports.select(
        "mission_id",
        pick(("sparse", "$.reprojection.median_px"), ("sparse", "$.median_reprojection_error"), ("sparse", "$.mean_reproj_error")).alias("reprojection_median"),
        pick(("dense", "$.cross_view.median_m"), ("dense", "$.cross_view_disagreement_median_m")).alias("cross_view_median"),
        pick(("dense", "$.sparse_dense.median_m"), ("dense", "$.sparse_dense_nn_median")).alias("sparse_dense_median"),
        F.when(F.get_json_object("sparse", "$.reprojection").isNotNull(), "nested").otherwise("flat").alias("source"),
    )


def internal_checks(values: DataFrame) -> DataFrame:
    """One row per check with its criterion; columns of ``values`` named as in ``CHECKS``."""
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(u).alias("unit"), F.lit(c).alias("criterion"), F.col(n).alias("value")) for n, u, c in CHECKS])
    return values.select("mission_id", F.explode(rows).alias("c")).select("mission_id", "c.*").withColumn("measured", F.col("value").isNotNull()).withColumn("passed", F.col("value") <= F.col("criterion"))
