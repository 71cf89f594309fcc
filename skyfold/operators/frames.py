"""Frame selection, pairs and score reports over tables of scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from skyfold.functions import geo
from skyfold.functions.stats import clip, grade, present
from skyfold.kernels.ordered import with_running
from skyfold.kernels.quantile import quantiles
from skyfold.operators.telemetry import KEY, row_block
from skyfold.session import cut, once

# Condition weights, bounds and grades of the reports.
CONDITION_WEIGHT = {"fog_haze": 1.4, "smoke_dust": 1.2, "lowlight": 1.0, "motion_blur": 1.5, "sun_glare": 1.0, "strong_shadows": 0.8, "lens_artifacts": 1.3, "cloud_cover": 0.7, "rain_streaks": 1.2}
WEATHER_WEIGHT = {"rain_streaks": 0.7, "fog_haze": 0.6, "smoke_dust": 0.6, "lowlight": 0.5, "motion_blur": 0.5, "sun_glare": 0.4, "strong_shadows": 0.3, "cloud_cover": 0.2, "lens_artifacts": 0.8}
VISIBILITY_MAX = 15000.0
ENV_GRADES = [(85.0, "Excellent"), (70.0, "Good"), (50.0, "Fair"), (30.0, "Poor")]
BLUR_FLOOR = 100.0
SSIM_LIMIT = 0.85
MOTION_FLOOR = 0.05
STRATEGIES = [
    ("fog_haze", 0.3, "enable_dehaze"),
    ("rain_streaks", 0.3, "robustify_matching"),
    ("motion_blur", 0.3, "robustify_matching"),
    ("lowlight", 0.4, "raise_confidence_floor"),
    ("sun_glare", 0.4, "mask_glare_frames"),
    ("lens_artifacts", 0.3, "clean_optics"),
]


def lookup(values: dict[str, float], key: Column, default: float) -> Column:
    m = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, key), F.lit(default))


def candidate_frames(video: DataFrame, mode: str = "fps", value: float = 2.0) -> DataFrame:
    """Frame numbers to score; ``video(mission_id, n_frames, fps)``; mode all, every, fps or interval."""
    step = {
        "all": F.lit(1),
        "every": F.lit(int(value)),
        "fps": (F.col("fps") / value).cast("int"),
        "interval": (F.col("fps") * value).cast("int"),
    }[mode]
    v = video.filter("n_frames > 0").withColumn("step", F.greatest(F.lit(1), step))
    return v.select(*KEY, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_frames") - 1, F.col("step").cast("long"))).alias("frame_num"))


def score_frames(df: DataFrame) -> DataFrame:
    """Composite score and first rejection reason; ``raw_blur, sharpness, exposure, motion, ssim, bright`` in."""
    norm = F.least(F.col("raw_blur") / (3 * BLUR_FLOOR), F.lit(1.0))
    composite = 0.30 * norm + 0.25 * F.col("sharpness") + 0.25 * F.col("exposure") + 0.20 * (1 - F.col("motion"))
    reason = (
        F.when(F.col("raw_blur") < BLUR_FLOOR, "blurry")
        .when(F.col("exposure") < 0.1, F.when(F.col("bright"), "overexposed").otherwise("underexposed"))
        .when((F.col("ssim") >= SSIM_LIMIT) & (F.col("motion") < MOTION_FLOOR), "duplicate")
    )
    return df.select("*", norm.alias("blur_norm"), composite.alias("composite"), reason.alias("rejection_reason"))


def hist_exposure(h: Column) -> Column:
    """Exposure score of a 256-bin histogram column."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    extreme = (total(F.slice(h, 1, 10)) + total(F.slice(h, 247, 10))) / total(h)
    return clip(1 - (extreme - 0.05) / 0.45)


def hist_entropy(h: Column) -> Column:
    """Shannon entropy in bits."""
    total = F.aggregate(h, F.lit(0.0), lambda s, v: s + v)
    return F.log2(total) - F.aggregate(h, F.lit(0.0), lambda s, v: s + F.when(v > 0, v * F.log2(v)).otherwise(0.0)) / total


def _scan_segment(pdf: pd.DataFrame, memory: int, bits: int) -> pd.DataFrame:
    """Sequential near-duplicate scan of one segment from its incoming kept hashes."""
    pdf = pdf.sort_values("frame_num", kind="stable")
    first = pdf["carried"].iloc[0]
    recent = [int(h) for h in first] if first is not None else []
    kept = []
    for h, moving in zip(pdf["phash"].to_numpy(), pdf["motion"].to_numpy() >= MOTION_FLOOR):
        dup = not moving and any((int(h) ^ k).bit_count() <= bits for k in recent)
        kept.append(not dup)
        if not dup:
            recent = [*recent, int(h)][-memory:]
    return pd.DataFrame({"mission_id": pdf["mission_id"], "frame_num": pdf["frame_num"], "segment": pdf["segment"], "kept": kept, "leaving": [recent] * len(pdf)})


def dedup_phash(frames: DataFrame, memory: int = 10, bits: int = 8, segment: int = 5000) -> DataFrame:
    """Frames with ``kept``: not within ``bits`` of the last ``memory`` kept frames unless moving.

    The rule is sequential, so a mission is cut into bounded segments.  Each
    round scans every segment from the hashes its predecessor left in the round
    before; only segments whose incoming hashes changed run again, and the
    result is exact once none did.
    """
    base = cut(frames.select(*KEY, "frame_num", "phash", "motion", F.floor(F.col("frame_num") / segment).alias("segment")))
    key = f"mission_id {base.schema['mission_id'].dataType.simpleString()}"
    schema = f"{key}, frame_num long, segment long, kept boolean, leaving array<long>"
    none = F.lit(None).cast("array<long>")
    order = Window.partitionBy(*KEY).orderBy("segment")
    done = cut(base.withColumn("carried", none).groupBy(*KEY, "segment").applyInPandas(lambda p: _scan_segment(p, memory, bits), schema))
    carried = done.select(*KEY, "segment").distinct().withColumn("carried", none)
    while True:
        left = done.groupBy(*KEY, "segment").agg(F.first("leaving").alias("leaving"))
        now = cut(left.select(*KEY, "segment", F.lag("leaving").over(order).alias("carried")))
        changed = now.join(carried.withColumnRenamed("carried", "old"), [*KEY, "segment"]).filter(~F.col("carried").eqNullSafe(F.col("old"))).select(*KEY, "segment", "carried")
        changed = once(changed)
        if changed.isEmpty():
            return frames.join(done.select(*KEY, "frame_num", "kept"), [*KEY, "frame_num"])
        again = base.join(changed, [*KEY, "segment"]).groupBy(*KEY, "segment").applyInPandas(lambda p: _scan_segment(p, memory, bits), schema)
        done = cut(done.join(changed, [*KEY, "segment"], "left_anti").unionByName(again))
        carried = now


def select_frames(frames: DataFrame, k: int, arc: DataFrame | None = None) -> DataFrame:
    """At most ``k`` frames spread over the trajectory: the best composite of each equal part.

    ``arc(mission_id, frame_num, step_m)`` gives the way since the previous
    frame; without it the frame rank is the coordinate.
    """
    f = frames.select(*KEY, "frame_num", "composite")
    step = F.lit(0.0)
    if arc is not None:
        f = f.join(arc.select(*KEY, "frame_num", "step_m"), [*KEY, "frame_num"], "left")
        step = F.coalesce("step_m", F.lit(0.0))
    f = once(with_running(f, KEY, ["frame_num"], row_block("frame_num"), {"cum": step}, rank="rk", total="n"))
    f = f.withColumn("cum", F.col("cum") if arc is not None else (F.col("rk") - 1).cast("double"))
    total = f.groupBy(*KEY).agg(F.max("cum").alias("total"))
    f = once(f.join(total, KEY))
    part = F.col("total") / k
    small = f.filter(F.col("n") <= k).select(*KEY, "frame_num")
    big = f.filter(F.col("n") > k)
    at = F.when(part > 0, F.floor(F.col("cum") / part)).otherwise(F.lit(0))
    near = F.filter(F.array(at - 1, at, at + 1), lambda b: (b >= 0) & (b < k) & (F.col("cum") >= b * part) & (F.col("cum") <= F.when(b == k - 1, F.col("total")).otherwise((b + 1) * part)))
    near = F.when(part > 0, near).otherwise(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    best = big.withColumn("b", F.explode(near)).groupBy(*KEY, "b").agg((-F.max(F.struct("composite", (-F.col("frame_num")).alias("f")))["f"]).alias("frame_num"))
    every = big.groupBy(*KEY).agg(F.first("n").alias("n"), F.first("total").alias("total")).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))))
    empty = every.join(best.select(*KEY, "b"), [*KEY, "b"], "left_anti")
    place = F.least(F.bround(F.col("b") * F.col("total") / k / F.greatest("total", F.lit(1e-9)) * (F.col("n") - 1)).cast("long"), F.col("n") - 1) + 1
    filled = empty.select(*KEY, place.alias("rk")).join(big.select(*KEY, "rk", "frame_num"), [*KEY, "rk"]).select(*KEY, "frame_num")
    return small.unionByName(best.select(*KEY, "frame_num")).unionByName(filled).distinct()


def apply_frame_gates(frames: DataFrame, quality: float | None = None, budget: int | None = None) -> DataFrame:
    """``kept`` and ``gate_reason`` after the quality threshold and the frame budget."""
    f = once(frames.withColumn("gate_reason", F.when(F.col("composite") < quality, "below_quality_threshold") if quality is not None else F.lit(None).cast("string")))
    if budget is not None:
        chosen = select_frames(f.filter("gate_reason IS NULL"), budget).withColumn("_in", F.lit(True))
        f = f.join(chosen, [*KEY, "frame_num"], "left").withColumn(
            "gate_reason", F.when(F.col("gate_reason").isNull() & F.col("_in").isNull(), "above_frame_budget").otherwise(F.col("gate_reason"))
        ).drop("_in")
    return f.withColumn("kept", F.col("gate_reason").isNull())


def top_percent(frames: DataFrame, share: float) -> DataFrame:
    """The best ``max(1, int(n * share))`` frames of each mission."""
    n = frames.groupBy(*KEY).agg(F.greatest(F.lit(1), (F.count(F.lit(1)) * share).cast("int")).alias("_take"))
    f = with_running(frames.withColumn("_inv", -F.col("composite")), KEY, ["_inv", "frame_num"], F.floor(F.col("_inv") * 1000), rank="_r")
    return f.join(n, KEY).filter("_r <= _take").drop("_r", "_take", "_inv")


def select_pairs(frames: DataFrame, strategy: str = "adaptive", window: int = 10, max_pairs: int = 500, least: float = 0.1) -> DataFrame:
    """Frame pairs to match; ``frames(mission_id, frame_num, timestamp_sec, entropy, lat, lon)``."""
    w = 1 if strategy == "sequential" else window
    f = once(with_running(frames, KEY, ["frame_num"], row_block("frame_num"), rank="rk"))
    cols = ["frame_num", "timestamp_sec", "entropy", "lat", "lon"]
    a = f.select(*KEY, "rk", *cols).withColumn("rk", F.explode(F.sequence(F.col("rk") + 1, F.col("rk") + w)))
    b = f.select(*KEY, "rk", *[F.col(c).alias(f"{c}_b") for c in cols])
    p = a.join(b, [*KEY, "rk"])
    if strategy == "sequential":
        return p.select(*KEY, F.col("frame_num").alias("a"), F.col("frame_num_b").alias("b"), F.lit(None).cast("double").alias("score"))
    la, lo, lb, ob = (F.col(c) for c in ("lat", "lon", "lat_b", "lon_b"))
    h = F.pow(F.sin(F.radians(lb - la) / 2), 2) + F.cos(F.radians(la)) * F.cos(F.radians(lb)) * F.pow(F.sin(F.radians(ob - lo) / 2), 2)
    dist = F.lit(2 * geo.EARTH_R_PAIRS) * F.atan2(F.sqrt(h), F.sqrt(1 - h))
    near = F.when(la.isNull() | lb.isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - dist / 100))
    score = 0.4 / (1 + F.abs(F.col("timestamp_sec_b") - F.col("timestamp_sec"))) + 0.3 * F.least((F.col("entropy") + F.col("entropy_b")) / 16, F.lit(1.0)) + 0.3 * near
    p = p.select(*KEY, F.col("frame_num").alias("a"), F.col("frame_num_b").alias("b"), score.alias("score"))
    order = [F.desc("score"), F.desc("a"), F.desc("b")] if strategy == "adaptive" else ["a", "b"]
    if strategy == "adaptive":
        p = p.filter(F.col("score") >= least)
    best = Window.partitionBy(*KEY).orderBy(*order)
    return p.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= max_pairs).drop("rank")


def verified_pairs(matches: DataFrame, ratio: float = 0.3, least: int = 10) -> DataFrame:
    return matches.withColumn("inlier_ratio", F.try_divide("inliers", "matches")).filter((F.col("inlier_ratio") >= ratio) & (F.col("inliers") >= least))


def match_counts(pairs: DataFrame) -> DataFrame:
    """Verified pairs per frame."""
    return pairs.select(*KEY, F.explode(F.array("a", "b")).alias("frame_num")).groupBy(*KEY, "frame_num").agg(F.count(F.lit(1)).alias("pairs"))


def confidence_level(c: Column) -> Column:
    return F.when(c >= 0.7, "high").when(c >= 0.4, "medium").otherwise("low")


def camera_confidence(features: Column, matches: Column, error: Column) -> Column:
    one = F.lit(1.0)
    return 0.3 * F.least(features / 2000.0, one) + 0.3 * F.least(matches / 500.0, one) + 0.4 * clip(1 - (error - 0.5) / 4.5)


def point_confidence(track: Column, error: Column) -> Column:
    return 0.5 * F.least(track / 5.0, F.lit(1.0)) + 0.5 * clip(1 - error / 5.0)


def condition_summary(det: DataFrame) -> DataFrame:
    """Mean, p90, max and affected share per mission and condition."""
    k = [*KEY, "condition"]
    det = once(det)
    a = det.groupBy(*k).agg(F.avg("score").alias("mean_score"), F.max("score").alias("max_score"), (100.0 * F.avg((F.col("score") > 0.35).cast("int"))).alias("affected_pct"))
    return a.join(quantiles(det, k, p90_score=("score", 0.9)), k)


def score_environment(det: DataFrame) -> DataFrame:
    s = condition_summary(det).withColumn("w", lookup(CONDITION_WEIGHT, F.col("condition"), 1.0))
    worst = F.max(F.greatest("p90_score", F.col("max_score") * 0.8) * F.col("w"))
    e = s.groupBy(*KEY).agg(clip(100.0 * (1 - worst / 2.2), 0.0, 100.0).alias("quality_score"), F.max_by("condition", F.struct(F.col("p90_score") * F.col("w"), "condition")).alias("dominant_condition"))
    return e.withColumn("grade", grade(F.col("quality_score"), ENV_GRADES, "Unusable"))


def visibility(det: DataFrame) -> DataFrame:
    """Visible range from the mean fog veil over all frames."""
    frames = det.groupBy(*KEY).agg(F.count_distinct("frame_num").alias("_n"), F.coalesce(F.sum(F.when(F.col("condition") == "fog_haze", F.col("score"))), F.lit(0.0)).alias("_v"))
    return frames.select(*KEY, (F.col("_v") / F.col("_n")).alias("veil"), (VISIBILITY_MAX * F.exp(-6.0 * F.col("_v") / F.col("_n"))).alias("visibility_m"))


def weather_severity(det: DataFrame) -> DataFrame:
    s = condition_summary(det)
    return s.groupBy(*KEY).agg(F.max(F.col("p90_score") * lookup(WEATHER_WEIGHT, F.col("condition"), 0.3)).alias("severity"))


def adaptive_strategies(det: DataFrame) -> DataFrame:
    """Processing actions whose condition mean passes its threshold."""
    mean = det.groupBy(*KEY, "condition").agg(F.avg("score").alias("mean_score"))
    rules = det.sparkSession.createDataFrame(STRATEGIES, "condition string, threshold double, action string")
    return mean.join(F.broadcast(rules), "condition").filter("mean_score > threshold").groupBy(*KEY, "action").agg(F.max("mean_score").alias("strength"))


def mission_score(runs: DataFrame) -> DataFrame:
    """Mission score of runs with ``registered, total_frames, points, reproj_error, smoothness, features``."""
    rate = F.when(F.col("total_frames") > 0, F.col("registered") / F.col("total_frames")).otherwise(0.0)
    density = F.when(F.col("registered") > 0, F.col("points") / F.col("registered")).otherwise(0.0)
    one = F.lit(1.0)
    r = runs.select("*", rate.alias("registration_rate"), density.alias("sparse_density"))
    score = (
        0.25 * F.least(F.col("registration_rate") * 100, F.lit(100.0)) + 0.20 * F.greatest(F.lit(0.0), 100 - (F.col("reproj_error") - 1) * 25)
        + 0.15 * F.least(F.col("sparse_density") / 10.0, one) * 100 + 0.20 * F.col("registration_rate") * 100
        + 0.10 * F.col("smoothness") * 100 + 0.10 * F.least(F.col("features") / 20.0, one) * 100
    )
    r = r.withColumn("mission_score", clip(score, 0.0, 100.0))
    return r.withColumn("grade", grade(F.col("mission_score"), [(85.0, "Excellent"), (70.0, "Good"), (50.0, "Fair")], "Poor")).withColumn(
        "suggestions",
        present((F.col("registration_rate") < 0.7, "raise image overlap"), (F.col("reproj_error") > 2.0, "check calibration"), (F.col("smoothness") < 0.5, "fly smoother")),
    )
