"""Mission history, plans and run analytics over the fleet."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from skyfold.functions.stats import clip, grade, present
from skyfold.operators.frames import lookup
from skyfold.session import once

# History features, limits and the lifecycle table.
FEATURES = ["altitude_m", "speed_m_s", "forward_overlap", "side_overlap", "gps_score", "env_score", "coverage", "confidence", "battery_consumed_pct", "frames", "processing_time_s"]
SIMILAR_ON = ["altitude_m", "speed_m_s", "forward_overlap", "env_score", "gps_score"]
MIN_HISTORY_FOR_ML = 5
CLEARANCE_M = 15.0
OBJECTIVES = {"quality_index": 1, "coverage_est": 1, "duration_min": -1, "battery_wh": -1, "risk_score": -1}
TRANSITIONS = {
    "CREATED": ["UPLOADING", "QUEUED", "CANCELLED"],
    "UPLOADING": ["VALIDATING", "QUEUED", "FAILED", "CANCELLED"],
    "VALIDATING": ["QUEUED", "FAILED", "CANCELLED"],
    "QUEUED": ["PROCESSING", "PAUSED", "CANCELLED"],
    "PROCESSING": ["COMPLETED", "FAILED", "PAUSED", "CANCELLED", "QUEUED"],
    "PAUSED": ["RESUMING", "CANCELLED"],
    "RESUMING": ["QUEUED", "FAILED", "CANCELLED"],
    "COMPLETED": ["QUEUED", "CANCELLED"],
    "FAILED": ["QUEUED", "CANCELLED"],
    "CANCELLED": ["QUEUED"],
}
LEVELS = {"None": 0, "Low": 1, "Medium": 2, "High": 3, "Critical": 4}


def history_features(history: DataFrame) -> DataFrame:
    """The nullable numeric features of each mission."""
    return history.select("mission_id", *[(F.col(c) if c in history.columns else F.lit(None)).cast("double").alias(c) for c in FEATURES])


def history_record(reports: DataFrame) -> DataFrame:
    """Outcome record from report texts ``mission_id, gps, environment, dense, plan`` (JSON)."""
    j = lambda c, p: F.get_json_object(c, p).try_cast("double")
    return reports.select(
        "mission_id",
        F.coalesce(j("gps", "$.gps_score"), j("gps", "$.quality.score")).alias("gps_score"),
        j("environment", "$.quality_score").alias("env_score"),
        F.coalesce(j("dense", "$.coverage_percent"), j("dense", "$.coverage")).alias("coverage"),
        j("dense", "$.mean_confidence").alias("confidence"),
        j("plan", "$.altitude_m").alias("altitude_m"),
        j("plan", "$.speed_m_s").alias("speed_m_s"),
    )


def similar_missions(history: DataFrame, queries: DataFrame, k: int = 3, block: int = 1000) -> DataFrame:
    """The ``k`` nearest past missions of each query mission, by normalised feature distance.

    A query's ranges leave its own mission out: they follow from the two smallest and two largest values of each feature, of
    different missions.  Queries go to the tasks in blocks of about ``block`` rows; any number of blocks may follow each other.
    """
    h = once(history)
    ends = {}
    first = h.agg(*[f(F.when(F.col(c).isNotNull(), F.struct(c, "mission_id"))).alias(f"{n}_{c}") for c in SIMILAR_ON for n, f in (("lo", F.min), ("hi", F.max))]).first()
    rest = [f(F.when(F.col("mission_id") != F.lit(first[f"{n}_{c}"]["mission_id"]), F.col(c))).alias(f"{n}_{c}") for c in SIMILAR_ON for n, f in (("lo", F.min), ("hi", F.max)) if first[f"{n}_{c}"]]
    second = h.agg(*rest).first() if rest else {}
    q = queries.select(F.col("mission_id").alias("query_id"), *[F.col(c).alias(f"q_{c}") for c in SIMILAR_ON])
    for c in SIMILAR_ON:
        for n in ("lo", "hi"):
            end = first[f"{n}_{c}"]
            own = F.lit(None).cast("double") if end is None else F.when(F.col("query_id") == F.lit(end["mission_id"]), F.lit(second[f"{n}_{c}"])).otherwise(F.lit(end[c]))
            ends[f"{n}_{c}"] = own.cast("double").alias(f"{n}_{c}")
    q = once(q.select("*", *ends.values()))
    part = []
    for c in SIMILAR_ON:
        lo, hi, x, v = F.col(f"lo_{c}"), F.col(f"hi_{c}"), F.col(f"q_{c}"), F.col(c)
        part.append(F.when(hi > lo, F.pow((x - lo) / (hi - lo) - (v - lo) / (hi - lo), 2)).when((x == lo) & (v == lo), 0.0))
    used = sum((p.isNotNull().cast("int") for p in part), F.lit(0))
    distance = F.when(used > 0, sum((F.coalesce(p, F.lit(0.0)) for p in part), F.lit(0.0)) / used)
    n = max(1, -(-q.count() // block))
    found = None
    for b in range(n):
        own = q.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b)
        d = h.join(F.broadcast(own), F.col("mission_id") != F.col("query_id")).select("query_id", distance.alias("distance"), *h.columns).filter("distance IS NOT NULL")
        found = d if found is None else found.unionByName(d)
    w = Window.partitionBy("query_id").orderBy("distance", "mission_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def similar_averages(near: DataFrame) -> DataFrame:
    return near.groupBy("query_id").agg(F.count(F.lit(1)).alias("count"), F.avg("coverage").alias("average_coverage"), F.avg("confidence").alias("average_confidence"))


def learning_summary(history: DataFrame) -> DataFrame:
    return history.agg(
        F.count(F.lit(1)).alias("missions"), F.count_if(F.coalesce("mission_success", F.lit(True))).alias("successful"),
        F.avg("coverage").alias("average_coverage"), F.avg("confidence").alias("average_confidence"), F.avg("processing_time_s").alias("average_processing_time_s"),
        F.min_by("mission_id", F.struct(-F.coalesce("coverage", F.lit(0.0)), "mission_id")).alias("best_mission"), F.max("coverage").alias("best_coverage"),
    ).withColumn("status", F.when(F.col("missions") == 0, "no_history").when(F.col("missions") >= MIN_HISTORY_FOR_ML, "ready").otherwise("insufficient_for_ml"))


def prediction_error(predicted: DataFrame, measured: DataFrame) -> DataFrame:
    """Measured minus predicted on shared keys; both ``mission_id, metric, value``."""
    return measured.join(predicted.withColumnRenamed("value", "predicted"), ["mission_id", "metric"]).filter("value IS NOT NULL AND predicted IS NOT NULL").select(
        "mission_id", "metric", (F.col("value") - F.col("predicted")).alias("error")
    )


def unpivot_metrics(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.unpivot("mission_id", cols, "metric", "value")


def recommend(missions: DataFrame, weak: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recommendation rows and the optimisation score per mission.

    ``missions(mission_id, gps_q, env_q, low_share, objects, structures)``,
    ``weak(mission_id, region, vertices)``.
    """
    w = Window.partitionBy("mission_id").orderBy(F.desc("vertices"), "region")
    refly = weak.join(missions.filter("low_share IS NOT NULL").select("mission_id"), "mission_id", "left_semi").withColumn("i", F.row_number().over(w)).filter("i <= 8").select(
        "mission_id", F.lit("refly_region").alias("type"), F.when(F.col("i") <= 3, "High").otherwise("Medium").alias("priority"), F.col("i").cast("long").alias("seq")
    )
    one = lambda cond, kind, pr: F.when(cond, F.struct(F.lit(kind).alias("type"), pr.alias("priority")))
    g, e = F.col("gps_q"), F.col("env_q")
    rules = F.array_compact(
        F.array(
            one(g.isNull(), "gps", F.lit("High")),
            one(g < 70, "flight_parameter", F.when(g < 40, "High").otherwise("Medium")),
            one(g >= 70, "gps", F.lit("Low")),
            one(e < 45, "refly_conditions", F.lit("High")),
            one(e.isNull(), "environment", F.lit("Low")),
            one((F.col("structures") == 0) & (F.col("objects") > 0), "coverage", F.lit("Medium")),
            one((F.col("low_share") <= 0.02) & F.col("_weak").isNull(), "coverage", F.lit("Low")),
        )
    )
    even = weak.select("mission_id").distinct().withColumn("_weak", F.lit(True))
    rows = missions.join(even, "mission_id", "left").select("mission_id", F.posexplode(rules).alias("p", "r")).select("mission_id", "r.type", "r.priority", (F.col("p") + 100).cast("long").alias("seq"))
    parts = F.filter(
        F.array(F.struct(F.lit(0.4).alias("w"), g.alias("v")), F.struct(F.lit(0.3).alias("w"), e.alias("v")), F.struct(F.lit(0.3).alias("w"), ((1 - F.col("low_share")) * 100).alias("v"))),
        lambda s: s["v"].isNotNull(),
    )
    total = lambda f: F.aggregate(parts, F.lit(0.0), f)
    score = F.when(F.size(parts) > 0, total(lambda a, s: a + s["w"] * s["v"]) / total(lambda a, s: a + s["w"])).otherwise(0.0)
    return refly.unionByName(rows), missions.select("mission_id", score.alias("score"))


def _dominated(a: str, b: str) -> Column:
    """Plan ``b`` dominates plan ``a`` on the normalised objectives."""
    diff = [(F.col(f"{b}.n_{o}") - F.col(f"{a}.n_{o}")) * d for o, d in OBJECTIVES.items()]
    better, worse = diff[0] > 1e-9, diff[0] < -1e-9
    for x in diff[1:]:
        better, worse = better | (x > 1e-9), worse | (x < -1e-9)
    return better & ~worse


def _local_front(pdf: pd.DataFrame) -> pd.DataFrame:
    """Plans of one block that no plan of the block dominates."""
    v = pdf[[f"n_{o}" for o in OBJECTIVES]].to_numpy() * list(OBJECTIVES.values())
    keep = [not (((v - r) > 1e-9).any(1) & ~((v - r) < -1e-9).any(1)).any() for r in v]
    return pdf[keep]


def skyline(plans: DataFrame, key: str = "scene_id", pid: str = "plan_id", block: int = 2000) -> DataFrame:
    """Plans that no other plan of the scene dominates.

    Blocks of bounded size drop their dominated plans first.  A plan that some
    plan dominates is dominated by a survivor too, so the final anti join only
    meets local survivors.
    """
    plans = once(plans)
    lo_hi = plans.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[f(o).alias(f"{n}_{o}") for o in OBJECTIVES for n, f in (("lo", F.min), ("hi", F.max))])
    spread = lambda o: F.when(F.col(f"hi_{o}") > F.col(f"lo_{o}"), F.col(f"hi_{o}") - F.col(f"lo_{o}")).otherwise(1.0)
    p = plans.join(lo_hi, key).select(*plans.columns, *[((F.col(o) - F.col(f"lo_{o}")) / spread(o)).alias(f"n_{o}") for o in OBJECTIVES], F.pmod(F.xxhash64(pid), F.ceil(F.col("_n") / block)).alias("_block"))
    p = once(p.groupBy(key, "_block").applyInPandas(_local_front, p.schema))
    beaten = p.alias("a").join(p.alias("b"), (F.col(f"a.{key}") == F.col(f"b.{key}")) & _dominated("a", "b"), "left_anti")
    return beaten.select(*plans.columns)


def pick_plans(plans: DataFrame, key: str = "scene_id", pid: str = "plan_id") -> DataFrame:
    """Five labelled plans per scene, from the front or from all plans when it has fewer than 3."""
    plans = once(plans)
    front = once(skyline(plans, key, pid))
    size = front.groupBy(key).agg(F.count(F.lit(1)).alias("_f"))
    full = front.join(size.filter("_f >= 3").select(key), key, "left_semi").unionByName(plans.join(size.filter("_f < 3").select(key), key, "left_semi"))
    full = once(full)
    best = full.groupBy(key).agg(*[F.max(F.col(o) * d).alias(f"b_{o}") for o, d in OBJECTIVES.items()])
    deficit = sum((F.col(f"b_{o}") - F.col(o) * d for o, d in OBJECTIVES.items()), F.lit(0.0))
    full = full.join(best, key).withColumn("_deficit", deficit)
    pick = lambda e: F.min_by(pid, F.struct(e, pid))
    return full.groupBy(key).agg(
        pick(-F.col("quality_index")).alias("best_quality"), pick(F.col("battery_wh")).alias("lowest_battery"), pick(F.col("duration_min")).alias("fastest"),
        pick(F.col("risk_score")).alias("safest"), pick(F.col("_deficit")).alias("balanced"),
    )


def compare_metrics(base: DataFrame, scenario: DataFrame) -> DataFrame:
    """Percent change per metric; null when the base is missing or zero."""
    j = base.withColumnRenamed("value", "base").join(scenario.withColumnRenamed("value", "scenario"), ["mission_id", "metric"], "full")
    ok = F.col("base").isNotNull() & F.col("scenario").isNotNull() & (F.col("base") != 0)
    return j.withColumn("delta_pct", F.when(ok, (F.col("scenario") - F.col("base")) / F.abs("base") * 100))


def plan_risk(plans: DataFrame, severity: DataFrame) -> DataFrame:
    """Composite risk; ``plans(mission_id, plan_id, altitude_m, completion_prob, max_scene_height_m, restricted)``."""
    j = plans.join(severity, "mission_id", "left").fillna(0.0, ["severity"])
    p, s = F.coalesce("completion_prob", F.lit(1.0)), F.col("severity")
    gap = F.col("altitude_m") - F.col("max_scene_height_m")
    near = (F.col("max_scene_height_m") > 0) & (gap < CLEARANCE_M)
    comp = F.when(p < 0.5, 0.30 * (1 - p) * 2).when(p < 1.0, 0.30 * (1 - p)).otherwise(0.0) + 0.30 * s + F.when(near, 0.20).otherwise(0.0) + F.when(F.col("restricted"), 0.20).otherwise(0.0)
    j = j.withColumn("risk_score", F.least(comp, F.lit(1.0)) * 100)
    return j.select(
        "mission_id", "plan_id", "risk_score", F.when(F.col("risk_score") < 25, "Low").when(F.col("risk_score") < 55, "Medium").otherwise("High").alias("level"), (p <= 0).alias("no_go"),
        F.concat_ws(",", present((p < 0.5, "battery"), ((p >= 0.5) & (p < 1), "reserve"), (s > 0.4, "weather"), (near, "clearance"), (F.col("restricted"), "restricted"))).alias("warnings"),
    )


def stage_profile(m: DataFrame) -> DataFrame:
    """Throughput per stage and its share of the mission's completed time."""
    n = F.when(F.coalesce("output_count", F.lit(0)) > 0, F.col("output_count")).otherwise(F.coalesce("input_count", F.lit(0)))
    s = m.groupBy("mission_id", "stage").agg(F.sum("duration_sec").alias("duration_sec"), F.sum(n).alias("items"), F.coalesce(F.sum(F.when(F.col("status") == "completed", F.col("duration_sec"))), F.lit(0.0)).alias("active_sec"))
    total = Window.partitionBy("mission_id")
    return s.select(
        "mission_id", "stage", "duration_sec", "active_sec", F.when(F.col("duration_sec") > 0, F.col("items") / F.col("duration_sec")).otherwise(0.0).alias("throughput"),
        F.try_divide(F.col("active_sec") * 100, F.sum("active_sec").over(total)).alias("share_pct"),
    )


def bottleneck(profile: DataFrame) -> DataFrame:
    a = profile.filter("active_sec > 0")
    return a.groupBy("mission_id").agg(F.min_by("stage", F.struct(-F.col("active_sec"), "stage")).alias("bottleneck_stage"), F.max("active_sec").alias("bottleneck_sec"), (100 * F.max("active_sec") / F.sum("active_sec")).alias("bottleneck_pct"))


def audit_transitions(events: DataFrame, allowed: dict[str, list[str]] = TRANSITIONS) -> DataFrame:
    """Events that break the lifecycle; ``events(mission_id, seq, from_status, to_status)``."""
    from skyfold.kernels.ordered import with_adjacent

    rules = events.sparkSession.createDataFrame([(a, b) for a, bs in allowed.items() for b in bs], "from_status string, to_status string").withColumn("_ok", F.lit(True))
    e = with_adjacent(events, ["mission_id"], ["seq"], F.floor(F.col("seq") / 100_000), prev={"_prev": F.col("to_status")})
    e = e.join(F.broadcast(rules), ["from_status", "to_status"], "left")
    torn = F.col("_prev").isNotNull() & (F.col("_prev") != F.col("from_status"))
    return e.filter(F.col("_ok").isNull() | torn).select("mission_id", "seq", "from_status", "to_status", F.when(F.col("_ok").isNull(), "not allowed").otherwise("does not follow").alias("problem"))


def list_missions(missions: DataFrame, owner=None, status=None, limit: int = 50) -> DataFrame:
    m = missions
    if owner is not None:
        m = m.filter(F.col("owner") == owner)
    if status is not None:
        m = m.filter(F.col("status") == status)
    return m.orderBy(F.desc("created_at"), F.desc("mission_id")).limit(limit)


def mission_events(events: DataFrame, limit: int = 200) -> DataFrame:
    """Newest events of every mission."""
    w = Window.partitionBy("mission_id").orderBy(F.desc("seq"))
    return events.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def queue_view(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Next job per queue (highest priority, then oldest) and outcome counts."""
    at = F.struct(-F.col("priority"), "created_at", "job_id")
    nxt = jobs.filter("status = 'queued'").groupBy("queue").agg(F.min_by("job_id", at).alias("next_job"))
    counts = jobs.groupBy("queue").agg(F.count_if(F.col("attempts") > 1).alias("retried"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if((F.col("attempts") > 1) & (F.col("status") == "completed")).alias("recovered"))
    return nxt, counts


def metrics_table(events: DataFrame) -> DataFrame:
    """Counter sums and last gauge per name and label set; ``labels`` is a map."""
    lab = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("labels"))))
    return events.groupBy("name", lab.alias("labels")).agg(F.sum("value").alias("total"), F.max_by("value", "seq").alias("last"), F.count(F.lit(1)).alias("n"))


def alerts(missions: DataFrame, findings: DataFrame) -> DataFrame:
    """Alert rows; ``missions(mission_id, blocked, overall, env_q, clusters)``, ``findings(mission_id, kind, severity)``."""
    f = findings.filter(F.col("severity").isin("High", "Critical")).select("mission_id", F.lit("finding").alias("source"), F.col("severity").alias("level"))
    row = lambda cond, source, level: F.when(cond, F.struct(F.lit(source).alias("source"), level.alias("level")))
    rules = F.array_compact(
        F.array(
            row(F.col("blocked") >= 1, "access", F.when(F.col("blocked") >= 3, "High").otherwise("Medium")),
            row(F.col("overall").isin("High", "Critical"), "risk", F.col("overall")),
            row(F.col("env_q") < 50, "environment", F.when(F.col("env_q") < 30, "High").otherwise("Medium")),
            row(F.col("clusters") > 0, "change", F.lit("Medium")),
        )
    )
    return f.unionByName(missions.select("mission_id", F.explode(rules).alias("r")).select("mission_id", "r.source", "r.level"))


def alert_levels(alert_rows: DataFrame) -> DataFrame:
    rank = lookup({k: float(v) for k, v in LEVELS.items()}, F.col("level"), 0.0)
    return alert_rows.groupBy("mission_id").agg(F.count(F.lit(1)).alias("alerts"), F.max_by("level", rank).alias("max_level"))


def stage_success(stages: DataFrame) -> DataFrame:
    ok = F.count_if(F.col("status").isin("completed", "cached"))
    return stages.groupBy("mission_id").agg(F.count(F.lit(1)).alias("stages"), ok.alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"), F.try_divide(ok, F.count(F.lit(1))).alias("success_rate"))


def scene_context(mission: DataFrame, overlay: DataFrame, coverage: DataFrame, objects: DataFrame, targets: int = 8) -> DataFrame:
    """Extent, height, blind share (overlay before coverage) and up to eight target objects per mission."""
    w = Window.partitionBy("mission_id").orderBy(F.desc("area"), "object_id")
    t = objects.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= targets).groupBy("mission_id").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("i", "object_id"))), lambda s: s["object_id"].cast("string"))).alias("targets"))
    box = objects.groupBy("mission_id").agg((F.max("x1") - F.min("x0")).alias("extent_x"), (F.max("y1") - F.min("y0")).alias("extent_y"), F.max("z1").alias("max_height"), F.avg("confidence").alias("mean_confidence"))
    return mission.select("mission_id").join(box, "mission_id", "left").join(overlay.withColumnRenamed("blind_share", "_o"), "mission_id", "left").join(coverage.withColumnRenamed("blind_share", "_c"), "mission_id", "left").join(t, "mission_id", "left").select(
        "mission_id", "extent_x", "extent_y", "max_height", "mean_confidence", F.coalesce("_o", "_c").alias("blind_share"), "targets"
    )


def scene_index(runs: DataFrame, **parts: DataFrame) -> DataFrame:
    """One row per run with the available report of each part and a list of the missing ones."""
    out = runs
    for name, df in parts.items():
        cols = [c for c in df.columns if c != "mission_id"]
        out = out.join(df.select("mission_id", F.struct(*cols).alias(name)), "mission_id", "left")
    gap = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in parts]))
    return out.withColumn("missing", F.concat_ws(",", gap))
