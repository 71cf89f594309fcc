"""Registered queries: frames, pairs and score reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyfold.operators import frames as fr
from skyfold.plans.registry import query

MAPS = lambda m, c, d: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in m.items()) + f" ELSE {d}e0 END"
SCORED = """SELECT *, blur*400 AS raw_blur, least(blur*400/300,1) AS blur_norm, 0.30e0*least(blur*400/300,1)+0.25e0*sharpness+0.25e0*exposure+0.20e0*(1-motion) AS composite,
 CASE WHEN blur*400<100 THEN 'blurry' WHEN exposure<0.1 THEN (CASE WHEN phash%2=0 THEN 'overexposed' ELSE 'underexposed' END) WHEN sharpness>=0.85 AND motion<0.05 THEN 'duplicate' END AS rejection_reason FROM frames"""


def scored(t):
    return fr.score_frames(t.frames.select("*", (F.col("blur") * 400).alias("raw_blur"), F.col("sharpness").alias("ssim"), (F.col("phash") % 2 == 0).alias("bright")))


@query("d1_candidate_frames", """SELECT mission_id, unnest(range(0, n, greatest(1, CAST(trunc((25+mission_id%3*5)/2.0e0) AS BIGINT)))) AS frame_num FROM (SELECT mission_id, count(*) AS n FROM telemetry GROUP BY 1)""")
def _(t):
    v = t.telemetry.groupBy("mission_id").agg(F.count(F.lit(1)).alias("n_frames")).withColumn("fps", 25.0 + F.col("mission_id") % 3 * 5)
    return fr.candidate_frames(v, "fps", 2.0)


@query("d2_frame_scores", f"SELECT mission_id, frame_num, blur_norm, composite, rejection_reason FROM ({SCORED})", "blur_norm composite")
def _(t):
    return scored(t).select("mission_id", "frame_num", "blur_norm", "composite", "rejection_reason")


@query("d3_histogram_features", """WITH h AS (SELECT mission_id, alt_m, source_row, list_transform(range(0,256), lambda i: ((i*(source_row+7)) % 23 + (CASE WHEN i<10 OR i>=246 THEN source_row%40 ELSE 0 END))*1.0e0) AS h FROM telemetry)
 SELECT mission_id, source_row, greatest(0,least(1,1-((list_sum(h[1:10])+list_sum(h[247:256]))/list_sum(h)-0.05e0)/0.45e0)) AS exposure, list_sum(list_transform(h, lambda v: CASE WHEN v>0 THEN -v/list_sum(h)*log2(v/list_sum(h)) ELSE 0 END)) AS entropy FROM h""", "exposure entropy")
def _(t):
    h = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: ((i * (F.col("source_row") + 7)) % 23 + F.when((i < 10) | (i >= 246), F.col("source_row") % 40).otherwise(0)).cast("double"))
    d = t.telemetry.withColumn("h", h)
    return d.select("mission_id", "source_row", fr.hist_exposure(F.col("h")).alias("exposure"), fr.hist_entropy(F.col("h")).alias("entropy"))


@query("d4_near_duplicates")
def _(t):
    return fr.dedup_phash(t.frames).select("mission_id", "frame_num", "kept")


K = 8
SELECTED = f"""f AS ({SCORED}), r AS (SELECT *, row_number() OVER w - 1 AS cum, count(*) OVER (PARTITION BY mission_id) AS n FROM f WINDOW w AS (PARTITION BY mission_id ORDER BY frame_num)),
 b AS (SELECT r.*, x.b FROM r, (SELECT unnest(range(0,{K})) AS b) x WHERE n>{K} AND cum>=x.b*((n-1)*1.0e0/{K}) AND cum<=(CASE WHEN x.b={K - 1} THEN n-1 ELSE (x.b+1)*((n-1)*1.0e0/{K}) END)),
 sel AS (SELECT mission_id, frame_num FROM r WHERE n<={K} UNION SELECT mission_id, frame_num FROM (SELECT *, row_number() OVER (PARTITION BY mission_id,b ORDER BY composite DESC, frame_num) AS k FROM b) WHERE k=1)"""


@query("d5_coverage_buckets", f"WITH {SELECTED} SELECT * FROM sel")
def _(t):
    return fr.select_frames(scored(t), K)


@query("d6_frame_gates", f"""WITH {SELECTED.replace('FROM f WINDOW', 'FROM f WHERE composite>=0.4 WINDOW')} SELECT f.mission_id, f.frame_num, CASE WHEN composite<0.4 THEN 'below_quality_threshold' WHEN sel.frame_num IS NULL THEN 'above_frame_budget' END AS gate_reason,
 composite>=0.4 AND sel.frame_num IS NOT NULL AS kept FROM f LEFT JOIN sel ON f.mission_id=sel.mission_id AND f.frame_num=sel.frame_num""")
def _(t):
    return fr.apply_frame_gates(scored(t), 0.4, K).select("mission_id", "frame_num", "gate_reason", "kept")


@query("d6_top_percent", f"""SELECT mission_id, frame_num FROM (SELECT *, row_number() OVER (PARTITION BY mission_id ORDER BY composite DESC, frame_num) AS r, count(*) OVER (PARTITION BY mission_id) AS n FROM ({SCORED})) WHERE r<=greatest(1,CAST(trunc(n*0.25e0) AS BIGINT))""")
def _(t):
    return fr.top_percent(scored(t), 0.25).select("mission_id", "frame_num")


def pair_input(t):
    return t.frames.join(t.telemetry.select("mission_id", F.col("source_row").alias("frame_num"), F.when(F.col("lat") != 0, F.col("lat")).alias("lat"), F.when(F.col("lat") != 0, F.col("lon")).alias("lon")), ["mission_id", "frame_num"]).withColumn("entropy", F.col("sharpness") * 8)


PAIRIN = "SELECT f.mission_id, f.frame_num, f.timestamp_sec, f.sharpness*8 AS entropy, CASE WHEN lat<>0 THEN lat END AS lat, CASE WHEN lat<>0 THEN lon END AS lon FROM frames f JOIN telemetry t ON t.mission_id=f.mission_id AND t.source_row=f.frame_num"


@query("d7_adaptive_pairs", f"""WITH i AS (SELECT *, row_number() OVER (PARTITION BY mission_id ORDER BY frame_num) AS rk FROM ({PAIRIN})),
 p AS (SELECT a.mission_id, a.frame_num AS a, b.frame_num AS b, 0.4e0/(1+abs(b.timestamp_sec-a.timestamp_sec))+0.3e0*least((a.entropy+b.entropy)/16,1)+0.3e0*(CASE WHEN a.lat IS NULL OR b.lat IS NULL THEN 1 ELSE greatest(0,1-2*6371000.0e0*atan2(sqrt(h),sqrt(1-h))/100) END) AS score
  FROM (SELECT a, b, a.mission_id, pow(sin(radians(b.lat-a.lat)/2),2)+cos(radians(a.lat))*cos(radians(b.lat))*pow(sin(radians(b.lon-a.lon)/2),2) AS h FROM i a JOIN i b ON a.mission_id=b.mission_id AND b.rk BETWEEN a.rk+1 AND a.rk+10))
 SELECT mission_id, a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY mission_id ORDER BY score DESC, a DESC, b DESC) AS r FROM p WHERE score>=0.1) WHERE r<=500""", "score")
def _(t):
    return fr.select_pairs(pair_input(t), "adaptive")


@query("d7_temporal_pairs", f"""WITH i AS (SELECT *, row_number() OVER (PARTITION BY mission_id ORDER BY frame_num) AS rk FROM ({PAIRIN}))
 SELECT mission_id, a, b FROM (SELECT a.mission_id, a.frame_num AS a, b.frame_num AS b, row_number() OVER (PARTITION BY a.mission_id ORDER BY a.frame_num, b.frame_num) AS r FROM i a JOIN i b ON a.mission_id=b.mission_id AND b.rk BETWEEN a.rk+1 AND a.rk+5) WHERE r<=40""")
def _(t):
    return fr.select_pairs(pair_input(t), "temporal", 5, 40).select("mission_id", "a", "b")


@query("d8_verified_pairs", """WITH m AS (SELECT l_suppkey AS mission_id, l_orderkey AS a, l_orderkey+1 AS b, CAST(l_quantity*l_linenumber AS BIGINT) AS inliers, l_partkey%200+20 AS matches FROM lineitem)
 SELECT mission_id, frame_num, count(*) AS pairs FROM (SELECT mission_id, unnest([a,b]) AS frame_num FROM m WHERE inliers*1.0e0/matches>=0.3 AND inliers>=10) GROUP BY 1,2""")
def _(t):
    m = t.raw("lineitem").select(F.col("l_suppkey").alias("mission_id"), F.col("l_orderkey").alias("a"), (F.col("l_orderkey") + 1).alias("b"), (F.col("l_quantity") * F.col("l_linenumber")).cast("long").alias("inliers"), (F.col("l_partkey") % 200 + 20).alias("matches"))
    return fr.match_counts(fr.verified_pairs(m))


@query("d9_camera_confidence", """SELECT mission_id, avg(c) AS camera, avg(p) AS point, count(*) FILTER (c>=0.7) AS high, count(*) FILTER (c>=0.4 AND c<0.7) AS medium, count(*) FILTER (c<0.4) AS low FROM (
 SELECT l_suppkey AS mission_id, 0.3e0*least(l_partkey/2000.0e0,1)+0.3e0*least(l_quantity*15/500,1)+0.4e0*greatest(0,least(1,1-(l_tax*60-0.5)/4.5)) AS c, 0.5e0*least(l_linenumber/5.0e0,1)+0.5e0*greatest(0,least(1,1-l_tax*60/5)) AS p FROM lineitem) GROUP BY 1""", "camera point")
def _(t):
    c = fr.camera_confidence(F.col("l_partkey"), F.col("l_quantity") * 15, F.col("l_tax") * 60)
    d = t.raw("lineitem").select(F.col("l_suppkey").alias("mission_id"), c.alias("c"), fr.point_confidence(F.col("l_linenumber"), F.col("l_tax") * 60).alias("p"))
    lv = fr.confidence_level(F.col("c"))
    return d.groupBy("mission_id").agg(F.avg("c").alias("camera"), F.avg("p").alias("point"), *[F.count_if(lv == n).alias(n) for n in ("high", "medium", "low")])


COND = "SELECT mission_id, condition, avg(score) AS mean_score, quantile_cont(score,.9) AS p90_score, max(score) AS max_score, 100*avg(CASE WHEN score>0.35 THEN 1 ELSE 0 END) AS affected_pct FROM detections GROUP BY 1,2"
W = MAPS(fr.CONDITION_WEIGHT, "condition", 1.0)


@query("d10_condition_summary", COND, "mean_score p90_score max_score affected_pct")
def _(t):
    return fr.condition_summary(t.detections)


@query("d10_environment_score", f"""WITH s AS (SELECT *, {W} AS w FROM ({COND})), e AS (SELECT mission_id, greatest(0,least(100,100*(1-max(greatest(p90_score,max_score*0.8e0)*w)/2.2e0))) AS quality_score, max({{'v':p90_score*w,'c':condition}}).c AS dominant_condition FROM s GROUP BY 1)
 SELECT *, CASE WHEN quality_score>=85 THEN 'Excellent' WHEN quality_score>=70 THEN 'Good' WHEN quality_score>=50 THEN 'Fair' WHEN quality_score>=30 THEN 'Poor' ELSE 'Unusable' END AS grade FROM e""", "quality_score")
def _(t):
    return fr.score_environment(t.detections)


@query("d11_visibility", """SELECT mission_id, v/n AS veil, 15000*exp(-6*v/n) AS visibility_m FROM (SELECT mission_id, count(DISTINCT frame_num) AS n, coalesce(sum(score) FILTER (condition='fog_haze'),0) AS v FROM detections GROUP BY 1)""", "veil visibility_m")
def _(t):
    return fr.visibility(t.detections)


@query("d11_weather_severity", f"SELECT mission_id, max(p90_score*{MAPS(fr.WEATHER_WEIGHT, 'condition', 0.3)}) AS severity FROM ({COND}) GROUP BY 1", "severity")
def _(t):
    return fr.weather_severity(t.detections)


RULES = ", ".join(f"('{a}',{b}e0,'{c}')" for a, b, c in fr.STRATEGIES)


@query("d12_adaptive_strategies", f"SELECT mission_id, action, max(mean_score) AS strength FROM ({COND}) JOIN (VALUES {RULES}) r(condition,threshold,action) USING (condition) WHERE mean_score>threshold GROUP BY 1,2", "strength")
def _(t):
    return fr.adaptive_strategies(t.detections)


@query("d13_mission_score", """WITH r AS (SELECT o_orderkey AS mission_id, o_orderkey%50 AS registered, o_custkey%60 AS total_frames, o_orderkey%5000 AS points, (o_orderkey%70)/10.0e0 AS e, (o_orderkey%101)/100.0e0 AS s, (o_orderkey%3000)/100.0e0 AS f FROM orders),
 q AS (SELECT *, CASE WHEN total_frames>0 THEN registered*1.0e0/total_frames ELSE 0 END AS rate, CASE WHEN registered>0 THEN points*1.0e0/registered ELSE 0 END AS d FROM r),
 z AS (SELECT mission_id, greatest(0,least(100,0.25e0*least(rate*100,100)+0.20e0*greatest(0,100-(e-1)*25)+0.15e0*least(d/10,1)*100+0.20e0*rate*100+0.10e0*s*100+0.10e0*least(f/20,1)*100)) AS mission_score FROM q)
 SELECT *, CASE WHEN mission_score>=85 THEN 'Excellent' WHEN mission_score>=70 THEN 'Good' WHEN mission_score>=50 THEN 'Fair' ELSE 'Poor' END AS grade FROM z""", "mission_score")
def _(t):
    o = F.col("o_orderkey")
    r = t.raw("orders").select(o.alias("mission_id"), (o % 50).alias("registered"), (F.col("o_custkey") % 60).alias("total_frames"), (o % 5000).alias("points"), (o % 70 / 10.0).alias("reproj_error"), (o % 101 / 100.0).alias("smoothness"), (o % 3000 / 100.0).alias("features"))
    return fr.mission_score(r).select("mission_id", "mission_score", "grade")
