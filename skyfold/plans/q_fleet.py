"""Registered queries: fleet and run analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyfold.operators import fleet as fl, frames as fr
from skyfold.plans.q_frames import COND, MAPS
from skyfold.plans.registry import query


@query("l1_history_features", "SELECT mission_id, altitude_m, speed_m_s, forward_overlap, CAST(NULL AS DOUBLE) AS side_overlap, gps_score, env_score, coverage, confidence, CAST(NULL AS DOUBLE) AS battery_consumed_pct, CAST(NULL AS DOUBLE) AS frames, processing_time_s FROM history".replace("AS frames", "AS \"frames\""), "altitude_m speed_m_s forward_overlap side_overlap gps_score env_score coverage confidence battery_consumed_pct processing_time_s")
def _(t):
    return fl.history_features(t.history)


@query("l1_history_record", """SELECT CAST(o_orderkey AS VARCHAR) AS mission_id, CAST(o_custkey%100 AS DOUBLE) AS gps_score, o_totalprice/1000 AS env_score, CASE WHEN o_orderkey%3>0 THEN CAST(o_orderkey%90 AS DOUBLE) END AS coverage, 0.5e0 AS confidence, CAST(40+o_orderkey%80 AS DOUBLE) AS altitude_m, CAST(NULL AS DOUBLE) AS speed_m_s FROM orders""", "gps_score env_score coverage confidence altitude_m speed_m_s")
def _(t):
    o, c = F.col("o_orderkey"), F.col("o_custkey") % 100
    j = lambda **kv: F.to_json(F.struct(*[v.alias(k) for k, v in kv.items()]))
    r = t.raw("orders").select(
        o.cast("string").alias("mission_id"),
        F.when(o % 2 == 0, j(gps_score=c)).otherwise(j(quality=F.struct(c.alias("score")))).alias("gps"),
        j(quality_score=F.col("o_totalprice") / 1000).alias("environment"),
        F.when(o % 3 == 1, j(coverage_percent=o % 90, mean_confidence=F.lit(0.5))).when(o % 3 == 2, j(coverage=o % 90, mean_confidence=F.lit(0.5))).otherwise(j(mean_confidence=F.lit(0.5))).alias("dense"),
        j(altitude_m=40 + o % 80).alias("plan"),
    )
    return fl.history_record(r)


SIM_Q = "SELECT CASE WHEN mission_success THEN 'ok' ELSE 'bad' END AS query_id, avg(altitude_m) AS altitude_m, avg(speed_m_s) AS speed_m_s, avg(forward_overlap) AS forward_overlap, avg(env_score) AS env_score, avg(gps_score) AS gps_score FROM history GROUP BY 1"
TERM = lambda c: f"pow((q.{c}-lo_{c})/(hi_{c}-lo_{c})-(h.{c}-lo_{c})/(hi_{c}-lo_{c}),2)"
NEAR = f"""WITH q AS ({SIM_Q}), s AS (SELECT {', '.join(f'min({c}) AS lo_{c}, max({c}) AS hi_{c}' for c in fl.SIMILAR_ON)} FROM history),
 d AS (SELECT query_id, h.mission_id, h.coverage, h.confidence, ({'+'.join(f'coalesce({TERM(c)},0)' for c in fl.SIMILAR_ON)})/({'+'.join(f'CASE WHEN h.{c} IS NULL THEN 0 ELSE 1 END' for c in fl.SIMILAR_ON)}) AS distance FROM history h, q, s),
 n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance,12), mission_id) AS rank FROM d) WHERE rank<=3)"""


def near(t):
    q = t.history.groupBy(F.when(F.col("mission_success"), "ok").otherwise("bad").alias("mission_id")).agg(*[F.avg(c).alias(c) for c in fl.SIMILAR_ON])
    return fl.similar_missions(t.history, q)


@query("l2_similar_missions", f"{NEAR} SELECT query_id, count(*) AS count, avg(coverage) AS average_coverage, avg(confidence) AS average_confidence, max(distance) AS far FROM n GROUP BY 1", "average_coverage average_confidence far")
def _(t):
    n = near(t)
    return n.groupBy("query_id").agg(F.count(F.lit(1)).alias("count"), F.avg("coverage").alias("average_coverage"), F.avg("confidence").alias("average_confidence"), F.max("distance").alias("far"))


@query("l3_learning_summary", """SELECT count(*) AS missions, count(*) FILTER (coalesce(mission_success,true)) AS successful, avg(coverage) AS average_coverage, avg(confidence) AS average_confidence, avg(processing_time_s) AS average_processing_time_s,
 (SELECT mission_id FROM history ORDER BY coalesce(coverage,0) DESC, mission_id LIMIT 1) AS best_mission, max(coverage) AS best_coverage, CASE WHEN count(*)=0 THEN 'no_history' WHEN count(*)>=5 THEN 'ready' ELSE 'insufficient_for_ml' END AS status FROM history""", "average_coverage average_confidence average_processing_time_s best_coverage")
def _(t):
    return fl.learning_summary(t.history)


@query("l4_prediction_error", """SELECT mission_id, 'coverage_est' AS metric, coverage-forward_overlap AS error FROM history WHERE coverage IS NOT NULL UNION ALL SELECT mission_id, 'quality_index', confidence-env_score/100 FROM history WHERE confidence IS NOT NULL""", "error")
def _(t):
    m = fl.unpivot_metrics(t.history.select("mission_id", F.col("coverage").alias("coverage_est"), F.col("confidence").alias("quality_index")), ["coverage_est", "quality_index"])
    p = fl.unpivot_metrics(t.history.select("mission_id", F.col("forward_overlap").alias("coverage_est"), (F.col("env_score") / 100).alias("quality_index")), ["coverage_est", "quality_index"])
    return fl.prediction_error(p, m)


WEAK = "SELECT CAST(l_orderkey AS VARCHAR) AS mission_id, l_linenumber AS region, max(l_partkey) AS vertices FROM lineitem GROUP BY 1,2"


@query("l5_recommendations", f"""WITH w AS ({WEAK}), r AS (SELECT mission_id, row_number() OVER (PARTITION BY mission_id ORDER BY vertices DESC, region) AS i FROM w)
 SELECT mission_id, 'refly_region' AS type, CASE WHEN i<=3 THEN 'High' ELSE 'Medium' END AS priority FROM r JOIN history USING (mission_id) WHERE i<=8 AND coverage IS NOT NULL
 UNION ALL SELECT mission_id, 'gps', 'High' FROM history WHERE gps_score IS NULL UNION ALL SELECT mission_id, 'flight_parameter', CASE WHEN gps_score<40 THEN 'High' ELSE 'Medium' END FROM history WHERE gps_score<70
 UNION ALL SELECT mission_id, 'gps', 'Low' FROM history WHERE gps_score>=70 UNION ALL SELECT mission_id, 'refly_conditions', 'High' FROM history WHERE env_score<45
 UNION ALL SELECT mission_id, 'coverage', 'Medium' FROM history WHERE CAST(altitude_m AS BIGINT)%4=0
 UNION ALL SELECT mission_id, 'coverage', 'Low' FROM history WHERE 1-coverage<=0.02e0 AND mission_id NOT IN (SELECT mission_id FROM w)""")
def _(t):
    return _recommend(t)[0].select("mission_id", "type", "priority")


def _recommend(t):
    m = t.history.select("mission_id", F.col("gps_score").alias("gps_q"), F.col("env_score").alias("env_q"), (1 - F.col("coverage")).alias("low_share"), F.lit(5).alias("objects"), (F.col("altitude_m").cast("long") % 4).alias("structures"))
    w = t.raw("lineitem").groupBy(F.col("l_orderkey").cast("string").alias("mission_id"), F.col("l_linenumber").alias("region")).agg(F.max("l_partkey").alias("vertices"))
    return fl.recommend(m, w)


@query("l5_optimisation_score", """SELECT mission_id, (coalesce(0.4e0*gps_score,0)+0.3e0*env_score+coalesce(0.3e0*coverage*100,0))/((CASE WHEN gps_score IS NULL THEN 0 ELSE 0.4e0 END)+0.3e0+(CASE WHEN coverage IS NULL THEN 0 ELSE 0.3e0 END)) AS score FROM history""", "score")
def _(t):
    return _recommend(t)[1]


PLANS = """SELECT o_custkey%200 AS scene_id, o_orderkey AS plan_id, (o_orderkey*7%101)/100.0e0 AS quality_index, (o_orderkey*13%97)/97.0e0 AS coverage_est, (o_orderkey*3%61)*1.0e0 AS duration_min, o_totalprice/1000 AS battery_wh, (o_orderkey*11%89)*1.0e0 AS risk_score FROM orders"""


def plans(t):
    o = F.col("o_orderkey")
    return t.raw("orders").select((F.col("o_custkey") % 200).alias("scene_id"), o.alias("plan_id"), (o * 7 % 101 / 100.0).alias("quality_index"), (o * 13 % 97 / F.lit(97.0)).alias("coverage_est"), (o * 3 % 61 * F.lit(1.0)).alias("duration_min"), (F.col("o_totalprice") / 1000).alias("battery_wh"), (o * 11 % 89 * F.lit(1.0)).alias("risk_score"))


BETTER = " OR ".join(f"(b.{o}-a.{o})*({d})/greatest(s.r_{o},1e-300)>1e-9" for o, d in fl.OBJECTIVES.items())
WORSE = " OR ".join(f"(b.{o}-a.{o})*({d})/greatest(s.r_{o},1e-300)<-1e-9" for o, d in fl.OBJECTIVES.items())
FRONT = f"""p AS ({PLANS}), s AS (SELECT scene_id, {', '.join(f'max({o})-min({o}) AS r_{o}' for o in fl.OBJECTIVES)} FROM p GROUP BY 1),
 front AS (SELECT a.* FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b JOIN s ON s.scene_id=b.scene_id WHERE b.scene_id=a.scene_id AND ({BETTER}) AND NOT ({WORSE})))"""


@query("l6_skyline", f"WITH {FRONT} SELECT scene_id, plan_id FROM front")
def _(t):
    return fl.skyline(plans(t)).select("scene_id", "plan_id")


@query("l7_plan_picks", f"""WITH {FRONT}, f AS (SELECT p.* FROM p JOIN (SELECT scene_id, count(*) AS n FROM front GROUP BY 1) c USING (scene_id) WHERE n<3 OR plan_id IN (SELECT plan_id FROM front)),
 x AS (SELECT scene_id, max(quality_index) AS q, max(coverage_est) AS c, min(duration_min) AS d, min(battery_wh) AS w, min(risk_score) AS r FROM f GROUP BY 1),
 z AS (SELECT f.*, (q-quality_index)+(c-coverage_est)+(duration_min-d)+(battery_wh-w)+(risk_score-r) AS deficit FROM f JOIN x USING (scene_id))
 SELECT scene_id, min({{'v':-quality_index,'p':plan_id}}).p AS best_quality, min({{'v':battery_wh,'p':plan_id}}).p AS lowest_battery, min({{'v':duration_min,'p':plan_id}}).p AS fastest, min({{'v':risk_score,'p':plan_id}}).p AS safest, min({{'v':round(deficit,9),'p':plan_id}}).p AS balanced FROM z GROUP BY 1""")
def _(t):
    return fl.pick_plans(plans(t))


@query("l8_metric_comparison", """WITH l AS (SELECT mission_id, unnest(['altitude_m','coverage']) AS metric, unnest([altitude_m,coverage]) AS base, unnest([altitude_m+5, confidence]) AS scenario FROM history)
 SELECT mission_id, metric, base, scenario, CASE WHEN base<>0 AND scenario IS NOT NULL THEN (scenario-base)/abs(base)*100 END AS delta_pct FROM l""", "base scenario delta_pct")
def _(t):
    a = fl.unpivot_metrics(t.history.select("mission_id", "altitude_m", "coverage"), ["altitude_m", "coverage"])
    b = fl.unpivot_metrics(t.history.select("mission_id", (F.col("altitude_m") + 5).alias("altitude_m"), F.col("confidence").alias("coverage")), ["altitude_m", "coverage"])
    return fl.compare_metrics(a, b)


@query("l9_plan_risk", f"""WITH v AS (SELECT mission_id, max(p90_score*{MAPS(fr.WEATHER_WEIGHT, 'condition', 0.3)}) AS s FROM ({COND}) GROUP BY 1),
 p AS (SELECT o_custkey%150 AS mission_id, o_orderkey AS plan_id, 30+o_orderkey%50 AS alt, (o_orderkey%12)/10.0e0 AS p, (o_orderkey%40)*1.0e0 AS mh, o_orderkey%17=0 AS restricted FROM orders),
 r AS (SELECT *, mh>0 AND alt-mh<15 AS near, least(1,(CASE WHEN p<0.5 THEN 0.6e0*(1-p) WHEN p<1 THEN 0.3e0*(1-p) ELSE 0 END)+0.3e0*coalesce(s,0)+(CASE WHEN mh>0 AND alt-mh<15 THEN 0.2e0 ELSE 0 END)+(CASE WHEN restricted THEN 0.2e0 ELSE 0 END))*100 AS risk_score FROM p LEFT JOIN v USING (mission_id))
 SELECT mission_id, plan_id, risk_score, CASE WHEN risk_score<25 THEN 'Low' WHEN risk_score<55 THEN 'Medium' ELSE 'High' END AS level, p<=0 AS no_go,
 concat_ws(',', CASE WHEN p<0.5 THEN 'battery' END, CASE WHEN p>=0.5 AND p<1 THEN 'reserve' END, CASE WHEN s>0.4 THEN 'weather' END, CASE WHEN near THEN 'clearance' END, CASE WHEN restricted THEN 'restricted' END) AS warnings FROM r""", "risk_score")
def _(t):
    o = F.col("o_orderkey")
    p = t.raw("orders").select((F.col("o_custkey") % 150).alias("mission_id"), o.alias("plan_id"), (30 + o % 50).alias("altitude_m"), (o % 12 / 10.0).alias("completion_prob"), (o % 40 * F.lit(1.0)).alias("max_scene_height_m"), (o % 17 == 0).alias("restricted"))
    return fl.plan_risk(p, fr.weather_severity(t.detections))


PROFILE = """SELECT mission_id, stage, duration_sec, active_sec, CASE WHEN duration_sec>0 THEN items/duration_sec ELSE 0 END AS throughput, CASE WHEN sum(active_sec) OVER (PARTITION BY mission_id)>0 THEN active_sec*100/sum(active_sec) OVER (PARTITION BY mission_id) END AS share_pct FROM (
 SELECT mission_id, stage, sum(duration_sec) AS duration_sec, sum(CASE WHEN coalesce(output_count,0)>0 THEN output_count ELSE coalesce(input_count,0) END) AS items, coalesce(sum(duration_sec) FILTER (status='completed'),0) AS active_sec FROM stage_metrics GROUP BY 1,2)"""


@query("l10_stage_profile", PROFILE, "duration_sec active_sec throughput share_pct")
def _(t):
    return fl.stage_profile(t.stage_metrics)


@query("l10_bottleneck", f"SELECT mission_id, min({{'v':-active_sec,'s':stage}}).s AS bottleneck_stage, max(active_sec) AS bottleneck_sec, 100*max(active_sec)/sum(active_sec) AS bottleneck_pct FROM ({PROFILE}) WHERE active_sec>0 GROUP BY 1", "bottleneck_sec bottleneck_pct")
def _(t):
    return fl.bottleneck(fl.stage_profile(t.stage_metrics))


ALLOWED = ", ".join(f"('{a}','{b}')" for a, bs in fl.TRANSITIONS.items() for b in bs)


@query("l11_lifecycle_audit", f"""SELECT mission_id, seq, from_status, to_status, CASE WHEN f IS NULL THEN 'not allowed' ELSE 'does not follow' END AS problem FROM (SELECT *, lag(to_status) OVER (PARTITION BY mission_id ORDER BY seq) AS p FROM mission_events) LEFT JOIN (VALUES {ALLOWED}) r(f,g) ON f=from_status AND g=to_status WHERE f IS NULL OR p<>from_status""")
def _(t):
    return fl.audit_transitions(t.mission_events)


@query("l12_mission_listing", "SELECT o_orderkey AS mission_id, o_custkey AS owner, o_orderstatus AS status FROM orders WHERE o_orderstatus='F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def _(t):
    m = t.raw("orders").select(F.col("o_orderkey").alias("mission_id"), F.col("o_custkey").alias("owner"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    return fl.list_missions(m, status="F").drop("created_at")


@query("l12_mission_events", "SELECT mission_id, seq, to_status FROM (SELECT *, row_number() OVER (PARTITION BY mission_id ORDER BY seq DESC) AS r FROM mission_events) WHERE r<=20")
def _(t):
    return fl.mission_events(t.mission_events, 20).select("mission_id", "seq", "to_status")


JOBS = "SELECT o_orderpriority AS queue, o_orderkey AS job_id, o_custkey%10 AS priority, o_orderdate AS created_at, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'failed' ELSE 'completed' END AS status, o_orderkey%3+1 AS attempts FROM orders"


def jobs(t):
    o = F.col("o_orderkey")
    return t.raw("orders").select(F.col("o_orderpriority").alias("queue"), o.alias("job_id"), (F.col("o_custkey") % 10).alias("priority"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "F", "failed").otherwise("completed").alias("status"), (o % 3 + 1).alias("attempts"))


@query("l13_queue_view", f"""WITH j AS ({JOBS}) SELECT * FROM (SELECT queue, min({{'p':-priority,'c':created_at,'j':job_id}}).j AS next_job FROM j WHERE status='queued' GROUP BY 1) FULL JOIN
 (SELECT queue, count(*) FILTER (attempts>1) AS retried, count(*) FILTER (status='failed') AS failed, count(*) FILTER (attempts>1 AND status='completed') AS recovered FROM j GROUP BY 1) USING (queue)""")
def _(t):
    a, b = fl.queue_view(jobs(t))
    return a.join(b, "queue", "full")


@query("l14_metrics_table", """SELECT event_type AS name, '{"kind":"'||event_type||'","user":"'||(user_id%7)||'"}' AS labels, sum(value) AS total, arg_max(value,event_id) AS last, count(*) AS n FROM events GROUP BY 1,2""", "total last")
def _(t):
    e = t.raw("events").select(F.col("event_type").alias("name"), F.create_map(F.lit("user"), (F.col("user_id") % 7).cast("string"), F.lit("kind"), F.col("event_type")).alias("labels"), "value", F.col("event_id").alias("seq"))
    return fl.metrics_table(e)


@query("l15_scene_index", """SELECT mission_id, concat_ws(',', CASE WHEN g IS NULL THEN 'gps' END, CASE WHEN c IS NULL THEN 'coverage' END) AS missing FROM (SELECT mission_id, gps_score AS g, coverage AS c FROM history)""")
def _(t):
    h = t.history
    return fl.scene_index(h.select("mission_id"), gps=h.filter("gps_score IS NOT NULL").select("mission_id", "gps_score"), coverage=h.filter("coverage IS NOT NULL").select("mission_id", "coverage")).select("mission_id", "missing")


ALERT = """WITH m AS (SELECT o_orderkey AS mission_id, o_orderkey%5 AS blocked, CASE o_orderstatus WHEN 'F' THEN 'High' WHEN 'O' THEN 'Critical' ELSE 'Low' END AS overall, (o_orderkey*7%101)*1.0e0 AS env_q, o_custkey%3 AS clusters FROM orders),
 f AS (SELECT l_orderkey AS mission_id, CASE l_returnflag WHEN 'A' THEN 'Critical' WHEN 'R' THEN 'High' ELSE 'Low' END AS severity FROM lineitem),
 a AS (SELECT mission_id, 'finding' AS source, severity AS level FROM f WHERE severity IN ('High','Critical') UNION ALL SELECT mission_id, 'access', CASE WHEN blocked>=3 THEN 'High' ELSE 'Medium' END FROM m WHERE blocked>=1
 UNION ALL SELECT mission_id, 'risk', overall FROM m WHERE overall IN ('High','Critical') UNION ALL SELECT mission_id, 'environment', CASE WHEN env_q<30 THEN 'High' ELSE 'Medium' END FROM m WHERE env_q<50 UNION ALL SELECT mission_id, 'change', 'Medium' FROM m WHERE clusters>0)"""


@query("l16_alerts", f"{ALERT} SELECT mission_id, count(*) AS alerts, CASE max(CASE level WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END) WHEN 4 THEN 'Critical' WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END AS max_level FROM a GROUP BY 1")
def _(t):
    o = F.col("o_orderkey")
    m = t.raw("orders").select(o.alias("mission_id"), (o % 5).alias("blocked"), F.when(F.col("o_orderstatus") == "F", "High").when(F.col("o_orderstatus") == "O", "Critical").otherwise("Low").alias("overall"), (o * 7 % 101 * F.lit(1.0)).alias("env_q"), (F.col("o_custkey") % 3).alias("clusters"))
    f = t.raw("lineitem").select(F.col("l_orderkey").alias("mission_id"), F.lit("x").alias("kind"), F.when(F.col("l_returnflag") == "A", "Critical").when(F.col("l_returnflag") == "R", "High").otherwise("Low").alias("severity"))
    return fl.alert_levels(fl.alerts(m, f))


@query("l17_stage_success", "SELECT mission_id, count(*) AS stages, count(*) FILTER (status IN ('completed','cached')) AS succeeded, count(*) FILTER (status='failed') AS failed, (count(*) FILTER (status IN ('completed','cached')))*1.0e0/count(*) AS success_rate FROM stage_metrics GROUP BY 1", "success_rate")
def _(t):
    return fl.stage_success(t.stage_metrics)


@query("l18_scene_context", """WITH m AS (SELECT DISTINCT mission_id FROM objects), b AS (SELECT mission_id, max(x1)-min(x0) AS extent_x, max(y1)-min(y0) AS extent_y, max(z1) AS max_height, avg(confidence) AS mean_confidence FROM objects GROUP BY 1),
 t AS (SELECT mission_id, string_agg(object_id, ',' ORDER BY i) AS targets FROM (SELECT *, row_number() OVER (PARTITION BY mission_id ORDER BY area DESC, object_id) AS i FROM objects) WHERE i<=8 GROUP BY 1)
 SELECT m.mission_id, extent_x, extent_y, max_height, mean_confidence, CASE WHEN m.mission_id%2=0 THEN 0.25e0 ELSE 0.5e0 END AS blind_share, targets FROM m LEFT JOIN b USING (mission_id) LEFT JOIN t USING (mission_id)""", "extent_x extent_y max_height mean_confidence blind_share")
def _(t):
    m = t.objects.select("mission_id").distinct()
    over = m.filter("mission_id % 2 = 0").withColumn("blind_share", F.lit(0.25))
    return fl.scene_context(m, over, m.withColumn("blind_share", F.lit(0.5)), t.objects)
