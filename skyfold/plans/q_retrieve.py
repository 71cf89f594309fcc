"""Registered queries: retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyfold.operators import retrieve as re_
from skyfold.plans.registry import query

TOK = "SELECT {id}, tok, count(*) AS c FROM (SELECT {id}, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS tok FROM {src}) GROUP BY 1,2"


@query("k1_record_index", """SELECT mission_id, kind, count(*) AS n FROM (SELECT mission_id, 'object' AS kind FROM (SELECT *, row_number() OVER (PARTITION BY mission_id ORDER BY object_id) AS i FROM objects) WHERE i<=200 UNION ALL SELECT mission_id, 'object' FROM objects GROUP BY mission_id HAVING count(*)>200
 UNION ALL SELECT id%4 AS mission_id, 'finding' FROM records WHERE trim(text)<>'') GROUP BY 1,2""")
def _(t):
    o = t.objects.select("mission_id", F.col("object_id").alias("seq"), F.concat("class", F.lit(" "), F.col("height").cast("string")).alias("text"))
    f = t.records.select((F.col("id") % 4).alias("mission_id"), F.col("id").alias("seq"), "text")
    return re_.build_records(object=o, finding=f).groupBy("mission_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("k2_lexical_rank", f"""WITH d AS ({TOK.format(id='id', src='records')}), q AS ({TOK.format(id='qid', src='questions')}), dn AS (SELECT id, sqrt(sum(c*c)) AS n FROM d GROUP BY 1), qn AS (SELECT qid, sqrt(sum(c*c)) AS n FROM q GROUP BY 1),
 s AS (SELECT qid, id, sum(d.c*q.c)/any_value(dn.n*qn.n) AS score FROM d JOIN q USING (tok) JOIN dn USING (id) JOIN qn USING (qid) GROUP BY 1,2), r AS (SELECT qid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC) AS rank FROM s)
 SELECT qid, CAST(rank AS INTEGER) AS rank, score FROM r WHERE rank<=5""", "score")
def _(t):
    return re_.lexical_topk(t.records, t.questions, 5).select("qid", "rank", "score")


@query("k3_vector_rank", """WITH u AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding,1) AS i FROM embeddings), q AS (SELECT label::BIGINT AS qid, i, avg(v) AS v FROM u GROUP BY 1,2),
 dn AS (SELECT vec_id, sqrt(sum(v*v)) AS n FROM u GROUP BY 1), qn AS (SELECT qid, sqrt(sum(v*v)) AS n FROM q GROUP BY 1), s AS (SELECT qid, vec_id, sum(u.v*q.v)/any_value(dn.n*qn.n) AS score FROM u JOIN q USING (i) JOIN dn USING (vec_id) JOIN qn USING (qid) GROUP BY 1,2)
 SELECT qid, vec_id AS id, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, score FROM s WHERE score>0 QUALIFY rank<=5""", "score")
def _(t):
    e = t.raw("embeddings")
    q = e.select(F.col("label").cast("long").alias("qid"), F.posexplode("embedding").alias("i", "v")).groupBy("qid", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    q = q.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("embedding"))
    return re_.vector_topk(e.select(F.col("vec_id").alias("id"), "embedding"), q, 5)


# Written out here on purpose: the check must not share constants with what it checks.
SYN = "MAP {" + ", ".join(f"'{w}': '{c}'" for w, c in (
    ("buildings", "building"), ("building", "building"), ("house", "building"), ("homes", "building"), ("structure", "structure"), ("structures", "structure"), ("road", "road"), ("roads", "road"), ("street", "road"), ("streets", "road"), ("path", "road"),
    ("water", "water"), ("pond", "water"), ("lake", "water"), ("river", "water"), ("flood", "flood"), ("flooding", "flood"), ("trees", "tree"), ("tree", "tree"), ("forest", "tree"), ("roof", "roof"), ("roofs", "roof"), ("vehicles", "vehicle"), ("tower", "tower"), ("rubble", "debris"),
)) + "}"
C = f"""coalesce(list_filter(list_transform(string_split_regex(q,'\\s+'), lambda w: ({SYN})[w]), lambda c: c IS NOT NULL)[1],
 CASE WHEN regexp_matches(q,'building|house|homes|structure') THEN 'building' WHEN regexp_matches(q,'water|flood|pond|lake|river') THEN 'water' WHEN regexp_matches(q,'road|street|path') THEN 'road' END)"""
W = {
    "COUNT": "\\b(how many|count|number of|total)\\b", "DAMAGED": "\\b(damaged|destroyed|collapsed|flooded|affected)\\b", "MEASURE": "\\b(measure|height|area|volume|size|how tall|how big|dimensions)\\b",
    "DAMAGE": "\\b(damage|destroyed|collapse|collapsed|flood|flooded|landslide|debris|rubble|blocked|blockage)\\b", "LOCATE": "\\b(where|show|find|list|locate|highlight|which)\\b", "RISK": "\\b(risk|danger|unsafe|emergency|access|evacuat)\\b",
    "CHANGE": "\\b(change|compare|added|removed|new|difference|different|progress|vs)\\b", "RECOMMEND": "\\b(recommend|re-fly|refly|improve|better|rescan|optimiz)\\b", "SUMMARY": "\\b(summary|overview|what is there|report)\\b",
}
ROUTE = f"""SELECT qid, concept, CASE WHEN q='' THEN 'clarify' WHEN regexp_matches(q,'{W['COUNT']}') AND regexp_matches(q,'{W['DAMAGED']}') THEN 'count_damage' WHEN regexp_matches(q,'{W['COUNT']}') AND concept IS NOT NULL THEN 'count' WHEN regexp_matches(q,'{W['COUNT']}') THEN 'count_kinds'
 WHEN concept IS NOT NULL AND regexp_matches(q,'{W['MEASURE']}') THEN 'measure' WHEN regexp_matches(q,'{W['DAMAGE']}') THEN 'damage' WHEN concept IS NOT NULL AND regexp_matches(q,'{W['LOCATE']}') THEN 'locate' WHEN regexp_matches(q,'{W['RISK']}') THEN 'risk'
 WHEN regexp_matches(q,'{W['CHANGE']}') THEN 'change' WHEN regexp_matches(q,'{W['RECOMMEND']}') THEN 'recommendation' WHEN regexp_matches(q,'{W['SUMMARY']}') THEN 'summary' ELSE 'retrieval' END AS intent, q FROM (SELECT qid, q, {C} AS concept FROM (SELECT qid, lower(trim(text)) AS q FROM asked))"""
ASKED = """asked AS (SELECT conv_id*1000+turn AS qid, CASE turn%8 WHEN 0 THEN 'how many houses ' WHEN 1 THEN 'total volume of the building ' WHEN 2 THEN 'where is the river ' WHEN 3 THEN 'what changed, any risk ' WHEN 4 THEN 'height of the road ' WHEN 5 THEN 'how many trees ' WHEN 6 THEN 'show every roof and flood ' ELSE '' END || text AS text FROM conversations)"""


def asked(t):
    k = F.col("turn") % 8
    lead = F.when(k == 0, "how many houses ").when(k == 1, "total volume of the building ").when(k == 2, "where is the river ").when(k == 3, "what changed, any risk ").when(k == 4, "height of the road ").when(k == 5, "how many trees ").when(k == 6, "show every roof and flood ").otherwise("")
    return t.raw("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.concat(lead, "text").alias("text"))


@query("k4_question_routing", f"WITH {ASKED} SELECT qid, concept, intent FROM ({ROUTE})")
def _(t):
    return re_.route_questions(asked(t)).select("qid", "concept", "intent")


@query("k5_batch_answers", f"""WITH {ASKED}, r AS ({ROUTE}), o AS (SELECT objects.*, concept FROM objects JOIN (VALUES ('building','roof'),('building','wall'),('building','structure'),('structure','roof'),('structure','wall'),('structure','structure'),('road','ground'),('water','water'),('flood','water'),('tree','vegetation'),('roof','roof'),('vehicle','vehicle'),('tower','structure'),('debris','unclassified'),('debris','structure')) k(concept,class) USING (class)),
 g AS (SELECT concept, count(*) AS n, sum(height) AS h, sum(area) AS a, sum(volume) AS v FROM o WHERE concept IS NOT NULL GROUP BY 1), s AS (SELECT concept, string_agg(object_id, ',' ORDER BY object_id) AS sources FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY object_id) AS i FROM o) WHERE i<=50 GROUP BY 1)
 SELECT qid, intent, concept, CASE WHEN intent='measure' THEN (CASE WHEN contains(q,'volume') THEN v WHEN contains(q,'height') OR contains(q,'tall') THEN h WHEN contains(q,'area') OR contains(q,'size') THEN a ELSE h END) ELSE coalesce(n,0)*1.0e0 END AS answer, sources
 FROM r LEFT JOIN g USING (concept) LEFT JOIN s USING (concept) WHERE intent IN ('count','measure','locate')""", "answer")
def _(t):
    return re_.answer_batch(re_.route_questions(asked(t)), t.objects)


@query("k6_low_confidence", "SELECT mission_id, object_id, confidence FROM objects WHERE confidence<0.65", "confidence")
def _(t):
    return re_.low_confidence(t.objects, "which objects are below 65 % confidence").select("mission_id", "object_id", "confidence")


@query("k6_class_summary", "SELECT mission_id, class, count(*) AS objects, sum(height) AS height, sum(area) AS area, sum(volume) AS volume FROM objects GROUP BY 1,2", "height area volume")
def _(t):
    return re_.class_summary(t.objects)
