"""Drone-survey tables derived from the given warehouse tables.

``Tables`` builds them with the DataFrame API; ``SQL_TABLES`` states the same
rules in SQL for the result check.  Lattice coordinates carry a half-step
offset so that a cell border never coincides with a value.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skyfold.kernels.ordered import with_running
from skyfold.session import once, written


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def _event_rows(self) -> DataFrame:
        e = self.raw("events").select(F.col("user_id").alias("mission_id"), "event_id", "event_type", "value", "ts")
        rows = with_running(e, ["mission_id"], ["ts", "event_id"], F.to_date("ts"), rank="_rank")
        return once(rows.withColumn("source_row", F.col("_rank") - 1).drop("_rank"))

    @cached_property
    def telemetry(self) -> DataFrame:
        r, kind, row = self._event_rows, F.col("event_type"), F.col("source_row")
        stale = row - row % 3
        spike = F.when(F.col("event_id") % 97 == 0, 0.01).otherwise(0.0)
        return r.select(
            "mission_id",
            "source_row",
            (row * F.lit(0.2) + (F.col("event_id") % 3) * F.lit(0.01)).alias("ts_s"),
            F.when(kind == "error", None).when(kind == "signup", 0.0).otherwise(F.lit(24.53) + F.lit(0.00002) * stale + spike).alias("lat"),
            F.when(kind == "error", None).when(kind == "signup", 0.0).otherwise(F.lit(120.93) + F.lit(0.00001) * (stale % 20)).alias("lon"),
            (F.lit(350.0) + F.col("value") / 100).alias("alt_m"),
        )

    @cached_property
    def frames(self) -> DataFrame:
        r, i = self._event_rows.filter(F.col("event_type").isin("click", "view")), F.col("event_id")
        return r.select(
            "mission_id",
            F.col("source_row").alias("frame_num"),
            (F.col("source_row") * F.lit(0.2) + F.lit(0.07)).alias("timestamp_sec"),
            (i * 37 % 100 / 100.0).alias("blur"),
            (i * 53 % 100 / 100.0).alias("sharpness"),
            (i * 71 % 100 / 100.0).alias("exposure"),
            (i * 13 % 20 / 100.0).alias("motion"),
            (i * 48271 % 2147483647).alias("phash"),
        )

    @cached_property
    def detections(self) -> DataFrame:
        return self._event_rows.select(
            "mission_id",
            F.col("source_row").alias("frame_num"),
            F.element_at(F.array(*[F.lit(c) for c in CONDITIONS]), (F.col("event_id") % 9 + 1).cast("int")).alias("condition"),
            F.least(F.col("value") / 20, F.lit(1.0)).alias("score"),
        )

    @cached_property
    def points(self) -> DataFrame:
        li = self.raw("lineitem")
        copy = with_running(
            li,
            ["l_orderkey", "l_linenumber"],
            ["l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"],
            F.col("l_partkey"),
            rank="_copy",
        )
        copy = written(copy)  # all lines of the table; files take a small part of a checkpoint's disk
        return copy.select(
            (F.col("l_suppkey") % 8).alias("mission_id"),
            ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100000 + F.col("_copy")).alias("point_id"),
            (F.col("l_partkey") % 200 * F.lit(0.25) + F.lit(0.125)).alias("x"),
            (F.col("l_orderkey") % 200 * F.lit(0.25) + F.lit(0.125)).alias("y"),
            (F.col("l_quantity") * F.lit(0.1) + F.lit(0.05)).alias("z"),
            (F.lit(1.0) - F.col("l_discount") * 9).alias("confidence"),
            F.col("l_linenumber").cast("long").alias("observations"),
            F.col("l_tax").alias("residual"),
            F.when(F.col("l_returnflag") == "A", 2).when(F.col("l_returnflag") == "N", 5).otherwise(6).cast("long").alias("class"),
            F.when(F.col("l_linestatus") == "F", "baseline").otherwise("current").alias("epoch"),
        )

    @property
    def baseline(self) -> DataFrame:
        return self.points.filter("epoch = 'baseline'")

    @property
    def current(self) -> DataFrame:
        return self.points.filter("epoch = 'current'")

    @cached_property
    def vertices(self) -> DataFrame:
        p = F.col("p_partkey")
        return self.raw("part").select(
            F.floor(p / 1000).alias("mission_id"),
            p.alias("vid"),
            (p % 40 * F.lit(1.0)).alias("x"),
            (F.floor(p / 40) * F.lit(1.0)).alias("y"),
            (F.col("p_size") * F.lit(0.1)).alias("z"),
            (p * 7 % 10 / 10.0).alias("conf"),
            (p * 31 % 256).alias("r"),
            (p * 57 % 256).alias("g"),
            (p * 83 % 256).alias("b"),
            F.col("p_size").cast("long").alias("p_size"),
        )

    @cached_property
    def faces(self) -> DataFrame:
        v = self.vertices.select("mission_id", "vid", "p_size").filter("p_size % 7 <> 0 AND vid % 40 <> 39")
        far = self.vertices.select("mission_id", (F.col("vid") - 41).alias("vid"))
        two = F.array(
            F.struct((F.col("vid") * 2).alias("fid"), F.col("vid").alias("v0"), (F.col("vid") + 1).alias("v1"), (F.col("vid") + 40).alias("v2")),
            F.struct((F.col("vid") * 2 + 1).alias("fid"), (F.col("vid") + 1).alias("v0"), (F.col("vid") + 41).alias("v1"), (F.col("vid") + 40).alias("v2")),
        )
        return v.join(far.hint("merge"), ["mission_id", "vid"]).select("mission_id", "p_size", F.explode(two).alias("f")).select(
            "mission_id", "f.*", (F.col("p_size") % 8).alias("label"), ((F.col("p_size") * 3) % 10 / 10.0).alias("conf")
        )

    @cached_property
    def poses(self) -> DataFrame:
        s = F.col("s_suppkey")
        return self.raw("supplier").select(
            (s % 8).alias("mission_id"),
            s.alias("frame_id"),
            (F.floor(s / 8) * F.lit(0.5)).alias("ts_s"),
            (s % 10 * F.lit(5.0) + F.lit(2.5)).alias("cx"),
            (s * 3 % 11 * F.lit(4.5) + F.lit(1.25)).alias("cy"),
            (F.lit(60.0) + s % 3).alias("cz"),
        )

    @cached_property
    def depth_px(self) -> DataFrame:
        """One measured pixel per line item; nadir cameras, 64 x 64 pixels, focal length 60."""
        return (
            self.raw("lineitem")
            .select(
                (F.col("l_suppkey") % 8).alias("mission_id"),
                F.col("l_suppkey").alias("frame_id"),
                (F.col("l_partkey") % 64).alias("u"),
                (F.col("l_orderkey") % 64).alias("v"),
                (F.lit(55.0) + F.col("l_quantity") * F.lit(0.1)).alias("z"),
            )
            .groupBy("mission_id", "frame_id", "u", "v")
            .agg(F.min("z").alias("z"))
        )

    @cached_property
    def track(self) -> DataFrame:
        """Camera positions with a telemetry position each, for pair fits."""
        o = F.col("o_orderkey")
        th = F.lit(0.6)
        sx, sy, sz = o % 97 * F.lit(1.0), o * 7 % 89 * F.lit(1.0), o * 13 % 31 * F.lit(0.5)
        e = (F.col("o_totalprice") % 7 - 3) * F.lit(0.05)
        bad = F.when(o % 23 == 0, F.lit(40.0)).otherwise(F.lit(0.0))
        return self.raw("orders").select(
            (F.col("o_custkey") % 50).alias("mission_id"),
            o.alias("frame_id"),
            (o * F.lit(0.1)).alias("ts_s"),
            sx.alias("sx"), sy.alias("sy"), sz.alias("sz"),
            (F.lit(2.0) * (F.cos(th) * sx - F.sin(th) * sy) + 100 + e + bad).alias("dx"),
            (F.lit(2.0) * (F.sin(th) * sx + F.cos(th) * sy) + 50 - e).alias("dy"),
            (F.lit(2.0) * sz + 10 + e).alias("dz"),
        )

    @cached_property
    def history(self) -> DataFrame:
        o = F.col("o_orderkey")

        def num(e: Column) -> Column:
            return F.when(F.col("o_orderstatus") == "P", None).otherwise(e)

        return self.raw("orders").select(
            o.cast("string").alias("mission_id"),
            F.col("o_custkey").alias("scene_id"),
            (F.lit(40.0) + o % 80).alias("altitude_m"),
            (F.lit(3.0) + o % 12).alias("speed_m_s"),
            (F.lit(0.6) + o % 30 / 100.0).alias("forward_overlap"),
            (o * 7 % 101 * F.lit(1.0)).alias("env_score"),
            num(o * 11 % 101 * F.lit(1.0)).alias("gps_score"),
            num(o * 3 % 100 / 100.0).alias("coverage"),
            num(o * 17 % 100 / 100.0).alias("confidence"),
            (F.lit(100.0) - o * 5 % 90).alias("battery_pct"),
            num(F.col("o_totalprice") / 1000).alias("processing_time_s"),
            (F.col("o_orderstatus") == "F").alias("mission_success"),
        )

    @cached_property
    def stage_metrics(self) -> DataFrame:
        li = self.raw("lineitem")
        return li.select(
            F.col("l_orderkey").alias("mission_id"),
            F.element_at(F.array(*[F.lit(s) for s in STAGES]), F.col("l_linenumber")).alias("stage"),
            F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_discount") < 0.02, "cached").otherwise("completed").alias("status"),
            (F.col("l_extendedprice") / 100).alias("duration_sec"),
            F.col("l_quantity").cast("long").alias("input_count"),
            F.when(F.col("l_tax") > 0.01, F.col("l_partkey")).alias("output_count"),
        )

    @cached_property
    def mission_events(self) -> DataFrame:
        from skyfold.kernels.ordered import with_adjacent

        r = self._event_rows
        state = F.element_at(F.create_map(*[x for k, v in EVENT_STATE.items() for x in (F.lit(k), F.lit(v))]), F.col("event_type"))
        r = with_adjacent(
            r.withColumn("to_status", state), ["mission_id"], ["source_row"], F.floor(F.col("source_row") / 100000),
            prev={"from_status": F.col("to_status")},
        )
        return r.select("mission_id", F.col("source_row").alias("seq"), F.coalesce("from_status", F.lit("DRAFT")).alias("from_status"), "to_status")

    @cached_property
    def records(self) -> DataFrame:
        return self.raw("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("kind"), "text")

    @cached_property
    def questions(self) -> DataFrame:
        return self.raw("conversations").filter("role = 'user'").select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "text"
        )

    @cached_property
    def objects(self) -> DataFrame:
        """Scene objects, one per part."""
        p = F.col("p_partkey")
        x, y = p * 13 % 400 * F.lit(1.0), p * 29 % 300 * F.lit(1.0)
        h, s = p % 9 * F.lit(0.5) + F.lit(0.25), F.col("p_size") * F.lit(0.2)
        return self.raw("part").select(
            F.floor(p / 500).alias("mission_id"),
            p.alias("object_id"),
            F.element_at(F.array(*[F.lit(c) for c in CLASSES]), (F.col("p_size") % 8 + 1)).alias("class"),
            x.alias("x0"), y.alias("y0"), F.lit(0.0).alias("z0"), (x + s).alias("x1"), (y + s / 2).alias("y1"), h.alias("z1"),
            h.alias("height"), (s * s / 2).alias("area"),
            F.when(p % 3 == 0, s * s / 2 * h).alias("volume"),
            (p * 7 % 100 / 100.0).alias("confidence"),
        )

    @cached_property
    def gcp(self) -> DataFrame:
        """Surveyed points with an estimate each, one per order."""
        o = F.col("o_orderkey")
        return self.raw("orders").select(
            (F.col("o_custkey") % 50).alias("mission_id"),
            F.floor(o / 2).alias("id"),
            F.when(o % 5 == 0, "control").otherwise("check").alias("role"),
            (o % 100 * F.lit(1.0)).alias("x"), (o % 70 * F.lit(1.0)).alias("y"), (o % 30 * F.lit(1.0)).alias("z"),
            (o % 100 + o % 7 * F.lit(0.1)).alias("ex"), (o % 70 - o % 5 * F.lit(0.1)).alias("ey"), (o % 30 + o % 3 * F.lit(0.25)).alias("ez"),
            (F.lit(5.0) + o % 11).alias("distance_m"),
        )


# Names used by the rules.
CLASSES = ["ground", "structure", "roof", "wall", "vegetation", "water", "vehicle", "unclassified"]
CONDITIONS = ["fog_haze", "smoke_dust", "lowlight", "motion_blur", "sun_glare", "strong_shadows", "lens_artifacts", "cloud_cover", "rain_streaks"]
STAGES = ["frames", "sparse", "depth", "dense", "georef", "mesh", "texture"]
EVENT_STATE = {"view": "READY", "click": "QUEUED", "signup": "RUNNING", "purchase": "COMPLETED", "error": "FAILED"}


def _case(col: str, names: list[str]) -> str:
    return f"CASE {col} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


SQL_TABLES = {
    "event_rows": """SELECT user_id AS mission_id, event_id, event_type, value,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS source_row FROM events""",
    "telemetry": """SELECT mission_id, source_row, source_row*0.2e0 + (event_id%3)*0.01e0 AS ts_s,
  CASE WHEN event_type='error' THEN NULL WHEN event_type='signup' THEN 0.0e0
       ELSE 24.53e0 + 0.00002e0*(source_row - source_row%3) + CASE WHEN event_id%97=0 THEN 0.01e0 ELSE 0.0e0 END END AS lat,
  CASE WHEN event_type='error' THEN NULL WHEN event_type='signup' THEN 0.0e0
       ELSE 120.93e0 + 0.00001e0*((source_row - source_row%3)%20) END AS lon,
  350.0e0 + value/100 AS alt_m FROM event_rows""",
    "frames": """SELECT mission_id, source_row AS frame_num, source_row*0.2e0 + 0.07e0 AS timestamp_sec,
  (event_id*37%100)/100.0e0 AS blur, (event_id*53%100)/100.0e0 AS sharpness, (event_id*71%100)/100.0e0 AS exposure,
  (event_id*13%20)/100.0e0 AS motion, (event_id*48271)%2147483647 AS phash
FROM event_rows WHERE event_type IN ('click','view')""",
    "detections": f"""SELECT mission_id, source_row AS frame_num, {_case('event_id%9', CONDITIONS)} AS condition, least(value/20,1.0e0) AS score FROM event_rows""",
    "points": """SELECT l_suppkey%8 AS mission_id,
  (l_orderkey*8+l_linenumber)*100000 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber
     ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS point_id,
  (l_partkey%200)*0.25e0+0.125e0 AS x, (l_orderkey%200)*0.25e0+0.125e0 AS y, l_quantity*0.1e0+0.05e0 AS z,
  1.0e0 - l_discount*9 AS confidence, CAST(l_linenumber AS BIGINT) AS observations, l_tax AS residual,
  CAST(CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 5 ELSE 6 END AS BIGINT) AS class,
  CASE l_linestatus WHEN 'F' THEN 'baseline' ELSE 'current' END AS epoch FROM lineitem""",
    "vertices": """SELECT CAST(floor(p_partkey/1000) AS BIGINT) AS mission_id, p_partkey AS vid, (p_partkey%40)*1.0e0 AS x,
  floor(p_partkey/40)*1.0e0 AS y, p_size*0.1e0 AS z, (p_partkey*7%10)/10.0e0 AS conf,
  p_partkey*31%256 AS r, p_partkey*57%256 AS g, p_partkey*83%256 AS b, CAST(p_size AS BIGINT) AS p_size FROM part""",
    "faces": """SELECT c.mission_id, CASE h.i WHEN 0 THEN c.vid*2 ELSE c.vid*2+1 END AS fid,
  CASE h.i WHEN 0 THEN c.vid ELSE c.vid+1 END AS v0, CASE h.i WHEN 0 THEN c.vid+1 ELSE c.vid+41 END AS v1, c.vid+40 AS v2,
  c.p_size%8 AS label, (c.p_size*3%10)/10.0e0 AS conf
FROM vertices c JOIN vertices d ON d.vid=c.vid+41 AND d.mission_id=c.mission_id, (VALUES (0),(1)) h(i)
WHERE c.p_size%7<>0 AND c.vid%40<>39""",
    "poses": """SELECT s_suppkey%8 AS mission_id, s_suppkey AS frame_id, floor(s_suppkey/8)*0.5e0 AS ts_s, (s_suppkey%10)*5.0e0+2.5e0 AS cx,
  (s_suppkey*3%11)*4.5e0+1.25e0 AS cy, 60.0e0 + s_suppkey%3 AS cz FROM supplier""",
    "depth_px": """SELECT l_suppkey%8 AS mission_id, l_suppkey AS frame_id, l_partkey%64 AS u, l_orderkey%64 AS v,
  min(55.0e0 + l_quantity*0.1e0) AS z FROM lineitem GROUP BY 1,2,3,4""",
    "track": """SELECT o_custkey%50 AS mission_id, o_orderkey AS frame_id, o_orderkey*0.1e0 AS ts_s, sx, sy, sz,
  2.0e0*(cos(0.6e0)*sx - sin(0.6e0)*sy) + 100 + e + bad AS dx, 2.0e0*(sin(0.6e0)*sx + cos(0.6e0)*sy) + 50 - e AS dy, 2.0e0*sz + 10 + e AS dz
FROM (SELECT *, (o_orderkey%97)*1.0e0 AS sx, (o_orderkey*7%89)*1.0e0 AS sy, (o_orderkey*13%31)*0.5e0 AS sz,
  (o_totalprice%7 - 3)*0.05e0 AS e, CASE WHEN o_orderkey%23=0 THEN 40.0e0 ELSE 0.0e0 END AS bad FROM orders)""",
    "history": """SELECT CAST(o_orderkey AS VARCHAR) AS mission_id, o_custkey AS scene_id, 40.0e0 + o_orderkey%80 AS altitude_m, 3.0e0 + o_orderkey%12 AS speed_m_s,
  0.6e0 + (o_orderkey%30)/100.0e0 AS forward_overlap, (o_orderkey*7%101)*1.0e0 AS env_score,
  CASE WHEN o_orderstatus<>'P' THEN (o_orderkey*11%101)*1.0e0 END AS gps_score, CASE WHEN o_orderstatus<>'P' THEN (o_orderkey*3%100)/100.0e0 END AS coverage,
  CASE WHEN o_orderstatus<>'P' THEN (o_orderkey*17%100)/100.0e0 END AS confidence, 100.0e0 - o_orderkey*5%90 AS battery_pct,
  CASE WHEN o_orderstatus<>'P' THEN o_totalprice/1000 END AS processing_time_s, o_orderstatus='F' AS mission_success FROM orders""",
    "stage_metrics": f"""SELECT l_orderkey AS mission_id, {_case('l_linenumber-1', STAGES)} AS stage,
  CASE WHEN l_returnflag='R' THEN 'failed' WHEN l_discount<0.02 THEN 'cached' ELSE 'completed' END AS status,
  l_extendedprice/100 AS duration_sec, CAST(l_quantity AS BIGINT) AS input_count, CASE WHEN l_tax>0.01 THEN l_partkey END AS output_count FROM lineitem""",
    "mission_events": """SELECT mission_id, source_row AS seq, coalesce(lag(to_status) OVER (PARTITION BY mission_id ORDER BY source_row), 'DRAFT') AS from_status, to_status
FROM (SELECT *, CASE event_type """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_STATE.items()) + """ END AS to_status FROM event_rows)""",
    "records": "SELECT doc_id AS id, source AS kind, text FROM documents",
    "questions": "SELECT conv_id*1000+turn AS qid, text FROM conversations WHERE role='user'",
    "objects": f"""SELECT *, h AS height, s*s/2 AS area, CASE WHEN object_id%3=0 THEN s*s/2*h END AS volume,
  (object_id*7%100)/100.0e0 AS confidence FROM (SELECT mission_id, object_id, class, x0, y0, 0.0e0 AS z0, x0+s AS x1, y0+s/2 AS y1, h AS z1, h, s
  FROM (SELECT CAST(floor(p_partkey/500) AS BIGINT) AS mission_id, p_partkey AS object_id, {_case('p_size%8', CLASSES)} AS class,
  (p_partkey*13%400)*1.0e0 AS x0, (p_partkey*29%300)*1.0e0 AS y0, (p_partkey%9)*0.5e0+0.25e0 AS h, p_size*0.2e0 AS s FROM part))""",
    "gcp": """SELECT o_custkey%50 AS mission_id, CAST(floor(o_orderkey/2) AS BIGINT) AS id, CASE WHEN o_orderkey%5=0 THEN 'control' ELSE 'check' END AS role,
  (o_orderkey%100)*1.0e0 AS x, (o_orderkey%70)*1.0e0 AS y, (o_orderkey%30)*1.0e0 AS z, o_orderkey%100+(o_orderkey%7)*0.1e0 AS ex,
  o_orderkey%70-(o_orderkey%5)*0.1e0 AS ey, o_orderkey%30+(o_orderkey%3)*0.25e0 AS ez, 5.0e0+o_orderkey%11 AS distance_m FROM orders""",
}
