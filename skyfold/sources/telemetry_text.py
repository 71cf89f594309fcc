"""Telemetry text: subtitle logs and units of mapped columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """Subtitle blocks with position and gimbal angles; files with repeated counters are flagged ``bad``."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.explode(F.split(F.regexp_replace("value", "\r", ""), r"\n\s*\n")).alias("b")).filter("trim(b) <> ''")
    return parse_srt(raw)


def parse_srt(blocks: DataFrame) -> DataFrame:
    """Fields of subtitle blocks ``file, b``."""
    g = lambda p, i=1: F.regexp_extract("b", p, i).try_cast("double")
    clock = r"(\d+):(\d+):(\d+)[,.](\d+)\s*-->"
    num = r"\s*:?\s*([+-]?\d+(?:\.\d+)?)"
    legacy = r"GPS\s*\(([+-]?\d+(?:\.\d+)?),\s*([+-]?\d+(?:\.\d+)?)(?:,\s*([+-]?\d+(?:\.\d+)?))?"
    d = blocks.select(
        "file", F.regexp_extract("b", r"^\s*(\d+)", 1).try_cast("long").alias("counter"),
        (g(clock, 1) * 3600 + g(clock, 2) * 60 + g(clock, 3) + g(clock, 4) / 1000).alias("ts_s"),
        F.coalesce(g("latitude" + num), g(legacy, 1)).alias("la"), F.coalesce(g("long(?:i)?tude" + num), g(legacy, 2)).alias("lo"), F.coalesce(g("abs_alt" + num), g(legacy, 3)).alias("alt_m"),
        g("rel_alt" + num).alias("alt_agl_m"), g("gb_yaw" + num).alias("yaw"), g("gb_pitch" + num).alias("pitch"), g("gb_roll" + num).alias("roll"), g("focal_len" + num).alias("focal"),
    )
    swap = (F.abs("la") > 90) & (F.abs("lo") <= 90)
    d = d.select("*", F.when(swap, F.col("lo")).otherwise(F.col("la")).alias("lat"), F.when(swap, F.col("la")).otherwise(F.col("lo")).alias("lon")).drop("la", "lo")
    bad = d.groupBy("file").agg((F.count_distinct("counter") < F.count("counter")).alias("bad"))
    return d.join(bad, "file")


def srt_to_telemetry(frames: DataFrame) -> DataFrame:
    """Position-only logs as telemetry; files with any gimbal row are refused here."""
    oriented = frames.filter("yaw IS NOT NULL").select("file").distinct()
    return frames.join(oriented, "file", "left_anti").select(F.col("file").alias("mission_id"), (F.col("counter") - 1).alias("source_row"), "ts_s", "lat", "lon", "alt_m", "alt_agl_m")


def convert_units(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Feet to metres, 0-360 longitudes to signed, time to seconds; ``mapping(mission_id, feet, lon360, time_factor)``."""
    j = df.join(mapping, "mission_id", "left")
    alt, lon = F.col("alt_m"), F.col("lon")
    new = {
        "alt_m": F.when(F.col("feet"), alt * 0.3048).otherwise(alt),
        "lon": F.when(F.col("lon360") & (lon > 180), lon - 360).otherwise(lon),
        "ts_s": F.col("ts_s") * F.coalesce("time_factor", F.lit(1.0)),
    }
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])
