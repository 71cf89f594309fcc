"""Structured Streaming jobs; each returns a streaming DataFrame or a started query."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skyfold.operators.cloud import VOXEL, voxels
from skyfold.operators.telemetry import KEY, gps_status


def voxel_sums(points: DataFrame, size: float) -> DataFrame:
    """Additive voxel model of a (streaming or static) point table; late chunks only add."""
    w = F.col("confidence")
    return voxels(points, size).groupBy(*KEY, *VOXEL).agg(
        F.sum(w).alias("w"), *[F.sum(F.col(a) * w).alias(f"w{a}") for a in "xyz"], F.count(F.lit(1)).alias("n"), F.sum(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2).alias("sq")
    )


def voxel_model(sums: DataFrame) -> DataFrame:
    """Points of the running model."""
    safe = F.when(F.col("w") > 0, F.col("w")).otherwise(1.0)
    return sums.select(*KEY, *VOXEL, *[(F.col(f"w{a}") / safe).alias(a) for a in "xyz"], (F.col("w") / F.col("n")).alias("confidence"), F.col("n").alias("observations"))


def stream_voxel_model(points: DataFrame, size: float, path: str, checkpoint: str):
    """Write the changed voxels of every micro-batch under ``path/version=<batch>``."""
    def write(batch: DataFrame, version: int) -> None:
        batch.withColumn("version", F.lit(version)).write.mode("overwrite").parquet(f"{path}/version={version}")

    return voxel_sums(points, size).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def latest_voxels(spark, path: str) -> DataFrame:
    """The newest sums of every voxel over all versions."""
    d = spark.read.option("recursiveFileLookup", True).parquet(path)
    rest = [c for c in d.columns if c not in (*KEY, *VOXEL, "version")]
    return d.groupBy(*KEY, *VOXEL).agg(F.max_by(F.struct(*rest), "version").alias("r")).select(*KEY, *VOXEL, "r.*")


def job_state(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Latest event per job and stage; ``job_id, stage, event_id, event_ts, type, payload``."""
    e = events.withWatermark("event_ts", lateness).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
    return e.groupBy("job_id", "stage").agg(F.max_by(F.struct("type", "payload"), F.struct("event_ts", "event_id")).alias("last"), F.max("event_ts").alias("event_ts"), F.count(F.lit(1)).alias("events")).select(
        "job_id", "stage", "last.type", "last.payload", "event_ts", "events", F.col("last.type").isin("completed", "failed", "cancelled").alias("terminal")
    )


def telemetry_rows(raw: DataFrame) -> DataFrame:
    """Row rules of telemetry intake on a stream: status per row, stateless."""
    return gps_status(raw)
