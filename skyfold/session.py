"""Session defaults and lineage cutting."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "skyfold", cpus: str | int = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SKYFOLD_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster a
    machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-")
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder and read them back without lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As ``cut``, but in columns and packed: for small tables of a loop, and for large ones of which readers take few columns.

    A checkpoint keeps the size that the plan was estimated to have.  Joined round by round these estimates multiply until the numbers
    alone take minutes; rows that come from files have the size of the files.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SHUFFLES = re.compile(r"\b(Join|Aggregate|Window|Sort|Generate|Expand|Deduplicate|\w*RepartitionByExpression|MapInPandas|FlatMapGroupsInPandas|ArrowEvalPython)\b")


def once(df: DataFrame) -> DataFrame:
    """For rows that the caller reads more than once.

    A plain scan with filters and projections is read again (pushdown and
    pruning make that cheap).  Anything with a shuffle or a generator behind it
    is written once, so that branching operators do not multiply their inputs.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return cut(df) if SHUFFLES.search(plan) else df
