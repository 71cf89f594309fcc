"""Tables written once to the shared folder, and what Python tasks need."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from skyfold.session import checkpoint_dir

BATCH_BYTES = 8 << 20
_made: list[str] = []
_shipped: set[str] = set()


def folder(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new folder name under ``spark.checkpoint.dir``; with ``keep``, ``passing`` leaves it alone."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not keep:
        _made.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet to the shared folder and read back, so that later jobs do not run ``df`` again.

    Lost executors cost nothing: the files are complete before they are read.
    """
    spark, schema = df.sparkSession, df.schema
    path = folder(spark, name)
    df.write.parquet(path)
    del df
    gc.collect()  # then Spark's cleaner drops the shuffle files of finished steps, which count as disk until then
    spark._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def mark() -> int:
    """How many folders have been written so far."""
    return len(_made)


def forget(spark: SparkSession, since: int, but: tuple[str, ...] = ()) -> None:
    """Delete the folders written since ``mark``, but those of the named tables."""
    conf = spark._jsc.hadoopConfiguration()
    kept = []
    for name in _made[since:]:
        if name.rpartition("/")[2].rpartition("-")[0] in but:
            kept.append(name)
        else:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
    _made[since:] = kept


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what was written inside; for callers that store their result elsewhere before they leave."""
    since = mark()
    try:
        yield
    finally:
        forget(spark, since)


def prepare(spark: SparkSession) -> None:
    """For operators with Python tasks: bound Arrow batches by bytes, for very long texts, and give the workers this package."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        at = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
        with zipfile.ZipFile(at, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(at))
        _shipped.add(sc.applicationId)


def columns(df: DataFrame, *wanted: str) -> None:
    """Complain about missing columns by name."""
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")


def others(df: DataFrame, *new: str) -> list[str]:
    """Columns of ``df`` that do not clash with ``new`` (Spark does not tell cases apart)."""
    low = {c.lower() for c in new}
    return [c for c in df.columns if c.lower() not in low]
