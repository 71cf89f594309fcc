"""File sources and catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Artifact categories by first folder, outputs at the root by ending, names of a dataset's files.
FOLDERS = {
    "raw": ["raw"],
    "processed": ["frames", "selected", "frames_selected"],
    "intermediate": ["depth", "checkpoints", "tmp", ".cache"],
    "final": ["dense", "mesh", "georef", "intel", "exports", "textures", "lods"],
    "logs": ["logs"],
}
FINAL_ENDINGS = ["ply", "obj", "glb", "gltf", "las", "laz", "json", "csv", "md", "html"]
REFERENCE_ENDINGS = ["las", "laz", "npz"]
TELEMETRY_NAMES = ["poses.csv", "movingdrone_telemetry.csv", "video.SRT"]


def read_history(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Mission history lines, and the number of corrupt lines per file."""
    raw = spark.read.text(path).withColumn("file", F.col("_metadata.file_path")).filter("trim(value) <> ''")
    ok = F.try_parse_json("value").isNotNull() & F.get_json_object("value", "$.mission_id").isNotNull()
    good = raw.filter(ok).select("file", F.get_json_object("value", "$.mission_id").alias("mission_id"), F.col("value").alias("record"))
    return good, raw.groupBy("file").agg(F.count_if(~ok).alias("corrupt_lines"), F.count_if(ok).alias("records"))


def upsert_history(old: DataFrame, new: DataFrame) -> DataFrame:
    """The same ``mission_id`` replaces; the highest ``seq`` wins, new rows over old ones."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    cols = old.columns
    return both.groupBy("mission_id").agg(F.max(F.struct("_new", "seq", *[c for c in cols if c not in ("mission_id", "seq")])).alias("r")).select("mission_id", *[F.col(f"r.{c}").alias(c) for c in cols if c != "mission_id"])


def read_points(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Points with finite coordinates."""
    df = spark.read.format(fmt).option("header", True).option("inferSchema", fmt == "csv").load(path)
    return df.filter(" AND ".join(f"{a} IS NOT NULL AND NOT isnan({a})" for a in "xyz"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Names and sizes; the content column is never read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def category(rel: Column) -> Column:
    """Category of a file by the first part of its path inside the workspace, else by its ending: outputs are final, the rest raw."""
    head = F.element_at(F.split(rel, "/"), 1)
    e = F.lit(None).cast("string")
    for name, folders in FOLDERS.items():
        e = F.coalesce(e, F.when(head.isin(folders), name))
    ending = F.regexp_extract(rel, r"\.([A-Za-z0-9]+)$", 1)
    return F.coalesce(e, F.when(ending.isin(FINAL_ENDINGS), "final"), F.lit("raw"))


def catalog_artifacts(files: DataFrame, root: str, limit: int | None = None) -> DataFrame:
    """Files of each run with category; point clouds first, then path; all, or the first ``limit``."""
    rel = F.regexp_replace("path", f"^.*{root}/?", "")
    f = files.select("*", rel.alias("rel")).withColumn("run_id", F.split("rel", "/")[0]).withColumn("category", category(F.regexp_replace("rel", "^[^/]*/", "")))
    w = Window.partitionBy("run_id").orderBy(F.when(F.col("rel").endswith(".ply"), 0).otherwise(1), "rel")
    ranked = f.withColumn("rank", F.row_number().over(w))
    return ranked.filter(F.col("rank") <= limit) if limit else ranked


def storage_summary(files: DataFrame, rel: str = "rel") -> DataFrame:
    """Files and bytes per category; ``rel`` is the path inside the workspace."""
    return files.withColumn("category", category(F.col(rel))).groupBy("category").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and SHA-256 of every file."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return d.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_identity(files: DataFrame, recorded: DataFrame) -> DataFrame:
    """Each name as verified, mismatched, missing or unverified; ``name, bytes, sha256`` on both sides."""
    j = files.alias("f").join(recorded.alias("r"), "name", "full")
    same = (F.col("f.bytes") == F.col("r.bytes")) & (F.col("f.sha256") == F.col("r.sha256"))
    return j.select("name", F.when(F.col("r.sha256").isNull(), "unverified").when(F.col("f.sha256").isNull(), "missing").when(same, "verified").otherwise("mismatch").alias("status"))


def fingerprint(parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.array_sort(parts)))


def staleness(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Why a stage would run again; ``run_id, stage, inputs, params`` (map) on both sides."""
    j = current.alias("c").join(recorded.alias("r"), ["run_id", "stage"], "left")
    keys = F.array_sort(F.array_distinct(F.concat(F.map_keys("c.params"), F.coalesce(F.map_keys("r.params"), F.array().cast("array<string>")))))
    changed = F.filter(keys, lambda k: ~F.col("c.params")[k].eqNullSafe(F.col("r.params")[k]))
    return j.select(
        "run_id", "stage",
        F.when(F.col("r.inputs").isNull(), "no_record").when(F.col("r.params").isNull(), "legacy_record_without_params").when(F.size(changed) > 0, F.concat(F.lit("params_changed("), F.concat_ws(",", changed), F.lit(")")))
        .when(F.col("c.inputs") != F.col("r.inputs"), "inputs_changed").otherwise("match").alias("state"),
    )


def dataset_catalog(files: DataFrame) -> DataFrame:
    """Telemetry files and the reference scan of each folder: a ``lidar`` name first, else the only candidate, never a guess."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    f = files.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"), name.alias("name"))
    scan = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)).isin(REFERENCE_ENDINGS)
    own = F.array_position(F.array(*[F.lit(f"lidar.{e}") for e in REFERENCE_ENDINGS]), F.col("name"))
    a = f.groupBy("folder").agg(F.count_if(F.col("name").isin(TELEMETRY_NAMES)).alias("telemetry"), F.min_by("name", F.when(own > 0, own)).alias("_named"), F.count_if(scan).alias("scans"), F.min(F.when(scan, F.col("name"))).alias("_one"))
    return a.select("folder", "telemetry", "scans", F.coalesce("_named", F.when(F.col("scans") == 1, F.col("_one"))).alias("reference"))


def read_runs(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Run records; a manifest wins over a report and an earlier root over a later one."""
    out = None
    for i, root in enumerate(roots):
        d = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="{manifest,pipeline_report}.json")
        d = d.select(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("run_id"), F.col("_metadata.file_name").alias("source"), F.col("value").alias("record"), F.lit(i).alias("_root"))
        out = d if out is None else out.unionByName(d)
    return out.groupBy("run_id").agg(F.min(F.struct("_root", "source", "record")).alias("m")).select("run_id", "m.source", "m.record").orderBy(F.desc("run_id"))


def objects_to_geojson(objects: DataFrame, transforms: DataFrame) -> DataFrame:
    """One GeoJSON feature text per object; ``transforms(mission_id, m)`` with the row-major 4 x 4 matrix."""
    j = objects.join(transforms, "mission_id")

    def at(x: str, y: str) -> Column:
        p = [F.col(x), F.col(y), F.col("z0"), F.lit(1.0)]
        return F.array(*[sum((F.col("m")[4 * r + k] * p[k] for k in range(4)), F.lit(0.0)) for r in range(2)])

    ring = F.array(at("x0", "y0"), at("x1", "y0"), at("x1", "y1"), at("x0", "y1"), at("x0", "y0"))
    f = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"), F.struct("class", "height", "area", "volume").alias("properties")))
    return j.select("mission_id", "object_id", f.alias("feature"))


TELEMETRY_COLUMNS = ["source_row", "ts_s", "lat", "lon", "alt_m", "alt_agl_m", "roll", "pitch", "yaw", "heading", "speed", "gps_accuracy", "h_acc", "v_acc", "satellites", "hdop", "vdop", "frame_number", "sequence", "gps_status"]


def write_telemetry(df: DataFrame, path: str) -> None:
    """The 20 telemetry columns as CSV per mission: nulls blank, nine decimals for time and position."""
    nine = {"ts_s", "lat", "lon"}
    col = lambda c: (F.format_string("%.9f", F.col(c).cast("double")) if c in nine else F.col(c).cast("string")) if c in df.columns else F.lit(None).cast("string")
    out = df.select("mission_id", *[F.when(F.col(c).isNotNull(), col(c)).alias(c) if c in df.columns else col(c).alias(c) for c in TELEMETRY_COLUMNS])
    out.write.mode("overwrite").partitionBy("mission_id").option("header", True).option("nullValue", "").csv(path)


def write_track(df: DataFrame, path: str) -> None:
    """Track rows ``idx, lat, lon, alt_m, e, n, u`` as CSV."""
    names = {"idx": "index", "lat": "lat", "lon": "lon", "alt_m": "alt_m", "e": "east_m", "n": "north_m", "u": "up_m"}
    df.select("mission_id", *[F.col(a).alias(b) for a, b in names.items()]).write.mode("overwrite").partitionBy("mission_id").option("header", True).csv(path)
