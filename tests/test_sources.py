"""File sources and streaming jobs on small hand-made inputs."""

from pyspark.sql import functions as F

from skyfold.functions.parse import parse_dms, parse_iso, parse_iso6709, parse_number
from skyfold.plans import derive
from skyfold.sources import files as fi, telemetry_text as tt
from skyfold.streaming import jobs


def test_cell_casts(spark):
    d = spark.createDataFrame([("1.5e2", "11°01'30\"S", "2024-01-01T00:00:10", "+24.5+120.9+35.0/")], "a string, b string, c string, d string")
    r = d.select(parse_number("a") if False else parse_number(F.col("a")), parse_dms(F.col("b")), parse_iso(F.col("c")), *parse_iso6709(F.col("d"))).first()
    assert r[0] == 150 and abs(r[1] + 11.025) < 1e-9 and r[2] == 1704067210 and list(r[3:]) == [24.5, 120.9, 35.0]


def test_degrees_refuse_stray_signs(spark):
    cells = ["12-30N", "N-12", "-12N", "+12 30 S", "N12", "12°30'N", "12", "12 N E", "W 120°54'36\""]
    got = [r[0] for r in spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").orderBy("i").select(parse_dms(F.col("c"))).collect()]
    assert got[:8] == [None, None, 12, -12.5, 12, 12.5, None, None] and abs(got[8] + 120.91) < 1e-9


def test_every_word_names_its_concept(spark):
    from skyfold.operators.concepts import CONCEPT_CLASSES, SYNONYMS, concept

    got = spark.createDataFrame([(w, f"show the {w} please") for w in SYNONYMS], "w string, q string").select("w", concept(F.col("q"))).collect()
    assert dict(map(tuple, got)) == SYNONYMS and set(SYNONYMS.values()) <= set(CONCEPT_CLASSES) and SYNONYMS["terrain"] == "terrain"


def test_srt(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\n00:00:01,500 --> 00:00:02,000\n[latitude: 24.5] [longitude: 120.9] [rel_alt: 10.0 abs_alt: 50.5]\n\n2\n00:00:02,000 --> 00:00:03,000\nGPS(120.9,24.6,51)\n")
    r = tt.read_srt(spark, str(tmp_path)).orderBy("counter").collect()
    assert [x.ts_s for x in r] == [1.5, 2.0] and r[0].alt_m == 50.5 and (r[1].lat, r[1].lon) == (24.6, 120.9) and not r[0].bad
    assert tt.srt_to_telemetry(tt.read_srt(spark, str(tmp_path))).count() == 2


def test_catalogue(spark, tmp_path):
    for n in ("run1/raw/a.mp4", "run1/dense.ply", "run1/scan.las", "run2/x.log"):
        p = tmp_path / n
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x")
    f = fi.list_files(spark, str(tmp_path))
    f = f.withColumn("rel", F.regexp_replace("path", ".*/run[0-9]/", ""))
    assert {r.category: r.files for r in fi.storage_summary(f).collect()} == {"raw": 2, "final": 2}
    h = fi.file_hashes(spark, str(tmp_path))
    rec = h.filter("name = 'a.mp4'").unionByName(spark.createDataFrame([("gone", 1, "x")], "name string, bytes long, sha256 string"))
    assert {r.name: r.status for r in fi.verify_identity(h, rec).collect()}["gone"] == "missing"


def test_voxel_stream_equals_batch(spark, tmp_path):
    p = derive.Tables(spark, "/root/testdata/sf0.001").points
    p.repartition(3).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.stream_voxel_model(s, 2.0, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    a = jobs.voxel_model(jobs.latest_voxels(spark, str(tmp_path / "out"))).agg(F.count(F.lit(1)), F.sum("observations"), F.sum("x")).first()
    b = jobs.voxel_model(jobs.voxel_sums(p, 2.0)).agg(F.count(F.lit(1)), F.sum("observations"), F.sum("x")).first()
    assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-6
