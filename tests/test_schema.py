"""Logs of many dialects: what the header search, the value checks and the column choice make of them."""

import pytest

from skyfold.sources import schema

FILES = {
    "plain.csv": "timestamp,latitude,longitude,altitude\n0,24.53,120.93,350\n1,24.531,120.931,351\n2,,,352\n3,24.533,120.933,353\n",
    "meta.csv": "Aircraft: ABC\nPilot: none, really\nTime (s),GPS Latitude,GPS Longitude,GPS Altitude,Satellites\n0,24.53,120.93,350,9\n\n1,24.54,120.94,351,10\n",
    "comma.csv": "time;lat;lon;alt\n0,000000;52,351;13,1;90,5\n0,200000;52,352;13,2;91,5\n0,400000;52,353;13,3;92,5\n",
    "bom.csv": "﻿time_ms\tlat\tlon\trel_alt\n1000\t24.5\t120.9\t10\n2000\t24.6\t120.8\t11\n3000\t24.7\t120.7\t12\n",
    "dms.csv": "utc|latitude|longitude\n2024-01-01T00:00:00Z|24°30'00\"N|120°54'00\"W\n2024-01-01T00:00:01Z|24°30'36\"N|120°54'36\"W\n",
    "wide.csv": "time,lat,lon,altitude_ft\n0,10,250,100\n1,10,251,200\n2,10,179,300\n3,10,252,x\n",
    "swap.csv": 'lat_deg,latitude,lon,note,speed\n500,24.5,120.9,"a, b",3\n600,24.6,120.8,"c ""d"", e",4\n',
    "bad.csv": "latitude,longitude,time\n900,500,1\n901,501,2\n",
    "none.csv": "a b c\nd e f\n",
    "pose.csv": "frame_id,x,y,z,qw,qx\n1,2,3,4,5,6\n2,3,4,5,6,7\n",
    "epoch.csv": "gps_time,lat,lon\n1700000000,1,2\n1700000001,1,2\n1700000002,1,2\n",
}


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("logs")
    for name, text in FILES.items():
        (top / name).write_text(text, encoding="utf-8")
    (top / "latin.csv").write_bytes("temps;latitude;longitude;höhe\n".encode("latin-1") + b"0;1.5;2.5;3\n1;1.6;2.6;4\n")
    rows, layout, chosen = schema.read_telemetry(spark, str(top))
    name = lambda r: r["file"].rsplit("/", 1)[1]
    by = {}
    for r in rows.orderBy("file", "source_row").collect():
        by.setdefault(name(r), []).append(r)
    events = {}
    for r in chosen.collect():
        events.setdefault(name(r), []).append(r)
    return by, {name(r): r for r in layout.collect()}, events


def mapping(events):
    return {r["canonical"]: r["header"] for r in events if r["event"] == "mapping"}


def test_layouts(read):
    _, layout, _ = read
    assert {n: (r["delimiter"], r["encoding"], r["decimal_comma"]) for n, r in layout.items()} == {
        "plain.csv": (",", "utf-8", False), "meta.csv": (",", "utf-8", False), "comma.csv": (";", "utf-8", True), "bom.csv": ("\t", "utf-8", False), "dms.csv": ("|", "utf-8", False),
        "wide.csv": (",", "utf-8", False), "swap.csv": (",", "utf-8", False), "bad.csv": (",", "utf-8", False), "none.csv": (",", "utf-8", False), "pose.csv": (",", "utf-8", False),
        "epoch.csv": (",", "utf-8", False), "latin.csv": (";", "latin-1", False),
    }
    assert layout["meta.csv"]["header"][1] == "GPS Latitude" and layout["latin.csv"]["header"][3] == "höhe" and layout["none.csv"]["header"] == ["a b c"]


def test_rows(read):
    rows, _, _ = read
    at = lambda n, *c: [tuple(r[x] for x in c) for r in rows[n]]
    assert at("plain.csv", "timestamp", "latitude", "altitude") == [(0, 24.53, 350), (1, 24.531, 351), (2, None, 352), (3, 24.533, 353)]
    assert at("meta.csv", "timestamp", "latitude", "satellites") == [(0, 24.53, 9), (1, 24.54, 10)]
    assert at("comma.csv", "timestamp", "latitude", "altitude") == [(0, 52.351, 90.5), (0.2, 52.352, 91.5), (0.4, 52.353, 92.5)]
    assert at("bom.csv", "timestamp", "altitude", "altitude_agl") == [(1, None, 10), (2, None, 11), (3, None, 12)]
    assert [(r["timestamp"], round(r["latitude"], 6), round(r["longitude"], 6)) for r in rows["dms.csv"]] == [(1704067200, 24.5, -120.9), (1704067201, 24.51, -120.91)]
    assert at("wide.csv", "longitude") == [(-110,), (-109,), (179,), (-108,)] and [r["altitude"] for r in rows["wide.csv"]][:3] == pytest.approx([30.48, 60.96, 91.44]) and rows["wide.csv"][3]["altitude"] is None
    assert at("swap.csv", "latitude", "velocity_x") == [(24.5, 3), (24.6, 4)]  # "speed" is part of a name of velocity_x, which chooses first
    assert at("latin.csv", "latitude", "longitude") == [(1.5, 2.5), (1.6, 2.6)]
    assert at("epoch.csv", "timestamp") == [(1700000000,), (1700000001,), (1700000002,)]


def test_choices(read):
    _, _, events = read
    assert mapping(events["swap.csv"])["latitude"] == "latitude"
    assert [(r["event"], r["others"]) for r in events["swap.csv"] if r["canonical"] == "latitude" and r["event"] != "mapping"] == [("rejected", ["lat_deg"]), ("ranked", ["lat_deg"])]
    bad = {r["canonical"]: r for r in events["bad.csv"] if r["event"] == "mapping"}
    assert bad["latitude"]["status"] == "UNVALIDATED" and {r["canonical"] for r in events["bad.csv"] if r["event"] == "kept_unvalidated"} == {"latitude", "longitude"}
    assert mapping(events["pose.csv"]) == {"frame_number": "frame_id"} and "none.csv" not in events
    plain = {r["canonical"]: r for r in events["plain.csv"] if r["event"] == "mapping"}
    assert plain["latitude"]["confidence"] == pytest.approx(0.985) and plain["altitude"]["reference"] == "MSL (assumed)"
    assert {r["canonical"]: r["reference"] for r in events["meta.csv"] if r["event"] == "mapping"}["altitude"] == "MSL"
    assert {r["canonical"]: r["unit"] for r in events["wide.csv"] if r["event"] == "mapping"} == {"timestamp": "relative_seconds", "latitude": "degrees", "longitude": "degrees_0_360", "altitude": "feet"}


def test_all_values_decide(spark):
    """A column whose first cells fit and whose others do not is refused, wherever they stand."""
    rows = spark.createDataFrame([("f", i, [str(20.0 if i < 300 else 400.0)], False) for i in range(1000)], "file string, line long, cells array<string>, decimal_comma boolean")
    named = spark.createDataFrame([("f", 0, "lat", "latitude", 1.0)], "file string, pos int, header string, canonical string, score double")
    r = schema.validate_values(named, schema.value_stats(rows), rows).first()
    assert not r["ok"] and r["value_confidence"] == pytest.approx(0.3)


def test_headers(spark):
    h = spark.createDataFrame([("f", c) for c in ("Timestamp (ms)", "GPS Latitude", "lon_deg", "relative_alt", "qw", "heading", "vx", "h_acc", "eph")], "file string, header string")
    best = {}
    for r in schema.score_headers(h).collect():
        if r["score"] >= best.get(r["canonical"], (0.5, ""))[0]:
            best[r["canonical"]] = (r["score"], r["header"])
    assert {c: n for c, (s, n) in best.items() if s == 1} == {"timestamp": "Timestamp (ms)", "latitude": "GPS Latitude", "longitude": "lon_deg", "altitude_agl": "relative_alt", "heading": "heading", "velocity_x": "vx", "horizontal_accuracy": "h_acc", "gps_accuracy": "eph"}


def test_unfit_columns_go_to_their_better_name(spark):
    """A name that only shares a word with an altitude is no altitude when its values are none; it stays free for the field it names."""
    row = lambda f, p, h, c, s, ok: (f, p, h, c, s, ok, "x", None, 0.5)
    rows = [row("f", 0, "gps_time", "altitude", 0.6, False), row("f", 0, "gps_time", "timestamp", 1.0, True), row("g", 0, "alt", "altitude", 1.0, False)]
    v = spark.createDataFrame(rows, "file string, pos int, header string, canonical string, score double, ok boolean, unit string, note string, value_confidence double")
    got = {(r["file"], r["canonical"]): r["status"] for r in schema.assign_columns(v).filter("event = 'mapping'").collect()}
    assert got == {("f", "timestamp"): "VALIDATED", ("g", "altitude"): "UNVALIDATED"}


def test_packed_logs_and_many_files_in_one_batch(spark, tmp_path):
    """Logs packed in one table give what the same logs give as files, and a task chooses the columns of many files at once."""
    logs = {f"f{i}": ["time,lat,lon,alt"] + [f"{k},{24 + i / 100 + k / 1000},121.{k},{300 + k}" for k in range(4)] for i in range(30)}
    raw = spark.createDataFrame([(f, k, bytearray(x, "utf-8")) for f, lines in logs.items() for k, x in enumerate(lines)], "file string, line long, raw binary")
    layout, rows = schema.parsed(schema.lines_of(raw.coalesce(1)))
    chosen = schema.choices(layout, rows).filter("event = 'mapping'")
    assert {(r["file"], r["canonical"], r["header"]) for r in chosen.collect()} == {(f, c, h) for f in logs for c, h in (("timestamp", "time"), ("latitude", "lat"), ("longitude", "lon"), ("altitude", "alt"))}
    got = {(r["file"], r["source_row"]): (r["timestamp"], r["latitude"]) for r in schema.typed(rows, chosen).collect()}
    assert got[("f7", 2)] == (2, 24.072) and len(got) == 120


def test_headers_without_a_shared_word_are_not_scored(spark):
    """Only headers that share a word with an alias, hold one or lie in one are compared with the aliases."""
    h = spark.createDataFrame([("a", "zzz"), ("b", "Lat"), ("c", "Lat"), ("a", "mytimestamps"), ("a", "alti"), ("a", "53;120")], "file string, header string")
    scores = {(r["file"], r["header"], r["canonical"]): r["score"] for r in schema.score_headers(h).collect()}
    assert scores[("b", "Lat", "latitude")] == scores[("c", "Lat", "latitude")] == 1.0 and scores[("a", "mytimestamps", "timestamp")] == 0.45 == scores[("a", "alti", "altitude")]
    assert not [k for k in scores if k[1] in ("zzz", "53;120")]
    assert {r["header"] for r in schema.named_headers(h).collect()} == {"Lat"}
