"""Delimited telemetry of unknown layout: encoding, delimiter, header, columns, units, and typed rows, for many files at once."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skyfold.functions.parse import parse_dms, parse_iso, parse_number
from skyfold.kernels.ordered import with_adjacent, with_running
from skyfold.kernels.quantile import quantiles
from skyfold.session import once
from skyfold.sources.fields import CHOICE, DELIMITERS, FIELDS, POSE_WORDS, UNITS

# Least name score, least shares of fitting values, ranges, magnitudes and intervals of time columns.
LEAST_SCORE = 0.5
PASS_SHARE = 0.6
ISO_SHARE = 0.8
DECIMAL_COMMA_SHARE = 0.3
FEET = 0.3048
SANE_S = (1e-3, 60.0)
ALTITUDES = (-500.0, 20000.0)
TIME_KINDS = [  # least magnitude, kind, seconds, counted from the epoch
    (1e14, "unix_microseconds", 1e-6, True), (1e14, "relative_microseconds", 1e-6, False),
    (1e11, "unix_milliseconds", 1e-3, True), (1e11, "relative_milliseconds", 1e-3, False),
    (1e9, "unix_seconds", 1.0, True), (1e9, "unix_milliseconds", 1e-3, True),
    (0.0, "relative_seconds", 1.0, False), (0.0, "relative_milliseconds", 1e-3, False), (0.0, "relative_microseconds", 1e-6, False),
]
LINE_BLOCK = 1 << 20


def header_words(h: Column) -> Column:
    """Identity words of a header: lower case, unit words and bracketed hints dropped."""
    t = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.regexp_replace(h, "﻿", ""))), r"\([^()]*\)", " "), "°", " ")
    words = F.filter(F.split(t, "[^a-z0-9]+"), lambda w: w != "")
    core = F.filter(words, lambda w: ~w.isin(UNITS))
    return F.when(F.size(core) > 0, core).otherwise(words)


def alias_words(alias: str) -> list[str]:
    """``header_words`` of a name of the fixed table; these hold ASCII only and no brackets."""
    words = [w for w in re.split("[^a-z0-9]+", alias.strip().lower()) if w]
    return [w for w in words if w not in UNITS] or words


ALIASES = [(canon, alias_words(a)) for canon, names in FIELDS.items() for a in names]


def shares_word(h: Column) -> Column:
    """Whether a header shares a word with any alias, without which it scores below 0.5."""
    letter = h.rlike("[A-Za-z]|[^\\x00-\\x7F]")  # spares most cells the splitting
    return letter & F.arrays_overlap(header_words(h), F.array(*[F.lit(w) for w in sorted({w for _, ws in ALIASES for w in ws})]))


def score_headers(headers: DataFrame) -> DataFrame:
    """Best name score per ``file, header`` and canonical field; the alias table is a fixed constant.

    Each header is scored once, whatever the number of its files, and meets the aliases only if it shares a word with one, holds one
    or lies in one.
    """
    names = ["_".join(ws) for _, ws in ALIASES]
    hn = F.concat_ws("_", header_words(F.col("header")))
    holds = hn.rlike("|".join(sorted({n for n in names if len(n) >= 4})))
    plain = headers.select("header").distinct().filter((hn != "") & (shares_word(F.col("header")) | holds | F.contains(F.lit(" ".join(names)), hn)))
    return headers.select("file", "header").distinct().join(_scores(plain), "header").select("file", "header", "canonical", "score")


def _scores(headers: DataFrame) -> DataFrame:
    alias = headers.sparkSession.range(1).select(F.explode(F.array(*[F.struct(F.lit(c).alias("canonical"), F.array(*[F.lit(w) for w in ws]).alias("aw"), F.lit("_".join(ws)).alias("an")) for c, ws in ALIASES])).alias("a")).select("a.*")
    h = headers.withColumn("hw", header_words(F.col("header"))).withColumn("hn", F.concat_ws("_", "hw"))
    pose = F.arrays_overlap("hw", F.array(*[F.lit(w) for w in POSE_WORDS])) | (F.size(F.array_except("hw", F.array(F.lit("x"), F.lit("y"), F.lit("z")))) == 0)
    j = h.filter(~pose).join(F.broadcast(alias))
    shared = F.size(F.array_intersect("aw", "hw"))
    s = (
        F.when(F.col("hn") == F.col("an"), 1.0)
        .when(F.size(F.array_except("aw", "hw")) == 0, 0.85 + 0.05 * (F.size(F.array_distinct("aw")) - 1))
        .when(shared > 0, 0.6)
        .when((F.length("an") >= 4) & (F.contains("hn", "an") | F.contains("an", "hn")), 0.45)
        .otherwise(0.0)
    )
    has = lambda *w: F.arrays_overlap("hw", F.array(*[F.lit(x) for x in w]))
    agl = has("relative", "rel", "agl")
    c = F.col("canonical")
    off = ((c == "yaw") & has("heading", "course", "compass", "cog") & ~has("yaw")) | ((c == "heading") & has("yaw")) | ((c == "altitude") & agl) | ((c == "altitude_agl") & ~agl)
    best = j.withColumn("score", F.when(off, 0.0).otherwise(s)).groupBy("header", "canonical").agg(F.max("score").alias("score"))
    return best.filter("score > 0")


def named_headers(headers: DataFrame) -> DataFrame:
    """``header, canonical, score`` of all distinct headers whose name may stand for a field."""
    return _scores(headers.filter(shares_word(F.col("header"))).select("header").distinct()).filter(F.col("score") >= LEAST_SCORE)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty lines ``file, line, text, encoding`` of text files, read splittably.

    ``line`` is an order key (block start plus row within the scan task), not a dense number.  A file with any line that is not UTF-8 is
    read as Latin-1, in which every byte stands for a character; a byte order mark is dropped by Spark's reader.
    """
    at = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return lines_of(once(spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), at.alias("line"), F.col("value").cast("binary").alias("raw"))))


def lines_of(raw: DataFrame) -> DataFrame:
    """``read_lines`` for logs that lie packed in a table ``file, line, raw``: many small logs cost no file each."""
    plain = F.is_valid_utf8(F.col("raw").cast("string"))
    kind = raw.groupBy("file").agg(F.bool_and(plain).alias("utf8"))
    text = F.when(F.col("utf8"), F.col("raw").cast("string")).otherwise(F.decode("raw", "ISO-8859-1"))
    text = F.regexp_replace(text, "\r$", "")
    return raw.join(kind, "file").select("file", "line", text.alias("text"), F.when(F.col("utf8"), "utf-8").otherwise("latin-1").alias("encoding")).filter("trim(text) <> ''")


def cells_of(text: Column, delimiter: Column) -> Column:
    """Cells of a line; in a cell that begins with a double quote, delimiters up to the closing one are text."""
    plain = F.concat(F.lit("\\Q"), delimiter, F.lit("\\E"))
    opens = F.regexp_like(text, F.concat(F.lit("(^|"), plain, F.lit(')\\s*"')))
    quoted = F.concat(plain, F.lit('(?=(?:[^"]*"[^"]*")*[^"]*$)'))
    bare = lambda c: F.when(F.startswith(c, F.lit('"')), F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c)
    return F.when(opens, F.transform(F.split(text, quoted), lambda c: bare(F.trim(c)))).otherwise(F.transform(F.split(text, plain), lambda c: F.trim(c)))


def layouts(lines: DataFrame) -> DataFrame:
    """``file, encoding, delimiter, header_line, header, mapped`` of every file.

    A delimiter's score is the share of lines with its most common count times that count, eight at most.  The header is the line of cells
    that names the most fields, at least two, and is at most half numeric; the first of equals.  A delimiter with a header goes before
    one without; a file without any header starts at its first line.  All lines count, whatever the length of the file.
    """
    lines = once(lines)
    split = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(d).alias("d"), cells_of(F.col("text"), F.lit(d)).alias("cells")) for i, d in enumerate(DELIMITERS)])).alias("s")
    every = once(lines.select("file", "line", split).select("file", "line", "s.*").filter(F.size("cells") > 1))
    total = lines.groupBy("file").agg(F.count(F.lit(1)).alias("total"), F.first("encoding").alias("encoding"), F.min(F.struct("line", "text")).alias("top"))
    count = every.groupBy("file", "i", "d", (F.size("cells") - 1).alias("n")).agg(F.count(F.lit(1)).alias("k"))
    mode = count.groupBy("file", "i", "d").agg(F.max(F.struct("k", "n")).alias("m"), F.sum("k").alias("with"))
    mode = mode.join(total.select("file", "total"), "file").filter(F.col("m.k") >= F.col("total") - F.col("with"))
    mode = mode.select("file", "i", "d", (F.col("m.k") / F.col("total") * F.least(F.col("m.n"), F.lit(8))).alias("score"))
    numeric = F.size(F.filter("cells", lambda c: parse_number(c).isNotNull()))
    maybe = once(every.filter(numeric <= F.size("cells") / 2))
    cell = maybe.select("file", "i", "line", F.explode(F.array_distinct("cells")).alias("header"))
    names = named_headers(cell).select("header", "canonical")
    mapped = cell.join(names, "header").groupBy("file", "i", "line").agg(F.count_distinct("canonical").alias("mapped")).filter("mapped >= 2")
    best = mapped.groupBy("file", "i").agg(F.max(F.struct("mapped", (-F.col("line")).alias("l"))).alias("b"))
    pick = mode.join(best, ["file", "i"], "left").groupBy("file").agg(F.max(F.struct(F.col("b").isNotNull().alias("found"), "score", (-F.col("i")).alias("i"), "d", F.col("b.mapped").alias("mapped"), (-F.col("b.l")).alias("line"))).alias("p"))
    j = total.join(pick, "file", "left").select("file", "encoding", F.coalesce("p.d", F.lit(",")).alias("delimiter"), F.coalesce("p.line", "top.line").alias("header_line"), F.coalesce("p.mapped", F.lit(0)).alias("mapped"))
    head = lines.select("file", F.col("line").alias("header_line"), "text")
    return j.join(head, ["file", "header_line"]).select("file", "encoding", "delimiter", "header_line", cells_of(F.col("text"), F.col("delimiter")).alias("header"), "mapped")


def data_rows(lines: DataFrame, layout: DataFrame) -> DataFrame:
    """``file, line, cells, decimal_comma`` of the lines below the header.

    Where another delimiter than the comma is used and three in ten cells look like 24,53, the commas between digits are decimal points.
    """
    rows = lines.join(layout.select("file", "delimiter", "header_line"), "file").filter(F.col("line") > F.col("header_line"))
    rows = once(rows.select("file", "line", "delimiter", cells_of(F.col("text"), F.col("delimiter")).alias("cells")))
    european = F.size(F.filter("cells", lambda c: c.rlike(r"^-?\d+,\d+$")))
    share = rows.groupBy("file").agg(((F.first("delimiter") != ",") & (F.sum(european) >= DECIMAL_COMMA_SHARE * F.sum(F.size("cells")))).alias("decimal_comma"))
    pointed = F.transform("cells", lambda c: F.regexp_replace(c, r"(\d),(\d)", "$1.$2"))
    return rows.join(share, "file").select("file", "line", F.when(F.col("decimal_comma"), pointed).otherwise(F.col("cells")).alias("cells"), "decimal_comma")


def value_stats(rows: DataFrame) -> DataFrame:
    """Counts over all values of each column ``file, pos``: numbers, ISO times, degrees with a hemisphere, values in each range."""
    v = rows.select("file", F.posexplode("cells").alias("pos", "cell")).filter("trim(cell) <> ''").withColumn("n", parse_number(F.col("cell")))
    n = F.col("n")
    return v.groupBy("file", "pos").agg(
        F.count(F.lit(1)).alias("values"), F.count("n").alias("numbers"), F.count(parse_iso(F.col("cell"))).alias("iso"), F.count(parse_dms(F.col("cell"))).alias("dms"),
        F.count_if(n.between(-90, 90)).alias("lat"), F.count_if(n.between(-180, 180)).alias("lon"), F.count_if((n > 180) & (n <= 360)).alias("lon360"), F.count_if(n.between(*ALTITUDES)).alias("alt"),
    )


def time_units(cells: DataFrame) -> DataFrame:
    """``file, kind, factor, epoch, confidence, interval`` of time columns ``file, line, cell, header``.

    The median magnitude leaves a few readings; those whose median interval lies between a millisecond and a minute stay, a hint
    in the name decides between them, else the first.  Without any, the magnitude alone decides.  All values count.
    """
    v = once(cells.withColumn("t", parse_number(F.col("cell"))).filter("t IS NOT NULL").select("file", "line", "header", "t", F.abs("t").alias("mag")))
    span = v.groupBy("file").agg(F.min("t").alias("lo"), F.greatest(F.max("t") - F.min("t"), F.lit(1e-9)).alias("wide"), F.first("header").alias("header"))
    slots = v.join(span.select("file", "lo", "wide"), "file").withColumn("_slot", F.floor((F.col("t") - F.col("lo")) / F.col("wide") * 1000))
    gaps = with_adjacent(slots, ["file"], ["t", "line"], F.col("_slot"), prev={"tp": F.col("t")}).withColumn("gap", F.col("t") - F.col("tp")).filter("gap > 0")
    m = span.select("file", "header").join(quantiles(v, ["file"], mag=("mag", 0.5)), "file").join(quantiles(gaps, ["file"], gap=("gap", 0.5)), "file", "left")
    has = lambda *w: F.lower("header").rlike("|".join(w))
    hints = {"micro": has("_us", "_usec", "micro"), "milli": has("_ms", "milli", "time_boot_ms"), "unix": has("unix", "epoch", "utc", "gps_time", "timestamp"), "relative": has("boot", "elapsed", "flight", "relative", "mission")}
    least = F.when(F.col("mag") >= 1e14, 1e14).when(F.col("mag") >= 1e11, 1e11).when(F.col("mag") >= 1e9, 1e9).otherwise(0.0)
    rows = []
    for k, (low, kind, factor, epoch) in enumerate(TIME_KINDS):
        hint = F.lit(False)
        for word, said in hints.items():
            hint = hint | (said if word in kind else F.lit(False))
        sane = F.coalesce((F.col("gap") * factor).between(*SANE_S), F.lit(False))
        confidence = F.when(sane & hint, 0.9).when(sane, 0.7).otherwise(0.4)
        rows.append(F.when(least == low, F.struct(confidence.alias("confidence"), F.lit(-k).alias("k"), F.lit(kind).alias("kind"), F.lit(factor).alias("factor"), F.lit(epoch).alias("epoch"))))
    best = F.array_max(F.filter(F.array(*rows), lambda r: r.isNotNull()))
    return m.select("file", best.alias("b"), "gap").select("file", "b.kind", "b.factor", "b.epoch", "b.confidence", F.col("gap").alias("interval"))


def named_columns(layout: DataFrame) -> DataFrame:
    """``file, pos, header, canonical, score`` of all columns with a name that may stand for a field."""
    h = layout.select("file", F.posexplode("header").alias("pos", "header"))
    return h.join(named_headers(h), "header").select("file", "pos", "header", "canonical", "score")


def validate_values(named: DataFrame, stats: DataFrame, rows: DataFrame) -> DataFrame:
    """``named`` with ``ok, unit, note, value_confidence``: whether the values of a column fit the field that its name suggests."""
    timed = named.filter("canonical = 'timestamp'").select("file", "pos", F.concat_ws("\u0001", "file", F.col("pos").cast("string")).alias("key"))
    cells = rows.join(timed, "file").select(F.col("key").alias("file"), "line", F.get("cells", F.col("pos")).alias("cell"), F.lit("").alias("header"))
    times = timed.join(time_units(cells).withColumnRenamed("file", "key"), "key").select("file", "pos", "kind", F.col("confidence").alias("time_confidence"))
    j = named.join(stats, ["file", "pos"], "left").join(times, ["file", "pos"], "left")
    share = lambda a, b: F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0))
    numeric = share("numbers", "values")
    field = F.col("canonical")
    verdict = lambda ok, unit, note, conf: F.struct(ok.alias("ok"), unit.alias("unit"), note.alias("note"), conf.alias("value_confidence"))
    no = verdict(F.lit(False), F.lit("unknown"), F.lit(None).cast("string"), F.lit(0.0))
    text = lambda x: F.lit(x).cast("string")
    yes = lambda unit, note, conf: verdict(F.lit(True), text(unit) if isinstance(unit, str) else unit, text(note), conf if isinstance(conf, Column) else F.lit(conf))
    time = F.when(share("iso", "values") >= ISO_SHARE, yes("iso8601", "ISO 8601 to seconds (UTC)", 0.95)).when(numeric < PASS_SHARE, no).otherwise(yes(F.col("kind"), None, F.col("time_confidence")))

    def degrees(inside: str) -> Column:
        s = share(inside, "numbers")
        out = F.when(share("dms", "values") >= PASS_SHARE, yes("DMS", "degrees, minutes, seconds to degrees", 0.9)).when(F.col("numbers") == 0, no).when(s >= PASS_SHARE, yes("degrees", None, 0.6 + 0.35 * s))
        if inside == "lon":
            out = out.when(share("lon360", "numbers") >= PASS_SHARE, yes("degrees_0_360", "0 to 360 to signed degrees", 0.85))
        return out.otherwise(verdict(F.lit(False), F.lit("degrees"), text(None), s))

    high = share("alt", "numbers")
    metres = F.when(numeric < PASS_SHARE, no).otherwise(verdict(high >= PASS_SHARE, F.lit("meters"), text(None), 0.5 + 0.4 * high))
    other = F.when(numeric >= PASS_SHARE, yes("native", None, 0.6 + 0.3 * numeric)).otherwise(verdict(F.lit(False), F.lit("unknown"), text(None), numeric))
    every = F.when(F.coalesce("values", F.lit(0)) == 0, no).when(field == "timestamp", time).when(field == "latitude", degrees("lat")).when(field == "longitude", degrees("lon")).when(field.isin("altitude", "altitude_agl"), metres).otherwise(other)
    return j.withColumn("v", every).select(*named.columns, "v.*")


def _reference(canonical: str, header: str) -> str | None:
    h = header.lower()
    if canonical == "altitude_agl" or canonical == "altitude" and any(w in h for w in ("relative", "rel_", "rel ", "agl", "above_ground")):
        return "AGL"
    if canonical == "altitude":
        return "MSL" if any(w in h for w in ("msl", "gps", "absolute")) else "MSL (assumed)"
    return None


CHOSEN = "file string, event string, canonical string, pos int, header string, unit string, note string, reference string, confidence double, status string, others array<string>"


def assign_columns(validated: DataFrame) -> DataFrame:
    """The column of every field: rows with ``event`` mapping, and rows that say where a choice was not plain.

    In the fixed order of fields, the unused column with the best name goes first; if its values do not fit, the next that fits takes
    its place (event ``rejected``); if none does, it stays UNVALIDATED (event ``kept_unvalidated`` for coordinates), unless its name stands
    better for another field, to which it is left.  Other candidates are listed as ``ranked``.  A file is one row of at most its
    header's width times the number of fields; a task takes many files at once.
    """
    cols = [c.split()[0] for c in CHOSEN.split(", ")]
    given = ["canonical", "pos", "header", "score", "ok", "unit", "note", "value_confidence"]

    def choose(file: str, columns: list[dict]) -> list[dict]:
        used: set[int] = set()
        out = []
        by_field: dict[str, list[dict]] = {}
        named: dict[int, float] = {}
        for r in columns:
            by_field.setdefault(r["canonical"], []).append(r)
            named[r["pos"]] = max(named.get(r["pos"], 0.0), r["score"])
        for field in CHOICE:
            mine = sorted((r for r in by_field.get(field, []) if r["pos"] not in used), key=lambda r: (-r["score"], r["pos"]))
            if not any(r["ok"] for r in mine):
                mine = [r for r in mine if r["score"] >= named[r["pos"]]]
            if not mine:
                continue
            pick = next((r for r in mine if r["ok"]), mine[0])
            base = {"file": file, "canonical": field, "pos": pick["pos"], "header": pick["header"]}
            if not mine[0]["ok"]:
                if pick is not mine[0]:
                    out.append(base | {"event": "rejected", "others": [mine[0]["header"]]})
                elif field in ("latitude", "longitude"):
                    out.append(base | {"event": "kept_unvalidated", "others": []})
            unit, note, conf = pick["unit"], pick["note"], min(0.99, 0.7 * pick["score"] + 0.3 * pick["value_confidence"])
            if field in ("altitude", "altitude_agl"):
                low = pick["header"].strip().lower().split("_")
                unit, note = ("feet", "feet to meters") if {"ft", "feet"} & set(low) else ("meters", None)
            out.append(base | {"event": "mapping", "unit": unit, "note": note, "reference": _reference(field, pick["header"]), "confidence": conf, "status": "VALIDATED" if pick["ok"] else "UNVALIDATED", "others": []})
            used.add(pick["pos"])
            rest = [r["header"] for r in mine if r is not pick]
            if rest:
                out.append(base | {"event": "ranked", "others": rest[:2]})
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [r for f, columns in zip(frame["file"], frame["columns"]) for r in choose(f, list(columns))]
            yield pd.DataFrame({c: pd.Series([r.get(c) for r in out], dtype="int32" if c == "pos" else object) for c in cols})

    per = validated.groupBy("file").agg(F.collect_list(F.struct(*given)).alias("columns"))
    return per.mapInPandas(run, CHOSEN)


def normalise(rows: DataFrame, chosen: DataFrame, times: DataFrame) -> DataFrame:
    """Typed rows ``file, source_row`` and one column per field, in canonical units, from all data rows.

    ``source_row`` counts the data rows of a file from 0; cells that do not fit the unit of their column are null, as is a field without
    a column.  ``times(file, factor)`` turns numeric times into seconds.
    """
    m = chosen.filter("event = 'mapping'")
    per = m.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("canonical", F.struct("pos", "unit").alias("v")))).alias("m"))
    j = with_running(rows.select("file", "line", "cells"), ["file"], ["line"], F.floor(F.col("line") / LINE_BLOCK), rank="_r").join(per, "file", "left").join(times.select("file", "factor"), "file", "left")

    def value(field: str) -> Column:
        at = F.col("m")[field]
        cell, unit = F.get("cells", at["pos"]), at["unit"]
        n = parse_number(cell)
        if field == "timestamp":
            return F.when(unit == "iso8601", parse_iso(cell)).otherwise(n * F.coalesce("factor", F.lit(1.0)))
        if field in ("latitude", "longitude"):
            n = F.when(unit == "DMS", parse_dms(cell)).when((unit == "degrees_0_360") & (n > 180), n - 360).otherwise(n)
        if field in ("altitude", "altitude_agl"):
            n = F.when(unit == "feet", n * FEET).otherwise(n)
        return n

    return j.select("file", (F.col("_r") - 1).alias("source_row"), *[value(f).alias(f) for f in CHOICE])


def read_telemetry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Typed rows of the files under ``path``, their layouts (with ``decimal_comma``), and the choices made for their columns."""
    layout, rows = parsed(read_lines(spark, path))
    chosen = once(choices(layout, rows))
    return typed(rows, chosen), with_comma(layout, rows), chosen


def parsed(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Layouts and data rows of ``lines``."""
    lines = once(lines)
    layout = once(layouts(lines))
    return layout, once(data_rows(lines, layout))


def choices(layout: DataFrame, rows: DataFrame) -> DataFrame:
    return assign_columns(validate_values(named_columns(layout), value_stats(rows), rows))


def with_comma(layout: DataFrame, rows: DataFrame) -> DataFrame:
    comma = rows.groupBy("file").agg(F.first("decimal_comma").alias("decimal_comma"))
    return layout.join(comma, "file", "left")


def typed(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Data rows in canonical fields and units; numeric times by the unit of their column."""
    at = chosen.filter("event = 'mapping' AND canonical = 'timestamp'").select("file", "pos", "header")
    times = time_units(rows.join(at, "file").select("file", "line", F.get("cells", F.col("pos")).alias("cell"), "header"))
    return normalise(rows, chosen, times)
