"""Strict text casts as column expressions; a cell that does not fit gives null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Accepted shapes.
SEPARATORS = "°d:'m\"″"
ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"
ISO6709 = r"^([+-]\d+(?:\.\d+)?)([+-]\d+(?:\.\d+)?)([+-]\d+(?:\.\d+)?)?/?"


def parse_number(c: Column) -> Column:
    """A finite decimal number; words that a cast would take (nan, infinity, 1f) are none."""
    t = F.trim(c)
    v = F.when(~F.lower(t).rlike("[a-df-z]"), t.try_cast("double"))
    return F.when(F.abs(v) < F.lit(float("inf")), v)


def parse_dms(c: Column) -> Column:
    """Signed degrees of up to three numbers (degrees, minutes, seconds) with one hemisphere letter before or after them.

    Degrees are whole, of at most three digits; minutes and seconds have at most two digits before the point.  Between the numbers
    stand only marks and blanks; a plus or minus may stand in front of all, where no letter does, and the letter alone gives the sign.
    """
    t = F.upper(F.trim(c))
    ahead, behind = F.substring(t, 1, 1).isin("N", "S", "E", "W"), F.right(t, F.lit(1)).isin("N", "S", "E", "W")
    hemi = F.when(behind, F.right(t, F.lit(1))).when(ahead, F.substring(t, 1, 1))
    body = F.substring(t, F.when(ahead, 2).otherwise(1), F.length(t) - ahead.cast("int") - behind.cast("int"))
    body = F.when(ahead, body).otherwise(F.regexp_replace(body, "^[-+]", ""))
    parts = F.regexp_extract_all(body, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    marks = F.translate(F.regexp_replace(body, r"[0-9]+(?:\.[0-9]+)?", ""), SEPARATORS.upper(), "")
    whole = lambda i: F.length(F.substring_index(F.get(parts, F.lit(i)), ".", 1))
    fits = (F.trim(marks) == "") & F.size(parts).between(1, 3) & ~F.get(parts, F.lit(0)).contains(".") & (whole(0) <= 3)
    fits = fits & F.coalesce(whole(1) <= 2, F.lit(True)) & F.coalesce(whole(2) <= 2, F.lit(True)) & body.rlike(r"^\s*[0-9]")
    num = lambda i: F.coalesce(F.get(parts, F.lit(i)).try_cast("double"), F.lit(0.0))
    v = num(0) + num(1) / 60.0 + num(2) / 3600.0
    return F.when(fits & hemi.isNotNull(), F.when(hemi.isin("S", "W"), -v).otherwise(v))


def parse_iso(c: Column) -> Column:
    """ISO date-time to epoch seconds; a time without zone counts as UTC."""
    t = F.trim(c)
    zoned = t.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    stamp = F.try_to_timestamp(F.when(zoned, t).otherwise(F.concat(t, F.lit("Z"))))
    return F.when(t.rlike(ISO), F.unix_micros(stamp) / 1e6)


def parse_iso6709(c: Column) -> list[Column]:
    """Latitude, longitude and altitude of a location string, null when out of range."""
    lat, lon, alt = (F.regexp_extract(c, ISO6709, i).try_cast("double") for i in (1, 2, 3))
    ok = (F.abs(lat) <= 90) & (F.abs(lon) <= 180)
    return [F.when(ok, v) for v in (lat, lon, alt)]
