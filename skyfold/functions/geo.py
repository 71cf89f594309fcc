"""Geodesy as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# WGS84 ellipsoid and the two mean earth radii in use.
WGS84_A = 6378137.0
WGS84_F = 1.0 / 298.257223563
WGS84_E2 = WGS84_F * (2.0 - WGS84_F)
EARTH_R = 6371008.8
EARTH_R_PAIRS = 6371000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_R) -> Column:
    """Great-circle metres; null if a coordinate is."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


def ecef(lat: Column, lon: Column, alt: Column) -> list[Column]:
    la, lo = F.radians(lat), F.radians(lon)
    n = F.lit(WGS84_A) / F.sqrt(1 - F.lit(WGS84_E2) * F.sin(la) * F.sin(la))
    return [
        (n + alt) * F.cos(la) * F.cos(lo),
        (n + alt) * F.cos(la) * F.sin(lo),
        (n * (1 - WGS84_E2) + alt) * F.sin(la),
    ]


def enu(lat: Column, lon: Column, alt: Column, lat0: Column, lon0: Column, alt0: Column) -> list[Column]:
    """East, north, up of a fix around an anchor."""
    d = [a - b for a, b in zip(ecef(lat, lon, alt), ecef(lat0, lon0, alt0))]
    la, lo = F.radians(lat0), F.radians(lon0)
    return [
        -F.sin(lo) * d[0] + F.cos(lo) * d[1],
        -F.sin(la) * F.cos(lo) * d[0] - F.sin(la) * F.sin(lo) * d[1] + F.cos(la) * d[2],
        F.cos(la) * F.cos(lo) * d[0] + F.cos(la) * F.sin(lo) * d[1] + F.sin(la) * d[2],
    ]


def geodetic(x: Column, y: Column, z: Column) -> list[Column]:
    """Latitude, longitude, altitude of an earth-centred position (Bowring start, two refinements)."""
    b = WGS84_A * (1 - WGS84_F)
    ep2 = WGS84_E2 / (1 - WGS84_E2)
    p = F.hypot(x, y)
    th = F.atan2(z * WGS84_A, p * b)
    lat = F.atan2(z + F.lit(ep2 * b) * F.pow(F.sin(th), 3), p - F.lit(WGS84_E2 * WGS84_A) * F.pow(F.cos(th), 3))
    for _ in range(2):
        n = F.lit(WGS84_A) / F.sqrt(1 - F.lit(WGS84_E2) * F.pow(F.sin(lat), 2))
        h = p / F.cos(lat) - n
        lat = F.atan2(z, p * (1 - F.lit(WGS84_E2) * n / (n + h)))
    n = F.lit(WGS84_A) / F.sqrt(1 - F.lit(WGS84_E2) * F.pow(F.sin(lat), 2))
    return [F.degrees(lat), F.degrees(F.atan2(y, x)), p / F.cos(lat) - n]


def enu_to_geodetic(e: Column, n: Column, u: Column, lat0: Column, lon0: Column, alt0: Column) -> list[Column]:
    la, lo = F.radians(lat0), F.radians(lon0)
    x0 = ecef(lat0, lon0, alt0)
    x = x0[0] - F.sin(lo) * e - F.sin(la) * F.cos(lo) * n + F.cos(la) * F.cos(lo) * u
    y = x0[1] + F.cos(lo) * e - F.sin(la) * F.sin(lo) * n + F.cos(la) * F.sin(lo) * u
    z = x0[2] + F.cos(la) * n + F.sin(la) * u
    return geodetic(x, y, z)


def utm_epsg(mean_lat: Column, mean_lon: Column) -> Column:
    zone = (F.floor((mean_lon + 180) / 6) % 60 + 1).cast("long")
    return F.when(mean_lat >= 0, 32600 + zone).otherwise(32700 + zone)
