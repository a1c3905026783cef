"""Distances, boxes, equal-area projection and polygon area as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------------------
EARTH_RADIUS_KM = 6371.0
EARTH_RADIUS_MEAN_KM = 6371.0088
METRES_PER_DEGREE = 111_320.0
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
ALBERS_PARALLEL_1, ALBERS_PARALLEL_2 = 20.0, -23.0
ALBERS_CENTRE_LAT, ALBERS_CENTRE_LON = 0.0, 25.0
# ----------------------------------------------------------------------------------------


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_RADIUS_KM) -> Column:
    dlat = F.radians(lat2 - lat1)
    dlon = F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * radius * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Point on the unit sphere; distances through the globe have no seam at poles or date line."""
    la, lo = F.radians(lat), F.radians(lon)
    return F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)


def chord_of_km(km: float, radius: float = EARTH_RADIUS_MEAN_KM) -> float:
    """Straight-line distance on the unit sphere that belongs to a surface distance."""
    return 2 * math.sin(km / (2 * radius))


def bounding_box(
    lat: Column, lon: Column, urban: Column, urban_radius_m: float = 2000, rural_radius_m: float = 10000
) -> dict[str, Column]:
    """Square around a point, smaller for urban places."""
    r = F.when(urban, F.lit(float(urban_radius_m))).otherwise(F.lit(float(rural_radius_m)))
    dlat = r / METRES_PER_DEGREE
    dlon = r / (METRES_PER_DEGREE * F.cos(F.radians(lat)))
    return {"lat_min": lat - dlat, "lat_max": lat + dlat, "lon_min": lon - dlon, "lon_max": lon + dlon}


def _albers_constants() -> tuple[float, float, float, float]:
    e2 = WGS84_F * (2 - WGS84_F)
    e = math.sqrt(e2)

    def q(phi: float) -> float:
        s = math.sin(phi)
        return (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    def m(phi: float) -> float:
        return math.cos(phi) / math.sqrt(1 - e2 * math.sin(phi) ** 2)

    p1, p2, p0 = (math.radians(x) for x in (ALBERS_PARALLEL_1, ALBERS_PARALLEL_2, ALBERS_CENTRE_LAT))
    n = (m(p1) ** 2 - m(p2) ** 2) / (q(p2) - q(p1))
    c = m(p1) ** 2 + n * q(p1)
    return e, n, c, WGS84_A * math.sqrt(c - n * q(p0)) / n


def albers_xy(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Africa Albers equal-area coordinates in metres (Snyder 1987, ellipsoidal form)."""
    e, n, c, rho0 = _albers_constants()
    e2 = e * e
    s = F.sin(F.radians(lat))
    q = (1 - e2) * (s / (1 - e2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    rho = WGS84_A * F.sqrt(c - n * q) / n
    theta = n * F.radians(lon - ALBERS_CENTRE_LON)
    return rho * F.sin(theta), F.lit(rho0) - rho * F.cos(theta)


def ring_area(ring: Column) -> Column:
    """Shoelace area of a ring of structs (x, y); the last point joins the first."""
    nxt = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    parts = F.zip_with(ring, nxt, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v)) / 2


def project_ring(ring: Column) -> Column:
    """Ring of structs (x = longitude, y = latitude) in equal-area metres."""

    def one(p: Column) -> Column:
        x, y = albers_xy(p["y"], p["x"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(ring, one)


def tile_centre(
    transform: dict[str, Column], height: Column, width: Column, edges: bool = True
) -> tuple[Column, Column]:
    """Position (lon, lat) of a tile from its affine terms a, b, c, d, e, f, at pixel centres.

    With ``edges`` the longitude is read in the first column of the middle row and the
    latitude in the first row of the middle column, which is how existing tile names were
    made; without it both are read at the middle pixel.
    """
    mid_col = F.floor(width / 2) + 0.5
    mid_row = F.floor(height / 2) + 0.5
    lon_col, lat_row = (F.lit(0.5), F.lit(0.5)) if edges else (mid_col, mid_row)
    lon = transform["a"] * lon_col + transform["b"] * mid_row + transform["c"]
    lat = transform["d"] * mid_col + transform["e"] * lat_row + transform["f"]
    return lon, lat
