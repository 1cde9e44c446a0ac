"""Distances, decay, rings, hexagon ids, and the cubes of the range join: column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean earth radius, equatorial radius and flattening of WGS84.
EARTH_KM, EQUATOR_KM, FLATTENING = 6371.0088, 6378.137, 1 / 298.257223563
#: The smallest radius of curvature: a cube side made with it never loses a pair.
LEAST_RADIUS_KM = 6335.0
#: Mean hexagon edge in km, and mean hexagon area in square km, of resolutions 0 to 15.
EDGE_KM = [1281.256011, 483.0568391, 182.5129565, 68.97922179, 26.07175968, 9.854090990, 3.724532667, 1.406475763, 0.531414010, 0.200786148, 0.075863783, 0.028663897, 0.010830188, 0.004092010, 0.001546100, 0.000584169]
AREA_KM2 = [4357449.416078383, 609788.441794133, 86801.780398997, 12393.434655088, 1770.347654491, 252.903858182, 36.129062164, 5.161293360, 0.737327598, 0.105332513, 0.015047502, 0.002149643, 0.000307092, 0.000043870, 0.000006267, 0.000000895]

#: The longest travel time in seconds that the service answers, by resolution; else the first.
LONGEST_S = {5: 36000, 6: 36000, 7: 36000, 8: 28800, 9: 14400, 10: 5400, 11: 2700, 12: 1800}


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    s = F.pow(F.sin((b - a) / 2), F.lit(2.0)) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2.0))
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(s, F.lit(1.0))))


def lambert_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Lambert's closed formula on the ellipsoid: within about 12 m of the exact geodesic."""
    p = F.atan((1 - FLATTENING) * F.tan(F.radians(lat1)))
    q = F.atan((1 - FLATTENING) * F.tan(F.radians(lat2)))
    s = F.pow(F.sin((q - p) / 2), F.lit(2.0)) + F.cos(p) * F.cos(q) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2.0))
    sigma = 2 * F.asin(F.sqrt(F.least(s, F.lit(1.0))))
    mean, half = (p + q) / 2, (q - p) / 2
    x = (sigma - F.sin(sigma)) * F.pow(F.sin(mean) * F.cos(half), F.lit(2.0)) / F.pow(F.cos(sigma / 2), F.lit(2.0))
    y = (sigma + F.sin(sigma)) * F.pow(F.cos(mean) * F.sin(half), F.lit(2.0)) / F.pow(F.sin(sigma / 2), F.lit(2.0))
    return F.when(sigma == 0, F.lit(0.0)).otherwise(EQUATOR_KM * (sigma - FLATTENING / 2 * (x + y)))


def decay(d: Column, model: str = "step", scale: float = 30.0, shape: float = 2.0, cutoff: float | None = None, reach: float = 50.0) -> Column:
    """Probability of access at distance (or minutes) d; null d is out of reach but for uniform."""
    if model == "uniform":
        return F.lit(1.0)
    if model == "step":
        return F.when(d <= reach, F.lit(1.0)).otherwise(F.lit(0.0))
    x = d / scale
    p = F.exp(-F.pow(x, F.lit(shape))) if model == "weibull" else F.exp(-x)
    return F.when(d <= (10 * scale if cutoff is None else cutoff), p).otherwise(F.lit(0.0))


def travel_cap(resolution: Column, seconds: Column) -> Column:
    """Seconds asked for (null: as long as can be), limited by what the resolution allows."""
    limit = F.coalesce(*[F.when(resolution == r, F.lit(s)) for r, s in LONGEST_S.items()], F.lit(LONGEST_S[5]))
    return F.least(seconds, limit)


def ring(km: Column, resolution: int = 4) -> Column:
    """Ring of hexagons around a facility: half-even rounding, ring 0 is its own."""
    return F.rint(km / (EDGE_KM[resolution] * 3**0.5)).cast("int")


def cell_size(resolution: Column) -> list[Column]:
    """edge_km and area_km2, the means of a resolution; null beyond 0 to 15."""
    return [F.get(F.array(*map(F.lit, x)), resolution).alias(name) for x, name in ((EDGE_KM, "edge_km"), (AREA_KM2, "area_km2"))]


def polygon_km2(boundary: Column) -> Column:
    """Area of a convex cell on the sphere from its corners (array of lat, lon structs, in order):
    the excesses of the triangles that its first corner makes with each side."""
    corners = F.transform(boundary, lambda p: F.array(*unit_vector(p["lat"], p["lon"])))
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]

    def excess(a: Column, b: Column, c: Column) -> Column:
        volume = a[0] * (b[1] * c[2] - b[2] * c[1]) + a[1] * (b[2] * c[0] - b[0] * c[2]) + a[2] * (b[0] * c[1] - b[1] * c[0])
        return 2 * F.atan2(F.abs(volume), 1 + dot(a, b) + dot(b, c) + dot(c, a))

    sides = F.sequence(F.lit(2), F.greatest(F.size(boundary) - 1, F.lit(2)))
    parts = F.transform(sides, lambda i: excess(F.get(corners, F.lit(0)), F.get(corners, i - 1), F.get(corners, i)))
    return F.when(F.size(boundary) > 2, EARTH_KM**2 * F.aggregate(parts, F.lit(0.0), lambda s, e: s + e))


def h3_number(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("decimal(20,0)").cast("long")


def h3_resolution(cell: Column) -> Column:
    return F.shiftright(cell, 52).bitwiseAND(F.lit(15)).cast("int")


def h3_parent(cell: Column, resolution: int) -> Column:
    """Ancestor id at a coarser resolution; null if the cell is coarser than that."""
    base = cell.bitwiseAND(F.lit(~(15 << 52)))
    fill = (1 << (3 * (15 - resolution))) - 1
    parent = base.bitwiseOR(F.lit(resolution << 52)).bitwiseOR(F.lit(fill))
    return F.when(h3_resolution(cell) >= resolution, parent)


def unit_vector(lat: Column, lon: Column) -> list[Column]:
    """x, y, z of a point on the unit sphere."""
    a, b = F.radians(lat), F.radians(lon)
    return [F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)]


def cube(lat: Column, lon: Column, radius_km: float) -> list[Column]:
    """Cube of the unit sphere that a point lies in, for pairs within ``radius_km``."""
    return [F.floor(v / (radius_km / LEAST_RADIUS_KM)) for v in unit_vector(lat, lon)]
