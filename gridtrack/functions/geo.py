"""Geodesy as Column expressions. Angles are degrees unless a name says otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radius of great-circle lengths, and of the haversine used between centres of successive steps.
RADIUS_KM, LINK_RADIUS_KM = 6371.22, 6367.0


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def arc(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle angle in radians, by the clamped arc cosine."""
    a, b = F.radians(col(lat1)), F.radians(col(lat2))
    c = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(col(lon2) - col(lon1)))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def arc_km(lat1, lon1, lat2, lon2) -> Column:
    return arc(lat1, lon1, lat2, lon2) * RADIUS_KM


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    a, b = F.radians(col(lat1)), F.radians(col(lat2))
    s = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(col(lon2) - col(lon1)) / 2), 2)
    return F.asin(F.sqrt(F.least(F.lit(1.0), s))) * (2 * LINK_RADIUS_KM)


def lat_km(lat1, lat2) -> Column:
    """Signed distance along a meridian."""
    return F.radians(col(lat2) - col(lat1)) * LINK_RADIUS_KM


def lon_km(lat1, lon1, lat2, lon2) -> Column:
    """Signed distance along the parallel of the mean latitude."""
    return F.radians(col(lon2) - col(lon1)) * F.cos(F.radians((col(lat1) + col(lat2)) / 2)) * LINK_RADIUS_KM


def lon360(lon) -> Column:
    return F.pmod(col(lon), F.lit(360.0))


def lon180(lon) -> Column:
    """Longitudes over 180 as negative ones; others as they are."""
    return F.when(col(lon) > 180, col(lon) - 360).otherwise(col(lon))


def lon_gap(lon1, lon2) -> Column:
    """Unsigned difference of longitudes, across the date line where that is shorter."""
    d = F.pmod(F.abs(col(lon1) - col(lon2)), F.lit(360.0))
    return F.least(d, 360 - d)


def stereo_to_latlon(x, y, south: bool = False, lon0: float = 0.0) -> tuple[Column, Column]:
    """Polar stereographic km to (lat, lon in 0..360); the pole itself has longitude ``lon0``... of the plane: 0."""
    x, y = col(x), col(y)
    rho = F.sqrt(x * x + y * y)
    theta = F.degrees(F.atan(rho / (2 * RADIUS_KM)) * 2)
    lat = theta - 90 if south else 90 - theta
    lon = F.pmod(F.degrees(F.atan2(x, y if south else -y)) + lon0, F.lit(360.0))
    return lat, F.when(rho == 0, F.lit(0.0)).otherwise(lon)


def latlon_to_stereo(lat, lon, south: bool = False, lon0: float = 0.0) -> tuple[Column, Column]:
    theta = F.radians(90 + col(lat) if south else 90 - col(lat))
    rho, phi = F.tan(theta / 2) * (2 * RADIUS_KM), F.radians(col(lon) - lon0)
    return rho * F.sin(phi), rho * F.cos(phi) * (1 if south else -1)


def cosine_weight(index, size: int, points: int) -> Column:
    """Taper weight of an index: 0 at the edge, rising over ``points`` cells, 1 inside; both edges alike."""
    n = min(points, size // 2)
    edge = F.least(col(index), F.lit(size - 1) - col(index))
    if n < 1:
        return F.lit(1.0)
    return F.when(edge < n, (1 - F.cos(edge * (math.pi / n))) * 0.5).otherwise(F.lit(1.0))


def adaptive_limit(distance, table: list[list[float]], default: float) -> Column:
    """Piecewise linear in the distance between the table's knots, flat outside; ``default`` without four of them."""
    if len(table) != 2 or min(map(len, table)) < 4:
        return F.lit(float(default))
    xs, ys = table
    d = col(distance)
    out = F.when(d <= xs[0], F.lit(float(ys[0])))
    for k in range(len(xs) - 1):
        slope = (ys[k + 1] - ys[k]) / (xs[k + 1] - xs[k]) if xs[k + 1] != xs[k] else 0.0
        out = out.when(d <= xs[k + 1], F.lit(float(ys[k])) + (d - xs[k]) * slope)
    return out.otherwise(F.lit(float(ys[-1])))


def zone_limit(lat, lon, zones: list[list[float]], default: float) -> Column:
    """The last of the first zone (lon_min, lon_max, lat_min, lat_max, limit) that holds a point; a zone may cross 0 degrees."""
    lat, lon, out = col(lat), col(lon), None
    for lo, hi, south, north, limit in zones:
        inside = lon.between(lo, hi) if lo <= hi else (lon >= lo) | (lon <= hi)
        hit = inside & lat.between(south, north)
        out = F.when(hit, F.lit(limit)) if out is None else out.when(hit, F.lit(limit))
    return F.lit(float(default)) if out is None else out.otherwise(F.lit(float(default)))


def smoothness_cost(p0: tuple, p1: tuple, p2: tuple, w1: float = 0.2, w2: float = 0.8) -> Column:
    """Change of direction and of speed along three points (lat, lon), 0 for steady motion.

    Directions are the tangents of both arcs at the middle point. Two still steps cost 0, one still step costs w2.
    """

    def unit(p):
        a, b = F.radians(col(p[0])), F.radians(col(p[1]))
        return F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)

    u, v, w = unit(p0), unit(p1), unit(p2)
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    uv, vw, uw = dot(u, v), dot(v, w), dot(u, w)
    one = lambda c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))
    a1, a2 = F.acos(one(uv)), F.acos(one(vw))
    # tangents v * uv - u and w - v * vw, both orthogonal to v
    n1, n2 = F.sqrt(F.greatest(1 - uv * uv, F.lit(0.0))), F.sqrt(F.greatest(1 - vw * vw, F.lit(0.0)))
    turn = one((uv * vw - uw) / (n1 * n2))
    moving = F.greatest((1 - turn) * (0.5 * w1) + (1 - 2 * F.sqrt(a1 * a2) / (a1 + a2)) * w2, F.lit(0.0))
    still1, still2 = a1 < 1e-12, a2 < 1e-12
    return F.when(still1 & still2, F.lit(0.0)).when(still1 | still2, F.lit(float(w2))).otherwise(moving)
