"""Geodesy as functions of Spark SQL: expressions, not Python, once they are called."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .geo import RADIUS_KM

_FUNCTIONS = {
    "geod_dist": ("a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE", "acos(greatest(-1D, least(1D, sin(radians(a)) * sin(radians(c)) + cos(radians(a)) * cos(radians(c)) * cos(radians(d - b)))))"),
    "geod_dist_km": ("a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE", f"{RADIUS_KM}D * geod_dist(a, b, c, d)"),
    "lon360": ("lon DOUBLE", "pmod(lon, 360D)"),
    "lon_gap": ("x DOUBLE, y DOUBLE", "least(pmod(x - y, 360D), pmod(y - x, 360D))"),
}


def register_functions(spark: SparkSession) -> SparkSession:
    """geod_dist (lat, lon, lat, lon; radians), geod_dist_km, lon360 and lon_gap as temporary functions of a session."""
    for name, (arguments, body) in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS DOUBLE RETURN {body}")
    return spark
