"""Fields as DataFrames: one row per cell (t, i, j, lat, lon, v) or one per frame (t, nlat, nlon, vals).

Cell rows suit relational stencils; frame rows suit array kernels, for which a frame is one Arrow value. The dense and
sparse fields here are made from the test tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    nlat: int
    nlon: int
    lat0: float
    dlat: float
    lon0: float
    dlon: float

    def lat(self, i: str = "i"):
        return F.lit(self.lat0) + F.col(i) * self.dlat

    def lon(self, j: str = "j"):
        return F.lit(self.lon0) + F.col(j) * self.dlon


DENSE = Grid(8, 8, -70.0, 20.0, 0.0, 45.0)
SPARSE = Grid(10, 15, -67.5, 15.0, 0.0, 24.0)


def dense_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as an 8 x 8 frame."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("t"), F.posexplode("embedding").alias("p", "x"))
    e = e.select("t", F.floor(F.col("p") / 8).cast("int").alias("i"), (F.col("p") % 8).cast("int").alias("j"), F.col("x").cast("double").alias("v"))
    return e.select("t", "i", "j", DENSE.lat().alias("lat"), DENSE.lon().alias("lon"), "v")


def sparse_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest event value by six hours and user cell: a 10 x 15 grid with gaps and ties."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 21_600_000_000).alias("t"), F.floor((F.col("user_id") % 150) / 15).cast("int").alias("i"), (F.col("user_id") % 15).cast("int").alias("j"), "value",
    )
    e = e.groupBy("t", "i", "j").agg(F.max("value").alias("v"))
    return e.select("t", "i", "j", SPARSE.lat().alias("lat"), SPARSE.lon().alias("lon"), "v")


def track_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points of tracks: (track_id, pos, time, lat, lon, v), pos in order of time."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("user_id").alias("track_id"), F.col("event_id").alias("pos"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        (F.col("event_id") * 37 % 1700 / 10.0 - 85).alias("lat"), (F.col("event_id") * 91 % 3600 / 10.0).alias("lon"), F.col("value").alias("v"),
    )


def to_frames(cells: DataFrame, grid: Grid) -> DataFrame:
    """(t, vals): frames in row order, missing cells null."""
    at, size = F.col("i") * grid.nlon + F.col("j"), grid.nlat * grid.nlon
    m = cells.groupBy("t").agg(F.sort_array(F.collect_list(F.struct(at.alias("k"), F.col("v").alias("v")))).alias("m"))
    # sorted cells; between two, as many nulls as are missing
    ends = F.concat(F.transform("m", lambda x: x["k"]), F.array(F.lit(size)))
    gap = lambda n: F.array_repeat(F.lit(None).cast("double"), n)
    parts = F.transform("m", lambda x, k: F.concat(F.array(x["v"]), gap((F.get(ends, k + 1) - x["k"] - 1).cast("int"))))
    return m.select("t", F.concat(gap(F.get(ends, F.lit(0)).cast("int")), F.flatten(parts)).alias("vals"))


def to_cells(frames: DataFrame, grid: Grid, vals: str = "vals") -> DataFrame:
    c = frames.select("t", F.posexplode(vals).alias("p", "v"))
    c = c.select("t", F.floor(F.col("p") / grid.nlon).cast("int").alias("i"), (F.col("p") % grid.nlon).cast("int").alias("j"), "v")
    return c.select("t", "i", "j", grid.lat().alias("lat"), grid.lon().alias("lon"), "v")


def clean(cells: DataFrame) -> DataFrame:
    """NaN and infinite values as missing ones."""
    return cells.withColumn("v", F.when(F.isnan("v") | (F.abs("v") == float("inf")), None).otherwise(F.col("v")))


def time_range(frames: DataFrame, start=None, end=None, column: str = "t") -> DataFrame:
    """Frames of a closed range; a bound that is None is open. The predicate reaches the scan."""
    if start is not None:
        frames = frames.where(F.col(column) >= start)
    return frames if end is None else frames.where(F.col(column) <= end)


def first_steps(frames: DataFrame, n: int, column: str = "t") -> DataFrame:
    """Frames of the first ``n`` distinct times."""
    first = frames.select(column).distinct().orderBy(column).limit(n)
    return frames.join(F.broadcast(first), column, "left_semi")  # n rows


def latitude_descends(cells: DataFrame):
    """One row: whether the first latitude is above the last."""
    return cells.agg((F.min_by("lat", "i") > F.max_by("lat", "i")).alias("descends"))
