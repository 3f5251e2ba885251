"""Trackers: preprocessing, detection and linking composed over frame tables (t, time, nlat, nlon, vals)."""

from __future__ import annotations

import math
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.geo import stereo_to_latlon
from .operators import healpix as H
from .operators import kernels, spectral
from .operators.exchange import Rules, exchange_link
from .operators.linking import link
from .operators.tracks import splice
from .sources import gridded

#: Wave numbers kept by default, and thresholds by variable.
LMIN, LMAX, THRESHOLD = 5, 42, {"vo": 1e-5}


class Tracker(Protocol):
    def track(self, spark: SparkSession, path: str | DataFrame, var: str, **options) -> DataFrame: ...


def load(spark: SparkSession, path: str | DataFrame, var: str, start=None, end=None, first: int | None = None, engine: str | None = None, index: bool = False) -> DataFrame:
    """Frames of a file or a table, of a closed time range (None: open), or the first ``first``; with ``index``, without
    their values, which are then not read."""
    if not isinstance(path, str):
        frames = path.drop("vals") if index else path
    else:
        reader = gridded.register(spark).read.format("gridded").option("var", var).option("index", str(index).lower())
        frames = (reader.option("engine", engine) if engine else reader).load(path)
    if start is not None:
        frames = frames.where(F.col("time") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        frames = frames.where(F.col("time") <= F.lit(end).cast("timestamp_ntz"))
    return frames if first is None else frames.where(F.col("t") < first)


def axes(path: str | None, shape: tuple[int, int], engine: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Latitudes and longitudes of a file; of a global grid from north to south without one."""
    if path is None:
        return np.linspace(90, -90, shape[0]), np.arange(shape[1]) * 360.0 / shape[1]
    f = gridded.open_file(path, engine)
    return f.read(gridded.coordinate(f, "lat")), f.read(gridded.coordinate(f, "lon"))


def preprocess(frames: DataFrame, shape: tuple[int, int], lmin: int = LMIN, lmax: int = LMAX, taper: int = 0, map_proj: str = "global", resolution: float = 100.0, extent=(-13000.0, 13000.0, -13000.0, 13000.0), filter: bool = True, north_first: bool = True) -> tuple[DataFrame, tuple[int, int]]:
    """Taper, then the band-pass on the grid or its synthesis on another one; frames and their new shape."""
    if taper:
        frames = spectral.taper(frames, shape, taper)
    if map_proj in ("nh_stereo", "sh_stereo"):
        x, y = spectral.stereo_axes(extent, resolution)
        flip = 1 if north_first else -1
        out = spectral.map_frames(frames, lambda f: spectral.to_polar_stereo(f[::flip], map_proj == "sh_stereo", extent, resolution, 0.0, lmin if filter else 0, lmax), shape)
        return out, (len(y), len(x))
    if map_proj == "healpix":
        nside = 2 ** round(math.log2(lmax + 1))
        flip = 1 if north_first else -1
        return spectral.map_frames(frames, lambda f: spectral.to_healpix(spectral.filter_frame(f[::flip], lmin, lmax) if filter else f[::flip], nside, lmax), shape), (1, 12 * nside * nside)
    if map_proj != "global":
        raise ValueError(f"unknown map projection {map_proj}")
    return (spectral.spectral_filter(frames, shape, lmin, lmax, north_first) if filter else frames), shape


def sample_at(centers: DataFrame, frames: DataFrame, shape: tuple[int, int], lat: np.ndarray, lon: np.ndarray, name: str) -> DataFrame:
    """``centers`` with a column for another variable: its value in the cell nearest to each centre, null without one."""

    def pick(c: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        if not len(f) or not len(c):
            return c.assign(**{name: np.nan})
        grid = np.asarray(f["vals"].iloc[0], float).reshape(shape)
        i = np.abs(np.asarray(lat)[None, :] - c["lat"].to_numpy()[:, None]).argmin(1)
        gap = np.abs(np.asarray(lon)[None, :] - c["lon"].to_numpy()[:, None]) % 360
        return c.assign(**{name: grid[i, np.minimum(gap, 360 - gap).argmin(1)]})

    spec = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in centers.schema)
    out = centers.groupBy("t").cogroup(frames.select("t", "vals").groupBy("t")).applyInPandas(pick, f"{spec}, `{name}` double")
    return out.where("lat is not null").withColumn(name, F.nanvl(name, F.lit(None)))


def _points(tracks: DataFrame, frames: DataFrame, also: tuple = ()) -> DataFrame:
    """Track points with microseconds, as track operators and writers take them."""
    when = F.broadcast(frames.select("t", F.unix_micros(F.col("time").cast("timestamp")).alias("us")))  # one row a frame
    return tracks.join(when, "t").select("track_id", "us", F.col("t").alias("pos"), "lat", "lon", "v", *also)


class _Base:
    def _prepare(self, spark, path, var, mode, threshold, filter, lmin, lmax, taper, map_proj, resolution, extent, start, end, first, engine):
        index = load(spark, path, var, start, end, first, engine, index=True)
        head = index.select("nlat", "nlon").first()
        if head is None:
            raise ValueError("no frames")
        frames, shape = load(spark, path, var, start, end, first, engine), (head["nlat"], head["nlon"])
        lat, lon = axes(path if isinstance(path, str) else None, shape, engine)
        ready, new = preprocess(frames, shape, lmin, lmax, taper, map_proj, resolution, extent, filter, bool(lat[0] > lat[-1]))
        if map_proj.endswith("stereo"):
            lon, lat = spectral.stereo_axes(extent, resolution)
        limit = THRESHOLD.get(var, 0.0) if threshold is None else threshold
        return index, ready.select("t", "vals"), new, lat, lon, limit

    @staticmethod
    def _degrees(centers: DataFrame, map_proj: str) -> DataFrame:
        if not map_proj.endswith("stereo"):
            return centers
        lat, lon = stereo_to_latlon("lon", "lat", map_proj == "sh_stereo")
        return centers.withColumn("_lat", lat).withColumn("_lon", lon).drop("lat", "lon").withColumnsRenamed({"_lat": "lat", "_lon": "lon"})


class SimpleTracker(_Base):
    """Local extrema linked by mutual nearest neighbours."""

    def track(self, spark, path, var, mode="min", threshold=None, size=5, filter=True, lmin=LMIN, lmax=LMAX, taper=0, map_proj="global", resolution=100.0, extent=(-13000.0, 13000.0, -13000.0, 13000.0), start=None, end=None, first=None, engine=None, also=(), **_) -> DataFrame:
        """Points (track_id, us, pos, lat, lon, v) and a column for each variable of ``also``, sampled at the centres."""
        frames, ready, shape, lat, lon, limit = self._prepare(spark, path, var, mode, threshold, filter, lmin, lmax, taper, map_proj, resolution, extent, start, end, first, engine)
        if also and (map_proj != "global" or not isinstance(path, str)):
            raise ValueError("other variables are sampled on the grid of a file")
        centers = kernels.detect_frames(ready, shape, lat, lon, size, limit, mode, periodic=not map_proj.endswith("stereo"))
        centers = self._degrees(centers, map_proj)
        for name in also:
            centers = sample_at(centers, load(spark, path, name, start, end, first, engine), shape, lat, lon, name)
        times = {r["time"]: r["t"] for r in frames.select("t", "time").collect()} if start is not None or end is not None else {}  # one row a frame
        # the range that the user gave, in frame numbers
        first_t = min(times.values(), default=None) if start is not None else None
        last_t = max(times.values(), default=None) if end is not None else None
        return _points(link(centers, frames.select("t"), start=first_t, end=last_t), frames, tuple(also))


class ExchangeTracker(_Base):
    """Refined extrema of thresholded objects, linked by smoothness in overlapping chunks."""

    def __init__(self, rules: Rules | None = None, **rule):
        self.rules = rules or Rules(**rule)

    def track(self, spark, path, var, mode="min", threshold=None, size=5, min_points=1, filter=True, lmin=LMIN, lmax=LMAX, taper=0, map_proj="global", resolution=100.0, extent=(-13000.0, 13000.0, -13000.0, 13000.0), start=None, end=None, first=None, engine=None, chunk=None, overlap=3, **_) -> DataFrame:
        frames, ready, shape, lat, lon, limit = self._prepare(spark, path, var, mode, threshold, filter, lmin, lmax, taper, map_proj, resolution, extent, start, end, first, engine)
        if map_proj == "healpix":
            centers = H.healpix_detect(ready, limit, mode, min_points)
        else:
            centers = self._degrees(kernels.object_frames(ready, shape, lat, lon, size, limit, mode, min_points, periodic=not map_proj.endswith("stereo")), map_proj)
        linked = exchange_link(centers.select("t", "c_idx", "lat", "lon", "v"), frames.select("t"), self.rules, chunk, overlap)
        return _points(splice(linked), frames)


class HealpixTracker(ExchangeTracker):
    """The same on HEALPix maps: frames are (time, pixels) already, or are synthesised with map_proj healpix."""

    def track(self, spark, path, var, mode="min", threshold=None, min_points=1, filter=False, **options) -> DataFrame:
        if filter:
            return super().track(spark, path, var, mode, threshold, min_points=min_points, filter=True, **{**options, "map_proj": "healpix"})
        frames = load(spark, path, var, options.get("start"), options.get("end"), options.get("first"), options.get("engine"))
        limit = THRESHOLD.get(var, 0.0) if threshold is None else threshold
        centers = H.healpix_detect(frames.select("t", "vals"), limit, mode, min_points)
        frames = load(spark, path, var, options.get("start"), options.get("end"), options.get("first"), options.get("engine"), index=True)
        linked = exchange_link(centers.select("t", "c_idx", "lat", "lon", "v"), frames.select("t"), self.rules, options.get("chunk"), options.get("overlap", 3))
        return _points(splice(linked), frames)
