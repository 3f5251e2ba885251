"""Gridded files as DataFrames: a Python data source over NetCDF, GRIB and Zarr v2, a partition for each run of frames.

``spark.read.format("gridded").option("var", "msl").load(path)`` gives (t, time, nlat, nlon, vals), a frame a row, sent
as Arrow. Conditions on ``t`` and ``time`` choose the frames that are read. NetCDF-3 and Zarr with zlib or zstd chunks
need nothing else; NetCDF-4 (h5py), GRIB (cfgrib), other chunk codecs (numcodecs) and remote paths (fsspec) need a
library that may be absent; asking for them then is a ValueError that names it.
"""

from __future__ import annotations

import importlib
import importlib.util
import json
import os
import struct
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

# Names that variables and coordinates go by.
VARIABLES = {"msl": ("msl", "slp"), "slp": ("msl", "slp"), "vo": ("vo",)}
COORDINATES = {"lat": ("latitude", "lat", "y"), "lon": ("longitude", "lon", "x"), "time": ("time", "valid_time")}
FRAMES = 16


def _library(name: str, what: str):
    try:
        return importlib.import_module(name)
    except ImportError:
        raise ValueError(f"reading {what} needs the library {name}, which is not installed") from None


def _remote(path: str) -> bool:
    return "://" in path and not path.startswith("file://")


def _open(path: str):
    if not _remote(path):
        return open(path.removeprefix("file://"), "rb")
    return _library("fsspec", path).open(path, "rb", **({"anon": True} if path.startswith(("s3://", "gs://")) else {}))


def _bytes(path: str) -> bytes | None:
    """What a file holds; None if there is no such file."""
    try:
        with _open(path) as f:
            return f.read()
    except FileNotFoundError:
        return None


def engine_of(path: str, engine: str | None = None) -> str:
    """netcdf, zarr, netcdf4 or grib, from the file's own first bytes or its name."""
    if engine:
        return engine
    if path.endswith(".zarr") or (not _remote(path) and os.path.exists(os.path.join(path, ".zmetadata"))):
        return "zarr"
    if path.endswith((".grib", ".grib2", ".grb")):
        return "grib"
    if _remote(path) or os.path.isfile(path):
        with _open(path) as f:
            if f.read(4) == b"\x89HDF":
                return "netcdf4"
    return "netcdf"


def open_file(path: str, engine: str | None = None):
    kind = engine_of(path, engine)
    if kind == "zarr":
        return Zarr(path)
    if kind == "netcdf":
        return NetCDF3(path)
    if kind in ("netcdf4", "h5netcdf"):
        return NetCDF4(path)
    if kind in ("grib", "cfgrib"):
        return Grib(path)
    raise ValueError(f"unknown engine {kind}")


class NetCDF4:
    """Variables of a NetCDF-4 file, which is HDF5; only the frames asked for are read."""

    def __init__(self, path: str):
        self.file = _library("h5py", path).File(_open(path) if _remote(path) else path, "r")
        text = lambda x: x.decode() if isinstance(x, bytes) else x
        self.variables = {k: {"dims": [], "shape": list(d.shape), "attrs": {n: text(x) for n, x in d.attrs.items()}, "type": d.dtype} for k, d in self.file.items() if hasattr(d, "shape")}

    def read(self, key: str, lo: int = 0, hi: int | None = None) -> np.ndarray:
        v = self.variables[key]
        return _unpack(np.asarray(self.file[key][lo:hi] if v["shape"] else self.file[key][()]), v["attrs"])


class Grib:
    """Variables of a GRIB file as cfgrib indexes them."""

    def __init__(self, path: str):
        if _remote(path):
            raise ValueError(f"{path}: GRIB files are read from local paths only")
        self.found = _library("cfgrib", path).open_file(path).variables
        self.variables = {k: {"dims": list(v.dimensions), "shape": list(np.shape(v.data)), "attrs": dict(v.attributes), "type": np.dtype(float)} for k, v in self.found.items()}

    def read(self, key: str, lo: int = 0, hi: int | None = None) -> np.ndarray:
        v = self.variables[key]
        return _unpack(np.atleast_1d(np.asarray(self.found[key].data[lo:hi] if v["shape"] else self.found[key].data)), v["attrs"])


class NetCDF3:
    """Reader of the classic formats (CDF-1, 2 and 5); values are read by record, not as a whole."""

    TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}

    def __init__(self, path: str):
        self.path = path
        with open(path, "rb") as f:
            magic = f.read(4)
            if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
                raise ValueError(f"{path} is no classic NetCDF file")
            version = magic[3]
            n_fmt, off_fmt = (">q" if version == 5 else ">i"), (">i" if version == 1 else ">q")

            def number(fmt: str = n_fmt) -> int:
                return struct.unpack(fmt, f.read(struct.calcsize(fmt)))[0]

            def name() -> str:
                n = number()
                s = f.read(n).decode()
                f.read(-n % 4)
                return s

            def attributes() -> dict:
                number(">i")
                out = {}
                for _ in range(number()):
                    key, kind, n = name(), number(">i"), number()
                    t = np.dtype(self.TYPES[kind])
                    raw = f.read(n * t.itemsize)
                    f.read(-(n * t.itemsize) % 4)
                    out[key] = raw.decode(errors="replace") if kind == 2 else np.frombuffer(raw, t)
                return out

            self.records = number()
            number(">i")
            dims = [(name(), number()) for _ in range(number())]
            self.attributes = attributes()
            number(">i")
            self.variables = {}
            for _ in range(number()):
                key = name()
                ids = [number() for _ in range(number())]
                attrs, kind, size, begin = attributes(), number(">i"), number(), number(off_fmt)
                self.variables[key] = {"dims": [dims[i][0] for i in ids], "shape": [dims[i][1] for i in ids], "attrs": attrs, "type": np.dtype(self.TYPES[kind]), "size": size, "begin": begin, "record": bool(ids) and dims[ids[0]][1] == 0}
        rec = [v for v in self.variables.values() if v["record"]]
        self.stride = sum(v["size"] for v in rec) if len(rec) != 1 else int(np.prod(rec[0]["shape"][1:], dtype=int)) * rec[0]["type"].itemsize
        for v in rec:
            v["shape"][0] = self.records

    def read(self, key: str, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Values of a variable, of its first dimension lo..hi - 1, packed ones unpacked, missing ones NaN."""
        v = self.variables[key]
        shape = v["shape"]
        hi = (shape[0] if shape else 1) if hi is None else hi
        inner = int(np.prod(shape[1:], dtype=int))
        with open(self.path, "rb") as f:
            if v["record"]:
                parts = []
                for k in range(lo, hi):
                    f.seek(v["begin"] + k * self.stride)
                    parts.append(np.frombuffer(f.read(inner * v["type"].itemsize), v["type"]))
                raw = np.concatenate(parts) if parts else np.zeros(0, v["type"])
            else:
                f.seek(v["begin"] + lo * inner * v["type"].itemsize)
                raw = np.frombuffer(f.read((hi - lo) * inner * v["type"].itemsize), v["type"])
        return _unpack(raw, v["attrs"]).reshape([hi - lo, *shape[1:]] if shape else [])


class Zarr:
    """Reader of Zarr v2 folders, by their consolidated metadata where there is some: a remote one needs it."""

    def __init__(self, path: str):
        self.path, self.variables = path.rstrip("/"), {}
        whole = _bytes(f"{self.path}/.zmetadata")
        if whole is not None:
            found = {k: v for k, v in json.loads(whole)["metadata"].items()}
            names = sorted(k.removesuffix("/.zarray") for k in found if k.endswith("/.zarray"))
        else:
            local = self.path.removeprefix("file://")
            names = [k for k in sorted(os.listdir(local)) if os.path.exists(os.path.join(local, k, ".zarray"))]
            found = {f"{k}/{n}": json.loads(_bytes(f"{self.path}/{k}/{n}") or b"{}") for k in names for n in (".zarray", ".zattrs")}
        for key in names:
            m, attrs = found[f"{key}/.zarray"], found.get(f"{key}/.zattrs", {})
            if m.get("filters"):
                raise ValueError(f"reading {path} needs the library zarr: chunks of {key} are filtered by {m['filters']}")
            self.variables[key] = {"dims": attrs.get("_ARRAY_DIMENSIONS", []), "shape": m["shape"], "attrs": attrs, "type": np.dtype(m["dtype"]), "meta": m}

    def _decode(self, raw: bytes, codec: dict | None) -> bytes:
        if not codec:
            return raw
        if codec["id"] in ("zlib", "gzip"):
            return zlib.decompress(raw, 47)
        if codec["id"] == "zstd" and importlib.util.find_spec("zstandard"):
            return importlib.import_module("zstandard").ZstdDecompressor().decompressobj().decompress(raw)
        return bytes(_library("numcodecs", f"{self.path}, whose chunks are {codec['id']},").get_codec(codec).decode(raw))

    def read(self, key: str, lo: int = 0, hi: int | None = None) -> np.ndarray:
        v = self.variables[key]
        m, shape = v["meta"], v["shape"]
        hi = shape[0] if hi is None else hi
        out = np.full([hi - lo, *shape[1:]], m.get("fill_value") or 0, v["type"])
        chunk = m["chunks"]
        grid = [range(lo // chunk[0], -(-hi // chunk[0])), *(range(-(-s // c)) for s, c in zip(shape[1:], chunk[1:], strict=True))]
        for at in np.ndindex(*map(len, grid)):
            ids = [g[a] for g, a in zip(grid, at, strict=True)]
            raw = _bytes(f"{self.path}/{key}/{m.get('dimension_separator', '.').join(map(str, ids))}")
            if raw is None:  # a chunk of nothing but the fill value
                continue
            block = np.frombuffer(self._decode(raw, m.get("compressor")), v["type"]).reshape(chunk, order=m.get("order", "C"))
            begin = [i * c for i, c in zip(ids, chunk, strict=True)]
            src, dst = [], []
            for k, (b, c) in enumerate(zip(begin, chunk, strict=True)):
                first, last = (lo, hi) if k == 0 else (0, shape[k])
                a, z = max(b, first), min(b + c, last)
                src.append(slice(a - b, z - b))
                dst.append(slice(a - first, z - first))
            out[tuple(dst)] = block[tuple(src)]
        return _unpack(out, v["attrs"])


def _unpack(raw: np.ndarray, attrs: dict) -> np.ndarray:
    if raw.dtype.kind == "S":
        return raw
    one = lambda k: np.asarray(attrs[k]).ravel()[0] if k in attrs else None
    missing = [x for x in (one("_FillValue"), one("missing_value")) if x is not None]
    out = raw.astype(float)
    for x in missing:
        out[raw == x] = np.nan
    scale, shift = one("scale_factor"), one("add_offset")
    return out * (1.0 if scale is None else scale) + (0.0 if shift is None else shift)


def coordinate(f, kind: str) -> str:
    """The first known name of a coordinate that the file has; the usual name if it has none."""
    return next((n for n in COORDINATES[kind] if n in f.variables), COORDINATES[kind][0])


def variable(f, name: str) -> str:
    for n in (*VARIABLES.get(name, ()), name):
        if n in f.variables:
            return n
    raise KeyError(f"{name} is not in the file, which has {sorted(f.variables)}")


def times(f) -> list[datetime]:
    """Times by the variable's units, like ``hours since 1900-01-01``."""
    key = coordinate(f, "time")
    units = f.variables[key]["attrs"].get("units", "seconds since 1970-01-01")
    unit, _, origin = units.partition(" since ")
    seconds = {"s": 1, "m": 60, "h": 3600, "d": 86_400}[unit.strip()[0].lower()]
    start = datetime.fromisoformat(origin.strip().replace(" UTC", "").rstrip("Z").replace(".0", ""))
    return [start + timedelta(seconds=float(x) * seconds) for x in f.read(key)]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.var, self.engine = options["path"], options.get("var"), options.get("engine")
        self.frames, self.parts, self.pushed = int(options.get("frames", FRAMES)), int(options.get("parts", 0)), []
        self.index = options.get("index", "false").lower() == "true"
        if not self.var:
            raise ValueError("option var is needed")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of t and time choose the frames to read; Spark applies all conditions again."""
        self.pushed = [(f.attribute[0], type(f), f.value) for f in filters if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute in (("t",), ("time",))]
        yield from filters

    def _wanted(self, f, n: int) -> list[int]:
        holds = {EqualTo: lambda x, y: x == y, GreaterThan: lambda x, y: x > y, GreaterThanOrEqual: lambda x, y: x >= y, LessThan: lambda x, y: x < y, LessThanOrEqual: lambda x, y: x <= y}
        if not self.pushed:
            return list(range(n))
        when = times(f) if any(c == "time" for c, _, _ in self.pushed) else [None] * n
        return [k for k in range(n) if all(holds[op](k if c == "t" else when[k], value) for c, op, value in self.pushed)]

    def partitions(self) -> list[InputPartition]:
        """Runs of ``frames`` frames, or with option ``parts`` that many runs of nearly one length."""
        f = open_file(self.path, self.engine)
        own = self._wanted(f, f.variables[variable(f, self.var)]["shape"][0])
        if not own:
            return [InputPartition((0, 0))]
        lo, hi = own[0], own[-1] + 1
        if self.index:
            cuts = [lo, hi]
        elif self.parts:
            cuts = [lo + (hi - lo) * k // self.parts for k in range(self.parts + 1)]
        else:
            cuts = [*range(lo, hi, self.frames), hi]
        return [InputPartition((a, b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        lo, hi = partition.value
        if lo == hi:
            return
        f = open_file(self.path, self.engine)
        when, key = times(f), variable(f, self.var)
        if self.index:  # no values: which frames there are
            shape, n = [1, *f.variables[key]["shape"][1:]][-2:], hi - lo
            yield pa.RecordBatch.from_arrays([pa.array(range(lo, hi), pa.int32()), pa.array(when[lo:hi], pa.timestamp("us")), *(pa.array([x] * n, pa.int32()) for x in shape), pa.array([[]] * n, pa.list_(pa.float64()))], names=["t", "time", "nlat", "nlon", "vals"])
            return
        for k in range(lo, hi):  # a frame a batch: what a task holds is one
            frame = f.read(key, k, k + 1)[0]
            plane = frame.reshape(frame.shape[-2:]) if frame.ndim > 1 else frame.reshape(1, -1)  # single levels go
            vals = pa.ListArray.from_arrays(pa.array([0, plane.size], pa.int32()), pa.array(plane.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([when[k]], pa.timestamp("us")), *(pa.array([x], pa.int32()) for x in plane.shape), vals], names=["t", "time", "nlat", "nlon", "vals"])


class Gridded(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gridded"

    def schema(self) -> str:
        return "t int, time timestamp_ntz, nlat int, nlon int, vals array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    """Make the format known to a session, and let conditions reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Gridded)
    return spark


def write_netcdf3(path: str, lat: np.ndarray, lon: np.ndarray, hours: np.ndarray, name: str, data: np.ndarray) -> None:
    """A classic NetCDF file of one variable (time, latitude, longitude), times in hours since 1970."""
    def text(s: str) -> bytes:
        b = s.encode()
        return struct.pack(">i", len(b)) + b + b"\0" * (-len(b) % 4)

    dims = [("time", len(hours)), ("latitude", len(lat)), ("longitude", len(lon))]
    units = struct.pack(">ii", 12, 1) + text("units") + struct.pack(">i", 2) + text("hours since 1970-01-01")
    none = struct.pack(">ii", 0, 0)
    arrays = [("time", [0], units, hours), ("latitude", [1], none, lat), ("longitude", [2], none, lon), (name, [0, 1, 2], none, data)]
    head = b"CDF\x01" + struct.pack(">i", 0) + struct.pack(">ii", 10, 3) + b"".join(text(n) + struct.pack(">i", s) for n, s in dims) + none

    def table(begins: list[int]) -> bytes:
        out = struct.pack(">ii", 11, len(arrays))
        for (n, ids, attrs, a), begin in zip(arrays, begins, strict=True):
            out += text(n) + struct.pack(f">i{len(ids)}i", len(ids), *ids) + attrs + struct.pack(">iii", 6, a.size * 8, begin)
        return out

    at, begins = len(head) + len(table([0] * len(arrays))), []
    for *_, a in arrays:
        begins.append(at)
        at += a.size * 8
    with open(path, "wb") as f:
        f.write(head + table(begins) + b"".join(np.ascontiguousarray(a, ">f8").tobytes() for *_, a in arrays))


def read_zones(path: str) -> list[list[float]]:
    """Search zones of a text file; a first line of one number is a count."""
    with open(path) as f:
        rows = [list(map(float, x.split())) for x in f if x.strip()]
    return [r for r in rows if len(r) != 1]


def read_adapt(path: str) -> list[list[float]]:
    """Adaptive knots as two rows; a file of four rows of two is turned."""
    with open(path) as f:
        rows = [list(map(float, x.split())) for x in f if x.strip()]
    return [list(x) for x in zip(*rows, strict=True)] if len(rows) == 4 and len(rows[0]) == 2 else rows
