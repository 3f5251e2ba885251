"""Command lines: ``python -m gridtrack.cli track ...`` and ``python -m gridtrack.cli convert ...``."""

from __future__ import annotations

import argparse
import json
import warnings

from pyspark.sql import functions as F

from .api import LMAX, LMIN, ExchangeTracker, HealpixTracker, SimpleTracker
from .operators.exchange import ADAPT, ZONES, Rules
from .session import session
from .sources import formats, gridded


def wave_range(text: str) -> tuple[int, int]:
    """``a-b`` or ``b``; anything else warns and gives the default."""
    try:
        low, _, high = text.rpartition("-")
        return int(low or 0), int(high)
    except ValueError:
        warnings.warn(f"bad filter range {text}, using {LMIN}-{LMAX}", stacklevel=2)
        return LMIN, LMAX


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gridtrack")
    sub = p.add_subparsers(dest="command", required=True)
    t = sub.add_parser("track", help="detect and link features of a gridded file")
    t.add_argument("-i", "--input", required=True)
    t.add_argument("-v", "--var", required=True)
    t.add_argument("-o", "--output", required=True)
    t.add_argument("-a", "--algorithm", choices=("simple", "hodges", "healpix"), default="simple")
    t.add_argument("-f", "--format", choices=("imilast", "hodges", "json", "html"), default="imilast")
    t.add_argument("-m", "--mode", choices=("min", "max"), default="min")
    t.add_argument("--map-proj", choices=("global", "nh_stereo", "sh_stereo", "healpix"), default="global")
    t.add_argument("--resolution", type=float, default=100.0)
    t.add_argument("--extent", default="-13000,13000,-13000,13000")
    t.add_argument("-t", "--threshold", type=float)
    band = t.add_mutually_exclusive_group()
    band.add_argument("--filter-range")
    band.add_argument("--no-filter", action="store_true")
    t.add_argument("-n", "--num", type=int)
    t.add_argument("-b", "--backend", choices=("serial", "mpi", "dask"), help="serial: one local core; others: the Spark master decides")
    t.add_argument("-w", "--workers", type=int, help="partitions")
    t.add_argument("-c", "--chunk-size", type=int, default=60)
    t.add_argument("--overlap", type=int, default=3)
    t.add_argument("-e", "--engine")
    t.add_argument("--min-points", type=int, default=1)
    t.add_argument("--taper", type=int, default=0)
    for name, kind in (("w1", float), ("w2", float), ("dmax", float), ("phimax", float), ("iterations", int), ("min-lifetime", int), ("max-missing", int)):
        t.add_argument(f"--{name}", type=kind)
    zones, adapt = t.add_mutually_exclusive_group(), t.add_mutually_exclusive_group()
    zones.add_argument("--zone-file")
    zones.add_argument("--zones", help="JSON list of lon_min, lon_max, lat_min, lat_max, degrees")
    adapt.add_argument("--adapt-file")
    adapt.add_argument("--adapt-params", help="JSON, two rows of four")
    c = sub.add_parser("convert", help="turn a track file into another format")
    c.add_argument("-i", "--input", required=True)
    c.add_argument("-o", "--output", required=True)
    c.add_argument("-f", "--from", dest="source", choices=("imilast", "json"), required=True)
    c.add_argument("-F", "--to", choices=("imilast", "hodges", "json", "html"), required=True)
    c.add_argument("--type", choices=("msl", "vo"))
    c.add_argument("--split", action="store_true")
    return p


def rules_of(a: argparse.Namespace) -> Rules:
    given = {k: getattr(a, k) for k in ("w1", "w2", "dmax", "phimax", "iterations", "min_lifetime", "max_missing") if getattr(a, k) is not None}
    zones = gridded.read_zones(a.zone_file) if a.zone_file else json.loads(a.zones) if a.zones else [list(z) for z in ZONES]
    adapt = gridded.read_adapt(a.adapt_file) if a.adapt_file else json.loads(a.adapt_params) if a.adapt_params else [list(x) for x in ADAPT]
    return Rules(**given, zones=zones, adapt=adapt)


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    backend = getattr(a, "backend", None)
    if backend in ("mpi", "dask"):
        warnings.warn(f"backend {backend}: Spark's master decides how the work is spread", stacklevel=2)
    spark = session(master="local[1]" if backend == "serial" else None)
    if a.command == "convert":
        points = (formats.read_imilast if a.source == "imilast" else formats.read_json)(spark, a.input)
        from .operators.tracks import infer_kind

        formats.write(points, a.output, a.type or infer_kind(points).first()["kind"], a.to, a.split)
        return
    algorithm = "healpix" if a.map_proj == "healpix" else a.algorithm
    use_filter = not a.no_filter and (algorithm != "simple" or a.filter_range is not None)
    lmin, lmax = wave_range(a.filter_range) if a.filter_range else (LMIN, LMAX)
    options = dict(
        mode=a.mode, threshold=a.threshold, filter=use_filter, lmin=lmin, lmax=lmax, taper=a.taper, map_proj=a.map_proj, resolution=a.resolution,
        extent=tuple(map(float, a.extent.split(","))), first=a.num, engine=a.engine, min_points=a.min_points, chunk=a.chunk_size, overlap=a.overlap,
    )
    tracker = SimpleTracker() if algorithm == "simple" else (HealpixTracker if algorithm == "healpix" else ExchangeTracker)(rules_of(a))
    points = tracker.track(spark, a.input, a.var, **options)
    if a.workers:
        points = points.repartition(a.workers, F.col("track_id"))
    formats.write(points, a.output, a.var, a.format)


def convert(argv: list[str] | None = None) -> None:
    """``gridtrack-convert``: the convert command by itself."""
    import sys

    main(["convert", *(sys.argv[1:] if argv is None else argv)])


if __name__ == "__main__":
    main()
