"""Track-level operators on points (track_id, us, pos, lat, lon, v): statistics, filters, orders, splices, comparison.

``us`` is microseconds since 1970, ``pos`` settles equal times.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import arc_km, haversine_km, lon_gap
from ..storage import numbered, written


def by_track():
    """The window over a track's points in order of time."""
    return Window.partitionBy("track_id").orderBy("us", "pos")


def statistics(points: DataFrame, kind: str = "msl") -> DataFrame:
    """n_points, first and last time, strength (least for msl, greatest else), duration in hours, displacement in km."""
    at = F.struct("us", "pos", "lat", "lon")
    s = points.groupBy("track_id").agg(F.count("*").alias("n_points"), F.min(at).alias("a"), F.max(at).alias("b"), (F.min if kind == "msl" else F.max)("v").alias("strength"))
    return s.select(
        "track_id", "n_points", F.col("a.us").alias("first_us"), F.col("b.us").alias("last_us"), "strength",
        ((F.col("b.us") - F.col("a.us")) / 3_600_000_000).alias("duration_h"), arc_km("a.lat", "a.lon", "b.lat", "b.lon").alias("displacement_km"),
    )


def metadata(points: DataFrame, kind: str = "msl") -> DataFrame:
    """One row of extremes over all tracks; zeros without tracks."""
    s = statistics(points, kind).agg(F.min("first_us").alias("min_us"), F.max("last_us").alias("max_us"), F.max("duration_h").alias("max_duration"), F.max("displacement_km").alias("max_displacement"), F.count("*").alias("n_tracks"))
    p = points.agg(F.min("v").alias("min_strength"), F.max("v").alias("max_strength"))
    out = s.withColumn("_k", F.lit(1)).join(p.withColumn("_k", F.lit(1)), "_k").drop("_k")  # one row each
    return out.select(*[F.coalesce(c, F.lit(0).cast(t)).alias(c) for c, t in out.dtypes])


def infer_kind(points: DataFrame) -> DataFrame:
    """One row: msl if the median value is over 500 or below -100, else vo; unknown without values."""
    m = points.agg(F.median(F.when(~F.isnan("v"), F.col("v"))).alias("m"))
    return m.select(F.when(F.col("m").isNull(), "unknown").when((F.col("m") > 500) | (F.col("m") < -100), "msl").otherwise("vo").alias("kind"))


def scale_pressure(points: DataFrame) -> DataFrame:
    """Values over 100 if any is beyond 500 in size."""
    big = points.agg((F.max(F.abs(F.when(~F.isnan("v"), F.col("v")))) > 500).alias("_big")).withColumn("_k", F.lit(1))
    out = points.withColumn("_k", F.lit(1)).join(F.broadcast(big), "_k")  # one row
    return out.withColumn("v", F.when(F.coalesce("_big", F.lit(False)), F.col("v") / 100).otherwise(F.col("v"))).drop("_k", "_big")


def number_steps(points: DataFrame) -> DataFrame:
    return points.withColumn("step", F.row_number().over(by_track()))


def sort_tracks(points: DataFrame) -> DataFrame:
    """``rank``: the order of tracks by their first point's time, latitude, longitude; points follow within it."""
    first = points.groupBy("track_id").agg(F.min(F.struct("us", "pos", "lat", "lon")).alias("f"))
    first = first.select("track_id", F.col("f.us").alias("_us"), F.col("f.lat").alias("_lat"), F.col("f.lon").alias("_lon"))
    ranked = numbered(first, ["_us", "_lat", "_lon", "track_id"], "rank").select("track_id", F.col("rank").cast("int").alias("rank"))
    return number_steps(points).join(ranked, "track_id")


def min_lifetime(points: DataFrame, least: int) -> DataFrame:
    """Tracks of ``least`` or more points, numbered again from 1 in order of their ids."""
    keep = points.groupBy("track_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    keep = numbered(keep.select("track_id"), ["track_id"], "new_id")
    return points.join(keep, "track_id")


def eligible(points: DataFrame, kind: str = "msl", strength: float | None = None, hours: float = 0, km: float = 0, start=None, end=None) -> DataFrame:
    """Points in a time window of the tracks that are strong, long-lived and far-travelled enough."""
    s = statistics(points, kind).where((F.col("duration_h") >= hours) & (F.col("displacement_km") >= km))
    if strength is not None:
        s = s.where(F.col("strength") <= strength if kind == "msl" else F.col("strength") >= strength)
    out = points.join(s.select("track_id"), "track_id", "left_semi")
    out = out if start is None else out.where(F.col("us") >= start)
    return out if end is None else out.where(F.col("us") <= end)


def segments(points: DataFrame) -> DataFrame:
    """``segment``: the part of a track's line up to its next step across the date line; ``mean_v`` with the next point."""
    jump = F.abs(F.col("lon") - F.lag("lon").over(by_track())) > 180
    out = points.withColumn("segment", F.sum(F.when(jump, 1).otherwise(0)).over(by_track()))
    inside = Window.partitionBy("track_id", "segment").orderBy("us", "pos")
    return out.withColumn("mean_v", (F.col("v") + F.lead("v").over(inside)) / 2)


def missing_runs(points: DataFrame, spacing_us: int, most: int) -> DataFrame:
    """``part``: pieces of a track between gaps of more than ``most`` missing steps."""
    gap = (F.col("us") - F.lag("us").over(by_track())) > spacing_us * (most + 1)
    return points.withColumn("part", F.sum(F.when(gap, 1).otherwise(0)).over(by_track()))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """All points of both, ids of ``b`` moved behind those of ``a``; values that one side lacks are null."""
    last = a.agg(F.coalesce(F.max("track_id"), F.lit(0)).alias("_last")).withColumn("_k", F.lit(1))
    moved = b.withColumn("_k", F.lit(1)).join(F.broadcast(last), "_k").withColumn("track_id", F.col("track_id") + F.col("_last")).drop("_k", "_last")
    return a.unionByName(moved, allowMissingColumns=True)


def replace_track(points: DataFrame, track_id: int, other: DataFrame) -> DataFrame:
    """The points of one track replaced by those of ``other``."""
    return points.where(F.col("track_id") != track_id).unionByName(other.withColumn("track_id", F.lit(track_id).cast("long")), allowMissingColumns=True)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(track_id, equal): whether both have the same points of a track."""
    x, y = (number_steps(p).groupBy("track_id").agg(F.sort_array(F.collect_list(F.struct("step", "us", "lat", "lon", "v"))).alias(n)) for p, n in ((a, "x"), (b, "y")))
    return x.join(y, "track_id", "full").select("track_id", F.coalesce(F.col("x") == F.col("y"), F.lit(False)).alias("equal"))


def splice(chunks: DataFrame, tolerance: float = 1e-5, overlap_aware: bool = True) -> DataFrame:
    """(track_id, t, lat, lon, v): tracks of chunks (chunk, track_id, step, t, lat, lon, v) joined into one set.

    A track goes on in the next chunk's track that shares its last point: within ``tolerance`` of it at the same time.
    Overlap-aware, any point of the next chunk's track may be that point; otherwise only its first.
    """
    from .linking import label_chains

    chunks = written(chunks, "chunk-tracks")
    last = chunks.groupBy("chunk", "track_id").agg(F.max(F.struct("t", "lat", "lon")).alias("e"))
    last = last.select((F.col("chunk") + 1).alias("chunk"), "e.t", F.col("track_id").alias("from_id"), F.col("e.lat").alias("_la"), F.col("e.lon").alias("_lo"))
    entry = chunks if overlap_aware else chunks.where("step = 1")
    hit = entry.join(last, ["chunk", "t"]).where((F.abs(F.col("lat") - F.col("_la")) < tolerance) & (F.abs(F.col("lon") - F.col("_lo")) < tolerance))
    one = hit.groupBy("chunk", "from_id").agg(F.min("track_id").alias("track_id")).groupBy("chunk", "track_id").agg(F.min("from_id").alias("from_id"))
    code = lambda c, i: F.shiftleft(c.cast("long"), 40) + F.col(i)
    edges = one.select(code(F.col("chunk") - 1, "from_id").alias("a"), code(F.col("chunk"), "track_id").alias("b"))
    nodes = chunks.select(code(F.col("chunk"), "track_id").alias("cid"), F.col("chunk").cast("long").alias("at")).distinct()
    root = label_chains(nodes, edges)
    joined = chunks.withColumn("cid", code(F.col("chunk"), "track_id")).join(root, "cid")
    ids = numbered(joined.select("root").distinct(), ["root"], "new_id")
    out = joined.join(ids, "root").select(F.col("new_id").alias("track_id"), "t", "lat", "lon", "v")
    return out.dropDuplicates(["track_id", "t"]) if overlap_aware else out


def compare(a: DataFrame, b: DataFrame, length_tol: int = 0, coord_tol: float = 1e-4, value_tol: float = 1e-4, dist_tol: float | None = None) -> DataFrame:
    """(a, b): tracks of ``a`` and the first like track of ``b``, each used once.

    Like tracks start at the same time, differ by at most ``length_tol`` in length, share all but ``length_tol`` times
    of the shorter and lie within the tolerances at every shared time. Candidates are judged by joins; only candidate
    ids with one start time are gathered to pick one each.
    """
    def shape(p, n):
        return p.groupBy("track_id").agg(F.min("us").alias("us0"), F.count("*").alias("n")).toDF(n, "us0", f"n{n}")

    cand = shape(a, "a").join(shape(b, "b"), "us0").where(F.abs(F.col("na") - F.col("nb")) <= length_tol)
    x = a.select(F.col("track_id").alias("a"), "us", F.col("lat").alias("la"), F.col("lon").alias("oa"), F.col("v").alias("va"))
    y = b.select(F.col("track_id").alias("b"), "us", F.col("lat").alias("lb"), F.col("lon").alias("ob"), F.col("v").alias("vb"))
    at = cand.join(x, "a").join(y, ["b", "us"])
    near = haversine_km("la", "oa", "lb", "ob") <= dist_tol if dist_tol is not None else (F.abs(F.col("la") - F.col("lb")) <= coord_tol) & (lon_gap("oa", "ob") <= coord_tol)
    near = near & F.coalesce(F.abs(F.col("va") - F.col("vb")) <= value_tol, F.lit(True))
    ok = at.groupBy("us0", "a", "b", "na", "nb").agg(F.count("*").alias("n"), F.min(near.cast("int")).alias("all"))
    ok = ok.where((F.col("all") == 1) & (F.col("n") >= F.least("na", "nb") - length_tol))

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for own, group in g.sort_values(["a", "b"]).groupby("a"):
            other = next((x for x in group["b"] if x not in used), None)
            if other is not None:
                used.add(other)
                out.append((own, other))
        return pd.DataFrame(out, columns=["a", "b"])

    return ok.select("us0", "a", "b").groupBy("us0").applyInPandas(pick, "a long, b long")
