"""Linking detections to trajectories by mutual nearest neighbours, all pairs of steps at once.

After a step the only open tracks are those with a centre in it, so the matching of step k to k + 1 depends on these two
steps alone. Matching runs in parallel by step; chains of matches are then labelled by pointer doubling.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from ..storage import numbered, written

LINK_KM = 500.0
#: Latitude bands for candidate pairs are as wide as the search radius, so that pairs lie in neighbouring bands.
KM_PER_DEGREE = 111.0


def linkable_steps(steps: list[tuple], start=None, end=None) -> set:
    """Times whose centres may continue tracks of the step before; ``steps`` holds (time, centres) in order.

    An empty step ends all tracks, and the first step after one has none to continue. Once the usual spacing is known
    (the first continued step's distance from the range's start), a step further than that from the range's end
    starts afresh. A range given by the user sets start and end.
    """
    alive, spacing, out = False, None, set()
    for t, n in steps:
        if n == 0:
            alive = False
        elif not alive:
            alive = True
            if start is None:
                start = end = t
        elif spacing is not None and end is not None and t - spacing > end:
            end = t
        else:
            out.add(t)
            if spacing is None and t != start:
                spacing = t - start
            if end is None or t > end:
                end = t
    return out


def step_pairs(centers: DataFrame, within_km: float = LINK_KM) -> DataFrame:
    """(step, a, b, d): centres of step - 1 and step less than ``within_km`` apart.

    Centres meet by step and latitude band; ``centers`` has (step, cid, lat, lon) with steps numbered without gaps.
    """
    width = within_km / KM_PER_DEGREE + 1e-6
    band = F.floor(F.col("lat") / width)
    a = centers.select((F.col("step") + 1).alias("step"), F.explode(F.array(band - 1, band, band + 1)).alias("band"), F.col("cid").alias("a"), F.col("lat").alias("la"), F.col("lon").alias("oa"))
    b = centers.select("step", band.alias("band"), F.col("cid").alias("b"), F.col("lat").alias("lb"), F.col("lon").alias("ob"))
    d = haversine_km("la", "oa", "lb", "ob")
    return a.join(b, ["step", "band"]).withColumn("d", d).where(F.col("d") < within_km).select("step", "a", "b", "d", "la", "oa", "lb", "ob")


def mutual_nearest(pairs: DataFrame) -> DataFrame:
    """One round of mutual nearest neighbours: (step, a, b, d), ties to the lesser (lat, lon)."""
    w = lambda own, other: Window.partitionBy("step", own).orderBy("d", *other)
    ranked = pairs.withColumn("_ra", F.row_number().over(w("a", ("lb", "ob", "b")))).withColumn("_rb", F.row_number().over(w("b", ("la", "oa", "a"))))
    return ranked.where("_ra = 1 and _rb = 1").select("step", "a", "b", "d")


#: Steps that one task matches or labels at once; centres of so many steps are what it holds.
STEPS = 128


def match(pairs: DataFrame) -> DataFrame:
    """Mutual nearest neighbours repeated until no pair is left: (step, a, b).

    That is the same as taking pairs in order of distance and leaving out those with an end already taken. Distances
    that agree to a millimetre are ties, settled by latitude and longitude. A task holds the pairs of a few steps,
    which the search radius bounds.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.assign(d=g["d"].round(6)).sort_values(["d", "la", "oa", "a", "lb", "ob", "b"], kind="stable")
        used_a, used_b, out = set(), set(), []  # ids differ between steps
        for step, a, b in zip(g["step"], g["a"], g["b"], strict=True):
            if a not in used_a and b not in used_b:
                used_a.add(a)
                used_b.add(b)
                out.append((step, a, b))
        return pd.DataFrame(out, columns=["step", "a", "b"])

    return pairs.groupBy(F.floor(F.col("step") / 16).alias("_run")).applyInPandas(run, "step long, a long, b long")


def label_chains(nodes: DataFrame, edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(cid, root): the first node of the chain that each of ``nodes`` (cid, at) is on; a node has at most one edge
    (a -> b) in, from a node that is earlier by ``at``.

    Chains are followed within runs of ``STEPS`` places first; pointer doubling then ties the runs together, each round
    halving what is left of every chain of runs.
    """
    at = nodes.select("cid", "at").join(edges.select(F.col("b").alias("cid"), F.col("a").alias("prev")), "cid", "left")

    def follow(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["at", "cid"], kind="stable")
        root, up = {}, []
        for cid, prev in zip(g["cid"].tolist(), g["prev"].tolist(), strict=True):
            inside = prev in root  # a missing one is no key
            root[cid] = root[prev] if inside else cid
            up.append(None if inside or prev != prev or prev is None else int(prev))
        return pd.DataFrame({"cid": g["cid"], "root": list(root.values()), "up": pd.array(up, "Int64")})

    runs = at.withColumn("prev", F.col("prev").cast("long")).groupBy(F.floor(F.col("at") / STEPS).alias("_run"))
    local = written(runs.applyInArrow(_exact(follow), "cid long, root long, up long"), "runs")
    heads = local.where("up is not null")
    if heads.isEmpty():
        return local.select("cid", "root")
    parent = heads.select("cid", "up").join(local.select(F.col("cid").alias("up"), F.col("root").alias("top")), "up").select("cid", "top")
    at = written(parent, "heads")
    for _ in range(rounds):
        jump = at.select(F.col("cid").alias("top"), F.col("top").alias("_up"))
        new = written(at.join(jump, "top", "left").select("cid", F.coalesce("_up", "top").alias("top"), F.col("_up").isNotNull().alias("moved")), "heads")
        at = new.select("cid", "top")
        if new.where("moved").isEmpty():
            break
    return local.join(at.select(F.col("cid").alias("root"), "top"), "root", "left").select("cid", F.coalesce("top", "root").alias("root"))


def _exact(f):
    """``f`` with null longs as None: as doubles, large ones would be rounded."""

    def run(table: pa.Table) -> pa.Table:
        g = table.to_pandas(integer_object_nulls=True)
        return pa.Table.from_pandas(f(g), preserve_index=False)

    return run


def link(centers: DataFrame, steps: DataFrame, within_km: float = LINK_KM, start=None, end=None) -> DataFrame:
    """Tracks of ``centers`` (t, c_idx, lat, lon, v): (track_id, step, t, c_idx, lat, lon, v) and any further columns.

    ``steps`` (t, n) holds every step, also those without centres; it is the only thing read on the driver, one small
    row a step; with n null it is counted from ``centers``. ``start`` and ``end`` are the times of a range that the
    user gave. Track ids start at 1 in order of first step, latitude, longitude. ``centers`` is written once and read
    from there.
    """
    c = written(centers, "centers")
    if "n" not in steps.columns:
        steps = steps.select("t").distinct().join(c.groupBy("t").agg(F.count("*").alias("n")), "t", "left").select("t", F.coalesce("n", F.lit(0)).alias("n"))
    order = [(r["t"], r["n"]) for r in steps.orderBy("t").select("t", "n").collect()]
    go = linkable_steps(order, start, end)
    kind = steps.schema["t"].dataType.simpleString()
    places = centers.sparkSession.createDataFrame([(t, k, t in go) for k, (t, _) in enumerate(order)], f"t {kind}, step long, go boolean")
    names = [x for x in centers.columns if x not in ("t", "step")]
    c = c.select("t", *names).join(F.broadcast(places), "t")  # one row a step
    c = c.withColumn("cid", F.shiftleft(F.col("step"), 32) + F.col("c_idx"))
    pairs = step_pairs(c, within_km).join(F.broadcast(places.where("go").select("step")), "step", "left_semi")
    chain = written(label_chains(c.select("cid", F.col("step").alias("at")), match(pairs)), "chains")
    c = c.join(chain, "cid")
    first = numbered(c.where("cid = root").select("root", F.col("step").alias("_s"), "lat", "lon", "c_idx"), ["_s", "lat", "lon", "c_idx"], "track_id").select("root", "track_id")
    return c.join(first, "root").select("track_id", F.row_number().over(Window.partitionBy("track_id").orderBy("step")).alias("step"), "t", *names)
