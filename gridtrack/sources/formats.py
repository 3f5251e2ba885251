"""Track files: intercomparison text, tdump text, hybrid-index JSON and an HTML page over it."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import lon180, lon360
from ..operators import tracks as T
from ..storage import numbered, written

SCALE = {"msl": 0.01, "vo": 1e5}
HEADER = "99 00,CycloneNo,StepNo,DateI10,Year,Month,Day,Time,LongE,LatN,"


def _ordered(points: DataFrame) -> DataFrame:
    """Points with ``no``, the track's number from 1 in order of ids, ``n`` and ``step``."""
    ids = numbered(points.groupBy("track_id").agg(F.count("*").alias("n")), ["track_id"], "no").withColumn("no", F.col("no").cast("int"))
    return T.number_steps(points).join(ids, "track_id")


def imilast_lines(points: DataFrame, kind: str = "msl", decimals: int = 6) -> DataFrame:
    """(no, step, line): a header at (0, 0), then a head at step 0 and a line for each point of each track.

    Longitudes over 180 are negative, coordinates have two decimals, times are whole hours; a point without a time has
    zeros in its place; msl comes in hPa and vo in 1e-5 / s.
    """
    p = _ordered(points)
    ts = F.timestamp_micros("us")
    date = F.when(F.col("us").isNull(), F.lit("0000000000 0 00 00 00")).otherwise(F.concat_ws(" ", F.date_format(ts, "yyyyMMddHH"), F.date_format(ts, "yyyy"), F.date_format(ts, "MM"), F.date_format(ts, "dd"), F.date_format(ts, "HH")))
    line = F.concat_ws(" ", F.lit("00"), F.col("no"), F.col("step"), date, F.format_string("%.2f", lon180("lon")), F.format_string("%.2f", F.col("lat")), F.format_string(f"%.{decimals}f", F.col("v") * SCALE.get(kind, 1.0)))
    rows = p.select("no", "step", line.alias("line"))
    heads = p.where("step = 1").select("no", F.lit(0).alias("step"), F.concat_ws(" ", F.lit("90"), F.col("no"), F.col("n")).alias("line"))
    top = points.sparkSession.createDataFrame([(0, 0, HEADER + (kind.upper() if kind in SCALE else "Intensity1"))], "no int, step int, line string")
    return top.unionByName(heads).unionByName(rows)


def tdump_lines(points: DataFrame) -> DataFrame:
    """(no, step, line): tdump text; two lines of zeros and a count first, numbered steps -1 and below."""
    p = _ordered(points)
    rows = p.select("no", "step", F.format_string("%d %10.6f %10.6f %12.6e", F.col("step"), lon360("lon"), F.col("lat"), F.col("v")).alias("line"))
    one = p.where("step = 1")
    heads = one.select("no", F.lit(-1).alias("step"), F.format_string("TRACK_ID %2d", F.col("no")).alias("line")).unionByName(one.select("no", F.lit(0).alias("step"), F.format_string("POINT_NUM %3d", F.col("n")).alias("line")))
    count = points.agg(F.countDistinct("track_id").alias("n"))
    top = count.select(F.lit(0).alias("no"), F.explode(F.array(*[F.struct(F.lit(k).alias("step"), x.alias("line")) for k, x in ((-3, F.lit("0")), (-2, F.lit("0 0")), (-1, F.format_string("TRACK_NUM %10d ADD_FLD    0   0 &", F.col("n"))))])).alias("x")).select("no", "x.*")
    return top.unionByName(heads).unionByName(rows)


def json_offsets(points: DataFrame) -> DataFrame:
    """(track_id, start, end): places of each track in point lists that have a separator between tracks."""
    n = points.groupBy("track_id").agg(F.count("*").alias("n"))
    order = Window.partitionBy(F.lit(0)).orderBy("track_id")  # one row a track
    start = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.row_number().over(order) - 1
    return n.withColumn("start", start).select("track_id", "start", (F.col("start") + F.col("n") - 1).alias("end"))


def to_json(points: DataFrame, kind: str = "msl") -> dict:
    """The JSON document of a track set. A document is one file, so its points do come to the driver."""
    if kind == "msl":
        points = T.scale_pressure(points)
    rows = T.number_steps(points).orderBy("track_id", "step").collect()
    if not rows:
        return {"points": {}, "tracks": [], "metadata": {}}
    out: dict[str, list] = {"lat": [], "lon": [], "time": [], "strength": []}
    last = None
    for r in rows:
        if last is not None and r["track_id"] != last:
            for x in out.values():
                x.append(None)
        last = r["track_id"]
        for k, x in (("lat", r["lat"]), ("lon", r["lon"]), ("time", r["us"] // 1000), ("strength", r["v"])):
            out[k].append(None if x is None or x != x else x)
    s = T.statistics(points, kind).join(json_offsets(points), "track_id").orderBy("track_id").collect()
    meta = T.metadata(points, kind).first()
    return {
        "metadata": {"track_type": kind, "min_time": meta["min_us"] // 1000, "max_time": meta["max_us"] // 1000, **{k: meta[k] for k in ("min_strength", "max_strength", "max_duration", "max_displacement")}},
        "points": out,
        "tracks": [{"track_id": r["track_id"], "start": r["start"], "end": r["end"], "strength": r["strength"], "duration": r["duration_h"], "displacement": r["displacement_km"]} for r in s],
    }


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Points of a JSON document, separators dropped by each track's places."""
    doc = spark.read.option("multiLine", True).json(path)
    p = doc.select(F.posexplode(F.arrays_zip("points.lat", "points.lon", "points.time", "points.strength")).alias("at", "p"))
    t = doc.select(F.explode("tracks").alias("t")).select("t.track_id", F.explode(F.sequence("t.start", "t.end")).alias("at"))
    return t.join(p, "at").select("track_id", (F.col("p.time") * 1000).alias("us"), F.col("at").alias("pos"), F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"), F.col("p.strength").alias("v"))


def _time(text: Column) -> Column:
    """Microseconds of YYYYMMDDHH, seconds since 1970, or an ISO time."""
    date = F.when(text.rlike(r"^\d{10}$"), F.try_to_timestamp(text, F.lit("yyyyMMddHH")))
    number = F.when(text.rlike(r"^[+-]?\d+(\.\d+)?$"), F.timestamp_seconds(text.try_cast("double")))
    return F.unix_micros(F.coalesce(date, number, F.try_to_timestamp(text)))


def parse_imilast(lines: DataFrame) -> DataFrame:
    """Points of intercomparison text (value): rows of code 00; values in Pa or 1 / s again.

    msl values below 5000 in size count as hPa, vo values over 0.1 as 1e-5 / s.
    """
    head = lines.where(F.trim("value").startswith("99")).select(F.lower(F.trim(F.get(F.split("value", ","), F.lit(10)))).alias("_var")).limit(1)
    p = lines.withColumn("w", F.split(F.trim("value"), r"\s+")).where(F.col("w")[0] == "00")
    when = F.get("w", F.lit(3))
    p = p.select(F.get("w", F.lit(1)).cast("long").alias("track_id"), F.get("w", F.lit(2)).cast("long").alias("pos"), when.alias("_when"), F.get("w", F.lit(8)).cast("double").alias("lon"), F.get("w", F.lit(9)).cast("double").alias("lat"), F.get("w", F.lit(10)).cast("double").alias("x"))
    p = p.withColumn("us", _time(F.col("_when"))).withColumn("_k", F.lit(1)).join(F.broadcast(head.withColumn("_k", F.lit(1))), "_k", "left")  # one row
    v = F.when((F.col("_var") == "msl") & (F.abs("x") < 5000), F.col("x") * 100).when((F.col("_var") == "vo") & (F.abs("x") > 0.1), F.col("x") * 1e-5).otherwise(F.col("x"))
    return p.select("track_id", "us", "pos", "lat", "lon", v.alias("v"))


def read_imilast(spark: SparkSession, path: str) -> DataFrame:
    return parse_imilast(spark.read.text(path))


PAGE = """<!doctype html><html><head><meta charset="utf-8"><title>Tracks</title></head><body><svg id="map" viewBox="-180 -90 360 180"></svg>
<script{src}>{data}</script><script>
const p = TRACKS.points, svg = document.getElementById("map");
for (const t of TRACKS.tracks) {{
  let d = "", last = null;
  for (let k = t.start; k <= t.end; k++) {{
    const lon = (p.lon[k] + 540) % 360 - 180;
    d += (last === null || Math.abs(lon - last) > 180 ? "M" : "L") + lon + " " + -p.lat[k];
    last = lon;
  }}
  const e = document.createElementNS("http://www.w3.org/2000/svg", "path");
  e.setAttribute("d", d); e.setAttribute("fill", "none"); e.setAttribute("stroke", "black"); e.setAttribute("stroke-width", ".3");
  svg.appendChild(e);
}}
</script></body></html>
"""


def write(points: DataFrame, path: str, kind: str = "msl", format: str = "imilast", split: bool = False) -> None:
    """Write one file in imilast, hodges, json or html format."""
    out, points = Path(path), written(points, "points")
    if format in ("imilast", "hodges"):
        lines = imilast_lines(points, kind) if format == "imilast" else tdump_lines(points)
        with out.open("w", newline="") as f:
            for r in lines.orderBy("no", "step").toLocalIterator():
                f.write(r["line"] + "\n")
    elif format in ("json", "tracks-json"):
        out.write_text(json.dumps(to_json(points, kind), separators=(",", ":")))
    elif format == "html":
        data = "const TRACKS = " + json.dumps(to_json(points, kind), separators=(",", ":")) + ";"
        if split:
            side = out.with_suffix(".tracks.js")
            side.write_text(data)
            out.write_text(PAGE.format(src=f' src="{side.name}"', data=""))
        else:
            out.write_text(PAGE.format(src="", data=data))
    else:
        raise ValueError(f"unknown format {format}: imilast, hodges, json or html")
