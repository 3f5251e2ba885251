"""Detection on cells by windows and equi-joins: extrema, Laplacians, duplicate removal, objects, refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.fields import Grid, clean

INF = float("inf")


def threshold_mask(cells: DataFrame, threshold: float, mode: str = "min") -> DataFrame:
    """Cells at or beyond a threshold; missing values are never in it."""
    cells = clean(cells).where("v is not null")
    return cells.where(F.col("v") <= threshold if mode == "min" else F.col("v") >= threshold)


def densify(cells: DataFrame, grid: Grid) -> DataFrame:
    """A row for every cell of every frame that has any; missing ones null. Windows need it: they count rows."""
    full = cells.select("t").distinct().select("t", F.explode(F.sequence(F.lit(0), F.lit(grid.nlat * grid.nlon - 1))).alias("p"))
    full = full.select("t", F.floor(F.col("p") / grid.nlon).cast("int").alias("i"), (F.col("p") % grid.nlon).cast("int").alias("j"))
    full = full.join(cells.select("t", "i", "j", "v"), ["t", "i", "j"], "left")
    return full.select("t", "i", "j", grid.lat().alias("lat"), grid.lon().alias("lon"), "v")


def sliding_min(cells: DataFrame, grid: Grid, size: int, value: str = "v", out: str = "low") -> DataFrame:
    """Least value in a ``size`` square around each cell: first along rows, with wrapped columns, then along columns.

    Rows are cut at the poles. All of it is by frame, so one exchange on t serves both windows.
    """
    if size % 2 == 0:
        raise ValueError("size must be odd")
    h, n = size // 2, grid.nlon
    near = F.filter(F.array(F.col("j"), F.col("j") + n, F.col("j") - n), lambda x: (x >= -h) & (x < n + h))
    haloed = cells.repartition("t").withColumn("_jj", F.explode(near))
    row = Window.partitionBy("t", "i").orderBy("_jj").rangeBetween(-h, h)
    low = haloed.withColumn("_row", F.min(value).over(row)).where((F.col("_jj") >= 0) & (F.col("_jj") < n)).drop("_jj")
    return low.withColumn(out, F.min("_row").over(Window.partitionBy("t", "j").orderBy("i").rangeBetween(-h, h))).drop("_row")


def _signed(cells: DataFrame, mode: str) -> DataFrame:
    return cells.withColumn("w", F.col("v") if mode == "min" else -F.col("v"))


def _offsets(size: int) -> Column:
    h = size // 2
    return F.explode(F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a in range(-h, h + 1) for b in range(-h, h + 1)]))


def neighbours(centers: DataFrame, cells: DataFrame, grid: Grid, offsets: Column, value: str) -> DataFrame:
    """``centers`` by offset, with the value of the cell there (null where there is none) as ``nv``."""
    at = centers.withColumn("_o", offsets).select("*", (F.col("i") + F.col("_o.di")).alias("_ni"), F.pmod(F.col("j") + F.col("_o.dj"), F.lit(grid.nlon)).alias("_nj"))
    there = cells.select("t", F.col("i").alias("_ni"), F.col("j").alias("_nj"), F.col(value).alias("nv"))
    return at.join(there, ["t", "_ni", "_nj"], "left").drop("_ni", "_nj")


def extrema(cells: DataFrame, grid: Grid, size: int = 5, threshold: float = 0.0, mode: str = "min") -> DataFrame:
    """Cells that nothing in their square undercuts and that a third of it exceeds by more than ``threshold``.

    Rows whose square would leave the grid have none. Plateaus pass as a whole. Missing cells count as infinitely
    high. Survivors of the cheap test alone are joined to their squares for the rank.
    """
    dense = _signed(densify(clean(cells), grid), mode)
    h, rank = size // 2, size * size // 3
    low = sliding_min(dense, grid, size, "w")
    low = low.where((F.col("i") >= h) & (F.col("i") < grid.nlat - h) & (F.col("w") == F.col("low"))).drop("low")
    there = _signed(clean(cells), mode)
    near = neighbours(low, there, grid, _offsets(size), "w").groupBy("t", "i", "j", "lat", "lon", "v", "w").agg(F.sort_array(F.collect_list("nv")).alias("_s"))
    third = F.coalesce(F.get("_s", F.lit(rank)), F.lit(INF))
    return near.where(third - F.col("w") > threshold).drop("_s", "w")


def laplacian(centers: DataFrame, cells: DataFrame, grid: Grid, mode: str = "min") -> DataFrame:
    """``centers`` with ``lap``: the four neighbours' sum less four times the centre, rows and columns wrapped, with
    the sign that makes it positive at an extremum; infinite beside a missing cell."""
    four = F.explode(F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1))]))
    at = centers.withColumn("_o", four).select("*", F.pmod(F.col("i") + F.col("_o.di"), F.lit(grid.nlat)).alias("_ni"), F.pmod(F.col("j") + F.col("_o.dj"), F.lit(grid.nlon)).alias("_nj"))
    there = clean(cells).select("t", F.col("i").alias("_ni"), F.col("j").alias("_nj"), F.col("v").alias("_nv"))
    near = at.join(there, ["t", "_ni", "_nj"], "left").groupBy("t", "i", "j", "lat", "lon", "v")
    near = near.agg(F.sum("_nv").alias("_s"), F.count("_nv").alias("_n"))
    lap = (F.col("_s") - 4 * F.col("v")) * (1 if mode == "min" else -1)
    return near.withColumn("lap", F.when(F.col("_n") < 4, F.lit(INF)).otherwise(lap)).drop("_s", "_n")


def drop_duplicates(centers: DataFrame, grid: Grid, size: int = 5) -> DataFrame:
    """Centres whose Laplacian no other within the square exceeds; ties go to the first in row order, zeros go."""
    c = centers.where("lap <> 0")
    near = c.select("t", "i", "j", "lap").withColumn("_o", _offsets(size)).select(
        "t", (F.col("i") + F.col("_o.di")).alias("i"), F.pmod(F.col("j") + F.col("_o.dj"), F.lit(grid.nlon)).cast("int").alias("j"),
        F.col("i").alias("_i"), F.col("j").alias("_j"), F.abs("lap").alias("_lap"),
    )
    here = c.withColumn("_a", F.abs("lap"))
    beaten = here.join(near, ["t", "i", "j"]).where((F.col("_lap") > F.col("_a")) | ((F.col("_lap") == F.col("_a")) & (F.struct("_i", "_j") < F.struct("i", "j"))))
    return c.join(beaten.select("t", "i", "j").distinct(), ["t", "i", "j"], "left_anti")


def number_centers(centers: DataFrame, most: int | None = None) -> DataFrame:
    """``c_idx`` from 0 by frame in row order; a frame keeps its first ``most``."""
    out = centers.withColumn("c_idx", F.row_number().over(Window.partitionBy("t").orderBy("i", "j")) - 1)
    return out if most is None else out.where(F.col("c_idx") < most)


def simple_detect(cells: DataFrame, grid: Grid, size: int = 5, threshold: float = 0.0, mode: str = "min") -> DataFrame:
    """Centres of local extrema: (t, c_idx, i, j, lat, lon, v)."""
    found = laplacian(extrema(cells, grid, size, threshold, mode), cells, grid, mode)
    return number_centers(drop_duplicates(found, grid).drop("lap"))


def steps(cells: DataFrame, centers: DataFrame) -> DataFrame:
    """(t, n): every frame with the number of its centres, frames without any among them."""
    return cells.select("t").distinct().join(centers.groupBy("t").agg(F.count("*").alias("n")), "t", "left").select("t", F.coalesce("n", F.lit(0)).alias("n"))


def object_sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("t", "label").agg(F.count("*").alias("n_cells"))


def object_extrema(labelled: DataFrame, cells: DataFrame, grid: Grid, size: int = 5, mode: str = "min", min_points: int = 1) -> DataFrame:
    """Cells of objects of ``min_points`` or more cells that no cell of the frame undercuts within the square."""
    low = sliding_min(_signed(densify(clean(cells), grid), mode), grid, size, "w")
    low = low.where(F.col("w") == F.col("low")).drop("low", "w")
    big = labelled.withColumn("_n", F.count("*").over(Window.partitionBy("t", "label"))).where(F.col("_n") >= min_points)
    return low.join(big.select("t", "i", "j", "label"), ["t", "i", "j"])


def refine(centers: DataFrame, cells: DataFrame, grid: Grid, periodic: bool = True) -> DataFrame:
    """Centres moved to the stationary point of the quadratic through their 3 x 3 square: rlat, rlon, rv.

    The grid point stays at the first and last row, where a neighbour is missing, where the determinant is below
    1e-10, and where the point would leave the square.
    """
    near = neighbours(centers, cells, grid, _offsets(3), "v")
    pick = lambda a, b: F.max(F.when((F.col("_o.di") == a) & (F.col("_o.dj") == b), F.col("nv")))
    names = {(a, b): f"_z{a + 1}{b + 1}" for a in (-1, 0, 1) for b in (-1, 0, 1)}
    keys = [c for c in centers.columns]
    z = near.groupBy(*keys).agg(*[pick(a, b).alias(n) for (a, b), n in names.items()])
    g = {k: F.col(n) for k, n in names.items()}
    fx, fy = (g[0, 1] - g[0, -1]) / 2, (g[1, 0] - g[-1, 0]) / 2
    fxx, fyy = g[0, 1] - 2 * g[0, 0] + g[0, -1], g[1, 0] - 2 * g[0, 0] + g[-1, 0]
    fxy = (g[1, 1] - g[1, -1] - g[-1, 1] + g[-1, -1]) / 4
    z = z.select(*keys, fx.alias("_fx"), fy.alias("_fy"), fxx.alias("_fxx"), fyy.alias("_fyy"), fxy.alias("_fxy"))
    z = z.withColumn("_det", F.col("_fyy") * F.col("_fxx") - F.col("_fxy") * F.col("_fxy"))
    dx = -(F.col("_fyy") * F.col("_fx") - F.col("_fxy") * F.col("_fy")) / F.col("_det")
    dy = -(F.col("_fxx") * F.col("_fy") - F.col("_fxy") * F.col("_fx")) / F.col("_det")
    ok = (F.col("i") > 0) & (F.col("i") < grid.nlat - 1) & (F.abs("_det") >= 1e-10)
    z = z.withColumn("_dx", F.when(ok, dx)).withColumn("_dy", F.when(ok, dy))
    ok = F.coalesce((F.abs("_dx") <= 1) & (F.abs("_dy") <= 1), F.lit(False))
    if not periodic:
        ok = ok & (F.col("j") > 0) & (F.col("j") < grid.nlon - 1)
    lon = F.col("lon") + F.col("_dx") * grid.dlon
    return z.select(
        *keys, F.when(ok, F.col("lat") + F.col("_dy") * grid.dlat).otherwise(F.col("lat")).alias("rlat"),
        F.when(ok, F.pmod(lon, F.lit(360.0)) if periodic else lon).otherwise(F.col("lon")).alias("rlon"),
        F.when(ok, F.col("v") + (F.col("_fy") * F.col("_dy") + F.col("_fx") * F.col("_dx")) * 0.5).otherwise(F.col("v")).alias("rv"),
    )


def object_detect(cells: DataFrame, grid: Grid, size: int = 5, threshold: float = 0.0, mode: str = "min", min_points: int = 1) -> DataFrame:
    """Refined extrema of thresholded objects: (t, c_idx, i, j, lat, lon, v, label, rlat, rlon, rv)."""
    from .objects import label_objects

    labelled = label_objects(threshold_mask(cells, threshold, mode), grid)
    return refine(number_centers(object_extrema(labelled, cells, grid, size, mode, min_points), None), cells, grid)
