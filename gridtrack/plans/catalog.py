"""Registry of the engine's queries: operators over fields made from the test tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import exchange, healpix, kernels, linking, objects, spectral, stencil
from ..operators import tracks as T
from ..sources import fields, formats

QUERIES, ORACLES = {}, {}
FLAGSHIP = "simple_link_stats"
D, S = fields.DENSE, fields.SPARSE

# Fields of the test tables in SQL.
G = """g AS (SELECT t, i, j, -70.0::DOUBLE + 20.0::DOUBLE * i AS lat, 45.0::DOUBLE * j AS lon, v FROM (
  SELECT vec_id AS t, ((p - 1) // 8)::INT AS i, ((p - 1) % 8)::INT AS j, embedding[p]::DOUBLE AS v FROM embeddings, range(1, 65) r(p)))"""
H = """g AS (SELECT t, i, j, -67.5::DOUBLE + 15.0::DOUBLE * i AS lat, 24.0::DOUBLE * j AS lon, v FROM (
  SELECT epoch_us(ts) // 21600000000 AS t, ((user_id % 150) // 15)::INT AS i, (user_id % 15)::INT AS j, max(value) AS v FROM events GROUP BY 1, 2, 3))"""
E = """e AS (SELECT user_id AS track_id, event_id AS pos, epoch_us(ts) AS us, (event_id * 37 % 1700) / 10.0::DOUBLE - 85 AS lat,
  (event_id * 91 % 3600) / 10.0::DOUBLE AS lon, value AS v FROM events)"""
KM = 6371.22


def _arc(a: str, b: str, c: str, d: str) -> str:
    return f"acos(greatest(-1, least(1, sin(radians({a})) * sin(radians({c})) + cos(radians({a})) * cos(radians({c})) * cos(radians({d} - {b})))))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _round(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# Filters


@query(f"WITH {G} SELECT t, i, j, v FROM g WHERE t BETWEEN 10 AND 40")
def time_range_filter(spark: SparkSession, sf: str) -> DataFrame:
    return fields.time_range(fields.dense_cells(spark, sf), 10, 40).select("t", "i", "j", "v")


@query(f"WITH {H} SELECT t, i, j, v FROM g WHERE t IN (SELECT DISTINCT t FROM g ORDER BY t LIMIT 20)")
def first_n_steps(spark, sf):
    return fields.first_steps(fields.sparse_cells(spark, sf), 20).select("t", "i", "j", "v")


@query(f"WITH {G} SELECT t, i, j, v FROM g WHERE v <= -0.1")
def threshold_mask_min(spark, sf):
    return stencil.threshold_mask(fields.dense_cells(spark, sf), -0.1).select("t", "i", "j", "v")


@query(f"WITH {G} SELECT t, i, j, v FROM g WHERE v >= 0.1")
def threshold_mask_max(spark, sf):
    return stencil.threshold_mask(fields.dense_cells(spark, sf), 0.1, "max").select("t", "i", "j", "v")


@query(f"WITH {G} SELECT arg_min(lat, i) > arg_max(lat, i) AS descends FROM g")
def latitude_order(spark, sf):
    return fields.latitude_descends(fields.dense_cells(spark, sf))


# Preprocessing


@query(f"""WITH {G}, w AS (SELECT *, least(i, 7 - i) AS a, least(j, 7 - j) AS b FROM g)
SELECT t, i, j, round(v * CASE WHEN a < 3 THEN (1 - cos(pi() * a / 3)) / 2 ELSE 1 END * CASE WHEN b < 3 THEN (1 - cos(pi() * b / 3)) / 2 ELSE 1 END, 9) AS v FROM w""")
def taper_mask(spark, sf):
    c = fields.dense_cells(spark, sf)
    return c.select("t", "i", "j", F.round(F.col("v") * geo.cosine_weight("i", 8, 3) * geo.cosine_weight("j", 8, 3), 9).alias("v"))


@query(f"""WITH {G} SELECT t, i, j, round(v * CASE WHEN least(i, 7 - i) < 3 THEN (1 - cos(pi() * least(i, 7 - i) / 3)) / 2 ELSE 1 END
  * CASE WHEN least(j, 7 - j) < 3 THEN (1 - cos(pi() * least(j, 7 - j) / 3)) / 2 ELSE 1 END, 9) AS v FROM g""")
def taper_frames(spark, sf):
    frames = spectral.taper(fields.to_frames(fields.dense_cells(spark, sf), D), (8, 8), 3)
    return fields.to_cells(frames, D).select("t", "i", "j", F.round("v", 9).alias("v"))


# Harmonic fields: the sums of four components each of an embedding are coefficients of the sixteen harmonics up to
# degree 3, written as polynomials in the unit vector (x, y, z); a filter keeps or drops whole degrees.
_HARMONICS = [
    (0, "1"), (1, "z"), (1, "x"), (1, "y"), (2, "3*z*z - 1"), (2, "x*z"), (2, "y*z"), (2, "x*x - y*y"), (2, "x*y"), (3, "5*z*z*z - 3*z"),
    (3, "x*(5*z*z - 1)"), (3, "y*(5*z*z - 1)"), (3, "z*(x*x - y*y)"), (3, "x*y*z"), (3, "x*(x*x - 3*y*y)"), (3, "y*(3*x*x - y*y)"),
]


def _coefficient(k: int, e: str) -> str:
    """The k-th coefficient, in SQL of either engine; ``e`` gives a component by its number from 1."""
    return "(" + " + ".join(e.format(4 * k + n) for n in range(1, 5)) + ")"


def _harmonic(e: str, low: int, high: int) -> str:
    return " + ".join(f"{_coefficient(k, e)} * ({h})" for k, (degree, h) in enumerate(_HARMONICS) if low <= degree <= high)


_C = "embedding[{0}]::DOUBLE"
_UNIT = "sin(theta) * cos(phi) AS x, sin(theta) * sin(phi) AS y, cos(theta) AS z"


def _grid_sql(nlat: int, nlon: int) -> str:
    return f"""q AS (SELECT (p // {nlon})::INT AS i, (p % {nlon})::INT AS j, {_UNIT} FROM (
  SELECT p, pi() * (p // {nlon}) / {nlat - 1} AS theta, 2 * pi() * (p % {nlon}) / {nlon} AS phi FROM range({nlat * nlon}) r(p)))"""


def _harmonic_frames(spark, sf, nlat: int = 8, nlon: int = 8):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("t"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    e = e.select("t", *[F.expr(_coefficient(k, "e[{0} - 1]")).alias(f"c{k}") for k in range(16)])
    return spectral.frames_of(e, nlat, nlon, lambda x, y, z: [eval(h, {"x": x, "y": y, "z": z}) + 0 * x for _, h in _HARMONICS], [f"c{k}" for k in range(16)])


@query(f"WITH {_grid_sql(8, 8)} SELECT vec_id AS t, i, j, round({_harmonic(_C, 1, 2)}, 6) + 0.0 AS v FROM embeddings, q")
def spectral_band_pass(spark, sf):
    frames = spectral.spectral_filter(_harmonic_frames(spark, sf), (8, 8), 1, 2)
    return fields.to_cells(frames, D).select("t", "i", "j", (F.round("v", 6) + 0.0).alias("v"))


@query(f"WITH {_grid_sql(11, 20)} SELECT vec_id AS t, i, j, round({_harmonic(_C, 0, 3)}, 6) + 0.0 AS v FROM embeddings, q")
def spectral_regrid(spark, sf):
    out = spectral.map_frames(_harmonic_frames(spark, sf), lambda f: spectral.regrid(f, 11, 20, 3), (8, 8))
    return fields.to_cells(out, fields.Grid(11, 20, 90.0, -18.0, 0.0, 18.0)).select("t", "i", "j", (F.round("v", 6) + 0.0).alias("v"))


def _rings(nside: int) -> str:
    """pix(pixel, z, phi): pixel centres in RING order in closed form, by cap and belt."""
    n, cap, all_ = nside, 2 * nside * (nside - 1), 12 * nside * nside
    return f"""pix AS (SELECT pixel, CASE WHEN pixel < {cap} THEN 1 - i * i / {3.0 * n * n}::DOUBLE WHEN pixel < {all_ - cap} THEN ({2 * n} - i) * 2 / {3.0 * n}::DOUBLE ELSE i * i / {3.0 * n * n}::DOUBLE - 1 END AS z,
  CASE WHEN pixel < {cap} OR pixel >= {all_ - cap} THEN (k - 0.5::DOUBLE) * pi() / (2 * i) ELSE (k - CASE WHEN (i + {n}) % 2 = 1 THEN 1 ELSE 0.5::DOUBLE END) * pi() / {2 * n} END AS phi FROM (
  SELECT pixel, i, CASE WHEN pixel < {cap} THEN pixel - 2 * i * (i - 1) + 1 WHEN pixel < {all_ - cap} THEN (pixel - {cap}) % {4 * n} + 1 ELSE 4 * i + 1 - ({all_} - pixel - 2 * i * (i - 1)) END AS k FROM (
  SELECT pixel, CASE WHEN pixel < {cap} THEN floor((1 + sqrt(1 + 2 * pixel)) / 2)::BIGINT WHEN pixel < {all_ - cap} THEN (pixel - {cap}) // {4 * n} + {n} ELSE floor((1 + sqrt(2 * ({all_} - pixel) - 1)) / 2)::BIGINT END AS i
  FROM range({all_}) r(pixel))))"""


@query(f"""WITH {_rings(2)}, q AS (SELECT pixel, sqrt(1 - z * z) * cos(phi) AS x, sqrt(1 - z * z) * sin(phi) AS y, z FROM pix)
SELECT vec_id AS t, pixel::INT AS pixel, round({_harmonic(_C, 0, 3)}, 6) + 0.0 AS v FROM embeddings, q""")
def spectral_to_healpix(spark, sf):
    out = spectral.map_frames(_harmonic_frames(spark, sf), lambda f: spectral.to_healpix(f, 2, 3), (8, 8))
    return out.select("t", F.posexplode("vals").alias("pixel", "v")).select("t", "pixel", (F.round("v", 6) + 0.0).alias("v"))


@query(f"""WITH a AS (SELECT p, (p % 9 - 4) * 1000.0::DOUBLE AS px, (p // 9 - 4) * 1000.0::DOUBLE AS py FROM range(81) r(p)
), b AS (SELECT p, 2 * atan(sqrt(px * px + py * py) / (2 * {KM})) AS theta, atan2(px, -py) AS phi FROM a), q AS (SELECT p, {_UNIT} FROM b)
SELECT vec_id AS t, p::INT AS p, round({_harmonic(_C, 1, 3)}, 6) + 0.0 AS v FROM embeddings, q""")
def spectral_to_stereo(spark, sf):
    out = spectral.map_frames(_harmonic_frames(spark, sf), lambda f: spectral.to_polar_stereo(f, extent=(-4000, 4000, -4000, 4000), resolution=1000, lmin=1, lmax=3), (8, 8))
    return out.select("t", F.posexplode("vals").alias("p", "v")).select("t", "p", (F.round("v", 6) + 0.0).alias("v"))


# A wind made of a rotation w x r, a turning of degree 2 (r x grad of r'Ar) and the gradients of g.r and r'Br: vorticity is
# 2 w.r - 6 r'Ar, divergence -2 g.r - 6 r'Br, for A and B without trace.
_WIND = {"w": (0, 1, 2), "g": (3, 4, 5), "A": (6, 7, 8, 9, 10), "B": (11, 12, 13, 14, 15)}


def _trace_free(m, v):
    """M v of the symmetric matrix with diagonal (m0, m1, -m0 - m1) and m2, m3, m4 off it (xy, xz, yz)."""
    x, y, z = v
    return [m[0] * x + m[2] * y + m[3] * z, m[2] * x + m[1] * y + m[4] * z, m[3] * x + m[4] * y - (m[0] + m[1]) * z]


def _wind_basis(x, y, z, part: int) -> list:
    """What each coefficient adds to the eastward (part 0) or northward (1) wind at points of the unit sphere."""
    import numpy as np

    phi, theta = np.arctan2(y, x), np.arccos(np.clip(z, -1, 1))
    grid = np.round(theta / (np.pi / 7)), np.round(np.linspace(0, 8, 9)[:-1])  # at the poles, longitude is the column's
    lon = np.broadcast_to(grid[1] * np.pi / 4, x.shape) if x.ndim == 2 else phi
    east, north = [-np.sin(lon), np.cos(lon), 0 * x], [-np.cos(theta) * np.cos(lon), -np.cos(theta) * np.sin(lon), np.sin(theta)]
    r, to = [x, y, z], (east, north)[part]
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    along = lambda v: v[0] * to[0] + v[1] * to[1] + v[2] * to[2]
    unit = lambda n, k: [float(i == k) for i in range(n)]
    out = [along(cross(unit(3, k), r)) for k in range(3)] + [along(unit(3, k)) for k in range(3)]
    out += [along(cross(r, [2 * c for c in _trace_free(unit(5, k), r)])) for k in range(5)]
    return out + [along([2 * c for c in _trace_free(unit(5, k), r)]) for k in range(5)]


def _form(m) -> str:
    c = [_coefficient(k, _C) for k in m]
    return f"({c[0]} * (x * x - z * z) + {c[1]} * (y * y - z * z) + 2 * ({c[2]} * x * y + {c[3]} * x * z + {c[4]} * y * z))"


def _dot(m) -> str:
    return "(" + " + ".join(f"{_coefficient(k, _C)} * {x}" for k, x in zip(m, "xyz", strict=True)) + ")"


@query(f"""WITH {_grid_sql(8, 8)} SELECT vec_id AS t, (i * 8 + j)::INT AS p, round(-2 * {_dot(_WIND['g'])} - 6 * {_form(_WIND['B'])}, 6) + 0.0 AS divergence,
  round(2 * {_dot(_WIND['w'])} - 6 * {_form(_WIND['A'])}, 6) + 0.0 AS vorticity FROM embeddings, q""")
def vorticity_divergence(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("t"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    names = [f"c{k}" for k in range(16)]
    e = e.select("t", *[F.expr(_coefficient(k, "e[{0} - 1]")).alias(f"c{k}") for k in range(16)])
    u, v = (spectral.frames_of(e, 8, 8, lambda x, y, z, part=part: _wind_basis(x, y, z, part), names) for part in (0, 1))
    w = spectral.wind_frames(u, v, (8, 8), radius=1.0).select("t", F.posexplode(F.arrays_zip("divergence", "vorticity")).alias("p", "x"))
    return w.select("t", "p", *[(F.round(f"x.{c}", 6) + 0.0).alias(c) for c in ("divergence", "vorticity")])


# Detection on cells

_NEAR = "o(d) AS (SELECT unnest(range(-2, 3)))"


def _square(field: str, n: int) -> str:
    """Cells of the field with the 24 cells around each, columns wrapped."""
    return f"""{field}, {_NEAR}, sq AS (
  SELECT c.t, c.i, c.j, c.lat, c.lon, c.v, n.v AS nv FROM g c CROSS JOIN o a CROSS JOIN o b
  LEFT JOIN g n ON n.t = c.t AND n.i = c.i + a.d AND n.j = (c.j + b.d + {n}) % {n})"""


def _extrema(field: str, rows: int, n: int, mode: str, threshold: float) -> str:
    s = "" if mode == "min" else "-"
    return f"""{_square(field, n)}, ex AS (
  SELECT t, i, j, any_value(lat) AS lat, any_value(lon) AS lon, any_value(v) AS v FROM sq WHERE i BETWEEN 2 AND {rows - 3}
  GROUP BY t, i, j HAVING count(*) FILTER (WHERE {s}nv < {s}v) = 0
  AND coalesce(list_sort(list({s}nv) FILTER (WHERE nv IS NOT NULL))[9], 'inf'::DOUBLE) - any_value({s}v) > {threshold})"""


@query(f"WITH {_square(G, 8)} SELECT t, i, j, min(nv) AS low FROM sq GROUP BY t, i, j")
def sliding_min(spark, sf):
    return stencil.sliding_min(fields.dense_cells(spark, sf), D, 5).select("t", "i", "j", "low")


@query(f"WITH {_extrema(G, 8, 8, 'min', 0.05)} SELECT t, i, j, v FROM ex")
def extrema_min(spark, sf):
    return stencil.extrema(fields.dense_cells(spark, sf), D, 5, 0.05).select("t", "i", "j", "v")


@query(f"WITH {_extrema(G, 8, 8, 'max', 0.05)} SELECT t, i, j, v FROM ex")
def extrema_max(spark, sf):
    return stencil.extrema(fields.dense_cells(spark, sf), D, 5, 0.05, "max").select("t", "i", "j", "v")


@query(f"WITH {_extrema(H, 10, 15, 'min', 0.0)} SELECT t, i, j, v FROM ex")
def extrema_sparse(spark, sf):
    return stencil.extrema(fields.sparse_cells(spark, sf), S).select("t", "i", "j", "v")


def _laplace(rows: int, n: int) -> str:
    return f"""lap AS (SELECT c.t, c.i, c.j, c.lat, c.lon, c.v,
  CASE WHEN count(n.v) < 4 THEN 'inf'::DOUBLE ELSE sum(n.v) - 4 * c.v END AS lap
  FROM ex c CROSS JOIN (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) q(a, b)
  LEFT JOIN g n ON n.t = c.t AND n.i = (c.i + a + {rows}) % {rows} AND n.j = (c.j + b + {n}) % {n} GROUP BY c.t, c.i, c.j, c.lat, c.lon, c.v)"""


@query(f"WITH {_extrema(G, 8, 8, 'min', 0.0)}, {_laplace(8, 8)} SELECT t, i, j, round(lap, 9) AS lap FROM lap")
def laplacian_masked(spark, sf):
    c = fields.dense_cells(spark, sf)
    return _round(stencil.laplacian(stencil.extrema(c, D), c, D).select("t", "i", "j", "lap"), "lap", digits=9)


def _dedup(n: int) -> str:
    return f"""dd AS (SELECT * FROM lap c WHERE lap <> 0 AND NOT EXISTS (SELECT 1 FROM lap o WHERE o.t = c.t AND o.lap <> 0 AND abs(o.i - c.i) <= 2
  AND least((o.j - c.j + {n}) % {n}, (c.j - o.j + {n}) % {n}) <= 2
  AND (abs(o.lap) > abs(c.lap) OR (abs(o.lap) = abs(c.lap) AND (o.i, o.j) < (c.i, c.j)))))"""


@query(f"WITH {_extrema(H, 10, 15, 'min', 0.0)}, {_laplace(10, 15)}, {_dedup(15)} SELECT t, i, j, v FROM dd")
def dedup_centers(spark, sf):
    c = fields.sparse_cells(spark, sf)
    return stencil.drop_duplicates(stencil.laplacian(stencil.extrema(c, S), c, S), S).select("t", "i", "j", "v")


_SIMPLE = f"WITH {_extrema(G, 8, 8, 'min', 0.0)}, {_laplace(8, 8)}, {_dedup(8)}"


@query(f"{_SIMPLE} SELECT t, (row_number() OVER (PARTITION BY t ORDER BY i, j) - 1)::INT AS c_idx, i, j, lat, lon, v FROM dd")
def simple_detect(spark, sf):
    return stencil.simple_detect(fields.dense_cells(spark, sf), D)


@query(f"{_SIMPLE} SELECT t, (row_number() OVER (PARTITION BY t ORDER BY i, j) - 1)::INT AS c_idx, lat, lon, v FROM dd")
def simple_detect_frames(spark, sf):
    frames = fields.to_frames(fields.dense_cells(spark, sf), D)
    return kernels.detect_frames(frames, (8, 8), -70 + 20.0 * _range(8), 45.0 * _range(8))


def _range(n: int):
    import numpy as np

    return np.arange(n)


@query(f"{_SIMPLE} SELECT t, count(d.v) AS n FROM (SELECT DISTINCT t FROM g) LEFT JOIN dd d USING (t) GROUP BY t")
def step_counts(spark, sf):
    c = fields.dense_cells(spark, sf)
    return stencil.steps(c, stencil.simple_detect(c, D))


_OBJECTS = f"""WITH RECURSIVE {G}, m AS MATERIALIZED (SELECT *, i * 8 + j AS p FROM g WHERE v >= 0.1), adj AS MATERIALIZED (
  SELECT a.t, a.p, b.p AS q FROM m a JOIN m b ON a.t = b.t AND abs(a.i - b.i) <= 1 AND least((a.j - b.j + 8) % 8, (b.j - a.j + 8) % 8) <= 1
), r(t, p, low) AS (SELECT t, p, p FROM m UNION SELECT adj.t, adj.q, r.low FROM r JOIN adj ON r.t = adj.t AND r.p = adj.p AND r.low < adj.q
), k AS (SELECT t, p, min(low) AS low FROM r GROUP BY t, p), ob AS (
  SELECT m.t, m.i, m.j, m.lat, m.lon, m.v, (dense_rank() OVER (PARTITION BY m.t ORDER BY k.low))::INT AS label FROM m JOIN k USING (t, p))"""


def _labelled(spark, sf):
    return objects.label_objects(stencil.threshold_mask(fields.dense_cells(spark, sf), 0.1, "max"), D)


@query(f"{_OBJECTS} SELECT t, i, j, label FROM ob")
def object_labels(spark, sf):
    return _labelled(spark, sf).select("t", "i", "j", "label")


@query(f"{_OBJECTS} SELECT t, label, count(*) AS n_cells FROM ob GROUP BY t, label")
def object_sizes(spark, sf):
    return stencil.object_sizes(_labelled(spark, sf))


_OBEX = f"""{_OBJECTS}, o(d) AS (SELECT unnest(range(-2, 3))), big AS (SELECT *, count(*) OVER (PARTITION BY t, label) AS n FROM ob), oe AS (
  SELECT c.t, c.i, c.j, any_value(c.lat) AS lat, any_value(c.lon) AS lon, any_value(c.v) AS v, any_value(c.label) AS label
  FROM big c CROSS JOIN o a CROSS JOIN o b JOIN g n ON n.t = c.t AND n.i = c.i + a.d AND n.j = (c.j + b.d + 8) % 8
  WHERE c.n >= 2 GROUP BY c.t, c.i, c.j HAVING max(n.v) <= any_value(c.v))"""


@query(f"{_OBEX} SELECT t, i, j, v, label FROM oe")
def object_extrema(spark, sf):
    return stencil.object_extrema(_labelled(spark, sf), fields.dense_cells(spark, sf), D, 5, "max", 2).select("t", "i", "j", "v", "label")


def _refined(source: str) -> str:
    pick = ", ".join(f"max(n.v) FILTER (WHERE a.d = {a} AND b.d = {b}) AS z{a + 1}{b + 1}" for a in (-1, 0, 1) for b in (-1, 0, 1))
    return f"""h(d) AS (SELECT unnest(range(-1, 2))), zz AS (
  SELECT c.t, c.i, c.j, c.lat, c.lon, c.v, {pick} FROM {source} c CROSS JOIN h a CROSS JOIN h b
  LEFT JOIN g n ON n.t = c.t AND n.i = c.i + a.d AND n.j = (c.j + b.d + 8) % 8 GROUP BY c.t, c.i, c.j, c.lat, c.lon, c.v
), z1 AS (SELECT *, (z12 - z10) / 2 AS fx, (z21 - z01) / 2 AS fy, z12 - 2 * z11 + z10 AS fxx, z21 - 2 * z11 + z01 AS fyy, (z22 - z20 - z02 + z00) / 4 AS fxy FROM zz
), z2 AS (SELECT *, fyy * fxx - fxy * fxy AS det FROM z1
), z3 AS (SELECT *, CASE WHEN i BETWEEN 1 AND 6 AND abs(det) >= 1e-10 THEN -(fyy * fx - fxy * fy) / det END AS dx,
  CASE WHEN i BETWEEN 1 AND 6 AND abs(det) >= 1e-10 THEN -(fxx * fy - fxy * fx) / det END AS dy FROM z2
), z4 AS (SELECT *, coalesce(abs(dx) <= 1 AND abs(dy) <= 1, false) AS ok FROM z3
), rf AS (SELECT t, i, j, v, round(CASE WHEN ok THEN lat + dy * 20 ELSE lat END, 6) AS rlat,
  round(CASE WHEN ok THEN (lon + dx * 45 + 360) % 360 ELSE lon END, 6) AS rlon, round(CASE WHEN ok THEN v + (fy * dy + fx * dx) / 2 ELSE v END, 6) AS rv FROM z4)"""


@query(f"{_SIMPLE}, {_refined('dd')} SELECT t, i, j, rlat, rlon, rv FROM rf")
def subgrid_refine(spark, sf):
    c = fields.dense_cells(spark, sf)
    out = stencil.refine(stencil.simple_detect(c, D).select("t", "i", "j", "lat", "lon", "v"), c, D)
    return _round(out.select("t", "i", "j", "rlat", "rlon", "rv"), "rlat", "rlon", "rv")


@query(f"{_OBEX}, {_refined('oe')} SELECT t, (row_number() OVER (PARTITION BY t ORDER BY i, j) - 1)::INT AS c_idx, i, j, rlat, rlon, rv FROM rf")
def object_detect(spark, sf):
    out = stencil.object_detect(fields.dense_cells(spark, sf), D, 5, 0.1, "max", 2)
    return _round(out.select("t", "c_idx", "i", "j", "rlat", "rlon", "rv"), "rlat", "rlon", "rv")


@query(f"{_OBEX}, {_refined('oe')} SELECT t, (row_number() OVER (PARTITION BY t ORDER BY i, j) - 1)::INT AS c_idx, rlat, rlon, rv FROM rf")
def object_detect_frames(spark, sf):
    frames = fields.to_frames(fields.dense_cells(spark, sf), D)
    out = kernels.object_frames(frames, (8, 8), -70 + 20.0 * _range(8), 45.0 * _range(8), 5, 0.1, "max", 2)
    return _round(out.select("t", "c_idx", F.col("lat").alias("rlat"), F.col("lon").alias("rlon"), F.col("v").alias("rv")), "rlat", "rlon", "rv")


def _maps(spark, sf):
    """Three embeddings in a row as one map of 192 pixels; what is missing of the last map is NaN."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.floor(F.col("vec_id") / 3).alias("t"), (F.col("vec_id") % 3).alias("k"), "embedding")
    one = lambda k: F.coalesce(F.max(F.when(F.col("k") == k, F.col("embedding").cast("array<double>"))), F.array_repeat(F.lit(float("nan")), 64))
    return e.groupBy("t").agg(F.concat(*[one(k) for k in range(3)]).alias("vals"))


_MAPS = """hm AS (SELECT vec_id // 3 AS t, ((vec_id % 3) * 64 + p - 1)::INT AS pixel, embedding[p]::DOUBLE AS v FROM embeddings, range(1, 65) r(p))"""


@query(f"""WITH {_rings(4)}, {_MAPS}
SELECT pixel::INT AS pixel, round(degrees(asin(z)), 6) + 0.0 AS lat, round(degrees(phi), 6) AS lon, round(avg(v), 6) + 0.0 AS mean_v FROM pix JOIN hm USING (pixel) GROUP BY pixel, z, phi""")
def healpix_pixels(spark, sf):
    """Mean value by pixel, with the pixel's centre."""
    theta, phi = healpix.pixel_angles(4)
    place = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(theta, phi, strict=True))], "pixel int, theta double, phi double")
    cells = _maps(spark, sf).select(F.posexplode("vals").alias("pixel", "v")).where(~F.isnan("v")).groupBy("pixel").agg(F.avg("v").alias("v"))
    cells = cells.join(F.broadcast(place), "pixel")  # 192 rows
    return cells.select("pixel", (F.round(90 - F.degrees("theta"), 6) + 0.0).alias("lat"), F.round(F.degrees("phi"), 6).alias("lon"), (F.round("v", 6) + 0.0).alias("mean_v"))


# Neighbours are pixels with a common corner; corners by the projection of the twelve faces.
_CORNERS = """fc(f, ring, turn) AS (SELECT f, (2 + f // 4)::INT, CASE WHEN f // 4 = 1 THEN 2 * (f % 4) ELSE 2 * (f % 4) + 1 END FROM range(12) r(f)
), fp AS (SELECT f, ring, turn, x, y FROM fc, range(4) a(x), range(4) b(y)
), pt AS (SELECT f, x, y, dx, dy, ring * 4 - (x + dx) - (y + dy) AS r, turn, x + dx - y - dy AS d FROM fp, (VALUES (0.5, 0.5), (0, 0), (0, 1), (1, 0), (1, 1)) c(dx, dy)
), pn AS (SELECT *, (CASE WHEN r < 4 THEN r WHEN r > 12 THEN 16 - r ELSE 4 END)::DOUBLE AS near FROM pt
), pz AS (SELECT *, CASE WHEN r < 4 THEN 1 - near * near / 48 WHEN r > 12 THEN near * near / 48 - 1 ELSE (8 - r) / 6.0::DOUBLE END AS z,
  CASE WHEN near > 0 THEN ((turn * near + d) / near * pi() / 4 + 4 * pi()) % (2 * pi()) ELSE 0 END AS phi FROM pn
), px AS (SELECT f, x, y, (row_number() OVER (ORDER BY round(r), phi) - 1)::INT AS pixel FROM pz WHERE dx = 0.5
), ck AS (SELECT pixel, round(sqrt(greatest(1 - z * z, 0)) * cos(phi), 6) + 0.0 AS a, round(sqrt(greatest(1 - z * z, 0)) * sin(phi), 6) + 0.0 AS b, round(z, 6) + 0.0 AS c FROM pz JOIN px USING (f, x, y) WHERE dx <> 0.5
), nb AS MATERIALIZED (SELECT DISTINCT k.pixel AS p, l.pixel AS q FROM ck k JOIN ck l USING (a, b, c) WHERE k.pixel <> l.pixel)"""


@query(f"WITH {_CORNERS}, {_MAPS} SELECT hm.t, hm.pixel, count(*) AS n, round(sum(o.v), 6) + 0.0 AS around FROM hm JOIN nb ON nb.p = hm.pixel JOIN hm o ON o.t = hm.t AND o.pixel = nb.q GROUP BY hm.t, hm.pixel")
def healpix_neighbours(spark, sf):
    """Number and sum of the values around each pixel."""
    near = healpix.neighbours(4)
    table = spark.createDataFrame([(int(p), int(q)) for p in range(192) for q in near[:, p] if q >= 0], "pixel int, q int")
    cells = _maps(spark, sf).select("t", F.posexplode("vals").alias("pixel", "v")).where(~F.isnan("v"))
    out = cells.select("t", "pixel").join(F.broadcast(table), "pixel").join(cells.select("t", F.col("pixel").alias("q"), "v"), ["t", "q"])  # 1,500 rows
    return out.groupBy("t", "pixel").agg(F.count("*").alias("n"), (F.round(F.sum("v"), 6) + 0.0).alias("around"))


@query(f"""WITH RECURSIVE {_CORNERS}, {_MAPS}, m AS MATERIALIZED (SELECT t, pixel, v FROM hm WHERE v >= 0.1
), ad AS MATERIALIZED (SELECT a.t, a.pixel AS p, b.pixel AS q FROM m a JOIN nb ON nb.p = a.pixel JOIN m b ON b.t = a.t AND b.pixel = nb.q
), r(t, p, low) AS (SELECT t, pixel, pixel FROM m UNION SELECT ad.t, ad.q, r.low FROM r JOIN ad ON r.t = ad.t AND r.p = ad.p AND r.low < ad.q
), k AS (SELECT t, p, min(low) AS low FROM r GROUP BY t, p
), ob AS (SELECT m.t, m.pixel, m.v, (dense_rank() OVER (PARTITION BY m.t ORDER BY k.low))::INT AS label FROM m JOIN k ON k.t = m.t AND k.p = m.pixel)
SELECT t, pixel, label, (row_number() OVER (PARTITION BY t ORDER BY pixel) - 1)::INT AS c_idx FROM ob
WHERE NOT EXISTS (SELECT 1 FROM nb JOIN hm o ON o.pixel = nb.q WHERE nb.p = ob.pixel AND o.t = ob.t AND o.v > ob.v)""")
def healpix_extrema(spark, sf):
    """Objects of the pixel graph and their extrema."""
    return healpix.healpix_detect(_maps(spark, sf), 0.1, "max").select("t", "pixel", "label", "c_idx")


@query()
def healpix_detect(spark, sf):
    return _round(healpix.healpix_detect(_maps(spark, sf), 0.1, "max").select("t", "c_idx", "pixel", "label", "lat", "lon", "v"), "lat", "lon", "v")


# Geodesy

_STEPS = f"{E}, s AS (SELECT *, lag(lat) OVER w AS la, lag(lon) OVER w AS lo FROM e WINDOW w AS (PARTITION BY track_id ORDER BY us, pos))"


def _lagged(spark, sf):
    return fields.track_points(spark, sf).withColumn("la", F.lag("lat").over(T.by_track())).withColumn("lo", F.lag("lon").over(T.by_track())).where("la is not null")


@query(f"WITH {_STEPS} SELECT pos, round({_arc('la', 'lo', 'lat', 'lon')} * {KM}, 3) AS km FROM s WHERE la IS NOT NULL")
def geod_dist_km(spark, sf):
    return _lagged(spark, sf).select("pos", F.round(geo.arc_km("la", "lo", "lat", "lon"), 3).alias("km"))


@query(f"""WITH {_STEPS} SELECT pos, round(2 * 6367 * asin(sqrt(least(1, pow(sin(radians(lat - la) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * pow(sin(radians(lon - lo) / 2), 2)))), 3) AS km FROM s WHERE la IS NOT NULL""")
def haversine_km(spark, sf):
    return _lagged(spark, sf).select("pos", F.round(geo.haversine_km("la", "lo", "lat", "lon"), 3).alias("km"))


@query(f"WITH {_STEPS} SELECT pos, round(radians(lat - la) * 6367, 6) AS ns, round(radians(lon - lo) * cos(radians((la + lat) / 2)) * 6367, 6) AS we FROM s WHERE la IS NOT NULL")
def lat_lon_dist(spark, sf):
    return _lagged(spark, sf).select("pos", F.round(geo.lat_km("la", "lat"), 6).alias("ns"), F.round(geo.lon_km("la", "lo", "lat", "lon"), 6).alias("we"))


@query(f"WITH {_STEPS} SELECT pos, round((lon - 400 + 720) % 360, 6) AS a, CASE WHEN lon > 180 THEN lon - 360 ELSE lon END AS b, round(least(abs(lon - lo), 360 - abs(lon - lo)), 6) AS c FROM s WHERE la IS NOT NULL")
def lon_normalize(spark, sf):
    return _lagged(spark, sf).select("pos", F.round(geo.lon360(F.col("lon") - 400), 6).alias("a"), geo.lon180("lon").alias("b"), F.round(geo.lon_gap("lon", "lo"), 6).alias("c"))


@query(f"""WITH {E}, a AS (SELECT *, 2 * {KM} * tan(radians(90 - lat) / 2) AS r FROM e WHERE lat > 5)
SELECT pos, round(r * sin(radians(lon)), 3) + 0.0 AS x, round(-r * cos(radians(lon)), 3) + 0.0 AS y FROM a""")
def stereo_forward(spark, sf):
    x, y = geo.latlon_to_stereo("lat", "lon")
    return fields.track_points(spark, sf).where("lat > 5").select("pos", (F.round(x, 3) + 0.0).alias("x"), (F.round(y, 3) + 0.0).alias("y"))


@query(f"""WITH {E}, a AS (SELECT pos, lat * 100 + 1 AS x, (lon - 180) * 50 + 1 AS y FROM e)
SELECT pos, round(90 - degrees(2 * atan(sqrt(x * x + y * y) / (2 * {KM}))), 6) AS lat, round((degrees(atan2(x, -y)) + 360) % 360, 6) AS lon FROM a""")
def stereo_inverse(spark, sf):
    lat, lon = geo.stereo_to_latlon(F.col("lat") * 100 + 1, (F.col("lon") - 180) * 50 + 1)
    return fields.track_points(spark, sf).select("pos", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@query(f"""WITH {E}, z(k, lo, hi, s, n, d) AS (VALUES (0, 30.0, 300.0, -90.0, -20.0, 6.5), (1, 0.0, 360.0, -20.0, 20.0, 3.0), (2, 300.0, 60.0, -90.0, 90.0, 9.0)), m AS (
  SELECT e.pos, z.k, z.d FROM e LEFT JOIN z ON lat BETWEEN s AND n AND CASE WHEN lo <= hi THEN lon BETWEEN lo AND hi ELSE lon >= lo OR lon <= hi END)
SELECT pos, coalesce(arg_min(d, k), 5.0)::DOUBLE AS dmax FROM m GROUP BY pos""")
def zone_dmax(spark, sf):
    zones = [[30.0, 300.0, -90.0, -20.0, 6.5], [0.0, 360.0, -20.0, 20.0, 3.0], [300.0, 60.0, -90.0, 90.0, 9.0]]
    return fields.track_points(spark, sf).select("pos", geo.zone_limit("lat", "lon", zones, 5.0).alias("dmax"))


@query(f"""WITH {E} SELECT pos, round(CASE WHEN d < 1 THEN 1.0 WHEN d < 2 THEN 1.0 - 0.7 * (d - 1) WHEN d < 5 THEN 0.3 - 0.2 / 3 * (d - 2) WHEN d < 8 THEN 0.1 - 0.1 / 3 * (d - 5) ELSE 0.0 END::DOUBLE, 6) AS phimax
FROM (SELECT pos, v / 50 AS d FROM e)""")
def adaptive_phimax(spark, sf):
    return fields.track_points(spark, sf).select("pos", F.round(geo.adaptive_limit(F.col("v") / 50, exchange.ADAPT, 0.5), 6).alias("phimax"))


_COST = f"""{E}, l AS (SELECT *, lag(lat) OVER w AS a0, lag(lon) OVER w AS o0, lead(lat) OVER w AS a2, lead(lon) OVER w AS o2 FROM e WINDOW w AS (PARTITION BY track_id ORDER BY us, pos)
), u AS (SELECT *, {_arc('a0', 'o0', 'lat', 'lon')} AS d1, {_arc('lat', 'lon', 'a2', 'o2')} AS d2, {_arc('a0', 'o0', 'a2', 'o2')} AS d3 FROM l WHERE a0 IS NOT NULL AND a2 IS NOT NULL
), ct AS (SELECT *, CASE WHEN d1 < 1e-12 AND d2 < 1e-12 THEN 0 WHEN d1 < 1e-12 OR d2 < 1e-12 THEN 0.8 ELSE
  greatest(0.1 * (1 - (cos(d1) * cos(d2) - cos(d3)) / (sin(d1) * sin(d2))) + 0.8 * (1 - 2 * sqrt(d1 * d2) / (d1 + d2)), 0) END AS cost FROM u)"""


def _costs(spark, sf):
    p = fields.track_points(spark, sf)
    for n, f in (("0", F.lag), ("2", F.lead)):
        p = p.withColumn(f"a{n}", f("lat").over(T.by_track())).withColumn(f"o{n}", f("lon").over(T.by_track()))
    p = p.where("a0 is not null and a2 is not null")
    return p.withColumn("cost", geo.smoothness_cost(("a0", "o0"), ("lat", "lon"), ("a2", "o2")))


# Where two points all but coincide, the angles at them hold few digits: there the cost is given to one.
_HARD = "sin(d1) <= 0.01 OR sin(d2) <= 0.01"


@query(f"WITH {_COST} SELECT pos, round(cost, CASE WHEN {_HARD} THEN 1 ELSE 4 END) AS cost FROM ct")
def smoothness_cost(spark, sf):
    hard = (F.sin(geo.arc("a0", "o0", "lat", "lon")) <= 0.01) | (F.sin(geo.arc("lat", "lon", "a2", "o2")) <= 0.01)
    return _costs(spark, sf).select("pos", F.when(hard, F.round("cost", 1)).otherwise(F.round("cost", 4)).alias("cost"))


@query(f"""WITH {_COST}, d AS (SELECT *, degrees(0.5 * (d1 + d2)) AS far FROM ct), b AS (
  SELECT e.track_id, e.pos, e.us, coalesce(cost > CASE WHEN far < 1 THEN 1 WHEN far < 2 THEN 1 - 0.7 * (far - 1) WHEN far < 5 THEN 0.3 - 0.2 / 3 * (far - 2) WHEN far < 8 THEN 0.1 - 0.1 / 3 * (far - 5) ELSE 0.05 END, false) AS brk FROM e LEFT JOIN d USING (pos))
SELECT pos, coalesce(sum(brk::INT) OVER (PARTITION BY track_id ORDER BY us, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS part FROM b""")
def smoothness_break(spark, sf):
    """Parts of tracks between points where the cost is above the limit for the distance."""
    cost, far = _costs(spark, sf), F.degrees((geo.arc("a0", "o0", "lat", "lon") + geo.arc("lat", "lon", "a2", "o2")) * 0.5)
    limit = geo.adaptive_limit(far, [[1.0, 2.0, 5.0, 8.0, 8.0], [1.0, 0.3, 0.1, 0.0, 0.05]], 0.5)
    p = fields.track_points(spark, sf).join(cost.select("pos", (F.col("cost") > limit).alias("brk")), "pos", "left")
    before = T.by_track().rowsBetween(Window.unboundedPreceding, -1)
    return p.select("pos", F.coalesce(F.sum(F.coalesce("brk", F.lit(False)).cast("int")).over(before), F.lit(0)).alias("part"))


# Linking

_CENTERS = f"{_SIMPLE}, c AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY i, j) - 1 AS k FROM dd)"
_PAIRS = f"""{_CENTERS}, pr AS (SELECT a.t + 1 AS step, a.k AS ka, b.k AS kb, a.lat AS la, a.lon AS oa, b.lat AS lb, b.lon AS ob,
  2 * 6367 * asin(sqrt(least(1, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) AS d
  FROM c a JOIN c b ON b.t = a.t + 1), nr AS (SELECT * FROM pr WHERE d < 2500)"""


def _numbered(spark, sf):
    return stencil.simple_detect(fields.dense_cells(spark, sf), D).select(F.col("t").alias("step"), F.col("c_idx").cast("long").alias("cid"), "lat", "lon")


@query(f"{_PAIRS} SELECT step, ka, kb, round(d, 3) AS km FROM nr")
def nearest_pairs(spark, sf):
    return linking.step_pairs(_numbered(spark, sf), 2500).select("step", F.col("a").alias("ka"), F.col("b").alias("kb"), F.round("d", 3).alias("km"))


@query(f"""{_PAIRS}, q AS (SELECT *, row_number() OVER (PARTITION BY step, ka ORDER BY round(d, 6), lb, ob) AS ra, row_number() OVER (PARTITION BY step, kb ORDER BY round(d, 6), la, oa) AS rb FROM nr)
SELECT step, ka, kb FROM q WHERE ra = 1 AND rb = 1""")
def mutual_nearest(spark, sf):
    pairs = linking.step_pairs(_numbered(spark, sf), 2500).withColumn("d", F.round("d", 6))
    return linking.mutual_nearest(pairs).select("step", F.col("a").alias("ka"), F.col("b").alias("kb"))


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


# Pairs of a step in order of distance, one after the other, with the ends taken so far.
_MATCH = f"""{_recursive(_PAIRS)}, fr AS (SELECT t, row_number() OVER (ORDER BY t) AS s, count(k) AS n FROM (SELECT DISTINCT t FROM g) LEFT JOIN c USING (t) GROUP BY t
), fo(s, t, alive, st, en, sp, go) AS (
  SELECT 0::BIGINT, NULL::BIGINT, false, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, false
  UNION ALL SELECT x.s, x.t, x.n > 0, CASE WHEN x.n > 0 AND NOT alive THEN coalesce(st, x.t) ELSE st END,
    CASE WHEN x.n = 0 THEN en WHEN NOT alive THEN coalesce(en, x.t) WHEN coalesce(x.t - sp > en, false) THEN x.t ELSE greatest(en, x.t) END,
    CASE WHEN x.n > 0 AND alive AND NOT coalesce(x.t - sp > en, false) AND sp IS NULL AND x.t <> st THEN x.t - st ELSE sp END,
    x.n > 0 AND alive AND NOT coalesce(x.t - sp > en, false)
  FROM fo JOIN fr x ON x.s = fo.s + 1
), rk AS MATERIALIZED (SELECT step, ka, kb, row_number() OVER (PARTITION BY step ORDER BY round(d, 6), la, oa, ka, lb, ob, kb) AS r FROM nr WHERE step IN (SELECT t FROM fo WHERE go)
), mt(step, r, ua, ub, ka, kb, hit) AS (
  SELECT DISTINCT step, 0::BIGINT, []::BIGINT[], []::BIGINT[], NULL::BIGINT, NULL::BIGINT, false FROM rk
  UNION ALL SELECT m.step, x.r, CASE WHEN list_contains(ua, x.ka) OR list_contains(ub, x.kb) THEN ua ELSE list_append(ua, x.ka) END,
    CASE WHEN list_contains(ua, x.ka) OR list_contains(ub, x.kb) THEN ub ELSE list_append(ub, x.kb) END, x.ka, x.kb, NOT (list_contains(ua, x.ka) OR list_contains(ub, x.kb))
  FROM mt m JOIN rk x ON x.step = m.step AND x.r = m.r + 1
), ed AS MATERIALIZED (SELECT step, ka, kb FROM mt WHERE hit)"""


@query(f"{_MATCH} SELECT step, ka, kb FROM ed")
def repeated_match(spark, sf):
    """Mutual nearest neighbours until no pair is left, of the steps that may be linked."""
    c = stencil.simple_detect(fields.dense_cells(spark, sf), D)
    counts = stencil.steps(fields.dense_cells(spark, sf), c)
    go = linking.linkable_steps([(r["t"], r["n"]) for r in counts.orderBy("t").collect()])  # one row a step
    steps = F.broadcast(spark.createDataFrame([(t,) for t in sorted(go)], "step long"))
    own = c.select(F.col("t").alias("step"), (F.col("t") * 100 + F.col("c_idx")).cast("long").alias("cid"), "lat", "lon")
    return linking.match(linking.step_pairs(own, 2500).join(steps, "step", "left_semi")).select("step", (F.col("a") % 100).alias("ka"), (F.col("b") % 100).alias("kb"))


_LINKED = f"""{_MATCH}, ch(t, k, rt, rk) AS (
  SELECT t, k, t, k FROM c WHERE NOT EXISTS (SELECT 1 FROM ed WHERE ed.step = c.t AND ed.kb = c.k)
  UNION ALL SELECT ed.step, ed.kb, ch.rt, ch.rk FROM ch JOIN ed ON ed.step = ch.t + 1 AND ed.ka = ch.k
), tr AS (SELECT ch.*, c.lat, c.lon, c.v FROM ch JOIN c ON c.t = ch.t AND c.k = ch.k
), tn AS (SELECT rt, rk, row_number() OVER (ORDER BY rt, lat, lon, rk) AS track_id FROM tr WHERE t = rt)"""


def _tracks(spark, sf) -> DataFrame:
    c = fields.dense_cells(spark, sf)
    return linking.link(stencil.simple_detect(c, D), c.select("t"), 2500).drop("i", "j")


@query(f"""{_LINKED} SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY t)::INT AS step, t, k::INT AS c_idx, lat, lon, v FROM tr JOIN tn USING (rt, rk)""")
def simple_link(spark, sf):
    return _tracks(spark, sf)


@query(f"""{_LINKED}, ps AS (SELECT track_id, t * 21600000000 AS us, lat, lon, v FROM tr JOIN tn USING (rt, rk)
), s1 AS (SELECT track_id, count(*) AS n_points, min(us) AS first_us, max(us) AS last_us, min(v) AS strength, (max(us) - min(us)) / 3600000000.0::DOUBLE AS duration_h,
  arg_min(lat, us) AS a1, arg_min(lon, us) AS o1, arg_max(lat, us) AS a2, arg_max(lon, us) AS o2 FROM ps GROUP BY track_id)
SELECT track_id, n_points, first_us, last_us, strength, duration_h, round({_arc('a1', 'o1', 'a2', 'o2')} * {KM}, 3) AS displacement_km FROM s1""")
def simple_link_stats(spark, sf):
    """Flagship: detect, link, and summarise every track."""
    points = _tracks(spark, sf).select("track_id", (F.col("t") * 21_600_000_000).alias("us"), F.col("t").alias("pos"), "lat", "lon", "v")
    return _round(T.statistics(points), "displacement_km", digits=3)


@query()
def exchange_link(spark, sf):
    c = fields.dense_cells(spark, sf)
    found = stencil.object_detect(c, D, 5, 0.1, "max")
    found = found.select("t", "c_idx", F.col("rlat").alias("lat"), F.col("rlon").alias("lon"), F.col("rv").alias("v"))
    rules = exchange.Rules(dmax=40.0, zones=[], adapt=[], phimax=0.9, min_lifetime=2)
    return _round(exchange.exchange_link(found, c.select("t"), rules, 50), "lat", "lon", "v")


@query()
def spliced_tracks(spark, sf):
    return T.splice(exchange_link(spark, sf))


# Tracks of events cut into chunks of five points that share a point with the next; each chunk numbers its own from 1.
_PIECES = f"""{E}, pp AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY us, pos) - 1 AS s, dense_rank() OVER (ORDER BY track_id) AS no FROM e)"""


def _pieces(spark, sf):
    p = fields.track_points(spark, sf).withColumn("s", F.row_number().over(T.by_track()) - 1)
    ids = p.select("track_id").distinct().select("track_id", F.row_number().over(Window.orderBy("track_id")).alias("no"))
    own = p.join(ids, "track_id").withColumn("chunk", F.floor(F.col("s") / 5).cast("int"))
    both = own.unionByName(own.where("s % 5 = 0 and s > 0").withColumn("chunk", F.col("chunk") - 1))
    number = F.dense_rank().over(Window.partitionBy("chunk").orderBy("no"))
    step = F.row_number().over(Window.partitionBy("chunk", "no").orderBy("s"))
    return both.select("chunk", number.cast("long").alias("track_id"), step.cast("int").alias("step"), F.col("us").alias("t"), "lat", "lon", "v")


@query(f"WITH {_PIECES} SELECT no AS track_id, us AS t, any_value(lat) AS lat, any_value(lon) AS lon FROM pp GROUP BY no, us")
def splice_pieces(spark, sf):
    """Pieces joined again at shared points: each whole track comes back, with its times once."""
    return T.splice(_pieces(spark, sf)).select("track_id", "t", "lat", "lon")


@query(f"WITH {_PIECES}, b AS (SELECT no, us, lat, lon FROM pp UNION ALL SELECT no, us, lat, lon FROM pp WHERE s % 5 = 0 AND s > 0) SELECT no AS track_id, us AS t, lat, lon FROM b")
def splice_pieces_at_first_points(spark, sf):
    """The same by first points only: shared points stay twice."""
    return T.splice(_pieces(spark, sf), overlap_aware=False).select("track_id", "t", "lat", "lon")


# Tracks

_STATS = f"""{E}, st AS (SELECT track_id, count(*) AS n_points, min(us) AS first_us, max(us) AS last_us, min(v) AS strength,
  (max(us) - min(us)) / 3600000000.0::DOUBLE AS duration_h,
  arg_min(lat, (us, pos)) AS a1, arg_min(lon, (us, pos)) AS o1, arg_max(lat, (us, pos)) AS a2, arg_max(lon, (us, pos)) AS o2 FROM e GROUP BY track_id
), sx AS (SELECT track_id, n_points, first_us, last_us, strength, duration_h, round({_arc('a1', 'o1', 'a2', 'o2')} * {KM}, 3) AS displacement_km FROM st)"""


def _stats(spark, sf, kind="msl"):
    return _round(T.statistics(fields.track_points(spark, sf), kind), "displacement_km", digits=3)


@query(f"WITH {_STATS} SELECT * FROM sx")
def track_stats(spark, sf):
    return _stats(spark, sf)


@query(f"WITH {E} SELECT count(DISTINCT track_id) AS n_tracks FROM e")
def track_count(spark, sf):
    return fields.track_points(spark, sf).agg(F.countDistinct("track_id").alias("n_tracks"))


@query(f"""WITH {_STATS} SELECT min(first_us) AS min_us, max(last_us) AS max_us, max(duration_h) AS max_duration, max(displacement_km) AS max_displacement, count(*) AS n_tracks,
  (SELECT min(v) FROM e) AS min_strength, (SELECT max(v) FROM e) AS max_strength FROM sx""")
def track_metadata(spark, sf):
    return _round(T.metadata(fields.track_points(spark, sf)), "max_displacement", digits=3)


@query(f"WITH {E} SELECT CASE WHEN median(v) > 500 OR median(v) < -100 THEN 'msl' ELSE 'vo' END AS kind FROM e")
def infer_type(spark, sf):
    return T.infer_kind(fields.track_points(spark, sf))


@query(f"WITH {E} SELECT pos, CASE WHEN (SELECT max(abs(v * 2)) FROM e) > 500 THEN v * 2 / 100 ELSE v * 2 END AS v FROM e")
def unit_scale(spark, sf):
    return T.scale_pressure(fields.track_points(spark, sf).withColumn("v", F.col("v") * 2)).select("pos", "v")


@query(f"""WITH {E}, f AS (SELECT track_id, min(us) AS u0, arg_min(lat, (us, pos)) AS a0, arg_min(lon, (us, pos)) AS o0 FROM e GROUP BY track_id
), k AS (SELECT track_id, row_number() OVER (ORDER BY u0, a0, o0, track_id)::INT AS rank FROM f)
SELECT e.pos, k.rank, row_number() OVER (PARTITION BY track_id ORDER BY us, e.pos)::INT AS step FROM e JOIN k USING (track_id)""")
def sort_tracks(spark, sf):
    return T.sort_tracks(fields.track_points(spark, sf)).select("pos", "rank", "step")


@query(f"""WITH {E}, n AS (SELECT track_id, count(*) AS n FROM e GROUP BY track_id HAVING count(*) >= 65), k AS (SELECT track_id, row_number() OVER (ORDER BY track_id) AS new_id FROM n)
SELECT new_id, pos FROM e JOIN k USING (track_id)""")
def min_lifetime(spark, sf):
    return T.min_lifetime(fields.track_points(spark, sf), 65).select("new_id", "pos")


@query(f"WITH {_STATS} SELECT pos FROM e WHERE track_id IN (SELECT track_id FROM sx WHERE strength <= 5 AND duration_h >= 600 AND displacement_km >= 5000)")
def eligible_tracks(spark, sf):
    return T.eligible(fields.track_points(spark, sf), "msl", 5, 600, 5000).select("pos")


@query(f"""WITH {E}, b AS (SELECT *, (abs(lon - lag(lon) OVER (PARTITION BY track_id ORDER BY us, pos)) > 180)::INT AS jump FROM e
), s AS (SELECT *, coalesce(sum(jump) OVER (PARTITION BY track_id ORDER BY us, pos), 0)::BIGINT AS segment FROM b)
SELECT pos, segment, round((v + lead(v) OVER (PARTITION BY track_id, segment ORDER BY us, pos)) / 2, 6) AS mean_v FROM s""")
def antimeridian_segments(spark, sf):
    return _round(T.segments(fields.track_points(spark, sf)).select("pos", "segment", "mean_v"), "mean_v")


@query(f"""WITH {E}, b AS (SELECT *, (us - lag(us) OVER (PARTITION BY track_id ORDER BY us, pos) > 21600000000 * 3)::INT AS gap FROM e)
SELECT pos, coalesce(sum(gap) OVER (PARTITION BY track_id ORDER BY us, pos), 0)::BIGINT AS part FROM b""")
def gap_islands(spark, sf):
    return T.missing_runs(fields.track_points(spark, sf), 21_600_000_000, 2).select("pos", "part")


@query(f"""WITH {E}, l AS (SELECT max(track_id) AS m FROM e WHERE track_id < 50)
SELECT track_id, pos, v, NULL::DOUBLE AS w FROM e WHERE track_id < 50 UNION ALL SELECT track_id + (SELECT m FROM l), pos, NULL, v FROM e WHERE track_id >= 50""")
def union_missing_vars(spark, sf):
    p = fields.track_points(spark, sf)
    a, b = p.where("track_id < 50").select("track_id", "pos", "v"), p.where("track_id >= 50").select("track_id", "pos", F.col("v").alias("w"))
    return T.union(a, b).select("track_id", "pos", "v", "w")


@query(f"WITH {E} SELECT CASE WHEN track_id = 7 THEN 7 ELSE track_id END AS track_id, pos FROM e WHERE track_id <> 7 UNION ALL SELECT 7, pos FROM e WHERE track_id = 8")
def replace_track(spark, sf):
    p = fields.track_points(spark, sf)
    return T.replace_track(p, 7, p.where("track_id = 8")).select("track_id", "pos")


# The same tracks changed: some points a little or far off, some values or times, some last points missing.
_OTHER = f"""{E}, n AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY us DESC, pos DESC) AS back FROM e
), o AS (SELECT track_id, pos, CASE WHEN track_id % 13 = 5 THEN us + 1 ELSE us END AS us, CASE WHEN pos % 11 = 0 AND track_id % 13 = 1 THEN lat + 0.00005 WHEN pos % 11 = 0 AND track_id % 13 = 2 THEN lat + 0.01 ELSE lat END AS lat,
  CASE WHEN pos % 7 = 0 AND track_id % 13 = 3 THEN (lon + 359.99995) % 360 ELSE lon END AS lon, CASE WHEN pos % 5 = 0 AND track_id % 13 = 4 THEN v + 1 ELSE v END AS v FROM n WHERE NOT (track_id % 13 = 6 AND back = 1) AND NOT (track_id % 13 = 7 AND back <= 2))"""


def _other(points: DataFrame) -> DataFrame:
    back = F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("us"), F.desc("pos")))
    kind, every = F.col("track_id") % 13, lambda n: F.col("pos") % n == 0
    out = points.withColumn("back", back).where(~((kind == 6) & (F.col("back") == 1)) & ~((kind == 7) & (F.col("back") <= 2))).drop("back")
    return out.withColumns({
        "us": F.when(kind == 5, F.col("us") + 1).otherwise(F.col("us")),
        "lat": F.when(every(11) & (kind == 1), F.col("lat") + 0.00005).when(every(11) & (kind == 2), F.col("lat") + 0.01).otherwise(F.col("lat")),
        "lon": F.when(every(7) & (kind == 3), (F.col("lon") + 359.99995) % 360).otherwise(F.col("lon")),
        "v": F.when(every(5) & (kind == 4), F.col("v") + 1).otherwise(F.col("v")),
    })


@query(f"""WITH {_OTHER}, x AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY us, pos) AS s FROM e), y AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY us, pos) AS s FROM o
), j AS (SELECT coalesce(x.track_id, y.track_id) AS track_id, coalesce(x.us = y.us AND x.lat = y.lat AND x.lon = y.lon AND x.v = y.v, false) AS same FROM x FULL JOIN y ON x.track_id = y.track_id AND x.s = y.s)
SELECT track_id, bool_and(same) AS equal FROM j GROUP BY track_id""")
def track_equality(spark, sf):
    p = fields.track_points(spark, sf)
    return T.differences(p, _other(p))


@query(f"""WITH {_OTHER}, a AS (SELECT track_id, min(us) AS u0, count(*) AS n FROM e GROUP BY track_id), b AS (SELECT track_id, min(us) AS u0, count(*) AS n FROM o GROUP BY track_id
), cd AS (SELECT a.track_id AS a, b.track_id AS b, a.n AS na, b.n AS nb FROM a JOIN b USING (u0) WHERE abs(a.n - b.n) <= 1
), sh AS (SELECT cd.a, cd.b, na, nb, count(*) AS n, bool_and(abs(e.lat - o.lat) <= 1e-4 AND least(abs(e.lon - o.lon), 360 - abs(e.lon - o.lon)) <= 1e-4 AND abs(e.v - o.v) <= 1e-4) AS ok
  FROM cd JOIN e ON e.track_id = cd.a JOIN o ON o.track_id = cd.b AND o.us = e.us GROUP BY cd.a, cd.b, na, nb)
SELECT a, min(b) AS b FROM sh WHERE ok AND n >= least(na, nb) - 1 GROUP BY a""")
def compare_tracks(spark, sf):
    p = fields.track_points(spark, sf)
    return T.compare(p, _other(p), length_tol=1)


@query(f"""WITH {E}, n AS (SELECT track_id, count(*) AS n FROM e GROUP BY track_id)
SELECT track_id, (coalesce(sum(n) OVER (ORDER BY track_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + row_number() OVER (ORDER BY track_id) - 1)::BIGINT AS start,
  (sum(n) OVER (ORDER BY track_id) + row_number() OVER (ORDER BY track_id) - 2)::BIGINT AS "end" FROM n""")
def json_offsets(spark, sf):
    return formats.json_offsets(fields.track_points(spark, sf))


_NO = f"""{E}, n AS (SELECT track_id, count(*) AS n, row_number() OVER (ORDER BY track_id) AS no FROM e GROUP BY track_id
), p AS (SELECT e.*, n.n, n.no, row_number() OVER (PARTITION BY track_id ORDER BY us, pos) AS step FROM e JOIN n USING (track_id))"""


@query(f"""WITH {_NO}
SELECT 0 AS no, 0 AS step, '99 00,CycloneNo,StepNo,DateI10,Year,Month,Day,Time,LongE,LatN,MSL' AS line
UNION ALL SELECT no::INT, 0, '90 ' || no || ' ' || n FROM n
UNION ALL SELECT no::INT, step::INT, printf('00 %d %d %s %.2f %.2f %.6f', no, step, strftime(make_timestamp(us), '%Y%m%d%H %Y %m %d %H'), CASE WHEN lon > 180 THEN lon - 360 ELSE lon END, lat, v * 0.01) FROM p""")
def imilast_lines(spark, sf):
    return formats.imilast_lines(fields.track_points(spark, sf))


@query(f"""WITH {_NO}, c AS (SELECT count(*) AS n FROM n)
SELECT 0 AS no, -3 AS step, '0' AS line UNION ALL SELECT 0, -2, '0 0' UNION ALL SELECT 0, -1, printf('TRACK_NUM %10d ADD_FLD    0   0 &', n) FROM c
UNION ALL SELECT no::INT, -1, printf('TRACK_ID %2d', no) FROM n UNION ALL SELECT no::INT, 0, printf('POINT_NUM %3d', n) FROM n
UNION ALL SELECT no::INT, step::INT, printf('%d %10.6f %10.6f %12.6e', step, lon, lat, v) FROM p""")
def tdump_lines(spark, sf):
    return formats.tdump_lines(fields.track_points(spark, sf))


@query(f"""WITH {E} SELECT user_id % 150 AS u, round(avg(abs(e.lat)), 6) AS mean_lat, round(corr(e.lat, e.v), 6) AS r, round(sqrt(avg(pow(e.lat - e.v, 2))), 6) AS rmse
FROM e JOIN events x ON x.event_id = e.pos GROUP BY 1""")
def field_agreement(spark, sf):
    p = fields.track_points(spark, sf)
    return p.groupBy((F.col("track_id") % 150).alias("u")).agg(F.round(F.avg(F.abs("lat")), 6).alias("mean_lat"), F.round(F.corr("lat", "v"), 6).alias("r"), F.round(F.sqrt(F.avg(F.pow(F.col("lat") - F.col("v"), 2))), 6).alias("rmse"))
