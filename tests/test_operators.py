"""Hand-computed cases, analytic fields, and agreement of kernels, orders and partitions."""

import json

import numpy as np
import pandas as pd
import pytest

from gridtrack.operators import exchange, healpix, kernels, linking, objects, spectral, stencil
from gridtrack.operators import tracks as T
from gridtrack.sources import fields, formats, gridded


def test_extrema_of_a_pit_and_a_plateau():
    f = np.full((10, 10), 100.0)
    f[5, 5] = 90
    assert np.argwhere(kernels.extrema(f, 3, 5)).tolist() == [[5, 5]]
    assert not kernels.extrema(f, 3, 5, "max").any()
    f[5, 6] = 90
    assert kernels.extrema(f, 3, 5).sum() == 2
    with pytest.raises(ValueError):
        kernels.extrema(f, 4)


def test_simple_detection_of_one_low():
    f = np.full((7, 7), 1000.0)
    f[3, 3] = 950
    assert [x.tolist() for x in kernels.centers(f)] == [[3], [3]]


def test_refined_peak():
    i, j = np.mgrid[0:7, 0:7]
    f = 1000.0 - (i - 3) ** 2 - (j - 3.2) ** 2
    a, b, _ = kernels.object_extrema(f, 5, 0.0, "max", 1)
    lat, lon, v = kernels.refine(f, a, b, np.arange(7.0), np.arange(7.0))
    best = v.argmax()
    assert (round(lat[best], 6), round(lon[best], 6), round(v[best], 6)) == (3.0, 3.2, 1000.0)


def test_kernels_agree_with_relations(spark, sf):
    cells = fields.sparse_cells(spark, sf)
    frames = fields.to_frames(cells, fields.SPARSE)
    lat, lon = -67.5 + 15.0 * np.arange(10), 24.0 * np.arange(15)
    for mode in ("min", "max"):
        a = stencil.simple_detect(cells, fields.SPARSE, mode=mode).select("t", "c_idx", "lat", "lon", "v").toPandas()
        b = kernels.detect_frames(frames, (10, 15), lat, lon, mode=mode).toPandas()
        key = ["t", "c_idx"]
        pd.testing.assert_frame_equal(a.sort_values(key).reset_index(drop=True), b.sort_values(key).reset_index(drop=True), check_dtype=False)


def test_labels_wrap_and_are_in_order():
    m = np.zeros((4, 6), bool)
    m[0, 0] = m[0, 5] = m[1, 4] = m[3, 2] = True
    assert objects.label_mask(m).tolist()[0] == [1, 0, 0, 0, 0, 1]
    assert objects.label_mask(m)[1, 4] == 1 and objects.label_mask(m)[3, 2] == 2
    spiral = np.random.default_rng(1).random((40, 40)) < 0.6
    labels = objects.label_mask(spiral)
    for d in ((0, 1), (1, 0), (1, 1), (1, -1)):
        a, b = (labels[: 40 - d[0]], np.roll(labels, -d[1], 1)[d[0] :])
        assert ((a == b) | (a == 0) | (b == 0)).all()


def _sequential(frames, within):
    """The rule as written: repeated mutual nearest neighbours, step after step."""
    tails, out, next_id = [], [], 1
    for lat, lon in frames:
        order = np.lexsort((lon, lat))
        pts = [(lat[k], lon[k]) for k in order]
        ids = [None] * len(pts)
        if tails and pts:
            tails.sort(key=lambda x: x[:2])
            a = np.radians([x[0] for x in tails])[:, None]
            b = np.radians([p[0] for p in pts])[None]
            dl = np.radians(np.array([p[1] for p in pts])[None] - np.array([x[1] for x in tails])[:, None])
            d = 2 * 6367 * np.arcsin(np.sqrt(np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(dl / 2) ** 2))
            d[d >= within] = np.inf
            while np.isfinite(d).any():
                for c in range(len(pts)):
                    r = d[:, c].argmin()
                    if np.isfinite(d[r, c]) and d[r].argmin() == c:
                        ids[c] = tails[r][2]
                        d[r], d[:, c] = np.inf, np.inf
        for c in range(len(pts)):
            if ids[c] is None:
                ids[c], next_id = next_id, next_id + 1
        tails = [(*p, i) for p, i in zip(pts, ids, strict=True)]
        out.append(sorted(zip(ids, pts, strict=True)))
    return out


def test_parallel_linking_is_the_sequential_one(spark):
    rng = np.random.default_rng(3)
    frames = [(rng.uniform(-60, 60, n), rng.uniform(0, 360, n)) for n in rng.integers(5, 20, 12)]
    rows = [(t, k, float(a), float(b), 0.0) for t, (lat, lon) in enumerate(frames) for k, (a, b) in enumerate(zip(lat, lon, strict=True))]
    c = spark.createDataFrame(rows, "t long, c_idx int, lat double, lon double, v double")
    s = spark.createDataFrame([(t, len(f[0])) for t, f in enumerate(frames)], "t long, n long")
    want = [(t, i, p) for t, step in enumerate(_sequential(frames, 3000)) for i, p in step]
    for parts in (1, 5):
        got = linking.link(c.repartition(parts), s, 3000).collect()
        assert sorted((r["t"], r["track_id"], (r["lat"], r["lon"])) for r in got) == sorted(want)


def test_gap_rule():
    assert linking.linkable_steps([(0, 1), (6, 2), (12, 0), (18, 1), (24, 1)]) == {6}  # spacing 6, end 6: 24 is too far
    assert linking.linkable_steps([(0, 1), (6, 1), (12, 1)]) == {6, 12}


def _movers(*paths):
    return [(np.array([p[k][0] for p in paths], float), np.array([p[k][1] for p in paths], float)) for k in range(len(paths[0]))]


def test_exchange_follows_straight_movers():
    rules = exchange.Rules(zones=[], adapt=[], min_lifetime=1)
    ex = exchange.Exchange(_movers([(0, 0), (0, 2), (0, 4)], [(10, 0), (10, 2), (10, 4)]), rules)
    assert [[f for _, f in x] for x in ex.tracks(ex.run())] == [[0, 2, 4], [1, 3, 5]]


def test_exchange_query_takes_every_frame(spark, tmp_path):
    from gridtrack.plans import catalog

    rng, n, chunk, overlap = np.random.default_rng(5), 260, 50, 3
    rows = [(2 * k, rng.normal(0, 0.15, 64).astype("float32").tolist()) for k in range(n)]  # vec_id has gaps, and goes far beyond 199
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    cells = fields.dense_cells(spark, str(tmp_path))
    points = stencil.object_detect(cells, fields.DENSE, 5, 0.1, "max").orderBy("t", "c_idx").collect()
    rules, want, start, number = exchange.Rules(dmax=40.0, zones=[], adapt=[], phimax=0.9, min_lifetime=2), [], 0, 0
    while True:  # chunk after chunk, in one process
        stop = min(start + chunk, n)
        own = [[p for p in points if p["t"] == 2 * k] for k in range(start, stop)]
        flat = [p for f in own for p in f]
        ex = exchange.Exchange([(np.array([p["rlat"] for p in f], float), np.array([p["rlon"] for p in f], float)) for f in own], rules)
        found = [x for x in ex.tracks(ex.run()) if len(x) >= 2]
        want += [(number, i, s, flat[f]["t"], flat[f]["rlat"], flat[f]["rlon"]) for i, x in enumerate(found, 1) for s, (_, f) in enumerate(x, 1)]
        if stop == n:
            break
        start, number = stop - overlap, number + 1
    got = sorted(tuple(r)[:6] for r in catalog.exchange_link(spark, str(tmp_path)).collect())
    assert [r[:4] for r in got] == [w[:4] for w in sorted(want)]
    assert np.array([r[4:] for r in got]) == pytest.approx(np.array([w[4:] for w in sorted(want)]), abs=2e-6)
    assert catalog.spliced_tracks(spark, str(tmp_path)).agg({"t": "max"}).first()[0] == max(w[3] for w in want)


def test_exchange_costs():
    u = exchange.unit_vectors
    one = lambda *p: exchange.triplet_cost(*(u(np.array([a]), np.array([b])) for a, b in p[:3]), *p[3:])[0]
    assert one((0, 0), (0, 1), (0, 2), 0.2, 0.8) == pytest.approx(0, abs=1e-9)
    assert one((0, 0), (0, 1), (1, 1), 1, 0) == pytest.approx(0.5, abs=1e-4)
    assert one((0, 0), (0, 1), (0, 11), 0, 1) == pytest.approx(1 - 2 * 10**0.5 / 11)
    assert exchange.adaptive_limit(np.array([0.5, 10, 2, 1.5]), exchange.ADAPT, 0).tolist() == pytest.approx([1, 0, 0.3, 0.65])
    assert exchange.zone_limits(np.array([0.0, 45.0]), np.array([5.0, 5.0]), exchange.ZONES, 5).tolist() == [3.0, 6.5]


def test_spectral_filter_keeps_and_drops_harmonics():
    theta, lon = spectral.colatitudes(73), np.arange(144) * 2 * np.pi / 144
    for l, m in ((4, 2), (5, 5), (20, 7), (42, 42), (43, 3)):  # noqa: E741
        y = spectral.legendre(m, l, theta)[-1][:, None] * np.cos(m * lon)
        assert np.allclose(spectral.filter_frame(y), y if 5 <= l <= 42 else 0, atol=1e-11)
    with pytest.raises(ValueError, match="Unsupported shape"):
        spectral.filter_frame(np.random.default_rng(0).random((10, 15)))


def test_wind_derivatives_of_rotation_and_of_a_harmonic():
    theta, lon = spectral.colatitudes(73), np.arange(144) * 2 * np.pi / 144
    u = 10 * np.sin(theta)[:, None] * np.ones(144)
    div, vort = spectral.wind_derivatives(u, 0 * u)
    assert np.abs(div).max() < 1e-12 and np.allclose(vort, 20 * np.cos(theta)[:, None] / spectral.EARTH_M, atol=1e-15)


def test_regrids():
    theta, lon = spectral.colatitudes(73), np.arange(144) * 2 * np.pi / 144
    f = np.sin(2 * lon) * np.sin(theta)[:, None]
    assert np.abs(spectral.regrid(f, 73, 144, 42) - f).max() < 2e-2
    assert spectral.to_polar_stereo(f, extent=(-1000, 1000, -1000, 1000), lmax=20).shape == (21, 21)
    z = np.cos(theta)[:, None] * np.ones(144)
    assert np.allclose(spectral.to_healpix(z, 8, 20), np.cos(healpix.pixel_angles(8)[0]))


def test_healpix_graph():
    near = healpix.neighbours(8)
    assert (near < 0).sum() == 24 and ((near < 0).sum(0) <= 1).all()
    pairs = {(p, q) for s in range(8) for p, q in enumerate(near[s]) if q >= 0}
    assert all((q, p) in pairs for p, q in pairs)
    theta, phi = healpix.pixel_angles(1)
    assert np.degrees(phi[:8]).round(6).tolist() == [45, 135, 225, 315, 0, 90, 180, 270]
    with pytest.raises(ValueError):
        healpix.nside_of(100)


def test_healpix_objects_and_refinement():
    near = healpix.neighbours(4)
    v = np.zeros(192)
    v[[10, 11, 50]] = 100
    labels = healpix.label_pixels(v >= 50, near)
    assert labels[10] == labels[11] != labels[50] and labels.max() == 2
    v[[10, 11, 12]] = 100, 90, 80
    assert healpix.object_extrema(v, healpix.label_pixels(v >= 95, near), near, "max").tolist()[0] == 10
    theta, phi = healpix.pixel_angles(16)
    lat, lon = 90 - np.degrees(theta), np.degrees(phi)
    d2 = (lat - lat[100] - 0.3) ** 2 + ((lon - lon[100]) * np.cos(np.radians(lat[100]))) ** 2
    a, _, z = healpix.refine_pixel(100 - d2, 100, healpix.neighbours(16), lat, lon)
    assert abs(a - lat[100] - 0.3) < 0.1 and z > 99.9


def test_track_files_round_trip(spark, sf, tmp_path):
    p = fields.track_points(spark, sf).where("track_id < 20")
    n = p.count()
    formats.write(p, str(tmp_path / "a.txt"), "vo", "imilast")
    assert formats.read_imilast(spark, str(tmp_path / "a.txt")).count() == n
    formats.write(p, str(tmp_path / "a.json"), "vo", "json")
    back = formats.read_json(spark, str(tmp_path / "a.json"))
    assert back.count() == n
    a, b = (T.statistics(x, "vo").orderBy("track_id").toPandas() for x in (p, back))
    assert np.allclose(a["displacement_km"], b["displacement_km"]) and np.allclose(a["strength"], b["strength"])
    formats.write(p, str(tmp_path / "a.html"), "vo", "html", split=True)
    assert (tmp_path / "a.tracks.js").exists()
    formats.write(p, str(tmp_path / "a.tdump"), "vo", "hodges")
    assert (tmp_path / "a.tdump").read_text().startswith("0\n0 0\nTRACK_NUM")
    assert formats.to_json(p.where("false")) == {"points": {}, "tracks": [], "metadata": {}}
    with pytest.raises(ValueError):
        formats.write(p, str(tmp_path / "a"), "vo", "nothing")


def test_imilast_times_and_units(spark):
    text = ["99 00,CycloneNo,StepNo,DateI10,Year,Month,Day,Time,LongE,LatN,MSL", "90 1 3", "00 1 1 2025120100 2025 12 01 00 -170.00 10.00 1000.0", "", "00 1 2 1764568800 2025 12 01 06 20.00 11.00 99000", "00 1 3 2025-12-01T12:00:00 2025 12 01 12 20.00 11.00 990.0"]
    p = formats.parse_imilast(spark.createDataFrame([(x,) for x in text], "value string")).orderBy("pos").collect()
    assert [r["us"] // 3_600_000_000 % 24 for r in p] == [0, 6, 12]
    assert [r["v"] for r in p] == [100_000.0, 99_000.0, 99_000.0]
    point = spark.createDataFrame([(1, 1, None, 10.0, 190.0, 1000.0)], "track_id long, pos long, us long, lat double, lon double, v double")
    lines = [r["line"] for r in formats.imilast_lines(point, "x").orderBy("no", "step").collect()]
    assert lines[1:] == ["90 1 1", "00 1 1 0000000000 0 00 00 00 -170.00 10.00 1000.000000"]


def test_gridded_source_and_trackers(spark, tmp_path):
    from gridtrack.api import ExchangeTracker, SimpleTracker

    lat, lon, hours = np.linspace(90, -90, 37), np.arange(72) * 5.0, np.arange(6) * 6.0
    data = np.stack([101_000 - 2000 * np.exp(-((lat[:, None] - 40) ** 2 + (lon[None] - 100 - 3 * t) ** 2) / 60) for t in range(6)])
    path = str(tmp_path / "msl.nc")
    gridded.write_netcdf3(path, lat, lon, hours, "msl", data)
    df = gridded.register(spark).read.format("gridded").option("var", "slp").option("frames", 2).load(path)
    assert df.count() == 6 and df.rdd.getNumPartitions() == 3
    assert np.allclose(df.orderBy("t").first()["vals"], data[0].ravel())
    tracks = SimpleTracker().track(spark, path, "msl", filter=False, threshold=10).toPandas()
    assert len(tracks) == 6 and tracks["track_id"].nunique() == 1
    refined = ExchangeTracker(zones=[], adapt=[]).track(spark, path, "msl", filter=False, threshold=99_800.0, chunk=4, overlap=2).toPandas()
    assert len(refined) == 6 and refined["track_id"].nunique() == 1
    with pytest.raises(KeyError):
        gridded.variable(gridded.open_file(path), "vo")
    with pytest.raises(ValueError, match="cfgrib"):
        gridded.open_file("x.grib")


def test_zarr(tmp_path):
    import zlib

    a = np.arange(24.0).reshape(2, 3, 4)
    for name, x, chunks in (("msl", a, [1, 3, 4]), ("time", np.array([0.0, 6.0]), [2])):
        d = tmp_path / "x.zarr" / name
        d.mkdir(parents=True)
        (d / ".zarray").write_text(json.dumps({"shape": list(x.shape), "chunks": chunks, "dtype": "<f8", "compressor": {"id": "zlib"}, "fill_value": 0, "filters": None, "order": "C"}))
        (d / ".zattrs").write_text(json.dumps({"units": "hours since 2020-01-01"}))
        for k in range(x.shape[0] // chunks[0]):
            (d / ".".join([str(k)] + ["0"] * (x.ndim - 1))).write_bytes(zlib.compress(np.ascontiguousarray(x[k * chunks[0] : (k + 1) * chunks[0]]).tobytes()))
    z = gridded.open_file(str(tmp_path / "x.zarr"))
    assert np.array_equal(z.read("msl", 1, 2), a[1:]) and gridded.times(z)[1].hour == 6


def test_zone_and_adapt_files(tmp_path):
    (tmp_path / "z").write_text("1\n0 360 -20 20 3.0\n")
    (tmp_path / "a").write_text("1 1\n2 .3\n5 .1\n8 0\n")
    assert gridded.read_zones(str(tmp_path / "z")) == [[0, 360, -20, 20, 3.0]]
    assert gridded.read_adapt(str(tmp_path / "a")) == [[1, 2, 5, 8], [1, 0.3, 0.1, 0]]


def test_command_line(spark, tmp_path):
    from gridtrack import cli

    a = cli.parser().parse_args("track -i a -v msl -o b --zones [[0,360,-90,90,4]] --dmax 3".split())
    assert cli.rules_of(a).zones == [[0, 360, -90, 90, 4]] and cli.rules_of(a).dmax == 3 and a.chunk_size == 60
    assert cli.wave_range("5-42") == (5, 42) and cli.wave_range("42") == (0, 42)
    with pytest.warns(UserWarning):
        assert cli.wave_range("x") == (5, 42)


def test_streaming_linker(spark, tmp_path):
    from gridtrack.streaming.linker import link_stream

    rows = [("a", t, 10.0 + k * 20, 3.0 * t, 1.0) for t in range(4) for k in range(2)] + [("b", 0, 0.0, 0.0, 1.0), ("b", 2, 0.0, 0.0, 1.0)]
    schema = "dataset string, t long, lat double, lon double, v double"
    for k in (0, 1):
        spark.createDataFrame([r for r in rows if r[1] // 2 == k], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = link_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("linked").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("linked").toPandas()
    assert len(got) == 10 and got[got.dataset == "a"].groupby("lat")["track_id"].nunique().eq(1).all()
    assert got[got.dataset == "b"]["track_id"].nunique() == 2


def _dense_swap(ex, m, k, ahead):
    """The best exchange of two rows' points, from all pairs of rows."""
    to, best = k + 1 if ahead else k - 1, (1e-8, None)

    def three(row, point):
        return (m[row, k - 1], m[row, k], point) if ahead else (point, m[row, k], m[row, k + 1])

    def allowed(row, point):
        new = m[row : row + 1].copy()
        new[0, to] = point
        ends = [np.array([x]) for x in three(row, point)]
        return ex.gaps_ok(new)[0] and ex.near(m[row, k], point) and ex.smooth(*ends, ex.cost(*ends))[0]

    cost = lambda row, point: float(ex.cost(*(np.array([x]) for x in three(row, point)))[0])
    for i in range(len(m)):
        for j in range(i + 1, len(m)):
            a, b = m[i, to], m[j, to]
            if a != b and allowed(i, b) and allowed(j, a):
                gain = cost(i, a) + cost(j, b) - cost(i, b) - cost(j, a)
                if gain > best[0] + 1e-12:
                    best = (gain, (i, j))
    return best[1]


def test_exchange_search_is_the_dense_one(monkeypatch):
    rng = np.random.default_rng(0)
    for trial in range(6):
        monkeypatch.setattr(exchange, "PAIRS", (500_000, 40)[trial % 2])
        frames = [(rng.uniform(-30, 30, c), rng.uniform(0, 60, c)) for c in rng.integers(0, 7, int(rng.integers(4, 7)))]
        rules = exchange.Rules(dmax=15, zones=[] if trial % 2 else exchange.ZONES, adapt=[], phimax=0.9, max_missing=trial % 3)
        ex = exchange.Exchange(frames, rules)
        m = ex.broken(ex.initial())
        for k in range(1, len(frames) - 1):
            for ahead in (True, False):
                assert ex.best_swap(m, k, ahead) == _dense_swap(ex, m, k, ahead)


def test_exchange_resolves_crossing_movers():
    a, b = [(0, 0), (0, 2), (0, 4), (0, 6), (0, 8)], [(4, 0), (2.9, 2), (0.5, 4), (-1.5, 6), (-3.5, 8)]
    rules = exchange.Rules(zones=[], adapt=[], min_lifetime=1, dmax=8, phimax=1.0)
    ex = exchange.Exchange(_movers(a, b), rules)
    assert sorted([f for _, f in x] for x in ex.tracks(ex.run())) == [[0, 2, 4, 6, 8], [1, 3, 5, 7, 9]]


def test_chains_over_many_runs(spark, monkeypatch):
    monkeypatch.setattr(linking, "STEPS", 4)
    rng, big = np.random.default_rng(3), 1 << 60
    nodes, edges, root, last = [], [], {}, {}
    for step in range(60):
        now = {}
        for k in range(5):
            cid = big + (step << 8) + k
            nodes.append((cid, step))
            prev = last.pop(int(rng.choice(list(last))), None) if last and rng.random() < 0.8 else None
            root[cid] = root[prev] if prev else cid
            if prev:
                edges.append((prev, cid))
            now[k] = cid
        last = now
    got = linking.label_chains(spark.createDataFrame(nodes, "cid long, at long").repartition(3), spark.createDataFrame(edges, "a long, b long"))
    assert {r["cid"]: r["root"] for r in got.collect()} == root


def test_range_given_by_the_user(spark):
    steps = [(0, 1), (6, 1), (24, 1), (30, 1)]
    c = spark.createDataFrame([(t, 0, 0.0, 0.0, 1.0) for t, _ in steps], "t long, c_idx int, lat double, lon double, v double")
    s = spark.createDataFrame(steps, "t long, n long")
    count = lambda **k: linking.link(c, s, **k).select("track_id").distinct().count()
    assert count() == 2 and count(start=0, end=30) == 1 and count(start=0) == 2


def test_gridded_conditions_choose_frames(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

    data = np.random.default_rng(0).normal(size=(40, 4, 6))
    path = str(tmp_path / "f.nc")
    gridded.write_netcdf3(path, np.linspace(90, -90, 4), np.arange(6) * 60.0, np.arange(40) * 6.0, "msl", data)
    frames = gridded.register(spark).read.format("gridded").option("var", "msl").load(path)
    got = frames.where("t >= 10 and t < 13 and time <= timestamp_ntz'1970-01-03 18:00:00'").collect()
    assert [r["t"] for r in got] == [10, 11] and np.allclose(got[0]["vals"], data[10].ravel())
    reader = gridded._Reader({"path": path, "var": "msl"})
    list(reader.pushFilters([GreaterThan(("t",), 4), LessThanOrEqual(("t",), 7)]))
    assert [p.value for p in reader.partitions()] == [(5, 8)]
    list(reader.pushFilters([EqualTo(("t",), 99)]))
    assert [p.value for p in reader.partitions()] == [(0, 0)]
    index = gridded.register(spark).read.format("gridded").option("var", "msl").option("index", "true").load(path).collect()
    assert [(r["t"], r["nlat"], r["nlon"], r["vals"]) for r in index] == [(k, 4, 6, []) for k in range(40)] and index[1]["time"].hour == 6
    parts = [p.value for p in gridded._Reader({"path": path, "var": "msl", "parts": "7"}).partitions()]
    assert {b - a for a, b in parts} == {5, 6} and (parts[0][0], parts[-1][1], len(parts)) == (0, 40, 7)


def test_files_of_optional_libraries(monkeypatch, tmp_path):
    import sys
    import types

    class Values(np.ndarray):
        attrs: dict

    def values(x, **attrs):
        out = np.asarray(x).view(Values)
        out.attrs = attrs
        return out

    held = {"msl": values(np.arange(24).reshape(2, 3, 4), scale_factor=2.0), "time": values(np.array([0, 6]), units=b"hours since 2000-01-01")}
    monkeypatch.setitem(sys.modules, "h5py", types.SimpleNamespace(File=lambda path, mode: held))
    f = gridded.open_file("x.nc", "netcdf4")
    assert f.read("msl", 1, 2).tolist() == (2.0 * np.arange(12, 24).reshape(1, 3, 4)).tolist() and gridded.times(f)[1].hour == 6
    one = types.SimpleNamespace(dimensions=("time", "lat", "lon"), data=np.ones((2, 3, 4)), attributes={"missing_value": 1.0})
    monkeypatch.setitem(sys.modules, "cfgrib", types.SimpleNamespace(open_file=lambda path: types.SimpleNamespace(variables={"vo": one})))
    assert np.isnan(gridded.open_file("x.grib").read("vo", 0, 1)).all()
    monkeypatch.setitem(sys.modules, "h5py", None)
    with pytest.raises(ValueError, match="h5py"):
        gridded.open_file("x.nc", "netcdf4")
    z = tmp_path / "a.zarr" / "msl"
    z.mkdir(parents=True)
    meta = {"shape": [2, 2], "chunks": [2, 2], "dtype": "<f8", "order": "C", "fill_value": 0, "filters": None, "zarr_format": 2}
    (z / ".zarray").write_text(json.dumps({**meta, "compressor": {"id": "blosc"}}))
    (z / "0.0").write_bytes(np.arange(4.0).tobytes()[::-1])
    codec = types.SimpleNamespace(get_codec=lambda c: types.SimpleNamespace(decode=lambda raw: raw[::-1]))
    monkeypatch.setitem(sys.modules, "numcodecs", codec)
    assert gridded.Zarr(str(tmp_path / "a.zarr")).read("msl").tolist() == [[0, 1], [2, 3]]


def test_winds_of_many_frames_are_those_of_each():
    u, v = np.random.default_rng(2).normal(size=(2, 3, 9, 16))
    div, vort = spectral.wind_derivatives_of(u, v, 1.0)
    for k in range(3):
        d, z = spectral.wind_derivatives(u[k], v[k], 1.0)
        assert np.allclose(div[k], d) and np.allclose(vort[k], z)
    assert all(np.allclose(p, spectral.legendre(m, 20, np.linspace(0, 3, 7))) for m, p in enumerate(spectral._orders(20, 20, np.linspace(0, 3, 7))))


def test_exports_functions_and_other_variables(spark, tmp_path):
    import gridtrack

    assert all(getattr(gridtrack, n) for n in gridtrack.__all__)
    gridtrack.register_functions(spark)
    row = spark.sql("select geod_dist_km(0D, 0D, 0D, 90D) as km, lon360(-10D) as lon, lon_gap(350D, 10D) as gap").first()
    assert row["km"] == pytest.approx(6371.22 * np.pi / 2) and (row["lon"], row["gap"]) == (350.0, 20.0)
    centers = spark.createDataFrame([(0, 10.0, 359.0), (0, -80.0, 100.0), (5, 0.0, 0.0)], "t long, lat double, lon double")
    frames = spark.createDataFrame([(0, [float(k) for k in range(12)]), (7, [0.0] * 12)], "t long, vals array<double>")
    got = gridtrack.api.sample_at(centers, frames, (3, 4), np.array([90.0, 0.0, -90.0]), np.arange(4) * 90.0, "wind")
    assert {(r["t"], r["lat"]): r["wind"] for r in got.collect()} == {(0, 10.0): 4.0, (0, -80.0): 9.0, (5, 0.0): None}
