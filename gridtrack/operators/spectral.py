"""Spherical harmonics on regular grids: filters, wind derivatives, regridding. Numpy by frame, frames in parallel.

Transforms are linear, so a band-pass is one small matrix per zonal wave number, built once for a grid. Rows run from
north to south and include both poles. Quadrature in latitude is exact for band-limited fields: profiles are
continued around the circle with their parity and refined twofold before Clenshaw-Curtis weights apply.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EARTH_M, KM = 6_371_220.0, 6371.22


def legendre(m: int, lmax: int, theta: np.ndarray) -> np.ndarray:
    """P_lm(theta) for l = m..lmax, without sign factor, the integral of P^2 sin(theta) over 0..pi being 1."""
    c, s = np.cos(theta), np.sin(theta)
    out = np.zeros((max(0, lmax - m + 1), len(theta)))
    p = np.full(len(theta), np.sqrt(0.5))
    for k in range(1, m + 1):
        p = p * s * np.sqrt((2 * k + 1) / (2 * k))
    if lmax >= m:
        out[0] = p
    if lmax > m:
        out[1] = np.sqrt(2 * m + 3) * c * p
    for l in range(m + 2, lmax + 1):  # noqa: E741
        a = np.sqrt((4 * l * l - 1) / (l * l - m * m))
        b = np.sqrt(((l - 1) ** 2 - m * m) / (4 * (l - 1) ** 2 - 1))
        out[l - m] = a * (c * out[l - m - 1] - b * out[l - m - 2])
    return out


def colatitudes(nlat: int, geometry: str = "CC") -> np.ndarray:
    if geometry == "GL":
        return np.arccos(np.polynomial.legendre.leggauss(nlat)[0][::-1])
    return np.linspace(0, np.pi, nlat)


@lru_cache(maxsize=8)
def _refine(nlat: int, odd: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(matrix to 2 * nlat - 1 rows, their colatitudes, their weights) for profiles of even or odd parity."""
    n = nlat - 1
    sign = -1.0 if odd else 1.0
    circle = np.zeros((2 * n, nlat))
    circle[np.arange(nlat), np.arange(nlat)] = 1
    circle[2 * n - np.arange(1, n), np.arange(1, n)] = sign
    spectrum = np.fft.fft(circle, axis=0)
    wide = np.zeros((4 * n, nlat), complex)
    wide[:n], wide[-n + 1 :] = spectrum[:n], spectrum[n + 1 :]
    wide[n], wide[-n] = spectrum[n] / 2, spectrum[n] / 2
    fine = np.fft.ifft(wide, axis=0).real[: 2 * n + 1] * 2
    return fine, np.linspace(0, np.pi, 2 * n + 1), _refine_weights(nlat)


@lru_cache(maxsize=8)
def _refine_weights(nlat: int) -> np.ndarray:
    n = nlat - 1
    k, j = np.arange(2 * n + 1), np.arange(1, n + 1)
    b = np.where(j == n, 1.0, 2.0)
    w = (1 - (b / (4 * j * j - 1) * np.cos(np.pi * np.outer(k, j) / n)).sum(1)) / (2 * n)
    w[1:-1] *= 2
    return w


def _check(frame: np.ndarray) -> None:
    if frame.ndim != 2 or frame.shape[0] < 3 or frame.shape[1] < 4 or not np.isfinite(frame).all():
        raise ValueError(f"Unsupported shape for spectral filter: {frame.shape}")


def analyse(frame: np.ndarray, lmax: int, mmax: int) -> list[np.ndarray]:
    """Coefficients a_lm, a vector for l = m..lmax for each m."""
    _check(frame)
    f = np.fft.rfft(frame, axis=1) / frame.shape[1]
    out = []
    for m in range(mmax + 1):
        up, theta, w = _refine(len(frame), bool(m % 2))
        out.append((legendre(m, lmax, theta) * w) @ (up @ f[:, m]))
    return out


def band(alm: list[np.ndarray], lmin: int, lmax: int) -> list[np.ndarray]:
    """Coefficients outside lmin..lmax set to 0."""
    return [np.where((np.arange(m, m + len(a)) >= lmin) & (np.arange(m, m + len(a)) <= lmax), a, 0) for m, a in enumerate(alm)]


def synthesise(alm: list[np.ndarray], theta: np.ndarray, nlon: int) -> np.ndarray:
    f = np.zeros((len(theta), nlon // 2 + 1), complex)
    for m, a in enumerate(alm):
        if m < f.shape[1]:
            f[:, m] = a @ legendre(m, m + len(a) - 1, theta)
    return np.fft.irfft(f * nlon, nlon, axis=1)


def synthesise_points(alm: list[np.ndarray], theta: np.ndarray, phi: np.ndarray) -> np.ndarray:
    rows, at = np.unique(theta, return_inverse=True)
    out = np.zeros(len(theta))
    for m, a in enumerate(alm):
        g = (a @ legendre(m, m + len(a) - 1, rows))[at]
        out += (g * np.exp(1j * m * phi)).real * (2 if m else 1)
    return out


@lru_cache(maxsize=8)
def _band_pass(nlat: int, nlon: int, lmin: int, lmax: int) -> np.ndarray:
    mmax = min(lmax, nlon // 2 - 1)
    out = np.zeros((mmax + 1, nlat, nlat))
    for m in range(mmax + 1):
        up, theta, w = _refine(nlat, bool(m % 2))
        low = max(0, lmin - m)
        fine, rows = legendre(m, lmax, theta)[low:], legendre(m, lmax, colatitudes(nlat))[low:]
        out[m] = rows.T @ ((fine * w) @ up)
    return out


def filter_frame(frame: np.ndarray, lmin: int = 5, lmax: int = 42) -> np.ndarray:
    """A frame's wave numbers lmin..lmax, on the same grid."""
    _check(frame)
    if lmax >= frame.shape[0] or lmax < 0:
        raise ValueError(f"Unsupported shape for spectral filter: {frame.shape} has no wave number {lmax}")
    q = _band_pass(*frame.shape, lmin, lmax)
    f = np.fft.rfft(frame, axis=1)
    out = np.zeros_like(f)
    out[:, : len(q)] = np.einsum("mij,jm->im", q, f[:, : len(q)])
    return np.fft.irfft(out, frame.shape[1], axis=1)


def _orders(mmax: int, lmax: int, theta: np.ndarray, block: int = 16) -> Iterator[np.ndarray]:
    """``legendre(m, lmax, theta)`` for m = 0..mmax; the recurrence runs over ``block`` orders at once."""
    c, s, first = np.cos(theta), np.sin(theta), np.full(len(theta), np.sqrt(0.5))
    for m0 in range(0, mmax + 1, block):
        orders = np.arange(m0, min(m0 + block, mmax + 1))
        out = np.zeros((len(orders), max(0, lmax - m0 + 1), len(theta)))
        for i, m in enumerate(orders):
            if m:
                first = first * s * np.sqrt((2 * m + 1) / (2 * m))
            if out.shape[1]:
                out[i, 0] = first
        m = orders[:, None]
        if out.shape[1] > 1:
            out[:, 1] = np.sqrt(2 * m + 3) * c * out[:, 0]
        for k in range(2, out.shape[1]):
            l = m + k  # noqa: E741
            x = np.sqrt((4 * l * l - 1) / (l * l - m * m))
            y = x * np.sqrt(((l - 1) ** 2 - m * m) / (4 * (l - 1) ** 2 - 1))
            out[:, k] = (x * c) * out[:, k - 1] - y * out[:, k - 2]
        for i, m in enumerate(orders):
            yield out[i, : max(0, lmax - m + 1)]


def _circle(f: np.ndarray, odd: bool) -> np.ndarray:
    """Columns of ``f`` on twice as many rows, continued around the circle with their parity: ``_refine`` by FFT."""
    n = len(f) - 1
    spectrum = np.fft.fft(np.concatenate([f, (-1 if odd else 1) * f[n - 1 : 0 : -1]]), axis=0)
    wide = np.zeros((4 * n, *f.shape[1:]), complex)
    wide[:n], wide[-n + 1 :] = spectrum[:n], spectrum[n + 1 :]
    wide[n], wide[-n] = spectrum[n] / 2, spectrum[n] / 2
    return np.fft.ifft(wide, axis=0)[: 2 * n + 1] * 2


def wind_derivatives_of(u: np.ndarray, v: np.ndarray, radius: float = EARTH_M, lmax: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(divergence, vorticity) of winds (frames, rows, columns), by integrating against the gradients of the harmonics.

    Rows run from north to south. The harmonics are made once for all frames, on one hemisphere: they are even or odd
    about the equator, so the other follows from sums and differences.
    """
    if u.shape != v.shape:
        raise ValueError("u and v differ in shape")
    for x in (*u, *v):
        _check(x)
    count, nlat, nlon = u.shape
    n, lmax = nlat - 1, nlat - 2 if lmax is None else lmax
    mmax = min(lmax, (nlon - 1) // 2)
    w = _refine_weights(nlat)[: n + 1, None, None]
    # (even and odd part, half of the rows, orders, u of all frames and v of all frames), folded about the equator
    f = np.concatenate([np.fft.rfft(x, axis=2)[:, :, : mmax + 1].transpose(1, 2, 0) / nlon for x in (u, v)], 2)
    folded = np.empty((2, n + 1, mmax + 1, 2 * count), complex)
    for parity in (0, 1):  # components of a vector have the other parity
        whole = _circle(f[:, parity::2], parity == 0)
        north, south = whole[: n + 1], whole[: n - 1 : -1]
        south = south.copy()
        south[n] = 0  # the equator counts once
        folded[0, :, parity::2], folded[1, :, parity::2] = (north + south) * w, (north - south) * w
    folded[1, n] = 0
    out = np.zeros((2, nlat, nlon // 2 + 1, count), complex)
    theta = np.linspace(0, np.pi, 2 * n + 1)[: n + 1]

    def project(p: np.ndarray, m: int) -> np.ndarray:
        rows = np.empty((len(p), 2 * count), complex)
        for k in (0, 1):
            rows[k::2] = (p[k::2] @ np.ascontiguousarray(folded[k, :, m]).view(float)).view(complex)
        return rows

    waves = _orders(mmax + 1, lmax, theta)
    before, here = None, next(waves)
    for m in range(mmax + 1):
        after = next(waves)
        l = np.arange(m, lmax + 1)[:, None]  # noqa: E741
        plus = np.zeros((len(l) + 1, 2 * count), complex)  # from l - 1 = m - 1 on
        plus[2 : 2 + len(after)] = project(after, m)[: len(l) - 1]
        if m == 0:
            slope, across = -np.sqrt(l * (l + 1.0)) * plus[1:], np.zeros_like(plus[1:])
        else:
            minus = project(before, m)
            slope = 0.5 * (np.sqrt((l + m) * (l - m + 1.0)) * minus[1:] - np.sqrt((l - m) * (l + m + 1.0)) * plus[1:])
            scale = 0.5 * np.sqrt((2 * l + 1) / np.maximum(2 * l - 1, 1))
            across = scale * (np.sqrt((l + m) * (l + m - 1.0)) * minus[:-1] + np.sqrt(np.maximum((l - m) * (l - m - 1.0), 0)) * plus[:-1])
        su, sv, xu, xv = slope[:, :count], slope[:, count:], across[:, :count], across[:, count:]
        coefficients = np.concatenate([1j * xu + sv, -su + 1j * xv], 1) / radius  # divergence, vorticity
        if m < out.shape[2]:
            e, o = ((here[k::2, ::2].T @ np.ascontiguousarray(coefficients[k::2]).view(float)).view(complex) for k in (0, 1))
            rows = np.empty((nlat, 2 * count), complex)
            rows[: len(e)] = e + o
            rows[nlat - len(e) :] = (e - o)[::-1]
            if n % 2 == 0:
                rows[n // 2] = e[-1]  # all odd ones are 0 there
            out[0, :, m], out[1, :, m] = rows[:, :count], rows[:, count:]
        before, here = here, after
    div, vort = (np.fft.irfft(x * nlon, nlon, axis=1).transpose(2, 0, 1) for x in out)
    return div, vort


def wind_derivatives(u: np.ndarray, v: np.ndarray, radius: float = EARTH_M, lmax: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(divergence, vorticity) of one wind; rows north to south."""
    if u.shape != v.shape:
        raise ValueError("u and v differ in shape")
    div, vort = wind_derivatives_of(u[None], v[None], radius, lmax)
    return div[0], vort[0]


def regrid(frame: np.ndarray, nlat: int, nlon: int, lmax: int | None = None, geometry: str = "CC") -> np.ndarray:
    lmax = min(frame.shape[1] // 2 - 1, frame.shape[0] - 1) if lmax is None else lmax
    return synthesise(analyse(frame, lmax, min(lmax, frame.shape[1] // 2 - 1)), colatitudes(nlat, geometry), nlon)


def to_healpix(frame: np.ndarray, nside: int, lmax: int | None = None) -> np.ndarray:
    from .healpix import pixel_angles

    lmax = min(frame.shape[1] // 2 - 1, frame.shape[0] - 1) if lmax is None else lmax
    theta, phi = pixel_angles(nside)
    return synthesise_points(analyse(frame, lmax, min(lmax, frame.shape[1] // 2 - 1)), theta, phi)


def stereo_axes(extent: tuple[float, float, float, float], resolution: float) -> tuple[np.ndarray, np.ndarray]:
    x0, x1, y0, y1 = extent
    return np.linspace(x0, x1, round((x1 - x0) / resolution) + 1), np.linspace(y0, y1, round((y1 - y0) / resolution) + 1)


def to_polar_stereo(frame: np.ndarray, south: bool = False, extent=(-13000.0, 13000.0, -13000.0, 13000.0), resolution: float = 100.0, lon0: float = 0.0, lmin: int = 0, lmax: int | None = None) -> np.ndarray:
    """(y, x) values on a polar stereographic plane in km."""
    lmax = min(frame.shape[1] // 2 - 1, frame.shape[0] - 1) if lmax is None else lmax
    x, y = np.meshgrid(*stereo_axes(extent, resolution))
    rho = np.hypot(x, y)
    theta = 2 * np.arctan(rho / (2 * KM))
    theta, phi = (np.pi - theta, np.arctan2(x, y)) if south else (theta, np.arctan2(x, -y))
    alm = band(analyse(frame, lmax, min(lmax, frame.shape[1] // 2 - 1)), lmin, lmax)
    return synthesise_points(alm, theta.ravel(), np.radians(lon0) + phi.ravel()).reshape(x.shape)


def taper_weights(n: int, points: int) -> np.ndarray:
    k = min(points, n // 2)
    w = np.ones(n)
    if k > 0 and n > 1:
        edge = 0.5 * (1 - np.cos(np.pi * np.arange(k) / k))
        w[:k], w[n - k :] = edge, edge[::-1]
    return w


def map_frames(frames: DataFrame, f: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int], vals: str = "vals") -> DataFrame:
    """``f`` on every frame (t, vals), in Arrow batches; the other columns pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{vals: [f(np.asarray(x, float).reshape(shape)).ravel() for x in b[vals]]})

    return frames.mapInPandas(run, frames.schema)


def frames_of(rows: DataFrame, nlat: int, nlon: int, basis: Callable, names: list[str]) -> DataFrame:
    """(t, vals): frames that are sums of fields given at unit vectors (x, y, z) of the grid, weighted by the columns ``names``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        theta, phi = np.linspace(0, np.pi, nlat)[:, None], (np.arange(nlon) * 2 * np.pi / nlon)[None, :]
        parts = np.stack([np.broadcast_to(b, (nlat, nlon)).ravel() for b in basis(np.sin(theta) * np.cos(phi), np.sin(theta) * np.sin(phi), np.cos(theta) + 0 * phi)])
        for b in batches:
            yield pd.DataFrame({"t": b["t"], "vals": list(b[names].to_numpy(float) @ parts)})

    return rows.mapInPandas(run, f"t {rows.schema['t'].dataType.simpleString()}, vals array<double>")


def spectral_filter(frames: DataFrame, shape: tuple[int, int], lmin: int = 5, lmax: int = 42, north_first: bool = True) -> DataFrame:
    """Band-pass of frames; rows keep their order, whichever pole is first."""
    flip = slice(None) if north_first else slice(None, None, -1)
    return map_frames(frames, lambda x: filter_frame(x[flip], lmin, lmax)[flip], shape)


def taper(frames: DataFrame, shape: tuple[int, int], points: int = 10) -> DataFrame:
    wy, wx = taper_weights(shape[0], points), taper_weights(shape[1], points)
    return map_frames(frames, lambda x: x * np.outer(wy, wx), shape)


def wind_frames(u: DataFrame, v: DataFrame, shape: tuple[int, int], north_first: bool = True, radius: float = EARTH_M) -> DataFrame:
    """(t, divergence, vorticity) of two frame tables, joined on t."""
    flip = slice(None) if north_first else slice(None, None, -1)
    most = max(1, (1 << 22) // (shape[0] * shape[1]))  # frames that share the making of the harmonics

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), most):
                part = b.iloc[lo : lo + most]
                div, vort = wind_derivatives_of(*(np.stack([np.asarray(x, float).reshape(shape)[flip] for x in part[c]]) for c in ("u", "v")), radius)
                yield pd.DataFrame({"t": part["t"], "divergence": [d[flip].ravel() for d in div], "vorticity": [z[flip].ravel() for z in vort]})

    both = u.select("t", F.col("vals").alias("u")).join(v.select("t", F.col("vals").alias("v")), "t")
    return both.mapInPandas(run, f"t {u.schema['t'].dataType.simpleString()}, divergence array<double>, vorticity array<double>")
