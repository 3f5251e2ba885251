"""HEALPix maps in RING order: geometry from the projection itself, objects and refined extrema on the pixel graph."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Fixed values of the projection: ring offset and longitude offset of each of the twelve faces.
_RING = np.array([2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4])
_TURN = np.array([1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7])
SLOTS = ("SW", "W", "NW", "N", "NE", "E", "SE", "S")


def _place(face: np.ndarray, x: np.ndarray, y: np.ndarray, nside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ring coordinate, z, phi) of points of faces, x and y in 0..nside (Gorski et al., 2005)."""
    r = _RING[face] * nside - x - y
    near = np.where(r < nside, r, np.where(r > 3 * nside, 4 * nside - r, nside)).astype(float)
    cap = near * near / (3.0 * nside * nside)
    z = np.where(r < nside, 1 - cap, np.where(r > 3 * nside, cap - 1, (2 * nside - r) * 2 / (3.0 * nside)))
    with np.errstate(divide="ignore", invalid="ignore"):
        turn = np.where(near > 0, (_TURN[face] * near + x - y) / near, 0)
    return r, z, np.mod(turn * np.pi / 4, 2 * np.pi)


def nside_of(pixels: int) -> int:
    n = round((pixels / 12) ** 0.5)
    if pixels <= 0 or 12 * n * n != pixels:
        raise ValueError(f"{pixels} pixels are no HEALPix map")
    return n


@lru_cache(maxsize=4)
def _order(nside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    face, x, y = (a.ravel() for a in np.meshgrid(np.arange(12), np.arange(nside), np.arange(nside), indexing="ij"))
    r, _, phi = _place(face, x + 0.5, y + 0.5, nside)
    order = np.lexsort((phi, np.round(r)))
    return face[order], x[order], y[order]


@lru_cache(maxsize=4)
def pixel_angles(nside: int) -> tuple[np.ndarray, np.ndarray]:
    """(theta, phi) of all pixels, in RING order."""
    face, x, y = _order(nside)
    _, z, phi = _place(face, x + 0.5, y + 0.5, nside)
    return np.arccos(z), phi


@lru_cache(maxsize=4)
def neighbours(nside: int) -> np.ndarray:
    """(8, pixels): neighbours in the order of ``SLOTS``, -1 where eight pixels' corner has but seven.

    Pixels that share a corner are neighbours; two shared corners make it an edge.
    """
    face, x, y = _order(nside)
    n = len(face)
    keys = []
    for dx, dy in ((1, 1), (1, 0), (0, 0), (0, 1)):  # north, east, south, west
        _, z, phi = _place(face, x + dx, y + dy, nside)
        s = np.sqrt(np.maximum(1 - z * z, 0))
        keys.append(np.round(np.stack([s * np.cos(phi), s * np.sin(phi), z], 1) * 1e7).astype(np.int64))
    _, corner = np.unique(np.concatenate(keys), axis=0, return_inverse=True)
    corner = corner.reshape(4, n)
    table = pd.DataFrame({"c": corner.ravel(), "p": np.tile(np.arange(n), 4), "k": np.repeat(np.arange(4), n)})
    pairs = table.merge(table[["c", "p"]], on="c", suffixes=("", "2"))
    pairs = pairs[pairs["p"] != pairs["p2"]]
    mask = pairs.assign(k=np.left_shift(1, pairs["k"].to_numpy())).groupby(["p", "p2"])["k"].sum()
    slot = {0b1: 3, 0b10: 5, 0b100: 7, 0b1000: 1, 0b11: 4, 0b110: 6, 0b1100: 0, 0b1001: 2}
    out = np.full((8, n), -1)
    at = mask.map(slot)
    keep = at.notna().to_numpy()
    out[at[keep].astype(int), mask.index.get_level_values(0)[keep]] = mask.index.get_level_values(1)[keep]
    return out


def label_pixels(mask: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Labels 1..N of connected pixels in order of their first; 0 outside."""
    n = len(mask)
    label = np.where(mask, np.arange(n), n)
    while True:
        flat = np.append(label, n)
        new = np.where(mask, np.minimum(label, flat[near].min(0)), n)  # -1 is the last
        new = np.where(mask, np.append(new, n)[new], n)
        if (new == label).all():
            break
        label = new
    return np.where(mask, np.searchsorted(np.unique(label[mask]), label) + 1, 0)


def object_extrema(values: np.ndarray, labels: np.ndarray, near: np.ndarray, mode: str = "min", min_points: int = 1) -> np.ndarray:
    """Pixels of objects that are large enough, none of whose neighbours is strictly better."""
    w = values if mode == "min" else -values
    around = np.where(near >= 0, w[near], np.inf)
    around = np.where(np.isnan(around), np.inf, around)
    big = np.bincount(labels, minlength=2)[labels] >= min_points
    return np.flatnonzero((labels > 0) & big & (around.min(0) >= w))


def refine_pixel(values: np.ndarray, p: int, near: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> tuple[float, float, float]:
    """The stationary point of a quadric fitted to a pixel and its neighbours in a local plane; the pixel itself where
    the fit is degenerate or leaves the neighbourhood."""
    own = (float(lat[p]), float(lon[p]), float(values[p]))
    at = np.append(p, near[near[:, p] >= 0, p])
    if len(at) < 6 or not np.isfinite(values[at]).all():
        return own
    shrink = np.cos(np.radians(lat[p]))
    x = np.radians((lon[at] - lon[p] + 180) % 360 - 180) * shrink
    y = np.radians(lat[at] - lat[p])
    sx, sy = (s if s >= 1e-10 else 1.0 for s in (np.abs(x).max(), np.abs(y).max()))
    x, y = x / sx, y / sy
    m = np.stack([x * x, y * y, x * y, x, y, np.ones(len(x))], 1)
    try:
        a, b, c, d, e, f = np.linalg.solve(m.T @ m, m.T @ values[at])
    except np.linalg.LinAlgError:
        return own
    det = 4 * a * b - c * c
    if abs(det) < 1e-12:
        return own
    px, py = (c * e - 2 * b * d) / det, (c * d - 2 * a * e) / det
    if abs(px) > 2 or abs(py) > 2:
        return own
    value = a * px * px + b * py * py + c * px * py + d * px + e * py + f
    return float(lat[p] + np.degrees(py * sy)), float((lon[p] + np.degrees(px * sx / shrink)) % 360), float(value)


def detect_map(values: np.ndarray, threshold: float, mode: str = "min", min_points: int = 1) -> list[tuple[int, int, float, float, float]]:
    """(pixel, label, lat, lon, value) of refined extrema of thresholded objects."""
    nside = nside_of(len(values))
    near = neighbours(nside)
    theta, phi = pixel_angles(nside)
    lat, lon = 90 - np.degrees(theta), np.degrees(phi)
    with np.errstate(invalid="ignore"):
        mask = values <= threshold if mode == "min" else values >= threshold
    labels = label_pixels(mask, near)
    return [(int(p), int(labels[p]), *refine_pixel(values, p, near, lat, lon)) for p in object_extrema(values, labels, near, mode, min_points)]


def healpix_detect(frames: DataFrame, threshold: float, mode: str = "min", min_points: int = 1) -> DataFrame:
    """(t, c_idx, pixel, label, lat, lon, v) of frames (t, vals) in RING order; each frame is a row of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(t, k, *x) for t, vals in zip(b["t"], b["vals"], strict=True) for k, x in enumerate(detect_map(np.asarray(vals, float), threshold, mode, min_points))]
            yield pd.DataFrame(rows, columns=["t", "c_idx", "pixel", "label", "lat", "lon", "v"])

    kind = frames.schema["t"].dataType.simpleString()
    return frames.select("t", "vals").mapInPandas(run, f"t {kind}, c_idx int, pixel int, label int, lat double, lon double, v double")
