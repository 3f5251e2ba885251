"""Detection on whole frames in numpy, for grids whose cells are too many for rows: one frame is one Arrow value."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .objects import label_mask


def _window_min(w: np.ndarray, h: int, periodic: bool) -> np.ndarray:
    """Least value in the square around each cell, rows cut at the edge, columns wrapped if periodic."""
    pad = np.pad(w, ((0, 0), (h, h)), mode="wrap") if periodic else np.pad(w, ((0, 0), (h, h)), constant_values=np.inf)
    row = np.lib.stride_tricks.sliding_window_view(pad, 2 * h + 1, 1).min(-1)
    tall = np.pad(row, ((h, h), (0, 0)), constant_values=np.inf)
    return np.lib.stride_tricks.sliding_window_view(tall, 2 * h + 1, 0).min(-1)


def _filled(frame: np.ndarray, mode: str) -> np.ndarray:
    w = frame if mode == "min" else -frame
    return np.where(np.isfinite(w), w, np.inf)


def extrema(frame: np.ndarray, size: int = 5, threshold: float = 0.0, mode: str = "min", periodic: bool = True) -> np.ndarray:
    """Mask of cells that nothing in their square undercuts and a third of it exceeds by more than ``threshold``."""
    if size % 2 == 0:
        raise ValueError("size must be odd")
    w, h = _filled(frame, mode), size // 2
    rows, cols = w.shape
    out = np.zeros(w.shape, bool)
    if rows <= 2 * h:
        return out
    out[h : rows - h] = ((w == _window_min(w, h, periodic)) & np.isfinite(w))[h : rows - h]
    i, j = np.nonzero(out)
    if len(i):
        o = np.arange(-h, h + 1)
        jj = j[:, None, None] + o[None, None, :]
        ring = w[i[:, None, None] + o[None, :, None], jj % cols] if periodic else np.where((jj >= 0) & (jj < cols), w[i[:, None, None] + o[None, :, None], np.clip(jj, 0, cols - 1)], np.inf)
        third = np.partition(ring.reshape(len(i), -1), size * size // 3, 1)[:, size * size // 3]
        out[i, j] = third - w[i, j] > threshold
    return out


def centers(frame: np.ndarray, size: int = 5, threshold: float = 0.0, mode: str = "min", periodic: bool = True, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of extrema with the strongest Laplacian in their 5 x 5 square, in row order; the first ``most``
    of them if that is given."""
    w = _filled(frame, mode)
    i, j = np.nonzero(extrema(frame, size, threshold, mode, periodic))
    if not len(i):
        return i, j
    rows, cols = w.shape
    lap = w[(i - 1) % rows, j] + w[(i + 1) % rows, j] + w[i, (j - 1) % cols] + w[i, (j + 1) % cols] - 4 * w[i, j]
    score = np.zeros((rows, cols))
    score[i, j] = np.abs(lap)
    order = np.full((rows, cols), rows * cols)
    order[i, j] = i * cols + j
    keep = np.abs(lap) > 0
    for di in range(-2, 3):
        for dj in range(-2, 3):
            if di or dj:
                a, b = i + di, (j + dj) % cols
                ok = (a >= 0) & (a < rows)
                if not periodic:
                    ok &= (j + dj >= 0) & (j + dj < cols)
                a = np.clip(a, 0, rows - 1)
                keep &= ~(ok & ((score[a, b] > np.abs(lap)) | ((score[a, b] == np.abs(lap)) & (order[a, b] < i * cols + j))))
    return i[keep][:most], j[keep][:most]


def object_extrema(frame: np.ndarray, size: int, threshold: float, mode: str, min_points: int, periodic: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and labels of the extrema of thresholded objects."""
    w = _filled(frame, mode)
    mask = np.isfinite(w) & (w <= (threshold if mode == "min" else -threshold))
    labels = label_mask(mask)
    big = np.bincount(labels.ravel(), minlength=2)[labels] >= min_points
    i, j = np.nonzero(mask & big & (w == _window_min(w, size // 2, periodic)))
    return i, j, labels[i, j]


def refine(frame: np.ndarray, i: np.ndarray, j: np.ndarray, lat: np.ndarray, lon: np.ndarray, periodic: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stationary points of the quadratic through each 3 x 3 square; grid points where that fails."""
    rows, cols = frame.shape
    at = lambda a, b: frame[np.clip(i + a, 0, rows - 1), (j + b) % cols]
    z = at(0, 0)
    fx, fy = (at(0, 1) - at(0, -1)) / 2, (at(1, 0) - at(-1, 0)) / 2
    fxx, fyy = at(0, 1) - 2 * z + at(0, -1), at(1, 0) - 2 * z + at(-1, 0)
    fxy = (at(1, 1) - at(1, -1) - at(-1, 1) + at(-1, -1)) / 4
    det = fyy * fxx - fxy * fxy
    with np.errstate(divide="ignore", invalid="ignore"):
        dx, dy = -(fyy * fx - fxy * fy) / det, -(fxx * fy - fxy * fx) / det
        ok = (i > 0) & (i < rows - 1) & (np.abs(det) >= 1e-10) & (np.abs(dx) <= 1) & (np.abs(dy) <= 1)
    if not periodic:
        ok &= (j > 0) & (j < cols - 1)
    to_i, to_j = np.clip(i + np.where(dy >= 0, 1, -1), 0, rows - 1), (j + np.where(dx >= 0, 1, -1)) % cols
    step = lon[to_j] - lon[j]
    if periodic:
        step = (step + 180) % 360 - 180
    rlat, rlon = lat[i] + np.abs(dy) * (lat[to_i] - lat[i]), lon[j] + np.abs(dx) * step
    if periodic:
        rlon = rlon % 360
    return np.where(ok, rlat, lat[i]), np.where(ok, rlon, lon[j]), np.where(ok, z + 0.5 * (fy * dy + fx * dx), z)


def _map(frames: DataFrame, shape: tuple[int, int], find) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [find(np.asarray(vals, float).reshape(shape)) for vals in b["vals"]]
            n = [len(v) for _, _, v in found]
            lat, lon, v = (np.concatenate([f[k] for f in found]) if found else np.zeros(0) for k in range(3))
            index = np.concatenate([np.arange(c) for c in n]) if n else np.zeros(0, int)
            yield pd.DataFrame({"t": b["t"].repeat(n).to_numpy(), "c_idx": index, "lat": lat, "lon": lon, "v": v})

    kind = frames.schema["t"].dataType.simpleString()
    return frames.select("t", "vals").mapInPandas(run, f"t {kind}, c_idx int, lat double, lon double, v double")


def detect_frames(frames: DataFrame, shape, lat, lon, size: int = 5, threshold: float = 0.0, mode: str = "min", periodic: bool = True, most: int | None = None) -> DataFrame:
    """(t, c_idx, lat, lon, v): local extrema of frames (t, vals); at most ``most`` a frame if that is given."""

    def find(f):
        i, j = centers(f, size, threshold, mode, periodic, most)
        return lat[i], lon[j], f[i, j]

    return _map(frames, shape, find)


def object_frames(frames: DataFrame, shape, lat, lon, size: int = 5, threshold: float = 0.0, mode: str = "min", min_points: int = 1, periodic: bool = True) -> DataFrame:
    """(t, c_idx, lat, lon, v): refined extrema of thresholded objects."""

    def find(f):
        i, j, _ = object_extrema(f, size, threshold, mode, min_points, periodic)
        return refine(f, i, j, lat, lon, periodic)

    return _map(frames, shape, find)
