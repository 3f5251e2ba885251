"""Linking by smoothness: nearest-neighbour rows, breaks, and greedy exchange of points between rows.

One chunk of frames is one task: the exchange picks a single best swap for each frame, so it can't be cut further.
Chunks are independent of each other and run in parallel; ``tracks.splice`` joins them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Pairs of rows whose exchange is judged at once: a few dozen MB.
PAIRS = 500_000
# Standard search zones (lon_min, lon_max, lat_min, lat_max, degrees) and adaptive smoothness knots.
ZONES = [[0.0, 360.0, -90.0, -20.0, 6.5], [0.0, 360.0, -20.0, 20.0, 3.0], [0.0, 360.0, 20.0, 90.0, 6.5]]
ADAPT = [[1.0, 2.0, 5.0, 8.0], [1.0, 0.3, 0.1, 0.0]]


@dataclass
class Rules:
    w1: float = 0.2
    w2: float = 0.8
    dmax: float = 6.5
    phimax: float = 0.5
    iterations: int = 3
    min_lifetime: int = 3
    max_missing: int = 0
    zones: list = field(default_factory=lambda: [list(z) for z in ZONES])
    adapt: list = field(default_factory=lambda: [list(a) for a in ADAPT])


def unit_vectors(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], -1)


def angle(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip((p * q).sum(-1), -1, 1))


def zone_limits(lat: np.ndarray, lon: np.ndarray, zones: list, default: float) -> np.ndarray:
    """Search radius in degrees of the first zone that holds each point; zones may cross longitude 0."""
    out, open_ = np.full(len(lat), float(default)), np.ones(len(lat), bool)
    for lo, hi, south, north, limit in zones:
        inside = (lon >= lo) & (lon <= hi) if lo <= hi else (lon >= lo) | (lon <= hi)
        hit = open_ & inside & (lat >= south) & (lat <= north)
        out[hit], open_ = limit, open_ & ~hit
    return out


def adaptive_limit(d: np.ndarray, adapt: list, default: float) -> np.ndarray:
    if len(adapt) != 2 or min(map(len, adapt)) < 4:
        return np.full(np.shape(d), float(default))
    return np.interp(d, adapt[0], adapt[1])


def triplet_cost(u: np.ndarray, v: np.ndarray, w: np.ndarray, w1: float, w2: float) -> np.ndarray:
    a1, a2 = angle(u, v), angle(v, w)
    uv, vw, uw = (u * v).sum(-1), (v * w).sum(-1), (u * w).sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        turn = (uv * vw - uw) / (np.sin(a1) * np.sin(a2))
        moving = np.maximum(0.5 * w1 * (1 - turn) + w2 * (1 - 2 * np.sqrt(a1 * a2) / (a1 + a2)), 0)
    return np.where((a1 <= 0) & (a2 <= 0), 0.0, np.where((a1 <= 0) | (a2 <= 0), w2, moving))


class Exchange:
    """Tracks of a chunk as a matrix: a row per track, a column per frame, feature numbers or -1."""

    def __init__(self, frames: list[tuple[np.ndarray, np.ndarray]], rules: Rules):
        self.rules, self.frames = rules, len(frames)
        lat, lon = (np.concatenate([f[k] for f in frames]) if frames else np.zeros(0) for k in (0, 1))
        self.first = np.concatenate([[0], np.cumsum([len(f[0]) for f in frames])]).astype(int)
        self.p = np.concatenate([unit_vectors(lat, lon), np.full((1, 3), np.nan)])  # -1 is the last: no point
        self.limit = np.append(np.radians(zone_limits(lat, lon, rules.zones, rules.dmax)), np.nan)

    def near(self, a, b) -> np.ndarray:
        """Whether two features are within the mean of their search radii; true where either is missing."""
        ok = ~(angle(self.p[a], self.p[b]) > 0.5 * (self.limit[a] + self.limit[b]))
        return ok | (np.asarray(a) < 0) | (np.asarray(b) < 0)

    def cost(self, a, b, c) -> np.ndarray:
        """Cost of a triplet; a missing first point costs nothing, a missing other one ``phimax``."""
        full = triplet_cost(self.p[a], self.p[b], self.p[c], self.rules.w1, self.rules.w2)
        a, b, c = np.broadcast_arrays(a, b, c)
        return np.where(a < 0, 0.0, np.where((b < 0) | (c < 0), self.rules.phimax, full))

    def smooth(self, a, b, c, cost) -> np.ndarray:
        """Whether a triplet of real points is within the adaptive limit; true where one is missing."""
        d = np.degrees(0.5 * (angle(self.p[a], self.p[b]) + angle(self.p[b], self.p[c])))
        a, b, c = np.broadcast_arrays(a, b, c)
        real = (a >= 0) & (b >= 0) & (c >= 0)
        return ~real | (cost <= adaptive_limit(np.where(real, d, 0), self.rules.adapt, self.rules.phimax))

    def initial(self) -> np.ndarray:
        rows = [[i] for i in range(self.first[0], self.first[1])]
        for k in range(self.frames - 1):
            new = np.arange(self.first[k + 1], self.first[k + 2])
            taken = np.zeros(len(new), bool)
            for row in rows:
                tail, best = row[-1], -1
                if tail >= 0 and len(new):
                    d = angle(self.p[tail], self.p[new])
                    d = np.where(taken | ~(d < 0.5 * (self.limit[tail] + self.limit[new])), np.inf, d)
                    if np.isfinite(d).any():
                        best = int(d.argmin())
                        taken[best] = True
                row.append(int(new[best]) if best >= 0 else -1)
            rows += [[-1] * (k + 1) + [int(i)] for i in new[~taken]]
        return np.array(rows, int).reshape(-1, self.frames)

    def broken(self, m: np.ndarray) -> np.ndarray:
        out = []
        for row in m:
            start = 0
            for k in range(1, self.frames - 1):
                a, b, c = row[k - 1 : k + 2]
                if min(a, b, c) >= 0 and not self.smooth(a, b, c, self.cost(a, b, c)):
                    piece = np.full(self.frames, -1)
                    piece[start : k + 1] = row[start : k + 1]
                    out.append(piece)
                    start = k + 1
            piece = np.full(self.frames, -1)
            piece[start:] = row[start:]
            out.append(piece)
        return np.array(out, int).reshape(-1, self.frames)

    def gaps_ok(self, m: np.ndarray) -> np.ndarray:
        """Rows without more than ``max_missing`` phantoms in a row between real points."""
        most = self.rules.max_missing
        if most < 0:
            return np.ones(len(m), bool)
        real = m >= 0
        between = ~real & (np.maximum.accumulate(real, 1)) & (np.maximum.accumulate(real[:, ::-1], 1)[:, ::-1])
        run, bad = np.zeros(len(m), int), np.zeros(len(m), bool)
        for k in range(m.shape[1]):
            run = np.where(between[:, k], run + 1, 0)
            bad |= run > most
        return ~bad

    def best_swap(self, m: np.ndarray, k: int, ahead: bool) -> tuple[int, int] | None:
        """Rows whose points at the frame beyond k, when exchanged, lower the cost most; the first such pair.

        Only rows with a point in the three frames around k can differ: of the rows without one, which are alike but
        for their gaps, the first of each kind stands for all. Pairs out of reach of each other are left out before
        any cost is computed, and costs are computed for ``PAIRS`` pairs at a time.
        """
        target = k + 1 if ahead else k - 1
        fill = []
        for value in (0, -1):  # a row with a point at the target, and without one
            with_ = m.copy()
            with_[:, target] = value
            fill.append(self.gaps_ok(with_))
        live = (m[:, k - 1 : k + 2] >= 0).any(1)
        empty = np.flatnonzero(~live)
        _, firsts = np.unique(np.stack([f[empty] for f in fill], 1), axis=0, return_index=True)
        rows = np.sort(np.concatenate([np.flatnonzero(live), empty[firsts]]))
        fill = [f[rows] for f in fill]
        m = m[rows]
        own, x = m[:, k], m[:, target]
        best, found = 1e-8, None
        now = self.cost(m[:, k - 1], own, x) if ahead else self.cost(x, own, m[:, k + 1])
        half = max(1, PAIRS // max(1, len(rows)))
        for lo in range(0, len(rows), half):
            one = np.arange(lo, min(lo + half, len(rows)))
            ok = (x[one][:, None] != x[None, :]) & (one[:, None] < np.arange(len(rows))[None, :])
            ok &= np.where(x[None, :] >= 0, fill[0][one][:, None], fill[1][one][:, None]) & np.where(x[one][:, None] >= 0, fill[0][None, :], fill[1][None, :])
            ok &= self.reach(own[one], x) & self.reach(own, x[one]).T
            i, j = np.nonzero(ok)
            i = one[i]
            if not len(i):
                continue
            if ahead:
                ends = (m[i, k - 1], own[i], x[j]), (m[j, k - 1], own[j], x[i])
            else:
                ends = (x[j], own[i], m[i, k + 1]), (x[i], own[j], m[j, k + 1])
            then = [self.cost(*e) for e in ends]
            gain = now[i] + now[j] - then[0] - then[1]
            gain = np.where(self.smooth(*ends[0], then[0]) & self.smooth(*ends[1], then[1]), gain, 0)
            at = int(gain.argmax())
            if gain[at] > best:
                best, found = gain[at], (int(rows[i[at]]), int(rows[j[at]]))
        return found

    def reach(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``near`` for every pair of two lists, as a matrix."""
        with np.errstate(invalid="ignore"):
            far = np.arccos(np.clip(self.p[a] @ self.p[b].T, -1, 1)) > 0.5 * (self.limit[a][:, None] + self.limit[b][None, :])
        return ~far | (a < 0)[:, None] | (b < 0)[None, :]

    def cut(self, m: np.ndarray, row: int, k: int, ahead: bool) -> np.ndarray:
        """Move what lies beyond frame k to a new row if the step from k is too long."""
        to = k + 1 if ahead else k - 1
        if self.near(m[row, k], m[row, to]):
            return m
        new, part = np.full(self.frames, -1), slice(to, None) if ahead else slice(0, k)
        new[part] = m[row, part]
        m[row, part] = -1
        return np.vstack([m, new])

    def run(self) -> np.ndarray:
        if self.frames < 2:
            return np.zeros((0, self.frames), int)
        m = self.broken(self.initial())
        for _ in range(self.rules.iterations):
            changed = False
            for ahead, ks in ((True, range(1, self.frames - 1)), (False, range(self.frames - 2, 0, -1))):
                for k in ks:
                    if swap := self.best_swap(m, k, ahead):
                        i, j = swap
                        target = k + 1 if ahead else k - 1
                        m[[i, j], target] = m[[j, i], target]
                        changed = True
                        if 0 < target < self.frames - 1:
                            m = self.cut(self.cut(m, i, target, ahead), j, target, ahead)
            if not changed:
                break
        return m

    def tracks(self, m: np.ndarray) -> list[list[tuple[int, int]]]:
        """(frame, feature) lists in row order, split where a gap exceeds ``max_missing``."""
        out = []
        for row in m:
            points, last = [], None
            for k in np.flatnonzero(row >= 0):
                if last is not None and self.rules.max_missing >= 0 and k - last - 1 > self.rules.max_missing:
                    out.append(points)
                    points = []
                points.append((int(k), int(row[k])))
                last = k
            if points:
                out.append(points)
        return out


def exchange_link(centers: DataFrame, steps: DataFrame, rules: Rules | None = None, chunk: int | None = None, overlap: int = 3) -> DataFrame:
    """(chunk, track_id, step, t, lat, lon, v): tracks of each chunk of frames, ids from 1 in a chunk.

    ``centers`` has (t, c_idx, lat, lon, v); ``steps`` every frame's t. Chunks of ``chunk`` frames share ``overlap``;
    tracks of fewer than ``min_lifetime`` points go, and the others are numbered without gaps.
    """
    rules = rules or Rules()
    if chunk is not None and chunk <= overlap:
        raise ValueError("chunk must be longer than overlap")
    times = [r["t"] for r in steps.select("t").distinct().orderBy("t").collect()]  # one value a frame
    bounds, start = [], 0
    while times:
        stop = min(start + (chunk or len(times)), len(times))
        bounds.append((start, stop))
        if stop == len(times):
            break
        start = stop - overlap
    kind = steps.schema["t"].dataType.simpleString()
    plan = centers.sparkSession.createDataFrame([(t, c, k) for c, (lo, hi) in enumerate(bounds) for k, t in enumerate(times[lo:hi])], f"t {kind}, chunk int, k int")
    c = plan.join(centers.select("t", "c_idx", "lat", "lon", "v"), "t", "left")
    c = c.repartition(max(1, min(len(bounds), 10_000)), "chunk")  # few bytes, but much work: a task for each, about

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["k", "c_idx"], kind="stable")
        own = g[g["c_idx"].notna()].reset_index(drop=True)
        n = bounds[key[0]][1] - bounds[key[0]][0]
        ex = Exchange([(f["lat"].to_numpy(), f["lon"].to_numpy()) for f in (own[own["k"] == k] for k in range(n))], rules)
        found = [x for x in ex.tracks(ex.run()) if len(x) >= rules.min_lifetime]
        rows = [(key[0], i, s, own["t"][f], own["lat"][f], own["lon"][f], own["v"][f]) for i, x in enumerate(found, 1) for s, (_, f) in enumerate(x, 1)]
        return pd.DataFrame(rows, columns=["chunk", "track_id", "step", "t", "lat", "lon", "v"])

    return c.groupBy("chunk").applyInPandas(run, f"chunk int, track_id long, step int, t {kind}, lat double, lon double, v double")
