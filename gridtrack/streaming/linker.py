"""Linking of a stream of detections, step by step, by dataset: the open track ends are the state.

Beyond the batch engine: each dataset's steps must arrive in order of time; a step's centres come in one batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.geo import LINK_RADIUS_KM

OUT = "dataset string, track_id long, t long, lat double, lon double, v double"
STATE = "next_id long, t long, ids array<long>, lats array<double>, lons array<double>"


def pair_step(ends: tuple[np.ndarray, np.ndarray, np.ndarray], lat: np.ndarray, lon: np.ndarray, next_id: int, within_km: float) -> tuple[np.ndarray, int]:
    """Track ids of a step's centres: those of the nearest open ends, else new ones."""
    ids = np.full(len(lat), -1, np.int64)
    old, la, lo = ends
    if len(old) and len(lat):
        a, b = np.radians(la)[:, None], np.radians(lat)[None, :]
        s = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon[None, :] - lo[:, None]) / 2) ** 2
        d = 2 * LINK_RADIUS_KM * np.arcsin(np.sqrt(np.minimum(s, 1)))
        used: set[int] = set()
        for at in np.argsort(d, axis=None, kind="stable"):
            i, j = divmod(int(at), len(lat))
            if d[i, j] >= within_km:
                break
            if i not in used and ids[j] < 0:
                used.add(i)
                ids[j] = old[i]
    new = np.flatnonzero(ids < 0)
    ids[new] = next_id + np.arange(len(new))
    return ids, next_id + len(new)


def link_stream(centers: DataFrame, within_km: float = 500.0) -> DataFrame:
    """Track points of a stream (dataset, t, lat, lon, v), t counting steps; a missing step ends all tracks."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        next_id, last, ids, lats, lons = state.get if state.exists else (1, None, [], [], [])
        ends = (np.array(ids, np.int64), np.array(lats, float), np.array(lons, float))
        rows = pd.concat(list(batches)).sort_values(["t", "lat", "lon"], kind="stable")
        for t, g in rows.groupby("t"):
            if last is None or t != last + 1:
                ends = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
            lat, lon = g["lat"].to_numpy(), g["lon"].to_numpy()
            own, next_id = pair_step(ends, lat, lon, next_id, within_km)
            ends, last = (own, lat, lon), int(t)
            yield pd.DataFrame({"dataset": key[0], "track_id": own, "t": t, "lat": lat, "lon": lon, "v": g["v"].to_numpy()})
        state.update((next_id, last, ends[0].tolist(), ends[1].tolist(), ends[2].tolist()))

    return centers.groupBy("dataset").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
