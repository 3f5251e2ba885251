"""Connected objects of a frame: a kernel by frame, which are independent of each other."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..sources.fields import Grid


def label_mask(mask: np.ndarray) -> np.ndarray:
    """Labels 1..N of a 2-D mask's 8-connected objects, columns wrapped, in order of their first cell; 0 outside."""
    rows, cols = mask.shape
    none = rows * cols
    label = np.where(mask, np.arange(none).reshape(rows, cols), none)
    while True:
        wide = np.minimum(label, np.minimum(np.roll(label, 1, 1), np.roll(label, -1, 1)))
        tall = wide.copy()
        tall[1:] = np.minimum(tall[1:], wide[:-1])
        tall[:-1] = np.minimum(tall[:-1], wide[1:])
        new = np.where(mask, tall, none)
        flat = np.append(new.ravel(), none)
        new = np.where(mask, flat[flat[new]], none)  # a label's own label: long objects need few rounds
        if (new == label).all():
            break
        label = new
    names = np.unique(label[mask])
    return np.where(mask, np.searchsorted(names, label) + 1, 0)


def label_objects(masked: DataFrame, grid: Grid) -> DataFrame:
    """(t, i, j, v, label) of cells of a mask. A task holds one frame of at most nlat * nlon cells."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        mask = np.zeros((grid.nlat, grid.nlon), bool)
        mask[frame["i"], frame["j"]] = True
        return frame.assign(label=label_mask(mask)[frame["i"], frame["j"]])

    kind = masked.schema["t"].dataType.simpleString()
    return masked.select("t", "i", "j", "v").groupBy("t").applyInPandas(run, f"t {kind}, i int, j int, v double, label int")
