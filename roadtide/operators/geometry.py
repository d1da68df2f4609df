"""Polyline jobs over tables of ways."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadtide.functions.columns import MI_PER_LAT, MI_PER_LON

#: Metres of a mile (fixed value).
M_PER_MI = 1609.344


def simplify(ways: DataFrame, tolerance_m: float = 25.0) -> DataFrame:
    """way_id, points of array<struct<lat, lon>> without those that lie within the tolerance of the line left.

    Between two points that stay, the farthest from their line stays too if it is beyond the tolerance; a round settles
    one point in every open stretch. Distances are planar, in the miles a degree that matching uses. Each way is worked on
    where it lies.
    """

    def kept(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        # All points of a round are measured at once against the stretch of kept points that they lie in.
        x, y = lon * MI_PER_LON * M_PER_MI, lat * MI_PER_LAT * M_PER_MI
        keep = np.zeros(len(lat), bool)
        keep[[0, -1]] = True
        while True:
            marks = np.flatnonzero(keep)
            stretch = np.clip(np.searchsorted(marks, np.arange(len(lat)), side="right") - 1, 0, len(marks) - 2)
            a, b = marks[stretch], marks[stretch + 1]
            ux, uy = x[b] - x[a], y[b] - y[a]
            long = np.hypot(ux, uy)
            across = np.abs(ux * (y - y[a]) - uy * (x - x[a])) / np.where(long > 0, long, 1)
            off = np.where(keep, 0.0, np.where(long > 0, across, np.hypot(x - x[a], y - y[a])))
            most = np.maximum.reduceat(off, marks[:-1])
            far = (off > tolerance_m) & (off == most[stretch])
            if not far.any():
                return keep
            # Of equally far points of a stretch the first.
            at = np.flatnonzero(far)
            keep[at[np.unique(stretch[at], return_index=True)[1]]] = True

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for points in batch["points"]:
                if points is None or len(points) < 3:
                    out.append(points)
                    continue
                lat, lon = (np.array([p[k] for p in points], float) for k in ("lat", "lon"))
                out.append([p for p, k in zip(points, kept(lat, lon), strict=True) if k])
            yield pd.DataFrame({"way_id": batch["way_id"], "points": out})

    shape = "array<struct<lat:double,lon:double>>"
    return ways.select(F.col("way_id").cast("long").alias("way_id"), F.col("points").cast(shape).alias("points")).mapInPandas(run, f"way_id long, points {shape}")
