"""Nearest cells for many points at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clamp
from ..sources.store import LONGEST_AXIS


def nearest_on_axis(points: DataFrame, axis: DataFrame, value: str, idx: str, coord: str) -> DataFrame:
    """``points`` with column ``idx``: the index of the axis cell nearest to column ``value``, by 32-bit distance, the lower index of two equally near ones.

    On an ascending, even axis the nearest cell is among the four around the value's place, so each value is joined with four candidates by index, against
    a broadcast axis (its length is checked); the least (distance, index) of the four is taken by position in the same row. Other axes are searched in numpy by batches."""
    rows = sorted({(r[0], r[1]) for r in axis.select(idx, F.col(coord).cast("float")).limit(LONGEST_AXIS + 1).collect()})
    n = len(rows)
    if not n or n > LONGEST_AXIS:
        raise ValueError(f"an axis of {n} cells can't be used")
    first, low, high = rows[0][0], min(r[1] for r in rows), max(r[1] for r in rows)
    values = np.array([r[1] for r in rows], np.float32)
    indices = np.array([r[0] for r in rows], np.int64)
    clamped = clamp(F.col(value), F.lit(float(low)).cast("double"), F.lit(float(high)).cast("double")).cast("float")
    step = (float(high) - float(low)) / max(1, n - 1)
    even = n > 1 and np.array_equal(indices, first + np.arange(n)) and np.abs(values.astype(np.float64) - (float(low) + step * np.arange(n))).max() < step / 2
    if not even:
        order = np.argsort(values, kind="stable")

        @F.pandas_udf("int")
        def search(v: pd.Series) -> pd.Series:
            x = v.to_numpy(np.float32)
            at = np.clip(np.searchsorted(values[order], x), 1, max(1, n - 1))
            pick = lambda k: order[np.clip(k, 0, n - 1)]
            a, b = pick(at - 1), pick(at)
            da, db = np.abs(values[a] - x), np.abs(values[b] - x)
            return pd.Series(indices[np.where((da < db) | ((da == db) & (indices[a] < indices[b])), a, b)].astype(np.int32))

        return points.withColumn(idx, search(clamped))
    lookup = F.broadcast(axis.sparkSession.createDataFrame([(0, [float(x) for x in values])], "_k int, _axis array<float>"))
    place = F.floor((clamped.cast("double") - F.lit(float(low))) / F.lit(step)).cast("int")
    near = lambda k: F.greatest(F.lit(0), F.least(F.lit(n - 1), place + k))
    best = F.array_min(F.array(*(F.struct(F.abs(F.get("_axis", near(k)) - clamped).alias("d"), (near(k) + first).alias("i")) for k in (-1, 0, 1, 2))))
    # one row on the right: a join on a constant, not a product of rows
    return points.withColumn("_k", F.lit(0)).join(lookup, "_k").withColumn(idx, best["i"].cast("int")).drop("_k", "_axis")


def nearest_cells(points: DataFrame, lon_axis: DataFrame, lat_axis: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """``points`` with lon_idx and lat_idx of the nearest cell; coordinates beyond the axes count as their ends."""
    return nearest_on_axis(nearest_on_axis(points, lon_axis, lon, "lon_idx", "lon"), lat_axis, lat, "lat_idx", "lat")
