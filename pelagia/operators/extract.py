"""Extraction of points and boxes by cell index, so that filters reach the scan."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import COORD_DIGITS, FIELD_DIGITS, half_even
from ..messages import BAD_VALUES


ONE_PLACE = 1_000_000


def output(fields: list[str], truncate: bool) -> list[Column]:
    """Coordinates and fields as doubles, perhaps rounded; a field that is asked for twice comes once."""
    coord = (lambda x: half_even(x, COORD_DIGITS)) if truncate else (lambda x: F.col(x).cast("double"))
    field = (lambda x: half_even(x, FIELD_DIGITS)) if truncate else (lambda x: F.col(x).cast("double"))
    return [coord("lon").alias("lon"), coord("lat").alias("lat"), F.col("date"), *(field(f).alias(f) for f in dict.fromkeys(fields))]


def point_cells(grid: DataFrame, days: list[dt.date], lon_idx: int, lat_idx: int, fields: list[str], truncate: bool = False) -> DataFrame:
    """A cell on some days, ascending by date."""
    found = grid.filter(F.col("date").isin(days) & (F.col("lat_idx") == lat_idx) & (F.col("lon_idx") == lon_idx))
    return found.select(*output(fields, truncate)).repartition(1).sortWithinPartitions("date")  # some days


def box_cells(grid: DataFrame, day: dt.date, i0: int, i1: int, j0: int, j1: int, stride: int = 1) -> DataFrame:
    """Cells lon_idx i0..i1 and lat_idx j0..j1 of a day, both ends included; of each axis every stride-th from the first."""
    found = grid.filter((F.col("date") == F.lit(day)) & F.col("lat_idx").between(j0, j1) & F.col("lon_idx").between(i0, i1))
    if stride > 1:
        found = found.filter((F.pmod(F.col("lat_idx") - j0, F.lit(stride)) == 0) & (F.pmod(F.col("lon_idx") - i0, F.lit(stride)) == 0))
    return found


def box_rows(cells: DataFrame, fields: list[str], truncate: bool = False, count: int | None = None) -> DataFrame:
    """Latitude by latitude, then by longitude, both ascending. Up to ONE_PLACE cells (by plan) are sorted in one place, since a range sort would read them twice."""
    small = count is not None and count <= ONE_PLACE
    sort = cells.repartition(1).sortWithinPartitions("lat_idx", "lon_idx") if small else cells.orderBy("lat_idx", "lon_idx")
    return sort.select(*output(fields, truncate))


def box_mean(cells: DataFrame, fields: list[str]) -> DataFrame:
    """One row: the unweighted mean of the non-null values of each field. Infinite values are an error; NaN is null in the store."""
    bad = lambda f: F.max(F.when(F.isnan(f) | (F.abs(F.col(f)) == float("inf")), True))
    mean = lambda f: F.when(bad(f), F.raise_error(F.lit(BAD_VALUES.format(field=f)))).otherwise(F.avg(F.col(f).cast("double")))
    return cells.agg(*(mean(f).cast("double").alias(f) for f in fields))


def daily_means(cells: DataFrame, fields: list[str]) -> DataFrame:
    """A row for each day: the means of the non-null values, as box_mean has them, and ``cells``, how many values the first field has."""
    return cells.groupBy("date").agg(*(F.avg(F.col(f).cast("double")).alias(f) for f in fields), F.count(fields[0]).alias("cells"))


def box_percentile(cells: DataFrame, field: str, share: float, accuracy: int | None = None) -> DataFrame:
    """One row: a percentile of the non-null values. Exact values are held by their distinct number; with ``accuracy`` (the inverse of the error in rank) memory is bounded, for
    large boxes."""
    value = F.col(field).cast("double")
    return cells.agg((F.percentile(value, share) if accuracy is None else F.percentile_approx(value, share, accuracy)).alias(field))
