"""Point and box requests to a store, with its checks in a fixed order: fields, modes, kind, any data, dates, days, stride, size."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .. import messages as say
from ..errors import BadRequest
from ..functions import params
from ..operators import extract
from ..sources.store import GridStore


@dataclass(frozen=True)
class Box:
    """A resolved box: its day, the index range of both axes, the stride and the number of cells it leaves."""

    day: dt.date
    i0: int
    i1: int
    j0: int
    j1: int
    stride: int
    cells: int


def box_indices(store: GridStore, lon0: float, lat0: float, lon1: float, lat1: float) -> tuple[int, int, int, int]:
    """Corners in any order, snapped to their nearest cells; both ends belong to the box. A box never crosses the antimeridian."""
    i0, j0 = store.nearest(min(lon0, lon1), min(lat0, lat1))
    i1, j1 = store.nearest(max(lon0, lon1), max(lat0, lat1))
    return min(i0, i1), max(i0, i1), min(j0, j1), max(j0, j1)


def left(first: int, last: int, stride: int) -> int:
    return (last - first) // stride + 1


def plan_box(store: GridStore, lon0: float, lat0: float, lon1: float, lat1: float, start: str | None = None, end: str | None = None, sample: int = 1) -> Box:
    """``start`` counts if both dates are given, and then ``end`` isn't read; without a date the latest day is taken."""
    days = store.calendar()
    earliest, latest = days[0], days[-1]
    day = params.request_date(start or end) if start or end else latest
    if day not in days:
        raise BadRequest(say.BOX_DAY_MISSING.format(day=day, earliest=earliest, latest=latest))
    i0, i1, j0, j1 = box_indices(store, lon0, lat0, lon1, lat1)
    if sample < 1:
        raise BadRequest(say.SAMPLE_TOO_SMALL)
    cells = left(i0, i1, sample) * left(j0, j1, sample)
    if cells > store.config.point_limit:
        raise BadRequest(say.TOO_MANY_POINTS.format(cells=cells, limit=store.config.point_limit))
    return Box(day, i0, i1, j0, j1, sample, cells)


def box(store: GridStore, lon0: float, lat0: float, lon1: float, lat1: float, start: str | None = None, end: str | None = None, append: str | None = None, sample: int = 1, mode: str | None = None) -> DataFrame:
    """The cells of a box on one day: lon, lat, date and fields."""
    return box_served(store, lon0, lat0, lon1, lat1, start, end, append, sample, mode)[0]


def box_served(store: GridStore, lon0: float, lat0: float, lon1: float, lat1: float, start: str | None = None, end: str | None = None, append: str | None = None, sample: int = 1, mode: str | None = None) -> tuple[DataFrame, Box, Observation]:
    """A box's cells with its plan, and an observation that has ``served``, the number of rows, once the cells have been read: no second pass."""
    params.finite(lon0, lat0, lon1, lat1)
    fields, modes = params.request_fields(append, store.config.fields), params.request_modes(mode)
    b = plan_box(store, lon0, lat0, lon1, lat1, start, end, sample)
    seen = Observation()
    rows = extract.box_rows(extract.box_cells(store.cells([b.day], b.i0, b.i1, b.j0, b.j1, fields), b.day, b.i0, b.i1, b.j0, b.j1, b.stride), fields, "truncate" in modes, b.cells)
    return rows.observe(seen, F.count(F.lit(1)).alias("served")), b, seen  # after the sort, which reads its input twice


def point(store: GridStore, lon0: float, lat0: float, start: str | None = None, end: str | None = None, append: str | None = None, mode: str | None = None) -> DataFrame:
    """The nearest cell on each existing day of a range: lon, lat, date and fields, ascending by date."""
    params.finite(lon0, lat0)
    fields, modes = params.request_fields(append, store.config.fields), params.request_modes(mode)
    known = store.calendar()
    earliest, latest = known[0], known[-1]
    days = sorted(set(known) & set(params.point_dates(params.request_date(start), params.request_date(end), earliest, latest, store.config.max_days)))
    if not days:
        raise BadRequest(say.NO_DATA_IN_PERIOD.format(earliest=earliest, latest=latest))
    i, j = store.nearest(lon0, lat0)
    return extract.point_cells(store.cells(days, i, i, j, j, fields), days, i, j, fields, "truncate" in modes)


def read(store: GridStore, lon0: float, lat0: float, lon1: float | None = None, lat1: float | None = None, start: str | None = None, end: str | None = None, append: str | None = None, sample: int = 1, mode: str | None = None) -> DataFrame:
    """A box if the second corner is given and differs from the first; else a point, also if only half a corner is given."""
    if lon1 is not None and lat1 is not None and (lon1, lat1) != (lon0, lat0):
        return box(store, lon0, lat0, lon1, lat1, start, end, append, sample, mode)
    params.request_fields(append, store.config.fields)
    params.request_modes(mode)
    if sample != 1:
        raise BadRequest(say.SAMPLE_IN_POINT)
    return point(store, lon0, lat0, start, end, append, mode)
