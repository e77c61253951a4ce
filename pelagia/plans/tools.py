"""Tools over a store: a point's value and a box's mean, with the nearest bound as a stand-in for a missing day, and tide forecasts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import messages as say
from ..errors import NotFound, ToolError
from ..functions import params
from ..operators import extract, tides
from ..sources.store import GridStore
from .requests import box_indices, left


def _standing_in(store: GridStore, asked: dt.date, nearest: bool) -> tuple[dt.date, bool]:
    """The day to read and whether it stands in for the one asked. Only the two bounds can stand in, and only within the tolerance."""
    days = store.calendar()
    earliest, latest = days[0], days[-1]
    if asked in days:
        return asked, False
    if not nearest:
        raise NotFound(say.NO_DATA_IN_PERIOD.format(earliest=earliest, latest=latest))
    other, most = params.fallback_date(asked, earliest, latest), store.config.nearest_days
    away = abs((other - asked).days)
    if away > most:
        raise NotFound(say.TOO_FAR.format(asked=asked, other=other, away=away, most=most))
    if other == asked:
        raise NotFound(say.ALSO_UNAVAILABLE.format(asked=asked, other=other))
    return other, True


def _noted(df: DataFrame, asked: dt.date | None, stood_in: bool) -> DataFrame:
    return df.withColumn("requested_date", F.lit(asked if stood_in else None).cast("date")).withColumn("method", F.lit("nearest" if stood_in else None).cast("string"))


def point_value(store: GridStore, longitude: float, latitude: float, date: str | None = None, fields: list[str] | None = None, method: str = "exact") -> DataFrame:
    """One row: region (the coordinates asked for), date, fields, and what was asked if a bound stands in. Without a date, the latest day. A cell that the day lacks is an error."""
    params.tool_point(longitude, latitude)
    nearest, names = params.tool_method(method), params.tool_fields(fields, store.config.tool_fields)
    asked = params.tool_date(date) if date is not None else None
    day, stood_in = _standing_in(store, asked, nearest) if asked else (store.span()[1], False)
    i, j = store.nearest(longitude, latitude)
    cell = extract.point_cells(store.cells([day], i, i, j, j, names), [day], i, j, names).select("date", *names)
    found = cell.limit(1).collect()  # one row; a tool says so if there is none
    if not found:
        raise NotFound(say.NO_POINT)
    region = F.array(F.lit(float(longitude)), F.lit(float(latitude))).alias("region")
    return _noted(cell.sparkSession.createDataFrame(found, cell.schema).select(region, "date", *names), asked, stood_in)


def bbox_mean(store: GridStore, bbox: list[float], date: str, fields: list[str] | None = None, method: str = "exact") -> DataFrame:
    """One row: region (the box), date, sample (the stride), the mean of each field, and what was asked if a bound stands in.

    The stride is estimated from the nominal step, and doubled while the snapped box has too many cells: arithmetic, before anything is read."""
    lon0, lat0, lon1, lat1 = params.tool_bbox(bbox)
    asked = params.tool_date(date)
    nearest, names = params.tool_method(method), params.tool_fields(fields, store.config.tool_fields)
    day, stood_in = _standing_in(store, asked, nearest)
    i0, i1, j0, j1 = box_indices(store, lon0, lat0, lon1, lat1)
    c = store.config
    stride = params.fitting_stride(params.stride_estimate(lon0, lat0, lon1, lat1, c.degrees_per_cell, c.point_limit), left(i0, i1, 1), left(j0, j1, 1), c.point_limit, c.stride_attempts)
    mean = extract.box_mean(extract.box_cells(store.cells([day], i0, i1, j0, j1, names), day, i0, i1, j0, j1, stride), names)
    region = F.array(*(F.lit(x) for x in (lon0, lat0, lon1, lat1))).alias("region")
    return _noted(mean.select(region, F.lit(day).alias("date"), F.lit(stride).alias("sample"), *names), asked, stood_in)


def tide_forecast(spark: SparkSession, fetch: Callable[[dict], str], longitude: float, latitude: float, tz: str, date: str | None = None, query_time: str | None = None) -> DataFrame:
    """One row, as operators.tides.forecast gives it. ``fetch`` gets lon, lat, date and tz, and returns the backend's JSON document."""
    if not (-180 <= longitude <= 180 and -90 <= latitude <= 90):
        raise ToolError(say.COORDS_OUT)
    zone, name, unchosen = params.timezone(tz)
    at = params.iso_datetime(query_time) if query_time else None
    if at is not None:
        at = (at if at.tzinfo else at.replace(tzinfo=zone)).astimezone(zone)
    day = params.tool_date(date) if date else (at or dt.datetime.now(zone)).date()
    offset = params.offset_on(zone, day)
    document = fetch({"lon": longitude, "lat": latitude, "date": day.isoformat(), "tz": name or offset})
    row = (float(longitude), float(latitude), day, at.isoformat() if at else None, at.date() if at else None, offset, name, unchosen, document)
    rows = spark.createDataFrame([row], "lon double, lat double, date date, query_time string, query_date date, offset string, tz_name string, zone_note boolean, document string")
    parsed = rows.select(F.size(F.from_json("document", tides.SCHEMA)["days"]).alias("n"), F.try_parse_json("document").isNull().alias("bad")).first()
    if parsed["bad"]:
        raise ToolError(say.TIDE_BAD_JSON)
    if not parsed["n"] or parsed["n"] < 1:
        raise ToolError(say.TIDE_EMPTY)
    return tides.forecast(rows)
