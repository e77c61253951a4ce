"""A query for each operator, over the fixtures: what the driver runs and holds against SQL (oracles.py, written on its own)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures
from .config import GridConfig
from .errors import PelagiaError
from .functions import columns as fc
from .functions import params
from .operators import extract, nearest, parity, tides
from .pipeline import ingest
from .plans import requests, tools
from .sources import granules, index, rows, zarr
from .sources.fetch import retrying
from .sources.store import GridStore
from .streaming import arrivals

Query = Callable[[SparkSession, str], DataFrame]
DAY = "2024-01-10"


def _rows(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame([*rows], schema)


def catalog_bounds(s: SparkSession, d: str) -> DataFrame:
    return fixtures.store(s, d).bounds()


def catalog_days(s: SparkSession, d: str) -> DataFrame:
    return fixtures.store(s, d).days.orderBy("date")


def catalog_gaps(s: SparkSession, d: str) -> DataFrame:
    return fixtures.store(s, d).gaps()


def axis_bounds(s: SparkSession, d: str) -> DataFrame:
    return fixtures.store(s, d).axis_bounds()


def index_merge(s: SparkSession, d: str) -> DataFrame:
    """The bounds with one day more, for an early, an inner and a late day."""
    new = _rows(s, "day date", (dt.date(2023, 12, 30),), (dt.date(2024, 1, 15),), (dt.date(2024, 2, 2),))
    return index.merged(fixtures.store(s, d).bounds().crossJoin(new), F.col("day"))  # one row of bounds


def nearest_index_bulk(s: SparkSession, d: str) -> DataFrame:
    st = fixtures.store(s, d)
    return nearest.nearest_cells(fixtures.points(s, d), st.lon_axis, st.lat_axis).select("c_custkey", "lon_idx", "lat_idx")


def clamp_points(s: SparkSession, d: str) -> DataFrame:
    st = fixtures.store(s, d)
    b = st.axis_bounds().select(*(F.col(x).cast("double") for x in ("lon_min", "lon_max", "lat_min", "lat_max")))
    p = fixtures.points(s, d).crossJoin(F.broadcast(b))  # one row of bounds
    return p.select("c_custkey", fc.clamp(F.col("lon"), F.col("lon_min"), F.col("lon_max")).alias("lon"), fc.clamp(F.col("lat"), F.col("lat_min"), F.col("lat_max")).alias("lat"))


def point_latest(s: SparkSession, d: str) -> DataFrame:
    return requests.read(fixtures.store(s, d), 120.021, 20.009)


def point_range(s: SparkSession, d: str) -> DataFrame:
    return requests.read(fixtures.store(s, d), 120.021, 20.009, start="2024-01-05", end="2024-01-16")


def point_range_reversed(s: SparkSession, d: str) -> DataFrame:
    return requests.read(fixtures.store(s, d), 120.021, 20.009, start="2024-01-16", end="2024-01-05")


def point_range_capped(s: SparkSession, d: str) -> DataFrame:
    """A range that begins before the store, clamped and cut to ten days."""
    return requests.read(fixtures.store(s, d, GridConfig(max_days=10)), 120.021, 20.009, start="2023-01-01", end="2025-01-01")


def point_all_fields(s: SparkSession, d: str) -> DataFrame:
    return requests.read(fixtures.store(s, d), 119.0, 25.0, start=DAY, append="sst,sst_anomaly,sea_ice")


def point_truncate(s: SparkSession, d: str) -> DataFrame:
    return requests.read(fixtures.store(s, d), 120.03, 20.02, start="2024-01-01", end="2024-01-30", append="sst,sst_anomaly,sea_ice", mode="Truncate")


def bbox_day(s: SparkSession, d: str) -> DataFrame:
    return requests.read(fixtures.store(s, d), 120.008, 19.996, 120.031, 20.021, start=DAY, end="2099-01-01", append="sst,sst_anomaly")


def bbox_stride(s: SparkSession, d: str) -> DataFrame:
    return requests.read(fixtures.store(s, d), 120.0, 20.0, 120.04, 20.02, start=DAY, sample=2, append="sst,sea_ice")


def bbox_reversed_corners(s: SparkSession, d: str) -> DataFrame:
    return requests.read(fixtures.store(s, d), 120.031, 20.021, 120.008, 19.996, start=DAY, append="sst,sst_anomaly")


def bbox_clamped(s: SparkSession, d: str) -> DataFrame:
    """The whole grid: all corners lie beyond the axes, also where many users make the fixture's rows pass 90 degrees."""
    st = fixtures.store(s, d)
    _, lons, _, lats = st.axes
    low, high = (min(-180.0, float(lons.min()) - 1), min(-90.0, float(lats.min()) - 1)), (max(180.0, float(lons.max()) + 1), max(90.0, float(lats.max()) + 1))
    return requests.read(st, *low, *high, start=DAY)


def bbox_line(s: SparkSession, d: str) -> DataFrame:
    return requests.read(fixtures.store(s, d), 120.02, 20.0, 120.02, 20.02, start=DAY)


def bbox_truncate(s: SparkSession, d: str) -> DataFrame:
    return requests.read(fixtures.store(s, d), 120.0, 20.0, 120.04, 20.02, start=DAY, append="sst,sst_anomaly,sea_ice", mode="truncate")


def bbox_cardinality(s: SparkSession, d: str) -> DataFrame:
    """Cells that a box leaves at a stride: planned by arithmetic, and counted."""
    st = fixtures.store(s, d)
    b = requests.plan_box(st, 120.0, 20.0, 120.04, 20.02, start=DAY, sample=2)
    return extract.box_cells(st.grid, b.day, b.i0, b.i1, b.j0, b.j1, b.stride).agg(F.count(F.lit(1)).alias("served")).withColumn("planned", F.lit(b.cells).cast("long"))


def _mean(df: DataFrame) -> DataFrame:
    return df.select("date", F.col("sample").cast("long").alias("sample"), *(F.round(c, 6).alias(c) for c in df.columns if c.startswith("sst")))


def bbox_mean_day(s: SparkSession, d: str) -> DataFrame:
    return _mean(tools.bbox_mean(fixtures.store(s, d), [120.0, 20.0, 120.04, 20.02], DAY, ["sst", "sst_anomaly"]))


def bbox_mean_strided(s: SparkSession, d: str) -> DataFrame:
    return _mean(tools.bbox_mean(fixtures.store(s, d, GridConfig(point_limit=6)), [120.0, 20.0, 120.04, 20.02], DAY, ["sst"]))


def bbox_mean_all_null(s: SparkSession, d: str) -> DataFrame:
    st = fixtures.store(s, d)
    cells = st.grid.filter(F.col("date") == DAY).withColumn("sst", F.when(F.lit(False), F.col("sst")))
    return extract.box_mean(cells, ["sst"])


def bbox_mean_by_day(s: SparkSession, d: str) -> DataFrame:
    st = fixtures.store(s, d)
    i0, i1, j0, j1 = requests.box_indices(st, 120.0, 20.0, 120.04, 20.02)
    cells = st.grid.filter(F.col("lat_idx").between(j0, j1) & F.col("lon_idx").between(i0, i1))
    return extract.daily_means(cells, ["sst"]).select("date", F.round("sst", 6).alias("sst"), "cells")


def bbox_percentile_anomaly(s: SparkSession, d: str) -> DataFrame:
    """The 90th percentile of a day's anomalies in a box."""
    st = fixtures.store(s, d)
    b = requests.plan_box(st, 120.0, 20.0, 120.04, 20.02, start=DAY)
    cells = extract.box_cells(st.grid, b.day, b.i0, b.i1, b.j0, b.j1)
    return extract.box_percentile(cells, "sst_anomaly", 0.9).select(F.round("sst_anomaly", 6).alias("p90"))


def mean_fallback(s: SparkSession, d: str) -> DataFrame:
    """A day after the last one, for which the latest bound stands in."""
    out = tools.bbox_mean(fixtures.store(s, d), [120.0, 20.0, 120.04, 20.02], "2024-02-02", ["sst"], "nearest")
    return out.select("date", "requested_date", "method", F.round("sst", 6).alias("sst"))


def point_tool(s: SparkSession, d: str) -> DataFrame:
    out = tools.point_value(fixtures.store(s, d), 120.021, 20.009, "2023-12-28", ["sst", "sst_anomaly"], "nearest")
    return out.select(F.element_at("region", 1).alias("lon"), F.element_at("region", 2).alias("lat"), "date", "sst", "sst_anomaly", "requested_date", "method")


_BOXES = ((1, 119.0, 20.0, 123.0, 26.0), (2, -180.0, -90.0, 180.0, 90.0), (3, 120.0, 20.0, 120.0, 21.0), (4, 130.0, 30.0, 120.0, 20.0), (5, 100.0, 0.0, 160.0, 60.0))


def stride_estimate(s: SparkSession, d: str) -> DataFrame:
    b = _rows(s, "box_id int, lon0 double, lat0 double, lon1 double, lat1 double", *_BOXES)
    return b.select("box_id", fc.stride_estimate(F.col("lon0"), F.col("lat0"), F.col("lon1"), F.col("lat1"), 0.01, 1_000_000).alias("stride"))


def stride_retry(s: SparkSession, d: str) -> DataFrame:
    b = _rows(s, "nx long, ny long, cap long", (1000, 1000, 1_000_000), (1001, 1000, 1_000_000), (6001, 6001, 1_000_000), (34850, 2324, 1_000_000))
    zero = F.lit(0.0)  # boxes of nx by ny cells, a degree each
    first = fc.stride_estimate(zero, zero, F.col("nx") - 1.0, F.col("ny") - 1.0, 1.0, 1_000_000).cast("long")
    return b.select("nx", "ny", first.alias("estimate"), fc.fitting_stride(first, F.col("nx"), F.col("ny"), 1_000_000, 4).cast("long").alias("stride"))


def nearest_date_fallback(s: SparkSession, d: str) -> DataFrame:
    """For each calendar day around the store: what would stand in, and whether it is near enough."""
    asked = s.range(1).select(F.explode(F.sequence(F.lit("2023-12-20").cast("date"), F.lit("2024-02-10").cast("date"))).alias("asked"))
    b = asked.crossJoin(F.broadcast(fixtures.store(s, d).bounds()))  # one row of bounds
    b = b.withColumn("fallback", fc.fallback_date(F.col("asked"), F.col("earliest"), F.col("latest")))
    away = fc.days_apart(F.col("fallback"), F.col("asked"))
    return b.select("asked", "fallback", away.cast("long").alias("away"), ((away <= 7) & (F.col("fallback") != F.col("asked"))).alias("usable"))


def field_list_parse(s: SparkSession, d: str) -> DataFrame:
    rows = _rows(s, "k int, append string", (1, "sst"), (2, " sst , sst_anomaly "), (3, " , "), (4, "sst,sst,,sea_ice"), (5, ""))
    return rows.select("k", F.array_join(fc.comma_list("append"), "|").alias("fields"), F.size(fc.comma_list("append")).cast("long").alias("n"))


def available_range_parse(s: SparkSession, d: str) -> DataFrame:
    rows = _rows(s, "k int, t string", (1, "Data not exist; available range is 2024-01-01/2024-01-30."), (2, "Requested 2025-05-05; range 2024-02-02/2024-01-01"), (3, "none"), (4, "only 2024-01-01"))
    r = fc.available_range("t")
    return rows.select("k", F.get(r, F.lit(0)).alias("earliest"), F.get(r, F.lit(1)).alias("latest"))


def kelvin_to_celsius(s: SparkSession, d: str) -> DataFrame:
    return granules.normalise(fixtures.granules(s, d)).select("date", "lat_idx", "lon_idx", "sst", "sst_anomaly", "sea_ice")


def granule_date_parse(s: SparkSession, d: str) -> DataFrame:
    names = ("/in/20240105090000-L4-grid.nc", "s3a://b/x-20240131090000.nc", "/in/plain.nc", "/in/2024010509000-short.nc", "/in/20249905090000-bad.nc/")
    return _rows(s, "k int, path string", *enumerate(names)).select("k", fc.granule_date("path").alias("date"))


def backfill_pending(s: SparkSession, d: str) -> DataFrame:
    return ingest.pending(s, "2024-01-01", "2024-02-05", fixtures.store(s, d).days)


def backfill_existing(s: SparkSession, d: str) -> DataFrame:
    """Requested days that exist."""
    asked = s.range(1).select(F.explode(F.sequence(F.lit("2024-01-05").cast("date"), F.lit("2024-01-16").cast("date"))).alias("date"))
    return asked.join(fixtures.store(s, d).days, "date", "left_semi")


def retention_candidates(s: SparkSession, d: str) -> DataFrame:
    files = fixtures.table(s, d, "orders").select(F.concat(F.lit("granule-"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_orderdate").cast("timestamp").alias("modified"))
    return ingest.expired(files, dt.date(1996, 1, 1), 30).select("path")


def _parity_rows(s: SparkSession, d: str) -> DataFrame:
    """The cube against itself with every eleventh cell moved."""
    cube = fixtures.cube(s, d)
    moved = (F.col("lat_idx") * 5 + F.col("lon_idx")) % 11 == 0
    other = cube.withColumn("sst", F.when(moved, (F.col("sst") + F.col("lon_idx") * F.lit(0.5)).cast("float")).otherwise(F.col("sst")))
    return parity.differences(cube, other)


def verify_parity(s: SparkSession, d: str) -> DataFrame:
    return parity.summary(_parity_rows(s, d)).select("field", "compared", F.round("max_diff", 4).alias("max_diff"), "mismatches")


def verify_top_mismatches(s: SparkSession, d: str) -> DataFrame:
    return parity.worst(_parity_rows(s, d)).select("field", F.col("rank").cast("long").alias("rank"), F.round("diff", 4).alias("diff"))


def tide_highs_lows(s: SparkSession, d: str) -> DataFrame:
    return fixtures.tide_events(s, d).select("user_id", "local_date", "ts", "phen", fc.height(F.col("height_cm").cast("string"), F.lit(None).cast("string")).alias("height_cm"))


def _states(s: SparkSession, d: str) -> DataFrame:
    return tides.states(fixtures.tide_queries(s, d), fixtures.tide_events(s, d), ["user_id", "local_date"])


def tide_state(s: SparkSession, d: str) -> DataFrame:
    return _states(s, d).filter("state is not null").select("event_id", F.col("state.state_now").alias("state_now"), F.col("state.last_extreme.height_cm").alias("last_height"), F.col("state.next_extreme.height_cm").alias("next_height"))


def tide_countdown(s: SparkSession, d: str) -> DataFrame:
    return _states(s, d).filter("state is not null").select("event_id", F.col("state.since_extreme").alias("since_extreme"), F.col("state.until_extreme").alias("until_extreme"))


def sun_first_events(s: SparkSession, d: str) -> DataFrame:
    """The first rise and set of each station and day, out of all its events as a document would list them."""
    kind = F.when(F.col("event_type") == "signup", "Rise").when(F.col("event_type") == "view", "Set").otherwise(F.col("event_type"))
    e = fixtures.table(s, d, "events").select("user_id", F.col("ts").cast("date").alias("local_date"), F.struct("ts", kind.alias("phen"), F.col("ts").cast("string").alias("time")).alias("e"))
    listed = e.groupBy("user_id", "local_date").agg(F.array_sort(F.collect_list("e")).alias("events"))  # a day's events of a station
    found = listed.withColumn("sky", tides.sky(F.col("events")))
    return found.select("user_id", "local_date", *(F.col(f"sky.{k}").cast(dict(e.select("e.ts").dtypes)["ts"]).alias(k) for k in ("rise", "set")))


def tz_offset_at_noon(s: SparkSession, d: str) -> DataFrame:
    zones = ("Asia/Taipei", "America/New_York", "Europe/London", "Australia/Adelaide", "UTC")
    rows = _rows(s, "zone string, day date", *((z, x) for z in zones for x in (dt.date(2024, 1, 15), dt.date(2024, 7, 15))))
    minutes = fc.offset_at_noon(F.col("zone"), F.col("day"))
    return rows.select("zone", "day", minutes.cast("long").alias("minutes"), fc.offset_text(minutes).alias("utc_offset"))


def tz_numeric_parse(s: SparkSession, d: str) -> DataFrame:
    texts = ("+08:00", "8", "-5.5", "5.75", "-0:30", "+0800", "Nope/Zone", "", "23:59", "24")
    return _rows(s, "k int, tz string", *enumerate(texts)).select("k", fc.numeric_offset("tz").alias("minutes"), fc.offset_text(fc.numeric_offset("tz")).alias("utc_offset"))


def tide_messages(s: SparkSession, d: str) -> DataFrame:
    rows = _rows(s, "k int, status string, z boolean", (1, "", False), (2, "down", False), (3, None, True), (4, "down", True))
    m: Column = fc.tide_messages(F.col("status"), F.col("z"))
    return rows.select("k", F.size(m).cast("long").alias("n"), F.array_join(m, " | ").alias("messages"))


DOCUMENT = (
    '{"meta":{"lon":151.2,"lat":-33.9,"timezone":"+10:00","reference":"heights above mean level","status":""},"days":[{"local_date":"2024-08-19T00:00:00+10:00",'
    '"moonphase":{"closestphase":{"time":"2024-08-20T04:26:00+10:00","phase":"Full Moon"},"curphase":"Waxing Gibbous","fracillum":"98%"},'
    '"moon":[{"phen":"Set","time":"2024-08-19T05:41:00+10:00"},{"phen":"Rise","time":"2024-08-19T16:08:00+10:00"},{"phen":"Upper Transit","time":"2024-08-19T23:14:00+10:00"}],'
    '"sun":[{"phen":"Rise","time":"2024-08-19T06:27:00+10:00"},{"phen":"Set","time":"2024-08-19T17:31:00+10:00"}],'
    '"tide":[{"phen":"HIGH","time":"2024-08-19T07:12:05+10:00","height":61.4},{"phen":"LOW","time":"2024-08-19T13:05:50+10:00","height":-48.75},{"phen":"HIGH","time":"2024-08-19T19:30:10+10:00","height":72.3}]}]}'
)


def tide_document(s: SparkSession, d: str) -> DataFrame:
    """A day's document at an instant between a high and a low."""
    out = tools.tide_forecast(s, lambda _: DOCUMENT, 151.2, -33.9, "Australia/Brisbane", "2024-08-19", "2024-08-19T10:00:00+10:00")
    st = F.col("tide.state")
    return out.select("date", "timezone", "tz_name", F.size("tide.highs").cast("long").alias("highs"), F.size("tide.lows").cast("long").alias("lows"), F.col("sun.rise").alias("sun_rise"), F.col("moon.transit").alias("moon_transit"), F.col("moonphase.current").alias("phase"), st["state_now"].alias("state_now"), st["since_extreme"].alias("since_extreme"), st["until_extreme"].alias("until_extreme"))


def tile_layout(s: SparkSession, d: str) -> DataFrame:
    """Cells by storage tile, and back."""
    back = granules.cells_of(granules.tiles(fixtures.cube(s, d), 2))
    return back.filter(F.col("date") == DAY).select("lat_idx", "lon_idx", "sst")


def bench_mean_by_day(s: SparkSession, d: str) -> DataFrame:
    """Means of a box for every day of the larger grid."""
    cells = fixtures.bench_cube(s, d).filter(F.col("lat_idx").between(8, 40) & F.col("lon_idx").between(4, 50))
    return extract.daily_means(cells, ["sst"]).select("date", F.round("sst", 6).alias("sst"), "cells")


def index_fill(s: SparkSession, d: str) -> DataFrame:
    """Bounds where no index has been written: those of the manifest."""
    return index.read_index(s, f"{d}/no-such-index", fixtures.store(s, d).days)


# Over a store that was written by ingest, from granules in Kelvin.


def stored_cells(s: SparkSession, d: str) -> DataFrame:
    return fixtures.stored(s, d).grid.select("date", "lat_idx", "lon_idx", "sst", "sst_anomaly", "sea_ice")


def stored_box(s: SparkSession, d: str) -> DataFrame:
    return requests.read(fixtures.stored(s, d), 120.0, 20.0, 120.03, 20.05, start=DAY, append="sst,sst_anomaly")


def stored_point(s: SparkSession, d: str) -> DataFrame:
    return requests.read(fixtures.stored(s, d), 120.021, 20.009, start="2024-01-05", end="2024-01-16")


def stored_mean(s: SparkSession, d: str) -> DataFrame:
    out = tools.bbox_mean(fixtures.stored(s, d), [120.0, 20.0, 120.04, 20.02], DAY, ["sst_anomaly"])
    return out.select("date", F.round("sst_anomaly", 6).alias("sst_anomaly"))


def stored_days(s: SparkSession, d: str) -> DataFrame:
    return fixtures.stored(s, d).days


def stored_index(s: SparkSession, d: str) -> DataFrame:
    """The bounds as written by ingest, then with a late day merged in, written and read again, then rebuilt from the manifest."""
    root, st = fixtures.ingested(s, d)[0], fixtures.stored(s, d)
    written = index.read_index(s, f"{root}/index", st.days)
    other = fixtures.scratch(s, "index")
    index.write_index(index.merged(written, F.lit(dt.date(2024, 3, 1))), other)
    again, rebuilt = index.read_index(s, other, st.days), index.rebuilt(st.days)
    return written.withColumn("k", F.lit(1)).unionByName(again.withColumn("k", F.lit(2))).unionByName(rebuilt.withColumn("k", F.lit(3)))


def stored_attributes(s: SparkSession, d: str) -> DataFrame:
    return s.read.json(f"{fixtures.ingested(s, d)[0]}/attributes").select("name", "units", "dims", "source")


def ingest_verdict(s: SparkSession, d: str) -> DataFrame:
    """What ingest said of itself, and the parity of all its cells with the granules."""
    root, days, said = fixtures.ingested(s, d)
    word, summary = parity.verify(granules.normalise(fixtures.granules(s, d)), fixtures.stored(s, d).grid)
    return summary.select("field", "compared", "mismatches", F.lit(said).alias("said"), F.lit(word).alias("all"), F.lit(len(days)).cast("long").alias("days"))


def ingest_again(s: SparkSession, d: str) -> DataFrame:
    """Days up to the tenth, then all of them changed and without sea ice: what is there stays, and a field that granules lack is null."""
    g, root = fixtures.granules(s, d), fixtures.scratch(s, "again")
    ingest.ingest(g.filter("date <= '2024-01-10'"), root)
    ingest.ingest(g.withColumn("sst_anomaly", (F.col("sst_anomaly") + 1).cast("float")).drop("sea_ice_fraction"), root)
    return GridStore.open(s, root).grid.select("date", "lat_idx", "lon_idx", "sst_anomaly", "sea_ice")


def ingest_stream(s: SparkSession, d: str) -> DataFrame:
    """Granules that arrive as files, in two goes."""
    g, inbox, root = fixtures.granules(s, d), fixtures.scratch(s, "inbox"), fixtures.scratch(s, "stream")
    for part in ("date > '2024-01-20'", "date <= '2024-01-20'"):  # the second is late
        g.filter(part).coalesce(1).write.mode("append").parquet(inbox)
        arrivals.ingest_arrivals(s, inbox, g.schema, root, f"{root}-checkpoint").awaitTermination()
    return GridStore.open(s, root).grid.groupBy("date").agg(F.count(F.lit(1)).alias("cells"), F.count("sst").alias("values"))


def daily_runs(s: SparkSession, d: str) -> DataFrame:
    """A day, the same again, a day while another writer is at the store, and a refused date."""
    root, g = fixtures.scratch(s, "daily"), fixtures.granules(s, d)
    run = lambda day: ingest.daily(s, day, root, lambda x: g.filter(F.col("date") == F.lit(x)), f"{root}/index")[0]
    said = [run("2024-01-10"), run("2024-01-10")]
    with ingest.single_writer(s, f"{root}/_lock") as first, ingest.single_writer(s, f"{root}/_lock") as second:
        said += [run("2024-01-11"), f"{first} {second}"]
    said.append(_refused(lambda: run("2024-1-12"))[0])
    return _rows(s, "k int, said string", *enumerate(said))


def zarr_cells(s: SparkSession, d: str) -> DataFrame:
    """Three days written as a Zarr store of small chunks, and read back whole."""
    root = fixtures.scratch(s, "zarr")
    cells = fixtures.stored(s, d).grid.filter("date between '2024-01-08' and '2024-01-10'")
    zarr.write_zarr(cells, root, GridConfig(tile=3))
    return zarr.open_zarr(s, root).grid.select("date", "lat_idx", "lon_idx", "sst", "sst_anomaly", "sea_ice")


def zarr_box(s: SparkSession, d: str) -> DataFrame:
    """A box on one of the days, from its chunks alone."""
    root = fixtures.scratch(s, "zarr")
    zarr.write_zarr(fixtures.stored(s, d).grid.filter("date between '2024-01-09' and '2024-01-10'"), root, GridConfig(tile=3))
    return requests.read(zarr.open_zarr(s, root), 120.0, 20.0, 120.03, 20.05, start=DAY, append="sst,sst_anomaly")


def json_round_trip(s: SparkSession, d: str) -> DataFrame:
    """A box as JSON rows, written and read back."""
    path = fixtures.scratch(s, "json")
    rows.write_json(requests.read(fixtures.store(s, d), 120.0, 20.0, 120.04, 20.02, start=DAY, append="sst,sea_ice", mode="truncate"), path)
    return s.read.schema("lon double, lat double, date date, sst double, sea_ice double").json(path)


def _refused(call: Callable[[], object]) -> tuple[str, int, str]:
    try:
        call()
    except PelagiaError as e:
        return type(e).__name__, e.status, e.message
    return "", 200, ""


def refusals(s: SparkSession, d: str) -> DataFrame:
    """What requests and tools answer to what they can't do: kind, status and message."""
    st, small = fixtures.store(s, d), fixtures.store(s, d, GridConfig(point_limit=3))
    none = GridStore(st.grid, st.days.limit(0), st.lon_axis, st.lat_axis)
    calls = [
        lambda: requests.read(st, 120.0, 20.0, start="2024-1-5"),
        lambda: requests.read(st, 120.0, 20.0, start="2024-99-99"),
        lambda: requests.read(st, 120.0, 20.0, append="sst,salt"),
        lambda: requests.read(st, 120.0, 20.0, mode="raw"),
        lambda: requests.read(st, 120.0, 20.0, sample=2),
        lambda: requests.read(st, 120.0, 20.0, 120.04, 20.02, start=DAY, sample=0),
        lambda: requests.read(small, 120.0, 20.0, 120.04, 20.02, start=DAY),
        lambda: requests.read(none, 120.0, 20.0),
        lambda: tools.point_value(st, 181.0, 20.0),
        lambda: tools.point_value(st, 120.0, 91.0),
        lambda: tools.point_value(st, 120.0, 20.0, "today"),
        lambda: tools.point_value(st, 120.0, 20.0, DAY, ["sea_ice"]),
        lambda: tools.point_value(st, 120.0, 20.0, DAY, None, "closest"),
        lambda: tools.bbox_mean(st, [120.0, 20.0, 120.0, 21.0], DAY),
        lambda: tools.bbox_mean(st, [120.0, 20.0, 121.0], DAY),
        lambda: tools.point_value(st, 120.0, 20.0, "2025-01-01", None, "nearest"),
        lambda: requests.read(st, float("nan"), 20.0),
        lambda: ingest.pending(s, "2024-01-05", "2024-01-01", st.days),
        lambda: requests.read(st, 120.0, 20.0, start="2024-01-05"),
    ]
    return _rows(s, "k int, kind string, status int, message string", *((k, *_refused(c)) for k, c in enumerate(calls)))


def box_mean_of_infinite_values(s: SparkSession, d: str) -> DataFrame:
    """Whether a mean over an infinite value is an error, and one over the same cells without it isn't."""
    cells = fixtures.store(s, d).grid.filter(F.col("date") == DAY)
    bad = cells.withColumn("sst", F.when(F.col("lat_idx") == 0, F.lit(float("inf")).cast("float")).otherwise(F.col("sst")))
    out = []
    for k, df in enumerate((cells, bad)):
        try:
            extract.box_mean(df, ["sst"]).collect()
            out.append((k, True))
        except Exception as e:
            out.append((k, "sst values contains invalid values" not in str(e)))
    return _rows(s, "k int, fine boolean", *out)


def zone_inputs(s: SparkSession, d: str) -> DataFrame:
    """Time zones as callers write them: the offset at noon of a summer day, the name, and whether none was chosen."""
    found = []
    for k, text in enumerate(("+08:00", "8", "-5.5", "Asia/Taipei", "Europe/London", "utc", "Z", "+0800", "Nope/Zone", "24", "")):
        try:
            zone, name, unchosen = params.timezone(text)
            found.append((k, params.offset_on(zone, dt.date(2024, 7, 1)), name, unchosen, None))
        except PelagiaError as e:
            found.append((k, None, None, None, e.message))
    return _rows(s, "k int, utc_offset string, name string, unchosen boolean, message string", *found)


def settings(s: SparkSession, d: str) -> DataFrame:
    """Settings from an environment: what is set, what isn't, and what can't be read."""
    c = GridConfig.from_env(env={"PELAGIA_POINT_LIMIT": "5", "PELAGIA_DEGREES_PER_CELL": "0.25", "OTHER": "x"})
    bad = _refused(lambda: GridConfig.from_env(env={"PELAGIA_MAX_DAYS": "many"}))
    return _rows(s, "name string, value string", *((k, str(getattr(c, k))) for k in ("point_limit", "degrees_per_cell", "max_days", "nearest_days", "tile")), ("error", f"{bad[1]} {bad[2]}"))


def fetch_retries(s: SparkSession, d: str) -> DataFrame:
    """Answers of a backend, and what comes of them: tries, pauses and the outcome."""
    out = []
    for k, answers in enumerate((((503, "busy"), (429, "busy"), (200, "fine")), ((502, '{"detail": "gone"}'),) * 5, ((404, '{"detail": "none"}'),), ((400, "bad"),), ((200, "fine"),))):
        left, pauses = list(answers), []
        said: list[str] = []
        kind, status, message = _refused(lambda left=left, pauses=pauses, said=said: said.append(retrying(lambda _: left.pop(0), sleep=pauses.append)({})))
        out.append((k, len(answers) - len(left), float(sum(pauses)), said[0] if said else None, kind, status))
    return _rows(s, "k int, tries int, paused double, text string, kind string, status int", *out)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        catalog_bounds, catalog_days, catalog_gaps, axis_bounds, index_merge, index_fill, nearest_index_bulk, clamp_points, point_latest, point_range, point_range_reversed, point_range_capped,
        point_all_fields, point_truncate, bbox_day, bbox_stride, bbox_reversed_corners, bbox_clamped, bbox_line, bbox_truncate, bbox_cardinality, bbox_mean_day, bbox_mean_strided, bbox_mean_all_null,
        bbox_mean_by_day, bbox_percentile_anomaly, mean_fallback, point_tool, stride_estimate, stride_retry, nearest_date_fallback, field_list_parse, available_range_parse, kelvin_to_celsius,
        granule_date_parse, backfill_pending, backfill_existing, retention_candidates, verify_parity, verify_top_mismatches, tide_highs_lows, tide_state, tide_countdown, sun_first_events,
        tz_offset_at_noon, tz_numeric_parse, tide_messages, tide_document, tile_layout, bench_mean_by_day,
        stored_cells, stored_box, stored_point, stored_mean, stored_days, stored_index, stored_attributes, ingest_verdict, ingest_again, ingest_stream, daily_runs, zarr_cells, zarr_box,
        json_round_trip, refusals, box_mean_of_infinite_values, zone_inputs, settings, fetch_retries,
    )
}
