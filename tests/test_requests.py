from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from pelagia.config import GridConfig
from pelagia.errors import BadRequest, NotFound, ToolError, Unavailable
from pelagia.operators import nearest
from pelagia.plans import requests, tools
from pelagia.sources.rows import json_rows
from pelagia.sources.store import SCHEMA, GridStore

D = dt.date


def cells(spark, *days):
    rows = [(day, j, i, float(np.float32(15 + j)), float(np.float32(135 + i)), float(v[j][i]) if v[j][i] is not None else None, None, None) for day, v in days for j in range(2) for i in range(2)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def two(spark):
    grid = cells(spark, (D(2025, 10, 30), [[20, 21], [22, 23]]), (D(2025, 11, 3), [[21, 22], [23, None]])).cache()
    return GridStore.of_cells(grid)


@pytest.fixture(scope="module")
def one(spark):
    row = (D(2024, 5, 1), 0, 0, float(np.float32(23.7654321)), float(np.float32(120.1234567)), float(np.float32(1.2345678)), None, None)
    return GridStore.of_cells(spark.createDataFrame([row], SCHEMA).cache())


def test_truncate(one):
    r = requests.read(one, 120.12, 23.76, mode="truncate").first()
    assert (r["lon"], r["lat"], r["sst"]) == (120.12346, 23.76543, 1.235)
    r = requests.read(one, 120.12, 23.76).first()
    assert (r["lon"], r["sst"]) == (float(np.float32(120.1234567)), float(np.float32(1.2345678)))
    with pytest.raises(BadRequest):
        requests.read(one, 120.12, 23.76, mode="unknown")


def test_box_takes_the_start(two):
    rows = requests.read(two, 135, 15, 136, 16, start="2025-10-30", end="2025-11-05").collect()
    assert [(r["lon"], r["lat"], r["sst"]) for r in rows] == [(135, 15, 20), (136, 15, 21), (135, 16, 22), (136, 16, 23)]
    assert {r["date"] for r in rows} == {D(2025, 10, 30)}


def test_box_dates(two):
    assert requests.plan_box(two, 135, 15, 136, 16).day == D(2025, 11, 3)
    assert requests.plan_box(two, 135, 15, 136, 16, start="", end="2025-10-30").day == D(2025, 10, 30)
    assert requests.plan_box(two, 135, 15, 136, 16, start="2025-10-30", end="junk").day == D(2025, 10, 30)
    with pytest.raises(BadRequest, match="single-day.*2025-10-21"):
        requests.read(two, 135, 15, 136, 16, start="2025-10-21", end="2025-10-31")
    with pytest.raises(BadRequest, match="single-day"):
        requests.read(two, 135, 15, 136, 16, start="2025-11-01")  # a gap


def test_box_stride_limits_and_line(two):
    rows = requests.read(two, 136, 16, 135, 15, start="2025-10-30", sample=2).collect()
    assert [(r["lon"], r["lat"]) for r in rows] == [(135, 15)]
    assert requests.read(two, 135, 15, 135, 16).count() == 2
    with pytest.raises(BadRequest, match="'sample' must be >= 1"):
        requests.read(two, 135, 15, 136, 16, sample=0)
    small = GridStore.of_cells(two.grid, GridConfig(point_limit=3))
    with pytest.raises(BadRequest, match=r"Too many points \(4\).*limit 3"):
        requests.read(small, 135, 15, 136, 16)
    assert requests.read(small, 135, 15, 136, 16, sample=2).count() == 1


def test_point_kinds(two):
    assert requests.read(two, 135, 15, 136, None).count() == 1  # half a corner is a point
    assert requests.read(two, 135, 15, 135, 15).count() == 1
    with pytest.raises(BadRequest, match="only supported in BBox mode"):
        requests.read(two, 135, 15, sample=2)
    assert requests.read(two, 135, 15, append=" , ").columns == ["lon", "lat", "date"]


def test_point_ranges(two):
    dates = lambda *a: [r["date"] for r in requests.read(two, -999, 999, start=a[0], end=a[1]).collect()]
    assert dates("2025-11-05", "2025-10-01") == [D(2025, 10, 30), D(2025, 11, 3)]
    assert dates(None, None) == [D(2025, 11, 3)]
    with pytest.raises(BadRequest, match="available date range is 2025-10-30/2025-11-03"):
        dates("2025-11-01", "2025-11-02")
    with pytest.raises(BadRequest, match="Invalid date"):
        dates("", None)


def test_checks_come_in_order(two, spark):
    empty = GridStore.of_cells(two.grid.limit(0))
    with pytest.raises(BadRequest, match="field"):
        requests.read(empty, 0, 0, append="x", mode="y")
    with pytest.raises(BadRequest, match="mode"):
        requests.read(empty, 0, 0, mode="y", sample=3)
    with pytest.raises(BadRequest, match="sample"):
        requests.read(empty, 0, 0, sample=3, start="x")
    with pytest.raises(Unavailable) as e:
        requests.read(empty, 0, 0)
    assert e.value.status == 503


def test_tools(two):
    r = tools.point_value(two, 135.2, 15.1, "2025-11-06", method="nearest").first()
    assert (r["region"], r["date"], r["requested_date"], r["method"], r["sst"]) == ([135.2, 15.1], D(2025, 11, 3), D(2025, 11, 6), "nearest", 21)
    with pytest.raises(NotFound, match="13 days away"):
        tools.point_value(two, 135, 15, "2025-11-16", method="nearest")
    with pytest.raises(NotFound, match="available date range"):
        tools.point_value(two, 135, 15, "2025-11-16")
    r = tools.bbox_mean(two, [135, 15, 136, 16], "2025-11-03", ["sst", "sst_anomaly"]).first()
    assert (r["sst"], r["sst_anomaly"], r["sample"], r["method"]) == (22, None, 1, None)
    r = tools.bbox_mean(two, [135, 15, 136, 16], "2025-11-02", method="nearest").first()
    assert r["date"] == D(2025, 11, 3)  # the nearer bound
    with pytest.raises(ToolError, match="Unsupported method"):
        tools.bbox_mean(two, [135, 15, 136, 16], "2025-11-01", method="closest")


def test_infinite_values_fail_a_mean(spark):
    bad = GridStore.of_cells(cells(spark, (D(2025, 1, 1), [[1, float("inf")], [1, 1]])))
    with pytest.raises(Exception, match="invalid values"):
        tools.bbox_mean(bad, [135, 15, 136, 16], "2025-01-01").collect()


def test_ties_and_distances_are_32_bit(spark, two):
    lon = spark.createDataFrame([(i, float(np.float32(i / 100 + 100))) for i in range(500)], "lon_idx int, lon float")
    probes = [(k, 99.99 + k * 0.005) for k in range(1005)]
    found = {r["k"]: r["lon_idx"] for r in nearest.nearest_on_axis(spark.createDataFrame(probes, "k int, v double"), lon, "v", "lon_idx", "lon").collect()}
    axis = np.array([np.float32(i / 100 + 100) for i in range(500)])
    assert found == {k: int(np.abs(axis - np.float32(min(max(v, float(axis[0])), float(axis[-1])))).argmin()) for k, v in probes}


def test_uneven_axis(spark):
    values = [0.0, 1.0, 10.0, 11.0, 50.0]
    axis = spark.createDataFrame(list(enumerate(values)), "lon_idx int, lon float")
    probes = [(k, k * 0.5 - 3) for k in range(120)]
    found = {r["k"]: r["lon_idx"] for r in nearest.nearest_on_axis(spark.createDataFrame(probes, "k int, v double"), axis, "v", "lon_idx", "lon").collect()}
    a = np.array(values, np.float32)
    assert found == {k: int(np.abs(a - np.float32(min(max(v, 0.0), 50.0))).argmin()) for k, v in probes}


def test_filters_reach_the_scan(spark, two, tmp_path):
    from pelagia.pipeline.ingest import write_days

    write_days(two.grid, str(tmp_path))
    st = GridStore.open(spark, str(tmp_path))
    plan = requests.read(st, 135, 15, 136, 16, start="2025-10-30")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "GreaterThanOrEqual(lat_idx,0)" in plan
    assert "sea_ice" not in plan.split("ReadSchema")[1]
    assert requests.read(st, 135, 15, 136, 16, start="2025-10-30").count() == 4


def test_json_rows(two):
    df = requests.read(two, 135, 15, append="sst,sea_ice")
    assert json_rows(df).first()[0] == '{"lon":135.0,"lat":15.0,"date":"2025-11-03","sst":21.0,"sea_ice":null}'
    assert "sea_ice" not in json_rows(df, omit_null=True).first()[0]


def test_served_rows_and_views(spark, two):
    df, box, seen = requests.box_served(two, 135, 15, 136, 16, sample=1)
    assert len(df.collect()) == box.cells == seen.get["served"] == 4
    two.views("t_")
    assert spark.sql("SELECT count(*) FROM t_grid WHERE date = (SELECT max(date) FROM t_days)").first()[0] == 4
