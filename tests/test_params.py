from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from pelagia.config import GridConfig
from pelagia.errors import BadRequest, ToolError
from pelagia.functions import params as p

ALL = GridConfig().fields
D = dt.date


@pytest.mark.parametrize("text", ["2025-1-2", "2025-99-99", "", "x", "2025-01-02\n", "٢٠٢٥-01-02"])
def test_bad_dates(text):
    with pytest.raises(BadRequest, match="Invalid date format"):
        p.request_date(text)
    with pytest.raises(ToolError):
        p.tool_date(text)


def test_fields_of_a_request():
    assert p.request_fields(None, ALL) == p.request_fields("", ALL) == ["sst"]
    assert p.request_fields(" , ", ALL) == []
    assert p.request_fields("sst, sst", ALL) == ["sst", "sst"]
    with pytest.raises(BadRequest, match=r"Unsupported field\(s\): SST,foo. Allowed: sst,sst_anomaly,sea_ice"):
        p.request_fields("SST,sst,foo", ALL)


def test_fields_of_a_tool():
    two = GridConfig().tool_fields
    assert p.tool_fields(None, two) == p.tool_fields([], two) == ["sst"]
    assert p.tool_fields(["sst_anomaly", "sst", "sst_anomaly"], two) == ["sst_anomaly", "sst"]
    with pytest.raises(ToolError, match="Unsupported field 'sea_ice'"):
        p.tool_fields(["sea_ice"], two)


def test_modes():
    assert p.request_modes("TRUNCATE, truncate") == {"truncate"}
    with pytest.raises(BadRequest, match="Unsupported mode"):
        p.request_modes("unknown")


def test_boxes_of_a_tool():
    assert p.tool_bbox([2, 3, 1, 0]) == (1, 0, 2, 3)
    for bad, text in (([1, 2, 3], "exactly four"), ([1, 2, 1, 3], "non-zero area"), ([181, 0, 1, 1], "Longitude"), ([0, -91, 1, 1], "Latitude")):
        with pytest.raises(ToolError, match=text):
            p.tool_bbox(bad)


def test_point_dates():
    e, last = D(2024, 1, 1), D(2024, 3, 1)
    days = lambda a, b: p.point_dates(a, b, e, last, 31)
    assert days(None, None) == [last]
    assert days(D(2024, 1, 5), None) == days(None, D(2024, 1, 5)) == [D(2024, 1, 5)]
    assert days(D(2024, 1, 7), D(2024, 1, 5)) == [D(2024, 1, k) for k in (5, 6, 7)]
    assert days(D(2025, 1, 1), D(2025, 2, 1)) == days(D(2020, 1, 1), D(2020, 2, 1)) == []
    assert len(days(D(2020, 1, 1), D(2025, 1, 1))) == 31 and days(D(2020, 1, 1), D(2025, 1, 1))[0] == e


def test_strides():
    one = lambda *b: p.stride_estimate(*b, 0.01, 1_000_000)
    assert one(0, 0, 1, 1) == 1 and one(100, 0, 160, 60) == 7
    assert p.fitting_stride(1, 1000, 1000, 1_000_000, 4) == 1
    assert p.fitting_stride(9, 34850, 2324, 1_000_000, 4) == 18  # the estimate leaves 1,003,107 cells
    with pytest.raises(ToolError, match="Too many points"):
        p.fitting_stride(1, 36000, 18000, 1_000_000, 4)


@given(st.integers(1, 5000), st.integers(1, 5000), st.integers(1, 9))
def test_stride_counts(nx, ny, s):
    s2 = p.fitting_stride(s, nx, ny, 10**6, 12)
    assert len(range(0, nx, s2)) * len(range(0, ny, s2)) <= 10**6


def test_fallback_is_a_bound():
    e, last = D(2024, 1, 1), D(2024, 1, 11)
    assert p.fallback_date(D(2024, 1, 6), e, last) == e  # a tie goes to the earlier one
    assert p.fallback_date(D(2024, 1, 7), e, last) == last


@pytest.mark.parametrize(
    ("text", "offset", "name"),
    [("Z", "+00:00", None), ("UTC", "+00:00", "UTC"), ("Asia/Taipei", "+08:00", "Asia/Taipei"), ("America/New_York", "-04:00", "America/New_York"), ("8", "+08:00", None), ("-5.5", "-05:30", None), ("5.75", "+05:45", None), ("-0:30", "-00:30", None)],
)
def test_zones(text, offset, name):
    zone, found, unchosen = p.timezone(text)
    assert (p.offset_on(zone, D(2024, 7, 1)), found, unchosen) == (offset, name, text == "Z")


@pytest.mark.parametrize(("text", "said"), [("+0800", "Invalid"), ("Nope/Zone", "Unknown"), ("", "required"), (None, "required"), ("24", "Invalid")])
def test_bad_zones(text, said):
    with pytest.raises(ToolError, match=said):
        p.timezone(text)


def test_config_from_the_environment():
    c = GridConfig.from_env(env={"PELAGIA_POINT_LIMIT": "5", "PELAGIA_DEGREES_PER_CELL": "0.5"})
    assert (c.point_limit, c.degrees_per_cell, c.max_days) == (5, 0.5, 31)
    with pytest.raises(ToolError, match="Invalid int value"):
        GridConfig.from_env(env={"PELAGIA_POINT_LIMIT": "many"})


def test_nan_is_refused():
    with pytest.raises(BadRequest):
        p.finite(1.0, float("nan"))
    p.finite(np.float64(1))


def test_hundredths_round_as_python_does(spark):
    import random

    from pyspark.sql import functions as F

    from pelagia.functions.columns import hundredths

    rng = random.Random(8)
    values = [2.675, 1.005, 0.125, 0.375, -2.675, -0.125, 0.0, 1e12 + 0.125, 123456.785, 5e-324, 0.005, 0.015, 1e15 + 0.5]
    values += [k / 1000 for k in range(-4000, 4000, 5)] + [rng.uniform(-1e4, 1e4) for _ in range(3000)] + [rng.randint(-(10**6), 10**6) / 8 for _ in range(1000)] + [rng.randint(-(10**9), 10**9) / 1000 for _ in range(2000)]
    found = [tuple(r) for r in spark.createDataFrame([(v,) for v in values], "x double").select("x", hundredths(F.col("x"))).collect()]
    assert [(x, y) for x, y in found if y != round(x, 2)] == []
