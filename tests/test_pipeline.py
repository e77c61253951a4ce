from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from pelagia.errors import BadRequest, NotFound, ToolError
from pelagia.operators import parity
from pelagia.pipeline import ingest as pipe
from pelagia.plans import tools
from pelagia.queries import DOCUMENT
from pelagia.sources import index
from pelagia.sources.granules import cells_of, normalise, tiles
from pelagia.sources.store import GridStore
from pelagia.streaming.arrivals import ingest_arrivals

D = dt.date
GRANULE = "date date, lat_idx int, lon_idx int, latitude float, longitude float, analysed_sst float, sst_anomaly float, units string"


def granule(spark, *days, shift=0.0):
    rows = [(day, j, i, 15.0 + j, 135.0 + i, 293.15 + shift + i + j if (i, j) != (1, 1) else float("nan"), 0.5, "Kelvin") for day in days for j in range(2) for i in range(2)]
    return spark.createDataFrame(rows, GRANULE)


def test_normalise(spark):
    rows = normalise(granule(spark, D(2024, 1, 1))).orderBy("lat_idx", "lon_idx").collect()
    assert [r["sst"] and round(r["sst"], 3) for r in rows] == [20, 21, 21, None]
    assert rows[0]["sst_anomaly"] == 0.5 and rows[0]["sea_ice"] is None
    celsius = normalise(granule(spark, D(2024, 1, 1)).withColumn("units", F.lit("celsius"))).agg(F.max("sst")).first()[0]
    assert round(celsius) == 294
    with pytest.raises(BadRequest):
        normalise(spark.createDataFrame([(1,)], "x1 int"))


def test_ingest_skips_and_replaces_days(spark, tmp_path):
    root, idx = str(tmp_path / "s"), str(tmp_path / "i")
    assert pipe.ingest(granule(spark, D(2024, 1, 2), D(2024, 1, 4)), root, idx) == ([D(2024, 1, 2), D(2024, 1, 4)], "PASS")
    assert pipe.ingest(granule(spark, D(2024, 1, 4), shift=5), root, idx) == ([], "SKIPPED")
    assert pipe.ingest(granule(spark, D(2024, 1, 1)), root, idx)[0] == [D(2024, 1, 1)]
    st = GridStore.open(spark, root)
    assert st.span() == (D(2024, 1, 1), D(2024, 1, 4)) and st.grid.count() == 12
    assert [r["date"] for r in st.gaps().collect()] == [D(2024, 1, 3)]
    bounds = index.read_index(spark, idx, st.days).first()
    assert tuple(bounds) == (D(2024, 1, 1), D(2024, 1, 4))
    pipe.ingest(granule(spark, D(2024, 1, 4), shift=5), root, idx, replace=True)
    st = GridStore.open(spark, root)
    assert st.grid.count() == 12 and round(st.grid.filter("date = '2024-01-04'").agg(F.max("sst")).first()[0]) == 26


def test_index_of_a_damaged_file(spark, tmp_path):
    days = spark.createDataFrame([(D(2024, 1, 1),), (D(2024, 2, 1),)], "date date")
    (tmp_path / "x.json").write_text('{"earliest": "2023-05-05", "latest": "junk"}')
    assert tuple(index.read_index(spark, str(tmp_path / "x.json"), days).first()) == (D(2023, 5, 5), D(2024, 2, 1))
    assert tuple(index.read_index(spark, str(tmp_path / "none"), days).first()) == (D(2024, 1, 1), D(2024, 2, 1))
    assert tuple(index.merged(days.agg(F.min("date").alias("earliest"), F.max("date").alias("latest")), F.lit(D(2025, 1, 1))).first()) == (D(2024, 1, 1), D(2025, 1, 1))
    with pytest.raises(NotFound, match="No date groups found"):
        index.rebuilt(days.limit(0))


def test_backfill(spark, tmp_path):
    root = str(tmp_path / "s")
    pipe.ingest(granule(spark, D(2024, 1, 2)), root)
    assert pipe.backfill(spark, "2024-01-01", "2024-01-03", root, lambda d: granule(spark, d)) == [D(2024, 1, 1), D(2024, 1, 3)]
    for a, b in (("2024-1-1", "2024-01-03"), ("2024-01-01", "x"), ("2024-01-04", "2024-01-03")):
        with pytest.raises(BadRequest):
            pipe.backfill(spark, a, b, root, lambda d: granule(spark, d))


def test_another_grid_is_refused(spark, tmp_path):
    root = str(tmp_path / "s")
    pipe.ingest(granule(spark, D(2024, 1, 2)), root)
    for odd in (F.col("longitude") + 0.5, None):
        moved = granule(spark, D(2024, 1, 3)).withColumn("longitude", odd.cast("float")) if odd is not None else granule(spark, D(2024, 1, 3)).withColumn("lat_idx", F.col("lat_idx") + 5)
        with pytest.raises(BadRequest, match="another grid"):
            pipe.ingest(moved, root)
    assert GridStore.open(spark, root).span() == (D(2024, 1, 2), D(2024, 1, 2))
    assert pipe.ingest(granule(spark, D(2024, 1, 3)).filter("lat_idx = 0"), root)[0] == [D(2024, 1, 3)]  # a part of the grid will do


def test_daily(spark, tmp_path):
    import os

    root, idx, src = str(tmp_path / "s"), str(tmp_path / "i"), tmp_path / "src"
    src.mkdir()
    for name, days in (("old.nc", 40), ("new.nc", 1), ("old.txt", 40)):
        (src / name).write_text("x")
        then = dt.datetime(2024, 3, 1, 12).timestamp() - days * 86400
        os.utime(src / name, (then, then))
    run = lambda day, **kw: pipe.daily(spark, day, root, lambda d: granule(spark, d), idx, str(src), D(2024, 3, 1), **kw)
    said, gone = run("2024-01-02")
    assert said == "PASS" and [x.rsplit("/", 1)[1] for x in gone] == ["old.nc"] and sorted(os.listdir(src)) == ["new.nc", "old.txt"]
    assert run("2024-01-02") == ("EXISTS", [])
    with pipe.single_writer(spark, f"{root}/_lock"):
        assert run("2024-01-03") == ("LOCKED", [])
    with pytest.raises(BadRequest):
        run("2024-1-3")
    assert tuple(index.read_index(spark, idx, GridStore.open(spark, root).days).first()) == (D(2024, 1, 2), D(2024, 1, 2))


def test_command_line(spark, tmp_path, capsys):
    from pelagia.pipeline.__main__ import main

    granule(spark, D(2024, 1, 5)).write.parquet(str(tmp_path / "g"))
    args = ["2024-01-05", str(tmp_path / "s"), str(tmp_path / "g"), "--parquet", "--index", str(tmp_path / "i")]
    assert main(args, spark) == 0 and main(args, spark) == 0
    assert capsys.readouterr().out.split() == ["PASS", "EXISTS"]
    assert spark.read.json(str(tmp_path / "s" / "attributes")).count() == 5


def test_a_stale_lock_is_taken_away(spark, tmp_path):
    import os

    (tmp_path / "_lock").write_text("")
    with pipe.single_writer(spark, str(tmp_path / "_lock")) as a:
        assert not a
    os.utime(tmp_path / "_lock", (1, 1))
    with pipe.single_writer(spark, str(tmp_path / "_lock")) as a:
        assert a


def test_no_cell_for_a_point(spark, tmp_path):
    pipe.ingest(granule(spark, D(2024, 1, 2)), str(tmp_path / "s"))
    st = GridStore.open(spark, str(tmp_path / "s"))
    st.grid = st.grid.filter("lat_idx > 0")
    with pytest.raises(NotFound, match="No data returned"):
        tools.point_value(st, 135.0, 15.0, "2024-01-02")


def test_percentiles_and_daily_means(spark):
    from pelagia.operators import extract

    cells = normalise(granule(spark, D(2024, 1, 1), D(2024, 1, 2)))
    assert [(r["date"], round(r["sst"], 3), r["cells"]) for r in extract.daily_means(cells, ["sst"]).orderBy("date").collect()] == [(D(2024, 1, 1), 20.667, 3), (D(2024, 1, 2), 20.667, 3)]
    assert round(extract.box_percentile(cells, "sst", 0.5).first()[0], 3) == round(extract.box_percentile(cells, "sst", 0.5, 1000).first()[0], 3) == 21


def test_single_writer(spark, tmp_path):
    lock = str(tmp_path / "s" / "_lock")
    with pipe.single_writer(spark, lock) as a, pipe.single_writer(spark, lock) as b:
        assert a and not b
        assert pipe.backfill(spark, "2024-01-01", "2024-01-01", str(tmp_path / "s"), lambda d: granule(spark, d)) == []
    with pipe.single_writer(spark, lock) as a:
        assert a
    pipe.write_attributes(spark, str(tmp_path / "s"), "test")
    assert spark.read.json(str(tmp_path / "s" / "attributes")).count() == 5


def test_netcdf_needs_its_package(spark):
    from pelagia.sources import netcdf

    if netcdf.netCDF4 is None:
        with pytest.raises(BadRequest, match="netCDF4"):
            netcdf.read_granules(spark, "x")


def test_parity(spark):
    a = normalise(granule(spark, D(2024, 1, 1)))
    assert parity.verify(a, a)[0] == "PASS"
    assert parity.verify(a, a.withColumn("sst", (F.col("sst") + 1).cast("float")))[0] == "FAIL"
    assert parity.verify(a, a.limit(0))[0] == "VACUOUS"
    assert parity.sampled(a, 3).count() == 3
    axis = a.select("lon_idx", "lon").distinct()
    assert tuple(parity.axes_agree(axis, axis, "lon_idx", "lon").first()) == (0, 0)


def test_tiles(spark):
    a = normalise(granule(spark, D(2024, 1, 1), D(2024, 1, 2)))
    assert tiles(a, 1).count() == 8
    assert sorted(map(tuple, cells_of(tiles(a, 2)).select("date", "lat_idx", "lon_idx", "sst_anomaly").collect())) == sorted(map(tuple, a.select("date", "lat_idx", "lon_idx", "sst_anomaly").collect()))


def test_stream_of_arrivals(spark, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "s")
    for day in (D(2024, 1, 3), D(2024, 1, 1)):  # the second is late
        granule(spark, day).write.mode("append").parquet(src)
        ingest_arrivals(spark, src, granule(spark, day).schema, root, str(tmp_path / "c")).awaitTermination()
    st = GridStore.open(spark, root)
    assert st.span() == (D(2024, 1, 1), D(2024, 1, 3)) and st.grid.count() == 8


def forecast(spark, doc=DOCUMENT, **kw):
    return tools.tide_forecast(spark, lambda _: doc, 151.2, -33.9, **{"tz": "+10:00", "date": "2024-08-19", **kw}).first()


def test_tide_state(spark):
    r = forecast(spark, query_time="2024-08-19T10:00:00")  # without an offset it is local
    s = r["tide"]["state"]
    assert (s["state_now"], s["since_extreme"], s["until_extreme"]) == ("falling", "02:47:55", "03:05:50")
    assert (s["last_extreme"]["height_cm"], s["next_extreme"]["type"]) == (61.4, "LOW")
    assert r["sun"]["rise"].endswith("06:27:00+10:00") and r["sun"]["transit"] is None and r["tz_name"] is None
    assert forecast(spark, query_time="2024-08-19T07:12:05+10:00")["tide"]["state"]["since_extreme"] == "00:00:00"  # at the extreme
    assert forecast(spark, query_time="2024-08-19T23:00:00+10:00")["tide"]["state"] is None  # nothing follows
    assert forecast(spark)["tide"]["state"] is None


def test_tide_days_and_gaps(spark):
    r = forecast(spark, date="2024-08-27", query_time="2024-08-27T10:00:00+10:00")
    assert r["date"] == D(2024, 8, 19) and r["tide"]["state"] is None  # the first day stands in
    doc = json.loads(DOCUMENT)
    doc["days"][0] |= {"sun": None, "moon": [], "moonphase": None}
    doc["days"][0]["tide"] += [{"phen": "HIGH", "time": None, "height": "x"}, {"phen": "SLACK", "time": "2024-08-19T09:00:00+10:00"}]
    doc["meta"] |= {"status": "down", "timezone": None}
    r = forecast(spark, json.dumps(doc), tz="Z", query_time="2024-08-19T10:00:00+10:00", date=None)
    assert r["sun"] is None and r["moon"] is None and r["moonphase"] is None and r["timezone"] == "+00:00" and len(r["messages"]) == 3
    assert len(r["tide"]["highs"]) == 3 and r["tide"]["highs"][2]["height_cm"] is None
    assert r["tide"]["state"] is None  # another event lies between
    for bad, said in (("{", "Invalid JSON"), ('{"days":[]}', "no data")):
        with pytest.raises(ToolError, match=said):
            forecast(spark, bad)
