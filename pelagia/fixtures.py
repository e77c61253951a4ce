"""Deterministic inputs made from the driver's tables: a cube of cells from events, probe points, tide extrema and instants, granules in Kelvin."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import GridConfig
from .pipeline.ingest import ingest
from .sources.store import SCHEMA, GridStore

_stored: dict[tuple[str, str], tuple[str, list, str]] = {}
_local: dict[str, str] = {}


def scratch(spark: SparkSession, tag: str) -> str:
    """A new place in ``spark.checkpoint.dir``; where that is unset, in a temporary folder, if all runs in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _local.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="pelagia-grid-"))
    return f"{base.rstrip('/')}/pelagia-grid/{tag}-{uuid.uuid4().hex}"


def ingested(spark: SparkSession, sf_dir: str) -> tuple[str, list, str]:
    """Where the granules have been ingested as a store (once in a session), the days written and the verifier's word. Its index is beside it."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _stored:
        root = scratch(spark, "store")
        _stored[key] = (root, *ingest(granules(spark, sf_dir), root, f"{root}/index", source="fixtures"))
    return _stored[key]


def stored(spark: SparkSession, sf_dir: str, config: GridConfig | None = None) -> GridStore:
    return GridStore.open(spark, ingested(spark, sf_dir)[0], config)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One user is one cell, five to a row; days whose number divides by seven are absent; cells without an event are null."""
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("date").alias("date"), "event_type", "value")
    axis = events.select("user_id").distinct()
    days = events.filter(F.dayofmonth("date") % 7 != 0).select("date").distinct()
    seen = events.groupBy("date", "user_id").agg(
        F.max("value").cast("float").alias("sst"),
        (F.max("value") - F.min("value")).cast("float").alias("sst_anomaly"),
        (F.count_if(F.col("event_type") == "error").cast("double") / F.count(F.lit(1))).cast("float").alias("sea_ice"),
    )
    grid = axis.crossJoin(F.broadcast(days))  # a month of days: the product is the grid itself
    row, col = F.expr("cast(user_id div 5 as int)"), (F.col("user_id") % 5).cast("int")
    placed = grid.withColumns({"lat_idx": row, "lon_idx": col}).withColumns({"lat": ((2000 + F.col("lat_idx")) / F.lit(100.0)).cast("float"), "lon": ((12000 + F.col("lon_idx")) / F.lit(100.0)).cast("float")})
    return placed.join(seen, ["date", "user_id"], "left").select(*SCHEMA.names)


def store(spark: SparkSession, sf_dir: str, config: GridConfig | None = None) -> GridStore:
    """The cube with its manifest and axes, which come from narrow scans and not from the cells."""
    events = table(spark, sf_dir, "events")
    user = events.select("user_id").distinct()
    place = user.select(F.expr("cast(user_id div 5 as int)").alias("lat_idx"), (F.col("user_id") % 5).cast("int").alias("lon_idx"))
    lon = place.select("lon_idx").distinct().withColumn("lon", ((12000 + F.col("lon_idx")) / F.lit(100.0)).cast("float"))
    lat = place.select("lat_idx").distinct().withColumn("lat", ((2000 + F.col("lat_idx")) / F.lit(100.0)).cast("float"))
    days = events.select(F.col("ts").cast("date").alias("date")).filter(F.dayofmonth("date") % 7 != 0).distinct()
    return GridStore(cube(spark, sf_dir), days, lon, lat, config)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes, half of them between two cells and some beyond the axes."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", ((119995 + k % 60) / F.lit(1000.0)).cast("double").alias("lon"), ((19990 + k % 400) / F.lit(1000.0)).cast("double").alias("lat"))


def tide_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    phen = F.when(F.col("event_type") == "purchase", "HIGH").when(F.col("event_type") == "error", "LOW")
    return table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("date").alias("local_date"), "ts", phen.alias("phen"), F.col("value").alias("height_cm")).filter("phen is not null")


def tide_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("event_type = 'click'").select("event_id", "user_id", F.col("ts").cast("date").alias("local_date"), "ts")


def granules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cube as it would be delivered: in Kelvin, under source names."""
    units = F.when(F.dayofmonth("date") % 2 == 0, "kelvin").otherwise("K")
    return cube(spark, sf_dir).select("date", "lat_idx", "lon_idx", "lat", "lon", (F.col("sst").cast("double") + F.lit(273.15)).alias("analysed_sst"), "sst_anomaly", F.col("sea_ice").alias("sea_ice_fraction"), units.alias("units"))


def bench_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger, sparse grid: one row for each cell that was seen."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    keys = [F.col("l_shipdate").cast("date").alias("date"), (F.col("l_partkey") % 64).cast("int").alias("lat_idx"), (F.col("l_suppkey") % 64).cast("int").alias("lon_idx")]
    found = l.groupBy(*keys).agg(F.max("l_quantity").cast("float").alias("sst"), F.max("l_discount").cast("float").alias("sst_anomaly"), F.max("l_tax").cast("float").alias("sea_ice"))
    return found.withColumns({"lat": (F.col("lat_idx") / F.lit(100.0)).cast("float"), "lon": (F.col("lon_idx") / F.lit(100.0)).cast("float")}).select(*SCHEMA.names)
