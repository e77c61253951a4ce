"""Days into the store. A day is written whole: its partition is replaced, other days stay, and a day that is there already is skipped unless asked otherwise."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import messages as say
from ..config import GridConfig
from ..errors import BadRequest
from ..functions.params import calendar_date
from ..operators import parity
from ..sources import index as bounds_index
from ..sources.granules import normalise
from ..sources.store import SCHEMA

#: Coordinates of one index that lie closer are the same.
AXIS_TOLERANCE = 1e-6


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def known_days(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/days") if exists(spark, f"{root}/days") else spark.createDataFrame([], "date date")


def same_axes(cells: DataFrame, root: str) -> None:
    """Refuses cells that lie on another grid than the store: an index that its axis lacks, or another coordinate there."""
    for idx, value in (("lon_idx", "lon"), ("lat_idx", "lat")):
        axis = cells.sparkSession.read.parquet(f"{root}/{value}_axis")
        seen = cells.select(idx, value).distinct()
        odd = seen.join(axis.select(idx, F.col(value).alias("known")), idx, "left").filter(F.col("known").isNull() | (F.abs(F.col(value) - F.col("known")) >= AXIS_TOLERANCE)).first()
        if odd:
            raise BadRequest(f"The granule is on another grid: {idx} {odd[idx]} is at {odd[value]}, and at {odd['known']} in the store.")


def write_days(cells: DataFrame, root: str, config: GridConfig | None = None, replace: bool = False) -> DataFrame:
    """Writes the days of ``cells`` that the store lacks (or all, with ``replace``) and returns them, as a manifest that is written as well.

    Cells are dealt by day and tile, so a global day is many files of neighbouring cells, sorted for the scan's statistics. Axes are taken
    from the first days written; days on another grid are refused before anything is written. ``cells`` is read several times; ingest keeps it for that."""
    spark, edge = cells.sparkSession, (config or GridConfig()).tile
    known = known_days(spark, root)
    fresh = cells if replace else cells.join(known, "date", "left_anti")
    if exists(spark, f"{root}/lat_axis"):
        same_axes(fresh, root)
    tile = [F.expr(f"lat_idx div {edge}").alias("tile_i"), F.expr(f"lon_idx div {edge}").alias("tile_j")]
    laid = fresh.select(*SCHEMA.names, *tile).repartition("date", "tile_i", "tile_j").sortWithinPartitions("date", "tile_i", "tile_j", "lat_idx", "lon_idx")
    days = spark.createDataFrame(fresh.select("date").distinct().collect(), "date date")  # a row for each day of the batch
    write = laid.select(*SCHEMA.names).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    write.option("compression", "zstd").partitionBy("date").parquet(f"{root}/grid")
    added = days.join(known, "date", "left_anti")
    added.coalesce(1).write.mode("append").parquet(f"{root}/days")
    for idx, value in (("lon_idx", "lon"), ("lat_idx", "lat")):
        if not exists(spark, f"{root}/{value}_axis") and not added.isEmpty():
            fresh.select(idx, value).distinct().coalesce(1).sortWithinPartitions(idx).write.parquet(f"{root}/{value}_axis")
    return days


@contextmanager
def single_writer(spark: SparkSession, path: str, stale_hours: float = 24) -> Iterator[bool]:
    """Whether this is the only writer: a lock file in the store's own file system, made only if it isn't there, and removed in the end. A lock that a writer left behind, older than
    ``stale_hours``, is taken away first."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        fs.mkdirs(hadoop.getParent())
        if fs.exists(hadoop) and fs.getFileStatus(hadoop).getModificationTime() < (time.time() - stale_hours * 3600) * 1000:
            fs.delete(hadoop, False)
        won = fs.createNewFile(hadoop)
    except Exception:
        won = False
    try:
        yield won
    finally:
        if won:
            fs.delete(hadoop, False)


def write_attributes(spark: SparkSession, root: str, source: str = "") -> None:
    """What the store's columns mean, beside it."""
    rows = [("sst", "degrees Celsius"), ("sst_anomaly", "degrees Celsius"), ("sea_ice", "fraction, 0 to 1"), ("lon", "degrees east"), ("lat", "degrees north")]
    spark.createDataFrame([(n, u, "lat,lon", source) for n, u in rows], "name string, units string, dims string, source string").coalesce(1).write.mode("overwrite").json(f"{root}/attributes")


def ingest(granules: DataFrame, root: str, index_path: str | None = None, config: GridConfig | None = None, replace: bool = False, check: bool = True, strict: bool = False, source: str = "") -> tuple[list[dt.date], str]:
    """Source cells to store days: normalise, write, verify, then bring the index up to date. Returns the days written and the verifier's word, or LOCKED if another writer is
    at the store. A failed check stops the index only if ``strict``. The source is read once; its cells are kept on the executors meanwhile, and made again if one is lost."""
    spark = granules.sparkSession
    with single_writer(spark, f"{root}/_lock") as alone:
        if not alone:
            return [], "LOCKED"
        cells = normalise(granules).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            new = not exists(spark, f"{root}/attributes")
            written = sorted(r["date"] for r in write_days(cells, root, config, replace).collect())
            if new and written:
                write_attributes(spark, root, source)
            said = "SKIPPED"
            if check and written:
                target = spark.read.schema(SCHEMA).option("basePath", f"{root}/grid").parquet(f"{root}/grid").filter(F.col("date").isin(written))
                said, _ = parity.verify(cells.filter(F.col("date").isin(written)), target, n=50)
        finally:
            cells.unpersist()
        if index_path and not (strict and said == "FAIL"):
            bounds_index.write_index(known_days(spark, root).agg(F.min("date").alias("earliest"), F.max("date").alias("latest")), index_path)
    return written, said


def pending(spark: SparkSession, start: str, end: str, days: DataFrame) -> DataFrame:
    """Calendar days from start to end that don't exist yet."""
    a, b = calendar_date(start), calendar_date(end)
    if a is None:
        raise BadRequest(say.BAD_START.format(text=start))
    if b is None:
        raise BadRequest(say.BAD_END.format(text=end))
    if a > b:
        raise BadRequest(say.BAD_ORDER)
    calendar = spark.range(1).select(F.explode(F.sequence(F.lit(a), F.lit(b))).alias("date"))
    return calendar.join(days, "date", "left_anti")


def backfill(spark: SparkSession, start: str, end: str, root: str, source: Callable[[dt.date], DataFrame], index_path: str | None = None, config: GridConfig | None = None) -> list[dt.date]:
    """Ingests each missing day in turn, and stops at the first that fails. ``source`` gives a day's granule. A day that another writer is at is left out of the result."""
    done = []
    for r in pending(spark, start, end, known_days(spark, root)).orderBy("date").collect():  # calendar days
        written, _ = ingest(source(r["date"]), root, index_path, config)
        done += written
    return done


def expired(files: DataFrame, today: dt.date, days: int) -> DataFrame:
    """Source files (path, modified) older than ``days``."""
    return files.filter(F.col("modified").cast("date") < F.date_sub(F.lit(today), days))


def purge(spark: SparkSession, folder: str, today: dt.date, days: int, pattern: str = "*.nc") -> list[str]:
    """Deletes the files of ``folder`` that match and are older than ``days``; their names."""
    if not exists(spark, folder):
        return []
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", F.col("modificationTime").alias("modified"))
    gone = sorted(r["path"] for r in expired(files, today, days).collect())  # a name for each old granule
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)
    return gone


def daily(spark: SparkSession, day: str, root: str, source: Callable[[dt.date], DataFrame], index_path: str | None = None, folder: str | None = None, today: dt.date | None = None, config: GridConfig | None = None) -> tuple[str, list[str]]:
    """A day's run: what is there is skipped; else it is ingested, verified and indexed, and old granules in ``folder`` are deleted. Returns EXISTS, LOCKED or the verifier's word,
    and the files deleted. Nothing else runs after EXISTS or LOCKED."""
    asked = calendar_date(day)
    if asked is None:
        raise BadRequest(say.BAD_START.format(text=day))
    if not known_days(spark, root).filter(F.col("date") == F.lit(asked)).isEmpty():
        return "EXISTS", []
    written, said = ingest(source(asked), root, index_path, config)
    if said == "LOCKED":
        return said, []
    if written != [asked]:
        raise BadRequest(f"The granule of {asked} has other days: {written}.")
    return said, purge(spark, folder, today or dt.datetime.now(dt.timezone.utc).date(), (config or GridConfig()).retention_days) if folder else []
