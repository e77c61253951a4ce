"""The store: a table of cells partitioned by day, a manifest of days, and two axis tables.

    grid   date, lat_idx, lon_idx, lat, lon, sst, sst_anomaly, sea_ice   (Parquet, partitioned by date, sorted by tile inside a day)
    days   date                                                          (a row for each day that exists, even if all its cells are null)
    lon_axis, lat_axis   index and coordinate

Requests are planned on the driver from the manifest's bounds and the axes; cells are only read by the plan that comes out.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, FloatType, IntegerType, StructField, StructType

from .. import messages as say
from ..config import GridConfig
from ..errors import BadRequest, Unavailable

FIELDS = ("sst", "sst_anomaly", "sea_ice")
SCHEMA = StructType([StructField("date", DateType()), StructField("lat_idx", IntegerType()), StructField("lon_idx", IntegerType()), StructField("lat", FloatType()), StructField("lon", FloatType()), *(StructField(f, FloatType()) for f in FIELDS)])
#: An axis longer than this is taken for a mistake: a hundredth of a degree gives 36,000 cells.
LONGEST_AXIS = 1_000_000


class GridStore:
    def __init__(self, grid: DataFrame, days: DataFrame, lon_axis: DataFrame, lat_axis: DataFrame, config: GridConfig | None = None):
        self.grid, self.days, self.lon_axis, self.lat_axis = grid, days, lon_axis, lat_axis
        self.config = config or GridConfig()

    @classmethod
    def open(cls, spark: SparkSession, root: str, config: GridConfig | None = None) -> GridStore:
        read = lambda name: spark.read.parquet(f"{root}/{name}")
        return cls(spark.read.schema(SCHEMA).option("basePath", f"{root}/grid").parquet(f"{root}/grid"), read("days"), read("lon_axis"), read("lat_axis"), config)

    @classmethod
    def of_cells(cls, grid: DataFrame, config: GridConfig | None = None) -> GridStore:
        """A store over a table of cells; its manifest and axes are taken from the cells."""
        return cls(grid, grid.select("date").distinct(), grid.select("lon_idx", "lon").distinct(), grid.select("lat_idx", "lat").distinct(), config)

    def cells(self, days: list[dt.date], i0: int, i1: int, j0: int, j1: int, fields: list[str] | tuple[str, ...] = FIELDS) -> DataFrame:
        """The table that a request for some days, an index range of both axes and some fields is to be filtered from. Here that is all cells, since filters on partitions and
        sorted columns reach the Parquet scan; other formats give no more than the request needs."""
        return self.grid

    def views(self, prefix: str = "") -> None:
        """Temporary views for SQL: grid, days, lon_axis and lat_axis."""
        for name in ("grid", "days", "lon_axis", "lat_axis"):
            getattr(self, name).createOrReplaceTempView(f"{prefix}{name}")

    def bounds(self) -> DataFrame:
        return self.days.agg(F.min("date").alias("earliest"), F.max("date").alias("latest"))

    def axis_bounds(self) -> DataFrame:
        lon = self.lon_axis.agg(F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"))
        return lon.crossJoin(self.lat_axis.agg(F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max")))  # a row each

    def gaps(self) -> DataFrame:
        """Calendar days between the bounds that don't exist."""
        calendar = self.bounds().filter("earliest is not null").select(F.explode(F.sequence("earliest", "latest")).alias("date"))
        return calendar.join(self.days, "date", "left_anti")

    def calendar(self) -> list[dt.date]:
        """All days that exist, ascending; a row for each, so a century is 36,525. Read anew for each request, so new days are seen at once."""
        found = sorted({r["date"] for r in self.days.select("date").collect()} - {None})
        if not found:
            raise Unavailable(say.NO_DATES)
        return found

    def span(self) -> tuple[dt.date, dt.date]:
        found = self.calendar()
        return found[0], found[-1]

    @cached_property
    def axes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """lon_idx, lon, lat_idx, lat, each ascending by index, as 32-bit values. An axis is the edge of the grid, so its length is bounded."""
        pick = lambda k, table, idx, value: table.select(F.lit(k).alias("k"), F.col(idx).cast("long").alias("i"), F.col(value).cast("float").alias("v")).limit(LONGEST_AXIS + 1)
        rows = pick(0, self.lon_axis, "lon_idx", "lon").unionByName(pick(1, self.lat_axis, "lat_idx", "lat")).collect()
        out = []
        for k, name in enumerate(("lon", "lat")):
            own = sorted({(r["i"], r["v"]) for r in rows if r["k"] == k})
            if not own:
                raise BadRequest(say.NO_GROUPS_IN_SPAN)
            if len(own) > LONGEST_AXIS:
                raise BadRequest(f"The {name} axis has over {LONGEST_AXIS:,} cells.")
            out += [np.array([i for i, _ in own], np.int64), np.array([v for _, v in own], np.float32)]
        return tuple(out)

    def nearest(self, lon: float, lat: float) -> tuple[int, int]:
        """lon_idx and lat_idx of the nearest cell. Inputs are clamped to the axis; distances are 32-bit, and of equal ones the lower index counts."""
        lon_idx, lons, lat_idx, lats = self.axes
        pick = lambda idx, axis, v: int(idx[np.abs(axis - np.float32(min(max(v, float(axis.min())), float(axis.max())))).argmin()])
        return pick(lon_idx, lons, lon), pick(lat_idx, lats, lat)
