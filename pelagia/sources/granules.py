"""Source granules: a day's cells with source names, units and perhaps a time axis, made into store cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BadRequest
from ..functions.columns import celsius, clean, granule_date
from .store import FIELDS, SCHEMA

#: Names in source granules that stand for ours.
ALIASES = {"lon": ("lon", "longitude", "x"), "lat": ("lat", "latitude", "y"), "sst": ("sst", "analysed_sst"), "sst_anomaly": ("sst_anomaly",), "sea_ice": ("sea_ice", "sea_ice_fraction")}


def resolve(df: DataFrame, name: str) -> str | None:
    return next((x for x in ALIASES[name] if x in df.columns), None)


def normalise(df: DataFrame, units: str = "units") -> DataFrame:
    """Cells with the store's columns. The date is the column ``date``, or the day in the file's name, or that of the column ``time``; lat_idx and lon_idx must
    be there. The temperature becomes Celsius if ``units`` says Kelvin; the anomaly never changes. NaN becomes null; fields that a granule lacks are null."""
    names = {k: resolve(df, k) for k in ALIASES}
    if not names["lon"] or not names["lat"]:
        raise BadRequest("The granule has no coordinates.")
    if "date" in df.columns:
        date = F.col("date").cast("date")
    else:
        time = F.col("time").cast("date") if "time" in df.columns else F.lit(None).cast("date")
        date = F.coalesce(granule_date(F.col("_metadata.file_path")), time)
    value = lambda k: clean(F.col(names[k]).cast("float")) if names[k] else F.lit(None).cast("float")
    sst = celsius(value("sst"), units) if units in df.columns else value("sst")
    fields = {"sst": sst} | {f: value(f) for f in FIELDS[1:]}
    return df.select(date.alias("date"), F.col("lat_idx").cast("int"), F.col("lon_idx").cast("int"), F.col(names["lat"]).cast("float").alias("lat"), F.col(names["lon"]).cast("float").alias("lon"), *(v.alias(k) for k, v in fields.items())).select(*SCHEMA.names)


def tiles(cells: DataFrame, edge: int = 1024) -> DataFrame:
    """The tile layout of cells: a row for each day and tile, its cells as arrays of structs by place."""
    at = cells.withColumns({"tile_i": F.expr(f"lat_idx div {edge}").cast("int"), "tile_j": F.expr(f"lon_idx div {edge}").cast("int")})
    return at.groupBy("date", "tile_i", "tile_j").agg(F.array_sort(F.collect_list(F.struct("lat_idx", "lon_idx", "lat", "lon", *FIELDS))).alias("cells"))  # edge * edge cells at most


def cells_of(tiled: DataFrame) -> DataFrame:
    return tiled.select("date", F.explode("cells").alias("c")).select("date", "c.*").select(*SCHEMA.names)
