"""NetCDF granules, where the netCDF4 package is installed; elsewhere granules come as Parquet or any other table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..errors import BadRequest
from .granules import ALIASES

try:
    import netCDF4
except ImportError:
    netCDF4 = None

SCHEMA = "time timestamp, path string, lat_idx int, lon_idx int, lat float, lon float, sst float, sst_anomaly float, sea_ice float, units string"


def read_granules(spark: SparkSession, path: str, rows: int = 1024) -> DataFrame:
    """Cells of each file in ``path`` with its source units; granules.normalise makes them store cells. A file is one task, and goes out ``rows`` grid lines at a time."""
    if netCDF4 is None:
        raise BadRequest("Reading NetCDF needs the netCDF4 package.")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with netCDF4.Dataset("granule", memory=bytes(content)) as ds:
                    pick = lambda k: next((ds[a] for a in ALIASES[k] if a in ds.variables), None)  # noqa: B023, E731
                    lat, lon = np.asarray(pick("lat")[:], np.float32), np.asarray(pick("lon")[:], np.float32)
                    sst = pick("sst")
                    when = pd.Timestamp(str(netCDF4.num2date(ds["time"][0], ds["time"].units))) if "time" in ds.variables else pd.NaT
                    for at in range(0, len(lat), rows):
                        j, i = (x.ravel() for x in np.meshgrid(np.arange(at, min(at + rows, len(lat))), np.arange(len(lon)), indexing="ij"))
                        value = lambda v: np.ma.filled(v[..., at : at + rows, :].astype(np.float32), np.nan).ravel() if v is not None else np.full(len(i), np.nan, np.float32)  # noqa: B023, E731
                        yield pd.DataFrame({"time": when, "path": name, "lat_idx": j, "lon_idx": i, "lat": lat[j], "lon": lon[i], "sst": value(sst), "sst_anomaly": value(pick("sst_anomaly")), "sea_ice": value(pick("sea_ice")), "units": getattr(sst, "units", None)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, SCHEMA)
