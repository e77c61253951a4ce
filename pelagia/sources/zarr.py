"""Zarr version 3 stores of daily groups (root/YYYY/MM/DD) as store cells.

Metadata and coordinates are listed and read on the driver through Hadoop's file system, so any store that Spark reads will do; chunks come as ``binaryFile`` rows and are
decoded in batches on the executors. A chunk is one task row; cells never pass the driver. ``write_zarr`` writes such stores.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import GridConfig
from ..errors import BadRequest
from .chunks import chunk_key, decoded, fill
from .granules import ALIASES
from .store import FIELDS, LONGEST_AXIS, SCHEMA, GridStore


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _folders(spark: SparkSession, path: str) -> list[str]:
    p, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def _read(spark: SparkSession, path: str) -> bytes | None:
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def days(spark: SparkSession, root: str) -> list[str]:
    """The days that have a group: folders of four, two and two digits."""
    digits = lambda path, n: [x for x in _folders(spark, path) if re.fullmatch(f"[0-9]{{{n}}}", x)]
    return [f"{y}-{m}-{d}" for y in digits(root, 4) for m in digits(f"{root}/{y}", 2) for d in digits(f"{root}/{y}/{m}", 2)]


def _array(spark: SparkSession, path: str) -> np.ndarray:
    """A whole one-dimensional array: a coordinate."""
    meta = json.loads(_read(spark, f"{path}/zarr.json"))
    n, step = meta["shape"][0], meta["chunk_grid"]["configuration"]["chunk_shape"][0]
    parts = [decoded(data, meta) if (data := _read(spark, f"{path}/{chunk_key(meta, k)}")) is not None else fill(meta) for k in range(-(-n // step))]
    return np.concatenate(parts)[:n].astype(np.float32)


class ZarrStore(GridStore):
    """A Zarr root as a store. A request's chunks are listed from its days, index ranges and fields before anything is read, and only their files are. Axes, chunk sizes and
    codecs are those of the first day: grids are taken to be the same."""

    def __init__(self, spark: SparkSession, root: str, picked: list[str], config: GridConfig | None = None):
        self.spark, self.root, self.picked = spark, root.rstrip("/"), picked
        self.groups = {d: f"{self.root}/{d.replace('-', '/')}" for d in picked}
        self.inside = {d: set(_folders(spark, g)) for d, g in self.groups.items()}
        self.first = next((d for d in picked if self.inside[d]), None)
        self.lon, self.lat = (_array(spark, f"{self.groups[self.first]}/{n}") if self.first and (n := self._name(k, self.first)) else np.zeros(0, np.float32) for k in ("lon", "lat"))
        found = {f: next((f"{self.groups[d]}/{n}" for d in picked if (n := self._name(f, d))), None) for f in FIELDS}
        self.metas = {f: json.loads(_read(spark, f"{x}/zarr.json")) for f, x in found.items() if x}
        table = lambda v, idx, name: spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], f"{idx} int, {name} float")
        manifest = spark.createDataFrame([(d,) for d in picked], "d string").select(F.col("d").cast("date").alias("date"))
        super().__init__(None, manifest, table(self.lon, "lon_idx", "lon"), table(self.lat, "lat_idx", "lat"), config)

    @property
    def grid(self) -> DataFrame:
        """All cells of all days, in one plan."""
        return self._decoded(self.picked, 0, len(self.lon) - 1, 0, len(self.lat) - 1, FIELDS)

    @grid.setter
    def grid(self, _: DataFrame | None) -> None:
        """Nothing is kept: cells are read when they are asked for."""

    def cells(self, days: list[dt.date], i0: int, i1: int, j0: int, j1: int, fields: list[str] | tuple[str, ...] = FIELDS) -> DataFrame:
        wanted = {f"{d:%Y-%m-%d}" for d in days}
        return self._decoded([d for d in self.picked if d in wanted], i0, i1, j0, j1, tuple(f for f in FIELDS if f in fields))

    def _name(self, key: str, day: str) -> str | None:
        return next((a for a in ALIASES[key] if a in self.inside[day]), None)

    def _stored(self, folder: str, lead: tuple[int, ...], rows: range, cols: range) -> list[str]:
        """Chunk files of a field that are there, of some chunk rows and columns: a listing for each chunk row, none of the whole array."""
        out = []
        for a in rows:
            base = "/".join(["c", *map(str, lead), str(a)])
            p, fs = _fs(self.spark, f"{folder}/{base}")
            if fs.exists(p):
                there = {x.getPath().getName() for x in fs.listStatus(p)}
                out += [f"{folder}/{base}/{b}" for b in cols if str(b) in there]
        return out

    def _decoded(self, days: list[str], i0: int, i1: int, j0: int, j1: int, fields: tuple[str, ...]) -> DataFrame:
        """Cells as a store has them. A field that isn't asked for, that a day lacks, or whose chunk isn't stored, is null; NaN is null."""
        metas = {f: self.metas[f] for f in fields if f in self.metas}
        if not days or not self.metas:
            return self.spark.createDataFrame([], SCHEMA)
        shape = next(iter(self.metas.values()))["chunk_grid"]["configuration"]["chunk_shape"]
        (rows, cols), lead = shape[-2:], (0,) * (len(shape) - 2)  # a time axis of length one may stand before the two others
        a, b = range(j0 // rows, j1 // rows + 1), range(i0 // cols, i1 // cols + 1)
        tiles = self.spark.createDataFrame([(d,) for d in days], "date string")
        tiles = tiles.select("date", F.explode(F.sequence(F.lit(a[0]), F.lit(a[-1]))).alias("a")).select("date", "a", F.explode(F.sequence(F.lit(b[0]), F.lit(b[-1]))).alias("b"))
        here = []
        for f in metas:
            paths = [x for d in days if (n := self._name(f, d)) for x in self._stored(f"{self.groups[d]}/{n}", lead, a, b)]
            if not paths:
                continue
            here.append(f)
            files = self.spark.read.format("binaryFile").load(paths)
            part = lambda pattern, k: F.regexp_extract("path", pattern, k)
            date = F.concat_ws("-", *(part(r"/([0-9]{4})/([0-9]{2})/([0-9]{2})/[^0-9/]+/c/", k) for k in (1, 2, 3)))
            place = [part(r"([0-9]+)[/.]([0-9]+)$", k).cast("int") for k in (1, 2)]
            tiles = tiles.join(files.select(date.alias("date"), place[0].alias("a"), place[1].alias("b"), F.col("content").alias(f)), ["date", "a", "b"], "left")
        lon, lat = self.lon, self.lat

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    a, b = batch.column("a")[k].as_py(), batch.column("b")[k].as_py()
                    j, i = np.arange(a * rows, min((a + 1) * rows, len(lat))), np.arange(b * cols, min((b + 1) * cols, len(lon)))
                    jj, ii = (x.ravel() for x in np.meshgrid(j, i, indexing="ij"))
                    out = {"date": pa.array([batch.column("date")[k].as_py()] * len(jj)), "lat_idx": pa.array(jj.astype(np.int32)), "lon_idx": pa.array(ii.astype(np.int32)), "lat": pa.array(lat[jj]), "lon": pa.array(lon[ii])}
                    for f in FIELDS:
                        data = batch.column(f)[k].as_py() if f in here else None
                        if data is None and (f not in metas or metas[f].get("fill_value") in (None, "NaN")):
                            out[f] = pa.nulls(len(jj), pa.float32())
                            continue
                        values = (decoded(data, metas[f]) if data is not None else fill(metas[f])).reshape(rows, cols)[: len(j), : len(i)].astype(np.float32).ravel()
                        out[f] = pa.array(values, mask=np.isnan(values))
                    yield pa.RecordBatch.from_pydict(out)

        schema = "date string, lat_idx int, lon_idx int, lat float, lon float, " + ", ".join(f"{f} float" for f in FIELDS)
        return tiles.mapInArrow(run, schema).withColumn("date", F.col("date").cast("date")).select(*SCHEMA.names)


def open_zarr(spark: SparkSession, root: str, wanted: list[str] | None = None, config: GridConfig | None = None) -> ZarrStore:
    """A store over some days of a Zarr root, or all. Days that aren't picked don't exist for it."""
    return ZarrStore(spark, root, [d for d in days(spark, root) if wanted is None or d in wanted], config)


def _meta(shape: list[int], chunk: list[int], names: list[str]) -> dict:
    return {
        "zarr_format": 3, "node_type": "array", "shape": shape, "data_type": "float32", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunk}},
        "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": "NaN",
        "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "zstd", "configuration": {"level": 5, "checksum": False}}], "dimension_names": names, "attributes": {},
    }


def _write(spark: SparkSession, path: str, data: bytes) -> None:
    p, fs = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def write_zarr(cells: DataFrame, root: str, config: GridConfig | None = None, replace: bool = False, source: str = "") -> list[dt.date]:
    """Writes the days of ``cells`` that the root lacks (or all, with ``replace``) as daily groups, and returns them. A tile is a task's group and a chunk of each field; chunks are
    compressed and written by the executors through Arrow's file systems (local or mounted folders, hdfs, s3, gs), metadata by the driver, a group's own at last. Chunks without a value aren't stored. All days share the axes of
    ``cells``."""
    spark, edge, root = cells.sparkSession, (config or GridConfig()).tile, root.rstrip("/")
    there = set(days(spark, root))
    fresh = sorted(r["date"] for r in cells.select("date").distinct().collect() if replace or f"{r['date']:%Y-%m-%d}" not in there)  # a row for each day
    axes = {k: sorted((r[0], r[1]) for r in cells.select(f"{k}_idx", k).distinct().limit(LONGEST_AXIS + 1).collect()) for k in ("lat", "lon")}
    size = {}
    for k, found in axes.items():
        if [i for i, _ in found] != list(range(len(found))):
            raise BadRequest(f"The {k} axis must have one coordinate for each index from 0.")
        size[k] = len(found)
    group = lambda d: f"{root}/{d:%Y/%m/%d}"

    def encode(table: pa.Table) -> pa.Table:
        import pyarrow.fs
        import zstandard

        day, a, b = (table.column(k)[0].as_py() for k in ("date", "a", "b"))
        j, i = (table.column(k).to_numpy() - n * edge for k, n in (("lat_idx", a), ("lon_idx", b)))
        shape, done = (min(edge, size["lat"]), min(edge, size["lon"])), 0
        for f in FIELDS:
            values = np.full(shape, np.nan, "<f4")
            values[j, i] = table.column(f).to_numpy().astype(np.float32)
            if np.isnan(values).all():
                continue
            uri = re.sub("^s3[an]:", "s3:", f"{group(day)}/{f}/c/{a}/{b}")
            fs, path = pyarrow.fs.FileSystem.from_uri(re.sub("^file:/+", "/", uri))
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(path) as out:
                out.write(zstandard.ZstdCompressor(level=5).compress(values.tobytes()))
            done += 1
        return pa.table({"chunks": pa.array([done], pa.int64())})

    place = [F.expr(f"lat_idx div {edge}").alias("a"), F.expr(f"lon_idx div {edge}").alias("b")]
    tiled = cells.filter(F.col("date").isin(fresh)).select("date", "lat_idx", "lon_idx", *FIELDS, *place)
    tiled.groupBy("date", "a", "b").applyInArrow(encode, "chunks bigint").agg(F.sum("chunks")).collect()
    import zstandard

    for d in fresh:
        for k in ("lat", "lon"):
            values = np.array([x for _, x in axes[k]], "<f4")
            _write(spark, f"{group(d)}/{k}/c/0", zstandard.ZstdCompressor(level=5).compress(values.tobytes()))
            _write(spark, f"{group(d)}/{k}/zarr.json", json.dumps(_meta([size[k]], [size[k]], [k])).encode())
        for f in FIELDS:
            chunk = [min(edge, size["lat"]), min(edge, size["lon"])]
            _write(spark, f"{group(d)}/{f}/zarr.json", json.dumps(_meta([size["lat"], size["lon"]], chunk, ["lat", "lon"])).encode())
        about = {"date": f"{d:%Y-%m-%d}", "source": source, "variables": [*FIELDS], "coords": ["lat", "lon"]}
        _write(spark, f"{group(d)}/zarr.json", json.dumps({"zarr_format": 3, "node_type": "group", "attributes": about}).encode())
    return fresh
