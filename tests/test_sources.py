from __future__ import annotations

import datetime as dt
import gzip
import json
import zlib

import numpy as np
import pytest
import zstandard

from pelagia.config import GridConfig
from pelagia.errors import BadRequest, NotFound, ToolError
from pelagia.plans import requests
from pelagia.sources import chunks
from pelagia.sources.fetch import retrying
from pelagia.sources.store import SCHEMA
from pelagia.sources.zarr import days, open_zarr
from pelagia.sources.zarr import write_zarr as write_zarr_days


def container(raw: bytes, size: int, block: int, flags: int, pack) -> bytes:
    """A Blosc container written plainly: one stream a block."""
    shuffle = lambda b: np.frombuffer(b, np.uint8).reshape(-1, size).T.tobytes()

    def bits(b):
        x = np.unpackbits(np.frombuffer(b, np.uint8).reshape(-1, size), axis=1, bitorder="little")
        return np.packbits(x.T, axis=1, bitorder="little").tobytes()

    parts = [raw[k : k + block] for k in range(0, len(raw), block)]
    packed = [pack(shuffle(p) if flags & 1 else bits(p) if flags & 4 else p) for p in parts]
    at, offsets = 16 + 4 * len(parts), []
    for p in packed:
        offsets.append(at)
        at += 4 + len(p)
    head = bytes([2, 1, flags | 0x10, size]) + b"".join(n.to_bytes(4, "little") for n in (len(raw), block, at))
    return head + b"".join(o.to_bytes(4, "little") for o in offsets) + b"".join(len(p).to_bytes(4, "little") + p for p in packed)


@pytest.mark.parametrize(("flags", "pack"), [(4 << 5, zstandard.compress), (4 << 5 | 1, zstandard.compress), (4 << 5 | 4, zstandard.compress), (3 << 5 | 1, zlib.compress)])
def test_blosc(flags, pack):
    raw = np.arange(640, dtype="<f4").tobytes()
    assert chunks.blosc(container(raw, 4, 1024, flags, pack)) == raw
    stored = bytes([2, 1, 0x2, 4]) + (len(raw)).to_bytes(4, "little") + b"\0" * 8 + raw
    assert chunks.blosc(stored) == raw


def write_zarr(folder, values, codec, chunk):
    folder.mkdir(parents=True)
    codecs = [{"name": "bytes", "configuration": {"endian": "little"}}] + ([{"name": codec}] if codec else [])
    pack = {None: bytes, "zstd": zstandard.compress, "gzip": gzip.compress, "blosc": lambda b: container(b, 4, 64, 4 << 5 | 4, zstandard.compress)}[codec]
    meta = {"zarr_format": 3, "node_type": "array", "shape": list(values.shape), "data_type": "float32", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunk}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": "NaN", "codecs": codecs}
    (folder / "zarr.json").write_text(json.dumps(meta))
    counts = [-(-n // c) for n, c in zip(values.shape, chunk, strict=True)]
    for place in np.ndindex(*counts):
        part = values[tuple(slice(k * c, (k + 1) * c) for k, c in zip(place, chunk, strict=True))]
        if np.isnan(part).all():
            continue  # not stored
        full = np.full(chunk, np.nan, "<f4")
        full[tuple(slice(0, n) for n in part.shape)] = part
        path = folder.joinpath("c", *map(str, place))
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(pack(full.tobytes()))


@pytest.mark.parametrize("codec", [None, "zstd", "gzip", "blosc"])
def test_zarr_days(spark, tmp_path, codec):
    sst = np.arange(35, dtype=np.float32).reshape(5, 7)
    sst[4, 4:] = np.nan
    for day in ("2024/01/02", "2024/01/04"):
        g = tmp_path / day
        write_zarr(g / "lon", np.float32(100 + np.arange(7) / 100), codec if codec != "blosc" else None, [4])
        write_zarr(g / "latitude", np.float32(20 + np.arange(5) / 100), None, [5])
        write_zarr(g / "sst", sst, codec, [4, 4])
    (tmp_path / "2024/1").mkdir()
    root = f"file://{tmp_path}"
    assert days(spark, root) == ["2024-01-02", "2024-01-04"]
    st = open_zarr(spark, root, ["2024-01-04"])
    rows = requests.read(st, 100, 20, 101, 21, start="2024-01-04", append="sst,sea_ice").collect()
    assert [r["sst"] for r in rows] == [None if np.isnan(v) else v for v in sst.ravel().tolist()]
    assert all(r["sea_ice"] is None for r in rows)
    assert requests.read(open_zarr(spark, root), 100.021, 20.009).first()["sst"] == 9.0
    with pytest.raises(BadRequest, match="unavailable"):  # a day that wasn't picked doesn't exist
        requests.read(st, 100, 20, 101, 21, start="2024-01-02")
    assert st.calendar() == [dt.date(2024, 1, 4)]


def names(df):
    return sorted(x.split("/sst/")[1] if "/sst/" in x else x.split("/sea_ice/")[1] + " ice" for x in df.inputFiles())


def test_a_request_reads_only_its_chunks(spark, tmp_path):
    values = np.arange(20 * 30, dtype=np.float32).reshape(20, 30)
    for day in ("2024/01/02", "2024/01/03"):
        g = tmp_path / day
        write_zarr(g / "lon", np.float32(100 + np.arange(30) / 100), None, [30])
        write_zarr(g / "lat", np.float32(20 + np.arange(20) / 100), None, [20])
        write_zarr(g / "sst", values, "zstd", [5, 5])
        write_zarr(g / "sea_ice", values / 600, "zstd", [5, 5])
    st = open_zarr(spark, f"file://{tmp_path}")
    d = [dt.date(2024, 1, 2)]
    assert names(st.cells(d, 7, 7, 3, 3, ["sst"])) == ["c/0/1"]
    assert names(st.cells(d, 4, 5, 9, 10, ["sst"])) == ["c/1/0", "c/1/1", "c/2/0", "c/2/1"]
    assert names(st.cells(d, 7, 7, 3, 3, ["sst", "sea_ice"])) == ["c/0/1", "c/0/1 ice"]
    assert len(st.grid.inputFiles()) == 2 * 2 * 24
    box = requests.read(st, 100.04, 20.09, 100.05, 20.10, start="2024-01-02", append="sst")
    assert [r["sst"] for r in box.collect()] == [values[9, 4], values[9, 5], values[10, 4], values[10, 5]]
    assert len(requests.read(st, 100.07, 20.03, start="2024-01-01", end="2024-01-09").collect()) == 2


def test_zarr_round_trip(spark, tmp_path):
    rows = [(dt.date(2024, 1, d), j, i, 10 + j / 100, 50 + i / 100, float(100 * d + 10 * j + i) if (i, j) != (1, 1) else None, 0.5 if d == 1 else None, None) for d in (1, 2) for j in range(5) for i in range(7)]
    cells = spark.createDataFrame(rows, SCHEMA)
    root = f"file://{tmp_path}/z"
    config = GridConfig(tile=3)
    assert write_zarr_days(cells, root, config) == [dt.date(2024, 1, 1), dt.date(2024, 1, 2)]
    assert write_zarr_days(cells, root, config) == []
    st = open_zarr(spark, root)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, st.grid.collect())) == sorted(map(key, cells.collect()))
    assert json.loads((tmp_path / "z/2024/01/01/zarr.json").read_text())["attributes"]["variables"] == ["sst", "sst_anomaly", "sea_ice"]
    assert not (tmp_path / "z/2024/01/01/sea_ice/c").exists()  # no value, no chunk
    with pytest.raises(BadRequest, match="axis"):
        write_zarr_days(cells.filter("lon_idx <> 2"), f"{root}2", config)


def test_retries():
    pauses: list[float] = []
    answers = iter([(503, "busy"), (429, "busy"), (200, "{}")])
    assert retrying(lambda _: next(answers), sleep=pauses.append)({}) == "{}" and pauses == [0.75, 1.5]
    with pytest.raises(ToolError, match=r"error \(502\): gone"):
        retrying(lambda _: (502, '{"detail": "gone"}'), sleep=pauses.append)({})
    with pytest.raises(NotFound, match="none"):
        retrying(lambda _: (404, '{"detail": "none"}'))({})
    with pytest.raises(ToolError, match="400"):
        retrying(lambda _: (400, "bad"))({})

    def broken(_):
        raise OSError("no route")

    with pytest.raises(ToolError, match="no route"):
        retrying(broken, sleep=pauses.append)({})
