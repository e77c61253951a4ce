"""Bytes of chunked arrays: the codecs of Zarr version 3 in numpy and zstandard, and a decoder for the Blosc container."""

from __future__ import annotations

import gzip
import zlib

import numpy as np

#: Zarr data types and their numpy kinds.
KINDS = {"bool": "?", "int8": "i1", "int16": "i2", "int32": "i4", "int64": "i8", "uint8": "u1", "uint16": "u2", "uint32": "u4", "uint64": "u8", "float32": "f4", "float64": "f8"}


def zstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


def unshuffled(data: bytes, size: int) -> bytes:
    """Bytes of one place stand together; whole elements only, the rest follows as it is."""
    n = len(data) // size * size
    return np.frombuffer(data[:n], np.uint8).reshape(size, -1).T.tobytes() + data[n:]


def unshuffled_bits(data: bytes, size: int) -> bytes:
    """Bits of one place stand together, over blocks of eight elements; the rest follows as it is."""
    n = len(data) // size // 8 * 8
    planes = np.unpackbits(np.frombuffer(data[: n * size], np.uint8).reshape(size * 8, -1), axis=1, bitorder="little")
    return np.packbits(planes.T.reshape(n, size * 8), axis=1, bitorder="little").tobytes() + data[n * size :]


def blosc(data: bytes) -> bytes:
    """A Blosc 1 container whose blocks are stored, zlib or zstd."""
    flags, size = data[2], data[3]
    total, block = (int.from_bytes(data[k : k + 4], "little") for k in (4, 8))
    if flags & 0x2:
        return data[16 : 16 + total]
    codec = flags >> 5
    unpack = {3: zlib.decompress, 4: zstd}.get(codec)
    if unpack is None:
        raise ValueError(f"blosc codec {codec} isn't supported")
    count = -(-total // block)
    out = []
    for k in range(count):
        at = int.from_bytes(data[16 + 4 * k : 20 + 4 * k], "little")
        own = min(block, total - k * block)
        # a full block of wide elements is cut into as many streams as an element has bytes
        parts = 1 if flags & 0x10 or own < block or size > 16 else size
        pieces = []
        for _ in range(parts):
            n = int.from_bytes(data[at : at + 4], "little")
            raw = data[at + 4 : at + 4 + n]
            pieces.append(raw if n == own // parts else unpack(raw))
            at += 4 + n
        joined = b"".join(pieces)
        out.append(unshuffled(joined, size) if flags & 0x1 and size > 1 else unshuffled_bits(joined, size) if flags & 0x4 else joined)
    return b"".join(out)


def decoded(data: bytes, meta: dict) -> np.ndarray:
    """A chunk as an array of its full chunk shape."""
    shape = meta["chunk_grid"]["configuration"]["chunk_shape"]
    order = "<"
    for codec in reversed(meta["codecs"]):
        name, conf = codec["name"], codec.get("configuration", {})
        if name == "blosc":
            data = blosc(data)
        elif name == "zstd":
            data = zstd(data)
        elif name == "gzip":
            data = gzip.decompress(data)
        elif name == "crc32c":
            data = data[:-4]
        elif name == "bytes":
            order = ">" if conf.get("endian") == "big" else "<"
        else:
            raise ValueError(f"codec {name} isn't supported")
    return np.frombuffer(data, np.dtype(order + KINDS[meta["data_type"]])).reshape(shape)


def fill(meta: dict) -> np.ndarray:
    """A chunk that isn't stored."""
    value = meta.get("fill_value")
    return np.full(meta["chunk_grid"]["configuration"]["chunk_shape"], np.nan if value in (None, "NaN") else value, KINDS[meta["data_type"]])


def chunk_key(meta: dict, *place: int) -> str:
    conf = meta.get("chunk_key_encoding", {}).get("configuration", {})
    sep = conf.get("separator", "/")
    return sep.join(["c", *map(str, place)])
