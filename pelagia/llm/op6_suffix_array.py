"""Suffix-array dedup of byte strings.

Texts are reduced to runs of 400-byte strings that share an anchor, and runs whose anchor occurs once are done with (see spans). All others are decided by
suffix arrays: runs are cut into blocks of sixteen bytes, counted from the anchor, so equal strings have equal blocks; the blocks of many runs are one integer sequence, whose
suffix array is built by linear grouping (suffix_array). Neighbours in it that agree in 24 blocks form a class; a string is that class together with
the sixteen bytes around it, so strings are compared byte by byte, not by hashes. An array holds two places of each different run at most.

Scale: a suffix array covers a bounded batch of anchor groups, about a megabyte of text; groups of more than ``MOST`` different runs are cut into several batches (see spans).
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .spans import CHUNK, Units, anchored, mix, often, repeated
from .suffix_array import suffix_array

WINDOW, GRAM, BLOCK, MOST, SYMBOLS = 400, 64, 16, 256, 1 << 16
_BASE = 0x2545F4914F6CDD1D
_BYTE = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse, mod 2**64."""
    n = 1 << max(12, n.bit_length())
    if n not in _powers:
        _powers.clear()
        one = lambda b: np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, b, np.uint64))), dtype=np.uint64)
        _powers[n] = one(_BASE), one(pow(_BASE, -1, 1 << 64))
    return _powers[n]


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    up, down = powers(len(raw))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * up[: len(raw)], dtype=np.uint64)))
    return mix((sums[gram:] - sums[:-gram]) * down[: len(raw) - gram + 1])


def byte_anchors(text: bytes, window: int, gram: int):
    parts = []
    view = memoryview(text)
    for a in range(0, len(text) - window + 1, CHUNK):
        raw = np.frombuffer(text, np.uint8, min(CHUNK + window - 1, len(text) - a), a)
        g = gram_hashes(raw, gram)
        at, lo, n = anchored(g, window - gram + 1)
        sw = np.fromiter((xxhash.xxh3_64_intdigest(view[s:e]) for s, e in zip((lo + a).tolist(), (lo + n + (a + window - 1)).tolist(), strict=True)), np.uint64, len(lo))
        parts.append((g[at], sw, lo + a, n))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def classes(runs: list[bytes], window: int = WINDOW, gram: int = GRAM) -> list[np.ndarray]:
    """For each run a number for each of its places, the same for two places exactly if the ``window`` bytes there are equal. The last place of a run is its
    length less the window."""
    deep = (window - BLOCK) // BLOCK  # blocks that lie in a string wherever it starts
    inner = deep * BLOCK
    skip, symbols = [], []
    for r in runs:
        g = gram_hashes(np.frombuffer(r, np.uint8), gram)
        first = g[: window - gram + 1]
        s = int((first & ~np.uint64(2 * CHUNK - 1)).argmin()) % BLOCK  # the anchor of the first window is that of all
        skip.append(s)
        symbols.append(np.frombuffer(r, f"V{BLOCK}", (len(r) - s) // BLOCK, s))
    total = np.concatenate(symbols)
    names = np.unique(total.view("<u8").reshape(-1, 2), axis=0, return_inverse=True)[1].ravel() + 1
    ends = np.cumsum([len(s) + 1 for s in symbols])
    text = np.zeros(ends[-1], np.int64)
    keep = np.ones(len(text), bool)
    keep[ends - 1] = False  # a zero ends each run
    text[keep] = names
    sa = np.array(suffix_array(text))
    # neighbours that agree in `deep` blocks and reach no end
    same = np.ones(len(sa) - 1, bool)
    padded = np.concatenate((text, np.zeros(deep, np.int64)))
    for k in range(deep):
        i = np.flatnonzero(same)
        a, b = padded[sa[i] + k], padded[sa[i + 1] + k]
        same[i] = (a == b) & (a > 0)
    cluster = np.empty(len(sa), np.int64)
    cluster[sa] = np.concatenate(([0], np.cumsum(~same)))
    # every start of every run: class of the first block boundary, bytes before it, bytes after the blocks
    buffer = np.frombuffer(b"".join(runs), np.uint8)
    base = np.cumsum([0, *map(len, runs)])
    base_symbol = np.concatenate(([0], ends[:-1]))
    keys = []
    j = np.arange(window - inner)[None]
    for k, r in enumerate(runs):
        q = np.arange(len(r) - window + 1)
        t = (skip[k] - q) % BLOCK
        block = (q + t - skip[k]) // BLOCK
        at = base[k] + q[:, None] + j + np.where(j >= t[:, None], inner, 0)
        keys.append(np.concatenate((buffer[at], t[:, None].astype(np.uint8), cluster[base_symbol[k] + block].astype("<i8").view(np.uint8).reshape(-1, 8)), axis=1))
    rows = np.ascontiguousarray(np.concatenate(keys))
    inverse = np.unique(rows.view(f"V{rows.shape[1]}").ravel(), return_inverse=True)[1].ravel()
    return np.split(inverse, np.cumsum([len(r) - window + 1 for r in runs])[:-1])


def byte_units(window: int, gram: int) -> Units:
    def kept(x: bytes, s: np.ndarray, e: np.ndarray) -> bytes:
        return b"".join(x[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(x)], strict=True))

    def cut(p: bytes) -> list[bytes]:
        return [p[k : k + window] for k in range(len(p) - window + 1)]

    return Units(window, lambda t: t, len, lambda t: byte_anchors(t, window, gram), lambda t, lo, n: t[lo : lo + n + window - 1], kept, lambda runs: classes(runs, window, gram), cut)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, most: int = MOST, symbols: int = SYMBOLS, digest: bool = False) -> DataFrame:
    """One row for each input row: id, n_units (bytes), n_removed, n_spans, spans (byte places) and kept (the remaining bytes, which may split a character, or
    their digest). A byte goes if a string of ``window`` bytes over it also starts anywhere else, in the same document or another one; strings are
    judged on the input, and never cross documents. ``window`` is a multiple of 16 and at least 16 more than ``gram``.

    Null and empty texts have no bytes; texts shorter than a window keep all. Repeated rows are copies of each other, so their strings go. Null ids are
    ids like others. An empty table gives an empty result. Other columns aren't read."""
    return repeated(df, id_col, text_col, byte_units(window, gram), often, digest, most, symbols * BLOCK)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(table(spark, sf_dir, "documents"), digest=True)
    return rows.select(F.col("id").alias("doc_id"), F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
parts AS (SELECT doc_id, n, f, substr(x, 2 * f + 1, 2800) AS x, least(1000, n - f) AS m FROM (SELECT *, unnest(generate_series(0, n - 1, 1000)) AS f FROM d WHERE n > 0)),
pos AS (
  SELECT doc_id, unnest(generate_series(f + 1, f + m)) AS p, unnest(list_transform(generate_series(1, m), lambda k: substr(x, 2 * k - 1, 2))) AS c,
         unnest(list_transform(generate_series(1, m), lambda k: CASE WHEN f + k + 399 <= n THEN sha256(substr(x, 2 * k - 1, 800)) END)) AS s
  FROM parts),
often AS (SELECT s FROM pos WHERE s IS NOT NULL GROUP BY s HAVING count(*) > 1),
marked AS (
  SELECT doc_id, c, p, coalesce(max(CASE WHEN often.s IS NOT NULL THEN p END) OVER (PARTITION BY doc_id ORDER BY p) > p - 400, false) AS gone
  FROM pos LEFT JOIN often ON pos.s = often.s),
edged AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS begins FROM marked),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(c, '' ORDER BY p) FILTER (NOT gone) AS t FROM edged GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(t, ''))) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
