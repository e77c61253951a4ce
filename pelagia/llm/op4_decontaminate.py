"""Benchmark decontamination by SimHash windows.

For each benchmark item, windows of the item's length in words slide over a document. A window's 64-bit SimHash is looked up in a multi-index: the bits are cut into
one block more than the radius, so fingerprints within the radius agree in a block at least, and none is missed. Candidates are verified by the
exact weighted similarity of their five-word shingles, each weighted by how often it occurs: sum of minima over sum of maxima.

Before that, two conditions that every match meets by arithmetic spare windows: it shares a shingle with the item, and of its shingles at least
2t / (1 + t) of the mean number are shingles of the benchmark (t: the similarity asked for).

Scale: one scan of the documents for each block of benchmark items, without a shuffle; a block has a bounded number of words, so what each task gets is bounded,
and a larger benchmark is more blocks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, keyed, map_arrow, staged, table, texts
from .spans import mix

SHINGLE, SIMILARITY, RADIUS, BLOCK_WORDS, SPAN = 5, 0.8, 20, 200_000, 8192
_STEP = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    g = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        g = g * _STEP + h[j : j + len(g)]
    return mix(g)


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def simhashes(grams: np.ndarray, size: int) -> np.ndarray:
    """SimHash of each ``size`` consecutive shingles, repeats included: a bit is set if more than half have it."""
    bits = np.unpackbits(grams.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)))
    return np.packbits((sums[size:] - sums[:-size]) * 2 > size, axis=1).view(">u8").ravel().astype(np.uint64)


def similarity(a: list[bytes], b: list[bytes], shingle: int) -> float:
    """Weighted Jaccard similarity of the shingles of two word sequences."""
    x, y = (Counter(tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)) for w in (a, b))
    low = sum(min(n, y[k]) for k, n in x.items() if k in y)
    return low / max(1, sum(x.values()) + sum(y.values()) - low)


class Benchmark:
    """A block of items, ready for lookups. Items of fewer words than a shingle are matched as a whole."""

    def __init__(self, items: list[tuple[int | None, str]], shingle: int = SHINGLE, radius: int = RADIUS, least: float = SIMILARITY):
        self.radius, self.least = radius, least
        self.ids = [i for i, _ in items]
        self.words = [t.encode().lower().split() for _, t in items]
        known = sorted({w for x in self.words for w in x})
        self.number = {w: i for i, w in enumerate(known)}
        self.known = hashes(known)
        grams: dict[int, list[tuple[np.ndarray, int]]] = {}
        prints = np.zeros(len(items), np.uint64)
        for i, w in enumerate(self.words):
            k = min(shingle, len(w))
            g = gram_hashes(hashes(w), k)
            grams.setdefault(k, []).append((g, i))
            prints[i] = simhashes(g, len(g))[0]
        # by shingle size: sorted shingle hashes and the items that have them
        self.grams = {}
        for k, found in grams.items():
            h, owner = np.concatenate([g for g, _ in found]), np.concatenate([np.full(len(g), i) for g, i in found])
            order = np.argsort(h, kind="stable")
            self.grams[k] = h[order], owner[order]
        self.prints = prints
        edges = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            mask = np.uint64((1 << int(b - a)) - 1)
            values = (prints >> np.uint64(a)) & mask
            order = np.argsort(values, kind="stable")
            self.blocks.append((np.uint64(a), mask, values[order], order))

    def near(self, fp: np.uint64) -> np.ndarray:
        """Items whose fingerprint is within the radius: the union of the blocks' entries, then the distance."""
        found = []
        for shift, mask, values, order in self.blocks:
            v = (fp >> shift) & mask
            found.append(order[np.searchsorted(values, v) : np.searchsorted(values, v, "right")])
        items = np.unique(np.concatenate(found))
        return items[np.bitwise_count(self.prints[items] ^ fp) <= self.radius]

    def matches(self, text: bytes) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, number of words) of the most similar window of each item that is similar enough; of equal ones, the first."""
        words = text.lower().split()
        n = len(words)
        numbers = np.fromiter(map(self.number.get, words, iter(lambda: -1, 0)), np.int64, n)
        best: dict[int, tuple[float, int, int]] = {}
        for k, (grams, owner) in self.grams.items():
            ok = np.concatenate(([0], np.cumsum(numbers >= 0)))
            starts = np.flatnonzero(ok[k:] - ok[:-k] == k) if n >= k else np.zeros(0, np.int64)
            if not len(starts):
                continue
            h = np.zeros(len(starts), np.uint64)
            for j in range(k):
                h = h * _STEP + self.known[numbers[starts + j]]
            h = mix(h)
            first = np.searchsorted(grams, h)
            hit = grams[np.minimum(first, len(grams) - 1)] == h
            starts, first, last = starts[hit], first[hit], np.searchsorted(grams, h[hit], "right")
            if not len(starts):
                continue
            marks = np.zeros(n - k + 2, np.int64)
            marks[starts + 1] = 1
            marks = np.cumsum(marks)  # shingles of the benchmark before a place
            wanted: dict[int, dict[int, list[int]]] = {}  # by item length: the items and the places of shared shingles
            for s, a, b in zip(starts.tolist(), first.tolist(), last.tolist(), strict=True):
                for i in owner[a:b].tolist():
                    at = wanted.setdefault(len(self.words[i]), {}).setdefault(i, [])
                    if not at or at[-1] != s:
                        at.append(s)
            for length, items in wanted.items():
                size = min(length, n)  # a shorter document is one window
                need = np.ceil(self.least / (1 + self.least) * (size - k + 1 + length - k + 1) - 1e-9)
                shared = np.unique(np.concatenate([np.asarray(x) for x in items.values()]))
                lows, highs = np.maximum(0, shared - (size - k)), np.minimum(n - size, shared)
                cover = np.zeros(n - size + 2, np.int64)
                np.add.at(cover, lows, 1)
                np.add.at(cover, highs + 1, -1)
                windows = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
                windows = windows[marks[windows + size - k + 1] - marks[windows] >= need]
                for part in np.split(windows, np.flatnonzero(np.diff(windows) > size) + 1) if len(windows) else ():
                    for at in range(0, len(part), SPAN):
                        span = part[at : at + SPAN]
                        low, high = int(span[0]), int(span[-1]) + size
                        prints = simhashes(gram_hashes(hashes(words[low:high]), k), size - k + 1)[span - low]
                        for s, fp in zip(span.tolist(), prints, strict=True):
                            for i in self.near(fp).tolist():
                                if i in items:
                                    q = similarity(words[s : s + size], self.words[i], k)
                                    if q >= self.least and (i not in best or q > best[i][0]):
                                        best[i] = (q, s, size)
        return [(i, *best[i]) for i in sorted(best)]


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: float = SIMILARITY, radius: int = RADIUS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each document and item that it contains: id, th, item_id, similarity, first_word, n_words (of the most similar window).

    Words are lower-cased (A-Z). Null and empty texts match nothing, on either side. Items of equal text are all reported. Repeated rows are reported each;
    null ids as well. Empty tables give an empty result. Other columns aren't read."""
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("i"), F.col(f"`{item_text_col}`").cast("string").alias("t")).filter(F.col("t").rlike(WORD))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-total // (block_words * 6)))
    docs, found = keyed(df, id_col, text_col), None
    schema = "id bigint, th bigint, item_id bigint, similarity double, first_word bigint, n_words bigint"
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
    for part in range(parts):
        own = [(r["i"], r["t"]) for r in items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part).collect()]  # about block_words words
        own.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))

        def run(batches: Iterator[pa.RecordBatch], own=own) -> Iterator[pa.RecordBatch]:
            known = Benchmark(own, SHINGLE, radius, least) if own else None
            for b in batches:
                rows = [(i, th, known.ids[m[0]], *m[1:]) for i, th, t in zip(b.column("id").to_pylist(), b.column("th").to_pylist(), texts(b), strict=True) if known for m in known.matches(t)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], names=names)

        one = map_arrow(docs, run, schema)
        found = one if found is None else found.unionByName(one)
    return found


def keep_clean(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that contain no benchmark item, with all their columns and as often as they occur."""
    bad = staged(contaminated(df, benchmark, id_col, text_col).select("id", "th").distinct(), "contaminated")
    th = F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    rows = df.select(F.struct("*").alias("_row"), F.col(f"`{id_col}`").cast("long").alias("_id"), th.alias("_th"))
    return rows.join(bad, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_th") == F.col("th")), "left_anti").select("_row.*")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "similarity", "first_word", "n_words")
