"""Substring dedup with a log-structured fingerprint index.

The index keeps the fingerprints of historical 35-word windows in immutable runs: tables sorted and bucketed by fingerprint, one for each batch of documents. A new
batch is written as a run of its own and merge-joined with the earlier ones, bucket by bucket, without a shuffle of what is indexed; runs are compacted by merging their
sorted entries. Consecutive windows that share an anchor have one entry (see spans), about sixteen words.

A fingerprint that a batch shares with history, or that it has twice, is a match, no more: all windows behind it are compared word by word.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, drop, staged, table
from .spans import CHUNK, Units, anchored, counted, mix, repeated

WINDOW, GRAM, BATCHES, MOST, BYTES = 35, 5, 3, 256, 4 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Word hashes, remembered for the frequent words; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


class Words:
    def __init__(self, text: bytes):
        self.words = text.split()
        self._h: np.ndarray | None = None

    @property
    def h(self) -> np.ndarray:
        if self._h is None:
            self._h = np.fromiter(map(_hashes.__getitem__, self.words), np.uint64, len(self.words))
        return self._h


def windows_of(p: bytes, window: int) -> list[bytes]:
    """Each ``window`` words of words joined by one space."""
    ends = [*np.flatnonzero(np.frombuffer(p, np.uint8) == 32).tolist(), len(p)]
    return [p[a:b] for a, b in zip([0, *(e + 1 for e in ends)], ends[window - 1 :], strict=False)]


def classes(runs: list[bytes], window: int) -> list[np.ndarray]:
    """For each run a number for each of its windows, the same for two windows exactly if their words are."""
    numbers: dict[bytes, int] = {}
    return [np.fromiter((numbers.setdefault(w, len(numbers)) for w in windows_of(p, window)), np.int64) for p in runs]


def word_units(window: int, gram: int) -> Units:
    def anchors(x: Words):
        parts = []
        for a in range(0, len(x.words) - window + 1, CHUNK):
            h = x.h[a : a + CHUNK + window - 1]
            m = len(h) - gram + 1
            g = np.zeros(m, np.uint64)
            for k in range(gram):
                g = g * _STEP + h[k : k + m]
            g = mix(g)
            at, lo, n = anchored(g, window - gram + 1)
            raw = memoryview(np.ascontiguousarray(h)).cast("B")
            sw = np.fromiter((xxhash.xxh3_64_intdigest(raw[8 * s : 8 * e]) for s, e in zip(lo.tolist(), (lo + n + window - 1).tolist(), strict=True)), np.uint64, len(lo))
            parts.append((g[at], sw, lo + a, n))
        if not parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True))

    def payload(x: Words, lo: int, n: int) -> bytes:
        return b" ".join(x.words[lo : lo + n + window - 1])

    def kept(x: Words, s: np.ndarray, e: np.ndarray) -> bytes:
        if not len(s):
            return b" ".join(x.words)
        cuts = zip([0, *e.tolist()], [*s.tolist(), len(x.words)], strict=True)
        return b" ".join(w for a, b in cuts for w in x.words[a:b])

    return Units(window, Words, lambda x: len(x.words), anchors, payload, kept, lambda runs: classes(runs, window), lambda p: windows_of(p, window))


class FingerprintIndex:
    """Sorted immutable runs of fingerprints. ``add`` takes a batch of anchor rows, writes its run, and returns the batch's matches; ``compact`` merges all runs into one.
    Entries are (h, c): a fingerprint and how often it occurs. Runs are bucketed by h into as many buckets as there are shuffle
    partitions, so that matching and merging read them side by side."""

    def __init__(self, spark: SparkSession, most_runs: int = 4):
        self.spark, self.most, self.runs = spark, most_runs, []

    def add(self, rows: DataFrame) -> DataFrame:
        """The fingerprints of ``rows`` that occur more than once, history counted; staged."""
        run = bucketed(counted(rows), "run", "h", sort=True)
        found = staged(self.match(run), "matches")
        self.runs.append(run)
        if len(self.runs) > self.most:
            self.compact()
        return found

    def match(self, run: DataFrame) -> DataFrame:
        """Merge-joins a run with the earlier ones: its fingerprints (h) that occur more than once in all."""
        total = F.col("c")
        for k, old in enumerate(self.runs):
            run = run.join(old.select("h", F.col("c").alias(f"c{k}")), "h", "left")
            total = total + F.coalesce(f"c{k}", F.lit(0))
        return run.filter(total > 1).select("h")

    def compact(self) -> DataFrame:
        """One run for all; the old ones are dropped after it is written."""
        old = self.runs
        if len(old) > 1:
            all_ = old[0].select("h", "c")
            for one in old[1:]:
                sums = (F.coalesce("c", F.lit(0)) + F.coalesce("c_", F.lit(0))).alias("c")
                all_ = all_.join(one.select("h", F.col("c").alias("c_")), "h", "full_outer").select("h", sums)
            self.runs = [bucketed(all_, "run", "h", sort=True)]
            drop(*old)
        return self.runs[0]

    def close(self) -> None:
        drop(*self.runs)
        self.runs = []


def matched(rows: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The anchors that occur more than once, by an index that takes the texts in batches, one after the other: what occurs twice is met when it comes for the second time."""
    index = FingerprintIndex(rows.sparkSession, most_runs=2)
    found = [index.add(rows.filter(F.pmod(F.xxhash64("t1", "t2"), F.lit(batches)) == k)) for k in range(batches)]
    index.close()
    every = found[0]
    for one in found[1:]:
        every = every.unionByName(one)
    return every.distinct()


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, most: int = MOST, size: int = BYTES, digest: bool = False) -> DataFrame:
    """One row for each input row: id, n_units (words), n_removed, n_spans, spans (word places) and kept (the remaining words joined by one space, or their
    digest). A word goes if a window of ``window`` words over it also starts anywhere else, in the same document or another one; windows are judged on
    the input. Words are taken unchanged. The number of ``batches`` that the index takes the documents in doesn't change the result.

    Null and empty texts have no words; texts shorter than a window keep all. Repeated rows are copies of each other, so their windows go. Null ids are
    ids like others. An empty table gives an empty result. Other columns aren't read."""
    return repeated(df, id_col, text_col, word_units(window, gram), lambda rows: matched(rows, batches), digest, most, size)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(table(spark, sf_dir, "documents"), digest=True)
    return rows.select(F.col("id").alias("doc_id"), F.col("n_units").alias("n_words"), "n_removed", F.col("kept").alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
pos AS (
  SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p,
         unnest(list_transform(generate_series(1, len(w)), lambda k: CASE WHEN k + 34 <= len(w) THEN array_to_string(w[k:k + 34], ' ') END)) AS s
  FROM d WHERE len(w) > 0),
often AS (SELECT s FROM pos WHERE s IS NOT NULL GROUP BY s HAVING count(*) > 1),
marked AS (
  SELECT doc_id, word, p, coalesce(max(CASE WHEN often.s IS NOT NULL THEN p END) OVER (PARTITION BY doc_id ORDER BY p) > p - 35, false) AS gone
  FROM pos LEFT JOIN often ON pos.s = often.s),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS t FROM marked GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
