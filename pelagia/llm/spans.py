"""Repeated windows by anchors: what the two substring operators share.

A window is a fixed number of units (bytes or words). Its anchor is the gram (a shorter run of units) with the smallest hash in it, so equal windows have
equal anchors at equal places, and consecutive windows mostly share one. The run of windows that share an anchor is one row: the anchor's
hash ``h``, a hash ``sw`` of all units the run covers, and where it starts. Two windows can only be equal if their rows agree in ``h``, so rows whose ``h``
occurs once are done with. Hashes only group: of all other rows, two places of each (h, sw), or its only one, go to the operator's own
method (``Units.classes``), which compares units and says which windows of a group are equal. A window is repeated if its class occurs more than once; what is
found holds for all places of the (h, sw).

Equal texts (by SHA-256) are one row with a number from the start, so copies cost nothing more. Texts move once, into a table bucketed by
their key; what is asked of them later, and what is found, joins it there without another exchange of texts.

A batch for ``classes`` holds whole groups and is bounded. A group of more than ``most`` different runs is cut into several batches, each of them solved in the same way;
windows that are alone in their batch are then counted over the batches of their group by a 128-bit digest. Digests of a batch travel as one row for
each shard of them, so no group has to fit a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, drop, map_arrow, partitions, staged, texts

CHUNK = 1 << 20
#: Batches of a group for which one shard of its digests is made.
SHARD = 8
_LOW = np.uint64(CHUNK * 2 - 1)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def anchored(grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For windows of ``width`` gram hashes: the anchor, first window and number of windows of each run. At most CHUNK + width - 1 hashes."""
    n = len(grams) - width + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    packed = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)  # ties go to the first place
    pad = -len(packed) % width
    blocks = np.concatenate((packed, np.full(pad, ~np.uint64(0)))).reshape(-1, width)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(tail[:n], head[width - 1 : width - 1 + n]) & _LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return at[first], first, np.diff(np.append(first, n))


def periodic(h: np.ndarray, sw: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Neighbouring runs that agree in h, sw and length are one row, with their number: in a text that repeats itself every few units, all of it is."""
    if not len(h):
        return h, sw, lo, n, n
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (sw[1:] != sw[:-1]) | (n[1:] != n[:-1])))
    at = np.flatnonzero(new)
    return h[at], sw[at], lo[at], n[at], np.diff(np.append(at, len(h)))


def merged(lo: np.ndarray, count: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of units that windows ``lo .. lo + count - 1`` cover."""
    if not len(lo):
        return lo, lo
    order = np.argsort(lo, kind="stable")
    s, e = lo[order], np.maximum.accumulate((lo + count - 1 + window)[order])
    new = np.concatenate(([True], s[1:] > e[:-1]))
    return s[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(e) - 1)]


def consecutive(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and length of each run of consecutive places."""
    if not len(at):
        return at, at
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1] + 1)))
    return at[first], np.diff(np.append(first, len(at)))


@dataclass
class Units:
    """How an operator sees a text. split: its units; size: their number; anchors: of split units, the arrays h, sw, lo, count; payload: what
    ``classes`` needs of the run of windows at lo; kept: the text without the units in the spans; classes: of payloads, a number for each window of each of them, equal
    for two windows exactly if their units are; cut: the bytes of each window of a payload."""

    window: int
    split: Callable[[bytes], object]
    size: Callable[[object], int]
    anchors: Callable[[object], tuple[np.ndarray, ...]]
    payload: Callable[[object, int, int], bytes]
    kept: Callable[[object, np.ndarray, np.ndarray], bytes]
    classes: Callable[[list[bytes]], list[np.ndarray]]
    cut: Callable[[bytes], list[bytes]]


def keys_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, t1, t2 (128 bits of the text's SHA-256) and text; null texts count as empty. Other columns are left out, so names can't clash."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text")).withColumn("sha", F.sha2("text", 256))
    return rows.select("id", *(F.conv(F.substring("sha", a, 16), 16, -10).cast("long").alias(k) for k, a in (("t1", 1), ("t2", 17))), "text")


def distinct_texts(keyed: DataFrame) -> DataFrame:
    """t1, t2, text and k (its copies), bucketed by key. Copies are collapsed before the exchange."""
    return bucketed(keyed.groupBy("t1", "t2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("k")), "texts", "t1", "t2")


def anchor_rows(docs: DataFrame, u: Units) -> DataFrame:
    """h, sw, t1, t2, lo, n (windows of a run), m (runs in a row) and w (its occurrences, with those in copies of the text) of distinct texts."""
    names = ["h", "sw", "t1", "t2", "lo", "n", "m", "w"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [periodic(*u.anchors(u.split(t))) for t in texts(b)]
            sizes = [len(f[0]) for f in found]
            rows = pa.array(np.repeat(np.arange(b.num_rows), sizes))
            h, sw, lo, n, m = (np.concatenate([f[i] for f in found]) for i in range(5))
            w = m * np.repeat(b.column("k").to_numpy(), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(sw.view(np.int64)), b.column("t1").take(rows), b.column("t2").take(rows), *(pa.array(x.astype(np.int32)) for x in (lo, n, m)), pa.array(w.astype(np.int64))], names=names)

    return map_arrow(docs.select("t1", "t2", "text", "k"), run, "h bigint, sw bigint, t1 bigint, t2 bigint, lo int, n int, m int, w bigint")


def counted(rows: DataFrame) -> DataFrame:
    """For each anchor how often it occurs."""
    return rows.groupBy("h").agg(F.sum("w").alias("c"))


def often(rows: DataFrame) -> DataFrame:
    return counted(rows).filter("c > 1").select("h")


def solved(asked: DataFrame, u: Units, size: int) -> DataFrame:
    """Of runs h, sw, c (copies of the text), salt, parts (batches that the group is cut into) and payload, the repeated windows as h, sw, a and b (arrays of first window and number)."""
    schema = "h bigint, sw bigint, a array<int>, b array<int>, shard int, w binary, c binary, of binary, runs binary"
    names = ["h", "sw", "a", "b", "shard", "w", "c", "of", "runs"]
    types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), *[pa.binary()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; whole groups are gathered until they are enough for one call."""
        held, held_size, last = [], 0, None

        def solve() -> pa.RecordBatch:
            found = u.classes([x[4] for x in held])
            flat, sizes = np.concatenate(found), np.array([len(x) for x in found])
            owner = np.repeat(np.arange(len(held)), sizes)
            total = np.bincount(flat, np.array([x[2] for x in held], np.float64)[owner])
            twice, ends, out = total[flat] > 1, np.cumsum(sizes), []
            told = np.zeros(len(total), bool)
            tell: dict[tuple[int, int], list[tuple]] = {}  # what other batches of a group have to know
            for (h, sw, c, parts, p), e, n in zip(held, ends.tolist(), sizes.tolist(), strict=True):
                own = twice[e - n : e]
                if own.any():
                    a, b = consecutive(np.flatnonzero(own))
                    out.append((h, sw, a, b, *[None] * 5))
                if parts > 1:  # each class once, and where those are that are alone here
                    of = flat[e - n : e]
                    new = np.flatnonzero(~told[of])
                    new = new[np.sort(np.unique(of[new], return_index=True)[1])] if len(new) else new
                    told[of] = True
                    w = u.cut(p) if len(new) else []
                    tell.setdefault((h, parts), []).extend((xxhash.xxh3_128_digest(w[k]), 2 if own[k] else c, -1 if own[k] else k, sw) for k in new.tolist())
            for (h, parts), rows in tell.items():  # a row for each shard of the digests, and not for each of them
                w = np.frombuffer(b"".join([r[0] for r in rows]), "<u8").reshape(-1, 2)
                c, of, sw = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3))
                shard = (w[:, 0] % np.uint64(-(-parts // SHARD))).astype(np.int64)
                for s in np.unique(shard).tolist():
                    i = shard == s
                    out.append((h, None, None, None, s, *(np.ascontiguousarray(x[i]).tobytes() for x in (w, c, of, sw))))
            cols = zip(*out, strict=True) if out else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=names)

        for b in batches:
            for h, sw, c, salt, parts, p in zip(*(b.column(k).to_pylist() for k in ("h", "sw", "c", "salt", "parts", "payload")), strict=True):
                if (h, salt) != last and held_size > size:
                    yield solve()
                    held, held_size = [], 0
                held.append((h, sw, c, parts, p))
                held_size, last = held_size + len(p), (h, salt)
        if held:
            yield solve()

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group and shard: windows that are alone in their batch, but not in the group, as runs of consecutive ones."""
        held, last = [], None

        def solve() -> pa.RecordBatch:
            w, c, of, sw = (np.frombuffer(b"".join([x[k] for x in held]), kind) for k, kind in enumerate(("V16", "<i8", "<i8", "<i8")))
            inverse = np.unique(w, return_inverse=True)[1].ravel()
            again = np.flatnonzero((of >= 0) & (np.bincount(inverse, c)[inverse] > 1))
            again = again[np.lexsort((of[again], sw[again]))]
            runs, at = np.unique(sw[again], return_index=True)
            spans = [consecutive(x) for x in np.split(of[again], at[1:])][: len(runs)]
            columns = [pa.array([last[0]] * len(runs), pa.int64()), pa.array(runs, pa.int64()), *(pa.array([x[k] for x in spans], pa.list_(pa.int32())) for k in (0, 1))]
            return pa.RecordBatch.from_arrays(columns, names=["h", "sw", "a", "b"])

        for b in batches:
            for h, shard, *x in zip(*(b.column(k).to_pylist() for k in ("h", "shard", "w", "c", "of", "runs")), strict=True):
                if (h, shard) != last:
                    if held:
                        yield solve()
                    held, last = [], (h, shard)
                held.append(x)
        if held:
            yield solve()

    spark = asked.sparkSession
    dealt = asked.repartition(partitions(spark), "h", "salt").sortWithinPartitions("h", "salt")
    done = staged(map_arrow(dealt.select("h", "sw", "c", "salt", "parts", "payload"), run, schema), "solved")
    over = done.filter("w is not null").select("h", "shard", "w", "c", "of", "runs").repartition(partitions(spark), "h", "shard").sortWithinPartitions("h", "shard")
    return done.filter("w is null").select("h", "sw", "a", "b").unionByName(map_arrow(over, across, "h bigint, sw bigint, a array<int>, b array<int>"))


def repeated(df: DataFrame, id_col: str, text_col: str, u: Units, known: Callable[[DataFrame], DataFrame], digest: bool, most: int, size: int) -> DataFrame:
    """One row for each input row: id, n_units, n_removed, n_spans, spans (start and end of the maximal removed runs) and kept (the remaining text, or its SHA-256
    in lower-case hex if ``digest``). ``known`` gets the anchor rows and gives the anchors that occur more than once. most: different runs of a group in
    a batch; size: bytes of a batch."""
    docs = distinct_texts(keys_of(df, id_col, text_col))
    rows = staged(anchor_rows(docs, u), "anchors")
    # staged, so that it has no buckets and adaptive execution can split a hot anchor's rows
    twice = staged(known(rows), "known")
    found = staged(rows.join(twice, "h"), "repeated")
    drop(rows, twice)

    # two places of each run, if it has as many; the first two of runs in a row
    place = F.struct("t1", "t2", "lo", "n", F.expr("w div m").alias("c"), "m")
    two = found.groupBy("h", "sw").agg(F.min(place).alias("a"), F.max(place).alias("b"))
    places = F.expr("explode(if(a.m > 1, array(a, named_struct('t1', a.t1, 't2', a.t2, 'lo', a.lo + a.n, 'n', a.n, 'c', a.c, 'm', a.m)), array_distinct(array(a, b))))")
    runs = staged(two.select("h", "sw", places.alias("x")).select("h", "sw", "x.t1", "x.t2", "x.lo", "x.n", "x.c"), "runs")
    large = staged(runs.groupBy("h").agg(F.count(F.lit(1)).alias("r")).filter(F.col("r") > most).select("h", F.ceil(F.col("r") / most).cast("int").alias("parts")), "large")
    parts = F.coalesce("parts", F.lit(1))
    dealt = runs.join(large, "h", "left").withColumn("parts", parts).withColumn("salt", F.pmod(F.xxhash64("sw"), F.col("parts")).cast("int"))
    lists = dealt.groupBy("t1", "t2").agg(F.collect_list(F.struct("h", "sw", "c", "lo", "n", "salt", "parts")).alias("runs"))  # a text's own runs: as many as its length allows

    names = ["h", "sw", "c", "salt", "parts", "payload"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(names), types, strict=True)], names=names)
        for b in batches:
            for t, asked in zip(texts(b), b.column("runs"), strict=True):
                x = u.split(t)
                for r in asked.as_py():
                    p = u.payload(x, r["lo"], r["n"])
                    out.append((r["h"], r["sw"], r["c"], r["salt"], r["parts"], p))
                    held += len(p)
                if held > 1 << 21:
                    yield batch()
                    out, held = [], 0
        yield batch()

    asked = map_arrow(docs.join(lists, ["t1", "t2"]).select("text", "runs"), payloads, "h bigint, sw bigint, c bigint, salt int, parts int, payload binary")
    hits = staged(solved(asked, u, size), "hits")
    # of several runs in a row all windows are repeated
    at = F.expr("explode(arrays_zip(a, b))").alias("x")
    windows = found.join(hits, ["h", "sw"]).select("t1", "t2", "lo", "n", "m", at)
    windows = windows.select("t1", "t2", (F.col("lo") + F.col("x.a")).alias("lo"), F.expr("if(m > 1, n * m, x.b)").alias("n"))
    spans = windows.groupBy("t1", "t2").agg(F.collect_list(F.struct("lo", "n")).alias("spans"))

    out_names = ["t1", "t2", "n_units", "start", "end", "kept"]
    out_types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in out_names]
            column, held = b.column("spans"), 0
            for i, (t1, t2, t) in enumerate(zip(b.column("t1").to_pylist(), b.column("t2").to_pylist(), texts(b), strict=True)):
                x = u.split(t)
                lo, n = (column[i].values.field(k).to_numpy().astype(np.int64) for k in ("lo", "n")) if column[i].is_valid else (np.zeros(0, np.int64),) * 2
                s, e = merged(lo, n, u.window)
                kept = u.kept(x, s, e)
                kept = hashlib.sha256(kept).hexdigest().encode() if digest else kept
                for c, v in zip(out, (t1, t2, u.size(x), s.tolist(), e.tolist(), kept), strict=True):
                    c.append(v)
                if (held := held + len(kept)) > 1 << 21:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, out_types, strict=True)], names=out_names)
                    out, held = [[] for _ in out_names], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, out_types, strict=True)], names=out_names)

    of_text = docs.join(spans, ["t1", "t2"], "left").select("t1", "t2", "text", "spans")
    done = staged(map_arrow(of_text, cleaned, "t1 bigint, t2 bigint, n_units bigint, start array<bigint>, end array<bigint>, kept binary"), "cleaned")
    drop(docs, found, runs, large, hits)
    total = "aggregate(zip_with(start, end, (a, b) -> b - a), 0L, (x, y) -> x + y)"
    ids = keys_of(df, id_col, text_col).select("id", "t1", "t2")
    return ids.join(done, ["t1", "t2"]).select("id", "n_units", F.expr(total).alias("n_removed"), F.size("start").cast("long").alias("n_spans"), F.arrays_zip("start", "end").alias("spans"), F.col("kept").cast("string").alias("kept"))
