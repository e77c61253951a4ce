"""Exact dedup by deterministic block naming.

Normalised texts are cut into fixed-size blocks. All blocks are sorted, by a hash and then their whole content, and each distinct one gets the
integer of its place in that order. Then adjacent pairs of names are sorted and named in the same way, level by level, until a document
has one name. Names come from comparisons of whole contents: two texts get one identity exactly if they are equal. (Only where two sorted ranges
meet, the contents at their edges are compared by SHA-256, so that no content reaches the driver.) Rows are told apart by a number of their own, not by their ids.

Scale: one shuffle moves the contents (the sort of level 0); later levels move pairs of integers, a 4096th of the bytes. The sort key
ends in a salt, so a block that a third of all documents share is spread over many tasks; what the edges of the sorted ranges
share is settled from two digests for each range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, keyed, map_arrow, only, partitions, staged, table, texts

BLOCK = 4096


def named(df: DataFrame, keys: list[str], carry: str, ranged: list[str] | None = None) -> DataFrame:
    """``df``'s carried columns (a DDL string) and ``name`` (long): the dense rank of its key columns in their sort order; staged. ``df`` is read twice.

    ``ranged``: the first key columns, by which the ranges are cut; with short ones the driver's sample of keys is small. If ranges are cut between two keys that agree in
    them, which the edges show, the work is done again with ranges by whole keys."""
    ranged = ranged or keys
    spark = df.sparkSession
    cols = [c.split()[0] for c in carry.split(", ")]
    fields = ["part", "local", *cols, "whole", "lead"]

    def digest(key: tuple) -> bytes:
        return hashlib.sha256(repr(key).encode()).digest()

    def name_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key. The first and the last row of a range carry digests of their keys as well."""
        part, rank, last, rows = TaskContext.get().partitionId(), -1, None, None

        def marked(rows: dict, at: int, key: tuple) -> dict:
            n = len(rows["local"])
            for f, v in (("whole", digest(key)), ("lead", digest(key[: len(ranged)]))):
                values = rows[f].to_pylist() if rows[f].null_count < n else [None] * n
                values[at] = v
                rows[f] = pa.array(values, pa.binary())
            return rows

        out = lambda rows: pa.RecordBatch.from_arrays([rows[f] for f in fields], names=fields)
        for b in batches:
            if not b.num_rows:
                continue
            new = None
            for k in keys:
                c = b.column(k)
                ne = pc.not_equal(c.slice(1), c.slice(0, len(c) - 1))
                new = ne if new is None else pc.or_(new, ne)
            first = tuple(b.column(k)[0].as_py() for k in keys)
            step = pa.concat_arrays([pa.array([first != last]), new]).cast(pa.int64())
            local = pc.add(pc.cumulative_sum(step), rank)
            now = {"part": pa.array([part] * b.num_rows, pa.int32()), "local": local} | {c: b.column(c) for c in cols} | {f: pa.nulls(b.num_rows, pa.binary()) for f in ("whole", "lead")}
            if rank < 0:
                now = marked(now, 0, first)
            if rows is not None:
                yield out(rows)
            rank, last, rows = local[-1].as_py(), tuple(b.column(k)[-1].as_py() for k in keys), now
        if rows is not None:
            yield out(marked(rows, -1, last))

    spread = df.withColumn("salt", F.xxhash64(*cols)).repartitionByRange(partitions(spark), *ranged, "salt").sortWithinPartitions(*keys)
    done = staged(map_arrow(spread.select(*keys, *cols), name_sorted, f"part int, local long, {carry}, whole binary, lead binary"), "names")
    edges = done.filter(F.col("whole").isNotNull()).select("part", "local", "whole", "lead").collect()  # two rows a range at most, of two digests each
    ends: dict[int, list] = {}
    for r in sorted(edges, key=lambda r: (r["part"], r["local"])):
        ends.setdefault(r["part"], []).append(r)
    base, before, offsets = 0, None, []
    for part, rows in sorted(ends.items()):
        if before is not None and rows[0]["whole"] == before["whole"]:
            base -= 1
        elif before is not None and ranged != keys and rows[0]["lead"] == before["lead"]:
            drop(done)
            return named(df, keys, carry)
        offsets.append((part, base))
        base, before = base + rows[-1]["local"] + 1, rows[-1]
    offset = F.broadcast(spark.createDataFrame(offsets, "part int, base long"))  # a row for each range
    out = done.join(offset, "part").select(*cols, (F.col("local") + F.col("base")).alias("name"))
    out._pelagia_path = done._pelagia_path
    return out


def normalised(text: bytes) -> bytes:
    """Each run of ASCII white space as one space."""
    words = text.split()
    if not words:
        return text and b" "
    return b" " * text[:1].isspace() + b" ".join(words) + b" " * text[-1:].isspace()


def identities(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Columns row (a number for each input row), id, th (a hash of the text), sha (of the normalised text), level and name, one row for each input row. Level and name
    are the collision-free identity: rows have the same pair exactly if their normalised texts are equal."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each block; the digest is on the first one, so once for each input row."""
        names, size = ["row", "id", "th", "sha", "n", "idx", "block"], 0
        out: list[list] = [[] for _ in names]
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=names)
        for b in batches:
            for row, i, th, t in zip(*(b.column(k).to_pylist() for k in ("row", "id", "th")), texts(b), strict=True):
                t = normalised(t)
                n = max(1, -(-len(t) // block))
                for c, v in zip(out, ([row] * n, [i] * n, [th] * n, [hashlib.sha256(t).digest(), *[None] * (n - 1)], [n] * n, range(n), (t[k * block : (k + 1) * block] for k in range(n))), strict=True):
                    c.extend(v)
                if (size := size + len(t)) > 1 << 21:
                    yield flush()
                    out, size = [[] for _ in names], 0
        yield flush()

    numbered = keyed(df, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    cuts = staged(map_arrow(numbered, cut, "row bigint, id bigint, th bigint, sha binary, n int, idx int, block binary").withColumn("h", F.xxhash64("block")), "blocks")
    level0 = named(cuts, ["h", "block"], "row bigint, id bigint, th bigint, sha binary, n int, idx int", ["h"])
    drop(cuts)
    whole, now, level = None, level0.filter("n > 1").select("row", "idx", "name"), 0
    while True:
        arrays = now.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("idx", "name"))).alias("at"))  # a document's own names: as many as its length allows
        left = staged(arrays.select("row", F.col("at.name").alias("names")), "level")
        if level:
            drop(now)
            done = left.filter(F.size("names") == 1).select("row", F.lit(level).alias("level"), F.col("names")[0].alias("name"))
            whole = done if whole is None else whole.unionByName(done)
        more = left.filter(F.size("names") > 1)
        if more.isEmpty():
            break
        level += 1
        pairs = more.select("row", F.posexplode(F.expr("transform(sequence(0, cast((size(names) - 1) div 2 as int)), i -> struct(names[2 * i] as a, coalesce(try_element_at(names, 2 * i + 2), -1L) as b))")).alias("idx", "p"))
        now = named(pairs.select("row", "idx", "p.a", "p.b"), ["a", "b"], "row bigint, idx int")
    first = level0.filter("idx = 0")
    found = first.filter("n = 1").select("row", "id", "th", "sha", F.lit(0).alias("level"), "name")
    if whole is not None:
        found = found.unionByName(first.filter("n > 1").select("row", "id", "th", "sha").join(whole, "row"))
    return found


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row for each input row: id, th, keep_id (the smallest id of equal texts), group_size (its rows), kept, text_sha256.

    Null texts count as empty, and empty texts are equal to each other. Null ids come last: they are kept only if no row of the group has an id. Rows
    that repeat an id with the same text count in group_size, and are reported alike. An empty table gives an empty result.
    Other columns aren't read."""
    rows = staged(identities(df, id_col, text_col, block), "ids")
    # groups of several rows, staged: then both sides of the join are plain exchanges, and a hot group can be split
    best = staged(rows.groupBy("level", "name").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1"), "groups")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    joined = rows.join(best, ["level", "name"], "left").withColumn("keep_id", keep)
    return joined.select("id", "th", "keep_id", F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay: of equal texts the one with the smallest id, once if it is repeated. All columns are kept."""
    return only(df, exact_groups(df, id_col, text_col).filter("kept").groupBy("id", "text_sha256").agg(F.min("th").alias("th")), id_col, text_col)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents),
g AS (SELECT n, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY n)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.n) AS text_sha256 FROM d JOIN g ON d.n = g.n
"""
