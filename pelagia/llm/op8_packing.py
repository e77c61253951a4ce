"""Optimal length buckets for packing.

Documents longer than the longest sequence are cut into pieces, so lengths are bounded. Dynamic programming over the global histogram of piece lengths chooses
the bucket boundaries that leave the least padding; batches of a token budget form inside each bucket.

Scale: the histogram has a row for each length up to ``max_tokens``. Pieces are numbered in the order of their documents' ids: inside ranges of ids, whose first numbers
are a running sum over their counts, so no bucket meets in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, keyed, partitions, staged, table

MAX_TOKENS, BUCKETS, BUDGET = 2048, 8, 65536


def boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """The upper ends of at most ``buckets`` buckets of lengths with the least total padding, ascending; the last is the largest length. Of equal costs, the one
    with the smaller boundaries. Costs obey the quadrangle inequality, so each row is solved by halving."""
    lengths = sorted(k for k, n in histogram.items() if n)
    if not lengths:
        return []
    x = np.array(lengths, np.float64)
    before = np.concatenate(([0.0], np.cumsum([histogram[k] for k in lengths], dtype=np.float64)))
    m, k = len(lengths), min(buckets, len(lengths))
    cost, back = x * before[1:], []  # padded tokens; what is not padding is the same for all choices
    for row in range(1, k):
        new, arg = np.full(m, np.inf), np.zeros(m, np.int64)
        todo = [(row, m - 1, row, m - 1)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(first, min(mid, last) + 1)  # the bucket of mid starts at i
            c = cost[i - 1] + x[mid] * (before[mid + 1] - before[i])
            best = int(c.argmin())
            new[mid], arg[mid] = c[best], i[best]
            todo += [(lo, mid - 1, first, int(i[best])), (mid + 1, hi, int(i[best]), last)]
        cost = new
        back.append(arg)
    ends, at = [m - 1], m - 1
    for arg in reversed(back):
        at = int(arg[at]) - 1
        ends.append(at)
    return [lengths[e] for e in reversed(ends)]


def pieces(df: DataFrame, id_col: str, text_col: str, max_tokens: int) -> DataFrame:
    """id, th, piece and n_tokens: a text's words and one end, cut after each ``max_tokens``."""
    blank = F.regexp_count("text", F.lit(WORD))
    sized = keyed(df, id_col, text_col).select("id", "th", (blank + 1).cast("long").alias("n"))
    cut = F.posexplode(F.expr(f"transform(sequence(0, cast((n - 1) div {max_tokens} as int)), i -> least({max_tokens}, n - i * {max_tokens}))")).alias("piece", "n_tokens")
    return sized.select("id", "th", cut)


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """One row for each piece: id, piece, n_tokens, bucket (its boundary, the length that it is padded to), padding, batch (numbered inside the bucket from 0) and
    slot (its place in the batch). A batch holds ``budget // bucket`` pieces, one at least; only the last of a bucket can hold fewer.

    Null and empty texts are one token, the end. A bucket's pieces come by id (null ids first), a hash of the text and piece; repeated rows get places of their own.
    An empty table gives an empty result. Other columns aren't read."""
    found = staged(pieces(df, id_col, text_col, max_tokens), "pieces")
    histogram = {r["n_tokens"]: r["c"] for r in found.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("c")).collect()}  # max_tokens rows at most
    ends = boundaries(histogram, buckets)
    if not ends:
        return found.select(F.col("id").alias(id_col), "piece", "n_tokens", F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("padding"), F.lit(0).cast("long").alias("batch"), F.lit(0).cast("int").alias("slot"))
    bucket = F.array_min(F.filter(F.array(*(F.lit(e).cast("long") for e in ends)), lambda e: e >= F.col("n_tokens")))
    # ranges of about equal size; the last column parts repeated rows, and rows of one id
    dealt = found.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(partitions(df.sparkSession), "id", "th", "piece", "row")
    rows = staged(dealt.withColumn("bucket", bucket).withColumn("deal", F.spark_partition_id()), "ranges")
    counts = rows.groupBy("bucket", "deal").agg(F.count(F.lit(1)).alias("c"))
    # a row for each range
    first = counts.withColumn("first", F.sum("c").over(Window.partitionBy("bucket").orderBy("deal")) - F.col("c")).drop("c")
    number = F.row_number().over(Window.partitionBy("bucket", "deal").orderBy("id", "th", "piece", "row")) - 1
    rows = rows.withColumn("number", number).join(first, ["bucket", "deal"]).withColumn("number", F.col("number") + F.col("first"))
    per = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col("bucket")))
    return rows.select(F.col("id").alias(id_col), "piece", "n_tokens", "bucket", (F.col("bucket") - F.col("n_tokens")).alias("padding"), F.floor(F.col("number") / per).alias("batch"), (F.col("number") % per).cast("int").alias("slot"))


def op8_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def oracle(max_tokens: int = MAX_TOKENS, buckets: int = BUCKETS, budget: int = BUDGET) -> str:
    """SQL for tables with at least as many lengths as buckets: each level of the dynamic programming is a common table."""
    levels = "".join(
        f"""l{k} AS MATERIALIZED (SELECT h.j, min(p.cost + h.x * (h.upto - p.upto)) AS cost, min(h.upto) AS upto, arg_min(p.j, (p.cost + h.x * (h.upto - p.upto)) * 4096 + p.j) AS prev
    FROM l{k - 1} p JOIN hist h ON p.j < h.j GROUP BY h.j),
"""
        for k in range(1, buckets)
    )
    ends = [f"e{buckets - 1} AS (SELECT max(j) AS j FROM hist)"]
    ends += [f"e{k} AS (SELECT prev AS j FROM l{k + 1} JOIN e{k + 1} USING (j))" for k in range(buckets - 2, -1, -1)]
    chosen = " UNION ALL ".join(f"SELECT x FROM hist JOIN e{k} USING (j)" for k in range(buckets))
    return rf"""
WITH sized AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 AS n FROM documents),
pieces AS (SELECT doc_id, CAST(i AS INTEGER) AS piece, CAST(least({max_tokens}, n - i * {max_tokens}) AS BIGINT) AS n_tokens FROM (SELECT doc_id, n, unnest(generate_series(0, (n - 1) // {max_tokens})) AS i FROM sized)),
hist AS MATERIALIZED (SELECT x, CAST(row_number() OVER (ORDER BY x) - 1 AS BIGINT) AS j, CAST(sum(c) OVER (ORDER BY x) AS BIGINT) AS upto FROM (SELECT n_tokens AS x, count(*) AS c FROM pieces GROUP BY n_tokens)),
l0 AS MATERIALIZED (SELECT j, x * upto AS cost, upto, CAST(NULL AS BIGINT) AS prev FROM hist),
{levels}{", ".join(ends)},
ends AS ({chosen}),
placed AS (SELECT doc_id, piece, n_tokens, (SELECT min(x) FROM ends WHERE x >= n_tokens) AS bucket FROM pieces),
numbered AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id NULLS FIRST, piece) - 1 AS number, greatest(1, {budget} // bucket) AS per FROM placed)
SELECT doc_id, piece, n_tokens, bucket, bucket - n_tokens AS padding, CAST(number // per AS BIGINT) AS batch, CAST(number % per AS INTEGER) AS slot FROM numbered
"""


ORACLE = oracle()
