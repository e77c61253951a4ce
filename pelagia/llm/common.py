"""What the text operators share: the shared work folder, staged tables, row keys and connected components."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space (space, tab, LF, VT, FF, CR); ``bytes.split()`` gives the same.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_made: list[tuple[SparkSession, str]] = []
_local: dict[SparkSession, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local one is made if all runs in this process
    (``local[n]``, as in tests); on a cluster that is an error, since executors wouldn't see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None) or _local.get(spark)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = _local[spark] = "file://" + tempfile.mkdtemp(prefix="pelagia-")
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/pelagia/{tag}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside go as soon as it has run, and not when the driver happens to collect garbage: what is staged never needs them again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def staged(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    with shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pelagia_path = path
    return out


def bucketed(df: DataFrame, tag: str, *keys: str, sort: bool = False) -> DataFrame:
    """``df`` written to the shared folder as a table with a bucket for each shuffle partition: joins on all of ``keys`` read it without an exchange. sort: rows of a file
    are in the order of the keys."""
    spark = df.sparkSession
    path, name = new_path(spark, tag), f"pelagia_{tag}_{uuid.uuid4().hex}"
    write = df.write.bucketBy(partitions(spark), *keys)
    with shuffles_freed(spark):
        (write.sortBy(*keys) if sort else write).option("compression", "zstd").option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._pelagia_path, out._pelagia_table = path, name
    return out


def drop(*frames: DataFrame) -> None:
    """Removes staged and bucketed tables that no later plan reads."""
    for df in frames:
        if hasattr(df, "_pelagia_table"):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._pelagia_table}")
        remove(df.sparkSession, df._pelagia_path)


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    with contextlib.suppress(ValueError):
        _made.remove((spark, path))


@atexit.register
def _clean() -> None:
    for spark, path in [*_made]:
        with contextlib.suppress(Exception):
            remove(spark, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Texts can be long, so Arrow batches hold fewer rows than Spark's default; a setting made by the user is kept."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns id, th, text. A row's key is its id with the hash of its text: repeated rows share a key, and give
    the same result; rows of one id with different texts stay apart. Null texts count as empty. Other columns are left out, so
    names can't clash."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def same_key(a: DataFrame, b: DataFrame):
    return a["id"].eqNullSafe(b["id"]) & (a["th"] == b["th"])


def only(df: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``df`` whose key is in ``kept`` (id, th), each key once, with all their columns. One exchange of the rows serves the join and the choice
    among repeated rows."""
    mark = lambda c: (F.coalesce(c, F.lit(0).cast("long")), c.isNull())
    own, of = mark(F.col(f"`{id_col}`").cast("long")), mark(F.col("id"))
    th = F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    kept = kept.select(of[0].alias("_i"), of[1].alias("_n"), F.col("th").alias("_t")).distinct()
    joined = df.select(F.struct("*").alias("_row"), own[0].alias("_i"), own[1].alias("_n"), th.alias("_t")).join(kept, ["_i", "_n", "_t"])
    at = F.row_number().over(Window.partitionBy("_i", "_n", "_t").orderBy(F.lit(0)))
    return joined.withColumn("_at", at).filter("_at = 1").select("_row.*")


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(f, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """Connected components of ``edges`` (u, v longs) as (v, m): each node but the smallest of its component, with that smallest.

    Alternating large-star and small-star steps; all state is in staged tables. Hot nodes are met by partial
    aggregation, and by joins of plain exchanges, which adaptive execution can split."""
    now = staged(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = None
    for _ in range(most):
        # large star: each neighbour larger than u is tied to the smallest of u and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = staged(both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m")), "cc")
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = staged(large, "cc")
        # small star: the smaller neighbours of u, and u itself, are tied to the smallest of them
        down = staged(large.groupBy("u").agg(F.min("v").alias("m")), "cc")
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        after = staged(small.filter("u <> v").distinct(), "cc")
        printed = after.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        drop(now, low, large, down)
        now = after
        if tuple(printed) == before:
            return now.select(F.col("u").alias("v"), F.col("v").alias("m"))
        before = tuple(printed)
    raise RuntimeError("components did not settle")
