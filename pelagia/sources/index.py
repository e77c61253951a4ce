"""The bounds index: a JSON table of one row with the earliest and the latest day. Missing or damaged values are filled from the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import messages as say
from ..errors import NotFound
from ..functions.columns import parsed_date

SCHEMA = "earliest string, latest string"


def read_index(spark: SparkSession, path: str, days: DataFrame) -> DataFrame:
    """earliest and latest, one row."""
    scanned = days.agg(F.min("date").alias("e"), F.max("date").alias("l"))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return scanned.toDF("earliest", "latest")
    stored = spark.read.schema(SCHEMA).json(path).agg(F.min(parsed_date("earliest")).alias("earliest"), F.max(parsed_date("latest")).alias("latest"))
    return stored.crossJoin(scanned).select(F.coalesce("earliest", "e").alias("earliest"), F.coalesce("latest", "l").alias("latest"))  # a row each


def merged(bounds: DataFrame, day) -> DataFrame:
    """The bounds with one more day; greatest and least skip nulls. Other columns stay."""
    return bounds.select(*(c for c in bounds.columns if c not in ("earliest", "latest")), F.least("earliest", day).alias("earliest"), F.greatest("latest", day).alias("latest"))


def write_index(bounds: DataFrame, path: str) -> None:
    bounds.select(F.date_format("earliest", "yyyy-MM-dd").alias("earliest"), F.date_format("latest", "yyyy-MM-dd").alias("latest")).coalesce(1).write.mode("overwrite").json(path)


def rebuilt(days: DataFrame) -> DataFrame:
    """Bounds from the manifest alone; an empty store is an error."""
    bounds = days.agg(F.min("date").alias("earliest"), F.max("date").alias("latest"))
    if bounds.filter("earliest is not null").isEmpty():
        raise NotFound(say.NO_DAYS)
    return bounds
