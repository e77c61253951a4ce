"""Granules that arrive as files are ingested as they come, late days too; each batch replaces whole days, so a batch that is run again changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..config import GridConfig
from ..pipeline.ingest import ingest


def ingest_arrivals(spark: SparkSession, folder: str, schema: StructType, root: str, checkpoint: str, index_path: str | None = None, config: GridConfig | None = None, replace: bool = True) -> StreamingQuery:
    """Takes what has arrived and ends; run it again, or on a schedule, for what comes later."""

    def batch(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            ingest(df, root, index_path, config, replace=replace)

    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
