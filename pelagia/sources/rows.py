"""Results as JSON rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_rows(df: DataFrame, omit_null: bool = False) -> DataFrame:
    """A column ``value`` with one JSON object for each row. Null fields are written, or left out as a store without the field would."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": str(omit_null).lower()}).alias("value"))


def write_json(df: DataFrame, path: str, omit_null: bool = False) -> None:
    json_rows(df, omit_null).write.mode("overwrite").text(path)
