"""Parity of a source day with the store: differences over a tolerance, by field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..sources.store import FIELDS

TOLERANCE = 1e-5


def differences(source: DataFrame, target: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """A row for each shared cell and field with both values: date, lat_idx, lon_idx, field, source, target, diff."""
    keys = ["date", "lat_idx", "lon_idx"]
    pick = lambda df, to: df.select(*keys, *(F.nanvl(F.col(f).cast("double"), F.lit(None)).alias(f"{to}_{f}") for f in fields))
    both = pick(source, "a").join(pick(target, "b"), keys)
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("source"), F.col(f"b_{f}").alias("target")) for f in fields)))
    rows = both.select(*keys, each.alias("x")).select(*keys, "x.*").filter("source is not null and target is not null")
    return rows.filter((F.abs("source") < float("inf")) & (F.abs("target") < float("inf"))).withColumn("diff", F.abs(F.col("source") - F.col("target")))


def sampled(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n cells, picked by a hash of their place: the same ones each time."""
    return df.orderBy(F.xxhash64(F.lit(seed), "date", "lat_idx", "lon_idx"), "date", "lat_idx", "lon_idx").limit(n)


def summary(diffs: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """For each field: pairs compared, largest difference, pairs over the tolerance."""
    return diffs.groupBy("field").agg(F.count(F.lit(1)).alias("compared"), F.max("diff").alias("max_diff"), F.count_if(F.col("diff") > tolerance).alias("mismatches"))


def worst(diffs: DataFrame, k: int = 5, tolerance: float = TOLERANCE) -> DataFrame:
    """The k largest differences over the tolerance of each field."""
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("diff"), "date", "lat_idx", "lon_idx"))
    return diffs.filter(F.col("diff") > tolerance).withColumn("rank", rank).filter(F.col("rank") <= k)


def verify(source: DataFrame, target: DataFrame, n: int | None = None, seed: int = 42, tolerance: float = TOLERANCE) -> tuple[str, DataFrame]:
    """PASS, FAIL or VACUOUS (no pair could be compared), and the summary. With n, that many source cells are compared."""
    result = summary(differences(sampled(source, n, seed) if n else source, target), tolerance)
    rows = result.collect()  # a row for each field
    if not rows:
        return "VACUOUS", result
    return ("FAIL" if any(r["mismatches"] for r in rows) else "PASS"), result


def axes_agree(a: DataFrame, b: DataFrame, idx: str, value: str, tolerance: float = 1e-9) -> DataFrame:
    """One row: cells of one axis only, and shared cells whose coordinates differ; a warning, not a failure."""
    both = a.select(idx, F.col(value).alias("a")).join(b.select(idx, F.col(value).alias("b")), idx, "full_outer")
    return both.agg(F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("unmatched"), F.count_if(F.abs(F.col("a") - F.col("b")) >= tolerance).alias("moved"))
