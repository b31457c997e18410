"""Model sinks: the weight table plus bias, as text lines or parquet.

Text layout: D weight lines in id order, then one bias line. The lines are
written range-partitioned by id and sorted inside each part, so the part
files concatenated in name order are the model in order; no single task
holds the whole model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import with_line_ids


def model_table(weights: DataFrame, b: float, d: int) -> DataFrame:
    """K1: ``(idx, w)`` rows for ids 1..D, then the bias as id D+1."""
    spark = weights.sparkSession
    bias = spark.range(1).select(F.lit(d + 1).cast("bigint").alias("idx"), F.lit(float(b)).alias("w"))
    return weights.select("idx", "w").unionByName(bias)


def write_model_text(model: DataFrame, path: str, parts: int | None = None) -> None:
    """K1 text form: one value per line in id order."""
    n = parts or max(1, int(model.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    (model.repartitionByRange(n, "idx").sortWithinPartitions("idx")
     .select(F.col("w").cast("string").alias("value")).write.mode("overwrite").text(path))


def write_model_parquet(model: DataFrame, path: str) -> None:
    model.write.mode("overwrite").parquet(path)


def read_model_text(spark: SparkSession, path: str) -> DataFrame:
    """Read a text model back as ``(idx, w)``: ids follow file order (part
    files by name, lines in order)."""
    lines = with_line_ids(spark.read.text(path), start=1, name="idx")
    return lines.select("idx", F.col("value").cast("double").alias("w"))
