"""Labelled training rows derived from the given parquet tables.

FX-S  sparse rows: one row per order having lineitems; row_id = o_orderkey+1,
      y = +1 for priorities '1-URGENT'/'2-HIGH' else -1, feature id =
      l_suppkey+1, value = sum(l_quantity)/50 per (order, supplier).
FX-E  FX-S plus the orders without lineitems (empty feature arrays).
FX-D  dense rows from ``embeddings``: row_id = vec_id+1, x = embedding,
      y = +1 if label < 5 else -1.
FX-2  two-dimensional dense rows from ``orders``:
      x = [o_totalprice/100000, (o_custkey % 10)/10], y as FX-S.
FX-W  weights w = ((idx*7919) % 1000 - 500)/1000 for idx 1..D, bias 0.25.
FX-P  FX-S plus a row weight p = ((row_id*31) % 97 + 1) / its L2 norm.

Generated keys start at 0 while feature ids are 1-based, hence the +1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed fixture values (shared with the SQL oracles).
POSITIVE_PRIORITIES = ("1-URGENT", "2-HIGH")
QUANTITY_SCALE = 50.0
FXW_MULT, FXW_MOD, FXW_SHIFT, FXW_DIV = 7919, 1000, 500, 1000.0
FXW_BIAS = 0.25
FXP_MULT, FXP_MOD = 31, 97


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select((F.col("o_orderkey") + 1).alias("row_id"),
                    F.when(F.col("o_orderpriority").isin(*POSITIVE_PRIORITIES), F.lit(1.0))
                    .otherwise(F.lit(-1.0)).alias("y"))


def sparse_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX-S in long form without labels: (row_id, idx, val)."""
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy((F.col("l_orderkey") + 1).alias("row_id"),
                       (F.col("l_suppkey") + 1).alias("idx"))
            .agg((F.sum("l_quantity") / F.lit(QUANTITY_SCALE)).alias("val")))


def sparse_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX-S long form: (row_id, y, idx, val)."""
    return sparse_entries(spark, sf_dir).join(order_labels(spark, sf_dir), "row_id") \
        .select("row_id", "y", "idx", "val")


def _feature_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One group per order: at most D entries after the (order, supplier)
    # pre-aggregation, so the collected array is bounded by the row width.
    return (sparse_entries(spark, sf_dir).groupBy("row_id")
            .agg(F.sort_array(F.collect_list(F.struct("idx", "val"))).alias("features")))


def sparse_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX-S row form: (row_id, y, features)."""
    return order_labels(spark, sf_dir).join(_feature_arrays(spark, sf_dir), "row_id") \
        .select("row_id", "y", "features")


def sparse_rows_with_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX-E: every order, orders without lineitems have ``features = []``."""
    empty = F.array().cast("array<struct<idx:bigint,val:double>>")
    return (order_labels(spark, sf_dir).join(_feature_arrays(spark, sf_dir), "row_id", "left")
            .select("row_id", "y", F.coalesce("features", empty).alias("features")))


def dense_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX-D: (row_id, y, x ARRAY<DOUBLE>) from ``embeddings``."""
    e = table(spark, sf_dir, "embeddings")
    return e.select((F.col("vec_id") + 1).alias("row_id"),
                    F.when(F.col("label") < 5, F.lit(1.0)).otherwise(F.lit(-1.0)).alias("y"),
                    F.col("embedding").cast("array<double>").alias("x"))


def two_dim_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX-2: (row_id, y, x) with x = [o_totalprice/1e5, (o_custkey % 10)/10]."""
    o = table(spark, sf_dir, "orders")
    return o.select((F.col("o_orderkey") + 1).alias("row_id"),
                    F.when(F.col("o_orderpriority").isin(*POSITIVE_PRIORITIES), F.lit(1.0))
                    .otherwise(F.lit(-1.0)).alias("y"),
                    F.array(F.col("o_totalprice") / F.lit(100000.0),
                            (F.col("o_custkey") % 10).cast("double") / F.lit(10.0)).alias("x"))


def fxw_value(idx: Column) -> Column:
    return ((idx * FXW_MULT) % FXW_MOD - FXW_SHIFT).cast("double") / F.lit(FXW_DIV)


def fx_weights(spark: SparkSession, d: int) -> DataFrame:
    """FX-W: (idx, w) for idx 1..d."""
    parts = max(1, -(-d // 1_000_000))
    return spark.range(1, d + 1, numPartitions=parts).select(F.col("id").alias("idx"),
                                                            fxw_value(F.col("id")).alias("w"))


def max_feature_id(rows: DataFrame) -> int:
    """D derived from the data: the largest feature id (scalar aggregate)."""
    v = rows.select(F.max(F.aggregate("features", F.lit(0).cast("bigint"),
                                      lambda a, f: F.greatest(a, f["idx"])))).first()[0]
    return int(v or 0)


def feature_count(spark: SparkSession, sf_dir: str) -> int:
    """D of FX-S from the narrow columns, without building its rows."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    known = li.join(o.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    return int(known.agg(F.max("l_suppkey")).first()[0] or 0) + 1


def row_count(spark: SparkSession, sf_dir: str) -> int:
    """N of FX-S: orders with line items."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(li, "o_orderkey", "left_semi").count()


def _q(row_id: Column) -> Column:
    return ((row_id * FXP_MULT) % FXP_MOD + 1).cast("double")


def fxp_norm(spark: SparkSession, sf_dir: str) -> float:
    """Norm of the FX-P row weights, from the row ids alone."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    q = _q(F.col("o_orderkey") + 1)
    rows = table(spark, sf_dir, "orders").join(li, "o_orderkey", "left_semi")
    return float(rows.agg(F.sqrt(F.sum(q * q))).first()[0])


def with_fxp_weights(rows: DataFrame, norm: float | None = None) -> DataFrame:
    """FX-P: add ``p = q / |q|_2`` with q = (row_id*31) % 97 + 1; the norm is
    one scalar aggregate unless given, the column stays distributed."""
    q = _q(F.col("row_id"))
    norm = rows.select(F.sqrt(F.sum(q * q))).first()[0] if norm is None else norm
    return rows.withColumn("p", q / F.lit(float(norm)))
