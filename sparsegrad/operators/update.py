"""Weight and row-weight initialisation and updates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..plans.rowlocal import primal_coefficients
from .linear import BIAS_IDX


# Weight-table rows per partition: a weight row is 16 bytes, so a partition
# of the table stays around 16 MB whatever D is.
WEIGHT_ROWS_PER_PARTITION = 1_000_000


def weight_ids(spark: SparkSession, d: int) -> DataFrame:
    """Ids 1..d generated in parallel, one partition per million ids."""
    parts = max(1, -(-d // WEIGHT_ROWS_PER_PARTITION))
    return spark.range(1, d + 1, numPartitions=parts)


def zero_weights(spark: SparkSession, d: int) -> DataFrame:
    """``(idx, w = 0)`` for idx 1..d, generated in parallel."""
    return weight_ids(spark, d).select(F.col("id").alias("idx"), F.lit(0.0).alias("w"))


def uniform_weights(spark: SparkSession, d: int, seed: int = 42) -> DataFrame:
    """``(idx, w)`` uniform in [-1, 1) from the seeded hash uniform."""
    return weight_ids(spark, d).select(
        F.col("id").alias("idx"), (F.lit(2.0) * S.seeded_uniform(F.lit(seed), F.col("id")) - 1.0).alias("w"))


def initial_p(rows: DataFrame, n: int | None = None) -> DataFrame:
    """``p = 1 / sqrt(N)`` for every row (ones, L2-normalised)."""
    n = rows.count() if n is None else n
    return rows.withColumn("p", F.lit(1.0 / (float(n) ** 0.5)))


def _outside() -> Column:
    return F.raise_error(F.lit("gradient of a feature id that the weight table lacks")).cast("double")


def apply_gradient(weights: DataFrame, grad: DataFrame, step: float) -> DataFrame:
    """``w + step * g`` per id; ids without a gradient keep w, and a
    gradient of an id that the weight table lacks raises."""
    g = grad.where(F.col("idx") != BIAS_IDX).select("idx", F.col("g").alias("_g"))
    j = weights.select("idx", "w").join(g, "idx", "full")
    return j.select("idx", (F.coalesce("w", _outside()) + F.lit(float(step)) * F.coalesce("_g", F.lit(0.0))).alias("w"))


def gradient_step(weights: DataFrame, grad: DataFrame, w_step: float, b: float,
                  b_step: float) -> DataFrame:
    """The new weights ``w + w_step * g`` per id plus one row at idx 0
    holding the new bias ``b + b_step * g0`` (absent when the gradient has no
    bias part, i.e. no active rows).

    The weight table and the scaled gradient (which may have several rows for
    an id) are unioned and summed per id: one shuffle, nothing broadcast. Ids without a gradient
    keep their weight; an id that the weight table lacks raises."""
    scale = F.when(F.col("idx") == BIAS_IDX, F.lit(float(b_step))).otherwise(F.lit(float(w_step)))
    summed = (weights.select("idx", "w", F.lit(1).alias("known"))
              .unionByName(grad.select("idx", (scale * F.col("g")).alias("w"), F.lit(0).alias("known")))
              .groupBy("idx").agg(F.sum("w").alias("w"), F.max("known").alias("known")))
    return summed.select("idx", F.when(F.col("idx") == BIAS_IDX, F.col("w") + F.lit(float(b)))
                         .when(F.col("known") == 1, F.col("w")).otherwise(_outside()).alias("w"))


def apply_factors(p_rows: DataFrame, factor_pairs: DataFrame, p: str = "p") -> DataFrame:
    """``p * factor`` per row; rows without a factor keep p and repeated
    pairs of one row multiply. Pairs are reduced per row first (partial
    product before the shuffle), so the join is one-to-one."""
    per_row = factor_pairs.groupBy("row_id").agg(F.product("factor").alias("_f"))
    j = p_rows.join(per_row, "row_id", "left")
    return j.withColumn(p, F.col(p) * F.coalesce(F.col("_f"), F.lit(1.0))).drop("_f")


def normalise(rows: DataFrame, col: str = "p") -> tuple[DataFrame, float]:
    """U2 second half: divide by the L2 norm (one scalar aggregate)."""
    norm = float(rows.agg(F.sqrt(F.sum(F.col(col) * F.col(col)))).first()[0] or 0.0)
    if norm == 0.0:
        return rows, norm
    return rows.withColumn(col, F.col(col) / F.lit(norm)), norm


#: Ids that are looked up in the weight table by a literal list.
LIST_IDS = 10_000


def single_row_step(rows: DataFrame, weights: DataFrame, b: float, row_id: int,
                    scale: float) -> DataFrame:
    """``w += y * g(y (w.x + b)) / scale * x`` for the one sampled row. A
    row id that is not there exactly once raises."""
    found = rows.where(F.col("row_id") == F.lit(int(row_id))).agg(
        F.count(F.lit(1)).alias("n"), F.first(F.struct("y", "features")).alias("row")).first()
    if found["n"] != 1:
        raise ValueError(f"row id {row_id} is there {'more than once' if found['n'] else 'not at all'}")
    return row_step(found["row"]["y"], found["row"]["features"], weights, b, scale)


def row_step(y: float, features: list, weights: DataFrame, b: float, scale: float) -> DataFrame:
    """U5 of a row at hand: the weights of its ids come back (as few as the row
    is wide), and a join adds the step. An id that the weight table lacks
    raises."""
    y, spark = float(y), weights.sparkSession
    x: dict[int, float] = {}
    for f in features:
        x[int(f["idx"])] = x.get(int(f["idx"]), 0.0) + float(f["val"])
    own = spark.createDataFrame(list(x.items()), "idx bigint, val double")
    if len(x) <= LIST_IDS:
        w = {r["idx"]: r["w"] for r in weights.where(F.col("idx").isin(list(x))).select("idx", "w").collect()} if x else {}
        if len(w) != len(x):
            raise ValueError("gradient of a feature id that the weight table lacks")
        score = sum(v * w[k] for k, v in x.items())
    else:
        score = own.join(weights.select("idx", "w"), "idx", "left").agg(
            F.sum(F.col("val") * F.coalesce("w", _outside()))).first()[0]
    coef = float(primal_coefficients(np.array([y]), np.array([score + b]))[0]) / scale
    return apply_gradient(weights, own.select("idx", (F.lit(coef) * F.col("val")).alias("g")), 1.0)
