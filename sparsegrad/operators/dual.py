"""Dual (row-weight) side: sampled feature look-up, score estimate, clip,
multiplicative factor and the per-row (row_id, factor) pairs.

All of it is a per-row projection over the row table with a handful of
driver scalars (j, w_j, |w|^2, b, eta): no join and no shuffle. The pairs
stay a distributed table (the reference concatenated them on the driver)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S


def feature_value(rows: DataFrame, j: int, name: str = "x_j") -> DataFrame:
    """Value of feature ``j`` per row, first match in file order, 0 if absent."""
    return rows.withColumn(name, S.first_feature_value(F.col("features"), F.lit(int(j))))


def estimate(rows: DataFrame, j: int, w_j: float, norm_sq: float, b: float,
             name: str = "s") -> DataFrame:
    """``s = x_j * |w|^2 / w_j + b * y`` (feature term 0 when w_j = 0)."""
    x_j = S.first_feature_value(F.col("features"), F.lit(int(j)))
    return rows.withColumn(name, S.dual_estimate(x_j, F.lit(float(norm_sq)), F.lit(float(w_j)),
                                                 F.lit(float(b)), F.col("y")))


def factor_expr(j: int, w_j: float, norm_sq: float, b: float, eta: float,
                clip: float | None = None) -> Column:
    """``1 - eta*s + (eta*s)^2`` of a row (reads ``features`` and ``y``);
    ``clip`` bounds s to [-clip, clip] first (P14)."""
    x_j = S.first_feature_value(F.col("features"), F.lit(int(j)))
    s = S.dual_estimate(x_j, F.lit(float(norm_sq)), F.lit(float(w_j)), F.lit(float(b)), F.col("y"))
    if clip is not None:
        s = S.clip(s, F.lit(float(clip)))
    return S.dual_factor(s, F.lit(float(eta)))


def factors(rows: DataFrame, j: int, w_j: float, norm_sq: float, b: float, eta: float,
            clip: float | None = None) -> DataFrame:
    """The ``(row_id, factor)`` pairs of all rows (A5: kept as a table)."""
    return rows.select("row_id", factor_expr(j, w_j, norm_sq, b, eta, clip).alias("factor"))


def count_check(pairs: DataFrame, n: int) -> DataFrame:
    """One row comparing the number of pairs (and distinct rows) with N.
    ``ok`` is 1 when both equal N; the caller decides whether to raise."""
    agg = pairs.agg(F.count(F.lit(1)).alias("n_pairs"),
                    F.count_distinct("row_id").alias("n_distinct"))
    return agg.select("n_pairs", "n_distinct", F.lit(int(n)).cast("bigint").alias("n_rows"),
                      ((F.col("n_pairs") == n) & (F.col("n_distinct") == n)).cast("bigint").alias("ok"))
