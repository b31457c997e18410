"""Norms and label sums: single scalar aggregates (partial per task, one
final merge of one row per task)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S


def sum_squares(df: DataFrame, col: str) -> float:
    """Sum of squares of a column (scalar)."""
    return float(df.agg(F.sum(F.col(col) * F.col(col))).first()[0] or 0.0)


def l2_norm(df: DataFrame, col: str) -> float:
    """L2 norm of a column (scalar)."""
    return sum_squares(df, col) ** 0.5


def norms_row(weights: DataFrame, rows: DataFrame, w: str = "w", p: str = "p") -> DataFrame:
    """A6 as a one-row table: |w|^2, |w|_2 and |p|_2. Each side is a scalar
    aggregate; the two one-row results are side by side."""
    p_norm = l2_norm(rows, p)
    ws = weights.agg(F.sum(F.col(w) * F.col(w)).alias("w_sumsq"))
    return ws.select("w_sumsq", F.sqrt("w_sumsq").alias("w_norm"), F.lit(p_norm).alias("p_norm"))


def unit_weights(weights: DataFrame, w: str = "w", norm: float | None = None) -> DataFrame:
    """W / |w|_2; a zero vector is left as it is."""
    n = l2_norm(weights, w) if norm is None else norm
    if n == 0.0:
        return weights
    return weights.withColumn(w, F.col(w) / F.lit(n))


def weighted_label_sum(rows: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """A7 with P17 / U4: one row ``(pys, b)`` with ``pys = sum p*y`` and
    ``b = sign(pys)``."""
    s = rows.agg(F.sum(F.col(p) * F.col(y)).alias("pys"))
    return s.select("pys", S.sign(F.col("pys")).alias("b"))
