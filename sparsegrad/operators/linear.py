"""Scores, per-row gradients and distributed vector sums.

A row holds its whole vector, so its score is a row-local sum over a weight
array that is broadcast after a check of its size (``plans.rowlocal``): no
sort, no window, no use of row ids. The gradient of all rows is added up inside
each task and summed over tasks by one shuffle on idx, the bias part riding
along as idx 0, so rows with an empty vector keep their bias term. Beyond the
size limit the trainers use ``plans.blocked``; the per-row operators join
entries and weights with hot ids split off."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..plans import rowlocal
from ..plans.blocked import FeatureBlocks
from ..plans.joins import lookup_join

BIAS_IDX = 0


def entries(rows: DataFrame, keep: list[str], with_bias: bool = False) -> DataFrame:
    """Explode ``features`` into one row per stored entry ``(keep..., idx, val)``.
    ``with_bias`` prepends the entry (0, 1.0) to every row."""
    feats = F.col("features")
    if with_bias:
        bias = F.array(F.struct(F.lit(BIAS_IDX).cast("bigint").alias("idx"), F.lit(1.0).alias("val")))
        feats = F.concat(bias, feats)
    return rows.select(*keep, F.inline(feats))


def placed(rows: DataFrame, d: int, **how) -> FeatureBlocks:
    """The entries of ``rows`` (row_id unique) placed by feature block, for
    operators that take ``blocks``: they send row-sized data, never entries.
    Ids outside 1..d raise. ``release()`` drops the placed copy."""
    _, n_entries, low, high = rowlocal.measured(rows)
    if n_entries and (low < 1 or high > d):
        raise ValueError(f"feature ids {low}..{high} are not all in 1..{d}")
    return FeatureBlocks(rows.select(F.col("row_id").alias("rid"), "features"), d, **how)


def scored(rows: DataFrame, weights: DataFrame, b: float = 0.0, *, d: int | None = None,
           max_weights: int = rowlocal.MAX_WEIGHTS, blocks: FeatureBlocks | None = None) -> DataFrame:
    """``rows`` with ``score = b + sum_k w[idx_k] * val_k`` (P1 with P4).

    ``d`` is the largest id of the weight table (read from it if not given);
    ids outside 1..d raise. Within ``max_weights`` the sum is row-local;
    beyond, entries meet their weights in a join with hot ids split off and
    are summed by ``row_id``, which must then be unique. With ``blocks`` (see
    ``placed``) partial scores of the placed entries are summed instead."""
    if blocks is not None:
        found = blocks.scores(rows.withColumnRenamed("row_id", "rid"), weights, b)
        return found.withColumnRenamed("rid", "row_id").select(*rows.columns, "score")
    d = int(weights.agg(F.max("idx")).first()[0] or 0) if d is None else d
    if d <= max_weights:
        return rowlocal.with_scores(rows, rowlocal.weight_array(weights, d), b)
    e = lookup_join(entries(rows, ["row_id"]), weights.select("idx", "w"), "idx", "left", lookup_rows=d,
                    max_broadcast_rows=max_weights)
    w = F.coalesce("w", F.raise_error(F.lit(f"feature id outside 1..{d}")).cast("double"))
    sums = e.groupBy("row_id").agg(F.sum(F.col("val") * w).alias("score"))
    total = F.coalesce("score", F.lit(0.0)) + F.lit(float(b))
    return rows.join(sums, "row_id", "left").select(*rows.columns, total.alias("score"))


def sparse_scores(rows: DataFrame, weights: DataFrame, b: float = 0.0, *,
                  keep: list[str] | None = None, d: int | None = None,
                  max_weights: int = rowlocal.MAX_WEIGHTS, blocks: FeatureBlocks | None = None) -> DataFrame:
    """Per-row score ``w . x + b`` (P1 with P4) as ``(row_id, keep..., score)``.
    Rows with an empty feature array score ``b``; duplicate ids add."""
    keep = [c for c in (keep or []) if c != "row_id"]
    need = rows.select("row_id", *keep, *([] if blocks else ["features"]))
    return scored(need, weights, b, d=d, max_weights=max_weights, blocks=blocks).select("row_id", *keep, "score")


def dense_scores(rows: DataFrame, w: Column, x: str = "x", shifted: bool = False) -> DataFrame:
    """Dense score ``w . x`` (P2), or ``w . x - w1 - w2`` (P3) when
    ``shifted``. ``w`` is an array column of length D (bounded by the row
    width, like every dense row)."""
    score = S.shifted_dense_score(w, F.col(x)) if shifted else S.dense_dot(w, F.col(x))
    return rows.withColumn("score", score)


# --- coefficients -----------------------------------------------------------

def gd_coef(y: str = "y", score: str = "score") -> Column:
    return S.gd_coefficient(F.col(y), F.col(score))


def primal_coef(y: str = "y", score: str = "score", scale: float = 1.0) -> Column:
    return S.primal_coefficient(F.col(y), F.col(score), scale)


# --- per-row gradients ------------------------------------------------------

def dense_row_gradients(rows: DataFrame, coef: Column, x: str = "x") -> DataFrame:
    """Per-row dense gradient ``coef * x`` exploded to ``(row_id, pos, g)``
    (pos 0-based)."""
    return rows.select("row_id", F.posexplode(F.transform(F.col(x), lambda v: coef * v)).alias("pos", "g"))


def sparse_row_gradients(rows: DataFrame, weights: DataFrame, b: float = 0.0, *,
                         coef: Callable[[], Column] = gd_coef, with_bias: bool = False,
                         weight: str | None = None, d: int | None = None,
                         max_weights: int = rowlocal.MAX_WEIGHTS, blocks: FeatureBlocks | None = None) -> DataFrame:
    """Per-row sparse gradient entries ``(row_id, idx, g)``.

    ``g = coef * val`` for feature entries; with ``weight`` (P11) feature
    entries are ``coef * p * val`` while the bias entry stays ``coef``.
    ``with_bias`` adds the bias entry (idx 0, value ``coef``). With ``blocks``
    the entries are made where they were placed."""
    if blocks is not None:
        read = rows.select(F.col("row_id").alias("rid"), "y", *([weight] if weight else []))
        return blocks.row_gradients(read, weights, b, coef, weight, with_bias).withColumnRenamed("rid", "row_id")
    need = rows.select("row_id", "y", "features", *([weight] if weight else []))
    c = scored(need, weights, b, d=d, max_weights=max_weights).withColumn("_c", coef())
    factor = F.col("_c") * F.col(weight) if weight else F.col("_c")
    parts = F.transform("features", lambda f: F.struct(f["idx"].alias("idx"), (factor * f["val"]).alias("g")))
    if with_bias:
        bias = F.array(F.struct(F.lit(BIAS_IDX).cast("bigint").alias("idx"), F.col("_c").alias("g")))
        parts = F.concat(bias, parts)
    return c.select("row_id", F.inline(parts))


def active_rows(rows: DataFrame, r: int, n: int, weight: str = "p") -> DataFrame:
    """rows whose weight is strictly above r/N."""
    return rows.where(F.col(weight) > F.lit(float(r) / float(n)))


# --- vector sums ------------------------------------------------------------

def dense_sum(row_vectors: DataFrame, pos: str = "pos", value: str = "g") -> DataFrame:
    """A1: element-wise sum of dense vectors given exploded ``(pos, value)``."""
    return row_vectors.groupBy(pos).agg(F.sum(value).alias(value))


def dense_gradient_sum(rows: DataFrame, coef: Column, x: str = "x") -> DataFrame:
    """P8 and A1 in one pass: ``(pos, g)`` with the sum of ``coef * x`` over
    all rows, added up inside the tasks; nothing is exploded."""
    return rowlocal.dense_sums(rows.select(coef.cast("double").alias("c"), F.col(x).cast("array<double>").alias("x")))


def sparse_sum(entries_df: DataFrame, idx: str = "idx", value: str = "g") -> DataFrame:
    """A2 / A3: sum of sparse vectors given exploded ``(idx, value)`` entries.
    A partial sum per task runs before the shuffle on ``idx``, so a feature id
    present in most rows still sends one row per task."""
    return entries_df.groupBy(idx).agg(F.sum(value).alias(value))


#: Array forms of the coefficients, for the row-local pass.
_ARRAY_COEFFICIENTS = {gd_coef: rowlocal.gd_coefficients, primal_coef: rowlocal.primal_coefficients}


def gradient(rows: DataFrame, weights: DataFrame, b: float = 0.0, *,
             coef: Callable[[], Column] = gd_coef, weight: str | None = None,
             d: int | None = None, max_weights: int = rowlocal.MAX_WEIGHTS, summed: bool = True) -> DataFrame:
    """A3 / A4: aggregated gradient ``(idx, g)``; idx 0 is the bias part (not
    ``summed``: an id may have a row for each task, as ``gradient_step`` takes).
    Filter rows first (F1) for the null-skipping form; an empty input gives
    an empty table, read as a zero gradient by ``apply_gradient``. ``rows``
    are sparse (``features``) or dense (``x``)."""
    d = int(weights.agg(F.max("idx")).first()[0] or 0) if d is None else d
    if d <= max_weights and coef in _ARRAY_COEFFICIENTS:
        return rowlocal.gradient(rows, rowlocal.weight_array(weights, d), b, _ARRAY_COEFFICIENTS[coef], weight,
                                 summed=summed)
    return sparse_sum(sparse_row_gradients(rows, weights, b, coef=coef, with_bias=True, weight=weight, d=d,
                                           max_weights=max_weights))
