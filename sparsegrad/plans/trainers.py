"""The five trainers, composed from the operators.

State layout:

* ``R``  training rows, persisted once (memory, spilling to disk) in the
  partitions they are given;
* ``W``  weight table ``(idx, w)`` for ids 1..D, rewritten each iteration by
  one aggregate that also carries the new bias as idx 0 (persisted and
  checkpointed, every iteration by default);
* the row weights p of T3 and T4 are not a table: each pass works them out
  from the rows and the scalars of the iterations so far (``plans.history``),
  or, with a feature index, carries its sums along (``plans.featureindex``).
  The model's ``p`` is written once, at the end;
* driver: bias b, sampled ids, norms, N, D, the scalar history, and within
  ``max_weights`` the weight array on its way to the broadcast.

Draws: with ``u`` the first id whose running weight exceeds u times the total;
with ``seed`` instead an exponential race, which the jobs that write W and sum p
decide on the way.

Feature ids outside 1..D raise before the first pass. Stopping rule: a fixed
number of iterations, as in the reference. The returned tables are
checkpointed; ``Model.release`` drops their cached copies."""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import linear, norms, sample, update
from ..session import stored
from ..sources import model_io
from . import rowlocal
from .blocked import BLOCK_SIZE, FeatureBlocks
from .featureindex import CarriedSums
from .history import BINS, DualHistory
from .lineage import IterationState


@dataclass
class Model:
    weights: DataFrame            # (idx, w), ids 1..D
    b: float                      # bias
    d: int
    trace: list[dict] = field(default_factory=list)
    p: DataFrame | None = None    # (row_id, p) for the primal-dual trainers
    b_avg: float | None = None    # running-mean bias of the sampled trainer
    seconds: list[float] = field(default_factory=list)  # wall time per iteration
    state: IterationState | None = None

    def release(self) -> None:
        """Drop the cached copies of the state; the tables stay readable from
        their checkpoints."""
        if self.state is not None:
            self.state.release()

    def trace_frame(self, spark: SparkSession) -> DataFrame:
        """K2: the per-iteration trace as a table (one row per iteration)."""
        if not self.trace:
            return spark.createDataFrame([], "iter bigint")
        cols = list(self.trace[0].keys())
        ids = {"iter", "i", "j"}
        schema = ", ".join(f"{c} {'bigint' if c in ids else 'double'}" for c in cols)
        data = [tuple(t[c] if t[c] is None or c in ids else float(t[c]) for c in cols) for t in self.trace]
        return spark.createDataFrame(data, schema)

    def save(self, path: str, fmt: str = "text", use_b_avg: bool | None = None) -> None:
        """K1: write D weight lines then the bias line (the sampled trainer
        writes b_avg), as text (one value per line, in order) or parquet."""
        rows = self.model_rows(self.b_avg is not None if use_b_avg is None else use_b_avg)
        if fmt == "text":
            model_io.write_model_text(rows, path)
        else:
            model_io.write_model_parquet(rows, path)

    def model_rows(self, use_b_avg: bool = False) -> DataFrame:
        """K1: D weight rows in id order followed by the bias as id D+1."""
        bias = self.b_avg if (use_b_avg and self.b_avg is not None) else self.b
        return model_io.model_table(self.weights, bias, self.d)


def _w_measures() -> list:
    """Aggregates taken while a new weight table (with its bias row at idx
    0) is materialised: the sampling stats of w^2 over ids >= 1, the first
    two weights for the trace and the bias."""
    idx, w = F.col("idx"), F.col("w")
    feat = idx > 0
    return [F.min(F.when(feat, idx)), F.max(F.when(feat, idx)), F.sum(F.when(feat, w * w)),
            F.max(F.when(feat & (w != 0), idx)),
            F.sum(F.when(idx == 1, w)), F.sum(F.when(idx == 2, w)), F.sum(F.when(idx == 0, w))]


def _features_only(W: DataFrame) -> DataFrame:
    """The weight rows (ids >= 1) of a table that also holds the bias row."""
    return W.where(F.col("idx") > 0)


def _checked_ids(rows: DataFrame, d: int) -> tuple[int, int]:
    """(rows, entries) of sparse rows; ids outside 1..d raise."""
    n, n_entries, low, high = rowlocal.measured(rows)
    if n_entries and (low < 1 or high > d):
        raise ValueError(f"feature ids {low}..{high} are not all in 1..{d}")
    return n, n_entries


def _prepare(rows: DataFrame, d: int) -> tuple[DataFrame, int, int]:
    """Cached rows, N and the entry count, for the trainers whose rows have
    ids. A repeated row id raises: a draw could not tell such rows apart."""
    R = rows.select("row_id", "y", "features").persist(StorageLevel.MEMORY_AND_DISK)
    n, n_entries = _checked_ids(R, d)
    if R.groupBy("row_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        R.unpersist()
        raise ValueError("row ids repeat")
    return R, n, n_entries


def _draws(u: list[float] | float | None, seed: int | None, iters: int) -> list[float | None]:
    if (u is None) == (seed is None):
        raise ValueError("give either the draws or a seed")
    return [None] * iters if u is None else [u] * iters if isinstance(u, (int, float)) else list(u)


def _feature_race(seed: int | None, t: int) -> list:
    """The winner of the feature draw, for the action that writes W."""
    if seed is None:
        return []
    return [sample.race_winner(f"{seed}:w{t}", "idx", F.when(F.col("idx") > 0, F.col("w") * F.col("w")).otherwise(0.0), "w")]


def _drawn_feature(W: DataFrame, stats: tuple, u: float | None, race) -> tuple[int | None, float]:
    """(j, w_j): by the given draw from W, or the race that was run."""
    if u is None:
        return (None, 0.0) if race is None else (int(race["idx"]), float(race["w"]))
    return sample.sample_one(W, "idx", F.col("w") * F.col("w"), u, value="w", stats=stats, unique=True)


class _Pass:
    """The gradient of cached rows, row-local up to ``max_weights`` features,
    else over feature blocks keyed by ``rid``. An id may have several rows:
    the weight update sums by id in any case."""

    def __init__(self, R: DataFrame, d: int, n_entries: int, max_weights: int, rid: str, block_size: int):
        self.d, self.entries, self.rid = d, n_entries, rid
        self.blocks = None
        if d > max_weights:
            self.blocks = FeatureBlocks(R.select(F.col(rid).alias("rid"), "features"), d, block_size)

    def __call__(self, rows: DataFrame, W: DataFrame, b: float, coef) -> DataFrame:
        if self.blocks is None:
            return linear.gradient(rowlocal.gathered(rows, self.entries, self.d), W, b, coef=coef,
                                   d=self.d, max_weights=self.d, summed=False)
        return self.blocks.gradient(rows.select(F.col(self.rid).alias("rid"), "y"), W, b, coef)

    def active(self, rows: DataFrame, W: DataFrame, b: float, history: DualHistory, r: int, n: int) -> DataFrame:
        """The primal gradient of the rows whose weight is above r/N, scaled
        by that weight."""
        if self.blocks is None:
            return rowlocal.gradient(
                rowlocal.gathered(rows, self.entries, self.d), rowlocal.weight_array(W, self.d), b,
                rowlocal.primal_coefficients, weigh=history.frozen().weights, above=float(r) / float(max(1, n)),
                summed=False)
        act = linear.active_rows(history.with_p(rows), r, max(1, n)).select(F.col(self.rid).alias("rid"), "y", "p")
        return self.blocks.gradient(act, W, b, linear.primal_coef, "p")

    def release(self) -> None:
        if self.blocks is not None:
            self.blocks.release()


def train_gd(rows: DataFrame, d: int, iters: int, *, weights: DataFrame | None = None,
             b: float = 0.0, fit_bias: bool = False, shifted: bool = False,
             w_step: float = -1.0, b_step: float = -1.0, seed: int = 42,
             checkpoint_every: int = 1, max_weights: int = rowlocal.MAX_WEIGHTS,
             block_size: int = BLOCK_SIZE) -> Model:
    """Batch gradient descent.

    * T1: ``train_gd(rows, d, T)``: uniform(-1, 1) init, no bias,
      ``w -= sum (sigma(y w.x) - 1) y x``.
    * T0: ``shifted=True``: the score is ``w.x - w1 - w2``.
    * T2: ``fit_bias=True`` with zero init: ``score = w.x + b``,
      ``w -= sum tmp x``, ``b -= sum tmp``.

    ``rows`` have ``y`` and either sparse ``features`` or dense ``x``; a row id
    is not needed and not read. ``w_step`` / ``b_step`` scale the summed
    gradient (-1 as in the reference; -1/N gives mean-scale steps)."""
    spark = rows.sparkSession
    dense = "features" not in rows.columns
    R = rows.select("y", "x" if dense else "features")
    if not dense and d > max_weights:
        # row numbers must not change when a block is lost
        R = stored(R.withColumn("rid", F.monotonically_increasing_id()), "numbered")
    R = R.persist(StorageLevel.MEMORY_AND_DISK)
    n_entries = R.count() * d if dense else _checked_ids(R, d)[1]
    run = _Pass(R, d, n_entries, d if dense else max_weights, "rid", block_size)
    state = IterationState(checkpoint_every)
    if weights is None:
        weights = update.zero_weights(spark, d) if fit_bias else update.uniform_weights(spark, d, seed)
    first_two = [F.sum(F.when(F.col("idx") == 1, F.col("w"))), F.sum(F.when(F.col("idx") == 2, F.col("w")))]
    W, (w1, w2) = state.put("W", weights, 1, measure=first_two)
    model = Model(W, b, d, state=state)
    for t in range(1, iters + 1):
        t0 = time.perf_counter()
        w1, w2 = float(w1 or 0.0), float(w2 or 0.0)
        model.trace.append({"iter": t, "w1": w1, "w2": w2, "b": float(b)})
        grad = run(R, W, -(w1 + w2) if shifted else b, linear.gd_coef)
        # one job: gradient pass, weight update, and the new bias read back
        Wx, (w1, w2, nb) = state.put(
            "W", update.gradient_step(W, grad, w_step, b, b_step if fit_bias else 0.0), t, final=t == iters,
            measure=first_two + [F.sum(F.when(F.col("idx") == 0, F.col("w")))])
        W = _features_only(Wx)
        if fit_bias and nb is not None:
            b = float(nb)
        model.seconds.append(time.perf_counter() - t0)
    model.weights, model.b = W, float(b)
    run.release()
    R.unpersist()
    return model


def train_primal_dual(rows: DataFrame, d: int, iters: int, *, eta: float, r: int,
                      u: list[float] | float | None = None, seed: int | None = None, n: int | None = None,
                      w_step: float | None = None, b_step: float = 1.0,
                      clip: float | None = None, checkpoint_every: int = 1,
                      max_weights: int = rowlocal.MAX_WEIGHTS, block_size: int = BLOCK_SIZE,
                      feature_index: bool = False) -> Model:
    """Primal-dual logistic regression with row weights p.

    Per iteration: rows with ``p > r/N`` give ``c = y g(y (w.x + b))``;
    ``w += w_step * sum p c x`` (``w_step`` defaults to N) and
    ``b += b_step * sum c``; a feature j is drawn with probability
    ``w_j^2 / |w|^2`` from the updated w (draw ``u[t]``, or ``seed``); every
    row's p is multiplied by ``1 - eta s + (eta s)^2`` with
    ``s = x_j |w|^2 / w_j + b y`` (no clip unless ``clip`` is given), then
    p is L2-normalised.

    An iteration is a gradient pass that writes W and a pass that sums p^2;
    the latter must count every row, else the trainer raises. With
    ``feature_index`` (one more copy of the entries, written before the first
    iteration) the second pass reads only rows that hold a drawn feature."""
    spark = rows.sparkSession
    R, n_rows, n_entries = _prepare(rows, d)
    run = _Pass(R, d, n_entries, max_weights, "row_id", block_size)
    n = n_rows if n is None else n
    w_step = float(n) if w_step is None else w_step
    us = _draws(u, seed, iters)
    state = IterationState(checkpoint_every)
    history = DualHistory(eta, clip, 1.0 / math.sqrt(max(1, n_rows)))
    carried = CarriedSums(R, history) if feature_index else None
    W = state.put("W", update.zero_weights(spark, d), 1)
    b = 0.0
    model = Model(W, b, d, state=state)
    for t in range(1, iters + 1):
        t0 = time.perf_counter()
        grad = run.active(R, W, b, history, r, n)
        # one job: gradient pass, weight update, sampling stats and new bias
        Wx, (lo, hi, len_sq, last, w1, w2, nb, *race) = state.put(
            "W", update.gradient_step(W, grad, w_step, b, b_step), t, measure=_w_measures() + _feature_race(seed, t),
            final=t == iters)
        W = _features_only(Wx)
        if nb is not None:  # no active rows: no bias part, b stays
            b = float(nb)
        len_sq = float(len_sq or 0.0)
        j, w_j = None, 0.0
        if len_sq:
            j, w_j = _drawn_feature(W, (lo, hi, len_sq, last), us[t - 1], race[0] if race else None)
        history.add(j, w_j, len_sq, b)
        sums = carried.step() if carried else history.totals(R)
        if sums.n != n_rows:  # A8
            raise RuntimeError(f"dual pass counted {sums.n} rows of {n_rows}")
        (carried or history).normalise(sums)
        model.trace.append({"iter": t, "w1": float(w1 or 0.0), "w2": float(w2 or 0.0), "b": float(b), "j": j})
        model.seconds.append(time.perf_counter() - t0)
    model.weights, model.b = W, float(b)
    model.p = state.put("P", history.with_p(R).select("row_id", "p"), max(1, iters), final=True)
    run.release()
    R.unpersist()
    return model


def train_sampled(rows: DataFrame, d: int, iters: int, *, u_rows: list[float] | float | None = None,
                  u_features: list[float] | float | None = None, seed: int | None = None, eta: float = 0.15,
                  clip: float | None = None, checkpoint_every: int = 1, feature_index: bool = False) -> Model:
    """T4: sampled primal-dual, as a distributed job.

    Per iteration: draw one row i with probability p_i^2; step
    ``w += y g(y (w.x_i + b)) / sqrt(2T) x_i`` and project w to unit norm;
    ``b = sign(sum p y)``; ``b_avg`` is the running mean of b; draw a feature
    j with probability w_j^2; every row's p is multiplied by the dual factor
    of ``s = clip(x_j / w_j + b y, 1/eta)`` and L2-normalised. The model's
    bias line is b_avg. Both draws are given (``u_rows``, ``u_features``) or
    both raced (``seed``). With ``feature_index`` as in T3 a dual step reads
    only rows that hold a drawn feature; a race needs a key of every row, so
    the draws must be given then."""
    spark = rows.sparkSession
    if feature_index and seed is not None:
        raise ValueError("raced row draws read every row: give the draws to use a feature index")
    R, n, _ = _prepare(rows, d)
    if not n:
        raise ValueError("no rows to sample")
    clip = 1.0 / eta if clip is None else clip
    ur, uf = _draws(u_rows, seed, iters), _draws(u_features, seed, iters)
    scale = math.sqrt(2.0 * iters)
    state = IterationState(checkpoint_every)
    history = DualHistory(eta, clip, 1.0 / math.sqrt(n))
    W = state.put("W", update.zero_weights(spark, d), 1)
    low, high = R.agg(F.min("row_id"), F.max("row_id")).first()
    width = -(-(high - low + 1) // BINS)

    carried = CarriedSums(R, history, low, width) if feature_index else None

    def passed(t: int):
        """Sums of p and what the row draw of iteration ``t`` needs."""
        if carried:
            return carried.step() if t > 1 else carried.totals()
        return history.totals(R, race=(seed, t)) if seed is not None else history.totals(R, low, width)

    sums = passed(1)
    b, b_avg = 0.0, 0.0
    model = Model(W, b, d, state=state)
    for t in range(1, iters + 1):
        t0 = time.perf_counter()
        row = history.draw(R, sums, ur[t - 1]) if seed is None else history._row(R, sums.winner)
        Ws, (lo, hi, norm_sq, last, *race) = state.put(
            "W", update.row_step(row["y"], row["features"], W, b, scale), t, final=t == iters,
            measure=sample.weight_stats(None, "idx", F.col("w") * F.col("w")) + _feature_race(seed, t))
        norm = math.sqrt(norm_sq or 0.0)
        W = norms.unit_weights(Ws, "w", norm=norm)
        # U4: p is only rescaled by a positive norm since it was summed
        b = float(math.copysign(1.0, sums.labels)) if sums.labels else 0.0
        b_avg = (b_avg * (t - 1) + b) / t
        j, w_j, len_sq = None, 0.0, 0.0
        if norm:
            # drawn on the written table with its stats (same id as on w/|w|)
            j, w_raw = _drawn_feature(Ws, (lo, hi, norm_sq, last), uf[t - 1], race[0] if race else None)
            w_j, len_sq = w_raw / norm, 1.0
        history.add(j, w_j, len_sq, b)
        sums = passed(t + 1)
        if sums.n != n:
            raise RuntimeError(f"dual pass counted {sums.n} rows of {n}")
        sums = (carried or history).normalise(sums)
        model.trace.append({"iter": t, "i": row["row_id"], "b": float(b), "b_avg": float(b_avg), "j": j})
        model.seconds.append(time.perf_counter() - t0)
    model.weights, model.b, model.b_avg = W, float(b), float(b_avg)
    model.p = state.put("P", history.with_p(R).select("row_id", "p"), max(1, iters), final=True)
    R.unpersist()
    return model
