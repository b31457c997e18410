"""Fits over any number of learning rows: logistic losses by Newton steps and
order statistics. The driver gets a few numbers for each task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sample import cumulative
from .common import stored


def logistic_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and second derivatives of the logistic loss, summed over rows."""
    p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
    return x.T @ (p - y), (x * (p * (1 - p))[:, None]).T @ x


def newton(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], prior: np.ndarray, strength: float,
           longest: float, rounds: int) -> np.ndarray:
    """Newton steps of at most ``longest`` on the loss behind ``sums``, with a
    Gaussian prior around ``prior``."""
    w = prior.astype(float).copy()
    for _ in range(rounds):
        grad, hess = sums(w)
        step = np.linalg.solve(hess + strength * np.eye(len(w)), grad + strength * (w - prior))
        w -= step * min(1.0, longest / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """x, y of a batch as the bytes of two arrays."""
    for batch in batches:
        if batch.num_rows:
            parts = [batch.column(0).flatten(), batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c.to_numpy(zero_copy_only=False).astype(np.float64).tobytes()], pa.binary()) for c in parts],
                names=["x", "y"])


def _sums(w: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grad, hess = np.zeros(len(w)), np.zeros((len(w), len(w)))
        for batch in batches:
            for x, y in zip(*[c.to_pylist() for c in batch.columns]):
                g, h = logistic_sums(np.frombuffer(x).reshape(-1, len(w)), np.frombuffer(y), w)
                grad += g
                hess += h
        yield pa.RecordBatch.from_arrays([pa.array([np.append(grad, hess)], pa.list_(pa.float64()))], names=["s"])
    return run


def fit_rows(rows: DataFrame, prior: np.ndarray, strength: float, longest: float, rounds: int) -> np.ndarray:
    """``newton`` over all rows (x array<double>, y)."""
    held = rows.select("x", F.col("y").cast("double").alias("y")).mapInArrow(_packed, "x binary, y binary").persist(
        StorageLevel.MEMORY_AND_DISK)
    k = len(prior)

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = np.zeros(k + k * k)
        for row in held.mapInArrow(_sums(w), "s array<double>").collect():      # one row a task
            total += np.array(row["s"])
        return total[:k], total[k:].reshape(k, k)

    try:
        return newton(sums, prior, strength, longest, rounds)
    finally:
        held.unpersist()


def order_statistics(rows: DataFrame, ranks: dict, size: dict) -> dict:
    """{(group, rank): value} of rows (grp, value): the value at each of the
    0-based ``ranks`` of a group, whose ``size`` in rows is given. Equal values
    are counted first, so copies do not meet in one task."""
    asked, before = [], 0
    for group in sorted(size):
        asked += [(group, r, before + r) for r in ranks.get(group, ())]
        before += size[group]
    if not asked:
        return {}
    counts = stored(rows.groupBy("grp", "value").agg(F.count(F.lit(1)).alias("n")), "values")
    ends = cumulative(counts.select(F.struct("grp", "value").alias("k"), "n"), "k", "n")
    found = ends.agg(*[F.min(F.when(F.col("cum") > place, F.col("k"))).alias(f"r{i}") for i, (_, _, place) in enumerate(asked)]).first()
    return {(group, r): found[i]["value"] for i, (group, r, _) in enumerate(asked)}


def quantiles(rows: DataFrame, share: dict) -> dict:
    """{group: the ``share[group]`` quantile of its values}, between neighbours in proportion."""
    size = {r["grp"]: r["n"] for r in rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}     # one row a group
    at = {g: (n - 1) * share[g] for g, n in size.items() if g in share}
    found = order_statistics(rows, {g: {int(x), min(int(x) + 1, size[g] - 1)} for g, x in at.items()}, size)
    return {g: found[g, int(x)] + (x - int(x)) * (found[g, min(int(x) + 1, size[g] - 1)] - found[g, int(x)]) for g, x in at.items()}
