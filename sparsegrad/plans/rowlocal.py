"""Row-local numeric passes: one Arrow pass over whole rows, no sort, no window.

A training row holds its whole vector, so its score needs only the weights.
Within ``MAX_WEIGHTS`` features the weight vector is one array of at most
32 MB: it is collected after a check of its size and broadcast. A task scores its
rows batch by batch and adds the gradient up in one array, so the only rows
that leave a task are its non-zero sums, or slices of them where D is large
(``plans.slices``). Feature ids outside 1..D raise.
Larger models go through ``plans.blocked``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import slices

#: Largest weight vector that is broadcast as an array of doubles (32 MB).
MAX_WEIGHTS = 4_000_000

Coefficient = Callable[[np.ndarray, np.ndarray], np.ndarray]


def gd_coefficients(y: np.ndarray, score: np.ndarray) -> np.ndarray:
    """(sigma(y s) - 1) y."""
    with np.errstate(over="ignore"):
        return (1.0 / (1.0 + np.exp(-y * score)) - 1.0) * y


def primal_coefficients(y: np.ndarray, score: np.ndarray) -> np.ndarray:
    """y g(y s)."""
    with np.errstate(over="ignore"):
        return y / (1.0 + np.exp(y * score))


def weight_array(weights: DataFrame, d: int) -> np.ndarray:
    """The weights as an array of length d + 1 (place 0 unused). Call only
    after ``d`` was checked against ``MAX_WEIGHTS``."""
    table = weights.select("idx", "w").toArrow()
    out = np.zeros(d + 1)
    idx = table.column("idx").to_numpy()
    check_ids(idx, d)
    out[idx] = table.column("w").to_numpy()
    return out


def check_ids(idx: np.ndarray, d: int) -> None:
    if len(idx) and (idx.min() < 1 or idx.max() > d):
        raise ValueError(f"feature id outside 1..{d}")


def sparse_entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each entry, ids, values) of an Arrow array of features."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    idx = flat.field("idx").to_numpy(zero_copy_only=False)
    if flat.field("idx").null_count or flat.field("val").null_count:
        raise ValueError("null feature id or value")
    return np.repeat(np.arange(len(column)), counts), idx, flat.field("val").to_numpy(zero_copy_only=False)


def sparse_batch(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``sparse_entries`` with ids checked against 1..d."""
    row, idx, val = sparse_entries(column)
    check_ids(idx, d)
    return row, idx, val


def dense_batch(column: pa.Array, d: int) -> np.ndarray:
    """Matrix of an Arrow array of dense vectors; any other length than d raises."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(lengths) and not (lengths == d).all():
        raise ValueError(f"dense row whose length is not {d}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def _scores(batch: pa.RecordBatch, w: np.ndarray, b: float, dense: bool):
    """(scores, function from row factors to the summed vector) of a batch."""
    d = len(w) - 1
    if dense:
        x = dense_batch(batch.column("x"), d)
        return x @ w[1:] + b, lambda c: np.concatenate([[0.0], c @ x])
    row, idx, val = sparse_batch(batch.column("features"), d)
    score = np.bincount(row, w[idx] * val, batch.num_rows) + b
    return score, lambda c: np.bincount(idx, c[row] * val, d + 1)


def with_scores(rows: DataFrame, w: np.ndarray, b: float) -> DataFrame:
    """``rows`` with ``score``. Rows may repeat ids or have none."""
    shared = rows.sparkSession.sparkContext.broadcast(w)
    dense = "features" not in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, _ = _scores(batch, shared.value, b, dense)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "score"])

    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def gradient(rows: DataFrame, w: np.ndarray, b: float, coefficient: Coefficient, weight: str | None = None,
             weigh: Callable[[pa.RecordBatch], np.ndarray] | None = None, above: float | None = None,
             summed: bool = True, width: int | None = None) -> DataFrame:
    """(idx, g): the summed gradient, the bias part at idx 0. With ``weight``
    the features, not the bias, are scaled by that column; with ``weigh`` by
    what it gives for a batch, and rows not ``above`` that value are left out.
    One row for each non-zero sum leaves a task; the shuffle on idx adds them
    up; without ``summed`` the rows of all tasks are returned as they are, for
    a caller that sums by idx anyway. Long vectors leave a task in slices of
    ``width`` ids and are added in two levels instead (``width`` 0: never).
    Without any row that counts the table is empty."""
    spark = rows.sparkSession
    if width is None:
        width = slices.SLICE if len(w) >= slices.SLICED_FROM * slices.SLICE else 0
    groups = slices.groups_of(rows.rdd.getNumPartitions()) if width else 1
    shared = spark.sparkContext.broadcast((w, weigh))
    vector = "features" if "features" in rows.columns else "x"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, weigh = shared.value
        total, seen = np.zeros(len(w)), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            score, added = _scores(batch, w, b, vector == "x")
            c = coefficient(batch.column("y").to_numpy(zero_copy_only=False), score)
            scale = batch.column(weight).to_numpy(zero_copy_only=False) if weight else weigh(batch) if weigh else 1.0
            active = batch.num_rows
            if weigh and above is not None:
                c = np.where(scale > above, c, 0.0)
                active = int((scale > above).sum())
            total += added(c * scale)
            total[0] += c.sum()
            seen += active
        if seen and width:
            yield from slices.packed(total, width, groups)
        elif seen:
            hit = np.flatnonzero(total)
            hit = hit if len(hit) and hit[0] == 0 else np.concatenate([[0], hit])
            for i in range(0, len(hit), 500_000):
                part = hit[i:i + 500_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(total[part])], names=["idx", "g"])

    keep = ["y", vector] + ([weight] if weight else [])
    if width:
        return slices.added(rows.select(*keep).mapInArrow(run, slices.PACKED), width, groups)
    parts = rows.select(*keep).mapInArrow(run, "idx long, g double")
    return parts.groupBy("idx").agg(F.sum("g").alias("g")) if summed else parts


def dense_sums(rows: DataFrame) -> DataFrame:
    """(pos, g), pos 0-based: sum of c * x over rows (c, x). A task adds its
    rows up in one dense vector, batch by batch, so at most D rows leave it,
    however many rows it reads. Vectors of different lengths raise."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = dense_batch(batch.column("x"), len(batch.column("x")[0]) if total is None else len(total))
            part = batch.column("c").to_numpy(zero_copy_only=False) @ x
            total = part if total is None else total + part
        if total is not None:
            for i in range(0, len(total), 500_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(i, min(i + 500_000, len(total)))), pa.array(total[i:i + 500_000])], names=["pos", "g"])

    parts = rows.select("c", "x").mapInArrow(run, "pos long, g double")
    return parts.groupBy("pos").agg(F.sum("g").alias("g"))


def measured(rows: DataFrame) -> tuple[int, int, int, int]:
    """(rows, entries, smallest id, largest id) of sparse rows, in one
    aggregate; ids are 0 without entries."""
    ids = F.transform("features", lambda f: f["idx"])
    got = rows.agg(F.count(F.lit(1)), F.sum(F.size("features")), F.min(F.array_min(ids)), F.max(F.array_max(ids))).first()
    return int(got[0]), int(got[1] or 0), int(got[2] or 0), int(got[3] or 0)


def gathered(rows: DataFrame, entries: int, d: int, spark: SparkSession | None = None) -> DataFrame:
    """Fewer, larger tasks for a gradient pass when D is large: a task should
    read several times as many entries as it may send sums. No shuffle."""
    spark = spark or rows.sparkSession
    want = max(spark.sparkContext.defaultParallelism, entries // (4 * max(1, d)))
    now = rows.rdd.getNumPartitions()
    return rows.coalesce(want) if want < now else rows
