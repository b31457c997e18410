"""Dual steps that read only the rows of drawn features.

``FeatureIndex`` is the inverted form of the rows: one posting (feature, row,
label, first value) for each feature of a row, range-partitioned by (feature,
row) and written once in the shared folder, so that a hot feature spans several
files and a look-up opens the files that can hold the feature and no others.

``CarriedSums`` keeps the sums of p and p^2 by (bin of row ids, label). A dual
step multiplies the weight of a row without the drawn feature by a factor of
its label alone, so such rows change their sums by two scalars for each label;
only rows that hold the feature are read. Their weights follow from the postings
of the features drawn so far (``plans.history``): logarithms add up by row.

What rows without the feature hold is found by subtraction. Every
``EXACT_EVERY`` steps, and whenever a subtraction would lose more than six
digits, the sums are taken from all rows anew; likewise when the drawn
features have more postings than there are rows, as a pass is cheaper then."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .history import DualHistory, Totals
from .rowlocal import sparse_entries

#: Distinct labels up to which sums are kept by label.
LABELS = 64
#: Steps between two passes over all rows, and the least share of a sum that a subtraction may leave.
EXACT_EVERY = 32
LEAST_REST = 1e-6

POSTING = "idx long, row_id long, y double, val double"


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first value of each feature of a row."""
    for batch in batches:
        row, idx, val = sparse_entries(batch.column("features"))
        at = slice(None)
        if not ((np.diff(idx) > 0) | (np.diff(row) != 0)).all():     # else each id of a row stands alone
            order = np.lexsort((idx, row))
            first = np.ones(len(order), bool)
            first[1:] = (np.diff(row[order]) != 0) | (np.diff(idx[order]) != 0)
            at = order[first]
        ids = batch.column("row_id").to_numpy(zero_copy_only=False)[row[at]]
        y = batch.column("y").to_numpy(zero_copy_only=False)[row[at]]
        yield pa.RecordBatch.from_arrays([pa.array(idx[at]), pa.array(ids), pa.array(y), pa.array(val[at])],
                                         names=["idx", "row_id", "y", "val"])


class FeatureIndex:
    """Postings of sparse rows (row_id unique, y, features)."""

    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession
        path = f"{ensure_checkpoint_dir(spark)}/postings-{uuid.uuid4().hex}"
        (rows.select("row_id", "y", "features").mapInArrow(_postings, POSTING)
         .repartitionByRange("idx", "row_id").withColumn("part", F.spark_partition_id())
         .sortWithinPartitions("part", "idx", "row_id").write.partitionBy("part").parquet(path))
        self.table = spark.read.schema(f"{POSTING}, part int").parquet(path)
        # one row for each shuffle partition
        self.parts = [tuple(r) for r in self.table.groupBy("part").agg(F.min("idx"), F.max("idx")).collect()]

    def postings(self, features: list[int]) -> DataFrame:
        """(idx, row_id, y, val) of some features; other files are not opened."""
        parts = [p for p, low, high in self.parts if any(low <= j <= high for j in features)]
        return self.table.where(F.col("part").isin(parts) & F.col("idx").isin(features)).drop("part")


class CarriedSums:
    """The sums behind ``Totals``, carried along with a history. Row ids are
    binned from ``low`` by ``width`` (one bin without)."""

    def __init__(self, rows: DataFrame, history: DualHistory, low: int = 0, width: int | None = None):
        self.rows, self.history, self.low, self.width = rows, history, low, width
        labels = rows.select("y").distinct().limit(LABELS + 1).count()
        self.index = FeatureIndex(rows) if labels <= LABELS else None
        self.held: dict[int, int] = {}
        self.since, self.passes, self.read = 0, 0, 0
        # self.held: rows that hold a feature, for the features looked up; self.read: postings read
        #: (bin, label): [rows, sum of p, sum of p^2, first id, last id]
        self.groups: dict[tuple[int, float], list] = {}
        self._exact()

    def _bin(self):
        return F.floor((F.col("row_id") - F.lit(self.low)) / F.lit(self.width)) if self.width else F.lit(0).cast("bigint")

    def _exact(self) -> None:
        shared = self.rows.sparkSession.sparkContext.broadcast(self.history.frozen())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("y"), pa.array(shared.value.weights(batch))],
                                                 names=["row_id", "y", "p"])

        p = self.rows.select("row_id", "y", "features").mapInArrow(run, "row_id long, y double, p double")
        p = p.groupBy(self._bin().alias("bin"), "y") if self.index is not None else p.groupBy(self._bin().alias("bin"))
        found = p.agg(F.count(F.lit(1)), F.sum("p"), F.sum(F.col("p") * F.col("p")), F.sum(F.col("p") * F.col("y")),
                      F.min("row_id"), F.max("row_id")).collect()
        if self.index is not None:
            self.groups = {(r[0], r[1]): [r[2], r[3], r[4], r[6], r[7]] for r in found}
        else:  # too many labels: the sum of p y stands in the place of a label of 1
            self.groups = {(r[0], 1.0): [r[1], r[4], r[3], r[5], r[6]] for r in found}
        self.since, self.passes = 0, self.passes + 1

    def totals(self) -> Totals:
        bins: dict[int, tuple] = {}
        for (k, _), (n, _, s, first, last) in self.groups.items():
            a = bins.get(k, (0.0, 0, first, last))
            bins[k] = (a[0] + s, a[1] + n, min(a[2], first), max(a[3], last))
        return Totals(sum(g[0] for g in self.groups.values()), sum(g[2] for g in self.groups.values()),
                      sum(y * g[1] for (_, y), g in self.groups.items()), sorted((k, *v) for k, v in bins.items()), None)

    def step(self) -> Totals:
        """The sums after the last step of the history, weights not normalised yet."""
        j, q, b = self.history.steps[-1]
        known = sum(self.held.values())
        self.since += 1
        if self.index is None or self.since >= EXACT_EVERY or known > sum(g[0] for g in self.groups.values()) or not self._carry(j, q, b):
            self._exact()
        return self.totals()

    def normalise(self, sums: Totals) -> Totals:
        k = sums.norm or 1.0
        for g in self.groups.values():
            g[1], g[2] = g[1] / k, g[2] / (k * k)
        return self.history.normalise(sums)

    def _carry(self, j: int | None, q: float, b: float) -> bool:
        """False where a subtraction would lose too much."""
        frozen = self.history.frozen()
        hold = {} if j is None else self._holders(frozen, j, q, b)
        after = {}
        for (k, y), (n, p, s, first, last) in self.groups.items():
            f = math.exp(frozen.log_factor(np.array([y * b]))[0])
            m, old_p, old_s, new_p, new_s = hold.pop((k, y), (0, 0.0, 0.0, 0.0, 0.0))
            if m > n:
                raise RuntimeError(f"{m} rows hold feature {j}, of {n}")
            if m == n:
                after[k, y] = [n, new_p, new_s, first, last]
                continue
            if s - old_s < LEAST_REST * s:
                return False
            after[k, y] = [n, f * (p - old_p) + new_p, f * f * (s - old_s) + new_s, first, last]
        if hold:
            raise RuntimeError(f"rows that hold feature {j} are not among the rows")
        self.groups = after
        return True

    def _holders(self, frozen, j: int, q: float, b: float) -> dict:
        """(bin, label): rows that hold ``j``, their sums before and after the step."""
        drawn = [int(k) for k in frozen.features]
        shared = self.rows.sparkSession.sparkContext.broadcast(frozen)

        def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                idx, y, val = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("idx", "y", "val"))
                x = pa.array(np.where(idx == j, val, np.nan), from_pandas=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row_id"), batch.column("y"), pa.array(shared.value.changes(idx, y, val)), x],
                    names=["row_id", "y", "c", "x"])

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                y, c, x = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("y", "c", "x"))
                new = np.exp(shared.value.by_label(y) + c)
                old = new / np.exp(shared.value.log_factor(x * q + b * y))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("bin"), batch.column("y"), pa.array(old), pa.array(new)], names=["bin", "y", "old", "new"])

        found = self.index.postings(drawn).mapInArrow(changes, "row_id long, y double, c double, x double")
        if len(drawn) > 1:
            found = found.groupBy("row_id").agg(F.max("y").alias("y"), F.sum("c").alias("c"), F.max("x").alias("x"))
            found = found.where("x IS NOT NULL")
        rows = found.select(self._bin().alias("bin"), "y", "c", "x").mapInArrow(sums, "bin long, y double, old double, new double")
        square = lambda c: F.sum(F.col(c) * F.col(c))
        got = rows.groupBy("bin", "y").agg(F.count(F.lit(1)), F.sum("old"), square("old"), F.sum("new"), square("new")).collect()
        self.held[j] = sum(r[2] for r in got)
        self.read += sum(self.held.get(k, 0) for k in drawn)
        return {(r[0], r[1]): tuple(r[2:]) for r in got}
