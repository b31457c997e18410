"""Cumulative weights and inverse-CDF sampling over id order.

A global running sum ordered by id would be one sorted task. Here ids are cut
into ranges of about ``RANGE_ROWS`` rows by Spark's range partitioning (bounds
come from a sample of the ids, so gaps and outliers do not fill one range):
range totals get an exclusive running offset, and the running sum inside a
range is a window over that range alone.

A draw u takes the first id whose cumulative weight exceeds ``u * total``
(strict, so a zero-weight id is never drawn); a rounding overshoot past the end
takes the last id of non-zero weight.

Where draws need not be given from outside, an exponential race draws in one
pass: every id has the key -ln(u_id) / weight, and the least key wins."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as S
from ..session import stored

#: Rows of one id range, and draws that one task looks up in it, on average.
RANGE_ROWS = 100_000
RANGE_DRAWS = 100_000
#: Bins of one narrowing step of a single draw, and rows read at its end.
BINS = 1024
LAST_ROWS = 4096
#: Ranges that may be broadcast.
BROADCAST_RANGES = 200_000
#: Rows, on average, whose race is worked out for one of many draws.
RACE_LEFT = 32.0


def _ranged(df: DataFrame, key: str, weight) -> tuple[DataFrame, DataFrame, float, int | None]:
    """(rows with ``_range``, offsets by range, total, last id of non-zero
    weight). The rows are written once, so every reader sees the same ranges."""
    w = F.col(weight) if isinstance(weight, str) else weight
    narrow = df.select(F.col(key), w.cast("double").alias("_w"))
    n, total, last = narrow.agg(F.count(F.lit(1)), F.sum("_w"), F.max(F.when(F.col("_w") != 0, F.col(key)))).first()
    cut = narrow.repartitionByRange(max(1, -(-n // RANGE_ROWS)), key)
    rows = stored(cut.withColumn("_range", F.spark_partition_id().cast("bigint")), "ranges")
    totals = rows.groupBy("_range").agg(F.sum("_w").alias("_tot"))
    # one row for each range of RANGE_ROWS rows
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", "_tot", F.coalesce(F.sum("_tot").over(before), F.lit(0.0)).alias("_off"))
    return rows, offsets, float(total or 0.0), last


def cumulative(df: DataFrame, key: str, weight, name: str = "cum") -> DataFrame:
    """``(key, name)`` with the inclusive running sum of ``weight`` in key order."""
    rows, offsets, _, _ = _ranged(df, key, weight)
    inner = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(offsets, "_range").select(key, (F.col("_off") + F.sum("_w").over(inner)).alias(name))


def _locate(starts: np.ndarray, ranges: np.ndarray):
    """Draws -> the range whose interval holds the target."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.column(1).to_numpy(zero_copy_only=False)
            at = np.maximum(np.searchsorted(starts, t, side="right") - 1, 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ranges[at])], names=[*batch.schema.names, "_range"])
    return run


def _look_up(name: str):
    """One range, one share of its draws -> the drawn ids. Null if the target
    lies past the end."""
    def run(key: tuple, rows: pa.Table, draws: pa.Table) -> pa.Table:
        ids, w = rows.column("_key").to_numpy(), rows.column("_w").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, w = ids[order], w[order]
        ends = (rows.column("_off")[0].as_py() if len(ids) else 0.0) + np.cumsum(w)
        t = draws.column("_t").to_numpy()
        at = np.searchsorted(ends, t, side="right")
        found = pa.array(ids[np.minimum(at, max(0, len(ids) - 1))] if len(ids) else np.zeros(len(t), np.int64),
                         pa.int64(), mask=at >= len(ids))
        return pa.table([draws.column("_draw"), found], names=["_draw", name])
    return run


def sample_by_weight(df: DataFrame, key: str, weight, draws: DataFrame, *,
                     draw: str = "draw", u: str = "u", name: str | None = None) -> DataFrame:
    """For each draw ``(draw, u)`` the first ``key`` whose
    cumulative weight exceeds ``u * total``. Returns ``(draw, name)``.

    Draws find their range in the sorted range starts (a few numbers for
    each 100,000 rows) without a shuffle. In a range they are dealt out over
    salts by their number, each with a copy of the range, so a heavy id that
    attracts all draws is looked up by many tasks; no draw x row pairs form."""
    name = name or key
    if df.schema[key].dataType.simpleString() not in ("bigint", "int"):
        raise TypeError("sample_by_weight draws integer ids")
    rows, offsets, total, last = _ranged(df, key, weight)
    t = draws.select(F.col(draw).cast("bigint").alias("_draw"), (F.col(u) * F.lit(total)).alias("_t"))
    offsets = stored(offsets, "range-offsets")
    starts = offsets.where(F.col("_tot") > 0).orderBy("_off", "_range").select("_off", "_range").toArrow()
    if not starts.num_rows:
        return draws.select(draw, F.lit(None).cast("bigint").alias(name))
    run = _locate(starts.column("_off").to_numpy(), starts.column("_range").to_numpy())
    located = stored(t.mapInArrow(run, "_draw long, _t double, _range long"), "draws")
    wanted = located.groupBy("_range").agg(F.ceil(F.count(F.lit(1)) / F.lit(RANGE_DRAWS)).cast("int").alias("_salts"))
    copies = (rows.where(F.col("_w") > 0).join(wanted.join(offsets, "_range"), "_range")
              .select("_range", F.col(key).cast("bigint").alias("_key"), "_w", "_off",
                      F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt")))
    # one row for each range of RANGE_ROWS rows that a draw falls into
    few = starts.num_rows <= BROADCAST_RANGES
    dealt = located.join(F.broadcast(wanted) if few else wanted, "_range").select(
        "_range", "_draw", "_t", F.pmod(F.xxhash64("_draw"), F.col("_salts")).cast("int").alias("_salt"))
    found = copies.groupBy("_range", "_salt").cogroup(dealt.groupBy("_range", "_salt")).applyInArrow(
        _look_up("_found"), "_draw long, _found long")
    return found.select(F.col("_draw").cast(draws.schema[draw].dataType).alias(draw),
                        F.coalesce("_found", F.lit(last)).cast("bigint").alias(name))


def weight_stats(df: DataFrame | None, key: str, weight) -> list:
    """The aggregate expressions ``sample_one`` needs: id range, total weight
    and the last id of non-zero weight (fold them into another action)."""
    w = F.col(weight) if isinstance(weight, str) else weight
    return [F.min(key), F.max(key), F.sum(w), F.max(F.when(w != 0, F.col(key)))]


def _first_above(rows: list, offset: float, target: float):
    """(first row, by id, whose running weight exceeds the target; the sum so far)."""
    for row in sorted(rows):
        offset += row["_w"]
        if offset > target:
            return row, offset
    return None, offset


def sample_one(df: DataFrame, key: str, weight, u: float, *, value: str | None = None,
               stats: tuple | None = None, unique: bool = False):
    """One draw as driver scalars: the first id whose cumulative weight
    exceeds ``u * total``. Returns ``(id, value_of_id)`` when ``value`` names a
    column, else the id; ``None`` ids when the total weight is 0.

    The id range is narrowed step by step: one partial aggregate gives the
    weight, count and id bounds of at most ``BINS`` equal bins, and the bin
    that holds the target is cut again from its own bounds, until it has at
    most ``LAST_ROWS`` rows, which are summed in order. Ids with large gaps
    only take another step; with ``unique`` ids a range of at most
    ``LAST_ROWS`` ids is summed at once. ``stats`` = (min id, max id, total, last non-zero
    id) may come from an earlier action (see ``weight_stats``)."""
    w = F.col(weight) if isinstance(weight, str) else weight
    lo, hi, total, last = stats if stats is not None else df.agg(*weight_stats(df, key, weight)).first()
    if lo is None or not total:
        return (None, None) if value else None
    target, offset = float(u) * float(total), 0.0
    base = df.select(F.col(key).alias("_key"), w.alias("_w"), *([F.col(value).alias("_v")] if value else []))
    chosen = None
    while lo is not None:
        if lo == hi:        # one id, however many rows it has
            chosen = base.where(F.col("_key") == F.lit(lo)).first()
            break
        if unique and hi - lo < LAST_ROWS:
            chosen, offset = _first_above(base.where(F.col("_key").between(lo, hi)).collect(), offset, target)
            break
        width = max(1, -(-(hi - lo + 1) // BINS))
        scope = base.where(F.col("_key").between(lo, hi))
        bins = scope.groupBy(F.floor((F.col("_key") - F.lit(lo)) / F.lit(width)).alias("_bin")).agg(
            F.sum("_w"), F.count(F.lit(1)), F.min("_key"), F.max("_key")).collect()
        lo = None
        for _, s, n, first, final in sorted(bins):
            if offset + s > target:
                lo, hi, rows = first, final, n
                break
            offset += s
        if lo is not None and rows <= LAST_ROWS:
            chosen, offset = _first_above(base.where(F.col("_key").between(lo, hi)).collect(), offset, target)
            break
    if chosen is None:  # rounding overshoot past the end: last id of non-zero weight
        chosen = base.where(F.col("_key") == F.lit(last)).first()
    return (int(chosen["_key"]), float(chosen["_v"])) if value else int(chosen["_key"])


def race_key(seed, key: Column, weight: Column) -> Column:
    """Exponential race: -ln(1 - u) / weight with the seeded uniform u of
    (seed, key); the least one wins with probability weight / total. Null
    where the weight is 0, so such an id never wins."""
    return F.when(weight > 0, -F.log1p(-S.seeded_uniform(seed, key)) / weight)


def race_winner(seed, key: str, weight: Column, *values: str) -> Column:
    """One draw as an aggregate expression, to be folded into an action that
    reads the table anyway: struct (race, key, values...) of the winner."""
    race = race_key(F.lit(seed), F.col(key), weight)
    return F.min(F.when(race.isNotNull(), F.struct(race.alias("race"), key, *values)))


def _race_rows(rows: DataFrame, seed: int, draws: list[int], limit: float) -> DataFrame:
    """(_draw, _key, race) of every row (_key, _w) whose race may be at most
    ``limit``. A row's bound on the uniform is worked out once, so a draw costs
    it one hash and one comparison of text; few rows go on to the race."""
    top = S.hash_bound(1 - F.exp(-F.lit(limit) * F.col("_w")))
    tags = F.array(*[F.struct(F.lit(k).cast("bigint").alias("_draw"), F.lit(f"{seed}:{k}").alias("_seed")) for k in draws])
    each = rows.select("_key", "_w", top.alias("_top"), S.seeded_text(F.col("_key")).alias("_text"), F.inline(tags))
    near = each.where(F.md5(F.concat("_seed", "_text")) <= F.col("_top"))
    return near.select("_draw", "_key", race_key(F.col("_seed"), F.col("_key"), F.col("_w")).alias("race"))


def race_draws(df: DataFrame, key: str, weight, seed: int, draws: int, name: str | None = None) -> DataFrame:
    """L1 / L2: ``(draw, name)`` for draws 0 .. draws-1, each drawn by
    ``race_winner`` with the seed ``seed:draw``; no cumulative sums or order.

    The least race of a draw is about 1 / total. Only rows that can stay below
    ``RACE_LEFT`` times that are raced, and a winner counts if it does, as then
    no other row can be less; a draw left without one (a chance of
    exp(-RACE_LEFT)) races all rows."""
    w = F.col(weight) if isinstance(weight, str) else weight
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = stored(df.select(F.col(key).alias("_key"), w.cast("double").alias("_w")).where("_w > 0").repartition(parts), "race")
    total = rows.agg(F.sum("_w")).first()[0]
    won, left = {}, list(range(draws))
    limits = [] if total is None else [RACE_LEFT / total, math.inf] if 0 < total < math.inf else [math.inf]
    for limit in limits:
        if left:
            best = _race_rows(rows, seed, left, limit).groupBy("_draw").agg(F.min(F.struct("race", "_key")).alias("b"))
            won |= {r["_draw"]: r["b"]["_key"] for r in best.collect()       # one row a draw
                    if limit == math.inf or r["b"]["race"] <= limit}
            left = [k for k in left if k not in won]
    kinds = T.StructType([T.StructField("draw", T.LongType()), T.StructField(name or key, df.schema[key].dataType)])
    return spark.createDataFrame([(k, won.get(k)) for k in range(draws)], kinds)


def running_mean(trace: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Running mean of ``value`` in ``order`` (trace tables have one row
    per iteration)."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return trace.withColumn(name, F.avg(value).over(w))
