"""Join strategies with explicit size and skew checks.

* ``lookup_join``: attach a keyed lookup table (e.g. the weight table
  ``(idx, w)``) to a large table. The lookup side is broadcast only after its
  row count is checked against ``max_broadcast_rows``; beyond that the join is
  a shuffle join whose hot keys are split off first (``skew_split_join``).
* ``skew_split_join``: a key may hold a third of all rows. Keys above a
  per-partition share are found with a partial aggregate (output bounded by
  the number of hot keys), joined by broadcasting just their lookup rows, and
  only the cold keys go through the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

# A hashed relation of (bigint, double) rows takes about 100 bytes a row.
DEFAULT_MAX_BROADCAST_ROWS = 1_000_000
# A key is hot when it holds more than 1/(HOT_SHARE * partitions) of the rows.
HOT_SHARE = 4


def _shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def lookup_join(big: DataFrame, lookup: DataFrame, key: str, how: str = "left", *,
                lookup_rows: int | None = None, big_unique: bool = False,
                hot: DataFrame | None = None,
                max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Join ``lookup`` (unique on ``key``) onto ``big``.

    ``lookup_rows`` may be given when the size is known by construction (for
    example the dimension D of a weight table); otherwise it is counted.
    ``big_unique`` says ``big`` is unique on ``key`` too (weight table joined
    with a gradient): no key can be hot, so the skew check is skipped.
    ``hot`` is a precomputed hot-key table (see ``hot_keys``), reused across
    iterations over the same rows."""
    n = lookup_rows if lookup_rows is not None else lookup.count()
    if n <= max_broadcast_rows:
        return big.join(F.broadcast(lookup), key, how)
    if big_unique:
        return big.join(lookup, key, how)
    return skew_split_join(big, lookup, key, how, hot=hot)


def hot_keys(big: DataFrame, key: str) -> DataFrame:
    """Keys of ``big`` holding more than 1/(HOT_SHARE * partitions) of its
    rows, as a one-column table, empty if there are none. There are fewer than
    HOT_SHARE * partitions of them by construction, so the table is always
    small. A partial aggregate per task: a key holding a third of the rows
    costs one row per task."""
    counts = big.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = big.count()
    return counts.where(F.col("_n") > F.lit(total / (HOT_SHARE * _shuffle_partitions(big)))).select(key)


def skew_split_join(big: DataFrame, lookup: DataFrame, key: str, how: str = "left", *,
                    hot: DataFrame | None = None) -> DataFrame:
    """Shuffle join of ``big`` with a large ``lookup`` (unique on ``key``)
    that routes hot keys of ``big`` through a broadcast join: only the
    lookup rows of hot keys are broadcast (bounded by the hot-key count), the
    cold keys go through the shuffle (where AQE can still split a skewed
    partition)."""
    # written once: it is read four times, and a cached copy would have no owner to drop it
    hot_b = F.broadcast(stored(hot_keys(big, key), "hot-keys") if hot is None else hot)
    hot_part = big.join(hot_b, key, "left_semi").join(
        F.broadcast(lookup.join(hot_b, key, "left_semi")), key, how)
    cold_part = big.join(hot_b, key, "left_anti").join(
        lookup.join(hot_b, key, "left_anti"), key, how)
    return hot_part.unionByName(cold_part)
