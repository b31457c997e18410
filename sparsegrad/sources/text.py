"""Text sources: scan labelled sparse lines and parse them into rows.

Row layout produced here (and used by every operator):

    row_id   BIGINT                                  (indexed lines, or assigned)
    y        DOUBLE                                  label, +1/-1 by convention
    features ARRAY<STRUCT<idx: BIGINT, val: DOUBLE>> 1-based feature ids, file order

Line grammar (tokens separated by one or more spaces):

    indexed:    row_id label idx:val idx:val ...
    plain:      label idx:val idx:val ...
    positional: label any:val any:val ...   (the first D values, ids ignored)

Parsing stops at the first token without ':'; the rest of the line is
ignored. A third ':' part of a token is ignored. Ids may be unsorted and may
repeat, and must be >= 1. A line with no token after the label is an error.

The parse is built from SQL expressions (split / slice / transform) next to
the scan. Text that is not a number raises whatever the session's ANSI mode."""

from __future__ import annotations

import re

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

FEATURE_TYPE = T.ArrayType(T.StructType([
    T.StructField("idx", T.LongType()),
    T.StructField("val", T.DoubleType()),
]))


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text line scan (local or distributed file system): one ``value`` row per line."""
    return spark.read.text(path)


def _tokens(value: Column) -> Column:
    return F.split(F.trim(value), " +")


def _number(token: Column, kind: str) -> Column:
    """The token as a number; anything else raises."""
    return F.coalesce(token.try_cast(kind), F.raise_error(F.concat(F.lit("not a number: "), F.coalesce(token, F.lit("nothing")))).cast(kind))


def _sparse_features(tokens_after_label: Column) -> Column:
    """Feature tokens up to (excluding) the first token without ':'."""
    has_colon = F.transform(tokens_after_label, lambda t: F.contains(t, F.lit(":")))
    stop = F.array_position(has_colon, F.lit(False))
    kept = F.when(stop == 0, tokens_after_label).otherwise(
        F.slice(tokens_after_label, F.lit(1), (stop - 1).cast("int")))

    def to_struct(t):
        parts = F.split(t, ":")
        idx = _number(F.get(parts, 0), "bigint")
        # ids are 1-based (id 0 is where the trainers keep the bias)
        idx = F.when(idx >= 1, idx).otherwise(F.raise_error(F.lit("feature id must be >= 1")))
        return F.struct(idx.alias("idx"), _number(F.get(parts, 1), "double").alias("val"))

    return F.transform(kept, to_struct)


def _require(cond: Column, msg: str, value: Column) -> Column:
    return F.when(cond, value).otherwise(F.raise_error(F.lit(msg)))


def parse_indexed(lines: DataFrame, value: str = "value", keep: list[str] | None = None) -> DataFrame:
    """Parse ``row_id label idx:val ...`` lines."""
    tok = _tokens(F.col(value))
    keep_cols = [F.col(c) for c in (keep or [])]
    parsed = lines.select(*keep_cols, tok.alias("_tok"))
    ok = F.size("_tok") >= 3
    return parsed.select(
        *keep_cols,
        _number(_require(ok, "line has no token after the label", F.get("_tok", F.lit(0))), "bigint").alias("row_id"),
        _number(F.get("_tok", F.lit(1)), "double").alias("y"),
        _sparse_features(F.slice("_tok", 3, F.greatest(F.size("_tok") - 2, F.lit(0)))).alias("features"),
    )


def parse_plain(lines: DataFrame, value: str = "value", keep: list[str] | None = None) -> DataFrame:
    """Parse ``label idx:val ...`` lines (no row id)."""
    tok = _tokens(F.col(value))
    keep_cols = [F.col(c) for c in (keep or [])]
    parsed = lines.select(*keep_cols, tok.alias("_tok"))
    ok = F.size("_tok") >= 2
    return parsed.select(
        *keep_cols,
        _number(_require(ok, "line has no token after the label", F.get("_tok", F.lit(0))), "double").alias("y"),
        _sparse_features(F.slice("_tok", 2, F.greatest(F.size("_tok") - 1, F.lit(0)))).alias("features"),
    )


def parse_positional(lines: DataFrame, d: int, value: str = "value",
                     keep: list[str] | None = None) -> DataFrame:
    """Parse the first ``d`` values after the label into a dense ``x``; the
    id before ':' is ignored. Fewer than ``d`` values is an error."""
    tok = _tokens(F.col(value))
    keep_cols = [F.col(c) for c in (keep or [])]
    parsed = lines.select(*keep_cols, tok.alias("_tok"))
    ok = F.size("_tok") >= d + 1
    vals = F.transform(F.slice("_tok", 2, d), lambda t: _number(F.get(F.split(t, ":"), 1), "double"))
    return parsed.select(
        *keep_cols,
        _number(_require(ok, f"line has fewer than {d} values", F.get("_tok", F.lit(0))), "double").alias("y"),
        vals.alias("x"),
    )


#: Values of one output batch of the dense scatter (16 MB of doubles).
SCATTER_VALUES = 1 << 21


def _scatter_last_wins(d: int):
    """Scatter of sparse lists into dense length-d rows, a slice of bounded
    size at a time; for a repeated id the last value in the line wins."""
    step = max(1, SCATTER_VALUES // max(1, d))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                lists = batch.column(batch.num_columns - 1)
                flat = lists.flatten()
                idx = flat.field("idx").to_numpy(zero_copy_only=False)
                if len(idx) and (idx.min() < 1 or idx.max() > d):
                    raise ValueError(f"feature id outside 1..{d}")
                counts = lists.value_lengths().to_numpy(zero_copy_only=False)
                place = np.repeat(np.arange(batch.num_rows), counts) * d + (idx - 1)
                # the last of equal places is the first in reversed order
                places, last = np.unique(place[::-1], return_index=True)
                dense = np.zeros(batch.num_rows * d)
                dense[places] = flat.field("val").to_numpy(zero_copy_only=False)[::-1][last]
                x = pa.ListArray.from_arrays(np.arange(0, len(dense) + 1, d, dtype=np.int32) if d else
                                             np.zeros(batch.num_rows + 1, np.int32), dense)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], x], names=[*batch.schema.names[:-1], "x"])

    return run


def _slices_last_wins(d: int, size: int):
    """As ``_scatter_last_wins``, for the slices that hold a stored value."""
    slices = -(-d // size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            flat = lists.flatten()
            idx = flat.field("idx").to_numpy(zero_copy_only=False)
            if not len(idx):
                continue
            if idx.min() < 1 or idx.max() > d:
                raise ValueError(f"feature id outside 1..{d}")
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            place = np.repeat(np.arange(batch.num_rows), counts) * (slices * size) + (idx - 1)
            # the last of equal places is the first in reversed order
            places, last = np.unique(place[::-1], return_index=True)
            values = flat.field("val").to_numpy(zero_copy_only=False)[::-1][last]
            held, first = np.unique(places // size, return_index=True)
            ends = np.append(first[1:], len(places))
            step = max(1, SCATTER_VALUES // size)
            for a in range(0, len(held), step):
                some = held[a:a + step]
                mine = slice(first[a], ends[a + len(some) - 1])
                dense = np.zeros((len(some), size))
                dense[np.searchsorted(some, places[mine] // size), places[mine] % size] = values[mine]
                start = some % slices * size
                length = np.minimum(size, d - start)
                x = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(length)]).astype(np.int32),
                                             dense[np.arange(size) < length[:, None]])
                row = pa.array(some // slices)
                yield pa.RecordBatch.from_arrays([*[c.take(row) for c in batch.columns[:-1]], pa.array(start + 1), x],
                                                 names=[*batch.schema.names[:-1], "first", "x"])

    return run


def parse_dense_last_wins(lines: DataFrame, d: int, value: str = "value", keep: list[str] | None = None,
                          slice_values: int | None = None) -> DataFrame:
    """Parse ``label idx:val ...`` into a dense ``x`` of length ``d``; for a
    repeated id the last value wins. The scatter has no SQL form that is
    linear in ``d``; it runs on Arrow batches, its output cut into slices.

    Whole vectors are N x ``d`` values, which grows with the square of a table
    whose features grow with its rows. With ``slice_values`` a vector comes as
    dense slices of that many values, the first of which has the id ``first``;
    slices without a stored value are all zero and are not written, so the
    output grows with the stored values. A line without features has none."""
    sparse = parse_plain(lines, value=value, keep=keep)
    x = T.StructField("x", T.ArrayType(T.DoubleType()))
    if slice_values is None:
        return sparse.mapInArrow(_scatter_last_wins(d), T.StructType([*sparse.schema.fields[:-1], x]))
    schema = T.StructType([*sparse.schema.fields[:-1], T.StructField("first", T.LongType()), x])
    return sparse.mapInArrow(_slices_last_wins(d, slice_values), schema)


#: Splits (with their file names) that may be broadcast.
BROADCAST_SPLITS = 50_000


def with_line_ids(df: DataFrame, start: int = 1, name: str = "row_id") -> DataFrame:
    """Stable consecutive ids in file order (for plain lines, which carry no
    id), computed JVM-side with one scan of the input and no global sort:

    1. the lines are written once to the shared folder, each with (file, block
       start, ``monotonically_increasing_id``); the last one is (partition <<
       33) + position, so a segment = one (file, block, partition) holds
       consecutive ids;
    2. the split index: rows per segment, from the narrow columns of that copy
       (one row per input split), with exclusive running offsets in (file,
       block) order;
    3. the copy joined with the index, by broadcast up to ``BROADCAST_SPLITS``
       splits.

    Ids and lines come from the same copy, so they agree however often a task
    is run again. For a DataFrame that is not a file scan the order is the
    partition order."""
    tagged = stored(df.select("*", F.input_file_name().alias("_file"), F.input_file_block_start().alias("_blk"),
                              F.monotonically_increasing_id().alias("_mid")), "lines")
    tagged = tagged.withColumn("_part", F.shiftright("_mid", 33))
    keys = ["_file", "_blk", "_part"]
    segs = tagged.groupBy(*keys).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    index = stored(segs.select(*keys, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")), "split-index")
    side = F.broadcast(index) if index.count() <= BROADCAST_SPLITS else index
    return tagged.join(side, keys).select(
        (F.col("_off") + F.col("_mid") - F.col("_first") + F.lit(start)).alias(name), *df.columns)


def dense_to_sparse(rows: DataFrame, x: str = "x", keep_zeros: bool = True) -> DataFrame:
    """Dense ``x`` (ARRAY<DOUBLE>) to the sparse ``features`` layout, ids 1..D."""
    feats = F.transform(F.col(x), lambda v, i: F.struct((i + 1).cast("bigint").alias("idx"),
                                                        v.cast("double").alias("val")))
    if not keep_zeros:
        feats = F.filter(feats, lambda f: f["val"] != 0)
    return rows.withColumn("features", feats).drop(x)


# Rough in-memory bytes of a cached row: id, label and array header, plus
# (idx, val) per stored entry.
ROW_BYTES, ENTRY_BYTES = 48, 16


def sized_partitions(spark: SparkSession, n_rows: int, n_entries: int) -> int:
    """Partition count that keeps each cached partition near Spark's advisory
    partition size (``spark.sql.adaptive.advisoryPartitionSizeInBytes``), and
    never fewer partitions than the session's parallelism."""
    target = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64MB")
    m = re.fullmatch(r"(\d+)\s*([kmgt]?)b?", target.strip().lower())
    unit = {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    target_bytes = int(m.group(1)) * unit[m.group(2)] if m else 64 << 20
    need = -(-(n_rows * ROW_BYTES + n_entries * ENTRY_BYTES) // target_bytes)
    return max(spark.sparkContext.defaultParallelism, int(need), 1)


def cache_points(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """Materialise parsed rows once for reuse by every pass: hash-partitioned
    and sorted by ``row_id`` so per-row state (a ``p`` table partitioned the
    same way) zips with it without a shuffle, then persisted in memory with
    spill to disk.

    Without ``partitions`` the count is sized from the data (one counting
    pass that keeps nothing), so a partition stays near the advisory size at
    any scale. Only trainers with a per-row state need this layout."""
    if partitions is None:
        n_rows, n_entries = rows.agg(F.count(F.lit(1)), F.sum(F.size("features"))).first()
        partitions = sized_partitions(rows.sparkSession, int(n_rows or 0), int(n_entries or 0))
    out = rows.repartition(partitions, "row_id").sortWithinPartitions("row_id")
    return out.persist(StorageLevel.MEMORY_AND_DISK)


def render_indexed(rows: DataFrame) -> DataFrame:
    """Inverse of ``parse_indexed``: rows to ``value`` lines."""
    toks = F.transform("features", lambda f: F.concat(f["idx"].cast("string"), F.lit(":"),
                                                      f["val"].cast("string")))
    return rows.select(F.concat_ws(" ", F.col("row_id").cast("string"), F.col("y").cast("string"),
                                   toks).alias("value"))


def render_plain(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Inverse of ``parse_plain``: rows to ``value`` lines."""
    toks = F.transform("features", lambda f: F.concat(f["idx"].cast("string"), F.lit(":"),
                                                      f["val"].cast("string")))
    return rows.select(*(keep or []), F.concat_ws(" ", F.col("y").cast("string"), toks).alias("value"))
