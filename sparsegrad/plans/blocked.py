"""Scores and gradients for models whose weight vector is too large to broadcast.

Entries are placed once. A block is a range of ``block_size`` feature ids, cut
into parts by row so that a block with hot features is spread over tasks. A
(block, part) cell is one packed, cached record with dictionaries of its own:
its distinct rows, its distinct ids in order, and for each entry a place in
both. A routing table, made from the dictionaries and cached by ranges of
``CHUNK`` ids, says which cells use which ids. In an iteration only

* weights move to the routing table, in chunks;
* a cell is sent the weights of the ids that it holds and no others, in the
  order of its dictionary (8 bytes for each distinct (cell, id) pair);
* a cell sends one partial score for each of its rows,
* and gets one coefficient for each of its rows back.

Partial scores and coefficients travel packed: rows are dealt to groups by a hash
of their id, a record holds the values of the rows that a cell and a group share,
and a cached table of the groups says which rows these are. So the records of an
iteration are the rows and the (cell, group) pairs, not the (cell, row) pairs.

The gradient is summed inside the cells. Entries and dictionaries never move
again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Feature ids of a block and entries of a cell, on average.
BLOCK_SIZE = 1_000_000
CELL_ENTRIES = 1_000_000
#: Feature ids of one record of the routing table, at most.
CHUNK = 4096

CELL = "cell long, block long, rid array<long>, id array<int>, r array<int>, i array<int>, val array<double>"
GROUP = "group int, rid array<long>, cells array<long>, n array<int>, at array<int>"


class FeatureBlocks:
    """Sparse rows (rid unique, features) placed by feature block. ``rows``
    arguments of the methods hold ``rid`` and what the coefficient reads."""

    def __init__(self, rows: DataFrame, d: int, block_size: int = BLOCK_SIZE, cell_entries: int = CELL_ENTRIES):
        spark = rows.sparkSession
        self.block_size, self.d = block_size, d
        self.chunk = min(CHUNK, block_size)
        self._held: DataFrame | None = None
        entries = rows.select("rid", F.inline("features")).withColumn(
            "block", F.floor((F.col("idx") - 1) / F.lit(block_size)))
        counts = entries.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
        # D / block_size rows
        parts = counts.select("block", "n", F.ceil(F.col("n") / F.lit(cell_entries)).cast("int").alias("parts")).persist(
            StorageLevel.MEMORY_AND_DISK)
        held = int(parts.agg(F.sum("n")).first()[0] or 0)
        self.n_groups = max(4 * spark.sparkContext.defaultParallelism, -(-held // cell_entries))
        placed = entries.join(F.broadcast(parts.drop("n")), "block").withColumn(
            "part", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int"))
        offset = (F.col("idx") - 1 - F.col("block") * F.lit(block_size)).cast("int")
        cells = placed.groupBy("block", "part").agg(F.collect_list(F.struct("rid", offset.alias("o"), "val")).alias("e"))
        ensure_checkpoint_dir(spark)
        n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        packed = cells.select("block", "part", F.col("e.rid"), F.col("e.o"), F.col("e.val")).mapInArrow(_pack, CELL)
        # partitioned by a column of their own, so later joins leave them where they are
        self.cells = packed.withColumn("g", F.transform("rid", self._group_of)).repartition(n, "cell").persist(
            StorageLevel.MEMORY_AND_DISK)
        self.cells.count()
        parts.unpersist()
        self.routes = self.cells.select("cell", "block", "id").mapInArrow(
            _routes(self.chunk, -(-block_size // self.chunk)), "chunk long, cell long, first int, at array<int>") \
            .repartition(n, "chunk").persist(StorageLevel.MEMORY_AND_DISK)
        self.routes.count()
        members = self.cells.select("cell", "rid", "g").mapInArrow(_members, "group int, cell long, rid array<long>")
        self.groups = members.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("cell", "rid"))).alias("x")).select(
            "group", F.col("x.cell"), F.col("x.rid")).mapInArrow(_grouped, GROUP).repartition(n, "group").persist(
            StorageLevel.MEMORY_AND_DISK)
        self.groups.count()

    def release(self) -> None:
        for df in (self.cells, self.routes, self.groups, self._held):
            if df is not None:
                df.unpersist()
        self._held = None

    def _chunk_of(self, idx: Column) -> Column:
        """Chunks are numbered inside their block, which need not be a multiple of them."""
        block = F.floor((idx - 1) / F.lit(self.block_size))
        inside = F.floor((idx - 1 - block * F.lit(self.block_size)) / F.lit(self.chunk))
        return block * F.lit(-(-self.block_size // self.chunk)) + inside

    def _group_of(self, rid: Column) -> Column:
        return F.pmod(F.xxhash64(rid), F.lit(self.n_groups)).cast("int")

    def routed(self, weights: DataFrame) -> DataFrame:
        """(cell, w): the weights of the cell's own ids, in their order."""
        chunks = weights.select(self._chunk_of(F.col("idx")).alias("chunk"), F.struct("idx", "w").alias("x")) \
            .groupBy("chunk").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["w"]).alias("w"))
        used = self.routes.join(chunks, "chunk").select(
            "cell", F.struct("first", F.transform("at", lambda k: F.get("w", k)).alias("w")).alias("x"))
        return used.groupBy("cell").agg(
            F.flatten(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["w"])).alias("w"))

    def _partial(self, weights: DataFrame) -> DataFrame:
        return self.cells.join(self.routed(weights), "cell").select("cell", "rid", "g", "r", "i", "val", "w").mapInArrow(
            _partial_scores, "group int, cell long, s array<double>")

    def scores(self, rows: DataFrame, weights: DataFrame, b: float) -> DataFrame:
        """``rows`` with ``score``. ``weights`` holds every id 1..D once."""
        sent = self._partial(weights).groupBy("group").agg(F.collect_list(F.struct("cell", "s")).alias("got"))
        seen = self.groups.join(sent, "group").select("rid", "cells", "n", "at", "got").mapInArrow(_row_scores, "rid long, s double")
        total = F.coalesce("s", F.lit(0.0)) + F.lit(float(b))
        return rows.join(seen, "rid", "left").withColumn("score", total).drop("s")

    def _coefficients(self, rows: DataFrame, weights: DataFrame, b: float, coef: Callable[[], Column], weight: str | None):
        """(rid, c, f) held until the next call: it is read twice."""
        if self._held is not None:
            self._held.unpersist()
        c = self.scores(rows, weights, b).withColumn("c", coef())
        factor = F.col("c") * F.col(weight) if weight else F.col("c")
        self._held = c.select("rid", "c", factor.alias("f")).persist(StorageLevel.MEMORY_AND_DISK)
        return self._held

    def _back(self, c: DataFrame) -> DataFrame:
        """Cells with the factors of their rows."""
        rows = c.where("rid IS NOT NULL").groupBy(self._group_of(F.col("rid")).alias("group")).agg(
            F.collect_list(F.struct("rid", "f")).alias("back"))
        sent = self.groups.join(rows, "group").select("group", "rid", "cells", "n", "at", "back").mapInArrow(
            _group_factors, "cell long, group int, f array<double>")
        sent = sent.groupBy("cell").agg(F.collect_list(F.struct("group", "f")).alias("back"))
        return self.cells.join(sent, "cell").select("block", "rid", "g", "id", "r", "i", "val", "back")

    def gradient(self, rows: DataFrame, weights: DataFrame, b: float, coef: Callable[[], Column],
                 weight: str | None = None) -> DataFrame:
        """(idx, g) with the bias part at idx 0, over ``rows`` (rid, y and the
        weight column): the active rows if some are filtered out. Valid until
        the next call or ``release``; after that it is worked out anew."""
        c = self._coefficients(rows, weights, b, coef, weight)
        sums = self._back(c).mapInArrow(_cell_sums(self.block_size), "idx long, g double")
        bias = c.agg(F.sum("c").alias("g")).where(F.col("g").isNotNull()).select(F.lit(0).cast("bigint").alias("idx"), "g")
        return sums.groupBy("idx").agg(F.sum("g").alias("g")).unionByName(bias)

    def row_gradients(self, rows: DataFrame, weights: DataFrame, b: float, coef: Callable[[], Column],
                      weight: str | None = None, with_bias: bool = False) -> DataFrame:
        """(rid, idx, g): the gradient entries of each row, made where the
        entries lie; repeated ids of a row stay apart."""
        c = self._coefficients(rows, weights, b, coef, weight)
        out = self._back(c).mapInArrow(_cell_entries(self.block_size), "rid long, idx long, g double")
        if with_bias:
            out = out.unionByName(c.select("rid", F.lit(0).cast("bigint").alias("idx"), F.col("c").alias("g")))
        return out


def _lists(batch: pa.RecordBatch, *names: str) -> Iterator[list[np.ndarray]]:
    """For each record the arrays of some list columns."""
    return zip(*[[x.values.to_numpy(zero_copy_only=False) for x in batch.column(n)] for n in names])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells with dictionaries: distinct rows and ids, and places in them."""
    for batch in batches:
        for block, part, (rid, o, val) in zip(batch.column("block"), batch.column("part"), _lists(batch, "rid", "o", "val")):
            rows, r = np.unique(rid, return_inverse=True)
            ids, i = np.unique(o, return_inverse=True)
            cell = block.as_py() << 32 | part.as_py()
            one = lambda x, kind: pa.array([x.astype(kind)])
            yield pa.RecordBatch.from_arrays(
                [pa.array([cell]), pa.array([block.as_py()]), one(rows, np.int64), one(ids, np.int32), one(r, np.int32),
                 one(i, np.int32), one(val, np.float64)], names=["cell", "block", "rid", "id", "r", "i", "val"])


def _routes(chunk: int, chunks: int):
    """A cell's ids, one record for each chunk of ids that it touches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, block, (ids,) in zip(batch.column("cell"), batch.column("block"), _lists(batch, "id")):
                which, first = np.unique(ids // chunk, return_index=True)
                at = [x.astype(np.int32) for x in np.split(ids % chunk, first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(which.astype(np.int64) + block.as_py() * chunks), pa.array(np.full(len(which), cell.as_py())),
                     pa.array(first.astype(np.int32)), pa.array(at, pa.list_(pa.int32()))], names=["chunk", "cell", "first", "at"])
    return run


def _runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places first..first + n - 1 of each run, one run after the other."""
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


def _dealt(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by group, groups, offsets of the groups in that order)."""
    order = np.argsort(g, kind="stable")
    groups, first = np.unique(g[order], return_index=True)
    return order, groups, np.append(first, len(g)).astype(np.int32)


def _to_groups(cell: int, g: np.ndarray, x: np.ndarray, name: str) -> pa.RecordBatch:
    """A cell's values of its rows, one record for each group."""
    order, groups, offsets = _dealt(g)
    return pa.RecordBatch.from_arrays(
        [pa.array(groups.astype(np.int32)), pa.array(np.full(len(groups), cell)),
         pa.ListArray.from_arrays(pa.array(offsets), pa.array(x[order]))], names=["group", "cell", name])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cell, (rid, g) in zip(batch.column("cell"), _lists(batch, "rid", "g")):
            yield _to_groups(cell.as_py(), g, rid, "rid")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups: distinct rows; by cell, how many of them it holds and which."""
    for batch in batches:
        for k, (cells,) in enumerate(_lists(batch, "cell")):
            held = batch.column("rid")[k].values
            rows, at = np.unique(held.flatten().to_numpy(), return_inverse=True)
            one = lambda x, kind: pa.array([x.astype(kind)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("group").slice(k, 1), one(rows, np.int64), one(cells, np.int64),
                 one(held.value_lengths().to_numpy(), np.int32), one(at, np.int32)], names=["group", "rid", "cells", "n", "at"])


def _partial_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cell, (rid, g, r, i, val, w) in zip(batch.column("cell"), _lists(batch, "rid", "g", "r", "i", "val", "w")):
            yield _to_groups(cell.as_py(), g, np.bincount(r, w[i] * val, len(rid)), "s")


def _row_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores of the rows of a group; every cell of the group has sent its part."""
    for batch in batches:
        for k, (rid, cells, n, at) in enumerate(_lists(batch, "rid", "cells", "n", "at")):
            got = batch.column("got")[k].values
            which = np.searchsorted(cells, got.field("cell").to_numpy())
            s = np.empty(len(at))
            s[_runs((np.cumsum(n) - n)[which], n[which])] = got.field("s").flatten().to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(np.bincount(at, s, len(rid)))], names=["rid", "s"])


def _group_factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The factors of a group's rows, for each cell that holds active ones;
    null for rows that are not active."""
    for batch in batches:
        for k, (rid, cells, n, at) in enumerate(_lists(batch, "rid", "cells", "n", "at")):
            back = batch.column("back")[k].values
            ids, f = back.field("rid").to_numpy(), back.field("f").to_numpy()
            to = np.minimum(np.searchsorted(rid, ids), len(rid) - 1)
            known = rid[to] == ids          # rows without entries have no cell
            factor, active = np.zeros(len(rid)), np.zeros(len(rid), bool)
            factor[to[known]], active[to[known]] = f[known], True
            first = np.cumsum(n) - n
            out = pa.RecordBatch.from_arrays(
                [pa.array(cells), pa.array(np.full(len(cells), batch.column("group")[k].as_py(), np.int32)),
                 pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), pa.array(factor[at], mask=~active[at]))],
                names=["cell", "group", "f"])
            yield out.filter(pa.array(np.add.reduceat(active[at].astype(np.int32), first) > 0))


def _factors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each cell (factor of each of its rows, whether it is active); rows
    that are not active count as 0."""
    for k, (g,) in enumerate(_lists(batch, "g")):
        back = batch.column("back")[k].values
        order, groups, offsets = _dealt(g)
        f = back.field("f").flatten()
        which = np.searchsorted(groups, back.field("group").to_numpy())
        to = order[_runs(offsets[which], offsets[which + 1] - offsets[which])]
        out, active = np.zeros(len(g)), np.zeros(len(g), bool)
        active[to] = f.is_valid().to_numpy(zero_copy_only=False)
        out[to] = f.fill_null(0.0).to_numpy(zero_copy_only=False)
        yield out, active


def _cell_sums(block_size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, (f, _), (ids, r, i, val) in zip(batch.column("block"), _factors(batch), _lists(batch, "id", "r", "i", "val")):
                g = np.bincount(i, f[r] * val, len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64) + 1 + block.as_py() * block_size), pa.array(g)],
                                                 names=["idx", "g"])
    return run


def _cell_entries(block_size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = zip(batch.column("block"), _factors(batch), _lists(batch, "rid", "id", "r", "i", "val"))
            for block, (f, on), (rid, ids, r, i, val) in cells:
                active = on[r]
                idx = ids[i].astype(np.int64) + 1 + block.as_py() * block_size
                yield pa.RecordBatch.from_arrays([pa.array(x[active]) for x in (rid[r], idx, f[r] * val)], names=["rid", "idx", "g"])
    return run
