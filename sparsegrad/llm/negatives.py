"""Hard negatives by an exact search in an inverted multi-index.

Vectors are quantised to whole numbers and scored by inner product. The two
halves of a vector have a codebook each; a pair of codewords is a cell. For an
anchor q, no row of codeword c with radius r (the largest distance of a row's
half from c) has a half score above ``q.c + |q| r``, so the sum of two half
bounds limits a cell. A multi-sequence heap visits cells in the order of that
sum, without listing all pairs, and stops when it falls below what the anchor
still needs: its 5th best row of the same label for positives, the 10th best
row inside each window for negatives. What is returned is exact, whatever
the codebooks are.

The index is cut into shards of whole cells (or parts of a large cell), and a
task searches one shard for one block of anchors. Each search first visits the
shard of the best cell; the scores found there decide which other shards can
still matter, and only those are visited.

Defined cases: rows with a null id, label or vector, or a component that is
null or not finite, take no part; vectors of different lengths are compared
as if the shorter ended in zeros; rows are told apart even if all their values
are equal, so a repeated row can be the positive or negative of its copy; ties
go to the smaller id; an anchor without another row of its label has no result;
an empty table gives an empty result; extra columns do not matter. Scores are
exact and must fit a long (beyond that the job fails).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored

#: Rows that the codebooks are fitted on, in hash order of the id; every row is indexed.
CODEBOOK_ROWS = 20_000
#: Rows of a cell, on average, until the codebooks have MOST_CODES words.
CELL_ROWS, MOST_CODES = 64, 64
SHARD_ROWS, ANCHOR_ROWS = 4096, 1024
#: Rows scored by one product.
VISIT_ROWS = 512

N_POSITIVES, N_NEGATIVES = 5, 10
#: 100 times a negative's score lies between these multiples of the positive's.
WINDOW = (30, 90)


# --------------------------------------------------------------------- index

def usable(vector: Column) -> Column:
    """True if the vector and all its components are there and finite."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, odd)


def quantised(vectors: pa.Array, dims: int) -> np.ndarray:
    """floor(256 x) of each component, padded with zeros to ``dims``."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    length = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(vectors), dims))
    out[np.arange(dims) < length[:, None]] = np.floor(256.0 * flat)
    return out


def unpacked(column, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dims)


def codebook(half: np.ndarray, codes: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """Lloyd's iterations from distinct rows of the sample."""
    if not half.size:
        return np.zeros((1, half.shape[1]))
    distinct = np.unique(half, axis=0)
    rng = np.random.default_rng(seed)
    words = distinct[rng.choice(len(distinct), min(codes, len(distinct)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(half, words)[0]
        count = np.bincount(near, minlength=len(words))
        total = np.zeros_like(words)
        for k in range(words.shape[1]):
            total[:, k] = np.bincount(near, half[:, k], len(words))
        words[count > 0] = total[count > 0] / count[count > 0, None]
    return words


def nearest(half: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword of each row and the distance to it."""
    apart = (words ** 2).sum(1) - 2 * half @ words.T
    near = apart.argmin(1)
    return near, np.sqrt(((half - words[near]) ** 2).sum(1))


@dataclass
class Codebooks:
    dims: int
    first: np.ndarray
    second: np.ndarray
    exact: bool              # inner products are exact in doubles

    @property
    def cut(self) -> int:
        return self.first.shape[1]

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Half scores of anchors against both codebooks, and their half norms."""
        a, b = q[:, :self.cut], q[:, self.cut:]
        return a @ self.first.T, b @ self.second.T, np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)


def _encode(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = quantised(batch.column("v"), books.dims)
            (i, r1), (j, r2) = nearest(x[:, :books.cut], books.first), nearest(x[:, books.cut:], books.second)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("uid", "id", "label", "anchor")],
                 pa.array([row.tobytes() for row in x], pa.binary()), pa.array(i * len(books.second) + j, pa.int32()),
                 pa.array(r1), pa.array(r2)], names=["uid", "id", "label", "anchor", "x", "cell", "r1", "r2"])

    return run, "uid long, id long, label long, anchor boolean, x binary, cell int, r1 double, r2 double"


@dataclass
class Cells:
    """The cells that hold rows: number, radii, and shards first .. first + parts - 1."""
    cell: np.ndarray
    r1: np.ndarray
    r2: np.ndarray
    first: np.ndarray
    parts: np.ndarray


def laid_out(cells: list[tuple[int, int, float, float]], shard_rows: int = SHARD_ROWS) -> Cells:
    """Cells in order fill shards of about ``shard_rows`` rows; a larger cell
    has shards of its own."""
    first, parts, shard, used = [], [], 0, 0
    for _, n, _, _ in cells:
        if used and used + n > shard_rows:
            shard, used = shard + 1, 0
        first.append(shard)
        parts.append(max(1, math.ceil(n / shard_rows)))
        used += n
        if parts[-1] > 1:
            shard, used = shard + parts[-1], 0
    cols = list(zip(*cells)) or [(), (), (), ()]
    return Cells(np.array(cols[0], np.int64), np.array(cols[2], float), np.array(cols[3], float),
                 np.array(first, np.int64), np.array(parts, np.int64))


# ----------------------------------------------------- search inside a shard

def slack(bound):
    """Bounds are sums of doubles; scores are whole numbers."""
    return bound + 0.5 + 1e-9 * np.abs(bound)


def multi_sequence(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(a[x] + b[y], x, y) of all pairs in falling order, lazily. From (x, y)
    the heap goes on to (x, y + 1), and to (x + 1, 0) from the first of a row,
    so every pair enters it once."""
    p, q = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    if not len(p) or not len(q):
        return
    heap = [(-(a[p[0]] + b[q[0]]), 0, 0)]
    while heap:
        total, x, y = heapq.heappop(heap)
        yield -total, int(p[x]), int(q[y])
        if y + 1 < len(q):
            heapq.heappush(heap, (-(a[p[x]] + b[q[y + 1]]), x, y + 1))
        if y == 0 and x + 1 < len(p):
            heapq.heappush(heap, (-(a[p[x + 1]] + b[q[0]]), x + 1, 0))


class Shard:
    """Rows of one shard in the order of their cells, with the radii of the
    codewords and cells that occur in it."""

    def __init__(self, table: pa.Table, books: Codebooks):
        cell = table.column("cell").to_numpy()
        order = np.argsort(cell, kind="stable")
        take = lambda name: table.column(name).to_numpy()[order]
        self.books, self.id, self.uid, self.label = books, take("id"), take("uid"), take("label")
        self.x = unpacked(table.column("x"), books.dims)[order]
        present, start = np.unique(cell[order], return_index=True)
        self.start, self.end = start, np.append(start[1:], len(order))
        r1, r2 = take("r1"), take("r2")
        self.cell_r1, self.cell_r2 = [np.maximum.reduceat(r, start) if len(start) else r for r in (r1, r2)]
        codes = len(books.second)
        self.i, i = np.unique(present // codes, return_inverse=True)
        self.j, j = np.unique(present % codes, return_inverse=True)
        self.r1, self.r2 = np.zeros(len(self.i)), np.zeros(len(self.j))
        np.maximum.at(self.r1, i, self.cell_r1)
        np.maximum.at(self.r2, j, self.cell_r2)
        self.at = {(int(a), int(b)): k for k, (a, b) in enumerate(zip(i, j))}

    def scores(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if self.books.exact:
            return self.x[rows] @ q
        out = np.empty(len(rows), object)
        for k, row in enumerate(self.x[rows].tolist()):
            out[k] = sum(int(a) * int(b) for a, b in zip(q.tolist(), row))
        return out

    def search(self, q: np.ndarray, half: tuple[np.ndarray, np.ndarray, float, float], need) -> None:
        """Feed ``need`` with rows until the bound of the cells that are left
        falls below ``need.floor``; cells wholly above ``need.ceiling`` are skipped."""
        s1, s2, n1, n2 = half
        a, b = s1[self.i], s2[self.j]
        waiting, rows = [], 0
        for bound, x, y in multi_sequence(a + n1 * self.r1, b + n2 * self.r2):
            if slack(bound) < need.floor:
                break
            k = self.at.get((x, y))
            if k is None:
                continue
            reach = n1 * self.cell_r1[k] + n2 * self.cell_r2[k]
            if slack(a[x] + b[y] + reach) < need.floor or -slack(reach - a[x] - b[y]) > need.ceiling:
                continue
            waiting.append(np.arange(self.start[k], self.end[k]))
            rows += len(waiting[-1])
            if rows >= VISIT_ROWS:
                self._feed(q, waiting, need)
                waiting, rows = [], 0
        if waiting:
            self._feed(q, waiting, need)

    def _feed(self, q, waiting, need):
        rows = np.concatenate(waiting)
        need.add(self.scores(q, rows), self.id[rows], self.uid[rows], self.label[rows])


Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def best(score: np.ndarray, key: np.ndarray, uid: np.ndarray, n: int) -> Found:
    """The first n by falling score, then by key and uid."""
    if score.dtype == object:
        order = np.array(sorted(range(len(score)), key=lambda i: (-score[i], key[i], uid[i]))[:n], np.int64)
    else:
        order = np.lexsort((uid, key, -score))[:n]
    return score[order], key[order], uid[order]


def _nothing(exact: bool) -> Found:
    return np.zeros(0, float if exact else object), np.zeros(0, np.int64), np.zeros(0, np.int64)


class Positives:
    """The best other rows of the anchor's label."""
    ceiling = math.inf

    def __init__(self, uid: int, label: int, floor: float | None, exact: bool):
        self.uid, self.label, self.found = uid, label, _nothing(exact)
        self.floor = -math.inf if floor is None else floor

    def add(self, score, key, uid, label):
        on = (label == self.label) & (uid != self.uid)
        on[on] = (score[on] >= self.floor).astype(bool)
        if on.any():
            self.found = best(*[np.concatenate([a, b[on]]) for a, b in zip(self.found, (score, key, uid))], N_POSITIVES)
            if len(self.found[0]) == N_POSITIVES:
                self.floor = max(self.floor, float(self.found[0][-1]))

    def rows(self):
        return [(0, int(s), int(k), int(u)) for s, k, u in zip(*self.found)]


class Negatives:
    """For each positive, the best rows of other labels inside its window."""

    def __init__(self, label: int, positives: list[int], floors: list[int | None], exact: bool):
        self.label, self.exact = label, exact
        low, high = WINDOW
        self.windows = [(low * p, high * p) for p in positives]
        # a window cannot yield anything below its low end, or below what is found already
        self.floors = [math.inf if a > b else max(a / 100, -math.inf if f is None else f)
                       for (a, b), f in zip(self.windows, floors)]
        self.ceiling = max((b / 100 for a, b in self.windows if a <= b), default=-math.inf)
        self.found = [_nothing(exact) for _ in positives]

    @property
    def floor(self) -> float:
        return min(self.floors, default=math.inf)

    def add(self, score, key, uid, label):
        on = label != self.label
        score, key, uid = score[on], key[on], uid[on]
        for k, (low, high) in enumerate(self.windows):
            inside = ((100 * score >= low) & (100 * score <= high) & (score >= self.floors[k])).astype(bool)
            if inside.any():
                self.found[k] = best(*[np.concatenate([a, b[inside]]) for a, b in
                                       zip(self.found[k], (score, key, uid))], N_NEGATIVES)
                if len(self.found[k][0]) == N_NEGATIVES:
                    self.floors[k] = max(self.floors[k], float(self.found[k][0][-1]))

    def rows(self):
        return [(k, int(s), int(i), int(u)) for k, f in enumerate(self.found) for s, i, u in zip(*f)]


def _visit(books: Codebooks, negatives: bool):
    """One shard searched for one block of anchors; rows (anchor uid, window,
    score, id, uid), at most the wanted number for each anchor and window."""
    def run(index, anchors):
        cols = [[] for _ in range(5)]
        if len(index) and len(anchors):
            shard = Shard(index, books)
            q = unpacked(anchors.column("x"), books.dims)
            s1, s2, n1, n2 = books.bounds(q)
            state = zip(*[anchors.column(c).to_pylist() for c in ("uid", "label", "positives", "floors")])
            for row, (uid, label, positives, floors) in enumerate(state):
                need = (Negatives(label, positives, floors, books.exact) if negatives
                        else Positives(uid, label, floors[0] if floors else None, books.exact))
                shard.search(q[row], (s1[row], s2[row], n1[row], n2[row]), need)
                for found in need.rows():
                    for col, value in zip(cols, (uid, *found)):
                        col.append(value)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.table(dict(zip(("anchor", "w", "score", "id", "uid"), [pa.array(c, t) for c, t in zip(cols, kinds)])))

    return run, "anchor long, w int, score long, id long, uid long"


def _requests(shared, negatives: bool, probe: bool):
    """(uid, shard) that an anchor has to visit. The probe is the shard of the
    cell with the highest bound; afterwards all others that can still matter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, cells = shared.value
        codes = len(books.second)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                q = unpacked(part.column("x"), books.dims)
                s1, s2, n1, n2 = books.bounds(q)
                bound = slack(s1[:, cells.cell // codes] + s2[:, cells.cell % codes]
                              + n1[:, None] * cells.r1 + n2[:, None] * cells.r2)
                top = bound.argmax(1)
                uids, out = part.column("uid").to_pylist(), [[], []]
                state = zip(*[part.column(c).to_pylist() for c in ("label", "positives", "floors")])
                for row, (uid, (label, positives, floors)) in enumerate(zip(uids, state)):
                    home = int(cells.first[top[row]])
                    if probe:
                        shards = [home]
                    else:
                        floor = (Negatives(label, positives, floors, books.exact).floor if negatives
                                 else floors[0] if floors and floors[0] is not None else -math.inf)
                        live = np.flatnonzero(bound[row] >= floor)
                        shards = {s for k in live for s in range(cells.first[k], cells.first[k] + cells.parts[k])} - {home}
                    out[0] += [uid] * len(shards)
                    out[1] += shards
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())],
                                                 names=["uid", "shard"])

    return run, "uid long, shard long"


# ------------------------------------------------------------------- library

class MultiIndex:
    """The index over rows (id, label, v, anchor): ``encoded`` rows with their
    shard, and the bounded directory (codebooks, cells) that tasks share."""

    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession
        rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
        rows = stored(rows.select(F.monotonically_increasing_id().alias("uid"), F.col("id").cast("long").alias("id"),
                                  F.col("label").cast("long").alias("label"), F.col("v"),
                                  F.coalesce(F.col("anchor"), F.lit(False)).alias("anchor")), "vectors")
        largest = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
        n, dims, top, self.n_anchors = rows.agg(
            F.count(F.lit(1)), F.max(F.size("v")), F.max(largest), F.count_if("anchor")).first()
        dims = max(1, dims or 0)      # without components every score is 0
        exact = 100.0 * dims * (256.0 * (top or 0.0) + 1) ** 2 < float(1 << 53)
        share = F.pmod(F.xxhash64("id"), F.lit(max(1, n))) < CODEBOOK_ROWS
        sample = quantised(rows.filter(share).orderBy("uid").limit(2 * CODEBOOK_ROWS).select("v").toArrow().column("v"), dims)
        codes = min(MOST_CODES, max(2, math.isqrt(n // CELL_ROWS)))
        cut = dims // 2
        self.books = Codebooks(dims, codebook(sample[:, :cut], codes), codebook(sample[:, cut:], codes), exact)
        run, schema = _encode(self.books)
        encoded = stored(rows.mapInArrow(run, schema), "encoded")
        found = encoded.groupBy("cell").agg(F.count(F.lit(1)), F.max("r1"), F.max("r2")).orderBy("cell").collect()
        cells = laid_out([tuple(r) for r in found])
        self.shared = spark.sparkContext.broadcast((self.books, cells))
        # at most MOST_CODES ** 2 rows
        shards = spark.createDataFrame(
            [(int(c), int(a), int(b)) for c, a, b in zip(cells.cell, cells.first, cells.parts)], "cell int, first long, parts long")
        self.encoded = encoded.join(F.broadcast(shards), "cell").withColumn(
            "shard", F.col("first") + F.pmod(F.xxhash64("uid"), F.col("parts"))).drop("first", "parts")

    def _visits(self, anchors: DataFrame, negatives: bool, probe: bool) -> DataFrame:
        asked, schema = _requests(self.shared, negatives, probe)
        blocks = max(1, math.ceil(self.n_anchors / ANCHOR_ROWS))
        wanted = stored(anchors.select("uid", "label", "x", "positives", "floors").mapInArrow(asked, schema), "requests")
        block = F.pmod(F.xxhash64("uid"), F.lit(blocks)).alias("block")
        pairs = stored(wanted.select("shard", block).distinct(), "shard-blocks")
        rows = self.encoded.drop("anchor").join(small(pairs, pairs.count()), "shard")
        asking = wanted.join(anchors, "uid").select("shard", block, "uid", "label", "x", "positives", "floors")
        run, schema = _visit(self.books, negatives)
        visited = rows.groupBy("shard", "block").cogroup(stored(asking, "asking").groupBy("shard", "block"))
        return stored(visited.applyInArrow(run, schema), "visited")

    def _exact(self, anchors: DataFrame, negatives: bool, n: int, floors) -> DataFrame:
        """Probe, then every other shard whose bound reaches the floors that the
        probe's rows set; the first n of each (anchor, window), with their rank."""
        order = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "id", "uid")
        ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
        probed = self._visits(anchors, negatives, True)
        known = stored(floors(ranked(probed)), "floors")
        rest = self._visits(anchors.drop("floors").join(known, "uid", "left"), negatives, False)
        return stored(ranked(probed.unionByName(rest)), "ranked")

    def mine(self) -> DataFrame:
        """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
        none = F.lit(None).cast("array<bigint>")
        anchors = self.encoded.filter("anchor").select("uid", "id", "label", "x")
        full = F.when(F.count(F.lit(1)) == N_POSITIVES, F.array(F.min("score")))
        positives = self._exact(anchors.withColumns({"positives": none, "floors": none}), False, N_POSITIVES,
                                lambda top: top.groupBy(F.col("anchor").alias("uid")).agg(full.alias("floors")))
        lists = positives.groupBy(F.col("anchor").alias("uid")).agg(
            F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("positives"))
        lists = stored(lists, "positive-lists")

        def floors(top: DataFrame) -> DataFrame:
            """The last score of each full window, null for the others."""
            lasts = top.groupBy("anchor", "w").agg(F.when(F.count(F.lit(1)) == N_NEGATIVES, F.min("score")).alias("s"))
            found = lasts.groupBy(F.col("anchor").alias("uid")).agg(F.map_from_entries(
                F.collect_list(F.struct("w", "s"))).alias("by"))
            slots = F.sequence(F.lit(0), F.size("positives") - 1)
            return lists.join(found, "uid", "left").select("uid", F.transform(slots, lambda k: F.try_element_at("by", k)).alias("floors"))

        asking = anchors.join(lists, "uid").withColumn("floors", F.transform("positives", lambda _: F.lit(None).cast("long")))
        negatives = self._exact(asking, True, N_NEGATIVES, floors)
        named = positives.select("anchor", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"),
                                 F.col("score").alias("positive_score"))
        return (negatives.join(named, ["anchor", "w"]).join(anchors.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
                .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                        "positive_score", F.col("score").alias("negative_score")))
