"""N-gram Jaccard join by MinHash banding.

Documents whose sets of five-word shingles have a Jaccard similarity of at
least 0.8 are linked. Steps:

1. Documents with equal shingle sets form one class; from here on only one
   representative of a class is handled, so copies never meet each other.
2. MinHash signatures are cut into bands; band and row counts are the cheapest
   that reach the target recall at the threshold (``bands_for``). Classes are
   shuffled on band hashes, and every member of a bucket is tied to the
   bucket's head (a star, not all pairs).
3. Components of these ties hold all pairs that share a bucket. A component
   is cut into blocks of about ``BLOCK`` classes or ``BLOCK_SHINGLES`` shingles; each pair of blocks is one
   task unit that verifies its pairs on the full shingle sets and returns at
   most one row for each class: linked documents and one tie for connectivity.
4. Verified ties give the groups; links are summed over units. Each pair of
   classes meets in exactly one unit, so no link is lost or counted twice.

Defined cases: a text of one to four words is one shingle; documents without
a word (null, empty) are unlinked classes of their own; repeated rows are
copies of each other; null ids are carried; an empty table gives an empty
result; extra columns do not matter, and clashing names are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .common import small, stored
from .components import components

SHINGLE_WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
BLOCK = 512
#: Shingles of a block, on average: long documents make smaller blocks.
BLOCK_SHINGLES = 1_000_000
#: Columns of the 0/1 matrix in one step of a block comparison.
STRIP = 4096


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = 5) -> tuple[int, int]:
    """(bands, rows): the fewest bands of ``rows`` rows each that find a pair
    at the threshold with probability ``recall``."""
    return int(np.ceil(np.log(1 - recall) / np.log1p(-threshold ** rows))), rows


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = tb.mix(np.arange(1, 2 * n + 1, dtype=tb.U64) * tb.STEP)
    return seeds[:n] | tb.U64(1), seeds[n:]


def signatures(sets: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes, one row for each non-empty set."""
    full = np.flatnonzero(np.diff(first))
    out = np.zeros((len(full), bands), tb.U64)
    mult, add = _permutations(bands * rows)
    at = first[:-1][full]
    for b in range(bands):
        acc = np.full(len(full), b + 1, tb.U64)
        for r in range(rows):
            p = b * rows + r
            acc += np.minimum.reduceat(sets * mult[p] + add[p], at) * tb.SEQ_MULT[r % 5]
            acc = tb.mix(acc)
        out[:, b] = acc
    return out


def _class_keys(sets: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    """128-bit key of each shingle set: two sums of independent hashes."""
    full = np.flatnonzero(np.diff(first))
    keys: list[bytes | None] = [None] * (len(first) - 1)
    if len(full):
        sums = [np.add.reduceat(tb.mix(sets + tb.U64(salt)), first[:-1][full]) for salt in (1, 2)]
        for d, pair in zip(full, np.stack(sums, 1)):
            keys[d] = pair.tobytes()
    return keys


def _shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return tb.distinct(*tb.shingles(tb.Words(tb.Codes(texts)), SHINGLE_WORDS))


def _sketch(bands: int, rows: int):
    schema = pa.schema([("uid", pa.int64()), ("ck", pa.binary()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b, some in tb.pieces(texts):
                sets, first = _shingle_sets(some)
                n = np.diff(first)
                full = n > 0
                flat = np.zeros((b - a, bands), np.int64)
                if full.any():
                    flat[full] = signatures(sets, first, bands, rows).view(np.int64)
                lists = pa.ListArray.from_arrays(np.arange(0, (b - a + 1) * bands, bands, dtype=np.int32), flat.ravel())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(_class_keys(sets, first), pa.binary()), pa.array(n), lists], schema=schema)

    return run, "uid long, ck binary, n long, bands array<long>"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """uid, text -> uid, sorted distinct shingles."""
    for batch in batches:
        for a, b, some in tb.pieces(batch.column(1)):
            sets, first = _shingle_sets(some)
            lists = pa.LargeListArray.from_arrays(first, sets.view(np.int64)).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["uid", "sets"])


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of intersection sizes. Only shingles of two or more sets count;
    the 0/1 matrix is built and multiplied strip by strip."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    flat = np.concatenate(sets) if n else np.zeros(0, np.int64)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    fresh = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(fresh) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[shared]
    column = np.cumsum(np.concatenate([[True], column[1:] != column[:-1]])) - 1 if len(column) else column
    out = np.zeros((n, n), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, STRIP):
        a, b = np.searchsorted(column, [low, low + STRIP])
        strip = np.zeros((n, STRIP), np.float32)
        strip[owner[a:b], column[a:b] - low] = 1
        out += strip @ strip.T
    return out


def _verify(threshold: float):
    schema = pa.schema([("cid", pa.int64()), ("tie", pa.int64()), ("n_docs", pa.int64()), ("n_texts", pa.int64())])

    def run(key: tuple, unit: pa.Table) -> pa.Table:
        low, high = key[1].as_py(), key[2].as_py()
        cid = unit.column("cid").to_numpy()
        block, size = unit.column("block").to_numpy(), unit.column("size").to_numpy()
        sets = [np.asarray(x.values) for x in unit.column("sets")]
        length = np.array([len(s) for s in sets], np.float64)
        common = shared_counts(sets)
        union = length[:, None] + length[None, :] - common
        linked = common + 1e-6 >= threshold * union
        np.fill_diagonal(linked, False)
        if low != high:                                   # pairs inside a block meet in its own unit
            linked &= block[:, None] != block[None, :]
        n_docs = linked @ size
        tie = np.where(linked.any(1), np.arange(len(cid)), -1)
        for i in np.flatnonzero(tie >= 0):                # smallest member of its part of the unit
            todo, part = [i], tie[i]
            if part < i:
                continue
            seen = np.zeros(len(cid), bool)
            seen[i] = True
            while len(todo):
                near = linked[todo].any(0) & ~seen
                seen |= near
                todo = np.flatnonzero(near)
            tie[seen] = i
        hit = np.flatnonzero(tie >= 0)
        return pa.table([cid[hit], cid[tie[hit]], n_docs[hit], linked.sum(1)[hit]], schema=schema)

    return run, "cid long, tie long, n_docs long, n_texts long"


class Join:
    """The join of one table. ``rows`` is the input with a row number ``uid``,
    written once; ``documents()`` and ``extra_rows()`` read the results."""

    def __init__(self, docs: DataFrame, text: str = "text", threshold: float = THRESHOLD,
                 recall: float = RECALL, block: int = BLOCK):
        self.rows = stored(docs.select(F.struct("*").alias("row"), F.col(text).alias("text"),
                                       F.monotonically_increasing_id().alias("uid")), "join-rows")
        bands, rows = bands_for(threshold, recall)
        run, schema = _sketch(bands, rows)
        self.sketch = stored(self.rows.select("uid", "text").mapInArrow(run, schema), "sketches")
        # classes of equal shingle sets; a document without words has no key
        self.classes = stored(self.sketch.filter("ck IS NOT NULL").groupBy("ck").agg(
            F.min("uid").alias("cid"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n")), "classes")
        reps = self.sketch.join(self.classes.select(F.col("cid").alias("uid"), "size"), "uid")
        self.links = self._verified(self._units(reps, block), threshold)
        ties = self.links.filter("cid != tie").select(F.col("cid").alias("u"), F.col("tie").alias("v"))
        self.groups = stored(components(ties), "groups")

    def _units(self, reps: DataFrame, block: int) -> DataFrame:
        """cid, size, comp, block and the unit's block pair (low, high)."""
        entries = reps.select(F.col("uid").alias("cid"), F.posexplode("bands").alias("band", "h"))
        heads = entries.groupBy("band", "h").agg(F.min("cid").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        ties = entries.join(heads, ["band", "h"]).filter("cid != head").select(
            F.col("cid").alias("u"), F.col("head").alias("v"))
        comp = stored(components(ties), "candidates")
        sized = comp.withColumnRenamed("node", "cid").join(self.classes.select("cid", "size", "n"), "cid")
        parts = sized.groupBy("label").agg(F.greatest(
            F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"))
        return stored(sized.join(parts, "label").select(
            "cid", "size", F.col("label").alias("comp"), "parts",
            F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int").alias("block")), "members")

    def _verified(self, members: DataFrame, threshold: float) -> DataFrame:
        run, schema = _verify(threshold)
        chosen = self.rows.select("uid", "text").join(
            small(members.select(F.col("cid").alias("uid")), members.count()), "uid", "left_semi")
        sets = chosen.mapInArrow(_sets, "uid long, sets array<long>").withColumnRenamed("uid", "cid")
        other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
        placed = sets.join(members, "cid").select("cid", "size", "comp", "block", "sets", other).withColumns(
            {"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other")
        found = placed.groupBy("comp", "low", "high").applyInArrow(run, schema)
        return stored(found, "links")

    def documents(self) -> DataFrame:
        """uid, cid, group (smallest uid of the group), class size, n_links
        (other documents at or above the threshold, copies included) and
        n_linked_texts (different linked texts) for every row."""
        links = self.links.groupBy("cid").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_texts").alias("n_texts"))
        info = (self.classes.join(links, "cid", "left")
                .join(self.groups.select(F.col("node").alias("cid"), F.col("label").alias("group")), "cid", "left"))
        keyed = self.sketch.select("uid", "ck").join(info, "ck", "left")
        cid = F.coalesce("cid", "uid")
        return keyed.select("uid", cid.alias("cid"), F.coalesce("group", cid).alias("group"),
                            F.coalesce("size", F.lit(1)).alias("class_size"),
                            (F.coalesce("size", F.lit(1)) - 1 + F.coalesce("n_docs", F.lit(0))).alias("n_links"),
                            F.coalesce("n_texts", F.lit(0)).alias("n_linked_texts"))

    def kept_rows(self) -> DataFrame:
        """The input's rows with one document of each group, the first."""
        dropped = stored(self.documents().filter("uid != group").select("uid"), "dropped")
        keep = self.rows.join(small(dropped, dropped.count()), "uid", "left_anti")
        return keep.select("row.*")


def linked_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, class_id (smallest id among equal
    texts), class_size, n_links, n_linked_texts, group_id (smallest id of the
    group of linked documents)."""
    join = Join(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))
    out = stored(join.documents().join(join.rows.select("uid", "row.doc_id"), "uid"), "documents")
    group = out.groupBy("group").agg(F.min("doc_id").alias("group_id"))
    classes = out.groupBy("cid", "group").agg(F.min("doc_id").alias("class_id")).join(group, "group").drop("group")
    return out.join(classes, "cid").select("doc_id", "class_id", "class_size", "n_links", "n_linked_texts", "group_id")
