"""Benchmark decontamination: short test items inside long documents.

Size-partitioned MinHash containment search. Items are partitioned by the
number of their five-word shingles (powers of two). An item's sketch are its
``k`` smallest shingle hashes, with ``k`` set by the upper size bound ``u`` of
its partition: ``k = floor((1 - t) * u) + 1``. A document that holds a share
``t`` of an item's shingles misses at most ``(1 - t) * u`` of them, so it
holds one of the sketch: the search loses nothing, whatever the document's
length. Candidates are verified by exact shingle containment over the whole
document.

Words are lower-cased runs of letters and digits, so punctuation and case do
not hide a copy. The benchmark is broadcast only if its shingles number at
most ``BROADCAST_SHINGLES``; a larger one is joined by shuffle, with the same
result.

Defined cases: items of fewer than five words have no shingle and match
nothing; null and empty texts match nothing; repeated items and repeated
documents each give their own pairs; null ids are carried; empty tables give
empty results; clashing column names do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .common import stored

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BROADCAST_SHINGLES = 4_000_000

_alnum: list[np.ndarray] = []


def letters_and_digits(c: np.ndarray) -> np.ndarray:
    """True for letters and digits of any script."""
    if not _alnum:
        _alnum.append(np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000))
    return _alnum[0][c]


def item_shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in text order of normalised texts: (hashes, first)."""
    words = tb.Words(tb.Codes([t.lower() for t in texts]), letters_and_digits)
    return tb.shingles(words, SHINGLE_WORDS, whole_short=False)


def sketch_size(n: int, threshold: float) -> int:
    """Sketch size of the partition of items with 2^p <= n < 2^(p+1) shingles."""
    upper = (1 << n.bit_length()) - 1
    return min(n, math.floor((1 - threshold) * upper + 1e-9) + 1)


def _items(threshold: float):
    schema = "item_id long, q int, hashes array<long>, k int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, some in tb.pieces(batch.column(1)):
                sets, first = tb.distinct(*item_shingles(some))
                q = np.diff(first)
                k = [sketch_size(int(n), threshold) if n else 0 for n in q]
                lists = pa.LargeListArray.from_arrays(first, sets.view(np.int64)).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(q, pa.int32()), lists, pa.array(k, pa.int32())],
                    names=["item_id", "q", "hashes", "k"])

    return run, schema


def prepared(benchmark: DataFrame, threshold: float = THRESHOLD, key: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, q, hashes (sorted as unsigned; the first k are the sketch), k."""
    run, schema = _items(threshold)
    pairs = benchmark.select(F.col(key).cast("long").alias("item_id"), F.col(text).alias("text"))
    return stored(pairs.mapInArrow(run, schema).filter("q > 0"), "items")


@dataclass
class Index:
    """Sketch postings and full shingle sets of a benchmark of bounded size."""
    ids: list[int | None]
    sets: list[np.ndarray]
    keys: np.ndarray        # distinct sketch hashes, sorted
    first: np.ndarray       # postings of keys[i]: items[first[i]:first[i+1]]
    items: np.ndarray
    threshold: float

    @classmethod
    def of(cls, rows: list, threshold: float) -> Index:
        sets = [np.asarray(r["hashes"], np.int64).view(tb.U64) for r in rows]
        sketch = np.concatenate([s[:r["k"]] for s, r in zip(sets, rows)]) if rows else np.zeros(0, tb.U64)
        owner = np.repeat(np.arange(len(rows)), [r["k"] for r in rows]) if rows else np.zeros(0, np.int64)
        order = np.argsort(sketch, kind="stable")
        keys, first = np.unique(sketch[order], return_index=True)
        return cls([r["item_id"] for r in rows], sets, keys, np.append(first, len(order)), owner[order], threshold)

    def matches(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(text, item, shared shingles) of every contained item."""
        out: list[tuple[int, int, int]] = []
        if not len(self.keys):
            return out
        flat, at = item_shingles(texts)
        slot = np.minimum(np.searchsorted(self.keys, flat), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[slot] == flat)
        text_of = np.searchsorted(at, hit, side="right") - 1
        for d in np.unique(text_of):
            own = np.unique(flat[at[d]:at[d + 1]])
            slots = np.unique(slot[hit[text_of == d]])
            for i in np.unique(np.concatenate([self.items[self.first[s]:self.first[s + 1]] for s in slots])):
                items = self.sets[i]
                found = np.minimum(np.searchsorted(own, items), len(own) - 1)
                shared = int((own[found] == items).sum())
                if shared + 1e-9 >= self.threshold * len(items):
                    out.append((int(d), int(i), shared))
        return out


PAIRS = "doc_id long, item_id long, n_shared int, item_shingles int, containment double"


def _pairs(shared):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_shared", pa.int32()),
                        ("item_shingles", pa.int32()), ("containment", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            ids = batch.column(0)
            for a, _, some in tb.pieces(batch.column(1)):
                rows = [(ids[a + d].as_py(), index.ids[i], n, len(index.sets[i]), n / len(index.sets[i]))
                        for d, i, n in index.matches(some)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _clean(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for a, _, some in tb.pieces(batch.column(1)):
                keep[[a + d for d, _, _ in index.matches(some)]] = False
            if keep.any():
                yield batch.select([0]).filter(pa.array(keep))

    return run


def _shared_index(items: DataFrame, threshold: float, limit: int):
    """The broadcast index, or None if the benchmark is larger than ``limit``."""
    total = items.agg(F.sum("q")).first()[0] or 0
    if total > limit:
        return None
    return items.sparkSession.sparkContext.broadcast(Index.of(items.collect(), threshold))


def _document_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, some in tb.pieces(batch.column(1)):
            sets, first = tb.distinct(*item_shingles(some))
            ids = batch.column(0).slice(a, b - a).take(pa.array(np.repeat(np.arange(b - a), np.diff(first))))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sets.view(np.int64))], names=["uid", "h"])


def _by_shuffle(rows: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """uid, item, item_id, n_shared, q over a benchmark too large to broadcast:
    documents' shingles meet sketches, and only candidates meet full sets."""
    keyed = stored(items.withColumn("item", F.monotonically_increasing_id()), "items")
    at = F.posexplode("hashes").alias("pos", "h")
    postings = keyed.select("item", "item_id", "q", "k", at)
    shingles = stored(rows.select("uid", "text").mapInArrow(_document_shingles, "uid long, h long"), "shingles")
    candidates = shingles.join(postings.filter("pos < k").select("item", "h"), "h").select("uid", "item").distinct()
    full = candidates.join(postings.select("item", "item_id", "q", "h"), "item")
    shared = full.join(shingles, ["uid", "h"]).groupBy("uid", "item").agg(
        F.first("item_id").alias("item_id"), F.count(F.lit(1)).alias("n_shared"), F.first("q").alias("q"))
    return shared.filter(F.col("n_shared") + 1e-9 >= F.lit(threshold) * F.col("q"))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id",
                 text: str = "text", limit: int = BROADCAST_SHINGLES) -> DataFrame:
    """One row for each (document, item) with containment of at least the
    threshold: doc_id, item_id, n_shared, item_shingles, containment."""
    items = prepared(benchmark, threshold)
    pairs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    shared = _shared_index(items, threshold, limit)
    if shared is not None:
        return pairs.mapInArrow(_pairs(shared), PAIRS)
    rows = stored(pairs.withColumn("uid", F.monotonically_increasing_id()), "documents")
    found = _by_shuffle(rows, items, threshold)
    return found.join(rows.select("uid", "doc_id"), "uid").select(
        "doc_id", "item_id", F.col("n_shared").cast("int"), F.col("q").alias("item_shingles"),
        (F.col("n_shared") / F.col("q")).alias("containment"))


def clean_rows(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text: str = "text",
               limit: int = BROADCAST_SHINGLES) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, unshuffled."""
    items = prepared(benchmark, threshold)
    shared = _shared_index(items, threshold, limit)
    if shared is not None:
        packed = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
        return packed.mapInArrow(_clean(shared), packed.select("row").schema).select("row.*")
    rows = stored(docs.select(F.struct("*").alias("row"), F.col(text).alias("text"),
                              F.monotonically_increasing_id().alias("uid")), "documents")
    found = _by_shuffle(rows, items, threshold).select("uid").distinct()
    return rows.join(found, "uid", "left_anti").select("row.*")
