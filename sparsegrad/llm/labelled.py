"""Learning rows from ``labels``: the rows a classifier may see."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, small, stored


def learning_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """doc_id, text, label (0/1) of all labelled documents that are not held
    out; with ``rows`` of at most that many, in hash order of the id. Null labels
    and ids do not count; of several labels for one id the largest holds; of
    several documents with one id one is used."""
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    chosen = stored(known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")), "labelled")
    if rows is not None:
        # hashes are even, so about twice the wanted rows lie below the bound, and the
        # task that orders them reads no more, whatever the number of labels
        share = min(1.0, 2.0 * rows / max(1, chosen.count()))
        below = F.col("_o") <= F.lit(int(-(1 << 63) + share * ((1 << 64) - 1)) if share < 1.0 else (1 << 63) - 1)
        chosen = stored(chosen.withColumn("_o", F.xxhash64("doc_id")).filter(below)
                        .orderBy("_o", "doc_id").limit(rows).drop("_o"), "sample")
    joined = docs.select("doc_id", "text").join(small(chosen, chosen.count()), "doc_id")
    n, ids = joined.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    return stored(joined.dropDuplicates(["doc_id"]) if n > ids else joined, "learning")
