"""Connected components of a distributed edge table (large star, small star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stored


def _distinct_edges(df: DataFrame) -> DataFrame:
    return df.filter("u > v").groupBy("u", "v").agg(F.count(F.lit(1)).alias("_n")).drop("_n")


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """Hang neighbours below the smallest: in a large star the larger
    neighbours of every node, in a small star the smaller ones. ``n`` bounds
    the edges; a table of minima that is small enough is broadcast, which
    leaves the edges where they are."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(small(low, 2 * n), "u")
    if large:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _distinct_edges(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        low.select("u", F.col("m").alias("v"))))


def _shape(edges: DataFrame) -> tuple[int, bool]:
    """(edges, whether they are stars: every node hangs below one node that
    hangs below none)."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("child")).union(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("child")))
    nodes = ends.groupBy("node").agg(F.sum("child").alias("c"), F.min("child").alias("least"))
    n, bad = nodes.agg(F.sum("c"), F.count_if((F.col("c") > 1) | ((F.col("c") == 1) & (F.col("least") == 0)))).first()
    return int(n or 0), not bad


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (columns u, v), the label
    being the smallest node of its component. Every round is a table in the
    shared folder; two numbers reach the driver a round. Edges are never
    grouped by node in one task: minima are partial aggregates, and joins
    that are not broadcast may be split by adaptive execution."""
    if edges.sparkSession.conf.get("spark.sql.adaptive.enabled") != "true":
        raise ValueError("components needs adaptive execution to split hot nodes")
    high = F.greatest("u", "v")
    now = stored(_distinct_edges(edges.select(high.alias("u"), F.least("u", "v").alias("v"))), "edges")
    while True:
        n, done = _shape(now)
        if done:
            break
        now = stored(_star(_star(now, True, n), False, n), "edges")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)
