"""Iteration state: persist each iteration's small state tables and cut the
lineage with a reliable checkpoint every few iterations.

The checkpoint goes to the session's ``spark.checkpoint.dir`` (a shared
folder on a cluster), so a lost executor re-reads the last checkpoint
instead of replaying every earlier iteration. ``localCheckpoint`` is never
used: its blocks die with the executor."""

from __future__ import annotations

from contextlib import contextmanager, nullcontext

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


@contextmanager
def static_plan(spark: SparkSession):
    """Plan without adaptive execution while a state table is materialised.

    An adaptive plan reports no output partitioning until it has run, so a
    checkpoint taken from it forgets that the table is hash-partitioned and
    sorted by row_id, and every later ``rows JOIN state`` would shuffle and
    sort the state again. Planned statically, the checkpoint keeps both and
    the join is a zip of co-partitioned, sorted inputs (no exchange, no sort).
    The setting is restored afterwards; queries that other threads start on
    the same session meanwhile see it too."""
    key = "spark.sql.adaptive.enabled"
    old = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, old)


class IterationState:
    """Holds the current version of named state tables.

    Each new version is persisted, then (every ``checkpoint_every``
    iterations, by default every one; ``every`` overrides it per table)
    checkpointed from that cache: the
    checkpoint write reads the cached blocks instead of recomputing, and the
    returned table's plan is a scan of the checkpoint, so plans do not grow
    with the number of iterations (analysis and cache look-ups of a plan that
    embeds every earlier iteration get slower each step)."""

    def __init__(self, checkpoint_every: int = 1, every: dict[str, int] | None = None,
                 keep_layout: tuple[str, ...] = ("P",)):
        self.checkpoint_every = checkpoint_every
        self.every = dict(every or {})
        # tables whose row_id layout must survive the checkpoint (row state);
        # the others are written with adaptive execution as configured
        self.keep_layout = set(keep_layout)
        self._live: dict[str, list[DataFrame]] = {}

    def put(self, name: str, df: DataFrame, iteration: int, measure: list | None = None, final: bool = False):
        """Materialise ``df`` as the new version of ``name`` and drop the old one.
        ``final`` checkpoints whatever the cadence says.

        With ``measure`` (aggregate columns) the materialising action computes
        them and ``(df, row)`` is returned, saving a separate pass."""
        with (static_plan(df.sparkSession) if name in self.keep_layout else nullcontext()):
            cached = df.persist(StorageLevel.MEMORY_AND_DISK)
            keep = [cached]
            k = self.every.get(name, self.checkpoint_every)
            if final or (k and iteration % k == 0):
                ensure_checkpoint_dir(df.sparkSession)
                # lazy checkpoint, kept in memory: the measuring action below
                # computes the table once (filling both caches) and Spark then
                # writes the checkpoint from the first cache, two jobs in all
                out = cached.checkpoint(eager=False).persist(StorageLevel.MEMORY_AND_DISK)
                row = out.agg(*measure).first() if measure else out.count()
                cached.unpersist()
                keep = [out]
            else:
                out = cached
                # a persisted relation caches every column whichever are read
                row = out.agg(*measure).first() if measure else out.count()
        for old in self._live.get(name, []):
            old.unpersist()
        self._live[name] = keep
        return (out, row) if measure else out

    def release(self) -> None:
        for dfs in self._live.values():
            for df in dfs:
                df.unpersist()
        self._live.clear()
