"""Shuffle volume of the hot path, from Spark's event log (written to a fresh
scratch folder; no UI): python tools/shuffle_profile.py [sf_dir] [scratch_dir]

Prints a markdown table: rows read, shuffle records and bytes written per
labelled job (gradient and weight update, dual passes)."""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from sparsegrad.operators import linear, update  # noqa: E402
from sparsegrad.plans import rowlocal  # noqa: E402
from sparsegrad.plans.history import DualHistory  # noqa: E402
from sparsegrad.plans.lineage import IterationState  # noqa: E402
from sparsegrad.session import ensure_checkpoint_dir  # noqa: E402
from sparsegrad.sources import fixtures as fx  # noqa: E402
from sparsegrad.sources.text import cache_points  # noqa: E402


def _lines(path):
    """Lines of an event-log file (rolling logs are zstd-compressed in Spark 4)."""
    if path.endswith(".zstd"):
        import io

        import zstandard
        with open(path, "rb") as fh:
            reader = zstandard.ZstdDecompressor().stream_reader(fh)
            yield from io.TextIOWrapper(reader, encoding="utf-8")
    else:
        with open(path, encoding="utf-8") as fh:
            yield from fh


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    scratch = sys.argv[2] if len(sys.argv) > 2 else tempfile.mkdtemp(prefix="run-")
    logs = os.path.join(scratch, "events")
    os.makedirs(logs, exist_ok=True)
    spark = (SparkSession.builder.master("local[8]").appName("shuffle-profile")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", f"file://{logs}")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    rows = fx.sparse_rows(spark, sf)
    d = fx.max_feature_id(rows)
    R = cache_points(rows)
    n = R.count()
    nnz = R.agg(F.sum(F.size("features"))).first()[0]
    st = IterationState()
    W = st.put("W", fx.fx_weights(spark, d), 1)
    history = DualHistory(0.15, None, n ** -0.5)
    history.add(5, 0.1, 2.0, 0.1)
    labelled = []

    def run(label, fn):
        sc.setJobDescription(label)
        fn()
        sc.setJobDescription(None)
        labelled.append(label)

    grad = rowlocal.gradient(R, rowlocal.weight_array(W, d), 0.1, rowlocal.primal_coefficients,
                             weigh=history.frozen().weights, above=50 / n, summed=False)
    run("gradient pass + weight update (one aggregate)",
        lambda: update.gradient_step(W, grad, 1.0, 0.1, 1.0).collect())
    run("gradient alone, summed", lambda: linear.gradient(R, W, 0.1, d=d).collect())
    run("dual pass (sums of p^2, p y by bins)", lambda: history.totals(R, 1, 600))
    run("dual pass with raced row", lambda: history.totals(R, race=(3, 1)))
    spark.stop()

    job_label, stage_job = {}, {}
    metrics = defaultdict(lambda: defaultdict(int))
    for path in glob.glob(os.path.join(logs, "**", "events_*"), recursive=True) + \
            glob.glob(os.path.join(logs, "local-*")):
        for line in _lines(path):
            if True:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    desc = (ev.get("Properties") or {}).get("spark.job.description")
                    for sid in ev.get("Stage IDs", []):
                        stage_job[sid] = desc
                elif kind == "SparkListenerTaskEnd":
                    label = stage_job.get(ev.get("Stage ID"))
                    if label not in labelled:
                        continue
                    tm = ev.get("Task Metrics") or {}
                    sw = tm.get("Shuffle Write Metrics") or {}
                    metrics[label]["shuffle records"] += sw.get("Shuffle Records Written", 0)
                    metrics[label]["shuffle bytes"] += sw.get("Shuffle Bytes Written", 0)
                    metrics[label]["tasks"] += 1
    print(f"## Shuffle volume per pass (event log; N = {n}, stored entries = {nnz}, D = {d}, 8 tasks)\n")
    print("| job | tasks | shuffle records written | shuffle bytes written |")
    print("| --- | --- | --- | --- |")
    for label in labelled:
        m = metrics[label]
        print(f"| {label} | {m['tasks']} | {m['shuffle records']} | {m['shuffle bytes']} |")
    print()


if __name__ == "__main__":
    main()
