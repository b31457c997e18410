"""Print the executed physical plans of the per-iteration hot path (cached
subplans folded) as markdown: python tools/show_plans.py [sf_dir] > PLANS.md"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from sparsegrad.operators import linear, sample, update  # noqa: E402
from sparsegrad.plans import rowlocal  # noqa: E402
from sparsegrad.plans.blocked import FeatureBlocks  # noqa: E402
from sparsegrad.plans.history import DualHistory  # noqa: E402
from sparsegrad.plans.lineage import IterationState  # noqa: E402
from sparsegrad.session import local_session  # noqa: E402
from sparsegrad.sources import fixtures as fx  # noqa: E402


def folded(df) -> str:
    """The executed plan as a tree of one-line node descriptions, walking
    adaptive stages and not descending into cached relations."""
    df.collect()
    out = []

    def walk(node, depth):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan(), depth)
        if name.endswith("QueryStageExec"):
            return walk(node.plan(), depth)
        if name in ("WholeStageCodegenExec", "InputAdapter"):
            return walk(node.child(), depth)
        line = node.simpleString(12)
        line = re.sub(r"#\d+L?", "", line)
        line = re.sub(r", \[plan_id=\d+\]", "", line)
        if len(line) > 150:
            line = line[:147] + "..."
        out.append("  " * depth + ("+- " if depth else "") + line)
        kids = node.children()
        for i in range(kids.size()):
            walk(kids.apply(i), depth + 1)

    walk(df._jdf.queryExecution().executedPlan(), 0)
    return "\n".join(out)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8)
    # show the plan shapes of a cluster, where the row state is too big to broadcast
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rows = fx.sparse_rows(spark, sf)
    d = fx.max_feature_id(rows)
    R = rows.persist()
    n = R.count()
    st = IterationState()
    W = st.put("W", fx.fx_weights(spark, d), 1)
    history = DualHistory(0.15, None, n ** -0.5)
    history.add(5, 0.1, 2.0, 0.1)
    active = rowlocal.gradient(R, rowlocal.weight_array(W, d), 0.1, rowlocal.primal_coefficients,
                               weigh=history.frozen().weights, above=50 / n, summed=False)
    w_sq = F.when(F.col("idx") > 0, F.col("w") * F.col("w")).otherwise(0.0)
    blocks = FeatureBlocks(R.select(F.col("row_id").alias("rid"), "features"), d, block_size=200)
    by_rid = R.select(F.col("row_id").alias("rid"), "y")
    sections = [
        ("Training rows from parquet (built once, cached)", rows.select(F.sum(F.size("features")))),
        ("T2: gradient pass and weight update in one job (union + sum per id; new bias as idx 0)",
         update.gradient_step(W, linear.gradient(R, W, 0.1, d=d, summed=False), 1.0, 0.1, 1.0)),
        ("T3: p-weighted gradient of the active rows (p from the history, no table of p) and weight update",
         update.gradient_step(W, active, 1.0, 0.1, 1.0)),
        ("Feature draw by exponential race, folded into the job that writes W", W.agg(sample.race_winner("3:w1", "idx", w_sq, "w"))),
        ("Dual pass: sums of p^2 and p y, rows counted, by bins of the row id", history.sums(R, 1, 600)),
        ("Dual pass with a raced row draw", history.sums(R, race=(3, 1))),
        ("Weights on their way to the cells that use them (routes cached)", blocks.routed(W)),
        ("Scores over feature blocks (weights too large to broadcast; cells cached)", blocks.scores(by_rid, W, 0.1)),
        ("Gradient pass over feature blocks", blocks.gradient(by_rid, W, 0.1, linear.gd_coef)),
    ]
    print(f"# Physical plans of the hot path\n\nGenerated by `tools/show_plans.py {sf}` "
          f"(N = {n}, D = {d}, automatic broadcast off, as for row state too big to broadcast). "
          "Cached relations are shown as their scan; code-generated stages are flattened.\n")
    for title, df in sections:
        print(f"## {title}\n\n```\n{folded(df)}\n```\n")
    spark.stop()


if __name__ == "__main__":
    main()
