"""Trainer-level checks."""


import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from sparsegrad.operators import linear
from sparsegrad.plans import trainers
from sparsegrad.sources import fixtures as fx
from sparsegrad.sources import model_io


def test_gd_step_equals_primal_step_with_uniform_p(spark, sf):
    # (sigma(y s) - 1) y = -y g(y s): a T2 step of -1/N equals a T3 step with p = 1/N, r = 0
    rows = fx.sparse_rows(spark, sf)
    d = fx.max_feature_id(rows)
    n = rows.count()
    w = fx.fx_weights(spark, d)
    g2 = {r["idx"]: r["g"] for r in linear.gradient(rows, w, 0.25, d=d).collect()}
    rp = rows.withColumn("p", F.lit(1.0 / n))
    g3 = {r["idx"]: r["g"] for r in linear.gradient(rp, w, 0.25, coef=linear.primal_coef, weight="p", d=d).collect()}
    for k in g2:
        if k == 0:
            assert abs(g3[0] + g2[0]) < 1e-9          # bias part is not weighted by p
        else:
            assert abs(g3[k] + g2[k] / n) < 1e-12


def test_primal_dual_invariants(spark, sf):
    rows = fx.sparse_rows(spark, sf)
    d = fx.max_feature_id(rows)
    n = rows.count()
    m = trainers.train_primal_dual(rows, d, 3, eta=0.15, r=0, u=0.37, w_step=1.0, b_step=1.0 / n)
    assert abs(m.p.agg(F.sum(F.col("p") * F.col("p"))).first()[0] - 1.0) < 1e-9
    assert m.p.count() == n
    assert len(m.trace) == 3 and all(t["j"] is not None for t in m.trace)
    # the sampled feature always has a non-zero weight
    js = {t["j"] for t in m.trace}
    assert m.weights.where(F.col("idx").isin(list(js)) & (F.col("w") == 0)).count() == 0


def test_sampled_trainer_unit_norm_and_bias(spark, sf):
    rows = fx.sparse_rows(spark, sf)
    d = fx.max_feature_id(rows)
    m = trainers.train_sampled(rows, d, 3, u_rows=0.61, u_features=0.37)
    assert abs(m.weights.agg(F.sum(F.col("w") * F.col("w"))).first()[0] - 1.0) < 1e-9
    bs = [t["b"] for t in m.trace]
    assert all(b in (-1.0, 0.0, 1.0) for b in bs)
    assert abs(m.b_avg - sum(bs) / len(bs)) < 1e-12


def test_trainers_independent_of_partitioning(spark, sf):
    rows = fx.sparse_rows(spark, sf)
    d = fx.max_feature_id(rows)
    n = rows.count()
    a = trainers.train_gd(rows.repartition(2), d, 2, fit_bias=True, w_step=-1.0 / n, b_step=-1.0 / n)
    b = trainers.train_gd(rows.repartition(11), d, 2, fit_bias=True, w_step=-1.0 / n, b_step=-1.0 / n)
    wa = {r["idx"]: r["w"] for r in a.weights.collect()}
    wb = {r["idx"]: r["w"] for r in b.weights.collect()}
    assert abs(a.b - b.b) < 1e-12 and all(abs(wa[k] - wb[k]) < 1e-12 for k in wa)


def test_model_text_roundtrip(spark, sf, scratch):
    rows = fx.sparse_rows(spark, sf)
    d = fx.max_feature_id(rows)
    m = trainers.train_gd(rows, d, 1, fit_bias=True)
    table = model_io.model_table(m.weights, m.b, d)
    model_io.write_model_text(table, f"{scratch}/model", parts=3)
    back = {r["idx"]: r["w"] for r in model_io.read_model_text(spark, f"{scratch}/model").collect()}
    exp = {r["idx"]: r["w"] for r in table.collect()}
    assert back.keys() == exp.keys() and all(abs(back[k] - exp[k]) < 1e-12 for k in exp)
    assert abs(back[d + 1] - m.b) < 1e-12
    m.save(f"{scratch}/saved")
    saved = {r["idx"]: r["w"] for r in model_io.read_model_text(spark, f"{scratch}/saved").collect()}
    assert saved == back


def test_blocked_plan_matches(spark, sf):
    # weights "too large" to broadcast: feature blocks, one of them hot
    hot = F.concat(F.array(F.struct(F.lit(1).cast("bigint").alias("idx"), F.lit(0.5).alias("val"))), F.col("features"))
    rows = fx.sparse_rows_with_empty(spark, sf).withColumn("features", hot)
    d = fx.max_feature_id(rows)
    n = rows.count()
    for train, kw in ((trainers.train_gd, dict(fit_bias=True, w_step=-1.0 / n, b_step=-1.0 / n)),
                      (trainers.train_primal_dual, dict(eta=0.15, r=38, u=0.37, w_step=1.0, b_step=1.0 / n))):
        a = train(rows, d, 2, **kw)
        b = train(rows, d, 2, max_weights=3, block_size=4, **kw)
        wa = {r["idx"]: r["w"] for r in a.weights.collect()}
        wb = {r["idx"]: r["w"] for r in b.weights.collect()}
        assert wa.keys() == wb.keys() and abs(a.b - b.b) < 1e-12 and all(abs(wa[k] - wb[k]) < 1e-10 for k in wa)
        assert [t.get("j") for t in a.trace] == [t.get("j") for t in b.trace]


def test_blocks_move_rows_not_entries(spark):
    # 40 entries a row in 2 blocks: an iteration shuffles 2 records a row each way
    from sparsegrad.operators import linear as L
    from sparsegrad.plans.blocked import FeatureBlocks
    feats = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.struct(i.cast("bigint").alias("idx"), F.lit(1.0).alias("val")))
    rows = spark.range(3000).select(F.col("id").alias("rid"), F.lit(1.0).alias("y"), feats.alias("features")).persist()
    blocks = FeatureBlocks(rows, 40, block_size=20, cell_entries=20_000)
    assert blocks.cells.count() == 6                       # every block is hot and cut into parts
    g = blocks.gradient(rows.select("rid", "y"), fx.fx_weights(spark, 40), 0.0, L.gd_coef)
    got = {r["idx"]: r["g"] for r in g.collect()}
    want = {r["idx"]: r["g"] for r in L.gradient(rows, fx.fx_weights(spark, 40), 0.0, d=40).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in got)
    assert max(_records_written(g._jdf.queryExecution().executedPlan())) <= 3000 * 2
    blocks.release()


def _small_broadcasts_off(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    return lambda: spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _scattered_rows(spark, n=4000, d=60_000, width=6):
    """Rows of a few ids out of many, and an id that all rows share."""
    pick = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda k: F.struct(
        F.when(k == 1, F.lit(7).cast("bigint")).otherwise(F.pmod(F.xxhash64("id", k), F.lit(d)) + 1).alias("idx"),
        (k / 8.0).alias("val")))
    return spark.range(n).select(F.col("id").alias("rid"), F.when(F.col("id") % 3 == 0, 1.0).otherwise(-1.0).alias("y"),
                                 pick.alias("features")).persist()


def test_cells_get_only_the_weights_they_use(spark):
    """Bytes and records of one routing of the weights, against the distinct
    (cell, id) pairs; the placed cells and routes stay where they are."""
    from sparsegrad.plans.blocked import FeatureBlocks
    restore = _small_broadcasts_off(spark)
    try:
        d, rows = 60_000, _scattered_rows(spark)
        blocks = FeatureBlocks(rows, d, block_size=20_000, cell_entries=3000)
        cells, pairs = blocks.cells.agg(F.count(F.lit(1)), F.sum(F.size("id"))).first()
        assert cells >= 8 and pairs < cells * 20_000 / 4
        weights = fx.fx_weights(spark, d).withColumn("w", F.rand(3))
        sent = blocks.routed(weights)
        sent.count()
        sizes = []
        _exchanges(sent._jdf.queryExecution().executedPlan(), sizes)
        chunks = -(-20_000 // blocks.chunk) * 3
        tasks = 8
        # one exchange takes D weights to their chunks, one the used weights to the cells
        assert len(sizes) == 2
        to_cells, to_chunks = sizes
        assert to_chunks[0] <= chunks * tasks and to_cells[0] <= min(pairs, cells * tasks)
        assert to_cells[1] < 16 * pairs < 8 * 20_000 * cells / 2
    finally:
        restore()
        blocks.release()
        rows.unpersist()


def test_placed_entries_never_move_again(spark):
    from sparsegrad.operators import linear as L
    from sparsegrad.plans.blocked import FeatureBlocks
    restore = _small_broadcasts_off(spark)
    try:
        d, rows = 60_000, _scattered_rows(spark)
        blocks = FeatureBlocks(rows, d, block_size=20_000, cell_entries=3000)
        weights = fx.fx_weights(spark, d)
        g = blocks.gradient(rows.select("rid", "y"), weights, 0.3, L.gd_coef)
        got = {r["idx"]: r["g"] for r in g.collect()}
        want = {r["idx"]: r["g"] for r in L.gradient(rows, weights, 0.3, d=d).collect()}
        assert all(abs(got.get(k, 0.0) - want.get(k, 0.0)) < 1e-9 for k in got.keys() | want.keys())
        sizes = []
        _exchanges(g._jdf.queryExecution().executedPlan(), sizes)
        held = blocks.cells.agg(F.sum(F.size("val"))).first()[0]
        assert held == 24_000 and sum(s[1] for s in sizes) < 24 * held       # less than the entries themselves
    finally:
        restore()
        blocks.release()
        rows.unpersist()


def test_blocked_training_holds_a_constant_number_of_tables(spark, sf):
    """Cached tables do not grow with the iterations."""
    from sparsegrad.plans import blocked
    rows = fx.sparse_rows(spark, sf)
    d, n = fx.max_feature_id(rows), rows.count()
    held, once = [], blocked.FeatureBlocks.gradient

    def counted(self, *args):
        out = once(self, *args)
        held.append(spark.sparkContext._jsc.getPersistentRDDs().size())
        return out

    blocked.FeatureBlocks.gradient = counted
    try:
        before = spark.sparkContext._jsc.getPersistentRDDs().size()
        m = trainers.train_gd(rows, d, 10, fit_bias=True, w_step=-1.0 / n, b_step=-1.0 / n, max_weights=3, block_size=9)
    finally:
        blocked.FeatureBlocks.gradient = once
    assert len(held) == 10 and max(held[2:]) <= held[1]
    m.release()
    spark.sparkContext._jvm.System.gc()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before + 1


def test_row_operators_over_blocks(spark, sf):
    """Scores and row gradients from the placed cells, repeated ids, empty
    vectors and rows outside the active ones included."""
    twice = F.concat(F.array(F.struct(F.lit(1).cast("bigint").alias("idx"), F.lit(0.5).alias("val"))), F.col("features"))
    rows = fx.sparse_rows_with_empty(spark, sf).withColumn("features", F.when(F.size("features") > 0, twice).otherwise(F.col("features")))
    rows = rows.withColumn("p", (F.col("row_id") % 7) / 7.0)
    d = fx.max_feature_id(rows)
    w = fx.fx_weights(spark, d)
    blocks = linear.placed(rows, d, block_size=11, cell_entries=500)
    key = lambda df: sorted((r["row_id"], round(r["score"], 9)) for r in df.collect())
    assert key(linear.sparse_scores(rows, w, 0.2, blocks=blocks)) == key(linear.sparse_scores(rows, w, 0.2))
    for part in (rows, rows.where("p > 0.5")):
        kw = dict(coef=linear.primal_coef, with_bias=True, weight="p")
        both = [sorted((r["row_id"], r["idx"], round(r["g"], 9)) for r in linear.sparse_row_gradients(part, w, 0.2, blocks=x, **kw).collect())
                for x in (None, blocks)]
        assert both[0] == both[1]
    blocks.release()
    with pytest.raises(ValueError, match="feature ids"):
        linear.placed(rows, d - 1)


def test_small_blocks_send_packed_records(spark):
    """Each entry of a row in a cell of its own: an iteration sends records of
    rows and of (cell, group) pairs, not one for each entry."""
    from sparsegrad.plans import rowlocal
    from sparsegrad.plans.blocked import FeatureBlocks
    n, width = 5000, 12
    feats = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.struct(
        (k * 7 + 1 + F.pmod(F.xxhash64("id", k), F.lit(7))).alias("idx"), ((k + 1) / 8.0).alias("val")))
    rows = spark.range(n).select(F.col("id").alias("rid"), F.when(F.col("id") % 3 == 0, 1.0).otherwise(-1.0).alias("y"),
                                 feats.alias("features")).persist()
    d = 7 * width
    blocks = FeatureBlocks(rows, d, block_size=7)
    w = fx.fx_weights(spark, d)
    g = blocks.gradient(rows.select("rid", "y"), w, 0.2, linear.gd_coef)
    got = {r["idx"]: r["g"] for r in g.collect()}
    sent = _records_written(g._jdf.queryExecution().executedPlan())
    got_scores = {r["rid"]: r["score"] for r in blocks.scores(rows.select("rid"), w, 0.2).collect()}
    scores = blocks.scores(rows.select("rid"), w, 0.2)
    scores.count()
    sent += _records_written(scores._jdf.queryExecution().executedPlan())
    assert blocks.cells.count() == width and sent and max(sent) <= max(n, width * blocks.n_groups) < n * width
    want = {r["idx"]: r["g"] for r in linear.gradient(rows, w, 0.2, d=d).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in got)
    want = {r["rid"]: r["score"] for r in rowlocal.with_scores(rows, rowlocal.weight_array(w, d), 0.2).collect()}
    assert got_scores.keys() == want.keys() and all(abs(got_scores[k] - want[k]) < 1e-9 for k in want)
    blocks.release()
    rows.unpersist()


def test_postings_sort_only_rows_out_of_order(monkeypatch):
    """Rows whose ids rise are taken as they are; others, and repeated ids, are
    ordered and keep the first value."""
    import numpy as np
    import pyarrow as pa
    from sparsegrad.plans import featureindex
    kind = pa.list_(pa.struct([("idx", pa.int64()), ("val", pa.float64())]))

    def postings(*features):
        batch = pa.RecordBatch.from_arrays(
            [pa.array(range(len(features)), pa.int64()), pa.array([1.0] * len(features)),
             pa.array([[{"idx": i, "val": v} for i, v in f] for f in features], kind)], names=["row_id", "y", "features"])
        out = pa.Table.from_batches(featureindex._postings(iter([batch]))).to_pylist()
        return [(r["row_id"], r["idx"], r["val"]) for r in out]

    assert postings([(5, 1.0), (2, 2.0), (5, 3.0)], [], [(1, 4.0), (1, 5.0)]) == [(0, 2, 2.0), (0, 5, 1.0), (2, 1, 4.0)]
    calls, lexsort = [], np.lexsort
    monkeypatch.setattr(featureindex.np, "lexsort", lambda keys: calls.append(1) or lexsort(keys))
    assert postings([(2, 2.0), (5, 1.0)], [], [(1, 4.0)], [(1, 6.0)]) == [(0, 2, 2.0), (0, 5, 1.0), (2, 1, 4.0), (3, 1, 6.0)]
    assert not calls


def _exchanges(plan, out):
    """(records, bytes) written by each shuffle of an executed plan, outermost
    first, not descending into cached tables."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _exchanges(plan.executedPlan(), out)
    if name.endswith("QueryStageExec"):
        return _exchanges(plan.plan(), out)
    if name == "ShuffleExchangeExec":
        m = plan.metrics()
        out.append((m.apply("shuffleRecordsWritten").value(), m.apply("shuffleBytesWritten").value()))
    kids = plan.children()
    for i in range(kids.size()):
        _exchanges(kids.apply(i), out)


def _records_written(plan):
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _records_written(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return _records_written(plan.plan())
    out = [0]
    if name == "ShuffleExchangeExec":
        out.append(plan.metrics().apply("shuffleRecordsWritten").value())
    kids = plan.children()
    return out + [x for i in range(kids.size()) for x in _records_written(kids.apply(i))]


ROWS = "row_id bigint, y double, features array<struct<idx:bigint,val:double>>"


def test_ids_above_d_raise_in_every_trainer(spark):
    rows = spark.createDataFrame([(1, 1.0, [(4, 1.0)]), (2, -1.0, [(1, 1.0)])], ROWS)
    for run in (lambda: trainers.train_gd(rows, 3, 1), lambda: trainers.train_gd(rows, 3, 1, fit_bias=True),
                lambda: trainers.train_gd(rows, 3, 1, max_weights=0),
                lambda: trainers.train_primal_dual(rows, 3, 1, eta=0.1, r=0, u=0.5),
                lambda: trainers.train_sampled(rows, 3, 1, u_rows=0.5, u_features=0.5)):
        with pytest.raises(ValueError, match="feature ids"):
            run()


def test_repeated_row_ids(spark):
    rows = spark.createDataFrame([(1, 1.0, [(1, 1.0)]), (1, 1.0, [(2, 2.0)]), (2, -1.0, [])], ROWS)
    m = trainers.train_gd(rows, 2, 1, fit_bias=True)       # row ids are not read
    assert [r["w"] for r in m.weights.orderBy("idx").collect()] == [0.5, 1.0]
    for run in (lambda: trainers.train_primal_dual(rows, 2, 1, eta=0.1, r=0, u=0.5),
                lambda: trainers.train_sampled(rows, 2, 1, u_rows=0.5, u_features=0.5)):
        with pytest.raises(ValueError, match="row ids repeat"):
            run()


def test_active_rows_split_during_training(spark, sf):

    rows = fx.sparse_rows_with_empty(spark, sf)
    d, n = fx.max_feature_id(rows), rows.count()
    r = math.isqrt(n)
    active = []
    for iters in (1, 2):
        m = trainers.train_primal_dual(rows, d, iters, eta=0.15, r=r, u=0.37, w_step=1.0, b_step=1.0 / n)
        active.append(m.p.where(F.col("p") > r / n).count())
        assert m.weights.where("w != 0").count() > 0
    assert any(0 < a < n for a in active)


def test_released_model_stays_readable(spark, sf):
    rows = fx.sparse_rows(spark, sf)
    m = trainers.train_gd(rows, fx.max_feature_id(rows), 3, fit_bias=True, checkpoint_every=2)
    before = sorted(map(tuple, m.weights.collect()))
    m.release()
    assert sorted(map(tuple, m.weights.collect())) == before


def test_plain_text_to_model_file(spark, sf, scratch):
    from sparsegrad.sources import text
    rows = fx.sparse_rows(spark, sf)
    d, n = fx.max_feature_id(rows), rows.count()
    text.render_plain(rows).write.text(f"{scratch}/plain")
    parsed = text.parse_plain(text.scan_lines(spark, f"{scratch}/plain"))
    assert "row_id" not in parsed.columns
    kw = dict(fit_bias=True, w_step=-1.0 / n, b_step=-1.0 / n)
    trainers.train_gd(parsed, d, 2, **kw).save(f"{scratch}/plainmodel")
    back = {r["idx"]: r["w"] for r in model_io.read_model_text(spark, f"{scratch}/plainmodel").collect()}
    ref = trainers.train_gd(rows, d, 2, **kw)
    assert all(abs(back[r["idx"]] - r["w"]) < 1e-12 for r in ref.weights.collect()) and abs(back[d + 1] - ref.b) < 1e-12


def test_dense_rows_train_without_exploding(spark, sf):
    rows = fx.dense_rows(spark, sf)
    g = linear.gradient(rows, fx.fx_weights(spark, 64), 0.0, d=64)
    assert "inline" not in g._jdf.queryExecution().toString() and "explode" not in g._jdf.queryExecution().toString()
    sparse = linear.gradient(text_sparse(rows), fx.fx_weights(spark, 64), 0.0, d=64)
    a, b = ({r["idx"]: r["g"] for r in x.collect()} for x in (g, sparse))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)
    with pytest.raises(Exception, match="dense row"):
        linear.gradient(rows, fx.fx_weights(spark, 63), 0.0, d=63).collect()


def text_sparse(rows):
    from sparsegrad.sources.text import dense_to_sparse
    return dense_to_sparse(rows)


def _hash_exchanges(plan):
    """Hash-partitioning exchanges of an executed plan, not descending into
    cached relations (their own build plans)."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _hash_exchanges(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return _hash_exchanges(plan.plan())
    n = 1 if name == "ShuffleExchangeExec" and "hashpartitioning" in plan.outputPartitioning().toString().lower() \
        else 0
    kids = plan.children()
    return n + sum(_hash_exchanges(kids.apply(i)) for i in range(kids.size()))


def test_row_state_join_is_a_zip(spark, sf):
    # the per-row state keeps the rows' partitioning across checkpoints:
    # joining it back to the cached rows needs no exchange
    from sparsegrad.plans.lineage import IterationState
    from sparsegrad.sources.text import cache_points
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        R = cache_points(fx.sparse_rows(spark, sf))
        st = IterationState()
        P = st.put("P", R.select("row_id", F.lit(1.0).alias("p")), 1)
        P = st.put("P", R.join(P, "row_id").select("row_id", (F.col("p") * 2).alias("p")), 2)
        q = R.join(P, "row_id").select(F.sum("p").alias("s"))
        assert q.first()["s"] == 2.0 * R.count()
        assert _hash_exchanges(q._jdf.queryExecution().executedPlan()) == 0
        # a full gradient pass: the only hash exchange is the one on idx
        d = fx.max_feature_id(R)
        g = linear.gradient(R.join(P, "row_id"), fx.fx_weights(spark, d), 0.1, coef=linear.primal_coef,
                            weight="p", d=d)
        g.collect()
        assert _hash_exchanges(g._jdf.queryExecution().executedPlan()) == 1
        # persisted only (between checkpoints): still a zip
        st2 = IterationState(every={"P": 5})
        Q = st2.put("P", R.select("row_id", F.lit(1.0).alias("p")), 1)
        Q = st2.put("P", R.join(Q, "row_id").select("row_id", (F.col("p") * 3).alias("p")), 2)
        q3 = R.join(Q, "row_id").select(F.sum("p").alias("s"))
        assert q3.first()["s"] == 3.0 * R.count()
        assert _hash_exchanges(q3._jdf.queryExecution().executedPlan()) == 0
        st2.release()
        # without the state store's static planning the state is re-shuffled
        P2 = R.select("row_id", F.lit(1.0).alias("p")).persist()
        P2 = P2.checkpoint(eager=True)
        q2 = R.join(P2, "row_id").select(F.sum("p").alias("s"))
        q2.first()
        assert _hash_exchanges(q2._jdf.queryExecution().executedPlan()) >= 1
        st.release()
        R.unpersist()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_weights_from_history_equal_stored_weights(spark, sf):
    """p from the scalar history against a table of p that the operators
    update pair by pair: repeated ids in a row, empty rows, steps with and
    without a feature term, clipped and not, one feature drawn often."""
    from sparsegrad.operators import dual
    from sparsegrad.operators import update as U
    from sparsegrad.plans.history import DualHistory
    twice = F.concat("features", F.transform(F.slice("features", 1, 1), lambda f: F.struct(f["idx"], (f["val"] + 1).alias("val"))))
    rows = fx.sparse_rows_with_empty(spark, sf).withColumn("features", twice).persist()
    n = rows.count()
    for clip in (None, 0.6):
        history = DualHistory(0.15, clip, n ** -0.5)
        P = U.initial_p(rows.select("row_id"), n)
        for j, w_j, norm_sq, b in ((5, 0.3, 2.0, 0.7), (None, 0.0, 0.0, -1.0), (2, -0.1, 1.0, 0.0), (5, 0.2, 1.5, 1.0), (5, 0.0, 1.0, 0.4)):
            history.add(j, w_j, norm_sq, b)
            pairs = dual.factors(rows, j or 0, w_j, norm_sq, b, 0.15, clip)
            P, _ = U.normalise(U.apply_factors(P, pairs))
            sums = history.totals(rows)
            after = history.normalise(sums)
            assert sums.n == n and abs(after.squares - 1.0) < 1e-12
        want = {r["row_id"]: r["p"] for r in P.collect()}
        got = {r["row_id"]: r["p"] for r in history.with_p(rows).select("row_id", "p").collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-13 for k in want)
    rows.unpersist()


def test_row_draws_by_history(spark, sf, monkeypatch):
    """Every draw finds the row that the running sum gives, also where the
    bins have to be cut again and where ids leave large gaps."""
    from sparsegrad.plans import history as H
    rows = fx.sparse_rows(spark, sf).withColumn("row_id", F.when(F.col("row_id") % 50 == 0, F.col("row_id") * 10 ** 9).otherwise(F.col("row_id"))).persist()
    n = rows.count()
    h = H.DualHistory(0.15, 1.0, n ** -0.5)
    h.add(3, 0.2, 1.0, 1.0)
    monkeypatch.setattr(H, "LAST_ROWS", 100)
    monkeypatch.setattr(H, "BINS", 16)
    p = sorted((r["row_id"], r["p"]) for r in h.with_p(rows).collect())
    low, high = p[0][0], p[-1][0]
    sums = h.totals(rows, low, -(-(high - low + 1) // 16))
    total = sum(x * x for _, x in p)
    assert abs(sums.squares - total) < 1e-9
    sums = h.normalise(sums)
    p, total = [(i, x / total ** 0.5) for i, x in p], 1.0
    for u in (0.0, 0.2, 0.61, 0.95, 0.99999, 1.0):
        run, want = 0.0, p[-1][0]
        for i, x in p:
            run += x * x
            if run > u * total:
                want = i
                break
        assert h.draw(rows, sums, u)["row_id"] == want
    rows.unpersist()


def test_raced_draws_follow_the_weights(spark):
    from sparsegrad.operators import sample
    weights = [1.0, 2.0, 0.0, 4.0, 3.0]
    df = spark.createDataFrame([(i + 1, w) for i, w in enumerate(weights)], "id bigint, w double")
    got = [r["id"] for r in sample.race_draws(df, "id", "w", 5, 1000).collect()]
    for i, w in enumerate(weights):
        assert abs(got.count(i + 1) / 1000 - w / 10) < 4 * math.sqrt(0.25 / 1000)
    assert sample.race_draws(df.where("w = 0"), "id", "w", 5, 2).collect() == [(0, None), (1, None)]
    spread = df.repartition(5)
    assert [r["id"] for r in sample.race_draws(spread, "id", "w", 5, 1000).collect()] == got


def test_many_raced_draws_race_few_rows(spark, monkeypatch):
    """The winners are those of a plain race; a draw works out the race of a
    few rows, and one without such a row races all of them."""
    from sparsegrad.operators import sample
    rows = [(i, 10.0 ** (i % 7 - 3) if i % 11 else 0.0) for i in range(4000)] + [(4001, None)]
    df = spark.createDataFrame(rows, "id bigint, w double")
    total = sum(w or 0 for _, w in rows)
    raced = sample._race_rows(df.selectExpr("id AS _key", "w AS _w").where("_w > 0"), 5, list(range(50)), 32.0 / total)
    assert 50 * 10 < raced.count() < 50 * 100

    def plain(k):
        race = lambda i, w: -math.log1p(-int(hashlib.md5(f"5:{k}:{i}".encode()).hexdigest()[:13], 16) / 2 ** 52) / w
        return min((race(i, w), i) for i, w in rows if w)[1]

    want = [plain(k) for k in range(50)]
    for left in (32.0, 0.5):                      # half a row on average: many draws race all rows
        monkeypatch.setattr(sample, "RACE_LEFT", left)
        assert [tuple(r) for r in sample.race_draws(df, "id", "w", 5, 50).collect()] == list(enumerate(want))


def test_raced_trainers_run_no_draw_jobs(spark, sf, monkeypatch):
    """With a seed the draws ride along with the jobs that write W and sum p;
    the same seed gives the same model, in any partitions."""
    from sparsegrad.operators import sample
    from sparsegrad.plans.history import DualHistory

    def no_job(*args, **kw):
        raise AssertionError("a draw job")

    monkeypatch.setattr(sample, "sample_one", no_job)
    monkeypatch.setattr(DualHistory, "draw", no_job)
    rows = fx.sparse_rows(spark, sf)
    d, n = fx.max_feature_id(rows), rows.count()
    key = lambda m: (m.trace and [(t["j"], t.get("i")) for t in m.trace], {r["idx"]: round(r["w"], 9) for r in m.weights.collect()})
    for train in (lambda rows: trainers.train_primal_dual(rows, d, 3, eta=0.15, r=0, seed=3, w_step=1.0, b_step=1.0 / n),
                  lambda rows: trainers.train_sampled(rows, d, 3, seed=3)):
        assert key(train(rows)) == key(train(rows.repartition(3)))
    with pytest.raises(ValueError, match="draws or a seed"):
        trainers.train_primal_dual(rows, d, 1, eta=0.15, r=0)


def test_one_id_with_many_rows_is_drawn(spark):
    """A single id that holds more rows than the last step reads ends the search."""
    from sparsegrad.operators import sample
    df = spark.range(20_000).select(F.lit(7).cast("bigint").alias("id"), F.lit(1.0).alias("w"))
    assert sample.sample_one(df, "id", "w", 0.5) == 7
    assert sample.sample_one(df.unionByName(spark.range(3).selectExpr("id", "1.0D AS w")), "id", "w", 0.5) == 7


def test_text_to_model_end_to_end(spark, sf, scratch):
    # the reference's workflow: indexed text lines -> parse -> train -> model file
    from sparsegrad.sources import text
    rows = fx.sparse_rows(spark, sf)
    d = fx.max_feature_id(rows)
    n = rows.count()
    text.render_indexed(rows).write.text(f"{scratch}/lines")
    parsed = text.parse_indexed(text.scan_lines(spark, f"{scratch}/lines"))
    kw = dict(eta=0.15, r=0, u=0.37, w_step=1.0, b_step=1.0 / n)
    m = trainers.train_primal_dual(parsed, d, 2, **kw)
    ref = trainers.train_primal_dual(rows, d, 2, **kw)
    m.save(f"{scratch}/model")
    back = {r["idx"]: r["w"] for r in model_io.read_model_text(spark, f"{scratch}/model").collect()}
    exp = {r["idx"]: r["w"] for r in ref.weights.collect()}
    assert len(back) == d + 1
    assert all(abs(back[k] - exp[k]) < 1e-12 for k in exp)
    assert abs(back[d + 1] - ref.b) < 1e-12


def _history_steps():
    return ((5, 0.3, 2.0, 0.7), (None, 0.0, 0.0, -1.0), (2, -0.1, 1.0, 0.0), (5, 0.2, 1.5, 1.0), (5, 0.0, 1.0, 0.4),
            (999_999, 0.4, 1.0, 0.2), (3, 0.5, 1.0, -0.3))


def _carried_equals_passes(rows, width, steps, **settings):
    from sparsegrad.plans.featureindex import CarriedSums
    from sparsegrad.plans.history import DualHistory
    n = rows.count()
    plain, h = DualHistory(0.15, 0.9, n ** -0.5), DualHistory(0.15, 0.9, n ** -0.5)
    carried = CarriedSums(rows, h, 1, width)
    for step in steps:
        plain.add(*step)
        h.add(*step)
        want, got = plain.totals(rows, 1, width), carried.step()
        assert got.n == want.n == n
        assert abs(got.squares - want.squares) < 1e-12 and abs(got.labels - want.labels) < 1e-9
        assert [(b[0], *b[2:]) for b in got.bins] == [(b[0], *b[2:]) for b in want.bins]
        assert all(abs(a[1] - b[1]) < 1e-12 for a, b in zip(got.bins, want.bins))
        plain.normalise(want)
        after = carried.normalise(got)
        assert abs(after.squares - 1.0) < 1e-12 and abs(h.log_norms - plain.log_norms) < 1e-12
    return carried


def test_sums_carried_by_the_feature_index(spark, sf):
    """Sums after each dual step against passes over all rows: repeated ids in
    a row, empty rows, no feature term, a feature that no row holds, one drawn
    often, other labels than -1 and 1."""
    twice = F.concat("features", F.transform(F.slice("features", 1, 1), lambda f: F.struct(f["idx"], (f["val"] + 1).alias("val"))))
    rows = fx.sparse_rows_with_empty(spark, sf).withColumn("features", twice)
    rows = rows.withColumn("y", F.when(F.col("row_id") % 11 == 0, 0.5).otherwise(F.col("y"))).persist()
    for width in (None, 300):
        carried = _carried_equals_passes(rows, width, _history_steps())
        assert carried.passes < 1 + len(_history_steps())
    rows.unpersist()


def test_carried_sums_fall_back_to_passes(spark, sf, monkeypatch):
    """Many labels; a feature that all rows but an almost weightless one hold;
    a pass every few steps."""
    from sparsegrad.plans import featureindex as FI
    rows = fx.sparse_rows(spark, sf).withColumn("y", (F.col("row_id") % 100) / 50.0).persist()
    carried = _carried_equals_passes(rows, None, _history_steps())
    assert carried.index is None
    rows.unpersist()
    # rows 1..40 hold feature 1; row 41 alone does not and loses its weight
    data = [(i, 1.0, [(1, 2.0)]) for i in range(1, 41)] + [(41, 1.0, [(2, 3.0)])]
    rows = spark.createDataFrame(data, ROWS).persist()
    steps = [(2, 1.0, 1.0, 0.0)] * 4 + [(1, 1.0, 1.0, 0.0)] * 2
    monkeypatch.setattr(FI, "LEAST_REST", 0.02)
    carried = _carried_equals_passes(rows, None, steps)
    assert 1 < carried.passes <= 3
    monkeypatch.setattr(FI, "EXACT_EVERY", 2)
    monkeypatch.setattr(FI, "LEAST_REST", 0.0)
    assert _carried_equals_passes(rows, None, steps[:4]).passes == 1 + 2
    rows.unpersist()


def test_dual_steps_read_only_rows_of_drawn_features(spark):
    """Files opened and rows read by a look-up grow with the feature, not with the rows."""
    from sparsegrad.plans.featureindex import CarriedSums, FeatureIndex
    from sparsegrad.plans.history import DualHistory
    rows = _scattered_rows(spark).withColumnRenamed("rid", "row_id").persist()
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")    # as for data of some size
    try:
        index = FeatureIndex(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    entries = rows.select(F.inline("features")).groupBy("idx").count()
    assert index.table.count() == rows.select("row_id", F.inline("features")).select("row_id", "idx").distinct().count()
    j = entries.where("idx != 7 AND count > 1").first()["idx"]
    assert index.postings([j]).count() == rows.where(F.exists("features", lambda f: f["idx"] == j)).count()
    plan = index.postings([j])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*part", plan) and len([p for p in index.parts if p[1] <= j <= p[2]]) <= 2
    assert len(index.parts) == 8
    assert len([p for p in index.parts if p[1] <= 7 <= p[2]]) >= 2              # the hot feature spans several files
    h = DualHistory(0.15, None, 4000 ** -0.5)
    carried = CarriedSums(rows, h)
    h.add(j, 0.3, 1.0, 0.5)
    carried.normalise(carried.step())
    assert carried.passes == 1 and 2 <= carried.read < 20
    rows.unpersist()


def test_indexed_trainers_equal_the_others(spark, sf):
    rows = fx.sparse_rows_with_empty(spark, sf)
    d, n = fx.max_feature_id(rows), rows.count()
    how = dict(eta=0.15, r=math.isqrt(n), u=0.37, w_step=1.0, b_step=1.0 / n)
    for train in (lambda **k: trainers.train_primal_dual(rows, d, 4, **how, **k),
                  lambda **k: trainers.train_sampled(rows, d, 4, u_rows=[0.1, 0.61, 0.9, 0.33], u_features=0.37, **k)):
        a, b = train(), train(feature_index=True)
        assert [(t["j"], t.get("i")) for t in a.trace] == [(t["j"], t.get("i")) for t in b.trace]
        for x, y, key in ((a.weights, b.weights, "idx"), (a.p, b.p, "row_id")):
            x, y = ({r[0]: r[1] for r in df.select(key, df.columns[-1]).collect()} for df in (x, y))
            assert x.keys() == y.keys() and all(abs(x[k] - y[k]) < 1e-10 for k in x)
    with pytest.raises(ValueError, match="raced row draws"):
        trainers.train_sampled(rows, d, 1, seed=1, feature_index=True)
