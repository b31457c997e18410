"""Operator invariants against brute force (numpy over collected small fixtures)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsegrad.functions import scalar as S
from sparsegrad.operators import dual, linear, norms, sample, update
from sparsegrad.plans import joins, rowlocal
from sparsegrad.sources import fixtures as fx


def _dense(rows, d):
    out = {}
    for r in rows.collect():
        x = np.zeros(d + 1)
        for f in r["features"]:
            x[f["idx"]] += f["val"]
        out[r["row_id"]] = (r["y"], x)
    return out


def test_gradient_matches_brute_force(spark, sf):
    rows = fx.sparse_rows_with_empty(spark, sf)
    d = fx.max_feature_id(rows)
    w = fx.fx_weights(spark, d)
    wv = np.zeros(d + 1)
    for r in w.collect():
        wv[r["idx"]] = r["w"]
    b = 0.25
    g = {r["idx"]: r["g"] for r in linear.gradient(rows, w, b, d=d).collect()}
    exp = np.zeros(d + 1)
    exp0 = 0.0
    for y, x in _dense(rows, d).values():
        s = x @ wv + b
        c = (1 / (1 + math.exp(-y * s)) - 1) * y
        exp += c * x
        exp0 += c
    assert abs(g[0] - exp0) < 1e-9
    for i in range(1, d + 1):
        assert abs(g.get(i, 0.0) - exp[i]) < 1e-9


def test_row_gradients_sum_to_aggregate(spark, sf):
    rows = fx.sparse_rows(spark, sf)
    d = fx.max_feature_id(rows)
    w = fx.fx_weights(spark, d)
    per_row = linear.sparse_row_gradients(rows, w, 0.25, with_bias=True, d=d)
    a = {r["idx"]: r["g"] for r in linear.sparse_sum(per_row).collect()}
    b = {r["idx"]: r["g"] for r in linear.gradient(rows, w, 0.25, d=d).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_partition_count_independent(spark, sf):
    rows = fx.sparse_rows(spark, sf)
    d = fx.max_feature_id(rows)
    w = fx.fx_weights(spark, d)
    g1 = {r["idx"]: r["g"] for r in linear.gradient(rows.repartition(1), w, 0.1, d=d).collect()}
    g2 = {r["idx"]: r["g"] for r in linear.gradient(rows.repartition(13), w, 0.1, d=d).collect()}
    assert all(abs(g1[k] - g2[k]) < 1e-9 for k in g1)


def test_skew_split_join_equals_plain_join(spark):
    # one key holds far more than a third of the rows
    big = spark.range(30000).select((F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50)).alias("idx"),
                                    F.col("id").alias("row_id"))
    lookup = spark.range(0, 50).select(F.col("id").alias("idx"), (F.col("id") * 0.5).alias("w"))
    split = joins.lookup_join(big, lookup, "idx", "left", max_broadcast_rows=10)
    plain = big.join(lookup, "idx", "left")
    key = lambda df: sorted((r["row_id"], r["idx"], r["w"]) for r in df.collect())
    assert key(split) == key(plain)


def test_dual_factor_bounds_and_p_norm(spark, sf):
    rows = fx.with_fxp_weights(fx.sparse_rows(spark, sf))
    d = fx.max_feature_id(rows)
    w = fx.fx_weights(spark, d)
    norm_sq = norms.sum_squares(w, "w")
    w_j = w.where("idx = 5").first()["w"]
    f = dual.factors(rows, 5, w_j, norm_sq, 0.25, 0.15)
    assert f.agg(F.min("factor")).first()[0] >= 0.75 - 1e-12
    fc = dual.factors(rows, 5, w_j, norm_sq, 0.25, 0.15, clip=1 / 0.15)
    assert fc.agg(F.max("factor")).first()[0] <= 3.0 + 1e-12
    p, _ = update.normalise(update.apply_factors(rows.select("row_id", "p"), f))
    assert abs(p.agg(F.sum(F.col("p") * F.col("p"))).first()[0] - 1.0) < 1e-12
    assert p.agg(F.min("p")).first()[0] > 0
    chk = dual.count_check(f, rows.count()).first()
    assert chk["ok"] == 1


def test_apply_factors_duplicates_multiply(spark):
    p = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "row_id bigint, p double")
    pairs = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 0.5)], "row_id bigint, factor double")
    got = {r["row_id"]: r["p"] for r in update.apply_factors(p, pairs).collect()}
    assert got == {1: 6.0, 2: 1.0, 3: 3.0}


def test_first_match_lookup(spark):
    rows = spark.createDataFrame([(1, 1.0, [(3, 1.0), (5, 2.0), (5, 9.0)]), (2, 1.0, [])],
                                 "row_id bigint, y double, features array<struct<idx:bigint,val:double>>")
    got = {r["row_id"]: r["x_j"] for r in dual.feature_value(rows, 5).collect()}
    assert got == {1: 2.0, 2: 0.0}


def test_sampling_frequencies(spark):
    w = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, -2.0), (4, 0.0), (5, 1.0)], "idx bigint, w double")
    draws = spark.range(2000).select(F.col("id").alias("draw"), S.seeded_uniform(F.lit(7), F.col("id")).alias("u"))
    got = sample.sample_by_weight(w, "idx", F.col("w") * F.col("w"), draws)
    counts = {r["idx"]: r["n"] for r in got.groupBy("idx").agg(F.count("*").alias("n")).collect()}
    assert set(counts) <= {2, 3, 5}                       # zero weights never drawn
    assert abs(counts[3] / 2000 - 4 / 6) < 0.05
    assert abs(counts[2] / 2000 - 1 / 6) < 0.05


def test_two_level_prefix_sum_matches_numpy(spark):
    df = spark.range(1, 5001).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("v"))
    cum = {r["k"]: r["cum"] for r in sample.cumulative(df, "k", F.col("v")).collect()}
    v = np.array([(k % 7) for k in range(1, 5001)], dtype=float)
    exp = np.cumsum(v)
    assert all(abs(cum[k] - exp[k - 1]) < 1e-6 for k in range(1, 5001))
    for u in (0.0, 0.123, 0.5, 0.999):
        assert sample.sample_one(df, "k", F.col("v"), u) == int(np.argmax(exp > u * exp[-1])) + 1


def test_outlier_id_does_not_fill_one_range(spark, monkeypatch):
    monkeypatch.setattr(sample, "RANGE_ROWS", 5000)
    ids = spark.range(1, 60001).union(spark.range(2 ** 50, 2 ** 50 + 1))
    df = ids.select(F.col("id").alias("k"), F.lit(1.0).alias("v"))
    rows, _, _, _ = sample._ranged(df, "k", "v")
    sizes = [r["count"] for r in rows.groupBy("_range").count().collect()]
    assert len(sizes) >= 10 and max(sizes) < 15000
    assert sample.sample_one(df, "k", F.col("v"), 0.5) == 30001
    assert sample.sample_one(df, "k", F.col("v"), 0.999999) == 2 ** 50


def _plan_names(plan):
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _plan_names(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return _plan_names(plan.plan())
    kids = plan.children()
    label = f"{name} {plan.outputPartitioning().toString()}" if name == "ShuffleExchangeExec" else name
    return [label] + [x for i in range(kids.size()) for x in _plan_names(kids.apply(i))]


def test_million_draws_on_one_id_are_spread(spark):
    df = spark.range(1, 2001).select(F.col("id").alias("k"), F.when(F.col("id") == 7, 1e9).otherwise(1.0).alias("v"))
    draws = spark.range(1_000_000).select(F.col("id").alias("draw"), ((F.col("id") + 0.5) / 1e6).alias("u"))
    got = sample.sample_by_weight(df, "k", F.col("v"), draws)
    heavy = got.groupBy("k").count().where("k = 7").first()["count"]
    assert heavy > 999_000
    assert not any("SinglePartition" in x for x in _plan_names(got._jdf.queryExecution().executedPlan()))
    shares = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(shares) > 3                                  # ten salts over the tasks


def test_gradient_is_one_exchange_without_sort(spark, sf):
    rows = fx.sparse_rows(spark, sf).persist()
    d = fx.max_feature_id(rows)
    g = linear.gradient(rows, fx.fx_weights(spark, d), 0.25, d=d)
    g.collect()
    names = _plan_names(g._jdf.queryExecution().executedPlan())
    assert sum(x.startswith("ShuffleExchange") for x in names) == 1
    assert not any(x.startswith(("Sort", "Window")) for x in names)
    rows.unpersist()


def test_rows_that_share_an_id_keep_their_own_scores(spark):
    rows = spark.createDataFrame([(1, 1.0, [(1, 1.0)]), (1, -1.0, [(2, 1.0)]), (2, 1.0, [])],
                                 "row_id bigint, y double, features array<struct<idx:bigint,val:double>>")
    w = spark.createDataFrame([(1, 2.0), (2, 5.0)], "idx bigint, w double")
    assert sorted(r["score"] for r in linear.sparse_scores(rows, w, 0.5).collect()) == [0.5, 2.5, 5.5]


def test_ids_outside_the_weights_raise(spark):
    rows = spark.createDataFrame([(1, 1.0, [(4, 1.0)])],
                                 "row_id bigint, y double, features array<struct<idx:bigint,val:double>>")
    w = fx.fx_weights(spark, 3)
    g = spark.createDataFrame([(4, 1.0)], "idx bigint, g double")
    for run in (lambda: linear.sparse_scores(rows, w, 0.0).collect(),
                lambda: linear.sparse_scores(rows, w, 0.0, max_weights=1).collect(),
                lambda: linear.gradient(rows, w, 0.0).collect(),
                lambda: update.apply_gradient(w, g, 1.0).collect(),
                lambda: update.gradient_step(w, g, 1.0, 0.0, 1.0).collect(),
                lambda: update.single_row_step(rows, w, 0.0, 1, 1.0).collect()):
        with pytest.raises(Exception, match="feature id"):
            run()


def test_scores_beyond_the_limit_equal_row_local_ones(spark, sf):
    rows = fx.sparse_rows_with_empty(spark, sf)
    d = fx.max_feature_id(rows)
    w = fx.fx_weights(spark, d)
    key = lambda df: {r["row_id"]: round(r["score"], 9) for r in df.collect()}
    assert key(linear.sparse_scores(rows, w, 0.25, d=d)) == key(linear.sparse_scores(rows, w, 0.25, d=d, max_weights=1))


def test_unit_weights_and_zero(spark):
    w = spark.createDataFrame([(1, 3.0), (2, 4.0)], "idx bigint, w double")
    got = {r["idx"]: r["w"] for r in norms.unit_weights(w).collect()}
    assert got == {1: 0.6, 2: 0.8}
    z = spark.createDataFrame([(1, 0.0)], "idx bigint, w double")
    assert norms.unit_weights(z).first()["w"] == 0.0


def test_logistic_overflow_is_zero(spark):
    v = spark.range(1).select(S.logistic_complement(F.lit(1000.0)).alias("g")).first()["g"]
    assert v == 0.0


def test_many_draws_in_one_bucket(spark):
    # all weight on one id: every draw lands in the same interval
    df = spark.range(1, 20001).select(F.col("id").alias("k"),
                                      F.when(F.col("id") == 777, 5.0).otherwise(0.0).alias("v"))
    draws = spark.range(5000).select(F.col("id").alias("draw"), (F.col("id") / 5000.0).alias("u"))
    got = sample.sample_by_weight(df, "k", F.col("v"), draws)
    assert got.count() == 5000
    assert {r["k"] for r in got.select("k").distinct().collect()} == {777}
    # u at the very end still returns the last id of non-zero weight
    edge = spark.range(1).select(F.lit(0).cast("bigint").alias("draw"), F.lit(0.9999999999999999).alias("u"))
    assert sample.sample_by_weight(df, "k", F.col("v"), edge).first()["k"] == 777


def test_row_form_equals_long_form(spark, sf):
    # scores from the row form (explode + lookup join + window) equal a
    # plain long-form aggregate over (row_id, idx, val) entries
    rows = fx.sparse_rows(spark, sf)
    d = fx.max_feature_id(rows)
    w = fx.fx_weights(spark, d)
    a = {r["row_id"]: r["score"] for r in linear.sparse_scores(rows, w, 0.25, d=d).collect()}
    long = fx.sparse_long(spark, sf).join(w, "idx")
    b = {r["row_id"]: r["s"] + 0.25 for r in long.groupBy("row_id").agg(F.sum(F.col("val") * F.col("w")).alias("s")).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_gradient_step_one_aggregate(spark):
    w = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "idx bigint, w double")
    g = spark.createDataFrame([(0, 10.0), (1, 1.0), (3, -1.0)], "idx bigint, g double")
    got = {r["idx"]: r["w"] for r in update.gradient_step(w, g, 0.5, 0.25, 2.0).collect()}
    assert got == {0: 0.25 + 20.0, 1: 1.5, 2: 2.0, 3: 2.5}
    # no bias part (no active rows): no idx 0 row, the bias stays with the caller
    g_empty_bias = g.where("idx > 0")
    got = {r["idx"]: r["w"] for r in update.gradient_step(w, g_empty_bias, 0.5, 0.25, 2.0).collect()}
    assert 0 not in got and got[1] == 1.5


def test_hot_key_holding_a_third_is_found(spark):
    # key 7 holds a third of the rows; every other key is rare
    big = spark.range(30000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") + 100).alias("idx"))
    assert [r["idx"] for r in joins.hot_keys(big, "idx").collect()] == [7]
    assert joins.hot_keys(big.where("idx > 100"), "idx").count() == 0


def test_partition_sizing_follows_advisory_size(spark):
    from sparsegrad.sources.text import sized_partitions
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1MB")
        n = sized_partitions(spark, 1_000_000, 10_000_000)   # ~200 MB of rows
        assert n == max(spark.sparkContext.defaultParallelism, -(-(48_000_000 + 160_000_000) // (1 << 20)))
        assert sized_partitions(spark, 10, 10) == spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)


def test_dense_sum_sends_one_vector_a_task(spark):
    from tests.test_trainers import _exchanges
    rows = spark.range(4000).repartition(5).select(
        (F.col("id") % 7 - 3.0).alias("c"), F.transform(F.sequence(F.lit(1), F.lit(30)), lambda k: (k * F.col("id") % 11).cast("double")).alias("x"))
    g = rowlocal.dense_sums(rows)
    got = {r["pos"]: r["g"] for r in g.collect()}
    want = [0.0] * 30
    for r in rows.collect():
        for k, v in enumerate(r["x"]):
            want[k] += r["c"] * v
    assert sorted(got) == list(range(30)) and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    sizes = []
    _exchanges(g._jdf.queryExecution().executedPlan(), sizes)
    assert sizes[0][0] <= 30 * 5
    exploded = linear.dense_sum(linear.dense_row_gradients(rows.withColumn("row_id", F.lit(1)), F.col("c")))
    assert all(abs(got[r["pos"]] - r["g"]) < 1e-9 for r in exploded.collect())
    assert rowlocal.dense_sums(rows.limit(0)).collect() == []
    with pytest.raises(Exception, match="dense row"):
        rowlocal.dense_sums(rows.limit(3).unionByName(spark.createDataFrame([(1.0, [1.0])], "c double, x array<double>")).coalesce(1)).collect()


def test_nothing_stays_cached_behind_the_caller(spark):
    """Operators that read a small table several times leave no cached copy."""
    from sparsegrad.operators import sample
    from sparsegrad.plans import joins
    spark.sparkContext._jvm.System.gc()
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    df = spark.range(500).select(F.col("id"), (F.col("id") + 1.0).alias("w"))
    draws = spark.range(20).select(F.col("id").alias("draw"), (F.col("id") / 20.0).alias("u"))
    assert sample.sample_by_weight(df, "id", "w", draws).count() == 20
    big = spark.range(3000).select((F.col("id") % 4).alias("id"), F.lit(1).alias("v"))
    assert joins.skew_split_join(big, df, "id").where("w IS NULL").count() == 0
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before


def test_sliced_sums_equal_sums_by_id(spark):
    """Slices of any width, in one and two levels, dense and sparse ones, a
    hot id, an id whose parts cancel out, rows and tasks without entries."""
    d = 5000
    pick = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.struct(
        F.when(k == 1, F.lit(1).cast("bigint")).when(F.col("id") < 1500, F.pmod(F.xxhash64("id", k), F.lit(300)) + 1)
        .otherwise(F.pmod(F.xxhash64("id", k), F.lit(d)) + 1).alias("idx"), (k / 8.0).alias("val")))
    rows = spark.range(0, 3000, 1, 24).select(
        "id", F.when(F.col("id") % 3 == 0, 1.0).otherwise(-1.0).alias("y"), pick.alias("features")).where("id > 200")
    rows = rows.unionByName(spark.range(2).select("id", F.lit(1.0).alias("y"), F.slice(pick, 1, 0).alias("features")))
    w = np.linspace(-1.0, 1.0, d + 1)
    want = {r["idx"]: r["g"] for r in rowlocal.gradient(rows, w, 0.3, rowlocal.gd_coefficients, width=0).collect()}
    for part in (rows, rows.coalesce(3)):
        for width in (64, 700, 8192):
            got = rowlocal.gradient(part, w, 0.3, rowlocal.gd_coefficients, width=width).collect()
            assert len(got) == len({r["idx"] for r in got})
            got = {r["idx"]: r["g"] for r in got}
            assert all(abs(got.get(k, 0.0) - want.get(k, 0.0)) < 1e-9 for k in got.keys() | want.keys()) and 0 in got
    assert rowlocal.gradient(rows.where("id < 0"), w, 0.3, rowlocal.gd_coefficients, width=64).collect() == []
    # the bias part is there even when it is zero
    none = rowlocal.gradient(rows, w, 0.3, lambda y, s: y * 0.0, width=64).collect()
    assert [tuple(r) for r in none] == [(0, 0.0)]


def test_sliced_sums_send_slices_not_ids(spark):
    from sparsegrad.plans import slices
    d, tasks = 60_000, 25
    feats = F.transform(F.sequence(F.lit(1), F.lit(200)), lambda k: F.struct(
        (F.pmod(F.xxhash64("id", k), F.lit(d)) + 1).alias("idx"), F.lit(1.0).alias("val")))
    rows = spark.range(0, 10_000, 1, tasks).select(F.lit(1.0).alias("y"), feats.alias("features"))
    g = rowlocal.gradient(rows, np.zeros(d + 1), 0.0, rowlocal.gd_coefficients)
    assert g.collect()
    written = []

    def walk(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(plan.plan())
        if name == "ShuffleExchangeExec":
            written.append(plan.metrics().apply("shuffleRecordsWritten").value())
        for i in range(plan.children().size()):
            walk(plan.children().apply(i))

    walk(g._jdf.queryExecution().executedPlan())
    n = -(-(d + 1) // slices.SLICE)
    # last level, first level: groups x slices and tasks x slices, not tasks x D
    assert written[0] <= slices.groups_of(tasks) * n and written[1] <= tasks * n
