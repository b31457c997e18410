"""Hard negatives against brute force over all pairs."""

import math
from itertools import islice

import numpy as np
import pyarrow as pa

from sparsegrad.llm import negatives

SCHEMA = "id long, label long, v array<float>, anchor boolean, cell int, uid string, shard string"


def brute(rows):
    """rows: (id, label, v, anchor); sorted result rows."""
    good = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None
            and all(x is not None and math.isfinite(x) for x in r[2])]
    vec = [[math.floor(256.0 * float(x)) for x in r[2]] for r in good]
    out = []
    for a, row in enumerate(good):
        if not row[3]:
            continue
        score = [sum(x * y for x, y in zip(vec[a], v)) for v in vec]
        order = sorted((i for i in range(len(good)) if i != a), key=lambda i: (-score[i], good[i][0]))
        for p in [i for i in order if good[i][1] == row[1]][:5]:
            inside = [i for i in order if good[i][1] != row[1] and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out += [(row[0], good[p][0], k + 1, good[i][0], score[p], score[i]) for k, i in enumerate(inside[:10])]
    return sorted(out)


def mined(spark, rows):
    table = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    return sorted(map(tuple, negatives.MultiIndex(table).mine().collect()))


def made(n, seed, dims=16, labels=4, spread=0.6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    v = (centres[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, dims))).astype(np.float32)
    return [(int(i), int(rng.integers(0, labels)), [float(x) for x in v[i]], i % 20 == 0) for i in range(n)]


def test_equals_brute_force_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHOR_ROWS", 8)
    monkeypatch.setattr(negatives.laid_out, "__defaults__", (100,))
    rows = made(900, 1)
    assert mined(spark, rows) == brute(rows)


def test_odd_rows_ties_copies_and_lengths(spark):
    rows = made(120, 2, dims=6) + [
        (None, 1, [0.5] * 6, True), (500, None, [0.5] * 6, True), (500, 1, None, True), (520, 1, [0.5, None, 0.1], True),
        (540, 1, [math.nan, 0.5], True), (560, 1, [math.inf, 0.5], False), (600, 1, [], True), (620, 2, [0.7], True), (640, 2, [0.0] * 6, None)]
    rows += [(700, 3, [1.0, 0.5, 0.25, 0.0, 0.0, 0.0], True)] * 7 + [(720 + i, i % 2, [0.8, 0.4, 0.3], False) for i in range(30)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, rows[:1]) == [] and mined(spark, [(0, 1, [0.5], True)]) == [] and mined(spark, [(0, 1, [], True)] * 3) == []


def test_empty_table(spark):
    assert mined(spark, []) == []


def test_scores_beyond_doubles_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 2, [float(np.float32(x)) for x in rng.uniform(0.5, 1.0, 3) * 3e5], i < 3) for i in range(60)]
    index = negatives.MultiIndex(spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA))
    assert not index.books.exact
    assert sorted(map(tuple, index.mine().collect())) == brute(rows)


def test_multi_sequence_gives_falling_sums_of_all_pairs():
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=9), rng.normal(size=7)
    got = list(negatives.multi_sequence(a, b))
    assert [g[0] for g in got] == sorted((x + y for x in a for y in b), reverse=True)
    assert {(x, y) for _, x, y in got} == {(x, y) for x in range(9) for y in range(7)}
    assert list(islice(negatives.multi_sequence(a, b[:0]), 3)) == []


def test_search_stops_early_in_clustered_data():
    """Tight clusters: most rows are never scored, and nothing is lost."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(30, 8))
    x = np.floor(256 * (centres[np.arange(6000) % 30] + 0.01 * rng.normal(size=(6000, 8))))
    books = negatives.Codebooks(8, negatives.codebook(x[:, :4], 30), negatives.codebook(x[:, 4:], 30), True)
    (i, r1), (j, r2) = negatives.nearest(x[:, :4], books.first), negatives.nearest(x[:, 4:], books.second)
    table = pa.table({"id": np.arange(6000), "uid": np.arange(6000), "label": np.arange(6000) % 30 % 3,
                      "cell": (i * len(books.second) + j).astype(np.int32), "r1": r1, "r2": r2,
                      "x": pa.array([v.tobytes() for v in x])})
    shard = negatives.Shard(table, books)
    seen = []
    need = negatives.Positives(0, 0, None, True)
    add = need.add
    need.add = lambda s, *rest: (seen.append(len(s)), add(s, *rest))
    s1, s2, n1, n2 = books.bounds(x[:1])
    shard.search(x[0], (s1[0], s2[0], n1[0], n2[0]), need)
    score = x @ x[0]
    order = [k for k in np.lexsort((np.arange(6000), -score)) if k and k % 30 % 3 == 0][:5]
    assert [r[3] for r in need.rows()] == order and sum(seen) < 2000
