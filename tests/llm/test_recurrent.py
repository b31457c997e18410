"""Recurrent language model: counts against plain Python, gradients against
differences, scores against one step at a time, and held-out gain."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsegrad.llm import queries, recurrent as rec, textbatch as tb

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
END = "\n"
SCHEMA = "doc_id long, text string, uid string, h string, n long, rest string"


def plain_tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*WORDS.findall(low), END]


def is_held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def hash_of(token):
    return int(rec.END.view(np.int64)) if token == END else int(rec.tokens([token])[0][0])


def check_counts(docs, rows):
    """Counts and base scores of (doc_id, text) rows, in any order."""
    counts = Counter(t for i, text in docs if not is_held(i) for t in plain_tokens(text))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, text in docs:
        seen = [counts[t] for t in plain_tokens(text)]
        want.append((i, is_held(i), len(seen), sum(c > 0 for c in seen), n,
                     sum(math.log10((c + 1) / (n + v + 1)) for c in seen)))
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows]
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=str), sorted(want, key=str)):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9)


def scored(spark, docs):
    table = spark.createDataFrame([(*d, "x", "y", 1, "z") for d in docs], SCHEMA)
    kept = table.filter(~rec.held_out(F.col("doc_id")))
    model = rec.fit(kept)
    return model, rec.score(table, model).withColumn("held_out", rec.held_out(F.col("doc_id"))).collect()


def test_query_counts_and_held_out_gain(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = queries.recurrent_scores(spark, sf).collect()
    check_counts(docs, rows)
    assert all(r.score < 0 for r in rows)
    for held in (False, True):
        assert sum(r.score for r in rows if r.held_out == held) > sum(r.base_score for r in rows if r.held_out == held)


def test_joined_counts_and_many_trainers(spark, sf, monkeypatch):
    """Most words beyond the broadcast ones, and several trainers."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    monkeypatch.setattr(rec.vocabulary, "__defaults__", (60, 100))
    monkeypatch.setattr(rec, "TRAINER_RUNS", 20)
    (vocab, net, _), rows = scored(spark, docs)
    assert len(vocab.hash) <= 101 and len(vocab.net) == 60 and all(np.isfinite(x).all() for x in net.p.values())
    check_counts(docs, rows)


def test_scores_equal_single_steps(spark):
    """Scores of whole documents from a plain loop over the fitted weights,
    nulls, empties, repeats, a long text and a null id included."""
    rng = np.random.default_rng(1)
    pool = [f"W{i}" for i in range(300)]
    docs = [(i, " ".join(pool[int(k)] for k in rng.zipf(1.4, 30) % 300)) for i in range(120)]
    docs += [(200, None), (201, ""), (202, " \t\n"), (None, "w1 W2 neverseen"), (203, "w1 " * 40_000), (204, "É é"), (5, docs[5][1]), (5, docs[5][1])]
    (vocab, net, _), rows = scored(spark, docs)
    check_counts(docs, rows)
    counts = Counter(t for i, text in docs if not is_held(i) for t in plain_tokens(text))
    place = dict(zip(vocab.hash.tolist(), vocab.place.tolist()))
    p, k = {a: b.astype(np.float64) for a, b in net.p.items()}, rec.HIDDEN
    sig = lambda x: 1 / (1 + np.exp(-x))

    def plain(text):
        h, before, total = np.zeros(k), net.words + 1, 0.0
        for t in plain_tokens(text):
            x, u = p["embed"][before] @ p["inward"] + p["bias"], h @ p["onward"]
            z, r = sig(x[:k] + u[:k]), sig(x[k:2 * k] + u[k:2 * k])
            h = (1 - z) * np.tanh(x[2 * k:] + r * u[2 * k:]) + z * h
            at = place.get(hash_of(t), -1)
            logit = h @ p["classes"] + p["class_bias"]
            logit -= np.log(np.exp(logit).sum())
            if at < 0:
                total += logit[-1] + math.log((counts[t] + 1) / vocab.rest)
                before = net.words
            else:
                c, j = divmod(at, rec.CLASS_WORDS)
                inner = h @ p["inside"][c] + p["inside_bias"][c]
                total += logit[c] + inner[j] - np.log(np.exp(inner).sum())
                before = at
        return total / math.log(10)

    want = {(i, text or "") : plain(text) for i, text in docs if i != 203}
    by_id = {}
    for i, text in want:
        by_id.setdefault(i, []).append(want[i, text])
    for r in rows:
        if r.doc_id != 203:
            assert any(r.score == pytest.approx(x, rel=1e-4) for x in by_id[r.doc_id])
    assert [r.n_tokens for r in rows if r.doc_id == 203] == [40_001]


def test_probabilities_of_all_types_sum_to_one():
    words = [f"w{i}" for i in range(200)]
    h = np.unique(rec.tokens(words)[0])
    n = np.arange(1, len(h) + 1)
    place = np.full(len(h), -1, np.int32)
    place[-90:] = np.arange(90)
    vocab = rec.Vocabulary(h, n, place, int(n.sum()), len(h), n[-90:])
    net = rec.Network.fresh(vocab)
    states = np.random.default_rng(0).normal(size=(1, rec.HIDDEN)).astype(np.float32)
    logp = rec.log_probs(net, np.repeat(states, 91, 0), np.arange(91))
    rest = sum((int(c) + 1) / vocab.rest for c, at in zip(n, place) if at < 0) + 1 / vocab.rest
    assert rest == pytest.approx(1) and np.exp(logp).sum() == pytest.approx(1, rel=1e-5)


def test_gradient_equals_differences():
    rng = np.random.default_rng(2)
    vocab = rec.Vocabulary(np.arange(80), np.arange(80, 0, -1), np.arange(80, dtype=np.int32), 5000, 90, np.arange(80, 0, -1))
    net = rec.Network.fresh(vocab, hidden=5)
    net.p = {a: b.astype(np.float64) for a, b in net.p.items()}
    inputs, target = rng.integers(0, 82, (6, 4)), rng.integers(0, 81, (6, 4))
    live = np.arange(6)[:, None] < np.array([6, 4, 6, 1])
    h0 = rng.normal(size=(4, 5))
    loss = lambda: rec.window_gradient(net, inputs, target, live, h0)[0]
    _, grad, _ = rec.window_gradient(net, inputs, target, live, h0)
    for name, w in net.p.items():
        flat = w.reshape(-1)
        for i in rng.choice(flat.size, min(flat.size, 12), replace=False):
            if flat[i] < -1e3:
                continue
            keep, step = flat[i], 1e-5
            flat[i] = keep + step
            up = loss()
            flat[i] = keep - step
            down = loss()
            flat[i] = keep
            assert grad[name].reshape(-1)[i] == pytest.approx((up - down) / (2 * step), rel=2e-2, abs=2e-3), name


def test_state_is_carried_over_scoring_windows(monkeypatch):
    rng = np.random.default_rng(3)
    vocab = rec.Vocabulary(np.arange(80), np.arange(80, 0, -1), np.arange(80, dtype=np.int32), 5000, 90, np.arange(80, 0, -1))
    net = rec.Network.fresh(vocab)
    docs = [rng.integers(0, 81, n) for n in (1, 500, 3, 77, 77, 2)]
    whole = rec.document_scores(net, docs)
    monkeypatch.setattr(rec, "STATES", 7)
    assert rec.document_scores(net, docs) == pytest.approx(whole, rel=1e-5)
    assert [rec.document_scores(net, [d])[0] for d in docs] == pytest.approx(list(whole), rel=1e-5)
    # two texts with the same last words but other first words: the end differs
    a, b = [np.concatenate([[x] * 3, [5, 6]]) for x in (1, 60)]
    assert rec.document_scores(net, [a])[0] != rec.document_scores(net, [b])[0]


def test_nothing_to_learn_from(spark):
    held = [i for i in range(60) if is_held(i)][:3]
    model, rows = scored(spark, [(i, "some words") for i in held])
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, round(r.score, 6)) for r in rows] == [(3, 0, 0, 0.0, 0.0)] * 3
    assert scored(spark, [])[1] == []


def test_tokens():
    h, first = rec.tokens(["A b", "", "a"])
    assert first.tolist() == [0, 3, 4, 6] and h[0] == h[4] and h[2] == h[3] == h[5] == rec.END.view(np.int64)
    assert (rec.word_hashes(["é Z"])[0] == tb.Words(tb.Codes(["é z"])).hash).all()


def test_runs_hold_every_token(spark):
    """Each token of each document is learned once, after the one before it."""
    docs = [(1, " ".join(f"W{i % 150}" for i in range(1000))), (2, None), (3, ""), (4, "a b"), (5, " ".join(["x"] * 63)),
            (6, " ".join(["x"] * 64)), (7, "only once"), (4, "a b")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    vocab = rec.vocabulary(rec.count_tokens(table), net_words=100)
    words = len(vocab.net)
    want = Counter()
    for _, text in docs:
        h, _ = rec.tokens([text or ""])
        place = vocab.look_up(h)[1]
        seq = [words + 1, *[int(x) if x >= 0 else words for x in place]]
        want.update(zip(seq, seq[1:]))
    rows = rec.training_runs(table, spark.sparkContext.broadcast(vocab)).collect()
    got, sizes = Counter(), []
    for r in rows:
        seq = np.frombuffer(r.run, np.int16).tolist()
        sizes.append(len(seq) - 1)
        got.update(zip(seq, seq[1:]))
    assert got == want and max(sizes) <= rec.RUN_TOKENS and min(sizes) >= 1
    assert len({r.place for r in rows}) == len(rows) - 1               # (4, "a b") twice


def test_look_up_by_leading_bits():
    """Words next to each other, at both ends of the range and absent ones."""
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    h = np.array([low, low + 1, -5, -1, 0, 1, 2, 3, 1 << 61, high - 1], np.int64)
    for words in (h, np.append(h, high), h[:0]):
        vocab = rec.Vocabulary(words, np.arange(1, len(words) + 1), np.arange(len(words), dtype=np.int32), 99, 20, np.ones(3, np.int64))
        asked = np.array([*h, high, low + 2, -3, 4, 1 << 62], np.int64)
        want = {int(x): (k + 1, k) for k, x in enumerate(words)}
        count, place = vocab.look_up(asked)
        assert list(zip(count.tolist(), place.tolist())) == [want.get(int(x), (0, -1)) for x in asked]


def test_logits_of_any_size():
    """Weights whose logits may not be taken as they are, and pieces of
    positions: probabilities as worked out at once in doubles."""
    rng = np.random.default_rng(5)
    vocab = rec.Vocabulary(np.arange(80), np.arange(80, 0, -1), np.arange(80, dtype=np.int32), 5000, 90, np.arange(80, 0, -1))
    n = rec.LOGITS * 2 + 7
    states, target = np.tanh(rng.normal(size=(n, rec.HIDDEN))).astype(np.float32), rng.integers(0, 81, n)
    for size, safe in ((0.3, True), (40.0, False)):
        net = rec.Network.fresh(vocab)
        for name in ("classes", "inside"):
            net.p[name] = rng.normal(0, size, net.p[name].shape).astype(np.float32)
        assert rec._output(net.p["inside"], net.p["inside_bias"])[1] == safe
        p = {a: b.astype(np.float64) for a, b in net.p.items()}
        log_share = lambda x: x - x.max(-1, keepdims=True) - np.log(np.exp(x - x.max(-1, keepdims=True)).sum(-1, keepdims=True))
        outer = log_share(states @ p["classes"] + p["class_bias"])
        want = []
        for k, t in enumerate(target):
            c, j = divmod(int(t), rec.CLASS_WORDS) if t < 80 else (outer.shape[1] - 1, None)
            want.append(outer[k, c] + (0 if j is None else log_share(states[k] @ p["inside"][c] + p["inside_bias"][c])[j]))
        got = rec.log_probs(net, states, target)
        assert np.isfinite(got).all() and got == pytest.approx(np.array(want), rel=1e-3, abs=1e-3)


def test_trained_weights_are_averaged_in_slices(spark):
    """Weights of many trainers: no group holds a whole network of any of
    them, and the mean is that by tokens seen, in the order of the weights."""
    rng = np.random.default_rng(6)
    vocab = rec.Vocabulary(np.arange(80), np.arange(80, 0, -1), np.arange(80, dtype=np.int32), 5000, 90, np.arange(80, 0, -1))
    net = rec.Network.fresh(vocab)
    seen, nets = rng.integers(1, 99, 40).astype(float), []
    for _ in seen:
        nets.append(rec.Network(net.words, {a: rng.normal(size=b.shape).astype(np.float32) for a, b in net.p.items()}))
    cut = [rec._slices(x.packed()) for x in nets]
    assert len(cut[0]) > 10 and max(map(len, cut[0])) == 4 * rec.SLICE and b"".join(cut[0]) == nets[0].packed()
    rows = [(k, w, x) for w, c in zip(seen.tolist(), cut) for k, x in enumerate(c)]
    trained = spark.createDataFrame(rows, "slice int, weight double, net binary").repartition(7)
    got = net.unpacked(rec.averaged(trained))
    for name in net.NAMES:
        want = sum(w * x.p[name].astype(np.float64) for w, x in zip(seen, nets)) / seen.sum()
        assert got.p[name] == pytest.approx(want, rel=1e-5, abs=1e-6)
    assert rec.averaged(trained.limit(0)) == b""


def test_trainers_pass_on_slices(spark, monkeypatch):
    """What the trainers hand over for averaging: every slice of each network
    as a row of its own, and nothing larger."""
    handed = []
    averaged = rec.averaged
    monkeypatch.setattr(rec, "averaged", lambda trained: handed.append(trained.cache()) or averaged(handed[0]))
    monkeypatch.setattr(rec, "TRAINER_RUNS", 8)
    vocab = rec.Vocabulary(np.arange(80), np.arange(80, 0, -1), np.arange(80, dtype=np.int32), 5000, 90, np.arange(80, 0, -1))
    net = rec.Network.fresh(vocab)
    rng = np.random.default_rng(7)
    runs = spark.createDataFrame([(i, rng.integers(0, 80, 20).astype(np.int16).tobytes()) for i in range(64)], "place long, run binary")
    got = rec.refined(net, runs, 64)
    rows = handed[0].collect()
    cut = rec._slices(net.packed())
    trainers = Counter(r.slice for r in rows)
    assert set(trainers) == set(range(len(cut))) and min(trainers.values()) == max(trainers.values()) > 1
    assert all(len(r.net) == len(cut[r.slice]) <= 4 * rec.SLICE for r in rows)
    assert sum(r.weight for r in rows if r.slice == 0) == 64 * 19
    assert all(np.isfinite(x).all() for x in got.p.values()) and got.packed() != net.packed()
