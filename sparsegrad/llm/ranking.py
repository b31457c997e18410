"""Quality classifier by Bradley-Terry pairwise ranking.

Preference pairs set a document labelled 1 against one labelled 0. The chance
that the first is preferred is the logistic of the difference of their scores,
scores are linear in text features, and the weights minimise the logistic loss
on the feature differences. Every learning document stands in pairs: those of
the commoner label in turn, each round with other documents of the rarer one. A score
quantile of the learning documents, the share of label 0 among them, is the
decision threshold; it is placed at a score of ``DECISION``.

Defined cases: null and empty texts have all features 0 and are scored like
any other; with one label or none every score is 0.5; repeated rows are scored
alike; long texts are measured whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.text import with_line_ids
from . import textbatch as tb
from .common import stored
from .fitting import fit_rows, logistic_sums, newton, order_statistics

FEATURES = ("symbols", "repeated_neighbours", "repeated_windows", "distinct_words", "log_words", "short_text",
            "word_length", "digits", "upper", "long_words", "symbols_any", "top_word")
#: Least pairs formed for each document of the rarer label.
PAIRS_EACH = 10
PENALTY = 1.0
DECISION = 0.3
_SYMBOL = np.zeros(128, bool)
_SYMBOL[[ord(x) for x in "#*$%&|<>~^_=+{}[]\\/@"]] = True


def _per_word(flags: np.ndarray, words: tb.Words) -> np.ndarray:
    """Flagged characters between a word's start and end."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[words.end] - total[words.start]


def features(texts: list[str]) -> np.ndarray:
    codes = tb.Codes(texts)
    words = tb.Words(codes)
    n_texts, doc = len(texts), words.doc()
    n = np.maximum(words.count, 1).astype(float)
    by_text = lambda x: np.bincount(doc, x, n_texts)
    low = codes.c < 128
    symbols = by_text(_per_word(low & _SYMBOL[codes.c & np.uint32(127)], words))
    digits = by_text(_per_word((codes.c - np.uint32(48)) < 10, words))
    upper = by_text(_per_word((codes.c - np.uint32(65)) < 26, words))
    length = words.end - words.start
    chars = np.maximum(by_text(length), 1)
    # symbols at the end of a word must not make each repetition look new
    same = np.concatenate([[False], (words.hash[1:] == words.hash[:-1]) & (doc[1:] == doc[:-1])]) if len(doc) else np.zeros(0, bool)
    runs = tb.sequence_hash(words.hash, 3)
    inside = doc[:len(runs)] == doc[2:2 + len(runs)]
    salt = tb.mix(doc.astype(tb.U64) + tb.U64(1))
    windows = (runs ^ salt[:len(runs)])[inside]
    _, which, count = np.unique(windows, return_inverse=True, return_counts=True)
    window_doc = doc[:len(runs)][inside]
    again = np.bincount(window_doc, count[which] > 1, n_texts) if len(windows) else np.zeros(n_texts)
    keys, first, count = np.unique(words.hash ^ salt, return_index=True, return_counts=True)
    distinct = np.bincount(doc[first], minlength=n_texts)
    top = np.zeros(n_texts)
    np.maximum.at(top, doc[first], count)
    # the share of different words falls with the length of clean texts too
    expected = np.minimum(n, 40 * np.sqrt(n))
    return np.column_stack([
        np.minimum(symbols / n, 2.0), by_text(same) / n, again / n, np.minimum(distinct / expected, 1.5),
        np.log1p(words.count) / 10, words.count < 5, np.minimum(chars / n, 30) / 10, digits / chars, upper / chars,
        by_text(length > 25) / n, np.minimum(symbols / n, 0.2) * 5, top / n])


@dataclass
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """In (0, 1); ``DECISION`` where the raw score meets the quantile."""
        at = self.slope * (self.raw(x) - self.cut) + np.log(DECISION / (1 - DECISION))
        return 1 / (1 + np.exp(-np.clip(at, -35, 35)))


def bradley_terry(better: np.ndarray, worse: np.ndarray, penalty: float = PENALTY, rounds: int = 60) -> np.ndarray:
    """Weights that minimise the logistic loss of the differences (Newton)."""
    x = better - worse
    return newton(lambda w: logistic_sums(x, np.ones(len(x)), w), np.zeros(x.shape[1]), penalty, 4.0, rounds)


def _placed(model: Ranking, low: float, high: float, good: float, bad: float) -> Ranking:
    """With the cut between two raw scores, and a slope from the medians by label."""
    model.cut = (low + high) / 2
    model.slope = 6.0 / max(good - bad, 1e-6) if good - bad > 6.0 else 1.0
    return model


def rank(x: np.ndarray, y: np.ndarray) -> Ranking | None:
    """Fit on the features and labels of the learning documents."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    scale = x.std(0)
    model = Ranking(x.mean(0), np.where(scale > 1e-9, scale, 1.0), np.zeros(x.shape[1]), 0.0, 1.0)
    z = (x - model.mean) / model.scale
    few, many = (bad, good) if len(bad) <= len(good) else (good, bad)
    pair = np.arange(max(len(many), PAIRS_EACH * len(few)))
    turn, at = np.divmod(pair, len(many))
    left, right = z[few[(at + turn * (len(many) + 1)) % len(few)]], z[many[at]]
    model.weights = bradley_terry(right, left) if few is bad else bradley_terry(left, right)
    raw = np.sort(model.raw(x))
    k = len(bad)
    return _placed(model, float(raw[k - 1]), float(raw[k]), float(np.median(model.raw(x[good]))),
                   float(np.median(model.raw(x[bad]))))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, some in tb.pieces(batch.column(1)):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a),
                 pa.array(list(features(some)), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])


def _raw(model: Ranking):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.raw(x))], names=["label", "value"])
    return run


def _differences(rows: DataFrame, n: dict[int, int], scale: np.ndarray) -> DataFrame:
    """x: the pairs of ``rank``, better less worse, over ``scale``; rows are
    numbered inside their label in the order of a hash."""
    few, many = (0, 1) if n[0] <= n[1] else (1, 0)
    order = [F.col("label"), F.xxhash64("doc_id"), F.col("doc_id")]
    ids = with_line_ids(rows.repartitionByRange(*order).sortWithinPartitions(*order), start=0, name="number")
    mine = lambda label: ids.where(F.col("label") == label).withColumn("number", F.col("number") - (n[0] if label else 0))
    pairs = max(n[many], PAIRS_EACH * n[few])
    turns = F.sequence(F.lit(0), F.floor((F.lit(pairs - 1) - F.col("number")) / F.lit(n[many])).cast("int"))
    left = mine(many).select("number", F.col("x").alias("a"), F.explode(turns).alias("turn")).select(
        "a", F.pmod(F.col("number") + F.col("turn") * F.lit(n[many] + 1), F.lit(n[few])).alias("number"))
    right = mine(few).select("number", F.col("x").alias("b"))
    better, worse = ("a", "b") if many == 1 else ("b", "a")
    steps = F.array(*[F.lit(float(s)) for s in scale])
    off = F.zip_with(F.zip_with(better, worse, lambda u, v: u - v), steps, lambda u, v: u / v)
    return left.join(right, "number").select(off.alias("x"), F.lit(1.0).alias("y"))


def fit(sample: DataFrame) -> Ranking | None:
    """``rank`` on learning rows (doc_id, text, label) of any number. Tasks
    measure the texts; the driver gets sums and a few order statistics."""
    rows = stored(sample.select("doc_id", "text", "label").mapInArrow(_features, "doc_id long, label int, x array<double>"), "features")
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return None
    seen = rows.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.avg("v"), F.stddev_pop("v"))
    mean, scale = np.array(sorted(map(tuple, seen.collect())))[:, 1:].T             # one row a feature
    model = Ranking(mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(len(mean)), 0.0, 1.0)
    model.weights = fit_rows(_differences(rows.where("label IN (0, 1)"), n, model.scale), np.zeros(len(mean)), PENALTY, 4.0, 60)
    raw = stored(rows.select("label", "x").mapInArrow(_raw(model), "label int, value double"), "raw")
    every, size = 2, {0: n[0], 1: n[1], 2: sum(n.values())}
    middle = lambda k: ((size[k] - 1) // 2, size[k] // 2)
    ranks = {0: set(middle(0)), 1: set(middle(1)), every: {n[0] - 1, n[0]}}
    found = order_statistics(raw.select(F.explode(F.array("label", F.lit(every))).alias("grp"), "value"), ranks, size)
    good, bad = (sum(found[k, r] for r in middle(k)) / 2 for k in (1, 0))
    return _placed(model, found[every, n[0] - 1], found[every, n[0]], good, bad)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, some in tb.pieces(batch.column(1)):
                found = shared.value.score(features(some)) if shared.value else np.full(b - a, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found)], names=["doc_id", "score"])
    return run


def score(docs: DataFrame, model: Ranking | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    pairs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return pairs.mapInArrow(_score(shared), "doc_id long, score double")
