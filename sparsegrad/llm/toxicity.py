"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words are read by lexical transducers that map them to classes: insults
(a seed list, and words and word beginnings learned from labelled documents
with their shrunken log odds as weights), threats, targets, negation and reported speech. Small
transducers for target, negation and reported speech each remember for a few
words what they have read; their composition is one deterministic transducer
that turns each insult or threat of a clause into a kind of match: plain,
directed at someone, negated or reported. A clause is as strong as what it
asserts: its strongest plain or directed insult and its threat, if that is
directed or stands with such an insult; what is negated or reported only
counts by its kind. The strongest clause and the match weights of a document
feed a logistic model whose coefficients come from labelled documents, so how much
a negated or reported insult counts is learned, not assumed. All learning
documents serve both: the coefficients see each document through a lexicon
learned from the other folds.

Defined cases: null and empty texts have no match and get the score of a text
without one; with one label or none to learn from the prior coefficients hold;
repeated rows are scored alike; long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .decontaminate import letters_and_digits
from .fitting import fit_rows, logistic_sums, newton

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: The seed words of each class.
SEED_WORDS = {
    INSULT: """idiot idiots moron morons imbecile imbeciles stupid dumb dumbass scum scumbag trash garbage vermin
        loser losers clown clowns worthless pathetic disgusting retard retarded cretin degenerate bastard bitch
        asshole dickhead jackass""".split(),
    THREAT: """kill murder hurt stab shoot strangle beat burn destroy hang""".split(),
    TARGET: """you your yours yourself u ur he she him her they them their these those people""".split(),
    NEGATION: """not never no isn aren wasn weren don doesn didn nobody neither nor without""".split(),
    REPORT: """said says say called calls wrote writes quoted quote claimed alleged reported according told""".split(),
}
SEED_WEIGHT = 4.0
#: Words over which a target, a negation or a reporting verb reaches.
REACH = {TARGET: 3, NEGATION: 3, REPORT: 6}
#: Lengths of the word beginnings that may be learned; whole words have 0.
PREFIXES = (4, 5, 6, 7, 8)
WHOLE = 0
CLAUSE_END = np.array([ord(x) for x in ".!?;:,\n"], np.uint32)
KINDS = ("plain", "directed", "negated", "reported", "threat", "threat_directed", "threat_negated", "threat_reported")
#: First threat kind, and the asserted kinds counted from it or from 0.
THREATS, PLAIN, DIRECTED = 4, 0, 1
#: Prior coefficients: bias, strongest clause, then log(1 + weight sum) by kind.
PRIOR = np.array([-3.0, 1.0, 0.5, 0.8, 0.1, 0.2, 0.1, 1.5, 0.0, 0.1])
#: Folds of the learning documents.
FOLDS = 3
#: Deviance from the base share that chance explains: log odds are shrunk by
#: 1 - CHANCE / deviance, to 0 at most.
CHANCE = 10.0


@dataclass(frozen=True)
class Reach:
    """Transducer that remembers a class for some words: state = words left."""
    cls: int
    words: int

    def step(self, state: int, symbol: int) -> int:
        return self.words if symbol == self.cls else max(0, state - 1)

    @property
    def states(self) -> range:
        return range(self.words + 1)


def compose(parts: tuple[Reach, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Product of the transducers: (next state, output kind) by state and
    class. The output reads the state before the word: reported speech wins
    over negation, negation over a target."""
    states = list(product(*[p.states for p in parts]))
    number = {s: i for i, s in enumerate(states)}
    move, emit = np.zeros((len(states), 6), np.int64), np.full((len(states), 6), -1)
    for s in states:
        active = {p.cls: left > 0 for p, left in zip(parts, s)}
        mode = 3 if active[REPORT] else 2 if active[NEGATION] else 1 if active[TARGET] else 0
        for symbol in range(6):
            move[number[s], symbol] = number[tuple(p.step(left, symbol) for p, left in zip(parts, s))]
        emit[number[s], INSULT], emit[number[s], THREAT] = mode, 4 + mode
    return move, emit


GRAMMAR = compose(tuple(Reach(c, n) for c, n in REACH.items()))
START = 0


@dataclass
class Lexicon:
    """Sorted hash arrays: seed words and, by length, learned beginnings (at
    length 0 learned words)."""
    words: np.ndarray
    classes: np.ndarray
    prefixes: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    @classmethod
    def seed(cls) -> Lexicon:
        words = [(w, c) for c, some in SEED_WORDS.items() for w in some]
        read = tb.Words(tb.Codes([w for w, _ in words]), letters_and_digits)
        order = np.argsort(read.hash)
        return cls(read.hash[order], np.array([c for _, c in words])[order])

    def read(self, words: tb.Words) -> tuple[np.ndarray, np.ndarray]:
        """(class, insult weight) of every word; each distinct word of the
        piece is looked up once."""
        keys, at, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        slot = np.minimum(np.searchsorted(self.words, keys), len(self.words) - 1)
        cls = np.where(self.words[slot] == keys, self.classes[slot], OTHER)
        weight = np.where(cls == INSULT, SEED_WEIGHT, 0.0)
        length = (words.end - words.start)[at]
        for n, (marks, odds) in self.prefixes.items():
            who = np.flatnonzero(length >= n)
            h = words.prefix_hash(n, at[who]) if n else keys
            slot = np.minimum(np.searchsorted(marks, h), len(marks) - 1)
            found = np.where(marks[slot] == h, odds[slot], 0.0)
            weight[who] = np.maximum(weight[who], found)
        cls = np.where((weight > 0) & (cls == OTHER), INSULT, cls)
        return cls[inverse], weight[inverse]


def _read(texts: list[str]) -> tuple[tb.Codes, tb.Words]:
    codes = tb.Codes([t.lower() for t in texts])
    return codes, tb.Words(codes, letters_and_digits)


def matches(texts: list[str], lexicon: Lexicon) -> tuple[np.ndarray, ...]:
    """(text, first character, end, kind, weight) of every match. Character
    places are those of the lower-cased text."""
    return clause_matches(texts, lexicon)[:5]


def clause_matches(texts: list[str], lexicon: Lexicon) -> tuple[np.ndarray, ...]:
    """As ``matches``, and the clause of every match, numbered over all texts."""
    codes, words = _read(texts)
    if not len(words.hash):
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0), np.zeros(0, np.int64))
    cls, weight = lexicon.read(words)
    doc = words.doc()
    # a clause ends where any clause mark stands between two words
    marks = np.concatenate([[0], np.cumsum(np.isin(codes.c, CLAUSE_END))])
    fresh = np.concatenate([[True], (marks[words.start[1:]] > marks[words.end[:-1]]) | (doc[1:] != doc[:-1])])
    clause = np.cumsum(fresh) - 1
    begin = np.flatnonzero(fresh)
    hits = np.flatnonzero((cls == INSULT) | (cls == THREAT))
    move, emit = GRAMMAR
    kinds = np.zeros(len(hits), np.int64)
    longest = max(REACH.values())
    done = -1
    state = START
    for i, w in enumerate(hits):
        first = begin[clause[w]]
        if done < first or w - done > longest:            # the transducer has forgotten everything older
            done, state = max(first, w - longest) - 1, START
        for symbol in cls[done + 1:w].tolist():
            state = move[state, symbol]
        kinds[i] = emit[state, cls[w]]
        state, done = move[state, cls[w]], w
    near = _target_after(cls, clause, hits)
    kinds = np.where(near & (kinds % 4 == 0), kinds + 1, kinds)
    d = doc[hits]
    value = np.where(cls[hits] == THREAT, 1.0, weight[hits])
    return d, words.start[hits] - codes.at[d], words.end[hits] - codes.at[d], kinds, value, clause[hits]


def _target_after(cls: np.ndarray, clause: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """True if a target follows within reach in the same clause ("kill you")."""
    out = np.zeros(len(hits), bool)
    for step in range(1, REACH[TARGET] + 1):
        at = np.minimum(hits + step, len(cls) - 1)
        out |= (cls[at] == TARGET) & (clause[at] == clause[hits]) & (at == hits + step)
    return out


def features(texts: list[str], lexicon: Lexicon) -> np.ndarray:
    """Bias, strongest clause, and log(1 + summed weight) of each kind."""
    d, _, _, kind, weight, clause = clause_matches(texts, lexicon)
    sums = np.zeros((len(texts), len(KINDS)))
    np.add.at(sums, (d, kind), weight)
    strongest = np.zeros(len(texts))
    _, first, at = np.unique(clause, return_index=True, return_inverse=True)
    insult, threat, aimed = (np.zeros(len(first)) for _ in range(3))
    asserted = kind <= DIRECTED
    np.maximum.at(insult, at[asserted], weight[asserted])
    threat[at[kind == THREATS + PLAIN]] = SEED_WEIGHT
    aimed[at[kind == THREATS + DIRECTED]] = SEED_WEIGHT
    np.maximum.at(strongest, d[first], insult + np.where(insult > 0, np.maximum(threat, aimed), aimed))
    return np.column_stack([np.ones(len(texts)), strongest, np.log1p(sums)])


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Newton steps on the logistic loss with a Gaussian prior around ``prior``."""
    return newton(lambda w: logistic_sums(x, y, w), prior, strength, 5.0, rounds)


def _mark_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, label, fold -> (fold, length, hash, toxic texts, other texts) of
    words and word beginnings."""
    fields = ["fold", "length", "mark", "yes", "no"]
    for batch in batches:
        label, fold = (np.array(batch.column(i).to_pylist()) for i in (1, 2))
        for a, b, some in tb.pieces(batch.column(0), 1 << 21):
            _, words = _read(some)
            doc, length = words.doc(), words.end - words.start
            folds = fold[a:b].astype(tb.U64)
            for n in (WHOLE, *PREFIXES):
                who = np.flatnonzero(length >= n)
                if not len(who):
                    continue
                h = words.prefix_hash(n, who) if n else words.hash
                _, once = np.unique(h ^ tb.mix(doc[who].astype(tb.U64) + tb.U64(1)), return_index=True)
                of = doc[who][once]
                _, at, inverse = np.unique(h[once] ^ tb.mix(folds[of] + tb.U64(1)), return_index=True, return_inverse=True)
                yes = np.bincount(inverse, label[a:b][of], len(at)).astype(np.int64)
                every = np.bincount(inverse, minlength=len(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(folds[of[at]].astype(np.int32)), pa.array(np.full(len(at), n, np.int32)),
                     pa.array(h[once][at].view(np.int64)), pa.array(yes), pa.array(every - yes)], names=fields)


def marker_weight(yes: Column, no: Column, yes_all: int, n_all: int) -> Column:
    """Log odds of a mark that stands in ``yes`` toxic and ``no`` other texts,
    shrunk by how much of its deviance from the base share chance explains;
    0 if it is not more frequent in toxic texts. Holds at any base share."""
    if not 0 < yes_all < n_all:
        return F.lit(0.0)
    base = yes_all / n_all
    n = yes + no
    share = F.try_divide(yes, n)
    term = lambda p, q: F.when(p > 0, p * F.log(p / q)).otherwise(0.0)
    deviance = 2 * n * (term(share, F.lit(base)) + term(1 - share, F.lit(1 - base)))
    odds = F.log((yes + 0.5) / (yes_all + 1)) - F.log((no + 0.5) / (n_all - yes_all + 1))
    more = (share > base) & (odds > 0) & (deviance > CHANCE)
    return F.when(more, odds * (1 - F.try_divide(F.lit(CHANCE), deviance))).otherwise(0.0)


def learn_lexicons(sample: DataFrame) -> list[Lexicon]:
    """From (text, label, fold): for each fold the lexicon of the other folds,
    then the lexicon of all. All counts come from one pass."""
    totals = {r["fold"]: (int(r["yes"]), int(r["n"])) for r in sample.groupBy("fold").agg(
        F.sum("label").alias("yes"), F.count(F.lit(1)).alias("n")).collect()}
    lexicons = [Lexicon.seed() for _ in range(FOLDS + 1)]
    if not 0 < sum(y for y, _ in totals.values()) < sum(n for _, n in totals.values()):
        return lexicons
    counts = sample.select("text", "label", "fold").mapInArrow(
        _mark_counts, "fold int, length int, mark long, yes long, no long")
    sums, weights = [], []
    for k in range(FOLDS + 1):
        mine = F.col("fold") != k
        sums += [F.sum(F.when(mine, F.col(c)).otherwise(0)).alias(f"{c}{k}") for c in ("yes", "no")]
        yes_all, n_all = (sum(t[i] for fold, t in totals.items() if fold != k) for i in (0, 1))
        weights.append(marker_weight(F.col(f"yes{k}"), F.col(f"no{k}"), yes_all, n_all).alias(f"w{k}"))
    # marks with a weight, a small part of the words and beginnings that recur in toxic texts
    kept = (counts.groupBy("length", "mark").agg(*sums).select("length", "mark", *weights)
            .filter(F.greatest(*[F.col(f"w{k}") for k in range(FOLDS + 1)]) > 0).toPandas())
    for k, lexicon in enumerate(lexicons):
        for n, some in kept[kept[f"w{k}"] > 0].groupby("length"):
            h = some["mark"].to_numpy().view(tb.U64)
            order = np.argsort(h)
            lexicon.prefixes[int(n)] = (h[order], some[f"w{k}"].to_numpy()[order])
    return lexicons


@dataclass
class Grammar:
    lexicon: Lexicon
    coefficients: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features(texts, self.lexicon) @ self.coefficients, -35, 35)))


def _features(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = np.array(batch.column(2).to_pylist())
            for a, b, some in tb.pieces(batch.column(0)):
                x = np.zeros((b - a, len(PRIOR)))
                for k in np.unique(fold[a:b]):
                    mine = np.flatnonzero(fold[a:b] == k)
                    x[mine] = features([some[i] for i in mine], shared.value[k])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(a, b - a), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])
    return run


def fit(sample: DataFrame) -> Grammar:
    """From learning rows (doc_id, text, label) of any number: the lexicon from
    all rows, the coefficients from all rows too, each read with the lexicon of
    the folds that it is not in. The driver gets the lexicons and sums."""
    fold = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(FOLDS)).cast("int")
    rows = sample.select("text", "label", fold.alias("fold"))
    lexicons = learn_lexicons(rows)
    shared = sample.sparkSession.sparkContext.broadcast(lexicons)
    seen = rows.mapInArrow(_features(shared), "label int, x array<double>")
    return Grammar(lexicons[-1], fit_rows(seen.select("x", F.col("label").alias("y")), PRIOR, 1.0, 5.0, 50))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, some in tb.pieces(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(shared.value.score(some))], names=["doc_id", "score"])
    return run


def score(docs: DataFrame, model: Grammar, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score in (0, 1) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    pairs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return pairs.mapInArrow(_score(shared), "doc_id long, score double")


def _clauses(shared):
    fields = ["doc_id", "start", "end", "kind", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, some in tb.pieces(batch.column(1)):
                d, start, end, kind, weight = matches(some, shared.value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(d + a)), pa.array(start), pa.array(end),
                     pa.array([KINDS[k] for k in kind], pa.string()), pa.array(weight)], names=fields)
    return run


def match_rows(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, end, kind, weight of every matched word."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    pairs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return pairs.mapInArrow(_clauses(shared), "doc_id long, start long, end long, kind string, weight double")
