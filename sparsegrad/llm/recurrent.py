"""Language model scores of whole documents: a gated recurrent network with a
class-factored output, beside a smoothed unigram base.

Tokens are the words of the text with A-Z in lower case, then one end token.
Every training token is counted. The ``NET_WORDS`` most frequent words (and the
end) have a place of their own in the network; they are dealt to classes of
``CLASS_WORDS`` by frequency, and a word's probability is that of its class times
its own inside the class. All other words share one more class, in which a word
has its smoothed share of the training tokens, an unseen one that of a single
type. The probabilities of all types sum to one.

The network learns from every token of every training document. A document is
cut into runs of ``RUN_TOKENS`` tokens, each of which is told the token before it;
backpropagation is cut after ``WINDOW`` steps, and the state goes on into the
next window of a run. It is warmed up on about ``WARM_RUNS`` runs, a tenth of
which are kept aside to check the loss; then the runs of all documents are dealt to trainers, one for each ``TRAINER_RUNS`` runs up
to ``MOST_TRAINERS``, and their weights are averaged by the tokens that they saw.
The weights that do best on the runs kept aside are used. A document is scored whole, window by window, with
the state carried from its first token to its end.

Counts of the ``KNOWN_WORDS`` most frequent words are broadcast; all other tokens
are joined with the count table, so nothing that is broadcast grows with the
corpus.

Defined cases: a null text is empty and has the end token only; a null id is not
held out; rows with equal ids or texts are scored and counted each; without a
training token every probability is 1; an empty table gives an empty result;
extra columns do not matter. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .common import stored

NET_WORDS, CLASS_WORDS, HIDDEN = 4096, 64, 16
KNOWN_WORDS = 1 << 18
RUN_TOKENS, WINDOW = 64, 32
WARM_RUNS, WARM_ROUNDS, WARM_BATCH, WARM_RATE = 8192, 4, 64, 0.02
TRAINER_RUNS, MOST_TRAINERS, BATCH = 32768, 512, 512
#: Weights of one slice of a trained network; slices are averaged apart.
SLICE = 256
#: Tokens whose network states are held at once, and tokens pooled for one pass.
STATES, POOL = 1 << 15, 1 << 21
#: Positions whose logits are held at once, so that they stay in a core's cache.
LOGITS = 1024
#: Steps of a doubling of the count, for the histogram that picks frequent words.
BINS = 8
END = np.uint64(0x51ED270B9F1D8A37)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


# -------------------------------------------------------------------- tokens

def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of the words of each text, A-Z in lower case."""
    codes = tb.Codes(texts)
    codes.c = np.where((codes.c - np.uint32(65)) < 26, codes.c + np.uint32(32), codes.c)
    words = tb.Words(codes)
    return words.hash, words.first


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of the tokens of each text: its words, then the end."""
    h, first = word_hashes(texts)
    return np.insert(h, first[1:], END).view(np.int64), first + np.arange(len(first))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, n): tokens counted inside the task, passed on at 2^20 types."""
    def merged(parts):
        h, n = (np.concatenate(x) for x in zip(*parts))
        types, at = np.unique(h, return_inverse=True)
        return types, np.bincount(at, n, len(types)).astype(np.int64)

    held, waiting = [], 0
    for batch in batches:
        for _, _, texts in tb.pieces(batch.column(0)):
            held.append(np.unique(tokens(texts)[0], return_counts=True))
            waiting += len(held[-1][0])
            if waiting >= 1 << 21:
                held = [merged(held)]
                waiting = len(held[0][0])
                if waiting >= 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["h", "n"])
                    held, waiting = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged(held)], names=["h", "n"])


@dataclass
class Vocabulary:
    """Frequent words (hash, count, and place in the network or -1), sorted by
    hash, and the totals over all training tokens."""
    hash: np.ndarray
    count: np.ndarray
    place: np.ndarray
    n: int                   # training tokens
    types: int
    net: np.ndarray          # counts of the network's words by place

    def __post_init__(self):
        """The first word for each value of the leading bits of a hash, and an
        end that no word lies beyond."""
        bits = min(22, len(self.hash).bit_length() + 2)
        self.shift, self.half = 64 - bits, 1 << bits - 1
        edges = np.arange(-self.half, self.half, dtype=np.int64) << self.shift
        self.first = np.searchsorted(self.hash, edges).astype(np.int32)
        self.ended = np.append(self.hash, np.iinfo(np.int64).max).astype(np.int64)
        self.found = np.append(self.count, 0), np.append(self.place, -1).astype(np.int32)

    @property
    def rest(self) -> int:
        """Mass of the shared class: its tokens, its types and one unseen."""
        return self.n - int(self.net.sum()) + self.types - len(self.net) + 1

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count or 0, place or -1) of each hash."""
        at = self.first[(h >> self.shift) + self.half]
        below = np.flatnonzero(self.ended[at] < h)
        while len(below):
            at[below] += 1
            below = below[self.ended[at[below]] < h[below]]
        same = self.ended[at] == h
        count, place = self.found
        return np.where(same, count[at], 0), np.where(same, place[at], -1)


def vocabulary(counts: DataFrame, net_words: int = NET_WORDS, known: int = KNOWN_WORDS) -> Vocabulary:
    """The most frequent words by a histogram of the counts' logarithms: the
    lowest bin down to which at most ``known`` types lie."""
    bin_ = F.floor(F.log2("n") * BINS).cast("int")
    found = counts.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("types"), F.sum("n").alias("n")).collect()
    total, lowest = 0, math.inf
    for row in sorted(found, key=lambda r: -r.bin):
        total += row.types
        if total > known:
            break
        lowest = row.bin
    end = int(END.view(np.int64))
    top = counts.filter((bin_ >= F.lit(float(min(lowest, 1e9)))) | (F.col("h") == end)).select("h", "n").toArrow()
    h, n = [top.column(c).to_numpy().astype(np.int64) for c in ("h", "n")]
    order = np.lexsort((h, -n))
    chosen = order[:net_words]
    if len(h) > net_words and not (h[chosen] == end).any():
        chosen[-1] = np.flatnonzero(h == end)[0]
    place = np.full(len(h), -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    by_hash = np.argsort(h)
    return Vocabulary(h[by_hash], n[by_hash], place[by_hash], sum(r.n for r in found), sum(r.types for r in found), n[chosen])


# ------------------------------------------------------------------- network

class Network:
    """Weights of the recurrent network. Inputs: a place, ``words`` for other
    words, ``words`` + 1 before the first token. Outputs: the classes, the shared
    class last, and the places inside each class."""
    NAMES = ("embed", "inward", "onward", "bias", "classes", "class_bias", "inside", "inside_bias")

    def __init__(self, words: int, params: dict[str, np.ndarray]):
        self.words, self.p = words, params

    @classmethod
    def fresh(cls, vocab: Vocabulary, hidden: int = HIDDEN, seed: int = 3) -> Network:
        """Random recurrent weights; the output starts as the unigram shares."""
        rng = np.random.default_rng(seed)
        words = len(vocab.net)
        k = -(-words // CLASS_WORDS)
        share = np.full(k * CLASS_WORDS, 1e-30)
        share[:words] = vocab.net / max(1, vocab.n + vocab.types + 1)
        share = share.reshape(k, CLASS_WORDS)
        mass = np.append(share.sum(1), vocab.rest / max(1, vocab.n + vocab.types + 1))
        inner = np.where(np.arange(k * CLASS_WORDS).reshape(k, CLASS_WORDS) < words, np.log(share), -1e4)
        normal = lambda scale, *shape: rng.normal(0, scale, shape)
        p = {"embed": normal(0.3, words + 2, hidden), "inward": normal(hidden ** -0.5, hidden, 3 * hidden),
             "onward": normal(hidden ** -0.5, hidden, 3 * hidden), "bias": np.zeros(3 * hidden),
             "classes": np.zeros((hidden, k + 1)), "class_bias": np.log(mass),
             "inside": np.zeros((k, hidden, CLASS_WORDS)), "inside_bias": inner}
        return cls(words, {a: b.astype(np.float32) for a, b in p.items()})

    def packed(self) -> bytes:
        return b"".join(self.p[a].astype(np.float32).tobytes() for a in self.NAMES)

    def unpacked(self, data: bytes) -> Network:
        out, at = {}, 0
        flat = np.frombuffer(data, np.float32)
        for name in self.NAMES:
            shape = self.p[name].shape
            out[name] = flat[at:at + math.prod(shape)].reshape(shape).copy()
            at += math.prod(shape)
        return Network(self.words, out)


# States, gates and logits are held with the positions last, so that sums over
# a state or a class run along whole rows of positions.

def _sigmoid(x: np.ndarray) -> np.ndarray:
    """Of an array that is overwritten."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.divide(1, x, out=x)


def _step(x: np.ndarray, h: np.ndarray, onward: np.ndarray):
    """One gated step (``onward`` transposed): new state, gates and what the
    backward pass needs."""
    k = len(h)
    u = onward @ h
    gates = _sigmoid(x[:2 * k] + u[:2 * k])
    z, r, m = gates[:k], gates[k:], u[2 * k:]
    new = r * m
    new += x[2 * k:]
    np.tanh(new, out=new)
    out = h - new
    out *= z
    out += new
    return out, z, r, m, new


def _pieces(a: int, b: int) -> Iterator[tuple[int, int]]:
    return ((i, min(i + LOGITS, b)) for i in range(a, b, LOGITS))


def _by_class(target: np.ndarray, words: int):
    """(order, [(class, from, to)]): the positions of network words by class,
    at most ``LOGITS`` at once."""
    label = np.where(target < words, target // CLASS_WORDS, -1).astype(np.int16)
    order = np.argsort(label, kind="stable")
    classes, start = np.unique(label[order], return_index=True)
    ends = np.append(start[1:], len(order))
    return order, [(int(c), i, j) for c, a, b in zip(classes, start, ends) if c >= 0 for i, j in _pieces(int(a), int(b))]


#: Reach of the states within which no logit leaves the range of the exponential.
SAFE = 30.0


def _output(weight: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, bool]:
    """(weights with the bias as one more input, whether logits may be taken as
    they are): less a bound, by states within -1 and 1, they are 0 at most."""
    reach = np.abs(weight).sum(-2)
    bias = bias - (bias + reach).max(-1, keepdims=True)
    return np.concatenate([weight, bias[..., None, :]], -2), bool(reach.max(initial=0) <= SAFE)


def _softmax(weight: np.ndarray, states: np.ndarray, target: np.ndarray, safe: bool) -> tuple[np.ndarray, ...]:
    """(target's logit, exponentials, their sums) of outputs with a bias."""
    x = weight.T @ states
    if not safe:
        x -= x.max(0)
    hit = x[target, np.arange(len(target))]
    np.exp(x, out=x)
    return hit, x, x.sum(0)


def _softmax_loss(weight: np.ndarray, states: np.ndarray, target: np.ndarray, safe: bool) -> tuple[float, np.ndarray]:
    """(summed loss, its gradient by logit)."""
    hit, x, total = _softmax(weight, states, target, safe)
    x *= 1 / total
    x[target, np.arange(len(target))] -= 1
    return float((np.log(total) - hit).sum()), x


def log_probs(net: Network, states: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log probability of each target place (shared class: of the class)."""
    p, last = net.p, net.p["classes"].shape[1] - 1
    states = np.concatenate([states.T, np.ones((1, len(target)), states.dtype)])
    label = np.where(target < net.words, target // CLASS_WORDS, last)
    out = np.empty(len(target), states.dtype)
    weight, safe = _output(p["classes"], p["class_bias"])
    for a, b in _pieces(0, len(target)):
        hit, _, total = _softmax(weight, states[:, a:b], label[a:b], safe)
        out[a:b] = hit - np.log(total)
    order, groups = _by_class(target, net.words)
    by_class, places = states.take(order, 1), target[order] % CLASS_WORDS
    weight, safe = _output(p["inside"], p["inside_bias"])
    for c, a, b in groups:
        hit, _, total = _softmax(weight[c], by_class[:, a:b], places[a:b], safe)
        out[order[a:b]] += hit - np.log(total)
    return out


def _output_gradient(net: Network, states: np.ndarray, target: np.ndarray, grad: dict) -> tuple[float, np.ndarray]:
    """Summed loss and its gradient by state; weight gradients go to ``grad``.
    The states have a last row of ones."""
    p, last = net.p, net.p["classes"].shape[1] - 1
    label = np.where(target < net.words, target // CLASS_WORDS, last)
    loss, back, inner = 0.0, np.empty_like(states[:-1]), np.zeros_like(states[:-1])
    weight, safe = _output(p["classes"], p["class_bias"])
    for a, b in _pieces(0, len(target)):
        h = states[:, a:b]
        more, d = _softmax_loss(weight, h, label[a:b], safe)
        loss += more
        g = (d @ h.T).T
        grad["classes"] += g[:-1]
        grad["class_bias"] += g[-1]
        back[:, a:b] = p["classes"] @ d
    order, groups = _by_class(target, net.words)
    by_class, places = states.take(order, 1), target[order] % CLASS_WORDS
    weight, safe = _output(p["inside"], p["inside_bias"])
    for c, a, b in groups:
        h = by_class[:, a:b]
        more, d = _softmax_loss(weight[c], h, places[a:b], safe)
        loss += more
        g = (d @ h.T).T
        grad["inside"][c] += g[:-1]
        grad["inside_bias"][c] += g[-1]
        inner[:, a:b] = p["inside"][c] @ d
    back[:, order] += inner
    return loss, back


def window_gradient(net: Network, inputs: np.ndarray, target: np.ndarray, live: np.ndarray, h: np.ndarray):
    """(loss, gradients, last state) of one window (steps x runs); the state
    that enters the window is a constant."""
    p = net.p
    steps, runs = inputs.shape
    k, ids = h.shape[1], inputs.ravel()
    grad = {a: np.zeros_like(b) for a, b in p.items()}
    x = np.ascontiguousarray((p["embed"] @ p["inward"] + p["bias"])[ids].T).reshape(3 * k, steps, runs)
    onward, held, states = np.ascontiguousarray(p["onward"].T), [], np.ones((k + 1, steps + 1, runs), x.dtype)
    states[:k, 0] = h.T
    for t in range(steps):
        states[:k, t + 1], *kept = _step(x[:, t], states[:k, t], onward)
        held.append(kept)
    after, on = states[:, 1:].reshape(k + 1, -1), np.flatnonzero(live)
    loss, back_live = _output_gradient(net, after.take(on, 1), target.ravel()[on], grad)
    back = np.zeros((k, steps * runs), x.dtype)
    back[:, on] = back_live
    back = back.reshape(k, steps, runs)
    dx, du = x, np.empty_like(x)      # the inputs are not needed any more
    dh = np.zeros((k, runs), x.dtype)
    for t in range(steps - 1, -1, -1):
        z, r, m, new = held[t]
        dh += back[:, t]
        dn = (dh - dh * z) * (1 - new * new)
        dx[:k, t] = dh * (states[:k, t] - new) * (z - z * z)
        dx[k:2 * k, t] = dn * m * (r - r * r)
        dx[2 * k:, t], du[2 * k:, t] = dn, dn * r
        du[:2 * k, t] = dx[:2 * k, t]
        dh *= z
        dh += p["onward"] @ du[:, t]
    flat = dx.reshape(3 * k, -1)
    grad["onward"] += states[:k, :-1].reshape(k, -1) @ du.reshape(3 * k, -1).T
    grad["inward"] += (flat @ p["embed"][ids]).T
    grad["bias"] += flat.sum(1)
    order = np.argsort(ids.astype(np.int16), kind="stable")
    seen, start = np.unique(ids[order], return_index=True)
    grad["embed"][seen] = np.add.reduceat((flat.T @ p["inward"].T)[order], start)
    return loss, grad, states[:k, -1].T


class Trainer:
    """Adam over the windows of batches of runs."""

    def __init__(self, net: Network, rate: float):
        self.net, self.rate, self.t, self.seen = net, rate, 0, 0
        self.m = {a: np.zeros_like(b) for a, b in net.p.items()}
        self.v = {a: np.zeros_like(b) for a, b in net.p.items()}

    def learn(self, runs: list[np.ndarray]) -> float:
        """One pass over some runs (arrays of inputs; each also is the target
        of the one before it); returns the summed loss."""
        runs = sorted((r for r in runs if len(r) > 1), key=len)
        if not runs:
            return 0.0
        longest = len(runs[-1]) - 1
        grid = np.full((longest + 1, len(runs)), self.net.words, np.int64)
        for j, r in enumerate(runs):
            grid[:len(r), j] = r
        live = np.arange(longest)[:, None] < np.array([len(r) - 1 for r in runs])
        h, total = np.zeros((len(runs), self.net.p["onward"].shape[0]), np.float32), 0.0
        for a in range(0, longest, WINDOW):
            on = live[a:a + WINDOW]
            going = on.any(0)            # runs that end before this window leave the batch
            grid, live, h, on = grid[:, going], live[:, going], h[going], on[:, going]
            b = a + len(on)
            loss, grad, h = window_gradient(self.net, grid[a:b], grid[a + 1:b + 1], on, h)
            self._update(grad, int(on.sum()))
            total += loss
        return total

    def _update(self, grad: dict[str, np.ndarray], n: int) -> None:
        self.t += 1
        self.seen += n
        size = math.sqrt(sum(float((g * g).sum()) for g in grad.values())) / n
        scale = np.float32(min(1.0, 1.0 / max(size, 1e-9)) / n)
        rate = self.rate * math.sqrt(1 - 0.99 ** self.t) / (1 - 0.9 ** self.t)
        for name, g in grad.items():
            g *= scale
            m, v = self.m[name], self.v[name]
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.01) * (g * g - v)
            self.net.p[name] -= np.float32(rate) * m / (np.sqrt(v) + np.float32(1e-8))


def run_loss(net: Network, runs: list[np.ndarray]) -> float:
    """Summed loss of some runs."""
    runs = [r for r in runs if len(r) > 1]
    return -float(document_scores(net, [r[1:] for r in runs], np.array([r[0] for r in runs], np.int64)).sum())


def warmed(vocab: Vocabulary, runs: list[np.ndarray], checks: list[np.ndarray], rounds: int = WARM_ROUNDS) -> Network:
    """The best network, by its loss on ``checks``, of those after 0 to
    ``rounds`` passes over a bounded set of runs."""
    net = Network.fresh(vocab)
    rng, trainer = np.random.default_rng(4), Trainer(net, WARM_RATE)
    least, kept = run_loss(net, checks), net.packed()
    for k in range(rounds):
        trainer.rate = WARM_RATE * (1 - 0.8 * k / rounds)
        order = rng.permutation(len(runs))
        for a in range(0, len(order), WARM_BATCH):
            trainer.learn([runs[i] for i in order[a:a + WARM_BATCH]])
        loss = run_loss(net, checks)
        if loss > least:
            break
        least, kept = loss, net.packed()
    return net.unpacked(kept)


def document_scores(net: Network, places: list[np.ndarray], inputs: np.ndarray | None = None) -> np.ndarray:
    """Summed natural log probability of each document's tokens, given as
    places (``words`` for the shared class); the state runs from the first
    token of a document to its last. ``inputs``: what comes before the first
    token, if not the beginning of a text."""
    out = np.zeros(len(places))
    if not len(places):
        return out
    order = np.argsort([-len(x) for x in places], kind="stable")
    length = np.array([len(places[i]) for i in order])
    flat = np.concatenate([places[i] for i in order])
    first = np.concatenate([[0], np.cumsum(length)])[:-1]
    table = np.ascontiguousarray((net.p["embed"] @ net.p["inward"] + net.p["bias"]).T)
    onward = np.ascontiguousarray(net.p["onward"].T)
    h = np.zeros((len(onward[0]), len(order)), np.float32)
    t = 0
    while t < length[0]:
        going = int(np.searchsorted(-length, -t, "left"))     # longer than t
        stop = min(int(length[0]), t + max(1, STATES // going))
        on = np.searchsorted(-length[:going], -np.arange(t, stop), "left")
        begin = np.concatenate([[0], np.cumsum(on)])
        doc = np.arange(begin[-1]) - np.repeat(begin[:-1], on)
        at = first[doc] + np.repeat(np.arange(t, stop), on)
        target, before = flat[at], flat[at - 1]
        if t == 0:
            before[:going] = net.words + 1 if inputs is None else inputs[order]
        x, states = table.take(before, 1), np.empty((len(h), len(at)), np.float32)
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
            states[:, a:b] = h = _step(x[:, a:b], h[:, :b - a], onward)[0]
        score = log_probs(net, states.T, target)
        out += np.bincount(order[doc], score.astype(np.float64), len(out))
        t = stop
    return out


# --------------------------------------------------------------- Spark passes

def count_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """(h, n) over every token of every text."""
    return stored(docs.select(F.col(text)).mapInArrow(_counted, "h long, n long").groupBy("h").agg(
        F.sum("n").alias("n")), "token-counts")


def training_runs(docs: DataFrame, shared, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(place, run): every document as runs of places, as 16-bit numbers. A run
    begins with what comes before its first token: the token before, or the
    beginning of the text. ``place`` is a hash of the document and the run."""
    body = F.coalesce(F.col(text), F.lit(""))
    parts = docs.select(F.xxhash64(F.col(key), body).alias("place"), body.alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        words = len(vocab.net)
        for batch in batches:
            for a, b, texts in tb.pieces(batch.column(1)):
                h, first = tokens(texts)
                ids = vocab.look_up(h)[1]
                # the beginning of a text stands before its tokens
                ids = np.insert(np.where(ids < 0, words, ids), first[:-1], words + 1).astype(np.int16)
                begin, count = first[:-1] + np.arange(b - a), np.diff(first)
                runs = -(-count // RUN_TOKENS)
                doc = np.repeat(np.arange(b - a), runs)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs)
                start = begin[doc] + number * RUN_TOKENS
                size = np.minimum(RUN_TOKENS, count[doc] - number * RUN_TOKENS) + 1
                place = batch.column(0).slice(a, b - a).to_numpy().astype(np.int64).view(tb.U64)[doc]
                place = np.where(number > 0, tb.mix(place + tb.mix(number.astype(tb.U64))), place).view(np.int64)
                ends = np.concatenate([[0], np.cumsum(size)])
                flat = ids[np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)]
                out = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer((2 * ends).astype(np.int32)), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([pa.array(place), out], names=["place", "run"])

    return stored(parts.mapInArrow(run, "place long, run binary"), "runs")


def _runs(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int16).astype(np.int64) for x in column.to_pylist()]


def _slices(data: bytes) -> list[bytes]:
    """Packed weights cut into slices of ``SLICE`` numbers."""
    return [data[a:a + 4 * SLICE] for a in range(0, len(data), 4 * SLICE)]


def _weighted_mean(weights: np.ndarray, rows: list[bytes]) -> bytes:
    total = sum(np.frombuffer(x, np.float32).astype(np.float64) * w for w, x in zip(weights, rows))
    return (total / max(weights.sum(), 1e-9)).astype(np.float32).tobytes()


def averaged(trained: DataFrame) -> bytes:
    """Mean of the trainers' packed weights by ``weight``, slice by slice: a
    group is a slice of all trainers, and only means are collected."""
    def mean(key, rows):
        rows = rows.sort_by([("weight", "ascending"), ("net", "ascending")])   # sums do not follow the order of arrival
        data = _weighted_mean(rows.column("weight").to_numpy(), rows.column("net").to_pylist())
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "net": pa.array([data], pa.binary())})

    means = trained.groupBy("slice").applyInArrow(mean, "slice int, net binary").toArrow().sort_by("slice")
    return b"".join(means.column("net").to_pylist())


def refined(net: Network, runs: DataFrame, n: int) -> Network:
    """Trainers go on from ``net`` over all runs of all documents, each over
    its share, and their weights are averaged."""
    trainers = max(1, min(MOST_TRAINERS, n // TRAINER_RUNS))
    shared = runs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = shared.value
        trainer = Trainer(base.unpacked(base.packed()), 0.004)
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                trainer.learn(_runs(batch.column(1).slice(a, BATCH)))
        if trainer.seen:
            cut = _slices(trainer.net.packed())
            yield pa.RecordBatch.from_arrays([pa.array(range(len(cut)), pa.int32()), pa.array([float(trainer.seen)] * len(cut)),
                                              pa.array(cut, pa.binary())], names=["slice", "weight", "net"])

    data = averaged(runs.repartition(trainers, "place").sortWithinPartitions("place", "run").mapInArrow(
        run, "slice int, weight double, net binary"))
    return net.unpacked(data) if data else net


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[Vocabulary, Network, DataFrame]:
    """(vocabulary, network, counts) of the documents."""
    sc = docs.sparkSession.sparkContext
    counts = count_tokens(docs, text)
    vocab = vocabulary(counts)
    runs = training_runs(docs, sc.broadcast(vocab), key, text)
    n = runs.count()
    warm = F.pmod(F.xxhash64("place", F.lit(9)), F.lit(max(1, n))) < WARM_RUNS
    check = warm & (F.pmod(F.xxhash64("place", F.lit(10)), F.lit(10)) == 0)
    some = runs.filter(warm).select("place", "run", check.alias("check")).orderBy("place", "run").limit(2 * WARM_RUNS).toArrow()
    sets = [[r for r, c in zip(_runs(some.column("run")), some.column("check").to_pylist()) if c == x] for x in (False, True)]
    first = warmed(vocab, *sets)
    second = refined(first, runs.filter(~check), n)
    return vocab, min(first, second, key=lambda net: run_loss(net, sets[1])), counts


def _scored(shared):
    names = ["uid", "doc_id", "n_tokens", "n_known", "log_counts", "score", "rest"]

    def flush(vocab, net, pool):
        counts, places = zip(*[vocab.look_up(h) for _, h, _ in pool])
        words = len(vocab.net)
        shared_mass = math.log10(vocab.rest)
        ids, docs, n, known, logs, tail, rest = [], [], [], [], [], [], []
        sequences = []
        for (_, h, first), count, place in zip(pool, counts, places):
            gain = np.log10(count + 1.0)
            outside = (place < 0)
            place = np.where(outside, words, place)
            unknown = count == 0
            for d in range(len(first) - 1):
                a, b = first[d], first[d + 1]
                sequences.append(place[a:b])
                n.append(b - a)
                known.append(b - a - int(unknown[a:b].sum()))
                logs.append(float(gain[a:b].sum()))
                tail.append(float(gain[a:b][outside[a:b]].sum()) - shared_mass * int(outside[a:b].sum()))
                rest.append(h[a:b][unknown[a:b]])
        model = document_scores(net, sequences) / math.log(10) + np.array(tail)
        ids = pa.concat_arrays([rows.column(0) for rows, _, _ in pool])
        docs = pa.concat_arrays([rows.column(1) for rows, _, _ in pool])
        ends = np.concatenate([[0], np.cumsum([len(x) for x in rest])]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [ids, docs, pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(logs, pa.float64()), pa.array(model),
             pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rest), pa.int64()))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, net = shared.value
        pool, held = [], 0
        for batch in batches:
            for a, b, texts in tb.pieces(batch.column(2)):
                pool.append((batch.slice(a, b - a).select([0, 1]), *tokens(texts)))
                held += len(pool[-1][1])
                if held >= POOL:
                    yield flush(vocab, net, pool)
                    pool, held = [], 0
        if pool:
            yield flush(vocab, net, pool)

    return run


def score(docs: DataFrame, model: tuple[Vocabulary, Network, DataFrame], key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every
    document. Tokens beyond the broadcast words find their counts by a join."""
    vocab, net, counts = model
    shared = docs.sparkSession.sparkContext.broadcast((vocab, net))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scored = stored(rows.mapInArrow(
        _scored(shared), "uid long, doc_id long, n_tokens long, n_known long, log_counts double, score double, rest array<long>"), "scored")
    found = scored.select("uid", F.explode("rest").alias("h")).join(counts, "h").groupBy("uid").agg(
        F.count(F.lit(1)).alias("k"), F.sum(F.log10(F.col("n") + F.lit(1.0))).alias("gain"))
    gain, k = F.coalesce("gain", F.lit(0.0)), F.coalesce("k", F.lit(0))
    base = F.col("log_counts") + gain - F.col("n_tokens") * F.lit(math.log10(vocab.n + vocab.types + 1))
    return scored.drop("rest").join(found, "uid", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + k).alias("n_known"), F.lit(vocab.n).cast("long").alias("train_tokens"),
        base.alias("base_score"), (F.col("score") + gain).alias("score"))
