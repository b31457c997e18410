"""Language identification by interpolated Kneser-Ney character models.

One model of order 4 per language over lower-cased letters and word gaps.
Counts come from every learning document: tasks count their character 4-grams
in sorted arrays, Spark sums them. The lower orders use continuation counts,
derived from the distinct longer grams. A model is a few sorted hash arrays;
a text gets the language with the lowest cross-entropy for each character.

Rejection is calibrated: a text is rejected if its cross-entropy is above that
of all but ``REJECT_SHARE`` of the learning texts of the same language, all of
which are scored. The query of this operator must answer with a learned language, so
it reports rejection in a column of its own.

Every gram counts, whatever the size of the input. A model of at most
``MODEL_GRAMS`` 4-grams is gathered and broadcast; a larger one stays in Spark:
continuation counts and context sums are aggregates, and the distinct grams of
the texts are joined with them. Both ways use the same formulas.

Defined cases: null texts and texts without a letter get ``und`` and score 0;
rows without a language are not learned from but are predicted; with nothing
to learn from every text is ``und``; repeated rows count as often as they
occur; long texts are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .common import held_out, stored
from .fitting import quantiles

ORDER = 4
#: 4-grams up to which the model is broadcast; larger models are joined.
MODEL_GRAMS = 2_000_000
REJECT_SHARE = 0.002
#: Entries of a task's table before it is flushed, and bytes of its cache of
#: scored grams (a number for each language and gram).
TABLE_ROWS = 1_000_000
CACHE_BYTES = 64 << 20
#: Characters that count as evidence in the score.
EVIDENCE_CHARS = 60
UNKNOWN = "und"

_alpha: list[np.ndarray] = []


def is_letter(c: np.ndarray) -> np.ndarray:
    if not _alpha:
        _alpha.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _alpha[0][c]


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, of): three zeros before each text, letters lower-cased, all
    between letters one space; ``of`` is the text of each code, -1 for zeros."""
    pad = "\0" * (ORDER - 1)
    low = [t.lower().replace("\0", " ") for t in texts]
    c = np.frombuffer((pad + pad.join(low)).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t) for t in low), np.int64, len(low))
    of = np.repeat(np.arange(len(low)), lengths + (ORDER - 1))
    zero = c == 0
    c = np.where(is_letter(c) | zero, c, np.uint32(32))
    keep = np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])
    c, of = c[keep], of[keep]
    return c, np.where(c == 0, -1, of)


def gram_hash(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of n-grams given as n columns of code points."""
    out = np.full(len(columns[0]), len(columns), tb.U64)
    for j, c in enumerate(columns):
        out += tb.mix(c.astype(tb.U64) + tb.U64(1)) * tb.SEQ_MULT[j]
    return tb.mix(out)


def grams(c: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, text) of the 4-gram that ends at each letter or space;
    its code points are c[place:place + 4]."""
    if len(c) < ORDER:
        return np.zeros(0, tb.U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = tb.mix(c.astype(tb.U64) + tb.U64(1))
    out = np.full(len(c) - ORDER + 1, ORDER, tb.U64)
    for j in range(ORDER):
        out += h[j:j + len(out)] * tb.SEQ_MULT[j]
    place = np.flatnonzero(of[ORDER - 1:] >= 0)
    return tb.mix(out[place]), place, of[place + ORDER - 1]


def _packed(c: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    two = lambda i: (c[place + i].astype(np.int64) << 32) | c[place + i + 1]
    return two(0), two(2)


class _Tally:
    """Counts by (language, gram) of one task, merged as sorted arrays."""

    def __init__(self):
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, *columns: np.ndarray) -> None:
        self.rows.append(columns)
        self.size += len(columns[0])
        if len(self.rows) > 16:
            self.merge()

    def merge(self) -> None:
        lang, a, b, n = (np.concatenate(x) for x in zip(*self.rows))
        key = gram_hash([lang, a, b])
        order = np.argsort(key)
        first = np.flatnonzero(np.diff(key[order], prepend=key[order[:1]] + tb.U64(1)))
        at = order[first]
        self.rows = [(lang[at], a[at], b[at], np.add.reduceat(n[order], first))]
        self.size = len(at)


def _count(names: list[str]):
    number = {name: i for i, name in enumerate(names)}
    fields = ["lang", "a", "b", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()

        def flush():
            tally.merge()
            columns = tally.rows[0]
            tally.rows, tally.size = [], 0
            for i in range(0, len(columns[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i:i + 100_000], pa.int64()) for x in columns], names=fields)

        for batch in batches:
            langs = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            for a, b, some in tb.pieces(batch.column(1)):
                c, of = normalised(some)
                h, place, text = grams(c, of)
                if not len(h):
                    continue
                h ^= tb.mix(langs[a:b].astype(tb.U64) + tb.U64(7))[text]
                _, at, n = np.unique(h, return_index=True, return_counts=True)
                tally.add(langs[a:b][text[at]], *_packed(c, place[at]), n)
                if tally.size > TABLE_ROWS:
                    yield from flush()
        if tally.rows:
            yield from flush()

    return run, "lang long, a long, b long, n long"


def _lookup(keys: np.ndarray, values: np.ndarray, h: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(h), missing)
    slot = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[slot] == h, values[slot], missing)


def _discount(ones: int, twos: int) -> float:
    return float(np.clip(ones / max(1, ones + 2 * twos), 0.1, 0.9))


@dataclass
class Model:
    """One language: for each order sorted gram hashes with the discounted
    probability, and sorted context hashes with the weight of the lower order."""
    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    contexts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    floor: float = 1.0

    @classmethod
    def of(cls, codes: np.ndarray, n: np.ndarray) -> Model:
        """From the distinct 4-grams (rows of ``codes``) and their counts."""
        out, orders = cls(), []
        for order in range(ORDER, 0, -1):
            orders.append((codes, n))
            codes, n = np.unique(codes[:, 1:], axis=0, return_counts=True) if order > 1 else (codes, n)
        for codes, n in reversed(orders):                     # order 1 first
            discount = _discount((n == 1).sum(), (n == 2).sum())
            context, which = np.unique(codes[:, :-1], axis=0, return_inverse=True)
            which = which.ravel()
            total = np.bincount(which, n)
            rest = discount * np.bincount(which) / total
            out.grams.append(_sorted(codes, np.maximum(n - discount, 0) / total[which]))
            out.contexts.append(_sorted(context, rest) if codes.shape[1] > 1 else (np.zeros(0, tb.U64), rest))
        out.floor = 1.0 / (len(orders[-1][0]) + 1)
        return out

    def log_prob(self, columns: list[np.ndarray]) -> np.ndarray:
        """log p(last character | the three before)."""
        p = np.full(len(columns[0]), self.floor)
        for order in range(1, ORDER + 1):
            tail = columns[ORDER - order:]
            keys, value = self.grams[order - 1]
            rest = self.contexts[0][1][0] if order == 1 else _lookup(*self.contexts[order - 1], gram_hash(tail[:-1]), 1.0)
            p = _lookup(keys, value, gram_hash(tail), 0.0) + rest * p
        return np.log(p)


def _sorted(codes: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = gram_hash(list(codes.T))
    order = np.argsort(h)
    return h[order], value[order]


def _entropies(models: list[Model], texts: list[str], cache: dict, most: int) -> tuple[np.ndarray, np.ndarray]:
    """``Identifier.entropies`` for some models; their scores of grams are kept in ``cache``."""
    c, of = normalised(texts)
    letters = np.bincount(of[of >= 0], is_letter(c[of >= 0]), len(texts)) if len(c) else np.zeros(len(texts))
    h, place, text = grams(c, of)
    keys, at, inverse = np.unique(h, return_index=True, return_inverse=True)
    known, table = cache.get("keys", np.zeros(0, tb.U64)), cache.get("table", np.zeros((0, len(models))))
    slot = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
    old = known[slot] == keys if len(known) else np.zeros(len(keys), bool)
    logs = np.empty((len(keys), len(models)))
    logs[old] = table[slot[old]]
    new = np.flatnonzero(~old)
    columns = [c[place[at[new]] + j] for j in range(ORDER)]
    for i, model in enumerate(models):
        logs[new, i] = model.log_prob(columns)
    if (len(known) + len(new)) * 8 * (1 + len(models)) > most:
        cache["keys"], cache["table"] = keys, logs
    elif len(new):
        every, rows = np.concatenate([known, keys[new]]), np.concatenate([table, logs[new]])
        order = np.argsort(every)
        cache["keys"], cache["table"] = every[order], rows[order]
    chars = np.bincount(text, minlength=len(texts))
    sums = np.stack([np.bincount(text, logs[inverse, i], len(texts)) for i in range(len(models))], 1)
    return -sums / np.maximum(chars, 1)[:, None], np.where(letters > 0, chars, 0)


@dataclass
class Identifier:
    """The models of all languages and their rejection bounds."""
    names: list[str]
    models: list[Model]
    bounds: np.ndarray

    def entropies(self, texts: list[str], cache: dict) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy for each text and language, characters); texts
        without a letter have 0 characters."""
        return _entropies(self.models, texts, cache, CACHE_BYTES)

    def own_entropies(self, texts: list[str], which: np.ndarray, caches: dict) -> np.ndarray:
        """Cross-entropy of each text under the model of its language, 0 for
        texts without a letter; ``which``: the places of the languages."""
        out = np.zeros(len(texts))
        for i in np.unique(which):
            mine = np.flatnonzero(which == i)
            entropy, chars = _entropies([self.models[i]], [texts[k] for k in mine], caches.setdefault(int(i), {}),
                                        CACHE_BYTES // len(self.models))
            out[mine] = np.where(chars > 0, entropy[:, 0], 0.0)
        return out

    def predict(self, texts: list[str], cache: dict) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, cross-entropy, rejected) of each text."""
        return self.judge(*self.entropies(texts, cache))

    def judge(self, entropy: np.ndarray, chars: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        best = entropy.argmin(1)
        evidence = -entropy * np.minimum(chars, EVIDENCE_CHARS)[:, None]
        share = np.exp(evidence - evidence.max(1, keepdims=True))
        score = np.where(chars > 0, share.max(1) / share.sum(1), 0.0)
        low = entropy[np.arange(len(chars)), best]
        names = [self.names[b] if n else UNKNOWN for b, n in zip(best, chars)]
        return names, score, np.where(chars > 0, low, 0.0), (chars == 0) | (low > self.bounds[best])


def learning_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.filter(~held_out(F.col(key)) & F.col("lang").isNotNull()).select("lang", "text")


def _chars(order: int) -> list[str]:
    """Columns of the last ``order`` characters of a 4-gram."""
    return [f"c{i}" for i in range(ORDER - order, ORDER)]


def _unpacked(rows: DataFrame, *others: str) -> DataFrame:
    """Columns a and b as the four characters c0 to c3."""
    low = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))
    return rows.select(*others, F.shiftright("a", 32).alias("c0"), low("a").alias("c1"),
                       F.shiftright("b", 32).alias("c2"), low("b").alias("c3"))


def _text_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> for each text one head row with its doc_id and
    characters (0 without a letter), and one row for each distinct gram. A
    head's ``a`` is negative and its own, so it meets no gram and no other head."""
    fields, done = ["row", "doc_id", "chars", "a", "b", "n"], TaskContext.get().partitionId() << 33
    kinds = [pa.int64()] * len(fields)

    def out(size: int, **columns) -> Iterator[pa.RecordBatch]:
        for i in range(0, size, 100_000):
            m = min(size - i, 100_000)
            yield pa.RecordBatch.from_arrays(
                [columns[f].slice(i, m).cast(k) if f in columns else pa.nulls(m, k) for f, k in zip(fields, kinds)],
                names=fields)

    for batch in batches:
        for a, b, some in tb.pieces(batch.column(1)):
            c, of = normalised(some)
            h, place, text = grams(c, of)
            letters = np.bincount(of[of >= 0], is_letter(c[of >= 0]), len(some))
            chars = np.where(letters > 0, np.bincount(text, minlength=len(some)), 0)
            rows = done + np.arange(b - a)
            yield from out(b - a, row=pa.array(rows), doc_id=batch.column(0).slice(a, b - a), chars=pa.array(chars),
                           a=pa.array(-1 - rows), b=pa.array(np.zeros(b - a, np.int64)))
            _, at, n = np.unique(h ^ tb.mix(text.astype(tb.U64) + tb.U64(7)), return_index=True, return_counts=True)
            at, n = at[letters[text[at]] > 0], n[letters[text[at]] > 0]
            first, second = _packed(c, place[at])
            yield from out(len(at), row=pa.array(done + text[at]), a=pa.array(first), b=pa.array(second), n=pa.array(n))
            done += b - a


def _distinct_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> the distinct grams (a, b) of some texts at a time."""
    for batch in batches:
        for _, _, some in tb.pieces(batch.column(0), 1 << 21):
            c, of = normalised(some)
            h, place, _ = grams(c, of)
            first, second = _packed(c, place[np.unique(h, return_index=True)[1]])
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(second, pa.int64())], names=["a", "b"])


@dataclass
class JoinedIdentifier(Identifier):
    """The models of all languages as stored tables, for any number of grams:
    ``grams[o - 1]`` has the counts of order o, ``contexts[o - 1]`` the sum and
    number of its grams by context. On the driver are a few numbers for each
    language: its number in the tables, the discounts by order, the floor."""
    grams: list[DataFrame] = field(default_factory=list)
    contexts: list[DataFrame] = field(default_factory=list)
    discounts: list[list[float]] = field(default_factory=list)
    numbers: list[int] = field(default_factory=list)
    floor: list[float] = field(default_factory=list)

    @classmethod
    def of(cls, counts: DataFrame, every: list[str]) -> JoinedIdentifier:
        """From the counts (lang, a, b, n); ``lang`` is a place in ``every``."""
        out = cls(every, [], np.full(len(every), np.inf))
        grams = stored(_unpacked(counts, "lang", "n"), "grams4")
        for order in range(ORDER, 0, -1):
            if order < ORDER:                                 # continuation counts
                grams = stored(grams.groupBy("lang", *_chars(order)).agg(F.count(F.lit(1)).alias("n")), f"grams{order}")
            # one row a language
            facts = {r["lang"]: r for r in grams.groupBy("lang").agg(
                F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos"),
                F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).collect()}
            found = range(len(every))
            out.discounts.insert(0, [_discount(facts[i]["ones"], facts[i]["twos"]) if i in facts else 0.1 for i in found])
            out.grams.insert(0, grams)
            out.contexts.insert(0, stored(grams.groupBy("lang", *_chars(order)[:-1]).agg(
                F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")), f"contexts{order}"))
        known = [i for i in found if i in facts]              # a language without a letter is not learned
        out.numbers, out.names = known, [every[i] for i in known]
        out.bounds = np.full(len(known), np.inf)
        out.floor = [1.0 / (facts[i]["kinds"] + 1) if i in facts else 1.0 for i in found]
        return out

    def _log_probs(self, asked: DataFrame) -> DataFrame:
        """a, b, logs: log p(last character | the three before) by language for
        distinct grams (a, b). Built from order 1 up, so that each step joins a
        gram with the one a character shorter."""
        by_lang = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("lang") + 1).cast("int"))
        wanted = [_unpacked(asked, "a", "b")]
        for order in range(ORDER - 1, 0, -1):
            wanted.insert(0, wanted[0].select(*_chars(order)).distinct())
        langs = F.explode(F.array(*[F.lit(i).cast("long") for i in self.numbers])).alias("lang")
        p = wanted[0].select("*", langs).withColumn("p", by_lang(self.floor))
        for order in range(1, ORDER + 1):
            if order > 1:
                p = wanted[order - 1].join(p, _chars(order - 1))
            discount = by_lang(self.discounts[order - 1])
            p = (p.join(self.contexts[order - 1], ["lang", *_chars(order)[:-1]], "left")
                 .join(self.grams[order - 1], ["lang", *_chars(order)], "left"))
            value = F.coalesce(F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("total"), F.lit(0.0))
            rest = F.coalesce(discount * F.col("kinds") / F.col("total"), F.lit(1.0))
            p = p.withColumn("p", value + rest * F.col("p")).drop("n", "total", "kinds")
            if order < ORDER:
                p = p.select("lang", *_chars(order), "p")
        by_place = F.array_sort(F.collect_list(F.struct("lang", F.log("p").alias("log"))))
        return p.groupBy("a", "b").agg(by_place["log"].alias("logs"))

    def text_entropies(self, pairs: DataFrame) -> DataFrame:
        """doc_id, chars, entropy (by language) for every row of (doc_id, text).
        The grams of the texts are never stored: one pass asks for the distinct
        ones, another sends each text's grams to their log probabilities."""
        asked = pairs.select("text").mapInArrow(_distinct_grams, "a long, b long").distinct()
        logs = stored(self._log_probs(asked), "text-logs")
        rows = pairs.mapInArrow(_text_grams, "row long, doc_id long, chars long, a long, b long, n long")
        sums = rows.join(logs, ["a", "b"], "left").groupBy("row").agg(
            F.max("doc_id").alias("doc_id"), F.max("chars").alias("chars"),
            *[F.sum(F.col("n") * F.col("logs")[i]).alias(f"s{i}") for i in range(len(self.names))])
        entropy = F.array(*[-F.coalesce(f"s{i}", F.lit(0.0)) / F.greatest("chars", F.lit(1)) for i in range(len(self.names))])
        return sums.select("doc_id", "chars", entropy.alias("entropy"))

    def own_bounds(self, rows: DataFrame) -> np.ndarray:
        """As ``_bounds``, with the texts scored by joins."""
        place = F.lit(None).cast("long")
        for i, name in enumerate(self.names):
            place = F.when(F.col("lang") == name, F.lit(i).cast("long")).otherwise(place)
        got = self.text_entropies(rows.filter(F.col("lang").isin(self.names)).select(place.alias("doc_id"), "text"))
        own = F.col("entropy")[F.col("doc_id").cast("int")]
        return _quantiles(got.filter("chars > 0").select(F.col("doc_id").cast("int").alias("grp"), own.alias("value")),
                          list(range(len(self.names))))

    def identify(self, pairs: DataFrame) -> DataFrame:
        plain = Identifier(self.names, [], self.bounds)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    entropy = np.stack(batch.column(2).to_numpy(zero_copy_only=False))
                    found = plain.judge(entropy, batch.column(1).to_numpy())
                    yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found)], names=FOUND)

        return self.text_entropies(pairs).mapInArrow(run, FOUND_SCHEMA)


def fit(rows: DataFrame) -> Identifier | None:
    """Learn from all rows (lang, text); None if there is nothing to learn."""
    names = sorted(r["lang"] for r in rows.select("lang").distinct().collect())        # one row a language
    if not names:
        return None
    run, schema = _count(names)
    counts = rows.mapInArrow(run, schema).groupBy("lang", "a", "b").agg(F.sum("n").alias("n")).persist()
    if counts.count() > MODEL_GRAMS:
        joined = JoinedIdentifier.of(counts, names)
        counts.unpersist()
        joined.bounds = joined.own_bounds(rows)
        return joined
    table = counts.toPandas()
    counts.unpersist()
    models, kept = [], []
    for i, name in enumerate(names):
        own = table[table["lang"] == i]
        if len(own):
            a, b = own["a"].to_numpy(), own["b"].to_numpy()
            codes = np.stack([a >> 32, a & 0xFFFFFFFF, b >> 32, b & 0xFFFFFFFF], 1)
            models.append(Model.of(codes, own["n"].to_numpy().astype(np.int64)))
            kept.append(name)
    if not models:
        return None
    found = Identifier(kept, models, np.full(len(kept), np.inf))
    found.bounds = _bounds(rows, found)
    return found


def _quantiles(found: DataFrame, groups: list) -> np.ndarray:
    high = quantiles(stored(found.filter("value > 0"), "entropies"), dict.fromkeys(groups, 1 - REJECT_SHARE))
    return np.array([high.get(g, np.inf) for g in groups])


def _bounds(rows: DataFrame, model: Identifier) -> np.ndarray:
    """Cross-entropy bound of each language from all its learning texts. The
    texts are read where they are and give a number each."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    known = rows.filter(F.col("lang").isin(model.names)).select("lang", "text")
    return _quantiles(known.mapInArrow(_own_entropy(shared), "grp string, value double"), model.names)


def _own_entropy(shared):
    """lang, text -> the text's cross-entropy under the model of its language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, caches = shared.value, {}
        number = {name: i for i, name in enumerate(model.names)}
        for batch in batches:
            which = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            for a, b, some in tb.pieces(batch.column(1), 1 << 21):
                own = model.own_entropies(some, which[a:b], caches)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(own)], names=["grp", "value"])
    return run


FOUND = ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"]
FOUND_SCHEMA = "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean"


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            for a, b, some in tb.pieces(batch.column(1), 1 << 21):
                if shared.value is None:
                    n = b - a
                    found = [UNKNOWN] * n, np.zeros(n), np.zeros(n), np.ones(n, bool)
                else:
                    found = shared.value.predict(some, cache)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *map(pa.array, found)], names=FOUND)

    return run


def identify(docs: DataFrame, model: Identifier | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy, rejected for every row."""
    pairs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if isinstance(model, JoinedIdentifier):
        return model.identify(pairs)
    return pairs.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model)), FOUND_SCHEMA)
