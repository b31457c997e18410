"""Personal data: exact patterns plus a linear-chain conditional random field.

The base spans of email, ip, card and phone are leftmost, non-overlapping
pattern matches that pass a check. The random field adds what the patterns
cannot: phone numbers without a country code, written-out addresses, cards
with unusual separators, social security numbers. It reads word shapes, is
trained from a small labelled table (``labelled_table``) and decoded by Viterbi
in numpy batches. Its spans are kept if they pass the check of their kind and
touch no base span. Where a span does not pass, its words are decoded again as
the best-scoring sequence of segments that do.

The chain is decoded near words that hold a digit or an ``@`` (or spell out a
dot); words further away than ``CONTEXT`` are fixed at "outside", which cuts
the chain there exactly.

Defined cases: null texts are empty and have no span; repeated rows give
repeated rows; all work is linear in the text, also for one endless word.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "ssn")
CONTEXT = 3
TAGS = ("O", *[f"{p}-{k}" for k in KINDS for p in "BI"])

Span = tuple[int, int, int]          # kind, start, end

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
# a match that starts inside a run of digits would also start at its beginning
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Every ``@`` with a domain after it and at least one local character
    before it that no earlier match has taken."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at)
        if domain:
            start = at
            while start > free and _LOCAL.match(text, start - 1):
                start -= 1
            if start < at:
                out.append((0, start, domain.end()))
                free = domain.end()
        at = text.find("@", max(at + 1, free))
    return out


def card_ok(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and luhn(digits)


def ip_ok(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def base_spans(text: str) -> list[Span]:
    """All base spans, by kind as listed, then by start."""
    out = emails(text) if "@" in text else []
    if _DIGIT.search(text):
        out += [(1, *m.span()) for m in _IP.finditer(text) if ip_ok(m.group())]
        out += [(2, *m.span()) for m in _CARD.finditer(text) if card_ok(_NOT_DIGIT.sub("", m.group()))]
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return out


# ---------------------------------------------------------------- features

_OPEN, _CLOSE = "\"'<[{(", "\"'>]}.,;:!?)"
#: Marks that end a clause; a word may carry one.
_MARKS = ".,;:!?"
#: Words that say something about their neighbours.
CUES = frozenset("""call phone tel telephone mobile fax cell ring text card visa mastercard amex credit debit ssn
    social security ip server host address mail email e-mail at dot (at) (dot) [at] [dot] com org net version
    page chapter section year price order isbn id no number""".split())
DOTS = ("dot", "(dot)", "[dot]")


def shape(token: str) -> str:
    """Digit runs with their length up to 5, letter runs as one letter."""
    t = token.rstrip("\"'>]}.,;:!?") or token
    t = re.sub(r"[0-9]+", lambda m: f"9{min(len(m.group()), 5)}", t)
    return re.sub(r"[^\W\d_]+", "a", t)


def token_features(tokens: list[str]) -> list[list[str]]:
    shapes = [shape(t) for t in tokens]
    cues = [t.lower().strip(_CLOSE[:-1] + "\"'") if len(t) < 16 else "" for t in tokens]
    cues = [c if c in CUES else "" for c in cues]
    ends = [t[-1] if t[-1:] in _MARKS else "" for t in tokens]
    n = len(tokens)
    out = []
    for i in range(n):
        before = shapes[i - 1] if i else "^"
        after = shapes[i + 1] if i + 1 < n else "$"
        out.append(["b", "s=" + shapes[i], "s-=" + before, "s+=" + after, f"p={before}|{shapes[i]}",
                    f"n={shapes[i]}|{after}", "c=" + cues[i], "c-=" + (cues[i - 1] if i else ""),
                    "c+=" + (cues[i + 1] if i + 1 < n else ""), "e=" + ends[i], "e-=" + (ends[i - 1] if i else "")])
    return out


# ------------------------------------------------------------ labelled table

#: Marked sentences; a mark is [kind pattern], 9 stands for a digit.
MARKED = """call me on [phone (999) 999-9999] tomorrow
my number is [phone 999-999-9999] thanks
phone [phone 999.999.9999] or write
tel [phone 999-9999] after six
the fax [phone (999) 999-9999] is broken
reach us at [phone +9 (999) 999-9999] any time
ring [phone +99 99 9999 9999] for details
mobile [phone 9999 999999] only
and [phone (999) 999-9999] of the
the [phone +9 (999) 999-9999] is in
of [phone 999-999-9999] and that
mail [email jane@example.com] please
write to [email jane at example dot com] now
contact [email jane.roe (at) example (dot) org] today
send it to [email bob [at] mail [dot] net] soon
the [email x.99@mail9.example.com] in
the [email jane at example dot com] in
[email mary at host dot org]
of [email bob dot lee at mail dot net] and
or [email jane at example dot com] not
[email ann [at] example [dot] org]
and [email ann (at) example dot com] of
[phone (999) 999-9999]
[phone 999-999-9999]
[ssn 999-99-9999]
look at the dot on page 9
at noon the dot com era began
host [ip 99.999.99.9] is down
from [ip 999.99.9.99] on port 9999
the [ip 99.99.999.999] of
card [card 9999 9999 9999 9999] expires
pay with [card 9999.9999.9999.9999] please
visa [card 9999999999999999] was charged
amex [card 9999 999999 99999] is fine
the [card 9999999999999999] and
at [phone +9 (999) 999-9999] [card 9999999999999999] and
the [card 9999999999999999] [phone +9 (999) 999-9999] of
to [phone (999) 999-9999] [phone +9 (999) 999-9999] in
ssn [ssn 999-99-9999] on file
social security number [ssn 999-99-9999] here
the [ssn 999-99-9999] of
in the year 9999 we moved
page 99 of chapter 9
version 9.9.9 was released
version 9.9 of the tool
on 9999-99-99 it rained
at 99:99 the train left
it costs 9.99 or 99 euros
order 999999 was sent
isbn 999-9-999-99999-9 is out
the score was 9-9 in the end
between 99 and 999 people
rows 9999 to 9999 are empty
9. first 9. second 9. third
and 9. then
section 9.9.9.9 says so
the key AKIA9A9A9AAA is old
hash 9a99a9a9a999a is wrong
password=9a9a9a999a99a9 leaked
follow @name9 for news
the word dot is short
that was it and of in the
about 9,999 of 99,999 files
99% of 9999 cases
room 999-A on floor 9""".splitlines()


Row = tuple[tuple[str, ...], tuple[str, ...]]


def marked_row(line: str) -> Row:
    """(tokens, tags) of a marked sentence."""
    tokens, tags, kind, inside = [], [], None, False
    for word in line.split():
        if word[0] == "[" and word[1:] in KINDS:
            kind, inside = word[1:], False
            continue
        last = kind is not None and word.endswith("]") and word not in ("[at]", "[dot]")
        tokens.append(word[:-1] if last else word)
        tags.append("O" if kind is None else f"{'I' if inside else 'B'}-{kind}")
        inside = True
        if last:
            kind = None
    return tuple(tokens), tuple(tags)


def _punctuated(row: Row, rng: np.random.Generator) -> Row:
    """Clause marks behind some words; none inside an entity."""
    tokens, tags = row
    inside = [i + 1 < len(tags) and tags[i + 1][0] == "I" for i in range(len(tags))]
    chance = [0.0 if cut or t[-1] in _MARKS else 0.6 if tag != "O" else 0.12 for t, tag, cut in zip(tokens, tags, inside)]
    marks = rng.choice(list(".,,,;:!?"), len(tokens))
    return tuple(t + m if rng.random() < c else t for t, m, c in zip(tokens, marks, chance)), tags


def table_of(lines: list[str], copies: int, joined: int, seed: int) -> tuple[Row, ...]:
    """Rows with random digits filled in: every sentence ``copies`` times plain
    and as often punctuated, then ``joined`` rows of two or three sentences with
    punctuation, so that several entities meet in one row."""
    rng = np.random.default_rng(seed)
    filled = lambda line: marked_row(re.sub("9", lambda _: str(rng.integers(0, 10)), line))
    rows = []
    for line in lines:
        for _ in range(copies):
            rows += [filled(line), _punctuated(filled(line), rng)]
    links = [(), (), ("and",), ("or",), ("then",)]
    for _ in range(joined):
        tokens, tags = (), ()
        for k, i in enumerate(rng.choice(len(lines), int(rng.integers(2, 4)))):
            part, link = filled(lines[i]), links[rng.integers(0, len(links))] if k else ()
            tokens, tags = tokens + link + part[0], tags + ("O",) * len(link) + part[1]
        rows.append(_punctuated((tokens, tags), rng))
    return tuple(rows)


@lru_cache(maxsize=1)
def labelled_table(copies: int = 3, joined: int = 220, seed: int = 11) -> tuple[Row, ...]:
    """The small labelled table: (tokens, tags)."""
    return table_of(MARKED, copies, joined, seed)


# ------------------------------------------------------------------ the field

@dataclass
class Field:
    """Weights of shape features by tag, and of tag transitions."""
    index: dict[str, int]
    emit: np.ndarray
    move: np.ndarray

    def emissions(self, tokens: list[str]) -> np.ndarray:
        out = np.zeros((len(tokens), len(TAGS)))
        for row, names in zip(out, token_features(tokens)):
            row += self.emit[[self.index[x] for x in names if x in self.index]].sum(0)
        return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _allowed() -> np.ndarray:
    """An I tag follows a B or I tag of its kind only."""
    ok = np.ones((len(TAGS), len(TAGS)), bool)
    for j, tag in enumerate(TAGS):
        if tag[0] == "I":
            ok[:, j] = [x[2:] == tag[2:] for x in TAGS]
    return ok


@lru_cache(maxsize=2)
def train(table: tuple[Row, ...] | None = None, rounds: int = 80, rate: float = 0.25, penalty: float = 0.002) -> Field:
    """Maximum conditional likelihood by full-batch Adam; the gradient is
    observed minus expected counts from forward and backward sums over all
    sequences of the table at once."""
    table = table or labelled_table()
    index: dict[str, int] = {}
    rows = [[[index.setdefault(x, len(index)) for x in names] for names in token_features(list(tokens))] for tokens, _ in table]
    n, longest, k = len(rows), max(len(r) for r in rows), len(TAGS)
    length = np.array([len(r) for r in rows])
    width = len(rows[0][0])
    feats = np.zeros((n, longest, width), np.int64)
    gold = np.zeros((n, longest), np.int64)
    for i, (r, (_, tags)) in enumerate(zip(rows, table)):
        feats[i, :len(r)] = r
        gold[i, :len(r)] = [TAGS.index(t) for t in tags]
    live = np.arange(longest) < length[:, None]
    blocked = np.where(_allowed(), 0.0, -1e4)
    emit, move = np.zeros((len(index), k)), np.zeros((k, k))
    state = [np.zeros_like(emit), np.zeros_like(emit), np.zeros_like(move), np.zeros_like(move)]
    flat, one = feats[live], np.eye(k)
    for step in range(1, rounds + 1):
        e = emit[feats].sum(2)
        m = move + blocked
        first = np.where([t[0] == "I" for t in TAGS], -1e4, 0.0)
        fwd, bwd = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        fwd[:, 0] = e[:, 0] + first
        for t in range(1, longest):
            fwd[:, t] = np.where(live[:, t, None], _lse(fwd[:, t - 1, :, None] + m, 1) + e[:, t], fwd[:, t - 1])
        z = _lse(fwd[:, -1], 1)
        for t in range(longest - 2, -1, -1):
            onward = _lse(m + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
            bwd[:, t] = np.where(live[:, t + 1, None], onward, 0.0)
        node = np.exp(fwd + bwd - z[:, None, None])
        diff = (one[gold] - node)[live]
        g_emit = np.zeros_like(emit)
        for j in range(width):
            np.add.at(g_emit, flat[:, j], diff)
        g_move = np.zeros_like(move)
        for t in range(1, longest):
            on = live[:, t]
            pair = np.exp(fwd[on, t - 1, :, None] + m + (e[on, t] + bwd[on, t])[:, None, :] - z[on, None, None])
            g_move += (one[gold[on, t - 1], :, None] * one[gold[on, t], None, :] - pair).sum(0)
        for w, g, a, b in ((emit, g_emit / n - penalty * emit, 0, 1), (move, g_move / n - penalty * move, 2, 3)):
            state[a] = 0.9 * state[a] + 0.1 * g
            state[b] = 0.99 * state[b] + 0.01 * g * g
            w += rate * (state[a] / (1 - 0.9 ** step)) / (np.sqrt(state[b] / (1 - 0.99 ** step)) + 1e-8)
    return Field(index, emit, move + blocked)


def viterbi(field: Field, scores: list[np.ndarray]) -> list[np.ndarray]:
    """Best tags of many sequences at once, longest first, so that each step
    works on the sequences that are still running."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    length = np.array([len(scores[i]) for i in order])
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(scores)
    if not len(order):
        return out
    first = np.where([t[0] == "I" for t in TAGS], -1e4, 0.0)
    best = np.stack([scores[i][0] for i in order]) + first
    back = []
    for t in range(1, length[0]):
        n = int((length > t).sum())
        total = best[:n, :, None] + field.move
        back.append(total.argmax(1).astype(np.int8))
        best[:n] = total.max(1) + np.stack([scores[order[i]][t] for i in range(n)])
    last = best.argmax(1)
    for row, i in enumerate(order):
        tags = np.empty(length[row], np.int64)
        tags[-1] = last[row]
        for t in range(length[row] - 1, 0, -1):
            tags[t - 1] = back[t - 1][row, tags[t]]
        out[i] = tags
    return out


_WRITTEN = re.compile(r"[\w.%+-]+ *(?:@|\(at\)|\[at\]| at ) *[\w-]+ *(?:(?:\.|\(dot\)|\[dot\]| dot ) *[\w-]+ *)+", re.I)


def _passes(kind: str, text: str) -> bool:
    digits = _NOT_DIGIT.sub("", text)
    if kind == "email":
        return _WRITTEN.fullmatch(text) is not None
    if kind == "ip":
        return re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", text) is not None and ip_ok(text)
    if kind == "card":
        return card_ok(digits)
    if kind == "phone":
        return re.fullmatch(r"[+(]?[0-9][\x20().0-9/-]*[0-9]", text) is not None and 7 <= len(digits) <= 15 and (
            not re.fullmatch(r"[0-9]+|[0-9.]+\.[0-9.]{1,2}|[0-9]{4}-[0-9]{2}-[0-9]{2}", text))
    return re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", text) is not None


#: Most words of a segment that is decoded again.
SEGMENT = 10


def _segments(field: Field, scores: np.ndarray, passes) -> list[tuple[int, int, str]]:
    """(from, to, kind) of the best-scoring sequence of single outside words
    and segments of at most SEGMENT words for which ``passes(kind, from, to)``."""
    n, tag = len(scores), {t: i for i, t in enumerate(TAGS)}
    best: list[dict[int, tuple[float, int, int, str]]] = [{tag["O"]: (0.0, -1, -1, "")}] + [{} for _ in range(n)]

    def offer(at: int, last: int, value: float, back: tuple[int, int, str]) -> None:
        if last not in best[at] or value > best[at][last][0]:
            best[at][last] = (value, *back)

    for i in range(n):
        for before, (value, *_) in list(best[i].items()):
            offer(i + 1, tag["O"], value + field.move[before, tag["O"]] + scores[i, tag["O"]], (i, before, ""))
            for kind in KINDS:
                b, inner = tag["B-" + kind], tag["I-" + kind]
                total, last = value + field.move[before, b] + scores[i, b], b
                for j in range(i + 1, min(n, i + SEGMENT) + 1):
                    if j > i + 1:
                        total += field.move[last, inner] + scores[j - 1, inner]
                        last = inner
                    if passes(kind, i, j):
                        offer(j, last, total, (i, before, kind))
    out, at = [], n
    last = max(best[n], key=lambda x: best[n][x][0])
    while at > 0:
        _, start, before, kind = best[at][last]
        if kind:
            out.append((start, at, kind))
        at, last = start, before
    return out[::-1]


def _worth(text: str) -> bool:
    return _DIGIT.search(text) is not None or "@" in text or " dot " in text or "dot)" in text or "dot]" in text


def field_spans(texts: list[str], field: Field) -> list[list[Span]]:
    """Spans of the field in each text, unchecked against base spans."""
    out: list[list[Span]] = [[] for _ in texts]
    some = [d for d, t in enumerate(texts) if _worth(t)]
    if not some:
        return out
    codes = tb.Codes([texts[d] for d in some])
    words = tb.Words(codes)
    evidence = ((codes.c - np.uint32(48)) < 10) | (codes.c == 64)
    total = np.concatenate([[0], np.cumsum(evidence)])
    near = total[words.end] > total[words.start]
    spelled = tb.Words(tb.Codes(list(DOTS))).hash
    near |= np.isin(words.hash, spelled)
    doc = words.doc()
    wide = near.copy()
    for step in range(1, CONTEXT + 1):
        same = doc[step:] == doc[:-step]
        wide[:-step] |= near[step:] & same
        wide[step:] |= near[:-step] & same
    chosen = np.flatnonzero(wide)
    if not len(chosen):
        return out
    cut = np.flatnonzero((np.diff(chosen) > 1) | (doc[chosen[1:]] != doc[chosen[:-1]])) + 1
    runs = np.split(chosen, cut)
    place, end = words.start - codes.at[doc], words.end - codes.at[doc]
    tokens = [[texts[some[doc[w]]][place[w]:end[w]] for w in run] for run in runs]
    scores = [field.emissions(t) for t in tokens]

    def bounds(d: int, a: int, b: int) -> tuple[int, int]:
        """Without brackets, quotes and marks at the edges."""
        text = texts[d]
        while a < b and text[a] in (_OPEN[:-1] if ")" in text[a:b] else _OPEN):
            a += 1
        while b > a and text[b - 1] in _CLOSE:
            b -= 1
        return a, b

    for run, values, tags in zip(runs, scores, viterbi(field, scores)):
        d = some[doc[run[0]]]

        def span(i: int, j: int) -> tuple[int, int]:
            return bounds(d, int(place[run[i]]), int(end[run[j - 1]]))

        def good(kind: str, i: int, j: int) -> bool:
            a, b = span(i, j)
            # a mark inside ends a clause, and an entity with it
            open_ = all(texts[d][end[run[k]] - 1] not in ",;:!?" for k in range(i, j - 1))
            return b > a and open_ and _passes(kind, texts[d][a:b])

        i = 0
        while i < len(run):
            tag = TAGS[tags[i]]
            j = i + 1
            if tag != "O":
                while j < len(run) and TAGS[tags[j]] == "I-" + tag[2:]:
                    j += 1
                found = [(i, j, tag[2:])] if good(tag[2:], i, j) else [
                    (i + x, i + y, kind) for x, y, kind in
                    _segments(field, values[i:j], lambda kind, x, y, i=i: good(kind, i + x, i + y))]
                out[d] += [(KINDS.index(kind), *span(x, y)) for x, y, kind in found]
            i = j
    return out


def find(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text."""
    out = []
    for text, added in zip(texts, field_spans(texts, field)):
        base = base_spans(text)
        extra = [s for s in added if all(s[2] <= b[1] or s[1] >= b[2] for b in base)]
        out.append((base, sorted(base + extra)))
    return out


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _detect(shared):
    names = ["doc_id", *[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, some in tb.pieces(batch.column(1)):
                found = find(some, shared.value)
                counts = np.array([[sum(s[0] == k for s in base) for k in range(4)] for base, _ in found], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *[pa.array(counts[:, k]) for k in range(4)],
                     pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found]),
                     pa.array([_joined(every) for _, every in found], pa.string()),
                     pa.array([len(every) - len(base) for base, every in found], pa.int64())], names=names)

    return run, ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
                 "spans string, n_added long")


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of base spans, their digest, and all spans of every row."""
    run, schema = _detect(docs.sparkSession.sparkContext.broadcast(train()))
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def span_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, kind, start, end of every span."""
    one = F.explode(F.split("spans", ",")).alias("span")
    parts = F.split("span", ":")
    return detect(docs, key, text).filter("spans != ''").select("doc_id", one).select(
        "doc_id", parts[0].alias("kind"), parts[1].cast("long").alias("start"), parts[2].cast("long").alias("end"))
