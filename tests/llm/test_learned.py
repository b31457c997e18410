"""Language, toxicity, quality ranking and personal data: held-out results,
model identities and plain versions."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsegrad.llm import langid, pii, queries, ranking, toxicity
from sparsegrad.llm.toxicity import KINDS, Lexicon

MID = "/root/testdata/sf0.01"


def out_of_learning(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_language_held_out(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{MID}/documents.parquet").collect()}
    rows = queries.language_id(spark, MID).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == out_of_learning(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    right = sum(r.lang_pred == docs[r.doc_id].lang for r in held)
    assert right >= 0.97 * len(held)


def test_kneser_ney_sums_to_one_and_matches_plain():
    text = "the cat sat on the mat and the dog ate the hat "
    c, of = langid.normalised([text])
    h, place, _ = langid.grams(c, of)
    rows = np.stack([c[place + j].astype(np.int64) for j in range(4)], 1)
    codes, n = np.unique(rows, axis=0, return_counts=True)
    model = langid.Model.of(codes, n)
    alphabet = np.unique(codes[:, -1])
    unseen = (1 / model.floor) - len(alphabet)          # mass kept for a character never seen
    for context in (codes[5, :3], codes[20, :3], np.array([120, 121, 122])):
        columns = [np.full(len(alphabet), x) for x in context] + [alphabet]
        p = np.exp(model.log_prob(columns)).sum()
        other = np.exp(model.log_prob([np.array([x]) for x in context] + [np.array([0x4E2D])]))[0] * unseen
        assert abs(p + other - 1) < 1e-9
    # the highest order by hand
    context = tuple(codes[5, :3])
    seen = {tuple(r): m for r, m in zip(codes.tolist(), n)}
    total = sum(m for r, m in seen.items() if r[:3] == context)
    ones, twos = (n == 1).sum(), (n == 2).sum()
    d = np.clip(ones / (ones + 2 * twos), 0.1, 0.9)
    _, value = model.grams[3]
    hit = np.searchsorted(model.grams[3][0], langid.gram_hash([np.array([x]) for x in codes[5]]))[0]
    assert abs(value[hit] - max(seen[tuple(codes[5])] - d, 0) / total) < 1e-12


def test_language_edges(spark):
    rows = [(i, "the quick brown fox and the lazy dog " * 3, "en") for i in range(40)]
    rows += [(100 + i, "der schnelle braune Fuchs und der faule Hund " * 3, "de") for i in range(40)]
    rows += [(None, "the dog", None), (500, None, "en"), (501, "12 !! 3", "de"), (502, "", None), (503, "hund " * 30000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(langid.learning_rows(docs))
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert (got[0].lang_pred, got[100].lang_pred, got[503].lang_pred, got[None].lang_pred) == ("en", "de", "de", "en")
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (500, 501, 502))
    strange = spark.createDataFrame([(1, "зимний вечер в старом городе " * 5, None)], docs.schema)
    assert langid.identify(strange, model).first().rejected and not got[0].rejected
    assert langid.fit(langid.learning_rows(docs.limit(0))) is None
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}


def test_bounds_come_from_every_learning_text(spark):
    rng = np.random.default_rng(6)
    words = "the quick brown fox and the lazy dog sleep under a tall tree".split()
    rows = [(i, " ".join(words[k] for k in rng.integers(0, len(words), 8)), "en") for i in range(3000)]
    rows += [(5000 + i, f"der Hund {i} schläft", "de") for i in range(30)] + [(6000, "12 !!", "de"), (6001, "4", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(langid.learning_rows(docs))
    assert model.names == ["de", "en", "xx"] and model.bounds[2] == np.inf
    for i, name in enumerate(["de", "en"]):
        entropy, chars = model.entropies([t for d, t, lang in rows if lang == name and not out_of_learning(d)], {})
        assert model.bounds[i] == pytest.approx(np.quantile(entropy[chars > 0, i], 1 - langid.REJECT_SHARE))


def test_joined_model_equals_the_broadcast_one(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rare = [(9000 + i, f"зимний вечер в старом городе {'абвгд'[i % 5]}", "ru") for i in range(2)]
    rare += [(None, "the dog", None), (9100, None, "en"), (9101, "12 !! 3", "xx"), (9102, "зимний город", None)]
    docs = docs.union(spark.createDataFrame(rare, docs.schema))
    rows = langid.learning_rows(docs)

    def found():
        model = langid.fit(rows)
        return model, sorted(map(tuple, langid.identify(docs, model).collect()), key=str)

    small, want = found()
    monkeypatch.setattr(langid, "MODEL_GRAMS", 100)
    large, got = found()
    assert isinstance(large, langid.JoinedIdentifier) and large.names == small.names and "ru" in large.names
    assert np.allclose(large.bounds, small.bounds)
    assert dict((r[0], r[1]) for r in got)[9102] == "ru"
    assert [(a[0], a[1], a[4]) for a in got] == [(a[0], a[1], a[4]) for a in want]
    assert np.allclose([a[2:4] for a in got], [a[2:4] for a in want])


def labels(spark, name):
    return {r.doc_id: r[name] for r in spark.read.parquet(f"{MID}/labels.parquet").collect()}


def test_toxicity_held_out(spark):
    truth = labels(spark, "toxic")
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{MID}/documents.parquet").collect()}
    rows = queries.toxicity_grammar(spark, MID).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    english = [r for r in rows if r.held_out and r.doc_id in truth and docs[r.doc_id] == "en"]
    assert sum(r.predicted == truth[r.doc_id] for r in english) >= 0.97 * len(english)


def kinds_of(text):
    return [KINDS[k] for k in toxicity.matches([text], Lexicon.seed())[3]]


def test_grammar_reads_clauses():
    assert kinds_of("the idiot came") == ["plain"]
    assert kinds_of("you are an idiot") == ["directed"]
    assert kinds_of("that is not an idiot") == ["negated"]
    assert kinds_of("he said the film is trash") == ["reported"]
    assert kinds_of("i will kill you") == ["threat_directed"]
    assert kinds_of("not now. idiot") == ["plain"]            # a new clause starts afresh
    assert kinds_of("to kill time") == ["threat"]
    assert kinds_of("") == [] and toxicity.features([""], Lexicon.seed()).tolist()[0][1:] == [0.0] * 9
    d, start, end, _, _ = toxicity.matches(["ok", "Oh, MORON!"], Lexicon.seed())
    assert (d.tolist(), start.tolist(), end.tolist()) == ([1], [4], [9])


def test_scores_follow_the_clause(spark):
    rows = [(i, "you are an idiot" if i % 4 == 0 else "a good day", int(i % 4 == 0)) for i in range(80)]
    learned = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    for model in (toxicity.Grammar(Lexicon.seed(), toxicity.PRIOR), learned):
        toxic = ["you are an idiot", "i will kill you", "kill the scum", "he is not here. you idiot"]
        clean = ["not an idiot", "he said the film is trash", "to kill time", "i will not kill you", "he said kill them", ""]
        assert all(model.score([t])[0] > 0.5 for t in toxic), model.score(toxic)
        assert all(model.score([t])[0] < 0.5 for t in clean), model.score(clean)
    strongest = lambda t: toxicity.features([t], Lexicon.seed())[0, 1]
    assert [strongest(t) for t in ("kill the scum", "to kill. the scum", "i will kill you scum", "not an idiot")] == [8, 4, 8, 0]


def test_composed_grammar_equals_a_plain_scan():
    rng = np.random.default_rng(2)
    lexicon = Lexicon.seed()
    pool = ["idiot", "kill", "you", "not", "said", "a", "b", "c", "d.", "e"]
    for _ in range(200):
        words = [pool[i] for i in rng.integers(0, len(pool), 25)]
        want, since = [], {}
        classes = {"idiot": 1, "kill": 2, "you": 3, "not": 4, "said": 5}
        for i, w in enumerate(words):
            c = classes.get(w, 0)
            if c in (1, 2):
                active = {k: i - since.get(k, -99) <= n for k, n in toxicity.REACH.items()}
                mode = 3 if active[5] else 2 if active[4] else 1 if active[3] else 0
                rest = []
                for x in words[i:i + 4]:
                    rest.append(x)
                    if x.endswith("."):
                        break
                if mode == 0 and "you" in rest[1:]:
                    mode = 1
                want.append(KINDS[mode + (4 if c == 2 else 0)])
            if c in (3, 4, 5):
                since[c] = i
            if w.endswith("."):
                since = {}
        assert [KINDS[k] for k in toxicity.matches([" ".join(words)], lexicon)[3]] == want


def test_learned_beginnings(spark):
    rows = [(i, f"gut wort snark{'aeiou'[i % 5]}x ende" if i % 4 == 0 else "gut wort sonne ende snap", int(i % 4 == 0)) for i in range(300)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.fit(sample)
    yes, no, empty = model.score(["das snarkung da", "das gut wort", ""])
    assert yes > 0.5 > no and abs(no - empty) < 1e-9
    only = toxicity.fit(sample.filter("label = 0"))
    assert only.score(["gut"])[0] < 0.5
    assert toxicity.fit(sample.limit(0)).score(["you idiot", "hello"]).round(1).tolist()[1] < 0.5


def test_learned_markers_in_every_language(spark):
    plain = {"fr": "la mer est calme ce soir", "de": "das haus steht am wald", "es": "el sol sale por la ventana"}
    marks = {"fr": "zut", "de": "oaf", "es": "ñoño"}           # whole words, two of three letters
    rows, unseen = [], []
    for lang, text in plain.items():
        words = text.split()
        for i in range(80):
            some = words[i % 3:] + words[:i % 5]
            toxic = i % 8 == 0
            rows.append((len(rows), " ".join([*some, marks[lang], words[0]] if toxic else some), int(toxic)))
        unseen += [(f"{words[1]} {marks[lang]} {words[2]}", 1), (f"{words[1]} {words[2]} {words[1]}", 0)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    assert [int(p >= 0.5) for p in model.score([t for t, _ in unseen])] == [y for _, y in unseen]
    # most labels toxic: a mark's share cannot be twice the base
    rows = [(i, "gut snarkig wort" if i % 4 else "gut wort", int(i % 4 > 0)) for i in range(400)]
    most = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    assert set(most.lexicon.prefixes) == {0, 4, 5, 6, 7}
    yes, no = most.score(["snarkig", "gut wort"])
    assert yes > 0.5 > no


def test_quality_held_out(spark):
    truth = labels(spark, "quality")
    rows = queries.quality_ranking(spark, MID).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_bradley_terry_recovers_the_order():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 12))
    y = (x[:, 0] - 2 * x[:, 3] + 0.2 * rng.normal(size=600) > 0).astype(int)
    model = ranking.rank(x, y)
    assert np.corrcoef(model.raw(x), x[:, 0] - 2 * x[:, 3])[0, 1] > 0.95
    assert abs((model.score(x) < ranking.DECISION).sum() - (y == 0).sum()) <= 1
    assert ranking.rank(x, np.ones(600)) is None
    better, worse = x[y == 1][:200], x[y == 0][:200]
    w = ranking.bradley_terry(better, worse)
    loss = lambda v: np.log1p(np.exp(-(better - worse) @ v)).sum() + 0.5 * ranking.PENALTY * v @ v
    assert all(loss(w) <= loss(w + e) for e in 1e-3 * np.eye(12))
    assert ranking.features(["", "a", "a a a a"]).shape == (3, 12)


# -------------------------------------------------------------- personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]


def test_base_spans_equal_the_patterns(spark, sf):
    rng = np.random.default_rng(9)
    pool = list("a1.@+-() 0%9\n") + ["a@b.c", "1.2.3.4", "4111111111111111", "+1 (702) 555-0742", "é", "😀"]
    texts = ["".join(pool[i] for i in rng.integers(0, len(pool), 40)) for _ in range(4000)]
    texts += ["a@b.c@d.e", "x@y..z", "@a.b", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1", "4111 1111 1111 1111", "00255.01.1.1"]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for t in texts:
        assert pii.base_spans(t) == plain_spans(t), t


def test_endless_words_stay_linear():
    for t in ("a" * 2_000_000 + "@", "1" * 2_000_000, "+" + "1 " * 300_000 + "x", "a@" * 200_000, "1." * 500_000):
        pii.base_spans(t)


def test_shape_reads_the_whole_token():
    assert pii.shape("x" * 70 + "-555.1234") == "a-93.94"
    assert pii.shape("7" * 80 + "_" + "y" * 80 + "42,") == "95_a92"
    assert len(pii.shape("a1" * 300_000)) == 900_000


def test_field_learns_its_table_and_adds_spans():
    field = pii.train()
    table = pii.labelled_table()
    found = pii.viterbi(field, [field.emissions(list(tokens)) for tokens, _ in table])
    right = [tuple(pii.TAGS[t] for t in tags) == gold for tags, (_, gold) in zip(found, table)]
    assert np.mean(right) > 0.95
    text = "Ring (702) 555-0742 today, or jane at example dot com; not 2024-05-06, 3.14 or AKIA1234."
    base, every = pii.find([text], field)[0]
    assert base == [] and [(pii.KINDS[k], text[a:b]) for k, a, b in every] == [
        ("email", "jane at example dot com"), ("phone", "(702) 555-0742")]


def test_viterbi_equals_brute_force():
    from itertools import product
    field = pii.train()
    for tokens in (["the", "(702)", "555-0742"], ["card", "4111"], ["x"]):
        e = field.emissions(tokens)
        first = [-1e4 if t[0] == "I" else 0.0 for t in pii.TAGS]
        value = lambda p: first[p[0]] + e[range(len(p)), p].sum() + sum(field.move[a, b] for a, b in zip(p, p[1:]))
        best = max(product(range(len(pii.TAGS)), repeat=len(tokens)), key=value)
        assert tuple(pii.viterbi(field, [e])[0]) == best


def test_personal_data_query(spark, sf):
    import hashlib
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.personal_data(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = plain_spans(docs[r.doc_id])
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in range(4)]
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
    odd = spark.createDataFrame([(None, None, "x"), (1, "", "x"), (1, "mail a@b.cd", "x")], "doc_id long, text string, spans string")
    assert sorted(r.spans for r in pii.detect(odd).collect()) == ["", "", "email:5:11"]
    assert pii.span_rows(odd).collect()[0][:] == (1, "email", 5, 11)


def entity_sentence(rng, count):
    """A sentence of words that the labelled table does not hold, with
    ``count`` entities that the base patterns do not find, and those entities."""
    words = "blue river walks seven under garden light paper stone window music forest early never winter table".split()
    digits = lambda form: "".join(str(rng.integers(0, 10)) if c == "9" else c for c in form)
    forms = [("phone", lambda: digits("(999) 999-9999")), ("phone", lambda: digits("999-999-9999")),
             ("ssn", lambda: digits("999-99-9999")),
             ("email", lambda: f"{rng.choice(words)} at {rng.choice(words)} dot com"),
             ("email", lambda: f"{rng.choice(words)} (at) {rng.choice(words)} dot org")]
    parts, gold = [], []
    for _ in range(count):
        parts += [str(w) for w in rng.choice(words, rng.integers(2, 6))]
        kind, make = forms[rng.integers(0, len(forms))]
        gold.append((kind, make()))
        parts.append(gold[-1][1] + str(rng.choice(["", ",", ".", ";"])))
    return " ".join(parts + [str(w) for w in rng.choice(words, 3)]), gold


def test_field_finds_several_entities_in_new_sentences():
    rng = np.random.default_rng(21)
    made = [entity_sentence(rng, 1 + i % 3) for i in range(200)]
    hit = extra = total = 0
    for (text, gold), (_, every) in zip(made, pii.find([t for t, _ in made], pii.train())):
        found = [(pii.KINDS[k], text[a:b]) for k, a, b in every]
        hit += sum(g in found for g in gold)
        extra += sum(f not in gold for f in found)
        total += len(gold)
    assert hit >= 0.9 * total and extra <= 0.05 * total, (hit, extra, total)
    clean = ["We met at the dot on page 9, at 10.30, and left.", "On 2024-05-06 it cost 19.99, then 20.", "version 2.14.1 of 3 files; 17 in 2020",
             "room 12-B at noon. 100 people, 99% of 512 cases", "", "dot dot dot", "AKIA1234 and 9f86d081884c7d65 are keys"]
    assert all(every == [] for _, every in pii.find(clean, pii.train()))


def entities(tags):
    starts = [i for i, t in enumerate(tags) if t[0] == "B"]
    return {(i, next((j for j in range(i + 1, len(tags)) if tags[j] != "I" + tags[i][1:]), len(tags)), tags[i]) for i in starts}


def test_field_on_held_out_rows():
    """F1 over other digits, marks and joins than those learned from."""
    field, held = pii.train(), pii.table_of(pii.MARKED, 1, 120, 77)
    found = pii.viterbi(field, [field.emissions(list(tokens)) for tokens, _ in held])
    pairs = [(entities([pii.TAGS[t] for t in tags]), entities(gold)) for tags, (_, gold) in zip(found, held)]
    right = sum(len(a & b) for a, b in pairs)
    assert 2 * right / sum(len(a) + len(b) for a, b in pairs) > 0.95


def test_rejected_spans_are_decoded_again():
    """A field that tags everything as one entity still yields the two that pass."""
    field = pii.train()
    text = "(702) 555-0742 jane at example dot com"
    tokens = text.split()
    spans, at = [], 0
    for t in tokens:
        spans.append((at, at + len(t)))
        at += len(t) + 1
    passes = lambda kind, i, j: pii._passes(kind, text[spans[i][0]:spans[j - 1][1]])
    assert pii._segments(field, field.emissions(tokens), passes) == [(0, 2, "phone"), (2, 7, "email")]
    assert pii._segments(field, field.emissions(tokens), lambda *_: False) == []


ODD = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "long word " * 60_000, "x"), (5, "plain words of one text", "x"),
       (5, "plain words of one text", "x"), (None, "plain words of one text", "x"), (6, "### $$$ %%%", "x"), (7, "you are an idiot", "x")]
ODD_SCHEMA = "doc_id long, text string, score string"


@pytest.mark.parametrize("name", ["quality", "toxic"])
def test_scores_of_odd_rows(spark, name):
    """Nulls, empty and very long texts, repeated rows and ids, a clashing
    column, labels without documents, and tables without rows."""
    from sparsegrad.llm import labelled
    module = {"quality": ranking, "toxic": toxicity}[name]
    docs = spark.createDataFrame(ODD + [(i, f"some words number {i} and more of them", "x") for i in range(20, 80)], ODD_SCHEMA)
    given = [(i, i % 2, int(i % 3 == 0)) for i in range(20, 80)] + [(5, 1, 0), (5, 1, 0), (900, 0, 1), (None, 1, 1), (1, None, None), (2, 0, 0)]
    labels = spark.createDataFrame(given, "doc_id long, quality int, toxic int")
    sample = labelled.learning_sample(docs, labels, name)
    assert sample.count() == sample.select("doc_id").distinct().count() and sample.filter("doc_id = 900 OR label IS NULL").count() == 0
    rows = module.score(docs, module.fit(sample)).collect()
    assert len(rows) == docs.count() and all(0.0 <= r.score <= 1.0 for r in rows)
    same = {r.score for r in rows if r.doc_id in (5, None)}
    assert len(same) == 1
    by = {r.doc_id: r.score for r in rows}
    assert by[1] == by[2] == by[3]
    empty = labelled.learning_sample(docs.limit(0), labels, name)
    model = module.fit(empty)
    assert module.score(docs.limit(0), model).count() == 0
    assert all(0.0 <= r.score <= 1.0 for r in module.score(docs, model).collect())


def test_learning_sample_is_cut_by_hash(spark):
    from sparsegrad.llm import labelled
    docs = spark.range(3000).selectExpr("id AS doc_id", "'t' AS text")
    labels = spark.range(3000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    some = labelled.learning_sample(docs, labels, "quality", rows=100)
    every = labelled.learning_sample(docs, labels, "quality", rows=3000)
    first = every.selectExpr("doc_id", "xxhash64(doc_id) AS h").orderBy("h").limit(100)
    assert {r.doc_id for r in some.collect()} == {r.doc_id for r in first.collect()}


def test_fits_learn_from_every_label(spark):
    """No label is left out, whatever their number, and the fit over tasks is
    the plain one."""
    from sparsegrad.llm import fitting, labelled
    docs = spark.range(90_000).selectExpr("id AS doc_id", "'t' AS text")
    given = spark.range(90_000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    kept = [i for i in range(90_000) if not out_of_learning(i)]
    assert len(kept) > 40_000 and labelled.learning_sample(docs, given, "quality").count() == len(kept)

    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        good = i % 3 > 0
        rows.append((i, " ".join(f"w{k}" for k in rng.integers(0, 400 if good else 15, rng.integers(20, 60))) + " #" * (0 if good else i % 4), int(good)))
    sample = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(5)
    x, y = ranking.features([t for _, t, _ in rows]), np.array([b for _, _, b in rows])
    plain, found = ranking.rank(x, y), ranking.fit(sample)
    assert np.allclose(found.mean, plain.mean) and np.allclose(found.scale, plain.scale)
    assert np.corrcoef(found.raw(x), plain.raw(x))[0, 1] > 0.99          # other pairs
    raw = np.sort(found.raw(x))
    bad = int((y == 0).sum())
    assert found.cut == pytest.approx((raw[bad - 1] + raw[bad]) / 2)
    pairs = ranking._differences(sample.select("doc_id", "label").withColumn("x", F.array(F.col("doc_id").cast("double"))),
                                 {0: bad, 1: 300 - bad}, np.ones(1))
    assert pairs.count() == 10 * bad
    given = spark.createDataFrame([([*map(float, a)], float(b)) for a, b in zip(x, y)], "x array<double>, y double").repartition(4)
    assert np.allclose(fitting.fit_rows(given, np.zeros(12), 1.0, 5.0, 50), toxicity.fit_logistic(x, y, np.zeros(12)), atol=1e-6)


def test_order_statistics(spark):
    from sparsegrad.llm import fitting
    rng = np.random.default_rng(8)
    values = {"a": rng.normal(size=501).round(1), "b": np.ones(40), "c": np.array([3.0])}
    rows = spark.createDataFrame([(g, float(v)) for g, some in values.items() for v in some], "grp string, value double")
    got = fitting.quantiles(rows, dict.fromkeys("abc", 0.77))
    assert all(got[g] == pytest.approx(np.quantile(v, 0.77)) for g, v in values.items()) and set(got) == set(values)
