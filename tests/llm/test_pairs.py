"""Jaccard join and decontamination against brute force."""

import re
from collections import defaultdict
from itertools import combinations

import numpy as np

from sparsegrad.llm import components, decontaminate, neardup, queries, textbatch as tb

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, uid string, h long, size string"


def shingle_set(text, k=5):
    w = WORDS.findall(text or "")
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(texts, threshold=0.8):
    """links[i] = other rows at or above the threshold; group = smallest row."""
    sets = [shingle_set(t) for t in texts]
    links, root = defaultdict(set), list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    at = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            at[x].add(i)
    for i, s in enumerate(sets):
        for j in set().union(*(at[x] for x in s)) if s else ():
            if j > i and len(s & sets[j]) / len(s | sets[j]) >= threshold:
                links[i].add(j)
                links[j].add(i)
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [len(links[i]) for i in range(len(texts))], [find(i) for i in range(len(texts))]


def check(spark, texts):
    docs = spark.createDataFrame([(i, t, "u", 1, "s") for i, t in enumerate(texts)], SCHEMA)
    rows = sorted(neardup.linked_documents(docs).collect())
    links, group = brute(texts)
    assert [r.doc_id for r in rows] == list(range(len(texts)))
    assert [r.n_links for r in rows] == links
    assert [r.group_id for r in rows] == group
    join = neardup.Join(docs, block=4)
    got = {r.uid: r.n_links for r in join.documents().collect()}
    ids = {r.uid: r.doc_id for r in join.rows.select("uid", "row.doc_id").collect()}
    assert {ids[u]: n for u, n in got.items()} == dict(enumerate(links))      # many small blocks, same links
    kept = join.kept_rows()
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(group))


def variants(rng, words, n, edits):
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(edits):
            w[rng.integers(0, len(w))] = f"e{rng.integers(0, 10 ** 9)}"
        out.append(" ".join(w))
    return out


def test_join_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [f"w{rng.integers(0, 500)}" for _ in range(150)]
    texts = variants(rng, base, 14, 1) + variants(rng, base, 8, 3) + [" ".join(base)] * 3
    texts += [" ".join(f"w{rng.integers(0, 500)}" for _ in range(n)) for n in (3, 4, 5, 6, 50, 400)]
    texts += [None, "", " \n", "one two", "one  two", "one two three four five", "one two three four five",
              "a " * 40, "a " * 60, "x" * 50_000, " ".join(f"q{i}" for i in range(30_000))]
    check(spark, texts)


def test_join_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    links, group = brute([d.text for d in docs])
    rows = {r.doc_id: r for r in queries.jaccard_join(spark, sf).collect()}
    assert [rows[d.doc_id].n_links for d in docs] == links
    assert [rows[d.doc_id].group_id for d in docs] == [docs[g].doc_id for g in group]


def test_join_null_ids_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d e f", "u", 1, "s"), (None, "a b c d e f", "u", 1, "s"),
                                  (7, "a b c d e f", "u", 1, "s")], SCHEMA)
    assert [(r.class_id, r.n_links) for r in neardup.linked_documents(docs).collect()] == [(7, 2)] * 3
    assert neardup.linked_documents(docs.limit(0)).count() == 0
    assert neardup.Join(docs).kept_rows().count() == 1


def test_bands_reach_the_recall():
    bands, rows = neardup.bands_for()
    assert 1 - (1 - neardup.THRESHOLD ** rows) ** bands >= neardup.RECALL
    assert 1 - (1 - neardup.THRESHOLD ** rows) ** (bands - 1) < neardup.RECALL


def test_signature_agreement_estimates_jaccard():
    a = tb.mix(np.arange(1000, dtype=tb.U64))
    b = tb.mix(np.arange(100, 1100, dtype=tb.U64))
    sets, first = np.concatenate([np.sort(a), np.sort(b)]), np.array([0, 1000, 2000])
    sig = neardup.signatures(sets, first, 600, 1)
    assert abs((sig[0] == sig[1]).mean() - 900 / 1100) < 0.06


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (10, 11), (11, 12), (12, 13), (13, 14), (14, 3)] + [(100, i) for i in range(101, 160)]
    rows = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    want = {i: 1 for i in (1, 2, 3, 10, 11, 12, 13, 14)} | {4: 4, 5: 4} | {i: 100 for i in range(100, 160)}
    assert sorted((r.node, r.label) for r in rows) == sorted(want.items())
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_words_and_shingles():
    texts = ["", "a b\tc\n d\x0be f", "x" * 300 + " y", " one ", "é😀 ß\xa0z\x85 q r s t"]
    words = tb.Words(tb.Codes(texts))
    assert words.count.tolist() == [len(WORDS.findall(t)) for t in texts]
    flat, first = tb.shingles(words)
    assert np.diff(first).tolist() == [len(shingle_set(t)) for t in texts]
    again, _ = tb.shingles(tb.Words(tb.Codes(["zz", "a b c d e f"])))
    assert again[1:].tolist() == flat[first[1]:first[2]].tolist()      # the place in a batch does not matter


# ------------------------------------------------------------ decontamination

def normal(text):
    w = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split(" ")
    w = [x for x in w if x]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute_leaks(docs, items, threshold=0.8):
    own = [(i, normal(t)) for i, t in items]
    out = []
    for d, t in docs:
        s = normal(t)
        out += [(d, i, len(s & q), len(q)) for i, q in own if q and len(s & q) >= threshold * len(q)]
    return sorted(out, key=str)


def leaks(df):
    return sorted(((r.doc_id, r.item_id, r.n_shared, r.item_shingles) for r in df.collect()), key=str)


def fixture(spark):
    rng = np.random.default_rng(3)
    word = lambda: f"w{rng.integers(0, 3000)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([5, 6, 9, 20, 40, 60, 150, 400, 4, 0])]
    items += [(20, None), (3, items[3][1]), (None, items[4][1])]
    filler = lambda n: " ".join(word() for _ in range(n))
    docs = [(0, filler(9000) + " " + items[3][1].upper() + ". " + filler(9000)), (1, filler(300)), (2, None), (3, ""),
            (None, items[5][1]), (5, items[6][1][:len(items[6][1]) * 9 // 10]), (6, items[7][1][:len(items[7][1]) // 2]),
            (7, items[0][1]), (7, items[0][1]), (8, "(" + items[4][1].replace(" ", ", ") + ")")]
    broken = items[7][1].split()
    for i in range(20, 400, 45):
        broken[i] = "changed"
    docs.append((9, " ".join(broken)))
    return (spark.createDataFrame([(d, t, "u", 1, "s") for d, t in docs], SCHEMA), docs,
            spark.createDataFrame(items, "item_id long, text string"), items)


def test_leaks_both_paths_match_brute_force(spark):
    docs, doc_rows, items, item_rows = fixture(spark)
    want = brute_leaks(doc_rows, item_rows)
    assert len(want) >= 7
    assert leaks(decontaminate.contaminated(docs, items)) == want
    assert leaks(decontaminate.contaminated(docs, items, limit=0)) == want
    clean = [d for d in doc_rows if not any(d[0] == w[0] for w in want)]
    for limit in (decontaminate.BROADCAST_SHINGLES, 0):
        rows = decontaminate.clean_rows(docs, items, limit=limit)
        assert rows.columns == docs.columns
        assert sorted((r.doc_id, r.text) for r in rows.collect() if r.doc_id is not None) == sorted(
            ((d, t) for d, t in clean if d is not None))
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0


def test_leaks_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert leaks(queries.benchmark_leaks(spark, sf)) == brute_leaks(docs, items)


def test_sketches_lose_nothing():
    for n in range(1, 300):
        k = decontaminate.sketch_size(n, 0.8)
        assert k <= n and k > n - np.ceil(0.8 * n - 1e-9) or k == n
