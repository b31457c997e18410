"""Merkle manifest against a plain version: trees as lists of levels."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from sparsegrad.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, at long, h string"


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    code = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H("".join(map(code, (*row[:4], text))))


def tree_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i:i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def plain(rows):
    """Sorted (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)."""
    lower = lambda t: t if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append((r[0] is not None, r[0] or 0, leaf_of(r, r[4]), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree_of([leaf for _, _, leaf, _ in sorted(by[x], key=lambda y: y[:3])]) for x in langs}
    top = tree_of([trees[x][-1][0] for x in langs]) if langs else []
    out = []
    for rank, x in enumerate(langs):
        for pos, (_, _, leaf, r) in enumerate(sorted(by[x], key=lambda y: y[:3])):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            end, proof = leaf_of(r, lower(r[4])) if bad else leaf, ""
            for levels, i in ((trees[x], pos), (top, rank)):
                for level in levels[:-1]:
                    a = i // 8 * 8
                    left, right = "".join(level[a:i]), "".join(level[i + 1:a + 8])
                    proof, end, i = proof + left + right, H(left + end + right), i // 8
            root = top[-1][0]
            out.append((r[0], leaf, trees[x][-1][0], root, H(proof), end, end == root))
    return sorted(out, key=str)


def made(n, seed, langs=("de", "en", None, "zz", "ä")):
    rng = np.random.default_rng(seed)
    return [(int(i), "s", langs[int(rng.integers(0, len(langs)))], int(rng.integers(0, 99)),
             "".join(rng.choice(list("aB cé"), 8)), "x", 7, "y") for i in rng.permutation(n)]


def check(spark, rows):
    got = merkle.Manifest(spark.createDataFrame(rows, SCHEMA)).proofs().collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


def test_proofs_equal_plain_trees(spark):
    check(spark, made(1500, 1))


def test_more_than_one_round_and_run(spark):
    check(spark, made(9000, 2, langs=("en", "en", "en", "fr")))


def test_nulls_ties_repeats_long_texts_and_clashing_names(spark):
    rows = [(None, None, None, None, None, None, None, None), (None, "s", None, 1, "", "x", 1, "y"),
            (3, "s", "en", 1, "AB", "x", 1, "y"), (3, "s", "en", 1, "AB", "x", 1, "y"), (3, "t", "en", 1, "ab", "x", 1, "y"),
            (4, "s", "", 2, "Zé" * 300_000, "x", 1, "y"), (-6, "-", "en", -1, "-", "x", 1, "y")]
    check(spark, rows + [(5, "s", "en", 1, "Q", "x", 1, "y")] * 20)
    check(spark, rows[:1])


def test_many_small_trees(spark):
    check(spark, [(i, "s", f"l{i % 150:03d}", i, "T", "x", 1, "y") for i in range(600)])


def test_empty_table(spark):
    made = merkle.Manifest(spark.createDataFrame([], SCHEMA))
    assert made.root is None and made.proofs().collect() == []


def test_missing_is_the_least_set():
    rng = np.random.default_rng(3)
    for size in (1, 2, 8, 9, 70, 600):
        levels = tree_of([H(str(i)) for i in range(size)])
        for _ in range(20):
            have = sorted(map(int, rng.choice(size, int(rng.integers(1, min(size, 12) + 1)), replace=False)))
            above = [{i // 8 ** k for i in have} for k in range(len(levels))]
            need = {(k, j) for k in range(len(levels) - 1) for i in have
                    for j in range(i // 8 ** k // 8 * 8, min(i // 8 ** k // 8 * 8 + 8, len(levels[k])))}
            want = {(k, j) for k, j in need if j not in above[k]}
            found = merkle.missing(have, size)
            assert len(found) == len(set(found)) and set(found) == want
            root, path = merkle.derive({i: levels[0][i] for i in have}, size, {(k, j): levels[k][j] for k, j in found})
            assert root == levels[-1][0] and all(merkle.folded(levels[0][i], path(i)) == root for i in have)


def test_some_proofs_fetch_less(spark):
    rows = made(3000, 4, langs=("en", "de"))
    found = merkle.Manifest(spark.createDataFrame(rows, SCHEMA))
    want = {r[0]: r for r in plain(rows)}
    some = found.proofs(F.col("doc_id") % 500 == 7).collect()
    assert len(some) == 6 and all(tuple(r) == want[r.doc_id] for r in some)
    runs = found.leaves.withColumn("run", F.shiftright("at", merkle.RUN_BITS))
    asked = found.requests(runs)
    assert asked.count() == asked.distinct().count() < 30 * runs.select("run").distinct().count()
