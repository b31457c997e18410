"""The corpus pipeline: every stage against a plain version of its decision."""

from collections import Counter

import corpus_pipeline
from sparsegrad.llm.common import stored

from .test_native_ops import check_mix, measures
from .test_pairs import brute, brute_leaks

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid long, n_words string, row string, shard int"


def plain_quality(text):
    n, chars, symbols, dup, repeat = measures(text)
    words = (text or "").replace("\t", " ").split()
    lines = [x for x in (text or "").split("\n") if x.strip()]
    return not (n < 50 or 100 * repeat > 50 * n or 100 * symbols > 40 * n or 100 * dup > 60 * len(lines) or chars < 2 * n
                or chars > 25 * n or 100 * len(set(words)) < 8 * min(n, 500))


def step(name, spark, docs, sf):
    out = stored(STAGES[name](spark, docs, sf), "test-stage")
    return out, docs.collect(), out.collect()


def check_stages(spark, docs, sf):
    rows = Counter
    columns = docs.columns
    good, before, after = step("quality rules", spark, docs, sf)
    assert good.columns == columns
    assert rows(after) == rows(r for r in before if plain_quality(r.text))
    single, before, after = step("near duplicates", spark, good, sf)
    assert single.columns == columns and not rows(after) - rows(before)
    group = dict(enumerate(brute([r.text for r in before])[1]))
    kept = Counter(after)
    assert sum(kept.values()) == len(set(group.values()))
    texts = {}
    for i, r in enumerate(before):
        texts.setdefault(r.text, set()).add(group[i])
    assert all(len(g) == 1 for g in texts.values())
    assert Counter(next(iter(texts[r.text])) for r in after) == Counter(set(group.values()))
    clean, before, after = step("benchmark decontamination", spark, single, sf)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaked = {d for d, *_ in brute_leaks([(i, r.text) for i, r in enumerate(before)], items)}
    assert clean.columns == columns and rows(after) == rows(r for i, r in enumerate(before) if i not in leaked)
    mix, before, after = step("mixing", spark, clean, sf)
    assert mix.columns == columns and not set(after) - set(before)
    plan = corpus_pipeline.mixing.plan(clean).collect()
    check_mix(before, plan)
    assert Counter(r.doc_id for r in after) == Counter({r.doc_id: r.copies for r in plan if r.copies})
    _, before, after = step("sharding", spark, mix, sf)
    assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before)
    slots = {}
    for r in after:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return after


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    last = check_stages(spark, docs, sf)
    result = corpus_pipeline.run(spark, sf)
    assert Counter((r.doc_id, r.shard) for r in result.collect()) == Counter((r.doc_id, r.shard) for r in last)


def test_odd_rows_and_clashing_columns(spark, sf):
    body = " ".join(f"word{i} and" for i in range(60))
    other = " ".join(f"term{i} or" for i in range(80))
    rows = [(1, body, "en", "a", 1, 5, "x", "r", 3), (2, body, "en", None, 1, 5, "x", "r", 3),
            (3, body + " more", None, "b", 1, 5, "x", "r", 3), (4, None, None, None, None, None, None, None, None),
            (5, "", "en", "a", 0, 5, "x", "r", 3), (6, other, "en", "b", 1, 5, None, "r", 3),
            (7, other.upper() * 40, "en", "a", 1, 5, "x", "r", 3)]
    check_stages(spark, spark.createDataFrame(rows, SCHEMA).coalesce(1), sf)


def test_empty_table(spark, sf):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0 and (name == "sharding" or out.columns == docs.columns)


def test_entry_works_without_the_subpackage():
    import subprocess
    import sys
    code = ("import sys\n"
            "class Gone:\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name in ('corpus_pipeline', 'sparsegrad.llm') or name.startswith('sparsegrad.llm.'):\n"
            "            raise ModuleNotFoundError(name, name=name)\n"
            "sys.meta_path.insert(0, Gone())\n"
            "import __spark_entry__ as e\n"
            "assert 'pipeline' not in e.queries() and set(e.queries()) == set(e.oracle_sql())\n")
    import os
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
