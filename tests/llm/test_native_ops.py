"""Quality ledger, mixing and sharding against plain Python versions."""

import re
import zlib
from collections import Counter, defaultdict

import pytest

from sparsegrad.llm import mixing, quality, queries, sharding

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, target string, shard string"
EDGE = [
    (1, None, None, None, 0, 7, "x", "s"),
    (2, "", "en", "b", 0, 7, "x", "s"),
    (3, "a b c a b c", "en", "a", 11, 7, "x", "s"),
    (4, " ".join(f"w{i}" for i in range(60)), "en", "a", 0, 7, "x", "s"),
    (4, " ".join(f"w{i}" for i in range(60)), "en", "a", 0, 7, "x", "s"),
    (5, "one two three " * 40, "en", None, 0, 7, "x", "s"),
    (None, "\t x\x0b\x0cy\r\n x\n\n x \n", None, "é", 0, 7, "x", "s"),
    (7, "a\x85b c\xa0d # % <e> 😀😀\n" * 3, "en", "b", 0, 7, "x", "s"),
    (8, " ".join(f"v{i % 4000}" for i in range(30000)), "en", "a", 0, 7, "x", "s"),
]


def measures(text):
    t = text or ""
    w = WORDS.findall(t)
    win = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(win)
    hit = {i + j for i, x in enumerate(win) if n[x] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    return (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))


def same_measures(rows, texts):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert got == Counter((i, *measures(t)) for i, t in texts)


def test_ledger_edge_cases(spark):
    led = quality.ledger(spark.createDataFrame(EDGE, SCHEMA))
    same_measures(led.collect(), [(r[0], r[1]) for r in EDGE])
    assert quality.ledger(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ledger_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = queries.quality_rules(spark, sf).collect()
    same_measures(rows, docs)
    for r in rows:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)


def test_policies_and_ablations(spark):
    led = quality.ledger(spark.createDataFrame(EDGE, SCHEMA)).cache()
    bits = [r.fail_bits for r in led.collect()]
    mask = quality.mask_of("web-1")
    assert sum(r.kept for r in quality.apply_policy(led, "web-1").collect()) == sum(b & mask == 0 for b in bits)
    for r in quality.ablations(led, "web-1").collect():
        bit = quality.BITS[r.rule]
        assert r.n_failed == sum(b & bit != 0 for b in bits)
        assert r.n_only == sum(b & mask == bit for b in bits)
        assert r.n_rejected_without == sum(b & mask & ~bit != 0 for b in bits)


def plain_targets(sizes):
    """Share, stop at three times the size, share the excess again."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in fixed]
        rest, w = total - sum(fixed.values()), sum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] / w > 3 * sizes[s]]
        if not over:
            return fixed | {s: rest * weight[s] / w for s in open_}
        fixed |= {s: 3.0 * sizes[s] for s in over}


def check_mix(docs, rows):
    sizes = defaultdict(int)
    for d in docs:
        sizes[d.source] += len(WORDS.findall(d.text or ""))
    want = plain_targets(dict(sizes))
    source = {d.doc_id: d.source for d in docs}
    taken, largest = defaultdict(int), defaultdict(int)
    assert Counter(r.doc_id for r in rows) == Counter(d.doc_id for d in docs)
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * (1 + want[s])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6


def test_mixing_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = queries.source_mixing(spark, sf).collect()
    check_mix(docs, rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.source_mixing(spark, sf).collect()))


def test_mixing_capped_sources_and_edges(spark):
    rows = [(i, "w " * (1 + i % 7), None, "big", 0, 1, "", "") for i in range(400)]
    rows += [(1000 + i, "x y", None, f"s{i % 3}", 0, 1, "", "") for i in range(12)] + [(2000, None, None, None, 0, 1, "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixing.plan(docs).collect()
    check_mix(docs.collect(), out)
    copies = Counter({r.doc_id: r.copies for r in out if r.copies})
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == copies
    assert mixing.plan(spark.createDataFrame([], SCHEMA)).count() == 0


def plain_selection(rows):
    """{doc_id: copies} of one source from (doc_id, size, key) and its target:
    the prefix in key order, then one document of each size class that fits, or
    the document at the edge if that comes closer."""
    docs, target = rows
    total = sum(s for _, s, _ in docs)
    epochs = min(3, int(target // total)) if total else 0
    rest, chosen = target - epochs * total, set()
    behind, edge = [], None
    for i, size, _ in sorted((d for d in docs if d[1] > 0), key=lambda d: d[2]) if rest > 0 else ():
        if edge is None and size <= rest:
            rest -= size
            chosen.add(i)
        elif edge is None:
            edge = (i, size)
            gap = rest
        elif size <= gap:
            behind.append((i, size))
    if edge:
        fill = []
        for band in range(64, 0, -1):
            first = next(((i, s) for i, s in behind if s.bit_length() == band), None)
            if first and first[1] <= rest:
                rest -= first[1]
                fill.append(first[0])
        chosen |= {edge[0]} if edge[1] - gap < rest else set(fill)
    return {i: epochs + (i in chosen) for i, _, _ in docs}


def check_selection(spark, docs):
    from pyspark.sql import functions as F
    keyed = mixing.drawn(docs.select("doc_id", "text", "source", F.monotonically_increasing_id().alias("uid"))).collect()
    rows = {r.doc_id: r for r in mixing.plan(docs).collect()}
    by = defaultdict(list)
    for r in keyed:
        by[r.skey].append((r.doc_id, r.size, r.key))
    for same in by.values():
        want = plain_selection((same, rows[same[0][0]].target))
        assert {i: rows[i].copies for i in want} == want
    return rows


def test_selection_equals_plain_sampling(spark, sf):
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    rows = check_selection(spark, docs)
    source = {d.doc_id: d.source for d in docs.collect()}
    taken, target = Counter(), {}
    for i, r in rows.items():
        taken[source[i]] += r.taken
        target[source[i]] = r.target
    # 50 documents a source: most gaps can be filled to 1%, one source has nothing small enough left
    assert all(abs(taken[s] - t) <= 0.03 * t for s, t in target.items())
    assert sum(abs(taken[s] - t) <= 0.01 * t for s, t in target.items()) >= len(target) - 1


def test_selection_of_junk_heavy_and_one_size_sources(spark):
    rows = [(i, "### $$$ %%% &&& " * (1 + i % 9), None, "junk", 0, 1, "", "") for i in range(500)]
    rows += [(1000 + i, "five words of one size", None, "flat", 0, 1, "", "") for i in range(300)]
    rows += [(2000 + i, "a " * (1 + i % 40), None, "mixed", 0, 1, "", "") for i in range(200)]
    rows += [(3000, "w " * 5000, None, "one", 0, 1, "", ""), (3001, "", None, "none", 0, 1, "", "")]
    check_selection(spark, spark.createDataFrame(rows, SCHEMA).repartition(5))


def test_repeated_rows_meet_the_targets(spark):
    """Rows equal in id and text are taken one by one."""
    rows = [(7, "two words", None, f"s{i % 2}", 0, 1, "", "") for i in range(2000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    out = mixing.plan(docs.withColumn("lang", docs.source).drop("source").withColumnRenamed("lang", "source"))
    got = {r.target: r.t for r in out.groupBy("target").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "t").collect()}
    assert len(got) == 2 and all(abs(t - taken) <= 2 for t, taken in got.items())
    mixed = Counter(r.source for r in mixing.mixed_rows(docs).collect())
    assert sorted(2 * n for n in mixed.values()) == sorted(got.values())
    one = spark.createDataFrame([(1, "a b c", None, "x", 0, 1, "", "")] * 300 + [(2, "a " * 50, None, "y", 0, 1, "", "")] * 40, SCHEMA)
    got = {r.target: r.t for r in mixing.plan(one).groupBy("target").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "t").collect()}
    assert all(abs(t - taken) <= 25 for t, taken in got.items())


def test_exponential_keys_favour_heavy_documents(spark):
    from pyspark.sql import functions as F
    ids = spark.range(20000).select(F.col("id"), F.lit("t").alias("t"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.25).alias("w"))
    first = ids.withColumn("p", mixing.draw_key(F.col("id"), F.col("t"), F.col("w"))).orderBy("p").limit(2000)
    heavy = first.filter("w = 1.0").count()
    assert 0.74 < heavy / 2000 < 0.86      # about 4 to 1 while few are taken


NAMES = ("row text uid words lines bits _words _lines _searched N_WORDS fail_bits key size gap k u band cell part rest done epochs "
         "fill copies skey cut_key tree at").split()


def test_columns_of_any_name_do_not_matter(spark, sf):
    """Columns that bear names used inside are carried or ignored."""
    from pyspark.sql import functions as F

    from sparsegrad.llm import decontaminate, neardup
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    extra = [c for c in NAMES if c not in docs.columns]
    wide = docs.withColumns({c: F.lit(f"x-{c}") for c in extra})
    led = quality.ledger(wide)
    assert sorted(led.columns) == sorted({*wide.columns, *quality.MEASURES, "fail_bits"} - {"N_WORDS"})
    keep = [c for c in docs.columns] + list(quality.MEASURES) + ["fail_bits"]
    plain = quality.ledger(docs).select(*keep).collect()
    assert sorted(map(str, led.select(*keep).collect())) == sorted(map(str, plain))
    assert led.select("words", "lines", "_words").distinct().collect() == [("x-words", "x-lines", "x-_words")]
    marks = spark.read.parquet(f"{sf}/benchmark.parquet")
    for limit in (decontaminate.BROADCAST_SHINGLES, 1):
        clean = decontaminate.clean_rows(wide, marks, limit=limit)
        assert clean.columns == wide.columns and clean.count() == decontaminate.clean_rows(docs, marks).count()
    for same in (mixing.mixed_rows(wide), neardup.Join(wide).kept_rows()):
        assert same.columns == wide.columns and same.select("uid", "row").distinct().collect() == [("x-uid", "x-row")]


def test_sharding_law(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = queries.hash_tree_shards(spark, sf).collect()
    text = {d.doc_id: (d.text or "").encode() for d in docs}
    by = defaultdict(list)
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.size, r.text_crc32, r.law) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id]), "key")
        assert r.grown_shard in (r.shard, 16)
        by[r.shard].append(r.slot)
    assert set(by) <= set(range(16)) and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_sharding_edges_and_weights(spark):
    rows = [(i if i % 5 else None, f"t{i % 9}", None, None, 0, 1, "", "own") for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = sharding.shard_rows(docs, sharding.even_tree(16)).collect()
    assert len({r.shard for r in out if r.doc_id is None}) == 1
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard_rows(spark.createDataFrame([], SCHEMA), sharding.even_tree(16)).count() == 0


def test_weight_change_moves_only_its_subtree(spark):
    from pyspark.sql import functions as F
    from dataclasses import replace
    tree = sharding.even_tree(16)
    region = tree.children[0]
    rack = region.children[0]
    heavier = replace(rack, children=(replace(rack.children[0], weight=2.0), *rack.children[1:]))
    new = replace(tree, children=(replace(region, children=(heavier, *region.children[1:])), *tree.children[1:]))
    ids = spark.range(40000)
    moved = ids.select(sharding.assign(F.col("id"), tree).alias("a"), sharding.assign(F.col("id"), new).alias("b"))
    n = Counter(map(tuple, moved.collect()))
    share = sum(v for (a, b), v in n.items() if b == 0) / 40000
    assert abs(share - 2 / 17) < 0.01
    outside = {x.shard for x in tree.children[1].leaves()}
    assert not any(a != b and a in outside and b in outside for a, b in n)


def plain_draw(doc_id, name):
    """The uniform draw of (id, child) by the public 64-bit hash, chained as
    Spark chains the hashes of two columns (seed 42; a null passes the seed on)."""
    import struct

    import xxhash
    h = 42 if doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42)
    return ((xxhash.xxh64_intdigest(name.encode(), h) >> 11) + 0.5) / (1 << 53)


def plain_shard(doc_id, node):
    """Down the tree: the child with the least -ln(u) / weight, level by level."""
    from math import log
    while node.children:
        live = [c for c in node.children if c.total > 0]
        node = live[0] if len(live) == 1 else min(live, key=lambda c: -log(plain_draw(doc_id, c.name)) / c.total)
    return node.shard


def test_shards_equal_plain_draws(spark, sf):
    tree = sharding.even_tree(16)
    rows = queries.hash_tree_shards(spark, sf).collect()
    assert all(r.shard == plain_shard(r.doc_id, tree) and r.grown_shard == plain_shard(r.doc_id, sharding.grown(tree)) for r in rows)
    leaf = lambda i, w: sharding.Node(f"s{i}", w, shard=i)
    uneven = sharding.Node("root", children=(
        sharding.Node("a", children=(leaf(0, 1.0), leaf(1, 0.0), leaf(2, 3.0))), sharding.Node("b", children=(leaf(3, 2.5),))))
    docs = spark.createDataFrame([(i if i else None, "t", None, None, 0, 1, "", "") for i in range(500)], SCHEMA)
    got = {r.doc_id: r.shard for r in sharding.shard_rows(docs, uneven).collect()}
    assert got == {i: plain_shard(i, uneven) for i in [None, *range(1, 500)]} and 1 not in got.values()
