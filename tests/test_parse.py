"""Parser edge cases on in-line strings (the reference's line grammar)."""

import pytest
from pyspark.sql import functions as F

from sparsegrad.sources import text


def _lines(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def _feats(row):
    return [(f["idx"], f["val"]) for f in row["features"]]


def test_indexed_spaces_order_duplicates(spark):
    rows = text.parse_indexed(_lines(spark, [
        "  7   1   3:0.5   1:2 3:1.5 ",      # leading/repeated spaces, unsorted, duplicate id
        "8 -1 5:6:7 2:1",                    # third ':' part ignored
        "9 1 4:1 # 9:9",                     # stop at the first token without ':'
        "10 1 x 2:3",                        # empty vector, still a row
    ])).orderBy("row_id").collect()
    assert [r["row_id"] for r in rows] == [7, 8, 9, 10]
    assert _feats(rows[0]) == [(3, 0.5), (1, 2.0), (3, 1.5)]
    assert rows[1]["y"] == -1.0 and _feats(rows[1]) == [(5, 6.0), (2, 1.0)]
    assert _feats(rows[2]) == [(4, 1.0)]
    assert _feats(rows[3]) == []


def test_label_only_line_raises(spark):
    with pytest.raises(Exception):
        text.parse_indexed(_lines(spark, ["3 1"])).collect()
    with pytest.raises(Exception):
        text.parse_plain(_lines(spark, ["1"])).collect()


def test_feature_id_below_one_raises(spark):
    with pytest.raises(Exception):
        text.parse_indexed(_lines(spark, ["1 1 0:2.0"])).collect()
    with pytest.raises(Exception):
        text.parse_plain(_lines(spark, ["1 -3:2.0"])).collect()


def test_plain_and_positional(spark):
    r = text.parse_plain(_lines(spark, ["-1 2:0.25 1:4"])).first()
    assert r["y"] == -1.0 and _feats(r) == [(2, 0.25), (1, 4.0)]
    d = text.parse_positional(_lines(spark, ["1 9:1.5 9:2.5 0:3 7:99"]), 3).first()
    assert d["x"] == [1.5, 2.5, 3.0]       # ids ignored, only the first D values
    with pytest.raises(Exception):
        text.parse_positional(_lines(spark, ["1 1:1"]), 3).collect()


def test_dense_last_wins(spark):
    d = text.parse_dense_last_wins(_lines(spark, ["1 2:1 4:2 2:7", "-1 1:3"]), 4).collect()
    xs = sorted(r["x"] for r in d)
    assert [0.0, 7.0, 0.0, 2.0] in xs and [3.0, 0.0, 0.0, 0.0] in xs


def test_text_scan_roundtrip_and_line_ids(spark, scratch):
    path = f"{scratch}/lines"
    src = ["1 1:1", "-1 2:2", "1 3:3 1:1"]
    _lines(spark, src).coalesce(1).write.text(path)
    scanned = text.scan_lines(spark, path)
    with_ids = text.with_line_ids(scanned)
    got = [(r["row_id"], r["value"]) for r in with_ids.orderBy("row_id").collect()]
    assert got == [(1, "1 1:1"), (2, "-1 2:2"), (3, "1 3:3 1:1")]
    parsed = text.parse_plain(with_ids, keep=["row_id"])
    assert parsed.where(F.col("row_id") == 3).first()["features"][1]["idx"] == 1


def test_render_parse_roundtrip(spark):
    rows = spark.createDataFrame([(5, 1.0, [(2, 0.1), (9, 1e-7)])],
                                 "row_id bigint, y double, features array<struct<idx:bigint,val:double>>")
    back = text.parse_indexed(text.render_indexed(rows)).first()
    assert back["row_id"] == 5 and _feats(back) == [(2, 0.1), (9, 1e-7)]


def test_cache_points_storage(spark):
    rows = spark.createDataFrame([(1, 1.0, [(1, 1.0)])],
                                 "row_id bigint, y double, features array<struct<idx:bigint,val:double>>")
    c = text.cache_points(rows)
    assert c.storageLevel.useMemory and c.storageLevel.useDisk
    c.unpersist()


def test_line_ids_follow_file_order_across_files(spark, scratch):
    import os
    path = f"{scratch}/multi"
    os.makedirs(path)
    files = {"part-00.txt": ["-1 7:7", "-1 8:8"],
             "part-10.txt": [f"1 {i}:1" for i in range(1, 301)],
             "part-99.txt": ["1 9:9"]}
    for f, lines in files.items():
        with open(f"{path}/{f}", "w") as fh:
            fh.write("\n".join(lines) + "\n")
    ids = text.with_line_ids(text.scan_lines(spark, path)).orderBy("row_id").collect()
    expected = [v for f in sorted(files) for v in files[f]]
    assert [r["row_id"] for r in ids] == list(range(1, len(expected) + 1))
    assert [r["value"] for r in ids] == expected


def test_line_ids_with_split_files(spark, scratch):
    import os
    path = f"{scratch}/split"
    os.makedirs(path)
    lines = [f"1 {i}:{i}.5" for i in range(1, 2001)]
    with open(f"{path}/part-00.txt", "w") as fh:
        fh.write("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        scanned = text.scan_lines(spark, path)
        assert scanned.rdd.getNumPartitions() > 2
        got = text.with_line_ids(scanned).orderBy("row_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["value"] for r in got] == lines
    assert [r["row_id"] for r in got] == list(range(1, 2001))


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("line", ["1 1 3:abc", "1 zz 3:1", "q 1 3:1", "1 1 x3:1", "1 1 3:"])
def test_text_that_is_no_number_raises(spark, ansi, line):
    old = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(Exception):
            text.parse_indexed(_lines(spark, [line])).collect()
        with pytest.raises(Exception):
            text.parse_plain(_lines(spark, [line.split(" ", 1)[1].replace("1 3:1", "1 3:x")])).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", old)


def test_wide_dense_scatter(spark):
    d = 16428
    lines = _lines(spark, [f"1 {i}:1 {d}:{i} {i}:2" for i in range(1, 1201)]).coalesce(1)
    got = text.parse_dense_last_wins(lines, d).selectExpr("size(x) n", "x[16427] z", "aggregate(x, 0D, (a, b) -> a + b) s").collect()
    assert len(got) == 1200 and all(r["n"] == d for r in got)
    assert sorted(r["z"] for r in got) == [float(i) for i in range(1, 1201)] and all(r["s"] == r["z"] + 2 for r in got)
    with pytest.raises(Exception, match="feature id"):
        text.parse_dense_last_wins(lines, d - 1).collect()


def test_checkpoint_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from sparsegrad.session import ensure_checkpoint_dir
    conf = SimpleNamespace(get=lambda *a: None)
    sc = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=conf))


def test_ordered_lines_spread_over_the_session_partitions(spark, sf, monkeypatch):
    from sparsegrad.plans import catalog
    tasks, write = [], catalog._written_lines
    monkeypatch.setattr(catalog, "_written_lines", lambda s, lines: tasks.append(lines.rdd.getNumPartitions()) or write(s, lines))
    adaptive = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(adaptive)
    spark.conf.set(adaptive, "false")
    try:
        rows = catalog.q_line_ids(spark, sf).orderBy("line").collect()
        catalog.q_parse_plain(spark, sf)
    finally:
        spark.conf.set(adaptive, before)
    assert tasks == [8, 8]                   # shuffle partitions of the test session
    ids = [int(r["value"].split()[1]) for r in rows]
    assert ids == sorted(ids) and len(ids) > 1000


def test_line_ids_scan_the_text_once(spark, scratch):
    """One text scan, ids in file order over several splits, the same ids
    when the result is read again."""
    from sparsegrad.sources import text
    lines = [f"line {i} " + "x" * (i % 40) for i in range(3000)]
    for part in range(3):
        with open(f"{scratch}/part-{part}.txt", "w") as f:
            f.write("\n".join(lines[part * 1000:part * 1000 + 1000]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        ids = text.with_line_ids(text.scan_lines(spark, scratch))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    plan = ids._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan.replace("text/", "").split("Relation", 1)[0].lower() and ".txt" not in plan
    for _ in range(2):
        got = {r["row_id"]: r["value"] for r in ids.collect()}
        assert got == {i + 1: x for i, x in enumerate(lines)}
    assert text.with_line_ids(text.scan_lines(spark, scratch).limit(0)).count() == 0


def test_dense_slices_hold_the_whole_vectors(spark, monkeypatch):
    """Slices that hold a value give the dense vectors; d = 10^6 forms no
    vector of that length, whatever the number of lines."""
    raw = ["1 2:1 4:2 2:7", "-1 1:3 9:0 10:4", "1 x", "-1 5:1 5:0", "1 7:2"]
    monkeypatch.setattr(text, "SCATTER_VALUES", 6)
    lines = spark.createDataFrame([(i, v) for i, v in enumerate(raw)], "line int, value string")
    whole = {r.line: r.x for r in text.parse_dense_last_wins(lines, 10, keep=["line"]).collect()}
    slices = text.parse_dense_last_wins(lines, 10, keep=["line"], slice_values=3).collect()
    built = {i: [0.0] * 10 for i in whole}
    for r in slices:
        assert len(r.x) == min(3, 11 - r.first) and any(r.first <= i < r.first + 3 for i in (1, 2, 4, 5, 7, 9, 10))
        built[r.line][r.first - 1:r.first - 1 + len(r.x)] = r.x
    assert built == whole and len(slices) == 2 + 3 + 1 + 1
    many = spark.range(20_000).selectExpr("id AS line", "concat('1 ', id * 50 + 1, ':2 1:3') AS value")
    got = text.parse_dense_last_wins(many, 1_000_000, keep=["line"], slice_values=32)
    assert got.selectExpr("sum(size(x)) n", "sum(aggregate(x, 0D, (a, b) -> a + b)) s").first() == (2 * 32 * 20_000 - 32, 5 * 20_000 - 2)
    with pytest.raises(Exception, match="outside 1..8"):
        text.parse_dense_last_wins(lines, 8, slice_values=3).collect()
