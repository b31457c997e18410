"""The text source as a Structured Streaming source."""

import os

from sparsegrad.streaming.lines import append_points, read_points_stream


def test_stream_parse_and_append(spark, scratch):
    src = os.path.join(scratch, "incoming")
    os.makedirs(src)
    with open(os.path.join(src, "a.txt"), "w") as fh:
        fh.write("1 1 3:0.5 1:2\n2 -1 2:1 x\n")
    stream = read_points_stream(spark, src, indexed=True)
    q = append_points(stream, os.path.join(scratch, "table"), os.path.join(scratch, "chk"))
    q.awaitTermination(120)
    got = spark.read.parquet(os.path.join(scratch, "table")).orderBy("row_id").collect()
    assert [r["row_id"] for r in got] == [1, 2]
    assert [(f["idx"], f["val"]) for f in got[0]["features"]] == [(3, 0.5), (1, 2.0)]
    assert [(f["idx"], f["val"]) for f in got[1]["features"]] == [(2, 1.0)]
