"""WARC archives of pages, and their capture index by external merge.

Pages are written as WARC records through Spark's text writer (a record ends
with two line breaks, which serve as its line separator), then read back,
parsed and verified. A payload of at least ``REVISIT_BYTES`` that equals an
earlier page's becomes a revisit record without a body.

The index: every reading task sorts its captures by URL key, time and page and
stores them as runs; the runs are cut at range bounds of that compound key, so
a URL with a third of all captures is split too; in each range the slices of
all runs are merged by a loser tree. The ranges in order are one globally
ordered capture history.

Defined cases: null html is an empty payload; a null URL has an empty key;
null page ids are carried but never referred to; rows that repeat the smallest
page id of a payload are responses too; pages of any length are written whole;
an empty table gives empty archives and an empty index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_path, small, stored

REVISIT_BYTES = 100
#: Records of one archive file, captures of one sorted run and of one range.
FILE_RECORDS = 1000
#: Bytes above which a payload is long, and bytes of one file of long ones:
#: a file is read whole by one task, so files are bounded by bytes as well.
LONG_BYTES, FILE_BYTES = 256 << 10, 256 << 20
RUN_ROWS = 50_000
RANGE_ROWS = 20_000
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
FIRST_DAY = "2024-01-01"
DAY = 86_400


def capture_time(page_id: Column) -> Column:
    """A repeatable time of capture: one second for each page id, in UTC."""
    second = F.coalesce(F.pmod(page_id, F.lit(365 * DAY)), F.lit(0))
    part = lambda unit, size: F.lpad((F.floor(second / unit) % size).cast("string"), 2, "0")
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), F.floor(second / DAY).cast("int")).cast("string")
    return F.concat(day, F.lit("T"), part(3600, 24), F.lit(":"), part(60, 60), F.lit(":"), part(1, 60), F.lit("Z"))


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest and ``first``: the page to refer to, null
    for responses."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html"), F.lit("")).alias("payload"))
    digest = F.sha2(F.col("payload").cast("binary"), 256)
    long_ = F.octet_length("payload") >= REVISIT_BYTES
    copies = stored(rows.filter(long_).groupBy(digest.alias("digest")).agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "copies")
    keyed = rows.withColumn("digest", digest)
    return keyed.join(small(copies, copies.count()), "digest", "left").withColumn(
        "first", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))


def records(pages: DataFrame) -> DataFrame:
    """value, the record without its end (header, blank line, block), and payload_length."""
    revisit = F.col("first").isNotNull()
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value, F.lit("\r\n"))).otherwise("")
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    body = F.concat(F.lit(HTTP), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        F.when(revisit, F.lit("WARC-Type: revisit\r\n")).otherwise(F.lit("WARC-Type: response\r\n")),
        line("WARC-Record-ID", urn(F.col("page_id"))), line("WARC-Target-URI", url),
        line("WARC-Date", capture_time(F.col("page_id"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("WARC-Payload-Length", F.octet_length("payload").cast("string")),
        line("WARC-Refers-To", F.when(revisit, urn(F.col("first")))),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        line("Content-Length", F.octet_length(body).cast("string")), F.lit("\r\n"))
    return with_revisits(pages).select(F.concat(head, body).alias("value"), F.octet_length("payload").alias("payload_length"))


def write(pages: DataFrame, path: str) -> None:
    """Archive files below ``path``: of at most ``FILE_RECORDS`` records with
    payloads that are not long, and of as many long ones as ``FILE_BYTES``
    allow for the longest (at least one)."""
    made, size = records(pages), F.col("payload_length")
    longest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    parts = [("records", size <= LONG_BYTES, FILE_RECORDS)]
    if longest > LONG_BYTES:
        parts.append(("long", size > LONG_BYTES, max(1, FILE_BYTES // longest)))
    for name, some, count in parts:
        (made.filter(some).select("value").write.option("lineSep", END).option("maxRecordsPerFile", count)
         .option("compression", "none").text(f"{path}/{name}"))


def url_key(url: str | None) -> str:
    """Sort key: host labels reversed, then path and query; no scheme,
    fragment, ``www.`` or default port."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url
    if not host:
        return url
    tail = parts.path or "/"
    tail += f"?{parts.query}" if parts.query else ""
    extra = f":{port}" if port not in (None, 80, 443) else ""
    return ",".join(reversed(host.split("."))) + extra + ")" + tail


def _number(urn: str | None) -> int | None:
    return int(urn.removeprefix("<urn:page:").removesuffix(">")) if urn else None


def parse(content: bytes) -> Iterator[dict]:
    """Captures of one archive; raises if a record is cut or damaged."""
    at = 0
    while at < len(content):
        stop = content.index(b"\r\n\r\n", at)
        first, *lines = content[at:stop].decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError(f"no record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines)
        begin, size = stop + 4, int(head["Content-Length"])
        block = content[begin:begin + size]
        payload = block[block.index(b"\r\n\r\n") + 4:]
        end = begin + size + 4
        digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
        kind = head["WARC-Type"]
        if len(block) != size or content[begin + size:end] != b"\r\n\r\n" or (
                kind == "response" and hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"damaged record at byte {at}")
        yield {"page_id": _number(head.get("WARC-Record-ID")), "payload_bytes": int(head["WARC-Payload-Length"]),
               "payload_digest": digest, "record_type": kind, "refers_to": _number(head.get("WARC-Refers-To")),
               "url": head.get("WARC-Target-URI"), "capture_time": head["WARC-Date"], "offset": at, "length": end - at}
        at = end


RUNS = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
        "url_key string, capture_time string, file string, offset long, length long, run string, run_row long")
KEY = ("url_key", "capture_time", "page_id")


def _sort_key(row: dict) -> tuple:
    return row["url_key"], row["capture_time"], row["page_id"] is not None, row["page_id"] or 0


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, content -> captures in locally sorted runs."""
    task, number, rows = TaskContext.get().partitionId(), 0, []

    def run():
        rows.sort(key=_sort_key)
        for i, row in enumerate(rows):
            row |= {"run": f"{task}-{number}", "run_row": i}
        return pa.RecordBatch.from_pylist(rows, schema=_arrow(RUNS))

    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            name = path.as_py().rsplit("/", 1)[-1]
            for row in parse(content.as_py()):
                rows.append(row | {"url_key": url_key(row.pop("url")), "file": name})
                if len(rows) >= RUN_ROWS:
                    yield run()
                    number, rows = number + 1, []
    if rows:
        yield run()


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Every capture of the archives below ``path``, in stored sorted runs."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter("length > 0")
    return stored(files.select("path", "content").mapInArrow(_runs, RUNS), "runs")


class LoserTree:
    """Merges sorted sequences: inner nodes keep the loser of their match, so
    the next smallest item costs one path from its leaf to the root."""

    def __init__(self, runs: list[Iterator], key=lambda x: x):
        self.key, self.runs = key, runs
        self.k = len(runs)
        self.heads: list = [next(r, None) for r in runs]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.losers = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._play(leaf)

    def _beats(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and (self.keys[a] is not None or a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def _play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            rival = self.losers[node]
            if rival < 0:                      # the other side has not played yet
                self.losers[node] = winner
                return
            if self._beats(rival, winner):
                self.losers[node], winner = winner, rival
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator:
        while self.k and self.heads[self.losers[0]] is not None:
            run = self.losers[0]
            yield self.heads[run]
            self.heads[run] = next(self.runs[run], None)
            self.keys[run] = None if self.heads[run] is None else self.key(self.heads[run])
            self._play(run)


MERGED = RUNS.replace("run string, run_row long", "range_no long, range_row long")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one key range, by run and row -> the range in key order."""
    slices: list[list[dict]] = []
    last = None
    for batch in batches:
        for row in batch.to_pylist():
            if row["run"] != last:
                slices.append([])
                last = row["run"]
            slices[-1].append(row)
    number, out, schema = TaskContext.get().partitionId(), [], _arrow(MERGED)
    for i, row in enumerate(LoserTree([iter(s) for s in slices], _sort_key)):
        out.append({k: row[k] for k in schema.names[:-2]} | {"range_no": number, "range_row": i})
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def merged_index(runs: DataFrame) -> DataFrame:
    """All captures with ``position``, their place in the global order by URL
    key, capture time and page."""
    ranges = max(1, int(np.ceil(runs.count() / RANGE_ROWS)))
    cut = runs.repartitionByRange(ranges, *KEY).sortWithinPartitions("run", "run_row")
    merged = stored(cut.mapInArrow(_merge, MERGED), "captures")
    # one row for each range
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    sizes = merged.groupBy("range_no").agg(F.count(F.lit(1)).alias("n")).select(
        "range_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from"))
    return merged.join(F.broadcast(sizes), "range_no").withColumn(
        "position", F.col("from") + F.col("range_row")).drop("from", "range_no", "range_row")


def archive(pages: DataFrame) -> DataFrame:
    """Write the pages, read the archives back, and return the merged index."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages, path)
    return merged_index(read_runs(spark, path))
