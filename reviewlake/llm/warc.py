"""Web archive files, their capture index, and its external merge (operator 4).

Pages are written as WARC/1.1 records by Spark's text writer (records are UTF-8
text that ends in two line ends, so the line separator is the record's end), one
archive file per task, gzipped. Of records with equal payloads one is the
response, that of the largest page id; the others are revisits without payload.

Each archive is read back into a run: its captures sorted by URL key, time and
page id. The runs are merged like sorted files on disk: ranges of the key are dealt
to tasks, and a task merges the slices of all runs that fall in its range with a
loser tree, which needs one comparison per level for each capture. Ranges follow
one another, so the merged table is in global order, however many captures one
URL has.

Defined cases: a null page is an empty payload; a null URL has no target header
and an empty key; line ends in a URL are escaped; a null page id is smaller than
all others; of rows with equal payload and page id one is the response; payloads
under ``min_bytes`` are all responses; an empty table gives no rows; columns other
than the named are not looked at.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from reviewlake.llm.storage import shared_folder, written

END_OF_RECORD = "\r\n\r\n"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORDS_PER_FILE = 20_000
#: 2000-01-01, from which a capture time is made where a table has none.
FIRST_SECOND = 946_684_800

CAPTURE_SCHEMA = "uid long, page_id long, url string, at string, digest string, size long, html string"
RUN_SCHEMA = ("run string, place long, offset long, uid long, page_id long, url_key string, at string, "
              "record_type string, refers_uid long, payload_bytes long, payload_digest string")
MERGED_SCHEMA = RUN_SCHEMA + ", part int, pos long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels from the top level down, then path and query."""
    if not url:
        return ""
    rest = url.split("#", 1)[0]
    rest = rest.split("://", 1)[1] if "://" in rest else rest
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + (rest[cut:] or "/")


def _utc(at: Column) -> Column:
    """A moment in UTC as archives write it, whatever the session's zone."""
    second = F.unix_seconds(at)
    day = F.date_from_unix_date(F.floor(second / 86400).cast("int")).cast("string")
    of_day = F.pmod(second, F.lit(86400))
    clock = F.format_string("T%02d:%02d:%02dZ", F.floor(of_day / 3600), F.floor(of_day / 60) % 60, of_day % 60)
    return F.concat(day, clock)


def captures(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url",
             html_col: str = "html", time_col: str | None = None) -> DataFrame:
    """The pages with a row number, payload size and digest, written."""
    at = F.col(time_col).cast("timestamp") if time_col else F.timestamp_seconds(
        F.lit(FIRST_SECOND) + F.coalesce(F.col(id_col).cast("long"), F.lit(0)))
    rows = pages.select(F.monotonically_increasing_id().alias("uid"),
                        F.col(id_col).cast("long").alias("page_id"),
                        F.regexp_replace(F.regexp_replace(F.col(url_col).cast("string"), "\r", "%0D"),
                                         "\n", "%0A").alias("url"),
                        _utc(at).alias("at"),
                        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payload = batch.column("html").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("uid", "page_id", "url", "at")),
                 pa.array([base32_sha1(p) for p in payload], pa.string()),
                 pa.array([len(p) for p in payload], pa.int64()), batch.column("html")],
                [x.split()[0] for x in CAPTURE_SCHEMA.split(", ")])

    return written(rows.mapInArrow(run, CAPTURE_SCHEMA), "captures")


def write_archives(caps: DataFrame, *, min_bytes: int = 0) -> str:
    """Write captures as archive files in the shared folder; the folder's path."""
    least = F.lit(-(2 ** 63))
    first = (caps.where(F.col("size") >= min_bytes).groupBy("digest")
             .agg(F.max(F.struct(F.coalesce("page_id", least).alias("p"), "uid")).getField("uid").alias("of")))
    rows = caps.join(first, "digest", "left")
    revisit = F.col("of").isNotNull() & (F.col("of") != F.col("uid")) & (F.col("size") >= min_bytes)
    head = F.lit(HTTP_HEAD)
    length = F.when(revisit, F.lit(len(HTTP_HEAD))).otherwise(F.lit(len(HTTP_HEAD)) + F.col("size"))

    def line(name: str, value) -> F.Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:capture:"), F.col("uid"), F.lit(">"))),
        line("WARC-Date", F.col("at")),
        F.coalesce(line("WARC-Target-URI", F.col("url")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"),
            line("WARC-Refers-To", F.concat(F.lit("<urn:capture:"), F.col("of"), F.lit(">")))))
        .otherwise(F.lit("")),
        F.coalesce(line("X-Page-ID", F.col("page_id")), F.lit("")),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        line("Content-Length", length), F.lit("\r\n"), head,
        F.when(revisit, F.lit("")).otherwise(F.col("html")))
    folder = f"{shared_folder(caps.sparkSession)}/warc-{uuid.uuid4().hex}"
    (rows.select(record.alias("value")).write.option("lineSep", END_OF_RECORD)
         .option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder))
    return folder


def records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers and payload of each record of an unpacked archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        start, size = end + 4, int(head["Content-Length"])
        block = data[start:start + size]
        yield at, head, block[block.index(b"\r\n\r\n") + 4:]
        at = start + size + len(END_OF_RECORD)


def _uid(urn: str) -> int:
    return int(urn.removeprefix("<urn:capture:").removesuffix(">"))


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """One sorted run of captures per archive file, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for offset, head, payload in records(gzip.decompress(body.as_buffer())):
                    revisit = head["WARC-Type"] == "revisit"
                    page = head.get("X-Page-ID")
                    rows.append((url_key(head.get("WARC-Target-URI")), head["WARC-Date"],
                                 -(2 ** 63) if page is None else int(page), _uid(head["WARC-Record-ID"]),
                                 offset, head["WARC-Type"], _uid(head["WARC-Refers-To"]) if revisit else None,
                                 None if revisit else len(payload),
                                 head["WARC-Payload-Digest"].removeprefix("sha1:") if revisit
                                 else base32_sha1(payload)))
                if not rows:
                    continue
                rows.sort(key=lambda r: r[:4])
                key, at, page, uid, offset, kind, refers, size, digest = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path.rsplit("/", 1)[1]] * len(rows)), pa.array(range(len(rows)), pa.int64()),
                     pa.array(offset, pa.int64()), pa.array(uid, pa.int64()), pa.array(page, pa.int64()),
                     pa.array(key, pa.string()), pa.array(at, pa.string()), pa.array(kind, pa.string()),
                     pa.array(refers, pa.int64()), pa.array(size, pa.int64()), pa.array(digest, pa.string())],
                    [x.split()[0] for x in RUN_SCHEMA.split(", ")])

    files = (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
             .where("length > 0").select("path", "content"))
    return written(files.mapInArrow(run, RUN_SCHEMA), "runs")


class LoserTree:
    """Merge of k sorted sequences. An inner node holds the loser of its match; the
    next winner is found by replaying the matches on its leaf's path to the root."""

    def __init__(self, runs: list[list]) -> None:
        self.k = max(1, len(runs))
        self.runs = [iter(r) for r in runs] or [iter(())]
        self.head = [next(r, None) for r in self.runs]
        self.loser = [-1] * self.k
        for leaf in range(self.k):
            self._replay(leaf)

    def _before(self, a: int, b: int) -> bool:
        """Whether run a's head comes before run b's; an ended run comes last."""
        x, y = self.head[a], self.head[b]
        return y is None if x is None or y is None else (x, a) < (y, b)

    def _replay(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node:
            other = self.loser[node]
            if other < 0:           # the first to come waits for its match
                self.loser[node] = winner
                return
            if self._before(other, winner):
                self.loser[node], winner = winner, other
            node //= 2
        self.winner = winner

    def __iter__(self) -> Iterator:
        while self.head[self.winner] is not None:
            yield self.head[self.winner]
            self.head[self.winner] = next(self.runs[self.winner], None)
            self._replay(self.winner)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext
    held = list(batches)                # the slices of all runs in this task's range
    if not held:
        return
    rows = pa.Table.from_batches(held).combine_chunks()
    run, place = rows.column("run").to_pylist(), rows.column("place").to_pylist()
    columns = [rows.column(c).to_pylist() for c in ("url_key", "at", "page_id", "uid")]
    slices: dict[str, list[int]] = {}
    for i in sorted(range(len(run)), key=lambda i: (run[i], place[i])):
        slices.setdefault(run[i], []).append(i)
    tree = LoserTree([[(*(c[i] for c in columns), i) for i in own] for own in slices.values()])
    order = np.array([x[-1] for x in tree], np.int64)
    out = rows.take(pa.array(order))
    out = out.append_column("part", pa.array(np.full(len(order), TaskContext.get().partitionId(), np.int32)))
    yield from out.append_column("pos", pa.array(np.arange(len(order)))).to_batches()


def merge_runs(runs: DataFrame) -> DataFrame:
    """All captures with their place in the global order of URL key, time and page id."""
    merged = written(runs.repartitionByRange("url_key", "at", "page_id", "uid")
                     .mapInArrow(_merge, MERGED_SCHEMA), "merged")
    sizes = merged.groupBy("part").agg(F.count("*").alias("n"))      # a row per range
    before = sizes.select("part", F.coalesce(F.sum("n").over(
        W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return (merged.join(F.broadcast(before), "part")
            .withColumn("place_in_index", F.col("before") + F.col("pos")).drop("part", "pos", "before", "place"))


def archive_round_trip(pages: DataFrame, *, min_bytes: int = 0, **columns) -> DataFrame:
    """Write the pages as archives, read them back, merge the index: a row per page."""
    folder = write_archives(captures(pages, **columns), min_bytes=min_bytes)
    index = merge_runs(read_runs(pages.sparkSession, folder))
    null_id = F.lit(-(2 ** 63))
    real = index.withColumn("page_id", F.when(F.col("page_id") != null_id, F.col("page_id")))
    of = real.where("record_type = 'response'").select(
        F.col("uid").alias("refers_uid"), F.col("page_id").alias("refers_to"),
        F.col("payload_bytes").alias("full_bytes"))
    return real.join(of, "refers_uid", "left").select(
        "page_id", F.coalesce("payload_bytes", "full_bytes").alias("payload_bytes"), "payload_digest",
        "record_type", "refers_to", "url_key", F.col("at").alias("captured_at"), "place_in_index",
        F.col("run").alias("archive"), "offset")
