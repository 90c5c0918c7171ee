"""WARC archives with revisit records, and a globally ordered capture index by an external merge.

Writing: equal payloads are found by digest; the capture with the largest page_id is the response, others revisit it. A
task puts records together to archives of file_bytes at most (or one record), and Spark's text writer makes a file of each.
Reading: each archive is parsed by Content-Length, and its captures, sorted, are a run. Runs are written once, dealt out by
ranges of (url key, timestamp, page_id), so many that a range has merge_bytes or so, and merged in each range by a loser
tree. What a range gets of a run is in order already: it stays as Arrow batches, of which only the rows under a run's cursor are
unpacked. Rows that come out of order begin a run of their own, so nothing is sorted again. A hot url is split by time.

Defined cases: a null html is an empty payload; a null url has the key ""; a null page_id ranks below all others and
captures without page_id whose payload only they have are responses; repeated rows are captures each; pages have no
capture time, so WARC-Date is EPOCH plus page_id seconds, page_id modulo CYCLE (any bigint has a date); columns besides page_id,
url and html are left out, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm._common import durable, shared_dir

EPOCH = 1_704_067_200
#: Over 31 years of seconds.
CYCLE = 1_000_000_000
FILE_BYTES = 32 << 20
MERGE_BYTES = 64 << 20
END = "\r\n\r\n"
CAPTURES = "url_key string, timestamp long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, file string, offset long, length long, run string"
NAMES = [x.split()[0] for x in CAPTURES.split(", ")]


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Host labels from the right, then the path and query."""
    rest = (url or "").partition("://")[2]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = rest[:cut].lower()
    return ",".join(reversed(host.split("."))) + ")" + rest[cut:].partition("#")[0] if host else ""


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        html = batch.column(batch.schema.get_field_index("html"))
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("page_id")), pa.array([digest((x.as_py() or "").encode()) for x in html], pa.string())], ["page_id", "digest"])


def _record(page: int | None, url: str | None, html: str | None, own: str, response: int | None) -> str:
    from datetime import datetime, timezone

    payload = html or ""
    revisit = response is not None and response != page
    when = datetime.fromtimestamp(EPOCH + (page or 0) % CYCLE, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {when}"]
    head += [] if url is None else [f"WARC-Target-URI: {url.encode('unicode_escape').decode()}"]
    head += [f"WARC-Payload-Digest: sha1:{own}", f"WARC-Payload-Length: {len(payload.encode())}"]
    head += [f"WARC-Refers-To: <urn:page:{response}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []
    body = "" if revisit else payload
    return "\r\n".join([*head, f"Content-Length: {len(body.encode())}"]) + END + body


def _archives(file_bytes: int):
    """A row for each archive: its records, without the end of the last one, which the writer adds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[str] = []
        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                record = _record(*(batch.column(c)[i].as_py() for c in ("page_id", "url", "html", "digest", "response")))
                length = len(record.encode()) + len(END)
                if made and size + length > file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([END.join(made)], pa.string())], ["value"])
                    made, size = [], 0
                made.append(record)
                size += length
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([END.join(made)], pa.string())], ["value"])

    return run


def write_archives(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """A folder of WARC files of file_bytes at most (or one record) from (page_id, url, html)."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    digests = own.select("page_id", "html").mapInArrow(_digests, "page_id long, digest string")
    shared = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("response"))
    shared = durable(shared.where("n > 1 AND response IS NOT NULL").select("digest", "response"))
    keyed = own.withColumn("digest", F.lit(None).cast("string")).mapInArrow(_with_digest, "page_id long, url string, html string, digest string")
    keyed.join(shared, "digest", "left").mapInArrow(_archives(file_bytes), "value string").write.option("lineSep", END).option("maxRecordsPerFile", 1).text(path)


def _with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        page, url, html = (batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "html"))
        yield pa.RecordBatch.from_arrays([page, url, html, pa.array([digest((x.as_py() or "").encode()) for x in html], pa.string())], ["page_id", "url", "html", "digest"])


def parse(content: bytes) -> Iterator[tuple[dict[str, str], int, int, bytes]]:
    """(headers, offset, length, block) of each record."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode().split("\r\n")
        head = dict(x.split(": ", 1) for x in lines[1:])
        body = end + 4
        stop = body + int(head["Content-Length"])
        if not lines[0].startswith("WARC/") or content[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"no WARC record at {at}")
        yield head, at, stop + 4 - at, content[body:stop]
        at = stop + 4


def _order(row: tuple) -> tuple:
    return row[0], row[1], -1 if row[2] is None else row[2], row[8], row[9]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from datetime import datetime

    number = lambda x: int(x[10:-1]) if x and x[10:-1] else None
    types = [pa.string() if " string" in c else pa.int64() for c in CAPTURES.split(", ")]
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows = []
            for head, at, length, block in parse(content.as_py()):
                response = head["WARC-Type"] == "response"
                url = head.get("WARC-Target-URI")
                url = None if url is None else url.encode().decode("unicode_escape")
                when = int(datetime.fromisoformat(head["WARC-Date"]).timestamp())
                own = digest(block) if response else head["WARC-Payload-Digest"][5:]
                if f"sha1:{own}" != head["WARC-Payload-Digest"]:
                    raise ValueError(f"damaged record in {name} at {at}")
                rows.append((url_key(url), when, number(head["WARC-Record-ID"]), url, head["WARC-Type"], number(head.get("WARC-Refers-To")), len(block) if response else int(head["WARC-Payload-Length"]), own, name, at, length, name))
            rows.sort(key=_order)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], NAMES)


class Run:
    """A cursor over a sorted run of Arrow batches; a block of rows is unpacked at a time."""

    def __init__(self, batches: list[pa.RecordBatch], block: int = 256):
        self.batches, self.block = batches, block

    def __iter__(self) -> Iterator[tuple]:
        for batch in self.batches:
            for a in range(0, batch.num_rows, self.block):
                yield from zip(*(c.slice(a, self.block).to_pylist() for c in batch.columns))


class LoserTree:
    """Merges sorted runs: an inner node keeps the loser of its match, so a step costs one comparison a level."""

    def __init__(self, runs: list, key=_order):
        self.runs, self.key, self.k = [iter(r) for r in runs], key, max(1, len(runs))
        self.row: list = [None] * len(runs)
        self.head: list = [None] * len(runs)
        self.tree = [-1] * self.k
        for i in range(len(runs)):
            self._next(i)
            self._play(i)

    def _next(self, i: int) -> None:
        self.row[i] = next(self.runs[i], None)
        self.head[i] = None if self.row[i] is None else self.key(self.row[i])

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _play(self, i: int) -> None:
        node, winner = (i + self.k) // 2, i
        while node:
            if self.tree[node] < 0:  # the first to come waits here
                self.tree[node] = winner
                return
            if self._beats(self.tree[node], winner):
                winner, self.tree[node] = self.tree[node], winner
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and self.head[w := self.tree[0]] is not None:
            yield self.row[w]
            self._next(w)
            self._play(w)


def _split_runs(batches: Iterator[pa.RecordBatch]) -> list[list[pa.RecordBatch]]:
    """What came of each run, in order; rows that are less than the one before them in their run begin another one."""
    runs: dict[str, list[pa.RecordBatch]] = {}
    last: dict[str, tuple] = {}
    ended: list[list[pa.RecordBatch]] = []
    for batch in batches:
        names = batch.column("run").to_pylist()
        rows = list(map(_order, zip(*(batch.column(c).to_pylist() for c in NAMES))))
        start = 0
        for i in range(1, batch.num_rows + 1):
            if i < batch.num_rows and names[i] == names[start] and rows[i] >= rows[i - 1]:
                continue
            run = names[start]
            if run in last and rows[start] < last[run]:
                ended.append(runs.pop(run))
            runs.setdefault(run, []).append(batch.slice(start, i - start))
            last[run], start = rows[i - 1], i
    return [*ended, *runs.values()]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs = _split_runs(batches)
    types = [f.type for f in runs[0][0].schema] if runs else []
    block: list[tuple] = []
    for row in LoserTree([Run(r) for r in runs]):
        block.append(row)
        if len(block) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block), types)], NAMES)
            block = []
    if block:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block), types)], NAMES)


def capture_history(spark: SparkSession, path: str, merge_bytes: int = MERGE_BYTES) -> DataFrame:
    """All captures of the archives in path, ordered by url key, timestamp and page_id over all partitions."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    runs = durable(files.mapInArrow(_runs, CAPTURES))
    size = runs.agg(F.sum(200 + F.coalesce(F.octet_length("url"), F.lit(0)) + F.octet_length("url_key") + 2 * F.octet_length("file"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // merge_bytes))
    return runs.repartitionByRange(ranges, "url_key", "timestamp", "page_id").mapInArrow(_merge, CAPTURES)


def op2(pages: DataFrame) -> DataFrame:
    path = shared_dir(pages.sparkSession)
    write_archives(pages, path)
    return capture_history(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
