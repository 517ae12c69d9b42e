"""Web archives (WARC) and their index by external merge.

``write_archives`` turns pages into archives of gzipped WARC records, ``read_archives`` parses them back. Every
archive yields a run of captures sorted by URL key, timestamp and page; ``merge_runs`` deals the runs to key ranges
and merges each range's runs by a loser tree, so that the ranges in order are one globally sorted capture history.
A payload that an earlier capture has is stored as a revisit of it.

An archive is a row of a table (its name and its bytes), because executors share only what Spark writes; ``export``
writes them as files where a local folder is wanted.

Defined cases: null or empty html is an empty payload, which counts as any other; a very long page is a record of its own size; a null url has the key ""; equal pages
are equal records, the smallest page_id responds; a null page_id comes first and never responds for others; an empty
table gives no rows; columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timedelta, timezone
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Uncompressed bytes after which a task closes an archive.
ARCHIVE_BYTES = 16 << 20
#: Smallest payload that is stored once only.
REVISIT_FROM = 0
#: Digests that several pages have, at most, for them to be broadcast.
MOST_SHARED = 500_000
#: Captures of a key range, about: bounds what a merging task holds.
RANGE_ROWS = 20_000
_EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
_SCHEME = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?")


def url_key(url: str | None) -> str:
    """The key that sorts a site's captures together: reversed host, then path and sorted query, in lower case, without www and fragment."""
    rest = _SCHEME.sub("", (url or "").strip().lower()).split("#", 1)[0]
    if not rest:
        return ""
    host, slash, path = rest.partition("/")
    if "?" in host:
        host, _, query = host.partition("?")
        path, slash = f"?{query}", "/"
    name, _, port = host.partition(":")
    name = re.sub(r"^www\d*\.", "", name)
    path, mark, query = path.partition("?")
    port = f":{port}" if port not in ("", "80", "443") else ""
    return ",".join(reversed(name.split("."))) + port + ")/" + path.rstrip("/") + (f"?{'&'.join(sorted(query.split('&')))}" if mark and query else "")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def date_of(page_id: int | None) -> str:
    """The capture time of a page where the table has none: a second a page."""
    return (_EPOCH + timedelta(seconds=(page_id or 0) % (1 << 31))).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, size: int | None = None) -> bytes:
    """A response record, or without its payload a revisit one. The HTTP header tells the full payload's size in both."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if size is None else size}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date_of(page_id)}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def records(archive: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, compressed length, header, block) of each record of an archive of one gzip member a record."""
    at = 0
    while at < len(archive):
        inflate = zlib.decompressobj(31)
        data = inflate.decompress(archive[at:] if len(archive) - at < 1 << 16 else memoryview(archive)[at : at + (1 << 16)])
        taken = min(len(archive) - at, 1 << 16)
        while not inflate.eof and at + taken < len(archive):
            step = min(1 << 20, len(archive) - at - taken)
            data += inflate.decompress(memoryview(archive)[at + taken : at + taken + step])
            taken += step
        if not inflate.eof:
            raise ValueError("the archive ends within a record")
        used = taken - len(inflate.unused_data)
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        yield at, used, fields, rest[: int(fields["Content-Length"])]
        at += used


def _archives(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, serial, held, size, count = TaskContext.get().partitionId(), 0, [], 0, 0

    def closed() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"archive": [f"part-{part:06d}-{serial:05d}.warc.gz"], "n_records": pa.array([count], pa.int64()), "data": pa.array([b"".join(held)], pa.binary())})

    for batch in rows:
        cols = [batch.column(c).to_pylist() for c in ("page_id", "url", "payload_bytes", "digest", "refers_to")]
        for page_id, url, n, digest, refers_to, payload in zip(*cols, common.as_bytes(batch.column("html")), strict=True):
            data = record(page_id, url, payload, base64.b32encode(bytes.fromhex(digest)).decode(), refers_to, n)
            held.append(gzip.compress(data, 6, mtime=0))
            size, count = size + len(data), count + 1
            if size >= ARCHIVE_BYTES:
                yield closed()
                serial, size, count = serial + 1, 0, 0
                held.clear()
    if held:
        yield closed()


def write_archives(pages: DataFrame, path: str, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """The table of archives at path: archive, n_records, data. The first pages of equal payloads are found by their digests before anything is written.

    The pages are read twice, for digests and for records, so that html is shuffled only where the digests that several pages have are more
    than MOST_SHARED; then a digest of many pages is dealt to several tasks.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(payload).alias("digest"), F.length(payload).cast("long").alias("payload_bytes"))
    firsts = own.groupBy("digest", "payload_bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("times")).where(F.col("times") > 1)
    firsts = common.cut(firsts.where(F.col("payload_bytes") >= revisit_from), "shared_payloads")
    if firsts.limit(MOST_SHARED + 1).count() <= MOST_SHARED:
        joined = own.join(F.broadcast(firsts), ["digest", "payload_bytes"], "left")
    else:
        total = firsts.agg(F.sum("times")).first()[0]
        joined = common.spread_join(own, firsts, ["digest", "payload_bytes"], F.col("times") * common.OFTEN > total, "page_id", "left")
    revisits = F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    joined = joined.withColumn("refers_to", revisits).withColumn("html", F.when(F.col("refers_to").isNull(), F.col("html")))  # a revisit's payload is not sent on
    joined.select("page_id", "url", "html", "payload_bytes", "digest", "refers_to").mapInArrow(_archives, "archive string, n_records long, data binary").write.option("compression", "none").parquet(path)
    return pages.sparkSession.read.schema("archive string, n_records long, data binary").parquet(path)


CAPTURE = pa.schema(
    [("url_key", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
    + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
)
CAPTURES = "url_key string, timestamp string, page_id long, archive string, offset long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _page_of(field: str) -> int | None:
    number = field.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def capture(archive: str, offset: int, length: int, fields: dict[str, str], block: bytes) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", head)[1])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or sha1_base32(payload) != digest):
        raise ValueError(f"{archive} at {offset}: the payload does not have its digest")
    page = _page_of(fields["WARC-Record-ID"])
    refers = _page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None
    return url_key(fields["WARC-Target-URI"]), re.sub(r"\D", "", fields["WARC-Date"]), page, archive, offset, length, size, digest, kind, refers


def _order(c: tuple) -> tuple:
    return c[0], c[1], -1 if c[2] is None else c[2], c[3], c[4]


def _runs(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for archive, data in zip(batch.column("archive").to_pylist(), batch.column("data").to_pylist(), strict=True):
            run = sorted((capture(archive, *r) for r in records(data)), key=_order)
            for i in range(0, len(run), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*run[i : i + 10_000], strict=True), CAPTURE, strict=True)], schema=CAPTURE)


def read_archives(archives: DataFrame) -> DataFrame:
    """The captures of all records, a sorted run an archive."""
    return archives.select("archive", "data").mapInArrow(_runs, CAPTURES)


def loser_tree_merge(runs: Iterable[Iterable[Any]], key: Callable[[Any], Any]) -> Iterator[Any]:
    """The items of sorted runs in order; of equal keys the earlier run's first. Each item costs one comparison a level."""
    sources = [iter(r) for r in runs]
    k = len(sources)
    heads: list[tuple[int, Any, int, Any]] = []  # an ended run sorts last

    def pull(i: int) -> tuple:
        for item in sources[i]:
            return 0, key(item), i, item
        return 1, None, i, None

    def before(a: tuple, b: tuple) -> bool:
        return a[0] < b[0] if a[0] != b[0] else a[0] == 1 and a[2] < b[2] or a[0] == 0 and (a[1] < b[1] or not b[1] < a[1] and a[2] < b[2])

    if not k:
        return
    heads = [pull(i) for i in range(k)]
    tree: list[int] = [-1] * k  # the loser of each match; tree[0] is the winner
    for leaf in range(k):
        at, node = leaf, (leaf + k) // 2
        while node and tree[node] != -1:
            if before(heads[tree[node]], heads[at]):
                at, tree[node] = tree[node], at
            node //= 2
        if node:
            tree[node] = at
        else:
            tree[0] = at
    while True:
        best = tree[0]
        ended, _, _, item = heads[best]
        if ended:
            return
        yield item
        heads[best] = pull(best)
        at, node = best, (best + k) // 2
        while node:
            if before(heads[tree[node]], heads[at]):
                at, tree[node] = tree[node], at
            node //= 2
        tree[0] = at


def _merge(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs: dict[str, list[list[tuple]]] = {}
    for batch in rows:
        for c in zip(*(col.to_pylist() for col in batch.columns), strict=True):
            own = runs.setdefault(c[3], [[]])
            if own[-1] and _order(c) < _order(own[-1][-1]):
                own.append([])  # blocks of a run may arrive in any order; each is sorted
            own[-1].append(c)
    out: list[tuple] = []
    for c in loser_tree_merge([r for name in sorted(runs) for r in runs[name]], _order):
        out.append(c)
        if len(out) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), CAPTURE, strict=True)], schema=CAPTURE)
            out.clear()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), CAPTURE, strict=True)], schema=CAPTURE)


def merge_runs(captures: DataFrame, n_records: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures in global order: partition by partition, and within each. A key of any number of captures spans as many ranges as it needs, because timestamp and page divide it."""
    parts = max(1, -(-n_records // range_rows))
    return captures.repartitionByRange(parts, "url_key", "timestamp", "page_id").mapInArrow(_merge, CAPTURES)


def index(archives: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The globally ordered index of a table of archives."""
    total = archives.agg(F.sum("n_records")).first()[0] or 0
    return merge_runs(common.cut(read_archives(archives), "capture_runs"), total, range_rows)


def export(archives: DataFrame, folder: str) -> int:
    """Writes the archives as files into a local folder, one at a time; returns their number."""
    n = 0
    for row in archives.select("archive", "data").toLocalIterator():
        with open(f"{folder}/{row.archive}", "wb") as f:
            f.write(row.data)
        n += 1
    return n


def op10_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), common.new_table(spark, "archives"))
    return index(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "timestamp", "archive", "offset", "length")
