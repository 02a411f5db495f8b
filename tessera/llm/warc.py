"""WARC archives and their index, merged from sorted runs.

Every page becomes a record of a gzip-per-record archive, one archive a task;
reading an archive back gives its captures, which each task sorts to a run; the
runs meet in ranges of (URL key, timestamp, page), where a loser tree merges
them.  The result is the capture history of every URL key, in global order.

Archives lie in the shared folder under names that no other attempt of a task
uses, and only the files that the written manifest names are read, so a lost
executor or a repeated task leaves no trace in the result.

Cases.  A null html is an empty payload; a null url is archived as
`urn:page:<id>`; a null page_id is the smallest and is referred to by nobody
unless all copies lack an id; of repeated rows that hold the largest id of
their payload all are responses; an empty table gives an empty result.  Only
the columns named are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.runtime import shared_dir, table, written

EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
ARCHIVE_BYTES = 64 << 20
#: Captures that one merging task gets, about.
MERGE_ROWS = 200_000


def url_key(url: str) -> str:
    """Sort-friendly form of a URL: host labels reversed, then path and query; scheme, port and www dropped."""
    m = re.match(r"(?i)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^#]*)", url)
    if not m:
        return url.lower()
    host = m[1].lower().removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (m[2].lower() or "/")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def capture_time(page_id: int | None) -> str:
    """The WARC-Date of a page: no table has capture times, so its id counts seconds."""
    return (EPOCH + timedelta(seconds=(page_id or 0) % (10 * 365 * 86400))).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member; a revisit keeps the HTTP head, whose length header is that of the full payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{url}')}>",
        "WARC-Target-URI": re.sub(r"[\r\n]", "", url) if url is not None else f"urn:page:{'' if page_id is None else page_id}",
        "WARC-Date": capture_time(page_id),
        "WARC-Payload-Digest": f"sha1:{sha}",
        "X-Page-ID": "" if page_id is None else str(page_id),
        "Content-Type": "application/http; msgtype=response",
    }
    if revisit:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page": "" if refers_to is None else str(refers_to)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in (fields | {"Content-Length": len(block)}).items())
    return gzip.compress(b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n", 3, mtime=0)


def read_records(stream: io.BufferedIOBase, chunk: int = 1 << 20) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, header fields, block) of each gzip member."""
    offset, data = 0, b""
    while True:
        unzip, parts, used = zlib.decompressobj(31), [], 0
        while not unzip.eof:
            if not data and not (data := stream.read(chunk)):
                if not used:
                    return
                raise ValueError(f"the record at {offset} is cut off")
            used += len(data)
            parts.append(unzip.decompress(data))
            data = b""
        data = unzip.unused_data
        used -= len(data)
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        if version != "WARC/1.1":
            raise ValueError(f"no record at {offset}")
        fields = dict(line.split(": ", 1) for line in lines)
        yield offset, used, fields, rest[: int(fields["Content-Length"])]
        offset += used


class LoserTree:
    """Merges k sorted iterators with one comparison a level: inner nodes keep the loser of their match."""

    def __init__(self, runs: list[Iterator], key: Callable) -> None:
        self.runs, self.key, self.k = runs, key, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and x is not None or x is None and y is None and a < b
        kx, ky = self.key(x), self.key(y)
        return kx < ky or kx == ky and a < b

    def _play(self, i: int) -> None:
        """Run i plays from its leaf up; the loser of each match stays, the winner goes on."""
        node, winner = (i + self.k) // 2, i
        while node > 0:
            if self.tree[node] == -1:  # while building: wait for an opponent
                self.tree[node] = winner
                return
            if self._beats(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        while self.k and (head := self.heads[w := self.tree[0]]) is not None:
            yield head
            self.heads[w] = next(self.runs[w], None)
            self._play(w)


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """pages(page_id, url, html, sha in hex, first) -> the manifest (archive, records, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_folder(folder)
        store.create_dir(root, recursive=True)
        out, name, size, n, done = None, "", 0, 0, []
        for b in batches:
            for page_id, url, html, sha, first in zip(*(b[c].to_pylist() for c in ("page_id", "url", "html", "sha", "first"))):
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                raw = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), base64.b32encode(bytes.fromhex(sha)).decode(), first, first is not None and page_id != first)
                out.write(raw)
                size, n = size + len(raw), n + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((name, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, n, size))
        yield pa.record_batch([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["archive", "records", "bytes"])

    return written(pages.select("page_id", "url", "html", "sha", "first").mapInArrow(run, "archive string, records long, bytes long"), "manifest")


CAPTURE = "url_key string, timestamp string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"
_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
_NAMES = [f.split()[0] for f in CAPTURE.split(", ")]


def order_of(row: tuple) -> tuple:
    """URL key, timestamp, page (none first), place."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8]


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """The captures of every archive, each archive's a sorted run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_folder(folder)
        for b in batches:
            for name in b["archive"].to_pylist():
                rows = []
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for offset, length, fields, block in read_records(stream):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size, sha, kind = int(re.search(rb"Content-Length: (\d+)", head)[1]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                        if kind == "response" and (len(payload) != size or digest(payload) != sha):
                            raise ValueError(f"{name}, {offset}: the payload is not what its digest says")
                        refers = fields.get("X-Refers-To-Page", "")
                        rows.append((url_key(fields["WARC-Target-URI"]), fields["WARC-Date"], int(fields["X-Page-ID"]) if fields["X-Page-ID"] else None, size, sha, kind, int(refers) if refers else None, name, offset, length))
                rows.sort(key=order_of)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)

    files = manifest.select("archive").repartition(max(1, manifest.count()))
    return written(files.mapInArrow(run, CAPTURE), "runs")


def merge_runs(runs: DataFrame, ranges: int) -> DataFrame:
    """Captures in global order: each task takes one key range of all runs and merges them by a loser tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        sorted_runs = [list(g) for _, g in groupby(rows, key=lambda r: r[7])]  # a key range of bounded size
        tree, out = LoserTree([iter(r) for r in sorted_runs], order_of), []
        for row in tree:
            out.append(row)
            if len(out) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], names=_NAMES)
                out = []
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(_TYPES)], names=_NAMES)

    by = ["url_key", "timestamp", "page_id"]
    # one URL may hold most captures: the page is part of the range, so no range is hot
    return runs.repartitionByRange(ranges, *by).sortWithinPartitions("archive", *by, "offset").mapInArrow(run, CAPTURE)


def capture_histories(pages: DataFrame, folder: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archive pages under folder, read the archives back and merge their index."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = rows.withColumn("sha", F.sha1(payload)).withColumn("big", F.octet_length(payload) >= least_bytes)
    copies = written(rows.where("big").groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("first")).where("n > 1").select("sha", "first"), "copies")
    joined = rows.join(copies, "sha", "left").withColumn("first", F.when(F.col("big"), F.col("first")))

    manifest = write_archives(joined, folder)
    runs = read_archives(manifest, folder)
    return merge_runs(runs, max(1, -(-runs.count() // MERGE_ROWS), manifest.count()))


def op9_capture_histories(spark, sf_dir: str) -> DataFrame:
    return capture_histories(table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "timestamp")


OP9_SQL = r"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT *, count(*) OVER (PARTITION BY sha) AS n, max(page_id) OVER (PARTITION BY sha) AS first FROM p),
u AS (SELECT *, lower(regexp_extract(url, '(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^#]*)', 1)) AS host,
        lower(regexp_extract(url, '(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^#]*)', 2)) AS rest FROM f)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
  list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha, 10 * (i // 8) + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT + 1, 1) FOR i IN range(32)], 'string_agg', '') AS payload_digest,
  CASE WHEN n > 1 AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n > 1 AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to,
  CASE WHEN url IS NULL THEN 'urn:page:' || coalesce(page_id::VARCHAR, '')
       WHEN NOT regexp_matches(url, '(?i)^[a-z][a-z0-9+.-]*://') THEN lower(url)
       ELSE list_aggregate(list_reverse(string_split(regexp_replace(host, '^www\.', ''), '.')), 'string_agg', ',') || ')' || CASE WHEN rest = '' THEN '/' ELSE rest END END AS url_key,
  strftime(TIMESTAMP '2024-01-01' + to_seconds(coalesce(page_id, 0) % 315360000), '%Y-%m-%dT%H:%M:%SZ') AS timestamp
FROM u
"""
