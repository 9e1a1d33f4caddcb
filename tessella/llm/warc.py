"""WARC archives of pages, their capture index, and the merge of its sorted runs into capture histories."""

from __future__ import annotations

import base64
import hashlib
import os
import pickle
import re
import tempfile
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from typing import BinaryIO
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, parked, salted_join, sliced, utf8

#: Rows of a range of the merged index, which is what one task lays out on disk; repeated payloads that are broadcast at most.
RANGE_ROWS, BROADCAST_ROWS = 200_000, 400_000
EPOCH = datetime(2020, 1, 1, tzinfo=UTC)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Sort-friendly form of a URL: host labels reversed, then the path; scheme, "www.", default ports and fragment go."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return (url or "").lower()
    host = re.sub(r"^www\d*\.", "", host)
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + (parts.path.lower() or "/")
    return key + ("?" + "&".join(sorted(parts.query.lower().split("&"))) if parts.query else "")


def _stamp(page_id: object) -> str:
    """The capture time: so many seconds after the start of 2020 as the page's id says."""
    return (EPOCH + timedelta(seconds=int(page_id or 0) % 3_000_000_000)).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id: object, url: str | None, payload: bytes, sha1: str, refers_to: object) -> bytes:
    """One compressed WARC record; a revisit has the HTTP head only, whose Content-Length is the full payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Target-URI: " + re.sub(r"[\r\n]", "", url or ""),
        f"WARC-Date: {_stamp(page_id)}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + z.flush()


def members(segment: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of the records of a segment."""
    view, at = memoryview(segment), 0
    while at < len(view):
        z, out, p = zlib.decompressobj(31), [], at
        while not z.eof:
            part = view[p : p + 65_536]
            if not len(part):
                raise ValueError("a record is cut off")
            out.append(z.decompress(part))
            p += len(part)
        end = p - len(z.unused_data)
        yield at, end - at, b"".join(out)
        at = end


def parsed(content: bytes) -> dict:
    """What a record says; a response's length and digest are taken from its payload and held against its head."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    n = int(re.search(rb"Content-Length: (\d+)", http)[1])
    sha1 = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != n or digest(payload) != sha1):
        raise ValueError("a payload differs from its record's head")
    name = lambda x: None if x is None or x == "<urn:page:>" else int(x[10:-1])
    return {
        "page_id": name(fields["WARC-Record-ID"]), "url_key": url_key(fields["WARC-Target-URI"]), "captured_at": fields["WARC-Date"], "payload_bytes": n,
        "payload_digest": sha1, "record_type": fields["WARC-Type"], "refers_to": name(fields.get("WARC-Refers-To")),
    }


def archive(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write a record per row of (page_id, url, html) and return the archives: (segment, archive), read from the shared folder.

    Null html is an empty payload, a null url an empty one; ids are integers. Of rows with equal payloads of
    ``least_bytes`` or more, the smallest page_id is a response and the others revisit it, rows without an id too; rows
    of that page_id are all responses, and payloads of rows without ids alone are, too. A row goes by its own payload,
    whatever other rows of its page_id hold. Only payloads that occur twice are joined back, by their digest: broadcast
    up to BROADCAST_ROWS of them, else in salted shuffles.
    """
    payload = F.coalesce("html", F.lit(""))
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("html"), F.unhex(F.sha2(payload, 256)).alias("same"))
    seen = pages.where(F.octet_length("html") >= least_bytes).groupBy("same")
    first = seen.agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1 and refers_to is not null")
    first = parked(first.select("same", "refers_to"), "copies")
    if first.count() <= BROADCAST_ROWS:
        ready = pages.join(F.broadcast(first), "same", "left")
    else:
        ready = salted_join(pages, first, "same", by="page_id", how="left")
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("refers_to"))
    ready = ready.withColumn("refers_to", F.when(other, F.col("refers_to")))

    def write(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), utf8(batch.column("html")), batch.column("refers_to").to_pylist(), strict=True)
        return pa.RecordBatch.from_arrays([pa.array([b"".join(record(i, u, h, digest(h), r) for i, u, h, r in rows)], pa.binary())], ["archive"])

    return parked(by_batch(ready.select("page_id", "url", "html", "refers_to"), write, "archive binary").select(F.monotonically_increasing_id().alias("segment"), "archive"), "warc")


#: A capture; ``place`` numbers those of a segment, which are a sorted run.
FIELDS = "url_key string, captured_at string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, segment bigint, offset bigint, length bigint, place bigint"


def _order(row: dict) -> tuple:
    return row["url_key"], row["captured_at"], row["page_id"] is not None, row["page_id"] or 0, row["segment"], row["offset"]


def captures(archives: DataFrame) -> DataFrame:
    """Read the archives: a row per record; those of a segment are a run that is sorted by URL key and time."""
    schema = pa.schema([(f.split()[0], {"string": pa.string(), "bigint": pa.int64()}[f.split()[1]]) for f in FIELDS.split(", ")])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for segment, content in zip(batch.column("segment").to_pylist(), batch.column("archive").to_pylist(), strict=True):
            rows = [parsed(c) | {"segment": segment, "offset": at, "length": n} for at, n, c in members(content)]
            yield pa.RecordBatch.from_pylist([r | {"place": i} for i, r in enumerate(sorted(rows, key=_order))], schema)

    return parked(by_batch(archives, run, FIELDS, rows=1), "captures")


class LoserTree:
    """Merges k sorted iterators: each inner node holds the loser of its match, so a new head plays log2(k) matches."""

    def __init__(self, runs: list[Iterator], key):
        self.key, self.runs = key, runs
        self.heads = [next(r, None) for r in runs]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.size = max(1, len(runs))
        self.loser = [-1] * self.size
        for i in range(len(runs)):
            self._play(i, build=True)

    def _beats(self, a: int, b: int) -> bool:
        ka, kb = self.keys[a], self.keys[b]
        return kb is None or ka is not None and (ka, a) < (kb, b)

    def _play(self, i: int, build: bool = False) -> None:
        at = (i + self.size) // 2
        while at > 0:
            if self.loser[at] < 0 and build:
                self.loser[at] = i  # waits for the other side of this match
                return
            if self.loser[at] >= 0 and self._beats(self.loser[at], i):
                self.loser[at], i = i, self.loser[at]
            at //= 2
        self.loser[0] = i

    def __iter__(self):
        while self.runs and self.keys[winner := self.loser[0]] is not None:
            yield self.heads[winner]
            self.heads[winner] = next(self.runs[winner], None)
            self.keys[winner] = None if self.heads[winner] is None else self.key(self.heads[winner])
            self._play(winner)


class Scratch:
    """Sorted runs in a file of the task's own: rows are written run by run and read back one at a time."""

    def __init__(self, file: BinaryIO):
        self.file, self.at, self.bounds = file, 0, []

    def add(self, row: dict, new: bool) -> None:
        blob = pickle.dumps(tuple(row.values()))
        if new:
            self.bounds.append([self.at, self.at])
        self.file.write(len(blob).to_bytes(4, "little") + blob)
        self.at += 4 + len(blob)
        self.bounds[-1][1] = self.at

    def runs(self, names: list[str]) -> list[Iterator[dict]]:
        self.file.flush()
        handle = self.file.fileno()

        def one(at: int, end: int) -> Iterator[dict]:
            while at < end:
                n = int.from_bytes(os.pread(handle, 4, at), "little")
                yield dict(zip(names, pickle.loads(os.pread(handle, n, at + 4)), strict=True))
                at += 4 + n

        return [one(*b) for b in self.bounds]


def histories(index: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The captures in global order of URL key and time: runs are cut by ranges of the key, each range merges its runs.

    Ranges are of (url_key, captured_at, page_id), so a URL with very many captures spans several; a range holds about
    ``range_rows`` rows however large the index is. A run's rows come back in the run's own order (``place``); they are
    laid out in a scratch file, and the merge holds one row of each run. A lost task begins its range anew.
    """
    spark = index.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-index.count() // range_rows))
    schema = pa.schema([(f.split()[0], {"string": pa.string(), "bigint": pa.int64()}[f.split()[1]]) for f in FIELDS.split(", ")])

    def merge(batches):
        with tempfile.TemporaryFile() as file:
            scratch, last = Scratch(file), None
            for batch in batches:
                for part in sliced(batch, 1024):
                    for row in part.to_pylist():
                        scratch.add(row, row["segment"] != last)
                        last = row["segment"]
            merged = iter(LoserTree(scratch.runs(schema.names), _order))
            while part := [r for _, r in zip(range(4096), merged, strict=False)]:
                yield pa.RecordBatch.from_pylist(part, schema)

    return index.repartitionByRange(ranges, "url_key", "captured_at", "page_id").sortWithinPartitions("segment", "place").mapInArrow(merge, FIELDS)
