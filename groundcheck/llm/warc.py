"""WARC archives with a two-level capture index.

Archives hold one gzip member per record, so any record can be read by its byte
range.  The index has one line per capture, sorted by reversed-host key and id:

* level 1: lines in gzip blocks of ``BLOCK`` captures, one file per range of keys;
* level 2: for each such file a sparse directory with the first key, offset and
  length of every block, and above all a list of the files' first keys (one per
  partition), which alone is broadcast.

A lookup bisects that list, then the file's directory, reads one block's byte
range, bisects its lines and reads the record's byte range.  Lookups are sorted
like the index, so neighbours share blocks.

Files are named by task attempt and only those that a finished task reports are
ever read: a lost executor or a repeated task leaves nothing but an orphan.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from groundcheck.llm._shared import join_skewed, materialize, new_path, only, shuffle_count, small_batches, store_of

BLOCK = 512  # captures of an index block
ROLL = 1 << 30  # bytes after which a task starts another archive
LEAST = 100  # bytes of payload from which equal ones are revisits
_ID_SPACE = 0x67726F756E64 << 80
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def reversed_host_key(url: str | None) -> str:
    """``http://www.Example.org:80/a?b#c`` as ``org,example)/a?b``; a url without host keeps its text."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return url
    if not host:
        return url
    host = re.sub(r"^www\d*\.", "", host)
    where = ",".join(reversed(host.split(".")))
    if port and port != {"http": 80, "https": 443}.get(u.scheme):
        where += f":{port}"
    return where + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")


def record_id(page: int) -> str:
    return f"<urn:uuid:{uuid.UUID(int=_ID_SPACE | page & (2**64 - 1))}>"


def page_of(record: str) -> int:
    low = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int & (2**64 - 1)
    return low - (1 << 64) if low >> 63 else low


def make_record(page: int, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """The bytes of a response record, or of a revisit (which holds no payload)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    page: int
    kind: str
    uri: str
    payload: bytes | None
    payload_bytes: int
    digest: str
    refers_to: int | None


def parse_record(data: bytes) -> Record:
    """A record from its bytes; a response's payload must have its digest."""

    def headers(text: bytes) -> dict[str, str]:
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in text.decode().split("\r\n")[1:])}

    top, _, rest = data.partition(b"\r\n\r\n")
    if not top.startswith(b"WARC/1."):
        raise ValueError("no WARC record")
    have = headers(top)
    block = rest[: int(have["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = have["warc-payload-digest"].removeprefix("sha256:")
    size, kind = int(headers(http)["content-length"]), have["warc-type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {have['warc-record-id']} differs from its digest")
    refers = have.get("warc-refers-to")
    return Record(page_of(have["warc-record-id"]), kind, have["warc-target-uri"], payload if kind == "response" else None, size, digest, page_of(refers) if refers else None)


def _task_name() -> str:
    task = TaskContext.get()
    return f"{task.partitionId():06d}-{task.taskAttemptId()}"


_CAPTURE = "key string, page long, file string, offset long, length long"


def _write_archives(base: str, date: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = store_of(base)
        store.create_dir(top, recursive=True)
        name, out, number, at = "", None, 0, 0
        for batch in batches:
            rows: list[tuple] = []
            for page, url, html, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("page", "url", "html", "digest", "refers_to")), strict=True):
                if out is None or at >= ROLL:
                    if out is not None:
                        out.close()
                    name, at, number = f"pages-{_task_name()}-{number}.warc.gz", 0, number + 1
                    out = store.open_output_stream(f"{top}/{name}", compression=None)
                member = gzip.compress(make_record(page, url, (html or "").encode(), digest, refers, date), level, mtime=0)
                out.write(member)
                rows.append((reversed_host_key(url), page, name, at, len(member)))
                at += len(member)
            out.flush()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["key", "page", "file", "offset", "length"])
        if out is not None:
            out.close()

    return run


def _write_index(base: str, block: int):
    """Captures in order; yields one row for each index file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = store_of(base)
        out, held, directory, at = None, [], [], 0
        name = f"captures-{_task_name()}"

        def flush() -> None:
            nonlocal out, at, held
            if out is None:
                store.create_dir(top, recursive=True)
                out = store.open_output_stream(f"{top}/{name}.cdx.gz", compression=None)
            data = gzip.compress("\n".join(json.dumps(x) for x in held).encode(), 6, mtime=0)
            directory.append((held[0][0], held[0][1], at, len(data)))
            out.write(data)
            at, held = at + len(data), []

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                held.append(row)
                if len(held) == block:
                    flush()
        if held:
            flush()
        if out is not None:
            out.close()
            with store.open_output_stream(f"{top}/{name}.idx.gz", compression=None) as f:
                f.write(gzip.compress(json.dumps(directory).encode(), mtime=0))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([directory[0][0]], pa.string()), pa.array([directory[0][1]], pa.int64())], names=["name", "key", "page"])

    return run


@dataclass
class CaptureIndex:
    """Where the archives and the index lie, and the first capture of each index file, in order."""

    base: str
    files: list[tuple[str, int, str]]  # key, page, name


class IndexReader:
    """Lookups in one process; keeps the last few directories, blocks and open archives."""

    def __init__(self, index: CaptureIndex) -> None:
        self.index = index
        self.store, self.top = store_of(index.base)
        self.firsts = [f[:2] for f in index.files]
        self.directory = lru_cache(8)(self._directory)
        self.block = lru_cache(8)(self._block)
        self.archive = lru_cache(64)(lambda name: self.store.open_input_file(f"{self.top}/{name}"))

    def _read(self, name: str, at: int, size: int) -> bytes:
        return self.archive(name).read_at(size, at)

    def _directory(self, name: str) -> list[tuple]:
        with self.store.open_input_file(f"{self.top}/{name}.idx.gz") as f:
            return [tuple(x) for x in json.loads(gzip.decompress(f.read()))]

    def _block(self, name: str, k: int) -> list[tuple]:
        _, _, at, size = self.directory(name)[k]
        return [tuple(json.loads(x)) for x in gzip.decompress(self._read(f"{name}.cdx.gz", at, size)).decode().split("\n")]

    def captures(self, key: str, page: int | None = None) -> Iterator[tuple]:
        """Index lines of a key, or of one page of it, in order."""
        want = (key, page if page is not None else -(2**63))
        file = max(0, bisect.bisect_left(self.firsts, want) - 1)
        while file < len(self.firsts):
            name = self.index.files[file][2]
            directory = self.directory(name)
            k = max(0, bisect.bisect_left(directory, want, key=lambda x: x[:2]) - 1)
            while k < len(directory):
                lines = self.block(name, k)
                for line in lines[bisect.bisect_left(lines, want, key=lambda x: x[:2]) :]:
                    if line[0] != key or page is not None and line[1] != page:
                        return
                    yield line
                k += 1
            file += 1

    def record(self, line: tuple) -> Record:
        return parse_record(gzip.decompress(self._read(*line[2:5])))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([reversed_host_key(u) for u in batch.column(0).to_pylist()], pa.string()), batch.column(1)], names=["key", "page"])


def _look_up(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = IndexReader(index.value)
        for batch in batches:
            rows = []
            for key, page in zip(batch.column("key").to_pylist(), batch.column("page").to_pylist(), strict=True):
                for line in reader.captures(key, page):
                    r = reader.record(line)
                    rows.append((r.page, r.uri, r.kind, r.payload_bytes, r.digest, r.refers_to))
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["page", "uri", "record_type", "payload_bytes", "payload_digest", "refers_to"])

    return run


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", base: str | None = None, date: str = "2000-01-01T00:00:00Z", level: int = 3, block: int = BLOCK) -> CaptureIndex:
    """Write archives and index of ``pages`` to ``base`` (a new shared folder by default).

    Of equal payloads of at least ``LEAST`` bytes the one of smallest id is a
    response and all others revisit it; each smaller one is a response.  Whole
    payloads of any length are kept.  A null payload is empty, a null url has the
    empty key, a null id ranks below all others.  Every row gets a record: rows
    repeated whole, and rows of one id with several urls or payloads; those of the
    smallest id of a payload are all responses.  Other columns, whatever their
    names, are not read.  Without rows there are no files.

    Bodies never meet by digest: which pages revisit is found with ids and digests
    alone, and each body is joined by its own page.
    """
    spark, pages = pages.sparkSession, only(pages, id_col, url_col, html_col)
    small_batches(spark)
    base, n = base or new_path(spark, "warc"), shuffle_count(spark)
    html, page = F.coalesce(F.col(html_col), F.lit("")), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("page")
    rows = pages.select(page, F.col(url_col).alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    seen = materialize(pages.where(F.octet_length(html) >= LEAST).select(page, F.sha2(html, 256).alias("digest")), "payloads", light=True)
    firsts = materialize(seen.groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1"), "payload-firsts", light=True)
    again = join_skewed(seen, firsts.drop("n"), ["digest"], firsts).where("page <> first").distinct()
    again = materialize(again.select(F.col("page").alias("own"), F.col("digest").alias("same"), "first"), "revisits", light=True)
    rows = rows.join(again, (F.col("page") == F.col("own")) & (F.col("digest") == F.col("same")), "left").select("page", "url", "html", "digest", F.col("first").alias("refers_to"))
    captures = materialize(rows.mapInArrow(_write_archives(base, date, level), _CAPTURE), "captures")
    found = captures.repartitionByRange(n, "key", "page").sortWithinPartitions("key", "page").mapInArrow(_write_index(base, block), "name string, key string, page long")
    return CaptureIndex(base, sorted((r.key, r.page, r.name) for r in found.collect()))  # one row per partition


def look_up(index: CaptureIndex, wanted: DataFrame, url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """``page, uri, record_type, payload_bytes, payload_digest, refers_to`` of the captures of the ``wanted`` url and id pairs.

    Every capture shows once however often its pair is wanted, also where two urls
    have one key; several captures of a pair all show.  A pair without a capture
    gives no row.
    """
    spark, wanted = wanted.sparkSession, only(wanted, url_col, id_col)
    small_batches(spark)
    place = spark.sparkContext.broadcast(index)
    pairs = wanted.select(F.col(url_col).alias("url"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("page"))
    keys = materialize(pairs.mapInArrow(_keys, "key string, page long").distinct(), "lookups", light=True)
    line = keys.repartitionByRange(shuffle_count(spark), "key", "page").sortWithinPartitions("key", "page")  # like the index
    out = line.mapInArrow(_look_up(place), "page long, uri string, record_type string, payload_bytes long, payload_digest string, refers_to long")
    lowest = F.lit(-(2**63))
    return out.withColumns({c: F.when(F.col(c) != lowest, F.col(c)) for c in ("page", "refers_to")})
