"""WARC records with a two-level capture index.

Records are gzip members, packed one after another into segment files of the shared folder. An index line names a
record: its key (the URL with the host reversed), capture id, segment, offset and length. Lines sorted by key form
compressed blocks of ``BLOCK`` lines, packed into index files; a sparse directory holds each block's first key and
range, ``BLOCK`` entries to a compressed page of a directory file, and the pages' first keys and ranges are few enough
for every task (one for ``BLOCK`` ** 2 captures). A lookup binary-searches those, reads one directory page's range,
binary-searches it, reads one block's range, and then the record's range: files are opened and sought in, never read
whole, and neither records nor blocks pass through a shuffle.

Files are written by tasks under names of their own attempt; only those of attempts whose rows were committed are ever
named, so a task that is run again leaves at most a file that nothing reads.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.runtime import Scratch, ensure_importable

#: Lines of an index block, and entries of a directory page; bytes of payloads that a task gives on at once.
BLOCK, READ_BYTES = 3000, 8 << 20


def url_key(url: str) -> Column:
    """Key of a URL: lower-case host, without ``www.`` and default port, its labels reversed, then path and query.

    ``https://www.Example.com:443/a?b#c`` is ``com,example)/a?b``. Null stays null; what isn't a URL with
    a host is its own key.
    """
    u = F.col(url)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), r"^www[0-9]*\.", ""), r":(80|443)$", "")
    rest = F.regexp_replace(F.regexp_replace(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), r"#.*$", "")
    rest = F.when(F.substring(rest, 1, 1) == "/", rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(host == "", u).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), ","), F.lit(")"), rest))


def _line(text: str) -> str:
    return re.sub(r"[\r\n\t ]", lambda m: f"%{ord(m.group()):02X}", text)


def record(capture: int, url: str, payload: bytes) -> bytes:
    """One WARC record; its id is made from the capture's."""
    name = hashlib.md5(str(capture).encode()).hexdigest()
    head = (
        f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: {_line(url)}\r\n"
        f"WARC-Record-ID: <urn:uuid:{name[:8]}-{name[8:12]}-{name[12:16]}-{name[16:20]}-{name[20:]}>\r\n"
        f"WARC-Date: 1970-01-01T00:00:00Z\r\nVeldspar-Capture: {capture}\r\n"
        f"Content-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n"
    )
    return head.encode() + payload + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and payload of each record; ``data`` may be gzip members or plain.

    A record cut short at the end is left out.
    """
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode(errors="replace").split("\r\n")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(head.get("content-length", 0))
        if end + 4 + size > len(data):
            return
        yield head, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of ``.warc`` and ``.warc.gz`` files: ``path``, ``type``, ``url``, ``date``, ``content_type``, ``payload``.

    A header that a record lacks is null; an empty payload is empty; an empty file, and a record cut short at a
    file's end, give no row. Equal records are rows of their own. A folder of no files gives an empty table.
    """
    ensure_importable(spark)
    names = ["path", "type", "url", "date", "content_type", "payload"]

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out = [
                    (path, h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-date"), h.get("content-type"), p)
                    for h, p in parse(content)
                ]
                if out:
                    types = [pa.string()] * 5 + [pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), types)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(run, "path string, type string, url string, date string, content_type string, payload binary")


class Files:
    """Files of one folder that any task can write, and read ranges of."""

    def __init__(self, folder: str):
        self.folder = folder

    def _open(self):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.folder if "://" in self.folder else "file://" + re.sub("^file:", "", self.folder))
        return system, path

    def writer(self, kind: str) -> Writer:
        """For one task's files."""
        return Writer(self, kind)

    def reader(self) -> Reader:
        """For one task's reads."""
        return Reader(self)


class Writer:
    """Appends parts to files of at most ``most`` bytes (a larger part has a file of its own)."""

    def __init__(self, files: Files, kind: str, most: int = 256 << 20):
        self.system, self.path = files._open()
        context = TaskContext.get()
        self.stem = f"{kind}-{context.partitionId() if context else 0:05d}-{context.taskAttemptId() if context else 0}"
        self.most, self.number, self.out = most, 0, None

    def add(self, data: bytes) -> tuple[str, int]:
        """The file and offset at which ``data`` is written."""
        if self.out is not None and self.at + len(data) > self.most:
            self.close()
        if self.out is None:
            self.name, self.at = f"{self.stem}-{self.number}", 0
            self.system.create_dir(self.path, recursive=True)
            self.out = self.system.open_output_stream(f"{self.path}/{self.name}")
            self.number += 1
        at = self.at
        self.out.write(data)
        self.at += len(data)
        return self.name, at

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


class Reader:
    """Reads ranges; the file read last stays open. ``n_reads`` and ``n_bytes`` tell what was read."""

    def __init__(self, files: Files):
        self.system, self.path = files._open()
        self.name = self.file = None
        self.n_reads = self.n_bytes = 0

    def read(self, name: str, at: int, size: int) -> bytes:
        """``size`` bytes of a file from ``at`` on."""
        if name != self.name:
            self.close()
            self.file, self.name = self.system.open_input_file(f"{self.path}/{name}"), name
        self.file.seek(at)
        data = self.file.read(size)
        if len(data) != size:
            raise EOFError(f"{name} ends before {at + size}")
        self.n_reads += 1
        self.n_bytes += size
        return data

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = self.name = None


def _segments(batches, files: Files):
    """Pages (id, key, url, html) to records of segment files, and their index lines."""
    writer = files.writer("segment")
    try:
        for batch in batches:
            segments, starts, sizes, keys = [], [], [], []
            for k in range(batch.num_rows):
                capture, key, url, html = (batch.column(c)[k].as_py() for c in range(4))
                member = gzip.compress(record(capture, url or "", (html or "").encode()), 4, mtime=0)
                segment, at = writer.add(member)
                segments.append(segment), starts.append(at), sizes.append(len(member)), keys.append(_line(key or ""))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), batch.column(0), pa.array(segments, pa.string()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())],
                names=list(_LINE),
            )
    finally:
        writer.close()


_LINE = ("key", "id", "segment", "at", "size")
_LINES = "key string, id long, segment string, at long, size long"
#: A compressed part of an index or directory file: its first key and its range.
_PART = "first string, file string, at long, size long"


def _parts(batches, files: Files, kind: str, size: int):
    """Sorted rows, joined by tabs, to compressed parts of ``size`` lines in files of one task."""
    writer = files.writer(kind)
    held: list[tuple] = []

    def emit(rows: list[tuple]):
        data = zlib.compress("\n".join("\t".join(map(str, r)) for r in rows).encode(), 6)
        name, at = writer.add(data)
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[0][0]]), pa.array([name]), pa.array([at], pa.int64()), pa.array([len(data)], pa.int64())], names=["first", "file", "at", "size"]
        )

    try:
        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in range(batch.num_columns)))
            while len(held) >= size:
                yield emit(held[:size])
                held = held[size:]
        if held:
            yield emit(held)
    finally:
        writer.close()


def _span(firsts: list[str], key: str) -> range:
    """The parts whose lines may hold the key: the last one beginning before it, and all beginning with it."""
    return range(max(bisect.bisect_left(firsts, key) - 1, 0), bisect.bisect_right(firsts, key))


class Lookup:
    """Lookups by one reader; the directory page and the blocks read last are kept, so sorted keys read each once."""

    def __init__(self, files: Files, root: list[tuple[str, str, int, int]]):
        self.reader, self.root = files.reader(), root
        self.firsts = [r[0] for r in root]
        self.page: tuple = (None, [], [])
        self.block: tuple = (None, [], [])

    def _load(self, held: tuple, part: tuple) -> tuple:
        where = tuple(part[1:])
        if held[0] == where:
            return held
        name, at, size = where
        rows = [x.split("\t") for x in zlib.decompress(self.reader.read(name, int(at), int(size))).decode().split("\n")]
        return where, [x[0] for x in rows], rows

    def find(self, key: str) -> Iterator[list[str]]:
        """Index lines (key, id, segment, at, size) of a key."""
        for p in _span(self.firsts, key):
            self.page = self._load(self.page, self.root[p])
            _, firsts, parts = self.page
            for b in _span(firsts, key):
                self.block = self._load(self.block, parts[b])
                _, known, lines = self.block
                yield from lines[bisect.bisect_left(known, key) : bisect.bisect_right(known, key)]


class CaptureIndex:
    """Segments, index and directory of a table of pages, as files of the shared folder."""

    def __init__(self, pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", block: int = BLOCK, scratch: Scratch | None = None):
        spark = pages.sparkSession
        ensure_importable(spark)
        scratch = self.scratch = scratch or Scratch(spark)
        files = self.files = Files(f"{scratch.root}/warc-{uuid.uuid4().hex}")
        self.parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = pages.select(F.col(id_col).cast("long").alias("id"), url_key(url).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"))
        self.lines = scratch.keep(rows.where("id is not null").mapInArrow(lambda b: _segments(b, files), _LINES))
        blocks = scratch.keep(
            self.lines.repartitionByRange(self.parts, "key", "id").sortWithinPartitions(*_LINE)
            .mapInArrow(lambda b: _parts(b, files, "index", block), _PART)
        )
        # one row for a block: sorted in few tasks; a key that begins several blocks finds them all, in any order
        pages = scratch.keep(
            blocks.repartitionByRange(max(1, self.parts // 16), *blocks.columns).sortWithinPartitions(*blocks.columns)
            .mapInArrow(lambda b: _parts(b, files, "directory", block), _PART)
        )
        self.root = sorted(tuple(r) for r in pages.collect())

    def lookup(self, keys: DataFrame) -> DataFrame:
        """``key``, ``id``, ``segment``, ``at``, ``size`` of every capture of each distinct key; keys without one have no row.

        Null keys are the empty one. Keys are sorted and dealt out by range, so each task reads its own part of the
        directory and index.
        """
        files, root = self.files, self.root

        def run(batches):
            found = Lookup(files, root)
            for batch in batches:
                rows = [(x[0], int(x[1]), x[2], int(x[3]), int(x[4])) for k in map(_line, batch.column(0).to_pylist()) for x in found.find(k)]
                if rows:
                    types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=list(_LINE))
            found.reader.close()

        wanted = keys.select(F.coalesce("key", F.lit("")).alias("key")).distinct()
        return wanted.repartitionByRange(self.parts, "key").sortWithinPartitions("key").mapInArrow(run, _LINES)

    def read(self, hits: DataFrame) -> DataFrame:
        """``key``, ``id``, ``url``, ``payload`` of the hits, each read from its range of its segment.

        Hits are sorted by segment and offset and dealt out by range, so a task reads forward in its few segments.
        """
        files = self.files

        def run(batches):
            reader = files.reader()
            for batch in batches:
                out, held = [], 0
                for key, capture, segment, at, size in zip(*(batch.column(c).to_pylist() for c in range(5))):
                    ((head, body),) = parse(reader.read(segment, at, size))
                    if int(head["veldspar-capture"]) != capture:
                        raise ValueError(f"the index names another record at {segment}, {at}")
                    out.append((key, capture, head.get("warc-target-uri"), body))
                    held += len(body)
                    if held > READ_BYTES:
                        yield _read_rows(out)
                        out, held = [], 0
                if out:
                    yield _read_rows(out)
            reader.close()

        order = ["segment", "at", "key", "id"]
        return hits.select(*_LINE).repartitionByRange(self.parts, *order).sortWithinPartitions(*order).mapInArrow(run, "key string, id long, url string, payload binary")


def _read_rows(rows: list[tuple]):
    types = (pa.string(), pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=["key", "id", "url", "payload"])


def captures(pages: DataFrame, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """Index ``pages`` and look every URL up: ``page_id``, ``key``, ``n_captures``, ``n_bytes``, ``digest`` of each record read.

    ``n_captures`` counts the key's records, ``digest`` is the MD5 of the payload. Null and empty HTML is an
    empty payload; a null or empty URL has the empty key. Blanks and line ends in a key are percent-encoded.
    Rows with a null id are left out; repeated rows are captures of their own, and so are those that tie in key and
    id. Pages of any length are one record each. Other columns are ignored; an empty table gives an empty result.
    """
    index = CaptureIndex(pages, block=block, scratch=scratch)
    hits = index.lookup(pages.where("page_id is not null").select(url_key("url").alias("key")))
    hits = index.scratch.keep(hits)
    totals = hits.groupBy("key").agg(F.count(F.lit(1)).alias("n_captures"))
    found = index.read(hits).select(F.col("id").alias("page_id"), "key", F.length("payload").cast("long").alias("n_bytes"), F.md5("payload").alias("digest"))
    return found.join(totals, "key").select("page_id", "key", "n_captures", "n_bytes", "digest")


WARC_SQL = r"""
WITH p AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^www[0-9]*\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', ''), '#.*$', '') AS rest
  FROM pages WHERE page_id IS NOT NULL
), k AS (
  SELECT page_id, html, coalesce(CASE WHEN host = '' THEN url ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || ')'
    || CASE WHEN rest LIKE '/%' THEN rest ELSE '/' || rest END END, '') AS key FROM p
)
SELECT page_id, key, count(*) OVER (PARTITION BY key) AS n_captures, strlen(coalesce(html, '')) AS n_bytes, md5(coalesce(html, '')) AS digest FROM k
"""
