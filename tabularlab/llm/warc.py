"""WARC archives: a writer with revisit records and a salvaging reader.

Writing: equal payloads are found by SHA-1 and length in one aggregation; the
smallest page id of a group is its response, the others are revisits that
refer to it.  Tasks pack records as gzip members into runs of a few megabytes;
Spark's text sink puts many runs into one archive, in any store that Spark can
write to.

Reading: every record is checked (gzip checksum, version line, headers, length,
closing line feeds, block and payload digests).  After a failed check the
reader searches for the next gzip member or version line from which a valid
record follows, goes on there, and logs the byte gap with its reason.  An archive
is read through a window of ``WINDOW`` bytes and its rows leave in batches of
``BATCH_BYTES``: a task's memory follows the largest record (or member), not the archive.

Defined cases: null html is an empty payload; empty payloads form one group like
any other; rows with the group's smallest page_id (repeated rows, too) are
responses; rows with a null page_id revisit their group's response, or are
responses if the group has no id at all.  Only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularlab.llm.common import Scratch, need

ARCHIVE_BYTES = 256 << 20          # an archive holds about this many bytes
RUN_BYTES = 4 << 20                # of which a task holds this many while packing
PIECE = 1 << 16                    # bytes given to the decompressor at a time
WINDOW = 1 << 20                   # bytes of an archive held while reading
BATCH_BYTES = 8 << 20              # payload bytes in a batch of rows read
BATCH_ROWS = 4096
DATE = "2024-01-01T00:00:00Z"      # the pages carry no capture time
VERSION = re.compile(rb"WARC/(?:0\.\d+|1\.[01])\r\n")
LINE = re.compile(rb"WARC/[01]\.")                # where a version line may begin, 7 bytes at most
START = re.compile(rb"\x1f\x8b\x08|WARC/[01]\.")
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [
        ("WARC-Type", kind), ("WARC-Date", DATE), *headers,
        ("WARC-Block-Digest", "sha1:" + digest(block)), ("Content-Length", str(len(block)))])
    return member(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n")


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def page_record(page_id, url: str | None, html: bytes, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    headers = [("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Target-URI", uri),
               ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", "sha1:" + digest(html))]
    if refers_to is None:
        return record("response", headers, http + html)
    return record("revisit", [*headers, ("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<urn:page:{refers_to}>")], http)


def info_record() -> bytes:
    return record("warcinfo", [("WARC-Record-ID", "<urn:info>"), ("Content-Type", "application/warc-fields")],
                  b"format: WARC File Format 1.1\r\n")


def with_references(pages: DataFrame) -> DataFrame:
    """Pages with ``refers_to``: the response's page_id for revisits, else null."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.sha1(html).alias("sha"), F.octet_length(html).alias("size"))
    # only groups of two or more matter; rows of a large group are spread by the skew-split join
    first = rows.groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")) \
        .where("n > 1").drop("n")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(first, ["sha", "size"], "left") \
        .select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, out: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write one record per page into archives of about ``archive_bytes`` under the folder ``out``."""
    need(pages, "page_id", "url", "html")
    run_bytes = min(RUN_BYTES, archive_bytes)
    runs = max(1, archive_bytes // run_bytes)      # in an archive; each begins with an info record

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, closed = [info_record()], 0, 0

        def close() -> pa.RecordBatch:
            data = b"".join(held)
            if data[-1]:   # the sink closes a row with a zero byte: let the last member end in one
                data += member(b"")
            return pa.RecordBatch.from_arrays([pa.array([data[:-1]], pa.binary())], names=["run"])

        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            for page_id, url, html, refers_to in zip(*columns):
                held.append(page_record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to))
                size += len(held[-1])
                if size >= run_bytes:
                    yield close()
                    closed += 1
                    held, size = [] if closed % runs else [info_record()], 0
        if size:
            yield close()

    # a member ends in the high byte of its length, which is zero below 16 MB: the row is
    # written without it and the sink's separator puts it back, so files are members only
    with_references(pages).mapInArrow(pack, "run binary").select(F.col("run").cast("string")) \
        .write.option("lineSep", "\0").option("maxRecordsPerFile", runs).text(out)


# -- reading ----------------------------------------------------------------

class Damaged(Exception):
    pass


class Source:
    """Bytes of a seekable file at any place, through one held window."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.held = file, size, 0, b""

    @classmethod
    def of(cls, data) -> "Source":
        return data if isinstance(data, Source) else cls(io.BytesIO(data), len(data))

    def read(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        if n > WINDOW:                             # a long block is handed on, not held
            self.file.seek(at)
            return self.file.read(n)
        if at < self.at or at + n > self.at + len(self.held):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(min(WINDOW, self.size - at))
        return self.held[at - self.at: at - self.at + n]

    def find(self, pattern: re.Pattern, at: int, overlap: int) -> int:
        """Where the next match of at most ``overlap`` + 1 bytes begins; the size if there is none."""
        while at < self.size:
            part = self.read(at, PIECE)
            found = pattern.search(part)
            if found:
                return at + found.start()
            if at + len(part) >= self.size:
                break
            at += len(part) - overlap
        return self.size


def read_member(data, at: int) -> tuple[bytes, int]:
    """(content, end) of the gzip member at ``at``; its checksum and length are checked."""
    source = Source.of(data)
    z, parts, fed = zlib.decompressobj(31), [], at
    try:
        while not z.eof:
            if fed >= source.size:
                raise Damaged("truncated member")
            piece = source.read(fed, PIECE)
            parts.append(z.decompress(piece))
            fed += len(piece)
    except zlib.error as e:
        raise Damaged(f"bad member: {e}") from None
    return b"".join(parts), fed - len(z.unused_data)


BLANK = re.compile(rb"\r\n\r\n")


def read_record(data, at: int) -> tuple[dict, int]:
    """(record, end) of the record at ``at``; raises Damaged if a check fails."""
    source = Source.of(data)
    if not LINE.match(source.read(at, 8)):
        raise Damaged("no version line")
    stop = source.find(BLANK, at, 3)
    if stop == source.size:
        raise Damaged("headers not closed")
    head = source.read(at, stop - at)
    if not VERSION.match(head + b"\r\n"):
        raise Damaged("no version line")
    headers: dict[str, str] = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise Damaged("bad header line")
        headers.setdefault(name.strip().decode("utf-8", "replace").lower(), value.strip().decode("utf-8", "replace"))
    if not all(h in headers for h in ("warc-type", "warc-record-id", "content-length")):
        raise Damaged("missing header")
    if not re.fullmatch("[0-9]{1,18}", headers["content-length"]):
        raise Damaged("bad length")
    if not (headers["warc-record-id"].startswith("<") and headers["warc-record-id"].endswith(">")):
        raise Damaged("bad record id")
    start, end = stop + 4, stop + 4 + int(headers["content-length"])
    if source.read(end, 4) != b"\r\n\r\n":        # before the block is read: a wrong length costs nothing
        raise Damaged("block not closed")
    block = source.read(start, end - start)
    if not agrees(headers.get("warc-block-digest"), block):
        raise Damaged("block digest")
    kind, payload, size = headers["warc-type"], block, len(block)
    if headers.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        size = len(payload)
        if kind == "revisit":
            said = re.search(rb"(?im)^content-length:\s*(\d+)", head)
            size = int(said[1]) if said else None
    if kind != "revisit" and not agrees(headers.get("warc-payload-digest"), payload):
        raise Damaged("payload digest")
    return {"record_type": kind, "record_id": headers["warc-record-id"].strip("<>"),
            "target_uri": headers.get("warc-target-uri"),
            "refers_to": headers["warc-refers-to"].strip("<>") if "warc-refers-to" in headers else None,
            "payload": None if kind == "revisit" else payload, "payload_bytes": size,
            "payload_digest": headers.get("warc-payload-digest", "").removeprefix("sha1:") or None}, end + 4


def agrees(said: str | None, data: bytes) -> bool:
    return said is None or not said.startswith("sha1:") or said[5:].upper() == digest(data)


def salvage(data) -> Iterator[tuple[str, int, int, object]]:
    """("record", start, end, fields) and ("gap", start, end, reason), in file order, of bytes or a ``Source``.

    Gaps inside a sound gzip member carry the member's bounds and say where in
    its content they lie."""
    source = Source.of(data)
    at, gap_from, reason = 0, -1, ""
    while at < source.size:
        try:
            if source.read(at, 2) == b"\x1f\x8b":
                content, end = read_member(source, at)
                found = ((k, at, end, x if k == "record" else f"{x} (content {a}-{z})")
                         for k, a, z, x in salvage_content(content))
            else:
                fields, end = read_record(source, at)
                found = [("record", at, end, fields)]
        except Damaged as e:
            if gap_from < 0:
                gap_from, reason = at, str(e)
            at = source.find(START, at + 1, 6)
            continue
        if gap_from >= 0:
            yield "gap", gap_from, at, reason
            gap_from = -1
        yield from found
        at = end
    if gap_from >= 0:
        yield "gap", gap_from, source.size, reason


def salvage_content(content: bytes) -> Iterator[tuple[str, int, int, object]]:
    """The records of one member's content, which may hold several or none."""
    source = Source.of(content)
    at, gap_from, reason = 0, -1, ""
    while at < source.size:
        try:
            fields, end = read_record(source, at)
        except Damaged as e:
            if gap_from < 0:
                gap_from, reason = at, str(e)
            at = source.find(LINE, at + 1, 6)
            continue
        if gap_from >= 0:
            yield "gap", gap_from, at, reason
            gap_from = -1
        yield "record", at, end, fields
        at = end
    if gap_from >= 0:
        yield "gap", gap_from, source.size, reason


STORES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}   # Spark's names and Arrow's


def open_archive(path: str):
    """A seekable file for a path as Spark lists it, in the stores that Arrow reads."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return pyarrow.fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    store, inner = pyarrow.fs.FileSystem.from_uri(f"{STORES[scheme]}:{quote(rest)}")
    return store.open_input_file(inner)


FIELDS = ("record_type", "record_id", "target_uri", "refers_to", "payload", "payload_bytes", "payload_digest")
READ_SCHEMA = ("path string, kind string, start long, end long, reason string, record_type string, record_id string, "
               "target_uri string, refers_to string, payload binary, payload_bytes long, payload_digest string")


def batches_of(path: str, source: Source, payloads: bool) -> Iterator[pa.RecordBatch]:
    """The rows of one archive, in batches of bounded bytes."""
    types = {"payload": pa.binary(), "payload_bytes": pa.int64()}

    def batch() -> pa.RecordBatch:
        fields = [x if k == "record" else {} for k, _, _, x in rows]
        return pa.RecordBatch.from_arrays(
            [pa.array([path] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.string()),
             pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
             pa.array([None if r[0] == "record" else r[3] for r in rows], pa.string()),
             *(pa.array([f.get(n) for f in fields], types.get(n, pa.string())) for n in FIELDS)],
            names=["path", "kind", "start", "end", "reason", *FIELDS])

    rows, held = [], 0
    for row in salvage(source):
        if row[0] == "record":
            if not payloads:
                row[3]["payload"] = None
            held += len(row[3]["payload"] or b"")
        rows.append(row)
        if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
            yield batch()
            rows, held = [], 0
    if rows:
        yield batch()


def read_archives(spark: SparkSession, folder: str, payloads: bool = True, pattern: str | None = None,
                  opener: Callable = open_archive) -> DataFrame:
    """All records and gaps of the archives in a folder, one row each.  ``kind`` is
    "record" or "gap"; ``start`` and ``end`` are byte positions in the file.  Spark
    lists the files; each is streamed by one task through ``opener`` (path to seekable file).
    Where Arrow knows no such store and no other opener is given, Spark reads the files, whole."""
    files = spark.read.format("binaryFile")
    if pattern:
        files = files.option("pathGlobFilter", pattern)
    files = files.load(folder)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    scheme = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme()
    streamed = opener is not open_archive or scheme in STORES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                path = b.column(0)[i].as_py()
                if streamed:
                    with opener(path) as file:
                        yield from batches_of(path, Source(file, b.column(1)[i].as_py()), payloads)
                else:
                    yield from batches_of(path, Source.of(b.column(1)[i].as_py() or b""), payloads)

    if streamed:                                   # the listing alone: contents are not read by Spark
        return files.select("path", "length").mapInArrow(run, READ_SCHEMA)
    return files.select("path", "content").mapInArrow(run, READ_SCHEMA)


def archive_report(pages: DataFrame) -> DataFrame:
    """Write one record per page, read the archives back: (page_id, payload_bytes,
    payload_digest, record_type, refers_to)."""
    spark = pages.sparkSession

    def page(column: str):
        return F.nullif(F.substring_index(F.col(column), ":", -1), F.lit("")).cast("bigint")

    with Scratch(spark, "warc") as scratch:
        out = scratch.path("archives")
        scratch.paths.append(out)
        write_archives(pages, out)
        rows = read_archives(spark, out, payloads=False).where("kind = 'record' and record_type <> 'warcinfo'")
        return scratch.table(rows.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest",
                                         "record_type", page("refers_to").alias("refers_to")), "result", keep=True)


ARCHIVE_SQL = """
with p as (select page_id, coalesce(html, '') as h, sha1(encode(coalesce(html, ''))) as s from pages),
d as (select *, min(page_id) over (partition by h) as f,
             list_transform(range(8), lambda i: cast('0x' || substr(s, 1 + 5 * i, 5) as bigint)) as q from p)
select page_id, cast(strlen(h) as bigint) as payload_bytes,
       list_reduce(list_transform(q, lambda v: list_reduce(list_transform([32768, 1024, 32, 1], lambda m:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((v // m) % 32 as bigint), 1)), lambda a, b: a || b)),
           lambda a, b: a || b) as payload_digest,
       case when page_id = f then 'response' else 'revisit' end as record_type,
       case when page_id = f then null else f end as refers_to
from d
"""
