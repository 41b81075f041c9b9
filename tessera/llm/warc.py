"""WARC archives of pages, and a normaliser for archives that are one gzip stream.

`write_archives` makes whole-file gzip streams of WARC records with Spark's text writer. `normalise` inflates
each such stream once, rewrites every record as a gzip member of its own and writes a sidecar index
(offset, length and identity of each member) next to the archive. `read_records` inflates members by the
index, each by itself.

Files in the shared folder are opened through pyarrow's file systems; a file is written under another name and
moved into place when it is whole, so that a task which is run again leaves the same files.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh_path, remove, small_side

#: Payloads of at least so many bytes are stored once and revisited.
LEAST_SHARED = 1000
WARC_DATE = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"
STEP, ARCHIVE_BYTES = 1 << 20, 256 << 20


def with_revisits(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """page_id, url, body, digest (SHA-1 in hex), bytes, refers_to (null for a response) for each page.

    A null html is empty. Of pages with equal payloads of at least `least` bytes the one with the largest
    page_id is the response; repeated rows of it are responses too. Pages without page_id are responses.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), body.alias("body"), F.sha1(F.encode(body, "utf-8")).alias("digest"), F.octet_length(body).cast("long").alias("bytes"))
    keys = rows.filter((F.col("bytes") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest", "bytes")
    last = small_side(keys.groupBy("digest", "bytes").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "bytes", "last"))
    # bodies meet what they refer to by their own page_id: a payload that many pages share is no hot key
    refers = small_side(keys.join(last, ["digest", "bytes"]).filter(F.col("last") != F.col("page_id")).distinct())
    return rows.join(refers, ["page_id", "digest", "bytes"], "left").select("page_id", "url", "body", "digest", "bytes", F.col("last").alias("refers_to"))


def record_text(page_id, url, body, digest, size, refers_to):
    """A WARC record as text, without the two line ends that close it."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))
    block = F.when(refers_to.isNull(), F.concat(http, body)).otherwise(http)
    name = F.coalesce(page_id.cast("string"), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(refers_to.isNull(), "response").otherwise("revisit"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), name,
        F.lit(f">\r\nWARC-Date: {WARC_DATE}\r\nWARC-Target-URI: "), F.regexp_replace(url, "[\\x00-\\x20]", "%20"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), digest,
        F.when(refers_to.isNull(), "").otherwise(F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), refers_to.cast("string"), F.lit(">"))),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"), block,
    )


def write_archives(pages: DataFrame, path: str) -> None:
    """Write pages as archives of one gzip stream each, one or more a task: none holds more records than come to
    ARCHIVE_BYTES at the mean size of a page."""
    mean = pages.agg(F.avg(F.octet_length(F.coalesce(F.col("html").cast("string"), F.lit(""))))).first()[0] or 0
    rows = with_revisits(pages).select(record_text(*(F.col(c) for c in ("page_id", "url", "body", "digest", "bytes", "refers_to"))).alias("value"))
    rows.write.option("maxRecordsPerFile", int(ARCHIVE_BYTES / (mean + 512)) + 1).option("compression", "gzip").option("lineSep", END.decode()).text(path)


def records(pieces):
    """The records of one inflated stream, given in pieces: header and block bytes as they stand."""
    held = bytearray()
    pieces = iter(pieces)

    def more(need: int) -> bool:
        while len(held) < need:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while True:
        seen = 0
        while (at := held.find(END, seen)) < 0:
            seen = max(0, len(held) - 3)
            if not more(len(held) + 1):
                if bytes(held).strip():
                    raise ValueError("the archive ends within a record's header")
                return
        size = re.search(rb"(?im)^content-length:\s*(\d+)", held[:at])
        if not held.startswith(b"WARC/") or not size:
            raise ValueError("no WARC record where one should begin")
        need = at + 4 + int(size[1])
        if not more(need):
            raise ValueError("the archive ends within a record's block")
        yield bytes(held[: at + 4]), bytes(held[at + 4 : need])
        more(need + 4)
        del held[: need + 4 if held[need : need + 4] == END else need]


def inflated(read):
    """Pieces of a gzip stream, of which read(n) gives the next bytes; members that follow each other are one stream."""
    d, given, any_ = zlib.decompressobj(31), b"", False
    while True:
        given = given or read(STEP)
        if not given:
            break
        any_ = True
        if d.eof:
            given = given.lstrip(b"\0")
            if not given:
                continue
            d = zlib.decompressobj(31)
        piece = d.decompress(given, 4 * STEP)
        if piece:
            yield piece
        given = d.unused_data if d.eof else d.unconsumed_tail
    if any_ and not d.eof:
        raise ValueError("the gzip stream is cut off")


def _at(path: str):
    """The file system and the path in it, of a path as Spark gives it."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


def member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def field(header: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", header)
    return m[1].decode() if m else None


def _put(fs, path: str, write) -> None:
    made = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(made, compression=None) as f:
        write(f)
    fs.move(made, path)


INDEX = "archive string, at long, length long, record_id string, record_type string, block_bytes long"


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrite every archive of source as target/NAME.warc.gz with NAME.idx beside it; returns the index rows.

    An archive that is cut off or holds something else than records fails the job. An empty one gives an
    archive without records. The result is lazy and writes when it is read; write it to keep it.
    """

    def rewrite(batches):
        fs, top = pafs.FileSystem.from_uri(target)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                name = re.sub(r"(\.txt|\.warc)?\.gz$", "", path.rpartition("/")[2])
                out, at = [], 0

                def write(f, path=path):
                    nonlocal at
                    own, place = _at(path)
                    with own.open_input_stream(place, compression=None) as source_:
                        for header, block in records(inflated(source_.read)):
                            packed = member(header + block + END)
                            f.write(packed)
                            out.append((at, len(packed), field(header, "WARC-Record-ID"), field(header, "WARC-Type"), len(block)))
                            at += len(packed)

                _put(fs, f"{top}/{name}.warc.gz", write)
                _put(fs, f"{top}/{name}.idx", lambda f: f.write("".join("\t".join(map(str, row)) + "\n" for row in out).encode()))
                cols = list(zip(*out, strict=True)) if out else [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([f"{target}/{name}.warc.gz"] * len(out), pa.string()), *(pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True))], names=["archive", "at", "length", "record_id", "record_type", "block_bytes"])

    made = pafs.FileSystem.from_uri(target)
    made[0].create_dir(made[1], recursive=True)
    return spark.read.format("binaryFile").load(source).select("path").mapInArrow(rewrite, INDEX)  # paths only: tasks read the streams


RECORDS = "archive string, record_id string, record_type string, refers_to string, digest string, payload_bytes long, block binary"
DIGESTS = RECORDS.replace(", block binary", "")


def read_records(spark: SparkSession, source: str, with_block: bool = True) -> DataFrame:
    """Records of normalised archives, each inflated by its place in the sidecar index and checked against its digest.

    payload_bytes is the length that the HTTP header names, for a revisit that of the payload referred to; digest
    is in hex. A response whose payload has another digest or length fails the job.
    """

    def read(batches):
        for batch in batches:
            for idx, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                archive = re.sub(r"\.idx$", ".warc.gz", idx)
                fs, path = _at(archive)
                rows = []
                with fs.open_input_file(path) as f:
                    for line in lines.decode().splitlines():
                        at, length = map(int, line.split("\t")[:2])
                        record = zlib.decompress(f.read_at(length, at), 31)
                        cut = record.index(END) + 4
                        head, block = record[:cut], record[cut:-4]
                        kind, digest = field(head, "WARC-Type"), field(head, "WARC-Payload-Digest").removeprefix("sha1:")
                        top = block.index(END) + 4
                        size = int(field(block[:top], "Content-Length"))
                        if kind == "response" and (len(block) - top != size or hashlib.sha1(block[top:]).hexdigest() != digest):
                            raise ValueError(f"{archive}: the record at {at} is not what its header says")
                        rows.append((archive, field(head, "WARC-Record-ID"), kind, field(head, "WARC-Refers-To"), digest, size, block if with_block else None))
                        if len(rows) == 256:
                            yield pack(rows)
                            rows = []
                yield pack(rows)

    names = ("archive", "record_id", "record_type", "refers_to", "digest", "payload_bytes", "block")[: 7 if with_block else 6]

    def pack(rows):
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        kinds = (*[pa.string()] * 5, pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in list(zip(cols, kinds, strict=True))[: len(names)]], names=list(names))

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.idx").load(source).select("path", "content")
    return found.mapInArrow(read, RECORDS if with_block else DIGESTS)


def archived_pages(pages: DataFrame) -> DataFrame:
    """A row for each row of pages after a round trip through archives: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Wants page_id (long), url and html; other columns are ignored. Nulls as in with_revisits; no rows give no rows.
    """
    spark = pages.sparkSession
    raw, normal = fresh_path(spark, "streams"), fresh_path(spark, "archives")
    write_archives(pages, raw)
    normalise(spark, raw, normal).agg(F.count(F.lit(1))).collect()
    remove(spark, raw)  # nothing reads the streams any more
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?\\d*)>$", 1)
    rows = read_records(spark, normal, False)
    return rows.select(F.nullif(number("record_id"), F.lit("")).cast("long").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.nullif(number("refers_to"), F.lit("")).cast("long").alias("refers_to"))
