"""WARC archives: a writer and a sequential reader.

Each record is one gzip member. The reader inflates a member incrementally,
frames the record by its Content-Length, takes what is left after the
member's end as the next member's begin, and verifies both digests.

Payloads that are equal and at least ``least`` bytes long are stored once:
the record of the smallest page_id is a ``response``, the others are
``revisit`` records that name it and hold the HTTP header alone.

Defined results: a null html is the empty payload; a null url is written as
the empty target; rows with one page_id and equal payloads are each written,
and all but the response's own page_id count as revisits (equal rows of that
page_id are all responses); a null page_id never is a revisit's aim unless
all of its payload's are null, and those are all responses; an empty table
gives no archive and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.common import as_text, open_fs, scratch, written_files

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("n_records", T.LongType())])
ROWS = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def digest(data: bytes) -> str:
    """Base32 of SHA-1, upper case, without its algorithm's name."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page/{page_id}')}>"


def member(head: dict[str, str], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode("utf-8", "surrogatepass")
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n") + z.flush()


def record(page_id: int | None, url: str | None, payload: bytes, size: int, payload_digest: str, refers_to: int | None) -> bytes:
    """A response, or, where refers_to is given, a revisit without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (b"" if refers_to is not None else payload)
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": re.sub(r"[\r\n]", " ", url or ""),
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha1:{payload_digest}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
        "WARC-Page-ID": "" if page_id is None else str(page_id),
    }
    if refers_to is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to), "WARC-Refers-To-Page-ID": str(refers_to)}
    return member(head | {"Content-Length": str(len(block))}, block)


@dataclass
class Record:
    head: dict[str, str]
    block: bytes

    @property
    def http(self) -> tuple[bytes, bytes]:
        """(HTTP header, payload)"""
        head, _, body = self.block.partition(b"\r\n\r\n")
        return head, body


class Broken(ValueError):
    pass


def members(stream, chunk: int = 1 << 18) -> Iterator[Iterator[bytes]]:
    """The inflated pieces of each gzip member; every member is read to its end before the next."""
    waiting = stream.read(chunk)
    while waiting:
        z = zlib.decompressobj(31)

        def pieces(first: bytes, z=z):
            raw = first
            while not z.eof:
                if not raw:
                    raise Broken("an archive ends inside a member")
                if out := z.decompress(raw, 1 << 20):
                    yield out
                raw = z.unconsumed_tail or (b"" if z.eof else stream.read(chunk))

        whole = pieces(waiting)
        yield whole
        for _ in whole:
            pass
        waiting = z.unused_data or stream.read(chunk)


def records(stream) -> Iterator[Record]:
    """Every record, framed by its Content-Length and held against its digests. A header is as long as it is; its end is looked for within its own gzip member."""
    for pieces in members(stream):
        buffer, seen = bytearray(), 0
        while (at := buffer.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(buffer) - 3)
            piece = next(pieces, None)
            if piece is None:
                raise Broken("a record has no header")
            buffer += piece
        version, *lines = bytes(buffer[:at]).decode("utf-8", "surrogatepass").split("\r\n")
        if not version.startswith("WARC/1."):
            raise Broken(f"not a WARC record: {version[:20]!r}")
        head = {k: v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(head["Content-Length"])
        parts, got = [bytes(buffer[at + 4 :])], len(buffer) - at - 4
        for piece in pieces:
            parts.append(piece)
            got += len(piece)
            if got > size + 4:
                break
        whole = b"".join(parts)
        if whole[size:] != b"\r\n\r\n":
            raise Broken("a record is not as long as its Content-Length")
        found = Record(head, whole[:size])
        verify(found)
        yield found


def verify(r: Record) -> None:
    if "WARC-Block-Digest" in r.head and r.head["WARC-Block-Digest"] != f"sha1:{digest(r.block)}":
        raise Broken("a block does not match its digest")
    if r.head.get("WARC-Type") == "response" and "WARC-Payload-Digest" in r.head and r.head["WARC-Payload-Digest"] != f"sha1:{digest(r.http[1])}":
        raise Broken("a payload does not match its digest")


def write(df: DataFrame, folder: str, least: int = 0, most_bytes: int = 1 << 27, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes the archives, none much longer than ``most_bytes``, and returns their manifest.

    The smallest page_id of each payload is a grouped minimum over digests,
    combined before its shuffle; the join back is one Spark can split where
    many rows share a payload.
    """
    pages = df.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), as_text(F.col(html)).alias("html"))
    keyed = pages.withColumn("sha1", F.unhex(F.sha1(F.col("html").cast("binary")))).withColumn("size", F.octet_length("html").cast("long"))
    ids = df.select(F.col(page_id).cast("long").alias("page_id"), F.unhex(F.sha1(as_text(F.col(html)).cast("binary"))).alias("sha1"), F.octet_length(as_text(F.col(html))).alias("size"))
    firsts = ids.where(F.col("size") >= least).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha1", "first")
    told = keyed.join(firsts, "sha1", "left").withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("first") != F.col("page_id")), F.col("first")))
    slim = told.select("page_id", "url", "sha1", "size", "refers_to", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"))

    def run(batches, create):
        name, stream, n, at = "", None, 0, 0
        for batch in batches:
            for key, link, sha1, size, to, text in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if stream is None:
                    name, stream = create(".warc.gz")
                    n, at = 0, 0
                raw = record(key, link, (text or "").encode("utf-8", "surrogatepass"), size, base64.b32encode(sha1).decode(), to)
                stream.write(raw)
                n, at = n + 1, at + len(raw)
                if at >= most_bytes:
                    stream.close()
                    yield {"path": name, "n_records": n}
                    stream = None
        if stream is not None:
            stream.close()
            yield {"path": name, "n_records": n}

    return written_files(slim, folder, run, MANIFEST)


def read(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row a record of the archives listed."""
    n = max(2, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    schema = ROWS if with_payload else T.StructType(ROWS.fields[:-1])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                files, path = open_fs(uri)
                with files.open_input_stream(path) as stream:
                    rows, held = [], 0
                    for r in records(stream):
                        row, size = told(r)
                        rows.append(row)
                        held += size
                        if len(rows) >= 1000 or held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    def told(r: Record):
        http, body = r.http
        size = int(re.search(rb"(?i)\r\nContent-Length: *(\d+)", http)[1])
        whole = r.head["WARC-Type"] == "response"
        if whole and size != len(body):
            raise Broken("a payload is not as long as its Content-Length")
        to = r.head.get("WARC-Refers-To-Page-ID")
        row = {
            "page_id": int(r.head["WARC-Page-ID"]) if r.head["WARC-Page-ID"] else None,
            "url": r.head["WARC-Target-URI"],
            "payload_bytes": size,
            "payload_digest": r.head["WARC-Payload-Digest"].removeprefix("sha1:"),
            "record_type": r.head["WARC-Type"],
            "refers_to": int(to) if to else None,
        }
        return (row | {"payload": body if whole else None} if with_payload else row), len(body)

    return manifest.select("path").repartition(n, "path").mapInArrow(run, schema)


def write_and_read(df: DataFrame, least: int = 0, folder: str | None = None, with_payload: bool = True) -> DataFrame:
    return read(write(df, folder or scratch(df.sparkSession, "warc"), least), with_payload)
