"""WARC 1.1 archives: one gzip member per record, written and read one record after another.

Archives are binary cells of a Parquet table in the folder that the cluster shares, because only Spark reaches every
store; the reader takes any iterable of bytes, so files read with Spark's binaryFile format work as well.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, materialize

REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
STEP = 1 << 16
HEAD = 1 << 22  # a head beyond this is no record
KINDS = "page_id {}, payload_bytes long, payload_digest string, record_type string, refers_to {}, target_uri string"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None = None, date: str = "1970-01-01T00:00:00Z", level: int = 4) -> bytes:
    """One record as a gzip member. With refers_to it is a revisit: the HTTP head alone, with the payload's digest."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT}"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: {digest(payload)}", f"WARC-Block-Digest: {digest(block)}", f"Content-Length: {len(block)}"]
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


@dataclass
class Record:
    head: dict[str, str]
    block: bytes

    @property
    def http(self) -> tuple[dict[str, str], bytes]:
        head, _, body = self.block.partition(b"\r\n\r\n")
        return fields(head.decode("latin-1").split("\r\n")[1:]), body


def fields(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def inflated(chunks: Iterable[bytes]) -> Iterator[tuple[bytes, bool]]:
    """(bytes, whether a gzip member ends with them), decompressed in steps of at most STEP bytes, whatever a member
    holds; a broken or cut member is a ValueError."""
    inflate, open_ = zlib.decompressobj(31), False
    for chunk in chunks:
        while chunk:
            open_ = True
            try:
                part = inflate.decompress(chunk, STEP)
            except zlib.error as e:
                raise ValueError(f"broken gzip member: {e}") from e
            yield part, inflate.eof
            if inflate.eof:
                chunk = inflate.unused_data
                inflate, open_ = zlib.decompressobj(31), False
            else:
                chunk = inflate.unconsumed_tail
    if open_:
        raise ValueError("the archive ends within a gzip member")


class Frame:
    """A record as it is read: its head up to the empty line, then the block of Content-Length bytes and the closing
    line ends; a member that goes on beyond these is refused before more of it is inflated."""

    def __init__(self) -> None:
        self.held, self.said, self.size = bytearray(), None, 0
        self.sha = hashlib.sha1()

    def feed(self, part: bytes) -> None:
        begin = max(len(self.held) - 3, 0)
        self.held += part
        if self.said is None:
            at = self.held.find(b"\r\n\r\n", begin)
            if not self.held.startswith(b"WARC/"[: len(self.held)]) or at < 0 and len(self.held) > HEAD:
                raise ValueError("no WARC record at the start of a member")
            if at < 0:
                return
            self.said = fields(self.held[:at].decode("utf-8").split("\r\n")[1:])
            self.size = int(self.said["content-length"])
            del self.held[: at + 4]
            part = bytes(self.held)
        before = len(self.held) - len(part)
        if before < self.size:
            self.sha.update(memoryview(part)[: self.size - before])
        if len(self.held) > self.size + 4:
            raise ValueError(f"a record of {self.size} bytes is framed by more")

    def record(self) -> Record:
        if self.said is None:
            raise ValueError("no WARC record at the start of a member")
        if self.held[self.size :] != b"\r\n\r\n":
            raise ValueError(f"a record of {self.size} bytes is framed by {len(self.held)}")
        found = "sha1:" + base64.b32encode(self.sha.digest()).decode()
        if found != self.said.get("warc-block-digest", found):
            raise ValueError("the block's digest differs")
        r = Record(self.said, bytes(memoryview(self.held)[: self.size]))
        if self.said["warc-type"] == "response" and "warc-payload-digest" in self.said and digest(r.http[1]) != self.said["warc-payload-digest"]:
            raise ValueError("the payload's digest differs")
        return r


def records(chunks: Iterable[bytes]) -> Iterator[Record]:
    """The records of an archive in order. Framing is by Content-Length; block digests, and payload digests of
    responses, are verified; what does not hold is a ValueError. A record is held whole, nothing beyond it."""
    frame = Frame()
    for part, last in inflated(chunks):
        frame.feed(part)
        if last:
            yield frame.record()
            frame = Frame()


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000, archive_bytes: int = 1 << 20) -> DataFrame:
    """(archive binary): all pages as records. Of equal payloads of at least `least` bytes the largest id's is the
    response, others revisit it; ids that are null count as smallest, and repeated rows of the largest id are all
    responses. Null payloads are empty, null addresses are left out; other columns are ignored."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("key", F.when(F.octet_length("payload") >= least, F.sha1("payload")))
    keyed = rows.where(F.col("key").isNotNull())
    first = keyed.groupBy("key").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    total = pages.count()
    out = hot_join(keyed, first, "key", "n", total).select("page_id", "url", "payload", F.when(F.col("page_id").isNull() | (F.col("first") > F.col("page_id")), F.col("first")).alias("refers_to"))
    out = out.unionByName(rows.where(F.col("key").isNull()).select("page_id", "url", "payload", F.lit(None).cast(rows.schema["page_id"].dataType).alias("refers_to")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                held.append(record(*row))
                n += len(held[-1])
                if n >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["archive"])
                    held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["archive"])

    return materialize(out.mapInArrow(write, "archive binary"), "warc")


def read_archives(archives: DataFrame, column: str = "archive", id_type: str = "long", keep_payload: bool = False) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri[, payload]) of every record."""
    whole = id_type in ("tinyint", "smallint", "int", "bigint", "long")
    kind = pa.int64() if whole else pa.string()

    def page(said: str | None) -> int | str | None:
        text = (said or "").removeprefix("<urn:page:").removesuffix(">")
        return (int(text) if whole else text) if text else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                view = memoryview(data.as_buffer())
                out: list[list] = [[] for _ in range(7)]
                for r in records(bytes(view[i : i + STEP]) for i in range(0, len(view), STEP)):
                    http, body = r.http
                    sha = base64.b32decode(r.head["warc-payload-digest"].removeprefix("sha1:")).hex()
                    for a, x in zip(out, (page(r.head["warc-record-id"]), int(http["content-length"]), sha, r.head["warc-type"], page(r.head.get("warc-refers-to")), r.head.get("warc-target-uri"), body if keep_payload else None)):
                        a.append(x)
                kinds = (kind, pa.int64(), pa.string(), pa.string(), kind, pa.string(), pa.binary())[: 6 + keep_payload]
                names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "payload")[: 6 + keep_payload]
                yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(out, kinds)], list(names))

    spark_kind = "long" if whole else "string"
    return archives.select(column).mapInArrow(read, KINDS.format(spark_kind, spark_kind) + ", payload binary" * keep_payload)
