"""WARC archives: a deduplicating writer and a salvage reader.

Each record is a gzip member of its own. The writer hands members to Spark's text sink as they are, with an empty
member for a line end, so files are committed like any table's and may lie in any store Spark writes to. The reader
takes whole files from Spark's binary source. Where a check fails (member, header, length, end, digest) it looks for
the next member or version line from which a valid record can be read, goes on there, and logs the bytes between. It
does so inside members of several records as well, and in what can be decompressed of a broken member.

Scale: payloads are compressed before the one shuffle, which joins them with the digests that occur more than once; a
digest that very many pages share is a skewed join key, which Spark splits. Files hold at most ``file_records``.

Defined cases: a null payload is empty; a null page id is written as null and is never the smallest; rows with the same
id and payload are all responses if theirs is the smallest id; line ends in URLs are percent-encoded; an empty table
gives no records; further columns are not looked at.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EMPTY = gzip.compress(b"", mtime=0)
_HEAD = re.compile(rb"WARC/1\.[01]\r\n((?:[^\r\n]+\r\n)+)\r\n")
_NEXT = re.compile(rb"\x1f\x8b\x08|(?:(?<=\n)|\A)WARC/1\.")
_VERSION = re.compile(rb"(?<=\n)WARC/1\.")
_PAGE = re.compile(r"<urn:page:(-?\d+)>$")


def base32(hex_digest: Column) -> Column:
    """A SHA-1 in hex as upper-case base 32: five hex digits are four of these."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, block: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'null' if page_id is None else page_id}>"), ("WARC-Date", date), ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{_digest(block)}"), ("Content-Type", "application/http; msgtype=response"),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v != "")
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def response_block(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload


def write_archives(pages: DataFrame, path: str, *, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z", level: int = 6, file_records: int = 2000) -> None:
    """Of pages with equal payloads of ``least_bytes`` or more, the one with the smallest id is a response, others revisit it."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    digests = rows.select("page_id", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("bytes")).where(F.col("bytes") >= least_bytes)
    shared = digests.groupBy("sha1", "bytes").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("many")).where("many > 1").drop("many")

    def responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for page_id, url, payload in zip(*[c for c in batch.columns], strict=True):
                payload = payload.as_py()
                page_id, url, sha1 = page_id.as_py(), url.as_py(), hashlib.sha1(payload)
                digest = base64.b32encode(sha1.digest()).decode()
                out.append((page_id, url, sha1.hexdigest(), len(payload), gzip.compress(record("response", page_id, url, response_block(payload), digest, None, date), level, mtime=0)))
                size += len(out[-1][4])
                if size > 8_000_000:
                    yield _batch(out, "page_id url sha1 bytes member")
                    out, size = [], 0
            yield _batch(out, "page_id url sha1 bytes member")

    def revisits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column("member").to_pylist()
            for i, first in enumerate(batch.column("first").to_pylist()):
                if first is not None and first != (page_id := batch.column("page_id")[i].as_py()):
                    digest = base64.b32encode(bytes.fromhex(batch.column("sha1")[i].as_py())).decode()
                    members[i] = gzip.compress(record("revisit", page_id, batch.column("url")[i].as_py(), b"", digest, first, date), level, mtime=0)
            yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], ["member"])

    made = rows.mapInArrow(responses, "page_id long, url string, sha1 string, bytes long, member binary")
    made = made.join(shared.withColumn("bytes", F.col("bytes").cast("long")), ["sha1", "bytes"], "left").mapInArrow(revisits, "member binary")
    made.select(F.col("member").cast("string").alias("value")).write.option("lineSep", _EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", file_records).text(path)


_TYPES = {"page_id": pa.int64(), "url": pa.string(), "sha1": pa.string(), "bytes": pa.int64(), "member": pa.binary(), "path": pa.string(), "kind": pa.string(), "start": pa.int64(), "end": pa.int64(), "note": pa.string(), "type": pa.string(), "refers_to": pa.int64(), "digest": pa.string(), "payload": pa.binary()}


def _batch(rows: list[tuple], names: str) -> pa.RecordBatch:
    names = names.split()
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _TYPES[n]) for i, n in enumerate(names)], names)


def parse_record(data: bytes, at: int) -> tuple[int, dict]:
    """The end of the record that begins there, and what it holds; ValueError says which check failed."""
    if not (m := _HEAD.match(data, at)):
        raise ValueError("header")
    fields = {}
    for line in m[1].decode("utf-8", "replace").split("\r\n")[:-1]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("header")
        fields[name.strip().lower()] = value.strip()
    if not (length := fields.get("content-length", "")).isdigit():
        raise ValueError("length")
    end = m.end() + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("end")
    block = data[m.end() : end]
    if (d := fields.get("warc-block-digest", "")).startswith("sha1:") and d[5:] != _digest(block):
        raise ValueError("block digest")
    head, gap, payload = block.partition(b"\r\n\r\n")
    if fields.get("warc-type") != "response" or not gap or not head.startswith(b"HTTP/"):
        payload = b"" if fields.get("warc-type") == "revisit" else block
    if fields.get("warc-type") == "response" and (d := fields.get("warc-payload-digest", "")).startswith("sha1:") and d[5:] != _digest(payload):
        raise ValueError("payload digest")
    page, refers = (_PAGE.match(fields.get(k, "")) for k in ("warc-record-id", "warc-refers-to"))
    return end + 4, {
        "type": fields.get("warc-type"), "page_id": int(page[1]) if page else None, "url": fields.get("warc-target-uri"), "payload": payload,
        "digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, "refers_to": int(refers[1]) if refers else None,
    }


def _member(data: bytes, at: int) -> tuple[int, bytes, bool]:
    """Where a gzip member ends, what it holds, and whether it's whole; of a broken one, all that can be decompressed."""
    d, parts, fed = zlib.decompressobj(31), [], at
    while not d.eof and fed < len(data):
        try:
            parts.append(d.decompress(data[fed : fed + 65536]))
        except zlib.error:
            d = zlib.decompressobj(31)  # an error drops what its call has decompressed: again, byte by byte
            parts = [d.decompress(data[at:fed])]
            try:
                while True:
                    parts.append(d.decompress(data[fed : fed + 1]))
                    fed += 1
            except zlib.error:
                return fed, b"".join(parts), False
        fed = min(fed + 65536, len(data))
    return fed - len(d.unused_data), b"".join(parts), d.eof


def _inside(plain: bytes) -> Iterator[tuple[str, int, int, object]]:
    """Over the bytes of a member: records and gaps, as salvage() has them."""
    at, bad, why = 0, None, ""
    while at < len(plain):
        try:
            end, fields = parse_record(plain, at)
        except ValueError as e:
            bad, why = (at, str(e)) if bad is None else (bad, why)
            m = _VERSION.search(plain, at + 1)
            at = m.start() if m else len(plain)
            continue
        if bad is not None:
            yield "gap", bad, at, why
            bad = None
        yield "record", at, end, fields
        at = end
    if bad is not None:
        yield "gap", bad, len(plain), why


def salvage(data: bytes) -> Iterator[tuple[str, int, int, object]]:
    """Over an archive: ("record", start, end, fields) and ("gap", start, end, the first check that failed there).

    Records of a member all have the member's start and end. A gap inside a member from which records come has them
    too, and its note ends with the gap's offsets in the decompressed bytes.
    """
    at, bad, why = 0, None, ""
    while at < len(data):
        whole = True
        try:
            if data.startswith(b"\x1f\x8b\x08", at):
                end, plain, whole = _member(data, at)
                found = list(_inside(plain))
                if not whole and (not found or found[-1][0] == "record"):
                    found.append(("gap", len(plain), len(plain), "member"))
                if found and not any(kind == "record" for kind, *_ in found):
                    raise ValueError(found[0][3] if whole else "member")
            elif data.startswith(b"WARC/1.", at):
                end, fields = parse_record(data, at)
                found = [("record", at, end, fields)]
            else:
                raise ValueError("no record")
        except ValueError as e:
            bad, why = (at, str(e)) if bad is None else (bad, why)
            m = _NEXT.search(data, at + 1)
            at = m.start() if m else len(data)
            continue
        if bad is not None:
            yield "gap", bad, at, why
            bad = None
        for kind, lo, hi, x in found:
            yield kind, at, end, x if kind == "record" else f"{x} at {lo} to {hi} of the member"
        if whole:
            at = end
            continue
        # the next record may begin before the byte that decompression failed at; stored version lines have been read
        nexts, read = _NEXT.finditer(data, at + 1), 0
        at = len(data)
        for m in nexts:
            if m.start() >= end or data[m.start()] == 0x1F or (i := plain.find(data[m.start() : min(m.start() + 512, end)], read)) < 0:
                at = m.start()
                break
            read = i + 1
        if at > end:
            bad, why = end, "member"
    if bad is not None:
        yield "gap", bad, len(data), why


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps: path, kind (record or gap), start, end, note (of a gap), type, page_id, url, payload, digest, refers_to."""
    names = "path kind start end note type page_id url payload digest refers_to"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                file, rows, size = batch.column(0)[i].as_py(), [], 0
                for kind, start, end, x in salvage(batch.column(1)[i].as_py()):
                    f = x if kind == "record" else {}
                    rows.append((file, kind, start, end, None if f else x, *[f.get(k) for k in names.split()[5:]]))
                    size += len(f.get("payload") or b"")
                    if size > 8_000_000:
                        yield _batch(rows, names)
                        rows, size = [], 0
                yield _batch(rows, names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, kind string, start long, end long, note string, type string, page_id long, url string, payload binary, digest string, refers_to long")


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; of revisits, the size is that of the response they refer to."""
    own = records.where("kind = 'record'").select(
        "page_id", F.octet_length("payload").cast("long").alias("bytes"), F.when(F.col("type") == "response", base32(F.sha1("payload"))).otherwise(F.col("digest")).alias("payload_digest"), F.col("type").alias("record_type"), "refers_to",
    )
    own = written(own, "records")  # archives are read and parsed once
    revisits, responses = own.where("record_type = 'revisit'"), own.where("record_type <> 'revisit'")
    sizes = responses.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("bytes").alias("payload_bytes"))
    revisits = revisits.drop("bytes").join(sizes, ["refers_to", "payload_digest"], "left")
    return responses.withColumnRenamed("bytes", "payload_bytes").unionByName(revisits)
