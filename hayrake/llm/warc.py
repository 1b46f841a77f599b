"""WARC archives: writing through Spark's text sink, and a reader that salvages damaged files.

Files are gzip members one after another.  Every record is one member with its header and block, and the blank lines
that end a record are a member of their own, always the same 24 bytes.  That member serves as the line
separator of the text sink, so Spark's commit protocol writes the archives on any file system, and the
decompressed file is plain WARC/1.1.

The reader takes records from gzip members or from plain text.  Where a check fails (member CRC, header syntax,
length, digest) it moves on to the next place where a whole valid member or record starts, and reports
the bytes in between as a quarantined gap.  Of a member that fails, the records that hold on their own are kept: all that
parse where the member's CRC holds, else those with a SHA-256 block digest that fits.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import passing, prepare, stage_path, store, table

#: Smaller payloads are always stored whole.
LEAST_SHARED = 100
DATE = "1970-01-01T00:00:00Z"
ID = "urn:hayrake:page:"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: The member that ends every record.
END = gzip.compress(b"\r\n\r\n", mtime=0)
#: Records go to the sink in bundles of about so many compressed bytes, and so many bundles make a file: archives of 64 MB at most,
#: but for single records larger than a bundle.
BUNDLE, FILE_BUNDLES = 1 << 20, 64
_PIECE = 1 << 14

_START = re.compile(rb"\x1f\x8b\x08|WARC/\d+\.\d")
_VERSION = re.compile(rb"WARC/\d+\.\d")
#: A version line, then fields; a line that starts with white space goes on with the field before it.
_HEAD = re.compile(rb"WARC/\d+\.\d+\r\n((?:[!-9;-~]+:[^\r\n]*\r\n(?:[ \t][^\r\n]*\r\n)*)+)\r\n")
_FOLD = re.compile(rb"\r\n[ \t]+")
#: The mark of a record that no check of its bytes covers.
UNVERIFIED = "unverified"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_RECORD = (
    "file string, kind string, first bigint, past bigint, reason string, page_id bigint, url string, "
    "record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"
)


# ---------------------------------------------------------------- writing


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, first: bool) -> bytes:
    """One WARC record without its closing blank lines; a revisit has no payload."""
    block = HTTP + payload if first else HTTP
    name = "" if page_id is None else str(page_id)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first else 'revisit'}",
        f"WARC-Record-ID: <{ID}{name}>",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(4, "WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if not first:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{ID}{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block


def write_archives(pages: DataFrame, path: str, least: int = LEAST_SHARED, level: int = 3) -> str:
    """Write a record per row of (page_id, url, html) as compressed archives under ``path``.

    The payload is the html in UTF-8, a null one empty.  Of rows with equal payloads of at least ``least`` bytes, the
    smallest page_id holds the response, the others are revisits of it; rows that repeat that smallest
    page_id, rows without page_id and smaller payloads are responses.  Only digests that occur more than once
    are joined back; the pages move over the network only if those are too many to broadcast.
    """
    prepare(pages.sparkSession)
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    own = own.withColumn("digest", F.sha2("payload", 256))
    shared = (
        own.where((F.length("payload") >= least) & F.col("page_id").isNotNull())
        .groupBy("digest")
        .agg(F.min("page_id").alias("holder"), F.max("page_id").alias("latest"))
        .where("holder < latest")
        .select("digest", "holder")
    )
    shared, _ = store(shared, "warc-shared")
    joined = own.join(shared, "digest", "left").select("page_id", "url", "payload", "digest", "holder")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def bundle() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([END.join(held)], pa.binary())], names=["member"])

        for b in batches:
            for lo in range(0, b.num_rows, 200):
                for page_id, url, body, digest, holder in zip(*(c.to_pylist() for c in b.slice(lo, 200).columns), strict=True):
                    first = holder is None or page_id is None or page_id <= holder
                    held.append(gzip.compress(record(page_id, url, body, digest, holder, first), level, mtime=0))
                    size += len(held[-1])
                    if size >= BUNDLE:
                        yield bundle()
                        held, size = [], 0
        if held:
            yield bundle()

    members = joined.mapInArrow(run, "member binary").select(F.col("member").cast("string").alias("value"))
    (
        members.write.option("lineSep", END.decode("latin-1"))
        .option("encoding", "ISO-8859-1")
        .option("maxRecordsPerFile", FILE_BUNDLES)
        .text(path)
    )
    return path


# ---------------------------------------------------------------- reading


class Bad(ValueError):
    """A check that failed."""


def fits(want: str, data: bytes) -> bool | None:
    """Whether data has the digest ``algorithm:value``, the value in hex or base 32; None where there is none or it is of another kind."""
    name, _, value = want.partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("sha1", "sha256", "sha512", "md5") or not value.strip():
        return None
    digest, value = hashlib.new(name, data).digest(), value.strip()
    return value.lower() == digest.hex() or value.rstrip("=").upper() == base64.b32encode(digest).decode().rstrip("=")


def parse(data: bytes, at: int, closed: bool) -> tuple[dict, bytes, int]:
    """The record that starts at ``at``: fields, block, and where it ends.  closed: blank lines must follow."""
    m = _HEAD.match(data, at)
    if not m:
        raise Bad("header")
    fields: dict[str, str] = {}
    for line in _FOLD.sub(b" ", m[1]).split(b"\r\n")[:-1]:
        k, _, v = line.partition(b":")
        fields[k.decode("ascii").lower()] = v.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
        raise Bad("header")
    end = m.end() + int(fields["content-length"])
    block = data[m.end() : end]
    if end > len(data):
        raise Bad("length")
    if fits(fields.get("warc-block-digest", ""), block) is False:
        raise Bad("digest")
    if fields["warc-type"] == "response" and fits(fields.get("warc-payload-digest", ""), block.partition(b"\r\n\r\n")[2]) is False:
        raise Bad("payload")
    if data.startswith(b"\r\n\r\n", end):
        end += 4
    elif closed:
        raise Bad("end")
    return fields, block, end


def _member(data: bytes, at: int) -> tuple[bytes, int]:
    if data.startswith(END, at):
        return b"", at + len(END)
    unzip, parts = zlib.decompressobj(31), []
    try:
        while not unzip.eof and at < len(data):  # by pieces: zlib copies what it leaves unused
            parts.append(unzip.decompress(data[at : at + _PIECE]))
            at = min(at + _PIECE, len(data))
    except zlib.error as e:
        raise Bad("member") from e
    if not unzip.eof:
        raise Bad("member")
    return b"".join(parts), at - len(unzip.unused_data)


def _unit(data: bytes, at: int) -> tuple[list[tuple[dict, bytes]], int]:
    """All records of the member or plain record at ``at``, if every check holds."""
    if data.startswith(b"\x1f\x8b\x08", at):
        content, end = _member(data, at)
        found, k = [], 0
        while k < len(content):
            if content.startswith(b"\r\n", k):
                k += 2
                continue
            fields, block, k = parse(content, k, closed=False)
            found.append((fields, block))
        return found, end
    fields, block, end = parse(data, at, closed=True)
    return [(fields, block)], end


def _inflated(data: bytes, at: int) -> tuple[bytes, int | None]:
    """What a gzip member gives up to its first error, and where it ends if its CRC holds."""
    unzip, parts = zlib.decompressobj(31), []
    while not unzip.eof and at < len(data):
        before, piece = unzip.copy(), data[at : at + _PIECE]
        try:
            parts.append(unzip.decompress(piece))
        except zlib.error:  # a call that fails gives nothing, so the last piece goes byte by byte
            try:
                for k in range(len(piece)):
                    parts.append(before.decompress(piece[k : k + 1]))
            except zlib.error:
                pass
            return b"".join(parts), None
        at += len(piece)
    return b"".join(parts), at - len(unzip.unused_data) if unzip.eof else None


def _without_trailer(data: bytes, at: int) -> int | None:
    """Where the data of the gzip member at ``at`` end, if they are whole and less than a trailer follows them."""
    flags, k = data[at + 3] if at + 3 < len(data) else 0, at + 10
    if flags & 4:
        k += 2 + int.from_bytes(data[k : k + 2], "little")
    for flag in (8, 16):
        if flags & flag:
            k = data.find(b"\0", k) + 1 or len(data)
    k += 2 if flags & 2 else 0
    unzip = zlib.decompressobj(-15)
    try:
        while not unzip.eof and k < len(data):
            unzip.decompress(data[k : k + _PIECE])
            k = min(k + _PIECE, len(data))
    except zlib.error:
        return None
    end = k - len(unzip.unused_data)
    return end if unzip.eof and (len(data) - end < 8 or _START.search(data, end, end + 11)) else None


def _consumed(data: bytes, at: int, size: int) -> int:
    """Where the compressed bytes of the first ``size`` bytes of a member's content end, but for the last byte: no check behind it is run."""
    unzip, size = zlib.decompressobj(31), size - 1
    while size:
        piece = data[at : at + _PIECE]
        while piece and size:
            size -= len(unzip.decompress(piece, size))
            at += len(piece) - len(unzip.unconsumed_tail)
            piece = unzip.unconsumed_tail
    return at


def _kept(content: bytes, sure: bool, torn: bool) -> tuple[list[tuple[dict, bytes, str]], int, str]:
    """Records of a member's content that hold, where the last one ends, and the reason of the first that does not (not sure: before that end).

    Without the member's CRC a record holds by its own digest; where only the trailer is missing (torn), also by its length and the
    blank lines behind it, with the mark UNVERIFIED.
    """
    found, past, reason, inside, k, lost = [], 0, "", "", 0, False
    while k < len(content):
        if content.startswith(b"\r\n", k):
            k += 2
            continue
        try:
            fields, block, end = parse(content, k, closed=False)
            closed = content[end - 4 : end] == b"\r\n\r\n"
            mark = "" if sure or _checked(fields, block) else UNVERIFIED
            if mark and not (torn and closed):
                raise Bad("member")
            if lost and end < len(content) and not closed:
                raise Bad("end")
        except Bad as e:
            reason, lost = reason or str(e), True
            m = _VERSION.search(content, k + 1)
            k = m.start() if m else len(content)
            continue
        found.append((fields, block, mark))
        past = k = end
        lost, inside = False, reason
    return found, past, reason if sure else inside


def _checked(fields: dict, block: bytes) -> bool:
    """Whether a digest covers the whole block."""
    return bool(fits(fields.get("warc-block-digest", ""), block))


def salvage(data: bytes) -> Iterator[tuple[str, int, int, str, dict, bytes]]:
    """(kind, first, past, reason, fields, block) of all records and gaps of an archive, in order."""
    at, gap, reason = 0, None, ""
    while at < len(data):
        if gap is None and data.startswith(b"\r\n", at):
            at += 2
            continue
        try:
            if not _START.match(data, at):
                raise Bad("start")
            found, end = _unit(data, at)
        except Bad as e:
            packed = data.startswith(b"\x1f\x8b\x08", at)
            inner, sure = _inflated(data, at) if packed else (b"", None)
            whole = _without_trailer(data, at) if packed and sure is None else None
            found, past, why = _kept(inner, sure is not None, whole is not None)
            if found:
                if gap is not None:
                    yield "gap", gap, at, reason, {}, b""
                end = sure or whole or _consumed(data, at, past)
                for fields, block, mark in found:
                    yield "record", at, end, mark, fields, block
                if why:
                    yield "gap", at, end, why, {}, b""
                at, gap, reason = end, None if sure else end, str(e)
                if sure or _START.match(data, at):
                    continue
            elif gap is None:
                gap, reason = at, str(e)
            m = _START.search(data, at + 1)
            at = m.start() if m else len(data)
            continue
        if gap is not None:
            yield "gap", gap, at, reason, {}, b""
            gap = None
        for fields, block in found:
            yield "record", at, end, "", fields, block
        at = end
    if gap is not None and gap < len(data):
        yield "gap", gap, len(data), reason, {}, b""


def _page(name: str) -> int | None:
    m = re.fullmatch(rf"<{ID}(-?\d+)>", name)
    return int(m[1]) if m else None


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Records and gaps of all archives under ``path``; kind tells them apart.

    ``payload_digest`` and ``payload_bytes`` of a response are computed from what was read; a response whose payload does
    not fit its header is a gap with reason ``payload``.  SHA-1, SHA-256, SHA-512 and MD5 digests in hex or base 32 are checked; records
    of a member that lost its trailer and that have no digest of their own come with reason ``unverified``.  A revisit carries both in its header.  Files are read
    one at a time, whatever their names, those of folders below too, but not hidden ones (``.`` or ``_`` first); a folder
    without files gives no rows.
    """
    prepare(spark)
    fields = _RECORD.split(", ")
    schema = ", ".join(fields if with_payload else fields[:-1])
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    types = [kinds[f.split()[1]] for f in schema.split(", ")]

    def rows(file: str, data: bytes) -> Iterator[list]:
        for kind, first, past, reason, head, block in salvage(data):
            if kind == "gap":
                yield [file, kind, first, past, reason, *[None] * (len(names) - 5)]
                continue
            digest, size, body = head.get("warc-payload-digest", "").partition(":")[2], head.get("warc-payload-length"), None
            if head["warc-type"] == "response":
                body = block.partition(b"\r\n\r\n")[2]
                digest, size = hashlib.sha256(body).hexdigest(), len(body)
            page, other = _page(head.get("warc-record-id", "")), _page(head.get("warc-refers-to", ""))
            row = [file, kind, first, past, reason or None, page, head.get("warc-target-uri"), head["warc-type"], int(size or 0), digest, other]
            yield row + [body] * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                held: list[list] = []
                for row in rows(b.column(0)[k].as_py(), b.column(1)[k].as_py()):
                    held.append(row)
                    if len(held) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, schema)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back: page_id, payload size and digest, record type, holder of the payload.

    Null and empty html are empty payloads; repeated rows are records of their own; of equal payloads the smallest page_id holds
    the response, rows that repeat it are responses too; null page_ids are responses; an empty table gives an empty result.
    """
    path = passing(spark, write_archives(table(spark, sf_dir, "pages"), stage_path(spark, "warc")))
    found = read_archives(spark, path).where("kind = 'record'")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha256(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS holder FROM p)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN strlen(body) >= {LEAST_SHARED} AND page_id > holder THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(body) >= {LEAST_SHARED} AND page_id > holder THEN holder END AS refers_to
FROM m
"""
