"""WARC files: a writer, and a reader that salvages damaged files.

After a record that fails a check the reader looks for the next place where a
valid one begins: a version line whose record is whole, in a plain file, in the
bytes of a gzip member, or in what a cut or corrupt member gave before its error;
after such a member also the next member. What lies between is quarantined and
logged as a gap, and every later record is recovered.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.llm.common import read, small_batches

_MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_VERSION_LINE = re.compile(rb"\r\nWARC/1\.[01]\r\n")
BLOB_BYTES = 4 << 20


def record(fields: dict[str, str], block: bytes) -> bytes:
    """One record, uncompressed, with the digest of its block."""
    digest = "sha1:" + hashlib.sha1(block, usedforsecurity=False).hexdigest()
    lines = [f"{k}: {v}" for k, v in fields.items()] + [f"WARC-Block-Digest: {digest}", f"Content-Length: {len(block)}"]
    return ("WARC/1.0\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def page_record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """A page as a response record; a null page_id, url or html is a header that is not there, or no body."""
    fields = {"WARC-Type": "response", "WARC-Date": "2024-01-01T00:00:00Z", "WARC-Record-ID": f"<urn:loupe:{page_id}>", "Content-Type": "application/http; msgtype=response"}
    if url is not None:
        fields["WARC-Target-URI"] = url.replace("\r", "%0D").replace("\n", "%0A")
    if page_id is not None:
        fields["X-Page-Id"] = str(page_id)
    if html is None:
        fields["X-No-Body"] = "1"
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    return record(fields, head + (html or "").encode("utf-8", "surrogatepass"))


@dataclass
class Found:
    """A record (fields and block), or with fields None a gap, of the bytes from start to end.

    What is in a gzip member has the member's start and end, and its own place
    in the inflated bytes as inner_start and inner_end; block is then also set for a gap.
    """

    start: int
    end: int
    fields: dict[str, str] | None = None
    block: bytes = b""
    reason: str = ""
    inner_start: int | None = None
    inner_end: int | None = None


def _parse(raw: bytes | memoryview, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """The record at a place and where it ends; ValueError with the check that fails."""
    data = raw
    m = _VERSION.match(data, at)
    if not m:
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n", m.end() - 2)
    if end < 0:
        raise ValueError("no end of header")
    if _VERSION_LINE.search(data, m.end() - 2, end + 2):  # the header is cut, and another record begins
        raise ValueError("bad header line")
    if inner := _VERSION.search(data, m.end(), end + 2):  # also where it is cut within a line, if a whole record follows
        try:
            _parse(data, inner.start())
        except ValueError:
            pass
        else:
            raise ValueError("bad header line")
    fields = {}
    for line in data[m.end() : end].split(b"\r\n"):
        k, sep, v = line.partition(b":")
        if line and not sep:
            raise ValueError("bad header line")
        fields[k.strip().decode("utf-8", "replace")] = v.strip().decode("utf-8", "replace")
    low = {k.lower(): v for k, v in fields.items()}
    size = low.get("content-length", "")
    if not size.isdigit():
        raise ValueError("bad content length")
    block = data[end + 4 : end + 4 + int(size)]
    after = end + 4 + int(size)
    if len(block) < int(size) or data[after : after + 4] != b"\r\n\r\n":
        raise ValueError("record is cut or too long")
    digest = low.get("warc-block-digest", "")
    if digest.startswith("sha1:") and len(digest) == 45 and hashlib.sha1(block, usedforsecurity=False).hexdigest() != digest[5:].lower():
        raise ValueError("digest differs")
    return fields, block, after + 4


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What a member gives, where it ends, and the check that fails; then it ends with its last good byte."""
    z = zlib.decompressobj(31)
    view = memoryview(data)
    out, i = [], at
    while not z.eof:
        part = view[i : i + 16384]
        if not len(part):
            return b"".join(out), i, "member is cut"
        before = z.copy()
        try:
            out.append(z.decompress(part))
        except zlib.error:
            break
        i += len(part)
    else:
        return b"".join(out), i - len(z.unused_data), ""
    z, step = before, 8192  # an error takes all that its call would have given: the good bytes by halves, then what the bad one gives
    while step:
        part, trial = view[i : i + step], z.copy()
        try:
            out.append(trial.decompress(part))
            z, i = trial, i + len(part)
        except zlib.error:
            pass
        step //= 2
    feed: bytes | memoryview = view[i : i + 1]
    try:
        while got := z.decompress(feed, 1):
            out.append(got)
            feed = z.unconsumed_tail
    except zlib.error:
        pass
    return b"".join(out), i, "bad gzip member"


def _records(raw: bytes, corrupt: bool) -> list[Found]:
    """The whole records of a member's bytes and the gaps between them, by their inner places.

    Of corrupt bytes only blocks with a digest are known to be whole; their headers are not, which is given as reason.
    """
    found, at, gap, reason = [], 0, None, ""
    while at < len(raw):
        try:
            fields, block, end = _parse(raw, at)
            if corrupt and not any(k.lower() == "warc-block-digest" and v.startswith("sha1:") and len(v) == 45 for k, v in fields.items()):
                raise ValueError("no digest in a bad member")
        except ValueError as e:
            if gap is None:
                gap, reason = at, str(e)
            m = _VERSION.search(raw, at + 1)
            at = m.start() if m else len(raw)
            continue
        if gap is not None:
            found.append(Found(0, 0, None, raw[gap:at], reason, gap, at))
            gap = None
        found.append(Found(0, 0, fields, block, "header not verified" if corrupt else "", at, end))
        at = end
    if gap is not None:
        found.append(Found(0, 0, None, raw[gap:], reason, gap, len(raw)))
    return found


def _member_at(data: bytes, at: int) -> tuple[list[Found], int, str]:
    """The records and gaps of a member up to where it ends; of a broken one up to its last whole record."""
    raw, end, error = _inflate(data, at)
    corrupt = error == "bad gzip member"
    found = _records(raw, corrupt)
    if not any(f.fields is not None for f in found) or corrupt and len(found) == 1:  # a single record's damage is in its header
        return [], end, error or (found[0].reason if found else "empty member")
    if error:
        while found[-1].fields is None:
            found.pop()
        z = zlib.decompressobj(31)
        z.decompress(memoryview(data)[at:end], found[-1].inner_end)
        end -= len(z.unconsumed_tail)
    for f in found:
        f.start, f.end = at, end
    return found, end, error


def _next_start(data: bytes, at: int) -> int:
    a = data.find(_MAGIC, at)
    m = _VERSION.search(data, at)
    return min(a if a >= 0 else len(data), m.start() if m else len(data))


def salvage(data: bytes) -> Iterator[Found]:
    """All whole records of a file in order, compressed or plain, and the gaps between them.

    Every byte is in one gap or one record, or in a member with records; every inflated
    byte of such a member, up to the last record if it is broken, is in one record or one
    gap as well. An empty file has neither.
    """
    at, gap, reason = 0, None, ""
    while at < len(data):
        if data[at : at + 3] == _MAGIC:
            found, end, error = _member_at(data, at)
            if not found:
                if gap is None:
                    gap, reason = at, error
                at = _next_start(data, at + 1)
                continue
        else:
            try:
                fields, block, end = _parse(data, at)
            except ValueError as e:
                if gap is None:
                    gap, reason = at, str(e)
                at = _next_start(data, at + 1)
                continue
            found, error = [Found(at, end, fields, block)], ""
        if gap is not None and gap < at:
            yield Found(gap, at, reason=reason)
        gap = None
        yield from found
        at = end
        if error and at < len(data):
            gap, reason = at, error
            at = _next_start(data, at)
    if gap is not None:
        yield Found(gap, len(data), reason=reason)


_SCHEMA = "file string, kind string, start long, end long, inner_start long, inner_end long, reason string, warc_type string, url string, page_id long, fields map<string,string>, block binary"


def _salvage_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
    names = ["file", "kind", "start", "end", "inner_start", "inner_end", "reason", "warc_type", "url", "page_id", "fields", "block"]

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    for b in batches:
        for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            rows, size, blob = [], 0, data.as_py() or b""
            for f in salvage(blob):
                at = (f.start, f.end, f.inner_start, f.inner_end)
                if f.fields is None:
                    rows.append((name, "gap", *at, f.reason, None, None, None, None, blob[f.start : f.end] if f.inner_start is None else f.block))
                else:
                    low = {k.lower(): v for k, v in f.fields.items()}
                    page = low.get("x-page-id", "")
                    rows.append((name, "record", *at, f.reason or None, low.get("warc-type"), low.get("warc-target-uri"), int(page) if page.lstrip("-").isdigit() else None, list(f.fields.items()), f.block))
                size += len(rows[-1][-1])
                if size > BLOB_BYTES:
                    yield flush(rows)
                    rows, size = [], 0
            if rows:
                yield flush(rows)


def salvage_blobs(blobs: DataFrame) -> DataFrame:
    """Records and gaps of blobs (file, data). kind is record or gap; a record has a reason only if it is whole by its digest in a member that is corrupt, so that its header may be wrong; block is the record's block or the quarantined bytes; start and end are byte offsets in the (compressed) file, inner_start and inner_end in the inflated bytes of a member with records. Null and empty data give no rows. Batches end by bytes; a file is in memory whole, at most 2 GB."""
    small_batches(blobs.sparkSession)
    return blobs.select(F.col("file").cast("string"), F.col("data").cast("binary")).mapInArrow(_salvage_batches, _SCHEMA)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """salvage_blobs of the files of a path, one task a file of up to 2 GB."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return salvage_blobs(files.select(F.col("path").alias("file"), F.col("content").alias("data")))


def _damaged(raw: bytes, kind: str) -> bytes:
    """A broken write of a record: its member cut or with a wrong byte, or whole members of a record with a wrong body, digest or header."""
    m = bytearray(member(raw))
    head = raw.index(b"\r\n\r\n") + 4
    if kind == "cut":
        return bytes(m[: len(m) // 2])
    if kind == "stream":
        m[len(m) // 2] ^= 0xFF
        return bytes(m)
    if kind == "body":
        return member(raw[:head] + bytes([raw[head] ^ 1]) + raw[head + 1 :])
    if kind == "digest":
        at = raw.index(b"WARC-Block-Digest: sha1:") + 24
        return member(raw[:at] + (b"1" if raw[at : at + 1] == b"0" else b"0") + raw[at + 1 :])
    return member(raw[: head - 4].replace(b"Content-Length: ", b"Content-Length: ?") + raw[head - 4 :])


DAMAGE = ("cut", "stream", "body", "digest", "header")


def pages_to_warc(pages: DataFrame, junk_every: int = 0, damage: tuple[str, ...] = ("cut",), shared: bool = False) -> DataFrame:
    """(file, data) blobs of about 4 MB of gzip members from pages (page_id, url, html).

    junk_every: before each page whose place in its blob is a multiple, a broken
    write of it stands as well, of the kinds of damage in turn; the whole member
    follows. With shared, every other round of the kinds within a member (all but
    cut and stream) leaves both in one member. Null columns are kept apart from
    empty ones.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        size = done = 0
        first = None

        def blob() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"pages-{first}.warc.gz"]), pa.array([b"".join(parts)], pa.binary())], ["file", "data"])

        for b in batches:
            for page_id, url, html in zip(*[c.to_pylist() for c in b.columns], strict=True):
                raw = page_record(page_id, url, html)
                m = member(raw)
                if junk_every and done % junk_every == 0:
                    turn, k = divmod(done // junk_every, len(damage))
                    bad = _damaged(raw, damage[k])
                    if shared and turn % 2 and damage[k] not in ("cut", "stream"):
                        m = member(zlib.decompress(bad, 31) + raw)
                    else:
                        parts.append(bad)
                first = page_id if first is None else first
                parts.append(m)
                done += 1
                size += len(m)
                if size > BLOB_BYTES:
                    yield blob()
                    parts, size, done, first = [], 0, 0, None
        if parts:
            yield blob()

    return pages.select("page_id", "url", "html").mapInArrow(run, "file string, data binary")


def pages_from_warc(found: DataFrame) -> DataFrame:
    """(page_id, url, html) of the response records of salvage_blobs."""
    head = F.locate("\r\n\r\n", F.col("block").cast("string"))
    html = F.when(F.col("fields")["X-No-Body"].isNull(), F.substring(F.col("block").cast("string"), head + 4, F.length("block")))
    return found.where("kind = 'record' and warc_type = 'response'").select("page_id", "url", html.alias("html"))


def op7_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, out of WARC blobs in which broken half records stand among the whole ones."""
    return pages_from_warc(salvage_blobs(pages_to_warc(read(spark, sf_dir, "pages"), junk_every=16)))


def op7_warc_salvage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record and every gap of such blobs, with all kinds of damage: places, reasons, and pages or quarantined bytes."""
    found = salvage_blobs(pages_to_warc(read(spark, sf_dir, "pages"), junk_every=16, damage=DAMAGE, shared=True))
    body = F.locate("\r\n\r\n", F.col("block").cast("string"))
    html = F.when((F.col("kind") == "record") & F.col("fields")["X-No-Body"].isNull(), F.substring(F.col("block").cast("string"), body + 4, F.length("block")))
    quarantined = F.when(F.col("kind") == "gap", F.col("block"))
    return found.select("file", "kind", "start", "end", "inner_start", "inner_end", "reason", "page_id", "url", html.alias("html"), quarantined.alias("quarantined"))


OP7_SQL = "select page_id, url, html from pages"
