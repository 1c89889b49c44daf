"""Cases that only the whole job gets right."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest

from loupe.llm import queries, simhash, warc
from loupe.llm.common import read


@pytest.mark.parametrize("longest", [simhash.LONGEST, 5])
def test_every_pair_within_the_bits_is_joined(spark, longest):
    rng, n = np.random.default_rng(7), 3000
    a = rng.integers(0, 256, (n, simhash.BYTES), np.uint8)
    flip = np.zeros((n, simhash.BYTES), np.uint8)
    for row in flip:  # each bit in a byte of its own: two bytes are left
        row[rng.choice(simhash.BYTES, simhash.MAX_BITS, replace=False)] = 1 << rng.integers(0, 8)
    b = a ^ flip
    far = b.copy()
    far[:, 0] ^= 0xFF  # 36 bits where byte 0 had one, else 38
    rows = [(i + k * n, bytes(x)) for k, sig in enumerate((a, b)) for i, x in enumerate(sig)]
    got = {tuple(sorted((r["a"], r["b"]))) for r in simhash.near_edges(spark.createDataFrame(rows, "id long, sig binary"), longest=longest).collect()}
    assert got == {(i, i + n) for i in range(n)}
    rows = [(i + k * 40, bytes(x)) for k, sig in enumerate((a[:40], far[:40])) for i, x in enumerate(sig)]
    assert simhash.near_edges(spark.createDataFrame(rows, "id long, sig binary"), longest=longest).count() == 0


def pages_of(data: bytes) -> list[str]:
    return [f.fields["X-Page-Id"] for f in warc.salvage(data) if f.fields]


def test_whole_records_of_a_damaged_member():
    rng = np.random.default_rng(3)
    raw = [warc.page_record(i, f"http://a/{i}", rng.bytes(3000).hex()) for i in range(12)]
    bad = raw[1].replace(b"sha1:", b"sha1:0", 1)[: len(raw[1]) + 1].replace(b"Content-Length", b"Content_Length", 1)
    digest = raw[2].replace(b"\r\n\r\n", b"\r\n\r\n!", 1).replace(b"HTTP", b"HTT", 1)
    one = warc.member(raw[0] + bad + digest + raw[3] + b"tail")
    found = list(warc.salvage(one))
    assert [f.fields["X-Page-Id"] if f.fields else f.reason for f in found] == ["0", "bad content length", "3", "no version line"]
    assert all((f.start, f.end) == (0, len(one)) for f in found)
    assert [f.inner_end for f in found[:-1]] == [f.inner_start for f in found[1:]] and found[1].block == bad + digest
    packed, sizes = warc.member(b"".join(raw)), np.cumsum([len(r) for r in raw])
    for at in range(20, len(packed), 997):
        inflated = len(zlib.decompressobj(31).decompress(packed[:at]))
        whole = [str(i) for i in np.flatnonzero(sizes <= inflated)]
        assert pages_of(packed[:at]) == whole  # cut
        assert pages_of(packed[:at] + warc.member(raw[0])) == [*whole, "0"]
        flipped = bytearray(packed)
        flipped[at] ^= 0x55
        got = pages_of(bytes(flipped))
        assert set(whole) <= set(got)  # and those after the flip where the stream goes on
        found = list(warc.salvage(bytes(flipped) + raw[5]))
        spans = list(dict.fromkeys((f.start, f.end) for f in found))
        assert found[-1].fields["X-Page-Id"] == "5" and spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_long_headers_are_read():
    raw = [warc.page_record(1, "http://a/" + "x" * (2 << 20), "one"), warc.page_record(2, "http://a/2", "two")]
    assert pages_of(b"".join(raw)) == pages_of(warc.member(raw[0]) + warc.member(raw[1])) == ["1", "2"]
    assert pages_of(raw[0][:1000] + b"\r\n" + raw[1]) == ["2"]


def whole_records(raw: bytes) -> list[tuple[int, int]]:
    """By brute force: the places of records whose length and digest are right, tried at every version line."""
    out = []
    for at in range(len(raw)):
        m = re.match(rb"WARC/1\.0\r\n((?:[^\r\n]+: [^\r\n]*\r\n)*)WARC-Block-Digest: sha1:([0-9a-f]{40})\r\nContent-Length: (\d+)\r\n\r\n", raw[at:]) if raw[at : at + 8] == b"WARC/1.0" else None
        if m and (not out or at >= out[-1][1]):
            block = raw[at + m.end() : at + m.end() + int(m[3])]
            if hashlib.sha1(block).hexdigest().encode() == m[2] and raw[at + m.end() + len(block) :][:4] == b"\r\n\r\n":
                out.append((at, at + m.end() + len(block) + 4))
    return out


def gaps(whole: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    edges = [0, *[x for span in whole for x in span], size]
    return [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if a < b]


def test_log_of_salvage_has_every_gap_and_page(spark):
    sf = "/root/testdata/sf0.01"
    pages = read(spark, sf, "pages")
    blobs = {r["file"]: bytes(r["data"]) for r in warc.pages_to_warc(pages, junk_every=16, damage=warc.DAMAGE, shared=True).collect()}
    want = set()
    for name, data in blobs.items():
        members = []
        for at in range(len(data)):
            if data[at : at + 3] == b"\x1f\x8b\x08":
                z = zlib.decompressobj(31)
                try:
                    raw = z.decompress(data[at:])
                except zlib.error:
                    continue
                if z.eof and whole_records(raw):
                    members.append((at, len(data) - len(z.unused_data)))
                    want |= {(name, *members[-1], a, b, raw[a:b]) for a, b in gaps(whole_records(raw), len(raw))}
        want |= {(name, a, b, None, None, data[a:b]) for a, b in gaps(members, len(data))}
    rows = queries.QUERIES["op7_warc_salvage_log"](spark, sf).collect()
    got = [(r["file"], r["start"], r["end"], r["inner_start"], r["inner_end"], bytes(r["quarantined"])) for r in rows if r["kind"] == "gap"]
    assert len(got) == len(set(got)) and set(got) == want and any(g[3] is not None for g in got)
    reasons = {r["reason"] for r in rows if r["kind"] == "gap"}
    assert {"bad gzip member", "digest differs", "bad content length"} <= reasons
    key = lambda rs: sorted(repr((r["page_id"], r["url"], r["html"])) for r in rs)
    assert key(r for r in rows if r["kind"] == "record") == key(pages.collect())
