"""SimHash near-dedup with a byte-position inverted index and count filtering.

A document's signature has 32 bytes. Signatures that differ in at most h bits
agree in at least 32 - h byte positions, the guaranteed minimum. The index posts
each document under the bytes at h + 1 positions, so that every such pair shares
a list at any corpus size; a long list is split into pairs of blocks. Within a
list all pairs are compared on half of their bits, what is left is tallied for
the minimum of shared bytes and verified by Hamming distance, and a list's
groups leave it as edges to one member, never as all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.llm import textvec as V
from loupe.llm.common import components, materialize, read, small_batches, unused

BYTES = 32
MAX_BITS = 30
LONGEST = 1 << 16
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1


def signatures(texts: V.Texts, least_words: int = 16) -> np.ndarray:
    """32 bytes for each text: the signs of sums over its lower-case words, each word weighing the root of its count.

    With fewer than least_words words a sum says nothing: such a text gets a hash
    of its words in order, so that it equals only its exact copies. Texts without
    a word are zeros.
    """
    low = texts.lower()
    tok = low.tokens(V.LETTER)
    h, owner, n = tok.hashes(), tok.owner, len(texts)
    out = np.zeros((n, BYTES), np.uint8)
    if not len(h):
        return out
    order = np.lexsort((h, owner))
    hs, ow = h[order], owner[order]
    first = np.flatnonzero(np.r_[True, (hs[1:] != hs[:-1]) | (ow[1:] != ow[:-1])])
    weight = np.sqrt(np.diff(np.r_[first, len(hs)]))
    hs, ow = hs[first], ow[first]
    for w in range(BYTES // 8):
        word = V.mix(hs + np.uint64((0x9E3779B97F4A7C15 * (w + 1)) % (1 << 64))).view(np.uint8).reshape(-1, 8)
        for b in range(8):
            for lo in range(0, n, 4096):
                hi = min(n, lo + 4096)
                s, e = np.searchsorted(ow, [lo, hi])
                hist = np.bincount((ow[s:e] - lo) * 256 + word[s:e, b], weight[s:e], (hi - lo) * 256).reshape(hi - lo, 256)
                out[lo:hi, w * 8 + b] = np.packbits(hist.astype(np.float32) @ _BITS > 0, axis=1)[:, 0]
    short = np.flatnonzero((tok.count < least_words) & (tok.count > 0))
    for i in short:
        x = np.uint64(1469598103934665603)
        with np.errstate(over="ignore"):
            for v in h[tok.lo[i] : tok.hi[i]]:
                x = (x ^ v) * np.uint64(1099511628211)
        out[i] = V.mix(x + np.arange(1, BYTES // 8 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.uint8)
    out[tok.count == 0] = 0
    return out


def _signature_udf(text: pa.Array) -> pa.Array:
    parts = [signatures(t) for t in V.pieces(text)]
    raw = np.concatenate(parts).tobytes() if parts else b""
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(BYTES), len(text), [None, pa.py_buffer(raw)])
    return fixed.cast(pa.binary())


def tuples(n: int, max_bits: int = MAX_BITS) -> np.ndarray:
    """The tuples of byte positions under which n signatures are posted: one of h + 1 positions each.

    h bits touch at most h of them, so at any n a pair within h bits agrees in at
    least one; longer tuples would have shorter lists, but miss pairs.
    """
    if not 0 <= max_bits < BYTES:
        raise ValueError(f"signatures of {BYTES} bytes that differ in {max_bits} bits may share none")
    return np.arange(max_bits + 1)[:, None]


def _near(a: np.ndarray, b: np.ndarray | None, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The index pairs of all rows of a and b (None: of a and its later rows) within max_bits; rows are 4 words."""
    cols, words = (a if b is None else b), np.ascontiguousarray((a if b is None else b).T)
    wide = 4096
    for i in range(0, len(a), 32):
        rows = a[i : i + 32]
        for j in range(i if b is None else 0, len(cols), wide):
            part = words[:, j : j + wide]
            d = np.bitwise_count(rows[:, :1] ^ part[0]) + np.bitwise_count(rows[:, 1:2] ^ part[1])  # at most 128
            at = np.flatnonzero(d <= max_bits)
            x, y = at // part.shape[1] + i, at % part.shape[1] + j
            if b is None:
                x, y = x[y > x], y[y > x]
            diff = a[x] ^ cols[y]
            enough = np.count_nonzero(diff.view(np.uint8) == 0, axis=1) >= BYTES - max_bits
            near = enough & (np.bitwise_count(diff).sum(1, dtype=np.int64) <= max_bits)
            if near.any():
                yield x[near], y[near]


def _join(lead: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """lead, the least member of each row's group, after the groups of i and j are joined pair by pair."""
    while True:
        low, high = np.minimum(lead[i], lead[j]), np.maximum(lead[i], lead[j])
        if (low == high).all():
            return lead
        np.minimum.at(lead, high, low)
        while (lead[lead] != lead).any():
            lead = lead[lead]


def _groups(sig: np.ndarray, max_bits: int, second: np.ndarray | None = None) -> np.ndarray:
    """The index of each row's group leader; rows are joined if they differ in at most max_bits bits.

    Every pair is compared; with second, every pair of a row that it marks and one that it doesn't.
    """
    lead, words = np.arange(len(sig)), sig.view(np.uint64)
    if second is None or not second.any():
        for i, j in _near(words, None, max_bits):
            lead = _join(lead, i, j)
    else:
        p, q = np.flatnonzero(~second), np.flatnonzero(second)
        for i, j in _near(words[p], words[q], max_bits):
            lead = _join(lead, p[i], q[j])
    return lead


def near_edges(sigs: DataFrame, max_bits: int = MAX_BITS, longest: int = LONGEST) -> DataFrame:
    """(a, b) edges that connect the near-duplicate signatures of sigs (id, sig), signatures distinct; an id may have several.

    A list of more than longest is cut into blocks, and each pair of blocks is a list of its own.
    """
    sets = tuples(0, max_bits)[:, 0]

    def matrix(b: pa.RecordBatch, at: int) -> np.ndarray:
        return np.frombuffer(b"".join(b.column(at).to_pylist()), np.uint8).reshape(-1, BYTES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(sets) * 256, np.int64)
        for b in batches:
            sums += np.bincount((matrix(b, 0)[:, sets] + np.arange(len(sets)) * 256).ravel(), minlength=len(sums))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["post", "n"])

    blocks = np.zeros(len(sets) * 256, np.int64)
    for post, n in sigs.select("sig").mapInArrow(count, "post long, n long").groupBy("post").agg(F.sum("n")).collect():
        blocks[post] = -(-n // longest) if n > 1 else 0

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = matrix(b, 1)
            ids = b.column(0).to_numpy()
            own = V.mix(ids.view(np.uint64) + np.uint64(1))
            for k in sets:
                at = k * 256 + s[:, k].astype(np.int64)
                times = blocks[at]
                row = np.repeat(np.arange(len(s)), times)
                other = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                mine = (own[row] % times[row].astype(np.uint64)).astype(np.int64)
                key = (at[row] << 40) | (np.minimum(mine, other) << 20) | np.maximum(mine, other)
                words = np.ascontiguousarray(s[row]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, ids[row], mine > other, *words.T)], ["key", "id", "second", "w0", "w1", "w2", "w3"])

    def lists(t: pa.Table) -> pa.Table:
        ids = t["id"].to_numpy()
        sig = np.stack([t[f"w{i}"].to_numpy() for i in range(4)], axis=1).view(np.uint8)
        lead = _groups(sig, max_bits, t["second"].to_numpy())
        other = lead != np.arange(len(ids))
        return pa.table({"a": ids[other], "b": ids[lead[other]]})

    posted = sigs.select("id", "sig").mapInArrow(post, "key long, id long, second boolean, w0 long, w1 long, w2 long, w3 long")
    return posted.groupBy("key").applyInArrow(lists, "a long, b long").distinct()


def doc_signatures(docs: DataFrame) -> DataFrame:
    """(id, sig) of the documents of docs (doc_id, text) that have an id and a word."""
    small_batches(docs.sparkSession)
    sig = F.arrow_udf(_signature_udf, "binary")
    sigs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), sig("text").alias("sig"))
    return sigs.where(F.col("sig") != F.lit(bytes(BYTES)))


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, earlier: DataFrame | None = None) -> DataFrame:
    """(doc_id, rep) for every document of a group of two or more; rep is the least doc_id of the group.

    Groups are the connected components of pairs within max_bits of the 256 bits;
    identical signatures are one from the start, so that many exact copies cost
    nothing. earlier (doc_id, text): other texts of documents of docs, as they were
    before lines were taken out; a document is near another if any of its texts is.
    Documents without a word, or without a doc_id, are in no group. Rows
    that share a doc_id are one document with several texts; a doc_id that is no
    number raises. Further columns don't matter; an empty table gives none.
    """
    all_sigs = doc_signatures(docs)
    if earlier is not None:
        own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id")).distinct()
        all_sigs = all_sigs.union(doc_signatures(earlier).join(own, "id", "left_semi").select("id", "sig")).distinct()
    all_sigs = materialize(all_sigs, "sigs")
    same = materialize(all_sigs.groupBy("sig").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "same")
    copies = all_sigs.join(same.where("n > 1"), "sig").where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    edges = materialize(near_edges(same.select(F.col("rep").alias("id"), "sig"), max_bits).where("a <> b"), "edges")
    return components(copies.union(edges)).select(F.col("node").alias("doc_id"), F.col("root").alias("rep"))


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS, earlier: DataFrame | None = None) -> DataFrame:
    """docs without the documents that are near duplicates of one with a lesser doc_id; rows without a doc_id stay. An empty table gives an empty one. See near_duplicates."""
    gone = near_duplicates(docs, max_bits, earlier).where("doc_id <> rep")
    key = unused(docs, "gone_id")
    gone = gone.select(F.col("doc_id").alias(key)).hint("shuffle_hash")
    return docs.join(gone, docs["doc_id"].cast("long") == gone[key], "left_anti")


def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each group of near duplicates: the doc_id that stays and all of the group."""
    pairs = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return pairs.groupBy(F.col("rep").alias("kept_doc_id")).agg(F.array_sort(F.collect_set("doc_id")).alias("doc_ids"), F.count("*").alias("n_docs"))
