"""Language-model scores by stupid backoff over n-gram counts of the whole corpus.

The texts are exploded into n-grams chunk by chunk. A chunk gives, for each order
and partition of the hash space, a packed list of its distinct n-grams with their
counts. The lists of a partition add up to its part of the count table, which holds
what stands more than once; the lists are joined with that table by partition, and
the corpus counts go back to their chunk, where each token looks its own up and the
scores are summed by document. A list is a run of rows in five to six bytes an
n-gram; there are never more lists than distinct n-grams of chunks, so what is
shuffled grows in proportion to the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.llm import textvec as V
from loupe.llm.common import materialize, read, small_batches

CHUNK_BYTES = 16 << 20
PART_BYTES = 32 << 20  # of text, a partition of the count table
_LISTS = "n int, part int, chunk long, grams binary, counts binary"
_MUL = np.uint64(0x9FB21C651E98DF25)


def pack(values: np.ndarray, wide: int) -> bytes:
    """Non-negative integers as byte planes, compressed."""
    raw = values.astype(f"<u{wide}").view(np.uint8).reshape(-1, wide).T.tobytes()
    return len(values).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes, wide: int) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little")
    raw = pa.decompress(blob[4:], n * wide, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(wide, n).T).view(f"<u{wide}").ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)), 8)


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, 8), dtype=np.uint64)


def gram_hashes(words: np.ndarray, place: np.ndarray, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For n from 1 to order, the hash of the n-gram that ends at each token, and whether there is one. place: a token's place in its text."""
    h, has = [words], [np.ones(len(words), bool)]
    for n in range(2, order + 1):
        x = np.zeros_like(words)
        if len(words) > 1:
            x[1:] = V.mix(h[-1][:-1] * _MUL + words[1:] + np.uint64(n))
        h.append(x)
        has.append(place >= n - 1)
    return h, has


def _chunk_grams(text: pa.ChunkedArray, order: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    counts, h, has = [], [[] for _ in range(order)], [[] for _ in range(order)]
    for t in V.pieces(text):
        tok = t.tokens(~V.WHITE)
        place = np.arange(len(tok)) - np.repeat(tok.lo, tok.count)
        a, b = gram_hashes(tok.hashes(), place, order)
        counts.append(tok.count)
        for n in range(order):
            h[n].append(a[n])
            has[n].append(b[n])
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return cat(counts, np.int64), [cat(x, np.uint64) for x in h], [cat(x, bool) for x in has]


def _packed_texts(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        for b in batches:
            w.write_batch(b)
    return sink.getvalue().to_pybytes()


def _chunks(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[tuple[int, bytes, list[pa.RecordBatch]]]:
    """(chunk, packed texts, batches). A chunk's number comes from what it holds: should a task read its rows in another order when it runs again, chunks don't mix."""
    held: list[pa.RecordBatch] = []
    size = 0

    def one() -> tuple[int, bytes, list[pa.RecordBatch]]:
        blob = _packed_texts(held)
        return int.from_bytes(hashlib.blake2b(blob, digest_size=8).digest(), "little", signed=True), blob, held

    for b in batches:
        held.append(b)
        size += b.column(1).nbytes
        if size >= chunk_bytes:
            yield one()
            held, size = [], 0
    if any(b.num_rows for b in held):
        yield one()


_TYPES = {"n": pa.int32(), "part": pa.int32(), "chunk": pa.int64(), "grams": pa.binary(), "counts": pa.binary()}


def _rows(*columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _TYPES.values(), strict=True)], list(_TYPES))


def hash_bits(grams: float) -> int:
    """Bits of an n-gram's hash with which so many distinct ones have an eighth of a colliding pair, as expected; at most 64."""
    return int(min(64, max(32, np.ceil(2 * np.log2(max(2.0, grams)) + 2))))


def gram_lists(docs: DataFrame, parts: int, bits: int = 64, order: int = 3, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(n, part, chunk, grams, counts): for each chunk of docs (doc_id, text), its distinct n-grams by order (from 0) and partition."""
    bounds = np.array([(i << bits) // parts for i in range(1, parts)], np.uint64)
    shift = np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, held in _chunks(batches, chunk_bytes):
            _, h, has = _chunk_grams(pa.chunked_array([b.column(1) for b in held]), order)
            for n in range(order):
                u, c = np.unique(h[n][has[n]] >> shift, return_counts=True)
                cut = np.r_[0, np.searchsorted(u, bounds), len(u)]
                full = [p for p in range(parts) if cut[p + 1] > cut[p]]
                at = [(int(cut[p]), int(cut[p + 1])) for p in full]
                yield _rows([n] * len(full), full, [chunk] * len(full), [pack_sorted(u[a:b]) for a, b in at], [pack(c[a:b], 4) for a, b in at])

    return docs.select("doc_id", "text").mapInArrow(run, _LISTS)


def chunk_texts(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The same chunks themselves, packed in grams, with n = -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, blob, _ in _chunks(batches, chunk_bytes):
            yield _rows([-1], [0], [chunk], [blob], [None])

    return docs.select("doc_id", "text").mapInArrow(run, _LISTS)


def count_table(lists: DataFrame, least: int = 2) -> DataFrame:
    """(n, part, grams, counts): of all chunks together, the n-grams that stand at least so many times, sorted by hash."""

    def count(t: pa.Table) -> pa.Table:
        n, part = t["n"][0].as_py(), t["part"][0].as_py()
        grams = np.concatenate([unpack_sorted(x.as_py()) for x in t["grams"]])
        c = np.concatenate([unpack(x.as_py(), 4) for x in t["counts"]]).astype(np.uint64)
        order = np.argsort(grams)
        grams, c = grams[order], c[order]
        first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
        total, grams = np.add.reduceat(c, first), grams[first]
        keep = total >= least
        return pa.table({"n": pa.array([n], pa.int32()), "part": pa.array([part], pa.int32()), "grams": pa.array([pack_sorted(grams[keep])], pa.binary()), "counts": pa.array([pack(total[keep], 8)], pa.binary())})

    return lists.groupBy("n", "part").applyInArrow(count, "n int, part int, grams binary, counts binary")


def _look_up(left: pa.Table, right: pa.Table) -> pa.Table:
    """The corpus counts of each list's n-grams, in its order; 1 for what the table lacks."""
    grams, total = unpack_sorted(right["grams"][0].as_py()), unpack(right["counts"][0].as_py(), 8)
    said = []
    for x in left["grams"]:
        u = unpack_sorted(x.as_py())
        c = np.ones(len(u), np.uint64)
        if len(grams):
            at = np.minimum(np.searchsorted(grams, u), len(grams) - 1)
            hit = grams[at] == u
            c[hit] = total[at[hit]]
        said.append(pack(c, 8))
    return left.drop_columns(["grams", "counts"]).append_column("grams", pa.nulls(len(left), pa.binary())).append_column("counts", pa.array(said, pa.binary()))


def lm_scores(docs: DataFrame, order: int = 3, alpha: float = 0.4, min_count: int = 2, chunk_bytes: int = CHUNK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, n_tokens, log_score, mean_log_score), a row for each row of docs.

    Counts are taken over all of docs. A token's score is count(n-gram) over
    count(its context) for the longest n-gram that ends at it, starts in its text
    and stands min_count times (2 or more) in the corpus; alpha for every order that was passed
    by; a word's share of all tokens at the end. log_score sums natural logarithms.
    Tokens are what white space separates. Null and empty texts have 0 tokens, score
    0 and no mean; repeated rows and null ids are scored like others; an empty table
    gives none. Further columns don't matter.
    """
    if min_count < 2:
        raise ValueError("the count table has no n-grams that stand once")
    small_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    bits = hash_bits(size * order / 6)  # a token and its space have some six bytes

    def score(t: pa.Table) -> pa.Table:
        own = t.filter(pc.less(t["n"], 0))
        if not len(own):
            raise RuntimeError("a chunk was made twice in different ways; write docs to a table first")
        left = pa.ipc.open_stream(own["grams"][0].as_py()).read_all()
        counts, h, has = _chunk_grams(left["text"], order)
        rest = t.filter(pc.greater_equal(t["n"], 0))
        found = {(n, part): blob for n, part, blob in zip(rest["n"].to_pylist(), rest["part"].to_pylist(), rest["counts"], strict=True)}
        c = []
        for n in range(order):
            _, inv = np.unique(h[n][has[n]] >> np.uint64(64 - bits), return_inverse=True)
            got = [unpack(found[n, p].as_py(), 8) for p in range(parts) if (n, p) in found]
            if sum(map(len, got)) != (inv.max() + 1 if len(inv) else 0):
                raise RuntimeError("a chunk was made twice in different ways; write docs to a table first")
            x = np.zeros(len(h[n]))
            x[has[n]] = (np.concatenate(got) if got else np.zeros(0))[inv]
            c.append(x)
        m = len(h[0])
        out, open_ = np.zeros(m), np.ones(m, bool)
        for n in range(order - 1, 0, -1):
            use = np.flatnonzero(open_ & (c[n] >= min_count))
            out[use] += np.log(c[n][use]) - np.log(c[n - 1][use - 1])
            open_[use] = False
            out[open_ & has[n]] += np.log(alpha)
        out[open_] += np.log(c[0][open_])
        owner = np.repeat(np.arange(len(counts)), counts)
        scores = pa.table({"doc_id": left["doc_id"], "n_tokens": pa.array(counts, pa.int64()), "by_word": pa.array(np.bincount(owner, open_, len(counts)).astype(np.int64)), "log_score": pa.array(np.bincount(owner, out, len(counts)), pa.float64())})
        return pa.concat_tables([scores] * len(own))  # chunks of the same rows are one

    lists = gram_lists(docs, parts, bits, order, chunk_bytes)
    table = count_table(lists)
    said = lists.groupBy("n", "part").cogroup(table.groupBy("n", "part")).applyInArrow(_look_up, _LISTS)
    said = said.unionByName(chunk_texts(docs, chunk_bytes))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = said.groupBy("chunk").applyInArrow(score, f"doc_id {kind}, n_tokens long, by_word long, log_score double")
    out = materialize(out, "scores")
    total = max(1, out.agg(F.sum("n_tokens")).first()[0] or 0)
    s = F.col("log_score") - F.col("by_word") * F.log(F.lit(float(total)))
    return out.select("doc_id", "n_tokens", s.alias("log_score"), F.when(F.col("n_tokens") > 0, s / F.col("n_tokens")).alias("mean_log_score"))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trigram score of every document under the counts of all documents."""
    out = lm_scores(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_tokens", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 5).alias("mean_log_score"))


OP4_SQL = r"""
with d as (select doc_id, regexp_split_to_array(coalesce(text, ''), '[ \t\n\r\x0b\x0c]+') w from documents),
t as (select * from (select doc_id, unnest(w) w, generate_subscripts(w, 1) i from d) where w <> ''),
g as (select *, lag(w, 1) over o a, lag(w, 2) over o b from t window o as (partition by doc_id order by i)),
c1 as (select w, count(*) c from t group by w),
c2 as (select a, w, count(*) c from g where a is not null group by a, w),
c3 as (select b, a, w, count(*) c from g where b is not null group by b, a, w),
s as (
  select g.doc_id, case
    when c3.c >= 2 then ln(c3.c) - ln(x2.c)
    when c2.c >= 2 then (case when g.b is null then 0 else ln(0.4) end) + ln(c2.c) - ln(x1.c)
    else (case when g.b is not null then 2 when g.a is not null then 1 else 0 end) * ln(0.4) + ln(c1.c) - ln((select count(*) from t)) end v
  from g join c1 on c1.w = g.w left join c1 x1 on x1.w = g.a left join c2 on c2.a = g.a and c2.w = g.w
  left join c2 x2 on x2.a = g.b and x2.w = g.a left join c3 on c3.b = g.b and c3.a = g.a and c3.w = g.w)
select d.doc_id, coalesce(x.n, 0)::bigint n_tokens, round(coalesce(x.v, 0), 4) log_score, round(x.v / x.n, 5) mean_log_score
from d left join (select doc_id, sum(v) v, count(*) n from s group by doc_id) x using (doc_id)
"""
