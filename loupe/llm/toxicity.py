"""Toxicity: a linear-chain conditional random field over a sentence's words.

Two states, toxic or not. Emissions are sums of weights of a word, how it begins,
its two neighbours, its shape and its length; forward-backward marginals give each word's
probability, runs of probable words are the offending spans, and a logistic
function of the expected number of toxic words and of all words, fitted on the
labels, scores the document: a stray word in a long text is not a toxic text. Chains of many documents are worked on at once, a step
being one array operation over all that are long enough.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.llm import textvec as V
from loupe.llm.common import materialize, read, small_batches, unused

_END = V.table(".!?\n\r;")
_N_SHAPE = 12
_BEGIN_BYTES = 6
LEAST_DOCS = 5


@dataclass
class Words:
    """Words of some texts in chains: one a sentence."""

    tok: V.Tokens | None
    h: np.ndarray
    begin: np.ndarray  # hash of the first bytes
    first: np.ndarray  # of each chain
    shape: np.ndarray
    head: np.ndarray  # whether a word begins a chain


def words(texts: V.Texts) -> Words:
    tok = texts.tokens(V.LETTER)
    n = len(tok)
    low = texts.lower().data
    h = tok.hashes(low)
    begin = V.span_hashes(low, tok.start, np.minimum(tok.end, tok.start + _BEGIN_BYTES))
    head = np.zeros(n, bool)
    if n:
        head[tok.lo[tok.count > 0]] = True
        ends = np.r_[0, np.cumsum(_END[texts.data])]
        head[1:] |= ends[tok.start[1:]] > ends[tok.end[:-1]]
    c = texts.data[tok.start]
    size = tok.end - tok.start
    upper = (c >= 65) & (c <= 90)
    digit = (c >= 48) & (c <= 57)
    shape = np.minimum(size // 3, 3) + 4 * np.where(digit, 2, np.where(upper, 1, 0))
    return Words(tok, h, begin, np.flatnonzero(head), shape, head)


def _index(vocab: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The place of each hash in a sorted vocabulary; the last for others. Most words are others, which a table of slots settles."""
    out = np.full(len(h), len(vocab))
    if len(vocab):
        slots = np.zeros(1 << 18, bool)
        slots[(vocab >> np.uint64(46)).view(np.int64)] = True
        may = np.flatnonzero(slots[(h >> np.uint64(46)).view(np.int64)])
        k = np.minimum(np.searchsorted(vocab, h[may]), len(vocab) - 1)
        hit = vocab[k] == h[may]
        out[may[hit]] = k[hit]
    return out


@dataclass
class Crf:
    """vocab: sorted word hashes; weights that state 1 gains over state 0; trans[i, j]: from i to j."""

    vocab: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    begins: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    begin: np.ndarray = field(default_factory=lambda: np.zeros(1))
    here: np.ndarray = field(default_factory=lambda: np.zeros(1))
    before: np.ndarray = field(default_factory=lambda: np.zeros(1))
    after: np.ndarray = field(default_factory=lambda: np.zeros(1))
    shape: np.ndarray = field(default_factory=lambda: np.zeros(_N_SHAPE))
    bias: float = -30.0
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    doc: np.ndarray = field(default_factory=lambda: np.array([-30.0, 0, 0, 0]))

    def score(self, expected: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_doc_features(expected, n_words) @ self.doc, -40, 40)))

    def neighbours(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        k = _index(self.vocab, w.h)
        none = len(self.vocab)
        prev, nxt = np.full(len(k), none), np.full(len(k), none)
        prev[1:] = np.where(w.head[1:], none, k[:-1])
        nxt[:-1] = np.where(w.head[1:], none, k[1:])
        return k, prev, nxt, _index(self.begins, w.begin)

    def emissions(self, w: Words, at: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        return self.bias + self.here[at[0]] + self.before[at[1]] + self.after[at[2]] + self.begin[at[3]] + self.shape[w.shape]


def marginals(first: np.ndarray, emit: np.ndarray, start: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """For chains that begin at first: each word's probability of state 1, the expected transitions, and the log partition sum. emit: log weight of state 1."""
    n = len(emit)
    if not n:
        return np.zeros(0), np.zeros((2, 2)), 0.0
    size = np.diff(np.r_[first, n])
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    longest = int(size[0])
    live = np.searchsorted(-size, -np.arange(longest), "left")  # chains longer than t
    emit = np.clip(emit, -60, 60)
    e1 = np.exp(emit)
    a = np.exp(trans)
    s = np.exp(start)
    fwd = np.empty((n, 2))
    scale = np.empty(n)
    f0, f1 = np.full(len(first), s[0]), s[1] * e1[first]
    for t in range(longest):
        k = live[t]
        pos = first[:k] + t
        if t:
            g0, g1 = f0[:k], f1[:k]
            f0 = g0 * a[0, 0] + g1 * a[1, 0]
            f1 = (g0 * a[0, 1] + g1 * a[1, 1]) * e1[pos]
        c = f0 + f1
        f0, f1 = f0 / c, f1 / c
        fwd[pos, 0], fwd[pos, 1], scale[pos] = f0, f1, c
    p = np.empty(n)
    moves = np.zeros((2, 2))
    b0, b1 = np.ones(len(first)), np.ones(len(first))
    for t in range(longest - 1, -1, -1):
        k = live[t]
        pos = first[:k] + t
        m = live[t + 1] if t + 1 < longest else 0
        if m:
            nxt = pos[:m] + 1
            x0, x1 = b0[:m] / scale[nxt], b1[:m] * e1[nxt] / scale[nxt]
            q0, q1 = fwd[pos[:m], 0], fwd[pos[:m], 1]
            moves += [[(q0 * x0).sum() * a[0, 0], (q0 * x1).sum() * a[0, 1]], [(q1 * x0).sum() * a[1, 0], (q1 * x1).sum() * a[1, 1]]]
            b0[:m], b1[:m] = a[0, 0] * x0 + a[0, 1] * x1, a[1, 0] * x0 + a[1, 1] * x1
        z0, z1 = fwd[pos, 0] * b0[:k], fwd[pos, 1] * b1[:k]
        p[pos] = z1 / (z0 + z1)
    return p, moves, float(np.log(scale).sum())


def _doc_features(expected: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(expected)), np.log(expected + 0.05), np.log1p(n_words), np.minimum(expected, 3)])


def fit_doc_score(expected: np.ndarray, n_words: np.ndarray, y: np.ndarray, l2: float = 0.1) -> np.ndarray:
    """Logistic regression by Newton's method."""
    x, b = _doc_features(expected, n_words), np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(4), x.T @ (y - p) - l2 * b)
        b = b + np.clip(step, -3, 3)
    return b


def fit_crf(w: Words, tags: np.ndarray, rounds: int = 100, rate: float = 0.5, l2: float = 0.02, min_words: int = 3) -> Crf:
    """Maximum likelihood of the tags (0 or 1 for each word), with a quadratic penalty, by Adagrad on the whole gradient."""
    y = tags.astype(float)
    if not len(y) or not y.any():
        return Crf()
    u, c = np.unique(w.h, return_counts=True)
    known = np.isin(u, np.unique(w.h[y > 0]))
    ub, cb = np.unique(w.begin, return_counts=True)
    m = Crf(vocab=u[(c >= min_words) | known], begins=ub[(cb >= min_words) | np.isin(ub, np.unique(w.begin[y > 0]))])
    size = len(m.vocab) + 1
    m.here, m.before, m.after, m.begin, m.bias = np.zeros(size), np.zeros(size), np.zeros(size), np.zeros(len(m.begins) + 1), -3.0
    at = m.neighbours(w)
    same = ~w.head[1:]
    a, b = tags[:-1][same], tags[1:][same]
    seen = np.bincount(a * 2 + b, minlength=4).reshape(2, 2).astype(float)
    begins = np.array([(1 - y[w.first]).sum(), y[w.first].sum()])
    square = [np.full(x.shape, 1e-6) for x in (m.here, m.before, m.after, m.begin, m.shape, np.zeros(1), m.start, m.trans)]
    for _ in range(rounds):
        p, moves, _ = marginals(w.first, m.emissions(w, at), m.start, m.trans)
        d = y - p
        one = p[w.first].sum()
        grads = [np.bincount(at[0], d, size) - l2 * m.here, np.bincount(at[1], d, size) - l2 * 10 * m.before, np.bincount(at[2], d, size) - l2 * 10 * m.after, np.bincount(at[3], d, len(m.begin)) - l2 * m.begin, np.bincount(w.shape, d, _N_SHAPE) - l2 * m.shape, np.array([d.sum()]), begins - [len(w.first) - one, one] - l2 * m.start, seen - moves - l2 * m.trans]
        for g in grads[:4]:
            g[-1] = 0  # words that are not in the vocabulary have no weight of their own
        for k, g in enumerate(grads):
            square[k] += g * g
        step = [rate * g / np.sqrt(s) for g, s in zip(grads, square, strict=True)]
        m.here, m.before, m.after, m.begin, m.shape = m.here + step[0], m.before + step[1], m.after + step[2], m.begin + step[3], m.shape + step[4]
        m.bias += float(step[5][0])
        m.start, m.trans = m.start + step[6], m.trans + step[7]
    return m


def toxic_hashes(seen: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n_toxic: int, n_other: int, least_docs: int = LEAST_DOCS, least_odds: float = 8.0, least_z: float = 5.0) -> list[np.ndarray]:
    """Of (hashes, toxic documents that have it, other documents that have it), the sorted hashes that stand in far more toxic documents."""
    na, nb = max(1, n_toxic), max(1, n_other)
    found = []
    for u, a, b in seen:
        pool = (a + b) / (na + nb)
        z = (a / na - b / nb) / np.sqrt(np.maximum(pool * (1 - pool) * (1 / na + 1 / nb), 1e-12))
        odds = (a + 0.5) / (na + 1) / ((b + 0.5) / (nb + 1))
        found.append(np.sort(u[(a >= least_docs) & (odds >= least_odds) & (z >= least_z)]))
    return found


def token_tags(w: Words, toxic: np.ndarray, bad: list[np.ndarray]) -> np.ndarray:
    """Tags from labels of documents: in toxic ones, the words that toxic_hashes has, or that begin like such words."""
    return ((np.isin(w.h, bad[0]) | np.isin(w.begin, bad[1])) & (toxic[w.tok.owner] > 0)).astype(np.int64)


def span_tags(texts: V.Texts, w: Words, marks: list[list[dict] | None]) -> np.ndarray:
    """Tags from marked spans of each text, in characters: words that share a character with one."""
    starts, ends, _ = _character_places(texts, w, np.arange(len(w.h)), np.arange(len(w.h)))
    out = np.zeros(len(w.h), np.int64)
    for i, spans in enumerate(marks):
        at = slice(w.tok.lo[i], w.tok.hi[i])
        for x in spans or []:
            out[at] |= (starts[at] < x["end"]) & (ends[at] > x["begin"])
    return out


def _character_places(texts: V.Texts, w: Words, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where runs of words begin and end in their text, in characters, and their texts."""
    chars = np.r_[0, np.cumsum((texts.data & 0xC0) != 0x80)]
    owner = w.tok.owner[first]
    base = chars[texts.start[owner]]
    return chars[w.tok.start[first]] - base, chars[w.tok.end[last]] - base, owner


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, h, bad, good): for words (kind 0) and how they begin (1), in how many toxic and other texts of a batch they stand."""
    for b in batches:
        toxic, at = b.column(1).to_numpy(), 0
        for t in V.pieces(b.column(0)):
            y = toxic[at : at + len(t)]
            at += len(t)
            w = words(t)
            owner = w.tok.owner
            for kind, h in enumerate((w.h, w.begin)):
                _, once = np.unique(V.mix(h + V.mix(owner.astype(np.uint64))), return_index=True)
                u, inv = np.unique(h[once], return_inverse=True)
                bad = y[owner[once]] > 0
                cols = [np.full(len(u), kind, np.int32), u.view(np.int64), np.bincount(inv, bad, len(u)).astype(np.int64), np.bincount(inv, ~bad, len(u)).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["kind", "h", "bad", "good"])


def _tag_chains(bad: list[np.ndarray] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of (text, toxic, marks) to chains: (key, tagged, h, begin, shape, tags). Tags are from the hashes of bad words, or without them from marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic, at = b.column(1).to_numpy(), 0
            for t in V.pieces(b.column(0)):
                w = words(t)
                y = toxic[at : at + len(t)]
                tags = span_tags(t, w, b.column(2).slice(at, len(t)).to_pylist()) if bad is None else token_tags(w, y, bad)
                at += len(t)
                if not len(w.h):
                    continue
                cut = np.r_[w.first, len(w.h)]
                # equal chains have equal keys, so that what is kept of a sample doesn't depend on batches
                key = V.mix(np.add.reduceat(V.mix(w.h + np.arange(len(w.h), dtype=np.uint64) - np.repeat(w.first, np.diff(cut)).astype(np.uint64)), w.first))
                lists = [[x[i:j].astype(kind).tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)] for x, kind in ((w.h, np.uint64), (w.begin, np.uint64), (w.shape, np.uint8), (tags, np.uint8))]
                cols = [pa.array(key.view(np.int64)), pa.array(np.add.reduceat(tags, w.first) > 0), *[pa.array(x, pa.binary()) for x in lists]]
                yield pa.RecordBatch.from_arrays(cols, ["key", "tagged", "h", "begin", "shape", "tags"])

    return run


def _expected_words(m: Crf) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for t in V.pieces(b.column(0)):
                w = words(t)
                p, _, _ = marginals(w.first, m.emissions(w, m.neighbours(w)), m.start, m.trans)
                yield pa.RecordBatch.from_arrays([b.column(1).slice(at, len(t)), pa.array(np.bincount(w.tok.owner, p, len(t))), pa.array(w.tok.count.astype(np.int64))], ["toxic", "expected", "n_words"])
                at += len(t)

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_train_rows: int = 8000, max_chains: int = 40_000, others: int = 3, spans: DataFrame | None = None) -> Crf:
    """Trains on at most about max_train_rows labelled documents, chosen by hash; labels: doc_id, toxic (0 or 1).

    spans (doc_id, begin, end): the labelled tokens, as spans of characters; without
    them the words that stand in far more toxic documents are taken as labelled in
    toxic ones. The field is fitted on the chains with a tag and others times as many
    without, at most max_chains in all, the score on all the documents. Words are
    hashed and counted on the executors; the driver gets counts and chains.

    Rows without doc_id, text or a label of 0 or 1 don't count; of labels that repeat
    the greater counts; a document that repeats is trained on as often as it stands. No
    rows, or none that is toxic, give a model that scores 0 and finds nothing.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = rows.count()
    if n > max_train_rows:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_train_rows / n))
    # the sample has a bounded number of rows, so that it can be sent to all tasks
    sample = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").where("text is not null")
    kind = "array<struct<begin:int,end:int>>"
    if spans is not None:
        marks = spans.join(F.broadcast(rows.select("doc_id")), "doc_id").groupBy("doc_id").agg(F.collect_list(F.struct(F.col("begin").cast("int").alias("begin"), F.col("end").cast("int").alias("end"))).alias("marks"))
        sample = sample.join(marks, "doc_id", "left").select("text", "toxic", "marks")
    else:
        sample = sample.select("text", "toxic", F.lit(None).cast(kind).alias("marks"))
    sample = materialize(sample, "labelled")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not sizes.get(1):
        return Crf()
    bad = None
    if spans is None:
        found = sample.mapInArrow(_word_counts, "kind int, h long, bad long, good long").groupBy("kind", "h").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where(F.col("bad") >= LEAST_DOCS).toPandas()
        seen = [tuple(found.loc[found["kind"] == k, c].to_numpy() for c in ("h", "bad", "good")) for k in (0, 1)]
        bad = [x.astype(np.int64).view(np.uint64) for x in toxic_hashes(seen, sizes[1], sizes.get(0, 0))]
        bad = [np.sort(x) for x in bad]
    chains = materialize(sample.mapInArrow(_tag_chains(bad), "key long, tagged boolean, h binary, begin binary, shape binary, tags binary"), "chains")
    have = {r["tagged"]: r["count"] for r in chains.groupBy("tagged").count().collect()}
    if not have.get(True):
        return Crf()
    share = min(1.0, max_chains / (1 + others) / have[True])
    rest = min(1.0, share * others * have[True] / max(1, have.get(False, 0)))
    part = F.pmod("key", F.lit(1_000_000)) < (F.when(F.col("tagged"), share).otherwise(rest) * 1_000_000)
    got = chains.where(part).orderBy("key", "h").toPandas()
    if not got["tagged"].any():
        return Crf()
    h, begin, shape, tags = (np.frombuffer(b"".join(got[c]), kind_) for c, kind_ in (("h", np.uint64), ("begin", np.uint64), ("shape", np.uint8), ("tags", np.uint8)))
    head = np.zeros(len(h), bool)
    head[np.cumsum([0, *[len(x) // 8 for x in got["h"]]])[:-1]] = True
    m = fit_crf(Words(None, h, begin, np.flatnonzero(head), shape.astype(np.int64), head), tags.astype(np.int64))
    e = sample.select("text", "toxic").mapInArrow(_expected_words(m), "toxic int, expected double, n_words long").toPandas().sort_values(["toxic", "n_words", "expected"])
    m.doc = fit_doc_score(e["expected"].to_numpy(), e["n_words"].to_numpy(), e["toxic"].to_numpy())
    return m


def tag(texts: V.Texts, m: Crf, least: float = 0.5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scores of texts, and spans of words of at least that probability: (scores, text of each span, first character, character after, probability)."""
    w = words(texts)
    n = len(texts)
    if not len(w.h):
        return np.zeros(n), *[np.zeros(0, np.int64)] * 3, np.zeros(0)
    p, _, _ = marginals(w.first, m.emissions(w, m.neighbours(w)), m.start, m.trans)
    owner = w.tok.owner
    scores = m.score(np.bincount(owner, p, n), w.tok.count)
    scores[w.tok.count == 0] = 0
    hit = p >= least
    begin = hit & (w.head | ~np.r_[False, hit[:-1]])
    s = np.flatnonzero(begin)
    if not len(s):
        return scores, *[np.zeros(0, np.int64)] * 3, np.zeros(0)
    run = np.cumsum(begin) - 1
    idx = np.flatnonzero(hit)
    last = np.zeros(len(s), np.int64)
    last[run[idx]] = idx
    prob = np.zeros(len(s))
    np.maximum.at(prob, run[idx], p[idx])
    a, b, who = _character_places(texts, w, s, last)
    return scores, who, a, b, prob


def score_toxicity(docs: DataFrame, m: Crf, column: str = "toxicity") -> DataFrame:
    """docs and a column of (score, spans of (begin, end, probability)).

    score is the probability that the text is toxic, spans are runs of toxic words, as character
    offsets from 0, end excluded. Null, empty and wordless texts score 0 without
    spans; an empty table gives an empty one. Each row is worked on by itself, over its whole text; repeated rows get
    the same; a column of that name stays and the new one gets underscores.
    """
    small_batches(docs.sparkSession)
    inner = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())])

    def run(text: pa.Array) -> pa.Array:
        scores, counts, cols, at = [], [], [[], [], []], 0
        for t in V.pieces(text):
            s, who, a, b, p = tag(t, m)
            scores.append(s)
            counts.append(np.bincount(who, minlength=len(t)))
            for c, x in zip(cols, (a, b, p), strict=True):
                c.append(x)
            at += len(t)
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        spans = pa.StructArray.from_arrays([pa.array(cat(cols[0], np.int32)), pa.array(cat(cols[1], np.int32)), pa.array(cat(cols[2], np.float64))], fields=list(inner))
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(cat(counts, np.int64))].astype(np.int32)), spans)
        return pa.StructArray.from_arrays([pa.array(cat(scores, np.float64)), lists], names=["score", "spans"])

    kind = "score double, spans array<struct<begin:int,end:int,probability:double>>"
    return docs.withColumn(unused(docs, column), F.arrow_udf(run, f"struct<{kind.replace('score double', 'score:double').replace('spans array', 'spans:array')}>")("text"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    m = fit_toxicity(docs, read(spark, sf_dir, "labels"))
    return score_toxicity(docs, m).select("doc_id", F.round("toxicity.score", 6).alias("score"), "toxicity.spans")


def op10_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxic documents with their scores and offending offsets."""
    return _scored(spark, sf_dir).where("score >= 0.5")


def op10_span_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score, all its spans and whether it counts as toxic: also passages too short to make their document toxic."""
    return _scored(spark, sf_dir).withColumn("toxic", F.col("score") >= 0.5)
