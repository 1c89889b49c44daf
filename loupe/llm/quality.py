"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees learns one lookup table for each feature, then
one for each of the pairs whose residuals interact most. A document's logit is
the intercept plus one table entry a feature and a pair, so scoring is binning
and vectorised additions inside one Arrow UDF: no shuffle, whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.llm import textvec as V
from loupe.llm.common import read, small_batches, unused

FEATURES = [
    "log_bytes", "log_words", "mean_word", "long_words", "short_words", "upper", "digit", "symbol", "bang", "bar", "stop", "comma",
    "white", "newline", "not_ascii", "distinct_words", "repeats_before", "top_word", "distinct_lines", "control",
]
_CLASSES = [V.table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), V.table("0123456789"), V.table("#$%&*@^~=+<>{}[]\\/_"), V.table("!?"), V.table("|"), V.table("."), V.table(",;:"), V.WHITE, V.table("\n"), V.table("", 128), V.table("".join(map(chr, [*range(9), *range(14, 32)])))]


def features(texts: V.Texts) -> np.ndarray:
    """A row of FEATURES for each text; an empty text has zeros."""
    size = (texts.end - texts.start).astype(float)
    one = np.maximum(size, 1)
    tok = texts.tokens(~V.WHITE)
    n = tok.count.astype(float)
    words = np.maximum(n, 1)
    length = tok.end - tok.start
    owner = tok.owner

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(owner, mask, len(texts)) / words

    h = tok.hashes()
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    distinct, top = _distinct(owner, h, len(texts))
    lines = texts.tokens(~V.table("\n"))
    line_distinct, _ = _distinct(lines.owner, lines.hashes(), len(texts))
    upper, digit, symbol, bang, bar, stop, comma, white, newline, other, control = (texts.per_text(c[texts.data]) / one for c in _CLASSES)
    return np.column_stack([
        np.log1p(size), np.log1p(n), np.bincount(owner, length, len(texts)) / words, share(length > 12), share(length < 4), upper, digit, symbol, bang, bar, stop, comma,
        white, newline, other, distinct / words, share(same), top / words, line_distinct / np.maximum(lines.count, 1), control,
    ])


def _distinct(owner: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each owner, how many distinct values and how often the most frequent stands."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    key = np.sort((h >> np.uint64(20)) | (owner.astype(np.uint64) << np.uint64(44)))
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    who = (key[first] >> np.uint64(44)).astype(np.int64)
    runs = np.diff(np.r_[first, len(key)])
    top = np.zeros(n)
    np.maximum.at(top, who, runs)
    return np.bincount(who, minlength=n).astype(float), top


@dataclass
class Gam:
    """edges: cut points of each feature; tables: what its bins add; pairs: (i, j, coarse cuts of i, of j, table)."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for k, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += t[np.searchsorted(e, x[:, k], "right")]
        for i, j, a, b, t in self.pairs:
            out += t[np.searchsorted(a, x[:, i], "right"), np.searchsorted(b, x[:, j], "right")]
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, l2: float) -> np.ndarray:
    """A step function over bins with at most so many leaves: greedy best splits of gradient sums."""
    cg, ch = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, 0, 0)
        for k, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            m = np.arange(a + 1, b)
            gl, hl, gr, hr = cg[m] - cg[a], ch[m] - ch[a], cg[b] - cg[m], ch[b] - ch[m]
            gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + l2)
            at = int(np.argmax(gain))
            best = max(best, (float(gain[at]), k, int(m[at])))
        if not best[2]:
            break
        a, b = parts[best[1]]
        parts[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + l2)
    return out


def _corner(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[np.ndarray, float]:
    """The best tree of one cut on each axis over a grid of bins, and its gain."""
    cg, ch = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)

    def quads(c: np.ndarray) -> list[np.ndarray]:
        a, r, d, t = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return [a, r - a, d - a, t - r - d + a]

    q = list(zip(quads(cg), quads(ch), strict=True))
    gain = sum(x**2 / (y + l2) for x, y in q)
    if not gain.size:
        return np.zeros_like(g), 0.0
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    v = [float(x[i, j] / (y[i, j] + l2)) for x, y in q]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return out, float(gain[i, j]) - float(cg[-1, -1] ** 2 / (ch[-1, -1] + l2))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.1, bins: int = 32, leaves: int = 3, n_pairs: int = 6, grid: int = 8, l2: float = 1.0) -> Gam:
    """Boosts feature after feature in turn, then the n_pairs pairs with the largest gain on what is left.

    No rows, or labels of one class, give a constant model.
    """
    y = y.astype(float)
    if not len(x):
        return Gam()
    p = (y.sum() + 0.5) / (len(y) + 1)
    m = Gam(float(np.log(p / (1 - p))))
    if y.min() == y.max():
        return m
    q = np.linspace(0, 1, bins + 1)[1:-1]
    m.edges = [np.unique(np.quantile(x[:, k], q)) for k in range(x.shape[1])]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    at = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(m.edges)]
    z = np.full(len(y), m.intercept)

    def sums(where: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        s = _sigmoid(z)
        return np.bincount(where, y - s, n), np.bincount(where, s * (1 - s), n)

    for _ in range(rounds):
        for k, t in enumerate(m.tables):
            step = rate * _tree(*sums(at[k], len(t)), leaves, l2)
            t += step
            z += step[at[k]]
    coarse = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, grid + 1)[1:-1])) for k in range(x.shape[1])]
    ca = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(coarse)]
    found = []
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
            g, h = sums(ca[i] * shape[1] + ca[j], shape[0] * shape[1])
            found.append((_corner(g.reshape(shape), h.reshape(shape), l2)[1], i, j, shape))
    best = sorted(found, key=lambda f: (-f[0], f[1], f[2]))[:n_pairs]
    m.pairs = [(i, j, coarse[i], coarse[j], np.zeros(shape)) for _, i, j, shape in best]
    for _ in range(rounds // 2):
        for i, j, _, _, t in m.pairs:
            where = ca[i] * t.shape[1] + ca[j]
            g, h = sums(where, t.size)
            step = rate * _corner(g.reshape(t.shape), h.reshape(t.shape), l2)[0]
            t += step
            z += step.ravel()[where]
    return m


def training_rows(docs: DataFrame, labels: DataFrame, max_train_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most about max_train_rows labelled documents, chosen by hash of doc_id."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = rows.count()
    if n > max_train_rows:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_train_rows / n))
    f = F.arrow_udf(_features_udf, "array<double>")
    # the sample has a bounded number of rows, so that it can be sent to all tasks
    got = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").select("quality", f("text").alias("x")).toPandas()
    x = np.stack(got["x"].to_numpy()).astype(float) if len(got) else np.zeros((0, len(FEATURES)))
    order = np.lexsort(np.round(x, 9).T) if len(x) else []
    return x[order], got["quality"].to_numpy()[order]


def _features_udf(text: pa.Array) -> pa.Array:
    parts = [features(t) for t in V.pieces(text)]
    x = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))


def fit_quality(docs: DataFrame, labels: DataFrame, max_train_rows: int = 8000) -> Gam:
    """Trains on at most about max_train_rows labelled documents; labels: doc_id, quality (0 or 1). Other values, and rows without doc_id, don't count; of labels that repeat the greater counts; none, or of one value, give a constant model."""
    return fit(*training_rows(docs, labels, max_train_rows))


def score_quality(docs: DataFrame, model: Gam, column: str = "quality_score") -> DataFrame:
    """docs and a column with the probability of good quality.

    Every row is scored, on its whole text. A null text counts as an empty one; a
    missing doc_id, repeated rows, ties and further columns change nothing; an
    empty table gives an empty table. A column of that name stays, and the new one
    gets underscores.
    """
    small_batches(docs.sparkSession)

    def score(text: pa.Array) -> pa.Array:
        parts = [_sigmoid(model.logit(features(t))) for t in V.pieces(text)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(unused(docs, column), F.arrow_udf(score, "double")("text"))


def keep_good(docs: DataFrame, model: Gam, threshold: float = 0.5) -> DataFrame:
    """The documents whose score is threshold or more, with the columns they had. A blank document has nothing to reject and scores as the model says; ties of the score go or stay together; an empty table gives an empty one."""
    name = unused(docs, "quality_score")
    return score_quality(docs, model, name).where(F.col(name) >= threshold).drop(name)


def op9_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with their scores."""
    docs = read(spark, sf_dir, "documents")
    model = fit_quality(docs, read(spark, sf_dir, "labels"))
    return score_quality(docs.select("doc_id", "source", "text"), model).where("quality_score >= 0.5").drop("text")
