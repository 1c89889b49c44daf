"""Operators that SQL can't express against plain loops that do the same one thing at a time."""

from __future__ import annotations

import gzip
import itertools
import math
import re
from collections import Counter

import numpy as np
import pytest

from loupe.llm import quality, queries, sentencepiece, toxicity, warc
from loupe.llm import textvec as V
from loupe.llm.common import read
from tests.llm.test_results import segmentations

SF = "/root/testdata/sf0.001"


def plain_tree(g: list[float], h: list[float], leaves: int, l2: float) -> list[float]:
    parts = [(0, len(g))]
    score = lambda a, b: sum(g[a:b]) ** 2 / (sum(h[a:b]) + l2)
    while len(parts) < leaves:
        found = [(score(a, m) + score(m, b) - score(a, b), k, m) for k, (a, b) in enumerate(parts) for m in range(a + 1, b)]
        found = [x for x in found if x[0] > 1e-9]
        if not found:
            break
        _, k, m = max(found)
        a, b = parts[k]
        parts[k : k + 1] = [(a, m), (m, b)]
    return [next(sum(g[a:b]) / (sum(h[a:b]) + l2) for a, b in parts if a <= i < b) for i in range(len(g))]


def plain_corner(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[np.ndarray, float]:
    best, out = -1.0, np.zeros_like(g)
    for i, j in itertools.product(range(1, g.shape[0]), range(1, g.shape[1])):
        quads = [(slice(*a), slice(*b)) for a in ((0, i), (i, None)) for b in ((0, j), (j, None))]
        gain = sum(g[q].sum() ** 2 / (h[q].sum() + l2) for q in quads)
        if gain > best:
            best, out = gain, np.zeros_like(g)
            for q in quads:
                out[q] = g[q].sum() / (h[q].sum() + l2)
    return out, best - g.sum() ** 2 / (h.sum() + l2)


def plain_gam(x: np.ndarray, y: np.ndarray, rounds: int, rate: float, bins: int, leaves: int, n_pairs: int, grid: int, l2: float = 1.0) -> np.ndarray:
    """The logits of the rows of x after the same boosting, row by row."""
    n, d = x.shape
    p = (y.sum() + 0.5) / (n + 1)
    z = [math.log(p / (1 - p))] * n
    cuts = lambda k, m: sorted(set(np.quantile(x[:, k], np.linspace(0, 1, m + 1)[1:-1]).tolist()))
    place = lambda v, edges: sum(v >= e for e in edges)
    fine = [[place(v, cuts(k, bins)) for v in x[:, k]] for k in range(d)]
    coarse = [[place(v, cuts(k, grid)) for v in x[:, k]] for k in range(d)]

    def sums(shape: tuple[int, ...], at: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
        g, h = np.zeros(shape), np.zeros(shape)
        for i in range(n):
            s = 1 / (1 + math.exp(-z[i]))
            g[at[i]] += y[i] - s
            h[at[i]] += s * (1 - s)
        return g, h

    for _ in range(rounds):
        for k in range(d):
            g, h = sums((len(cuts(k, bins)) + 1,), [(b,) for b in fine[k]])
            step = plain_tree(g.tolist(), h.tolist(), leaves, l2)
            z = [v + rate * step[b] for v, b in zip(z, fine[k], strict=True)]
    grids = {(i, j): ((len(cuts(i, grid)) + 1, len(cuts(j, grid)) + 1), list(zip(coarse[i], coarse[j], strict=True))) for i in range(d) for j in range(i + 1, d)}
    gains = {ij: plain_corner(*sums(*grids[ij]), l2)[1] for ij in grids}
    best = sorted(gains, key=lambda ij: (-gains[ij], ij))[:n_pairs]
    for _ in range(rounds // 2):
        for ij in best:
            step, _ = plain_corner(*sums(*grids[ij]), l2)
            z = [v + rate * step[at] for v, at in zip(z, grids[ij][1], strict=True)]
    return np.array(z)


def test_gam_equals_plain_boosting():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 4))
    y = (x[:, 0] + 2 * x[:, 1] * x[:, 2] + rng.normal(size=80) * 0.3 > 0).astype(int)
    options = {"rounds": 6, "rate": 0.3, "bins": 6, "leaves": 3, "n_pairs": 2, "grid": 4}
    m = quality.fit(x, y, **options)
    assert {(p[0], p[1]) for p in m.pairs} >= {(1, 2)}
    assert np.allclose(m.logit(x), plain_gam(x, y, **options))


def plain_features(text: str) -> list[float]:
    b = text.encode()
    words = re.findall(rb"[^ \t\n\r\x0b\x0c]+", b)
    one, n = max(len(b), 1), max(len(words), 1)
    share = lambda chars: sum(c in chars for c in b) / one
    lines = [x for x in b.split(b"\n") if x]
    count = Counter(words)
    return [
        math.log1p(len(b)), math.log1p(len(words)), sum(map(len, words)) / n, sum(len(w) > 12 for w in words) / n, sum(len(w) < 4 for w in words) / n,
        share(bytes(range(65, 91))), share(b"0123456789"), share(b"#$%&*@^~=+<>{}[]\\/_"), share(b"!?"), share(b"|"), share(b"."), share(b",;:"), share(b" \t\n\r\x0b\x0c"), share(b"\n"), share(bytes(range(128, 256))),
        len(count) / n, sum(u == v for u, v in zip(words, words[1:], strict=False)) / n, max(count.values(), default=0) / n, len(set(lines)) / max(len(lines), 1), share(bytes([*range(9), *range(14, 32)])),
    ]


def test_quality_query_equals_plain_scoring(spark):
    docs = read(spark, SF, "documents")
    rows = docs.select("doc_id", "text").toPandas()
    odd = ["", "a", "a a a\n\n a", "ü" * 50 + " \t\x01 x|y", "!" * 1000]
    texts = [*rows["text"].fillna(""), *odd]
    x = np.array([plain_features(t) for t in texts])
    assert np.allclose(x, quality.features(V.of(texts)))
    m = quality.fit_quality(docs, read(spark, SF, "labels"))
    want = {}
    for doc_id, f in zip(rows["doc_id"], x, strict=False):
        z = m.intercept + sum(t[sum(v >= e for e in edges)] for v, edges, t in zip(f, m.edges, m.tables, strict=True))
        z += sum(t[sum(f[i] >= e for e in a), sum(f[j] >= e for e in b)] for i, j, a, b, t in m.pairs)
        score = 1 / (1 + math.exp(-z))
        if score >= 0.5:
            want[doc_id] = score
    got = {r["doc_id"]: r["quality_score"] for r in queries.QUERIES["op9_quality_gam"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-6) for k in got)


@pytest.mark.parametrize("word", ["cats", "to", "1a", "dogs"])
def test_all_segmentations_are_those_of_the_vocabulary(word):
    p = sentencepiece.load(sentencepiece.MODEL)
    all_ = np.array(segmentations(p, b" " + word.encode()))
    got = sentencepiece.sample(p, V.of([word]), np.array([3]), len(all_) + 5)[0]
    logp = sorted(x[1] for x in got)
    top = all_.max() + np.log(np.exp(all_ - all_.max()).sum())
    assert len(logp) == len(all_) and np.allclose(logp, np.sort(all_ - top))


def test_spans_equal_enumeration(spark):
    """The field's tags by enumeration of all tag sequences, with weights looked up word by word."""
    docs, labels = read(spark, "/root/testdata/sf0.01", "documents"), read(spark, "/root/testdata/sf0.01", "labels")
    m = toxicity.fit_toxicity(docs, labels)
    assert len(m.vocab)
    toxic = docs.join(labels.where("toxic = 1"), "doc_id").orderBy("doc_id").limit(6).toPandas()["text"]
    texts = [s.strip() for t in toxic for s in re.split(r"[.!?;\n]", t) if 0 < len(re.findall(r"\w+", s)) <= 10][:40]
    assert len(texts) > 5
    here, begin = dict(zip(m.vocab.tolist(), range(len(m.vocab)), strict=True)), dict(zip(m.begins.tolist(), range(len(m.begins)), strict=True))
    found = 0
    for text in texts:
        w = toxicity.words(V.of([text]))
        k = [here.get(x, len(here)) for x in w.h.tolist()]
        none = len(here)
        heads = w.head.tolist()
        emit = []
        for i in range(len(k)):
            before = none if heads[i] else k[i - 1]
            after = none if i + 1 == len(k) or heads[i + 1] else k[i + 1]
            emit.append(m.bias + m.here[k[i]] + m.before[before] + m.after[after] + m.begin[begin.get(int(w.begin[i]), len(begin))] + m.shape[w.shape[i]])
        emit = np.clip(emit, -60, 60)
        mass, total = np.zeros(len(k)), 0.0
        for y in itertools.product((0, 1), repeat=len(k)):
            s = sum(m.start[y[i]] if heads[i] else m.trans[y[i - 1], y[i]] for i in range(len(y))) + float(np.dot(emit, y))
            total += math.exp(s)
            mass += math.exp(s) * np.array(y)
        p = mass / total
        spans, at = [], [(x.start(), x.end()) for x in re.finditer(r"[^\W_]+", text)]
        for i, hit in enumerate(p >= 0.5):
            if hit and spans and i and p[i - 1] >= 0.5 and not heads[i]:
                spans[-1] = (spans[-1][0], at[i][1])
            elif hit:
                spans.append(at[i])
        if len(at) != len(k):
            continue
        scores, _, a, b, _ = toxicity.tag(V.of([text]), m)
        assert list(zip(a.tolist(), b.tolist(), strict=True)) == spans
        assert math.isclose(scores[0], m.score(np.array([p.sum()]), np.array([len(k)]))[0], rel_tol=1e-6)
        found += len(spans)
    assert found


def test_files_are_read_plain_by_record_and_as_one_member(spark, tmp_path):
    raw = [warc.page_record(i, f"http://a/{i}", f"page {i} " * 20) for i in range(20)]
    (tmp_path / "deep").mkdir()
    (tmp_path / "plain.warc").write_bytes(b"".join(raw))
    (tmp_path / "deep" / "records.warc.gz").write_bytes(b"".join(warc.member(r) for r in raw))
    (tmp_path / "whole.warc.gz").write_bytes(gzip.compress(b"".join(raw)))
    (tmp_path / "broken.warc").write_bytes(b"".join(raw[:3]) + raw[3][:50] + b"".join(raw[4:]))
    (tmp_path / "empty.warc").write_bytes(b"")
    found = warc.read_warc(spark, str(tmp_path))
    pages: dict[str, list[int]] = {}
    for r in found.where("kind = 'record'").orderBy("file", "start", "inner_start").collect():
        pages.setdefault(r["file"].rsplit("/", 1)[1], []).append(r["page_id"])
    every = list(range(20))
    assert pages == {"plain.warc": every, "records.warc.gz": every, "whole.warc.gz": every, "broken.warc": [i for i in every if i != 3]}
    gaps = [(r["file"].rsplit("/", 1)[1], bytes(r["block"])) for r in found.where("kind = 'gap'").collect()]
    assert gaps == [("broken.warc", raw[3][:50])]


def test_lm_needs_counts_of_two(spark):
    from loupe.llm import ngrams

    with pytest.raises(ValueError):
        ngrams.lm_scores(read(spark, SF, "documents"), min_count=1)
