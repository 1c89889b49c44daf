"""Each operator against brute force, an exact round trip or held-out accuracy."""

from __future__ import annotations

import gzip
import itertools

import numpy as np
import pytest

import corpus_pipeline
from loupe.llm import lines, mixing, quality, sentencepiece, simhash, toxicity, vectors, warc
from loupe.llm import textvec as V
from loupe.llm.common import read

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return read(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return docs.toPandas().sort_values("doc_id")


def groups_of(sig: np.ndarray, ids: list[int], bits: int) -> set[frozenset[int]]:
    """Of the documents ids, which may have several signatures each."""
    group = {i: {i} for i in ids}
    x = np.unpackbits(sig, axis=1)
    for i, j in itertools.combinations(range(len(ids)), 2):
        if (x[i] != x[j]).sum() <= bits and sig[i].any():
            both = group[ids[i]] | group[ids[j]]
            for k in both:
                group[k] = both
    return {frozenset(g) for g in group.values() if len(g) > 1}


def test_simhash_equals_all_pairs(docs, texts):
    want = groups_of(simhash.signatures(V.of(texts["text"].tolist())), texts["doc_id"].tolist(), simhash.MAX_BITS)
    found: dict[int, set[int]] = {}
    for r in simhash.near_duplicates(docs).collect():
        found.setdefault(r["rep"], set()).add(r["doc_id"])
    got = {frozenset(g) for g in found.values()}
    assert all(min(g) == k for k, g in found.items())
    assert all(any(g <= w for w in want) for g in got)  # nothing joined that all pairs don't join
    assert sum(any(w == g for g in got) for w in want) >= 0.95 * len(want)


@pytest.mark.parametrize("n", [1000, 100_000, 5_000_000, 10**9])
def test_simhash_tuples_find_near_copies(n):
    sets, rng = simhash.tuples(n), np.random.default_rng(1)
    for bits, least in ((4, 0.99), (8, 0.95)):
        hit = 0
        for _ in range(300):
            bad = np.zeros(simhash.BYTES, bool)
            bad[rng.choice(256, bits, replace=False) // 8] = True
            hit += any(not bad[s].any() for s in sets)
        assert hit >= least * 300


def test_signature_of_near_copies():
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in rng.integers(0, 5000, 300)]
    other = list(words)
    other[7], other[99] = "changed", "also"
    far = [f"w{i}" for i in rng.integers(0, 5000, 300)]
    a, b, c = np.unpackbits(simhash.signatures(V.of([" ".join(x) for x in (words, other, far)])), axis=1)
    assert (a != b).sum() <= simhash.MAX_BITS < (a != c).sum()


def segmentations(p: sentencepiece.Pieces, word: bytes) -> list[float]:
    vocab = {bytes(p.raw[s : s + z]): float(lp) for s, z, lp in zip(p.start, p.size, p.logp, strict=True)}
    out = []

    def go(at: int, total: float) -> None:
        if at == len(word):
            out.append(total)
        for end in range(at + 1, len(word) + 1):
            if word[at:end] in vocab:
                go(end, total + vocab[word[at:end]])

    go(0, 0.0)
    return out


def test_samples_are_distinct_and_follow_the_lattice():
    p = sentencepiece.load(sentencepiece.MODEL)
    n, word = 4000, "cats"
    got = sentencepiece.sample(p, V.of([word] * n), np.arange(n), 3)
    assert all(len({tuple(x[0]) for x in g}) == len(g) == 3 for g in got)
    assert all(g[0][2] >= g[1][2] >= g[2][2] for g in got)
    first: dict[tuple[int, ...], list[float]] = {}
    for g in got:
        first.setdefault(tuple(g[0][0].tolist()), []).append(g[0][1])
    for logp in first.values():  # the first sample is an ordinary one
        share, want = len(logp) / n, float(np.exp(logp[0]))
        assert abs(share - want) < 5 * np.sqrt(want * (1 - want) / n) + 1e-3
    second_if_first = [tuple(g[1][0].tolist()) for g in got if tuple(g[0][0].tolist()) == max(first, key=lambda k: len(first[k]))]
    top = np.exp(max(first.values(), key=len)[0])
    for other in set(second_if_first):  # and the second one of what is left
        if other in first:
            share, want = second_if_first.count(other) / len(second_if_first), float(np.exp(first[other][0])) / (1 - top)
            assert abs(share - want) < 5 * np.sqrt(want * (1 - want) / len(second_if_first)) + 2e-3


def test_every_text_decodes(spark, docs):
    out = sentencepiece.decode(sentencepiece.encode(docs, k=2, carry=("doc_id", "text")))
    assert out.where("not round_trip or decoded <> text").count() == 0
    assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_quality_and_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels")
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    q = quality.score_quality(docs, quality.fit_quality(docs, train)).join(test, "doc_id").select("quality", "quality_score").toPandas()
    assert ((q["quality_score"] >= 0.5) == (q["quality"] == 1)).mean() >= 0.9
    t = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, train)).join(test, "doc_id").select("toxic", "toxicity.score", "toxicity.spans", "text").toPandas()
    hit = t["score"] >= 0.5
    assert (hit == (t["toxic"] == 1)).mean() >= 0.9
    for text, spans in t.loc[hit, ["text", "spans"]].itertuples(index=False):
        assert all(0 <= s["begin"] < s["end"] <= len(text) and not text[s["begin"] : s["end"]].startswith(" ") for s in spans)


@pytest.mark.parametrize("given", [True, False])
def test_spans_are_the_planted_ones(spark, given):
    """With labelled tokens, and with labels of documents alone: every planted word, and nothing else, on documents that were not trained on."""
    rng = np.random.default_rng(8)
    good, bad = [f"w\u00f6rd{i:03d}" for i in range(400)], [f"zork{i}" for i in "abcdefghij"]
    rows, planted = [], {}
    for i in range(600):
        ws = [str(x) for x in rng.choice(good, 40)]
        spots = sorted(int(x) for x in rng.choice(38, 3, replace=False)) if i % 3 == 0 else []
        for x in spots:
            ws[x] = str(rng.choice(bad))
        text = ""
        for k, x in enumerate(ws):
            if k in spots:
                planted.setdefault(i, []).append((len(text), len(text) + len(x)))
            text += x + (". " if k % 10 == 9 else " ")
        rows.append((i, text, int(bool(spots))))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    spans = spark.createDataFrame([(i, a, b) for i, s in planted.items() for a, b in s], "doc_id long, begin int, end int")
    m = toxicity.fit_toxicity(docs.drop("toxic"), docs.where("doc_id % 2 = 0").select("doc_id", "toxic"), spans=spans if given else None)
    right = wrong = missed = 0
    for r in toxicity.score_toxicity(docs.where("doc_id % 2 = 1"), m).collect():
        got = set()
        for x in r["toxicity"]["spans"]:  # neighbours are one span
            at = x["begin"]
            for word in r["text"][x["begin"] : x["end"]].split(" "):
                got.add((at, at + len(word)))
                at += len(word) + 1
        want = set(planted.get(r["doc_id"], []))
        right, wrong, missed = right + len(got & want), wrong + len(got - want), missed + len(want - got)
        assert (r["toxicity"]["score"] >= 0.5) == bool(want)
    assert right > 250 and wrong + missed <= 0.02 * right


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    emit, start, trans = rng.normal(size=9), rng.normal(size=2), rng.normal(size=(2, 2))
    p, moves, log_z = toxicity.marginals(np.array([0, 5]), emit, start, trans)
    want, total = np.zeros(9), 0.0
    for a, b in ((0, 5), (5, 9)):
        weight, z = np.zeros(b - a), 0.0
        for y in itertools.product((0, 1), repeat=b - a):
            w = np.exp(start[y[0]] + sum(emit[a + i] * v for i, v in enumerate(y)) + sum(trans[u, v] for u, v in zip(y, y[1:], strict=False)))
            z += w
            weight += w * np.array(y)
        want[a:b] = weight / z
        total += np.log(z)
    assert np.allclose(p, want) and np.isclose(log_z, total) and np.isclose(moves.sum(), 7)


def test_cuckoo_holds_what_was_put_in():
    keys = np.random.default_rng(2).integers(-(2**62), 2**62, 20_000)
    c = lines.Cuckoo.build(keys)
    assert c.contains(keys).all()
    assert lines.Cuckoo.load(c.dump()).contains(np.arange(20_000)).mean() < 0.002
    c.delete(keys[:10_000])
    assert c.contains(keys[10_000:]).all() and c.contains(keys[:10_000]).mean() < 0.002


def test_deleting_documents_undoes_their_insertion(docs):
    a, b = docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0")
    both = lines.LineIndex().insert(a).insert(b)
    once = lines.LineIndex().insert(docs)
    key = lambda i: sorted((r["h1"], r["h2"], r["refs"], tuple(r["first"])) for r in i.refs.collect())
    assert key(both) == key(once)
    back = both.delete(b.select("doc_id"))
    alone = lines.LineIndex().insert(a)
    assert key(back) == key(alone)
    assert back.probe(alone.refs).where("not maybe").count() == 0
    gone = both.refs.join(back.refs, ["h1", "h2"], "left_anti")
    assert back.probe(gone).where("maybe").count() <= 0.01 * gone.count() + 1
    clean = {r["doc_id"]: r["text"] for r in back.clean(a).collect()}
    assert clean == {r["doc_id"]: r["text"] for r in alone.clean(a).collect()}


def test_an_index_of_many_shards_through_several_changes(spark, docs, monkeypatch):
    monkeypatch.setattr(lines.LineIndex, "lines_per_shard", 60)
    part = lambda i: docs.where(f"doc_id % 4 = {i}")
    key = lambda i: sorted((r["h1"], r["h2"], r["refs"], tuple(r["first"])) for r in i.refs.collect())
    index = lines.LineIndex().insert(part(0)).insert(part(1)).insert(part(2))
    assert index.shards > 2 and index.filters.count() == index.filters.select("shard").distinct().count() == index.shards
    with pytest.raises(ValueError):
        index.insert(part(2))
    index = index.delete(part(1).select("doc_id")).delete(part(2).select("doc_id")).insert(part(3)).delete(part(0).select("doc_id")).insert(part(2))
    want = lines.LineIndex().insert(docs.where("doc_id % 4 in (2, 3)"))
    assert key(index) == key(want)
    assert index.filters.count() == index.shards and index.filters.agg({"n": "sum"}).first()[0] == want.refs.count()
    assert index.probe(want.refs).where("not maybe").count() == 0
    unknown = lines.LineIndex().insert(part(0)).refs.join(want.refs, ["h1", "h2"], "left_anti")
    assert index.probe(unknown).where("maybe").count() <= 0.01 * unknown.count() + 1


def test_mixture_keeps_to_its_budget(docs):
    plan = mixing.mix_sources(docs, targets={r["source"] or "": 1.0 for r in docs.select("source").distinct().collect()}, plan=True).toPandas()
    total = mixing.mix_sources(docs, plan=True, alpha=1.0)["n_tokens"]
    assert total is not None
    used = (plan["n_tokens"] * plan["copies"]).groupby(plan["source"].fillna("")).sum()
    share = docs.select(mixing.word_count(docs["text"]).alias("n")).groupBy().sum("n").first()[0] / len(used)
    assert (used <= share).all()
    biggest = plan.groupby(plan["source"].fillna(""))["n_tokens"].max()
    assert (used > share - biggest - share * 0.2).all()


def test_vector_groups_equal_all_pairs(spark):
    """Pairs just above and just below the cosine, chains of them, and a third of all rows in one group of copies."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)

    def at(a: np.ndarray, cosine: float) -> np.ndarray:
        z = rng.normal(size=a.shape)
        z -= (z @ a) * a
        return cosine * a + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z)

    near = [at(a, c) for c in (0.951, 0.96, 0.99) for a in x[:150]]
    far = [at(a, 0.949) for a in x[150:300]]
    chain = [x[300]]
    for _ in range(20):
        chain.append(at(chain[-1], 0.97))
    rows = np.array([*x, *near, *far, *chain, *[x[400]] * 700]).astype(np.float32)
    order = rng.permutation(len(rows))
    rows = rows[order]
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")
    u = rows.astype(np.float64) / np.linalg.norm(rows, axis=1, keepdims=True)
    lead = vectors._adjacent_groups(u @ u.T >= 0.95)
    got = {r["vec_id"]: (r["rep_id"], r["kept"]) for r in vectors.near_duplicate_vectors(t).collect()}
    assert got == {i: (int(r), int(r) == i) for i, r in enumerate(lead)}
    assert len(set(lead)) < len(rows) - 1100


@pytest.mark.parametrize("most_parts", [1024, 7])
def test_recall_of_learned_partitions(spark, most_parts):
    """With one level and with two."""
    rng = np.random.default_rng(4)
    n, parts = 6000, 40
    x = rng.normal(size=(n, 16)) * 0.5 + rng.normal(size=(60, 16))[rng.integers(0, 60, n)] * 2
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    t = vectors.materialize(vectors.unit_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")))
    index = vectors.build_index(t, n, 10, sample_rows=2000, part_rows=n // parts, most_parts=most_parts)
    assert index.parts >= parts and (index.below > 1) == (most_parts < parts)
    assert index.probes[0] * index.probes[1] <= index.parts // 2 and index.recall >= 0.9  # where vectors have groups at all
    sizes = [r["count"] for r in index.base.groupBy("part").count().collect()]
    assert sum(sizes) == n and max(sizes) < 4 * n // parts
    s = x @ x.T
    np.fill_diagonal(s, -2)
    want = np.argsort(-s, axis=1)[:, :10]
    got: dict[int, set[int]] = {}
    asked = t.where(vectors.ASKED)
    for r in vectors.search(index, asked, asked.count(), n, 10).collect():
        got.setdefault(r["q"], set()).add(r["id"])
    assert len(got) == n // 50
    assert np.mean([len(g & set(want[i].tolist())) / 10 for i, g in got.items()]) >= 0.9


def test_salvage_finds_later_records():
    raw = [warc.page_record(i, f"http://a/{i}", f"page {i} " * 50) for i in range(6)]
    packed = [warc.member(r) for r in raw]
    broken = bytearray(packed[2])
    broken[len(broken) // 2] ^= 0xFF
    data = packed[0] + b"junk" + packed[1] + bytes(broken) + packed[3][:40] + packed[4] + raw[5]
    found = list(warc.salvage(data))
    assert [f.fields["X-Page-Id"] for f in found if f.fields] == ["0", "1", "4", "5"]
    spans = [(f.start, f.end) for f in found]
    assert spans[0][0] == 0 and spans[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    plain = raw[0] + raw[1].replace(b"page 1", b"PAGE 1", 1) + raw[2]
    assert [f.fields["X-Page-Id"] if f.fields else f.reason for f in warc.salvage(plain)] == ["0", "digest differs", "2"]
    assert len(list(warc.salvage(gzip.compress(raw[0] + raw[1])))) == 2


def test_pipeline_is_its_stages(spark, docs):
    kept = corpus_pipeline.quality_stage(spark, docs, SF)
    m = quality.fit_quality(docs, read(spark, SF, "labels"))
    pdf = docs.toPandas()
    scores = quality._sigmoid(m.logit(quality.features(V.of(pdf["text"].tolist()))))
    want = pdf[scores >= 0.5].sort_values("doc_id", kind="stable")
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(want["doc_id"])
    seen: set[str] = set()
    rows = []
    for doc_id, text in want[["doc_id", "text"]].itertuples(index=False):
        ls, out = text.split("\n"), []
        for x in ls:
            if not x.strip(" ") or x not in seen:
                out.append(x)
            if x.strip(" "):
                seen.add(x)
        if len(out) == len(ls) or "\n".join(out).strip(" "):
            rows.append((doc_id, "\n".join(out)))
    lined = corpus_pipeline.materialize(corpus_pipeline.line_stage(spark, kept, SF))
    assert sorted((r["doc_id"], r["text"]) for r in lined.collect()) == sorted(rows)
    unique = corpus_pipeline.materialize(corpus_pipeline.near_duplicate_stage(spark, lined, SF))
    now = dict(rows)
    before = dict(want[["doc_id", "text"]].itertuples(index=False))
    ids = [i for i in sorted(now) for _ in (0, 1)]
    sig = simhash.signatures(V.of([t for i in sorted(now) for t in (now[i], before[i])]))
    gone = {i for g in groups_of(sig, ids, simhash.MAX_BITS) for i in g - {min(g)}}
    assert gone
    assert {r["doc_id"] for r in unique.collect()} == set(now) - gone
    mixed = corpus_pipeline.mixing_stage(spark, unique, SF)
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(unique, plan=True).collect()}
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == plan
    final = corpus_pipeline.encoding_stage(spark, mixed, SF)
    assert final.where("not round_trip").count() == 0 and final.where("sample = 1").count() == sum(plan.values())
