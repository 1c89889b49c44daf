"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loupe.llm import lines, mixing, ngrams, quality, sentencepiece, simhash, toxicity, vectors, warc
from loupe.llm import textvec as V

LONG = "calm river walks past old mills " * 6000
DOCS = [
    (1, "the quick fox\nshared line here\nends", "en", "a", 10), (1, "the quick fox\nshared line here\nends", "en", "a", 10), (2, None, "en", "a", None), (3, "", None, None, 0), (4, "  \n \n", "en", "b", 5),
    (None, "no id has this text\nshared line here", "en", None, 3), (None, None, None, None, None), (5, LONG, "en", "b", len(LONG)), (6, LONG, "en", "b", len(LONG)), (7, "shared line here", "de", "c", 16), (8, "ünï çödé \U0001f600 #### 123", "fr", "c", 4),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "sig rep n key gone_id did th drop n_lines n_dropped mix_source n_tokens weight sample_key copies again cut_s epochs edge last quality_score toxicity chunk s k b".split()


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(DOCS, SCHEMA)
    return d.withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (7, 0, 1), (8, 0, 0), (None, 1, 1), (2, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int")


def same_rows(df) -> None:
    assert sorted(df.select(F.coalesce("doc_id", F.lit(-1))).toPandas().iloc[:, 0]) == sorted(-1 if r[0] is None else r[0] for r in DOCS)


def test_quality(docs, empty, labels):
    m = quality.fit_quality(docs, labels)
    out = quality.score_quality(docs, m)
    assert "quality_score_" in out.columns
    same_rows(out)
    scores = [tuple(r) for r in out.where("doc_id in (1, 5, 6)").select("text", "quality_score_").distinct().collect()]
    assert len(scores) == 2  # copies score alike
    assert quality.keep_good(empty, quality.fit_quality(empty, labels)).count() == 0


def test_lines(docs, empty):
    out, index = lines.dedup_lines(docs)
    same_rows(out)
    got = {(r["doc_id"], r["text"]): (r["n_lines_"], r["n_dropped_"]) for r in out.collect()}
    assert got[1, DOCS[0][1]] == (3, 0)  # both rows keep the first places
    assert got[2, None] == (0, 0) and got[3, ""] == (1, 0) and got[4, "  \n \n"] == (3, 0)
    assert got[None, "no id has this text"] == (2, 1)  # null ids come last
    assert got[7, ""] == (1, 1) and got[6, ""] == (1, 1) and got[5, LONG] == (1, 0)
    assert lines.dedup_lines(empty)[0].count() == 0


def test_simhash(docs, empty):
    pairs = {(r["doc_id"], r["rep"]) for r in simhash.near_duplicates(docs).collect()}
    assert pairs == {(5, 5), (6, 5)}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(DOCS) - 1 and kept.where("doc_id = 6").count() == 0
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty, earlier=docs).count() == 0
    words = [f"w{i * 7919 % 1000}" for i in range(60)]
    a, b, c = " ".join(words), " ".join(words[:59] + ["other"]), " ".join(reversed([w + "x" for w in words]))
    rows = [(1, a), (2, b), (2, c), (3, c), (4, "short one")]
    two = {(r["doc_id"], r["rep"]) for r in simhash.near_duplicates(docs.sparkSession.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert two == {(1, 1), (2, 1), (3, 1)}  # document 2 has two texts, and links what they are near to
    left = docs.sparkSession.createDataFrame([(1, a), (2, "only this line is left of it"), (9, "only this")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(left, earlier=docs.sparkSession.createDataFrame(rows, "doc_id long, text string")).collect()) == [1, 9]


def test_mixing(docs, empty):
    plan = mixing.mix_sources(docs, targets={"a": 1, "b": 1, "c": 1, "": 1}, budget=10**6, plan=True)
    assert {"n_tokens_", "weight_", "sample_key_", "copies_"} <= set(plan.columns)
    got = {(r["doc_id"], r["text"]): r["copies_"] for r in plan.collect()}
    assert got[1, DOCS[0][1]] == 25000 and got[7, "shared line here"] == 31250  # a quarter of the budget over 10 and over 8 tokens
    assert mixing.mix_sources(docs).columns == docs.columns
    assert mixing.mix_sources(empty).count() == 0 and mixing.mix_sources(empty, targets={}).count() == 0
    assert mixing.mix_sources(docs, targets={}).where("length(text) > 0").count() == 0  # texts without words may stand in a budget of 0


def test_sentencepiece(docs, empty):
    out = sentencepiece.encode(docs, k=3, carry=("doc_id", "text", "key", "sig"))
    rows = sentencepiece.decode(out).collect()
    assert {r["doc_id"] for r in rows} == {r[0] for r in DOCS}
    assert all(r["decoded"] == (r["text"] or "") and r["round_trip"] for r in rows)
    one = [r for r in rows if r["doc_id"] == 1]
    assert len(one) == 6 and len({tuple(r["ids"]) for r in one}) == 3  # repeated rows draw the same
    assert [r["sample"] for r in rows if r["doc_id"] == 2] == [1]
    clash = docs.select("doc_id", "text", *[F.lit("x").alias(c) for c in ("sample", "ids", "LOG_PROB", "perturbed", "log_inclusion", "round_trip", "text_", "key_")])
    named = sentencepiece.encode(clash, carry=tuple(clash.columns))
    assert {"sample_", "ids_", "log_prob_", "round_trip_"} <= set(named.columns) and named.where("sample <> 'x' or not round_trip_").count() == 0
    assert sentencepiece.encode(empty).count() == 0
    spark = docs.sparkSession
    assert [r["decoded"] for r in sentencepiece.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>")).collect()] == [None, ""]


def test_lm(docs, empty):
    out = ngrams.lm_scores(docs)
    same_rows(out)
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[2]["n_tokens"] == got[3]["n_tokens"] == got[4]["n_tokens"] == 0 and got[2]["mean_log_score"] is None and got[2]["log_score"] == 0
    assert got[5]["log_score"] == got[6]["log_score"]
    assert ngrams.lm_scores(empty).count() == 0
    small = ngrams.lm_scores(docs.repartition(3), chunk_bytes=50_000, part_bytes=20_000)
    assert small.count() == len(DOCS)
    same = docs.where("doc_id = 7").unionByName(docs.where("doc_id = 7"))
    assert ngrams.lm_scores(same).count() == 2  # two partitions of the same rows
    assert small.exceptAll(out).where("n_tokens < 100").count() == 0


def test_toxicity(docs, empty, labels):
    m = toxicity.fit_toxicity(docs, labels)
    out = toxicity.score_toxicity(docs, m)
    assert "toxicity_" in out.columns
    same_rows(out)
    assert all(r["t"]["score"] == 0 and r["t"]["spans"] == [] for r in out.where("text is null or trim(replace(text, '\n', '')) = ''").select(F.col("toxicity_").alias("t")).collect())
    assert toxicity.score_toxicity(empty, toxicity.fit_toxicity(empty, labels)).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0]), (None, [1.0, 0.0]), (1, [1.0, 0.0]), (10, [1.0, None]), (11, [2.0, 0.0])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in ("id", "v", "cell", "rep_id", "kept", "rank", "cosine", "neighbour_id", "part", "d")})
    got = {r["vec_id"]: (r["rep_id"], r["kept"]) for r in vectors.near_duplicate_vectors(t).collect()}
    assert got == {1: (1, True), 2: (1, False), 11: (1, False)} | {i: (i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10)}
    nn = vectors.nearest_neighbours(t, k=2).collect()
    assert [(r["rank"], r["neighbour_id"]) for r in sorted(nn, key=lambda r: (r["vec_id"], r["rank"])) if r["vec_id"] == 1] == [(1, 11), (2, 2)]
    assert {r["vec_id"] for r in nn} == {1, 2, 3, 11}
    none = t.where("false")
    assert vectors.near_duplicate_vectors(none).count() == 0 and vectors.nearest_neighbours(none).count() == 0


def test_warc(spark):
    pages = [(1, "http://a/1", "<p>x\r\n\r\ny</p>"), (2, None, None), (None, "http://a/3", ""), (4, "http://a/4", "z" * 300_000), (1, "http://a/1", "<p>x\r\n\r\ny</p>")]
    t = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("file", F.lit("x"))
    back = warc.pages_from_warc(warc.salvage_blobs(warc.pages_to_warc(t, junk_every=2)))
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(map(repr, pages))
    assert warc.salvage_blobs(spark.createDataFrame([("a", None), ("b", b"")], "file string, data binary")).count() == 0
    assert warc.pages_to_warc(t.where("false")).count() == 0


@pytest.mark.parametrize("n", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, docs, empty, labels, tmp_path, n):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stage = corpus_pipeline.STAGES[n][1]
    plain = docs.select(*SCHEMA.replace("long", "").replace("string", "").replace(" ", "").split(","))
    plain.write.parquet(f"{tmp_path}/documents.parquet")
    out = stage(spark, plain, str(tmp_path))
    if n < 4:
        assert out.columns == plain.columns
    assert out.count() > 0
    assert stage(spark, empty, str(tmp_path)).count() == 0


def test_texts_pieces_hold_whole_texts():
    import pyarrow as pa

    parts = list(V.pieces(pa.array(["a" * 10, None, "", "b" * 50, "c"]), 20))
    assert sum(len(p) for p in parts) == 5
    assert [bytes(p.data[s:e]).decode() for p in parts for s, e in zip(p.start, p.end, strict=True)] == ["a" * 10, "", "", "b" * 50, "c"]
