"""Cases of the third round's findings."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb
import pytest

from loupe import config as cfg
from loupe.operators import duplicates, graph, security
from loupe.plans import registry
from loupe.sources.files import from_rows


def both(spark, folder, name, **tables):
    """Sorted rows of a query and of its SQL over tables (rows, schema)."""
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    got = registry.QUERIES[name](spark, str(folder))
    want = con.execute(registry.SQL[name])
    return sorted(map(tuple, got.select(*[c[0] for c in want.description]).collect())), sorted(want.fetchall())


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", ["security_findings", "findings_editor_rows", "findings_first", "findings_rules"])
def test_column_of_a_text_that_stands_twice_in_a_line(spark, tmp_path, name):
    line = "call (509) 555-6973 or, é, (509) 555-6973"
    got, want = both(spark, tmp_path, name, documents=([(7, line, "en", "s", len(line))], DOCS))
    assert got == want
    f = security.pattern_findings(from_rows(spark, [("a.py", line)]), cfg.DEFAULTS["analyzers"]["security"])
    assert sorted(r["column_number"] for r in f.collect()) == [7, 29]  # the analysis has the places of both


@pytest.fixture
def one_cut(monkeypatch):
    """Fails at the second checkpoint of a graph."""
    cut, left = graph._cut, [1]

    def once(df):
        assert left.pop(), "a second checkpoint"
        return cut(df)

    monkeypatch.setattr(graph, "_cut", once)


def paths(edges):
    """Pairs with a path, by search; nothing goes through a null."""
    to = {}
    for a, b in edges:
        to.setdefault(a, set()).add(b)
    found = set()
    for a in to:
        seen, todo = set(), list(to[a])
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += to.get(x, ()) if x is not None else ()
        found |= {(a, x) for x in seen}
    return found


CHAIN = [(i, i + 1) for i in range(150)] + [(150, 140), (200, 201), (300, 300), (301, 300)]
RANDOM = random.Random(3)


@pytest.mark.parametrize("edges", [CHAIN, [*CHAIN, (3, None), (None, 149), (10, 90), (10, 90)], [(RANDOM.randrange(60), RANDOM.randrange(60)) for _ in range(90)], [(5, 6)], [(None, 6), (5, None)]])
def test_reach_without_rounds(spark, one_cut, monkeypatch, edges):
    monkeypatch.setattr(graph, "SEEN", 500)
    got = [tuple(r) for r in graph.reach(spark.createDataFrame(edges, "src int, dst long")).collect()]
    assert len(got) == len(set(got)) and set(got) == paths(edges)


def test_reach_of_names_of_no_edges_and_in_rounds(spark):
    names = [(f"m{a}", f"m{b}") for a, b in CHAIN if a > 130] + [("m300", None)]
    e = spark.createDataFrame(names, "src string, dst string")
    assert set(map(tuple, graph.reach(e).collect())) == set(map(tuple, graph.reach(e, one_task=0).collect())) == paths(names)
    assert graph.reach(e.limit(0)).count() == 0


@pytest.mark.parametrize("ring", [2, 1000])
def test_components_of_a_long_chain_without_rounds(spark, one_cut, ring):
    e = spark.range(250_000).selectExpr("id + 7 as src", "id + 8 as dst").unionAll(spark.sql(f"select 250000L, 250000L - {ring} + 1"))
    got = graph.cycles(graph.scc(e)).collect()
    assert [(r["component"], r["n_modules"], r["severity"]) for r in got] == [(250_001 - ring, ring, "High" if ring == 2 else "Low")]


def plain_prints(text, k=17, w=4):
    """Winnowing by a plain loop, in hex."""
    words = re.findall(r"[a-zA-Z0-9_]+|[^a-zA-Z0-9_ \t\n\x0b\f\r]", text)
    g = [hashlib.md5(" ".join(words[i : i + k]).encode()).hexdigest()[:8] for i in range(len(words) - k + 1)]
    return {min(g[i : i + w]) for i in range(len(g) - w + 1)}


def test_prints_without_a_function_for_each_window(spark):
    words = " ".join(f"n{i}" for i in range(30))
    texts = [None, "", words, words + "\x0b\xa0é\U0001f600 # gone", " ".join(["a"] * 20), " ".join(["a"] * 19), "é-ü " * 30, f"  {words}\r\n#x\n\n {words}"]
    blocks = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "block_id int, content string")
    got = {}
    for r in (prints := duplicates.fingerprints(blocks)).collect():
        assert r["h"] not in got.setdefault(r["block_id"], set())
        got[r["block_id"]].add(r["h"])
    texts[3], texts[7] = words + "\x0b\xa0é\U0001f600", f"{words} {words}"
    assert got == {i: p for i, x in enumerate(texts) if x and (p := plain_prints(x))}
    assert "MapInArrow" in prints._jdf.queryExecution().executedPlan().toString()  # md5 in nested functions took nine times as long


@pytest.mark.parametrize("least", [0.0, 0.1, 0.5, 5 / 7])
def test_similar_pairs_by_brute_force(spark, least):
    rnd, sets = random.Random(5), {}
    for i in range(120):
        own = {rnd.randrange(-(1 << 31), 1 << 31) for _ in range(rnd.randrange(1, 30))}
        passage = set(range(100 * (i % 7), 100 * (i % 7) + rnd.choice([0, 3, 20, 40])))
        sets[i] = own | passage | (set(rnd.sample(sorted(sets[i - 1]), len(sets[i - 1]) * 3 // 4)) if i % 3 == 1 else set())
    want = {(a, b, len(x & y)) for a, x in sets.items() for b, y in sets.items() if a < b and x & y and len(x & y) / len(x | y) >= least}
    rows = spark.createDataFrame([(i, sorted(x)) for i, x in sets.items()], "block_id int, prints array<int>")
    got = [(r["a"], r["b"], r["shared"]) for r in duplicates.jaccard_pairs(rows, least=least).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    other = {(a, b, len(x & y)) for a, x in sets.items() for b, y in sets.items() if b % 10 == 0 and x & y and len(x & y) / len(x | y) >= least}
    for most in (1_000_000, 0):
        duplicates.BROADCAST_ROWS, was = most, duplicates.BROADCAST_ROWS
        assert {(r["a"], r["b"], r["shared"]) for r in duplicates.jaccard_pairs(rows, rows.where("block_id % 10 = 0"), least).collect()} == other
        duplicates.BROADCAST_ROWS = was


def test_blocks_of_too_few_common_prints_are_no_candidates(spark):
    rows = spark.createDataFrame([(1, list(range(100))), (2, list(range(95, 195))), (3, list(range(90, 300)))], "block_id int, prints array<int>")
    # with 1: five and ten in common, of the ten that it needs; all but one of 2's are also 3's
    got = {r["block_id"]: (len(r["hs"]), len(r["prefix"])) for r in duplicates._shareable(rows, 0.1).collect()}
    assert got == {1: (10, 1), 2: (100, 91), 3: (105, 85)}


@pytest.mark.parametrize("name", ["dup_jaccard_pairs", "dup_score_pairs"])
def test_pairs_without_documents_of_no_source(spark, tmp_path, name):
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words), " ".join(words), " ".join(words[:190] + ["x"] * 10), " ".join(words[:100]), " ".join(words[:150]), "short one", None]
    rows = [(i, x, "en", None if i in (1, 4) else "s", 1) for i, x in enumerate(texts)]
    got, want = both(spark, tmp_path, name, documents=(rows, DOCS))
    assert got == want and got


def test_against_others_without_a_shuffle_of_prints(spark):
    rows = spark.createDataFrame([(i, list(range(i, i + 9))) for i in range(20)], "block_id int, prints array<int>")
    p = duplicates.jaccard_pairs(rows, rows.where("block_id = 3"))
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning(") == 1  # only of counts
    assert {(r["a"], r["shared"]) for r in p.collect()} == {(i, 9 - abs(i - 3)) for i in range(12)}
