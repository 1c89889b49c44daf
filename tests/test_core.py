"""The engine's own queries against DuckDB, and what has no SQL: reports, configuration, streams, imports."""

from __future__ import annotations

import json
import math
import subprocess
import sys
from pathlib import Path
from xml.etree import ElementTree

import duckdb
import pytest
from pyspark.sql import functions as F

from loupe import config as cfg
from loupe.functions.text import match_columns
from loupe.model import findings
from loupe.operators import duplicates, graph, security
from loupe.operators import findings as ops
from loupe.plans import analyze as whole
from loupe.plans import fixture, registry
from loupe.sinks import reports
from loupe.sources.files import from_rows, scan, scan_statistics
from loupe.streaming import incremental

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def shown(v: object) -> str:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return "[" + ",".join(map(shown, v)) + "]" if isinstance(v, list | tuple) else str(v)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    assert sorted("|".join(shown(r[c]) for c in order) for r in got.collect()) == sorted("|".join(shown(r[names.index(c)]) for c in order) for r in want.fetchall())


@pytest.fixture(scope="module")
def found(spark):
    return whole.analyze(spark, from_rows(spark, fixture.FILES), root="proj").coalesce(2).persist()


def test_whole_analysis_and_reports(found):
    rules = {r["rule_id"] for r in found.collect()}
    assert {"python-security-eval", "circular-import-detected", "dead-code-import", "python-syntax-error"} <= rules
    n = found.count()
    doc = json.loads(reports.render(found, "json"))
    assert doc["statistics"]["total_findings"] == len(doc["findings"]) == n
    sarif = json.loads(reports.render(found, "sarif"))
    assert len(sarif["runs"][0]["results"]) == n and sarif["version"] == "2.1.0"
    assert len(ElementTree.fromstring(reports.render(found, "xml")).findall("finding")) == n
    assert "proj/main.py" in reports.render(found, "console", colors=False)
    assert ops.exit_code(found).first()["exit_code"] == 2
    with pytest.raises(ValueError):
        reports.render(found, "pdf")


def test_reports_hold_all_findings_or_say_how_many_are_left_out(found, tmp_path):
    n = found.count()
    doc = json.loads(reports.render(found, "json", most=3))
    assert len(doc["findings"]) == 3 and doc["omitted_findings"] == n - 3 and doc["statistics"]["total_findings"] == n
    assert json.loads(reports.render(found, "sarif", most=3))["runs"][0]["invocations"][0]["properties"]["omittedResults"] == n - 3
    assert ElementTree.fromstring(reports.render(found, "xml", most=3)).get("omitted") == str(n - 3)
    assert len(json.loads(reports.render(found, "ide"))) == reports.render(found, "html").count("<tr>") == n
    reports.save(found, "xml", str(tmp_path / "all.xml"))
    assert len(ElementTree.parse(tmp_path / "all.xml").getroot()) == n
    reports.write_parts(found, "sarif", str(tmp_path / "parts"))
    assert found.sparkSession.read.json(str(tmp_path / "parts")).count() == n


def test_a_folder_through_scan_and_run(spark, tmp_path):
    (tmp_path / "p" / "build").mkdir(parents=True)
    for name, text in (("broken.py", b"def broken(\n    # no close\n"), ("bad.py", b"x = 'a\xffb'\n"), ("s.py", b"k = 'AKIA" + b"Q" * 16 + b"'\n"), ("build/t.py", b"eval('1' + x)\n"), (".h.py", b"x\n"), ("big.py", b"#" * (1 << 21)), ("n.unknown", b"x")):
        (tmp_path / "p" / name).write_bytes(text)
    with pytest.warns(UserWarning, match="no such path"):
        files = scan(spark, [str(tmp_path / "p"), str(tmp_path / "none")], cfg.DEFAULTS)
    assert {r["file_path"].rsplit("/", 1)[1]: r["content"] for r in files.collect()}.keys() == {"broken.py", "bad.py", "s.py"}
    assert [r["content"] for r in files.where("file_path like '%bad.py'").collect()] == ["x = 'ab'\n"]
    assert "length" in files._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1].split("]")[0]
    with pytest.raises(ValueError, match="no such path"), pytest.warns(UserWarning):
        scan(spark, str(tmp_path / "none"))
    text, code = whole.run(spark, str(tmp_path / "p"), "json", output=str(tmp_path / "r.json"), analyzers="security")
    assert code == 2 and json.loads(text) == json.loads((tmp_path / "r.json").read_text())
    assert {(f["file_path"].rsplit("/", 1)[1], f["rule_id"]) for f in json.loads(text)["findings"]} == {("broken.py", "python-syntax-error"), ("s.py", "security-pattern-cwe-798")}
    assert "\x1b" not in whole.run(spark, files, config=cfg.load(output__colors=False), analyzers="security")[0]
    with pytest.raises(ValueError, match=r"output\.format"):
        whole.run(spark, files, config=cfg.load(output__format="pdf"))
    assert scan_statistics(files).first()["n_files"] == 3


def test_exit_codes_by_policy(spark):
    def codes(*severities: str) -> list[int]:
        f = findings(spark.createDataFrame([(s,) for s in severities], "s string"), {"severity": F.col("s"), "rule_id": "r", "file_path": "f"})
        return [ops.exit_code(f, p).first()["exit_code"] for p in ("mixed", "security", "simple")]

    assert codes("Critical") == [2, 2, 0] and codes("High") == [1, 1, 1] and codes(*["Medium"] * 6) == [1, 0, 1] and codes("Low") == [0, 0, 0]


@pytest.mark.parametrize("one_task", [graph.ONE_TASK, 0])
def test_components_in_one_task_and_in_rounds(spark, one_task):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 4), (7, 1), (6, 8), (8, 9), (9, 8), (10, 10), (None, 1)]
    got = {(r["node"], r["component"]) for r in graph.scc(spark.createDataFrame(edges, "src long, dst long"), one_task=one_task).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4), (8, 8), (9, 8)}


def test_copies_make_as_many_pairs_as_blocks(spark):
    text = " ".join(f"name{i}" for i in range(40))
    rows = [(i, "f/1" if i < 2 else f"f/{i}", 1 + i % 2, 9, text) for i in range(30)]
    blocks = spark.createDataFrame(rows, "block_id long, file_path string, start_line int, end_line int, content string")
    pairs = {(r["block_id_a"], r["block_id_b"]) for r in duplicates.exact_pairs(blocks).collect()}
    assert len(pairs) == 29 and (0, 1) not in pairs  # those two are within three lines of one file
    assert {i for p in pairs for i in p} == set(range(30))
    scored = duplicates.scored_pairs(blocks).collect()
    assert {(r["a"], r["b"], r["score"]) for r in scored} == {(0, i, 1.0) for i in range(1, 30)}


def test_configuration():
    c = cfg.load()
    assert set(cfg.select()) == set(cfg.ANALYZERS) and cfg.select(security_only=True) == ["security"]
    assert cfg.get(c, "analyzers.duplicates.min_lines") and cfg.get(c, "no.such", 7) == 7


def test_odd_files(spark):
    rows = [("a.py", None), ("b.py", ""), ("c.py", "x = 'AKIA" + "Q" * 16 + "'\r\n"), ("c.py", "x = 'AKIA" + "Q" * 16 + "'\r\n"), ("d.txt", "word " * 50_000)]
    f = security.pattern_findings(from_rows(spark, rows), cfg.DEFAULTS["analyzers"]["security"])
    assert [(r["file_path"], r["line_number"], r["column_number"]) for r in f.collect()] == [("c.py", 1, 6)] * 2
    assert ops.dedupe(f).count() == 1
    assert security.pattern_findings(from_rows(spark, []), {}).count() == 0


def test_places_of_matches(spark):
    got = spark.createDataFrame([("aa b aa",)], "line string").select(match_columns("line", "a+").alias("m")).first()["m"]
    assert [(m["text"], m["column"]) for m in got] == [("aa", 1), ("aa", 6)]


def test_stream_finds_what_a_batch_finds(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "k.py").write_text("k = 'AKIA" + "Z" * 16 + "'\n")
    rule = lambda b: incremental.stateless_findings(b, cfg.DEFAULTS["analyzers"]["security"])
    for i in range(2):  # nothing is found twice, not even in a file that comes again
        (tmp_path / "in" / f"more{i}").mkdir()
        (tmp_path / "in" / f"more{i}" / "k.txt").write_text("k = 'AKIA" + "Y" * 16 + "'\n")
        rule = lambda b: incremental.stateless_findings(b.withColumn("file_path", F.regexp_replace("file_path", ".*/", "")), cfg.DEFAULTS["analyzers"]["security"])
        incremental.analyse_stream(incremental.file_stream(spark, str(tmp_path / "in")), str(tmp_path / "state"), rule, str(tmp_path / "out")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert [r["rule_id"] for r in out.where(F.col("category") == "security").collect()] == ["security-pattern-cwe-798"] * 2


def test_queries_can_be_listed_without_a_session():
    root = Path(__file__).parents[1]
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()), set(e.oracle_sql()) <= set(e.queries()))"], cwd=root, capture_output=True, text=True, timeout=120)
    n, known = said.stdout.split()
    assert int(n) >= len(registry.QUERIES) and known == "True"
