"""Queries over a small project of Python and JavaScript sources; what they must give is written out as rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe import config as cfg
from loupe.sources.facts import facts
from loupe.sources.files import from_rows

FILES: list[tuple[str, str | None]] = [
    ("proj/main.py", 'import os\nimport pickle\nfrom pkg import alpha\n\ndef run(cmd):\n    os.system("ls " + cmd)\n    return alpha.first(eval("1+" + cmd))\n'),
    ("proj/pkg/__init__.py", ""),
    (
        "proj/pkg/alpha.py",
        '"""Alpha module."""\nimport json\nimport pkg.beta\n\nMAX_SIZE = 10\nlimit = 5\n\ndef first(x):\n    """Return x doubled.\n\n    Args:\n        x (int): value\n        y (int): not a parameter\n\n    Returns:\n        doubled value\n    """\n'
        '    if x > 1 and x < 10 or x == 50:\n        for i in range(x):\n            while i:\n                with open("f") as f:\n                    try:\n                        i -= 1\n                    except ValueError:\n                        pass\n    return pkg.beta.second(x)\n',
    ),
    ("proj/pkg/beta.py", 'import pkg.gamma\n\nclass bad_name:\n    def BadMethod(self, value: str) -> str:\n        return value\n\ndef second(n):\n    return pkg.gamma.third(n)\n\ndef unused_helper():\n    """x"""\n    return 1\n'),
    ("proj/pkg/gamma.py", "import pkg.alpha\n\ndef third(n):\n    return pkg.alpha.MAX_SIZE + n\n"),
    ("proj/broken.py", "def broken(\n    # no close\n"),
    ("proj/web/app.js", "var x = 1;\nconsole.log(x);\nlet y = 2;\n"),
]


def project(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    files = from_rows(spark, FILES)
    return files, facts(files)


def _values(columns: str, rows: list[tuple]) -> str:
    def lit(v: object) -> str:
        return "null" if v is None else f"'{v}'" if isinstance(v, str) else str(v)

    return f"select * from (values {', '.join('(' + ', '.join(lit(v) for v in r) + ')' for r in rows)}) t({columns})"


def register(add: Callable[..., None], _: object) -> None:
    from loupe.operators import deadcode, docs, graph, security, visitors

    section = cfg.DEFAULTS["analyzers"]
    short = lambda c: F.replace(c, F.lit("proj/"), F.lit(""))
    place = lambda: [short(F.col("file_path")).alias("file"), F.col("line_number").alias("line"), "rule_id", "severity"]

    def over(pick: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda s, d: pick(*project(s))

    add("ast_parse_errors", over(lambda f, x: x.where("kind = 'parse_error'").select(short(F.col("file_path")).alias("file"), "line")), _values("file, line", [("broken.py", 1)]))
    add(
        "ast_complexity", over(lambda f, x: x.where("kind = 'function'").select("name", F.col("attrs")["complexity"].cast("int").alias("complexity"), F.col("attrs")["depth"].cast("int").alias("depth"))),
        _values("name, complexity, depth", [("run", 1, 0), ("first", 7, 5), ("BadMethod", 1, 0), ("second", 1, 0), ("unused_helper", 1, 0), ("third", 1, 0)]),
    )
    add("complexity_findings", over(lambda f, x: visitors.complexity_findings(x, section["visitors"]).select(*place())), _values("file, line, rule_id, severity", [("pkg/alpha.py", 8, "python-complexity-nesting", "Medium")]))
    add("naming_findings", over(lambda f, x: visitors.naming_findings(x).select(*place())), _values("file, line, rule_id, severity", [("pkg/alpha.py", 6, "python-style-constant-naming", "Low"), ("pkg/beta.py", 3, "python-style-class-naming", "Medium"), ("pkg/beta.py", 4, "python-style-function-naming", "Medium")]))
    add("imports_unused", over(lambda f, x: visitors.unused_imports(x).select(short(F.col("file_path")).alias("file"), "name")), _values("file, name", [("main.py", "pickle"), ("pkg/alpha.py", "json")]))
    add("javascript_findings", over(lambda f, x: visitors.javascript_findings(f).select(*place())), _values("file, line, rule_id, severity", [("web/app.js", 1, "js-style-var-usage", "Medium"), ("web/app.js", 2, "js-style-console-log", "Low")]))
    add("ast_security_findings", over(lambda f, x: security.call_findings(x).select(*place())), _values("file, line, rule_id, severity", [("main.py", 2, "python-security-pickle-import", "Medium"), ("main.py", 7, "python-security-eval", "Critical")]))
    add("core_security_findings", over(lambda f, x: visitors.core_security_findings(x).select(*place())), _values("file, line, rule_id, severity", [("main.py", 2, "python-security-pickle-import", "Medium"), ("main.py", 6, "python-security-os-system", "High"), ("main.py", 7, "python-security-eval", "High")]))
    add(
        "module_edges", over(lambda f, x: graph.edges(graph.imports(x), graph.modules(f, "proj")).select("src", "dst")),
        _values("src, dst", [("main", "pkg"), ("pkg.alpha", "pkg.beta"), ("pkg.beta", "pkg.gamma"), ("pkg.gamma", "pkg.alpha")]),
    )
    add("circular_findings", over(lambda f, x: graph.circular_findings(f, x, {"root": "proj"}).select(*place())), _values("file, line, rule_id, severity", [("pkg/alpha.py", 3, "circular-import-detected", "Medium"), ("pkg/beta.py", 1, "circular-import-detected", "Medium"), ("pkg/gamma.py", 1, "circular-import-detected", "Medium")]))
    add("dead_symbols", over(lambda f, x: deadcode.deadcode_findings(f, x, section["deadcode"]).select(*place())), _values("file, line, rule_id, severity", [("pkg/alpha.py", 2, "dead-code-import", "Low"), ("pkg/beta.py", 4, "dead-code-function", "Medium")]))
    add(
        "dead_symbols_all", over(lambda f, x: deadcode.dead_symbols(f, x, section["deadcode"] | {"exclude_public_api": False}).select("name", "symbol_type")),
        _values("name, symbol_type", [("json", "import"), ("BadMethod", "function"), ("first", "function"), ("MAX_SIZE", "variable"), ("limit", "variable"), ("second", "function"), ("unused_helper", "function"), ("bad_name", "class"), ("third", "function")]),
    )
    add(
        "doc_findings", over(lambda f, x: docs.docs_findings(x, section["docs"]).select(short(F.col("file_path")).alias("file"), "rule_id")),
        _values("file, rule_id", [
            ("main.py", "DOC001"), ("pkg/__init__.py", "DOC001"), ("pkg/beta.py", "DOC001"), ("pkg/gamma.py", "DOC001"), ("main.py", "missing-function-docstring"), ("pkg/beta.py", "missing-function-docstring"), ("pkg/gamma.py", "missing-function-docstring"),
            ("pkg/beta.py", "missing-function-docstring"), ("pkg/beta.py", "short-function-docstring"), ("pkg/alpha.py", "extra-parameter-doc"), ("pkg/beta.py", "missing-class-docstring"),
        ]),
    )
    add("analyze_project", _whole, None)


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loupe.plans.analyze import analyze

    return analyze(spark, from_rows(spark, FILES), root="proj").groupBy("category", "severity").agg(F.count("*").alias("n"))
