"""Queries over a second small project, in which each rule that the first leaves out fires once, beside a near miss that must not. What they must give is written out as rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe import config as cfg
from loupe.operators import deadcode, docs, duplicates, graph, security, visitors
from loupe.plans.fixture import _values
from loupe.sources.facts import facts
from loupe.sources.files import from_rows

_DOCS = '''"""Documented functions."""


def google(a: int, b: str) -> int:
    """Adds what is given.

    Args:
        a (str): a number, of the wrong type here

    Returns:
        the sum
    """
    return a


def sphinx(a, b):
    """Joins both of them.

    :param a: the first
    :type a: int
    :param b: the second
    :returns: both
    """
    return a + b


def numpy(a, b) -> int:
    """Numbers of two things.

    Parameters
    ----------
    a : int
        the first
    b : int
        the second
    """
    return a


def example():
    """Shows a call.

    >>> example(
    """


def fine():
    """Shows a call.

    >>> fine()
    """


class Known:
    """A class."""

    def _private(self):
        return 1
'''
_BRANCHES = "\n".join(f"    if x == {i}:\n        return {i}" for i in range(10))
FILES: list[tuple[str, str | None]] = [
    ("lib/docs.py", _DOCS),
    ("lib/src/__init__.py", ""),
    ("lib/src/shop/__init__.py", "from . import cart\n"),
    ("lib/src/shop/cart.py", "from .price import cost\nfrom ..tools import helper\nimport shop.price\nimport requests\n\ntotalCost = cost()\ntotal_cost = helper()\n"),
    ("lib/src/shop/price.py", "import typing\n\n\ndef cost():\n    from .cart import totalCost\n    return totalCost\n"),
    ("lib/src/tools.py", f"def many(x):\n{_BRANCHES}\n\n\ndef few(x):\n" + _BRANCHES.rsplit("\n", 2)[0] + "\n\n\ndef helper():\n    return many(few(1))\n"),
    ("lib/hooks.py", "import app\n\n__all__ = ['shown']\n\n\n@app.route('/')\ndef page():\n    return 1\n\n\n@cached\ndef kept():\n    return 1\n\n\ndef shown():\n    return 1\n\n\ndef _hidden():\n    return 1\n\n\ndef on_start():\n    return 1\n"),
    ("lib/star.py", "from os.path import *\nfrom shop import cart\n\nprint(cart)\n"),
    ("lib/keys.py", 'admin = "admin@example.com"\nmail = "someone@corp.org"\nk = "aB3$kL9#mN2@pQ7!rS5%tU8^vW1&xY4*zC6"\nplain = "aaaaaaaaaaaaaaaaaaaaaaaaaaaa"\n'),
    ("lib/lost.py", None),
    ("lib/notes.txt", 'eval("1+" + x)\n'),
]


def register(add: Callable[..., None]) -> None:
    section = cfg.DEFAULTS["analyzers"]
    short = lambda c="file_path": F.replace(F.col(c), F.lit("lib/"), F.lit("")).alias("file")
    place = lambda: [short(), F.col("line_number").alias("line"), "rule_id", "severity"]

    def over(pick: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            files = from_rows(spark, FILES)
            return pick(files, facts(files))

        return run

    rows = "file, line, rule_id, severity"
    add("rules_complexity", over(lambda f, x: visitors.complexity_findings(x, section["visitors"]).select(*place())), _values(rows, [("src/tools.py", 1, "python-complexity-cyclomatic", "Medium")]))
    add("rules_naming", over(lambda f, x: visitors.naming_findings(x).where("rule_id = 'python-style-variable-naming'").select(*place(), "context", "code_snippet")), _values(rows + ", context, code_snippet", [("src/shop/cart.py", 6, "python-style-variable-naming", "Low", "totalCost = cost()", "totalCost = cost()")]))
    add("rules_star_import", over(lambda f, x: visitors.import_findings(x).where("rule_id = 'python-imports-star'").select(*place())), _values(rows, [("star.py", 1, "python-imports-star", "Low")]))
    add(
        "rules_edges", over(lambda f, x: graph.edges(graph.imports(x), graph.modules(f, "lib")).select("src", "dst", "line")),
        _values("src, dst, line", [
            ("src.shop.cart", "src.shop.price", 1), ("src.shop.cart", "src.tools", 2), ("src.shop.price", "src.shop.cart", 5), ("star", "src.shop", 2),
        ]),
    )
    add(
        "rules_external_edges", over(lambda f, x: graph.edges(graph.imports(x), graph.modules(f, "lib"), external=True).where("dst in ('requests', 'typing', 'app', 'os.path')").select("src", "dst")),
        _values("src, dst", [("src.shop.cart", "requests"), ("src.shop.price", "typing"), ("hooks", "app"), ("star", "os.path")]),
    )
    add("rules_layers", over(lambda f, x: graph.forbidden(graph.edges(graph.imports(x), graph.modules(f, "lib")), [("star", "src.shop")]).select("src", "dst")), _values("src, dst", [("star", "src.shop")]))
    add(
        "rules_docs", over(lambda f, x: docs.docs_findings(x.where("file_path = 'lib/docs.py'"), section["docs"] | {"enforce_style": True, "check_private_methods": True}).select(F.col("line_number").alias("line"), "rule_id", "severity")),
        _values("line, rule_id, severity", [
            (5, "missing-parameter-doc", "Medium"), (5, "type-annotation-mismatch", "Low"), (17, "docstring-style-mismatch", "Low"), (28, "docstring-style-mismatch", "Low"), (28, "missing-return-doc", "Medium"),
            (41, "docstring-style-mismatch", "Low"), (41, "invalid-docstring-example", "Low"), (48, "docstring-style-mismatch", "Low"), (57, "missing-function-docstring", "Low"),
        ]),
    )
    add(
        "rules_dead_code", over(lambda f, x: deadcode.deadcode_findings(f, x, section["deadcode"]).where("file_path = 'lib/hooks.py'").select(*place())),
        _values(rows, [("hooks.py", 12, "dead-code-function", "Low"), ("hooks.py", 20, "dead-code-function", "Low")]),
    )
    add(
        "rules_secrets", over(lambda f, x: security.security_findings(f, None, section["security"]).select(*place(), F.col("column_number").alias("col"))),
        _values(rows + ", col", [("keys.py", 2, "security-pattern-cwe-200", "Medium", 9), ("keys.py", 3, "security-entropy-high", "High", 6), ("lost.py", 1, "file-read-error", "Low", 0)]),
    )
    add(
        "rules_blocks", over(lambda f, x: duplicates.python_blocks(x.where("file_path = 'lib/src/tools.py'"), section["duplicates"]).select("block_id")),
        _values("block_id", [("lib/src/tools.py:1:21:function",), ("lib/src/tools.py:24:42:function",)]),
    )
