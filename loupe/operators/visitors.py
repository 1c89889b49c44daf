"""Complexity, nesting, naming, unused imports and JavaScript line rules."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loupe.functions.text import lines
from loupe.model import JAVASCRIPT, findings, union
from loupe.sources.files import suffix

SNAKE = "^[a-z_][a-z0-9_]*$"
PASCAL = "^[A-Z][a-zA-Z0-9]*$"
_AT = {"file_path": "file_path", "line_number": "line", "column_number": "col", "end_line": "end_line", "end_column": "end_col"}
_TEXT = {"context": "context", "code_snippet": "code"}


def _at() -> dict[str, Column]:
    return {k: F.col(v) for k, v in _AT.items()} | {k: F.coalesce(F.col("attrs")[v], F.lit("")) for k, v in _TEXT.items()}


def _num(key: str) -> Column:
    return F.col("attrs")[key].cast("int")


def complexity_findings(facts: DataFrame, config: dict[str, Any]) -> DataFrame:
    """Functions above the limits of cyclomatic complexity (not async ones) and of nesting."""
    most, deep = config.get("max_complexity", 10), config.get("max_depth", 4)
    f = facts.where("kind = 'function' and attrs['is_async'] = 'false'").withColumns({"complexity": _num("complexity"), "depth": _num("depth")})
    text = lambda what, c, n: F.format_string(f"Function '%s' has {what} of %d (max: {n})", F.col("name"), c)
    base = _at() | {"category": "complexity", "severity": "Medium"}
    return union([
        findings(f.where(F.col("complexity") > most), base | {"rule_id": "python-complexity-cyclomatic", "message": text("cyclomatic complexity", F.col("complexity"), most), "suggestion": "Split the function"}),
        findings(f.where(F.col("depth") > deep), base | {"rule_id": "python-complexity-nesting", "message": text("nesting depth", F.col("depth"), deep), "suggestion": "Move nested logic out"}),
    ])


def naming_findings(facts: DataFrame) -> DataFrame:
    name = F.col("name")
    upper = (F.upper("name") == name) & (F.lower("name") != name)
    a = facts.where("kind = 'assign' and attrs['plain'] = 'true'")
    literal = F.col("attrs")["literal"] == "true"
    rules = [
        (facts.where("kind = 'function' and attrs['is_async'] = 'false'").where(~name.rlike(SNAKE) & ~name.startswith("_")), "function", "Medium", "Function '%s' should use snake_case naming"),
        (facts.where("kind = 'class'").where(~name.rlike(PASCAL)), "class", "Medium", "Class '%s' should use PascalCase naming"),
        (a.where(literal & ~upper), "constant", "Low", "Constant '%s' should use UPPER_CASE naming"),
        (a.where(~literal & ~name.rlike(SNAKE)), "variable", "Low", "Variable '%s' should use snake_case naming"),
    ]
    return union([findings(rows, _at() | {"rule_id": f"python-style-{what}-naming", "category": "style", "severity": s, "message": F.format_string(m, name)}) for rows, what, s, m in rules])


def unused_imports(facts: DataFrame) -> DataFrame:
    """(file_path, name) of names that a file imports and never loads."""
    imported = facts.where("kind = 'import' and value <> '*'").select("file_path", F.col("value").alias("name")).distinct()
    used = facts.where("kind = 'use' and value = 'access'").select("file_path", "name").distinct()
    return imported.join(used, ["file_path", "name"], "left_anti")


def import_findings(facts: DataFrame) -> DataFrame:
    """Unused imports, and star imports."""
    unused = unused_imports(facts)
    star = facts.where("kind = 'import' and value = '*'")
    return union([
        findings(unused, {"rule_id": "python-imports-unused", "category": "imports", "severity": "Low", "message": F.concat(F.lit("Unused import: "), F.col("name")), "file_path": F.col("file_path"), "fixable": True, "suggestion": F.concat(F.lit("Remove import "), F.col("name"))}),
        findings(star, _at() | {"rule_id": "python-imports-star", "category": "imports", "severity": "Low", "message": F.concat(F.lit("Star import from "), F.col("name"))}),
    ])


def core_security_findings(facts: DataFrame) -> DataFrame:
    """Any call of eval or exec, os.system, and plain imports of pickle."""
    base = _at() | {"category": "security"}
    calls = facts.where("kind = 'call'")
    return union([
        findings(calls.where("name in ('eval', 'exec')"), base | {"rule_id": "python-security-eval", "severity": "High", "message": F.format_string("Use of %s() can lead to code injection", F.col("name")), "cwe": "CWE-94"}),
        findings(calls.where("name = 'os.system'"), base | {"rule_id": "python-security-os-system", "severity": "High", "message": F.lit("Use of os.system() can lead to command injection"), "cwe": "CWE-78"}),
        findings(facts.where("kind = 'import' and attrs['type'] = 'import' and name = 'pickle'"), base | {"rule_id": "python-security-pickle-import", "severity": "Medium", "message": F.lit("pickle is unsafe on untrusted data"), "cwe": "CWE-502"}),
    ])


def javascript_findings(files: DataFrame) -> DataFrame:
    js = lines(files.where(suffix("file_path").isin(sorted(JAVASCRIPT))))
    at = {"file_path": F.col("file_path"), "line_number": F.col("line_number"), "category": "style", "context": F.trim("line"), "fixable": True}
    return union([
        findings(js.where(F.col("line").rlike(r"\bconsole\.log\b")), at | {"rule_id": "js-style-console-log", "severity": "Low", "message": F.lit("console.log is left in")}),
        findings(js.where(F.col("line").rlike(r"\bvar\s+\w+")), at | {"rule_id": "js-style-var-usage", "severity": "Medium", "message": F.lit("Use let or const instead of var")}),
    ])


def string_literals(facts: DataFrame) -> DataFrame:
    return facts.where("kind = 'string'").select("file_path", "line", "col", "value")


def visitor_findings(files: DataFrame, facts: DataFrame, config: dict[str, Any]) -> DataFrame:
    return union([complexity_findings(facts, config), naming_findings(facts), import_findings(facts), core_security_findings(facts), javascript_findings(files)])
