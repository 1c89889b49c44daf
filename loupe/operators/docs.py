"""Documentation quality of Python modules, classes and functions."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loupe.model import findings, union

_TYPE_NAMES = {"str": "string", "int": "integer", "bool": "boolean", "list": "array", "dict": "mapping", "dictionary": "mapping"}


def functions(facts: DataFrame) -> DataFrame:
    """Functions with params, types and documented: maps from parameter to annotation and to documented type."""
    a = F.col("attrs")

    def part(prefix: str) -> Column:
        m = F.map_filter("attrs", lambda k, _: k.startswith(prefix))
        return F.transform_keys(m, lambda k, _: F.substring(k, F.lit(len(prefix) + 1), F.length(k)))

    f = facts.where("kind = 'function'")
    return f.select(
        "file_path", "name", "line", "col", "end_line", "end_col", F.col("value").alias("doc"), F.col("items").alias("params"), (a["is_method"] == "true").alias("is_method"), (a["is_property"] == "true").alias("is_property"),
        (F.col("name").startswith("_") & ~F.col("name").rlike("^__.*__$")).alias("is_private"), F.col("name").rlike("^__.*__$").alias("is_special"), a["returns"].alias("returns"), a["doc_style"].alias("style"),
        F.coalesce(a["doc_returns"], F.lit("")).alias("doc_returns"), part("type:").alias("types"), part("doc:").alias("documented"),
    )


def _same_type(a: Column, b: Column) -> Column:
    names = F.create_map(*[F.lit(x) for p in _TYPE_NAMES.items() for x in p])
    norm = lambda c: F.coalesce(F.try_element_at(names, F.lower(F.trim(c))), F.lower(F.trim(c)))
    return norm(a) == norm(b)


def checked(facts: DataFrame, config: dict[str, Any]) -> DataFrame:
    f = functions(facts)
    if not config.get("check_private_methods", False):
        f = f.where(~F.col("is_private"))
    return f if config.get("check_special_methods", False) else f.where(~F.col("is_special"))


def undocumented_params(f: DataFrame) -> DataFrame:
    own = F.array(F.lit("self"), F.lit("cls"))
    return f.withColumn("param", F.explode(F.array_except(F.array_except("params", F.map_keys("documented")), own)))


def unknown_params(f: DataFrame) -> DataFrame:
    own = F.array(F.lit("self"), F.lit("cls"))
    return f.withColumn("param", F.explode(F.array_except(F.array_except(F.map_keys("documented"), F.col("params")), own)))


def mismatched_types(f: DataFrame) -> DataFrame:
    e = f.select("*", F.explode("types").alias("param", "annotation")).withColumn("said", F.try_element_at("documented", F.col("param")))
    return e.where((F.col("said") != "") & ~_same_type(F.col("annotation"), F.col("said")))


def docs_findings(facts: DataFrame, config: dict[str, Any]) -> DataFrame:
    """Missing module, class and function docstrings; of functions that have one, its length, style, parameters, return value, types and examples."""
    at = {"file_path": F.col("file_path"), "line_number": F.col("line"), "column_number": F.col("col"), "category": "documentation"}
    doc_at = at | {"line_number": F.col("line") + 1}
    f = checked(facts, config)
    has, what = f.where("doc is not null"), F.when(F.col("is_method"), "method").otherwise("function")
    none = F.col("doc").isNull() | (F.col("doc") == "")
    least, style = config.get("min_docstring_length", 10), config.get("preferred_style", "google")
    parts = []

    def say(rows: DataFrame, rule: str, severity: str | Column, message: Column, base: dict[str, Any] = doc_at, suggestion: str = "") -> None:
        parts.append(findings(rows, base | {"rule_id": rule, "severity": severity, "message": message, "suggestion": suggestion}))

    say(f.where(none), "missing-function-docstring", F.when(F.col("is_private"), "Low").otherwise("Medium"), F.format_string("Missing docstring for %s '%s'", what, F.col("name")), at)
    has = has.where(~none)
    say(has.where(F.length("doc") < least), "short-function-docstring", "Low", F.format_string("Function docstring too short (%d chars)", F.length("doc")), suggestion=f"Write at least {least} characters")
    if config.get("enforce_style", False) and style != "any":
        say(has.where(F.col("style") != style), "docstring-style-mismatch", "Low", F.format_string(f"Docstring style '%s' is not '{style}'", F.col("style")))
    if config.get("require_parameter_docs", True):
        say(undocumented_params(has), "missing-parameter-doc", "Medium", F.format_string("Parameter '%s' of '%s' is not documented", F.col("param"), F.col("name")))
        say(unknown_params(has), "extra-parameter-doc", "Low", F.format_string("'%s' has no parameter '%s'", F.col("name"), F.col("param")))
    if config.get("require_return_docs", True):
        say(has.where("returns is not null and returns <> 'None' and doc_returns = ''"), "missing-return-doc", "Medium", F.format_string("Return value of '%s' is not documented", F.col("name")))
    if config.get("check_type_consistency", True):
        say(mismatched_types(has), "type-annotation-mismatch", "Low", F.format_string("Parameter '%s' is annotated '%s' and documented '%s'", F.col("param"), F.col("annotation"), F.col("said")))
    if config.get("validate_examples", True):
        say(facts.where("kind = 'example_error'"), "invalid-docstring-example", "Low", F.format_string("Example of '%s' doesn't compile: %s", F.col("name"), F.col("value")))
    private = F.col("name").startswith("_")
    classes = facts.where("kind = 'class'").where(F.col("value").isNull())
    classes = classes if config.get("check_private_methods", False) else classes.where(~private)
    say(classes, "missing-class-docstring", F.when(private, "Low").otherwise("Medium"), F.format_string("Missing docstring for class '%s'", F.col("name")), at)
    if config.get("require_module_docstring", True):
        say(facts.where("kind = 'module' and value is null"), "DOC001", "Medium", F.lit("Module docstring is missing."), at)
    return union(parts)
