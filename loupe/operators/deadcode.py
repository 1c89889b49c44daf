"""Symbols that nothing uses."""

from __future__ import annotations

import builtins
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loupe.model import findings
from loupe.sources.files import name_of

ENTRY_NAMES = sorted(f"{n}.py" for n in "__main__ app cli main manage run server setup start".split())
EXTERNAL = "|".join(["^_.*_handler$", "^clean_", "^delete$", "^do_", "^get_.*_display$", "^handle_", "^on_", "^save$", "^test_"])
_FRAMEWORK = sorted(set("admin app argument blueprint command conftest dependency endpoint fixture forms group models option route router serializers urls views".split()))
_BUILTINS = sorted(dir(builtins))


def symbols(facts: DataFrame) -> DataFrame:
    """(file_path, name, symbol_type, line_number, column_number, is_private, is_special, decorators, scope, parent)."""
    n = F.col("name")
    kinds = F.create_map(*[F.lit(x) for x in ("function", "function", "class", "class", "assign", "variable", "import", "import")])
    f = facts.where("kind in ('function', 'class', 'assign', 'import')").where(~((F.col("kind") == "import") & (F.col("value") == "*")))
    name = F.when(F.col("kind") == "import", F.col("value")).otherwise(n)
    private = name.startswith("_") & ~name.rlike("^__.*__$")
    decorators = F.filter(F.split(F.coalesce(F.col("attrs")["decorators"], F.lit("")), ","), lambda x: x != "")
    s = f.select("file_path", name.alias("name"), F.try_element_at(kinds, F.col("kind")).alias("symbol_type"), F.col("line").alias("line_number"), F.col("col").alias("column_number"), private.alias("is_private"), name.rlike("^__.*__$").alias("is_special"), decorators.alias("decorators"), "scope", "parent")
    return s.where((F.col("symbol_type") != "variable") | (F.col("scope") != "function"))


def usages(facts: DataFrame, track_attribute_names: bool = False) -> DataFrame:
    """(name, file_path, line_number, usage_type); attribute names count only if they are tracked."""
    kinds = ["access", "call", "inherit"] + ["attribute"] * track_attribute_names
    u = facts.where((F.col("kind") == "use") & F.col("value").isin(kinds))
    return u.select("name", "file_path", F.col("line").alias("line_number"), F.col("value").alias("usage_type"))


def entry_points(files: DataFrame, symbols_: DataFrame) -> DataFrame:
    named = files.where(name_of("file_path").isin(ENTRY_NAMES)).select("file_path")
    return named.union(symbols_.where("name = '__main__' and symbol_type = 'variable'").select("file_path")).distinct()


def exported(facts: DataFrame) -> DataFrame:
    """(file_path, name) of names in __all__."""
    return facts.where("kind = 'assign' and name = '__all__'").select("file_path", F.explode("items").alias("name")).distinct()


def dead_symbols(files: DataFrame, facts: DataFrame, config: dict[str, Any]) -> DataFrame:
    """Symbols without a use in another file or on another line, that are no dunder, builtin name, part of an entry file, public API or framework hook."""
    s = symbols(facts)
    if not config.get("include_tests", False):
        s = s.where(~name_of("file_path").rlike(r"^test_|_test\.py$"))
    s = s.where(~F.col("is_special") & ~F.col("name").isin(_BUILTINS)).join(entry_points(files, s), "file_path", "left_anti")
    if not config.get("aggressive", False):
        last = F.transform("decorators", lambda x: F.element_at(F.split(x, r"\."), -1))
        hook = F.col("name").rlike(EXTERNAL) | F.arrays_overlap(last, F.array(*[F.lit(x) for x in _FRAMEWORK]))
        s = s.where(~hook)
        if config.get("exclude_public_api", True):
            lists = exported(facts)
            s = s.join(lists.withColumn("in_all", F.lit(True)), ["file_path", "name"], "left").join(lists.select("file_path", F.lit(True).alias("has_all")).distinct(), "file_path", "left")
            implied = F.col("has_all").isNull() & ~F.col("is_private") & (F.col("scope") == "module") & F.col("symbol_type").isin("function", "class", "variable")
            s = s.where(F.col("in_all").isNull() & ~implied).drop("in_all", "has_all")
    # a use is elsewhere if the first or the last place of the name is not the symbol's own
    place = F.struct("file_path", "line_number")
    u = usages(facts, config.get("track_attribute_names", False)).groupBy("name").agg(F.min(place).alias("first_use"), F.max(place).alias("last_use"))
    j = s.join(u, "name", "left")
    return j.where(F.col("first_use").isNull() | ((F.col("first_use") == place) & (F.col("last_use") == place))).drop("first_use", "last_use")


def removal_suggestion() -> Column:
    t, n = F.col("symbol_type"), F.col("name")
    tail = F.when(F.col("is_private"), " (private)").when(F.size("decorators") > 0, " (decorated: check the framework)").otherwise("")
    return F.concat(F.lit("Remove unused "), t, F.lit(" "), n, tail)


def deadcode_findings(files: DataFrame, facts: DataFrame, config: dict[str, Any]) -> DataFrame:
    t = F.col("symbol_type")
    low = F.col("is_private") | ((t == "function") & (F.size("decorators") > 0))
    severity = F.when(low, "Low").when(t == "function", "Medium").when(t == "class", "High").otherwise("Low")
    return findings(dead_symbols(files, facts, config), {
        "rule_id": F.concat(F.lit("dead-code-"), t), "category": "dead-code", "severity": severity, "message": F.format_string("Unused %s: '%s'", t, F.col("name")), "file_path": F.col("file_path"),
        "line_number": F.col("line_number"), "column_number": F.col("column_number"), "fixable": True, "suggestion": removal_suggestion(), "tags": F.array(F.concat(F.lit("dead-"), t), F.lit("unused")),
    })
