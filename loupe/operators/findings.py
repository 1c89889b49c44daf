"""Relational operators over the findings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loupe.model import SEVERITIES, rank

ORDER = ["file_path", "line_number", "column_number", "rule_id", "message"]
KEY = ["file_path", "line_number", "column_number", "rule_id", "message"]


def where(f: DataFrame, severity: str | None = None, category: str | None = None, file_path: str | None = None, categories: str | list[str] | None = None, min_severity: str | None = None) -> DataFrame:
    if severity:
        f = f.where(F.lower("severity") == severity.lower())
    if category:
        f = f.where(F.col("category") == category)
    if file_path:
        f = f.where(F.col("file_path") == file_path)
    if categories:
        f = f.where(F.col("category").isin([c.strip() for c in categories.split(",")] if isinstance(categories, str) else categories))
    if min_severity:
        f = f.where(rank("severity") >= SEVERITIES.index(min_severity.capitalize()))
    return f


def summary(f: DataFrame) -> DataFrame:
    """(severity, category, n, fixable): counts by both, by each alone, and in all; null stands for all."""
    return f.groupingSets([["severity", "category"], ["severity"], ["category"], []], "severity", "category").agg(F.count("*").alias("n"), F.count_if(F.col("fixable")).alias("fixable"))


def first(f: DataFrame, n: int) -> DataFrame:
    """The first n in the order of files, lines, columns and rules."""
    return f.orderBy(*ORDER).limit(n)


def highest_severity(f: DataFrame) -> DataFrame:
    return f.agg(F.max_by("severity", rank("severity")).alias("highest"))


def combine(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def by_file(f: DataFrame) -> DataFrame:
    return f.groupBy("file_path").agg(F.count("*").alias("n"), F.max_by("severity", rank("severity")).alias("highest")).orderBy("file_path")


def top_per_file(f: DataFrame, n: int) -> DataFrame:
    """Of each file the first n in order, then by severity; remaining says how many are left out."""
    w = Window.partitionBy("file_path")
    r = f.withColumns({"seq": F.row_number().over(w.orderBy(*ORDER)), "remaining": F.greatest(F.count("*").over(w) - n, F.lit(0))})
    return r.where(F.col("seq") <= n).orderBy("file_path", F.desc(rank("severity")), "seq")


def rules(f: DataFrame) -> DataFrame:
    """The first finding of each rule."""
    w = Window.partitionBy("rule_id").orderBy(*ORDER)
    return f.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def sarif_level(severity: str = "severity"):  # noqa: ANN201
    r = rank(severity)
    return F.when(r >= 3, "error").when(r == 2, "warning").otherwise("note")


def editor_level(severity: str = "severity"):  # noqa: ANN201
    s = F.lower(severity)
    return F.when(s == "high", "Error").when(s.isin("low", "info"), "Information").otherwise("Warning")


def dedupe(f: DataFrame) -> DataFrame:
    return f.dropDuplicates(KEY)


def sorted_findings(f: DataFrame) -> DataFrame:
    return f.orderBy(F.desc(rank("severity")), *ORDER)


def severity_pivot(f: DataFrame) -> DataFrame:
    return f.groupBy("file_path").pivot("severity", SEVERITIES).count().na.fill(0)


def suppress(f: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Without the findings of suppressed (the key columns that it has)."""
    return f.join(suppressed, [c for c in KEY if c in suppressed.columns], "left_anti")


def exit_code(f: DataFrame, policy: str = "mixed") -> DataFrame:
    """mixed: 2 with a critical finding, 1 with a high one or more than five medium ones, else 0. security: without regard to medium ones. simple: 1 with a high one or more than five medium ones, else 0."""
    n = lambda s: F.count_if(F.col("severity") == s)
    high, many = n("High") > 0, n("Medium") > 5
    codes = {"mixed": F.when(n("Critical") > 0, 2).when(high | many, 1), "security": F.when(n("Critical") > 0, 2).when(high, 1), "simple": F.when(high | many, 1)}
    if policy not in codes:
        raise ValueError(f"no policy {policy}; there are {', '.join(codes)}")
    return f.agg(codes[policy].otherwise(0).alias("exit_code"))


def override_severity(f: DataFrame, by_rule: dict[str, str]) -> DataFrame:
    if not by_rule:
        return f
    m = F.create_map(*[F.lit(x) for p in by_rule.items() for x in p])
    return f.withColumn("severity", F.coalesce(F.try_element_at(m, F.col("rule_id")), F.col("severity")))


def health(f: DataFrame) -> DataFrame:
    """A score from 0 to 100 a file: 100 less 25, 10, 4 and 1 for each critical, high, medium and low finding."""
    cost = F.get(F.array(*[F.lit(x) for x in (0, 1, 4, 10, 25)]), rank("severity"))
    return f.groupBy("file_path").agg(F.greatest(F.lit(0), 100 - F.sum(cost)).alias("health"))
