"""The whole analysis: files to facts to findings, filtered, ranked and reported.

A rule is a function of (files, facts, config) to findings. Rules are registered by
analyzer name, and further ones can be added.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe import config as cfg
from loupe.model import union
from loupe.operators import findings as ops
from loupe.operators.deadcode import deadcode_findings
from loupe.operators.docs import docs_findings
from loupe.operators.duplicates import duplicate_findings, python_blocks
from loupe.operators.graph import circular_findings
from loupe.operators.security import security_findings
from loupe.operators.visitors import visitor_findings
from loupe.sinks import reports
from loupe.sources import files as src
from loupe.sources.facts import facts as parse

Rule = Callable[[DataFrame, DataFrame, dict[str, Any]], DataFrame]

ANALYZERS: dict[str, Rule] = {
    "security": lambda f, x, c: security_findings(f, x, c),
    "circular": circular_findings,
    "deadcode": deadcode_findings,
    "docs": lambda f, x, c: docs_findings(x, c),
    "duplicates": lambda f, x, c: duplicate_findings(python_blocks(x, c), c),
    "visitors": visitor_findings,
}


def register(name: str, rule: Rule) -> None:
    ANALYZERS[name] = rule


def analyze(
    spark: SparkSession, source: str | list[str] | DataFrame, analyzers: str | list[str] | None = None, exclude: list[str] | None = None, security_only: bool = False,
    min_severity: str | None = None, categories: str | list[str] | None = None, max_findings: int | None = None, config: dict[str, Any] | None = None, profile: str | None = None,
    root: str = "",
) -> DataFrame:
    """Findings of the files of a path, or of a files table. Facts are parsed once and kept in memory or on disk while several analyzers read them; see released. ValueError says what is wrong with the configuration."""
    c = config or cfg.load(profile=profile)
    if wrong := cfg.validate(c):
        raise ValueError("; ".join(wrong))
    files = source if isinstance(source, DataFrame) else src.scan(spark, source, c)
    names = [n for n in cfg.select(analyzers, exclude, security_only) if cfg.analyzer_on(c, n)]
    names += [n for n in ANALYZERS if n not in cfg.ANALYZERS and (not analyzers or n in analyzers)]
    facts = parse(files, cfg.get(c, "analyzers.duplicates.min_lines", 6)).persist(StorageLevel.MEMORY_AND_DISK)
    _kept.append(facts)
    parts = []
    for n in names:
        section = dict(c["analyzers"].get(n, {}))
        section.setdefault("root", root)
        f = ANALYZERS[n](files, facts, section)
        parts.append(ops.where(f, min_severity=section.get("min_severity")))
    out = union(parts) if parts else ops.first(spark.createDataFrame([], reports.FINDING_SCHEMA), 0)
    off = [r for r in c.get("rules", {}) if not cfg.rule_on(c, r)]
    out = out.where(~F.col("rule_id").isin(off)) if off else out
    out = ops.override_severity(out, c["global"].get("rule_severity") or {})
    out = ops.where(out, min_severity=min_severity or c["global"].get("severity_filter"), categories=categories)
    return ops.first(out, max_findings) if max_findings else out


_kept: list[DataFrame] = []


def released() -> None:
    """Lets go of the facts that analyze has kept; findings that are read later parse anew."""
    while _kept:
        _kept.pop().unpersist()


def run(spark: SparkSession, source: str | list[str] | DataFrame, fmt: str | None = None, output: str | None = None, policy: str = "mixed", config: dict[str, Any] | None = None, profile: str | None = None, **options: Any) -> tuple[str, int]:
    """The report's text, also written to output, and the exit code by the policy of that name. Format, colours and findings shown of each file are the configuration's, unless fmt is given."""
    c = config or cfg.load(profile=profile)
    f = analyze(spark, source, config=c, **options).persist(StorageLevel.MEMORY_AND_DISK)
    fmt = fmt or c["output"]["format"]
    shown = {"colors": c["output"]["colors"] and not output, "per_file": c["global"]["max_findings_per_file"]} if fmt == "console" else {}
    text = reports.render(f, fmt, **shown)
    if output:
        Path(output).write_text(text, encoding="utf-8")
    code = ops.exit_code(f, policy).first()["exit_code"]
    f.unpersist()
    released()
    return text, code
