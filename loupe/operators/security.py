"""Secrets, personal data, injection patterns and high entropy in lines; dangerous calls in Python facts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loupe.functions.text import entropy, lines, match_columns, match_places
from loupe.model import findings, union
from loupe.sources.files import is_python, name_of, read_errors, suffix

_N = "[0-9]"
_SEP = r"[-.\s]?"
_KEYED = r'["\s]*[:=]["\s]*'
_B64 = "[A-Za-z0-9+/=]"
_ARG = r"\s*\(\s*[^)]*\+[^)]*\)"
_Q = r"[\x22\x27]"
_NQ = r"[^\x22\x27]*"


@dataclass(frozen=True)
class Pattern:
    name: str
    group: str
    regex: str
    message: str
    severity: str
    cwe: int
    gate: str  # words of which a match has one in lower case; none: four digits in a match

    def may(self, low: Column) -> Column:
        """Whether a line may have a match, by its lower case: far cheaper than the expression."""
        return reduce(lambda a, b: a | b, [low.contains(x) for x in self.gate.split()]) if self.gate else low.rlike("[0-9]{4}")


PATTERNS = [
    Pattern("aws_key", "secret", "AKIA" + "[0-9A-Z]" + "{16}", "AWS Access Key ID", "Critical", 798, "akia"),
    Pattern("aws_secret", "secret", "[_-]?".join(["aws", "secret", "access", "key"]) + _KEYED + "[a-z0-9/+]{40}", "AWS Secret Access Key", "Critical", 798, "aws"),
    Pattern("github", "secret", "ghp_" + "[a-z0-9]{36}", "GitHub personal access token", "Critical", 798, "ghp_"),
    Pattern("openai", "secret", "sk-" + "[a-z0-9]{48,}", "OpenAI API key", "Critical", 798, "sk-"),
    Pattern("api_key", "secret", "api[_-]?key" + _KEYED + _B64 + "{20,}", "API Key", "High", 798, "api"),
    Pattern("jwt", "secret", "eyJ" + _B64 + r"+\.eyJ" + _B64 + r"+\." + _B64 + "+", "JWT token", "High", 798, "eyj"),
    Pattern("eval", "vulnerability", r"\beval" + _ARG, "eval() of joined strings", "Critical", 94, "eval"),
    Pattern("exec", "vulnerability", r"\bexec" + _ARG, "exec() of joined strings", "Critical", 94, "exec"),
    Pattern("os_system", "vulnerability", r"os\.system" + _ARG, "os.system() of joined strings", "Critical", 78, "os.system"),
    Pattern("sql", "vulnerability", r"(?:query|execute)\s*\(\s*" + _Q + _NQ + r"\+" + _NQ + _Q, "SQL built from joined strings", "High", 89, "query execute"),
    Pattern("pickle", "vulnerability", r"pickle\.loads?\s*\(", "pickle of untrusted data", "Critical", 502, "pickle.load"),
    Pattern("email", "pii", r"\b[\w.%+-]+@[a-z0-9.-]+\.[a-z|]{2,}\b", "Email address", "Medium", 200, "@"),
    Pattern("phone", "pii", r"\b(?:\+1" + _SEP + r")?\(?" + _N + r"{3}\)?" + _SEP + _N + "{3}" + _SEP + _N + r"{4}\b", "US phone number", "Medium", 200, ""),
    Pattern("ssn", "pii", "-".join([r"\b" + _N + "{3}", _N + "{2}", _N + r"{4}\b"]), "US social security number", "High", 200, "-"),
]
SUFFIXES = "cfg env ini js json jsx py svelte toml ts tsx vue yaml yml".split()
BY_NAME = {p.name: p for p in PATTERNS}
TEST_WORDS = "demo|dummy|example|fake|fixme|mock|placeholder|sample|test|todo|xxx"
_QUOTED = _Q + r"([^\x22\x27]{20,})" + _Q
_ASSIGNED = r"=\s*(" + _B64 + r"{20,})(?:\s|$)"
_HARMLESS = r"\.net|\.org|/|\\|com|http|www"


def is_test(low: Column) -> Column:
    """Whether a line in lower case has a word of test data."""
    return reduce(lambda a, b: a | b, [low.contains(x) for x in TEST_WORDS.split("|")])


def matches(line_rows: DataFrame, p: Pattern, config: dict[str, Any]) -> DataFrame:
    """line_rows with text and column (from 1) of each match of the pattern, less test data and allowed personal data."""
    rx = "(?i)" + p.regex
    low = F.lower("line")
    hit = line_rows.where(p.may(low) & F.col("line").rlike(rx))
    if config.get("skip_test_data", True):
        hit = hit.where(~is_test(low))
    hit = hit.withColumn("m", F.explode(match_columns("line", rx))).select(*line_rows.columns, "m.text", "m.column")
    allow = config.get("allow") or []
    return hit.where(~F.col("text").isin(allow)) if p.group == "pii" and allow else hit


def pattern_findings(files: DataFrame, config: dict[str, Any], patterns: list[Pattern] = PATTERNS, first_place: bool = False) -> DataFrame:
    """A finding for each match of each pattern in each line, in one pass: each expression is tried only on lines that have one of its words.

    Its column is where the match is; with first_place, where its text first stands in the line.
    """
    low = F.col("low")
    hit = lines(files).withColumn("low", F.lower("line")).where(reduce(lambda a, b: a | b, [p.may(low) for p in patterns]))
    if config.get("skip_test_data", True):
        hit = hit.where(~is_test(low))
    each = F.array(*[
        F.struct(
            F.when(p.may(low), F.regexp_extract_all("line", F.lit("(?i)" + p.regex), F.lit(0))).alias("found"), F.lit(p.group).alias("group"), F.lit(p.severity).alias("severity"), F.lit(p.message).alias("message"), F.lit(p.cwe).alias("cwe"),
        )
        for p in patterns
    ])
    hit = hit.withColumn("p", F.explode(each)).where(F.size("p.found") > 0)
    hit = hit.withColumn("m", F.explode(match_places("line", F.col("p.found"))))
    if allow := config.get("allow") or []:
        hit = hit.where((F.col("p.group") != "pii") | ~F.col("m.text").isin(allow))
    column = F.instr("line", F.col("m.text")) if first_place else F.col("m.column")
    return findings(hit.withColumn("text", F.col("m.text")), {
        "rule_id": F.concat(F.lit("security-pattern-cwe-"), F.col("p.cwe").cast("string")), "category": "security", "severity": F.col("p.severity"), "message": F.col("p.message"), "file_path": F.col("file_path"),
        "line_number": F.col("line_number"), "column_number": column, "context": F.trim("line"), "cwe": F.concat(F.lit("CWE-"), F.col("p.cwe").cast("string")), "confidence": 0.8, "tags": F.array(F.col("p.group")),
    })


def entropy_candidates(files: DataFrame, min_length: int = 20) -> DataFrame:
    """(file_path, line_number, line, text, entropy) of quoted and assigned strings that look like no address or path."""
    ls = lines(files).where(F.length("line") >= min_length)
    both = F.concat(F.regexp_extract_all("line", F.lit(_QUOTED), F.lit(1)), F.regexp_extract_all("line", F.lit(_ASSIGNED), F.lit(1)))
    c = ls.withColumn("text", F.explode(both)).where((F.length("text") >= min_length) & ~F.lower("text").rlike(_HARMLESS))
    return c.withColumn("entropy", entropy("text"))


def entropy_findings(files: DataFrame, config: dict[str, Any]) -> DataFrame:
    e = F.col("entropy")
    hit = entropy_candidates(files, config.get("min_string_length", 20)).where(e >= config.get("min_entropy", 4.5))
    if config.get("skip_test_data", True):
        hit = hit.where(~is_test(F.lower("line")))
    return findings(hit, {
        "rule_id": "security-entropy-high", "category": "security", "severity": F.when(e < 5.0, "Medium").otherwise("High"), "message": F.format_string("High entropy string (entropy: %.2f)", e),
        "file_path": F.col("file_path"), "line_number": F.col("line_number"), "column_number": F.instr("line", F.col("text")), "context": F.trim("line"), "cwe": "CWE-798",
        "confidence": F.least(F.lit(0.9), e / 6), "tags": ["entropy"],
    })


def call_findings(facts: DataFrame) -> DataFrame:
    """Calls of eval and exec with a dynamic argument, and plain imports of pickle."""
    dynamic = facts.where("kind = 'call' and name in ('eval', 'exec') and attrs['dynamic'] = 'true'")
    loads = facts.where("kind = 'import' and attrs['type'] = 'import' and name in ('pickle', 'cPickle')")
    at = {"file_path": F.col("file_path"), "line_number": F.col("line"), "column_number": F.col("col"), "end_line": F.col("end_line"), "end_column": F.col("end_col"), "category": "security"}
    at |= {"context": F.coalesce(F.col("attrs")["context"], F.lit("")), "code_snippet": F.coalesce(F.col("attrs")["code"], F.lit(""))}
    return union([
        findings(dynamic, at | {"rule_id": F.concat(F.lit("python-security-"), F.col("name")), "severity": "Critical", "message": F.concat("name", F.lit("() of dynamic input")), "cwe": "CWE-94"}),
        findings(loads, at | {"rule_id": "python-security-pickle-import", "severity": "Medium", "message": F.lit("pickle is unsafe on untrusted data"), "cwe": "CWE-502"}),
    ])


def syntax_findings(facts: DataFrame) -> DataFrame:
    bad = facts.where("kind = 'parse_error'")
    return findings(bad, {"rule_id": "python-syntax-error", "category": "security", "severity": "Low", "message": F.concat(F.lit("Syntax error: "), F.col("value")), "file_path": F.col("file_path"), "line_number": F.col("line")})


def security_findings(files: DataFrame, facts: DataFrame | None, config: dict[str, Any]) -> DataFrame:
    """Patterns and entropy in files of the kinds that hold code or settings (all_files: in all), dangerous calls and syntax errors in Python ones, files that can't be read."""
    if not config.get("all_files", False):
        files = files.where(suffix("file_path").isin(SUFFIXES) | (name_of("file_path") == ".env"))
    parts = [pattern_findings(files, config), read_errors(files)]
    if config.get("entropy", True):
        parts.append(entropy_findings(files, config))
    if facts is not None:
        parts += [call_findings(facts), syntax_findings(facts)]
    return union(parts)


def redaction_counts(files: DataFrame, config: dict[str, Any]) -> DataFrame:
    """(group, name, n) of matches over all patterns in one pass over the lines, without exploding them."""
    low = F.lower("line")
    ls = lines(files)
    if config.get("skip_test_data", True):
        ls = ls.where(~is_test(low))
    counts: list[Column] = [F.sum(F.when(p.may(low), F.regexp_count("line", F.lit("(?i)" + p.regex))).otherwise(0)).alias(p.name) for p in PATTERNS]
    pairs = ", ".join(f"'{p.group}', '{p.name}', {p.name}" for p in PATTERNS)
    return ls.agg(*counts).selectExpr(f"stack({len(PATTERNS)}, {pairs}) as (pattern_group, pattern_name, n)").where("n > 0")


def python_files(files: DataFrame) -> DataFrame:
    return files.where(is_python("file_path"))
