"""Reports of findings.

A document is made as a run of pieces: findings come to the driver a partition at a
time, in order, and go on to the file or the string, so that no number of them needs
more memory than a partition. All findings are in it, unless the caller gives a
number; then the document says how many are left out. write_parts has the executors
write the same rows as a folder of files, for reports that are too large for one.
"""

from __future__ import annotations

import html
import json
import textwrap
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from pathlib import Path
from typing import Any
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.model import FINDING_SCHEMA, SEVERITIES, rank
from loupe.operators import findings as ops

VERSION = "1.0.0"
_COLORS = {"Critical": "\x1b[95m", "High": "\x1b[91m", "Medium": "\x1b[93m", "Low": "\x1b[94m", "Info": "\x1b[90m"}
def to_dict(row: Any) -> dict[str, Any]:
    d = row.asDict(recursive=True)
    return {f.name: d[f.name] for f in FINDING_SCHEMA.fields}


def stats(f: DataFrame) -> dict[str, Any]:
    rows = ops.summary(f).collect()
    total = next((r for r in rows if r["severity"] is None and r["category"] is None), None)
    return {
        "total_findings": total["n"] if total else 0,
        "fixable_issues": total["fixable"] if total else 0,
        "severity_breakdown": {s: next((r["n"] for r in rows if r["severity"] == s and r["category"] is None), 0) for s in reversed(SEVERITIES)},
        "category_breakdown": {r["category"]: r["n"] for r in sorted(rows, key=lambda r: r["category"] or "") if r["severity"] is None and r["category"]},
    }


def write_parts(f: DataFrame, fmt: str, path: str) -> None:
    """A folder of JSON lines, XML or SARIF results (a line each), written by the executors."""
    if fmt == "json":
        f.write.mode("overwrite").json(path, ignoreNullFields=False)
    elif fmt == "xml":
        f.write.mode("overwrite").format("xml").option("rootTag", "findings").option("rowTag", "finding").save(path)
    elif fmt == "sarif":
        region = F.struct(F.greatest(F.lit(1), "line_number").alias("startLine"), F.greatest(F.lit(1), "column_number").alias("startColumn"))
        place = F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
        f.select(F.col("rule_id").alias("ruleId"), ops.sarif_level().alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations")).write.mode("overwrite").json(path)
    else:
        raise ValueError(f"no parts of format {fmt}; there are json, sarif, xml")


def _rows(f: DataFrame, most: int | None) -> Iterator[Any]:
    return (ops.first(f, most) if most is not None else f.orderBy(*ops.ORDER)).toLocalIterator()


def _omitted(total: int, most: int | None) -> int:
    return max(0, total - most) if most is not None else 0


def json_pieces(f: DataFrame, project: str = "", analyzers: list[str] | None = None, config: dict[str, Any] | None = None, most: int | None = None) -> Iterator[str]:
    s = stats(f)
    head = {"analyzers": analyzers or [], "version": VERSION, "timestamp": datetime.now(UTC).isoformat(), "project_path": project, "statistics": s, "config": config or {}}
    if left := _omitted(s["total_findings"], most):
        head["omitted_findings"] = left
    yield json.dumps(head, indent=2, ensure_ascii=False)[:-2] + ',\n  "findings": ['
    for i, r in enumerate(_rows(f, most)):
        yield ("," if i else "") + "\n" + textwrap.indent(json.dumps(to_dict(r), indent=2, ensure_ascii=False), "    ")
    yield "\n  ]\n}"


def xml_pieces(f: DataFrame, most: int | None = None) -> Iterator[str]:
    def text(v: object) -> str:
        return escape("".join(c for c in str(v) if c >= " " or c in "\t\n\r"))

    left = _omitted(f.count(), most) if most is not None else 0
    yield '<?xml version="1.0" encoding="UTF-8"?>\n<findings' + (f' omitted="{left}"' if left else "") + ">\n"
    for r in _rows(f, most):
        cells = [f"    <{k}>{text(x)}</{k}>" for k, v in to_dict(r).items() for x in (v if isinstance(v, list) else [v]) if x is not None]
        yield "\n".join(["  <finding>", *cells, "  </finding>"]) + "\n"
    yield "</findings>"


def sarif_pieces(f: DataFrame, most: int | None = None) -> Iterator[str]:
    f = f.withColumn("level", ops.sarif_level())
    rules = [{"id": r["rule_id"], "name": r["rule_id"], "shortDescription": {"text": r["message"]}, "defaultConfiguration": {"level": r["level"]}, "properties": {"category": r["category"]}} for r in ops.rules(f).orderBy("rule_id").collect()]
    yield json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0"}, indent=2)[:-2] + ',\n  "runs": [{\n    "tool": ' + json.dumps({"driver": {"name": "loupe", "version": VERSION, "rules": rules}}, sort_keys=True) + ',\n    "results": ['
    for i, r in enumerate(_rows(f, most)):
        region = {"startLine": max(1, r["line_number"]), "startColumn": max(1, r["column_number"])}
        if r["end_line"]:
            region |= {"endLine": r["end_line"], "endColumn": max(1, r["end_column"])}
        x = {"ruleId": r["rule_id"], "level": r["level"], "message": {"text": r["message"]}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["file_path"]}, "region": region}}]}
        if r["fixable"] and r["suggestion"]:
            x["fixes"] = [{"description": {"text": r["suggestion"]}}]
        yield ("," if i else "") + "\n      " + json.dumps(x, sort_keys=True)
    call: dict[str, Any] = {"executionSuccessful": True}
    if most is not None and (left := _omitted(f.count(), most)):
        call["properties"] = {"omittedResults": left}
    yield '\n    ],\n    "invocations": ' + json.dumps([call]) + "\n  }]\n}"


def console_pieces(f: DataFrame, colors: bool = True, per_file: int = 20, summary_only: bool = False) -> Iterator[str]:
    """A summary, and of each file the first per_file findings, with how many more there are."""
    s = stats(f)
    paint = lambda sev, x: f"{_COLORS[sev]}{x}\x1b[0m" if colors else x
    yield f"{s['total_findings']} findings, {s['fixable_issues']} of them fixable\n"
    yield from (f"\n  {paint(k, k)}: {v}" for k, v in s["severity_breakdown"].items() if v)
    yield "\n" if s["category_breakdown"] else ""
    yield from (f"\n  {k}: {v}" for k, v in s["category_breakdown"].items())
    if not summary_only:
        last = None
        for r in ops.top_per_file(f, per_file).toLocalIterator():
            if r["file_path"] != last:
                last = r["file_path"]
                yield f"\n\n{last}" + (f" (and {r['remaining']} more)" if r["remaining"] else "")
            yield f"\n  {r['line_number']}:{r['column_number']} {paint(r['severity'], r['severity'])} {r['rule_id']}: {r['message']}"


def editor_rows(f: DataFrame) -> DataFrame:
    return f.select(F.col("file_path").alias("file"), F.col("line_number").alias("line"), F.col("column_number").alias("column"), "message", F.lower("severity").alias("severity"), "category", "rule_id", F.col("suggestion").alias("fix_suggestion"))


def editor_pieces(f: DataFrame, most: int | None = None) -> Iterator[str]:
    """An array of editor_rows; an editor asks for the most that it shows and counts for itself."""
    rows = editor_rows(ops.first(f, most) if most is not None else f.orderBy(*ops.ORDER))
    yield "["
    for i, r in enumerate(rows.toLocalIterator()):
        yield ("," if i else "") + "\n" + json.dumps(r.asDict(), ensure_ascii=False)
    yield "\n]"


def editor_lines(f: DataFrame) -> DataFrame:
    return f.select(F.format_string("%s:%d:%d %s %s", "file_path", "line_number", "column_number", F.lower("severity"), "message").alias("value"))


def html_pieces(f: DataFrame, most: int | None = None) -> Iterator[str]:
    rows = ops.sorted_findings(f)
    yield "<!DOCTYPE html><meta charset='utf-8'><title>Findings</title>"
    if most is not None and (left := _omitted(f.count(), most)):
        yield f"<p>{left} more findings are left out.</p>"
    yield "<table>"
    for r in (rows.limit(most) if most is not None else rows).toLocalIterator():
        yield "<tr>" + "".join(f"<td>{html.escape(str(r[c]))}</td>" for c in ("severity", "file_path", "line_number", "rule_id", "message")) + "</tr>\n"
    yield "</table>"


FORMATS: dict[str, Callable[..., Iterator[str]]] = {"console": console_pieces, "json": json_pieces, "xml": xml_pieces, "sarif": sarif_pieces, "ide": editor_pieces, "html": html_pieces}


def pieces(f: DataFrame, fmt: str, **options: object) -> Iterator[str]:
    if fmt not in FORMATS:
        raise ValueError(f"no format {fmt}; there are {', '.join(FORMATS)}")
    return FORMATS[fmt](f, **options)


def render(f: DataFrame, fmt: str, **options: object) -> str:
    return "".join(pieces(f, fmt, **options))


def save(f: DataFrame, fmt: str, path: str, **options: object) -> None:
    """The document as one file of the driver's file system, written piece by piece."""
    run = pieces(f, fmt, **options)
    with Path(path).open("w", encoding="utf-8") as out:
        out.writelines(run)


def highest(f: DataFrame) -> int:
    return f.agg(F.max(rank("severity"))).first()[0] or 0
