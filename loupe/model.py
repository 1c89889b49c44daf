"""The findings table, severities, categories and language dimensions."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEVERITIES = ["Info", "Low", "Medium", "High", "Critical"]  # rank is the place
CATEGORIES = ["complexity", "dead-code", "documentation", "duplicates", "imports", "performance", "security", "style"]

_KINDS = {"int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "array": T.ArrayType(T.StringType())}
_TYPED = {"line_number": "int", "column_number": "int", "end_line": "int", "end_column": "int", "confidence": "double", "fixable": "boolean", "external_refs": "array", "tags": "array"}
_FIELDS = "rule_id category severity message file_path line_number column_number end_line end_column context code_snippet suggestion cwe confidence fixable external_refs tags"
FINDING_SCHEMA = T.StructType([T.StructField(f, _KINDS[_TYPED[f]] if f in _TYPED else T.StringType()) for f in _FIELDS.split()])
_DEFAULTS: dict[str, object] = {
    "severity": "Medium", "category": "style", "message": "", "line_number": 1, "column_number": 0, "end_line": 0, "end_column": 0, "context": "", "code_snippet": "",
    "suggestion": "", "cwe": None, "confidence": 1.0, "fixable": False,
}

#: Suffixes (without the dot) and whole names of each language, in alphabetical order.
LANGUAGES: dict[str, str] = {
    "c": "c h", "config": "cfg conf env ini toml", "cpp": "c++ cc cpp cxx h++ hpp hxx", "csharp": "cs", "css": "css less sass scss", "dockerfile": "dockerfile", "go": "go",
    "html": "htm html xhtml", "java": "jar java", "javascript": "cjs js jsx mjs", "json": "json jsonc", "markdown": "markdown md mdown", "php": "php php3 php4 php5 phtml",
    "powershell": "ps1 psd1 psm1", "python": "py pyi pyw", "ruby": "gemspec rake rb", "rust": "rs", "shell": "bash fish sh zsh", "sql": "mysql pgsql sql", "svelte": "svelte",
    "typescript": "d.ts ts tsx", "vue": "vue", "xml": "xml xsd xsl xslt", "yaml": "yaml yml",
}
SENSITIVE = set("conf config env ini jks key keystore p12 pem pfx properties secrets".split())
BINARY = set("7z avi bin bmp class dll doc docx dylib exe gif gz ico iso jar jpeg jpg mkv mov mp3 mp4 pdf png ppt pptx rar so svg tar wav xls xlsx zip".split())
PYTHON = set("py pyi pyw".split())
JAVASCRIPT = set("js jsx ts tsx svelte vue".split())


def rank(severity: Column | str) -> Column:
    """0 for Info to 4 for Critical; unknown names count as Info."""
    s = F.lower(F.col(severity) if isinstance(severity, str) else severity)
    return reduce(lambda c, i: c.when(s == SEVERITIES[i].lower(), i), range(1, 5), F.when(s == "info", 0)).otherwise(0)


def findings(rows: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """rows as findings: values are columns or plain values by field; what is left out gets its default."""

    def value(f: T.StructField) -> Column:
        v = values.get(f.name, _DEFAULTS.get(f.name))
        if f.dataType == T.ArrayType(T.StringType()):
            c = v if isinstance(v, Column) else F.array(*[F.lit(x) for x in (v or [])])
            return F.array_sort(F.array_distinct(c.cast(f.dataType)))
        return (v if isinstance(v, Column) else F.lit(v)).cast(f.dataType)

    return rows.select(*[value(f).alias(f.name) for f in FINDING_SCHEMA.fields])


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
