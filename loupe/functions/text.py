"""Column functions over texts and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lines(files: DataFrame, key: str = "file_path", content: str = "content") -> DataFrame:
    """(key, line_number from 1, line)."""
    return files.select(key, F.posexplode(F.split(content, "\r?\n")).alias("pos", "line")).select(key, (F.col("pos") + 1).alias("line_number"), "line")


def entropy(s: Column | str) -> Column:
    """Shannon entropy in bits over the characters; 0 for an empty string."""
    cs = F.filter(F.split(s, ""), lambda x: x != "")
    n = F.size(cs)
    share = F.transform(F.array_distinct(cs), lambda ch: F.size(F.filter(cs, lambda x: x == ch)) / n)
    return F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p))


def context(content: Column | str, line: Column, around: int = 3) -> Column:
    """The lines from around before to around after a line, joined; empty where there is none."""
    ls = F.split(content, "\r?\n")
    first = F.greatest(line - around, F.lit(1))
    return F.array_join(F.slice(ls, first, F.greatest(F.least(line + around, F.size(ls)) - first + 1, F.lit(0))), "\n")


def line_at(content: Column | str, line: Column) -> Column:
    return F.coalesce(F.get(F.split(content, "\r?\n"), line - 1), F.lit(""))


def match_columns(line: Column | str, pattern: str) -> Column:
    """array of (text, column from 1) of all matches."""
    return match_places(line, F.regexp_extract_all(line, F.lit(pattern), F.lit(0)))


def match_places(line: Column | str, found: Column) -> Column:
    """array of (text, column from 1) of texts found in a line, in order: each is sought after the end of the one before."""
    whole = F.col(line) if isinstance(line, str) else line
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<text:string,column:int>>").alias("out"))
    return F.aggregate(found, start, lambda acc, m: _step(acc, m, whole))["out"]


def _step(acc: Column, m: Column, whole: Column) -> Column:
    rest = F.substring(whole, acc["at"], F.length(whole))
    at = (acc["at"] + F.instr(rest, m) - 1).cast("int")
    after = (at + F.length(m)).cast("int")
    return F.struct(after.alias("at"), F.concat(acc["out"], F.array(F.struct(m.alias("text"), at.alias("column")))).alias("out"))
