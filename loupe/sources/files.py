"""Source files as a table, and predicates over their paths.

files(file_path, content, size_bytes, ext, language, category). The scan is lazy and
distributed; directory, name and size filters are plain predicates on it, so that
content is decoded only for files that stay.
"""

from __future__ import annotations

import fnmatch
import warnings
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.model import BINARY, LANGUAGES, PYTHON, SENSITIVE

SCHEMA = "file_path string, content string, size_bytes bigint"
_MARKERS = {"python": "setup.py pyproject.toml requirements.txt setup.cfg pipfile", "javascript": "package.json", "typescript": "tsconfig.json"}


def name_of(path: Column | str) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(p, r"([^/\\]*)$", 1)


def ext_of(path: Column | str) -> Column:
    """The suffix in lower case without its dot; empty without one or for dot files."""
    return F.lower(F.regexp_extract(name_of(path), r"[^.].*?\.([^.]+)$|^[^.]+\.([^.]+)$", 1))


def suffix(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(name_of(path), r".\.([^.]+)$", 1))


def language_of(path: Column | str) -> Column:
    """By whole name or suffix, null if unknown; a name that ends in .d.ts is TypeScript."""
    pairs = [(s, lang) for lang, all_ in LANGUAGES.items() for s in all_.split() if "." not in s and s != "jar"] + [("jar", "java")]
    m = F.create_map(*[F.lit(x) for p in pairs for x in p])
    lower = F.lower(name_of(path))
    return F.coalesce(F.when(lower == "dockerfile", "dockerfile"), F.when(lower.endswith(".d.ts"), "typescript"), F.try_element_at(m, suffix(path)), F.when(lower == ".env", "config"))


def is_binary(path: Column | str) -> Column:
    return suffix(path).isin(sorted(BINARY))


def is_sensitive(path: Column | str) -> Column:
    lower = F.lower(name_of(path))
    return suffix(path).isin(sorted(SENSITIVE)) | lower.rlike("secret|password|key|token") | (lower == ".env")


def is_text(path: Column | str) -> Column:
    return ~is_binary(path) & (language_of(path).isNotNull() | suffix(path).isin("txt", "text", "csv", "log", "rst", "tsv"))


def category_of(path: Column | str) -> Column:
    lang = language_of(path)
    return (
        F.when(lang.isNull(), "unknown").when(lang == "markdown", "documentation").when(lang.isin("config", "json", "xml", "yaml"), "configuration")
        .when(lang.isin("dockerfile", "powershell", "shell"), "infrastructure").when(lang.isNotNull(), "source").otherwise("other")
    )


def is_source(path: Column | str) -> Column:
    lang = language_of(path)
    return lang.isNotNull() & ~lang.isin("config", "json", "markdown", "xml", "yaml")


def is_configuration(path: Column | str) -> Column:
    return F.coalesce(language_of(path).isin("config", "json", "xml", "yaml"), F.lit(False))


def for_security(path: Column | str) -> Column:
    return is_text(path) & (is_source(path) | is_configuration(path) | is_sensitive(path))


def is_python(path: Column | str) -> Column:
    return suffix(path).isin(sorted(PYTHON))


def normalized(path: Column | str) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(F.regexp_replace(F.replace(p, F.lit("\\"), F.lit("/")), r"/(\./)+", "/"), r"(?<=.)/+$", "")


def glob(path: Column | str, pattern: str) -> Column:
    """Whether a shell pattern matches the whole path, the name, or with a trailing /** a parent folder."""
    p = F.col(path) if isinstance(path, str) else path
    rx = "^" + fnmatch.translate(pattern).replace(r"\z", r"\Z").replace(r"\Z", "$")
    out = p.rlike(rx) | name_of(p).rlike(rx)
    if pattern.endswith("/**"):
        folder = "^" + fnmatch.translate(pattern[:-3]).replace(r"\z", r"\Z").replace(r"\Z", "$")
        parts = F.split(p, "/")
        parents = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
        out = out | F.exists(parents, lambda x: x.rlike(folder))
    return out


def glob_or_part(path: Column | str, pattern: str) -> Column:
    """The editor's rule: a match, or the pattern's text anywhere in the path."""
    p = F.col(path) if isinstance(path, str) else path
    return glob(p, pattern) | p.contains(pattern)


def skip_reason(path: Column | str, size: Column, config: dict[str, Any]) -> Column:
    """Why a file is not analysed, or null: hidden, too large, folder, pattern, language."""
    p = F.col(path) if isinstance(path, str) else path
    ex = config["exclude"]
    parts = F.split(p, "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    in_dir = F.arrays_overlap(folders, F.array(*[F.lit(d) for d in ex["dirs"]])) if ex["dirs"] else F.lit(False)
    patterns = F.lit(False)
    for x in [*ex["files"], *ex["patterns"]]:
        patterns = patterns | glob(p, x)
    return (
        F.when(name_of(p).startswith("."), "hidden").when(size > config["max_file_size"], "too large").when(in_dir, "folder").when(patterns, "pattern")
        .when(language_of(p).isNull(), "language")
    )


def described(files: DataFrame) -> DataFrame:
    return files.withColumns({"ext": suffix("file_path"), "language": language_of("file_path"), "category": category_of("file_path")})


def analysed(path: Column | str, size: Column, config: dict[str, Any]) -> Column:
    """Whether no skip_reason holds, as conjuncts of their own: those on the size and the path reach the source before content is read."""
    p = F.col(path) if isinstance(path, str) else path
    ex = config["exclude"]
    out = (size <= config["max_file_size"]) & ~name_of(p).startswith(".")
    if ex["dirs"]:
        out = out & ~p.rlike("(^|/)(?:" + "|".join(_quoted(d) for d in ex["dirs"]) + ")/")
    for x in [*ex["files"], *ex["patterns"]]:
        out = out & ~glob(p, x)
    return out & language_of(p).isNotNull()


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else "\\" + c for c in text)


def existing(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """The paths that are there; others are told by a warning. ValueError if none is: there is nothing to analyse."""
    out = []
    for p in [paths] if isinstance(paths, str) else paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.globStatus(at):
            out.append(p)
        else:
            warnings.warn(f"no such path: {p}", stacklevel=3)
    if not out:
        raise ValueError(f"no such path: {paths}")
    return out


def scan(spark: SparkSession, paths: str | list[str], config: dict[str, Any] | None = None, pattern: str | None = None, limit: int | None = None) -> DataFrame:
    """The files below paths (folders or files), without excluded ones if there is a config.

    Malformed UTF-8 is left out of the content, unreadable content is null. Missing paths
    are told by a warning and the others are read; ValueError if none is there.
    """
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    raw = r.load(existing(spark, paths))
    if config:
        raw = raw.where(F.col("length") <= config["max_file_size"])  # alone, so that the source takes it
    raw = raw.withColumn("file_path", F.regexp_replace("path", "^file:/+", "/"))
    if config:
        raw = raw.where(analysed("file_path", F.col("length"), config))
    out = described(raw.select("file_path", text_of("content").alias("content"), F.col("length").alias("size_bytes")))
    return out.orderBy("file_path").limit(limit) if limit else out


def text_of(content: Column | str) -> Column:
    """Bytes as UTF-8 text, without those that are malformed; those that stand for the replacement character itself go with them."""
    c = F.col(content) if isinstance(content, str) else content
    return F.when(F.is_valid_utf8(c.cast("string")), c.cast("string")).otherwise(F.replace(F.make_valid_utf8(c.cast("string")), F.lit("\ufffd"), F.lit("")))


def from_rows(spark: SparkSession, rows: list[tuple[str, str | None]]) -> DataFrame:
    """For tests and editors: files given as (path, content)."""
    return described(spark.createDataFrame([(p, c, len((c or "").encode())) for p, c in rows], SCHEMA))


def from_documents(docs: DataFrame) -> DataFrame:
    """Documents as files of the path source/doc_id.txt."""
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt"))
    return docs.select(path.alias("file_path"), F.col("text").alias("content"), F.octet_length("text").cast("long").alias("size_bytes"), F.lit("txt").alias("ext"), F.col("lang").alias("language"), F.lit("documentation").alias("category"))


def read_errors(files: DataFrame) -> DataFrame:
    """A finding for each file whose content could not be read."""
    from loupe.model import findings

    return findings(files.where("content is null"), {"rule_id": "file-read-error", "category": "security", "severity": "Low", "message": F.concat(F.lit("File can't be read: "), F.col("file_path")), "file_path": F.col("file_path")})


def by_language(files: DataFrame) -> DataFrame:
    """(language, file_path), sorted: a row a file, so that no language has to fit a row."""
    return files.select(F.coalesce("language", F.lit("unknown")).alias("language"), "file_path").orderBy("language", "file_path")


def scan_statistics(files: DataFrame) -> DataFrame:
    """(n_files, n_bytes, n_languages, n_unreadable) of a scan."""
    return files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("n_bytes"), F.countDistinct("language").alias("n_languages"), F.count_if(F.col("content").isNull()).alias("n_unreadable"))


def project_info(files: DataFrame) -> DataFrame:
    """Files and bytes by language, and under GROUPING SETS' total row (language null) those of all."""
    f = files.select(F.coalesce("language", F.lit("unknown")).alias("language"), "size_bytes")
    return f.rollup("language").agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("n_bytes"))


def project_types(files: DataFrame) -> DataFrame:
    """The project types whose marker files are there."""
    pairs = [(n, kind) for kind, names in _MARKERS.items() for n in names.split()]
    markers = files.sparkSession.createDataFrame(pairs, "marker string, project_type string")
    return files.select(F.lower(name_of("file_path")).alias("marker")).join(F.broadcast(markers), "marker").select("project_type").distinct()


def languages(spark: SparkSession) -> DataFrame:
    """(language, ext): the dimension itself."""
    return spark.createDataFrame([(lang, e) for lang, all_ in LANGUAGES.items() for e in all_.split()], "language string, ext string")
