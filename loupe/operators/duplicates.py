"""Duplicate blocks: exact ones by a hash of their normal form, similar ones by winnowing.

Blocks of the same tokens are one class, and only its least block is compared; the
others are given as members. Similar pairs are candidates if they share one of the
rarest fingerprints of each, as many as the threshold needs: a pair that shares none
of them can't reach it, so nothing is lost, and prints that stand everywhere are mostly
not joined. The score is 0.7 times the Jaccard index of fingerprints plus 0.3 times a
token share of at most 1, so that a threshold above 0.3 bounds the Jaccard index.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loupe.model import findings, union
from loupe.operators.graph import _cut
from loupe.session import small_batches
from loupe.sources.files import name_of

_SKIP = "|".join([r"^class.*\(.*\):$", r"^def __init__\(self.*\):$", r"^if __name__ == [\x22\x27]__main__[\x22\x27]:\s*$", r"^(?:pass|return)\s*$"])


#: As in tokens, with what Java takes for a space.
_TOKENS = re.compile(r"[a-zA-Z0-9_]+|[^a-zA-Z0-9_ \t\n\x0b\f\r]")


def normalize(content: Column | str) -> Column:
    """Lines without comments and outer space; blank ones go."""
    ls = F.transform(F.split(content, "\n"), lambda x: F.trim(F.regexp_replace(x, r"#.*$", "")))
    return F.array_join(F.filter(ls, lambda x: x != ""), "\n")


def similarity_hash(content: Column | str) -> Column:
    """sha256 of the text with names, numbers and strings replaced by what they are."""
    c = F.col(content) if isinstance(content, str) else content
    for rx, by in ((r"[a-zA-Z_][a-zA-Z0-9_]*", "VAR"), (r"[0-9]+", "NUM"), (r"\x22[^\x22]*\x22", "STR"), (r"\x27[^\x27]*\x27", "STR")):
        c = F.regexp_replace(c, rx, by)
    return F.sha2(c, 256)


def tokens(content: Column | str) -> Column:
    return F.regexp_extract_all(content, F.lit(r"[a-zA-Z0-9_]+|[^a-zA-Z0-9_\s]"), F.lit(0))


def python_blocks(facts: DataFrame, config: dict[str, Any]) -> DataFrame:
    """blocks(block_id, file_path, start_line, end_line, content) of facts, less short, sparse and boilerplate ones."""
    least = config.get("min_lines", 6)
    b = facts.where("kind = 'block'").select("file_path", F.col("line").alias("start_line"), "end_line", F.col("value").alias("content"), F.col("name").alias("block_type"))
    dense = F.size(F.filter(F.split("content", "\n"), lambda x: F.trim(x) != "")) >= least // 2
    b = b.where((F.col("end_line") - F.col("start_line") + 1 >= least) & dense & ~F.trim("content").rlike(_SKIP))
    return b.withColumn("block_id", F.concat_ws(":", "file_path", "start_line", "end_line", "block_type"))


def text_blocks(docs: DataFrame) -> DataFrame:
    """Documents as blocks."""
    return docs.where("doc_id is not null").select(F.col("doc_id").alias("block_id"), F.concat("source", F.lit("/"), "doc_id").alias("file_path"), F.lit(1).alias("start_line"), F.size(F.split("text", "\n")).alias("end_line"), F.col("text").alias("content"))


def print_sets(blocks: DataFrame, k: int = 17, w: int = 4) -> DataFrame:
    """(block_id, digest, prints): of each w neighbouring hashes of k tokens the least, distinct, and a sha256 of all tokens. No row leaves its task.

    A hash is the first 32 bits of an md5, as an int of the same bits; hashes compare without sign.
    """
    small_batches(blocks.sparkSession)
    t = blocks.select("block_id", normalize("content").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [_prints(x, k, w) for x in b.column(1).to_pylist()]
            some = [i for i, x in enumerate(sets) if x is not None]
            ends = np.cumsum([0] + [len(sets[i][1]) for i in some]).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.int32), *[sets[i][1] for i in some]])
            columns = [b.column(0).take(pa.array(some, pa.int32())), pa.array([sets[i][0] for i in some], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
            yield pa.RecordBatch.from_arrays(columns, ["block_id", "digest", "prints"])

    return t.mapInArrow(work, T.StructType([t.schema["block_id"], T.StructField("digest", T.BinaryType()), T.StructField("prints", T.ArrayType(T.IntegerType()))]))


def _prints(text: str | None, k: int, w: int) -> tuple[bytes, np.ndarray] | None:
    """The digest and the prints of a normal text; None if it is too short."""
    words = _TOKENS.findall(text) if text is not None else []
    n = len(words) - k + 1
    if n < w:
        return None
    line = " ".join(words).encode()
    at = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)  # tokens have no spaces
    starts, ends = [0, *(at + 1).tolist()], [*at.tolist(), len(line)]
    md5 = hashlib.md5
    grams = np.frombuffer(b"".join([md5(line[i:j]).digest()[:4] for i, j in zip(starts, ends[k - 1 :], strict=False)]), ">u4").astype(np.uint32)
    return hashlib.sha256(line).digest(), np.unique(np.lib.stride_tricks.sliding_window_view(grams, w).min(1)).view(np.int32)


def fingerprints(blocks: DataFrame, k: int = 17, w: int = 4) -> DataFrame:
    """(block_id, h): print_sets, a row each, h in hex."""
    h = F.lower(F.lpad(F.hex(F.col("h").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
    return print_sets(blocks, k, w).select("block_id", F.explode("prints").alias("h")).select("block_id", h.alias("h"))


def similar_pairs(blocks: DataFrame, least: float, k: int = 17, w: int = 4) -> tuple[DataFrame, DataFrame]:
    """jaccard_pairs of the blocks that are the least of those of the same tokens, and (a, b) of each such block and every other of its class."""
    sets = _cut(print_sets(blocks, k, w))
    rep = sets.groupBy("digest").agg(F.min("block_id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = _cut(sets.select("block_id", "digest").join(rep, "digest").where("block_id <> rep").select(F.col("rep").alias("a"), F.col("block_id").alias("b")))
    return jaccard_pairs(sets.join(members.select(F.col("b").alias("block_id")), "block_id", "left_anti"), least=least), members


def _shareable(sets: DataFrame, least: float) -> DataFrame:
    """(block_id, n, hs, prefix) of blocks that may reach a Jaccard index of least: the prints that others have too, rarest first, and so many of these that a pair must share one.

    A block has need = ceil(least * n) prints or more in common with any that it pairs
    with, all of them in hs, so that the rarest is not among the last need - 1.
    """
    p = sets.select("block_id", F.size("prints").alias("n"), F.explode("prints").alias("h"))
    p = p.withColumn("df", F.count("*").over(Window.partitionBy("h"))).where("df > 1")
    v = p.groupBy("block_id").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "h"))).alias("hs")).withColumn("hs", F.col("hs.h"))
    need = F.greatest(F.ceil(F.lit(least) * F.col("n") - 1e-9), F.lit(1))
    return v.withColumn("prefix", F.slice("hs", F.lit(1), F.greatest(F.size("hs") - need + 1, F.lit(0)).cast("int"))).where(F.size("prefix") > 0)


def jaccard_pairs(sets: DataFrame, other: DataFrame | None = None, least: float = 0.0) -> DataFrame:
    """(a, b, shared, jaccard) of blocks (block_id, prints) that share a fingerprint and have at least that index: a < b within sets, or a of sets and b of other.

    Within sets, of the prints of the prefixes that the same blocks have only one is
    joined, and a pair comes from the rarest that both have, so that it comes once. With
    other, shared prints are counted where those of a block of sets are, if other is small.
    """
    if other is not None:
        return _against(sets, other, least)
    v = _cut(_shareable(sets, least))
    same = v.select("block_id", F.explode("prefix").alias("h")).groupBy("h").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("block_id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "block_id")).alias("y"))
    kept = same.where("c > 1").groupBy("c", "x", "y").agg(F.min("h").alias("h")).select("h")
    r = v.select("block_id", "n", F.size("hs").alias("s"), F.posexplode("prefix").alias("pos", "h")).join(kept, "h")
    r = r.groupBy("block_id").agg(F.first("n").alias("n"), F.first("s").alias("s"), F.array_sort(F.collect_list(F.struct("pos", "h"))).alias("hs")).withColumn("hs", F.col("hs.h"))
    r = r.select("block_id", "n", "s", "hs", F.posexplode("hs").alias("i", "h"))
    r = _cut(r.select("block_id", "n", "s", "h", F.when(F.col("i") > 0, F.get("hs", F.col("i") - 1)).alias("before"), F.slice("hs", F.lit(1), F.col("i")).alias("earlier")))
    x, y = (r.select("h", *[F.col(c).alias(f"{c}_{z}") for c in ("block_id", "n", "s", "before", "earlier")]) for z in "ab")
    n, t = F.col("n_a") + F.col("n_b"), F.lit(least)
    may = (F.col("block_id_a") < F.col("block_id_b")) & (F.least("n_a", "n_b") >= t * F.greatest("n_a", "n_b")) & (F.least("s_a", "s_b") >= t / (1 + t) * n - 1e-6)
    new = ~F.coalesce(F.col("before_a") == F.col("before_b"), F.lit(False)) & ~F.arrays_overlap("earlier_a", "earlier_b")
    pairs = x.join(y, "h").where(may & new).select(F.col("block_id_a").alias("a"), F.col("block_id_b").alias("b"))
    p = pairs.join(v.select(F.col("block_id").alias("a"), F.col("hs").alias("pa"), F.col("n").alias("na")), "a").join(v.select(F.col("block_id").alias("b"), F.col("hs").alias("pb"), F.col("n").alias("nb")), "b")
    return _indexed(p.select("a", "b", F.size(F.array_intersect("pa", "pb")).cast("long").alias("shared"), (F.col("na") + F.col("nb")).alias("both")), least)


BROADCAST_ROWS = 1_000_000


def _against(sets: DataFrame, other: DataFrame, least: float) -> DataFrame:
    x, y = (z.select(F.col("block_id").alias(i), F.size("prints").alias(f"n{i}"), F.explode("prints").alias("h")) for z, i in ((sets, "a"), (other, "b")))
    y = _cut(y)
    both = x.join(F.broadcast(y) if y.count() <= BROADCAST_ROWS else y, "h")
    return _indexed(both.groupBy("a", "b").agg(F.count("*").alias("shared"), F.first(F.col("na") + F.col("nb")).alias("both")), least)


def _indexed(p: DataFrame, least: float) -> DataFrame:
    return p.select("a", "b", "shared", (F.col("shared").cast("double") / (F.col("both") - F.col("shared"))).alias("jaccard")).where(F.col("jaccard") >= least)


def scored_pairs(blocks: DataFrame, threshold: float = 0.8, k: int = 17, w: int = 4) -> DataFrame:
    """(a, b, jaccard, score) with at least the threshold; the token share counts a's tokens that b has, and a is the lesser block.

    Blocks of the same tokens, long enough to have prints, are one pair a block, with the least of them: both values are 1.
    """
    if threshold <= 0.3:
        raise ValueError("with a threshold of 0.3 or less pairs without a common fingerprint would count")
    p, members = similar_pairs(blocks, (threshold - 0.3) / 0.7, k, w)
    p = _cut(p)
    near = p.select(F.explode(F.array("a", "b")).alias("block_id")).distinct()
    t = blocks.select("block_id", "content").join(near, "block_id", "left_semi").select("block_id", tokens(normalize("content")).alias("w"))
    p = p.join(t.select(F.col("block_id").alias("a"), F.col("w").alias("wa")), "a").join(t.select(F.col("block_id").alias("b"), F.col("w").alias("wb")), "b")
    p = p.withColumn("has", F.explode(F.array(F.map_from_arrays(F.array_distinct("wb"), F.transform(F.array_distinct("wb"), lambda _: F.lit(1))))))
    common = F.size(F.filter("wa", lambda x: F.map_contains_key("has", x)))
    score = 0.7 * F.col("jaccard") + 0.3 * common / F.greatest(F.size("wa"), F.size("wb"))
    near = p.select("a", "b", "jaccard", score.alias("score")).where(F.col("score") >= threshold)
    return near.unionByName(members.select("a", "b", F.lit(1.0).alias("jaccard"), F.lit(1.0).alias("score")))


def exact_groups(blocks: DataFrame) -> DataFrame:
    """(similarity_hash, block_ids sorted, n_blocks) of two or more."""
    g = blocks.groupBy(similarity_hash(normalize("content")).alias("similarity_hash")).agg(F.array_sort(F.collect_list("block_id")).alias("block_ids"), F.count("*").alias("n_blocks"))
    return g.where("n_blocks > 1")


def exact_pairs(blocks: DataFrame) -> DataFrame:
    """(a, b) of blocks of one hash: each block with the first of its hash by file and line; not blocks of one file within three lines.

    A block that is so near the first goes with the first that is not, if there is one.
    Linear in the blocks: m copies give m - 1 rows.
    """
    cols = ["file_path", "start_line", "block_id", "end_line", "content"]
    h = blocks.select(F.struct(*cols[:4]).alias("x"), "content", similarity_hash(normalize("content")).alias("h"))
    first = h.groupBy("h").agg(F.min("x").alias("one"), F.count("*").alias("n")).where("n > 1").drop("n")
    near = lambda a, b: (F.col(f"{a}.file_path") == F.col(f"{b}.file_path")) & (F.abs(F.col(f"{a}.start_line") - F.col(f"{b}.start_line")) < 3)
    j = h.join(first, "h")
    second = j.where(~near("x", "one")).groupBy("h").agg(F.min("x").alias("two"))
    j = j.where("x <> one").join(second, "h", "left")
    a = F.when(~near("x", "one"), F.col("one")).when(F.col("two").isNotNull() & ~near("x", "two"), F.col("two"))
    j = j.withColumn("a", a).where("a is not null")
    same = lambda s, c: F.col(f"{s}.{c}")
    swap = F.struct("a.file_path", "a.start_line", "a.block_id") > F.struct("x.file_path", "x.start_line", "x.block_id")
    # both have one hash but may differ in names: the content of a is read from its own row
    texts = h.select(F.col("x").alias("a"), F.col("content").alias("content_first")).join(j.select("a").distinct(), "a", "left_semi")
    j = j.join(texts, "a")
    out = []
    for c in cols:
        ca, cb = (F.col("content_first"), F.col("content")) if c == "content" else (same("a", c), same("x", c))
        out += [F.when(swap, cb).otherwise(ca).alias(f"{c}_a"), F.when(swap, ca).otherwise(cb).alias(f"{c}_b")]
    return j.select("h", *out)


def preview(content: Column) -> Column:
    ls = F.split(content, "\n")
    return F.concat(F.array_join(F.slice(ls, 1, 3), "\n"), F.when(F.size(ls) > 3, "\n...").otherwise(""))


def duplicate_findings(blocks: DataFrame, config: dict[str, Any]) -> DataFrame:
    """Two findings a pair of exact duplicates (see exact_pairs), and one a pair of similar blocks of different files."""
    parts = []
    if least := config.get("min_tokens", 0):
        blocks = blocks.where(F.size(tokens("content")) >= least)
    n = F.col("end_line_a") - F.col("start_line_a") + 1
    place = lambda s: F.concat(name_of(F.col(f"file_path_{s}")), F.lit(":"), F.col(f"start_line_{s}").cast("string"))
    if config.get("exact", True):
        p = exact_pairs(blocks)
        long = F.concat(n.cast("string"), F.lit("-lines"))
        for mine, other, primary in (("a", "b", True), ("b", "a", False)):
            parts.append(findings(p, {
                "rule_id": "exact-duplicate", "category": "duplicates", "severity": F.when(n > 15, "Medium").otherwise("Low") if primary else "Low",
                "message": F.format_string("Exact duplicate code block (%d lines)", n) if primary else F.concat(F.lit("Duplicate of code block at "), place("a")), "file_path": F.col(f"file_path_{mine}"),
                "line_number": F.col(f"start_line_{mine}"), "end_line": F.col(f"end_line_{mine}"), "context": preview(F.col(f"content_{mine}")), "suggestion": F.concat(F.lit("The same stands at "), place(other)),
                "tags": F.array(F.lit("duplicate"), F.lit("exact"), long) if primary else F.array(F.lit("duplicate"), F.lit("exact"), long, F.lit("secondary")),
            }))
    if config.get("structural", True) or config.get("partial", False):
        order = blocks.withColumn("key", F.struct("file_path", "start_line", "block_id"))
        s = scored_pairs(order.drop("block_id").withColumnRenamed("key", "block_id"), config.get("threshold", 0.8), config.get("k", 17), config.get("w", 4))
        s = s.where(F.col("a.file_path") != F.col("b.file_path"))
        info = order.select("key", "end_line", "content")
        s = s.join(info.select(F.col("key").alias("a"), F.col("end_line").alias("end_line_a"), F.col("content").alias("content_a")), "a")
        s = s.select("score", "end_line_a", "content_a", F.col("a.file_path").alias("file_path_a"), F.col("a.start_line").alias("start_line_a"), F.col("b.file_path").alias("file_path_b"), F.col("b.start_line").alias("start_line_b"))
        kind = F.when(F.col("score") < 0.95, "structural").otherwise("near-exact")
        parts.append(findings(s, {
            "rule_id": F.concat(kind, F.lit("-duplicate")), "category": "duplicates", "severity": F.when(F.col("score") > 0.9, "Medium").otherwise("Low"),
            "message": F.format_string("%s duplicate code (%.1f%% similar, %d lines)", F.initcap(kind), F.col("score") * 100, n), "file_path": F.col("file_path_a"), "line_number": F.col("start_line_a"),
            "end_line": F.col("end_line_a"), "context": preview(F.col("content_a")), "confidence": F.col("score"), "suggestion": F.concat(F.lit("Related code at "), place("b")),
            "tags": F.array(F.lit("duplicate"), kind, F.concat(n.cast("string"), F.lit("-lines")), F.format_string("%.0f%%-similar", F.col("score") * 100)),
        }))
    return union(parts)
