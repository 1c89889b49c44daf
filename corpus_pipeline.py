"""A training corpus from documents: bad ones, repeated lines and near copies go, sources are mixed, and the rest is encoded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.llm.common import materialize, read
from loupe.llm.lines import dedup_lines
from loupe.llm.mixing import mix_sources
from loupe.llm.quality import fit_quality, keep_good
from loupe.llm.sentencepiece import encode
from loupe.llm.simhash import keep_one

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is trained on the labels of sf_dir.

    A null text is judged as an empty one; labels without doc_id or of other values than
    0 and 1 don't count, and without any every document scores one half and stays. Rows
    are judged one by one, on whole texts of any length, so that repeated rows and ties
    of the score go or stay together. An empty table gives an empty one.
    """
    return keep_good(docs, fit_quality(docs, read(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier in the corpus go, with documents of which nothing else is left; n_chars follows the text.

    Earlier is by doc_id, rows without one last and among themselves by a hash of their
    text. Null and blank texts have no lines to lose and stay. Rows that repeat doc_id
    and text count as one and keep the same lines. A doc_id that is no number raises. An
    empty table gives an empty one.
    """
    clean, _ = dedup_lines(docs)
    clean = clean.where((F.col("n_dropped") == 0) | (F.trim("text") != ""))
    return clean.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the least doc_id.

    Documents are near by what they are now or by their texts in sf_dir's documents: line
    dedup takes shared lines out of the later copy, and what is left of it would look like
    nothing else. Null and wordless texts and rows without a doc_id are in no group and
    stay; rows of one doc_id go or stay together. An empty table gives an empty one.
    """
    return keep_one(docs, earlier=read(spark, sf_dir, "documents"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in shares as the root of their tokens; a document stands as often as its source's epochs say.

    A null source is one of its own. Texts without words have no tokens and go with the
    key they have; rows of one doc_id have one key and are taken together or not at all.
    An empty table gives an empty one.
    """
    return mix_sources(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each row, one where a text has no more.

    Each row is encoded by itself, on its whole text; repeated rows get the same. A null
    or empty text has the one piece of the space that is put first. An empty table gives
    an empty one.
    """
    return encode(docs, carry=("doc_id", "lang", "source"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding", encoding_stage),
]

#: The classifier, SimHash and sampled encodings have no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage{i}")
    return docs
