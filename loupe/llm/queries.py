"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loupe.llm import lines, mixing, ngrams, quality, sentencepiece, simhash, toxicity, vectors, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dedup": vectors.op1_embedding_near_dedup,
    "op2_mixing_plan": mixing.op2_mixing_plan,
    "op3_line_dedup": lines.op3_line_dedup,
    "op4_lm_scores": ngrams.op4_lm_scores,
    "op5_simhash_groups": simhash.op5_simhash_groups,
    "op6_sentencepiece_samples": sentencepiece.op6_sentencepiece_samples,
    "op7_warc_salvage": warc.op7_warc_salvage,
    "op7_warc_salvage_log": warc.op7_warc_salvage_log,
    "op8_learned_partitions_ann": vectors.op8_learned_partitions_ann,
    "op8_recall_of_partitions": vectors.op8_recall_of_partitions,
    "op9_quality_gam": quality.op9_quality_gam,
    "op10_toxic_spans": toxicity.op10_toxic_spans,
    "op10_span_scores": toxicity.op10_span_scores,
}

SQL: dict[str, str] = {
    "op1_embedding_near_dedup": vectors.OP1_SQL,
    "op2_mixing_plan": mixing.OP2_SQL,
    "op3_line_dedup": lines.OP3_SQL,
    "op4_lm_scores": ngrams.OP4_SQL,
    "op7_warc_salvage": warc.OP7_SQL,
    "op8_learned_partitions_ann": vectors.OP8_SQL,
    "op8_recall_of_partitions": vectors.OP8_RECALL_SQL,
}
