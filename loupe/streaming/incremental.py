"""Analysis of files as they come: a stream of new files, the same rules in each batch, findings deduplicated by key."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loupe.operators.findings import KEY
from loupe.operators.security import entropy_findings, pattern_findings
from loupe.sources.files import described


def file_stream(spark: SparkSession, path: str, pattern: str | None = None, per_batch: int = 1000) -> DataFrame:
    """files, of files that appear below path."""
    r = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    raw = r.load(path).withColumn("file_path", F.regexp_replace("path", "^file:/+", "/"))
    return described(raw.select("file_path", F.decode("content", "UTF-8").alias("content"), F.col("length").alias("size_bytes"), "modificationTime"))


def table_stream(spark: SparkSession, path: str, schema: str, per_batch: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def stateless_findings(files: DataFrame, config: dict[str, Any]) -> DataFrame:
    """The rules that need one file at a time and no Python: they run on a stream as they are."""
    return pattern_findings(files, config).unionByName(entropy_findings(files, config))


def analyse_stream(files: DataFrame, checkpoint: str, rule: Callable[[DataFrame], DataFrame], target: str) -> StreamingQuery:
    """Each batch's findings, once by key over all batches, as Parquet below target; a batch that is run again replaces its own folder and sees only those before it."""

    def write(batch: DataFrame, number: int) -> None:
        found = rule(batch).dropDuplicates(KEY)
        spark = batch.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(target)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            before = spark.read.schema(f"{found.select(*KEY)._jdf.schema().toDDL()}, batch long").parquet(target).where(F.col("batch") < number)
            found = found.join(before.select(*KEY), KEY, "left_anti")
        found.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def rolling_counts(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Findings or events (ts, event_type) counted in tumbling windows, with a watermark for late ones."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
