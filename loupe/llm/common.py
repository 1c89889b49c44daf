"""What the corpus operators share: tables, materialisation, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.session import small_batches  # noqa: F401 (for the operators)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors reach; a temporary one only in local mode, where there is but one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not at.isDefined() and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = at.get() if at.isDefined() else tempfile.mkdtemp(prefix="loupe-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """df, written once as a table in the shared folder and read back: its lineage ends there. The application's tables go when its JVM ends."""
    spark = df.sparkSession
    root = f"{shared_folder(spark)}/loupe-{spark.sparkContext.applicationId}"
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if root not in _to_go:
        at = spark._jvm.org.apache.hadoop.fs.Path(root)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
        _to_go.add(root)
    return spark.read.schema(df.schema).parquet(path)


_to_go: set[str] = set()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint; the files go when df is no longer used, if Spark is told to clean them."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def unused(df: DataFrame, name: str) -> str:
    """name, or name with underscores, such that df has no such column in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b): one row (node, root) for each node, root the least node.

    Alternating large-star and small-star steps; each step is one shuffle-bound
    aggregation and the number of rounds grows with the logarithm of the longest
    chain. Every round is checkpointed, so a lost executor costs one round.
    Self edges give a component of one; null ends are ignored; no edges, no rows.
    """
    e = cut(edges.where("a is not null and b is not null").select(F.col("a").cast("long"), F.col("b").cast("long")).distinct())
    last = None
    for _ in range(most_rounds):
        both = e.where("a <> b").select("a", "b").union(e.where("a <> b").select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        e2 = cut(small.where("a <> b").distinct())
        now = e2.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == last:
            break
        last, e = now, e2
    else:
        raise RuntimeError("components did not converge")
    star = e2.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    nodes = edges.select(F.col("a").cast("long").alias("node")).union(edges.select(F.col("b").cast("long"))).where("node is not null").distinct()
    return nodes.join(star, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def unit(key: Column, salt: str) -> Column:
    """A number above 0 and below 1 from the first 52 bits of an md5; DuckDB finds the same."""
    hex13 = F.substring(F.md5(F.concat(key.cast("string"), F.lit(salt)).cast("binary")), 1, 13)
    return (F.conv(hex13, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def unit_sql(key: str, salt: str) -> str:
    return f"((('0x' || substr(md5(cast({key} as varchar) || '{salt}'), 1, 13))::bigint::double + 0.5) / 4503599627370496.0)"
