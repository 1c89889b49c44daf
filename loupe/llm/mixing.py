"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source whose token budget is several times its tokens gives that many complete
epochs, and what is left of the budget is filled by a weighted sample without
replacement: documents in order of exponential keys -ln(u) / weight, as long as
the prefix sum of tokens stays within the rest. The prefix sums are taken over a
histogram of keys first, so that only the one bucket a source in which the budget
ends is sorted; a source of any size needs no single sorted partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loupe.llm.common import materialize, read, unit, unit_sql, unused

BUCKETS = 4096
BROADCAST_ROWS = 100_000
_MARKS = "#$%&*|!0123456789"


def word_count(text: Column) -> Column:
    """Words by single spaces; 0 for null and empty texts."""
    return F.when(F.length(text) > 0, F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).otherwise(0).cast("long")


def text_weight(text: Column) -> Column:
    """A document's quality weight: a quarter, and three quarters of the share of characters that are no marks or digits. 1/4 for null and empty texts."""
    return F.when(F.length(text) > 0, 0.25 + 0.75 * F.length(F.translate(text, _MARKS, "")) / F.length(text)).otherwise(0.25)


def mix_sources(docs: DataFrame, targets: dict[str, float] | None = None, budget: int | None = None, alpha: float = 0.5, seed: str = "mix", plan: bool = False) -> DataFrame:
    """docs, each row as many times as the mixture holds it; with plan, once, with n_tokens, weight, sample_key and copies.

    targets: the share of each source (scaled to a sum of 1; sources that it lacks
    get 0), or None: shares as the power alpha of a source's tokens. budget: tokens in
    all, or None: as many as docs has. A null source is a source of its own, named
    by "" in targets. Texts without words have 0 tokens and go with the key they
    have. Rows of equal key (one doc_id twice, or several without one) are taken
    together or not at all. Where all shares are 0 no tokens are taken. A source without
    tokens gives one epoch if it has a budget.
    Columns that would clash get underscores. An empty table gives none.
    """
    s, n, w, k, b, c = (unused(docs, x) for x in ("mix_source", "n_tokens", "weight", "sample_key", "key_bucket", "copies"))
    keyed = docs.withColumns({s: F.coalesce(F.col("source").cast("string"), F.lit("")), n: word_count(F.col("text")), w: text_weight(F.col("text"))})
    keyed = keyed.withColumn(k, -F.log(unit(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), seed)) / F.col(w))
    keyed = keyed.withColumn(b, F.floor(BUCKETS * (1 - F.exp(-F.col(k)))).cast("int"))
    light = materialize(keyed.select(F.col(s).alias("s"), F.col(n).alias("n"), F.col(k).alias("k"), F.col(b).alias("b")), "keys")
    hist = materialize(light.groupBy("s", "b").agg(F.sum("n").alias("n")), "hist")
    totals = hist.groupBy("s").agg(F.sum("n").alias("t"))
    if targets is None:
        totals = totals.withColumn("share", F.pow("t", F.lit(alpha)))
    else:
        pairs = docs.sparkSession.createDataFrame([(x, float(y)) for x, y in targets.items()] or [("", 0.0)], "s string, share double")
        totals = totals.join(pairs, "s", "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    sums = totals.agg(F.sum("t").alias("all"), F.sum("share").alias("shares"))
    want = F.floor(F.try_divide("share", "shares") * (F.lit(budget) if budget is not None else F.col("all")))
    budgets = totals.crossJoin(sums).withColumn("want", F.coalesce(want, F.lit(0)))
    budgets = budgets.withColumn("epochs", F.when(F.col("t") > 0, F.floor(F.col("want") / F.col("t"))).otherwise((F.col("want") > 0).cast("long")))
    budgets = budgets.withColumn("rest", F.greatest(F.col("want") - F.col("epochs") * F.col("t"), F.lit(0))).select("s", "epochs", "rest")
    by_key = Window.partitionBy("s").orderBy("b")
    cum = hist.withColumn("upto", F.sum("n").over(by_key)).join(budgets, "s")
    edge = cum.where("upto > rest").groupBy("s").agg(F.min("b").alias("edge"), F.min_by(F.col("upto") - F.col("n"), "b").alias("base"))
    edge = edge.join(budgets, "s")
    inside = light.join(edge.select("s", F.col("edge").alias("b"), "base", "rest"), ["s", "b"])
    inside = inside.withColumn("upto", F.col("base") + F.sum("n").over(Window.partitionBy("s").orderBy("k")))
    last = inside.where("upto <= rest").groupBy("s").agg(F.max("k").alias("last"))
    cuts = budgets.join(edge.select("s", "edge"), "s", "left").join(last, "s", "left").select(F.col("s").alias("cut_s"), "epochs", "edge", "last")
    cuts = materialize(cuts.select(*[F.col(x).alias(unused(keyed, x)) for x in cuts.columns]), "cuts")
    cs, ep, ed, la = (F.col(x) for x in cuts.columns)
    if cuts.count() <= BROADCAST_ROWS:  # a row a source
        cuts = F.broadcast(cuts)
    taken = F.when(ed.isNull() | (F.col(b) < ed) | ((F.col(b) == ed) & (F.col(k) <= la)), 1).otherwise(0)
    out = keyed.join(cuts, F.col(s) == cs).withColumn(c, (ep + taken).cast("int")).where(F.col(c) > 0)
    if plan:
        return out.select(*docs.columns, n, w, k, c)
    again = unused(out, "again")
    return out.withColumn(again, F.explode(F.sequence(F.lit(1), F.col(c)))).select(*docs.columns)


def op2_mixing_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mixture holds each document of documents that it holds at all."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = mix_sources(docs, plan=True)
    return out.select("doc_id", "source", "n_tokens", F.round("weight", 6).alias("weight"), F.round("sample_key", 6).alias("sample_key"), "copies")


OP2_SQL = f"""
with d as (
  select doc_id, source, coalesce(source, '') s,
    case when length(text) > 0 then length(text) - length(replace(text, ' ', '')) + 1 else 0 end n,
    case when length(text) > 0 then 0.25::double + 0.75::double * length(translate(text, '{_MARKS}', '')) / length(text) else 0.25 end w
  from documents),
k as (select *, -ln({unit_sql("doc_id", "mix")}) / w k from d),
t as (select s, sum(n) t, pow(sum(n), 0.5) share from d group by s),
b as (select s, t, floor(share / (select sum(share) from t) * (select sum(t) from t))::bigint want from t),
e as (select s, t, want, case when t > 0 then want // t else (want > 0)::bigint end epochs from b),
p as (select k.*, epochs, greatest(want - epochs * t, 0) rest, sum(n) over (partition by s order by k) upto from k join e using (s))
select doc_id, source, n::bigint n_tokens, round(w, 6) weight, round(k, 6) sample_key, (epochs + (upto <= rest)::int)::int copies
from p where epochs + (upto <= rest)::int > 0
"""
