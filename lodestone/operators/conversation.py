"""Signals over the turns of a conversation. A conversation's turns meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestone.functions import text as X


def escalation(df: DataFrame, key: str, order: list[str], risk: str, last: int = 4) -> DataFrame:
    """key, first, latest, delta, escalated: over the last turns, at least three, the risk rose from at most 0.2 to at least 0.35, late mean over early by 0.25."""
    w = W.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    x = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last)
    g = x.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(-F.col("_r"), F.col(risk).alias("x")))), lambda y: y["x"]).alias("s")).where(F.size("s") >= 3)
    half = F.floor(F.size("s") / 2).cast("int")

    def mean(a):
        return F.aggregate(a, F.lit(0.0), lambda t, y: t + y) / F.size(a)

    early, late = mean(F.slice("s", F.lit(1), half)), mean(F.slice("s", half + 1, F.size("s") - half))
    first, latest = F.col("s")[0], F.element_at("s", -1)
    return g.select(key, F.round(first, 6).alias("first"), F.round(latest, 6).alias("latest"), F.round(late - early, 6).alias("delta"), ((first <= 0.2) & (latest >= 0.35) & (late - early >= 0.25)).alias("escalated"))


def prior_overlap(df: DataFrame, key: str, order: list[str], ident: str, text: str) -> DataFrame:
    """ident, n_words, n_prior: different words of five letters or more of a turn, and those that an earlier turn has. The first turn of each word is found by
    aggregation, so no turn's history is collected."""
    w = df.select(key, *order, ident, F.explode(F.array_distinct(X.tokens(F.col(text)))).alias("_w")).where(F.length("_w") >= 5)
    at = F.struct(*order)
    first = w.groupBy(key, "_w").agg(F.min(at).alias("_first"))
    x = w.join(first, [key, "_w"])
    return x.groupBy(ident).agg(F.count("*").alias("n_words"), F.sum(F.when(at > F.col("_first"), 1).otherwise(0)).alias("n_prior"))


def topic_drift(df: DataFrame, key: str, order: list[str], ident: str, text: str) -> DataFrame:
    """ident, drift: 1 - cosine of the word counts of a turn and the turn before; null for the first."""
    turn = df.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    n = turn.select(key, "_k", F.explode(X.tokens(F.col(text))).alias("_w")).groupBy(key, "_k", "_w").agg(F.count("*").alias("c"))
    size = n.groupBy(key, "_k").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("s"))
    before = n.select(key, (F.col("_k") + 1).alias("_k"), "_w", F.col("c").alias("b"))
    dot = n.join(before, [key, "_k", "_w"]).groupBy(key, "_k").agg(F.sum(F.col("c") * F.col("b")).alias("d"))
    x = turn.select(key, "_k", ident).join(size, [key, "_k"], "left").join(size.select(key, (F.col("_k") + 1).alias("_k"), F.col("s").alias("t")), [key, "_k"], "left").join(dot, [key, "_k"], "left")
    return x.select(ident, F.when(F.col("_k") > 1, F.round(1 - F.coalesce(F.col("d"), F.lit(0)) / F.nullif(F.col("s") * F.col("t"), F.lit(0.0)), 6) + 0.0).alias("drift"))
