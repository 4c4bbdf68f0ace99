"""Phrase sets: membership of word n-grams, proximity of roles, tiered scores."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestone.functions import text as X


def phrase_hits(df: DataFrame, key: str, text: str, phrases: DataFrame, sizes: tuple[int, ...] = (3, 4, 5)) -> DataFrame:
    """key, phrase, category of each phrase (of 3 to 5 words, lower case) that a text holds, each once. A user's own phrases are just rows of `phrases`.

    Texts become their n-grams, which are looked up in the phrase set; the set is a dimension that Spark broadcasts while its size permits. Both joins can send
    only the set to the driver: n-grams are many times what Spark takes their text's table for, so an inner join would at times broadcast them instead. Of a set
    whose size Spark doesn't know when it plans (rows of Python objects) all n-grams are shuffled; see known_size. N-grams are made place by place, without
    lambdas, so that they run in generated code up to the join; a plain posexplode would find the words three times, as Spark puts a filter on them before it.
    """
    words = df.select(key, X.tokens(F.col(text)).alias("_w")).select(key, "_w", F.posexplode_outer("_w").alias("_i", "_first"))
    own = [F.when(F.size("_w") - F.col("_i") >= n, F.array_join(F.slice("_w", F.col("_i") + 1, n), " ")) for n in sizes]
    grams = words.select(key, F.explode(F.array(*own)).alias("phrase"))
    known = phrases.select("phrase", "category").dropDuplicates(["phrase"])
    return grams.join(known.select("phrase"), "phrase", "left_semi").distinct().join(known, "phrase", "left").select(key, "phrase", "category")


def known_size(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    """Few rows of texts as a table whose size Spark knows when it plans; of createDataFrame's lists it doesn't."""
    return spark.createDataFrame(pa.table({c: pa.array([r[i] for r in rows], pa.string()) for i, c in enumerate(columns)}))


def role_windows(df: DataFrame, key: str, text: str, roles: DataFrame, words: int = 40) -> DataFrame:
    """key, place, n_roles: for each word with a role, the different roles within the next `words` words. roles: word, role."""
    w = df.select(key, F.posexplode(X.tokens(F.col(text))).alias("place", "word"))
    hit = w.join(F.broadcast(roles), "word")
    frame = W.partitionBy(key).orderBy("place").rangeBetween(0, words)
    return hit.select(key, "place", F.size(F.collect_set("role").over(frame)).alias("n_roles"))


def tier_score(phrase_confidence: Column, bloom_hits: Column, ngram_hits: Column) -> Column:
    """The strongest of the phrase's confidence and the steps by the numbers of weaker hits."""
    bloom = F.when(bloom_hits >= 2, 0.72).when(bloom_hits == 1, 0.50).otherwise(0.0)
    ngram = F.when(ngram_hits >= 3, 0.75).when(ngram_hits == 2, 0.62).when(ngram_hits == 1, 0.48).otherwise(0.0)
    return F.greatest(F.coalesce(phrase_confidence, F.lit(0.0)), bloom, ngram)


def folded(decisions: list[Column]) -> Column:
    """The outcome of checks in order of priority: the first denial ends it, an escalation stays, a failed check (null) denies."""
    out = F.lit("allow")
    for d in reversed(decisions):
        d = F.coalesce(d, F.lit("deny"))
        out = F.when(d == "deny", "deny").when((d == "escalate") & (out != "deny"), "escalate").otherwise(out)
    return out
