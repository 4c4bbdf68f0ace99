"""Set-similarity self-join by prefix filtering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def similar_pairs(df: DataFrame, key: str, items: str, least: float) -> DataFrame:
    """a, b (a < b), jaccard of sets that are at least so similar. df: key, items (array of distinct strings; empty and null sets are in no pair).

    Equal sets are one, represented by the smallest key. Items are ordered from rare to frequent. Of two sets as similar as asked, the smaller (x, in ties the one
    of the smaller key) shares one of its first |x| - ceil(2 s |x| / (1 + s)) + 1 items with the first |y| - ceil(s |y|) + 1 of the larger; only these
    are joined. Places in the order bound the overlap too. What remains is compared exactly.
    """
    x = df.where(F.size(items) > 0).select(F.col(key).alias("k"), F.sort_array(items).alias("s"))
    x = x.groupBy(F.sha2(F.array_join("s", "\x1f"), 256).alias("h")).agg(F.min(F.struct("k", "s")).alias("m")).select("m.k", "m.s")
    token = x.select("k", F.size("s").alias("n"), F.explode("s").alias("t")).withColumn("t", F.xxhash64("t"))
    freq = token.groupBy("t").agg(F.count("*").alias("f")).where("f > 1")
    # an item that occurs once comes first and matches nothing, so only its place counts
    lists = token.join(freq, "t", "left").groupBy("k", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("f", F.lit(1)).alias("f"), "t"))).alias("o"))

    def first(share: float) -> Column:
        return F.col("n") - F.ceil(share * F.col("n") - 1e-9).cast("int") + 1

    place = lists.select("k", "n", first(2 * least / (1 + least)).alias("short"), F.posexplode(F.slice("o", F.lit(1), first(least))).alias("i", "p")).where("p.f > 1")
    a = place.where("i < short").select(F.col("k").alias("a"), F.col("n").alias("na"), F.col("i").alias("ia"), F.col("p.t").alias("t"))
    b = place.select(F.col("k").alias("b"), F.col("n").alias("nb"), F.col("i").alias("ib"), F.col("p.t").alias("t"))
    need = F.ceil(least / (1 + least) * (F.col("na") + F.col("nb")) - 1e-9)
    order = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    cand = a.join(b, "t").where(order & (F.col("na") >= least * F.col("nb")) & (F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= need)).select("a", "b").distinct()
    sa, sb = x.select(F.col("k").alias("a"), F.col("s").alias("sa")), x.select(F.col("k").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    j = both / (F.size("sa") + F.size("sb") - both)
    out = cand.join(sa, "a").join(sb, "b").where(j >= least)
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round(j, 6).alias("jaccard"))
