"""Problem 2: the same or near-same records across splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import split_key, stored
from lodestone.llm.wordsets import may_be_near, near_verified, with_bands


def cross_split_overlaps(df: DataFrame, key: str = "sample_no", text: str = "text", split: str = "split", against: str = "train", others: tuple = ("val", "test")) -> DataFrame:
    """Pairs of records of which one is in `against` and one in one of `others`, with (nearly) the same text.

    df: one row for each record. Result: a, b (the keys, smaller first), train_no, other_no, other_split.

    Word keys are hashed to MinHash bands; texts with the same words are one class, represented by its smallest key, and only classes meet
    in a band: those with a record in `against` on one side, those with a record in another split on the other. Candidates must
    also pass a bound on length and unshared words that no near copy fails; the rest is compared exactly. Pairs of classes are then
    spread over their records. Null keys of split, other splits and texts without words give no pair.
    """
    rows = df.select(F.col(key).alias("key"), split_key(F.col(split)).alias("side"), F.col(text).alias("text")).where(F.col("side").isin(against, *others))
    sk = stored(with_bands(rows), "bands")
    member = sk.select("key", "side", "multiset", "n")
    on = ["multiset", "n"]
    # a class: its smallest key, and on which sides it has records; bands and bits are the same for all its records
    cls = sk.groupBy(*on).agg(
        F.min("key").alias("rep"), F.max((F.col("side") == against)).alias("in_a"), F.max((F.col("side") != against)).alias("in_o"),
        F.first("bits").alias("bits"), F.first("more").alias("more"), F.first("bands").alias("bands"))
    cls = stored(cls, "classes")
    band = cls.select("rep", "n", "bits", "in_a", "in_o", F.posexplode("bands").alias("i", "band"))
    band = band.withColumn("band", F.expr("(cast(i as bigint) << 32) | (cast(band as bigint) & 4294967295)")).drop("i")
    x = band.where("in_a").select("band", F.col("rep").alias("ra"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    y = band.where("in_o").select("band", F.col("rep").alias("ro"), F.col("n").alias("no"), F.col("bits").alias("bo"))
    cand = x.join(y, "band").where((F.col("ra") != F.col("ro")) & may_be_near("na", "no", "ba", "bo")).select("ra", "ro").distinct()
    # a second sketch, which needn't travel with every band, leaves few pairs to be compared
    a, o = (cls.select(F.col("rep").alias(r), F.col("n").alias(n), F.col("more").alias(m)) for r, n, m in (("ra", "na", "ma"), ("ro", "no", "mo")))
    cand = cand.join(a, "ra").join(o, "ro").where(may_be_near("na", "no", "ma", "mo")).select("ra", "ro")
    near = near_verified(stored(cand, "candidates"), df.select(F.col(key).alias("key"), F.col(text).alias("text")), "ra", "ro")
    same = cls.where("in_a and in_o").select(F.col("rep").alias("ra"), F.col("rep").alias("ro"))
    pairs = near.unionByName(same)
    of = member.join(cls.select(*on, "rep"), on).select("rep", "key", "side")
    a = of.where(F.col("side") == against).select(F.col("rep").alias("ra"), F.col("key").alias("train_no"))
    o = of.where(F.col("side") != against).select(F.col("rep").alias("ro"), F.col("key").alias("other_no"), F.col("side").alias("other_split"))
    return pairs.join(a, "ra").join(o, "ro").select(
        F.least("train_no", "other_no").alias("a"), F.greatest("train_no", "other_no").alias("b"), "train_no", "other_no", "other_split")


def overlap_report(pairs: DataFrame, df: DataFrame, key: str = "sample_no", source: str = "source") -> DataFrame:
    """For each split and source (of the record outside train): pairs, and records with a partner in train."""
    src = df.select(F.col(key).alias("other_no"), F.col(source).alias("source"))
    per = pairs.groupBy("other_no", "other_split").agg(F.count("*").alias("k"))
    return per.join(src, "other_no").groupBy(F.col("other_split").alias("split"), "source").agg(
        F.sum("k").cast("bigint").alias("n_pairs"), F.count("*").alias("n_records"))
