"""Quality of scores: AUC, best threshold, recall at a false-positive rate, sweeps.

All work over counts by score, so the number of different scores, not of rows, is what is sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def by_score(df: DataFrame, score: str, positive: str) -> DataFrame:
    """s, p, n: positives and negatives of each score; rows without a score or label are left out."""
    x = df.where(F.col(score).isNotNull() & F.col(positive).isNotNull())
    return x.groupBy(F.col(score).alias("s")).agg(F.sum(F.when(F.col(positive), 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(positive), 0).otherwise(1)).alias("n"))


def running(c: DataFrame, by: str, sums: dict[str, str], descending: bool = True, parts: int = 64) -> DataFrame:
    """c with, for each column of `sums`, its sum over the rows from the first up to this one in the order of `by`, under the name given. `by` has no equal values.

    Rows are cut into ranges of about equal length, of which only the sums are read to the driver; within a range the sum runs on. So no task sorts all rows.
    """
    spark = c.sparkSession
    cuts = c.agg(F.percentile_approx(by, [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    own = c.withColumn("_part", sum(((F.col(by) > x).cast("int") for x in sorted(set(cuts))), F.lit(0)))
    own = own.withColumn("_part", -F.col("_part")) if descending else own
    got = sorted((tuple(r) for r in own.groupBy("_part").agg(*[F.sum(x) for x in sums]).collect()), key=lambda r: r[0])
    before, at = [], [0] * len(sums)
    for part, *n in got:
        before.append((part, *at))
        at = [a + (b or 0) for a, b in zip(at, n, strict=True)]
    offsets = spark.createDataFrame(before, "_part int, " + ", ".join(f"_b{i} long" for i in range(len(sums))))
    w = W.partitionBy("_part").orderBy(F.desc(by) if descending else by).rowsBetween(W.unboundedPreceding, 0)
    x = own.join(F.broadcast(offsets), "_part")
    return x.select(*c.columns, *[(F.sum(n).over(w) + F.col(f"_b{i}")).alias(out) for i, (n, out) in enumerate(sums.items())])


def _above(c: DataFrame) -> DataFrame:
    """With tp, fp: those of this score or a higher one."""
    return running(c, "s", {"p": "tp", "n": "fp"})


def auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """n_pos, n_neg, auc: the share of pairs that the score puts in order, ties half; null without both kinds."""
    c = _above(by_score(df, score, positive))
    u = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2))
    return c.agg(F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"), u.alias("u")).select("n_pos", "n_neg", F.round(F.col("u") / F.nullif((F.col("n_pos") * F.col("n_neg")).cast("double"), F.lit(0.0)), 6).alias("auc"))


def best_f1(df: DataFrame, score: str, positive: str) -> DataFrame:
    """threshold, f1: of all scores as thresholds the one with the largest F1; of equals the highest."""
    c = _above(by_score(df, score, positive))
    t = c.agg(F.sum("p").alias("all_p"))
    f1 = F.round(2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("all_p")), 6)
    return c.join(F.broadcast(t)).select("s", f1.alias("f1")).agg(F.max(F.struct("f1", "s")).alias("m")).select(F.col("m.s").alias("threshold"), F.col("m.f1").alias("f1"))


def recall_at(df: DataFrame, score: str, positive: str, fpr: float) -> DataFrame:
    """threshold, recall: the threshold is the negatives' score at place int(fpr n) from above; positives above it count."""
    c = _above(by_score(df, score, positive))
    t = c.agg(F.sum("n").alias("all_n"), F.sum("p").alias("all_p"))
    x = c.join(F.broadcast(t))
    at = x.where(F.col("fp") > F.floor(fpr * F.col("all_n"))).agg(F.max("s").alias("threshold"))
    return x.join(F.broadcast(at)).agg(F.first("threshold").alias("threshold"), F.round(F.sum(F.when(F.col("s") > F.col("threshold"), F.col("p")).otherwise(0)) / F.first("all_p"), 6).alias("recall"))


def sweep(df: DataFrame, score: str, positive: str, thresholds: list[float]) -> DataFrame:
    """threshold, tp, fp, recall, false_block for each threshold."""
    t = df.sparkSession.createDataFrame([(float(x),) for x in thresholds], "threshold double")
    c = by_score(df, score, positive).join(F.broadcast(t))
    on = F.col("s") >= F.col("threshold")
    g = c.groupBy("threshold").agg(F.sum(F.when(on, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(on, F.col("n")).otherwise(0)).alias("fp"), F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    return g.select("threshold", "tp", "fp", F.round(F.col("tp") / F.col("all_p"), 6).alias("recall"), F.round(F.col("fp") / F.col("all_n"), 6).alias("false_block"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """n, rho: Pearson's correlation of average ranks, which are computed over counts by value."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())

    def ranks(c: str) -> DataFrame:
        n = running(d.groupBy(c).agg(F.count("*").alias("k")), c, {"k": "upto"}, False)
        return n.select(c, (F.col("upto") - (F.col("k") - 1) / 2).alias(f"rank_{c}"))

    r = d.join(ranks(x), x).join(ranks(y), y)
    return r.agg(F.count("*").alias("n"), F.round(F.corr(f"rank_{x}", f"rank_{y}"), 6).alias("rho"))
