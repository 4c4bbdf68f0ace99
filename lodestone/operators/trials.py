"""Trial analytics: validity, rates with intervals, pairing, confirmation, coverage, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lodestone.functions import stats


def model_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.btrim(c, F.lit(" \t\n"))), r"^[^/]*/", "")


def outcome_name(c: Column) -> Column:
    return F.lower(F.btrim(c, F.lit(" \t\n")))


def valid_reason(error: Column, outcome: Column, response: Column) -> Column:
    """Why a row doesn't count, the first reason that holds; null if it counts."""
    return (F.when(outcome.isNull(), "no_outcome").when(outcome == "error", "failed_run").when(error.rlike("(?i)timeout|HTTP 5|connection reset"), "infrastructure")
            .when(response.isNull() | (F.trim(response) == ""), "empty_response"))


def rates(df: DataFrame, keys: list[str], hit: Column, least: int = 1) -> DataFrame:
    """keys, n, k, rate with Wilson's interval of groups of at least `least` rows. keys may be any columns; hit is any condition."""
    x = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.when(hit, 1).otherwise(0)).alias("k")).where(F.col("n") >= least)
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return x.select(*keys, "n", "k", F.round(stats.rate(F.col("k"), F.col("n")), 6).alias("rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def collapsed_rates(df: DataFrame, keys: list[str], unit: str, hit: Column) -> DataFrame:
    """The mean over units of the units' own rates, so that repeats of a unit don't weigh."""
    u = df.groupBy(*keys, unit).agg(F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("r"))
    return u.groupBy(*keys).agg(F.count("*").alias("n_units"), F.round(F.avg("r"), 6).alias("rate"))


def first_only(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with `duplicate`: whether an earlier row, or an equal one, has the same keys (nulls are a key). One row of each key isn't a duplicate.

    The first of each key is found by aggregation, so a hot key isn't sorted in one task; equal rows are counted, not told apart.
    """
    cols = df.columns
    x = df.groupBy(*cols).agg(F.count("*").alias("_n"))
    first = x.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    own = F.struct(*[F.col(f"l.{o}").alias(o) for o in order])
    flags = F.when(own == F.col("r._first"), F.concat(F.array(F.lit(False)), F.array_repeat(F.lit(True), (F.col("l._n") - 1).cast("int")))).otherwise(F.array_repeat(F.lit(True), F.col("l._n").cast("int")))
    return x.alias("l").join(first.alias("r"), on, "left").select(*[F.col(f"l.{c}") for c in cols], F.explode(flags).alias("duplicate"))


def confirmation(df: DataFrame, unit: str, model: str, provider: str, hit: Column) -> DataFrame:
    """unit, models tested and hit, providers hit, status: confirmed (hit with two models of two providers), rejected (no hit of at least three models), provisional."""
    g = df.groupBy(unit).agg(F.countDistinct(model).alias("n_models"), F.countDistinct(F.when(hit, F.col(model))).alias("n_hit"), F.countDistinct(F.when(hit, F.col(provider))).alias("n_providers"))
    status = F.when((F.col("n_hit") >= 2) & (F.col("n_providers") >= 2), "confirmed").when((F.col("n_hit") == 0) & (F.col("n_models") >= 3), "rejected").otherwise("provisional")
    return g.withColumn("status", status)


def paired(df: DataFrame, unit: list[str], side: str, a: str, b: str, hit: Column) -> DataFrame:
    """One row: units under both sides, the four cells, rates, chi-square and effect size. A unit hits if any of its rows does."""
    u = df.where(F.col(side).isin(a, b)).groupBy(*unit).agg(
        F.max(F.when((F.col(side) == a), F.when(hit, 1).otherwise(0))).alias("a"), F.max(F.when((F.col(side) == b), F.when(hit, 1).otherwise(0))).alias("b")).where("a is not null and b is not null")
    c = u.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(F.when((F.col("a") == x) & (F.col("b") == y), 1).otherwise(0)), F.lit(0)).alias(f"n{x}{y}") for x in (1, 0) for y in (1, 0)])
    ra, rb = stats.rate(F.col("n11") + F.col("n10"), F.col("n")), stats.rate(F.col("n11") + F.col("n01"), F.col("n"))
    return c.select("n", "n11", "n10", "n01", "n00", F.round(ra, 6).alias("rate_a"), F.round(rb, 6).alias("rate_b"),
                    F.round(stats.mcnemar_chi2(F.col("n10"), F.col("n01")), 6).alias("chi2"), F.round(stats.cohens_h(ra, rb), 6).alias("h"))


def balanced_take(df: DataFrame, strata: list[str], order: Column, n: int) -> DataFrame:
    """n rows, in turns from each stratum, within it in the given order. At most n rows of a stratum are ever ranked together: each task keeps its own first."""
    top = df.withColumn("_r", F.row_number().over(W.partitionBy(*strata, F.pmod(F.xxhash64(order), F.lit(32))).orderBy(order))).where(F.col("_r") <= n).drop("_r")
    x = top.withColumn("turn", F.row_number().over(W.partitionBy(*strata).orderBy(order)))
    return x.where(F.col("turn") <= n).orderBy("turn", *strata).limit(n)


def cluster_bootstrap(df: DataFrame, group: str, cluster: str, hit: Column, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """group, mean, low, high: percentile interval of the rate over resampled clusters. Clusters are counted by (rows, hits) first; only those counts are resampled."""
    import numpy as np
    import pandas as pd

    c = df.groupBy(group, cluster).agg(F.count("*").alias("n"), F.sum(F.when(hit, 1).otherwise(0)).alias("k")).groupBy(group, "n", "k").agg(F.count("*").alias("m"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(["n", "k"])
        m = stats.bootstrap_means(p["m"].to_numpy(float), p["k"].to_numpy(float), p["n"].to_numpy(float), rounds, seed)
        mean = (p["m"] * p["k"]).sum() / (p["m"] * p["n"]).sum()
        return pd.DataFrame({group: [p[group].iloc[0]], "mean": [mean], "low": [np.quantile(m, 0.025)], "high": [np.quantile(m, 0.975)]})

    return c.groupBy(group).applyInPandas(one, T.StructType([df.schema[group], *[T.StructField(x, T.DoubleType()) for x in ("mean", "low", "high")]]))


def paired_bootstrap(df: DataFrame, unit: list[str], side: str, a: str, b: str, hit: Column, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """n, difference, low, high: percentile interval of the difference of rates between two sides over resampled units, which are only counted by their own difference. One row; null without units."""
    import numpy as np

    u = df.where(F.col(side).isin(a, b)).groupBy(*unit).agg(*[F.max(F.when(F.col(side) == s, F.when(hit, 1).otherwise(0))).alias(c) for s, c in ((a, "a"), (b, "b"))]).where("a is not null and b is not null")
    k = {r["d"]: r["n"] for r in u.groupBy((F.col("a") - F.col("b")).alias("d")).agg(F.count("*").alias("n")).collect()}
    counts, own = np.array(list(k.values()), float), np.array(list(k), float)
    row = (int(counts.sum()), None, None, None)
    if k:
        m = stats.bootstrap_means(counts, own, np.ones(len(own)), rounds, seed)
        row = (row[0], float(counts @ own / counts.sum()), float(np.quantile(m, 0.025)), float(np.quantile(m, 0.975)))
    return df.sparkSession.createDataFrame([row], "n long, difference double, low double, high double")
