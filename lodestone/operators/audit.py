"""Audit logs: latest entries, hash chains."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestone.operators.fold import folded


def latest(df: DataFrame, conditions: list[Column], order: list[str], n: int) -> DataFrame:
    """The last n rows that meet all conditions (any Column, so a custom predicate too)."""
    x = reduce(DataFrame.where, conditions, df)
    return x.orderBy(*[F.desc(c) for c in order]).limit(n)


def chained(df: DataFrame, key: str, order: list[str], ident: str, body: str) -> DataFrame:
    """key, ident, prev_hash, entry_hash: each entry's SHA-256 covers the one before. A chain for each key, built in order; chains are built side by side. A null body counts as empty."""
    kind = df.schema[ident].dataType.simpleString()

    def step(before: str, i, text: str | None) -> tuple:
        h = hashlib.sha256(f"{before}|{text or ''}".encode()).hexdigest()
        return h, (i, before, h)

    return folded(df, key, [*order, ident], [ident, body], str, step, f"`{ident}` {kind}, prev_hash string, entry_hash string")


def verified(df: DataFrame, key: str, order: list[str], body: str) -> DataFrame:
    """df with `valid`: the entry's hash is that of its content, and it names the hash of the entry before. No fold is needed to check a chain."""
    before = F.coalesce(F.lag("entry_hash").over(W.partitionBy(key).orderBy(*order)), F.lit(""))
    return df.withColumn("valid", (F.col("prev_hash") == before) & (F.col("entry_hash") == F.sha2(F.concat("prev_hash", F.lit("|"), F.coalesce(F.col(body), F.lit(""))), 256)))
