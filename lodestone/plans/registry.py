"""Named queries, each with its SQL where SQL can say the same."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for work that costs much a row: where its files make fewer tasks than there are cores, rows are dealt out anew; larger tables stay as they are."""
    x = table(spark, sf_dir, name)
    n = spark.sparkContext.defaultParallelism
    return x if x.rdd.getNumPartitions() >= n else x.repartition(n)


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir; where none is set, a local session gets a temporary one; on a cluster that is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
    return f"{d}/lodestone" if d else tempfile.mkdtemp(prefix="lodestone-")
