"""Shared pieces: table loading, key spelling, record identity, checkpoints."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that stand for "no value" (compared in lower case, outer blanks removed).
NO_VALUE = [
    "", "-", "--", "?", "??", ".", "n/a", "n.a.", "na", "nan", "nil", "none", "null", "unknown", "unk", "not known",
    "not available", "undefined", "missing", "tbd", "(none)", "(null)", "(unknown)", "und", "zxx", "mis", "mul", "xx", "other",
]
EMPTY_HASH = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # sha256 of no bytes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores: a scan with fewer partitions than cores is redistributed round robin; larger scans stay as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir. Where none is set, a local session (tests) gets a temporary one; on a cluster, whose machines don't
    share one, that is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        d = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(d)
    return d


def stored(df: DataFrame, name: str = "part") -> DataFrame:
    """The rows written once to the shared folder and read back: lineage ends here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    with tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._lodestone_path = path
    return out


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries within leave no shuffle files behind when they are done; they are for writes, whose result is read from files."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def discard(*parts: DataFrame | str) -> None:
    """Files of stored tables that nothing reads any more, or a folder of ours."""
    for x in parts:
        path = x if isinstance(x, str) else x._lodestone_path
        spark = SparkSession.getActiveSession()
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def smallest(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most `rows` rows of df, those whose key (unique) has the smallest hashes. Rows that can't be among them are dropped where they are, so that
    all tasks together send about as many rows as are asked for, not each as many."""
    x = df.withColumn("_h", F.xxhash64(key))
    n = df.count()
    if n > 2 * rows:
        x = x.where(F.col("_h") < int(-(2**63) + 2**64 * 1.5 * rows / n))
    return x.orderBy("_h", key).limit(rows).drop("_h")


def clean(c: Column) -> Column:
    """Case and outer white space removed, a trailing line break too."""
    return F.lower(F.btrim(c, F.lit(" \t\n\r\f\v\u00a0")))


def present(c: Column) -> Column:
    """A cleaned value, or null where it stands for "no value"."""
    k = clean(c)
    return F.when(k.isin(NO_VALUE), F.lit(None)).otherwise(k)


def hash_key(c: Column) -> Column:
    """A hash without the prefix that names it; null for the hash of nothing and for all zeros."""
    k = F.regexp_replace(present(c), r"^sha-?256\s*[:=]\s*", "")
    return F.when(k.isin(*NO_VALUE, EMPTY_HASH) | k.rlike("^0+$"), F.lit(None)).otherwise(k)


def model_key(c: Column) -> Column:
    """A model without the prefix that names its provider."""
    return F.regexp_replace(present(c), r"^[^/]*/\s*", "")


def split_key(c: Column) -> Column:
    k = present(c)
    return F.when(k.isin("train", "training"), "train").when(k.isin("val", "validation", "valid", "dev", "development"), "val").when(k.isin("test", "testing"), "test").otherwise(k)


def later_deliveries(df: DataFrame, key: Column, number: str) -> DataFrame:
    """The numbers of rows whose key (not null) occurs with a smaller number: one column, `number`. Only key and number are shuffled."""
    base = df.select(key.alias("_k"), F.col(number).alias(number)).where("_k is not null")
    first = base.groupBy("_k").agg(F.min(number).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    return base.join(first, "_k").where(F.col(number) > F.col("_first")).select(number)


def records(df: DataFrame, key: str = "id", number: str = "sample_no") -> DataFrame:
    """One row for each key: the one with the smallest number. Rows without a key are records of their own.

    The few later deliveries are written first, so that Spark knows their size: it broadcasts them to the wide rows while that is below
    its threshold, and shuffles both sides otherwise.
    """
    return df.join(stored(later_deliveries(df, present(F.col(key)), number), "later"), number, "left_anti")
