"""Problem 7: new batches against all history, by an index of segments and MinHash bands.

A near copy shares four fifths of all words, however they are placed. A text is stored as its MinHash bands over words counted with repeats, as in problem 2,
of which one shared band makes a candidate whatever the words' order, and as its segments of seven words (shorter ones in short texts) with their positions, which
prove what the bands can't where words are replaced in place, at most one in nine: all the batch text's substrings of seven words are looked up. Segment hits
must agree in length and place as far as the number of edits allows, and a pair needs two of them (one where the text is short). All candidates pass a bound on unshared words,
first by a sketch of 64 bits that every entry has, then by one that is as long as the text needs, of which there is one a text; what remains is verified exactly. Keys (id, family) and whole multisets of words are further entries of the same index. Appending a batch writes its entries
as another table; what is in the index is never worked out again, and joins read it in the buckets in which it was written.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import checkpoint_dir, discard, later_deliveries, stored, tidy
from lodestone.llm.wordsets import BANDS, PER_SEGMENT, SEGMENT, may_be_near, may_be_near_widely, near_verified, with_both, with_segments, with_windows


class SegmentIndex:
    """Entries (k, no, n, at, bits) in tables bucketed by k. n is 0 for entries that match by k alone; of those the smallest no is kept. at is -1 for bands.
    Beside each table there is one of the texts' wide sketches (no, n, wide).

    An index of a name that the catalog has is opened: what was appended to it, in whatever session, is found.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, name: str | None = None):
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.prefix = f"lodestone_index_{name or uuid.uuid4().hex}_"
        self.tables = sorted(t.name for t in spark.catalog.listTables(pattern=self.prefix + "*")) if name else []

    @staticmethod
    def _sketches(table: str) -> str:
        return table.replace("lodestone_index_", "lodestone_sketches_", 1)

    def _path(self, table: str) -> str:
        return f"{checkpoint_dir(self.spark)}/lodestone/{table}"

    def _keys(self, df: DataFrame, keys: list[Column]) -> DataFrame:
        kinds = F.array(*[F.when(c.isNotNull(), F.xxhash64(F.lit(f"key {i}"), c)) for i, c in enumerate(keys)])
        return df.select(F.explode(kinds).alias("k"), "no").where("k is not null")

    def append(self, df: DataFrame, keys: list[Column], text: str = "text", sketch: DataFrame | None = None) -> None:
        """df has `no`, the text and the columns of which keys are made. Null keys and texts without words make no entry. sketch: with_both of the texts, if there is one."""
        seg = sketch.drop("segment", "at").withColumnRenamed("own", "segment") if sketch is not None else stored(with_segments(df.select("no", F.col(text).alias("text"))), "segments")
        alone = self._keys(df, keys).unionByName(seg.select(F.xxhash64(F.lit("words"), "multiset", "n").alias("k"), "no"))
        alone = alone.groupBy("k").agg(F.min("no").alias("no")).selectExpr("k", "no", "0 as n", "0 as at", "0L as bits")
        # of texts with the same words in the same order the first stands for all; only the later ones' numbers travel
        words = F.concat_ws(" ", "multiset", "n", F.xxhash64("segment"))
        later = stored(later_deliveries(seg, words, "no"), "later")
        one = seg.join(later, "no", "left_anti")
        # the segments, at equal distances, are followed by the bands
        at = F.expr(f"if(pos < size(segment) - {BANDS}, cast(pos * cast(n as bigint) div (size(segment) - {BANDS}) as int), -1)")
        parts = one.select("segment", "no", "n", "bits", F.posexplode("segment").alias("pos", "k")).select("k", "no", "n", at.alias("at"), "bits")
        name = f"{self.prefix}{len(self.tables):06d}"
        with tidy(self.spark):
            alone.unionByName(parts).repartition(self.buckets, "k").write.bucketBy(self.buckets, "k").option("compression", "zstd").option("path", self._path(name)).saveAsTable(name)
            own = self._sketches(name)
            seg.select("no", "n", "wide").write.option("compression", "zstd").option("path", self._path(own)).saveAsTable(own)
        self.tables.append(name)
        discard(later)
        if sketch is None:
            discard(seg)

    def probe(self, df: DataFrame, keys: list[Column], text: str = "text", sketch: DataFrame | None = None) -> DataFrame:
        """probe_no, no, sure: entries with a smaller no that match (sure) or may match one of df's rows."""
        win = sketch if sketch is not None else stored(with_windows(df.select("no", F.col(text).alias("text"))), "windows")
        alone = self._keys(df, keys).unionByName(win.select(F.xxhash64(F.lit("words"), "multiset", "n").alias("k"), "no"))
        alone = alone.selectExpr("k", "no as p_no", "0 as p_n", "0 as p_at", "0L as p_bits")
        sub = win.select(F.explode(F.arrays_zip("segment", "at")).alias("s"), "no", "n", "bits").select(F.col("s.segment").alias("k"), F.col("no").alias("p_no"), F.col("n").alias("p_n"), F.col("s.at").alias("p_at"), F.col("bits").alias("p_bits"))
        probes = alone.unionByName(sub).hint("shuffle_hash")
        # bands have no place: their -1 leaves the bound on the lengths. Of segments, the shift before the segment and that after it can't exceed the number of words by which near copies differ
        slack = f"(n + p_n) div {PER_SEGMENT}"
        near = F.expr(f"n > 0 and p_n > 0 and abs(at - p_at) <= {slack} and abs((n - at) - (p_n - p_at)) <= {slack}") & may_be_near("n", "p_n", "bits", "p_bits")
        # the first table, the history, is read in its buckets; the few later ones, of a batch each, together
        first, *later = map(self.spark.table, self.tables)
        parts = [first, functools.reduce(DataFrame.unionByName, later)] if later else [first]
        hits = [x.join(probes, "k").where("no < p_no").where(near | F.expr("n = 0 and p_n = 0")) for x in parts]
        hit = functools.reduce(DataFrame.unionByName, hits)
        # two segments are hit if the first and the last hit differ
        g = hit.groupBy("p_no", "no").agg(F.max(F.col("n") == 0).alias("sure"), F.max("n").alias("n"), F.min("at").alias("at"), F.max("at").alias("last"))
        one = F.expr(f"n < 28 or n div {SEGMENT} - n div {PER_SEGMENT} < 2")
        out = stored(g.where(F.col("sure") | (F.col("at") < 0) | one | (F.col("at") < F.col("last"))).select(F.col("p_no").alias("probe_no"), "no", "sure"), "matches")
        discard(win)
        return out

    def narrowed(self, pairs: DataFrame) -> DataFrame:
        """The rows of pairs (probe_no, no), both of texts that were appended, without those that their wide sketches show not to be near copies. A text without a sketch stays."""
        own = [self.spark.table(t) for t in map(self._sketches, self.tables) if self.spark.catalog.tableExists(t)]
        if not own:
            return pairs
        wide = functools.reduce(DataFrame.unionByName, own)
        a, b = wide.selectExpr("no as probe_no", "n as _n", "wide as _a"), wide.selectExpr("no", "n as _m", "wide as _b")
        return pairs.join(a, "probe_no", "left").join(b, "no", "left").where(may_be_near_widely("_n", "_m", "_a", "_b")).select(*pairs.columns)

    def drop(self) -> None:
        for name in [x for t in self.tables for x in (t, self._sketches(t))]:
            self.spark.sql(f"drop table if exists {name}")
            discard(self._path(name))
        self.tables = []


def repeats(history: DataFrame, incoming: DataFrame, batch: str, keys: list[Column], text: str = "text", together: int = 4) -> DataFrame:
    """match_no, no: each incoming row that repeats a row of the history or an incoming row with a smaller no, with the smallest no that it repeats.

    history, incoming: no, the text, the keys' columns; incoming also has `batch`. Batches are taken in order: each is appended to the index and looked up
    in it; of a backlog up to `together` batches are appended and looked up in one pass over the index, which gives the same, as rows match smaller numbers only. Candidates of all batches are verified together, reading the texts of the candidates only.
    """
    spark = history.sparkSession
    index = SegmentIndex(spark)
    index.append(history, keys, text)
    found = []
    waiting = [r[0] for r in incoming.select(batch).distinct().orderBy(batch).collect()]
    for i in range(0, len(waiting), together):
        part = incoming.where(functools.reduce(Column.__or__, [F.col(batch).eqNullSafe(F.lit(b)) for b in waiting[i : i + together]]))
        both = stored(with_both(part.select("no", F.col(text).alias("text"))), "sketches")
        index.append(part, keys, text, both)
        found.append(index.probe(part, keys, text, both))
    if not found:
        index.drop()
        return history.select(F.col("no").alias("match_no"), "no").limit(0)
    all_ = functools.reduce(DataFrame.unionByName, found)
    texts = history.select(F.col("no").alias("key"), F.col(text).alias("text")).unionByName(incoming.select(F.col("no").alias("key"), F.col(text).alias("text")))
    sure = all_.where("sure").groupBy("probe_no").agg(F.min("no").alias("no"))
    # only candidates with a smaller number than what is sure can change the result
    open_ = all_.where("not sure").join(sure.select("probe_no", F.col("no").alias("least")), "probe_no", "left").where("least is null or no < least").select("probe_no", "no")
    open_ = stored(index.narrowed(open_), "open")
    index.drop()
    near = near_verified(open_, texts, "probe_no", "no")
    return sure.unionByName(near.select("probe_no", "no")).groupBy("probe_no").agg(F.min("no").alias("match_no")).select("match_no", F.col("probe_no").alias("no"))
