"""Behaviour over ordered calls: windows that need the order of a key's rows. A key's rows meet in one task (they are one user's or one tool's calls);
counts over time ranges are first summed by time bucket where the range permits it."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestone.operators.fold import folded


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def range_count(df: DataFrame, key: str, ts: str, seconds: int, out: str = "n_recent") -> DataFrame:
    """Rows of the key in the `seconds` up to and including this row's time."""
    return df.withColumn(out, F.count("*").over(W.partitionBy(key).orderBy(micros(ts)).rangeBetween(-seconds * 1_000_000, 0)))


def spikes(df: DataFrame, key: str, ts: str, order: str, seconds: int, threshold: int) -> DataFrame:
    """Rows at which the count within `seconds` reaches a new high of an episode; an episode ends when it falls below the threshold."""
    x = range_count(df, key, ts, seconds)
    w = W.partitionBy(key).orderBy(ts, order)
    x = x.withColumn("_e", F.sum(F.when(F.col("n_recent") < threshold, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    high = F.max("n_recent").over(W.partitionBy(key, "_e").orderBy(ts, order).rowsBetween(W.unboundedPreceding, -1))
    return x.withColumn("_h", F.coalesce(high, F.lit(0))).where((F.col("n_recent") >= threshold) & (F.col("n_recent") > F.col("_h"))).drop("_e", "_h")


def sequences(df: DataFrame, key: str, ts: str, order: str, kind: str, triples: list[tuple[str, str, str]]) -> DataFrame:
    """Rows that end one of the triples of three rows of the key in a row."""
    w = W.partitionBy(key).orderBy(ts, order)
    x = df.withColumn("first", F.lag(kind, 2).over(w)).withColumn("second", F.lag(kind, 1).over(w))
    hit = F.lit(False)
    for a, b, c in triples:
        hit = hit | ((F.col("first") == a) & (F.col("second") == b) & (F.col(kind) == c))
    return x.where(hit)


def runs(df: DataFrame, key: str, ts: str, order: str, inside: Column, least: int) -> DataFrame:
    """key, start, end, n of runs of at least `least` consecutive rows for which `inside` holds."""
    w = W.partitionBy(key).orderBy(ts, order)
    x = df.withColumn("_in", inside).withColumn("_g", F.sum(F.when(F.col("_in"), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    g = x.where("_in").groupBy(key, "_g").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n"))
    return g.where(F.col("n") >= least).drop("_g")


def expanding_z(df: DataFrame, key: str, ts: str, order: str, value: str, samples: int = 5) -> DataFrame:
    """The row's z-score against the key's earlier rows; null with fewer than `samples` of them or next to no spread."""
    w = W.partitionBy(key).orderBy(ts, order).rowsBetween(W.unboundedPreceding, -1)
    mean, sd, n = F.avg(value).over(w), F.stddev_samp(value).over(w), F.count(value).over(w)
    return df.withColumn("n_prior", n).withColumn("z", F.when((n >= samples) & (sd >= 1.0), (F.col(value) - mean) / sd))


def repeats(df: DataFrame, key: str, ts: str, order: str, what: str, window: int, threshold: int) -> DataFrame:
    """Rows at which, of the key's last `window` rows, at least `threshold` have the same `what` as this one."""
    w = W.partitionBy(key).orderBy(ts, order)
    x = df.withColumn("_r", F.row_number().over(w))
    same = F.count("*").over(W.partitionBy(key, what).orderBy("_r").rangeBetween(-(window - 1), 0))
    return x.withColumn("n_same", same).where(F.col("n_same") >= threshold).drop("_r")


def sessions(df: DataFrame, key: str, ts: str, order: str, gap: int) -> DataFrame:
    """key, session_no, n, start, end: rows less than `gap` seconds apart are one session."""
    w = W.partitionBy(key).orderBy(ts, order)
    x = df.withColumn("_m", micros(ts)).withColumn("_n", F.when(F.col("_m") - F.lag("_m").over(w) >= gap * 1_000_000, 1).otherwise(0))
    x = x.withColumn("session_no", F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return x.groupBy(key, "session_no").agg(F.count("*").alias("n"), F.min(ts).alias("start"), F.max(ts).alias("end"))


def decayed(df: DataFrame, key: str, ts: str, order: str, risk: Column, decay: float = 0.85, streak: int = 4, bonus: float = 0.15) -> DataFrame:
    """Cumulative risk: decay times the last plus the row's own (null: none), plus a bonus from the fourth positive row in a row on."""
    kind = df.schema[order].dataType.simpleString()

    def step(state: tuple[float, int], i, r: float | None) -> tuple:
        c, s = state
        r = r or 0.0
        s = s + 1 if r > 0 else 0
        c = c * decay + r + (bonus if s >= streak else 0.0)
        return (c, s), (i, c)

    return folded(df.withColumn("_risk", risk.cast("double")), key, [ts, order], [order, "_risk"], lambda: (0.0, 0), step, f"`{order}` {kind}, cumulative double")


def set_drift(df: DataFrame, key: str, kind: str, early: Column) -> DataFrame:
    """key, drift: half the Jaccard distance of the kinds before and after, half the relative change in number (1 at most)."""
    g = df.groupBy(key).agg(
        F.collect_set(F.when(early, F.col(kind))).alias("a"), F.collect_set(F.when(~early, F.col(kind))).alias("b"),
        F.sum(F.when(early, 1).otherwise(0)).alias("na"), F.sum(F.when(early, 0).otherwise(1)).alias("nb"))
    j = F.coalesce(F.size(F.array_intersect("a", "b")) / F.nullif(F.size(F.array_union("a", "b")), F.lit(0)), F.lit(1.0))
    v = F.coalesce(F.least(F.lit(1.0), F.abs(F.col("nb") - F.col("na")) / F.nullif(F.col("na"), F.lit(0))), F.lit(1.0))
    return g.select(key, "na", "nb", F.round(0.5 * (1 - j) + 0.5 * v, 6).alias("drift"), ((F.col("na") >= 2) & (F.col("nb") == 0)).alias("collapsed"))


def rate_limited(df: DataFrame, key: str, ts: str, order: str, limit: int, seconds: int, factor: float = 2.0) -> DataFrame:
    """key, order, allowed, n_window: a sliding limit that halves with each refusal (five times at most) and recovers in quiet times. What is allowed depends on what was allowed
    before; the times allowed within the window are kept, at most `limit` of a key."""
    kind = df.schema[order].dataType.simpleString()

    def step(state: tuple[deque, int], i, t: int) -> tuple:
        window, bad = state
        while window and window[0] < t - seconds * 1_000_000:
            window.popleft()
        most = max(1, int(limit / factor ** min(bad, 5)))
        ok = len(window) < most
        if not ok:
            bad += 1
        else:
            window.append(t)
            if bad and len(window) < most // 2:
                bad -= 1
        return (window, bad), (i, ok, len(window))

    return folded(df.withColumn("_t", micros(ts)), key, [ts, order], [order, "_t"], lambda: (deque(), 0), step, f"`{order}` {kind}, allowed boolean, n_window long")
