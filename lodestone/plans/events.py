"""Behaviour of users and tools over the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestone.operators import audit, sequence
from lodestone.plans.registry import query, table

E = "events"


@query("""with c as (select event_id, user_id, ts, count(*) over (partition by user_id order by ts range between interval 6 hours preceding and current row) as n_recent from events),
    e as (select *, sum(case when n_recent < 4 then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as ep from c),
    h as (select *, coalesce(max(n_recent) over (partition by user_id, ep order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as high from e)
    select event_id, user_id, n_recent from h where n_recent >= 4 and n_recent > high""")
def event_spike(spark: SparkSession, d: str) -> DataFrame:
    return sequence.spikes(table(spark, d, E), "user_id", "ts", "event_id", 6 * 3600, 4).select("event_id", "user_id", "n_recent")


@query("""with l as (select event_id, user_id, event_type, lag(event_type, 2) over w as first, lag(event_type, 1) over w as second from events window w as (partition by user_id order by ts, event_id))
    select event_id, user_id, first, second, event_type from l where (first = 'view' and second = 'click' and event_type = 'error') or (first = 'signup' and second = 'error' and event_type = 'purchase')""")
def event_sequence(spark: SparkSession, d: str) -> DataFrame:
    x = sequence.sequences(table(spark, d, E), "user_id", "ts", "event_id", "event_type", [("view", "click", "error"), ("signup", "error", "purchase")])
    return x.select("event_id", "user_id", "first", "second", "event_type")


@query("""with g as (select *, sum(case when event_type = 'error' then 0 else 1 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as g from events)
    select user_id, min(event_id) as "start", max(event_id) as "end", count(*) as n from g where event_type = 'error' group by user_id, g having count(*) >= 3""")
def event_failure_runs(spark: SparkSession, d: str) -> DataFrame:
    return sequence.runs(table(spark, d, E), "user_id", "ts", "event_id", F.col("event_type") == "error", 3)


@query("""with s as (select event_id, user_id, value, count(value) over w as n, avg(value) over w as m, stddev_samp(value) over w as sd from events window w as (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding))
    select event_id, user_id, n as n_prior, round((value - m) / sd, 6) as z from s where n >= 5 and sd >= 1 and abs((value - m) / sd) >= 3""")
def event_value_anomaly(spark: SparkSession, d: str) -> DataFrame:
    x = sequence.expanding_z(table(spark, d, E), "user_id", "ts", "event_id", "value").where("abs(z) >= 3")
    return x.select("event_id", "user_id", "n_prior", F.round("z", 6).alias("z"))


@query("""with l as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) >= 43200000000 then 1 else 0 end as b from events),
    s as (select *, sum(b) over (partition by user_id order by ts, event_id rows unbounded preceding) as session_no from l)
    select user_id, session_no::bigint as session_no, count(*) as n, min(ts) as "start", max(ts) as "end" from s group by user_id, session_no""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sequence.sessions(table(spark, d, E), "user_id", "ts", "event_id", 12 * 3600)


@query("""with r as (select *, row_number() over (partition by user_id order by ts, event_id) as r from events),
    s as (select event_id, user_id, event_type, count(*) over (partition by user_id, event_type order by r range between 19 preceding and current row) as n_same from r)
    select * from s where n_same >= 8""")
def event_doom_loop(spark: SparkSession, d: str) -> DataFrame:
    return sequence.repeats(table(spark, d, E), "user_id", "ts", "event_id", "event_type", 20, 8).select("event_id", "user_id", "event_type", "n_same")


@query()
def event_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    return sequence.rate_limited(table(spark, d, E), "user_id", "ts", "event_id", 4, 24 * 3600)


@query("""with recursive o as (select event_id, user_id, case event_type when 'error' then 0.5 when 'signup' then 0.2 else 0.0 end::double as r, row_number() over (partition by user_id order by ts, event_id) as k from events),
    f as (select user_id, event_id, k, r as c, case when r > 0 then 1 else 0 end as s from o where k = 1 union all
          select o.user_id, o.event_id, o.k, f.c * 0.85 + o.r + case when o.r > 0 and f.s + 1 >= 4 then 0.15 else 0 end, case when o.r > 0 then f.s + 1 else 0 end from f join o on o.user_id = f.user_id and o.k = f.k + 1)
    select user_id, event_id, round(c, 6) as cumulative from f""")
def event_decayed_risk(spark: SparkSession, d: str) -> DataFrame:
    risk = F.when(F.col("event_type") == "error", 0.5).when(F.col("event_type") == "signup", 0.2).otherwise(0.0)
    return sequence.decayed(table(spark, d, E), "user_id", "ts", "event_id", risk).withColumn("cumulative", F.round("cumulative", 6))


@query("""with s as (select user_id, event_type, ts < timestamp '2024-01-16' as early from events), g as (select user_id, array_agg(distinct event_type) filter (early) as a, array_agg(distinct event_type) filter (not early) as b,
    count(*) filter (early) as na, count(*) filter (not early) as nb from s group by user_id)
    select user_id, na, nb, round(0.5 * (1 - coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 1.0)) + 0.5 * coalesce(least(1.0, abs(nb - na) / nullif(na, 0)), 1.0), 6)::double as drift,
    (na >= 2 and nb = 0) as collapsed from g""")
def event_drift(spark: SparkSession, d: str) -> DataFrame:
    return sequence.set_drift(table(spark, d, E), "user_id", "event_type", F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"))


@query("select event_id, user_id, event_type, value from events where event_type = 'error' and value >= 10 and ts >= timestamp '2024-01-10' order by ts desc, event_id desc limit 100")
def audit_filter_latest(spark: SparkSession, d: str) -> DataFrame:
    x = audit.latest(table(spark, d, E), [F.col("event_type") == "error", F.col("value") >= 10, F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")], ["ts", "event_id"], 100)
    return x.select("event_id", "user_id", "event_type", "value")


@query("""select event_type, coalesce(nullif(case when value < 5 then '' when value < 20 then 'allow' else 'deny' end, ''), 'none') as decision, count(*) as n, grouping(event_type)::bigint as total
    from events group by grouping sets ((event_type, coalesce(nullif(case when value < 5 then '' when value < 20 then 'allow' else 'deny' end, ''), 'none')), (coalesce(nullif(case when value < 5 then '' when value < 20 then 'allow' else 'deny' end, ''), 'none')))""")
def audit_stats(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, E).withColumn("decision", F.when(F.col("value") < 5, "").when(F.col("value") < 20, "allow").otherwise("deny"))
    x = x.withColumn("decision", F.coalesce(F.nullif("decision", F.lit("")), F.lit("none")))
    return x.groupingSets([[F.col("event_type"), F.col("decision")], [F.col("decision")]], F.col("event_type"), F.col("decision")).agg(
        F.count("*").alias("n"), F.grouping("event_type").cast("bigint").alias("total"))


_ROW = "concat_ws('|', event_id, user_id, event_type, props)"


@query(f"""with recursive o as (select event_id, user_id, {_ROW} as body, row_number() over (partition by user_id order by ts, event_id) as k from events),
    f as (select user_id, event_id, k, '' as prev_hash, sha256('' || '|' || body) as entry_hash from o where k = 1 union all
          select o.user_id, o.event_id, o.k, f.entry_hash, sha256(f.entry_hash || '|' || o.body) from f join o on o.user_id = f.user_id and o.k = f.k + 1)
    select user_id, event_id, prev_hash, entry_hash from f""")
def audit_chain_build(spark: SparkSession, d: str) -> DataFrame:
    return audit.chained(table(spark, d, E).withColumn("body", F.expr(_ROW)), "user_id", ["ts", "event_id"], "event_id", "body").select("user_id", "event_id", "prev_hash", "entry_hash")


@query("""select user_id, count(*) as n, 0::bigint as n_broken from events group by user_id""")
def audit_chain_verify(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, E).withColumn("body", F.expr(_ROW))
    c = audit.chained(x, "user_id", ["ts", "event_id"], "event_id", "body").join(x.select("event_id", "body", "ts"), "event_id")
    return audit.verified(c, "user_id", ["ts", "event_id"], "body").groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("valid"), 0).otherwise(1)).alias("n_broken"))


@query("""with k as (select event_id, event_type, row_number() over (order by ts desc, event_id desc) as r from events) select event_id, event_type from k where r <= 50 or event_type = 'error'""")
def events_compacted(spark: SparkSession, d: str) -> DataFrame:
    """The latest 50 events, and of all earlier ones the errors. The latest are found by a bounded sort."""
    x = table(spark, d, E).select("event_id", "event_type", "ts")
    new = x.orderBy(F.desc("ts"), F.desc("event_id")).limit(50)
    return new.unionByName(x.where("event_type = 'error'")).select("event_id", "event_type").distinct()


@query("""select event_id, user_id, round(sum(value) over (partition by user_id order by ts, event_id rows unbounded preceding), 4) as used,
    sum(value) over (partition by user_id order by ts, event_id rows unbounded preceding) >= 500 as exhausted from events""")
def budget_ledger(spark: SparkSession, d: str) -> DataFrame:
    s = F.sum("value").over(W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0))
    return table(spark, d, E).select("event_id", "user_id", F.round(s, 4).alias("used"), (s >= 500).alias("exhausted"))


@query("""with h as (select event_id, user_id, ts, cast(json_extract(props, '$.k') as int) as k from events)
    select event_id, user_id, k, lag(k) over (partition by user_id order by ts, event_id) as baseline, coalesce(k <> lag(k) over (partition by user_id order by ts, event_id), false) as changed from h""")
def baseline_change(spark: SparkSession, d: str) -> DataFrame:
    """Each row against the last one before it (an as-of comparison with itself)."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    x = table(spark, d, E).withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("baseline", F.lag("k").over(w))
    return x.select("event_id", "user_id", "k", "baseline", F.coalesce(F.col("k") != F.col("baseline"), F.lit(False)).alias("changed"))
