"""Streams of the event log, run to the end of the files there are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans.registry import query, shared_folder
from lodestone.streaming import detectors


@query("""select make_timestamp((epoch_us(ts) // 21600000000) * 21600000000) as "start", event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2""")
def stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    return detectors.summarised(detectors.window_counts(detectors.event_stream(spark, d, "events")), shared_folder(spark))


@query()
def stream_failure_runs(spark: SparkSession, d: str) -> DataFrame:
    return detectors.finished(detectors.failure_runs(detectors.event_stream(spark, d, "events")), shared_folder(spark))


@query("select event_id, user_id, event_type, value from events")
def stream_first_deliveries(spark: SparkSession, d: str) -> DataFrame:
    return detectors.finished(detectors.first_deliveries(detectors.event_stream(spark, d, "events")), shared_folder(spark)).select("event_id", "user_id", "event_type", "value")


@query("""with l as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over w >= 43200000000 then 1 else 0 end as b from events window w as (partition by user_id order by ts, event_id)),
    s as (select *, sum(b) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from l) select user_id, min(ts) as "start", max(ts) + interval 12 hours as "end", count(*) as n from s group by user_id, k""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    return detectors.summarised(detectors.session_counts(detectors.event_stream(spark, d, "events")), shared_folder(spark))
