"""Detectors over streams: windows with watermarks, deduplication, and state by key."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, path: str, name: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of the table's files, its time column as a timestamp."""
    schema = spark.read.parquet(f"{path}/{name}.parquet").schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    return s.parquet(f"{path}/{name}.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, late: str = "1 hour", size: str = "6 hours", slide: str = "6 hours") -> DataFrame:
    """window start, event_type, n, total: rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str = "12 hours", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_deliveries(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def failure_runs(events: DataFrame, least: int = 3) -> DataFrame:
    """user_id, event_id, run: rows that make a run of failures `least` long or longer. The state of a user is the length of the open run.

    A micro-batch's rows are put in order of time; rows that come in a later batch than newer ones count from there on.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = state.get[0] if state.exists else 0
        rows: list[dict[str, Any]] = []
        for x in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples():
            run = run + 1 if x.event_type == "error" else 0
            if run >= least:
                rows.append({"user_id": key[0], "event_id": x.event_id, "run": run})
        state.update((run,))
        yield pd.DataFrame(rows, columns=["user_id", "event_id", "run"])

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, run int", "run int", "append", GroupStateTimeout.NoTimeout)


def finished(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All that the stream gives for the files there are, written to files under `folder` and read back. In append mode windows that the watermark hasn't passed stay open."""
    run = uuid.uuid4().hex
    out = f"{folder}/stream-{run}/out"
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", f"{folder}/stream-{run}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def summarised(stream: DataFrame, folder: str) -> DataFrame:
    """All windows and sessions of the files there are, open ones too: each micro-batch gives all so far (complete mode), and what the last one gave is read back. Rows later than the watermark
    still count, as no window is closed."""
    run = uuid.uuid4().hex
    at = f"{folder}/stream-{run}"
    last: list[str] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out-{number}")
        last[:] = [f"{at}/out-{number}"]

    q = stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(last[0]) if last else spark.createDataFrame([], stream.schema)
