"""Sources and sinks: tables written in each format to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.registry import query, shared_folder, table
from lodestone.sources import files


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("select result_no, model, outcome, score from evaluation_results")
def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark, "jsonl")
    files.write_jsonl(table(spark, d, "evaluation_results").select("result_no", "model", "outcome", "score"), at)
    return files.read_jsonl(spark, at, "result_no long, model string, outcome string, score double")


@query("select count(*) as n_good, (select count(*) from attack_samples where sample_no % 10 = 0) as n_bad from attack_samples where sample_no % 10 <> 0")
def jsonl_strict(spark: SparkSession, d: str) -> DataFrame:
    """Lines of which a tenth is broken: counted, not lost."""
    at = _folder(spark, "strict")
    line = F.to_json(F.struct("sample_no", "label"))
    table(spark, d, "attack_samples").select(F.when(F.col("sample_no") % 10 == 0, F.concat(F.lit("{broken "), line)).otherwise(line).alias("value")).write.text(at)
    x = files.read_jsonl(spark, at, "sample_no long, label string", bad="keep")
    bad = F.col(files.BAD).isNotNull()
    return x.agg(F.sum(F.when(~bad & F.col("sample_no").isNotNull(), 1).otherwise(0)).alias("n_good"), F.sum(F.when(bad, 1).otherwise(0)).alias("n_bad"))


@query("select count(*) as n_rows, 4::bigint as n_shards, true as same from events")
def sharded(spark: SparkSession, d: str) -> DataFrame:
    """Shards with their manifest, which what is read back agrees with."""
    at = _folder(spark, "shards")
    x = table(spark, d, "events").select("event_id", "user_id", "event_type")
    m = files.write_shards(x, at, "event_id", 4)
    back = spark.read.parquet(at).groupBy("shard").agg(F.count("*").alias("k"))
    return m.join(back, "shard").agg(F.sum("n_rows").cast("long").alias("n_rows"), F.count("*").alias("n_shards"), F.min(F.col("n_rows") == F.col("k")).alias("same"))


@query("""with u as (select sample_no, id, 0 as part from attack_samples union all select sample_no, id, 1 from incoming_samples), r as (select *, row_number() over (partition by lower(trim(id)) order by part, sample_no) as k from u where id is not null)
    select lower(trim(id)) as id, sample_no, part from r where k = 1""")
def merged_shards(spark: SparkSession, d: str) -> DataFrame:
    """Two tables as one, the first row of each key kept."""
    a, b = (table(spark, d, n).where("id is not null").select(F.lower(F.trim("id")).alias("id"), "sample_no", F.lit(i).alias("part")) for i, n in enumerate(("attack_samples", "incoming_samples")))
    return files.merge_first([a, b], ["id"], ["part", "sample_no"])


@query("""select sample_no, id, null as batch_no from attack_samples union all select sample_no, id, batch_no from incoming_samples""")
def two_shapes(spark: SparkSession, d: str) -> DataFrame:
    return files.union_shapes(table(spark, d, "attack_samples").select("sample_no", "id"), table(spark, d, "incoming_samples").select("sample_no", "id", "batch_no"))


@query("""select event_id, user_id, (case when event_id % 3 = 2 then 2 else event_id % 3 end)::int as file_no from events""")
def rotated_logs(spark: SparkSession, d: str) -> DataFrame:
    """Entries of two rotated logs and the one in use, with the order of their files."""
    at = _folder(spark, "audit")
    x = table(spark, d, "events").select("event_id", "user_id")
    hadoop = spark._jvm.org.apache.hadoop.fs
    for i, name in enumerate(("audit.20240101.jsonl", "audit.20240102.jsonl", "audit.jsonl")):
        part = f"{at}/part-{i}"
        files.write_jsonl(x.where(F.col("event_id") % 3 == i).coalesce(1), part)
        fs = hadoop.Path(part).getFileSystem(spark._jsc.hadoopConfiguration())
        own = next(f.getPath() for f in fs.listStatus(hadoop.Path(part)) if f.getPath().getName().startswith("part-"))
        fs.rename(own, hadoop.Path(f"{at}/{name}"))
        fs.delete(hadoop.Path(part), True)
    return files.read_rotated(spark, at, "event_id long, user_id long").select("event_id", "user_id", "file_no")


@query("select doc_id, 'text/plain' as kind, left(regexp_replace(text, '[^a-z]', '', 'g'), 20) as content from documents where length(regexp_replace(text, '[^a-z]', '', 'g')) > 0")
def embedded_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a data URI in them: what it carries."""
    x = table(spark, d, "documents").select("doc_id", F.substring(F.regexp_replace("text", "[^a-z]", ""), 1, 20).alias("s")).where("length(s) > 0")
    page = F.concat(F.lit("<img src='data:text/plain;base64,"), F.base64(F.encode("s", "UTF-8")), F.lit("'> and data:,"))
    return x.select("doc_id", F.inline(files.data_uris(page)))


@query(r"""select distinct lower(trim(regexp_replace(task, '\s+', ' ', 'g'))) as phrase from (select replace(task, '_', ' ') as task from trial_plan) where length(trim(task)) >= 10 and contains(trim(task), ' ')""")
def seed_phrases(spark: SparkSession, d: str) -> DataFrame:
    return files.phrase_list(table(spark, d, "trial_plan").select(F.replace("task", F.lit("_"), F.lit(" ")).alias("task")), "task")


@query("""select 'calls{event_type="' || event_type || '"} ' || count(*)::varchar as line from events group by event_type""")
def counter_lines(spark: SparkSession, d: str) -> DataFrame:
    return files.prometheus(table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")), "calls", ["event_type"], "n")
