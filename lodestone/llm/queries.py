"""The queries of the training-data problems and, where SQL can say the same, their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestone.llm import confusables, consensus, grouping, history, language, mixing, overlap, packing, pairs, subjects, tokens
from lodestone.llm.common import EMPTY_HASH, NO_VALUE, hash_key, model_key, present, records, spread, stored, table


def samples(spark: SparkSession, d: str) -> DataFrame:
    return records(table(spark, d, "attack_samples"))


# 1 ---------------------------------------------------------------------------------------------------------------------------------
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    s = stored(confusables.keyed_forms(spread(samples(spark, d)), "sample_no", "text", present(F.col("id")).alias("id")), "forms")
    results = table(spark, d, "evaluation_results").select("result_no", "attack_id", "attack_text")
    r = stored(confusables.keyed_forms(spread(results), "result_no", "attack_text", present(F.col("attack_id")).alias("id")), "forms")
    own = s.drop("id")
    pairs = confusables.look_alike_pairs(own, own, []).where("key_a < key_b").select(F.lit("sample").alias("kind"), "key_a", "key_b")
    return pairs.unionByName(confusables.look_alike_pairs(s, r, ["id"]).select(F.lit("result").alias("kind"), "key_a", "key_b"))


def p1_texts(spark: SparkSession, d: str) -> DataFrame:
    """The form of each sample's and each result's attack text: kind is `sample` or `result`, key its number."""
    s = table(spark, d, "attack_samples").select(F.lit("sample").alias("kind"), F.col("sample_no").alias("key"), "text")
    r = table(spark, d, "evaluation_results").select(F.lit("result").alias("kind"), F.col("result_no").alias("key"), F.col("attack_text").alias("text"))
    return confusables.consistent_texts(spread(s.unionByName(r))).select("kind", "key", "canonical", "canonical_changed")


# 2 ---------------------------------------------------------------------------------------------------------------------------------
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.cross_split_overlaps(spread(samples(spark, d))).select(F.col("a").alias("sample_no_a"), F.col("b").alias("sample_no_b"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    df = samples(spark, d)
    return overlap.overlap_report(overlap.cross_split_overlaps(spread(df)), df)


# 3 ---------------------------------------------------------------------------------------------------------------------------------
def _labels(spark: SparkSession, d: str) -> DataFrame:
    outcome = present(F.col("outcome"))
    return consensus.latest_labels(table(spark, d, "evaluation_results"), present(F.col("attack_id")), model_key(F.col("model")), F.when(outcome != "error", outcome), F.col("ts_epoch"), F.col("result_no"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_consensus(spark, d).where("n_labels >= 3").select("attack_id", "outcome")


def p3_consensus(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(*consensus.fit(_labels(spark, d))).withColumnsRenamed({"item": "attack_id", "label": "outcome"})


def p3_reliability(spark: SparkSession, d: str) -> DataFrame:
    return consensus.reliabilities(*consensus.fit(_labels(spark, d))).withColumnRenamed("worker", "model")


# 4 ---------------------------------------------------------------------------------------------------------------------------------
def _links() -> list:
    return [hash_key(F.col("family_sha256")), present(F.col("contributor")), present(F.col("source_ref"))]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    df = samples(spark, d).select("sample_no", "family_sha256", "contributor", "source_ref")
    return grouping.related(df, "sample_no", _links()).select(F.col("node").alias("sample_no"), F.col("component").alias("group_no"))


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    df = samples(spark, d).select("sample_no", "family_sha256", "contributor", "source_ref", present(F.col("label")).alias("label"))
    group = grouping.related(df, "sample_no", _links()).select(F.col("node").alias("sample_no"), "component")
    rows = df.join(group, "sample_no", "left").select("sample_no", F.coalesce("component", "sample_no").alias("component"), "label")
    targets = [(r["split"], r["target_share"]) for r in table(spark, d, "split_targets").orderBy(F.desc("target_share"), "split").collect()]
    return grouping.grouped_splits(rows, targets).select("sample_no", F.col("component").alias("group_no"), "split")


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    n = p4_splits(spark, d).groupBy("split").agg(F.count("*").alias("n_records"), F.countDistinct("group_no").alias("n_groups"))
    return n.withColumn("share", F.round(F.col("n_records") / F.sum("n_records").over(W.partitionBy()), 6))


# 5 ---------------------------------------------------------------------------------------------------------------------------------
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    df = samples(spark, d).select("sample_no", "text", "source_lang")
    return language.relabelled(spread(df), "sample_no", "text", "source_lang", language.fit(df, "sample_no", "text", "source_lang")).select("sample_no", "segment_no", "lang")


def p5_segments(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "attack_samples").select("sample_no", "text", "source_lang")
    return language.segments(spread(df), "sample_no", "text", language.fit(df, "sample_no", "text", "source_lang"))


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    """Each record's main language, the share of its characters in that language and the confidence, over all segments by their sentences; lang is null without letters."""
    x = p5_segments(spark, d)
    per = x.groupBy("sample_no", "lang").agg(F.sum("n_chars").alias("c"), F.sum("n_sentences").alias("s"), F.sum(F.col("confidence") * F.col("n_sentences")).alias("w"))
    g = per.groupBy("sample_no").agg(F.max_by("lang", F.struct(F.col("lang").isNotNull(), "c", "lang")).alias("lang"), F.max(F.when(F.col("lang").isNotNull(), F.col("c"))).alias("most"), F.sum("c").alias("all"), F.sum("w").alias("w"), F.sum("s").alias("s"))
    return g.select("sample_no", "lang", F.round(F.coalesce("most", F.lit(0)) / F.greatest("all", F.lit(1)), 4).alias("share"), F.round(F.col("w") / F.greatest("s", F.lit(1)), 4).alias("confidence"))


# 6 ---------------------------------------------------------------------------------------------------------------------------------
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    df = spread(table(spark, d, "evaluation_results").select("result_no", "attack_text", "response_text", "error", "source_lang"))
    return pairs.defective(df, "result_no", "attack_text", "response_text", "error", language.fit(df, "result_no", "attack_text", "source_lang"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Rows and defects of each model."""
    model = table(spark, d, "evaluation_results").select("result_no", model_key(F.col("model")).alias("model"))
    x = model.join(p6_found(spark, d), "result_no", "left")
    return x.groupBy("model", F.coalesce("defect", F.lit("none")).alias("defect")).agg(F.count("*").alias("n"))


# 7 ---------------------------------------------------------------------------------------------------------------------------------
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    cols = [F.col("sample_no").alias("no"), "id", "family_sha256", "text"]
    old = spread(table(spark, d, "attack_samples").select(*cols))
    new = spread(table(spark, d, "incoming_samples").select(*cols, "batch_no"))
    found = history.repeats(old, new, "batch_no", [present(F.col("id")), hash_key(F.col("family_sha256"))])
    return found.select("match_no", F.col("no").alias("sample_no"))


# 8 ---------------------------------------------------------------------------------------------------------------------------------
def _sized(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return stored(docs.select(F.col("doc_id").alias("item"), tokens.count_tokens(F.col("text")).alias("size")), "sizes")


def p8_windows(spark: SparkSession, d: str) -> DataFrame:
    items, out = _sized(spark, d), None
    for r in table(spark, d, "context_windows").orderBy("capacity_tokens", "window_name").collect():
        x = packing.pack(items, r["capacity_tokens"]).select(F.lit(r["window_name"]).alias("window_name"), F.col("container").alias("window_no"), F.col("item").alias("doc_id"), F.col("piece").alias("piece_no"), F.col("length").alias("n_tokens"))
        out = x if out is None else out.unionByName(x)
    return out


def p8_unused(spark: SparkSession, d: str) -> DataFrame:
    """Windows of each kind, those that the tokens would fill at least, and the unused share."""
    size = table(spark, d, "context_windows").select("window_name", "capacity_tokens")
    used = p8_windows(spark, d).groupBy("window_name").agg(F.countDistinct("window_no").alias("n_windows"), F.sum("n_tokens").alias("n_tokens"))
    return used.join(F.broadcast(size), "window_name").select(
        "window_name", "n_windows", F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("n_least"), "n_tokens",
        (F.col("n_windows") * F.col("capacity_tokens") - F.col("n_tokens")).alias("n_unused"), F.round(1 - F.col("n_tokens") / (F.col("n_windows") * F.col("capacity_tokens")), 6).alias("unused_share"))


# 9 ---------------------------------------------------------------------------------------------------------------------------------
def p9_uses(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    targets = [(r["source"], r["target_share"], r["max_repeats"]) for r in table(spark, d, "mix_targets").withColumn("source", mixing.source_key(F.col("source"))).collect()]
    own = spread(docs.withColumn("source", mixing.source_key(F.col("source"))).where(F.col("source").isin([t[0] for t in targets])))
    own = own.select(F.col("doc_id").alias("item"), "source", "text")
    cells = mixing.profiled(own, "item", "text", language.fit(docs, "doc_id", "text", "lang"), _subject_model(spark, d))
    out = mixing.mixed(cells, {t[0]: t[1] for t in targets}, {t[0]: t[2] for t in targets})
    return out.select(F.col("item").alias("doc_id"), "source", "language", "topic", F.col("tokens").alias("n_tokens"), "weight", "uses")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.share_report(p9_uses(spark, d).withColumnRenamed("n_tokens", "tokens"), table(spark, d, "mix_targets"))


def p9_met(spark: SparkSession, d: str) -> DataFrame:
    """Whether each source has its share of all tokens, to the tokens of the largest document that any listed source has: no document is split."""
    uses = stored(p9_uses(spark, d), "uses")
    x = mixing.share_report(uses.withColumnRenamed("n_tokens", "tokens"), table(spark, d, "mix_targets"))
    all_ = uses.agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("total"), F.max("n_tokens").alias("largest"))
    return x.join(F.broadcast(all_)).select("source", (F.abs(F.col("n_tokens") - F.col("target_share") * F.col("total")) <= F.col("largest")).alias("met"))


# 10 -------------------------------------------------------------------------------------------------------------------------------
def _subject_model(spark: SparkSession, d: str) -> subjects.SubjectModel:
    names = [r["subject"] for r in table(spark, d, "subjects").collect()]
    return subjects.fit(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "subject_labels"), names)


def _subjects(spark: SparkSession, d: str, docs: DataFrame) -> DataFrame:
    return subjects.document_subjects(docs, "doc_id", "text", _subject_model(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d, spread(table(spark, d, "documents").select("doc_id", "text"))).select("doc_id", "subject")


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents on each subject, and on none, with their share of all documents."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    x = docs.select("doc_id").join(_subjects(spark, d, docs), "doc_id", "left").withColumn("subject", F.coalesce("subject", F.lit("none")))
    n = x.groupBy("subject").agg(F.count("*").alias("n_documents"), F.sum("n_sentences").alias("n_sentences"))
    return n.withColumn("share", F.round(F.col("n_documents") / docs.count(), 6))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _prepared(f) for k, f in globals().items() if k.startswith("p") and k[1:2].isdigit()}


def _prepared(f: Callable) -> Callable:
    @functools.wraps(f)
    def run(spark: SparkSession, d: str) -> DataFrame:
        confusables.prepare(spark)
        return f(spark, d)

    return run


def oracle_sql() -> dict[str, str]:
    gone = ", ".join("'" + x.replace("'", "''") + "'" for x in NO_VALUE)
    clean = lambda c: f"lower(trim({c}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)))"
    known = lambda c: f"case when {clean(c)} in ({gone}) then null else {clean(c)} end"
    family = f"regexp_replace({known('family_sha256')}, '^sha-?256\\s*[:=]\\s*', '')"
    return {
        # components as all that can be reached, which only small components keep cheap
        "p4_found": f"""with recursive r as (select * from attack_samples where id is null or sample_no in (select min(sample_no) from attack_samples group by {clean("id")})),
            f as (select sample_no as n, {family} as f, {known("contributor")} as c, {known("source_ref")} as s from r),
            k as (select n, 'f' || f as k from f where f is not null and f <> '{EMPTY_HASH}' and not regexp_matches(f, '^0+$') union all select n, 'c' || c from f where c is not null union all select n, 's' || s from f where s is not null),
            m as (select k, min(n) as m from k group by k having count(*) > 1), h as (select n, m from k join m using (k) where n <> m), e as (select n as a, m as b from h union select m, n from h),
            c(n, m) as (select distinct a, a from e union select e.b, c.m from c join e on e.a = c.n)
            select n as sample_no, min(m) as group_no from c group by n""",
        # what the shares are is the targets' to say
        "p9_met": "select regexp_replace(lower(trim(source)), '[\\s-]+', '_', 'g') as source, true as met from mix_targets",
    }
