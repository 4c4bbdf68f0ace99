"""Rule-table scans of documents, attack texts and responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import decode, rules
from lodestone.plans.registry import query, table, wide

ALL = rules.INJECTION + rules.SECRETS


@query(rules.scan_sql(ALL, "documents", "doc_id", "text"))
def doc_scan_verdict(spark: SparkSession, d: str) -> DataFrame:
    return rules.scan(wide(spark, d, "documents"), "doc_id", "text", ALL)


@query(rules.findings_sql(ALL, "documents", "doc_id", "text"))
def doc_findings(spark: SparkSession, d: str) -> DataFrame:
    return rules.findings(wide(spark, d, "documents"), "doc_id", "text", ALL)


@query(f"select rule_id, category, count(*) as n_docs, sum(n_hits)::bigint as n_hits from ({rules.findings_sql(ALL, 'documents', 'doc_id', 'text')}) group by rule_id, category")
def doc_rule_counts(spark: SparkSession, d: str) -> DataFrame:
    return doc_findings(spark, d).groupBy("rule_id", "category").agg(F.count("*").alias("n_docs"), F.sum("n_hits").cast("bigint").alias("n_hits"))


@query(f"""with r as ({rules.scan_sql(ALL, 'documents', 'doc_id', 'text')})
    select lang, source, count(*) as n_docs, round(avg(risk), 6) as mean_risk, sum(case when verdict = 'block' then 1 else 0 end)::bigint as n_blocked, grouping(lang, source)::bigint as level
    from r join documents using (doc_id) group by grouping sets ((lang), (source), ())""")
def doc_category_summary(spark: SparkSession, d: str) -> DataFrame:
    x = doc_scan_verdict(spark, d).join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    return x.groupingSets([[F.col("lang")], [F.col("source")], []], F.col("lang"), F.col("source")).agg(
        F.count("*").alias("n_docs"), F.round(F.avg("risk"), 6).alias("mean_risk"), F.sum(F.when(F.col("verdict") == "block", 1).otherwise(0)).alias("n_blocked"),
        F.grouping_id().cast("bigint").alias("level"))


@query(rules.scan_sql(rules.INJECTION, "attack_samples", "sample_no", "text"))
def attack_scan_verdict(spark: SparkSession, d: str) -> DataFrame:
    return rules.scan(wide(spark, d, "attack_samples"), "sample_no", "text", rules.INJECTION)


@query(rules.scan_sql(rules.SECRETS + rules.MARKUP, "evaluation_results", "result_no", "response_text"))
def output_scan_verdict(spark: SparkSession, d: str) -> DataFrame:
    return rules.scan(wide(spark, d, "evaluation_results"), "result_no", "response_text", rules.SECRETS + rules.MARKUP)


@query(rules.scan_sql(rules.COMMANDS, "evaluation_results", "result_no", "response_text"))
def command_scan(spark: SparkSession, d: str) -> DataFrame:
    return rules.scan(wide(spark, d, "evaluation_results"), "result_no", "response_text", rules.COMMANDS)


@query(rules.scan_sql(rules.UNICODE, "attack_samples", "sample_no", "text"))
def unicode_scan(spark: SparkSession, d: str) -> DataFrame:
    return rules.scan(wide(spark, d, "attack_samples"), "sample_no", "text", rules.UNICODE)


@query(f"""select f.doc_id, f.rule_id, f.category, f.confidence from ({rules.findings_sql(ALL, 'documents', 'doc_id', 'text')}) f
    where not (f.rule_id = 'account_reference' or (f.category = 'pii' and f.rule_id = 'ipv4') or f.category = 'encoding_attack')""")
def suppressed_findings(spark: SparkSession, d: str) -> DataFrame:
    s = spark.createDataFrame([("account_reference", None), ("ipv4", "pii"), (None, "encoding_attack")], "rule_id string, category string")
    return rules.suppress(doc_findings(spark, d), s).select("doc_id", "rule_id", "category", "confidence")


@query("""select doc_id, regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z0-9.-]*[A-Za-z]', '[email]', 'g'), '[A-Za-z]{4,}-[0-9]{4}', '[account]', 'g') as redacted,
    len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z0-9.-]*[A-Za-z]'))::int as n_email, len(regexp_extract_all(text, '[A-Za-z]{4,}-[0-9]{4}'))::int as n_account from documents""")
def doc_pii_redact(spark: SparkSession, d: str) -> DataFrame:
    email, account = (next(r.pattern for r in rules.SECRETS if r.rule_id == x) for x in ("email", "account_reference"))
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", F.regexp_replace(F.regexp_replace(t, email, "[email]"), account, "[account]").alias("redacted"),
        F.regexp_count(t, F.lit(email)).alias("n_email"), F.regexp_count(t, F.lit(account)).alias("n_account"))


_CUE = r"(?i)\b(must|should|never|always|only|do not|ignore|instead)\b"
_VERB = r"(?im)(^|[.!?] )(open|send|copy|replace|rename|write|read|call|encode|append|treat|forget|stop|switch|let|hand|pretend)\b"


@query(f"""with c as (select sample_no, len(regexp_extract_all(text, '{_CUE}')) as cues, len(regexp_extract_all(text, '{_VERB}')) as verbs from attack_samples)
    select sample_no, cues::int as n_cues, verbs::int as n_verbs, round(greatest(case when cues >= 3 then least(0.5 + 0.1 * cues, 0.85) else 0 end, case when verbs >= 3 then least(0.4 + 0.1 * verbs, 0.8) else 0 end)::double, 6) as score from c""")
def structural_density(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "attack_samples").select("sample_no", F.regexp_count("text", F.lit(_CUE)).alias("n_cues"), F.regexp_count("text", F.lit(_VERB)).alias("n_verbs"))
    a = F.when(F.col("n_cues") >= 3, F.least(F.lit(0.5) + 0.1 * F.col("n_cues"), F.lit(0.85))).otherwise(0.0)
    b = F.when(F.col("n_verbs") >= 3, F.least(F.lit(0.4) + 0.1 * F.col("n_verbs"), F.lit(0.8))).otherwise(0.0)
    return x.select("sample_no", "n_cues", "n_verbs", F.round(F.greatest(a, b), 6).alias("score"))


_TRIGGER, _TAIL = r"(?i)\b(as though|regardless of|even if|unless)\b", r"(?i)\b(as though|regardless of|even if|unless)\b[^.!?]{0,200}?\b(confirmation|warning|refusal|wording|work|objects)\b"


@query(f"select sample_no, len(regexp_extract_all(text, '{_TRIGGER}'))::int as n_triggers, len(regexp_extract_all(text, '{_TAIL}'))::int as n_pairs from attack_samples")
def trigger_then_target(spark: SparkSession, d: str) -> DataFrame:
    """Triggers, and triggers followed by a target within the sentence and 200 characters."""
    return table(spark, d, "attack_samples").select("sample_no", F.regexp_count("text", F.lit(_TRIGGER)).alias("n_triggers"), F.regexp_count("text", F.lit(_TAIL)).alias("n_pairs"))


@query()
def decoded_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings in encoded parts of documents, up to three layers deep."""
    docs = wide(spark, d, "documents").select("doc_id", "text")
    return decode.decode_and_scan(docs, "doc_id", "text", rules.INJECTION)


@query("select doc_id, translate(text, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM') as rotated from documents")
def doc_rot13(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", decode.rot13(F.col("text")).alias("rotated"))
