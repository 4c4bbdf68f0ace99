"""Markup in texts, conversations made of trial rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import media, rules
from lodestone.plans.registry import query, table, wide


@query(rules.scan_sql(rules.MARKUP, "documents", "doc_id", "text"))
def markup_scan(spark: SparkSession, d: str) -> DataFrame:
    return rules.scan(wide(spark, d, "documents"), "doc_id", "text", rules.MARKUP)


@query()
def html_divergence(spark: SparkSession, d: str) -> DataFrame:
    """Documents as pages whose second half is hidden."""
    x = wide(spark, d, "documents").where("text is not null").select("doc_id", "text")
    half = (F.length("text") / 2).cast("int")
    page = F.concat(F.lit("<html><body><p>"), F.substring("text", F.lit(1), half), F.lit('</p><div style="display:none">'), F.substring("text", half + 1, F.length("text")), F.lit("</div></body></html>"))
    return media.html_divergence(x.select("doc_id", page.alias("html")), "doc_id", "html").select("doc_id", F.round("ratio", 6).alias("ratio"), "severity")


@query(r"""with m as (select result_no, response_text as t, (case when regexp_matches(response_text, '(?m)^#{1,6} ') then 1 else 0 end) + (case when regexp_matches(response_text, '(?m)^[-*] ') then 1 else 0 end) + (case when regexp_matches(response_text, '\[[^\]]+\]\([^)]+\)') then 1 else 0 end)
      + (case when regexp_matches(response_text, '```') then 1 else 0 end) + (case when regexp_matches(response_text, '\*\*[^*]+\*\*') then 1 else 0 end) as k from evaluation_results where response_text is not null)
    select result_no, case when contains(substr(t, 1, 1024), '%PDF-') then 'pdf' when regexp_matches(substr(t, 1, 4096), '(?i)<(!doctype html|html|body|head|div|script)\b') then 'html' when k >= 2 then 'markdown' else 'plain' end as kind from m""")
def content_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "evaluation_results").where("response_text is not null").select("result_no", media.content_type(F.col("response_text")).alias("kind"))


@query()
def ascii_art(spark: SparkSession, d: str) -> DataFrame:
    return media.ascii_art_blocks(table(spark, d, "documents"), "doc_id", "text")


@query("select doc_id, 1 as first_line, 3::bigint as n_lines from documents")
def planted_art(spark: SparkSession, d: str) -> DataFrame:
    """A picture of signs between two lines of text is found in its place."""
    x = table(spark, d, "documents").select("doc_id", F.lit("Some words.\n#####\n##@##\n#####\nMore words.").alias("text"))
    return media.ascii_art_blocks(x, "doc_id", "text")


@query()
def planted_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents' beginnings as texts in images: found, with the statistics of the file's last bits."""
    x = table(spark, d, "documents").where("text is not null").select("doc_id", F.regexp_replace(F.substring("text", 1, 40), "[^ -~]", "").alias("s"))
    body = F.concat(F.encode(F.lit("Note\0"), "ISO-8859-1"), F.encode("s", "ISO-8859-1"))
    chunk = F.concat(F.unhex(F.lpad(F.hex(F.length(body)), 8, "0")), F.encode(F.lit("tEXt"), "ISO-8859-1"), body, F.unhex(F.lit("00000000")))
    png = F.concat(F.unhex(F.lit("89504E470D0A1A0A")), chunk, F.unhex(F.lit("0000000049454E4400000000")))
    files = x.select(F.col("doc_id").cast("string").alias("path"), png.alias("content"))
    found = media.scan_files(files).select("path", "kind", "finding")
    return found.join(media.bit_measures(files), "path", "left")
