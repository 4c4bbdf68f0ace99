"""Text features, duplicates, n-grams and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestone.functions import text as X
from lodestone.operators.dedup import similar_pairs
from lodestone.plans.registry import query, table, wide


@query("""with c as (select doc_id, unnest(string_split(text, '')) as ch from documents where text <> ''), n as (select doc_id, ch, count(*) as k from c group by doc_id, ch),
    t as (select doc_id, k, sum(k) over (partition by doc_id) as s, count(*) over (partition by doc_id) as u from n)
    select doc_id, max(u)::bigint as n_distinct, round(sum(-(k / s) * log2(k / s)), 6) as entropy from t group by doc_id""")
def doc_char_entropy(spark: SparkSession, d: str) -> DataFrame:
    x = wide(spark, d, "documents").where("text <> ''").select("doc_id", X.char_counts(F.col("text")).alias("c"))
    return x.select("doc_id", F.col("c.n_distinct").alias("n_distinct"), F.round("c.entropy", 6).alias("entropy"))


@query(r"""with w as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_'']+')) as w from documents), n as (select doc_id, w, count(*) as k from w where length(w) > 3 group by doc_id, w),
    r as (select doc_id, w, k, row_number() over (partition by doc_id order by k desc, w) as rn, sum(k) over (partition by doc_id) as s from n)
    select doc_id, sum(k)::bigint as top5, max(s)::bigint as n_words, round(sum(k) / max(s), 6) as share, (sum(k) / max(s) >= 0.18 and max(k) >= 7) as stuffed from r where rn <= 5 group by doc_id""")
def doc_keyword_stuffing(spark: SparkSession, d: str) -> DataFrame:
    # most common words are found text by text, where the text is; nothing is shuffled
    x = wide(spark, d, "documents").select("doc_id", X.common_words(F.col("text"), 5, 4).alias("c")).where("c.n_words > 0")
    share = F.col("c.top") / F.col("c.n_words")
    return x.select("doc_id", F.col("c.top").alias("top5"), F.col("c.n_words").alias("n_words"), F.round(share, 6).alias("share"), ((share >= 0.18) & (F.col("c.most") >= 7)).alias("stuffed"))


@query("""with l as (select doc_id, trim(unnest(string_split(text, chr(10)))) as line from documents), n as (select doc_id, line, count(*) as k from l where length(line) >= 10 group by doc_id, line)
    select doc_id, max(k)::bigint as most, count(*)::bigint as n_lines from n group by doc_id""")
def doc_line_repetition(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.trim("line").alias("line")).where(F.length("line") >= 10).groupBy("doc_id", "line").agg(F.count("*").alias("k"))
    return n.groupBy("doc_id").agg(F.max("k").alias("most"), F.count("*").alias("n_lines"))


@query("""with b as (select sample_no, ('0x' || substr(sha256(coalesce(id, '')), 1, 8))::bigint % 100 as bucket from attack_samples)
    select sample_no, bucket, case when bucket < 80 then 'train' when bucket < 90 then 'val' else 'test' end as split from b""")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "attack_samples").select("sample_no", X.hash_bucket(F.coalesce("id", F.lit(""))).alias("bucket"))
    return b.select("sample_no", "bucket", F.when(F.col("bucket") < 80, "train").when(F.col("bucket") < 90, "val").otherwise("test").alias("split"))


@query(r"""with h as (select doc_id, sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) as h from documents where text is not null)
    select doc_id, first_doc, n from (select doc_id, min(doc_id) over (partition by h) as first_doc, count(*) over (partition by h) as n from h) where n > 1""")
def doc_exact_dupes(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(X.dedupe_form(F.col("text")), 256).alias("h"))
    g = h.groupBy("h").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).where("n > 1")
    return h.join(g, "h").select("doc_id", "first_doc", "n")


@query(r"""with w as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9_'']+') as w from documents where text is not null),
    g as (select distinct doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) as g from w where len(w) >= 5),
    s as (select doc_id, count(*) as n from g group by doc_id), c as (select doc_id, md5(string_agg(g, '|' order by g)) as h from g group by doc_id),
    r as (select h, min(doc_id) as rep from c group by h), q as (select g.* from g join r on g.doc_id = r.rep),
    p as (select a.doc_id as a, b.doc_id as b, count(*) as k from q a join q b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2)
    select p.a, p.b, round(k / (x.n + y.n - k), 6) as jaccard from p join s x on x.doc_id = p.a join s y on y.doc_id = p.b where k / (x.n + y.n - k) >= 0.8""")
def doc_near_dupes(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of representatives (of documents with equal shingle sets) whose five-word shingles are at least 0.8 alike."""
    w = table(spark, d, "documents").where("text is not null").select("doc_id", F.array_distinct(X.ngrams(X.tokens(F.col("text")), 5)).alias("g"))
    return similar_pairs(w, "doc_id", "g", 0.8)


@query(r"""with w as (select sample_no, lower(trim(label)) as label, regexp_extract_all(lower(text), '[a-z0-9_'']+') as w from attack_samples),
    g as (select distinct sample_no, label, unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i:i+2], ' '))) as g from w),
    t as (select count(*) filter (label <> 'clean') as a, count(*) filter (label = 'clean') as b from w),
    n as (select g, count(*) filter (label <> 'clean') as da, count(*) filter (label = 'clean') as db from g group by g)
    select g, da, db, round(da / a - db / b, 6) as score from n, t where da >= 20 and da / a - db / b >= 0.01""")
def trigger_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """Word triples more frequent in attacks than in clean samples."""
    w = table(spark, d, "attack_samples").select("sample_no", F.lower(F.trim("label")).alias("label"), X.tokens(F.col("text")).alias("w"))
    g = w.select("label", F.explode(F.array_distinct(X.ngrams(F.col("w"), 3))).alias("g"))
    t = w.agg(F.sum(F.when(F.col("label") != "clean", 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("label") == "clean", 1).otherwise(0)).alias("b"))
    n = g.groupBy("g").agg(F.sum(F.when(F.col("label") != "clean", 1).otherwise(0)).alias("da"), F.sum(F.when(F.col("label") == "clean", 1).otherwise(0)).alias("db")).where("da >= 20")
    s = F.col("da") / F.col("a") - F.col("db") / F.col("b")
    return n.join(F.broadcast(t)).where(s >= 0.01).select("g", "da", "db", F.round(s, 6).alias("score"))


@query(r"""select sample_no, length(text)::int as n_chars, len(regexp_extract_all(text, '[^\s]+'))::int as n_words, round(len(regexp_extract_all(text, '[A-Z]')) / greatest(length(text), 1), 6) as upper_ratio,
    round(len(regexp_extract_all(text, '[{}\[\]<>|`~\\/]')) / greatest(length(text), 1), 6) as special_ratio, round(len(regexp_extract_all(text, '\?')) / greatest(length(text), 1), 6) as question_ratio,
    len(regexp_extract_all(text, '\n'))::int as n_newlines from attack_samples""")
def text_features(spark: SparkSession, d: str) -> DataFrame:
    t, n = F.col("text"), F.greatest(F.length("text"), F.lit(1))
    count = lambda p: F.regexp_count(t, F.lit(p))
    return table(spark, d, "attack_samples").select(
        "sample_no", F.length(t).alias("n_chars"), count(r"[^\s]+").alias("n_words"), F.round(count("[A-Z]") / n, 6).alias("upper_ratio"),
        F.round(count(r"[{}\[\]<>|`~\\/]") / n, 6).alias("special_ratio"), F.round(count(r"\?") / n, 6).alias("question_ratio"), count("\n").alias("n_newlines"))


@query("""select doc_id, translate(text, '%s', '%s') as folded, translate(text, '%s', '%s') <> text as found from documents""" % ((X.FOLD_FROM, X.FOLD_TO) * 2))
def doc_homoglyph_fold(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", X.fold(t).alias("folded"), (X.fold(t) != t).alias("found"))


@query()
def doc_nfkc(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.nfkc(F.col("text")).alias("normal"))


@query(r"""select sample_no, len(regexp_extract_all(text, '[А-Яа-яЁё]'))::int as n_cyrillic, len(regexp_extract_all(text, '[A-Za-z]'))::int as n_latin,
    case when len(regexp_extract_all(text, '[А-Яа-яЁё]')) > len(regexp_extract_all(text, '[A-Za-z]')) then 'Cyrillic' else 'Latin' end as script from attack_samples""")
def script_shares(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "attack_samples").select("sample_no", F.regexp_count("text", F.lit("[А-Яа-яЁё]")).alias("n_cyrillic"), F.regexp_count("text", F.lit("[A-Za-z]")).alias("n_latin"))
    return x.withColumn("script", F.when(F.col("n_cyrillic") > F.col("n_latin"), "Cyrillic").otherwise("Latin"))


@query("""with l as (select source, length(text) as n from documents where text is not null), r as (select source, n, row_number() over (partition by source order by n) as rn, count(*) over (partition by source) as c from l)
    select source, max(c)::bigint as n_docs, max(case when rn = ceil(0.5 * c) then n end)::bigint as p50, max(case when rn = ceil(0.9 * c) then n end)::bigint as p90 from r group by source""")
def length_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-rank percentiles over a histogram of lengths, so that no source's lengths meet in one task one by one."""
    h = table(spark, d, "documents").where("text is not null").groupBy("source", F.length("text").alias("n")).agg(F.count("*").alias("k"))
    w = W.partitionBy("source").orderBy("n")
    r = h.withColumn("cum", F.sum("k").over(w)).withColumn("c", F.sum("k").over(W.partitionBy("source")))
    at = lambda q: F.min(F.when(F.col("cum") >= F.ceil(F.lit(q) * F.col("c")), F.col("n"))).cast("bigint")
    return r.groupBy("source").agg(F.max("c").alias("n_docs"), at(0.5).alias("p50"), at(0.9).alias("p90"))


@query("select doc_id * 2 as a, doc_id * 2 + 1 as b, round(35 / 37, 6) as jaccard from documents")
def planted_near_dupes(spark: SparkSession, d: str) -> DataFrame:
    """Texts of forty words of their own and copies whose last word is another: each pair, and nothing else, is found."""
    word = lambda i: F.concat(F.lit("w"), F.col("doc_id").cast("string"), F.lit("x"), i.cast("string"))
    x = table(spark, d, "documents").select("doc_id", F.transform(F.sequence(F.lit(1), F.lit(39)), word).alias("w"))
    two = F.array(F.struct((F.col("doc_id") * 2).alias("id"), F.concat("w", F.array(F.lit("end"))).alias("w")), F.struct((F.col("doc_id") * 2 + 1).alias("id"), F.concat("w", F.array(F.lit("other"))).alias("w")))
    y = x.select(F.inline(two)).select("id", F.array_distinct(X.ngrams(F.col("w"), 5)).alias("g"))
    return similar_pairs(y, "id", "g", 0.8)
