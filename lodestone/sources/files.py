"""Readers and writers of trial rows, corpora, binary files and audit logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType | str, bad: str = "drop") -> DataFrame:
    """JSON lines. bad = drop: malformed lines vanish; keep: they are rows with the line in _corrupt_record, so they can be counted."""
    if bad == "drop":
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    s = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return spark.read.schema(T.StructType([*s.fields, T.StructField(BAD, T.StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(path)


def read_shards(spark: SparkSession, folder: str, schema: str, pattern: str = "shard_*.jsonl", without: str = "_broken") -> DataFrame:
    """All shards of a folder with the name of each row's file; files whose name has `without` are left out."""
    x = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("pathGlobFilter", pattern).json(folder)
    return x.withColumn("shard_file", F.col("_metadata.file_name")).where(~F.col("shard_file").contains(without))


def union_shapes(*frames: DataFrame) -> DataFrame:
    """Rows of several shapes as one table; columns that a shape lacks are null."""
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def read_corpus(spark: SparkSession, spec: str) -> DataFrame:
    """text of an outside corpus: `file.txt` (lines), `file.csv:csv:field` or `file.jsonl:field`."""
    path, *rest = spec.split(":")
    if not rest:
        x = spark.read.text(path).select(F.col("value").alias("text"))
    elif rest[0] == "csv":
        x = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).select(F.col(rest[1]).alias("text"))
    else:
        x = spark.read.schema(f"`{rest[0]}` string").json(path).select(F.col(rest[0]).alias("text"))
    return x.where("text is not null and text <> ''")


def read_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def merge_first(frames: list[DataFrame], key: list[str], order: list[str]) -> DataFrame:
    """Union of tables with one row a key, that with the smallest order: the first kept, later ones ignored."""
    x = union_shapes(*frames)
    rest = [c for c in x.columns if c not in key and c not in order]
    g = x.groupBy(*key).agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_r"))
    return g.select(*key, "_r.*").select(*x.columns)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with the fields in order of their names."""
    df.select(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])).alias("value")).write.mode("errorifexists").text(path)


def write_shards(df: DataFrame, path: str, key: str, shards: int) -> DataFrame:
    """Parquet partitioned into shards by a hash of the key; gives the manifest: shard, n_rows, checksum (over the rows in order of the key)."""
    x = df.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int"))
    x.repartition("shard").write.mode("errorifexists").partitionBy("shard").parquet(path)
    # a sum of row hashes doesn't depend on the order, so no shard's rows are gathered
    row = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return x.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum(row).alias("checksum"))


def verify_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """name, ok: files of a manifest (name, size, sha256) that are there with that size and hash."""
    f = read_binary(spark, path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("_n"), F.sha2("content", 256).alias("_h"))
    return manifest.join(f, "name", "left").select("name", F.coalesce((F.col("size") == F.col("_n")) & (F.col("sha256") == F.col("_h")), F.lit(False)).alias("ok"))


def prometheus(df: DataFrame, metric: str, labels: list[str], value: str) -> DataFrame:
    """Counters as lines of text: metric{label="value"} n."""
    parts = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"')) for c in labels])
    return df.select(F.concat(F.lit(metric + "{"), parts, F.lit("} "), F.col(value).cast("string")).alias("line"))


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, parts: int = 8) -> DataFrame:
    """A table of an SQLite file that all executors can read, in ranges of its row numbers: no task reads all of it. schema: the columns to read."""
    import sqlite3

    names = T._parse_datatype_string(schema).fieldNames()
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
        low, high = c.execute(f'select coalesce(min(rowid), 0), coalesce(max(rowid), -1) from "{table}"').fetchone()
    width = max(1, -(-(high - low + 1) // parts))
    ranges = spark.createDataFrame([(i, min(i + width - 1, high)) for i in range(low, high + 1, width)], "low long, high long").repartition(parts)

    def run(batches):
        import pandas as pd

        for b in batches:
            for lo, hi in zip(b["low"], b["high"], strict=True):
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
                    cols = ", ".join(f'"{n}"' for n in names)
                    yield pd.DataFrame(c.execute(f'select {cols} from "{table}" where rowid between ? and ?', (int(lo), int(hi))).fetchall(), columns=names)

    return ranges.mapInPandas(run, schema)


def read_rotated(spark: SparkSession, folder: str, schema: str, pattern: str = "audit*.jsonl") -> DataFrame:
    """Entries of rotated logs with `file_no`, by which older files come first (rotated ones by their names, the one in use last), and their place in the file's text. Malformed lines are left out."""
    x = spark.read.option("pathGlobFilter", pattern).text(folder).select("value", F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("line"))
    files = sorted((r[0] for r in x.select("f").distinct().collect()), key=lambda f: (f.count(".") < 2, f))
    number = F.create_map(*[F.lit(y) for i, f in enumerate(files) for y in (f, i)]) if files else F.lit(None)
    y = x.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), (number[F.col("f")] if files else F.lit(0)).alias("file_no"), "at", "line").where("r is not null")
    return y.select("file_no", "at", "line", "r.*")


def data_uris(text):
    """What data URIs in a text carry: array of struct kind, content (base-64 or percent-coded); what can't be decoded is left out."""
    found = F.regexp_extract_all(text, F.lit(r"data:([a-zA-Z0-9.+/-]*(?:;[a-zA-Z0-9=.-]+)*),([A-Za-z0-9+/=%_.~-]+)"), F.lit(0))

    def one(x):
        head, body = F.regexp_extract(x, r"^data:([^,]*),", 1), F.regexp_extract(x, r"^data:[^,]*,(.*)$", 1)
        coded = head.endswith(";base64")
        return F.struct(F.regexp_replace(head, ";.*$", "").alias("kind"), F.when(coded, F.decode(F.try_to_binary(body, F.lit("base64")), "UTF-8")).otherwise(F.try_url_decode(body)).alias("content"))

    return F.filter(F.transform(found, one), lambda y: y["content"].isNotNull())


def phrase_list(df: DataFrame, text: str, least: int = 10) -> DataFrame:
    """Phrases in lower case with single blanks, each once; shorter ones than `least` signs and single words are left out."""
    p = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    return df.select(p.alias("phrase")).where((F.length("phrase") >= least) & F.col("phrase").contains(" ")).distinct()


def markdown(df: DataFrame, rows: int = 1000) -> str:
    """A small report table as Markdown; more than `rows` rows are an error, as a report isn't a copy of a table."""
    got = df.limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"a report has at most {rows} rows")
    line = lambda x: "| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in x) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, got)])
