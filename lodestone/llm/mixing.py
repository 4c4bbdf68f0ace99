"""Problem 9: a mixture of sources with given shares of all tokens, by iterative proportional fitting."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestone.llm import subjects, tokens
from lodestone.llm.common import present, stored
from lodestone.llm.language import LanguageModel

#: Parts of about equal numbers of documents into which a source's order is cut.
BUCKETS = 256
Cell = tuple[str, str, str]


def source_key(c: Column) -> Column:
    """A source in any spelling: case, outer blanks, and blanks or hyphens for underscores don't matter."""
    return F.regexp_replace(present(c), r"[\s-]+", "_")


def profiled(docs: DataFrame, key: str, text: str, language: LanguageModel, subject: subjects.SubjectModel, ranks: str = tokens.RANKS) -> DataFrame:
    """docs but the text, with tokens, language (that of most of its characters) and topic (the subject of most of its sentences), all from one reading of the text. A null or
    empty text has 0 tokens, no language and no topic."""
    name, kept = tokens.sent(ranks), [c for c in docs.columns if c != text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields] + ["tokens int", "language string", "topic string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                texts = part.column(part.num_columns - 1).to_pylist()
                own = [subjects.paragraphs(t) for t in texts]
                lang: list[str | None] = []
                for s in language.split_texts([[x for p in t for x in p] for t in own]):
                    size: dict[str, int] = defaultdict(int)
                    for x in s:
                        if x[0]:
                            size[x[0]] += x[3]
                    lang.append(max(size, key=lambda k: (size[k], k), default=None))
                topic = [max(t, key=lambda k: (t[k], k), default=None) for t in subject.paragraphs(own)]
                cols = [part.column(i) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(tokens.counted(texts, name), pa.int32()), pa.array(lang, pa.string()), pa.array(topic, pa.string())], [*kept, "tokens", "language", "topic"])

    return docs.select(*kept, text).mapInArrow(run, schema)


def _scaled(cells: list[Cell], tokens: dict[Cell, float], weight: dict[Cell, float], want: float, most: float) -> None:
    """Weights of these cells times one factor, each at most `most`, so that they make up `want` tokens if they can."""
    for _ in range(60):
        loose = [c for c in cells if weight[c] < most]
        fixed = sum(tokens[c] * most for c in cells if weight[c] >= most)
        now = sum(tokens[c] * weight[c] for c in loose)
        if not loose or not now:
            return
        f = max(0.0, want - fixed) / now
        for c in loose:
            weight[c] = min(most, weight[c] * f)
        if all(weight[c] < most for c in loose):
            return


def rake(tokens: dict[Cell, float], shares: dict[str, float], repeats: dict[str, int], total: float | None = None, rounds: int = 50) -> tuple[dict[Cell, float], float]:
    """The expected uses of each cell's tokens, and the size of the mixture.

    tokens: by (source, language, topic). The size is as asked, or the largest that the repeat limits let all sources reach. The margins of
    language and topic are those of the listed sources' tokens; each round ends with the sources' margin, which is thus kept exactly.
    """
    cells = [c for c in tokens if c[0] in shares and tokens[c] > 0]
    of: dict[int, dict[str, list[Cell]]] = {i: defaultdict(list) for i in range(3)}
    for c in cells:
        for i in range(3):
            of[i][c[i]].append(c)
    have = {s: sum(tokens[c] for c in x) for s, x in of[0].items()}
    reach = min((have.get(s, 0) * repeats[s] / w for s, w in shares.items() if w > 0 and have.get(s)), default=0.0)
    size = min(reach, total) if total else reach
    everything = sum(have.values())
    weight = {c: min(repeats[c[0]], shares[c[0]] * size / have[c[0]]) for c in cells}
    for _ in range(rounds):
        before = dict(weight)
        for i in (1, 2):
            for x in of[i].values():
                now = sum(tokens[c] * weight[c] for c in x)
                want = size * sum(tokens[c] for c in x) / everything
                for c in x:
                    weight[c] = min(repeats[c[0]], weight[c] * want / now) if now else weight[c]
        for s, x in of[0].items():
            _scaled(x, tokens, weight, shares[s] * size, repeats[s])
        if max((abs(weight[c] - before[c]) for c in cells), default=0) < 1e-6:
            break
    return weight, size


def mixed(docs: DataFrame, shares: dict[str, float], repeats: dict[str, int], total: float | None = None) -> DataFrame:
    """docs (item, source, language, topic, tokens) of the listed sources with `weight` and `uses`.

    A document is used as often as its cell's weight says: the whole part for certain. Whether once more is drawn with the rest as probability: first for documents
    of at least a fiftieth of what their source still needs, each by its own hash; then, by order sampling, the others of the source are taken in the order
    of their hash over their odds until the need is met. A source's tokens are thus met to about half a document's. Only the part of a source's order in which the need is met, one of about
    BUCKETS equally long ones, is put in order. Cells (sources x languages x topics) and the parts' sums are read to the driver, documents aren't. Documents without tokens are never used.
    """
    spark = docs.sparkSession
    listed = sorted(shares)
    names = ["source", "language", "topic"]
    d = docs.select("item", "source", *[F.coalesce(c, F.lit("")).alias(c) for c in names[1:]], "tokens").where(F.col("source").isin(listed))
    d = stored(d, "docs")
    tokens = {tuple(r[x] for x in names): float(r["n"]) for r in d.groupBy(*names).agg(F.sum("tokens").alias("n")).collect()}
    weight, _ = rake(tokens, shares, repeats, total)
    cells = spark.createDataFrame([(*c, float(w)) for c, w in weight.items()], "source string, language string, topic string, weight double")
    x = d.join(F.broadcast(cells), names, "left").withColumn("weight", F.round(F.when(F.col("tokens") > 0, F.coalesce("weight", F.lit(0.0))).otherwise(0.0), 9))
    u = (F.xxhash64(F.lit("mix"), "item").cast("double") / 2.0**64 + 0.5).alias("u")
    x = stored(x.select("*", u, (F.col("weight") - F.floor("weight")).alias("part")), "weighted")
    need = x.groupBy("source").agg(F.sum(F.col("part") * F.col("tokens")).alias("need"))
    x = x.join(F.broadcast(need), "source").withColumn("large", F.col("tokens") >= 0.02 * F.col("need"))
    got = x.where("large and u < part").groupBy("source").agg(F.sum("tokens").alias("got"))
    odds = F.col("u") / (1 - F.col("u")) * (1 - F.col("part")) / F.col("part")
    small = stored(x.where("part > 0 and not large").withColumn("place", odds / (1 + odds)), "small")
    # places crowd where weights are small, so a source's parts are cut at quantiles
    cuts = small.groupBy("source").agg(F.percentile_approx("place", [i / BUCKETS for i in range(1, BUCKETS)], 10_000).alias("cuts"))
    small = small.join(F.broadcast(cuts), "source").withColumn("bucket", F.size(F.filter("cuts", lambda c: c < F.col("place")))).drop("cuts")
    wanted = {r["source"]: float(r["need"] or 0) - float(r["got"] or 0) for r in need.join(got, "source", "left").collect()}
    sums: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for r in small.groupBy("source", "bucket").agg(F.sum("tokens").alias("n")).collect():
        sums[r["source"]].append((r["bucket"], r["n"]))
    edge = []  # the part in which the need is met, and the tokens before it
    for s, own in sums.items():
        before = 0
        for bucket, n in sorted(own):
            if before + n > wanted[s]:
                edge.append((s, bucket, float(before), wanted[s]))
                break
            before += n
    small = small.join(F.broadcast(spark.createDataFrame(edge, "source string, edge int, before double, wanted double")), "source", "left")
    sorted_ = small.where("bucket = edge")
    run = F.sum("tokens").over(W.partitionBy("source").orderBy("place", "item").rowsBetween(W.unboundedPreceding, 0))
    sorted_ = sorted_.withColumn("fits", F.col("before") + run - F.col("tokens") / 2 <= F.col("wanted"))
    rest = small.where("edge is null or bucket <> edge").withColumn("fits", F.expr("edge is null or bucket < edge"))
    small, fits = sorted_.unionByName(rest), F.col("fits")
    more = small.select("item", *names, "tokens", "weight", fits.alias("once_more")).unionByName(
        x.where("part = 0 or large").select("item", *names, "tokens", "weight", (F.col("large") & (F.col("u") < F.col("part"))).alias("once_more")))
    return more.select("item", *names, "tokens", "weight", (F.floor("weight") + F.col("once_more").cast("int")).cast("int").alias("uses"))


def share_report(uses: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, actual_share, n_tokens (with repeats), n_documents used."""
    n = uses.where("uses > 0").groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).cast("long").alias("n_tokens"), F.count("*").alias("n_documents"))
    x = targets.select(source_key(F.col("source")).alias("source"), "target_share").join(n, "source", "left").fillna(0, ["n_tokens", "n_documents"])
    return x.withColumn("actual_share", F.coalesce(F.col("n_tokens") / F.nullif(F.sum("n_tokens").over(W.partitionBy()), F.lit(0)), F.lit(0.0)))
