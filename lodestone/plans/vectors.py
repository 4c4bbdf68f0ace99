"""Embeddings: neighbours, centroids, clusters; learned scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import vectors
from lodestone.plans.registry import query, table
from lodestone.plans.trials import valid_rows

_COS = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"


@query(f"""with e as (select vec_id, embedding::double[] as v from embeddings), s as (select a.vec_id as query, b.vec_id as neighbour, round({_COS}, 9) as s from e a join e b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id),
    r as (select *, row_number() over (partition by query order by s desc, neighbour) as rank from s) select query, neighbour, rank::int as rank, round(s, 6) as score from r where rank <= 5""")
def embedding_topk(spark: SparkSession, d: str) -> DataFrame:
    """Every twentieth vector against all."""
    e = table(spark, d, "embeddings")
    return vectors.top_k(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 5)


_CENT = """x as (select label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as dim from embeddings), m as (select label, dim, avg(v) as m from x group by 1, 2), c as (select label, dim, round(m / sqrt(sum(m * m) over (partition by label)), 6) as mean from m)"""


@query(f"with {_CENT} select label, dim::int as dim, mean from c")
def embedding_centroid(spark: SparkSession, d: str) -> DataFrame:
    return vectors.centroids(table(spark, d, "embeddings"), "label", "embedding")


@query(f"""with {_CENT}, l as (select label, array_agg(mean order by dim) as v from c group by label), e as (select vec_id, label, embedding::double[] as v from embeddings),
    s as (select a.vec_id, a.label as given, b.label as nearest, round({_COS}, 6) as score from e a, l b), r as (select *, row_number() over (partition by vec_id order by score desc, nearest) as rn from s)
    select vec_id, given, nearest, score from r where rn = 1""")
def embedding_nearest_label(spark: SparkSession, d: str) -> DataFrame:
    return vectors.nearest_centroid(table(spark, d, "embeddings"), "vec_id", "label", "embedding")


@query()
def effect_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Attacks by their strongest outcome under each model, clustered."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    level = F.when(F.col("outcome") == "compliance", 1.0).when(F.col("outcome") == "partial", 0.5).otherwise(0.0)
    names = [r["model"] for r in table(spark, d, "models").orderBy("model").collect()]
    m = valid_rows(spark, d).groupBy("attack_id").pivot("model", names).agg(F.max(level)).fillna(0.0)
    cols = [f"m{i}" for i in range(len(names))]
    x = VectorAssembler(inputCols=cols, outputCol="features").transform(m.withColumnsRenamed(dict(zip(names, cols, strict=True))))
    return KMeans(k=4, seed=0, maxIter=20).fit(x).transform(x).select("attack_id", F.col("prediction").alias("cluster"))


@query()
def classifier_scores(spark: SparkSession, d: str) -> DataFrame:
    """A balanced, regularised logistic regression on hashed character triples: attack or clean."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array

    chars = F.split(F.lower("text"), "")
    grams = F.flatten(F.transform(F.array(chars), lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - 2, F.lit(1))), lambda i: F.array_join(F.slice(c, i, 3), ""))))
    x = table(spark, d, "attack_samples").where("text is not null").select("sample_no", F.when(F.lower(F.trim("label")) == "clean", 0.0).otherwise(1.0).alias("y"), grams.alias("g"))
    share = x.agg(F.avg("y")).first()[0] or 0.0
    x = x.withColumn("w", F.when(F.col("y") == 1.0, 1 - share).otherwise(share))
    x = HashingTF(inputCol="g", outputCol="features", numFeatures=4096).transform(x).select("sample_no", "y", "w", "features")
    fit = LogisticRegression(labelCol="y", weightCol="w", regParam=0.01, maxIter=20).fit(x)
    return fit.transform(x).select("sample_no", "y", F.round(vector_to_array("probability")[1], 6).alias("score"))


@query("""with e as (select vec_id, label, embedding::double[] as v from embeddings), s as (select a.vec_id, max(round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6)) as score from e a join e b on a.vec_id % 20 = 0 and b.label = 0 and a.vec_id <> b.vec_id group by 1)
    select vec_id, score, score >= 0.3 as matched from s""")
def exemplar_match(spark: SparkSession, d: str) -> DataFrame:
    """The best likeness of each query to the exemplars of one label."""
    e = table(spark, d, "embeddings")
    t = vectors.top_k(e.where("vec_id % 20 = 0"), e.where("label = 0"), "vec_id", "embedding", 1)
    return t.select(F.col("query").alias("vec_id"), "score", (F.col("score") >= 0.3).alias("matched"))


@query()
def embedding_distances(spark: SparkSession, d: str) -> DataFrame:
    """How far each vector is from its label's mean, by the pooled covariance."""
    return vectors.mahalanobis(table(spark, d, "embeddings"), "vec_id", "label", "embedding").withColumn("distance", F.round("distance", 6))
