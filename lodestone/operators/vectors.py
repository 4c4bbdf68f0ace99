"""Nearest neighbours, centroids and clusters of embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either is all zeros."""
    return F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def top_k(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int, least: float = -1.0, block: int = 2048, rows: int = 20_000) -> DataFrame:
    """query, neighbour, rank, score: the k rows of base most alike by cosine to each query (itself excluded), of equals the smaller key, at least `least` alike.

    Exact, in blocks: about `block` queries meet about `rows` rows of base in one matrix product, so a task's memory doesn't depend on the tables; it keeps
    its own k best of each query, and only these are shuffled on. Each block of queries goes to each part of base and the other way round; neither side is
    collected or broadcast.
    """
    import numpy as np
    import pandas as pd

    kind = base.schema[key].dataType.simpleString()
    n = max(1, -(-queries.count() // block))
    q = queries.select(F.col(key).alias("q"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("b"))
    parts = max(1, -(-base.count() // rows))
    x = base.select(F.col(key).alias("q"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("p"))
    left = q.select("q", "v", "b", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"))
    right = x.select("q", "v", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("b"), "p")

    def unit(v) -> np.ndarray:
        m = np.stack([np.asarray(y, np.float64) for y in v])
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            s = np.round(unit(a["v"]) @ unit(b["v"]).T, 9)
            ids = b["q"].to_numpy()
            for i, own in enumerate(a["q"]):
                order = np.lexsort((ids, -s[i]))[: k + 1]
                out += [(own, ids[j], s[i, j]) for j in order if ids[j] != own and s[i, j] >= least][:k]
        return pd.DataFrame(out, columns=["query", "neighbour", "score"])

    got = left.groupBy("b", "p").cogroup(right.groupBy("b", "p")).applyInPandas(best, f"query {kind}, neighbour {kind}, score double")
    w = F.sort_array(F.collect_list(F.struct(-F.col("score"), "neighbour")))
    top = got.groupBy("query").agg(F.slice(w, 1, k).alias("t"))
    return top.select("query", F.posexplode("t").alias("rank", "x")).select("query", F.col("x.neighbour").alias("neighbour"), (F.col("rank") + 1).alias("rank"), F.round(-F.col("x.col1"), 6).alias("score"))


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """label, dim, mean: the mean vector of each label, scaled to length 1, in long form. Summed by (label, dimension), so nothing is collected."""
    x = df.select(label, F.posexplode(vector).alias("dim", "x")).groupBy(label, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    n = x.groupBy(label).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("n"))
    return x.join(n, label).select(label, "dim", F.round(F.coalesce(F.col("m") / F.nullif("n", F.lit(0.0)), F.lit(0.0)), 6).alias("mean"))


def nearest_centroid(df: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """key, given, nearest, score: the label whose centroid is most alike. Labels are a vocabulary, so their centroids are small and are sent as one array."""
    c = centroids(df, label, vector).groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "mean"))), lambda y: y["mean"]).alias("c"))
    all_ = c.agg(F.collect_list(F.struct(F.col(label).alias("label"), "c")).alias("all"))
    x = df.select(key, F.col(label).alias("given"), F.col(vector).alias("v")).join(F.broadcast(all_))
    scored = F.transform("all", lambda y: F.struct(F.round(cosine(F.col("v"), y["c"]), 6).alias("score"), (-y["label"]).alias("neg")))
    best = x.select(key, "given", F.array_max(scored).alias("m"))
    return best.select(key, "given", (-F.col("m.neg")).alias("nearest"), F.col("m.score").alias("score"))


def mahalanobis(df: DataFrame, key: str, label: str, vector: str, ridge: float = 1e-6) -> DataFrame:
    """key, distance of each vector to its label's mean, in the metric of the pooled covariance. Only sums (dimensions squared) and one mean a label are on the driver. Null vectors are left out."""
    import numpy as np
    import pandas as pd

    x = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull())
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def sums(batches):
        n, total, square = {}, {}, None
        for b in batches:
            if len(b):
                m = np.stack([np.asarray(v, float) for v in b[vector]])
                square = m.T @ m + (0 if square is None else square)
                for k in b[label].unique():
                    own = m[(b[label] == k).to_numpy()]
                    n[k], total[k] = n.get(k, 0) + len(own), total.get(k, 0) + own.sum(0)
        if square is not None:
            yield pd.DataFrame({"label": [str(k) for k in n], "n": list(n.values()), "s": [v.tolist() for v in total.values()], "q": [square.ravel().tolist()] + [None] * (len(n) - 1)})

    n, total, square = {}, {}, 0.0
    for r in x.select(label, vector).mapInPandas(sums, "label string, n long, s array<double>, q array<double>").collect():
        n[r["label"]], total[r["label"]] = n.get(r["label"], 0) + r["n"], total.get(r["label"], 0) + np.array(r["s"])
        square = square + (np.array(r["q"]) if r["q"] is not None else 0.0)
    mean = {k: total[k] / n[k] for k in n}
    if n:
        d = len(next(iter(mean.values())))
        cov = (np.array(square).reshape(d, d) - sum(n[k] * np.outer(mean[k], mean[k]) for k in n)) / max(sum(n.values()) - len(n), 1)
        inverse = np.linalg.inv(cov + ridge * np.eye(d))

    def away(batches):
        for b in batches:
            delta = np.stack([np.asarray(v, float) - mean[str(k)] for v, k in zip(b[vector], b[label], strict=True)]) if len(b) else None
            yield pd.DataFrame({key: b[key], "distance": np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", delta, inverse, delta), 0)) if len(b) else []})

    return x.select(key, label, vector).mapInPandas(away, f"`{key}` {kinds[key]}, distance double")
