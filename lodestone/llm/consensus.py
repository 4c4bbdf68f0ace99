"""Problem 3: consensus of several annotators' labels by a community confusion model.

Annotators belong to a few types, each with a confusion matrix shared by its annotators. Variational updates alternate between the items' class
posteriors (computed where the items are, one pass without a shuffle beyond annotators x classes x labels sums) and, on the driver, the types'
matrices, the annotators' type responsibilities and each annotator's own matrix, whose prior is that of its types. An annotator with
few labels is thus judged as its type is, one with many by its own record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import stored


def digamma(x: np.ndarray) -> np.ndarray:
    x, out = np.maximum(np.array(x, float), 1e-300), 0.0
    for _ in range(8):  # shift upwards, then the asymptotic series
        out, x = out - 1 / x, x + 1
    i = 1 / x**2
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i / 240)))


def _expected_log(a: np.ndarray) -> np.ndarray:
    return digamma(a) - digamma(a.sum(-1, keepdims=True))


def _flat(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    col = batch.column(i)
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(col.offsets.to_numpy())


def _posterior(codes: np.ndarray, counts: np.ndarray, logp: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Class posteriors of items; logp: [annotator and label, class]. Every item has a label."""
    s = np.add.reduceat(logp[codes], np.cumsum(counts) - counts) + prior
    s = np.exp(s - s.max(1, keepdims=True))
    return s / s.sum(1, keepdims=True)


def _counted(codes: np.ndarray, counts: np.ndarray, q: np.ndarray, size: int) -> np.ndarray:
    """Sums of posteriors by annotator and label, and over all items, flat."""
    k = q.shape[1]
    w = np.repeat(q, counts, axis=0)
    return np.concatenate([np.stack([np.bincount(codes, w[:, j], size) for j in range(k)], 1).ravel(), q.sum(0)])


class Community:
    """The fitted model. matrix[w, k, c]: how probably annotator w gives label c to an item of class k."""

    def __init__(self, workers: list[str], classes: list[str], types: int = 3, strength: float = 10.0, weight: float = 100.0):
        """strength: labels that an annotator's types weigh against its own record. weight: labels that an annotator's record weighs at most in its types' matrices and in telling its
        types, so that a type is its annotators' and not the busiest one's; its own matrix is made of all its labels."""
        self.workers, self.classes, self.types, self.strength, self.weight = workers, classes, types, strength, weight
        n, k = len(workers), len(classes)
        # types start out from reliable to unreliable
        right = np.linspace(0.9, 1 / max(k, 1) + 0.1, types)
        self.shared = np.stack([np.where(np.eye(k, dtype=bool), r, (1 - r) / max(k - 1, 1)) for r in right]) * 20
        self.resp = np.full((n, types), 1 / types)
        self.kappa = np.ones(k)
        self.own = np.tile((self.shared / 20).mean(0), (n, 1, 1)) * strength
        self.counts = np.zeros((n, k, k))

    def parameters(self) -> tuple[np.ndarray, np.ndarray]:
        n, k = len(self.workers), len(self.classes)
        return _expected_log(self.own).transpose(0, 2, 1).reshape(n * k, k), _expected_log(self.kappa)

    def update(self, flat: np.ndarray) -> float:
        """New parameters from the counts of one pass; the largest relative change of an annotator's counts."""
        n, k = len(self.workers), len(self.classes)
        counts = flat[: n * k * k].reshape(n, k, k).transpose(0, 2, 1)
        change = np.abs(counts - self.counts).sum((1, 2)) / np.maximum(counts.sum((1, 2)), 1)
        self.counts, self.kappa = counts, 1 + flat[n * k * k :]
        for _ in range(5):
            e = _expected_log(self.shared)
            weight = np.log((1 + self.resp.sum(0)) / (self.types + n))
            scale = np.minimum(1, self.weight / np.maximum(counts.sum((1, 2)), 1))[:, None]
            s = weight + scale * np.einsum("wkc,tkc->wt", counts, e)
            s = np.exp(s - s.max(1, keepdims=True))
            self.resp = s / s.sum(1, keepdims=True)
            self.shared = np.stack([1 + 2.0 * np.eye(k)] * self.types) + np.einsum("wt,wkc->tkc", self.resp * scale, counts)
        mean = self.shared / self.shared.sum(-1, keepdims=True)
        self.own = self.strength * np.einsum("wt,tkc->wkc", self.resp, mean) + counts
        return float(change.max(initial=0))

    @property
    def matrix(self) -> np.ndarray:
        return self.own / self.own.sum(-1, keepdims=True)

    def reliability(self) -> np.ndarray:
        """The expected share of right labels, over the classes' shares."""
        return np.einsum("k,wkk->w", self.kappa / self.kappa.sum(), self.matrix)


def latest_labels(df: DataFrame, item: Column, worker: Column, label: Column, when: Column, tie: Column) -> DataFrame:
    """One label for each item and worker: the latest (of equal times the one with the larger tie). Nulls of any of the three aren't labels."""
    x = df.select(item.alias("item"), worker.alias("worker"), label.alias("label"), F.struct(when.alias("t"), tie.alias("n")).alias("at"))
    return x.where("item is not null and worker is not null and label is not null").groupBy("item", "worker").agg(F.max_by("label", "at").alias("label"))


def fit(labels: DataFrame, types: int = 3, iterations: int = 30, tolerance: float = 1e-3, weight: float = 100.0) -> tuple[Community, DataFrame]:
    """The model, and the items with their labels as arrays of codes. labels: item, worker, label, one row each item and worker.

    The annotators' and the classes' names are read to the driver, as they are the model's parameters; an item's array holds one code
    for each annotator of it. An empty table gives a model without annotators.
    """
    labels = stored(labels, "labels")
    classes = sorted(r[0] for r in labels.select("label").distinct().collect())
    workers = sorted(r[0] for r in labels.select("worker").distinct().collect())
    k = max(1, len(classes))
    code = F.expr("array_position(cs, label) - 1").cast("int")
    names = labels.sparkSession.createDataFrame([(w, i) for i, w in enumerate(workers)], "worker string, w int")
    coded = labels.join(F.broadcast(names), "worker").withColumn("cs", F.array(*map(F.lit, classes)) if classes else F.array(F.lit(""))).select("item", (F.col("w") * k + code).alias("code"))
    items = stored(coded.groupBy("item").agg(F.sort_array(F.collect_list("code")).alias("codes")), "items")
    model = Community(workers, classes, types, weight=weight)
    n = len(workers) * k
    for i in range(iterations if workers else 0):
        start = None if i == 0 else model.parameters()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(n * k + k)
            for b in batches:
                if b.num_rows:
                    codes, counts = _flat(b, 0)
                    if start is None:  # at first each item's classes have the shares of its labels
                        first = np.cumsum(counts) - counts
                        q = np.add.reduceat(np.eye(k)[codes % k], first) / counts[:, None]
                    else:
                        q = _posterior(codes, counts, *start)
                    total += _counted(codes, counts, q, n)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["i", "v"])

        sums = items.select("codes").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        flat = np.zeros(n * k + k)
        for r in sums:
            flat[r["i"]] = r["v"]
        if model.update(flat) < tolerance:
            break
    return model, items


def consensus(model: Community, items: DataFrame) -> DataFrame:
    """item, label (of equals the first in the classes' order), confidence, agreement (share of labels equal to it), pair_agreement (share of pairs of
    labels that agree; null of a single label), n_labels."""
    logp, prior = model.parameters()
    k, classes = len(model.classes), model.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes, counts = _flat(b, 1)
                q = _posterior(codes, counts, logp, prior)
                best = q.argmax(1)
                per = np.add.reduceat(np.eye(k)[codes % k], np.cumsum(counts) - counts)
                at = np.arange(len(best))
                pairs = np.where(counts > 1, (per * (per - 1)).sum(1) / np.maximum(counts * (counts - 1), 1), np.nan)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([classes[j] for j in best], pa.string()), pa.array(q[at, best]), pa.array(per[at, best] / counts), pa.array(pairs, from_pandas=True), pa.array(counts.astype(np.int32))],
                    ["item", "label", "confidence", "agreement", "pair_agreement", "n_labels"])

    return items.select("item", "codes").mapInArrow(run, "item string, label string, confidence double, agreement double, pair_agreement double, n_labels int")


def reliabilities(model: Community, df: DataFrame) -> DataFrame:
    """worker, reliability, type (the likeliest, 0 the most reliable to start with), n_labels."""
    rows = [(w, float(r), int(t), float(c)) for w, r, t, c in zip(model.workers, model.reliability(), model.resp.argmax(1), model.counts.sum((1, 2)), strict=True)]
    return df.sparkSession.createDataFrame(rows, "worker string, reliability double, type int, n_labels double").withColumn("n_labels", F.round("n_labels").cast("long"))
