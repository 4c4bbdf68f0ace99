"""Problem 4: related records, and splits that keep them together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import stored
from lodestone.llm.packing import ranked
from lodestone.operators.fold import folded

SALTS = 16


def star_edges(df: DataFrame, key: str, links: list[Column]) -> DataFrame:
    """(u, v), u > v, that connect all rows which share a value of a link; nulls link nothing.

    Each row is tied to the smallest row of its value's part (a value's rows fall into 16 parts, so a value that a third of all rows
    have isn't one group), each part's smallest row to the value's. No group is collected.
    """
    x = df.select(F.col(key).alias("u"), F.explode(F.array(*[F.when(c.isNotNull(), F.xxhash64(F.lit(i), c)) for i, c in enumerate(links)])).alias("k")).where("k is not null")
    x = x.withColumn("salt", F.expr(f"pmod(xxhash64(u), {SALTS})").cast("int"))
    part = stored(x.groupBy("k", "salt").agg(F.min("u").alias("v"), F.count("*").alias("n")), "parts")
    low = x.join(part.where("n > 1").drop("n"), ["k", "salt"]).select("u", "v")
    top = part.groupBy("k").agg(F.min("v").alias("m"))
    return low.unionByName(part.join(top, "k").select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u > v").distinct()


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) of each node of an edge, by alternating large and small stars until nothing changes."""
    e = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v"), "edges")
    last = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = stored(large, "large")
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u")
        e = stored(small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u > v").distinct(), "edges")
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components didn't settle")
    # every node now hangs directly on its component's smallest
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def related(df: DataFrame, key: str, links: list[Column]) -> DataFrame:
    """node, component of the rows related to at least one other."""
    return connected(star_edges(df, key, links))


def _allotted(need: list[list[float]], i: int, vector: list[float], m: int) -> list[int]:
    """How many of m equal components each split gets if they go one by one to the split that needs label i most: needs are evened out from above."""
    k, v = len(need), vector[i]
    order = sorted(range(k), key=lambda s: (-need[s][i], -sum(need[s]), s))
    left, out = m, [0] * k
    # the level to which the first j splits' needs come down together
    for j in range(1, k + 1):
        top = [need[s][i] for s in order[:j]]
        floor = need[order[j]][i] if j < k else float("-inf")
        if j == k or (sum(top) - j * floor) / v >= m:
            level = (sum(top) - m * v) / j
            want = [max(0.0, (t - level) / v) for t in top]
            for s, w in zip(order[:j], want, strict=True):
                out[s] = min(int(w), left)
                left -= out[s]
            break
    # the last few, one by one
    for _ in range(left):
        s = max(range(k), key=lambda s: (need[s][i] - out[s] * v, sum(need[s]), -s))
        out[s] += 1
    return out


def grouped_splits(rows: DataFrame, targets: list[tuple[str, float]], vectors: int | None = None) -> DataFrame:
    """rows (key, component, label) with `split`: components stay whole, each split gets about its share of each label.

    Grouped iterative stratification over components' label vectors: of the outstanding labels the rarest comes first, and its components, the largest first, go to the split that
    needs most of it. Components with the same vector are alike, so the plan is made for vectors and numbers of components, and components take their places by their rank within
    the vector. Every vector is planned as it is, however many there are: they go by in order in one task, which keeps what the splits need; the driver gets sums by label only.
    A null label is a label; a column `split` that rows have is replaced. vectors has no effect; it was the number of vectors beyond which they were rounded.
    """
    rows = stored(rows.drop("split").withColumn("label", F.coalesce("label", F.lit(""))), "rows")
    names, shares = [t[0] for t in targets], [t[1] for t in targets]
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    labels = sorted(totals, key=lambda x: (totals[x], x))
    if not labels:
        return rows.withColumn("split", F.lit(None).cast("string"))
    span = range(len(labels))
    own = rows.groupBy("component").agg(F.array(*[F.sum(F.when(F.col("label") == x, 1).otherwise(0)) for x in labels]).alias("vector"))
    own = stored(own, "vectors")
    kinds = stored(own.groupBy("vector").agg(F.count("*").alias("m")), "kinds")
    # the labels in the order of their turns: what is outstanding after a turn is what components without that label and those before have
    turns, left, out = [], kinds, [totals[x] for x in labels]
    while any(out):
        i = min((i for i in span if out[i]), key=lambda i: (out[i], i))
        turns.append(i)
        left = left.where(F.col("vector")[i] == 0)
        out = [x or 0 for x in left.agg(*[F.sum(F.col("vector")[j] * F.col("m")) for j in span]).first()] if sum(map(bool, out)) > 1 else []
    need = [[s / sum(shares) * totals[x] for x in labels] for s in shares]

    def place(need: list[list[float]], turn: int, m: int, vector: list[int]) -> tuple:
        v = [float(x) for x in vector]
        n = _allotted(need, turns[turn], v, m)
        return [[a - k * b for a, b in zip(x, v, strict=True)] for x, k in zip(need, n, strict=True)], (vector, [sum(n[: s + 1]) for s in range(len(n))])

    turn = F.coalesce(*[F.when(F.col("vector")[i] > 0, F.lit(t)) for t, i in enumerate(turns)])
    plan = kinds.select("vector", "m", F.lit(0).alias("all"), turn.alias("turn"), F.aggregate("vector", F.lit(0).cast("long"), lambda a, x: a - x).alias("less"), F.xxhash64(*[F.col("vector")[i] for i in span]).alias("mixed"))
    ends = stored(folded(plan, "all", ["turn", "less", "mixed", "vector"], ["turn", "m", "vector"], lambda: need, place, "vector array<bigint>, ends array<bigint>").drop("all"), "ends")
    # a component's rank in its vector's places, which are mixed so that neighbours don't go to the same split for being neighbours
    where = ranked(own, "vector", F.struct(F.xxhash64(F.lit("split"), "component"), "component"))
    split = F.element_at(F.array(*map(F.lit, names)), F.size(F.filter("ends", lambda e: e <= F.col("rank"))) + 1)
    return rows.join(where.join(ends, "vector").select("component", split.alias("split")), "component")
