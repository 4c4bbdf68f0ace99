"""Taint of values: where they come from and who may read them, carried as columns beside them.

A value's taint is a struct of sources (array of labels, kept distinct and sorted) and readers (array of names; empty: anybody). What a function of values gives carries the taint of all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.policy import FLOW, flow_decision

NOBODY = "<nobody>"
# Decisions from harmless to grave.
GRAVITY = {"allow": 0, "quarantine": 1, "ask_user": 2, "deny": 3}


def taint(sources: Column, readers: Column) -> Column:
    return F.struct(F.array_sort(F.array_distinct(F.coalesce(sources, F.array().cast("array<string>")))).alias("sources"), F.array_sort(F.array_distinct(F.coalesce(readers, F.array().cast("array<string>")))).alias("readers"))


def _common(a: Column, b: Column) -> Column:
    """Readers of both; where both are restricted and share none, nobody (an empty list would mean anybody)."""
    both = F.array_intersect(a, b)
    return F.when(F.size(a) == 0, b).when(F.size(b) == 0, a).when(F.size(both) == 0, F.array(F.lit(NOBODY))).otherwise(both)


def propagated(*inputs: Column) -> Column:
    """The taint of a value made of these: all sources, common readers."""
    return taint(F.flatten(F.array(*[x["sources"] for x in inputs])), reduce(_common, [x["readers"] for x in inputs]))


def of_items(items: Column) -> Column:
    """The taint of a container of tainted values (an array of their taints)."""
    none = F.array().cast("array<string>")
    return taint(F.flatten(F.transform(items, lambda x: x["sources"])), F.aggregate(F.transform(items, lambda x: x["readers"]), none, _common))


def mapped(value: Column, own: Column, f) -> Column:
    """A value and its taint (struct value, taint) after a function of the value alone, such as an encoding or a change of case: the taint stays."""
    return F.struct(f(value).alias("value"), own.alias("taint"))


def joined(values: Column, separator: str) -> Column:
    """Tainted values (array of struct value, taint) as one, with the taint of all."""
    return F.struct(F.array_join(F.transform(values, lambda x: x["value"]), separator).alias("value"), of_items(F.transform(values, lambda x: x["taint"])).alias("taint"))


def split(tainted: Column, pattern: str) -> Column:
    """Parts of a tainted value, each with its taint."""
    return F.transform(F.split(tainted["value"], pattern), lambda x: F.struct(x.alias("value"), tainted["taint"].alias("taint")))


def worst_flow(tool: Column, labels_of_args: Column) -> Column:
    """The gravest decision of all arguments' flows into a tool; labels_of_args: an array of arrays of labels. Without arguments: allow."""
    each = F.transform(labels_of_args, lambda x: flow_decision(x, tool, FLOW))
    rank = F.create_map(*[F.lit(y) for kv in GRAVITY.items() for y in kv])
    top = F.array_max(F.transform(each, lambda x: F.struct(rank[x].alias("g"), x.alias("d"))))
    return F.coalesce(top["d"], F.lit("allow"))


def grouped(df: DataFrame, key: str, own: str) -> DataFrame:
    """key, taint of all values of the key (column `own`). Readers of a group are those of each restricted value, found by counting, so that a large group isn't gathered; nobody if there is none."""
    r = df.select(key, F.col(own)["sources"].alias("s"), F.col(own)["readers"].alias("r"))
    s = r.select(key, F.explode_outer("s").alias("x")).groupBy(key).agg(F.array_sort(F.collect_set("x")).alias("sources"))
    n = r.groupBy(key).agg(F.sum(F.when(F.size("r") > 0, 1).otherwise(0)).alias("n"))
    k = r.select(key, F.explode(F.array_distinct("r")).alias("x")).groupBy(key, "x").agg(F.count("*").alias("k"))
    all_ = k.join(n, key).where("k = n").groupBy(key).agg(F.array_sort(F.collect_set("x")).alias("readers"))
    out = s.join(n, key).join(all_, key, "left")
    readers = F.when(F.col("n") == 0, F.array().cast("array<string>")).otherwise(F.coalesce("readers", F.array(F.lit(NOBODY))))
    return out.select(key, "sources", readers.alias("readers"))
