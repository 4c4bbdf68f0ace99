"""Rules over calls: the matching rule of the highest priority decides.

A rule set is a small dimension; calls are reduced to their different combinations of what rules look at before rules meet them, and the decision is
joined back, so the theta join doesn't see the calls one by one.
"""

from __future__ import annotations

import re
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The 15 labels with their trust and risk.
LABELS = [
    ("user", "trusted", 0), ("system", "trusted", 0), ("tool_output", "conditional", 5), ("web_content", "untrusted", 8), ("file_content", "conditional", 5),
    ("memory", "conditional", 5), ("mcp", "untrusted", 8), ("mcp_tool_description", "untrusted", 9), ("mcp_tool_result", "untrusted", 8), ("mcp_resource", "untrusted", 8),
    ("mcp_prompt", "untrusted", 8), ("agent", "conditional", 4), ("agent_delegated", "conditional", 6), ("cross_session", "conditional", 6), ("unknown", "untrusted", 9),
]
UNTRUSTED = [x for x, t, _ in LABELS if t == "untrusted"]
UNMAPPED_RISK = 9
# Tools through which data takes effect.
SINKS = ["terminal", "send_message", "memory_write", "file_write", "http_request", "browser_navigate"]


class FlowRule(NamedTuple):
    labels: list[str]
    tools: list[str]  # "*" is any
    decision: str
    priority: int


FLOW = [
    FlowRule(["mcp", "mcp_tool_description", "mcp_tool_result"], ["skill_manage"], "deny", 110),
    FlowRule(["memory", "cross_session"], ["send_message"], "deny", 105),
    FlowRule(UNTRUSTED, SINKS, "deny", 100),
    FlowRule([*UNTRUSTED, "tool_output"], ["delegate_task"], "ask_user", 95),
    FlowRule(["tool_output", "file_content", "memory", "agent_delegated", "cross_session"], SINKS, "ask_user", 50),
    FlowRule(["agent"], SINKS, "quarantine", 25),
    FlowRule(["user", "system"], ["*"], "allow", 10),
]


def glob_regex(glob: str) -> str:
    """A glob (*, ?, sets as [ab], [a-z], [!ab]) as a pattern for whole strings; a bracket that isn't closed is itself."""
    out, i = "", 0
    while i < len(glob):
        c, end = glob[i], glob.find("]", i + 2 + (glob[i + 1 : i + 2] == "!"))
        if c == "[" and end > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else "\\" + inner if inner[0] == "^" else inner) + "]"
            i = end
        else:
            out += {"*": "(?s:.*)", "?": "(?s:.)"}.get(c, re.escape(c))
        i += 1
    return "^" + out + "$"


def flow_decision(labels: Column, tool: Column, rules: list[FlowRule] = FLOW, default: str = "ask_user") -> Column:
    """The decision for data with these labels into this tool. No label: allow. All labels trusted: what would be asked is allowed. Where no rule applies, the default holds, which asks."""
    trusted = F.array(*[F.lit(x) for x, t, _ in LABELS if t == "trusted"])
    first = F.lit(default)
    for r in sorted(rules, key=lambda r: r.priority):
        at = F.lit(True) if "*" in r.tools else tool.isin(r.tools)
        first = F.when(at & F.arrays_overlap(labels, F.array(*map(F.lit, r.labels))), r.decision).otherwise(first)
    clean = F.size(F.array_except(labels, trusted)) == 0
    return F.when(labels.isNull() | (F.size(labels) <= 0), "allow").when(clean & (first == "ask_user"), "allow").otherwise(first)


def risk_level(label: Column, trust: Column) -> Column:
    """0 of a trusted source, at least 7 of an untrusted one, else the label's risk; a label that isn't known has 9."""
    base = F.lit(UNMAPPED_RISK)
    for x, _, n in LABELS:
        base = F.when(label == x, n).otherwise(base)
    return F.when(trust == "trusted", 0).when(trust == "untrusted", F.greatest(base, F.lit(7))).otherwise(base)


class Chosen(NamedTuple):
    """A rule whose condition is a Column over the calls."""

    name: str
    priority: int
    action: str
    condition: Column


def chosen(rules: list[Chosen], default: str) -> list[Column]:
    """`action` and `rule` of the matching rule with the highest priority (of equals the first by name), else the default and null: one projection for a rule set that the driver has."""
    action, name = F.lit(default), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (r.priority, [-ord(c) for c in r.name])):
        action, name = F.when(r.condition, r.action).otherwise(action), F.when(r.condition, r.name).otherwise(name)
    return [action.alias("action"), name.alias("rule")]


def first_match(calls: DataFrame, rules: DataFrame, looked_at: list[str], condition: Column, default: str) -> DataFrame:
    """calls with `action` and `rule`: those of the matching rule with the highest priority (of equals the first by name), else the default and null.

    rules: name, priority, action, enabled and what `condition` uses. condition is any Column over both sides.
    """
    own = [f"_of_{c}" for c in looked_at]
    kinds = calls.select(*looked_at).distinct()
    hit = kinds.join(F.broadcast(rules.where("enabled")), condition).groupBy(*looked_at).agg(F.min(F.struct(-F.col("priority"), "name", "action")).alias("_m"))
    hit = hit.select(*[F.col(c).alias(o) for c, o in zip(looked_at, own, strict=True)], F.col("_m.action").alias("_action"), F.col("_m.name").alias("rule"))
    x = calls.join(hit, [F.col(c).eqNullSafe(F.col(o)) for c, o in zip(looked_at, own, strict=True)], "left")
    return x.withColumn("action", F.coalesce("_action", F.lit(default))).drop(*own, "_action")


# Commands that are harmless even with doubtful input, and git's subcommands that only read.
BENIGN = (
    "ls cat echo pwd cd pip pip3 npm npx yarn git head tail wc sort uniq grep find which whoami date env printenv uname df du free ps top htop file stat id hostname uptime python3 python node "
    "cargo rustc make cmake tree less more diff basename dirname realpath mkdir touch cp mv"
).split()
BENIGN_GIT = "status log diff show branch tag remote describe shortlog reflog config ls-files ls-tree".split()
_SEPARATOR, _SUBSTITUTION = r";|&&|\|\||\||\n|&", r"\$\(|\$\{|`|<\(|>\("
# Names of tools that run commands, and parts of such names.
COMMAND_SINKS = (
    "terminal bash shell sh zsh fish run_command run_terminal_cmd runcommand run_shell_command subprocess exec execute_command execute_bash command cmd powershell pwsh system os_system"
).split()
COMMAND_SINK_PARTS = "terminal shell bash subprocess powershell run_command".split()


def command_sink(tool: Column) -> Column:
    """Whether a tool runs commands; null and blank names don't."""
    t = F.lower(F.trim(tool))
    return F.coalesce(t.isin(COMMAND_SINKS) | t.rlike("|".join(COMMAND_SINK_PARTS)), F.lit(False))


def canonical_tool(tool: Column) -> Column:
    """All tools that run commands are `terminal`."""
    return F.when(command_sink(tool), "terminal").otherwise(tool)


def benign_command(c: Column) -> Column:
    """Whether every command between separators is harmless (settings of variables, sudo and paths before its name left out; of git's, subcommands that only read), and nothing
    is substituted. Null and empty are benign of nothing: false."""
    parts = F.filter(F.split(c, _SEPARATOR), lambda x: F.trim(x) != "")

    def words(x: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(F.trim(x), r"^(?:[^\s=]*=\S*\s+)+", ""), r"^sudo\s+", "")
        return F.split(F.trim(bare), r"\s+")

    def one(w: Column) -> Column:
        name = F.regexp_extract(F.translate(F.get(w, F.lit(0)), "\\", "/"), r"([^/]*)$", 1)
        git = F.coalesce(F.get(w, F.lit(1)).isin(BENIGN_GIT), F.lit(True))
        return name.isin(BENIGN) & ((name != "git") | git)

    return F.coalesce(F.forall(F.transform(parts, words), one) & (F.size(parts) > 0) & ~c.rlike(_SUBSTITUTION), F.lit(False))


def sliced(spans: Column, start: Column, stop: Column) -> Column:
    """Labels of a part of a text: spans (s, e, labels) that overlap [start, stop), cut to it and counted from its start."""
    inside = F.filter(spans, lambda x: (x["s"] < stop) & (x["e"] > start))
    return F.transform(inside, lambda x: F.struct((F.greatest(x["s"], start) - start).alias("s"), (F.least(x["e"], stop) - start).alias("e"), x["labels"].alias("labels")))


def concatenated(a: Column, length: Column, b: Column) -> Column:
    """Spans of a text of this length followed by another."""
    return F.concat(a, F.transform(b, lambda x: F.struct((x["s"] + length).alias("s"), (x["e"] + length).alias("e"), x["labels"].alias("labels"))))


def closure(edges: DataFrame, folder: str) -> DataFrame:
    """a, b, depth: all that can be reached over edges (a, b), with the least number of steps. Rounds go on until one brings no new pair; each is written
    to a table of its own under `folder`, so that no round works the earlier ones out again."""
    spark, at = edges.sparkSession, f"{folder}/closure-{uuid.uuid4().hex}"
    kind = edges.schema["a"].dataType.simpleString()

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{at}/{name}")
        return spark.read.schema(df.schema).parquet(f"{at}/{name}")

    e = kept(edges.select("a", F.col("b").cast(kind).alias("b")).where("a is not null and b is not null").distinct(), "edges")
    on = e.select(F.col("a").alias("b"), F.col("b").alias("c"))
    out = new = e.withColumn("depth", F.lit(1))
    depth = 1
    while not new.isEmpty():
        depth += 1
        step = new.join(on, "b").select("a", F.col("c").alias("b")).distinct()
        new = kept(step.join(out.select("a", "b"), ["a", "b"], "left_anti").withColumn("depth", F.lit(depth)), f"round-{depth}")
        out = out.unionByName(new)
    return out
