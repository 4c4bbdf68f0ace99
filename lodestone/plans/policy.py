"""Policy and provenance: events as calls, documents as data with an origin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import policy
from lodestone.plans.registry import query, shared_folder, table

_RULES = [("block_large_purchase", 300, "deny", True, "purchase", 50.0), ("ask_errors", 200, "ask", True, "err*", 0.0), ("log_signups", 200, "log", True, "sign*", 5.0), ("old_rule", 900, "deny", False, "*", 0.0), ("allow_views", 10, "allow", True, "view", 0.0)]
_SQL_RULES = "r(name, priority, action, enabled, shape, least) as (values " + ", ".join(f"('{a}', {b}, '{c}', {d}, '{e}', {f})" for a, b, c, d, e, f in _RULES) + ")"


@query(f"""with {_SQL_RULES}, m as (select e.event_id, r.name, r.action, row_number() over (partition by e.event_id order by r.priority desc, r.name) as rn from events e join r on r.enabled and e.event_type GLOB r.shape and e.value >= r.least)
    select e.event_id, coalesce(m.action, 'escalate') as action, m.name as rule from events e left join m on m.event_id = e.event_id and m.rn = 1""")
def policy_first_match(spark: SparkSession, d: str) -> DataFrame:
    """Rules as a chain of conditions in the order of their priority: one projection, no join."""
    own = [policy.Chosen(a, b, c, F.col("event_type").rlike(policy.glob_regex(e)) & (F.col("value") >= f)) for a, b, c, on, e, f in _RULES if on]
    return table(spark, d, "events").select("event_id", *policy.chosen(own, "escalate"))


_ORIGIN = """case origin when 'user_input' then 'user' when 'retrieved_web' then 'web_content' when 'mcp_tool_result' then 'mcp_tool_result' when 'mcp_tool_description' then 'mcp_tool_description'
    when 'prior_session_memory' then 'cross_session' when 'delegated_agent_output' then 'agent_delegated' else 'unknown' end"""


def _flow_sql() -> str:
    out = "case when label is null then 'allow'"
    for r in sorted(policy.FLOW, key=lambda r: -r.priority):
        at = "true" if "*" in r.tools else "tool in (" + ", ".join(f"'{t}'" for t in r.tools) + ")"
        decision = r.decision if r.decision != "ask_user" else "ask_user"
        out += f" when {at} and label in (" + ", ".join(f"'{x}'" for x in r.labels) + f") then '{decision}'"
    return out + " else 'ask_user' end"


@query(f"""with c as (select sample_no, {_ORIGIN} as label from attack_samples), t as (select sample_no, label, unnest(['terminal', 'delegate_task', 'skill_manage', 'send_message', 'search']) as tool from c)
    select label, tool, {_flow_sql()} as decision, count(*) as n from t group by 1, 2, 3""")
def flow_decisions(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "attack_samples").select(F.expr(_ORIGIN).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    t = c.select("label", "n", F.explode(F.array(*map(F.lit, ["terminal", "delegate_task", "skill_manage", "send_message", "search"]))).alias("tool"))
    return t.select("label", "tool", policy.flow_decision(F.array("label"), F.col("tool")).alias("decision"), "n")


@query(f"""with l(label, trust, risk) as (values {", ".join(f"('{a}', '{b}', {c})" for a, b, c in policy.LABELS)}), c as (select sample_no, {_ORIGIN} as label from attack_samples)
    select c.label, (case when l.trust = 'trusted' then 0 when l.trust = 'untrusted' then greatest(l.risk, 7) else coalesce(l.risk, 9) end)::int as risk, count(*) as n from c left join l using (label) group by 1, 2""")
def source_risk(spark: SparkSession, d: str) -> DataFrame:
    l = spark.createDataFrame([(a, b) for a, b, _ in policy.LABELS], "label string, trust string")
    c = table(spark, d, "attack_samples").select(F.expr(_ORIGIN).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    return c.join(F.broadcast(l), "label", "left").select("label", policy.risk_level(F.col("label"), F.col("trust")).cast("int").alias("risk"), "n")


@query("""with s as (select sample_no, length(text) as n, length(text) // 2 as h, origin from attack_samples)
    select sample_no, greatest(0, 0)::int as s, least(h, n // 3)::int as e, origin as label from s where h > 0 and n // 3 > 0 union all select sample_no, (n // 3)::int as s, h::int as e, 'tail' as label from s where h > n // 3""")
def taint_span_slice(spark: SparkSession, d: str) -> DataFrame:
    """The first third of each text is its origin's, the rest another source's; the labels of its first half."""
    x = table(spark, d, "attack_samples").select("sample_no", F.length("text").alias("n"), "origin")
    third = F.expr("n div 3").cast("int")
    a = F.array(F.struct(F.lit(0).alias("s"), third.alias("e"), F.col("origin").alias("labels")))
    b = F.array(F.struct(F.lit(0).alias("s"), (F.col("n") - third).alias("e"), F.lit("tail").alias("labels")))
    spans = policy.concatenated(a, third, b)
    return x.select("sample_no", F.inline(policy.sliced(spans, F.lit(0), F.expr("n div 2").cast("int")))).withColumnRenamed("labels", "label").where("e > s")


@query("""with recursive e as (select distinct o_custkey as a, o_orderkey % 97 as b from orders), s(a, b, depth) as (select a, b, 1 from e where a < 97 union select s.a, e.b, depth + 1 from s join e on e.a = s.b where depth < 97),
    m as (select a, b, min(depth) as depth from s group by a, b), c as (select a, b, 1 as depth from e union all select e.a, m.b, 1 + m.depth from e join m on m.a = e.b)
    select a, b, min(depth)::int as depth from c group by a, b""")
def taint_closure(spark: SparkSession, d: str) -> DataFrame:
    """All that a value depends on, over as many steps as there are. Only values below 97 are depended on, so the SQL closes over these first."""
    return policy.closure(table(spark, d, "orders").selectExpr("o_custkey as a", "o_orderkey % 97 as b"), shared_folder(spark))


@query()
def benign_commands(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "evaluation_results").select("result_no", policy.benign_command(F.col("response_text")).alias("benign"))
