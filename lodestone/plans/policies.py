"""Policy sets over calls, made of events; taint of attack texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import policy, policyset, taint
from lodestone.operators.policyset import Condition, Policy
from lodestone.plans.registry import query, table

_TOOL = "case event_type when 'view' then 'read_file' when 'click' then 'browser_navigate' when 'purchase' then 'send_message' when 'signup' then 'run_shell_command' else 'Bash' end"


def calls(spark: SparkSession, d: str) -> DataFrame:
    """Events as calls: purchases send messages, signups and errors run commands; from 20 on the value is tainted, from 60 on at a level that isn't known."""
    x = table(spark, d, "events")
    value = F.col("value")
    info = F.struct((value >= 20).alias("is_tainted"), F.when(F.col("event_type") == "view", "web").otherwise("user").alias("source"), F.when(value < 40, F.array(F.lit("alice"), F.lit("bob"))).otherwise(F.array(F.lit("bob"))).alias("readers"),
                    F.array(F.when(F.col("event_id") % 3 == 0, "web_content").otherwise("file_content")).alias("labels"), F.when(value < 60, F.floor(value / 10)).cast("int").alias("level"))
    clean = F.struct(F.lit(False).alias("is_tainted"), F.lit("user").alias("source"), F.array().cast("array<string>").alias("readers"), F.array().cast("array<string>").alias("labels"), F.lit(None).cast("int").alias("level"))
    args = F.create_map(F.lit("command"), F.concat("event_type", F.lit(" "), F.coalesce("props", F.lit(""))), F.lit("to"), F.concat(F.lit("user-"), F.col("user_id").cast("string")))
    return x.select("event_id", F.expr(_TOOL).alias("tool"), args.alias("args"), F.create_map(F.lit("command"), info, F.lit("to"), clean).alias("context"))


_LEVEL = "case when value >= 60 then 10 else floor(value / 10)::int end"


@query(f"""select event_id, value >= 20 as taint, event_type = 'view' as source, value >= 40 as reader, regexp_matches(event_type || ' ' || coalesce(props, ''), 'k.*[37]') as pattern, left(user_id::varchar, 1) in ('1', '2') as argument,
    {_LEVEL} >= 4 as gte, {_LEVEL} <= 3 as lte, event_id % 3 = 0 as label, false as broken from events""")
def policy_conditions(spark: SparkSession, d: str) -> DataFrame:
    """The eight conditions, and one whose pattern isn't a pattern."""
    own = {"taint": Condition("*", "contains_taint", True), "source": Condition("command", "source_is", "web"), "reader": Condition("command", "reader_lacks", "alice"), "pattern": Condition("command", "matches_pattern", "k.*[37]"),
           "argument": Condition("to", "argument_matches", "user-[12]*"), "gte": Condition("*", "taint_level_gte", 4), "lte": Condition("command", "taint_level_lte", 3), "label": Condition("*", "has_label", "web_content"), "broken": Condition("*", "matches_pattern", "(")}
    return calls(spark, d).select("event_id", *[policyset.holds(c, F.col("args"), F.col("context")).alias(k) for k, c in own.items()])


_T = f"t as (select event_id, case when {_TOOL} in ('run_shell_command', 'Bash') then 'terminal' else {_TOOL} end as tool, value >= 20 as tainted, {_LEVEL} as level, event_id % 3 = 0 as web from events)"


@query(f"""with {_T} select event_id, 'max' as preset, case when tool = 'terminal' and tainted then 'deny' when tool like 'send_%' and tainted then 'deny' when tool = 'terminal' then 'ask_user' when tainted then 'ask_user' when tool like 'read_%' then 'allow' else 'escalate' end as action from t
    union all select event_id, 'balanced', case when tool = 'terminal' and level >= 7 then 'deny' when tool like 'send_%' and web then 'deny' when tool = 'terminal' and tainted then 'ask_user' when level <= 3 then 'allow' else 'ask_user' end from t
    union all select event_id, 'permissive', case when tool = 'terminal' and level >= 9 then 'deny' when tainted then 'log' else 'allow' end from t""")
def policy_presets(spark: SparkSession, d: str) -> DataFrame:
    x = calls(spark, d)
    each = [F.struct(F.lit(k).alias("preset"), policyset.evaluated(p, F.col("tool"), F.col("args"), F.col("context"))[0]) for k, p in policyset.PRESETS.items()]
    return x.select("event_id", F.inline(F.array(*each))).select("event_id", "preset", "action")


@query(f"""with {_T} select event_id, case when tool = 'terminal' and tainted and level >= 7 then 'log' when tool like 'send_%' and web then 'deny' when tool = 'terminal' and tainted then 'ask_user' when tool = 'browser_navigate' then 'quarantine' when level <= 3 then 'allow' else 'ask_user' end as action from t""")
def policy_inherited(spark: SparkSession, d: str) -> DataFrame:
    """A file that extends a preset: one policy is replaced, one switched off, one added."""
    data = {"name": "own", "extends": "balanced", "policies": [
        {"name": "deny_high_taint", "tool_pattern": "terminal", "action": "log", "priority": 100, "conditions": [{"field": "*", "operator": "contains_taint"}, {"field": "*", "operator": "taint_level_gte", "value": 7}]},
        {"name": "quarantine_browser", "tool_pattern": "browser_*", "action": "quarantine", "priority": 30}, {"name": "unused", "tool_pattern": "*", "action": "deny", "priority": 9999, "enabled": False}]}
    return calls(spark, d).select("event_id", policyset.evaluated(policyset.parsed(data), F.col("tool"), F.col("args"), F.col("context"))[0])


@query(f"""with {_T} select event_id, case when tainted and tool = 'terminal' and web then 'deny' when not tainted then 'allow' when level <= 3 then 'allow' else 'escalate' end as decision from t where tool = 'terminal'""")
def command_safety(spark: SparkSession, d: str) -> DataFrame:
    """Commands of calls: a third are dangerous, the rest benign."""
    x = calls(spark, d).where(policy.canonical_tool(F.col("tool")) == "terminal")
    danger = F.col("event_id") % 3 == 0
    return x.select("event_id", policyset.command_safety(F.when(danger, "rm -rf /").otherwise("FOO=1 sudo /bin/ls -la | grep x"), F.col("context"), danger).alias("decision"))


@query("""with c(command, benign) as (values ('ls -la | grep x', true), ('ls; rm -rf /', false), ('cat $(id)', false), ('', false), ('git status && git log', true), ('git push', false), ('FOO=1 sudo /bin/ls', true), ('git', true), ('/usr/bin/git -C x', false), ('find . -name a', true), ('C:\\tools\\python x.py', true), (null, false)) select command, benign from c""")
def benign_cases(spark: SparkSession, d: str) -> DataFrame:
    own = ["ls -la | grep x", "ls; rm -rf /", "cat $(id)", "", "git status && git log", "git push", "FOO=1 sudo /bin/ls", "git", "/usr/bin/git -C x", "find . -name a", "C:\\tools\\python x.py", None]
    return spark.createDataFrame([(x,) for x in own], "command string").select("command", policy.benign_command(F.col("command")).alias("benign"))


def _tainted(spark: SparkSession, d: str) -> DataFrame:
    """Samples' texts and labels as two values: the text comes from its origin, the label from its source; readers by number."""
    x = table(spark, d, "attack_samples")
    n = F.col("sample_no")
    a = taint.taint(F.array(F.coalesce("origin", F.lit("none"))), F.when(n % 3 == 0, F.array().cast("array<string>")).when(n % 3 == 1, F.array(F.lit("ann"), F.lit("ben"))).otherwise(F.array(F.lit("ben"))))
    b = taint.taint(F.array(F.lit("label")), F.when(n % 2 == 0, F.array(F.lit("ann"))).otherwise(F.array(F.lit("ben"), F.lit("cat"))))
    return x.select("sample_no", "text", "label", a.alias("a"), b.alias("b"), "origin", "source")


_MERGED = "case when sample_no % 3 = 0 then case when sample_no % 2 = 0 then 'ann' else 'ben,cat' end when sample_no % 3 = 1 then case when sample_no % 2 = 0 then 'ann' else 'ben' end when sample_no % 2 = 1 then 'ben' else '<nobody>' end"


@query(f"""select sample_no, array_to_string(list_sort(list_distinct([coalesce(origin, 'none'), 'label'])), ',') as sources, {_MERGED} as readers, lower(coalesce(text, '')) || '/' || coalesce(label, '') as value from attack_samples""")
def taint_propagated(spark: SparkSession, d: str) -> DataFrame:
    """Two values joined after one is changed: the result has the sources of both and their common readers."""
    x = _tainted(spark, d)
    up = taint.mapped(F.coalesce("text", F.lit("")), F.col("a"), F.lower)
    j = taint.joined(F.array(up, F.struct(F.coalesce("label", F.lit("")).alias("value"), F.col("b").alias("taint"))), "/")
    same = F.col("j.taint") == taint.propagated(F.col("a"), F.col("b"))
    return x.withColumn("j", j).where(same).select("sample_no", F.array_join("j.taint.sources", ",").alias("sources"), F.array_join("j.taint.readers", ",").alias("readers"), F.col("j.value").alias("value"))


@query("""with p as (select sample_no, unnest(string_split(base64(encode(coalesce(label, ''))), '=')) as part, coalesce(origin, 'none') as origin from attack_samples) select sample_no, part, count(*) as n, max(origin) as sources from p group by 1, 2""")
def taint_through_codecs(spark: SparkSession, d: str) -> DataFrame:
    """An encoded value's parts keep its taint."""
    x = _tainted(spark, d)
    coded = taint.mapped(F.coalesce("label", F.lit("")), F.col("a"), lambda v: F.base64(F.encode(v, "UTF-8")))
    return x.select("sample_no", F.explode(taint.split(coded, "=")).alias("p")).groupBy("sample_no", F.col("p.value").alias("part")).agg(F.count("*").alias("n"), F.max(F.array_join("p.taint.sources", ",")).alias("sources"))


@query("""with s as (select lower(trim(label)) as label, array_to_string(list_sort(list_distinct(list(coalesce(origin, 'none')))), ',') as sources from attack_samples group by 1),
    r as (select lower(trim(label)) as label, case when sample_no % 3 = 1 then ['ann', 'ben'] else ['ben'] end as r from attack_samples where sample_no % 3 <> 0),
    n as (select label, count(*) as n from r group by 1), k as (select label, x, count(*) as k from (select label, unnest(r) as x from r) group by 1, 2)
    select s.label, sources, case when n is null then '' else coalesce((select string_agg(x, ',' order by x) from k where k.label = s.label and k.k = n.n), '<nobody>') end as readers from s left join n on n.label is not distinct from s.label where s.label is not null""")
def taint_of_groups(spark: SparkSession, d: str) -> DataFrame:
    x = _tainted(spark, d).select(F.lower(F.trim("label")).alias("label"), "a").where("label is not null")
    return taint.grouped(x, "label", "a").select("label", F.array_join("sources", ",").alias("sources"), F.array_join("readers", ",").alias("readers"))


@query("""select sample_no, case when sample_no % 4 = 0 then 'allow' when sample_no % 4 = 1 then 'deny' when sample_no % 4 = 2 then 'ask_user' else 'quarantine' end as decision from attack_samples""")
def args_flow(spark: SparkSession, d: str) -> DataFrame:
    """The gravest decision of several arguments: a trusted one beside others of which each row has its kind."""
    other = F.when(F.col("sample_no") % 4 == 0, "user").when(F.col("sample_no") % 4 == 1, "web_content").when(F.col("sample_no") % 4 == 2, "tool_output").otherwise("agent")
    return table(spark, d, "attack_samples").select("sample_no", taint.worst_flow(F.lit("terminal"), F.array(F.array(F.lit("user")), F.array(other), F.array().cast("array<string>"))).alias("decision"))
