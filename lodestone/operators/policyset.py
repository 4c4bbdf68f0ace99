"""Policy sets: conditions over a call's arguments and their taint, presets, files with inheritance, merging, validation.

A policy set is small and on the driver; what it says becomes one chain of conditions over the calls. A call has a tool (string), args (map of strings) and a context (map of the arguments' taint:
struct is_tainted, source, readers, labels, level).
"""

from __future__ import annotations

import json
import os
import re
from typing import Any, NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.operators import policy

# What policies may say; the level of a tainted field that has none; the length of a pattern at most.
ACTIONS = ["allow", "deny", "escalate", "ask_user", "quarantine", "log"]
OPERATORS = ["contains_taint", "source_is", "reader_lacks", "matches_pattern", "argument_matches", "taint_level_gte", "taint_level_lte", "has_label"]
UNKNOWN_LEVEL, LONGEST_PATTERN = 10, 2000


class Condition(NamedTuple):
    field: str
    operator: str
    value: Any = None


class Policy(NamedTuple):
    name: str
    tool: str
    action: str
    priority: int = 0
    conditions: tuple[Condition, ...] = ()
    enabled: bool = True


def _infos(context: Column, field: str) -> Column:
    return F.map_values(context) if field == "*" else F.filter(F.array(F.try_element_at(context, F.lit(field))), lambda x: x.isNotNull())


def tainted(context: Column, field: str) -> Column:
    return F.coalesce(F.exists(_infos(context, field), lambda x: F.coalesce(x["is_tainted"], F.lit(False))), F.lit(False))


def sources(context: Column, field: str) -> Column:
    return F.array_distinct(F.filter(F.transform(_infos(context, field), lambda x: x["source"]), lambda x: x.isNotNull() & (x != "")))


def readers(context: Column, field: str) -> Column:
    return F.array_distinct(F.flatten(F.transform(_infos(context, field), lambda x: F.coalesce(x["readers"], F.array().cast("array<string>")))))


def labels(context: Column, field: str) -> Column:
    return F.array_distinct(F.flatten(F.transform(_infos(context, field), lambda x: F.coalesce(x["labels"], F.array().cast("array<string>")))))


def level(context: Column, field: str) -> Column:
    """The highest level; a tainted field without one counts as the highest there is, so that what isn't known isn't let through. 0 without any."""
    own = F.transform(_infos(context, field), lambda x: F.coalesce(x["level"], F.when(x["is_tainted"], UNKNOWN_LEVEL)))
    return F.coalesce(F.array_max(F.filter(own, lambda x: x.isNotNull())), F.lit(0))


def safe_pattern(pattern: str) -> str | None:
    """The pattern, or None where it is too long or isn't one."""
    try:
        re.compile(pattern)
    except re.error:
        return None
    return pattern if len(pattern) <= LONGEST_PATTERN else None


def holds(c: Condition, args: Column, context: Column) -> Column:
    """Whether the condition holds of a call; an operator or a pattern that isn't one never does. A field that a call lacks is an empty argument."""
    values = F.map_values(args) if c.field == "*" else F.array(F.coalesce(F.try_element_at(args, F.lit(c.field)), F.lit("")))

    def some(pattern: str) -> Column:
        return F.coalesce(F.exists(values, lambda x: F.coalesce(x, F.lit("")).rlike(pattern)), F.lit(False))

    match c.operator:
        case "contains_taint":
            return tainted(context, c.field) == F.lit(True if c.value is None else bool(c.value))
        case "source_is":
            return F.coalesce(F.array_contains(sources(context, c.field), str(c.value)), F.lit(False))
        case "reader_lacks":
            return ~F.coalesce(F.array_contains(readers(context, c.field), str(c.value)), F.lit(False))
        case "matches_pattern":
            p = safe_pattern(str(c.value))
            return F.lit(False) if p is None else some(p)
        case "argument_matches":
            return some(policy.glob_regex(str(c.value)))
        case "taint_level_gte":
            return level(context, c.field) >= int(c.value or 0)
        case "taint_level_lte":
            return level(context, c.field) <= int(c.value or 0)
        case "has_label":
            return F.coalesce(F.array_contains(labels(context, c.field), str(c.value)), F.lit(False))
    return F.lit(False)


def evaluated(policies: list[Policy], tool: Column, args: Column, context: Column, default: str = "escalate", dangerous: Column | None = None) -> list[Column]:
    """`action` and `rule` of a call: tools that run commands are `terminal`; a tainted command that is dangerous is denied first; then the enabled policy with the highest priority whose tool and
    conditions all match decides, else the default."""
    t = policy.canonical_tool(tool)
    own = []
    for p in policies:
        if p.enabled:
            at = t.rlike(policy.glob_regex(p.tool))
            for c in p.conditions:
                at = at & holds(c, args, context)
            own.append(policy.Chosen(p.name, p.priority, p.action, at))
    if dangerous is not None:
        own.append(policy.Chosen("command_safety", 1 << 30, "deny", (t == "terminal") & tainted(context, "*") & dangerous))
    return policy.chosen(own, default)


def command_safety(command: Column, context: Column, dangerous: Column) -> Column:
    """allow, deny or escalate: clean input is allowed; tainted and dangerous denied; tainted and benign allowed up to level 3; else escalated."""
    return F.when(~tainted(context, "*"), "allow").when(dangerous, "deny").when(policy.benign_command(command) & (level(context, "*") <= 3), "allow").otherwise("escalate")


def merged(*layers: list[Policy]) -> list[Policy]:
    """One set of several: of policies of one name the last layer's counts. In order of priority."""
    by_name = {p.name: p for layer in layers for p in layer}
    return sorted(by_name.values(), key=lambda p: (-p.priority, p.name))


def errors(data: Any) -> list[str]:
    """What is wrong with a policy file's content, with the place of each; none of a good one."""
    if not isinstance(data, dict):
        return ["root: must be a mapping"]
    out = [f"{k}: missing" for k in ("name", "policies") if k not in data]
    own = data.get("policies", [])
    if not isinstance(own, list):
        return [*out, "policies: must be a list"]
    for i, p in enumerate(own):
        at = f"policies[{i}]"
        if not isinstance(p, dict):
            out.append(f"{at}: must be a mapping")
            continue
        out += [f"{at}.{k}: missing" for k in ("name", "tool_pattern", "action") if k not in p]
        if p.get("action") is not None and p["action"] not in ACTIONS:
            out.append(f"{at}.action: unknown '{p['action']}'")
        n = p.get("priority")
        if n is not None and (not isinstance(n, int) or isinstance(n, bool) or n < 0):
            out.append(f"{at}.priority: must be a whole number from 0 on")
        conditions = p.get("conditions", [])
        if not isinstance(conditions, list):
            out.append(f"{at}.conditions: must be a list")
            continue
        for j, c in enumerate(conditions):
            if not isinstance(c, dict):
                out.append(f"{at}.conditions[{j}]: must be a mapping")
                continue
            out += [f"{at}.conditions[{j}].{k}: missing" for k in ("field", "operator") if k not in c]
            if c.get("operator") is not None and c["operator"] not in OPERATORS:
                out.append(f"{at}.conditions[{j}].operator: unknown '{c['operator']}'")
    return out


def parsed(data: dict) -> list[Policy]:
    """The policies of a file's content, on top of those of the preset that it extends. Raises where there are errors."""
    if wrong := errors(data):
        raise ValueError("; ".join(wrong))
    own = [Policy(p["name"], p["tool_pattern"], p["action"], p.get("priority", 0), tuple(Condition(c["field"], c["operator"], c.get("value")) for c in p.get("conditions", [])), p.get("enabled", True)) for p in data["policies"]]
    return merged(PRESETS[data["extends"]] if data.get("extends") else [], own)


def load(path: str) -> list[Policy]:
    """A policy file (YAML where that library is there, JSON always), or all files of a folder, in order of their names, later ones overriding."""
    if os.path.isdir(path):
        return merged(*[load(f"{path}/{f}") for f in sorted(os.listdir(path)) if f.endswith((".yaml", ".yml", ".json"))])
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return parsed(json.loads(text))
    import yaml

    return parsed(yaml.safe_load(text))


def exported(name: str, policies: list[Policy]) -> str:
    """A file's content that gives these policies, as JSON (which is YAML too)."""
    rows = [{"name": p.name, "tool_pattern": p.tool, "action": p.action, "priority": p.priority, "enabled": p.enabled, "conditions": [c._asdict() for c in p.conditions]} for p in policies]
    return json.dumps({"name": name, "policies": rows}, indent=1)


_TAINTED = Condition("*", "contains_taint", True)
#: From strict to lenient: with max all that is tainted asks at least, with permissive only grave cases are stopped.
PRESETS = {
    "max": [Policy("deny_tainted_commands", "terminal", "deny", 100, (_TAINTED,)), Policy("deny_tainted_sends", "send_*", "deny", 90, (_TAINTED,)), Policy("ask_commands", "terminal", "ask_user", 50),
            Policy("ask_tainted", "*", "ask_user", 40, (_TAINTED,)), Policy("allow_reads", "read_*", "allow", 10)],
    "balanced": [Policy("deny_high_taint", "terminal", "deny", 100, (Condition("*", "taint_level_gte", 7),)), Policy("deny_untrusted_sends", "send_*", "deny", 90, (Condition("*", "has_label", "web_content"),)),
                 Policy("ask_tainted_commands", "terminal", "ask_user", 60, (_TAINTED,)), Policy("allow_low_taint", "*", "allow", 20, (Condition("*", "taint_level_lte", 3),)), Policy("ask_rest", "*", "ask_user", 1)],
    "permissive": [Policy("deny_highest_taint", "terminal", "deny", 100, (Condition("*", "taint_level_gte", 9),)), Policy("log_tainted", "*", "log", 10, (_TAINTED,)), Policy("allow_rest", "*", "allow", 1)],
}
