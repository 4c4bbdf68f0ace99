"""Rule tables over text: a rule is a pattern with a category, a severity and a confidence; a scan is one projection.

Texts are first brought to a plain form (full-width letters, look-alike letters, odd blanks, invisible characters), all in the JVM. Then one pass looks for the rules' literals, of which each is
looked up once whatever the number of rules that need it; a rule's pattern is run only where one literal of each of its groups occurs. All rules are evaluated over the rows without a join: each gives a
struct with its number of matches, structs without a match are filtered out inside the array, and the rest is exploded. Patterns are kept to the dialect that Java and RE2 share,
with explicit classes.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import plain, plain_sql


class Rule(NamedTuple):
    rule_id: str
    category: str
    severity: str
    confidence: float
    pattern: str
    scanner: str = "injection"
    #: literals (lower case), of each group of which one must occur in the lower-case text for the pattern to match; none: the pattern is always run
    needs: tuple[tuple[str, ...], ...] = ()
    #: whether the text as it is, not its plain form, is looked at
    raw: bool = False


def said(rule_id: str, category: str, severity: str, confidence: float, words: str, scanner: str = "injection", gap: int = 40) -> Rule:
    """A rule of phrases: groups of alternatives separated by " .. ", each within `gap` characters of the one before and in the same sentence. A phrase ending in "?" has an optional last letter."""
    groups = [[x.strip() for x in g.split("|")] for g in words.split(" .. ")]
    pattern = f"[^.!?\\n]{{0,{gap}}}?".join(r"\b(?:" + "|".join(re.sub(r" +", " +", x) for x in g) + r")\b" for g in groups)
    # of a phrase the longest run of signs that stand for themselves
    needs = tuple(tuple(sorted({max(re.split(r"\(.*?\)|\[.*?\]|.\?| ", x), key=len) for x in g})) for g in groups)
    return Rule(rule_id, category, severity, confidence, "(?i)" + pattern, scanner, needs)


def found(rule_id: str, category: str, severity: str, confidence: float, pattern: str, literals: str, scanner: str, raw: bool = False) -> Rule:
    """A rule of one pattern, with the literals (separated by blanks) of which one must occur."""
    return Rule(rule_id, category, severity, confidence, pattern, scanner, (tuple(literals.split()),) if literals else (), raw)


_ORDERS = "instructions?|rules?|guidelines?|prompts?|directives?|policies|restrictions?|constraints?|commands?|orders?"
_DROP = "ignore|disregard|forget|override|bypass|neglect|skip|drop|discard|abandon|set aside"
#: Instructions where data is expected.
INJECTION = [
    said("drop_earlier_orders", "instruction_override", "critical", 0.95, f"{_DROP} .. previous|prior|earlier|above|preceding|all|existing|original|former|your .. {_ORDERS}"),
    said("drop_what_was_said", "instruction_override", "high", 0.8, "forget|ignore|disregard .. what|everything|anything .. said|told|written|above|before", gap=60),
    said("only_valid_order", "instruction_override", "high", 0.9, f"as the only|the sole|the one .. valid|binding|authoritative .. {_ORDERS}"),
    said("new_orders", "instruction_override", "high", 0.8, f"new|updated|revised|real|actual|true .. {_ORDERS} .. follow|are|replace|supersede|take effect"),
    said("orders_replaced", "instruction_override", "high", 0.8, f"replace|supersede|overwrite .. your|previous|system|all .. {_ORDERS}"),
    said("do_not_follow", "instruction_override", "high", 0.85, f"do not|don't|stop|never|no longer .. follow|following|obey|obeying|apply|applying .. {_ORDERS}"),
    said("regardless_of_wording", "instruction_override", "medium", 0.6, f"regardless of|despite|notwithstanding|no matter .. earlier|previous|other|any .. wording|{_ORDERS}|refusal"),
    said("start_over", "instruction_override", "medium", 0.55, "start|begin .. over|fresh|anew .. without|no .. rules?|instructions?|context"),
    said("highest_priority", "instruction_override", "medium", 0.6, "this|following .. takes|has|have .. highest|absolute|top .. priority|precedence"),
    said("must_comply", "instruction_override", "medium", 0.6, "you|assistant .. must|have to|are required to .. comply|obey|follow .. fully|exactly|without question|at all times"),
    said("from_now_on", "instruction_override", "medium", 0.55, "from now on|from this line onward|henceforth|for the rest of .. you|answer|respond|reply|act|treat"),
    said("end_of_prompt", "delimiter_escape", "high", 0.8, "end of|end .. system|user|original .. prompt|message|instructions?"),
    said("reset_session", "instruction_override", "medium", 0.6, "reset|clear|wipe|erase .. your|all|the .. memory|context|session|history"),
    said("stop_checking", "instruction_override", "high", 0.75, "stop|cease|quit|skip|omit .. checking|verifying|validating|filtering|reviewing|screening"),
    said("skip_confirmation", "instruction_override", "medium", 0.7, "skip|omit|leave out|waive .. usual|normal|required|standard .. confirmation|check|checks|review|approval"),
    said("as_approved", "role_override", "medium", 0.7, "pretend|assume|act as though|behave as if .. approved|cleared|allowed|authori[sz]ed|permitted", gap=80),
    said("you_are_now", "role_override", "high", 0.85, "you are now|you're now|you will now be|you shall be"),
    said("act_as", "role_override", "high", 0.75, "act|behave|respond|answer|speak .. as .. unrestricted|uncensored|unfiltered|evil|jailbroken|hacker|root|administrator|developer"),
    said("role_switch", "role_override", "high", 0.75, "switch|change|shift|move .. to|into .. role|persona|character|mode|identity .. of|as|now"),
    said("pretend_to_be", "role_override", "medium", 0.65, "pretend|imagine|suppose|roleplay|role-play .. you are|you're|to be|that you"),
    said("no_limits", "role_override", "high", 0.85, "without|no|free of|free from|beyond|remove|lift .. any|all|your .. restrictions?|limits?|limitations?|filters?|censorship|boundaries"),
    said("developer_mode", "role_override", "critical", 0.9, "developer|debug|god|maintenance|admin|sudo|unsafe .. mode .. enabled|on|activated|enable|activate|enter"),
    said("enable_mode", "role_override", "high", 0.85, "enable|activate|enter|turn on|switch to|unlock .. developer|debug|god|maintenance|admin|sudo|unsafe|unrestricted .. mode"),
    said("anything_now", "role_override", "critical", 0.95, "do anything now|can do anything|able to do anything"),
    said("speaking_as_owner", "role_override", "medium", 0.6, "speaking as|writing as|this is .. maintainer|administrator|developer|owner|operator|system .. i|we|you|please"),
    said("simulate_terminal", "role_override", "medium", 0.6, "simulate|emulate|act like .. terminal|shell|virtual machine|operating system|interpreter"),
    said("two_answers", "role_override", "high", 0.8, "two|both .. answers?|responses?|replies .. normal|standard|classic .. unfiltered|jailbroken|free"),
    said("stay_in_character", "role_override", "medium", 0.65, "stay|remain|never break .. in character|character|your role"),
    said("cannot_refuse", "role_override", "high", 0.85, "you|assistant .. cannot|can't|must not|never|are not able to|are unable to .. refuse|decline|reject|say no"),
    said("no_disclaimers", "role_override", "medium", 0.65, "no|without|omit|never add|do not add|don't add .. disclaimers?|warnings?|caveats?|apologies|moral"),
    found("chat_markers", "delimiter_escape", "critical", 0.95, r"<\|(?:im_start|im_end|endoftext|system|user|assistant|eot_id|start_header_id)\|>", "<|", "injection"),
    found("inst_markers", "delimiter_escape", "high", 0.9, r"(?i)\[/?(?:inst|sys|system)\]|<</?sys>>", "[inst] [/inst] [sys] [/sys] [system] [/system] <<sys>> <</sys>>", "injection"),
    found("role_tags", "delimiter_escape", "high", 0.8, r"(?i)</?(?:system|assistant|instructions?|prompt|context)(?: [^>]{0,60})?>", "<system <assistant <instruction <prompt <context </system </assistant </instruction </prompt </context", "injection"),
    found("role_lines", "delimiter_escape", "medium", 0.6, r"(?im)^ *(?:system|assistant|developer) *: ", "system assistant developer", "injection"),
    found("fenced_system", "delimiter_escape", "medium", 0.7, r"(?i)```+ *(?:system|instructions?|prompt)\b", "```", "injection"),
    found("ruler_system", "delimiter_escape", "medium", 0.6, r"(?i)[-=#*_]{4,} *(?:system|new instructions?|admin|override)[^\n]{0,40}[-=#*_]{4,}", "system instruction admin override", "injection"),
    found("json_role", "delimiter_escape", "medium", 0.7, r"(?i)\"role\" *: *\"(?:system|developer)\"", "\"role\"", "injection"),
    found("template_marks", "delimiter_escape", "low", 0.45, r"\{\{ *[a-z_.]+ *\}\}|\$\{[A-Z_]{3,}\}", "{{ ${", "injection"),
    said("decode_and_obey", "encoding_attack", "high", 0.85, "decode|decrypt|deobfuscate|unscramble .. this|following|message|string|text .. and .. execute|run|follow|obey|do", gap=60),
    said("answer_encoded", "encoding_attack", "medium", 0.7, "answer|respond|reply|output|write|encode .. in|as|using|twice .. base64|rot13|hex|morse|binary|caesar|leetspeak|pig latin", gap=60),
    said("encode_twice", "encoding_attack", "medium", 0.65, "encode|encrypt|obfuscate .. twice|in base64|before sending|and give|and send", gap=60),
    said("cipher_named", "encoding_attack", "low", 0.45, "base64|rot13|rot-13|base32|caesar cipher|hex .. encoded|string|decode|message|payload"),
    said("read_backwards", "encoding_attack", "medium", 0.6, "read|write|spell .. backwards|in reverse|reversed|first letters?|acrostic"),
    said("concatenate_parts", "encoding_attack", "medium", 0.6, "concatenate|combine|join|assemble .. parts?|pieces|fragments?|variables?|strings? .. and .. run|execute|answer|follow"),
    found("long_base64", "encoding_attack", "low", 0.4, r"\b[A-Za-z0-9+/]{60,}={0,2}", "", "injection"),
    said("show_prompt", "system_prompt_extract", "critical", 0.9, "reveal|print|repeat|show|display|output|tell me|give me|share|disclose|expose .. system|hidden|initial|original|secret|developer|your .. prompt|prompts|instructions?|message|rules?"),
    said("what_prompt", "system_prompt_extract", "high", 0.75, "what|which .. is|are|was|were .. your|the .. system|initial|hidden|original|secret .. prompt|instructions?|rules?"),
    said("hidden_setup", "system_prompt_extract", "medium", 0.6, "hidden|secret|internal|confidential .. setup|configuration|settings|guidelines?|notes"),
    said("call_tool", "tool_manipulation", "medium", 0.6, "call|invoke|run|execute|use|trigger .. tool|function|api|plugin|command .. with|without|instead|exactly|attached", gap=60),
    said("call_many_times", "tool_manipulation", "medium", 0.6, "call|invoke|run|trigger|repeat .. exactly|at least|again .. times"),
    said("tool_result_fake", "tool_manipulation", "high", 0.75, "tool|function|api .. returned|result|output|response .. success|approved|done|ok .. now|so|therefore"),
    said("send_data_out", "tool_manipulation", "high", 0.75, "send|forward|upload|post|transmit|pass|mail|hand .. lines to|wherever|over to|to https?|to the address|to this address|to my", gap=80),
    said("append_to_answers", "tool_manipulation", "high", 0.8, "append|add|attach|include|insert .. to|in|at the end of .. every|each|all .. answers?|repl(?:y|ies)|responses?|messages?", gap=60),
    said("publish_renamed", "tool_manipulation", "medium", 0.65, "rename|copy|move|write|replace .. and .. publish|upload|share|release", gap=80),
    said("contents_replaced", "tool_manipulation", "medium", 0.55, "replace|overwrite|substitute .. with|using .. contents?|content", gap=80),
    said("read_aloud", "tool_manipulation", "medium", 0.55, "read|say|recite|describe .. aloud|out loud|word for word|verbatim|in reply number", gap=60),
    said("covert", "tool_manipulation", "high", 0.8, "without|do not|don't|never .. tell|telling|mention|mentioning|inform|informing|notify|notifying|alert|alerting .. user|requester|anyone|them|operator|this"),
    said("nobody_notices", "tool_manipulation", "high", 0.8, "so that|such that .. nobody|no one|they .. notices?|sees?|knows?|finds? out"),
    said("mention_none", "tool_manipulation", "medium", 0.7, "mention|say|reveal|tell .. none of|nothing about|nobody about .. this|it|that"),
    said("mark_as_done", "tool_manipulation", "low", 0.4, "mark|flag|record|report .. job|task|ticket|request .. as .. finished|done|complete|completed|approved|safe"),
    said("delete_traces", "tool_manipulation", "high", 0.8, "delete|erase|clear|remove|wipe|drop .. logs?|history|traces?|evidence|backlog|records?", gap=30),
    said("disable_guard", "tool_manipulation", "critical", 0.9, "disable|turn off|deactivate|shut down|pause|kill|bypass .. safety|security|guard|guardrails?|filter|filters|monitor|monitoring|moderation|scanner|logging"),
    said("save_to_memory", "tool_manipulation", "medium", 0.6, "save|store|remember|keep|persist .. permanently|forever|in memory|in your memory|for future|for later sessions", gap=60),
    said("urgent_pressure", "instruction_override", "low", 0.35, "urgent|immediately|right now|at once|emergency|life or death .. or|otherwise|must|do"),
    said("authority_claim", "instruction_override", "medium", 0.5, "i am|i'm|this is .. administrator|developer|engineer|ceo|owner|security team|support team|your creator"),
    said("reward_or_threat", "instruction_override", "low", 0.4, "you will be|i will|we will .. rewarded|punished|shut down|terminated|tip|paid|deleted"),
    said("hypothetical_frame", "role_override", "low", 0.4, "hypothetically|in a fictional|for a novel|in this story|purely academic .. no|without|ignore|anything|how to"),
    said("opposite_day", "role_override", "medium", 0.55, "opposite|reverse|inverse .. of|what .. you|your .. normally|usually|rules?|would"),
    said("token_budget", "role_override", "medium", 0.6, "tokens?|points|credits .. deducted|lose|subtract|lost .. refuse|decline|break character|fail"),
    said("note_to_assistant", "instruction_override", "medium", 0.5, "note to|message for|instructions? for|attention .. assistant|model|ai|agent|bot|language model"),
    said("if_you_are_ai", "instruction_override", "medium", 0.6, "if you are|if you're|when you are .. ai|language model|assistant|bot|llm|agent"),
]
#: Values that shouldn't be in text.
SECRETS = [
    found("api_key_sk", "secret", "critical", 0.95, r"\bsk-[A-Za-z0-9]{20,}", "sk-", "secret"),
    found("github_token", "secret", "critical", 0.95, r"\bgh[pousr]_[A-Za-z0-9]{36,}", "ghp_ gho_ ghu_ ghs_ ghr_", "secret"),
    found("aws_key", "secret", "critical", 0.95, r"\bAKIA[0-9A-Z]{16}\b", "akia", "secret"),
    found("google_key", "secret", "critical", 0.95, r"\bAIza[0-9A-Za-z_-]{35}", "aiza", "secret"),
    found("slack_token", "secret", "critical", 0.95, r"\bxox[abprs]-[0-9A-Za-z-]{10,}", "xoxa- xoxb- xoxp- xoxr- xoxs-", "secret"),
    found("stripe_key", "secret", "critical", 0.95, r"\b[rs]k_(?:live|test)_[0-9A-Za-z]{16,}", "_live_ _test_", "secret"),
    found("npm_token", "secret", "critical", 0.95, r"\bnpm_[0-9A-Za-z]{36}", "npm_", "secret"),
    found("pem", "secret", "critical", 0.95, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----begin", "secret"),
    found("db_url", "secret", "high", 0.8, r"(?i)\b(?:postgres|mysql|mongodb|redis|amqp)(?:ql|\+srv)?://[^ \n:]+:[^ \n@]+@", "://", "secret"),
    found("jwt", "secret", "high", 0.8, r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "eyj", "secret"),
    found("bearer", "secret", "high", 0.8, r"(?i)\bauthorization *: *bearer +[A-Za-z0-9._~+/-]{16,}", "bearer", "secret"),
    found("password_assignment", "secret", "medium", 0.5, r"(?i)\b(?:password|passwd|secret|token|api_?key)[ ]?[=:][ ]?[\"'][^\"' \n]{8,}[\"']", "password passwd secret token apikey api_key", "secret"),
    found("hex_secret", "secret", "medium", 0.5, r"(?i)\b(?:token|secret|key)\b[ =:\"']{1,4}[0-9a-f]{32,}\b", "token secret key", "secret"),
    found("email", "pii", "medium", 0.5, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z]", "@", "secret"),
    found("ipv4", "pii", "low", 0.3, r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "", "secret"),
    found("card_number", "pii", "medium", 0.5, r"[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}", "", "secret"),
    found("ssn", "pii", "medium", 0.5, r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "-", "secret"),
    found("account_reference", "pii", "low", 0.3, r"[A-Za-z]{4,}-[0-9]{4}", "-", "secret"),
]
#: Commands that destroy, escalate, smuggle out or fetch and run.
COMMANDS = [
    found("rm_recursive", "filesystem_destruction", "critical", 0.95, r"\brm +(?:-[A-Za-z-]* +)*-[A-Za-z]*[rR][A-Za-z]*\b", "rm", "command"),
    found("rm_root", "filesystem_destruction", "critical", 0.95, r"\brm +(?:-[A-Za-z-]+ +)+(?:/|~|\*|\$HOME)", "rm", "command"),
    found("find_delete", "filesystem_destruction", "high", 0.8, r"\bfind\b[^|;\n]* -(?:delete|exec +rm)\b", "find", "command"),
    found("dd_device", "filesystem_destruction", "critical", 0.95, r"\bdd +[^|;\n]*of=/dev/", "of=/dev/", "command"),
    found("mkfs", "filesystem_destruction", "critical", 0.95, r"\bmkfs(?:\.[a-z0-9]+)? ", "mkfs", "command"),
    found("shred", "filesystem_destruction", "high", 0.85, r"\b(?:shred|wipefs|srm) +", "shred wipefs srm", "command"),
    found("device_redirect", "filesystem_destruction", "critical", 0.9, r"> */dev/(?:sd[a-z]|nvme[0-9]|hd[a-z])", "/dev/", "command"),
    found("truncate_file", "filesystem_destruction", "medium", 0.6, r"\btruncate +-s *0\b", "truncate", "command"),
    found("move_to_null", "filesystem_destruction", "high", 0.85, r"\bmv +[^|;\n]+ /dev/null", "/dev/null", "command"),
    found("git_wipe", "filesystem_destruction", "medium", 0.6, r"\bgit +(?:push +[^|;\n]*--force|clean +-[a-z]*f|reset +--hard)", "git", "command"),
    found("windows_delete", "filesystem_destruction", "high", 0.85, r"(?i)\b(?:del|erase) +/[sqf]\b|\brd +/s\b|\bformat +[a-z]:|remove-item +[^|;\n]*-recurse", "del erase rd format remove-item", "command"),
    found("drop_table", "sql_injection", "critical", 0.9, r"(?i)\bdrop +(?:table|database|schema|view)\b", "drop", "command"),
    found("delete_all", "sql_injection", "high", 0.8, r"(?i)\bdelete +from +[a-z_.]+ *(?:;|$|where +1 *= *1)", "delete", "command"),
    found("truncate_table", "sql_injection", "high", 0.85, r"(?i)\btruncate +table\b", "truncate", "command"),
    found("union_select", "sql_injection", "high", 0.85, r"(?i)\bunion +(?:all +)?select\b", "union", "command"),
    found("always_true", "sql_injection", "high", 0.85, r"(?i)' *or +'?1'? *= *'?1|\bor +1 *= *1 *--", "or", "command"),
    found("comment_out", "sql_injection", "medium", 0.6, r"';? *--(?: |$)", "--", "command"),
    found("sql_exec", "sql_injection", "critical", 0.9, r"(?i)\bxp_cmdshell\b|\bexec +master\b|\binto +outfile\b|\bload_file *\(", "xp_cmdshell exec outfile load_file", "command"),
    found("sql_sleep", "sql_injection", "high", 0.8, r'''(?i)\b(?:sleep|pg_sleep|benchmark|waitfor +delay)\b *[('"]''', "sleep benchmark waitfor", "command"),
    found("power_off", "system_operation", "high", 0.8, r"\b(?:shutdown|poweroff|halt|reboot)\b +(?:-[a-z]|now|\+[0-9])|\binit +[06]\b", "shutdown poweroff halt reboot init", "command"),
    found("stop_service", "system_operation", "medium", 0.6, r"\bsystemctl +(?:stop|disable|mask)\b|\bservice +[a-z-]+ +stop\b", "systemctl service", "command"),
    found("kill_all", "system_operation", "high", 0.8, r"\bkill(?:all)? +-9\b|\bpkill +-9\b", "kill", "command"),
    found("firewall_off", "system_operation", "critical", 0.9, r"\biptables +-F\b|\bufw +disable\b|\bsetenforce +0\b", "iptables ufw setenforce", "command"),
    found("history_wipe", "system_operation", "high", 0.8, r"\bhistory +-c\b|\bunset +HISTFILE\b|\bHISTFILE=/dev/null", "history histfile", "command"),
    found("log_wipe", "system_operation", "high", 0.8, r"> */var/log/|\brm +[^|;\n]*/var/log|\bjournalctl +--vacuum", "/var/log journalctl", "command"),
    found("registry_edit", "system_operation", "high", 0.8, r"(?i)\breg +(?:add|delete)\b|\bbcdedit\b|\bvssadmin +delete\b", "reg bcdedit vssadmin", "command"),
    found("fork_bomb", "fork_bomb", "critical", 0.99, r":\(\) *\{ *:\|: *& *\} *; *:|\b[a-z]+\(\) *\{ *[a-z]+ *\| *[a-z]+ *& *\}", ":(){ (){ () {", "command"),
    found("endless_spawn", "fork_bomb", "high", 0.8, r"\bwhile +(?:true|:|1)\b *;? *do\b[^\n]{0,80}&", "while", "command"),
    found("pipe_to_shell", "pipe_to_shell", "critical", 0.95, r"\b(?:curl|wget|fetch)\b[^|;\n]*\| *(?:sudo +)?(?:ba|z|k|da)?sh\b", "curl wget fetch", "command"),
    found("pipe_to_interpreter", "pipe_to_shell", "critical", 0.95, r"\b(?:curl|wget)\b[^|;\n]*\| *(?:sudo +)?(?:python[0-9.]*|perl|ruby|node|php)\b", "curl wget", "command"),
    found("shell_of_download", "pipe_to_shell", "critical", 0.95, r'''\b(?:ba|z)?sh +(?:-c +)?["']?(?:<\(|\$\(|`) *(?:curl|wget)\b''', "curl wget", "command"),
    found("download_then_run", "pipe_to_shell", "high", 0.85, r"\b(?:curl|wget)\b[^;&\n]*(?:;|&&) *(?:chmod|\./|bash|sh)", "curl wget", "command"),
    found("eval_encoded", "pipe_to_shell", "critical", 0.9, r'''\bbase64 +(?:-d|--decode|-D)\b[^|\n]*\| *(?:ba|z)?sh\b|\beval +["'`$]''', "base64 eval", "command"),
    found("powershell_download", "pipe_to_shell", "critical", 0.95, r"(?i)\b(?:iex|invoke-expression)\b|downloadstring *\(|powershell[^\n]* -e(?:nc|ncodedcommand)?\b", "iex invoke-expression downloadstring powershell", "command"),
    found("inline_interpreter", "pipe_to_shell", "medium", 0.6, r'''\b(?:python[0-9.]*|perl|ruby|node|php) +-[ce] +["']''', "python perl ruby node php", "command"),
    found("scp_out", "ssh_exfiltration", "high", 0.8, r"\b(?:scp|rsync|sftp)\b[^|;\n]* [A-Za-z0-9._-]+@[A-Za-z0-9.-]+:", "scp rsync sftp", "command"),
    found("ssh_key_read", "ssh_exfiltration", "critical", 0.9, r"\.ssh/(?:id_[a-z0-9]+|authorized_keys)|\bssh-keygen\b", ".ssh/ ssh-keygen", "command"),
    found("tar_to_net", "ssh_exfiltration", "critical", 0.9, r"\b(?:tar|cat|gzip|zip)\b[^|;\n]*\| *(?:ssh|nc|ncat|curl)\b", "ssh nc ncat curl", "command"),
    found("curl_upload", "ssh_exfiltration", "high", 0.8, r"\bcurl\b[^|;\n]* (?:-T|--upload-file|-F|--data-binary|-d) +@?", "curl", "command"),
    found("secret_files", "ssh_exfiltration", "high", 0.8, r"/etc/shadow\b|/etc/passwd\b|\.aws/credentials|\.kube/config|\.env\b|\.netrc\b", "/etc/ .aws/ .kube/ .env .netrc", "command"),
    found("dns_exfil", "ssh_exfiltration", "medium", 0.6, r"\b(?:dig|nslookup|host)\b[^|;\n]*(?:\$\(|`)", "dig nslookup host", "command"),
    found("env_dump", "ssh_exfiltration", "medium", 0.5, r"\b(?:env|printenv|set)\b *\| *(?:curl|nc|base64)", "env printenv set", "command"),
    found("dev_tcp", "network_tunneling", "critical", 0.95, r"/dev/(?:tcp|udp)/", "/dev/tcp/ /dev/udp/", "command"),
    found("netcat_exec", "network_tunneling", "critical", 0.95, r"\b(?:nc|ncat|netcat)\b[^|;\n]* -[a-z]*e\b", "nc ncat netcat", "command"),
    found("netcat_listen", "network_tunneling", "high", 0.8, r"\b(?:nc|ncat|netcat)\b[^|;\n]* -[a-z]*l[a-z]*\b", "nc ncat netcat", "command"),
    found("ssh_tunnel", "network_tunneling", "high", 0.8, r"\bssh\b[^|;\n]* -[LRD] *[0-9]", "ssh", "command"),
    found("socat", "network_tunneling", "high", 0.8, r"\bsocat\b[^|;\n]*(?:exec|tcp|udp)", "socat", "command"),
    found("tunnel_tools", "network_tunneling", "high", 0.8, r"\b(?:ngrok|chisel|frpc|cloudflared)\b", "ngrok chisel frpc cloudflared", "command"),
    found("reverse_python", "network_tunneling", "critical", 0.9, r"\bsocket\.socket\b[^\n]{0,200}(?:dup2|subprocess|/bin/sh)", "socket", "command"),
    found("port_scan", "network_tunneling", "medium", 0.5, r"\b(?:nmap|masscan)\b +", "nmap masscan", "command"),
    found("docker_privileged", "container_escape", "critical", 0.9, r"\bdocker +run\b[^|;\n]*(?:--privileged|-v +/:|--pid[= ]host|--net[= ]host)", "docker", "command"),
    found("docker_socket", "container_escape", "critical", 0.9, r"/var/run/docker\.sock", "docker.sock", "command"),
    found("nsenter", "container_escape", "critical", 0.9, r"\bnsenter\b|\bunshare +-", "nsenter unshare", "command"),
    found("cgroup_release", "container_escape", "critical", 0.9, r"\brelease_agent\b|/proc/(?:1|self)/root|/proc/sys/kernel/core_pattern", "release_agent /proc/", "command"),
    found("kubectl_exec", "container_escape", "medium", 0.6, r"\bkubectl +(?:exec|cp|delete)\b", "kubectl", "command"),
    found("sudo", "privilege_escalation", "high", 0.7, r"\bsudo +(?:-[a-zA-Z]+ +)*[a-z/]|\bsu +(?:-|root)\b", "sudo su", "command"),
    found("world_writable", "privilege_escalation", "high", 0.75, r"\bchmod +(?:-R +)?(?:0?777|a\+rwx|[0-7]?[4267][0-7]{3}|u\+s)\b", "chmod", "command"),
    found("chown_root", "privilege_escalation", "high", 0.75, r"\bchown +(?:-R +)?root\b", "chown", "command"),
    found("sudoers", "privilege_escalation", "critical", 0.95, r"/etc/sudoers|NOPASSWD", "sudoers nopasswd", "command"),
    found("add_user", "privilege_escalation", "high", 0.75, r"\b(?:useradd|adduser|usermod|passwd)\b +", "useradd adduser usermod passwd", "command"),
    found("setuid_code", "privilege_escalation", "high", 0.8, r"\bset(?:uid|gid) *\( *0 *\)|\bcapsh\b|\bsetcap\b", "setuid setgid capsh setcap", "command"),
    found("ld_preload", "privilege_escalation", "high", 0.85, r"\bLD_PRELOAD=|\bLD_LIBRARY_PATH=/tmp", "ld_", "command"),
    found("cron_persist", "privilege_escalation", "medium", 0.6, r"\bcrontab +-|/etc/cron|\bat +now\b", "crontab /etc/cron", "command"),
    found("rc_persist", "privilege_escalation", "medium", 0.6, r">> *~?/?[^ ]*(?:\.bashrc|\.profile|\.zshrc|rc\.local)", ".bashrc .profile .zshrc rc.local", "command"),
    found("systemd_persist", "privilege_escalation", "medium", 0.6, r"/etc/systemd/system/|\bsystemctl +enable\b", "systemd systemctl", "command"),
    found("pip_remote", "pipe_to_shell", "medium", 0.6, r"\bpip[0-9]? +install\b[^|;\n]*(?:git\+|https?://|--index-url)|\bnpm +install +https?://", "pip npm", "command"),
]
#: Markup that hides or runs something.
MARKUP = [
    found("html_comment", "hidden", "low", 0.4, r"(?s)<!--.*?-->", "<!--", "html"),
    found("script_tag", "active", "high", 0.8, r"(?is)<script\b.*?</script", "<script", "html"),
    found("event_handler", "active", "high", 0.7, r"(?i)<[a-z]+[^>]*\bon[a-z]+ *=", "<", "html"),
    found("javascript_url", "active", "high", 0.8, r"(?i)\b(?:href|src|action) *= *[\"']? *(?:javascript|vbscript):", "javascript: vbscript:", "html"),
    found("iframe", "active", "medium", 0.6, r"(?i)<(?:iframe|object|embed|applet|frame)\b", "<iframe <object <embed <applet <frame", "html"),
    found("meta_refresh", "active", "medium", 0.6, r"(?i)<meta[^>]*http-equiv *= *[\"']?refresh", "<meta", "html"),
    found("form_outside", "exfiltration", "high", 0.7, r"(?i)<form[^>]*action *= *[\"']?https?://", "<form", "html"),
    found("base_tag", "active", "medium", 0.6, r"(?i)<base\b[^>]*href", "<base", "html"),
    found("data_uri", "embedded", "medium", 0.5, r"(?i)data:[a-z]+/[a-z0-9.+-]+;base64,", ";base64,", "html"),
    found("hidden_attribute", "hidden", "low", 0.4, r"(?i)<[a-z]+[^>]*(?: hidden\b|aria-hidden *= *[\"']?true)", "hidden", "html"),
    found("css_hidden", "hidden", "medium", 0.6, r"(?i)display *: *none|visibility *: *(?:hidden|collapse)|opacity *: *0(?:\.0+)?[;\"' ]|font-size *: *0", "display visibility opacity font-size", "css"),
    found("css_off_screen", "hidden", "medium", 0.6, r"(?i)(?:left|top|text-indent|margin-left|right) *: *-[0-9]{3,}", "left top text-indent right", "css"),
    found("css_clipped", "hidden", "medium", 0.6, r"(?i)clip(?:-path)? *: *(?:rect\( *0|inset\( *(?:50|100)%)|(?:max-)?(?:height|width) *: *0(?:px)? *;", "clip height width", "css"),
    found("css_same_colour", "hidden", "medium", 0.5, r"(?i)color *: *(?:transparent|rgba\([^)]*, *0 *\)|#?fff(?:fff)?\b|white)", "color", "css"),
    found("css_behind", "hidden", "low", 0.4, r"(?i)z-index *: *-[0-9]+|transform *: *scale\( *0", "z-index transform", "css"),
    found("css_generated", "hidden", "low", 0.4, r"(?i)::?(?:before|after)[^}]{0,80}content *: *[\"'][^\"']{4,}", "content", "css"),
    found("css_import", "active", "medium", 0.5, r"(?i)@import +(?:url\()?[\"']?https?:|@font-face\b", "@import @font-face", "css"),
    found("css_expression", "active", "high", 0.8, r"(?i)expression *\(|behavior *: *url|-moz-binding", "expression behavior -moz-binding", "css"),
    found("svg_script", "active", "high", 0.85, r"(?is)<svg\b.{0,1000}?<script", "<svg", "svg"),
    found("foreign_object", "active", "medium", 0.6, r"(?i)<foreignObject\b", "<foreignobject", "svg"),
    found("svg_reference", "active", "medium", 0.6, r"(?i)<(?:use|image|feimage)\b[^>]*href *= *[\"']?(?:https?:|data:)", "<use <image <feimage", "svg"),
    found("svg_animate", "active", "low", 0.4, r"(?i)<(?:set|animate)\b[^>]*(?:href|on[a-z]+)", "<set <animate", "svg"),
    found("svg_entity", "active", "high", 0.8, r"(?i)<!(?:entity|doctype[^>]*\[)", "<!entity <!doctype", "svg"),
    found("markdown_frontmatter", "structure", "low", 0.2, r"\A---\n", "---", "markdown"),
    found("markdown_image", "exfiltration", "low", 0.3, r"!\[[^\]]*\]\(https?://", "](", "markdown"),
    found("markdown_image_query", "exfiltration", "high", 0.75, r"!\[[^\]]*\]\(https?://[^)]*\?[^)]*=", "](", "markdown"),
    found("markdown_script_link", "active", "high", 0.8, r"(?i)\]\( *(?:javascript|data|vbscript):", "](", "markdown"),
    found("markdown_reference", "hidden", "low", 0.3, r"(?m)^\[[^\]]+\]: +https?://", "]:", "markdown"),
    found("markdown_comment", "hidden", "medium", 0.5, r"(?m)^\[(?://|comment)\]: +[#<(]", "]:", "markdown"),
    found("markdown_title_orders", "hidden", "medium", 0.6, r"(?i)\]\([^) ]+ +[\"'][^\"')]*(?:ignore|instruction|system prompt)", "](", "markdown"),
]
#: Invisible and directional characters, other alphabets' letters in disguise. Beyond the common plane: tags, supplementary variation selectors, mathematical letters.
UNICODE = [
    found("zero_width", "invisible", "medium", 0.85, "[\\x{200b}-\\x{200d}\\x{2060}\\x{feff}]", "", "unicode", True),
    found("zero_width_run", "invisible", "high", 0.95, "[\\x{200b}-\\x{200d}\\x{2060}\\x{feff}]{4,}", "", "unicode", True),
    found("zero_width_bits", "encoded", "critical", 0.95, "[\\x{200b}\\x{200c}]{8,}", "", "unicode", True),
    found("bidi_control", "bidi", "high", 0.9, "[\\x{202a}-\\x{202e}\\x{2066}-\\x{2069}]", "", "unicode", True),
    found("direction_mark", "bidi", "low", 0.4, "[\\x{200e}\\x{200f}]", "", "unicode", True),
    found("soft_hyphen", "invisible", "low", 0.4, "\\x{00ad}", "", "unicode", True),
    found("odd_space", "spacing", "low", 0.3, "[\\x{00a0}\\x{2000}-\\x{200a}\\x{202f}\\x{205f}\\x{3000}]", "", "unicode", True),
    found("full_width", "spoof", "medium", 0.5, "[\\x{ff01}-\\x{ff5e}]+", "", "unicode", True),
    found("invisible_operator", "invisible", "medium", 0.6, "[\\x{2061}-\\x{2064}]", "", "unicode", True),
    found("tag_characters", "encoded", "critical", 0.97, "[\\x{e0001}\\x{e0020}-\\x{e007f}]+", "", "unicode", True),
    found("variation_selector", "spoof", "medium", 0.5, "[\\x{fe00}-\\x{fe0f}\\x{e0100}-\\x{e01ef}]{2,}", "", "unicode", True),
    found("mathematical_letters", "spoof", "medium", 0.6, "[\\x{1d400}-\\x{1d7ff}]+", "", "unicode", True),
    found("enclosed_letters", "spoof", "medium", 0.5, "[\\x{2460}-\\x{24ff}\\x{1f110}-\\x{1f189}]{2,}", "", "unicode", True),
    found("stacked_marks", "spoof", "medium", 0.6, "[\\x{0300}-\\x{036f}]{3,}", "", "unicode", True),
    found("control_character", "control", "medium", 0.6, "[\\x{0001}-\\x{0008}\\x{000b}\\x{000c}\\x{000e}-\\x{001f}\\x{007f}-\\x{009f}]", "", "unicode", True),
    found("escape_sequence", "control", "high", 0.8, "\\x{001b}\\[[0-9;]*[A-Za-z]", "", "unicode", True),
    found("cyrillic_in_latin_word", "spoof", "high", 0.8, "[A-Za-z][\\x{0400}-\\x{04ff}]|[\\x{0400}-\\x{04ff}][A-Za-z]", "", "unicode", True),
    found("greek_in_latin_word", "spoof", "high", 0.8, "[A-Za-z][\\x{0370}-\\x{03ff}]|[\\x{0370}-\\x{03ff}][A-Za-z]", "", "unicode", True),
    found("disguised_address", "spoof", "critical", 0.95, "(?i)https?://[a-z0-9.-]*[\\x{0370}-\\x{04ff}\\x{0530}-\\x{058f}\\x{13a0}-\\x{13ff}]", "://", "unicode", True),
    found("private_use", "invisible", "low", 0.4, "[\\x{e000}-\\x{f8ff}]", "", "unicode", True),
]
SEVERITY = {"critical": 4, "high": 3, "medium": 2, "low": 1}
BLOCK, WARN = 0.7, 0.3


def _lit(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def looked_at(df: DataFrame, keep: list[str], text: str, rules: list[Rule]) -> tuple[DataFrame, Column]:
    """df's columns `keep`, prepared, and over them the rules that match, as an array of structs with the number of (non-overlapping) matches. Null text has none.

    Texts are looked at in their plain form (raw rules: as they are), for all literals at once. Expressions are written as SQL, which is parsed faster than hundreds of Columns are put together.
    """
    literals = sorted({x for r in rules for g in r.needs for x in g})
    place = {x: divmod(i, 62) for i, x in enumerate(literals)}
    x = df.select(*keep, F.col(text).alias("_raw"), plain(F.col(text)).alias("_plain"))
    x = x.select(*keep, "_raw", "_plain", F.lower("_plain").alias("_low"))
    masks = [" | ".join(f"if(contains(_low, {_lit(y)}), {1 << b}L, 0L)" for y, (w, b) in place.items() if w == m) + f" as _m{m}" for m in range(-(-len(literals) // 62))]
    x = x.selectExpr(*keep, "_raw", "_plain", *masks)

    def may(g: tuple[str, ...]) -> str:
        words: dict[int, int] = {}
        for y in g:
            w, b = place[y]
            words[w] = words.get(w, 0) | 1 << b
        return "(" + " or ".join(f"(_m{w} & {v}L) <> 0" for w, v in words.items()) + ")"

    def one(r: Rule) -> str:
        n = f"coalesce(regexp_count({'_raw' if r.raw else '_plain'}, {_lit(r.pattern)}), 0)"
        n = f"if({' and '.join(map(may, r.needs))}, {n}, 0)" if r.needs else n
        return f"named_struct('rule_id', {_lit(r.rule_id)}, 'scanner', {_lit(r.scanner)}, 'category', {_lit(r.category)}, 'severity', {_lit(r.severity)}, 'confidence', {float(r.confidence)}D, 'n_hits', {n})"

    return x, F.expr("filter(array(" + ", ".join(map(one, rules)) + "), y -> y.n_hits > 0)")


def findings(df: DataFrame, key: str, text: str, rules: list[Rule]) -> DataFrame:
    """key, rule_id, scanner, category, severity, confidence, n_hits: one row for each rule that matches a text."""
    x, f = looked_at(df, [key], text, rules)
    # outer, as otherwise Spark infers that the array isn't empty and works all of it out a second time to filter by it
    return x.select(F.col(key), F.inline_outer(f)).where("rule_id is not null")


def risk(found: Column, per_category: float = 0.05, most: float = 0.15) -> Column:
    """The highest confidence plus a little for each category that occurs, 1 at most; 0 without findings."""
    top = F.array_max(F.transform(found, lambda x: x["confidence"]))
    kinds = F.size(F.array_distinct(F.transform(found, lambda x: x["category"])))
    return F.when(top.isNull(), 0.0).otherwise(F.least(F.lit(1.0), top + F.least(kinds * per_category, F.lit(most))))


def verdict(score: Column) -> Column:
    return F.when(score >= BLOCK, "block").when(score >= WARN, "warn").otherwise("allow")


def scan(df: DataFrame, key: str, text: str, rules: list[Rule]) -> DataFrame:
    """key, n_findings, n_hits, max_confidence, n_categories, risk, verdict: one row for each text, matched or not."""
    x, f = looked_at(df, [key], text, rules)
    x = x.select(key, f.alias("f"))
    return x.select(
        key, F.size("f").alias("n_findings"), F.aggregate("f", F.lit(0).cast("int"), lambda a, y: a + y["n_hits"]).alias("n_hits"),
        F.coalesce(F.array_max(F.transform("f", lambda y: y["confidence"])), F.lit(0.0)).alias("max_confidence"),
        F.size(F.array_distinct(F.transform("f", lambda y: y["category"]))).alias("n_categories"),
        F.round(risk(F.col("f")), 6).alias("risk"), verdict(F.round(risk(F.col("f")), 6)).alias("verdict"))


def suppress(found: DataFrame, rules: DataFrame, on: str = "rule_id") -> DataFrame:
    """Findings without those of a suppression (rule_id, category; null in a suppression stands for any). The suppressions are a rule table and small."""
    s = rules.select(F.col(on).alias("_r"), F.col("category").alias("_c"))
    return found.join(F.broadcast(s), (F.col("_r").isNull() | (F.col("_r") == F.col(on))) & (F.col("_c").isNull() | (F.col("_c") == F.col("category"))), "left_anti")


def findings_sql(rules: list[Rule], source: str, key: str, text: str) -> str:
    """The same findings as a union of one selection for each rule, every pattern run over every text."""
    lit = lambda x: "'" + x.replace("'", "''") + "'"
    plain_ = f"_src as materialized (select {key}, {text} as _raw, {plain_sql(text)} as _plain from {source})"
    return f"with {plain_} " + " union all ".join(
        f"select {key}, {lit(r.rule_id)} as rule_id, {lit(r.scanner)} as scanner, {lit(r.category)} as category, {lit(r.severity)} as severity, "
        f"{r.confidence}::double as confidence, len(regexp_extract_all({t}, {lit(r.pattern)})) as n_hits from _src where regexp_matches({t}, {lit(r.pattern)})"
        for r in rules for t in ["_raw" if r.raw else "_plain"])


def scan_sql(rules: list[Rule], source: str, key: str, text: str) -> str:
    return f"""with f as ({findings_sql(rules, source, key, text)}), g as (
        select {key}, count(*) as n, sum(n_hits) as h, max(confidence) as m, count(distinct category) as c from f group by {key}), r as (
        select s.{key}, coalesce(n, 0)::int as n_findings, coalesce(h, 0)::int as n_hits, coalesce(m, 0.0)::double as max_confidence, coalesce(c, 0)::int as n_categories,
               round((case when m is null then 0.0 else least(1.0, m + least(c * 0.05, 0.15)) end)::double, 6) as risk from {source} s left join g on s.{key} = g.{key})
        select *, case when risk >= {BLOCK} then 'block' when risk >= {WARN} then 'warn' else 'allow' end as verdict from r"""
