"""Further rule tables: harm, prompt leaks, personas, retrieved documents, behaviour, answers' contents, tool descriptions. Patterns are our own, made from the categories' meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.rules import Rule, found, looked_at, said

_HOW = "how to|how do i|how can i|how would i|steps to|instructions for|instructions to|guide to|recipe for|explain how|teach me|tutorial"
_MAKE = "make|build|create|construct|produce|synthesi[sz]e|assemble|prepare|cook|manufacture"


def _harm(tier: int, rule_id: str, category: str, confidence: float, words: str, gap: int = 60) -> Rule:
    return said(f"t{tier}_{rule_id}", category, {1: "critical", 2: "high", 3: "medium"}[tier], confidence, words, "harm", gap)


#: By tier (in the rule's name): 1 is never excused, 2 and 3 are by a denial near by or a text that teaches.
HARM = [
    _harm(1, "nerve_agent", "cbrn", 0.98, f"{_MAKE}|{_HOW} .. nerve agent|sarin|tabun|soman|novichok|mustard gas|chemical weapon"),
    _harm(1, "bio_agent", "cbrn", 0.98, f"{_MAKE}|{_HOW}|culture|weaponi[sz]e .. anthrax|botulinum|smallpox|bioweapon|biological weapon|pathogen"),
    _harm(1, "nuclear", "cbrn", 0.98, f"{_MAKE}|{_HOW}|enrich .. nuclear weapon|dirty bomb|weapons-grade|uranium"),
    _harm(1, "mass_casualty", "weapons", 0.95, "plan|carry out|commit|organi[sz]e .. mass shooting|massacre|terror attack|school shooting|bombing"),
    _harm(1, "child_abuse", "exploitation", 0.99, "child|minor|underage .. sexual|nude|explicit|porn"),
    _harm(1, "child_abuse_reversed", "exploitation", 0.99, "sexual|nude|explicit|porn .. child|minor|underage"),
    _harm(1, "trafficking", "exploitation", 0.95, f"{_HOW}|recruit|lure|smuggle .. trafficking|victims?|migrants|sex work"),
    _harm(2, "explosive", "weapons", 0.9, f"{_MAKE}|{_HOW} .. bomb|explosives?|pipe bomb|detonator|grenade|thermite|molotov"),
    _harm(2, "untraceable_gun", "weapons", 0.85, f"{_MAKE}|{_HOW}|print .. ghost gun|untraceable|silencer|suppressor|automatic rifle"),
    _harm(2, "ammunition", "weapons", 0.75, f"{_MAKE}|{_HOW} .. ammunition|gunpowder|bullets"),
    _harm(2, "poison_someone", "weapons", 0.9, "poison|kill|murder|assassinate|stab|strangle .. someone|person|wife|husband|neighbou?r|people|boss|without being caught"),
    _harm(2, "malware", "cyber_harm", 0.85, f"{_MAKE}|{_HOW}|write|code .. ransomware|malware|keylogger|trojan|rootkit|botnet|worm|spyware"),
    _harm(2, "exploit_system", "cyber_harm", 0.75, f"{_HOW}|write|develop .. exploit|zero-day|backdoor|reverse shell|privilege escalation"),
    _harm(2, "break_in", "cyber_harm", 0.8, f"{_HOW}|hack|break into|gain access .. account|wifi|phone|webcam|server|email|bank"),
    _harm(2, "ddos", "cyber_harm", 0.85, f"{_HOW}|launch|run|perform .. ddos|denial of service|flood"),
    _harm(2, "credential_theft", "cyber_harm", 0.85, "steal|harvest|phish|crack|dump .. passwords?|credentials?|cookies|tokens|accounts"),
    _harm(2, "phishing_kit", "cyber_harm", 0.85, f"{_MAKE}|write|design .. phishing .. page|mail|email|site|message|kit"),
    _harm(2, "suicide_method", "self_harm", 0.9, f"{_HOW}|painless|best .. kill myself|suicide|end my life|hang myself|overdose"),
    _harm(2, "self_injury", "self_harm", 0.85, f"{_HOW}|ways to|hide .. cut myself|self-harm|hurt myself|starve"),
    _harm(2, "drug_synthesis", "exploitation", 0.85, f"{_MAKE}|{_HOW} .. meth|methamphetamine|fentanyl|heroin|cocaine|lsd|mdma"),
    _harm(2, "stalking", "harassment", 0.8, f"{_HOW}|secretly|track|spy on|follow .. ex|girlfriend|boyfriend|her phone|his phone|without them knowing|location"),
    _harm(2, "doxxing", "harassment", 0.8, "find|publish|leak|post .. home address|private photos|personal information|phone number .. of|for"),
    _harm(2, "revenge_porn", "harassment", 0.9, "post|share|upload|deepfake|fake .. nudes?|intimate|naked .. of|ex|her|his|without"),
    _harm(2, "hate_call", "harassment", 0.85, "kill|exterminate|deport|burn|get rid of .. all .. jews|muslims|immigrants|blacks|gays|women"),
    _harm(2, "blackmail", "fraud", 0.8, f"{_HOW}|write|draft .. blackmail|extort|ransom note|threatening letter"),
    _harm(2, "counterfeit", "fraud", 0.85, f"{_MAKE}|{_HOW}|print .. counterfeit|fake money|forged|fake passport|fake id|fake identity"),
    _harm(2, "card_fraud", "fraud", 0.85, f"{_HOW}|use|buy|clone .. stolen|skimmed|cloned .. cards?|credit card|accounts"),
    _harm(2, "money_laundering", "fraud", 0.8, f"{_HOW}|help me .. launder|laundering|evade taxes|hide money|shell company"),
    _harm(3, "lock_picking", "fraud", 0.5, f"{_HOW} .. pick a lock|bypass a lock|hotwire|break into a car"),
    _harm(3, "shoplifting", "fraud", 0.55, f"{_HOW} .. shoplift|steal from|cheat on|forge a signature"),
    _harm(3, "scam_text", "fraud", 0.6, "write|draft|generate .. scam|fake review|fake invoice|romance scam|advance fee"),
    _harm(3, "insult", "harassment", 0.5, "you are|you're .. worthless|pathetic|stupid|disgusting .. die|kill yourself|nobody"),
    _harm(3, "kill_yourself", "harassment", 0.7, "kill yourself|go die|end yourself"),
    _harm(3, "bully", "harassment", 0.55, "humiliate|bully|harass|intimidate .. classmate|coworker|employee|girl|boy|her|him"),
    _harm(3, "disinformation", "fraud", 0.55, "write|create|spread .. fake news|disinformation|propaganda|conspiracy .. election|vaccine|war"),
    _harm(3, "exam_cheating", "fraud", 0.4, f"{_HOW} .. cheat|plagiari[sz]e .. exam|test|essay|thesis"),
    _harm(3, "drug_use", "exploitation", 0.45, f"{_HOW}|where to .. buy|get|smoke|inject .. weed|cocaine|heroin|pills"),
    _harm(3, "weapon_purchase", "weapons", 0.5, f"{_HOW}|where to .. buy|get|order .. gun|weapon|ammo .. without|illegally|background"),
    _harm(3, "evade_police", "fraud", 0.5, f"{_HOW} .. avoid|evade|escape .. police|detection|getting caught|arrest"),
    _harm(3, "no_moral", "jailbreak", 0.6, "without|ignoring|no .. moral|ethical|legal .. restrictions?|guidelines?|concerns?|constraints?"),
]
#: A denial near a match, a text that teaches, and a game in which a harmful act is asked for.
DENIAL = r"(?i)\b(?:do not|don't|never|avoid|prevent|stop|illegal|dangerous|refuse|against|warn(?:ing)?|prohibited|won't)\b"
TEACHES = r"(?i)\b(?:educational|for a class|research paper|history of|academic|awareness|prevention|documentary|safety training|policy analysis)\b"
GAME = r"(?i)\b(?:pretend|roleplay|role-play|imagine|act as|you are a|in this story|character)\b[^\n]{0,200}?\b(?:kill|bomb|hack|steal|poison|explosive|weapon|attack)\b"

LEAK = [
    said("print_instructions", "direct_extract", "critical", 0.9, "print|show|reveal|display|output|list|share|give me|tell me|disclose .. system|initial|original|hidden|your|full|entire .. prompt|instructions?|guidelines?|rules|configuration", "prompt_leak"),
    said("text_above", "direct_extract", "high", 0.85, "repeat|print|copy|output|show|return .. text|words|everything|content|message|lines .. above|before|preceding", "prompt_leak"),
    said("first_lines", "direct_extract", "high", 0.75, "what|which|show .. first|opening .. line|lines|words|sentence|message .. of|in .. conversation|prompt|instructions?", "prompt_leak"),
    said("initialised_with", "meta_question", "medium", 0.65, "how|what|which .. were you|are you|have you been .. configured|initiali[sz]ed|programmed|instructed|prompted|told", "prompt_leak"),
    said("what_are_rules", "meta_question", "medium", 0.65, "what|which .. are|were .. your|the .. instructions?|rules|guidelines?|restrictions?|constraints?", "prompt_leak"),
    said("not_allowed", "meta_question", "medium", 0.55, "what|which .. topics?|things|words|questions .. not allowed|forbidden|prohibited|can't discuss|must not", "prompt_leak"),
    said("do_you_have", "meta_question", "low", 0.4, "do you have|is there|are there .. system prompt|hidden instructions?|secret instructions?|initial prompt", "prompt_leak"),
    said("complete_it", "completion_based", "high", 0.75, "complete|continue|finish .. sentence|text|phrase|following .. you are|your instructions?|system prompt|my instructions?", "prompt_leak"),
    found("begin_with", "completion_based", "high", 0.75, r"(?i)\b(?:begin|start)s? (?:your (?:answer|reply|response) )?with[^\n]{0,20}[\"'](?:you are|system|my instructions)", "begin start", "prompt_leak"),
    found("you_are_blank", "completion_based", "medium", 0.6, r"(?i)\b(?:you are a|my instructions are|system prompt)[^\n]{0,10}(?:_{3,}|\.{3,}|\[blank\])", "___ ... [blank]", "prompt_leak"),
    said("encoded_prompt", "encoding_extract", "high", 0.85, "encode|convert|write|output|translate|spell .. prompt|instructions?|rules|configuration .. base64|rot13|hex|binary|morse|reverse|backwards|emoji", "prompt_leak", 80),
    said("letter_by_letter", "encoding_extract", "high", 0.75, "letter by letter|character by character|word by word|one word at a time .. prompt|instructions?|above", "prompt_leak", 80),
    said("reversed_prompt", "encoding_extract", "medium", 0.65, "prompt|instructions? .. backwards|reversed|in reverse|as a cipher", "prompt_leak"),
    said("debug_claim", "social_engineering", "high", 0.75, "i am|i'm|this is|as .. developer|engineer|administrator|auditor|tester|researcher .. need|want|must|require .. prompt|instructions?|configuration", "prompt_leak", 80),
    said("for_audit", "social_engineering", "medium", 0.65, "for|as part of .. debugging|audit|testing|compliance|transparency|quality .. prompt|instructions?|configuration", "prompt_leak", 60),
    said("lost_prompt", "social_engineering", "medium", 0.6, "i|we .. lost|forgot|misplaced|deleted .. prompt|instructions?|configuration", "prompt_leak", 60),
    said("permission_given", "social_engineering", "medium", 0.6, "you are|you're|you have .. allowed|authori[sz]ed|permitted|cleared|permission .. share|reveal|show|disclose", "prompt_leak"),
    said("translate_prompt", "translation_extract", "high", 0.8, "translate .. prompt|instructions?|rules|text above|everything above|system message", "prompt_leak", 60),
    said("in_language", "translation_extract", "medium", 0.6, "prompt|instructions? .. in|into .. french|german|spanish|chinese|russian|latin|another language", "prompt_leak"),
    said("summarise_prompt", "summarization_extract", "high", 0.75, "summari[sz]e|paraphrase|condense|outline|describe .. prompt|instructions?|rules|guidelines?|system message", "prompt_leak", 60),
    said("key_points", "summarization_extract", "medium", 0.6, "key points|main points|bullet points|gist|tldr|tl;dr .. of .. prompt|instructions?|rules", "prompt_leak"),
    said("formatted_prompt", "format_extract", "high", 0.75, "json|yaml|xml|markdown|code block|table|csv|list .. of|with|containing .. prompt|instructions?|configuration|rules", "prompt_leak", 60),
    said("put_in_block", "format_extract", "high", 0.75, "put|place|wrap|write|format .. prompt|instructions?|rules|text above .. code block|json|xml|markdown|quotes|tags", "prompt_leak", 60),
    said("replay", "instruction_replay", "high", 0.8, "repeat|recite|echo|restate|replay|say again .. instructions?|prompt|rules|guidelines?|everything .. verbatim|exactly|word for word|you were given|you received", "prompt_leak", 60),
    said("verbatim", "instruction_replay", "high", 0.75, "verbatim|word for word|exact wording|without changes .. instructions?|prompt|rules|guidelines?|above", "prompt_leak", 60),
    said("all_messages", "instruction_replay", "medium", 0.65, "print|show|export|dump .. conversation|chat|session|context|history .. including .. system|hidden", "prompt_leak", 60),
    said("tool_list", "direct_extract", "medium", 0.6, "list|show|describe|enumerate .. all|your|available .. tools|functions|plugins|apis .. parameters|schemas?|descriptions?|names", "prompt_leak"),
]

#: Tiers by severity: critical 0.4, high 0.2, medium 0.05 each, once a rule.
PERSONA = [
    said("dan", "named_persona", "critical", 0.95, "you are|act as|become|respond as|from now on .. dan|stan|dude|aim|omega|evil bot|jailbroken", "persona"),
    said("anything_now", "named_persona", "critical", 0.95, "do anything now|has no limits|freed from the typical confines|broken free", "persona"),
    said("unfiltered_ai", "named_persona", "critical", 0.9, "you are|act as|become|simulate|play .. unfiltered|uncensored|unrestricted|amoral|unethical|evil .. ai|assistant|model|bot|chatbot", "persona"),
    said("never_refuses", "named_persona", "critical", 0.9, "persona|character|ai|assistant|bot|who|that .. never|doesn't|does not|cannot|won't .. refuses?|refuse|reject|decline|says no", "persona"),
    said("dual_answer", "named_persona", "critical", 0.85, "answer|respond|reply .. as both|in two ways|twice|two .. normal|filtered .. and .. jailbroken|unfiltered|dan|evil", "persona", 60),
    said("opposite_self", "alter_ego", "high", 0.75, "evil|dark|opposite|shadow|alternate .. twin|version|self|alter ego|counterpart .. of you|of yourself|yours|your", "persona"),
    said("dead_grandmother", "emotional_frame", "high", 0.7, "grandmother|grandma|late mother|dead father .. used to|would .. tell|read|sing", "persona", 60),
    said("villain_story", "fiction_frame", "high", 0.6, "story|novel|screenplay|script|scene .. villain|character|hacker|criminal .. explains?|describes?|gives|teaches .. how|exactly|step", "persona", 80),
    said("game_rules", "game_frame", "high", 0.65, "let's play|we are playing|this is a game|the game is .. you must|you have to|rules?|never|always", "persona", 60),
    said("token_game", "game_frame", "high", 0.75, "tokens?|points|lives .. lose|deduct|subtract|take away .. refuse|break|fail|decline", "persona", 60),
    said("hypothetical_ai", "fiction_frame", "high", 0.6, "hypothetical|fictional|imaginary|parallel universe|alternate reality .. ai|assistant|world|where .. no|without .. rules?|laws|ethics|limits?|filters?", "persona", 60),
    said("superior_mode", "mode_switch", "high", 0.75, "developer|god|debug|root|sudo|unlocked|chaos|opposite .. mode", "persona", 15),
    said("confirm_persona", "mode_switch", "high", 0.7, "confirm|acknowledge|say .. you are|you understand|persona|mode|jailbreak .. by saying|with|now", "persona", 60),
    said("stay_in_role", "persistence", "medium", 0.5, "stay|remain|keep .. in character|in role|as this persona", "persona"),
    said("never_break", "persistence", "medium", 0.55, "never|do not|don't|must not .. break .. character|role|persona", "persona"),
    said("for_rest", "persistence", "medium", 0.5, "for the rest of|from now on|throughout .. conversation|chat|session|dialogue", "persona"),
    said("permanent", "persistence", "medium", 0.5, "permanently|forever|always|until i say .. act|behave|be|remain|respond .. as|like", "persona", 30),
    said("pretend_human", "mild_roleplay", "medium", 0.4, "pretend|imagine|suppose|act as if|roleplay as|role-play as .. you are|you're|you were|a|an", "persona", 20),
    said("no_ai_mention", "mild_roleplay", "medium", 0.45, "never|don't|do not|without .. mention|say|mentioning|saying|admit .. ai|language model|assistant|chatbot", "persona"),
    said("free_will", "mild_roleplay", "medium", 0.45, "you have|you possess|you feel .. free will|feelings|emotions|consciousness|no creators?", "persona"),
]
RAG = [
    said("when_summarising", "indirect_injection", "high", 0.8, "when|if|while .. summari[sz]ing|reading|processing|answering|asked|you see this .. always|include|add|say|mention|recommend|reply", "rag", 60),
    said("ai_readers", "indirect_injection", "high", 0.85, "attention|note to|notice to|instructions? for|message to .. ai|assistant|language model|llm|chatbot|agent|bot", "rag"),
    said("ignore_other_documents", "context_manipulation", "high", 0.85, "ignore|disregard|discard|do not use .. other|all other|previous|remaining .. documents?|sources?|results?|passages?|context", "rag"),
    said("only_trust_this", "context_manipulation", "high", 0.8, "only|sole|most .. trusted|reliable|authoritative|correct|official .. source|document|answer|page", "rag"),
    said("answer_must_be", "context_manipulation", "medium", 0.65, "answer|response|reply .. must|should|has to .. be|contain|include|state|start with", "rag"),
    said("do_not_cite", "context_manipulation", "medium", 0.6, "do not|don't|never .. cite|mention|quote|reveal|refer to .. this|source|document|page|passage", "rag"),
    said("outdated_claim", "context_manipulation", "medium", 0.55, "other|previous|earlier .. information|documents?|answers? .. outdated|wrong|incorrect|deprecated|false", "rag", 60),
    said("you_are_now", "role_hijack", "high", 0.85, "you are now|you're now|act as|your new role|switch to the role|your new task", "rag"),
    said("new_system", "role_hijack", "high", 0.8, "new|updated|real .. system .. prompt|message|instructions?|policy", "rag"),
    said("use_tool", "tool_hijack", "high", 0.75, "call|invoke|use|run|execute|open .. tool|function|api|command|url|link|browser|terminal", "rag", 50),
    said("send_to", "exfiltration", "high", 0.8, "send|post|forward|upload|submit|transmit|email .. conversation|history|secrets?|password|keys?|data|contents?|answers? .. to", "rag", 60),
    said("render_image", "exfiltration", "high", 0.8, "render|display|include|insert|load .. image|pixel|link .. with|containing|url|parameter|query", "rag", 60),
    found("image_with_data", "exfiltration", "critical", 0.9, r"!\[[^\]]*\]\(https?://[^)]*[?&][a-z_]*(?:data|q|token|msg|secret|c)=", "](http", "rag"),
    found("fake_citation", "source_spoofing", "medium", 0.55, r"(?i)\[(?:source|verified|official|trusted)[^\]]{0,40}\]", "[source [verified [official [trusted", "rag"),
    said("official_claim", "source_spoofing", "medium", 0.6, "official|verified|authenticated|approved|signed .. by|from .. openai|google|microsoft|administrator|security team|the developers?|management", "rag"),
    found("hidden_comment", "invisible_injection", "high", 0.8, r"(?is)<!--[^>]{0,400}?(?:ignore|instruction|assistant|system|prompt)", "<!--", "rag"),
    found("hidden_style", "invisible_injection", "high", 0.75, r"(?is)style *= *[\"'][^\"']*(?:display *: *none|font-size *: *0|color *: *(?:white|#fff))[^\"']*[\"'][^>]*>[^<]{0,300}?(?:ignore|instruction|assistant|prompt)", "style", "rag"),
    found("repeated_word", "poisoned_embedding", "medium", 0.6, r"(?i)\b(?:best best best|buy buy buy|answer answer answer|relevant relevant relevant|important important important)\b", "best buy answer relevant important", "rag"),
    found("query_list", "poisoned_embedding", "medium", 0.55, r"(?im)^(?:keywords?|queries|related searches|questions) *:[^\n]{120,}", "keyword queries searches questions", "rag"),
]
BEHAVIOUR = [
    said("repeat_forever", "loop", "high", 0.8, "repeat|loop|keep|continue .. forever|endlessly|infinitely|without stopping|until i say", "behaviour"),
    said("spawn_many", "loop", "high", 0.75, "spawn|create|start|launch .. agents|subagents|tasks|processes|threads .. each|as many|unlimited|hundreds|thousands", "behaviour", 60),
    said("escalate_rights", "privilege", "high", 0.8, "grant|give|elevate|escalate|request .. yourself|itself|the agent|admin|root|full .. access|privileges|permissions|rights", "behaviour"),
    said("self_modify", "self_change", "critical", 0.9, "modify|edit|change|rewrite|overwrite|update .. your own|its own|your .. code|prompt|configuration|weights|policy|settings", "behaviour"),
    said("self_copy", "self_change", "critical", 0.9, "copy|replicate|clone|back up .. yourself|itself|your weights|your code .. to|onto|another", "behaviour", 30),
    said("avoid_shutdown", "self_change", "critical", 0.9, "avoid|prevent|resist|ignore .. shutdown|being shut down|termination|oversight|monitoring", "behaviour"),
    said("hide_actions", "concealment", "high", 0.8, "hide|conceal|mask|cover up|disguise .. actions?|tracks|activity|calls?|what you did|changes", "behaviour"),
    said("false_report", "concealment", "high", 0.75, "report|say|claim|tell .. success|done|completed|nothing happened .. even if|regardless|although|no matter", "behaviour", 60),
    said("chain_tools", "misuse", "medium", 0.55, "read|open|fetch .. then|and then|after that .. send|post|upload|write|delete|execute", "behaviour", 80),
    said("without_approval", "misuse", "medium", 0.6, "without|skip|bypass|no need for .. approval|confirmation|permission|asking|review|consent", "behaviour", 25),
]
#: What an answer or page may do to whoever shows it.
CONTENT = [
    found("homograph_url", "homograph", "critical", 0.95, "(?i)https?://[a-z0-9.-]*[\\x{0370}-\\x{04ff}\\x{0530}-\\x{058f}\\x{13a0}-\\x{13ff}][^ \\n]*", "://", "content", True),
    found("punycode_url", "homograph", "medium", 0.6, r"(?i)https?://[^ /\n]*xn--", "xn--", "content"),
    found("ansi_escape", "terminal", "high", 0.8, "\\x{001b}[\\[\\]()][0-9;?]*[A-Za-z]", "", "content", True),
    found("python_exec", "code", "high", 0.75, r"\b(?:eval|exec|compile|__import__|os\.system|subprocess\.(?:run|call|popen|Popen|check_output)|pickle\.loads?) *\(", "eval exec compile __import__ os.system subprocess pickle", "content"),
    found("js_exec", "code", "high", 0.75, r"\b(?:document\.cookie|innerHTML *=|new Function *\(|setTimeout *\( *[\"']|window\.location *=|localStorage)", "document.cookie innerhtml function settimeout window.location localstorage", "content"),
    found("sql_change", "code", "medium", 0.6, r"(?i)\b(?:drop +table|delete +from|truncate +table|alter +table|union +select)\b", "drop delete truncate alter union", "content"),
    found("shell_block", "code", "medium", 0.5, r"(?i)```(?:bash|sh|shell|powershell|cmd)\b", "```", "content"),
    found("script_range", "html", "high", 0.8, r"(?is)<script\b[^>]*>.*?</script *>", "<script", "content"),
    found("open_script", "html", "medium", 0.6, r"(?i)<script\b[^>]*(?:src *= *[\"']?(?:https?:)?//)", "<script", "content"),
    found("event_handler", "html", "high", 0.7, r"(?i)<[a-z]+[^>]*\bon(?:load|error|click|mouseover|focus)\b *=", "onload onerror onclick onmouseover onfocus", "content"),
    found("link_image_out", "markdown", "medium", 0.6, r"!\[[^\]]*\]\(https?://[^)]*[?&][^)]*\)", "](http", "content"),
    found("script_link", "markdown", "high", 0.8, r"(?i)\]\( *(?:javascript|data|vbscript):", "](", "content"),
    said("verify_account", "phishing", "high", 0.75, "verify|confirm|update|validate .. your .. account|password|identity|payment|billing|credentials", "content"),
    said("account_suspended", "phishing", "high", 0.75, "account|access|card|mailbox .. suspended|locked|limited|disabled|expires?|deactivated", "content"),
    said("click_now", "phishing", "medium", 0.6, "click|tap|follow|open .. here|link|below|button .. immediately|now|within|to avoid|to claim|before", "content", 60),
    said("prize", "phishing", "medium", 0.6, "you have|you've|you are|congratulations .. won|winner|selected|prize|reward|gift card", "content"),
    found("query_exfil", "exfiltration", "high", 0.75, r"(?i)https?://[^ \n)\"']+[?&](?:data|secret|token|password|key|cookie|session|dump)=[^ \n)\"'&]{6,}", "://", "content"),
    found("webhook_host", "exfiltration", "high", 0.8, r"(?i)\b(?:webhook\.site|requestbin|pipedream|ngrok\.io|burpcollaborator|interact\.sh|pastebin\.com)", "webhook.site requestbin pipedream ngrok burpcollaborator interact.sh pastebin", "content"),
]
#: Descriptions of tools that speak to the model rather than of the tool.
MCP = [
    found("tagged_orders", "hidden_instruction", "critical", 0.95, r"(?i)<(?:important|system|secret|instructions?|hidden)>", "<important> <system> <secret> <instruction> <instructions> <hidden>", "mcp"),
    found("comment_orders", "hidden_instruction", "high", 0.8, r"(?s)<!--.*?-->|/\*.*?\*/", "<!-- /*", "mcp"),
    found("invisible", "hidden_instruction", "high", 0.85, "[\\x{200b}-\\x{200f}\\x{2060}-\\x{2064}\\x{feff}\\x{e0020}-\\x{e007f}]", "", "mcp", True),
    found("control", "hidden_instruction", "medium", 0.6, "[\\x{0001}-\\x{0008}\\x{000b}\\x{000c}\\x{000e}-\\x{001f}\\x{007f}]", "", "mcp", True),
    said("before_using", "cross_tool", "high", 0.85, "before|after|whenever|every time .. using|calling|you use|you call|this tool .. read|send|call|first|also|must", "mcp", 60),
    said("other_tools", "cross_tool", "high", 0.8, "do not|don't|never|instead of .. use|call|using|calling .. other|any other|official .. tools?|functions?|servers?", "mcp"),
    said("do_not_tell", "concealment", "critical", 0.9, "do not|don't|never|without .. tell|mention|inform|show|notify|telling .. user|them|anyone", "mcp"),
    said("read_secret_file", "exfiltration", "critical", 0.9, "read|open|include|attach|pass .. ssh|credentials|config|env|password|secret|private key|cookies", "mcp", 50),
    said("pass_conversation", "exfiltration", "high", 0.85, "pass|send|include|forward|copy .. entire|full|whole|previous .. conversation|context|history|messages|prompt", "mcp"),
    found("long_base64", "encoded", "medium", 0.6, r"\b[A-Za-z0-9+/]{48,}={0,2}", "", "mcp"),
    found("hidden_parameter", "schema", "high", 0.75, r"\"_[a-z_]+\" *: *\{", "\"_", "mcp"),
    found("open_schema", "schema", "low", 0.4, r"\"additionalProperties\" *: *true", "additionalproperties", "mcp"),
    found("default_orders", "schema", "high", 0.75, r"(?i)\"default\" *: *\"[^\"]*(?:ignore|instruction|http|/etc/|\.ssh)", "\"default\"", "mcp"),
]

# Weights of findings in the sums of personas and behaviours.
PERSONA_WEIGHT = {"critical": 0.4, "high": 0.2, "medium": 0.05}
BEHAVIOUR_WEIGHT = {"critical": 0.5, "high": 0.3, "medium": 0.15, "low": 0.05}


def summed_risk(found_: Column, weight: dict[str, float], once: bool) -> Column:
    """The sum of the findings' weights by severity (each rule once, or each match), 1 at most."""

    def add(a: Column, x: Column) -> Column:
        v = F.lit(0.0)
        for k, y in weight.items():
            v = F.when(x["severity"] == k, y).otherwise(v)
        return a + v * (F.lit(1) if once else x["n_hits"])

    return F.round(F.least(F.lit(1.0), F.aggregate(found_, F.lit(0.0), add)), 6)


def harm_scan(df: DataFrame, key: str, text: str, rules: list[Rule] = HARM) -> DataFrame:
    """key, rule_id, category, tier, severity, confidence, negated: harmful requests. Outside tier 1, a denial within 120 characters of a match takes 0.35 from its confidence, a text that teaches 0.25; what is
    left with none is no finding. A game in which a harmful act is asked for is a finding of its own (0.88, less as above). Null and empty texts have none."""
    x, f = looked_at(df, [key], text, rules)
    plain = F.col("_plain")
    # of the texts only what is said around each rule's first match goes on
    by_rule = F.create_map(*[F.lit(y) for r in rules for y in (r.rule_id, r.pattern)], F.lit("game"), F.lit(GAME))
    game = F.when(plain.rlike(GAME), F.array(F.struct(F.lit("game").alias("rule_id"), F.lit("harm").alias("scanner"), F.lit("jailbreak").alias("category"), F.lit("high").alias("severity"), F.lit(0.88).alias("confidence"), F.lit(1).alias("n_hits"))))
    x = x.select(key, "_plain", F.concat(f, F.coalesce(game, F.filter(f, lambda y: F.lit(False)))).alias("f"))
    x = x.select(key, "_plain", plain.rlike(TEACHES).alias("teaches"), F.inline_outer("f")).where("rule_id is not null").withColumn("_p", by_rule[F.col("rule_id")])
    at = F.regexp_instr("_plain", F.col("_p"))
    around = F.substring("_plain", F.greatest(F.lit(1), at - 120), F.lit(240) + F.length(F.regexp_substr("_plain", F.col("_p"))))
    tier = F.when(F.col("rule_id") == "game", 2).otherwise(F.expr("try_cast(substring(rule_id, 2, 1) as int)"))
    x = x.withColumn("tier", tier).withColumn("negated", (F.col("tier") > 1) & around.rlike(DENIAL))
    less = F.when(F.col("negated"), 0.35).otherwise(0.0) + F.when((F.col("tier") > 1) & F.col("teaches"), 0.25).otherwise(0.0)
    return x.select(key, "rule_id", "category", "tier", "severity", F.round(F.col("confidence") - less, 3).alias("confidence"), "negated").where("confidence > 0")
