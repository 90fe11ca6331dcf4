"""Chat prompts: a string expression for each message, joined in the order of turns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Per-message forms of the named formats and the opening of the assistant's turn.
# {role} and {text} stand for the message, {trim} for its text without blanks at the ends, {Role} for the role with a
# capital first letter, {ROLE} for the role in capitals.
TEMPLATES: dict[str, tuple[str, str]] = {
    "chatml": ("<|im_start|>{role}\n{text}<|im_end|>\n", "<|im_start|>assistant\n"),
    "llama3": ("<|start_header_id|>{role}<|end_header_id|>\n\n{trim}<|eot_id|>", "<|start_header_id|>assistant<|end_header_id|>\n\n"),
    "zephyr": ("<|{role}|>\n{text}<|endoftext|>\n", "<|assistant|>\n"),
    "phi3": ("<|{role}|>\n{text}<|end|>\n", "<|assistant|>\n"),
    "falcon3": ("<|{role}|>\n{text}\n", "<|assistant|>\n"),
    "phi4": ("<|im_start|>{role}<|im_sep|>{text}<|im_end|>", "<|im_start|>assistant<|im_sep|>"),
    "glmedge": ("<|{role}|>\n{text}", "<|assistant|>"),
    "megrez": ("<|role_start|>{role}<|role_end|>{text}<|turn_end|>", "<|role_start|>assistant<|role_end|>"),
    "llama4": ("<|header_start|>{role}<|header_end|>\n\n{trim}<|eot|>", "<|header_start|>assistant<|header_end|>\n\n"),
}


# Formats whose messages depend on the role: what stands before all messages, each role's form, the opening.
# * is every other role; without it, a role without a form is left out.
BY_ROLE: dict[str, tuple[str, dict[str, str], str]] = {
    "openchat": ("", {"system": "{text}<|end_of_turn|>", "*": "GPT4 Correct {Role}: {text}<|end_of_turn|>"}, "GPT4 Correct Assistant:"),
    "vicuna": ("", {"system": "{text}\n\n", "user": "USER: {text}\n", "assistant": "ASSISTANT: {text}</s>\n"}, "ASSISTANT:"),
    "vicuna_orca": ("", {"system": "SYSTEM: {text}\n", "user": "USER: {text}\n", "assistant": "ASSISTANT: {text}</s>\n"}, "ASSISTANT:"),
    "deepseek": ("", {"system": "{text}", "user": "### Instruction:\n{text}\n", "assistant": "### Response:\n{text}\n<|EOT|>\n"}, "### Response:\n"),
    "deepseek3": ("", {"system": "{text}\n\n", "user": "<｜User｜>{text}", "assistant": "<｜Assistant｜>{text}<｜end▁of▁sentence｜>"}, "<｜Assistant｜>"),
    "command_r": ("", {"system": "<|START_OF_TURN_TOKEN|><|SYSTEM_TOKEN|>{trim}<|END_OF_TURN_TOKEN|>", "user": "<|START_OF_TURN_TOKEN|><|USER_TOKEN|>{trim}<|END_OF_TURN_TOKEN|>", "assistant": "<|START_OF_TURN_TOKEN|><|CHATBOT_TOKEN|>{trim}<|END_OF_TURN_TOKEN|>"}, "<|START_OF_TURN_TOKEN|><|CHATBOT_TOKEN|>"),
    "chatglm3": ("[gMASK]sop", {"*": "<|{role}|>\n {text}"}, "<|assistant|>"),
    "chatglm4": ("[gMASK]<sop>", {"*": "<|{role}|>\n{text}"}, "<|assistant|>\n"),
    "exaone3": ("", {"system": "[|system|]{trim}[|endofturn|]\n", "user": "[|user|]{trim}\n", "assistant": "[|assistant|]{trim}[|endofturn|]\n"}, "[|assistant|]"),
    "bailing": ("", {"user": "<role>HUMAN</role>{text}", "*": "<role>{ROLE}</role>{text}"}, "<role>ASSISTANT</role>"),
    "granite": ("", {"assistant_tool_call": "<|start_of_role|>{role}<|end_of_role|><|tool_call|>{text}<|end_of_text|>\n", "*": "<|start_of_role|>{role}<|end_of_role|>{text}<|end_of_text|>\n"}, "<|start_of_role|>assistant<|end_of_role|>\n"),
    "yandex": ("", {"user": " Пользователь: {text}\n\n", "assistant": " Ассистент: {text}\n\n"}, " Ассистент:[SEP]"),
}

# Formats in which a message's form also depends on its place. A key is a role, with @first or @last for
# that place only; * stands for every other role. {open} opens a turn: the first text of the pair before the first
# message, the second before each message that follows one of neither the user nor the system. {pending} is the system
# text that no earlier message took, with an empty line behind it. Values: start, turn openings, forms, opening.
BY_PLACE: dict[str, tuple[str, tuple[str, str], dict[str, str], str]] = {
    "mistral_v1": ("", (" [INST] ", " [INST] "), {"system": "{open}{text}\n\n", "user": "{open}{text} [/INST]", "*": "{open} {text}</s>"}, ""),
    "mistral_v3": ("", ("[INST] ", "[INST] "), {"system": "{open}{text}\n\n", "user": "{open}{text}[/INST]", "*": "{open} {trim}</s>"}, ""),
    "mistral_v3_tekken": ("", ("[INST]", "[INST]"), {"system": "{open}{text}\n\n", "user": "{open}{text}[/INST]", "*": "{open}{text}</s>"}, ""),
    "mistral_v7": ("", ("", ""), {"system": "[SYSTEM_PROMPT] {text}[/SYSTEM_PROMPT]", "user": "[INST] {text}[/INST]", "*": " {text}</s>"}, ""),
    "mistral_v7_tekken": ("", ("", ""), {"system": "[SYSTEM_PROMPT]{text}[/SYSTEM_PROMPT]", "user": "[INST]{text}[/INST]", "*": "{text}</s>"}, ""),
    "llama2": ("", ("[INST] ", "[INST] "), {"system": "{open}{text}\n", "user": "{open}{text} [/INST]", "*": "{open}{text}</s>"}, ""),
    "llama2_sys": ("", ("[INST] ", "[INST] "), {"system": "{open}<<SYS>>\n{text}\n<</SYS>>\n\n", "user": "{open}{text} [/INST]", "*": "{open}{text}</s>"}, ""),
    "llama2_sys_bos": ("", ("[INST] ", "<s>[INST] "), {"system": "{open}<<SYS>>\n{text}\n<</SYS>>\n\n", "user": "{open}{text} [/INST]", "*": "{open}{text}</s>"}, ""),
    "llama2_sys_strip": ("", ("[INST] ", "[INST] "), {"system": "{open}<<SYS>>\n{trim}\n<</SYS>>\n\n", "user": "{open}{trim} [/INST]", "*": "{open}{trim}</s>"}, ""),
    "monarch": ("", ("", ""), {"*@first": "{role}\n{text}</s>\n", "*": "<s>{role}\n{text}</s>\n"}, "<s>assistant\n"),
    "gemma": ("", ("", ""), {"system": "", "assistant": "<start_of_turn>model\n{trim}<end_of_turn>\n", "*": "<start_of_turn>{role}\n{pending}{trim}<end_of_turn>\n"}, "<start_of_turn>model\n"),
    "orion": ("", ("", ""), {"system": "", "user": "Human: {pending}{text}\n\nAssistant: </s>", "*": "{text}</s>"}, ""),
    "minicpm": ("", ("", ""), {"user": "<用户>{trim}<AI>", "*": "{trim}"}, ""),
    "deepseek2": ("", ("", ""), {"system": "{text}\n\n", "user": "User: {text}\n\n", "assistant": "Assistant: {text}<｜end▁of▁sentence｜>"}, "Assistant:"),
    "exaone4": ("", ("", ""), {"system": "[|system|]{trim}[|endofturn|]\n", "user": "[|user|]{trim}\n", "assistant": "[|assistant|]{trim}[|endofturn|]\n", "tool": "[|tool|]{trim}[|endofturn|]\n"}, "[|assistant|]"),
    "rwkv_world": ("", ("", ""), {"system": "System: {trim}\n\n", "user@last": "User: {trim}\n\nAssistant:", "user": "User: {trim}\n\n", "assistant": "Assistant: {trim}\n\n"}, ""),
    "gigachat": ("<s>", ("", ""), {"system@first": "{text}<|message_sep|>", "user": "user<|role_sep|>{text}<|message_sep|>available functions<|role_sep|>[]<|message_sep|>", "assistant": "assistant<|role_sep|>{text}<|message_sep|>"}, "assistant<|role_sep|>"),
    "smolvlm": ("<|im_start|>", ("", ""), {"system": "{text}\n\n", "user": "User: {text}<end_of_utterance>\n", "*": "Assistant: {text}<end_of_utterance>\n"}, "Assistant:"),
    "dots1": ("", ("", ""), {"system": "<|system|>{text}<|endofsystem|>", "user": "<|userprompt|>{text}<|endofuserprompt|>", "*": "<|response|>{text}<|endofresponse|>"}, "<|response|>"),
    "hunyuan_moe": ("", ("", ""), {"system": "<|startoftext|>{text}<|extra_4|>", "assistant": "{text}<|eos|>", "*": "<|startoftext|>{text}<|extra_0|>"}, ""),
    "hunyuan_dense": ("", ("", ""), {"system@first": "{text}<｜hy_place▁holder▁no▁3｜>", "assistant": "<｜hy_Assistant｜>{text}<｜hy_place▁holder▁no▁2｜>", "user": "<｜hy_User｜>{text}<｜hy_Assistant｜>"}, ""),
    "gpt_oss": ("", ("", ""), {"assistant": "<|start|>assistant<|message|>{text}<|return|>", "*": "<|start|>{role}<|message|>{text}<|end|>"}, "<|start|>assistant"),
    "kimi_k2": ("", ("", ""), {"system": "<|im_system|>system<|im_middle|>{text}<|im_end|>", "user": "<|im_user|>user<|im_middle|>{text}<|im_end|>", "assistant": "<|im_assistant|>assistant<|im_middle|>{text}<|im_end|>", "tool": "<|im_system|>tool<|im_middle|>{text}<|im_end|>", "*": "{text}<|im_end|>"}, "<|im_assistant|>assistant<|im_middle|>"),
    "seed_oss": ("", ("", ""), {"assistant": "<seed:bos>assistant\n{trim}<seed:eos>", "*": "<seed:bos>{role}\n{text}<seed:eos>"}, "<seed:bos>assistant\n"),
}

#: What is trimmed from a message's ends.
BLANKS = " \t\n\v\f\r"


def _filled(form: str, **more: Column) -> Column:
    """The form with role, text and the other values in their places; nulls count as empty."""
    values = {"role": F.col("role"), "text": F.col("text"), "trim": F.btrim(F.col("text"), F.lit(BLANKS)), "Role": F.concat(F.upper(F.substring("role", 1, 1)), F.substring("role", 2, 1 << 30)), "ROLE": F.upper("role")} | more
    parts = [F.coalesce(values[p[1:-1]], F.lit("")) if p[0] == "{" and p[1:-1] in values else F.lit(p) for p in re.split(r"(\{[A-Za-z]+\})", form) if p]
    return F.concat(F.lit(""), *parts)


def _placed(conversations: DataFrame, turns: tuple[str, str], forms: dict[str, str]) -> DataFrame:
    """(conv_id, turn, m) by the rules of BY_PLACE. All windows share the conversations' partitioning."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    whole = {r.partition("@")[0] for r in forms} - {"*"}
    rest = F.col("role").isNull() | ~F.col("role").isin(*whole) if whole else F.lit(True)
    takes = F.lit(False)
    for key, form in forms.items():
        if "{pending}" in form:
            takes = takes | (rest if key == "*" else F.coalesce(F.col("role") == key, F.lit(False)))
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("place", F.row_number().over(order)).withColumn("before", F.lag("role").over(order)).withColumn("after", F.lead("turn").over(order))
    opens = F.when(F.col("place") == 1, turns[0]).when(F.col("before").isin("user", "system"), "").otherwise(turns[1])
    pending = F.lit("")
    if any("{pending}" in f for f in forms.values()):
        trimmed = F.btrim(F.col("text"), F.lit(BLANKS)) if "{trim}" in "".join(forms.values()) else F.col("text")
        taken = F.coalesce(F.sum(takes.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rows = rows.withColumn("taken", taken)
        since = Window.partitionBy("conv_id", "taken").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("system", F.array_join(F.collect_list(F.when(F.col("role") == "system", trimmed)).over(since), ""))
        pending = F.when(F.col("system") != "", F.concat("system", F.lit("\n\n")))
    message = F.lit(None).cast("string")
    for key, form in reversed(forms.items()):
        role, _, place = key.partition("@")
        cond = rest if role == "*" else F.col("role") == role
        cond = cond & {"": F.lit(True), "first": F.col("place") == 1, "last": F.col("after").isNull()}[place]
        message = F.when(cond, _filled(form, open=opens, pending=pending)).otherwise(message)
    return rows.select("conv_id", "turn", F.coalesce(message, F.lit("")).alias("m"))


def prompts(conversations: DataFrame, template: str, add_assistant: bool = True) -> DataFrame:
    """(conv_id, prompt) of each conversation."""
    rows = None
    if template in TEMPLATES:
        form, opening = TEMPLATES[template]
        start, message = "", _filled(form)
    elif template in BY_ROLE:
        start, forms, opening = BY_ROLE[template]
        message = _filled(forms["*"]) if "*" in forms else F.lit("")
        for role, form in reversed(forms.items()):
            message = message if role == "*" else F.when(F.col("role") == role, _filled(form)).otherwise(message)
    elif template in BY_PLACE:
        start, turns, forms, opening = BY_PLACE[template]
        rows = _placed(conversations, turns, forms)
    else:
        raise ValueError(f"unknown template {template!r}")
    if rows is None:
        rows = conversations.select("conv_id", "turn", message.alias("m"))
    joined = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "m"))), lambda s: s["m"]), "").alias("prompt"))
    return joined.withColumn("prompt", F.concat(F.lit(start), "prompt", F.lit(opening if add_assistant else "")))


# By which marks in the text of a model's template its format is told; the first row whose marks all occur
# holds. A mark with ^ must begin the text.
_INSTRUCT = [
    ("mistral_v7", ("[SYSTEM_PROMPT]",)), ("mistral_v1", ("' [INST] ' + system_message", " [INST]")), ("mistral_v1", ("[AVAILABLE_TOOLS]", " [INST]")),
    ("mistral_v3_tekken", ("' [INST] ' + system_message", "\"[INST]\"")), ("mistral_v3_tekken", ("[AVAILABLE_TOOLS]", "\"[INST]\"")), ("mistral_v3", ("' [INST] ' + system_message",)), ("mistral_v3", ("[AVAILABLE_TOOLS]",)),
    ("llama2_sys_strip", ("content.strip()",)), ("llama2_sys_bos", ("bos_token + '[INST]",)), ("llama2_sys", ("<<SYS>>",)), ("llama2", ()),
]
MARKS: list[tuple[str, tuple[str, ...]]] = [
    ("phi4", ("<|im_start|>", "<|im_sep|>")), ("smolvlm", ("<|im_start|>", "<end_of_utterance>")), ("chatml", ("<|im_start|>",)),
    *((name, (lead, *marks)) for name, marks in _INSTRUCT for lead in ("^mistral", "[INST]")),
    ("phi3", ("<|assistant|>", "<|end|>")), ("chatglm4", ("[gMASK]<sop>",)), ("falcon3", ("<|assistant|>", "<|user|>", "</s>")), ("glmedge", ("<|assistant|>", "<|user|>")), ("glmedge", ("<|{{ item['role'] }}|>", "<|begin_of_image|>")),
    ("zephyr", ("<|user|>", "<|endoftext|>")), ("monarch", ("bos_token + message['role']",)), ("gemma", ("<start_of_turn>",)), ("orion", ("'\\n\\nAssistant: ' + eos_token",)), ("openchat", ("GPT4 Correct ",)),
    ("vicuna_orca", ("USER: ", "ASSISTANT: ", "SYSTEM: ")), ("vicuna", ("USER: ", "ASSISTANT: ")), ("deepseek", ("### Instruction:", "<|EOT|>")), ("command_r", ("<|START_OF_TURN_TOKEN|>", "<|USER_TOKEN|>")), ("llama3", ("<|start_header_id|>", "<|end_header_id|>")),
    ("chatglm3", ("[gMASK]sop",)), ("minicpm", ("<用户>",)), ("deepseek2", ("'Assistant: ' + message['content'] + eos_token",)), ("deepseek3", ("<｜Assistant｜>", "<｜User｜>", "<｜end▁of▁sentence｜>")), ("exaone4", ("[|system|]", "[|assistant|]", "[|endofturn|]", "[|tool|]")), ("exaone3", ("[|system|]", "[|assistant|]", "[|endofturn|]")),
    ("rwkv_world", ("rwkv-world",)), ("rwkv_world", ("{{- 'User: ' + message['content']|trim + '\\n\\n' -}}",)), ("granite", ("<|start_of_role|>",)), ("gigachat", ("message['role'] + additional_special_tokens[0] + message['content'] + additional_special_tokens[1]",)), ("megrez", ("<|role_start|>",)), ("yandex", (" Ассистент:",)), ("bailing", ("<role>ASSISTANT</role>", "'HUMAN'")),
    ("llama4", ("<|header_start|>", "<|header_end|>")), ("dots1", ("<|endofuserprompt|>",)), ("hunyuan_moe", ("<|extra_0|>", "<|extra_4|>")), ("gpt_oss", ("<|start|>", "<|channel|>")), ("hunyuan_dense", ("<｜hy_Assistant｜>", "<｜hy_place▁holder▁no▁3｜>")), ("kimi_k2", ("<|im_assistant|>assistant<|im_middle|>",)), ("seed_oss", ("<seed:bos>",)),
]


def detected(template: Column) -> Column:
    """The format that a template's name or text belongs to; null if none is known."""
    names = sorted({*TEMPLATES, *BY_ROLE, *BY_PLACE})
    out = F.when(F.replace(template, F.lit("-"), F.lit("_")).isin(*names), F.replace(template, F.lit("-"), F.lit("_")))
    for name, marks in MARKS:
        here = [F.startswith(template, F.lit(m[1:])) if m[0] == "^" else F.contains(template, F.lit(m)) for m in marks]
        cond = here[0]
        for c in here[1:]:
            cond = cond & c
        out = out.when(cond, F.lit(name))
    return out
