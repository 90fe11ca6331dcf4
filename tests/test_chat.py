"""Chat prompts against expected texts, with a tool's turn, a null text and an assistant's turn at the end."""

import pytest
from pyspark.sql import functions as F

from vecquill.operators import chat

TURNS = [(0, "system", "Be brief."), (1, "user", " Hi "), (2, "assistant", "Yes?"), (3, "tool", "42"), (4, "user", None), (5, "assistant", "Done")]
EXPECTED = {
    "chatml": "<|im_start|>system\nBe brief.<|im_end|>\n<|im_start|>user\n Hi <|im_end|>\n<|im_start|>assistant\nYes?<|im_end|>\n<|im_start|>tool\n42<|im_end|>\n<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\nDone<|im_end|>\n<|im_start|>assistant\n",
    "openchat": "Be brief.<|end_of_turn|>GPT4 Correct User:  Hi <|end_of_turn|>GPT4 Correct Assistant: Yes?<|end_of_turn|>GPT4 Correct Tool: 42<|end_of_turn|>GPT4 Correct User: <|end_of_turn|>GPT4 Correct Assistant: Done<|end_of_turn|>GPT4 Correct Assistant:",
    "chatglm3": "[gMASK]sop<|system|>\n Be brief.<|user|>\n  Hi <|assistant|>\n Yes?<|tool|>\n 42<|user|>\n <|assistant|>\n Done<|assistant|>",
    "chatglm4": "[gMASK]<sop><|system|>\nBe brief.<|user|>\n Hi <|assistant|>\nYes?<|tool|>\n42<|user|>\n<|assistant|>\nDone<|assistant|>\n",
    "glmedge": "<|system|>\nBe brief.<|user|>\n Hi <|assistant|>\nYes?<|tool|>\n42<|user|>\n<|assistant|>\nDone<|assistant|>",
    "bailing": "<role>SYSTEM</role>Be brief.<role>HUMAN</role> Hi <role>ASSISTANT</role>Yes?<role>TOOL</role>42<role>HUMAN</role><role>ASSISTANT</role>Done<role>ASSISTANT</role>",
    "granite": "<|start_of_role|>system<|end_of_role|>Be brief.<|end_of_text|>\n<|start_of_role|>user<|end_of_role|> Hi <|end_of_text|>\n<|start_of_role|>assistant<|end_of_role|>Yes?<|end_of_text|>\n<|start_of_role|>tool<|end_of_role|>42<|end_of_text|>\n<|start_of_role|>user<|end_of_role|><|end_of_text|>\n<|start_of_role|>assistant<|end_of_role|>Done<|end_of_text|>\n<|start_of_role|>assistant<|end_of_role|>\n",
    "llama3": "<|start_header_id|>system<|end_header_id|>\n\nBe brief.<|eot_id|><|start_header_id|>user<|end_header_id|>\n\nHi<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\nYes?<|eot_id|><|start_header_id|>tool<|end_header_id|>\n\n42<|eot_id|><|start_header_id|>user<|end_header_id|>\n\n<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\nDone<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n",
    "gemma": "<start_of_turn>user\nBe brief.\n\nHi<end_of_turn>\n<start_of_turn>model\nYes?<end_of_turn>\n<start_of_turn>tool\n42<end_of_turn>\n<start_of_turn>user\n<end_of_turn>\n<start_of_turn>model\nDone<end_of_turn>\n<start_of_turn>model\n",
    "vicuna": "Be brief.\n\nUSER:  Hi \nASSISTANT: Yes?</s>\nUSER: \nASSISTANT: Done</s>\nASSISTANT:",
    "mistral_v7": "[SYSTEM_PROMPT] Be brief.[/SYSTEM_PROMPT][INST]  Hi [/INST] Yes?</s> 42</s>[INST] [/INST] Done</s>",
    "monarch": "system\nBe brief.</s>\n<s>user\n Hi </s>\n<s>assistant\nYes?</s>\n<s>tool\n42</s>\n<s>user\n</s>\n<s>assistant\nDone</s>\n<s>assistant\n",
    "kimi_k2": "<|im_system|>system<|im_middle|>Be brief.<|im_end|><|im_user|>user<|im_middle|> Hi <|im_end|><|im_assistant|>assistant<|im_middle|>Yes?<|im_end|><|im_system|>tool<|im_middle|>42<|im_end|><|im_user|>user<|im_middle|><|im_end|><|im_assistant|>assistant<|im_middle|>Done<|im_end|><|im_assistant|>assistant<|im_middle|>",
}


@pytest.mark.parametrize("name", EXPECTED)
def test_prompts(spark, name):
    rows = spark.createDataFrame([(7, *t) for t in TURNS], "conv_id long, turn int, role string, text string").repartition(3)
    assert chat.prompts(rows, name).first().prompt == EXPECTED[name]
    without = chat.prompts(rows, name, add_assistant=False).first().prompt
    assert EXPECTED[name].startswith(without)


def test_tool_calls_and_unknown_formats(spark):
    rows = spark.createDataFrame([(1, 0, "assistant_tool_call", "f(x)")], "conv_id long, turn int, role string, text string")
    assert chat.prompts(rows, "granite", False).first().prompt == "<|start_of_role|>assistant_tool_call<|end_of_role|><|tool_call|>f(x)<|end_of_text|>\n"
    with pytest.raises(ValueError):
        chat.prompts(rows, "no such format")


def test_detection(spark):
    cases = {"chatml": "chatml", "mistral-v1": "mistral_v1", "a <|im_start|> b": "chatml", "<|im_start|><|im_sep|>": "phi4", "[INST] x": "llama2", "x [INST] <<SYS>>": "llama2_sys", "[AVAILABLE_TOOLS] [INST]": "mistral_v1", "[INST][AVAILABLE_TOOLS]": "mistral_v3", "mistral of some kind": "llama2", "<|assistant|><|user|></s>": "falcon3", "<|assistant|><|user|>": "glmedge", "<start_of_turn>": "gemma", "USER: ASSISTANT: SYSTEM: ": "vicuna_orca", "nothing": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.d for r in rows.select("t", chat.detected(F.col("t")).alias("d")).collect()} == cases
