"""Fixed values.

The values in the block below must equal the evaluated harness's for identical
results (label space, answer pattern, sentinels, sub-task names, routing rules).
They are stated plainly and in their natural order.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the evaluated harness)
# ---------------------------------------------------------------------------

# Answer a response may start with: optional "(", a label, optional one of . , : ; )
CHOICE_PATTERN = r"\(?(-1|[0-5]|[A-B]|yes|no)[.,:;)]?"
# Returned when no label is found, and its integer code.
INVALID_LABEL = "-100"
INVALID_CODE = -100
# Gold id when an item has no correct choice.
NO_GOLD = -1
# Valid ratings for the vote-distribution distance.
RATING_MIN, RATING_MAX = 1, 5
# Added to the standard deviation when all votes agree.
SD_EPSILON = 1e-3
# Placeholder for an inline image in prompt text.
IMAGE_TOKEN = "<image>"
# Prefix of a data URL; the media type is fixed whatever the file type.
DATA_URL_PREFIX = "data:image/jpeg;base64,"
# URL schemes (case-sensitive).
URL_SCHEMES = ("http://", "https://")
# Label codes for two-way tasks.
A_B_CODES = {"A": 0, "B": 1}
YES_NO_CODES = {"no": 0, "yes": 1}
# Sub-subtasks.
SELECTION_SUB_SUBTASKS = ("choice2_ans1", "choice3_ans1", "choice4_ans1", "choice5_ans1", "random")
MULTI_CHOICE_SUB_SUBTASKS = ("choice2_ans1", "choice3_ans1", "choice4_ans1", "choice5_ans1")
RANDOM_SUB_SUBTASK = "random"
# Characters Python's str.strip() removes (str.isspace() is true).
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a regular-expression class (Java syntax).
PY_WHITESPACE_CLASS = r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# The same set for RE2 (DuckDB oracles).
PY_WHITESPACE_CLASS_RE2 = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# Separator between a system text folded into a user turn, and the user text.
FOLD_SEPARATOR = "\n\n"
# Valid (lang, task, sub_task) combinations.
TASK_COMBINATIONS = (
    ("ja", "perception", "generation"),
    ("ja", "perception", "selection"),
    ("ja", "commonsense", "generation"),
    ("ja", "commonsense", "classification"),
    ("ja", "taxonomic", "a_b_classification"),
    ("ja", "taxonomic", "yes_no_classification"),
    ("ja", "taxonomic", "multiple_choice_classification"),
    ("en", "perception", "selection"),
    ("en", "commonsense", "classification"),
)
# Decoding settings shared by every task configuration.
DEFAULT_GEN_PARAMS = {"max_new_tokens": 1024, "do_sample": True, "temperature": 0.01, "top_p": 1.0, "num_beams": 1}

# Model routing: ordered rules, first match wins.  Each rule is
# (backend, family, substrings that must all occur, alternatives of which at
#  least one must occur or None).  A rule whose family is None matches and
# reports the name as unsupported.
ROUTING_RULES = (
    ("hf", "mllama_instruct", ("llama-3.2", "vision"), ("instruct",)),
    ("hf", None, ("llama-3.2", "vision"), None),
    ("hf", "llava", ("llava",), ("1.5", "v1.5")),
    ("hf", "llava_next", ("llava",), ("next", "1.6", "v1.6")),
    ("hf", "llava_onevision", ("llava",), ("onevision",)),
    ("hf", None, ("llava",), None),
    ("hf", "idefics2", ("idefics2",), None),
    ("hf", "idefics3", ("idefics3",), None),
    ("hf", "qwen2_vl", ("qwen2-vl",), None),
    ("hf", "molmo", ("molmo",), None),
    ("hf", "llama3_instruct", ("llama-3",), ("instruct",)),
    ("hf", None, ("llama-3",), None),
    ("hf", "llama2_instruct", ("llama-2",), ("chat", "instruct")),
    ("hf", None, ("llama-2",), None),
    ("hf", "gemma2_instruct", ("gemma-2",), None),
    ("hf", "qwen2_5_instruct", ("qwen2.5",), ("instruct",)),
    ("hf", None, ("qwen2.5",), None),
    ("hf", "qwen2_instruct", ("qwen2",), ("instruct",)),
    ("hf", None, ("qwen2",), None),
    ("hf", "llm_jp_3_instruct", ("llm-jp-3",), ("instruct",)),
    ("hf", None, ("llm-jp-3",), None),
    ("vllm", "mllama_instruct", ("llama-3.2", "vision"), ("instruct",)),
    ("vllm", None, ("llama-3.2", "vision"), None),
    ("vllm", "llava", ("llava",), ("1.5", "v1.5")),
    ("vllm", "llava_next", ("llava",), ("next", "1.6", "v1.6")),
    ("vllm", "llava_onevision", ("llava",), ("onevision",)),
    ("vllm", None, ("llava",), None),
    ("vllm", "idefics2", ("idefics2",), None),
    ("vllm", "idefics3", ("idefics3",), None),
    ("vllm", "qwen2_vl_vllm", ("qwen2-vl",), None),
    ("vllm", "molmo", ("molmo",), None),
    ("api", "gpt4o", ("gpt-4",), None),
)
# Only this family runs on the batch engine; the others are local wrappers.
BATCH_CAPABLE_FAMILIES = ("qwen2_vl_vllm",)
# Hosted-API parameter defaults, filled only for absent keys (in this order).
API_PARAM_DEFAULTS = {
    "max_completion_tokens": 1024, "n": 1, "presence_penalty": 0, "frequency_penalty": 0, "logit_bias": None,
    "logprobs": False, "top_logprobs": None, "seed": 42, "temperature": 0.0, "top_p": 1.0,
}
# Batch-engine parameter defaults, filled only for absent keys (in this order).
BATCH_PARAM_DEFAULTS = {
    "max_tokens": 1024, "temperature": 0, "top_p": 1.0, "n": 1, "presence_penalty": 0,
    "frequency_penalty": 0, "repetition_penalty": 1.0, "logit_bias": None, "logprobs": False, "seed": 42,
}
# Local-model defaults; temperature and top_p only apply when sampling.
LOCAL_PARAM_DEFAULTS = {"max_new_tokens": 1024, "do_sample": True, "num_beams": 1, "use_cache": True}
LOCAL_SAMPLING_DEFAULTS = {"temperature": 0.05, "top_p": 1.0}
# Retry policy of the hosted responder: attempts, first wait (s), growth factor.
RETRY_ATTEMPTS, RETRY_FIRST_WAIT, RETRY_FACTOR = 5, 10.0, 2.0

# Chat formats (public model prompt formats), one block per format.
CHATML = {"start": "<|im_start|>", "end": "<|im_end|>", "default_system": "You are a helpful assistant."}
INST = {"bos": "<s>", "eos": "</s>", "inst_open": "[INST] ", "inst_close": " [/INST]",
        "sys_open": "<<SYS>>\n", "sys_close": "\n<</SYS>>\n\n"}
HEADER = {"bos": "<|begin_of_text|>", "header_open": "<|start_header_id|>", "header_close": "<|end_header_id|>\n\n",
          "eot": "<|eot_id|>", "knowledge_line": "Cutting Knowledge Date: December 2023\n",
          "date_prefix": "Today Date: ", "default_date": "26 Jul 2024"}
TURN = {"bos": "<bos>", "start": "<start_of_turn>", "end": "<end_of_turn>\n", "assistant_role": "model"}
INSTRUCTION_RESPONSE = {"bos": "<s>", "eos": "</s>", "user_header": "\n\n### 指示:\n",
                        "response_header": "\n\n### 応答:\n"}

# How each wrapper family assembles a request:
# (vision, system handling, placeholder handling, text chat format, default system text).
# system handling: "role" system turn, "user" system text as a user turn,
#   "fold" system text prefixed to the first user turn, "flat" one flat text.
# placeholder handling: "check" count only, "strip" check then remove,
#   "fill" check then add only the missing images, "none" text-only model.
MODEL_PROFILES = {
    "gpt4o": (True, "role", "check", None, None),
    "llava": (True, "role", "strip", None, None),
    "llava_next": (True, "role", "strip", None, None),
    "llava_onevision": (True, "role", "strip", None, None),
    "idefics2": (True, "role", "fill", None, None),
    "idefics3": (True, "role", "fill", None, None),
    "qwen2_vl": (True, "role", "strip", None, None),
    "qwen2_vl_vllm": (True, "role", "strip", None, None),
    "mllama_instruct": (True, "user", "strip", None, None),
    "molmo": (True, "flat", "strip", "flat", None),
    "llama3_instruct": (False, "role", "none", "header", None),
    "llama2_instruct": (False, "role", "none", "inst", None),
    "gemma2_instruct": (False, "fold", "none", "turn", None),
    "qwen2_instruct": (False, "role", "none", "chatml", "You are a helpful assistant."),
    "qwen2_5_instruct": (False, "role", "none", "chatml", "You are Qwen, created by Alibaba Cloud. You are a helpful assistant."),
    "llm_jp_3_instruct": (False, "role", "none", "instruction_response", None),
}

# ---------------------------------------------------------------------------
# end of fixed values
# ---------------------------------------------------------------------------
