"""Texts and patterns that decide results and therefore must not drift."""

# --- fixed values: special tokens, in id order -------------------------------------------
SPECIAL_TOKENS = [
    "<|endoftext|>",
    "<|im_start|>",
    "<|im_end|>",
    "<|object_ref_start|>",
    "<|object_ref_end|>",
    "<|box_start|>",
    "<|box_end|>",
    "<|quad_start|>",
    "<|quad_end|>",
    "<|vision_start|>",
    "<|vision_end|>",
    "<|vision_pad|>",
    "<|image_pad|>",
    "<|video_pad|>",
    "<tool_call>",
    "</tool_call>",
    "<|fim_prefix|>",
    "<|fim_middle|>",
    "<|fim_suffix|>",
    "<|fim_pad|>",
    "<|repo_name|>",
    "<|file_sep|>",
    "<tool_response>",
    "</tool_response>",
    "<think>",
    "</think>",
]
ADDITIONAL_SPECIAL_TOKENS = SPECIAL_TOKENS[1:14]
SMALL_SPECIAL_TOKENS = SPECIAL_TOKENS[:3]
# End of text, padding, additional tokens.
CHAT_ROLES = ("<|im_end|>", "<|endoftext|>", ADDITIONAL_SPECIAL_TOKENS)
PLAIN_ROLES = ("<|endoftext|>", "<|endoftext|>", ["<|im_start|>", "<|im_end|>"])
THINK_END = "</think>"

# --- fixed values: sizes -----------------------------------------------------------------
VOCAB_SIZE = 151936
MAX_LENGTH = 1024
CHAR_VOCAB_SIZE = 32000
MAX_CHAR_PIECE = 32
SAMPLE_ROWS_PER_FILE = 10000
LENGTH_PERCENTILES = [0.5, 0.75, 0.9, 0.95, 0.99]
HEADROOM = 1.05
IGNORED_LABEL = -100
CHECKPOINT_EVERY = 500

# --- fixed values: file formats, in discovery order --------------------------------------
FORMATS = {
    "jsonl": [".jsonl"],
    "parquet": [".parquet"],
    "text": [".txt", ".text"],
    "json": [".json"],
    "csv": [".csv"],
}

# --- fixed values: splitting patterns (Java syntax) --------------------------------------
PIECE_PATTERN = (
    r"(?U)(?i:'s|'t|'re|'ve|'m|'ll|'d)"
    r"|[^\r\n\p{L}\p{N}]?[^\s\p{L}\p{N}]++[\r\n]*+"
    r"|\s*[\r\n]+"
    r"|\s++"
    r"|[\p{L}\p{N}]++"
)
DIGIT_PATTERN = r"\p{N}|[^\p{N}]++"

# --- fixed values: chat texts ------------------------------------------------------------
DEFAULT_SYSTEM = "You are a helpful assistant"
TOOLS_INTRO = (
    "# Tools\n\nYou may call one or more functions to assist with the user query.\n\n"
    "You are provided with function signatures within <tools></tools> XML tags:\n<tools>"
)
TOOLS_OUTRO = (
    "\n</tools>\n\nFor each function call, return a json object with function name and arguments "
    "within <tool_call></tool_call> XML tags:\n<tool_call>\n"
    '{"name": <function-name>, "arguments": <args-json-object>}\n</tool_call>'
)
