"""Texts, markers and numbers the results depend on.

Nothing here is tunable logic. Results only match if these are exactly as they are.
"""

# The 29 characters str.strip() removes.
WHITESPACE = (
    "\u0009\u000a\u000b\u000c\u000d"
    "\u001c\u001d\u001e\u001f\u0020"
    "\u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Patterns (Java regex syntax).
BOXED_PATTERN = r"\\boxed\{([^}]*)\}"
THINK_PATTERN = r"(?is)<think>(.*?)</think>"
PIECE_PATTERN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\t\n\x0B\f\r ]"

# Tags.
REASONING_OPEN = "<reasoning>"
REASONING_CLOSE = "</reasoning>"
ANSWER_OPEN = "<answer>"
ANSWER_CLOSE = "</answer>"

# Chat markers.
BOS = "<bos>"
USER_TURN = "<start_of_turn>user\n"
MODEL_TURN = "<start_of_turn>model\n"
END_OF_TURN = "<end_of_turn>\n"

# Prompt texts.
INSTRUCTION_SUFFIX = (
    "\n\nPlease reason step by step, and put your thoughts within <reasoning> and </reasoning> tags, "
    "and your final answer within <answer> and </answer> tags."
)
TEACHER_SYSTEM = (
    "You are a helpful assistant. You must first think about the answer and enclose your reasoning process "
    "within <reasoning> and </reasoning> tags. Then, provide your final answer within <answer> and </answer> tags."
)
# A real backslash stands before "boxed"; a backspace character there would be unreadable to a model.
REWARD_SYSTEM = (
    "A conversation between User and Assistant. The user asks a question, and the Assistant solves it.\n"
    "The assistant first thinks about the reasoning process in the mind and then provides the user with the answer.\n"
    "The reasoning process must be enclosed within <reasoning> and </reasoning> tags.\n"
    "Finally, place the exact final answer inside \\boxed{}.\n"
)

# Numbers.
IGNORED_LABEL = -100
SHUFFLE_SEED = 42
MAX_SAMPLES = 20000
MAX_TOKENS = 8192
PROMPT_MAX_TOKENS = 2048
PREVIEW_CHARS = 500
GENERATIONS_PER_PROMPT = 4
GENERATION_BATCH = 4
FORMAT_REWARD = 1.0
CORRECT_REWARD = 2.0
LOSS_ALPHA = 0.5
LOSS_TEMPERATURE = 2.0
ADVANTAGE_EPS = 1e-4

# Ids the built-in vocabulary keeps free.
PAD_ID = 0
BOS_ID = 1
UNK_ID = 2
RESERVED_IDS = 3
