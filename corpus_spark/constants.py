"""Wordings, ids and defaults that results depend on."""

# Label texts and their codes.
TARGET_TO_LABEL = {"ai写的": 0, "人类写的": 1}
LABEL_TO_TARGET = {0: "ai写的", 1: "人类写的"}

# Prompt rows.
PROMPT_INSTRUCTION = "将以下文本归类为AI编写还是人类编写？"
PROMPT_OUTPUTS = {0: "AI编写", 1: "人类编写"}

# Segment separators, in the order they are tried.
PIPE_SEPARATOR = "|||||"
PIPE_SOURCE = "multi_news"
SEPARATORS = ("　　", "\n\n", "  ")
INPUT_MAX_LENGTH = 512

# Templates for training rows.
TRAIN_OPTIONS = "选项:\n0\n1"
SUMMARY_PROMPT = "summarize this article: {sentence1}"
TRAIN_PROMPT = "### 指示:下面这篇文章是谁写的?\n{options_}\n\n### 输入:{sentence1}\n\n### 回答:"
INSTRUCTION_TEMPLATE = (
    "Below is an instruction that describes a task. "
    "Write a response that appropriately completes the request.\n\n"
    "### Instruction:\n{instruction}\n\n### Response: "
)

# Templates for sequence-to-sequence rows.
SEQ2SEQ_OPTIONS = "选项:ai写的,人类写的"
SEQ2SEQ_PROMPT = "下面这篇文章是AI写的还是人类写的?{options_}。{sentence1}"

# Templates and answer marker for inference text.
INFERENCE_PROMPT = "### 指示:下面这篇文章是谁写的?{options_}\n\n### 输入:{sentence1}\n\n### 回答:\n"
INFERENCE_WITH_INPUT = (
    "Below is an instruction that describes a task, paired with an input that provides further context. "
    "Write a response that appropriately completes the request.\n\n"
    "### Instruction:\n{instruction}\n\n### Input:\n{input}\n\n### Response:"
)
INFERENCE_NO_INPUT = (
    "Below is an instruction that describes a task. "
    "Write a response that appropriately completes the request.\n\n"
    "### Instruction:\n{instruction}\n\n### Response:"
)
ANSWER_MARKER = "### 回答:"

# Special tokens, in the order they are added, and the ignored label.
SPECIAL_TOKENS = (("pad", "[PAD]"), ("eos", "</s>"), ("bos", "</s>"), ("unk", "</s>"))
PAD_ID = 0
EOS_ID = 1
UNK_ID = 1
IGNORE_INDEX = -100

# Columns a trainer accepts.
TRAINER_COLUMNS = ("attention_mask", "input_ids", "labels", "token_type_ids")

# Seeds, packing and reporting sizes.
SHUFFLE_SEED = 5
TRIM_SEED = 42
MAP_BATCH_ROWS = 1000
MAX_DEFAULT_BLOCK = 1024
RATIO_EXAMPLES = 400
BUFFER_SEQUENCES = 1024
REPORT_SAMPLE = 16

# Fixed value: the word between the two parts of a test case.
CASE_JOINER = "输入"
