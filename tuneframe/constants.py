"""Fixed values that results depend on.

These are plain data, gathered in one place. Operators take them as
default parameters so a caller can override any of them.
"""

# --- fixed values: dataset validation -------------------------------------
REQUIRED_FIELDS = ("instruction", "input", "output", "workflow", "success_condition")
EXPECTED_RECORDS = 172
MAX_DATASET_BYTES = 50 * 1024 * 1024
MAX_MODEL_BYTES = 50 * 1024 * 1024 * 1024
MAX_MODEL_FILES = 4000
DATASET_SUFFIXES = (".jsonl", ".json")

# --- fixed values: whitespace as Python's str.strip()/str.isspace() sees it --
# (29 code points: TAB LF VT FF CR, FS GS RS US, SPACE, NEL, NBSP, OGHAM SPACE,
#  EN QUAD..HAIR SPACE, LINE SEP, PARAGRAPH SEP, NNBSP, MMSP, IDEOGRAPHIC SPACE)
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- fixed values: ids and names ------------------------------------------
UPLOAD_ID_PATTERN = r"\A[0-9a-f]{32}\z"
SAFE_NAME_BAD_RUN = r"[^A-Za-z0-9._-]+"
SAFE_NAME_STRIP = "._"
SAFE_NAME_MAX = 160
SAFE_NAME_DEFAULT = "upload.jsonl"
REPO_ID_PATTERN = r"\A[A-Za-z0-9][A-Za-z0-9_.-]*/[A-Za-z0-9][A-Za-z0-9_.-]*\z"
REPO_ID_LENGTH = (3, 200)
REVISION_PATTERN = r"\A[A-Za-z0-9_.-]+\z"
REVISION_LENGTH = (1, 100)
DEFAULT_REVISION = "main"

# --- fixed values: training requests (name, default, low, low_inclusive, high)
METHODS = ("lora", "qlora")
REQUEST_RULES = (
    ("epochs", 3, 1, True, 20),
    ("learning_rate", 0.0002, 0.0, False, 0.01),
    ("rank", 16, 1, True, 64),
    ("alpha", 16, 1, True, 128),
    ("dropout", 0.0, 0.0, True, 0.5),
    ("batch_size", 1, 1, True, 2),
    ("sequence_length", 512, 128, True, 2048),
)
COMMAND_MAX_CHARS = 4000
TRAIN_MAX_TOKENS = 512
INFER_MAX_TOKENS = 1024
MAX_NEW_TOKENS = 120
TRAIN_SEED = 3407

# --- fixed values: job states ----------------------------------------------
STATUSES = ("queued", "loading", "running", "completed", "failed")
ACTIVE_STATUSES = ("queued", "loading", "running")
ALLOWED_TRANSITIONS = (
    ("queued", "loading"),
    ("loading", "running"),
    ("running", "running"),
    ("running", "completed"),
    ("queued", "failed"),
    ("loading", "failed"),
    ("running", "failed"),
)
INTERRUPTED_ERROR = "Backend restarted before this training job completed."
INTERRUPTED_MESSAGE = "Training was interrupted by a backend restart"
OOM_MARKER = "out of memory"
OOM_ADVICE = "GPU ran out of memory. Retry with a shorter sequence length or a smaller base model."
DEFAULT_MODEL_NAME = "Trained model"
EMPTY_RESPONSE_NOTICE = "The model returned an empty response."

# --- fixed values: prompt text ---------------------------------------------
USER_HEADINGS = ("Instruction", "Input", "Required workflow", "Success condition")
RESPONSE_HEADING = "Response"
INFERENCE_INSTRUCTION = "Follow the workflow for this command."
INFERENCE_WORKFLOW = "List the ordered actions and checks."
INFERENCE_SUCCESS = "State how success will be verified."

# --- fixed values: model artifacts -------------------------------------------
WEIGHT_SUFFIXES = (".safetensors", ".bin")
TOKENIZER_FILES = ("tokenizer.json", "tokenizer.model", "spiece.model", "sentencepiece.bpe.model", "vocab.txt")
TOKENIZER_PAIR = ("vocab.json", "merges.txt")
SHARD_INDEX_FILES = ("model.safetensors.index.json", "pytorch_model.bin.index.json")
CAUSAL_MARKERS = ("ForCausalLM", "LMHeadModel")
ADAPTER_CANDIDATES = ("q_proj", "k_proj", "v_proj", "o_proj", "gate_proj", "up_proj", "down_proj", "c_attn", "c_proj", "c_fc")
SAFETENSORS_MAX_HEADER = 100 * 1024 * 1024
BIN_MAGICS = (b"PK\x03\x04", b"\x80")
MISSING_SHARDS_SHOWN = 5
ADAPTER_ARCHIVE_PREFIX = "adapter/"
