"""Fixed values that must equal the reference's for equal results.

Fixed values (stated plainly, in natural order):
"""

# --- fixed values: audio markup -------------------------------------------------
BOA_TOKEN = "<|beginofaudio|>"
EOA_TOKEN = "<|endofaudio|>"
CODE_TEMPLATE_PREFIX = "<|AUDIO"  # a code c is rendered as <|AUDIO{c}|>
CODE_TEMPLATE_SUFFIX = "|>"
CODE_VOCAB_SIZE = 4096
UNICODE_OFFSET = 0x4E00  # code c <-> chr(c + 0x4E00)

# --- fixed values: chat rendering -----------------------------------------------
SYSTEM_PROMPT = "You are a helpful assistant."
TTS_INSTRUCTION_PREFIX = "Convert the following text to audible speech.\n"  # followed by the text
# ChatML-style turn markup (public format): <|im_start|>{role}\n{content}<|im_end|>\n
TURN_START = "<|im_start|>"
TURN_END = "<|im_end|>"

# --- fixed values: labels, capacities, thresholds --------------------------------
IGNORE_INDEX = -100
PACK_CAPACITY = 4096          # corpus packing job
PACK_BUCKETS = 64             # packing buckets unless given; our own choice
STREAM_CAPACITY = 2048        # streaming packer default
STREAM_BUFFER = 100           # streaming packer buffer
CER_THRESHOLD = 10.0          # keep rows with cer < 10.0
MIN_SAMPLES = 8000            # keep clips with >= 8000 samples
SAMPLE_RATE = 24000
ENCODER_RATIOS = (8, 5, 4, 2)  # hop 320
KMEANS_ITERS = 10
EMA_DECAY = 0.99
EMA_EPSILON = 1e-5
DEAD_CODE_THRESHOLD = 2
RMS_EPSILON = 1e-8
SAFE_LOG_CLIP = 1e-7
PEAK_LIMIT = 0.99
CDF_ROUNDOFF = 1e-8
CDF_MIN_RANGE = 2
THROUGHPUT_WINDOW = 50
CHECKPOINT_PREFIX = "vocos_"
CHECKPOINT_PARAM_PREFIXES = ("backbone.", "head.", "feature_extractor.")
TOPK_CHECKPOINTS = 3
SHARD_GROUP = 32              # shards per incremental group, output shard_%03d
SHARD_MIN_ROWS = 15000        # rows per written tar shard (at least)
JSONL_MIN_ROWS = 50000        # rows per written JSON-lines file (at least)
