"""Fixed values of the data model and the default parameters of each operator."""

# --- fixed values -----------------------------------------------------------
# Window geometry.
TUBELET_RAW_FRAMES = 64
LATENT_SHAPE = (32, 24, 24, 768)
TARGET_FPS = 4

# Row defaults of the latent table.
UNKNOWN = "unknown"
UNKNOWN_INDEX = -1
UNMEASURED_FLOW = -1.0
SAMPLE_TAG = "iid_sample"

# Calibration.
STATIC_TARGET = 1000
EPSILON_PERCENTILE = 0.95
TAU_PERCENTILE = 0.20
CHECKPOINT_STEP = 1000
CONVERGENCE_TOLERANCE = 1e-4
ROW_STOP_MIN_SAMPLES = 5000
ROW_STOP_MIN_CHECKPOINTS = 3
FILE_STOP_PATIENCE = 3
MIN_TUBELETS_FOR_EPSILON = 100
FLOW_CLIP = 50.0
PREFILTER_THRESHOLD = 15.0

# Corpus.
DEFAULT_FACTORIES = [
    "factory_001",
    "factory_002",
    "factory_003",
    "factory_010",
    "factory_020",
    "factory_030",
    "factory_040",
    "factory_050",
]
MAX_VIDEOS_PER_FACTORY = 500
TARGET_TUBELETS = 25_000
SHARD_BYTES = 1024 ** 3

# Serving.
SPLIT_BUCKETS = 10
VALIDATION_BUCKET = 0
TUBELETS_PER_EPOCH = 5000
BATCH_SIZE = 8
FALLBACK_STEPS_PER_EPOCH = 100
SEED = 42

# Evaluation.
SHIFT_PAIRS = 30
VALIDATION_VARIANCE_BATCHES = 10
EARLY_STOP_PATIENCE = 10
HUBER_BETA_MIN = 0.50
HUBER_BETA_MAX = 0.99
HUBER_ALPHA = 2.0
HUBER_ETA = 1e-8

# Channel standardisation of RGB values.
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)

# --- scale limits -----------------------------------------------------------
# Scalar rows one task may sort or hold; larger groups are split.
MAX_TASK_ROWS = 4_000_000
# Values the built-in exact percentile may hold in its one buffer.
MAX_PERCENTILE_ROWS = 1_000_000
# Upper bound on the number of keys sent to every executor.
MAX_HOT_KEYS = 65_536
# Row addresses sent to every executor; more are joined by shuffle.
MAX_BROADCAST_ROWS = 1_000_000
# Identities pushed into one scan of payloads, and scans of a fetch that has them pushed.
MAX_PUSHED_KEYS = 500
MAX_PUSHED_SCANS = 64
# Buckets of a store that is laid out by identity.
STORE_BUCKETS = 64
# Parts one group's top-n is cut in before its rows meet.
TOP_N_SALTS = 256
