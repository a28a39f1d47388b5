"""Limits, weights and labels of the drift monitor."""

# These decide results and must stay as they are.
EWMA_ALPHA = 0.1
LAPLACE_EPSILON = 1e-3
MAX_FIELD_DEPTH = 5
MAX_FIELDS = 500
MAX_VOCABULARY = 1000
MAX_ENUM = 50
MAX_MASK_DEPTH = 10
NEWEST_PER_WINDOW = 1000
OLDEST_PER_BASELINE = 500
REPLAY_CHUNK = 100
MODEL_VERSION = "1.0.0"
ALERT_KEY_SECONDS = 3600
TRIGGER_COUNT, TRIGGER_SECONDS = 100, 900
DELIVERIES = 5
PERSIST_UP, PERSIST_DOWN, PERSIST_SECONDS = 4.0, 2.0, 86_400

# What makes a detector fire.
Z_TRIGGER, Z_CAP = 2.0, 10.0
PSI_TRIGGER, JSD_TRIGGER = 0.25, 0.15
STATUS_DIFF_MIN, ERROR_STATUS = 0.01, 400
ENTROPY_MIN, ENTROPY_DROP = 0.1, 0.3
NULL_RATE_RISE, PRESENCE_DROP, PRESENCE_MIN = 0.05, 0.1, 0.5
CONSISTENCY_MIN, CONSISTENCY_DROP, TYPE_CONSISTENCY_MIN = 0.95, 0.05, 0.8
VOCABULARY_RATIO = 0.5

# Weight and label of each kind of drift.
DRIFT_WEIGHTS = {
    "field_disappeared": 2.0,
    "schema_type_change": 1.8,
    "null_rate_spike": 1.5,
    "structural_change": 1.4,
    "type_consistency_drop": 1.3,
    "presence_rate_drop": 1.3,
    "enum_collapse": 1.2,
    "vocabulary_collapse": 1.2,
    "payload_entropy_drop": 1.1,
    "status_code_shift": 1.0,
    "numeric_distribution_shift": 1.0,
    "latency_shift": 0.8,
    "response_size_shift": 0.7,
}
DRIFT_LABELS = {
    "null_rate_spike": "null rate increased",
    "field_disappeared": "field disappeared",
    "enum_collapse": "enum distribution collapsed",
    "numeric_distribution_shift": "numeric distribution shifted",
    "payload_entropy_drop": "payload entropy dropped",
    "latency_shift": "latency shifted",
    "response_size_shift": "response size shifted",
    "type_consistency_drop": "type consistency dropped",
    "vocabulary_collapse": "vocabulary collapsed",
    "status_code_shift": "error rate increased",
    "structural_change": "new field appeared",
    "schema_type_change": "field type changed",
    "presence_rate_drop": "field presence rate dropped",
}
NO_DRIFT = "No significant behavioral drift detected."

# Maturity by sample count, its look-back and its weights in a confidence.
MATURITY_UP_TO = ((99, "initializing"), (999, "learning"), (4999, "stabilizing"))
MATURE, SPARSE, SPARSE_DAILY_RATE = "production_trusted", "sparse_traffic", 100
WINDOW_DAYS = {"initializing": 0, "learning": 3, "stabilizing": 7, "production_trusted": 14, "sparse_traffic": 30}
MATURITY_SCORE = {"initializing": 0.1, "learning": 0.35, "stabilizing": 0.65, "production_trusted": 1.0, "sparse_traffic": 0.3}
CONFIDENCE_WEIGHTS = {
    "initializing": (0.50, 0.30, 0.10, 0.10),
    "learning": (0.45, 0.30, 0.15, 0.10),
    "stabilizing": (0.35, 0.30, 0.20, 0.15),
    "production_trusted": (0.25, 0.30, 0.25, 0.20),
    "sparse_traffic": (0.50, 0.30, 0.10, 0.10),
}
SAMPLE_SCORE = ((10_000, 1.0), (5000, 0.9), (1000, 0.7), (500, 0.5), (100, 0.3), (50, 0.15))
FRESHNESS_SCORE = ((0.25, 1.0), (0.5, 0.8), (0.75, 0.5), (1.0, 0.3))
DEPLOY_SCORE = ((0.5, 0.2), (2.0, 0.5), (6.0, 0.8))
CONFIDENCE_LEVELS = ((0.85, "production_trusted"), (0.65, "high"), (0.40, "moderate"))
SEVERITIES = ((8.0, "critical"), (6.0, "high"), (4.0, "medium"), (2.0, "low"))

# Patterns of strings that are masked, in the order in which they are tried, and their masks.
MASKS = (
    (r"^eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}$", "__JWT__"),
    (r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\Z", "__UUID__"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", "__TIMESTAMP__"),
    (r"^\d{6,}$", "__NUMERIC_ID__"),
    (r"^[\w.+-]+@[\w-]+\.[\w.]+$", "__EMAIL__"),
    (r"^\+?\d[\d\s\-()]{7,}\d$", "__PHONE__"),
    (r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$", "__IP__"),
    (r"^([0-9a-fA-F]{1,4}:){2,7}[0-9a-fA-F]{1,4}$", "__IP__"),
)

# Days that rows are kept.
RETENTION_DAYS = {"observations": 90, "feature_vectors": 180, "drift_scores": 365}

KEY = ("endpoint_id", "segmentation_key")
