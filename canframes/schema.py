"""Fixed names and values the results depend on.

FIXED VALUES (must stay equal to the behaviour being reproduced; do not edit):

- payload feature columns: DATA_0, DATA_1, DATA_2, DATA_3, DATA_4, DATA_5, DATA_6, DATA_7
- default seed: 42
- attack source files, in concatenation order:
  decimal_DoS.csv, decimal_spoofing-GAS.csv, decimal_spoofing-RPM.csv,
  decimal_spoofing-SPEED.csv, decimal_spoofing-STEERING_WHEEL.csv
- benign source file: decimal_benign.csv
- descriptor columns dropped on read: category, specific_class
- frame label text map (after lower-casing): benign -> 0, 0 -> 0, attack -> 1, 1 -> 1
- text of a CSV field that counts as missing (besides the empty field): see MISSING_TOKENS
- synthetic group id when no ID column: "gid_" + (row position // 50)
- time column candidates, first present wins: timestamp, time, ts
- score-file truth column candidates (lower-cased, in order): label, category, target, y_true, gt, truth
- score-file score column candidates (lower-cased, in order): prob, score, y_score, proba, confidence
- score-file truth text map (exact spelling): ATTACK -> 1, BENIGN -> 0, MALICIOUS -> 1, NORMAL -> 0,
  attack -> 1, benign -> 0, normal -> 0
- default threshold: 0.5 for probabilities, 0.0 when scores leave [0, 1]
- F1 denominators: + 1e-9 when tuning the threshold, + 1e-12 in the threshold report
- grouped split: 20 % of the groups go to test
- rolling context window: 5 frames; basic sequence windows: 10 frames, step 1, label = any;
  improved windows: 20 frames, step 1, label = share of positives >= 0.3
- Gaussian NB variance smoothing 1e-9 (times the largest feature variance); NB alpha 1.0
- uniform bins: 16 for Complement NB, 2 for Bernoulli NB
- calibration sample: first 1000 training rows; int8 range -128 .. 127
- learners: logistic C = 1 (L1 variant: 2000 iterations); linear SVM 5000 iterations;
  hinge SGD alpha 1e-4, 2000 iterations, tol 1e-3; decision tree depth 5, min leaf 20;
  forest 64 trees, depth 8, min leaf 10 (export form: 100 trees, min leaf 2); MLP hidden
  layers 128 and 64; perceptron L2 alpha 1e-4; passive-aggressive C = 1
"""

from __future__ import annotations

# --- fixed values (see module docstring) -------------------------------------------------
FEATURES = ["DATA_0", "DATA_1", "DATA_2", "DATA_3", "DATA_4", "DATA_5", "DATA_6", "DATA_7"]
SEED = 42
ATTACK_FILES = [
    "decimal_DoS.csv",
    "decimal_spoofing-GAS.csv",
    "decimal_spoofing-RPM.csv",
    "decimal_spoofing-SPEED.csv",
    "decimal_spoofing-STEERING_WHEEL.csv",
]
BENIGN_FILE = "decimal_benign.csv"
DESCRIPTOR_COLUMNS = ["category", "specific_class"]
LABEL_TEXT_MAP = {"benign": 0, "0": 0, "attack": 1, "1": 1}
MISSING_TOKENS = [
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
]
SYNTHETIC_ID_PREFIX = "gid_"
SYNTHETIC_ID_BLOCK = 50
TIME_COLUMNS = ["timestamp", "time", "ts"]
TRUTH_CANDIDATES = ["label", "category", "target", "y_true", "gt", "truth"]
SCORE_CANDIDATES = ["prob", "score", "y_score", "proba", "confidence"]
TRUTH_TEXT_MAP = {
    "ATTACK": 1,
    "BENIGN": 0,
    "MALICIOUS": 1,
    "NORMAL": 0,
    "attack": 1,
    "benign": 0,
    "normal": 0,
}
DEFAULT_THRESHOLD = 0.5
MARGIN_THRESHOLD = 0.0
F1_EPS_TUNE = 1e-9
F1_EPS_EVAL = 1e-12
TEST_SIZE = 0.2
ROLL_WINDOW = 5
BASIC_TIMESTEPS, BASIC_STEP, BASIC_RULE = 10, 1, "any"
IMPROVED_TIMESTEPS, IMPROVED_STEP, IMPROVED_RULE, IMPROVED_POS_RATIO = 20, 1, "ratio", 0.3
NB_VAR_SMOOTHING = 1e-9
NB_ALPHA = 1.0
COMPLEMENT_NB_BINS = 16
BERNOULLI_NB_BINS = 2
REPRESENTATIVE_ROWS = 1000
INT8_MIN, INT8_MAX = -128, 127
LOGREG_C = 1.0
LOGREG_L1_MAX_ITER = 2000
LINEAR_SVC_MAX_ITER = 5000
SGD_ALPHA, SGD_MAX_ITER, SGD_TOL = 1e-4, 2000, 1e-3
TREE_MAX_DEPTH, TREE_MIN_LEAF = 5, 20
FOREST_TREES, FOREST_MAX_DEPTH, FOREST_MIN_LEAF = 64, 8, 10
EXPORT_FOREST_TREES, EXPORT_FOREST_MIN_LEAF = 100, 2
MLP_HIDDEN = (128, 64)
PERCEPTRON_ALPHA = 1e-4
PA_C = 1.0
# -------------------------------------------------------------------------------------------

# Column names this package adds.
SOURCE_COL = "source"  # file the frame came from
SOURCE_RANK_COL = "source_rank"  # order of that file in the concatenation
FRAME_SEQ_COL = "frame_seq"  # 0-based position of the frame inside its source file
CLASS_POS_COL = "class_pos"  # 0-based position inside the concatenated class table
GROUP_KEY_COL = "group_key"  # content hash of the payload
SPLIT_COL = "split"
POS_COL = "pos"  # 0-based position inside an ID after the time sort
N_COL = "n_in_id"  # frames in the ID


def resolve_time_column(columns: list[str], candidates: list[str] | tuple[str, ...] | None = None) -> str | None:
    """First time column that exists, exact case (driver-side, plan-building time)."""
    return next((c for c in (candidates or TIME_COLUMNS) if c in columns), None)
