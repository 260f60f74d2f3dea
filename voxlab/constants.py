"""Fixed values that must equal the screening application's for equal results.

They are stated plainly and together; nothing here is derived.
"""

# ---------------------------------------------------------------------------
# The 22 voice features of the labelled set, in file order.
# ---------------------------------------------------------------------------
LABELLED_FEATURES = [
    "MDVP:Fo(Hz)", "MDVP:Fhi(Hz)", "MDVP:Flo(Hz)",
    "MDVP:Jitter(%)", "MDVP:Jitter(Abs)", "MDVP:RAP", "MDVP:PPQ", "Jitter:DDP",
    "MDVP:Shimmer", "MDVP:Shimmer(dB)", "Shimmer:APQ3", "Shimmer:APQ5", "MDVP:APQ", "Shimmer:DDA",
    "NHR", "HNR", "RPDE", "DFA", "spread1", "spread2", "D2", "PPE",
]

# ---------------------------------------------------------------------------
# Longitudinal-set column name -> labelled-set column name.
# The 16 target names, in this order, are the common model features.
# ---------------------------------------------------------------------------
LONGITUDINAL_RENAME = {
    "Jitter(%)": "MDVP:Jitter(%)",
    "Jitter(Abs)": "MDVP:Jitter(Abs)",
    "Jitter:RAP": "MDVP:RAP",
    "Jitter:PPQ5": "MDVP:PPQ",
    "Jitter:DDP": "Jitter:DDP",
    "Shimmer": "MDVP:Shimmer",
    "Shimmer(dB)": "MDVP:Shimmer(dB)",
    "Shimmer:APQ3": "Shimmer:APQ3",
    "Shimmer:APQ5": "Shimmer:APQ5",
    "Shimmer:APQ11": "MDVP:APQ",
    "Shimmer:DDA": "Shimmer:DDA",
    "NHR": "NHR",
    "HNR": "HNR",
    "RPDE": "RPDE",
    "DFA": "DFA",
    "PPE": "PPE",
}
COMMON_FEATURES = list(LONGITUDINAL_RENAME.values())

LABEL_COL = "status"
LONGITUDINAL_SUBJECT = "subject#"
LONGITUDINAL_TARGET = "motor_UPDRS"

# ---------------------------------------------------------------------------
# Severity bands (closed integer ranges) with the colours of
# the training report and of the serving page.
# (lo, hi, label, report colour, page colour, page background)
# ---------------------------------------------------------------------------
SEVERITY_BANDS = [
    (0, 10, "None / Minimal", "#27AE60", "#00e676", "rgba(0,230,118,0.1)"),
    (11, 30, "Mild", "#F39C12", "#ffc107", "rgba(255,193,7,0.1)"),
    (31, 58, "Moderate", "#E67E22", "#ff9800", "rgba(255,152,0,0.1)"),
    (59, 200, "Severe", "#E74C3C", "#ef5350", "rgba(239,83,80,0.1)"),
]
FALLBACK_BAND = "Severe"
SEVERITY_CLIP = (0.0, 59.0)
SEVERITY_DEFAULT_MAE = 5.2

# Result texts and class names.
CLASS_NAMES = {1: "Parkinson's", 0: "Healthy"}
RESULT_POSITIVE = "Parkinson's Risk"
RESULT_NEGATIVE = "Healthy"
INPUT_TYPE_AUDIO = "Audio"
INPUT_TYPE_CSV = "CSV"
DIRECTION_POSITIVE = "toward Parkinson's"
DIRECTION_NEGATIVE = "toward Healthy"

# Field names of the single-record scoring result, in order.
RECORD_FIELDS = ["has_parkinsons", "probability_healthy", "probability_parkinsons", "confidence", "model_used"]

# Risk tiers on the percent scale.
RISK_AMBER = 40.0
RISK_RED = 60.0

# Signal-measure limits and defaults.
JITTER_T_MIN = 0.0001
JITTER_T_MAX = 0.02
JITTER_MAX_RATIO = 1.3
SHIMMER_MAX_AMP_RATIO = 1.6
DEFAULT_RPDE = 0.5
DEFAULT_DFA = 0.6
DEFAULT_D2 = 2.3
DEFAULT_PPE = 0.2
DEFAULT_SPREAD1 = -5.0
DEFAULT_SPREAD2 = 0.2
DEFAULT_NHR = 0.1
DFA_SCALES = 12
DFA_MIN_SCALE = 4
DFA_RAW_FALLBACK = 2000
HIST_MAX_BINS = 20

# Classifier and regressor hyper-parameter grids.
GRID_LOGISTIC = {"C": [0.01, 0.1, 1, 10]}
GRID_FOREST = {"n_estimators": [100, 200], "max_depth": [None, 5, 10], "min_samples_split": [2, 5]}
GRID_SVM = {"C": [0.1, 1, 10], "kernel": ["rbf", "linear"], "gamma": ["scale", "auto"]}
GRID_BOOSTED = {"n_estimators": [100, 200], "max_depth": [3, 5], "learning_rate": [0.05, 0.1], "subsample": [0.8, 1.0]}
GRID_SEVERITY = {"n_estimators": [200, 400], "max_depth": [4, 6], "learning_rate": [0.05, 0.1], "subsample": [0.8, 1.0]}
FAMILY_ORDER = ["Logistic Regression", "Random Forest", "SVM", "Boosted Trees"]
CV_FOLDS = 5
SEED = 42
TEST_FRACTION = 0.2
OVERSAMPLE_RATIO = 0.25
SMOTE_K = 5
BACKGROUND_ROWS = 50
TOP_IMPORTANCE = 12
TOP_ATTRIBUTION = 14
