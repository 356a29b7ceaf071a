"""Fixed values and table schemas shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: stage domain -------------------------------------------
WAKE, N1, N2, N3, REM = 0, 1, 2, 3, 4
STAGES = [0, 1, 2, 3, 4]
STAGE_NAMES = ["W", "N1", "N2", "N3", "REM"]
N_STAGES = 5
UNSCORED = -1
# top-to-bottom row order of a clinical hypnogram
DISPLAY_ORDER = [0, 4, 1, 2, 3]

# --- fixed values: annotation text -> stage -------------------------------
# Every other text ("Sleep stage ?", "Movement time", unknown, empty) is dropped.
ANNOTATION_STAGE = {
    "Sleep stage W": 0,
    "Sleep stage 1": 1,
    "Sleep stage 2": 2,
    "Sleep stage 3": 3,
    "Sleep stage 4": 3,
    "Sleep stage R": 4,
}

# --- fixed values: file naming --------------------------------------------
STEM_PATTERN = r"^SC4(\d{2})(\d)[A-Za-z0-9]{2}$"
LISTING_PATTERN = r"SC4\d{3}[A-Za-z0-9]{2}-(?:PSG|Hypnogram)\.edf"
SIGNAL_SUFFIX = "-PSG.edf"
ANNOTATION_SUFFIX = "-Hypnogram.edf"

# --- fixed values: numeric contract ---------------------------------------
ZSCORE_EPS = 1e-8
ANALYSIS_LOW_HZ = 0.5
ANALYSIS_HIGH_HZ = 30.0

# --- fixed values: names and layouts that files and tables share ------------
SPLITS = ["train", "val", "test"]

BAND_NAMES = ["delta", "theta", "alpha", "sigma", "beta"]
FEATURES = [f"feat_bp_{b}" for b in BAND_NAMES] + [
    "feat_spec_entropy",
    "feat_hjorth_activity",
    "feat_hjorth_mobility",
    "feat_hjorth_complexity",
    "feat_rms",
]

REC = ["subject_id", "night"]

MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("subject_id", T.StringType()),
        T.StructField("night", T.IntegerType()),
        T.StructField("psg_path", T.StringType()),
        T.StructField("hypnogram_path", T.StringType()),
    ]
)

EPOCH_SCHEMA = T.StructType(
    [
        T.StructField("subject_id", T.StringType(), False),
        T.StructField("night", T.IntegerType(), False),
        T.StructField("epoch_idx", T.IntegerType(), False),
        T.StructField("stage", T.IntegerType(), False),
        T.StructField("signal", T.ArrayType(T.FloatType(), False), False),
    ]
    + [T.StructField(name, T.FloatType(), False) for name in FEATURES]
)

SPLIT_DOC_SCHEMA = T.StructType(
    [
        T.StructField("seed", T.LongType()),
        T.StructField("val_frac", T.DoubleType()),
        T.StructField("test_frac", T.DoubleType()),
        T.StructField("split", T.StringType()),
        T.StructField("shard", T.LongType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("ids", T.ArrayType(T.StringType())),
    ]
)
IDS_PER_SHARD = 10_000
