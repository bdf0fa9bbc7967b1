"""Fixed values that must equal the original application's for equal results.

Everything here is data, not logic.  Tables that would be long (the
whitespace class, the accent fold) are derived from a rule in ``text.py``.
"""

# --- FIXED VALUES (must match the original application) --------------------

# Class names in class-index order; index = label.
CLASS_NAMES = ("Negative", "Neutral", "Positive")
# Class name -> label.
LABEL_MAP = {"Negative": 0, "Neutral": 1, "Positive": 2}

# Special token ids of the uncased BERT vocabulary, and its size.
PAD_ID = 0
UNK_ID = 100
CLS_ID = 101
SEP_ID = 102
MASK_ID = 103
VOCAB_SIZE = 30522

# Sequence length (specials included), mini-batch size, split ratios, seed.
MAX_LENGTH = 128
BATCH_SIZE = 16
TRAIN_RATIO = 0.8
VAL_RATIO = 0.1
SEED = 42

# Training options of the original command line.
EPOCHS = 3
WEIGHT_DECAY = 0.01
EARLY_STOPPING_PATIENCE = 2

# Display text is cut to this many characters, then "..." is appended.
DISPLAY_CHARS = 100
DISPLAY_SUFFIX = "..."

# Confidence gauge: band edges in percent and the marker threshold.
CONFIDENCE_BANDS = ((0, 50), (50, 75), (75, 100))
CONFIDENCE_THRESHOLD = 90

# Example catalogue: category -> texts, in the order shown.
EXAMPLES = {
    "Positive Examples": [
        "I absolutely love this product! It's amazing and works perfectly.",
        "Excellent customer service! They were very helpful and responsive.",
        "Outstanding! Exceeded all my expectations!",
    ],
    "Negative Examples": [
        "This is terrible. I'm very disappointed with the quality.",
        "Poor quality materials, not worth the money at all.",
        "Not happy with the purchase, will not recommend.",
    ],
    "Neutral Examples": [
        "The product is okay, nothing special but it works.",
        "It's decent for the price, but could be better.",
        "Average experience, met basic expectations.",
    ],
}

# pandas' default missing-value strings for read_csv (public pandas docs).
PANDAS_NA_VALUES = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# What a null becomes once stringified by pandas.
NULL_TEXT = "nan"

# --- end of fixed values ------------------------------------------------------
