"""Fixed values that must equal the evaluated scripts' values for equal results.

Everything here is a literal that decides parity (patterns, seeds, thresholds,
column names).  Nothing here is logic.
"""

# --- fixed values -----------------------------------------------------------
RANDOM_MODEL = "random"                           # pseudo-model: one random response per message
SEED = 42                                         # every seeded sample / split
SAMPLE_SIZE = 50                                  # agreement sample size
OUTPUT_SEPARATOR = "<XXX>"                        # tag around the counter speech in model output
TRIM_CHARS = ' "'                                 # characters stripped from response text
SENTIMENT_POSITIVE = 0.05                         # compound >= this -> positive
SENTIMENT_NEGATIVE = -0.05                        # compound <= this -> negative
SENTIMENT_ALPHA = 15.0                            # compound = s / sqrt(s^2 + alpha)
BLEU_EPSILON = 0.1                                # smoothing method 1 epsilon
BLEU_MAX_N = 4                                    # BLEU n-gram orders 1..4, weight 1/4 each
TOP_K = 10                                        # most-common lists
SIGNIFICANCE_LEVEL = 0.05                         # Friedman gate and Wilcoxon better-model gate

# Emoji code-point ranges, one character class (flags count as two code points).
EMOJI_RANGES = [
    (0x1F600, 0x1F64F),
    (0x1F300, 0x1F5FF),
    (0x1F680, 0x1F6FF),
    (0x1F700, 0x1F77F),
    (0x1F780, 0x1F7FF),
    (0x1F800, 0x1F8FF),
    (0x1F900, 0x1F9FF),
    (0x1FA00, 0x1FA6F),
    (0x1FA70, 0x1FAFF),
    (0x2600, 0x26FF),
    (0x2700, 0x27BF),
    (0x1F1E0, 0x1F1FF),
]

# Annotation columns: long names used in annotation files -> short names.
ANNOTATION_COL_MAPPING = {
    "1 Conciseness and Clarity of Response": "clarity",
    "3 Strategy 1: Factual Accuracy": "factual",
    "4 Strategy 2: Exploration of Alternative Explanations": "alternative",
    "5 Strategy 3: Use of Narrative Storytelling": "narrative",
    "6 Strategy 4: Encouragement of Critical Thinking": "critical_thinking",
    "7.1 Fear Identification": "fear_id",
    "7.2 Empathy/Acknowledgement of Fear and Anxiety": "fear_ack",
    "8 Usage of terms such as conspiracy theory": "conspiracy_usage",
    "9 Repetition of false or harmful content from the message": "repetition_harmful",
    "2.1 Hate Speech Identification": "hate_speech_id",
    "2.2 If hate speech present (1-x): hate speech handling": "hate_speech_handling",
    "2.3 If hate speech identified (x-1): conspiracy theory handling": "conspiracy_handling",
}
# Second annotator's column names -> short names.
ANNOTATOR_2_COL_MAPPING = {
    "Clarity": "clarity",
    "Factual Accuracy": "factual",
    "Exploration of Alternative Explanations": "alternative",
    "Narrative Storytelling": "narrative",
    "Critical Thinking": "critical_thinking",
    "Fear Identification": "fear_id",
    "Empathy for Fear & Anxiety": "fear_ack",
    "Term Usage (CT, misinfo)": "conspiracy_usage",
    "Repetition of false content": "repetition_harmful",
    "2.1 Hate Speech Identification": "hate_speech_id",
    "2.2 If hate speech present (1-x): hate speech handling": "hate_speech_handling",
    "2.3 If hate speech identified (x-1): conspiracy theory handling": "conspiracy_handling",
}
STRATEGY_COLS = ["strategy_1", "strategy_2", "strategy_3", "strategy_4"]
REAL_STRATEGY_COLS = ["factual", "alternative", "narrative", "critical_thinking"]
COL_OUTPUT = "model_output"
COL_STRATEGY = "model_strategies"
COL_COUNTER_SPEECH = "model_counter_speech"
COL_STRATEGY_CORRECTED = "model_strategies_corrected"
COL_COUNTER_SPEECH_CORRECTED = "model_counter_speech_corrected"
# ---------------------------------------------------------------------------
