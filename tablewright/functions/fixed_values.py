"""Values that results depend on, stated as they are.

Fixed values: word lists, thresholds, labels and message formats below must
stay exactly as written for results to be right. No logic lives here.
"""

# --- quality scoring -------------------------------------------------------
COMPLETENESS_PENALTY = 2.5
UNIQUENESS_PENALTY = 4.0
CONSISTENCY_PENALTY = 8.0
VALIDITY_PENALTY = 3.0
SCORE_WEIGHTS = {
    "completeness": 0.35,
    "uniqueness": 0.25,
    "consistency": 0.20,
    "validity": 0.20,
}
FENCE_FACTOR = 1.5
FENCE_METHOD = "IQR (1.5 x Interquartile Range)"
NON_NEGATIVE_WORDS = [
    "price", "cost", "revenue", "quantity", "age", "days", "count", "income", "amount",
]
CRITICAL_MISSING_PERCENT = 50.0
ISSUE_NEGATIVE = "Unexpected Negative Values"
ISSUE_CONSTANT = "Zero Variance / Constant Column"
ISSUE_MISSING = "Critical Missing Rate (>50%)"
NEGATIVE_DESCRIPTION = "Found %s negative entries in '%s', which is conventionally non-negative."
CONSTANT_DESCRIPTION = "Column '%s' has only 1 distinct value ('%s') across all records."
MISSING_DESCRIPTION = "Column '%s' is missing %s%% of entries (%s/%s)."
SKEW_RIGHT = "Right-skewed (concentrated at lower end with high outliers)"
SKEW_LEFT = "Left-skewed (concentrated at higher end with low outliers)"
SKEW_NONE = "Approximately symmetrical"
SKEW_PATTERN = "Distribution Skew"
NEXT_OUTLIERS = "Investigate outliers in '%s' (%s values outside IQR bounds)."
NEXT_MISSING = "Address %s missing values in '%s' before analysis."
NEXT_DUPLICATES = "Remove %s duplicate rows to ensure analysis accuracy."
NEXT_DEFAULT = "Continue longitudinal monitoring of core transactional volume."

# --- type detection and conversion ----------------------------------------
DETECTION_SHARE = 0.85
BOOLEAN_WORDS = ["true", "false", "yes", "no", "y", "n", "1", "0"]
TRUE_WORDS = ["true", "1", "yes", "y", "t"]
FALSE_WORDS = ["false", "0", "no", "n", "f"]
REASON_BOOLEAN = "Column values are exclusively boolean indicators (%s)."
REASON_INTEGER = "%s%% of values are valid whole numbers currently stored as text."
REASON_DECIMAL = "%s%% of values are valid numeric decimals stored as text."
REASON_DATETIME = "%s%% of values are valid date/time entries formatted as text."
REASON_WHOLE = (
    "All values have zero decimal fraction and are whole numbers stored as floating-point."
)
# Text read as missing by the CSV reader (pandas' documented default list).
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
CSV_TRUE = ["True", "TRUE", "true"]
CSV_FALSE = ["False", "FALSE", "false"]
# Date layouts tried in this order; month comes before day.
DATE_LAYOUTS = [
    "M/d/yyyy[ H:mm[:ss]]",
    "d/M/yyyy[ H:mm[:ss]]",
    "yyyy/M/d[ H:mm[:ss]]",
    "M-d-yyyy[ H:mm[:ss]]",
    "d-M-yyyy[ H:mm[:ss]]",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "d MMM yyyy",
    "d MMMM yyyy",
    "d-MMM-yyyy",
]

# --- cleaning --------------------------------------------------------------
NOTE_NAMES = ["analyst note", "analyst_note", "analyst notes", "analyst_notes"]
NOTE_FRAGMENTS = ["analyst note", "analyst_note"]
FENCE_MIN_VALUES = 10
EMPTY_MODE_TEXT = "Unknown"
DEFAULT_CONSTANT_TEXT = "Not Specified"

# What the audit trail says about each step.
AUDIT_TRIM = "Trimmed redundant whitespace across %s column names and %s text fields."
AUDIT_DUPLICATES = "Removed %s identical duplicate rows across all features."
AUDIT_KEEP = "Preserved all original values (including %s null entries)."
AUDIT_REMOVE_COLUMN = "Dropped column '%s' entirely from dataset schema."
AUDIT_REMOVE_ROWS = "Removed %s rows containing missing values in '%s'."
AUDIT_FILL = {
    "mean": "Imputed %s missing cells using column mean (%s).",
    "median": "Imputed %s missing cells using column median (%s).",
    "mode": "Imputed %s missing cells using modal frequency ('%s').",
    "constant": "Imputed %s missing cells with constant value: %s.",
    "ffill": "Imputed %s missing cells via Forward Fill propagation.",
    "bfill": "Imputed %s missing cells via Backward Fill propagation.",
}
AUDIT_CLIP = "Winsorized/clipped %s outliers to IQR bounds [%s, %s]."
AUDIT_OUTLIER_ROWS = "Removed %s rows with extreme values in '%s'."
AUDIT_CONVERT = "Converted data type from '%s' to '%s' (%s)."

# --- charts ----------------------------------------------------------------
CHART_BAR = ("rec_chart_bar", "bar", "Total %s by %s")
CHART_HISTOGRAM = ("rec_chart_dist", "histogram", "Distribution of %s")
CHART_HEATMAP = ("rec_chart_corr", "heatmap", "Feature Correlation Heatmap")
CHART_SCATTER = ("rec_chart_scatter", "scatter", "%s vs %s")
CHART_BOX = ("rec_chart_box", "box", "Spread & Outlier Comparison")
CHART_LINE = ("rec_chart_line", "line", "%s Over Time")
CHART_PIE = ("rec_chart_pie", "pie", "Share of %s by %s")
CHART_FREQUENCY = ("rec_chart_cat_bar", "bar", "Frequency of %s")
TIME_NAME_WORDS = ["date", "time", "year", "month", "day"]
SAMPLE_SEED = 42

# --- report ----------------------------------------------------------------
SUMMARY_LABELS = [
    "Overall Quality Score", "Total Records", "Completeness Index", "Total Features",
    "Uniqueness Index", "Missing Cells", "Consistency & Validity", "Duplicate Rows",
]
OUTLIER_ISSUE = "Tail Outlier (IQR)"
OUTLIER_RANGE = "Values outside [%s, %s]."

# --- questions -------------------------------------------------------------
PROCEDURE_WORDS = [
    "step", "steps", "procedure", "how to", "instructions", "workflow", "process to", "guide to",
]
ROWS_WORDS = [
    "how many rows", "number of rows", "total rows", "row count", "how many records",
    "size of dataset",
]
COLUMNS_WORDS = [
    "how many columns", "number of columns", "list of columns", "what columns", "column names",
    "available fields",
]
MISSING_WORDS = ["missing", "null", "empty", "incomplete", "nan"]
DUPLICATE_WORDS = ["duplicate", "identical rows", "repeated rows"]
GROUP_WORDS = ["by", "per", "for each", "each", "wise", "breakdown", "grouped by"]
MEAN_WORDS = ["average", "avg", "mean"]
COUNT_WORDS = ["count", "number of", "frequency", "how many"]
MAX_WORDS = ["max", "maximum", "highest", "peak"]
MIN_WORDS = ["min", "minimum", "lowest"]
DISTINCT_WORDS = ["list", "what are the", "distinct", "unique", "show all", "names of", "all "]
EXTREME_WORDS = [
    "highest", "maximum", "max", "top", "lowest", "minimum", "min", "bottom", "best", "worst",
]
EXTREME_HIGH_WORDS = ["highest", "maximum", "max", "top", "best"]
TOTAL_WORDS = ["total", "sum", "aggregate"]
MEDIAN_WORDS = ["median", "middle"]
CORRELATION_WORDS = ["correlat", "relationship", "relation", "linked", "associate"]
TOP_N_PATTERN = r"(?:top|first|highest)\s*(\d+)"
BOTTOM_N_PATTERN = r"(?:bottom|lowest|last)\s*(\d+)"

# --- text, HTML and graph extraction ---------------------------------------
# Characters that count as whitespace at the ends of a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
FIELD_SEPARATOR = r"(?U)\s{2,}|\t|,"
LINE_BREAK_CHARS = "[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
LINE_BREAK = "\\r\\n|" + LINE_BREAK_CHARS
# Quantifiers are possessive where giving back characters could never help.
DOT_EDGE_PATTERN = (
    r"""(?U)(?<!["'\w])["'\w]++\s*+(?:->|--)\s*+["'\w]++(?:\s*+\[[^\]]*+\])?"""
)
DOT_NODE_PATTERN = r"""(?U)(?<!["'\w])["'\w]++\s*+\[[^\]]*+\]"""
DOT_WEIGHT_PATTERN = r"weight\s*=\s*([0-9.]+)"

# The slice that holds all groups a pie does not show.
OTHER_SLICE = "Other"

# Points of a custom scatter chart that does not say how many.
SCATTER_POINTS = 1000
