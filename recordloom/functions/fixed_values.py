"""These decide the results, so they are stated here as plain text."""

# ---- ledger CSV layouts: header names that identify a layout (lower case), tested in this order
LAYOUT_REQUIRED = {
    "discover": [
        "transaction date",
        "transaction description",
        "transaction type",
        "debit",
        "credit",
        "balance",
    ],
    "wealthfront": ["transaction date", "description", "type", "amount"],
}

# ---- ledger CSV layouts: header names the values are taken from (exact case), first non-empty wins
LAYOUT_COLUMNS = {
    "wealthfront": {
        "date": ["Transaction date", "date"],
        "description": ["Description", "description"],
        "subtype": ["Type", "type"],
        "amount": ["Amount", "amount"],
    },
    "discover": {
        "date": ["Transaction Date", "transaction date"],
        "description": ["Transaction Description", "transaction description"],
        "subtype": ["Transaction Type", "transaction type"],
        "debit": ["Debit", "debit"],
        "credit": ["Credit", "credit"],
    },
}

CATEGORY = "transaction"

# ---- description clean-up: (pattern, replacement), applied in this order
DESCRIPTION_RULES = [
    (r"\s*\([^)]*\)", ""),
    (r"[X*]{3,}\d*", ""),
    (r"[-_ ]+(?:[A-Za-z]?\d{3,})(?:[-_ ]+\d+)*\s*$", ""),
    (r"[-_]+", " "),
    (r" {2,}", " "),
]

# ---- sheet cells that mean "no value" (compared in lower case)
NULL_WORDS = ["", "null", "na", "n/a", "-"]

# ---- yearly ratios: (name, numerator field, denominator field, label)
RATIOS = [
    ("effective_tax_rate_pct", "f_1040_24", "f_1040_15", "Effective tax rate"),
    (
        "capital_gain_short_vs_long_ratio_pct",
        "f_d_7",
        "f_d_15",
        "Capital gain short vs long-term ratio",
    ),
    ("ca_effective_tax_rate_pct", "f_540_64", "f_540_19", "CA effective tax rate"),
]

# ---- repository address, shortstat figures
REPO_URL = r"^https?://github\.com/([^/]+)/([^/.]+)"
INSERTIONS = r"(\d+) insertion"
DELETIONS = r"(\d+) deletion"
ANY_CHANGE = r"\d (?:insertion|deletion)"

# ---- health export: element kinds
ALWAYS_KEPT = ["ExportDate", "Me", "Workout"]
COUNTED_KINDS = ["Workout", "Record", "Correlation", "ActivitySummary"]

# ---- text sniff: a file is text when its head of this many characters decodes
SNIFF_CHARS = 4096
SNIFF_BYTES = 8192

DEFAULT_PREVIEW_ROWS = 3

# ---- characters counted as white space: ASCII ones, the four separators, then the Unicode ones
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
