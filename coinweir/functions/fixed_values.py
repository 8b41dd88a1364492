"""Fixed values. They decide results, so they are stated as plain text, in natural order."""

# The characters that count as white space at the ends of a text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Merchant keys.
TOP_LEVEL_DOMAINS = ["com", "ca", "net", "org", "io", "co", "app", "gov", "edu", "uk", "us", "au", "de", "fr"]
STORE_WORDS = ["store", "shop", "location", "branch", r"no\.?"]
COMPANY_WORDS = ["inc", "ltd", "corp", "llc", "trip"]
MERCHANT_KEY_WORDS = 3

# Classification.
TRANSACTION_TYPES = ["expense", "income"]
DEFAULT_CATEGORY = "Other"
CATEGORY_WORDS = 3
DEFAULT_CONFIDENCE = 0.5
DEFAULT_CLASSIFICATION_REASON = "Classified based on merchant name."
IMPORT_FALLBACK = {
    "category_name": "Other",
    "normalized_category": "other",
    "confidence": 0.0,
    "reason": "AI classification unavailable during import",
}
ANOMALY_FALLBACK_REASON = "Anomaly check unavailable during import"

# Summary lines of a statement (regular expression alternatives).
SUMMARY_LINE = [
    r"opening\s*balance",
    r"closing\s*balance",
    r"previous\s*balance",
    r"new\s*balance",
    r"beginning\s*balance",
    r"ending\s*balance",
    r"brought\s*forward",
    r"carried\s*forward",
    r"balance\s*forward",
    r"running\s*balance",
    r"\btotals?\b",
    r"sub\s*-?\s*total",
    r"grand\s*total",
    r"\bsummary\b",
    r"interest\s*rate",
    r"account\s*(?:number|no\.?|\#)",
    r"statement\s*(?:period|date|balance)",
    r"(?:^|\s)page\s+\d",
    r"(?:^|\s)\bpage\b",
    r"payments?\s*due",
    r"credit\s*limit",
    r"available\s*credit",
    r"minimum\s*(?:payment|due)",
]

# Statement metadata phrases (parser).
METADATA_PHRASES = [
    r"previous\s*balance",
    r"new\s*balance",
    r"opening\s*balance",
    r"closing\s*balance",
    r"statement\s*balance",
    r"balance\s*(?:forward|brought\s*forward|carried\s*forward)",
    r"minimum\s*payment",
    r"minimum\s*(?:amount\s*)?due",
    r"payment\s*due\s*date",
    r"due\s*date",
    r"total\s*amount\s*due",
    r"amount\s*due",
    r"credit\s*limit",
    r"available\s*credit",
    r"available\s*balance",
    r"credit\s*available",
    r"annual\s*interest\s*rate",
    r"interest\s*rate",
    r"total\s*interest",
    r"total\s*fees",
    r"cash\s*back\s*summary",
    r"rewards?\s*summary",
    r"points?\s*summary",
    r"rewards?\s*balance",
    r"account\s*summary",
    r"statement\s*(?:period|date|summary)",
    r"sub\s*-?\s*total",
    r"grand\s*total",
    r"total\s*(?:purchases|payments|withdrawals|deposits|credits|debits|new\s*charges)",
]
CONTACT_PHRASES = [
    r"customer\s*service",
    r"lost\s*(?:or\s*|/)?\s*stolen",
    r"report\s*(?:lost|fraud)",
    r"online\s*banking",
    r"www\.",
    r"https?://",
    r"\.com\b",
    r"\.ca\b",
    r"call\s*(?:us|toll)",
    r"1[-\s]?800",
    r"toll[-\s]?free",
    r"make\s*(?:cheque|check)\s*payable",
    r"mail\s*your\s*payment",
    r"remit\s*to",
    r"please\s*(?:pay|see)",
    r"to\s*pay\s*your\s*bill",
    r"payment\s*options",
    r"visit\s*(?:us|our)",
    r"contact\s*us",
]
PHONE_ONLY = r"^[\s+()0-9.\-]{7,}$"
PAGE_LINE = r"^\s*page\s+\d+(\s+of\s+\d+)?\s*$"
AMOUNT_TOKEN = r"(?:\d{1,3}(?:,\d{3})+|\d+)\.\d{2}"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH_NAMES = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]
DATE_TOKEN = [
    r"\d{4}-\d{1,2}-\d{1,2}",
    r"\d{1,2}[-/]\d{1,2}(?:[-/]\d{2,4})?",
    r"(?:MONTH)[a-z]*\.?\s*\d{1,2}",
    r"\d{1,2}\s*(?:MONTH)[a-z]*",
]

# Metadata phrases of the cleanup audit.
CLEANUP_METADATA = [
    r"opening\s*balance",
    r"closing\s*balance",
    r"previous\s*balance",
    r"new\s*balance",
    r"balance\s*forward",
    r"balance\s*brought\s*forward",
    r"available\s*balance",
    r"amount\s+due",
    r"total\s+amount\s+due",
    r"payment\s+due",
    r"minimum\s*payment",
    r"minimum\s+due",
    r"available\s*credit",
    r"credit\s+available",
    r"credit\s+limit",
    r"rewards?\s+summary",
    r"cash\s*back\s+summary",
    r"points\s+summary",
    r"rewards?\s+redeemed",
    r"interest\s+summary",
    r"total\s+interest",
    r"total\s+fees",
    r"sub\s*-?\s*total",
    r"grand\s+total",
    r"total\s+withdrawals",
    r"total\s+deposits",
    r"\btotals?\b",
    r"statement\s+(?:period|date|balance|summary)",
    r"account\s+(?:number|no\.?|summary|information)",
    r"card\s+number",
    r"(?:^|\s)page\s+\d",
]
MAX_REMOVAL_FRACTION = 0.40
CLEANUP_CHUNK_ROWS = 50

# Leading date of a statement line, alternatives in order of precedence.
LEADING_DATE = [
    r"\d{4}[-/]\d{1,2}[-/]\d{1,2}",
    r"\d{1,2}[-/]\d{1,2}[-/]\d{2,4}",
    r"(?:MONTH)[a-z]*\.?\s+\d{1,2},?\s+\d{2,4}",
    r"\d{1,2}\s+(?:MONTH)[a-z]*\.?\s+\d{2,4}",
    r"\d{1,2}-(?:MONTH)[a-z]*-\d{2,4}",
    r"(?:MONTH)[a-z]*\.?\s+\d{1,2}",
    r"\d{1,2}\s+(?:MONTH)[a-z]*",
    r"\d{1,2}(?:MONTH)[a-z]*",
    r"\d{1,2}-(?:MONTH)[a-z]*",
    r"\d{1,2}/\d{1,2}",
]
TWO_DIGIT_YEAR_PIVOT = 69

# Amounts and their direction words.
AMOUNT = (
    r"(?<![,\d])"
    r"([+\-]?\s*\$?\s*\(?(?:\d{1,3}(?:,\d{3})+|\d+)\.\d{2}\)?(?:\s*(?:CR|DR)\b)?)"
    r"(?![,\d])"
)
DEBIT_HINT = (
    r"debit|withdrawal|payment|purchase|fee|charge|pos\b|dr\b"
    r"|paid\s*out|money\s*out|\bsent\b|transfer\s*-?\s*sent|visa"
)
CREDIT_HINT = (
    r"credit|deposit|payroll|refund|transfer.{0,5}in|direct.{0,5}deposit"
    r"|salary|interest.{0,5}paid|cr\b|paid.{0,5}in|money.{0,5}in"
    r"|transfer\s*-?\s*(received|autodeposit)"
)

# Statement type indicators.
CARD_INDICATORS = [
    "credit card", "minimum payment", "payment due date", "credit limit", "cash advance", "interest charged",
    "statement balance", "amount due", "new balance", "available credit", "previous balance",
]
CARD_WEAK_INDICATORS = ["visa", "mastercard", "purchases"]
BANK_INDICATORS = [
    "chequing", "checking", "savings", "account activity", "opening balance", "closing balance", "deposits",
    "withdrawals", "interac", "direct deposit", "payroll", "overdraft", "transit number", "branch",
]

# Section headers by statement type, and the sign a section implies.
CARD_SECTIONS = [
    ("payments", r"payments?"),
    ("credits", r"other\s+credits|credits?"),
    ("cash_advances", r"cash\s+advances?"),
    ("purchases", r"purchases?(\s+and\s+adjustments)?"),
    ("fees", r"fees?|fees?\s+and\s+charges"),
    ("interest", r"interest(\s+charges?)?"),
]
BANK_SECTIONS = [
    ("deposits", r"deposits?(\s+and\s+credits?)?|credits?"),
    ("withdrawals", r"withdrawals?(\s+and\s+debits?)?|debits?"),
    ("service_charges", r"service\s+charges?|fees?"),
    ("transfers", r"transfers?"),
    ("card", r"card\s+(transactions|purchases)|point\s+of\s+sale"),
]
CREDIT_SECTIONS = ["payments", "credits", "deposits"]
DEBIT_SECTIONS = ["purchases", "fees", "interest", "cash_advances", "withdrawals", "card", "service_charges"]

# Direction keywords.
TRANSFER_SENT = r"e-?transfer\s*-?\s*sent"
TRANSFER_RECEIVED = r"e-?transfer\s*-?\s*(received|autodeposit)"
INTEREST_CHARGED = r"interest\s+(charge|charged|charges)"
INTEREST_PAID = r"interest\s+(paid|earned)"
ANY_CREDIT_WORDS = [
    "refund", "reversal", "rebate", "cashback", "cash back", "payroll", "direct deposit", "auto deposit",
    "received from", "remittance", "credit memo",
]
ANY_DEBIT_WORDS = [
    "purchase", "withdrawal", "cash advance", "atm", "nsf", "overdraft", "service charge", "service fee",
    "monthly fee", "account fee", "maintenance fee", "annual fee", "pos ", "point of sale", "bill payment",
    "pre-authorized", "preauthorized",
]
CARD_CREDIT_WORDS = [
    "payment thank you", "thank you", "payment received", "autopay", "auto pay", "payment -", "payment",
]
CARD_DEBIT_WORDS = ["fee", "interest", "purchase"]
BANK_DEBIT_WORDS = [
    "debit", "payment", "withdrawal", "transfer to", "transfer out", "cheque", "check", "fee", "service",
]
BANK_CREDIT_WORDS = ["credit", "interest", "deposit", "transfer from", "transfer in"]

# Header words of statement tables.
TABLE_HEADERS = {
    "date": ["date", "posted date", "transaction date", "activity date", "trans date", "trans.", "posted",
             "value date", "effective date"],
    "desc": ["description", "details", "merchant", "transaction", "activity", "memo", "payee", "narrative",
             "particulars", "reference"],
    "debit": ["debit", "withdrawal", "withdrawals", "money out", "paid out", "charge", "charges", "dr",
              "payment out", "amount debit"],
    "credit": ["credit", "deposit", "deposits", "money in", "paid in", "payment in", "cr", "amount credit"],
    "amount": ["amount", "transaction amount", "net amount"],
    "balance": ["balance", "running balance", "available balance", "closing balance"],
}

# Words beside the ones above in headers that are written as one word.
HEADER_FILLERS = ["cad", "usd", "eur", "gbp", "account"]

# Scoring.
HISTORY_ROWS = 200
RECENT_ROWS = 10
COLD_START_TOTAL = 10
COLD_START_CATEGORY = 5
SAME_AMOUNT = 0.01
TOLERANCE = 0.20
NUMERIC_FEATURES = [
    "log_amount", "amount_zscore", "category_percentile", "spending_freq_7d", "day_of_week", "day_of_month",
    "month", "hour", "is_weekend",
]
CATEGORICAL_FEATURES = ["user_id", "merchant", "category", "transaction_type"]
UNSEEN_LABEL = "__unseen__"
UNKNOWN_LABEL = "unknown"
FOREST_TREES = 50
FOREST_DEPTH = 10
FOREST_MIN_LEAF = 2
SEED = 42
EVALUATION_THRESHOLD = 0.3
SCORING_THRESHOLD = 0.5

# Anomaly sentences.
REASON_GENERIC = "This transaction looks different from your usual spending pattern."
REASON_HIGH = "This is one of your higher %s transactions."
REASON_FREQ = "You've made %d %s purchases in the past 7 days, which is higher than usual."
REASON_TIME = "This transaction happened at an unusual time — it may be worth reviewing."
REASON_HIGH_FREQ = "This is one of your higher %s transactions, and you've made %d purchases in this category recently."
REASON_HIGH_TIME = "This is one of your higher %s transactions, and it happened at an unusual time."
REASON_FREQ_TIME = "You've made %d %s purchases in the past 7 days, and it also happened at an unusual time."
REASON_ALL = (
    "This is one of your higher %s transactions. You've also made %d purchases in this category recently, "
    "and the transaction time was unusual."
)

# Seasonal spending factors (category, months, factor); every other month is 1.
SEASON_FACTORS = [
    ("Shopping", [11, 12], 1.40),
    ("Entertainment", [6, 7, 8], 1.25),
    ("Healthcare", [1], 1.20),
    ("Food & Dining", [6, 7, 8], 1.15),
]

# Anomaly labels searched for in the notes of a labelled set.
ANOMALY_LABELS = [
    "card test", "novel merchant", "behavioral shift", "geographic anomaly", "unusual hour",
    "subscription hijack", "silent fraud", "frequency burst", "dormant account", "category switch",
    "duplicate charge", "velocity anomaly", "mixed anomaly", "income anomaly", "behavioral contradiction",
]
