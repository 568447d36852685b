"""Word lists, thresholds and patterns that results depend on.

Java (Spark), RE2 and Python differ in what ``\\s`` and ``\\w`` mean, so the classes are
spelled out and the same text is valid in Java and in RE2.
"""

# --- fixed values: character classes -------------------------------------------------
WS_SET = (
    r"\s\x0b\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
WS = f"[{WS_SET}]"
# the same set without the plain space
WS_ODD_SET = (
    r"\t\n\x0b\f\r\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
WORD_SET = r"\p{L}\p{N}_"
CONTENT_DROP = f'[^{WORD_SET}{WS_SET}.,!?;:()\\-"]'
TITLE_DROP = f'[^{WORD_SET}{WS_SET}.,!?()\\-"]'
CONTROL = r"[\x00-\x08\x0e-\x1b]"
TOKEN = f"[{WORD_SET}]+"
AFTER_WORD, BEFORE_WORD = f"(?<=[{WORD_SET}])", f"(?=[{WORD_SET}])"
WORD_START, WORD_END = f"(?<![{WORD_SET}])", f"(?![{WORD_SET}])"
BORDER = f"(?:{AFTER_WORD}{WORD_END}|{WORD_START}{BEFORE_WORD})"

# --- fixed values: contact patterns --------------------------------------------------
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE_US = r"(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}"
PHONE_MULTI_US = r"\+?1?[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
PHONE_MULTI_INTL = r"\+?\d{1,3}[-.\s]?\d{1,4}[-.\s]?\d{1,4}[-.\s]?\d{1,9}"
PHONE_MULTI_DASHED = r"\b\d{3}-\d{3}-\d{4}\b"
PHONE_MULTI_PAREN = r"\b\(\d{3}\)\s?\d{3}-\d{4}\b"
TEXT_URL = r"http[s]?://[a-z$-_!]+"  # the range $ to _ holds digits, capitals, % and the other signs
SOCIAL = r"@([A-Za-z0-9_]+)"

# --- fixed values: company and place patterns ----------------------------------------
COMPANY_PATTERNS = (
    r"\b([A-Z][a-z]+ (?:Inc|LLC|Corp|Corporation|Company|Co|Ltd)\.?)\b",
    r"\b([A-Z][a-z]+ & [A-Z][a-z]+)\b",
    r"\b([A-Z]{2,})\b",
)
PLACE_PATTERNS = (
    r"\b([A-Z][a-z]+, [A-Z]{2})\b",
    r"\b([A-Z][a-z]+ [A-Z][a-z]+, [A-Z]{2})\b",
    r"\b(\d{5}(?:-\d{4})?)\b",
)
ENTITY_LIMIT = 10
KEYWORD_LIMIT = 20

# --- fixed values: word lists --------------------------------------------------------
STOP_WORDS = (
    "the a an and or but in on at to for of with by about into through during before "
    "after above below up down out off over under again further then once"
).split()
ENGLISH_WORDS = "the and or but in on at to for of with by".split()
TITLE_SUFFIXES = (" - Homepage", " | Home", " - Home", " - Official Site", " - Official Website")
PRODUCT_WORDS = ("price", "buy", "cart", "product", "purchase", "shipping")
CONTACT_WORDS = ("contact", "email", "phone", "address", "location")
NEWS_WORDS = ("published", "author", "date", "news", "article", "blog")

# --- fixed values: letters that decide a language, in rule order ----------------------
LANGUAGE_LETTERS = (
    ("el", "αβγδεζηθικλμνξοπρστυφχψω"),
    ("fr", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"),
    ("de", "äöüß"),
    ("es", "ñáéíóúü"),
)

# --- fixed values: routing words -----------------------------------------------------
INGEST_SCRIPT_WORDS = ("javascript:", "#", "angular", "react", "vue", "spa")
SMART_CONTENT_WORDS = (
    "news", "blog", "article", "post", "content", "medium.com",
    "substack.com", "linkedin.com/pulse", "wordpress.com",
)
SMART_SCRIPT_WORDS = ("spa", "react", "angular", "vue", "app", "javascript:")
DOCUMENT_SUFFIXES = (".pdf", ".doc", ".xls")

# --- fixed values: worker kinds and their queues --------------------------------------
WORKERS = ("http", "headless", "crawl4ai", "processing")
QUEUES = {
    "http": "scrape_http",
    "headless": "scrape_headless",
    "crawl4ai": "scrape_crawl4ai",
    "processing": "needs_cleaning",
}

# --- fixed values: statuses ----------------------------------------------------------
JOB_STATUSES = ("pending", "processing", "completed", "failed", "cancelled", "paused")
TASK_STATUSES = ("pending", "processing", "completed", "failed", "retrying")
TERMINAL = ("completed", "failed", "cancelled")

# --- fixed values: JSON keys that hold URLs, in order of preference --------------------
URL_KEYS = ("url", "link", "href", "address", "uri")
URL_LIST_KEYS = ("urls", "links", "addresses", "sites")

# --- fixed values: upload limits and types ---------------------------------------------
UPLOAD_SUFFIXES = (".txt", ".csv", ".json", ".xlsx", ".xls")
UPLOAD_MAX_BYTES = 100 * 1024 * 1024
MIME_TYPES = {
    ".txt": "text/plain",
    ".csv": "text/csv",
    ".json": "application/json",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".xls": "application/vnd.ms-excel",
}

# --- fixed values: histogram bounds ------------------------------------------------------
DURATION_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)
SCORE_BUCKETS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)

# --- fixed values: named character references the column engine decodes, "&" last -------
ENTITIES = (
    ("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"),
    ("&hellip;", "…"), ("&mdash;", "—"), ("&ndash;", "–"), ("&rsquo;", "’"),
    ("&lsquo;", "‘"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&#39;", "'"),
    ("&apos;", "'"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"),
)
