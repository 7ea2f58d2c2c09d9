"""Patterns, word lists, lookup tables and limits.

Everything here has to stay exactly as it is for results to be right, so the
values are kept together, in natural order, and used from nowhere else.
"""

# --- fixed values: limits -------------------------------------------------
MAX_UPLOAD_MB = 50
DOCUMENT_TTL_HOURS = 24
RATE_LIMIT_REQUESTS = 30
RATE_LIMIT_WINDOW_S = 60
HISTORY_DEPTH = 20
SECTION_RESULTS = 20
ANSWER_SECTIONS = 10
TOPIC_COUNT = 20
CONVERSATION_WINDOW = 20
DEFAULT_FONT_SIZE = 12.0
EDIT_FONT_SIZE = 11.0
MIN_FONT_SIZE = 6.0
MAX_SHRINK = 0.7
WIDTH_TOLERANCE = 1.05
MOVE_MIN_SIZE = 4.0
MOVE_MAX_SIZE = 72.0
BASELINE_DROP = 0.15
HEADING_SIZE_STEP = 2.0
HEADING_MAX_CHARS = 100
SCRIPT_SHARE = 0.1
SCRIPT_CONFIDENCE = 0.8
HIGHLIGHT_COLOR = (1.0, 0.92, 0.23)
HIGHLIGHT_OPACITY = 0.35
INK_COLOR = (0.0, 0.0, 0.0)
INK_WIDTH = 2.0
STAMP_TEXT = "Page {n} of {total}"
STAMP_FONT_SIZE = 10.0
STAMP_MARGIN = 36.0
WATERMARK_TEXT = "CONFIDENTIAL"
WATERMARK_FONT_SIZE = 60.0
WATERMARK_ROTATION = -45.0
WATERMARK_OPACITY = 0.3
UNDO_MARKER = "(current state before undo)"

# --- fixed values: identifiers --------------------------------------------
DOC_ID_PATTERN = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"

# --- fixed values: the characters str.strip() removes ----------------------
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# --- fixed values: entity patterns ----------------------------------------
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE = r"[\+]?[(]?[0-9]{1,4}[)]?[-\s\./0-9]{7,}"
DATE_LONG = (
    r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b(?:January|February|March|April|May|June|July|August"
    r"|September|October|November|December|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
    r"[a-z]*\.?\s+\d{1,2},?\s+\d{2,4}\b"
)
DATE_SHORT = (
    r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
    r"[a-z]* \d{1,2},? \d{4}\b"
)
DATE_NUMERIC = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"
URL = r"https?://[^\s<>\"']+"
MONEY = (
    r"[\$€£]\s?\d[\d,]*\.?\d*\b|\b\d[\d,]*\.\d{2}\b"
    r"(?:\s?(?:USD|EUR|GBP|dollars?|euros?))?"
)
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
PERSON = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2}\b"
NOT_A_PERSON = (
    r"^(?:The |This |That |These |Those |January|February|March|April|May|June|July|August"
    r"|September|October|November|December)"
)
ORGANIZATION = (
    r"\b[A-Z][\w&\-]*(?:\s+[A-Z][\w&\-]*)*\s+(?:Inc|LLC|Ltd|Corp|Corporation|Company|Co|Group"
    r"|Foundation|Institute|Association|University|Bank|Partners)\.?\b"
)
ENTITY_PATTERNS = {
    "emails": EMAIL,
    "phones": PHONE,
    "dates": DATE_LONG,
    "urls": URL,
    "monetary": MONEY,
    "ssns": SSN,
    "people": PERSON,
    "organizations": ORGANIZATION,
}
KEY_INFO_TYPES = ("people", "organizations", "dates", "monetary", "emails", "phones", "urls")
EXTRACT_PATTERNS = {"emails": EMAIL, "phones": PHONE, "dates": DATE_SHORT, "urls": URL}
REDACT_PATTERNS = {"ssn": SSN, "phone": PHONE, "email": EMAIL, "date": DATE_NUMERIC}
MIN_PHONE_CHARS = 7
# what a text must contain for a pattern to be able to match; begins with one character, so that few places are tried
NEEDED_BY = {
    EMAIL: "@",
    PHONE: "[0-9]",
    DATE_LONG: r"(?U)\d(?:[/-]|,?\s+)\d",
    DATE_SHORT: r"(?U)\d(?:[/-]|,?\s+)\d",
    DATE_NUMERIC: r"(?U)\d[/-]\d",
    URL: "://",
    MONEY: r"(?U)[\$€£]\s?\d|\d\.\d{2}",
    SSN: r"(?U)\d-\d{2}-\d",
    PERSON: r"(?U)[A-Z][a-z]+\s+[A-Z][a-z]",
    ORGANIZATION: (
        r"(?U)\s(?:Inc|LLC|Ltd|Corp|Corporation|Company|Co|Group"
        r"|Foundation|Institute|Association|University|Bank|Partners)\.?\b"
    ),
}

# --- fixed values: topic stop words ---------------------------------------
TOPIC_WORD = r"\b[a-zA-Z]{4,}\b"
TOPIC_MIN_CHARS = 4
STOP_WORDS = (
    "this", "that", "with", "from", "have", "been", "were", "will", "would",
    "could", "should", "their", "there", "they", "them", "than", "then",
    "also", "each", "which", "when", "what", "where", "about", "into",
    "more", "some", "such", "only", "over", "other", "after", "before",
    "between", "through", "under", "these", "those", "does", "done",
    "being", "very", "just", "because", "most", "many", "much", "your",
    "page", "document",
)

# --- fixed values: language indicator words, in tie-breaking order ---------
LANGUAGE_WORD = r"\b[a-z]+\b"
LANGUAGE_WORDS = {
    "english": ("the", "and", "is", "in", "to", "of", "for", "that", "with", "this", "are", "was", "have", "from"),
    "spanish": ("el", "la", "de", "en", "que", "los", "del", "las", "por", "con", "una", "para", "como", "pero"),
    "french": ("le", "la", "de", "et", "les", "des", "en", "une", "est", "que", "dans", "pour", "pas", "avec"),
    "german": ("der", "die", "und", "den", "das", "ist", "ein", "eine", "nicht", "auf", "mit", "sich", "auch", "von"),
    "portuguese": ("de", "que", "em", "para", "com", "uma", "por", "mais", "como", "dos", "das", "foi", "ser", "tem"),
    "italian": ("di", "che", "il", "per", "una", "con", "del", "della", "sono", "anche", "questo", "come", "non", "nel"),
}

# --- fixed values: scripts tested in this order -----------------------------
SCRIPTS = (
    ("CJK", "chinese/japanese/korean", "[一-鿿]"),
    ("Arabic", "arabic", "[؀-ۿ]"),
    ("Cyrillic", "russian/cyrillic", "[Ѐ-ӿ]"),
)

# --- fixed values: span flag bits ------------------------------------------
ITALIC_BIT = 1
MONO_BIT = 3
BOLD_BIT = 4

# --- fixed values: font names to short codes --------------------------------
FONT_CODES = {
    "helvetica": "helv",
    "nimbussansregular": "helv",
    "nimbussansbold": "hebo",
    "nimbussansitalic": "heit",
    "nimbussansbolditalic": "hebi",
    "arial": "helv",
    "arialboldmt": "hebo",
    "arialitalicmt": "heit",
    "arialbolditalimt": "hebi",
    "arialmt": "helv",
    "timesroman": "tiro",
    "timesnewromanpsmt": "tiro",
    "timesnewromanpsboldmt": "tibo",
    "timesnewromanpsitalicmt": "tiit",
    "timesnewromanpsbolditalicmt": "tibi",
    "nimbusromanregular": "tiro",
    "nimbusromanbold": "tibo",
    "nimbusromanitalic": "tiit",
    "nimbusromanbolditalic": "tibi",
    "courier": "cour",
    "courierneweepsmt": "cour",
    "nimbusmonopsregular": "cour",
    "nimbusmonopsbold": "cobo",
    "nimbusmonopsitalic": "coit",
    "nimbusmonopsbolditalic": "cobi",
}
# family code -> (regular, bold, italic, bold italic)
FONT_VARIANTS = {
    "helv": ("helv", "hebo", "heit", "hebi"),
    "tiro": ("tiro", "tibo", "tiit", "tibi"),
    "cour": ("cour", "cobo", "coit", "cobi"),
}
SERIF_HINTS = ("times", "roman", "serif", "garamond", "georgia")
MONO_HINTS = ("courier", "mono", "consol", "menlo")
DISPLAY_MONO_HINTS = ("courier", "mono", "consolas", "menlo")
DISPLAY_SERIF_HINTS = ("times", "serif", "garamond", "georgia")
DISPLAY_NAMES = {
    "mono": ("Courier", "Courier-Bold", "Courier-Oblique", "Courier-BoldOblique"),
    "serif": ("Times-Roman", "Times-Bold", "Times-Italic", "Times-BoldItalic"),
    "sans": ("Helvetica", "Helvetica-Bold", "Helvetica-Oblique", "Helvetica-BoldOblique"),
}

# --- fixed values: list item prefixes ---------------------------------------
LIST_ITEM = r"^(?:[•‣◦⁃\-\*]\s|\d+[\.\)]\s|[a-zA-Z][\.\)]\s)"

# --- fixed values: form patterns -------------------------------------------
UNDERLINE_FIELD = r"([A-Za-z\s]+):\s*_{3,}"
CHECKBOX_FIELD = r"\[([xX\s])\]\s*(.+?)(?:\n|$)"

# --- fixed values: cell characters dropped before a sum ----------------------
CURRENCY_CHARS = ",$€£%"

# --- fixed values: question routing -----------------------------------------
ASKS_ENTITIES = r"email|phone|date|url|link|name|person|organization|company|amount|money"
ASKS_TABLES = r"table|total|sum|row|column|data"

# --- fixed values: message intent patterns, in the order they are tried ------
INTENT_COUNT_LONG = (
    r"how many (?:times?|instances?|occurrences?).*?(?:does?|of|is)\s+[\"']?(.+?)[\"']?\s*"
    r"(?:appear|occur|exist|show|\?|$)"
)
INTENT_COUNT_SHORT = r"count\s+[\"']?(.+?)[\"']?\s*$"
INTENT_PAGES = r"how many pages"
INTENT_REPLACE = (
    r"(?:replace|change|swap|update)\s+[\"'](.+?)[\"']\s+(?:to|with|into)\s+[\"'](.+?)[\"']",
    r"(?:replace|change|swap|update)\s+(.+?)\s+(?:to|with|into)\s+(.+?)\s+"
    r"(?:everywhere|throughout|across|on all pages|in the document|in this document)",
    r"(?:replace|change|swap|update)\s+the\s+(?:name|word|text|phrase)\s+(.+?)\s+(?:to|with)\s+(.+?)$",
    r"(?:replace|change|swap|update)\s+(.+?)\s+(?:to|with|into)\s+(.+?)$",
)
INTENT_SCOPE = r"(?:on|in)\s+page\s+(\d+)"
INTENT_DELETE_TEXT = (
    r"(?:delete|remove|strip|erase)\s+(?:every\s+instance\s+of\s+|all\s+instances\s+of\s+|all\s+"
    r"|the\s+(?:word|text|phrase)\s+)?[\"']?(.+?)[\"']?\s*(?:from|in|on|$)"
)
INTENT_NOT_TEXT = r"^pages?\s+\d"
INTENT_DELETE_PAGES = r"(?:delete|remove)\s+pages?\s+(\d+)(?:\s*(?:through|to|-)\s*(\d+))?"
INTENT_ROTATE = r"rotate\s+(?:page\s+)?(\d+)?"
INTENT_EXTRACT = {
    "emails": r"(?:extract|pull|find|list|get)\s+(?:all\s+)?(?:the\s+)?emails?",
    "phones": r"(?:extract|pull|find|list|get)\s+(?:all\s+)?(?:the\s+)?phone",
    "dates": r"(?:extract|pull|find|list|get)\s+(?:all\s+)?(?:the\s+)?dates?",
    "urls": r"(?:extract|pull|find|list|get)\s+(?:all\s+)?(?:the\s+)?urls?|links?",
}
INTENT_REDACT_SSN = r"redact\s+(?:all\s+)?(?:the\s+)?(?:ssn|social\s+security)"
INTENT_REDACT_OTHER = r"redact\s+(?:all\s+)?(?:the\s+)?(?:phone|email|date)"
INTENT_REDACT_KIND = r"(phone|email|date)"
INTENT_ADD_TEXT = (
    r"(?:add|insert|write|put)\s+(?:the\s+)?(?:text\s+)?[\"'](.+?)[\"']\s+(?:on|to|at)\s+"
    r"(?:page\s+)?(\d+)?"
)
INTENT_SUMMARIZE = r"summarize|summary|sum up|tldr|tl;dr"
INTENT_WORD_COUNT = r"word count|how many words|character count"
MAX_DELETE_TERM = 200
