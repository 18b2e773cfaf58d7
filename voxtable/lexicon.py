"""The patterns, word lists and feature names results depend on.

Everything here is data. Patterns use the shorthands ``\\w \\d \\s \\b`` with their
full-Unicode meaning; ``voxtable.regexes`` turns them into Java patterns.
"""

from __future__ import annotations

# ---- fixed values: masking and separator patterns ----
URL = r"(?:https?://\S+|www\.\S+)"
EMAIL = r"\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b"
PHONE_CHUNK = r"(?<!\d)(?:\+?\d[\d\s\-.]{6,}\d)(?!\d)"
LONG_DIGITS = r"\d{6,}"
SEPARATORS = r"[\/_|]+"
COLON_IN_WORD = r"(?<=\w):(?=\w)"
BRACKET_SUFFIX = r"\s*\[[^\]]+\]\s*$"
PAREN_CODE = r"\(([^()]*)\)\s*$"
ZERO_WIDTH = "[\u200b-\u200f\u202a-\u202e]"
PUNCTUATION = "!?.,\u060c\u061b\u061f"
ARABIC = "[\u0600-\u06ff\u0750-\u077f\u08a0-\u08ff]"
LATIN = r"[A-Za-z]"
ARABIC_MARKS = "[\u0610-\u061a\u064b-\u065f\u0670\u06d6-\u06ed]"
TATWEEL = "\u0640"
ARABIC_VARIANTS = {"\u0623": "\u0627", "\u0625": "\u0627", "\u0622": "\u0627", "\u0649": "\u064a"}
DOUBLED_PLATFORMS = ("facebook", "twitter", "instagram")

# ---- fixed values: telecom spellings and their canonical token, applied in this order ----
TELECOM_SPELLINGS = (
    (r"\b(a\s*d\s*s\s*l|adsl)\b", "adsl"),
    (r"\b(v\s*d\s*s\s*l|vdsl)\b", "vdsl"),
    (r"\b(ftth)\b", "ftth"),
    (r"\b(fttx)\b", "fttx"),
    (r"\b(4\s*g|4g)\b", "4g"),
    (r"\b(3\s*g|3g)\b", "3g"),
    (r"\b(5\s*g|5g)\b", "5g"),
    (r"\b(idoom\s*fibre|idoomfibre)\b", "idoom_fibre"),
    (r"\b(idoom)\b", "idoom"),
    (r"\b(espace\s*client|espaceclient)\b", "espace_client"),
    (r"(?:فضاء\s*الزبون|فضاء\s*الزبائن)", "espace_client"),
    (r"\b(fibre\s*optique|fiber\s*optic|fiber|fibre)\b", "fibre"),
    (r"(?:الفيبر|فيبر|فايبر)", "fibre"),
    (r"\b(modem|modam|modem[e]?)\b", "modem"),
    (r"(?:مودام|مودم)", "modem"),
    (r"\b(wi\s*fi\s*6|wifi\s*6|wifi6)\b", "wifi6"),
    (r"\b(ping)\b", "ping"),
    (r"\b(debit|débit)\b", "debit"),
    (r"\b(mbps|mb/s|mega|megabit)\b", "mbps"),
    (r"\b(gbps|gb/s|giga|gigabit)\b", "gbps"),
)

# ---- fixed values: ticket feature names and keyword flags ----
TIME_FEATURES = (
    "handle_year", "handle_month", "handle_day", "handle_dayofyear", "handle_dayofweek",
    "handle_hour", "handle_minute", "handle_iso_week", "handle_time_ordinal",
    "handle_is_weekend", "handle_time_missing",
)
TICKET_TEXT_FEATURES = (
    "text_len", "word_count", "digit_count", "has_num_token", "has_phone_token",
    "mbps_value_count", "mbps_value_max", "mo_value_count", "mo_value_max",
)
TICKET_MISSING_FEATURES = ("subs_level_missing",)
TICKET_KEYWORDS = (
    ("has_pon", r"\bpon\b"),
    ("has_los", r"\blos\b"),
    ("has_los_rouge", r"\blos\s+rouge\b"),
    ("has_los_allume", r"\blos\s+allum\w*\b"),
    ("has_los_eteint", r"\blos\s+eteint\w*\b"),
    ("has_pon_stable", r"\bpon\s+stable\b"),
    ("has_pon_instable", r"\bpon\s+instable\b"),
    ("has_pon_clignote", r"\bpon\s+clignot\w*\b"),
    ("has_signal_bad", r"(?:\blos\s+(?:rouge|allum\w*)\b)|(?:\bpon\s+(?:clignot\w*|instable|rouge)\b)"),
    ("has_debit", r"\bdebit\b"),
    ("has_chute_debit", r"\bchute\s+de\s+debit\b"),
    ("has_mbps", r"\bmbps\b"),
    ("has_download", r"\bdownload\b"),
    ("has_upload", r"\bupload\b"),
    ("has_imei", r"\bimei\b"),
    ("has_gps", r"\bgps\b"),
    ("has_adsl", r"\badsl\b"),
    ("has_ftth", r"\bftth\b"),
    ("has_fttx", r"\bfttx\b"),
    ("has_4g", r"\b4g\b"),
    ("has_ont", r"\bont\b"),
    ("has_modem", r"\bmodem\b"),
)
MBPS_VALUE = r"\b(\d+(?:[.,]\d+)?)\s*mbps\b"
MO_VALUE = r"\b(\d{1,4})\s*mo\b"

# ---- fixed values: comment feature names and keyword flags ----
COMMENT_TEXT_FEATURES = (
    "len_chars", "len_tokens", "digit_count", "punct_count",
    "has_phone_token", "has_url_token", "has_email_token", "has_id_token",
)
COMMENT_KEYWORDS = (
    ("has_fibre", r"\b(?:fibre|ftth|fttx|idoom_fibre)\b|(?:الفيبر|فيبر|فايبر)"),
    ("has_adsl", r"\b(?:adsl|vdsl)\b"),
    ("has_4g", r"\b(?:3g|4g|5g)\b"),
    ("has_modem", r"\b(?:modem)\b|(?:مودام|مودم)"),
    ("has_portal", r"\b(?:espace_client|espace\s*client|application|app|login|mot\s*de\s*passe)\b|(?:فضاء\s*الزبون|فضاء\s*الزبائن|الولوج|حساب|كلمة\s*السر)"),
    ("has_ping", r"\bping\b"),
    ("has_debit", r"\bdebit\b|(?:تدفق|سرعه|البينغ)"),
    ("has_mbps", r"\b(?:mbps|gbps)\b"),
    ("has_prices", r"\b(?:prix|tarif|cher|promo|offre|offres)\b|(?:سعر|الاسعار|الأسعار|اسعار|العروض)"),
    ("has_outage", r"\b(?:panne|coupure|down|hs|marche\s+pas|ne\s+marche\s+pas)\b|(?:انقطاع|عطل|مقطوع|ماكاش|مكانش|walou)"),
    ("has_support_numbers", r"\b(?:100|12|1500)\b"),
)

# ---- fixed values: intent flags put in front of classifier text (last item: ignore case) ----
INTENT_FLAGS = (
    ("FIBRE", r"\b(?:fibre|ftth|fttx|idoom_fibre)\b", True),
    ("MODEM", r"\b(?:modem|wifi6)\b", True),
    ("PORTAL", r"\b(?:espace_client|espace\s*client|application|app|login|mot\s*de\s*passe)\b|(?:فضاء\s*الزبون|فضاء\s*الزبائن|الولوج|حساب|كلمة\s*السر)", True),
    ("PRICES", r"\b(?:prix|tarif|cher|promo|offre|offres)\b|(?:سعر|الاسعار|الأسعار|اسعار|العروض)", True),
    ("OUTAGE", r"\b(?:panne|coupure|down|hs|marche\s+pas|ne\s+marche\s+pas)\b|(?:مقطوع|انقطاع|ماكاش|مكانش|تقطع|مقطوعة)", True),
    ("SUPPORT", r"\b(?:100|12|1500)\b", False),
    ("SPEED", r"\b(?:mbps|gbps)\b|(?:ميغا|جيغا)", True),
    ("WAIT", r"\b(?:a\s*quand|quand|depuis|attend|attente)\b|(?:وقتاش|متي|مزال|مازال|نستناو|نستنو|انتظار|راني\s+في|راه|راهم)", True),
    ("LOCATION", r"\b(?:wilaya|commune|quartier|centre|ville|rue)\b|(?:ولاية|بلدية|حي|شارع|مدينة|الجزائر|وهران|عنابة|قسنطينة|سطيف|بجاية|الشلف|الجلفة)", True),
    ("MOBILE", r"\b(?:3g|4g|5g)\b|(?:جيل\s*4|جيل\s*5)", True),
    ("TOWER", r"\b(?:antenne|tour|pylone|emetteur|emet(?:teur|trice))\b|(?:برج|أبراج|ابراج)", True),
    ("PRAISE", r"\b(?:bravo|merci|felicitations?|félicitations?)\b|(?:مبروك|بالتوفيق|👏|❤️)", True),
    ("LAUGH", r"(?:هههه+|lol|mdr|😂|🤣)", True),
)

# ---- fixed values: patterns whose per-class rate is reported (last item: ignore case) ----
DOMAIN_PATTERNS = (
    ("has_fibre", r"\b(?:fibre|ftth|fttx|fiber|idoom_fibre)\b|فيبر|الفيبر|فايبر", True),
    ("has_modem", r"\b(?:modem|wifi6|wifi)\b|مودام|مودم", True),
    ("has_portal", r"\b(?:espace\s*client|espace|application|app|client|compte|login|mot\s*de\s*passe)\b|فضاء\s*الزبون|فضاء|الولوج|حساب|كلمة\s*السر", True),
    ("has_prices", r"\b(?:prix|tarif|cher|promo|offre|offres)\b|سعر|الاسعار|الأسعار|اسعار|العروض", True),
    ("has_outage", r"\b(?:panne|coupure|down|hs|marche\s+pas|ne\s+marche\s+pas)\b|مقطوع|انقطاع|ماكاش|مكانش|تقطع|مقطوعة", True),
    ("has_support_nums", r"\b(?:100|12|1500)\b", False),
    ("has_speed_units", r"\b(?:mbps|gbps|mega|giga)\b|ميغا|جيغا", True),
)

# ---- fixed values: noise patterns counted when profiling (last item: ignore case) ----
NOISE_PATTERNS = (
    ("url_candidates", URL, True),
    ("email_candidates", EMAIL, True),
    ("phone_like_candidates", PHONE_CHUNK, False),
    ("long_digit_seq_ge6", LONG_DIGITS, False),
    ("repeated_punct_ge3", "([" + PUNCTUATION + r"])\1{2,}", False),
    ("elongated_latin_ge4", r"([A-Za-z])\1{3,}", False),
)
LENGTH_QUANTILES = (0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0)

# ---- fixed values: tokenizer, header candidates, gating defaults ----
TOKEN = r"<[^>]+>|" + ARABIC + r"+|[a-zA-Z]+|\d+"
HEADER_EXACT = {
    "id": ("id", "idx", "index"),
    "platform": ("platform", "reseau_social", "reseaux_social", "reseau"),
    "text": ("comment", "commentaire", "commentaire_client", "message", "texte", "content"),
    "target": ("class", "classe", "label", "target", "y"),
}
HEADER_CONTAINS = {
    "id": ("id",),
    "platform": ("social", "platform"),
    "text": ("comment", "message"),
}
TARGET_FALLBACK = ("class_int", "classid")
SUBMISSION_COLUMNS = ("id", "class_int")
CSV_ENCODINGS = ("utf-8", "utf-8-sig", "cp1252", "latin-1")
GATE_CLASSES = (0, 3, 4, 5)
GATE_FALLBACK = 2
GATE_OVERRIDES = {5: 1}
# ---- end of fixed values ----
