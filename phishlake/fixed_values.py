"""Fixed values.

The short tables, thresholds and patterns below decide results, so they are
stated once, as plain text. They are defaults: every job takes its own values
through a config object. Large lists (trusted hosts, known-bad hosts, keyword
categories, organisations, rules) are inputs and are not kept here.
"""

# --- fixed values: verdict bands -------------------------------------------
BAND_HIGH = 80
BAND_MEDIUM = 55
BAND_LOW = 30
SCORE_CAP = 100

# --- fixed values: sensitivity shifts --------------------------------------
SENSITIVITY_SHIFT = {"strict": 15, "balanced": 0, "permissive": -15}

# --- fixed values: URL signal weights --------------------------------------
WEIGHT_LOOKALIKE = 60
WEIGHT_FAKE_GOV = 50
WEIGHT_RISKY_TLD = 30
WEIGHT_HYPHENS = 20
WEIGHT_IP_HOST = 40
WEIGHT_ENCODED_HOST = 40
WEIGHT_SUBDOMAIN_SPOOF = 45
MIN_HYPHENS = 3
MAX_EDIT_DISTANCE = 2

# --- fixed values: URL word lists ------------------------------------------
RISKY_TLDS = (
    ".xyz", ".top", ".click", ".live", ".vip", ".online",
    ".site", ".info", ".biz", ".tk", ".ml", ".ga", ".cf", ".gq",
)
GOV_KEYWORDS = (
    "cra", "canada-revenue", "revenue-canada", "arc-canada",
    "service-canada", "servicecanada", "ircc", "rcmp", "canada-post",
)
GOV_SUFFIXES = (".gc.ca", ".canada.ca")

# --- fixed values: look-alike letters (after lower-casing) -----------------
LOOKALIKE_LETTERS = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p",
    "с": "c", "х": "x", "у": "y", "і": "i",
    "ѕ": "s", "ԁ": "d", "ь": "b",
    # Greek
    "α": "a", "ο": "o", "ε": "e", "ν": "v",
    "ρ": "p", "τ": "t",
    # other Latin-like letters
    "ℓ": "l", "ı": "i", "ƥ": "p", "ɡ": "g", "ɯ": "m",
}
# full-width forms U+FF01..U+FF5E sit 0xFEE0 above their ASCII letters
FULLWIDTH_FIRST, FULLWIDTH_LAST, FULLWIDTH_SHIFT = 0xFF01, 0xFF5E, 0xFEE0

# --- fixed values: page layer ----------------------------------------------
CREDENTIAL_WEIGHT = 25
PAYMENT_HOSTS = (
    "stripe.com", "paypal.com", "squareup.com", "square.com",
    "moneris.com", "interac.ca",
)
CARD_CODE_AUTOCOMPLETE = "cc-csc"
TITLE_CHARS, META_CHARS, TEXT_CHARS = 300, 500, 30000
MAX_FIELDS, LABEL_CHARS = 80, 120

# --- fixed values: message layer -------------------------------------------
MAIL_TEXT_CHARS, MAIL_ANCHORS = 20000, 60
FREE_MAIL_HOSTS = (
    "gmail.com", "outlook.com", "hotmail.com", "yahoo.com", "yahoo.ca",
    "live.com", "live.ca", "icloud.com", "proton.me", "protonmail.com",
    "aol.com", "mail.com", "gmx.com", "zoho.com", "yandex.com",
)
STRUCTURAL_PREDICATES = (
    "attachment_extension_in",
    "or_password_protected_archive",
    "spf_or_dkim_or_dmarc_failed",
    "reply_to_domain_in",
    "link_text_domain_differs_from_href_domain",
    "link_url_is_ip_address",
    "email_body_contains_html_form",
)

# --- fixed values: sender reputation ---------------------------------------
REPUTATION_WEIGHTS = {
    "random_sender_domain": 30,
    "random_sender_local_part": 25,
    "deep_subdomain_chain_sender": 20,
    "abused_sender_tld": 25,
    "digit_mixed_sender_domain": 10,
}
DEEP_CHAIN_LABELS = 5
RANDOM_MIN_LETTERS = 8
COMMON_LETTER_PAIRS = (
    "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng "
    "se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si "
    "om ur ca el ta la ns di fo ho pe ec pr ui id ge no rt et ie pa pl pp "
    "ot ad pi po us wa wo we wh wi tr tu su sc sh sp ss sa ld lo ke ki na ni "
    "nu mi mo mu ba bo bu bi do du da fe fa fi fu ga go gu gi gr gl br cr dr "
    "fr sk sl sm sn sw tw qu ph ck nk mp ct ft lt"
).split()
NEVER_ENGLISH_PAIRS = (
    "fq", "qw", "qx", "qz", "jx", "xj", "zx", "xz", "jq", "qj", "zq", "jz", "zj",
    "wj", "jw", "vh", "hv", "hj", "jh", "kx", "xk", "bq", "qb", "fz", "zf",
    "gx", "xg", "vf", "fv", "wx", "xw", "vk", "kv", "gq", "qg", "hq", "qh",
)
ROLE_MAILBOX_WORDS = (
    "noreply", "donotreply", "notifications", "notification", "support",
    "customerservice", "billing", "newsletter", "marketing", "accounts", "service",
)
ABUSED_SUFFIXES = (
    ".eu.com", ".biz.id", ".web.id", ".or.id", ".co.id", ".my.id", ".ru.com",
    ".cn.com", ".sa.com", ".us.com", ".uk.com", ".gb.com", ".za.com", ".br.com",
)

# --- fixed values: enrichment ----------------------------------------------
YOUNG_DOMAIN_DAYS = 90
YOUNG_DOMAIN_WEIGHT = 30
AGE_TTL_SECONDS = 7 * 86400
PHISH_TTL_SECONDS = 86400
FAILED_LOOKUP_TTL_SECONDS = 3600

# --- fixed values: operations ----------------------------------------------
KNOWN_BAD_CAP = 8000
RATE_LIMIT_CALLS = 30
RATE_LIMIT_TTL_SECONDS = 60
MAIL_DEBOUNCE_MS = 600
ENDED_SUBSCRIPTION_STATES = ("canceled", "unpaid", "incomplete_expired")
# four groups of four symbols without 0, 1, I, L-like letters, behind a prefix
LICENCE_KEY_GROUPS = r"(-[2-9A-HJKMNP-Z]{4}){4}"
LIST_DOMAIN_PATTERN = r"^[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
