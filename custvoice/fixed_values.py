"""Fixed values.

Every word list, domain, token and message format below has to be exactly as it
is for results to agree with the behaviour this engine reproduces.  They are
data, not logic: all of them can be replaced through ``custvoice.config``.
"""

# --- accounts and brand ------------------------------------------------------

OFFICIAL_ACCOUNTS = ("Freebox", "free", "Free_1337")

BRAND_KEYWORDS = (
    "free", "freebox", "@free", "@freebox", "free mobile", "freebox delta",
    "free fibre", "free fiber",
)

# --- lexical word lists (fixed values) ---------------------------------------

STRONG_NEGATIVE = (
    "scandale", "honte", "honteux", "nul", "nulle", "lamentable", "inadmissible",
    "inacceptable", "catastrophique", "merde", "arnaque", "vol", "voleur",
)

WEAK_NEGATIVE = (
    "problème", "probleme", "bug", "lent", "lente", "déçu", "decu", "décevant",
    "marche pas", "ne marche pas", "ne fonctionne pas", "fonctionne pas", "panne",
    "coupure", "instable",
)

PRAISE = (
    "merci", "bravo", "top", "super", "génial", "genial", "parfait", "au top", "nickel",
)

COMPLAINT = (
    "panne", "coupure", "incident", "bug", "debit", "débit", "connexion", "connection",
    "réseau", "reseau", "facture", "prélèvement", "prelevement", "surfacturation",
    "remboursement", "service client", "sav", "attente", "retard",
)

BREAKDOWN_PHRASES = ("ne marche pas", "marche pas", "ne fonctionne pas")

URGENCY = (
    "urgent", "urgence", "immédiatement", "immediatement", "tout de suite", "vite",
    "rapidement",
)

CHURN = (
    "résilier", "resilier", "résiliation", "resiliation", "me barre", "je me barre",
    "partir chez", "changer d'opérateur", "changer d’operateur",
)

TOPICS = {
    "fiber_issue": ("fibre", "ftth", "pon", "ont"),
    "mobile_issue": ("4g", "5g", "mobile", "forfait", "sim", "carte sim"),
    "network_issue": ("débit", "debit", "ping", "latence", "lag", "reseau", "réseau"),
    "tv_service_issue": ("tv", "télé", "tele", "chaine", "chaîne", "replay", "vod"),
    "billing_issue": ("facture", "prélèvement", "prelevement", "paiement", "tarif", "prix"),
    "customer_service_issue": ("service client", "sav", "hotline", "support", "conseiller"),
    "equipment_issue": ("box", "freebox", "modem", "routeur", "router", "décodeur", "decodeur"),
}

# --- domains (fixed values) --------------------------------------------------

INTENTS = (
    "complaint", "suggestion", "thanks", "question", "praise", "spam_or_irrelevant", "other",
)

COMPLAINT_TYPES = (
    "none", "network_outage", "slow_connection", "mobile_issue", "fiber_issue",
    "tv_service_issue", "billing_issue", "customer_service_issue",
    "account_contract_issue", "equipment_issue", "other_complaint",
)

SENTIMENTS = ("negative", "neutral", "positive")

PRIORITIES = ("none", "low", "medium", "high", "critical")

TICKET_STATUSES = ("Nouveau", "En cours", "Résolu")

# --- formats (fixed values) --------------------------------------------------

# Tokens a CSV reader with default null handling turns into null.
CSV_NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

TRUE_WORDS = ("true", "1", "yes", "y")
TRUE_WORDS_SHORT = ("true", "1")

UNPARSED_RESPONSE = "Parsing JSON échoué. Réponse brute: "
UNPARSED_RESPONSE_CHARS = 120
FAILED_CALL = "Erreur LLM : "
LABEL_TEXT_CHARS = 80
DASHBOARD_HEAD_ROWS = 20
PAGE_SIZES = (10, 20, 30, 40, 50)

# --- raw columns (fixed values) ----------------------------------------------

RAW_COLUMNS = (
    "id", "created_at", "full_text", "screen_name", "name", "profile_image_url",
    "user_id", "in_reply_to", "retweeted_status", "quoted_status", "favorite_count",
    "retweet_count", "reply_count", "views_count",
)

# Texts of times that are not numeric dates, and how they are read.  Fixed values.
TIME_FORMATS = (
    (r"^[A-Za-z]{3} \d{2} \d{2}:\d{2}:\d{2} [+-]\d{4} \d{4}$", "MMM dd HH:mm:ss Z yyyy"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^[A-Za-z]{3} \d{1,2},? \d{4}", "MMM d[,] yyyy[ H:mm[:ss]]"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}.* [+-]\d{4}$", "d MMM yyyy H:mm[:ss] Z"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}.* [A-Z]{3}$", "d MMM yyyy H:mm[:ss] z"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}", "d MMM yyyy[ H:mm[:ss]]"),
)
