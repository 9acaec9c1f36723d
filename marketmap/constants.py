"""Fixed values that must equal the original tool's for identical results.

These are data, not logic: word lists, ordered suffixes and paths, prices,
thresholds and sentinels, kept together in their natural order.
"""

# ---- FIXED VALUES (must match the original tool) ----

# Whole words blanked out of a company name before slugging / searching.
SLUG_STRIP_WORDS = ["HOLDINGS", "LIMITED", "GROUP", "LTD", "PLC", "LLP"]

# Name tokens dropped before scoring a search hit.
TOKEN_STOP_WORDS = ["ltd", "limited", "plc", "llp", "group", "the", "and",
                    "services", "company", "holdings"]

# Host fragments that mark a directory / aggregator site (substring test).
DIRECTORY_DOMAINS = [
    "linkedin", "facebook", "companieshouse", "find-and-update", "gov.uk",
    "endole", "duedil", "opencorporates", "dnb.com", "bloomberg", "zoominfo",
    "yell.com", "192.com", "trustpilot", "glassdoor", "indeed",
    "companieslist", "bizstats", "pappers", "northdata", "creditsafe",
    "companycheck", "bizdb", "solocheck", "yahoo.com", "wikipedia",
    "companies-house", "companiesintheuk", "hithorizons", "companieshub",
    "ukcom.biz", "google.com", "bing.com",
]

# Domain guesses, in preference order.
TLD_ORDER = ["co.uk", "com", "uk", "org.uk"]

# Site pages fetched per domain, in order.
PAGE_PATHS = ["/", "/about", "/about-us", "/services", "/what-we-do", "/products", "/our-story"]
MIN_GOOD_CHARS = 500
MAX_GOOD_PAGES = 3
MAX_TOTAL_CHARS = 3000

# Subtrees dropped before taking the text of a page.
DROPPED_HTML_TAGS = ["script", "style", "nav", "footer", "header", "noscript"]
# Elements that have no end tag.
VOID_HTML_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
                  "track", "wbr"]

# Substrings not allowed in a sector name (case-insensitive).
BANNED_WORDS = ["other", "misc", "miscellaneous", "general services",
                "business services", "professional services", "support services",
                "other support"]

EXPECTED_SECTORS = 20
MAX_SUB_SECTORS = 20

# Sentinels and fixed labels.
INSUFFICIENT_DATA = "INSUFFICIENT_DATA"
UNCLASSIFIED = "UNCLASSIFIED"
NONE_AREA = "_NONE_"
NO_SERVICES_RATIONALE = "no services data"
CLASSIFY_MISSING_ERROR = "classify: LLM returned nothing"
ERROR_SEPARATOR = " | "

# Price per call in GBP, by service.
PRICE_GBP = [("search", 0.00024), ("small_model", 0.001), ("large_model", 0.015)]

# Run defaults.
SAMPLE_SIZE = 2500
SAMPLE_SEED = 42
CLUSTER_BATCH = 100
CHECKPOINT_EVERY = 1000
REFRESH_WINDOW = 1000
REFRESH_EVERY = 10000
REFRESH_UNCLASSIFIED_THRESHOLD = 0.05
CONTEXT_SAMPLE_N = 200
FALLBACK_SLUG_CHARS = 40
FALLBACK_HASH_CHARS = 16

# Columns of an exported row, in order.
EXPORT_COLUMNS = [
    "company_number", "company_name", "postcode", "domain", "domain_confidence",
    "domain_method", "services_description", "specialisms", "sector", "sub_sector",
    "classification_confidence", "rationale", "keywords", "taxonomy_version_id",
    "processed_at", "error_log",
]

# Columns of a research-state row, in order.
STATE_COLUMNS = [
    "company_number", "company_name", "postcode", "domain", "domain_confidence",
    "domain_method", "website_raw_text_length", "services_description", "specialisms",
    "sector", "sub_sector", "classification_confidence", "rationale", "keywords",
    "sampled_for_discovery", "taxonomy_version_id", "processed_at", "error_log",
]

# Classification columns blanked when a gap row is sent back for reclassification.
RECLASSIFY_CLEARED = ["sector", "sub_sector", "classification_confidence", "rationale",
                      "keywords", "taxonomy_version_id"]

# Columns a classification patch carries over from the earlier row.
CARRY_OVER = ["domain", "domain_confidence", "domain_method", "website_raw_text_length",
              "services_description", "specialisms", "sampled_for_discovery"]

# ---- end of fixed values ----
