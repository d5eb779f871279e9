"""Fixed word lists and limits.

Every operator takes these as parameters, so other dictionaries can be passed in their place.
"""

from __future__ import annotations

# --- Fixed values: results depend on them, they are data and not logic. ---

MAX_ARTICLE_AGE_HOURS = 72
TITLE_LIMIT = 512
AUTHOR_LIMIT = 256

TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "gclid", "fbclid", "_ga", "mc_cid", "mc_eid",
]

ENTITIES = {
    "Company": [
        "Reliance", "TCS", "Infosys", "HDFC Bank", "ICICI Bank", "SBI",
        "State Bank of India", "Bajaj Finance", "L&T", "Larsen & Toubro",
        "Wipro", "HCL Tech", "ITC", "Kotak Mahindra", "Axis Bank",
        "Tata Motors", "Maruti Suzuki", "Sun Pharma", "NTPC",
        "Tata Steel", "Adani", "Adani Enterprises", "Adani Ports",
    ],
    "Regulator": ["RBI", "SEBI", "IRDAI", "PFRDA", "Reserve Bank of India"],
    "Index": ["Nifty", "Nifty 50", "Sensex", "BSE Sensex", "Bank Nifty", "Nifty IT"],
    "Currency": ["Rupee", "INR", "USD", "Dollar", "Euro", "Yen"],
}

ACRONYMS = ["RBI", "SEBI", "IRDAI", "PFRDA", "INR", "USD", "TCS", "SBI", "NTPC", "ITC"]

SECTORS = {
    "Banking": ["bank", "rbi", "lending", "loan", "npa", "hdfc", "icici", "sbi", "repo rate"],
    "IT": ["tcs", "infosys", "wipro", "hcl", "tech", "software", "ai", "cloud"],
    "Pharma": ["pharma", "fda", "sun pharma", "lupin", "dr reddy", "medicine", "drug"],
    "Energy": ["oil", "gas", "coal", "power", "solar", "reliance", "ntpc", "adani green"],
    "FMCG": ["fmcg", "itc", "hindustan unilever", "nestle", "consumer", "retail"],
    "Auto": ["auto", "maruti", "tata motors", "mahindra", "ev", "vehicle"],
    "Telecom": ["telecom", "jio", "airtel", "vodafone", "5g", "spectrum"],
    "Markets": ["nifty", "sensex", "bse", "nse", "stock", "shares", "equity", "bull", "bear"],
    "Economy": ["gdp", "inflation", "cpi", "fiscal", "deficit", "export", "import"],
    "Policy": ["sebi", "budget", "finance minister", "tax", "gst", "tariff", "subsidy"],
}

SENTIMENT = {
    "surge": 0.8, "jump": 0.7, "soar": 0.9, "rally": 0.8, "profit": 0.6,
    "up": 0.3, "growth": 0.5, "gain": 0.5, "outperform": 0.7,
    "upgrade": 0.6, "dividend": 0.5, "boom": 0.8, "record high": 0.9,
    "beat": 0.6, "bullish": 0.8,
    "slump": -0.8, "plunge": -0.9, "crash": -1.0, "fall": -0.5, "drop": -0.5,
    "loss": -0.6, "decline": -0.5, "underperform": -0.7, "downgrade": -0.6,
    "fraud": -1.0, "scam": -1.0, "penalty": -0.7, "layoff": -0.8,
    "bearish": -0.8, "default": -0.9, "cut": -0.4, "miss": -0.6,
}

KEYWORD_STOP_WORDS = [
    "the", "and", "a", "to", "of", "in", "i", "is", "that", "it", "on", "you", "this", "for", "but", "with",
    "are", "have", "be", "at", "or", "as", "was", "so", "if", "out", "not", "said", "will", "has", "from", "by",
    "an", "its", "they", "we", "he", "she", "it", "which", "about", "more", "their", "up", "one", "were",
    "what", "there", "all", "when", "can", "would", "who", "been", "into", "also", "new", "after", "year",
    "two", "time", "first", "over", "just", "like", "could", "than", "now", "some", "other", "how", "only",
    "do", "them", "these", "most", "any", "no", "because", "back", "us", "through", "such", "rs", "crore",
    "lakh", "per", "cent", "percent",
]

SUMMARY_STOP_WORDS = [
    "the", "and", "a", "to", "of", "in", "is", "that", "it", "on", "for", "with", "as", "was", "at", "by", "an",
    "be", "this", "which", "or", "from", "but", "not",
]

DURATION_BOUNDS = [1.0, 5.0, 15.0, 30.0, 60.0, 120.0, 300.0, float("inf")]

# Common English function words left out of the search postings.
SEARCH_STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "had", "has", "have", "he", "her",
    "his", "i", "if", "in", "into", "is", "it", "its", "no", "not", "of", "on", "or", "our", "she", "so",
    "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "we", "were", "what",
    "when", "which", "who", "will", "with", "you", "your",
]
