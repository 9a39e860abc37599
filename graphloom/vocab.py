"""Word lists, patterns and constants that the results depend on."""

from __future__ import annotations

# --- fixed values: labels, scores and limits ---
NODE_LABELS = ("Company", "Person", "Event", "Policy", "Indicator", "Sector")
SESSIONS = ("pre_market", "regular", "post_market", "closed")
SCORE_EXACT, SCORE_ALIAS, SCORE_FUZZY = 1.0, 0.85, 0.65
FUZZY_CUTOFF = 0.55
WEIGHTS = {"entity": 0.35, "relation": 0.25, "temporal": 0.20, "penalty": 0.20, "hop_penalty": 0.08, "relevance": 0.15}
ANCHOR_SCORE = 0.75

# --- fixed values: default properties of the entity types ---
DEFAULT_PROPERTIES = {
    "Company": ("ticker", "sector", "exchange", "market_cap", "industry"),
    "Person": ("role", "affiliation"),
    "Sector": ("index", "industry_group"),
    "Event": ("event_type", "severity", "date"),
    "Policy": ("policy_type", "effective_date", "issuing_authority"),
    "Indicator": ("indicator_name", "value", "unit", "period"),
}

# --- fixed values: stopwords of span extraction ---
STOPWORDS = (
    "tell me about what do you know is the find who happened with doing a an in of are was were has have had how why when "
    "which that this it its from to for on by at be been being will would could should can may might shall not no any all some "
    "give show list get explain describe industries group limited ltd inc corp co and or but if then than so yet"
).split()

# --- fixed values: what a user may type, and the names to try for it, in order ---
ALIASES = {
    "infosys": ["infosys"],
    "infy": ["infosys"],
    "wipro": ["wipro"],
    "cipla": ["cipla"],
    "aurobindo": ["aurobindo pharma"],
    "aurobindo pharma": ["aurobindo pharma"],
    "navin fluorine": ["navin fluorine"],
    "ultratech": ["ultratech cement"],
    "ultratech cement": ["ultratech cement"],
    "larsen": ["larsen & toubro"],
    "l&t": ["larsen & toubro"],
    "larsen & toubro": ["larsen & toubro"],
    "asian paints": ["asian paints"],
    "avenue supermarts": ["avenue supermarts"],
    "dmart": ["avenue supermarts"],
    "tvs motor": ["tvs motor"],
    "tvs": ["tvs motor"],
    "adani ports": ["adani ports"],
    "adani": ["adani ports"],
    "macrotech": ["macrotech developers"],
    "sanjay malhotra": ["sanjay malhotra"],
    "donald trump": ["donald trump"],
    "trump": ["donald trump"],
    "sebi": ["sebi", "securities and exchange board"],
    "rbi": ["reserve bank of india", "rbi"],
    "sebi regulation": ["regulation 30 of sebi"],
    "regulation 30": ["regulation 30 of sebi"],
    "gdp": ["gross domestic product", "gdp"],
    "inflation": ["inflation", "consumer price index", "cpi"],
    "crude oil": ["west texas intermediate", "crude"],
    "wti": ["west texas intermediate"],
    "reliance": ["reliance industries", "reliance group"],
    "tcs": ["tata consultancy"],
    "hdfc": ["hdfc bank", "housing development finance"],
    "hdfc bank": ["hdfc bank"],
    "icici": ["icici bank"],
    "bajaj": ["bajaj finance", "bajaj auto"],
    "tata": ["tata motors", "tata steel", "tata consultancy"],
    "sensex": ["sensex", "bse sensex"],
    "nifty": ["nifty 50", "nifty"],
    "taxes": ["tariffs", "us tariffs", "trump tariffs"],
    "tax": ["tariffs", "us tariffs"],
    "duty": ["tariffs", "us tariffs", "tariff hike"],
    "duties": ["tariffs", "us tariffs", "tariff hike"],
    "import duty": ["tariffs", "tariff hike"],
    "us taxes": ["us tariffs", "tariffs"],
    "american taxes": ["us tariffs", "tariffs"],
    "american tariffs": ["us tariffs", "tariffs"],
    "trump tax": ["trump tariffs", "us tariffs"],
    "trade war": ["us tariffs", "tariffs", "trump tariffs"],
    "trade tension": ["us tariffs", "tariffs"],
    "tariff war": ["us tariffs", "tariffs", "trump tariffs"],
    "reciprocal tariff": ["reciprocal tariff rate", "us tariffs"],
    "indian markets": ["stock market", "indian stock market", "india inc"],
    "indian market": ["stock market", "indian stock market", "india inc"],
    "stock markets": ["stock market"],
    "equity market": ["stock market"],
    "equity markets": ["stock market"],
    "share market": ["stock market"],
    "indian economy": ["india inc", "gdp", "gross domestic product"],
    "india market": ["stock market", "india inc"],
    "market": ["stock market", "market"],
    "markets": ["stock market", "market"],
    "rate cut": ["repo rate cut", "rate cut"],
    "repo rate": ["repo rate", "rate cut"],
    "interest rate": ["repo rate", "rate cut", "interest rates"],
    "interest rates": ["interest rates", "repo rate"],
    "monetary policy": ["monetary policy", "rbi", "reserve bank of india"],
    "oil": ["crude oil", "west texas intermediate", "brent crude"],
    "petroleum": ["crude oil"],
    "gold": ["gold prices", "gold"],
    "silver": ["silver"],
    "pharma": ["pharmaceutical", "sun pharmaceutical", "cipla"],
    "pharmaceuticals": ["pharmaceutical", "sun pharmaceutical"],
    "it sector": ["it services", "infosys", "wipro"],
    "technology": ["it services", "infosys", "wipro"],
    "banking": ["bank", "hdfc bank", "icici bank", "state bank of india"],
    "banks": ["bank", "hdfc bank", "icici bank"],
    "automobile": ["auto", "tata motors", "maruti suzuki india"],
    "auto sector": ["auto", "tata motors", "maruti suzuki india"],
}

# --- fixed values: predicate phrases and the relation types they name ---
PREDICATES = {
    "report": ["REPORTS"],
    "reports": ["REPORTS"],
    "reported": ["REPORTS"],
    "filing": ["REPORTS"],
    "filed": ["REPORTS"],
    "quarterly": ["REPORTS"],
    "earnings": ["REPORTS"],
    "results": ["REPORTS"],
    "announced": ["ANNOUNCES"],
    "announces": ["ANNOUNCES"],
    "announcement": ["ANNOUNCES"],
    "declared": ["ANNOUNCES"],
    "launched": ["ANNOUNCES"],
    "ipo": ["ANNOUNCES"],
    "listing": ["ANNOUNCES"],
    "dividend": ["ANNOUNCES"],
    "buyback": ["ANNOUNCES"],
    "merger": ["ANNOUNCES"],
    "acquired": ["ANNOUNCES"],
    "impacted": ["IMPACTS"],
    "impact": ["IMPACTS"],
    "affected": ["IMPACTS"],
    "affect": ["IMPACTS"],
    "benefited": ["IMPACTS"],
    "influenced": ["IMPACTS"],
    "driven by": ["IMPACTS"],
    "caused by": ["IMPACTS"],
    "surged": ["IMPACTS"],
    "fell": ["IMPACTS"],
    "dropped": ["IMPACTS"],
    "declined": ["IMPACTS"],
    "in focus": ["IS_IN_FOCUS"],
    "focus": ["IS_IN_FOCUS"],
    "spotlight": ["IS_IN_FOCUS"],
    "watch": ["IS_IN_FOCUS"],
    "trending": ["IS_IN_FOCUS"],
    "operates in": ["OPERATES_IN"],
    "sector": ["OPERATES_IN"],
    "part of": ["OPERATES_IN"],
    "belongs to": ["OPERATES_IN"],
    "industry": ["OPERATES_IN"],
    "ceo": ["LEADS", "ANNOUNCES"],
    "chief executive": ["LEADS"],
    "head of": ["LEADS"],
    "led by": ["LEADS"],
    "founded": ["ANNOUNCES"],
    "founder": ["ANNOUNCES"],
    "regulated by": ["IMPACTS"],
    "rbi policy": ["ANNOUNCES", "IMPACTS"],
    "rbi rate": ["ANNOUNCES", "IMPACTS"],
    "rate cut": ["ANNOUNCES", "IMPACTS"],
    "repo rate": ["ANNOUNCES", "IMPACTS"],
    "sebi": ["ANNOUNCES", "IMPACTS"],
    "policy": ["ANNOUNCES"],
    "related to": ["IMPACTS"],
    "linked to": ["IMPACTS"],
}

# --- fixed values: temporal words and the comparison they ask for ---
TEMPORAL_WORDS = {"after": "after", "before": "before", "since": "after", "following": "after", "prior to": "before", "during": "during", "in": "during"}

# --- fixed values: synonyms rewritten before the search, in order ---
SYNONYMS = [
    (r"\bus\s+taxes?\b", "US tariffs"),
    (r"\bamerican\s+taxes?\b", "US tariffs"),
    (r"\bimport\s+duties\b", "US tariffs"),
    (r"\btariff\s+war\b", "US tariffs"),
    (r"\btrade\s+war\b", "US tariffs"),
    (r"\btrade\s+tensions?\b", "US tariffs"),
    (r"\btrump\s+taxes?\b", "Trump tariffs"),
    (r"\breciprocal\s+tariffs?\b", "reciprocal tariff rate"),
    (r"\bindian\s+markets?\b", "Indian stock market"),
    (r"\bindian\s+stocks?\b", "Indian stock market"),
    (r"\bstock\s+markets?\b", "stock market"),
    (r"\bequity\s+markets?\b", "stock market"),
    (r"\bshare\s+markets?\b", "stock market"),
    (r"\binterest\s+rates?\b", "repo rate"),
    (r"\brate\s+cuts?\b", "repo rate cut"),
    (r"\bmonetary\s+policy\b", "RBI monetary policy"),
    (r"\bindian\s+economy\b", "India Inc"),
    (r"\bcrude\s+oil\b", "crude oil prices"),
]

# --- fixed values: patterns of question types, tried in this order ---
CHAIN_PATTERNS = [
    r"which\s+\w+\s+benefited\s+from",
    r"companies?\s+(that|which)\s+(were|are|got)\s+(affected|impacted|benefited)",
    r"what\s+(changed|happened)\s+after",
    r"(who|which)\s+(was|were|is|are)\s+(involved|affected)\s+(in|by|after)",
    r"following\s+the\s+\w+\s+(of|by|from)",
    r"as\s+a\s+result\s+of",
    r"(connection|relationship|link|relation|impact|effect|influence)\s+(between|of|from)",
    r"how\s+(does|did|do|has|have|is|are)\s+.{3,60}\s+(affect|impact|influence|relate\s+to|connect)",
    r"what\s+(is|was|are|were)\s+the\s+(impact|effect|influence|connection|relationship|link|role)",
    r"(why|how)\s+(did|does|has|have|is|are)\s+.{3,40}\s+(cause|lead|contribute|result)",
    r"(impact|effect|influence|role)\s+of\s+.{3,40}\s+on\s+",
]
INTERSECTION_PATTERNS = [r"(both|all)\s+\w+\s+and\s+\w+", r"common\s+(between|across)", r"also\s+\w+"]
TEMPORAL_PATTERNS = [
    r"\b(after|before|since|during|in|on|prior to|following)\b.{2,30}\b(\d{4}|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\b",
    r"\b(q[1-4]|quarter|fy|fiscal year|financial year)\b",
]

# --- fixed values: forms "between A and B", "impact of A on B", "how does A affect B" ---
BETWEEN_PATTERNS = [
    r"(?i)\b(?:connection|relationship|link|relation|impact|difference)\s+between\s+(.+?)\s+and\s+(.+?)(?:\?|$)",
    r"(?i)\b(?:impact|effect|influence|role|consequence)\s+of\s+(.+?)\s+on\s+(.+?)(?:\?|$)",
    r"(?i)\bhow\s+(?:does|did|has|do)\s+(.+?)\s+(?:affect|impact|influence|relate\s+to|connect\s+to)\s+(.+?)(?:\?|$)",
]
# --- fixed values: connectors that split a chain question; the last one's own words stay as a part ---
CONNECTORS = [r"\s+after\s+", r"\s+following\s+", r"\s+because\s+of\s+", r"\s+as\s+a\s+result\s+of\s+", r"\s+due\s+to\s+", r"\s+that\s+(benefited|were affected)\s+by\s+"]

# --- fixed values: pronouns that stand for the last entity and the last event ---
ENTITY_PRONOUNS = r"(?i)\b(they|their|them|it|its|the company|this company|that company)\b"
EVENT_PRONOUNS = r"(?i)\b(that event|this event|the event|it)\b"

# --- fixed values: noise names in results, in builds, and by label in the cleaner ---
RESULT_NOISE = (
    r"(?i)^(joint\s+venture|special\s+purpose\s+vehicle|integrated\s+back.end|four\s+tranches|multiple\s+tranches|tepid\s+condition"
    r"|overbought\s+levels?|oversold\s+levels?|trade\s+spotlight|final\s+dividend|interim\s+dividend|revisions?\s+in\s+credit\s+ratings?)$"
)
BUILD_NOISE = (
    r"^([\d\s%.,/-]+|\d+(\.\d+)?\s*(million|billion|crore|lakh|thousand|tons?|kg|usd|inr|year|quarter|fy\d*)?|rs\.?\s*[\d.,]*"
    r"|joint\s+venture|special\s+purpose\s+vehicle|spv|integrated\s+back[\s\-]?end|back[\s\-]?end|front[\s\-]?end|final\s+dividend|interim\s+dividend"
    r"|trade\s+spotlight|market\s+update|press\s+release|four\s+tranches|multiple\s+tranches|tranches?"
    r"|(buy|sell|hold|neutral|overweight|underweight)\s*|(overbought|oversold|tepid)\s*(condition|level|zone)?|[a-z]{1,4})$"
)
LABEL_NOISE = {
    "Company": ("joint venture", "special purpose vehicle", "spv", "integrated back-end", "back-end", "four tranches", "multiple tranches", "final dividend", "interim dividend"),
    "Indicator": ("tepid condition", "manappuram finance is at overbought levels", "overbought levels", "oversold levels"),
    "Policy": ("integrated back-end",),
}

# --- fixed values: entity merging ---
PROTECTED_TOKENS = (
    "jio", "retail", "power", "infrastructure", "capital", "securities", "insurance", "finance", "bank", "asset", "petroleum", "energy", "pharma", "healthcare",
    "motors", "auto", "steel", "cement", "telecom", "media", "realty", "housing", "ventures", "foundation", "mutual fund", "amc", "trustee", "mobility",
)
NEVER_MERGED = [
    r"^\d", r"^-?\d", r"^\$", r"(?i)^rs\b", r"^₹", r"(?i)\bfy\d{2}", r"\b20\d{2}-\d{2}-\d{2}\b", r"(?i)\d+\s*(crore|lakh|mtpa|million|billion|shares|points|percent|per\s+cent)\b",
]
UNMERGED_LABELS = ("Event", "Policy")
LEGAL_SUFFIXES = (" ltd.", " ltd", " limited", " inc.", " inc", " corp.", " corp", " llp", " llc", " pvt", " private")
CANONICAL_NAMES = [
    ("company", "reliance industries", "Reliance Industries Ltd"),
    ("company", "hdfc bank", "HDFC Bank"),
    ("company", "tata consultancy", "Tata Consultancy Services"),
    ("company", "infosys", "Infosys Ltd"),
    ("company", "wipro", "Wipro Ltd."),
    ("company", "icici bank", "ICICI Bank"),
    ("company", "axis bank", "Axis Bank"),
    ("company", "kotak mahindra", "Kotak Mahindra Bank"),
    ("company", "bharti airtel", "Bharti Airtel Limited"),
    ("company", "hindustan unilever", "Hindustan Unilever Ltd"),
    ("company", "tata motors", "Tata Motors Ltd"),
    ("company", "tata steel", "Tata Steel Ltd"),
    ("company", "adani ports", "Adani Ports and SEZ Ltd"),
    ("company", "adani enterprises", "Adani Enterprises Ltd"),
    ("company", "maruti suzuki", "Maruti Suzuki India Ltd"),
    ("company", "state bank", "State Bank of India"),
]

# --- fixed values: relation types as phrases, in steps and in answers ---
STEP_PHRASES = {
    "REPORTS": "reported", "ANNOUNCES": "announced", "IMPACTS": "impacted", "IS_IN_FOCUS": "is in focus alongside", "OPERATES_IN": "operates in the", "CEO_OF": "serves as CEO of",
    "LEADS": "leads", "FOUNDED": "founded", "PART_OF": "is part of", "REGULATES": "is regulated by", "REGULATED_BY": "is regulated by", "INFLUENCES": "influences",
    "RATE_CHANGE": "underwent a rate change affecting", "POLICY_CHANGE": "was subject to a policy change from", "ACQUIRED": "acquired", "MERGED_WITH": "merged with",
    "INVESTED_IN": "invested in", "IMPACTED_BY": "was impacted by", "BENEFITED_FROM": "benefited from", "ANNOUNCED": "announced", "FILED": "filed", "IPO": "went public via IPO on",
    "LISTED_ON": "is listed on", "DIVIDEND": "declared a dividend", "BUYBACK": "conducted a share buyback", "RELATED_TO": "is related to", "LINKED_TO": "is linked to",
    "JOINT_VENTURE": "entered a joint venture with", "PARTNERSHIP_WITH": "entered a partnership with",
}
ANSWER_PHRASES = {
    "REPORTS": "reported", "ANNOUNCES": "announced", "IMPACTS": "impacted", "IS_IN_FOCUS": "is in focus alongside", "OPERATES_IN": "operates in", "CEO_OF": "is the CEO of",
    "LEADS": "leads", "FOUNDED": "founded", "PART_OF": "is part of", "REGULATES": "is regulated by", "REGULATED_BY": "is regulated by", "INFLUENCES": "influences",
    "RATE_CHANGE": "changed rate affecting", "POLICY_CHANGE": "introduced policy change for", "ACQUIRED": "acquired", "MERGED_WITH": "merged with", "INVESTED_IN": "invested in",
    "IMPACTED_BY": "was impacted by", "BENEFITED_FROM": "benefited from", "ANNOUNCED": "announced", "FILED": "filed", "IPO": "had its IPO on", "LISTED_ON": "is listed on",
    "DIVIDEND": "declared dividend", "BUYBACK": "conducted buyback", "RELATED_TO": "is related to", "LINKED_TO": "is linked to",
}

# --- fixed values: strings that are no date ---
NO_DATES = ("YYYY-MM-DD", "UNKNOWN", "N/A", "NA", "NULL", "NONE", "FUTURE", "ONGOING", "IMMEDIATE", "CURRENT", "HISTORICAL", "P_CURRENT", "P_FUTURE", "P_PAST")

# --- fixed values: scripts of the supported languages, ties in this order ---
SCRIPT_RANGES = [("ta", "஀-௿"), ("te", "ఀ-౿"), ("kn", "ಀ-೿"), ("ml", "ഀ-ൿ"), ("hi", "ऀ-ॿ")]
DEVANAGARI_LATIN = dict(
    zip(
        "अ आ इ ई उ ऊ ए ऐ ओ औ क ख ग घ च छ ज झ ट ठ ड ढ त थ द ध न प फ ब भ म य र ल व श ष स ह ं ा ि ी ु ू े ै ो ौ ् ँ ः".split(" "),
        "a aa i ii u uu e ai o au k kh g gh ch chh j jh t th d dh t th d dh n p ph b bh m y r l v sh sh s h n a i i u u e ai o au  n h".split(" "),
    )
)
