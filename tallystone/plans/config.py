"""Settings of the registered queries. All names and values are made up."""

from ..operators.extract import Windows
from ..operators.pages import Rule

AS_OF = 2001

#: id, label, required, evidence ids that stand in where the id itself has no rows.
METRICS = [
    ("demand_standard", "Standard demand", True, []),
    ("demand_medium", "Medium demand", True, []),
    ("demand_promo", "Promotional demand", False, []),
    ("demand_large", "Large demand", True, []),
    ("demand_small", "Small demand", True, []),
    ("demand_any", "Any budget demand", False, ["demand_economy", "demand_bulk"]),
    ("demand_bulk", "Bulk demand", True, []),
]

CLUSTERS = {"demand_standard": "core", "demand_medium": "core", "promo": "campaign"}
#: Ordered: the first pattern that a metric contains decides.
CLUSTER_PATTERNS = [("_larg", "scale"), ("econ", "budget"), ("demand", "other_demand")]
CLUSTER_LABELS = {"core": "Core products", "campaign": "Campaigns", "scale": "Scale", "budget": "Budget", "other_demand": "Other demand", "unknown": "Unknown"}

URL_KEYS = [("national ledger", "https://ledger.example.org/"), ("registry", "https://registry.example.org/"), ("note", "https://notes.example.org/")]

SYNONYMS = {
    "metric_red": ["red", "red widget", "crimson"],
    "metric_blue": ["blue", "blue bolt"],
    "metric_small": ["small", "small ring", "tiny"],
    "metric_ring": ["ring", "round ring"],
    "metric_gear": ["gear"],
}

#: Keywords, then the name that they stand for, in order of precedence.
RULES = [(["red", "crimson"], "warm"), (["blue"], "cold"), (["ring", "gear"], "round"), (["gear", "bolt"], "metal")]

RELEVANCE_BLOB = "the incidence and prevalence of the population from which that cohort was"
RELEVANCE_TERMS = ["incidence", "prevalence", "cohort", "population", "mortality", "survival"]

CLASSES = [("incidence", ["thing", "incid"]), ("mortality", ["hand", "mort"]), ("rate", ["rate", "tion"])]
#: Names by which a text must mention its subject.
ALIASES = ["the", "der", "que"]

#: alias, canonical name, code.
PLACES = [
    ("nation_0", "nation_0", "N00"), ("n0", "nation_0", "N00"), ("nation_1", "nation_1", "N01"), ("first nation", "nation_1", "N01"),
    ("nation_2", "nation_2", "N02"), ("nation_3", "nation_3", "N03"), ("nation_7", "nation_7", "N07"),
]

SCENARIOS = [("base", "Base", 0.0), ("low", "Low", -0.05), ("high", "High", 0.08)]
GROWTH = {"demand_standard": 0.02, "demand_large": -0.01}

KEYS, KEY_NAMES = ["ASIA", "EUROPE"], {"AMERICA": "AM", "AFRICA": "AF"}
CONTEXTS = [("red", ["red", "crimson"]), ("blue", ["blue", "azure", "navy"]), ("ring", ["ring"])]
PAGE_KINDS = [("example.org/de", "german"), ("example.org", "org"), ("example.net", "net")]
#: Rules by kind of page: elements, how many of them, the length that a text must exceed.
PAGE_RULES = {"german": Rule(("p", "li", "div"), 200, 20), "org": Rule(("h1", "p"), 150, 40), "net": Rule(("div", "p", "h1", "td"), 5, 20)}
#: Keywords and windows of the plainer extractor.
NEAR_CLASSES = [("incidence", ["thing"]), ("prevalence", ["hand"]), ("cases", ["tion"])]
NEAR = Windows(number=80, alias=None, percent_label="percent", years=(1900, 2030), versions=False)
#: Alternatives (all words of one), words ruled out, phrases; the first rule that fits counts.
PHRASES = [([["red", "ring"], ["crimson"]], ["bolt"], ["Red ring", "Ring, red", "Crimson"]), ([["blue"]], ["gear"], ["Blue part", "Azure part"]), ([["gear"], ["bolt"]], [], ["Gear", "Bolt", "Fastener", "Drive"])]
CELL_LABELS = {"m3": "MEDIUM", "m4": "SMALL"}

FLAGS, CONNECTORS = {"use_counts": False, "use_links": True}, ["counts"]

OPTION_DEFAULTS = [("growth", "g_default", "Default growth", 0.02)]
OPTIONS, CORE = {"m_small": "SMALL", "m_promo": "PROMO", "m_none": "NONE"}, {"m_large": 7, "m_medium": "MEDIUM", "m_absent": 8}
LINK_METRICS = ["incidence", "demand_standard"]
