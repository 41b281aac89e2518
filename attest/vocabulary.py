"""Fixed values that results depend on: terms, predicates, expansions. Kept as plain lists."""

# --- fixed values: claim wording ---

WEASEL_TERMS = [
    "reportedly", "allegedly", "purportedly", "supposedly", "approximately", "roughly", "about", "around",
    "nearly", "almost", "somewhat", "fairly", "rather", "quite", "may", "might", "could", "perhaps", "possibly",
    "probably", "apparently", "seemingly", "arguably", "ostensibly", "instructed", "believed", "suspected",
    "estimated", "projected", "expected", "indicated", "suggested", "assumed", "reported", "alleged",
    "purported", "understood", "said", "claimed", "asserted", "sometimes", "occasionally", "frequently",
    "generally", "usually", "typically", "often", "rarely", "seldom", "largely", "mostly", "relatively", "some",
]

ABSOLUTE_TERMS = [
    "always", "never", "everyone", "nobody", "no-one", "all", "none", "impossible", "certainly", "definitely",
    "guaranteed", "guarantee", "guarantees", "undeniably", "unquestionably", "indisputably", "absolutely",
    "completely", "totally", "utterly", "entirely", "invariably", "unfailingly", "permanently", "forever",
    "exclusively", "only", "solely", "must", "shall", "proved", "proven", "confirmed", "verified", "every",
    "everybody", "anybody", "any", "whatever", "whoever", "whenever", "wherever", "unanimously", "universally",
    "categorically", "emphatically",
]

ABSOLUTE_PHRASES = [
    "no one", "in all (?:cases|respects)", "without exception", "in every case", "to be certain", "beyond doubt", "has been proven", "shall not fail", "at all times", "in no circumstances",
]

NEGATORS = ["not", "no", "never", "cannot", "without"]

# --- fixed values: retrieval ---

STOP_TERMS = [
    "the", "a", "an", "and", "or", "but", "of", "to", "in", "on", "at", "for", "with", "is", "are", "was",
    "were", "be", "been", "by", "from", "as", "that", "this", "these", "those", "it", "its", "he", "she",
    "they", "them", "his", "her", "their", "what", "which", "who", "whom", "how", "when", "where", "why",
    "does", "did", "do", "not", "no", "yes", "if", "then", "than", "so", "such", "have", "has", "had", "will",
    "would", "can", "could", "should", "may", "might", "must", "there", "here",
]


EXPANSIONS = {
    "collaborates_with": "collaborate collaborates collaborated collaborating collaboration collaborative collaborations partners partnerships",
    "reports_to": "report reports reported reporting accountable accountability answerable",
    "headquartered_in": "headquartered headquarters headquarter head-office hq",
    "parent_organization": "parent parents parent-company parent-organisation parent-organization ultimate-parent",
    "subsidiary_of": "subsidiary subsidiaries subsidiary-of",
    "owns": "owns own owned ownership owning owner",
    "located_in": "located location site sites situated premises geographical",
    "chief_executive": "ceo chief chief-executive chief-executives managing-director",
    "funds": "fund funds funded funding finances financed financing",
    "controls": "control controls controlled controlling",
    "invests_in": "invest invests invested investment investments",
    "supplies": "supply supplies supplied supplier suppliers vendor vendors",
    "member_of": "member members membership belongs belonging",
    "part_of": "part part-of division divisions",
    "works_for": "work works worked employs employed employee employees staff",
    "advises": "advise advises advisor adviser advisors advisers",
    "allied_with": "ally allies allied ally-of",
    "competes_with": "compete competes competing competitor competitors rival rivals",
    "acquires": "acquire acquires acquired acquisition",
    "sources_from": "source sources sourced sourcing",
    "operated_by": "operate operates operated operator operators",
    "licenses_to": "license licenses licensed licence licences licensing",
    "exports_to": "export exports exported exporter",
    "founded_by": "founded founder founders founding",
    "succeeded_by": "succeed succeeds succeeded successor successors",
    "preceded_by": "precede precedes preceded predecessor predecessors",
    "regulated_by": "regulate regulates regulated regulator regulators",
    "operates_in": "trading presence",
}

# --- fixed values: predicates (name, cardinality, most values, symmetric, transitive, mutually exclusive, temporal) ---

PREDICATES = [
    ("reports_to", "SINGLE", 0, False, True, True, False),
    ("headquartered_in", "SINGLE", 0, False, False, True, True),
    ("parent_organization", "SINGLE", 0, False, True, True, False),
    ("subsidiary_of", "SINGLE", 0, False, True, True, False),
    ("founded_by", "SINGLE", 0, False, False, True, False),
    ("chief_executive", "SINGLE", 0, False, False, True, True),
    ("located_in", "SINGLE", 0, False, True, True, True),
    ("part_of", "SINGLE", 0, False, True, True, True),
    ("controls", "MULTI", 0, False, False, False, True),
    ("funds", "MULTI", 0, False, False, False, True),
    ("owns", "MULTI", 0, False, False, False, True),
    ("allied_with", "MULTI", 0, True, False, False, True),
    ("supplies", "MULTI", 0, False, False, False, True),
    ("works_for", "MULTI", 0, False, False, False, True),
    ("operates_in", "MULTI", 0, False, False, False, False),
    ("collaborates_with", "MULTI", 0, True, False, False, True),
    ("acquires", "MULTI", 0, False, False, False, True),
    ("competes_with", "MULTI", 0, True, False, False, True),
    ("member_of", "MULTI", 0, False, False, False, True),
    ("exports_to", "MULTI", 0, False, False, False, False),
    ("licenses_to", "MULTI", 0, False, False, False, True),
    ("invests_in", "MULTI", 0, False, False, False, True),
    ("advises", "MULTI", 0, False, False, False, True),
    ("succeeded_by", "SINGLE", 0, False, True, True, True),
    ("preceded_by", "SINGLE", 0, False, True, True, True),
    ("sources_from", "BOUNDED", 3, False, False, False, True),
    ("operated_by", "BOUNDED", 2, False, False, False, True),
    ("regulated_by", "BOUNDED", 4, False, False, False, True),
]

# --- fixed values: names and sentences ---

DESIGNATORS = [
    "inc", "inc.", "llc", "ltd", "ltd.", "limited", "corp", "corp.", "corporation", "co", "co.", "company",
    "gmbh", "sarl", "plc", "ag", "sa", "nv", "bv", "pty", "holdings", "holding", "group", "the",
]
EDGE_PUNCTUATION = ",;:\"'()[]—–"
ABBREVIATIONS = [
    "mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "mt", "gen", "col", "lt", "sgt", "capt", "rev", "hon",
    "pres", "gov", "sen", "rep", "inc", "ltd", "co", "corp", "dept", "univ", "approx", "est", "fig", "no", "vs",
    "etc", "al", "cf", "ca", "circa",
]
