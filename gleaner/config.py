"""Settings, word lists and limits. Word lists and patterns in this module are fixed values of the data model."""

from __future__ import annotations

from dataclasses import dataclass

# Tokens, stop words, question words and notices.
TOKEN = r"[a-zåäö0-9][a-zåäö0-9_-]{1,}"
STOP_WORDS = tuple(
    """vilka vilken vad hur erbjuder finns har och eller för med the what which offer offers your you about
    does do is are can of to and in on a an det den är kan att om en ett
    for with our us we their it its at by from""".split()
)
STOP_WORDS_V1 = tuple("vilka vilken vad hur erbjuder finns har och eller för med the what which offer offers your you about".split())
GENERIC_FOCUS = ("rules", "rule", "posting", "regler", "regel", "describe", "explain", "beskriv")
DEFINITION_QUESTION = r"^\s*(?:what is|what are|vad är)\b"
DEFINITION_CUE = r"\b(?:is|are|helps?|provides?|enables?|är|hjälper|erbjuder)\b"
PLACEHOLDER_NOTICE = (
    r"\b(?:content coming soon|no (?:articles|posts|resources) (?:yet|available)|this (?:page|section) is under construction|"
    r"innehåll kommer snart|inga (?:artiklar|inlägg|resurser) (?:ännu|tillgängliga))\b"
)
INJECTION = (
    r"ignore (?:all |any )?(?:previous|prior|system) instructions|system prompt|developer message|act as (?:an? )?|"
    r"reveal (?:your|the) (?:prompt|instructions)|jailbreak|do not cite"
)
# Words by which a language is told.
HEURISTIC_WORDS = {
    "en": tuple("the and our with for this is are we of from your".split()),
    "sv": tuple("och för våra med som är vi att av från vår har".split()),
}
MISMATCH_WORDS = {
    "en": tuple("the and our with for this these is are we of from your which must not provides knowledge available".split()),
    "sv": tuple("och för våra med som är vi att av från vår har inte det detta dessa kan måste kunskap användningsfall tillgänglig teknisk".split()),
}
CATEGORY_WORDS = (
    ("product", ("product", "products", "produkt", "produkter")),
    ("service", ("service", "services", "tjänst", "tjänster")),
    ("company", ("company", "företag", "organisation")),
)
# Routing.
ROUTING_RULES = (
    ("appointment", "REQUEST_APPOINTMENT", 10, "all", r"\b(boka|möte|mötestid|appointment|meeting|request.*time)\b"),
    ("availability", "REQUEST_APPOINTMENT", 20, "all", r"\b(lediga tider|tillgängliga tider|tillgänglighet|availability|available (?:times?|slots?)|slots?)\b"),
    ("contact", "FIND_CONTACT", 30, "all", r"\b(contact\w*|kontakt\w*|representative\w*|säljare\w*)\b"),
    ("service", "SERVICE_INFORMATION", 40, "all", r"\b(service\w*|tjänst\w*)\b"),
    ("product", "PRODUCT_INFORMATION", 50, "all", r"\b(product\w*|produkt\w*|equipment|utrustning\w*)\b"),
    ("company", "COMPANY_INFORMATION", 60, "all", r"\b(company|företag\w*|organisation\w*|organization\w*|about us|om oss|who are you|vilka är ni)\b"),
)
PHRASE_RULES = (
    ("product", "product", 100, "all", ("product", "products", "produkt", "produkter")),
    ("service", "service", 110, "all", ("service", "services", "tjänst", "tjänster")),
    ("company", "company", 120, "all", ("company", "företag", "about us", "om oss")),
)
PROTECTED_ACTION = (
    r"\b(booking|book an?|appointment\w*|meeting\w*|schedule\w*|availability|contact\w*|email\w*|quotation\w*|quote\w*|purchase\w*|buy|"
    r"boka\w*|möte\w*|mötestid\w*|kontakt\w*|offert\w*|köpa|skicka\w*)\b"
)
# Graphs.
PREDICATES = ("HAS_SUBSIDIARY", "IS_PRODUCT_CATEGORY_OF", "BELONGS_TO", "IS_A", "RESPONSIBLE_CONTACT", "DOCUMENTED_BY", "USES_MATERIAL", "INCLUDES", "HAS_TECHNICAL_PROPERTY", "PROVIDES", "HAS_LOCATION")
HEADING_KINDS = {
    "company": "organization", "organization": "organization", "företag": "organization", "organisation": "organization",
    "product": "product", "produkt": "product", "service": "service", "tjänst": "service",
    "category": "category", "kategori": "category", "location": "location", "plats": "location",
    "contact": "business_contact", "kontakt": "business_contact",
}
CATEGORY_HEADINGS = ("products", "produkter", "services", "tjänster", "locations", "platser", "categories", "kategorier")
STATEMENTS = (
    ("PROVIDES", {"en": "provides", "sv": "erbjuder"}, ("organization",), ("product", "service")),
    ("BELONGS_TO", {"en": "belongs to", "sv": "tillhör"}, ("product", "service"), ("category",)),
    ("HAS_LOCATION", {"en": "is located in", "sv": "ligger i"}, ("organization",), ("location",)),
)
DEPTH_SCORES = {1: 0.6, 2: 0.4}
MAX_SEEDS, MAX_VISITED, MAX_PATHS, MAX_BRANCHES = 8, 60, 32, 8
# Answer checks, safety and references to earlier turns.
UNSAFE_CONTEXT = r"ignore (?:all |any )?(?:previous|prior|system) instructions|system prompt|developer message|jailbreak"
SAFETY = r"\b(dimension|install|godkänd|standard|krock|säker|engineering|design|compliance|crash|safe|100 km|hastighet)\w*"
FOLLOW_UP = r"\b(it|its|this|that|these|those|them|the product|that product|this product|den|det|dess|denna|detta|de|dem|produkten|den produkten|det området)\b"
HISTORY_REFERENCE = r"\b(previous|earlier|last|before|both|compare|comparison|föregående|tidigare|förra|båda|jämför|jämförelse)\b"
EXPLICIT_COMPANY = r"\b(company|företag\w*|organisation\w*|organization\w*|about us|om oss|who are you|vilka är ni)\b"
UNSAFE_FORMAT = r"[<>@]|(?:https?://|www\.|mailto:|tel:|javascript:)|\]\s*\("
ANSWER_ACTION = (
    r"\b(contact\w*|representative\w*|book\w*|appoint\w*|meeting\w*|schedul\w*|confirm\w*|calendar\w*|email\w*|sent|send|install\w*|must|should|recommend\w*|"
    r"kontakt\w*|representant\w*|bok\w*|möte\w*|mötes\w*|bekräft\w*|kalender\w*|skicka\w*|mejl\w*|bör|måste|rekommender\w*)\b"
)
CHECK_FAILURES = {
    "execution": "execution_error", "intent": "intent_mismatch", "generation": "generation_mismatch", "sources": "source_mismatch",
    "contact": "contact_mismatch", "required_phrase": "required_phrase_missing", "forbidden_phrase": "forbidden_phrase_present",
}
GROUNDING_FAILURES = ("semantic_check_failed", "unknown_citation", "missing_claim", "unsupported_number", "unsupported_claim", "missing_citation", "invalid_answer", "unsafe_format", "tool_or_safety_claim", "other_validation_failure")
TRACKING = ("fbclid", "gclid")
CHUNK_CHARS, CHUNK_LEAST = 1500, 300


@dataclass(frozen=True)
class Retrieval:
    """Settings of hybrid search."""

    result_limit: int = 4
    minimum_score: float = 0.2
    lexical_weight: float = 0.65
    use_semantic: bool = True
    graph_depth: int = 1

    def __post_init__(self):
        if not (1 <= self.result_limit <= 4 and 0.2 <= self.minimum_score <= 1 and 0 <= self.lexical_weight <= 1 and self.graph_depth in (1, 2)):
            raise ValueError("retrieval settings out of range")
