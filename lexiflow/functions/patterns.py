"""Patterns, masks and word lists.

Fixed values: they decide which characters are rewritten or counted, so they are
given literally and shared by all operators.
"""

from __future__ import annotations

# --- identifiers and headings -------------------------------------------------
FILE_ID = r"^S.+\.xml$"
FILE_SUFFIX = r"\.xml$"
GLUED_HEADING = "^[A-Z][a-z]+([A-Zα-ωΑ-Ω])"
GLUED_HEADING_ASCII = "^[A-Z][a-z]+([A-Z])"
GLUED_ABSTRACT = "^Abstract(.)"

# --- masks (letters only, so that a letters-only term pattern keeps them) ------
ENTITY_MASK = "maskentity"
PERCENT_MASK = "maskpct"
COMPARISON_MASK = "masknumexpr"
NUMBER_MASK = "masknum"
PAREN_MASK = "maskparen"

# --- numbers -------------------------------------------------------------------
NUMBER = r"(?:\+/-|\+-|\+|-)?\s*\d+(?:\.\d+)*"

MASK_RULES: tuple[tuple[str, str], ...] = (
    (NUMBER + r"\s*%", f" {PERCENT_MASK} "),
    (r"[<>=]+\s*" + NUMBER, f" {COMPARISON_MASK} "),
    (NUMBER + r"\s*[<>=]+", f" {COMPARISON_MASK} "),
    (NUMBER, f" {NUMBER_MASK} "),
    (r"\(.*?\)", " "),
    (r"\s+", " "),
)

# The older rules: comparator before number twice, number before comparator never.
LEXICON_MASK_RULES: tuple[tuple[str, str], ...] = (
    (r"[^\s]+" + ENTITY_MASK, ENTITY_MASK),
    (NUMBER + r"\s*%", f" {PERCENT_MASK} "),
    (r"[<>=]+\s*" + NUMBER, f" {COMPARISON_MASK} "),
    (r"[<>=]+\s*" + NUMBER, f" {COMPARISON_MASK} "),
    (NUMBER, f" {NUMBER_MASK} "),
)
PAREN = r"\(.*?\)"

QUANTITY = (
    r"((?:\+\s*/?)?(?:\s*-)?)(?:\s|\x{00A0})*((?:\d+\.)*\d+)(?:\s|\x{00A0})*"
    r"([a-zA-Z]+(?:/[a-zA-Z]+)?)"
)

# --- chemical-name seeds ---------------------------------------------------------
SEED_SHAPE = r"\S*\d+,\d+-[^\s.]+"
SEED_FRAGMENT = "[^-+0-9()\\[\\]{},–<>\\s/'=`\"]+"
NOT_LATIN_GREEK = "[^a-zA-Zα-ωΑ-Ω]"
GREEK = "α-ωΑ-Ω"
LOCANT_HEADER = rf"[\d(\[][-\d()\[\]{{}},= {GREEK}]*"
LOCANT_TRAILER = rf"(?:[-/\d()\[\]{{}},={GREEK}]+[a-zA-Z]*)*"

LETTER = f"[a-zA-Z{GREEK}]"
# A locant header and the letters after it: wherever a name can begin.
NAME_SHAPE = rf"{LOCANT_HEADER}{LETTER}*"

# --- tokens ----------------------------------------------------------------------
WORD_RUN = r"[\p{L}\p{Nd}_]+"
NOT_AFTER_WORD = r"(?<![\p{L}\p{Nd}_])"
NOT_BEFORE_WORD = r"(?![\p{L}\p{Nd}_])"
TOKEN = r"[\p{L}\p{Nd}_]+|[^\s\p{L}\p{Nd}_]"
SENTENCE = r"[^.!?\n]+[.!?]*|[.!?]+"
PLAIN_WORD = "[a-zA-Z][a-z]+"

# Treebank-style spacing, in order; the line is padded with a space on both sides.
TREEBANK_RULES: tuple[tuple[str, str], ...] = (
    (r"\s+", " "),
    (r"\.\.\.", "\n...\n"),
    (r'[/.,;:@#$%&!?"]', "\n$0\n"),
    (r"""([^.])([.])([\])}>"']*)\s*\z""", "$1\n$2$3\n"),
    (r"[\]\[(){}<>]", "\n$0\n"),
    (r"--", "\n--\n"),
    (r"([^'])'\s+", "$1\n'\n"),
    (r"'([sSmMdD])\s+", "\n'$1\n"),
    (r"(?i)'(ll|re|ve)\s+", "\n'$1\n"),
    (r"(?i)(n't)\s+", "\n$1\n"),
    (r"(?i)\s+(can)(not)\s+", "\n$1\n$2\n"),
)

# --- part-of-speech classes ---------------------------------------------------------
TAG_CLASSES: dict[str, tuple[str, ...]] = {
    "verb": (
        "VB", "VBD", "VBG", "VBN", "VBZ", "VBP",
        "VD", "VDD", "VDG", "VDN", "VDZ", "VDP",
        "VH", "VHD", "VHG", "VHN", "VHZ", "VHP",
        "VV", "VVD", "VVG", "VVN", "VVP", "VVZ",
    ),
    "noun": ("NN", "NNS", "NP", "NPS"),
    "adj": ("JJ", "JJR", "JJS"),
    "adv": ("RB", "RBR", "RBS"),
}
OTHER_CLASS = "other"
ANNOTATION_SPECIALS = r"^([<>|])$"

# --- full-text search ---------------------------------------------------------------
# The default English stop set of the standard analyser, and the default BM25 constants.
SEARCH_STOP_WORDS: tuple[str, ...] = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into",
    "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then",
    "there", "these", "they", "this", "to", "was", "will", "with",
)
BM25_K1 = 1.2
BM25_B = 0.75

# --- article XML: field -> (namespace, local name) ------------------------------------
XML_NAMESPACES: dict[str, str] = {
    "dc": "http://purl.org/dc/elements/1.1/",
    "prism": "http://prismstandard.org/namespaces/basic/2.0/",
    "xocs": "http://www.elsevier.com/xml/xocs/dtd",
    "base": "http://www.elsevier.com/xml/svapi/article/dtd",
}
XML_FIELDS: dict[str, str] = {
    "DOI": "prism:doi",
    "PMID": "base:pubmed-id",
    "EID": "base:scopus-eid",
    "Title": "dc:title",
    "ISSN": "prism:issn",
    "Authors": "dc:creator",
    "Volume": "xocs:vol-iss-suppl-text",
    "PubTime": "prism:coverDate",
    "FirstPage": "xocs:first-page",
    "LastPage": "xocs:last-page",
    "Abstract": "dc:description",
}
XML_DEFAULT_FIELDS = ("PII", "Title", "ISSN", "Authors", "Volume", "PubTime", "Pages", "Abstract")
XML_ID_FIELDS = ("PII", "DOI", "PMID", "EID")
