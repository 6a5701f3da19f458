"""Word lists of the evidence scorer. Another field of study passes its own Lexicon."""

from __future__ import annotations

from dataclasses import dataclass

# The lists, cue words and patterns that scores and senses follow from.
DOMAIN = (
    "tapa", "barkcloth", "bark cloth", "masi", "mahi", "siapo", "kapa",
    "ngatu", "hiapo", "paper mulberry", "broussonetia", "bast", "inner bark",
    "fibre", "fiber", "bark", "felt", "felting", "mallet", "beater",
    "beaters", "ike", "anvil", "yatua", "tutua", "pound", "pounding",
    "hammer", "tutumahi", "i-tututu", "samusamu", "samu masi", "daluang",
    "beaten bark paper",
)
TOOL = ("beater", "beaters", "mallet", "ike", "anvil", "yatua", "tutua", "stone beater", "hardwood beater", "barkcloth beater")
PRODUCTION = (
    "beat bark", "beat bark-cloth", "beat barkcloth", "beating bark",
    "beaten masi", "beaten bark", "pounding bark", "spread fibres",
    "spread fibers", "felting", "inner-bark", "inner bark", "bast",
)
PAPER = ("beaten bark paper", "daluang", "amate", "fuya")
NEGATIVE = (
    "nothing beats", "can't beat", "cannot beat", "beat these guys",
    "beat their adversaries", "beating and harassing", "beat octopus",
    "beat the lali", "drums were beaten", "lali gong", "political",
    "election", "tourist slogan",
)
RITUAL = ("beat the lali", "lali gong", "drums were beaten", "beat octopus")
LEXICAL = ("pound_action", "tool", "beater", "mallet", "pound")
BIBLIOGRAPHY = ("bibliography", "references", "works cited")
CITATION, PUBLISHER = r"\(\d{4}[a-z]?\)|\b\d{4}\.", r"\b(?:journal|press|university|proceedings|bulletin)\b"
WORDLIST_HEADERS, WORDLIST_ROWS, WORDLIST_CELL = ("language name", "concept", "form"), ("concept_group", "pound_action"), r"\bconcept\s*,"
#: Terms that stand for a verb's forms.
STEMS = {"beat": "beat|beats|beating|beaten", "beat verb": "beat|beats|beating|beaten", "beat (verb)": "beat|beats|beating|beaten"}
SENSES = {
    "lexical_wordlist": ("lexical_row_or_table", "Looks like lexical table data with concept/form fields related to the query."),
    "bibliographic_lead": ("bibliographic_reference", "Looks mainly like a reference or literature-list entry."),
    "bark_paper_or_related_technology": ("technology_context", "Mentions bark paper or related beaten-bark technology."),
    "tool_or_beater": ("tool_evidence", "Tool terms occur with barkcloth/tapa/masi or related production vocabulary."),
    "production_action": ("production_process", "Production action terms occur with bark, fibre, barkcloth, tapa, or related vocabulary."),
    "ritual_or_non_barkcloth_action": ("non_barkcloth_context", "The query appears to describe sound, ritual, food, or other non-barkcloth action."),
    "metaphor_or_general_usage": ("general_language_context", "General or metaphorical usage pattern appears rather than a barkcloth production action."),
    "needs_review": ("ambiguous_context", "Rule-based classifier found limited or ambiguous domain proximity; human review recommended."),
}


@dataclass(frozen=True)
class Lexicon:
    """Lower-case words and phrases, found as parts of a lower-cased text."""

    domain: tuple[str, ...] = DOMAIN
    tool: tuple[str, ...] = TOOL
    production: tuple[str, ...] = PRODUCTION
    paper: tuple[str, ...] = PAPER
    negative: tuple[str, ...] = NEGATIVE
    ritual: tuple[str, ...] = RITUAL
    lexical: tuple[str, ...] = LEXICAL
