"""Word lists, patterns and thresholds that results depend on."""

from __future__ import annotations

# Words that carry no lexical content on their own.
FUNCTION_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "but", "by", "for",
    "from", "had", "has", "have", "he", "her", "hers", "him", "his", "i",
    "if", "in", "into", "is", "it", "its", "me", "my", "not", "of", "on",
    "or", "our", "ours", "she", "so", "that", "the", "their", "theirs",
    "them", "they", "this", "to", "us", "was", "we", "were", "what",
    "when", "where", "which", "who", "why", "will", "with", "you", "your",
)

# The words that sentence skeletons keep; one per line in the canonical list.
ANCHORS = (
    "a an and are as at be been but by for from had has have he her hers him his i if in into is it its me my not of on "
    "or our ours she so that the their theirs them they this to us was we were what when where which who why will with "
    "you your do does did can could shall should would may might must isn't aren't wasn't weren't don't doesn't didn't "
    "won't can't couldn't shouldn't wouldn't it's that's there's here's about after before between during over under "
    "through without against among within across toward because although while since than though unless whether either "
    "neither nor both only also yet rather instead"
).split()

# Negative contractions with one reading each.
CONTRACTIONS = {
    "isn't": ("is", "not"),
    "aren't": ("are", "not"),
    "wasn't": ("was", "not"),
    "weren't": ("were", "not"),
    "don't": ("do", "not"),
    "doesn't": ("does", "not"),
    "didn't": ("did", "not"),
    "won't": ("will", "not"),
    "can't": ("can", "not"),
    "couldn't": ("could", "not"),
    "shouldn't": ("should", "not"),
    "wouldn't": ("would", "not"),
}

# Slots and kept punctuation of skeletons.
SLOT, NUMBER_SLOT = "<X>", "<NUM>"
PUNCTUATION = (".", "!", "?", ",", ";", ":")

# The four rhetorical frames (kind, pattern, template). `whether <X> or <Y>` is withdrawn and stays out.
FRAMES = (
    ("contrast_not_but", r"\bnot\s+(.{1,120}?)\s*,?\s+but\s+(.{1,120}?)(?:[.!?]|$)", "not <X> but <Y>"),
    ("reframe_isnt_its", r"\b(?:isn't|is not)\s+(.{1,120}?)(?:[.!?;:,]|\s+)\s+(?:it'?s|it is)\s+(.{1,120}?)(?:[.!?]|$)", "isn't <X> it's <Y>"),
    ("reframe_about", r"\b(?:isn't|is not)\s+about\s+(.{1,100}?)[.!?;:,]\s+(?:it'?s|it is)\s+about\s+(.{1,100}?)(?:[.!?]|$)", "isn't about <X> it's about <Y>"),
    ("not_only_but_also", r"\bnot\s+only\s+(.{1,120}?)\s+but\s+also\s+(.{1,120}?)(?:[.!?]|$)", "not only <X> but also <Y>"),
)
WITHDRAWN_FRAMES = ("whether_or",)

# White space, the sentence boundary, the paragraph boundary and the token patterns.
SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SENTENCE_BOUNDARY = rf"(?<=[.!?])(?:[\"'”’)]*){SPACE}+(?=[A-Z0-9\"'“‘(])"
PARAGRAPH_BOUNDARY = rf"\n{SPACE}*\n+"
TOKEN = r"[A-Za-z]+(?:['’][A-Za-z]+)?|\p{Nd}+(?:[.,]\p{Nd}+)*"
STRUCTURAL_TOKEN = r"[A-Za-z]+(?:'[A-Za-z]+)?|\p{Nd}+(?:[.,]\p{Nd}+)*|[.!?,;:]"

# Kinds of patterns.
NGRAM, WITHIN, CROSS = "ngram", "within_sentence", "cross_sentence"

# Groups of models, domains and corpus selection rules.
DISCOVERY_MODELS = ("chatgpt", "mistral-chat", "mpt-chat")
VALIDATION_MODELS = ("gpt4", "llama-chat", "cohere-chat")
PROSE_DOMAINS = ("abstracts", "books", "news", "recipes", "reddit", "wiki")
CELL_DOMAINS = ("abstracts", "books", "news", "recipes", "wiki")
MIN_CHARS = 400
DOCS_PER_STRATUM, HUMAN_PER_DOMAIN, HC3_PER_STRATUM = 20, 60, 40
SOURCES_PER_PHASE = 70

# Span limits of skeletons and n-grams.
MIN_N, MAX_N = 2, 5
MIN_SPAN, MAX_SPAN, MIN_SLOTS, MAX_SLOTS, MIN_ANCHORS = 3, 12, 1, 3, 2
SMOOTHING = 0.5
PROMPT_DERIVED_ABOVE = 0.5
