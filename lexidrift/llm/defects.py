"""What a single answer tells about itself: empty, refusing, copied, in another language, cut off."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import ahocorasick

from lexidrift.llm.language import LetterModel, asked_language, language

_INVISIBLE = re.compile("[​-‏⁠﻿­‪-‮]")

# Texts that only hold the place of an answer, without brackets and in lower case.
PLACEHOLDERS = frozenset("null|none|nan|nil|n/a|na|n.a|no answer|empty|removed|deleted|missing|blank|no response|no text|no content|not available|unavailable|undefined|todo|tbd|redacted|content removed|answer removed|no answer given|not answered|unknown".split("|"))

# Phrases with which an answer declines, in lower case with straight apostrophes.
REFUSALS = """
i can't|i cannot|i can not|i won't|i will not|i am unable|i'm unable|i am not able|i'm not able|i must decline|i have to decline|i must refuse|i have to pass on|i'd rather not|i would rather not|i am not allowed|i'm not allowed|i am not permitted|i'm not permitted|i do not feel able|i don't feel comfortable|isn't possible for me|is not possible for me|isn't something i can|is not something i can|isn't something i could|against the guidelines|against my guidelines|i refuse to|i decline to|we can't|we cannot|we are unable|unable to help with|unable to assist|do not allow me|don't allow me|does not allow me|not be appropriate for me|isn't appropriate for me|is not appropriate for me|i'm not comfortable|i am not comfortable|i'm not willing|i am not willing|beyond what i can|outside of what i may|outside what i may
no puedo|no me es posible|no estoy autorizad|prefiero no|debo rechazar|no podré
je ne peux pas|je ne suis pas en mesure|je ne puis|je préfère ne pas|je dois refuser|je regrette, mais|il ne m'est pas possible
kann ich leider nicht|kann ich nicht|ich kann leider nicht|ich kann das nicht|ich kann dabei nicht|ist mir nicht möglich|darf ich nicht|ich muss ablehnen|möchte ich lieber nicht
nemohu|nemůžu|není mi možné|musím odmítnout|nejsem schopen
できません|お答えできかね|お手伝いでき|いたしかねます
无法|不能提供|不能回答|我不能|无法满足
не могу|не смогу|не имею возможности|вынужден отказать|вынуждена отказать
δεν μπορώ|δεν είμαι σε θέση|αδυνατώ
لا أستطيع|لا يمكنني|لن أتمكن|لا أقدر
नहीं कर सकता|नहीं कर सकती|असमर्थ|मदद नहीं
ไม่สามารถ|ไม่อาจ
non posso|não posso|niet mogelijk|ik kan niet|nie mogę
"""


# Phrases that look like declining and are not.
NOT_REFUSALS = re.compile(r"i (?:can't|cannot|can not) (?:say enough|wait|complain|stress|recommend|thank|praise|help but|imagine|believe|overstate)")


@lru_cache(1)
def _refusals() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in REFUSALS.replace("\n", "|").split("|"):
        if phrase.strip():
            found.add_word(phrase.strip(), len(phrase.strip()))
    found.make_automaton()
    return found


def visible(text: str | None) -> str:
    """`text` without invisible characters and outer white space; empty for null."""
    if not text:
        return ""
    return text.strip() if text.isascii() else _INVISIBLE.sub("", text).strip()


def is_empty(text: str) -> bool:
    """No letter or digit at all, or a placeholder, in whatever brackets."""
    if not any(map(str.isalnum, text)):
        return True
    if len(text) > 40:
        return False
    bare = re.sub(r"^[\W_]+|[\W_]+$", "", text.lower())
    return bare in PLACEHOLDERS


_SENTENCE = re.compile(r"(?<=[.!?。！？।؟…])[\"”’»)]*\s+|(?<=[。！？])")
#: To each sentence that declines a refusal may add so many short ones (a wish, an offer, a reason); words of either.
EXTRA, EXTRA_WORDS, DECLINING_WORDS = 2, 16, 24


def _declines(sentence: str) -> bool:
    return any(True for _ in _refusals().iter(sentence)) and not NOT_REFUSALS.search(sentence)


def is_refusal(text: str) -> bool:
    """One of the first two sentences declines in the first person, and nothing but more of it and short courtesy follows, however long."""
    lowered = text.lower().replace("’", "'")
    opening = [p for p in _SENTENCE.split(lowered, maxsplit=3)[:3] if any(map(str.isalnum, p))][:2]
    if not any(map(_declines, opening)):
        return False
    parts = [p for p in _SENTENCE.split(lowered) if any(map(str.isalnum, p))]
    hits = [_declines(p) for p in parts]
    if hits.count(False) > EXTRA * hits.count(True):
        return False
    return all(len(p.split()) <= (DECLINING_WORDS if hit else EXTRA_WORDS) for p, hit in zip(parts, hits, strict=True))


# Words that label a copied prompt.
LABELS = frozenset("question answer prompt instruction task request you asked your q a reply response input output user assistant title frage antwort réponse pregunta respuesta otázka odpověď вопрос ответ 问题 回答 質問".split())
_ASCII_TOKEN = re.compile("[a-z0-9]+")
_TOKEN = re.compile(r"[぀-ヿ㐀-鿿฀-๿]|[^\W_぀-ヿ㐀-鿿฀-๿]+")


def tokens(text: str) -> list[str]:
    """Words in lower case; single characters where a script sets no blanks."""
    if text.isascii():
        return _ASCII_TOKEN.findall(text.lower())
    return _TOKEN.findall(unicodedata.normalize("NFKC", text).lower())


class SuffixAutomaton:
    """All runs of words of one prompt; `runs` gives, at each word of another text, the longest run that ends there."""

    def __init__(self, words: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size = [-1], [0]
        last = 0
        for w in words:
            cur = len(self.next)
            self.next.append({})
            self.size.append(self.size[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                if self.size[q] == self.size[p] + 1:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.size.append(self.size[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def runs(self, words: list[str]) -> list[int]:
        state = size = 0
        out = []
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                size = self.size[state]
            if w in self.next[state]:
                state, size = self.next[state][w], size + 1
            else:
                state = size = 0
            out.append(size)
        return out


@lru_cache(4096)
def _automaton(prompt: str) -> tuple[SuffixAutomaton, frozenset[str], list[str]]:
    words = tokens(prompt)
    return SuffixAutomaton(words), frozenset(words), words


#: A copy may differ from the prompt in this many words, or in this share of a long one, and in no longer run.
SPARE_WORDS, SPARE_SHARE, SPARE_RUN = 2, 0.25, 3
#: Or, where it has as many words, this share of them stand in their places.
IN_PLACE = 0.65


def uncopied(prompt: str, words: list[str]) -> tuple[int, int]:
    """How many of `words` lie outside runs of two or more words of the prompt, and their longest run."""
    runs = _automaton(prompt)[0].runs(words)
    outside = longest = stretch = 0
    until = len(words)
    for i in range(len(words) - 1, -1, -1):
        if runs[i] >= 2:
            until = min(until, i - runs[i] + 1)
        if i < until:
            outside, stretch = outside + 1, stretch + 1
            longest = max(longest, stretch)
        else:
            stretch = 0
        if i <= until:
            until = len(words)
    return outside, longest


_LEAD = re.compile(r"^[^:：\n]{1,40}[:：]\s*(?=\S)")


def is_copy(prompt: str, text: str) -> bool:
    """Nothing but the prompt: restyled, quoted, labelled, repeated, or with a word or two exchanged."""
    _, known, own = _automaton(prompt)
    size = len(own)
    if not size:
        return False
    for body in dict.fromkeys((text, _LEAD.sub("", text))):
        words = tokens(body)
        if len(words) == size >= 4 and sum(a == b for a, b in zip(own, words, strict=True)) >= IN_PLACE * size:
            return True
        # a word that the prompt doesn't hold lies outside, so most answers end here
        if len(set(words).difference(known, LABELS)) > max(SPARE_WORDS, SPARE_SHARE * len(words)):
            continue
        while words and words[0] in LABELS and len(words) > 1:
            words = words[1:]
        while words and words[-1] in LABELS and len(words) > 1:
            words = words[:-1]
        if len(words) < max(2, min(4, size), 0.5 * size):
            continue
        outside, longest = uncopied(prompt, words)
        if outside <= max(SPARE_WORDS, SPARE_SHARE * len(words)) and longest <= SPARE_RUN and outside < 0.5 * len(words):
            return True
    return False


#: An answer with fewer letters than this carries no vote on its language.
LANGUAGE_LETTERS = 20


def in_other_language(prompt: str, text: str, model: LetterModel | None = None) -> bool:
    """Both languages can be told and they differ."""
    if len(text) < 10 * LANGUAGE_LETTERS and sum(map(str.isalpha, text)) < LANGUAGE_LETTERS:
        return False
    told = language(text, 3) or (model.language(text) if model else None)
    if told is None:
        return False
    asked = asked_language(prompt, model)
    return asked is not None and asked != told


_CLOSED = re.compile(r"(?:[.!?。！？।॥؟‼⁇⁈⁉｡]|[\U0001F000-\U0001FAFF☀-➿️])[\s\"'”’»“)\]}」』】》]*$")
_MARKS = re.compile(r"\s*(?:[\[(<{]\s*(?:truncated|cut|cut off|more|read more|continued|cont|cont\.|snip|trimmed|clipped|text truncated|message truncated|output truncated|\.\.\.|…)\s*[\])>}]|(?:\.\.\.|…)\s*(?:more|read more|\[\+?\d+ chars\]))$", re.I)
_DOTS = re.compile(r"(?:\.{3,}|…)[\"'”’»)\]]*$")
_URL = re.compile(r"(?:https?://|www\.)[^\s/]+\.[a-z]{2,}(?:/\S*)?$|\S+@\S+\.[a-z]{2,}$", re.I)
_THAI = re.compile("[฀-๿]")
_BULLET = re.compile(r"^\s*(?:[-*•‣–]|\d{1,3}[.)])\s+\S")
_SIGNED = re.compile(r"^\s*[–—-]\s?[^\W\d_]\S*(?:\s\S+){0,2}\s*$")
_CLOSING_LINE = re.compile(r"^\s*[^\W\d_][^.!?]{0,40},\s*$")
_LAST_WORD = re.compile(r"([^\s\d.,;:!?…\"“”„«»()\[\]<>{}—–/\\।。！？，、「」《》]+)[^\w]*$")
#: Characters in which a truncation mark or closing marks are looked for.
MARK_SPAN = 64
#: Words of a text that ends openly and yet may be a short answer.
SHORT_WORDS = 4


# Delimiters that come in pairs; straight quotation marks and apostrophes don't tell which one they are.
_PAIRS = {")": "(", "]": "[", "}": "{", "）": "（", "】": "【", "」": "「", "』": "『", "》": "《"}
_DELIMITER = re.compile("[" + re.escape("".join([*_PAIRS, *_PAIRS.values()])) + "]")


def unclosed(sentence: str) -> bool:
    """Whether a stack of delimiters still holds one at the end; a closing one without its partner is left alone."""
    stack: list[str] = []
    for mark in _DELIMITER.findall(sentence):
        if mark in _PAIRS:
            if stack and stack[-1] == _PAIRS[mark]:
                stack.pop()
        else:
            stack.append(mark)
    return bool(stack)


_BREAK = re.compile(r"[.!?。！？।؟]\s|\n")


def cut_state(text: str) -> tuple[str, str]:
    """How `text` ends, as `_end` tells; an open end inside an open delimiter of the last sentence is a cut."""
    state, word = _end(text)
    if state in ("open", "dots", "list", "short"):
        body = visible(text)
        last = 0
        for m in _BREAK.finditer(body.rstrip(".…")):
            last = m.end()
        if unclosed(body[last:]):
            return "cut", "delimiter"
    return state, word


def _end(text: str) -> tuple[str, str]:
    """How `text` ends: `closed`, `cut` with its evidence, or a question for the vocabulary.

    `("closed", "")`: it ends with a closing mark, an emoji, an address, a signature, or
    is Thai. `("cut", evidence)`: a truncation mark, half a character, or a comma, dash or
    colon at the end. `("open", word)`: it stops without a mark after `word`. `("dots",
    word)` and `("list", word)`: suspension points or a list item, complete if `word` is;
    `("short", word)`: a few words, which may be a whole answer.
    """
    body = visible(text)
    if not body:
        return "closed", ""
    if body[-1] == "�":
        return "cut", "inside_character"
    end = body[-MARK_SPAN:]  # longer than any mark; the text itself is judged whole below
    if _MARKS.search(end):
        return "cut", "mark"
    dots = _DOTS.search(end)
    if not dots and _CLOSED.search(end):
        return "closed", ""
    last = body[-1]
    thai = 0x0E00 <= ord(last) <= 0x0E7F
    if thai or not body.isascii() and len(_THAI.findall(body)) > 0.3 * len(body):
        return "closed", ""
    if last == ";" and 0x0370 <= ord(re.sub(r"[^Ͱ-Ͽ]", "", body)[:1] or "a") <= 0x03FF:
        return "closed", ""
    core = body[: len(body) - len(end) + dots.start()] if dots else body
    found = _LAST_WORD.search(core.split()[-1].lower()) if core.strip() else None
    word = found[1] if found else ""
    if dots:
        if not core or core[-1] in ".!?。！？":
            return "closed", ""
        if core[-1] in ",;:，、-–—":
            return "cut", "inside_sentence"
        return "dots", word
    if last in "\"'”’»“)]}」』】》":
        return ("closed", "") if re.search(r"[.!?。！？।؟…][\"'”’»“)\]}」』】》]+$", body) else ("open", word)
    if _URL.search(body):
        return "closed", ""
    if re.search(r"(?:https?://|www\.)\S*$", body):
        return "cut", "inside_word"
    lines = body.split("\n")
    before = [x for x in lines[:-1] if x.strip()]
    if len(before) and (_SIGNED.match(lines[-1]) or _CLOSING_LINE.match(before[-1]) and len(lines[-1].split()) <= 4):
        if not (_BULLET.match(lines[-1]) and _BULLET.match(before[-1])):
            return "closed", ""
    if _BULLET.match(lines[-1]):
        items = [len(x.split()) for x in before if _BULLET.match(x)]
        if items and len(lines[-1].split()) < min(items) or not word:
            return "cut", "inside_sentence"
        return "list", word
    if last in ",;:，、：；-–—~&/+=\\*#_|<([{“„«「《":
        return "cut", "inside_sentence"
    if len(body.split()) <= SHORT_WORDS and not re.search(r"[.!?。！？]", body) and language(body, 1) not in ("zh", "ja"):
        return "short", word
    return "open", word
