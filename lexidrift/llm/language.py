"""Votes for the language of a text: the script first, then function words for Latin script.

A prompt may hold too few function words; there a model of letter triples decides, trained on the texts that
votes tell with certainty.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache

import numpy as np

# Frequent function words of languages in Latin script.
STOPWORDS = {
    "en": "the of and to in is was it that for on with as his her its by at from this are were be has have had not but which they an or there what who when than so a i my after while does about can't didn't isn't every near how why where your you we he she",
    "de": "der die das und den dem des ein eine einen einer nicht ist war mit für von auf nach vor bei aus sich auch während trotz wegen ohne hinter gegen unser mein zum zur am im es ich wir sie er warum wie wer was wo",
    "fr": "le la les un une des du et est dans pour par sur avec sans qui que ne pas plus au aux ce cette son sa ses notre après derrière pendant malgré vers dès je vous il elle à pourquoi comment où quel quelle",
    "es": "el la los las un una unos de del y en es por para con sin que no se su sus más al lo este esta nuestro tras hacia pese durante detrás como yo usted qué cómo quién dónde cuál",
    "cs": "a je na se v ve z že do pro po od za bez při během kvůli navzdory náš ten ta to byl byla k ke ale jako jsem s proč jak kdo kde",
    "it": "il lo gli di che e è per con non del della dei nel alla sono una uno anche dopo prima senza",
    "pt": "o os as um uma de do da dos das e é em no na para por com não que se seu sua após durante sem",
    "nl": "de het een van en in is dat op te voor met niet zijn aan er om ook na tijdens zonder",
    "pl": "i w na z się nie do to jest że po od za bez przez dla przy jak ale jego",
}
_VOTES: dict[str, list[str]] = {}
for _lang, _words in STOPWORDS.items():
    for _w in _words.split():
        _VOTES.setdefault(_w, []).append(_lang)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_ASCII_WORD = re.compile("[a-z]+(?:'[a-z]+)?")
_ASCII = re.compile("[\x00-\x7f]+")

# First and last code point of the scripts told apart.
SCRIPTS = ((0x0370, 0x03FF, "el"), (0x1F00, 0x1FFF, "el"), (0x0400, 0x052F, "ru"), (0x0590, 0x05FF, "he"), (0x0600, 0x06FF, "ar"), (0x0750, 0x077F, "ar"), (0x0900, 0x097F, "hi"), (0x0E00, 0x0E7F, "th"), (0x3040, 0x30FF, "ja"), (0x3400, 0x9FFF, "zh"), (0xAC00, 0xD7AF, "ko"))


def scripts(text: str) -> Counter:
    """Characters of each non-Latin script."""
    out: Counter = Counter()
    if not text.isascii():
        for c, n in Counter(_ASCII.sub("", text)).items():
            o = ord(c)
            for lo, hi, name in SCRIPTS:
                if lo <= o <= hi:
                    out[name] += n
                    break
    return out


def language(text: str, least: int = 2) -> str | None:
    """The language voted for, or None where too little speaks for any."""
    found = scripts(text)
    if found:
        letters = sum(map(str.isalpha, text)) or 1
        if found["ja"] and found["ja"] + found["zh"] > 0.25 * letters:
            return "ja"
        name, n = found.most_common(1)[0]
        if n > (0.25 if name in ("zh", "th", "hi") else 0.5) * letters:
            return name
    votes = dict.fromkeys(STOPWORDS, 0)
    for word in filter(_VOTES.__contains__, (_ASCII_WORD if text.isascii() else _WORD).findall(text.lower())):
        for lang in _VOTES[word]:
            votes[lang] += 1
    (lang, top), (_, second) = sorted(votes.items(), key=lambda v: -v[1])[:2]
    return lang if top >= least and top > second else None


# How a prompt names a language.
NAMED = {
    "en": "english englisch anglais inglés angličtině anglicky английски 英语 英文 英語",
    "de": "german deutsch allemand alemán němčině německy немецки 德语 ドイツ語",
    "fr": "french französisch français francés francouzštině francouzsky французски 法语 フランス語",
    "es": "spanish spanisch espagnol español španělštině španělsky испански 西班牙语 スペイン語",
    "cs": "czech tschechisch tchèque checo češtině česky чешски 捷克语 チェコ語",
    "ru": "russian russisch russe ruso ruštině rusky русски 俄语 ロシア語",
    "el": "greek griechisch grec griego řečtině řecky гречески 希腊语 ギリシャ語 ελληνικά",
    "hi": "hindi hindština hindsky хинди 印地语 ヒンディー語 हिंदी हिन्दी",
    "ar": "arabic arabisch arabe árabe arabštině arabsky арабски 阿拉伯语 アラビア語 العربية",
    "zh": "chinese chinesisch chinois chino čínštině čínsky китайски 中文 汉语 中国語",
    "ja": "japanese japanisch japonais japonés japonštině japonsky японски 日语 日文 日本語",
    "th": "thai thailändisch thaï tailandés thajštině thajsky тайски 泰语 タイ語 ภาษาไทย",
}
_NAME_TO_LANG = {n: lang for lang, names in NAMED.items() for n in names.split()}
_SPACED = "|".join(sorted((re.escape(n) for n in _NAME_TO_LANG if n.isalpha() and ord(n[0]) < 0x3000), key=len, reverse=True))
_JOINED = "|".join(sorted((re.escape(n) for n in _NAME_TO_LANG if ord(n[0]) >= 0x3000), key=len, reverse=True))
_ASKED = re.compile(rf"\b(?:in|into|auf|en|in het|v|na|по|на|στα|باللغة|بال)[ -]({_SPACED})\b|(?:用|以)?({_JOINED})", re.I)
_QUOTED = re.compile(r"[\"“„«《「『][^\"”“»》」』]{0,400}[\"”“»》」』]")


def unquoted(text: str) -> str:
    """`text` without quoted passages, such as the title that a prompt names."""
    return _QUOTED.sub(" ", text)


#: Buckets of letter triples, votes that make a text a training text, and odds at which the model tells a language.
TRIPLES, SURE, ODDS = 1 << 13, 6, 20.0


def _triples(text: str) -> np.ndarray:
    words = _WORD.findall(text.lower())
    return np.array([zlib.crc32(w[i : i + 3].encode()) % TRIPLES for w in (f" {w} " for w in words) for i in range(len(w) - 2)], dtype=np.int64)


class LetterModel:
    """Naive Bayes over letter triples, trained on the texts in Latin script whose function words tell their language."""

    def __init__(self, texts: Iterable[str]) -> None:
        counts: dict[str, np.ndarray] = {}
        for text in texts:
            told = None if scripts(text) else language(text, SURE)
            if told:
                counts.setdefault(told, np.full(TRIPLES, 0.5))
                counts[told] += np.bincount(_triples(text), minlength=TRIPLES)
        self.languages = sorted(counts)
        self.logs = np.array([np.log(counts[x] / counts[x].sum()) for x in self.languages])

    def language(self, text: str) -> str | None:
        """The likeliest language, or None where another is nearly as likely or none was learned."""
        found = _triples(text)
        if len(self.languages) < 2 or not len(found):
            return None
        score = self.logs[:, found].sum(axis=1)
        order = np.argsort(score)
        return self.languages[order[-1]] if score[order[-1]] - score[order[-2]] >= math.log(ODDS) else None


@lru_cache(4096)
def asked_language(prompt: str, model: LetterModel | None = None) -> str | None:
    """The language a prompt asks for by name, else the language it is written in."""
    bare = unquoted(prompt)
    named = _ASKED.findall(bare)
    if named:
        return _NAME_TO_LANG[(named[-1][0] or named[-1][1]).lower()]
    return language(bare, 2) or (model.language(bare) if model else None) or language(bare, 1)
