"""Problem 3: sentences of texts in many languages and scripts, with positions, in SQL expressions only.

Dots that end nothing (decimals, versions, addresses, initials, abbreviations) are masked
one for one by private-use characters, so positions stay as they are. Boundary marks are
then put in by script-specific terminator patterns, the text is split at the marks, and
sentences are cut from the stored text by position, which restores what was masked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Stand-ins for a dot that never ends a sentence, and for the boundary itself.
DOT, MARK = "", ""

# Abbreviations that are followed by what they belong to and so end no sentence.
BOUND = {
    "en": "dr mr mrs ms prof st sr jr rev gen col capt lt sgt hon messrs mt vs viz cf ca eg ie approx no nos vol vols pp chap chaps ch fig figs sec secs eq eqs ed eds art dept est incl",
    "de": "nr bzw ggf evtl vgl bspw inkl zzgl str hr fr abs abb bd jh geb gest ehem sog usf zb dh",
    "fr": "mme mlle mm me env av boul chap éd ex",
    "es": "sra srta srs dra ud uds núm pág págs avda aprox ej",
    "cs": "např tzv tj resp popř mgr ing čl č str odst mj",
    "ru": "им ул г-н г-жа стр гл рис см напр проф акад тыс руб коп",
    "el": "π χ κ κα δρ βλ αρ σελ",
    "hi": "डॉ श्री पं प्रो कु",
    "ar": "د أ م",
}
# Abbreviations that may well end a sentence; they do so before a capital, quote or bracket.
LOOSE = "a.m p.m etc al lb lbs oz ft in kg km cm mm min hr hrs sec inc ltd co corp jan feb mar apr jun jul aug sep sept oct nov dec bros u.a usw etc atd apod aj т.д т.п т.е κ.λπ κ.ά р"
# Abbreviations with dots inside that end no sentence.
DOTTED = "i.e e.g z.b d.h u.a v.a o.ä p.ex q.v т.е т.н н.э π.χ δ.δ μ.μ"
# German words before an ordinal that goes on, as in "Im 3. Stock".
BEFORE_ORDINAL = "im am vom zum beim der die das dem den des ab seit bis jeden jeder"
# German months; after an ordinal they start no sentence.
MONTHS = "januar februar märz april mai juni juli august september oktober november dezember"

_INVISIBLE = "​‌‍⁠﻿­"
_SPACE = rf"[\s  {_INVISIBLE}]"
_LOW = r"[\p{Ll}]"
_OPEN = "[\"'“‘«„‚(\\[¿¡—–-]"
_QUOTES = "[\"'”’»›“]"


def _alternation(words: str) -> str:
    return "|".join(sorted({w.replace(".", r"\.") for w in words.split()}, key=lambda w: (-len(w), w)))


def _sub(text: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(to))


def _dot(before: str, after: str, flags: str = "U") -> tuple[str, str]:
    """A pattern for a dot by what stands before it (of bounded length) and after it; words are looked at only where a dot is."""
    return rf"(?{flags})\.(?<={before}\.)(?!\.){after}", DOT


def mask(text: Column) -> Column:
    """`text` with every dot that ends no sentence replaced by one private-use character."""
    bound = _alternation(" ".join(BOUND.values()))
    spread = _alternation(LOOSE).replace(r"\.", DOT)
    dotted = _alternation(DOTTED).replace(r"\.", DOT)
    alone = rf"(?<![\p{{L}}\p{{N}}{DOT}])"
    number = rf"(?<![\p{{N}}{DOT}.,])\d{{1,2}}"
    goes_on = rf"(?=[,;:]|{_SPACE}+(?:{_LOW}|\d))"
    patterns = [
        # inside numbers, versions, file names, addresses and initialisms: a dot between two letters or digits
        _dot(r"[\p{L}\p{N}]", r"(?=[\p{L}\p{N}])"),
        # dots inside an abbreviation of single letters, as in "p.m." or "U.K.", are gone by now; the last one is left
        _dot(rf"{alone}(?:{bound})", rf"(?={_SPACE}*[^\s])", "iU"),
        # loose ones go on before a small letter, a digit or a comma
        _dot(rf"{alone}(?:{spread})", goes_on),
        _dot(rf"{alone}(?:{dotted})", rf"(?={_SPACE}*[^\s])", "iU"),
        # initialisms ("U.K.") go on before a small letter or digit
        _dot(rf"\p{{Lu}}{DOT}\p{{Lu}}", goes_on),
        # initials and one-letter abbreviations ("J. K.", "d. h.", "т. е."), not the last letter of "p.m."
        _dot(rf"(?<![\p{{L}}\p{{N}}{DOT}'’])\p{{L}}", rf"(?={_SPACE}*[\p{{L}}\p{{N}}])(?!\n\s*\n)"),
        # ordinals before a small letter or a German month, as in "16. května" and "3. Mai"
        _dot(number, rf"(?={_SPACE}+(?:{_alternation(MONTHS)})\b)", "iU"),
        _dot(rf"\b(?:{_alternation(BEFORE_ORDINAL)}){_SPACE}{{1,4}}\d{{1,2}}", rf"(?={_SPACE}+\p{{L}})", "iU"),
        _dot(number, rf"(?={_SPACE}+{_LOW})"),
    ]
    out = text
    for pattern, to in patterns:
        out = _sub(out, pattern, to)
    return out


def _mostly(text: Column, letters: str) -> Column:
    """Whether more than three in ten letters of `text` belong to the class `letters`; they are counted only where there is one."""
    own = F.length(_sub(text, f"[^{letters}]+", ""))
    return F.when(text.rlike(f"[{letters}]"), own > 0.3 * F.length(_sub(text, r"[^\p{L}]+", ""))).otherwise(False)


def mark(text: Column) -> Column:
    """The masked text with a boundary mark after every sentence."""
    end = r"[.!?؟।॥…‼⁇⁈⁉]"
    close = r"[)\]}]"
    masked = mask(text)
    greek = _sub(masked, r"(?U);(?=\s|$)", f";{MARK}")
    out = F.when(_mostly(text, r"\p{IsGreek}"), greek).otherwise(masked)
    # ideographs and kana: no blank is needed; speech with its reporting clause stays whole
    report = r"[^。！？“”「」\n]{1,24}?(?:问|说|道|喊|叫|答)|と|って|，|、|,"
    out = _sub(out, rf"([。！？｡]+[”’」』）》】]*)(?![”’」』）》】])(?!\s*$)(?!(?<=[”’」』])(?:{report}))", f"$1{MARK}")
    # a quotation that ends in a question or an exclamation goes on before a small letter, a dash or a comma
    out = _sub(out, rf"(?U)([!?؟…][!?…]*{_SPACE}?{_QUOTES}+{close}*)(?={_SPACE}+(?!{_LOW}|[—–-]{_SPACE}*{_LOW}))", f"$1{MARK}")
    # a statement closed inside the quotation
    out = _sub(out, rf"(?U)((?<!\.)[.।॥]{close}*{_QUOTES}+{close}*)(?={_SPACE}+)", f"$1{MARK}")
    # suspension points end a sentence unless a small letter follows
    out = _sub(out, rf"(?U)((?:\.{{2,}}|…)[.!?…]*{close}*{_QUOTES}*)(?={_SPACE}+(?!{_LOW}|[—–-]{_SPACE}*{_LOW}))", f"$1{MARK}")
    # the plain case
    out = _sub(out, rf"(?U)((?<![.…!?؟])(?:[.।॥]|(?=[!?؟‼⁇⁈⁉]){end}[!?؟]*){close}*)(?![.…!?؟)\]}}])(?={_SPACE}+(?!{_SPACE}*{_QUOTES}{_SPACE}*(?:[,;:]|{_SPACE}{_LOW})|[—–-]{_SPACE}*{_LOW}|»))", f"$1{MARK}")
    # Thai sets blanks between sentences only
    out = F.when(_mostly(text, r"฀-๿"), _sub(out, rf"(?U)({_SPACE}+)", f"{MARK}$1")).otherwise(out)
    # a blank line always ends a sentence
    return _sub(out, rf"(?U)(\n[^\S\n]*\n\s*)", f"{MARK}$1")


#: What the private-use characters become where they stand in a stored text, so that positions hold.
_STORED = "\ufdd0\ufdd1"


def sentence_parts(text: Column) -> Column:
    """Array of `(n, lead, body, part)`: the text in parts that end with a sentence, with the length of each, of the white
    space and invisible characters before its sentence, and of all up to its end.

    Null and empty texts have one empty part.
    """
    plain = F.translate(F.coalesce(text, F.lit("")), DOT + MARK, _STORED)
    skip = rf"(?U)^[\s {_INVISIBLE}]+"
    tail = rf"(?U)[\s {_INVISIBLE}]+$"
    return F.transform(F.split(mark(plain), F.lit(MARK), -1), lambda p: F.struct(F.length(p).alias("n"), (F.length(p) - F.length(_sub(p, skip, ""))).alias("lead"), F.length(_sub(p, tail, "")).alias("body"), p.alias("part")))


def sentences(records: DataFrame, key: str = "id", text: str = "generation") -> DataFrame:
    """`(key, sent_no, start_char, end_char, sentence)`: the sentences of every row, numbered from 1.

    Positions are 1-based and inclusive. Rows delivered again (same key) count once, with the
    first of their texts in order; other columns are ignored. A row without a sentence gives
    no row. Positions are running sums over the parts of a text, which lie where its key does,
    so nothing is shuffled a second time.
    """
    once = records.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(text).alias("_text"))
    parts = once.select(key, F.posexplode(sentence_parts(F.col("_text"))).alias("_at", "_p")).select(key, "_at", "_p.*")
    order = Window.partitionBy(key).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = F.col("body") > F.col("lead")
    placed = parts.withColumns({"_upto": F.sum("n").over(order), "sent_no": F.sum(whole.cast("int")).over(order)}).where(whole)
    before = F.col("_upto") - F.col("n")
    sentence = F.translate(F.expr("substring(part, lead + 1, body - lead)"), DOT + _STORED, "." + DOT + MARK)
    return placed.select(key, F.col("sent_no").cast("int").alias("sent_no"), (before + F.col("lead") + 1).cast("int").alias("start_char"), (before + F.col("body")).cast("int").alias("end_char"), sentence.alias("sentence"))


def probe_sentences(records: DataFrame, probe: DataFrame) -> DataFrame:
    """`(id, sent_no, end_char)` for the records that the probe names, each once."""
    asked = records.join(probe.select("id").distinct(), "id", "left_semi")
    return sentences(asked).select("id", "sent_no", "end_char")


def sentence_report(records: DataFrame) -> DataFrame:
    """Sentences and mean sentence length in characters by tidied domain, over all records."""
    domain = F.coalesce(F.lower(F.trim("domain")), F.lit("unknown"))
    labels = records.where("id is not null").groupBy("id").agg(F.min(domain).alias("domain"), F.min("generation").alias("_text"))
    parts = F.filter(sentence_parts(F.col("_text")), lambda p: p["body"] > p["lead"])
    sizes = labels.select("domain", F.transform(parts, lambda p: p["body"] - p["lead"]).alias("s"))
    chars = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x)
    return sizes.select("domain", F.size("s").cast("long").alias("n"), chars.alias("chars")).groupBy("domain").agg(F.count("*").alias("records"), F.sum("n").alias("sentences"), (F.sum("chars") / F.greatest(F.sum("n"), F.lit(1))).alias("mean_chars"))
