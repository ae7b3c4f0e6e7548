"""Text expressions: cleaning, comparison forms, predicates and pauses, all as columns of SQL functions.

White space is Unicode's throughout, as are letters. A null text gives null unless a function says otherwise.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats and word lists that results depend on.
PAGE_NUMBER = r"(?U)^\s*[-–—]?\s*\d+\s*[-–—]?\s*$"
PAGE_HEADING = r"(?iU)^(chapter|book|prologue|epilogue|part|glossary|map|contents|foreword|preface)\b"
SCRIPT_HEADING = r"(?iU)^(chapter|part|book|prologue|epilogue)\b"
SENTENCE_END = r"""[.!?"”'][”"']?$"""
META_LINE, PAGE_MARK = r"(?U)^\s*#", r"(?U)^\s*--- page \d+ ---\s*$"
CURLY, STRAIGHT = "‘’“”", "''\"\""
#: Unicode's white space, as ``\s`` has it under ``(?U)``.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
DOUBLE_QUOTES = '"“”„‟«»'
REACTIONS = {"laugh": r"(?iU)\blaugh\w*\b", "chuckle": r"(?iU)\bchuckl\w*\b", "cough": r"(?iU)\bcough\w*\b"}
PRONOUNS = ("he", "she", "they", "him", "her", "them", "his", "hers", "their", "i", "you", "we", "it")
GENDERS = {"f": "female", "female": "female", "m": "male", "male": "male", "unknown": "unknown"}
AGES = ("adult", "child", "elderly", "unknown", "young")
SPEAKER_ID = r"^[a-z][a-z0-9_]*$"
MIN_LETTERS, MIN_LETTER_SHARE = 25, 0.35
PAUSES = {"heading": 900, "paragraph": 350, "line": 150}
REACH = 150
HEADING_CHARS = 120

#: Characters below U+0300 and these of general punctuation and currency stand in NFC whatever surrounds them.
_SURELY_NFC = r"^[\x00-\x{2FF}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{20A0}-\x{20BF}]*$"


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    """No white space at the ends. Only the ends are looked at; a pattern would try every character."""
    return F.btrim(text, F.lit(WHITE))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(WHITE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITE))


def letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{L}")).cast("long")


def nfc(text: Column) -> Column:
    """NFC. Only texts with a character that composition could touch travel to Python.

    Declared nondeterministic, so that a filter on the result isn't pushed below and made to call it again.
    """

    @F.pandas_udf("string")
    def composed(t: pd.Series) -> pd.Series:
        return t.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return F.coalesce(composed.asNondeterministic()(F.when(~text.rlike(_SURELY_NFC), text)), text)


def spoken_form(text: Column, compose: bool = True) -> Column:
    """The form a speech engine gets: NFC, plain spaces and quotes, three dots for every ellipsis."""
    text = F.translate(nfc(text) if compose else text, "\u00a0" + CURLY, " " + STRAIGHT)
    # three dots or more with white space between them, and what follows the last; written without a
    # repeated group, which would recurse once for each dot
    text = F.regexp_replace(text, r"(?U)\.\s*\.\s*\.[.\s]*|…", "...")
    # single spaces, which are most, are no matches
    return strip(F.regexp_replace(text, r"\t[ \t]*| [ \t]+", " "))


def comparison_form(text: Column) -> Column:
    """No white space, straight quotes: what alignment compares."""
    return F.translate(F.regexp_replace(text, r"(?U)\s+", ""), CURLY, STRAIGHT)


def clean_source(text: Column) -> Column:
    """A clean-text file without byte order mark, ``#`` lines and page marks; null if nothing is left."""
    lines = F.split(F.regexp_replace(text, "^\ufeff", ""), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]", -1)
    kept = F.filter(lines, lambda x: ~x.rlike(META_LINE) & ~x.rlike(PAGE_MARK))
    return F.nullif(strip(F.array_join(kept, "\n")), F.lit(""))


def json_literal(text: Column) -> Column:
    """A string as JSON text, quotes included."""
    object_ = F.to_json(F.struct(text.alias("t")))
    return F.substring(object_, F.lit(6), F.length(object_) - 6)


def digest(text: Column) -> Column:
    """SHA-256 of a string's JSON form, lower-case hex."""
    return F.sha2(json_literal(text), 256)


def gender(value: Column) -> Column:
    """``female``, ``male`` or ``unknown``; null and empty are unknown; null for anything else (an error to report)."""
    key = F.lower(strip(F.coalesce(value.cast("string"), F.lit(""))))
    pairs = [F.lit(x) for pair in GENDERS.items() for x in pair]
    return F.when(F.coalesce(value.cast("string"), F.lit("")) == "", "unknown").otherwise(F.element_at(F.create_map(*pairs), key))


def is_page_number(text: Column) -> Column:
    return text.rlike(PAGE_NUMBER)


def is_garbage(text: Column) -> Column:
    """Blank, under 25 letters, or letters a smaller part than 0.35 of the stripped text; null counts as blank."""
    bare = strip(F.coalesce(text, F.lit("")))
    return (letters(bare) < MIN_LETTERS) | (letters(bare) / F.length(bare) < MIN_LETTER_SHARE)


def is_heading(text: Column) -> Column:
    """A script heading as a whole: keyword first, one line, short."""
    return strip(text).rlike(SCRIPT_HEADING) & ~text.contains("\n") & (F.length(text) < HEADING_CHARS)


def starts_heading(text: Column) -> Column:
    return F.coalesce(text.rlike(SCRIPT_HEADING), F.lit(False))


def is_continuation(previous: Column, following: Column) -> Column:
    """Whether a paragraph goes on in the next fragment; blank or null sides never do."""
    a, b = rstrip(F.coalesce(previous, F.lit(""))), lstrip(F.coalesce(following, F.lit("")))
    return (a != "") & (b != "") & (b.rlike(r"^\p{Ll}") | a.endswith("-") | ~a.rlike(SENTENCE_END))


def pause_ms(text: Column, following: Column, gap: Column) -> Column:
    """Milliseconds after a span: ``following`` is the text after it (null at a chunk's end), ``gap`` what lies between."""
    by_gap = F.when(following.isNull() | F.coalesce(gap.contains("\n\n"), F.lit(False)), PAUSES["paragraph"]).otherwise(PAUSES["line"])
    return F.when(is_heading(text) | starts_heading(following), PAUSES["heading"]).otherwise(by_gap)


def reaction_supported(reaction: Column, source: Column, start: Column, end: Column) -> Column:
    """Whether the source within 150 characters of ``start`` to ``end`` (from 0) names the reaction; none needs no support."""
    low = F.greatest(F.lit(0), start - REACH)
    near = F.substring(source, low.cast("int") + 1, (end + REACH - low).cast("int"))
    found = F.lit(False)
    for name, root in REACTIONS.items():
        found = F.when(reaction == name, near.rlike(root)).otherwise(found)
    return F.coalesce(reaction, F.lit("")).isin("") | found


def split_pattern(limit: int) -> str:
    """A pattern whose successive matches are the pieces of :func:`split_text`."""
    if limit < 32:
        raise ValueError("the segment limit must be at least 32 characters")
    third = limit // 3
    rest = rf"(?=\S)(?s:.{{1,{limit}}})(?<=\S)(?=\s*\z)"
    mark, quote = "[.!?;:,]", "[”\"']"
    sentence = rf"(?=\S)(?s:.{{{third}}})(?:(?s:.{{2,{limit - third}}})(?:(?<={mark})|(?<={mark}{quote}))|(?s:.)(?<={mark}))(?=\s)"
    word = rf"(?=\S)(?s:.{{1,{limit}}})(?<=\S)(?=\s)"
    return f"(?U)(?:{rest}|{sentence}|{word})"


def split_text(text: Column, limit: int = 300) -> Column:
    """Pieces of at most ``limit`` characters, cut after the last punctuation in the latter two thirds, else between words.

    Null where a word alone exceeds the limit; a blank text has no pieces.
    """
    pieces = F.regexp_extract_all(text, F.lit(split_pattern(limit)), F.lit(0))
    bare = lambda x: F.length(F.regexp_replace(x, r"(?U)\s+", ""))
    return F.when(bare(F.array_join(pieces, "")) == bare(text), pieces)


def response_json(content: Column, reasoning: Column) -> Column:
    """The JSON text of a model's answer: its content, else its reasoning, without a leading block of thought."""
    blank = lambda x: F.nullif(strip(F.coalesce(x, F.lit(""))), F.lit(""))
    return F.regexp_replace(F.coalesce(blank(content), blank(reasoning)), r"(?s)^<think>.*?</think>\s*", "")


def unsupported_tags(dialogue: Column) -> Column:
    """Bracketed words that are no known reaction."""
    found = F.regexp_extract_all(dialogue, F.lit(r"\[([^\]\n]+)\]"), F.lit(1))
    return F.filter(found, lambda x: ~x.isin(*REACTIONS))


def python_pattern(pattern: str) -> re.Pattern:
    """One of this module's patterns for Python's ``re``, whose classes are Unicode's by default."""
    return re.compile(pattern.replace("(?U)", "").replace("(?iU)", "(?i)"))
