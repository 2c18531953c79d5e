"""Text column functions: normalization, ratios, predicates, identities.

All of them are Spark expressions but Unicode NFC, for which Spark has no function: an
Arrow UDF sees only texts with a code point from U+0300 on (all below are stable under
NFC), and is marked nondeterministic so that the optimizer evaluates it once.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What counts as white space besides the line feed, as control characters,
# as letters of the two scripts, and as a hint of mathematics.
WS = r" \t\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]"
LATIN = "[A-Za-z]"
HANGUL_LATIN = r"[A-Za-z\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{AC00}-\x{D7A3}]"
HANGUL_SYLLABLE = r"[\x{AC00}-\x{D7A3}]"
MATH = r"[=^_$∑√∫±≤≥∞≈≠∂∇πθαβγΔΩ]|\\frac|\\sum|\\int|\\sqrt"
SPACE = rf"[{WS}\n]"
PUNCTUATION = rf"[^\p{{L}}\p{{N}}_{WS}\n]"
RUN = r"(?s)((.)\2+)"
#: The characters of SPACE, and ASCII that is no punctuation: what needs no pattern of many ranges for each character.
SPACES = " \t\n\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
PLAIN = "[A-Za-z0-9_ \n]"


@F.pandas_udf(StringType())  # a type, not its name: importing needs no session
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


_nfc = _nfc.asNondeterministic()


def nfc(text: Column) -> Column:
    """The text in Unicode normal form C."""
    return F.coalesce(_nfc(F.when(text.rlike(r"[^\x{0}-\x{2FF}]"), text)), text)


def replaced(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(by))


def _where(text: Column, parts: list[str], pattern: str, by: str) -> Column:
    """Replaced where the text holds one of these parts, without which the pattern matches nothing. The text
    is an array's one element, so that what makes it is computed once, however often it is named here."""
    def one(t: Column) -> Column:
        return F.when(reduce(Column.__or__, [t.contains(x) for x in parts]), replaced(t, pattern, by)).otherwise(t)

    return F.transform(F.array(text), one)[0]


def unify_newlines(text: Column) -> Column:
    return _where(text, ["\r"], r"\r\n?", "\n")


def drop_controls(text: Column) -> Column:
    return replaced(text, CONTROL, "")


def trim_line_ends(text: Column) -> Column:
    return _where(text, [f"{x}\n" for x in SPACES if x != "\n"], f"[{WS}]+\n", "\n")


def collapse_newlines(text: Column) -> Column:
    return _where(text, ["\n\n\n"], "\n{3,}", "\n\n")


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def normalize(text: Column) -> Column:
    """NFC, newlines, control characters, line ends, blank lines, ends: in this order."""
    return strip(collapse_newlines(trim_line_ends(drop_controls(unify_newlines(nfc(text))))))


def once(x: Column) -> Column:
    """The same values, computed where the column is made: the optimizer inlines no expression
    that counts as nondeterministic into the filters and columns that read it."""
    return F.when(F.spark_partition_id() >= 0, x)


def occurrences(text: Column, pattern: str) -> Column:
    """How many code points match a class, without a list of matches: runs of them are taken out at once."""
    if pattern == SPACE:
        return F.length(text) - F.length(F.translate(text, SPACES, ""))
    if pattern == PUNCTUATION:
        text = replaced(text, f"{PLAIN}++", "")
    return F.length(text) - F.length(replaced(text, f"{pattern}++", ""))


def ratio(text: Column, pattern: str) -> Column:
    """Share of code points that match a class; null for an empty text."""
    return occurrences(text, pattern) / F.nullif(F.length(text), F.lit(0))


def longest_run(text: Column) -> Column:
    """Length of the longest run of one code point; at least 1."""
    runs = F.transform(F.regexp_extract_all(text, F.lit(RUN), F.lit(1)), lambda x: F.length(x))
    return F.coalesce(F.array_max(runs), F.lit(1))


def run_ratio(text: Column) -> Column:
    """Longest run over length; 1 for an empty text."""
    return F.when(text == "", F.lit(1.0)).otherwise(longest_run(text) / F.length(text))


def is_english(language: Column) -> Column:
    """Whether a language tag is en, english or en-*; false for null."""
    tag = F.lower(strip(language))
    return F.coalesce(tag.isin("en", "english") | tag.startswith("en-"), F.lit(False))


def document_id(source: Column, text: Column) -> Column:
    return F.sha2(F.concat(source, F.lit("\n"), text), 256)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def preview(text: Column, chars: int = 80) -> Column:
    return F.replace(F.substring(text, 1, chars), F.lit("\n"), F.lit(" "))


def error_kind(error: Column) -> Column:
    """The part of an error text before the first colon."""
    return F.substring_index(error, ":", 1)


def has_hangul(text: Column) -> Column:
    return text.rlike(HANGUL_SYLLABLE)


def has_latin(text: Column) -> Column:
    return text.rlike(LATIN)


def has_digit(text: Column) -> Column:
    return text.rlike("[0-9]")


def has_math(text: Column) -> Column:
    return text.rlike(MATH)


def replacement_chars(text: Column) -> Column:
    return occurrences(text, r"\x{FFFD}")


def rounded(x: Column) -> Column:
    """Half to even, as a long."""
    return F.bround(x, 0).cast("long")
