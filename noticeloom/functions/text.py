"""Text normalisation as Column expressions. Dialects: "py" and "js" (see rules.DIALECTS)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Digit and letter foldings of the notice format.
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
ASCII_DIGITS = "0123456789"
DIACRITICS = "[\\u0610-\\u061a\\u064b-\\u065f\\u0670\\u06d6-\\u06ed]"
LETTERS_FROM, LETTERS_TO = "إأآٱىؤئةـ", "اااايويه"  # tatweel has no counterpart and goes
ARABIC = "[\\u0600-\\u06ff]"
BIDI_MARKS = "[\\u200e\\u200f\\u202a-\\u202e\\u2066-\\u2069]"
TRIM = " .,:;-"
#: What \s matches with (?U).
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
ASCII_SPACES = r"[ \t\n\x0B\f\r]+"


def is_ascii(c: Column) -> Column:
    """Whether a text is ASCII, told by its sizes: most work on letters beyond it can then be left out."""
    return F.octet_length(c) == F.length(c)


def _mapped(c: Column, make: Callable[[], Callable[[str], str]]) -> Column:
    """Apply a Python function of strings in Arrow batches; `make` builds it on the executor.

    The UDF object is made anew for each use: once used it holds a JVM handle, and this module must
    stay free of such handles, as it travels by value with the functions that refer to it.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = make()
        for s in batches:
            yield s.map(lambda v: None if v is None else one(v))

    return F.pandas_udf(run, StringType())(c)


def _normaliser(form: str) -> Callable[[], Callable[[str], str]]:
    def make() -> Callable[[str], str]:
        import unicodedata

        return lambda v: unicodedata.normalize(form, v)

    return make


def _compatible(c: Column, form: str) -> Column:
    ascii_only = F.coalesce(is_ascii(c), F.lit(True))
    return F.when(ascii_only, c).otherwise(_mapped(F.when(~ascii_only, c), _normaliser(form)))


def nfkc(c: Column) -> Column:
    """NFKC. Spark has no such function, so non-ASCII values pass through one Arrow UDF."""
    return _compatible(c, "NFKC")


def nfkd(c: Column) -> Column:
    return _compatible(c, "NFKD")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def tidy(c: Column, dialect: str) -> Column:
    """normalise() without NFKC: digits to ASCII, marks dropped (py) or spaced (js), blanks collapsed
    and trimmed around line breaks."""
    c = F.when(is_ascii(c), c).otherwise(F.translate(c, ARABIC_DIGITS + PERSIAN_DIGITS + "\u00a0\u200e\u200f", ASCII_DIGITS * 2 + (" " if dialect == "py" else "   ")))
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r" *\n *", "\n")
    return strip(c)


#: Blanks that tidy() changes, in a text without letters beyond ASCII.
UNTIDY = r"[\t\x0B\f\r]|\A[ \n]|[ \n]\z|  | \n|\n "


def untidy(c: Column, also: str = "") -> Column:
    """The text if normalise() may change it (or if it has a character of `also`), else null: settled, it
    keeps the work on odd texts away from the others."""
    return F.when(~is_ascii(c) | c.rlike(UNTIDY + (f"|[{also}]" if also else "")), c)


def normalise(c: Column, dialect: str = "js") -> Column:
    return tidy(nfkc(F.coalesce(c, F.lit(""))), dialect)


def fold(c: Column) -> Column:
    """Fold normalised text for matching: no diacritics or tatweel, one form of each letter family,
    all white space one space, lower case. Latin accents stay."""
    one = F.translate(F.regexp_replace(c, DIACRITICS, ""), LETTERS_FROM, LETTERS_TO)
    return F.lower(strip(F.when(is_ascii(c), F.regexp_replace(c, ASCII_SPACES, " ")).otherwise(F.regexp_replace(one, r"(?U)\s+", " "))))


def fold_lines(lines: Column) -> Column:
    """fold() of each line of an array, by one pass over the joined text."""
    joined = F.array_join(lines, "\n")
    c = F.translate(F.regexp_replace(joined, DIACRITICS, ""), LETTERS_FROM, LETTERS_TO)
    c = F.trim(F.regexp_replace(F.regexp_replace(c, r"(?U)[\s&&[^\n]]+", " "), " ?\n ?", "\n"))
    # most ASCII lines have single spaces, inside: there is nothing to fold but the case
    odd = joined.startswith(" ") | joined.endswith(" ")
    for blank in ("  ", " \n", "\n ", "\t", "\x0b", "\f", "\r"):
        odd = odd | joined.contains(blank)
    return F.when(F.size(lines) > 0, F.split(F.lower(F.when(is_ascii(joined) & ~odd, joined).otherwise(c)), "\n")).otherwise(lines)


def lines_of(c: Column, dialect: str = "js") -> Column:
    """Trimmed non-empty lines of normalised text; py also breaks at the other line separators."""
    cut = r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]" if dialect == "py" else "\n"
    return F.filter(F.transform(F.split(c, cut), strip), lambda x: x != "")


def clean_field(c: Column) -> Column:
    """Blanks collapsed, ` .,:;-` trimmed; empty is null."""
    c = F.regexp_replace(c, r"(?U)\s+", " ")
    return F.nullif(F.btrim(c, F.lit(TRIM)), F.lit(""))


def clean_value(c: Column) -> Column:
    """Blanks collapsed, none before punctuation; empty is null."""
    c = F.regexp_replace(c, r"(?U)\s+", " ")
    return F.nullif(strip(F.regexp_replace(c, r" +([,.;:،])", "$1")), F.lit(""))


def ocr_text(c: Column) -> Column:
    """Text of a second reading: NFKC, no direction marks or tatweel, collapsed non-empty lines."""
    c = F.translate(F.regexp_replace(nfkc(F.coalesce(c, F.lit(""))), BIDI_MARKS, ""), "ـ", "")
    lines = F.transform(F.split(c, r"\r?\n"), lambda x: strip(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def ocr_fold(c: Column) -> Column:
    """Fold a second reading's text, line breaks kept."""
    return F.lower(F.translate(F.regexp_replace(c, DIACRITICS, ""), LETTERS_FROM, LETTERS_TO))


def compact(c: Column) -> Column:
    """Letters and numbers of the folded text only."""
    return F.regexp_replace(ocr_fold(c), r"[^\p{L}\p{N}]", "")


def uppercase_ratio(c: Column) -> Column:
    """Share of upper-case among letters; null without letters."""
    left = lambda latin, every: F.length(F.when(is_ascii(c), F.regexp_replace(c, latin, "")).otherwise(F.regexp_replace(c, every, ""))).cast("double")
    return F.try_divide(left("[^A-Z]+", r"[^\p{Lu}]+"), left("[^A-Za-z]+", r"[^\p{L}]+"))


def has_arabic(c: Column) -> Column:
    return c.rlike(ARABIC)


# Named entities that the format decodes (in any case), in order.
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;|&#39;", "'")]


def _numeric_entities() -> Callable[[str], str]:
    import re

    def one(m) -> str:
        code = int(m[1][1:], 16) if m[1][0] in "xX" else int(m[1])
        return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]

    pattern = re.compile(r"&#([xX][0-9a-fA-F]{1,8}|[0-9]{1,9});")
    return lambda v: pattern.sub(one, v)


def decode_entities(c: Column) -> Column:
    """Numeric entities (one Arrow UDF, only for values that hold any), then the named ones in order,
    so `&amp;lt;` decodes twice."""
    numeric = F.coalesce(c.contains("&#"), F.lit(False))
    c = F.when(numeric, _mapped(F.when(numeric, c), _numeric_entities)).otherwise(c)
    named = c
    for name, value in ENTITIES:
        named = F.regexp_replace(named, f"(?i){name}", value)
    return F.when(c.contains("&"), named).otherwise(c)


def html_to_text(c: Column) -> Column:
    """Line breaks for <br> and closing block tags, other tags a space, entities decoded, lines trimmed."""
    whole = c
    odd = ~is_ascii(c) | c.rlike(r"[<&\t-\r]|\A | \z|  ")  # an ASCII text of words with single spaces stays as it is
    c = F.regexp_replace(c, r"(?i)<br\s*/?>", "\n")
    c = F.regexp_replace(c, r"(?i)</(?:p|div|li|tr|td|th)>", "\n")
    c = decode_entities(F.regexp_replace(c, r"<[^>]+>", " "))
    lines = F.transform(F.split(c, "\n"), lambda x: strip(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.when(~odd, whole).otherwise(F.array_join(F.filter(lines, lambda x: x != ""), "\n"))


# Titles that name no company, without accents and stops.
GENERIC_TITLES = ["SA", "SARL", "SARL AU", "SARLAU", "SAS", "SOCIETE A RESPONSABILITE LIMITEE", "SOCIETE A RESPONSABILITE LIMITEE A ASSOCIE UNIQUE"]
TITLE_LEAST, TITLE_MOST, TITLE_UPPER = 2, 160, 0.76


def clean_title(c: Column) -> Column:
    """Normalised text without heading marks and the quotes and punctuation around it."""
    c = F.regexp_replace(c, r"\A#{1,6}\s*", "")
    return strip(F.regexp_replace(c, r"""\A[«"' .:،;\-]+|[»"' .:،;\-]+\z""", ""))


def meaningful_title(c: Column) -> Column:
    """Whether a clean title of 2 to 160 characters has a Latin letter and is more than a legal form."""
    bare = F.regexp_replace(F.regexp_replace(nfkd(c), r"[\p{M}.]", ""), r"(?U)\s+", " ")
    fits = F.length(c).between(TITLE_LEAST, TITLE_MOST) & c.rlike(r"\p{IsLatin}")
    return F.coalesce(fits & ~F.upper(strip(bare)).isin(*GENERIC_TITLES), F.lit(False))


def looks_like_title(c: Column) -> Column:
    """Whether a text reads as a title: meaningful, not Arabic, Latin letters mostly upper-case (letters
    without case count as upper)."""
    return title_like(clean_title(c))


def title_like(title: Column) -> Column:
    """looks_like_title() of a clean title."""
    latin = F.length(F.regexp_replace(title, r"[^\p{IsLatin}]", ""))
    small = F.length(F.regexp_replace(title, r"[^\p{IsLatin}]|[^\p{Ll}\p{Lt}]", ""))
    return meaningful_title(title) & ~title.rlike(r"\p{IsArabic}") & ((latin - small) >= latin * TITLE_UPPER)


def clean_block(c: Column) -> Column:
    """Normalised text of an OCR block: tables as text, line ends as line breaks, no heading marks."""
    tagged = c.rlike(r"(?i)<\s*(?:table|tr|td|th)\b")
    c = F.when(tagged, html_to_text(F.when(tagged, c))).otherwise(c)
    return normalise(F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"(?m)^#{1,6}\s*", ""))
