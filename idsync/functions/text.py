"""String normalisation as Column expressions; every function keeps null as null."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters that one ASCII letter doesn't stand for or that have no decomposition.
SPECIAL = {
    "ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th", "ð": "d", "Ð": "D", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L",
    "đ": "d", "Đ": "D", "ħ": "h", "Ħ": "H", "ı": "i", "ŋ": "ng", "Ŋ": "NG", "ĸ": "k", "ŧ": "t", "Ŧ": "T", "ə": "e", "Ə": "E", "’": "'", "‘": "'", "“": '"', "”": '"',
    "–": "-", "—": "--", "…": "...", " ": " ",
}
# Romanisation of Cyrillic and Greek lower-case letters.
ROMAN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "io", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r",
    "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "'", "ы": "y", "ь": "'", "э": "e", "ю": "iu", "я": "ia", "і": "i", "ї": "yi", "є": "ye", "ґ": "g",
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t",
    "υ": "u", "φ": "ph", "χ": "kh", "ψ": "ps", "ω": "o",
}
# Endings of women's sides, taken off in this order, then phrases deleted anywhere.
WOMENS_ENDINGS = (r",?\s+Women'+s$", r",?\s+Womens$", r",?\s+Women$", r",?\s+W$", r"\s+WFC$", r"\s+LFC$", r"\s+Ladies$", r"\s+F$")
WOMENS_PHRASES = (", Women", ", Women's", " Women's", " WFC", " Femenino", " Femminile", "Féminas")
# Club words at the end and at the start of a name; one is taken off.
CLUB_ENDINGS = ("SC", "Sc", "sc", "FC", "fc", "Fc", "LFC", "CF", "CD", "WFC", "FCW", "HSC", "AC", "AF", "FCO", "Ladies", "Women", "W", "F", "Women's", "VF", "FF", "Football")
CLUB_STARTS = ("SC", "FC", "CF", "CD", "RC", "OL", "Olympique de", "Olympique", "WNT", "SKN", "SK", "1.")


# All blanks, as a character class that Java and RE2 read alike; what isn't part of a word.
BLANK = r"[\s\x1c-\x1f\x{85}\p{Z}]"
NO_WORD = r"[^\p{L}\p{N}]+"


@lru_cache(maxsize=1)
def _tables() -> tuple[str, str, dict[str, str]]:
    """(letters, their ASCII letters, letters that become several), generated from the Unicode decompositions."""
    one, many = {}, {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(code)
        base = unicodedata.normalize("NFKD", c)
        plain = "".join(x for x in base if not unicodedata.combining(x))
        if plain and plain.isascii() and plain != c:
            (one if len(plain) == 1 else many)[c] = plain
    for c, r in [*SPECIAL.items(), *ROMAN.items(), *((k.upper(), v.capitalize()) for k, v in ROMAN.items() if len(k.upper()) == 1 and k != "ς")]:
        one.pop(c, None)
        many.pop(c, None)
        (one if len(r) == 1 else many)[c] = r
    return "".join(one), "".join(one.values()), many


def strip(c: Column) -> Column:
    """Trim all Unicode blanks at both ends."""
    return F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+$", "")


def clean_spaces(c: Column) -> Column:
    return F.translate(strip(c), " ", " ")


def remove_accents(c: Column, kana_hangul: bool = False) -> Column:
    """ASCII form of Latin, Cyrillic and Greek letters; marks are dropped.

    ``kana_hangul`` also romanises Kana and Hangul, through an Arrow UDF.
    """
    singles, plain, many = _tables()
    out = F.translate(F.regexp_replace(strip(c), r"\p{M}", ""), singles, plain)
    for letter, text in many.items():
        if letter in SPECIAL or letter.lower() in ROMAN:
            out = F.replace(out, F.lit(letter), F.lit(text))
    return _romanise(out) if kana_hangul else out


@F.pandas_udf(T.StringType())
def _romanise(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Kana and Hangul by the sounds in their character names."""

    def letter(ch: str) -> str:
        m = re.match(r"(?:HANGUL SYLLABLE|KATAKANA LETTER(?: SMALL)?|HIRAGANA LETTER(?: SMALL)?) (\w+)$", unicodedata.name(ch, ""))
        return m.group(1).lower() if m else ch

    for s in values:
        yield s.map(lambda x: "".join(map(letter, x)), na_action="ignore")


def non_word_chars(c: Column) -> Column:
    return F.regexp_replace(c, NO_WORD, " ")


def double_spaces(c: Column) -> Column:
    return F.regexp_replace(c, rf"{BLANK}+", " ")


def womens_suffixes(c: Column) -> Column:
    out = strip(c)
    for ending in WOMENS_ENDINGS:
        out = F.regexp_replace(out, ending, "")
    for phrase in WOMENS_PHRASES:
        out = F.replace(out, F.lit(phrase), F.lit(""))
    return strip(out)


def youth_suffixes(c: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(strip(c), " Under-?", " U"), " Sub-?", " U")
    out = F.replace(out, F.lit(" U-"), F.lit(" U"))
    return strip(F.regexp_replace(out, r" U\s?\d+$", ""))


def common_suffixes(c: Column) -> Column:
    ends = "|".join(re.escape(x) for x in CLUB_ENDINGS)
    return F.regexp_replace(youth_suffixes(womens_suffixes(c)), rf"(?: (?:{ends})|\sW|, W)$", "")


def common_prefixes(c: Column) -> Column:
    return F.regexp_replace(c, rf"^(?:{'|'.join(re.escape(x) for x in CLUB_STARTS)}) ", "")


def normalize(c: Column, kana_hangul: bool = False) -> Column:
    """Lower-case ASCII words with one blank between them."""
    return strip(F.lower(double_spaces(non_word_chars(remove_accents(clean_spaces(c), kana_hangul)))))


def normalize_team_names(c: Column) -> Column:
    return normalize(common_prefixes(common_suffixes(c)))


def ngrams(c: Column, n: int = 3) -> Column:
    """All runs of ``n`` characters, with repeats, after blanks and , - . / ; are deleted; null gives an empty list."""
    if n <= 0:
        raise ValueError("n must be greater than 0")
    text = F.regexp_replace(c, rf"[,\-./;]|{BLANK}", "")
    made = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, made).otherwise(F.array().cast("array<string>"))


def token_set(c: Column) -> Column:
    return F.array_distinct(F.split(c, r"\s+"))
