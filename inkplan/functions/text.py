"""String functions as column expressions: keyword and value normalisation, de-confusion, label splitting."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that stand for digits in numeric readings, and the digits.
CONFUSED, MEANT = "OoIliSsBb", "001115588"
#: Fixed value: the wider set used where digit windows are looked for.
WINDOW_CONFUSED, WINDOW_MEANT = "OoIilLSsBb", "0011115588"
#: Fixed value: glyphs of scripts that no value is written in.
FOREIGN = r"[぀-ヿ㐀-䶿一-鿿豈-﫿가-힯]"
COLONS = "[:：]"


@cache
def _foldings(upper: bool) -> tuple[str, str]:
    """Characters whose compatibility decomposition without marks is one ASCII character, and those; marks come last, to be deleted."""
    source, target = [], []
    for code in range(0x80, 0x2500):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain.isascii() and plain != "'":
            source.append(chr(code))
            target.append(plain.upper() if upper else plain.lower())
    marks = [chr(c) for c in range(0x300, 0x370) if unicodedata.combining(chr(c))]
    return "".join(source + marks), "".join(target)


def strip_accents(c: Column, upper: bool = False) -> Column:
    source, target = _foldings(upper)
    return F.when(ascii_only(c), c).otherwise(F.translate(c, source, target))


def ascii_only(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def keyword(c: Column) -> Column:
    """TXT1: lower case, no accents, & as et, everything but letters and digits to single spaces."""
    plain = strip_accents(F.lower(F.trim(c)))
    return F.trim(F.regexp_replace(F.replace(plain, F.lit("&"), F.lit("et")), "[^a-z0-9]+", " "))


def folded(c: Column) -> Column:
    """TXT3: upper case, no accents, single spaces; null as empty."""
    plain = strip_accents(F.upper(F.trim(F.coalesce(c, F.lit("")))), True)
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def clean(c: Column) -> Column:
    """TXT2: single spaces for blanks and underscores, no closing punctuation."""
    return F.btrim(F.trim(F.regexp_replace(c, r"[\s_]+", " ")), F.lit(".:;,«»\"'"))


def deconfuse(c: Column) -> Column:
    """TXT4."""
    return F.translate(c, CONFUSED, MEANT)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def mostly_digits(c: Column) -> Column:
    """Whether at least half of the characters, and at least one, are digits (the gate of TXT5)."""
    n = F.length(digits(c))
    return (n > 0) & (n * 2 >= F.length(c))


def deconfused_if_numeric(c: Column) -> Column:
    """TXT5 for plain numeric kinds."""
    return F.when(mostly_digits(c), deconfuse(c)).otherwise(c)


def is_noise(c: Column) -> Column:
    """FLT3: pieces of labels and foreign glyphs, never a value. A pattern is only tried where the text has some of its characters."""
    low = F.lower(F.trim(c))
    pieces = (F.contains(low, F.lit("re")) | F.contains(low, F.lit("number"))) & low.rlike(r"\bnombre\b|\bnumber\b|\bn?0?m8?re\b")
    return ends_with_colon(low) | pieces | (~ascii_only(c) & c.rlike(FOREIGN))


def ends_with_colon(c: Column) -> Column:
    return has_colon(c) & c.rlike(f"{COLONS}$")


def value_part(c: Column) -> Column:
    """TXT7: what follows the first colon, cleaned; empty without one."""
    return clean(F.regexp_extract(c, r"(?s)^[^:：]*[:：](.*)$", 1))


def label_part(c: Column) -> Column:
    return F.regexp_extract(c, r"(?s)^([^:：]*)[:：].*$", 1)


def has_colon(c: Column) -> Column:
    return F.contains(c, F.lit(":")) | F.contains(c, F.lit("："))


def has_value(c: Column) -> Column:
    """FLT5: something alphanumeric after the last separator."""
    return F.element_at(F.split(c, COLONS, -1), -1).rlike(r"(?U)\p{Alnum}")


def display_width(c: Column, least: float = 8.0, most: float = 52.0) -> Column:
    """TXT14: ASCII counts 1, other characters 1.7, two for the margin."""
    wide = F.length(c) - F.length(F.regexp_replace(c, r"[^\x00-\x7F]", ""))
    width = F.length(c) + wide.cast("double") * 0.7 + 2.0
    return F.greatest(F.lit(least), F.least(F.lit(most), F.coalesce(width, F.lit(least))))


def safe_token(c: Column) -> Column:
    """SNK6: letters, digits, - and _ only; INCONNU if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(c, "[^A-Za-z0-9_-]", ""), F.lit("")), F.lit("INCONNU"))


def capitalised(c: Column) -> Column:
    """First letter upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(c, F.lit(1), F.lit(1))), F.substring(c, F.lit(2), F.length(c)))


def tidy_name(c: Column) -> Column:
    """TXT12 for names: words of letters, each with a capital, joined by single spaces."""
    words = F.regexp_extract_all(c, F.lit("[A-Za-zÀ-ÖØ-öø-ÿ']+"), F.lit(0))
    return F.array_join(F.transform(words, capitalised), " ")


def tidy_acronym(c: Column) -> Column:
    """TXT12 for acronyms: letters and digits only, upper case."""
    return F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", ""))


def last_place(c: Column) -> Column:
    """TXT16: the last word of three letters or more, capitalised; null if there is none."""
    words = F.filter(F.regexp_extract_all(c, F.lit("[A-Za-zÀ-ÖØ-öø-ÿ']+"), F.lit(0)), lambda w: (F.length(w) >= 3) & ~is_noise(w))
    return capitalised(F.get(words, F.size(words) - 1))


def has_parasite(c: Column) -> Column:
    """FLT8: fewer letters than two or than 60 % of the characters."""
    letters = F.length(F.regexp_replace(c, "[^A-Za-zÀ-ÖØ-öø-ÿ]", ""))
    return letters < F.greatest(F.lit(2.0), F.length(c) * 0.6)


def nearest_digits(c: Column, length: int, leading: str | None = None) -> Column:
    """TXT6: of all windows of `length` characters without blanks, the digits of that with the fewest errors (a confusable letter
    counts one, another character two and gives no digit), then a wanted first digit, then the leftmost; at most two errors."""
    packed = F.regexp_replace(c, r"\s+", "")

    def window(i: Column) -> Column:
        w = F.substring(packed, i, F.lit(length))
        meant = F.translate(w, WINDOW_CONFUSED, WINDOW_MEANT)
        plain, known = F.length(digits(w)), F.length(digits(meant))
        first = F.when(F.substring(digits(meant), 1, 1).isin(*leading), 0).otherwise(1) if leading else F.lit(0)
        return F.struct(((known - plain) + 2 * (length - known)).alias("errors"), first.alias("lead"), i.alias("at"), digits(meant).alias("digits"))

    last = F.length(packed) - length + 1
    windows = F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), window))
    return F.array_min(F.filter(windows, lambda w: w["errors"] <= 2))["digits"]
