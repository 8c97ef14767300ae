"""Dates in readings: clean forms as column expressions, noisy ones by a parser in an Arrow function."""

from __future__ import annotations

import datetime
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import CONFUSED, MEANT, strip_accents

# French month names without accents.
MONTHS = ("janvier", "fevrier", "mars", "avril", "mai", "juin", "juillet", "aout", "septembre", "octobre", "novembre", "decembre")
DAY_NAMES = "lundi|mardi|mercredi|jeudi|vendredi|samedi|dimanche"
# The forms that dates are written in, and years.
LONGHAND = rf"(?i)(?:{DAY_NAMES})?\s*(\d{{1,2}})\s*([A-Za-zÀ-ÖØ-öø-ÿ]+)\s*((?:19|20)\d{{2}})"
ISO = r"(\d{4})\s*[/.\-]\s*(\d{1,2})\s*[/.\-]\s*(\d{1,2})"
PLAIN = r"(\d{1,2})\s*[/.\-]\s*(\d{1,2})\s*[/.\-]\s*((?:19|20)\d{2})"
YEAR = r"(?:19|20)\d{2}"


def _written(day: Column, month: Column, year: Column) -> Column:
    return F.concat_ws("/", F.lpad(day, 2, "0"), F.lpad(month, 2, "0"), year)


def real(c: Column) -> Column:
    """c if it is a day of the calendar written dd/MM/yyyy, else null."""
    return F.when(F.try_to_timestamp(c, F.lit("dd/MM/yyyy")).isNotNull(), c)


def from_iso(c: Column) -> Column:
    """DT1: the first yyyy-mm-dd as dd/MM/yyyy, null if there is none or it isn't a date."""
    part = [F.regexp_extract(c, ISO, k) for k in (1, 2, 3)]
    return F.when(part[0] != "", real(_written(part[2], part[1], part[0])))


def from_plain(c: Column) -> Column:
    """DT2 on clean text: the first day, month and year with separators."""
    part = [F.regexp_extract(c, PLAIN, k) for k in (1, 2, 3)]
    return F.when(part[0] != "", real(_written(*part)))


def from_longhand(c: Column) -> Column:
    """DT3: a day, a French month name and a year; the day is only held to 1 .. 31."""
    day, month, year = (F.regexp_extract(c, LONGHAND, k) for k in (1, 2, 3))
    number = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(strip_accents(month)))
    ok = (day != "") & (number > 0) & F.try_to_number(day, F.lit("99")).between(1, 31)
    return F.when(ok, _written(day, number.cast("string"), year))


def clean_date(c: Column) -> Column:
    """A date in one of the clean forms: ISO first, then numeric, then written out."""
    return F.coalesce(from_iso(c), from_plain(c), from_longhand(c))


def year_of(c: Column) -> Column:
    """DT8: the first year of a text, as an integer."""
    return F.nullif(F.regexp_extract(c, YEAR, 0), F.lit("")).cast("int")


def session_year_ok(c: Column) -> Column:
    """DT9: a year, or two with the second one later by one."""
    first, second = F.regexp_extract(c, r"^\s*(\d{4})(?:[/-](\d{4}))?\s*$", 1), F.regexp_extract(c, r"^\s*(\d{4})(?:[/-](\d{4}))?\s*$", 2)
    return (first != "") & ((second == "") | (second.try_cast("int") == first.try_cast("int") + 1))


# -- noisy dates ---------------------------------------------------------------------------------

_TABLE = str.maketrans(CONFUSED, MEANT)
_PAIR = re.compile(r"([0-9]{1,2})\s*[/.\-|,]\s*([0-9]{1,2})")
_NOISY_YEAR = re.compile(r"(?:19|20)[\s./\-|,]*[0-9][\s./\-|,]*[0-9]")
_LONGHAND = re.compile(LONGHAND.replace(r"\d", "[0-9]"))
_ISO = re.compile(ISO.replace(r"\d", "[0-9]"))


def _date(day: int, month: int, year: int) -> str | None:
    try:
        datetime.date(year, month, day)
    except ValueError:
        return None
    return f"{day:02d}/{month:02d}/{year}"


def _pairs(day: str, month: str, swap: bool) -> Iterator[tuple[int, int]]:
    """Readings of a day and month in order of trust; swap also lets the digits of either be reversed."""
    yield int(day), int(month)
    if swap and len(day) == len(month) == 2:
        back = int(day[::-1]), int(month[::-1])
        yield from ((back[0], int(month)), (int(day), back[1]), back)


def _first_pair(day: str, month: str, swap: bool) -> tuple[int, int] | None:
    return next((p for p in _pairs(day, month, swap) if 1 <= p[0] <= 31 and 1 <= p[1] <= 12), None)


def _read(text: str, swap: bool) -> tuple[str, int, int] | None:
    if (m := _ISO.search(text)) and (found := _date(int(m[3]), int(m[2]), int(m[1]))):
        return found, m.start(), m.end()
    for m in _PAIR.finditer(text):
        after = _NOISY_YEAR.search(text, m.end())
        pair = _first_pair(m[1], m[2], swap)
        if after and pair and (found := _date(*pair, int(re.sub("[^0-9]", "", after[0])[:4]))):
            return found, m.start(), after.end()
    if m := _LONGHAND.search(text):
        name = "".join(c for c in unicodedata.normalize("NFKD", m[2]) if not unicodedata.combining(c)).lower()
        if name in MONTHS and 1 <= int(m[1]) <= 31:
            return f"{int(m[1]):02d}/{MONTHS.index(name) + 1:02d}/{m[3]}", m.start(), m.end()
    if swap:
        runs = [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+", text)]
        for k, (_, end, run) in enumerate(runs):
            short = [r for r in runs[:k] if len(r[2]) <= 2][-2:]
            if re.fullmatch(YEAR.replace(r"\d", "[0-9]"), run) and len(short) == 2 and (pair := _first_pair(short[0][2], short[1][2], True)):
                if found := _date(*pair, int(run)):
                    return found, short[0][0], end
    return None


def best_date(text: str | None) -> tuple[str, int, int] | None:
    """DT6: the date that a noisy reading most likely holds, with the characters it takes up. The text as it is comes first; then it with
    letters read as digits and & as 2, where reversed digits and bare runs are allowed too."""
    if text is None:
        return None
    variants = dict.fromkeys([text, text.translate(_TABLE)])
    variants |= dict.fromkeys(v.replace("&", "2") for v in list(variants))
    return next((r for k, v in enumerate(variants) if (r := _read(v, k > 0))), None)


@F.pandas_udf(T.StructType([T.StructField("value", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))
def best_date_column(texts: pd.Series) -> pd.DataFrame:
    found = [best_date(t) or (None, None, None) for t in texts]
    out = pd.DataFrame(found, columns=["value", "start", "stop"])
    return out.astype({"start": "Int32", "stop": "Int32"})
