"""Format-preserving pseudonyms for personal data, as column expressions only.

Numbers and dates that pass their checks are permuted by a keyed Feistel network within their own format: equal values map to
equal values in every document, different ones to different ones, digits stay digits, separators stay where they are, card
numbers keep a valid check digit, social numbers keep to the ranges that are given out, addresses stay addresses and dates stay
dates from 1900 to 2099. A value is split into two numbers that are changed in turn by adding a keyed hash of the other, modulo the
number's own range, so the network is a bijection of exactly that format's values. Mail addresses and key-like hexadecimal tokens
have no such small range: they become keyed hashes of the same shape.

The key is a secret: it comes from the argument or from the session's setting SETTING, and without one nothing runs. It doesn't enter the plan: what
does are keys derived from it, one for each use, as literals that begin with MARK, which spark.redaction.string.regex=inkplan-key-[0-9a-f]+ hides in
plans, the UI and event logs.

Defined cases: null text stays null and empty text empty; numbers that fail their check (card numbers by the Luhn sum, phone numbers by seven digits, dates by
the calendar and the years 1900 to 2099, social numbers and addresses by their ranges) are left as they are, and so are plain runs of
digits that no check tells from other numbers; a date with slashes or points is read day first or, where there is no such day, month
first, and written as it was read; overlapping finds go to the first in
the text and, at one place, to the first kind of KINDS; all other columns pass unchanged, whatever their names.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

ROUNDS = 8
#: The session's setting that holds the key.
SETTING = "spark.inkplan.pseudonyms.key"
#: Steps in which a month-first date finds another that only reads month first; all but 1e-26 of them do.
WALK = 64

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: Kinds in order of precedence, as Java patterns.
KINDS = {
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}([/.])[0-9]{2}\1(?:19|20)[0-9]{2})(?![0-9]|[/-][0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+[0-9]{1,3}(?:[ .-]?[0-9]{1,4}){3,6})(?![0-9])",
    "social": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    "secret": r"(?<![0-9A-Za-z])(?=[a-fA-F]*+[0-9])(?=[0-9]*+[a-fA-F])[0-9a-fA-F]{32,}+(?![0-9A-Za-z])",
}
ANY = "|".join(f"(?:{p.replace(chr(92) + '1', chr(92) + 'k<sep>').replace('([/.])', '(?<sep>[/.])')})" for p in KINDS.values())
#: The days from 1900-01-01 to 2099-12-31 that dates are permuted over, 73,049 of them, as two factors.
DAYS = (17, 4297)
#: Area numbers of social numbers: 1 to 899 without 666; the groups 1 to 99 and serials 1 to 9999 make the second number.
AREAS, SERIALS = 898, 9999


#: What derived keys begin with, and how many hexadecimal digits stand for a mail address's name and host: 80 bits each.
MARK, MAIL_DIGITS = "inkplan-key-", 20


def derived(key: str, use: str) -> str:
    return MARK + hmac.new(key.encode(), use.encode(), hashlib.sha256).hexdigest()


def _sum(key: str, kind: Column, turn: Column, half: Column) -> Column:
    """The keyed round function: a number under 2^56."""
    text = F.concat_ws("|", F.lit(derived(key, "feistel")), kind, turn.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 14), 16, 10).cast("long")


def feistel(a: Column, b: Column, over_a: Column, over_b: Column, key: str, kind: Column) -> Column:
    """struct<a, b>: a permutation of pairs with 0 <= a < over_a, 0 <= b < over_b."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def turn(s: Column, k: Column) -> Column:
        left = F.struct(F.pmod(s["a"] + F.pmod(_sum(key, kind, k, s["b"]), over_a), over_a).alias("a"), s["b"].alias("b"))
        right = F.struct(s["a"].alias("a"), F.pmod(s["b"] + F.pmod(_sum(key, kind, k, s["a"]), over_b), over_b).alias("b"))
        return F.when(k % 2 == 0, left).otherwise(right)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10 of a digit string; 0 if its last digit is the right check digit."""
    n = F.length(digits)

    def add(s: Column, k: Column) -> Column:
        d = F.substring(digits, n - k, F.lit(1)).cast("int")
        twice = 2 * d
        return s + F.when(k % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.pmod(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add), F.lit(10))


def check_digit(body: Column) -> Column:
    """The digit that completes a card number."""
    return F.pmod(10 - luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")


def refilled(found: Column, digits: Column) -> Column:
    """found with its digits replaced, in order, by those of `digits`."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"))

    def put(s: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        return F.struct(
            F.concat(s["text"], F.when(is_digit, F.substring(digits, s["n"] + 1, F.lit(1))).otherwise(c)).alias("text"),
            (s["n"] + is_digit.cast("int")).alias("n"),
        )

    return F.aggregate(F.split(found, ""), start, put)["text"]


def _halves(x: Column) -> list[Column]:
    """a, b, over_a, over_b of a find: the two numbers that are permuted and their ranges. Digit strings are cut in the middle,
    addresses into two pairs, social numbers after the area, dates by their number of days; all NULL where a check fails or nothing is
    permuted."""
    kind, body = x["kind"], x["body"]
    left = F.floor(F.length(body) / 2).cast("int")
    ten = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    part = [F.try_to_number(F.get(F.split(x["found"], r"\."), F.lit(k)), F.lit("999")).cast("long") for k in range(4)]
    number = kind.isin("phone", "card")
    area, rest = F.substring(body, 1, 3).cast("long"), (F.substring(body, 4, 2).cast("long") - 1) * SERIALS + F.substring(body, 6, 4).cast("long") - 1

    def of(ip: Column, date: Column, social: Column, digits: Column) -> Column:
        return F.when(kind == "ip", ip).when(kind == "date", date).when(kind == "social", social).when(number & x["ok"], digits)

    long = lambda n: F.lit(n).cast("long")
    return [
        of(part[0] * 256 + part[1], F.floor(x["days"] / DAYS[1]), area - F.when(area > 666, 2).otherwise(1), F.substring(body, F.lit(1), left).cast("long")).alias("a"),
        of(part[2] * 256 + part[3], F.pmod(x["days"], F.lit(DAYS[1])), rest, F.substring(body, left + 1, F.length(body)).cast("long")).alias("b"),
        of(long(65536), long(DAYS[0]), long(AREAS), ten(left)).alias("over_a"),
        of(long(65536), long(DAYS[1]), long(99 * SERIALS), ten(F.length(body) - left)).alias("over_b"),
    ]


START = "1900-01-01"


def _days(found: Column, *forms: str) -> Column:
    """Days from 1900-01-01 of a written date, NULL if the calendar has no such day."""
    form = F.regexp_replace(found, r"[/.]", "-")
    day = F.coalesce(*[F.try_to_timestamp(form, F.lit(f)) for f in forms]).cast("date")
    return F.datediff(day, F.lit(START).cast("date")).cast("long")


def _day(s: Column) -> Column:
    return F.date_add(F.lit(START).cast("date"), (s["a"] * DAYS[1] + s["b"]).cast("int"))


def _moved(x: Column, key: str) -> Column:
    """The permuted halves. A month-first date is permuted again until it is one that can't be read day first, so that both orders have
    permutations of their own."""
    kind = F.concat(x["kind"], F.length(x["body"]).cast("string"), F.when(x["us"], "us").otherwise(""))
    turn = lambda s: feistel(s["a"], s["b"], x["over_a"], x["over_b"], key, kind)
    again = lambda s, _: F.when(F.dayofmonth(_day(s)) > 12, s).otherwise(turn(s))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), turn(x), again)
    return F.when(x["us"], walked).when(x["a"].isNotNull(), turn(x))


def _written(x: Column, key: str) -> Column:
    """The pseudonym of a find from its permuted halves."""
    found, kind, s = x["found"], x["kind"], x["s"]
    moved, sep = _day(s), found.substr(3, 1)
    month, day = F.date_format(moved, "MM"), F.date_format(moved, "dd")
    first, second = F.when(x["us"], month).otherwise(day), F.when(x["us"], day).otherwise(month)
    date = F.when(found.substr(5, 1) == "-", F.date_format(moved, "yyyy-MM-dd")).otherwise(F.concat(first, sep, second, sep, F.date_format(moved, "yyyy")))
    ip = F.concat_ws(".", *[n.cast("string") for h in ("a", "b") for n in (F.shiftright(s[h], 8), s[h].bitwiseAND(255))])
    return (
        F.when(kind == "mail", _mail(found, key)).when(kind == "secret", _secret(found, key)).when(s["a"].isNull(), found)
        .when(kind == "ip", ip).when(kind == "date", date)
        .otherwise(F.concat(x["prefix"], refilled(F.substring(found, F.length(x["prefix"]) + 1, F.length(found)), x["digits"])))
    )


def _hashed(found: Column, key: str, kind: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(derived(key, kind)), found), 256)


def _mail(found: Column, key: str) -> Column:
    host = F.substring_index(found, "@", -1)
    return F.concat(
        F.lit("p"), F.substring(_hashed(F.lower(found), key, "mail"), 1, MAIL_DIGITS), F.lit("@d"),
        F.substring(_hashed(F.lower(host), key, "host"), 1, MAIL_DIGITS), F.lit("."), F.substring_index(host, ".", -1),
    )


def _secret(found: Column, key: str) -> Column:
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.length(found) - 1) / 64)), lambda k: _hashed(F.concat_ws("|", k.cast("string"), found), key, "secret"))
    new = F.substring(F.array_join(parts, ""), F.lit(1), F.length(found))
    return F.when(found.rlike("[A-F]"), F.upper(new)).otherwise(new)


def kind_of(found: Column) -> Column:
    """Which of KINDS a find is; the finds hold nothing that needs a look around."""
    return (
        F.when(found.contains("@"), "mail")
        .when(found.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), "ip")
        .when(found.rlike(r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4})$"), "date")
        .when(found.startswith("+"), "phone")
        .when(found.rlike(r"[a-fA-F]"), "secret")
        .when(found.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "social")
        .when(F.length(F.regexp_replace(found, "[^0-9]", "")) >= 13, F.when(found.rlike(r"[+(.]"), "phone").otherwise("card"))
        .otherwise("phone")
    )


def pseudonyms(finds: Column, key: str) -> Column:
    """An array of finds to the array of their pseudonyms. Each step names what the next one uses, so that nothing is worked out twice."""

    def step(array: Column, make) -> Column:
        return F.transform(array, make)

    x = step(finds, lambda m: F.struct(m.alias("found"), kind_of(m).alias("kind")))
    x = step(x, lambda x: F.struct(
        x["found"].alias("found"), x["kind"].alias("kind"),
        F.when(x["kind"] == "phone", F.regexp_extract(x["found"], r"^\+[0-9]{1,3}(?=[ .(-])", 0)).otherwise("").alias("prefix"),
        F.when(x["kind"] == "date", _days(x["found"], "yyyy-MM-dd", "dd-MM-yyyy")).alias("days"), F.when(x["kind"] == "date", _days(x["found"], "MM-dd-yyyy")).alias("other"),
    ))
    x = step(x, lambda x: F.struct(
        *[x[c].alias(c) for c in ("found", "kind", "prefix")], F.coalesce(x["days"], x["other"]).alias("days"), (x["days"].isNull() & x["other"].isNotNull()).alias("us"),
    ))
    x = step(x, lambda x: F.struct(
        *[x[c].alias(c) for c in ("found", "kind", "prefix", "days", "us")],
        F.regexp_replace(F.substring(x["found"], F.length(x["prefix"]) + 1, F.length(x["found"])), "[^0-9]", "").alias("all"),
    ))
    x = step(x, lambda x: F.struct(
        *[x[c].alias(c) for c in ("found", "kind", "prefix", "days", "us")],
        F.when(x["kind"] == "card", F.substring(x["all"], F.lit(1), F.length(x["all"]) - 1)).otherwise(x["all"]).alias("body"),
        F.when(x["kind"] == "card", luhn(x["all"]) == 0).otherwise(F.length(x["all"]) >= 7).alias("ok"),
    ))
    x = step(x, lambda x: F.struct(*[x[c].alias(c) for c in ("found", "kind", "prefix", "body", "us")], *_halves(x)))
    x = step(x, lambda x: F.struct(
        *[x[c].alias(c) for c in ("found", "kind", "prefix", "body", "us")], _moved(x, key).alias("s"),
    ))
    x = step(x, lambda x: F.struct(
        *[x[c].alias(c) for c in ("found", "kind", "prefix", "us", "s")], F.when(x["kind"] == "social", _social(x["s"])).otherwise(F.concat(
            F.lpad(x["s"]["a"].cast("string"), F.floor(F.length(x["body"]) / 2).cast("int"), "0"),
            F.lpad(x["s"]["b"].cast("string"), F.ceil(F.length(x["body"]) / 2).cast("int"), "0"),
        )).alias("new"),
    ))
    x = step(x, lambda x: F.struct(
        *[x[c].alias(c) for c in ("found", "kind", "prefix", "us", "s")],
        F.when((x["kind"] == "card") & x["new"].isNotNull(), F.concat(x["new"], check_digit(x["new"]))).otherwise(x["new"]).alias("digits"),
    ))
    return step(x, lambda x: _written(x, key))


def _social(s: Column) -> Column:
    area = s["a"] + F.when(s["a"] >= 665, 2).otherwise(1)
    digits = lambda n, size: F.lpad(n.cast("string"), size, "0")
    return F.concat(digits(area, 3), digits(F.floor(s["b"] / SERIALS) + 1, 2), digits(F.pmod(s["b"], F.lit(SERIALS)) + 1, 4))


def pseudonymise(df: DataFrame, text_col: str = "text", key: str | None = None, count_col: str | None = None) -> DataFrame:
    """df with the personal data in text_col replaced; count_col, if named, gets how many finds changed. Without `key` that of SETTING holds.
    Documents without a digit or an at sign are passed by the first test alone."""
    key = key or df.sparkSession.conf.get(SETTING, None)
    if not key:
        raise ValueError(f"pseudonyms need a key: pass one or set {SETTING}")
    hits, out = fresh(df, "_hits"), fresh(df, "_new")
    text = F.col(f"`{text_col}`")
    none = F.array().cast("array<string>")
    found = df.withColumn(hits, F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none))
    found = found.withColumn(out, pseudonyms(F.coalesce(hits, none), key))
    joined = F.array_join(F.zip_with(F.split(text, ANY, -1), F.col(out), lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    changed = F.size(F.filter(F.arrays_zip(F.col(hits).alias("a"), F.col(out).alias("b")), lambda p: p["a"] != p["b"]))
    columns = [(F.when(F.size(out) > 0, joined).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`")) for c in df.columns]
    return found.select(*columns, *([changed.cast("long").alias(count_col)] if count_col else []))
