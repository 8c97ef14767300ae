"""Validation rules as column expressions: a status of valid, warning or error and a message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text
from ..functions.numbers import mean4
from . import fields

WARNING_BELOW, ERROR_BELOW = 0.85, 0.65
YEARS = (1950, 2026)
NAME = r"^[A-Za-zÀ-ÖØ-öø-ÿ' -]{2,}$"
PREFIX_MESSAGE = "the identifier doesn't begin with the series"


def by_confidence(confidence: Column, warning: float = WARNING_BELOW, error: float = ERROR_BELOW) -> Column:
    """VAL1: strict comparisons, so that the thresholds themselves are the better class."""
    return F.when(confidence < error, "error").when(confidence < warning, "warning").otherwise("valid")


def worst(*statuses: Column) -> Column:
    return F.when(F.greatest(*[F.when(s == "error", 2).when(s == "warning", 1).otherwise(0) for s in statuses]) == 2, "error").when(
        F.greatest(*[F.when(s == "warning", 1).otherwise(0) for s in statuses]) == 1, "warning"
    ).otherwise("valid")


def cin_message(value: Column) -> Column:
    """VAL2: null if the number is right."""
    packed = F.regexp_replace(value, " ", "")
    return (
        F.when(packed.rlike("^[01][0-9]{7}$"), None).when(packed.rlike("^[0-9]{8}$"), "first digit must be 0 or 1")
        .when(packed.rlike(r"(?U)\p{Alpha}"), "letters in the number").otherwise("eight digits expected")
    )


def date_message(value: Column, session_year: Column | None = None, found: Column | None = None) -> Column:
    """VAL3: null if the date is right. found: the date read from the value (dates.clean_date for clean text, dates.best_date_column for noisy)."""
    found = dates.clean_date(value) if found is None else found
    year = F.substring(found, -4, 4).cast("int")
    message = (
        F.when(found.isNull() & (value.rlike(r"[0-9]{1,2}\s*[/.\-]\s*[0-9]{1,2}\s*[/.\-]\s*[0-9]{2,4}") | value.rlike(dates.ISO)), "no such day")
        .when(found.isNull() & value.rlike(dates.YEAR), None).when(found.isNull(), "no date")
        .when(~year.between(*YEARS), "year out of range").when(F.try_to_timestamp(found, F.lit("dd/MM/yyyy")).isNull(), "no such day")
    )
    return message if session_year is None else F.coalesce(message, F.when(found.isNotNull() & (year > session_year - 17), "too young for the session"))


def date_status(value: Column, status: Column, message: Column) -> Column:
    """A year without day and month is a warning, other wrong dates are errors."""
    probe = F.regexp_replace(text.deconfuse(value), "&", "2")
    partial = probe.rlike(dates.YEAR) & ~probe.rlike(dates.PLAIN) & (status == "valid")
    return F.when(message.isNull(), status).when(partial, "warning").otherwise("error")


def identifier_status(value: Column, series: Column, status: Column) -> Column:
    """VAL4: begins with the series' digits, six digits; five, seven or eight are a warning."""
    own, first = text.digits(value), text.digits(series)
    return (
        F.when(identifier_mismatch(value, series), "error")
        .when(value.rlike("[A-Za-z]") | ~own.rlike("^[0-9]{5,8}$"), "error").when((F.length(own) != 6) & (status == "valid"), "warning").otherwise(status)
    )


def identifier_mismatch(value: Column, series: Column) -> Column:
    given = F.trim(F.coalesce(series, F.lit("")))
    first = text.digits(given)
    return (given != "") & ~((first != "") & text.digits(value).startswith(first))


def count_ok(value: Column) -> Column:
    """VAL5."""
    return value.rlike("^[1-5]$")


def series_ok(value: Column) -> Column:
    """VAL6."""
    return ~value.rlike("[A-Za-z]") & text.digits(value).rlike("^[0-9]{3,4}$")


def duration_status(value: Column, status: Column) -> Column:
    """VAL7: in words is a warning, a single character an error."""
    return F.when(value.rlike(fields.DURATION) | value.rlike("[0-9]"), status).when(F.length(value) >= 2, "warning").otherwise("error")


def anonymity_ok(value: Column, series: Column, identifier: Column) -> Column:
    """VAL8: digits; those of series and identifier where both are plain."""
    s, i = F.trim(F.coalesce(series, F.lit(""))), F.trim(F.coalesce(identifier, F.lit("")))
    plain = s.rlike("^[0-9]{3,4}$") & i.rlike("^[0-9]+$")
    return F.regexp_replace(value, " ", "").rlike("^[0-9][0-9 -]{3,19}$") & (~plain | (text.digits(value) == F.concat(s, i)))


def name_ok(value: Column) -> Column:
    """VAL9."""
    return value.rlike(NAME)


def school_ok(value: Column) -> Column:
    """VAL10: digits left in a short name are suspect."""
    return ~(F.upper(value).rlike("[A-Z]") & value.rlike("[0-9]"))


def validated(found: DataFrame, warning: float = WARNING_BELOW, error: float = ERROR_BELOW) -> DataFrame:
    """All rules over fields (page_id, occurrence, key, value, confidence): status added. Values of other fields of the page come from one
    window over page_id (JN17): the last occurrence of a key counts (T23)."""
    page = Window.partitionBy("page_id").orderBy("occurrence").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def of(key: str) -> Column:
        return F.last(F.when(F.col("key") == key, F.col("value")), ignorenulls=True).over(page)

    year = F.coalesce(dates.year_of(of("session")), dates.year_of(of("date_concours")))
    out = found.withColumn("_series", of("serie")).withColumn("_identifier", of("identifiant")).withColumn("_year", year)
    return mismatch_flagged(_judged(out, warning, error)).drop("_series", "_identifier", "_year")


def in_context(found: DataFrame, warning: float = WARNING_BELOW, error: float = ERROR_BELOW) -> DataFrame:
    """validated() without windows, for fields that bring what their rules look at on their page: the last _series and _identifier (fields serie, identifiant,
    anonyme), _session and _exam (date_naissance), and _earlier, all identifiers before the last one (serie, identifiant)."""
    year = F.coalesce(dates.year_of(F.col("_session")), dates.year_of(F.col("_exam")))
    out = _judged(found.withColumn("_year", year), warning, error)
    own = identifier_mismatch(F.col("_identifier"), F.col("_series"))
    earlier = F.col("_earlier").isNotNull() & F.exists("_earlier", lambda v: identifier_mismatch(v, F.col("_series")))
    wrong = F.col("key").isin("serie", "identifiant") & (F.coalesce(own, F.lit(False)) | F.coalesce(earlier, F.lit(False)))
    return out.withColumn("status", F.when(wrong, "error").otherwise(F.col("status"))).drop("_series", "_identifier", "_session", "_exam", "_earlier", "_year")


def _judged(out: DataFrame, warning: float, error: float) -> DataFrame:
    """Each field's own rules: status of fields with _series, _identifier and _year of their page."""
    out = out.withColumn("_s", by_confidence(F.col("confidence"), warning, error))
    k, v, s = F.col("key"), F.col("value"), F.col("_s")

    def dated(year: Column | None) -> Column:  # the date is read once, not wherever the rule looks at it; and apart, for all the rules in one method are too long to be compiled
        return F.get(F.transform(F.array(dates.clean_date(v)), lambda d: date_message(v, year, d)), F.lit(0))

    out = out.withColumn("_message", F.when(k == "date_naissance", dated(F.col("_year"))).when(k == "date_concours", dated(None)))
    status = (
        F.when(k == "cin", F.when(cin_message(v).isNull(), s).otherwise("error"))
        .when(k.isin("date_naissance", "date_concours"), date_status(v, s, F.col("_message")))
        .when(k == "identifiant", identifier_status(v, F.col("_series"), s)).when(k == "nombre_cahiers", F.when(count_ok(v), s).otherwise("error"))
        .when(k == "serie", F.when(series_ok(v), s).otherwise("error")).when(k == "duree", duration_status(v, s))
        .when(k == "anonyme", F.when(anonymity_ok(v, F.col("_series"), F.col("_identifier")), s).otherwise("error"))
        .when(k.isin("nom", "prenom"), F.when(name_ok(v), s).otherwise("error"))
        .when(k == "etablissement", F.when(~school_ok(v) & (s == "valid"), "warning").otherwise(s))
        .otherwise(F.when(F.length(v) >= 2, s).otherwise("error"))
    )
    return out.withColumn("status", status).drop("_s", "_message")


def mismatch_flagged(found: DataFrame) -> DataFrame:
    """VAL12: where an identifier doesn't begin with the series, the series is an error too."""
    page = Window.partitionBy("page_id")
    wrong = F.max(F.when(F.col("key") == "identifiant", identifier_mismatch(F.col("value"), F.col("_series"))).otherwise(False)).over(page)
    return found.withColumn("status", F.when(wrong & F.col("key").isin("serie", "identifiant"), "error").otherwise(F.col("status")))


def signature_missing(found: DataFrame, ink: DataFrame, least: float = 0.004) -> DataFrame:
    """VAL13: pages (page_id, ink) whose signature zone is blank get an error field, in place of one that was read."""
    blank = ink.where(F.col("ink") < least).select("page_id")
    row = blank.select("page_id", F.lit(999).alias("occurrence"), F.lit("zone_signature").alias("key"), F.lit("").alias("value"), F.lit(0.0).alias("confidence"), F.lit("error").alias("status"))
    gone = blank.withColumn("key", F.lit("zone_signature"))
    kept = found.select(row.columns)
    had = kept.join(gone, ["page_id", "key"], "left_semi").withColumn("status", F.lit("error"))
    new = row.join(had.select("page_id"), "page_id", "left_anti")
    return kept.join(gone, ["page_id", "key"], "left_anti").select(row.columns).union(had.select(row.columns)).union(new)


def placeholders(found: DataFrame, pages: DataFrame, spark) -> DataFrame:
    """PRJ2: the template's fields of each page, read or with status empty; of others only an erroneous signature stays (T22)."""
    template = F.explode(F.array(*[F.lit(k) for k in fields.TEMPLATE])).alias("key")
    last = found.groupBy("page_id", "key").agg(F.max(F.struct("occurrence", "value", "confidence", "status")).alias("f"))
    rows = pages.select("page_id").distinct().select("page_id", template).join(last, ["page_id", "key"], "left")
    full = rows.select("page_id", "key", F.coalesce("f.value", F.lit("")).alias("value"), F.coalesce("f.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("f.status", F.lit("empty")).alias("status"))
    signature = last.where("key = 'zone_signature' and f.status = 'error'").select("page_id", "key", "f.value", "f.confidence", "f.status")
    return full.union(signature)


def form_summary(found: DataFrame, least: int = 2) -> DataFrame:
    """AGG5: is_form and the mean of positive confidences of each page."""
    mean = mean4(F.when(F.col("confidence") > 0, F.col("confidence")))
    return found.groupBy("page_id").agg((F.count("*") >= least).alias("is_form"), F.coalesce(mean, F.lit(0.0)).alias("global_confidence"))


def status_counts(found: DataFrame) -> DataFrame:
    """AGG16."""
    return found.groupBy("page_id").agg(
        F.count_if(F.col("status") == "error").alias("errors"), F.count_if(F.col("status") == "warning").alias("warnings"), F.count_if(F.col("status") != "empty").alias("detected")
    )


def by_section(found: DataFrame) -> DataFrame:
    """AGG17: keys of each section in the form's order."""
    keys = F.array_sort(F.collect_list(F.struct(fields.order_of(F.col("key")).alias("o"), "key")))
    return found.groupBy("page_id", fields.section_of(F.col("key")).alias("section")).agg(F.array_join(F.transform(keys, lambda x: x["key"]), ",").alias("field_keys"))
