"""Verification of extracted identities against a registry of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, decode, text

WEIGHTS = {"cin": 40, "nom": 30, "prenom": 20, "session_year": 10}
MOST_BY_NAME = 20
#: The forms of numbers on a form.
CIN, IDENTIFIER, BARCODE = "^[0-9]{8}$", "^(?:[0-9]{4}-[0-9]{3,6}|[0-9]{4,8})$", "^[A-Z0-9]{6,20}$"


def format_rules(cin: Column, session_year: Column, identifier: Column, barcode: Column) -> Column:
    """VAL15: array<struct<name, value, matched, message>> of the fields that are there."""

    def rule(name: str, value: Column, ok: Column, message: str) -> Column:
        row = F.struct(F.lit(name).alias("name"), value.alias("value"), ok.alias("matched"), F.when(ok, "").otherwise(message).alias("message"))
        return F.when(value.isNotNull(), row)

    return F.array_compact(F.array(
        rule("cin", cin, F.trim(cin).rlike(CIN), "CIN: eight digits"), rule("session_year", session_year, dates.session_year_ok(session_year), "session year: 2024/2025"),
        rule("identifiant", identifier, F.trim(identifier).rlike(IDENTIFIER), "identifier: 2024-0001"), rule("barcode", barcode, F.trim(barcode).rlike(BARCODE), "barcode: 6 to 20 characters"),
    ))


def violations(rules: Column) -> Column:
    """AGG11."""
    return F.transform(F.filter(rules, lambda r: ~r["matched"]), lambda r: r["message"])


def blocked(identities: DataFrame, registry: DataFrame) -> DataFrame:
    """JN10: identities (id, cin, nom, prenom, session_year) with their candidates: by CIN where there is one, else by name as written in capitals
    (accents count, T10), the first MOST_BY_NAME by CIN. The registry's rows are numbered within each name, and within each name and first name, before
    they meet anyone, so a frequent name brings MOST_BY_NAME rows to each identity and no more. Three equality joins."""
    names = ("cin", "nom", "prenom", "session_year")
    up = lambda n: F.upper(F.trim(F.coalesce(n, F.lit(""))))
    c = registry.select(*[F.col(n).alias(f"c_{n}") for n in names])
    given = F.trim(F.coalesce("cin", F.lit("")))
    by_cin = identities.where(given != "").join(c, given == F.col("c_cin"))
    named = identities.where((given == "") & (up("nom") != ""))

    def first(*by: str) -> DataFrame:
        keyed = c.select("*", *[up(f"c_{n}").alias(f"_{n}") for n in by])
        rank = F.row_number().over(Window.partitionBy(*[f"_{n}" for n in by]).orderBy("c_cin"))
        return keyed.where("_nom <> ''").withColumn("_rank", rank).where(F.col("_rank") <= MOST_BY_NAME).drop("_rank")

    by_name = named.where(up("prenom") == "").join(first("nom"), up("nom") == F.col("_nom")).drop("_nom")
    both = named.where(up("prenom") != "").join(first("nom", "prenom"), (up("nom") == F.col("_nom")) & (up("prenom") == F.col("_prenom"))).drop("_nom", "_prenom")
    return by_cin.unionByName(by_name).unionByName(both)


def scored(pairs: DataFrame, ratio=decode.ratio_column) -> DataFrame:
    """JN11: score of each pair; ratio(a, b) is the similarity of two folded names. Nearly equal names get the whole weight."""
    eq = lambda n: (text.folded(F.col(n)) != "") & (text.folded(F.col(n)) == text.folded(F.col(f"c_{n}")))

    def name(n: str) -> Column:
        like = ratio(text.folded(F.col(n)), text.folded(F.col(f"c_{n}")))
        part = F.when(like >= 0.9, float(WEIGHTS[n])).otherwise(F.round(WEIGHTS[n] * like, 1))
        return F.when(text.folded(F.col(n)) == "", 0.0).otherwise(part)

    sums = [F.when(eq(n), float(WEIGHTS[n])).otherwise(0.0) for n in ("cin", "session_year")] + [name(n) for n in ("nom", "prenom")]
    return pairs.withColumn("score", sums[0] + sums[2] + sums[3] + sums[1])


def equal_names(a: Column, b: Column) -> Column:
    """A similarity for registries whose names are clean: 1 or 0."""
    return F.when(a == b, 1.0).otherwise(0.0)


def match_status(score: Column, has_cin: Column, found: Column, accept: float = 85.0) -> Column:
    """VAL16: an unknown number is rejected at once; the accept threshold can only turn valid into review."""
    plain = F.when(score >= 85, F.when(score < accept, "review").otherwise("valid")).when(score >= 60, "review").otherwise("reject")
    return F.when(has_cin & ~found, "reject").otherwise(plain)


def verified(identities: DataFrame, registry: DataFrame, accept: float = 85.0, ratio=decode.ratio_column) -> DataFrame:
    """JN12: (id, match_score, status, matched_cin): the best candidate with a positive score, the least CIN of equals."""
    best = scored(blocked(identities, registry), ratio).where("score > 0").groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "c_cin")).alias("b"))
    out = identities.join(best, "id", "left")
    score, found = F.coalesce(-F.col("b.s"), F.lit(0.0)), F.col("b").isNotNull()
    has_cin = text.folded(F.col("cin")) != ""
    return out.select("id", F.round(score, 2).alias("match_score"), match_status(score, has_cin, found, accept).alias("status"), F.col("b.c_cin").alias("matched_cin"))
