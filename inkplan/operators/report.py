"""The report: one wide row a page, page acceptance and key figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, text

ACCEPT = 0.85
# Columns of the report and the labels that fill them.
COLUMNS = {
    "nom": "Nom", "name": "Nom", "lastname": "Nom", "prenom": "Prénom", "firstname": "Prénom", "cin": "CIN", "identifiant": "Identifiant", "id": "Identifiant",
    "identifier": "Identifiant", "no_dossier": "Identifiant", "serie": "Série", "date_naissance": "Date & Lieu de Naissance", "lieu_naissance": "Date & Lieu de Naissance",
    "naissance": "Date & Lieu de Naissance", "etablissement": "Établissement d'origine", "ecole": "Établissement d'origine", "etab": "Établissement d'origine", "epreuve": "Épreuve",
    "concours": "Concours", "date_concours": "Date Concours", "duree": "Durée", "nombre_cahiers": "Nombre de Cahiers", "cahiers": "Nombre de Cahiers",
}
#: Columns whose own heading is no label, so that the strict mode leaves them blank (T19).
NEVER_FILLED = ["Date & Lieu de Naissance", "Établissement d'origine", "Date Concours", "Nombre de Cahiers"]
HEADINGS = list(dict.fromkeys(COLUMNS.values()))
#: The data columns in the order of the sheet, the verdicts, and the fills of accepted pages, others and barcodes.
SHOWN = [
    "Nom", "Prénom", "CIN", "Identifiant", "Série", "Date & Lieu de Naissance", "Établissement d'origine", "Épreuve", "Concours", "Date Concours", "Durée",
    "Nombre de Cahiers",
]
ACCEPTED, REVIEW = "Validé (Auto)", "À réviser"
GOOD, BAD, MARKED = "FFEB9C", "FFC7CE", "C6EFCE"


def column_of(label: Column) -> Column:
    """TXT11."""
    return F.try_element_at(F.create_map(*[F.lit(x) for p in COLUMNS.items() for x in p]), text.strip_accents(F.lower(F.trim(label))))


def wide(found: DataFrame, strict: bool = False) -> DataFrame:
    """AGG8, ARR1: fields (page_id, occurrence, label, text) as one row a page; different texts of a column in order, joined by a comma.
    The pivot's values are fixed, so it is one pass of conditional aggregates."""
    named = found.withColumn("column", column_of(F.col("label"))).where(F.col("column").isNotNull() & (F.trim("text") != ""))

    def cell(heading: str) -> Column:
        if strict and heading in NEVER_FILLED:
            return F.lit("").alias(heading)
        some = F.array_sort(F.collect_list(F.when(F.col("column") == heading, F.struct("occurrence", F.trim("text").alias("t")))))
        return F.array_join(F.array_distinct(F.transform(some, lambda s: s["t"])), ", ").alias(heading)

    return named.groupBy("page_id").agg(*[cell(h) for h in HEADINGS])


def barcode_summary(barcodes: Column) -> Column:
    """AGG10: "data (type)" of the non-empty ones."""
    some = F.filter(barcodes, lambda b: F.trim(F.coalesce(b["data"], F.lit(""))) != "")
    shown = F.transform(some, lambda b: F.concat(F.trim(b["data"]), F.when(F.coalesce(b["type"], F.lit("")) != "", F.concat(F.lit(" ("), b["type"], F.lit(")"))).otherwise("")))
    return F.array_join(shown, " | ")


def page_violations(confidence: Column, cin: Column, payload: Column, barcodes: Column) -> Column:
    """VAL14: what keeps a page from being accepted."""
    return F.array_compact(F.array(
        F.when(confidence < ACCEPT, "confidence"), F.when((cin != "") & ~cin.rlike("^[A-Za-z0-9]{4,}$"), "cin"), F.when((payload == "") & (barcodes == ""), "empty"),
    ))


def key_figures(pages: DataFrame) -> DataFrame:
    """AGG9: over pages (file_id, confidence, accepted, barcodes)."""
    share = lambda c: F.coalesce(c * 100.0 / F.count("*"), F.lit(0.0))
    with_barcode = F.count_distinct(F.when(F.col("barcodes") != "", F.col("file_id")))
    return pages.agg(
        F.count_distinct("file_id").alias("files"), F.count("*").alias("pages"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("to_review"),
        F.round(share(F.count_if("accepted")), 4).alias("acceptance_pct"), F.round(F.coalesce(F.avg(geometry.clamp(F.col("confidence"))) * 100.0, F.lit(0.0)), 4).alias("mean_pct"),
        with_barcode.alias("files_with_barcode"),
    )


def bucket(confidence: Column) -> Column:
    """PRJ5: the colour of a box."""
    return F.when(confidence >= 0.85, "green").when(confidence >= 0.60, "orange").otherwise("red")


def gauge(percent: Column) -> Column:
    """PRJ5: the colour of a gauge."""
    return F.when(percent >= 70, "green").when(percent >= 50, "orange").otherwise("red")


def fill(status: Column, barcode: Column) -> Column:
    """SNK3."""
    return F.when(barcode != "", MARKED).when(status == "accepted", GOOD).otherwise(BAD)


def report_rows(pages: DataFrame, found: DataFrame, stamp: str, strict: bool = False) -> DataFrame:
    """SNK1, SNK3: the report's 18 columns for each page (page_id, file_name, page, confidence, text, barcodes), with `fill` and `marked`, how a sheet
    shows the verdict and the barcodes. A page without fields still has its row."""
    cells = wide(found, strict)
    rows = pages.join(cells, "page_id", "left")
    cell = {h: F.coalesce(F.col(f"`{h}`"), F.lit("")) for h in HEADINGS}
    codes = barcode_summary(F.col("barcodes"))
    payload = F.concat_ws("", *[cell[h] for h in ("Nom", "Prénom", "CIN", "Identifiant")], F.trim(F.coalesce("text", F.lit(""))))
    wrong = page_violations(F.col("confidence"), cell["CIN"], payload, codes)
    accepted = F.size(wrong) == 0
    return rows.select(
        "page_id", F.col("file_name").alias("Nom du Fichier"), F.when(F.col("page") > 0, F.col("page")).otherwise(1).alias("N° Page"), codes.alias("Code-Barres / QR"),
        *[cell[h].alias(h) for h in SHOWN], geometry.clamp(F.col("confidence")).alias("Indice de Confiance Global (%)"),
        F.when(accepted, ACCEPTED).otherwise(REVIEW).alias("Statut Validation"), F.lit(stamp).alias("Date Traitement"),
        F.when(accepted, GOOD).otherwise(BAD).alias("fill"), (codes != "").alias("marked"),
    )


def job_report(files: DataFrame, pages: DataFrame, found: DataFrame, overrides: DataFrame, stamp: str) -> DataFrame:
    """SNK4: report_rows() of a job's finished files (file_id, file_name, status, confidence), their pages (page_id, file_id, page, text) with the file's
    confidence, and their fields (page_id, occurrence, label, text), where an edited text takes a read one's place and fields that were only edited are
    added."""
    done = files.where("status = 'done'").select("file_id", "file_name", "confidence")
    some = pages.join(done, "file_id").withColumn("barcodes", F.array().cast("array<struct<data:string,type:string>>"))
    edits = overrides.where(F.trim("value") != "").select("page_id", F.col("key").alias("label"), F.col("value").alias("edited"))
    merged = found.join(edits, ["page_id", "label"], "full")
    merged = merged.select("page_id", F.coalesce("occurrence", F.lit(999)).alias("occurrence"), "label", F.coalesce("edited", "text").alias("text"))
    return report_rows(some, merged, stamp)
