"""Sinks: text, JSON and workbooks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import report
from ..operators.prepare import png
from ..operators.raster import resized
from .workbook import MOST_ROWS, Sheet, Style, exported, workbook


def write_text(df: DataFrame, column: str, path: str) -> None:
    """SNK5: one text a row, in parallel files; blank texts are an error."""
    if df.where(F.trim(F.coalesce(column, F.lit(""))) != "").limit(1).count() == 0:
        raise ValueError("nothing to export")
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_pages_json(df: DataFrame, path: str) -> None:
    """SNK10: all but the pixels."""
    df.drop("pixels", "image").write.mode("overwrite").json(path)


def write_report(wide: DataFrame, path: str) -> None:
    """SNK1 at scale: the report's rows as CSV by partition; a workbook is for one screen of them."""
    wide.write.mode("overwrite").option("header", True).csv(path)


HEADER = Style(fill="1F4E78", colour="FFFFFF", bold=True)
FIGURE = Style(fill="DDEBF7", bold=True)
VERDICT = {report.GOOD: "9C6500", report.BAD: "9C0006"}
#: The key figures' names and remarks on the second sheet.
FIGURES = [
    ("files", "Nombre total de fichiers traités (TIF/PDF/Images)", None),
    ("pages", "Nombre total de pages analysées", None),
    ("acceptance_pct", "Taux d'acceptation automatique (%)", "Confiance >= 85 % et règles métier respectées"),
    ("to_review", "Nombre de documents nécessitant révision", "Révision manuelle requise"),
    ("mean_pct", "Confiance moyenne globale (%)", None),
    ("files_with_barcode", "Fichiers avec code-barres détecté", "Données fiables à 100 %"),
]


def shown_row(r, names: list[str]) -> list:
    """A report row's cells, with the verdict's fill."""
    verdict = Style(fill=r["fill"], colour=VERDICT[r["fill"]], bold=True)
    style = {"Statut Validation": verdict, "Indice de Confiance Global (%)": Style(r["fill"], VERDICT[r["fill"]], True, "0.0%")}
    if r["marked"]:
        style["Code-Barres / QR"] = Style(fill=report.MARKED, colour="006100", bold=True)
    return [(r[c], style.get(c, Style())) for c in names]


def report_workbook(rows: DataFrame, order: list[str], stamp: str) -> bytes:
    """SNK1, SNK2, SNK3: report_rows() as .xlsx: a sheet of pages with the verdicts' fills, and one of key figures. A sheet holds a bounded
    number of rows; more are an error, and reportsink.write_report() is for them."""
    some = rows.orderBy(*order).limit(MOST_ROWS).collect()
    if not some:
        raise ValueError("no finished file to export")
    if len(some) == MOST_ROWS:
        raise ValueError("more pages than a sheet holds; use reportsink.write_report()")
    names = [c for c in rows.columns if c not in ("page_id", "fill", "marked")]

    def wide(v) -> float:
        return 0.0 if v is None else max(8.0, min(52.0, 2.0 + sum(1.0 if ord(c) < 128 else 1.7 for c in str(v))))

    widths = [min(60.0, 2.0 + max(wide(c), *(wide(r[c]) for r in some))) for c in names]
    data = Sheet("Données Extraites", [[(c, HEADER) for c in names], *[shown_row(r, names) for r in some]], widths, True)
    pages = rows.select(
        F.col("Nom du Fichier").alias("file_id"), F.col("`Indice de Confiance Global (%)`").alias("confidence"), (F.col("Statut Validation") == report.ACCEPTED).alias("accepted"),
        F.col("Code-Barres / QR").alias("barcodes"),
    )
    found = report.key_figures(pages).first()
    value = lambda k: round(found[k], 1) if k.endswith("_pct") else found[k]
    lines = [[("Indicateur", HEADER), ("Valeur", HEADER), ("Remarque", HEADER)], *[[name, (value(k), FIGURE), note] for k, name, note in FIGURES], ["Date de génération du rapport", (stamp, Style(bold=True)), None]]
    return workbook([data, Sheet("Rapport de Traitement", lines, [52.0, 16.0, 42.0])])


def write_previews(pages: DataFrame, path: str, longest: int = 1000) -> None:
    """SNK9: pages (name, page, width, height, pixels) as scaled-down PNG files in a column, by name and page; pages that have one are left as they are."""

    @F.pandas_udf("binary")
    def small(pixels: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        return pd.Series([png(resized(np.frombuffer(p, np.uint8).reshape(int(h), int(w), -1), longest)) for p, w, h in zip(pixels, width, height)])

    spark = pages.sparkSession
    some = pages.where("pixels is not null").dropDuplicates(["name", "page"])
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        some = some.join(spark.read.parquet(path).select("name", "page"), ["name", "page"], "left_anti")
    some.select("name", "page", small("pixels", "width", "height").alias("preview")).write.mode("append").parquet(path)


def write_exports(df: DataFrame, column: str, form: str, path: str) -> None:
    """SNK5: each row's text as a file of the form, in a column `file`, as Parquet: what a download serves by its key."""
    make = F.udf(lambda t: bytearray(exported(t, form)) if t and t.strip() else None, "binary", useArrow=True)
    df.withColumn("file", make(F.col(column))).write.mode("overwrite").parquet(path)


def write_archive(df: DataFrame, path: str) -> None:
    """SNK7: documents under their year."""
    df.write.mode("append").partitionBy("year").parquet(path)
