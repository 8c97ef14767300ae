"""SNK1, SNK2, SNK4: the report as workbooks that tasks write and one commit puts in place.

    spark.dataSource.register(ReportSink)
    rows.orderBy(...).write.format("inkplan_report").mode("append").option("path", folder).option("figures", json).save()

Each task writes workbooks of at most `rows` rows of its partition, in a folder of this job under the target, so a task holds the rows of one workbook
and nothing of other tasks. The driver gets their names and numbers of rows, moves them to report-<number>.xlsx in the order of partitions,
adds the key figures as a workbook of their own and, last, an index with all names. If the job or a task fails, its folder goes, and nothing is left.

Defined cases: a partition without rows writes nothing; no rows at all are an error, as in the export of a job without finished files; mode "append" adds
report numbers beyond those that are there.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators import report
from . import stores
from .workbook import Sheet, Style, workbook

ROWS = 100_000
HIDDEN = ("page_id", "fill", "marked")


@dataclass
class Written(WriterCommitMessage):
    part: int
    files: list[tuple[str, int]]


class ReportSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "inkplan_report"

    def writer(self, schema: StructType, overwrite: bool) -> "ReportWriter":
        return ReportWriter(schema, dict(self.options))


class ReportWriter(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict):
        self.names = [n for n in schema.names if n not in HIDDEN]
        self.path, self.rows = options["path"], int(options.get("rows", ROWS))
        self.figures, self.fail_at = options.get("figures"), options.get("fail_at")
        self.job = f"_job-{uuid.uuid4().hex}"

    def _folder(self) -> tuple[fs.FileSystem, str]:
        store, path = stores.opened(self.path)
        return store, path.rstrip("/")

    def write(self, rows: Iterator[Row]) -> Written:
        from .writers import shown_row  # writers imports this package's sheets too

        (store, path), part, out = self._folder(), TaskContext.get().partitionId(), []
        attempt, sheet = TaskContext.get().taskAttemptId(), []
        header = [(c, HEADER) for c in self.names]
        store.create_dir(f"{path}/{self.job}", recursive=True)

        def give() -> None:
            name = f"{part:06d}-{len(out):04d}-{attempt}.xlsx"
            with store.open_output_stream(f"{path}/{self.job}/{name}") as f:
                f.write(workbook([Sheet("Données Extraites", [header, *sheet], [18.0] * len(self.names), True)]))
            out.append((name, len(sheet)))
            sheet.clear()

        for r in rows:
            if self.fail_at is not None and str(r[0]) == self.fail_at:
                raise RuntimeError("stopped for a test")
            sheet.append(shown_row(r, self.names))
            if len(sheet) == self.rows:
                give()
        if sheet:
            give()
        return Written(part, out)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = self._folder()
        done = sorted((m.part, name, n) for m in messages if m for name, n in m.files)
        if not done:
            self.abort(messages)
            raise ValueError("no finished file to export")
        there = [f.base_name for f in store.get_file_info(fs.FileSelector(path)) if f.base_name.startswith("report-")]
        start = 1 + max((int(n[7:13]) for n in there), default=-1)
        index = []
        for k, (_, name, n) in enumerate(done):
            to = f"report-{start + k:06d}.xlsx"
            store.move(f"{path}/{self.job}/{name}", f"{path}/{to}")
            index.append({"file": to, "rows": n})
        if self.figures:
            with store.open_output_stream(f"{path}/figures-{start:06d}.xlsx") as f:
                f.write(workbook([Sheet("Rapport de Traitement", [[tuple_style(c) for c in line] for line in json.loads(self.figures)], [52.0, 16.0, 42.0])]))
        with store.open_output_stream(f"{path}/index-{start:06d}.json") as f:
            f.write(json.dumps(index).encode())
        store.delete_dir(f"{path}/{self.job}")

    def abort(self, messages: list[Written | None]) -> None:
        store, path = self._folder()
        if store.get_file_info(f"{path}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{path}/{self.job}")


HEADER = Style(fill="1F4E78", colour="FFFFFF", bold=True)


def tuple_style(cell):
    """A cell of the figures: a value, or [value, style's name]."""
    return (cell[0], HEADER if cell[1] == "header" else Style(fill="DDEBF7", bold=True)) if isinstance(cell, list) else cell


def write_report(rows: DataFrame, path: str, order: list[str], stamp: str, per_file: int = ROWS) -> None:
    """report_rows() as workbooks under path, in order, with the key figures. Nothing but these figures and the files' names reaches the driver."""
    from .writers import FIGURES

    rows.sparkSession.dataSource.register(ReportSink)
    pages = rows.select(
        F.col("Nom du Fichier").alias("file_id"), F.col("`Indice de Confiance Global (%)`").alias("confidence"), (F.col("Statut Validation") == report.ACCEPTED).alias("accepted"),
        F.col("Code-Barres / QR").alias("barcodes"),
    )
    found = report.key_figures(pages).first()
    value = lambda k: round(found[k], 1) if k.endswith("_pct") else found[k]
    head = [[c, "header"] for c in ("Indicateur", "Valeur", "Remarque")]
    lines = [head, *[[name, [value(k), "figure"], note] for k, name, note in FIGURES], ["Date de génération du rapport", stamp, None]]
    rows.orderBy(*order).write.format("inkplan_report").mode("append").option("path", path).option("rows", per_file).option("figures", json.dumps(lines)).save()


def sheet_text(content: bytes, number: int = 1) -> str:
    """A sheet's XML, for readers of what was written."""
    return zipfile.ZipFile(io.BytesIO(content)).read(f"xl/worksheets/sheet{number}.xml").decode()
