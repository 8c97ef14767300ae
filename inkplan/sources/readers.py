"""Sources: files of images, OCR items as JSON, registries, settings and models."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.decode import Decoder
from ..operators.batches import upload_error
from ..schemas import ITEM
from .images import split as split_file

PREFIX = "INKPLAN_"


@dataclass
class Settings:
    """SRC13: settings with their least and greatest values; from_env() reads PREFIX + name."""

    max_file_mb: int = field(default=25, metadata={"range": (1, 1024)})
    max_files: int = field(default=10_000, metadata={"range": (1, 100_000)})
    render_dpi: int = field(default=160, metadata={"range": (72, 600)})
    warning_below: float = field(default=0.85, metadata={"range": (0.0, 1.0)})
    error_below: float = field(default=0.65, metadata={"range": (0.0, 1.0)})
    recognizer_timeout_s: float = field(default=120.0, metadata={"range": (1.0, 3600.0)})

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> "Settings":
        env, out = os.environ if env is None else env, cls()
        for f in fields(cls):
            low, high = f.metadata["range"]
            try:
                value = type(f.default)(env[PREFIX + f.name.upper()])
            except (KeyError, ValueError):
                continue
            setattr(out, f.name, min(high, max(low, value)))
        return out


def files(spark: SparkSession, path: str, settings: Settings = Settings()) -> DataFrame:
    """SRC1, SRC2: path, name, size, content of each file under a folder, with an error where it isn't taken. The content of files that
    are too large isn't read into later stages. Spark's source doesn't list files of no bytes; batches.split_uploads() rejects those of a file list."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    error = upload_error(name, F.col("length"), settings.max_file_mb << 20)
    return raw.select("path", name.alias("name"), F.col("length").alias("size"), error.alias("error"), F.when(error.isNull(), F.col("content")).alias("content"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """SRC3: images as Spark's own struct of BGR bytes."""
    return spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")


def pages(df: DataFrame, split=split_file) -> DataFrame:
    """SRC4, SRC5, SRC6: one row for each page of a file (name, content). split(content, name) yields (page, BGR array); that of this library reads PNG
    and TIFF files, for PDF files one is passed in. A file that can't be read gives one row with an error."""
    import pyarrow as pa

    schema = pa.schema([("name", pa.string()), ("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary()), ("error", pa.string())])

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0), b.column(1)):
                name = name.as_py()
                try:
                    for k, image in split(content.as_py(), name):  # each page goes out before the next is read
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (name, k, image.shape[1], image.shape[0], image.tobytes(), None)))], schema=schema)
                except Exception as e:  # an unreadable file is data, not a failed task
                    yield pa.RecordBatch.from_pylist([{"name": name, "error": f"{type(e).__name__}: {e}"[:300]}], schema=schema)

    return df.select("name", "content").mapInArrow(run, "name string, page int, width int, height int, pixels binary, error string")


def item_json(df: DataFrame, column: str) -> DataFrame:
    """SRC7: items of a JSON column that holds an array of items or an object with `items`; (its other columns, item_idx, text, ...)."""
    array = F.from_json(F.col(column), f"array<{ITEM.simpleString()}>")
    nested = F.from_json(F.col(column), f"items array<{ITEM.simpleString()}>")["items"]
    found = F.when(F.ltrim(F.col(column)).startswith("["), array).otherwise(nested)
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.posexplode(found).alias("item_idx", "item")).select(*rest, "item_idx", "item.*")


def rois(column: Column) -> Column:
    """SRC11: map<name, four fractions> from JSON; entries that haven't four numbers are left out."""
    parsed = F.from_json(column, "map<string,array<double>>")
    return F.map_filter(parsed, lambda k, v: (F.size(v) == 4) & ~F.exists(v, lambda x: x.isNull()))


def registry(spark: SparkSession, path: str | None = None, jdbc: dict | None = None) -> DataFrame:
    """SRC9: candidates from Parquet or a database; filters and columns are pushed down to either."""
    return spark.read.format("jdbc").options(**jdbc).load() if jdbc else spark.read.parquet(path)


def decoder(folders: list[str]) -> Decoder:
    """SRC10, JSN3: the first valid char_lm*.json of the folders, else the built-in tables; on the driver, once."""
    for folder in folders:
        names = sorted(n for n in (os.listdir(folder) if os.path.isdir(folder) else []) if n.startswith("char_lm") and n.endswith(".json"))
        for name in names:
            try:
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    model = json.load(f)
                pairs = {k: float(v) for k, v in model.get("bigram", {}).items() if len(k) == 2}
                confusions = {kind: {k: list(v) for k, v in t.items()} for kind, t in model.get("confusions", {}).items()}
                return Decoder(pairs=pairs or None, confusions=confusions, letters={k: float(v) for k, v in model.get("unigram", {}).items()})
            except (OSError, ValueError, AttributeError, TypeError):
                continue
    return Decoder()


def demo_items(spark: SparkSession) -> DataFrame:
    """SRC8: a form of label and value rows on a 60-pixel grid."""
    rows = [
        ("Concours", "Physique"), ("Épreuve de", "Chimie"), ("Date", "03/06/2024"), ("Durée", "2h30"), ("Nom", "Trabelsi"), ("Prénom", "Sonia"), ("Date de naissance", "04/12/2003"),
        ("Établissement", "IPEIN"), ("N° CIN", "09728320"), ("Série", "5401"), ("Identifiant", "540117"),
    ]
    items = [t for k, (label, value) in enumerate(rows) for t in ((2 * k, label, 0.97, 50, 300, 60 + 60 * k), (2 * k + 1, value, 0.96, 320, 560, 60 + 60 * k))]
    df = spark.createDataFrame(items, "item_idx int, text string, confidence double, x0 int, x1 int, y0 int")
    return df.selectExpr("cast(1 as bigint) page_id", "item_idx", "text", "confidence", "array(array(x0, y0), array(x1, y0), array(x1, y0 + 34), array(x0, y0 + 34)) box")
