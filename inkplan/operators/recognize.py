"""Recognition as a plug-in: a class path made once in a process beside each worker, errors and time limits as columns, fallbacks in order. No models
are included."""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import prepare, raster, supervise


class Recognizer(Protocol):
    """UDF1, UDF2: reads crops; a batch at a time, so that a model can use its own batching (O2)."""

    def read(self, crops: list[bytes]) -> list[tuple[str, float]]: ...


class Stub:
    """A deterministic recognizer for tests: the text is the crop's bytes. It fails on one text, hangs on another and ends its process on a third."""

    def __init__(self, confidence: float = 0.9, fail_on: str = "\0", delay_s: float = 0.0, hang_on: str = "\0", die_on: str = "\0", up: bool = True):
        self.confidence, self.fail_on, self.delay_s, self.hang_on, self.die_on, self.up = confidence, fail_on, delay_s, hang_on, die_on, up

    def available(self) -> bool:
        return self.up

    def read(self, crops: list[bytes]) -> list[tuple[str, float]]:
        time.sleep(self.delay_s * len(crops))
        texts = [c.decode("utf-8", "replace") for c in crops]
        if any(self.hang_on in t for t in texts):
            time.sleep(3600)
        if any(self.die_on in t for t in texts):
            raise SystemExit
        if any(self.fail_on in t for t in texts):
            raise ValueError("unreadable crop")
        return [(t, self.confidence) for t in texts]


def recognized(df: DataFrame, path: str, options: dict | None = None, size: int = 32, timeout_s: float = 120.0) -> DataFrame:
    """REC1-REC5, REC10: (id, crop) to (id, text, confidence, error, source). Crops are read in batches; a batch that fails is halved until the bad
    crops stand alone, and one that hangs is ended with its process after timeout_s, so each bad crop costs only itself."""
    return cascade(df, [(path, options or {})], 0.0, size, timeout_s, any_text=True)


#: Batches that a task takes in at once, so that later stages have enough crops for batches of their own.
ROUND = 8


def cascade(df: DataFrame, stages: list[tuple[str, dict]], least: float = 0.5, size: int = 32, timeout_s: float = 120.0, any_text: bool = False) -> DataFrame:
    """REC7, REC12, REC13, REC14: (id, crop) to (id, text, confidence, error, source), in one pass over the crops. Each stage only sees those that the ones
    before left without a sure text (any_text: with an error), so a crop is read once by each stage at most, but for halved batches. What no stage
    read keeps the last reading or error. A stage that isn't available leaves all to the next. Null and empty crops go to the recognizers as empty."""
    fixed = [(path, tuple(sorted(options.items())), path.rsplit(".", 1)[-1]) for path, options in stages]

    def sure(reading: tuple) -> bool:
        text, confidence, error = reading
        return error is None and (any_text or bool((text or "").strip()) and confidence >= least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, ROUND * size):
                part = b.slice(start, ROUND * size)
                crops, rows = [c or b"" for c in part.column(1).to_pylist()], [(None, 0.0, None, None)] * part.num_rows
                left = list(range(part.num_rows))
                for path, options, name in fixed:
                    child = supervise.child(path, options)
                    for k in range(0, len(left), size):
                        some = left[k : k + size]
                        for i, r in zip(some, supervise.settled(child, [crops[i] for i in some], timeout_s)):
                            rows[i] = (*r, name)
                    left = [i for i in left if not sure(rows[i][:3])]
                columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.float64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["id", "text", "confidence", "error", "source"])

    rows = df.select(F.col("id").cast("long").alias("id"), F.col("crop").cast("binary").alias("crop"))
    return rows.mapInArrow(run, "id long, text string, confidence double, error string, source string")


def handwritten_kept(printed: DataFrame, handwritten: DataFrame) -> DataFrame:
    """REC8: a handwritten reading replaces a printed one if it has two letters and is half sure."""
    h = handwritten.select("id", F.col("text").alias("h"), F.col("confidence").alias("hc"))
    better = (F.length(F.regexp_replace(F.coalesce("h", F.lit("")), "[^A-Za-zÀ-ÖØ-öø-ÿ]", "")) >= 2) & (F.col("hc") >= 0.5)
    out = printed.join(h, "id", "left")
    return out.select("id", F.when(better, F.col("h")).otherwise(F.col("text")).alias("text"), F.when(better, F.col("hc")).otherwise(F.col("confidence")).alias("confidence"))


def digit(cell, classify, read=None) -> tuple[str, float] | None:
    """REC4: (digit, confidence) of a cell by a classifier of tensors, which gives ten weights; without one, the first digit that a reader finds."""
    if classify is not None:
        p = raster.softmax(np.asarray(classify(raster.tensor(cell)), float))
        return str(int(p.argmax())), float(p.max())
    for text, sure in read(cell) if read else ():
        if found := "".join(c for c in text if c.isdigit()):
            return found[0], float(sure)
    return None


def greedy_decode(step, start: int, stop: int, most: int) -> tuple[list[int], float]:
    """REC3: the tokens of a sequence model, the likeliest each time, until `stop` or `most` of them, and their mean probability. step(token, cache)
    gives (weights of all tokens, cache); what it keeps in the cache spares it the tokens before."""
    token, cache, out, sure = start, None, [], []
    while len(out) < most:
        weights, cache = step(token, cache)
        p = raster.softmax(np.asarray(weights, float))
        token = int(p.argmax())
        if token == stop:
            break
        out.append(token)
        sure.append(float(p[token]))
    return out, float(np.mean(sure)) if sure else 0.0


def zones(image: np.ndarray, read_row, classify=None, read_cell=None) -> list[dict]:
    """REC6: a form zone by zone: digit grids cell by cell, then the dotted rows that no grid takes up, each as {text, confidence, box, label}.
    read_row gives [(text, confidence)] for a list of crops. A row without a value is read again from its tight crop, unless its label says that the
    value stands elsewhere."""
    out, grids = [], raster.digit_grids(image)
    for g in grids:
        read = [(d, c) for c in g["cells"] if (d := digit(image[c[1] : c[3], c[0] : c[2]], classify, read_cell))]
        if read:
            x0, y0, x1, y1 = (f(c[k] for _, c in read) for k, f in enumerate((min, min, max, max)))
            sure = round(sum(d[1] for d, _ in read) / len(read), 4)
            out.append({"text": "".join(d[0] for d, _ in read), "confidence": sure, "box": [[x0, y0], [x1, y0], [x1, y1], [x0, y1]], "label": g["key"]})
    inside = lambda y0, y1: any(y1 >= min(c[1] for c in g["cells"]) - 48 and y0 <= max(c[3] for c in g["cells"]) + 48 for g in grids)
    rows = [b for b in raster.ink_rows(image) if not inside(b[0], b[1])]
    crops = [prepare.row_crop(image, b[0], b[1], max(6, round(0.02 * image.shape[0]))) for b in rows]
    for (y0, y1, *_), crop, (text, sure) in zip(rows, crops, read_row(crops) if crops else []):
        if not re.search(r"\w", re.split("[:：]", text)[-1]):
            again = read_row([prepare.ink_crop(crop)])[0]
            text, sure = again if len(again[0]) > len(text) else (text, sure)
        w = crop.shape[1]
        out.append({"text": text, "confidence": sure, "box": [[0, y0], [w, y0], [w, y1], [0, y1]], "label": None})
    return out


def in_rois(image: np.ndarray, rois: dict[str, tuple[float, float, float, float]], read) -> list[dict]:
    """REC11: what read(crop) finds in each named part of a page (fractions), with the label and with boxes moved to the page."""
    h, w = image.shape[:2]
    out = []
    for label, (a, b, c, d) in rois.items():
        x0, y0 = max(0, min(int(a * w), w - 1)), max(0, min(int(b * h), h - 1))
        x1, y1 = max(x0 + 1, min(int(c * w), w)), max(y0 + 1, min(int(d * h), h))
        whole = [[0, 0], [x1 - x0, 0], [x1 - x0, y1 - y0], [0, y1 - y0]]
        for found in read(image[y0:y1, x0:x1]):
            out.append(found | {"label": label, "box": [[x0 + x, y0 + y] for x, y in found.get("box") or whole]})
    return out


def one(spark, crop: bytes, path: str, options: dict | None = None) -> tuple[str | None, float]:
    """REC16: a single image through the same plan as many."""
    r = recognized(spark.createDataFrame([(0, bytearray(crop))], "id long, crop binary"), path, options).first()
    return r.text, r.confidence


def health() -> dict:
    """APP2: what runs beside this process."""
    return {"status": "ok", "recognizers": supervise.running()}
