"""What is found on pages by windows and joins, against the same by arrays of a whole page."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkplan.functions import decode
from inkplan.operators import layout, prepare, raster


def drawn(seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    image = np.full((160, 240, 3), 255, np.uint8)
    for _ in range(rng.integers(0, 9)):
        y, x = rng.integers(0, 150), rng.integers(0, 150)
        image[y : y + rng.integers(1, 14), x : x + rng.integers(5, 200)] = rng.integers(0, 140)
    image[rng.random(image.shape[:2]) < 0.002] = 0
    return image


def form() -> np.ndarray:
    image = np.full((300, 700, 3), 255, np.uint8)
    for k in range(6):
        x = 20 + 100 * k
        image[40:140, x : x + 100] = 0
        image[44:136, x + 4 : x + 96] = 255
    return image


@pytest.fixture(scope="module")
def images():
    return {("a.tif", k): drawn(k) for k in range(12)} | {("b.tif", 0): form(), ("b.tif", 1): np.full((20, 30, 3), 255, np.uint8), ("b.tif", 2): np.zeros((12, 9, 3), np.uint8)}


@pytest.fixture(scope="module")
def pages(spark, images):
    rows = [(n, p, i.shape[1], i.shape[0], bytearray(i.tobytes())) for (n, p), i in images.items()] + [("c.tif", 0, None, None, None), ("c.tif", 1, 10, 10, bytearray(b"xyz"))]
    return spark.createDataFrame(rows, "name string, page int, width int, height int, pixels binary").repartition(3).cache()


def grouped(df, *columns):
    out = {}
    for r in df.orderBy(*layout.PAGE, columns[0]).collect():
        out.setdefault((r.name, r.page), []).append(tuple(r[c] for c in columns))
    return out


def test_bands_lines_and_ratios(pages, images):
    runs = layout.runs(pages).cache()
    some = lambda f: {k: v for k, i in images.items() if (v := [tuple(x) for x in f(i)])}
    for options in ({}, {"least": 0.3, "gap": 0, "extent": 0.6}, {"least": 0.02, "gap": 12}):
        assert grouped(layout.ink_bands(runs, **options), "y0", "y1", "x0", "x1") == some(lambda i, o=options: raster.ink_rows(i, **o))
    for options in ({}, {"least": 1, "most": 2}):
        assert grouped(layout.text_lines(runs, **options), "y0", "y1") == some(lambda i, o=options: raster.text_lines(i, **o))
    got = {(r.name, r.page): (r.ratio, r.kept) for r in layout.inked(pages).collect()}
    assert {k: v for k, v in got.items() if k[0] != "c.tif"} == {k: (pytest.approx(raster.dark_ratio(i)), raster.dark_ratio(i) >= raster.LEAST_INK) for k, i in images.items()}
    assert not got["c.tif", 0][1] and not got["c.tif", 1][1]


def test_thresholds_grids_and_structure(pages, images):
    assert {(r.name, r.page): r.threshold for r in layout.otsu(pages).collect()} == {k: raster.otsu(raster.grey(i)) for k, i in images.items()}
    cells = grouped(layout.digit_grids(pages), "pos", "key", "x0", "y0", "x1", "y1")
    assert list(cells) == [("b.tif", 0)] and [c[2:] for c in cells["b.tif", 0]] == [tuple(c) for c in raster.digit_grids(form())[0]["cells"]]
    got = {(r.name, r.page): r.is_form for r in layout.form_structure(pages).collect()}
    assert {k: v for k, v in got.items() if k[0] != "c.tif"} == {k: raster.has_form_structure(i) for k, i in images.items()} and not got["c.tif", 0]


def test_prepared_pages_and_crops(spark, pages, images):
    rows = {(r.name, r.page): r for r in layout.prepared(pages, upright=False).collect()}
    assert {k for k, r in rows.items() if r.error} == {("c.tif", 0), ("c.tif", 1)}
    want, _ = prepare.prepared(images["a.tif", 3], upright=False)
    r = rows["a.tif", 3]
    assert (r.height, r.width) == want.shape[:2] and bytes(r.pixels) == want.tobytes() and r.what
    boxes = spark.createDataFrame([("a.tif", 0, 1, 10, 20, 30, 50), ("a.tif", 0, 2, -5, 150, 400, 170), ("a.tif", 0, 3, 30, 30, 30, 40), ("c.tif", 0, 1, 0, 0, 5, 5)], "name string, page int, box int, x0 int, y0 int, x1 int, y1 int")
    got = {r.box: (r.width, r.height, bytes(r.pixels)) for r in layout.crops(pages, boxes).collect()}
    image = images["a.tif", 0]
    assert got == {1: (20, 30, image[20:50, 10:30].tobytes()), 2: (240, 10, image[150:].tobytes())}
    assert layout.codes(pages).count() == 0


def test_digit_of_weights(spark):
    rows = [[0.1 * k for k in range(10)], [5.0] + [1.0] * 9, [-1e6, 1e6] + [0.0] * 8, [2.0, 2.0] + [0.0] * 8]
    got = spark.createDataFrame([(r,) for r in rows] + [([],), (None,)], "w array<double>").select(layout.digit_of(F.col("w")).alias("d")).collect()
    for r, g in zip(rows, got):
        p = raster.softmax(np.array(r))
        assert g.d.digit == str(int(p.argmax())) and g.d.confidence == pytest.approx(float(p.max()))
    assert got[4].d is None and got[5].d is None


def test_unigram_pieces(spark):
    rng = np.random.default_rng(4)
    for _ in range(3):
        scores = {"▁": -3.0, "a": -2.5, "b": -2.0, **{"".join(rng.choice(list("ab▁"), rng.integers(2, 5))): -float(rng.integers(1, 9)) for _ in range(12)}}
        texts = ["".join(rng.choice(list("abc "), rng.integers(0, 12))) for _ in range(25)] + ["", " ", None]
        vocabulary = spark.createDataFrame(list(scores.items()), "piece string, score double")
        got = {r.text: r.pieces for r in layout.pieces(spark.createDataFrame([(t,) for t in texts], "text string"), vocabulary).collect()}
        tokenizer = decode.UnigramTokenizer(scores)
        assert got == {t: tokenizer.pieces(t) for t in texts if t is not None}
