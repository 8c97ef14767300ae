"""Pages as a data source that splits files, and the report as a sink with one commit."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkplan.operators import prepare, report
from inkplan.sources import images, pagesource, reportsink


def tiff(pages: list[np.ndarray]) -> bytes:
    """Grey pages, uncompressed, each head before its pixels."""
    out = bytearray(b"II*\0" + struct.pack("<I", 8))
    for k, p in enumerate(pages):
        h, w = p.shape
        at = len(out)
        tags = [(256, 4, w), (257, 4, h), (258, 3, 8), (259, 3, 1), (262, 3, 1), (273, 4, at + 2 + 12 * 8 + 4), (277, 3, 1), (279, 4, w * h)]
        out += struct.pack("<H", len(tags))
        for tag, kind, value in tags:
            out += struct.pack("<HHI", tag, kind, 1) + struct.pack("<I", value)
        end = at + 2 + 12 * 8 + 4 + w * h
        out += struct.pack("<I", 0 if k == len(pages) - 1 else end) + p.tobytes()
    return bytes(out)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("scans")
    rng = np.random.default_rng(2)
    many = [np.full((60 + k % 3, 80), k % 251, np.uint8) for k in range(500)]
    (path / "many.tif").write_bytes(tiff(many))
    (path / "two.tiff").write_bytes(tiff([rng.integers(0, 255, (9, 7), np.uint8) for _ in range(2)]))
    (path / "one.png").write_bytes(prepare.png(rng.integers(0, 255, (5, 6, 3)).astype(np.uint8)))
    (path / "cut.tif").write_bytes(tiff(many[:3])[:-100])
    (path / "junk.tif").write_bytes(b"junk")
    (path / "empty.png").write_bytes(b"")
    return path


def read(spark, path, **options):
    spark.dataSource.register(pagesource.PageSource)
    return spark.read.format("inkplan_pages").options(path=str(path), split_bytes=200_000, pages=25, **options)


def test_a_large_file_is_read_by_several_tasks(spark, folder):
    df = read(spark, folder).load()
    rows = df.withColumn("part", F.spark_partition_id()).collect()
    many = {r.page: r for r in rows if r.name == "many.tif"}
    assert sorted(many) == list(range(500)) and len({r.part for r in many.values()}) == 20
    for k, image in enumerate(images.tiff((folder / "many.tif").read_bytes())):
        assert (many[k].height, many[k].width) == image.shape[:2] and bytes(many[k].pixels) == image.tobytes()
    small = [(r.name, r.page, r.width, r.error is None) for r in rows if r.name != "many.tif"]
    assert sorted(small, key=str) == sorted([("two.tiff", 0, 7, True), ("two.tiff", 1, 7, True), ("one.png", 0, 6, True), ("cut.tif", 0, 80, True), ("cut.tif", 1, 80, True), ("cut.tif", None, None, False), ("junk.tif", None, None, False), ("empty.png", None, None, False)], key=str)
    assert len({r.part for r in rows if r.name != "many.tif"}) == 1


def test_pages_without_pixels(spark, folder):
    rows = read(spark, folder / "m*.tif").schema("name string, page int, width int, height int, error string").load().collect()
    assert len(rows) == 500 and {(r.width, r.height) for r in rows} == {(80, 60), (80, 61), (80, 62)}


def test_a_task_holds_one_page(folder):
    reader = pagesource.PageReader(type("S", (), {"names": ["name", "page", "width", "height", "pixels", "error"]}), {"path": str(folder), "split_bytes": "200000", "pages": "25"})
    largest = []

    def watched(cut):
        def one(at, n):
            largest.append(n)
            return cut(at, n)

        return one

    before, pagesource.cut_of = pagesource.cut_of, lambda f, real=pagesource.cut_of: watched(real(f))
    try:
        parts = [p for p in reader.partitions() if p.pieces[0][0].endswith("many.tif")]
        assert max(largest) < 200  # the plan reads heads only
        assert [r[1] for r in reader.read(parts[3])] == list(range(75, 100)) and max(largest) == 62 * 80
    finally:
        pagesource.cut_of = before


def rows_of(spark, n: int):
    pages = spark.range(n).select(
        F.col("id").cast("int").alias("page_id"), F.format_string("f%05d.tif", F.col("id")).alias("file_name"), F.lit(1).alias("page"), (F.col("id") % 100 / 100.0).alias("confidence"),
        F.lit("t").alias("text"), F.expr("cast(array() as array<struct<data:string,type:string>>)").alias("barcodes"),
    )
    fields = spark.createDataFrame([(0, 0, "Nom", "Eya")], "page_id int, occurrence int, label string, text string")
    return report.report_rows(pages, fields, "01/01/2026 10:00")


def test_report_of_many_pages(spark, tmp_path):
    path = tmp_path / "r"
    reportsink.write_report(rows_of(spark, 4000), str(path), ["page_id"], "01/01/2026 10:00", per_file=700)
    index = json.loads((path / "index-000000.json").read_text())
    assert sum(f["rows"] for f in index) == 4000 and all(f["rows"] <= 700 for f in index)
    assert sorted(p.name for p in path.iterdir()) == sorted(["figures-000000.xlsx", "index-000000.json", *(f["file"] for f in index)])
    seen = []
    for f in index:
        xml = reportsink.sheet_text((path / f["file"]).read_bytes())
        assert xml.count("<row ") == f["rows"] + 1
        seen += [int(x[:5]) for x in xml.split(">f")[1:]]
    assert seen == list(range(4000))
    assert "<v>4000</v>" in reportsink.sheet_text((path / "figures-000000.xlsx").read_bytes())
    reportsink.write_report(rows_of(spark, 10), str(path), ["page_id"], "01/01/2026 10:00")
    last = f"{len(index):06d}"
    assert json.loads((path / f"index-{last}.json").read_text())[0]["file"] == f"report-{last}.xlsx"


def test_a_failed_report_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(reportsink.ReportSink)
    path = tmp_path / "r"
    write = lambda df, **o: df.orderBy("page_id").write.format("inkplan_report").mode("append").options(path=str(path), rows=50, **o).save()
    with pytest.raises(Exception, match="stopped for a test"):
        write(rows_of(spark, 400), fail_at="390")
    assert not path.exists() or list(path.iterdir()) == []
    with pytest.raises(Exception, match="no finished file"):
        write(rows_of(spark, 5).where("page_id < 0"))
    assert not path.exists() or list(path.iterdir()) == []
