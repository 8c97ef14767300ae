"""Golden cases of scalar functions."""

import itertools
import math
import random
import xml.dom.minidom
from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkplan.functions import dates, decode, geometry, security, text
from inkplan.operators import barcodes, fields, forms, prepare, raster, recognize, vision
from inkplan.sources import images, workbook


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()
    return row.x


@pytest.mark.parametrize("value, kind, want", [
    ("D1d1", "text", "Didi"), ("D0di", "text", "DOdi"), ("D1 d1", "text", "Di di"), ("Eya", "text", "Eya"), ("Tnus", "text", "Tnus"), ("Elloom", "text", "Elloom"),
    ("O92832O", "digit", "0928320"), ("04550842", "digit", "04550842"), ("", "text", ""), (None, "text", ""),
])
def test_decoder(value, kind, want):
    assert decode.DECODER.decode(value, kind)[0] == want


@given(st.text("0158&Oo@ZzSBaque", min_size=1, max_size=6), st.sampled_from(["text", "digit"]))
@settings(deadline=None)
def test_decoder_against_all_readings(word, kind):
    d = decode.DECODER
    table = d.alternatives[kind]
    options = [[c, *table.get(c, [])] for c in word]

    def score(chain) -> float:
        total = 0.0
        for k, c in enumerate(chain):
            n = len(options[k])
            total += math.log(0.99 if n == 1 else 0.1 if c == word[k] else 0.9 / (n - 1))
            if k:
                total += d.follows[d.number.get(chain[k - 1].lower(), 0), d.number.get(c.lower(), 0)]
        return total

    best = max(map(score, itertools.product(*options)))
    value = d.decode(word, kind)[0]
    if word[:1].isalnum():
        assert abs(score(value) - best) < 1e-9
    assert decode.Decoder(longest=3).decode(word, kind)[0] == d.decode(word[:3], kind)[0]


def test_decoder_prior():
    """Transitions worked out by hand. The alphabet has 52 plain letters, 31 with accents, apostrophe, blank, hyphen and ten digits: 96 halves are 48. The 29
    pairs add 58 letters, so all weigh 106. The norm is 1 and the 35 sequences."""
    for pair, letter, known in (("qu", 2.5, 1), ("th", 2.5, 1), ("zz", 0.5, 0), ("a1", 0.5, 0), ("n-", 0.5, 0), ("a ", 0.5, 0), ("lœ", 0.5, 0), ("ré", 0.5, 0), ("se", 9.5, 0), ("dÿ", 0.0, 0)):
        want = 0.5 * math.log((1.6 * letter / 106 + known + 1e-9) / (36 + 1e-9))
        d = decode.DECODER
        assert abs(d.follows[d.number[pair[0]], d.number.get(pair[1], 0)] - max(want, 0.5 * math.log(1e-9))) < 1e-9, pair
    assert abs(decode.DECODER.follows[decode.DECODER.number["q"], decode.DECODER.number["u"]] + 1.773239) < 1e-6


@pytest.mark.parametrize("value, want", [
    ("Ben Ali", 1.0), ("Jean-Paul", 1.0), ("O'Neil", 1.0), ("œuvre", 1.0), ("Œuvre", 0.8), ("12", 1.0), ("ÿa", 0.5), ("a#b", 0.6667), ("a  b", 0.941), ("a  b  c", 0.9052), ("a_b_c_d", 0.5714), ("", 0.0), (None, 0.0),
])
def test_decoder_confidence(value, want):
    """The share of known characters, times 0.85 + 0.15 exp(-n / 2) for n runs of blanks."""
    assert decode.Decoder(confusions={"none": {}}).decode(value, "none")[1] == want


@pytest.mark.parametrize("value, want", [
    ("2003-12-04", "04/12/2003"), ("05.12.2003", "05/12/2003"), ("nee le 04/12/1993 a Tnus", "04/12/1993"), ("Bo/09|&00.3", "08/09/2003"), ("31/02/2003", None), ("Lundi 03 Juin 2024 à 8 H", "03/06/2024"),
    ("Mardi 12 décembre 2023", "12/12/2023"), ("6.1.421.2003", "06/01/2003"), ("12/2003", None), ("", None), (None, None),
])
def test_best_date(value, want):
    assert (dates.best_date(value) or (None,))[0] == want


@pytest.mark.parametrize("value, want", [("O972832O", "09728320"), ("I972832O", "19728320"), ("0 9 7 28 320", "09728320"), ("aa09728320zz", "09728320"), ("0972832", None)])
def test_nearest_digits(spark, value, want):
    assert one(spark, text.nearest_digits(F.col("v"), 8, "01"), v=value) == want


def test_digit_windows():
    assert ("540017", 0) in decode.digit_windows("5140 5400 17", 6) and ("5140", 0) in decode.digit_windows("5140 5400 17", 4, 0)
    assert decode.digit_windows("abc", 3) == []


def test_digit_windows_as_an_expression(spark):
    rng = random.Random(3)
    some = ["", "abc", "5140 5400 17", "12345678", *("".join(rng.choice("0123456789  .-a") for _ in range(rng.randrange(40))) for _ in range(300))]
    df = spark.createDataFrame([(t,) for t in some], "t string")
    for length, slack in ((8, 1), (4, 0), (6, 1)):
        for r in df.select("t", decode.digit_windows_column(F.col("t"), length, slack).alias("w")).collect():
            assert [(w.window, w.penalty) for w in r.w] == decode.digit_windows(r.t, length, slack)


@given(st.text(max_size=20), st.text(max_size=20))
def test_ratio_is_the_standard_one(a, b):
    assert decode.ratio(a, b) == SequenceMatcher(None, a, b).ratio()


def test_nearest_school():
    assert decode.nearest("ENI7", fields.SCHOOLS, fields.SCHOOL_RATIO) == "ENIT" and decode.nearest("x", fields.SCHOOLS, 0.72) is None
    assert decode.nearest("QQQQQQ", fields.SCHOOLS, 0.72) is None


def test_tokenizer():
    t = decode.UnigramTokenizer({"▁ab": -1.0, "▁": -3.0, "a": -3.0, "b": -3.0, "c": -3.0})
    assert t.pieces("abc ab") == ["▁ab", "c", "▁ab"] and t.decode(t.encode("abc ab")) == "abc ab"


@pytest.mark.parametrize("value, want", [("N° C.I.N :", "n c i n"), ("Série", "serie"), ("Date & lieu", "date et lieu"), ("  ", "")])
def test_keyword(spark, value, want):
    assert one(spark, text.keyword(F.col("v")), v=value) == want


@pytest.mark.parametrize("value, want", [("n cin", "cin"), ("date et lieu de naissance x", "date_concours"), ("cinq", None), ("serie du sujet 3", "serie"), ("nom x", None)])
def test_label(spark, value, want):
    assert one(spark, fields.label_key(F.col("v")), v=value) == want


def test_longest_label(spark):
    df = spark.createDataFrame([("date et lieu de naissance x",), ("nothing",)], "norm string")
    assert [r.key for r in fields.longest_label(df, "norm").collect()] == ["date_naissance", None]


@pytest.mark.parametrize("value, want", [("Nom :", True), ("N0m8re de", True), ("二", True), ("Didi", False)])
def test_noise(spark, value, want):
    assert one(spark, text.is_noise(F.col("v")), v=value) is want


def test_small_functions(spark):
    assert one(spark, text.tidy_name(F.col("v")), v="amira   ben-salah.") == "Amira Ben Salah"
    assert one(spark, text.tidy_acronym(F.col("v")), v="f.s.t") == "FST"
    assert one(spark, text.safe_token(F.col("v")), v="é/") == "INCONNU"
    assert one(spark, text.last_place(F.col("v")), v="née à tunis") == "Tunis"
    assert one(spark, text.folded(F.col("v")), v=" Béji  Ali ") == "BEJI ALI"
    assert one(spark, text.has_value(F.col("v")), v="Nom : é") and not one(spark, text.has_value(F.col("v")), v="Nom : ..")
    assert [one(spark, dates.session_year_ok(F.col("v")), v=v) for v in ("2024/2025", "2024-2025", "2025", "2017/2025")] == [True, True, True, False]
    assert one(spark, geometry.rect(F.array(F.array(F.lit(3), F.lit(4)), F.array(F.lit(1), F.lit(9)))), v=1) == (1.0, 4.0, 3.0, 9.0)
    assert one(spark, geometry.rect(F.array().cast("array<array<int>>")), v=1) == (0.0, 0.0, 0.0, 0.0)
    assert one(spark, text.has_parasite(F.col("v")), v="1234a") and not one(spark, text.has_parasite(F.col("v")), v="Didi")


def test_encryption(spark):
    salt = b"s" * 16
    key = security.derived_key("secret", salt, 1000)
    df = spark.createDataFrame([(bytearray(b"abc"),)], "v binary").select(security.encrypted(F.col("v"), key, salt).alias("e"))
    assert df.select(security.decrypted(F.col("e"), key).alias("d")).first().d == b"abc"
    assert df.select(security.decrypted(F.col("e"), security.derived_key("x", salt, 1000)).alias("d")).first().d is None


def test_raster():
    page = np.full((200, 300, 3), 255, np.uint8)
    assert raster.dark_ratio(page) == 0 and raster.ink_rows(page) == [] and raster.text_lines(page) == []
    page[50:70, 20:280] = 0
    assert raster.ink_rows(page) == [(50, 70, 20, 280)] and raster.text_lines(page) == [(50, 70)]
    assert set(np.unique(raster.binarised(page))) == {0, 255} and raster.resized(page, 150).shape == (100, 150, 3)
    assert abs(int(raster.resized(page, 150).mean()) - int(page.mean())) <= 1
    form = np.full((200, 900), 255, np.uint8)
    for k in range(3):
        x = 50 + 110 * k
        form[40:42, x : x + 100] = form[138:140, x : x + 100] = 0
        form[40:140, x : x + 2] = form[40:140, x + 98 : x + 100] = 0
    grids = raster.digit_grids(form)
    assert [g["key"] for g in grids] == ["serie"] and raster.has_form_structure(form)
    out, tops = raster.stacked([page, page[:40]])
    assert tops == [0, 248] and out.shape == (288, 300, 3)
    assert raster.signature_ink(page, (60, 10, 120, 30)) > 0.1 and raster.signature_ink(page, (0, 195, 20, 199)) is None
    assert raster.tensor(page).shape == (28, 28) and abs(raster.softmax(np.array([1.0, 2.0])).sum() - 1) < 1e-9
    assert raster.bgr(np.zeros((4, 4), np.uint16)).shape == (4, 4, 3)


def test_workbook():
    import io
    import zipfile

    bold = workbook.Style(fill="FFEB9C", bold=True, form="0.0%")
    data = workbook.workbook([workbook.Sheet("One & two", [["a", "b"], [("<x>", bold), 1.5]], [10.0, 20.0], True), workbook.Sheet("Three")])
    z = zipfile.ZipFile(io.BytesIO(data))
    first, styles = z.read("xl/worksheets/sheet1.xml").decode(), z.read("xl/styles.xml").decode()
    assert "&lt;x&gt;" in first and 's="1"' in first and 'ref="A1:B2"' in first and 'width="20.0"' in first and "FFFFEB9C" in styles and "0.0%" in styles
    assert "One &amp; two" in z.read("xl/workbook.xml").decode() and "xl/worksheets/sheet2.xml" in z.namelist()
    for name in z.namelist():
        xml.dom.minidom.parseString(z.read(name))
    assert [workbook.letters(k) for k in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_exports():
    import io
    import zipfile

    text = "Nom : Béji\n(x) \\ <y> " + "long " * 60
    z = zipfile.ZipFile(io.BytesIO(workbook.exported(text, "docx")))
    assert z.read("word/document.xml").decode().count("<w:p>") == 2
    pdf = workbook.exported(text + "\n" * 200 + "end", "pdf")
    at = int(pdf.rsplit(b"startxref\n", 1)[1].split(b"\n")[0])
    assert pdf[at : at + 4] == b"xref" and pdf.count(b"/Type /Page ") == 4 and b"B\xe9ji" in pdf and rb"\(x\) \\" in pdf
    for k, entry in enumerate(pdf[at:].split(b"\n")[3 : 3 + pdf.count(b" obj\n")], 1):
        assert pdf[int(entry[:10]) :].startswith(b"%d 0 obj" % k)
    assert workbook.exported(text, "txt") == text.encode()
    for bad in ((" ", "txt"), ("x", "rtf")):
        with pytest.raises(ValueError):
            workbook.exported(*bad)


def test_passwords_and_tokens():
    digest = security.password_hash("secret", b"0" * 16)
    assert security.password_ok("secret", digest) and not security.password_ok("other", digest) and not security.password_ok("secret", "md5$x")
    t = security.token("key", "me", "here", "there", 10, now=1000, roles=["a"])
    assert security.claims_of("key", t, "here", "there", now=1001)["roles"] == ["a"]
    for bad in (("other", t, "here", "there", 1001), ("key", t, "x", "there", 1001), ("key", t, "here", "x", 1001), ("key", t, "here", "there", 1600), ("key", t, "here", "there", 999), ("key", t[:-3] + "abc", "here", "there", 1001)):
        with pytest.raises(ValueError):
            security.claims_of(*bad[:4], now=bad[4])


def lines(h=300, w=500, step=30):
    page = np.full((h, w, 3), 255, np.uint8)
    for y in range(40, h - 40, step):
        page[y : y + 6, 60 : w - 60] = 0
    return page


@pytest.mark.parametrize("angle", [-12.0, -3.0, 0.0, 2.0, 8.0])
def test_deskew(angle):
    """A turned page is turned back; an upright one stays as it is."""
    page = prepare.rotated(lines(), angle)
    upright, found = prepare.deskewed(page)
    assert abs(found + angle) <= 0.5
    assert abs(prepare.slant(upright)) <= 0.5


def test_preparation():
    rng = np.random.default_rng(0)
    page = lines()
    noisy = page.copy()
    noisy[rng.integers(0, 300, 300), rng.integers(0, 500, 300)] = 0
    assert (prepare.denoised(noisy) != page).mean() < (noisy != page).mean() / 3
    pale = np.repeat(rng.integers(200, 221, (300, 500, 1), dtype=np.uint8), 3, 2)
    strong, weak = (np.std(raster.grey(prepare.equalised(pale, clip))) for clip in (3.0, 1.0))
    assert strong > 2 * np.std(raster.grey(pale)) and strong > 1.5 * weak
    stained = np.clip(page.astype(int) // 4 + np.linspace(60, 180, 500).astype(int)[None, :, None], 0, 255).astype(np.uint8)
    ink = raster.grey(page) == 0
    found = raster.grey(prepare.handwriting(stained))
    assert set(np.unique(found)) <= {0, 255}
    local = prepare.thresholded(stained, 41)
    assert (local[ink] == 0).mean() > 0.95
    out, done = prepare.prepared(page, longest=250, noise=True)
    assert max(out.shape[:2]) <= 260 and done["scale"] == 0.5 and done["deskew_angle"] == 0.0 and done["size"] == (500, 300)


def test_crops():
    page = np.full((200, 400, 3), 255, np.uint8)
    page[100:104, 150:350:12] = 0
    page[100:104, 151:350:12] = page[100:104, 152:350:12] = page[100:104, 153:350:12] = 0
    page[60:95, 200:320] = 0  # writing, larger than a dot
    mask = prepare.dots(page)
    assert mask.shape == (200, 400) and mask[101, 151] and not mask[70, 250]
    value = prepare.value_crop(page, 60, 104, 150, 6)
    assert value.shape == (56, 240, 3) and (raster.grey(value)[:45] < 128).any() and not (raster.grey(value)[46:49] < 128).any()
    assert prepare.label_crop(page, 100, 104, 150, 6).shape == (16, 170, 3) and prepare.ink_crop(page, 2).shape == (48, 200, 3)
    head = prepare.png(page)
    import struct
    import zlib

    assert head[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", head[16:24]) == (400, 200)
    body = zlib.decompress(head[head.index(b"IDAT") + 4 : head.index(b"IEND") - 8])
    assert np.array_equal(np.frombuffer(body, np.uint8).reshape(200, -1)[:, 1:].reshape(page.shape)[:, :, ::-1], page)
    assert prepare.preview(page, 100).startswith("data:image/png;base64,")


def test_detections():
    box = np.array([[[1, 2, 3, 4]]])
    assert vision.detections((True, ["a", ""], ["QR"], box)) == (["a"], ["QR"], [(1, 2, 3, 4)])
    assert vision.detections(("a", np.array(["QR"]), np.array([[1.9, 2, 3, 4, 5]]))) == (["a"], ["QR"], [(1, 2, 3, 4)])
    assert vision.detections(None) == vision.detections((True,)) == ([], [], []) and vision.detections((None, None)) == ([], [], [])


def test_zones_and_rois():
    form = np.full((400, 900, 3), 255, np.uint8)
    for x in (100, 200, 300):  # three cells of a series
        form[40:42, x : x + 100] = form[138:140, x : x + 100] = 0
        form[40:140, x : x + 2] = form[40:140, x + 98 : x + 100] = 0
    form[300:306, 50:700] = 0
    digits = iter("531")
    seen = []

    def rows(crops):
        seen.append(len(crops))
        return [("Nom :" if len(seen) == 1 else "Nom : Eya", 0.9)] * len(crops)

    got = recognize.zones(form, rows, read_cell=lambda c: [(next(digits) + "x", 0.8)])
    assert got[0] == {"text": "531", "confidence": 0.8, "box": got[0]["box"], "label": "serie"}
    assert [g["text"] for g in got[1:]] == ["Nom : Eya"] and seen == [1, 1]
    assert recognize.digit(form[42:138, 104:196], lambda t: np.eye(10)[7] * 9)[0] == "7" and recognize.digit(form, None) is None
    at = recognize.in_rois(form, {"nom": (0.1, 0.25, 0.5, 0.5)}, lambda crop: [{"text": str(crop.shape)}, {"text": "b", "box": [[1, 2]]}])
    assert at[0]["text"] == "(100, 360, 3)" and at[0]["box"][0] == [90, 100] and at[1]["box"] == [[91, 102]] and at[1]["label"] == "nom"


def test_names_harvested():
    entry = lambda k, text, conf, x, key=None: {"idx": k, "raw": text, "clean": text, "conf": conf, "box": None, "key": key, "noise": False, "inline": None, "rect": (x, 100, x + 50, 130)}
    entries = [entry(0, "Nom", 0.97, 0, "nom"), entry(1, "Far Away", 0.96, 900), entry(2, "Near", 0.96, 100), entry(3, "Sure", 0.94, 60), entry(4, "lower", 0.99, 60)]
    found = [["nom", "", 0.3, None]]
    free = {e["idx"]: e for e in entries[1:]}
    forms.names_harvested(found, entries, free)
    assert found[-1] == ["nom", "Near", 0.96, None] and 2 not in free
    same = [["nom", "Read", 0.3, None]]
    forms.names_harvested(same, entries, dict(free))
    assert len(same) == 1


def test_unreadable_dates_whole_table(spark, sf_dir):
    """noisy_dates against the values that were made unreadable: what is found is the day written there, or nothing."""
    from inkplan.plans import catalogue, fixtures

    written = {r.id: r.value for r in fixtures.fixture(spark, sf_dir, fixtures.WRITTEN).collect()}
    month = {"Janvier": 1, "février": 2, "Août": 8, "décembre": 12}
    right = wrong = 0
    for r in catalogue.noisy_dates(spark, sf_dir).collect():
        v = written[r.id]
        y, m, d = v.split("-") if "-" in v else reversed(v.split("/")) if "/" in v else (v.split()[3], month[v.split()[2]], v.split()[1])
        if r.value is None:
            continue
        right, wrong = (right + 1, wrong) if r.value == f"{int(d):02d}/{int(m):02d}/{y}" else (right, wrong + 1)
    assert right > 0.5 * len(written) and wrong < 0.2 * len(written)


def tiff_file(pages: list[dict], order: str = "<") -> bytes:
    """A TIFF of one strip a page: dicts of tag to values, with the strip's bytes under 0."""
    import struct

    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + b"\0\0\0\0")
    link = 4
    for page in pages:
        at = len(out)
        out += page[0]
        tags = {k: v for k, v in page.items() if k} | {273: [at], 279: [len(page[0])]}
        places = {}
        for tag, values in tags.items():
            if len(values) > 1:
                places[tag] = len(out)
                out += struct.pack(f"{order}{len(values)}I", *values)
        out[link : link + 4] = struct.pack(order + "I", len(out))
        out += struct.pack(order + "H", len(tags))
        for tag, values in sorted(tags.items()):
            out += struct.pack(order + "HHII", tag, 4, len(values), places.get(tag, values[0]))
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_pages(order):
    import zlib

    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    grey = image[:, :, 0]
    bits = grey > 127
    packed = b"".join(bytes([len(r) - 1]) + r.tobytes() for r in grey)
    wide = (grey.astype(np.uint16) << 8 | 7).astype(f"{order}u2")
    steps = np.diff(grey, axis=1, prepend=np.zeros((5, 1), np.uint8))
    palette = rng.integers(0, 65536, (3, 256))
    cmyk = np.concatenate([255 - image, np.zeros((5, 7, 1), np.uint8)], 2)
    size = {256: [7], 257: [5]}
    pages = [
        {0: image.tobytes(), 258: [8, 8, 8], 262: [2], 277: [3], 259: [1], **size}, {0: zlib.compress(steps.tobytes()), 258: [8], 262: [1], 259: [8], 317: [2], **size},
        {0: packed, 258: [8], 262: [0], 259: [32773], **size}, {0: np.packbits(bits, axis=1).tobytes(), 258: [1], 262: [1], **size}, {0: wide.tobytes(), 258: [16], 262: [1], **size},
        {0: grey.tobytes(), 258: [8], 262: [3], 320: palette.ravel().tolist(), **size}, {0: cmyk.tobytes(), 258: [8, 8, 8, 8], 262: [5], 277: [4], **size},
    ]
    got = [i for _, i in images.split(tiff_file(pages, order), "a.tif")]
    three = lambda g: np.repeat(g[:, :, None], 3, 2)
    want = [image[:, :, ::-1], three(grey), three(255 - grey), three(bits * np.uint8(255)), three(grey), (palette >> 8).astype(np.uint8)[::-1, grey].transpose(1, 2, 0), image[:, :, ::-1]]
    assert len(got) == len(want) and all(np.array_equal(a, b) for a, b in zip(got, want))
    with pytest.raises(ValueError):
        list(images.split(tiff_file([{0: b"x", 258: [8], 262: [1], 259: [4], **size}]), "g4.tif"))


def lzw(data: bytes) -> bytes:
    table, code, out, bits, width = {bytes([k]): k for k in range(256)}, b"", "", 258, 9
    out += f"{256:09b}"
    for b in data:
        b = bytes([b])
        if code + b in table:
            code += b
            continue
        out += f"{table[code]:0{width}b}"
        table[code + b] = bits
        bits += 1
        width = 9 if bits < 512 else 10 if bits < 1024 else 11 if bits < 2048 else 12
        code = b
    out += f"{table[code]:0{width}b}"
    width = 9 if bits + 1 < 512 else 10 if bits + 1 < 1024 else 11
    out += f"{257:0{width}b}"
    return int(out.ljust(-(-len(out) // 8) * 8, "0"), 2).to_bytes(-(-len(out) // 8), "big")


def test_lzw():
    for data in (b"aaaaaaaabbbbbb", bytes(range(256)) * 2, b"abc" * 300):
        assert images.unpacked_lzw(lzw(data)) == data


def test_png_filters():
    import struct
    import zlib

    rng = np.random.default_rng(2)
    image = np.cumsum(rng.integers(0, 9, (6, 9, 3), dtype=np.uint8), axis=1, dtype=np.uint8)
    assert np.array_equal(images.png(prepare.png(image)), image)
    rgb = image[:, :, ::-1].reshape(6, -1).astype(int)
    rows, above = b"", np.zeros(27, int)
    for y, line in enumerate(rgb):
        left = np.concatenate([np.zeros(3, int), line[:-3]])
        corner = np.concatenate([np.zeros(3, int), above[:-3]])
        p = left + above - corner
        choice = np.stack([left, above, corner])
        paeth = np.take_along_axis(choice, np.abs(choice - p).argmin(0)[None], 0)[0]
        near = [0 * line, left, above, (left + above) // 2, paeth, 0 * line][y % 6]
        rows += bytes([y % 5 if y < 5 else 0]) + ((line - near) % 256).astype(np.uint8).tobytes()
        above = line
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + b"0000"
    file = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 9, 6, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows))
    assert np.array_equal(images.png(file), image)


def bars(digits: str, unit: int = 2) -> np.ndarray:
    """A code as an image, built from the digits' definition: seven modules each."""
    half = 6 if len(digits) == 13 else 4
    body = digits[1:] if half == 6 else digits
    which = barcodes.MIRRORED[int(digits[0])] if half == 6 else "0000"

    def modules(d: str, mirrored: bool, dark_first: bool) -> str:
        widths = [int(c) for c in barcodes.WIDTHS[int(d)]]
        return "".join(str(int((k % 2 == 0) == dark_first)) * w for k, w in enumerate(widths[::-1] if mirrored else widths))

    bits = "101" + "".join(modules(d, m == "1", False) for d, m in zip(body, which)) + "01010" + "".join(modules(d, False, True) for d in body[half:]) + "101"
    row = np.repeat([0 if b == "1" else 255 for b in bits], unit).astype(np.uint8)
    page = np.full((120, len(row) + 80, 3), 255, np.uint8)
    page[30:90, 40 : 40 + len(row)] = row[None, :, None]
    return page


@pytest.mark.parametrize("digits, kind", [("4006381333931", "EAN_13"), ("9780201379624", "EAN_13"), ("96385074", "EAN_8"), ("0036000291452", "UPC_A")])
@pytest.mark.parametrize("unit", [2, 3])
def test_barcodes(digits, kind, unit):
    page = bars(digits, unit)
    rng = np.random.default_rng(0)
    noisy = np.clip(page.astype(int) + rng.integers(-40, 40, page.shape), 0, 255).astype(np.uint8)
    for image in (page, noisy):
        [(found, what, (x0, y0, x1, y1))] = barcodes.scan(image)
        assert (found, what) == (digits[1:] if kind == "UPC_A" else digits, kind)
        assert x0 == 40 and 28 <= y0 <= 34 and x1 == page.shape[1] - 40
    assert barcodes.scan(barcodes.masked(page, [(x0, y0, x1, y1 + 3)])) == [] and barcodes.scan(page, budget_s=0.0) in ([], barcodes.scan(page))
    assert barcodes.scan(lines()) == [] and not barcodes.check_ok("4006381333932")
