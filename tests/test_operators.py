"""Golden and property tests of the form engine's operators."""

import io
import os
import random
import time
import zipfile
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkplan.operators import bands, batches, forms, matching, pairing, recognize, report, rules, store, supervise, vision
from inkplan.sources import readers, writers
from inkplan.streaming import jobs

ITEM = "page_id long, item_idx int, text string, confidence double, box array<array<int>>"


def box(x0, y0, x1, y1):
    return [[x0, y0], [x1, y0], [x1, y1], [x0, y1]]


def sheet(rows):
    out = []
    for k, (label, value) in enumerate(rows):
        out += [(label, 0.97, box(50, 100 + 60 * k, 260, 134 + 60 * k)), (value, 0.96, box(280, 100 + 60 * k, 520, 134 + 60 * k))]
    return out


def items(spark, *pages):
    return spark.createDataFrame([(p, k, *i) for p, page in enumerate(pages) for k, i in enumerate(page)], ITEM)


def found(spark, *pages):
    return {(r.page_id, r.key): r for r in forms.analysed(items(spark, *pages)).collect()}


def test_whole_sheet(spark):
    got = found(spark, sheet([
        ("Concours", "Physique"), ("Épreuve de", "Chimie"), ("Date", "03/06/2024"), ("Durée", "2h30"), ("Nom", "Trabelsi"), ("Prénom", "D1d1"), ("Date et lieu de naissance", "nee le 04/12/1993 a Tnus"),
        ("Établissement d'origine", "IPEIN"), ("N° CIN :", "O972832O"), ("Série", "5140"), ("Identifiant", "514 017"),
    ]), sheet([("Série", "5140"), ("Identifiant", "615001"), ("N° CIN", "K972832K")]))
    first = {k: r for (p, k), r in got.items() if p == 0}
    assert first["prenom"].value == "Didi" and first["prenom"].confidence >= 0.92 and first["prenom"].corrections.original == "D1d1"
    assert first["cin"].value == "09728320" and first["etablissement"].value == "IPEIN"
    assert first["date_concours"].value in ("03/06/2024", "04/12/1993 · Tnus")
    assert {k for k, r in first.items() if r.status == "error"} <= {"date_concours"}
    assert got[1, "serie"].status == got[1, "identifiant"].status == "error" and got[1, "cin"].status == "error"


def test_harvest_replaces_a_wrong_head(spark):
    page = [("N° CIN", 0.97, box(50, 100, 260, 134)), ("89728320", 0.9, box(280, 100, 520, 134)), ("09728320", 0.9, box(280, 500, 520, 534))]
    assert found(spark, page)[0, "cin"].value == "09728320"


def test_series_and_identifier_from_one_item(spark):
    page = [("Série", 0.97, box(50, 100, 260, 134)), ("Identifiant", 0.97, box(50, 700, 260, 734)), ("5140 5140 17", 0.9, box(900, 400, 1200, 434))]
    got = found(spark, page)
    assert got[0, "serie"].value == "5140" and got[0, "identifiant"].value == "514017"


def test_noise_gate(spark):
    page = [("Nom", 0.97, box(50, 100, 260, 134)), ("zzz", 0.4, box(280, 100, 400, 134)), ("Didi", 0.9, box(410, 100, 520, 134)), ("Prénom : Eya", 0.3, None)]
    got = found(spark, page)
    assert got[0, "nom"].value == "Didi" and got[0, "prenom"].value == "Eya"


def test_greedy_is_one_to_one_and_agrees_where_uncontested(spark):
    rng = random.Random(3)
    labels = ["Nom", "Prénom", "Série", "Identifiant", "Durée"]
    pages = []
    for _ in range(40):
        page = [(label, 0.97, box(50, y := rng.randrange(0, 900), 260, y + 34)) for label in rng.sample(labels, 3)]
        page += [(f"v{k}", 0.9, box(x := rng.randrange(200, 700), y := rng.randrange(0, 900), x + 100, y + 34)) for k in range(4)]
        pages.append(page)
    entries = pairing.normalised(items(spark, *pages)).cache()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)  # pages go over the ends of batches
    greedy = pairing.greedy_pages(entries).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plain = pairing.paired(entries).cache()
    contested = {r.page_id for r in pairing.contested_pages(plain).collect()}
    assert len({(r.page_id, r.value) for r in greedy}) == len(greedy)
    want = {(r.page_id, r.key, r.value) for r in greedy if r.page_id not in contested}
    assert want == {(r.page_id, r.key, r.raw) for r in plain.collect() if r.page_id not in contested}


def test_pages_analysed_together_as_alone(spark, monkeypatch):
    """Whole forms: many pages in one batch against each alone; readings are decoded by the batch, not one by one; items that share their number."""
    import pyarrow as pa

    rng = random.Random(5)
    pages = []
    for k in range(60):
        page = [(name, 0.97, box(50, y := 60 * rng.randrange(9), 260, y + 34)) for name in rng.sample(["N° CIN", "Série", "Identifiant", "Nom", "Prénom", "Durée : 2h30", "Établissement"], 5)]
        words = [f"O97{rng.randrange(10**5):05}", f"K9{rng.randrange(10**6):06}", "7777", "514", "514017", "514 514017", "D1d1", "Trabelsi", "ENI7", f"0{rng.randrange(10**7):07} x"]
        page += [(w, rng.choice([0.6, 0.9, 0.96]), box(x := rng.choice([280, 700]), y := 60 * rng.randrange(9), x + 200, y + 34)) for w in rng.sample(words, 6)]
        pages.append(page)
    table = pairing.flat(pairing.normalised(items(spark, *pages)).drop("box")).orderBy("page_id", "item_idx").toArrow()
    calls, decode_all = [], forms.decode.DECODER.decode_all
    monkeypatch.setattr(forms.decode.DECODER, "decode_all", lambda texts, kind="text": calls.append(len(texts)) or decode_all(texts, kind))
    rows = lambda t: list(zip(*(list(c.to_pylist() if isinstance(c, pa.Array) else c) for c in forms.page_fields(t.combine_chunks().to_batches()[0]).values())))
    together = rows(table)
    assert max(calls) > 20
    alone = [r for p in range(len(pages)) for r in rows(table.filter(pa.compute.equal(table["page_id"], p)))]
    assert together == alone and len({r[2] for r in together}) == 7 and any(r[5] for r in together)
    twice = items(spark, [("N° CIN", 0.97, box(50, 100, 260, 134)), ("09728320", 0.9, box(280, 100, 520, 134))])
    assert [r.value for r in forms.analysed(twice.union(twice)).collect()] == ["09728320"] * 2


def test_rules_of_whole_pages_need_no_windows(spark):
    """One shuffle and no window; each status is that of the rules with windows: pages with several series or identifiers, sessions, dates and schools."""
    rng = random.Random(11)
    names = ["N° CIN", "Série", "Série", "Identifiant", "Identifiant", "Nom", "Date de naissance", "Session", "Date", "Identifiant anonymat", "Établissement", "Durée : 2h30", "Session : 2019/2020", "Identifiant : 999017"]
    words = ["O9728320", "514", "614", "514017", "614017", "51", "20/03/2001", "20/03/2008", "31/02/2001", "2024/2025", "05/06/2026", "514514017", "ENI7", "D1d1", "Béji"]
    pages = []
    for _ in range(80):
        page = [(n, 0.97, box(50, 60 * k, 260, 60 * k + 34)) for k, n in enumerate(rng.sample(names, 7))]
        pages.append(page + [(rng.choice(words), rng.choice([0.6, 0.8, 0.96]), box(280, 60 * k, 520, 60 * k + 34)) for k in range(7)])
    found = forms.analysed(items(spark, *pages))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan
    rows = found.collect()
    assert len(rows) > 300 and {r.status for r in rows} == {"valid", "warning", "error"}
    again = rules.validated(spark.createDataFrame([r[:5] for r in rows], "page_id long, occurrence int, key string, value string, confidence double"))
    assert {(r.page_id, r.occurrence): r.status for r in again.collect()} == {(r.page_id, r.occurrence): r.status for r in rows}
    several = [p for p in {r.page_id for r in rows} if sum(r.page_id == p and r.key == "identifiant" for r in rows) > 1]
    assert len(several) > 5


def test_printed_blocks_of_a_batch_are_those_of_each_page(spark, monkeypatch):
    """Blanks of all kinds, blocks that are not sure, equally sure, or taken; readings that are plain digits are not corrected one by one."""
    texts = ["514 514017", "514\u00a0514017", "514\u2003|514017", "514\x85514017", "514514017", "x514./-514017y", "5145514017", "514 515017", "612 612017"]
    pages = [
        [("Série", 0.97, box(50, 160, 260, 194)), (s, 0.9, box(280, 160, 520, 194)), ("Identifiant", 0.97, box(50, 220, 260, 254)), ("777712", 0.9, box(280, 220, 520, 254))]
        + [(t, c, box(900, 20, 990, 54)), ("612 612019", d, box(900, 320, 990, 354))]
        for s in ("7777", "S14") for t in texts for c, d in ((0.9, 0.6), (0.6, 0.9), (0.7, 0.7))
    ]
    table = pairing.flat(pairing.normalised(items(spark, *pages)).drop("box")).orderBy("page_id", "item_idx").toArrow().combine_chunks().to_batches()[0]
    seen, corrected = set(), forms.corrected
    monkeypatch.setattr(forms, "corrected", lambda key, value, decoded: seen.add(value) or corrected(key, value, decoded))
    got = forms.page_fields(table)
    assert seen == {"S14"}
    clean, conf, page = table.column("clean").to_pylist(), table.column("confidence").to_pylist(), table.column("page_id").to_pylist()
    want = []
    for p in sorted(set(page)):
        at = [k for k, x in enumerate(page) if x == p]
        rows = [forms.built("serie", clean[at[1]], 0.9), forms.built("identifiant", clean[at[3]], 0.9)]
        forms.printed(rows, {k: {"idx": k, "clean": clean[k], "conf": conf[k], "key": None} for k in at[4:]})
        want += rows
    assert [list(r) for r in zip(*(got[c].to_pylist() for c in ("key", "value", "confidence", "original")))] == want
    assert {w[1] for w in want} == {"514", "514017", "612", "612017", "612019"}


def test_greedy_is_that_of_one_page_after_another(spark):
    """Many pages at once against a plain loop: contested values, equal gaps and texts, forms, labels with their value, pages over the ends of batches, and items that share
    their number."""
    import re

    from inkplan.operators import fields

    rng = random.Random(8)
    labels = ["Nom", "Prénom", "Série", "Durée", "Date", "Nom : Eya", "Série : 12", "Date :"]
    texts = ["123", "4567", "2h30", "x", "y", "03/06/2024", "nombre", "b", "b"]
    pages = []
    for _ in range(120):
        page = [(rng.choice(labels), 0.97, box(x := 50 + 110 * rng.randrange(3), y := 40 * rng.randrange(4), x + 100, y + 34)) for _ in range(rng.randrange(5))]
        page += [(rng.choice(texts), 0.9, box(x := 200 + 50 * rng.randrange(8), y := 40 * rng.randrange(9), x + 100, y + 34)) for _ in range(rng.randrange(7))]
        pages.append(rng.sample(page, len(page)))
    entries = pairing.normalised(items(spark, *pages)).cache()
    one_by_one = set()
    by_page = {}
    for r in pairing.flat(entries).orderBy("page_id", "item_idx").collect():
        by_page.setdefault(r.page_id, []).append(r)
    for p, rows in by_page.items():
        got = [(r.inline_key, r.inline_value) for r in rows if r.inline_key]
        free = [r for r in rows if not r.inline_key and not r.key and not r.noise]
        for e in [r for r in rows if r.key and not r.inline_key]:
            height, most = max(1.0, e.y1 - e.y0), 80 if e.key in ("nom", "prenom") else 300
            near = [(v.x0 - e.x1, v) for v in free if abs(v.y0 + v.y1 - e.y0 - e.y1) <= max(height, 8) and -2 <= v.x0 - e.x1 <= 400]
            near = near or [(v.y0 - e.y1, v) for v in free if 0 < v.y0 - e.y1 <= most and v.x1 >= e.x0 - 2 * height and v.x0 <= e.x1 + 2 * height]
            if near:
                form = fields.PATTERN[e.key]
                best = min(near, key=lambda g: (not (form and re.match(form, g[1].clean)), g[0], g[1].clean))[1]
                free.remove(best)
                got.append((e.key, best.raw))
        one_by_one |= {(p, k, *g) for k, g in enumerate(got)}
    for size in (7, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = pairing.greedy_pages(entries).collect()
        assert len(got) == len(one_by_one) and {(r.page_id, r.occurrence, r.key, r.value) for r in got} == one_by_one
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    twice = items(spark, [("Nom", 0.97, box(50, 100, 260, 134)), ("Eya", 0.9, box(280, 100, 520, 134))])
    got = pairing.greedy_pages(pairing.normalised(twice.union(twice))).collect()
    assert [(r.occurrence, r.key, r.value) for r in got] == [(0, "nom", "Eya"), (1, "nom", "Eya")] and list(map(list, got[0].box)) == box(280, 100, 520, 134)


@pytest.mark.parametrize("confidence, want", [(0.60, "error"), (0.649, "error"), (0.65, "warning"), (0.849, "warning"), (0.85, "valid")])
def test_thresholds(spark, confidence, want):
    assert spark.range(1).select(rules.by_confidence(F.lit(confidence)).alias("s")).first().s == want


def test_rules(spark):
    cases = [("serie", "531", "valid"), ("serie", "54", "error"), ("serie", "54AB", "error"), ("nombre_cahiers", "1", "valid"), ("nombre_cahiers", "7", "error"), ("nombre_cahiers", "un", "error"),
             ("duree", "2h30", "valid"), ("duree", "4 Heures", "valid"), ("duree", "deux heures", "warning"), ("nom", "Q1z9x", "error"), ("nom", "Béji", "valid"), ("etablissement", "TLE1B", "warning"),
             ("etablissement", "ZZZZ", "valid"), ("cin", "89728320", "error"), ("cin", "09728320", "valid"), ("date_naissance", "04/12/2003", "valid"), ("date_naissance", "04/12/1940", "error"),
             ("date_naissance", "31/02/2003", "error"), ("session", "x", "error"), ("identifiant", "54011", "warning"), ("identifiant", "5401177", "warning"), ("identifiant", "540117", "valid")]
    df = spark.createDataFrame([(k, 0, key, v, 0.96) for k, (key, v, _) in enumerate(cases)], "page_id long, occurrence int, key string, value string, confidence double")
    got = {r.page_id: r.status for r in rules.validated(df).collect()}
    assert [got[k] for k in range(len(cases))] == [c[2] for c in cases]


def test_birth_and_session(spark):
    rows = [(1, 0, "session", "2026", 0.96), (1, 1, "date_naissance", "01/01/2012", 0.96), (2, 0, "session", "2026", 0.96), (2, 1, "date_naissance", "01/01/2003", 0.96)]
    df = spark.createDataFrame(rows, "page_id long, occurrence int, key string, value string, confidence double")
    assert {(r.page_id, r.status) for r in rules.validated(df).where("key = 'date_naissance'").collect()} == {(1, "error"), (2, "valid")}


def test_placeholders_and_signature(spark):
    df = spark.createDataFrame([(1, 0, "nom", "Eya", 0.96, "valid"), (1, 1, "session", "2026", 0.9, "valid")], "page_id long, occurrence int, key string, value string, confidence double, status string")
    ink = spark.createDataFrame([(1, 0.0)], "page_id long, ink double")
    got = rules.placeholders(rules.signature_missing(df, ink), df, spark).collect()
    assert len(got) == 12 and sum(r.status == "empty" for r in got) == 10 and any(r.key == "zone_signature" and r.status == "error" for r in got)


def test_matching(spark):
    registry = spark.createDataFrame([("12345678", "Ben Ali", "Ahmed", "2024/2025"), ("87654321", "Trabelsi", "Sonia", "2023/2024")], "cin string, nom string, prenom string, session_year string")
    cases = [("12345678", "Ben Ali", "Ahmed", "2024/2025", 100.0, "valid"), ("12345678", "Benali", "Ahmed", "2024/2025", 100.0, "valid"), ("99999999", "Ben Ali", "Ahmed", None, 0.0, "reject"),
             ("12345678", "Ben Ali", "Ahmed", None, 90.0, "valid"), (None, "Trabelsi", "Sonia", "2023/2024", 60.0, "review"), (None, None, None, None, 0.0, "reject")]
    df = spark.createDataFrame([(k, *c[:4]) for k, c in enumerate(cases)], "id long, cin string, nom string, prenom string, session_year string")
    got = {r.id: (r.match_score, r.status) for r in matching.verified(df, registry).collect()}
    assert got == {k: c[4:] for k, c in enumerate(cases)}
    assert {r.id: r.status for r in matching.verified(df, registry, accept=95).collect()}[3] == "review"


def test_upsert_is_idempotent_and_keeps_the_last(spark, tmp_path):
    current = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, seq int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 3)], "k int, v string, seq int")
    once = store.upserted(current, new, ["k"], "seq")
    want = {(1, "a"), (2, "d"), (3, "e")}
    assert {(r.k, r.v) for r in once.collect()} == want == {(r.k, r.v) for r in store.upserted(once, new, ["k"], "seq").collect()}
    path = str(tmp_path / "t")
    store.replace(current, path)
    before = store.current(spark, path)
    store.replace(once, path)
    assert {(r.k, r.v) for r in store.current(spark, path).collect()} == want and before.count() == 2
    for _ in range(3):
        store.replace(store.current(spark, path), path)
    assert {(r.k, r.v) for r in store.current(spark, path).collect()} == want
    assert len([n for n in os.listdir(path) if n.startswith("v-")]) <= 4


def test_overlay_then_delete_is_identity(spark):
    none = spark.createDataFrame([], "page_id long, key string, value string")
    set_ = spark.createDataFrame([(1, "nom", "X", 1)], "page_id long, key string, value string, seq long")
    gone = spark.createDataFrame([(1, "nom", "", 2)], "page_id long, key string, value string, seq long")
    assert batches.overrides_edited(none, set_).count() == 1 and batches.overrides_edited(none, set_.union(gone)).count() == 0
    f = spark.createDataFrame([(1, "nom", "Y", "warning")], "page_id long, key string, value string, status string")
    assert batches.overlaid(f, batches.overrides_edited(none, set_)).first()[2:] == ("X", "valid", True)


def test_states_and_replies(spark):
    ev = spark.createDataFrame([(1, 1, "processing"), (1, 2, "cancelled"), (1, 3, "done"), (2, 1, "cancelled"), (2, 2, "done")], "file_id int, seq int, state string")
    assert {r.file_id: r.state for r in batches.latest_state(ev).collect()} == {1: "done", 2: "cancelled"}
    df = spark.createDataFrame([('```json\n{"text": " a ", "confidence": 0.5}\n```',), ("none",), ('{"text": "", "confidence": 1}',), ('{"text": "a", "confidence": -0.1}',), (None,)], "reply string")
    got = [r.p for r in df.select(vision.field_reply(F.col("reply")).alias("p")).collect()]
    assert got[0] == ("a", 0.5, None) and [g.error is None for g in got] == [True, False, False, False, False]
    grid = spark.createDataFrame([('{"rows": [{"row": 0, "text": "a"}, {"row": 9, "text": "b"}, {"row": 3, "text": "c", "confidence": 0.4}]}',)], "reply string")
    assert [(r.row, r.text, r.confidence) for r in vision.grid_reply(grid, "reply", 1, 4).collect()] == [(3, "c", 0.4)]


STUB = "inkplan.operators.recognize.Stub"


def test_recognizers(spark):
    df = spark.createDataFrame([(k, bytearray(t.encode())) for k, t in enumerate(["good", "bad!", "fine"])], "id long, crop binary")
    stub = STUB
    got = {r.id: r for r in recognize.recognized(df, stub, {"fail_on": "!"}).collect()}
    assert got[0].text == "good" and got[1].error and got[2].text == "fine"
    both = {r.id: r for r in recognize.cascade(df, [(stub, {"fail_on": "!"}), (stub, {"confidence": 0.7})]).collect()}
    assert (both[0].confidence, both[1].text, both[1].confidence) == (0.9, "bad!", 0.7) and len(both) == 3
    slow = recognize.recognized(df.limit(1), stub, {"delay_s": 0.5}, timeout_s=0.05).first()
    assert slow.text is None and "Timeout" in slow.error
    assert recognize.recognized(df.limit(0), stub).collect() == []


def test_supervised_recognizers(spark):
    """Of 1,000 crops with three that hang, one that ends the process and two that fail, these six are errors."""
    bad = {17: "hang", 18: "hang", 900: "hang", 400: "!", 401: "!", 777: "die"}
    df = spark.createDataFrame([(k, bytearray(bad.get(k, f"text {k}").encode())) for k in range(1000)], "id long, crop binary").repartition(2)
    start = time.time()
    got = {r.id: r for r in recognize.recognized(df, STUB, {"fail_on": "!", "hang_on": "hang", "die_on": "die"}, timeout_s=1.0).collect()}
    assert time.time() - start < 60  # six time limits for each that hangs, and a start after each
    assert {k for k, r in got.items() if r.error} == set(bad) and all(got[k].text == f"text {k}" for k in range(1000) if k not in bad)
    assert "Timeout" in got[17].error and "unreadable" in got[400].error and "ended" in got[777].error and got[1].source == "Stub"


def test_halving():
    class Counted(supervise.Child):
        calls = 0

        def read(self, crops, limit_s):
            self.calls += 1
            if b"bad" in crops:
                raise RuntimeError("ValueError: bad")
            if b"slow" in crops or len(crops) > 100:
                raise TimeoutError
            return [(c.decode(), 1.0) for c in crops]

    child = Counted("", ())
    out = supervise.settled(child, [b"a"] * 40 + [b"bad"] + [b"b"] * 23, 1.0)
    assert [r[2] for r in out].count(None) == 63 and out[40] == (None, 0.0, "ValueError: bad") and child.calls == 1 + 2 * 6
    assert all(r[2] is None for r in supervise.settled(child, [b"a"] * 128, 1.0)) and child.size == 64  # too large, not hung
    before = child.calls
    supervise.settled(child, [b"a"] * 128, 1.0)
    assert child.calls == before + 2


def test_cascade_in_one_pass(spark):
    df = spark.createDataFrame([(k, None if k == 7 else bytearray(t.encode())) for k, t in enumerate(["a", "b!", "c?", "d!?", "", "hang", "d", "x"])], "id long, crop binary")
    stages = [(STUB, {"up": False}), (STUB, {"fail_on": "!", "hang_on": "hang", "confidence": 0.4}), (STUB, {"fail_on": "?", "confidence": 0.7}), (STUB, {"confidence": 0.3, "fail_on": "!?"})]
    out = recognize.cascade(df, stages, timeout_s=0.5)
    got = {r.id: r for r in out.collect()}
    assert [got[k].confidence for k in range(8)] == [0.7, 0.7, 0.3, 0.0, 0.3, 0.7, 0.7, 0.3] and got[3].error == "ValueError: unreadable crop"
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    down = recognize.cascade(df.limit(2), [(STUB, {"up": False})]).collect()
    assert len(down) == 2 and all("not available" in r.error for r in down)
    missing = recognize.recognized(df.limit(1), "inkplan.operators.recognize.Absent").first()
    assert missing.text is None and "Absent" in missing.error


def test_recognizer_lifecycle():
    assert supervise.available(STUB, {"confidence": 0.1}) and not supervise.available(STUB, {"up": False})
    assert recognize.health()["recognizers"] == [STUB]
    first = supervise.child(STUB, (("confidence", 0.1),)).process.pid
    assert supervise.child(STUB, (("confidence", 0.1),)).process.pid == first
    for k in range(supervise.MOST):
        assert supervise.available(STUB, {"confidence": k / 10 + 0.2})
    assert len(supervise.running()) == supervise.MOST
    supervise.close()
    assert supervise.running() == []


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(b"x")
    (tmp_path / "in" / "b.exe").write_bytes(b"x")
    (tmp_path / "in" / "c.png").write_bytes(b"")
    got = {r.name: r.error for r in readers.files(spark, str(tmp_path / "in")).collect()}
    assert got == {"a.png": None, "b.exe": "extension"}  # Spark's source doesn't list files of no bytes

    def split(content, name):
        if name == "b.exe":
            raise ValueError("no")
        yield 0, np.zeros((2, 3, 3), np.uint8)

    df = spark.createDataFrame([("a", bytearray(b"x")), ("b.exe", bytearray(b"x"))], "name string, content binary")
    assert {(r.name, r.width, r.error) for r in readers.pages(df, split).collect()} == {("a", 3, None), ("b.exe", None, "ValueError: no")}
    js = spark.createDataFrame([(1, '[{"text": "a", "confidence": 0.5}]'), (2, '{"items": [{"text": "b"}, {"text": "c"}]}'), (3, "junk")], "id int, j string")
    assert [(r.id, r.item_idx, r.text) for r in readers.item_json(js, "j").orderBy("id", "item_idx").collect()] == [(1, 0, "a"), (2, 0, "b"), (2, 1, "c")]
    assert spark.range(1).select(readers.rois(F.lit('{"a": [0, 0, 1, 1], "b": [1]}')).alias("m")).first().m == {"a": [0.0, 0.0, 1.0, 1.0]}
    s = readers.Settings.from_env({"INKPLAN_MAX_FILE_MB": "5000", "INKPLAN_RENDER_DPI": "x"})
    assert s.max_file_mb == 1024 and s.render_dpi == 160
    (tmp_path / "char_lm_1.json").write_text('{"bigram": {"zz": 2.0}}')
    d = readers.decoder([str(tmp_path)])
    assert d.follows[d.number["z"], d.number["z"]] > d.follows[d.number["t"], d.number["h"]] and readers.decoder([]).decode("D1d1")[0] == "Didi"
    assert {r.key: r.status for r in forms.analysed(readers.demo_items(spark)).collect()}["cin"] == "valid"
    writers.write_text(spark.createDataFrame([("a",)], "t string"), "t", str(tmp_path / "t"))
    with pytest.raises(ValueError):
        writers.write_text(spark.createDataFrame([(" ",)], "t string"), "t", str(tmp_path / "u"))
    pages = spark.createDataFrame([(k, f"f{k // 2}.tif", k % 2, 0.5 + k / 10, "t", [("D", "QR")] if k == 3 else []) for k in range(4)], "page_id int, file_name string, page int, confidence double, text string, barcodes array<struct<data:string,type:string>>")
    fields_ = spark.createDataFrame([(0, 0, "Nom", "Eya"), (3, 0, "CIN", "K!")], "page_id int, occurrence int, label string, text string")
    rows = report.report_rows(pages, fields_, "01/01/2026 10:00")
    assert [(r["Statut Validation"], r["N° Page"], r["Nom"], r["marked"]) for r in rows.orderBy("page_id").collect()] == [("À réviser", 1, "Eya", False), ("À réviser", 1, "", False), ("À réviser", 1, "", False), ("À réviser", 1, "", True)]
    assert len(rows.columns) == 1 + 18 + 2
    z = zipfile.ZipFile(io.BytesIO(writers.report_workbook(rows, ["page_id"], "01/01/2026 10:00")))
    assert z.read("xl/worksheets/sheet1.xml").decode().count("<row ") == 5 and "Nombre total de pages" in z.read("xl/worksheets/sheet2.xml").decode()
    with pytest.raises(ValueError):
        writers.report_workbook(rows.where("page_id < 0"), ["page_id"], "x")
    writers.write_exports(spark.createDataFrame([(1, "a"), (2, " ")], "k int, t string"), "t", "docx", str(tmp_path / "d"))
    assert {r.k: r.file is not None for r in spark.read.parquet(str(tmp_path / "d")).collect()} == {1: True, 2: False}


def test_stream_equals_batch(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id as job_id", "case event_id % 3 when 0 then 'done' when 1 then 'error' else 'pending' end as status")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    jobs.start(spark, str(tmp_path / "in"), events.schema, lambda d: d, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(jobs.progress(spark, str(tmp_path / "out"))) == key(batches.job_counters(events))


def test_bad_files_in_a_stream(spark, tmp_path):
    """STR4: a file that can't be read is a row with an error; the stream and the other files go on."""
    from inkplan.operators import prepare

    image = prepare.png(np.zeros((4, 5, 3), np.uint8))
    for k, content in enumerate((image, b"junk", image[:40], image)):
        spark.createDataFrame([(f"{k}.png", bytearray(content))], "name string, content binary").write.parquet(str(tmp_path / "in" / str(k)))
    schema = "name string, content binary"
    jobs.start(spark, str(tmp_path / "in" / "*"), schema, readers.pages, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {r.name: (r.width, r.error is not None) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"0.png": (5, False), "1.png": (None, True), "2.png": (None, True), "3.png": (5, False)}


def test_previews_are_written_once(spark, tmp_path):
    from inkplan.sources import images

    page = np.arange(40 * 60 * 3, dtype=np.uint8).reshape(40, 60, 3)
    rows = [("a", k, 60, 40, bytearray(page.tobytes())) for k in (0, 1, 1)] + [("b", 0, None, None, None)]
    df = spark.createDataFrame(rows, "name string, page int, width int, height int, pixels binary")
    for _ in range(2):
        writers.write_previews(df, str(tmp_path / "p"), longest=30)
    got = spark.read.parquet(str(tmp_path / "p")).collect()
    assert sorted((r.name, r.page) for r in got) == [("a", 0), ("a", 1)] and images.png(bytes(got[0].preview)).shape == (20, 30, 3)


def test_greedy_decode():
    words = {0: 3, 3: 5, 5: 1}
    seen = []

    def step(token, cache):
        seen.append((token, cache))
        return np.eye(6)[words.get(token, 1)] * 5, (cache or 0) + 1

    assert recognize.greedy_decode(step, 0, 1, 10)[0] == [3, 5] and seen == [(0, None), (3, 1), (5, 2)]
    assert recognize.greedy_decode(step, 0, 9, 3)[0] == [3, 5, 1] and recognize.greedy_decode(step, 5, 1, 3) == ([], 0.0)


def test_report(spark):
    df = spark.createDataFrame([(1, 0, "Nom", "a"), (1, 1, "name", "b"), (1, 2, "NOM", "a"), (1, 3, "ecole", "x")], "page_id int, occurrence int, label string, text string")
    r = report.wide(df).first()
    assert r["Nom"] == "a, b" and r["Établissement d'origine"] == "x" and report.wide(df, strict=True).first()["Établissement d'origine"] == ""
    assert bands.likelihood(spark.createDataFrame([(1, 0.25), (1, 1.0)], "line_id int, p double")).first().confidence == pytest.approx(0.5)


def test_plans_have_no_nested_loops_and_push_filters(spark, sf_dir):
    from inkplan.plans import catalogue, entries

    assert catalogue
    for name in ("form_pairing_risk", "nearest_band", "candidate_match_exact", "overlay_export"):
        plan = entries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
    q = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey = 5").select("o_custkey")
    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,5)]" in q._jdf.queryExecution().executedPlan().toString()


def test_merged_bands_with_equal_and_missing_ends(spark, tmp_path):
    """band_merge against its SQL on one thread; equal bands, which its ORDER BY leaves open, are numbered once."""
    import duckdb

    from inkplan.plans import catalogue, entries

    part = [(1, 10, None), (1, 10, 30.0), (1, 10, 30.0), (1, 300, 5.0), (2, None, 4.0), (2, 7, 9.0), (3, 56, 26.0), (3, 56, 26.0), (4, 5, None), (4, 90, 2.0), (4, None, None)]
    rows = [(page, p, 1, 1 + k, q, 1.0) for k, (page, p, q) in enumerate(part)]
    df = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double")
    df.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = catalogue.band_merge(spark, str(tmp_path))
    assert got._jdf.queryExecution().executedPlan().toString().count("Sort [page_id") == 1
    assert Counter(map(tuple, got.collect())) == Counter(con.execute(entries.ORACLE_SQL["band_merge"]).fetchall())


def test_fuzzy_match_over_whole_tables(spark, sf_dir):
    """candidate_match_fuzzy against a plain loop over all candidates."""
    from inkplan.plans import catalogue, fixtures

    some = [r.asDict() for r in fixtures.fixture(spark, sf_dir, fixtures.IDENTITIES).collect()]
    registry = [r.asDict() for r in fixtures.fixture(spark, sf_dir, fixtures.REGISTRY).collect()]
    by_cin = {r["cin"]: r for r in registry}
    want = {}
    for i in some:
        up = lambda r: (r["nom"].upper(), r["prenom"].upper())
        met = [by_cin[i["cin"]]] if i["cin"] in by_cin else [] if i["cin"] else [r for r in registry if up(r) == up(i)]
        best = None
        for r in met:
            like = {n: SequenceMatcher(None, i[n].upper(), r[n].upper()).ratio() for n in ("nom", "prenom")}
            score = 40.0 * (i["cin"] == r["cin"]) + sum(w if like[n] >= 0.9 else round(w * like[n], 1) for n, w in (("nom", 30.0), ("prenom", 20.0))) + 10.0 * (i["session_year"] == r["session_year"])
            best = max(best or (0.0, ""), (score, r["cin"]), key=lambda x: x[0])
        score, cin = best or (0.0, None)
        status = "reject" if i["cin"] and not best else "valid" if score >= 85 else "review" if score >= 60 else "reject"
        want[i["id"]] = (round(score, 2), status, cin)
    got = {r.id: (r.match_score, r.status, r.matched_cin) for r in catalogue.candidate_match_fuzzy(spark, sf_dir).collect()}
    assert got == want and len(Counter(r[1] for r in got.values())) > 1


def test_decoded_words_over_whole_tables(spark, sf_dir):
    """char_decode and acronym_nearest against one value at a time."""
    from inkplan.functions import decode
    from inkplan.operators import fields
    from inkplan.plans import catalogue

    part = {r.p_partkey: r for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect()}
    for r in catalogue.char_decode(spark, sf_dir).collect():
        p = part[r.p_partkey]
        assert (r.value, r.confidence, r.changed) == decode.DECODER.decode(f"{p.p_name} {p.p_brand} {p.p_type}")
    for r in catalogue.acronym_nearest(spark, sf_dir).collect():
        probe = "".join(c for c in part[r.p_partkey].p_type if c.isalnum()).upper()
        like = [SequenceMatcher(None, probe, s).ratio() for s in fields.SCHOOLS]
        assert r.school == (fields.SCHOOLS[like.index(max(like))] if max(like) >= fields.SCHOOL_RATIO else None)


def test_nearest_by_merging(spark):
    rng = random.Random(3)
    boxes = [(p, k, rng.choice([None, *range(30)])) for p in range(6) for k in range(15)]
    of = [(p, k, rng.choice([None, *(x / 2 for x in range(60))])) for p in range(5) for k in range(rng.randint(0, 8))]
    got = {(r.page_id, r.box): (r.distance, r.band) for r in bands.nearest(spark.createDataFrame(boxes, "page_id long, box int, y int"), spark.createDataFrame(of, "page_id long, band int, y double")).collect()}
    want = {(p, k): min((abs(y - z), b) for q, b, z in of if q == p and z is not None) for p, k, y in boxes if y is not None and any(q == p and z is not None for q, _, z in of)}
    assert got == want
    tops = [(p, k, rng.choice([None, *range(60)])) for p in range(5) for k in range(12)]
    got = {(r.page_id, r.item): r.row_no for r in bands.same_row(spark.createDataFrame(boxes, "page_id long, item int, top int"), spark.createDataFrame(tops, "page_id long, row_no int, top int")).collect()}
    want = {(p, k): min(n for q, n, z in tops if q == p and z is not None and abs(y - z) < 8) for p, k, y in boxes if y is not None and any(q == p and z is not None and abs(y - z) < 8 for q, _, z in tops)}
    assert got == want


def test_nearest_sorts_boxes_once(spark):
    """Boxes before the first band, after the last, at a band and halfway; pages without page_id meet nothing, as in SQL."""
    boxes = [(1, k, y) for k, y in enumerate([0, 9, 10, 15, 16, 99])] + [(2, 0, 5), (None, 0, 5), (3, 0, 7), (1, None, 3)]
    of = [(1, 7, 10.0), (1, 4, 20.0), (1, 5, 20.0), (1, None, 16.0), (None, 1, 5.0), (3, 2, None), (3, 1, 8.0)]
    got = bands.nearest(spark.createDataFrame(boxes, "page_id long, box int, y int"), spark.createDataFrame(of, "page_id long, band int, y double"))
    assert got._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    want = {(1, 0, 7, 10.0), (1, 1, 7, 1.0), (1, 2, 7, 0.0), (1, 3, 4, 5.0), (1, 4, 4, 4.0), (1, 5, 4, 79.0), (3, 0, 1, 1.0)}
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_a_page_of_many_boxes_and_bands(spark):
    """100,000 of each on one page: all pairs would be ten thousand million."""
    n = 100_000
    ids = spark.range(n)
    boxes, of = ids.select(F.lit(1).alias("page_id"), F.col("id").alias("box"), (F.col("id") * 7 % 50_000).alias("y")), ids.select(F.lit(1).alias("page_id"), F.col("id").alias("band"), (F.col("id") * 3 % 40_000).alias("y"))
    got = bands.nearest(boxes, of)
    assert got.count() == n and got.agg(F.max("distance")).first()[0] == 10_000
    assert bands.same_row(boxes.withColumnsRenamed({"box": "item", "y": "top"}), of.withColumnsRenamed({"band": "row_no", "y": "top"})).count() == n * 40_007 // 50_000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_a_frequent_name_brings_few_candidates(spark):
    registry = spark.range(5000).select(F.format_string("%08d", F.lit(5000) - F.col("id")).alias("cin"), F.lit("Ben").alias("nom"), F.when(F.col("id") % 2 == 0, "Ali").otherwise("Eya").alias("prenom"), F.lit("2024").alias("session_year"))
    asked = [(1, None, "ben", ""), (2, "", " BEN", "eya"), (3, "00000007", "x", "y"), (4, None, "", ""), (5, None, "Bén", "")]
    identities = spark.createDataFrame([(*a, "2024") for a in asked], "id long, cin string, nom string, prenom string, session_year string")
    got = Counter()
    for r in matching.blocked(identities, registry).collect():
        got[r.id, int(r.c_cin)] += 1
    every = [(1, k) for k in range(1, 21)] + [(2, k) for k in range(1, 41) if (5000 - k) % 2 == 1] + [(3, 7)]
    assert got == Counter(every)
