"""Whole forms: OCR items to corrected, validated fields, with one shuffle by page."""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, decode, text
from . import fields, pairing, rules

LEAST_CHANGED = 0.92
_NUMERIC = ("cin", "serie", "identifiant", "anonyme")
_TABLE = str.maketrans(text.CONFUSED, text.MEANT)
_WINDOW = str.maketrans(text.WINDOW_CONFUSED, text.WINDOW_MEANT)
#: The numbers that are harvested, their digits, and how many more or fewer a whole run may have.
NUMBERS = (("cin", 8, 1), ("serie", 4, 0), ("identifiant", 6, 1))
#: Their forms that need no harvest, where they are plain digits.
PLAIN = {"cin": "^[01][0-9]{7}$", "serie": "^[0-9]{3,4}$", "identifiant": "^[0-9]{6}$"}
#: The pattern of printed() for Arrow, whose blanks are ASCII only unless named.
PRINTED = r"(?:^|[^0-9])(?P<serie>[0-9]{3})[\s\pZ\x0b\x1c-\x1f\x{85}./|-]*(?P<identifier>[0-9]{6})(?:[^0-9]|$)"
#: Labels that readings of schools may begin with, longest first.
SCHOOL_LABELS = ("ETABLISSEMENTDORIGINE", "ETABLISSEMENTSCOLAIRE", "ETABLISSEMENT", "INSTITUT", "LYCEE")


def nearest_digits(value: str, length: int, leading: str) -> str | None:
    """TXT6 on one value; text.nearest_digits() is the column form."""
    packed, found = "".join(value.split()), []
    for k in range(len(packed) - length + 1):
        w = packed[k : k + length]
        meant = "".join(c for c in w.translate(_WINDOW) if c.isdigit())
        errors = len(meant) - sum(c.isdigit() for c in w) + 2 * (length - len(meant))
        if errors <= 2:
            found.append((errors, meant[:1] not in leading or not meant, k, meant))
    return min(found)[3] if found else None


@lru_cache(100_000)
def birth(value: str) -> str:
    """DT7: the date and place of a birth; a year alone says that the rest can't be read."""
    found = dates.best_date(value)
    if not found:
        probe = value.translate(_TABLE).replace("&", "2")
        year = re.search(dates.YEAR.replace(r"\d", "[0-9]"), probe)
        whole = re.search(r"[0-9]{1,2}\s*[/.\-]\s*[0-9]{1,2}\s*[/.\-]\s*(?:19|20)[0-9]{2}", probe)
        return f"{year[0]} (jour/mois illisibles)" if year and not whole else value
    rest = re.sub(r"\s+", " ", value[: found[1]] + value[found[2] :]).strip(" ,.;:·-_")
    words = [w for w in re.findall("[A-Za-zÀ-ÖØ-öø-ÿ']+", decode.DECODER.decode(rest)[0]) if len(w) >= 3]
    place = words[-1][0].upper() + words[-1][1:] if words else rest
    return f"{found[0]} · {place}" if len(place) > 1 else found[0]


def name(value: str, decoded: str) -> str:
    """TXT9."""
    new = re.sub(r"\s+", " ", decoded).strip().strip(".'-")
    return new[0].upper() + new[1:] if len(new) >= 2 else value


@lru_cache(100_000)
def school(value: str) -> str:
    """TXT8, JN13."""
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFKD", value.lower()) if not unicodedata.combining(c))
    packed = re.sub("[^a-z0-9]", "", plain.replace("&", "et")).upper()
    packed = next((packed[len(p) :] for p in SCHOOL_LABELS if packed.startswith(p)), packed)
    return decode.nearest(packed, fields.SCHOOLS, fields.SCHOOL_RATIO) or packed if len(packed) >= 2 else value


def decoded_as(key: str) -> str | None:
    """The decoder's table for a field, if its readings are decoded."""
    return "digit" if fields.KIND.get(key) == "cin" else "text" if key in ("nom", "prenom") else None


def corrected(key: str, value: str, decoded: str | None) -> str:
    """TXT5: a reading as its field's kind would have it; what can't be told stays as it is."""
    kind = fields.KIND.get(key, "text")
    if not value:
        return value
    if key == "date_naissance":
        return birth(value)
    if key in ("nom", "prenom"):
        return name(value, decoded)
    if kind == "etablissement":
        return school(value)
    if kind == "date":
        return (dates.best_date(value) or (value,))[0]
    if kind == "cin" and (near := nearest_digits(decoded or value, 8, "01")):
        return near
    n = sum(c.isdigit() for c in value)
    return value.translate(_TABLE) if kind in _NUMERIC and n and 2 * n >= len(value) else value


def all_corrected(readings: list[tuple[str, str]]) -> list[str]:
    """corrected() of readings (key, value): each different one once, and those that are decoded together, which is what the decoder is made for."""
    decoded, different = {}, list(dict.fromkeys(readings))
    for kind in ("digit", "text"):
        some = [r for r in different if decoded_as(r[0]) == kind]
        decoded |= zip(some, (d[0] for d in decode.DECODER.decode_all([v for _, v in some], kind)))
    known = {r: corrected(*r, decoded.get(r)) for r in different}
    return [known[r] for r in readings]


def built(key: str, value: str, confidence: float, new: str | None = None) -> list:
    """[key, value, confidence, original]: a reading with its correction. A changed value is at least LEAST_CHANGED sure and keeps the original."""
    new = all_corrected([(key, value)])[0] if new is None else new
    return [key, new, confidence, None] if new == value else [key, new, max(confidence, LEAST_CHANGED), value]


def right(key: str, length: int, value: str) -> bool:
    """Whether a number needs no harvest."""
    n = sum(c.isdigit() for c in value)
    return n in (3, 4) if key == "serie" else n == length and (key != "cin" or bool(re.fullmatch("[01][0-9]{7}", value.replace(" ", ""))))


def harvest(found: list[list], entries: list[dict], free: dict[int, dict]) -> None:
    """JN7, FLT6 on one page: numbers that are missing or misread, from any item that no field has taken. found: rows of built()."""
    for key, length, slack in NUMBERS:
        own = next((f for f in reversed(found) if f[0] == key), None)
        if own and right(key, length, own[1]):
            continue
        label = next((e for e in entries if e["key"] == key), None)
        if label is None:
            continue
        best = None
        for e in free.values():
            if e["key"] or e["noise"]:
                continue
            spaced = "".join(c if c.isdigit() or c.isspace() else " " for c in e["clean"].translate(_TABLE))
            (x0, y0, x1, y1), (a0, b0, a1, b1) = label["rect"], e["rect"]
            far = (abs(x0 + x1 - a0 - a1) + abs(y0 + y1 - b0 - b1)) / 2 / 2000
            for window, penalty in decode.digit_windows(spaced, length, slack):
                score = 1000 * penalty + far + 400 * (key == "cin" and window[0] not in "01")
                if best is None or score < best[0]:
                    best = (score, window, e)
        if best:
            if sum(c.isdigit() for c in best[2]["clean"].translate(_WINDOW)) <= length + 2:
                free.pop(best[2]["idx"])
            new = built(key, best[1], best[2]["conf"])
            if own:
                own[:] = new
            else:
                found.append(new)


def printed(found: list[list], free: dict[int, dict]) -> None:
    """JN9 on one page."""
    two = {f[0]: f for f in found if f[0] in ("serie", "identifiant")}
    blocks = [(e["conf"], -e["idx"], *m.groups()) for e in free.values() if not e["key"] and (m := re.search(r"(?:^|[^0-9])([0-9]{3})[\s./|-]*([0-9]{6})(?:[^0-9]|$)", e["clean"])) and m[2].startswith(m[1])]
    if len(two) == 2 and blocks and max(blocks)[0] >= 0.5:
        for key, value in zip(("serie", "identifiant"), max(blocks)[2:]):
            if value != re.sub("[^0-9]", "", two[key][1]):
                two[key][1:] = [value, max(two[key][2], LEAST_CHANGED), two[key][1]]


def names_harvested(found: list[list], entries: list[dict], free: dict[int, dict]) -> None:
    """JN8 on one page: a first or last name that was read as nothing is the page's surest capitalised word that no field has taken, the nearest
    to the label among equals."""
    for key in ("prenom", "nom"):
        own = next((f for f in reversed(found) if f[0] == key), None)
        label = next((e for e in entries if e["key"] == key), None)
        if own is None or own[1] or label is None:
            continue
        best = None
        for e in free.values():
            if e["key"] or e["noise"] or e["conf"] < 0.95:
                continue
            word = next((w for w in re.findall("[A-Za-zÀ-ÖØ-öø-ÿ']+", e["clean"]) if w.isalpha() and len(w) >= 3 and w[0].isupper()), None)
            if word:
                (x0, y0, x1, y1), (a0, b0, a1, b1) = label["rect"], e["rect"]
                score = (abs(x0 + x1 - a0 - a1) + abs(y0 + y1 - b0 - b1)) / 2 / 2000 - 10 * e["conf"]
                if best is None or score < best[0]:
                    best = (score, word, e)
        if best:
            free.pop(best[2]["idx"])
            found.append(built(key, best[1], max(best[2]["conf"], 0.95)))


def all_corrected_columns(keys: pa.Array, values: pa.Array) -> pa.Array:
    """all_corrected() of columns. Plain digits stay as they are, in national numbers if they are eight; Python only sees the others."""
    numeric = pc.is_in(keys, pa.array([k for k, kind in fields.KIND.items() if kind in _NUMERIC and kind != "cin"]))
    eight = pc.is_in(keys, pa.array([k for k, kind in fields.KIND.items() if kind == "cin"]))
    plain = pc.or_(pc.and_(numeric, pc.match_substring_regex(values, "^[0-9]+$")), pc.and_(eight, pc.match_substring_regex(values, "^[0-9]{8}$")))
    rest = pc.invert(plain)
    new = all_corrected(list(zip(keys.filter(rest).to_pylist(), values.filter(rest).to_pylist())))
    return pc.replace_with_mask(values, rest, pa.array(new, pa.string()))


def last_rows(page: np.ndarray, keys: pa.Array, pages: int) -> dict[str, np.ndarray]:
    """By key: the last row of each page that has it, else -1."""
    code, found = keys.dictionary_encode(), {}
    for k, key in enumerate(code.dictionary.to_pylist()):
        at = np.flatnonzero(code.indices.to_numpy() == k)
        found[key] = np.full(pages, -1)
        found[key][page[at]] = at  # of equal places the last one stays
    return defaultdict(lambda: np.full(pages, -1), found)


def all_right(key: str, length: int, values: pa.Array) -> np.ndarray:
    """right() of a column; Python only sees what isn't plain digits."""
    out = pc.match_substring_regex(values, PLAIN[key]).to_numpy(zero_copy_only=False).copy()
    for at in np.flatnonzero(~out):
        out[at] = right(key, length, values[int(at)].as_py())
    return out


def all_printed(batch, page: np.ndarray, free: np.ndarray, rows: list, last: dict) -> list:
    """printed() of all pages of free items at once. rows: columns value, confidence, original; last: the rows of pages with their fields."""
    at = np.flatnonzero(free)
    block = pc.extract_regex(batch.column("clean").take(at), PRINTED)
    serie, identifier = block.flatten()
    there = pc.equal(pc.utf8_slice_codeunits(identifier, 0, 3), serie).fill_null(False)
    serie, identifier, at = serie.filter(there), identifier.filter(there), at[there.to_numpy(zero_copy_only=False)]
    sure = batch.column("confidence").take(at).to_numpy(zero_copy_only=False)
    order = np.lexsort((-at, sure, page[at]))
    order = order[np.r_[np.diff(page[at][order]) > 0, True][: len(order)]]
    order = order[sure[order] >= 0.5]
    for key, printed_as in (("serie", serie.take(order)), ("identifiant", identifier.take(order))):
        own = last[key][page[at[order]]]
        other = pc.not_equal(pc.replace_substring_regex(rows[0].take(own), "[^0-9]", ""), printed_as).to_numpy(zero_copy_only=False)
        mask = np.zeros(len(rows[0]), bool)
        mask[own[other]] = True
        given = pa.array(mask)
        old, most = rows[0].filter(given), pc.max_element_wise(rows[1].filter(given), LEAST_CHANGED)
        rows = [pc.replace_with_mask(c, given, x) for c, x in zip(rows, (printed_as.filter(pa.array(other)), most, old))]
    return rows


def page_context(page: np.ndarray, keys: pa.Array, values: pa.Array, pages: int) -> dict:
    """What rules.in_context() asks of a row's page, on the rows whose rules look at it."""
    last = last_rows(page, keys, pages)
    of = {k: pc.equal(keys, k).to_numpy(zero_copy_only=False) for k in ("serie", "identifiant", "anonyme", "date_naissance")}
    numbers, both = of["serie"] | of["identifiant"], of["serie"] | of["identifiant"] | of["anonyme"]

    def shown(key: str, where: np.ndarray) -> pa.Array:
        at = last[key][page]
        return values.take(pa.array(at, mask=~where | (at < 0)))

    out = {"_series": shown("serie", both), "_identifier": shown("identifiant", both)}
    out |= {"_session": shown("session", of["date_naissance"]), "_exam": shown("date_concours", of["date_naissance"])}
    earlier: dict[int, list] = {}
    for at in np.flatnonzero(of["identifiant"] & (last["identifiant"][page] != np.arange(len(page)))):
        earlier.setdefault(int(page[at]), []).append(values[int(at)].as_py())
    rows = np.flatnonzero(numbers & np.isin(page, list(earlier))) if earlier else ()
    lists: list = [None] * len(page)
    for at in rows:
        lists[at] = earlier[int(page[at])]
    return out | {"_earlier": pa.array(lists, pa.list_(pa.string())) if earlier else pa.nulls(len(page), pa.list_(pa.string()))}


def page_fields(batch) -> dict:
    """Pairing, correction, harvest of numbers, printed block and harvest of names of whole pages: columns of built() rows in order, and of page_context().
    All is done in columns for all pages at once, but for pages that lack something: harvests look at these one by one."""
    page, (label, value, both) = pairing.page_numbers(batch), pairing.greedy(batch)
    pages, inline, column = int(page[-1]) + 1, pa.array(both), batch.column
    keys = pc.if_else(inline, column("inline_key").take(label), column("key").take(label))
    old = pc.if_else(inline, column("inline_value").take(value), column("raw").take(value))
    new, sure, own = all_corrected_columns(keys, old), column("confidence").take(value), page[label]
    changed = pc.not_equal(new, old)
    rows = [new, pc.if_else(changed, pc.max_element_wise(sure, LEAST_CHANGED), sure), pc.if_else(changed, old, None)]
    last, lacks = last_rows(own, keys, pages), np.zeros(pages, bool)
    for key, length, _ in NUMBERS:
        have = np.flatnonzero(last[key] >= 0)
        wrong = np.zeros(pages, bool)
        wrong[page[pc.equal(column("key"), key).fill_null(False).to_numpy(zero_copy_only=False)]] = True
        wrong[have[all_right(key, length, new.take(last[key][have]))]] = False
        lacks |= wrong
    for key in ("nom", "prenom"):
        have = np.flatnonzero(last[key] >= 0)
        lacks[have[pc.equal(new.take(last[key][have]), "").to_numpy(zero_copy_only=False)]] = True
    free = column("key").is_null().to_numpy(zero_copy_only=False)
    free[value] = False
    rows = all_printed(batch, page, free & (~lacks & (last["serie"] >= 0) & (last["identifiant"] >= 0))[page], rows, last)
    if lacks.any():
        own, keys, *rows = harvested(batch, page, free, lacks, own, keys, rows)
    out = {"page_id": column("page_id").take(np.searchsorted(page, own)), "occurrence": np.arange(len(own)) - np.searchsorted(own, own)}
    return out | dict(zip(("key", "value", "confidence", "original"), (keys, *rows))) | page_context(own, keys, rows[0], pages)


def harvested(batch, page: np.ndarray, free: np.ndarray, lacks: np.ndarray, own: np.ndarray, keys: pa.Array, rows: list) -> list:
    """Pages that lack something, one by one: page numbers, keys and rows of all pages with what was found for these."""
    at = np.flatnonzero(lacks[page])
    some = {c: batch.column(c).take(at).to_pylist() for c in ("clean", "confidence", "key", "noise", "x0", "y0", "x1", "y1")}
    rects, items = zip(*(some[c] for c in ("x0", "y0", "x1", "y1"))), {}
    for row, clean, conf, key, noise, rect in zip(at.tolist(), some["clean"], some["confidence"], some["key"], some["noise"], rects):
        items.setdefault(int(page[row]), []).append({"idx": row, "clean": clean, "conf": conf, "key": key, "noise": noise, "rect": rect})
    theirs = lacks[own]
    found: dict[int, list[list]] = {p: [] for p in items}
    for p, *row in zip(own[theirs].tolist(), *(c.filter(pa.array(theirs)).to_pylist() for c in (keys, *rows))):
        found[p].append(row)
    for p, entries in items.items():
        left = {e["idx"]: e for e in entries if free[e["idx"]]}
        harvest(found[p], entries, left)
        printed(found[p], left)
        names_harvested(found[p], entries, left)
    flat, many = [f for more in found.values() for f in more], [len(more) for more in found.values()]
    own = np.r_[own[~theirs], np.repeat(list(found), many)]
    order = np.argsort(own, kind="stable")
    mine = zip(*flat) if flat else [()] * 4
    columns = (pa.concat_arrays([c.filter(pa.array(~theirs)), pa.array(list(x), c.type)]).take(order) for c, x in zip((keys, *rows), mine))
    return [own[order], *columns]


def analysed(items: DataFrame) -> DataFrame:
    """Items (page_id, item_idx, text, confidence, box) to (page_id, occurrence, key, value, confidence, corrections, status). The steps that take
    items away from one another see whole pages after the only shuffle, and give the rules what these look at on other rows of the page."""

    rows = pairing.flat(pairing.normalised(items).drop("box"))
    context = "_series string, _identifier string, _session string, _exam string, _earlier array<string>"
    found = pairing.per_page(rows, page_fields, f"page_id long, occurrence int, key string, value string, confidence double, original string, {context}")
    note = F.when(F.col("original").isNotNull(), F.struct("original", fields.kind_of(F.col("key")).alias("kind"), F.lit("char").alias("engine")))
    return rules.in_context(found.withColumn("corrections", note).drop("original"))
