"""Registered queries of the form engine and the DuckDB SQL that checks them. Each query applies operators to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, decode, geometry, text
from ..operators import bands, batches, fields, forms, matching, pairing, report, rules, similar, store, vision
from . import fixtures as fx
from .entries import query

def _norm(x: str) -> str:
    return f"trim(regexp_replace(replace(strip_accents(lower(trim({x}))), '&', 'et'), '[^a-z0-9]+', ' ', 'g'))"


def _clean(x: str) -> str:
    return f"trim(trim(regexp_replace({x}, '[\\s_]+', ' ', 'g')), '.:;,«»\"''')"


_NOISE = "(regexp_matches(lower(trim({0})), '[:：]$') OR regexp_matches(lower(trim({0})), '\\bnombre\\b|\\bnumber\\b|\\bn?0?m8?re\\b') OR regexp_matches({0}, '[぀-ヿ㐀-䶿一-鿿豈-﫿가-힯]'))"
_DIGITS = "regexp_replace({0}, '[^0-9]', '', 'g')"


def _alias_values() -> str:
    return ", ".join(f"('{a}', '{k}', {i})" for i, (a, k) in enumerate(fields.ALIASES))


def _labelled(items: str) -> str:
    """CTEs: e (items with clean, norm and key), as pairing.normalised() gives them."""
    return f"""al(alias, key, ord) AS (VALUES {_alias_values()}), items AS ({items}),
    n AS (SELECT *, {_clean('text')} AS clean, {_norm('text')} AS norm FROM items WHERE trim(text) <> '' AND confidence >= 0.5),
    e AS (SELECT n.*, coalesce((SELECT key FROM al WHERE alias = norm), (SELECT arg_min(key, ord) FROM al WHERE length(alias) >= 4 AND starts_with(norm, alias || ' '))) AS key FROM n),
    lab AS (SELECT * FROM e WHERE key IS NOT NULL), val AS (SELECT * FROM e WHERE key IS NULL AND NOT {_NOISE.format('clean')} AND NOT regexp_matches(trim(text), '[:：]$'))"""


_FORM = "CASE l.key " + " ".join(f"WHEN '{k}' THEN regexp_matches(v.clean, '{p}')" for k, p in fields.PATTERN.items() if p) + " ELSE false END"
_RIGHT = "v.x0 - l.x1 BETWEEN -2 AND 400 AND abs((v.y0 + v.y1) / 2.0 - (l.y0 + l.y1) / 2.0) <= greatest(l.y1 - l.y0, 8) * 0.5"
_BELOW = """v.y0 - l.y1 > 0 AND v.y0 - l.y1 <= CASE WHEN l.key IN ('nom', 'prenom') THEN 80 ELSE 300 END
    AND v.x1 >= l.x0 - 2 * greatest(1, l.y1 - l.y0) AND v.x0 <= l.x1 + 2 * greatest(1, l.y1 - l.y0)"""


def _picked(near: str, gap: str, likes: str = _FORM) -> str:
    return f"""SELECT * FROM (SELECT l.page_id, l.item_idx AS label_idx, l.key, v.item_idx AS value_idx, trim(v.text) AS raw, v.clean, v.confidence,
    row_number() OVER (PARTITION BY l.page_id, l.item_idx ORDER BY {likes} DESC, {gap}, v.clean, v.item_idx) AS rn
    FROM lab l JOIN val v ON l.page_id = v.page_id WHERE {near}) WHERE rn = 1"""


_PAIRED = f"""r AS ({_picked(_RIGHT, 'v.x0 - l.x1')}), rest AS (SELECT * FROM lab ANTI JOIN r ON lab.page_id = r.page_id AND lab.item_idx = r.label_idx),
    b AS ({_picked(_BELOW, 'v.y0 - l.y1').replace('FROM lab l', 'FROM rest l')}), p AS (SELECT * FROM r UNION ALL SELECT * FROM b)"""


def _mean4(x: str) -> str:
    """As numbers.mean4()."""
    return f"CASE WHEN count({x}) > 0 THEN floor((2 * sum(CAST(round({x} * 1000000) AS BIGINT)) + 100 * count({x})) / (200.0 * count({x}))) / 10000.0 END"


def _status(c: str = "confidence") -> str:
    return f"CASE WHEN {c} < 0.65 THEN 'error' WHEN {c} < 0.85 THEN 'warning' ELSE 'valid' END"


# -- items, labels and pairs ---------------------------------------------------------------------


@query(f"""WITH {_labelled(fx.ITEMS)}, {_PAIRED},
f AS (SELECT page_id, key AS field_key, confidence AS c0, raw, CASE WHEN key = 'cin' THEN translate(raw, 'OoIliSsBb', '001115588') ELSE raw END AS value FROM p),
g AS (SELECT *, CASE WHEN value <> raw THEN greatest(c0, 0.92) ELSE c0 END AS confidence FROM f)
SELECT page_id, field_key, value, confidence, CASE WHEN field_key = 'cin' AND NOT regexp_matches(value, '^[01][0-9]{{7}}$') THEN 'error'
WHEN field_key = 'nom' AND NOT regexp_matches(value, '^[A-Za-zÀ-ÖØ-öø-ÿ'' -]{{2,}}$') THEN 'error' ELSE {_status()} END AS status FROM g""")
def form_pairing_risk(spark, sf_dir):
    """JN1, JN3, JN5, TXT4, VAL1, VAL2, VAL9: pair, correct numbers (a changed value is at least 0.92 sure) and classify."""
    pairs = pairing.paired(pairing.normalised(fx.items(spark, sf_dir, fx.ITEMS)))
    value = F.when(F.col("key") == "cin", text.deconfuse(F.col("raw"))).otherwise(F.col("raw"))
    sure = F.when(value != F.col("raw"), F.greatest("confidence", F.lit(0.92))).otherwise(F.col("confidence"))
    found = pairs.select("page_id", F.col("key").alias("field_key"), value.alias("value"), sure.alias("confidence"))
    wrong = ((F.col("field_key") == "cin") & rules.cin_message(F.col("value")).isNotNull()) | ((F.col("field_key") == "nom") & ~rules.name_ok(F.col("value")))
    return found.withColumn("status", F.when(wrong, "error").otherwise(rules.by_confidence(F.col("confidence"))))


@query(f"SELECT doc_id, md5({_norm('text')}) AS norm_md5, md5({_clean('text')}) AS clean_md5 FROM documents")
def items_normalized(spark, sf_dir):
    """PRJ1, TXT1, TXT2 over whole texts."""
    t = F.col("text")
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.md5(text.keyword(t)).alias("norm_md5"), F.md5(text.clean(t)).alias("clean_md5"))


@query(f"""SELECT conv_id, turn, trim(text) AS raw FROM conversations WHERE trim(text) <> '' AND CAST(conv_id % 100 AS DOUBLE) / 100 >= 0.5 AND NOT {_NOISE.format('text')}""")
def noise_gate(spark, sf_dir):
    """FLT1, FLT2, FLT3."""
    sure = (F.col("conv_id") % 100).cast("double") / 100
    rows = fx.table(spark, sf_dir, "conversations").where((F.trim("text") != "") & (sure >= pairing.LEAST_CONFIDENCE))
    return rows.where(~text.is_noise(F.col("text"))).select("conv_id", "turn", F.trim("text").alias("raw"))


_INLINE = "SELECT c_custkey AS page_id, CASE c_custkey % 4 WHEN 0 THEN concat('Prénom : ', c_name) WHEN 1 THEN concat('Série du sujet：', c_mktsegment) WHEN 2 THEN concat('Autre : ', c_name) ELSE c_name END AS text FROM customer"


@query(f"""WITH al(alias, key, ord) AS (VALUES {_alias_values()}), k AS ({_INLINE}), s AS (SELECT page_id, {_norm("regexp_extract(text, '(?s)^([^:：]*)[:：](.*)$', 1)")} AS norm, {_clean("regexp_extract(text, '(?s)^([^:：]*)[:：](.*)$', 2)")} AS value FROM k)
SELECT page_id, coalesce((SELECT key FROM al WHERE alias = norm), (SELECT arg_min(key, ord) FROM al WHERE length(alias) >= 4 AND starts_with(norm, alias || ' '))) AS key, value FROM s
WHERE value <> '' AND coalesce((SELECT key FROM al WHERE alias = norm), (SELECT arg_min(key, ord) FROM al WHERE length(alias) >= 4 AND starts_with(norm, alias || ' '))) IS NOT NULL""")
def inline_split(spark, sf_dir):
    """TXT7, JN1."""
    rows = fx.fixture(spark, sf_dir, _INLINE)
    key = fields.label_key(text.keyword(text.label_part(F.col("text"))))
    return rows.select("page_id", key.alias("key"), text.value_part(F.col("text")).alias("value")).where("key is not null and value <> ''")


@query(f"WITH {_labelled(fx.BELOW)}, {_PAIRED} SELECT page_id, key, raw FROM p")
def pair_below(spark, sf_dir):
    """JN4: names within 80 below their label, other fields within 300."""
    return pairing.paired(pairing.normalised(fx.items(spark, sf_dir, fx.BELOW))).select("page_id", "key", "raw")


@query(f"WITH {_labelled(fx.DATED)}, {_PAIRED} SELECT page_id, key, raw FROM p")
def pattern_pick(spark, sf_dir):
    """JN5: a date wins over a nearer text."""
    return pairing.paired(pairing.normalised(fx.items(spark, sf_dir, fx.DATED))).select("page_id", "key", "raw")


@query(f"""WITH al(alias, key, ord) AS (VALUES {_alias_values()}), d AS (SELECT doc_id, {_norm('text')} AS norm FROM documents)
SELECT doc_id, key FROM (SELECT doc_id, key, row_number() OVER (PARTITION BY doc_id ORDER BY length(alias) DESC, ord) AS rn FROM d JOIN al ON contains(norm, alias)) WHERE rn = 1""")
def label_longest_alias(spark, sf_dir):
    """JN2 over whole texts."""
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", text.keyword(F.col("text")).alias("norm"))
    return fields.longest_label(docs, "norm").where("key is not null").select("doc_id", "key")


@query(f"""WITH {_labelled(fx.NUMBERS)}, w AS (SELECT page_id, item_idx, confidence, (x0 + x1) / 2.0 AS cx, (y0 + y1) / 2.0 AS cy, clean FROM val WHERE regexp_matches(clean, '^[0-9]{{8}}$')),
s AS (SELECT w.page_id, w.item_idx, w.clean AS value, (abs(w.cx - (l.x0 + l.x1) / 2.0) + abs(w.cy - (l.y0 + l.y1) / 2.0)) / 2000.0 + CASE WHEN regexp_matches(w.clean, '^[01]') THEN 0 ELSE 400 END AS score
FROM w JOIN lab l ON w.page_id = l.page_id WHERE l.key = 'cin') SELECT page_id, 'cin' AS key, value FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score, item_idx) AS rn FROM s) WHERE rn = 1""")
def cin_harvest(spark, sf_dir):
    """JN7: of the eight-digit numbers on a page the one with a right first digit, else the nearest."""
    e = pairing.normalised(fx.items(spark, sf_dir, fx.NUMBERS))
    eight = pairing.is_value() & F.col("clean").rlike("^[0-9]{8}$")
    return pairing.numeric_harvest(e, eight, "cin", 8).select("page_id", "key", "value")


#: Numbers as scans give them: whole, with letters for digits, in groups, a digit too many or too few, beside other digits, and none at all.
_SPREAD = """
SELECT page_id, item_idx, text, confidence, x0, y0, x1, y1 FROM (
  WITH k AS (SELECT o_orderkey AS page_id, o_orderkey % 9 AS r9, o_custkey % 5 AS r5, lpad(CAST((o_orderkey * 104729) % 10000000 AS VARCHAR(10)), 7, '0') AS n FROM orders)
  SELECT page_id, 0 AS item_idx, 'N° CIN' AS text, CAST(0.97 AS DOUBLE) AS confidence, 50 AS x0, 100 AS y0, 260 AS x1, 134 AS y1 FROM k
  UNION ALL SELECT page_id, 1, CASE r9 WHEN 0 THEN concat('O', n) WHEN 1 THEN concat('1', n, '7') WHEN 2 THEN n WHEN 3 THEN concat(substr(n, 1, 3), ' ', substr(n, 4, 4), ' 1') WHEN 4 THEN concat('x', n, 'y', n) ELSE concat('8', n) END,
    CAST(0.9 AS DOUBLE), 280, 100, 520, 134 FROM k
  UNION ALL SELECT page_id, 2, CASE r5 WHEN 0 THEN concat('0', substr(n, 1, 2), '.', substr(n, 3, 5)) WHEN 1 THEN concat('l', n) WHEN 2 THEN concat('12 0', n) WHEN 3 THEN 'rien' ELSE concat('77', n, '77') END, CAST(0.8 AS DOUBLE), 280, 400, 520, 434 FROM k) u
"""


@query(f"""WITH {_labelled(_SPREAD)}, groups AS (SELECT page_id, item_idx, confidence, x0, y0, x1, y1, unnest(regexp_extract_all(regexp_replace(translate(clean, 'OoIliSsBb', '001115588'), '[^0-9\\s]', ' ', 'g'), '[0-9]+(?:[ \t./|,-]+[0-9]+)*')) AS grp FROM val),
parts AS (SELECT *, regexp_extract_all(grp, '[0-9]+') AS runs FROM groups), edges AS (SELECT *, array_to_string(runs, '') AS whole, list_transform(range(1, len(runs) + 1), lambda k: length(array_to_string(runs[1:k], ''))) AS ends FROM parts),
starts AS (SELECT *, unnest(range(0, greatest(0, length(whole) - 7))) AS a FROM edges),
win AS (SELECT page_id, item_idx, confidence, x0, y0, x1, y1, substr(whole, CAST(a AS INT) + 1, 8) AS value, CAST(a > 0 AND NOT list_contains(ends, a) AS INT) + CAST(NOT list_contains(ends, a + 8) AS INT) AS penalty FROM starts
 UNION ALL SELECT page_id, item_idx, confidence, x0, y0, x1, y1, value, 0 FROM (SELECT *, unnest(runs) AS value FROM parts) WHERE abs(length(value) - 8) <= 1),
rated AS (SELECT w.page_id, w.item_idx, w.value, penalty * 1000.0 + (abs((w.x0 + w.x1) / 2.0 - (l.x0 + l.x1) / 2.0) + abs((w.y0 + w.y1) / 2.0 - (l.y0 + l.y1) / 2.0)) / 2000.0 + CASE WHEN regexp_matches(w.value, '^[01]') THEN 0.0 ELSE 400.0 END AS score
 FROM win w JOIN lab l ON w.page_id = l.page_id WHERE l.key = 'cin' AND penalty < 2)
SELECT page_id, item_idx, value, CAST(round(score, 4) AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score, item_idx, value) AS rn FROM (SELECT DISTINCT * FROM rated)) WHERE rn = 1""")
def number_windows(spark, sf_dir):
    """JN7, TXT10: the best window of eight digits of a page, over runs that stand whole, in groups, or beside other digits."""
    e = pairing.normalised(fx.items(spark, sf_dir, _SPREAD))
    found = pairing.numeric_harvest(e, pairing.is_value(), "cin", 8)
    return found.select("page_id", "item_idx", "value", F.round("score", 4).alias("score"))


@query(f"""WITH {_labelled(fx.NUMBERS)}, m AS (SELECT *, regexp_extract(clean, '(?:^|[^0-9])([0-9]{{3}})[\\s./|-]*([0-9]{{6}})(?:[^0-9]|$)', 1) AS serie, regexp_extract(clean, '(?:^|[^0-9])([0-9]{{3}})[\\s./|-]*([0-9]{{6}})(?:[^0-9]|$)', 2) AS identifiant FROM val)
SELECT page_id, serie, identifiant FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY confidence DESC, item_idx) AS rn FROM m WHERE serie <> '' AND starts_with(identifiant, serie)) WHERE rn = 1 AND confidence >= 0.5""")
def printed_block(spark, sf_dir):
    """JN9."""
    e = pairing.normalised(fx.items(spark, sf_dir, fx.NUMBERS))
    return pairing.printed_block(e.where(pairing.is_value())).select("page_id", "serie", "identifiant")


# -- values --------------------------------------------------------------------------------------

_MIXED = "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN concat('O9', CAST(c_custkey AS VARCHAR(12)), 'lS') WHEN 1 THEN concat('OMAR', CAST(c_custkey AS VARCHAR(12))) WHEN 2 THEN c_name ELSE CAST(c_custkey * 7919 AS VARCHAR(14)) END AS value FROM customer"


@query(f"""WITH k AS ({_MIXED}) SELECT id, CASE WHEN length({_DIGITS.format('value')}) > 0 AND length({_DIGITS.format('value')}) * 2 >= length(value) THEN translate(value, 'OoIliSsBb', '001115588') ELSE value END AS value FROM k""")
def deconfuse_digits(spark, sf_dir):
    """TXT4, TXT5."""
    return fx.fixture(spark, sf_dir, _MIXED).select("id", text.deconfused_if_numeric(F.col("value")).alias("value"))


@query(f"""WITH k AS ({_MIXED}), p AS (SELECT id, regexp_replace(value, '\\s+', '', 'g') AS v FROM k), w AS (SELECT id, i, substr(v, i, 8) AS w FROM p, range(1, 40) r(i) WHERE i <= length(v) - 7),
s AS (SELECT id, i, {_DIGITS.format("translate(w, 'OoIilLSsBb', '0011115588')")} AS d, length({_DIGITS.format('w')}) AS n FROM w),
t AS (SELECT id, i, d, length(d) - n + 2 * (8 - length(d)) AS errors, CASE WHEN substr(d, 1, 1) IN ('0', '1') THEN 0 ELSE 1 END AS lead FROM s)
SELECT k.id, f.d AS value FROM k LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY id ORDER BY errors, lead, i) AS rn FROM t WHERE errors <= 2) f ON k.id = f.id AND rn = 1""")
def digit_window(spark, sf_dir):
    """TXT6."""
    return fx.fixture(spark, sf_dir, _MIXED).select("id", text.nearest_digits(F.col("value"), 8, "01").alias("value"))


_ISO_SQL = "CASE WHEN regexp_matches(value, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN strftime(try_strptime(regexp_extract(value, '[0-9]{4}-[0-9]{2}-[0-9]{2}'), '%Y-%m-%d'), '%d/%m/%Y') END"
_PLAIN_SQL = "CASE WHEN regexp_matches(value, '[0-9]{2}/[0-9]{2}/[0-9]{4}') THEN strftime(try_strptime(regexp_extract(value, '[0-9]{2}/[0-9]{2}/[0-9]{4}'), '%d/%m/%Y'), '%d/%m/%Y') END"
_LONG_SQL = "CASE WHEN regexp_matches(value, '^Lundi') THEN concat(regexp_extract(value, '[0-9]{2}'), '/', CASE WHEN contains(value, 'Janvier') THEN '01' WHEN contains(value, 'février') THEN '02' WHEN contains(value, 'Août') THEN '08' ELSE '12' END, '/', regexp_extract(value, '[0-9]{4}')) END"


@query(f"WITH k AS ({fx.WRITTEN}) SELECT id, {_ISO_SQL} AS value FROM k")
def date_iso(spark, sf_dir):
    """DT1."""
    return fx.fixture(spark, sf_dir, fx.WRITTEN).select("id", dates.from_iso(F.col("value")).alias("value"))


@query(f"WITH k AS ({fx.WRITTEN}) SELECT id, {_LONG_SQL} AS value FROM k")
def date_fr_longhand(spark, sf_dir):
    """DT3."""
    return fx.fixture(spark, sf_dir, fx.WRITTEN).select("id", dates.from_longhand(F.col("value")).alias("value"))


@query(f"""WITH k AS ({fx.WRITTEN}), f AS (SELECT id, value, coalesce({_ISO_SQL}, {_PLAIN_SQL}, {_LONG_SQL}) AS d FROM k)
SELECT id, d, CASE WHEN d IS NULL THEN 'no such day' WHEN CAST(right(d, 4) AS INT) NOT BETWEEN 1950 AND 2026 THEN 'year out of range' WHEN try_strptime(d, '%d/%m/%Y') IS NULL THEN 'no such day' WHEN CAST(right(d, 4) AS INT) > 2009 - 17 + 8 THEN 'too young for the session' END AS message FROM f""")
def date_validate(spark, sf_dir):
    """DT2, VAL3 with a session year of 2017."""
    rows = fx.fixture(spark, sf_dir, fx.WRITTEN).withColumn("d", dates.clean_date(F.col("value")))
    return rows.select("id", "d", rules.date_message(F.col("value"), F.lit(2017), F.col("d")).alias("message"))


_SESSIONS = "SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN '2025' WHEN 1 THEN '2024/2025' WHEN 2 THEN '2024-2025' WHEN 3 THEN '2017/2025' ELSE concat('s', CAST(o_orderkey AS VARCHAR(12))) END AS value FROM orders"


@query(f"""WITH k AS ({_SESSIONS}) SELECT id, regexp_matches(value, '^[0-9]{{4}}([/-][0-9]{{4}})?$') AND (length(value) = 4 OR TRY_CAST(right(value, 4) AS INT) = TRY_CAST(left(value, 4) AS INT) + 1) AS ok,
TRY_CAST(nullif(regexp_extract(value, '(?:19|20)[0-9]{{2}}'), '') AS INT) AS year FROM k""")
def session_year_rule(spark, sf_dir):
    """DT8, DT9."""
    return fx.fixture(spark, sf_dir, _SESSIONS).select("id", dates.session_year_ok(F.col("value")).alias("ok"), dates.year_of(F.col("value")).alias("year"))


_IDENTITY = "SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN lpad(CAST(c_custkey AS VARCHAR(12)), 8, '0') ELSE 'O1234567' END AS cin, CASE c_custkey % 4 WHEN 0 THEN '2024/2025' WHEN 1 THEN '2017/2025' END AS session_year, CASE c_custkey % 5 WHEN 0 THEN '2024-0001' WHEN 1 THEN '12' END AS identifiant, CASE c_custkey % 2 WHEN 0 THEN upper(c_mktsegment) ELSE 'x' END AS barcode FROM customer"


@query(f"""WITH k AS ({_IDENTITY}) SELECT id, concat_ws('; ', CASE WHEN NOT regexp_matches(cin, '^[0-9]{{8}}$') THEN 'CIN: eight digits' END, CASE WHEN session_year = '2017/2025' THEN 'session year: 2024/2025' END,
CASE WHEN NOT regexp_matches(identifiant, '^(?:[0-9]{{4}}-[0-9]{{3,6}}|[0-9]{{4,8}})$') THEN 'identifier: 2024-0001' END, CASE WHEN NOT regexp_matches(barcode, '^[A-Z0-9]{{6,20}}$') THEN 'barcode: 6 to 20 characters' END) AS violations FROM k""")
def identity_rules(spark, sf_dir):
    """VAL15, AGG11."""
    found = matching.format_rules(F.col("cin"), F.col("session_year"), F.col("identifiant"), F.col("barcode"))
    return fx.fixture(spark, sf_dir, _IDENTITY).select("id", F.array_join(matching.violations(found), "; ").alias("violations"))


_F = f"WITH f AS ({fx.FIELDS}), s AS (SELECT page_id, max(CASE WHEN key = 'serie' THEN value END) AS serie, max(CASE WHEN key = 'identifiant' THEN value END) AS ident FROM f GROUP BY page_id)"
_MISMATCH = f"NOT ({_DIGITS.format('serie')} <> '' AND starts_with({_DIGITS.format('ident')}, {_DIGITS.format('serie')}))"


@query(f"""{_F} SELECT f.page_id, key, value, CASE WHEN {_MISMATCH} THEN 'error' WHEN key = 'serie' THEN CASE WHEN regexp_matches(value, '[A-Za-z]') OR NOT regexp_matches({_DIGITS.format('value')}, '^[0-9]{{3,4}}$') THEN 'error' ELSE {_status()} END
WHEN NOT regexp_matches(value, '^[0-9]{{5,8}}$') THEN 'error' WHEN length(value) <> 6 AND confidence >= 0.85 THEN 'warning' ELSE {_status()} END AS status FROM f JOIN s ON f.page_id = s.page_id WHERE key IN ('serie', 'identifiant')""")
def series_identifier(spark, sf_dir):
    """VAL4, VAL6, VAL12, JN17."""
    return rules.validated(fx.fixture(spark, sf_dir, fx.FIELDS)).where(F.col("key").isin("serie", "identifiant")).select("page_id", "key", "value", "status")


@query(f"""{_F} SELECT f.page_id, value, CASE WHEN regexp_matches(serie, '^[0-9]{{3,4}}$') AND regexp_matches(ident, '^[0-9]+$') AND {_DIGITS.format('value')} <> concat(serie, ident) THEN 'error' ELSE {_status()} END AS status FROM f JOIN s ON f.page_id = s.page_id WHERE key = 'anonyme'""")
def anonymity_code(spark, sf_dir):
    """VAL8."""
    return rules.validated(fx.fixture(spark, sf_dir, fx.FIELDS)).where("key = 'anonyme'").select("page_id", "value", "status")


@query(f"WITH f AS ({fx.FIELDS}) SELECT page_id, value, CASE WHEN regexp_matches(value, '[0-9]') THEN {_status()} WHEN length(value) >= 2 THEN 'warning' ELSE 'error' END AS status FROM f WHERE key = 'duree'")
def duration_rule(spark, sf_dir):
    """VAL7."""
    return rules.validated(fx.fixture(spark, sf_dir, fx.FIELDS)).where("key = 'duree'").select("page_id", "value", "status")


@query(f"WITH f AS ({fx.FIELDS}) SELECT page_id, value, CASE WHEN regexp_matches(value, '^[A-Za-zÀ-ÖØ-öø-ÿ'' -]{{2,}}$') THEN {_status()} ELSE 'error' END AS status FROM f WHERE key = 'nom'")
def name_rule(spark, sf_dir):
    """VAL9."""
    return rules.validated(fx.fixture(spark, sf_dir, fx.FIELDS)).where("key = 'nom'").select("page_id", "value", "status")


@query(f"WITH f AS ({fx.FIELDS}) SELECT page_id, value, CASE WHEN regexp_matches(value, '^[1-5]$') THEN {_status()} ELSE 'error' END AS status FROM f WHERE key = 'nombre_cahiers'")
def count_rule(spark, sf_dir):
    """VAL5."""
    return rules.validated(fx.fixture(spark, sf_dir, fx.FIELDS)).where("key = 'nombre_cahiers'").select("page_id", "value", "status")


@query("SELECT p_partkey, CASE WHEN regexp_matches(upper(p_brand), '[A-Z]') AND regexp_matches(p_brand, '[0-9]') THEN 'warning' ELSE 'valid' END AS brand_status, CASE WHEN length(p_name) < 2 THEN 'error' ELSE 'valid' END AS name_status FROM part")
def school_and_text_rules(spark, sf_dir):
    """VAL10, VAL11."""
    part = fx.table(spark, sf_dir, "part")
    return part.select("p_partkey", F.when(rules.school_ok(F.col("p_brand")), "valid").otherwise("warning").alias("brand_status"), F.when(F.length("p_name") < 2, "error").otherwise("valid").alias("name_status"))


@query(f"WITH f AS ({fx.FIELDS}) SELECT page_id, count(*) >= 2 AS is_form, coalesce({_mean4('CASE WHEN confidence > 0 THEN confidence END')}, 0.0) AS global_confidence FROM f GROUP BY page_id")
def form_confidence(spark, sf_dir):
    """AGG5."""
    return rules.form_summary(fx.fixture(spark, sf_dir, fx.FIELDS))


_TEMPLATE_VALUES = ", ".join(f"('{k}')" for k in fields.TEMPLATE)


@query(f"""WITH f AS ({fx.FIELDS}), t(key) AS (VALUES {_TEMPLATE_VALUES}), p AS (SELECT DISTINCT page_id FROM f) SELECT p.page_id, t.key, coalesce(f.value, '') AS value, coalesce(f.confidence, 0.0) AS confidence, CASE WHEN f.value IS NULL THEN 'empty' ELSE 'read' END AS status
FROM p CROSS JOIN t LEFT JOIN f ON f.page_id = p.page_id AND f.key = t.key""")
def placeholders(spark, sf_dir):
    """PRJ2, VAL17."""
    found = fx.fixture(spark, sf_dir, fx.FIELDS).withColumn("status", F.lit("read"))
    return rules.placeholders(found, found.select("page_id"), spark)


@query(f"""WITH f AS ({fx.FIELDS}), g AS (SELECT page_id, {_status()} AS status FROM f) SELECT page_id, count(*) FILTER (status = 'error') AS errors, count(*) FILTER (status = 'warning') AS warnings, count(*) AS detected FROM g GROUP BY page_id""")
def status_counts(spark, sf_dir):
    """AGG16, VAL1."""
    return rules.status_counts(fx.fixture(spark, sf_dir, fx.FIELDS).withColumn("status", rules.by_confidence(F.col("confidence"))))


@query(f"""WITH f AS ({fx.FIELDS}), o(key, section, ord) AS (VALUES {", ".join(f"('{k}', '{fields.SECTION[k]}', {n})" for k, n in fields.ORDER.items())}) SELECT page_id, section, string_agg(f.key, ',' ORDER BY ord) AS field_keys FROM f JOIN o ON f.key = o.key GROUP BY page_id, section""")
def sections(spark, sf_dir):
    """AGG17."""
    return rules.by_section(fx.fixture(spark, sf_dir, fx.FIELDS))


# -- batches -------------------------------------------------------------------------------------

_ITEM_ROWS = "SELECT l_orderkey AS file_id, l_suppkey % 3 AS page, CAST((l_orderkey * 3 + l_suppkey % 3) % 50 AS DOUBLE) / 50 AS confidence FROM lineitem"


@query(f"WITH i AS ({_ITEM_ROWS}) SELECT file_id, page, {_mean4('confidence')} AS confidence FROM i GROUP BY file_id, page")
def page_confidence(spark, sf_dir):
    """AGG1."""
    return batches.page_confidence(fx.fixture(spark, sf_dir, _ITEM_ROWS))


@query(f"WITH i AS ({_ITEM_ROWS}), p AS (SELECT file_id, page, {_mean4('confidence')} AS confidence FROM i GROUP BY file_id, page) SELECT file_id, {_mean4('confidence')} AS confidence FROM p GROUP BY file_id")
def file_confidence(spark, sf_dir):
    """AGG2."""
    return batches.file_confidence(batches.page_confidence(fx.fixture(spark, sf_dir, _ITEM_ROWS)))


@query(f"""WITH f AS ({fx.FILES}) SELECT job_id, count(*) AS total, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'error') AS error, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'pending') AS pending,
CAST(count(*) FILTER (status IN ('done', 'error')) AS DOUBLE) / greatest(1, count(*)) AS progress FROM f GROUP BY job_id""")
def job_counters(spark, sf_dir):
    """AGG3, STR3."""
    return batches.job_counters(fx.fixture(spark, sf_dir, fx.FILES))


_DONE = "CASE WHEN status = 'done' THEN confidence END"


@query(f"WITH f AS ({fx.FILES}) SELECT job_id, coalesce({_mean4(_DONE)}, 0.0) AS average FROM f GROUP BY job_id")
def job_average(spark, sf_dir):
    """AGG2 over jobs."""
    return batches.job_average(fx.fixture(spark, sf_dir, fx.FILES))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) FILTER (text <> '') AS text FROM conversations GROUP BY conv_id")
def page_text(spark, sf_dir):
    """AGG4 on pages."""
    return batches.joined_text(fx.table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text", "\n")


@query("WITH p AS (SELECT conv_id, role, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations WHERE text <> '' GROUP BY conv_id, role) SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY role) AS text FROM p GROUP BY conv_id")
def document_text(spark, sf_dir):
    """AGG4 on documents."""
    by_role = batches.joined_text(fx.table(spark, sf_dir, "conversations"), ["conv_id", "role"], "turn", "text", "\n")
    return batches.joined_text(by_role, ["conv_id"], "role", "text", "\n\n")


_UPLOADS = "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN concat('a', lang, '.PDF') WHEN 1 THEN concat(source, '.exe') WHEN 2 THEN 'noname' ELSE concat(source, '.Tiff') END AS name, CASE WHEN doc_id % 13 = 0 THEN 0 ELSE n_chars * 3000 END AS size FROM documents"


@query(f"""WITH u AS ({_UPLOADS}) SELECT doc_id, CASE WHEN lower(regexp_extract(name, '\\.([^.]+)$', 1)) NOT IN ('png', 'jpg', 'jpeg', 'tif', 'tiff', 'bmp', 'webp', 'pdf') THEN 'extension' WHEN size < 1 THEN 'empty' WHEN size > 26214400 THEN 'too large' ELSE 'accepted' END AS outcome FROM u""")
def upload_split(spark, sf_dir):
    """SRC1, SRC2, SET4."""
    taken, rejected = batches.split_uploads(fx.fixture(spark, sf_dir, _UPLOADS))
    return taken.select("doc_id", F.lit("accepted").alias("outcome")).union(rejected.select("doc_id", "error"))


@query(f"""WITH f AS ({fx.FILES}) SELECT file_id, name, status FROM f WHERE contains(lower(name), 'term') OR contains(lower(CASE status WHEN 'pending' THEN 'En attente' WHEN 'done' THEN 'Terminé' WHEN 'error' THEN 'Erreur' ELSE 'Annulé' END), 'term') ORDER BY file_id LIMIT 50 OFFSET 100""")
def file_search_page(spark, sf_dir):
    """FLT4, SRT1: the third page of fifty."""
    return batches.page_of(batches.searched(fx.fixture(spark, sf_dir, fx.FILES), "term"), ["file_id"], 3, 50).select("file_id", "name", "status")


_FIELD_STATUS = f"SELECT page_id, key, value, confidence, {_status()} AS status FROM ({fx.FIELDS}) z"


@query(f"WITH f AS ({_FIELD_STATUS}), o AS ({fx.OVERRIDES}) SELECT f.page_id, f.key, coalesce(o.value, f.value) AS value, CASE WHEN o.value IS NULL THEN f.status ELSE 'valid' END AS status, o.value IS NOT NULL AS edited FROM f LEFT JOIN o ON f.page_id = o.page_id AND f.key = o.key")
def overlay_detail(spark, sf_dir):
    """OVL1."""
    return batches.overlaid(fx.fixture(spark, sf_dir, _FIELD_STATUS), fx.fixture(spark, sf_dir, fx.OVERRIDES))


@query(f"WITH f AS ({fx.FIELDS}), o AS ({fx.OVERRIDES}) SELECT coalesce(f.page_id, o.page_id) AS page_id, coalesce(f.key, o.key) AS key, coalesce(o.value, f.value) AS value, coalesce(f.confidence, 1.0) AS confidence FROM f FULL JOIN o ON f.page_id = o.page_id AND f.key = o.key")
def overlay_export(spark, sf_dir):
    """OVL2."""
    return batches.overlaid_for_export(fx.fixture(spark, sf_dir, fx.FIELDS), fx.fixture(spark, sf_dir, fx.OVERRIDES))


_EDITS = "SELECT o_orderkey AS page_id, CASE o_orderkey % 3 WHEN 0 THEN 'nom' WHEN 1 THEN 'serie' ELSE 'epreuve' END AS key, CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE concat('again ', CAST(o_orderkey AS VARCHAR(12))) END AS value, o_orderkey AS seq FROM orders WHERE o_orderkey % 6 = 0"


@query(f"WITH o AS ({fx.OVERRIDES}), e AS ({_EDITS}) SELECT coalesce(e.page_id, o.page_id) AS page_id, coalesce(e.key, o.key) AS key, coalesce(e.value, o.value) AS value FROM o FULL JOIN e ON o.page_id = e.page_id AND o.key = e.key WHERE coalesce(e.value, o.value) <> ''")
def overrides_edit(spark, sf_dir):
    """OVL3, MAP1, STR5."""
    return batches.overrides_edited(fx.fixture(spark, sf_dir, fx.OVERRIDES), fx.fixture(spark, sf_dir, _EDITS))


# -- report and registry -------------------------------------------------------------------------

_LABELLED = "SELECT l_orderkey AS page_id, l_linenumber AS occurrence, CASE l_suppkey % 5 WHEN 0 THEN 'Nom' WHEN 1 THEN 'Prénom ' WHEN 2 THEN 'CIN' WHEN 3 THEN 'ecole' ELSE 'autre' END AS label, concat(' ', l_returnflag, CAST(l_partkey % 3 AS VARCHAR(4))) AS text FROM lineitem"


def _wide_sql() -> str:
    cases = " ".join(f"WHEN '{a}' THEN '{h.replace(chr(39), chr(39) * 2)}'" for a, h in report.COLUMNS.items())
    cells = ", ".join(f"""coalesce(string_agg(t, ', ' ORDER BY o, t) FILTER (h = '{h.replace(chr(39), chr(39) * 2)}'), '') AS "{h}" """ for h in report.HEADINGS)
    return f"""WITH k AS ({_LABELLED}), n AS (SELECT page_id, occurrence, trim(text) AS t, CASE strip_accents(lower(trim(label))) {cases} END AS h FROM k), d AS (SELECT page_id, h, t, min(occurrence) AS o FROM n WHERE h IS NOT NULL AND t <> '' GROUP BY page_id, h, t) SELECT page_id, {cells} FROM d GROUP BY page_id"""


@query(_wide_sql())
def report_pages(spark, sf_dir):
    """AGG8, ARR1, TXT11, SNK1."""
    return report.wide(fx.fixture(spark, sf_dir, _LABELLED))


_PAGES = "SELECT o_custkey AS file_id, o_orderkey AS page, CAST(50 + o_orderkey % 50 AS DOUBLE) / 100 AS confidence, CASE o_orderkey % 6 WHEN 0 THEN 'K1' WHEN 1 THEN '' ELSE lpad(CAST(o_orderkey AS VARCHAR(12)), 8, '0') END AS cin, CASE WHEN o_orderkey % 6 = 1 THEN '' ELSE o_orderpriority END AS payload, CASE WHEN o_orderkey % 9 = 0 THEN CAST(o_orderkey AS VARCHAR(12)) ELSE '' END AS code FROM orders"
_VIOLATED = "confidence < 0.85 OR (cin <> '' AND NOT regexp_matches(cin, '^[A-Za-z0-9]{4,}$')) OR (payload = '' AND code = '')"


@query(f"""WITH p AS ({_PAGES}), a AS (SELECT *, NOT ({_VIOLATED}) AS ok FROM p) SELECT count(DISTINCT file_id) AS files, count(*) AS pages, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS to_review, round(count(*) FILTER (ok) * 100.0 / count(*), 4) AS acceptance_pct,
round(avg(confidence) * 100.0, 4) AS mean_pct, count(DISTINCT CASE WHEN code <> '' THEN file_id END) AS files_with_barcode FROM a""")
def report_kpis(spark, sf_dir):
    """AGG9, VAL14, AGG10, SNK2."""
    pages = fx.fixture(spark, sf_dir, _PAGES)
    codes = report.barcode_summary(F.array(F.struct(F.col("code").alias("data"), F.lit("QR").alias("type"))))
    wrong = report.page_violations(F.col("confidence"), F.col("cin"), F.col("payload"), codes)
    return report.key_figures(pages.select("file_id", "confidence", (F.size(wrong) == 0).alias("accepted"), codes.alias("barcodes")))


@query(f"WITH p AS ({_PAGES}) SELECT page, CASE WHEN code <> '' THEN concat(code, ' (QR) | ', code, 'x') ELSE 'x' END AS codes, CASE WHEN confidence >= 0.85 THEN 'green' WHEN confidence >= 0.6 THEN 'orange' ELSE 'red' END AS colour, CASE WHEN confidence * 100 >= 70 THEN 'green' WHEN confidence * 100 >= 50 THEN 'orange' ELSE 'red' END AS gauge FROM p")
def barcodes_and_colours(spark, sf_dir):
    """AGG10, PRJ5."""
    two = F.array(F.struct(F.col("code").alias("data"), F.lit("QR").alias("type")), F.struct(F.concat(F.col("code"), F.lit("x")).alias("data"), F.lit("").alias("type")))
    return fx.fixture(spark, sf_dir, _PAGES).select("page", report.barcode_summary(two).alias("codes"), report.bucket(F.col("confidence")).alias("colour"), report.gauge(F.col("confidence") * 100).alias("gauge"))


_DOCS = "SELECT o_orderkey AS id, o_orderkey % 4 = 0 AS encrypted, CASE WHEN o_orderstatus = 'O' THEN 'review' ELSE 'valid' END AS status, CAST(o_orderkey % 101 AS DOUBLE) AS match_score FROM orders"


@query(f"WITH d AS ({_DOCS}) SELECT count(*) AS total, count(*) FILTER (encrypted) AS encrypted, count(*) FILTER (status = 'review') AS pending_review, nullif(round(avg(match_score), 2), 0.0) AS avg_match_score FROM d")
def registry_stats(spark, sf_dir):
    """AGG7."""
    return store.statistics(fx.fixture(spark, sf_dir, _DOCS))


_MATCHED = f"""WITH i AS ({fx.IDENTITIES}), c AS ({fx.REGISTRY}), m AS (SELECT i.id, c.cin, CASE WHEN i.cin = c.cin THEN 40.0 ELSE 0.0 END + CASE WHEN upper(i.nom) = upper(c.nom) THEN 30.0 ELSE 0.0 END + CASE WHEN upper(i.prenom) = upper(c.prenom) THEN 20.0 ELSE 0.0 END + CASE WHEN i.session_year = c.session_year THEN 10.0 ELSE 0.0 END AS s
FROM i JOIN c ON i.cin = c.cin OR (i.cin IS NULL AND upper(trim(i.nom)) = upper(trim(c.nom)) AND upper(trim(i.prenom)) = upper(trim(c.prenom)))), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, cin) AS rn FROM m WHERE s > 0) WHERE rn = 1)
SELECT i.id, coalesce(round(b.s, 2), 0.0) AS match_score, CASE WHEN i.cin IS NOT NULL AND b.id IS NULL THEN 'reject' WHEN coalesce(b.s, 0) >= 85 THEN 'valid' WHEN coalesce(b.s, 0) >= 60 THEN 'review' ELSE 'reject' END AS status, b.cin AS matched_cin FROM i LEFT JOIN b ON i.id = b.id"""


@query(_MATCHED)
def candidate_match_exact(spark, sf_dir):
    """JN10, JN12, VAL16, with equality as the similarity."""
    return matching.verified(fx.fixture(spark, sf_dir, fx.IDENTITIES), fx.fixture(spark, sf_dir, fx.REGISTRY), ratio=matching.equal_names)


@query(_MATCHED.replace("upper(c.nom) THEN 30.0 ELSE 0.0 END", f"upper(c.nom) THEN 30.0 WHEN c.nom = 'other' THEN {round(30 * 6 / 23, 1)} ELSE 0.0 END"))  # 'other' and 18 characters share three
def candidate_match_fuzzy(spark, sf_dir):
    """JN11, TXT17."""
    return matching.verified(fx.fixture(spark, sf_dir, fx.IDENTITIES), fx.fixture(spark, sf_dir, fx.REGISTRY))


_CURRENT = "SELECT c_custkey AS cin, c_name AS nom, c_custkey AS seq FROM customer WHERE c_custkey % 2 = 0"
_NEW = "SELECT o_custkey AS cin, concat('from ', CAST(o_orderkey AS VARCHAR(12))) AS nom, o_orderkey AS seq FROM orders"


@query(f"WITH c AS ({_CURRENT}), n AS ({_NEW}), l AS (SELECT cin, nom, seq FROM (SELECT *, row_number() OVER (PARTITION BY cin ORDER BY seq DESC) AS rn FROM n) WHERE rn = 1) SELECT * FROM l UNION ALL SELECT * FROM c WHERE cin NOT IN (SELECT cin FROM l)")
def upsert_candidates(spark, sf_dir):
    """SET2, AGG15."""
    return store.upserted(fx.fixture(spark, sf_dir, _CURRENT), fx.fixture(spark, sf_dir, _NEW), ["cin"], "seq")


@query("SELECT doc_id, sha256, n_chars FROM (SELECT doc_id, sha256(text) AS sha256, n_chars, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id DESC) AS rn FROM documents) WHERE rn = 1")
def dedupe_sha256(spark, sf_dir):
    """SEC1, SET3, SNK8."""
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", store.fingerprint(F.col("text")).alias("sha256"), "n_chars")
    return store.last_of_each(docs, ["sha256"], "doc_id")


_ARCHIVE = "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN concat('B/', CAST(c_custkey AS VARCHAR(12))) END AS barcode, CASE WHEN c_custkey % 3 = 1 THEN c_name END AS cin, CASE c_custkey % 2 WHEN 0 THEN '2024/2025' ELSE 'x' END AS session_year FROM customer"


@query(f"WITH k AS ({_ARCHIVE}) SELECT id, concat(CASE WHEN session_year = 'x' THEN '2026' ELSE '2024' END, '/', coalesce(nullif(regexp_replace(coalesce(barcode, cin, 'INCONNU'), '[^A-Za-z0-9_-]', '', 'g'), ''), 'INCONNU'), '_20260101_000000.tif') AS path FROM k")
def archive_path(spark, sf_dir):
    """SNK6, SNK7, DT8."""
    return fx.fixture(spark, sf_dir, _ARCHIVE).select("id", store.archive_path(F.col("barcode"), F.col("cin"), F.lit(None).cast("string"), F.col("session_year"), "20260101_000000", F.lit(".TIF"), "2026").alias("path"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey LIMIT 100 OFFSET 200")
def candidates_page(spark, sf_dir):
    """SRT2."""
    return batches.page_of(fx.table(spark, sf_dir, "customer"), ["c_name", "c_custkey"], 3, 100).select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_orderdate FROM (SELECT o_orderkey, o_orderdate, sha256(CAST(o_orderkey AS VARCHAR)) AS h FROM orders) ORDER BY o_orderdate DESC, h LIMIT 50")
def documents_newest(spark, sf_dir):
    """SRT3, SRT4."""
    rows = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.col("o_orderdate").alias("created_at"), store.fingerprint(F.col("o_orderkey").cast("string")).alias("sha256"))
    return store.newest_first(rows, 50).select("o_orderkey", "o_orderdate")


@query("SELECT doc_id, greatest(8.0, least(52.0, length(source || lang) + 2.0)) AS width, greatest(8.0, least(52.0, length(text) + (length(text) - length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'))) * 0.7 + 2.0)) AS text_width FROM documents")
def display_width(spark, sf_dir):
    """TXT14, SNK3."""
    return fx.table(spark, sf_dir, "documents").select("doc_id", text.display_width(F.concat("source", "lang")).alias("width"), text.display_width(F.col("text")).alias("text_width"))


# -- bands and geometry --------------------------------------------------------------------------

_ROW = "CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT)"
_BANDS = f"SELECT l_orderkey AS page_id, {_ROW} AS row_no, CAST(l_partkey % 400 AS INT) AS y0, CAST(l_partkey % 400 + l_quantity AS INT) AS y1, CAST(l_quantity AS INT) AS height FROM lineitem"


@query(f"""WITH b AS ({_BANDS}), c AS (SELECT page_id, y0, y1, count(*) AS n FROM b GROUP BY ALL),
m AS (SELECT *, max(y1) OVER (PARTITION BY page_id ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM c),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR y0 - p > 24 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS band FROM m)
SELECT page_id, CAST(band AS BIGINT) AS band, min(y0) AS y0, max(y1) AS y1, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY page_id, band""")
def band_merge(spark, sf_dir):
    """GEO5."""
    return bands.merged(fx.fixture(spark, sf_dir, _BANDS))


@query(f"WITH b AS ({_BANDS}) SELECT page_id, row_no, height, CAST(coalesce(sum(height + 48) OVER (PARTITION BY page_id ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS top FROM b")
def composite_offsets(spark, sf_dir):
    """GEO6."""
    return bands.stacked(fx.fixture(spark, sf_dir, _BANDS).select("page_id", "row_no", "height"))


@query(f"WITH b AS ({_BANDS}), n AS (SELECT page_id, row_no, row_number() OVER (PARTITION BY page_id ORDER BY row_no) AS number FROM b) SELECT page_id, row_no, CAST(number AS INT) AS number, CAST((number - 1) // 2 AS INT) AS chunk FROM n")
def row_chunks(spark, sf_dir):
    """GEO7."""
    return bands.chunked(fx.fixture(spark, sf_dir, _BANDS).select("page_id", "row_no"), 2)


_BOXES = f"SELECT l_orderkey AS page_id, {_ROW} AS box, CAST(floor(l_extendedprice) AS INT) % 400 AS y FROM lineitem"


@query(f"WITH b AS ({_BANDS}), x AS ({_BOXES}), m AS (SELECT x.page_id, x.box, b.row_no AS band, abs(x.y - (b.y0 + b.y1) / 2.0) AS distance FROM x JOIN b ON x.page_id = b.page_id) SELECT page_id, box, band, distance FROM (SELECT *, row_number() OVER (PARTITION BY page_id, box ORDER BY distance, band) AS rn FROM m) WHERE rn = 1")
def nearest_band(spark, sf_dir):
    """JN14."""
    of = fx.fixture(spark, sf_dir, _BANDS).select("page_id", F.col("row_no").alias("band"), ((F.col("y0") + F.col("y1")) / 2.0).alias("y"))
    return bands.nearest(fx.fixture(spark, sf_dir, _BOXES), of)


@query(f"WITH b AS ({_BANDS}), g AS (SELECT page_id, y0, y1 FROM b WHERE row_no = 1) SELECT page_id, row_no, y0, y1 FROM b WHERE row_no > 1 AND NOT EXISTS (SELECT 1 FROM g WHERE g.page_id = b.page_id AND b.y1 >= g.y0 - 48 AND b.y0 <= g.y1 + 48)")
def bands_outside_grids(spark, sf_dir):
    """FLT10."""
    rows = fx.fixture(spark, sf_dir, _BANDS)
    return bands.outside_grids(rows.where("row_no > 1"), rows.where("row_no = 1")).select("page_id", "row_no", "y0", "y1")


_RUNNING = f"SELECT l_orderkey AS page_id, l_returnflag AS key, {_ROW} AS ord, CAST(l_partkey % 100 AS DOUBLE) / 100 AS confidence FROM lineitem"


@query(f"WITH r AS ({_RUNNING}), m AS (SELECT *, max(confidence) OVER (PARTITION BY page_id, key ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM r) SELECT page_id, key, ord, confidence FROM m WHERE b IS NULL OR confidence > b")
def best_label_running_max(spark, sf_dir):
    """JN18."""
    return bands.improvements(fx.fixture(spark, sf_dir, _RUNNING))


_CELLS = "SELECT l_orderkey AS page_id, l_returnflag AS grid, l_linenumber AS pos, CAST(l_partkey % 10 AS VARCHAR(2)) AS digit, l_discount + 0.5 AS confidence, CAST(l_partkey % 300 AS INT) AS x0, CAST(l_suppkey % 300 AS INT) AS y0, CAST(l_partkey % 300 + 60 AS INT) AS x1, CAST(l_suppkey % 300 + 60 AS INT) AS y1 FROM lineitem"


@query(f"WITH c AS ({_CELLS}) SELECT page_id, grid, string_agg(digit, '' ORDER BY pos, digit) AS text, {_mean4('confidence')} AS confidence, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM c GROUP BY page_id, grid")
def digit_grid_reading(spark, sf_dir):
    """AGG14, GEO4."""
    return bands.grid_reading(fx.fixture(spark, sf_dir, _CELLS))


_TOKENS = "SELECT l_orderkey AS line_id, CAST(1 + l_partkey % 99 AS DOUBLE) / 100 AS p FROM lineitem"


@query(f"WITH t AS ({_TOKENS}) SELECT line_id, round(greatest(0.0, least(1.0, exp(avg(ln(p))))), 6) AS confidence FROM t GROUP BY line_id")
def token_likelihood(spark, sf_dir):
    """AGG13, MTH1."""
    return bands.likelihood(fx.fixture(spark, sf_dir, _TOKENS)).select("line_id", F.round("confidence", 6).alias("confidence"))


_ROIS = "SELECT p_partkey AS id, CAST(p_partkey % 11 AS DOUBLE) / 10 AS fx0, CAST(p_partkey % 7 AS DOUBLE) / 10 AS fy0, CAST(p_partkey % 13 AS DOUBLE) / 10 AS fx1, CAST(p_partkey % 5 AS DOUBLE) / 10 AS fy1, CAST(100 + p_size AS INT) AS w, CAST(200 + p_size AS INT) AS h FROM part"


@query(f"""WITH r AS ({_ROIS}), a AS (SELECT *, greatest(0, least(CAST(trunc(fx0 * w) AS INT), w - 1)) AS px0, greatest(0, least(CAST(trunc(fy0 * h) AS INT), h - 1)) AS py0 FROM r)
SELECT id, px0, py0, greatest(px0 + 1, least(CAST(trunc(fx1 * w) AS INT), w)) AS px1, greatest(py0 + 1, least(CAST(trunc(fy1 * h) AS INT), h)) AS py1 FROM a""")
def roi_pixels(spark, sf_dir):
    """GEO3."""
    px = geometry.to_pixels(F.col("fx0"), F.col("fy0"), F.col("fx1"), F.col("fy1"), F.col("w"), F.col("h"))
    return fx.fixture(spark, sf_dir, _ROIS).select("id", px.alias("p")).select("id", "p.*")


# -- replies -------------------------------------------------------------------------------------


@query(f"WITH r AS ({fx.REPLIES}) SELECT id, CASE id % 5 WHEN 0 THEN regexp_extract(reply, '\"text\": \"([^\"]*)\"', 1) WHEN 1 THEN trim(regexp_extract(reply, '\"text\": \"([^\"]*)\"', 1)) END AS text, CASE WHEN id % 5 IN (0, 1) THEN CAST(regexp_extract(reply, '\"confidence\": ([0-9.]+)', 1) AS DOUBLE) END AS confidence, CASE id % 5 WHEN 2 THEN 'no text' WHEN 3 THEN 'confidence out of range' WHEN 4 THEN 'no object' END AS error FROM r")
def vlm_reply_parse(spark, sf_dir):
    """JSN1, STR4."""
    return fx.fixture(spark, sf_dir, fx.REPLIES).select("id", vision.field_reply(F.col("reply")).alias("p")).select("id", "p.*")


@query(f"WITH r AS ({fx.GRID_REPLIES}) SELECT id, CAST(id % 6 AS INT) AS row, regexp_extract(reply, '\"text\": \"([^\"]*)\"', 1) AS text, CAST(concat('0.', CAST(10 + id % 80 AS VARCHAR)) AS DOUBLE) AS confidence FROM r WHERE id % 6 BETWEEN 1 AND 4 UNION ALL SELECT id, 3, 'x', 0.0 FROM r")
def grid_reply_parse(spark, sf_dir):
    """JSN2."""
    return vision.grid_reply(fx.fixture(spark, sf_dir, fx.GRID_REPLIES), "reply", 1, 4)


# -- functions without SQL -----------------------------------------------------------------------


def _alternatives() -> str:
    return ", ".join(f"('{c}', {k}, '{o}')" for c, others in decode.AS_TEXT.items() for k, o in enumerate(others, 1))


_READ_AS = "SELECT p_partkey, concat_ws(' ', p_name, p_brand, p_type) AS reading FROM part"
_WORDLIKE = "A-Za-zÀ-ÖØ-öø-ÿ0-9&@''-"
_OPTIONS = "SELECT x.c, 0 AS k, x.c AS o FROM (SELECT DISTINCT unnest(string_split(word, '')) AS c FROM word) x UNION ALL SELECT * FROM alt"


@query(f"""WITH RECURSIVE r AS ({_READ_AS}), alt(c, k, o) AS (VALUES {_alternatives()}), pair(p) AS (VALUES {", ".join(f"('{p}')" for p in decode.FREQUENT)}),
start AS (SELECT unnest(string_split('abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZàâäéèêëîïôöùûüçœÀÂÄÉÈÊËÎÏÔÖÙÛÜÇ'' -0123456789', '')) AS c),
weight AS (SELECT c, 0.5 + (SELECT count(*) FROM (SELECT unnest(string_split(p, '')) AS l FROM pair WHERE length(p) = 2) WHERE l = c) AS w FROM start),
share AS (SELECT c, w / (SELECT sum(w) FROM weight) AS s FROM weight),
part_of AS (SELECT reading, k, piece FROM (SELECT reading, unnest(range(1, len(l) + 1)) AS k, unnest(l) AS piece FROM (SELECT DISTINCT reading, regexp_extract_all(reading, '[{_WORDLIKE}]+|[^{_WORDLIKE}]+') AS l FROM r))),
word AS (SELECT DISTINCT piece AS word FROM part_of WHERE regexp_matches(piece, '^[\\p{{L}}\\p{{N}}]') AND regexp_matches(piece, '[{"".join(decode.AS_TEXT)}]')),
opt AS (SELECT c, k, o, CAST(CASE WHEN n = 1 THEN ln(0.99) WHEN k = 0 THEN ln(0.1) ELSE ln(0.9 / (n - 1)) END AS DOUBLE) AS e FROM (SELECT *, count(*) OVER (PARTITION BY c) AS n FROM ({_OPTIONS}))),
chain AS (SELECT word, 1 AS i, o AS text, [k] AS ks, e AS score FROM word JOIN opt ON opt.c = word[1]
 UNION ALL SELECT word, i + 1, text || o, list_append(ks, opt.k), score + e + 0.5 * ln(greatest(((1.6 * coalesce(s, 0) + CASE WHEN p IS NULL THEN 0 ELSE 1 END) + 1e-9) / (1 + {len(decode.FREQUENT)} + 1e-9), 1e-9))
 FROM chain JOIN opt ON opt.c = word[i + 1] LEFT JOIN share ON share.c = lower(o) LEFT JOIN pair ON p = lower(text[i]) || lower(o) WHERE i < length(word)),
best AS (SELECT word, text FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY round(score, 9) DESC, ks) AS rn FROM chain WHERE i = length(word)) WHERE rn = 1),
v AS (SELECT reading, string_agg(coalesce(text, piece), '' ORDER BY k) AS value FROM part_of LEFT JOIN best ON word = piece GROUP BY reading),
f AS (SELECT reading, value, length(regexp_replace(value, '[^abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZàâäéèêëîïôöùûüçœÀÂÄÉÈÊËÎÏÔÖÙÛÜÇ'' 0-9-]', '', 'g')) AS known, len(regexp_extract_all(value, '\\s{{2,}}')) AS ragged FROM v)
SELECT p_partkey, value, round_even(least(1.0, known / length(value) * (0.85 + 0.15 * exp(-0.5 * ragged))), 4) AS confidence, value <> r.reading AS changed FROM r JOIN f ON f.reading = r.reading""")
def char_decode(spark, sf_dir):
    """TXT13, TXT9, SRT6: different values once, joined back to all rows. Its SQL tries all chains of a word."""
    part = fx.fixture(spark, sf_dir, _READ_AS)
    known = part.select("reading").distinct().withColumn("d", decode.decoder_column("text")(F.col("reading")))
    return part.join(known, "reading").select("p_partkey", "d.value", "d.confidence", "d.changed")


def _ratios(pairs: str) -> str:
    """CTEs seg and ratio(p, n, ratio): the Ratcliff-Obershelp ratio of the pairs (p, n): the longest common block, the first in p and then in n, and the
    same on either side of it."""
    return f"""seg AS (SELECT p, n, 0 AS a0, length(p) AS a1, 0 AS b0, length(n) AS b1, 0 AS size FROM (SELECT DISTINCT p, n FROM {pairs})
 UNION ALL SELECT p, n, c.a0, c.a1, c.b0, c.b1, c.size FROM (
  SELECT p, n, unnest([{{'a0': a0, 'a1': i, 'b0': b0, 'b1': j, 'size': k}}, {{'a0': i + k, 'a1': a1, 'b0': j + k, 'b1': b1, 'size': 0}}]) AS c FROM (
   SELECT *, row_number() OVER (PARTITION BY p, n, a0, a1, b0, b1 ORDER BY k DESC, i, j) AS rn FROM (
    SELECT *, unnest(range(1, least(a1 - i, b1 - j) + 1)) AS k FROM (SELECT *, unnest(range(b0, b1)) AS j FROM (SELECT *, unnest(range(a0, a1)) AS i FROM seg)))
   WHERE substr(p, i + 1, k) = substr(n, j + 1, k)) WHERE rn = 1)),
ratio AS (SELECT p, n, 2.0 * sum(size) / (length(p) + length(n)) AS ratio FROM seg GROUP BY p, n)"""


_SCHOOLS = ", ".join(f"('{n}', {k})" for k, n in enumerate(fields.SCHOOLS))


@query(f"""WITH RECURSIVE school(n, ord) AS (VALUES {_SCHOOLS}), t AS (SELECT p_partkey, upper(regexp_replace(p_type, '[^A-Za-z0-9]', '', 'g')) AS probe FROM part), pairs AS (SELECT DISTINCT probe AS p, n FROM t, school WHERE length(probe) >= 2), {_ratios('pairs')},
best AS (SELECT p, first(n ORDER BY ratio DESC, ord) AS school FROM ratio JOIN school USING (n) WHERE ratio >= {fields.SCHOOL_RATIO} GROUP BY p)
SELECT p_partkey, probe, school FROM t LEFT JOIN best ON p = probe""")
def acronym_nearest(spark, sf_dir):
    """JN13, TXT8, TXT12."""
    part = fx.table(spark, sf_dir, "part").select("p_partkey", text.tidy_acronym(F.col("p_type")).alias("probe"))
    known = part.select("probe").distinct().withColumn("school", decode.nearest_column(fields.SCHOOLS, fields.SCHOOL_RATIO)(F.col("probe")))
    return part.join(known, "probe").select("p_partkey", "probe", "school")


_SLIPS = f"""SELECT p_partkey, concat(CASE p_partkey % 4 WHEN 0 THEN translate(name, 'IOE', '103') WHEN 1 THEN substr(name, 1, CAST(p_partkey % 7 AS INT) + 2) WHEN 2 THEN concat(substr(name, 2), substr(p_type, 1, 1)) ELSE name END,
CASE WHEN p_size % 5 = 0 THEN CAST(p_size AS VARCHAR(3)) ELSE '' END) AS probe FROM (SELECT p_partkey, p_type, p_size, {"CASE p_partkey % " + str(len(fields.SCHOOLS)) + " " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(fields.SCHOOLS))} END AS name FROM part) x"""


@query(f"""WITH RECURSIVE school(n, ord) AS (VALUES {_SCHOOLS}), t AS ({_SLIPS}), pairs AS (SELECT DISTINCT probe AS p, n FROM t, school), {_ratios('pairs')},
best AS (SELECT p, first(n ORDER BY ratio DESC, ord) AS name, max(ratio) AS ratio FROM ratio JOIN school USING (n) WHERE ratio >= {fields.SCHOOL_RATIO} GROUP BY p)
SELECT p_partkey, probe, name, CAST(round(ratio, 6) AS DOUBLE) AS ratio FROM t JOIN best ON p = probe""")
def acronym_slips(spark, sf_dir):
    """JN11, JN13: acronyms with slips, their nearest official one by bounds: different probes once, joined back to all rows."""
    rows = fx.fixture(spark, sf_dir, _SLIPS)
    names = spark.createDataFrame([(n, k) for k, n in enumerate(fields.SCHOOLS)], "name string, ord int")
    return rows.join(similar.best(spark, rows, names, fields.SCHOOL_RATIO), "probe").select("p_partkey", "probe", "name", F.round("ratio", 6).alias("ratio"))


@query()
def noisy_dates(spark, sf_dir):
    """DT2, DT4, DT5, DT6."""
    rows = fx.fixture(spark, sf_dir, fx.WRITTEN).select("id", F.translate("value", "08", "OB").alias("value"))
    return rows.select("id", dates.best_date_column("value").alias("d")).select("id", "d.*")


@query("SELECT o_orderkey AS page_id, CAST(0 AS INT) AS occurrence, 'nom' AS key, o_orderpriority AS value, CAST(0.9 AS DOUBLE) AS confidence FROM orders UNION ALL SELECT o_orderkey, 1, 'prenom', concat('c', CAST(o_custkey AS VARCHAR)), 0.8 FROM orders WHERE 500 + o_orderkey % 4 * 100 - 260 <= 400")
def greedy_pairing(spark, sf_dir):
    """JN6: two labels of a line compete for the nearer value; the first in reading order takes it, the other the next within reach."""
    found = pairing.greedy_pages(pairing.normalised(fx.items(spark, sf_dir, fx.CONTESTED)).drop("box"))
    return found.select("page_id", "occurrence", "key", "value", "confidence")


_ANALYSED = f"""WITH k AS (SELECT o_orderkey AS page_id, o_orderkey % 7 AS r7, CAST(60 + o_orderkey % 40 AS DOUBLE) / 100 AS c, lpad(CAST(o_orderkey % 10000000 AS VARCHAR), 7, '0') AS n, CAST(100 + o_orderkey % 900 AS VARCHAR) AS s,
lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') AS t FROM orders),
f AS (SELECT page_id, 'cin' AS key, concat(CASE WHEN r7 = 0 THEN '0' ELSE '1' END, n) AS value, CASE WHEN r7 = 0 THEN greatest(c, 0.92) ELSE c END AS confidence FROM k
UNION ALL SELECT page_id, 'serie', s, CASE WHEN r7 = 1 THEN greatest(c, 0.92) ELSE c END FROM k
UNION ALL SELECT page_id, 'identifiant', concat(s, t), CASE WHEN r7 = 1 THEN greatest(c, 0.92) ELSE c END FROM k UNION ALL SELECT page_id, 'duree', '2h30', 0.97 FROM k)
SELECT page_id, key, value, confidence, {_status()} AS status FROM f"""


@query(_ANALYSED)
def form_analysis(spark, sf_dir):
    """The chain of sections 2.4, 2.6, 2.7 and 2.10 over whole pages: JN6, JN7, JN9, TXT5, TXT7, all rules: numbers with a letter for their
    head, and series and identifiers that a printed block puts right."""
    return forms.analysed(fx.items(spark, sf_dir, fx.SHEETS)).select("page_id", "key", "value", "confidence", "status")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_counts(spark, sf_dir):
    """STR1, STR3: the same counts as a batch, through a file stream that ends with what is there."""
    import uuid

    from ..streaming import jobs

    schema = fx.table(spark, sf_dir, "events").schema
    base = f"{jobs.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = f"{sf_dir}/events.parque[t]"  # as a pattern it may be a file or a folder
    jobs.start(spark, source, schema, lambda df: df.groupBy("event_type").agg(F.count("*").alias("n")), f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.sum("n").alias("n"))
