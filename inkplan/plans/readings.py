"""Registered queries, continued: geometry of detections, rows of a form, digit windows, text clean-up, replies in JSON, and the report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import decode, geometry, text
from ..operators import bands, batches, report, rules, store
from ..sources import readers
from ..streaming import jobs
from . import fixtures as fx
from .catalogue import _ROW, _mean4, _status
from .entries import query

_REQUESTS = "SELECT user_id AS request_id, CASE event_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'error' ELSE 'ok' END AS status, CASE event_id % 5 WHEN 0 THEN 'engine' WHEN 1 THEN 'invalid' WHEN 2 THEN 'timeout' WHEN 3 THEN 'missing' ELSE 'other' END AS kind, event_id FROM events"


@query(f"WITH r AS ({_REQUESTS}) SELECT request_id, count(*) AS total, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status <> 'ok') AS errors FROM r GROUP BY request_id")
def response_totals(spark, sf_dir):
    """AGG6."""
    return batches.response_totals(fx.fixture(spark, sf_dir, _REQUESTS))


@query(f"WITH r AS ({_REQUESTS}) SELECT event_id, CAST(CASE kind WHEN 'engine' THEN 503 WHEN 'invalid' THEN 400 WHEN 'timeout' THEN 504 WHEN 'missing' THEN 404 ELSE 500 END AS INT) AS status FROM r")
def error_status(spark, sf_dir):
    """APP1b."""
    return fx.fixture(spark, sf_dir, _REQUESTS).select("event_id", batches.http_status(F.col("kind")).alias("status"))


@query("SELECT conv_id, turn, upper(role) || '.pdf' AS name FROM conversations WHERE role IN ('user', 'assistant')")
def client_filter(spark, sf_dir):
    """FLT12: the upload form's filter is that of the upload."""
    rows = fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.upper("role"), F.when(F.col("role").isin("user", "assistant"), ".pdf").otherwise(".exe")).alias("name"))
    return rows.where(batches.upload_error(F.col("name"), F.lit(1)).isNull())


_PAGE_ITEMS = "SELECT l_orderkey AS file_id, l_suppkey % 3 AS page, l_partkey AS item_idx, CASE WHEN l_linenumber % 4 = 0 THEN '' ELSE concat('t', CAST(l_partkey AS VARCHAR(12))) END AS text, CAST(l_partkey % 50 AS DOUBLE) / 50 AS confidence FROM lineitem"
_PAGE_TIMES = "SELECT o_orderkey AS file_id, o_custkey % 3 AS page, CAST(o_custkey AS DOUBLE) * 1.25 AS elapsed_ms FROM orders"


@query(f"""WITH i AS ({_PAGE_ITEMS}), t AS ({_PAGE_TIMES}), p AS (SELECT file_id, page, string_agg(text, chr(10) ORDER BY item_idx, text) FILTER (text <> '') AS text, {_mean4('confidence')} AS confidence FROM i GROUP BY file_id, page)
SELECT t.file_id, t.page, coalesce(p.text, '') AS text, coalesce(p.confidence, 0.0) AS confidence, round(t.elapsed_ms, 2) AS elapsed_ms FROM t LEFT JOIN p ON t.file_id = p.file_id AND t.page = p.page""")
def page_assembly(spark, sf_dir):
    """PRJ4."""
    return batches.assembled(fx.fixture(spark, sf_dir, _PAGE_ITEMS), fx.fixture(spark, sf_dir, _PAGE_TIMES))


@query(f"""WITH f AS ({fx.FILES}) SELECT job_id, count(*) AS total, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'error') AS error, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'pending') AS pending,
CAST(count(*) FILTER (status IN ('done', 'error')) AS DOUBLE) / greatest(1, count(*)) AS progress, coalesce({_mean4("CASE WHEN status = 'done' THEN confidence END")}, 0.0) AS average FROM f GROUP BY job_id""")
def job_summaries(spark, sf_dir):
    """PRJ3."""
    return batches.job_summary(fx.fixture(spark, sf_dir, fx.FILES))


_KNOWN = "SELECT c_custkey AS cin FROM customer WHERE c_custkey % 2 = 0"
_GIVEN = "SELECT o_custkey AS cin FROM orders"


@query(f"WITH k AS ({_KNOWN}), g AS (SELECT DISTINCT cin FROM ({_GIVEN})) SELECT count(*) FILTER (cin NOT IN (SELECT cin FROM k)) AS inserted, count(*) FILTER (cin IN (SELECT cin FROM k)) AS updated FROM g")
def upsert_counts(spark, sf_dir):
    """AGG15."""
    return store.upsert_counts(fx.fixture(spark, sf_dir, _KNOWN), fx.fixture(spark, sf_dir, _GIVEN), ["cin"])


# -- geometry ------------------------------------------------------------------------------------

_QUADS = "SELECT l_orderkey AS id, l_linenumber AS line, CAST(l_partkey % 97 AS DOUBLE) AS a, CAST(l_suppkey % 89 AS DOUBLE) AS b, CAST(l_partkey % 83 AS DOUBLE) / 4 AS c, CAST(l_suppkey % 79 AS DOUBLE) / 4 AS d, l_extendedprice AS e FROM lineitem"
_POINTS = [("a", "b"), ("100 + c", "d"), ("90 + d", "110 + a"), ("c", "120 - d")]


def _quad():
    return F.expr("array(" + ", ".join(f"array(cast({x} as double), cast({y} as double))" for x, y in _POINTS) + ")")


@query(f"WITH q AS ({_QUADS}) SELECT id, line, e, " + ", ".join(f"CAST(round_even({x}, 0) AS INT) AS x{k}, CAST(round_even({y}, 0) AS INT) AS y{k}" for k, (x, y) in enumerate(_POINTS)) + " FROM q")
def int_boxes(spark, sf_dir):
    """GEO9."""
    rows = fx.fixture(spark, sf_dir, _QUADS).withColumn("p", geometry.int_box(_quad()))
    return rows.select("id", "line", "e", *[F.col("p")[k][i].alias(f"{c}{k}") for k in range(4) for i, c in enumerate("xy")])


_CORNERS = ["x + y", "y - x", "-(x + y)", "x - y"]
_SIDE = "sqrt(({0}x - {1}x) * ({0}x - {1}x) + ({0}y - {1}y) * ({0}y - {1}y))"


@query(f"""WITH q AS (SELECT *, row_number() OVER () AS n FROM ({_QUADS})), p AS ({" UNION ALL ".join(f"SELECT id, line, e, n, {k} AS k, {x} AS x, {y} AS y FROM q" for k, (x, y) in enumerate(_POINTS))}),
s AS (SELECT id, line, e, n, {", ".join(f"arg_min(x, ({by}) * 64 + k) AS c{i}x, arg_min(y, ({by}) * 64 + k) AS c{i}y" for i, by in enumerate(_CORNERS))} FROM p GROUP BY ALL)
SELECT id, line, e, {", ".join(f"c{i}x, c{i}y" for i in range(4))}, CAST(floor(greatest({_SIDE.format("c0", "c1")}, {_SIDE.format("c2", "c3")})) AS INT) AS width, CAST(floor(greatest({_SIDE.format("c0", "c3")}, {_SIDE.format("c1", "c2")})) AS INT) AS height FROM s""")
def crop_corners(spark, sf_dir):
    """GEO8."""
    rows = fx.fixture(spark, sf_dir, _QUADS).withColumn("p", geometry.clockwise(_quad())).withColumn("s", geometry.crop_size(_quad()))
    return rows.select("id", "line", "e", *[F.col("p")[k][i].alias(f"c{k}{c}") for k in range(4) for i, c in enumerate("xy")], "s.width", "s.height")


_ROI_JSON = "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN concat('{\"nom\": [0.1, 0.2, 0.', CAST(3 + p_partkey % 6 AS VARCHAR(2)), ', 0.9], \"bad\": [1, 2]}') WHEN 1 THEN '{\"cin\": [0, 0, 1, 1], \"x\": [0, null, 1, 1]}' ELSE 'junk' END AS profile FROM part"


@query(f"WITH p AS ({_ROI_JSON}) SELECT id, 'nom' AS name, CAST(0.1 AS DOUBLE) AS x0, CAST(0.2 AS DOUBLE) AS y0, CAST(concat('0.', CAST(3 + id % 6 AS VARCHAR)) AS DOUBLE) AS x1, CAST(0.9 AS DOUBLE) AS y1 FROM p WHERE id % 3 = 0 UNION ALL SELECT id, 'cin', 0.0, 0.0, 1.0, 1.0 FROM p WHERE id % 3 = 1")
def roi_profiles(spark, sf_dir):
    """SRC11: the usable entries of profiles."""
    rows = fx.fixture(spark, sf_dir, _ROI_JSON).select("id", F.explode(readers.rois(F.col("profile"))).alias("name", "r"))
    return rows.select("id", "name", *[F.col("r")[k].alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))])


# -- rows of a form ------------------------------------------------------------------------------

_NUMBERED = f"SELECT l_orderkey AS page_id, {_ROW} AS number, l_partkey AS part, CAST(l_quantity AS INT) AS height FROM lineitem"
_READ = f"SELECT l_orderkey AS page_id, {_ROW} + 1 AS number, l_returnflag AS text FROM lineitem"


@query(f"WITH b AS ({_NUMBERED}), r AS ({_READ}) SELECT r.page_id, r.number, r.text, b.part, b.height FROM r LEFT JOIN b ON r.page_id = b.page_id AND r.number = b.number")
def band_metadata(spark, sf_dir):
    """JN15: a reading of a row that no band has keeps nulls."""
    return bands.with_metadata(fx.fixture(spark, sf_dir, _READ), fx.fixture(spark, sf_dir, _NUMBERED)).select("page_id", "number", "text", "part", "height")


_TOPS = f"SELECT l_orderkey AS page_id, {_ROW} AS row_no, CAST(l_partkey % 60 AS INT) AS top FROM lineitem"
_TOPPED = f"SELECT l_orderkey AS page_id, {_ROW} AS item, CAST(l_suppkey % 60 AS INT) AS top FROM lineitem"


@query(f"WITH t AS ({_TOPS}), i AS ({_TOPPED}) SELECT i.page_id, i.item, min(t.row_no) AS row_no FROM i JOIN t ON i.page_id = t.page_id AND abs(i.top - t.top) < 8 GROUP BY i.page_id, i.item")
def item_rows(spark, sf_dir):
    """JN16."""
    return bands.same_row(fx.fixture(spark, sf_dir, _TOPPED), fx.fixture(spark, sf_dir, _TOPS))


@query(f"SELECT page_id, key, value FROM ({fx.FIELDS}) f WHERE key NOT IN ('cin', 'serie', 'identifiant', 'zone_signature', 'anonyme')")
def rows_read_again(spark, sf_dir):
    """FLT11."""
    return bands.readable_again(fx.fixture(spark, sf_dir, fx.FIELDS)).select("page_id", "key", "value")


_LINES = "SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN concat('Nom : ', c_name) WHEN 1 THEN 'Nom : ...' WHEN 2 THEN c_mktsegment WHEN 3 THEN ' ' ELSE 'Série：' END AS text FROM customer"


@query(f"WITH k AS ({_LINES}) SELECT id, id % 5 IN (1, 3, 4) AS again, id % 5 = 0 AS has_value FROM k")
def rows_without_value(spark, sf_dir):
    """REC6 (which rows are read again), FLT5."""
    t = F.col("text")
    return fx.fixture(spark, sf_dir, _LINES).select("id", bands.incomplete(t).alias("again"), (text.has_colon(t) & text.has_value(t)).alias("has_value"))


_ENTRIES = f"SELECT l_orderkey AS page_id, CAST(l_partkey % 300 AS INT) AS y0, CAST(l_suppkey % 300 AS INT) AS x0, {_ROW} AS item FROM lineitem"


@query(f"WITH e AS ({_ENTRIES}) SELECT page_id, string_agg(CAST(item AS VARCHAR), ',' ORDER BY y0, x0, item) AS items FROM e GROUP BY page_id")
def reading_order(spark, sf_dir):
    """GEO10."""
    pages = fx.fixture(spark, sf_dir, _ENTRIES).groupBy("page_id").agg(F.collect_list(F.struct("y0", "x0", "item")).alias("e"))
    return pages.select("page_id", F.array_join(F.transform(bands.reading_order(F.col("e")), lambda s: s["item"].cast("string")), ",").alias("items"))


_ZONES = "SELECT o_orderkey AS page_id, CAST(o_orderkey % 10 AS DOUBLE) / 1000 AS ink FROM orders WHERE o_orderkey % 3 = 0"
_SIGNED = f"SELECT page_id, occurrence, key, value, confidence, {_status()} AS status FROM ({fx.FIELDS}) f UNION ALL SELECT o_orderkey, 7, 'zone_signature', 'x', 0.9, 'valid' FROM orders WHERE o_orderkey % 2 = 0"


@query(f"""WITH f AS ({_SIGNED}), z AS ({_ZONES}), b AS (SELECT page_id FROM z WHERE ink < 0.004)
SELECT f.page_id, key, value, confidence, CASE WHEN key = 'zone_signature' AND f.page_id IN (SELECT page_id FROM b) THEN 'error' ELSE status END AS status FROM f
UNION ALL SELECT page_id, 'zone_signature', '', 0.0, 'error' FROM b WHERE page_id % 2 = 1""")
def signatures(spark, sf_dir):
    """VAL13."""
    return rules.signature_missing(fx.fixture(spark, sf_dir, _SIGNED), fx.fixture(spark, sf_dir, _ZONES)).select("page_id", "key", "value", "confidence", "status")


# -- digits, words, JSON -------------------------------------------------------------------------

_SPACED = "SELECT c_custkey AS id, concat('x', CAST(c_custkey AS VARCHAR(12)), CASE c_custkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN '-' WHEN 2 THEN 'a' ELSE ' / ' END, concat(CAST(10 + c_nationkey AS VARCHAR(4)), '-', CAST(100 + c_custkey % 900 AS VARCHAR(4)), '-', CAST(c_custkey % 1000 AS VARCHAR(4))), ' ', CAST(c_custkey * 7919 AS VARCHAR(14))) AS value FROM customer"


@query(rf"""WITH k AS ({_SPACED}), g AS (SELECT id, gs[j] AS g, j FROM (SELECT id, gs, unnest(range(1, len(gs) + 1)) AS j FROM (SELECT id, regexp_extract_all(value, '[0-9]+(?:[ \t./|,\-]+[0-9]+)*') AS gs FROM k))),
c AS (SELECT id, j, i, substr(g, i, 1) AS ch, i = 1 OR NOT regexp_matches(substr(g, i - 1, 1), '[0-9]') AS opens, i = length(g) OR NOT regexp_matches(substr(g, i + 1, 1), '[0-9]') AS closes FROM (SELECT *, unnest(range(1, length(g) + 1)) AS i FROM g)),
d AS (SELECT id, j, ch, opens, closes, row_number() OVER (PARTITION BY id, j ORDER BY i) AS n FROM c WHERE regexp_matches(ch, '[0-9]')),
w AS (SELECT a.id, a.j, a.n, a.opens, z.closes, (SELECT string_agg(ch, '' ORDER BY n) FROM d x WHERE x.id = a.id AND x.j = a.j AND x.n BETWEEN a.n AND a.n + 7) AS win FROM d a JOIN d z ON a.id = z.id AND a.j = z.j AND z.n = a.n + 7),
r AS (SELECT id, unnest(regexp_extract_all(value, '[0-9]+')) AS win FROM k)
SELECT id, win, CAST((NOT opens)::INT + (NOT closes)::INT AS INT) AS penalty FROM w WHERE opens OR closes UNION ALL SELECT id, win, 0 FROM r WHERE abs(length(win) - 8) <= 1""")
def digit_windows(spark, sf_dir):
    """TXT10."""
    rows = fx.fixture(spark, sf_dir, _SPACED).select("id", F.explode(decode.digit_windows_column(F.col("value"), 8, 1)).alias("w"))
    return rows.select("id", F.col("w.window").alias("win"), "w.penalty")


@query("""SELECT c_custkey AS id, upper(regexp_replace(c_name || ' ' || c_mktsegment, '[^A-Za-z0-9]', '', 'g')) AS acronym, 'Customer ' || c_mktsegment AS name, CASE WHEN length(regexp_replace(CAST(c_custkey AS VARCHAR) || c_mktsegment, '[^A-Za-z]', '', 'g')) < greatest(2.0, length(CAST(c_custkey AS VARCHAR) || c_mktsegment) * 0.6) THEN true ELSE false END AS parasite,
c_mktsegment AS place FROM customer""")
def tidy_words(spark, sf_dir):
    """TXT12, TXT16, FLT8."""
    both = F.concat_ws(" ", "c_name", "c_mktsegment")
    out = fx.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return out.select(
        F.col("c_custkey").alias("id"), text.tidy_acronym(both).alias("acronym"), text.tidy_name(both).alias("name"), text.has_parasite(F.concat(F.col("c_custkey").cast("string"), "c_mktsegment")).alias("parasite"),
        text.last_place(F.concat_ws(" ", F.lit("né à"), "c_mktsegment", F.lit("le"))).alias("place"),
    )


_ITEM_JSON = "SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN concat('[{\"text\": \"', event_type, '\", \"confidence\": 0.5}, {\"text\": \"b\", \"confidence\": 1.0}]') WHEN 1 THEN concat('{\"items\": [{\"text\": \"', event_type, '\", \"confidence\": 0.25}]}') ELSE 'junk' END AS body FROM events"


@query(f"WITH r AS ({_ITEM_JSON}), e AS (SELECT event_id AS id, event_type FROM events) SELECT id, CAST(0 AS INT) AS item_idx, event_type AS text, CAST(CASE id % 3 WHEN 0 THEN 0.5 ELSE 0.25 END AS DOUBLE) AS confidence FROM e WHERE id % 3 < 2 UNION ALL SELECT id, 1, 'b', 1.0 FROM e WHERE id % 3 = 0")
def item_json(spark, sf_dir):
    """SRC7, ARR2: items from an array or from an object that holds one."""
    return readers.item_json(fx.fixture(spark, sf_dir, _ITEM_JSON), "body").select("id", "item_idx", "text", "confidence")


@query("SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    """Windows with a watermark, on a batch: counts of events by half hours."""
    return jobs.windowed(fx.table(spark, sf_dir, "events"))


# -- the report ----------------------------------------------------------------------------------

_JOB_PAGES = "SELECT o_orderkey AS page_id, o_orderkey AS file_id, CAST(o_orderkey % 3 AS INT) AS page, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS text FROM orders"
_JOB_FILES = f"SELECT file_id, name AS file_name, status, confidence FROM ({fx.FILES}) f"
_JOB_FIELDS = "SELECT o_orderkey AS page_id, CAST(0 AS INT) AS occurrence, 'cin' AS label, CASE WHEN o_orderkey % 4 = 0 THEN 'K!' ELSE lpad(CAST(o_orderkey AS VARCHAR(12)), 8, '0') END AS text FROM orders WHERE o_orderkey % 2 = 0"


@query(f"""WITH f AS ({_JOB_FILES}), p AS ({_JOB_PAGES}), c AS ({_JOB_FIELDS}), o AS ({fx.OVERRIDES}),
x AS (SELECT p.page_id, f.file_name, p.page, p.text, f.confidence, coalesce(c.text, '') AS cin, coalesce((SELECT value FROM o WHERE o.page_id = p.page_id AND o.key = 'nom'), '') AS nom, coalesce((SELECT value FROM o WHERE o.page_id = p.page_id AND o.key = 'serie'), '') AS serie
FROM p JOIN f ON p.file_id = f.file_id LEFT JOIN c ON c.page_id = p.page_id WHERE f.status = 'done')
SELECT page_id, file_name, CAST(CASE WHEN page > 0 THEN page ELSE 1 END AS INT) AS page, nom, cin, serie, confidence, CASE WHEN confidence >= 0.85 AND (cin = '' OR regexp_matches(cin, '^[A-Za-z0-9]{{4,}}$')) AND (nom <> '' OR cin <> '' OR trim(text) <> '') THEN 'Validé (Auto)' ELSE 'À réviser' END AS verdict FROM x""")
def report_job(spark, sf_dir):
    """SNK1, SNK3, SNK4: finished files' pages, with edited texts in place of read ones."""
    job = [fx.fixture(spark, sf_dir, x) for x in (_JOB_FILES, _JOB_PAGES, _JOB_FIELDS, fx.OVERRIDES)]
    out = report.job_report(*job, "01/01/2026 00:00")
    return out.select(
        "page_id", F.col("Nom du Fichier").alias("file_name"), F.col("N° Page").alias("page"), F.col("Nom").alias("nom"), F.col("CIN").alias("cin"), F.col("Série").alias("serie"),
        F.col("Indice de Confiance Global (%)").alias("confidence"), F.col("Statut Validation").alias("verdict"),
    )

