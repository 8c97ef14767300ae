"""OCR items and other inputs derived from the driver's tables, in SQL that both engines run unchanged."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Label and value items of a page for each customer: see form_pairing_risk.
ITEMS = """
SELECT page_id, item_idx, text, confidence, x0, y0, x1, y1 FROM (
  WITH k AS (SELECT c_custkey AS page_id, c_name, c_custkey % 7 AS r7, c_custkey % 40 AS r40 FROM customer)
  SELECT page_id, 0 AS item_idx, 'N° CIN :' AS text, CAST(0.97 AS DOUBLE) AS confidence, 50 AS x0, 100 AS y0, 260 AS x1, 134 AS y1 FROM k
  UNION ALL
  SELECT page_id, 1, CASE WHEN r7 = 0 THEN concat('O', lpad(CAST((page_id * 7919) % 10000000 AS VARCHAR(10)), 7, '0'))
                          ELSE lpad(CAST((page_id * 7919 * 13) % 100000000 AS VARCHAR(10)), 8, '0') END,
         CAST(60 + r40 AS DOUBLE) / 100, 280, 100, 520, 134 FROM k
  UNION ALL
  SELECT page_id, 2, 'Nom :', CAST(0.97 AS DOUBLE), 50, 160, 260, 194 FROM k
  UNION ALL
  SELECT page_id, 3, c_name, CAST(60 + r40 AS DOUBLE) / 100, CASE WHEN r7 = 3 THEN 700 ELSE 280 END, 160, 940, 194 FROM k) u
"""

#: A label with its value below it, at three distances.
BELOW = """
SELECT page_id, item_idx, text, confidence, x0, y0, x1, y1 FROM (
  WITH k AS (SELECT c_custkey AS page_id, c_name, CASE c_custkey % 3 WHEN 0 THEN 40 WHEN 1 THEN 180 ELSE 320 END AS dy FROM customer)
  SELECT page_id, 0 AS item_idx, 'Nom :' AS text, CAST(0.97 AS DOUBLE) AS confidence, 50 AS x0, 100 AS y0, 260 AS x1, 134 AS y1 FROM k
  UNION ALL SELECT page_id, 1, c_name, CAST(0.9 AS DOUBLE), 50, 134 + dy, 260, 168 + dy FROM k
  UNION ALL SELECT page_id, 2, 'Epreuve de', CAST(0.97 AS DOUBLE), 800, 100, 1010, 134 FROM k
  UNION ALL SELECT page_id, 3, concat('sujet ', c_name), CAST(0.9 AS DOUBLE), 800, 134 + dy, 1010, 168 + dy FROM k) u
"""

#: A date label with a text and a date on its line; the date is the farther one for odd orders.
DATED = """
SELECT page_id, item_idx, text, confidence, x0, y0, x1, y1 FROM (
  WITH k AS (SELECT o_orderkey AS page_id, o_orderpriority, o_orderkey % 2 AS odd, 1 + o_orderkey % 28 AS d, 1 + o_orderkey % 12 AS m, 1960 + o_orderkey % 50 AS y FROM orders)
  SELECT page_id, 0 AS item_idx, 'Date' AS text, CAST(0.97 AS DOUBLE) AS confidence, 50 AS x0, 100 AS y0, 260 AS x1, 134 AS y1 FROM k
  UNION ALL SELECT page_id, 1, o_orderpriority, CAST(0.9 AS DOUBLE), CAST(280 + 100 * (1 - odd) AS INT), 100, 500, 134 FROM k
  UNION ALL SELECT page_id, 2, concat(lpad(CAST(d AS VARCHAR(4)), 2, '0'), '/', lpad(CAST(m AS VARCHAR(4)), 2, '0'), '/', CAST(y AS VARCHAR(4))),
                   CAST(0.9 AS DOUBLE), CAST(280 + 100 * odd AS INT), 100, 500, 134 FROM k) u
"""

#: A number label, a number beside it with a wrong head and another one elsewhere; and a printed block.
NUMBERS = """
SELECT page_id, item_idx, text, confidence, x0, y0, x1, y1 FROM (
  WITH k AS (SELECT o_orderkey AS page_id, o_orderkey % 9 AS r9, lpad(CAST((o_orderkey * 104729) % 10000000 AS VARCHAR(10)), 7, '0') AS n, CAST(100 + o_orderkey % 900 AS VARCHAR(4)) AS s,
                    lpad(CAST(o_orderkey % 1000 AS VARCHAR(4)), 3, '0') AS t FROM orders)
  SELECT page_id, 0 AS item_idx, 'N° CIN' AS text, CAST(0.97 AS DOUBLE) AS confidence, 50 AS x0, 100 AS y0, 260 AS x1, 134 AS y1 FROM k
  UNION ALL SELECT page_id, 1, concat('8', n), CAST(0.9 AS DOUBLE), 280, 100, 520, 134 FROM k
  UNION ALL SELECT page_id, 2, concat('0', n), CAST(0.8 AS DOUBLE), 280, 400, 520, 434 FROM k WHERE r9 <> 4
  UNION ALL SELECT page_id, 3, concat(s, ' ', CASE WHEN r9 = 5 THEN '000' ELSE s END, t), CAST(40 + page_id % 60 AS DOUBLE) / 100, 700, 20, 990, 54 FROM k) u
"""

#: Fields of a form for each order: series, identifier (every ninth one wrong), anonymity code, booklets, duration, exam date, name.
FIELDS = """
SELECT page_id, occurrence, key, value, confidence FROM (
  WITH k AS (SELECT o_orderkey AS page_id, o_orderkey % 9 AS r9, o_orderkey % 5 AS r5, CAST(100 + o_orderkey % 900 AS VARCHAR(4)) AS s, lpad(CAST(o_orderkey % 1000 AS VARCHAR(4)), 3, '0') AS t,
                    CAST(60 + o_orderkey % 40 AS DOUBLE) / 100 AS confidence, o_orderpriority AS p FROM orders)
  SELECT page_id, 0 AS occurrence, 'serie' AS key, CASE WHEN r5 = 4 THEN concat(s, 'A') ELSE s END AS value, confidence FROM k
  UNION ALL SELECT page_id, 1, 'identifiant', concat(CASE WHEN r9 = 0 THEN '999' ELSE s END, t, CASE WHEN r9 = 1 THEN '7' ELSE '' END), confidence FROM k
  UNION ALL SELECT page_id, 2, 'anonyme', concat(s, ' ', s, CASE WHEN r9 = 2 THEN '000' ELSE t END), confidence FROM k
  UNION ALL SELECT page_id, 3, 'nombre_cahiers', CAST(r9 AS VARCHAR(4)), confidence FROM k
  UNION ALL SELECT page_id, 4, 'duree', CASE r5 WHEN 0 THEN '2h30' WHEN 1 THEN '4 Heures' WHEN 2 THEN 'deux heures' WHEN 3 THEN 'x' ELSE '3' END, confidence FROM k
  UNION ALL SELECT page_id, 5, 'nom', CASE r5 WHEN 0 THEN 'Béji' WHEN 1 THEN 'Ben-Ali' WHEN 2 THEN 'D1d1' WHEN 3 THEN 'x' ELSE p END, confidence FROM k
  UNION ALL SELECT page_id, 6, 'session', 'Session 2026', confidence FROM k) u
"""

#: Dates as written on forms.
WRITTEN = """
SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN concat(y, '-', m, '-', d) WHEN 1 THEN concat(d, '/', m, '/', y) ELSE concat('Lundi ', d, ' ', name, ' ', y, ' à 8 H') END AS value
FROM (SELECT o_orderkey, CAST(1940 + o_orderkey % 80 AS VARCHAR(4)) AS y, lpad(CAST(1 + o_orderkey % 12 AS VARCHAR(2)), 2, '0') AS m, lpad(CAST(1 + o_orderkey % 31 AS VARCHAR(2)), 2, '0') AS d,
             CASE o_orderkey % 4 WHEN 0 THEN 'Janvier' WHEN 1 THEN 'février' WHEN 2 THEN 'Août' ELSE 'décembre' END AS name FROM orders) o
"""

#: Files of jobs: a customer's orders.
FILES = """
SELECT o_custkey AS job_id, o_orderkey AS file_id, concat('scan_', CAST(o_orderkey AS VARCHAR(12)), '.png') AS name, CAST(o_orderkey % 100 AS DOUBLE) / 100 AS confidence,
       CASE WHEN o_orderkey % 11 = 0 THEN 'cancelled' WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'error' END AS status FROM orders
"""

#: Overrides of fields, some of fields that no page has.
OVERRIDES = """
SELECT o_orderkey AS page_id, CASE o_orderkey % 3 WHEN 0 THEN 'nom' WHEN 1 THEN 'serie' ELSE 'epreuve' END AS key, concat('edited ', CAST(o_orderkey AS VARCHAR(12))) AS value FROM orders WHERE o_orderkey % 4 = 0
"""

#: Identities, with a registry of candidates in which some numbers and names differ.
IDENTITIES = """
SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN lpad(CAST(c_custkey AS VARCHAR(12)), 8, '0') END AS cin, c_name AS nom, c_mktsegment AS prenom, CASE c_custkey % 3 WHEN 0 THEN '2024/2025' ELSE '2023/2024' END AS session_year FROM customer
"""
REGISTRY = """
SELECT lpad(CAST(c_custkey AS VARCHAR(12)), 8, '0') AS cin, CASE WHEN c_custkey % 5 = 0 THEN 'other' ELSE c_name END AS nom, c_mktsegment AS prenom, '2024/2025' AS session_year FROM customer WHERE c_custkey % 7 <> 0
"""

#: Replies of a vision model.
REPLIES = """
SELECT event_id AS id, CASE event_id % 5
  WHEN 0 THEN concat('{"text": "', event_type, '", "confidence": 0.', CAST(10 + event_id % 80 AS VARCHAR(4)), '}')
  WHEN 1 THEN concat('Here: ', chr(10), '{"text": " ', event_type, ' ", "confidence": 0.5} done') WHEN 2 THEN '{"text": "", "confidence": 0.5}'
  WHEN 3 THEN concat('{"text": "', event_type, '", "confidence": 1.7}') ELSE 'none' END AS reply FROM events
"""
GRID_REPLIES = """
SELECT event_id AS id, concat('{"rows": [{"row": ', CAST(event_id % 6 AS VARCHAR(2)), ', "text": "', event_type, '", "confidence": 0.', CAST(10 + event_id % 80 AS VARCHAR(4)), '}, {"row": 3, "text": "x", "confidence": 7.5}]}') AS reply FROM events
"""

#: Two labels on a line, and two values right of both; the farther value is out of the second label's reach on some pages.
CONTESTED = """
SELECT page_id, item_idx, text, confidence, x0, y0, x1, y1 FROM (
  WITH k AS (SELECT o_orderkey AS page_id, o_orderpriority, concat('c', CAST(o_custkey AS VARCHAR(12))) AS clerk, CAST(500 + o_orderkey % 4 * 100 AS INT) AS x FROM orders)
  SELECT page_id, 0 AS item_idx, 'Nom' AS text, CAST(0.97 AS DOUBLE) AS confidence, 50 AS x0, 100 AS y0, 150 AS x1, 134 AS y1 FROM k
  UNION ALL SELECT page_id, 1, 'Prénom', CAST(0.97 AS DOUBLE), 160, 100, 260, 134 FROM k
  UNION ALL SELECT page_id, 2, o_orderpriority, CAST(0.9 AS DOUBLE), 280, 100, 400, 134 FROM k
  UNION ALL SELECT page_id, 3, clerk, CAST(0.8 AS DOUBLE), x, 100, x + 100, 134 FROM k) u
"""

#: Sheets with a national number, at times with a letter for its head; series and identifier, at times misread beside a printed block; a duration.
SHEETS = """
SELECT page_id, item_idx, text, confidence, x0, y0, x1, y1 FROM (
  WITH k AS (SELECT o_orderkey AS page_id, o_orderkey % 7 AS r7, CAST(60 + o_orderkey % 40 AS DOUBLE) / 100 AS c, lpad(CAST(o_orderkey % 10000000 AS VARCHAR(10)), 7, '0') AS n,
                    CAST(100 + o_orderkey % 900 AS VARCHAR(4)) AS s, lpad(CAST(o_orderkey % 1000 AS VARCHAR(4)), 3, '0') AS t FROM orders)
  SELECT page_id, 0 AS item_idx, 'N° CIN' AS text, CAST(0.97 AS DOUBLE) AS confidence, 50 AS x0, 100 AS y0, 260 AS x1, 134 AS y1 FROM k
  UNION ALL SELECT page_id, 1, concat(CASE WHEN r7 = 0 THEN 'O' ELSE '1' END, n), c, 280, 100, 520, 134 FROM k
  UNION ALL SELECT page_id, 2, 'Série', CAST(0.97 AS DOUBLE), 50, 160, 260, 194 FROM k
  UNION ALL SELECT page_id, 3, CASE WHEN r7 = 1 THEN '7777' ELSE s END, c, 280, 160, 520, 194 FROM k
  UNION ALL SELECT page_id, 4, 'Identifiant', CAST(0.97 AS DOUBLE), 50, 220, 260, 254 FROM k
  UNION ALL SELECT page_id, 5, CASE WHEN r7 = 1 THEN '777712' ELSE concat(s, t) END, c, 280, 220, 520, 254 FROM k
  UNION ALL SELECT page_id, 6, 'Durée : 2h30', CAST(0.97 AS DOUBLE), 50, 280, 260, 314 FROM k
  UNION ALL SELECT page_id, 7, concat(s, ' ', s, t), CAST(0.9 AS DOUBLE), 700, 20, 990, 54 FROM k) u
"""

TABLES = ("customer", "supplier", "nation", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of one of the texts above; only the tables that it names are opened, under names of their own that go once the text is analysed."""
    own = uuid.uuid4().hex
    used = [name for name in TABLES if re.search(rf"FROM {name}\b", sql)]
    for name in used:
        table(spark, sf_dir, name).createOrReplaceTempView(f"{name}_{own}")
    try:
        return spark.sql(re.sub(rf"FROM ({'|'.join(TABLES)})\b", rf"FROM \1_{own}", sql))
    finally:
        for name in used:
            spark.catalog.dropTempView(f"{name}_{own}")


def items(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Items with their box as a polygon."""
    return fixture(spark, sf_dir, sql).selectExpr(
        "page_id", "item_idx", "text", "confidence", "array(array(x0, y0), array(x1, y0), array(x1, y1), array(x0, y1)) AS box"
    )
