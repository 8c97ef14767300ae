"""Registered queries of what streams keep up to date: the batch forms that tests hold the streams against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batches
from ..streaming import overlay, states
from . import fixtures as fx
from .entries import query

_STATE_EVENTS = """SELECT user_id * 40 + event_id % 40 AS file_id, event_id AS seq, CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 11 = 0 THEN 'cancelled'
WHEN event_id % 7 = 0 THEN 'done' WHEN event_id % 3 = 0 THEN 'pending' ELSE 'processing' END AS state, ts FROM events"""


@query(f"""WITH e AS ({_STATE_EVENTS}), p AS (SELECT *, lag(CASE WHEN state <> 'cancelled' THEN state END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY seq) AS before FROM e),
f AS (SELECT *, state IN ('done', 'error') OR state = 'cancelled' AND coalesce(before, 'pending') = 'pending' AS final FROM p)
SELECT file_id, coalesce(arg_min(state, seq) FILTER (final), arg_max(state, seq) FILTER (state <> 'cancelled'), 'pending') AS state FROM f GROUP BY file_id""")
def file_states(spark, sf_dir):
    """STR2."""
    return batches.latest_state(fx.fixture(spark, sf_dir, _STATE_EVENTS))


_EDITS = "SELECT user_id AS page_id, event_type AS key, event_id AS seq, CASE WHEN event_id % 4 = 0 THEN '' ELSE props END AS value, ts FROM events"


@query(f"""WITH e AS (SELECT *, epoch_ms(ts) AS ms FROM ({_EDITS})), n AS (SELECT *, lead(ms) OVER (PARTITION BY page_id, key ORDER BY ms, seq) AS nxt FROM e)
SELECT page_id, key, seq, value FROM n WHERE nxt IS NULL OR nxt > ms + 3600000""")
def edits_debounced(spark, sf_dir):
    """STR5: an edit stands if none of its field follows within an hour."""
    return states.debounced_batch(fx.fixture(spark, sf_dir, _EDITS).withColumn("ts", F.col("ts").cast("timestamp")), states.timedelta(hours=1))


_FOUND = "SELECT o_orderkey AS page_id, CASE WHEN o_custkey % 2 = 0 THEN 'nom' ELSE 'cin' END AS key, o_orderpriority AS value, CASE WHEN o_orderkey % 5 = 0 THEN 'error' ELSE 'valid' END AS status, CAST(o_custkey % 90 AS DOUBLE) / 100 AS confidence, o_orderdate AS ts FROM orders"
_CHANGED = "SELECT l_orderkey AS page_id, CASE WHEN l_partkey % 3 = 0 THEN 'nom' WHEN l_partkey % 3 = 1 THEN 'cin' ELSE 'serie' END AS key, CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE l_returnflag || l_linestatus END AS value, l_linenumber * 1000000 + l_partkey AS seq, l_shipdate AS ts FROM lineitem"


@query(f"""WITH f AS ({_FOUND}), c AS ({_CHANGED}), e AS (SELECT f.page_id, f.key, arg_max(c.value, (c.seq, c.value)) AS value FROM f JOIN c ON c.page_id = f.page_id AND c.key = f.key GROUP BY ALL)
SELECT f.page_id, f.key, coalesce(nullif(e.value, ''), f.value) AS value, CASE WHEN coalesce(e.value, '') <> '' THEN 'valid' ELSE f.status END AS status, coalesce(e.value, '') <> '' AS edited FROM f LEFT JOIN e ON e.page_id = f.page_id AND e.key = f.key""")
def results_with_edits(spark, sf_dir):
    """STR1, OVL1: readings and their edits. Edits of the sixty days after a reading meet it in the join, all others where its rows are read."""
    timed = lambda sql: fx.fixture(spark, sf_dir, sql).withColumn("ts", F.col("ts").cast("timestamp"))
    return overlay.detail(overlay.joined(timed(_FOUND), timed(_CHANGED), within=states.timedelta(days=60)))
