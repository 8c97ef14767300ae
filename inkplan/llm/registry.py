"""The queries of the training-data operators, one for each operator, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import bpe, licences, lm, neardup, packing, periods, pseudonyms, quality, spelling, suffixes, superkmers, telephony, tokencounts
from .common import documents, unkeyed


def op1_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.read(telephony.store(documents(spark, sf_dir)), pcm=False)


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    back = bpe.decoded(bpe.encoded(documents(spark, sf_dir), path), path)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rules = quality.learn(docs, documents(spark, sf_dir, "labels"))
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    return quality.judge(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("rule") == 0)).alias("kept"), "rule",
    )


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, key=corpus_pipeline.key(spark), count_col="n_replaced")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(spark, documents(spark, sf_dir), percent=85)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.digests(spark, documents(spark, sf_dir))
    return out.withColumn("doc_id", unkeyed())


def op10_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = superkmers.digests(spark, documents(spark, sf_dir))
    return out.withColumn("doc_id", unkeyed())


def op4_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(spark, documents(spark, sf_dir))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digests(documents(spark, sf_dir))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.forms(spark, documents(spark, sf_dir))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_telephony": op1_telephony,
    "op2_licences": op2_licences,
    "op3_packing": op3_packing,
    "op4_recurrent_lm": op4_recurrent_lm,
    "op5_quality": op5_quality,
    "op6_bpe": op6_bpe,
    "op7_pseudonyms": op7_pseudonyms,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_super_kmers": op10_super_kmers,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_spelling": op12_spelling,
    "op13_token_counts": op13_token_counts,
    "pipeline": corpus_pipeline.run,
}

_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
#: What orders texts of one doc_id, as common.text_key().
_KEY = "CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT)"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _runs(width: int) -> str:
    """CTEs u (runs of covered units [a, b) of each row r) and v (what stands before each run and after the last), from hit(r, p): the places of
    the windows that are repeated, and d(r, n): the units of each row."""
    return f"""j AS (SELECT r, p, coalesce(p - lag(p) OVER (PARTITION BY r ORDER BY p) > {width}, true) AS begins FROM hit),
    k AS (SELECT r, p, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS run FROM j),
    u AS (SELECT r, min(p) AS a, max(p) + {width} AS b FROM k GROUP BY r, run),
    v AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS f, a AS e FROM u UNION ALL SELECT d.r, coalesce(max(b), 0), any_value(d.n) FROM d LEFT JOIN u ON d.r = u.r GROUP BY d.r)"""


#: The CRC-32 table, and the CRC-32 of a string of ASCII characters and code points U+00C0 to U+00FF, with table t's list t.
_CRC_TABLE = "SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, (c & 1) * 3988292384)) AS c FROM range(256) AS r(b))"
_BYTES = "flatten(list_transform(string_split({}, ''), lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [195, CAST(ord(x) - 64 AS BIGINT)] END))"
_CRC = f"xor(list_reduce(list_prepend(4294967295, {_BYTES}), lambda c, b: xor(c >> 8, t.t[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295)"


#: Equal windows are found by their MD5 here, so that the oracle's hash is another than the operators'.
ORACLE_SQL: dict[str, str] = {
    "op8_near_duplicates": f"""WITH RECURSIVE w AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS LAST, {_KEY}) AS r, {_WORDS.format(_LOWER)} AS l FROM documents),
    s AS (SELECT r, md5(array_to_string(l[i:i + 4], ' ')) AS s FROM (SELECT r, l, unnest(range(1, greatest(len(l) - 4, least(len(l), 1)) + 1)) AS i FROM w) GROUP BY ALL),
    n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
    x AS (SELECT p.r AS a, q.r AS b, count(*) AS c FROM s p JOIN s q ON p.s = q.s AND p.r < q.r GROUP BY a, b),
    e AS (SELECT a, b FROM x JOIN n m ON m.r = a JOIN n o ON o.r = b WHERE 100 * c >= 85 * (m.n + o.n - c)),
    g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    reach AS (SELECT a, b FROM g UNION SELECT r.a, g.b FROM reach r JOIN g ON r.b = g.a),
    c AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
    SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, h.doc_id AS component_id, h.r = w.r AS kept
    FROM w LEFT JOIN n ON n.r = w.r LEFT JOIN c ON c.a = w.r JOIN w h ON h.r = least(w.r, coalesce(c.b, w.r))""",
    "op9_suffix_dedup": f"""WITH t AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS FIRST, {_KEY}) AS r, hex(encode(coalesce(text, ''))) AS h FROM documents), d AS (SELECT *, length(h) // 2 AS n FROM t),
    w AS (SELECT r, p, md5_number(substr(h, 2 * p + 1, {2 * suffixes.WINDOW})) AS m FROM (SELECT r, h, unnest(range(n - {suffixes.WINDOW - 1})) AS p FROM d)),
    hit AS (SELECT r, p FROM (SELECT r, p, row_number() OVER (PARTITION BY m ORDER BY r, p) AS k FROM w) WHERE k > 1), {_runs(suffixes.WINDOW)},
    q AS (SELECT v.r, string_agg(substr(h, 2 * f + 1, 2 * (e - f)), '' ORDER BY f, e) AS left FROM v JOIN d ON d.r = v.r GROUP BY v.r)
    SELECT doc_id, n AS n_bytes, n - length(q.left) // 2 AS n_removed, (SELECT count(*) FROM u WHERE u.r = d.r) AS n_spans, sha256(unhex(q.left)) AS kept_sha256 FROM d JOIN q ON d.r = q.r""",
    "op10_super_kmers": f"""WITH t AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS FIRST, {_KEY}) AS r, {_WORDS.format("coalesce(text, '')")} AS l FROM documents), d AS (SELECT *, len(l) AS n FROM t),
    w AS (SELECT r, p, md5_number(array_to_string(l[p + 1:p + {superkmers.WINDOW}], ' ')) AS m FROM (SELECT r, l, unnest(range(n - {superkmers.WINDOW - 1})) AS p FROM d)),
    hit AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY m) AS k FROM w) WHERE k > 1), {_runs(superkmers.WINDOW)},
    q AS (SELECT v.r, string_agg(array_to_string(l[f + 1:e], ' '), ' ' ORDER BY f, e) FILTER (e > f) AS left, sum(e - f) AS n FROM v JOIN d ON d.r = v.r GROUP BY v.r)
    SELECT doc_id, d.n AS n_words, CAST(d.n - q.n AS BIGINT) AS n_removed, sha256(coalesce(q.left, '')) AS kept_sha256 FROM d JOIN q ON d.r = q.r""",
    "op11_periodic_runs": f"""WITH t AS ({_CRC_TABLE}), b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, {_WORDS.format("coalesce(text, '')")} AS l, {_CRC.format("CAST(doc_id AS VARCHAR)")} AS h FROM documents, t),
    c AS (SELECT *, len(l) AS n, h % 10 = 0 AS ch, h // 10 AS g, CASE WHEN len(l) > 0 THEN (h // 10) % len(l) END AS a FROM b), d AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM c),
    w AS (SELECT r, n, i, CASE WHEN ch AND i >= a THEN l[a + (i - a) % p + 1] ELSE l[i + 1] END AS w FROM (SELECT *, unnest(range(n)) AS i FROM d)),
    g AS (SELECT r, n, i, md5_number(w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o) AS m FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
    e AS (SELECT x.r, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.r = y.r AND x.m = y.m AND y.i > x.i WHERE 4 * (y.i - x.i) <= x.n),
    k AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM e),
    u AS (SELECT r, min(i) AS s, q, count(*) + 2 + q AS n FROM k GROUP BY r, q, island HAVING count(*) + 2 + q >= greatest(6, 4 * q)),
    v AS (SELECT r, s, n, min(q) AS q FROM u GROUP BY r, s, n),
    f AS (SELECT r, count(*) AS n_runs, first(s ORDER BY n DESC, s, q) AS s, first(n ORDER BY n DESC, s, q) AS n, first(q ORDER BY n DESC, s, q) AS q, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS runs FROM v GROUP BY r),
    x AS (SELECT DISTINCT r, unnest(range(s + q, s + n)) AS i FROM v),
    y AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS left FROM w ANTI JOIN x USING (r, i) GROUP BY r)
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, f.n AS length, q AS period, 1000 * f.n // q AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(y.left, '')) AS collapsed_sha256
    FROM d LEFT JOIN f ON f.r = d.r LEFT JOIN y ON y.r = d.r""",
    "op12_spelling": f"""WITH RECURSIVE t AS ({_CRC_TABLE}),
    b AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]{{7,}}')) AS run FROM documents) GROUP BY ALL),
    h AS (SELECT run, n, {_CRC.format("doc_id || ':' || run")} AS h FROM b, t),
    c AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
    w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM c WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
    d AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS v FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
    e AS (SELECT x.word AS a, y.word AS b FROM d x JOIN d y ON x.i = y.i AND x.v = y.v AND x.word <> y.word UNION SELECT d.word, w.word FROM d JOIN w ON d.v = w.word UNION SELECT w.word, d.word FROM d JOIN w ON d.v = w.word),
    s AS (SELECT a, count(*) AS n_near, first(b ORDER BY w.n DESC, b) AS b, max(w.n) AS m FROM e JOIN w ON w.word = e.b GROUP BY a),
    f AS (SELECT a, s.b AS form, m FROM s JOIN w ON w.word = s.a WHERE m >= 10 * w.n),
    far AS (SELECT a, form, 1 AS k FROM f UNION ALL SELECT far.a, f.form, k + 1 FROM far JOIN f ON f.a = far.form), l AS (SELECT a, arg_max(form, k) AS root FROM far GROUP BY a)
    SELECT w.word, f.form, coalesce(l.root, w.word) AS root, w.n, coalesce(s.n_near, 0) AS n_near, f.m AS form_n FROM w LEFT JOIN s ON s.a = w.word LEFT JOIN f ON f.a = w.word LEFT JOIN l ON l.a = w.word""",
}
