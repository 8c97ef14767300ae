"""Keyed state with timers, stream-stream joins and two outputs in one commit: each equals its batch form, in any order of files and over restarts."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from inkplan.operators import batches
from inkplan.streaming import outputs, overlay, states

START = datetime(2026, 1, 1, tzinfo=timezone.utc)


def at(seconds: float) -> datetime:
    return START + timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    yield states.configured(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def run(spark, make, source, schema: str, out, ck, mode: str, per_trigger: int = 1):
    stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(str(source)))
    query = stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: df.withColumn("n", F.lit(n)).write.mode("append").parquet(str(out))).option("checkpointLocation", str(ck)).trigger(availableNow=True).start()
    query.awaitTermination(300)
    return query


EVENTS = "file_id long, seq long, state string, ts timestamp"


def state_rows(query) -> int:
    return [p["stateOperators"][0]["numRowsTotal"] for p in map(lambda p: json.loads(p.json), query.recentProgress) if p["stateOperators"]][-1]


def test_file_states_over_a_restart(rocks, tmp_path):
    rng = random.Random(5)
    rows = [(f, s, rng.choice(["pending", "processing", "processing", "done", "error", "cancelled"]), at(10 * s + rng.randint(0, 9))) for f in range(25) for s in range(rng.randint(1, 5))]
    rows += [(40, 0, "processing", at(5)), (None, 1, "done", at(1)), (41, None, "done", at(1))]
    events = rocks.createDataFrame(rows, EVENTS)
    want = {r.file_id: r.state for r in batches.latest_state(events.dropna()).collect()}
    rng.shuffle(rows)  # files in any order
    for k in range(2):
        rocks.createDataFrame(rows[k::3], EVENTS).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    make = lambda df: states.states(df, timedelta(minutes=10), timedelta(hours=1), timedelta(days=1))
    run(rocks, make, tmp_path / "in/*", EVENTS, tmp_path / "out", tmp_path / "ck", "update")
    rocks.createDataFrame(rows[2::3], EVENTS).coalesce(1).write.parquet(str(tmp_path / "in/2"))
    later = [(99, 0, "pending", at(3600)), (99, 1, "done", at(3601))]  # moves the watermark on
    rocks.createDataFrame(later, EVENTS).coalesce(1).write.parquet(str(tmp_path / "in/3"))
    run(rocks, make, tmp_path / "in/*", EVENTS, tmp_path / "out", tmp_path / "ck", "update")
    got = {r.file_id: r.state for r in rocks.read.parquet(str(tmp_path / "out")).where("not given_up").groupBy("file_id").agg(F.max_by("state", F.struct("n", "seq")).alias("state")).collect()}
    assert {f: s for f, s in got.items() if f != 99} == want
    # An event after a final one changes nothing while the mark is kept; days later marks and idle files are gone.
    closed = next(f for f, s in want.items() if s in states.FINAL)
    rocks.createDataFrame([(closed, 9, "processing", at(3700)), (98, 0, "done", at(5000))], EVENTS).coalesce(1).write.parquet(str(tmp_path / "in/4"))
    rocks.createDataFrame([(97, 0, "done", at(4 * 86400))], EVENTS).coalesce(1).write.parquet(str(tmp_path / "in/5"))
    query = run(rocks, make, tmp_path / "in/*", EVENTS, tmp_path / "out", tmp_path / "ck", "update")
    out = rocks.read.parquet(str(tmp_path / "out")).collect()
    assert max((r.n, r.state) for r in out if r.file_id == closed)[1] == want[closed]
    assert {r.file_id for r in out if r.given_up} == {f for f, s in want.items() if s not in states.FINAL}
    assert state_rows(query) <= 4  # the newest file's own


EDITS = "page_id long, key string, seq long, value string, ts timestamp"


def test_debounced_edits(rocks, tmp_path):
    rng = random.Random(6)
    rows = [(p, k, n, rng.choice("abc"), at(rng.choice([0, 0.3, 0.6, 1.0, 1.7, 2.4, 2.5, 9.0, 9.7, 9.701]) + 20 * p)) for n, (p, k) in enumerate((p, k) for p in range(6) for k in ("nom", "cin") for _ in range(6))]
    rows += [(1, None, 1, "x", at(0)), (1, "nom", 1, "x", None)]
    want = sorted(tuple(r) for r in states.debounced_batch(rocks.createDataFrame(rows, EDITS)).collect())
    assert 12 <= len(want) < len(rows)
    rng.shuffle(rows)
    for k in range(3):
        rocks.createDataFrame(rows[k::3], EDITS).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    rocks.createDataFrame([(0, "end", 0, "", at(86400))], EDITS).coalesce(1).write.parquet(str(tmp_path / "in/3"))
    run(rocks, states.debounced, tmp_path / "in/*", EDITS, tmp_path / "out", tmp_path / "ck", "append")
    assert sorted((r.page_id, r.key, r.seq, r.value) for r in rocks.read.parquet(str(tmp_path / "out")).where("key != 'end'").collect()) == want


FOUND = "page_id long, key string, value string, status string, confidence double, ts timestamp"


def test_results_meet_edits_as_they_come(spark, tmp_path):
    rng = random.Random(8)
    found = [(p, k, f"v{p}", rng.choice(["valid", "error"]), round(rng.random(), 2), at(60 * p)) for p in range(20) for k in ("nom", "cin")] + [(None, "nom", "x", "valid", 0.5, at(1))]
    edits = [(p, rng.choice(["nom", "cin", "serie"]), rng.choice(["", "e1", "e2"]), n, at(60 * p + rng.randint(0, 600))) for n, p in enumerate(rng.choices(range(25), k=60))] + [(1, None, "x", 1, at(1)), (1, "nom", "x", 1, None)]
    table = spark.createDataFrame(found, FOUND).dropna(subset=["page_id"])
    over = batches.overrides_edited(spark.createDataFrame([], "page_id long, key string, value string"), spark.createDataFrame(edits, EDITS.replace("key string, seq long, value string", "key string, value string, seq long")).dropna(subset=["key", "ts"]))
    key = lambda df: sorted(tuple(r) for r in df.collect())
    rng.shuffle(found)
    rng.shuffle(edits)
    schema = "page_id long, key string, value string, seq long, ts timestamp"
    for k in range(3):
        spark.createDataFrame(found[k::3], FOUND).coalesce(1).write.parquet(str(tmp_path / f"found/{k}"))
        spark.createDataFrame(edits[k::3], schema).coalesce(1).write.parquet(str(tmp_path / f"edits/{k}"))
    for day in (1, 2):  # moves both watermarks on
        spark.createDataFrame([(-day, "end", "", "", 0.0, at(86400 * day))], FOUND).coalesce(1).write.parquet(str(tmp_path / f"found/{2 + day}"))
        spark.createDataFrame([(-9 - day, "end", "", 0, at(86400 * day))], schema).coalesce(1).write.parquet(str(tmp_path / f"edits/{2 + day}"))

    def make(stream):
        edited = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "edits/*"))
        return overlay.joined(stream, edited, timedelta(hours=2), timedelta(hours=1))

    run(spark, make, tmp_path / "found/*", FOUND, tmp_path / "out", tmp_path / "ck", "append")
    rows = spark.read.parquet(str(tmp_path / "out")).where("page_id >= 0")
    assert key(overlay.detail(rows)) == key(batches.overlaid(table, over)) and key(overlay.export(rows)) == key(batches.overlaid_for_export(table, over))
    assert key(overlay.detail(overlay.joined(table, spark.createDataFrame(edits, schema)))) == key(batches.overlaid(table, over))  # as tables


def judged(df):
    return df.withColumn("error", F.when(F.col("name").endswith(".exe"), "extension").when((F.col("name") == "late.png") & (F.col("attempts") < 3), "not yet"))


def test_two_outputs_in_one_commit(spark, tmp_path):
    target = str(tmp_path / "t")
    rows = spark.createDataFrame([("a.png", 1), ("b.exe", 2), ("late.png", 3)], "name string, size int")
    assert outputs.accepted(spark, target) is None and outputs.again(spark, judged, target, "r0") is False

    class Killed(Exception):
        pass

    def killed():
        raise Killed

    with pytest.raises(Killed):
        outputs.commit(spark, rows, judged, target, "0", between=killed)
    assert outputs.accepted(spark, target) is None  # one output was written, and nobody sees it
    assert outputs.commit(spark, rows, judged, target, "0") and not outputs.commit(spark, rows, judged, target, "0")
    names = lambda df: sorted(r.name for r in df.collect())
    assert names(outputs.accepted(spark, target)) == ["a.png"] and names(outputs.refused(spark, target)) == ["b.exe", "late.png"]
    for k, (yes, no) in enumerate([(["a.png"], {"b.exe": 2, "late.png": 2}), (["a.png", "late.png"], {"b.exe": 3}), (["a.png", "late.png"], {"b.exe": 3})], 1):
        assert outputs.again(spark, judged, target, f"r{k}")
        assert names(outputs.accepted(spark, target)) == yes and {r.name: r.attempts for r in outputs.refused(spark, target).collect()} == no
    assert outputs.refused(spark, target).first().error == "extension"
    assert outputs.swept(spark, target) == 4 and names(outputs.accepted(spark, target)) == ["a.png", "late.png"] and outputs.swept(spark, target) == 0


def test_two_outputs_of_a_stream(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(f"{k}.png", 1), (f"{k}.exe", 1)], "name string, size int").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = lambda: spark.readStream.schema("name string, size int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    calls = []

    def flaky(df):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("executor lost")
        return judged(df)

    with pytest.raises(Exception, match="executor lost"):
        outputs.start(spark, stream(), flaky, str(tmp_path / "t"), str(tmp_path / "ck")).awaitTermination(120)
    outputs.start(spark, stream(), judged, str(tmp_path / "t"), str(tmp_path / "ck")).awaitTermination(120)
    assert sorted(r.name for r in outputs.accepted(spark, str(tmp_path / "t")).collect()) == ["0.png", "1.png", "2.png"]
    assert sorted(r.name for r in outputs.refused(spark, str(tmp_path / "t")).collect()) == ["0.exe", "1.exe", "2.exe"]
