"""The store of results and the runs that fill it."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from noticeloom.plans import run_queue
from noticeloom.sources.store import Store

RESULT = "struct<value:int>"
ROW = run_queue.schema(RESULT)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), ROW)


def row(k, at, value, doc="d", error=None):
    return (doc, k, at, 1, None if value is None else (value,), error)


def put(spark, store, *rows):
    df = spark.createDataFrame([(d, k, a, n, o, e) for d, k, a, n, o, e in rows], ROW.replace("processed_at timestamp", "processed_at string"))
    return store.put(df.withColumn("processed_at", F.col("processed_at").cast("timestamp")))


def values(df):
    return {(r.document_key, r.record_key): r.ocr and r.ocr.value for r in df.collect()}


def test_newest_rows_through_compactions(spark, store):
    assert store.load().count() == 0 and store.version()[0] == 0
    put(spark, store, row("a", "2026-01-01", 1), row("b", "2026-01-01", 1))
    put(spark, store, row("a", "2026-01-02", 2), row("a", "2026-01-02", 2), row("a", "2026-01-01", 9, doc="e"))
    want = {("d", "a"): 2, ("d", "b"): 1, ("e", "a"): 9}
    assert values(store.load()) == want and store.compact() and values(store.load()) == want
    put(spark, store, row("b", "2026-01-03", 3))
    for _ in range(3):  # the folders that are removed are in the snapshots
        assert values(store.load()) == want | {("d", "b"): 3} and store.compact()
    assert len(store._names("log")) <= 1 and len(store._names("snapshots")) == 2
    plan = store.load("d")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(document_key" in plan and values(store.load("d")) == {("d", "a"): 2, ("d", "b"): 3}


def test_equal_times_give_one_row_always(spark, store):
    put(spark, store, row("a", "2026-01-01", 1))
    put(spark, store, row("a", "2026-01-01", 2))
    first = values(store.load())
    assert store.compact() and values(store.load()) == first and len(first) == 1


def test_writers_that_stop_or_meet_lose_nothing(spark, store):
    put(spark, store, row("a", "2026-01-01", 1))
    broken = put(spark, store, row("a", "2026-01-09", 99))
    store.files.delete(store.hadoop.Path(f"{store.path}/log/{broken}/_SUCCESS"), False)  # a write that did not end
    assert values(store.load()) == {("d", "a"): 1}
    other = Store(spark, store.path, ROW)
    number = store.version()[0]
    other.version = lambda: (number, {"snapshot": None, "holds": []})  # it looked before the first compaction
    put(spark, store, row("b", "2026-01-02", 2))
    assert store.compact() and not other.compact()
    assert values(store.load()) == {("d", "a"): 1, ("d", "b"): 2} and store.version()[0] == 1


def records(spark, n=40):
    return spark.range(n).select(F.lit("doc").alias("document_key"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("record_key"), F.col("id").cast("int").alias("n"))


def test_failures_keep_their_result_and_are_tried_again(spark, store):
    own = records(spark, 12)
    first = run_queue.Run(store, RESULT, waves=2).go(own, ["n"], lambda r: {"value": 60 // (r["n"] % 4)})
    assert (first.todo, first.done, first.failed, first.wave, first.stopped) == (12, 9, 3, 2, False)
    second = run_queue.Run(store, RESULT, waves=1).go(own, ["n"], lambda r: {"value": -1})  # only what has no result
    assert (second.todo, second.done) == (3, 3)
    again = run_queue.Run(store, RESULT, waves=1).go(own.where("n < 2"), ["n"], lambda r: 1 / 0, rerun=True)
    assert (again.todo, again.failed) == (2, 2)
    got = {r.n: (r.ocr.value, r.error and r.error[:4], r.attempt) for r in run_queue.restored(own, store).collect()}
    assert got[0] == (-1, "Zero", 3) and got[1] == (60, "Zero", 2) and got[4] == (-1, None, 2) and got[5] == (60, None, 1)


def test_a_stopped_run_goes_on_where_it_was(spark, store):
    def slow(r):
        time.sleep(0.15)
        return {"value": r["n"]}

    run, seen = run_queue.Run(store, RESULT, waves=6), []
    stopper = threading.Timer(60, run.stop)

    def tell(progress):
        seen.append((progress.wave, progress.done))
        if progress.wave == 2:  # while the third wave is at work
            threading.Timer(0.8, run.stop).start()

    stopper.start()
    half = run.go(records(spark), ["n"], slow, tell=tell)
    stopper.cancel()
    assert half.stopped and 2 <= half.wave < 6 and 0 < half.done < 40 and seen[0][0] == 1
    assert store.load().count() == half.done
    rest = run_queue.Run(store, RESULT, waves=2).go(records(spark), ["n"], lambda r: {"value": r["n"]})
    assert rest.todo == 40 - half.done and not rest.stopped
    assert values(store.load()) == {("doc", f"r{k}"): k for k in range(40)}
