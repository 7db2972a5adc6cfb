"""Roll-ups of arriving logs: the same totals as over the whole log, through restarts, repeats and late rows."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from quire.operators import checks, completion
from quire.streaming import rollups
from quire.streaming.rollups import RunningRollup, read_health_rollup, read_usage_rollup, start_health_rollup, start_usage_rollup

CALLS = "provider string, model string, prompt_tokens long, completion_tokens long"
STATUS = "component string, ts timestamp_ntz, healthy boolean"


def arrive(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def call(i):
    return ("mock" if i % 3 else None, f"m{i % 2}", None if i % 5 == 0 else i, i)


def at(minute):
    return dt.datetime(2024, 1, 1, 0, minute)


def test_usage_through_restarts_is_the_usage_of_the_whole_log(spark, scratch):
    log, root = os.path.join(scratch, "calls"), os.path.join(scratch, "usage")
    for part in range(3):
        for file in range(2):
            arrive(spark, log, [call(i) for i in range(20 * part + 7 * file, 20 * part + 20)], CALLS)
        start_usage_rollup(stream(spark, log, CALLS), root).awaitTermination()
        whole = completion.usage_rollup(spark.read.schema(CALLS).parquet(log))
        assert rows_of(read_usage_rollup(spark, root)) == rows_of(whole)
    assert len(RunningRollup(spark, root)._batches()) >= 6
    before = rows_of(read_usage_rollup(spark, root))
    start_usage_rollup(stream(spark, log, CALLS), root).awaitTermination()  # nothing new arrived
    assert rows_of(read_usage_rollup(spark, root)) == before


def test_a_batch_that_fails_after_its_totals_counts_once(spark, scratch, monkeypatch):
    log, root = os.path.join(scratch, "calls"), os.path.join(scratch, "usage")
    arrive(spark, log, [call(i) for i in range(10)], CALLS)
    start_usage_rollup(stream(spark, log, CALLS), root).awaitTermination()
    arrive(spark, log, [call(i) for i in range(10, 30)], CALLS)
    listed, written = RunningRollup._batches, []

    def lost(self):  # the totals are written, then the driver goes
        written.append(listed(self))
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(rollups.RunningRollup, "_batches", lost)
        with pytest.raises(Exception, match="driver lost"):
            start_usage_rollup(stream(spark, log, CALLS), root).awaitTermination()
    assert written == [[0, 1]]
    start_usage_rollup(stream(spark, log, CALLS), root).awaitTermination()
    whole = completion.usage_rollup(spark.read.schema(CALLS).parquet(log))
    assert rows_of(read_usage_rollup(spark, root)) == rows_of(whole)


def test_health_takes_the_latest_row_not_the_last_to_arrive(spark, scratch):
    log, root = os.path.join(scratch, "status"), os.path.join(scratch, "health")
    arrive(spark, log, [("db", at(5), True), ("ocr", at(1), False), ("llm", at(1), None)], STATUS)
    start_health_rollup(stream(spark, log, STATUS), root).awaitTermination()
    assert rows_of(read_health_rollup(spark, root)) == [(3, 2, False, "degraded")]
    arrive(spark, log, [("db", at(2), False), ("ocr", at(6), True)], STATUS)  # db's is late
    start_health_rollup(stream(spark, log, STATUS), root).awaitTermination()
    r = read_health_rollup(spark, root, components=True).first()
    assert (r.n_unhealthy, r.components["db"].healthy, r.components["ocr"].status, r.components["llm"].status) == (
        1, True, "healthy", "degraded")
    arrive(spark, log, [("llm", at(9), True)], STATUS)
    start_health_rollup(stream(spark, log, STATUS), root).awaitTermination()
    assert rows_of(read_health_rollup(spark, root)) == [(3, 0, True, "healthy")]
    assert rows_of(read_health_rollup(spark, root)) == rows_of(checks.health_rollup(spark.read.schema(STATUS).parquet(log)))


def test_old_totals_go_and_an_empty_root_says_so(spark, scratch, monkeypatch):
    log, root = os.path.join(scratch, "calls"), os.path.join(scratch, "usage")
    with pytest.raises(FileNotFoundError, match="no totals yet"):
        read_usage_rollup(spark, root)
    monkeypatch.setattr(rollups, "KEEP", 2)
    for i in range(5):
        arrive(spark, log, [call(i)], CALLS)
    start_usage_rollup(stream(spark, log, CALLS), root).awaitTermination()
    assert RunningRollup(spark, root)._batches() == [3, 4]
    assert read_usage_rollup(spark, root).agg(F.sum("calls")).first()[0] == 5
