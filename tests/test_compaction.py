"""Streamed tables of many batches: merged generations, and crashes between their steps."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidepanel.session import scratch_path
from tidepanel.streaming import jobs

SCHEMA = "station string, ts timestamp, value double, note string"


def arrive(spark, source, n):
    """File n: late and equal times, a null value, a station of its own in every fourth file."""
    start = dt.datetime(2024, 1, 1)
    rows = [("s1", start + dt.timedelta(hours=n), float(n), f"n{n}"), ("s1", start + dt.timedelta(hours=49 - n), 0.5 * n, None), ("s2", start, None, f"m{99 - n}")]
    rows += [(f"own{n}", start, 1.0, "x")] if n % 4 == 0 else []
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)


def batch_form(spark, source):
    rows = spark.read.schema(SCHEMA).parquet(source)
    return jobs.merged_bins(jobs.partial_bins(rows, ["station"], "ts", "4 hours", ["value"], ["note"]), ["station"], "ts", ["value"], ["note"])


def call(spark, source, root, keep=3):
    stream = jobs.read_files(spark, source, spark.read.schema(SCHEMA).parquet(source).schema, per_trigger=1)
    return jobs.downsample(stream, root, ["station"], "ts", "4 hours", ["value"], ["note"], keep=keep)


def rows_of(df):
    return sorted((tuple(r) for r in df.withColumn("value", F.round("value", 9)).collect()), key=str)


def test_many_calls_leave_few_folders_and_the_batch_result(spark):
    source, root = scratch_path(spark, "in"), scratch_path(spark, "out")
    most, before = 0, None
    for n in range(14):
        arrive(spark, source, n)
        out = call(spark, source, root)
        if before is not None and n % 3 == 0:
            before.count()  # what the call before returned is still there
        before = out
        most = max(most, len(jobs.BatchTable(spark, root).folders()))
    local = root.removeprefix("file://")
    assert rows_of(out) == rows_of(batch_form(spark, source))
    assert most <= 3 and len(os.listdir(f"{local}/batches")) <= 8 and sum(n.startswith("upto=") for n in os.listdir(f"{local}/merged")) <= 2


@pytest.mark.parametrize("step", ["commit", "clear"])
def test_a_crash_in_a_merge_counts_every_batch_once(spark, monkeypatch, step):
    """Died after the write but before the mark, and after the mark but before old folders went."""
    source, root = scratch_path(spark, "in"), scratch_path(spark, "out")
    for n in range(5):
        arrive(spark, source, n)

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(jobs.BatchTable, step, die)
        with pytest.raises(RuntimeError, match="lost"):
            call(spark, source, root)
    table = jobs.BatchTable(spark, root)
    assert len(table.folders()) == (5 if step == "commit" else 1)
    merged = jobs.merged_bins(table.read(), ["station"], "ts", ["value"], ["note"])
    assert rows_of(merged) == rows_of(batch_form(spark, source))
    arrive(spark, source, 5)
    assert rows_of(call(spark, source, root)) == rows_of(batch_form(spark, source))


def test_a_batch_run_again_replaces_itself(spark):
    table = jobs.BatchTable(spark, scratch_path(spark, "out"), keep=2)
    one = spark.createDataFrame([("a", 1)], "k string, n int")
    for _ in range(2):
        table.write_batch(one, 0)
    table.write_batch(one, 1)
    assert table.read().count() == 2
    table.write_batch(one, 2)
    table.compact(lambda rows: rows.groupBy("k").agg(F.sum("n").cast("int").alias("n")))
    assert [tuple(r) for r in table.read().collect()] == [("a", 3)] and len(table.folders()) == 1
