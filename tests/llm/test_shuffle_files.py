"""Shuffle files of finished work don't pile up on the executors' disks."""

import time

from pyspark.sql import functions as F

import corpus_pipeline
from tidepanel.llm import common


def shuffle_files(spark) -> set[str]:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_freed_shuffles_leave_the_disk(spark):
    before = shuffle_files(spark)
    rows = common.staged(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    made = shuffle_files(spark) - before
    assert made
    for _ in range(3):
        common.free_shuffles(spark)
        time.sleep(1)
    assert not made & shuffle_files(spark)
    assert rows.count() == 7


def test_every_stage_is_freed(spark, monkeypatch, tmp_path):
    freed = []
    monkeypatch.setattr(corpus_pipeline, "free_shuffles", lambda s: freed.append(s))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", lambda s, docs, d: docs.limit(3)), ("two", lambda s, docs, d: docs)])
    spark.range(5).withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 3
    assert len(freed) == 2
