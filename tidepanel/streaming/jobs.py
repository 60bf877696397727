"""Incremental forms of the downsample, filter, key and as-of steps.

Each job reads new files as they arrive, keeps its state below the folder ``root`` that the caller names, writes
parquet there, and stops when nothing new is left (``availableNow``). A later call with the same folder goes on where
the last one ended, so a scheduler can run it; another trigger can leave it running.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidepanel.functions import dates
from tidepanel.operators.joins import asof_join


def read_files(spark: SparkSession, path: str, schema: T.StructType, glob: str = "*.parquet", fmt: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt).option("pathGlobFilter", glob)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(path)


def run_to_table(stream: DataFrame, root: str, mode: str = "append") -> DataFrame:
    """Drain the stream into a parquet table below ``root`` and return that table."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{root}/state")
        .option("path", f"{root}/table").trigger(availableNow=True).start()
    )
    _finish(query)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/table")


def _finish(query: StreamingQuery) -> None:
    try:
        query.awaitTermination()
    finally:
        query.stop()


def _files(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _numbers(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """The numbers n of the entries ``<prefix>n`` of a folder, ascending; none if there is no such folder."""
    fs, target = _files(spark, folder)
    if not fs.exists(target):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(target)]
    return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit())


class BatchTable:
    """A table of one folder per micro-batch, whose closed batches are merged into generations from time to time.

    ``batches/batch=n`` holds batch n; a batch that is run again replaces itself. ``merged/upto=n`` holds what all
    batches up to n merge to, and counts only once the empty file ``merged/done=n`` is there. A reader takes the newest
    such generation and the batches after it, so each batch counts once at any moment: a merge that died before its mark
    is not seen and is written again, and one that died after it leaves folders that nothing reads. Folders go at the
    next merge but one mark, so a table that the call before returned can still be read.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 16):
        self.spark, self.root, self.keep = spark, root, keep

    def path(self, kind: str, n: int) -> str:
        return {"batch": f"{self.root}/batches/batch={n}", "upto": f"{self.root}/merged/upto={n}", "done": f"{self.root}/merged/done={n}"}[kind]

    def write_batch(self, rows: DataFrame, n: int) -> None:
        rows.write.mode("overwrite").parquet(self.path("batch", n))

    def folders(self) -> list[str]:
        """The folders that make up the table now."""
        done = _numbers(self.spark, f"{self.root}/merged", "done=")
        last = done[-1] if done else -1
        return [self.path("upto", n) for n in done[-1:]] + [self.path("batch", n) for n in _numbers(self.spark, f"{self.root}/batches", "batch=") if n > last]

    def read(self) -> DataFrame:
        return self.spark.read.parquet(*self.folders())

    def compact(self, merge) -> None:
        """Merge generation and closed batches into a new generation if more than ``keep`` folders make up the table.

        Call it while no batch runs. ``merge`` maps rows of the table to fewer rows of the same columns.
        """
        if len(self.folders()) <= self.keep:
            return
        upto = _numbers(self.spark, f"{self.root}/batches", "batch=")[-1]
        merge(self.read()).write.mode("overwrite").parquet(self.path("upto", upto))
        self.commit(upto)
        self.clear()

    def commit(self, upto: int) -> None:
        fs, mark = _files(self.spark, self.path("done", upto))
        fs.create(mark, True).close()

    def clear(self) -> None:
        """Delete what the generation before the newest had replaced already."""
        done = _numbers(self.spark, f"{self.root}/merged", "done=")
        if len(done) < 2:
            return
        before = done[-2]
        old = [("batch", n) for n in _numbers(self.spark, f"{self.root}/batches", "batch=") if n <= before]
        old += [(kind, n) for kind in ("done", "upto") for n in _numbers(self.spark, f"{self.root}/merged", f"{kind}=") if n < before]
        for kind, n in old:
            fs, target = _files(self.spark, self.path(kind, n))
            fs.delete(target, True)


def _run_batches(stream: DataFrame, root: str, work, merge, keep: int = 16) -> DataFrame:
    """Drain the stream through ``work`` into a ``BatchTable`` below ``root``, merge what is closed, and return the table."""
    table = BatchTable(stream.sparkSession, root, keep)
    query = (
        stream.writeStream.foreachBatch(lambda batch, n: table.write_batch(work(batch), n))
        .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    )
    _finish(query)
    table.compact(merge)
    return table.read()


def partial_bins(rows: DataFrame, keys: Sequence[str], ts: str, freq: str, values: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Sums and counts of the values, and the first present carried value with its time, per key and bin."""
    return (
        rows.withColumn(ts, dates.as_utc(F.col(ts)))
        .groupBy(*keys, F.window(ts, freq).alias("bin"))
        .agg(
            *[F.sum(c).alias(f"{c}_sum") for c in values], *[F.count(c).alias(f"{c}_n") for c in values],
            *[F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(ts).alias("at"), F.col(c).alias("value")))).alias(f"{c}_first") for c in carry],
        )
        .select(*keys, F.col("bin.start").alias(ts), *[f"{c}_{x}" for c in values for x in ("sum", "n")], *[f"{c}_first" for c in carry])
    )


def merged_partials(partials: DataFrame, keys: Sequence[str], ts: str, values: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """One partial row per key and bin from those of several batches."""
    sums = [F.sum(f"{c}_{x}").alias(f"{c}_{x}") for c in values for x in ("sum", "n")]
    return partials.groupBy(*keys, ts).agg(*sums, *[F.min(f"{c}_first").alias(f"{c}_first") for c in carry])


def merged_bins(partials: DataFrame, keys: Sequence[str], ts: str, values: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Means and first carried values of all bins from the partial rows of all batches."""
    return merged_partials(partials, keys, ts, values, carry).select(
        *keys, dates.from_utc(F.col(ts)).alias(ts), *[(F.col(f"{c}_sum") / F.col(f"{c}_n")).alias(c) for c in values], *[F.col(f"{c}_first.value").alias(c) for c in carry]
    )


def downsample(stream: DataFrame, root: str, keys: Sequence[str], ts: str, freq: str, values: Sequence[str], carry: Sequence[str] = (), keep: int = 16) -> DataFrame:
    """n-hour means and first present carried values of all readings so far, whatever order they arrive in.

    Every batch leaves partial rows, which merge into the bins that the batch form gives: a late reading changes its
    bin, the last bin is there although it is still open, and nothing is dropped. Of readings that share the first
    time the smallest carried value counts. Closed batches are merged once more than ``keep`` folders make up the table.
    """
    partials = _run_batches(
        stream, root, lambda batch: partial_bins(batch, keys, ts, freq, values, carry), lambda rows: merged_partials(rows, keys, ts, values, carry), keep
    )
    return merged_bins(partials, keys, ts, values, carry)


def hour_filter(stream: DataFrame, ts: str, hours: Sequence[int] = (8, 20)) -> DataFrame:
    return stream.filter(F.hour(ts).isin(*hours))


def distinct_keys(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New keys only; the keys seen so far are the state."""
    return stream.select(*keys).dropDuplicates(list(keys))


def asof_enrich(stream: DataFrame, root: str, observations: DataFrame, by: Sequence[str], ts: str, obs_ts: str, tolerance: str) -> DataFrame:
    """As-of enrichment of every micro-batch against a static observation table.

    Batches are rows that no merge makes fewer; it puts them into partitions of the size that adaptive execution aims at.
    """
    return _run_batches(stream, root, lambda batch: asof_join(batch, observations, by, ts, obs_ts, tolerance), lambda rows: rows.hint("rebalance"))
