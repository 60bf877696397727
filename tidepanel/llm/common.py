"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidepanel.session import shared_dir, staged

__all__ = ["table", "staged", "shared_dir", "text_hash", "components", "numbered", "free_name"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_hash(data: bytes) -> str:
    """128 bits of a text's hash, as hex: the identity of equal texts."""
    return hashlib.blake2b(data, digest_size=16).hexdigest()


def labelled_sample(labelled: DataFrame, key: str, bound: int) -> DataFrame:
    """About ``bound`` rows at most, chosen by a hash of ``key`` alone: the same ones in any partitioning.

    The documented bound of rows that a classifier is fitted on; all rows, where there are fewer.
    """
    n = labelled.count()
    if n <= bound:
        return labelled
    return labelled.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1_000_000)) < int(1_000_000 * bound / n))


def numbered(rows: DataFrame, order: list[Column], partitions: int | None = None) -> DataFrame:
    """Rows with their global number ``row_no`` from 0 in the given order, and the count of all rows as ``n_rows``.

    A range sort numbers each partition; the partitions' counts, as many rows as there are partitions, are summed up
    by a window over that small table and joined back. The sorted rows are staged, so that both see the same ones.
    """
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    in_part = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    cut = (
        rows.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_mid", 33))
        .withColumn("_at", in_part)
        .drop("_mid")
    )
    cut = staged(cut)
    counts = cut.groupBy("_part").agg(F.count("*").alias("_c")).coalesce(1)
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    starts = counts.select(
        "_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"), F.sum("_c").over(whole).alias("n_rows")
    )
    # one row per partition: bounded by the partition count, so it may be broadcast
    return cut.join(F.broadcast(starts), "_part").withColumn("row_no", F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node in ``edges(a, b)``: root is the smallest node that links reach.

    Rounds of large star and small star, which shrink distances, so that long chains need few of them; they go on until
    a round leaves the count and the hash sum of the links as they were, with no cap. Joins are on staged tables, so
    that adaptive execution can split a hot node, and a reliable checkpoint ends each half of a round.
    """
    links = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        stamp = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if stamp == seen:
            break
        seen = stamp
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = staged(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        links = staged(large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low).distinct())
    # every link now leads from a node to its root
    return staged(links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    while stem.lower() in {c.lower() for c in df.columns}:
        stem = f"_{stem}"
    return stem


def texts_of(batch: pd.DataFrame, column: str = "text") -> list[str]:
    """The texts of a batch, with empty ones for nulls."""
    return ["" if t is None or t is pd.NA or t != t else t for t in batch[column]]


def code_points(text: str) -> np.ndarray:
    """The code points of a text; a lone surrogate counts as itself."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


Batches = Iterator[pd.DataFrame]


def give_back() -> None:
    """Return freed memory of a Python worker to the system; workers live on and serve other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library offers it
        ctypes.CDLL(None).malloc_trim(0)


def giving_back(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` of a task, which gives memory back at its end."""

    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        give_back()

    return run


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of results that nothing refers to any more, those of the latest steps perhaps a call later.

    Its cleaner learns of them when the driver's memory is collected, which a driver with little to do leaves for half an hour.
    """
    gc.collect()  # Python's handles first
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.5)  # handles are let go beside this thread, and what is left over goes with the next call
    spark.sparkContext._jvm.System.gc()


#: Fixed value: Spark's default.
SPARK_BATCH_BYTES = "67108864b"
BATCH_BYTES = "8m"
"""Bytes of an Arrow batch of whole texts, unless the session names its own; a single longer text is a batch."""


def bounded_batches(spark: SparkSession) -> None:
    """Let batches of texts end by bytes, well before Spark's default, since each is held several times over on both sides."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, SPARK_BATCH_BYTES):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def with_scores(documents: DataFrame, names: list[str], begin: Callable[[], Callable[[list[str]], list[list]]]) -> DataFrame:
    """``documents`` with double columns ``names`` that a task computes from whole texts (null ones as empty).

    ``begin`` is called once per task and gives the function from texts to one list per column. Other columns pass as
    they are, as Arrow data, whatever their types.
    """
    bounded_batches(documents.sparkSession)
    schema = StructType([*documents.schema.fields, *(StructField(n, DoubleType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = begin()
        for batch in batches:
            found = work([t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()])
            for name, values in zip(names, found, strict=True):
                batch = batch.append_column(name, pa.array(values, type=pa.float64()))
            yield batch

    return documents.mapInArrow(giving_back(run), schema)
