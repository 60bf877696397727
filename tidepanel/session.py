"""Session defaults and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).parent


def build_session(app: str = "tidepanel", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; ``conf`` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, whatever folder they run in. The driver serves the archive to executors."""
    path = os.path.join(tempfile.mkdtemp(prefix="package-"), f"{PACKAGE.name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(PACKAGE.rglob("*.py")):
            archive.write(source, source.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(path)


def is_local(master: str) -> bool:
    """Whether driver and executors are one process on one machine."""
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session that names none (a test) gets a new temporary folder; on a cluster that is an error, since
    every executor would write to a disk of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if configured is None and current.isDefined():
        configured = current.get()
    if configured is None:
        if not is_local(spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    if not current.isDefined():
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder for a table or stream output."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def staged(df: DataFrame) -> DataFrame:
    """A table written to the shared folder and read back: later plans start from it.

    For a result that several jobs use, so that none of them computes it again.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


ROWS_A_TASK = 250_000


def spread_groups(df: DataFrame, keys: list[str], rows: int = 0) -> DataFrame:
    """Hash the groups over all shuffle partitions before Python work on them, or over as many as ``rows`` that come of them ask for.

    Such groups are few bytes but many cycles, and merging partitions by size would put
    them in one task. The grouping that follows needs no further shuffle.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK))
    return df.repartition(n, *keys)


def sized(df: DataFrame, rows: int, keys: list[str]) -> DataFrame:
    """Hash the groups over as many partitions as ``rows`` ask for, so that a task's memory doesn't grow with the table.

    Joins, aggregates and windows by these keys follow without a shuffle. A table that the cores hold in few rows each stays as it is.
    """
    spark = df.sparkSession
    n = -(-rows // ROWS_A_TASK)
    if n <= spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(max(n, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
