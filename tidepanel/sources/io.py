"""Reading station files and tables, and writing results with row counts."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from urllib.parse import quote

import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.functions import text

# Required columns of the sampling-station list.
STATION_LIST_COLUMNS = [
    "NERR Site ID",
    "Station Code",
    "Station Name",
    "Reserve Name",
    "Latitude",
    "Longitude",
    "Lat Long",
    "Status",
]


def read_table(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str | None = None,
    fmt: str = "csv",
    ts_format: str | None = None,
    encoding: str | None = None,
    columns: Sequence[str] | None = None,
    recursive: bool = False,
) -> DataFrame:
    """Typed scan of a CSV, JSON or parquet table; only ``columns`` are read where given."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
        if encoding:
            reader = reader.option("encoding", encoding)
    if ts_format:
        reader = reader.option("timestampNTZFormat", ts_format).option("timestampFormat", ts_format)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    df = reader.load(path)
    return df.select(*columns) if columns else df


def require_columns(df: DataFrame, columns: Sequence[str], what: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns in {what}: {missing}")
    return df


def classify_stem(stem: Column) -> dict[str, Column]:
    """Station, region and file class taken from a file stem; NULL where it does not match."""
    station = F.lower(F.nullif(F.regexp_extract(stem, text.FILE_STEM_PATTERN, 1), F.lit("")))
    file_class = F.lower(F.nullif(F.regexp_extract(stem, text.FILE_STEM_PATTERN, 2), F.lit("")))
    return {"region": F.left(station, F.lit(3)), "station": station, "file_type": file_class}


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)\.csv$", "")


#: Stores that an executor opens by itself; files of others are read through Spark's own reader.
OPENED = ("", "file", "hdfs")
#: Bytes of the first read of a file; a longer first line takes further reads.
HEAD_BYTES = 4096


def first_line(stream) -> str | None:
    """The first line of a byte stream, read no further than needed; None if the stream is empty."""
    got = bytearray()
    while part := stream.read(HEAD_BYTES):
        got += part
        ends = [i for i in (got.find(b"\n"), got.find(b"\r")) if i >= 0]
        if ends:
            return bytes(got[: min(ends)]).removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace")
    return bytes(got).removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace") if got else None


def _first_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        lines = []
        for path in pdf["path"]:
            if path.startswith("file:") or "://" not in path:
                fs, name = pyarrow.fs.LocalFileSystem(), path.removeprefix("file:")
            else:
                fs, name = pyarrow.fs.FileSystem.from_uri(quote(path, safe=":/@"))
            with fs.open_input_file(name) as stream:
                lines.append(first_line(stream))
        yield pd.DataFrame({"path": pdf["path"], "header": pd.Series(lines, dtype=object)})


def headers(spark: SparkSession, root: str, by_range: bool | None = None) -> DataFrame:
    """``path, header`` of every CSV file below ``root``; files without a line are left out.

    The executors read the first few kilobytes of a file, whatever its size. ``by_range=False`` takes the first lines from a
    scan of the files instead; without a choice that is done for stores whose settings only Spark knows (object stores).
    """
    if by_range is None:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        by_range = (target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme() or "") in OPENED
    options = {"recursiveFileLookup": True, "pathGlobFilter": "*.[cC][sS][vV]"}
    if by_range:
        paths = spark.read.format("binaryFile").options(**options).load(root).select("path")
        return paths.mapInPandas(_first_lines, "path string, header string").filter(F.col("header").isNotNull())
    lines = (
        spark.read.options(**options).text(root)
        .select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"))
        .filter(F.col("_start") == 0)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    return lines.groupBy("path").agg(F.min_by("value", "_at").alias("header"))


def discover(spark: SparkSession, root: str) -> DataFrame:
    """Every station file below ``root`` with its header: path, region, station, file_type, header."""
    found = headers(spark, root)
    return found.withColumns(classify_stem(file_stem(F.col("path")))).filter(F.col("file_type").isNotNull())


def read_station_files(spark: SparkSession, root: str, file_type: str) -> DataFrame:
    """All files of a class as one table of text columns.

    One scan per distinct header, united by name; names are stripped and an absent cell is ''. The driver
    holds one path per file, as Spark's own listing of them does.
    """
    groups: dict[str, list[str]] = {}
    for row in discover(spark, root).filter(F.col("file_type") == file_type).select("path", "header").orderBy("path").toLocalIterator():
        groups.setdefault(row["header"], []).append(row["path"])
    if not groups:
        raise ValueError(f"no {file_type} files below {root}")
    parts, order = [], []
    for header, paths in groups.items():
        names = [n.strip().strip('"').strip() for n in header.split(",")]
        kept = [n for n in dict.fromkeys(names) if n]
        order += [n for n in kept if n not in order]
        schema = T.StructType(
            [T.StructField(n if n and names.index(n) == i else f"_unused{i}", T.StringType()) for i, n in enumerate(names)]
        )
        part = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(paths)
        parts.append(part.select("*", F.col("_metadata.file_path").alias("_path")).select("_path", *kept))
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    where = classify_stem(file_stem(F.col("_path")))
    stamps = [F.nullif(F.col(c), F.lit("")) for c in ("DateTimeStamp", "DatetimeStamp") if c in order]
    return united.select(
        where["region"].alias("region"),
        where["station"].alias("station"),
        F.coalesce(*stamps, F.lit("")).alias("datetime"),
        F.element_at(F.split("_path", "/"), -1).alias("source_file"),
        *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in order],
    )


def station_list(spark: SparkSession, path: str) -> DataFrame:
    """The Latin-1 sampling-station list with normalised keys and signed coordinates."""
    raw = read_table(spark, path, encoding="ISO-8859-1")
    raw = require_columns(raw.toDF(*[c.strip() for c in raw.columns]), STATION_LIST_COLUMNS, "sampling stations")
    full = text.key_text("Station Code")
    return raw.select(
        text.key_text("NERR Site ID").alias("region_code"),
        full.alias("station_code_full"),
        F.left(full, F.lit(5)).alias("station"),
        F.trim("Station Name").alias("station_name"),
        F.trim("Reserve Name").alias("region_name"),
        F.trim("Status").alias("status"),
        text.number(F.col("Latitude")).alias("latitude"),
        text.longitude(text.number(F.col("Longitude")), F.col("Lat Long")).alias("longitude"),
    ).filter((F.col("region_code") != "") & (F.col("station") != ""))


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_or(spark: SparkSession, path: str, fallback: DataFrame, defaults: Mapping[str, object], fmt: str = "parquet") -> DataFrame:
    """The table at ``path`` if it exists, else ``fallback``; absent or null cells get the defaults."""
    df = read_table(spark, path, fmt=fmt) if path_exists(spark, path) else fallback
    return df.withColumns(
        {
            c: F.coalesce(F.col(c).cast("double"), F.lit(v)) if c in df.columns else F.lit(v)
            for c, v in defaults.items()
        }
    )


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: Sequence[str] = ()) -> int:
    """Write and return the number of rows, counted while they are written."""
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return int(seen.get["rows"])


def filter_report(df: DataFrame, keep: Column, path: str, fmt: str = "parquet") -> dict[str, float]:
    """Write the kept rows; report rows read, kept, skipped and the kept share from the same pass."""
    seen = Observation()
    kept = F.coalesce(keep, F.lit(False))
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows_in"), F.count_if(kept).alias("rows_out"))
    watched.filter(kept).write.mode("overwrite").format(fmt).save(path)
    got = seen.get
    n_in, n_out = int(got["rows_in"]), int(got["rows_out"])
    return {"rows_in": n_in, "rows_out": n_out, "skipped": n_in - n_out, "kept_pct": 100.0 * n_out / n_in if n_in else 0.0}


def write_tables(tables: Mapping[str, DataFrame], root: str, fmt: str = "parquet") -> dict[str, int]:
    return {name: write_table(df, f"{root}/{name}", fmt) for name, df in tables.items()}


def write_named_csv(df: DataFrame, folder: str, stem: str) -> None:
    """CSV files below ``<folder>/<stem>`` whose names start with the stem, as station files do.

    A file name is what carries the station, so every part is renamed in place.
    """
    spark = df.sparkSession
    target = f"{folder}/{stem}"
    df.write.mode("overwrite").option("header", True).csv(target)
    jvm = spark.sparkContext._jvm
    fs_path = jvm.org.apache.hadoop.fs.Path
    fs = fs_path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = [s.getPath() for s in fs.listStatus(fs_path(target)) if s.getPath().getName().startswith("part-")]
    for i, part in enumerate(sorted(parts, key=lambda p: p.getName())):
        fs.rename(part, fs_path(f"{target}/{stem}_{i}.csv"))
