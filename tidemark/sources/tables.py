"""Parquet scans, hour-stamped files, time filters and result sinks."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.names import TS

# Fixed value: how an hourly file is named after its prefix.
FILE_STAMP = r"_(\d{8})_(\d{6})\.parquet$"


def scan(spark: SparkSession, *paths: str) -> DataFrame:
    """One table over many parquet files or folders."""
    if not paths:
        raise ValueError("no parquet files given")
    return spark.read.parquet(*paths)


def file_stamp(path: Column, prefix: str) -> Column:
    """Time stamp in a file name ``<prefix>_YYYYMMDD_HHMMSS.parquet``; null for other names."""
    pattern = "^" + re.escape(prefix) + FILE_STAMP
    name = F.element_at(F.split(path, "/"), -1)
    stamp = F.concat(F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2))
    return F.when(name.rlike(pattern), F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmmss")))


def list_stamped_files(
    spark: SparkSession, folder: str, prefix: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """``(path, stamp)`` of the files with ``start <= stamp < end``.

    Reads the listing only: no file is opened.
    """
    listing = spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}_*.parquet").load(folder)
    stamped = listing.select("path", file_stamp(F.col("path"), prefix).alias("stamp"))
    return time_between(stamped.where(F.col("stamp").isNotNull()), "stamp", start, end)


def _digits(low: str, high: str) -> list[str]:
    """Patterns of the digit strings ``low <= s < high``: a prefix, one range of digits, any rest."""

    def span(prefix: str, first: int, last: int) -> list[str]:
        any_rest = ["[0-9]"] * (len(low) - len(prefix) - 1)
        return ["".join([*prefix, f"[{first}-{last}]", *any_rest])] if first <= last else []

    if low >= high:
        return []
    same = next(i for i, (a, b) in enumerate(zip(low, high)) if a != b)
    found = span(low[:same], int(low[same]) + 1, int(high[same]) - 1)
    for i in range(same + 1, len(low)):
        found += span(low[:i], int(low[i]) + 1, 9) + span(high[:i], 0, int(high[i]) - 1)
    return [low, *found]


def stamp_globs(prefix: str, start: str | None = None, end: str | None = None) -> list[str]:
    """File name patterns that together match the stamps of ``start <= stamp < end`` and no others.

    At most two for each digit of a stamp, however many files there are.  Bounds are dates or
    times in text form, as far as whole seconds.
    """

    def digits(bound: str) -> str:
        return re.sub(r"\D", "", bound.split(".")[0]).ljust(14, "0")[:14]

    low = "0" * 14 if start is None else digits(start)
    if start is not None and re.search(r"\.0*[1-9]", start):
        low = f"{int(low) + 1:014}"  # a stamp has whole seconds
    high = "9" * 14 if end is None else digits(end)
    if end is not None and re.search(r"\.0*[1-9]", end):
        high = f"{int(high) + 1:014}"
    patterns = [prefix + "_" + "[0-9]" * 8 + "_" + "[0-9]" * 6] if (start, end) == (None, None) else []
    for pattern in [] if patterns else _digits(low, high):
        parts = re.findall(r"\[.*?\]|\d", pattern)
        patterns.append(f"{prefix}_{''.join(parts[:8])}_{''.join(parts[8:])}")
    return [p + ".parquet" for p in patterns]


def scan_stamped(
    spark: SparkSession, folder: str, prefix: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Scan only the files whose name falls into the window.

    The window becomes a few name patterns that the listing itself applies, so files outside it
    are not opened, and no list of paths passes through Python.
    """
    globs = stamp_globs(prefix, start, end)
    try:
        found = spark.read.option("pathGlobFilter", "{" + ",".join(globs) + "}").parquet(folder) if globs else None
    except AnalysisException as error:
        if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        found = None
    if found is None:
        raise ValueError(f"no {prefix} files between {start} and {end}")
    # Digits that are no time, such as a 13th month, are no stamp.
    return found.where(file_stamp(F.col("_metadata.file_path"), prefix).isNotNull())


def write_stamped(df: DataFrame, folder: str, prefix: str, column: str = TS) -> None:
    """One parquet file for each hour of ``column`` with rows, named by its stamp; rows without a time go nowhere.

    The format has one file an hour, so an hour is written by one task, batch by batch.  A file gets its
    name when it is whole, so a repeated task changes nothing.  Files go through ``pyarrow.fs``: the
    folder must be one that the executors can open.
    """
    hour = F.date_trunc("hour", F.col(column).cast("timestamp"))
    stamped = df.withColumn("_stamp", F.date_format(hour, "yyyyMMdd_HHmmss")).where(F.col("_stamp").isNotNull())
    names = df.columns

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        store.create_dir(root, recursive=True)
        done: list[str] = []
        stamp, writer, part = None, None, ""

        def close() -> None:
            if writer is not None:
                writer.close()
                store.move(part, f"{root}/{prefix}_{stamp}.parquet")
                done.append(stamp)

        for batch in batches:
            stamps = batch.column(batch.schema.get_field_index("_stamp"))
            rows = batch.select(names)
            runs = pc.run_end_encode(stamps)
            start = 0
            for value, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                if value != stamp:
                    close()
                    stamp, part = value, f"{root}/.{prefix}_{value}-{uuid.uuid4().hex}"
                    writer = pq.ParquetWriter(part, rows.schema, filesystem=store, compression="zstd")
                writer.write_batch(rows.slice(start, end - start))
                start = end
        close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["stamp"])

    ordered = stamped.repartition("_stamp").sortWithinPartitions("_stamp")
    ordered.mapInArrow(write, "stamp string").agg(F.count(F.lit(1))).collect()


def time_between(df: DataFrame, column: str = TS, start: str | None = None, end: str | None = None) -> DataFrame:
    """Half-open filter ``start <= column < end``; text columns compare as text.

    The bounds take the type of the column, never the other way round, so the
    filter reaches the parquet scan.
    """
    if column not in df.columns:
        raise ValueError(f"no column {column!r} to filter on; have {', '.join(df.columns)}")
    dtype = df.schema[column].dataType
    bound = (lambda v: F.lit(v)) if isinstance(dtype, T.StringType) else (lambda v: F.lit(v).cast(dtype))
    if start is not None:
        df = df.where(F.col(column) >= bound(start))
    if end is not None:
        df = df.where(F.col(column) < bound(end))
    return df


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet with zstd pages."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nulls become empty cells."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line; nulls are written out."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
