"""The point store: Parquet by measurement and date, last write wins.

Writers only ever append, so a retried write or a lost executor leaves at worst
identical copies. Readers resolve copies with ``last_write_wins``; compaction writes a
folder's resolved points beside its files and then deletes those, so a reader finds every
point at any moment, and one that breaks off leaves copies.

Files are sorted by sensor and time and have a Bloom filter of sensors, so one sensor's
points are few row groups of a folder. Columns beyond the fixed ones are stated in a small
table of their own when they are first written, so a scan asks no footers for a schema.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from benchlight.operators.measure import last_write_wins
from benchlight.schema import POINTS
from benchlight.session import exists, remove

PARTITIONS = ["measurement", "date"]
# Sensors a file's Bloom filter is made for; more only blunt it.
FILE_SENSORS = 100_000
# Files a folder may have before it is compacted, and folders compacted at once.
FOLDER_FILES = 8
FOLDERS_AT_ONCE = 1000


def write_points(points: DataFrame, path: str, rows_per_file: int = 5_000_000, **options) -> None:
    """Append points under ``measurement=…/date=…``.

    Rows of a folder come together first, so that it gets few files; a folder with more
    rows than a task should take is split again. ``options`` go to the writer.
    """
    _state_columns(points, path)
    (
        points.withColumn("date", F.to_date("time"))
        .hint("rebalance", *PARTITIONS)
        .sortWithinPartitions(*PARTITIONS, "sensor_id", "time")
        .write.mode("append")
        .option("maxRecordsPerFile", rows_per_file)
        .option("parquet.bloom.filter.enabled#sensor_id", "true")
        .option("parquet.bloom.filter.expected.ndv#sensor_id", str(FILE_SENSORS))
        .options(**options)
        .partitionBy(*PARTITIONS)
        .parquet(path)
    )


def _extra(fields: Sequence[StructField]) -> list[StructField]:
    known = {*StructType.fromDDL(POINTS).names, *PARTITIONS}
    return [StructField(f.name, f.dataType) for f in fields if f.name not in known]


def _state_columns(points: DataFrame, path: str) -> None:
    """Writes down the columns beyond the fixed ones, once per set of columns."""
    extra = StructType(_extra(points.schema.fields))
    if not extra.fields:
        return
    text = extra.json()
    place = f"{path}/_columns/{hashlib.sha256(text.encode()).hexdigest()[:16]}"
    spark = points.sparkSession
    if not exists(spark, f"{place}/_SUCCESS"):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(place)


def stated_schema(spark: SparkSession, path: str) -> StructType:
    """The store's columns: the fixed ones and those stated by writers."""
    schema = StructType.fromDDL(POINTS)
    if exists(spark, f"{path}/_columns"):
        for row in spark.read.text(f"{path}/_columns/*").distinct().orderBy("value").collect():
            for field in StructType.fromJson(json.loads(row["value"])).fields:
                if field.name not in schema.names:
                    schema = schema.add(field)
                elif schema[field.name].dataType != field.dataType:
                    raise ValueError(f"{field.name} was written as {schema[field.name].dataType} and {field.dataType}")
    return schema.add("date", "date")


def state_columns_of(spark: SparkSession, path: str) -> None:
    """States the columns of a store written without, from the footers of all its files."""
    _state_columns(spark.read.option("mergeSchema", True).parquet(path), path)


def scan_points(spark: SparkSession, path: str, resolve: bool = True) -> DataFrame:
    """Every stored point, copies resolved, whatever columns its table has.

    Columns a table never wrote are NULL. Filters on ``measurement`` and ``date``
    prune folders, those on ``sensor_id`` row groups.
    """
    schema = stated_schema(spark, path)
    stored = spark.read.schema(schema).parquet(path).select(schema.names)
    return last_write_wins(stored) if resolve else stored


def scan_measurement(
    spark: SparkSession,
    path: str,
    measurement: str,
    start: str | None = None,
    end: str | None = None,
    resolve: bool = True,
) -> DataFrame:
    """One measurement, optionally between two dates; other folders are not read."""
    chosen = scan_points(spark, path, resolve=False).filter(F.col("measurement") == measurement)
    if start is not None:
        chosen = chosen.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        chosen = chosen.filter(F.col("date") <= F.lit(end).cast("date"))
    return last_write_wins(chosen) if resolve else chosen


def list_measurements(points: DataFrame) -> DataFrame:
    return points.select("measurement").distinct().orderBy("measurement")


def compact_points(
    spark: SparkSession, source: str, target: str, measurements: Sequence[str] | None = None
) -> None:
    """Write the resolved points of a store to another folder."""
    points = scan_points(spark, source)
    if measurements is not None:
        points = points.filter(F.col("measurement").isin(*measurements))
    write_points(points.drop("date"), target)


def compact_in_place(spark: SparkSession, path: str, max_files: int = FOLDER_FILES) -> int:
    """Compacts the folders with more than ``max_files`` files; returns how many they were.

    A folder's points are written again, copies resolved, and then the files that were read
    are deleted; files that came meanwhile stay. Until then points are there twice, which
    readers resolve anyway, so it may break off anywhere and be called again.
    """
    folders = defaultdict(list)
    for file in scan_points(spark, path, resolve=False).inputFiles():
        folders[posixpath.dirname(file)].append(file)
    full = sorted(f for f, files in folders.items() if len(files) > max_files)
    schema = stated_schema(spark, path)
    for at in range(0, len(full), FOLDERS_AT_ONCE):
        files = [f for folder in full[at : at + FOLDERS_AT_ONCE] for f in folders[folder]]
        stored = spark.read.schema(schema).option("basePath", path).parquet(*files)
        write_points(last_write_wins(stored.select(schema.names)).drop("date"), path)
        remove(spark, files)
    return len(full)
