"""Is everything still reporting? Summaries that include what is silent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchlight.schema import SUMMARY_WINDOW


WINDOWS_PER_ROW = 2880


def window_start(time: Column | str, every: str) -> Column:
    """Start of the epoch-aligned window a time falls in."""
    return F.window(time, every)["start"]


def sensor_summary(
    outcomes: DataFrame,
    declared: DataFrame,
    clock: DataFrame,
    every: str = SUMMARY_WINDOW,
) -> DataFrame:
    """Readings written and skipped per sensor and window, zeros included.

    ``outcomes`` holds ``time``, ``sensor_id`` and ``written`` (false = skipped);
    readings a gate refused or without a calibration are in neither count and not
    in it. ``declared`` holds the ``sensor_id`` of every sensor expected to report,
    ``clock`` the ``time`` of everything that shows the process was running: each
    declared sensor has a row for every window between its first and last.
    """
    ticks = windows(declared, clock, every).select(
        "sensor_id", "window_start", F.lit(0).alias("_written"), F.lit(0).alias("_skipped")
    )
    counted = outcomes.select(
        "sensor_id",
        window_start("time", every).alias("window_start"),
        F.col("written").cast("int").alias("_written"),
        (~F.col("written")).cast("int").alias("_skipped"),
    )
    return (
        counted.unionByName(ticks)
        .groupBy("window_start", "sensor_id")
        .agg(F.sum("_written").alias("readings"), F.sum("_skipped").alias("skipped"))
        .withColumn("window_s", F.lit(seconds(every)))
    )


def windows(declared: DataFrame, clock: DataFrame, every: str) -> DataFrame:
    """Every window from the first to the last ``time`` of ``clock``, per declared sensor.

    Spread in two steps, so that no row holds an array as long as the history.
    """
    width = seconds(every)
    span = clock.agg(
        F.struct(
            F.floor(F.unix_seconds(F.min("time")) / width).alias("first"),
            F.floor(F.unix_seconds(F.max("time")) / width).alias("last"),
        )
    ).scalar()
    part = F.explode(F.sequence(F.col("_first"), F.col("_last"), F.lit(WINDOWS_PER_ROW).cast("bigint")))
    until = F.least(F.col("_part") + (WINDOWS_PER_ROW - 1), F.col("_last"))
    return (
        declared.select("sensor_id")
        .distinct()
        .select("sensor_id", span["first"].alias("_first"), span["last"].alias("_last"))
        .filter("_first IS NOT NULL")
        .select("sensor_id", "_last", part.alias("_part"))
        .select("sensor_id", F.explode(F.sequence(F.col("_part"), until)).alias("_n"))
        .select("sensor_id", F.timestamp_seconds(F.col("_n") * width).alias("window_start"))
    )


def in_order(summary: DataFrame) -> DataFrame:
    """A summary as it is reported: window by window, sorted by sensor."""
    return summary.orderBy("window_start", "sensor_id")


def seconds(every: str) -> int:
    """Length of a window such as ``30 seconds`` or ``6 hours``."""
    count, name = every.split()
    return int(count) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[name.rstrip("s")]


def silent_sensors(summary: DataFrame) -> DataFrame:
    """Windows without a reading: ``unwritable`` when some were skipped, else ``silent``."""
    return summary.filter("readings = 0").withColumn(
        "state", F.when(F.col("skipped") > 0, "unwritable").otherwise("silent")
    )


def coverage_gaps(
    expected: DataFrame, seen: DataFrame, exempt: DataFrame, name: str = "name"
) -> DataFrame:
    """Expected names that never occur and are not exempt from occurring."""
    return (
        expected.select(name)
        .distinct()
        .join(exempt.select(name), name, "left_anti")
        .join(seen.select(name), name, "left_anti")
    )


def failure_report(failures: DataFrame) -> DataFrame:
    """Failures by reason, with the labels that failed so.

    ``failures`` has ``label`` and ``reason``. Labels are names of declared things
    (panels, sensors, containers) and are made distinct before they are collected,
    so a list is as long as the declaration, however many failures there are.
    """
    per_label = failures.groupBy("reason", "label").agg(F.count(F.lit(1)).alias("n"))
    return per_label.groupBy("reason").agg(
        F.array_sort(F.collect_list("label")).alias("labels"),
        F.sum("n").alias("failures"),
    )
