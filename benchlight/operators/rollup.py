"""Rollups: mergeable parts of a series, kept per minute, hour and day.

A part holds what two parts of one step can be merged from: sum, count, least, greatest and
the last value with its key. Each batch of points adds its parts at every level, the coarser
made of the finer; a question about a long range reads the coarsest level that divides its
step, and no points. Points are added once; copies of a point have to be resolved before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from benchlight.operators.health import seconds, window_start
from benchlight.operators.ordered import last_key

# Seconds of a step at each level, finest first; each divides the next.
LEVELS = (60, 3600, 86_400)
KEYS = ["measurement", "sensor_id", "step"]


def parts(points: DataFrame, level: int = LEVELS[0]) -> DataFrame:
    """The parts of points with a value, by measurement, sensor and step."""
    valued = points.filter(F.col("value").isNotNull())
    return valued.groupBy("measurement", "sensor_id", window_start("time", f"{level} seconds").alias("step")).agg(
        F.sum("value").alias("total"),
        F.count("value").alias("readings"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.max(last_key()).alias("last_key"),
        F.max_by("value", last_key()).alias("last_value"),
    )


def merged(rows: DataFrame, step: str) -> DataFrame:
    """Parts merged into steps that theirs divide."""
    return rows.groupBy("measurement", "sensor_id", window_start("step", step).alias("step")).agg(
        F.sum("total").alias("total"),
        F.sum("readings").alias("readings"),
        F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"),
        F.max("last_key").alias("last_key"),
        F.max_by("last_value", "last_key").alias("last_value"),
    )


def level_for(step: str) -> int:
    """The coarsest level that divides a step."""
    fitting = [level for level in LEVELS if seconds(step) % level == 0]
    if not fitting:
        raise ValueError(f"a step of {step} is not made of whole minutes")
    return fitting[-1]


def add_points(points: DataFrame, path: str, batch: int) -> None:
    """Adds a batch's parts at every level; the same batch again replaces what it added."""
    spark, finest = points.sparkSession, f"{path}/level={LEVELS[0]}/batch={batch}"
    parts(points).write.mode("overwrite").parquet(finest)
    for finer, level in zip(LEVELS, LEVELS[1:], strict=False):
        below = spark.read.parquet(f"{path}/level={finer}/batch={batch}")
        merged(below, f"{level} seconds").write.mode("overwrite").parquet(f"{path}/level={level}/batch={batch}")


def stream_rollup(
    points: DataFrame, path: str, checkpoint: str, trigger: str | None = None
) -> StreamingQuery:
    """Adds the points of a stream batch by batch, in any order of time."""
    when = {"availableNow": True} if trigger is None else {"processingTime": trigger}
    writer = points.writeStream.option("checkpointLocation", checkpoint).trigger(**when)
    return writer.foreachBatch(lambda rows, batch: add_points(rows, path, batch)).start()


def downsample_rollup(
    spark: SparkSession, path: str, step: str, start=None, end=None, measurement: str | None = None
) -> DataFrame:
    """What ``downsample`` says of the points added, from parts alone.

    ``start`` and ``end`` choose whole steps: those that begin at or after ``start`` and
    before ``end``.
    """
    rows = spark.read.parquet(f"{path}/level={level_for(step)}")
    if measurement is not None:
        rows = rows.filter(F.col("measurement") == measurement)
    if start is not None:
        rows = rows.filter(F.col("step") >= F.lit(start))
    if end is not None:  # a step that begins before the end is whole
        rows = rows.filter(F.col("step") < F.lit(end) + F.make_dt_interval(secs=F.lit(seconds(step))))
    found = merged(rows, step)
    if start is not None:
        found = found.filter(F.col("step") >= F.lit(start))
    if end is not None:
        found = found.filter(F.col("step") < F.lit(end))
    return found.select(
        "sensor_id",
        "step",
        (F.col("total") / F.col("readings")).alias("avg_value"),
        "min_value",
        "max_value",
        "readings",
        "last_value",
    )
