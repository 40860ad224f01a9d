"""Readings that arrive in physical units, with no conversion to apply."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchlight.schema import CALIBRATION_ID, INPUT_VOLTS, SENSOR_ID, VALUE


def is_finite(x: Column) -> Column:
    """False for NULL, NaN and both infinities."""
    finite = ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(finite, F.lit(False))


def physical_readings(
    df: DataFrame,
    sensor_id: Column,
    measurement: Column,
    unit: Column | None = None,
    value: str = VALUE,
    field: str = VALUE,
    tags: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Any frame with ``time``, ``seq`` and a value column as points.

    A NULL value is a skipped tick and a non-finite one is refused. An empty unit
    becomes NULL: an empty tag would split the series in two. Tags given here are
    kept beside a ``tags`` map the frame already has. The value lands in ``field``.
    """
    fresh = (
        F.create_map(*[x for k, c in tags.items() for x in (F.lit(k), c.cast("string"))])
        if tags
        else F.create_map().cast("map<string,string>")
    )
    # A tag given here replaces one of the same name.
    if "tags" in df.columns:
        kept = F.map_filter("tags", lambda k, _: ~F.array_contains(F.map_keys(fresh), k))
        all_tags = F.map_concat(F.coalesce(kept, F.create_map().cast("map<string,string>")), fresh)
    else:
        all_tags = fresh
    filled = F.map_filter(all_tags, lambda _, v: v.isNotNull())
    no_text = F.lit(None).cast("string")
    return df.filter(is_finite(F.col(value))).select(
        measurement.alias("measurement"),
        F.date_trunc("millisecond", "time").alias("time"),
        sensor_id.alias(SENSOR_ID),
        (no_text if unit is None else F.nullif(unit, F.lit(""))).alias("unit"),
        no_text.alias(CALIBRATION_ID),
        F.col(value).cast("double").alias(field),
        F.lit(None).cast("double").alias(INPUT_VOLTS),
        filled.alias("tags"),
        "seq",
    )


def several_fields(df: DataFrame, fields: Mapping[str, tuple[str, str]]) -> DataFrame:
    """One device read with several columns as one row per measured quantity.

    ``fields`` maps a column to its (measurement, unit); the rows come back with
    ``measurement``, ``unit`` and ``value``, ready for :func:`physical_readings`.
    """
    keep = [c for c in df.columns if c not in fields]
    reads = F.array(
        *[
            F.struct(
                F.lit(measurement).alias("measurement"),
                F.lit(unit).alias("unit"),
                F.col(column).cast("double").alias(VALUE),
            )
            for column, (measurement, unit) in fields.items()
        ]
    )
    return df.select(*keep, F.inline(reads))
