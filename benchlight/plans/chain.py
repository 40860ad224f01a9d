"""The acquisition chain in one plan: lines to gated points and their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchlight.operators.calibrate import (
    LABELS,
    as_points,
    calibrate,
    conversions,
    drop_non_finite,
    formula_texts,
    uncalibrated_readings,
)
from benchlight.operators.gate import EVENT_COLUMNS, gate_events, recording_gate
from benchlight.operators.health import in_order, sensor_summary
from benchlight.operators.ordered import SPLIT_ROWS
from benchlight.session import settle
from benchlight.sources.wire import parse_wire, readings


def gated_readings(
    lines: DataFrame, conv: DataFrame, formulas: list[str], split_rows: int = SPLIT_ROWS
) -> DataFrame:
    """Finite readings of calibrated channels with the gate's verdict."""
    return _gated(_valued(lines, conv, formulas), split_rows)


def _valued(lines: DataFrame, conv: DataFrame, formulas: list[str]) -> DataFrame:
    """Calibrated readings with their gate events, written once for the passes to come."""
    valued = calibrate(
        readings(parse_wire(lines)).drop("line"), conv, formulas, carry=["conversion", "gate"]
    )
    return settle(gate_events(valued))


def _gated(valued: DataFrame, split_rows: int) -> DataFrame:
    return recording_gate(drop_non_finite(valued), split_rows=split_rows)


def gated_points(
    lines: DataFrame, calibrations: DataFrame, split_rows: int = SPLIT_ROWS
) -> DataFrame:
    """Raw lines to the points a store keeps: parsed, calibrated, finite, admitted."""
    conv = conversions(calibrations)
    gated = gated_readings(lines, conv, formula_texts(calibrations), split_rows)
    labels = conv.select("conversion", *LABELS)
    return as_points(gated.filter("admitted").join(labels, "conversion"))


def reading_outcomes(
    lines: DataFrame, calibrations: DataFrame, split_rows: int = SPLIT_ROWS
) -> DataFrame:
    """What became of the lines of every channel: ``outcome`` and ``readings``.

    Each line that holds a reading is in exactly one class: written, gated out, skipped
    (its value is no finite number), or uncalibrated (no conversion was in force).
    """
    conv = conversions(calibrations)
    valued = _valued(lines, conv, formula_texts(calibrations))
    needed = valued.select("channel", "time", "seq", "finite", *EVENT_COLUMNS)
    gated = _gated(needed, split_rows).select(
        "channel", F.when(F.col("admitted"), "written").otherwise("gated out").alias("outcome")
    )
    skipped = needed.filter(~F.col("finite")).select("channel", F.lit("skipped").alias("outcome"))
    strangers = uncalibrated_readings(readings(parse_wire(lines)), calibrations).select(
        "channel", F.lit("uncalibrated").alias("outcome")
    )
    every = gated.unionByName(skipped).unionByName(strangers)
    return every.groupBy("channel", "outcome").agg(F.count(F.lit(1)).alias("readings"))


def summarise(
    lines: DataFrame, calibrations: DataFrame, every: str, split_rows: int = SPLIT_ROWS
) -> DataFrame:
    """Readings and skips per declared sensor and window, from raw lines."""
    conv = conversions(calibrations)
    valued = _valued(lines, conv, formula_texts(calibrations))
    needed = valued.select("channel", "conversion", "time", "seq", "finite", *EVENT_COLUMNS)
    columns = ["conversion", "time", "written"]
    written = _gated(needed, split_rows).filter("admitted").withColumn("written", F.lit(True))
    skipped = needed.filter(~F.col("finite")).withColumn("written", F.lit(False))
    outcomes = written.select(columns).unionByName(skipped.select(columns))
    sensors = conv.select("conversion", "sensor_id")
    return in_order(
        sensor_summary(outcomes.join(sensors, "conversion"), sensors, lines.select("time"), every)
    )
