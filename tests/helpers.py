"""Small tables for tests."""

from datetime import datetime, timedelta, timezone

from benchlight.operators import calibrate as cal
from benchlight.plans import fixtures as fx

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(seconds: float) -> datetime:
    return START + timedelta(seconds=seconds)


def one_channel(spark, **row):
    """A calibration table of one channel A0."""
    base = {"channel": "A0", "revision": 1, "sensor_id": "s", "measurement": "m"}
    return fx.calibrations(spark, [base | row])


def values_at(spark, calibrations, volts):
    """The value of channel A0 at each voltage, and its unit."""
    counts = spark.createDataFrame(
        [(i, at(i), "A0", v * 4095 / 3.3) for i, v in enumerate(volts)],
        "seq bigint, time timestamp, channel string, raw_count double",
    )
    valued = cal.calibrate(counts, cal.conversions(calibrations), cal.formula_texts(calibrations))
    rows = valued.orderBy("seq").collect()
    return [r["value"] for r in rows], rows[0]["unit"] if rows else None
