"""Questions asked of stored points: ranges, latest values, series, inventories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchlight.functions.text import format_reading, panel_unit
from benchlight.operators.health import window_start
from benchlight.operators.ordered import (
    SPLIT_ROWS,
    chunked_previous,
    in_chunk,
    last_before,
    last_key,
    order_key,
    so_far,
    with_chunks,
    with_previous,
)
from benchlight.schema import CARRIER_HZ
from benchlight.session import settle

MAX_SERIES_POINTS = 1000


# --- filters --------------------------------------------------------------------


def time_range(points: DataFrame, start, end, ordered: bool = True) -> DataFrame:
    """Points of a range, both ends included, oldest first."""
    chosen = points.filter(F.col("time").between(F.lit(start), F.lit(end)))
    return chosen.orderBy("time", "seq") if ordered else chosen


def sensors_in(points: DataFrame, sensors: str | Sequence[str]) -> DataFrame:
    """Points of the chosen sensors: one name or several."""
    if isinstance(sensors, str):
        return points.filter(F.col("sensor_id") == F.lit(sensors))
    return points.filter(F.col("sensor_id").isin(*sensors))


def query_measurements(
    points: DataFrame, measurements: Sequence[str], query: str, **args
) -> DataFrame:
    """SQL over one table per measurement, named in braces, as ``{temperature}``.

    ``:name`` markers are bound, never pasted. No view is left in the session, nor one of
    the same name replaced.
    """
    tables = {name: points.filter(F.col("measurement") == name) for name in measurements}
    return points.sparkSession.sql(query, args=args, **tables)


# --- latest values --------------------------------------------------------------


def latest_value(points: DataFrame, sensor: str) -> DataFrame:
    """The newest row of one sensor."""
    return newest_rows(sensors_in(points, sensor), 1)


def newest_rows(points: DataFrame, count: int | None = None) -> DataFrame:
    """Newest points first; ``count`` limits them."""
    ordered = points.orderBy(F.col("time").desc(), F.col("seq").desc())
    return ordered if count is None else ordered.limit(count)


def latest_per_sensor(
    points: DataFrame, columns: Sequence[str] = ("time", "value", "unit"), by=("sensor_id",)
) -> DataFrame:
    """The newest row per sensor that has a value.

    One pass, hashed and combined before the shuffle: numbers are kept beside a key of fixed
    size, and texts are part of the group, as a sensor has few units and ids. What is left,
    a row per sensor and texts, is then reduced to one per sensor.
    """
    needed = dict.fromkeys([*by, *columns, "time", "seq", "value"])
    kinds = dict(points.select(*needed).dtypes)
    grouped = [c for c in columns if c not in by and not _is_fixed(kinds[c])]
    plain = [c for c in columns if c not in by and c not in grouped]
    valued = points.filter(F.col("value").isNotNull()).withColumn("_key", last_key())
    few = valued.groupBy(*by, *grouped).agg(
        F.max("_key").alias("_newest"), *[F.max_by(c, "_key").alias(c) for c in plain]
    )
    rest = F.struct(*grouped, *plain)
    rows = few.groupBy(*by).agg(F.max_by(rest, "_newest").alias("_row"))
    return rows.select(*by, *[F.col(f"_row.{c}").alias(c) for c in columns if c not in by])


def _is_fixed(kind: str) -> bool:
    """Whether a value has a fixed size, so that it fits a hashed group's buffer."""
    return kind in ("boolean", "date", "timestamp", "timestamp_ntz", "float", "double") or kind.endswith("int")


def last_write_wins(points: DataFrame) -> DataFrame:
    """One row per measurement, tag set and millisecond: the one written last.

    Rows are in one total order: by ``seq``, NULL first, and of equal ``seq`` by a hash
    of the row, so that all columns come from one row. Copies are combined before the
    shuffle, so a point written millions of times reaches it once per task.
    """
    named = ["measurement", "time", "sensor_id", "unit", "calibration_id"]
    rest = [c for c in points.columns if c not in (*named, "tags")]
    rows = points.withColumn("time", F.date_trunc("millisecond", "time"))
    keys = list(named)
    if "tags" in points.columns:
        rows = rows.withColumn("_tags", F.array_sort(F.map_entries("tags")))
        keys.append("_tags")
    if "date" in points.columns:  # it follows from the time; as a key it still prunes
        rest.remove("date")
        keys.append("date")
    # Column by column: numbers stay in fixed buffers and the groups are hashed.
    kept = (
        rows.withColumn("_order", _write_order(rows.select(*rest)))
        .groupBy(*keys)
        .agg(*[F.max_by(c, "_order").alias(c) for c in rest])
    )
    if "tags" in points.columns:
        kept = kept.withColumn("tags", F.map_from_entries("_tags"))
    return kept.select(*points.columns)


def _write_order(rows: DataFrame) -> Column:
    """``seq`` before a hash of the row, as one number."""
    mark = F.xxhash64(F.lit(0), *[c for c, kind in rows.dtypes if c != "seq" and "map<" not in kind])
    mark = mark.bitwiseAND(F.lit(2**63 - 1)).cast("decimal(19,0)")
    step = F.lit(str(2**63)).cast("decimal(19,0)")
    seq = F.coalesce(F.col("seq"), F.lit(-(2**62))).cast("decimal(19,0)")
    return (seq * step + mark).cast("decimal(38,0)")


# --- series ---------------------------------------------------------------------


def downsample(points: DataFrame, step: str) -> DataFrame:
    """Average, extremes, count and last value per sensor and step."""
    return (
        points.groupBy("sensor_id", window_start("time", step).alias("step"))
        .agg(
            F.avg("value").alias("avg_value"),
            F.min("value").alias("min_value"),
            F.max("value").alias("max_value"),
            F.count("value").alias("readings"),
            F.max_by("value", last_key()).alias("last_value"),
        )
    )


def step_for(start_s: int, end_s: int, points: int = MAX_SERIES_POINTS) -> str:
    """The step that draws a range with about ``points`` points."""
    return f"{max(1, -(-(end_s - start_s) // points))} seconds"


def sparkline(points: DataFrame, start, end, step: str) -> DataFrame:
    """Per sensor the averaged trace of a range as an ordered list, and its last value.

    The list holds one entry per step, so its length is bounded by the range and
    not by the readings; ``step_for`` picks a step for a range.
    """
    reduced = downsample(time_range(points, start, end, ordered=False), step)
    return reduced.groupBy("sensor_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("step", "avg_value"))), lambda s: s["avg_value"]
        ).alias("trace"),
        F.max_by("last_value", "step").alias("last_value"),
    )


def series_wide(points: DataFrame, sensors: Sequence[str]) -> DataFrame:
    """One column per named sensor and one row per time; the long form is the default."""
    return points.groupBy("time").pivot("sensor_id", list(sensors)).agg(F.max("value"))


def xy_pairs(points: DataFrame, x: str, y: str, step: str = "1 second") -> DataFrame:
    """The last ``x`` and the last ``y`` of each step in which both have a value."""
    return (
        sensors_in(points, [x, y])
        .groupBy(window_start("time", step).alias("step"))
        .agg(
            _last_of(x).alias("x"),
            _last_of(y).alias("y"),
        )
        .filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    )


def _last_of(sensor: str) -> Column:
    mine = F.col("sensor_id") == sensor
    return F.max_by(F.when(mine, F.col("value")), F.when(mine, last_key()))


def latest_pair(pairs: DataFrame) -> DataFrame:
    """Where the pair is now, under names of its own."""
    return (
        pairs.orderBy(F.col("step").desc())
        .limit(1)
        .select("step", F.col("x").alias("now_x"), F.col("y").alias("now_y"))
    )


def detuning(points: DataFrame, carrier: float = CARRIER_HZ) -> DataFrame:
    """Offset of a frequency from its carrier."""
    return points.withColumn("detuning", F.col("value") - F.lit(carrier))


def calibration_layer(points: DataFrame, sensor: str) -> DataFrame:
    """A channel's value beside the voltage it came from, with its display unit."""
    return sensors_in(points, sensor).select(
        "time", "seq", "input_volts", "value", "unit", panel_unit(F.col("unit")).alias("panel_unit")
    )


def data_gaps(points: DataFrame, silence_s: float, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Intervals longer than ``silence_s`` between neighbouring points of a sensor."""
    times = settle(points.select("sensor_id", "time", "seq"))  # read for counts, edges and rows
    paired = with_previous(times, ["sensor_id"], ["time"], "before", split_rows)
    length = (F.unix_micros("time") - F.unix_micros("before.time")) / 1e6
    return paired.select(
        "sensor_id",
        F.col("before.time").alias("gap_start"),
        F.col("time").alias("gap_end"),
        length.alias("gap_s"),
    ).filter(F.col("gap_s") > silence_s)


# --- inventories ----------------------------------------------------------------


def union_measurements(tables: Sequence[DataFrame]) -> DataFrame:
    """Tables of different columns under one another; a missing column is NULL."""
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table, allowMissingColumns=True)
    return result


def inventory(points: DataFrame) -> DataFrame:
    """Per measurement and sensor: latest reading, its unit, raw input and origin."""
    latest = latest_per_sensor(
        points,
        ["time", "value", "unit", "input_volts", "calibration_id"],
        by=("measurement", "sensor_id"),
    )
    return latest.withColumns(
        {
            "origin": F.when(F.col("calibration_id").isNull(), "simulated").otherwise("calibrated"),
            "reading": format_reading(F.col("measurement"), F.col("value")),
        }
    )


# --- bursts ---------------------------------------------------------------------


def mains_window_us(mains_hz: int = 50, periods: int = 1) -> int:
    """An averaging window of a whole number of mains periods, so pickup cancels."""
    return 1_000_000 // mains_hz * periods


def burst_average(
    samples: DataFrame,
    source: str = "source",
    window_us: int = mains_window_us(),
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """Mean count per burst and averaging window.

    A source dwells on one channel (a burst), then switches to the next. The first
    sample after a switch still carries the previous channel's voltage and is left
    out. A burst longer than the window gives one mean per window.
    """
    keys = [source]
    samples = settle(samples.select(source, "channel", "time", "seq", "raw_count"))
    chunked, chunk = with_chunks(samples, keys, split_rows)
    rows = chunked_previous(chunked, keys, chunk, ["channel"], "_before")
    switched = F.col("_before").isNull() | (F.col("_before.channel") != F.col("channel"))
    rows = rows.withColumn("_switch", F.when(switched, order_key()))
    latest = F.last("_switch", ignorenulls=True)
    switches = rows.groupBy(*keys, *chunk).agg(F.max("_switch").alias("_last"))
    carried = last_before(switches, keys, chunk, ["_last"]).select(
        *keys, *chunk, F.col("_before__last").alias("_open")
    )
    began = F.coalesce(latest.over(so_far(in_chunk(keys, chunk))), F.col("_open"))
    elapsed = F.unix_micros("time") - F.unix_micros("_began.time")
    return (
        rows.join(carried, [*keys, *chunk])
        .withColumn("_began", began)
        .filter(F.col("_switch").isNull())
        .groupBy(
            *keys,
            "channel",
            F.col("_began.time").alias("burst_start"),
            F.col("_began.seq").alias("burst_seq"),
            F.floor(elapsed / F.lit(window_us)).alias("window_no"),
        )
        .agg(F.avg("raw_count").alias("raw_count"), F.count("raw_count").alias("samples"))
    )
