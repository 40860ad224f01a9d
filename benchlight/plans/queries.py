"""The published queries: each takes (spark, sf_dir) and returns a frame.

Every one reads whole test tables. Lists and maps are rendered as text, and
computed doubles rounded, so that an oracle can be compared by value.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchlight.functions.text import logfmt_fields, logfmt_token, panel_unit, to_logfmt
from benchlight.functions.units import convert_units
from benchlight.operators import calibrate as cal
from benchlight.operators import gate, health, loglines, measure, rollup
from benchlight.operators.checks import validate_calibrations
from benchlight.plans import fixtures as fx
from benchlight.plans import chain
from benchlight.session import literal_rows, shared_folder
from benchlight.sources import logs, physical, store, wire
from benchlight.streaming import stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) + F.lit(0.0) for c, n in digits.items()})  # no -0.0


def _shown(df: DataFrame, **digits: int) -> DataFrame:
    """Values rounded; those of the electrode span decades and are given as such."""
    pressure = F.col("sensor_id") == "electrode"
    return df.withColumns(
        {c: F.round(F.when(pressure, F.log10(c)).otherwise(F.col(c)), n) for c, n in digits.items()}
    )


def _calibrate(readings: DataFrame, calibrations: DataFrame) -> DataFrame:
    return cal.calibrate(
        readings, cal.conversions(calibrations), cal.formula_texts(calibrations)
    )


# --- wire lines -------------------------------------------------------------------


@query
def parse_ok(spark, sf):
    return wire.readings(wire.parse_wire(fx.wire_lines(spark, sf))).drop("line")


@query
def quarantine(spark, sf):
    return wire.quarantine(wire.parse_wire(fx.wire_lines(spark, sf)))


@query
def malformed_by_reason(spark, sf):
    return wire.malformed_by_reason(wire.parse_wire(fx.wire_lines(spark, sf)))


@query
def raw_to_voltage(spark, sf):
    readings = fx.scale_readings(spark, sf)
    volts = F.round(cal.raw_to_voltage(F.col("raw_count")), 6)
    return readings.select("seq", "channel", volts.alias("volts"))


def _text_files(spark, sf, columns: str) -> str:
    """The derived lines as text files of a folder, several."""
    folder = shared_folder(spark)
    fx.wire_lines(spark, sf).selectExpr(columns).repartition(3).write.text(folder)
    return folder


@query
def read_wire(spark, sf):
    """Lines of files by channel and reason, and whether each has a time of its own."""
    lines = wire.read_wire(spark, _text_files(spark, sf, "line"))
    return wire.parse_wire(lines).groupBy("channel", "reason").agg(
        F.count("seq").alias("lines"), F.count_distinct("time", "seq").alias("places")
    )


@query
def read_wire_stamped(spark, sf):
    """Lines that bring their own time, read as a stream."""
    stamp = "concat(date_format(time, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\"), chr(9), line)"
    lines = wire.read_wire(spark, _text_files(spark, sf, stamp), streaming=True, stamped=True)
    folder = shared_folder(spark)
    found = wire.readings(wire.parse_wire(lines)).drop("line", "seq")
    writer = found.writeStream.option("checkpointLocation", f"{folder}/log").trigger(availableNow=True)
    writer.format("parquet").start(f"{folder}/out").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query
def read_logs(spark, sf):
    """Log records written as JSON files and read back."""
    folder = shared_folder(spark)
    fx.log_records(spark, sf).repartition(3).write.json(folder)
    return logs.read_logs(spark, folder).select("source", "ts", "seq", "line", "systemd_unit", "client_name")


@query
def scan_measurement(spark, sf):
    """One measurement between two days, out of a store whose points were written twice."""
    folder = shared_folder(spark)
    for _ in range(2):
        store.write_points(fx.event_points(spark, sf), folder)
    store.compact_in_place(spark, folder, max_files=1)
    found = store.scan_measurement(spark, folder, "temperature", "2024-01-10", "2024-01-12")
    return _rounded(found.select("sensor_id", "time", "seq", "value", "input_volts"), value=6, input_volts=6)


# --- calibration ------------------------------------------------------------------


def _channel_values(spark, sf, *channels: str) -> DataFrame:
    readings = wire.readings(wire.parse_wire(fx.wire_lines(spark, sf)))
    chosen = readings.filter(F.col("channel").isin(*channels))
    valued = _calibrate(chosen, fx.demo_calibrations(spark))
    return valued.select("channel", "seq", "unit", F.round("value", 6).alias("value"))


@query
def calibrate_linear(spark, sf):
    return _channel_values(spark, sf, "in2", "in7")


@query
def calibrate_affine(spark, sf):
    return _channel_values(spark, sf, "in3", "in5")


@query
def calibrate_piecewise(spark, sf):
    return _channel_values(spark, sf, "in0", "in6")


@query
def calibrate_spline(spark, sf):
    return _channel_values(spark, sf, "in1")


@query
def calibrate_expression(spark, sf):
    readings = wire.readings(wire.parse_wire(fx.wire_lines(spark, sf)))
    valued = _calibrate(
        readings.filter(F.col("channel") == "in4"), fx.demo_calibrations(spark)
    )
    return valued.select("seq", "unit", F.round(F.log10("value"), 6).alias("log_value"))


@query
def uncalibrated_channels(spark, sf):
    fx.load(spark, sf, "events")
    readings = spark.sql(
        "SELECT event_id AS seq, date_trunc('millisecond', ts) AS time,"
        " concat('in', CAST(user_id AS STRING)) AS channel, value AS raw_count FROM events"
    )
    return cal.uncalibrated_channels(readings, fx.demo_calibrations(spark))


@query
def calibrated_points(spark, sf):
    readings = wire.readings(wire.parse_wire(fx.wire_lines(spark, sf)))
    valued = cal.drop_non_finite(_calibrate(readings, fx.demo_calibrations(spark)))
    points = cal.as_points(valued).drop("tags", "calibration_id")
    return _rounded(_shown(points, value=6), input_volts=6)


@query
def store_input_override(spark, sf):
    """Which points kept their input voltage."""
    points = fx.event_points(spark, sf)
    return points.groupBy("sensor_id").agg(
        F.count("input_volts").alias("kept"), F.count("value").alias("points")
    )


def _awkward_values(spark, sf) -> DataFrame:
    """A channel whose formula is undefined over part of its range."""
    rows = [
        {
            "channel": f"in{i}", "revision": 1, "sensor_id": f"probe-{i}", "mode": "expression",
            "measurement": "level", "formula": text, "value_unit": "K",
        }
        for i, text in enumerate(["log(v - 1.0)", "1/(v - v)", "sqrt(v - 2)", "10**(900*v)", "v"])
    ]
    return _calibrate(fx.event_readings(spark, sf), fx.calibrations(spark, rows))


@query
def skipped_non_finite(spark, sf):
    valued = _awkward_values(spark, sf)
    return valued.groupBy("sensor_id").agg(
        F.count_if("finite").alias("written"), F.count_if(~F.col("finite")).alias("skipped")
    )


@query
def first_non_finite(spark, sf):
    first = cal.first_non_finite(_awkward_values(spark, sf))
    kind = F.when(F.isnan("value"), "nan").when(F.col("value").isNull(), "undefined").otherwise("infinite")
    return _rounded(first.withColumn("value", kind), input_volts=6)


@query
def calibration_ids(spark, sf):
    """Every row's id, NULL where the row is broken."""
    resolved = cal.resolve(fx.part_calibrations(spark, sf))
    return resolved.select("channel", "unit", F.expr(cal.calibration_id()).alias("calibration_id"))


@query
def calibrations_report(spark, sf):
    return cal.calibrations_report(fx.part_calibrations(spark, sf))


@query
def fit_segments(spark, sf):
    """Where each part's curve puts its segments, and how it behaves inside them."""
    fitted = cal.fit_segments(cal.resolve(fx.part_calibrations(spark, sf)))
    pieces = fitted.filter(
        "mode IN ('spline', 'piecewise_linear') AND segments IS NOT NULL"
    ).select("channel", "mode", F.inline("segments"))
    pieces = pieces.withColumns(
        {
            "v_lo": F.when(F.col("v_lo") > float("-inf"), F.col("v_lo")),
            "v_hi": F.when(F.col("v_hi") < float("inf"), F.col("v_hi")),
        }
    )
    return _rounded(pieces, c0=6, c1=6, c2=6, c3=6)


@query
def validate_calibration_table(spark, sf):
    return validate_calibrations(fx.part_calibrations(spark, sf))


@query
def validate_repeated_calibrations(spark, sf):
    """The same where a part of the table was pasted in twice."""
    table = fx.part_calibrations(spark, sf)
    return validate_calibrations(table.unionByName(table.filter("revision % 4 = 0")))


def _revised_points(spark, sf) -> DataFrame:
    valued = _calibrate(fx.event_readings(spark, sf), fx.revised_calibrations(spark))
    return cal.as_points(cal.drop_non_finite(valued))


@query
def recalibrate(spark, sf):
    """Stored points under the corrected calibrations of the stirrer."""
    rows = [
        row | {"factor": row["factor"] * 1.1}
        for row in fx.demo_rows()
        if row["channel"] in ("in2", "in3")
    ]
    points = cal.recalibrate(fx.event_points(spark, sf), fx.calibrations(spark, rows))
    return _shown(
        points.select(
            "sensor_id", "seq", "value", "old_value", "correctable", "unit"
        ),
        value=6,
        old_value=6,
    )


@query
def calibration_in_force(spark, sf):
    points = cal.calibration_in_force(
        fx.event_points(spark, sf), fx.revised_calibrations(spark)
    )
    return points.groupBy("sensor_id", "revision_in_force", "current").agg(
        F.count("seq").alias("points"), F.min("time").alias("first_time")
    )


@query
def calibration_usage(spark, sf):
    return cal.calibration_usage(_revised_points(spark, sf))


@query
def convert_to_watts(spark, sf):
    readings = fx.derive(spark, sf, fx.PHYSICAL_SQL).filter("value IS NOT NULL AND NOT isnan(value)")
    converted = convert_units(readings.withColumn("unit", F.nullif("unit", F.lit(""))), "W")
    return _rounded(
        converted.select("seq", "sensor_id", "converted", "converted_unit", "violation"),
        converted=6,
    )


# --- gate and health --------------------------------------------------------------


def _gated(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The demo chain up to the gate, and the conversions it used."""
    calibrations = fx.demo_calibrations(spark)
    conv = cal.conversions(calibrations)
    lines = fx.wire_lines(spark, sf)
    return chain.gated_readings(lines, conv, cal.formula_texts(calibrations)), conv


@query
def recording_gate(spark, sf):
    gated, _ = _gated(spark, sf)
    return gated.select("channel", "seq", "was_recording", "admitted")


@query
def gated_points(spark, sf):
    """The whole chain, from lines to what a store keeps."""
    points = chain.gated_points(fx.wire_lines(spark, sf), fx.demo_calibrations(spark))
    return _rounded(_shown(points.drop("tags", "calibration_id"), value=6), input_volts=6)


@query
def gate_transitions(spark, sf):
    found = gate.gate_transitions(*_gated(spark, sf))
    return _rounded(found.drop("unit", "value_text"), value=6)


@query
def transition_lines(spark, sf):
    """Transitions as the log lines that report them."""
    found = gate.gate_transitions(*_gated(spark, sf))
    line = to_logfmt(
        {"level": F.lit("info"), "logger": F.lit("gate"), "msg": F.col("message")},
        {"sensor_id": F.col("sensor_id"), "limit": F.col("limit"), "value": F.col("value_text")},
    )
    return found.select("seq", line.alias("line"))


@query
def recording_gaps(spark, sf):
    return _rounded(gate.recording_gaps(gate.gate_transitions(*_gated(spark, sf))), duration_s=3)


SUMMARY = "6 hours"


def _summary(spark, sf) -> DataFrame:
    return chain.summarise(
        fx.wire_lines(spark, sf), fx.demo_calibrations(spark), SUMMARY
    )


def _rowdy_calibrations(spark) -> DataFrame:
    """The demo channels with broken, rival and late revisions, and dwells that change."""
    rows = fx.demo_rows()
    late = {"effective_from": datetime(2024, 1, 11)}
    of = {r["channel"]: r for r in rows}
    extra = [
        # Two rows for one time: the higher revision stands. One number twice.
        of["in2"] | {"revision": 0, "factor": 1.0},
        of["in2"] | late | {"gate": fx.GATE_RATE | {"dwell": 7.0, "dwell_unit": "h"}},
        of["in7"] | late | {"revision": 2, "gate": fx.GATE_SUPPLY | {"dwell": 20.0, "dwell_unit": "min"}},
        # A spline through one point, and a mode nobody knows.
        of["in1"] | late | {"points": fx.points((1.0, 300.0))},
        of["in0"] | late | {"mode": "cubic"},
        # In force from mid-month on only.
        {"channel": "in8", "revision": 1, "sensor_id": "late", "measurement": "level", "factor": 1.0,
         "factor_unit": "K/V", "effective_from": datetime(2024, 1, 16)},
    ]
    return fx.calibrations(spark, rows + extra)


@query
def reading_outcomes(spark, sf):
    """What became of every reading under a table with broken and rival revisions."""
    return chain.reading_outcomes(fx.wire_lines(spark, sf), _rowdy_calibrations(spark))


@query
def recording_gate_revised(spark, sf):
    """The gate where revisions change the dwell in the middle of a run."""
    calibrations = _rowdy_calibrations(spark)
    conv = cal.conversions(calibrations)
    gated = chain.gated_readings(fx.wire_lines(spark, sf), conv, cal.formula_texts(calibrations))
    return gated.select("channel", "seq", "was_recording", "admitted")


@query
def sensor_summary(spark, sf):
    return _summary(spark, sf)


@query
def silent_sensors(spark, sf):
    return health.silent_sensors(_summary(spark, sf))


def _names(spark, *names: str) -> DataFrame:
    return literal_rows(spark, [{"name": n} for n in names], "name string")


@query
def coverage_gaps(spark, sf):
    expected = _names(spark, *[f"c{i}" for i in range(13)])
    seen = fx.demo_logs(spark, sf).select(F.col("container").alias("name"))
    return health.coverage_gaps(expected, seen, _names(spark, "c12"))


@query
def failure_report(spark, sf):
    """Malformed lines by reason, with the boards that sent them."""
    lines = fx.derive(spark, sf, fx.BOARD_LINES_SQL)
    report = health.failure_report(wire.quarantine(wire.parse_wire(lines)))
    return report.withColumn("labels", F.array_join("labels", ","))


# --- measurements -----------------------------------------------------------------


def _demo_points(spark, sf) -> DataFrame:
    return fx.event_points(spark, sf).drop("tags", "calibration_id")


@query
def time_range(spark, sf):
    start, end = "2024-01-10 00:00:00", "2024-01-12 00:00:00"
    chosen = measure.time_range(
        _demo_points(spark, sf),
        F.lit(start).cast("timestamp"),
        F.lit(end).cast("timestamp"),
    )
    return _shown(chosen.select("time", "seq", "sensor_id", "value"), value=6)


@query
def sensors_in(spark, sf):
    chosen = measure.sensors_in(_demo_points(spark, sf), ["broth", "stirrer"])
    return _rounded(chosen.select("time", "seq", "sensor_id", "value"), value=6)


@query
def sql_over_measurements(spark, sf):
    answer = measure.query_measurements(
        _demo_points(spark, sf),
        ["temperature", "pressure"],
        "SELECT t.sensor_id, count(*) AS high FROM {temperature} t"
        " WHERE t.value > :limit GROUP BY t.sensor_id"
        " UNION ALL SELECT p.sensor_id, count(*) FROM {pressure} p"
        " WHERE p.value > :limit GROUP BY p.sensor_id",
        limit=200.0,
    )
    return answer


@query
def latest_value(spark, sf):
    newest = measure.latest_value(fx.event_points(spark, sf), "electrode")
    return newest.select("time", "seq", F.round(F.log10("value"), 6).alias("log_value"))


@query
def newest_rows(spark, sf):
    return _shown(
        measure.newest_rows(_demo_points(spark, sf), 20).select(
            "time", "seq", "sensor_id", "value"
        ),
        value=6,
    )


@query
def latest_per_sensor(spark, sf):
    return _shown(measure.latest_per_sensor(_demo_points(spark, sf)), value=6)


@query
def downsample(spark, sf):
    return _shown(
        measure.downsample(_demo_points(spark, sf), "1 hour"),
        avg_value=4,
        min_value=6,
        max_value=6,
        last_value=6,
    )


@query
def downsample_scale(spark, sf):
    """The larger table by month of shipping."""
    valued = _calibrate(fx.scale_readings(spark, sf), fx.demo_calibrations(spark))
    return _shown(
        measure.downsample(valued, "30 days"),
        avg_value=4,
        min_value=6,
        max_value=6,
        last_value=6,
    )


@query
def downsample_rollup(spark, sf):
    """The same by hours, of parts that a stream of points added in no order of time."""
    folder = shared_folder(spark)
    points = cal.as_points(cal.drop_non_finite(_calibrate(
        fx.derive_stream(spark, sf, fx.READINGS_SQL), fx.demo_calibrations(spark)
    )))
    rollup.stream_rollup(points, f"{folder}/parts", f"{folder}/log").awaitTermination()
    return _shown(
        rollup.downsample_rollup(spark, f"{folder}/parts", "1 hour"),
        avg_value=4,
        min_value=6,
        max_value=6,
        last_value=6,
    )


@query
def sparkline(spark, sf):
    traces = measure.sparkline(
        _demo_points(spark, sf),
        F.lit("2024-01-01 00:00:00").cast("timestamp"),
        F.lit("2024-01-31 00:00:00").cast("timestamp"),
        "6 hours",
    )
    text = F.array_join(
        F.transform("trace", lambda v: F.round(v).cast("bigint").cast("string")), " "
    )
    return _shown(traces.withColumn("trace", text), last_value=6)


@query
def inventory(spark, sf):
    wavemeter = physical.physical_readings(
        fx.derive(spark, sf, fx.PHYSICAL_SQL).drop("sensor_id"),
        F.lit("mock-wavemeter"),
        F.lit("frequency"),
        F.lit("Hz"),
    ).withColumn("value", F.col("value") + F.lit(276.5613e12))
    points = measure.union_measurements(
        [fx.event_points(spark, sf), wavemeter.drop("input_volts", "calibration_id")]
    )
    listed = measure.inventory(points)
    listed = listed.withColumn("calibrated", F.col("calibration_id").isNotNull())
    return _rounded(_shown(listed.drop("calibration_id"), value=6), input_volts=6)


@query
def list_measurements(spark, sf):
    return store.list_measurements(fx.event_points(spark, sf))


@query
def xy_pairs(spark, sf):
    return _rounded(
        measure.xy_pairs(_demo_points(spark, sf), "broth", "jacket", "2 hours"), x=6, y=6
    )


@query
def latest_pair(spark, sf):
    pairs = measure.xy_pairs(_demo_points(spark, sf), "broth", "jacket", "2 hours")
    return _rounded(measure.latest_pair(pairs), now_x=6, now_y=6)


@query
def detuning(spark, sf):
    fx.load(spark, sf, "orders")
    tuned = spark.sql(
        "SELECT o_orderkey AS seq, 276.5613e12 + o_totalprice AS value FROM orders"
    )
    return _rounded(measure.detuning(tuned), detuning=1).drop("value")


@query
def calibration_layer(spark, sf):
    layer = measure.calibration_layer(fx.event_points(spark, sf), "head-space")
    return _rounded(layer, value=6, input_volts=6)


@query
def panel_units(spark, sf):
    points = fx.event_points(spark, sf)
    return points.groupBy("unit", panel_unit(F.col("unit")).alias("panel_unit")).agg(
        F.count("seq").alias("points")
    )


@query
def series_wide(spark, sf):
    wide = measure.series_wide(_demo_points(spark, sf), ["broth", "jacket", "stirrer"])
    named = wide.select(
        "time",
        F.col("broth").alias("inside"),
        F.col("jacket").alias("outside"),
        F.col("stirrer").alias("speed"),
    )
    return _rounded(named, inside=6, outside=6, speed=6)


@query
def last_write_wins(spark, sf):
    valued = _calibrate(
        fx.derive(spark, sf, fx.REWRITTEN_SQL), fx.demo_calibrations(spark)
    )
    points = measure.last_write_wins(cal.as_points(cal.drop_non_finite(valued)))
    return _shown(points.select("measurement", "time", "sensor_id", "value", "seq"), value=6)


@query
def data_gaps(spark, sf):
    return _rounded(measure.data_gaps(_demo_points(spark, sf), 7200.0), gap_s=3)


@query
def physical_readings(spark, sf):
    points = physical.physical_readings(
        fx.derive(spark, sf, fx.PHYSICAL_SQL),
        F.col("sensor_id"),
        F.lit("power"),
        F.col("unit"),
        tags={"rack": F.lit("r1")},
    )
    return points.select(
        "measurement", "time", "sensor_id", "unit", "value", "seq",
        F.col("tags")["rack"].alias("rack"),
    )


@query
def several_fields(spark, sf):
    fx.load(spark, sf, "lineitem")
    reads = spark.sql(
        "SELECT l_orderkey * 10 + l_linenumber AS seq, l_shipdate AS time,"
        " l_quantity AS t, l_extendedprice AS p FROM lineitem"
    )
    return physical.several_fields(reads, {"t": ("temperature", "K"), "p": ("pressure", "Pa")})


@query
def burst_average(spark, sf):
    samples = fx.derive(spark, sf, fx.SAMPLES_SQL)
    return _rounded(measure.burst_average(samples, window_us=1_800_000_000), raw_count=6)


# --- logs -------------------------------------------------------------------------


@query
def relabel(spark, sf):
    return logs.relabel(fx.log_records(spark, sf)).drop("line")


@query
def parse_logfmt(spark, sf):
    parsed = logs.parse_logfmt(logs.relabel(fx.log_records(spark, sf)))
    keys = ["level", "logger", "msg", "reason", "readings", "sensor_id", "skipped", "ts"]
    return parsed.select(
        "seq",
        F.size("fields").alias("pairs"),
        *[F.col("fields")[k].alias(f"f_{k}") for k in keys],
    )


@query
def labelled_lines(spark, sf):
    found = fx.demo_logs(spark, sf)
    return found.select("seq", "container", "unit", "level", "severity", "sensor_id")


@query
def log_volume(spark, sf):
    return loglines.log_volume(fx.demo_logs(spark, sf), "6 hours")


@query
def warning_count(spark, sf):
    return loglines.warning_count(fx.demo_logs(spark, sf))


@query
def error_count(spark, sf):
    return loglines.error_count(fx.demo_logs(spark, sf))


@query
def threshold_status(spark, sf):
    found = fx.demo_logs(spark, sf)
    warned = loglines.warning_count(found.filter(loglines.label_matches("container", "c[0-4]")))
    failed = loglines.error_count(found.filter(loglines.label_equals("container", "none")))
    return (
        loglines.threshold_status(warned, "warnings", loglines.WARNING_STEPS)
        .withColumnRenamed("warnings", "lines")
        .unionAll(
            loglines.threshold_status(failed, "errors", loglines.ERROR_STEPS).withColumnRenamed(
                "errors", "lines"
            )
        )
    )


@query
def warn_and_error_lines(spark, sf):
    return loglines.warn_and_error_lines(fx.demo_logs(spark, sf)).select("ts", "seq", "level", "line")


@query
def container_lines(spark, sf):
    found = fx.demo_logs(spark, sf).filter(loglines.label_matches("container", ".+"))
    return found.groupBy("container").agg(F.count("seq").alias("lines"))


@query
def skipped_by_sensor(spark, sf):
    return loglines.skipped_by_sensor(fx.demo_logs(spark, sf), "6 hours")


@query
def skipped_lines(spark, sf):
    found = fx.demo_logs(spark, sf).filter(loglines.field_number("skipped") > 0)
    return found.select("seq", "sensor_id")


@query
def label_values(spark, sf):
    return loglines.label_values(fx.demo_logs(spark, sf), "sensor_id")


@query
def module_levels(spark, sf):
    found = fx.demo_logs(spark, sf).withColumn("logger", F.col("fields")["logger"])
    kept = loglines.module_level_filter(found, {"store": "error", "store.wal": "warning"})
    return kept.groupBy("logger", "severity").agg(F.count("seq").alias("lines"))


@query
def module_rules(spark, sf):
    """The same by a table of rules, one for each of many modules."""
    found = fx.demo_logs(spark, sf).withColumn("logger", F.col("fields")["logger"])
    fx.load(spark, sf, "part")
    many = spark.sql("SELECT concat('module.', p_partkey) AS prefix, 'error' AS level FROM part")
    named = literal_rows(
        spark,
        [{"prefix": "store", "level": "error"}, {"prefix": "store.wal", "level": "warning"}, {"prefix": "sto", "level": "debug"}],
        "prefix string, level string",
    )
    kept = loglines.module_rules_filter(found, many.unionByName(named))
    return kept.groupBy("logger", "severity").agg(F.count("seq").alias("lines"))


@query
def without_readings(spark, sf):
    """Lines at info and above: reading-level noise is debug."""
    kept = loglines.at_least(fx.demo_logs(spark, sf))
    return kept.groupBy("severity").agg(F.count("seq").alias("lines"))


@query
def retention(spark, sf):
    kept = loglines.apply_retention(
        fx.demo_logs(spark, sf), F.lit("2024-01-31 12:00:00").cast("timestamp"), 240
    )
    return kept.select("seq", "ts")


@query
def gap_context(spark, sf):
    """Warnings and errors about a sensor while its series was silent."""
    named = fx.event_readings(spark, sf).withColumn(
        "sensor_id", F.concat(F.lit("s"), F.substring("channel", 3, 1))
    )
    gaps = measure.data_gaps(named, 7200.0)
    about = fx.demo_logs(spark, sf).filter(loglines.warnings() | loglines.errors())
    found = loglines.gap_context(gaps, about.select("sensor_id", "ts", "seq", "level"))
    return found.select("sensor_id", "gap_start", "seq", "level")


@query
def logfmt_tokens(spark, sf):
    """Whole texts as log values: quoted, escaped, and read back unchanged."""
    fx.load(spark, sf, "documents")
    token = logfmt_token(F.col("text"))
    docs = spark.table("documents").select("doc_id", "text", token.alias("token"))
    line = F.concat(F.lit("level=info msg="), "token")
    parsed = docs.withColumn("fields", logfmt_fields(line))
    return parsed.select(
        "doc_id",
        F.size("fields").alias("pairs"),
        (F.col("fields")["msg"] == F.col("text")).alias("same"),
        F.substring("token", 1, 1).eqNullSafe('"').alias("quoted"),
        F.col("token").contains("\n").alias("broken"),
    )


# --- streams: the same answers over micro-batches ---------------------------------


def _stream_lines(spark, sf, ordered: bool = False) -> DataFrame:
    return fx.derive_stream(spark, sf, fx.LINES_SQL, ordered=ordered)


def _stream_valued(spark, sf, *carry: str, ordered: bool = False) -> DataFrame:
    calibrations = fx.demo_calibrations(spark)
    return stream.stream_calibrate(
        _stream_lines(spark, sf, ordered),
        cal.conversions(calibrations),
        cal.formula_texts(calibrations),
        carry=list(carry),
    )


@query
def calibrated_points_stream(spark, sf):
    """Lines through a streaming sink into the store, and back."""
    folder = shared_folder(spark)
    valued = _stream_valued(spark, sf, *cal.LABELS)
    points = cal.as_points(cal.drop_non_finite(valued))
    stream.stream_points_sink(points, f"{folder}/points", f"{folder}/log").awaitTermination()
    stored = store.scan_points(spark, f"{folder}/points").drop("tags", "calibration_id", "date")
    return _rounded(_shown(stored, value=6), input_volts=6)


@query
def recording_gate_stream(spark, sf):
    """A gate judges readings as they arrive, so its batches follow the time."""
    folder = shared_folder(spark)
    valued = _stream_valued(spark, sf, "gate", ordered=True)
    stream.stream_gate(valued, f"{folder}/gated", f"{folder}/log").awaitTermination()
    gated = spark.read.parquet(f"{folder}/gated")
    return gated.select("channel", "seq", "was_recording", "admitted")


@query
def sensor_summary_stream(spark, sf):
    """Readings written and skipped per sensor and window, after the gate."""
    folder = shared_folder(spark)
    calibrations = fx.demo_calibrations(spark)
    conv = cal.conversions(calibrations)
    stream.stream_summary(
        _stream_lines(spark, sf, ordered=True),
        conv,
        cal.formula_texts(calibrations),
        f"{folder}/counts",
        f"{folder}/log",
        SUMMARY,
    ).awaitTermination()
    return stream.current_summary(spark, f"{folder}/counts", conv, SUMMARY)


@query
def recording_gate_late_stream(spark, sf):
    """Batches in no order of time: verdicts are repaired as earlier readings come in."""
    folder = shared_folder(spark)
    valued = _stream_valued(spark, sf, "gate")
    stream.stream_gate_late(valued, f"{folder}/gated", f"{folder}/log").awaitTermination()
    gated = stream.current_gate(spark, f"{folder}/gated")
    return gated.select("channel", "seq", "was_recording", "admitted")


@query
def heartbeat_stream(spark, sf):
    """The summary of an outage: lines stop on the 20th while a clock ticks on."""
    folder = shared_folder(spark)
    calibrations = fx.demo_calibrations(spark)
    conv = cal.conversions(calibrations)
    stream.stream_summary(
        _stream_lines(spark, sf, ordered=True).filter("time < '2024-01-20'"),
        conv,
        cal.formula_texts(calibrations),
        f"{folder}/counts",
        f"{folder}/log",
        SUMMARY,
    ).awaitTermination()
    clock = _stream_lines(spark, sf).select("time")
    stream.stream_heartbeat(clock, conv, f"{folder}/beats", f"{folder}/clock", SUMMARY).awaitTermination()
    return stream.current_summary(spark, f"{folder}/counts", conv, SUMMARY, f"{folder}/beats")


@query
def uncalibrated_channels_stream(spark, sf):
    folder = shared_folder(spark)
    readings = wire.readings(wire.parse_wire(_stream_lines(spark, sf, ordered=True)))
    strangers = cal.uncalibrated_readings(readings, fx.demo_calibrations(spark))
    stream.stream_warn_once(strangers, f"{folder}/warned", f"{folder}/log").awaitTermination()
    return stream.latest_version(spark, f"{folder}/warned")


def _stream_logs(spark, sf) -> DataFrame:
    return logs.labelled_logs(fx.derive_stream(spark, sf, fx.LOGS_SQL, time="ts"))


@query
def log_volume_stream(spark, sf):
    folder, keys = shared_folder(spark), ["step", "level"]
    stream.stream_counts(
        _stream_logs(spark, sf),
        lambda rows: loglines.log_volume(rows, SUMMARY),
        keys,
        f"{folder}/counts",
        f"{folder}/log",
    ).awaitTermination()
    return stream.current_counts(spark, f"{folder}/counts", keys)


@query
def skipped_by_sensor_stream(spark, sf):
    folder, keys = shared_folder(spark), ["step", "sensor_id"]
    stream.stream_counts(
        _stream_logs(spark, sf),
        lambda rows: loglines.skipped_by_sensor(rows, SUMMARY),
        keys,
        f"{folder}/counts",
        f"{folder}/log",
    ).awaitTermination()
    return stream.current_counts(spark, f"{folder}/counts", keys)
