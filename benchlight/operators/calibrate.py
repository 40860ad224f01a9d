"""Counts to volts to physical values, by a table of calibrations.

A calibration row is resolved once into a conversion: its unit, its id, and what
turns a voltage into a value - polynomial segments, or a formula. Readings then
meet the conversions in one equi-join on the channel, with the revision's time
interval and the segment's voltage interval as residual conditions. Each reading
satisfies them for exactly one segment, so rows do not multiply. A channel with many
revisions is a tree of intervals over its history: readings go down it level by level, a
join each, and compare themselves with at most ``FANOUT`` intervals on each.

No broadcast hint is given: Spark broadcasts the conversions while their size is
under its threshold and shuffles, splitting hot channels, above it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from benchlight.functions import units
from benchlight.functions.formulas import apply_shapes, numbers_of, shape_of
from benchlight.functions.staged import staged
from benchlight.functions.text import quantity_text
from benchlight.operators.ordered import key_seq, key_time, last_key, ranked
from benchlight.schema import (
    ADC_BITS,
    ADC_VREF,
    CALIBRATION_ID_LENGTH,
)
from benchlight.session import settle
from benchlight.sources.physical import is_finite

# Revisions under one node of the tree of a channel's history.
FANOUT = 16

BOUNDS = ("below", "above", "resume_above", "resume_below")


def raw_to_voltage(count: Column, bits: int = ADC_BITS, vref: float = ADC_VREF) -> Column:
    """The voltage a count stands for; the highest count is the reference voltage."""
    return (count / F.lit(float((1 << bits) - 1))) * F.lit(vref)


# --- conversions --------------------------------------------------------------


def resolve(calibrations: DataFrame) -> DataFrame:
    """Every calibration row with its mode, units and ascending points resolved.

    Columns added: ``n_factor`` and ``n_offset`` (in the result's unit), ``unit``
    with ``unit_scale`` and ``unit_dims``, ``n_points``, and the looked-up units
    the checks need. Nothing is dropped, so bad rows can still be reported.
    """
    spellings = {
        "num": "get(split(factor_unit, '/'), 0)",
        "den": "get(split(factor_unit, '/'), 1)",
        "offset": "offset_unit",
        "value": "value_unit",
        **{name: f"gate.{name}_unit" for name in BOUNDS},
        "dwell": "coalesce(gate.dwell_unit, 's')",
    }
    rows = staged(
        calibrations,
        {
            "mode": "coalesce(mode, 'linear')",
            "_units": units.lookup(spellings),
            # By rising voltage; a falling series is turned around.
            "n_points": "CASE WHEN get(points, 0).volts > try_element_at(points, -1).volts"
            " THEN reverse(points) ELSE points END",
        },
    )
    rows = rows.select(
        "*", *[F.expr(f"_units[{i}]").alias(f"u_{name}") for i, name in enumerate(spellings)]
    ).drop("_units")
    volt = units.dims_sql(units.VOLT_DIMS)
    # A factor per volt (or millivolt) leaves its numerator; any other denominator
    # stays in the unit, beside the volts.
    per_volt = f"(u_den.dims = {volt})"
    scale = f"IF({per_volt}, u_num.scale, u_num.scale / u_den.scale)"
    factor_dims = "zip_with(u_num.dims, u_den.dims, (a, b) -> a - b)"
    product = f"zip_with({factor_dims}, {volt}, (a, b) -> a + b)"
    above = "IF(u_num.symbol = '', 'V', concat(u_num.symbol, ' * V'))"
    symbol = f"""CASE WHEN {per_volt} THEN u_num.symbol
        WHEN u_den.symbol = '' THEN {above} ELSE concat({above}, ' / ', u_den.symbol) END"""
    scaled = "mode IN ('linear', 'affine')"
    return staged(
        rows,
        {
            "unit": f"nullif(IF({scaled}, {symbol}, u_value.symbol), '')",
            "unit_scale": f"IF({scaled}, {scale}, u_value.scale)",
            "unit_dims": f"IF({scaled}, {product}, u_value.dims)",
            "n_factor": f"IF({scaled}, IF({per_volt}, factor / u_den.scale, factor), NULL)",
            "n_offset": f"IF(mode = 'affine', offset * (u_offset.scale / ({scale})), NULL)",
            "factor_base": "factor * u_num.scale / u_den.scale",
            "factor_dims": factor_dims,
            "offset_fits": f"u_offset.dims = {product}",
            "offset_unit_used": "u_num.offset_unit OR u_den.offset_unit"
            " OR (mode = 'affine' AND u_offset.offset_unit)",
        },
    )


def fingerprint() -> str:
    """Canonical text of a resolved conversion: magnitudes in base units, 12 digits.

    Spelling, gate and provenance are not part of it; the mode is. NULL for a row that
    lacks what its mode needs, or whose mode is unknown.
    """

    def quantity(magnitude: str, dims: str) -> str:
        text = f"array_join(CAST({dims} AS ARRAY<STRING>), ',')"
        return f"IF({magnitude} IS NULL, NULL, concat(format_string('%.11e', {magnitude}), ' ', {text}))"

    factor = quantity("factor_base", "factor_dims")
    offset = quantity("offset * u_offset.scale", "u_offset.dims")
    value_unit = quantity("u_value.scale", "u_value.dims")
    points = (
        "array_join(transform(n_points, p ->"
        " format_string('%.11e:%.11e', p.volts, p.value)), ',')"
    )
    return f"""CASE
        WHEN mode = 'linear' THEN concat(mode, '|', {factor})
        WHEN mode = 'affine' THEN concat(mode, '|', {factor}, '|', {offset})
        WHEN mode = 'expression' THEN concat(mode, '|', {value_unit}, '|', formula)
        WHEN mode IN ('spline', 'piecewise_linear') THEN concat(mode, '|', {value_unit}, '|', {points}) END"""


def calibration_id() -> str:
    """Short hash of the fingerprint: equal conversions share it."""
    return f"substring({whole_id()}, 1, {CALIBRATION_ID_LENGTH})"


def whole_id() -> str:
    """The hash the short one is the beginning of, for comparing conversions."""
    return f"sha2({fingerprint()}, 256)"


def conversions(calibrations: DataFrame, store_input: bool = True) -> DataFrame:
    """One row per channel revision, ready to meet readings.

    ``store_input`` holds for the rows of the table that don't say it themselves.

    A revision is in force from ``effective_from`` (NULL: always was) until before
    ``effective_to`` (NULL: still is). Of rows for one channel and time the highest
    revision stands, and of those one; the others are never in force, so a reading
    meets one conversion at most. ``conversion`` numbers the rows, as revisions may
    repeat, and ``place`` those of a channel in order of time. A conversion that can't be applied (too few points, an unknown mode, no
    factor) has one segment without a value: its readings count as skipped. Written
    once, as every reading of every pass meets it.
    """
    in_order = Window.partitionBy("channel").orderBy(F.col("effective_from").asc_nulls_first())
    rivals = Window.partitionBy("channel", "effective_from").orderBy(
        F.col("revision").desc_nulls_last(), "sensor_id", "measurement", "calibration_id"
    )
    ready = staged(
        fit_segments(resolve(calibrations)),
        {
            "calibration_id": calibration_id(),
            "whole_id": whole_id(),
            "segments": f"coalesce(segments, array({_nowhere()}))",
            "gate": _gate_rule(),
            "store_input": f"coalesce(store_input, {str(store_input).lower()})",
            "formula": "IF(mode = 'expression', formula, NULL)",
        },
    )
    standing = ready.withColumn("_place", F.row_number().over(rivals)).filter("_place = 1")
    placed = standing.withColumns(
        {
            "effective_to": F.lead("effective_from").over(in_order),
            "place": F.row_number().over(in_order) - 1,
        }
    )
    return settle(
        placed.select(
            F.monotonically_increasing_id().alias("conversion"),
            "place",
            *["channel", "revision", "effective_from", "effective_to", "sensor_id"],
            *["measurement", "mode", "unit", "calibration_id", "whole_id", "store_input"],
            *["provenance", "formula", "gate", "segments"],
        )
    )


def fit_segments(resolved: DataFrame) -> DataFrame:
    """Adds ``segments`` to resolved calibrations, fitting the splines among them."""

    def to_fit(part: str) -> Column:
        return F.expr(f"IF(mode = 'spline', transform(n_points, p -> p.{part}), NULL)")

    slopes = spline_slopes(to_fit("volts"), to_fit("value"))
    return staged(
        resolved.withColumn("_slopes", slopes), {"segments": _segments()}
    ).drop("_slopes")


def _gate_rule() -> str:
    """The gate with its bounds in the unit they are compared in.

    Each bound keeps the text it was written as, for the transition report.
    """
    on_volts = "coalesce(gate.raw_voltage, false)"
    subject_scale = f"IF({on_volts}, 1D, unit_scale)"
    fields = []
    for name in BOUNDS:
        text = quantity_text(f"gate.{name}", f"coalesce(u_{name}.symbol, '')")
        fields += [
            f"'{name}', gate.{name} * (u_{name}.scale / {subject_scale})",
            f"'{name}_text', IF(gate.{name} IS NULL, NULL, {text})",
        ]
    return f"""CASE WHEN gate.below IS NOT NULL OR gate.above IS NOT NULL
        THEN named_struct({", ".join(fields)},
            'dwell_s', coalesce(gate.dwell * u_dwell.scale, 0D),
            'raw_voltage', {on_volts}, 'unit', IF({on_volts}, 'V', unit)) END"""


# --- segments -----------------------------------------------------------------


@F.pandas_udf(ArrayType(DoubleType()))
def spline_slopes(volts: pd.Series, values: pd.Series) -> pd.Series:
    """Slopes at the points of the interpolating cubic spline of each series.

    The spline takes its end condition from the points themselves: the third
    derivative is continuous at the second and the last but one. Two points give
    a line, three a parabola. A series that is not strictly rising gives NULL.
    """

    def slopes(x, y):
        if x is None or y is None or len(x) < 2:
            return None
        x, y = np.asarray(x, float), np.asarray(y, float)
        if not np.all(np.diff(x) > 0):
            return None
        h, n = np.diff(x), len(x)
        chord = np.diff(y) / h
        if n == 2:
            return np.repeat(chord, 2)
        if n == 3:
            bend = (chord[1] - chord[0]) / (x[2] - x[0])
            return np.array(
                [chord[0] - bend * h[0], chord[0] + bend * h[0], chord[1] + bend * h[1]]
            )
        system, right = np.zeros((n, n)), np.zeros(n)
        for i in range(1, n - 1):
            system[i, i - 1 : i + 2] = h[i], 2 * (h[i - 1] + h[i]), h[i - 1]
            right[i] = 3 * (h[i] * chord[i - 1] + h[i - 1] * chord[i])
        # Equal leading coefficients (s_i + s_i+1 - 2 chord_i) / h_i^2 on both sides
        # of the knot next to each end.
        for row, i in ((0, 0), (n - 1, n - 3)):
            left, next_ = h[i] ** -2, h[i + 1] ** -2
            system[row, i : i + 3] = left, left - next_, -next_
            right[row] = 2 * (chord[i] * left - chord[i + 1] * next_)
        return np.linalg.solve(system, right)

    return pd.Series([slopes(x, y) for x, y in zip(volts, values)])


def _segment(v_lo, v_hi, v0="0D", c0="0D", c1="0D", c2="0D", c3="0D") -> str:
    terms = zip(("v_lo", "v_hi", "v0", "c0", "c1", "c2", "c3"), (v_lo, v_hi, v0, c0, c1, c2, c3))
    return "named_struct(" + ", ".join(f"'{n}', CAST({t} AS DOUBLE)" for n, t in terms) + ")"


def _nowhere() -> str:
    """The segment of a conversion that has no value at any voltage."""
    return _segment("double('-inf')", "double('inf')", c0="NULL")


def _segments() -> str:
    """What turns volts into a value, as polynomials over voltage intervals.

    A formula keeps one segment for the whole axis; its value replaces the
    polynomial's.
    """
    segment = _segment
    low, high = "double('-inf')", "double('inf')"
    first, last = "get(n_points, 0)", "try_element_at(n_points, -1)"
    # Index of each interval's lower point, and what belongs to interval i.
    knots = "sequence(0, size(n_points) - 2)"
    a, b = "get(n_points, i)", "get(n_points, i + 1)"
    h = f"({b}.volts - {a}.volts)"
    chord = f"try_divide({b}.value - {a}.value, {h})"
    s, t = "get(_slopes, i)", "get(_slopes, i + 1)"
    straight = segment(f"{a}.volts", f"{b}.volts", f"{a}.volts", f"{a}.value", chord)
    cubic = segment(
        f"IF(i = 0, {low}, {a}.volts)",
        f"IF(i = size(n_points) - 2, {high}, {b}.volts)",
        f"{a}.volts",
        f"{a}.value",
        s,
        f"try_divide(3 * {chord} - 2 * {s} - {t}, {h})",
        f"try_divide({s} + {t} - 2 * {chord}, {h} * {h})",
    )
    enough = "size(n_points) >= 2"
    return f"""CASE
        WHEN mode = 'linear' THEN array({segment(low, high, c1="n_factor")})
        WHEN mode = 'affine' THEN array({segment(low, high, c0="n_offset", c1="n_factor")})
        WHEN mode = 'expression' THEN array({segment(low, high, c0="NULL")})
        WHEN mode = 'piecewise_linear' AND {enough} THEN concat(
            array({segment(low, f"{first}.volts", c0=f"{first}.value")}),
            transform({knots}, i -> {straight}),
            array({segment(f"{last}.volts", high, c0=f"{last}.value")}))
        WHEN mode = 'spline' AND {enough} AND _slopes IS NOT NULL
            THEN transform({knots}, i -> {cubic}) END"""


# --- readings meet conversions --------------------------------------------------


def formula_texts(calibrations: DataFrame) -> list[str]:
    """The distinct shapes of a table's formulas, their numbers left out.

    As many as there are kinds of response, not as there are channels.
    """
    rows = (
        calibrations.filter((F.col("mode") == "expression") & F.col("formula").isNotNull())
        .select(shape_of(F.col("formula")))
        .distinct()
        .collect()
    )
    return [row[0] for row in rows]


def _in_force() -> Column:
    began = F.col("_from").isNull() | (F.col("time") >= F.col("_from"))
    return began & (F.col("_to").isNull() | (F.col("time") < F.col("_to")))


def _located(df: DataFrame, conv: DataFrame, channel: str = "channel", how: str = "inner") -> DataFrame:
    """Adds ``_node``: the group of ``FANOUT`` revisions of its channel that a row's time falls into.

    Groups of groups are gone through from the top, so a row meets ``FANOUT`` of them at
    each level. Where no channel has more revisions than that, there is one group and no join.
    """
    most = conv.agg(F.max("place")).first()[0] or 0
    levels = 0
    while most >= FANOUT ** (levels + 1):
        levels += 1
    located = df.withColumn("_node", F.lit(0).cast("bigint"))
    for level in range(levels, 0, -1):
        size = FANOUT**level
        nodes = conv.groupBy(
            F.col("channel").alias("_channel_of"),
            F.floor(F.col("place") / (size * FANOUT)).alias("_parent"),
            F.floor(F.col("place") / size).alias("_child"),
        ).agg(
            # NULL is before all, and after all.
            F.min_by("effective_from", "place").alias("_from"),
            F.max_by("effective_to", "place").alias("_to"),
        )
        inside = (F.col(channel) == F.col("_channel_of")) & (F.col("_node") == F.col("_parent")) & _in_force()
        located = located.join(nodes, inside, how).select(*df.columns, F.col("_child").alias("_node"))
    return located


def _evaluate(
    df: DataFrame,
    conv: DataFrame,
    on: list[str],
    carry: list[str],
    formulas: list[str],
    volts: str = "input_volts",
    output: str = "value",
    how: str = "inner",
) -> DataFrame:
    """Join rows holding a voltage to the segment of their conversion, and apply it."""
    pieces = conv.select(
        *[F.col(c).alias(f"_on_{c}") for c in on],
        *[F.col(c).alias(f"_c_{c}") for c in carry],
        F.col("effective_from").alias("_from"),
        F.col("effective_to").alias("_to"),
        F.floor(F.col("place") / FANOUT).alias("_group"),
        shape_of(F.col("formula")).alias("_shape"),
        numbers_of(F.col("formula")).alias("_numbers"),
        F.inline("segments"),
    )
    match = (F.col(volts) >= F.col("v_lo")) & (F.col(volts) < F.col("v_hi"))
    match = match & _in_force() & (F.col("_node") == F.col("_group"))
    for c in on:
        match = match & (F.col(c) == F.col(f"_on_{c}"))
    d = F.col(volts) - F.col("v0")
    value = F.col("c0") + d * (F.col("c1") + d * (F.col("c2") + d * F.col("c3")))
    if formulas:
        value = F.when(
            F.col("_shape").isNotNull(),
            apply_shapes(F.col("_shape"), F.col("_numbers"), F.col(volts), formulas),
        ).otherwise(value)
    return _located(df, conv, how=how).join(pieces, match, how).select(
        *df.columns, *[F.col(f"_c_{c}").alias(c) for c in carry], value.alias(output)
    )


LABELS = ["sensor_id", "measurement", "unit", "calibration_id", "store_input"]


def calibrate(
    readings: DataFrame,
    conv: DataFrame,
    formulas: list[str],
    bits: int = ADC_BITS,
    vref: float = ADC_VREF,
    carry: list[str] | None = None,
) -> DataFrame:
    """Readings of calibrated channels with ``input_volts`` and ``value``.

    ``conv`` and ``formulas`` come from :func:`conversions` and :func:`formula_texts`.
    ``finite`` is false where the value is NULL, NaN or infinite: such a reading
    counts as skipped and goes no further. Readings without a conversion in force have
    no rows; ``uncalibrated_readings`` has them.
    ``carry`` names the conversion columns to attach.
    """
    volts = readings.withColumn("input_volts", raw_to_voltage(F.col("raw_count"), bits, vref))
    columns = ["conversion", "revision", *LABELS] if carry is None else carry
    valued = _evaluate(volts.drop("raw_count"), conv, ["channel"], columns, formulas)
    return valued.withColumn("finite", is_finite(F.col("value")))


def drop_non_finite(valued: DataFrame) -> DataFrame:
    """The readings that can be written, and that a gate may look at."""
    return valued.filter("finite").drop("finite")


def first_non_finite(valued: DataFrame) -> DataFrame:
    """Per sensor, the first refused reading and how many there were."""
    first = last_key()
    return (
        valued.filter(~F.col("finite"))
        .groupBy("sensor_id")
        .agg(
            F.count(F.lit(1)).alias("skipped"),
            *[F.min_by(c, first).alias(c) for c in ("time", "seq", "input_volts", "value")],
        )
    )


def as_points(valued: DataFrame) -> DataFrame:
    """Points in their stored shape; the input voltage stays unless opted out."""
    return valued.select(
        "measurement",
        F.date_trunc("millisecond", "time").alias("time"),
        "sensor_id",
        "unit",
        "calibration_id",
        "value",
        F.when(F.col("store_input"), F.col("input_volts")).alias("input_volts"),
        F.create_map().cast("map<string,string>").alias("tags"),
        "seq",
    )


def uncalibrated_readings(readings: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Readings no conversion is in force for: of unknown channels, and too early ones.

    A channel's first revision is followed without a gap, so its beginning decides.
    """
    starts = calibrations.groupBy(F.col("channel").alias("_channel")).agg(
        F.min("effective_from").alias("_from"), F.bool_or(F.col("effective_from").isNull()).alias("_always")
    )
    covered = (F.col("channel") == F.col("_channel")) & (
        F.col("_always") | (F.col("time") >= F.col("_from"))
    )
    return readings.join(starts, covered, "left_anti")


def uncalibrated_channels(
    readings: DataFrame, calibrations: DataFrame, named: int | None = None
) -> DataFrame:
    """Channels with readings no calibration is in force for, once each.

    ``place`` counts them in the order first seen; ``named`` limits the list. The first
    reading's key is combined by hash, so only one row per channel is ordered, by ranges:
    names come off the wire, so there may be any number of them.
    """
    strangers = (
        uncalibrated_readings(readings, calibrations)
        .groupBy("channel")
        .agg(F.min(last_key()).alias("_first"), F.count(F.lit(1)).alias("readings"))
    )
    listed = strangers.select(
        "channel",
        key_time("_first").alias("first_time"),
        key_seq("_first").alias("first_seq"),
        "readings",
    )
    listed = ranked(listed, ["first_time", "first_seq", "channel"])
    return listed if named is None else listed.filter(F.col("place") <= named)


# --- stored points and calibrations ---------------------------------------------


def _origins(conv: DataFrame) -> DataFrame:
    """Per sensor, measurement and calibration id the one channel that wrote such points.

    ``channels`` counts the candidates; where it is not one, which channel a point came
    from can't be told.
    """
    return conv.groupBy("sensor_id", "measurement", "calibration_id").agg(
        F.min("channel").alias("_channel"), F.count_distinct("channel").alias("_channels")
    )


def _with_channel(points: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Each point with the channel it came from: ``_channel``, and ``ambiguous``.

    The id a point was written under leads to its channel. An id that no conversion has
    (they were replaced in place) leaves the sensor: its only channel, if it has one.
    """
    named = _origins(before)
    only = after.unionByName(before).groupBy("sensor_id", "measurement").agg(
        F.min("channel").alias("_only"), F.count_distinct("channel").alias("_of")
    )
    found = points.join(named, ["sensor_id", "measurement", "calibration_id"], "left").join(
        only, ["sensor_id", "measurement"], "left"
    )
    channel = F.when(F.col("_channels") == 1, F.col("_channel")).when(F.col("_of") == 1, F.col("_only"))
    unclear = channel.isNull() & (F.coalesce("_channels", "_of") > 1)
    kept = [F.col(c) for c in points.columns]
    return found.select(
        *kept, channel.alias("_channel"), F.coalesce(unclear, F.lit(False)).alias("ambiguous")
    )


def recalibrate(
    points: DataFrame,
    calibrations: DataFrame,
    old_id: str | None = None,
    volts_scale: float = 1.0,
    written_under: DataFrame | None = None,
) -> DataFrame:
    """Recompute stored values from their input under new calibrations: one row each.

    A point finds its channel by the id it was written under, looked up in
    ``written_under``, the calibrations of that time (the new ones by default), or else
    by its sensor, and the channel its new conversion. Where two channels are possible
    the point is ``ambiguous`` and keeps its value. With ``old_id`` only the points
    written under that id change. Points without an input, or without a new calibration,
    keep their value and have ``correctable`` false. ``volts_scale`` corrects a wrong
    reference voltage or resolution, which act linearly.
    """
    conv = conversions(calibrations)
    before = conv if written_under is None else conversions(written_under)
    due = F.lit(True) if old_id is None else F.col("calibration_id") == F.lit(old_id)
    scaled = _with_channel(points, before, conv).withColumn(
        "_volts", F.when(due, F.col("input_volts") * F.lit(volts_scale))
    )
    joined = _evaluate(
        scaled.withColumnsRenamed(
            {"unit": "_old_unit", "calibration_id": "_old_id", "value": "_old_value"}
        ).withColumnRenamed("_channel", "channel"),
        conv,
        ["channel", "sensor_id", "measurement"],
        ["unit", "calibration_id"],
        formula_texts(calibrations),
        volts="_volts",
        output="_new_value",
        how="left",
    )
    correctable = is_finite(F.col("_new_value"))
    return joined.select(
        *[
            c
            for c in points.columns
            if c not in ("unit", "calibration_id", "value", "input_volts")
        ],
        F.when(correctable, F.col("unit")).otherwise(F.col("_old_unit")).alias("unit"),
        F.when(correctable, F.col("calibration_id"))
        .otherwise(F.col("_old_id"))
        .alias("calibration_id"),
        F.when(correctable, F.col("_new_value")).otherwise(F.col("_old_value")).alias("value"),
        F.coalesce("_volts", "input_volts").alias("input_volts"),
        F.col("_old_value").alias("old_value"),
        F.col("_old_id").alias("old_id"),
        correctable.alias("correctable"),
        "ambiguous",
    )


def calibration_in_force(points: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Each point once, with the revision in force at its time, and whether it used it.

    A point finds its channel as in :func:`recalibrate`.
    """
    found = conversions(calibrations)
    conv = found.select(
        F.col("channel").alias("_on"),
        F.col("sensor_id").alias("_sensor"),
        F.col("measurement").alias("_measurement"),
        F.col("effective_from").alias("_from"),
        F.col("effective_to").alias("_to"),
        F.col("revision").alias("revision_in_force"),
        F.col("calibration_id").alias("id_in_force"),
        F.floor(F.col("place") / FANOUT).alias("_group"),
    )
    match = (
        (F.col("_channel") == F.col("_on"))
        & (F.col("_node") == F.col("_group"))
        & (F.col("sensor_id") == F.col("_sensor"))
        & (F.col("measurement") == F.col("_measurement"))
        & _in_force()
    )
    return (
        _located(_with_channel(points, found, found), found, "_channel", "left")
        .join(conv, match, "left")
        .withColumn("current", F.col("calibration_id").eqNullSafe(F.col("id_in_force")))
        .drop("_channel", "_node", "_group", "_on", "_sensor", "_measurement", "_from", "_to")
    )


def calibration_usage(points: DataFrame) -> DataFrame:
    """Per sensor and calibration id: first and last time, and readings."""
    return points.groupBy("sensor_id", "calibration_id").agg(
        F.min("time").alias("first_time"),
        F.max("time").alias("last_time"),
        F.count(F.lit(1)).alias("readings"),
    )


def calibrations_report(calibrations: DataFrame) -> DataFrame:
    """What a run starts with: channel, sensor, id and provenance as text."""

    def item(entry: Column) -> Column:
        value = entry["value"]
        mark = F.when(value.contains("'") & ~value.contains('"'), '"').otherwise("'")
        return F.concat(entry["key"], F.lit("="), mark, value, mark)

    details = F.array_join(F.transform(F.map_entries("provenance"), item), ", ")
    return (
        resolve(calibrations)
        .select(
            "channel",
            "revision",
            "sensor_id",
            F.expr(calibration_id()).alias("calibration_id"),
            F.coalesce(F.nullif(details, F.lit("")), F.lit("-")).alias("provenance"),
        )
        .orderBy("channel", "revision")
    )
