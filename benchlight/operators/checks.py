"""Checks over a calibration table: one row per violation, in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchlight.functions import units
from benchlight.functions.formulas import apply_shapes, numbers_of, shape_error, shape_of
from benchlight.operators.calibrate import BOUNDS, fit_segments, formula_texts, resolve
from benchlight.schema import MODES, PROBE_VOLTS

# --- fixed values -----------------------------------------------------------
REQUIRED = {
    "linear": ("factor",),
    "affine": ("factor", "offset"),
    "spline": ("points", "value_unit"),
    "piecewise_linear": ("points", "value_unit"),
    "expression": ("formula", "value_unit"),
}
BAND_ORDER = "below <= resume_above < resume_below <= above"


def validate_calibrations(calibrations: DataFrame) -> DataFrame:
    """Rows ``(channel, revision, rule, detail)``, one per violated rule and detail.

    Rules: V1 required columns, V2 mode, V3 measured points, V4 units, V5 usable at
    some probe voltage, V6 gate bounds present, V7 their order, V8 their units,
    V9 one row per channel and effective time.
    """
    shapes = formula_texts(calibrations)
    rows = fit_segments(resolve(calibrations))
    checks = (
        _required()
        + [_mode()]
        + _points()
        + _units()
        + [_usable(shapes)]
        + _gate_keys()
        + _gate_order()
        + _gate_units()
    )
    found = rows.select(
        "channel",
        "revision",
        F.explode(F.filter(F.array(*checks), lambda v: v.isNotNull())).alias("v"),
    ).select("channel", "revision", "v.rule", "v.detail")
    return found.unionByName(_repeated(calibrations))


def _violation(broken: Column, rule: str, detail: Column | str) -> Column:
    text = detail if isinstance(detail, Column) else F.lit(detail)
    return F.when(broken, F.struct(F.lit(rule).alias("rule"), text.alias("detail")))


def _required() -> list[Column]:
    found = [
        _violation(F.nullif(key, F.lit("")).isNull(), "V1", f"is missing '{key}'")
        for key in ("sensor_id", "measurement")
    ]
    for key in ("factor", "offset", "points", "value_unit", "formula"):
        modes = [mode for mode, keys in REQUIRED.items() if key in keys]
        found.append(
            _violation(
                F.col("mode").isin(*modes) & F.col(key).isNull(), "V1", f"is missing '{key}'"
            )
        )
    return found


def _mode() -> Column:
    return _violation(
        ~F.col("mode").isin(*MODES), "V2", F.concat(F.lit("has unknown mode "), "mode")
    )


def _points() -> list[Column]:
    interpolated = F.col("mode").isin("spline", "piecewise_linear") & F.col("points").isNotNull()
    points, count = F.col("points"), F.size("points")
    unpaired = F.exists(points, lambda p: p["volts"].isNull() | p["value"].isNull())
    rises = F.transform(
        F.sequence(F.lit(0), F.greatest(count - 2, F.lit(0))),
        lambda i: F.get(points, i + 1)["volts"] - F.get(points, i)["volts"],
    )
    monotonic = F.forall(rises, lambda r: r > 0) | F.forall(rises, lambda r: r < 0)
    return [
        _violation(interpolated & unpaired, "V3", "voltages and values must pair up"),
        _violation(interpolated & (count < 2), "V3", "needs at least two measured points"),
        _violation(
            interpolated & (count >= 2) & ~unpaired & ~monotonic,
            "V3",
            "voltages must be strictly monotonic",
        ),
    ]


def _units() -> list[Column]:
    scaled, affine = F.col("mode").isin("linear", "affine"), F.col("mode") == "affine"
    declared = F.col("mode").isin("spline", "piecewise_linear", "expression")
    unknown_factor = F.col("u_num").isNull() | F.col("u_den").isNull()
    return [
        _violation(scaled & unknown_factor, "V4", "factor has an unknown unit"),
        _violation(affine & F.col("u_offset").isNull(), "V4", "offset has an unknown unit"),
        _violation(declared & F.col("u_value").isNull(), "V4", "value has an unknown unit"),
        _violation(
            scaled & F.coalesce("offset_unit_used", F.lit(False)), "V4", "uses an offset unit"
        ),
        _violation(
            affine & ~F.col("offset_fits"), "V4", "offset is not of the factor's dimension"
        ),
        # Scaling a reading onto an offset unit is just as ambiguous.
        _violation(
            declared & F.coalesce("u_value.offset_unit", F.lit(False)),
            "V4",
            "uses an offset unit",
        ),
    ]


def _usable(shapes: list[str]) -> Column:
    def at(volts: float) -> Column:
        v = F.lit(volts)
        piece = F.get(
            F.filter("segments", lambda s: (s["v_lo"] <= v) & (v < s["v_hi"])), F.lit(0)
        )
        d = v - piece["v0"]
        value = piece["c0"] + d * (piece["c1"] + d * (piece["c2"] + d * piece["c3"]))
        return F.when(
            F.col("mode") == "expression",
            apply_shapes(shape_of(F.col("formula")), numbers_of(F.col("formula")), v, shapes),
        ).otherwise(value)

    # Only where the parts are there; a missing part is V1's to report.
    complete = F.lit(False)
    for mode, keys in REQUIRED.items():
        present = F.col("mode") == mode
        for key in keys:
            present = present & F.col(key).isNotNull()
        complete = complete | present
    reason = F.lit("cannot be applied at any probe voltage")
    for shape in shapes:
        error = shape_error(shape)
        if error is not None:
            reason = F.when(shape_of(F.col("formula")) == shape, error).otherwise(reason)
    return _violation(
        complete & F.coalesce(*[at(v) for v in PROBE_VOLTS]).isNull(), "V5", reason
    )


def _gate_keys() -> list[Column]:
    gate = F.col("gate")
    return [
        _violation(
            gate.isNotNull() & gate["below"].isNull() & gate["above"].isNull(),
            "V6",
            "needs 'below' or 'above'",
        ),
        _violation(
            gate["resume_above"].isNotNull() & gate["below"].isNull(),
            "V6",
            "sets 'resume_above' without 'below'",
        ),
        _violation(
            gate["resume_below"].isNotNull() & gate["above"].isNull(),
            "V6",
            "sets 'resume_below' without 'above'",
        ),
    ]


def _bound(name: str) -> Column:
    """A bound in base units."""
    return F.col(f"gate.{name}") * F.col(f"u_{name}.scale")


def _gate_order() -> list[Column]:
    below, above = _bound("below"), _bound("above")
    resume_above, resume_below = _bound("resume_above"), _bound("resume_below")
    floor, ceiling = F.coalesce(resume_above, below), F.coalesce(resume_below, above)
    detail = f"the bounds must read {BAND_ORDER}"
    crossed = (
        F.coalesce(below > resume_above, F.lit(False))
        | F.coalesce(resume_below > above, F.lit(False))
        | F.coalesce(floor >= ceiling, F.lit(False))
    )
    return [_violation(crossed, "V7", detail)]


def _gate_units() -> list[Column]:
    wanted = F.when(
        F.coalesce("gate.raw_voltage", F.lit(False)), units.dims_lit(units.VOLT_DIMS)
    ).otherwise(F.col("unit_dims"))
    found = []
    for name in BOUNDS:
        unit = F.col(f"u_{name}")
        fits = F.coalesce((unit["dims"] == wanted) & ~unit["offset_unit"], F.lit(False))
        found.append(
            _violation(
                F.col(f"gate.{name}").isNotNull() & ~fits & wanted.isNotNull(),
                "V8",
                f"'{name}' cannot be compared with what is gated",
            )
        )
    is_time = F.coalesce(F.col("u_dwell.dims") == units.dims_lit(units.TIME_DIMS), F.lit(False))
    found.append(
        _violation(
            F.col("gate.dwell").isNotNull() & ~is_time,
            "V8",
            "dwell must be a duration; 'm' is metres, minutes are 'min'",
        )
    )
    return found


def _repeated(calibrations: DataFrame) -> DataFrame:
    """A channel's rows for one time, and its rows with one revision number."""

    def more_than_one(keys: list[str], what: str) -> DataFrame:
        repeats = calibrations.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), F.max("revision").alias("_revision")
        )
        return repeats.filter("n > 1").select(
            "channel",
            F.col("_revision").alias("revision"),
            F.lit("V9").alias("rule"),
            F.concat(F.lit("appears "), F.col("n").cast("string"), F.lit(f" times {what}")).alias("detail"),
        )

    return more_than_one(["channel", "effective_from"], "for one time").unionByName(
        more_than_one(["channel", "revision"], "as one revision")
    )
