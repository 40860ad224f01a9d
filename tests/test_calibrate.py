import bisect
import math
import random

import pytest
from helpers import at, one_channel, values_at
from pyspark.sql import functions as F

from benchlight.functions.formulas import FormulaError, formula_column, formula_error
from benchlight.operators import calibrate as cal
from benchlight.operators.checks import validate_calibrations
from benchlight.plans import chain
from benchlight.plans import fixtures as fx


@pytest.mark.parametrize(
    ("count", "bits", "vref", "volts"),
    [
        (0.0, 12, 3.3, 0.0),
        (4095.0, 12, 3.3, 3.3),
        (2048.0, 12, 3.3, 3.3 * 2048 / 4095),
        (1023.0, 10, 5.0, 5.0),
        (2048.31, 12, 3.3, 3.3 * 2048.31 / 4095),
    ],
)
def test_volts(spark, count, bits, vref, volts):
    row = spark.range(1).select(cal.raw_to_voltage(F.lit(count), bits, vref).alias("v")).first()
    assert row["v"] == pytest.approx(volts)


FALLING = fx.points((3.1, 268.15), (2.6, 280.15), (1.9, 294.15), (1.3, 309.15))
CURVES = [
    ({"factor": 17.25, "factor_unit": "K/V"}, {1.5: 25.875}, "K"),
    ({"factor": 17.25, "factor_unit": "kelvin / millivolt"}, {0.0015: 0.0015 * 17250}, "K"),
    (
        {"mode": "affine", "factor": 80.0, "factor_unit": "K/V", "offset": 250.0, "offset_unit": "K"},
        {0.5: 290.0},
        "K",
    ),
    ({"mode": "affine", "factor": 7.0, "offset": -11.0, "offset_unit": "V"}, {2.0: 3.0}, "V"),
    ({"mode": "affine", "factor": 7.0, "offset": -11000.0, "offset_unit": "mV"}, {2.0: 3.0}, "V"),
    ({"factor": 2.0, "factor_unit": "A"}, {1.0: 2.0}, "A * V"),
    (
        {"mode": "piecewise_linear", "value_unit": "K", "points": fx.points((0, 4), (1, 12), (2, 40))},
        {0.5: 8.0, 1.5: 26.0, 1.0: 12.0, 2.0: 40.0},
        "K",
    ),
    (
        {"mode": "piecewise_linear", "value_unit": "K", "points": fx.points((1, 10), (2, 20))},
        {0.0: 10.0, 3.0: 20.0},
        "K",
    ),
    (
        {"mode": "piecewise_linear", "value_unit": "K", "points": fx.points((2, 20), (1, 10))},
        {0.0: 10.0, 1.5: 15.0, 3.0: 20.0},
        "K",
    ),
    # A cubic spline through points of a parabola is the parabola, outside them too.
    (
        {"mode": "spline", "value_unit": "K", "points": fx.points((0, 0), (1, 1), (2, 4), (3, 9))},
        {1.5: 2.25, 2.5: 6.25, 3.2: 10.24},
        "K",
    ),
    (
        {"mode": "spline", "value_unit": "K", "points": fx.points((0, 0), (1, 1), (2, 4))},
        {1.5: 2.25, 3.0: 9.0},
        "K",
    ),
    (
        {"mode": "spline", "value_unit": "K", "points": fx.points((1, 1), (2, 3))},
        {0.0: -1.0, 1.5: 2.0, 3.0: 5.0},
        "K",
    ),
    ({"mode": "spline", "value_unit": "K", "points": FALLING}, {3.1: 268.15, 1.3: 309.15}, "K"),
    ({"mode": "expression", "value_unit": "mbar", "formula": "10**(3*v-8)"}, {1.0: 1e-5}, "mbar"),
    (
        {"mode": "expression", "value_unit": "K", "formula": "sqrt(v) if 0 < v < 2 else log(e)"},
        {1.44: 1.2, 3.0: 1.0},
        "K",
    ),
]


@pytest.mark.parametrize("i", range(len(CURVES)))
def test_curves(spark, i):
    row, expected, unit = CURVES[i]
    values, got_unit = values_at(spark, one_channel(spark, **row), list(expected))
    assert values == pytest.approx(list(expected.values()), rel=1e-9, abs=1e-9)
    assert got_unit == unit


def test_many_channels_keep_their_own_curve(spark):
    """A third of the readings on one channel, every reading meets one segment."""
    readings = spark.range(3000).select(
        F.col("id").alias("seq"),
        F.timestamp_seconds("id").alias("time"),
        F.when(F.col("id") % 3 == 0, "in0")
        .otherwise(F.concat(F.lit("in"), (F.col("id") % 7).cast("string")))
        .alias("channel"),
        (F.col("id") % 4096).cast("double").alias("raw_count"),
    )
    table = fx.demo_calibrations(spark)
    valued = cal.calibrate(readings, cal.conversions(table), cal.formula_texts(table))
    assert valued.count() == 3000
    assert valued.select("seq").distinct().count() == 3000


@pytest.mark.parametrize(
    ("formula", "part"),
    [
        ("import os", "not an expression"),
        ("w + 1", "'w' is not defined"),
        ("__import__('os')", "is not a number"),
        ("v > 1", "is not a number"),
        ("True", "is not a number"),
        ("'text'", "is not a number"),
        ("v.real", "is not a number"),
        ("[v]", "is not a number"),
    ],
)
def test_formulas_refused(spark, formula, part):
    assert part in formula_error(formula)
    with pytest.raises(FormulaError):
        formula_column(formula, F.lit(1.0))


@pytest.mark.parametrize(
    ("formula", "v", "expected"),
    [
        ("2**v", 3.0, 8.0),
        ("v // 2", 7.0, 3.0),
        ("-v % 3", 7.0, 2.0),
        ("max(v, 2, 5)", 3.0, 5.0),
        ("1 / v", 0.0, None),
        ("v ** -1", 0.0, None),
        ("log10(v)", 1000.0, 3.0),
        ("log(v - 2.0)", 2.0, -math.inf),
        ("arctan2(v, 1)", 1.0, math.pi / 4),
    ],
)
def test_formula_values(spark, formula, v, expected):
    row = spark.range(1).select(F.lit(v).alias("v")).select(formula_column(formula, F.col("v")).alias("y"))
    got = row.first()["y"]
    assert got is None if expected is None else got == pytest.approx(expected)


def test_one_bad_reading_fails_nothing(spark):
    table = one_channel(spark, mode="expression", value_unit="K", formula="log(v - 1.0)")
    values, _ = values_at(spark, table, [2.0, 0.5, 3.0])
    assert values[0] == pytest.approx(0.0) and math.isnan(values[1])


def _id(spark, **row):
    table = one_channel(spark, **row)
    return cal.conversions(table).first()["calibration_id"]


def test_ids(spark):
    base = {"factor": 42.5, "factor_unit": "kelvin / volt"}
    same = _id(spark, **base)
    assert len(same) == 8
    assert same == _id(spark, factor=42.5, factor_unit="K/V")
    assert same == _id(spark, **base, provenance={"operator": "x"})
    assert same == _id(spark, **base, gate={"below": 1.0, "below_unit": "K"})
    assert same == _id(spark, mode="linear", **base)
    assert same != _id(spark, factor=42.6, factor_unit="K/V")
    assert same != _id(spark, mode="affine", offset=0.0, offset_unit="K", **base)
    assert _id(spark, factor=1e-6, factor_unit="mbar/V") == _id(
        spark, factor=1e-4, factor_unit="Pa / volt"
    )
    points = {"points": fx.points((0, 0), (1, 1)), "value_unit": "K"}
    assert _id(spark, mode="spline", **points) != _id(spark, mode="piecewise_linear", **points)
    turned = {"points": fx.points((1, 1), (0, 0)), "value_unit": "K"}
    assert _id(spark, mode="spline", **points) == _id(spark, mode="spline", **turned)
    axes = [{"factor_unit": "µm/V", "offset_unit": "um"}, {"factor_unit": "micrometer / volt", "offset_unit": "micrometer"}]
    one, two = (_id(spark, mode="affine", factor=64.0, offset=-9.0, **spelled) for spelled in axes)
    assert one == two


def test_store_input(spark):
    table = one_channel(spark, factor=1.0, factor_unit="K/V", store_input=False)
    df = spark.createDataFrame(
        [(1, at(0), "A0", 5.0)], "seq bigint, time timestamp, channel string, raw_count double"
    )
    valued = cal.calibrate(df, cal.conversions(table), [])
    assert cal.as_points(cal.drop_non_finite(valued)).first()["input_volts"] is None


def test_revisions_apply_by_time(spark):
    later = {"revision": 2, "effective_from": at(10).replace(tzinfo=None)}
    first = {
        "channel": "A0", "revision": 1, "sensor_id": "s", "measurement": "m",
        "factor": 1.0, "factor_unit": "K/V",
    }
    table = fx.calibrations(spark, [first, first | later | {"factor": 2.0}])
    df = spark.createDataFrame(
        [(i, at(t), "A0", 4095.0) for i, t in enumerate([0, 9.999, 10, 11])],
        "seq bigint, time timestamp, channel string, raw_count double",
    )
    valued = cal.calibrate(df, cal.conversions(table), []).orderBy("seq").collect()
    assert [r["revision"] for r in valued] == [1, 1, 2, 2]
    assert [round(r["value"], 6) for r in valued] == [3.3, 3.3, 6.6, 6.6]


def test_points_without_input_are_not_correctable(spark):
    points = spark.createDataFrame(
        [("m", at(0), "s", "K", "old", 1.0, 2.0, {}, 1), ("m", at(1), "s", "K", "old", 1.0, None, {}, 2)],
        "measurement string, time timestamp, sensor_id string, unit string, calibration_id string,"
        "value double, input_volts double, tags map<string,string>, seq bigint",
    )
    table = one_channel(spark, factor=3.0, factor_unit="K/V")
    got = cal.recalibrate(points, table, volts_scale=0.5).orderBy("seq").collect()
    assert [(r["value"], r["correctable"]) for r in got] == [(3.0, True), (1.0, False)]
    assert got[0]["calibration_id"] != "old" and got[1]["calibration_id"] == "old"
    kept = cal.recalibrate(points, table, old_id="other").collect()
    assert not any(r["correctable"] for r in kept)


def test_uncalibrated_channels_are_named_in_order_and_counted(spark):
    df = spark.createDataFrame(
        [(i, at(i // 2), f"X{(7 * (i // 2)) % 70}", 0.0) for i in range(140)] + [(999, at(0), "in0", 0.0)],
        "seq bigint, time timestamp, channel string, raw_count double",
    )
    got = cal.uncalibrated_channels(df, fx.demo_calibrations(spark), named=5).collect()
    assert [r["channel"] for r in got] == ["X0", "X7", "X14", "X21", "X28"]
    assert [(r["readings"], r["place"]) for r in got] == [(14, i + 1) for i in range(5)]
    assert cal.uncalibrated_channels(df, fx.demo_calibrations(spark)).count() == 10


def test_each_reading_is_in_one_class(spark):
    """Rival rows, repeated revision numbers, unusable rows and readings that come too early."""
    base = {"channel": "A0", "revision": 1, "sensor_id": "s", "measurement": "m"} | LINEAR
    rows = [
        base,
        base | {"revision": 2, "factor": 2.0},
        base | {"effective_from": at(50), "factor": 5.0},  # revision 1 once more
        {"channel": "A1", "revision": 1, "sensor_id": "t", "measurement": "m", "mode": "spline",
         "value_unit": "K", "points": fx.points((1.0, 3.0))},
        {"channel": "A2", "revision": 1, "sensor_id": "u", "measurement": "m", "mode": "cubic"},
        base | {"channel": "A3", "sensor_id": "v", "effective_from": at(10)},
    ]
    table = fx.calibrations(spark, rows)
    lines = spark.createDataFrame(
        [(i, at(t), f"{c},4095") for i, (c, t) in enumerate(
            [("A0", 0), ("A0", 60), ("A1", 0), ("A2", 0), ("A3", 0), ("A3", 20), ("A9", 0)]
        )],
        "seq bigint, time timestamp, line string",
    )
    got = {(r["channel"], r["outcome"]): r["readings"] for r in chain.reading_outcomes(lines, table).collect()}
    assert got == {
        ("A0", "written"): 2, ("A1", "skipped"): 1, ("A2", "skipped"): 1,
        ("A3", "uncalibrated"): 1, ("A3", "written"): 1, ("A9", "uncalibrated"): 1,
    }
    points = {r["seq"]: r["value"] for r in chain.gated_points(lines, table).collect()}
    assert points == pytest.approx({0: 6.6, 1: 16.5, 5: 3.3})


def test_recalibration_gives_one_row_for_one(spark):
    """Two channels feed one sensor: a point's id tells which, or it stays as it is."""
    base = {"revision": 1, "sensor_id": "s", "measurement": "m", "factor_unit": "K/V"}
    old = fx.calibrations(spark, [base | {"channel": "A0", "factor": 1.0}, base | {"channel": "A1", "factor": 2.0}])
    new = fx.calibrations(spark, [base | {"channel": "A0", "factor": 10.0}, base | {"channel": "A1", "factor": 20.0}])
    ids = {r["channel"]: r["calibration_id"] for r in cal.conversions(old).collect()}
    points = spark.createDataFrame(
        [("m", at(i), "s", "K", c, 1.0, 1.0, {}, i) for i, c in enumerate([ids["A0"], ids["A1"], "unknown"])],
        "measurement string, time timestamp, sensor_id string, unit string, calibration_id string,"
        "value double, input_volts double, tags map<string,string>, seq bigint",
    )
    got = cal.recalibrate(points, new, written_under=old).orderBy("seq").collect()
    assert [(r["value"], r["correctable"], r["ambiguous"]) for r in got] == [
        (10.0, True, False), (20.0, True, False), (1.0, False, True)
    ]
    assert cal.calibration_in_force(points, old).count() == 3


GATE = {"below": 1.0, "below_unit": "K"}
LINEAR = {"factor": 1.0, "factor_unit": "K/V"}
EXPRESSION = {"mode": "expression", "value_unit": "K"}
RULES = [
    (LINEAR, set()),
    (LINEAR | {"sensor_id": None}, {"V1"}),
    ({}, {"V1"}),
    ({"mode": "spline", "value_unit": "K"}, {"V1"}),
    ({"mode": "cubic"}, {"V2"}),
    ({"mode": "spline", "value_unit": "K", "points": fx.points((0, 0))}, {"V3", "V5"}),
    ({"mode": "piecewise_linear", "value_unit": "K", "points": fx.points((0, 0), (2, 1), (1, 2))}, {"V3"}),
    ({"mode": "piecewise_linear", "value_unit": "K", "points": [{"volts": 1.0}, {"volts": 2.0, "value": 1.0}]}, {"V3"}),
    (LINEAR | {"mode": "affine", "offset": 1.0, "offset_unit": "m"}, {"V4"}),
    ({"factor": 10.0, "factor_unit": "degC / volt"}, {"V4"}),
    ({"factor": 10.0, "factor_unit": "delta_degC / volt"}, set()),
    ({"factor": 10.0, "factor_unit": "furlong / volt"}, {"V4"}),
    (EXPRESSION | {"formula": "5.0 / (1.0 - v)"}, set()),
    (EXPRESSION | {"formula": "1 / (v - v)"}, {"V5"}),
    (EXPRESSION | {"formula": "nope(v)"}, {"V5"}),
    (EXPRESSION | {"formula": "log(v - 2.0)"}, set()),
    (LINEAR | {"gate": GATE}, set()),
    (LINEAR | {"gate": {"dwell": 3.0, "dwell_unit": "s"}}, {"V6"}),
    (LINEAR | {"gate": GATE | {"resume_below": 2.0, "resume_below_unit": "K"}}, {"V6"}),
    (LINEAR | {"gate": GATE | {"resume_above": 0.5, "resume_above_unit": "K"}}, {"V7"}),
    (LINEAR | {"gate": GATE | {"above": 1000.0, "above_unit": "mK"}}, {"V7"}),
    (LINEAR | {"gate": GATE | {"above": 1001.0, "above_unit": "mK"}}, set()),
    (LINEAR | {"gate": {"below": 1.0, "below_unit": "mW"}}, {"V8"}),
    (LINEAR | {"gate": {"below": 1.0, "below_unit": "mV", "raw_voltage": True}}, set()),
    (LINEAR | {"gate": GATE | {"raw_voltage": True}}, {"V8"}),
    (LINEAR | {"gate": GATE | {"dwell": 1.0, "dwell_unit": "m"}}, {"V8"}),
]


def test_checks(spark):
    base = {"revision": 1, "sensor_id": "s", "measurement": "m"}
    rows = [base | {"channel": f"C{i}"} | row for i, (row, _) in enumerate(RULES)]
    rows += [base | LINEAR | {"channel": "twice"}, base | LINEAR | {"channel": "twice", "revision": 2}]
    found = {}
    for r in validate_calibrations(fx.calibrations(spark, rows)).collect():
        found.setdefault(r["channel"], set()).add(r["rule"])
    assert found.pop("twice") == {"V9"}
    assert found == {f"C{i}": rules for i, (_, rules) in enumerate(RULES) if rules}


def test_report(spark):
    rows = [
        {"channel": "B", "revision": 1, "sensor_id": "b", "measurement": "m", **LINEAR},
        {
            "channel": "A", "revision": 1, "sensor_id": "a", "measurement": "m", **LINEAR,
            "provenance": {"by": "lab", "note": "it's"},
        },
    ]
    got = cal.calibrations_report(fx.calibrations(spark, rows)).collect()
    assert [(r["channel"], r["provenance"]) for r in got] == [("A", "by='lab', note=\"it's\""), ("B", "-")]


@pytest.mark.parametrize("revisions", [1, 16, 17, 700])
def test_many_revisions_are_found_by_time(spark, revisions):
    """The last revision that began, whatever their number; levels, not candidates, grow."""
    rng = random.Random(revisions)
    base = {"sensor_id": "s", "measurement": "m", "factor_unit": "K/V"}
    starts = sorted(rng.sample(range(10, 100_000), revisions))
    rows = [base | {"channel": "A0", "revision": i, "effective_from": at(t), "factor": float(i + 1)} for i, t in enumerate(starts)]
    rows.append(base | {"channel": "A1", "revision": 1, "factor": -1.0})
    table = fx.calibrations(spark, rows)
    times = [0, *starts[:50], *[t - 1 for t in starts[-50:]], *rng.sample(range(100_100), 200)]
    counts = [(i, at(t), c, 4095.0) for i, t in enumerate(times) for c in ("A0", "A1", "A2")]
    readings = spark.createDataFrame(counts, "seq bigint, time timestamp, channel string, raw_count double")
    conv = cal.conversions(table)
    valued = cal.calibrate(readings, conv, [])
    got = {(r["channel"], r["seq"]): r["revision"] for r in valued.collect()}
    expected = {("A1", i): 1 for i in range(len(times))}
    for i, t in enumerate(times):
        if began := bisect.bisect_right(starts, t):
            expected["A0", i] = began - 1
    assert got == expected and valued.count() == len(expected)
    points = cal.as_points(cal.drop_non_finite(valued))
    in_force = cal.calibration_in_force(points, table)
    assert {(r["sensor_id"], r["seq"], r["current"]) for r in in_force.filter("value > 0").collect()} == {
        ("s", i, True) for c, i in expected if c == "A0"
    }
    levels = 0 if revisions <= 16 else 1 if revisions <= 256 else 2
    assert valued._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1 + levels
