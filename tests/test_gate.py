import random

import pytest
from helpers import at
from pyspark.sql import functions as F

from benchlight.functions.text import quantity_text, significant
from benchlight.operators import calibrate as cal
from benchlight.operators import ordered
from benchlight.operators.gate import (
    gate_step,
    gate_transitions,
    recording_gaps,
    recording_gate,
)
from benchlight.plans import fixtures as fx

MW = {"below": 1.0, "below_unit": "mW"}
DWELL = {"dwell": 30.0, "dwell_unit": "s"}
BAND = {"below": 100.0, "below_unit": "mV", "above": 3.0, "above_unit": "V"}
DEAD = MW | {"resume_above": 10.0, "resume_above_unit": "mW"}
EASED = BAND | {"resume_below": 2.9, "resume_below_unit": "V"}

# Each case: the gate, the unit of the readings, and (time, value, admitted) per reading.
CASES = {
    "inside": (MW, "mW", [(0, 5.0, True)]),
    "below": (MW, "mW", [(0, 0.2, False)]),
    "above": ({"above": 1e-3, "above_unit": "mbar"}, "mbar", [(0, 1e-7, True), (1, 1.0, False)]),
    "band": (BAND, "V", [(0, 1.5, True), (1, 0.05, False)]),
    "upper edge of a band": (BAND, "V", [(0, 3.2, False)]),
    "units mix": (MW, "W", [(0, 0.005, True), (1, 0.0002, False)]),
    "starts recording": (MW | DWELL, "mW", [(0, 0.0, True)]),
    "brief dip": (
        MW | DWELL, "mW", [(0, 5.0, True), (10, 0.1, True), (20, 0.1, True), (25, 5.0, True), (40, 0.1, True)],
    ),
    "dwell": (MW | DWELL, "mW", [(100, 0.1, True), (129.9, 0.1, True), (130, 0.1, False)]),
    "side change": (BAND | DWELL, "V", [(0, 3.2, True), (20, 0.05, True), (30, 0.05, False)]),
    "no dwell": (MW, "mW", [(0, 0.1, False)]),
    "resumes at once": (MW | DWELL, "mW", [(0, 0.1, True), (60, 0.1, False), (61, 5.0, True)]),
    "deadband": (DEAD, "mW", [(0, 0.9, False), (1, 5.0, False), (2, 11.0, True)]),
    "stop bound reused": (MW, "mW", [(0, 0.9, False), (1, 1.1, True)]),
    "two-sided resume": (EASED, "V", [(0, 3.2, False), (1, 2.95, False), (2, 2.5, True), (3, 0.05, False)]),
    "far bound": (EASED, "V", [(0, 3.2, False), (1, 3.5, False), (2, 2.95, False), (3, 2.85, True)]),
    "under the floor": (DEAD, "mW", [(0, 0.9, False), (1, 0.1, False), (2, 5.0, False), (3, 11.0, True)]),
    "on a stop bound": (MW | {"above": 3.0, "above_unit": "mW"}, "mW", [(0, 3.0, True), (1, 1.0, True)]),
    "on a resume bound": (DEAD, "mW", [(0, 0.5, False), (1, 10.0, False), (2, 10.001, True)]),
    "on the upper resume bound": (EASED, "V", [(0, 3.2, False), (1, 2.9, False), (2, 2.899, True)]),
    "dwell starts again": (
        MW | DWELL, "mW", [(0, 0.1, True), (30, 0.1, False), (31, 5.0, True), (32, 0.1, True), (62, 0.1, False)],
    ),
    "hovering": (
        MW | {"dwell": 1.0, "dwell_unit": "min"}, "mW", [(0, 0.5, True), (59, 0.5, True), (60, 0.5, False)],
    ),
}


def _conversions(spark):
    rows = [
        {
            "channel": name, "revision": 1, "sensor_id": name, "measurement": "m",
            "factor": 1.0, "factor_unit": f"{unit}/V", "gate": gate,
        }
        for name, (gate, unit, _) in CASES.items()
    ]
    return cal.conversions(fx.calibrations(spark, rows))


def _readings(spark, rows):
    return spark.createDataFrame(
        rows,
        "channel string, seq bigint, time timestamp, value double, input_volts double, revision int",
    )


def test_cases(spark):
    conv = _conversions(spark)
    rows = [
        (name, i, at(t), value, value, 1)
        for name, (_, _, steps) in CASES.items()
        for i, (t, value, _) in enumerate(steps)
    ]
    valued = _readings(spark, rows).join(conv.select("channel", "gate"), "channel")
    got = {(r["channel"], r["seq"]): r["admitted"] for r in recording_gate(valued).collect()}
    expected = {
        (name, i): admitted
        for name, (_, _, steps) in CASES.items()
        for i, (_, _, admitted) in enumerate(steps)
    }
    assert got == expected


def test_transitions_and_gaps(spark):
    conv = _conversions(spark)
    name = "two-sided resume"
    rows = [(name, i, at(t), v, v, 1) for i, (t, v, _) in enumerate(CASES[name][2])]
    valued = _readings(spark, rows).join(conv.select("channel", "gate"), "channel")
    changes = gate_transitions(recording_gate(valued), conv)
    got = [tuple(r) for r in changes.orderBy("seq").select("seq", "message", "limit", "value_text").collect()]
    assert got == [
        (0, "recording stopped", "above 3 V", "3.2 V"),
        (2, "recording resumed", "above 100 mV and below 2.9 V", "2.5 V"),
        (3, "recording stopped", "below 100 mV", "0.05 V"),
    ]
    gaps = recording_gaps(changes).orderBy("stopped_at").collect()
    assert [(r["duration_s"], r["limit"]) for r in gaps] == [(2.0, "above 3 V"), (None, "below 100 mV")]
    assert gaps[1]["resumed_at"] is None


def test_raw_voltage_picks_the_input(spark):
    gate = {"above": 3.0, "above_unit": "V", "raw_voltage": True}
    rows = [
        {"channel": "raw", "revision": 1, "sensor_id": "q", "measurement": "m",
         "factor": 1.0, "factor_unit": "mW/V", "gate": gate},
        {"channel": "value", "revision": 1, "sensor_id": "p", "measurement": "m",
         "factor": 1.0, "factor_unit": "mW/V", "gate": MW},
    ]
    conv = cal.conversions(fx.calibrations(spark, rows))
    readings = _readings(
        spark,
        [("raw", 0, at(0), 500.0, 1.5, 1), ("raw", 1, at(1), 500.0, 3.2, 1), ("value", 0, at(0), 5.0, 0.0, 1)],
    ).join(conv.select("channel", "gate"), "channel")
    gated = recording_gate(readings)
    got = {(r["channel"], r["seq"]): r["admitted"] for r in gated.collect()}
    assert got == {("raw", 0): True, ("raw", 1): False, ("value", 0): True}
    assert gate_transitions(gated, conv).first()["value_text"] == "3.2 V"


def walk(steps, gate):
    """The gate as a loop over (time, seq, value)."""
    below, above, floor, ceiling, dwell = gate
    recording, since, result = True, None, []
    for t, _, x in sorted(steps):
        out = (below is not None and x < below) or (above is not None and x > above)
        lo, hi = below if floor is None else floor, above if ceiling is None else ceiling
        back = (lo is None or x > lo) and (hi is None or x < hi)
        if recording:
            if not out:
                since = None
            else:
                since = t if since is None else since
                if t - since >= dwell:
                    recording = False
        elif back:
            recording, since = True, None
        result.append(recording)
    return result


GATES = [
    (3, None, None, None, 0), (3, None, 6, None, 3), (None, 7, None, 7, 10),
    (3, 7, 4, 6, 3), (3, 7, 3, 6, 600), (2, 8, None, None, 3600), (3, None, 6, None, 5000),
]


def _random_series(seed, length=150):
    """Series with long silences, bursts within a second, and many rows at one instant."""
    rng, rows, expected = random.Random(seed), [], {}
    for c in range(70):
        gate, steps, t = GATES[c % len(GATES)], [], 0
        for i in range(length):
            t += rng.choice([0, 0, 0, 0.001, 0.2, 1, 3, 5, 700, 3000, 4000])
            low = rng.random() < 0.7
            steps.append((round(t, 3), i, float(rng.choice([0, 1, 2, 3, 9] if low else range(10)))))
        for (when, i, x), admitted in zip(sorted(steps), walk(steps, gate)):
            rows.append((f"c{c}", i, at(when), x, x, c % len(GATES)))
            expected[f"c{c}", i] = admitted
    return rows, expected


def _with_events(df):
    out = back = dwell = F.lit(None)
    x = F.col("value")
    for i, (below, above, floor, ceiling, seconds) in enumerate(GATES):
        mine = F.col("revision") == i
        lo, hi = below if floor is None else floor, above if ceiling is None else ceiling
        outside = (x < below if below is not None else F.lit(False)) | (
            x > above if above is not None else F.lit(False)
        )
        inside = (x > lo if lo is not None else F.lit(True)) & (x < hi if hi is not None else F.lit(True))
        out = F.when(mine, outside).otherwise(out)
        back = F.when(mine, inside).otherwise(back)
        dwell = F.when(mine, seconds * 1_000_000).otherwise(dwell)
    return df.withColumns(
        {"gate_out": out, "gate_back": back, "gate_dwell_us": dwell.cast("bigint")}
    )


@pytest.mark.parametrize(("seed", "split_rows", "per_task"), [(1, 10**6, 10**6), (2, 12, 2), (3, 4, 3), (4, 1, 1)])
def test_random_series_match_the_loop(spark, monkeypatch, seed, split_rows, per_task):
    """However a history is cut, and whether its chunks are carried at once or up a ladder."""
    monkeypatch.setattr(ordered, "CHUNKS_PER_TASK", per_task)
    rows, expected = _random_series(seed)
    gated = recording_gate(_with_events(_readings(spark, rows)), split_rows=split_rows)
    got = {(r["channel"], r["seq"]): r["admitted"] for r in gated.collect()}
    assert got == expected
    assert 500 < sum(not v for v in got.values())
    # The state before a reading is the state after the one before it.
    before = {}
    for r in sorted(gated.collect(), key=lambda r: (r["channel"], r["time"], r["seq"])):
        assert r["was_recording"] == before.get(r["channel"], True)
        before[r["channel"]] = r["admitted"]


def walk_changing(steps, gate_of):
    """The loop again, each reading judged by the gate in force."""
    recording, since, result = True, None, []
    for t, i, x in sorted(steps):
        below, above, floor, ceiling, dwell = GATES[gate_of[i]]
        out = (below is not None and x < below) or (above is not None and x > above)
        lo, hi = below if floor is None else floor, above if ceiling is None else ceiling
        since = (t if since is None else since) if out else None
        if recording and out and t - since >= dwell:
            recording = False
        elif not out and (lo is None or x > lo) and (hi is None or x < hi):
            recording = True
        result.append(recording)
    return result


@pytest.mark.parametrize("split_rows", [1, 4, 12, 10**6])
def test_revisions_change_the_dwell_inside_a_run(spark, split_rows):
    rng, rows, expected = random.Random(split_rows + 8), [], {}
    for c in range(40):
        steps, t, gate_of, gate = [], 0, {}, 0
        for i in range(120):
            t += rng.choice([0, 0, 0.001, 1, 3, 5, 700, 3000, 4000])
            gate = rng.randrange(len(GATES)) if rng.random() < 0.2 else gate
            gate_of[i] = gate
            steps.append((round(t, 3), i, float(rng.choice([0, 0, 0, 1, 2, 3, 9]))))
        for (when, i, x), admitted in zip(sorted(steps), walk_changing(steps, gate_of)):
            rows.append((f"c{c}", i, at(when), x, x, gate_of[i]))
            expected[f"c{c}", i] = admitted
    gated = recording_gate(_with_events(_readings(spark, rows)), split_rows=split_rows)
    assert {(r["channel"], r["seq"]): r["admitted"] for r in gated.collect()} == expected


@pytest.mark.parametrize("split_rows", [10**6, 4])
def test_a_state_carries_the_gate_over_pieces(spark, split_rows):
    """A series gated piece by piece gives the verdicts of the whole."""
    rows, expected = _random_series(5, length=60)
    rows.sort(key=lambda r: (r[2], r[1]))
    state, got = None, {}
    for i in range(4):
        piece = [r for j, r in enumerate(rows) if j * 4 // len(rows) == i]
        gated, left = gate_step(_with_events(_readings(spark, piece)), state, split_rows=split_rows)
        got |= {(r["channel"], r["seq"]): r["admitted"] for r in gated.collect()}
        state = spark.createDataFrame(
            [tuple(r) for r in left.select("channel", "recording", "clock").collect()],
            "channel string, recording boolean, clock bigint",
        )
    assert got == expected


@pytest.mark.parametrize(
    "x", [0.03, 20.589744, 152.428571, 1.0, 0.0, -2.5, 100.0, 99999.0, 9999.5, 12346.0, 1e-5, 1.5e-4, 0.00001234,
          1e22, 3e-300, float("inf"), float("nan")],
)
def test_significant_digits(spark, x):
    row = spark.range(1).select(F.lit(x).alias("x")).select(F.expr(significant("x", 4)).alias("t")).first()
    assert row["t"] == f"{x:.4g}"


def test_quantities(spark):
    df = spark.createDataFrame([(1.0, "mW"), (2.9, "V"), (100.0, None)], "x double, u string")
    got = [r[0] for r in df.select(F.expr(quantity_text("x", "u"))).collect()]
    assert got == ["1 mW", "2.9 V", "100"]
