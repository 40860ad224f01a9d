"""What each published query must return, as SQL another engine runs.

Written from the semantics alone: readings are parsed with other functions, curves
are literal CASE expressions, and the gate walks its readings one by one.
"""

from __future__ import annotations

from benchlight.plans import fixtures as fx

ORACLES: dict[str, str] = {}


def _text(sql: str) -> str:
    return sql.strip().replace("AS STRING", "AS VARCHAR")


def _slot(time: str, seconds: int) -> str:
    width = seconds * 1_000_000
    return f"make_timestamp((epoch_us({time}) // {width}) * {width})"


LINES = f"lines AS ({_text(fx.LINES_SQL)})"

_NUMBER = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def _parsed(lines: str) -> str:
    return f"""parts AS (
  SELECT *, string_split(line, ',') AS f FROM {lines}),
parsed AS (
  SELECT *, CASE WHEN trim(line) = '' THEN NULL
    WHEN len(f) <> 2 THEN 'expected ''<channel>,<count>'''
    WHEN trim(f[1]) = '' THEN 'empty channel'
    WHEN NOT regexp_full_match(trim(f[1]), '[A-Za-z0-9_.-]{{1,32}}')
      THEN 'channel name has a disallowed character or length'
    WHEN lower(trim(f[2])) IN ('nan', '-infinity') THEN 'count is not finite'
    WHEN NOT regexp_matches(trim(f[2]), '{_NUMBER}') THEN 'count is not a number'
    WHEN trim(f[2]) = '9e999' THEN 'count is not finite' END AS reason
  FROM parts),
good AS (
  SELECT seq, time, trim(f[1]) AS channel, CAST(trim(f[2]) AS DOUBLE) AS raw_count
  FROM parsed WHERE reason IS NULL AND trim(line) <> '')"""


PARSED = f"{LINES}, {_parsed('lines')}"
READINGS = f"good AS ({_text(fx.READINGS_SQL)})"

# Points of the demo channels out of `good`, with the voltage as `v`.
POINTS = f"""volts AS (
  SELECT *, (raw_count / 4095::DOUBLE) * 3.3::DOUBLE AS v FROM good),
points AS (
  SELECT volts.*, s.sensor_id, s.measurement, s.unit,
    CASE volts.channel
      WHEN 'in0' THEN CASE WHEN v <= 0.3 THEN 90 WHEN v >= 2.4 THEN 260
        WHEN v < 1.1 THEN 90 + 50 * (v - 0.3) ELSE 130 + 100 * (v - 1.1) END
      WHEN 'in1' THEN 2 * v * v * v - v * v + 5 * v + 1
      WHEN 'in2' THEN v * 12.5
      WHEN 'in3' THEN v * 0.8 - 1.3
      WHEN 'in4' THEN 2.5e-9 * exp(3 * v)
      WHEN 'in5' THEN v * 20 + 268
      WHEN 'in6' THEN CASE WHEN v <= 0.6 THEN 330 WHEN v >= 2.8 THEN 270 ELSE 330 - 60 * ((v - 0.6) / 2.2) END
      WHEN 'in7' THEN v * 7.5 END AS value
  FROM volts JOIN (VALUES
    ('in0', 'head-space', 'pressure', 'kPa'), ('in1', 'vessel-weight', 'force', 'N'),
    ('in2', 'stirrer', 'rate', 'Hz'), ('in3', 'stirrer-magnet', 'field', 'T'),
    ('in4', 'electrode', 'current', 'A'), ('in5', 'broth', 'temperature', 'K'),
    ('in6', 'jacket', 'temperature', 'K'), ('in7', 'supply', 'voltage', 'V')) s(channel, sensor_id, measurement, unit)
    ON s.channel = volts.channel)"""

FROM_LINES = f"WITH {PARSED}, {POINTS}"
FROM_STORE = f"WITH {READINGS}, {POINTS}, demo AS (SELECT * FROM points)"


def _shown(column: str, digits: int = 6) -> str:
    """A rounded value; a current by its decades."""
    return f"round(CASE WHEN sensor_id = 'electrode' THEN log10({column}) ELSE {column} END, {digits})"


# The gate as the machine it is: one reading after the other, per gated channel.
WALK = f"""WITH RECURSIVE {PARSED}, {POINTS},
gated AS (
  SELECT channel, sensor_id, time, seq, row_number() OVER (PARTITION BY channel ORDER BY time, seq) AS rn,
    CASE channel WHEN 'in7' THEN v ELSE value END AS x,
    CASE channel WHEN 'in7' THEN (v < 0.15 OR v > 2.8) ELSE value > 24 END AS out,
    CASE channel WHEN 'in7' THEN (v > 0.25 AND v < 2.8) ELSE value < 12 END AS back,
    CASE channel WHEN 'in7' THEN 5400 ELSE 3000 END::BIGINT AS dwell
  FROM points WHERE channel IN ('in2', 'in7')),
walk(channel, rn, since, state, before) AS (
  SELECT channel, CAST(0 AS BIGINT), NULL::TIMESTAMP, true, true
  FROM (VALUES ('in2'), ('in7')) c(channel)
  UNION ALL
  SELECT g.channel, g.rn,
    CASE WHEN w.state AND g.out THEN coalesce(w.since, g.time) END,
    CASE WHEN w.state
      THEN NOT (g.out AND epoch_us(g.time) - epoch_us(coalesce(w.since, g.time)) >= dwell * 1000000)
      ELSE g.back END,
    w.state
  FROM walk w JOIN gated g ON g.channel = w.channel AND g.rn = w.rn + 1),
verdict AS (
  SELECT g.*, w.before AS was_recording, w.state AS admitted
  FROM gated g JOIN walk w ON w.channel = g.channel AND w.rn = g.rn),
changes AS (
  SELECT channel, sensor_id, time, seq, x, admitted,
    CASE WHEN was_recording THEN 'recording stopped' ELSE 'recording resumed' END AS message,
    CASE WHEN channel = 'in2' THEN
      CASE WHEN was_recording THEN 'above 24 Hz' ELSE 'below 0.012 kHz' END
    WHEN NOT was_recording THEN 'above 0.25 V and below 2.8 V'
    WHEN x < 0.15 THEN 'below 150 mV' ELSE 'above 2.8 V' END AS "limit"
  FROM verdict WHERE was_recording <> admitted)"""

# The same walk under the revisions that change the dwells from the eleventh on.
WALK_REVISED = WALK.replace(
    "CASE channel WHEN 'in7' THEN 5400 ELSE 3000 END::BIGINT AS dwell",
    "CASE WHEN time < TIMESTAMP '2024-01-11' THEN CASE channel WHEN 'in7' THEN 5400 ELSE 3000 END"
    " ELSE CASE channel WHEN 'in7' THEN 1200 ELSE 25200 END END::BIGINT AS dwell",
)

SUMMARY = f"""{WALK},
span AS (SELECT min(time) AS first, max(time) AS last FROM lines),
ticks AS (
  SELECT unnest(generate_series({_slot("first", 21600)}, {_slot("last", 21600)},
                                INTERVAL 6 HOUR)) AS window_start FROM span),
written AS (
  SELECT sensor_id, {_slot("time", 21600)} AS window_start FROM verdict WHERE admitted
  UNION ALL
  SELECT sensor_id, {_slot("time", 21600)} FROM points WHERE channel NOT IN ('in2', 'in7')),
summary AS (
  SELECT t.window_start, d.sensor_id,
    (SELECT count(*) FROM written w
     WHERE w.window_start = t.window_start AND w.sensor_id = d.sensor_id) AS readings,
    CAST(0 AS BIGINT) AS skipped, 21600 AS window_s
  FROM ticks t, (SELECT DISTINCT sensor_id FROM points UNION
                 VALUES ('head-space'), ('vessel-weight'), ('stirrer'), ('stirrer-magnet'),
                        ('electrode'), ('broth'), ('jacket'), ('supply')) d(sensor_id))"""


def _values(channels: str) -> str:
    return (
        f"{FROM_LINES} SELECT channel, seq, unit, round(value, 6) AS value"
        f" FROM points WHERE channel IN ({channels})"
    )


ORACLES |= {
    "parse_ok": f"WITH {PARSED} SELECT * FROM good",
    "quarantine": f"WITH {PARSED} SELECT seq, time, line, reason FROM parsed WHERE reason IS NOT NULL",
    "malformed_by_reason": f"WITH {PARSED} SELECT reason, count(*) AS lines FROM parsed"
    " WHERE reason IS NOT NULL GROUP BY reason",
    "read_wire": f"""WITH {PARSED} SELECT CASE WHEN reason IS NULL THEN nullif(trim(f[1]), '') END AS channel, reason,
 count(*) AS lines, count(*) AS places FROM parsed GROUP BY ALL""",
    "read_wire_stamped": f"WITH {PARSED} SELECT time, channel, raw_count FROM good",
    "scan_measurement": f"""{FROM_STORE} SELECT sensor_id, time, seq, round(value, 6) AS value, round(v, 6) AS input_volts
FROM points WHERE measurement = 'temperature' AND time >= TIMESTAMP '2024-01-10' AND time < TIMESTAMP '2024-01-13'""",
    "raw_to_voltage": f"WITH r AS ({_text(fx.SCALE_SQL)}) SELECT seq, channel,"
    " round(raw_count * 3.3::DOUBLE / 4095::DOUBLE, 6) AS volts FROM r",
    "calibrate_linear": _values("'in2', 'in7'"),
    "calibrate_affine": _values("'in3', 'in5'"),
    "calibrate_piecewise": _values("'in0', 'in6'"),
    "calibrate_spline": _values("'in1'"),
    "calibrate_expression": f"{FROM_LINES} SELECT seq, unit, round(log10(value), 6) AS log_value"
    " FROM points WHERE channel = 'in4'",
    "uncalibrated_channels": """
WITH r AS (SELECT event_id AS seq, date_trunc('millisecond', ts) AS time,
                  concat('in', CAST(user_id AS VARCHAR)) AS channel FROM events),
s AS (SELECT channel, min(time) AS first_time, count(*) AS readings FROM r
      WHERE channel NOT IN ('in0', 'in1', 'in2', 'in3', 'in4', 'in5', 'in6', 'in7') GROUP BY channel),
f AS (SELECT s.channel, s.first_time, min(r.seq) AS first_seq, s.readings
      FROM s JOIN r ON r.channel = s.channel AND r.time = s.first_time GROUP BY ALL)
SELECT *, row_number() OVER (ORDER BY first_time, first_seq, channel) AS place FROM f""",
    "calibrated_points": f"""{FROM_LINES} SELECT measurement, time, sensor_id, unit,
 {_shown("value")} AS value,
 CASE WHEN channel <> 'in3' THEN round(v, 6) END AS input_volts, seq
FROM points""",
    "store_input_override": f"""{FROM_STORE} SELECT sensor_id,
 count(CASE WHEN channel <> 'in3' THEN v END) AS kept, count(*) AS points FROM points GROUP BY 1""",
}

_AWKWARD = f"""WITH {READINGS}, v AS (
  SELECT seq, time, concat('probe-', channel[3:3]) AS sensor_id,
    (raw_count / 4095::DOUBLE) * 3.3::DOUBLE AS v, channel FROM good WHERE channel <= 'in4'),
k AS (SELECT *, CASE channel WHEN 'in0' THEN v > 1.0 WHEN 'in1' THEN false
  WHEN 'in2' THEN v >= 2 WHEN 'in3' THEN 900 * v < 308.2547155599167 ELSE true END AS fine FROM v)"""

ORACLES |= {
    "skipped_non_finite": f"""{_AWKWARD} SELECT sensor_id,
 count(*) FILTER (fine) AS written, count(*) FILTER (NOT fine) AS skipped FROM k GROUP BY 1""",
    "first_non_finite": f"""{_AWKWARD} SELECT sensor_id, count(*) AS skipped,
 arg_min(time, (time, seq)) AS time, arg_min(seq, (time, seq)) AS seq,
 round(arg_min(v, (time, seq)), 6) AS input_volts,
 -- a logarithm below zero and the root of a negative number are no numbers, at zero the
 -- logarithm is infinite; a pole and an overflow are undefined
 CASE sensor_id WHEN 'probe-0' THEN CASE WHEN arg_min(v, (time, seq)) = 1.0 THEN 'infinite' ELSE 'nan' END
   WHEN 'probe-2' THEN 'nan' ELSE 'undefined' END AS value
FROM k WHERE NOT fine GROUP BY sensor_id""",
}

# --- calibration tables ------------------------------------------------------------

CALIBRATIONS = f"""c AS (SELECT *, CASE
   WHEN bad_points = 1 THEN [{{'x': 1.0::DOUBLE, 'y': top}}]
   WHEN bad_points = 2 THEN [{{'x': 1.0::DOUBLE, 'y': top}}, {{'x': 1.0::DOUBLE, 'y': top + 1}}]
   WHEN steps % 2 = 0 THEN list_transform(range(1, 6), lambda i: {{'x': 0.5::DOUBLE * i, 'y': top + i * i}})
   ELSE list_transform(range(1, 6), lambda i: {{'x': 3::DOUBLE - 0.5::DOUBLE * (6 - i), 'y': top + (6 - i) * (6 - i)}})
   END AS pts, coalesce(mode, 'linear') AS kind FROM ({_text(fx.CALIBRATIONS_SQL)}))"""

# What each row's id is the hash of; a row without its factor or with an unknown mode has none.
PART_IDS = """k AS (SELECT *, factor_unit = 'degC / V' AS warm,
   CASE WHEN factor_unit IN ('W/V', 'degC / V') THEN 1 ELSE 0.001 END * factor AS base,
   CASE WHEN value_unit IS NULL THEN '1.00000000000e+00 0,0,0,0,0' ELSE '1.00000000000e+00 0,0,0,0,1' END AS whole,
   list_aggregate(list_transform(pts, lambda p: printf('%.11e:%.11e', p.x, p.y)), 'string_agg', ',') AS trace
 FROM c),
t AS (SELECT *, printf('%.11e', base) || CASE WHEN warm THEN ' -2,-1,3,1,1' ELSE ' 0,0,0,1,0' END AS slope FROM k),
ids AS (SELECT *, substr(sha256(CASE kind
     WHEN 'linear' THEN 'linear|' || slope
     WHEN 'affine' THEN 'affine|' || slope || '|' || printf('%.11e', "offset")
       || CASE WHEN offset_unit = 'K' THEN ' 0,0,0,0,1' ELSE ' 2,1,-3,0,0' END
     WHEN 'expression' THEN 'expression|' || whole || '|' || formula
     WHEN 'cubic' THEN NULL
     ELSE kind || '|' || whole || '|' || trace END), 1, 8) AS calibration_id,
   CASE WHEN kind NOT IN ('linear', 'affine') THEN CASE WHEN value_unit IS NOT NULL THEN 'K' END
     WHEN warm THEN '°C' WHEN factor_unit = 'W/V' THEN 'W' ELSE 'mW' END AS unit FROM t)"""


def _trace(*pairs: tuple[float, float]) -> str:
    return ",".join(f"{v:.11e}:{y:.11e}" for v, y in pairs)


# The same for the demo channels, by revision.
DEMO_IDS = "ids AS (SELECT channel, revision, substr(sha256(text), 1, 8) AS calibration_id FROM (VALUES " + ", ".join(
    f"('{channel}', {revision}, '{text}')"
    for channel, revision, text in (
        ("in0", 1, "piecewise_linear|1.00000000000e+03 -1,1,-2,0,0|" + _trace((0.3, 90), (1.1, 130), (2.4, 260))),
        ("in1", 1, "spline|1.00000000000e+00 1,1,-2,0,0|"
         + _trace((0.25, 2.21875), (0.75, 5.03125), (1.5, 13.0), (2.25, 29.96875), (3.0, 61.0))),
        ("in2", 1, "linear|1.25000000000e+01 -2,-1,2,1,0"),
        ("in2", 2, "linear|1.37500000000e+01 -2,-1,2,1,0"),
        ("in3", 1, "affine|8.00000000000e-01 -2,0,1,0,0|-1.30000000000e+00 0,1,-2,-1,0"),
        ("in3", 2, "affine|8.80000000000e-01 -2,0,1,0,0|-1.30000000000e+00 0,1,-2,-1,0"),
        ("in4", 1, "expression|1.00000000000e+00 0,0,0,1,0|2.5e-9 * exp(3*v)"),
        ("in5", 1, "affine|2.00000000000e+01 -2,-1,3,1,1|2.68000000000e+02 0,0,0,0,1"),
        ("in6", 1, "piecewise_linear|1.00000000000e+00 0,0,0,0,1|" + _trace((0.6, 330), (2.8, 270))),
        ("in7", 1, "linear|7.50000000000e+00 0,0,0,0,0"),
    )
) + ") x(channel, revision, text))"

ORACLES |= {
    "calibration_ids": f"WITH {CALIBRATIONS}, {PART_IDS} SELECT channel, unit, calibration_id FROM ids",
    "calibrations_report": f"""WITH {CALIBRATIONS}, {PART_IDS}
SELECT channel, revision, sensor_id, calibration_id,
  CASE WHEN steps % 4 = 0 THEN '-'
    ELSE concat('operator=''lab'', reference=', chr(39), brand, chr(39)) END AS provenance
FROM ids""",
    # The points lie on value = top + (2 v)^2 or top + (6 - 2 v)^2, which a cubic
    # spline through five of them reproduces; straight pieces have constant slopes.
    "fit_segments": f"""WITH {CALIBRATIONS},
k AS (SELECT channel, kind AS mode, top, steps % 2 = 0 AS rising, i,
        0.5::DOUBLE * i AS lo FROM c, (SELECT unnest(range(0, 6)) AS i)
      WHERE kind IN ('spline', 'piecewise_linear') AND bad_points = 0),
e AS (SELECT *, CASE WHEN rising THEN 0 ELSE 6 END AS s FROM k),
-- a repeated voltage still has its clamps and a piece without a slope
flat AS (SELECT channel, kind AS mode, top FROM c WHERE kind = 'piecewise_linear' AND bad_points = 2)
SELECT channel, mode,
  CASE WHEN (mode = 'spline' AND i = 1) OR i = 0 THEN NULL ELSE lo END AS v_lo,
  CASE WHEN (mode = 'spline' AND i = 4) OR i = 5 THEN NULL ELSE lo + 0.5 END AS v_hi,
  round(top + CASE WHEN i = 0 THEN (s - 1) * (s - 1) ELSE (s - i) * (s - i) END, 6) AS c0,
  round(CASE WHEN i IN (0, 5) THEN 0 WHEN mode = 'spline' THEN -4.0 * (s - i)
    ELSE 2.0 * ((s - i - 1) * (s - i - 1) - (s - i) * (s - i)) END, 6)::DOUBLE AS c1,
  CASE WHEN mode = 'spline' THEN 4.0 ELSE 0.0 END::DOUBLE AS c2, 0::DOUBLE AS c3,
  CASE WHEN mode = 'spline' OR i BETWEEN 1 AND 4 THEN lo ELSE 0 END::DOUBLE AS v0
FROM e WHERE mode = 'piecewise_linear' OR i BETWEEN 1 AND 4
UNION ALL
SELECT channel, mode, lo, hi, round(c0, 6), c1, 0::DOUBLE, 0::DOUBLE, v0 FROM flat,
  LATERAL (VALUES (NULL::DOUBLE, 1::DOUBLE, top, 0::DOUBLE, 0::DOUBLE), (1, 1, top, NULL, 1),
    (1, NULL, top + 1, 0, 0)) x(lo, hi, c0, c1, v0)""",
    "validate_calibration_table": f"""WITH {CALIBRATIONS}, k AS (SELECT *, kind = 'cubic' AS odd,
  kind IN ('linear', 'affine') AS scaled, kind IN ('spline', 'piecewise_linear') AS measured FROM c),
v(channel, revision, rule, detail, broken) AS (
 SELECT channel, revision, 'V1', 'is missing ''sensor_id''', sensor_id IS NULL FROM k
 UNION ALL SELECT channel, revision, 'V1', 'is missing ''measurement''', measurement = '' FROM k
 UNION ALL SELECT channel, revision, 'V1', 'is missing ''factor''', scaled AND factor IS NULL FROM k
 UNION ALL SELECT channel, revision, 'V1', 'is missing ''value_unit''',
   (measured OR kind = 'expression') AND value_unit IS NULL FROM k
 UNION ALL SELECT channel, revision, 'V2', 'has unknown mode cubic', odd FROM k
 UNION ALL SELECT channel, revision, 'V3', 'needs at least two measured points', measured AND bad_points = 1 FROM k
 UNION ALL SELECT channel, revision, 'V3', 'voltages must be strictly monotonic', measured AND bad_points = 2 FROM k
 UNION ALL SELECT channel, revision, 'V4', 'uses an offset unit', scaled AND factor_unit = 'degC / V' FROM k
 UNION ALL SELECT channel, revision, 'V4', 'offset is not of the factor''s dimension',
   kind = 'affine' AND (offset_unit = 'K') <> (factor_unit = 'degC / V') FROM k
 UNION ALL SELECT channel, revision, 'V5', 'cannot be applied at any probe voltage',
   (measured AND value_unit IS NOT NULL AND (bad_points = 1 OR (bad_points = 2 AND kind = 'spline')))
   OR (kind = 'expression' AND defect = 10) FROM k
 UNION ALL SELECT channel, revision, 'V5', 'name ''w'' is not defined', kind = 'expression' AND defect = 11 FROM k
 UNION ALL SELECT channel, revision, 'V6', 'needs ''below'' or ''above''', defect = 12 FROM k
 UNION ALL SELECT channel, revision, 'V6', 'sets ''resume_above'' without ''below''', defect = 13 FROM k
 UNION ALL SELECT channel, revision, 'V7',
   'the bounds must read below <= resume_above < resume_below <= above', defect IN (15, 16, 17) FROM k
 UNION ALL SELECT channel, revision, 'V8', '''above'' cannot be compared with what is gated', defect = 14 FROM k
 UNION ALL SELECT channel, revision, 'V8',
   'dwell must be a duration; ''m'' is metres, minutes are ''min''', defect = 19 FROM k)
SELECT channel, revision, rule, detail FROM v WHERE broken""",
    "recalibrate": f"""{FROM_STORE} SELECT sensor_id, seq, {_shown("value")} AS old_value,
 channel = 'in2' AS correctable,
 {_shown("CASE WHEN channel = 'in2' THEN v * 13.75::DOUBLE ELSE value END")} AS value, unit
FROM points""",
    "calibration_in_force": f"""{FROM_STORE}, p AS (
 SELECT sensor_id, time, seq, CASE WHEN channel IN ('in2', 'in3') AND time >= TIMESTAMP '2024-01-16'
   THEN 2 ELSE 1 END AS revision_in_force FROM points)
SELECT sensor_id, revision_in_force, revision_in_force = 1 AS current,
 count(*) AS points, min(time) AS first_time FROM p GROUP BY ALL""",
    "calibration_usage": f"""{FROM_STORE}, {DEMO_IDS}, p AS (
 SELECT channel, sensor_id, time, CASE WHEN channel IN ('in2', 'in3') AND time >= TIMESTAMP '2024-01-16'
   THEN 2 ELSE 1 END AS revision FROM points)
SELECT sensor_id, calibration_id, min(time) AS first_time, max(time) AS last_time, count(*) AS readings
FROM p JOIN ids USING (channel, revision) GROUP BY sensor_id, calibration_id""",
    "convert_to_watts": f"""WITH r AS ({_text(fx.PHYSICAL_SQL)})
SELECT seq, sensor_id, CASE WHEN unit = 'mW' THEN round(value * 0.001, 6) END AS converted,
 'W' AS converted_unit, unit <> 'mW' AS violation
FROM r WHERE value IS NOT NULL AND NOT isnan(value)""",
}

_BROKEN, _, _ALL = ORACLES["validate_calibration_table"].rpartition("SELECT channel, revision, rule, detail FROM v")
ORACLES["validate_repeated_calibrations"] = f"""{_BROKEN}, b AS (SELECT channel, revision, rule, detail FROM v {_ALL})
SELECT * FROM b UNION ALL SELECT * FROM b WHERE revision % 4 = 0
UNION ALL SELECT channel, revision, 'V9', 'appears 2 times for one time' FROM c WHERE revision % 4 = 0
UNION ALL SELECT channel, revision, 'V9', 'appears 2 times as one revision' FROM c WHERE revision % 4 = 0"""

# --- gate and health ----------------------------------------------------------------

ORACLES |= {
    "recording_gate": f"""{WALK} SELECT channel, seq, was_recording, admitted FROM verdict
UNION ALL SELECT channel, seq, true, true FROM points WHERE channel NOT IN ('in2', 'in7')""",
    "gated_points": f"""{WALK}, stored AS (
  SELECT p.* FROM points p WHERE channel NOT IN ('in2', 'in7')
  UNION ALL SELECT p.* FROM points p JOIN verdict w ON w.seq = p.seq WHERE w.admitted)
SELECT measurement, time, sensor_id, unit, {_shown("value")} AS value,
 CASE WHEN channel <> 'in3' THEN round(v, 6) END AS input_volts, seq FROM stored""",
    "gate_transitions": f"""{WALK} SELECT channel, sensor_id, time, seq, message,
 round(x, 6) AS value, "limit" FROM changes""",
    "transition_lines": f"""{WALK} SELECT seq, concat('level=info logger=gate msg="', message,
 '" limit="', "limit", '" sensor_id=', sensor_id, ' value="', format('{{:.4g}}', x),
 CASE channel WHEN 'in7' THEN ' V"' ELSE ' Hz"' END) AS line FROM changes""",
    "recording_gaps": f"""{WALK}, n AS (SELECT *, lead(time) OVER (PARTITION BY channel ORDER BY time, seq) AS nxt
 FROM changes) SELECT channel, sensor_id, time AS stopped_at, nxt AS resumed_at,
 round((epoch_us(nxt) - epoch_us(time)) / 1e6, 3) AS duration_s, "limit" FROM n WHERE NOT admitted""",
    "recording_gate_revised": f"""{WALK_REVISED} SELECT channel, seq, was_recording, admitted FROM verdict
UNION ALL SELECT channel, seq, true, true FROM good WHERE (channel IN ('in0', 'in1') AND time < TIMESTAMP '2024-01-11')
  OR (channel = 'in8' AND time >= TIMESTAMP '2024-01-16') OR channel IN ('in3', 'in4', 'in5', 'in6')""",
    "reading_outcomes": f"""{WALK_REVISED}
SELECT channel, outcome, count(*) AS readings FROM (
  SELECT channel, CASE WHEN admitted THEN 'written' ELSE 'gated out' END AS outcome FROM verdict
  UNION ALL SELECT channel, CASE
    WHEN channel = 'in8' AND time < TIMESTAMP '2024-01-16' THEN 'uncalibrated'
    WHEN channel IN ('in0', 'in1') AND time >= TIMESTAMP '2024-01-11' THEN 'skipped' ELSE 'written' END
  FROM good WHERE channel NOT IN ('in2', 'in7')) GROUP BY ALL""",
    "sensor_summary": f"{SUMMARY} SELECT * FROM summary",
    "silent_sensors": f"{SUMMARY} SELECT *, 'silent' AS state FROM summary WHERE readings = 0",
    "failure_report": f"""WITH lines AS ({_text(fx.BOARD_LINES_SQL)}), {_parsed('lines')}
SELECT reason, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, count(*) AS failures
FROM parsed WHERE reason IS NOT NULL GROUP BY reason""",
}

# --- measurements --------------------------------------------------------------------

_LONG = f"time, seq, sensor_id, {_shown('value')} AS value"

ORACLES |= {
    "time_range": f"""{FROM_STORE} SELECT {_LONG} FROM demo
WHERE time >= TIMESTAMP '2024-01-10' AND time <= TIMESTAMP '2024-01-12'""",
    "sensors_in": f"{FROM_STORE} SELECT {_LONG} FROM demo WHERE sensor_id IN ('broth', 'stirrer')",
    "sql_over_measurements": f"""{FROM_STORE} SELECT sensor_id, count(*) AS high FROM demo
WHERE measurement IN ('temperature', 'pressure') AND value > 200 GROUP BY 1""",
    "latest_value": f"""{FROM_STORE} SELECT time, seq, round(log10(value), 6) AS log_value
FROM points WHERE channel = 'in4' ORDER BY time DESC, seq DESC LIMIT 1""",
    "newest_rows": f"{FROM_STORE} SELECT {_LONG} FROM demo ORDER BY time DESC, seq DESC LIMIT 20",
    "latest_per_sensor": f"""{FROM_STORE} SELECT sensor_id, time, {_shown("value")} AS value, unit FROM demo
QUALIFY row_number() OVER (PARTITION BY sensor_id ORDER BY time DESC, seq DESC) = 1""",
    "list_measurements": f"{FROM_STORE} SELECT DISTINCT measurement FROM points",
    "sparkline": f"""{FROM_STORE}, s AS (SELECT sensor_id, {_slot("time", 21600)} AS step,
   avg(value) AS a, arg_max(value, (time, seq)) AS l FROM demo
   WHERE time BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31' GROUP BY ALL)
SELECT sensor_id, string_agg(CAST(CAST(round(a) AS BIGINT) AS VARCHAR), ' ' ORDER BY step) AS trace,
 {_shown("arg_max(l, step)")} AS last_value FROM s GROUP BY 1""",
    "inventory": f"""{FROM_STORE}, w AS ({_text(fx.PHYSICAL_SQL)}),
u AS (SELECT measurement, sensor_id, time, seq, value, unit, CASE WHEN channel <> 'in3' THEN v END AS input_volts,
        true AS calibrated FROM demo
      UNION ALL SELECT 'frequency', 'mock-wavemeter', time, seq, value + 276.5613e12, 'Hz', NULL, false
      FROM w WHERE value IS NOT NULL AND NOT isnan(value))
SELECT measurement, sensor_id, time, {_shown("value")} AS value, unit, round(input_volts, 6) AS input_volts,
 CASE WHEN calibrated THEN 'calibrated' ELSE 'simulated' END AS origin, calibrated,
 CASE measurement WHEN 'frequency' THEN format('{{:.6f}} THz', value / 1e12)
   WHEN 'pressure' THEN format('{{:.2e}}', value)
   ELSE format('{{:.4f}}', value) END AS reading FROM u
QUALIFY row_number() OVER (PARTITION BY measurement, sensor_id ORDER BY time DESC, seq DESC) = 1""",
    "detuning": """SELECT o_orderkey AS seq,
 round((276561300000000::DOUBLE + o_totalprice) - 276561300000000::DOUBLE, 1) AS detuning FROM orders""",
    "calibration_layer": f"""{FROM_STORE} SELECT time, seq, round(v, 6) AS input_volts,
 round(value, 6) AS value, unit, 'suffix:kPa' AS panel_unit FROM points WHERE channel = 'in0'""",
    "panel_units": f"""{FROM_STORE} SELECT unit, CASE unit WHEN 'K' THEN 'kelvin' WHEN 'V' THEN 'volt'
 WHEN 'Hz' THEN 'hertz' ELSE concat('suffix:', unit) END AS panel_unit,
 count(*) AS points FROM points GROUP BY ALL""",
    "series_wide": f"""{FROM_STORE} SELECT time,
 round(max(value) FILTER (sensor_id = 'broth'), 6) AS inside,
 round(max(value) FILTER (sensor_id = 'jacket'), 6) AS outside,
 round(max(value) FILTER (sensor_id = 'stirrer'), 6) AS speed FROM demo GROUP BY time""",
    "last_write_wins": f"""WITH good AS ({_text(fx.REWRITTEN_SQL)}), {POINTS}
SELECT measurement, time, sensor_id, {_shown("value")} AS value, seq FROM points
QUALIFY row_number() OVER (PARTITION BY measurement, sensor_id, time ORDER BY seq DESC) = 1""",
    "data_gaps": f"""{FROM_STORE}, g AS (SELECT sensor_id, time AS gap_end,
   lag(time) OVER (PARTITION BY sensor_id ORDER BY time, seq) AS gap_start FROM demo)
SELECT sensor_id, gap_start, gap_end, round((epoch_us(gap_end) - epoch_us(gap_start)) / 1e6, 3) AS gap_s
FROM g WHERE epoch_us(gap_end) - epoch_us(gap_start) > 7200000000""",
    "physical_readings": f"""WITH r AS ({_text(fx.PHYSICAL_SQL)}) SELECT 'power' AS measurement, time,
 sensor_id, nullif(unit, '') AS unit, value, seq, 'r1' AS rack FROM r
WHERE value IS NOT NULL AND NOT isnan(value)""",
    "several_fields": """SELECT l_orderkey * 10 + l_linenumber AS seq, l_shipdate AS time,
 'temperature' AS measurement, 'K' AS unit, l_quantity AS value FROM lineitem
UNION ALL SELECT l_orderkey * 10 + l_linenumber, l_shipdate, 'pressure', 'Pa', l_extendedprice FROM lineitem""",
    "burst_average": f"""WITH s AS ({_text(fx.SAMPLES_SQL)}),
a AS (SELECT *, lag(channel) OVER w IS DISTINCT FROM channel AS switched FROM s
      WINDOW w AS (PARTITION BY source ORDER BY time, seq)),
b AS (SELECT *, sum(switched::INT) OVER (PARTITION BY source ORDER BY time, seq) AS n FROM a),
c AS (SELECT *, first(time) OVER (PARTITION BY source, n ORDER BY time, seq) AS burst_start,
        first(seq) OVER (PARTITION BY source, n ORDER BY time, seq) AS burst_seq FROM b)
SELECT source, channel, burst_start, burst_seq,
 (epoch_us(time) - epoch_us(burst_start)) // 1800000000 AS window_no,
 round(avg(raw_count), 6) AS raw_count, count(*) AS samples
FROM c WHERE NOT switched GROUP BY ALL""",
}
for name, step, source in (
    ("downsample", 3600, f"{FROM_STORE}, src AS (SELECT * FROM demo)"),
    (
        "downsample_scale",
        30 * 86400,
        f"WITH good AS ({_text(fx.SCALE_SQL)}), {POINTS},"
        " src AS (SELECT * FROM points)",
    ),
):
    ORACLES[name] = f"""{source} SELECT sensor_id, {_slot("time", step)} AS step,
 {_shown("avg(value)", 4)} AS avg_value, {_shown("min(value)")} AS min_value, {_shown("max(value)")} AS max_value,
 count(*) AS readings, {_shown("arg_max(value, (time, seq))")} AS last_value FROM src GROUP BY 1, 2"""

_PAIRS = f"""{FROM_STORE}, pairs AS (SELECT {_slot("time", 7200)} AS step,
   arg_max(value, (time, seq)) FILTER (sensor_id = 'broth') AS x,
   arg_max(value, (time, seq)) FILTER (sensor_id = 'jacket') AS y
 FROM demo WHERE sensor_id IN ('broth', 'jacket') GROUP BY 1)"""
ORACLES |= {
    "xy_pairs": f"{_PAIRS} SELECT step, round(x, 6) AS x, round(y, 6) AS y FROM pairs"
    " WHERE x IS NOT NULL AND y IS NOT NULL",
    "latest_pair": f"{_PAIRS} SELECT step, round(x, 6) AS now_x, round(y, 6) AS now_y FROM pairs"
    " WHERE x IS NOT NULL AND y IS NOT NULL ORDER BY step DESC LIMIT 1",
}

# --- logs ------------------------------------------------------------------------------


def _field(key: str) -> str:
    return f"regexp_extract(line, '(?:^| ){key}=([^ \"]*)', 1)"


LOGS = f"""WITH records AS ({_text(fx.LOGS_SQL)}),
kept AS (
  SELECT *, CASE WHEN source = 'journal' THEN coalesce(nullif(systemd_user_unit, ''), systemd_unit) END AS unit_name
  FROM records),
labelled AS (
  SELECT ts, seq, line, substr(container_name, 2) AS container, unit_name AS unit,
    nullif(priority_keyword, '') AS stream_level, client_name AS host,
    CASE WHEN source = 'journal' THEN 'systemd-journal' END AS job,
    starts_with(line, 'plain') AS plain
  FROM kept WHERE source = 'docker' OR starts_with(unit_name, 'telemetry-')),
logs AS (
  SELECT *, coalesce(stream_level, nullif({_field("level")}, '')) AS level,
    nullif({_field("sensor_id")}, '') AS sensor_id, nullif({_field("logger")}, '') AS logger,
    nullif({_field("skipped")}, '') AS skipped,
    CASE WHEN contains(line, 'msg="wrote readings"') THEN 'wrote readings'
         WHEN contains(line, 'msg="said') THEN 'said "level=error" once' END AS msg
  FROM labelled),
sev AS (SELECT *, CASE WHEN level IN ('warn', 'warning') THEN 'warning'
  WHEN level IN ('error', 'critical', 'fatal') THEN 'error' ELSE level END AS severity FROM logs)"""
_WARN, _ERROR = "level IN ('warn', 'warning')", "level IN ('error', 'critical', 'fatal')"

ORACLES |= {
    "coverage_gaps": f"""{LOGS} SELECT name FROM (SELECT concat('c', unnest(range(0, 13))) AS name)
WHERE name <> 'c12' AND name NOT IN (SELECT container FROM logs WHERE container IS NOT NULL)""",
    "read_logs": f"WITH r AS ({_text(fx.LOGS_SQL)}) SELECT source, ts, seq, line, systemd_unit, client_name FROM r",
    "relabel": f"{LOGS} SELECT ts, seq, container, unit, stream_level, host, job FROM labelled",
    "parse_logfmt": f"""{LOGS} SELECT seq,
 CASE WHEN plain THEN 0 ELSE CASE WHEN msg = 'wrote readings' THEN 7 ELSE 5 END
   + CASE WHEN sensor_id IS NULL THEN 0 ELSE 1 END END AS pairs,
 nullif({_field("level")}, '') AS f_level, logger AS f_logger, msg AS f_msg,
 CASE WHEN msg LIKE 'said%' THEN '' END AS f_reason, nullif({_field("readings")}, '') AS f_readings,
 sensor_id AS f_sensor_id, skipped AS f_skipped, nullif({_field("ts")}, '') AS f_ts FROM sev""",
    "labelled_lines": f"{LOGS} SELECT seq, container, unit, level, severity, sensor_id FROM sev",
    "log_volume": f"{LOGS} SELECT {_slot('ts', 21600)} AS step, level, count(*) AS lines FROM sev GROUP BY ALL",
    "warning_count": f"{LOGS} SELECT count(*) AS warnings FROM sev WHERE {_WARN}",
    "error_count": f"{LOGS} SELECT count(*) AS errors FROM sev WHERE {_ERROR}",
    "threshold_status": f"""{LOGS}, n AS (SELECT count(*) AS lines FROM sev
  WHERE {_WARN} AND container IN ('c0', 'c1', 'c2', 'c3', 'c4'))
SELECT lines, CASE WHEN lines >= 1 THEN 'orange' ELSE 'green' END AS status FROM n
UNION ALL SELECT 0, 'green'""",
    "warn_and_error_lines": f"""{LOGS} SELECT ts, seq, level, line FROM sev WHERE {_WARN} OR {_ERROR}""",
    "container_lines": f"""{LOGS} SELECT container, count(*) AS lines FROM sev
WHERE container IS NOT NULL GROUP BY 1""",
    "skipped_by_sensor": f"""{LOGS} SELECT {_slot('ts', 21600)} AS step, sensor_id,
 sum(CAST(skipped AS DOUBLE)) AS skipped FROM sev WHERE msg = 'wrote readings' GROUP BY ALL""",
    "skipped_lines": f"{LOGS} SELECT seq, sensor_id FROM sev WHERE CAST(skipped AS INT) > 0",
    "label_values": f"{LOGS} SELECT DISTINCT sensor_id FROM sev WHERE sensor_id IS NOT NULL",
    "module_levels": f"""{LOGS}, k AS (SELECT logger, severity, CASE severity WHEN 'debug' THEN 10
   WHEN 'info' THEN 20 WHEN 'warning' THEN 30 WHEN 'error' THEN 40 END AS r,
   CASE logger WHEN 'store' THEN 40 WHEN 'store.wal' THEN 30 ELSE 20 END AS floor FROM sev)
SELECT logger, severity, count(*) AS lines FROM k WHERE r IS NULL OR r >= floor GROUP BY ALL""",
    "without_readings": f"""{LOGS} SELECT severity, count(*) AS lines FROM sev
WHERE severity IS DISTINCT FROM 'debug' GROUP BY ALL""",
    "retention": f"{LOGS} SELECT seq, ts FROM sev WHERE ts >= TIMESTAMP '2024-01-21'",
    "gap_context": f"""{LOGS}, r AS ({_text(fx.READINGS_SQL)}),
g AS (SELECT concat('s', channel[3:3]) AS sensor_id, time AS gap_end,
        lag(time) OVER (PARTITION BY channel ORDER BY time, seq) AS gap_start FROM r)
SELECT g.sensor_id, g.gap_start, l.seq, l.level FROM g JOIN sev l
 ON l.sensor_id = g.sensor_id AND l.ts >= g.gap_start AND l.ts <= g.gap_end
WHERE epoch_us(gap_end) - epoch_us(gap_start) > 7200000000 AND ({_WARN} OR {_ERROR})""",
    "logfmt_tokens": r"""SELECT doc_id, 2 AS pairs, true AS same,
 text = '' OR regexp_matches(text, '[ "=]|[\p{C}\p{Z}]') AS quoted, false AS broken FROM documents""",
}

ORACLES["module_rules"] = ORACLES["module_levels"]
ORACLES["downsample_rollup"] = ORACLES["downsample"]

# --- streams ---------------------------------------------------------------------------

ORACLES |= {
    "calibrated_points_stream": ORACLES["calibrated_points"],
    "recording_gate_stream": ORACLES["recording_gate"],
    "sensor_summary_stream": ORACLES["sensor_summary"],
    "recording_gate_late_stream": ORACLES["recording_gate"],
    # The walk up to the 20th, windows up to the last tick.
    "heartbeat_stream": SUMMARY.replace(
        "FROM points WHERE channel IN ('in2', 'in7'))",
        "FROM points WHERE channel IN ('in2', 'in7') AND time < TIMESTAMP '2024-01-20')",
    ).replace("FROM points WHERE channel NOT IN", "FROM points WHERE time < TIMESTAMP '2024-01-20' AND channel NOT IN")
    + " SELECT * FROM summary",
    "uncalibrated_channels_stream": f"""WITH {PARSED} SELECT channel, min(time) AS first_time,
 arg_min(seq, (time, seq)) AS first_seq FROM good WHERE channel > 'in7' GROUP BY channel""",
    "log_volume_stream": ORACLES["log_volume"],
    "skipped_by_sensor_stream": ORACLES["skipped_by_sensor"],
}
