"""Names and types shared by every job.

The stored field and tag names are fixed: renaming one would split the history
in two, since rows already written keep the old name.
"""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------
VALUE = "value"
INPUT_VOLTS = "input_volts"
CALIBRATION_ID = "calibration_id"
SENSOR_ID = "sensor_id"

ADC_BITS = 12
ADC_VREF = 3.3
PROBE_VOLTS = (1.0, 0.5, 2.0)
CALIBRATION_ID_LENGTH = 8
RETENTION_HOURS = 720
SUMMARY_WINDOW = "30 seconds"
CARRIER_HZ = 276.5613e12

MODES = ("linear", "affine", "spline", "piecewise_linear", "expression")

# Reasons a wire line is refused, in the order they are tested.
REASONS = (
    "not valid UTF-8",
    "expected '<channel>,<count>'",
    "empty channel",
    "channel name has a disallowed character or length",
    "count is not a number",
    "count is not finite",
)

WARN_LEVELS = ("warn", "warning")
ERROR_LEVELS = ("error", "critical", "fatal")

# --- types ------------------------------------------------------------------
GATE_TYPE = (
    "struct<below:double,below_unit:string,above:double,above_unit:string,"
    "resume_above:double,resume_above_unit:string,"
    "resume_below:double,resume_below_unit:string,"
    "dwell:double,dwell_unit:string,raw_voltage:boolean>"
)

CALIBRATIONS = (
    "channel string, revision int, effective_from timestamp, "
    "sensor_id string, measurement string, mode string, "
    "factor double, factor_unit string, offset double, offset_unit string, "
    "points array<struct<volts:double,value:double>>, value_unit string, "
    "formula string, store_input boolean, provenance map<string,string>, "
    f"gate {GATE_TYPE}"
)

POINTS = (
    "measurement string, time timestamp, sensor_id string, unit string, "
    "calibration_id string, value double, input_volts double, "
    "tags map<string,string>, seq bigint"
)

LOG_RECORDS = (
    "source string, ts timestamp, seq bigint, line string, container_name string, "
    "systemd_unit string, systemd_user_unit string, priority_keyword string, "
    "client_name string"
)
