"""Inputs derived from the read-only test tables.

The derivations are SQL that means the same to Spark and to DuckDB, so an oracle
starts from the same rows; the operators under test share nothing with it.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchlight.operators.calibrate import (
    as_points,
    calibrate,
    conversions,
    drop_non_finite,
    formula_texts,
)
from benchlight.schema import CALIBRATIONS, GATE_TYPE
from benchlight.session import literal_rows, settle, shared_folder
from benchlight.sources.logs import labelled_logs

# Wire lines out of `events`: mostly good, some malformed in every way text can be.
LINES_SQL = """
SELECT event_id AS seq, date_trunc('millisecond', ts) AS time,
 CASE event_id % 97
  WHEN 0 THEN 'in0;512'     WHEN 1 THEN 'in0,512,'    WHEN 2 THEN ' ,7'
  WHEN 3 THEN 'in/0,7'      WHEN 4 THEN 'in0,0x1F'    WHEN 5 THEN 'in0,-Infinity'
  WHEN 6 THEN '  '          WHEN 7 THEN 'in0,9e999'   WHEN 8 THEN 'in0,12e'
  ELSE concat('in', CAST(user_id % 9 AS STRING), ',',
              CAST(CAST(floor(least(value, 100) * 40.95) AS BIGINT) AS STRING)) END AS line
FROM events
"""

# The same, with the board each line came from.
BOARD_LINES_SQL = LINES_SQL.replace(
    "SELECT", "SELECT concat('board-', CAST(user_id % 11 AS STRING)) AS label,", 1
)

# The same readings already parsed, for questions asked of stored points.
READINGS_SQL = """
SELECT event_id AS seq, date_trunc('millisecond', ts) AS time,
       concat('in', CAST(user_id % 9 AS STRING)) AS channel,
       CAST(floor(least(value, 100) * 40.95) AS DOUBLE) AS raw_count
FROM events
"""

# The same, and every fiftieth reading again in its millisecond, written later.
REWRITTEN_SQL = """
SELECT event_id AS seq, date_trunc('millisecond', ts) AS time,
       concat('in', CAST(user_id % 9 AS STRING)) AS channel,
       CAST(floor(least(value, 100) * 40.95) AS DOUBLE) AS raw_count FROM events
UNION ALL
SELECT event_id + 1000000000, date_trunc('millisecond', ts),
       concat('in', CAST(user_id % 9 AS STRING)),
       CAST(floor(least(value, 100) * 40.95) AS DOUBLE) + 1 FROM events WHERE event_id % 50 = 0
"""

# The larger table as readings of nine channels.
SCALE_SQL = """
SELECT l_orderkey * 10 + l_linenumber AS seq, l_shipdate AS time,
       concat('in', CAST(l_suppkey % 9 AS STRING)) AS channel,
       CAST(CAST(floor(l_extendedprice) AS BIGINT) % 4096 AS DOUBLE) AS raw_count
FROM lineitem
"""
SCALE_LINES_SQL = """
SELECT l_orderkey * 10 + l_linenumber AS seq, l_shipdate AS time,
       concat('in', CAST(l_suppkey % 9 AS STRING), ',',
              CAST(CAST(floor(l_extendedprice) AS BIGINT) % 4096 AS STRING)) AS line
FROM lineitem
"""

# Log records out of `events`: containers, and journal units of three kinds.
LOGS_SQL = """
SELECT CASE WHEN event_id % 5 = 0 THEN 'journal' ELSE 'docker' END AS source,
       date_trunc('millisecond', ts) AS ts, event_id AS seq,
       CASE WHEN event_id % 89 = 0 THEN concat('plain text ', CAST(event_id AS STRING))
       ELSE concat('ts=', CAST(event_id AS STRING), ' level=',
         CASE event_type
           WHEN 'click' THEN 'debug'
           WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'warn' ELSE 'warning' END
           WHEN 'error' THEN CASE event_id % 3
             WHEN 0 THEN 'error' WHEN 1 THEN 'critical' ELSE 'fatal' END
           ELSE 'info' END,
         ' logger=', CASE event_id % 3 WHEN 0 THEN 'gate' WHEN 1 THEN 'store.wal' ELSE 'store' END,
         CASE WHEN event_id % 4 = 0
           THEN concat(' msg="wrote readings" readings=', CAST(user_id AS STRING),
                       CASE WHEN user_id % 5 = 0 THEN ''
                            ELSE concat(' sensor_id=s', CAST(user_id % 7 AS STRING)) END,
                       ' skipped=', CAST(event_id % 3 AS STRING), ' window_s=30')
           ELSE concat(' msg="said ', chr(92), '"level=error', chr(92), '" once" reason=""',
                       CASE WHEN user_id % 5 = 0 THEN ''
                            ELSE concat(' sensor_id=s', CAST(user_id % 7 AS STRING)) END)
         END) END AS line,
       CASE WHEN event_id % 5 <> 0 THEN concat('/c', CAST(user_id % 11 AS STRING)) END
         AS container_name,
       CASE WHEN event_id % 5 = 0 THEN CASE event_id % 3
         WHEN 0 THEN 'telemetry-sensor.service' WHEN 1 THEN 'user@1000.service'
         ELSE 'sshd.service' END END AS systemd_unit,
       CASE WHEN event_id % 5 = 0 AND event_id % 3 = 1
         THEN 'telemetry-bench.service' ELSE '' END AS systemd_user_unit,
       CASE WHEN event_id % 5 = 0 AND event_id % 2 = 0 THEN 'info' ELSE '' END
         AS priority_keyword,
       CASE WHEN user_id % 2 = 0 THEN 'bench-1' END AS client_name
FROM events
"""

# Readings already in physical units, out of `orders`: a tick without a value now
# and then, and an empty unit.
PHYSICAL_SQL = """
SELECT o_orderkey AS seq, o_orderdate AS time,
       concat('psu-', CAST(o_custkey % 5 AS STRING)) AS sensor_id,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL
            WHEN o_orderkey % 17 = 0 THEN CAST('NaN' AS DOUBLE)
            ELSE o_totalprice END AS value,
       CASE WHEN o_custkey % 5 = 0 THEN '' ELSE 'mW' END AS unit
FROM orders
"""

# Samples of boards that dwell on a channel for a few conversions, out of `events`.
SAMPLES_SQL = """
SELECT event_id AS seq, date_trunc('millisecond', ts) AS time,
       concat('board-', CAST(event_id % 2 AS STRING)) AS source,
       concat('in', CAST(CAST(floor(event_id / 12) AS BIGINT) % 4 AS STRING)) AS channel,
       CAST(floor(least(value, 100) * 40.95) AS DOUBLE) AS raw_count
FROM events
"""

# A calibration table as long as `part`: every mode, units spelled several ways, and
# broken rows of each kind.
CALIBRATIONS_SQL = """
SELECT concat('P', CAST(p_partkey AS STRING)) AS channel, p_size AS revision,
       CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS effective_from,
       CASE WHEN p_partkey % 31 = 1 THEN NULL
            ELSE concat('s', CAST(p_partkey AS STRING)) END AS sensor_id,
       CASE WHEN p_partkey % 31 = 2 THEN '' ELSE lower(p_type) END AS measurement,
       CASE WHEN p_partkey % 31 = 3 THEN 'cubic' WHEN p_partkey % 5 = 0 THEN NULL
            WHEN p_partkey % 5 = 1 THEN 'affine' WHEN p_partkey % 5 = 2 THEN 'piecewise_linear'
            WHEN p_partkey % 5 = 3 THEN 'spline' ELSE 'expression' END AS mode,
       CASE WHEN p_partkey % 31 = 4 THEN NULL ELSE p_retailprice END AS factor,
       CASE WHEN p_partkey % 31 = 5 THEN 'degC / V' WHEN p_size % 3 = 0 THEN 'mW / V'
            WHEN p_size % 3 = 1 THEN 'milliwatt/volt' ELSE 'W/V' END AS factor_unit,
       CAST(p_size AS DOUBLE) AS "offset",
       CASE WHEN p_partkey % 31 = 6 THEN 'K' ELSE 'W' END AS offset_unit,
       p_retailprice AS top, p_size AS steps,
       CASE WHEN p_partkey % 31 = 7 THEN 1 WHEN p_partkey % 31 = 8 THEN 2 ELSE 0 END AS bad_points,
       CASE WHEN p_partkey % 31 = 9 THEN NULL ELSE 'kelvin' END AS value_unit,
       CASE WHEN p_partkey % 31 = 10 THEN '1/(v-v)' WHEN p_partkey % 31 = 11 THEN 'w + 1'
            ELSE '10**(1.25*v - 8.5)' END AS formula,
       p_brand AS brand, p_partkey % 31 AS defect
FROM part
"""


STREAM_FILES = 4


def load(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Register the named tables as temporary views, times read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for name in names:
        _in_utc(spark.read.parquet(f"{sf_dir}/{name}.parquet")).createOrReplaceTempView(name)


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    load(spark, sf_dir, sql.rsplit("FROM", 1)[1].split()[0])
    return spark.sql(sql.replace('"offset"', "`offset`"))


def derive_stream(
    spark: SparkSession, sf_dir: str, sql: str, time: str = "time", ordered: bool = False
) -> DataFrame:
    """The same derivation as a stream of files, a third of the rows a batch.

    The thirds are by ``seq``, none in order of time, or with ``ordered`` thirds of the time
    one after the other. Each is ``STREAM_FILES`` files, written by as many tasks.
    """
    rows = settle(derive(spark, sf_dir, sql))
    folder = shared_folder(spark)
    at = F.unix_micros(time)
    first, last = rows.agg(F.min(at), F.max(at)).first()
    third = F.floor((at - F.lit(first)) * 3 / F.lit(last - first + 1)) if ordered else F.col("seq") % 3
    for i in range(3):
        # By key, so that a task has no rows of its own to deal out again if it is lost.
        part = rows.filter(third == i).repartition(STREAM_FILES, "seq")
        part.write.option("maxRecordsPerFile", 0).mode("append").parquet(f"{folder}/part={i}")
    files = [len(spark.read.parquet(f"{folder}/part={i}").inputFiles()) for i in range(3)]
    reader = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(files))
    return reader.parquet(f"{folder}/part=*")


def _in_utc(df: DataFrame) -> DataFrame:
    naive = [f.name for f in df.schema if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive})


def wire_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, LINES_SQL)


def event_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, READINGS_SQL)


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the demo channels, as a store would hand them out."""
    calibrations = demo_calibrations(spark)
    valued = calibrate(
        event_readings(spark, sf_dir), conversions(calibrations), formula_texts(calibrations)
    )
    return as_points(drop_non_finite(valued))


def demo_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_logs(log_records(spark, sf_dir))


def scale_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, SCALE_SQL)


def scale_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, SCALE_LINES_SQL)


def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, LOGS_SQL)


# A rate may not stay high: one bound, taken back in another unit of the same kind.
GATE_RATE = {
    "above": 24.0, "above_unit": "Hz", "resume_below": 0.012, "resume_below_unit": "kHz",
    "dwell": 50.0, "dwell_unit": "min", "raw_voltage": False,
}
# Two bounds on the voltage at the input, one of them with a margin for the way back.
GATE_SUPPLY = {
    "below": 150.0, "below_unit": "mV", "resume_above": 0.25, "resume_above_unit": "V",
    "above": 2.8, "above_unit": "V",
    "dwell": 1.5, "dwell_unit": "h", "raw_voltage": True,
}


def points(*pairs: tuple[float, float]) -> list[dict]:
    return [{"volts": volts, "value": value} for volts, value in pairs]


def demo_rows() -> list[dict]:
    """A fermenter's sensors: eight calibrated channels, two or so per mode; in8 has none.

    The measured points of the spline lie on a cubic, which the spline then is.
    """
    def channel(n: int, sensor_id: str, measurement: str, **conversion) -> dict:
        known = {"revision": 1, "effective_from": None, "provenance": {"by": "plant", "rig": str(n % 3)}}
        return known | {"channel": f"in{n}", "sensor_id": sensor_id, "measurement": measurement} | conversion

    cubic = [(v, 2 * v**3 - v**2 + 5 * v + 1) for v in (0.25, 0.75, 1.5, 2.25, 3.0)]
    return [
        channel(0, "head-space", "pressure", mode="piecewise_linear", value_unit="kPa",
                points=points((0.3, 90.0), (1.1, 130.0), (2.4, 260.0))),
        channel(1, "vessel-weight", "force", mode="spline", value_unit="newton", points=points(*cubic)),
        channel(2, "stirrer", "rate", factor=12.5, factor_unit="Hz / volt", gate=GATE_RATE),
        channel(3, "stirrer-magnet", "field", mode="affine", factor=0.8, factor_unit="tesla / volt",
                offset=-1300.0, offset_unit="mT", store_input=False),
        channel(4, "electrode", "current", mode="expression", formula="2.5e-9 * exp(3*v)", value_unit="ampere"),
        channel(5, "broth", "temperature", mode="affine", factor=20.0, factor_unit="K/V", offset=268.0,
                offset_unit="kelvin"),
        channel(6, "jacket", "temperature", mode="piecewise_linear", value_unit="K",
                points=points((2.8, 270.0), (0.6, 330.0))),
        channel(7, "supply", "voltage", factor=7.5, gate=GATE_SUPPLY),
    ]


def calibrations(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Calibration rows as a table; keys left out are NULL."""
    return literal_rows(spark, rows, CALIBRATIONS)


def demo_calibrations(spark: SparkSession) -> DataFrame:
    return calibrations(spark, demo_rows())


def revised_calibrations(spark: SparkSession) -> DataFrame:
    """The demo channels, the stirrer's speed and magnet corrected mid-month."""
    rows = demo_rows()
    later = {"revision": 2, "effective_from": datetime(2024, 1, 16)}
    extra = [
        row | later | {"factor": row["factor"] * 1.1}
        for row in rows
        if row["channel"] in ("in2", "in3")
    ]
    return calibrations(spark, rows + extra)


def part_calibrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many calibrations as there are parts, some of them broken."""
    derived = derive(spark, sf_dir, CALIBRATIONS_SQL)
    point = "struct<volts:double,value:double>"
    # Rising or falling by parity of `steps`; defects: one point, or a repeated voltage.
    points = F.expr(
        f"""
        CASE WHEN bad_points = 1 THEN array(cast(struct(1D, top) as {point}))
             WHEN bad_points = 2 THEN array(cast(struct(1D, top) as {point}),
                                            cast(struct(1D, top + 1) as {point}))
             WHEN steps % 2 = 0 THEN
               transform(sequence(1, 5), i -> cast(struct(0.5D * i, top + i * i) as {point}))
             ELSE transform(sequence(1, 5),
               i -> cast(struct(3D - 0.5D * i, top + i * i) as {point})) END
        """
    )
    gate = F.expr(
        f"""
        CASE WHEN defect NOT BETWEEN 12 AND 20 THEN CAST(NULL AS {GATE_TYPE}) ELSE
        CAST(named_struct(
          'below', IF(defect IN (12, 13), NULL, 1D), 'below_unit', 'V',
          'above', IF(defect = 12, NULL, 3D),
          'above_unit', IF(defect = 14, 'K', 'V'),
          'resume_above', CASE WHEN defect = 13 THEN 2D WHEN defect = 15 THEN 0.5D
                               WHEN defect = 16 THEN 3.5D END,
          'resume_above_unit', 'V',
          'resume_below', CASE WHEN defect = 17 THEN 3.2D WHEN defect = 18 THEN 2900D END,
          'resume_below_unit', IF(defect = 18, 'mV', 'V'),
          'dwell', 1D, 'dwell_unit', IF(defect = 19, 'm', 'min'),
          'raw_voltage', true) AS {GATE_TYPE}) END
        """
    )
    return derived.select(
        "channel",
        "revision",
        "effective_from",
        "sensor_id",
        "measurement",
        "mode",
        "factor",
        "factor_unit",
        "offset",
        "offset_unit",
        points.alias("points"),
        "value_unit",
        "formula",
        F.lit(None).cast("boolean").alias("store_input"),
        F.when(
            F.col("steps") % 4 != 0,
            F.create_map(F.lit("operator"), F.lit("lab"), F.lit("reference"), F.col("brand")),
        ).alias("provenance"),
        gate.alias("gate"),
    )
