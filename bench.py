"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the cores. Each
query is run once to warm up and then timed, from building the plan to the last row.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from benchlight.operators import calibrate as cal  # noqa: E402
from benchlight.operators import gate, loglines, measure  # noqa: E402
from benchlight.plans import fixtures as fx  # noqa: E402
from benchlight.plans import chain  # noqa: E402
from benchlight.session import local_session  # noqa: E402
from benchlight.sources import wire  # noqa: E402


def _calibrated(spark, sf):
    table = fx.demo_calibrations(spark)
    readings = fx.scale_readings(spark, sf)
    return cal.calibrate(readings, cal.conversions(table), cal.formula_texts(table))


def _points(spark, sf):
    return cal.as_points(cal.drop_non_finite(_calibrated(spark, sf)))


def parse(spark, sf):
    return wire.readings(wire.parse_wire(fx.scale_lines(spark, sf)))


def summary(spark, sf):
    """Lines to the per-sensor summary: parse, calibrate, gate, count."""
    return chain.summarise(fx.scale_lines(spark, sf), fx.demo_calibrations(spark), "30 days")


def chain_points(spark, sf):
    """Lines to the points a store keeps."""
    return chain.gated_points(fx.scale_lines(spark, sf), fx.demo_calibrations(spark))


def recording_gaps(spark, sf):
    table = fx.demo_calibrations(spark)
    conv = cal.conversions(table)
    gated = chain.gated_readings(fx.scale_lines(spark, sf), conv, cal.formula_texts(table))
    return gate.recording_gaps(gate.gate_transitions(gated, conv))


def last_write_wins(spark, sf):
    return measure.last_write_wins(_points(spark, sf))


def downsample(spark, sf):
    return measure.downsample(_points(spark, sf), "30 days")


def latest_per_sensor(spark, sf):
    return measure.latest_per_sensor(_points(spark, sf))


def data_gaps(spark, sf):
    return measure.data_gaps(_points(spark, sf), 86_400.0)


def log_volume(spark, sf):
    return loglines.log_volume(fx.demo_logs(spark, sf), "1 hour")


def skipped_by_sensor(spark, sf):
    return loglines.skipped_by_sensor(fx.demo_logs(spark, sf), "1 hour")


BENCH = {
    "parse": parse,
    "calibrate": _calibrated,
    "chain": summary,
    "chain_points": chain_points,
    "recording_gaps": recording_gaps,
    "last_write_wins": last_write_wins,
    "downsample": downsample,
    "latest_per_sensor": latest_per_sensor,
    "data_gaps": data_gaps,
    "log_volume": log_volume,
    "skipped_by_sensor": skipped_by_sensor,
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, app="bench")
    lines = fx.scale_lines(spark, sf_dir).agg(F.count("line")).first()[0]
    times = {}
    for name, query in BENCH.items():
        for _ in range(2):
            started = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cores": cores,
                "lines": lines,
                "lines_per_second": round(lines / times["chain"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
