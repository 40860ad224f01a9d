import random

import pytest
from helpers import at
from pyspark.sql import functions as F

from benchlight.functions.units import convert_units
from benchlight.operators import health, measure, rollup
from benchlight.operators.ordered import with_previous
from benchlight.schema import POINTS
from benchlight.sources import store
from benchlight.sources.physical import physical_readings, several_fields


def _points(spark, rows):
    """Rows of (sensor, seconds, value, seq)."""
    return spark.createDataFrame(
        [("m", at(t), s, "K", "id", v, None, {}, seq) for s, t, v, seq in rows], POINTS
    )


@pytest.mark.parametrize("split_rows", [10**6, 7, 2, 1])
def test_the_row_before_crosses_chunks(spark, split_rows):
    rng = random.Random(split_rows)
    rows, expected = [], {}
    for c in range(5):
        t, last = 0.0, None
        for i in range(200):
            t += rng.choice([0, 0, 0.001, 0.5, 2, 900, 4000, 100000])
            rows.append((f"k{c}", i, at(round(t, 3))))
            expected[f"k{c}", i] = last
            last = i
    df = spark.createDataFrame(rows, "k string, seq bigint, time timestamp")
    got = with_previous(df, ["k"], ["seq"], "before", split_rows).collect()
    assert len(got) == len(rows)
    assert {(r["k"], r["seq"]): r["before"] and r["before"]["seq"] for r in got} == expected


def test_the_last_write_wins(spark):
    rows = [("a", 0, 1.0, 1), ("a", 0, 2.0, 3), ("a", 0, 3.0, 2), ("a", 1, 4.0, 4), ("b", 0, 5.0, 5)]
    tagged = _points(spark, rows).unionByName(
        _points(spark, [("a", 0, 9.0, 9)]).withColumn("tags", F.create_map(F.lit("rack"), F.lit("1")))
    )
    got = measure.last_write_wins(tagged.unionByName(tagged)).orderBy("seq").collect()
    assert [(r["sensor_id"], r["value"]) for r in got] == [("a", 2.0), ("a", 4.0), ("b", 5.0), ("a", 9.0)]
    assert got[-1]["tags"] == {"rack": "1"}


@pytest.mark.parametrize("seqs", [(None, None), (5, 5)])
def test_columns_of_a_point_come_from_one_row(spark, seqs):
    """Rows whose seq says nothing about their order are still not mixed."""
    schema = "measurement string, time timestamp, sensor_id string, unit string, calibration_id string, value double, input_volts double, seq bigint"
    rows = [("m", at(0), "s", "K", "c", float(i), float(i), s) for i, s in enumerate(seqs)]
    found = measure.last_write_wins(spark.createDataFrame(rows, schema)).collect()
    assert len(found) == 1 and found[0]["value"] == found[0]["input_volts"] in (0.0, 1.0)


def test_dates_prune_folders(spark, tmp_path):
    from benchlight.sources import store

    rows = [("m", at(86400 * d), "s", "K", "c", 1.0, 2.0, {"a": "b"}, d) for d in range(4)]
    points = spark.createDataFrame(rows, POINTS_ORDER)
    store.write_points(points, f"{tmp_path}/p")
    found = store.scan_points(spark, f"{tmp_path}/p").filter("date = DATE'2024-01-02' AND measurement = 'm'")
    assert found.count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    partition = next(x for x in plan.split("PartitionFilters")[1:])
    assert "date" in partition.split("]")[0] and "measurement" in partition.split("]")[0]


POINTS_ORDER = (
    "measurement string, time timestamp, sensor_id string, unit string, calibration_id string,"
    "value double, input_volts double, tags map<string,string>, seq bigint"
)


def test_latest_and_ranges(spark):
    points = _points(spark, [("a", 0, 1.0, 1), ("a", 5, 2.0, 2), ("a", 5, 3.0, 3), ("b", 9, None, 4), ("b", 8, 7.0, 5)])
    assert measure.latest_value(points, "a").first()["value"] == 3.0
    latest = {r["sensor_id"]: r["value"] for r in measure.latest_per_sensor(points).collect()}
    assert latest == {"a": 3.0, "b": 7.0}
    assert [r["seq"] for r in measure.time_range(points, at(0), at(5)).collect()] == [1, 2, 3]
    assert measure.sensors_in(points, "b").count() == 2
    assert measure.step_for(0, 3601) == "4 seconds"


def test_gaps_and_traces(spark):
    points = _points(spark, [("a", t, float(t), t) for t in (0, 1, 100, 101, 7300, 7301)])
    gaps = measure.data_gaps(points, 50.0, split_rows=1).orderBy("gap_start").collect()
    assert [r["gap_s"] for r in gaps] == [99.0, 7199.0]
    trace = measure.sparkline(points, at(0), at(101), "10 seconds").first()
    assert trace["trace"] == [0.5, 100.5] and trace["last_value"] == 101.0


def test_pairs(spark):
    points = _points(spark, [("x", 0, 1.0, 1), ("x", 0.5, 2.0, 2), ("y", 0.1, 3.0, 3), ("y", 5, 4.0, 4)])
    pairs = measure.xy_pairs(points, "x", "y", "1 second")
    assert [(r["x"], r["y"]) for r in pairs.collect()] == [(2.0, 3.0)]
    assert measure.latest_pair(pairs).first()["now_x"] == 2.0


@pytest.mark.parametrize("split_rows", [10**6, 2])
def test_bursts_leave_out_the_first_sample(spark, split_rows):
    channels = "AAABBBBAAB"
    rows = [("b1", i, at(i * 0.01), c, float(i)) for i, c in enumerate(channels)]
    df = spark.createDataFrame(rows, "source string, seq bigint, time timestamp, channel string, raw_count double")
    got = measure.burst_average(df, window_us=20_000, split_rows=split_rows)
    rows = got.orderBy("burst_seq", "window_no").collect()
    assert [(r["channel"], r["window_no"], r["raw_count"], r["samples"]) for r in rows] == [
        ("A", 0, 1.0, 1), ("A", 1, 2.0, 1), ("B", 0, 4.0, 1), ("B", 1, 5.5, 2), ("A", 0, 8.0, 1),
    ]
    assert measure.mains_window_us(50, 2) == 40_000


def test_summary_has_silent_sensors_and_undeclared_ones(spark):
    outcomes = spark.createDataFrame(
        [(at(1), "cryo", True), (at(2), "cryo", True), (at(3), "room", True), (at(61), "odd", False)],
        "time timestamp, sensor_id string, written boolean",
    )
    declared = spark.createDataFrame([("cryo",), ("cryo",), ("off",)], "sensor_id string")
    clock = spark.createDataFrame([(at(0),), (at(95),)], "time timestamp")
    got = health.sensor_summary(outcomes, declared, clock, "30 seconds").collect()
    rows = {(r["sensor_id"], int(r["window_start"].timestamp()) % 3600): (r["readings"], r["skipped"]) for r in got}
    assert rows == {
        ("cryo", 0): (2, 0), ("cryo", 30): (0, 0), ("cryo", 60): (0, 0), ("cryo", 90): (0, 0),
        ("off", 0): (0, 0), ("off", 30): (0, 0), ("off", 60): (0, 0), ("off", 90): (0, 0),
        ("room", 0): (1, 0), ("odd", 60): (0, 1),
    }
    states = health.silent_sensors(health.sensor_summary(outcomes, declared, clock, "30 seconds"))
    assert {r["state"] for r in states.filter("sensor_id = 'odd'").collect()} == {"unwritable"}


def test_coverage_and_failures(spark):
    def names(*n):
        return spark.createDataFrame([(x,) for x in n], "name string")

    got = health.coverage_gaps(names("a", "b", "c", "d"), names("a"), names("d")).collect()
    assert sorted(r["name"] for r in got) == ["b", "c"]
    failures = spark.createDataFrame(
        [("p1", "x"), ("p2", "x"), ("p1", "x"), ("p3", "y")], "label string, reason string"
    )
    got = {r["reason"]: (r["labels"], r["failures"]) for r in health.failure_report(failures).collect()}
    assert got == {"x": (["p1", "p2"], 3), "y": (["p3"], 1)}


def test_physical_readings(spark):
    df = spark.createDataFrame(
        [(1, at(0.0004), 1.5, "K"), (2, at(1), None, "K"), (3, at(2), float("nan"), "K"), (4, at(3), 2.0, "")],
        "seq bigint, time timestamp, value double, u string",
    )
    got = physical_readings(df, F.lit("s"), F.lit("m"), F.col("u"), tags={"rack": F.lit(1), "no": F.lit(None)})
    rows = got.orderBy("seq").collect()
    assert [(r["seq"], r["unit"], r["tags"]) for r in rows] == [(1, "K", {"rack": "1"}), (4, None, {"rack": "1"})]
    named = physical_readings(df, F.lit("s"), F.lit("m"), field="kelvin")
    assert "kelvin" in named.columns and "value" not in named.columns


def test_one_read_of_several_quantities(spark):
    df = spark.createDataFrame([(1, 20.0, 1013.0)], "seq int, t double, p double")
    got = several_fields(df, {"t": ("temperature", "K"), "p": ("pressure", "mbar")}).collect()
    assert [(r["measurement"], r["unit"], r["value"]) for r in got] == [
        ("temperature", "K", 20.0), ("pressure", "mbar", 1013.0),
    ]


def test_units(spark):
    df = spark.createDataFrame(
        [(1, 1500.0, "mW"), (2, 2.0, "kilowatt"), (3, 1.0, "K"), (4, 1.0, "odd"), (5, 1.0, None)],
        "i int, value double, unit string",
    )
    rows = convert_units(df, "W").orderBy("i").collect()
    assert [(r["converted"], r["violation"]) for r in rows] == [
        (1.5, False), (2000.0, False), (None, True), (None, True), (None, True),
    ]
    minute = spark.createDataFrame([(1, 1.0, "min")], "i int, value double, unit string")
    assert convert_units(minute, "s").first()["converted"] == 60.0
    with pytest.raises(ValueError):
        convert_units(df, "furlong")


def test_store(spark, tmp_path):
    path, packed = str(tmp_path / "points"), str(tmp_path / "packed")
    store.write_points(_points(spark, [("a", 0, 1.0, 1), ("a", 90_000, 2.0, 2)]), path)
    store.write_points(_points(spark, [("a", 0, 3.0, 3)]), path)
    # A table that never had the conversion's columns.
    bare = _points(spark, [("w", 0, 5.0, 4)]).drop("calibration_id", "input_volts")
    store.write_points(bare.withColumn("measurement", F.lit("frequency")), path)
    points = store.scan_points(spark, path)
    assert sorted((r["sensor_id"], r["value"], r["calibration_id"]) for r in points.collect()) == [
        ("a", 2.0, "id"), ("a", 3.0, "id"), ("w", 5.0, None),
    ]
    assert [r[0] for r in store.list_measurements(points).collect()] == ["frequency", "m"]
    first_day = store.scan_measurement(spark, path, "m", end="2024-01-01")
    assert [r["value"] for r in first_day.collect()] == [3.0]
    plan = first_day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(measurement" in plan
    store.compact_points(spark, path, packed)
    assert spark.read.parquet(packed).count() == 3


def test_union_fills_missing_columns(spark):
    full = _points(spark, [("a", 0, 1.0, 1)])
    both = measure.union_measurements([full, full.drop("calibration_id")])
    assert sorted(str(r["calibration_id"]) for r in both.collect()) == ["None", "id"]
    wide = measure.series_wide(_points(spark, [("a", 0, 1.0, 1), ("b", 0, 2.0, 2)]), ["a", "b"])
    assert [(r["a"], r["b"]) for r in wide.collect()] == [(1.0, 2.0)]


def _files(path):
    return len(list(path.rglob("*.parquet")))


def test_compaction_in_place(spark, tmp_path):
    """Many small batches end in few files, with the same answer, whatever breaks off."""
    path = tmp_path / "points"
    for i in range(12):
        store.write_points(_points(spark, [("a", 0, float(i), i), ("b", i, float(i), i), ("a", i - 86400, 1.0, i)]), str(path))
    store.write_points(_points(spark, [("c", 5 * 86400, 7.0, 1)]).withColumn("note", F.lit("x")), str(path))
    key = lambda df: sorted(map(str, df.collect()))
    before = key(store.scan_points(spark, str(path)))
    kept = {f: f.read_bytes() for f in path.rglob("*.parquet")}
    assert _files(path) > 20
    assert store.compact_in_place(spark, str(path)) == 2
    assert _files(path) == 3 and key(store.scan_points(spark, str(path))) == before
    # The files read had not been deleted when it broke off: it is called again.
    for f, content in kept.items():
        f.write_bytes(content)
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    assert key(store.scan_points(spark, str(path))) == before
    assert store.compact_in_place(spark, str(path)) == 2
    assert _files(path) == 3 and key(store.scan_points(spark, str(path))) == before
    assert store.compact_in_place(spark, str(path)) == 0
    assert {r["note"] for r in store.scan_points(spark, str(path)).collect()} == {None, "x"}


def test_a_sensor_is_few_row_groups(spark, tmp_path):
    path = str(tmp_path / "points")
    many = spark.range(40_000).select(
        F.concat(F.lit("m"), F.col("id") % 1).alias("measurement"), F.timestamp_seconds(F.col("id") % 1000).alias("time"),
        F.concat(F.lit("s"), F.col("id") % 97).alias("sensor_id"), F.lit("K").alias("unit"),
        F.lit("id").alias("calibration_id"), F.rand(1).alias("value"), F.lit(1.0).alias("input_volts"),
        F.create_map().cast("map<string,string>").alias("tags"), F.col("id").alias("seq"),
    )
    store.write_points(many, path, **{"parquet.block.size": "65536"})
    import pyarrow.parquet as pq

    file = next((tmp_path / "points").rglob("*.parquet"))
    groups = pq.ParquetFile(file).metadata
    held = 0
    for i in range(groups.num_row_groups):
        of = next(c for c in map(groups.row_group(i).column, range(groups.num_columns)) if c.path_in_schema == "sensor_id")
        held += of.statistics.min <= "s50" <= of.statistics.max
    assert groups.num_row_groups > 8 and held <= 2
    one = store.scan_points(spark, path, resolve=False).filter("sensor_id = 's50'")
    assert "PushedFilters: [IsNotNull(sensor_id), EqualTo(sensor_id,s50)]" in one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == many.filter("sensor_id = 's50'").count()


def test_columns_of_two_kinds_are_refused(spark, tmp_path):
    path = str(tmp_path / "points")
    for value in (F.lit("x"), F.lit(1)):
        store.write_points(_points(spark, [("a", 0, 1.0, 1)]).withColumn("note", value), path)
    with pytest.raises(ValueError, match="note was written as"):
        store.scan_points(spark, path)


@pytest.mark.parametrize("step", ["1 minute", "30 minutes", "6 hours", "2 days"])
def test_rollups_say_what_points_say(spark, tmp_path, step):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randint(0, 5 * 86400), rng.random() * 100, i) for i in range(600)]
    path = str(tmp_path / "parts")
    for batch in (0, 1, 2, 1):  # one comes twice
        rollup.add_points(_points(spark, rows[batch::3]), path, batch)
    whole = measure.downsample(_points(spark, rows), step)
    start, end = at(86400), at(4 * 86400)
    for found, expected in (
        (rollup.downsample_rollup(spark, path, step), whole),
        (rollup.downsample_rollup(spark, path, step, start, end), whole.filter(F.col("step").between(start, end) & (F.col("step") < end))),
    ):
        got, wanted = ({(r["sensor_id"], r["step"]): r for r in x.collect()} for x in (found, expected))
        assert got.keys() == wanted.keys() and len(got) > 0
        for k, r in wanted.items():
            assert got[k]["avg_value"] == pytest.approx(r["avg_value"])
            assert all(got[k][c] == r[c] for c in ("min_value", "max_value", "readings", "last_value"))
    files = rollup.downsample_rollup(spark, path, step).inputFiles()
    assert {f"level={rollup.level_for(step)}" in f for f in files} == {True}
    with pytest.raises(ValueError, match="whole minutes"):
        rollup.level_for("90 seconds")
