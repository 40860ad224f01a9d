"""A stream of several batches must leave what one table would."""

import uuid

import pytest
from helpers import at
from pyspark.sql import functions as F

from benchlight import session
from benchlight.operators import calibrate as cal
from benchlight.operators import loglines
from benchlight.plans import fixtures as fx
from benchlight.plans import chain
from benchlight.sources import store, wire
from benchlight.streaming import stream


@pytest.fixture(scope="module")
def pieces(spark, small, tmp_path_factory):
    """The test lines as four files, in time order."""
    folder = tmp_path_factory.mktemp("lines")
    lines = fx.wire_lines(spark, small).withColumn("piece", F.ntile(4).over(_by_time()))
    for i in range(1, 5):
        part = lines.filter(F.col("piece") == i).drop("piece").coalesce(1)
        part.write.mode("append").parquet(str(folder))
    return str(folder)


def _by_time():
    from pyspark.sql import Window

    return Window.orderBy("time", "seq")


def _lines(spark, folder):
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _key(rows):
    return sorted(tuple(map(str, r)) for r in rows)


def test_gate(spark, small, pieces, tmp_path):
    table = fx.demo_calibrations(spark)
    conv, formulas = cal.conversions(table), cal.formula_texts(table)
    valued = stream.stream_calibrate(_lines(spark, pieces), conv, formulas, carry=["gate"])
    stream.stream_gate(valued, f"{tmp_path}/out", f"{tmp_path}/log", split_rows=3).awaitTermination()
    columns = ["channel", "seq", "was_recording", "admitted"]
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.select("batch").distinct().count() == 4
    whole = chain.gated_readings(fx.wire_lines(spark, small), conv, formulas)
    assert _key(got.select(columns).collect()) == _key(whole.select(columns).collect())


def test_points(spark, small, pieces, tmp_path):
    table = fx.demo_calibrations(spark)
    conv, formulas = cal.conversions(table), cal.formula_texts(table)
    for attempt in range(2):  # the second writes every point again
        valued = stream.stream_calibrate(_lines(spark, pieces), conv, formulas)
        points = cal.as_points(cal.drop_non_finite(valued))
        stream.stream_points_sink(points, f"{tmp_path}/points", f"{tmp_path}/log{attempt}").awaitTermination()
    stored = store.scan_points(spark, f"{tmp_path}/points")
    whole = cal.calibrate(wire.readings(wire.parse_wire(fx.wire_lines(spark, small))), conv, formulas)
    columns = ["measurement", "sensor_id", "time", "value", "seq"]
    assert _key(stored.select(columns).collect()) == _key(cal.drop_non_finite(whole).select(columns).collect())


def test_summary_follows_the_gate_and_counts_the_silent(spark, small, pieces, tmp_path, monkeypatch):
    monkeypatch.setattr(stream, "FOLD", 2)
    table = fx.demo_calibrations(spark)
    conv, formulas = cal.conversions(table), cal.formula_texts(table)
    stream.stream_summary(
        _lines(spark, pieces), conv, formulas, f"{tmp_path}/counts", f"{tmp_path}/log", "6 hours", split_rows=3
    ).awaitTermination()
    got = stream.current_summary(spark, f"{tmp_path}/counts", conv, "6 hours")
    whole = chain.summarise(fx.wire_lines(spark, small), table, "6 hours")
    columns = ["window_start", "sensor_id", "readings", "skipped", "window_s"]
    assert _key(got.select(columns).collect()) == _key(whole.select(columns).collect())
    assert got.filter("readings = 0").count() > 0
    assert stream.stream_summary(None, None, [], "", "", None) is None
    assert stream.stream_summary(None, None, [], "", "", "0 seconds") is None


@pytest.mark.parametrize("fold", [1, 2, 50])
def test_late_rows_are_counted(spark, tmp_path, monkeypatch, fold):
    """Batches in no order of time; the counts are those of the whole."""
    monkeypatch.setattr(stream, "FOLD", fold)
    schema = "ts timestamp, level string"
    times = [5000, 10, 9000, 20, 4990, 30, 86400, 1, 3]
    for t in times:
        spark.createDataFrame([(at(t), "info"), (at(t + 1), "warn")], schema).coalesce(1).write.mode("append").parquet(
            f"{tmp_path}/in"
        )
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    keys = ["step", "level"]
    count = lambda rows: loglines.log_volume(rows, "1 minute")
    stream.stream_counts(source, count, keys, f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination()
    got = stream.current_counts(spark, f"{tmp_path}/out", keys)
    whole = count(spark.read.schema(schema).parquet(f"{tmp_path}/in"))
    assert _key(got.select("step", "level", "lines").collect()) == _key(whole.collect())


@pytest.mark.parametrize("key", ["channel", "sensor_id"])
def test_warnings_are_given_once(spark, tmp_path, key):
    schema = f"seq bigint, time timestamp, {key} string"
    for batch in ([("n0", 0), ("n1", 1), ("n0", 2)], [("n1", 3), ("n2", 4)], [("n3", 5), ("n4", 6)], [("n4", 7)]):
        rows = [(t, at(t), c) for c, t in batch]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream.stream_warn_once(source, f"{tmp_path}/out", f"{tmp_path}/log", key).awaitTermination()
    got = stream.latest_version(spark, f"{tmp_path}/out")
    assert [(r[key], r["first_seq"]) for r in got.orderBy("first_seq").collect()] == [
        ("n0", 0), ("n1", 1), ("n2", 4), ("n3", 5), ("n4", 6)
    ]


def test_gaps_meet_the_lines_about_them(spark, tmp_path):
    logs = [(at(t), f"s{t % 2}", t) for t in range(0, 60, 5)]
    gaps = [("s1", at(10), at(30)), ("s0", at(40), at(45)), ("s2", at(0), at(99))]
    streams = []
    for name, rows, schema in (
        ("logs", logs, "ts timestamp, sensor_id string, seq int"),
        ("gaps", gaps, "sensor_id string, gap_start timestamp, gap_end timestamp"),
    ):
        for i in range(0, len(rows), 2):
            spark.createDataFrame(rows[i : i + 2], schema).coalesce(1).write.mode("append").parquet(
                f"{tmp_path}/{name}"
            )
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
        streams.append(source.parquet(f"{tmp_path}/{name}"))
    found = stream.stream_gap_context(streams[1], streams[0], "1 hour")
    query = (
        found.writeStream.format("parquet")
        .option("path", f"{tmp_path}/out")
        .option("checkpointLocation", f"{tmp_path}/log")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    got = spark.read.schema("sensor_id string, seq int").parquet(f"{tmp_path}/out").collect()
    assert sorted((r["sensor_id"], r["seq"]) for r in got) == [("s0", 40), ("s1", 15), ("s1", 25)]


@pytest.mark.parametrize("per_task", [10**6, 2])
def test_late_readings_are_judged_as_if_in_time(spark, small, tmp_path, monkeypatch, per_task):
    """Batches by hash, each spread over the whole month; a repeated batch changes nothing."""
    monkeypatch.setattr(stream, "CHUNKS_PER_TASK", per_task)
    table = fx.demo_calibrations(spark)
    conv, formulas = cal.conversions(table), cal.formula_texts(table)
    lines = fx.wire_lines(spark, small)
    for i in range(3):
        lines.filter(F.abs(F.xxhash64("seq")) % 3 == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    valued = stream.stream_calibrate(source, conv, formulas, carry=["gate"])
    stream.stream_gate_late(valued, f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination()
    columns = ["channel", "seq", "was_recording", "admitted"]
    whole = _key(chain.gated_readings(lines, conv, formulas).select(columns).collect())
    assert _key(stream.current_gate(spark, f"{tmp_path}/out").select(columns).collect()) == whole
    written = spark.read.parquet(f"{tmp_path}/out")
    assert written.select("batch").distinct().count() == 3 and written.count() > len(whole)
    # The commit of the last batch is lost: it comes once more.
    for name in ("2", ".2.crc"):
        (tmp_path / "log" / "commits" / name).unlink()
    stream.stream_gate_late(valued, f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination()
    assert _key(stream.current_gate(spark, f"{tmp_path}/out").select(columns).collect()) == whole


def test_heartbeat_of_silent_sensors(spark, tmp_path):
    """A clock that ticks while nothing else comes, running until it is stopped."""
    declared = spark.createDataFrame([("s1",), ("s2",), ("s1",)], "sensor_id string")
    query = stream.stream_heartbeat(
        stream.ticks(spark), declared, f"{tmp_path}/beats", f"{tmp_path}/log", "1 second", trigger="1 second"
    )
    query.processAllAvailable()
    deadline = 60
    while deadline and len(query.recentProgress) < 4:
        query.awaitTermination(1)
        deadline -= 1
    assert query.isActive
    query.stop()
    got = stream.current_counts(spark, f"{tmp_path}/beats", stream.SUMMARY_KEYS)
    rows = got.groupBy("sensor_id").agg(F.count("window_start").alias("n"), F.max("readings").alias("most")).collect()
    assert {r["sensor_id"] for r in rows} == {"s1", "s2"}
    assert len({r["n"] for r in rows}) == 1 and all(r["n"] > 0 and r["most"] == 0 for r in rows)


def test_batches_leave_no_intermediates(spark, small, tmp_path, monkeypatch):
    """Ten batches of each stream that settles tables: nothing stays but states and results."""
    monkeypatch.setattr(session, "shared_folder", lambda spark: f"{tmp_path}/scratch/{uuid.uuid4().hex}")
    table = fx.demo_calibrations(spark)
    with session.intermediates(spark):
        conv, formulas = cal.conversions(table), cal.formula_texts(table)
        kept = set((tmp_path / "scratch").iterdir())
        assert kept
        lines = fx.wire_lines(spark, small).limit(300).repartition(10, "seq")
        lines.write.parquet(f"{tmp_path}/in")
        for name, start in (
            ("gate", lambda v, *paths: stream.stream_gate(v, *paths)),
            ("late", lambda v, *paths: stream.stream_gate_late(v, *paths)),
        ):
            source = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            valued = stream.stream_calibrate(source, conv, formulas, carry=["gate"])
            query = start(valued, f"{tmp_path}/{name}", f"{tmp_path}/{name}-log")
            query.awaitTermination()
            assert len(list((tmp_path / name).glob("batch=*"))) == 10
            assert set((tmp_path / "scratch").iterdir()) == kept
    assert not list((tmp_path / "scratch").iterdir())
