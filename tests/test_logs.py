import pytest
from helpers import at
from pyspark.sql import functions as F

from benchlight.functions.text import (
    format_reading,
    logfmt_fields,
    logfmt_token,
    panel_unit,
    to_logfmt,
)
from benchlight.operators import loglines
from benchlight.schema import LOG_RECORDS
from benchlight.sources.logs import labelled_logs, read_logs

# By the rule: a value stands bare unless it is empty or holds a quote, an equals sign,
# white space, or something that doesn't print; inside quotes those are escaped.
BARE = ["stage-4", "a,b;c", "C:\\lab", "37.5%", "Größe", "45µm²", "π≈3", "🧪🔬"]
NAMED = {"\n": "\\n", "\r": "\\r", "\t": "\\t", '"': '\\"', "\\": "\\\\"}
UNPRINTED = ["\x01", "\x1f", "\x7f", "\x9b", "\xad", "\u200b", "\u2066", "\ufeff", "\U000e0020", "\u3000"]


def _escaped(text: str) -> str:
    out = []
    for c in text:
        if c in NAMED:
            out.append(NAMED[c])
        elif c == " " or c.isprintable():
            out.append(c)
        else:
            n = ord(c)
            out.append(f"\\x{n:02x}" if n < 256 else f"\\u{n:04x}" if n < 65536 else f"\\U{n:08x}")
    return '"' + "".join(out) + '"'


TOKENS = [(t, t) for t in BARE] + [
    (t, _escaped(t))
    for t in (
        "",
        "gate open",
        "k=v",
        *[f"up{c}down" for c in (*NAMED, *UNPRINTED) if c != "\\"],
        'a \\ and a "b"\r\n\tend',
        "".join(UNPRINTED),
    )
]


def test_tokens_and_back(spark):
    df = spark.createDataFrame([(i, t[0]) for i, t in enumerate(TOKENS)], "i int, v string")
    df = df.withColumn("token", logfmt_token(F.col("v")))
    line = F.concat(F.lit("level=info v="), "token", F.lit(" last=1"))
    rows = df.withColumn("fields", logfmt_fields(line)).orderBy("i").collect()
    assert [r["token"] for r in rows] == [t[1] for t in TOKENS]
    assert [r["fields"] for r in rows] == [
        {"level": "info", "v": t[0], "last": "1"} for t in TOKENS
    ]


def test_long_values_are_read_whole(spark):
    text = 'x "quoted" \\ ' * 20_000
    df = spark.createDataFrame([(text,)], "v string")
    line = F.concat(F.lit("a=1 msg="), logfmt_token(F.col("v")), F.lit(" b=2"))
    assert df.select(logfmt_fields(line).alias("f")).first()["f"] == {"a": "1", "msg": text, "b": "2"}


@pytest.mark.parametrize(
    ("line", "fields"),
    [
        ("plain text without pairs", {}),
        ("", {}),
        ('level=info msg="a b=c" x=', {"level": "info", "msg": "a b=c", "x": ""}),
        ("a=1 a=2", {"a": "1"}),
        ('msg="said \\"level=error\\" once" level=info', {"msg": 'said "level=error" once', "level": "info"}),
        ("words then level=warn", {"level": "warn"}),
    ],
)
def test_lines(spark, line, fields):
    assert spark.range(1).select(logfmt_fields(F.lit(line)).alias("f")).first()["f"] == fields


def test_a_line_has_its_head_then_sorted_extras(spark):
    df = spark.createDataFrame([(7, None)], "readings int, gone string")
    line = to_logfmt(
        {"ts": F.lit("t"), "level": F.lit("info"), "msg": F.lit("wrote readings")},
        {"window_s": F.lit(30), "readings": F.col("readings"), "gone": F.col("gone")},
    )
    assert df.select(line.alias("l")).first()["l"] == 'ts=t level=info msg="wrote readings" readings=7 window_s=30'


@pytest.fixture(scope="module")
def found(spark):
    rows = [
        ("docker", at(0), 0, 'level=info msg="wrote readings" sensor_id=s1 skipped=2', "/c1", None, None, None, None),
        ("docker", at(1), 1, "level=warn sensor_id= msg=x", "/c1", None, None, None, "client"),
        ("docker", at(2), 2, "plain", "c2", None, None, None, None),
        ("docker", at(3), 3, "level=WARNING logger=store.wal", "/c3", None, None, None, None),
        ("journal", at(4), 4, "level=error", None, "telemetry-a.service", "", "info", None),
        ("journal", at(5), 5, "level=fatal", None, "user@1000.service", "telemetry-b.service", "", None),
        ("journal", at(6), 6, "level=fatal", None, "sshd.service", "", "", None),
        ("docker", at(40), 7, 'level=info msg="wrote readings" sensor_id=s1 skipped=x', "/c1", None, None, None, None),
        ("docker", at(40), 8, 'level=debug msg="wrote readings" sensor_id=s1 skipped=3', "/c1", None, None, None, None),
    ]
    return labelled_logs(spark.createDataFrame(rows, LOG_RECORDS))


def test_labels(found):
    rows = {r["seq"]: r for r in found.collect()}
    assert 6 not in rows
    assert [rows[i]["container"] for i in (0, 2, 4)] == ["c1", None, None]
    assert rows[1]["sensor_id"] is None and rows[0]["sensor_id"] == "s1"
    assert rows[5]["unit"] == "telemetry-b.service" and rows[5]["job"] == "systemd-journal"
    assert rows[4]["level"] == "info" and rows[5]["severity"] == "error"
    assert rows[3]["severity"] == "warning" and rows[2]["level"] is None
    assert rows[1]["host"] == "client" and rows[0]["host"] is None


def test_counts(found):
    assert loglines.warning_count(found).first()["warnings"] == 1
    assert loglines.error_count(found).first()["errors"] == 1
    assert loglines.error_count(found.filter("seq < 0")).first()["errors"] == 0
    skipped = loglines.skipped_by_sensor(found, "30 seconds").orderBy("step").collect()
    assert [r["skipped"] for r in skipped] == [2.0, 3.0]
    volume = loglines.log_volume(found, "30 seconds").filter("level IS NULL").collect()
    assert [r["lines"] for r in volume] == [1]
    status = loglines.threshold_status(loglines.error_count(found), "errors", loglines.ERROR_STEPS)
    assert status.first()["status"] == "red"


def test_filters(found):
    assert found.filter(loglines.label_matches("container", "c1|c3")).count() == 5
    assert found.filter(loglines.label_matches("container", ".+")).count() == 5
    assert found.filter(loglines.field_number("skipped") > 2).count() == 1
    assert loglines.newest_lines(found, 2).select("seq").collect()[0][0] == 8
    named = found.withColumn("logger", F.col("fields")["logger"])
    kept = loglines.module_level_filter(named, {"store": "error", "store.wal": "warning"})
    assert 3 in [r["seq"] for r in kept.collect()]
    assert 8 not in [r["seq"] for r in loglines.at_least(found).collect()]


def test_retention_is_by_whole_days(spark, found):
    now = F.lit("2024-01-02 00:00:10").cast("timestamp")
    assert loglines.apply_retention(found, now, 24).count() == 8
    assert loglines.apply_retention(found, F.lit("2024-01-03 00:00:00").cast("timestamp"), 24).count() == 0
    with pytest.raises(ValueError, match="24 hours"):
        loglines.apply_retention(found, now, 23)


def test_gap_context(spark, found):
    gaps = spark.createDataFrame(
        [("s1", at(30), at(50)), ("s1", at(60), None), ("s2", at(0), at(99))],
        "sensor_id string, gap_start timestamp, gap_end timestamp",
    )
    got = loglines.gap_context(gaps, found.select("sensor_id", "ts", "seq"))
    assert sorted(r["seq"] for r in got.collect()) == [7, 8]


def test_records_from_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '{"source":"docker","ts":"2024-01-01T00:00:00Z","seq":1,"line":"level=info","container_name":"/x"}\n'
    )
    row = labelled_logs(read_logs(spark, str(tmp_path))).first()
    assert (row["container"], row["level"]) == ("x", "info")


def test_display(spark):
    df = spark.createDataFrame(
        [("frequency", 276.5613e12, "Hz"), ("pressure", 9.91e-10, "mbar"), ("power", 1.5, "furlong")],
        "m string, v double, u string",
    )
    got = df.select(format_reading(F.col("m"), F.col("v")), panel_unit(F.col("u"))).collect()
    assert [tuple(r) for r in got] == [
        ("276.561300 THz", "hertz"), ("9.91e-10", "pressurembar"), ("1.5000", "suffix:furlong"),
    ]


def test_rules_of_a_table_are_those_of_a_mapping(spark):
    """Ten thousand rules meet the lines in one join; the longest prefix decides."""
    names = [None, "", "a", "ab", "ab.c", "abc", "b.x", "module.77", "module.778", "zz"]
    lines = [(n, s, i) for i, (n, s) in enumerate((n, s) for n in names for s in ("debug", "info", "warning", "error", None))]
    logs = spark.createDataFrame(lines, "logger string, severity string, seq int")
    few = {"a": "debug", "ab": "error", "ab.": "warning", "z": "error"}
    many = {f"module.{i}": "warning" for i in range(10_000)}
    rules = spark.createDataFrame(list((few | many).items()), "prefix string, level string")
    kept = loglines.module_rules_filter(logs, rules)
    assert kept.columns == logs.columns
    wanted = loglines.module_level_filter(logs, few | {"module.77": "warning", "module.778": "warning"})
    assert sorted(r["seq"] for r in kept.collect()) == sorted(r["seq"] for r in wanted.collect())
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 1
