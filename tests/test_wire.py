import pytest

from benchlight.schema import REASONS
from benchlight.sources.wire import parse_wire, quarantine, read_wire, readings

UTF8, SHAPE, EMPTY, NAME, NUMBER, FINITE = REASONS

# Each part of a line in its good and bad forms; a line is every combination of them.
NAMES = {"in0": True, "p-7.b_Q": True, "0": True, "N" * 32: True, "N" * 40: NAME, "two words": NAME, "a/b": NAME,
         "é1": NAME, "tab\there": NAME, "bell\x07": NAME, "": EMPTY, " ": EMPTY}
COUNTS = {"0": 0.0, "731": 731.0, "+12.50": 12.5, "7.": 7.0, "-.25e2": -25.0, "6E-1": 0.6, "12_345.6_7": 12345.67,
          "": NUMBER, "0b11": NUMBER, "7_": NUMBER, "_7": NUMBER, "3__3": NUMBER, "1.2.3": NUMBER, "e5": NUMBER,
          "12f": NUMBER, "٣": NUMBER, "NaN": FINITE, "+inf": FINITE, "-iNfInItY": FINITE, "8e999": FINITE}
SPACES = [("", ""), (" ", "\t"), ("\u2003", "\r")]


def _expected(name, count):
    """The name is tested before the count."""
    if NAMES[name] is not True:
        return None, None, NAMES[name]
    return (name, COUNTS[count], None) if isinstance(COUNTS[count], float) else (None, None, COUNTS[count])


CASES = [
    (f"{before}{name}{after},{before}{count}{after}", _expected(name, count))
    for name in NAMES
    for count in COUNTS
    for before, after in SPACES
]
CASES += [(blank, (None, None, None)) for blank in ("", "\r", "\u00a0 \x1f")]
CASES += [(line, (None, None, SHAPE)) for line in ("in0", "in0;1", "in0,1,", ",,", "in0,1,2,3", "-")]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(i, line) for i, (line, _) in enumerate(CASES)]
    df = parse_wire(spark.createDataFrame(rows, "seq bigint, line string"))
    return {r["seq"]: (r["channel"], r["raw_count"], r["reason"]) for r in df.collect()}


def test_lines(parsed):
    for i, (line, expected) in enumerate(CASES):
        assert parsed[i] == expected, repr(line)


def test_files_keep_bytes_and_lone_returns(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"A0,1\r\nA1,2\n\xff\xfe,3\nA2,4\rA3,5\n\nA4,6")
    lines = read_wire(spark, str(tmp_path))
    places = [(r["time"], r["seq"]) for r in lines.collect()]
    assert len(set(places)) == len({t for t, _ in places}) == len(places)
    assert places == [(r["time"], r["seq"]) for r in read_wire(spark, str(tmp_path)).collect()]
    parsed = parse_wire(lines)
    good = readings(parsed).orderBy("seq").collect()
    assert [(r["channel"], r["raw_count"]) for r in good] == [("A0", 1.0), ("A1", 2.0), ("A4", 6.0)]
    assert all(r["time"].microsecond % 1000 == 0 for r in good)
    bad = quarantine(parsed).orderBy("seq").collect()
    assert [r["reason"] for r in bad] == [UTF8, SHAPE]


def test_files_are_numbered_over_their_splits(spark, tmp_path):
    """A file of many splits, and small ones: places follow the lines, stamped or not."""
    lines = [f"in{i % 3},{i}" for i in range(20_000)]
    (tmp_path / "big.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "small.txt").write_text("in0,1\n\nin0,2")
    held = {"spark.sql.files.maxPartitionBytes": "8k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        for stamped in (False, True):
            read = read_wire(spark, str(tmp_path), stamped=stamped).orderBy("seq")
            rows = [(r["seq"], r["line"]) for r in read.collect()]  # without a tab nothing is cut off
            assert rows == [(r["seq"], r["line"]) for r in read_wire(spark, str(tmp_path), stamped=stamped).orderBy("seq").collect()]
            files = {}
            for seq, line in rows:
                files.setdefault(seq >> 34, []).append((seq & (2**34 - 1), line))
            assert sorted(files.values(), key=len) == [
                list(enumerate(["in0,1", "", "in0,2"])), list(enumerate(lines))
            ]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
