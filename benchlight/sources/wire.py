"""Lines off the wire: ``<channel>,<count>``, one reading each.

All of it is column expressions, so it serves a static or a streaming frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from benchlight.functions.staged import staged
from benchlight.schema import REASONS
from benchlight.session import hold_splits

# --- fixed values -----------------------------------------------------------
_NAME = r"[A-Za-z0-9_.-]{1,32}"
_DIGITS = r"[0-9](?:_?[0-9])*+"
NUMBER = rf"[+-]?(?:{_DIGITS}(?:[.](?:{_DIGITS})?)?|[.]{_DIGITS})(?:[eE][+-]?{_DIGITS})?"
_NON_FINITE = r"(?i)^[+-]?(?:nan|inf|infinity)\z"
# Everything Unicode counts as white space, plus the four ASCII separators.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_SPACE = f"[{WHITE_SPACE}]*+"
# A whole line holding a reading, as boards write it and in general; the group is
# the count.
_PLAIN = rf"^{_NAME},([0-9]++(?:[.][0-9]++)?+)\r?\z"
_READING = rf"^{_SPACE}{_NAME}{_SPACE},{_SPACE}({NUMBER}){_SPACE}\z"


# Of a line's ``seq``: bits of its place in its file, and of a hash of the file's path.
PLACE_BITS = 34
FILE_BITS = 29


def read_wire(
    spark: SparkSession, path: str, streaming: bool = False, stamped: bool = False
) -> DataFrame:
    """``time``, ``seq`` and ``line`` of text files, as a table or as a stream.

    A file is what arrived at once: its lines bear the time it was written, a
    millisecond further from line to line, as one channel can't be read faster. With
    ``stamped`` every line begins with its own time, ISO 8601, and a tab. ``seq`` is a hash
    of the file's path and the line's place in the file, so it follows the order of lines;
    two files of one hash matter only if their lines bear the same times too. A second read
    gives the same.

    As a table, files may be of any size: tasks read splits of them, lines are counted by
    split, and sums of these counts tell each split's lines their places. In a stream a
    file is one arrival and taken whole by a task.

    Only LF ends a line: a lone CR stays inside its (malformed) line. Bytes that are no
    UTF-8 stay as they are, for ``parse_wire`` to refuse.
    """
    lines = _arrivals(spark, path) if streaming else _placed(spark, path)
    file = F.xxhash64("file").bitwiseAND(F.lit((1 << FILE_BITS) - 1))
    seq = (F.shiftleft(file, PLACE_BITS) + F.col("place")).alias("seq")
    if stamped:
        time = F.date_trunc("millisecond", F.substring_index("value", "\t", 1).try_cast("timestamp"))
        return lines.select(time.alias("time"), seq, F.expr("substring(value, locate('\t', value) + 1)").alias("line"))
    millisecond = F.floor(F.unix_micros("written") / 1000) + F.col("place")
    return lines.select(F.timestamp_millis(millisecond).alias("time"), seq, F.col("value").alias("line"))


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``written``, ``place`` and ``value`` of the lines of files, read by splits.

    Numbers ascend along a split, wherever it is read, so a line's number less that of its
    split's first line is its place there.
    """
    hold_splits(spark)
    lines = (
        spark.read.option("lineSep", "\n")
        .text(path)
        .select(
            "value",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.col("_metadata.file_modification_time").alias("written"),
        )
        .withColumn("at", F.monotonically_increasing_id())
    )
    # One row per split; a file's are few.
    splits = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")
    shifts = splits.select("file", "block", shift.alias("shift"))
    return lines.join(shifts, ["file", "block"]).withColumn("place", F.col("at") + F.col("shift"))


def _arrivals(spark: SparkSession, path: str) -> DataFrame:
    """The same of a stream of files, each taken whole."""
    # One character per byte while lines are cut apart, whatever the bytes are.
    text = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    files = spark.readStream.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_modification_time").alias("written"),
        F.split(text, "\n", -1).alias("lines"),
    )
    lines = files.select("file", "written", F.size("lines").alias("n"), F.posexplode("lines").alias("place", "text"))
    return lines.filter("place < n - 1 OR text <> ''").select(
        "file", "written", F.col("place").cast("bigint").alias("place"),
        F.encode("text", "ISO-8859-1").cast("string").alias("value"),
    )


def parse_wire(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds ``channel``, ``raw_count`` and ``reason`` to every line.

    ``reason`` is NULL for a good reading. A blank line is no reading and not an
    error either: all three are NULL. A line as boards write it costs one short
    match; only one that is no reading at all is taken apart to find out why.
    """
    text = F.col(line).cast("string")
    general = F.replace(F.regexp_extract(text, _READING, 1), F.lit("_"), F.lit(""))
    plain = F.col("_plain") != ""
    count = F.when(plain, F.col("_plain")).otherwise(general)
    rows = lines.withColumn("_plain", F.regexp_extract(text, _PLAIN, 1))
    rows = staged(rows, {"_number": count.try_cast("double")})
    # NULL where the line does not match, infinite where the count overflows.
    good = F.col("_number").isNotNull() & (F.abs(F.col("_number")) != float("inf"))
    channel = F.substring_index(text, ",", 1)
    return rows.select(
        *lines.columns,
        F.when(good, F.when(plain, channel).otherwise(_trim(channel))).alias("channel"),
        F.when(good, F.col("_number")).alias("raw_count"),
        F.when(~F.coalesce(good, F.lit(False)), _reason(text)).alias("reason"),
    )


def _trim(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def _reason(line: Column) -> Column:
    """Why a line is refused; the tests come in this order."""
    undecodable, shape, empty, name, not_number, not_finite = map(F.lit, REASONS)
    text = _trim(line)
    fields = F.split(text, ",")
    channel, count = _trim(F.get(fields, F.lit(0))), _trim(F.get(fields, F.lit(1)))
    return (
        F.when(~F.is_valid_utf8(line), undecodable)
        .when(text == "", F.lit(None))
        .when(F.size(fields) != 2, shape)
        .when(channel == "", empty)
        .when(~channel.rlike(rf"^{_NAME}\z"), name)
        # A number that still is no reading has overflowed.
        .when(count.rlike(_NON_FINITE) | count.rlike(rf"^{NUMBER}\z"), not_finite)
        .otherwise(not_number)
    )


def readings(parsed: DataFrame) -> DataFrame:
    """The lines that hold a reading."""
    return parsed.filter(F.col("raw_count").isNotNull()).drop("reason")


def quarantine(parsed: DataFrame) -> DataFrame:
    """The malformed lines, each with its reason."""
    return parsed.filter(F.col("reason").isNotNull()).drop("channel", "raw_count")


def malformed_by_reason(parsed: DataFrame) -> DataFrame:
    return quarantine(parsed).groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))
