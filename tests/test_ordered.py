"""Carrying values over many chunks of one key, and ranks over all rows."""

import random

import pytest
from helpers import at
from pyspark.sql import functions as F

from benchlight.operators import ordered


@pytest.mark.parametrize("crowded", [False, True])
def test_last_before_matches_a_loop(spark, crowded):
    rng, rows, expected = random.Random(6), [], {}
    for key in "ab":
        last, t = None, 0
        for i in range(300):
            t += rng.choice([1, 1, 40, 3600, 90_000, 3_000_000])
            value = rng.choice([None, None, i])
            expected[key, t] = last
            rows.append((key, at(t), t, value))
            last = last if value is None else value
    chunks = spark.createDataFrame(rows, "key string, _chunk_time timestamp, t long, v int")
    chunk = ordered.Chunks(["_chunk_time"], crowded)
    got = ordered.last_before(chunks, ["key"], chunk, ["v"])
    assert {(r["key"], r["t"]): r["_before_v"] for r in got.collect()} == expected
    assert set(got.columns) == {"key", "_chunk_time", "t", "v", "_before_v"}


def test_no_window_of_a_ladder_is_long(spark):
    """Three years of hours, one key: groups of hours, of days in a month, of months."""
    chunks = spark.range(3 * 365 * 24).select(
        F.lit("k").alias("key"),
        F.timestamp_seconds(F.col("id") * 3600).alias("_chunk_time"),
        F.when(F.col("id") % 1000 == 0, F.col("id")).alias("v"),
    )
    got = ordered.last_before(chunks, ["key"], ordered.Chunks(["_chunk_time"], True), ["v"])
    wrong = got.filter("NOT _before_v <=> IF(_chunk_time = timestamp_seconds(0), NULL,"
                       " ((unix_seconds(_chunk_time) div 3600 - 1) div 1000) * 1000)")  # fmt: skip
    assert wrong.count() == 0
    plan = got._jdf.queryExecution().analyzed().toString()
    specs = [line for line in plan.splitlines() if "windowspecdefinition" in line]
    # Only months are ordered for the key as a whole.
    assert len(specs) == 4 and sum("_hour" in x or "_day" in x or "_month" in x for x in specs) == 4
    months = chunks.select(F.date_trunc("month", "_chunk_time")).distinct().count()
    assert months == 36


def test_ranks(spark):
    rows = [(random.Random(i).randint(0, 50), f"n{i:04d}") for i in range(2000)]
    df = spark.createDataFrame(rows, "a int, b string").repartition(7)
    got = ordered.ranked(df, ["a", "b"])
    assert [(r["a"], r["b"]) for r in got.orderBy("place").collect()] == sorted(rows)
    assert sorted(r["place"] for r in got.collect()) == list(range(1, 2001))
    assert "Window" not in got._jdf.queryExecution().toString()
    assert ordered.ranked(df.limit(0), ["a", "b"]).count() == 0
