"""The acquisition chain over micro-batches.

Parsing, conversion and the finite check are projections and a stream-static join,
so they take a stream as they are. The gate and the warn-once lists keep their state in
small tables, one version per batch, read by the next batch; a few versions are kept. A
repeated batch reads the same version and writes the same result again.

A gate that must give the answer of the whole table however late readings come keeps its
events and one row per chunk of history instead (``stream_gate_late``): a late reading has
its chunk judged again, and those whose carried state it changes.

Windowed counts need no state: every batch writes what it adds, and readers sum it up.
So there is no watermark, and nothing is lost however late it comes; what earlier
batches added is folded into one table now and then. Stored points are only appended.

Without a ``trigger`` a stream takes what is there and ends; with one, such as
``10 seconds``, it goes on.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from benchlight.operators.calibrate import calibrate
from benchlight.operators.gate import (
    CHUNK_ENDS,
    carried,
    chunk_ends,
    gate_events,
    gate_step,
    run_events,
    verdicts,
)
from benchlight.operators.health import seconds, window_start, windows
from benchlight.operators.ordered import CHUNKS_PER_TASK, SPLIT_ROWS, Chunks, key_seq, key_time, last_key
from benchlight.schema import SUMMARY_WINDOW
from benchlight.session import exists, intermediates, remove, settle
from benchlight.sources.store import write_points
from benchlight.sources.wire import parse_wire, readings

STATE = "channel string, recording boolean, clock bigint"
SUMMARY_KEYS = ["window_start", "sensor_id"]
# Versions of a state that are kept, and batches after which counts are folded.
KEPT_VERSIONS = 5
FOLD = 50


# --- stateless ------------------------------------------------------------------


def stream_calibrate(lines: DataFrame, conv: DataFrame, formulas: list[str], **options):
    """Lines to calibrated readings; malformed lines have no row and stop nothing."""
    return calibrate(readings(parse_wire(lines)).drop("line"), conv, formulas, **options)


# --- versions of small tables ---------------------------------------------------


def _version(path: str, batch: int) -> str:
    return f"{path}/version={batch}"


def _previous(spark: SparkSession, path: str, batch: int, schema: str) -> DataFrame:
    """The table as the batch before left it; empty before the first."""
    if batch == 0:
        return spark.range(0).select(
            *[F.lit(None).cast(kind).alias(name) for name, kind in _fields(schema)]
        )
    return spark.read.schema(schema).parquet(_version(path, batch - 1))


def _forget(spark: SparkSession, path: str, batch: int) -> None:
    """Removes the version that no repeated batch can ask for any more."""
    remove(spark, [_version(path, batch - KEPT_VERSIONS)])


def _fields(schema: str) -> list[list[str]]:
    return [part.split() for part in schema.split(", ")]


def _writer(df: DataFrame, checkpoint: str, trigger: str | None = None) -> DataStreamWriter:
    when = {"availableNow": True} if trigger is None else {"processingTime": trigger}
    return df.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(**when)


def _started(
    df: DataFrame, checkpoint: str, trigger: str | None, step: Callable[[DataFrame, int], None]
) -> StreamingQuery:
    """Starts ``step`` on every batch; what a batch settles is deleted when it is done."""
    spark = df.sparkSession

    def scoped(rows: DataFrame, batch: int) -> None:
        with intermediates(spark):
            step(rows, batch)

    return _writer(df, checkpoint, trigger).foreachBatch(scoped).start()


# --- the gate -------------------------------------------------------------------


def stream_gate(
    valued: DataFrame, path: str, checkpoint: str, split_rows: int = SPLIT_ROWS, trigger: str | None = None
) -> StreamingQuery:
    """The recording gate across batches; verdicts land under ``path/batch=…``.

    A batch is gated by the same windows as a table, from the state the batch before
    left, so a hot channel is spread over tasks here too. Rows of a batch are taken in
    (time, seq) order; a row older than the batch before is judged when it arrives.
    """
    spark = valued.sparkSession
    states = f"{checkpoint}-state"

    def step(rows: DataFrame, batch: int) -> None:
        # One pass over the source: the gate reads its rows more than once.
        rows = settle(rows)
        state = _previous(spark, states, batch, STATE)
        gated, left = gate_step(rows, state, split_rows=split_rows)
        gated.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        left.write.mode("overwrite").parquet(_version(states, batch))
        _forget(spark, states, batch)

    events = gate_events(valued.filter("finite").drop("finite"))
    return _started(events, checkpoint, trigger, step)


_EVENTS = "channel string, time timestamp, seq bigint, gate_out boolean, gate_back boolean, gate_dwell_us bigint"
_CHUNK = Chunks(["_chunk_time"])


def stream_gate_late(
    valued: DataFrame, path: str, checkpoint: str, trigger: str | None = None
) -> StreamingQuery:
    """The recording gate of the whole table, in whatever order readings come.

    The events of gated channels are kept by day, and of every chunk, an hour of a channel,
    what it does to a state and what state was carried into it: one row. A batch has the
    chunks its readings fall into judged again, from all their events, and carries states
    over the rows of chunks; where another state comes into a chunk than did before, that
    chunk is judged again too. Verdicts are written chunk by chunk under ``path/batch=…``;
    ``current_gate`` reads the last ones. A repeated batch writes the same again.
    """
    spark = valued.sparkSession
    events_path, ends_path = f"{checkpoint}-events", f"{checkpoint}-chunks"
    keys, on = ["channel"], ["channel", *_CHUNK]
    hour = F.date_trunc("hour", "time")
    ends_schema = f"channel string, _chunk_time timestamp, {CHUNK_ENDS}, _clock bigint, _came boolean"

    def events_of(chunks: DataFrame, batch: int) -> DataFrame:
        """All events so far of some chunks; only their days are read."""
        days = [r[0] for r in chunks.select(F.to_date("_chunk_time")).distinct().collect()]
        kept = spark.read.schema(f"{_EVENTS}, batch int, day date").parquet(events_path)
        chosen = kept.filter(F.col("day").isin(days) & (F.col("batch") <= batch)).drop("batch", "day")
        return chosen.withColumn("_chunk_time", hour).join(chunks.select(*on), on, "left_semi")

    def step(rows: DataFrame, batch: int) -> None:
        rows = settle(rows)
        gated = rows.filter(F.col("gate_dwell_us").isNotNull()).withColumn("day", F.to_date("time"))
        gated.write.mode("overwrite").partitionBy("day").parquet(f"{events_path}/batch={batch}")
        before = _previous(spark, ends_path, batch, ends_schema)
        touched = settle(gated.select("channel", hour.alias("_chunk_time")).distinct())
        known = before.drop("_clock", "_came")
        if touched.isEmpty():
            ends = known
        else:
            again = chunk_ends(run_events(events_of(touched, batch), keys, _CHUNK), keys, _CHUNK)
            ends = known.join(touched, on, "left_anti").unionByName(again)
        now = settle(_carried_over(ends, keys))
        now.select(*[name for name, _ in _fields(ends_schema)]).write.mode("overwrite").parquet(
            _version(ends_path, batch)
        )
        came = before.select(*on, F.col("_clock").alias("_clock_then"), F.col("_came").alias("_came_then"))
        same = F.col("_clock").eqNullSafe(F.col("_clock_then")) & F.col("_came").eqNullSafe(F.col("_came_then"))
        moved = now.join(came, on, "left").filter(~same).select(*on).unionByName(touched).distinct()
        moved = settle(moved)
        free = rows.filter(F.col("gate_dwell_us").isNull()).select(
            "channel", F.lit(None).cast("timestamp").alias("_chunk_time"), "time", "seq",
            F.lit(True).alias("was_recording"), F.lit(True).alias("admitted"),
        )
        judged = free
        if not moved.isEmpty():
            judged = free.unionByName(
                verdicts(run_events(events_of(moved, batch), keys, _CHUNK), now, keys, _CHUNK).select(free.columns)
            )
        judged.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        _forget(spark, ends_path, batch)

    needed = [name for name, _ in _fields(_EVENTS)]
    events = gate_events(valued.filter("finite")).select(*needed)
    return _started(events, checkpoint, trigger, step)


def _carried_over(ends: DataFrame, keys: list[str]) -> DataFrame:
    ends = settle(ends)
    most = ends.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    return carried(ends, None, keys, Chunks(_CHUNK, most > CHUNKS_PER_TASK))


def current_gate(spark: SparkSession, path: str) -> DataFrame:
    """The verdicts as they stand: of each chunk those written last."""
    written = spark.read.parquet(path)
    last = written.groupBy("channel", "_chunk_time").agg(F.max("batch").alias("batch"))
    on = F.col("w._chunk_time") == F.col("l._chunk_time")
    on = on & (F.col("w.channel") == F.col("l.channel")) & (F.col("w.batch") == F.col("l.batch"))
    judged = written.filter(F.col("_chunk_time").isNotNull()).alias("w").join(last.alias("l"), on, "left_semi")
    free = written.filter(F.col("_chunk_time").isNull())
    return judged.unionByName(free).drop("_chunk_time", "batch")


# --- sinks ----------------------------------------------------------------------


def stream_points_sink(
    points: DataFrame, path: str, checkpoint: str, trigger: str | None = None
) -> StreamingQuery:
    """Append points batch by batch; readers of the store see the last write only."""

    def step(rows: DataFrame, batch: int) -> None:
        write_points(rows, path)

    return _started(points, checkpoint, trigger, step)


def stream_warn_once(
    strangers: DataFrame, path: str, checkpoint: str, key: str = "channel", trigger: str | None = None
) -> StreamingQuery:
    """Name each ``key`` of ``strangers`` once, with when it was first seen.

    For channels without a calibration, or sensors (``key="sensor_id"``) whose values
    are not finite. The list, one row per name, is all the state there is.
    """
    spark = strangers.sparkSession
    schema = f"{key} string, first_time timestamp, first_seq bigint"

    def step(rows: DataFrame, batch: int) -> None:
        warned = _previous(spark, path, batch, schema)
        fresh = (
            rows.groupBy(key)
            .agg(F.min(last_key()).alias("_first"))
            .join(warned, key, "left_anti")
            .select(key, key_time("_first").alias("first_time"), key_seq("_first").alias("first_seq"))
        )
        warned.unionByName(fresh).write.mode("overwrite").parquet(_version(path, batch))
        _forget(spark, path, batch)

    return _started(strangers, checkpoint, trigger, step)


def latest_version(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a table the functions above keep."""
    versions = spark.read.parquet(path)
    newest = versions.agg(F.max("version")).scalar()
    return versions.filter(F.col("version") == newest).drop("version")


# --- windowed counts ------------------------------------------------------------


def stream_counts(
    rows: DataFrame,
    count: Callable[[DataFrame], DataFrame],
    keys: Sequence[str],
    path: str,
    checkpoint: str,
    trigger: str | None = None,
) -> StreamingQuery:
    """Windowed counts of a stream, without a state: each batch writes what it adds.

    ``count`` makes counts or sums per ``keys`` out of a table, such as
    :func:`log_volume` of :mod:`loglines`; ``current_counts`` sums the batches up.
    """

    def step(batch_rows: DataFrame, batch: int) -> None:
        _add(count(batch_rows), keys, path, batch)

    return _started(rows, checkpoint, trigger, step)


def _add(counts: DataFrame, keys: Sequence[str], path: str, batch: int) -> None:
    """Writes a batch's counts; every ``FOLD`` batches one row per key is left of them all.

    The fold of a batch has a name of its own, and what it sums up is removed one fold
    later, so a repeated batch finds what it found before.
    """
    spark = counts.sparkSession
    counts.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    if batch % FOLD == FOLD - 1:
        folded = _summed(_parts(spark, path, batch), keys)
        folded.write.mode("overwrite").parquet(f"{path}/fold={batch}")
        remove(spark, [f"{path}/fold={batch - 2 * FOLD}"])
        remove(spark, [f"{path}/batch={b}" for b in range(batch - 2 * FOLD + 1, batch - FOLD + 1)])


def _parts(spark: SparkSession, path: str, last: int) -> DataFrame:
    """The newest complete fold before batch ``last``, and the batches after it."""
    folds = [f for f in range(FOLD - 1, last, FOLD) if exists(spark, f"{path}/fold={f}/_SUCCESS")]
    after = max(folds, default=-1)
    names = [f"{path}/fold={after}"] * (after >= 0) + [
        f"{path}/batch={b}" for b in range(after + 1, last + 1) if exists(spark, f"{path}/batch={b}")
    ]
    return spark.read.parquet(*names)


def _summed(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    values = [c for c in parts.columns if c not in keys]
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in values])


def current_counts(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The counts of all batches so far."""
    return _summed(_parts(spark, path, _last_batch(spark, path)), list(keys))


def _last_batch(spark: SparkSession, path: str) -> int:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
    names = [item.getPath().getName() for item in listed]
    return max(int(n.split("=")[1]) for n in names if n.startswith("batch="))


def stream_summary(
    lines: DataFrame,
    conv: DataFrame,
    formulas: list[str],
    path: str,
    checkpoint: str,
    every: str | None = SUMMARY_WINDOW,
    split_rows: int = SPLIT_ROWS,
    trigger: str | None = None,
) -> StreamingQuery | None:
    """Readings written and skipped per sensor and window, after the gate.

    Each batch of ``lines`` is calibrated and gated from the state the batch before left,
    and adds its counts; a row without a sensor marks each window that had a line.
    ``current_summary`` fills in the silent sensors. No window turns the summary off.
    """
    if not every or every.startswith("0 "):
        return None
    spark = lines.sparkSession
    states = f"{checkpoint}-state"

    def step(rows: DataFrame, batch: int) -> None:
        rows = settle(rows)
        valued = settle(gate_events(stream_calibrate(rows, conv, formulas, carry=["sensor_id", "gate"])))
        state = _previous(spark, states, batch, STATE)
        gated, left = gate_step(valued.filter("finite").drop("finite"), state, split_rows=split_rows)
        outcomes = (
            gated.filter("admitted")
            .select("time", "sensor_id", F.lit(1).alias("readings"), F.lit(0).alias("skipped"))
            .unionByName(
                valued.filter("NOT finite").select(
                    "time", "sensor_id", F.lit(0).alias("readings"), F.lit(1).alias("skipped")
                )
            )
            .unionByName(
                rows.select(
                    "time",
                    F.lit(None).cast("string").alias("sensor_id"),
                    F.lit(0).alias("readings"),
                    F.lit(0).alias("skipped"),
                )
            )
        )
        counts = outcomes.groupBy(window_start("time", every).alias("window_start"), "sensor_id").agg(
            F.sum("readings").alias("readings"), F.sum("skipped").alias("skipped")
        )
        _add(counts, SUMMARY_KEYS, path, batch)
        left.write.mode("overwrite").parquet(_version(states, batch))
        _forget(spark, states, batch)

    return _started(lines, checkpoint, trigger, step)


def ticks(spark: SparkSession) -> DataFrame:
    """A clock: one ``time`` a second for as long as the process lives."""
    return spark.readStream.format("rate").load().select(F.col("timestamp").alias("time"))


def stream_heartbeat(
    clock: DataFrame,
    declared: DataFrame,
    path: str,
    checkpoint: str,
    every: str = SUMMARY_WINDOW,
    trigger: str | None = None,
) -> StreamingQuery:
    """Zero rows for every declared sensor and window in which the clock ticked.

    So an outage of all sensors, when no line comes at all, still has its rows. ``clock``
    is a stream with a ``time``, such as ``ticks``. Counts of nothing are added under
    ``path`` as ``stream_summary`` adds its own; ``current_summary`` takes both.
    """

    def step(rows: DataFrame, batch: int) -> None:
        zeros = windows(declared, rows, every).select(
            "window_start", "sensor_id", F.lit(0).cast("bigint").alias("readings"), F.lit(0).cast("bigint").alias("skipped")
        )
        _add(zeros, SUMMARY_KEYS, path, batch)

    return _started(clock.select("time"), checkpoint, trigger, step)


def current_summary(
    spark: SparkSession,
    path: str,
    declared: DataFrame,
    every: str = SUMMARY_WINDOW,
    heartbeat: str | None = None,
) -> DataFrame:
    """The summary of all batches so far, with a row for every window of every sensor.

    Windows go from the first line to the last, and with ``heartbeat``, the path of
    ``stream_heartbeat``, as far as the clock ticked.
    """
    counts = current_counts(spark, path, SUMMARY_KEYS)
    zeros = windows(declared, counts.select(F.col("window_start").alias("time")), every)
    zeros = zeros.withColumns({"readings": F.lit(0).cast("bigint"), "skipped": F.lit(0).cast("bigint")})
    every_row = counts.filter("sensor_id IS NOT NULL").unionByName(zeros)
    if heartbeat is not None:
        every_row = every_row.unionByName(current_counts(spark, heartbeat, SUMMARY_KEYS))
    return _summed(every_row, SUMMARY_KEYS).withColumn("window_s", F.lit(seconds(every)))


def stream_gap_context(gaps: DataFrame, logs: DataFrame, delay: str) -> DataFrame:
    """Closed gaps of a sensor with the lines about it, both arriving as streams.

    ``gaps`` has ``sensor_id``, ``gap_start`` and ``gap_end``, ``logs`` ``sensor_id``
    and ``ts``. Either side may be ``delay`` late; past that its rows are let go, as a join
    of two streams can't wait for ever. ``gap_context`` over the stored tables has them all.
    """
    silences = gaps.withWatermark("gap_end", delay).withColumnRenamed("sensor_id", "_about")
    lines = logs.filter(F.col("sensor_id").isNotNull()).withWatermark("ts", delay)
    during = (
        (F.col("sensor_id") == F.col("_about"))
        & (F.col("ts") >= F.col("gap_start"))
        & (F.col("ts") <= F.col("gap_end"))
    )
    return lines.join(silences, during).drop("_about")
