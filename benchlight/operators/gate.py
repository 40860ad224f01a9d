"""The recording gate: hysteresis and dwell per channel, as window functions.

A channel starts out recording. While it records, a reading outside the band
starts a clock; once the clock reaches the dwell the channel stops, with that
reading. While it is stopped, the first reading strictly inside the resume band
starts it again, at once. A reading on a bound is on neither side of it.

Every reading is judged by the rule of the revision in force at its time. A revision
doesn't start the gate anew: the state and a running clock stay, and from its first
reading on its band and its dwell apply to them.

Without a loop: the clock starts where the current unbroken run of breaching
readings starts, since a reading that resumes never breaches. Each reading is
then an event - stop, resume or nothing - and the state is the last event so far.

Both parts are carried over chunk edges (see ``ordered``): the start of a run that
is open at a chunk's end, and the last event before the chunk. Readings at a
chunk's head that continue a run are the only ones whose event depends on the
carry, so one window pass per chunk and one over the chunk table are enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchlight.functions.text import quantity_text
from benchlight.operators.ordered import (
    SPLIT_ROWS,
    Chunks,
    before,
    in_chunk,
    last_before,
    order_key,
    so_far,
    with_chunks,
    with_previous,
)
from benchlight.session import settle


def subject() -> Column:
    """What the gate looks at: the voltage at the input, or the value."""
    return F.when(F.col("gate.raw_voltage"), F.col("input_volts")).otherwise(F.col("value"))


def breach_side(value: Column) -> Column:
    """``below`` or ``above`` when strictly outside the band, else NULL."""
    return F.when(value < F.col("gate.below"), "below").when(
        value > F.col("gate.above"), "above"
    )


def resumes(value: Column) -> Column:
    """Strictly inside the resume band; each edge defaults to its stop bound."""
    floor = F.coalesce("gate.resume_above", "gate.below")
    ceiling = F.coalesce("gate.resume_below", "gate.above")
    return (floor.isNull() | (value > floor)) & (ceiling.isNull() | (value < ceiling))


EVENT_COLUMNS = ["gate_out", "gate_back", "gate_dwell_us"]


def gate_events(valued: DataFrame) -> DataFrame:
    """Replaces ``gate`` by what it says of each reading on its own.

    ``gate_out``: outside the band; ``gate_back``: inside the resume band;
    ``gate_dwell_us``: the dwell, NULL for a channel without a gate. All the state
    machine needs, and much narrower than the rule.
    """
    gated = F.col("gate").isNotNull()
    return valued.withColumns(
        {
            "gate_out": F.when(gated, breach_side(subject()).isNotNull()),
            "gate_back": F.when(gated, resumes(subject())),
            "gate_dwell_us": F.when(gated, F.round(F.col("gate.dwell_s") * 1e6).cast("bigint")),
        }
    ).drop("gate")


def recording_gate(
    valued: DataFrame, keys: tuple[str, ...] = ("channel",), split_rows: int = SPLIT_ROWS
) -> DataFrame:
    """Adds ``was_recording`` (state before) and ``admitted`` (state after) to readings.

    Needs ``time``, ``seq`` and either ``gate`` with ``value`` and ``input_volts``, or
    the columns of :func:`gate_events`; all values finite. What was needed of the gate
    is dropped. Channels without one pass through without a shuffle. The input is read
    several times, so settle it if it is costly.
    """
    return gate_step(valued, None, keys, split_rows)[0]


def gate_step(
    valued: DataFrame,
    state: DataFrame | None,
    keys: tuple[str, ...] = ("channel",),
    split_rows: int = SPLIT_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """The gate from a given state: the verdicts, and the state they leave behind.

    A state has one row per gated channel: ``recording`` and, while a run of breaching
    readings is open, its start in microseconds as ``clock``.
    """
    events = gate_events(valued) if "gate" in valued.columns else valued
    kept = [c for c in events.columns if c not in EVENT_COLUMNS]
    free = events.filter(F.col("gate_dwell_us").isNull()).select(
        *kept, F.lit(True).alias("was_recording"), F.lit(True).alias("admitted")
    )
    gated, left = _gated(
        events.filter(F.col("gate_dwell_us").isNotNull()), state, list(keys), split_rows
    )
    return gated.select(*kept, "was_recording", "admitted").unionByName(free), left


def _gated(
    df: DataFrame, state: DataFrame | None, keys: list[str], split_rows: int
) -> tuple[DataFrame, DataFrame]:
    rows, chunk = with_chunks(df, keys, split_rows)
    # Shuffled and windowed once; the chunk table and the verdicts both read the result.
    rows = settle(run_events(rows, keys, chunk))
    chunks = settle(carried(chunk_ends(rows, keys, chunk), state, keys, chunk))
    return verdicts(rows, chunks, keys, chunk), _state_left(chunks, state, keys, chunk)


def run_events(rows: DataFrame, keys: list[str], chunk: Chunks) -> DataFrame:
    """What each reading does, and what state it leaves, as far as its own chunk tells."""
    window = in_chunk(keys, chunk)
    out, t = F.col("gate_out"), F.col("_t")
    rows = rows.withColumn("_t", F.unix_micros("time")).withColumn(
        "_after_out", F.lag("gate_out").over(window)
    )
    # Where the run a breaching reading belongs to started; NULL for a run that may
    # have started before the chunk.
    starts = F.when(out & ~F.col("_after_out"), t)
    rows = rows.withColumn("_start", F.last(starts, ignorenulls=True).over(so_far(window)))
    event = F.when(out & (t - F.col("_start") >= F.col("gate_dwell_us")), False).when(
        F.col("gate_back"), True
    )
    rows = rows.withColumns({"_head": out & F.col("_start").isNull(), "_event": event})
    last_event = F.last("_event", ignorenulls=True)
    due = F.when(F.col("_head"), t - F.col("gate_dwell_us"))
    return rows.withColumns(
        {
            "_state": last_event.over(so_far(window)),
            "_state_before": last_event.over(before(window)),
            # A head run has timed out if its clock started no later than this: every
            # reading is judged by its own dwell, and the latest so far decides.
            "_due": F.max(due).over(so_far(window)),
            "_due_before": F.max(due).over(before(window)),
        }
    )


def verdicts(rows: DataFrame, chunks: DataFrame, keys: list[str], chunk: Chunks) -> DataFrame:
    """Each reading's state before and after, from its chunk and what that was carried."""

    def verdict(known: str, due: str) -> Column:
        timed_out = F.col(due) >= F.col("_clock")
        return F.coalesce(F.col(known), F.when(timed_out, False), F.col("_came"))

    came = chunks.select(*keys, *chunk, "_clock", "_came")
    return rows.join(came, [*keys, *chunk]).withColumns(
        {
            "was_recording": verdict("_state_before", "_due_before"),
            "admitted": verdict("_state", "_due"),
        }
    )


def chunk_ends(rows: DataFrame, keys: list[str], chunk: Chunks) -> DataFrame:
    """What a chunk does to whatever state comes into it: one row per chunk."""
    return rows.groupBy(*keys, *chunk).agg(
        F.max_by("gate_out", order_key()).alias("_ends_out"),
        F.bool_and("gate_out").alias("_all_out"),
        F.max_by("_start", order_key()).alias("_end_start"),
        F.min("_t").alias("_first_t"),
        F.max("_due").alias("_head_due"),
        F.max_by("_state", order_key()).alias("_end_state"),
    )


CHUNK_ENDS = (
    "_ends_out boolean, _all_out boolean, _end_start bigint, _first_t bigint,"
    " _head_due bigint, _end_state boolean"
)


def carried(chunks: DataFrame, state: DataFrame | None, keys: list[str], chunk: Chunks) -> DataFrame:
    """Per chunk: when the clock of its head run started, and the state it begins in."""
    if state is None:
        chunks = chunks.withColumns(
            {"recording": F.lit(True), "clock": F.lit(None).cast("bigint")}
        )
    else:
        chunks = chunks.join(state, keys, "left")
    # Every chunk ends in or out, so the last value before is that of the chunk before.
    chunks = last_before(chunks, keys, chunk, ["_ends_out"])
    chunks = chunks.withColumn("_open", F.coalesce("_before__ends_out", F.col("clock").isNotNull()))
    run_start = F.when(F.col("_all_out") & ~F.col("_open"), F.col("_first_t")).when(
        ~F.col("_all_out") & F.col("_ends_out"), F.col("_end_start")
    )
    chunks = last_before(chunks.withColumn("_run_start", run_start), keys, chunk, ["_run_start"])
    open_since = F.coalesce("_before__run_start", "clock")
    chunks = chunks.withColumn(
        "_clock", F.coalesce(F.when(F.col("_open"), open_since), F.col("_first_t"))
    )
    stopped_at_head = F.when(F.col("_head_due") >= F.col("_clock"), False)
    chunks = chunks.withColumn("_left", F.coalesce("_end_state", stopped_at_head))
    chunks = last_before(chunks, keys, chunk, ["_left"])
    return chunks.withColumn("_came", F.coalesce("_before__left", "recording", F.lit(True)))


def _state_left(
    chunks: DataFrame, state: DataFrame | None, keys: list[str], chunk: Chunks
) -> DataFrame:
    """The state after the last chunk of each key; keys without rows keep theirs."""
    clock = F.when(
        F.col("_ends_out"), F.when(F.col("_all_out"), F.col("_clock")).otherwise(F.col("_end_start"))
    )
    end = F.struct(F.coalesce("_left", "_came").alias("recording"), clock.alias("clock"))
    now = (
        chunks.groupBy(*keys)
        .agg(F.max_by(end, F.struct(*chunk)).alias("_end"))
        .select(*keys, "_end.recording", "_end.clock")
    )
    return now if state is None else now.unionByName(state.join(now, keys, "left_anti"))


def gate_transitions(gated: DataFrame, conversions: DataFrame) -> DataFrame:
    """One row per change of state, with the bound crossed or the band re-entered.

    The rules come from ``conversions`` and meet only the readings that changed state.
    """
    on = ["conversion"] if "conversion" in gated.columns else ["channel", "revision"]
    rules = conversions.select(*on, "sensor_id", "gate")
    changed = gated.filter(F.col("admitted") != F.col("was_recording")).select(
        *dict.fromkeys(["channel", *on]), "time", "seq", "value", "input_volts", "was_recording"
    )
    value = subject()
    side = breach_side(value)
    crossed = F.concat_ws(
        " ",
        side,
        F.when(side == "below", F.col("gate.below_text")).otherwise(F.col("gate.above_text")),
    )
    floor = F.coalesce("gate.resume_above_text", "gate.below_text")
    ceiling = F.coalesce("gate.resume_below_text", "gate.above_text")
    band = F.concat_ws(
        " and ", F.concat(F.lit("above "), floor), F.concat(F.lit("below "), ceiling)
    )
    stopped = F.col("was_recording")
    return (
        changed.join(rules, on)
        .select(
            "channel",
            "sensor_id",
            "time",
            "seq",
            F.when(stopped, "recording stopped").otherwise("recording resumed").alias("message"),
            value.alias("value"),
            F.when(stopped, crossed).otherwise(band).alias("limit"),
            F.col("gate.unit").alias("unit"),
        )
        .withColumn("value_text", F.expr(quantity_text("value", "unit", 4)))
    )


def recording_gaps(transitions: DataFrame, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Intervals without recording; an open one has no end and no duration.

    A channel's transitions alternate and begin with a stop, so a resume closes
    the gap of the transition before it. They are few, and written before they are
    paired, as pairing reads them more than once.
    """
    transitions = settle(transitions)
    stop = ["time", "limit", "sensor_id"]
    paired = with_previous(transitions, ["channel"], stop, "stop", split_rows)
    closed = paired.filter(F.col("message") == "recording resumed").select(
        "channel",
        "sensor_id",
        F.col("stop.time").alias("stopped_at"),
        F.col("time").alias("resumed_at"),
        ((F.unix_micros("time") - F.unix_micros("stop.time")) / 1e6).alias("duration_s"),
        F.col("stop.limit").alias("limit"),
    )
    last = (
        transitions.groupBy("channel")
        .agg(F.max_by(F.struct("message", *stop), order_key()).alias("last"))
        .filter(F.col("last.message") == "recording stopped")
    )
    still = last.select(
        "channel",
        "last.sensor_id",
        F.col("last.time").alias("stopped_at"),
        F.lit(None).cast("timestamp").alias("resumed_at"),
        F.lit(None).cast("double").alias("duration_s"),
        "last.limit",
    )
    return closed.unionByName(still)
