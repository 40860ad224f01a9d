"""Ordered work per key without one task per key.

A window over a channel sorts the channel's whole history in one task. Here the
history is cut into chunks that follow (time, seq): an hour each, a second each
inside an hour that is too full, and an instant with a range of ``seq`` each
inside a second that is too full. A row's chunk depends only on the data, so a
recomputed task lands in the same place. Windows run inside chunks; what crosses
a chunk's edge is carried over a table with one row per chunk (``last_before``). A key
with more chunks than one task should take is carried by hours, days and months in turn.

``seq`` must be unique per key and time; it orders readings of one instant.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from benchlight.session import literal_rows, settle

# Rows one chunk may hold before it is split. Each hot hour or second holds more
# than this, so their tables have at most rows/SPLIT_ROWS entries. They are written, so
# Spark knows their size and broadcasts them while they are small.
SPLIT_ROWS = 2_000_000

# Chunks of one key that one window may order; beyond, they are carried over this ladder.
CHUNKS_PER_TASK = 100_000
LADDER = ("hour", "day", "month")

ORDER = ["time", "seq"]


class Chunks(list):
    """The names of chunk columns, and whether some key has too many chunks for one window."""

    def __init__(self, names: Sequence[str], crowded: bool = False):
        super().__init__(names)
        self.crowded = crowded


def with_chunks(
    df: DataFrame, keys: Sequence[str], split_rows: int = SPLIT_ROWS
) -> tuple[DataFrame, Chunks]:
    """Adds chunk columns and names them; within a key they ascend with (time, seq).

    Counts rows per key and hour first, combined before the shuffle; only where some
    hour is too full are its seconds counted too, and only where some second is too
    full is there a second chunk column.
    """
    hour, second = F.date_trunc("hour", "time"), F.date_trunc("second", "time")
    rows, full_hours, crowded = _flagged(df, keys, hour, "_full_hour", split_rows)
    if not full_hours:
        return rows.withColumn("_chunk_time", hour), Chunks(["_chunk_time"], crowded)
    chunk_time = F.when(F.col("_full_hour"), second).otherwise(hour)
    rows, full_seconds, more = _flagged(rows, keys, second, "_full_second", split_rows, "_full_hour")
    crowded = crowded or more
    if not full_seconds:
        return rows.withColumn("_chunk_time", chunk_time).drop("_full_hour"), Chunks(["_chunk_time"], crowded)
    full = F.col("_full_second")
    part = F.floor(F.col("seq") / F.lit(split_rows))
    rows = rows.withColumns(
        {
            "_chunk_time": F.when(full, F.col("time")).otherwise(chunk_time),
            "_chunk_seq": F.when(full, part).otherwise(F.lit(0).cast("bigint")),
        }
    )
    # An instant's parts are few, but how many instants a full second has isn't counted.
    return rows.drop("_full_hour", "_full_second"), Chunks(["_chunk_time", "_chunk_seq"], True)


def _flagged(
    df: DataFrame,
    keys: Sequence[str],
    slot: Column,
    flag: str,
    split_rows: int,
    among: str | None = None,
) -> tuple[DataFrame, bool, bool]:
    """Marks the rows of slots holding more than ``split_rows``, if there are any; also
    tells whether some key has more slots than a window should order."""
    source = df if among is None else df.filter(F.col(among))
    counts = settle(source.groupBy(*keys, slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_n")))
    slots = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_slots"), F.max("_n").alias("_n"))
    most, fullest = slots.agg(F.max("_slots"), F.max("_n")).first()
    crowded = (most or 0) > CHUNKS_PER_TASK
    if (fullest or 0) <= split_rows:
        return df, False, crowded
    marks = counts.filter(F.col("_n") > split_rows).select(*keys, "_slot", F.lit(True).alias(flag))
    return df.withColumn("_slot", slot).join(marks, [*keys, "_slot"], "left").drop("_slot"), True, crowded


def in_chunk(keys: Sequence[str], chunk: Sequence[str]) -> WindowSpec:
    """The window over one chunk, in order."""
    return Window.partitionBy(*keys, *chunk).orderBy(*ORDER)


def over_chunks(keys: Sequence[str], chunk: Sequence[str]) -> WindowSpec:
    """The window over a key's chunks, in order; its input has a row per chunk."""
    return Window.partitionBy(*keys).orderBy(*chunk)


def last_before(chunks: DataFrame, keys: Sequence[str], chunk: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Adds ``_before_<column>``: its last value that isn't NULL in the key's chunks before.

    To take the last of two runs of chunks, one after the other, is all it needs of each;
    so where ``chunk`` is crowded it is done inside hours, then for whole hours inside
    days, for days inside months and for months, and no task orders a key's history.
    """
    ladder = LADDER if getattr(chunk, "crowded", False) else ()
    return _climbed(chunks, list(keys), list(chunk), list(columns), ladder)


def _climbed(
    table: DataFrame, keys: list[str], chunk: list[str], columns: list[str], ladder: Sequence[str]
) -> DataFrame:
    def last(window: WindowSpec, name: str) -> dict[str, Column]:
        return {f"{name}_{c}": F.last(c, ignorenulls=True).over(before(window)) for c in columns}

    if not ladder:
        return table.withColumns(last(over_chunks(keys, chunk), "_before"))
    slot = f"_{ladder[0]}"
    cut = table.withColumn(slot, F.date_trunc(ladder[0], chunk[0]))
    inside = cut.withColumns(last(over_chunks([*keys, slot], chunk), "_inside"))
    order = F.struct(*chunk)
    ends = cut.groupBy(*keys, slot).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns]
    )
    above = _climbed(ends, keys, [slot], columns, ladder[1:]).select(
        *keys, slot, *[F.col(f"_before_{c}").alias(f"_above_{c}") for c in columns]
    )
    return (
        inside.join(above, [*keys, slot])
        .withColumns({f"_before_{c}": F.coalesce(f"_inside_{c}", f"_above_{c}") for c in columns})
        .drop(slot, *[f"_{place}_{c}" for c in columns for place in ("inside", "above")])
    )


def so_far(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def order_key() -> Column:
    return F.struct(*ORDER)


def last_key() -> Column:
    """(time, seq) as one number, for the last value of a group.

    Its buffer is of fixed size, so the groups are hashed; a struct would make every
    task sort its rows first.
    """
    return F.expr(
        "CAST(unix_micros(time) AS DECIMAL(19, 0))"
        " * CAST(10000000000000000000 AS DECIMAL(20, 0)) + CAST(seq AS DECIMAL(19, 0))"
    )


_STEP = "CAST(10000000000000000000 AS DECIMAL(20, 0))"


def key_time(key: str) -> Column:
    """The time in a number made by :func:`last_key`."""
    return F.expr(f"timestamp_micros(CAST(floor({key} / {_STEP}) AS BIGINT))")


def key_seq(key: str) -> Column:
    """The ``seq`` in a number made by :func:`last_key`."""
    return F.expr(f"CAST(pmod({key}, {_STEP}) AS BIGINT)")


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    name: str = "previous",
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """Adds the struct of ``columns`` of the row before, NULL on a key's first row."""
    chunked, chunk = with_chunks(df, keys, split_rows)
    return chunked_previous(chunked, keys, chunk, columns, name).drop(*chunk)


def chunked_previous(
    chunked: DataFrame, keys: Sequence[str], chunk: Sequence[str], columns: Sequence[str], name: str
) -> DataFrame:
    """``with_previous`` for rows that have their chunk columns already."""
    packed = F.struct(*columns)
    carried = (
        chunked.groupBy(*keys, *chunk)
        .agg(*[F.max_by(c, last_key()).alias(f"_last_{c}") for c in columns])
        .withColumn("_last", F.struct(*[F.col(f"_last_{c}").alias(c) for c in columns]))
    )
    carried = last_before(carried, keys, chunk, ["_last"]).select(
        *keys, *chunk, F.col("_before__last").alias("_carried")
    )
    return (
        chunked.withColumn("_previous", F.lag(packed).over(in_chunk(keys, chunk)))
        .join(carried, [*keys, *chunk])
        .withColumn(name, F.coalesce("_previous", "_carried"))
        .drop("_previous", "_carried")
    )


# --- ranks over all rows ----------------------------------------------------------


def ranked(df: DataFrame, order: Sequence[str], name: str = "place") -> DataFrame:
    """Numbers all rows from 1 in an order, with no window over all of them.

    Ranges of the order are found by sampling and sorted by a task each; the driver gets
    one row per range and adds up how many rows stand before it.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = settle(ordered.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    ranges = placed.groupBy(part.alias("_part")).agg(F.min("_at").alias("first"), F.count(F.lit(1)).alias("n"))
    rows, total = [], 0
    for r in sorted(ranges.collect()):
        rows.append({"_part": r["_part"], "_shift": total - r["first"] + 1})
        total += r["n"]
    shifts = literal_rows(df.sparkSession, rows, "_part bigint, _shift bigint")
    numbered = placed.withColumn("_part", part).join(F.broadcast(shifts), "_part")
    return numbered.withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")
