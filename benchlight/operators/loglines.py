"""Questions asked of labelled log lines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchlight.operators.health import window_start
from benchlight.schema import ERROR_LEVELS, WARN_LEVELS
from benchlight.sources.wire import NUMBER

# --- fixed values -----------------------------------------------------------
LEVEL_ORDER = {"debug": 10, "info": 20, "warning": 30, "error": 40}
SUMMARY_MESSAGE = "wrote readings"


# --- filters --------------------------------------------------------------------


def label_equals(label: str, value: str) -> Column:
    return F.col(label) == F.lit(value)


def label_matches(label: str, pattern: str) -> Column:
    """An anchored pattern; ``.+`` is "all" and leaves out lines without the label."""
    present = F.coalesce(F.col(label), F.lit(""))
    return present.rlike(rf"\A(?:{pattern})\z")


def field_number(field: str) -> Column:
    """A field as a number, NULL where it is none."""
    text = F.col("fields")[field]
    number = F.replace(text, F.lit("_"), F.lit("")).try_cast("double")
    return F.when(text.rlike(rf"\A{NUMBER}\z"), number)


def warnings() -> Column:
    return F.col("level").isin(*WARN_LEVELS)


def errors() -> Column:
    return F.col("level").isin(*ERROR_LEVELS)


def _rank(level: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in LEVEL_ORDER.items() for x in pair])
    return F.try_element_at(ranks, level)


def module_level_filter(
    logs: DataFrame, minimum: Mapping[str, str], default: str = "info", logger: str = "logger"
) -> DataFrame:
    """Lines at or above the level set for their module; the longest prefix decides.

    A line without a known severity is kept: there is nothing to judge it by.
    """
    floor = F.lit(LEVEL_ORDER[default])
    for prefix in sorted(minimum, key=len):
        name = F.coalesce(F.col(logger), F.lit(""))
        floor = F.when(name.startswith(prefix), LEVEL_ORDER[minimum[prefix]]).otherwise(floor)
    rank = _rank(F.col("severity"))
    return logs.filter(rank.isNull() | (rank >= floor))


def module_levels(logs: DataFrame, logger: str = "logger") -> DataFrame:
    """Every name a line's logger begins with, as ``_prefix``, once per distinct ``_logger``."""
    names = logs.select(F.coalesce(F.col(logger), F.lit("")).alias("_logger")).distinct()
    ends = F.sequence(F.lit(0), F.char_length("_logger"))
    return names.select("_logger", F.explode(ends).alias("_n")).withColumn(
        "_prefix", F.expr("substring(_logger, 1, _n)")
    )


def module_rules_filter(
    logs: DataFrame, rules: DataFrame, default: str = "info", logger: str = "logger"
) -> DataFrame:
    """``module_level_filter`` by a table of rules (``prefix``, ``level``), however many.

    Distinct loggers, not lines, meet the rules, by hash on all they begin with; the
    longest decides, and of rules for one prefix the strictest. Lines then meet their
    logger's level in one join.
    """
    wanted = rules.select(F.col("prefix").alias("_prefix"), _rank(F.col("level")).alias("_rank"))
    levels = (
        module_levels(logs, logger)
        .join(wanted.filter("_prefix IS NOT NULL AND _rank IS NOT NULL"), "_prefix")
        .groupBy("_logger")
        .agg(F.max_by("_rank", F.col("_n") * 100 + F.col("_rank")).alias("_floor"))
    )
    rank = _rank(F.col("severity"))
    floor = F.coalesce(F.col("_floor"), F.lit(LEVEL_ORDER[default]))
    named = logs.withColumn("_logger", F.coalesce(F.col(logger), F.lit("")))
    return named.join(levels, "_logger", "left").filter(rank.isNull() | (rank >= floor)).select(logs.columns)


def at_least(logs: DataFrame, level: str = "info") -> DataFrame:
    """Without the lines below a severity: reading-level noise is debug."""
    return module_level_filter(logs, {}, level, logger="line")


def apply_retention(logs: DataFrame, now, hours: int = 720, time: str = "ts") -> DataFrame:
    """Lines within retention, dropped by whole days as a date-partitioned store does.

    Below a day retention could not take effect, so it is refused.
    """
    if hours < 24:
        raise ValueError("retention works by whole days; give at least 24 hours")
    oldest = F.date_sub(F.to_date(F.lit(now)), hours // 24)
    if "date" in logs.columns:
        return logs.filter(F.col("date") >= oldest)
    return logs.filter(F.col(time) >= oldest.cast("timestamp"))


# --- aggregates -----------------------------------------------------------------


def log_volume(logs: DataFrame, step: str) -> DataFrame:
    """Lines per step and level; lines without a level are a group of their own."""
    return logs.groupBy(window_start("ts", step).alias("step"), "level").agg(
        F.count(F.lit(1)).alias("lines")
    )


def warning_count(logs: DataFrame) -> DataFrame:
    return logs.agg(F.count_if(warnings()).alias("warnings"))


def error_count(logs: DataFrame) -> DataFrame:
    return logs.agg(F.count_if(errors()).alias("errors"))


def threshold_status(
    counts: DataFrame, count: str, steps: Sequence[tuple[float | None, str]]
) -> DataFrame:
    """The colour of the highest step a count reaches; the first step has no limit."""
    colour = F.lit(steps[0][1])
    for limit, name in steps[1:]:
        colour = F.when(F.col(count) >= limit, name).otherwise(colour)
    return counts.withColumn("status", colour)


WARNING_STEPS = ((None, "green"), (1, "orange"))
ERROR_STEPS = ((None, "green"), (1, "red"))


def skipped_by_sensor(logs: DataFrame, step: str) -> DataFrame:
    """Skipped readings per step and sensor, out of the summary lines."""
    return (
        logs.filter(F.col("msg") == SUMMARY_MESSAGE)
        .withColumn("_skipped", field_number("skipped"))
        .filter(F.col("_skipped").isNotNull())
        .groupBy(window_start("ts", step).alias("step"), "sensor_id")
        .agg(F.sum("_skipped").alias("skipped"))
    )


def label_values(logs: DataFrame, label: str) -> DataFrame:
    return (
        logs.filter(F.col(label).isNotNull()).select(label).distinct().orderBy(label)
    )


# --- lines ----------------------------------------------------------------------


def newest_lines(logs: DataFrame, count: int | None = None) -> DataFrame:
    """Newest lines first; ``count`` limits them to what a panel shows."""
    ordered = logs.orderBy(F.col("ts").desc(), F.col("seq").desc())
    return ordered if count is None else ordered.limit(count)


def warn_and_error_lines(logs: DataFrame, count: int | None = None) -> DataFrame:
    return newest_lines(logs.filter(warnings() | errors()), count)


def gap_context(gaps: DataFrame, logs: DataFrame) -> DataFrame:
    """For each gap of a sensor, the lines about that sensor during it.

    ``gaps`` has ``sensor_id``, ``gap_start`` and ``gap_end`` (NULL = still open).
    A gap is spread over the hours it covers, up to the newest line, so the
    join is on sensor and hour and no task holds a sensor's whole history. A line
    has one hour, so it meets a gap once.
    """
    newest = logs.agg(F.max("ts")).scalar()
    end = F.coalesce("gap_end", newest)
    spread = gaps.withColumn(
        "_hour",
        F.explode(
            F.when(
                end >= F.col("gap_start"),
                F.sequence(
                    F.date_trunc("hour", "gap_start"), end, F.expr("INTERVAL 1 hour")
                ),
            )
        ),
    )
    lines = logs.filter(F.col("sensor_id").isNotNull()).withColumn(
        "_hour", F.date_trunc("hour", "ts")
    )
    during = (F.col("ts") >= F.col("gap_start")) & (
        F.col("gap_end").isNull() | (F.col("ts") <= F.col("gap_end"))
    )
    return spread.join(lines, ["sensor_id", "_hour"]).filter(during).drop("_hour")
