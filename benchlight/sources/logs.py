"""Container and journal records as labelled log rows.

An absent label is NULL, never empty text: an empty label would be a stream of
its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from benchlight.functions.staged import staged
from benchlight.functions.text import logfmt_fields
from benchlight.schema import ERROR_LEVELS, LOG_RECORDS, WARN_LEVELS


def read_logs(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """JSON records from files, with the schema stated rather than inferred."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(LOG_RECORDS).json(path)


def relabel(records: DataFrame, unit_prefix: str = "telemetry-") -> DataFrame:
    """Labels from where a record came from; foreign journal units are dropped.

    The journal is the whole machine's, so only units whose resolved name starts
    with ``unit_prefix`` are kept (``""`` keeps every one that has a name).
    """
    journal = F.col("source") == "journal"
    unit = F.when(journal, journal_unit())
    kept = ~journal | F.coalesce(unit.startswith(unit_prefix), F.lit(False))
    return records.filter(kept).select(
        "ts",
        "seq",
        "line",
        F.when(
            ~journal, F.nullif(F.regexp_extract("container_name", "^/(.*)$", 1), F.lit(""))
        ).alias("container"),
        unit.alias("unit"),
        F.when(journal, F.nullif("priority_keyword", F.lit(""))).alias("stream_level"),
        F.nullif("client_name", F.lit("")).alias("host"),
        F.when(journal, F.lit("systemd-journal")).alias("job"),
    )


def parse_logfmt(logs: DataFrame) -> DataFrame:
    """Adds the ``fields`` map of each line, parsed once however often it is used."""
    return staged(logs, {"fields": logfmt_fields(F.col("line"))})


def promote_labels(logs: DataFrame) -> DataFrame:
    """``sensor_id``, ``level`` and ``msg`` out of the fields, with a severity.

    A level the journal already set stands; the line's own is used otherwise.
    """
    level = F.col("fields")["level"]
    known = logs.withColumn("sensor_id", F.nullif(F.col("fields")["sensor_id"], F.lit("")))
    own = F.nullif(level, F.lit(""))
    if "stream_level" in logs.columns:
        own = F.coalesce("stream_level", own)
    return known.withColumn("level", own).withColumns(
        {"msg": F.col("fields")["msg"], "severity": severity(F.col("level"))}
    ).drop("stream_level")


def severity(level: Column) -> Column:
    """One spelling per severity: services do not agree on theirs."""
    lower = F.lower(level)
    return (
        F.when(lower.isin(*WARN_LEVELS), "warning")
        .when(lower.isin(*ERROR_LEVELS), "error")
        .otherwise(lower)
    )


def labelled_logs(records: DataFrame, unit_prefix: str = "telemetry-") -> DataFrame:
    """The whole collection step: relabel, parse, promote."""
    return promote_labels(parse_logfmt(relabel(records, unit_prefix)))


def journal_unit() -> Column:
    """A user unit names the manager in the system field, so its own name wins."""
    return F.coalesce(
        F.nullif("systemd_user_unit", F.lit("")), F.nullif("systemd_unit", F.lit(""))
    )
