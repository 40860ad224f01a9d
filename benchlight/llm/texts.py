"""Columns and helpers the text operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space is these six ASCII characters; everything else belongs to a word.
BLANKS = " \t\n\x0b\x0c\r"
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def whole(text: Column | str = "text") -> Column:
    """The text, NULL as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """The words of a text, in order; an empty array where there are none."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, BLANK + "+")
    )


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def normalised(text: Column) -> Column:
    """The text without its white space."""
    return F.regexp_replace(text, BLANK + "+", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often it is used."""
    return F.transform(F.array(value), body).getItem(0)


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """The rows as one struct ``doc`` beside new columns, so that no names clash."""
    return docs.select(F.struct("*").alias("doc"), *[c.alias(n) for n, c in columns.items()])


def row_number(docs: DataFrame) -> Column:
    """The number of a row by its place in the table, the same at every read.

    Spark cuts files into splits by the cores it finds, which changes as executors come
    and go. The number it finds first is held for the session, so a later read is cut,
    and its rows are numbered, like an earlier one.
    """
    spark, held = docs.sparkSession, "spark.sql.files.minPartitionNum"
    if spark.conf.get(held, None) is None:
        spark.conf.set(held, str(spark.sparkContext.defaultParallelism))
    return F.monotonically_increasing_id()


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
