"""Line dedup by distinct-site spread.

A line that stands on many sites is boilerplate. One HyperLogLog sketch of sites per
line hash, merged by aggregation, estimates each line's spread. Lines whose estimate is
far from the threshold are settled by it; those near it get an exact distinct count of
their sites. Lines at or above the threshold are removed from every document.

A line is compared without the white space at its ends; lines without a word are never
removed, they keep their place. A very long text is split whole, in its row's memory. NULL text has no lines and stays NULL. A NULL site is a
site of its own. A line that repeats in one document counts its site once. Rows are
numbered by position, so ``clean`` needs a table's rows. An empty table gives an empty
result. Other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchlight.llm.texts import BLANKS, WORD, packed, row_number
from benchlight.session import settle

MIN_SITES = 10
LOG_SKETCH_SIZE = 10
# The estimate's relative error is about 0.83 / sqrt(2 ** 10) = 2.6 %; six of those.
MARGIN = 0.16


def line_hash(line: Column) -> Column:
    """128 bits of a trimmed line."""
    return F.unhex(F.md5(F.btrim(line, F.lit(BLANKS))))


def lines(docs: DataFrame, text: str = "text", site: str = "source") -> DataFrame:
    """``row``, ``site`` and ``hash`` of every line with a word."""
    numbered = docs.select(
        row_number(docs).alias("row"),
        F.xxhash64(F.coalesce(F.concat(F.lit("s"), F.col(site)), F.lit(""))).alias("site"),
        F.array_distinct(F.split(F.col(text), "\n", -1)).alias("lines"),
    )
    split = numbered.select("row", "site", F.explode("lines").alias("line"))
    return split.filter(F.col("line").rlike(WORD)).select("row", "site", line_hash(F.col("line")).alias("hash"))


def spread(placed: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN) -> DataFrame:
    """``hash`` and ``n_sites`` of the lines on at least ``min_sites`` sites.

    ``n_sites`` is exact near the threshold and an estimate far above it.
    """
    sketched = placed.groupBy("hash").agg(F.hll_sketch_agg("site", LOG_SKETCH_SIZE).alias("sketch"))
    estimated = settle(
        sketched.select("hash", F.hll_sketch_estimate("sketch").alias("n_sites")).filter(
            F.col("n_sites") >= F.floor(F.lit(min_sites * (1 - margin)))
        )
    )
    is_near = F.col("n_sites") <= F.ceil(F.lit(min_sites * (1 + margin)))
    counted = (
        placed.join(estimated.filter(is_near).select("hash"), "hash", "left_semi")
        .distinct()
        .groupBy("hash")
        .agg(F.count(F.lit(1)).alias("n_sites"))
        .filter(F.col("n_sites") >= min_sites)
    )
    return estimated.filter(~is_near).select("hash", "n_sites").unionByName(counted)


def without_boilerplate(
    docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES
) -> DataFrame:
    """The rows as ``doc`` beside ``cleaned``, the text that remains, ``n_lines`` with a
    word, and ``n_removed`` of them."""
    placed = settle(lines(docs, text, site))
    widespread = settle(spread(placed.select("hash", "site"), min_sites))
    # At most the document's own lines come together, and only those on many sites.
    hits = (
        placed.select("row", "hash")
        .join(widespread.select("hash"), "hash")
        .groupBy("row")
        .agg(F.collect_set("hash").alias("hits"))
    )
    numbered = packed(docs, row=row_number(docs))
    body = F.split(F.col(f"doc.{text}"), "\n", -1)
    # By merge at every size: what is joined grows with the documents.
    found = numbered.join(settle(hits).hint("merge"), "row", "left")
    stays = F.filter(
        body, lambda x: ~x.rlike(WORD) | ~F.array_contains(F.col("hits"), line_hash(x))
    )
    has_word = lambda a: F.size(F.filter(a, lambda x: x.rlike(WORD)))
    cleaned = F.when(F.col("hits").isNull(), F.col(f"doc.{text}")).otherwise(F.array_join(stays, "\n"))
    counts = found.select(
        "doc",
        cleaned.alias("cleaned"),
        F.when(F.col(f"doc.{text}").isNull(), 0).otherwise(has_word(body)).cast("bigint").alias("n_lines"),
    )
    left = F.when(F.col("cleaned").isNull(), 0).otherwise(has_word(F.split("cleaned", "\n", -1)))
    return counts.withColumn("n_removed", (F.col("n_lines") - left).cast("bigint"))


def clean(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """The documents without their widespread lines; the columns are those of ``docs``."""
    rows = without_boilerplate(docs, text, site, min_sites)
    return rows.select(
        *[
            (F.col("cleaned") if n == text else F.col("doc").getField(n)).alias(n)
            for n in docs.columns
        ]
    )
