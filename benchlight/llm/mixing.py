"""Mixing sources to target weights.

Words are summed per source, each source gets a share of a total by its weight, and
every document is emitted ``floor(rate)`` times plus once more with the probability of
the remaining fraction, drawn from a keyed hash of its id. Reruns agree.

NULL text: size 0. A NULL source is a source of its own, ordered last. Sources without
a word get target 0 and rate 0. Rows that repeat draw alike, and so do all rows without an
id: of a source of such rows all are taken once more or none, which by a count of copies may
be off its target by one. A very long text is one document. An empty table gives an empty
mix. Other columns pass through ``mix`` untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from benchlight.llm.texts import n_words, packed, whole
from benchlight.session import settle

WEIGHTS = (3, 1, 2)
TOTAL_PERCENT = 150
MAX_REPEATS = 2
SEED = "mix"


def sizes(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """``key``, ``source`` and the number of words ``size`` of every document."""
    return docs.select(
        F.col(key).alias("doc_id"),
        F.col(source).alias("source"),
        n_words(whole(text)).alias("size"),
    )


def targets(
    sized: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    total_percent: int = TOTAL_PERCENT,
    max_repeats: int = MAX_REPEATS,
) -> DataFrame:
    """One row per source: ``source_size`` and ``target``, the words the mix takes of it.

    Weights repeat along the sources in code point order. The total is shared by weight;
    a share above ``max_repeats`` times its source is cut there and the excess shared
    again among the others. Each pass is one sum over the table of sources, and only
    sums reach the driver: what remains to share, and the weight it is shared by.
    """
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = settle(_ranked(total, weights)).withColumn(
        "cap", F.col("source_size") * max_repeats
    )
    whole_size = ranked.agg(F.sum("source_size")).first()[0] or 0
    goal = float(whole_size) * total_percent / 100.0
    left, weight = goal, 0.0
    is_open = F.lit(True)
    while True:
        sums = ranked.agg(
            F.sum(F.when(is_open, F.col("weight"))).alias("weight"),
            F.sum(F.when(~is_open, F.col("cap"))).alias("closed"),
        ).first()
        level = (goal - float(sums["closed"] or 0), float(sums["weight"] or 0))
        if level[1] == 0 or level == (left, weight):
            break
        left, weight = level
        is_open = F.col("weight") * left <= F.col("cap") * weight
    share = F.col("weight") * F.lit(left) / F.lit(weight or 1.0)
    return ranked.select(
        "source",
        "source_size",
        F.least(share, F.col("cap").cast("double")).alias("target"),
    )


def _ranked(total: DataFrame, weights: Sequence[int]) -> DataFrame:
    """Weights by rank. One row per source: the rank is found over ranges of sources."""
    code_points = F.hex(F.encode(F.col("source"), "UTF-8"))
    ordered = settle(
        total.withColumn("code", F.coalesce(code_points, F.lit("~")))
        .repartitionByRange("code")
        .sortWithinPartitions("code")
        .withColumn("part", F.spark_partition_id())
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        ordered.groupBy("part")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .select("part", "start")
    )
    within = F.row_number().over(Window.partitionBy("part").orderBy("code"))
    place = (F.col("start") + within - 1) % len(weights)
    table = F.array(*[F.lit(float(w)) for w in weights])
    return (
        ordered.join(counts, "part")
        .withColumn("weight", F.get(table, place.cast("int")))
        .select("source", "source_size", "weight")
    )


def copies(rate: Column, key: Column, seed: str = SEED) -> Column:
    """``floor(rate)``, plus one where a draw keyed by the id falls below the fraction."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))))
    draw = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(16**12)
    return F.floor(rate).cast("long") + F.when(draw < rate - F.floor(rate), 1).otherwise(0)


def _with_rate(rows: DataFrame, goal: DataFrame, source: Column) -> DataFrame:
    """Joins targets, NULL sources too; a small table of targets is broadcast by its size."""
    table = goal.withColumnRenamed("source", "goal_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return rows.join(table, source.eqNullSafe(F.col("goal_source"))).withColumn("rate", rate)


def taken(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """Per document its size, its source's size and target, and the words the mix takes."""
    sized = settle(sizes(docs, text, source, key))
    rated = _with_rate(sized, settle(targets(sized)), F.col("source"))
    n = copies(F.col("rate"), F.col("doc_id"))
    return rated.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        n.alias("copies"),
        (n * F.col("size")).alias("taken"),
    )


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The documents, each as often as the mix takes it; the columns are those of ``docs``."""
    goal = settle(targets(sizes(docs, text, source, key)))
    rated = _with_rate(packed(docs), goal, F.col(f"doc.{source}"))
    n = copies(F.col("rate"), F.col(f"doc.{key}")).cast("int")
    return (
        rated.select("doc", n.alias("n"))
        .filter("n > 0")
        .select("doc", F.explode(F.array_repeat(F.lit(0), F.col("n"))))
        .select("doc.*")
    )
