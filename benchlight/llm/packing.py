"""Best-fit packing into sequences of several permitted lengths.

A document longer than the largest capacity fills whole sequences first; what is left
of every document is one item. Items are dealt out to shards of bounded size by a hash
of their row, and each shard packs its items by best fit, longest first: an item goes
where least room stays. Where it fits nowhere a sequence is opened, of the capacity
that costs least per word it can expect to hold, given the items that are still to
come. At the end every sequence shrinks to the least capacity that holds its contents.

Rows that repeat are packed each; a NULL id is kept. A length of NULL or below one has
no pieces. A very long text fills many whole sequences. An empty table gives no pieces.
Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchlight.llm.texts import n_words, row_number, whole
from benchlight.session import settle

CAPACITIES = (512, 1024, 2048, 4096, 8192)
# A sequence costs its length, attention over it, and a fixed part.
ATTENTION = 16_384
FIXED = 64
SHARD_ITEMS = 50_000

_PIECES = "doc_id string, row bigint, sequence string, capacity int, offset int, start bigint, length int"


def cost(capacity: int) -> float:
    return FIXED + capacity * (1 + capacity / ATTENTION)


def best_fit(lengths: np.ndarray, capacities: Sequence[int] = CAPACITIES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For items in descending length: the bin, the offset in it, and every bin's capacity."""
    largest = max(capacities)
    waiting = np.bincount(lengths, weights=lengths, minlength=largest + 1).cumsum()
    prices = [(c, cost(c)) for c in sorted(capacities)]
    room: dict[int, list[int]] = {}
    free = 0  # bit r is set while some bin has room r
    used: list[int] = []
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    total, placed = int(lengths.sum()), 0
    for i, length in enumerate(lengths.tolist()):
        fitting = free >> length
        if fitting:
            left = length + (fitting & -fitting).bit_length() - 1
            at = room[left].pop()
            if not room[left]:
                free ^= 1 << left
        else:
            # Items come longest first: shorter ones are all still to come.
            to_come = float(total - placed - length)
            left, at = 0, len(used)
            least = math.inf
            for capacity, price in prices:
                beside = capacity - length
                if beside < 0:
                    continue
                expected = length + min(beside, float(waiting[beside]) if beside < length else to_come)
                if price / expected < least:
                    least, left = price / expected, capacity
            used.append(0)
        bins[i], offsets[i] = at, used[at]
        used[at] += length
        placed += length
        left -= length
        if left:
            room.setdefault(left, []).append(at)
            free |= 1 << left
    fitted = np.array(sorted(capacities))
    return bins, offsets, fitted[np.searchsorted(fitted, used)]


def _shard(capacities: Sequence[int]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["length", "row"], ascending=[False, True], ignore_index=True)
        bins, offsets, sizes = best_fit(items["length"].to_numpy(), capacities)
        shard = items["shard"].iloc[0]
        return pd.DataFrame(
            {
                "doc_id": items["doc_id"],
                "row": items["row"],
                "sequence": [f"s{shard}-{b}" for b in bins.tolist()],
                "capacity": sizes[bins].astype(np.int32),
                "offset": offsets.astype(np.int32),
                "start": items["start"],
                "length": items["length"].astype(np.int32),
            }
        )

    return run


def pack(
    items: DataFrame, capacities: Sequence[int] = CAPACITIES, shard_items: int = SHARD_ITEMS
) -> DataFrame:
    """Where every piece of every document goes: its sequence, that one's capacity, the
    offset in it, and the piece's start and length in the document.

    ``items`` has ``row``, unique, ``doc_id`` of any type and ``length``, and is a written
    table. Ids travel as text, which keeps their value beside NULL.
    """
    largest, id_type = max(capacities), items.schema["doc_id"].dataType
    full = F.floor(F.col("length") / largest).cast("bigint")
    cut = items.filter("length > 0").select(F.col("doc_id").cast("string").alias("doc_id"), "row", "length", full.alias("full"))
    at = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).alias("at")
    whole_pieces = cut.filter("full > 0").select("doc_id", "row", at).select(
        "doc_id",
        "row",
        F.concat(F.lit("w"), F.col("row").cast("string"), F.lit("-"), F.col("at").cast("string")).alias("sequence"),
        F.lit(largest).alias("capacity"),
        F.lit(0).alias("offset"),
        (F.col("at") * largest).alias("start"),
        F.lit(largest).alias("length"),
    )
    shards = max(1, math.ceil(items.count() / shard_items))
    rest = cut.select(
        F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"),
        "doc_id",
        "row",
        (F.col("full") * largest).alias("start"),
        (F.col("length") - F.col("full") * largest).cast("int").alias("length"),
    ).filter("length > 0")
    pieces = whole_pieces.unionByName(rest.groupBy("shard").applyInPandas(_shard(capacities), _PIECES))
    return pieces.withColumn("doc_id", F.col("doc_id").cast(id_type))


def lengths(docs: DataFrame, length: Column, key: str = "doc_id") -> DataFrame:
    """``row``, ``doc_id`` and ``length`` of every document, written."""
    return settle(
        docs.select(
            row_number(docs).alias("row"),
            F.col(key).alias("doc_id"),
            length.cast("bigint").alias("length"),
        )
    )


def pack_documents(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Packs whole texts by their words, an end mark added to each."""
    return pack(lengths(docs, n_words(whole(text)) + 1, key))
