"""SimHash near-duplicates, found by vantage-point trees.

Distinct fingerprints, not documents, are compared. The upper levels of one tree, built
from a bounded sample, deal them out to shards: at each vantage point a fingerprint goes
inside or outside the median distance. As a query it also goes where the triangle
inequality can't rule out a partner: down both sides if its distance is within the
radius of the border. Every shard continues the tree over its own fingerprints, in
blocks of arrays, down to blocks that are compared outright. So every pair is found.

A shard hands on no pairs but one edge per linked fingerprint, to the least of its
linked set; components of these edges are the groups.

Text NULL or without words: fingerprint zero, linked like any other. Ids may repeat or
be NULL: a NULL id is never a component's id unless it has no other. Rows are numbered
by position, so ``representatives`` needs a table's rows. An empty table gives an empty
result. Other columns pass through, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchlight.llm.components import components
from benchlight.llm.texts import packed, row_number
from benchlight.session import settle

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
# Fingerprints a shard holds, about; the sample the upper tree is built from.
SHARD_ROWS = 16_384
SAMPLE_ROWS = 65_536
LEAF_ROWS = 64
BLOCK = 1 << 20
BLOCK_SHINGLES = 1 << 15


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The fingerprint of one text, as an unsigned number."""
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII blanks
    if not words:
        return 0
    if len(words) < shingle_words:
        parts: Iterator = iter([words])
        n = 1
    else:
        parts = zip(*[words[i:] for i in range(shingle_words)], strict=False)
        n = len(words) - shingle_words + 1
    counts = np.zeros(64, np.int64)
    left = n
    while left:
        size = min(left, BLOCK_SHINGLES)
        digests = b"".join([xxhash.xxh64_digest(b" ".join(p), seed) for p in islice(parts, size)])
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int32)
        left -= size
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(
    docs: DataFrame, text: str = "text", key: str = "doc_id", shingle_words: int = SHINGLE_WORDS
) -> DataFrame:
    """Per row its number ``row``, ``doc_id`` and fingerprint ``fp``, a signed number."""

    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        values = [fingerprint(t.encode() if t else b"", shingle_words) for t in texts]
        return pd.Series(np.array(values, np.uint64).view(np.int64))

    return docs.select(
        row_number(docs).alias("row"),
        F.col(key).alias("doc_id"),
        of(F.col(text).cast("string")).alias("fp"),
    )


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def upper_tree(sample: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and median distances in heap order; -1 where a branch ends."""
    points = np.zeros((1 << levels) - 1, np.uint64)
    medians = np.full((1 << levels) - 1, -1, np.int16)
    parts = {0: sample}
    for at in range(len(points)):
        own = parts.pop(at, None)
        if own is None or (best := _vantage(own)) is None:
            continue
        points[at], medians[at], inside = best
        parts[2 * at + 1], parts[2 * at + 2] = own[inside], own[~inside]
    return points, medians


def _vantage(own: np.ndarray) -> tuple[np.uint64, int, np.ndarray] | None:
    """Of a few points the one whose median parts the rest best; None if none does."""
    best = None
    for point in own[:: max(1, len(own) // 5)][:5]:
        distance = np.bitwise_count(own ^ point)
        median = int(np.median(distance))
        inside = distance <= median
        near = int((np.abs(distance.astype(np.int16) - median) <= RADIUS).sum())
        if 0 < inside.sum() < len(own) and (best is None or near < best[0]):
            best = (near, point, median, inside)
    return best and best[1:]


def _deal(points: np.ndarray, medians: np.ndarray, radius: int):
    """Each fingerprint at home in one shard, and a guest wherever a partner may live."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            fp = rows["fp"].to_numpy().view(np.uint64)
            index, at, home = np.arange(len(fp)), np.zeros(len(fp), np.int64), np.ones(len(fp), bool)
            out = []
            while len(index):
                ends = at >= len(points)
                ends[~ends] = medians[at[~ends]] < 0
                out.append((index[ends], at[ends], home[ends]))
                index, at, home = index[~ends], at[~ends], home[~ends]
                distance = np.bitwise_count(fp[index] ^ points[at]).astype(np.int16)
                median = medians[at]
                is_in = distance <= median
                to_in, to_out = distance - radius <= median, distance + radius > median
                index = np.concatenate([index[to_in], index[to_out]])
                home = np.concatenate([(home & is_in)[to_in], (home & ~is_in)[to_out]])
                at = np.concatenate([2 * at[to_in] + 1, 2 * at[to_out] + 2])
            i, shard, home = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pd.DataFrame({"shard": shard, "fp": fp[i].view(np.int64), "home": home})

    return run


def near_pairs(points: np.ndarray, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (query, point) positions within the radius, in blocks: the lower tree."""
    stack = [(np.arange(len(points)), np.arange(len(queries)))]
    while stack:
        p, q = stack.pop()
        if not len(p) or not len(q):
            continue
        best = _vantage(points[p]) if len(p) > LEAF_ROWS else None
        if best is None:
            step = max(1, BLOCK // len(p))
            for i in range(0, len(q), step):
                near = np.bitwise_count(queries[q[i : i + step], None] ^ points[None, p]) <= radius
                a, b = np.nonzero(near)
                yield q[i : i + step][a], p[b]
            continue
        point, median, inside = best
        distance = np.bitwise_count(queries[q] ^ point).astype(np.int16)
        stack.append((p[inside], q[distance - radius <= median]))
        stack.append((p[~inside], q[distance + radius > median]))


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a and b, pair by pair; the least position of a set is its root."""
    while len(a):
        a, b = _roots(parent, a), _roots(parent, b)
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def _roots(parent: np.ndarray, of: np.ndarray) -> np.ndarray:
    while True:
        up = parent[of]
        if (up == of).all():
            return of
        of = up


def _linked(radius: int):
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("fp", ignore_index=True)
        fp, home = shard["fp"].to_numpy(), np.flatnonzero(shard["home"].to_numpy())
        unsigned, parent = fp.view(np.uint64), np.arange(len(fp))
        for q, p in near_pairs(unsigned[home], unsigned, radius):
            p = home[p]
            unite(parent, q[q != p], p[q != p])
        roots = _roots(parent, np.arange(len(fp)))
        linked = roots != np.arange(len(fp))
        return pd.DataFrame({"u": fp[linked], "v": fp[roots[linked]]})

    return run


def links(nodes: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Edges (u, v) that connect all fingerprints ``fp`` within the radius of each other.

    ``nodes`` has one row per distinct fingerprint and is a written table.
    """
    n = nodes.count()
    levels = min(max(0, math.ceil(math.log2(max(n, 1) / shard_rows))), int(math.log2(SAMPLE_ROWS)) - 4)
    share = min(1.0, SAMPLE_ROWS / max(n, 1))
    drawn = nodes.select("fp").filter(
        F.pmod(F.xxhash64(F.col("fp")), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    )
    sample = np.array([r[0] for r in drawn.limit(2 * SAMPLE_ROWS).collect()], np.int64)
    points, medians = upper_tree(np.sort(sample).view(np.uint64), levels)
    dealt = nodes.select("fp").mapInPandas(_deal(points, medians, radius), "shard bigint, fp bigint, home boolean")
    return dealt.groupBy("shard").applyInPandas(_linked(radius), "u bigint, v bigint")


def grouped(rows: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``row``, ``doc_id``, ``fp`` with ``root``, the least fingerprint of the group, and
    ``component_id``, its smallest id. ``rows`` is what ``fingerprints`` gives, written."""
    nodes = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(nodes, radius, shard_rows)).withColumnRenamed("node", "fp")
    rooted = settle(
        nodes.join(found, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    )
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = settle(rooted.join(ids, "root").select("fp", "root", "component_id"))
    return rows.join(placed, "fp")


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    shingle_words: int = SHINGLE_WORDS,
    radius: int = RADIUS,
) -> DataFrame:
    """One row per document: ``row``, ``doc_id``, ``fingerprint``, ``component_id``."""
    rows = settle(fingerprints(docs, text, key, shingle_words))
    return grouped(rows, radius).select(
        "row", "doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id", "root"
    )


def representatives(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    shingle_words: int = SHINGLE_WORDS,
    radius: int = RADIUS,
) -> DataFrame:
    """The documents with one of each group left, that of the smallest id; ``docs``' columns."""
    found = near_duplicates(docs, text, key, shingle_words, radius)
    staying = (
        found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("root")
        .agg(F.min("row").alias("row"))
        .select("row")
    )
    numbered = packed(docs, row=row_number(docs))
    return numbered.join(settle(staying).hint("merge"), "row", "left_semi").select("doc.*")
