"""Near-duplicate vectors by cross-polytope hashing.

Equal vectors are one node with a count, so a pile of copies is one entry. A node is turned
by random signs and fast Hadamard transforms, three times; the nearest corner of the cross
polytope, the largest coordinate with its sign, is its hash. A table's bucket is named by
several such hashes. A node lives in its home bucket of every table and is a guest in the
buckets of its next-best corners (multiprobe). Homes are compared with homes and guests,
and the cosine of every pair is worked out in double precision.

A bucket emits no pairs, but per linked node how many vectors it links and one edge to the
least node it is joined with. A pair that meets in several buckets counts in the first of
them: tasks know that from the codes of both nodes, which they work out from the vectors.
A bucket of more than ``SPLIT_ROWS`` entries is dealt out to blocks, and each pair of blocks
is a task, so a bucket never gathers in one; its pairs are all compared.

The number of hashes a bucket has follows the number of nodes, that of tables the number of
hashes: at a cosine of 0.95 a pair is expected to be met with probability 0.99 or more.

A vector that is NULL, empty, zero or holds a NULL or non-finite component links with nothing; vectors
of unlike lengths never link. Rows that repeat and ids that repeat or are NULL are vectors
of their own. A NULL id is no component's id unless there is no other. Vectors may have any
length. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from benchlight.llm.components import components
from benchlight.llm.simhash import _roots, unite
from benchlight.session import settle

MIN_COSINE = 0.95
SEED = 11
ROUNDS = 3
# Nodes a bucket holds, about; the buckets a node is in, per table; corners tried per hash.
BUCKET_ROWS = 64
PROBES = 4
RANKS = 3
MAX_HASHES = 6
# Entries a task compares at once.
SPLIT_ROWS = 8192
BLOCK = 1 << 21

_ROWS = "key binary, dim int, vector binary"
_CODES = "place int, bucket bigint"
_ENTRIES = "place int, bucket bigint, home boolean, node bigint, copies bigint, vector binary"
_FOUND = "node bigint, n_links bigint, root bigint"


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of each row; their length is a power of two."""
    n, half = x.shape[1], 1
    while half < n:
        y = x.reshape(-1, n // (2 * half), 2, half)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(-1, n)
        half *= 2
    return x / math.sqrt(n)


class Tables:
    """The hash functions of all tables for vectors of any length."""

    def __init__(self, hashes: int, tables: int, probes: int = PROBES, seed: int = SEED):
        self.hashes, self.tables, self.probes, self.seed = hashes, tables, probes, seed
        self.signs: dict[int, np.ndarray] = {}

    def _corners(self, vectors: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
        """The best corners of each vector under one hash function, and how far they reach."""
        size = vectors.shape[1]
        if size not in self.signs:
            rng = np.random.default_rng([self.seed, size])
            self.signs[size] = rng.choice([-1.0, 1.0], (self.tables * self.hashes, ROUNDS, size))
        for signs in self.signs[size][at]:
            vectors = hadamard(vectors * signs)
        reach = np.abs(vectors)
        best = np.argsort(-reach, axis=1, kind="stable")[:, : min(RANKS, size)]
        values = np.take_along_axis(vectors, best, axis=1)
        return 2 * best + (values < 0), np.abs(values)

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """Per vector and table its home bucket, then its guest buckets; -1 where there are fewer."""
        n, dim = vectors.shape
        size = 1 << max(0, dim - 1).bit_length()
        padded = np.zeros((n, size))
        padded[:, :dim] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        out = np.full((n, self.tables, self.probes), -1, np.int64)
        ranks = list(itertools.product(range(min(RANKS, size)), repeat=self.hashes))
        for t in range(self.tables):
            costs, codes = np.zeros((n, len(ranks))), np.zeros((n, len(ranks)), np.int64)
            for k in range(self.hashes):
                corner, reach = self._corners(padded, t * self.hashes + k)
                chosen = [r[k] for r in ranks]
                costs += (reach[:, :1] - reach[:, chosen]) ** 2
                codes = codes * (2 * size) + corner[:, chosen]
            # The home costs nothing and comes first, also among ties.
            cheapest = np.argsort(costs, axis=1, kind="stable")[:, : self.probes]
            out[:, t, : cheapest.shape[1]] = np.take_along_axis(codes, cheapest, axis=1)
        return out


def _usable(values: list | None) -> bool:
    if not values or any(v is None for v in values):
        return False
    # A zero vector, or one whose length can't be written as a double, has no direction.
    length = math.hypot(*values)
    return 0 < length < math.inf


def _keyed(kind: str) -> Callable:
    """Map task: a digest, the length and the bytes of each vector; NULL where it has no direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keys, dims, vectors = [], [], []
            for values in rows.column(0).to_pylist():
                if _usable(values):
                    raw = (np.array(values, kind) + 0.0).tobytes()  # minus zero is zero
                    keys.append(hashlib.md5(raw, usedforsecurity=False).digest())
                    dims.append(len(values))
                    vectors.append(raw)
                else:
                    keys.append(None), dims.append(None), vectors.append(None)
            columns = [pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(vectors, pa.binary())]
            passed = [rows.column(i) for i in range(1, rows.num_columns)]
            names = ["key", "dim", "vector", *rows.schema.names[1:]]
            yield pa.RecordBatch.from_arrays(columns + passed, names=names)

    return run


def _matrix(raw: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(float)


def _by_length(raw: list[bytes], kind: str, tables: Tables) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the vectors of one length, and their codes."""
    lengths = np.array([len(v) for v in raw])
    for length in np.unique(lengths):
        own = np.flatnonzero(lengths == length)
        for part in np.array_split(own, -(-len(own) // 4096)):
            yield part, tables.codes(_matrix([raw[i] for i in part], kind))


def _places(codes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(vector, place, bucket, home) of every entry; a place is a table for one length."""
    vector, table, probe = np.nonzero(codes >= 0)
    place = (table + 64 * length).astype(np.int32)
    return vector, place, codes[vector, table, probe], probe == 0


def _coded(kind: str, tables: Tables) -> Callable:
    """Map task: the buckets of all entries, without vectors, to be counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            raw = rows.column(0).to_pylist()
            for own, codes in _by_length(raw, kind, tables) if raw else ():
                _, place, bucket, _ = _places(codes, len(raw[own[0]]))
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(bucket)], names=["place", "bucket"])

    return run


def _entered(kind: str, tables: Tables) -> Callable:
    """Map task: every node in its home and as a guest, in every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            raw = rows.column("vector").to_pylist()
            node, copies = (rows.column(c).to_numpy() for c in ("node", "copies"))
            for own, codes in _by_length(raw, kind, tables) if raw else ():
                vector, place, bucket, home = _places(codes, len(raw[own[0]]))
                who = own[vector]
                columns = [place, bucket, home, node[who], copies[who]]
                vectors = pa.array([raw[i] for i in who], pa.binary())
                names = ["place", "bucket", "home", "node", "copies", "vector"]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), vectors], names=names)

    return run


def linked_pairs(own: np.ndarray, all_: np.ndarray, min_cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (own, all) of the pairs with that cosine or more, in blocks."""
    lengths = np.linalg.norm(all_, axis=1)
    step = max(1, BLOCK // max(1, len(all_)))
    for i in range(0, len(own), step):
        part = own[i : i + step]
        cosine = (part @ all_.T) / (np.linalg.norm(part, axis=1)[:, None] * lengths)
        a, b = np.nonzero(cosine >= min_cosine)
        yield i + a, b


def _first_meeting(one: np.ndarray, two: np.ndarray, table: int, bucket: int) -> np.ndarray:
    """Whether this table and bucket are the first in which two nodes of these codes meet."""
    to_one = (two == one[:, :, :1]).any(axis=2)  # the second comes to the home of the first
    to_two = (one == two[:, :, :1]).any(axis=2)
    first = (to_one | to_two).argmax(axis=1) == table
    least = np.minimum(one[:, table, 0], two[:, table, 0])
    return first & (~(to_one[:, table] & to_two[:, table]) | (least == bucket))


def _compared(kind: str, tables: Tables, min_cosine: float) -> Callable:
    """Task: entries come bucket by bucket; links are counted and joined, not listed."""
    keys = ["place", "bucket", "low", "high"]

    def bucket_links(rows: pa.Table) -> pa.RecordBatch | None:
        home, node, copies, salt = (rows[c].to_numpy() for c in ("home", "node", "copies", "salt"))
        place, bucket, low, high = (rows[c][0].as_py() for c in keys)
        if len(node) < 2 or not home.any():
            return None
        vectors = _matrix(rows["vector"].to_pylist(), kind)
        homes, codes = np.flatnonzero(home), None
        n_links, parent = np.zeros(len(node), np.int64), np.arange(len(node))
        for a, b in linked_pairs(vectors[homes], vectors, min_cosine):
            a = homes[a]
            # Each pair once, and in a split bucket only between the two blocks.
            wanted = (a != b) & (~home[b] | (a < b))
            if low != high:
                wanted &= salt[a] != salt[b]
            a, b = a[wanted], b[wanted]
            if not len(a):
                continue
            codes = tables.codes(vectors) if codes is None else codes
            first = np.concatenate([
                _first_meeting(codes[a[i : i + 65_536]], codes[b[i : i + 65_536]], place % 64, bucket)
                for i in range(0, len(a), 65_536)
            ])
            a, b = a[first], b[first]
            np.add.at(n_links, a, copies[b])
            np.add.at(n_links, b, copies[a])
            unite(parent, a, b)
        linked = np.flatnonzero(n_links)
        if not len(linked):
            return None
        # Rows are in node order, so the least position is the least node.
        root = node[_roots(parent, linked)]
        columns = [node[linked], n_links[linked], root]
        return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["node", "n_links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if carried is not None:
                rows = pa.concat_tables([carried, rows]).combine_chunks()
            if not rows.num_rows:
                continue
            columns = [rows[c].to_numpy() for c in keys]
            turns = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            edges = [0, *turns.tolist()]
            for begin, end in zip(edges[:-1], edges[1:], strict=True):
                if (found := bucket_links(rows.slice(begin, end - begin))) is not None:
                    yield found
            carried = rows.slice(edges[-1])
        if carried is not None and (found := bucket_links(carried)) is not None:
            yield found

    return run


def sizes(n: int, dim: int, bucket_rows: int = BUCKET_ROWS) -> tuple[int, int]:
    """Hashes a bucket's name has and the number of tables, for so many nodes."""
    corners = 2 * (1 << max(1, dim - 1).bit_length())
    hashes = math.ceil(math.log(max(n / bucket_rows, 1), corners))
    hashes = min(max(1, hashes), MAX_HASHES)
    return hashes, 2 * hashes


def links(
    nodes: DataFrame, kind: str, tables: Tables, min_cosine: float = MIN_COSINE, split_rows: int = SPLIT_ROWS
) -> DataFrame:
    """Per bucket and linked node: how many vectors it links there, and the least node it
    is joined with. ``nodes`` (``node``, ``copies``, ``vector``) is a written table."""
    codes = nodes.select("vector").mapInArrow(_coded(kind, tables), _CODES)
    full = codes.groupBy("place", "bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > split_rows)
    # One row per full bucket, each of which holds more entries than split_rows.
    blocks = settle(full.select("place", "bucket", F.ceil(F.col("n") / split_rows).cast("int").alias("blocks")))
    entries = nodes.select("node", "copies", "vector").mapInArrow(_entered(kind, tables), _ENTRIES)
    dealt = entries.join(blocks, ["place", "bucket"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select(
        "place", "bucket", F.least("salt", "other").alias("low"), F.greatest("salt", "other").alias("high"),
        "node", "home", "copies", "salt", "vector",
    )
    where = ["place", "bucket", "low", "high"]
    ordered = dealt.repartition(*where).sortWithinPartitions(*where, "node")
    return ordered.mapInArrow(_compared(kind, tables, min_cosine), _FOUND)


def near_vectors(
    table: DataFrame,
    vector: str = "embedding",
    key: str = "vec_id",
    min_cosine: float = MIN_COSINE,
    bucket_rows: int = BUCKET_ROWS,
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """One row per vector: its id ``vec_id``, ``n_links``, ``component_id`` and ``kept``."""
    of = table.schema[vector].dataType
    if not isinstance(of, ArrayType):
        raise ValueError(f"{vector} is no array of numbers")
    kind = "<f8" if isinstance(of.elementType, DoubleType) else "<f4"
    plain = F.col(vector) if kind == "<f4" else F.col(vector).cast("array<double>")
    id_type = table.schema[key].dataType.simpleString()
    rows = settle(
        table.select(plain.alias("v"), F.col(key).alias("vec_id")).mapInArrow(
            _keyed(kind), f"{_ROWS}, vec_id {id_type}"
        )
    )
    equal = rows.filter("key IS NOT NULL").groupBy("key").agg(
        F.first("vector").alias("vector"),
        F.first("dim").alias("dim"),
        F.count(F.lit(1)).alias("copies"),
        F.min("vec_id").alias("least"),
    )
    nodes = settle(equal.withColumn("node", F.monotonically_increasing_id()))
    n, dim = nodes.agg(F.count(F.lit(1)), F.coalesce(F.max("dim"), F.lit(1))).first()
    found = settle(links(nodes, kind, Tables(*sizes(n, dim, bucket_rows)), min_cosine, split_rows))
    counts = found.groupBy("node").agg(F.sum("n_links").alias("links"))
    roots = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    placed = settle(
        nodes.select("node", "key", "copies", "least")
        .join(counts, "node", "left")
        .join(roots, "node", "left")
        .select("key", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                F.coalesce("root", "node").alias("root"))
    )
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    known = placed.join(ids, "root").select("key", "n_links", "component_id")
    alone = rows.filter("key IS NULL").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    together = rows.filter("key IS NOT NULL").join(known, "key").select("vec_id", "n_links", "component_id")
    return together.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
