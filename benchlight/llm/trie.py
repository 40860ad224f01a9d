"""The prefix trie of conversations, by union-find over sorted neighbours.

A turn is a digest of its role and text, a conversation the run of its digests. Equal runs
are counted once, sorted and cut into blocks. In a sorted block the longest common prefix
(LCP) of two runs is the least LCP of neighbours between them; so the edges between
neighbours are taken in descending LCP, and every merge of two components is a branching
node, at the depth of that LCP, over the nodes merged. Between a node and the one above it
lie nodes of one child each, written out when the forest is done.

Only prefixes of a block's first and last run can go on in the blocks beside it. These
nodes are left open and merged by their prefix. All that is counted adds up over blocks: a
block knows by the LCP with the run before it which of its open nodes an earlier block has
begun, and leaves those out where each node counts once. Nodes below an open node find its
least member once it is known.

Texts are read once and don't pass a shuffle. A conversation is one row of 28 bytes a turn.
A pile of equal conversations is one run with a count; the ids that end at a node are
written in order by ranges, and one task streams them into the hash, which has no other way.

Turns go by ``turn``, NULL first, and where that is equal by their digest; rows that repeat
are turns of their own. A NULL role or text is empty, and an empty or very long text is a
turn like any other. Rows without a conversation id belong to no conversation and are left
out. An empty table gives no nodes, not even a root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from benchlight.session import settle

# Conversations of so many in a row begin with the first of them.
GROUP = 100
MAX_HEAD = 5
# Runs a block has: 2 to the power of this.
BLOCK_BITS = 14
DIGEST = 16
PIECE_BYTES = 1 << 20
ROWS_OUT = 50_000

_NODES = (
    "conv_id bigint, depth bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint,"
    " open boolean, key binary, ends boolean, parent_conv_id bigint, parent_key binary"
)
_SUMS = ["n_convs", "n_children", "n_leaves", "saved_tokens"]


# --- conversations as runs of digests -------------------------------------------
def conversations(turns: DataFrame) -> DataFrame:
    """``conv_id`` and ``turns``, an array of (turn, digest in hexadecimal, code points)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # The length of the role keeps ("ab", "c") apart from ("a", "bc").
    body = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    digest = F.substring(F.sha2(body, 256), 1, 2 * DIGEST)
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(
            F.col("turn").alias("turn"), digest.alias("digest"), F.char_length(text).cast("int").alias("chars")
        ).alias("turn"),
    )
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


def _head_turns(conv_id: Column) -> Column:
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(MAX_HEAD + 1)).cast("int")


def rebuilt(turns: DataFrame) -> DataFrame:
    """``conv_id`` and ``turns``: a conversation that begins as the first of its hundred does."""
    whole = settle(conversations(turns))
    heads = whole.filter(F.col("conv_id") % GROUP == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, MAX_HEAD).alias("heads")
    )
    own = whole.select(
        "conv_id",
        (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"),
        _head_turns(F.col("conv_id")).alias("h"),
        "turns",
    )
    none = F.array().cast(whole.schema["turns"].dataType)
    joined = own.join(heads, "base", "left")
    head = F.slice(F.coalesce("heads", none), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return joined.select("conv_id", F.concat(head, rest).alias("turns"))


def runs(built: DataFrame) -> DataFrame:
    """Per conversation its run of digests ``seq``, the run's ``key`` and code points ``chars``."""
    with_run = built.select(
        "conv_id",
        F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("seq"),
        F.transform("turns", lambda t: t["chars"]).alias("chars"),
    )
    return with_run.withColumn("key", F.unhex(F.md5("seq")))


# --- the forest of one block ------------------------------------------------------
def common(a: bytes, b: bytes) -> int:
    """Turns that two runs begin with alike."""
    size = min(len(a), len(b))
    if a[:size] == b[:size]:
        return size // DIGEST
    one, two = np.frombuffer(a, np.uint8, size), np.frombuffer(b, np.uint8, size)
    return int((one != two).argmax()) // DIGEST


class Forest:
    """Union-find over a sorted block's runs; its components become nodes as they merge.

    ``left`` and ``right`` are the LCPs with the runs before and after the block, -1 where
    there are none.
    """

    def __init__(self, seqs: list[bytes], chars: np.ndarray, n: list[int], least: list[int], left: int, right: int):
        m = len(seqs)
        self.seqs, self.m, self.left, self.right = seqs, m, left, right
        self.depth = [len(s) // DIGEST for s in seqs]
        self.offset = np.concatenate([[0], np.cumsum(self.depth)])
        self.summed = np.concatenate([[0], np.cumsum(chars)]).tolist()
        self.n, self.least, self.first, self.last = list(n), list(least), list(range(m)), list(range(m))
        self.kids, self.saved = [0] * m, [0] * m
        # A run is a leaf until something longer joins it, be it in the next block.
        self.is_leaf = [not (i == m - 1 and right >= d) for i, d in enumerate(self.depth)]
        self.leaves = [int(x) for x in self.is_leaf]
        self.above, self.same = [-1] * m, list(range(m))
        self._grow()

    def _begun(self, x: int) -> int:
        """Depth to which an earlier block has begun the nodes over x."""
        return self.left if self.first[x] == 0 else -1

    def _chars(self, x: int, over: int, to: int) -> int:
        """Code points of the turns of x's prefix deeper than ``over``, up to ``to``."""
        at = int(self.offset[self.first[x]])
        return self.summed[at + to] - self.summed[at + over] if to > over else 0

    def _node(self, depth: int, like: int) -> int:
        x = len(self.depth)
        for values, value in (
            (self.depth, depth), (self.n, 0), (self.least, self.least[like]), (self.first, self.first[like]),
            (self.last, self.last[like]), (self.kids, 0), (self.saved, 0), (self.leaves, 0), (self.is_leaf, False),
            (self.above, -1), (self.same, x),
        ):
            values.append(value)
        return x

    def _take(self, v: int, x: int) -> None:
        self.n[v] += self.n[x]
        self.least[v] = min(self.least[v], self.least[x])
        self.first[v], self.last[v] = min(self.first[v], self.first[x]), max(self.last[v], self.last[x])
        self.leaves[v] += self.leaves[x] - self.is_leaf[v]
        self.is_leaf[v] = False
        self.saved[v] += self.saved[x]

    def _attach(self, x: int, v: int) -> None:
        """x, which is complete, and the nodes of one child over it come under v."""
        over, begun = self.depth[v], self._begun(x)
        self.saved[v] += self.n[x] * self._chars(x, over, self.depth[x])
        self.saved[v] -= self._chars(x, max(over, begun), self.depth[x])
        self.kids[v] += over + 1 > begun
        self._take(v, x)
        self.above[x] = v

    def _merge(self, a: int, b: int, depth: int) -> int:
        ends_a, ends_b = self.depth[a] == depth, self.depth[b] == depth
        if ends_a and ends_b:
            a, b = (a, b) if a < self.m else (b, a)  # a run that ends here gives its name
            self.kids[a] += self.kids[b]
            self._take(a, b)
            self.same[b] = a
            return a
        if not ends_a and not ends_b:
            v = self._node(depth, a)
            self._attach(a, v)
        else:
            v, b = (a, b) if ends_a else (b, a)
        self._attach(b, v)
        return v

    def _grow(self) -> None:
        m, seqs = self.m, self.seqs
        lcp = np.array([common(seqs[i], seqs[i + 1]) for i in range(m - 1)], np.int64)
        up, node = list(range(m)), list(range(m))

        def find(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        for i in np.argsort(-lcp, kind="stable").tolist():
            a, b = find(i), find(i + 1)
            node[a] = self._merge(node[a], node[b], int(lcp[i]))
            up[b] = a
        top = node[find(0)]
        if self.depth[top]:
            root = self._node(0, top)
            self._attach(top, root)
            top = root
        self.top = top

    def rows(self, keys: list[bytes]) -> Iterator[pa.RecordBatch]:
        """All nodes. ``keys`` are those of the runs."""
        nodes = np.array([x for x in range(len(self.depth)) if self.same[x] == x], np.int64)
        above = np.array([self._top_name(self.above[x]) for x in nodes.tolist()], np.int64)
        hi = np.array(self.depth, np.int64)[nodes]
        lo = np.where(above < 0, 0, np.array([self.depth[a] for a in above.tolist()], np.int64) + 1)
        edges = np.concatenate([[0], np.cumsum(hi - lo + 1)])
        at = 0
        while at < len(nodes):
            to = max(at + 1, int(np.searchsorted(edges, edges[at] + ROWS_OUT)))
            yield self._expanded(nodes[at:to], above[at:to], lo[at:to], hi[at:to], keys)
            at = to

    def _top_name(self, x: int) -> int:
        while x >= 0 and self.same[x] != x:
            x = self.same[x]
        return x

    def _expanded(self, nodes, above, lo, hi, keys) -> pa.RecordBatch:
        sizes = hi - lo + 1
        x, top, bottom = np.repeat(nodes, sizes), np.repeat(lo, sizes), np.repeat(hi, sizes)
        depth = top + np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)

        def of(values: list) -> np.ndarray:
            return np.array(values, np.int64)[x]

        first, last, n, least = of(self.first), of(self.last), of(self.n), of(self.least)
        begun = np.where(first == 0, self.left, -1)
        reach = np.maximum(begun, np.where(last == self.m - 1, self.right, -1))
        is_open, is_bottom = depth <= reach, depth == bottom
        summed, start = np.array(self.summed, np.int64), self.offset[first]
        below = np.maximum(depth - 1, 0)  # the root has no turn
        own = n * (summed[start + bottom] - summed[start + below])
        own -= summed[start + bottom] - summed[start + np.minimum(bottom, np.maximum(below, begun))]
        children = np.where(is_bottom, of(self.kids), depth + 1 > begun)
        ends = is_bottom & (x < self.m)
        key = [
            keys[f] if e and v < self.m else self._prefix(f, d) if o else None
            for v, f, d, e, o in zip(x.tolist(), first.tolist(), depth.tolist(), ends.tolist(), is_open.tolist(), strict=True)
        ]
        # A node that a run ends at carries that run's key; the run is the first of its node.
        parent = np.repeat(above, sizes)
        is_top = depth == top
        parent_least = np.where(is_top, np.array(self.least, np.int64)[parent], least)
        parent_first = np.where(is_top, np.array(self.first, np.int64)[parent], first)
        parent_last = np.where(is_top, np.array(self.last, np.int64)[parent], last)
        parent_reach = np.maximum(
            np.where(parent_first == 0, self.left, -1), np.where(parent_last == self.m - 1, self.right, -1)
        )
        is_root = depth == 0
        to_open = ~is_root & (depth - 1 <= parent_reach)
        parent_key = [
            self._prefix(f, d - 1) if o else None
            for f, d, o in zip(first.tolist(), depth.tolist(), to_open.tolist(), strict=True)
        ]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(least),
                pa.array(depth),
                pa.array(n),
                pa.array(children.astype(np.int64)),
                pa.array(of(self.leaves)),
                pa.array(of(self.saved) + own),
                pa.array(is_open),
                pa.array(key, pa.binary()),
                pa.array(ends),
                pa.array(parent_least, mask=is_root | to_open),
                pa.array(parent_key, pa.binary()),
            ],
            names=["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "open", "key", "ends",
                   "parent_conv_id", "parent_key"],
        )

    def _prefix(self, run: int, depth: int) -> bytes:
        return hashlib.md5(self.seqs[run][: DIGEST * depth], usedforsecurity=False).digest()


def _grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: runs come block by block, in order; each block's forest."""
    names = ["seq", "chars", "key", "n", "least"]

    def forest(block: dict) -> Iterator[pa.RecordBatch]:
        chars = np.array([c for part in block["chars"] for c in part], np.int64)
        grown = Forest(block["seq"], chars, block["n"], block["least"], block["left"], block["right"])
        yield from grown.rows(block["key"])

    block: dict | None = None
    for rows in batches:
        columns = {c: rows.column(c).to_pylist() for c in ["part", "left", "right", *names]}
        parts = np.array(columns["part"])
        edges = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
        for begin, end in zip(edges[:-1], edges[1:], strict=True):
            if begin == end:
                continue
            if block is not None and block["part"] != columns["part"][begin]:
                yield from forest(block)
                block = None
            if block is None:
                block = {c: columns[c][begin] for c in ("part", "left", "right")} | {c: [] for c in names}
            for c in names:
                block[c].extend(columns[c][begin:end])
    if block is not None:
        yield from forest(block)


# --- over blocks --------------------------------------------------------------------
def _blocks(table: DataFrame, block_bits: int) -> DataFrame:
    """Different runs in order, each with its block and the block's LCPs to either side."""
    different = table.groupBy("seq").agg(
        F.first("key").alias("key"),
        F.first("chars").alias("chars"),
        F.count(F.lit(1)).alias("n"),
        F.min("conv_id").alias("least"),
    )
    placed = different.repartitionByRange("seq").sortWithinPartitions("seq").withColumn(
        "place", F.monotonically_increasing_id()
    )
    ordered = settle(placed.withColumn("part", F.shiftright("place", block_bits)))

    @F.pandas_udf("int")
    def lcp(before: pd.Series, after: pd.Series) -> pd.Series:
        pairs = zip(before, after, strict=True)
        return pd.Series([-1 if a is None or b is None else common(a, b) for a, b in pairs], dtype="int32")

    # One row per block.
    by_place = Window.orderBy("part")
    edges = ordered.groupBy("part").agg(F.min("seq").alias("head"), F.max("seq").alias("tail"))
    beside = edges.select(
        "part", "head", "tail", F.lag("tail").over(by_place).alias("before"), F.lead("head").over(by_place).alias("after")
    )
    sides = settle(beside.select("part", lcp("before", "head").alias("left"), lcp("tail", "after").alias("right")))
    return ordered.join(sides, "part").repartition("part").sortWithinPartitions("part", "place")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids in order, joined by commas, in pieces of one key."""
    key, ids, size = None, [], 0
    done: list[tuple] = []

    def cut() -> None:
        if ids:
            done.append((key, ids[0], ",".join(map(str, ids))))

    def flushed() -> pa.RecordBatch:
        columns = zip(*done, strict=True)
        kinds = [pa.binary(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "start", "body"]
        )

    for rows in batches:
        for k, conv_id in zip(rows.column("key").to_pylist(), rows.column("conv_id").to_pylist(), strict=True):
            if k != key or 20 * len(ids) > PIECE_BYTES:
                cut()
                key, ids = k, []
            ids.append(conv_id)
        size = sum(len(d[2]) for d in done)
        if len(done) > 5_000 or size > PIECE_BYTES:
            yield flushed()
            done = []
    cut()
    if done:
        yield flushed()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order: the hash of all of a key's, streamed."""
    key, hashed = None, hashlib.sha256()
    done: list[tuple] = []
    for rows in batches:
        for k, body in zip(rows.column("key").to_pylist(), rows.column("body").to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    done.append((key, hashed.hexdigest()))
                key, hashed = k, hashlib.sha256()
            else:
                hashed.update(b",")
            hashed.update(body.encode())
        if done:
            yield _digests(done)
            done = []
    if key is not None:
        yield _digests([(key, hashed.hexdigest())])


def _digests(done: list[tuple]) -> pa.RecordBatch:
    keys, digests = zip(*done, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests)], names=["key", "ends_sha256"])


def _ends(table: DataFrame) -> DataFrame:
    """Per run's ``key`` the hash of the ids of the conversations that are that run."""
    ordered = table.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = ordered.mapInArrow(_pieces, "key binary, start bigint, body string")
    return pieces.repartition("key").sortWithinPartitions("key", "start").mapInArrow(
        _hashed, "key binary, ends_sha256 string"
    )


def trie(built: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """One row per node of the trie of conversations (``conv_id``, ``turns``), as ``rebuilt`` gives them."""
    table = settle(runs(built))
    nodes = settle(_blocks(table, block_bits).mapInArrow(_grown, _NODES))
    merged = settle(
        nodes.filter("open")
        .groupBy("key")
        .agg(
            F.min("conv_id").alias("conv_id"),
            F.first("depth").alias("depth"),
            *[F.sum(c).alias(c) for c in _SUMS],
            F.max("ends").alias("ends"),
            F.max("parent_key").alias("parent_key"),
        )
    )
    columns = ["conv_id", "depth", *_SUMS, "key", "ends", "parent_conv_id", "parent_key"]
    every = nodes.filter("NOT open").select(columns).unionByName(
        merged.withColumn("parent_conv_id", F.lit(None).cast("bigint")).select(columns)
    )
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("found"))
    under = every.filter("parent_key IS NOT NULL").join(parents, "parent_key")
    known = every.filter("parent_key IS NULL").unionByName(
        under.withColumn("parent_conv_id", F.col("found")).select(columns)
    )
    named = ["conv_id", "depth", "parent_conv_id", *_SUMS]
    ending = known.filter("ends").join(_ends(table), "key").select(*named, "ends_sha256")
    passing = known.filter("NOT ends").select(*named, F.lit(hashlib.sha256().hexdigest()).alias("ends_sha256"))
    return ending.unionByName(passing)


def prefix_trie(turns: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """The trie of the rebuilt conversations of a table of turns (``conv_id, turn, role, text``)."""
    return trie(rebuilt(turns), block_bits)
