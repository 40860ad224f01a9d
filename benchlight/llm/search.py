"""Ranked lexical search of many queries at once, sharing their common parts.

Queries come in blocks, of which the driver holds one. Sets of terms that several queries
of a block share are mined: first terms that stand in the same queries, then, greedily, the
pair of such sets that most queries have together, until no pair is shared. What comes out
is a graph without cycles: a shared set is made of terms and smaller shared sets, a query
of terms and shared sets.

The documents are read once per block into postings: which of the block's terms a document
has, how often, and how many terms in all. Counts over all documents follow from these. A
second pass over the postings works out, for some documents at a time, the part of the score
of every shared set once, adds it up along the graph, and keeps each query's best. So a task
hands on as many rows as are asked for, per query; they are merged by salt, then by query.

Only term counts within one document, and the queries of one block, are held in memory.

A NULL text, of a document or a query, has no terms. A query without terms, or without a
document that has one, gives no rows. Rows that repeat are documents, and queries, of their
own. Ids are whole numbers; a NULL document id comes after all others of its score. Texts
may be very long: their terms are counted piece by piece. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from benchlight.session import settle

TOP = 50
# Queries, and terms of theirs, that one block may have.
BLOCK_QUERIES = 1024
BLOCK_TERMS = 200_000
# Sets of a query, the most shared ones, among which pairs are sought. Others are added one by one.
MINED = 64
# Numbers a task holds at once while it scores.
CELLS = 1 << 22
PIECE = 4 << 20
SALTS = 64

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or b in _KEEP else 32 for b in range(256)
)
_POSTINGS = "doc_id bigint, n bigint, terms binary, counts binary"
_BEST = "query int, doc_id bigint, score bigint"


# --- terms ------------------------------------------------------------------------
def term_counts(text: bytes | None) -> Counter:
    """How often each term stands in a text: runs of ASCII letters in lower case, digits and
    all that isn't ASCII."""
    if not text or len(text) <= PIECE:
        return Counter((text or b"").translate(_TABLE).split())
    plain, counts, at = text.translate(_TABLE), Counter(), 0
    while at < len(plain):
        to = plain.find(b" ", at + PIECE)
        to = len(plain) if to < 0 else to
        counts.update(plain[at:to].split())
        at = to
    return counts


# --- what queries share -------------------------------------------------------------
@dataclass
class Plan:
    """Terms of a block of queries, its shared sets in order of making, and the queries.

    A set, and a query, is a pair of arrays: terms and sets it is the sum of.
    """

    terms: dict[bytes, int] = field(default_factory=dict)
    shared: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    queries: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)


def _parts(terms: Iterable[int], sets: Iterable[int]) -> tuple[np.ndarray, np.ndarray]:
    return np.array(sorted(terms), np.int64), np.array(sorted(sets), np.int64)


def plan(queries: list[set[bytes]]) -> Plan:
    """Mines what the queries share."""
    made = Plan()
    where: dict[bytes, list[int]] = defaultdict(list)
    for q, terms in enumerate(queries):
        for term in terms:
            where[term].append(q)
    made.terms = {term: i for i, term in enumerate(sorted(where))}
    # Terms that stand in the same queries are one set.
    alike: dict[tuple[int, ...], list[int]] = defaultdict(list)
    for term, i in made.terms.items():
        alike[tuple(where[term])].append(i)
    alone: list[list[int]] = [[] for _ in queries]  # terms
    held: list[set[int]] = [set() for _ in queries]  # shared sets
    members: list[set[int]] = []
    for at, terms in sorted(alike.items()):
        if len(at) == 1:
            alone[at[0]].extend(terms)
            continue
        for q in at:
            held[q].add(len(made.shared))
        made.shared.append(_parts(terms, ()))
        members.append(set(at))
    _join_pairs(made, held, members)
    made.queries = [_parts(a, h) for a, h in zip(alone, held, strict=True)]
    return made


def _join_pairs(made: Plan, held: list[set[int]], members: list[set[int]]) -> None:
    """Joins the two sets that most queries hold together, as long as two queries do."""
    mined = [set(sorted(h, key=lambda s: (-len(members[s]), s))[:MINED]) for h in held]
    pairs: Counter = Counter()
    for sets in mined:
        pairs.update(combinations(sorted(sets), 2))
    queue = [(-n, pair) for pair, n in pairs.items() if n > 1]
    heapq.heapify(queue)
    while queue:
        n, (a, b) = heapq.heappop(queue)
        both = [q for q in members[a] & members[b] if a in mined[q] and b in mined[q]]
        if len(both) < 2:
            continue
        if len(both) < -n:  # fewer since it was counted
            heapq.heappush(queue, (-len(both), (a, b)))
            continue
        new = len(made.shared)
        made.shared.append(_parts((), (a, b)))
        members.append(set(both))
        beside: Counter = Counter()
        for q in both:
            for s in (a, b):
                mined[q].remove(s)
                held[q].remove(s)
                members[s].remove(q)
            beside.update(mined[q])
            mined[q].add(new)
            held[q].add(new)
        for other, count in beside.items():
            if count > 1:
                heapq.heappush(queue, (-count, (other, new)))


# --- over documents -------------------------------------------------------------------
def _posted(terms: dict[bytes, int]) -> Callable:
    """Map task: per document with terms its id, their number, and the block's terms in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms.keys()
        for rows in batches:
            ids, sizes, found, counts = [], [], [], []
            texts = rows.column(1).cast(pa.binary()).to_pylist()
            for doc_id, text in zip(rows.column(0).to_pylist(), texts, strict=True):
                of = term_counts(text)
                if not of:
                    continue
                hits = list(of.keys() & known)
                ids.append(doc_id)
                sizes.append(of.total())
                found.append(np.array([terms[t] for t in hits], "<i4").tobytes())
                counts.append(np.array([of[t] for t in hits], "<i8").tobytes())
            columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()),
                       pa.array(found, pa.binary()), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "counts"])

    return run


def _holding(n_terms: int) -> Callable:
    """Map task: per term the number of its documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for rows in batches:
            terms = np.frombuffer(b"".join(rows.column(0).to_pylist()), "<i4")
            total += np.bincount(terms, minlength=n_terms)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held.astype(np.int32)), pa.array(total[held])], names=["term", "df"]
        )

    return run


def weights(df: dict[int, int], n_terms: int, n_docs: int) -> np.ndarray:
    """floor(1000 * ln((2N + 2) / (2df + 1))) of each term."""
    return np.array(
        [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(n_terms)], np.int64
    )


def scores(
    made: Plan, weight: np.ndarray, at: np.ndarray, terms: np.ndarray, counts: np.ndarray, lengths: np.ndarray
) -> np.ndarray:
    """Score of each query (row) in each document (column); ``at`` is the column of a posting."""
    width = len(lengths)
    parts = np.zeros((len(weight), width), np.int64)
    parts[terms, at] = weight[terms] * ((1_000_000_000 * counts) // (1000 * counts + 20 * lengths[at]))
    shared = np.zeros((len(made.shared), width), np.int64)
    for s, (of_terms, of_sets) in enumerate(made.shared):
        shared[s] = parts[of_terms].sum(axis=0) + shared[of_sets].sum(axis=0)
    out = np.zeros((len(made.queries), width), np.int64)
    for q, (of_terms, of_sets) in enumerate(made.queries):
        out[q] = parts[of_terms].sum(axis=0) + shared[of_sets].sum(axis=0)
    return out


class _Best:
    """The best documents of each query so far."""

    def __init__(self, n_queries: int, top: int):
        self.top = top
        self.score = [np.zeros(0, np.int64) for _ in range(n_queries)]
        self.doc = [np.zeros(0, np.int64) for _ in range(n_queries)]
        self.none = [np.zeros(0, bool) for _ in range(n_queries)]
        self.least = np.ones(n_queries, np.int64)

    def add(self, found: np.ndarray, doc: np.ndarray, none: np.ndarray) -> None:
        rising = found >= self.least[:, None]
        for q in np.flatnonzero(rising.any(axis=1)).tolist():
            new = rising[q]
            score = np.concatenate([self.score[q], found[q, new]])
            docs = np.concatenate([self.doc[q], doc[new]])
            nones = np.concatenate([self.none[q], none[new]])
            order = np.lexsort((docs, nones, -score))[: self.top]
            self.score[q], self.doc[q], self.none[q] = score[order], docs[order], nones[order]
            if len(order) == self.top:
                self.least[q] = self.score[q][-1]

    def rows(self) -> pa.RecordBatch:
        query = np.repeat(np.arange(len(self.score), dtype=np.int32), [len(s) for s in self.score])
        docs, nones = np.concatenate(self.doc), np.concatenate(self.none)
        return pa.RecordBatch.from_arrays(
            [pa.array(query), pa.array(docs, mask=nones), pa.array(np.concatenate(self.score))],
            names=["query", "doc_id", "score"],
        )


def _ranked(made: Plan, weight: np.ndarray, n_docs: int, n_all: int, top: int) -> Callable:
    """Map task: the best of its documents for each query."""
    height = len(weight) + len(made.shared) + len(made.queries)
    step = max(16, CELLS // max(1, height))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(made.queries), top)
        for rows in batches:
            for begin in range(0, rows.num_rows, step):
                part = rows.slice(begin, step)
                found, counts = (part.column(c).to_pylist() for c in ("terms", "counts"))
                at = np.repeat(np.arange(part.num_rows), [len(x) // 4 for x in found])
                # Whole numbers of any size: the product may pass 64 bits.
                lengths = [50 + 50 * n * n_docs // n_all for n in part.column("n").to_pylist()]
                of_queries = scores(
                    made, weight, at, np.frombuffer(b"".join(found), "<i4"),
                    np.frombuffer(b"".join(counts), "<i8"), np.array(lengths, np.int64),
                )
                ids = part.column("doc_id")
                best.add(of_queries, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
        yield best.rows()

    return run


def _blocks(queries: DataFrame, text: str, key: str) -> Iterator[list[tuple[int | None, set[bytes]]]]:
    """(id, terms) of the queries, block by block; the driver holds one."""
    rows = queries.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    block, size = [], 0
    for row in rows.toLocalIterator():
        terms = set(term_counts(row["text"].encode() if row["text"] else None))
        if block and (len(block) >= BLOCK_QUERIES or size + len(terms) > BLOCK_TERMS):
            yield block
            block, size = [], 0
        block.append((row["id"], terms))
        size += len(terms)
    if block:
        yield block


def search(
    docs: DataFrame,
    queries: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    query_text: str = "text",
    query_key: str = "item_id",
    top: int = TOP,
) -> DataFrame:
    """The ``top`` documents of each query with a score above 0: ``item_id``, ``rank``,
    ``doc_id`` and ``score``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    answers: DataFrame | None = None
    for block in _blocks(queries, query_text, query_key):
        made = plan([terms for _, terms in block])
        postings = settle(rows.mapInArrow(_posted(made.terms), _POSTINGS))
        n_docs, n_all = postings.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs or not made.terms:
            continue
        held = postings.select("terms").mapInArrow(_holding(len(made.terms)), "term int, df bigint")
        df = dict(held.groupBy("term").agg(F.sum("df")).collect())  # the terms of one block
        weight = weights(df, len(made.terms), n_docs)
        best = postings.mapInArrow(_ranked(made, weight, n_docs, n_all, top), _BEST)
        best = best.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        for keys in (["query", "salt"], ["query"]):
            rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
            best = best.withColumn("rank", rank).filter(F.col("rank") <= top)
        ids = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(block)], "query int, item_id bigint")
        found = settle(best.join(F.broadcast(ids), "query").select("item_id", "rank", "doc_id", "score"))
        answers = found if answers is None else answers.unionByName(found)
    if answers is None:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return answers
