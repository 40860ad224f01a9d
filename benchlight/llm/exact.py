"""Exact duplicates by an extendible-hash index on shared files.

Texts are equal when they are identical without their white space. Every text has a
64-bit key. The directory maps the leading bits of a key to a bucket: it starts with
one bucket and doubles, splitting each overfull bucket by one more bit, until none is
overfull or the directory has ``2 ** MAX_DEPTH`` slots. Buckets are ranges of keys, and
a bucket belongs to one owner task.

A map task hands each text it reads to its owner once, with how many rows have it and the
best of them, so a pile of copies doesn't pile up at its owner. Owners read their range in
key order, so that one key's texts follow each other, compare bytes and chain the texts
that differ under one key; there counts are added up and the best row is chosen. What they
write, one row per different text, is the index. Rows find their group in it.

NULL counts as the empty text; a very long one is a text like any other. A row that repeats
in full is a copy like any other: one of them stays, that of the table's order. Ids may be of
any type that has an order; a NULL id is larger than any other. An empty table gives an empty
index. Other columns pass through ``deduplicate`` untouched, whatever their names.

The documents are read twice, and their rows are numbered by position, so they have to be
a table's rows, not the result of an unsettled shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchlight.llm.texts import normalised, packed, row_number, whole
from benchlight.session import settle

MAX_DEPTH = 16
BUCKET_BYTES = 4 << 20
KEY_BITS = 64
# Texts a map task holds back to leave out their copies.
HELD_BYTES = 48 << 20
BATCH_BYTES = 8 << 20

_SEED = 42
_BLANKS = b" \t\n\x0b\x0c\r"
_ENTRY = "bucket int, key bigint, body binary, n bigint, n_chars bigint, row bigint"
_INDEX = "bucket int, key bigint, chain int, sha binary, n_bytes bigint, group_size bigint, keep_row bigint"


def members(docs: DataFrame, text: str = "text", key: str = "doc_id", key_bits: int = KEY_BITS) -> DataFrame:
    """Per row its number, id, length in code points, key and digest; no text."""
    body = whole(text)
    rows = docs.select(
        row_number(docs).alias("row"),
        F.col(key).alias("doc_id"),
        F.char_length(body).cast("bigint").alias("n_chars"),
        normalised(body).alias("norm"),
    )
    return rows.select(
        "row",
        "doc_id",
        "n_chars",
        F.shiftleft(F.shiftrightunsigned(F.xxhash64("norm"), 64 - key_bits), 64 - key_bits).alias("key"),
        F.unhex(F.sha2("norm", 256)).alias("sha"),
        F.octet_length("norm").alias("n_bytes"),
    )


def directory(rows: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> np.ndarray:
    """The bucket of each slot, a slot being the leading bits of a key.

    The texts' bytes are summed over the longest prefixes the directory may have, so at
    most ``2 ** MAX_DEPTH`` sums reach the driver. A bucket's number is its first slot
    at full depth.
    """
    prefix = F.shiftrightunsigned("key", 64 - MAX_DEPTH).cast("int")
    distinct = rows.groupBy("key", "sha").agg(F.max("n_bytes").alias("n_bytes"))
    sums = distinct.groupBy(prefix.alias("prefix")).agg(F.sum("n_bytes").alias("n")).collect()
    load = np.zeros(1 << MAX_DEPTH, np.int64)
    for r in sums:
        load[r["prefix"]] = r["n"]
    return grow(load, bucket_bytes)


def grow(load: np.ndarray, capacity: int) -> np.ndarray:
    """Doubles a directory until every bucket holds at most ``capacity`` or is one slot."""
    full_depth = len(load).bit_length() - 1
    buckets = np.zeros(1, np.int64)
    depth = 0
    while depth < full_depth:
        per_slot = load.reshape(1 << depth, -1).sum(axis=1)
        firsts, place = np.unique(buckets, return_inverse=True)
        overfull = np.bincount(place, weights=per_slot) > capacity
        if not overfull.any():
            break
        depth += 1
        slots = np.arange(1 << depth, dtype=np.int64)
        buckets = np.where(
            np.repeat(overfull[place], 2), slots << (full_depth - depth), np.repeat(buckets, 2)
        )
    return buckets.astype(np.int32)


def _better(one: list, two: list) -> bool:
    """Whether a row (code points, id, number) goes before another."""
    if one[0] != two[0]:
        return one[0] > two[0]
    if (one[1] is None) != (two[1] is None):
        return two[1] is None
    return one[1] < two[1] if one[1] != two[1] else one[2] < two[2]


def _insert(slots: np.ndarray, key_bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Map task: each text it reads, once, with its bucket, the rows that have it and the best."""
    depth = len(slots).bit_length() - 1
    mask = ((1 << key_bits) - 1) << (64 - key_bits)

    def flushed(held: dict[bytes, list], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        bodies, size = [], 0
        for i, body in enumerate(held):
            bodies.append(body)
            size += len(body) + 100
            if size < BATCH_BYTES and i + 1 < len(held):
                continue
            keys = [xxhash.xxh64_intdigest(b, _SEED) & mask for b in bodies]
            n, n_chars, ids, rows = zip(*[held[b] for b in bodies], strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(slots[k >> (64 - depth)]) if depth else 0 for k in keys], pa.int32()),
                    pa.array(np.array(keys, np.uint64).view(np.int64)),
                    pa.array(bodies, pa.binary()),
                    *[pa.array(c, pa.int64()) for c in (n, n_chars, rows)],
                    pa.array(ids, kind),
                ],
                names=["bucket", "key", "body", "n", "n_chars", "row", "doc_id"],
            )
            bodies, size = [], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        held_bytes, kind = 0, pa.null()
        for rows in batches:
            kind = rows.schema.field("doc_id").type
            texts = rows.column("text").cast(pa.binary()).to_pylist()
            columns = [rows.column(c).to_pylist() for c in ("n_chars", "doc_id", "row")]
            for text, *row in zip(texts, *columns, strict=True):
                body = (text or b"").translate(None, _BLANKS)
                known = held.get(body)
                if known is None:
                    held[body] = [1, *row]
                    held_bytes += len(body) + 300
                else:
                    known[0] += 1
                    if _better(row, known[1:]):
                        known[1:] = row
            if held_bytes > HELD_BYTES:
                yield from flushed(held, kind)
                held, held_bytes = {}, 0
        yield from flushed(held, kind)

    return run


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Owner task: entries come in key order; one row per different text of a key."""
    names = ["bucket", "key", "chain", "sha", "n_bytes", "group_size", "keep_row", "keep_id"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    current: tuple[int, int] | None = None
    chain: list[list] = []  # body, rows that have it, the best of them
    done: list[tuple] = []
    kind = pa.null()

    def link() -> None:
        for i, (body, n, (_, doc_id, row)) in enumerate(chain):
            done.append((*current, i, hashlib.sha256(body).digest(), len(body), n, row, doc_id))

    def flushed() -> pa.RecordBatch:
        columns = zip(*done, strict=True)
        arrays = [pa.array(c, k) for c, k in zip(columns, [*kinds, kind], strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    for entries in batches:
        kind = entries.schema.field("doc_id").type
        columns = [entries.column(c).to_pylist() for c in ("bucket", "key", "body", "n", "n_chars", "doc_id", "row")]
        for bucket, key, body, n, *row in zip(*columns, strict=True):
            if (bucket, key) != current:
                if current is not None:
                    link()
                current, chain = (bucket, key), []
            known = next((other for other in chain if other[0] == body), None)
            if known is None:
                chain.append([body, n, row])
            else:
                known[1] += n
                if _better(row, known[2]):
                    known[2] = row
        if len(done) > 20_000:
            yield flushed()
            done = []
    if current is not None:
        link()
    if done:
        yield flushed()


def build_index(
    docs: DataFrame, slots: np.ndarray, text: str = "text", key: str = "doc_id", key_bits: int = KEY_BITS
) -> DataFrame:
    """The index on shared files: bucket, key, place in the key's chain, digest, how many
    rows have the text and which of them stays."""
    id_type = docs.schema[key].dataType.simpleString()
    rows = docs.select(
        F.col(text).cast("string").alias("text"),
        F.char_length(whole(text)).cast("bigint").alias("n_chars"),
        F.col(key).alias("doc_id"),
        row_number(docs).alias("row"),
    )
    entries = rows.mapInArrow(_insert(slots, key_bits), f"{_ENTRY}, doc_id {id_type}")
    owned = entries.repartition("bucket").sortWithinPartitions("bucket", "key")
    return settle(owned.mapInArrow(_chain, f"{_INDEX}, keep_id {id_type}"))


def groups(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    bucket_bytes: int = BUCKET_BYTES,
    key_bits: int = KEY_BITS,
) -> DataFrame:
    """One row per document: its number ``row``, ``doc_id``, ``keep_id``, ``group_size``,
    ``kept`` and ``text_sha256``.

    ``key_bits`` shortens the keys, which makes chains longer and changes nothing else.
    """
    rows = settle(members(docs, text, key, key_bits))
    index = build_index(docs, directory(rows, bucket_bytes), text, key, key_bits)
    # A row's digest tells it apart from the other texts chained under its key.
    return rows.join(index.select("key", "sha", "group_size", "keep_row", "keep_id"), ["key", "sha"]).select(
        "row",
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents that stay, one of each group; the columns are those of ``docs``."""
    staying = groups(docs, text, key).filter("kept").select("row")
    numbered = packed(docs, row=row_number(docs))
    return numbered.join(staying.hint("merge"), "row", "left_semi").select("doc.*")
