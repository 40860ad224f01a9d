import random
from collections import defaultdict

import numpy as np
import pytest

from benchlight.llm import packing


def check(rows, lengths, capacities):
    """Every word of every document once, no overlap, the least capacity that holds it."""
    bins, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r["sequence"]].append(r)
        docs[r["row"]].append((r["start"], r["length"]))
    for pieces in bins.values():
        pieces.sort(key=lambda r: r["offset"])
        end = 0
        for r in pieces:
            assert r["offset"] == end
            end += r["length"]
        assert {r["capacity"] for r in pieces} == {min(c for c in capacities if c >= end)}
    for row, pieces in docs.items():
        at = 0
        for start, length in sorted(pieces):
            assert start == at and length > 0
            at += length
        assert at == lengths[row]
    assert set(docs) == {row for row, n in lengths.items() if n}


@pytest.mark.parametrize("shard_items", [50, 10**6])
def test_pack(spark, shard_items):
    rng = random.Random(2)
    lengths = {i: rng.choice([0, 1, 7, 99, 100, 101, 250, 400, 401, 1234, rng.randint(1, 900)]) for i in range(400)}
    items = spark.createDataFrame([(i, i // 2, n) for i, n in lengths.items()], "row bigint, doc_id bigint, length bigint")
    capacities = (100, 200, 400)
    rows = packing.pack(items, capacities, shard_items).collect()
    check(rows, lengths, capacities)
    used = sum(r["length"] for r in rows)
    held = {r["sequence"]: r["capacity"] for r in rows}
    assert used / sum(held.values()) > (0.97 if shard_items > 1000 else 0.85)


def slow_best_fit(lengths, capacities, choose):
    room, sizes, out = [], [], []
    for n in lengths:
        fitting = [(r, i) for i, r in enumerate(room) if r >= n]
        if fitting:
            least = min(r for r, _ in fitting)
            out.append(least)
            i = next(i for r, i in fitting if r == least)
        else:
            i = len(room)
            sizes.append(choose[i])
            room.append(choose[i])
            out.append(None)
        room[i] -= n
    return out


def test_best_fit_takes_the_tightest_room():
    rng = random.Random(4)
    lengths = np.array(sorted((rng.randint(1, 512) for _ in range(300)), reverse=True))
    bins, offsets, sizes = packing.best_fit(lengths, (512,))
    room, tight = defaultdict(lambda: 512), []
    for b, n in zip(bins.tolist(), lengths.tolist(), strict=True):
        tight.append(room[b] if b in room else None)
        room[b] -= n
    assert tight == slow_best_fit(lengths.tolist(), (512,), [512] * 300)
    assert set(sizes.tolist()) == {512}


def test_sizes_are_chosen_by_cost():
    # Nothing else to come: the least that holds it. Much to come: a larger one pays.
    assert packing.best_fit(np.array([300]), (512, 8192))[2].tolist() == [512]
    lengths = np.array([300] * 200)
    sizes = packing.best_fit(lengths, (320, 640, 1280))[2]
    assert set(sizes.tolist()) <= {640, 1280}


def test_documents(odd, none):
    rows = packing.pack_documents(odd).collect()
    lengths = {r["row"]: r["length"] for r in packing.lengths(odd, packing.n_words(packing.whole("text")) + 1).collect()}
    assert len(lengths) == odd.count()
    check(rows, lengths, packing.CAPACITIES)
    assert packing.pack_documents(none).count() == 0
