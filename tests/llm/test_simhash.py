import numpy as np
import pytest
import xxhash

from benchlight.llm import simhash
from benchlight.llm.components import components


def fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, ids, radius=2):
    root = list(range(len(prints)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[top(i)] = top(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return [least.get(top(i)) for i in range(len(prints))]


@pytest.mark.parametrize("which", ["odd", "texts"])
def test_groups(request, which):
    docs = request.getfixturevalue(which)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    prints = [fingerprint(t) for _, t in rows]
    ids = [d for d, _ in rows]
    expected = [(d, f"{p:016x}", c) for d, p, c in zip(ids, prints, classes(prints, ids), strict=True)]
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_fingerprint_is_sparks_hash(spark):
    text = "one Two three"
    h = spark.sql("SELECT xxhash64('one two three')").first()[0]
    assert simhash.fingerprint(text.encode()) == h % 2**64


@pytest.mark.parametrize("shard_rows", [8, 64, 10**6])
def test_trees_find_all_pairs(spark, shard_rows):
    """Clusters of few differing bits, chains of them, over one shard or many."""
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**63, 60, dtype=np.uint64)
    prints = {0, 1, 2**64 - 1, 2**63}
    for s in seeds.tolist():
        for _ in range(int(rng.integers(1, 8))):
            prints.add(s)
            s ^= 1 << int(rng.integers(0, 64))
            s ^= 1 << int(rng.integers(0, 64))
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "doc_id bigint, fp bigint")
    got = {r["doc_id"]: r["component_id"] for r in simhash.grouped(nodes, shard_rows=shard_rows).collect()}
    assert [got[i] for i in range(len(prints))] == classes(prints, list(range(len(prints))))


def test_near_pairs_in_blocks(monkeypatch):
    rng = np.random.default_rng(5)
    points = rng.integers(0, 2**12, 700, dtype=np.uint64)
    monkeypatch.setattr(simhash, "BLOCK", 512)
    got = {(int(q), int(p)) for a, b in simhash.near_pairs(points, points, 2) for q, p in zip(a, b, strict=True)}
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 2
    assert got == set(zip(*[x.tolist() for x in np.nonzero(near)], strict=True))


def test_representatives(odd, none):
    left = simhash.representatives(odd)
    assert left.dtypes == odd.dtypes
    ids = [r["doc_id"] for r in left.collect()]
    assert len(ids) == len(set(ids))
    groups = {r["component_id"] for r in simhash.near_duplicates(odd).collect()}
    assert set(ids) == groups
    assert simhash.representatives(none).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (300, 200), (7, 7)] + [(500, 501 + i) for i in range(50)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 100} | {i: 500 for i in range(500, 551)}
