from collections import Counter

import pytest

from benchlight.llm import mixing


def filled(sizes, weights, goal, caps):
    """Shares by weight, the excess of full ones shared again, one step after the other."""
    full, left = {}, dict.fromkeys(sizes, 0)
    while True:
        weight = sum(weights[s] for s in sizes if s not in full)
        rest = goal - sum(full.values())
        left = {s: rest * weights[s] / weight for s in sizes if s not in full} if weight else {}
        over = [s for s, x in left.items() if x > caps[s]]
        if not over:
            return full | left
        full |= {s: caps[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 50}, {"a": 1, "b": 2, "c": 3, "d": 4000, "e": 0}, {"z": 0}])
def test_targets(spark, sizes):
    rows = [(1, s, n) for s, n in sizes.items()]
    sized = spark.createDataFrame(rows, "doc_id int, source string, size bigint")
    got = {r["source"]: r["target"] for r in mixing.targets(sized).collect()}
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}
    caps = {s: 2 * n for s, n in sizes.items()}
    assert got == pytest.approx(filled(sizes, weights, 1.5 * sum(sizes.values()), caps))


def test_sources_in_code_point_order(spark):
    names = ["Z", "a", "é", "日", "\U0001f600", "", None]
    sized = spark.createDataFrame([(1, s, 10) for s in names], "doc_id int, source string, size bigint")
    got = {r["source"]: r["weight"] for r in mixing._ranked(
        sized.groupBy("source").agg({"size": "sum"}).withColumnRenamed("sum(size)", "source_size"), (3, 1, 2)
    ).collect()}
    order = sorted((n for n in names if n is not None)) + [None]
    assert got == {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)}


def test_taken_comes_near_target(spark):
    docs = spark.createDataFrame(
        [(i, "w " * (1 + i % 7), f"s{i % 4}") for i in range(6000)], "doc_id bigint, text string, source string"
    )
    rows = mixing.taken(docs).collect()
    assert all(r["taken"] <= 2 * r["size"] and r["taken"] % r["size"] == 0 for r in rows)
    sums = Counter()
    for r in rows:
        sums[r["source"]] += r["taken"]
    for r in rows:
        assert sums[r["source"]] == pytest.approx(r["target"], rel=0.05)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.taken(docs).collect()))


def test_mix_emits_copies(odd, none):
    copies = Counter(r["doc_id"] for r in mixing.taken(odd).collect() for _ in range(r["copies"]))
    mixed = mixing.mix(odd)
    assert mixed.dtypes == odd.dtypes
    assert Counter(r["doc_id"] for r in mixed.collect()) == copies
    assert mixing.mix(none).count() == 0 and mixing.taken(none).count() == 0
