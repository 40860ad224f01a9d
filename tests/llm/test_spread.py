from collections import defaultdict

import pytest

from benchlight.llm import spread


@pytest.mark.parametrize("min_sites", [2, 10, 40])
def test_threshold_is_exact(spark, min_sites):
    """Lines on just under, just at, and far more sites."""
    rows, n = [], 0
    for spread_of in {1, min_sites - 1, min_sites, min_sites + 1, 3 * min_sites}:
        for site in range(spread_of):
            rows += [(n, f"line of {spread_of}\nown {n}", f"s{site}"), (n + 1, f"line of {spread_of} ", f"s{site}")]
            n += 2
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string")
    for r in spread.without_boilerplate(docs, min_sites=min_sites).collect():
        of = int(r["doc"]["text"].split("\n")[0].split()[-1])
        assert r["n_removed"] == (of >= min_sites)


def test_clean(spark, odd, none):
    rows = [(i, f"Common line.\n\n own {i}", f"s{i}") for i in range(12)] + [(99, None, None), (100, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string")
    got = {r["doc_id"]: r["text"] for r in spread.clean(docs).collect()}
    assert got == {i: f"\n own {i}" for i in range(12)} | {99: None, 100: ""}
    assert sorted(map(repr, spread.clean(odd).collect())) == sorted(map(repr, odd.collect()))
    assert spread.clean(none).count() == 0


def test_brute_force(texts):
    sites = defaultdict(set)
    rows = texts.collect()
    for r in rows:
        for line in r["text"].split("\n"):
            if line.split():
                sites[line.strip(" \t\n\x0b\x0c\r")].add(r["source"])
    wide = {x for x, s in sites.items() if len(s) >= 5}
    assert wide
    got = {r["doc"]["doc_id"]: r["cleaned"] for r in spread.without_boilerplate(texts, min_sites=5).collect()}
    for r in rows:
        left = [x for x in r["text"].split("\n") if x.strip(" \t\n\x0b\x0c\r") not in wide]
        assert got[r["doc_id"]] == "\n".join(left)
