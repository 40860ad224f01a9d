import math
import random
import re

import numpy as np
import pytest

from benchlight.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected(docs, items, top=50):
    split = [(i, terms(t)) for i, t in docs]
    split = [(i, w) for i, w in split if w]
    n_docs, n_all = len(split), sum(len(w) for _, w in split)
    held = {}
    for _, words in split:
        for w in set(words):
            held[w] = held.get(w, 0) + 1
    out = []
    for item_id, text in items:
        asked, scored = set(terms(text)), []
        for doc_id, words in split:
            m = 50 + 50 * len(words) * n_docs // n_all
            score = 0
            for w in asked & set(words):
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[w] + 1)))
                tf = words.count(w)
                score += weight * (1_000_000_000 * tf // (1000 * tf + 20 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, no_id, doc_id) in enumerate(sorted(scored)[:top], 1):
            out.append((item_id, rank, None if no_id else doc_id, -score))
    return sorted(out, key=repr)


def found(docs, items, **options):
    got = search.search(docs, items, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()), key=repr)


ITEMS = [
    (1, "The cat sat on the mat"), (2, "the CAT, the dog!"), (2, "the CAT, the dog!"), (3, None), (4, ""), (5, "?! ..."),
    (None, "Größe FÜSSE 日本語 text"), (6, "word5 thing7 absent"), (7, "one"), (8, "cat sat one the"),
]


@pytest.mark.parametrize("which", ["odd", "none"])
def test_odd_documents(request, spark, which):
    docs = request.getfixturevalue(which)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert found(docs, items) == expected(rows, ITEMS)
    assert found(docs, items.limit(0)) == []


def test_blocks_of_queries(spark, texts, monkeypatch):
    """Several blocks of queries, a short list, and more documents than it holds."""
    monkeypatch.setattr(search, "BLOCK_QUERIES", 3)
    rows = [(r["doc_id"], r["text"]) for r in texts.collect()]
    items = [(i, " ".join(t.split()[i : i + 12])) for i, (_, t) in enumerate(rows[:10]) if t]
    got = found(texts, spark.createDataFrame(items, "item_id bigint, text string"), top=7)
    assert got == expected(rows, items, top=7)


def test_sets_make_up_queries():
    """What is mined sums up to each query's terms, once each, in fewer additions."""
    rng = random.Random(4)
    words = [f"w{i}".encode() for i in range(60)]
    queries = [set(rng.sample(words[: rng.choice([10, 20, 60])], 10)) for _ in range(40)] + [set(), {b"alone"}]
    queries += [queries[0], queries[1] | {b"more"}]
    made = search.plan(queries)
    names = {i: t for t, i in made.terms.items()}
    whole = []
    for of_terms, of_sets in made.shared:
        assert all(s < len(whole) for s in of_sets)
        whole.append([names[t] for t in of_terms] + [w for s in of_sets for w in whole[s]])
    for query, (of_terms, of_sets) in zip(queries, made.queries, strict=True):
        got = [names[t] for t in of_terms] + [w for s in of_sets for w in whole[s]]
        assert sorted(got) == sorted(query)
    steps = sum(len(t) + len(s) for t, s in made.shared + made.queries)
    assert steps < sum(map(len, queries))


def test_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(search, "PIECE", 7)
    text = "Some words, some WORDS: élan 12x " * 5
    assert search.term_counts(text.encode()) == {w.encode(): terms(text).count(w) for w in set(terms(text))}


def test_weights():
    got = search.weights({0: 1, 1: 10}, 3, 10)
    assert got.tolist() == [math.floor(1000 * math.log(22 / 3)), math.floor(1000 * math.log(22 / 21)), math.floor(1000 * math.log(22))]
    assert got.dtype == np.int64
