import math

import numpy as np
import pytest

from benchlight.llm import polytope

KINDS = "vec_id bigint, embedding array<float>, label int, key string"


def expected(rows, min_cosine=0.95):
    """Links and components, pair by pair."""

    def usable(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n, root = [0] * len(rows), list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if usable(a) and usable(b) and len(a) == len(b):
                x, y = (np.array(v, np.float32).astype(float) for v in (a, b))
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= min_cosine:
                    n[i], n[j], root[top(i)] = n[i] + 1, n[j] + 1, top(j)
    least = {}
    for i, (vec_id, _) in enumerate(rows):
        if vec_id is not None:
            least[top(i)] = min(least.get(top(i), vec_id), vec_id)
    out = []
    for i, (vec_id, _) in enumerate(rows):
        component = least.get(top(i))
        out.append((vec_id, n[i], component, vec_id == component))
    return sorted(out, key=repr)


def found(spark, rows, **options):
    table = spark.createDataFrame([(i, v, 1, "k") for i, v in rows], KINDS)
    got = polytope.near_vectors(table, **options)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted(map(tuple, got.collect()), key=repr)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, -0.0]), (2, [2.0, 0.0, 0.0]), (3, [0.99, 0.05, 0.0]), (4, [0.0, 1.0, 0.0]),
        (5, None), (6, []), (7, [0.0, 0.0, 0.0]), (8, [nan, 1.0, 0.0]), (9, [inf, 1.0, 0.0]), (10, [None, 1.0, 0.0]),
        (None, [0.0, 1.0, 0.01]), (None, [0.0, 0.0, 1.0]), (None, None), (11, [1.0, 0.0]), (12, [1.0]), (13, [3.0]),
        (14, [-1.0, 0.0, 0.0]), (-1, [1.0, 0.001, 0.0]),
    ]
    assert found(spark, rows) == expected(rows)
    assert found(spark, []) == []


@pytest.mark.parametrize("split_rows", [16, 10**6])
def test_recall(spark, split_rows):
    """Groups of every size, chains and copies, over split buckets and whole ones."""
    rng = np.random.default_rng(5)
    rows, at = [], 0
    for size in [1] * 60 + [2] * 40 + [5] * 20 + [150]:
        centre = rng.standard_normal(48)
        for _ in range(size):
            noise = rng.standard_normal(48)
            rows.append((at, (centre + rng.choice([0, 0.05, 0.2, 0.25]) * noise).astype(np.float32).tolist()))
            at += 1
    wanted, got = expected(rows), found(spark, rows, split_rows=split_rows, bucket_rows=4)
    links = [sum(r[1] for r in x) for x in (wanted, got)]
    assert 0.98 * links[0] <= links[1] <= links[0]
    by_id = {r[0]: r for r in wanted}
    assert all(r[1] <= by_id[r[0]][1] for r in got)
    assert sum(r == by_id[r[0]] for r in got) >= 0.9 * len(got)


@pytest.mark.parametrize("n", [10, 10**5, 10**8])
def test_pairs_meet(n):
    """At the least cosine, for the tables that so many vectors get."""
    rng = np.random.default_rng(7)
    one = rng.standard_normal((2000, 64))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    aside = rng.standard_normal((2000, 64))
    aside -= (aside * one).sum(axis=1, keepdims=True) * one
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    two = 0.95 * one + math.sqrt(1 - 0.95**2) * aside
    tables = polytope.Tables(*polytope.sizes(n, 64))
    a, b = tables.codes(one), tables.codes(two)
    met = (a == b[:, :, :1]).any(axis=(1, 2)) | (b == a[:, :, :1]).any(axis=(1, 2))
    assert met.mean() >= 0.98


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).standard_normal((5, 16))
    turned = polytope.hadamard(x)
    assert np.allclose(turned @ turned.T, x @ x.T)
    assert np.allclose(polytope.hadamard(turned), x)
