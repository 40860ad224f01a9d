import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from benchlight.llm import trie

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
KINDS = "conv_id bigint, turn bigint, role string, text string, key string, seq int, n int"


def expected(rows):
    """Every prefix of every rebuilt conversation, one by one."""
    own = defaultdict(list)
    for conv_id, turn, role, text, *_ in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv_id].append((turn is not None, turn or 0, digest, role, text))
    whole = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in whole.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = whole.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), parent, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, **options):
    table = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], KINDS)
    got = trie.prefix_trie(table, **options)
    assert set(NAMES) == set(got.columns)
    return sorted((tuple(r) for r in got.select(NAMES).collect()), key=repr)


def test_odd_turns(spark):
    long = "word " * 100_000
    rows = [
        (0, 2, "user", "b"), (0, 1, "user", "a"), (0, None, None, None), (0, 3, "bot", long), (0, 4, "user", "d"),
        (0, 5, "bot", "e"), (0, 6, "user", "f"),
        (1, 1, "user", "x"), (1, 1, "user", "x"), (1, 1, "bot", "x"), (1, 9, None, "z"), (2, 0, "", ""), (3, 0, "ab", "c"),
        (4, 0, "a", "bc"), (-3, 0, "user", "y"), (-3, 1, "user", "y"), (250, 0, "user", "lonely"), (2**60 + 1, 0, "u", "big"),
        (None, 0, "user", "nobody"), (100, 0, "user", "a"), (101, 0, "user", "a"), (102, 0, "user", "b"),
    ]
    assert found(spark, rows) == expected(rows)
    assert found(spark, []) == []


@pytest.mark.parametrize("block_bits", [1, 3, 14])
def test_blocks(spark, block_bits):
    """Conversations that share much, over blocks of any size, with piles of copies."""
    rng = random.Random(block_bits)
    rows = []
    for c in range(400):
        first = rng.choice("aaaab")
        turns = ["same"] * 12 if c % 3 == 0 else [first] + [rng.choice("pq") * rng.randint(1, 2) for _ in range(rng.randint(0, 7))]
        rows += [(c, i, "user" if i % 2 else None, t) for i, t in enumerate(turns)]
    assert found(spark, rows, block_bits=block_bits) == expected(rows)


def test_common_turns():
    a, b, c = b"a" * 16, b"b" * 16, b"a" * 15 + b"c"
    assert trie.common(b"", a) == 0
    assert trie.common(a + b, a + b + c) == 2
    assert trie.common(a + a, a + c) == 1
