import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from benchlight.llm import exact


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((doc_id, text or ""))
    out = []
    for body, members in groups.items():
        best = max(members, key=lambda m: (len(m[1]), -(2**70 if m[0] is None else m[0])))
        out += [(m[0], best[0], len(members), hashlib.sha256(body.encode()).hexdigest()) for m in members]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("key_bits", "bucket_bytes"), [(64, 4 << 20), (64, 200), (2, 50), (1, 10**9)])
def test_groups(odd, key_bits, bucket_bytes):
    """Whatever the buckets, and with chains of many texts under one key."""
    found = exact.groups(odd, bucket_bytes=bucket_bytes, key_bits=key_bits).collect()
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found), key=repr)
    assert got == expected([(r["doc_id"], r["text"]) for r in odd.collect()])
    kept = [r["text_sha256"] for r in found if r["kept"]]
    assert len(kept) == len(set(kept)) == len({r["text_sha256"] for r in found})
    assert all(r["doc_id"] == r["keep_id"] for r in found if r["kept"])


def test_directory_doubles():
    load = np.zeros(16, np.int64)
    load[[0, 1, 2, 3, 9]] = [5, 5, 5, 5, 1]
    assert exact.grow(load, 100).tolist() == [0]
    slots = exact.grow(load, 10)
    assert slots.tolist() == [0, 2, 4, 4, 8, 8, 8, 8]  # only the overfull branch is split
    assert exact.grow(load, 4).tolist() == [0, 1, 2, 3, 4, 4, 4, 4, 8, 8, 8, 8, 8, 8, 8, 8]
    assert exact.grow(np.zeros(16, np.int64), 1).tolist() == [0]


def test_index_holds_each_text_once(odd):
    slots = exact.directory(exact.members(odd), 300)
    assert len(slots) > 1
    index = exact.build_index(odd, slots).collect()
    bodies = {re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in odd.collect()}
    assert sorted(r["sha"] for r in index) == sorted(hashlib.sha256(b.encode()).digest() for b in bodies)
    depth = len(slots).bit_length() - 1
    assert all(r["bucket"] == slots[(r["key"] % 2**64) >> (64 - depth)] for r in index)


def test_deduplicate(odd, none):
    kept = exact.deduplicate(odd)
    assert kept.dtypes == odd.dtypes
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids, key=repr) == sorted([1, 5, -9, 7, 8, None], key=repr)
    assert exact.deduplicate(none).count() == 0
