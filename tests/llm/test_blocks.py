"""The exchange of hashes between blocks."""

import time
from collections import Counter

import numpy as np
import pandas as pd

from wavegraph.llm import blocks, substring_dedup


def bucket(parts):
    return pd.DataFrame({"block": range(len(parts)), "bucket": 7, "data": [np.array(p, np.uint64).tobytes() for p in parts]})


def test_a_bucket_of_many_blocks_is_sorted_once():
    """A bucket has a part of every block; its time is that of the hashes, not of the blocks times the hashes."""
    rng = np.random.default_rng(3)
    parts = [np.sort(rng.choice(200_000, 100, replace=False)) * 2 + (rng.random(100) < 0.01) for _ in range(3000)]
    begun = time.process_time()
    found = blocks._shared(bucket(parts))
    assert time.process_time() - begun < 5
    uses = Counter(int(x) | 1 for p in parts for x in p)
    twice = {int(x) for p in parts for x in p if x & 1}
    assert found["block"].tolist() == list(range(3000)) and set(found["bucket"]) == {7}
    for p, data in zip(parts, found["data"]):
        assert np.frombuffer(data, np.uint64).tolist() == [int(x) | 1 for x in p if uses[int(x) | 1] > 1 or (int(x) | 1) in twice]


def test_hashes_go_to_their_buckets():
    hash = np.arange(10, dtype=np.uint64)
    for bucket_numbers in (np.array([2, 1, 2, 70_000, 1, 0, 2, 0, 1, 70_000]), np.array([2, 1, 2, 3, 1, 0, 2, 0, 1, 3])):
        rows = list(blocks.by_bucket(5, bucket_numbers, hash, hash.astype(np.uint8)))
        assert [r[:2] for r in rows] == [(5, b) for b in sorted(set(bucket_numbers.tolist()))]
        for _, b, data in rows:
            mine = hash[bucket_numbers == b]
            assert data == mine.tobytes() + mine.astype(np.uint8).tobytes()
    assert list(blocks.by_bucket(5, np.zeros(0, np.int64), hash[:0])) == []


def test_windows_of_one_hash_and_other_checks_stay_apart():
    hash = np.array([9, 4, 9, 9, 4], np.uint64)
    check = np.array([2, 1, 1, 2, 1], np.uint32)
    order, start = substring_dedup._equal(hash, check)
    assert [(hash[i], check[i]) for i in order] == sorted(zip(hash, check)) and start.tolist() == [0, 2, 3]


def test_symbols_of_texts_do_not_reach_over_their_ends():
    """Equal texts of 20 words, one after the other, have equal names at equal places."""
    words = np.tile(np.random.default_rng(1).integers(1, 1 << 62, 20).astype(np.uint64), 3)
    names = substring_dedup.anchors(words, np.repeat(np.arange(3), 20), 13).reshape(3, 20)[:, :8]
    assert (names[0] == names[1]).all() and (names[0] == names[2]).all()
    assert not len(substring_dedup.anchors(words[:0], np.zeros(0, np.int64), 13))
