"""Buckets of near-duplicates of any size against brute force over all pairs."""

import numpy as np
import pytest

from lumigrid.llm import near


def brute(sets, least, own=None):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = [set(s.tolist()) for s in sets]
    for i in range(len(sets)):
        for j in range(i):
            a, b = held[i], held[j]
            if (own is None or own[i] != own[j]) and min(len(a), len(b)) >= least * max(len(a), len(b)) - 1e-9:
                union = len(a | b)
                if (len(a & b) / union if union else 1.0) >= least:
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    return np.array([find(i) for i in range(len(sets))])


def texts(n, rng):
    """Sets with likenesses on both sides of 0.8, chains, equal sets and empty ones."""
    bases = [rng.integers(0, 1 << 32, rng.integers(1, 60), dtype=np.uint64).astype(np.uint32) for _ in range(max(2, n // 6))]
    out = []
    for k in range(n):
        s = bases[rng.integers(len(bases))].copy()
        at = rng.random(len(s)) < rng.choice([0, 0.05, 0.1, 0.12, 0.3])
        s[at] = rng.integers(0, 1 << 32, at.sum(), dtype=np.uint64).astype(np.uint32)
        out.append(np.unique(np.concatenate([s, bases[0][: rng.integers(0, 3)]])) if k % 9 else s[:0])
    return out


def fingerprints(sets):
    return near.set_fingerprints(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]))


@pytest.mark.parametrize("n", [2, 3, 64, 65, 500])
def test_links_of_a_bucket_are_those_of_all_pairs(n):
    for seed in range(6):
        rng = np.random.default_rng(seed * 1000 + n)
        sets = texts(n, rng)
        assert np.array_equal(near.bucket_labels(sets, fingerprints(sets), 0.8), brute(sets, 0.8))
        # the fingerprints only help: any will do
        assert np.array_equal(near.bucket_labels(sets, rng.integers(0, 1 << 63, n).astype(np.uint64), 0.8), brute(sets, 0.8))


def test_links_between_blocks():
    rng = np.random.default_rng(8)
    sets = [s for s in texts(130, rng) if len(s)]
    own = rng.integers(0, 2, len(sets))
    assert np.array_equal(near.bucket_labels(sets, fingerprints(sets), 0.8, own), brute(sets, 0.8, own))


def test_a_large_bucket():
    """5000 texts: groups of near copies, and texts that only share a passage."""
    rng = np.random.default_rng(9)
    passage, sets, group = np.arange(40, dtype=np.uint32), [], []
    for k in range(500):
        base = rng.integers(100, 1 << 32, 60, dtype=np.uint64).astype(np.uint32)
        for _ in range(10):
            s = base.copy()
            s[rng.integers(0, 60, 2)] = rng.integers(100, 1 << 32, 2, dtype=np.uint64)
            sets.append(np.unique(np.concatenate([s, passage[: rng.integers(38, 41)]])))
            group.append(k * 10)
    got = near.bucket_labels(sets, fingerprints(sets), 0.8)
    assert np.array_equal(got, group)


def test_repeated_lines_count_once(spark):
    """Texts of the same shingles, some repeated many times, are one class in a bucket of any size."""
    rng = np.random.default_rng(10)
    line = "one line of text that comes again and again\n"
    rest = " ".join(f"w{x}" for x in rng.integers(0, 10**6, 400))
    rows = [(k, line * int(n) + rest) for k, n in enumerate(np.linspace(3, 300, 90))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = near.near_classes(df).groupBy("root").count().collect()
    assert [r["count"] for r in got] == [90]
