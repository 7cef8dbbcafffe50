import random
import re

import numpy as np
import pytest
import xxhash

from sluice.llm import simhash


def plain_print(text):
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union(values, radius):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


def test_prints():
    for t in (None, "", "  \t", "One", "one two", "One two THREE", "a b c d", "É é x y z É", "a\x85b c d e", "the cat sat on the mat " * 50):
        assert simhash.fingerprint(t) == plain_print(t)


@pytest.mark.parametrize("radius", [0, 1, 3, 5])
def test_comparison(radius):
    rng = random.Random(radius)
    values = set()
    for _ in range(30):
        base = rng.getrandbits(64)
        for _ in range(25):
            v = base
            for _ in range(rng.randint(0, 4)):
                v ^= 1 << rng.randint(0, 63)
            values.add(v)
    values = sorted(values)
    n = len(values)
    edges = dict(simhash.compare_sorted(np.zeros(n, np.int64), np.zeros(n, np.int32), np.arange(n), np.array(values, np.uint64), radius))
    want = union(values, radius)
    assert all(edges.get(i, i) == want[i] for i in range(n))


def test_buckets_and_sides_keep_apart():
    v = np.array([5, 5, 5, 5], np.uint64)
    two = simhash.compare_sorted(np.array([1, 1, 2, 2]), np.zeros(4, int), np.arange(4), v, 3)
    assert sorted(two) == [(1, 0), (3, 2)]
    assert simhash.compare_sorted(np.array([1, 1]), np.array([1, 1]), np.arange(2), v[:2], 3) == []
    assert simhash.compare_sorted(np.array([1, 1]), np.array([1, 2]), np.arange(2), v[:2], 3) == [(1, 0)]


def test_bands_find_every_pair():
    for distinct in (10, 10**7, 10**10):
        masks = [m for m, _ in simhash.bands(distinct, 3)]
        rng = random.Random(1)
        for _ in range(300):
            flips = sum(1 << b for b in rng.sample(range(64), 3))
            assert any(flips & m == 0 for m in masks)


@pytest.mark.parametrize("bucket_rows", [simhash.BUCKET_ROWS, 16])
def test_table(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", bucket_rows)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", "  ", "same text here now"] + ["same text here now"] * 3
    for _ in range(25):
        base = [rng.choice(words) for _ in range(200)]
        for _ in range(8):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    rows = [(1000 - i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    out = {r["doc_id"]: r for r in simhash.near_duplicates(df).collect()}
    order = sorted(rows)
    prints = [plain_print(t) for _, t, _ in order]
    want = union(prints, 3)
    for k, (key, _, _) in enumerate(order):
        assert out[key]["fingerprint"] == f"{prints[k]:016x}"
        assert out[key]["component_id"] == order[want[k]][0]
    kept = {r["doc_id"] for r in simhash.keep_first(df).collect()}
    assert kept == {order[w][0] for w in want}


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_first(empty).count() == 0
    odd = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "q r s t"), (2, "a b c d")], "doc_id long, text string")
    out = simhash.near_duplicates(odd).collect()
    assert len(out) == 4
    kept = simhash.keep_first(odd).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept) == [(False, 1), (True, None)]
