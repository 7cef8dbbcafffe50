import numpy as np
import pytest

from sluice.llm import topk


def brute(rows, divisor, k, scale=64):
    good = [(i, np.floor(scale * np.array(v, float))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if i % divisor == 0}):
        x = min([list(v) for i, v in good if i == q])
        scores = sorted((-int(sum(int(a) * int(b) for a, b in zip(x, v, strict=True))), i) for i, v in good if i != q and len(v) == len(x))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return out


@pytest.mark.parametrize("size", [0, 1, 5, 3000])
def test_against_brute_force(spark, size):
    rng = np.random.default_rng(size)
    centres = rng.normal(size=(20, 32))
    rows = [(i, [float(v) for v in (centres[i % 20] + 0.1 * rng.normal(size=32)) / 8]) for i in range(size)]
    rows += rows[7:8]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>") if rows else spark.createDataFrame([], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in topk.nearest(df, 50 if size > 100 else 2).select("query_id", "rank", "vec_id", "score").collect()]
    rows32 = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(got) == brute(rows32, 50 if size > 100 else 2, 20)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, 2.0]), (8, [1.0, 2.0]), (None, [1.0, 1.0]), (10, [1.0, 2.0, 3.0]), (12, [2e5, -1e5])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = sorted(tuple(r) for r in topk.nearest(df, 2, k=2).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute(rows, 2, 2)


def test_only_survivors_are_scored():
    """Several tiles of one task: the bounds decide which pairs are scored, and the result is that of all pairs."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 64))
    x = np.floor(16 * (centres[rng.integers(0, 40, 9000)] + 0.05 * rng.normal(size=(9000, 64))))
    ids = rng.permutation(9000).astype(np.int64)
    search = topk.Search(ids[:300], x[:300], 20)
    for at in range(0, 9000, topk.TILE):
        search.tile(ids[at : at + topk.TILE], x[at : at + topk.TILE])
    scores = (x[:300] @ x.T).astype(np.int64)
    for q in range(300):
        want = sorted((-scores[q, c], ids[c]) for c in range(9000) if ids[c] != ids[q])[:20]
        assert [(-s, i) for s, i in zip(search.best.scores[q], search.best.ids[q], strict=True)] == want
    assert search.met == 300 * 9000 and search.scored < 0.1 * search.met


def test_large_scores_are_exact(spark):
    # scores between 2^53 and 2^63 that differ by one
    rows = [(0, [float(2**24), 1.0]), *[(i, [float(2**24), float(i) / 64]) for i in range(1, 40)], (50, [1e30, 0.0]), (60, [-1e30, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.nearest(df, 50, k=5).where("query_id = 0").select("query_id", "rank", "vec_id", "score").collect()]
    x = {i: [int(np.floor(64 * v)) for v in vec] for i, vec in rows}
    want = sorted((-min(2**63 - 1, sum(a * b for a, b in zip(x[0], x[i], strict=True))), i) for i in x if i)[:5]
    assert sorted(got) == [(0, r + 1, i, -s) for r, (s, i) in enumerate(want)]


def test_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=9)]) for i in range(120)]
    got = [tuple(r) for r in topk.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 4, k=3).select("query_id", "rank", "vec_id", "score").collect()]
    assert sorted(got) == brute(rows, 4, 3)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    q, x = np.floor(64 * rng.normal(size=(30, 64))), np.floor(64 * rng.normal(size=(200, 64)))
    a, b = topk.Statistics(q), topk.Statistics(x)
    exact = q @ x.T
    last = None
    for la, lb in zip(a.levels, b.levels, strict=True):
        bound = la @ lb.T
        assert (bound >= exact - 1e-6).all()
        assert last is None or (bound <= last + 1e-6).all()
        last = bound
