"""The near-copy stage against brute force over five-word shingles."""

import random

import corpus_pipeline
import numpy as np

from sluice.llm import common, nearcopies, setjoin, simhash


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def alike(a, b):
    return bool(a | b) and len(a & b) >= 0.8 * len(a | b)


def corpus():
    rng, rows = random.Random(3), []
    for _ in range(25):
        base = [rng.choice([f"w{i}" for i in range(300)]) for _ in range(rng.choice([3, 12, 80, 400]))]
        for _ in range(6):
            t = list(base)
            for _ in range(rng.randint(0, 1 + len(t) // 40)):
                t[rng.randrange(len(t))] = f"w{rng.randrange(300)}"
            rows.append(" ".join(t))
    rng.shuffle(rows)
    return [(7 * k - 300, t) for k, t in enumerate(rows)] + [(10**12, None), (10**12 + 1, ""), (None, rows[0]), (None, rows[0])]


def test_join_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, id int")
    known = [(k, shingles(t)) for k, t in rows if k is not None]
    want = [k for k, s in known if not any(j < k and alike(s, x) for j, x in known)]
    out = nearcopies.without_later(df)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.collect() if r["doc_id"] is not None) == sorted(want) and 25 < len(want) < 140
    assert out.where("doc_id is null").count() == 2
    assert nearcopies.without_later(df.limit(0)).count() == 0


def test_stage_leaves_no_similar_pair(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first = {r["doc_id"] for r in simhash.keep_first(df).collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, df, "").collect()}
    texts = {k: shingles(t) for k, t in rows if k is not None}
    pairs = lambda ids: [(a, b) for a in ids for b in ids if a is not None and b is not None and a < b and alike(texts[a], texts[b])]
    assert kept <= first and pairs(first) and not pairs(kept)


def test_no_copy_of_the_shingles_is_left(spark, monkeypatch):
    held, write, drop = {}, setjoin.durable, setjoin.release

    def watched(df, name="part", *more):
        out = write(df, name, *more)
        held[out.inputFiles()[0].rsplit("/", 1)[0] if out.inputFiles() else name] = name
        return out

    def released(df):
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            held.pop(path, None)
        drop(df)

    monkeypatch.setattr(setjoin, "durable", watched)
    monkeypatch.setattr(setjoin, "release", released)
    assert nearcopies.without_later(spark.createDataFrame(corpus(), "doc_id long, text string")).count() > 0
    assert "similar" in held.values() and "compared" not in held.values()


def test_levels_count_all_shingles(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    hashes = np.concatenate([nearcopies.keys_of(t) for k, t in rows if k is not None])
    bits = nearcopies.RARITY_BITS
    counts = np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    assert bits >= 22 and np.array_equal(nearcopies.levels(df), np.minimum(127, 3 * np.log2(counts + 1.0)).astype(np.int8))
    assert not nearcopies.levels(df.limit(0)).any()


def test_join_of_many_pairs(spark, monkeypatch):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    few_pairs = sorted(map(repr, nearcopies.without_later(df).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted(map(repr, nearcopies.without_later(df).collect())) == few_pairs
