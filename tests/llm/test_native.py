"""SpotSigs, line dedup, sharding."""

import random
import re
import zlib

import pytest
import regex

from sluice.llm import common, linededup, setjoin, sharding, spotsigs

SF = "/root/testdata/sf0.001"


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|MapInArrow|ArrowEval", plan)


# ---- SpotSigs -------------------------------------------------------------------------------------------------------


def spots(t):
    w = [x for x in regex.sub(r"[^\p{L}\p{N}]+", " ", t.lower()).split(" ") if x]
    out = {(x, tuple([y for y in w[i + 1 :] if y not in spotsigs.ANCHORS][: spotsigs.CHAIN])) for i, x in enumerate(w) if x in spotsigs.ANCHORS}
    return out or {(x, tuple(w[i + 1 : i + 3])) for i, x in enumerate(w)} or {t}


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("bucket_rows", [2000, 7])
def test_edits(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(spotsigs, "BUCKET_ROWS", bucket_rows)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    rows += [(10**12, None), (10**12 + 5, ""), (10**12 + 6, "!!"), (10**12 + 7, "one two"), (-3, "the quick brown fox jumps over the lazy dog and the cat" * 400)]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, bucket string")
    result = spotsigs.fingerprint_edits(df)
    no_python(result)
    out = {r["doc_id"]: r for r in result.collect()}
    rows = sorted((k, t or "") for k, t in rows)
    for i, (k, t) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + following[:q]
        import hashlib

        r = out[k]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(jaccard(spots(t), spots(edited)))
        assert r["near_next"] == pytest.approx(jaccard(spots(t), spots(following)))
        assert len(r["fingerprint"]) == 16 * len(spots(t))
    same = {}
    for k, t in rows:
        assert same.setdefault(t, out[k]["fingerprint"]) == out[k]["fingerprint"]


def test_classes_and_earlier_documents(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(14):
        base = [rng.choice(["the", "of", "and", *[f"w{i}" for i in range(60)]]) for _ in range(rng.choice([4, 90, 150]))]
        for _ in range(5):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = f"w{rng.randrange(60)}"
            rows.append(" ".join(t))
    rng.shuffle(rows)
    rows = [(3 * k - 50, t) for k, t in enumerate(rows)] + [(10**9, rows[0]), (10**9 + 1, None), (10**9 + 2, ""), (None, rows[0]), (None, "alone")]
    result = spotsigs.fingerprint_edits(spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, class_id int, h1 string"))
    no_python(result)
    first = {}
    for k, t in sorted((k, t or "") for k, t in rows if k is not None):
        first.setdefault(frozenset(spots(t)), k)
    near = {s: any(j < k and jaccard(s, x) >= 0.8 for x, j in first.items()) for s, k in first.items()}
    assert any(near.values()) and not all(near.values())
    want = [(k, first.get(s, k) if k is not None else first.get(s), near.get(s, False)) for k, t in rows for s in [frozenset(spots(t or ""))]]
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["class_id"], r["near_earlier"])) for r in result.collect())


def test_odd_tables_of_spotsigs(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spotsigs.fingerprint_edits(empty).count() == 0
    one = spotsigs.fingerprint_edits(spark.createDataFrame([(5, "the cat sat")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0
    twice = spark.createDataFrame([(None, "a"), (None, "a"), (1, "b"), (1, "b")], "doc_id long, text string")
    assert spotsigs.fingerprint_edits(twice).count() == 4


def test_near_pairs(spark):
    rng = random.Random(1)
    texts = []
    for _ in range(12):
        base = [rng.choice(["the", "of", "and", *[f"w{i}" for i in range(60)]]) for _ in range(150)]
        for _ in range(5):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(150)] = f"w{rng.randrange(60)}"
            texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {}
    for i, t in enumerate(texts):
        sets.setdefault(frozenset(spots(t)), i)
    items = sorted((i, s) for s, i in sets.items())
    want = {(a, b) for a, x in items for b, y in items if a < b and jaccard(x, y) >= 0.8}
    assert {tuple(r) for r in spotsigs.near_pairs(df).collect()} == want and want


def test_near_documents_link_all_rows(spark):
    rng = random.Random(5)
    base = " ".join(rng.choice(["the", "of", "and", *[f"w{i}" for i in range(40)]]) for _ in range(120))
    edited = base + " the w1 w2"
    # the last words stand beyond the last anchor's chain: different texts, equal signatures
    far = base + " and" + " w3" * 12
    other = base + " and" + " w3" * 11
    rows = [(1, base), (2, base), (3, edited), (4, far), (5, other), (5, other), (None, base), (None, edited), (None, "alone"), (None, "alone"), (6, "nothing like it"), (7, None), (8, ""), (-9, "same words"), (9, "same words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert spots(far) == spots(other)
    want = sorted((str(a), str(b)) for i, (a, x) in enumerate(rows) for b, y in rows[:i] if jaccard(spots(x or ""), spots(y or "")) >= 0.8)
    members, pairs = spotsigs.near_documents(df)
    members, pairs = members.collect(), {frozenset(r) for r in pairs.collect()}
    assert sorted(str(r["doc_id"]) for r in members) == sorted(str(k) for k, _ in rows)
    found = [(r, s) for i, r in enumerate(members) for s in members[:i] if r["class_id"] == s["class_id"] or frozenset((r["class_id"], s["class_id"])) in pairs]
    assert sorted(tuple(sorted((str(r["doc_id"]), str(s["doc_id"])))) for r, s in found) == sorted(tuple(sorted(p)) for p in want)
    for r in members:
        assert r["representative"] == min((s["doc_id"] for s in members if s["class_id"] == r["class_id"] and s["doc_id"] is not None), default=None)
    assert [t.count() for t in spotsigs.near_documents(df.limit(0))] == [0, 0]


def test_common_signatures_stay_out_of_prefixes(spark, monkeypatch):
    met, write = [], setjoin.durable

    def watched(df, name="part"):
        out = write(df, name)
        if name == "prefixes":
            met.append(out.groupBy("key").count().agg({"count": "max"}).first()[0])
        return out

    monkeypatch.setattr(setjoin, "durable", watched)
    # signatures that all documents share and 9 of their own: the group meets in whole unless rare ones come first
    texts = [(i, "the common signature the second one the third here " + " ".join(f"of x{i}y{k} z{k}" for k in range(9))) for i in range(120)]
    assert spotsigs.near_documents(spark.createDataFrame(texts, "doc_id long, text string"))[1].count() == 0
    assert met == [1]


def test_length_partitions(spark):
    from pyspark.sql import functions as F

    for t in (0.5, 0.8, 0.9, 1.0):
        # nested sets of all lengths, at the very edge of the threshold too
        rows = [(i, i, list(range(200, 200 - i, -1))) for i in range(1, 101)]
        rows += [(i + 500, i, [1000 * i + k for k in range(i)]) for i in range(1, 30)]
        df = spark.createDataFrame(rows, "id long, n int, keys array<int>").withColumn("bits", setjoin.parity(F.col("keys")))
        want = {(a, b) for a, _, x in rows for b, _, y in rows if a < b and len({*x} & {*y}) >= t * len({*x} | {*y}) - 1e-9}
        pairs = setjoin.similar_pairs(df, t)
        assert {tuple(r) for r in pairs.collect()} == want
        lengths = df.select(F.col("n"), setjoin.length_part(F.col("n"), t).alias("part")).distinct().collect()
        assert len({r["part"] for r in lengths}) > 5
        assert all(abs(x["part"] - y["part"]) <= 1 for x in lengths for y in lengths if t < 1 and t * x["n"] <= y["n"] <= x["n"])


# ---- line dedup -----------------------------------------------------------------------------------------------------


def deduped(rows, t=0.8):
    seen, out = [], {}
    for n, (k, text) in enumerate(rows):
        if text is None:
            out[n] = (k, None)
            continue
        kept = []
        for line in text.split("\n"):
            s = {w for w in re.split("[ \t\r\x0b\x0c]", line.lower()) if w}
            if not s:
                kept.append(line)
                continue
            if not any(len(s & x) >= t * len(s | x) - 1e-12 for x in seen):
                kept.append(line)
            if s not in seen:
                seen.append(s)
        out[n] = (k, "\n".join(kept))
    return sorted(out.values(), key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lines_against_brute_force(spark, seed):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6)) % 200}" for _ in range(400)]
    lines = [" ".join(rng.sample(words, rng.randint(1, 30))) for _ in range(60)]

    def line():
        if rng.random() < 0.5:
            parts = rng.choice(lines).split(" ")
            if rng.random() < 0.6:
                parts[rng.randrange(len(parts))] = rng.choice(words)
            rng.shuffle(parts)
            return rng.choice([" ", "  ", "\t"]).join(parts).upper()
        return rng.choice(["", "  ", rng.choice(lines)])

    rows = [(i * 3, "\n".join(line() for _ in range(rng.randint(0, 8)))) for i in range(60)]
    rows += [(500, None), (501, "x" * 100000), (502, "x" * 100000)]
    df = spark.createDataFrame([(k, t, 7) for k, t in rows], "doc_id long, text string, n_lines int").repartition(3)
    result = linededup.dedup_lines(df)
    no_python(result)
    out = result.collect()
    assert sorted(((r["doc_id"], r["text"]) for r in out), key=repr) == deduped(rows)
    assert all(r["n_removed"] >= 0 for r in out)


def test_words_of_lines_are_not_shuffled(spark, monkeypatch):
    plans, write = {}, linededup.durable

    def watched(df, name="part", *more):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name, *more)

    monkeypatch.setattr(linededup, "durable", watched)
    rng = random.Random(4)
    texts = ["\n".join(" ".join(rng.choice([f"w{i}" for i in range(12)]) for _ in range(rng.randint(1, 9))) for _ in range(6)) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(texts + texts[:9])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = lambda: sorted(((r["doc_id"], r["text"]) for r in linededup.dedup_lines(df).collect()), key=repr)
    assert got() == deduped(rows)
    assert "Exchange hashpartitioning" not in plans["lines"]
    # very many repeated lines and removed ones
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert got() == deduped(rows)


def test_only_beginnings_of_lines_are_ordered(spark, monkeypatch):
    kept, write = [], linededup.durable

    def watched(df, name="part", *more):
        out = write(df, name, *more)
        if name == "rare-first":
            kept.extend(out.selectExpr("n", "size(keys) AS held").collect())
        return out

    monkeypatch.setattr(linededup, "durable", watched)
    rng = random.Random(12)
    base = [[rng.choice([f"w{i}" for i in range(150)]) for _ in range(rng.randint(1, 60))] for _ in range(40)]
    gaps = [" ", "  ", "\t", " \x0b", "\r ", "\x0c"]

    def line():
        words = [w if rng.random() > 0.06 else f"new{rng.randrange(50)}" for w in rng.choice(base)]
        return rng.choice(["", " ", "\t"]) + "".join(w + rng.choice(gaps) for w in words) if rng.random() < 0.5 else " ".join(words)

    rows = [(k, "\n".join(line() for _ in range(4))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = deduped(rows)
    for first, one_in in ((setjoin.LED_FIRST, setjoin.LED), (0, 1 << 20)):
        # also where hardly an element has a leader
        monkeypatch.setattr(setjoin, "LED_FIRST", first)
        monkeypatch.setattr(setjoin, "LED", one_in)
        out = linededup.dedup_lines(df).collect()
        assert sorted(((r["doc_id"], r["text"]) for r in out), key=repr) == want
        assert all(r["n_lines"] == 4 and r["n_lines"] - r["n_removed"] == len(r["text"].split("\n")) or r["text"] == "" for r in out)
    assert all(r["held"] <= 0.28 * r["n"] + 1 for r in kept) and max(r["n"] for r in kept) > 30


def test_very_large_ids_of_lines(spark):
    rows = [(2**32 - 1, "a b c\nd e f"), (2**32, "a b c\ng h i"), (2**45, "g h i\n\nj"), (2**45 + 1, "j\nk\n")]
    for some in (rows[:1], rows[:2], rows):
        out = linededup.dedup_lines(spark.createDataFrame(some, "doc_id long, text string")).collect()
        assert sorted(((r["doc_id"], r["text"]) for r in out), key=repr) == deduped(some)
        assert all(r["n_lines"] - r["n_removed"] == len(r["text"].split("\n")) or r["text"] == "" for r in out)


def test_odd_tables_of_lines(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert linededup.dedup_lines(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c\nd"), (None, "a b c\nq"), (-5, "a b c"), (2**62, "z"), (2**62, "z")], "doc_id long, text string")
    texts = sorted(r["text"] for r in linededup.dedup_lines(odd).collect())
    assert len(texts) == 5 and sum("a b c" in t for t in texts) == 1 and sum(t == "z" for t in texts) == 1


def test_similar_pairs(spark):
    from pyspark.sql import functions as F

    rng = random.Random(9)
    sets = {}
    for _ in range(150):
        base = rng.sample(range(80), rng.randint(1, 20))
        sets.setdefault(tuple(sorted(base)), len(sets))
        sets.setdefault(tuple(sorted({*base[1:], rng.randrange(80)})), len(sets))
    rows = [(i, len(k), list(k)) for k, i in sets.items()]
    df = spark.createDataFrame(rows, "id long, n int, keys array<int>").withColumn("bits", setjoin.parity(F.col("keys")))
    for t in (0.5, 0.8, 1.0):
        want = {(a, b) for a, _, x in rows for b, _, y in rows if a < b and len({*x} & {*y}) >= t * len({*x} | {*y}) - 1e-9}
        assert {tuple(r) for r in setjoin.similar_pairs(df, t).collect()} == want
        assert {r["id"] for r in setjoin.with_earlier(df, t).collect()} == {b for _, b in want}
        assert {r["id"] for r in setjoin.with_earlier(df, t, by_length=True).collect()} == {b for _, b in want}


def test_beginnings_rule_out_long_sets(spark, monkeypatch):
    from pyspark.sql import functions as F

    heads, write = [], setjoin.durable

    def watched(df, name="part", *more):
        out = write(df, name, *more)
        if name == "heads":
            heads.append(out.count())
        return out

    monkeypatch.setattr(setjoin, "durable", watched)
    rng = random.Random(6)
    # long sets share one rare element each; bitmaps of 64 bits tell nothing of them
    base = [[k // 3] + rng.sample(range(1000, 9000), 400) for k in range(36)]
    near = [b[:-20] + rng.sample(range(9000, 9999), 20) for b in base[:4]]
    rows = [(i, len(k), sorted(k)) for i, k in enumerate(base + near)]
    df = spark.createDataFrame(rows, "id long, n int, keys array<long>").withColumn("bits", setjoin.parity(F.col("keys")))
    want = {(a, b) for a, _, x in rows for b, _, y in rows if a < b and len({*x} & {*y}) >= 0.8 * len({*x} | {*y})}
    every = df.selectExpr("id as a").crossJoin(df.selectExpr("id as b")).where("a < b")
    assert {tuple(r) for r in setjoin.verified(write(every), write(df), 0.8).collect()} == want and len(want) == 4
    assert heads == [4]


# ---- sharding -------------------------------------------------------------------------------------------------------


def test_shards(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    result = sharding.kd_shards(df)
    no_python(result)
    out = result.collect()
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    assert len(out) == len(texts)
    total = [0] * 24
    slots = {}
    for r in out:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        total[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(total) <= 1.02 * min(total)


def test_odd_shards(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.kd_shards(empty).count() == 0
    rows = [(None, None, "s"), (1, "", "s"), (1, "é" * 5000, None)] + [(7, "same text", "s")] * 400
    df = spark.createDataFrame(rows, "doc_id long, text string, size string")
    out = sharding.kd_shards(df, shards=5).collect()
    assert len(out) == 403
    assert sum(r["size"] for r in out) == sum(8 + len((t or "").encode()) for _, t, _ in rows)
    assert {r["shard"] for r in out} <= set(range(5))
    for s in range(5):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    assert len({r["shard"] for r in sharding.kd_shards(df, shards=None, target_bytes=4000).collect()}) >= 4
