import base64
import hashlib
import random
from array import array

import public_tokenizers
import pytest
import tiktoken

from sluice.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["a", "b", " ", "  ", "\n", "\x1c", "\x85", "\xa0", "'s", "'ll", "é", "ß", "中", "🎉", "1", "²", "Ⅷ", "_", "!!", "\t", "​", "　", "the", " the", "ing", "aaaa", "==", "\r\n", "zz"]


@pytest.fixture(scope="module")
def codec():
    return bpe.BytePairCodec(PATH)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts_agree_with_the_library(codec, library):
    rng = random.Random(1)
    for _ in range(3000):
        x = "".join(rng.choice(ODD) for _ in range(rng.randint(0, 60)))
        assert codec.encode(x) == library.encode_ordinary(x), repr(x)


def test_long_matches_are_joined_exactly(codec, library):
    rng = random.Random(2)
    for _ in range(300):
        x = "".join(rng.choice("thaeing") * rng.randint(1, 9) for _ in range(rng.randint(0, 300)))
        assert codec.encode(x) == library.encode_ordinary(x)
    for x in ("a" * 20001, "=" * 9999, "中" * 3001, " " * 5000 + "x"):
        assert codec.encode(x) == library.encode_ordinary(x)


def test_join_is_associative(codec):
    rng = random.Random(3)
    for _ in range(300):
        a, b, c = (bytes(rng.choice(b"abcth e") for _ in range(rng.randint(0, 40))) for _ in range(3))
        left = codec.join(codec.join(codec.tree(a), codec.tree(b)), codec.tree(c))
        right = codec.join(codec.tree(a), codec.join(codec.tree(b), codec.tree(c)))
        assert left == right == codec.merge(a + b + c)


def test_ids_of_documents_come_from_joins(library):
    import pyarrow.parquet as pq

    codec = bpe.BytePairCodec(PATH)
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()]
    several = {m for t in texts for m in codec.matches(t) if len(m.encode()) > bpe.LEAF_BYTES and m.encode() not in codec.ranks}
    for t in texts:
        assert codec.encode(t) == library.encode_ordinary(t)
    # each different match above a leaf is a tree with one join at least
    assert codec.joins >= len(several) > 1000


def test_join_at_every_seam(codec):
    rng = random.Random(6)
    for _ in range(200):
        data = bytes(rng.choice(b"abcth eing") for _ in range(rng.randint(2, 60)))
        whole = codec.merge(data)
        for cut in range(1, len(data)):
            assert codec.join(codec.merge(data[:cut]), codec.merge(data[cut:])) == whole


def test_other_patterns(library):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    rng = random.Random(7)
    for pattern in (r"[^,]+|,", r"\p{L}+ ?\p{L}*|[\s\S]", r"(a|b)+|[\s\S]"):
        own, other = bpe.BytePairCodec(PATH, pattern), tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for _ in range(200):
            x = "".join(rng.choice([*ODD, ",", " and "]) for _ in range(rng.randint(0, 30)))
            assert own.encode(x) == other.encode_ordinary(x)


def test_decoding(codec):
    for x in ("", "héllo 中", "a" * 50000):
        assert codec.decode_bytes(codec.encode(x)).decode() == x


def test_table(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (3, "hello world", "x"), (3, "hello world", "x"), (None, "q" * 30000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = bpe.round_trip(df, PATH).collect()
    assert len(out) == 5
    for r, (key, text, _) in zip(sorted(out, key=lambda r: (r["doc_id"] or 0, r["n_tokens"])), sorted(rows, key=lambda r: (r[0] or 0)), strict=True):
        ids = library.encode_ordinary(text or "")
        assert (r["doc_id"], r["n_tokens"]) == (key, len(ids))
        assert r["ids_sha256"] == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.round_trip(df.limit(0), PATH).count() == 0
    both = bpe.decode(bpe.encode(df, PATH), PATH)
    assert {bytes(r["data"]) for r in both.collect()} == {(t or "").encode() for _, t, _ in rows}
