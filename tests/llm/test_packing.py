import random
import zlib
from array import array
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sluice.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["a", "B", "à", "ÿ", "Ñ", "word", "É,", "x.", "z:!", " ", "  ", "\n", "\x1c", "\x85", "\xa0", "'s", "'LL", "é", "ß", "İ", "中", "1", "²", "_", "!!", ".", ",", "\t", "​", " the", "ing", "<|endoftext|>", "<", "|", ">", "ǅ", "ΑΣ", "̇", "ﬁ", "가", "ᄀ", "ᅡ", "ำ"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_ids_agree_with_the_library(library):
    codec, rng = packing.WordCodec(PATH), random.Random(1)
    assert codec.by_words and codec.direct
    for _ in range(4000):
        x = "".join(rng.choice(ODD) for _ in range(rng.randint(0, 20)))
        packed, ends = codec.encode(x)
        ids = library.encode(x, add_special_tokens=False).ids
        assert list(array("I", packed)) == ids, repr(x)
        assert ends == sorted(ends) and all(0 < e <= len(ids) for e in ends)


def test_sentence_ends_beside_unusual_characters(library):
    codec = packing.WordCodec(PATH)
    lines = ["One two three. Four (five!) six? \"Seven.\" eight", "", "nine ten", "Eleven. "]
    packed, plain_ends = codec.encode("\n".join(lines))
    for odd in ("\u200b", "\u202f", "\ufeff", "e\u0301", "\x01"):
        first = len(library.encode(odd, add_special_tokens=False).ids)
        text = odd + "\n" + "\n".join(lines)
        ids, ends = codec.encode(text)
        assert list(array("I", ids)) == library.encode(text, add_special_tokens=False).ids
        assert [e - first for e in ends if e > first] == plain_ends, repr(odd)
    ids, ends = codec.encode("one two.\u200b Three four")
    assert len(ends) == 2 and ends[-1] == len(array("I", ids))


def cheapest(position, penalty, size):
    best = {0: 0}
    for j in range(1, len(position)):
        best[j] = min(best[i] + penalty[j] + size - (position[j] - position[i]) for i in range(j) if position[j] - position[i] <= size)
    return best[len(position) - 1]


def test_cuts_are_cheapest():
    rng = random.Random(2)
    for _ in range(200):
        position = [0]
        for _ in range(rng.randint(1, 40)):
            position.append(position[-1] + rng.randint(1, 20))
        penalty = [rng.randint(0, 9) for _ in position]
        cuts = packing.choose_cuts(position, penalty, 20)
        cost = sum(penalty[j] + 20 - (position[j] - position[i]) for i, j in zip(cuts, cuts[1:], strict=False))
        assert cuts[0] == 0 and cuts[-1] == len(position) - 1 and cost == cheapest(position, penalty, 20)


def check(pieces, docs):
    """docs: (key, ids) in any order, keys unique."""
    sequences, parts = defaultdict(list), defaultdict(list)
    for key, start, length, crc, total, sequence, offset in pieces:
        sequences[sequence].append((offset, length))
        parts[key].append((start, length, crc, total))
    for key, ids in docs:
        at = 0
        for start, length, crc, total in sorted(parts[key]):
            assert start == at and length > 0 and total == len(ids)
            assert crc == zlib.crc32(array("I", ids[start : start + length]).tobytes())
            at += length
        assert at == len(ids)
    padding = 0
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding / max(1, sum(len(i) for _, i in docs))


def test_table(spark, library):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [(r["doc_id"], r["text"]) for r in rows] + [(-1, None), (-2, ""), (-3, "word " * 30000), (-4, "x" * 20000)]
    df = spark.createDataFrame([(k, t, "clash") for k, t in rows], "doc_id long, text string, start string").coalesce(2)
    pieces = [tuple(r) for r in packing.pack(df, PATH).collect()]
    docs = [(k, library.encode(t or "", add_special_tokens=False).ids + [1]) for k, t in rows]
    assert check(pieces, docs) < 0.04
    assert packing.pack(df.limit(0), PATH).count() == 0
    twice = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert packing.pack(twice, PATH).count() >= 2


def test_blocks_leave_nothing_out(monkeypatch, library):
    monkeypatch.setattr(packing, "BLOCK", 5000)
    codec, rng = packing.WordCodec(PATH), random.Random(4)
    packer, pieces, docs = packing.Packer(7), [], []
    for k in range(120):
        text = " ".join(rng.choice(["one", "two.", "three", "four,"]) for _ in range(rng.choice([1, 50, 700, 6000])))
        packed, ends = codec.encode(text)
        packed += array("I", [1]).tobytes()
        docs.append((k, list(array("I", packed))))
        pieces += packer.add(k, packed, ends)
    pieces += packer.settle(last=True)
    assert check(pieces, docs) < 0.05
