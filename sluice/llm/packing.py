"""Packing of token sequences by order-preserving dynamic programming.

The documents of a partition, in their order, form one stream of ids. Windows of at most `size` ids are cut at ends of
documents or sentences, and inside a sentence only where that is longer than a window. A window that ends at candidate
j and begins at candidate i costs its padding plus j's penalty (0 at a document's end, more at a sentence's end, most
inside a sentence), so

    f[j] = penalty[j] + size - position[j] + min over position[i] >= position[j] - size of (f[i] + position[i]),

whose minimum slides: a monotone queue gives it in constant time a candidate. The stream is cut into blocks for bounded
memory; a block's last windows stay open and begin the next block. What is left at a partition's end goes into windows
whose lengths are powers of two, which are not padded.

Defined results: null texts are empty ones; every document has at least its closing id, so empty ones are packed too;
repeated rows and null ids are packed like any row; texts longer than a window span several; an empty table gives an
empty table; further columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import WhitespaceSplit

from sluice.llm.common import Collector, rows

SIZE = 2048
END_OF_TEXT = 1
#: Penalties in ids of padding: a cut at a sentence's end, a cut inside a sentence.
SENTENCE_CUT, INNER_CUT = 8, 24
#: In a sentence longer than a window, candidates stand this many ids apart.
SPACING = 64
BLOCK = 1 << 18
#: Remembered words, after which all are forgotten; words in one call of the library; characters of texts met together.
MEMO_ENTRIES = 400_000
WORDS_AT_ONCE = 4096
TEXT_AT_ONCE = 1 << 20
SENTENCE_END = re.compile(r"[.!?。！？]['\")\]»”]*$")
WORD = re.compile(r"\S+")
#: Runs of Latin letters, each one code point that composes with nothing here, and marks that are no part of a contraction.
MARKS = ".,;:!?"
BEFORE_MARKS = re.compile("(?<![.,;:!?])(?=[.,;:!?])").sub
SIMPLE = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+[.,;:!?]*").fullmatch
#: Byte-level vocabularies write a byte as the character of its number, if that is printable; of Latin-1 text in UTF-8
#: the lead byte 0xC3 is, the others are shifted to 256 and on in their order among the unprintable bytes.
_UNPRINTABLE = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b)]
BYTE_LETTERS = {b: 256 + k for k, b in enumerate(_UNPRINTABLE) if b != 0x20}
LAST_OF_SENTENCE = frozenset(".!?。！？'\")]»”")


class WordCodec:
    """Ids by a tokenizers file, remembered by runs of text between white space, where that changes no id.

    A remembered run has a number; start, count and flag hold, by number, where its ids begin in flat, how many they are
    and whether a sentence ends with it. Runs not met before are encoded together, in one call of the library.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # the specials' strings in a text are ordinary text
        # White space is dropped: no id may depend on it, nor on what stands beyond it
        probe = "Ab's c1. é\n\tx  'll y!"
        whole = self.tokenizer.encode(probe, add_special_tokens=False).ids
        self.by_words = whole == [i for w in probe.split() for i in self.tokenizer.encode(w, add_special_tokens=False).ids]
        # for simple runs the file's normaliser and splitter are done here, if they come to the same
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.direct, suffix = False, model.get("end_of_word_suffix")
        if model.get("merges") and suffix:
            merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
            # no cache: each run comes once
            self.model = Tokenizer(BPE(model["vocab"], merges, cache_capacity=0, end_of_word_suffix=suffix))
            self.model.pre_tokenizer = WhitespaceSplit()
            self.suffixed = np.zeros(max(model["vocab"].values()) + 1, np.int64)
            self.suffixed[[i for t, i in model["vocab"].items() if t.endswith(suffix)]] = 1
            trial = ["the", "Über,", "naïve", "x", "Ça!?", "unbelievable...", "ÿ;", "ÀÉÎõü", "zqxjkvw:"]
            self.direct = all(map(SIMPLE, trial)) and self.model_ids(trial)[0].tolist() == self.tokenizer.encode(" ".join(trial), add_special_tokens=False).ids
        self.forget()

    def model_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of simple runs, which are letters and what follows them, and how many each has."""
        marked = np.fromiter((w[-1] in MARKS for w in words), np.int64, len(words))
        lower = BEFORE_MARKS(" ", " ".join(words)).lower()
        found = self.model.encode_batch_fast([lower if lower.isascii() else lower.encode().decode("latin-1").translate(BYTE_LETTERS)], add_special_tokens=False)[0]
        ids = np.array(found.ids, np.uint32)
        # the last piece of each unit has the suffix, no other one
        last = self.suffixed[ids]
        owners = np.repeat(np.arange(len(words)), 1 + marked)
        return ids, np.bincount(owners[np.cumsum(last) - last], minlength=len(words))

    def library_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for any runs."""
        found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        begins = np.array(found.offsets, np.int64).reshape(-1, 2)[:, 0]
        return np.array(found.ids, np.uint32), np.bincount(np.searchsorted(np.cumsum(lengths), begins, "right"), minlength=len(words))

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.start, self.count, self.flag = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, bool)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def learn(self, words: list[str]) -> None:
        """Remember runs that are not remembered yet."""
        while len(self.start) < len(self.number) + len(words):
            self.start, self.count, self.flag = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count, self.flag))
        simple = [w for w in words if SIMPLE(w)] if self.direct else []
        self._learn([w for w in simple if w.isascii()], self.model_ids)
        self._learn([w for w in simple if not w.isascii()], self.model_ids)
        self._learn(list(set(words).difference(simple)), self.library_ids)

    def _learn(self, words: list[str], encode) -> None:
        sentence, last = SENTENCE_END.search, LAST_OF_SENTENCE
        for at in range(0, len(words), WORDS_AT_ONCE):
            part = words[at : at + WORDS_AT_ONCE]
            ids, counts = encode(part)
            while len(self.flat) < self.used + len(ids):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : self.used + len(ids)] = ids
            first, after = len(self.number), len(self.number) + len(part)
            self.count[first:after] = counts
            self.start[first:after] = self.used + np.cumsum(counts) - counts
            self.flag[first:after] = [w[-1] in last and sentence(w) is not None for w in part]
            self.number.update(zip(part, range(first, after), strict=True))
            self.used += len(ids)

    def by_offsets(self, text: str) -> tuple[bytes, list[int]]:
        """As encode, with the text met as a whole: an end counts where no id stands across it."""
        found = self.tokenizer.encode(text, add_special_tokens=False)
        begins, reach = [list(accumulate(side, max)) for side in zip(*found.offsets, strict=True)] or ([], [])
        ends, start = [], 0
        for line in text.split("\n"):
            words = list(WORD.finditer(line))
            stops = {start + w.end() for w in words if SENTENCE_END.search(_UNUSUAL.sub("", w.group()))}
            for stop in sorted(stops | {start + w.end() for w in words[-1:]}):
                at = bisect_left(begins, stop)
                if at and reach[at - 1] <= stop and (not ends or ends[-1] != at):
                    ends.append(at)
            start += len(line) + 1
        return array("I", found.ids).tobytes(), ends

    def encode_all(self, texts: list[str]) -> list[tuple[bytes, list[int]]]:
        """For each text its packed ids and the numbers of ids at sentence ends."""
        words, lines, bounds, apart = [], [], [0], {}
        for k, text in enumerate(texts):
            if not self.by_words or not plain(text):
                apart[k] = self.by_offsets(text)
            else:
                for line in text.split("\n"):
                    words += line.split()
                    lines.append(len(words))
            bounds.append(len(words))
        fresh = set(words).difference(self.number)
        if len(self.number) + len(fresh) > MEMO_ENTRIES:
            self.forget()
            fresh = set(words)
        self.learn(list(fresh))
        numbers = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        counts = self.count[numbers]
        at = np.concatenate([[0], np.cumsum(counts)])
        ids = self.flat[np.repeat(self.start[numbers] - at[:-1], counts) + np.arange(at[-1])]
        stops = self.flag[numbers]
        # a line's last run; an empty line marks the one before it once more, or the last of the text before
        stops[np.array([x for x in lines if x], np.int64) - 1] = True
        ends = np.flatnonzero(stops)
        begin = np.searchsorted(ends, bounds)
        out = []
        for k in range(len(texts)):
            if k in apart:
                out.append(apart[k])
                continue
            a, b = at[bounds[k]], at[bounds[k + 1]]
            found = np.unique(at[ends[begin[k] : begin[k + 1]] + 1] - a)
            out.append((ids[a:b].tobytes(), found[found > 0].tolist()))
        return out

    def encode(self, text: str) -> tuple[bytes, list[int]]:
        return self.encode_all([text])[0]


#: Characters next to which white space might matter to a normaliser (a combining mark composes with what precedes it),
#: or that count as white space for one library and not for the other.
_UNUSUAL = re.compile("[\x00-\x08\x0e-\x1f\x7f-\x9f\u0300-\u036f\u200b-\u200f\u2028-\u202f\u2060-\u206f\u3099\u309a\ufeff\ufffd]")


def plain(text: str) -> bool:
    return not _UNUSUAL.search(text)


_CODECS: dict[str, WordCodec] = {}


def codec(path: str) -> WordCodec:
    if path not in _CODECS:
        _CODECS[path] = WordCodec(path)
    return _CODECS[path]


def choose_cuts(position: list[int], penalty: list[int], size: int = SIZE) -> list[int]:
    """Indexes of the cuts of the cheapest windows over candidates at rising positions; the first and last are cuts.

    Neighbouring candidates stand at most `size` apart.
    """
    n = len(position)
    value, back = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque([(position[0], 0)])  # (f + position, index), rising in the first
    popleft, pop, append = queue.popleft, queue.pop, queue.append
    for j in range(1, n):
        p = position[j]
        while position[queue[0][1]] < p - size:
            popleft()
        best, i = queue[0]
        back[j] = i
        value[j] = f = penalty[j] + size - p + best
        f += p
        while queue and queue[-1][0] >= f:
            pop()
        append((f, j))
    cuts, j = [], n - 1
    while j:
        cuts.append(j)
        j = back[j]
    return [0, *reversed(cuts)]


class Packer:
    """Packs the documents of one partition; sequence numbers start at `first`."""

    def __init__(self, first: int, size: int = SIZE):
        self.size, self.next, self.docs, self.ids = size, first, [], 0

    def add(self, key, packed: bytes, ends: list[int]) -> Iterator[tuple]:
        """packed: all ids of the document. Yields pieces of windows that are settled."""
        total = len(packed) >> 2
        self.docs.append([key, packed, ends, total, 0])  # the last: ids that have gone out already
        self.ids += total
        if self.ids >= BLOCK:
            yield from self.settle(last=False)

    def candidates(self) -> tuple[list[int], list[int]]:
        position, penalty, at = [[0]], [[0]], 0
        for _, _, ends, total, gone in self.docs:
            e = np.array(ends, np.int64)
            e = e[(e > gone) & (e < total - 1)] - gone
            at_end = total - gone
            position += [at + e, [at + at_end]]
            penalty += [np.full(len(e), SENTENCE_CUT), [0]]
            at += at_end
        p, cost = np.concatenate(position), np.concatenate(penalty)
        long = np.flatnonzero(np.diff(p) > self.size)
        if len(long):
            inner = [np.arange(p[i] + SPACING, p[i + 1], SPACING) for i in long]
            places = np.repeat(long + 1, [len(x) for x in inner])
            p, cost = np.insert(p, places, np.concatenate(inner)), np.insert(cost, places, INNER_CUT)
        return p.tolist(), cost.tolist()

    def settle(self, last: bool) -> Iterator[tuple]:
        if not self.docs:
            return
        position, penalty = self.candidates()
        cuts = [position[i] for i in choose_cuts(position, penalty, self.size)]
        if last:
            yield from self.emit(cuts[:-2] + self.powers(cuts[-2], cuts[-1]))
        elif len(cuts) > 6:
            yield from self.emit(cuts[:-4])

    def powers(self, begin: int, end: int) -> list[int]:
        """Cuts that leave windows of 2^k ids; a tail that pads by less than a 64th goes whole."""
        if self.size - (end - begin) <= self.size // 64:
            return [begin, end]
        cuts = [begin]
        while cuts[-1] < end:
            cuts.append(cuts[-1] + (1 << ((end - cuts[-1]).bit_length() - 1)))
        return cuts

    def emit(self, cuts: list[int]) -> Iterator[tuple]:
        """Pieces of the windows between the cuts; drops what has gone out."""
        k, start = 0, 0  # document and where it begins in the stream
        for a, b in zip(cuts, cuts[1:], strict=False):
            offset = 0
            while a < b:
                key, packed, _, total, gone = self.docs[k]
                begin = gone + a - start
                length = min(b - a, total - begin)
                yield key, begin, length, zlib.crc32(packed[4 * begin : 4 * (begin + length)]), total, self.next, offset
                offset += length
                a += length
                if begin + length == total:
                    start += total - gone
                    k += 1
            self.next += 1
        if k < len(self.docs):
            self.docs[k][4] += cuts[-1] - start
        self.docs = self.docs[k:]
        self.ids = sum(d[3] - d[4] for d in self.docs)


def together(found) -> Iterator[list[tuple]]:
    """Rows (key, text) in lists of TEXT_AT_ONCE characters, or little more than one text."""
    part, held = [], 0
    for row in found:
        part.append(row)
        held += len(row[1] or "")
        if held >= TEXT_AT_ONCE:
            yield part
            part, held = [], 0
    if part:
        yield part


def pack(docs: DataFrame, vocabulary: str, size: int = SIZE, end: int = END_OF_TEXT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = pa.schema([(n, pa.int64()) for n in names])
    closing = array("I", [end]).tobytes()

    def run(batches) -> Iterator[pa.RecordBatch]:
        c, out = codec(vocabulary), Collector(schema)
        packer = Packer(TaskContext.get().partitionId() << 36, size)
        for part in together(rows(batches, "doc_id", "text")):
            for (key, _), (packed, ends) in zip(part, c.encode_all([text or "" for _, text in part]), strict=True):
                for piece in packer.add(key, packed + closing, ends):
                    yield from out.add(*piece)
        for piece in packer.settle(last=True):
            yield from out.add(*piece)
        yield from out.flush()

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, ", ".join(f"`{n}` long" for n in names))
