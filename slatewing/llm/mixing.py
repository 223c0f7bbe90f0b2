"""Language-model scoring by online logistic context mixing.

Tokens are words; frequent ones (at most ``WORDS``) are written as binary code words: a class by rank,
then their place in the class, which is in the order of their letters. The rest are an escape followed by
their letters, each a Huffman code word. For every bit of these, four predictors give their log odds: the
plain shares, and three hashed contexts. For words these are the topic (the last very frequent word
before, which tells language and kind of text), the word before, and the two words before; for letters
the one, the two and the four letters before. A mixer adds the odds with weights from the set that a gate
selects (which contexts were seen, and the kind of bit), and after each bit the set is corrected by the
error (online logistic regression). A secondary map from the mixed odds to what really followed refines
the result adaptively. Every bit is mixed; the bits' costs are the text's probability.

What is learned from the training rows covers all of them: exact counts of all tokens (a table that
grows with the corpus), the bit counts of the hashed contexts, and letter counts of spelled words. Each
task counts its own rows in tables of fixed size and gives only parts that have counts; those are added
up in two rounds (by part and a salt, then by part). The tables grow with the training tokens up to
2^``MOST_BITS`` slots, which bounds a worker's memory; beyond, more events share a slot. Scoring needs no
other document: weights start anew every ``LANE`` bits (some 350 words), so a text's score doesn't depend
on its neighbours, and thousands of such lanes run side by side in vectors.

Tokens are places in a buffer rather than objects: they are found, ranked and counted as arrays, by the
first and the last eight bytes and the length, which are the whole word up to 16 bytes; longer ones go
through a dictionary.

The base score is the smoothed unigram formula over exact counts: frequent tokens' counts are broadcast
(at most ``WORDS`` of them, and at most ``WORD_BYTES`` together), the rest join the count table.

Defined results: null and empty texts consist of the end token alone; a null doc_id is a training row;
equal rows get equal results; without training rows N and V are 0. Only id and text are read.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewing.llm.common import LOWER_ASCII, held_out, stored, table

WORDS = (1 << 18) - 1
WORD_BYTES = 8 << 20
LANE = 4096
MOST_BITS = 22
PARTS = 64
SUB = 400_000
UNIT = 16.0
KINDS = 3
STEPS = 24
RATE = 0.03
REFINED = 0.25
STRIP = 32
SLICE = 8_000
TOPICS = 64
START, RARE, NONE = 0x7FFFFFFF, 0x7FFFFFFE, 0x7FFFFFFD
LETTERS = 3
PAD = 8
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
ODD = 0x9E3779B97F4A7C15
# Weights of plain, first, second and third context where neither of the last two was seen, where the
# second was, where the third was, and where both were.
FIRST_WEIGHTS = np.array([[0.3, 0.75, 0, 0], [0.2, 0.6, 0.3, 0], [0.2, 0.6, 0, 0.3], [0.1, 0.4, 0.3, 0.4]], np.float32)


def tokens(text: bytes | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, and the end, which is the empty token."""
    words = (text or b"").translate(LOWER_ASCII).split()
    words.append(b"")
    return words


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"), held_out(10, 0, id_col).alias("held_out"))


def count_tokens(texts: DataFrame) -> DataFrame:
    """(token, n): exact counts over the training rows; each task adds up before the shuffle."""

    def run(batches):
        counts = Counts()
        for batch in batches:
            for words, _, _ in flat(batch.column(0), SUB):
                counts.add(words)
                if len(counts) > 1_000_000:
                    counts.merge()
                    if len(counts) > 500_000:
                        yield pa.RecordBatch.from_arrays(list(counts.take()), names=["token", "n"])
        if len(counts):
            yield pa.RecordBatch.from_arrays(list(counts.take()), names=["token", "n"])

    rows = texts.filter(~F.col("held_out")).select("text").mapInArrow(run, "token binary, n long")
    return stored(rows.groupBy("token").agg(F.sum("n").alias("n")), "tokens")


def frequent(counts: DataFrame, most: int) -> tuple[list[bytes], np.ndarray]:
    """The most frequent tokens, in order, and their counts: as many whole steps of frequency as fit, by
    number and by bytes. Tokens seen once, or of over 64 bytes, are left out: as escapes they show the
    model how often new words come."""
    counts = counts.filter((F.col("n") > 1) & (F.octet_length("token") <= 64))
    step = F.floor(F.log2("n") * 8)
    sizes = sorted(map(tuple, counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)), F.sum(F.octet_length("token"))).collect()), reverse=True)
    total, held, least = 0, 0, None
    for s, n, size in sizes:
        if total + n > most or held + size > WORD_BYTES:
            break
        total, held, least = total + n, held + size, s
    if least is None:
        return [], np.zeros(0, np.int64)
    got = counts.filter(step >= least).toArrow()
    rows = sorted(zip(got.column("n").to_pylist(), got.column("token").to_pylist()), key=lambda x: (-x[0], x[1]))
    return [x[1] for x in rows], np.array([x[0] for x in rows], np.int64)


def class_codes(weights: list[float]) -> list[int]:
    """A Huffman code of the size classes, each with a leading 1."""
    heap = [(w, k, [k]) for k, w in enumerate(weights)]
    bits = {k: "" for k in range(len(weights))}
    heapq.heapify(heap)
    while len(heap) > 1:
        (v, i, low), (w, _, high) = heapq.heappop(heap), heapq.heappop(heap)
        for k in low:
            bits[k] = "0" + bits[k]
        for k in high:
            bits[k] = "1" + bits[k]
        heapq.heappush(heap, (v + w, i, low + high))
    return [int("1" + (bits[k] or "0"), 2) for k in range(len(weights))]


def code_words(words: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each rank its code with a leading 1 and its length: the class, which is the size of rank + 1
    in bits, then the word's place by its letters in the class. The last entry is the escape, class 0.
    Third: the largest class code."""
    v = np.arange(1, len(counts) + 1)
    size = np.floor(np.log2(v)).astype(np.int64) + 1 if len(v) else np.zeros(0, np.int64)
    sums = np.bincount(size, weights=counts, minlength=2) if len(v) else np.zeros(2)
    classes = np.array(class_codes([max(float(x), 1.0) for x in (0.05 * counts.sum(), *sums[1:])]))
    width = np.floor(np.log2(classes)).astype(np.int64)
    place = np.zeros(len(v), np.int64)
    for n in range(1, int(size.max(initial=0)) + 1):
        lo, hi = (1 << n - 1) - 1, min((1 << n) - 1, len(v))
        place[sorted(range(lo, hi), key=words.__getitem__)] = np.arange(hi - lo)
    code = (classes[size] << (size - 1)) | place
    return np.r_[code, classes[0]].astype(np.int32), np.r_[width[size] + size - 1, width[0]].astype(np.int32), int(classes.max())


def letter_codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A Huffman code for the 256 bytes by their share in the frequent words (a line feed ends a word):
    codes with a leading 1, and lengths."""
    share = np.bincount(np.frombuffer(b"\n".join(words) + b"\n", np.uint8), minlength=256) + 0.5
    code = np.array(class_codes(share.tolist()), np.int64)
    return code.astype(np.int32), np.floor(np.log2(code)).astype(np.int32)


def mixed(h: np.ndarray, *more) -> np.ndarray:
    """A 32-bit hash of some numbers."""
    out = (h.astype(np.uint32) + np.uint32(1)) * np.uint32(2654435761)
    for x in more:
        out = (out ^ (x.astype(np.uint32) + np.uint32(7)) * np.uint32(2246822519)) * np.uint32(3266489917)
        out ^= out >> np.uint32(13)
    return out


class Words:
    """Tokens as places in one buffer, which has ``PAD`` more bytes before and after them."""

    def __init__(self, text: bytes, start: np.ndarray, stop: np.ndarray):
        self.text, self.start, self.stop = text, start, stop

    @classmethod
    def of(cls, words: list[bytes]) -> Words:
        size = np.fromiter(map(len, words), np.int64, len(words))
        stop = PAD + np.cumsum(size)
        return cls(bytes(PAD) + b"".join(words) + bytes(PAD), stop - size, stop)

    def __len__(self) -> int:
        return len(self.start)

    def __getitem__(self, i):
        if isinstance(i, slice):
            return Words(self.text, self.start[i], self.stop[i])
        return self.text[self.start[i] : self.stop[i]]

    def some(self, numbers: np.ndarray) -> list[bytes]:
        return [self.text[a:b] for a, b in zip(self.start[numbers].tolist(), self.stop[numbers].tolist())]

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The first eight bytes (fewer: zeros follow), the length, the numbers of the words with over eight
        bytes, and the last eight bytes of these. Up to 16 bytes that is the whole word."""
        eight = np.ndarray((len(self.text) - 7,), "<u8", self.text, strides=(1,))
        size = self.stop - self.start
        head = eight[self.start]
        head &= MASKS.take(size, mode="clip")
        long = np.flatnonzero(size > 8)
        return head, size, long, eight[self.stop[long] - 8]


def hashed(head, size, long, tail) -> np.ndarray:
    """A 64-bit hash of the keys of some words."""
    h = head * np.uint64(ODD)
    h[long] ^= tail * np.uint64(0xC2B2AE3D27D4EB4F)
    h += size.view(np.uint64)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


class Counts:
    """Exact counts of words. Those of up to 16 bytes are kept as their keys: in the order of their hash
    equal ones are neighbours, and whole keys are compared; longer ones are in a dictionary."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, ...]] = []
        self.more: defaultdict[bytes, int] = defaultdict(int)

    def __len__(self) -> int:
        return len(self.more) + sum(len(x[0]) for x in self.held)

    def add(self, words: Words) -> None:
        head, size, long, tail = words.keys()
        last = np.zeros(len(head), np.uint64)
        last[long] = tail
        very = long[size[long] > 16]
        for w in words.some(very):
            self.more[w] += 1
        times = np.ones(len(head), np.int64)
        times[very] = 0
        self.held.append(self.summed(head, size, last, times))

    @staticmethod
    def summed(head, size, last, times):
        long = np.flatnonzero(size > 8)
        order = np.argsort(hashed(head, size, long, last[long]))
        head, size, last = head[order], size[order], last[order]
        at = np.flatnonzero(np.r_[True, (head[1:] != head[:-1]) | (size[1:] != size[:-1]) | (last[1:] != last[:-1])])
        times = np.add.reduceat(times[order], at)
        at, times = at[times > 0], times[times > 0]
        return head[at], size[at], last[at], times

    def merge(self) -> None:
        if len(self.held) > 1:
            self.held = [self.summed(*map(np.concatenate, zip(*self.held)))]

    def take(self) -> tuple[pa.Array, pa.Array]:
        """All words and their counts, which are then forgotten. A word may come twice if its hash is
        another's as well."""
        self.merge()
        head, size, last, times = self.held[0] if self.held else [np.zeros(0, np.uint64)] * 4
        both = np.empty((len(head), 2), "<u8")
        # Of the last eight bytes those that the first eight don't hold.
        both[:, 0], both[:, 1] = head, last >> (np.uint64(8) * (16 - np.clip(size, 9, 16)).astype(np.uint64))
        text = both.view(np.uint8).reshape(-1, 16)[np.arange(16) < size[:, None]]
        offsets = np.r_[0, np.cumsum(size)].astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(offsets), pa.py_buffer(text)])
        more = [pa.array(list(x), t) for x, t in ((self.more.keys(), pa.binary()), (self.more.values(), pa.int64()))]
        self.held, self.more = [], defaultdict(int)
        return pa.concat_arrays([words, more[0]]), pa.concat_arrays([pa.array(times, pa.int64()), more[1]])


class Index:
    """Words to ranks: a hash table by probing, in which whole words are compared; those of over 16 bytes
    are in a dictionary."""

    def __init__(self, words: list[bytes]):
        self.more = {w: i for i, w in enumerate(words) if len(w) > 16}
        self.head, self.size, long, tail = Words.of(words).keys()
        self.tail = np.zeros(len(words), np.uint64)
        self.tail[long] = tail
        self.shift = np.uint64(64 - max(10, 2 + len(words).bit_length()))
        self.table = np.full(1 << 64 - int(self.shift), -1, np.int32)
        left = np.flatnonzero(self.size <= 16)
        slot = (hashed(self.head, self.size, long, tail) >> self.shift).view(np.int64)[left]
        while len(left):
            free = np.flatnonzero(self.table[slot] < 0)
            self.table[slot[free]] = left[free]
            lost = self.table[slot] != left
            left, slot = left[lost], (slot[lost] + 1) % len(self.table)

    def ranks(self, words: Words) -> np.ndarray:
        """-1: not there."""
        head, size, long, tail = words.keys()
        slot = (hashed(head, size, long, tail) >> self.shift).view(np.int64)
        out = self.table.take(slot).astype(np.int64)
        if not len(self.head):
            return out
        wrong = self.head.take(out, mode="clip") != head
        wrong |= self.size.take(out, mode="clip") != size
        wrong[long] |= self.tail.take(out[long], mode="clip") != tail
        left = np.flatnonzero(wrong & (out >= 0))
        last = np.zeros(0, np.uint64)
        if len(left):
            last = np.zeros(len(head), np.uint64)
            last[long] = tail
        while len(left):
            slot[left] = at = (slot[left] + 1) % len(self.table)
            out[left] = got = self.table[at]
            same = (self.head[got] == head[left]) & (self.size[got] == size[left]) & (self.tail[got] == last[left])
            left = left[(got >= 0) & ~same]
        very = long[size[long] > 16]
        out[very] = [self.more.get(w, -1) for w in words.some(very)]
        return out


class Coder:
    """Tokens to bits: what training and scoring share. A token is a symbol, and a spelled one is
    followed by a symbol for each letter; each bit has its node (the code so far, letters apart)."""

    def __init__(self, words: list[bytes], counts: np.ndarray, bits: int):
        self.words, self.bits, self.key = words, bits, uuid.uuid4().hex
        self.code, self.length, self.classes = code_words(words, counts)
        self.letter_code, self.letter_length = letter_codes(words)
        self.nodes = int(self.code.max()) // 2 + 1  # letters' nodes come after

    def index(self) -> Index:
        """Made once in each Python process."""
        if CACHE.get("key") != self.key:
            CACHE.clear()
            CACHE.update(key=self.key, index=Index(self.words))
        return CACHE["index"]

    def ranks(self, words: Words) -> np.ndarray:
        return self.index().ranks(words)

    def before(self, ranks: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each token's topic, word before, and word before that; ``first`` marks a text's first token."""
        n = len(ranks)
        own = np.where(ranks < 0, RARE, ranks).astype(np.uint32)
        one = np.r_[np.uint32(START), own[:-1]]
        one[first] = START
        two = np.r_[np.uint32(START), one[:-1]]
        two[first] = START
        at = np.arange(n)
        start = np.maximum.accumulate(np.where(first, at, 0))
        last = np.r_[-1, np.maximum.accumulate(np.where((ranks >= 0) & (ranks < TOPICS), at, -1))[:-1]]
        return np.where(last >= start, own[np.maximum(last, 0)], np.uint32(NONE)), one, two

    def contexts(self, ranks: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The hashes of each token's topic, word before, and two words before."""
        topic, one, two = self.before(ranks, first)
        return mixed(topic), mixed(one), mixed(one, two)

    def decisions(self, words: Words, ranks: np.ndarray, hashes):
        """(node, bit, the slots of the three contexts, kind of the bit, bits of each token) of some
        tokens with the hashes of their contexts. Kinds: 0 class, 1 place in the class, 2 letter."""
        n, spelled = len(ranks), np.flatnonzero(ranks < 0)
        which = np.where(ranks < 0, len(self.words), ranks)
        extra = np.zeros(n, np.int64)
        extra[spelled] = words.stop[spelled] - words.start[spelled] + 1
        ends = np.cumsum(extra + 1)
        at = ends - extra - 1  # of each token among the symbols
        total = int(ends[-1]) if n else 0
        is_letter = np.ones(total, bool)
        is_letter[at] = False
        code, length, base = np.empty(total, np.int32), np.empty(total, np.int32), np.zeros(total, np.int32)
        code[at], length[at] = self.code[which], self.length[which]
        own = [np.empty(total, np.uint32) for _ in hashes]
        for x, h in zip(own, hashes):
            x[at] = h
        if len(spelled):
            letter, before = letters_of(words.some(spelled))
            code[is_letter], length[is_letter], base[is_letter] = self.letter_code[letter], self.letter_length[letter], self.nodes
            for x, h in zip(own, letter_contexts(before)):
                x[is_letter] = h
        node, bit, slots = self.expand(code, length, base, own)
        kind = np.maximum((node >= self.nodes).view(np.uint8) << 1, (node > self.classes).view(np.uint8))
        sums = np.r_[0, np.cumsum(length, dtype=np.int64)]
        return node, bit, slots, kind, sums[ends] - sums[at]

    def expand(self, code: np.ndarray, length: np.ndarray, base, own):
        """(node, bit, the slot of each context) of each bit of some symbols with their codes, lengths, the
        first of their nodes (one for each or for all), and the hashes of their contexts."""
        size = int(length.sum())
        left = np.repeat(np.cumsum(length, dtype=np.int32), length)
        left -= np.arange(1, size + 1, dtype=np.int32)
        node = np.repeat(code, length)
        node >>= left
        bit = node.astype(np.uint8)
        bit &= np.uint8(1)
        node >>= np.int32(1)
        node += np.repeat(base, length) if isinstance(base, np.ndarray) else np.int32(base)
        spread = node.view(np.uint32) * np.uint32(668265263)
        slots = []
        for h in own:
            x = np.repeat(h, length)
            x ^= spread
            x *= np.uint32(374761393)
            x ^= np.right_shift(x, np.uint32(15), out=left.view(np.uint32))
            x *= np.uint32(2246822519)
            x >>= np.uint32(32 - self.bits)
            slots.append(x)
        return node, bit, slots


def letters_of(words: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The letters of spelled words, a line feed after each, and the four before; nothing of the word
    before counts."""
    text = np.frombuffer(b"\n" * 4 + b"\n".join(words) + b"\n", np.uint8)
    before = [text[3:-1].astype(np.uint32)]
    for k in (2, 1, 0):
        before.append(np.where(before[-1] == 10, np.uint32(10), text[k : k - 4].astype(np.uint32)))
    return text[4:], before


def letter_contexts(before: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pair = before[0] | before[1] << np.uint32(8)
    return mixed(before[0], before[0]), mixed(pair, pair), mixed(pair, before[2] | before[3] << np.uint32(8))


CACHE: dict = {}


def split_words(texts: list[bytes]) -> tuple[Words, np.ndarray]:
    """The tokens of some texts, as ``tokens`` gives them, and how many each text has."""
    text = b" " * PAD + b" ".join(texts).translate(LOWER_ASCII) + b" " * PAD
    x = np.frombuffer(text, np.uint8)
    gap = x - np.uint8(9) < 5
    gap |= x == 32
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    stops = PAD + np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
    sizes = np.diff(np.searchsorted(edge[::2], stops), prepend=0) + 1
    ends = np.cumsum(sizes) - 1
    own = np.ones(len(edge) // 2 + len(texts), bool)
    own[ends] = False
    start, stop = np.empty(len(own), np.int64), np.empty(len(own), np.int64)
    start[own], stop[own] = edge[::2], edge[1::2]
    start[ends] = stop[ends] = stops
    return Words(text, start, stop), sizes


def firsts(sizes: np.ndarray) -> np.ndarray:
    first = np.zeros(int(sizes.sum()), bool)
    first[np.cumsum(sizes) - sizes] = True
    return first


def flat(batch_texts, most: int):
    """(words, sizes, first) of successive texts with about ``most`` tokens together; ``first`` marks the
    first token of a text."""

    def give(group):
        words, sizes = split_words(group)
        ends = np.cumsum(sizes)
        a = 0
        while a < len(sizes):
            begin = int(ends[a] - sizes[a])
            b = min(int(np.searchsorted(ends, begin + most)) + 1, len(sizes))
            yield words[begin : int(ends[b - 1])], sizes[a:b], firsts(sizes[a:b])
            a = b

    group, held = [], 0
    for text in batch_texts:
        group.append(text.as_py() or b"")
        held += len(group[-1]) + 1
        if held >= 6 * most:
            yield from give(group)
            group, held = [], 0
    if group:
        yield from give(group)


def joined(part: list[list[bytes]]):
    """The same from lists of tokens."""
    sizes = np.fromiter(map(len, part), np.int64, len(part))
    return Words.of(list(chain.from_iterable(part))), sizes, firsts(sizes)


class Tally:
    """Numbers, to be counted once many are there: each different one then costs as much as one."""

    def __init__(self):
        self.held, self.size = [], 0

    def add(self, keys: np.ndarray) -> None:
        self.held.append(keys)
        self.size += len(keys)

    def take(self):
        """(numbers, how often each came) in slices; then all are forgotten."""
        if self.held:
            keys, times = np.unique(np.concatenate(self.held), return_counts=True)
            self.held, self.size = [], 0
            for a in range(0, len(keys), SLICE):
                yield keys[a : a + SLICE], times[a : a + SLICE].astype(np.int32)


def gather(texts: DataFrame, coder: Coder) -> tuple[list[np.ndarray], np.ndarray]:
    """Over all training rows: the log odds of the hashed contexts' slots (one byte each) and the counts
    of the letters in spelled words."""
    shared = texts.sparkSession.sparkContext.broadcast(coder)
    size = 1 << coder.bits
    width = size // PARTS * 2

    def count(batches):
        import zstandard

        coder = shared.value
        tables = [np.zeros(size * 2, np.int32) for _ in range(LETTERS)]
        letters = np.zeros(256, np.int64)
        spelled, topical = Tally(), Tally()

        def add(tables, code, length, base, own, times):
            _, bit, slots = coder.expand(code, length, base, own)
            for t, slot in zip(tables, slots):
                slot <<= np.uint32(1)
                slot |= bit
                np.add.at(t, slot.astype(np.int64), times)

        def add_letters():
            for key, times in spelled.take():
                letter, *before = ((key >> np.uint64(8 * k) & np.uint64(255)).astype(np.uint32) for k in range(5))
                length = coder.letter_length[letter]
                add(tables, coder.letter_code[letter], length, coder.nodes, letter_contexts(before), np.repeat(times, length))

        def add_topics():
            for key, times in topical.take():
                topic, which = (key // codes).astype(np.uint32), key % codes
                length = coder.length[which]
                add(tables[:1], coder.code[which], length, 0, [mixed(np.where(topic == TOPICS, np.uint32(NONE), topic))], np.repeat(times, length))

        codes = np.uint32(len(coder.code))
        for batch in batches:
            for words, _, first in flat(batch.column(0), SLICE):
                ranks = coder.ranks(words)
                which = np.where(ranks < 0, len(coder.words), ranks)
                topic, *last = coder.before(ranks, first)
                add(tables[1:], coder.code[which], coder.length[which], 0, [mixed(last[0]), mixed(*last)], np.int32(1))
                topical.add(np.minimum(topic, np.uint32(TOPICS)) * codes + which.astype(np.uint32))
                rare = words.some(np.flatnonzero(ranks < 0))
                if rare:
                    letter, before = letters_of(rare)
                    letters += np.bincount(letter, minlength=256)
                    high = (before[2] | before[3] << np.uint32(8)).astype(np.uint64)
                    spelled.add(high << np.uint64(24) | (before[0] << np.uint32(8) | before[1] << np.uint32(16) | letter))
                if spelled.size > 1 << 21:
                    add_letters()
                if topical.size > 1 << 22:
                    add_topics()
        add_letters()
        add_topics()
        pack = zstandard.ZstdCompressor(level=1).compress
        for t, counts in enumerate(tables):
            for k in range(PARTS):
                own = counts[k * width : (k + 1) * width]
                if own.any():
                    # Byte planes: most counts are small, so three of four planes are almost empty.
                    yield one(t * PARTS + k, pack(np.ascontiguousarray(own.view(np.uint8).reshape(-1, 4).T).tobytes()))
        if letters.any():
            yield one(LETTERS * PARTS, letters.tobytes())

    def one(part, data):
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([data], pa.binary())], names=["part", "data"])

    def unpacked(part, data):
        import zstandard

        if part == LETTERS * PARTS:
            return np.frombuffer(data, np.int64)
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
        return np.ascontiguousarray(raw.reshape(4, -1).T).view("<i4").ravel().astype(np.int64)

    def sums(batches):
        at, held = None, None
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("data")):
                if part != at and at is not None:
                    yield at, held
                counts = unpacked(part, data.as_py())
                at, held = part, counts if part != at else held + counts
        if at is not None:
            yield at, held

    def add(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for part, counts in sums(batches):
            if part < LETTERS * PARTS:
                counts = np.minimum(counts, (1 << 31) - 1).astype("<i4")
                yield one(part, pack(np.ascontiguousarray(counts.view(np.uint8).reshape(-1, 4).T).tobytes()))
            else:
                yield one(part, counts.tobytes())

    def odds(batches):
        for part, counts in sums(batches):
            yield one(part, log_odds(counts.reshape(-1, 2)).tobytes() if part < LETTERS * PARTS else counts.tobytes())

    schema = "part int, data binary"
    counted = texts.filter(~F.col("held_out")).select("text").mapInArrow(count, schema)
    salted = counted.withColumn("salt", F.spark_partition_id() % 16)
    once = salted.repartition("part", "salt").sortWithinPartitions("part", "salt").select("part", "data").mapInArrow(add, schema)
    got = dict(zip(*once.repartition("part").sortWithinPartitions("part").mapInArrow(odds, schema).toArrow().to_pydict().values()))
    empty = bytes(width // 2)
    slots = [np.frombuffer(b"".join(got.pop(t * PARTS + k, empty) for k in range(PARTS)), np.int8) for t in range(LETTERS)]
    return slots, np.frombuffer(got.get(LETTERS * PARTS, bytes(2048)), np.int64)


def log_odds(pair: np.ndarray, least: float = 0.3) -> np.ndarray:
    """Counts of zeros and ones to log odds in a byte; 0 means not seen."""
    st = np.clip(np.rint(np.log((pair[:, 1] + least) / (pair[:, 0] + least)) * UNIT), -127, 127).astype(np.int8)
    st[(st == 0) & pair.any(axis=1)] = 1
    return st


class Mixer:
    """The whole model: code, plain shares, log odds of the contexts, exact counts of known tokens."""

    def __init__(self, coder: Coder, counts: np.ndarray, slots: list[np.ndarray], letters: np.ndarray, total: int):
        self.coder, self.slots = coder, slots
        self.log_counts = np.log10(counts + 0.1)
        plain = np.zeros((coder.nodes + int(coder.letter_code.max()) // 2 + 1, 2), np.float32)
        own = np.r_[counts, max(total - int(counts.sum()), 0)]
        for code, length, n, base in ((coder.code, coder.length, own, 0), (coder.letter_code, coder.letter_length, letters, coder.nodes)):
            for j in range(1, int(length.max()) + 1):
                some = length >= j
                prefix = code[some] >> (length[some] - j)
                np.add.at(plain, (base + (prefix >> 1), prefix & 1), n[some].astype(np.float32))
        self.plain = log_odds(plain, 0.05)

    def bits(self, words: Words, ranks: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The cost in bits of each token."""
        hashes, spelled = self.coder.contexts(ranks, first), words.some(np.flatnonzero(ranks < 0))
        total = int(self.coder.length[np.where(ranks < 0, len(self.coder.words), ranks)].sum())
        if spelled:
            total += int(self.coder.letter_length[np.frombuffer(b"\n".join(spelled) + b"\n", np.uint8)].sum())
        lengths, cells, at = [], np.zeros((total + STRIP, 8), np.int8), 0
        for a in range(0, len(ranks), SLICE):
            b = a + SLICE
            node, bit, slots, kind, length = self.coder.decisions(words[a:b], ranks[a:b], [h[a:b] for h in hashes])
            x = cells[at : at + len(bit)]
            at += len(bit)
            x[:, 0] = self.plain.take(node, mode="clip")
            gate = kind << 2
            for k, slot in enumerate(slots):
                odds = self.slots[k].take(slot, mode="clip")
                x[:, k + 1] = odds
                if k:
                    gate |= (odds != 0).view(np.uint8) << (k - 1)
            x[:, 4] = gate << 1 | bit
            lengths.append(length)
        length = np.concatenate(lengths)
        ends = np.cumsum(length)
        doc_start = (ends - length)[first]
        with np.errstate(over="ignore"):
            cost = run_lanes(cells, doc_start, np.diff(np.r_[doc_start, ends[-1]]))
        return np.add.reduceat(cost, ends - length)


def run_lanes(cells: np.ndarray, doc_start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The cost of every bit, from its cell: the log odds of the four predictors and its mark (gate and
    value); ``STRIP`` more cells follow. Texts are cut into lanes of at most LANE bits that run side by side; a lane's four weights
    for a gate lie together."""
    lanes = -(-sizes // LANE)
    which = np.repeat(np.arange(len(sizes)), lanes)
    k = np.arange(len(which)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    start = doc_start[which] + k * LANE
    size = np.minimum(sizes[which] - k * LANE, LANE)
    order = np.argsort(-size, kind="stable")
    cur, size = start[order], size[order]
    n = len(cur)
    weights = np.repeat(np.tile(FIRST_WEIGHTS, (KINDS, 1)) / np.float32(UNIT), n, axis=0).ravel().view(np.complex128)
    refine = np.tile(((np.arange(STEPS) + 0.5) / STEPS).astype(np.float32), KINDS * n)
    cells = cells.reshape(-1).view(np.int64)
    cost = np.empty(len(cells), np.float32)
    longest = int(size.max(initial=0))
    active = (n - np.searchsorted(size[::-1], np.arange(1, longest + 1))).tolist()
    lane, trust, one, slow, steep = np.arange(n), np.float32(REFINED), np.float32(1), np.float32(0.03), np.float32(STEPS - 0.001)
    rate = np.float32(RATE / UNIT / UNIT)
    for begin in range(0, longest, STRIP):
        # A strip of all lanes: read at once, and laid out step by step.
        steps, m = min(STRIP, longest - begin), active[begin]
        at = cur[:m] + np.arange(begin, begin + steps)[:, None]
        strip = cells.take(at, mode="clip")
        # Negative odds make exp(-x) of the sum; errors are then negative as well.
        inputs = np.negative(strip.astype(np.int32).view(np.int8)).astype(np.float32).reshape(steps, m, 4)
        strip >>= 32
        truths = (strip & 1).astype(np.float32)
        strip >>= 1
        rows = strip * n
        rows += lane[:m]
        strip >>= 2
        strip *= STEPS
        strip += lane[:m] * (STEPS * KINDS)
        out, fine = np.zeros((2, steps, m), np.float32)
        for j in range(steps):
            a = active[begin + j]
            x, truth, row, off, finer = inputs[j, :a], truths[j, :a], rows[j, :a], out[j, :a], fine[j, :a]
            w = weights.take(row).view(np.float32).reshape(a, 4)
            pair = (x * w).view(np.complex64)
            p = pair[:, 0] + pair[:, 1]
            p = p.real + p.imag
            np.exp(p, out=p)
            p += one
            np.reciprocal(p, out=p)
            np.subtract(p, truth, out=off)
            p *= steep
            seat = p.astype(np.int64)
            seat += strip[j, :a]
            r = refine.take(seat)
            np.subtract(r, truth, out=finer)
            r -= finer * slow
            refine[seat] = r
            x *= (off * rate).repeat(4).reshape(a, 4)
            w += x
            weights[row] = w.reshape(-1).view(np.complex128)
        fine -= out
        fine *= trust
        out += fine
        for i, a in enumerate(active[begin : begin + steps]) if active[begin + steps - 1] < m else ():
            at[i, a:] = len(cost) - 1
        cost[at] = out
    cost = cost[: len(cost) - STRIP]
    np.abs(cost, out=cost)
    np.subtract(one, cost, out=cost)
    np.maximum(cost, np.float32(1e-7), out=cost)
    np.log2(cost, out=cost)
    return np.negative(cost, out=cost)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Mixer, DataFrame, int, int]:
    """The model, the table of exact token counts, and N and V."""
    texts = texts_of(docs, id_col, text_col)
    counts = count_tokens(texts)
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    words, own = frequent(counts, WORDS)
    coder = Coder(words, own, int(min(MOST_BITS, max(14, math.ceil(math.log2(total + 1)) + 1))))
    return Mixer(coder, own, *gather(texts, coder), total), counts, total, distinct


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    model, counts, total, distinct = fit(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 40
        model = shared.value
        known = len(model.log_counts)
        for batch in batches:
            at, bounds = 0, np.r_[0, np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0))]
            for words, sizes, first in flat(batch.column(1), SUB):
                ranks = model.coder.ranks(words)
                starts = np.cumsum(sizes) - sizes
                log10 = model.bits(words, ranks, first) * -math.log10(2)
                seen = ranks >= 0
                base = np.where(seen, model.log_counts[np.where(seen, ranks, 0)] if known else 0.0, 0.0)
                add = lambda x: np.add.reduceat(x, starts)
                rare = np.flatnonzero(ranks < 0)
                owner = np.searchsorted(starts, rare, side="right") - 1
                offsets = np.searchsorted(owner, np.arange(len(sizes) + 1)).astype(np.int32)
                n_bytes = np.diff(bounds[at : at + len(sizes) + 1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(serial, serial + len(sizes))), batch.column(0).slice(at, len(sizes)), batch.column(2).slice(at, len(sizes)), pa.array(sizes), pa.array(add(seen.astype(np.int64))),
                        pa.array(add(base)), pa.array(add(log10.astype(np.float64))), pa.array(n_bytes), pa.ListArray.from_arrays(pa.array(offsets), pa.array(words.some(rare), pa.binary())),
                    ],
                    names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "n_bytes", "rare"],
                )
                at += len(sizes)
                serial += len(sizes)

    schema = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, n_bytes long, rare array<binary>"
    rows = stored(texts_of(docs, id_col, text_col).select("doc_id", "text", "held_out").mapInArrow(run, schema), "scored")
    loose = rows.select("row", F.explode("rare").alias("token")).join(counts, "token", "left")
    rest = loose.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("rest"), F.count("n").alias("more"))
    zero = F.lit(0)
    return rows.join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", zero)).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(total + 0.1 * (distinct + 1)))).alias("base_score"), "score",
        F.try_divide(-F.col("score") / math.log10(2), F.col("n_bytes")).alias("bits_per_byte"),
    )


def op9_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op9_context_mixing": op9_context_mixing}
