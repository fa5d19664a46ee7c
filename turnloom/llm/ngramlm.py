"""N-gram language model: Elias-Fano tries, one a word shard, with quantised smoothed probabilities.

Tokens are words `[^\\x20\\x09-\\x0D]+` (A-Z lower-cased) and one end a text; contexts are padded with two starts.
All counts cover all training documents. With c over training tokens, N tokens and V distinct ones:

    p1(w)     = (c(w) + 0.5) / (N + 0.5 (V + 1))
    p2(w|v)   = (c(vw) + MU2 p1(w)) / (c(v) + MU2)   for every v (p1(w) if c(v) < FREQUENT N; FREQUENT is 0)
    p3(w|uv)  = (c(uvw) + MU3 p2(w|v)) / (c(uv) + MU3)

Each level sums to one over the known words and one unknown word. The score of a text is the sum of
log10 p3, the base score that of log10 p1.

How it is spread. A token's counts c(w), c(vw), c(uvw) belong to its word w, so they are kept by a shard of w.
The denominator c(uv) + MU3 stands alone in a sum of logarithms, so it is added not where it is used but
where c(uv) is counted: at the token before, in the shard of v. What is left is c(v), which p2 needs in the shard of w.
That of words of at least LISTED N (1 / LISTED words at most) is broadcast. For any other v each batch
asks the shard that v belongs to, and that shard sends c(v), once, to each shard that needs it. So tokens are
shuffled once, as packed arrays per batch and shard, and come back as one partial sum for each document in a shard. A hot w,
of at least HOT N, is dealt to many shards by hash(v, w), which keeps c(vw) and c(uvw) whole; its c(w) is in
the broadcast table. A hot vw is dealt by hash(u, v, w), and its c(vw) is in a second table; the tokens of a hot uvw are
scored where they are read, from a third. Which n-grams are hot is decided on a bounded sample of the texts (GRAM_SAMPLE bytes): it
decides only where a token is scored, and what the tables hold is counted over all training documents. So a shard holds
SHARD_TOKENS on average, and of one n-gram about HOT_GRAMS N or SHARD_TOKENS / 16 tokens at most. Nothing else is broadcast or
collected, however large the corpus is.

A shard's model is a reversed trie w -> v -> u, each level a monotone sequence in Elias-Fano code: the
ids of a node's children are added to the last value of the nodes before, and pointers to children are
sums of their numbers. Levels are read and searched as they are packed: select on the unary bits gives a value, or the first
value of a high part, from which a successor search goes on; no level is decoded. A child u is not kept as an id but by its rank among the words that stand before v
in this shard, so a query first finds that rank and then seeks it among the children by successor search.
Levels are packed into one block of mapped memory (`mmap`); probabilities are 16-bit codes of their logarithm.

Nulls: a null text counts as an empty one, with the end as its one token. A null doc_id counts as training.
Repeated rows are counted and scored one by one. Empty tables give no rows. Long texts are taken whole. Further
columns are ignored.
"""

from __future__ import annotations

import itertools
import mmap
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import LOWER, crc_of, distinct, give_back, mix, tidied, word_hashes, written

MU2, MU3 = 200.0, 20.0
#: A context word of less than this share of the training tokens has no bigram level: 0, so every counted word has one.
FREQUENT = 0.0
#: A word of at least the first share of the training tokens is dealt to many shards; of at least the second, its count is broadcast.
HOT, LISTED = 1e-5, 1e-6
#: Tokens for each shard, on average.
SHARD_TOKENS = 1_200_000
#: A bigram or trigram of about this share of the tokens (or of a sixteenth of a shard, if that is more) is split; bytes of text that decide it.
HOT_GRAMS, GRAM_SAMPLE = 1e-4, 12_000_000
#: Documents whose tokens are dealt to the shards at a time, and queries that a level answers at a time.
BATCH_DOCS, QUERIES = 8000, 1 << 16
_BLANK = re.compile(rb"[ \t-\r]")
LOWER_FROM, LOWER_TO = slice(65, 91), slice(97, 123)
#: Identities of the end and the start, in place of a word's hash.
END, START = np.uint64(1), np.uint64(2)
#: Log10 probabilities are kept in steps of 1/STEP from 0 down.
STEP = 4000.0


# ---- Elias-Fano ---------------------------------------------------------------------------------------------------


def _select_in_word(bits: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The place of the rest-th one (from 0) of each 64-bit word: byte sums side by side, then a table for the byte."""
    s = bits - ((bits >> np.uint64(1)) & np.uint64(0x5555555555555555))
    s = (s & np.uint64(0x3333333333333333)) + ((s >> np.uint64(2)) & np.uint64(0x3333333333333333))
    s = ((s + (s >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * np.uint64(0x0101010101010101)
    rest = rest.astype(np.uint64)
    before = ((rest * np.uint64(0x0101010101010101)) | np.uint64(0x8080808080808080)) - s & np.uint64(0x8080808080808080)
    shift = np.bitwise_count(before).astype(np.uint64) << np.uint64(3)
    rest -= ((s << np.uint64(8)) >> shift) & np.uint64(255)
    return (shift + _SELECT_IN_BYTE[((bits >> shift) & np.uint64(255)).astype(np.int64), rest.astype(np.int64)]).astype(np.int64)


_SELECT_IN_BYTE = np.zeros((256, 8), np.uint64)
for _byte in range(256):
    _places = [k for k in range(8) if _byte >> k & 1]
    _SELECT_IN_BYTE[_byte, : len(_places)] = _places


class EliasFano:
    """A monotone sequence of integers: low bits packed, high bits in unary. Read and searched in place, by select."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones, self.zeros = n, low_bits, low, high, ones, zeros
        self.mask = np.uint64((1 << low_bits) - 1)
        self.bytes = np.ndarray(8 * len(low) - 7, np.uint64, low.data, strides=(1,))  # eight bytes from any one on
        self.last = int(self.get(np.array([n - 1]))[0]) if n else -1

    @staticmethod
    def parts(values: np.ndarray) -> tuple[int, list[np.ndarray]]:
        """Bits of the low part, and the arrays of the code: low bits, unary high bits, ones and zeros before each word."""
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        place = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(((int(place[-1]) // 64 + 2) if n else 1) * 64, bool)
        unary[place] = True
        high = np.packbits(unary, bitorder="little").view(np.uint64)
        low = values & np.uint64((1 << low_bits) - 1)
        packed = np.zeros(n * low_bits // 64 + 2, np.uint64)
        if low_bits and n:
            bit = np.arange(n) * low_bits
            shift = (bit & 63).astype(np.uint64)
            word = bit >> 6
            first = np.flatnonzero(np.diff(word, prepend=-1))  # the value that begins first in each word
            packed[word[first]] = np.bitwise_or.reduceat(low << shift, first)
            spill = np.flatnonzero((bit & 63) + low_bits > 64)  # one a word at most
            packed[word[spill] + 1] |= low[spill] >> (np.uint64(64) - shift[spill])
        ones = np.zeros(len(high), np.int32)
        np.cumsum(np.bitwise_count(high[:-1]), out=ones[1:])
        return low_bits, [packed, high, ones, (np.arange(len(high)) * 64 - ones).astype(np.int32)]

    def _low(self, i: np.ndarray) -> np.ndarray:
        """Low bits of the values at i: eight bytes from the one that holds the first bit."""
        bit = i * self.low_bits
        return (self.bytes[bit >> 3] >> (bit & 7).astype(np.uint64)) & self.mask

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at i."""
        word = np.searchsorted(self.ones, i, "right") - 1
        high = word * 64 + _select_in_word(self.high[word], i - self.ones[word]) - i
        return (high << self.low_bits) | self._low(i).astype(np.int64) if self.low_bits else high

    def _begin(self, high: np.ndarray) -> np.ndarray:
        """The first index whose high part is at least `high`: what stands before the zero that ends the part before."""
        k = np.maximum(high - 1, 0)
        word = np.searchsorted(self.zeros, k, "right") - 1
        place = word * 64 + _select_in_word(~self.high[word], k - self.zeros[word])
        return np.where(high > 0, place - k, 0)

    def _state(self, at: np.ndarray, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of indexes not before _begin(high): whether their value is of this high part and below, or just, the wanted one.

        An index has the high part if its one follows `high` zeros and as many ones as the index says.
        """
        place = at + high
        there = (self.high[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) > 0
        if not self.low_bits:
            return np.zeros(len(at), bool), there
        own = self._low(np.minimum(at, self.n - 1))
        return there & (own < low), there & (own == low)

    def seek(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Successor search: the first index whose value is at least the wanted one, and whether it is that."""
        if not self.n or not len(wanted):
            return np.full(len(wanted), self.n), np.zeros(len(wanted), bool)
        past = wanted > self.last
        if past.any():  # beyond all values
            out, equal = np.full(len(wanted), self.n), np.zeros(len(wanted), bool)
            inside = np.flatnonzero(~past)
            if len(inside):
                out[inside], equal[inside] = self.seek(wanted[inside])
            return out, equal
        high, low = wanted >> self.low_bits, wanted.astype(np.uint64) & self.mask
        out = self._begin(high)
        less, equal = self._state(out, high, low)
        live = np.flatnonzero(less)
        high, low, at = high[live], low[live], out[live]
        for _ in range(8):  # along the few values that share the high part
            if not len(live):
                return out, equal
            at = at + 1
            less, same = self._state(at, high, low)
            out[live], equal[live] = at, same
            live, high, low, at = live[less], high[less], low[less], at[less]
        # a high part that many values share: halves
        first, last = at, self._begin(high + 1)
        while (first < last).any():
            middle = (first + last) >> 1
            less = (first < last) & (self._low(np.minimum(middle, self.n - 1)) < low)
            first, last = np.where(less, middle + 1, first), np.where(less, last, np.minimum(middle, last))
        out[live] = first
        equal[live] = self._state(first, high, low)[1]
        return out, equal

    def successor(self, begin: np.ndarray, end: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """In each range [begin, end): the first index whose value is at least the wanted one."""
        return np.clip(self.seek(wanted)[0], begin, end)


class Level:
    """Children of nodes: ids ascend within a node; pointers say where each node's children begin."""

    def __init__(self, parent: np.ndarray, ids: np.ndarray, parents: int, store: Memory):
        # prefix sums: what the nodes before ended with is added, so that the level is one monotone sequence
        count = np.bincount(parent, minlength=parents)
        starts = np.concatenate([[0], np.cumsum(count)])
        last = np.zeros(parents, np.int64)
        full = count > 0
        last[full] = ids[starts[1:][full] - 1] + 1
        base = np.concatenate([[0], np.cumsum(last)[:-1]]) if parents else np.zeros(0, np.int64)
        self.pointers, self.values, self.bases = store.keep(starts), store.keep(ids + base[parent]), store.keep(base)

    def find(self, parent: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Index of the child with the wanted id, or -1. Also -1 below a parent of -1. So many queries at a time as the caches hold."""
        out = np.full(len(parent), -1)
        if self.values.n:
            for k in range(0, len(parent), QUERIES):
                out[k : k + QUERIES] = self._find(parent[k : k + QUERIES], wanted[k : k + QUERIES])
        return out

    def _find(self, parent: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        able = (parent >= 0) & (wanted >= 0)
        if not able.all():
            out = np.full(len(parent), -1)
            out[able] = self._find(parent[able], wanted[able]) if able.any() else -1
            return out
        at, equal = self.values.seek(wanted + self.bases.get(parent))
        there = np.flatnonzero(equal)
        out = np.full(len(parent), -1)
        there = there[at[there] < self.pointers.get(parent[there] + 1)]  # else it is a child of a later node
        out[there] = at[there]
        return out


class Memory:
    """Arrays laid one behind the other in one anonymous mapping."""

    def __init__(self, size: int = 1 << 26):
        self.map, self.at, self.size = mmap.mmap(-1, size), 0, size
        self.used = 0

    def put(self, array: np.ndarray) -> np.ndarray:
        raw = np.ascontiguousarray(array)
        if self.at + raw.nbytes + 8 > self.size:  # a further mapping; views keep the full one alive
            self.size = max(self.size, raw.nbytes + 64)
            self.map, self.at = mmap.mmap(-1, self.size), 0
        view = np.frombuffer(self.map, raw.dtype, raw.size, self.at)
        view[:] = raw.reshape(-1)
        self.at += -(-raw.nbytes // 8) * 8
        self.used += raw.nbytes
        return view

    def keep(self, values: np.ndarray) -> EliasFano:
        low_bits, arrays = EliasFano.parts(np.asarray(values))
        return EliasFano(len(values), low_bits, *map(self.put, arrays))


def quantised(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 * STEP), 0, 65535).astype(np.uint16)


class Trie:
    """Counts of the training tokens of one shard, as reversed n-grams w -> v -> u of local ids.

    w, v, u, c3: the distinct trigrams in order of (w, v, u), and their counts. n: local ids. c1: c(w) by local id. heavy: c(v)
    by local id, 0 if v has no bigram level. z: N + 0.5 (V + 1). total: c(vw) of each trigram's bigram where other shards hold some of
    its trigrams, else -1 (such bigrams may come with trigrams of count 0).
    """

    def __init__(self, w: np.ndarray, v: np.ndarray, u: np.ndarray, c3: np.ndarray, n: int, c1: np.ndarray, heavy: np.ndarray, z: float, total: np.ndarray | None = None):
        self.store = store = Memory()
        begin = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (v[1:] != v[:-1])])) if len(w) else np.zeros(0, np.int64)
        pair_of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(w))))
        c2 = np.add.reduceat(c3, begin) if len(w) else c3
        if total is not None:
            c2 = np.where(total[begin] >= 0, total[begin], c2)
        # u by its rank among the words in front of v
        key = v.astype(np.int64) * n + u
        order = np.argsort(key, kind="stable")
        new = np.diff(key[order], prepend=-1) > 0
        front = key[order[new]]
        place = np.empty(len(key), np.int64)
        place[order] = np.cumsum(new) - 1
        del key, order, new
        front_v = front // n
        self.front = Level(front_v, front % n, n, store)
        rank = place - np.searchsorted(front_v, np.arange(n + 1))[v]
        self.second = Level(w[begin].astype(np.int64), v[begin].astype(np.int64), n, store)
        self.third = Level(pair_of, rank, len(begin), store)
        self.p1, self.heavy = (c1 + 0.5) / z, heavy
        p2 = self.mixed(v[begin], w[begin], c2)
        p3 = c3 + MU3 * p2[pair_of]
        # smoothed probabilities; of trigrams the part above the denominator, which is added elsewhere
        self.code2 = store.put(quantised(np.log10(p2)))
        self.top3, self.top2 = float(np.log10(p3.max(initial=1.0))), float(np.log10(c2.max(initial=1) + MU3))
        self.code3 = store.put(quantised(np.log10(p3) - self.top3))
        self.below = store.put(quantised(np.log10(c2 + MU3) - self.top2))

    def mixed(self, v: np.ndarray, w: np.ndarray, c2: np.ndarray | int) -> np.ndarray:
        return np.where(self.heavy[v] > 0, (c2 + MU2 * self.p1[w]) / (self.heavy[v] + MU2), self.p1[w])

    def score(self, w: np.ndarray, v: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each trigram: log10 of c(uvw) + MU3 p2(w|v), and log10 of c(vw) + MU3 (what the next token is divided by).

        The trigrams come in order of (w, v, u); a bigram that several share is sought once.
        """
        if not len(w):
            return np.zeros(0), np.zeros(0)
        begin = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (v[1:] != v[:-1])]))
        many = np.diff(np.append(begin, len(w)))
        w2, v2 = w[begin].astype(np.int64), v[begin].astype(np.int64)
        pair = self.second.find(w2, v2)
        known = np.flatnonzero(pair >= 0)
        p2 = self.mixed(v2, w2, 0)
        below = np.full(len(pair), np.log10(MU3))
        if len(known):
            p2[known] = 10.0 ** -(self.code2[pair[known]] / STEP)
            below[known] = self.top2 - self.below[pair[known]] / STEP
        above = np.repeat(np.log10(MU3 * p2), many)
        asked = np.flatnonzero(np.repeat(pair >= 0, many))
        if len(asked):
            before = v[asked].astype(np.int64)
            rank = self.front.find(before, u[asked].astype(np.int64))
            there = rank >= 0
            asked, rank = asked[there], rank[there] - self.front.pointers.get(before[there])
            triple = self.third.find(np.repeat(pair, many)[asked], rank)
            there = triple >= 0
            above[asked[there]] = self.top3 - self.code3[triple[there]] / STEP
        return above, np.repeat(below, many)


def trigrams(w: np.ndarray, v: np.ndarray, u: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct trigrams in order, and for each row which it is."""
    key = w.astype(np.int64) * n + v
    if n**3 >= 1 << 63:  # too many ids for one key: bigrams by their rank first
        pairs, key = np.unique(key, return_inverse=True)
    else:
        pairs = None
    key, back = np.unique(key * n + u, return_inverse=True)
    pair, last = key // n, (key % n).astype(np.int32)
    if pairs is not None:
        pair = pairs[pair]
    return (pair // n).astype(np.int32), (pair % n).astype(np.int32), last, back.astype(np.int32)


# ---- packing of a batch's tokens by shard ----------------------------------------------------------------------------


#: A random number for each byte, and powers of an odd number and of its inverse modulo 2^64, for text of so many bytes at a time.
_CHUNK = 1 << 19
_BYTE_NUMBER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
_BYTE_NUMBER[LOWER_FROM] = _BYTE_NUMBER[LOWER_TO]
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[9, 10, 11, 12, 13, 32]] = True
_ODD = 0x9E3779B97F4A7C15


def _powers(base: int, count: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(count, base, np.uint64)]), dtype=np.uint64)


_UP, _DOWN = _powers(_ODD, _CHUNK), _powers(pow(_ODD, -1, 1 << 64), _CHUNK)


def _hashed(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a text of _CHUNK bytes at most, A-Z lower-cased, and where each begins.

    A word's hash is the sum of its bytes' numbers times powers of an odd number, counted from its start: differences of one running sum,
    moved there by the inverse power. So no word is ever an object of its own.
    """
    byte = np.frombuffer(raw, np.uint8)
    inside = ~_IS_BLANK[byte]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    begin, end = edge[::2], edge[1::2]
    total = np.zeros(len(byte) + 1, np.uint64)
    np.cumsum(_BYTE_NUMBER[byte] * _UP[: len(byte)], out=total[1:])
    return mix((total[end] - total[begin]) * _DOWN[begin] + (end - begin).astype(np.uint64)), begin


def text_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, one behind the other, and the number of words of each text."""
    counts = np.zeros(len(texts), np.int64)
    out: list[np.ndarray] = []
    held: list[bytes] = []
    first, size = 0, 0

    def flush(upto: int) -> None:
        if held:
            starts = np.cumsum([0, *(len(r) + 1 for r in held)])
            hashes, begin = _hashed(b" ".join(held))
            out.append(hashes)
            counts[first:upto] = np.diff(np.searchsorted(begin, starts))
            held.clear()

    for i, t in enumerate(texts):
        raw = b"" if t is None else t.encode("utf-8", "surrogatepass")
        if size + len(raw) >= _CHUNK:
            flush(i)
            first, size = i, 0
        if len(raw) >= _CHUNK - 1:  # a long text: in parts that end at blanks; a word of a whole part is hashed by itself
            for part in _parts(raw):
                if isinstance(part, np.ndarray):
                    out.append(part)
                    counts[i] += 1
                else:
                    hashes, _ = _hashed(part)
                    out.append(hashes)
                    counts[i] += len(hashes)
            first = i + 1
        else:
            held.append(raw)
            size += len(raw) + 1
    flush(len(texts))
    return np.concatenate([np.zeros(0, np.uint64), *out]), counts


def _parts(raw: bytes) -> Iterator[bytes | np.ndarray]:
    """A long text in parts of under _CHUNK bytes that end at blanks; of a word longer than that, its hash."""
    at = 0
    while at < len(raw):
        part = raw[at : at + _CHUNK - 1]
        if at + len(part) < len(raw):
            cut = max(part.rfind(b) for b in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
            if cut < 0:
                found = _BLANK.search(raw, at)
                end = found.start() if found else len(raw)
                yield word_hashes([raw[at:end].translate(LOWER)])
                at = end
                continue
            part = part[: cut + 1]
        yield part
        at += len(part)


def batch_tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the batch's words (and START and END) in order, and for each token its document, w, v and u as indexes in them."""
    words, counts = text_hashes(texts)
    code, hashes = pd.factorize(words)
    hashes = np.concatenate([np.array([START, END]), hashes.astype(np.uint64)])
    order = np.argsort(hashes)
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    # each text: two starts, its words, an end
    lengths = counts + 3
    starts = np.cumsum(lengths) - lengths
    flat = np.empty(int(lengths.sum()), np.int32)
    token = np.ones(len(flat), bool)
    token[starts] = token[starts + 1] = False
    flat[starts] = flat[starts + 1] = place[0]
    flat[starts + lengths - 1] = place[1]
    inner = token.copy()
    inner[starts + lengths - 1] = False
    flat[inner] = place[code + 2]
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), counts + 1)
    at = np.flatnonzero(token)
    return hashes[order], doc, flat[at], flat[at - 1], flat[at - 2]


def bigram_keys(hashes: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(hashes)[w] ^ hashes[v])


def trigram_keys(hashes: np.ndarray, bigrams: np.ndarray, u: np.ndarray) -> np.ndarray:
    return mix(bigrams + mix(hashes ^ np.uint64(0x5DEECE66D))[u])


def places(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where the wanted values stand among ascending keys, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def pack(arrays: list[np.ndarray]) -> bytes:
    head = np.array([len(arrays), *(x for a in arrays for x in (a.dtype.itemsize, len(a)))], np.int64)
    return zstandard.compress(head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 1)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(n, 2)
    out, at = [], 8 + 16 * n
    for size, length in sizes.tolist():
        out.append(np.frombuffer(raw, f"u{size}", length, at))
        at += size * length
    return out


def planes(hashes: np.ndarray) -> np.ndarray:
    """Differences of ascending 64-bit values, byte by byte: the high bytes compress to nothing."""
    return np.diff(hashes, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.reshape(-1)


def unplaned(raw: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).reshape(-1), dtype=np.uint64)


def narrow(a: np.ndarray) -> np.ndarray:
    top = int(a.max(initial=0))
    return a.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32)


# ---- the distributed operator ------------------------------------------------------------------------------------------


def _is_training(ids: list[int | None], held: int, modulus: int) -> np.ndarray:
    return np.fromiter((i is None or crc_of(i) % modulus != held for i in ids), bool, len(ids))


def score(docs: DataFrame, id_column: str = "doc_id", text: str = "text", held: int = 1, modulus: int = 5, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("t"))

    size = source.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    share = min(1.0, GRAM_SAMPLE / max(1, size))

    @tidied
    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of the sample's bigrams (kind 2) and trigrams (kind 3), and of its tokens (kind 1, word 3)."""
        for whole in batches:
            for at in range(0, len(whole), BATCH_DOCS):
                hashes, _, w, v, u = batch_tokens(whole.column(0).slice(at, BATCH_DOCS).to_pylist())
                two = bigram_keys(hashes, v, w)
                grams = []
                for k, x in ((2, two), (3, trigram_keys(hashes, two, u))):
                    key, first, n = np.unique(x, return_index=True, return_counts=True)
                    grams.append((k, key, n, hashes[v[first]], hashes[w[first]]))
                rows = count_rows([(1, np.full(1, 3, np.uint64), np.full(1, len(w))), *(g[:3] for g in grams)])
                words = [pa.array(np.concatenate([np.zeros(1, np.uint64), *(g[i] for g in grams)]).view(np.int64)) for i in (3, 4)]
                yield pa.RecordBatch.from_arrays([*rows.columns, *words], ["kind", "word", "n", "v", "w"])

    def count_rows(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        kind = np.repeat(np.array([p[0] for p in parts], np.int8), [len(p[1]) for p in parts])
        word = np.concatenate([p[1] for p in parts]).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(word), pa.array(np.concatenate([p[2] for p in parts]).astype(np.int64))], ["kind", "word", "n"])

    counts = "kind byte, word long, n long"
    picked = source.filter(F.pmod(F.xxhash64("doc_id", "t", F.lit("ngram")), F.lit(1 << 30)) < share * (1 << 30)).select("t")
    grams = written(picked.mapInArrow(sampled, f"{counts}, v long, w long").groupBy("kind", "word").agg(F.sum("n").alias("n"), F.max("v").alias("v"), F.max("w").alias("w")), "sampled")
    sample_tokens = (grams.filter("kind = 1").agg(F.sum("n")).first()[0]) or 0
    least = max(2.0, sample_tokens * HOT_GRAMS / 2, share * shard_tokens / 32)
    often_seen = grams.filter((F.col("kind") > 1) & (F.col("n") >= least)).select("kind", "word", "v", "w").collect()  # 4 / HOT_GRAMS rows at most
    hot_words = [np.unique(np.array([r[c] for r in often_seen if r["kind"] == 2], np.int64).view(np.uint64)) for c in ("v", "w")]
    hot_keys = [np.sort(np.array([r["word"] for r in often_seen if r["kind"] == k], np.int64).view(np.uint64)) for k in (2, 3)]
    told_hot = spark.sparkContext.broadcast((*hot_keys, *hot_words))

    def hot_bigrams(hashes: np.ndarray, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The tokens of hot bigrams, their keys and places: looked up only where both words are of some hot bigram."""
        two_keys, _, first, second = told_hot.value
        at = np.flatnonzero((places(second, hashes) >= 0)[w] & (places(first, hashes) >= 0)[v]) if len(two_keys) else np.zeros(0, np.int64)
        two = bigram_keys(hashes, v[at], w[at])
        place = places(two_keys, two)
        return at[place >= 0], two[place >= 0], place[place >= 0]

    @tidied
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, tokens, held_words, held_counts, size = 0, 0, [], [], 0
        hot = [np.zeros(len(k), np.int64) for k in told_hot.value[:2]]

        def merged() -> tuple[int, np.ndarray, np.ndarray]:
            words, back = np.unique(np.concatenate([np.zeros(0, np.uint64), *held_words]), return_inverse=True)
            return 1, words, np.bincount(back, np.concatenate([np.zeros(0, np.int64), *held_counts]), minlength=len(words))

        for whole in batches:
            for at in range(0, len(whole), BATCH_DOCS):
                b = whole.slice(at, BATCH_DOCS)
                training = _is_training(b.column(0).to_pylist(), held, modulus)
                hashes, doc, w, v, u = batch_tokens(b.column(1).to_pylist())
                tokens, rows = tokens + len(w), rows + int(training.sum())
                own = training[doc]
                w, v, u = w[own], v[own], u[own]
                n = np.bincount(w, minlength=len(hashes))
                seen = n > 0
                held_words.append(hashes[seen])
                held_counts.append(n[seen])
                size += int(seen.sum())
                if len(hot[0]):
                    at_hot, two, there = hot_bigrams(hashes, w, v)
                    hot[0] += np.bincount(there, minlength=len(hot[0]))
                    there = places(told_hot.value[1], trigram_keys(hashes, two, u[at_hot]))  # a hot trigram's bigram is hot
                    hot[1] += np.bincount(there[there >= 0], minlength=len(hot[1]))
                if size > 600_000:
                    yield count_rows([merged()])
                    held_words, held_counts, size = [], [], 0
        # two rows that aren't words say how many training documents and tokens there are
        extra = (1, np.array([START, np.uint64(3)]), np.array([rows, tokens]))
        yield count_rows([merged(), extra, *((k + 2, keys, n) for k, (keys, n) in enumerate(zip(told_hot.value[:2], hot, strict=True)))])

    all_counts = written(source.mapInArrow(counted, counts).groupBy("kind", "word").agg(F.sum("n").alias("n")).filter("n > 0"), "unigrams")
    unigrams = all_counts.filter("kind = 1").select("word", "n")
    said = {r["word"]: r["n"] for r in unigrams.filter("word in (2, 3)").collect()}
    train_docs, tokens = said.get(2, 0), said.get(3, 0)
    sums = unigrams.filter("word not in (2, 3)").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n_train, different = sums[0], sums[1]
    z = n_train + 0.5 * (different + 1)
    hot = max(1.0, HOT * n_train)
    listed = unigrams.filter(F.col("n") >= F.lit(max(1.0, min(HOT, LISTED) * n_train))).filter("word not in (2, 3)").toArrow()  # 1 / LISTED rows at most
    keys = listed.column("word").to_numpy().view(np.uint64)
    by_key = np.argsort(keys)
    hot_counts = {(r["kind"], r["word"]): r["n"] for r in all_counts.filter("kind > 1").collect()}  # as many as often_seen at most
    hot_totals = [np.array([hot_counts.get((k + 2, word), 0) for word in keys.view(np.int64).tolist()], np.int64) for k, keys in enumerate(hot_keys)]
    table = spark.sparkContext.broadcast((keys[by_key], listed.column("n").to_numpy()[by_key]))
    gram_totals = spark.sparkContext.broadcast(hot_totals)
    shards = max(1, -(-tokens // shard_tokens))

    def among(hashes: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The values of the hashes by ascending keys, else 0."""
        if not len(keys):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, values[at], 0)

    def lookup(hashes: np.ndarray) -> np.ndarray:
        """c of listed words, else 0."""
        return among(hashes, *table.value)

    def shard_of(hashes: np.ndarray, w: np.ndarray, v: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The shard of each token w after u v; `shards` for a hot trigram, which needs none."""
        own, count = mix(hashes), lookup(hashes)
        key = np.where((count >= hot)[w], mix(own[w] ^ hashes[v]), own[w])
        at, _, home = hot_places(hashes, count, w, v, u)
        key[at] = mix(key[at] ^ own[u[at]])
        key %= np.uint64(shards)
        key[at[home >= 0]] = shards
        return key

    def hot_places(hashes: np.ndarray, count: np.ndarray, w: np.ndarray, v: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The tokens of hot bigrams (of a hot w), where these stand in their table, and where their trigrams do, if all counts are told (else -1)."""
        at, two, place = hot_bigrams(hashes, w, v)
        often = (count >= hot)[w[at]]
        at, two, place = at[often], two[often], place[often]
        home = places(told_hot.value[1], trigram_keys(hashes, two, u[at]))
        told = (count > 0) | (hashes == START)
        # the batch's first token is always dealt, as some blob must bear what is said of the documents
        return at, place, np.where(told[v[at]] & (at > 0), home, -1)

    def home_sums(hashes: np.ndarray, doc: np.ndarray, w: np.ndarray, v: np.ndarray, u: np.ndarray, many: int) -> list[np.ndarray]:
        """Known tokens, base score and score of the documents' hot trigrams, from the tables alone."""
        count = lookup(hashes)
        at, place, home = hot_places(hashes, count, w, v, u)
        at, place, home = at[home >= 0], place[home >= 0], home[home >= 0]
        c1, cv, c2, c3 = count[w[at]], count[v[at]], gram_totals.value[0][place], gram_totals.value[1][home]
        cv = np.where(cv < FREQUENT * n_train, 0, cv)
        p1 = (c1 + 0.5) / z
        p2 = np.where(cv > 0, (c2 + MU2 * p1) / (cv + MU2), p1)
        own = np.log10(c3 + MU3 * p2) - np.where(hashes[w[at]] == END, 0.0, np.log10(c2 + MU3)) - np.where(hashes[v[at]] == START, np.log10(train_docs + MU3), 0.0)
        return [narrow(np.bincount(doc[at], minlength=many)), *(np.bincount(doc[at], x, minlength=many).view(np.uint64) for x in (np.log10(p1), own))]

    def rows_of(numbers: list[int], kind: int, blobs: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array([kind] * len(blobs), pa.int8()), pa.array(blobs, pa.binary())], ["shard", "kind", "blob"])

    @tidied
    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """To the shard of each unlisted context word (kind 1): which shards need its count."""
        for whole in batches:
            for at in range(0, len(whole), BATCH_DOCS):
                hashes, _, w, v, u = batch_tokens(whole.column(1).slice(at, BATCH_DOCS).to_pylist())
                rare = (lookup(hashes) == 0) & (hashes != START)
                key = shard_of(hashes, w, v, u)
                pick = rare[v] & (key < shards)
                pairs = distinct(v[pick].astype(np.int64) * shards + key[pick].astype(np.int64))
                word, needed = pairs // shards, pairs % shards
                home = (mix(hashes[word]) % np.uint64(shards)).astype(np.int64)
                order = np.argsort(home, kind="stable")
                bounds = np.searchsorted(home[order], np.arange(shards + 1))
                for many in itertools.batched(np.flatnonzero(np.diff(bounds)).tolist(), 64):
                    blobs = []
                    for s in many:
                        mine = order[bounds[s] : bounds[s + 1]]
                        words, times = np.unique(word[mine], return_counts=True)
                        blobs.append(pack([planes(hashes[words]), narrow(times), narrow(needed[mine])]))
                    yield rows_of(list(many), 1, blobs)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """To the shard of each unlisted word (kind 0): its count."""
        for b in batches:
            hashes, n = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
            order = np.argsort(hashes)
            order = order[lookup(hashes[order]) == 0]
            home = (mix(hashes[order]) % np.uint64(shards)).astype(np.int64)
            there = np.argsort(home, kind="stable")
            bounds = np.searchsorted(home[there], np.arange(shards + 1))
            for many in itertools.batched(np.flatnonzero(np.diff(bounds)).tolist(), 64):
                picks = [order[there[bounds[s] : bounds[s + 1]]] for s in many]
                yield rows_of(list(many), 0, [pack([planes(hashes[p]), narrow(n[p])]) for p in picks])

    def answered(t: pa.Table) -> pa.Table:
        """To each shard that needs them (kind 1): counts of the words of one shard."""
        kinds = t.column("kind").to_pylist()
        blobs = [unpack(x) for x in t.column("blob").to_pylist()]
        told = [b for b, k in zip(blobs, kinds, strict=True) if k == 0]
        wanted = [b for b, k in zip(blobs, kinds, strict=True) if k == 1]
        keys = np.concatenate([np.zeros(0, np.uint64), *(unplaned(b[0]) for b in told)])
        values = np.concatenate([np.zeros(0, np.int64), *(b[1].astype(np.int64) for b in told)])
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        word = np.concatenate([np.zeros(0, np.uint64), *(np.repeat(unplaned(b[0]), b[1].astype(np.int64)) for b in wanted)])
        needed = np.concatenate([np.zeros(0, np.int64), *(b[2].astype(np.int64) for b in wanted)])
        counts_of = among(word, keys, values)
        live = np.flatnonzero(counts_of > 0)  # a word that training doesn't hold has c(v) = 0
        live = live[np.lexsort((word[live], needed[live]))]
        word, needed, counts_of = word[live], needed[live], counts_of[live]
        new = np.ones(len(word), bool)
        new[1:] = (word[1:] != word[:-1]) | (needed[1:] != needed[:-1])
        word, needed, counts_of = word[new], needed[new], counts_of[new]
        to, begin = np.unique(needed, return_index=True)
        ends = np.append(begin, len(word))[1:]
        packed = [pack([planes(word[i:k]), narrow(counts_of[i:k])]) for i, k in zip(begin.tolist(), ends.tolist(), strict=True)]
        return pa.Table.from_batches([rows_of(to.tolist(), 1, packed)])

    @tidied
    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0
        for whole in batches:
            for at in range(0, len(whole), BATCH_DOCS):
                b = whole.slice(at, BATCH_DOCS)
                ids = b.column(0).to_pylist()
                hashes, doc, w, v, u = batch_tokens(b.column(1).to_pylist())
                key = shard_of(hashes, w, v, u)
                told = lookup(hashes) > 0  # listed words travel as their places in the table, others as hashes
                place = np.searchsorted(table.value[0], hashes)
                order = np.argsort(key.astype(np.int32 if shards > 65534 else np.uint16), kind="stable")
                bounds = np.searchsorted(key[order], np.arange(shards + 1, dtype=np.uint64))
                training = _is_training(ids, held, modulus)
                local = np.zeros(len(hashes), np.int32)
                name = np.array([(part << 32) + serial], np.uint64)
                serial += 1
                # what the result says of the batch's documents: it travels with the batch's first blob
                about = [np.array([i is not None for i in ids], np.uint8), np.array([i or 0 for i in ids], np.int64).view(np.uint64), training.astype(np.uint8), narrow(np.bincount(doc, minlength=len(ids))), *home_sums(hashes, doc, w, v, u, len(ids))]
                out: tuple[list, list] = ([], [])
                for s in np.flatnonzero(np.diff(bounds)).tolist():
                    pick = order[bounds[s] : bounds[s + 1]]
                    there = np.zeros(len(hashes), bool)
                    there[w[pick]] = there[v[pick]] = there[u[pick]] = True
                    words = np.flatnonzero(there)
                    local[words] = np.arange(len(words))
                    names, doc_at = np.unique(doc[pick], return_inverse=True)
                    out[0].append(s)
                    out[1].append(pack([planes(hashes[words[~told[words]]]), narrow(local[w[pick]]), narrow(local[v[pick]]), narrow(local[u[pick]]), narrow(np.diff(doc_at, prepend=0)), narrow(names), training[names].astype(np.uint8), name, narrow(np.diff(place[words[told[words]]], prepend=0)), *about]))
                    about = [a[:0] for a in about]
                    if len(out[0]) >= 64:
                        yield rows_of(out[0], 0, out[1])
                        out = ([], [])
                if out[0]:
                    yield rows_of(out[0], 0, out[1])

    def scored(t: pa.Table) -> pa.Table:
        kinds = t.column("kind").to_pylist()
        blobs = [unpack(x) for x in t.column("blob").to_pylist()]
        del t
        answers = [b for b, k in zip(blobs, kinds, strict=True) if k == 1]
        blobs = [b for b, k in zip(blobs, kinds, strict=True) if k == 0]
        for b in blobs:
            b[0] = np.sort(np.concatenate([unplaned(b[0]), table.value[0][np.cumsum(b[8], dtype=np.int64)]]))
        hashes, code = np.unique(np.concatenate([b[0] for b in blobs]), return_inverse=True)
        code = code.astype(np.int32)
        offsets = np.cumsum([0, *(len(b[0]) for b in blobs)])
        w, v, u = (np.concatenate([code[offsets[i] : offsets[i + 1]][b[k].astype(np.int64)] for i, b in enumerate(blobs)]) for k in (1, 2, 3))
        del code
        for b in blobs:
            b[0] = b[1] = b[2] = b[3] = None
        rows = np.cumsum([0, *(len(b[5]) for b in blobs)])
        doc = np.concatenate([(np.cumsum(b[4], dtype=np.int32) + rows[i]).astype(np.int32) for i, b in enumerate(blobs)])
        training = np.concatenate([b[6] for b in blobs]).astype(bool)
        learned = training[doc]
        n = len(hashes)
        heavy = lookup(hashes)
        c1 = np.where(heavy > 0, heavy, np.bincount(w[learned], minlength=n))
        for b in answers:  # of other shards' words
            heavy[np.searchsorted(hashes, unplaned(b[0]))] = b[1]
        del answers
        heavy[heavy < FREQUENT * n_train] = 0
        w3, v3, u3, back = trigrams(w, v, u, n)
        del u
        c3 = np.bincount(back, learned, minlength=len(w3)).astype(np.int64)
        total = np.full(len(w3), -1)
        at, _, there = hot_bigrams(hashes, w3, v3)
        total[at] = gram_totals.value[0][there]
        seen = (c3 > 0) | (total > 0)
        trie = Trie(w3[seen], v3[seen], u3[seen], c3[seen], n, c1, heavy, z, total[seen])
        above, below = trie.score(w3, v3, u3)
        del trie, w3, v3, u3, c3, seen, total, at, there
        start, end = (np.searchsorted(hashes, x) for x in (START, END))
        is_end = w == end if end < n and hashes[end] == END else np.zeros(len(w), bool)
        first = v == start if start < n and hashes[start] == START else np.zeros(len(w), bool)
        # a token pays for the next one's context; the first pays for that of two starts, too
        own = above[back] - np.where(is_end, 0.0, below[back]) - np.where(first, np.log10(train_docs + MU3), 0.0)
        many = int(rows[-1])
        give_back()
        sums = [np.bincount(doc, c1[w] > 0, minlength=many).astype(np.int64), np.bincount(doc, np.log10((c1[w] + 0.5) / z), minlength=many), np.bincount(doc, own, minlength=many)]
        parts = [pack([b[5], narrow(sums[0][at:to]), sums[1][at:to].view(np.uint64), sums[2][at:to].view(np.uint64), *b[9:]]) for b, at, to in zip(blobs, rows[:-1].tolist(), rows[1:].tolist(), strict=True)]
        return pa.table({"batch": pa.array([int(b[7][0]) for b in blobs], pa.int64()), "part": pa.array(parts, pa.binary())})

    def summed(t: pa.Table) -> pa.Table:
        blobs = [unpack(x) for x in t.column("part").to_pylist()]
        known_id, value, training, lengths, *home = next(b[4:] for b in blobs if len(b[4]))
        total = np.stack([home[0].astype(float), home[1].view(np.float64), home[2].view(np.float64)])
        for b in blobs:
            at = b[0].astype(np.int64)  # a document once a blob
            total[0, at] += b[1]
            total[1, at] += b[2].view(np.float64)
            total[2, at] += b[3].view(np.float64)
        return pa.table(
            {
                "doc_id": pa.array(value.view(np.int64), mask=known_id == 0),
                "held_out": pa.array(training == 0),
                "n_tokens": pa.array(lengths.astype(np.int64)),
                "n_known": pa.array(total[0].astype(np.int64)),
                "train_tokens": pa.array(np.full(len(value), n_train, np.int64)),
                "base_score": pa.array(total[1]),
                "score": pa.array(total[2]),
            }
        )

    row = "shard int, kind byte, blob binary"
    contexts = source.mapInArrow(asked, row).unionByName(unigrams.filter("word not in (2, 3)").mapInArrow(known, row)).groupBy("shard").applyInArrow(answered, row)
    partial = source.mapInArrow(dealt, row).unionByName(contexts).groupBy("shard").applyInArrow(scored, "batch long, part binary")
    return partial.groupBy("batch").applyInArrow(
        summed, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
