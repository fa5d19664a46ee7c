"""Benchmark decontamination: an FM-index per training shard, searched backwards for test phrases.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. A phrase is a window of
WINDOW consecutive words of a benchmark item; an item of fewer words (but some) is one phrase. Every word of
a document inside an occurrence of a phrase is a hit; overlapping occurrences merge into removal spans.

A training shard is a batch of SHARD_DOCS documents at most. Its words become symbols; words that no phrase holds
can't be part of an occurrence, so they and document ends only separate runs, and runs shorter than the
shortest phrase are left out. Over the rest a suffix array is built by prefix doubling, and from it the
Burrows-Wheeler transform as a wavelet matrix with packed bit vectors. All phrases are searched at once,
one backward step per word, by ranks in the wavelet matrix; occurrences are found by walking back to
sampled suffix positions.

Documents are never shuffled. The benchmark is read in blocks of at most about BLOCK_BYTES of text, each
broadcast for one pass over the documents; later passes carry the spans and items found so far.

Nulls: a null document text has no words; null or wordless items have no phrases; a null item_id counts
as an empty string. Repeated rows are searched one by one; items with one id count once. Empty tables give
no rows, or rows without hits. Very long texts are handled whole. Further columns are ignored by
`search` and kept by `strip`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from turnloom.llm.common import columns as own_columns
from turnloom.llm.common import mapped, schema_of, sliced, tidied, written

WINDOW = 10
BLOCK_BYTES = 8_000_000
#: Every so many text positions the suffix array keeps one.
SAMPLE = 8
#: Documents of a shard at most.
SHARD_DOCS = 2500

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # before lower-casing


def item_words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_WORDS).split()


class Phrases:
    """Distinct phrases of benchmark items: words as symbols from 1, right-aligned in a matrix."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        number: dict[bytes, int] = {}
        names: dict[str, int] = {}
        symbols, lengths, item = [], [], []
        for item_id, text in items:
            words = item_words(text)
            symbols.append(np.fromiter((number.setdefault(w, len(number) + 1) for w in words), np.int32, len(words)))
            lengths.append(len(words))
            item.append(names.setdefault("" if item_id is None else str(item_id), len(names)))
        flat = np.concatenate([np.zeros(window, np.int32), *symbols])  # so many zeros in front that each place ends a row
        lengths, item = np.array(lengths, np.int64), np.array(item, np.int64)
        many = np.where(lengths > 0, np.maximum(lengths - window + 1, 1), 0)
        owner = np.repeat(np.arange(len(items)), many)
        end = window + np.cumsum(lengths) - lengths + np.minimum(lengths, window)  # behind each item's first phrase
        end = end[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        rows = flat[end[:, None] + np.arange(-window, 0)]
        size = np.minimum(lengths[owner], window)
        rows[np.arange(window) < (window - size)[:, None]] = 0  # what stands before a short item
        self.matrix, row = np.unique(rows.reshape(-1, window), axis=0, return_inverse=True)
        self.lengths = (self.matrix > 0).sum(axis=1)
        self.shortest = int(self.lengths.min(initial=window)) if len(self.matrix) else 0
        self.vocabulary, self.names = number, list(names)
        # the items of each phrase, one behind the other
        pairs = np.unique(row.reshape(-1) * max(1, len(names)) + item[owner])
        self.first = np.searchsorted(pairs // max(1, len(names)), np.arange(len(self.matrix) + 1))
        self.item = (pairs % max(1, len(names))).astype(np.int32)

    def owners(self, phrase: int) -> list[str]:
        """The items that hold a phrase."""
        return [self.names[i] for i in self.item[self.first[phrase] : self.first[phrase + 1]].tolist()]


class Bits:
    """A bit vector in 64-bit words, with the ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones in front of position i."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    """Symbols of a sequence by bit, most significant first; ones go behind the zeros at each level."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            ones = (symbols >> shift & 1).astype(bool)
            self.levels.append((shift, Bits(ones), int(len(ones) - ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
        self.start = np.zeros(sigma, np.int64)
        self.start = self.follow(np.arange(sigma), np.zeros(sigma, np.int64))

    def follow(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position i goes if it takes the symbol's branch at each level."""
        for shift, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where(symbol >> shift & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of the symbol in front of position i."""
        return self.follow(symbol, i) - self.start[symbol]

    def read(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i, and its occurrences in front of i."""
        symbol = np.zeros(len(i), np.int64)
        for shift, bits, zeros in self.levels:
            one, ones = bits.get(i), bits.rank(i)
            symbol |= one.astype(np.int64) << shift
            i = np.where(one, zeros + ones, i - ones)
        return symbol, i - self.start[symbol]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of text in order; zeros are separators, each distinct, the earlier the smaller."""
    apart = text == 0
    rank = np.where(apart, np.cumsum(apart) - 1, text + int(apart.sum()))
    step, n = 1, len(text)
    while True:
        behind = np.zeros(n, np.int64)
        behind[: n - step] = rank[step:] + 1
        key = rank * (int(behind.max(initial=0)) + 1) + behind
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]])) if n else 0
        step *= 2
        if not n or rank[order[-1]] == n - 1 or step >= n:
            return order


class FMIndex:
    """Counts and places of patterns in a text of symbols from 1; 0 separates runs and ends the text."""

    def __init__(self, text: np.ndarray, sigma: int):
        order = suffix_array(text)
        before = np.where(order > 0, text[order - 1], 0)
        self.tree = WaveletMatrix(before, sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        # a run's first position is sampled too: no walk needs to cross a separator
        kept = (order % SAMPLE == 0) | (before == 0)
        self.kept, self.places = Bits(kept), order[kept]

    def search(self, matrix: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges [low, high) of suffixes that start with each right-aligned pattern."""
        low, high = self.first[matrix[:, -1]], self.first[matrix[:, -1] + 1]
        for back in range(2, matrix.shape[1] + 1):
            live = np.flatnonzero((lengths >= back) & (high > low))
            symbol = matrix[live, -back]
            low[live] = self.first[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.tree.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes."""
        place, steps, live = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        while len(live):
            known = self.kept.get(rows)
            place[live[known]] = self.places[self.kept.rank(rows[known])] + steps
            live, rows = live[~known], rows[~known]
            symbol, seen = self.tree.read(rows)
            rows, steps = self.first[symbol] + seen, steps + 1
        return place


def hits(texts: list[str | None], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """Of each text: where its words start in the concatenation (one more at the end); whether each word is hit; item ids."""
    symbols, lengths = [], np.zeros(len(texts) + 1, np.int64)
    known = phrases.vocabulary.get
    for i, text in enumerate(texts):
        words = item_words(text)
        lengths[i + 1] = len(words)
        symbols.append(np.fromiter((known(w, 0) for w in words), np.int32, len(words)))
    starts = np.cumsum(lengths)
    word = np.concatenate([*symbols, np.zeros(0, np.int32)])
    hit, items = np.zeros(len(word), bool), [set() for _ in texts]
    if not len(phrases.matrix) or not len(word):
        return starts, hit, items
    # runs of phrase words within a document, as long as the shortest phrase at least
    edge = np.zeros(len(word) + 1, bool)
    edge[starts] = True
    inside = word > 0
    begins = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    long_enough = ends - begins >= phrases.shortest
    begins, ends = begins[long_enough], ends[long_enough]
    if not len(begins):
        return starts, hit, items
    size = ends - begins + 1  # with a separator behind each
    at = np.arange(int(size.sum())) + np.repeat(begins - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    last = np.cumsum(size) - 1
    text = word[np.minimum(at, len(word) - 1)].astype(np.int64)
    text[last] = 0
    index = FMIndex(text, len(phrases.vocabulary) + 1)
    low, high = index.search(phrases.matrix, phrases.lengths)
    count = np.maximum(high - low, 0)
    phrase = np.repeat(np.arange(len(count)), count)
    rows = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    place = at[index.locate(rows)]
    change = np.zeros(len(word) + 1, np.int64)
    np.add.at(change, place, 1)
    np.add.at(change, place + phrases.lengths[phrase], -1)
    hit = np.cumsum(change)[:-1] > 0
    doc = np.searchsorted(starts, place, "right") - 1
    for pair in np.unique(doc * len(count) + phrase).tolist():
        items[pair // len(count)].update(phrases.owners(pair % len(count)))
    return starts, hit, items


def spans_of(hit: np.ndarray) -> list[tuple[int, int]]:
    """Maximal ranges [start, end) of hit words."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _n_blocks(benchmark: DataFrame, text: str, block_bytes: int) -> int:
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    return max(1, -(-total // block_bytes))


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    """The items in blocks of about block_bytes."""
    blocks = _n_blocks(benchmark, text, block_bytes)
    picked = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t"))
    for b in range(blocks):
        part = picked.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b) if blocks > 1 else picked
        yield [(r["i"], r["t"]) for r in part.collect()]  # a block: about block_bytes


def search(
    docs: DataFrame,
    benchmark: DataFrame,
    columns: tuple[str, ...] = ("doc_id",),
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    text: str = "text",
    item: str = "item_id",
) -> DataFrame:
    """The columns, then n_words, n_hit, n_items, items_sha256, contaminated and spans (of hit words, [start, end))."""
    found = docs.select(*columns, F.col(text).alias("_text"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("_spans"), F.array().cast("array<string>").alias("_items"))
    for k, block in enumerate(_blocks(benchmark, item, "text", block_bytes)):
        if k:
            found = written(found, "decontaminate")
        shared = docs.sparkSession.sparkContext.broadcast(Phrases(block, window))

        @tidied
        def searched(batches: Iterator[pa.RecordBatch], shared=shared, first=len(columns)) -> Iterator[pa.RecordBatch]:
            for b in sliced(batches, SHARD_DOCS):
                starts, hit, items = hits(b.column(first).to_pylist(), shared.value)
                n_words, spans, ids = np.diff(starts).tolist(), [], []
                for i, (old, seen) in enumerate(zip(b.column(first + 1).to_pylist(), b.column(first + 2).to_pylist(), strict=True)):
                    own = hit[starts[i] : starts[i + 1]]
                    for s in old:
                        own[s["start"] : s["end"]] = True
                    spans.append([{"start": s, "end": e} for s, e in spans_of(own)] if items[i] or old else [])
                    ids.append(sorted(items[i].union(seen)))
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:first], b.column(first), pa.array(spans, b.schema.field(first + 1).type), pa.array(ids, pa.list_(pa.string())), pa.array(n_words, pa.int64())],
                    [*columns, "_text", "_spans", "_items", "_words"],
                )

        found = found.drop("_words").mapInArrow(searched, schema_of(docs, columns, "_text string, _spans array<struct<start:bigint,end:bigint>>, _items array<string>, _words bigint"))
    return found.select(
        *columns,
        F.col("_words").alias("n_words"),
        F.aggregate("_spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"]).alias("n_hit"),
        F.size("_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("_items") > 0).alias("contaminated"),
        F.col("_spans").alias("spans"),
    )


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """text without its words in the spans and what stands between them; a space holds the place."""
    words = [m.span() for m in _WORD.finditer(text)]
    out, upto = [], 0
    for s, e in spans:
        out.append(text[upto : words[s][0]])
        upto = words[e - 1][1]
    return " ".join([*out, text[upto:]])


def strip_texts(texts: list[str | None], phrases: Phrases) -> list[str | None]:
    """Texts without any occurrence of a phrase: also none that a cut brings together."""
    out, todo = list(texts), list(range(len(texts)))
    while todo:
        starts, hit, items = hits([out[i] for i in todo], phrases)
        found = [k for k in range(len(todo)) if items[k]]
        for k in found:
            out[todo[k]] = cut(out[todo[k]], spans_of(hit[starts[k] : starts[k + 1]]))
        todo = [todo[k] for k in found]
    return out


def _strip_by_blocks(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int, text: str) -> DataFrame:
    """What strip_texts does, with the phrases in several blocks: spans of all blocks are cut at once, and what was cut is searched again."""
    at, schema = docs.columns.index(text), docs.schema
    left, done = docs, []

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, spans = b.column(0), b.column(1).to_pylist()
            columns = list(own.flatten())
            texts = [cut(t, [(s["start"], s["end"]) for s in found]) if found else t for t, found in zip(columns[at].to_pylist(), spans, strict=True)]
            columns[at] = pa.array(texts, columns[at].type)
            row = pa.StructArray.from_arrays(columns, fields=list(own.type))
            yield pa.RecordBatch.from_arrays([row, pa.array([bool(found) for found in spans], pa.bool_())], ["_own", "_cut"])

    rows = StructType([StructField("_own", schema), StructField("_cut", BooleanType())])
    while True:
        found = search(left.select(F.struct(*own_columns(left.columns)).alias("_own"), F.col(text).alias("_whole")), benchmark, ("_own",), window, block_bytes, "_whole")
        table = written(found.select("_own", "spans").mapInArrow(cut_out, rows), "decontaminate")
        done.append(table.filter("not _cut").select("_own.*"))
        left = table.filter("_cut").select("_own.*")
        if left.isEmpty():
            return reduce(DataFrame.unionAll, done)


def strip(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, text: str = "text", chars: str = "n_chars") -> DataFrame:
    """docs with removal spans cut out of the text; the column of its length, if there, follows."""
    at, kinds, schema = docs.columns.index(text), dict(docs.dtypes), docs.schema
    if _n_blocks(benchmark, "text", block_bytes) == 1:
        (block,) = _blocks(benchmark, "item_id", "text", block_bytes)
        shared = docs.sparkSession.sparkContext.broadcast(Phrases(block, window))

        @tidied
        def stripped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in sliced(batches, SHARD_DOCS):
                columns = list(b.columns)
                columns[at] = pa.array(strip_texts(b.column(at).to_pylist(), shared.value), b.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

        docs = mapped(docs, stripped, schema)
    else:
        docs = _strip_by_blocks(docs, benchmark, window, block_bytes, text)
    return docs.withColumn(chars, F.length(text).cast(kinds[chars])) if chars in kinds else docs


def digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
