"""SentencePiece encoding and decoding by weighted finite-state transducers.

A public model file is compiled into transducers (`Transducer`): arcs by state and symbol read, each with what it writes, a weight
and the next state. The normaliser writes a space as U+2581 and, from its start state, one in front of the text. The piece
machine reads characters and writes piece ids; its arcs weigh the negated score, and byte fallback is an arc that reads any
character and writes the ids of its UTF-8 bytes, at BYTE_WEIGHT times the heaviest piece each. `compose` joins the two once per model. A byte-pair model isn't a
bag of scores: of all ways through the lattice only the one that its merges lead to is right, and a sequence of pieces is
that one exactly if each pair of neighbours is what merging the two alone would give. So a third machine, whose
state is the last piece, has an arc of weight 0 for just such neighbours and of infinite weight for others; its arcs are made when
first met. Each input is composed with the three on the fly, and the shortest path in the tropical semiring (min, +), found best
first, is the encoding: the same ids as the model's own library. Weights choose it: of a character's piece and its bytes, and of any
two ways that the neighbour machine leaves.

Between two characters that stand side by side in no piece, no arc of the piece machine leads on, and no merge joins
them, so a text falls into segments there; the shortest path is found by segment, and a task keeps those of recent segments in
a bounded table.

Decoding writes the pieces' bytes one behind the other, U+2581 as a space, and drops the space put in front.

Model files are read on the driver from a path given by the caller, checked for what the machines cover (byte
pairs, identity normalisation, byte fallback) and broadcast; they hold a fixed vocabulary.

Nulls: a null text has no ids (null), decodes to null. An empty text has none, too, but an empty list. Lone surrogates
can't occur in a table's strings. Text with U+2581 itself decodes to spaces, as in the library. Repeated rows are
encoded one by one; empty tables give no rows; further columns stay, but for those named like a result (ids, n_ids, decodes; of
`decode`, the text), which give way to it.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import KEPT, columns, mapped, schema_of, tidied

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NORMAL, BYTE = 1, 6
TABLE_SEGMENTS, TABLE_CHARS, TABLE_PAIRS = 300_000, 48, 1_000_000
#: What a byte costs, in weights of the heaviest piece: more than any ten thousand pieces, so bytes stand only where no pieces lead on.
BYTE_WEIGHT = 1e4
#: Labels: nothing is read or written; any symbol; a symbol that no other arc of the state reads. An arc on the last two writes BYTES or the symbol itself (OTHER).
EPSILON, ANY, OTHER, BYTES = "", "<any>", "<other>", "<bytes>"
INFINITE = float("inf")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes | float]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        elif key & 7 == 2:
            size = number()
            yield key >> 3, data[at : at + size]
            at += size
        else:
            size = 4 if key & 7 == 5 else 8
            yield key >> 3, struct.unpack("<f" if size == 4 else "<d", data[at : at + size])[0]
            at += size


class Transducer:
    """arcs[state][symbol read]: (what is written, weight, next state) of each arc. State 0 is the start."""

    def __init__(self):
        self.arcs: list[dict[str, tuple[tuple, ...]]] = [{}]

    def state(self) -> int:
        self.arcs.append({})
        return len(self.arcs) - 1

    def arc(self, state: int, reads: str, writes, weight: float, to: int) -> None:
        own = self.arcs[state]
        own[reads] = (*own.get(reads, ()), (writes, weight, to))


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that reads what the first reads and writes what the second makes of what the first writes."""
    out = Transducer()
    number = {(0, 0): 0}
    todo = [(0, 0)]

    def to(pair: tuple[int, int]) -> int:
        if pair not in number:
            number[pair] = out.state()
            todo.append(pair)
        return number[pair]

    special = (EPSILON, ANY, OTHER)
    for p, q in todo:  # grows as states are found
        here, there = first.arcs[p], second.arcs[q]
        at = number[p, q]
        for writes, weight, q2 in there.get(EPSILON, ()):
            out.arc(at, EPSILON, writes, weight, to((p, q2)))
        for reads, arcs in here.items():
            for middle, weight, p2 in arcs:
                if middle == EPSILON:
                    out.arc(at, reads, EPSILON, weight, to((p2, q)))
                    continue
                # the symbols that may stand in the middle, and what is read for each
                symbols = [y for y in there if y not in special and y not in here] if middle == OTHER else [middle]
                for y in symbols:
                    for writes, more, q2 in (*there.get(y, ()), *there.get(ANY, ())):
                        out.arc(at, y if middle == OTHER else reads, (BYTES, y) if writes == BYTES else writes, weight + more, to((p2, q2)))
                if middle == OTHER:
                    for writes, more, q2 in there.get(ANY, ()):
                        out.arc(at, OTHER, writes, weight + more, to((p2, q2)))
    return out


class Machine:
    """The transducers of a model."""

    def __init__(self, data: bytes):
        pieces, normaliser, trainer = [], {}, {}
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                pieces.append((piece.get(1, b"").decode(), piece.get(2, 0.0), piece.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normaliser = dict(_fields(value))
        kinds = {p[2] for p in pieces}
        if trainer.get(3) != 2 or normaliser.get(2) or not normaliser.get(3, 1) or normaliser.get(4, 1) or BYTE not in kinds or 4 in kinds:
            raise ValueError("only byte-pair models with identity normalisation, a dummy prefix and byte fallback are covered")
        self.text = [p[0] for p in pieces]
        self.weight = [-p[1] for p in pieces]
        self.arcs = {p[0]: i for i, p in enumerate(pieces) if p[2] == NORMAL}
        self.bytes = [0] * 256
        for i, p in enumerate(pieces):
            if p[2] == BYTE:
                self.bytes[int(p[0][1:-1], 16)] = i
        self.compile()
        # the characters of longer pieces, numbered, and which pairs of them stand side by side in some piece
        pairs = {(p[i], p[i + 1]) for p in self.arcs for i in range(len(p) - 1)}
        self.classes = np.zeros(0x110000, np.int16)
        self.classes[[ord(c) for c in sorted({c for pair in pairs for c in pair})]] = np.arange(1, len({c for pair in pairs for c in pair}) + 1)
        self.classes[ord(" ")] = self.classes[ord(SPACE)]
        self.joins = np.zeros((int(self.classes.max()) + 1,) * 2, bool)
        for c, d in pairs:
            self.joins[self.classes[ord(c)], self.classes[ord(d)]] = True
        self.out = [b"" if p[2] not in (NORMAL, BYTE) else bytes([int(p[0][1:-1], 16)]) if p[2] == BYTE else p[0].replace(SPACE, " ").encode() for p in pieces]
        self.pairs: dict[int, float] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def compile(self) -> None:
        """The normaliser composed with the piece machine: where symbols lead, and what ends in each state."""
        normaliser, pieces = Transducer(), Transducer()
        within = normaliser.state()
        normaliser.arc(0, EPSILON, SPACE, 0.0, within)
        normaliser.arc(within, " ", SPACE, 0.0, within)
        normaliser.arc(within, OTHER, OTHER, 0.0, within)
        pieces.arc(0, ANY, BYTES, BYTE_WEIGHT * max(self.weight), 0)
        for text, i in self.arcs.items():
            node = 0
            for c in text:
                if c not in pieces.arcs[node]:
                    pieces.arc(node, c, EPSILON, 0.0, pieces.state())
                node = pieces.arcs[node][c][0][2]
            pieces.arc(node, EPSILON, i, self.weight[i], 0)
        machine = compose(normaliser, pieces).arcs
        (self.start,) = (to for writes, _, to in machine[0][EPSILON] if writes == EPSILON)  # the symbol in front of the text is behind it
        # states of between two pieces are one; its arcs but for bytes, and all others, are told apart by what they write
        (root,) = {to for arcs in machine for writes, _, to in arcs.get(EPSILON, ()) if isinstance(writes, int)}
        self.root = root
        self.steps = [{c: to for c, many in arcs.items() if c != EPSILON for writes, _, to in many if writes == EPSILON} for arcs in machine]
        self.ends = [tuple((writes, weight) for writes, weight, to in arcs.get(EPSILON, ()) if to == root) for arcs in machine]
        self.fallback = {c: (writes, weight) for c, many in machine[root].items() for writes, weight, to in many if to == root}

    def merged(self, text: str) -> list[int | str]:
        """What merging gives for a short text: the best-scored neighbours first, of equal ones the leftmost."""
        parts = list(text)
        arcs, weight = self.arcs, self.weight
        while len(parts) > 1:
            best = min(((weight[k], i) for i in range(len(parts) - 1) if (k := arcs.get(parts[i] + parts[i + 1])) is not None), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [arcs.get(p, p) for p in parts]

    def accepts(self, before: int, piece: int) -> bool:
        """Whether the neighbour machine has a finite arc from state `before` (-1: none) for the piece."""
        if before < 0:
            return self.merged(self.text[piece]) == [piece]
        arcs, weight, border = self.arcs, self.weight, len(self.text[before])
        parts = list(self.text[before] + self.text[piece])
        while len(parts) > 2:
            best = min(((weight[k], i) for i in range(len(parts) - 1) if (k := arcs.get(parts[i] + parts[i + 1])) is not None), default=None)
            if best is None or sum(map(len, parts[: best[1] + 1])) == border:  # a merge across the border
                return False
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts[0] + parts[1] not in arcs

    def neighbour(self, before: int, piece: int) -> float:
        """The weight of the neighbour machine's arc from state `before` that reads the piece."""
        key = (before + 1) * len(self.text) + piece
        weight = self.pairs.get(key)
        if weight is None:
            if len(self.pairs) >= TABLE_PAIRS:
                self.pairs.clear()
            weight = self.pairs[key] = 0.0 if self.accepts(before, piece) else INFINITE
        return weight

    def shortest(self, text: str, first: bool = False) -> tuple[int, ...]:
        """Ids along the shortest path of a segment's lattice; of a text's first segment, from the start state.

        Best first: what costs bytes is looked at only when no pieces lead on. A state of the lattice is a place between two arcs of the
        composed machine, and the neighbour machine's state (-1 after bytes).
        """
        n, steps, ends, fallback, pairs, size = len(text), self.steps, self.ends, self.fallback, self.pairs, len(self.text)
        reached: dict[tuple[int, int], tuple] = {}
        queue: list[tuple] = [(0.0, -1 if first else 0, -1, None, None)]  # place -1: in front of the symbol that the start writes
        while queue:
            cost, place, before, source, written = heappop(queue)
            key = place, before
            if key in reached:
                continue
            reached[key] = source, written
            if place == n:
                break
            if place < 0:
                at, state, symbol = 0, self.start, SPACE
            else:
                at, state, symbol = place + 1, steps[self.root].get(text[place]), text[place]
            # byte fallback of the next symbol
            told, weight = fallback.get(symbol) or fallback[OTHER]
            symbol = told[1] if told != BYTES else symbol
            heappush(queue, (cost + weight * len(symbol.encode()), at, -1, key, symbol))
            # pieces: along the composed machine, each end an arc of the neighbour machine
            row = (before + 1) * size
            while state is not None:
                for piece, weight in ends[state]:
                    more = pairs.get(row + piece)
                    if more is None:
                        more = self.neighbour(before, piece)
                    if more < INFINITE:
                        heappush(queue, (cost + weight + more, at, piece, key, piece))
                if at == n:
                    break
                state = steps[state].get(text[at])
                at += 1
        out: list[int] = []
        while key is not None:
            key, written = reached[key]
            if written is not None:
                out += [self.bytes[b] for b in reversed(written.encode())] if isinstance(written, str) else [written]
        return tuple(reversed(out))

    def segments(self, text: str) -> list[str]:
        """The text in segments that no arc of the piece machine leaves."""
        kind = self.classes[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        cuts = [0, *(np.flatnonzero(~self.joins[kind[:-1], kind[1:]]) + 1).tolist(), len(text)]
        return [text[a:b] for a, b in pairwise(cuts)]

    def encode(self, text: str) -> array:
        """Ids of a text."""
        out = array("i")
        if not text:
            return out
        segments = self.segments(text)
        opening = segments[0]
        segments[0] = first = " " + opening  # its name in the table: what the start state writes is what a space is read as
        known = self.known
        missing = set(segments).difference(known)
        if missing:
            if len(known) >= TABLE_SEGMENTS:
                self.older = dict(known)  # segments still in use are taken back from there
                known.clear()
                missing = set(segments)
            older = self.older
            for s in missing:
                known[s] = older.get(s) or array("i", self.shortest(opening, True) if s == first else self.shortest(s)).tobytes()
        out.frombytes(b"".join(map(known.__getitem__, segments)))
        for s in missing:
            if len(s) > TABLE_CHARS:
                del known[s]
        return out

    def decode(self, ids) -> str:
        text = b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


#: The last model's machine and tables, which a worker keeps until it works for another operator.
_BUILT: dict[bytes, Machine] = {}
KEPT["pieces"] = _BUILT


def built(data: bytes) -> Machine:
    if data not in _BUILT:
        _BUILT.clear()
        _BUILT[data] = Machine(data)
    return _BUILT[data]


def machine(path: str = MODEL) -> Machine:
    with open(path, "rb") as f:
        return Machine(f.read())


def encode(docs: DataFrame, model: str = MODEL, text: str = "text") -> DataFrame:
    """docs with ids (array of int), n_ids and decodes (whether decoding gives the text again); text is dropped."""
    others = [c for c in docs.columns if c not in (text, "ids", "n_ids", "decodes")]
    with open(model, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = built(shared.value)
        for whole in batches:
            for at in range(0, len(whole), 500):
                b = whole.slice(at, 500)
                flat, ends, good, nulls = array("i"), [0], [], []
                for t in b.column(len(others)).to_pylist():
                    ids = array("i") if t is None else m.encode(t)
                    flat.extend(ids)
                    ends.append(len(flat))
                    nulls.append(t is None)
                    good.append(None if t is None else m.decode(ids) == t.replace(SPACE, " "))
                lists = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32)), mask=pa.array(nulls))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists, pa.array(np.diff(ends), pa.int64()), pa.array(good, pa.bool_())], [*others, "ids", "n_ids", "decodes"])

    return mapped(docs.select(*columns(others), F.col(text).alias("_t")), tidied(encoded, "pieces"), schema_of(docs, others, "ids array<int>, n_ids bigint, decodes boolean"))


def decode(rows: DataFrame, model: str = MODEL, ids: str = "ids", text: str = "text") -> DataFrame:
    """rows with the ids column turned into text."""
    others = [c for c in rows.columns if c not in (ids, text)]
    with open(model, "rb") as f:
        shared = rows.sparkSession.sparkContext.broadcast(f.read())

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = built(shared.value)
        for b in batches:
            texts = [None if x is None else m.decode(x) for x in b.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*others, text])

    return mapped(rows.select(*columns(others), F.col(ids).alias("_i")), tidied(decoded, "pieces"), schema_of(rows, others, f"`{text}` string"))
