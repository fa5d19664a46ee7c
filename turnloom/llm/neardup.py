"""Near-duplicate grouping: SuperMinHash signatures, banding, verification and union-find.

A document's set holds its distinct word shingles (SHINGLE words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; with
fewer words the whole sequence), hashed to 64 bits. Two documents are linked if
100 * intersection >= PERCENT * union.

1. Documents of one set are one class, known by a 128-bit hash of the sorted set; its smallest doc_id speaks
   for it. Copies are never paired.
2. SuperMinHash: in round j every element draws a value in [j, j + 1) for the slot at place j of its own random
   permutation, so the slots of one element hold a sorted, correlated set of values; a document stops when no
   slot can change any more, after two or three rounds for most.
3. Bands of ROWS slots. Every band value leads to the smallest class that has it: one candidate edge a
   class and band, never all pairs of a bucket. With 25 bands of 5 a pair at 0.85 shares none with
   probability 4e-7.
4. Connected components of the candidate edges, by large-star and small-star rounds over a written table.
5. Verification on full sets within each candidate component (`link_sets`): of a set's shingles, the rarest of the
   component first, so many are its head that two linked sets share one of their heads. Members of different groups are compared
   if they do, so a line that many texts have pairs none of them. No link between candidates is lost, and memory grows with the sets.
   A component of more than `large` members, or of sets of more than LARGE_BYTES, first has its links to one hub verified by a
   join, spread over tasks by member; what the hub rules out or settles leaves the component. That goes on with other hubs as long as a
   round takes three tenths of what was left. Step 5 then does what is still over the limits by band value instead of by component: a
   set comes once for each band that it shares, and a chain of many bands isn't one task.

Nulls: a null or wordless text has an empty set and links with nothing. A null doc_id links with nothing
(component_id null, kept true). Repeated rows of a doc_id are one node. Empty tables give no rows. Very long
texts are shingled whole. Further columns are ignored by `components` and kept by `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import BROADCAST_BYTES, blank_words, broadcast_if_small, columns, discard, distinct, mix, tidied, written

SHINGLE = 3
PERCENT = 85
BANDS = 25
ROWS = 5
SEED = np.uint64(0x5EED)
#: Members from which a candidate component is first thinned by its hub.
LARGE, LARGE_BYTES = 1_000, 16_000_000
#: Shingles that are compared at once.
COMPARED = 2_000_000


# ---- sets and signatures --------------------------------------------------------------------------------------


def shingle_set(words: list[bytes], size: int = SHINGLE, known: dict[bytes, int] | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    known = {} if known is None else known
    h = np.empty(len(words), np.uint64)
    get, digest = known.get, xxhash.xxh3_64_intdigest
    h[:] = [x if (x := get(w)) is not None else known.setdefault(w, digest(w)) for w in words]
    n = max(1, len(words) - size + 1)
    out = np.full(n, min(size, len(words)), np.uint64)
    for k in range(min(size, len(words))):
        out = mix(out ^ h[k : k + n])
    return distinct(out)


def signatures(sets: list[np.ndarray], slots: int = BANDS * ROWS) -> np.ndarray:
    """SuperMinHash values (float64), one row a set; an empty set has infinities."""
    out = np.full(len(sets) * slots, np.inf)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    at = 0
    while at < len(sets):  # so many sets at a time that their permutations take a few MB
        upto = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), 60_000, "right")) + at)
        _fill(out, np.concatenate(sets[at:upto]), np.repeat(np.arange(at, upto), sizes[at:upto]), slots)
        at = upto
    return out.reshape(len(sets), slots)


def _fill(out: np.ndarray, elements: np.ndarray, owner: np.ndarray, slots: int) -> None:
    if len(elements) > 400_000:  # one very large set: in parts, as minima can be taken in any order
        for k in range(0, len(elements), 200_000):
            _fill(out, elements[k : k + 200_000], owner[k : k + 200_000], slots)
        return
    order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(elements), 1))
    for j in range(slots):
        if not len(elements):
            return
        draw = mix(elements ^ mix(SEED + np.arange(j, j + 1, dtype=np.uint64)))
        value = j + (draw >> np.uint64(32)).astype(np.float64) / 2.0**32
        swap = j + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
        row = np.arange(len(elements))
        slot = order[row, swap]
        order[row, swap] = order[:, j]
        np.minimum.at(out, owner * slots + slot, value)
        # a set is done when all its slots hold values below j + 1
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        own = owner[first]
        open_ = out.reshape(-1, slots)[own].max(axis=1) >= j + 1
        stay = np.repeat(open_, np.diff(np.concatenate([first, [len(owner)]])))
        if not stay.all():
            elements, owner, order = elements[stay], owner[stay], order[stay]


def band_values(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit value for each set and band; bands differ in their values."""
    bits = sig.view(np.uint64).reshape(len(sig), -1, rows)
    out = np.tile(np.arange(bits.shape[1], dtype=np.uint64), (len(sig), 1))
    for k in range(rows):
        out = mix(out ^ bits[:, :, k])
    return out


# ---- links within one candidate component -----------------------------------------------------------------------


def link_sets(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """A label for each set: the smallest index that links lead to. Exact."""
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    if n == 2:  # most components
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([0, 0 if 100 * both >= percent * (sizes.sum() - both) else 1])
    # the largest set first, and of every set the shingles, the rarest first
    order = np.argsort(-sizes, kind="stable")
    sets, sizes = [sets[i] for i in order.tolist()], sizes[order]
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    count = np.bincount(code)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    owner = np.repeat(np.arange(n), sizes)
    rank = rank[code]
    del code
    rank += owner * len(count)
    rank.sort()
    rank -= owner * len(count)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(rank)) - starts[owner]
    # The first common shingle of two linked sets, at place p of x and q of a later y, leaves at least
    # percent * (|x| + |y|) / (100 + percent) shingles from there on in both. So y needs to be found only by its first
    # shingles that leave this much with a set of its own size, and x asks only for those y that its place p still allows.
    room = (100 + percent) * (sizes[owner] - place) - percent * sizes[owner]
    filed = np.flatnonzero(room >= percent * sizes[owner])
    filed = filed[np.lexsort((owner[filed], rank[filed]))]
    holders, slack = owner[filed], room[filed]
    key = rank[filed] * n + holders
    bucket = np.searchsorted(rank[filed], np.arange(len(count) + 1))
    asks = np.flatnonzero(100 * (sizes[owner] - place) >= percent * sizes[owner])
    asker, room = owner[asks], room[asks]
    del owner, place, filed
    least = np.searchsorted(-100 * sizes, -percent * sizes, "right")[asker]  # sets from here on are too small for x
    most = np.maximum(np.searchsorted(-percent * sizes, -room, "left"), asker + 1)  # sets before this are too large for place p
    low, high = (np.searchsorted(key, rank[asks] * n + np.minimum(k, n)) for k in (np.minimum(most, least), least))
    asks, asker, low, high = (k[high > low] for k in (asks, asker, low, high))
    ask_starts = np.searchsorted(asker, np.arange(n + 1))
    others: dict[int, tuple[int, np.ndarray]] = {}  # of a long bucket: a group, and the entries that weren't in it
    mark, seen = np.zeros(len(count), bool), np.zeros(n, bool)
    root = np.arange(n)
    groups = {i: [i] for i in range(n)}
    for x in np.flatnonzero(np.diff(ask_starts)).tolist():
        any_found = False
        for k in range(ask_starts[x], ask_starts[x + 1]):
            at, to = low[k], high[k]
            if to - at > 64:
                r = int(rank[asks[k]])
                if r not in others or others[r][0] != root[x]:
                    whole = np.arange(bucket[r], bucket[r + 1])
                    others[r] = root[x], whole[root[holders[whole]] != root[x]]
                own = others[r][1]
                own = own[np.searchsorted(own, at) : np.searchsorted(own, to)]
            else:
                own = slice(at, to)
            later = holders[own]
            later = later[(slack[own] >= percent * sizes[x]) & (root[later] != root[x])]
            if len(later):
                seen[later] = any_found = True
        if not any_found:
            continue
        able = np.flatnonzero(seen)
        seen[able] = False
        mark[rank[starts[x] : starts[x] + sizes[x]]] = True
        many = 16
        while len(able):  # a few at first, as the rest is mostly of their groups
            part = able[: max(1, int(np.searchsorted(np.cumsum(sizes[able[:many]]), COMPARED, "right")))]
            able, many = able[len(part) :], 2 * many
            ends = np.cumsum(sizes[part])
            both = np.add.reduceat(mark[rank[np.arange(ends[-1]) + np.repeat(starts[part] - ends + sizes[part], sizes[part])]], ends - sizes[part], dtype=np.int64)
            for r in {root[x], *root[part[100 * both >= percent * (sizes[part] + sizes[x] - both)]].tolist()} - {root[x]}:
                keep, gone = (r, root[x]) if len(groups[r]) > len(groups[root[x]]) else (root[x], r)
                root[groups[gone]] = keep
                groups[keep] += groups.pop(gone)
            able = able[root[able] != root[x]]
        mark[rank[starts[x] : starts[x] + sizes[x]]] = False
        if len(groups) == 1:
            break
    low = np.full(n, n)
    np.minimum.at(low, root, order)
    out = np.empty(n, np.int64)
    out[order] = low[root]
    return out


# ---- the distributed operator ------------------------------------------------------------------------------------


def _described(docs: DataFrame, id_column: str, text: str, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, set_key, bands of every row."""

    @tidied
    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for whole in batches:
            for at in range(0, len(whole), 512):
                b = whole.slice(at, 512)
                if len(known) > 300_000:
                    known.clear()
                sets = [shingle_set(blank_words(t), size, known) for t in b.column(1).to_pylist()]
                values = band_values(signatures(sets, bands * rows), rows).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).cast(pa.int64()),
                        pa.array(list(map(len, sets)), pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands, pa.int32()), pa.array(values.reshape(-1))),
                    ],
                    ["doc_id", "n_shingles", "set_key", "bands"],
                )

    return docs.select(F.col(id_column).cast("long"), text).mapInArrow(described, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label (the smallest node it is connected with) of every node of the edges: large-star, small-star rounds.

    Every round keeps at most as many edges as before plus one a node; it ends when a round changes nothing. A round's table
    replaces the one before. The least neighbours (at most two nodes an edge) are broadcast where the counted edges bound them within
    BROADCAST_BYTES, so a hub's edges stay where they are; beyond that they are joined by shuffle, where adaptive execution splits hubs.
    """
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    state, many = None, now.count()
    while True:
        told = F.broadcast if many * 2 * 64 <= BROADCAST_BYTES else lambda df: df
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(told(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(told(low), "u")
        last, now = now, written(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(),
            "edges",
        )
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        discard(last)
        if tuple(seen) == state:
            break
        state, many = tuple(seen), seen[0]
    stars = now.groupBy("u").agg(F.min("v").alias("label"))
    return stars.select(F.col("u").alias("node"), "label").unionByName(stars.select(F.col("label").alias("node"), "label").distinct())


def _sets_of(members: DataFrame, docs: DataFrame, id_column: str, text: str, size: int) -> DataFrame:
    """members (comp, rep) with n and their sorted sets as bytes, from the texts of the representatives."""
    texts = docs.select(F.col(id_column).cast("long").alias("rep"), F.col(text).alias("_t"))

    @tidied
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for whole in batches:
            for at in range(0, len(whole), 512):
                b = whole.slice(at, 512)
                if len(known) > 300_000:
                    known.clear()
                sets = [shingle_set(blank_words(t), size, known) for t in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["comp", "rep", "set_key", "elements"],
                )

    few = broadcast_if_small(members.select("comp", "rep").distinct(), "members")
    return texts.join(few, "rep").select("comp", "rep", "_t").mapInArrow(made, "comp long, rep long, set_key binary, elements binary")


def _grouped(sets: DataFrame, percent: int) -> DataFrame:
    """comp, rep, elements -> rep, label, by exact links within comp."""

    def grouped(t: pa.Table) -> pa.Table:
        t = t.sort_by("rep")
        rep = t.column("rep").to_pylist()
        labels = link_sets([np.frombuffer(x, np.uint64) for x in t.column("elements").to_pylist()], percent) if len(rep) > 1 else [0] * len(rep)
        return pa.table({"rep": pa.array(rep, pa.int64()), "label": pa.array([rep[i] for i in labels], pa.int64())})

    return sets.groupBy("comp").applyInArrow(grouped, "rep long, label long")


def _thinned(sets: DataFrame, big: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """For the components in big (comp, hub): edges verified against the hub, and the (comp, rep) that remain.

    A member linked with the hub stays only if a member that isn't linked may still link with it: by the
    metric, one at hub distance d within twice the limit, d - limit <= its own distance.
    """
    limit = 1 - percent / 100
    hubs = broadcast_if_small(sets.join(big, "comp").filter("rep = hub").select("comp", "hub", F.col("elements").alias("hub_elements")), "hubs", "hub_elements")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, y in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append((both, len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], ["comp", "rep", "hub", "both", "either"])

    d = written(sets.join(hubs, "comp").select("comp", "rep", "hub", "elements", "hub_elements").mapInArrow(measured, "comp long, rep long, hub long, both long, either long"), "hub")
    d = d.withColumn("linked", F.expr(f"100 * both >= {percent} * either")).withColumn("d", F.expr("1 - both / either"))
    edges = d.filter("linked and rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    near = d.filter(f"not linked and d <= {2 * limit + 1e-9}").groupBy("comp").agg(F.min("d").alias("least"))
    stay = d.join(near, "comp", "left").filter(f"not linked or (least is not null and d >= least - {limit + 1e-9})")
    return edges, stay.select("comp", "rep")


def _by_band(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """sets with their band values in place of components, where two of them share one.

    Links of a component are links between members that share a band, united; so none of its bands need be one task with another.
    """
    bands = written(sets.select("rep", "set_key").join(classes.select("rep", "set_key", "bands"), ["rep", "set_key"]).select("rep", "set_key", F.explode("bands").alias("comp")), "split")
    shared = bands.groupBy("comp").count().filter("count > 1").select("comp")
    return sets.drop("comp").join(bands.join(shared, "comp"), ["rep", "set_key"]).select("comp", "rep", "set_key", "elements")


def components(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    size: int = SHINGLE,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
    large: int = LARGE,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs."""
    told = written(_described(docs, id_column, text, size, bands, rows), "described")
    real = told.filter("n_shingles > 0 and doc_id is not null")
    classes = written(real.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"), F.max("n_shingles").alias("n_shingles")), "classes")
    banded = classes.select("rep", F.explode("bands").alias("band"))
    first = banded.groupBy("band").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low <> high").select("band", "low")
    near = banded.join(first, "band").filter("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    candidate = written(connected(near).select(F.col("node").alias("rep"), F.col("label").alias("comp")), "candidates")
    # a doc_id may stand for several classes where its rows differ in text: each is a member of its own
    members = candidate.join(classes.select("rep", "set_key", "n_shingles"), "rep")
    sets = _sets_of(members, docs, id_column, text, size).dropDuplicates(["comp", "rep", "set_key"])
    links, left, turn = None, None, 0
    over = (F.col("n") > large) | (F.col("bytes") > LARGE_BYTES)
    if members.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("n_shingles") * 8).alias("bytes")).filter(over).limit(1).count():
        rest, sets = [], written(sets, "sets")
        while True:
            sizes = sets.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("elements")).alias("bytes"), F.min_by("rep", F.xxhash64("rep", F.lit(turn))).alias("hub"))
            big = broadcast_if_small(sizes.filter(over).select("comp", "hub", "n"), "big")
            now = big.agg(F.sum("n")).first()[0] or 0
            rest.append(sets.join(big.select("comp"), "comp", "left_anti") if now else sets)
            if not now:
                break
            sets = sets.join(big.select("comp"), "comp", "left_semi")
            if left is not None and now > 0.7 * left:
                rest.append(_by_band(sets, classes))
                break
            left, turn = now, turn + 1
            edges, stay = _thinned(sets, big.select("comp", "hub"), percent)
            links = edges if links is None else links.unionByName(edges)
            sets = written(sets.join(stay.distinct(), ["comp", "rep"], "left_semi"), "sets")
        sets = reduce(DataFrame.unionByName, rest)
    grouped = _grouped(sets, percent).filter("rep <> label").select(F.col("rep").alias("a"), F.col("label").alias("b"))
    links = grouped if links is None else links.unionByName(grouped)
    # classes of one doc_id, copies of a class, and links between classes
    multiple = real.groupBy("doc_id").agg(F.count_distinct("set_key").alias("k")).filter("k > 1").limit(1).count()
    if multiple:
        own = real.select("doc_id", "set_key").join(classes.select("set_key", "rep"), "set_key")
        links = links.unionByName(own.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    label = connected(links).select(F.col("node").alias("rep"), "label")
    classed = classes.select("set_key", "rep").join(label, "rep", "left").select("set_key", F.coalesce("label", "rep").alias("_label"))
    return (
        told.select("doc_id", "n_shingles", "set_key")
        .join(classed, "set_key", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.coalesce("_label", "doc_id")).otherwise(F.col("doc_id"))).alias("component_id"),
        )
        .withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))
    )


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, **more) -> DataFrame:
    """The rows of docs whose document speaks for its group; of repeated rows of such a doc_id, one."""
    names = docs.columns
    found = components(docs, id_column, text, size, percent, **more)
    found = written(found.select("doc_id", "kept"), "kept")
    gone = broadcast_if_small(found.filter("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    left = docs.join(gone, docs[id_column].cast("long") == gone["_gone"], "left_anti")
    if found.filter("kept and doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count():
        nulls = left.filter(F.col(id_column).isNull())
        left = left.filter(F.col(id_column).isNotNull()).dropDuplicates([id_column]).unionByName(nulls)
    return left.select(*columns(names))
