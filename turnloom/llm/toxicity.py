"""Toxicity: subword-bag embeddings, averaged into a linear softmax, trained jointly in numpy.

A word (run of letters, lower-cased) is the mean of the vectors of its subwords: itself and its character
n-grams of GRAMS with `<` and `>` at its ends, each hashed to one of BUCKETS rows. A document is the mean of its
words and of PAD empty ones, and a linear softmax over two classes reads it; vectors and softmax are trained together.
Misspelt and inflected words never seen in training share n-gram vectors with those that were.

The classifier is fitted on a bounded sample: at most SAMPLE_ROWS toxic and CLEAN_TIMES as many clean labelled rows, those with the
smallest hash of their id, with texts of up to SAMPLE_CHARS characters. Scoring takes every row and every
word: as the softmax is linear in the mean, each word has one number, kept in a bounded table by word.

Nulls and texts without letters have no words: their score is that of the bias alone. A document without label,
or with a null one, isn't trained on. With no labelled rows of either class every score is 0.5. Repeated rows are
scored one by one; a doc_id with several labels counts as toxic if one of them says so, and of several texts of one doc_id
the smallest is trained on. Empty tables give
no rows. Further columns stay out of `score` and are kept by `drop_toxic`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import columns as own_columns
from turnloom.llm.common import crc_mod, give_back, mix, schema_of, tidied

GRAMS = (4, 5)
BUCKETS = 1 << 20
DIMENSIONS = 4
SAMPLE_ROWS = 1500
#: Clean rows for each toxic one in the sample, at most, and what a clean row weighs.
CLEAN_TIMES, CLEAN_WEIGHT = 2, 1.0
SAMPLE_CHARS = 10_000
THRESHOLD = 0.7
#: Training: steps, rate, momentum, weight decay, and what a document's mean is multiplied by.
STEPS, RATE, MOMENTUM, DECAY, SCALE = 60, 0.005, 0.9, 1.0, 300.0
#: Spread of the vectors before training.
SPREAD = 0.01
#: Empty words added to every mean, so that a few words of a short text don't decide alone.
PAD = 30
#: Words whose numbers a task keeps.
TABLE_WORDS = 200_000

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return [] if text is None else _WORD.findall(text.lower())


def subwords(words: list[str], grams: tuple[int, ...] = GRAMS, size: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of all words (without `<` or `>`), and the word each belongs to."""
    code = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.flatnonzero(code == ord("<"))
    owner = np.cumsum(code == ord("<")) - 1
    buckets, owners = [], []
    for n in grams:
        count = len(code) - n + 1
        if count > 0:
            h = np.full(count, n, np.uint64)
            for k in range(n):
                h = mix(h ^ code[k : count + k])
            same = owner[:count] == owner[n - 1 :]
            buckets.append(h[same])
            owners.append(owner[:count][same])
    if len(starts):  # the whole word, as a sum over its characters at their places
        place = (np.arange(len(code)) - starts[owner]).astype(np.uint64)
        buckets.append(mix(np.add.reduceat(mix(code ^ (place << np.uint64(32))), starts)))
        owners.append(np.arange(len(starts)))
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return (np.concatenate(buckets) % np.uint64(size)).astype(np.int64), np.concatenate(owners)


@dataclass
class Model:
    """u: what each bucket adds to the logit of class 1 over class 0; bias: what every document has; w: the trained softmax; axes: singular values of the vectors."""

    u: np.ndarray
    bias: float
    w: np.ndarray | None = None
    axes: np.ndarray | None = None

    def numbers(self, words: list[str]) -> np.ndarray:
        """The logit of each word: the mean over its subwords."""
        bucket, owner = subwords(words)
        n = np.bincount(owner, minlength=len(words))
        return np.bincount(owner, self.u[bucket], minlength=len(words)) / np.maximum(n, 1)

    def score(self, texts: list[str | None], known: dict[str, float]) -> np.ndarray:
        lists = [words_of(t) for t in texts]
        new = list({w for ws in lists for w in ws if w not in known})
        if len(known) + len(new) > TABLE_WORDS:
            known.clear()
            new = list({w for ws in lists for w in ws})
        for k in range(0, len(new), 20_000):
            known.update(zip(new[k : k + 20_000], self.numbers(new[k : k + 20_000]).tolist(), strict=True))
        mean = np.array([sum(map(known.__getitem__, ws)) / (len(ws) + PAD) for ws in lists])
        return 1 / (1 + np.exp(-np.clip(SCALE * mean + self.bias, -50, 50)))


def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, share) of all texts, documents in order."""
    counts, buckets, shares = np.zeros(len(texts), np.int64), [np.zeros(0, np.int32)], [np.zeros(0, np.float32)]
    for i, t in enumerate(texts):
        ws = words_of(t)
        if not ws:
            continue
        bucket, owner = subwords(ws)
        share = 1.0 / np.bincount(owner, minlength=len(ws))[owner] / (len(ws) + PAD)
        b, at = np.unique(bucket, return_inverse=True)
        counts[i] = len(b)
        buckets.append(b.astype(np.int32))
        shares.append((np.bincount(at, share) * SCALE).astype(np.float32))
    bucket = np.concatenate(buckets)
    buckets.clear()  # lists of many small arrays go before the next array is made
    share = np.concatenate(shares)
    shares.clear()
    return np.repeat(np.arange(len(texts), dtype=np.uint16 if len(texts) < 1 << 16 else np.int32), counts), bucket, share


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))


def _ranges(starts: np.ndarray, n: int, most: int = 500_000):
    """(first run, run behind the last, first value, value behind the last) of stretches of whole runs, about `most` values each."""
    cuts = np.unique(np.searchsorted(starts, np.arange(0, n, most)))
    for low, high in zip(cuts.tolist(), [*cuts[1:].tolist(), len(starts)], strict=True):
        yield low, high, int(starts[low]), int(starts[high]) if high < len(starts) else n


def train(texts: list[str], labels: list[int], seed: int = 11) -> Model:
    """Vectors E (BUCKETS x DIMENSIONS) and softmax W (DIMENSIONS x 2), jointly, by gradient descent on all of the sample.

    Logits are X E W + b. With D = P - Y, the gradients are dE = (X' D) W' and dW = E' (X' D): each step passes
    over the sparse X once for X' D and once a dimension for X E. A row of E moves by its gradient over its curvature plus the
    decay: rows of rare subwords, which could only learn the sample by heart, hardly move. A row of W moves by its
    gradient over its own curvature, that of its column of X E. Vectors start at random, so the softmax turns while it learns
    which of their dimensions tell, and they don't all lie on one line.
    """
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    doc, bucket, share = _features(texts)
    give_back()
    if not len(doc):
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    used = np.flatnonzero(np.bincount(bucket, minlength=BUCKETS))  # rows of E that the sample moves
    column = np.zeros(BUCKETS, np.int32)
    column[used] = np.arange(len(used))
    column = column[bucket]
    del bucket
    by_doc = _starts(doc)
    rows = doc[by_doc]
    # the same values by column: a range of columns is sorted at a time, as all places at once take as much as all arrays
    sizes = np.bincount(column)
    by_column = np.cumsum(sizes) - sizes
    doc_of, share_of = np.empty_like(doc), np.empty_like(share)
    for low, high, first, last in _ranges(by_column, len(column)):
        own = np.flatnonzero((column >= low) & (column < high))
        own = own[np.argsort(column[own], kind="stable")]
        doc_of[first:last], share_of[first:last] = doc[own], share[own]
    del own, doc
    give_back()
    doc_parts, column_parts = list(_ranges(by_doc, len(column))), list(_ranges(by_column, len(column)))
    rng = np.random.default_rng(seed)
    half = rng.normal(size=DIMENSIONS)
    half /= 2 * np.linalg.norm(half)
    e, w, bias = rng.normal(0, SPREAD, (len(used), DIMENSIONS)), np.stack([-half, half], axis=1), np.zeros(2)
    curve, back = np.empty(len(used), np.float32), np.empty(len(used), np.float32)
    for low, high, first, last in column_parts:
        curve[low:high] = np.add.reduceat(share_of[first:last] * share_of[first:last], by_column[low:high] - first)
    curve = 1 / (curve / 4 + DECAY)
    mean = np.empty((len(rows), DIMENSIONS))
    weight = np.where(y > 0, 1.0, CLEAN_WEIGHT)
    speed_e, speed_w, speed_b = np.zeros_like(e), np.zeros_like(w), np.zeros(2)
    for _ in range(STEPS):
        for i, k in enumerate(e.T.astype(np.float32)):
            for low, high, first, last in doc_parts:
                mean[low:high, i] = np.add.reduceat(share[first:last] * k[column[first:last]], by_doc[low:high] - first)
        logit = np.full(len(y), bias[1] - bias[0])
        logit[rows] += mean @ (w[:, 1] - w[:, 0])
        d = (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - y) * weight
        told = d.astype(np.float32)
        for low, high, first, last in column_parts:
            back[low:high] = np.add.reduceat(share_of[first:last] * told[doc_of[first:last]], by_column[low:high] - first)
        both = np.stack([-back, back], axis=1)
        speed_e = MOMENTUM * speed_e - 2 * RATE * curve[:, None] * (both @ w.T + DECAY / 2 * e)
        speed_w = MOMENTUM * speed_w - 2 * RATE * (e.T @ both) / ((mean * mean).sum(axis=0) / 4 + DECAY)[:, None]
        speed_b = MOMENTUM * speed_b - RATE * 2 / len(y) * np.array([-d.sum(), d.sum()])
        e, w, bias = e + speed_e, w + speed_w, bias + speed_b
    u = np.zeros(BUCKETS, np.float32)
    u[used] = e @ (w[:, 1] - w[:, 0])
    return Model(u, float(bias[1] - bias[0]), w, np.sqrt(np.maximum(np.linalg.eigvalsh(e.T @ e)[::-1], 0)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    """The model of a bounded sample of the labelled rows outside the held-out third."""
    told = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    told = told.filter(crc_mod("doc_id", 3) != 1)
    order = F.xxhash64(F.lit("toxicity"), F.col("doc_id"))
    sizes = {r["toxic"]: r["count"] for r in told.filter("toxic in (0, 1)").groupBy("toxic").count().collect()}  # two rows
    picked = []
    for k in (0, 1):
        want = rows * (1 if k else CLEAN_TIMES)
        # a share by hash, twice what is wanted, is sorted: not every task's first rows
        share = min(1.0, 2 * want / max(1, sizes.get(k, 0)))
        picked.append(told.filter((F.col("toxic") == k) & (F.pmod(order, F.lit(1 << 30)) < share * (1 << 30))).orderBy(order, "doc_id").limit(want))
    ids = picked[0].unionByName(picked[1])  # rows * (1 + CLEAN_TIMES) at most
    short = docs.filter(F.length("text") <= chars).select("doc_id", "text")
    sample = short.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id").toPandas()
    texts, marks = sample["text"].tolist(), sample["toxic"].tolist()
    del sample
    model = train(texts, marks)
    del texts
    give_back()  # of the driver's memory
    return model


def score(docs: DataFrame, model: Model, text: str = "text", columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns, then score (0 to 1) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidied
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for whole in batches:
            for at in range(0, len(whole), 1000):
                b = whole.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(shared.value.score(b.column(len(columns)).to_pylist(), known))], [*columns, "score"])

    return docs.select(*own_columns(columns), F.col(text).alias("_t")).mapInArrow(scored, schema_of(docs, columns, "score double"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return score(docs, fit(docs, labels)).select(
        "doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score under THRESHOLD, with docs' own columns."""
    names = docs.columns
    whole = docs.withColumn("_own", F.struct(*own_columns(names))).select("_own", "text")
    return score(whole, fit(docs, labels), columns=("_own",)).filter(F.col("score") < THRESHOLD).select("_own.*")
