"""Language identification: script ranges narrow the candidates, then Viterbi over per-word scores.

Words are runs of letters, lower-cased. A word's first letter gives its script, and only languages that were
seen in that script are candidates. Each candidate's score is the mean log probability of the word's subwords
(itself and character n-grams, hashed) in that language, normalised over the candidates and bounded. Viterbi with a
penalty for every switch labels the words, so mixed texts fall into spans; the language of most words is the text's.

Viterbi runs on all texts of a batch at once: words are cut into blocks of BLOCK, each block gives a
(before, after) score matrix, the matrices are followed text by text, and the blocks are labelled again from their
entry states. The result is that of the plain recurrence.

The model is fitted on at most SAMPLE_ROWS rows a language, of the training share: a share of the language's rows by a hash of
their id, in order of the hash, with at most SAMPLE_CHARS characters. Every row is predicted on its whole text.

Nulls and texts without letters are `und` with score 0, also if no language was learned. A null lang isn't learned;
a null doc_id counts as training. Ties go to the language first by name. Repeated rows are predicted one by one; empty
tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.common import broadcast_if_small, crc_mod, tidied
from turnloom.llm.toxicity import subwords

GRAMS = (1, 2, 3)
BUCKETS = 1 << 18
SAMPLE_ROWS = 1000
SAMPLE_CHARS = 20_000
OVERSAMPLE = 4
SMOOTHING = 0.05
#: A word's scores lie between -BOUND and 0; a switch costs SWITCH.
BOUND, SWITCH = 4.0, 8.0
#: A language is written in a script that holds at least this share of its words.
SCRIPT_SHARE = 0.01
BLOCK = 64

#: First code points of Unicode ranges and the script of each range up to the next.
SCRIPT_RANGES = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"),
    (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "Latin"), (0x2C80, "Greek"), (0x2DE0, "Cyrillic"), (0x2E80, "Han"), (0x3040, "Kana"),
    (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"), (0xA640, "Cyrillic"), (0xA720, "Latin"), (0xAC00, "Hangul"),
    (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0x10000, "Other"), (0x20000, "Han"),
]
_FIRST = np.array([r[0] for r in SCRIPT_RANGES])
_NAMES = sorted({r[1] for r in SCRIPT_RANGES})
_SCRIPT = np.array([_NAMES.index(r[1]) for r in SCRIPT_RANGES])
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    if text is None:
        return []
    found = _WORD.findall(text.lower())
    return found if all(map(str.isalpha, set(found))) else [w for w in found if any(map(str.isalpha, w))]


def scripts_of(words: list[str]) -> np.ndarray:
    first = np.fromiter((ord(next(filter(str.isalpha, w))) for w in words), np.int64, len(words))
    return _SCRIPT[np.searchsorted(_FIRST, first, "right") - 1]


class Model:
    """Log probabilities of subwords by language, and the scripts of each."""

    def __init__(self, texts: list[str], langs: list[str]):
        self.langs = sorted(set(langs))
        n = len(self.langs)
        counts = np.zeros((n, BUCKETS))
        scripts = np.zeros((n, len(_NAMES)))
        for k, lang in enumerate(self.langs):
            seen: dict[str, int] = {}
            for t, own in zip(texts, langs, strict=True):
                if own == lang:
                    for w in words_of(t):
                        seen[w] = seen.get(w, 0) + 1
            if not seen:
                continue
            words, times = list(seen), np.fromiter(seen.values(), float, len(seen))
            for at in range(0, len(words), 100_000):
                bucket, owner = subwords(words[at : at + 100_000], GRAMS, BUCKETS)
                counts[k] += np.bincount(bucket, times[at + owner], minlength=BUCKETS)
            scripts[k] = np.bincount(scripts_of(words), times, minlength=len(_NAMES)) / times.sum()
        total = counts.sum(axis=1, keepdims=True)
        self.logs = np.log((counts + SMOOTHING) / (total + SMOOTHING * BUCKETS)).astype(np.float32)
        self.writes = scripts >= SCRIPT_SHARE

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Bounded log posterior of each language for each word; zeros if no language is written in its script."""
        bucket, owner = subwords(words, GRAMS, BUCKETS)
        n = np.maximum(np.bincount(owner, minlength=len(words)), 1)
        mean = np.stack([np.bincount(owner, row[bucket], minlength=len(words)) for row in self.logs], axis=1) / n[:, None]
        able = self.writes[:, scripts_of(words)].T
        mean = np.where(able, mean * 3, -np.inf)
        none = ~able.any(axis=1)
        mean[none] = 0
        mean -= mean.max(axis=1, keepdims=True)
        mean -= np.log(np.exp(mean).sum(axis=1, keepdims=True))
        mean[none] = 0
        return np.maximum(mean, -BOUND).astype(np.float32)


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each row of scores (rows of all texts one behind the other), text by text."""
    total, states = scores.shape
    blocks = -(-lengths // BLOCK)
    first = np.cumsum(blocks) - blocks
    row = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = (np.repeat(first, lengths) + row // BLOCK) * BLOCK + row % BLOCK
    emit = np.zeros((int(blocks.sum()) * BLOCK, states), np.float32)
    emit[place] = scores
    emit = emit.reshape(-1, BLOCK, states)
    n = len(emit)
    # what each block makes of each state before it
    move = np.full((n, states, states), -np.inf, np.float32)
    move[:, range(states), range(states)] = 0
    for t in range(BLOCK):
        move = np.maximum(move, move.max(axis=2, keepdims=True) - np.float32(switch)) + emit[:, t, None, :]
    # text by text, block k of all texts that have one
    at = np.zeros((n, states), np.float64)
    order = np.argsort(-blocks, kind="stable")
    have = np.searchsorted(-blocks[order], -np.arange(int(blocks.max(initial=0))), "left")  # texts with more than k blocks
    value = np.zeros((len(lengths), states))
    for k, live in enumerate(have.tolist()):
        texts = order[:live]
        b = first[texts] + k
        at[b] = value[texts]
        value[texts] = (value[texts][:, :, None] + move[b]).max(axis=1)
    state = value.argmax(axis=1)
    enter, leave = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k in range(len(have) - 1, -1, -1):
        texts = order[: have[k]]
        b = first[texts] + k
        leave[b] = state[texts]
        state[texts] = (at[b] + move[b, :, state[texts]]).argmax(axis=1)
        enter[b] = state[texts]
    del move
    # within the blocks, from their entry states
    best = np.full((n, states), -np.inf, np.float32)
    best[np.arange(n), enter] = 0
    source, stay = np.zeros((BLOCK, n), np.int16), np.zeros((BLOCK, n, states), bool)
    for t in range(BLOCK):
        source[t] = best.argmax(axis=1)
        other = best.max(axis=1, keepdims=True) - np.float32(switch)
        stay[t] = best >= other
        best = np.maximum(best, other) + emit[:, t]
    label = np.zeros((n, BLOCK), np.int16)
    for t in range(BLOCK - 1, -1, -1):
        label[:, t] = leave
        leave = np.where(stay[t, np.arange(n), leave], leave, source[t])
    return label.reshape(-1)[place]


def predict(texts: list[str | None], model: Model) -> tuple[list[str], list[float], list[np.ndarray]]:
    """Language, score (share of words that have it) and labels of the words of each text."""
    number: dict[str, int] = {}
    ids = [np.fromiter((number.setdefault(w, len(number)) for w in words_of(t)), np.int64) for t in texts]
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    if not len(number) or not model.langs:
        return ["und"] * len(texts), [0.0] * len(texts), [np.zeros(0, np.int16)] * len(texts)
    table = model.word_scores(list(number))
    flat = viterbi(table[np.concatenate(ids)], lengths)
    owner = np.repeat(np.arange(len(texts)), lengths)
    votes = np.bincount(owner * len(model.langs) + flat, minlength=len(texts) * len(model.langs)).reshape(len(texts), -1)
    top = votes.argmax(axis=1)
    share = votes.max(axis=1) / np.maximum(lengths, 1)
    langs = [model.langs[k] if n else "und" for k, n in zip(top.tolist(), lengths.tolist(), strict=True)]
    return langs, share.tolist(), np.split(flat, np.cumsum(lengths)[:-1])


def spans(text: str | None, model: Model) -> list[tuple[int, int, str]]:
    """(start, end, language) of maximal runs of words with one language, in characters of the lower-cased text."""
    found = [m for m in _WORD.finditer((text or "").lower()) if any(map(str.isalpha, m[0]))]
    out: list[tuple[int, int, str]] = []
    for m, k in zip(found, predict([text], model)[2][0].tolist(), strict=False):
        if out and out[-1][2] == model.langs[k]:
            out[-1] = (out[-1][0], m.end(), out[-1][2])
        else:
            out.append((m.start(), m.end(), model.langs[k]))
    return out


def fit(docs: DataFrame, held: int = 2, modulus: int = 4, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    """The model of a bounded sample of each language."""
    usable = docs.filter("lang is not null and text is not null").filter(F.length("text") <= chars)
    usable = usable.filter(F.coalesce(crc_mod("doc_id", modulus) != held, F.lit(True)))
    # a share of each language by hash, about OVERSAMPLE times the rows wanted, is ranked: no task ranks a whole language
    share = usable.groupBy("lang").agg(F.least(F.lit(float(OVERSAMPLE * rows)) / F.count(F.lit(1)), F.lit(1.0)).alias("share"))
    key = F.xxhash64(F.lit("language"), F.col("doc_id"), F.col("text"))  # so rows without an id don't share one key
    some = usable.select("lang", "text", "doc_id", key.alias("key")).join(broadcast_if_small(share, "languages", "lang"), "lang")
    some = some.filter(F.pmod(F.col("key"), F.lit(1 << 30)) < F.col("share") * float(1 << 30))
    order = Window.partitionBy("lang").orderBy("key", "doc_id", F.xxhash64("text"))
    picked = some.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= rows)
    sample = picked.select("lang", "text").toPandas()
    return Model(sample["text"].tolist(), sample["lang"].tolist())


def identify(docs: DataFrame, held: int = 2, modulus: int = 4) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, held, modulus))
    kind = dict(docs.dtypes)["doc_id"]

    @tidied
    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1500):
                b = whole.slice(at, 1500)
                langs, score, _ = predict(b.column(1).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    found = docs.select("doc_id", "text").mapInArrow(labelled, f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", (crc_mod("doc_id", modulus) == held).alias("held_out"), "lang_pred", "score")
