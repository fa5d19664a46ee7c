"""The sharded trie model against dictionaries of counts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from turnloom.llm import ngramlm as lm
from turnloom.llm.common import blank_words


def brute(rows):
    """(n_tokens, n_known, N, base, score) of each (doc_id, text)."""
    lists = [[*blank_words(t), b"<end>"] for _, t in rows]
    training = [d is None or zlib.crc32(str(d).encode()) % 5 != 1 for d, _ in rows]
    c1, c2, c3, context = Counter(), Counter(), Counter(), Counter()
    for words, own in zip(lists, training):
        if own:
            w = ["<s>", "<s>", *words]
            for i in range(2, len(w)):
                c1[w[i]] += 1
                c2[w[i - 1], w[i]] += 1
                c3[w[i - 2], w[i - 1], w[i]] += 1
                context[w[i - 2], w[i - 1]] += 1
    n, z = sum(c1.values()), sum(c1.values()) + 0.5 * (len(c1) + 1)
    docs = sum(training)
    out = []
    for words in lists:
        w, base, score = ["<s>", "<s>", *words], 0.0, 0.0
        for i in range(2, len(w)):
            p1 = (c1[w[i]] + 0.5) / z
            cv = c1[w[i - 1]] if w[i - 1] != "<s>" else 0
            p2 = (c2[w[i - 1], w[i]] + lm.MU2 * p1) / (cv + lm.MU2) if cv and cv >= lm.FREQUENT * n else p1
            before = docs if i == 2 else c2[w[i - 2], w[i - 1]]
            assert before == context[w[i - 2], w[i - 1]]
            score += math.log10((c3[w[i - 2], w[i - 1], w[i]] + lm.MU3 * p2) / (before + lm.MU3))
            base += math.log10(p1)
        out.append((len(words), sum(c1[x] > 0 for x in words), n, base, score))
    return out


def test_elias_fano_round_trip_and_successor():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 0), (1, 10**12), (200, 3), (3000, 10**9), (500, 500)):
        values = np.sort(rng.integers(0, top + 1, n))
        code = lm.Memory().keep(values)
        assert code.get(np.arange(n)).tolist() == values.tolist()
        wanted = rng.integers(0, top + 2, 50)
        at = code.successor(np.zeros(50, np.int64), np.full(50, n), wanted)
        assert at.tolist() == np.searchsorted(values, wanted).tolist()


def test_trie_takes_a_few_bytes_an_ngram():
    rng = np.random.default_rng(1)
    w, v, u = (rng.zipf(1.3, 40000) % 3000 for _ in range(3))
    w3, v3, u3, back = lm.trigrams(w, v, u, 3000)
    trie = lm.Trie(w3, v3, u3, np.bincount(back), 3000, np.bincount(w, minlength=3000), np.zeros(3000, np.int64), 50000.0)
    grams = len(set(zip(w.tolist(), v.tolist()))) + len(set(zip(w.tolist(), v.tolist(), u.tolist())))
    assert trie.store.used < 9 * grams


@pytest.mark.parametrize("shard_tokens,frequent", [(10**9, 1e-5), (300, 0.02), (300, 1e-5)])
def test_scores_equal_dictionaries(spark, monkeypatch, shard_tokens, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["Ünï", "the", "the", "the", "the"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for i in range(70)]
    rows += [(100, None), (101, ""), (102, rows[3][1]), (102, rows[3][1]), (None, "the w1"), (104, "The " * 3000), (105, "never seen\x0bbefore\x1cx")]
    docs = spark.createDataFrame([(d, t, "q") for d, t in rows], "doc_id long, text string, score string").repartition(3)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]), r["base_score"], r["score"]) for r in lm.score(docs, shard_tokens=shard_tokens).collect())
    want = sorted(((d is None, d or 0, d is not None and zlib.crc32(str(d).encode()) % 5 == 1, n, k, total), base, score) for (d, _), (n, k, total, base, score) in zip(rows, brute(rows)))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1] for g in got], [w[1] for w in want], rtol=1e-9)
    assert all(abs(g[2] - w[2]) < 3e-4 * g[0][3] + 1e-6 for g, w in zip(got, want))


def test_rare_context_words_have_a_bigram_level(spark, monkeypatch):
    """Context words of under 1e-5 of the tokens, over few and many shards, listed or asked for."""
    rng = random.Random(5)
    words = [f"r{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(words, k=12))) for i in range(70)] + [(200, "the " * 300_000)]
    with monkeypatch.context() as m:
        m.setattr(lm, "FREQUENT", 0.0)
        want = {d: score for (d, _), (*_, score) in zip(rows, brute(rows))}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for hot, listed, shard_tokens in ((1e-5, 1e-6, 10**9), (0.1, 0.1, 20_000), (0.1, 1e-5, 20_000)):
        monkeypatch.setattr(lm, "HOT", hot, raising=False)
        monkeypatch.setattr(lm, "LISTED", listed, raising=False)
        got = {r["doc_id"]: r["score"] for r in lm.score(docs, shard_tokens=shard_tokens).collect()}
        assert all(abs(got[d] - want[d]) < 13 * 3e-4 for d, _ in rows[:-1])


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(docs).count() == 0


def test_levels_are_searched_as_they_are_packed(monkeypatch):
    """Queries go through select and successor search; the levels hold no plain arrays."""
    rng = np.random.default_rng(2)
    w, v, u = (rng.integers(0, 300, 5000) for _ in range(3))
    w3, v3, u3, back = lm.trigrams(w, v, u, 300)
    trie = lm.Trie(w3, v3, u3, np.bincount(back), 300, np.bincount(w, minlength=300), np.zeros(300, np.int64), 6000.0)
    sought, read = [], []
    seek, get = lm.EliasFano.seek, lm.EliasFano.get
    monkeypatch.setattr(lm.EliasFano, "seek", lambda self, wanted: sought.append(len(wanted)) or seek(self, wanted))
    monkeypatch.setattr(lm.EliasFano, "get", lambda self, i: read.append(len(i)) or get(self, i))
    trie.score(w3, v3, u3)
    pairs = len(set(zip(w.tolist(), v.tolist())))
    assert sought == [pairs, len(w3), len(w3)] and max(read) <= len(w3)
    for level in (trie.front, trie.second, trie.third):
        for code in (level.pointers, level.values, level.bases):
            assert code.low.dtype == np.uint64 and 64 * (len(code.low) + len(code.high)) < 64 * code.n + 600


def test_hot_ngrams_are_split_and_scored_alike(spark, monkeypatch):
    """A bigram and a trigram that make up much of the corpus, over many shards, by tables or whole."""
    rng = random.Random(9)
    words = [f"h{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choices(words, k=10) + ["of", "the", rng.choice(words), "of", "the", "end"])) for i in range(120)]
    rows += [(300, "of the " * 4000), (301, "of the"), (302, None)]
    with monkeypatch.context() as m:
        m.setattr(lm, "FREQUENT", 0.0)
        want = {d: (n, k, base, score) for (d, _), (n, k, _, base, score) in zip(rows, brute(rows))}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for hot_grams, shard_tokens in ((0.01, 400), (0.5, 400), (1e-4, 10**9)):
        monkeypatch.setattr(lm, "HOT_GRAMS", hot_grams)
        got = {r["doc_id"]: r for r in lm.score(docs, shard_tokens=shard_tokens).collect()}
        for d, (n, k, base, score) in want.items():
            r = got[d]
            assert (r["n_tokens"], r["n_known"]) == (n, k) and abs(r["base_score"] - base) < 1e-6 * n and abs(r["score"] - score) < 3e-4 * n + 1e-6
