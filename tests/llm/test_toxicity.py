"""Toxicity on invented labels: held-out accuracy, unseen misspellings, odd rows."""

import random
import tracemalloc

import numpy as np

from turnloom.llm import toxicity as tx


def corpus(seed, n=500):
    rng = random.Random(seed)
    plain = ["".join(rng.choice(["ba", "ne", "ro", "ti", "lu", "sha"]) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    bad = ["grumpelwart", "snorkfiend", "muckbrain"]
    rows = []
    for i in range(n):
        toxic = int(rng.random() < 0.3)
        w = rng.choices(plain, k=rng.randrange(20, 120))
        if toxic:
            for _ in range(max(2, len(w) // 30)):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w).capitalize() + ".", toxic))
    return rows


def test_gradients_follow_the_loss_and_subwords_are_local():
    bucket, owner = tx.subwords(["abcd", "é", "abcde"])
    assert set(owner) == {0, 1, 2}
    one, _ = tx.subwords(["abcd"])
    assert set(one) == set(bucket[owner == 0])  # a word's subwords don't depend on its neighbours
    assert len(tx.subwords([])[0]) == 0


def test_held_out_and_misspelt():
    rows = corpus(1)
    model = tx.train([r[1] for r in rows[:350]], [r[2] for r in rows[:350]])
    score = model.score([r[1] for r in rows[350:]], {})
    right = [(s >= tx.THRESHOLD) == bool(r[2]) for s, r in zip(score, rows[350:], strict=True)]
    assert np.mean(right) > 0.97
    clean = "bane roti lusha tiro nelu " * 6
    base, bad = model.score([clean, clean + " grumpelwert snorkfiends " * 2], {})
    assert base < 0.3 < tx.THRESHOLD < bad


def test_model_without_one_class_or_words():
    assert tx.train([], []).score(["a", None], {}).tolist() == [0.5, 0.5]
    assert tx.train(["x y"], [1]).score(["x"], {}).tolist() == [0.5]
    assert tx.train(["1 2", "3"], [0, 1]).score(["x"], {}).tolist() == [0.5]


def test_tables(spark):
    rows = corpus(2, 300)
    docs = spark.createDataFrame([(i, t, "en", 9) for i, t, _ in rows] + [(None, "grumpelwart " * 40, "en", 1), (1000, None, None, None), (1001, "", "x", 0), (1002, "bane " * 40000, "x", 0), (1002, "bane", "x", 0)], "doc_id long, text string, lang string, score int")
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in rows] + [(i, 0, 0) for i, _, _ in rows[:5]] + [(None, 1, 1), (1000, None, None)], "doc_id long, quality int, toxic int")
    got = tx.judge(docs, labels).collect()
    assert len(got) == 305 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= tx.THRESHOLD) for r in got)
    truth = {i: x for i, _, x in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 60 and np.mean([truth[r["doc_id"]] == r["predicted"] for r in held]) > 0.9
    left = tx.drop_toxic(docs, labels)
    assert left.columns == docs.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert {1000, 1001, 1002} <= set(ids) and None not in ids and len(ids) == sum(1 - r["predicted"] for r in got)
    assert tx.judge(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in tx.judge(docs.limit(3), labels.limit(0)).collect()} == {0.5}


def test_softmax_is_trained_with_the_vectors():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(60)]
    texts = [" ".join(rng.choice(words[:40] if k % 2 else words[20:], 40)) for k in range(80)]
    model = tx.train(texts, [k % 2 for k in range(80)], seed=11)
    half = np.random.default_rng(11).normal(size=tx.DIMENSIONS)
    half /= 2 * np.linalg.norm(half)
    start = np.stack([-half, half], axis=1)
    assert np.linalg.norm(model.w - start) > 0.1 * np.linalg.norm(start)


def test_vectors_do_not_lie_on_one_line():
    rows = corpus(4, 200)
    axes = tx.train([r[1] for r in rows], [r[2] for r in rows]).axes
    assert len(axes) == tx.DIMENSIONS and axes[-1] > 0.005 * axes[0]


def test_ties_of_a_doc_id_do_not_depend_on_partitions(spark):
    rows = [(i, t, x) for i, t, x in corpus(6, 120)]
    texts = [(i, t) for i, t, _ in rows] + [(i, "zz " + t[::-1]) for i, t, _ in rows]
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in rows], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    one, other = (tx.fit(d, labels) for d in (docs.repartition(1), docs.orderBy(docs.text.desc()).repartition(7)))
    assert np.array_equal(one.u, other.u) and one.bias == other.bias


def test_training_equals_dense_loops(monkeypatch):
    monkeypatch.setattr(tx, "STEPS", 12)
    rows = corpus(9, 40)
    texts, y = [r[1][:300] for r in rows] + ["", "12"], np.array([r[2] for r in rows] + [0, 1], float)
    share = []
    for t in texts:
        own = {}
        words = tx.words_of(t)
        for w in words:
            buckets = tx.subwords([w])[0].tolist()
            for b in buckets:
                own[b] = own.get(b, 0.0) + tx.SCALE / len(buckets) / (len(words) + tx.PAD)
        share.append(own)
    used = sorted(set().union(*share))
    x = np.array([[own.get(b, 0.0) for b in used] for own in share])
    rng = np.random.default_rng(11)
    half = rng.normal(size=tx.DIMENSIONS)
    half /= 2 * np.linalg.norm(half)
    e, w, bias = rng.normal(0, tx.SPREAD, (len(used), tx.DIMENSIONS)), np.stack([-half, half], axis=1), np.zeros(2)
    move_e, move_w, move_b = np.zeros_like(e), np.zeros_like(w), np.zeros(2)
    hot = np.stack([1 - y, y], axis=1)
    for _ in range(12):
        mean = x @ e
        logit = mean @ w + bias
        p = np.exp(logit - logit.max(axis=1, keepdims=True))
        d = p / p.sum(axis=1, keepdims=True) - hot
        speed = 1 / ((x * x).sum(axis=0) / 4 + tx.DECAY)
        back = x.T @ d  # gradients by the chain rule, without the shortcuts of the operator
        move_e = tx.MOMENTUM * move_e - 2 * tx.RATE * speed[:, None] * (back @ w.T + tx.DECAY / 2 * e)
        move_w = tx.MOMENTUM * move_w - 2 * tx.RATE * (e.T @ back) / ((mean * mean).sum(axis=0) / 4 + tx.DECAY)[:, None]
        move_b = tx.MOMENTUM * move_b - tx.RATE * 2 / len(y) * d.sum(axis=0)
        e, w, bias = e + move_e, w + move_w, bias + move_b
    model = tx.train(texts, y.astype(int).tolist())
    u = e @ (w[:, 1] - w[:, 0])
    assert np.allclose(model.u[used], u, rtol=1e-3, atol=1e-5) and abs(model.bias - (bias[1] - bias[0])) < 1e-5 and np.allclose(model.w, w, atol=1e-4)
    plain = 1 / (1 + np.exp(-(x @ u + bias[1] - bias[0])))
    assert np.allclose(model.score(texts, {}), plain, atol=1e-4)


def test_training_takes_few_copies_of_its_values():
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(2000)]
    texts = [" ".join(rng.choices(words, k=300)) for _ in range(1500)]
    values = sum(a.nbytes for a in tx._features(texts))
    tracemalloc.start()
    tx.train(texts, [k % 2 for k in range(1500)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.5 * values
