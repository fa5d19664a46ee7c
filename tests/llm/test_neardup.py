"""Near-duplicate groups against all pairs."""

import random
import time
import tracemalloc

import numpy as np

from turnloom.llm import neardup as nd
from turnloom.llm.common import blank_words


def plain_set(text, size=3):
    w = blank_words(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, size=3, percent=85):
    """Labels of (doc_id, text) rows."""
    sets = [plain_set(t, size) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for k in range(i):
            if None in (rows[i][0], rows[k][0]):
                continue
            both = len(sets[i] & sets[k])
            if rows[i][0] == rows[k][0] or (sets[i] and sets[k] and 100 * both >= percent * (len(sets[i]) + len(sets[k]) - both)):
                up[root(i)] = root(k)
    return [None if d is None else min(rows[k][0] for k in range(len(rows)) if rows[k][0] is not None and root(k) == root(i)) for i, (d, _) in enumerate(rows)]


def corpus(seed, n=60):
    rng = random.Random(seed)
    rows, at = [(900, None), (901, ""), (902, " \n"), (903, "A b"), (904, "a B"), (905, "a b c"), (None, "a b c"), (906, "x"), (906, "x"), (907, "y " * 5000)], 0
    for _ in range(n // 6):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, 120))]
        for _ in range(rng.randrange(1, 10)):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(9)}"
            rows.append((at, " ".join(w)))
            at += 1
    rng.shuffle(rows)
    return rows


def test_signatures_estimate_jaccard_and_stop_early():
    rng = np.random.default_rng(2)
    error = []
    for _ in range(60):
        a = rng.integers(0, 2**63, 300, dtype=np.uint64)
        b = np.concatenate([a[: rng.integers(100, 300)], rng.integers(0, 2**63, 50, dtype=np.uint64)])
        sig = nd.signatures([np.unique(a), np.unique(b)], 125)
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        error.append((sig[0] == sig[1]).mean() - j)
    assert abs(np.mean(error)) < 0.02 and np.std(error) < 0.05
    big = rng.integers(0, 2**63, 500_000, dtype=np.uint64)
    assert (nd.signatures([np.unique(big)], 125) < 1).all()
    assert np.isinf(nd.signatures([np.zeros(0, np.uint64)], 10)).all()
    # slots of a single element: one value in each [j, j + 1)
    assert sorted(np.floor(nd.signatures([np.array([7], np.uint64)], 20))[0]) == list(range(20))


def test_links_within_a_component_equal_all_pairs():
    rng = random.Random(4)
    for trial in range(40):
        base = list(range(rng.randrange(10, 60)))
        sets = []
        for _ in range(rng.randrange(2, 40)):
            s = set(base)
            for _ in range(rng.randrange(8)):
                s.discard(rng.choice(base))
                s.add(rng.randrange(100, 130))
            sets.append(np.array(sorted(s), np.uint64))
        up = list(range(len(sets)))
        for _ in range(len(sets)):
            for i in range(len(sets)):
                for k in range(len(sets)):
                    both = len(np.intersect1d(sets[i], sets[k]))
                    if 100 * both >= 85 * (len(sets[i]) + len(sets[k]) - both):
                        up[i] = up[k] = min(up[i], up[k])
        got = nd.link_sets(sets)
        assert len({*zip(got.tolist(), up)}) == len(set(up)) == len(set(got.tolist())), trial


def test_a_line_that_many_texts_have_costs_neither_pairs_nor_their_memory():
    rng = np.random.default_rng(8)
    line = rng.integers(0, 2**63, 10, dtype=np.uint64)
    sets = [np.unique(np.concatenate([line, rng.integers(0, 2**63, 12, dtype=np.uint64)])) for _ in range(5000)]
    sets += [np.concatenate([s[:-1], s[-1:] + np.uint64(1)]) for s in sets[:50]]
    tracemalloc.start()
    got = nd.link_sets(sets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.tolist() == [*range(5000), *range(50)]
    assert peak < 60e6  # distances of all to all take 200 MB


def test_changed_copies_that_lie_too_far_from_their_text_are_not_all_compared():
    rng = np.random.default_rng(5)
    base = np.arange(400, dtype=np.uint64)
    sets = []
    for _ in range(4000):
        s = base.copy()
        gone = rng.permutation(400)[: rng.integers(46, 80)]
        s[gone] = rng.integers(1000, 2**63, len(gone), dtype=np.uint64)
        sets.append(np.sort(s))
    sets += [np.concatenate([s[:-1], s[-1:] + np.uint64(1)]) for s in sets[:50]]
    began = time.process_time()
    got = nd.link_sets(sets, 80)
    took = time.process_time() - began
    assert got.tolist() == [*range(4000), *range(50)]
    assert took < 5, took  # 0.3 s; 12 s when all that share a head were compared


def test_components_over_the_limits_that_hubs_do_not_thin_are_split_by_band(spark, monkeypatch):
    rng = random.Random(3)
    line = " ".join(f"l{i}" for i in range(40))
    rows = [(i, f"{line} " + " ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(4, 14)))) for i in range(60)]
    rows += [(100 + i, t + " more") for i, t in rows[:20]] + [(200 + i, f"more {t}") for i, t in rows[10:25]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    split, by_band = [], nd._by_band
    monkeypatch.setattr(nd, "_by_band", lambda *a: split.append(1) or by_band(*a))
    got = {r["doc_id"]: r["component_id"] for r in nd.components(docs, large=10).collect()}
    assert split and got == {d: c for (d, _), c in zip(rows, brute(rows), strict=True)}


def test_components_equal_all_pairs(spark):
    for seed, large in ((1, nd.LARGE), (2, 2)):
        rows = corpus(seed)
        docs = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, component_id string").repartition(5)
        got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in nd.components(docs, large=large).collect()}
        want = {(d, len(plain_set(t)), c, d is None or c == d) for (d, t), c in zip(rows, brute(rows), strict=True)}
        assert got == want


def test_rows_of_one_id_with_different_texts_join_groups(spark):
    long = " ".join(f"k{i}" for i in range(40))
    rows = [(5, "p q r s"), (5, long), (2, "p q r s"), (9, long), (11, "else where")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in nd.components(docs).collect()} == {(5, 2), (2, 2), (9, 2), (11, 11)}
    assert nd.components(docs.limit(0)).count() == 0


def test_keep_one(spark):
    rows = [(1, "a b c d e f", "x"), (2, "A b c d e f", "y"), (3, "other words here now", None), (3, "other words here now", None), (None, "a b c d e f", "q"), (4, None, "w"), (6, None, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = nd.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect()) == [(False, 1), (False, 3), (False, 4), (False, 6), (True, 0)]
