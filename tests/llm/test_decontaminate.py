"""FM-index search against a window-by-window search."""

import random
import re
from collections import Counter

import numpy as np

from turnloom.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return WORD.findall(low)


def brute(texts, items, window=10):
    phrases = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[k : k + window]), set()).add("" if i is None else str(i))
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for p, ids in phrases.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    found |= ids
        out.append((len(w), len(hit), len(found), dc.digest(found), bool(hit)))
    return out


def data(seed, n=60):
    rng = random.Random(seed)
    vocab = ["a", "b", "Ça", "d1", "E", "f", "日本"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 3, 4, 5, 12])))) for i in range(12)] + [(3, None), (None, "zz zz zz"), (77, "q")]
    texts = [None, "", "!!", "ZZ-zz zz", "q", "q " * 300]
    for _ in range(n):
        t = " ".join(rng.choices([*vocab, "other"], k=rng.randrange(60)))
        texts.append(t.replace(" ", rng.choice([" ", "-", ". ", "\n"])))
    return texts, items


def test_suffix_array_is_sorted_with_separators_by_place():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 400):
        text = rng.integers(0, 3, n)
        text[-1] = 0
        apart = np.cumsum(text == 0)
        plain = [((int(apart[i]),) if text[i] == 0 else (10**6 + int(text[i]),)) for i in range(n)]
        want = sorted(range(n), key=lambda i: [plain[k] for k in range(i, n)])
        assert dc.suffix_array(text).tolist() == want


def test_hits_equal_brute_force():
    for seed in range(12):
        texts, items = data(seed)
        for window in (10, 3):
            starts, hit, found = dc.hits(texts, dc.Phrases([(None if i is None else str(i), t) for i, t in items], window))
            got = [(int(starts[k + 1] - starts[k]), int(hit[starts[k] : starts[k + 1]].sum()), len(found[k]), dc.digest(found[k]), bool(found[k])) for k in range(len(texts))]
            assert got == brute(texts, items, window)


def frames(spark, texts, items):
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(texts)] + [(None, "q", None, None)], "doc_id long, text string, n_words int, items string")
    return docs, spark.createDataFrame(items, "item_id long, text string")


def test_query_in_one_and_in_many_blocks(spark):
    texts, items = data(99, 25)
    docs, bench = frames(spark, texts, items)
    want = Counter((i, *r) for i, r in enumerate(brute(texts, items, 3))) + Counter([(None, *brute(["q"], items, 3)[0])])
    for block in (dc.BLOCK_BYTES, 60):
        got = dc.search(docs, bench, window=3, block_bytes=block)
        assert Counter(tuple(r)[:6] for r in got.collect()) == want
    assert dc.search(docs.limit(0), bench).count() == 0
    assert {r["contaminated"] for r in dc.search(docs, bench.limit(0)).collect()} == {False}


def test_strip_leaves_no_phrase_and_clean_texts_alone(spark):
    texts, items = data(5, 40)
    texts.append("keep q keep")
    docs, bench = frames(spark, texts, items)
    docs = docs.withColumn("n_chars", docs["doc_id"])
    got = dc.strip(docs, bench, window=3)
    assert got.columns == docs.columns
    rows = {r["doc_id"]: r for r in got.collect()}
    before = brute(texts, items, 3)
    for i, t in enumerate(texts):
        if before[i][4]:
            assert not brute([rows[i]["text"]], items, 3)[0][4] and rows[i]["n_chars"] == len(rows[i]["text"])
        else:
            assert rows[i]["text"] == t
    assert rows[len(texts) - 1]["text"] == "keep   keep"


def test_strip_does_not_depend_on_blocks(spark):
    texts, items = data(9, 40)
    items += [(200, "v1 v2 v3 v4 v5"), (201, "v4 v5 v6 v7"), (202, "x1 x2 x3"), (203, "y1 y2 y3")]
    texts += ["o v1 v2 v3 v4 v5 v6 v7 o", "o x1 y1 y2 y3 x2 x3 o", "o y1 x1 x2 x3 y2 y3 o"]
    docs, bench = frames(spark, texts, items)
    want = {i: t for i, t in enumerate(dc.strip_texts(texts, dc.Phrases([(str(i), t) for i, t in items], 3)))}
    assert want[len(texts) - 3].split() == ["o", "o"] and want[len(texts) - 2].split() == ["o", "o"]
    for block_bytes in (10**9, 60, 20):
        assert {r["doc_id"]: r["text"] for r in dc.strip(docs.filter("doc_id is not null"), bench, window=3, block_bytes=block_bytes).collect()} == want
