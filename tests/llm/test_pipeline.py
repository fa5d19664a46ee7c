"""The pipeline's stages against plain Python, stage by stage."""

import random

import corpus_pipeline as cp
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_native_and_urls import brute_counts
from tests.llm.test_neardup import brute as groups
from turnloom.llm import pieces, toxicity


def make(tmp, spark):
    rng = random.Random(8)
    plain = ["".join(rng.choice(["ba", "ne", "ro", "ti", "lu"]) for _ in range(rng.randrange(1, 4))) for _ in range(400)]
    bench = [(i, " ".join(rng.choices(plain, k=14))) for i in range(6)]
    rows = []
    for i in range(260):
        w = rng.choices(plain, k=rng.randrange(5, 90))
        if i % 4 == 0:
            w += ["grumpelwart", "snorkfiend"] * 2
        if i % 7 == 1:
            w += bench[i % 6][1].split()
        if i % 9 == 2:
            w = rows[-1][1].split()
            w[0:1] = ["changed"]
        rows.append((i, " ".join(w), "en", f"s{i % 5}", None))
    rows += [(900, None, None, None, None), (901, "", "en", "s1", 0), (None, " ".join(plain[:30]), "en", None, 3)]
    d = str(tmp)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(260)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, bench


def test_stages(spark, tmp_path):
    d, bench = make(tmp_path, spark)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = docs.columns
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    now = sorted(docs.collect(), key=key)
    for k, (_, stage) in enumerate(cp.STAGES):
        left = stage(spark, docs, d)
        left.write.parquet(f"{d}/out{k}")
        docs = spark.read.parquet(f"{d}/out{k}")
        got = sorted(docs.collect(), key=key)
        ids = [r["doc_id"] for r in got]
        if k < 4:
            assert docs.columns == names
        if k == 0:
            model = toxicity.fit(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
            scores = model.score([r["text"] for r in now], {})
            assert ids == [r["doc_id"] for r, s in zip(now, scores) if s < toxicity.THRESHOLD]
            assert len(ids) < len(now)
        if k == 1:
            assert ids == [r["doc_id"] for r in now if not brute_counts(r["text"])[-1]]
        if k == 2:
            labels = groups([(r["doc_id"], r["text"]) for r in now], 5, 80)
            assert ids == [r["doc_id"] for r, c in zip(now, labels) if r["doc_id"] is None or r["doc_id"] == c]
            assert len(ids) < len(now)
        if k == 3:
            found = leaks([r["text"] for r in now], bench)
            assert ids == [r["doc_id"] for r in now] and any(f[-1] for f in found)
            assert not any(f[-1] for f in leaks([r["text"] for r in got], bench))
            assert all(a["text"] == b["text"] for a, b, f in zip(now, got, found) if not f[-1])
        if k == 4:
            m = pieces.machine()
            assert [r["ids"] for r in got] == [list(m.encode(r["text"])) for r in now] and all(r["decodes"] for r in got)
        now = got
    assert sorted(map(tuple, cp.run(spark, d).select("doc_id", "ids").collect()), key=str) == sorted(((r["doc_id"], r["ids"]) for r in now), key=str)


def test_odd_columns_come_through_all_stages(spark, tmp_path):
    """Names that operators use inside, names with dots, and null rows: all but the last stage return them as they were."""
    d, _ = make(tmp_path, spark)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    odd = {"_own": 1, "_t": "t", "score": 2, "rep": 3, "kept": "no", "comp": 4, "a.b": 5, "n_words": -7, "spans": "x", "_gone": 6}
    for name, value in odd.items():
        docs = docs.withColumn(name, cp.quality.F.lit(value))
    docs.write.parquet(f"{d}/odd")
    docs = spark.read.parquet(f"{d}/odd")
    for k, (_, stage) in enumerate(cp.STAGES[:-1]):
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        out.write.parquet(f"{d}/odd{k}")
        docs = spark.read.parquet(f"{d}/odd{k}")
        assert {tuple(r) for r in docs.select(*[f"`{n}`" for n in odd]).distinct().collect()} == {tuple(odd.values())}
    coded = cp.STAGES[-1][1](spark, docs, d)
    assert set(odd) <= set(coded.columns) and coded.count() == docs.count()
