"""A cross-section of the registered queries against their SQL on DuckDB, and invariance to the number of partitions."""

import math
import os

import pytest

from turnloom.plans.registry import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
SOME = ["tl_lane_spend", "tl_flushes", "span_asof_turns", "phase_dense", "phase_delegated", "vote_decided", "vote_consensus", "agree_by_transcript", "label_stats", "conv_batches", "tag_broadcast", "branch_survivors"]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver tables aren't here")


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)) or hasattr(v, "as_integer_ratio"):
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for name in os.listdir(DATA):
        c.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*names).collect()), key=repr)
    r = duck.sql(ORACLES[name])
    assert sorted(r.columns) == names
    at = [r.columns.index(n) for n in names]
    assert got == sorted((tuple(plain(row[i]) for i in at) for row in r.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["tl_token_views", "phase_runs", "vote_units"])
def test_partitions_do_not_matter(spark, name):
    seen = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(map(repr, QUERIES[name](spark, DATA).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1]


def test_every_query_has_a_name_of_its_own_and_most_have_sql():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) - len(ORACLES) <= 5


def test_flattened_documents_are_whole(spark, duck):
    got = {r["doc_id"]: r["flattened"] for r in QUERIES["doc_flat"](spark, DATA).collect()}
    assert got == dict(duck.sql(ORACLES["doc_flat"]).fetchall())
    whole = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    assert max(map(len, got.values())) > 500 and all("".join(got[k].split()) == "".join((t or "").split()) for k, t in whole.items())
