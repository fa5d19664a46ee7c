"""The event stream on a file worked out by hand: ties, missing stamps and models, two claims on one call, odd lines."""

import json

import pytest

from turnloom.operators import axis, frames, packing, report, tags
from turnloom.functions import text as tx
from turnloom.sources import event_stream as es
from turnloom.sources import results as rs
from turnloom.sources import telemetry as tm


def said(i, ms, calls=(), model="m", **more):
    return {"role": "assistant", "responseId": i, "timestamp": ms, "model": model, "stopReason": "stop", "usage": {"input": 1, "output": 2}, "content": [{"type": "toolCall", "id": c, "name": "sessions_spawn", "arguments": {"label": f"go {c}"}} for c in calls], **more}


def answer(c, ms, text, error=None):
    return {"role": "toolResult", "toolCallId": c, "timestamp": ms, "content": text, "isError": error}


def read(spark, lines):
    rows = [("f", (0, n), x if isinstance(x, str) else json.dumps(x)) for n, x in enumerate(lines)]
    return tm.parsed_lines(spark.createDataFrame(rows, "file string, ord struct<start:bigint,within:bigint>, value string"))


def test_stream_by_hand(spark):
    child = '{"childSessionKey":"agent:x:subagent:%s"}'
    main = "agent:x:main:s1"
    lines = [
        {"type": "agent.start", "sessionKey": main, "messages": [said("r1", 100, ["c1"])]},
        "not json", "[1]", "",
        {"type": "tool.start", "sessionKey": "agent:x:subagent:lost", "toolName": "t"},
        {"type": "agent.end", "sessionKey": "agent:x:subagent:kid", "messages": [said("k1", None)]},
        {"type": "agent.end", "sessionKey": "agent:x:subagent:twin", "messages": [said("w1", 150)]},
        {"type": "agent.end", "sessionKey": main, "messages": [said("r1", 100, ["c1"]), answer("c1", 130, child % "kid"), {"role": "compactionSummary", "timestamp": 200, "tokensBefore": 9}, said("r2", 200, ["c2"]), answer("c2", None, "it broke", True)]},
        {"type": "tool.end", "sessionKey": "agent:x:subagent:lost", "toolName": "t", "durationMs": 5, "success": False, "error": "no"},
        {"type": "message.in", "content": "aside", "timestamp": 50},
    ]
    got = [(r["kind"], r["span_id"] and r["span_id"][-4:], r["name"], r["stamp"], r["completed"], r["failed"], r["error"]) for r in es.event_stream(read(spark, lines)).orderBy("ev").collect()]
    assert got == [
        ("model", None, None, 100, 100, None, None),
        ("span_begin", ":kid", "go c1", 100, None, None, None),
        ("tool", ":kid", "sessions_spawn", 100, 130, None, None),
        ("model", ":kid", None, 100, 100, None, None),
        ("span_end", ":kid", None, 130, None, None, None),
        ("span_begin", "lost", "subagent", 100, None, None, None),
        ("tool", "lost", "t", 100, 105, True, "no"),
        ("span_end", "lost", None, 105, None, None, None),
        ("span_begin", "twin", "subagent", 100, None, None, None),
        ("model", "twin", None, 150, 150, None, None),
        ("span_end", "twin", None, 150, None, None, None),
        ("model", None, None, 200, 200, None, None),
        ("tool", None, "sessions_spawn", 200, 200, True, "it broke"),
        ("compaction", None, None, 200, None, None, None),
    ]


def test_bad_telemetry_is_an_error(spark):
    with pytest.raises(Exception, match="without its model"):
        es.event_stream(read(spark, [{"type": "agent.end", "sessionKey": "agent:x:main:s", "messages": [said("r", 1, model=None)]}])).collect()
    with pytest.raises(Exception, match="unknown session kind"):
        es.event_stream(read(spark, [{"type": "agent.end", "sessionKey": "agent:x:odd:s", "messages": [said("r", 1)]}])).collect()
    assert es.event_stream(read(spark, ["x"])).count() == 0


def test_packing_equals_first_fit():
    import random

    rng = random.Random(4)
    for _ in range(50):
        starts = sorted(rng.randrange(40) for _ in range(rng.randrange(30)))
        ends = [a + rng.randrange(12) for a in starts]
        rows, want = [], []
        for a, b in zip(starts, ends):
            i = next((i for i, e in enumerate(rows) if a > e), len(rows))
            rows[i : i + 1] = [b]
            want.append(i)
        assert packing.first_rows(starts, ends) == want


def test_matching_and_pairing_equal_their_folds(spark):
    import random

    rng = random.Random(7)
    sends = [("t", rng.choice("ab"), i, rng.randrange(60)) for i in range(40)] + [("t", "", 90, 3), ("t", None, 91, 3)]
    users = [("t", rng.choice("ab"), 100 + i, rng.randrange(70) if rng.random() < 0.7 else None) for i in range(30)]
    want = {}
    for text in "ab":
        dated = sorted((s, o) for _, x, o, s in users if x == text and s is not None)
        undated = sorted(o for _, x, o, s in users if x == text and s is None)
        for s, o in sorted((s, o) for _, x, o, s in sends if x == text):
            hit = next((d for d in dated if d[0] >= s), None)
            if hit:
                dated.remove(hit)
            want[o] = hit[1] if hit else undated.pop(0) if undated else None
    schema = "transcript_id string, text string, ord bigint, ts bigint"
    got = {r["ord"]: r["user_ord"] for r in packing.match_sends(spark.createDataFrame(sends, schema), spark.createDataFrame(users, schema)).collect()}
    assert got == want | {90: None, 91: None}
    events = [("s", i, rng.choice(["start", "end"]), rng.choice([None, "x", "y"])) for i in range(120)]
    open_, pairs = {}, {}
    for _, i, kind, name in events:
        if kind == "start":
            open_.setdefault(name, []).append(i)
            pairs[i] = None
        elif open_.get(name):
            pairs[open_[name].pop()] = i
    got = packing.pair_tools(spark.createDataFrame(events, "session string, ord bigint, type string, name string"))
    assert {r["start_ord"]: r["end_ord"] for r in got.collect()} == pairs


def test_deep_trees_are_walked_or_refused_never_cut(spark):
    spans = spark.createDataFrame([("t", f"s{i}", f"s{i - 1}" if i else None) for i in range(90)], "transcript_id string, span_id string, parent_id string")
    assert axis.lineage(spans).filter("span_id = 's89'").count() == 90
    with pytest.raises(Exception, match="RECURSION_LEVEL_LIMIT"):
        axis.lineage(spans, 20).count()


def test_a_capture_over_several_part_files_of_a_bundle_is_whole(spark, tmp_path):
    line = lambda i: f'{{"type":"agent.end","sessionKey":"agent:x:main:s","messages":[{{"role":"assistant","responseId":"r{i}","timestamp":"{1000 + i}","model":"m{i // 30}","usage":{{"input":1,"output":{i}}},"content":"a\\tb"}}]}}'
    made = [(f"u{k}.jsonl", (0, i), line(i)) for k in range(2) for i in range(50)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tm.write_bundles(spark.createDataFrame(made, "file string, ord struct<start:bigint,within:bigint>, value string").repartition(7), str(tmp_path / "raw"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    events = tm.read_bundles(spark, str(tmp_path / "raw"))
    assert sum(f.name.startswith("part-") for f in (tmp_path / "raw").iterdir()) > 2
    assert [r["r"] for r in events.filter("file = 'u1.jsonl'").orderBy("ord").selectExpr("messages[0].responseId as r").collect()] == [f"r{i}" for i in range(50)]
    assert {(r["task_name"], r["n_turns"], r["total_tokens"], r["model"]) for r in tm.transcripts(events).collect()} == {(f"u{k}", 50, 50 + sum(range(50)), "m0") for k in range(2)}


def test_trees_of_more_rows_than_a_recursive_query_may_have(spark):
    spans = spark.range(40).selectExpr("concat('t', id) as transcript_id").selectExpr("*", "explode(array('r', 'w', 'x')) as span_id").selectExpr("*", "case span_id when 'w' then 'r' when 'x' then 'w' end as parent_id", "'agent' as type", "false as utility")
    events = spans.filter("span_id = 'x'").selectExpr("transcript_id", "1 as ev", "'model' as kind", "span_id")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "50")
    try:
        assert axis.lineage(spans).count() == 240
        assert {(r["main_id"], r["error"]) for r in axis.main_span(spans, events).collect()} == {("x", None)}
        turns = events.selectExpr("transcript_id", "span_id", "'auditor' as role")
        assert axis.auditor_span(spans, turns).filter("main_id = 'x'").count() == 40
        assert axis.subagent_spans(spans, axis.main_span(spans, events)).count() == 0 and axis.lanes(events, spans).filter("is_main").count() == 40
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_pages_cells_and_tags(spark):
    rows = spark.range(25).selectExpr("id", "cast(id as string) as name")
    pages = list(rs.html_pages(rows, "a<b", 10))
    assert len(pages) == 3 and "next" in pages[0] and "next" not in pages[2] and "a&lt;b" in pages[0]
    assert sum(p.count("<tr>") - 1 for p in pages) == 25 and len(list(rs.html_pages(rows.limit(0), "x"))) == 1
    with pytest.raises(ValueError, match="more than 10"):
        rs.html_index(rows, "x", 10)
    cell = spark.range(1).select(report.rate_cell(tx.F.lit(1), tx.F.lit(4), tx.F.lit(0.0), tx.F.lit(0.5), "turns", "none").alias("c")).first()["c"]
    assert cell["text"] == "25% [0%–50%] 1/4 turns" and cell["background"].startswith("rgb(")
    n = spark.createDataFrame([("t", 2), ("u", 1)], "transcript_id string, n_turns bigint")
    layer = spark.createDataFrame([(0, "a"), (1, "b")], "turn bigint, fam string")
    assert {tuple(r) for r in tags.wide([layer], n, cut=True).collect()} == {("t", 0, "a"), ("t", 1, "b"), ("u", 0, "a")}
    assert tags.wide([layer], n).count() == 4
    left = spark.createDataFrame([("t", 5, "a"), ("t", 1, "b")], "k string, o int, x string")
    right = spark.createDataFrame([("t", 3, "c")], "k string, o int, y string")
    assert {tuple(r) for r in frames.by_position(left, right, ["k"], "o").select("k", "position", "x", "y").collect()} == {("t", 0, "b", "c"), ("t", 1, "a", None)}
