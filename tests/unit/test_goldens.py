"""Operators on small inputs with results worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from turnloom.functions import text as tx
from turnloom.operators import axis, branches, frames, judging, packing, phases, reliability as rel, report, status, tags, threads, tokens, voting


def rows(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


def units(spark, *labels):
    return spark.createDataFrame([("t", i, str(k), x) for i, u in enumerate(labels) for k, x in enumerate(u)], "transcript_id string, unit int, model string, label string")


@pytest.mark.parametrize("votes,ac1,alpha,percent", [(["aa", "bb"], 1.0, 1.0, 1.0), (["aab"] * 9, -0.2, -0.4444, 1 / 3), (["aa", "aa"], None, None, 1.0), (["a"], None, None, None)])
def test_agreement(spark, votes, ac1, alpha, percent):
    got = rel.agreement(units(spark, *votes), ["unit"]).collect()
    if percent is None:
        assert tuple(got[0]) == (0, None, None, None)
        return
    near = lambda x, y: x is None if y is None else math.isclose(x, y, abs_tol=5e-5)
    assert near(got[0]["ac1"], ac1) and near(got[0]["alpha"], alpha) and near(got[0]["percent"], percent)


def test_units_are_scoped_by_transcript(spark):
    v = spark.createDataFrame([("a", 5, "x"), ("a", 5, "x"), ("b", 5, "y"), ("b", 5, "y")], "transcript_id string, unit int, label string")
    assert rel.agreement(v, ["transcript_id", "unit"]).first()["percent"] == 1.0


def test_wilson(spark):
    low, high = rel.wilson(F.col("k"), F.col("n"))
    got = spark.createDataFrame([(50, 100), (0, 5), (0, 0)], "k int, n int").select(low.alias("a"), high.alias("b")).collect()
    assert [round(x, 4) for x in got[0]] == [0.4038, 0.5962]
    assert got[1]["a"] == 0 and abs(got[1]["b"] - 0.4345) < 5e-4 and got[2]["a"] is None


def test_flags(spark):
    s = [("k_roll", x) for x in (0.67, 0.98, 0.9, 0.8, 0.95)] + [("alpha", x) for x in (0.5, 0.7, 0.9, 0.66, 0.8)] + [("unjudged", x) for x in (0.0, 0.125, 0.25, 1.0)] + [("spot_check", 0.0), ("spot_check", 0.1), ("relabel", 0.2)]
    got = {(r["metric"], r["value"]): r["level"] for r in rel.flags(spark.createDataFrame(s, "metric string, value double")).collect()}
    assert got == {("k_roll", 0.67): "amber", ("k_roll", 0.98): "amber", ("alpha", 0.5): "red", ("alpha", 0.7): "amber", ("alpha", 0.66): "amber", ("unjudged", 0.125): "amber", ("unjudged", 0.25): "red", ("unjudged", 1.0): "red", ("spot_check", 0.1): "red", ("relabel", 0.2): "amber"}


def test_clock_and_positions(spark):
    t = spark.createDataFrame([("c", 0, 0.0, None), ("c", 1, 100.0, None), ("c", 2, 150.0, 170.0), ("m", 0, 0.0, None), ("m", 1, 100.0, None), ("m", 2, 150.0, None), ("bad", 0, 5.0, None), ("bad", 1, 4.0, None), ("z", 0, 0.0, None), ("z", 1, 0.0, None), ("z", 2, 100.0, 120.0)], "transcript_id string, turn bigint, start double, completed double")
    cells = axis.clock(t)
    last = {r["transcript_id"]: r["cell_end"] for r in cells.filter("turn = 2").collect()}
    assert last == {"c": 170.0, "m": 225.0, "z": 120.0}
    stamps = spark.createDataFrame([("c", x) for x in (-10.0, 0.0, 50.0, 100.0, 125.0, 150.0, 999.0)] + [("z", 0.0), ("z", 50.0)], "transcript_id string, at double")
    got = {(r["transcript_id"], r["at"]): r["position"] for r in axis.position(stamps, cells).collect()}
    assert [got["c", x] for x in (-10.0, 0.0, 50.0, 100.0, 125.0, 150.0, 999.0)] == [-0.5, -0.5, 0.0, 0.5, 1.0, 1.5, 2.5]
    assert got["z", 50.0] == 1.0
    spans = spark.createDataFrame([("c", "s", 9, 20.0, 110.0, 9), ("c", "open", 1, 20.0, None, None)], "transcript_id string, span_id string, spawn_turn bigint, started double, ended double, order_end_turn bigint")
    assert rows(axis.place_spans(spans, cells), "span_id", "anchor_turn", "end_turn", "turn_source") == [("open", 1, 1, "event_order"), ("s", 0, 1, "timestamp")]


TURN = "transcript_id string, ev bigint, lane string, turn bigint, lane_turn bigint, input_tokens bigint, output_tokens bigint, cache_read bigint, cache_write bigint"


def test_token_views(spark):
    t = spark.createDataFrame([("t", 0, "main", 0, 0, 1000, 100, 0, 1000), ("t", 1, "main", 1, 1, 1000, 30, 1000, 250), ("t", 2, None, None, None, 5, 5, 0, 0), ("t", 3, "main", 2, 2, None, 1, 0, 0), ("t", 4, "main", 3, 3, 0, 0, 0, 0)], TURN)
    got = {r["ev"]: r for r in tokens.token_views(t).collect()}
    assert (got[1]["context"], got[1]["new_work"], got[1]["billable"], got[1]["turn_total"]) == (2250, 1280, 1280, 2280)
    assert got[2]["new_work"] == 10 and got[3]["context"] is None and got[4]["new_work"] is None


def test_drops_and_flushes(spark):
    ctx = [1000, 950, 300, 280, 900, 400, 950, 900, 350, 300]
    v = spark.createDataFrame([("t", "main", i, i, i, c) for i, c in enumerate(ctx)], "transcript_id string, lane string, ev bigint, turn bigint, lane_turn bigint, context bigint")
    rec = spark.createDataFrame([("t", "main", 80, 8, 8, 900, 0)], "transcript_id string, lane string, ev bigint, turn bigint, lane_turn bigint, tokens_before bigint, tokens_after bigint")
    got = rows(tokens.flushes(rec, v), "turn", "source", "tokens_before", "tokens_after", "tokens_after_inferred")
    assert got == [(2, "synthesized", 950, 300, False), (8, "recorded", 900, 350, True)]


def judged(spark, data):
    return spark.createDataFrame([("t", i, x, b, c) for i, x, b, c in data], "transcript_id string, turn bigint, label string, basis string, conf100 bigint")


@pytest.mark.parametrize("starts,gaps,n,want", [([0, 6], [4], 8, [0, 0, 0, 0, None, None, 1, 1]), ([2], [], 4, [0, 0, 0, 0]), ([2], [0], 4, [None, None, 0, 0]), ([], [1], 3, [None] * 3), ([0], [2], 3, [0, 0, None])])
def test_dense(spark, starts, gaps, n, want):
    ax = spark.createDataFrame([("t", i) for i in range(n)], "transcript_id string, turn bigint")
    ph = spark.createDataFrame([("t", i, s) for i, s in enumerate(starts)], "transcript_id string, phase_index bigint, turn_start bigint")
    j = judged(spark, [(g, None, "refusal", None) for g in gaps])
    assert [r[1] for r in rows(phases.dense(ax, ph, j), "turn", "phase_index")] == want


def test_stitch_and_wedge(spark):
    p = phases.stitch(judged(spark, [(0, "a", "judged", 80), (1, "a", "filled", 30), (2, None, "refusal", None), (3, "a", "judged", 50), (4, "b", "judged", 90), (5, "a", "judged", None)]))
    assert rows(p, "phase_index", "phase", "turn_start", "turn_end", "confidence", "min_confidence") == [(0, "a", 0, 1, 0.55, 0.3), (1, "a", 3, 3, 0.5, 0.5), (2, "b", 4, 4, 0.9, 0.9), (3, "a", 5, 5, 0.0, 0.0)]
    assert rows(phases.wedges(p), "phase_index") == [(2,)]


def test_spend_of_gap_phase_is_zero_and_of_an_unseen_one_null(spark):
    ph = spark.createDataFrame([("t", 0), ("t", 1), ("t", 2)], "transcript_id string, phase_index bigint")
    per = spark.createDataFrame([("t", 0, 0), ("t", 1, 1), ("t", 9, 2)], "transcript_id string, turn bigint, phase_index bigint")
    v = spark.createDataFrame([("t", 0, 10), ("t", 1, None)], "transcript_id string, turn bigint, new_work bigint")
    assert rows(phases.phase_spend(ph, per, v), "phase_index", "new_work_tokens") == [(0, 10), (1, 0), (2, None)]


def test_votes(spark):
    b = spark.createDataFrame([("t", 1, "a", 5, 0), ("t", 1, "b", 9, 1), ("t", 2, "a", None, 0), ("t", 2, "b", None, 1), ("t", 3, "c", 7, 0), ("t", 3, "c", 9, 1), ("t", 3, "d", 10, 2)], "transcript_id string, unit bigint, label string, conf10 bigint, ord bigint")
    assert rows(voting.vote(b, ["transcript_id", "unit"]), "unit", "label", "agreement", "confidence") == [(1, "b", 0.5, 0.9), (2, "a", 0.5, None), (3, "c", 0.667, 0.8)]


def test_seeded_draws(spark):
    got = {r["id"]: round(r["draw"], 3) for r in voting.spot_draw(spark.createDataFrame([("O",), ("F",)], "id string"), "id").collect()}
    assert got == {"O": 0.003, "F": 0.062}
    assert [voting.sample_size(*x) for x in ((100, None), (10, None), (10, 0.5), (4, 1.0))] == [5, 3, 5, 4]


def test_packing_and_matching(spark):
    s = spark.createDataFrame([("t", "x", "a", 0.0, 5.0), ("t", "x", "b", 5.0, 6.0), ("t", "x", "c", 5.5, 7.0), ("t", "x", "d", 6.5, 8.0)], "transcript_id string, label string, span_id string, x0 double, x1 double")
    assert rows(packing.pack(s), "span_id", "sub_row") == [("a", 0), ("b", 1), ("c", 0), ("d", 1)]
    sends = spark.createDataFrame([("t", "hi", 0, 10), ("t", "hi", 1, 20), ("t", "hi", 2, 99)], "transcript_id string, text string, ord bigint, ts bigint")
    users = spark.createDataFrame([("t", "hi", 7, 15), ("t", "hi", 8, None)], "transcript_id string, text string, ord bigint, ts bigint")
    assert rows(packing.match_sends(sends, users), "ord", "user_ord") == [(0, 7), (1, 8), (2, None)]
    e = spark.createDataFrame([("s", i, k, n) for i, (k, n) in enumerate([("start", "a"), ("start", "a"), ("end", "a"), ("end", "b"), ("end", "a"), ("start", "c")])], "session string, ord bigint, type string, name string")
    assert {(r["start_ord"], r["end_ord"]) for r in packing.pair_tools(e).collect()} == {(1, 2), (0, 4), (5, None)}


def test_branches(spark):
    tree = spark.createDataFrame([("t", 0, None, 0), ("t", 1, 0, 1)], "transcript_id string, branch bigint, parent bigint, fork_after bigint")
    path = branches.surviving(tree, spark.createDataFrame([("t", 1, 2)], "transcript_id string, branch bigint, n bigint"))
    assert rows(path, "branch", "upto") == [(0, 1), (1, 2)]
    calls = spark.createDataFrame([("t", 0, 0), ("t", 0, 1), ("t", 1, 0), ("t", 1, 1)], "transcript_id string, branch bigint, branch_turn bigint")
    assert rows(branches.discarded(calls, path), "branch", "branch_turn") == [(0, 1)]
    assert rows(branches.diagram(tree), "branch", "start") == [(0, 0), (1, 1)]


def test_span_trees(spark):
    spans = spark.createDataFrame([("t", "r", None, "agent", False), ("t", "w", "r", "agent", False), ("t", "u", "r", "agent", True), ("t", "x", "w", "tool", False), ("t", "loop", "loop", "span", False)], "transcript_id string, span_id string, parent_id string, type string, utility boolean")
    assert ("x", "r", 2) in rows(axis.lineage(spans), "span_id", "ancestor_id", "depth") and len(rows(axis.lineage(spans))) == 9
    ev = spark.createDataFrame([("t", 0, "r", "model"), ("t", 1, "w", "model"), ("t", 2, "x", "tool"), ("n", 0, None, "tool")], "transcript_id string, ev bigint, span_id string, kind string")
    assert rows(axis.main_span(spans, ev), "transcript_id", "main_id", "error") == [("n", None, "no model turn"), ("t", "r", None)]
    got = {r["ev"]: (r["is_main"], r["lane_id"]) for r in axis.lanes(ev, spans).filter("transcript_id = 't'").collect()}
    assert got == {0: (True, None), 1: (False, "w"), 2: (False, "w")}
    turns = spark.createDataFrame([("t", "r", "auditor"), ("t", "w", "auditor")], "transcript_id string, span_id string, role string")
    assert rows(axis.auditor_span(spans, turns), "main_id", "error") == [("r", None)]


def test_selection(spark):
    runs = spark.createDataFrame([("a", "s", "k", 1, False), ("b", "s", "k", 2, True), ("c", "s", "k", 3, True)], "transcript_id string, sample_id string, task_set string, epoch int, success boolean")
    assert rows(status.select_runs(runs), "epoch") == [(2,)]
    assert rows(status.select_runs(runs.withColumn("success", F.lit(False))), "epoch") == [(1,)]
    with pytest.raises(ValueError, match="there are"):
        status.select_runs(runs, "nope")
    with pytest.raises(ValueError, match=r"\[9\]"):
        status.select_runs(runs, "s", [9])


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(tx.label_key(F.lit("  Fix\tThe  Bug "))) == "fix_the_bug"
    assert one(tx.humanise(F.lit("fix_the_BUG"))) == "Fix the bug"
    assert one(tx.clip(F.lit("short"), 10)) == "short" and one(tx.clip(F.lit("x"), 0)) == ""
    assert one(tx.clip(F.lit("a" * 100), 10)) == "aaaaa [... 90 chars ...] aaaaa"
    assert one(tx.file_stem(F.lit("s3://b/dir/run.v1.eval"))) == "run.v1"
    assert one(tx.threshold(F.lit("0.8")))["share"] == 0.8 and one(tx.threshold(F.lit("5000")))["tokens"] == 5000 and one(tx.threshold(F.lit("true"))) is None
    assert one(tx.elide(F.array(*[F.lit(str(i)) for i in range(10)]), 4)) == ["0", "1", "[... 6 turns elided ...]", "8", "9"]
    m = tx.scramble_map(["a", "b", "ops"], 3)
    assert m["ops"] == "ops" and one(tx.translated(tx.translated(F.lit("a"), m), {v: k for k, v in m.items()})) == "a"
    assert one(tx.viewer_link("http://v/", F.lit("a b?"), F.lit("x y"))) == "http://v/#/transcripts/YSBiPw/x%20y"


def test_tags_and_layers(spark):
    n = spark.createDataFrame([("t", 3), ("u", 2)], "transcript_id string, n_turns bigint")
    a = spark.createDataFrame([("t", 0, "x"), ("t", 0, "y"), ("u", 5, "z")], "transcript_id string, turn bigint, fam string")
    assert [r[2] for r in rows(tags.problems([a], n))] == ["layer 0: doubled", "layer 0: no such turn"]
    b = spark.createDataFrame([(1, "q")], "turn bigint, other string")
    assert rows(tags.wide([b], n), "transcript_id", "turn", "other") == [("t", 1, "q"), ("u", 1, "q")]
    with pytest.raises(ValueError, match="share a name"):
        tags.wide([a, a], n)
    from turnloom import layers

    with pytest.raises(ValueError, match="taken"):
        layers.validate([layers.Layer("phases", frame=a)], ["phases"])
    with pytest.raises(ValueError, match="must be a number"):
        layers.check(layers.Layer("x", frame=a, blocks=[("turn_chart", {"y": "fam"})]), a)
    made = layers.inject([layers.Layer("x", scanner=lambda spec, depth: (spec["n"], depth), scanner_args={"depth": 2})], {"judges": 1}, {"n": 7})
    assert made[0].scanner == (7, 2)
    assert layers.section_order(["token_spend"], [layers.Layer("mine", frame=a)])[0] == "token_spend"


def test_judging(spark):
    assert [m.roll for m in judging.members(["m"], 3)] == [0, 1, 2]
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            judging.members(bad)
    with pytest.raises(ValueError):
        judging.members(["a", "b"], 2)
    assert judging.verify_armed(1) and not judging.verify_armed(2)
    prompts = spark.createDataFrame([("t", 0, 0, 3, "p0"), ("t", 1, 4, 5, "p1")], "transcript_id string, chunk bigint, first bigint, last bigint, prompt string")
    asked = judging.calls(prompts, judging.members(["x/m"]), "sys")
    cache = asked.filter("chunk = 0").select("prompt_key", "model", "roll", F.lit('{"segments":[{"turn_start":0,"turn_end":9,"phase":"a","confidence":0.5,"explanation":""},{"turn_start":1,"turn_end":2,"phase":"zz"}]}').alias("value"), F.lit("ok").alias("status"))
    got = judging.answered(asked, cache, lambda s, p, m, r: (None, "refusal"))
    assert rows(got, "chunk", "status") == [(0, "ok"), (1, "refusal")]
    assert rows(phases.valid_segments(judging.segments(got, ["a"])), "turn_start", "turn_end", "phase") == [(0, 3, "a")]


def test_stored_results(spark, tmp_path):
    from turnloom.sources import results as rs

    raw = spark.createDataFrame([("s", "k", 1, "t", "ag", '{"flushes":[{"turn":1},{"turn":2}]}', None), ("s", "k", 1, "e", "ag", None, "boom")], "transcript_task_id string, transcript_task_set string, transcript_task_repeat bigint, transcript_id string, transcript_agent string, value string, scan_error string")
    assert rows(frames.exploded(raw, "flushes array<struct<turn:bigint>>", "flushes"), "transcript_id", "pos", "turn") == [("t", 0, 1), ("t", 1, 2)]
    where = f"{tmp_path}/scan_id=1"
    rs.write_scan({s: raw for s in rs.STRUCTURAL}, where)
    assert rs.newest_scan(spark, str(tmp_path)).endswith("scan_id=1")
    assert set(rs.read_scan(spark, where, rs.STRUCTURAL)) == set(rs.STRUCTURAL)
    with pytest.raises(ValueError, match="eval_setup"):
        rs.read_scan(spark, where, rs.STRUCTURAL[:3])
    spec = rs.load_spec('{"phases": ["plan", {"label": "ship", "description": "d"}], "phase_ops_label": "ship"}')
    assert rows(rs.vocabulary(spark, spec), "label", "reserved") == [("plan", False), ("ship", True)]
    with pytest.raises(ValueError, match="key"):
        rs.load_spec('{"phases": ["Plan It"]}')
    assert rows(status.errors(raw.withColumn("scanner", F.lit("x"))), "message") == [("boom",)]


def test_telemetry(spark, tmp_path):
    import json

    from turnloom.sources import telemetry as tm

    use = lambda i, o: {"input": i, "output": o, "cacheRead": 0, "cacheWrite": 0, "totalTokens": i + o}
    a1 = {"role": "assistant", "responseId": "r1", "timestamp": 1000, "model": "m", "stopReason": "toolUse", "usage": use(5, 2), "content": json.dumps([{"type": "toolCall", "id": "c1", "name": "sessions_spawn", "arguments": "{}"}])}
    a2 = {"role": "assistant", "responseId": "r2", "timestamp": 3000, "model": "m", "stopReason": "stop", "usage": use(7, 1), "content": "done"}
    roll = {"role": "assistant", "timestamp": 3001, "model": "m", "stopReason": "stop", "usage": {"input": 1, "output": 1, "totalTokens": 8}, "content": "done"}
    res = {"role": "toolResult", "toolCallId": "c1", "toolName": "sessions_spawn", "timestamp": 2000, "content": '{"childSessionKey":"agent:x:subagent:kid"}'}
    lines = [
        {"type": "agent.start", "sessionKey": "agent:x:main:s1", "messages": [a1]},
        {"type": "tool.start", "sessionKey": "agent:x:subagent:kid", "toolName": "t", "ts": 1500},
        {"type": "tool.end", "sessionKey": "agent:x:subagent:kid", "toolName": "t", "ts": 1600, "durationMs": 100, "success": True},
        {"type": "agent.end", "sessionKey": "agent:x:main:s1", "messages": [a1, res, a2, roll]},
    ]
    (tmp_path / "run.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\nnot json\n[1]\n")
    ev = tm.read_lines(spark, str(tmp_path))
    assert ev.count() == 4 and tm.malformed(spark, str(tmp_path)).first()["n"] >= 1
    assert tm.messages(ev).filter("role = 'assistant'").count() == 3
    t = tm.transcripts(ev).first()
    assert (t["transcript_id"], t["n_turns"], t["total_tokens"], t["model"], t["task_name"]) == ("s1-1000", 2, 15, "m", "run")
    m = tm.messages(ev).filter("role = 'toolResult'")
    assert rows(tm.spawn_links(m), "child", "call_id") == [("agent:x:subagent:kid", "c1")]
    assert rows(tm.subagent_tools(ev), "name", "duration_ms") == [("t", 100)]
    assert tm.import_files(spark, str(tmp_path), f"{tmp_path}/out").startswith(f"{tmp_path}/out")
    (tmp_path / "again.jsonl").write_text("\n".join(map(json.dumps, lines)))
    with pytest.raises(ValueError, match="comes from"):
        tm.import_files(spark, str(tmp_path), f"{tmp_path}/out")
    assert tm.route(["a.jsonl"]) == "telemetry"
    with pytest.raises(ValueError):
        tm.route(["a.jsonl", "b.eval"])


def test_streams(spark, tmp_path):
    from turnloom.streaming import telemetry_stream as ts

    turns = spark.createDataFrame([("t", "main", 0, 1000, 100, 0, 1000), ("t", "main", 1, 1000, 30, 1000, 250), ("t", "main", 2, None, 1, 0, 0)], "transcript_id string, lane string, ev bigint, input_tokens bigint, output_tokens bigint, cache_read bigint, cache_write bigint")
    turns.coalesce(1).write.parquet(f"{tmp_path}/in")
    live = ts.running_contexts(spark.readStream.schema(turns.schema).parquet(f"{tmp_path}/in"))
    q = live.writeStream.outputMode("append").format("memory").queryName("live_ctx").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("live_ctx"), "ev", "context", "new_work") == [(0, 2000, 2100), (1, 2250, 1280), (2, None, None)]


def test_threads_and_report(spark):
    m = spark.createDataFrame([("t", "s", 0, "message", "user", "old", False), ("t", "s", 1, "compaction", None, None, False), ("t", "s", 2, "message", "user", "hist", True), ("t", "s", 3, "compaction", None, None, False)], "transcript_id string, span_id string, ev bigint, kind string, role string, text string, in_history boolean")
    assert rows(threads.compaction_texts(m), "ev", "compaction_prompt") == [(1, "old"), (3, None)]
    e = spark.createDataFrame([("t", 1), ("t", 2)], "transcript_id string, turn bigint")
    f = spark.createDataFrame([("t", 3, "p"), ("t", 2, None)], "transcript_id string, turn bigint, compaction_prompt string")
    assert rows(threads.mark_summaries(e, f), "turn", "is_summary") == [(1, False), (2, True)]
    g = report.geometry(spark.createDataFrame([("t", "s", 9.4, 9.4)], "transcript_id string, span_id string, x0 double, x1 double"), spark.createDataFrame([("t", 10)], "transcript_id string, n_turns bigint")).first()
    assert math.isclose(g["x1"] - g["x0"], 0.06, abs_tol=1e-9) and g["x1"] <= 9.5
