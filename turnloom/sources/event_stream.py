"""Telemetry as one ordered event stream a file (ING-09, ING-11, ING-12, ING-14, ING-16): turns, tool calls, compactions and sub-agent spans.

Items of the orchestrator (user and operator messages, turns, compactions) stand in order of their stamps. A turn is followed by its tool
calls; a call that spawned a session gives way to that session's span, which holds the call. Spans of sessions that no call spawned stand in
front of the first item after their anchor, the orchestrator's latest stamp when the session first appeared. Order is a key of
columns (place, rank, call, session, step, turn, call of the turn), never a state that is carried along, so one sort a file gives it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.operators import packing
from turnloom.shared import written
from turnloom.sources import telemetry as tm

BIG = 1 << 40
FIELDS = ["span_id", "agent_span_id", "name", "call_id", "stamp", "completed", "model", "stop_reason", "error", "failed", "result", "input_tokens", "output_tokens", "cache_read", "cache_write"]
KINDS = {"stamp": "bigint", "completed": "bigint", "failed": "boolean", "input_tokens": "bigint", "output_tokens": "bigint", "cache_read": "bigint", "cache_write": "bigint"}
ORDER = ["place", "rank", "call", "tie", "step", "turn", "sub"]


def own_turns(found: DataFrame) -> DataFrame:
    """ING-06, ING-11: assistant messages without roll-ups, each with its model: orchestrators' in order of stamps, others' in order of the file."""
    model = F.when(F.coalesce(F.trim("model"), F.lit("")) != "", F.col("model")).otherwise(F.raise_error(F.lit("an assistant turn without its model")))
    main = F.col("kind") != tm.SUBAGENT_KIND
    ms = F.coalesce(F.col("timestamp").try_cast("bigint"), F.lit(0))
    rows = found.filter("role = 'assistant'").select(
        "file", "sessionKey", main.alias("is_main"), "ord", "pos", ms.alias("ms"), F.when(main, ms).otherwise(0).alias("sorted_ms"), model.alias("model"), F.col("responseId").alias("response_id"), F.col("stopReason").alias("stop_reason"), "errorMessage",
        tm.tool_calls("content").alias("calls"), F.size(tm.tool_calls("content")).alias("n_tool_calls"), F.col("usage.totalTokens").alias("total"), F.col("usage.input").alias("input"), F.col("usage.output").alias("output"), F.col("usage.cacheRead").alias("cache_read"), F.col("usage.cacheWrite").alias("cache_write"),
    )
    return tm.drop_rollups(rows, ["file", "sessionKey"], ["sorted_ms", "ord", "pos"])


def call_results(found: DataFrame) -> DataFrame:
    """ING-16: file, call_id, result text, is_error and stamp of tool results."""
    at = F.col("timestamp").try_cast("bigint")
    return found.filter("role = 'toolResult' and toolCallId is not null").select("file", F.col("toolCallId").alias("call_id"), tm.content_text("content").alias("result"), F.col("isError").alias("is_error"), F.when(at > 0, at).alias("result_ms"))


def with_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """ING-16: calls (file, call_id, stamp) with result, completed (the result's stamp, else the call's), error (the text of a failed one) and failed."""
    r = calls.join(results, ["file", "call_id"], "left")
    return r.select(*calls.columns, F.coalesce("result", F.lit("")).alias("result"), F.coalesce("result_ms", "stamp").alias("completed"), F.when(F.col("is_error"), F.col("result")).alias("error"), F.col("is_error").alias("failed"))


def spawned(turn_calls: DataFrame, results: DataFrame) -> DataFrame:
    """ING-08: file, child, call_id, label, task: the last orchestrator call whose result names the child session."""
    child = F.get_json_object("result", "$.childSessionKey")
    named = turn_calls.join(results, ["file", "call_id"]).withColumn("child", child).filter("child is not null")
    last = named.groupBy("file", "child").agg(F.max_by(F.struct("call_id", "arguments"), F.struct("place", "call")).alias("s"))
    return last.select("file", "child", "s.call_id", F.get_json_object("s.arguments", "$.label").alias("label"), F.get_json_object("s.arguments", "$.task").alias("task"))


def tool_events(events: DataFrame) -> DataFrame:
    """ING-09: file, session, n, name, started, ended (ms), success, error of the tool starts of sub-agent sessions."""
    own = events.filter(F.col("type").isin("tool.start", "tool.end") & (tm.session_kind("sessionKey") == tm.SUBAGENT_KIND))
    numbered = own.withColumn("n", F.row_number().over(Window.partitionBy("file", "sessionKey").orderBy("ord")).cast("bigint"))
    key = F.struct("file", "sessionKey")
    kind = F.when(F.col("type") == "tool.start", "start").otherwise("end")
    pairs = packing.pair_tools(numbered.select(key.alias("session"), F.col("n").alias("ord"), kind.alias("type"), F.col("toolName").alias("name")))
    ms = lambda c: F.when(F.col(c).try_cast("bigint") > 0, F.col(c).try_cast("bigint"))
    start = numbered.select(key.alias("session"), F.col("n").alias("start_ord"), ms("ts").alias("started"))
    end = numbered.select(key.alias("session"), F.col("n").alias("end_ord"), ms("ts").alias("ended"), ms("durationMs").alias("lasted"), "success", F.nullif("error", F.lit("")).alias("error"))
    r = pairs.join(start, ["session", "start_ord"]).join(end, ["session", "end_ord"], "left")
    return r.select("session.file", F.col("session.sessionKey").alias("session"), F.col("start_ord").alias("n"), F.coalesce("name", F.lit("unknown")).alias("name"), "started", "ended", "lasted", "success", "error")


def operator_items(events: DataFrame, users: DataFrame) -> DataFrame:
    """ING-13: file, ord, ms of inbound messages that no user turn carries. users: file, ord, pos, text, ms."""
    at = F.coalesce(F.col("timestamp").try_cast("bigint"), F.lit(0))
    sends = events.filter("type = 'message.in'").select("file", "ord", tm.content_text("content").alias("text"), at.alias("ts"))
    per = Window.partitionBy("file").orderBy("ord")
    numbered = sends.withColumn("n", F.row_number().over(per).cast("bigint"))
    turns = users.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("ms", "ord", "pos")).cast("bigint"))
    left = numbered.select(F.col("file").alias("transcript_id"), "text", F.col("n").alias("ord"), "ts")
    right = turns.select(F.col("file").alias("transcript_id"), "text", F.col("n").alias("ord"), F.when(F.col("ms") > 0, F.col("ms")).alias("ts"))
    matched = packing.match_sends(left, right).filter("user_ord is null").select(F.col("transcript_id").alias("file"), F.col("ord").alias("n"))
    return numbered.join(matched, ["file", "n"]).select("file", "ord", F.col("ts").alias("ms"))


def sessions(events: DataFrame) -> DataFrame:
    """ING-09, ING-10: file, session, first, prompt and anchor of sub-agent sessions."""
    kind = tm.session_kind("sessionKey")
    ours = F.col("type").startswith("agent.") | F.col("type").isin("tool.start", "tool.end")
    stamps = F.array_max(F.transform(F.filter("messages", lambda m: m["role"] == "assistant"), lambda m: m["timestamp"].try_cast("bigint")))
    rows = events.filter(ours).select("file", "ord", F.when(kind == tm.SUBAGENT_KIND, F.col("sessionKey")).alias("session"), kind.isin(*tm.ORCHESTRATOR_KINDS).alias("is_main"), stamps.alias("stamp"), F.when(F.col("type") == "agent.start", F.nullif("prompt", F.lit(""))).alias("prompt"))
    own = rows.filter("session is not null").groupBy("file", "session").agg(F.min("ord").alias("first"), F.min_by("prompt", F.when(F.col("prompt").isNotNull(), F.col("ord"))).alias("prompt"))
    anchors = tm.file_anchor(rows.select("file", "ord", "session", "is_main", "stamp")).filter("session is not null")
    return own.join(anchors, ["file", "session"], "left").withColumn("anchor", F.coalesce("anchor", F.lit(0).cast("bigint")))


def _row(kind: str, **fields: Column) -> list[Column]:
    """The columns of an event of one kind; a field that isn't given is NULL."""
    return [F.lit(kind).alias("kind"), *[fields.get(f, F.lit(None)).cast(KINDS.get(f, "string")).alias(f) for f in FIELDS]]


def _model(stamp: Column, span: Column | None = None) -> list[Column]:
    told = {"span_id": span} if span is not None else {}
    counts = {n: F.coalesce(F.col(c), F.lit(0)) for n, c in (("input_tokens", "input"), ("output_tokens", "output"), ("cache_read", "cache_read"), ("cache_write", "cache_write"))}
    error = F.when(tm.stop_reason("stop_reason") == "unknown", F.col("errorMessage"))
    return _row("model", stamp=stamp, completed=stamp, model=F.col("model"), stop_reason=tm.stop_reason("stop_reason"), error=error, **counts, **told)


def event_stream(events: DataFrame) -> DataFrame:
    """ING-12, ING-14: file, ev, kind (model, tool, compaction, span_begin, span_end) and FIELDS; stamps in milliseconds."""
    found = written(tm.messages(events), "messages")
    results = call_results(found)
    turns = written(own_turns(found), "turns")
    main = found.filter(F.col("kind") != tm.SUBAGENT_KIND).withColumn("ms", F.coalesce(F.col("timestamp").try_cast("bigint"), F.lit(0)))
    users = tm.without_twins(main.filter("role = 'user'").withColumn("text", tm.content_text("content")))
    # the orchestrator's items in order, each with the last valid stamp
    keys = ["file", "ord", "pos", "ms"]
    none = F.lit(-1).alias("pos")
    items = (
        users.select(*keys, F.lit(0).alias("item_rank"))
        .unionByName(operator_items(events, users.select("file", "ord", "pos", "text", "ms")).select("file", "ord", none, "ms", F.lit(1).alias("item_rank")))
        .unionByName(turns.filter("is_main").select(*keys, F.lit(2).alias("item_rank")))
        .unionByName(main.filter("role = 'compactionSummary'").select(*keys, F.lit(3).alias("item_rank")))
    )
    per = Window.partitionBy("file").orderBy("ms", "item_rank", "ord", "pos")
    valid = F.last(F.when(F.col("ms") > 0, F.col("ms")), ignorenulls=True).over(per.rowsBetween(Window.unboundedPreceding, 0))
    placed = written(items.withColumn("place", F.row_number().over(per) - 1).withColumn("stamp", F.coalesce(valid, F.lit(0))), "items")
    top = [F.lit(1).alias("rank"), F.lit(0).alias("call"), F.lit(0).alias("tie"), F.lit(0).alias("step"), F.lit(0).alias("turn"), F.lit(0).alias("sub")]
    at = placed.select("file", "ord", "pos", "item_rank", "place", "stamp")
    main_turns = turns.filter("is_main").join(at.filter("item_rank = 2").drop("item_rank"), ["file", "ord", "pos"])
    models = main_turns.select("file", "place", *top, *_model(F.col("stamp")))
    compactions = main.filter("role = 'compactionSummary'").join(at.filter("item_rank = 3").drop("item_rank"), ["file", "ord", "pos"]).select("file", "place", *top, *_row("compaction", stamp=F.col("stamp"), input_tokens=F.col("tokensBefore")))
    each = main_turns.select("file", "place", "stamp", F.posexplode("calls").alias("call", "c"))
    calls = with_results(each.select("file", "place", "stamp", (F.col("call") + 1).alias("call"), F.coalesce("c.id", F.lit("")).alias("call_id"), F.coalesce("c.name", F.lit("unknown")).alias("name"), F.col("c.arguments").alias("arguments")), results)
    # sub-agent sessions: by the call that spawned them (the first session to claim it), else by anchor
    links = spawned(calls.select("file", "place", "call", "call_id", "arguments"), results.select("file", "call_id", "result"))
    subs = sessions(events).join(links.withColumnRenamed("child", "session"), ["file", "session"], "left")
    claim = F.row_number().over(Window.partitionBy("file", "call_id").orderBy("first"))
    subs = subs.withColumn("call_id", F.when(claim == 1, F.col("call_id"))).withColumn("tie", F.row_number().over(Window.partitionBy("file").orderBy("anchor", "first")))
    spots = calls.groupBy("file", "call_id").agg(F.min_by(F.struct("place", "call", "stamp", "name", "result", "completed", "error", "failed"), F.struct("place", "call")).alias("spot"))
    linked = subs.filter("call_id is not null").join(spots, ["file", "call_id"])
    loose = subs.filter("call_id is null").select("*", F.lit(1).alias("_sub"))
    ticks = placed.select("file", F.col("ms").alias("anchor"), F.lit(0).alias("_sub"))
    seen = F.sum(1 - F.col("_sub")).over(Window.partitionBy("file").orderBy("anchor", "_sub").rowsBetween(Window.unboundedPreceding, 0))
    loose = loose.unionByName(ticks, allowMissingColumns=True).withColumn("place", F.coalesce(seen, F.lit(0))).filter("_sub = 1").drop("_sub")
    ends = placed.groupBy("file").agg(F.max_by("stamp", "place").alias("_last"))
    loose = loose.join(placed.select("file", "place", F.col("stamp").alias("_at")), ["file", "place"], "left").join(ends, "file", "left")
    start = F.when(F.col("anchor") > 0, F.col("anchor")).otherwise(F.coalesce("_at", "_last", F.lit(0)))
    spans = loose.select("file", "session", "prompt", "label", "task", F.col("place"), F.lit(0).alias("rank"), F.lit(0).alias("call"), "tie", start.alias("start"), F.lit(None).cast(linked.schema["spot"].dataType).alias("spot"), F.lit(None).cast("string").alias("call_id")).unionByName(
        linked.select("file", "session", "prompt", "label", "task", "spot.place", F.lit(1).alias("rank"), "spot.call", "tie", F.col("spot.stamp").alias("start"), "spot", "call_id")
    )
    spans = written(spans, "spans")
    lead = ["file", "place", "rank", "call", "tie"]
    within = lambda step, turn=0, sub=0: [F.lit(step).alias("step"), (turn if isinstance(turn, Column) else F.lit(turn)).cast("int").alias("turn"), (sub if isinstance(sub, Column) else F.lit(sub)).cast("int").alias("sub")]
    me, my_start = F.col("session"), F.col("start")
    name = F.coalesce(F.nullif("label", F.lit("")), tm.task_line("prompt"), F.lit("subagent"))
    begins = spans.select(*lead, *within(0), *_row("span_begin", span_id=me, name=name, stamp=my_start))
    folds = spans.filter("call_id is not null").select(*lead, *within(1), *_row("tool", span_id=me, agent_span_id=me, name=F.col("spot.name"), call_id=F.col("call_id"), stamp=my_start, completed=F.col("spot.completed"), result=F.col("spot.result"), error=F.col("spot.error"), failed=F.col("spot.failed")))
    place_of = spans.select(*lead, "session", "start")
    sub_turns = turns.filter("not is_main").withColumn("turn_no", F.row_number().over(Window.partitionBy("file", "sessionKey").orderBy("ord", "pos"))).withColumnRenamed("sessionKey", "session")
    sub_turns = sub_turns.join(place_of, ["file", "session"]).withColumn("stamp", F.when(F.col("ms") > 0, F.col("ms")).otherwise(my_start))
    sub_models = sub_turns.select(*lead, *within(2, F.col("turn_no")), *_model(F.col("stamp"), me))
    each = sub_turns.select(*lead, "session", "turn_no", "stamp", F.posexplode("calls").alias("k", "c")).select(*lead, "session", "turn_no", "stamp", "k", F.coalesce("c.id", F.lit("")).alias("call_id"), F.coalesce("c.name", F.lit("unknown")).alias("name"))
    told = lambda: {"span_id": me, "name": F.col("name"), "call_id": F.col("call_id"), "stamp": F.col("stamp"), "completed": F.col("completed"), "error": F.col("error"), "failed": F.col("failed")}
    sub_calls = with_results(each, results).select(*lead, *within(2, F.col("turn_no"), F.col("k") + 1), *_row("tool", result=F.col("result"), **told()))
    # tool events stand in only for sessions without turns: the same calls may be recorded both ways
    bare = tool_events(events).join(sub_turns.select("file", "session").distinct(), ["file", "session"], "left_anti").join(place_of, ["file", "session"])
    bare = bare.withColumn("k", F.row_number().over(Window.partitionBy("file", "session").orderBy("n"))).withColumn("stamp", F.coalesce("started", "start")).withColumn("completed", F.coalesce("ended", F.col("stamp") + F.col("lasted"), "stamp"))
    bare = bare.withColumn("call_id", F.concat(me, F.lit(":tool:"), (F.col("k") - 1).cast("string"))).withColumn("failed", ~F.col("success"))
    tools = bare.select(*lead, *within(2, F.col("k")), *_row("tool", result=F.lit(""), **told()))
    inside = begins.unionByName(folds).unionByName(sub_models).unionByName(sub_calls).unionByName(tools)
    over = inside.groupBy(*lead, "span_id").agg(F.max(F.greatest("stamp", "completed")).alias("_end")).select(*lead, *within(3), *_row("span_end", span_id=F.col("span_id"), stamp=F.col("_end")))
    plain = calls.join(linked.select("file", "spot.place", "spot.call").distinct(), ["file", "place", "call"], "left_anti")
    own_tools = plain.select("file", "place", F.lit(1).alias("rank"), "call", *top[2:], *_row("tool", name=F.col("name"), call_id=F.col("call_id"), stamp=F.col("stamp"), completed=F.col("completed"), result=F.col("result"), error=F.col("error"), failed=F.col("failed")))
    all_rows = models.unionByName(compactions).unionByName(own_tools).unionByName(inside).unionByName(over)
    return all_rows.withColumn("ev", F.row_number().over(Window.partitionBy("file").orderBy(*ORDER)) - 1).drop(*ORDER)
