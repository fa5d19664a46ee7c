"""Queries from telemetry lines to messages, transcripts and the event stream. The lines are written from the events table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from turnloom.plans.registry import query
from turnloom.shared import written
from turnloom.sources import adapters as ad
from turnloom.sources import event_stream as es
from turnloom.sources import telemetry as tm
from turnloom.sources.adapters import with_sql


def lines(spark, d):
    """Lines (file, ord, value) of one file a transcript: cumulative snapshots of a main session, a spawned one (lane A) and one of tool events (lane B)."""
    t = ad.timeline(spark, d).withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    whole = Window.partitionBy("transcript_id")
    first = F.min(F.when((F.col("lane") == "A") & (F.col("kind") == "model"), F.col("ev"))).over(whole)
    t = t.withColumn("first_a", first).withColumn("spawner", F.max(F.when((F.col("lane") == "main") & (F.col("kind") == "model") & (F.col("ev") < F.col("first_a")), F.col("ev"))).over(whole))
    t = t.withColumn("spawns", F.coalesce(F.col("ev") == F.col("spawner"), F.lit(False))).withColumn("mark", F.when(F.col("lane") == "A", "s").otherwise("c"))
    main = F.concat(F.lit("agent:x:main:"), "transcript_id")
    kid = F.concat(F.lit("agent:x:subagent:"), "transcript_id", F.lit("-"), "lane")
    t = t.withColumn("session", F.when(F.col("lane").isin("A", "B"), kid).otherwise(main))
    k = F.col("k")
    called = F.expr("spawns or k % 4 = 0")
    call = F.expr("""concat(',{"type":"toolCall","id":"', mark, ev, '","name":"', case when spawns then 'sessions_spawn' when lane = 'A' then 'read' else 'grep' end, '","arguments":{"label":"helper ', ev, '","task":"t"}}')""")
    content = F.concat(F.expr("""concat('[{"type":"text","text":"turn ', ev, '"}')"""), F.when(called, call).otherwise(""), F.lit("]"))
    fields = {
        "role": F.lit(None), "idempotencyKey": F.lit(None), "responseId": F.lit(None), "timestamp": F.col("ms"), "model": F.lit(None), "stopReason": F.lit(None), "toolCallId": F.lit(None), "toolName": F.lit(None), "isError": F.lit(None).cast("boolean"),
        "tokensBefore": F.lit(None).cast("bigint"), "usage": F.lit(None).cast("struct<input:bigint,output:bigint,cacheRead:bigint,cacheWrite:bigint,totalTokens:bigint>"), "content": F.lit(None),
    }
    kinds = {"isError": "boolean", "tokensBefore": "bigint", "usage": "struct<input:bigint,output:bigint,cacheRead:bigint,cacheWrite:bigint,totalTokens:bigint>"}
    message = lambda **own: F.struct(*[(own.get(n, c)).cast(kinds.get(n, "string")).alias(n) for n, c in fields.items()])
    total = F.coalesce("input_tokens", F.lit(0)) + F.col("output_tokens") + F.col("cache_read") + F.col("cache_write")
    usage = F.struct(F.col("input_tokens").alias("input"), F.col("output_tokens").alias("output"), F.col("cache_read").alias("cacheRead"), F.col("cache_write").alias("cacheWrite"), total.alias("totalTokens"))
    said = message(role=F.lit("assistant"), responseId=F.when(k % 3 != 2, F.concat(F.lit("r"), "ev")), model=F.col("event_type"), stopReason=F.when(k % 4 == 0, "toolUse").when(k % 4 == 1, "length").otherwise("stop"), usage=usage, content=content)
    answer = F.when(F.col("spawns"), F.concat(F.lit('{"childSessionKey":"agent:x:subagent:'), "transcript_id", F.lit('-A"}'))).otherwise(F.concat(F.lit("out "), "k"))
    result = message(role=F.lit("toolResult"), toolCallId=F.concat("mark", "ev"), timestamp=F.col("ms") + k, isError=F.when(~F.col("spawns") & (k % 8 == 0), True).when(~F.col("spawns") & (k % 8 == 4), False), content=answer)
    cut = message(role=F.lit("compactionSummary"), tokensBefore=k * 100)
    hello = F.concat(F.lit("hello "), "ev")
    asked = F.array(message(role=F.lit("user"), content=hello, timestamp=F.col("ms") - 1), message(role=F.lit("user"), idempotencyKey=F.concat(F.lit("u"), "ev"), content=hello))
    own = (
        F.when((F.col("kind") == "model") & F.col("lane").isin("main", "A"), F.when(called & (F.col("spawns") | (k % 16 != 8)), F.array(said, result)).otherwise(F.array(said)))
        .when((F.col("kind") == "compaction") & (F.col("lane") == "main"), F.array(cut))
        .when(F.col("lane").isNull() & (k == 92), asked)
    )
    recent = Window.partitionBy("transcript_id", "session").orderBy("ev").rowsBetween(-2, 0)
    snap = t.withColumn("own", own).filter("own is not null").withColumn("messages", F.flatten(F.collect_list("own").over(recent)))
    one = lambda at, **own: [F.col("transcript_id").alias("file"), at.alias("n"), F.to_json(F.struct(*[c.alias(n) for n, c in own.items()])).alias("value")]
    at = F.col("ev") * 4
    looks = t.filter("kind = 'model' and lane = 'B'")
    parts = [
        snap.select(*one(at, type=F.lit("agent.end"), sessionKey=F.col("session"), messages=F.col("messages"))),
        t.filter("kind = 'model' and ev = first_a").select(*one(at - 1, type=F.lit("agent.start"), sessionKey=F.col("session"), prompt=F.concat(F.lit("[note]\nDo the task of "), "transcript_id", F.lit("\nand more")))),
        looks.select(*one(at, type=F.lit("tool.start"), sessionKey=F.col("session"), toolName=F.lit("look"), ts=F.when(k % 2 == 0, F.col("ms")))),
        looks.select(*one(at + 1, type=F.lit("tool.end"), sessionKey=F.col("session"), toolName=F.lit("look"), durationMs=k, success=k % 2 == 0, ts=F.when(k % 3 != 0, F.col("ms") + 2 * k))),
        t.filter("lane is null").select(*one(at + 1, type=F.lit("message.in"), content=F.concat(F.when(k == 92, "hello ").otherwise("aside "), "ev"), timestamp=F.col("ms") - 5)),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.select("file", F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n").alias("within")).alias("ord"), "value")


def parsed(spark, d):
    return written(tm.parsed_lines(lines(spark, d)), "lines")


MS = "SELECT *, epoch_us(ts) // 1000 AS ms, max(CASE WHEN lane = 'main' AND kind = 'model' AND ev < first_a THEN ev END) OVER (PARTITION BY transcript_id) AS spawner FROM (SELECT *, min(CASE WHEN lane = 'A' AND kind = 'model' THEN ev END) OVER (PARTITION BY transcript_id) AS first_a, min(CASE WHEN lane = 'B' AND kind = 'model' THEN ev END) OVER (PARTITION BY transcript_id) AS first_b FROM tl)"
ITEM = """SELECT transcript_id, ev, r, ms, k, row_number() OVER (PARTITION BY transcript_id ORDER BY ms, r, ev) - 1 AS place FROM (
    SELECT transcript_id, ev, 0 AS r, ms, k FROM t WHERE lane IS NULL AND k = 92 UNION ALL SELECT transcript_id, ev, 1, ms - 5, k FROM t WHERE lane IS NULL AND k <> 92
    UNION ALL SELECT transcript_id, ev, 2, ms, k FROM t WHERE lane = 'main' AND kind = 'model' UNION ALL SELECT transcript_id, ev, 3, ms, k FROM t WHERE lane = 'main' AND kind = 'compaction')"""
CALL = """SELECT transcript_id, ev, lane, ms AS stamp, CASE WHEN lane = 'A' THEN 's' ELSE 'c' END || ev AS call_id, CASE WHEN ev IS NOT DISTINCT FROM spawner THEN 'sessions_spawn' WHEN lane = 'A' THEN 'read' ELSE 'grep' END AS name,
    ev IS NOT DISTINCT FROM spawner AS spawns, CASE WHEN ev IS NOT DISTINCT FROM spawner OR k % 16 <> 8 THEN ms + k ELSE ms END AS completed,
    CASE WHEN ev IS DISTINCT FROM spawner AND k % 16 <> 8 THEN k % 8 = 0 END AS failed FROM t WHERE kind = 'model' AND lane IN ('main', 'A') AND (k % 4 = 0 OR ev IS NOT DISTINCT FROM spawner)"""
SESSION = """SELECT transcript_id, lane, 'agent:x:subagent:' || transcript_id || '-' || lane AS span_id, min(ev) AS first_, lane = 'A' AND max(spawner) IS NOT NULL AS linked, max(spawner) AS spawner,
    coalesce((SELECT max(m.ms) FROM t m WHERE m.transcript_id = t.transcript_id AND m.lane = 'main' AND m.kind = 'model' AND m.ev < min(t.ev)), 0) AS anchor FROM t WHERE lane IN ('A', 'B') AND kind = 'model' GROUP BY transcript_id, lane"""
SPOT = """SELECT s.*, row_number() OVER (PARTITION BY s.transcript_id ORDER BY anchor, first_) AS tie, CASE WHEN linked THEN i.place ELSE (SELECT count(*) FROM item x WHERE x.transcript_id = s.transcript_id AND x.ms <= s.anchor) END AS place,
    CASE WHEN linked THEN 1 ELSE 0 END AS rank, CASE WHEN linked THEN 1 ELSE 0 END AS call, CASE WHEN linked THEN i.ms WHEN anchor > 0 THEN anchor ELSE coalesce((SELECT min_by(x.ms, x.place) FROM item x WHERE x.transcript_id = s.transcript_id), 0) END AS start
    FROM session s LEFT JOIN item i ON i.transcript_id = s.transcript_id AND i.ev = s.spawner AND i.r = 2 AND s.linked"""
ALL = """SELECT i.transcript_id AS file, i.place, 1 AS rank, 0 AS call, 0 AS tie, 0 AS step, 0 AS turn_, 0 AS sub, 'model' AS kind, NULL AS span_id, NULL AS agent_span_id, NULL AS name, NULL AS call_id, i.ms AS stamp, i.ms AS completed, t.event_type AS model, NULL AS failed, t.output_tokens, t.input_tokens FROM item i JOIN t ON t.transcript_id = i.transcript_id AND t.ev = i.ev WHERE r = 2
  UNION ALL SELECT transcript_id, place, 1, 0, 0, 0, 0, 0, 'compaction', NULL, NULL, NULL, NULL, ms, NULL, NULL, NULL, NULL, k * 100 FROM item WHERE r = 3
  UNION ALL SELECT c.transcript_id, i.place, 1, 1, 0, 0, 0, 0, 'tool', NULL, NULL, c.name, c.call_id, c.stamp, c.completed, NULL, c.failed, NULL, NULL FROM call c JOIN item i ON i.transcript_id = c.transcript_id AND i.ev = c.ev AND i.r = 2 WHERE c.lane = 'main' AND NOT c.spawns
  UNION ALL SELECT * FROM inner_
  UNION ALL SELECT file, place, rank, call, tie, 3, 0, 0, 'span_end', span_id, NULL, NULL, NULL, max(greatest(stamp, completed)), NULL, NULL, NULL, NULL, NULL FROM inner_ GROUP BY file, place, rank, call, tie, span_id"""
INNER = """SELECT transcript_id AS file, place, rank, call, tie, 0 AS step, 0 AS turn_, 0 AS sub, 'span_begin' AS kind, span_id, NULL AS agent_span_id, CASE WHEN linked THEN 'helper ' || spawner WHEN lane = 'A' THEN 'Do the task of ' || transcript_id ELSE 'subagent' END AS name, NULL AS call_id, start AS stamp, NULL AS completed, NULL AS model, NULL AS failed, NULL AS output_tokens, NULL AS input_tokens FROM spot
  UNION ALL SELECT s.transcript_id, place, rank, call, tie, 1, 0, 0, 'tool', span_id, span_id, c.name, c.call_id, start, c.completed, NULL, c.failed, NULL, NULL FROM spot s JOIN call c ON c.transcript_id = s.transcript_id AND c.spawns WHERE s.linked
  UNION ALL SELECT s.transcript_id, place, rank, call, tie, 2, a.n, 0, 'model', span_id, NULL, NULL, NULL, a.ms, a.ms, a.event_type, NULL, a.output_tokens, coalesce(a.input_tokens, 0) FROM spot s JOIN (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY ev) AS n FROM t WHERE lane = 'A' AND kind = 'model') a ON a.transcript_id = s.transcript_id WHERE s.lane = 'A'
  UNION ALL SELECT s.transcript_id, place, rank, call, tie, 2, a.n, 1, 'tool', span_id, NULL, c.name, c.call_id, c.stamp, c.completed, NULL, c.failed, NULL, NULL FROM spot s JOIN (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY ev) AS n FROM t WHERE lane = 'A' AND kind = 'model') a ON a.transcript_id = s.transcript_id JOIN call c ON c.transcript_id = a.transcript_id AND c.ev = a.ev WHERE s.lane = 'A'
  UNION ALL SELECT s.transcript_id, place, rank, call, tie, 2, b.n, 0, 'tool', span_id, NULL, 'look', span_id || ':tool:' || (b.n - 1), CASE WHEN k % 2 = 0 THEN ms ELSE start END, CASE WHEN k % 3 <> 0 THEN ms + 2 * k ELSE CASE WHEN k % 2 = 0 THEN ms ELSE start END + k END, NULL, k % 2 <> 0, NULL, NULL FROM spot s JOIN (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY ev) AS n FROM t WHERE lane = 'B' AND kind = 'model') b ON b.transcript_id = s.transcript_id WHERE s.lane = 'B'"""
STREAM = {"t": MS, "item": ITEM, "call": CALL, "session": SESSION, "spot": SPOT, "inner_": INNER, "every": ALL}


@query(
    "telemetry_stream",
    with_sql(
        "SELECT file, row_number() OVER (PARTITION BY file ORDER BY place, rank, call, tie, step, turn_, sub) - 1 AS ev, kind, span_id, agent_span_id, name, call_id, stamp, completed, model, failed, output_tokens, CASE WHEN kind = 'model' THEN coalesce(input_tokens, 0) ELSE input_tokens END AS input_tokens FROM every",
        STREAM,
    ),
)
def telemetry_stream(spark, d):
    return es.event_stream(parsed(spark, d)).select("file", "ev", "kind", "span_id", "agent_span_id", "name", "call_id", "stamp", "completed", "model", "failed", "output_tokens", "input_tokens")


@query(
    "telemetry_messages",
    with_sql(
        """SELECT transcript_id AS file, 'agent:x:' || CASE WHEN lane = 'A' THEN 'subagent:' || transcript_id || '-A' ELSE 'main:' || transcript_id END AS session, CASE WHEN lane = 'A' THEN 'subagent' ELSE 'main' END AS kind, role, count(*) AS n, min(ms) AS first_ms, max(ms) AS last_ms FROM (
          SELECT transcript_id, lane, 'assistant' AS role, ms FROM t WHERE kind = 'model' AND lane IN ('main', 'A')
          UNION ALL SELECT transcript_id, lane, 'toolResult', ms + k FROM t WHERE kind = 'model' AND lane IN ('main', 'A') AND (ev IS NOT DISTINCT FROM spawner OR k % 4 = 0 AND k % 16 <> 8)
          UNION ALL SELECT transcript_id, lane, 'compactionSummary', ms FROM t WHERE kind = 'compaction' AND lane = 'main'
          UNION ALL SELECT transcript_id, lane, 'user', ms - u FROM t, (VALUES (0), (1)) v(u) WHERE lane IS NULL AND k = 92) GROUP BY ALL""",
        {"t": MS},
    ),
)
def telemetry_messages(spark, d):
    """ING-01..04, ING-17: what is left of cumulative snapshots, by session and role."""
    m = tm.messages(parsed(spark, d))
    return m.groupBy("file", F.col("sessionKey").alias("session"), "kind", "role").agg(F.count(F.lit(1)).alias("n"), F.min(F.unix_millis(tm.millis("timestamp"))).alias("first_ms"), F.max(F.unix_millis(tm.millis("timestamp"))).alias("last_ms"))


@query("telemetry_users", with_sql("SELECT transcript_id AS file, 'hello ' || ev AS text, 'u' || ev AS key FROM t WHERE lane IS NULL AND k = 92", {"t": MS}))
def telemetry_users(spark, d):
    """ING-05: a prompt's transient form goes, its settled one stays."""
    users = tm.messages(parsed(spark, d)).filter("role = 'user'").withColumn("text", tm.content_text("content"))
    return tm.without_twins(users).select("file", "text", F.col("idempotencyKey").alias("key"))


@query("telemetry_operators", with_sql("SELECT transcript_id AS file, ms - 5 AS ms FROM t WHERE lane IS NULL AND k <> 92", {"t": MS}))
def telemetry_operators(spark, d):
    """ING-13 on telemetry: inbound messages that never entered the thread."""
    e = parsed(spark, d)
    users = tm.messages(e).filter("role = 'user'").withColumn("text", tm.content_text("content")).withColumn("ms", F.col("timestamp").cast("bigint"))
    return es.operator_items(e, tm.without_twins(users).select("file", "ord", "pos", "text", "ms")).select("file", "ms")


@query(
    "telemetry_transcripts",
    with_sql(
        """SELECT transcript_id || '-' || min(ms) AS transcript_id, transcript_id AS task_name, 'agent' AS agent, (max(ms) - min(ms)) / 1000 AS total_time, CAST(sum(coalesce(input_tokens, 0) + output_tokens + cache_read + cache_write) AS BIGINT) AS total_tokens, count(*) FILTER (lane = 'main') AS n_turns,
          (SELECT x.event_type FROM t x WHERE x.transcript_id = t.transcript_id AND x.lane = 'main' AND x.kind = 'model' GROUP BY x.event_type ORDER BY count(*) DESC, min(x.ev) LIMIT 1) AS model
        FROM t WHERE kind = 'model' AND lane IN ('main', 'A') GROUP BY transcript_id HAVING count(*) FILTER (lane = 'main') > 0""",
        {"t": MS},
    ),
)
def telemetry_transcripts(spark, d):
    """ING-07, ING-19, ING-21: one row a file that has turns of its main session."""
    return tm.transcripts(parsed(spark, d)).filter("n_turns > 0").select("transcript_id", "task_name", "agent", "total_time", "total_tokens", "n_turns", "model")


@query("telemetry_spawns", with_sql("SELECT transcript_id AS file, 'agent:x:subagent:' || transcript_id || '-A' AS child, 'c' || max(spawner) AS call_id FROM t WHERE spawner IS NOT NULL GROUP BY transcript_id", {"t": MS}))
def telemetry_spawns(spark, d):
    """ING-08: child sessions and the calls that spawned them."""
    m = tm.messages(parsed(spark, d)).filter("role = 'toolResult'").withColumn("toolName", F.when(F.col("content").contains("childSessionKey"), F.lit(tm.SPAWN_TOOL)))
    return tm.spawn_links(m.select("file", "ord", "toolCallId", "toolName", "content"))


@query("telemetry_results", with_sql("SELECT transcript_id AS file, call_id, stamp, completed, failed FROM call WHERE lane = 'main'", {"t": MS, "call": CALL}))
def telemetry_results(spark, d):
    """ING-16: orchestrators' calls with what came back."""
    m = tm.messages(parsed(spark, d))
    calls = es.own_turns(m).filter("is_main").select("file", F.col("ms").alias("stamp"), F.explode("calls").alias("c")).select("file", "stamp", F.col("c.id").alias("call_id"))
    return es.with_results(calls, es.call_results(m)).select("file", "call_id", "stamp", "completed", "failed")


@query(
    "telemetry_tools",
    with_sql("SELECT transcript_id AS file, lane, row_number() OVER (PARTITION BY transcript_id ORDER BY ev) - 1 AS i, CASE WHEN k % 2 = 0 THEN ms END AS started, CASE WHEN k % 3 <> 0 THEN ms + 2 * k END AS ended, CASE WHEN k > 0 THEN k END AS lasted, k % 2 = 0 AS success FROM t WHERE lane = 'B' AND kind = 'model'", {"t": MS}),
)
def telemetry_tools(spark, d):
    """ING-09: sessions that left tool events only."""
    r = es.tool_events(parsed(spark, d))
    return r.select("file", F.substring_index("session", "-", -1).alias("lane"), (F.row_number().over(Window.partitionBy("file", "session").orderBy("n")) - 1).alias("i"), "started", "ended", "lasted", "success")


@query("telemetry_ids", with_sql("SELECT count(*) AS n, count(DISTINCT id) AS different, max(length(id)) AS width FROM (SELECT substring(sha256(transcript_id || chr(31) || ev || chr(31) || kind), 1, 22) AS id FROM tl)"))
def telemetry_ids(spark, d):
    """ING-22: ids of messages depend on what tells them apart alone."""
    t = ad.timeline(spark, d).select(tm.message_id("transcript_id", "ev", "kind").alias("id"))
    return t.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("different"), F.max(F.length("id")).alias("width"))


@query(
    "telemetry_rules",
    with_sql("SELECT ev, transcript_id, CASE k % 4 WHEN 0 THEN 'tool_calls' WHEN 1 THEN 'max_tokens' WHEN 2 THEN 'stop' ELSE 'unknown' END AS stop, CAST(coalesce(input_tokens, 0) + output_tokens + cache_read + cache_write AS BIGINT) AS total, 'main' AS session_kind, CASE WHEN k % 5 <> 0 THEN transcript_id END AS session_id, 'say ' || k AS said, CASE WHEN k > 9 THEN 'Fix it ' || repeat('x', 72) || '…' ELSE 'Fix it' END AS task FROM tl"),
)
def telemetry_rules(spark, d):
    """ING-01, ING-15, ING-18..20: rules of single fields."""
    k = F.col("k")
    t = ad.timeline(spark, d)
    usage = F.struct(F.col("input_tokens").alias("input"), F.col("output_tokens").alias("output"), F.col("cache_read").alias("cacheRead"), F.col("cache_write").alias("cacheWrite"))
    key = F.concat(F.lit("agent:x:main:"), F.when(k % 5 == 0, tm.REDACTED).otherwise(F.col("transcript_id")))
    content = F.when(k % 2 == 0, F.concat(F.lit("say "), "k")).otherwise(F.concat(F.lit('[{"type":"thinking","thinking":"hm"},{"type":"text","text":"say '), "k", F.lit('"},{"type":"toolCall","id":"1","name":"f"}]')))
    prompt = F.concat(F.lit("# Title\n<context>\n[note]\n  Fix it"), F.when(k > 9, F.concat(F.lit(" "), F.repeat(F.lit("x"), F.lit(90)))).otherwise(""), F.lit("\nmore"))
    t = t.withColumn("_u", usage).withColumn("_k", key).withColumn("_c", content).withColumn("_p", prompt).withColumn("_s", F.when(k % 4 == 0, "toolUse").when(k % 4 == 1, "length").when(k % 4 == 2, "stop").otherwise("odd"))
    return t.select("ev", "transcript_id", tm.stop_reason("_s").alias("stop"), tm.total_tokens("_u").alias("total"), tm.session_kind("_k").alias("session_kind"), tm.session_id("_k").alias("session_id"), tm.content_text("_c").alias("said"), tm.task_line("_p").alias("task"))
