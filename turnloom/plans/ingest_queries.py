"""Queries on consolidation and on branch trees, over events and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from turnloom.operators import axis, branches, packing, threads
from turnloom.plans.registry import query
from turnloom.sources import adapters as ad
from turnloom.sources import telemetry as tm
from turnloom.sources.adapters import with_sql


@query("snapshot_dedup", with_sql("SELECT transcript_id, k, min(ev) AS first_ev, arg_min(event_type, ev) AS event_type FROM tl GROUP BY ALL"))
def snapshot_dedup(spark, d):
    t = ad.timeline(spark, d)
    # every row recurs in all later snapshots of its session; here in three of them
    seen = t.withColumn("snapshot", F.explode(F.sequence(F.col("ev"), F.col("ev") + 2)))
    return tm.first_of(seen, ["transcript_id", "k"], ["snapshot", "ev"]).select("transcript_id", "k", F.col("ev").alias("first_ev"), "event_type")


ROLL = "SELECT transcript_id, lane, ev, k // 25 AS total, input_tokens, output_tokens, CASE WHEN k % 3 = 0 THEN 'r' || k END AS response_id, CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN 'toolUse' ELSE 'stop' END AS stop_reason, k % 2 AS n_tool_calls FROM tl WHERE kind = 'model' AND lane IS NOT NULL"


@query(
    "rollup_drop",
    with_sql(
        "SELECT transcript_id, lane, ev FROM (SELECT *, lag(total) OVER (PARTITION BY transcript_id, lane ORDER BY ev) AS last_ FROM roll) WHERE NOT coalesce(response_id IS NULL AND (stop_reason IS NULL OR stop_reason = 'stop') AND n_tool_calls = 0 AND total = last_ AND coalesce(input_tokens, output_tokens) IS NOT NULL AND coalesce(input_tokens, 0) + coalesce(output_tokens, 0) <> total, false)",
        {"roll": ROLL},
    ),
)
def rollup_drop(spark, d):
    k = F.col("k")
    t = ad.timeline(spark, d).filter("kind = 'model' and lane is not null")
    none = F.lit(None).cast("bigint")
    rows = t.select(
        "transcript_id", "lane", "ev", F.expr("k div 25").alias("total"), F.col("input_tokens").alias("input"), F.col("output_tokens").alias("output"), none.alias("cache_read"), none.alias("cache_write"),
        F.when(k % 3 == 0, F.concat(F.lit("r"), k.cast("string"))).alias("response_id"), F.when(k % 4 == 1, "toolUse").when(k % 4 > 1, "stop").alias("stop_reason"), (k % 2).alias("n_tool_calls"),
    )
    return tm.drop_rollups(rows, ["transcript_id", "lane"], ["ev"]).select("transcript_id", "lane", "ev")


@query("primary_model", with_sql("SELECT transcript_id, model FROM (SELECT transcript_id, event_type AS model, row_number() OVER (PARTITION BY transcript_id ORDER BY count(*) DESC, min(ev)) AS r FROM tl WHERE turn IS NOT NULL GROUP BY transcript_id, event_type) WHERE r = 1"))
def primary_model(spark, d):
    return tm.primary_model(ad.timeline(spark, d).filter("turn is not null").withColumn("model", F.col("event_type")), ["transcript_id"], "ev")


@query("file_anchor", with_sql("SELECT f.transcript_id AS file, f.lane AS session, (SELECT max(epoch_us(x.ts)) FROM tl x WHERE x.transcript_id = f.transcript_id AND x.lane = 'main' AND x.ev < f.ev) AS anchor FROM (SELECT transcript_id, lane, min(ev) AS ev FROM tl WHERE lane IN ('A', 'B') GROUP BY ALL) f"))
def file_anchor(spark, d):
    t = ad.timeline(spark, d)
    rows = t.select(F.col("transcript_id").alias("file"), F.col("ev").alias("ord"), F.col("lane").alias("session"), F.coalesce(F.col("lane") == "main", F.lit(False)).alias("is_main"), F.unix_micros(F.col("ts").cast("timestamp")).alias("stamp"))
    return tm.file_anchor(rows).filter("session in ('A', 'B')")


@query("ordered_merge", with_sql("SELECT transcript_id AS file, row_number() OVER (PARTITION BY transcript_id ORDER BY stamp, r, ev) - 1 AS ev, kind FROM (SELECT transcript_id, ev, kind, epoch_us(ts) // 3600000000 AS stamp, CASE kind WHEN 'compaction' THEN 0 WHEN 'tool' THEN 1 ELSE 2 END AS r FROM tl)"))
def ordered_merge(spark, d):
    t = ad.timeline(spark, d).select(F.col("transcript_id").alias("file"), F.expr("unix_micros(cast(ts as timestamp)) div 3600000000").alias("stamp"), F.col("ev").alias("ord"), "kind")
    return tm.merged([(t.filter(F.col("kind") == k), i) for i, k in enumerate(("compaction", "tool", "model"))]).select("file", "ev", "kind")


SENDS = "SELECT CAST(transcript_id AS VARCHAR) AS transcript_id, text, ev AS ord, ev AS ts, row_number() OVER (PARTITION BY transcript_id, text ORDER BY ev) AS i FROM conv WHERE role = 'user'"
DATED = "SELECT transcript_id, text, ord, ts + 1 AS ts, row_number() OVER (PARTITION BY transcript_id, text ORDER BY ts) AS n FROM send WHERE ord % 3 > 0"
UNDATED = "SELECT transcript_id, text, ord, row_number() OVER (PARTITION BY transcript_id, text ORDER BY ord) AS n FROM send WHERE ord % 3 = 0"
#: One send of each text a step: the last dated turn taken (n), and how many undated ones are gone (u).
TAKEN = """SELECT s.transcript_id, s.text, s.i, s.ord, d.n, CASE WHEN d.n IS NULL THEN 1 ELSE 0 END AS u, d.ord AS user_ord
    FROM send s LEFT JOIN LATERAL (SELECT n, ord FROM dated x WHERE x.transcript_id = s.transcript_id AND x.text = s.text AND x.ts >= s.ts ORDER BY n LIMIT 1) d ON true WHERE s.i = 1
  UNION ALL
  SELECT s.transcript_id, s.text, s.i, s.ord, CASE WHEN t.u = 0 THEN d.n END, t.u + CASE WHEN t.u > 0 OR d.n IS NULL THEN 1 ELSE 0 END, CASE WHEN t.u = 0 THEN d.ord END
    FROM taken t JOIN send s ON s.transcript_id = t.transcript_id AND s.text = t.text AND s.i = t.i + 1
    LEFT JOIN LATERAL (SELECT n, ord FROM dated x WHERE x.transcript_id = s.transcript_id AND x.text = s.text AND x.ts >= s.ts AND x.n > coalesce(t.n, 0) ORDER BY n LIMIT 1) d ON true"""


@query(
    "operator_match",
    with_sql(
        "SELECT t.transcript_id, t.text, t.ord, CASE WHEN t.u = 0 THEN t.user_ord ELSE x.ord END AS user_ord FROM taken t LEFT JOIN undated x ON x.transcript_id = t.transcript_id AND x.text = t.text AND x.n = t.u AND t.u > 0",
        {"send": SENDS, "dated": DATED, "undated": UNDATED, "taken": TAKEN},
        recursive=True,
    ),
)
def operator_match(spark, d):
    m = ad.messages(spark, d)
    sends = m.filter("role = 'user'").select(F.col("transcript_id").cast("string"), "text", F.col("ev").alias("ord"), F.col("ev").alias("ts"))
    users = m.filter("role = 'user'").select(F.col("transcript_id").cast("string"), "text", F.col("ev").alias("ord"), F.when(F.col("ev") % 3 > 0, F.col("ev") + 1).alias("ts"))
    return packing.match_sends(sends, users)


@query(
    "tool_pairs",
    with_sql(
        "SELECT s.session, s.name, s.ord AS start_ord, (SELECT min(e.ord) FROM mark e WHERE e.session = s.session AND e.name = s.name AND e.type = 'end' AND e.ord > s.ord AND e.starts - s.starts = e.ends - s.ends - 1) AS end_ord FROM mark s WHERE s.type = 'start'",
        {"mark": "SELECT transcript_id || '/' || lane AS session, ev AS ord, CASE WHEN k % 2 = 0 THEN 'start' ELSE 'end' END AS type, event_type AS name, sum(CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END) OVER w AS starts, sum(CASE WHEN k % 2 = 0 THEN 0 ELSE 1 END) OVER w AS ends FROM tl WHERE lane IS NOT NULL WINDOW w AS (PARTITION BY transcript_id, lane, event_type ORDER BY ev)"},
    ),
)
def tool_pairs(spark, d):
    t = ad.timeline(spark, d).filter("lane is not null")
    return packing.pair_tools(t.select(F.concat_ws("/", "transcript_id", "lane").alias("session"), F.col("ev").alias("ord"), F.when(F.col("k") % 2 == 0, "start").otherwise("end").alias("type"), F.col("event_type").alias("name")))


@query("tool_outputs", with_sql("SELECT c.transcript_id, c.k AS call_id, c.ev AS start, coalesce((SELECT arg_min(x.event_type, x.ev) FROM tl x WHERE x.transcript_id = c.transcript_id AND x.k = c.k AND x.kind = 'tool' AND x.ev > c.ev AND x.ev < c.ev + 30), CASE WHEN (SELECT count(*) FROM tl y WHERE y.transcript_id = c.transcript_id AND y.k = c.k AND y.kind = 'compaction') = 1 THEN 'message' END) AS output FROM tl c WHERE c.turn IS NOT NULL"))
def tool_outputs(spark, d):
    t = ad.timeline(spark, d)
    calls = t.filter("turn is not null").select("transcript_id", F.col("k").alias("call_id"), F.col("ev").alias("start"), (F.col("ev") + 30).alias("end"))
    tools = t.filter("kind = 'tool'").select("transcript_id", F.col("k").alias("call_id"), "ev", F.col("event_type").alias("result"))
    answers = t.filter("kind = 'compaction'").select("transcript_id", F.col("k").alias("call_id"), F.lit("message").alias("text"))
    return threads.tool_outputs(calls, tools, answers)


TREE = "SELECT DISTINCT transcript_id, ev // 4 AS branch, CASE WHEN ev // 4 > 0 THEN CASE WHEN ev // 4 % 3 = 0 THEN 0 ELSE ev // 4 - 1 END END AS parent, CASE WHEN ev // 4 > 0 THEN ev // 4 % 3 ELSE 0 END AS fork_after FROM conv"


def tree(spark, d):
    m = ad.messages(spark, d).select("transcript_id", F.expr("ev div 4").alias("branch")).distinct()
    b = F.col("branch")
    return m.withColumn("parent", F.when(b > 0, F.when(b % 3 == 0, 0).otherwise(b - 1))).withColumn("fork_after", F.when(b > 0, b % 3).otherwise(0))


PATH = "SELECT transcript_id, branch, 1 AS upto FROM (SELECT transcript_id, max(branch) AS branch FROM tree GROUP BY ALL) UNION ALL SELECT p.transcript_id, t.parent, t.fork_after FROM path p JOIN tree t ON t.transcript_id = p.transcript_id AND t.branch = p.branch WHERE t.parent IS NOT NULL"


@query("branch_survivors", with_sql("SELECT transcript_id, branch, upto FROM path", {"tree": TREE, "path": PATH}, recursive=True))
def branch_survivors(spark, d):
    t = tree(spark, d)
    return branches.surviving(t, t.groupBy("transcript_id").agg(F.max("branch").alias("branch"), F.lit(1).alias("n")))


@query("branch_discarded", with_sql("SELECT c.transcript_id, c.ev // 4 AS branch, c.ev % 4 AS branch_turn FROM conv c WHERE NOT EXISTS (SELECT 1 FROM path p WHERE p.transcript_id = c.transcript_id AND p.branch = c.ev // 4 AND c.ev % 4 < p.upto)", {"tree": TREE, "path": PATH}, recursive=True))
def branch_discarded(spark, d):
    calls = ad.messages(spark, d).select("transcript_id", F.expr("ev div 4").alias("branch"), (F.col("ev") % 4).alias("branch_turn"))
    return branches.discarded(calls, branch_survivors(spark, d))


@query("branch_diagram", with_sql("SELECT transcript_id, branch, start FROM place", {"tree": TREE, "place": "SELECT transcript_id, branch, 0 AS start FROM tree WHERE parent IS NULL UNION ALL SELECT a.transcript_id, t.branch, a.start + t.fork_after FROM place a JOIN tree t ON t.transcript_id = a.transcript_id AND t.parent = a.branch"}, recursive=True))
def branch_diagram(spark, d):
    return branches.diagram(tree(spark, d))


@query("branch_calls", with_sql("SELECT transcript_id, row_number() OVER (PARTITION BY transcript_id ORDER BY ev) AS number, row_number() OVER (PARTITION BY transcript_id, k % 2 ORDER BY ev) - 1 AS lane_turn, k % 2 AS attempt, CAST((SELECT count(*) FROM tl x WHERE x.transcript_id = c.transcript_id AND x.ev < c.ev AND x.kind = 'model') - 1 AS BIGINT) AS driver_turn FROM tl c WHERE kind = 'tool'"))
def branch_calls(spark, d):
    kind = F.when(F.col("kind") == "tool", "call").when(F.col("kind") == "compaction", "rollback").otherwise("turn")
    t = ad.timeline(spark, d).select("transcript_id", "ev", kind.alias("kind"), (F.col("k") % 2).alias("attempt"), F.col("event_type").alias("text"))
    c = branches.target_calls(t)
    return c.select("transcript_id", "number", "lane_turn", "attempt", F.coalesce("driver_turn", F.lit(-1)).alias("driver_turn"))


@query("exchange_items", with_sql("SELECT transcript_id, driver AS driver_turn, min(number) AS first_call, max(number) AS last_call, count(*) AS n_calls FROM (SELECT *, sum(new_) OVER (PARTITION BY transcript_id ORDER BY number) AS island FROM (SELECT *, CASE WHEN lag(driver) OVER w IS DISTINCT FROM driver OR lag(number) OVER w IS NULL THEN 1 ELSE 0 END AS new_ FROM (SELECT transcript_id, turn AS number, k // 40 AS driver FROM tl WHERE turn IS NOT NULL) WINDOW w AS (PARTITION BY transcript_id ORDER BY number))) GROUP BY transcript_id, island, driver"))
def exchange_items(spark, d):
    t = ad.timeline(spark, d).filter("turn is not null").select("transcript_id", F.col("turn").alias("number"), F.expr("k div 40").alias("driver_turn"))
    return branches.exchange_items(t)


@query("nearest_lanes", with_sql("SELECT transcript_id, span_id, span_id AS lane_id FROM span"))
def nearest_lanes(spark, d):
    s = ad.spans(ad.timeline(spark, d)).select("transcript_id", "span_id", "parent_id", F.lit(True).alias("is_lane"), F.lit(True).alias("is_agent"))
    return axis.nearest_lane(s)


@query("axis_roles", with_sql("SELECT transcript_id, arg_min(role, ev) AS role, CASE WHEN bool_or(n > 0) AND arg_min(role, ev) IS DISTINCT FROM arg_min(role, ev) FILTER (n > 0) THEN 'the first tool call is of another role' END AS error FROM (SELECT transcript_id, ev, coalesce(role, 'none') AS role, k % 3 AS n FROM tl WHERE kind = 'model') GROUP BY ALL"))
def axis_roles(spark, d):
    t = ad.timeline(spark, d).filter("kind = 'model'").select("transcript_id", "ev", F.coalesce("role", F.lit("none")).alias("role"), (F.col("k") % 3).alias("n_tool_calls"))
    return axis.axis_role(t)


@query("intervention_rows", with_sql("SELECT transcript_id, ord, turn, channel, initiator, content, row_number() OVER (PARTITION BY transcript_id ORDER BY turn, ord) - 1 AS position FROM (SELECT transcript_id, ev AS ord, ev // 2 AS turn, 'operator' AS channel, 'human' AS initiator, text AS content FROM (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY ev) AS n FROM conv WHERE role = 'user') WHERE n > 1 UNION ALL SELECT transcript_id, ev, ev // 3, 'approval', 'agent', text FROM conv WHERE role = 'assistant' AND ev % 3 = 0)"))
def intervention_rows(spark, d):
    m = ad.messages(spark, d)
    human = m.filter("role = 'user'").select("transcript_id", F.col("ev").alias("id"), F.col("ev").alias("ord"), F.lit("operator").alias("source"), "text", F.when(F.col("ev") % 5 > 0, F.expr("ev div 2")).alias("seen_turn"), F.expr("ev div 2").alias("footprint_turn"))
    asks = m.filter("role = 'assistant' and ev % 3 = 0").select("transcript_id", F.col("ev").alias("ord"), F.expr("ev div 3").alias("turn"), F.lit("approval").alias("channel"), F.lit(None).cast("string").alias("prompt"), F.col("text").alias("content"), F.lit("ok").alias("outcome"))
    return threads.interventions(human, asks).select("transcript_id", "ord", "turn", "channel", "initiator", "content", "position")


@query("rank_latest", with_sql("SELECT transcript_id, ev, kind FROM (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY ts DESC, ev DESC) AS r FROM tl) WHERE r <= 3"))
def rank_latest(spark, d):
    w = Window.partitionBy("transcript_id").orderBy(F.desc("ts"), F.desc("ev"))
    return ad.timeline(spark, d).withColumn("r", F.row_number().over(w)).filter("r <= 3").select("transcript_id", "ev", "kind")
