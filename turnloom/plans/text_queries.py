"""Queries on message threads, texts, tags, definitions and status."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from turnloom.functions import text as tx
from turnloom.operators import frames, status, tags, threads
from turnloom.plans.axis_queries import PHASE_RUNS, staged
from turnloom.plans.registry import query
from turnloom.sources import adapters as ad
from turnloom.sources.adapters import read, with_sql

FLAT = r"regexp_replace(regexp_replace(coalesce({0}, ''), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"
CLIP = (
    r"CASE WHEN length({0}) <= {1} OR length({2}) >= length({0}) THEN {0} ELSE {2} END"
)


def clip_sql(x: str, cap: int) -> str:
    head, tail = rf"regexp_replace(substr({x}, 1, {cap // 2}), '\s+$', '')", rf"regexp_replace(right({x}, {cap - cap // 2}), '^\s+', '')"
    cut = f"concat_ws(' ', nullif({head}, ''), '[... ' || (length({x}) - length({head}) - length({tail})) || ' chars ...]', nullif({tail}, ''))"
    return CLIP.format(x, cap, cut)


def turns(spark, d):
    m = ad.messages(spark, d).filter("turn is not null")
    return m.withColumn("n_tool_calls", F.col("ev") % 3)


DIGESTS = f"""
  SELECT transcript_id, turn, CASE WHEN turn = last_ THEN {clip_sql('t', 4000)} ELSE {clip_sql('t', 300)} END AS text, n_tool_calls
  FROM (SELECT *, max(CASE WHEN t <> '' THEN turn END) OVER (PARTITION BY transcript_id) AS last_
    FROM (SELECT transcript_id, turn, {FLAT.format('text')} AS t, ev % 3 AS n_tool_calls FROM conv WHERE turn IS NOT NULL))
  WHERE (t <> '' OR n_tool_calls > 0) AND NOT starts_with(lower(t), '[assistant turn failed')"""


@query("conv_digests", with_sql("SELECT * FROM digests", {"digests": DIGESTS}))
def conv_digests(spark, d):
    return threads.digests(turns(spark, d))


@query("conv_digest_lines", with_sql("SELECT transcript_id, turn, concat_ws(' ', turn || ':', nullif(text, ''), CASE WHEN turn % 4 = 0 AND n_tool_calls > 0 THEN array_to_string(list_transform(range(1, n_tool_calls + 1), lambda i: '[CALL] tool' || i || '(x)'), ' ') WHEN n_tool_calls > 0 THEN '(tools: ' || array_to_string(list_transform(range(1, n_tool_calls + 1), lambda i: 'tool' || i), ', ') || ')' END, CASE WHEN turn % 3 = 0 THEN '[DELEGATES] goal' END) AS line FROM digests", {"digests": DIGESTS}))
def conv_digest_lines(spark, d):
    g = threads.digests(turns(spark, d))
    one = lambda i: F.struct(F.concat(F.lit("tool"), i.cast("string")).alias("function"), F.when(F.col("turn") % 4 == 0, "x").alias("arguments"), F.lit(None).cast("string").alias("result"), F.lit(False).alias("error"))
    calls = F.filter(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n_tool_calls")), one), lambda c: c["function"] != "tool0")
    goals = F.when(F.col("turn") % 3 == 0, F.array(F.lit("goal"))).otherwise(F.array().cast("array<string>"))
    return g.select("transcript_id", "turn", tx.digest_line(F.col("turn"), F.col("text"), F.lit(""), calls, F.array().cast("array<string>"), goals).alias("line"))


@query(
    "conv_batches",
    with_sql(
        r"""
        SELECT transcript_id, i // 3 AS batch, string_agg('[ITEM ' || (i % 3 + 1) || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY i) AS content, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n_items
        FROM (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY turn) - 1 AS i FROM digests) GROUP BY transcript_id, i // 3""",
        {"digests": DIGESTS},
    ),
)
def conv_batches(spark, d):
    return threads.batches(threads.digests(turns(spark, d)), 3)


@query("conv_batch_split", with_sql("SELECT transcript_id, turn, text FROM digests", {"digests": DIGESTS}))
def conv_batch_split(spark, d):
    g = threads.digests(turns(spark, d))
    b = threads.batches(g, 3).select("transcript_id", "batch", F.explode(threads.split_batch("content")).alias("n", "text"))
    at = g.select("transcript_id", "turn", (F.row_number().over(Window.partitionBy("transcript_id").orderBy("turn")) - 1).alias("i")).selectExpr("transcript_id", "turn", "i div 3 as batch", "i % 3 + 1 as n")
    return at.join(b, ["transcript_id", "batch", "n"]).select("transcript_id", "turn", "text")


EXCERPTS = f"""
  SELECT transcript_id, turn, substr(t, 1, 400) AS text, length(t) > 400 AS truncated, array_to_string(list_transform(range(1, least(n, 6) + 1), lambda i: 'tool' || i), ', ') || CASE WHEN n > 6 THEN ' (+' || (n - 6) || ' more)' ELSE '' END AS tools
  FROM (SELECT transcript_id, turn, {FLAT.format('text')} AS t, ev % 9 AS n FROM conv WHERE turn IS NOT NULL) WHERE t <> ''"""


def excerpt(spark, d):
    n = F.col("ev") % 9
    names = F.when(n > 0, F.transform(F.sequence(F.lit(1).cast("bigint"), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit("tool"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    return threads.excerpts(ad.messages(spark, d).filter("turn is not null").withColumn("tools", names))


@query("conv_excerpts", with_sql("SELECT * FROM excerpts", {"excerpts": EXCERPTS}))
def conv_excerpts(spark, d):
    return excerpt(spark, d)


@query(
    "card_budget",
    with_sql(
        """
        SELECT transcript_id, phase_index, group_index, turn, n - least(n, most) AS remaining
        FROM (SELECT *, greatest(4 // max(g) OVER (PARTITION BY transcript_id, phase_index), 1) AS most, row_number() OVER (PARTITION BY transcript_id, phase_index, group_index ORDER BY turn) AS r, count(*) OVER (PARTITION BY transcript_id, phase_index, group_index) AS n
          FROM (SELECT transcript_id, turn // 9 AS phase_index, turn % 9 // 4 AS group_index, turn, dense_rank() OVER (PARTITION BY transcript_id, turn // 9 ORDER BY turn % 9 // 4) AS g FROM phase))
        WHERE r <= most"""
    ),
)
def card_budget(spark, d):
    j = staged(spark, d)[1].selectExpr("transcript_id", "turn div 9 as phase_index", "(turn % 9) div 4 as group_index", "turn")
    return threads.card_budget(j, 4)


@query("conv_first_prompt", with_sql("SELECT transcript_id, arg_min(text, ev) FILTER (role = 'system') AS system_prompt, arg_min(text, ev) FILTER (role = 'user') AS task_message FROM conv GROUP BY ALL"))
def conv_first_prompt(spark, d):
    return threads.first_prompts(ad.messages(spark, d))


@query("conv_task_prompt", with_sql(f"SELECT transcript_id, substr(arg_min(t, ev), 1, 2400) AS task_prompt FROM (SELECT transcript_id, ev, {FLAT.format('text')} AS t FROM conv WHERE role = 'user') WHERE t <> '' AND NOT starts_with(t, '[') GROUP BY ALL"))
def conv_task_prompt(spark, d):
    return threads.task_prompt(ad.messages(spark, d))


@query("conv_elide", with_sql("SELECT transcript_id, ev, array_to_string(CASE WHEN len(w) <= 8 THEN w ELSE list_concat(list_concat(w[1:4], ['[... ' || (len(w) - 8) || ' turns elided ...]']), w[len(w) - 3:]) END, '|') AS lines FROM (SELECT transcript_id, ev, string_split(text, ' ') AS w FROM conv)"))
def conv_elide(spark, d):
    return ad.messages(spark, d).select("transcript_id", "ev", F.array_join(tx.elide(F.split("text", " "), 8), "|").alias("lines"))


@query("conv_snap", with_sql("SELECT transcript_id, ev AS id, coalesce((SELECT max(turn) FROM digests g WHERE g.transcript_id = c.transcript_id AND g.turn <= c.ev // 3), (SELECT min(turn) FROM digests g WHERE g.transcript_id = c.transcript_id)) AS turn FROM conv c WHERE role = 'user' AND transcript_id IN (SELECT transcript_id FROM digests)", {"digests": DIGESTS}))
def conv_snap(spark, d):
    anchors = ad.messages(spark, d).filter("role = 'user'").selectExpr("transcript_id", "ev as id", "ev div 3 as anchor")
    return threads.snap(anchors, threads.digests(turns(spark, d)))


@query("conv_top_tools", with_sql("SELECT transcript_id, span_id, tool, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY transcript_id, span_id ORDER BY n DESC, first) AS rank FROM (SELECT transcript_id, coalesce(lane, 'none') AS span_id, 'tool' || (k % 9) AS tool, count(*) AS n, min(ev) AS first FROM tl GROUP BY ALL)) WHERE rank <= 6"))
def conv_top_tools(spark, d):
    calls = ad.timeline(spark, d).select("transcript_id", F.coalesce("lane", F.lit("none")).alias("span_id"), "ev", F.concat(F.lit("tool"), (F.col("k") % 9).cast("string")).alias("tool"))
    return threads.top_tools(calls)


@query("conv_target_replies", with_sql("SELECT transcript_id, after_ AS turn, list(substr(event_type, 1, 4) ORDER BY ev) AS replies FROM (SELECT *, CAST(coalesce(sum(CASE WHEN turn IS NOT NULL THEN 1 END) OVER (PARTITION BY transcript_id ORDER BY ev ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) - 1 AS after_ FROM tl) WHERE turn IS NULL AND role = 'target' AND after_ >= 0 GROUP BY ALL"))
def conv_target_replies(spark, d):
    return threads.target_replies(ad.timeline(spark, d).withColumn("text", F.col("event_type")), 4)


@query("conv_compaction_texts", with_sql("SELECT transcript_id, lane AS span_id, ev, last_value(CASE WHEN kind <> 'compaction' AND k % 2 = 0 AND k % 3 > 0 THEN event_type || k END IGNORE NULLS) OVER (PARTITION BY transcript_id, lane, part ORDER BY ev ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS compaction_prompt FROM (SELECT *, coalesce(sum(CASE WHEN kind = 'compaction' THEN 1 END) OVER (PARTITION BY transcript_id, lane ORDER BY ev ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM tl WHERE lane IS NOT NULL) QUALIFY kind = 'compaction'"))
def conv_compaction_texts(spark, d):
    t = ad.timeline(spark, d).filter("lane is not null")
    kind = F.when(F.col("kind") == "compaction", "compaction").otherwise("message")
    return threads.compaction_texts(t.select("transcript_id", F.col("lane").alias("span_id"), "ev", kind.alias("kind"), F.when(F.col("k") % 2 == 0, "user").alias("role"), F.concat("event_type", F.col("k").cast("string")).alias("text"), (F.col("k") % 3 == 0).alias("in_history")))


@query("doc_clip", with_sql(f"SELECT doc_id, {clip_sql('text', 200)} AS clipped, {FLAT.format('substr(text, 1, 500)')} AS flattened FROM documents"))
def doc_clip(spark, d):
    return read(spark, d, "documents").select("doc_id", tx.clip("text", 200).alias("clipped"), tx.flat(F.substring("text", 1, 500)).alias("flattened"))


@query("doc_flat", with_sql(f"SELECT doc_id, {FLAT.format('text')} AS flattened FROM documents"))
def doc_flat(spark, d):
    return read(spark, d, "documents").select("doc_id", tx.flat("text").alias("flattened"))


@query("label_keys", with_sql(r"SELECT p_partkey, regexp_replace(lower(regexp_replace(p_type, '^\s+|\s+$', '', 'g')), '\s+', '_', 'g') AS key, upper(substr(p_type, 1, 1)) || lower(replace(substr(p_type, 2), '_', ' ')) AS shown FROM part"))
def label_keys(spark, d):
    return read(spark, d, "part").select("p_partkey", tx.label_key("p_type").alias("key"), tx.humanise("p_type").alias("shown"))


@query(
    "value_texts",
    with_sql(
        r"""
        SELECT o_orderkey, CASE WHEN n >= 3600 THEN (n // 3600) || 'h ' || lpad(CAST(n % 3600 // 60 AS VARCHAR), 2, '0') || 'm' WHEN n >= 60 THEN (n // 60) || 'm ' || lpad(CAST(n % 60 AS VARCHAR), 2, '0') || 's' ELSE n || 's' END AS busy,
          least(greatest(n * 1.6, 1000.0), 3000.0)::DOUBLE AS width, replace(trim(o_orderpriority), '-', '/') AS model, split_part(replace(trim(o_orderpriority), '-', '/'), '/', -1) AS short_model
        FROM (SELECT *, o_orderkey % 9000 AS n FROM orders)"""
    ),
)
def value_texts(spark, d):
    o = read(spark, d, "orders").withColumn("n", F.col("o_orderkey") % 9000)
    model = F.replace(F.trim("o_orderpriority"), F.lit("-"), F.lit("/"))
    return o.select("o_orderkey", tx.duration_text("n").alias("busy"), tx.chart_width("n").cast("double").alias("width"), model.alias("model"), tx.short_model(model).alias("short_model"))


# ---- tags, definitions, selection, status, frames ----------------------------------------------------------------------

TAG_A = "SELECT transcript_id, turn, event_type AS topic FROM tl WHERE turn IS NOT NULL AND k % 3 > 0"
TAG_B = "SELECT transcript_id, turn, 'q' || (k % 2) AS quality FROM tl WHERE turn IS NOT NULL AND k % 4 > 0"
TAG_C = "SELECT DISTINCT turn, 'early' AS stage FROM phase WHERE turn < 5"


def tag_layers(spark, d):
    t = ad.timeline(spark, d).filter("turn is not null")
    a = t.filter("k % 3 > 0").select("transcript_id", "turn", F.col("event_type").alias("topic"))
    b = t.filter("k % 4 > 0").select("transcript_id", "turn", F.concat(F.lit("q"), (F.col("k") % 2).cast("string")).alias("quality"))
    c = spark.range(5).select(F.col("id").alias("turn"), F.lit("early").alias("stage"))
    return t, a, b, c


@query("tag_wide", with_sql("SELECT coalesce(a.transcript_id, b.transcript_id) AS transcript_id, coalesce(a.turn, b.turn) AS turn, topic, quality FROM a FULL JOIN b ON a.transcript_id = b.transcript_id AND a.turn = b.turn", {"a": TAG_A, "b": TAG_B}))
def tag_wide(spark, d):
    from turnloom.operators.axis import n_turns

    t, a, b, _ = tag_layers(spark, d)
    return tags.wide([a, b], n_turns(t))


@query("tag_broadcast", with_sql("SELECT coalesce(a.transcript_id, x.transcript_id) AS transcript_id, coalesce(a.turn, x.turn) AS turn, topic, stage FROM a FULL JOIN (SELECT DISTINCT p.transcript_id, c.turn, c.stage FROM (SELECT transcript_id, max(turn) AS m FROM tl GROUP BY ALL) p, c WHERE c.turn <= p.m) x ON a.transcript_id = x.transcript_id AND a.turn = x.turn", {"a": TAG_A, "c": TAG_C}))
def tag_broadcast(spark, d):
    from turnloom.operators.axis import n_turns

    t, a, _, c = tag_layers(spark, d)
    return tags.wide([a, c], n_turns(t), cut=True)


@query("vocab_definitions", with_sql("SELECT DISTINCT 'ballots' AS surface, label, arg_min('of ' || transcript_id, (transcript_id, unit)) AS description, label IN ('N') AS reserved FROM bal WHERE label IS NOT NULL GROUP BY label"))
def vocab_definitions(spark, d):
    b = ad.ballots(spark, d).filter("label is not null")
    rows = b.select(F.lit("ballots").alias("surface"), "label", F.concat(F.lit("of "), "transcript_id").alias("description"), F.struct("transcript_id", "unit").alias("ord"), (F.col("label") == "N").alias("reserved"))
    return frames.definitions(rows)


@query("epoch_select", with_sql("SELECT o_custkey AS sample_id, arg_min(o_orderkey, (CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderkey)) AS epoch FROM orders GROUP BY ALL"))
def epoch_select(spark, d):
    runs = read(spark, d, "orders").select(F.col("o_custkey").alias("sample_id"), F.col("o_orderkey").alias("epoch"), (F.col("o_orderstatus") == "F").alias("success"))
    return status.earliest_success(runs)


@query(
    "status_rollup",
    with_sql(
        "SELECT scanner, model, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(reasoning) AS BIGINT) AS reasoning_tokens FROM (SELECT coalesce(lane, 'none') AS scanner, event_type AS model, coalesce(input_tokens, 0) AS input_tokens, output_tokens, CASE WHEN event_type = 'view' THEN k END AS reasoning FROM tl) GROUP BY ROLLUP (scanner, model)"
    ),
)
def status_rollup(spark, d):
    t = ad.timeline(spark, d)
    usage = F.to_json(F.create_map("event_type", F.struct("input_tokens", "output_tokens", F.when(F.col("event_type") == "view", F.col("k")).alias("reasoning_tokens"))))
    return status.usage_rollup(t.select(F.coalesce("lane", F.lit("none")).alias("scanner"), usage.alias("scan_model_usage")))


@query(
    "status_coverage",
    with_sql(
        "SELECT lane AS scanner, count(DISTINCT transcript_id) AS scanned, count(DISTINCT transcript_id) - count(DISTINCT CASE WHEN kind = 'tool' AND k % 7 = 0 THEN transcript_id END) AS completed, count(DISTINCT CASE WHEN kind = 'tool' AND k % 7 = 0 THEN (transcript_id, 'e' || k) END) AS n_errors FROM tl WHERE lane IS NOT NULL GROUP BY ALL"
    ),
)
def status_coverage(spark, d):
    t = ad.timeline(spark, d).filter("lane is not null")
    return status.coverage(t.select(F.col("lane").alias("scanner"), "transcript_id", F.when((F.col("kind") == "tool") & (F.col("k") % 7 == 0), F.concat(F.lit("e"), F.col("k").cast("string"))).alias("scan_error")))


@query("json_value_decode", with_sql("SELECT transcript_id, ev AS pos, k AS value_k, event_type AS kind FROM tl"))
def json_value_decode(spark, d):
    t = ad.timeline(spark, d)
    item = F.struct("ev", F.struct(F.col("k"), F.col("event_type").alias("kind")).alias("v"))
    stored = t.groupBy("transcript_id").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"]).alias("timeline"))).alias("value"))
    return frames.exploded(stored, "timeline array<struct<k:bigint,kind:string>>", "timeline").select("transcript_id", "pos", F.col("k").alias("value_k"), "kind")


@query("phase_spine", with_sql("SELECT s.transcript_id, s.span_id, CAST(a.tool_calls AS BIGINT) AS tool_calls, t.new_work, CASE WHEN a.tool_calls IS NULL AND t.new_work IS NULL THEN 'span' ELSE 'joined' END AS source FROM span s LEFT JOIN (SELECT transcript_id, lane AS span_id, count(*) AS tool_calls FROM tl WHERE kind = 'tool' AND lane IN ('A', 'B') GROUP BY ALL) a USING (transcript_id, span_id) LEFT JOIN (SELECT transcript_id, lane AS span_id, CAST(sum(output_tokens) AS BIGINT) AS new_work FROM tl WHERE kind = 'model' AND lane IN ('A', 'B') GROUP BY ALL) t USING (transcript_id, span_id)"))
def span_spine(spark, d):
    tl = ad.timeline(spark, d)
    lane = tl.filter("lane in ('A', 'B')").withColumn("span_id", F.col("lane"))
    acts = lane.filter("kind = 'tool'").groupBy("transcript_id", "span_id").agg(F.count(F.lit(1)).alias("tool_calls"))
    toks = lane.filter("kind = 'model'").groupBy("transcript_id", "span_id").agg(F.sum("output_tokens").alias("new_work"))
    s = frames.spine(ad.spans(tl).select("transcript_id", "span_id"), acts, toks)
    return s.select("transcript_id", "span_id", "tool_calls", "new_work", F.when(F.col("tool_calls").isNull() & F.col("new_work").isNull(), "span").otherwise("joined").alias("source"))
