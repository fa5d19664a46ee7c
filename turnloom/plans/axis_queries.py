"""Queries on the turn axis, tokens, lanes and spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.operators import axis, packing, phases, tokens
from turnloom.plans.registry import query
from turnloom.shared import written
from turnloom.sources import adapters as ad
from turnloom.sources.adapters import with_sql

VIEWS = """
  SELECT *, CASE WHEN NOT gap THEN input_tokens + output_tokens + least(cache_write, greatest(0, context - coalesce(last_context, 0))) END AS new_work,
    CASE WHEN NOT gap THEN input_tokens + output_tokens + cache_write END AS billable,
    CASE WHEN NOT gap THEN input_tokens + output_tokens + cache_write + cache_read END AS turn_total
  FROM (SELECT *, last_value(context IGNORE NULLS) OVER (PARTITION BY transcript_id, key ORDER BY ev ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_context
    FROM (SELECT *, CASE WHEN NOT gap THEN input_tokens + cache_write + cache_read END AS context,
        coalesce(CASE WHEN lane <> 'main' THEN lane END, CASE WHEN turn IS NOT NULL THEN '__main__' END, '__offaxis_' || ev) AS key
      FROM (SELECT *, input_tokens IS NULL OR input_tokens + output_tokens + cache_read + cache_write = 0 AS gap FROM tl WHERE kind = 'model')))"""
DROPS = """
  SELECT transcript_id, lane, ev, turn, lane_turn, prev AS tokens_before, context AS tokens_after
  FROM (SELECT *, lag(context) OVER w AS prev, lead(context) OVER w AS nxt FROM views WHERE lane IS NOT NULL AND context IS NOT NULL WINDOW w AS (PARTITION BY transcript_id, lane ORDER BY ev))
  WHERE context * 10 < prev * 6 AND (nxt IS NULL OR nxt * 10 < prev * 6)"""
FLUSHES = """
  SELECT transcript_id, lane, ev, axis AS turn, own AS lane_turn, output_tokens * 10 AS tokens_before, CASE WHEN k % 2 = 0 THEN 0 ELSE k END AS tokens_after
  FROM (SELECT *, CAST(coalesce(sum(CASE WHEN turn IS NOT NULL THEN 1 END) OVER (PARTITION BY transcript_id ORDER BY ev ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS axis,
      CAST(coalesce(sum(CASE WHEN kind = 'model' THEN 1 END) OVER (PARTITION BY transcript_id, lane ORDER BY ev ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS own FROM tl)
  WHERE kind = 'compaction' AND lane IS NOT NULL"""


def views(spark, d, timeline=None):
    return tokens.token_views((ad.timeline(spark, d) if timeline is None else timeline).filter("kind = 'model'"))


def recorded(spark, d, timeline=None):
    c = tokens.compactions(ad.timeline(spark, d) if timeline is None else timeline)
    return c.select("transcript_id", "lane", "ev", F.col("at_turn").alias("turn"), F.col("at_lane_turn").alias("lane_turn"), (F.col("output_tokens") * 10).alias("tokens_before"), F.when(F.col("k") % 2 == 0, 0).otherwise(F.col("k")).alias("tokens_after"))


@query("tl_lane_spend", with_sql("SELECT transcript_id, lane, count(*) AS turns, max(context) AS context_peak, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(new_work) AS BIGINT) AS new_work, CAST(sum(billable) AS BIGINT) AS billable FROM views WHERE lane IS NOT NULL GROUP BY ALL", {"views": "SELECT * FROM (" + VIEWS + ") AS from_tl"}))
def tl_lane_spend(spark, d):
    return tokens.lane_spend(views(spark, d))


@query("tl_token_views", with_sql("SELECT transcript_id, ev, lane, turn, lane_turn, context, new_work, billable, turn_total FROM views", {"views": VIEWS}))
def tl_token_views(spark, d):
    return views(spark, d).select("transcript_id", "ev", "lane", "turn", "lane_turn", "context", "new_work", "billable", "turn_total")


@query(
    "tl_turn_axis",
    with_sql("SELECT transcript_id, ev, kind, turn, lane_turn, CAST(coalesce(sum(CASE WHEN turn IS NOT NULL THEN 1 END) OVER (PARTITION BY transcript_id ORDER BY ev ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before_turn FROM tl"),
)
def tl_turn_axis(spark, d):
    return axis.before_turn(axis.number_turns(ad.timeline(spark, d).drop("turn", "lane_turn"), F.col("lane") == "main")).select("transcript_id", "ev", "kind", "turn", "lane_turn", "before_turn")


@query(
    "tl_lane_rows",
    with_sql(
        "SELECT transcript_id, ev, lane, CAST(greatest(coalesce(sum(CASE WHEN turn IS NOT NULL THEN 1 END) OVER (PARTITION BY transcript_id ORDER BY ev ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) - 1, 0) AS BIGINT) AS axis_turn FROM tl QUALIFY lane IS NOT NULL"
    ),
)
def tl_lane_rows(spark, d):
    return axis.lane_rows(ad.timeline(spark, d)).select("transcript_id", "ev", "lane", "axis_turn")


@query(
    "tl_cum_billable",
    with_sql(
        "SELECT transcript_id, turn, CAST(sum(billable) OVER (PARTITION BY transcript_id ORDER BY turn) AS BIGINT) AS cum_billable, coalesce(min(CASE WHEN billable > 0 THEN billable END) OVER (PARTITION BY transcript_id), 1) AS bar_floor, CASE WHEN billable > 0 THEN billable END AS log_billable FROM views WHERE turn IS NOT NULL",
        {"views": VIEWS},
    ),
)
def tl_cum_billable(spark, d):
    return tokens.cumulative(views(spark, d))


@query("tl_synth_drops", with_sql("SELECT * FROM drops", {"views": VIEWS, "drops": DROPS}))
def tl_synth_drops(spark, d):
    return tokens.drops(views(spark, d))


@query(
    "tl_flushes",
    with_sql(
        """
        SELECT r.transcript_id, r.lane, r.ev, r.turn, r.lane_turn, 'recorded' AS source, r.tokens_before,
          CASE WHEN inferred THEN nxt ELSE tokens_after END AS tokens_after, inferred AS tokens_after_inferred
        FROM (SELECT r.*, n.nxt, tokens_after = 0 AND tokens_before <> 0 AND n.nxt IS NOT NULL AS inferred FROM recorded r
          LEFT JOIN (SELECT r.transcript_id, r.lane, r.ev, arg_min(v.context, v.ev) AS nxt FROM recorded r JOIN views v ON v.transcript_id = r.transcript_id AND v.lane = r.lane AND v.lane_turn >= r.lane_turn WHERE v.context IS NOT NULL GROUP BY ALL) n
          USING (transcript_id, lane, ev)) r
        UNION ALL
        SELECT transcript_id, lane, ev, turn, lane_turn, 'synthesized', tokens_before, tokens_after, false FROM drops d
        WHERE NOT EXISTS (SELECT 1 FROM recorded r WHERE r.transcript_id = d.transcript_id AND r.lane = d.lane AND abs(r.lane_turn - d.lane_turn) <= 1)""",
        {"views": VIEWS, "drops": DROPS, "recorded": FLUSHES},
    ),
)
def tl_flushes(spark, d):
    t = written(ad.timeline(spark, d), "timeline")
    return tokens.flushes(recorded(spark, d, t), written(views(spark, d, t), "views"))


@query("tl_compactions_per_lane", with_sql("SELECT transcript_id, lane, count(*) AS n_compactions FROM tl WHERE kind = 'compaction' AND lane IS NOT NULL GROUP BY ALL"))
def tl_compactions_per_lane(spark, d):
    return tokens.compactions(ad.timeline(spark, d)).groupBy("transcript_id", "lane").agg(F.count(F.lit(1)).alias("n_compactions"))


@query(
    "tl_lane_activity",
    with_sql(
        """
        SELECT transcript_id, at_turn AS turn, lane, count(*) AS tool_calls, CAST(sum(input_tokens) AS BIGINT) AS busy, min(ts) AS started_at
        FROM (SELECT *, CAST(greatest(coalesce(sum(CASE WHEN turn IS NOT NULL THEN 1 END) OVER (PARTITION BY transcript_id ORDER BY ev ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1, 0) AS BIGINT) AS at_turn FROM tl)
        WHERE kind = 'tool' AND lane IN ('A', 'B') GROUP BY ALL"""
    ),
)
def tl_lane_activity(spark, d):
    return tokens.lane_activity(ad.timeline(spark, d).withColumn("busy", F.col("input_tokens")))


@query("tl_n_turns", with_sql("SELECT transcript_id, max(turn) + 1 AS n_turns FROM tl WHERE turn IS NOT NULL GROUP BY ALL"))
def tl_n_turns(spark, d):
    return axis.n_turns(ad.timeline(spark, d))


SPEND = """
  SELECT *, spend / CAST(sum(spend) OVER (PARTITION BY transcript_id) AS DOUBLE) AS share FROM (
    SELECT transcript_id, {key} AS label, CAST(sum(spend) AS BIGINT) AS spend FROM rows_ WHERE {key} IS NOT NULL GROUP BY ALL HAVING sum(spend) > 0
    UNION ALL
    SELECT transcript_id, '{missing}', CAST(max(total) - coalesce(sum(CASE WHEN {key} IS NOT NULL THEN spend END), 0) AS BIGINT) FROM rows_ GROUP BY ALL
    HAVING max(total) - coalesce(sum(CASE WHEN {key} IS NOT NULL THEN spend END), 0) > 0)"""


def spend_rows(spark, d, key):
    from pyspark.sql import Window

    v = views(spark, d).select("transcript_id", "ev", "turn", "role", "k", F.coalesce("new_work", F.lit(0)).alias("spend"))
    return v.withColumn("total", F.sum("spend").over(Window.partitionBy("transcript_id"))).withColumn("key", key)


@query("tl_spend_by_role", with_sql(SPEND.format(key="role", missing="no role"), {"views": VIEWS, "rows_": "SELECT *, sum(spend) OVER (PARTITION BY transcript_id) AS total FROM (SELECT transcript_id, role, coalesce(new_work, 0) AS spend FROM views)"}))
def tl_spend_by_role(spark, d):
    return tokens.spend_by(spend_rows(spark, d, F.col("role")), "key", F.col("total"), "no role")


@query(
    "tl_spend_by_tag",
    with_sql(
        SPEND.format(key="tag", missing="untagged"),
        {"views": VIEWS, "rows_": "SELECT *, sum(spend) OVER (PARTITION BY transcript_id) AS total FROM (SELECT transcript_id, CASE WHEN turn IS NOT NULL AND k % 3 > 0 THEN 't' || (k % 3) END AS tag, coalesce(new_work, 0) AS spend FROM views)"},
    ),
)
def tl_spend_by_tag(spark, d):
    tag = F.when(F.col("turn").isNotNull() & (F.col("k") % 3 > 0), F.concat(F.lit("t"), (F.col("k") % 3).cast("string")))
    return tokens.spend_by(spend_rows(spark, d, tag), "key", F.col("total"), "untagged")


@query("tl_measures_coincide", with_sql("SELECT transcript_id, count(context) > 0 AS has_views, coalesce(bool_and(turn_total = new_work), false) AS coincide FROM views WHERE turn IS NOT NULL GROUP BY ALL", {"views": VIEWS}))
def tl_measures_coincide(spark, d):
    return tokens.measures_coincide(views(spark, d))


def cells(spark, d):
    return cells_of(ad.timeline(spark, d))


def cells_of(timeline):
    t = timeline.filter("turn is not null")
    return axis.clock(t.select("transcript_id", "turn", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("start"), F.lit(None).cast("double").alias("completed")))


CELLS = """
  SELECT transcript_id, turn, start AS cell_start, coalesce(nxt, start + coalesce(median, 0)) AS cell_end
  FROM (SELECT *, quantile_cont(CASE WHEN nxt > start THEN nxt - start END, 0.5) OVER (PARTITION BY transcript_id) AS median
    FROM (SELECT transcript_id, turn, CAST(epoch_us(ts) AS DOUBLE) AS start, lead(CAST(epoch_us(ts) AS DOUBLE)) OVER (PARTITION BY transcript_id ORDER BY turn) AS nxt FROM tl WHERE turn IS NOT NULL))"""


@query("tl_clock", with_sql("SELECT * FROM cells", {"cells": CELLS}))
def tl_clock(spark, d):
    return cells(spark, d)


@query(
    "span_asof_turns",
    with_sql(
        """
        SELECT s.transcript_id, s.span_id, CAST(coalesce(max(turn) FILTER (cell_start <= epoch_us(started_at)), 0) AS BIGINT) AS anchor_turn,
          CAST(coalesce(max(turn) FILTER (cell_start <= epoch_us(ended_at)), 0) AS BIGINT) AS end_turn, 'timestamp' AS turn_source
        FROM span s JOIN cells USING (transcript_id) GROUP BY s.transcript_id, s.span_id""",
        {"cells": CELLS},
    ),
)
def span_asof_turns(spark, d):
    t = written(ad.timeline(spark, d), "timeline")
    s = ad.spans(t).select(
        "transcript_id", "span_id", "spawn_turn", F.unix_micros(F.col("started_at").cast("timestamp")).cast("double").alias("started"), F.unix_micros(F.col("ended_at").cast("timestamp")).cast("double").alias("ended"), F.lit(None).cast("bigint").alias("order_end_turn")
    )
    c = written(cells_of(t), "cells")
    return axis.place_spans(s.join(c.select("transcript_id").distinct(), "transcript_id", "left_semi"), c).select("transcript_id", "span_id", "anchor_turn", "end_turn", "turn_source")


@query(
    "span_position",
    with_sql(
        """
        SELECT s.transcript_id, s.span_id, round(CASE WHEN t <= first THEN -0.5 WHEN t >= last THEN n - 0.5 ELSE c.turn - 0.5 + (t - c.cell_start) / (c.cell_end - c.cell_start) END, 6) AS position
        FROM (SELECT transcript_id, span_id, CAST(epoch_us(ended_at) AS DOUBLE) AS t FROM span) s
        JOIN (SELECT transcript_id, count(*) AS n, min(cell_start) AS first, max(cell_end) AS last FROM cells GROUP BY ALL) e USING (transcript_id)
        LEFT JOIN cells c ON c.transcript_id = s.transcript_id AND c.cell_start <= t AND t < c.cell_end""",
        {"cells": CELLS},
    ),
)
def span_position(spark, d):
    s = ad.spans(ad.timeline(spark, d)).select("transcript_id", "span_id", F.unix_micros(F.col("ended_at").cast("timestamp")).cast("double").alias("at"))
    return axis.position(s, cells(spark, d)).select("transcript_id", "span_id", F.round("position", 6).alias("position"))


@query("span_lineage", with_sql("SELECT a.transcript_id, a.span_id, a.span_id AS ancestor_id, 0 AS depth FROM span a UNION ALL SELECT a.transcript_id, a.span_id, b.span_id, 1 FROM span a JOIN span b ON a.transcript_id = b.transcript_id AND a.parent_id = b.span_id"))
def span_lineage(spark, d):
    return axis.lineage(ad.spans(ad.timeline(spark, d)))


@query(
    "span_packing",
    with_sql(
        "SELECT transcript_id, 'lane' AS label, span_id, CAST(sub_row AS INTEGER) AS sub_row FROM fold",
        {
            "box": "SELECT transcript_id, span_id, epoch(ts0) AS x0, epoch(ts1) AS x1, row_number() OVER (PARTITION BY transcript_id ORDER BY epoch(ts0), span_id) AS i FROM (SELECT transcript_id, span_id, date_trunc('second', started_at) AS ts0, date_trunc('second', ended_at) AS ts1 FROM span)",
            "fold": "SELECT transcript_id, span_id, i, 0 AS sub_row, [x1] AS ends FROM box WHERE i = 1 UNION ALL SELECT b.transcript_id, b.span_id, b.i, coalesce(list_position(list_transform(f.ends, lambda e: b.x0 > e), true), len(f.ends) + 1) - 1, CASE WHEN list_contains(list_transform(f.ends, lambda e: b.x0 > e), true) THEN f.ends[: list_position(list_transform(f.ends, lambda e: b.x0 > e), true) - 1] || [b.x1] || f.ends[list_position(list_transform(f.ends, lambda e: b.x0 > e), true) + 1 :] ELSE f.ends || [b.x1] END FROM fold f JOIN box b ON b.transcript_id = f.transcript_id AND b.i = f.i + 1",
        },
        recursive=True,
    ),
)
def span_packing(spark, d):
    s = ad.spans(ad.timeline(spark, d)).select("transcript_id", "span_id", F.lit("lane").alias("label"), F.unix_seconds(F.col("started_at").cast("timestamp")).cast("double").alias("x0"), F.unix_seconds(F.col("ended_at").cast("timestamp")).cast("double").alias("x1"))
    return packing.pack(s)


PHASE_RUNS = """
  SELECT transcript_id, row_number() OVER (PARTITION BY transcript_id ORDER BY turn_start) - 1 AS phase_index, phase, turn_start, turn_end, n_digest_turns,
    round(total / CAST(n_digest_turns AS DOUBLE) / 100, 3) AS confidence, least_ / 100 AS min_confidence,
    CASE WHEN n_digest_turns < 2 THEN 0 ELSE round(1.96 * sqrt((squares * n_digest_turns - total * total) / CAST(n_digest_turns * (n_digest_turns - 1) AS DOUBLE)) / 100 / sqrt(n_digest_turns), 3) END AS confidence_spread
  FROM (SELECT transcript_id, island, lab AS phase, min(turn) AS turn_start, max(turn) AS turn_end, count(*) AS n_digest_turns, CAST(sum(c) AS BIGINT) AS total, CAST(sum(c * c) AS BIGINT) AS squares, min(c) AS least_
    FROM (SELECT *, sum(new_) OVER (PARTITION BY transcript_id ORDER BY turn) AS island
      FROM (SELECT *, CASE WHEN lag(turn) OVER w IS NULL OR lab IS DISTINCT FROM lag(lab) OVER w THEN 1 ELSE 0 END AS new_
        FROM (SELECT *, CASE WHEN basis IN ('judged', 'filled') THEN label END AS lab, coalesce(conf100, 0) AS c FROM phase) WINDOW w AS (PARTITION BY transcript_id ORDER BY turn)))
    WHERE lab IS NOT NULL GROUP BY ALL)"""
SURFACE = """
  SELECT a.transcript_id, a.turn, CASE WHEN has THEN coalesce(
      last_value(ev IGNORE NULLS) OVER (PARTITION BY a.transcript_id ORDER BY a.turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(ev IGNORE NULLS) OVER (PARTITION BY a.transcript_id ORDER BY a.turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)).i END AS phase_index, a.basis AS own
  FROM phase a
  LEFT JOIN (SELECT transcript_id, turn_start AS turn, {'i': phase_index} AS ev FROM stitched UNION ALL SELECT transcript_id, turn, {'i': NULL} FROM phase WHERE basis = 'refusal') e USING (transcript_id, turn)
  LEFT JOIN (SELECT DISTINCT transcript_id, true AS has FROM stitched) h ON h.transcript_id = a.transcript_id"""


def staged(spark, d):
    tl = ad.timeline(spark, d)
    judged = ad.judged_turns(tl)
    return tl, judged, phases.stitch(judged)


@query("phase_stitch", with_sql("SELECT * FROM stitched", {"stitched": PHASE_RUNS}))
def phase_stitch(spark, d):
    return staged(spark, d)[2]


@query("phase_dense", with_sql("SELECT transcript_id, turn, phase_index, own AS basis FROM surface", {"stitched": PHASE_RUNS, "surface": SURFACE}))
def phase_dense(spark, d):
    _, judged, ph = staged(spark, d)
    return phases.surface(judged.select("transcript_id", "turn"), ph, judged).drop("conf100")


@query(
    "phase_runs",
    with_sql(
        """
        SELECT transcript_id, phase_index, grey, min(turn) AS turn_start, max(turn) AS turn_end
        FROM (SELECT *, sum(new_) OVER (PARTITION BY transcript_id ORDER BY turn) AS island
          FROM (SELECT *, CASE WHEN lag(turn) OVER w IS NULL OR turn <> lag(turn) OVER w + 1 OR grey IS DISTINCT FROM lag(grey) OVER w OR phase_index IS DISTINCT FROM lag(phase_index) OVER w THEN 1 ELSE 0 END AS new_
            FROM (SELECT *, CASE WHEN own = 'refusal' THEN own END AS grey FROM surface) WINDOW w AS (PARTITION BY transcript_id ORDER BY turn)))
        GROUP BY transcript_id, island, phase_index, grey""",
        {"stitched": PHASE_RUNS, "surface": SURFACE},
    ),
)
def phase_runs(spark, d):
    _, judged, ph = staged(spark, d)
    return phases.runs(phases.surface(judged.select("transcript_id", "turn"), ph, judged))


@query(
    "phase_label_runs",
    with_sql(
        """
        SELECT transcript_id, label, min(turn) AS turn_start, max(turn) AS turn_end
        FROM (SELECT *, sum(new_) OVER (PARTITION BY transcript_id ORDER BY turn) AS island
          FROM (SELECT transcript_id, turn, coalesce(label, 'missing') AS label, CASE WHEN lag(turn) OVER w IS NULL OR label IS DISTINCT FROM lag(label) OVER w THEN 1 ELSE 0 END AS new_ FROM phase WINDOW w AS (PARTITION BY transcript_id ORDER BY turn)))
        GROUP BY transcript_id, island, label"""
    ),
)
def phase_label_runs(spark, d):
    tl, judged, _ = staged(spark, d)
    return phases.label_runs(judged, axis.n_turns(tl))


@query(
    "phase_spend",
    with_sql(
        """
        SELECT s.transcript_id, s.phase_index, s.phase, CAST(sum(t.spend) AS BIGINT) AS new_work_tokens FROM stitched s
        LEFT JOIN surface f ON f.transcript_id = s.transcript_id AND f.phase_index = s.phase_index
        LEFT JOIN (SELECT transcript_id, turn, sum(coalesce(new_work, 0)) AS spend FROM views WHERE turn IS NOT NULL GROUP BY ALL) t ON t.transcript_id = f.transcript_id AND t.turn = f.turn
        GROUP BY ALL""",
        {"views": VIEWS, "stitched": PHASE_RUNS, "surface": SURFACE},
    ),
)
def phase_spend(spark, d):
    _, judged, ph = staged(spark, d)
    return phases.phase_spend(ph, phases.dense(judged.select("transcript_id", "turn"), ph, judged), views(spark, d)).select("transcript_id", "phase_index", "phase", "new_work_tokens")


@query(
    "phase_delegated",
    with_sql(
        """
        SELECT p.transcript_id, p.phase_index, count(s.spawn_turn) AS n_subagents, CAST(sum(s.new_work) AS BIGINT) AS delegated_new_work_tokens FROM stitched p
        LEFT JOIN (SELECT transcript_id, span_id, spawn_turn, new_work FROM span LEFT JOIN (SELECT transcript_id, lane AS span_id, sum(new_work) AS new_work FROM views GROUP BY ALL) USING (transcript_id, span_id)) s
          ON s.transcript_id = p.transcript_id AND s.spawn_turn BETWEEN p.turn_start AND p.turn_end
        GROUP BY ALL""",
        {"views": VIEWS, "stitched": PHASE_RUNS},
    ),
)
def phase_delegated(spark, d):
    tl, _, ph = staged(spark, d)
    spend = tokens.lane_spend(views(spark, d)).select("transcript_id", F.col("lane").alias("span_id"), "new_work")
    return phases.phase_delegated(ph, ad.spans(tl).join(spend, ["transcript_id", "span_id"], "left"))


@query(
    "phase_event_flags",
    with_sql(
        """
        SELECT p.transcript_id, p.phase_index, coalesce(bool_or(f.at IN (p.phase_index, p.phase_index - 1)), false) AS event FROM stitched p
        LEFT JOIN (SELECT DISTINCT r.transcript_id, (SELECT max(phase_index) FROM stitched q WHERE q.transcript_id = r.transcript_id AND q.turn_start <= r.turn) AS at FROM recorded r) f ON f.transcript_id = p.transcript_id
        GROUP BY ALL""",
        {"stitched": PHASE_RUNS, "recorded": FLUSHES},
    ),
)
def phase_event_flags(spark, d):
    return phases.event_flags(staged(spark, d)[2], recorded(spark, d))


@query("phase_wedges", with_sql("SELECT transcript_id, phase_index, phase FROM (SELECT *, lag(phase) OVER w AS a, lead(phase) OVER w AS b FROM stitched WINDOW w AS (PARTITION BY transcript_id ORDER BY phase_index)) WHERE n_digest_turns <= 2 AND a = b AND a <> phase", {"stitched": PHASE_RUNS}))
def phase_wedges(spark, d):
    return phases.wedges(staged(spark, d)[2]).select("transcript_id", "phase_index", "phase")


@query(
    "phase_partition_check",
    with_sql(
        """
        SELECT transcript_id, phase_index, 2 - (turn_start = turn_end)::INT AS n_groups, CASE WHEN phase_index % 3 = 0 AND turn_start < turn_end THEN 'invalid_partition' ELSE 'complete' END AS status
        FROM stitched WHERE phase_index % 5 <> 4
        UNION ALL SELECT transcript_id, phase_index, 0, 'empty_groups' FROM stitched WHERE phase_index % 5 = 4""",
        {"stitched": PHASE_RUNS},
    ),
)
def phase_partition_check(spark, d):
    ph = staged(spark, d)[2]
    # groups: the first turn, and the rest, which in every third phase begins a turn late
    late = F.when(F.col("phase_index") % 3 == 0, 1).otherwise(0)
    first = ph.filter("phase_index % 5 <> 4").select("transcript_id", "phase_index", "turn_start", F.col("turn_start").alias("turn_end"))
    rest = ph.filter("phase_index % 5 <> 4 and turn_start < turn_end").select("transcript_id", "phase_index", (F.col("turn_start") + 1 + late).alias("turn_start"), "turn_end")
    return phases.partition_status(first.unionByName(rest), ph)


@query(
    "phase_chips",
    with_sql(
        """
        SELECT transcript_id, label, coalesce(n_phases, 0) AS n_phases, coalesce(n_turns, 0) AS n_turns
        FROM (SELECT DISTINCT transcript_id, unnest(['view', 'click', 'purchase', 'ops']) AS label FROM stitched UNION SELECT transcript_id, phase FROM stitched)
        LEFT JOIN (SELECT transcript_id, phase AS label, count(*) AS n_phases FROM stitched GROUP BY ALL) USING (transcript_id, label)
        LEFT JOIN (SELECT f.transcript_id, s.phase AS label, count(*) AS n_turns FROM surface f JOIN stitched s ON s.transcript_id = f.transcript_id AND s.phase_index = f.phase_index GROUP BY ALL) USING (transcript_id, label)""",
        {"stitched": PHASE_RUNS, "surface": SURFACE},
    ),
)
def phase_chips(spark, d):
    _, judged, ph = staged(spark, d)
    return phases.chip_counts(ph, phases.dense(judged.select("transcript_id", "turn"), ph, judged), ["view", "click", "purchase", "ops"])


@query("phase_coverage", with_sql("SELECT transcript_id, " + ", ".join(f"count(*) FILTER (basis = '{b}') AS {b}" for b in ("judged", "filled", "attributed", "unattributed", "refusal", "no_answer", "missing_turn")) + ", count(*) AS n_turns FROM phase GROUP BY ALL"))
def phase_coverage(spark, d):
    return phases.coverage(staged(spark, d)[1])


@query(
    "phase_colours",
    with_sql(
        "SELECT transcript_id, label, n_turns, row_number() OVER (PARTITION BY transcript_id ORDER BY n_turns DESC, label) - 1 AS slot FROM (SELECT f.transcript_id, s.phase AS label, count(*) AS n_turns FROM surface f JOIN stitched s ON s.transcript_id = f.transcript_id AND s.phase_index = f.phase_index GROUP BY ALL)",
        {"stitched": PHASE_RUNS, "surface": SURFACE},
    ),
)
def phase_colours(spark, d):
    _, judged, ph = staged(spark, d)
    return phases.colour_slots(phases.dense(judged.select("transcript_id", "turn"), ph, judged), ph)
