"""Queries on report rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.operators import axis, phases, report
from turnloom.plans.axis_queries import FLUSHES, PHASE_RUNS, SURFACE, VIEWS, recorded, staged, views
from turnloom.plans.registry import query
from turnloom.sources import adapters as ad
from turnloom.sources.adapters import with_sql


@query(
    "report_cards",
    with_sql(
        """
        SELECT s.transcript_id, s.phase_index, CAST((SELECT sum(ev % 3) FROM tl t WHERE t.transcript_id = s.transcript_id AND t.turn BETWEEN s.turn_start AND s.turn_end) AS BIGINT) AS tool_calls,
          EXISTS (SELECT 1 FROM recorded r WHERE r.transcript_id = s.transcript_id AND r.turn BETWEEN s.turn_start AND s.turn_end) AS compacted,
          EXISTS (SELECT 1 FROM tl t WHERE t.transcript_id = s.transcript_id AND t.turn BETWEEN s.turn_start AND s.turn_end AND t.k % 10 = 7) AS intervened,
          CASE WHEN s.phase_index % 9 = 4 THEN 'overturned' WHEN s.confidence <= 0.6 THEN 'low_confidence' WHEN s.confidence >= 0.8 AND s.phase_index % 2 = 0 THEN 'confident_but_divided' END AS issue
        FROM stitched s""",
        {"stitched": PHASE_RUNS, "recorded": FLUSHES},
    ),
)
def report_cards(spark, d):
    tl, _, ph = staged(spark, d)
    turns = tl.filter("turn is not null")
    p = ph.withColumn("overturned", F.col("phase_index") % 9 == 4).withColumn("agreement", F.when(F.col("phase_index") % 2 == 0, 0.4).otherwise(0.9))
    return report.cards(p, turns.select("transcript_id", "turn", (F.col("ev") % 3).alias("n_tool_calls")), recorded(spark, d), turns.filter("k % 10 = 7")).select("transcript_id", "phase_index", "tool_calls", "compacted", "intervened", "issue")


@query("report_summary", with_sql("SELECT transcript_id, n_turns, n_judged, n_phases, n_labels FROM (SELECT transcript_id, count(*) AS n_turns, count(*) FILTER (basis IN ('judged', 'filled')) AS n_judged FROM phase GROUP BY ALL) LEFT JOIN (SELECT transcript_id, count(*) AS n_phases, count(DISTINCT phase) AS n_labels FROM stitched GROUP BY ALL) USING (transcript_id)", {"stitched": PHASE_RUNS}))
def report_summary(spark, d):
    _, judged, ph = staged(spark, d)
    return report.summary(ph, judged).drop("confidence")  # a rounded mean of decimals: engines differ at ties


@query("report_band", with_sql("SELECT transcript_id, turn, string_agg(model || ': ' || coalesce(label, basis), '; ' ORDER BY model) AS votes FROM (SELECT transcript_id, turn, 'm' || g AS model, label, basis FROM phase, (SELECT unnest([1, 2]) AS g)) GROUP BY ALL", {}))
def report_band(spark, d):
    _, judged, ph = staged(spark, d)
    votes = judged.withColumn("model", F.explode(F.array(F.lit("x/m1"), F.lit("x/m2")))).withColumn("roll", F.lit(0))
    return report.band(phases.surface(judged.select("transcript_id", "turn"), ph, judged), ph, votes)[1]


@query("report_band_runs", with_sql("SELECT transcript_id, fill, count(*) AS runs FROM (SELECT transcript_id, count(*) AS n FROM (SELECT *, CASE WHEN lag(turn) OVER w IS NULL OR own_ IS DISTINCT FROM lag(own_) OVER w OR phase_index IS DISTINCT FROM lag(phase_index) OVER w THEN 1 END AS new_ FROM (SELECT *, CASE WHEN own = 'refusal' THEN own END AS own_ FROM surface) WINDOW w AS (PARTITION BY transcript_id ORDER BY turn)) WHERE new_ = 1 GROUP BY transcript_id, turn), (SELECT unnest(['plain', 'confidence']) AS fill) GROUP BY ALL", {"stitched": PHASE_RUNS, "surface": SURFACE}))
def report_band_runs(spark, d):
    _, judged, ph = staged(spark, d)
    return report.band(phases.surface(judged.select("transcript_id", "turn"), ph, judged), ph)[0].groupBy("transcript_id", "fill").agg(F.count(F.lit(1)).alias("runs"))


@query("report_tokens", with_sql("SELECT transcript_id, turn, context, new_work AS measure, turn_total, CAST(sum(billable) OVER (PARTITION BY transcript_id ORDER BY turn) AS BIGINT) AS cumulative FROM views WHERE turn IS NOT NULL", {"views": VIEWS}))
def report_tokens(spark, d):
    f = recorded(spark, d).withColumn("source", F.lit("recorded")).withColumn("tokens_after_inferred", F.lit(False))
    return report.token_chart(views(spark, d), f).drop("flush")


@query("report_geometry", with_sql("SELECT transcript_id, span_id, greatest(x0 - greatest(w - r, 0), -0.5) AS x0, least(w, r) AS x1, x1 > x0 AS boxed, x1 <= -0.5 AS before_first, x0 >= r AS after_last FROM (SELECT *, greatest(x1, x0 + 6.0 * n / least(greatest(n * 1.6, 1000.0), 3000.0)) AS w, n - 0.5 AS r FROM (SELECT transcript_id, span_id, CAST(spawn_turn AS DOUBLE) AS x0, CAST(spawn_turn + 1 AS DOUBLE) AS x1, CAST(n AS DOUBLE) AS n FROM span JOIN (SELECT transcript_id, max(turn) + 1 AS n FROM tl GROUP BY ALL) USING (transcript_id)))"))
def report_geometry(spark, d):
    tl = ad.timeline(spark, d)
    s = ad.spans(tl).select("transcript_id", "span_id", F.col("spawn_turn").cast("double").alias("x0"), (F.col("spawn_turn") + 1).cast("double").alias("x1"))
    return report.geometry(s, axis.n_turns(tl))


@query("report_events", with_sql("SELECT transcript_id, turn - 0.5 AS x, event_type AS channel, CASE WHEN length(event_type) > 60 THEN substr(event_type, 1, 60) || '…' ELSE event_type END AS preview FROM tl WHERE turn IS NOT NULL"))
def report_events(spark, d):
    t = ad.timeline(spark, d).filter("turn is not null")
    return report.event_marks(t.select("transcript_id", "turn", F.col("event_type").alias("channel"), F.col("event_type").alias("content"))).withColumn("x", F.col("x").cast("double"))


@query("report_flush_list", with_sql("SELECT transcript_id, lane, ev, row_number() OVER (PARTITION BY transcript_id, lane ORDER BY turn, lane_turn, ev) - 1 AS position FROM recorded", {"recorded": FLUSHES}))
def report_flush_list(spark, d):
    return report.flush_list(recorded(spark, d).withColumn("source", F.col("ev"))).select("transcript_id", "lane", "ev", "position")


@query("report_judge_cells", with_sql("SELECT transcript_id, label, list_sort(list(DISTINCT basis)) AS label_sources, count(*) FILTER (turn % 3 = 0) AS reviewed, count(*) FILTER (turn % 6 = 0) AS overturned FROM phase WHERE label IS NOT NULL AND conf100 IS NOT NULL GROUP BY ALL"))
def report_judge_cells(spark, d):
    j = staged(spark, d)[1].filter("label is not null and conf100 is not null")
    rows = j.select("transcript_id", "label", (F.col("conf100") / 100).alias("confidence"), F.lit(None).cast("double").alias("agreement"), F.col("basis").alias("label_source"), (F.col("turn") % 3 == 0).alias("reviewed"), (F.col("turn") % 6 == 0).alias("overturned"))
    return report.judge_cells(rows, ["transcript_id", "label"]).drop("agreement", "confidence")


@query("report_first_known", with_sql("SELECT transcript_id, arg_min(input_tokens, ev) FILTER (input_tokens IS NOT NULL) AS input_tokens, arg_min(role, ev) FILTER (role IS NOT NULL) AS role FROM tl GROUP BY ALL"))
def report_first_known(spark, d):
    return report.first_known(ad.timeline(spark, d), ["transcript_id"], "ev", ["input_tokens", "role"])
