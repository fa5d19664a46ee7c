"""Queries on the judges' side: setups, prompts, scripted answers, phases out of them, audits of a judged surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.operators import judging, phases, reliability as rel, voting
from turnloom.plans.axis_queries import PHASE_RUNS, staged
from turnloom.plans.judge_queries import DECIDED, DONE, UNIT, VOTED, agreement_sql, reviews, wilson_sql
from turnloom.plans.registry import query
from turnloom.shared import written
from turnloom.sources import adapters as ad
from turnloom.sources.adapters import with_sql

#: Digest turns, and the chunks of forty that a call judges.
DIG = "SELECT transcript_id, turn, event_type AS label, k, (row_number() OVER (PARTITION BY transcript_id ORDER BY turn) - 1) // 40 AS chunk FROM tl WHERE turn IS NOT NULL"
CHUNK = "SELECT transcript_id, chunk, string_agg('Turn ' || turn || ': did ' || label, chr(10) ORDER BY turn) AS prompt, min(turn) AS first_, max(turn) AS last_ FROM dig GROUP BY ALL"


def digests(spark, d):
    t = ad.timeline(spark, d).filter("turn is not null")
    return t.select("transcript_id", "turn", F.concat(F.lit("did "), "event_type").alias("line"))


def prompts(spark, d):
    return judging.chunks(digests(spark, d))


def scripted(asked):
    """A cache with an answer for each call: two segments of the chunk by one judge, one by the other, which refuses every third chunk."""
    whole = F.concat(F.lit('{"segments":[{"turn_start":'), F.col("first") - 5, F.lit(',"turn_end":'), F.col("last") - 3, F.lit(',"phase":"plan","confidence":0.5,"explanation":"x"},{"turn_start":'), F.col("last") - 2, F.lit(',"turn_end":'), F.col("last") + 9, F.lit(',"phase":"odd","confidence":0.5,"explanation":""}]}'))
    one = F.concat(F.lit('{"segments":[{"turn_start":'), "first", F.lit(',"turn_end":'), "last", F.lit(',"phase":"ship","confidence":0.75,"explanation":"y"}]}'))
    refused = (F.col("model") == "m2") & (F.col("chunk") % 3 == 2)
    return asked.select("prompt_key", "model", "roll", F.when(refused, None).when(F.col("model") == "m1", whole).otherwise(one).alias("value"), F.when(refused, "refusal").otherwise("ok").alias("status")).dropDuplicates(["prompt_key", "model", "roll"])


def asked(spark, d):
    return judging.calls(prompts(spark, d), judging.members(["m1", "m2"]), "Name the phases.")


@query("judge_setups", with_sql("SELECT * FROM (VALUES ('solo', 1, 1, true, true, 'a'), ('k_roll', 1, 3, true, false, 'a'), ('cohort', 2, 1, false, false, 'a,b')) v(regime, n_models, k_rolls, verifier_armed, verifier_same_model, models)", {}))
def judge_setups(spark, d):
    """VOT-03..05."""
    rows = []
    for models, k, verifier in ((["a"], 1, "a"), (["a"], 3, "v"), (["a", "b"], 1, None)):
        who = judging.members(models, k)
        s = judging.setup(sorted({m.model for m in who}), len({m.roll for m in who}), judging.verify_armed(len(models)), verifier)
        rows.append((s["regime"], s["n_models"], s["k_rolls"], s["verifier_armed"], s["verifier_same_model"], ",".join(s["models"])))
    return spark.createDataFrame(rows, "regime string, n_models int, k_rolls int, verifier_armed boolean, verifier_same_model boolean, models string")


@query("judge_prompts", with_sql("SELECT transcript_id, chunk, prompt, first_ AS first, last_ AS last, m AS model, 0 AS roll, sha256('Name the phases.' || chr(31) || prompt) AS prompt_key FROM chunk, (SELECT unnest(['m1', 'm2']) AS m)", {"dig": DIG, "chunk": CHUNK}))
def judge_prompts(spark, d):
    """VOT-14, VOT-19: a call for each chunk and member, known by what its answer depends on."""
    return asked(spark, d).drop("system")


@query("judge_answers", with_sql("SELECT transcript_id, chunk, m AS model, CASE WHEN m = 'm2' AND chunk % 3 = 2 THEN 'refusal' ELSE 'ok' END AS status, m <> 'm2' OR chunk % 3 <> 2 AS answered FROM chunk, (SELECT unnest(['m1', 'm2']) AS m)", {"dig": DIG, "chunk": CHUNK}))
def judge_answers(spark, d):
    """VOT-18, VOT-21: half of the answers from the cache, the others by a scripted judge that fails at first."""
    a = written(asked(spark, d), "asked")
    cache = scripted(a.filter("model = 'm2'"))
    known = {r["prompt_key"]: r["value"] for r in scripted(a.filter("model = 'm1' and chunk = 0")).collect()}
    tried = set()

    def judge(system, prompt, model, roll):
        if (prompt, model) not in tried:
            tried.add((prompt, model))
            return None, "error"
        return next(iter(known.values()), "{}"), "ok"

    got = judging.answered(a, cache, judge)
    return got.select("transcript_id", "chunk", "model", "status", F.col("value").isNotNull().alias("answered"))


SEGMENT = """SELECT transcript_id, chunk, 'm1' AS model, 0 AS ord, first_ AS a, last_ - 3 AS b, 'plan' AS phase, CAST(0.5 AS DOUBLE) AS confidence FROM chunk WHERE first_ <= last_ - 3
  UNION ALL SELECT transcript_id, chunk, 'm2', 0, first_, last_, 'ship', CAST(0.75 AS DOUBLE) FROM chunk WHERE chunk % 3 <> 2"""


@query("judge_segments", with_sql("SELECT transcript_id, chunk, model, ord, a AS turn_start, b AS turn_end, phase, confidence FROM segment", {"dig": DIG, "chunk": CHUNK, "segment": SEGMENT}))
def judge_segments(spark, d):
    """VOT-14, VOT-20, WIN-08: segments of scripted answers, in the vocabulary and within their chunk."""
    a = written(asked(spark, d), "asked")
    s = judging.segments(judging.answered(a, scripted(a)), ["plan", "ship"])
    each = [phases.valid_segments(s.filter(F.col("model") == m)).withColumn("model", F.lit(m)) for m in ("m1", "m2")]
    return each[0].unionByName(each[1]).select("transcript_id", "chunk", "model", "ord", "turn_start", "turn_end", "phase", "confidence")


@query(
    "judge_phases",
    with_sql(
        """SELECT transcript_id, turn, model, last_value(own IGNORE NULLS) OVER w AS label, CASE WHEN own IS NOT NULL THEN 'judged' WHEN last_value(own IGNORE NULLS) OVER w IS NOT NULL THEN 'filled' ELSE 'missing_turn' END AS basis
        FROM (SELECT g.transcript_id, g.turn, m.model, s.phase AS own FROM dig g CROSS JOIN (SELECT unnest(['m1', 'm2']) AS model) m LEFT JOIN segment s ON s.transcript_id = g.transcript_id AND s.chunk = g.chunk AND s.model = m.model AND g.turn BETWEEN s.a AND s.b)
        WINDOW w AS (PARTITION BY transcript_id, model ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        {"dig": DIG, "chunk": CHUNK, "segment": SEGMENT},
    ),
)
def judge_phases(spark, d):
    """VOT-14: from prompts by scripted answers to each member's label of every digest turn."""
    a = written(asked(spark, d), "asked")
    s = written(judging.segments(judging.answered(a, scripted(a)), ["plan", "ship"]), "segments")
    i = F.row_number().over(ad.Window.partitionBy("transcript_id").orderBy("turn")) - 1
    turns = written(digests(spark, d).select("transcript_id", "turn", F.floor(i / 40).cast("bigint").alias("chunk")), "turns")
    each = [phases.project_chunks(turns, phases.valid_segments(s.filter(F.col("model") == m))).withColumn("model", F.lit(m)) for m in ("m1", "m2")]
    return each[0].unionByName(each[1]).select("transcript_id", "turn", "model", "label", "basis")


@query("judge_labels", with_sql("SELECT o_orderkey AS unit, 'm1' AS model, CASE WHEN o_orderkey % 9 > 0 AND o_orderstatus IN ('F', 'O') THEN o_orderstatus END AS label, CASE WHEN o_orderkey % 9 > 0 AND o_orderstatus IN ('F', 'O') THEN CAST(0.5 AS DOUBLE) END AS confidence, CASE WHEN o_orderkey % 9 = 0 THEN 'refusal' WHEN o_orderstatus IN ('F', 'O') THEN 'ok' ELSE 'no_answer' END AS status FROM orders"))
def judge_labels(spark, d):
    """VOT-15, VOT-20: single answers against a closed vocabulary."""
    o = ad.read(spark, d, "orders")
    bad = F.col("o_orderkey") % 9 == 0
    value = F.concat(F.lit('{"label":"'), "o_orderstatus", F.lit('","confidence":0.5,"explanation":"because"}'))
    a = o.select(F.col("o_orderkey").alias("unit"), F.lit("m1").alias("model"), F.lit(0).alias("roll"), F.when(~bad, value).alias("value"), F.when(bad, "refusal").otherwise("ok").alias("status"))
    return judging.classified(a, ["F", "O"]).select("unit", "model", "label", "confidence", "status")


@query("judge_narration", with_sql("SELECT transcript_id, phase_index, CASE WHEN phase_index % 2 = 0 THEN 'About ' || phase ELSE phase || ', turns ' || turn_start || ' to ' || turn_end END AS headline, CASE WHEN phase_index % 2 = 0 THEN 'more' ELSE '' END AS summary, CASE WHEN phase_index % 2 = 0 THEN 'complete' ELSE 'no_narrative' END AS narration FROM stitched", {"stitched": PHASE_RUNS}))
def judge_narration(spark, d):
    """VOT-16."""
    ph = staged(spark, d)[2]
    told = ph.filter("phase_index % 2 = 0").select("transcript_id", "phase_index", F.concat(F.lit("About "), "phase").alias("headline"), F.lit("more").alias("summary"))
    return judging.narrated(ph.select("transcript_id", "phase_index", "phase", "turn_start", "turn_end"), told).select("transcript_id", "phase_index", "headline", "summary", "narration")


@query("judge_evidence", with_sql("SELECT s.transcript_id, s.phase_index, CASE WHEN count(*) <= 4 THEN string_agg('did ' || g.label, chr(10) ORDER BY g.turn) ELSE array_to_string(list('did ' || g.label ORDER BY g.turn)[1:2], chr(10)) || chr(10) || '[... ' || (count(*) - 4) || ' turns elided ...]' || chr(10) || array_to_string(list('did ' || g.label ORDER BY g.turn)[-2:], chr(10)) END AS evidence FROM stitched s JOIN dig g ON g.transcript_id = s.transcript_id AND g.turn BETWEEN s.turn_start AND s.turn_end GROUP BY s.transcript_id, s.phase_index", {"stitched": PHASE_RUNS, "dig": DIG}))
def judge_evidence(spark, d):
    """VOT-17."""
    return judging.evidence(staged(spark, d)[2], digests(spark, d), 4)


@query("judge_vocabulary", with_sql("SELECT * FROM (VALUES ('phases', '- plan: think' || chr(10) || '- ship')) v(surface, lines)", {}))
def judge_vocabulary(spark, d):
    """VOT-19."""
    return judging.vocabulary_lines(spark.createDataFrame([("phases", "ship", None, 1), ("phases", "plan", "think", 0)], "surface string, label string, description string, ord int"))


@query("judge_batches", with_sql("SELECT transcript_id AS call_id, i AS item, CASE WHEN i % 3 > 0 THEN 'a' || i END AS label, CASE WHEN i % 3 > 0 THEN CAST(0.5 AS DOUBLE) END AS confidence, CASE WHEN i % 3 > 0 THEN 'ok' ELSE 'no_answer' END AS status FROM (SELECT DISTINCT transcript_id FROM tl), (SELECT unnest([1, 2, 3, 4]) AS i)"))
def judge_batches(spark, d):
    """VOT-11: answers of batched calls by item; repeated, unknown and missing numbers."""
    t = ad.timeline(spark, d).select(F.col("transcript_id").alias("call_id")).distinct()
    items = lambda *n: t.select("call_id", F.posexplode(F.array(*[F.lit(x) for x in n])).alias("ord", "item"))
    answers = items(1, 2, 2, 9, 4).withColumn("label", F.when(F.col("ord") == 2, "late").otherwise(F.concat(F.lit("a"), "item"))).withColumn("confidence", F.lit(0.5))
    return voting.batch_answers(answers, items(1, 2, 3, 4).drop("ord"))


@query("judge_regime", with_sql("SELECT 'cohort' AS kind, ['m1', 'm2'] AS models, 'm2' AS verifier_model, true AS verifier_on, true AS verifier_same_model", {}))
def judge_regime(spark, d):
    """REL-01, REL-18."""
    t = ad.timeline(spark, d).filter("turn is not null")
    frame = t.select(F.when(F.col("k") % 2 == 0, "cohort").alias("judge_regime"), F.array(F.lit("m1"), F.lit("m2")).alias("judge_models"), F.when(F.col("k") % 4 == 0, "m2").alias("verifier_model"), F.struct("transcript_id", "turn").alias("ord"))
    return rel.regime(frame)


@query("review_units", with_sql("SELECT transcript_id, p AS original_phase_index, max(phase_index) % 2 = 0 AS overturned, 'b' AS verifier_label, true AS completed FROM (SELECT transcript_id, phase_index, phase_index // 3 AS p FROM stitched) GROUP BY ALL", {"stitched": PHASE_RUNS}))
def review_units(spark, d):
    """REL-06, SET-04: of reviews that several phases list, the last one written."""
    one = F.struct(F.expr("phase_index div 3").alias("original_phase_index"), (F.col("phase_index") % 2 == 0).alias("overturned"), F.lit("b").alias("verifier_label"))
    ph = staged(spark, d)[2].select("transcript_id", "phase_index", F.array(one).alias("verifier_reviews"))
    return rel.review_units(ph).select("transcript_id", "original_phase_index", "overturned", "verifier_label", "completed")


def audit(spark, d):
    b = written(ad.ballots(spark, d), "ballots")
    units = voting.decide(voting.vote(b, UNIT), ad.reviews(spark, d), UNIT).withColumn("attempted", F.col("unit") % 4 > 0).withColumn("label", F.when(F.col("unit") % 10 > 0, F.col("label")))
    declared = spark.createDataFrame([("R", 0), ("A", 1)], "label string, ord int")
    return rel.entity_audit(written(units, "units"), b, written(reviews(spark, d), "reviews"), UNIT, declared, ("status", "ok", ["refusal", "error", "no_answer"]))


AUDIT = {
    "voted": VOTED, "decided": DECIDED, "done": DONE, "unit_": "SELECT *, unit % 4 > 0 AS attempted, CASE WHEN unit % 10 > 0 THEN label END AS lab FROM decided",
    "per_label": "SELECT transcript_id, unit, label, count(*) AS n FROM bal WHERE label IS NOT NULL GROUP BY ALL", "per_unit": "SELECT transcript_id, unit, CAST(sum(n) AS BIGINT) AS m, CAST(sum(n * n) AS BIGINT) AS q FROM per_label GROUP BY ALL HAVING sum(n) >= 2",
    "stat": agreement_sql("bal", "transcript_id, unit"),
}


@query(
    "audit_flags",
    with_sql(
        """SELECT metric, round(value, 9) AS value, level FROM (SELECT metric, value, CASE WHEN metric = 'alpha' AND value < 0.66 THEN 'red' WHEN metric = 'alpha' AND value < 0.8 THEN 'amber' WHEN metric LIKE 'relabel%' AND value >= 0.2 THEN 'amber' WHEN metric = 'spot_check' AND value > 0 THEN 'red' WHEN metric = 'unjudged' AND value >= 0.25 THEN 'red' WHEN metric = 'unjudged' AND value > 0 THEN 'amber' END AS level FROM (
          SELECT 'alpha' AS metric, alpha AS value FROM stat
          UNION ALL SELECT 'relabel', count(*) FILTER (overturned) / CAST(count(*) AS DOUBLE) FROM done WHERE completed
          UNION ALL SELECT 'relabel_label', count(*) FILTER (overturned) / CAST(count(*) AS DOUBLE) FROM done WHERE completed AND original_label IS NOT NULL GROUP BY original_label
          UNION ALL SELECT 'spot_check', count(*) FILTER (overturned) / CAST(count(*) AS DOUBLE) FROM done WHERE completed AND trigger = 'random_sample'
          UNION ALL SELECT 'unjudged', count(*) FILTER (lab IS NULL) / CAST(count(*) AS DOUBLE) FROM unit_ WHERE attempted)) WHERE level IS NOT NULL""",
        AUDIT,
    ),
)
def audit_flags(spark, d):
    """REL-16, REL-15."""
    return audit(spark, d)["flags"].select("metric", F.round("value", 9).alias("value"), "level")


@query("audit_coverage", with_sql(f"SELECT model, roll, {wilson_sql('k', 'n', 'produced')}, missed_refusal, missed_error, missed_no_answer FROM (SELECT model, roll, count(*) FILTER (status = 'ok') AS k, count(*) AS n, count(*) FILTER (status = 'refusal') AS missed_refusal, count(*) FILTER (status = 'error') AS missed_error, count(*) FILTER (status = 'no_answer') AS missed_no_answer FROM bal GROUP BY ALL)"))
def audit_coverage(spark, d):
    """REL-16, REL-10."""
    return audit(spark, d)["coverage"]


@query("audit_tiers", with_sql("SELECT count(*) FILTER (confidence >= 0.8) AS high, count(*) FILTER (confidence < 0.8 AND confidence >= 0.66) AS medium, count(*) FILTER (confidence < 0.66) AS low, count(confidence) AS n FROM unit_", AUDIT))
def audit_tiers(spark, d):
    """REL-16, REL-14."""
    return audit(spark, d)["tiers"]


@query("unauditable_layer", with_sql("SELECT 'mine can''t be audited: it lacks label_source, members' AS said", {}))
def unauditable_layer(spark, d):
    """REL-16, UDF-03."""
    frame = spark.range(1).selectExpr("id AS confidence", "id AS judge_agreement")
    return spark.createDataFrame([(rel.unauditable("mine", frame, ["confidence", "judge_agreement", "label_source", "members"]),)], "said string")
