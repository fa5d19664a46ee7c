"""Queries on votes, reviews and reliability."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.operators import phases, reliability as rel, voting
from turnloom.plans.axis_queries import PHASE_RUNS, staged
from turnloom.plans.registry import query
from turnloom.shared import written
from turnloom.sources import adapters as ad
from turnloom.sources.adapters import with_sql

VOTED = """
  SELECT transcript_id, unit, label, n_voting, round(n / CAST(n_voting AS DOUBLE), 3) AS agreement, round(total / CAST(stated AS DOUBLE) / 10, 3) AS confidence,
    CASE WHEN stated < 2 THEN 0 ELSE round(1.96 * sqrt((squares * stated - total * total) / CAST(stated * (stated - 1) AS DOUBLE)) / 10 / sqrt(stated), 3) END AS confidence_pm
  FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY transcript_id, unit) AS BIGINT) AS n_voting, row_number() OVER (PARTITION BY transcript_id, unit ORDER BY n DESC, total / CAST(n AS DOUBLE) DESC, first) AS r
    FROM (SELECT transcript_id, unit, label, count(*) AS n, CAST(sum(conf10) AS BIGINT) AS total, count(conf10) AS stated, CAST(sum(conf10 * conf10) AS BIGINT) AS squares, min(ord) AS first FROM bal WHERE label IS NOT NULL GROUP BY ALL))
  WHERE r = 1"""
DECIDED = """
  SELECT v.transcript_id, v.unit, CASE WHEN o THEN r.verifier_label ELSE v.label END AS label, CASE WHEN o THEN 'verifier' ELSE 'majority_vote' END AS label_source, o AS overturned, agreement, n_voting, confidence
  FROM (SELECT v.*, r.verifier_label, coalesce(r.verifier_label IS NOT NULL AND r.verifier_label <> v.label AND r.verifier_conf100 >= 60, false) AS o FROM voted v LEFT JOIN rev r USING (transcript_id, unit)) v
  LEFT JOIN rev r USING (transcript_id, unit)"""
UNIT = ["transcript_id", "unit"]


def wilson_sql(k, n, name):
    p, z = f"({k} / CAST({n} AS DOUBLE))", "1.96"
    low = f"(({p} + {z}*{z}/(2*{n})) - {z}*sqrt({p}*(1-{p})/{n} + {z}*{z}/(4.0*{n}*{n}))) / (1 + {z}*{z}/{n})"
    high = low.replace(f") - {z}*sqrt", f") + {z}*sqrt")
    return f"{k} AS {name}_count, {n} AS {name}_of, CASE WHEN {n} > 0 THEN {p} END AS {name}_rate, CASE WHEN {n} > 0 THEN greatest({low}, 0.0) END AS {name}_low, CASE WHEN {n} > 0 THEN least({high}, 1.0) END AS {name}_high"


def voted(spark, d):
    return voting.vote(ad.ballots(spark, d), UNIT)


def decided(spark, d):
    return voting.decide(voted(spark, d), ad.reviews(spark, d), UNIT)


def reviews(spark, d):
    return rel.completed(ad.reviews(spark, d))


@query("vote_units", with_sql("SELECT * FROM voted", {"voted": VOTED}))
def vote_units(spark, d):
    return voted(spark, d)


@query("vote_decided", with_sql("SELECT * FROM decided", {"voted": VOTED, "decided": DECIDED}))
def vote_decided(spark, d):
    return decided(spark, d)


@query("vote_failures", with_sql("SELECT transcript_id, unit, CASE WHEN bool_and(status = 'refusal') THEN 'refusal' ELSE 'no_answer' END AS status FROM bal GROUP BY ALL HAVING count(label) = 0"))
def vote_failures(spark, d):
    return voting.failure_status(ad.ballots(spark, d), UNIT)


@query(
    "verify_triggers",
    with_sql("SELECT transcript_id, unit, CASE WHEN confidence < 0.6 THEN 'low_confidence' WHEN n_voting >= 2 AND agreement < 0.6 THEN 'low_agreement' END AS trigger FROM voted", {"voted": VOTED}),
)
def verify_triggers(spark, d):
    return voted(spark, d).select(*UNIT, voting.doubt(F.col("confidence"), F.col("agreement"), F.col("n_voting")).alias("trigger"))


CONSENSUS_IN = "SELECT transcript_id, unit // 8 AS turn, ord, CASE WHEN status = 'refusal' THEN 'refusal' WHEN conf10 >= 9 THEN 'filled' ELSE 'judged' END AS basis, CASE WHEN status = 'ok' AND conf10 < 9 THEN label END AS label, conf10 FROM bal"


@query(
    "vote_consensus",
    with_sql(
        """
        SELECT transcript_id, turn, coalesce(label, CASE WHEN fill THEN carried END) AS label, CASE WHEN label IS NOT NULL THEN 'judged' WHEN fill THEN 'filled' ELSE coalesce(status, 'missing_turn') END AS basis,
          coalesce(confidence, CASE WHEN fill THEN 0.3 END) AS confidence, CASE WHEN n_voting >= 2 THEN agreement END AS agreement, n_voting
        FROM (SELECT *, label IS NULL AND filled AND carried IS NOT NULL AS fill FROM (
          SELECT m.transcript_id, m.turn, m.filled, v.label, v.confidence, v.agreement, v.n_voting, s.status,
            last_value(v.label IGNORE NULLS) OVER (PARTITION BY m.transcript_id ORDER BY m.turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried
          FROM (SELECT transcript_id, turn, bool_or(basis = 'filled') AS filled FROM members GROUP BY ALL) m
          LEFT JOIN (SELECT transcript_id, turn, label, round(n / CAST(n_voting AS DOUBLE), 3) AS agreement, n_voting, round(total / CAST(n AS DOUBLE) / 10, 3) AS confidence
            FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY transcript_id, turn) AS BIGINT) AS n_voting, row_number() OVER (PARTITION BY transcript_id, turn ORDER BY n DESC, total / CAST(n AS DOUBLE) DESC, first) AS r
              FROM (SELECT transcript_id, turn, label, count(*) AS n, CAST(sum(conf10) AS BIGINT) AS total, min(ord) AS first FROM members WHERE basis = 'judged' AND label IS NOT NULL GROUP BY ALL)) WHERE r = 1) v USING (transcript_id, turn)
          LEFT JOIN (SELECT transcript_id, turn, arg_max(basis, (n, -first)) AS status FROM (SELECT transcript_id, turn, basis, count(*) AS n, min(ord) AS first FROM members WHERE basis NOT IN ('judged', 'filled') GROUP BY ALL) GROUP BY ALL) s USING (transcript_id, turn)))""",
        {"members": CONSENSUS_IN},
    ),
)
def vote_consensus(spark, d):
    b = ad.ballots(spark, d)
    basis = F.when(F.col("status") == "refusal", "refusal").when(F.col("conf10") >= 9, "filled").otherwise("judged")
    return voting.consensus(b.select("transcript_id", F.expr("unit div 8").alias("turn"), "ord", basis.alias("basis"), F.when((F.col("status") == "ok") & (F.col("conf10") < 9), F.col("label")).alias("label"), "conf10"))


def agreement_sql(source, unit, scope=""):
    s = f"{scope}, " if scope else ""
    on = f"USING ({scope})" if scope else "ON true"
    return f"""
      SELECT {s}n_units, same / CAST(all_ AS DOUBLE) AS percent, CASE WHEN r * r <> cc THEN 1 - (r - 1) * apart / (r * r - cc) END AS alpha,
        CASE WHEN q >= 2 THEN (same / CAST(all_ AS DOUBLE) - (1 - cc / CAST(r * r AS DOUBLE)) / (q - 1)) / (1 - (1 - cc / CAST(r * r AS DOUBLE)) / (q - 1)) END AS ac1
      FROM (SELECT {s}count(*) AS n_units, CAST(sum(q - m) AS BIGINT) AS same, CAST(sum(m * (m - 1)) AS BIGINT) AS all_, sum((m * m - q) / CAST(m - 1 AS DOUBLE)) AS apart FROM per_unit GROUP BY ALL) u
      JOIN (SELECT {s}count(*) AS q, CAST(sum(c) AS BIGINT) AS r, CAST(sum(c * c) AS BIGINT) AS cc FROM (SELECT {s}label, sum(n) AS c FROM per_label JOIN (SELECT {unit} FROM per_unit) USING ({unit}) GROUP BY ALL) GROUP BY ALL) l {on}"""


def agreement_query(source, unit, scope=""):
    return with_sql(
        agreement_sql(source, unit, scope),
        {"per_label": f"SELECT {unit}, label, count(*) AS n FROM {source} WHERE label IS NOT NULL GROUP BY ALL", "per_unit": f"SELECT {unit}, CAST(sum(n) AS BIGINT) AS m, CAST(sum(n * n) AS BIGINT) AS q FROM per_label GROUP BY ALL HAVING sum(n) >= 2"},
    )


@query("agree_ballots", agreement_query("bal", "transcript_id, unit"))
def agree_ballots(spark, d):
    return rel.agreement(ad.ballots(spark, d), UNIT)


@query("agree_by_transcript", agreement_query("bal", "transcript_id, unit", "transcript_id"))
def agree_by_transcript(spark, d):
    return rel.agreement(ad.ballots(spark, d), ["unit"], ["transcript_id"])


@query("agree_raters", agreement_query("lab", "unit"))
def agree_raters(spark, d):
    return rel.agreement(ad.raters(spark, d), ["unit"])


@query("member_coverage", with_sql(f"SELECT model, roll, {wilson_sql('k', 'n', 'produced')}, missed_refusal, missed_error, missed_no_answer FROM (SELECT model, roll, count(*) FILTER (status = 'ok') AS k, count(*) AS n, count(*) FILTER (status = 'refusal') AS missed_refusal, count(*) FILTER (status = 'error') AS missed_error, count(*) FILTER (status = 'no_answer') AS missed_no_answer FROM bal GROUP BY ALL)"))
def member_coverage(spark, d):
    return rel.member_coverage(ad.ballots(spark, d), "status", "ok", ["refusal", "error", "no_answer"])


DONE = "SELECT *, coalesce(trim(verifier_label) <> '', false) AS completed FROM rev"


@query("relabel_rate", with_sql(f"SELECT overall, label, {wilson_sql('k', 'n', 'relabel')} FROM (SELECT true AS overall, NULL AS label, count(*) FILTER (overturned) AS k, count(*) AS n FROM done WHERE completed UNION ALL SELECT false, original_label, count(*) FILTER (overturned), count(*) FROM done WHERE completed AND original_label IS NOT NULL GROUP BY ALL)", {"done": DONE}))
def relabel_rate(spark, d):
    return rel.relabel_rate(reviews(spark, d))


@query("spot_check", with_sql(f"SELECT {wilson_sql('k', 'n', 'overturned')} FROM (SELECT count(*) FILTER (overturned) AS k, count(*) AS n FROM done WHERE completed AND trigger = 'random_sample')", {"done": DONE}))
def spot_check(spark, d):
    return rel.spot_check(reviews(spark, d))


@query("verifier_tallies", with_sql("SELECT trigger, count(*) AS selected, count(*) FILTER (completed) AS completed, count(*) FILTER (overturned) AS relabelled, count(*) FILTER (completed AND NOT overturned AND verifier_label <> original_label) AS weak FROM done GROUP BY ALL", {"done": DONE}))
def verifier_tallies(spark, d):
    weak = F.col("completed") & ~F.col("overturned") & (F.col("verifier_label") != F.col("original_label"))
    return reviews(spark, d).groupBy("trigger").agg(F.count(F.lit(1)).alias("selected"), F.count_if("completed").alias("completed"), F.count_if("overturned").alias("relabelled"), F.count_if(weak).alias("weak"))


@query("provenance_shares", with_sql("SELECT l AS label, s AS label_source, (SELECT count(*) FROM decided d WHERE d.label = l AND d.label_source = s) AS n FROM (SELECT unnest(['A', 'N', 'R', 'F', 'O', 'P']) AS l), (SELECT unnest(['single_judge', 'majority_vote', 'verifier']) AS s)", {"voted": VOTED, "decided": DECIDED}))
def provenance_shares(spark, d):
    return rel.provenance(decided(spark, d), ["A", "N", "R", "F", "O", "P"])


@query(
    "label_stats",
    with_sql(
        """
        SELECT label, coalesce(n, 0) AS n, agreement, confidence, coalesce(reviewed, 0) AS reviewed, coalesce(relabelled, 0) AS relabelled, coalesce(spot_checked, 0) AS spot_checked, coalesce(votes, 0) AS votes, coalesce(minority, 0) AS minority,
          row_number() OVER (ORDER BY ord, label) - 1 AS position
        FROM (SELECT unnest(['R', 'A', 'X']) AS label, unnest([0, 1, 2]) AS ord UNION ALL SELECT DISTINCT label, 1000 FROM decided WHERE label NOT IN ('R', 'A', 'X')) s
        LEFT JOIN (SELECT label, count(*) AS n, avg(agreement) AS agreement, avg(confidence) AS confidence FROM decided WHERE label IS NOT NULL GROUP BY ALL) USING (label)
        LEFT JOIN (SELECT original_label AS label, count(*) AS reviewed, count(*) FILTER (overturned) AS relabelled, count(*) FILTER (trigger = 'random_sample') AS spot_checked FROM done WHERE completed GROUP BY ALL) USING (label)
        LEFT JOIN (SELECT b.label, count(*) AS votes, count(*) FILTER (b.label <> x.label) AS minority FROM bal b JOIN decided x USING (transcript_id, unit) WHERE b.label IS NOT NULL AND x.label IS NOT NULL AND x.label_source <> 'verifier' GROUP BY ALL) USING (label)""",
        {"voted": VOTED, "decided": DECIDED, "done": DONE},
    ),
)
def label_stats(spark, d):
    declared = spark.createDataFrame([("R", 0), ("A", 1), ("X", 2)], "label string, ord int")
    b = written(ad.ballots(spark, d), "ballots")
    out = written(voting.decide(voting.vote(b, UNIT), ad.reviews(spark, d), UNIT), "decided")
    return rel.label_stats(out, b, reviews(spark, d), UNIT, declared)


@query("confidence_tiers", with_sql("SELECT transcript_id, count(*) FILTER (confidence >= 0.8) AS high, count(*) FILTER (confidence < 0.8 AND confidence >= 0.66) AS medium, count(*) FILTER (confidence < 0.66) AS low, count(confidence) AS n FROM voted GROUP BY ALL", {"voted": VOTED}))
def confidence_tiers(spark, d):
    return rel.tiers(voted(spark, d), "confidence", by=["transcript_id"])


@query("mean_stat", with_sql("SELECT transcript_id, avg(confidence) AS mean, CASE WHEN count(confidence) >= 8 THEN 1.96 * stddev_samp(confidence) / sqrt(count(confidence)) END AS ci_half_width, min(confidence) AS minimum, count(confidence) AS n FROM voted GROUP BY ALL", {"voted": VOTED}))
def mean_stat(spark, d):
    return rel.mean_stat(voted(spark, d), "confidence", ["transcript_id"])


@query(
    "reliability_flags",
    with_sql(
        """
        SELECT metric, scope, value, level FROM (SELECT metric, scope, value, CASE WHEN metric = 'alpha' AND value < 0.66 THEN 'red' WHEN metric = 'alpha' AND value < 0.8 THEN 'amber' WHEN metric = 'unjudged' AND value >= 0.25 THEN 'red' WHEN metric = 'unjudged' AND value > 0 THEN 'amber' WHEN metric = 'relabel_label' AND value >= 0.2 THEN 'amber' END AS level FROM (
          SELECT 'alpha' AS metric, transcript_id AS scope, alpha AS value FROM stat
          UNION ALL SELECT 'unjudged', transcript_id, count(*) FILTER (status <> 'ok') / CAST(count(*) AS DOUBLE) FROM bal GROUP BY ALL
          UNION ALL SELECT 'relabel_label', original_label, count(*) FILTER (overturned) / CAST(count(*) AS DOUBLE) FROM done WHERE completed GROUP BY ALL))
        WHERE level IS NOT NULL""",
        {
            "done": DONE,
            "per_label": "SELECT transcript_id, unit, label, count(*) AS n FROM bal WHERE label IS NOT NULL GROUP BY ALL",
            "per_unit": "SELECT transcript_id, unit, CAST(sum(n) AS BIGINT) AS m, CAST(sum(n * n) AS BIGINT) AS q FROM per_label GROUP BY ALL HAVING sum(n) >= 2",
            "stat": agreement_sql("bal", "transcript_id, unit", "transcript_id"),
        },
    ),
)
def reliability_flags(spark, d):
    alpha = rel.agreement(ad.ballots(spark, d), ["unit"], ["transcript_id"]).select(F.lit("alpha").alias("metric"), F.col("transcript_id").alias("scope"), F.col("alpha").alias("value"))
    missing = ad.ballots(spark, d).groupBy(F.col("transcript_id").alias("scope")).agg((F.count_if(F.col("status") != "ok") / F.count(F.lit(1))).alias("value")).select(F.lit("unjudged").alias("metric"), "scope", "value")
    relabel = rel.relabel_rate(reviews(spark, d)).filter("not overall").select(F.lit("relabel_label").alias("metric"), F.col("label").alias("scope"), F.col("relabel_rate").alias("value"))
    return rel.flags(alpha.unionByName(missing).unionByName(relabel))


@query(
    "collection_reliability",
    with_sql(
        """
        SELECT s.setup, s.vocabulary, s.scope, s.seen, s.expected, CAST(b.ballots AS BIGINT) AS ballots, t.n_units, t.percent, t.alpha, t.ac1, CASE WHEN b.most > 1 THEN 'duplicate ballots' END AS error
        FROM (SELECT setup, vocabulary, count(DISTINCT transcript_id) AS scope, count(*) AS seen, CAST(sum(n_members) AS BIGINT) AS expected FROM units JOIN words USING (transcript_id) WHERE label IS NOT NULL GROUP BY ALL) s
        JOIN (SELECT setup, vocabulary, sum(k) AS ballots, max(k) AS most FROM (SELECT setup, vocabulary, transcript_id, unit, model, roll, count(*) AS k FROM own GROUP BY ALL) GROUP BY ALL) b USING (setup, vocabulary)
        JOIN stat t USING (setup, vocabulary)""",
        {
            "voted": VOTED,
            "units": "SELECT transcript_id, unit, label, CASE WHEN transcript_id IN ('o1', 'o2') THEN 's1' ELSE 's2' END AS setup, CAST(7 AS BIGINT) AS n_members FROM voted",
            "words": "SELECT transcript_id, CASE WHEN transcript_id IN ('o1', 'o3') THEN 'A,N,R' ELSE 'A,N,R,X' END AS vocabulary FROM voted GROUP BY ALL",
            "own": "SELECT b.*, setup, vocabulary FROM bal b JOIN (SELECT DISTINCT transcript_id, unit, setup FROM units WHERE label IS NOT NULL) USING (transcript_id, unit) JOIN words USING (transcript_id) WHERE b.label IS NOT NULL",
            "per_label": "SELECT setup, vocabulary, transcript_id, unit, label, count(*) AS n FROM own GROUP BY ALL",
            "per_unit": "SELECT setup, vocabulary, transcript_id, unit, CAST(sum(n) AS BIGINT) AS m, CAST(sum(n * n) AS BIGINT) AS q FROM per_label GROUP BY ALL HAVING sum(n) >= 2",
            "stat": agreement_sql("own", "setup, vocabulary, transcript_id, unit", "setup, vocabulary"),
        },
    ),
)
def collection_reliability(spark, d):
    b = written(ad.ballots(spark, d), "ballots")
    v = written(voting.vote(b, UNIT), "voted")
    units = v.select(*UNIT, "label", F.when(F.col("transcript_id").isin("o1", "o2"), "s1").otherwise("s2").alias("setup"), F.lit(7).cast("bigint").alias("n_members"))
    words = F.when(F.col("transcript_id").isin("o1", "o3"), F.array(*map(F.lit, "ANR"))).otherwise(F.array(*map(F.lit, "ANRX")))
    vocabulary = v.select("transcript_id").distinct().select("transcript_id", F.explode(words).alias("label"))
    return rel.collection(units, b, vocabulary)


@query("multi_roll_models", with_sql("SELECT model, count(DISTINCT unit % 3) AS rolls FROM bal GROUP BY ALL HAVING count(DISTINCT unit % 3) > 1"))
def multi_roll_models(spark, d):
    return voting.multi_roll_models(ad.ballots(spark, d).withColumn("roll", F.col("unit") % 3))


@query(
    "member_phase_summary",
    with_sql(
        """
        SELECT transcript_id, phase_index, model, roll, label, round(n / CAST(total AS DOUBLE), 3) AS support, total AS n, round(conf / CAST(n AS DOUBLE) / 10, 3) AS confidence
        FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY transcript_id, phase_index, model, roll) AS BIGINT) AS total, row_number() OVER (PARTITION BY transcript_id, phase_index, model, roll ORDER BY n DESC, conf / CAST(n AS DOUBLE) DESC, first) AS r
          FROM (SELECT p.transcript_id, p.phase_index, v.model, v.roll, v.label, count(*) AS n, CAST(sum(conf10) AS BIGINT) AS conf, min(v.turn) AS first
            FROM stitched p JOIN votes v ON v.transcript_id = p.transcript_id AND v.turn BETWEEN p.turn_start AND p.turn_end WHERE v.label IS NOT NULL GROUP BY ALL))
        WHERE r = 1""",
        {"stitched": PHASE_RUNS, "votes": "SELECT transcript_id, turn, 'm' || g AS model, 0 AS roll, CASE WHEN (k + g) % 7 > 0 THEN event_type END AS label, (k + g) % 10 AS conf10 FROM tl, (SELECT unnest([1, 2]) AS g) WHERE turn IS NOT NULL"},
    ),
)
def member_phase_summary(spark, d):
    tl, _, ph = staged(spark, d)
    k = F.col("k") + F.col("g")
    votes = tl.filter("turn is not null").withColumn("g", F.explode(F.array(F.lit(1), F.lit(2)))).select("transcript_id", "turn", F.concat(F.lit("m"), F.col("g").cast("string")).alias("model"), F.lit(0).alias("roll"), F.when(k % 7 > 0, F.col("event_type")).alias("label"), (k % 10).alias("conf10"))
    return voting.member_summary(votes, ph)


@query("spot_draw")
def spot_draw(spark, d):
    return voting.spot_draw(ad.messages(spark, d).select(F.col("transcript_id").cast("string").alias("item")).distinct(), "item")


@query("stratified_sample")
def stratified_sample(spark, d):
    return voting.stratified_sample(staged(spark, d)[2])


@query(
    "apply_verdicts",
    with_sql(
        "SELECT p.transcript_id, p.turn, coalesce(CASE WHEN p.label IS NOT NULL THEN v.verifier_label END, p.label) AS label, p.label IS NOT NULL AND v.verifier_label IS NOT NULL AS relabelled FROM phase p LEFT JOIN (SELECT transcript_id, turn_start, turn_end, 'other' AS verifier_label FROM stitched WHERE phase_index % 4 = 1) v ON v.transcript_id = p.transcript_id AND p.turn BETWEEN v.turn_start AND v.turn_end",
        {"stitched": PHASE_RUNS},
    ),
)
def apply_verdicts(spark, d):
    _, judged, ph = staged(spark, d)
    verdicts = ph.select("transcript_id", "turn_start", "turn_end", F.lit("other").alias("verifier_label"), (F.col("phase_index") % 4 == 1).alias("overturned"))
    return voting.apply_verdicts(judged, verdicts).select("transcript_id", "turn", "label", "relabelled")


@query(
    "overlapping_reviews",
    with_sql(
        """
        SELECT p.transcript_id, p.phase_index, count(*) AS n_reviews, arg_min(trigger, (CASE WHEN overturned THEN 0 WHEN completed THEN 1 ELSE 2 END, original_phase_index)) AS trigger, bool_or(overturned) AS overturned, list_sort(list(original_phase_index)) AS original_phase_indexes
        FROM stitched p JOIN (SELECT transcript_id, phase_index AS original_phase_index, turn_start - 1 AS turn_start, turn_end + 1 AS turn_end, CASE WHEN phase_index % 2 = 0 THEN 'wedge' ELSE 'low_confidence' END AS trigger, phase_index % 6 = 2 AS overturned, phase_index % 3 > 0 AS completed FROM stitched WHERE phase_index % 4 <> 3) r
          ON r.transcript_id = p.transcript_id AND p.turn_start <= r.turn_end AND r.turn_start <= p.turn_end
        GROUP BY ALL""",
        {"stitched": PHASE_RUNS},
    ),
)
def overlapping_reviews(spark, d):
    ph = staged(spark, d)[2]
    i = F.col("phase_index")
    r = ph.filter(i % 4 != 3).select("transcript_id", i.alias("original_phase_index"), (F.col("turn_start") - 1).alias("turn_start"), (F.col("turn_end") + 1).alias("turn_end"), F.when(i % 2 == 0, "wedge").otherwise("low_confidence").alias("trigger"), (i % 6 == 2).alias("overturned"), (i % 3 > 0).alias("completed"))
    return voting.overlapping_reviews(ph, r)


@query(
    "chunk_projection",
    with_sql(
        """
        SELECT transcript_id, turn, last_value(own.phase IGNORE NULLS) OVER w AS label, CASE WHEN own IS NOT NULL THEN 'judged' WHEN last_value(own.phase IGNORE NULLS) OVER w IS NOT NULL THEN 'filled' ELSE 'missing_turn' END AS basis,
          CASE WHEN own IS NOT NULL THEN own.confidence WHEN last_value(own.phase IGNORE NULLS) OVER w IS NOT NULL THEN 0.3 END AS confidence
        FROM (SELECT p.transcript_id, p.turn, arg_min({'phase': s.phase, 'confidence': s.confidence}, s.ord) AS own FROM phase p
          LEFT JOIN (SELECT transcript_id, turn // 10 AS chunk, turn AS ord, turn AS a, least(turn + 2, (turn // 10) * 10 + 9) AS b, label AS phase, conf100 / CAST(100 AS DOUBLE) AS confidence FROM phase WHERE basis = 'judged' AND turn % 4 = 1) s
            ON s.transcript_id = p.transcript_id AND s.chunk = p.turn // 10 AND p.turn BETWEEN s.a AND s.b
          GROUP BY ALL)
        WINDOW w AS (PARTITION BY transcript_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
    ),
)
def chunk_projection(spark, d):
    judged = staged(spark, d)[1].withColumn("chunk", F.expr("turn div 10"))
    raw = judged.filter("basis = 'judged' and turn % 4 = 1").select("transcript_id", "chunk", F.col("turn").alias("ord"), F.col("turn").alias("turn_start"), (F.col("turn") + 2).alias("turn_end"), F.col("label").alias("phase"), (F.col("conf100") / 100).alias("confidence"), F.lit("").alias("explanation"), (F.col("chunk") * 10).alias("first"), (F.col("chunk") * 10 + 9).alias("last"))
    return phases.project_chunks(judged.select("transcript_id", "chunk", "turn"), phases.valid_segments(raw))
