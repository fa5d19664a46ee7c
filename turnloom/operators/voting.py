"""Votes, consensus, review decisions and sampling (VOT-01..11, VOT-07..08, AGG-13, AGG-15)."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.schema import DOUBT, FILL_CONFIDENCE, SAMPLE_MIN, SAMPLE_SEED, SPOT_SEED, SPOT_SHARE, Z


def vote(ballots: DataFrame, unit: list[str], confidence: str = "conf10", scale: int = 10) -> DataFrame:
    """VOT-01: the label with most votes, then the higher mean confidence (NULL as 0), then the earliest member.

    Confidences are whole numbers in 1/scale, so that means are compared without rounding: sums by count cross-wise are
    exact, here as sum * 5040 / n with n up to ten, else as doubles. Adds agreement, n_voting, confidence and its half-width.
    """
    b = ballots.filter(F.col("label").isNotNull())
    c = F.col(confidence)
    sides = b.groupBy(*unit, "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(c, F.lit(0))).alias("total"), F.min("ord").alias("first"), F.count(c).alias("stated"), F.sum(c).alias("sum"), F.sum(c * c).alias("squares")
    )
    rank = Window.partitionBy(*unit).orderBy(F.desc("n"), F.desc(F.col("total") / F.col("n")), F.asc("first"))
    whole = Window.partitionBy(*unit)
    k, s, q = F.col("stated"), F.col("sum"), F.col("squares")
    sd = F.sqrt((q * k - s * s) / (k * (k - 1)).cast("double"))
    return (
        sides.withColumn("n_voting", F.sum("n").over(whole))
        .withColumn("_r", F.row_number().over(rank))
        .filter("_r = 1")
        .select(
            *unit,
            "label",
            "n_voting",
            F.round(F.col("n") / F.col("n_voting"), 3).alias("agreement"),
            F.round(s / k / scale, 3).alias("confidence"),
            F.when(k < 2, F.lit(0.0)).otherwise(F.round(Z * sd / scale / F.sqrt(k), 3)).alias("confidence_pm"),
        )
    )


def modal_status(ballots: DataFrame, unit: list[str]) -> DataFrame:
    """The most frequent status of units nobody voted on, ties to the earliest member."""
    n = ballots.groupBy(*unit, "status").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    rank = Window.partitionBy(*unit).orderBy(F.desc("n"), F.asc("first"))
    return n.withColumn("_r", F.row_number().over(rank)).filter("_r = 1").select(*unit, "status")


def consensus(members: DataFrame, carry: str | None = None) -> DataFrame:
    """VOT-02: per turn the vote; without a voter but with a filled member the last voted label at 0.3, else the modal failure.

    members: transcript_id, turn, ord, basis, label, conf10. Labels carry along the turns of a transcript.
    """
    keys = ["transcript_id", "turn"]
    voted = vote(members.filter("basis = 'judged'"), keys)
    filled = members.groupBy(*keys).agg(F.bool_or(F.col("basis") == "filled").alias("_filled"))
    failed = modal_status(members.filter("basis not in ('judged', 'filled')").withColumnRenamed("basis", "status"), keys)
    all_ = filled.join(voted, keys, "left").join(failed, keys, "left")
    back = Window.partitionBy("transcript_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    last = F.coalesce(F.last("label", ignorenulls=True).over(back), F.lit(carry))
    fill = F.col("label").isNull() & F.col("_filled") & last.isNotNull()
    return all_.select(
        *keys,
        F.coalesce("label", F.when(fill, last)).alias("label"),
        F.when(F.col("label").isNotNull(), "judged").when(fill, "filled").otherwise(F.coalesce("status", F.lit("missing_turn"))).alias("basis"),
        F.coalesce("confidence", F.when(fill, F.lit(FILL_CONFIDENCE))).alias("confidence"),
        F.when(F.col("n_voting") >= 2, F.col("agreement")).alias("agreement"),
        "n_voting",
    )


def doubt(confidence: Column, agreement: Column, n_voting: Column) -> Column:
    """VOT-06: low confidence, else low agreement of two voters at least, else NULL."""
    return F.when(confidence < DOUBT, "low_confidence").when((n_voting >= 2) & (agreement < DOUBT), "low_agreement")


def decide(voted: DataFrame, reviews: DataFrame, unit: list[str], solo: bool = False) -> DataFrame:
    """VOT-09: a review overturns a vote if its label differs and its confidence reaches the gate."""
    r = reviews.select(*unit, "verifier_label", "verifier_conf100")
    over = F.coalesce(F.col("verifier_label").isNotNull() & (F.col("verifier_label") != F.col("label")) & (F.col("verifier_conf100") >= int(DOUBT * 100)), F.lit(False))
    first = "single_judge" if solo else "majority_vote"
    return voted.join(r, unit, "left").select(
        *unit, F.when(over, F.col("verifier_label")).otherwise(F.col("label")).alias("label"), F.when(over, "verifier").otherwise(F.when(F.col("label").isNotNull(), first)).alias("label_source"), over.alias("overturned"), "agreement", "n_voting", "confidence"
    )


def failure_status(ballots: DataFrame, unit: list[str]) -> DataFrame:
    """A unit without any vote: refusal if all refused, else no_answer."""
    return ballots.groupBy(*unit).agg(F.count("label").alias("_n"), F.bool_and(F.col("status") == "refusal").alias("_all")).filter("_n = 0").select(*unit, F.when(F.col("_all"), "refusal").otherwise("no_answer").alias("status"))


def batch_answers(answers: DataFrame, expected: DataFrame) -> DataFrame:
    """VOT-11: answers of batched calls by item number: the first of a number counts, unknown numbers don't, missing ones have no answer."""
    keys = ["call_id", "item"]
    first = answers.groupBy(*keys).agg(F.min_by(F.struct("label", "confidence"), "ord").alias("a"))
    return expected.join(first, keys, "left").select(*keys, F.col("a.label").alias("label"), F.col("a.confidence").alias("confidence"), F.when(F.col("a").isNull(), "no_answer").otherwise("ok").alias("status"))


def apply_verdicts(judged: DataFrame, verdicts: DataFrame) -> DataFrame:
    """VOT-10: verdicts of overturned ranges rewrite the labelled turns inside; the turns are then stitched again.

    verdicts: transcript_id, turn_start, turn_end, verifier_label, overturned. Ranges of one transcript don't overlap.
    """
    v = verdicts.filter("overturned").select("transcript_id", F.col("turn_start").alias("_a"), F.col("turn_end").alias("_b"), F.col("verifier_label").alias("_v"))
    hit = judged.alias("j").join(v.alias("v"), (F.col("j.transcript_id") == F.col("v.transcript_id")) & F.col("turn").between(F.col("_a"), F.col("_b")) & F.col("label").isNotNull(), "left")
    return hit.select(*[F.col(f"j.{c}") if c != "label" else F.coalesce("_v", "label").alias("label") for c in judged.columns], F.col("_v").isNotNull().alias("relabelled"))


def overlapping_reviews(phases: DataFrame, reviews: DataFrame) -> DataFrame:
    """VOT-10: original reviews that overlap each stitched phase; the one that speaks for it is overturned, else the first completed."""
    p = phases.select("transcript_id", "phase_index", F.col("turn_start").alias("_a"), F.col("turn_end").alias("_b"))
    both = p.join(reviews, "transcript_id").filter("_a <= turn_end and turn_start <= _b")
    rank = F.struct(F.when(F.col("overturned"), 0).when(F.col("completed"), 1).otherwise(2), F.col("original_phase_index"))
    return both.groupBy("transcript_id", "phase_index").agg(
        F.count(F.lit(1)).alias("n_reviews"), F.min_by("trigger", rank).alias("trigger"), F.bool_or("overturned").alias("overturned"), F.array_sort(F.collect_list("original_phase_index")).alias("original_phase_indexes")
    )


def spot_draw(items: DataFrame, id_column: str, share: float = SPOT_SHARE, seed: int = SPOT_SEED) -> DataFrame:
    """VOT-07: a draw in [0, 1) that depends on seed and id alone, and whether it is under the share.

    The draw is that of Python's generator seeded with `seed:id`, so it runs in Arrow batches.
    """
    kind = dict(items.dtypes)[id_column]

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            value = [random.Random(f"{seed}:{i}").random() for i in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(value, pa.float64()), pa.array([v < share for v in value], pa.bool_())], [id_column, "draw", "picked"])

    return items.select(id_column).mapInArrow(drawn, f"`{id_column}` {kind}, draw double, picked boolean")


def sample_size(n: int, share: float | None = None) -> int:
    """Units to review of n that no rule picked."""
    return min(n, max(SAMPLE_MIN, round(0.05 * n)) if share is None else round(share * n))


def stratified_sample(phases: DataFrame, share: float | None = None, seed: int = SAMPLE_SEED) -> DataFrame:
    """VOT-08: of each transcript's phases without a trigger, a sample dealt round-robin over the sorted labels.

    The draws within a label follow one seeded generator per transcript; its phases are few, so they are one group.
    """

    def picked(t: pa.Table) -> pa.Table:
        t = t.sort_by("phase_index")
        by: dict[str, list[int]] = {}
        for i, label in zip(t.column("phase_index").to_pylist(), t.column("phase").to_pylist(), strict=True):
            by.setdefault(label, []).append(i)
        rng, left, out = random.Random(seed), sample_size(len(t), share), []
        while left:
            for label in sorted(by):
                if left and by[label]:
                    i = rng.choice(by[label])
                    by[label].remove(i)
                    out.append(i)
                    left -= 1
        return pa.table({"transcript_id": pa.array(t.column("transcript_id").to_pylist()[:1] * len(out), pa.string()), "phase_index": pa.array(out, pa.int64())})

    return phases.select("transcript_id", "phase_index", "phase").groupBy("transcript_id").applyInArrow(picked, "transcript_id string, phase_index bigint")


def multi_roll_models(ballots: DataFrame) -> DataFrame:
    """AGG-13: models that voted in more than one roll."""
    return ballots.groupBy("model").agg(F.count_distinct("roll").alias("rolls")).filter("rolls > 1")


def member_summary(votes: DataFrame, phases: DataFrame) -> DataFrame:
    """AGG-15: for each phase and member its modal label within the phase's turns, the support share and mean confidence."""
    p = phases.select("transcript_id", "phase_index", "turn_start", "turn_end")
    inside = p.join(votes, "transcript_id").filter("turn between turn_start and turn_end and label is not null").withColumnRenamed("turn", "ord")
    keys = ["transcript_id", "phase_index", "model", "roll"]
    return vote(inside, keys).select(*keys, "label", F.col("agreement").alias("support"), F.col("n_voting").alias("n"), F.col("confidence"))
