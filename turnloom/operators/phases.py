"""Segmentation: stitching, dense projection, runs, wedges, rollups (WIN-04..11, WIN-14, VOT-12, AGG-01, JON-04..06)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.schema import EXPLANATION_CHARS, FILL_CONFIDENCE, UNJUDGED, UNSEEN, WEDGE_TURNS


def labelled():
    """FLT-06: judged or filled, with a label."""
    return F.col("basis").isin("judged", "filled") & F.col("label").isNotNull()


def islands(rows: DataFrame, keys: list[str], order: str, same: list[str], adjacent: bool = False) -> DataFrame:
    """rows with `island`: a new number wherever a column of `same` changes, or (adjacent) the order jumps."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.lag(order).over(w).isNull()
    for c in same:
        new = new | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    if adjacent:
        new = new | (F.col(order) != F.lag(order).over(w) + 1)
    return rows.withColumn("_new", new.cast("int")).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")


def stitch(judged: DataFrame) -> DataFrame:
    """WIN-04: neighbours of one label become a phase; an unlabelled turn ends it. Confidences in hundredths.

    Counts a NULL confidence as 0; the half-width is 1.96 sd / sqrt(n), 0 for a single turn.
    """
    marked = judged.withColumn("_label", F.when(labelled(), F.col("label")))
    runs = islands(marked, ["transcript_id"], "turn", ["_label"]).filter("_label is not null")
    c = F.coalesce(F.col("conf100"), F.lit(0))
    grouped = runs.groupBy("transcript_id", "island", F.col("_label").alias("phase")).agg(
        F.min("turn").alias("turn_start"),
        F.max("turn").alias("turn_end"),
        F.count(F.lit(1)).alias("n_digest_turns"),
        F.sum(c).alias("_sum"),
        F.sum(c * c).alias("_squares"),
        F.min(c).alias("min_conf100"),
    )
    n, s, q = F.col("n_digest_turns"), F.col("_sum"), F.col("_squares")
    sd = F.sqrt((q * n - s * s) / (n * (n - 1)).cast("double"))
    order = Window.partitionBy("transcript_id").orderBy("turn_start")
    return grouped.select(
        "transcript_id",
        (F.row_number().over(order) - 1).cast("bigint").alias("phase_index"),
        "phase",
        "turn_start",
        "turn_end",
        "n_digest_turns",
        F.round(s / n / 100, 3).alias("confidence"),
        (F.col("min_conf100") / 100).alias("min_confidence"),
        F.when(n < 2, F.lit(0.0)).otherwise(F.round(1.96 * sd / 100 / F.sqrt(n), 3)).alias("confidence_spread"),
    )


def dense(axis: DataFrame, phases: DataFrame, judged: DataFrame) -> DataFrame:
    """WIN-05: phase_index of every axis turn: the last phase start, cleared by unjudged turns; leading turns take the first event's."""
    starts = phases.select("transcript_id", F.col("turn_start").alias("turn"), F.struct(F.col("phase_index").alias("i")).alias("_event"))
    gaps = judged.filter(F.col("basis").isin(UNJUDGED)).select("transcript_id", "turn", F.struct(F.lit(None).cast("bigint").alias("i")).alias("_event"))
    events = starts.unionByName(gaps)
    has = phases.select("transcript_id").distinct().withColumn("_any", F.lit(True))
    w = Window.partitionBy("transcript_id").orderBy("turn")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    event = F.coalesce(F.last("_event", ignorenulls=True).over(back), F.first("_event", ignorenulls=True).over(ahead))
    return axis.join(events, ["transcript_id", "turn"], "left").join(has, "transcript_id", "left").select(*axis.columns, F.when(F.col("_any"), event["i"]).alias("phase_index"))


def surface(axis: DataFrame, phases: DataFrame, judged: DataFrame) -> DataFrame:
    """WIN-06: one row an axis turn: phase_index, basis (its own, else attributed or unattributed), confidence."""
    own = judged.select("transcript_id", "turn", F.col("basis").alias("_basis"), "conf100")
    d = dense(axis, phases, judged).join(own, ["transcript_id", "turn"], "left")
    return d.select(
        "transcript_id", "turn", "phase_index", F.coalesce("_basis", F.when(F.col("phase_index").isNotNull(), UNSEEN[0]).otherwise(UNSEEN[1])).alias("basis"), "conf100"
    )


def runs(per_turn: DataFrame) -> DataFrame:
    """WIN-10: islands of turns with one phase, and one greyed basis if any, broken by turn gaps."""
    grey = F.when(F.col("basis").isin(*UNJUDGED, UNSEEN[1]), F.col("basis"))
    return (
        islands(per_turn.withColumn("grey", grey), ["transcript_id"], "turn", ["grey", "phase_index"], adjacent=True)
        .groupBy("transcript_id", "island", "phase_index", "grey")
        .agg(F.min("turn").alias("turn_start"), F.max("turn").alias("turn_end"))
        .drop("island")
    )


def label_runs(rows: DataFrame, n_turns: DataFrame, label: str = "label") -> DataFrame:
    """WIN-11: runs of equal labels on neighbouring turns, and the ranges between them that no label covers."""
    own = islands(rows.filter(F.col(label).isNotNull()), ["transcript_id"], "turn", [label], adjacent=True).groupBy("transcript_id", "island", F.col(label).alias("label")).agg(F.min("turn").alias("turn_start"), F.max("turn").alias("turn_end")).drop("island")
    axis = n_turns.select("transcript_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_turns") - 1)).alias("turn"))
    bare = axis.join(rows.filter(F.col(label).isNotNull()).select("transcript_id", "turn"), ["transcript_id", "turn"], "left_anti")
    holes = islands(bare, ["transcript_id"], "turn", [], adjacent=True).groupBy("transcript_id", "island").agg(F.min("turn").alias("turn_start"), F.max("turn").alias("turn_end"))
    return own.unionByName(holes.select("transcript_id", F.lit("missing").alias("label"), "turn_start", "turn_end"))


def wedges(phases: DataFrame) -> DataFrame:
    """WIN-09: phases of at most WEDGE_TURNS digest turns between two phases of one other label."""
    w = Window.partitionBy("transcript_id").orderBy("phase_index")
    p = phases.withColumn("_a", F.lag("phase").over(w)).withColumn("_b", F.lead("phase").over(w))
    return p.filter((F.col("n_digest_turns") <= WEDGE_TURNS) & (F.col("_a") == F.col("_b")) & (F.col("_a") != F.col("phase"))).drop("_a", "_b")


def valid_segments(segments: DataFrame) -> DataFrame:
    """WIN-08: segments within their chunk [first, last]: inverted and outside ones go, others are cut to it."""
    return segments.filter("turn_start <= turn_end and turn_end >= first and turn_start <= last").select(
        "transcript_id", "chunk", "ord", F.greatest("turn_start", "first").alias("turn_start"), F.least("turn_end", "last").alias("turn_end"), "phase", "confidence", F.substring("explanation", 1, EXPLANATION_CHARS).alias("explanation")
    )


def project_chunks(turns: DataFrame, segments: DataFrame) -> DataFrame:
    """WIN-07: turns covered by a segment (the first by order) are judged; others take the label before at 0.3, else are missing.

    Labels carry over from chunk to chunk of a transcript. turns: transcript_id, chunk, turn.
    """
    covering = turns.join(segments, ["transcript_id", "chunk"]).filter("turn between turn_start and turn_end").groupBy("transcript_id", "turn").agg(F.min_by(F.struct("phase", "confidence"), "ord").alias("_s"))
    back = Window.partitionBy("transcript_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last("_s.phase", ignorenulls=True).over(back)
    return turns.join(covering, ["transcript_id", "turn"], "left").select(
        "transcript_id",
        "turn",
        carried.alias("label"),
        F.when(F.col("_s").isNotNull(), "judged").when(carried.isNotNull(), "filled").otherwise("missing_turn").alias("basis"),
        F.when(F.col("_s").isNotNull(), F.col("_s.confidence")).when(carried.isNotNull(), F.lit(FILL_CONFIDENCE)).alias("confidence"),
    )


def phase_spend(phases: DataFrame, per_turn: DataFrame, views: DataFrame) -> DataFrame:
    """AGG-01, JON-04, JON-05: new work by phase. A turn of gaps counts 0; a phase without any timeline row is NULL."""
    turn = views.filter("turn is not null").groupBy("transcript_id", "turn").agg(F.sum(F.coalesce("new_work", F.lit(0))).alias("spend"))
    by = per_turn.filter("phase_index is not null").join(turn, ["transcript_id", "turn"], "left").groupBy("transcript_id", "phase_index").agg(F.sum("spend").alias("new_work_tokens"))
    return phases.join(by, ["transcript_id", "phase_index"], "left")


def phase_delegated(phases: DataFrame, spans: DataFrame) -> DataFrame:
    """JON-06: agent lanes spawned within each phase: their number, and their new work (NULL if none reported any)."""
    s = spans.select("transcript_id", "spawn_turn", F.col("new_work").alias("_spend"))
    p = phases.select("transcript_id", "phase_index", "turn_start", "turn_end")
    hit = p.join(s, (p.transcript_id == s.transcript_id) & F.col("spawn_turn").between(F.col("turn_start"), F.col("turn_end")), "left").select(p["*"], "spawn_turn", "_spend")
    return hit.groupBy("transcript_id", "phase_index").agg(F.count("spawn_turn").alias("n_subagents"), F.sum("_spend").alias("delegated_new_work_tokens"))


def event_flags(phases: DataFrame, events: DataFrame) -> DataFrame:
    """WIN-14: each event flags the phase that starts last at or before its turn, and the phase after it."""
    keyed = phases.select("transcript_id", F.col("turn_start").alias("_at"), F.lit(0).alias("_k"), "phase_index")
    marks = events.select("transcript_id", F.col("turn").alias("_at"), F.lit(1).alias("_k"))
    w = Window.partitionBy("transcript_id").orderBy("_at", "_k").rowsBetween(Window.unboundedPreceding, 0)
    hit = keyed.unionByName(marks, allowMissingColumns=True).withColumn("_p", F.last("phase_index", ignorenulls=True).over(w)).filter("_k = 1 and _p is not null")
    flagged = hit.select("transcript_id", F.explode(F.array("_p", F.col("_p") + 1)).alias("phase_index")).distinct().withColumn("_f", F.lit(True))
    return phases.join(flagged, ["transcript_id", "phase_index"], "left").select("transcript_id", "phase_index", F.coalesce("_f", F.lit(False)).alias("event"))


def partition_status(groups: DataFrame, phases: DataFrame) -> DataFrame:
    """VOT-12: whether a phase's groups tile its turns exactly."""
    w = Window.partitionBy("transcript_id", "phase_index").orderBy("turn_start", "turn_end")
    g = groups.withColumn("_next", F.lead("turn_start").over(w))
    tiled = g.groupBy("transcript_id", "phase_index").agg(
        F.count(F.lit(1)).alias("n_groups"), F.min("turn_start").alias("_a"), F.max("turn_end").alias("_b"), F.bool_and(F.col("_next").isNull() | (F.col("_next") == F.col("turn_end") + 1)).alias("_joined"), F.bool_and(F.col("turn_start") <= F.col("turn_end")).alias("_sane")
    )
    p = phases.select("transcript_id", "phase_index", "turn_start", "turn_end")
    ok = F.col("_joined") & F.col("_sane") & (F.col("_a") == F.col("turn_start")) & (F.col("_b") == F.col("turn_end"))
    return p.join(tiled, ["transcript_id", "phase_index"], "left").select("transcript_id", "phase_index", F.coalesce("n_groups", F.lit(0)).alias("n_groups"), F.when(F.col("n_groups").isNull(), "empty_groups").when(ok, "complete").otherwise("invalid_partition").alias("status"))


def chip_counts(phases: DataFrame, per_turn: DataFrame, vocabulary: list[str]) -> DataFrame:
    """AGG-08: phases and turns a label, 0 for declared labels that don't occur."""
    by_phase = phases.groupBy("transcript_id", F.col("phase").alias("label")).agg(F.count(F.lit(1)).alias("n_phases"))
    named = per_turn.join(phases.select("transcript_id", "phase_index", F.col("phase").alias("label")), ["transcript_id", "phase_index"])
    by_turn = named.groupBy("transcript_id", "label").agg(F.count(F.lit(1)).alias("n_turns"))
    spine = phases.select("transcript_id").distinct().select("transcript_id", F.explode(F.array(*map(F.lit, vocabulary))).alias("label"))
    keys = spine.unionByName(by_phase.select("transcript_id", "label")).distinct()
    return keys.join(by_phase, ["transcript_id", "label"], "left").join(by_turn, ["transcript_id", "label"], "left").fillna(0, ["n_phases", "n_turns"])


def coverage(per_turn: DataFrame) -> DataFrame:
    """AGG-09: turns by basis."""
    counts = [F.count_if(F.col("basis") == b).alias(b) for b in ("judged", "filled", "attributed", "unattributed", "refusal", "no_answer", "missing_turn")]
    return per_turn.groupBy("transcript_id").agg(*counts, F.count(F.lit(1)).alias("n_turns"))


def colour_slots(per_turn: DataFrame, phases: DataFrame) -> DataFrame:
    """AGG-14: labels by number of turns, most first, ties by name: their palette slots."""
    named = per_turn.join(phases.select("transcript_id", "phase_index", F.col("phase").alias("label")), ["transcript_id", "phase_index"])
    n = named.groupBy("transcript_id", "label").agg(F.count(F.lit(1)).alias("n_turns"))
    return n.withColumn("slot", F.row_number().over(Window.partitionBy("transcript_id").orderBy(F.desc("n_turns"), "label")) - 1)
