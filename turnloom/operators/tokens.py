"""Token views, context drops and flushes (WIN-01..03, WIN-12..13, FRM-03, EXT-03..04, JON-08..09, AGG-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.operators.axis import before, lane_key
from turnloom.schema import DROP_RATIO, SUPPRESS_RADIUS


def zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def is_gap() -> Column:
    """FLT-05: no input count, or input, output and both cache counts all zero."""
    return F.col("input_tokens").isNull() | (zero("input_tokens") + zero("output_tokens") + zero("cache_read") + zero("cache_write") == 0)


def token_views(timeline: DataFrame, span: str = "lane") -> DataFrame:
    """WIN-01: context, new_work, billable, turn_total of model rows; NULL on gaps, which don't reset a lane.

    A row off the axis is a lane of its own, so it never seeds another row's previous context.
    """
    own = F.when(F.col(span) != "main", F.col(span)) if span == "lane" else F.col(span)
    t = timeline.withColumn("_lane", lane_key(own, F.col("turn"), F.col("ev"))).withColumn("_gap", is_gap())
    context = F.when(~F.col("_gap"), zero("input_tokens") + zero("cache_write") + zero("cache_read"))
    t = t.withColumn("context", context)
    last = F.coalesce(F.last("context", ignorenulls=True).over(before("transcript_id", "_lane")), F.lit(0))
    fresh = F.least(zero("cache_write"), F.greatest(F.lit(0), F.col("context") - last))
    return (
        t.withColumn("new_work", F.when(~F.col("_gap"), zero("input_tokens") + zero("output_tokens") + fresh))
        .withColumn("billable", F.when(~F.col("_gap"), zero("input_tokens") + zero("output_tokens") + zero("cache_write")))
        .withColumn("turn_total", F.when(~F.col("_gap"), zero("input_tokens") + zero("output_tokens") + zero("cache_write") + zero("cache_read")))
        .drop("_lane", "_gap")
    )


def lane_spend(views: DataFrame) -> DataFrame:
    """AGG-03: per lane turns, peak context, and sums that are NULL when nothing was reported."""
    return views.filter("lane is not null").groupBy("transcript_id", "lane").agg(
        F.count(F.lit(1)).alias("turns"), F.max("context").alias("context_peak"), F.sum("output_tokens").alias("output_tokens"), F.sum("new_work").alias("new_work"), F.sum("billable").alias("billable")
    )


def drops(views: DataFrame) -> DataFrame:
    """WIN-03: turns whose context falls under DROP_RATIO of the one before and stays there, lane by lane."""
    w = Window.partitionBy("transcript_id", "lane").orderBy("ev")
    seen = views.filter("lane is not null and context is not null").withColumn("prev", F.lag("context").over(w)).withColumn("nxt", F.lead("context").over(w))
    # ratios as tenths, so that both sides are whole numbers
    tenths = int(DROP_RATIO * 10)
    fell = (F.col("context") * 10 < F.col("prev") * tenths) & (F.col("nxt").isNull() | (F.col("nxt") * 10 < F.col("prev") * tenths))
    return seen.filter(fell).select("transcript_id", "lane", "ev", "turn", "lane_turn", F.col("prev").alias("tokens_before"), F.col("context").alias("tokens_after"))


def compactions(events: DataFrame) -> DataFrame:
    """EXT-04: recorded compactions with the axis turn and the lane turn that they precede."""
    lane = F.when(F.col("kind") == "model", 1)
    w = before("transcript_id")
    axis = F.coalesce(F.sum(F.when(F.col("turn").isNotNull(), 1)).over(w), F.lit(0))
    return events.withColumn("at_turn", axis).withColumn("at_lane_turn", F.coalesce(F.sum(lane).over(before("transcript_id", "lane")), F.lit(0))).filter("kind = 'compaction' and lane is not null")


def flushes(recorded: DataFrame, views: DataFrame) -> DataFrame:
    """FRM-03: recorded flushes, their size afterwards inferred where it is missing, and drops that none explains.

    recorded: transcript_id, lane, turn, lane_turn, ev, tokens_before, tokens_after. The size afterwards is the first
    context of the lane at or after the flush (JON-08); a drop within SUPPRESS_RADIUS lane turns of a recorded flush is that
    flush (JON-09). Both are joined by transcript and lane.
    """
    keys = ["transcript_id", "lane"]
    seen = views.filter("lane is not null and context is not null")
    marks = recorded.select(*keys, F.col("lane_turn").alias("_t"), F.lit(0).alias("_k"), F.col("ev").alias("_flush"))
    ticks = seen.select(*keys, F.col("lane_turn").alias("_t"), F.lit(1).alias("_k"), F.col("context").alias("_c"))
    ahead = Window.partitionBy(*keys).orderBy(F.col("_t"), F.col("_k")).rowsBetween(0, Window.unboundedFollowing)
    next_ = marks.unionByName(ticks, allowMissingColumns=True).withColumn("_next", F.first("_c", ignorenulls=True).over(ahead)).filter("_k = 0").select(*keys, F.col("_flush").alias("ev"), "_next")
    missing = (F.coalesce("tokens_after", F.lit(0)) == 0) & (F.coalesce("tokens_before", F.lit(0)) != 0) & F.col("_next").isNotNull()
    told = recorded.join(next_, [*keys, "ev"], "left").select(
        *keys, "ev", "turn", "lane_turn", F.lit("recorded").alias("source"), "tokens_before", F.when(missing, F.col("_next")).otherwise(F.col("tokens_after")).alias("tokens_after"), missing.alias("tokens_after_inferred")
    )
    near = recorded.select(*keys, F.explode(F.sequence(F.col("lane_turn") - SUPPRESS_RADIUS, F.col("lane_turn") + SUPPRESS_RADIUS)).alias("lane_turn")).distinct()
    made = drops(views).join(near, [*keys, "lane_turn"], "left_anti").select(*keys, "ev", "turn", "lane_turn", F.lit("synthesized").alias("source"), "tokens_before", "tokens_after", F.lit(False).alias("tokens_after_inferred"))
    return told.unionByName(made)


def lane_activity(events: DataFrame) -> DataFrame:
    """EXT-03: tool rows of each lane by the axis turn in front: number, busy tenths of a second (NULL if none reported), first stamp."""
    axis = F.coalesce(F.sum(F.when(F.col("turn").isNotNull(), 1)).over(before("transcript_id")), F.lit(0))
    return (
        events.withColumn("at", F.greatest(axis - 1, F.lit(0)))
        .filter("kind = 'tool' and lane is not null and lane <> 'main'")
        .groupBy("transcript_id", F.col("at").alias("turn"), "lane")
        .agg(F.count(F.lit(1)).alias("tool_calls"), F.sum("busy").alias("busy"), F.min("ts").alias("started_at"))
    )


def cumulative(views: DataFrame) -> DataFrame:
    """WIN-12, WIN-13: running billable over axis turns, and the least positive value that bars are floored at."""
    w = Window.partitionBy("transcript_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("transcript_id")
    return views.filter("turn is not null").select(
        "transcript_id",
        "turn",
        F.sum("billable").over(w).alias("cum_billable"),
        F.coalesce(F.min(F.when(F.col("billable") > 0, F.col("billable"))).over(whole), F.lit(1)).alias("bar_floor"),
        F.when(F.col("billable") > 0, F.col("billable")).alias("log_billable"),
    )


def measures_coincide(views: DataFrame) -> DataFrame:
    """RPT-02: whether any view is known, and whether totals equal new work wherever both are."""
    return views.filter("turn is not null").groupBy("transcript_id").agg(
        (F.count("context") > 0).alias("has_views"), F.coalesce(F.bool_and(F.col("turn_total") == F.col("new_work")), F.lit(False)).alias("coincide")
    )


def spend_by(rows: DataFrame, key: str, total: Column, missing: str) -> DataFrame:
    """AGG-04..07, SET-02: sums of `spend` by key, with what the transcript spent beyond them as a row of its own.

    rows: transcript_id, key, spend; total: the transcript's whole spend, the same on each of its rows. Zero rows go.
    """
    by = rows.filter(F.col(key).isNotNull()).groupBy("transcript_id", F.col(key).alias("label")).agg(F.sum("spend").alias("spend"))
    rest = rows.groupBy("transcript_id").agg((F.coalesce(F.max(total), F.lit(0)) - F.coalesce(F.sum(F.when(F.col(key).isNotNull(), F.col("spend"))), F.lit(0))).alias("spend")).select("transcript_id", F.lit(missing).alias("label"), "spend")
    both = by.unionByName(rest.filter("spend > 0")).filter("spend > 0")
    return both.withColumn("share", F.col("spend") / F.sum("spend").over(Window.partitionBy("transcript_id")))


def tag_spend(views: DataFrame, tags: DataFrame, family: str) -> DataFrame:
    """JON-11: new work of the axis turns that have a tag of the family, one row a turn and tag."""
    own = tags.filter(F.col(family).isNotNull()).select("transcript_id", "turn", family)
    return views.filter("turn is not null").select("transcript_id", "turn", F.coalesce("new_work", F.lit(0)).alias("new_work")).join(own, ["transcript_id", "turn"])
