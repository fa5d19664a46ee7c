"""Turn axis, lanes and clocks (AXS-*). Order is always a column; a window never leaves its transcript."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.shared import walked, written

#: Span types whose calls are off the axis, and roles of an audited pair.
OFF_AXIS_SPANS = ["init", "scorers", "scorer"]
AUDITOR, TARGET = "auditor", "target"
#: Levels of a span tree beyond which a walk is an error.
DEPTH = 1000


def before(*partition: str, order: str = "ev"):
    """All rows of a partition in front of this one."""
    return Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def model_turns(events: DataFrame) -> DataFrame:
    """AXS-01: model rows of every lane with an output, also those without a lane."""
    return events.filter("kind = 'model'")


def number_turns(events: DataFrame, is_main: Column, lane: str = "lane") -> DataFrame:
    """AXS-02, EXT-01: turn (ordinal of main model rows) and lane_turn (ordinal in the row's lane), else NULL."""
    model = F.col("kind") == "model"
    out = events.withColumn("_main", F.when(model & is_main, 1)).withColumn("_own", F.when(model & F.col(lane).isNotNull(), 1))
    return (
        out.withColumn("turn", F.when(F.col("_main") == 1, F.coalesce(F.sum("_main").over(before("transcript_id")), F.lit(0))))
        .withColumn("lane_turn", F.when(F.col("_own") == 1, F.coalesce(F.sum("_own").over(before("transcript_id", lane)), F.lit(0))))
        .drop("_main", "_own")
    )


def before_turn(events: DataFrame) -> DataFrame:
    """AXS-03, WIN-02: the axis turn that each row stands in front of: axis turns so far."""
    return events.withColumn("before_turn", F.coalesce(F.sum(F.when(F.col("turn").isNotNull(), 1)).over(before("transcript_id")), F.lit(0)))


def anchor_turn(events: DataFrame) -> DataFrame:
    """EXT-17: the last axis turn in front of a row, floor 0."""
    return before_turn(events).withColumn("anchor_turn", F.greatest(F.col("before_turn") - 1, F.lit(0))).drop("before_turn")


def lane_key(span: Column, turn: Column, ev: Column) -> Column:
    """AXS-16: the span; axis rows without one share the main lane; any other row is a lane of its own."""
    return F.coalesce(span, F.when(turn.isNotNull(), F.lit("__main__")), F.concat(F.lit("__offaxis_"), ev.cast("string")))


def lane_rows(timeline: DataFrame) -> DataFrame:
    """AXS-17: rows of real lanes with the number of axis turns up to and with each."""
    up_to = Window.partitionBy("transcript_id").orderBy("ev").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.sum(F.when(F.col("turn").isNotNull(), 1)).over(up_to)
    return timeline.withColumn("axis_turn", F.greatest(F.coalesce(seen, F.lit(0)) - 1, F.lit(0))).filter("lane is not null")


def axis_role(turns: DataFrame) -> DataFrame:
    """AXS-05: role of the opening turn; it must be that of the first turn with a tool call, else an error text."""
    return (
        turns.groupBy("transcript_id")
        .agg(F.min_by("role", "ev").alias("role"), F.min_by("role", F.when(F.col("n_tool_calls") > 0, F.col("ev"))).alias("tool_role"), F.max(F.col("n_tool_calls") > 0).alias("tools"))
        .select("transcript_id", "role", F.when(F.col("tools") & ~F.col("role").eqNullSafe(F.col("tool_role")), "the first tool call is of another role").alias("error"))
    )


# ---- span trees -----------------------------------------------------------------------------------------------------


def lineage(spans: DataFrame, depth: int = DEPTH) -> DataFrame:
    """AXS-09: (transcript_id, span_id, ancestor_id, depth) for every ancestor, the span itself at depth 0.

    Cycle-safe: a walk stops at a span that it has seen. A tree of more than `depth` levels is an error, never cut.
    """
    tree = written(spans.select("transcript_id", "span_id", "parent_id"), "tree")
    above = tree.select("transcript_id", F.col("span_id").alias("next_id"), F.col("parent_id").alias("_next"))

    def up(level: DataFrame) -> DataFrame:
        on = level.join(above, ["transcript_id", "next_id"]).filter(~F.array_contains("seen", F.col("next_id")))
        return on.select("transcript_id", "span_id", F.col("next_id").alias("ancestor_id"), F.col("_next").alias("next_id"), (F.col("depth") + 1).alias("depth"), F.array_append("seen", F.col("next_id")).alias("seen"))

    start = tree.select("transcript_id", "span_id", F.col("span_id").alias("ancestor_id"), F.col("parent_id").alias("next_id"), F.lit(0).alias("depth"), F.array("span_id").alias("seen"))
    return walked(start, up, depth, "lineage").select("transcript_id", "span_id", "ancestor_id", "depth")


def nearest_lane(spans: DataFrame, depth: int = DEPTH, ways: DataFrame | None = None) -> DataFrame:
    """AXS-08: for each span the nearest ancestor (or itself) that is a lane or an agent span, if that is a lane.

    spans has is_lane and is_agent. ways: their `lineage`, where it is known.
    """
    blocking = spans.filter("is_lane or is_agent").select("transcript_id", F.col("span_id").alias("ancestor_id"), "is_lane")
    return (
        (lineage(spans, depth) if ways is None else ways)
        .join(blocking, ["transcript_id", "ancestor_id"])
        .groupBy("transcript_id", "span_id")
        .agg(F.min_by(F.when(F.col("is_lane"), F.col("ancestor_id")), "depth").alias("lane_id"))
    )


def main_span(spans: DataFrame, events: DataFrame) -> DataFrame:
    """AXS-04: (transcript_id, main_id, error). From the root down through a single non-utility agent child, to a span
    that holds a model row itself; several candidates, or none, are an error.

    spans: span_id, parent_id, type, utility. One level a join: a level's rows are the transcripts still walking.
    """
    holds = events.filter("kind = 'model'").select("transcript_id", F.coalesce("span_id", F.lit("")).alias("span_id")).distinct().withColumn("holds", F.lit(True))
    child = (
        spans.filter("type = 'agent' and not utility")
        .groupBy("transcript_id", F.coalesce("parent_id", F.lit("")).alias("at"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("span_id").alias("child"))
    )
    holds, child = written(holds, "holds"), written(child, "child")

    def placed(at: DataFrame) -> DataFrame:
        return at.join(holds.select("transcript_id", F.col("span_id").alias("at"), F.col("holds").alias("held")), ["transcript_id", "at"], "left").join(child, ["transcript_id", "at"], "left")

    def down(level: DataFrame) -> DataFrame:
        return placed(level.filter("held is null and n = 1").select("transcript_id", F.col("child").alias("at"), (F.col("depth") + 1).alias("depth")))

    walk = walked(placed(events.select("transcript_id").distinct().select("transcript_id", F.lit("").alias("at"), F.lit(0).alias("depth"))), down, DEPTH, "walk")
    end = walk.groupBy("transcript_id").agg(F.max_by(F.when(F.col("held"), F.col("at")), "depth").alias("main_id"), F.max_by("held", "depth").alias("_held"), F.max_by("n", "depth").alias("_n"))
    return end.select("transcript_id", "main_id", F.when(F.col("_held"), None).when(F.col("_n") > 1, "several agent spans").otherwise("no model turn").alias("error"))


def subagent_spans(spans: DataFrame, main: DataFrame, depth: int = DEPTH, ways: DataFrame | None = None) -> DataFrame:
    """AXS-06: agent spans that are neither main, nor above it, nor utility. ways: the spans' `lineage`, where it is known."""
    above = (lineage(spans, depth) if ways is None else ways).join(main.select("transcript_id", F.col("main_id").alias("span_id")), ["transcript_id", "span_id"])
    return spans.filter("type = 'agent' and not utility").join(above.select("transcript_id", F.col("ancestor_id").alias("span_id")), ["transcript_id", "span_id"], "left_anti")


def role_lanes(spans: DataFrame, turns: DataFrame, main: DataFrame, role: str, depth: int = DEPTH) -> DataFrame:
    """AXS-07: spans that hold turns of other roles and none of the axis role, outside agent, tool and phase spans."""
    held = turns.groupBy("transcript_id", "span_id").agg(F.bool_or(F.coalesce(F.col("role") == role, F.lit(False))).alias("axis"), F.bool_or(F.col("role").isNotNull() & (F.col("role") != role)).alias("other"))
    ways = lineage(spans, depth)
    above_main = ways.join(main.select("transcript_id", F.col("main_id").alias("span_id")), ["transcript_id", "span_id"]).select("transcript_id", F.col("ancestor_id").alias("span_id"))
    closed = spans.filter(F.col("type").isin("agent", "tool", *OFF_AXIS_SPANS)).select("transcript_id", F.col("span_id").alias("ancestor_id"))
    under = ways.join(closed, ["transcript_id", "ancestor_id"]).select("transcript_id", "span_id").distinct()
    return (
        held.filter("other and not axis").join(spans, ["transcript_id", "span_id"]).join(above_main, ["transcript_id", "span_id"], "left_anti").join(under, ["transcript_id", "span_id"], "left_anti").select("transcript_id", "span_id")
    )


def auditor_span(spans: DataFrame, turns: DataFrame, depth: int = DEPTH) -> DataFrame:
    """AXS-10: the outermost span with auditor turns, phase and tool spans aside; two unrelated ones are an error."""
    holds = turns.filter(F.col("role") == AUDITOR).select("transcript_id", "span_id").distinct().join(spans.filter(~F.col("type").isin("tool", *OFF_AXIS_SPANS)), ["transcript_id", "span_id"], "left_semi")
    inner = lineage(spans, depth).filter("depth > 0").join(holds.withColumnRenamed("span_id", "ancestor_id"), ["transcript_id", "ancestor_id"], "left_semi").select("transcript_id", "span_id")
    return holds.join(inner, ["transcript_id", "span_id"], "left_anti").groupBy("transcript_id").agg(
        F.when(F.count(F.lit(1)) == 1, F.min("span_id")).alias("main_id"), F.when(F.count(F.lit(1)) > 1, "unrelated auditor spans").alias("error")
    )


def lanes(events: DataFrame, spans: DataFrame, depth: int = DEPTH) -> DataFrame:
    """AXS-11: (transcript_id, ev, is_main, lane_id, lane_kind) of every event, from one pass over the span tree."""
    main, ways = written(main_span(spans, events), "main"), written(lineage(spans, depth), "lineage")
    agents = subagent_spans(spans, main, depth, ways).select("transcript_id", "span_id", F.lit(True).alias("is_lane"))
    marked = spans.join(agents, ["transcript_id", "span_id"], "left").select("transcript_id", "span_id", "parent_id", F.coalesce("is_lane", F.lit(False)).alias("is_lane"), (F.col("type") == "agent").alias("is_agent"))
    near = nearest_lane(marked, depth, ways)
    return (
        events.join(main.filter("error is null").select("transcript_id", "main_id"), "transcript_id")
        .join(near, ["transcript_id", "span_id"], "left")
        .select("transcript_id", "ev", ((F.col("kind") == "model") & (F.coalesce("span_id", F.lit("")) == F.col("main_id"))).alias("is_main"), "lane_id", F.when(F.col("lane_id").isNotNull(), "agent").alias("lane_kind"))
    )


# ---- the turn clock -----------------------------------------------------------------------------------------------------


def clock(turns: DataFrame) -> DataFrame:
    """AXS-12: cells [cell_start, cell_end) of axis turns in seconds, for transcripts whose stamps never fall or fail.

    turns: transcript_id, turn, start (seconds), completed (seconds or NULL). The last cell ends at its completion
    if that is later, else after the median positive width, else at its start.
    """
    w = Window.partitionBy("transcript_id").orderBy("turn")
    rows = turns.select("transcript_id", "turn", "start", "completed", F.lead("start").over(w).alias("next"), F.lag("start").over(w).alias("last"))
    whole = Window.partitionBy("transcript_id")
    bad = F.col("start").isNull() | (F.col("start") < F.col("last"))
    width = F.when(F.col("next") > F.col("start"), F.col("next") - F.col("start"))
    return (
        rows.withColumn("_bad", F.max(F.coalesce(bad, F.lit(False))).over(whole))
        .withColumn("_median", F.percentile(width, F.lit(0.5)).over(whole))
        .filter("not _bad")
        .select(
            "transcript_id",
            "turn",
            F.col("start").alias("cell_start"),
            F.coalesce("next", F.when(F.col("completed") > F.col("start"), F.col("completed")), F.col("start") + F.coalesce("_median", F.lit(0.0))).alias("cell_end"),
        )
    )


def asof_turn(stamps: DataFrame, cells: DataFrame, at: str = "at", out: str = "turn_at") -> DataFrame:
    """AXS-14, JON-07: the last turn whose cell starts at or before each stamp, 0 before the first.

    A union and one running last value per transcript: no pair of stamp and cell is ever formed.
    """
    names = stamps.columns
    keyed = stamps.withColumn("_s", F.struct(*names)).select("transcript_id", F.col(at).alias("_at"), F.lit(1).alias("_k"), F.lit(None).cast("bigint").alias("_turn"), "_s")
    ticks = cells.select("transcript_id", F.col("cell_start").alias("_at"), F.lit(0).alias("_k"), F.col("turn").cast("bigint").alias("_turn"))
    w = Window.partitionBy("transcript_id").orderBy("_at", "_k", "_turn").rowsBetween(Window.unboundedPreceding, 0)
    both = keyed.unionByName(ticks, allowMissingColumns=True)
    filled = both.withColumn("_t", F.coalesce(F.last("_turn", ignorenulls=True).over(w), F.lit(0))).filter("_k = 1")
    return filled.select("_s.*", F.col("_t").alias(out))


def position(stamps: DataFrame, cells: DataFrame, at: str = "at", out: str = "position") -> DataFrame:
    """AXS-13: turn - 0.5 + the share of its cell gone by, within [-0.5, turns - 0.5]; cells of no width are skipped."""
    wide = cells.filter("cell_end > cell_start")
    ends = cells.groupBy("transcript_id").agg(F.count(F.lit(1)).alias("_n"), F.min("cell_start").alias("_first"), F.max("cell_end").alias("_last"))
    own = wide.select("transcript_id", F.col("turn").alias("_cell"), "cell_start", "cell_end")
    placed = asof_turn(stamps, wide, at, "_cell").join(own, ["transcript_id", "_cell"], "left").join(ends, "transcript_id")
    share = (F.col(at) - F.col("cell_start")) / (F.col("cell_end") - F.col("cell_start"))
    value = F.when(F.col(at) <= F.col("_first"), F.lit(-0.5)).when(F.col(at) >= F.col("_last"), F.col("_n") - 0.5).otherwise(F.col("_cell") - 0.5 + F.least(share, F.lit(1.0)))
    return placed.withColumn(out, value).select(*stamps.columns, out)


def place_spans(spans: DataFrame, cells: DataFrame) -> DataFrame:
    """AXS-15: anchor_turn and end_turn by stamps where the clock and both stamps are there, else by event order.

    spans: transcript_id, span_id, spawn_turn, started, ended (seconds), order_end_turn.
    """
    begin = asof_turn(spans.filter("started is not null").select("transcript_id", "span_id", F.col("started").alias("at")), cells, out="_a").drop("at")
    end = asof_turn(spans.filter("ended is not null").select("transcript_id", "span_id", F.col("ended").alias("at")), cells, out="_e").drop("at")
    usable = cells.select("transcript_id").distinct().withColumn("_clock", F.lit(True))
    joined = spans.join(usable, "transcript_id", "left").join(begin, ["transcript_id", "span_id"], "left").join(end, ["transcript_id", "span_id"], "left")
    ok = F.col("_clock") & F.col("_a").isNotNull() & F.col("_e").isNotNull()
    return joined.select(
        *spans.columns,
        F.when(ok, F.col("_a")).otherwise(F.col("spawn_turn")).alias("anchor_turn"),
        F.when(ok, F.greatest("_a", "_e")).otherwise(F.greatest(F.coalesce("order_end_turn", "spawn_turn"), "spawn_turn")).alias("end_turn"),
        F.when(ok, "timestamp").otherwise("event_order").alias("turn_source"),
    )


def n_turns(timeline: DataFrame) -> DataFrame:
    """FRM-18: axis turns of each transcript."""
    return timeline.filter("turn is not null").groupBy("transcript_id").agg((F.max("turn") + 1).alias("n_turns"))


def span_records(events: DataFrame) -> DataFrame:
    """EXT-02: one row a lane span: the turn before its begin (floor 0), first and last activity, its recorded end, and the turn before that.

    events: transcript_id, ev, kind (span_begin, span_end, model, tool, others), span_id (of a begin or end its own, else the lane), turn, started,
    completed. Activity in front of the begin doesn't count, as the span isn't known yet.
    """
    seen = anchor_turn(events).filter("span_id is not null and kind in ('span_begin', 'span_end', 'model', 'tool')")
    keys = ["transcript_id", "span_id"]
    begin = seen.filter("kind = 'span_begin'").groupBy(*keys).agg(F.max("ev").alias("_begin"), F.max_by("anchor_turn", "ev").alias("spawn_turn"))
    rest = seen.filter("kind <> 'span_begin'").join(begin.select(*keys, "_begin"), keys).filter("ev > _begin")
    at_end, active = F.col("kind") == "span_end", F.col("kind").isin("model", "tool")
    facts = rest.groupBy(*keys).agg(
        F.min(F.when(active, F.col("started"))).alias("first_at"), F.max(F.when(active, F.coalesce("completed", "started"))).alias("last_at"),
        F.max_by(F.when(at_end, F.col("started")), F.when(at_end, F.col("ev"))).alias("end_at"), F.max_by("anchor_turn", F.when(at_end, F.col("ev"))).alias("order_end_turn"), F.bool_or(at_end).alias("end_recorded"),
    )
    return begin.drop("_begin").join(facts, keys, "left").withColumn("end_recorded", F.coalesce("end_recorded", F.lit(False)))


def run_role(turns: DataFrame) -> DataFrame:
    """SCA-18: the one role that a transcript's axis turns record, NULL if they record several or none."""
    return turns.groupBy("transcript_id").agg(F.when(F.count_distinct("role") == 1, F.max("role")).alias("role"))
