"""The rows behind a report (RPT-01..12, WIN-17, AGG-10, AGG-16, AGG-17): DataFrames only, rendering aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions import text as tx
from turnloom.operators.phases import runs


def band(per_turn: DataFrame, phases: DataFrame, votes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """RPT-01: runs in both fill modes with their labels, and per turn the members' votes as one text (by model, roll)."""
    named = runs(per_turn).join(phases.select("transcript_id", "phase_index", F.col("phase").alias("label")), ["transcript_id", "phase_index"], "left")
    both = named.withColumn("fill", F.explode(F.array(F.lit("plain"), F.lit("confidence"))))
    if votes is None:
        return both, per_turn.select("transcript_id", "turn", F.lit(None).cast("string").alias("votes"))
    said = F.concat_ws(": ", tx.short_model("model"), F.coalesce("label", "basis"))
    cell = votes.groupBy("transcript_id", "turn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("model", "roll", said.alias("t")))), lambda x: x["t"]), "; ").alias("votes"))
    return both, per_turn.select("transcript_id", "turn").join(cell, ["transcript_id", "turn"], "left")


def token_chart(views: DataFrame, flushes: DataFrame) -> DataFrame:
    """RPT-02: measures of axis turns with the running billable and the flush that a turn follows; raw output where no view is known."""
    w = Window.partitionBy("transcript_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    known = F.count("context").over(Window.partitionBy("transcript_id")) > 0
    note = flushes.groupBy("transcript_id", "turn").agg(F.array_join(F.array_sort(F.collect_list(tx.flush_detail("lane", "source", "tokens_before", "tokens_after", "tokens_after_inferred"))), "; ").alias("flush"))
    return views.filter("turn is not null").withColumn("measure", F.when(known, F.col("new_work")).otherwise(F.col("output_tokens"))).withColumn("cumulative", F.sum("billable").over(w)).join(note, ["transcript_id", "turn"], "left").select(
        "transcript_id", "turn", "context", "measure", "turn_total", "cumulative", "flush"
    )


def event_marks(interventions: DataFrame) -> DataFrame:
    """RPT-03: events half a turn before theirs, with a preview."""
    return interventions.select("transcript_id", (F.col("turn") - 0.5).alias("x"), "channel", tx.preview("content").alias("preview"))


def geometry(spans: DataFrame, n_turns: DataFrame, px: float = 6.0) -> DataFrame:
    """WIN-17, RPT-04: boxes of spans on the axis: as wide as px pixels at least, within the right edge; what lies outside is marked.

    spans: transcript_id, span_id, x0, x1 (axis positions).
    """
    s = spans.join(n_turns, "transcript_id")
    least = px * F.col("n_turns") / tx.chart_width("n_turns")
    right = F.col("n_turns") - 0.5
    wide = F.greatest(F.col("x1"), F.col("x0") + least)
    shift = F.greatest(wide - right, F.lit(0.0))
    return s.select("transcript_id", "span_id", F.greatest(F.col("x0") - shift, F.lit(-0.5)).alias("x0"), F.least(wide, right).alias("x1"), (F.col("x1") > F.col("x0")).alias("boxed"), (F.col("x1") <= -0.5).alias("before_first"), (F.col("x0") >= right).alias("after_last"))


def subagent_section(spans: DataFrame, votes: DataFrame, flushes: DataFrame, prompts: DataFrame, ran: bool) -> DataFrame:
    """RPT-05, AGG-11: lane spans with label, votes, compactions and prompt (the full one before the stored copy), in spawn order; the state says what is known."""
    n = flushes.filter("lane is not null").groupBy("transcript_id", F.col("lane").alias("span_id")).agg(F.count(F.lit(1)).alias("compactions"))
    v = votes.groupBy("transcript_id", "span_id").agg(F.array_sort(F.collect_list(F.concat_ws(": ", tx.short_model("model"), "label"))).alias("votes"))
    s = spans.join(n, ["transcript_id", "span_id"], "left").join(v, ["transcript_id", "span_id"], "left").join(prompts.select("transcript_id", "span_id", F.col("text").alias("_full")), ["transcript_id", "span_id"], "left")
    order = Window.partitionBy("transcript_id").orderBy(F.asc_nulls_last("spawn_turn"), "span_id")
    joined = F.count("label").over(Window.partitionBy("transcript_id")) > 0
    state = F.lit("not_run") if not ran else F.when(joined, "ok").otherwise("joined_none")
    return s.select(
        "transcript_id", "span_id", "spawn_turn", "label", "votes", F.coalesce("compactions", F.lit(0)).alias("compactions"), F.coalesce("_full", "span_task").alias("prompt"), state.alias("state"), (F.row_number().over(order) - 1).alias("position")
    )


def cards(phases: DataFrame, turns: DataFrame, flushes: DataFrame, interventions: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """RPT-06: a record a phase: tool calls in its range, whether anything was compacted or intervened in it, issues, and the tags of its turns.

    phases: with confidence, agreement, overturned; turns: transcript_id, turn, n_tool_calls.
    """
    keys = ["transcript_id", "phase_index"]
    p = phases.select(*keys, "turn_start", "turn_end")
    inside = p.join(turns, "transcript_id").filter("turn between turn_start and turn_end").groupBy(*keys).agg(F.sum("n_tool_calls").alias("tool_calls"))
    hit = lambda rows, name: p.join(rows.select("transcript_id", "turn").distinct(), "transcript_id").filter("turn between turn_start and turn_end").select(*keys).distinct().withColumn(name, F.lit(True))
    out = phases.join(inside, keys, "left").join(hit(flushes, "_c"), keys, "left").join(hit(interventions, "_i"), keys, "left")
    issue = F.when(F.coalesce("overturned", F.lit(False)), "overturned").when(F.col("confidence") <= 0.6, "low_confidence").when((F.col("confidence") >= 0.8) & (F.col("agreement") <= 0.5), "confident_but_divided")
    out = out.withColumn("compacted", F.coalesce("_c", F.lit(False))).withColumn("intervened", F.coalesce("_i", F.lit(False))).withColumn("issue", issue).drop("_c", "_i")
    if tags is not None:
        families = [c for c in tags.columns if c not in ("transcript_id", "turn")]
        chips = p.join(tags, "transcript_id").filter("turn between turn_start and turn_end").groupBy(*keys).agg(*[F.array_sort(F.collect_set(c)).alias(f"{c}_chips") for c in families])
        out = out.join(chips, keys, "left")
    return out


def summary(phases: DataFrame, per_turn: DataFrame) -> DataFrame:
    """RPT-07: phases, turns, judged turns, mean confidence and reviews of a transcript."""
    a = phases.groupBy("transcript_id").agg(F.count(F.lit(1)).alias("n_phases"), F.count_distinct("phase").alias("n_labels"), tx.rounded_mean("confidence").alias("confidence"))
    b = per_turn.groupBy("transcript_id").agg(F.count(F.lit(1)).alias("n_turns"), F.count_if(F.col("basis").isin("judged", "filled")).alias("n_judged"))
    return b.join(a, "transcript_id", "left")


def setup_facts(info: DataFrame, columns: list[str]) -> DataFrame:
    """RPT-08: setup facts as (transcript_id, position, name, value), unknown ones left out."""
    pairs = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)])
    return info.select("transcript_id", F.explode(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("f")).select("transcript_id", "f.*")


def compaction_prompts(flushes: DataFrame) -> DataFrame:
    """RPT-08: the different recorded prompts of a transcript in order of their first turn."""
    return flushes.filter("compaction_prompt is not null").groupBy("transcript_id", "compaction_prompt").agg(F.min("turn").alias("first_turn")).withColumn("position", F.row_number().over(Window.partitionBy("transcript_id").orderBy("first_turn", "compaction_prompt")) - 1)


def flush_list(flushes: DataFrame) -> DataFrame:
    """RPT-09: flushes by lane, in order of axis turn, then lane turn."""
    w = Window.partitionBy("transcript_id", "lane").orderBy(F.asc_nulls_last("turn"), "lane_turn", "source")
    return flushes.withColumn("position", F.row_number().over(w) - 1)


def initiator(channel: str = "channel", told: str = "initiator"):
    """RPT-09: who began an intervention, from its channel where that isn't said."""
    return F.coalesce(F.col(told), F.when(F.col(channel).isin("operator", "input"), "human").otherwise("agent"))


def judge_cells(rows: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-16: of a run of rows the mean confidence and agreement, label sources, and reviews."""
    return rows.groupBy(*keys).agg(tx.rounded_mean("confidence").alias("confidence"), tx.rounded_mean("agreement").alias("agreement"), F.array_sort(F.collect_set("label_source")).alias("label_sources"), F.count_if("reviewed").alias("reviewed"), F.count_if("overturned").alias("overturned"))


def first_known(rows: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """AGG-17: of each column the first value that isn't NULL, in order."""
    return rows.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def stat_cell(mean: Column, half: Column, n: Column) -> Column:
    """RPT-10: a mean with its half-width, and the colours of its cell."""
    said = F.concat(tx.two_places(mean), F.when(half.isNotNull(), F.concat(F.lit(" ± "), tx.two_places(half))).otherwise(""))
    known = mean.isNotNull() & (n > 0)
    return _cell(F.when(known, said).otherwise("n/a"), F.when(known, mean))


def rate_cell(count: Column, of: Column, low: Column, high: Column, unit: str, empty: str, invert: bool = True) -> Column:
    """RPT-10: a share in percent, its interval, the counts, and colours; inverted, a high share is an unhealthy one."""
    part = F.when(of > 0, count / of)
    percent = lambda x: F.format_string("%.0f%%", F.bround(x * 100, 0))
    ci = F.concat(F.lit("["), percent(low), F.lit("–"), percent(high), F.lit("]"))
    told = F.concat_ws(" ", percent(part), ci, F.concat(count.cast("string"), F.lit("/"), of.cast("string"), F.lit(f" {unit}")))
    return _cell(F.when(part.isNotNull(), told).otherwise(empty), 1 - part if invert else part)


def count_cell(count: Column, asked: Column) -> Column:
    """RPT-10: misses, coloured by the share that is left."""
    return _cell(count.cast("string"), F.when(asked > 0, 1 - count / asked))


def _cell(text: Column, health: Column) -> Column:
    background = tx.health_colour(health)
    return F.struct(text.alias("text"), background.alias("background"), tx.ink(background).alias("ink"))


def inline_flags(flags: DataFrame) -> DataFrame:
    """RPT-10: an entity's flags as lines of its own section, red ones first."""
    line = F.concat_ws(" ", F.upper("level"), "metric", tx.two_places("value"))
    return flags.select(F.when(F.col("level") == "red", 0).otherwise(1).alias("rank"), "metric", "value", line.alias("line"))


def turn_chart(frame: DataFrame, y: str) -> DataFrame:
    """RPT-11: bars of a layer's column on the turn axis: 0.8 of a turn wide, and a whole turn to point at."""
    t, v = F.col("turn").cast("int"), F.col(y).cast("double")
    return frame.filter(F.col("turn").isNotNull() & F.col(y).isNotNull()).select("transcript_id", t.alias("turn"), v.alias("y"), (t - 0.4).alias("x1"), (t + 0.4).alias("x2"), (t - 0.5).alias("tip_x1"), (t + 0.5).alias("tip_x2"))


def section_rows(frame: DataFrame, transcripts: DataFrame) -> DataFrame:
    """RPT-11: a layer's rows by the transcript whose section shows them; a layer without transcripts is shown in all. Transcripts: one row each."""
    if "transcript_id" in frame.columns:
        return frame.join(transcripts.select("transcript_id"), "transcript_id", "left_semi")
    return transcripts.select("transcript_id").crossJoin(frame)  # a layer of its own, shown once a transcript by what it is


def markdown_safe(x: Column | str) -> Column:
    """RPT-11: markdown without raw HTML and images: marks of either are escaped."""
    escaped = F.replace(F.replace(F.replace(tx.col(x), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(escaped, F.lit("!["), F.lit("\\!["))
