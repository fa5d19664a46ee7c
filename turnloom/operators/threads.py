"""Message threads: digests, batches, excerpts, prompts, tool outputs (EXT-05..22, WIN-15, WIN-20)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions import text as tx
from turnloom.operators.axis import before
from turnloom.schema import CARD_BUDGET, DIGEST, EXCERPT_CHARS, TASK_CHARS, TASK_PROMPT_CHARS, TOOLS_SHOWN


def first_prompts(messages: DataFrame) -> DataFrame:
    """EXT-06: the first system and the first user message of each thread."""
    at = lambda role: F.min_by("text", F.when(F.col("role") == role, F.col("ev")))
    return messages.groupBy("transcript_id").agg(at("system").alias("system_prompt"), at("user").alias("task_message"))


def task_prompt(messages: DataFrame, scaffold: str = "^\\[") -> DataFrame:
    """EXT-22: the first user message that isn't blank or scaffold, flattened and cut."""
    own = messages.filter("role = 'user'").withColumn("_t", tx.flat("text")).filter((F.col("_t") != "") & ~F.col("_t").rlike(scaffold))
    return own.groupBy("transcript_id").agg(F.substring(F.min_by("_t", "ev"), 1, TASK_PROMPT_CHARS).alias("task_prompt"))


def strip_scaffold(x, marks: str = "^(\\[|#|<)"):
    """EXT-10: a prompt without its leading scaffold lines, flattened."""
    lines = F.split(tx.col(x), "\n")
    first = F.array_position(F.transform(lines, lambda s: ~tx.strip(s).rlike(marks) & (tx.strip(s) != "")), True)
    return tx.flat(F.when(first > 0, F.array_join(F.slice(lines, F.greatest(first, F.lit(1)).cast("int"), F.size(lines)), "\n")).otherwise(""))


def span_tasks(spans: DataFrame, first_inputs: DataFrame) -> DataFrame:
    """EXT-10, EXT-12: a span's task: of its metadata, else its first call's last input that isn't a tool's; cut, with provenance."""
    s = spans.join(first_inputs.filter("role <> 'tool' and trim(text) <> ''").groupBy("transcript_id", "span_id").agg(F.max_by("text", "pos").alias("_input")), ["transcript_id", "span_id"], "left")
    raw = F.coalesce(tx.null_if_blank("task"), tx.null_if_blank("prompt"), F.col("_input"), F.lit(""))
    source = F.when(F.coalesce(tx.null_if_blank("task"), tx.null_if_blank("prompt")).isNotNull(), "metadata").when(F.col("_input").isNotNull(), "first_input").otherwise("none")
    clean = strip_scaffold(raw)
    return s.select("transcript_id", "span_id", F.substring(clean, 1, TASK_CHARS).alias("span_task"), source.alias("span_task_source"), (F.length(clean) > TASK_CHARS).alias("span_task_truncated"))


def digests(turns: DataFrame, settings: dict | None = None) -> DataFrame:
    """EXT-13: the axis turns with something to judge, texts cut; the last turn with text has a larger cap.

    turns: transcript_id, turn, text, n_tool_calls.
    """
    s = DIGEST | (settings or {})
    text = tx.flat(F.coalesce("text", F.lit("")))
    last = F.max(F.when(text != "", F.col("turn"))).over(Window.partitionBy("transcript_id"))
    own = turns.withColumn("_t", text).withColumn("_last", last)
    able = (F.col("_t") != "") | (F.lit(s["tool_only_turns"]) & (F.coalesce("n_tool_calls", F.lit(0)) > 0))
    return own.filter(able & ~tx.is_failed("_t")).select(
        "transcript_id", "turn", F.when(F.col("turn") == F.col("_last"), tx.clip("_t", s["final_text_chars"])).otherwise(tx.clip("_t", s["text_chars"])).alias("text"), "n_tool_calls"
    )


def snap(anchors: DataFrame, eligible: DataFrame) -> DataFrame:
    """WIN-20: for each anchor the last eligible turn at or before it, else the first."""
    first = eligible.groupBy("transcript_id").agg(F.min("turn").alias("_first"))
    ticks = eligible.select("transcript_id", F.col("turn").alias("_at"), F.lit(0).alias("_k"), F.col("turn").alias("_turn"))
    marks = anchors.select("transcript_id", F.col("anchor").alias("_at"), F.lit(1).alias("_k"), "id")
    w = Window.partitionBy("transcript_id").orderBy("_at", "_k").rowsBetween(Window.unboundedPreceding, 0)
    filled = ticks.unionByName(marks, allowMissingColumns=True).withColumn("_s", F.last("_turn", ignorenulls=True).over(w)).filter("_k = 1")
    return filled.join(first, "transcript_id").select("transcript_id", "id", F.coalesce("_s", "_first").alias("turn"))


def batches(digest: DataFrame, size: int) -> DataFrame:
    """EXT-21: windows of `size` digests in order, packed as items numbered from 1."""
    at = F.row_number().over(Window.partitionBy("transcript_id").orderBy("turn")) - 1
    d = digest.withColumn("_i", at).withColumn("batch", F.floor(F.col("_i") / size).cast("bigint")).withColumn("_n", F.col("_i") % size + 1)
    item = F.struct(F.col("_n").alias("n"), F.concat(F.lit("[ITEM "), F.col("_n").cast("string"), F.lit("]\n"), F.col("text")).alias("text"))
    return d.groupBy("transcript_id", "batch").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["text"]), "\n\n").alias("content"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count(F.lit(1)).alias("n_items")
    )


def split_batch(content):
    """EXT-21: the items of a packed batch by number."""
    parts = F.filter(F.split(tx.col(content), r"(?m)^\[ITEM (?=\d+\]\n)"), lambda p: p != "")
    number = lambda p: F.regexp_extract(p, r"^(\d+)\]", 1).cast("int")
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(number(p), F.regexp_replace(F.regexp_replace(p, r"^\d+\]\n", ""), r"\n\n$", ""))))


def excerpts(turns: DataFrame, cap: int = EXCERPT_CHARS) -> DataFrame:
    """EXT-19: text of each turn that has any, cut; tools as six names and how many more. turns: ..., text, tools (array)."""
    flat = tx.flat(F.coalesce("text", F.lit("")))
    n = F.size("tools")
    label = F.concat(F.array_join(F.slice("tools", 1, TOOLS_SHOWN), ", "), F.when(n > TOOLS_SHOWN, F.concat(F.lit(" (+"), (n - TOOLS_SHOWN).cast("string"), F.lit(" more)"))).otherwise(""))
    return turns.withColumn("_t", flat).filter("_t <> ''").select("transcript_id", "turn", F.substring("_t", 1, cap).alias("text"), (F.length("_t") > cap).alias("truncated"), label.alias("tools"))


def card_budget(excerpt: DataFrame, budget: int = CARD_BUDGET) -> DataFrame:
    """WIN-15: of each group the earliest max(1, budget // groups) excerpts, and how many are left.

    excerpt: transcript_id, phase_index, group_index, turn.
    """
    keys = ["transcript_id", "phase_index"]
    groups = F.max("_d").over(Window.partitionBy(*keys))
    own = Window.partitionBy(*keys, "group_index")
    e = excerpt.withColumn("_d", F.dense_rank().over(Window.partitionBy(*keys).orderBy("group_index"))).withColumn("_most", F.greatest(F.floor(F.lit(budget) / groups), F.lit(1)))
    e = e.withColumn("_r", F.row_number().over(own.orderBy("turn"))).withColumn("_n", F.count(F.lit(1)).over(own))
    return e.filter("_r <= _most").select(*keys, "group_index", "turn", (F.col("_n") - F.least("_n", "_most")).alias("remaining"))


def compaction_texts(messages: DataFrame) -> DataFrame:
    """EXT-05: for each compaction row the last user message in front of it since the compaction before, if it isn't history.

    messages: transcript_id, span_id, ev, kind (message or compaction), role, text, in_history.
    """
    keys = ["transcript_id", "span_id"]
    part = F.coalesce(F.sum(F.when(F.col("kind") == "compaction", 1)).over(before(*keys)), F.lit(0))
    w = before(*keys, "_part")
    own = F.when((F.col("kind") == "message") & (F.col("role") == "user") & ~F.col("in_history"), F.col("text"))
    return messages.withColumn("_part", part).withColumn("compaction_prompt", F.last(own, ignorenulls=True).over(w)).filter("kind = 'compaction'").select(*keys, "ev", "compaction_prompt")


def interventions(messages: DataFrame, requests: DataFrame) -> DataFrame:
    """EXT-07, SRT-02: human messages at the first axis call that saw them, and agents' requests at their turn, in stable order.

    messages: transcript_id, id, ord, source, text, seen_turn (NULL if no call saw it), footprint_turn; the first one is the task
    itself. requests: transcript_id, ord, turn, channel, prompt, content, outcome.
    """
    w = Window.partitionBy("transcript_id").orderBy("ord")
    human = messages.filter(F.col("source").isin("operator", "input")).withColumn("_n", F.row_number().over(w)).filter("_n > 1")
    a = human.select("transcript_id", "ord", F.coalesce("seen_turn", "footprint_turn").alias("turn"), F.col("source").alias("channel"), F.lit("human").alias("initiator"), F.lit(None).cast("string").alias("prompt"), F.col("text").alias("content"), F.lit(None).cast("string").alias("outcome"))
    b = requests.select("transcript_id", "ord", "turn", "channel", F.lit("agent").alias("initiator"), "prompt", "content", "outcome")
    return a.unionByName(b).withColumn("position", F.row_number().over(Window.partitionBy("transcript_id").orderBy("turn", "ord")) - 1)


def tool_outputs(calls: DataFrame, tools: DataFrame, answers: DataFrame) -> DataFrame:
    """EXT-15: a call's output: the tool event of its id within the turn's window, else the single message that answers it.

    calls: transcript_id, call_id, start, end (ev); tools: transcript_id, call_id, ev, result; answers: transcript_id, call_id, text.
    """
    keys = ["transcript_id", "call_id"]
    hit = calls.join(tools, keys).filter("ev > start and ev < end").groupBy(*keys, "start").agg(F.min_by("result", "ev").alias("_event"))
    single = answers.groupBy(*keys).agg(F.when(F.count(F.lit(1)) == 1, F.min("text")).alias("_message"))
    return calls.join(hit, [*keys, "start"], "left").join(single, keys, "left").select(*keys, "start", F.coalesce("_event", "_message").alias("output"))


def top_tools(calls: DataFrame, most: int = TOOLS_SHOWN) -> DataFrame:
    """EXT-11, SRT-04: a span's tools by number of calls, ties by first use. calls: transcript_id, span_id, ev, tool."""
    n = calls.groupBy("transcript_id", "span_id", "tool").agg(F.count(F.lit(1)).alias("n"), F.min("ev").alias("first"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("transcript_id", "span_id").orderBy(F.desc("n"), "first"))).filter(F.col("rank") <= most).drop("first")


def target_replies(events: DataFrame, cap: int = 1000) -> DataFrame:
    """EXT-16: texts of another role's turns, cut, under the axis turn in front of them, in order."""
    turns = F.coalesce(F.sum(F.when(F.col("turn").isNotNull(), 1)).over(before("transcript_id")), F.lit(0))
    own = events.withColumn("_after", turns - 1).filter("turn is null and role = 'target' and _after >= 0")
    item = F.struct("ev", F.substring(F.coalesce("text", F.lit("")), 1, cap).alias("t"))
    return own.groupBy("transcript_id", F.col("_after").alias("turn")).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]).alias("replies"))


def mark_summaries(excerpt: DataFrame, flushes: DataFrame) -> DataFrame:
    """RPT-12: the turn in front of a flush with a recorded prompt is that of the summary."""
    own = flushes.filter("compaction_prompt is not null").select("transcript_id", (F.col("turn") - 1).alias("turn")).distinct().withColumn("_m", F.lit(True))
    return excerpt.join(own, ["transcript_id", "turn"], "left").withColumn("is_summary", F.coalesce("_m", F.lit(False))).drop("_m")


def spawn_prompts(spans: DataFrame, first_inputs: DataFrame) -> DataFrame:
    """EXT-20: every lane's own opening message in full; a span without any is left out. Inputs as for `span_tasks`."""
    first = first_inputs.filter("role <> 'tool' and trim(text) <> ''").groupBy("transcript_id", "span_id").agg(F.max_by("text", "pos").alias("_input"))
    told = strip_scaffold(F.coalesce(tx.null_if_blank("task"), tx.null_if_blank("prompt"), F.col("_input"), F.lit("")))
    return spans.join(first, ["transcript_id", "span_id"], "left").select("transcript_id", "span_id", told.alias("text")).filter("text <> ''")


def tool_counts(turns: DataFrame) -> DataFrame:
    """EXT-20: tool calls of the axis turns that have any."""
    return turns.filter("turn is not null and n_tool_calls > 0").select("transcript_id", "turn", "n_tool_calls")
