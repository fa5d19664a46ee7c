"""Telemetry files: reading, consolidation and assembly of transcripts (SRC-01..04, ING-*)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.functions import text as tx
from turnloom.operators import packing
from turnloom.shared import written

#: The kinds of session that are the orchestrator's, and the sub-agent kind.
ORCHESTRATOR_KINDS = ["telegram", "main", "dashboard", "cron", "explicit"]
SUBAGENT_KIND = "subagent"
SPAWN_TOOL = "sessions_spawn"
REDACTED = "[REMOVED]"

BLOCK = "struct<type:string,text:string,thinking:string,id:string,name:string,arguments:string>"
MESSAGE = (
    f"struct<role:string,idempotencyKey:string,responseId:string,timestamp:string,model:string,stopReason:string,errorMessage:string,toolCallId:string,toolName:string,isError:boolean,"
    f"summary:string,tokensBefore:bigint,usage:struct<input:bigint,output:bigint,cacheRead:bigint,cacheWrite:bigint,totalTokens:bigint>,content:string>"
)
SCHEMA = f"type string, sessionKey string, agentId string, prompt string, toolName string, params string, ts string, durationMs string, success boolean, error string, channel string, `from` string, content string, timestamp string, messages array<{MESSAGE}>"


# ---- reading ------------------------------------------------------------------------------------------------------------


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """SRC-01, SRC-02: one row a line that holds a JSON object, with the file, and an order within it.

    Blank lines and lines that aren't objects go; `malformed` counts them. Splits of a file are in order of their start, and
    rows of a split in order of reading, so (start, within) is the order of lines.
    """
    text = spark.read.option("pathGlobFilter", "*.jsonl").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("within"))
    return parsed_lines(text.select("value", "file", F.struct("start", "within").alias("ord")))


def write_bundles(lines: DataFrame, path: str) -> None:
    """Lines (file, ord, value) of any number of captures as a few text files: a line each, the file's name, a tab, the line.

    Part files are ranges of (file, ord), so a capture may go over several of them; all its lines are there, in order of parts.
    """
    lines.repartitionByRange("file", "ord").sortWithinPartitions("file", "ord").select(F.concat("file", F.lit("\t"), "value").alias("value")).write.text(path)


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """SRC-01, SRC-02: the lines of bundles as events, as read_lines has those of files. The order is that of part, split and row."""
    text = spark.read.option("pathGlobFilter", "part-*").text(path).select("value", "_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id().alias("within"))
    part = F.regexp_extract("file_name", r"^part-(\d+)", 1).cast("bigint")
    start = F.shiftleft(part, 40) + F.col("file_block_start")
    return parsed_lines(text.select(F.expr("substring(value, instr(value, '\t') + 1)").alias("value"), F.substring_index("value", "\t", 1).alias("file"), F.struct(start.alias("start"), "within").alias("ord")))


def parsed_lines(lines: DataFrame) -> DataFrame:
    """SRC-01: lines (file, ord, value) as events."""
    parsed = lines.filter("trim(value) <> ''").withColumn("e", F.from_json("value", SCHEMA))
    return parsed.filter(F.col("e").isNotNull() & F.startswith(F.ltrim("value"), F.lit("{")) & F.col("e.type").isNotNull()).select("file", "ord", "e.*")


def malformed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines by file that can't be read as an object."""
    text = spark.read.option("pathGlobFilter", "*.jsonl").text(path).select("value", F.col("_metadata.file_path").alias("file")).filter("trim(value) <> ''")
    return text.filter(F.from_json("value", "type string")["type"].isNull()).groupBy("file").agg(F.count(F.lit(1)).alias("n"))


def route(paths: list[str], heads: dict[str, str] | None = None) -> str:
    """SRC-03: `telemetry` or `log` by suffix, or by the head of a JSON file; both at once are an error."""
    kinds = {"telemetry" if p.endswith(".jsonl") else "log" if p.endswith(".eval") or {'"version"', '"eval"'} <= {w for w in ('"version"', '"eval"') if w in (heads or {}).get(p, "")[:512]} else "unknown" for p in paths}
    if len(kinds) != 1 or "unknown" in kinds:
        raise ValueError(f"inputs must all be telemetry, or all logs; these are {sorted(kinds)}")
    return kinds.pop()


# ---- scalar rules -------------------------------------------------------------------------------------------------------


def session_kind(key: Column | str) -> Column:
    """ING-01: the third part of a session key."""
    return F.get(F.split(tx.col(key), ":"), F.lit(2))


def session_id(key: Column | str) -> Column:
    """ING-01: the last of four parts at least, unless it is redacted."""
    parts = F.split(tx.col(key), ":")
    last = tx.strip(F.element_at(parts, -1))
    return F.when((F.size(parts) >= 4) & (last != REDACTED) & (last != ""), last)


def millis(x: Column | str) -> Column:
    """ING-17: positive whole milliseconds, as numbers or text, as a timestamp; else NULL."""
    n = tx.col(x).try_cast("bigint")
    return F.when(n > 0, F.timestamp_millis(n))


def blocks(content: Column | str) -> Column:
    """ING-20: content as typed blocks: text is one text block."""
    c = tx.col(content)
    return F.when(F.startswith(F.ltrim(c), F.lit("[")), F.from_json(c, f"array<{BLOCK}>")).when(c.isNotNull(), F.array(F.struct(F.lit("text").alias("type"), c.alias("text"), *[F.lit(None).cast("string").alias(n) for n in ("thinking", "id", "name", "arguments")])))


def content_text(content: Column | str) -> Column:
    """ING-20: the text of all text blocks."""
    return F.array_join(F.transform(F.filter(blocks(content), lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")


def tool_calls(content: Column | str) -> Column:
    return F.filter(blocks(content), lambda b: b["type"] == "toolCall")


def keyless(content: Column | str) -> Column:
    """ING-04: content as JSON with the ids of tool calls blanked."""
    return F.to_json(F.transform(blocks(content), lambda b: F.struct(b["type"], b["text"], b["thinking"], b["name"], b["arguments"])))


def stop_reason(reason: Column | str) -> Column:
    """ING-15: the stop reason in common words; an unknown one is `unknown`."""
    r = tx.col(reason)
    return F.when(r.isNull() | (r == "stop"), "stop").when(r == "toolUse", "tool_calls").when(r == "length", "max_tokens").otherwise("unknown")


def total_tokens(usage: Column | str) -> Column:
    """ING-19: input, output and both cache counts, missing ones as 0."""
    u = tx.col(usage)
    return sum((F.coalesce(u[f], F.lit(0)) for f in ("output", "cacheRead", "cacheWrite")), F.coalesce(u["input"], F.lit(0)))


def task_line(prompt: Column | str, cap: int = 80) -> Column:
    """ING-18: the first line of a prompt that bears a task, cut with an ellipsis."""
    lines = F.filter(F.split(tx.col(prompt), "\n"), lambda s: (tx.strip(s) != "") & ~tx.strip(s).rlike(r"^(\[[^\]]*\]|<[^>]*>|#+.*|-{3,})$"))
    first = tx.flat(F.regexp_replace(F.get(lines, F.lit(0)), r"^\s*(<[^>]*>|\[[^\]]*\])\s*", ""))
    return F.when(F.length(first) > cap, F.concat(F.substring(first, 1, cap - 1), F.lit("…"))).otherwise(first)


def message_id(*parts: Column | str) -> Column:
    """ING-22: a stable id of a message: a hash of what tells it apart."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(tx.col(p).cast("string"), F.lit("")) for p in parts]), 256), 1, 22)


# ---- consolidation ----------------------------------------------------------------------------------------------------------


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def messages(events: DataFrame) -> DataFrame:
    """ING-02, ING-03: messages of all snapshots, each once: it recurs in every later snapshot of its session.

    Kept apart by response id, call id, idempotency key, or by session, stamp and content without call ids. A session of an
    unknown kind is an error, not a loss.
    """
    kind = session_kind("sessionKey")
    known = kind.isin(*ORCHESTRATOR_KINDS, SUBAGENT_KIND)
    each = events.filter("messages is not null").select("file", "ord", "sessionKey", F.when(known, kind).otherwise(F.raise_error(F.concat(F.lit("unknown session kind in "), F.coalesce("sessionKey", F.lit("NULL"))))).alias("kind"), F.posexplode("messages").alias("pos", "m")).select("file", "ord", "sessionKey", "kind", "pos", "m.*")
    masked = F.concat_ws("\x1f", "sessionKey", "timestamp", keyless("content"))
    key = (
        F.when(F.col("role") == "assistant", F.coalesce(F.concat(F.lit("r:"), "responseId"), F.concat(F.lit("k:"), masked)))
        .when(F.col("role") == "toolResult", F.concat(F.lit("c:"), "toolCallId"))
        .when(F.col("role") == "compactionSummary", F.concat_ws("\x1f", F.lit("s:"), "sessionKey", "timestamp"))
        .otherwise(F.coalesce(F.concat(F.lit("i:"), "idempotencyKey"), F.concat(F.lit("u:"), masked)))
    )
    return first_of(each.withColumn("key", key), ["file", "role", "key"], ["ord", "pos"])


def without_twins(users: DataFrame) -> DataFrame:
    """ING-05: user turns without a key go where a keyed turn of the session has the same text."""
    keyed = users.filter("idempotencyKey is not null").select("file", "sessionKey", "text").distinct()
    return users.filter("idempotencyKey is not null").unionByName(users.filter("idempotencyKey is null").join(keyed, ["file", "sessionKey", "text"], "left_anti"))


def drop_rollups(turns: DataFrame, session: list[str], order: list[str]) -> DataFrame:
    """ING-06: aggregates that repeat the total of the row before: no response id, an ordinary stop, no tool calls, and parts that don't add up.

    A dropped row has the total of the one before it, so the previous row stands for the previous kept row.
    """
    last = F.lag("total").over(Window.partitionBy(*session).orderBy(*order))
    parts = F.coalesce("input", F.lit(0)) + F.coalesce("output", F.lit(0)) + F.coalesce("cache_read", F.lit(0)) + F.coalesce("cache_write", F.lit(0))
    some = F.coalesce("input", "output", "cache_read", "cache_write").isNotNull()
    gone = F.col("response_id").isNull() & (F.col("stop_reason").isNull() | (F.col("stop_reason") == "stop")) & (F.col("n_tool_calls") == 0) & F.col("total").isNotNull() & (F.col("total") == last) & some & (parts != F.col("total"))
    return turns.withColumn("_gone", F.coalesce(gone, F.lit(False))).filter("not _gone").drop("_gone")


def primary_model(turns: DataFrame, by: list[str], order: str = "ord") -> DataFrame:
    """ING-07: the most frequent model, ties to the first seen."""
    n = turns.filter("model is not null").groupBy(*by, "model").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return first_of(n.withColumn("_n", -F.col("n")), by, ["_n", "first"]).select(*by, "model")


def spawn_links(results: DataFrame) -> DataFrame:
    """ING-08: child session to the call that spawned it; the last one wins. results: file, ord, toolCallId, toolName, content."""
    child = F.get_json_object(content_text("content"), "$.childSessionKey")
    return results.filter(F.col("toolName") == SPAWN_TOOL).withColumn("child", child).filter("child is not null").groupBy("file", "child").agg(F.max_by("toolCallId", "ord").alias("call_id"))


#: Rows of a file whose running maximum is one window; windows of windows carry it on, so a long file isn't one task.
ANCHOR_ROWS = 4096


def file_anchor(rows: DataFrame) -> DataFrame:
    """ING-10: the largest orchestrator stamp in front of each session's first row. rows: file, ord (a number, or start and within), session, is_main, stamp."""
    kind = rows.schema["ord"].dataType.typeName()
    part = F.struct("ord.start", F.floor(F.col("ord.within") / ANCHOR_ROWS)) if kind == "struct" else F.floor(F.col("ord") / ANCHOR_ROWS)
    own = rows.withColumn("_part", part).withColumn("_stamp", F.when(F.col("is_main"), F.col("stamp")))
    so_far = Window.partitionBy("file").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = own.groupBy("file", "_part").agg(F.max("_stamp").alias("_most")).withColumn("_before", F.max("_most").over(so_far)).select("file", "_part", "_before")
    here = F.max("_stamp").over(Window.partitionBy("file", "_part").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    first = first_of(own.withColumn("_here", here).select("file", "session", "ord", "_part", "_here"), ["file", "session"], ["ord"])
    return first.join(parts, ["file", "_part"]).select("file", "session", F.greatest("_before", "_here").alias("anchor"))


def merged(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """ING-12: rows of several kinds in one order: by stamp, then kind, then their own order. Each part: file, stamp, ord, kind, payload."""
    rows = None
    for df, rank in parts:
        own = df.withColumn("kind_rank", F.lit(rank))
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    return rows.withColumn("ev", F.row_number().over(Window.partitionBy("file").orderBy(F.asc_nulls_first("stamp"), "kind_rank", "ord")) - 1)


def subagent_tools(events: DataFrame) -> DataFrame:
    """ING-09: tool starts of sub-agent sessions with their ends, for sessions that have no turns of their own."""
    own = events.filter(F.col("type").isin("tool.start", "tool.end") & (session_kind("sessionKey") == SUBAGENT_KIND))
    numbered = own.withColumn("n", F.row_number().over(Window.partitionBy("sessionKey").orderBy("ord")))
    pairs = packing.pair_tools(numbered.select(F.col("sessionKey").alias("session"), F.col("n").cast("bigint").alias("ord"), F.when(F.col("type") == "tool.start", "start").otherwise("end").alias("type"), F.col("toolName").alias("name")))
    start = numbered.select(F.col("sessionKey").alias("session"), F.col("n").cast("bigint").alias("start_ord"), millis("ts").alias("started"), "params")
    end = numbered.select(F.col("sessionKey").alias("session"), F.col("n").cast("bigint").alias("end_ord"), millis("ts").alias("ended"), F.col("durationMs").try_cast("bigint").alias("duration_ms"), "success", "error")
    return pairs.join(start, ["session", "start_ord"]).join(end, ["session", "end_ord"], "left")


def transcripts(events: DataFrame, agent: str = "agent") -> DataFrame:
    """ING-11, ING-21: one row a file: id, date, total time and tokens, primary model; and the number of axis turns."""
    m = messages(events).filter("role = 'assistant'")
    turns = drop_rollups(
        m.select("file", "sessionKey", "kind", "ord", "pos", "model", F.col("timestamp").try_cast("bigint").alias("ms"), F.col("responseId").alias("response_id"), F.col("stopReason").alias("stop_reason"), F.size(tool_calls("content")).alias("n_tool_calls"), F.col("usage.totalTokens").alias("total"), F.col("usage.input").alias("input"), F.col("usage.output").alias("output"), F.col("usage.cacheRead").alias("cache_read"), F.col("usage.cacheWrite").alias("cache_write")),
        ["file", "sessionKey"],
        ["ms", "ord", "pos"],
    )
    main = turns.filter(F.col("kind") != SUBAGENT_KIND)
    session = events.filter(session_kind("sessionKey").isin(ORCHESTRATOR_KINDS)).groupBy("file").agg(F.min_by(session_id("sessionKey"), F.when(session_id("sessionKey").isNotNull(), F.col("ord"))).alias("session_id"))
    parts = sum((F.coalesce(F.col(c), F.lit(0)) for c in ("output", "cache_read", "cache_write")), F.coalesce(F.col("input"), F.lit(0)))
    sums = turns.groupBy("file").agg(F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"), F.sum(parts).alias("total_tokens"), F.count_if(F.col("kind") != SUBAGENT_KIND).alias("n_turns"))
    return sums.join(primary_model(main.withColumn("ord", F.struct("ord", "pos")), ["file"]), "file", "left").join(session, "file", "left").select(
        F.concat_ws("-", F.coalesce("session_id", tx.file_stem("file")), F.col("first_ms").cast("string")).alias("transcript_id"), "file", tx.file_stem("file").alias("task_name"), F.lit(agent).alias("agent"), F.timestamp_millis("first_ms").alias("date"), ((F.col("last_ms") - F.col("first_ms")) / 1000).alias("total_time"), "total_tokens", "n_turns", "model"
    )


def import_files(spark: SparkSession, path: str | list[str], target: str, agent: str = "agent") -> str:
    """SRC-04, SNK-01: imports files as a new snapshot; one id from two files, or nothing to import, is refused before anything is written."""
    return imported(read_lines(spark, path), target, agent)


def imported(events: DataFrame, target: str, agent: str = "agent") -> str:
    """SRC-04, SNK-01: events of read files or bundles as a new snapshot, refused as by import_files before the target has anything."""
    found = written(transcripts(events, agent), "transcripts")
    twice = found.groupBy("transcript_id").agg(F.count_distinct("file").alias("n"), F.min("file").alias("a"), F.max("file").alias("b")).filter("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0]['transcript_id']} comes from {twice[0]['a']} and {twice[0]['b']}")
    if found.isEmpty():
        raise ValueError("there is nothing to import")
    where = f"{target}/{uuid.uuid4().hex}"
    found.write.mode("errorifexists").parquet(where)
    return where
