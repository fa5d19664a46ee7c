"""Rolled-back conversations as trees of trajectories (BRN-01..06, SET-07, WIN-18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.operators.axis import DEPTH, before
from turnloom.operators.phases import islands


def target_calls(events: DataFrame) -> DataFrame:
    """BRN-01: a target's calls numbered from 1, with their attempt, place in it, driving turn and the prompts since the call or rollback before.

    events: transcript_id, ev, kind (call, prompt, rollback, turn), attempt, text.
    """
    step = F.coalesce(F.sum(F.when(F.col("kind").isin("call", "rollback"), 1)).over(before("transcript_id")), F.lit(0))
    e = events.withColumn("_step", step).withColumn("driver_turn", F.sum(F.when(F.col("kind") == "turn", 1)).over(before("transcript_id")) - 1)
    prompts = e.filter("kind = 'prompt'").groupBy("transcript_id", "_step").agg(F.transform(F.array_sort(F.collect_list(F.struct("ev", "text"))), lambda x: x["text"]).alias("prompts"))
    calls = e.filter("kind = 'call'").withColumn("number", F.row_number().over(Window.partitionBy("transcript_id").orderBy("ev")))
    calls = calls.withColumn("lane_turn", F.row_number().over(Window.partitionBy("transcript_id", "attempt").orderBy("ev")) - 1)
    return calls.join(prompts, ["transcript_id", "_step"], "left").select("transcript_id", "number", "attempt", "lane_turn", "driver_turn", F.coalesce("prompts", F.array().cast("array<string>")).alias("prompts"))


def stored_tree(timelines: DataFrame) -> DataFrame:
    """BRN-02: the one timeline named target (or ending so) with a branch root, else a note."""
    own = timelines.filter("(name = 'target' or endswith(name, '-target')) and has_branches")
    return own.groupBy("transcript_id").agg(F.when(F.count(F.lit(1)) == 1, F.min("name")).alias("name"), F.when(F.count(F.lit(1)) > 1, "more than one timeline is a target's").alias("note"))


def branches(calls: DataFrame, anchors: DataFrame, rollbacks: DataFrame) -> DataFrame:
    """BRN-03: each trajectory with its parent, the parent's calls before it forks off (0: a restart), and the turn of its rollback.

    calls: transcript_id, branch, ev; anchors: transcript_id, branch, parent, anchor_ev (NULL: restart); rollbacks: transcript_id, ev, turn.
    """
    first = calls.groupBy("transcript_id", "branch").agg(F.min("ev").alias("_first"), F.count(F.lit(1)).alias("n_calls"))
    a = anchors.join(first, ["transcript_id", "branch"], "left")
    kept = a.alias("a").join(calls.alias("c"), (F.col("a.transcript_id") == F.col("c.transcript_id")) & (F.col("a.parent") == F.col("c.branch")) & (F.col("c.ev") < F.col("a.anchor_ev")), "left")
    fork = kept.groupBy(F.col("a.transcript_id").alias("transcript_id"), F.col("a.branch").alias("branch")).agg(F.count("c.ev").alias("fork_after"))
    undo = a.alias("a").join(rollbacks.alias("r"), (F.col("a.transcript_id") == F.col("r.transcript_id")) & (F.col("r.ev") < F.col("a._first"))).groupBy(F.col("a.transcript_id").alias("transcript_id"), F.col("a.branch").alias("branch")).agg(F.max_by("r.turn", "r.ev").alias("rollback_turn"))
    return a.select("transcript_id", "branch", "parent", F.coalesce("n_calls", F.lit(0)).alias("n_calls")).join(fork, ["transcript_id", "branch"]).join(undo, ["transcript_id", "branch"], "left")


def surviving(tree: DataFrame, last: DataFrame, depth: int = DEPTH) -> DataFrame:
    """BRN-04: calls on the way from the last one back to the root: (transcript_id, branch, upto): the first `upto` calls of each branch.

    tree: transcript_id, branch, parent, fork_after; last: transcript_id, branch, n (calls of it that survive). More than `depth` levels are an error.
    """
    return tree.sparkSession.sql(
        f"""
        WITH RECURSIVE path(transcript_id, branch, upto) MAX RECURSION LEVEL {depth} AS (
          SELECT transcript_id, branch, CAST(n AS BIGINT) FROM {{last}}
          UNION ALL
          SELECT p.transcript_id, t.parent, CAST(t.fork_after AS BIGINT)
          FROM path p JOIN {{tree}} t ON t.transcript_id = p.transcript_id AND t.branch = p.branch
          WHERE t.parent IS NOT NULL)
        SELECT transcript_id, branch, upto FROM path""",
        tree=tree.select("transcript_id", "branch", "parent", "fork_after"),
        last=last.select("transcript_id", "branch", "n"),
    )


def discarded(calls: DataFrame, path: DataFrame) -> DataFrame:
    """SET-07: calls off the surviving path. calls: transcript_id, branch, branch_turn (from 0)."""
    kept = calls.join(path, ["transcript_id", "branch"]).filter("branch_turn < upto").select("transcript_id", "branch", "branch_turn")
    return calls.join(kept, ["transcript_id", "branch", "branch_turn"], "left_anti")


def file_calls(calls: DataFrame, per_turn: DataFrame) -> DataFrame:
    """BRN-05: calls under the phase of their driving turn, or none."""
    p = per_turn.select("transcript_id", F.col("turn").alias("driver_turn"), "phase_index")
    return calls.join(p, ["transcript_id", "driver_turn"], "left")


def diagram(tree: DataFrame, depth: int = DEPTH) -> DataFrame:
    """BRN-06: where each branch starts on the diagram: its parent's start and the calls before the fork. More than `depth` levels are an error."""
    return tree.sparkSession.sql(
        f"""
        WITH RECURSIVE at(transcript_id, branch, start) MAX RECURSION LEVEL {depth} AS (
          SELECT transcript_id, branch, CAST(0 AS BIGINT) FROM {{tree}} WHERE parent IS NULL
          UNION ALL
          SELECT a.transcript_id, t.branch, CAST(a.start + t.fork_after AS BIGINT)
          FROM at a JOIN {{tree}} t ON t.transcript_id = a.transcript_id AND t.parent = a.branch)
        SELECT transcript_id, branch, start FROM at""",
        tree=tree.select("transcript_id", "branch", "parent", "fork_after"),
    )


def exchange_items(calls: DataFrame) -> DataFrame:
    """WIN-18: neighbouring calls of one driving turn as one item."""
    g = islands(calls, ["transcript_id"], "number", ["driver_turn"])
    return g.groupBy("transcript_id", "island", "driver_turn").agg(F.min("number").alias("first_call"), F.max("number").alias("last_call"), F.count(F.lit(1)).alias("n_calls")).drop("island")


def error_text(error: Column | str) -> Column:
    """BRN-07: the message of a recorded error (JSON), or the text itself where it is none; NULL of nothing."""
    e = F.nullif(F.trim(F.col(error) if isinstance(error, str) else error), F.lit(""))
    return F.coalesce(F.when(e.startswith("{"), F.get_json_object(e, "$.message")), e)


def noted(found: DataFrame, wanted: DataFrame, note: str) -> DataFrame:
    """BRN-07: every wanted transcript, with a note where nothing could be extracted for it."""
    have = found.select("transcript_id").distinct().withColumn("_have", F.lit(True))
    return wanted.select("transcript_id").distinct().join(have, "transcript_id", "left").select("transcript_id", F.when(F.col("_have").isNull(), F.lit(note)).alias("note"))
