"""The driver tables as transcripts: DataFrame adapters, and the same as SQL for a second engine.

`*_SQL` are the bodies of common table expressions; `with_sql` puts those that a query names in front of it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as model, tool and compaction rows of a main lane, lanes A and B, and rows off the axis (lane NULL)."""
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.when(F.col("event_type") == "error", "tool").when(F.col("event_type") == "signup", "compaction").otherwise("model")
    lane = F.when(F.col("k").isin(92, 97), None).when(F.col("k") % 5 == 0, "A").when(F.col("k") % 5 == 1, "B").otherwise("main")
    per = Window.partitionBy("transcript_id").orderBy("ts", "event_id")
    base = (
        e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("transcript_id"), "event_id", "ts", "event_type", "value", k.alias("k"))
        .withColumn("ev", F.row_number().over(per) - 1)
        .withColumn("kind", kind)
        .withColumn("lane", lane)
        .withColumn("model_row", F.when(F.col("kind") == "model", 1))
    )
    in_lane = Window.partitionBy("transcript_id", "lane").orderBy("ev").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("model_row").over(in_lane), F.lit(0))
    placed = F.col("lane").isNotNull() & (F.col("kind") == "model")
    return base.withColumn("lane_turn", F.when(placed, before)).select(
        "transcript_id",
        F.col("ev").cast("bigint").alias("ev"),
        "ts",
        "event_type",
        "kind",
        "lane",
        F.when(F.col("lane") == "main", F.col("lane_turn")).alias("turn"),
        "lane_turn",
        F.when(F.col("k") % 11 != 10, F.floor(F.col("value") * 10)).cast("bigint").alias("input_tokens"),
        F.col("k").alias("output_tokens"),
        ((F.col("k") % 7) * 50).alias("cache_read"),
        ((F.col("k") % 4) * 25).alias("cache_write"),
        F.when(F.col("lane") == "main", "auditor").when(F.col("lane") == "A", "target").alias("role"),
        "k",
    )


def spans(tl: DataFrame) -> DataFrame:
    """One span a transcript and lane A or B: first and last stamp, and the main turn it was spawned in."""
    started = Window.partitionBy("transcript_id").orderBy("ev").rowsBetween(Window.unboundedPreceding, -1)
    turns = F.coalesce(F.sum(F.when(F.col("turn").isNotNull(), 1)).over(started), F.lit(0))
    return (
        tl.withColumn("turns_before", turns)
        .filter(F.col("lane").isin("A", "B"))
        .groupBy("transcript_id", F.col("lane").alias("span_id"))
        .agg(
            F.min("ts").alias("started_at"),
            F.max("ts").alias("ended_at"),
            F.greatest(F.min("turns_before") - 1, F.lit(0)).alias("spawn_turn"),
        )
        .withColumn("parent_id", F.when(F.col("span_id") == "B", "A"))
    )


def judged_turns(tl: DataFrame) -> DataFrame:
    """A judgement of every axis turn: label, basis, confidence in hundredths."""
    m = F.col("k") % 13
    return tl.filter("turn is not null").select(
        "transcript_id",
        "turn",
        F.when(m != 12, F.col("event_type")).alias("label"),
        F.when(m == 12, "refusal").when(m == 11, "filled").otherwise("judged").alias("basis"),
        F.when(m == 12, None).when(m == 11, 30).otherwise(50 + F.col("k") % 50).cast("bigint").alias("conf100"),
    )


def ballots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of seven judges (line numbers) on orders: label, confidence in tenths, status."""
    line = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("line_status"), F.max(F.round(F.col("l_discount") * 100)).cast("bigint").alias("conf10")
    )
    refused = (F.col("l_linenumber") == 7) & (F.col("line_status") == "O")
    return line.select(
        F.concat(F.lit("o"), (F.col("l_orderkey") % 8).cast("string")).alias("transcript_id"),
        F.col("l_orderkey").alias("unit"),
        F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("model"),
        F.lit(0).alias("roll"),
        F.when(~refused, F.col("flag")).alias("label"),
        F.when(~refused, F.col("conf10")).alias("conf10"),
        F.when(refused, "refusal").otherwise("ok").alias("status"),
        F.col("l_linenumber").cast("bigint").alias("ord"),
    )


def raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two raters' votes on documents, from labels."""
    return read(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("unit"), F.explode(F.map_from_arrays(F.array(F.lit("quality"), F.lit("toxic")), F.array("quality", "toxic"))).alias("model", "vote")
    ).select("unit", "model", F.col("vote").cast("string").alias("label"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of orders: trigger, labels before and after, confidence in hundredths, whether overturned."""
    nxt = F.when(F.col("o_orderstatus") == "F", "O").when(F.col("o_orderstatus") == "O", "P").otherwise("F")
    digit = F.substring("o_orderpriority", 1, 1)
    trigger = F.when(digit == "1", "low_confidence").when(digit == "2", "low_agreement").when(digit == "3", "wedge").otherwise("random_sample")
    r = read(spark, sf_dir, "orders").select(
        F.concat(F.lit("o"), (F.col("o_orderkey") % 8).cast("string")).alias("transcript_id"),
        F.col("o_orderkey").alias("unit"),
        trigger.alias("trigger"),
        F.col("o_orderstatus").alias("original_label"),
        F.when(F.col("o_custkey") % 17 == 0, None).when(F.col("o_custkey") % 5 == 0, nxt).otherwise(F.col("o_orderstatus")).alias("verifier_label"),
        (40 + F.col("o_orderkey") % 60).alias("verifier_conf100"),
    )
    return r.withColumn("overturned", F.coalesce((F.col("verifier_label") != F.col("original_label")) & (F.col("verifier_conf100") >= 60), F.lit(False)))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as threads: assistant rows are axis turns."""
    c = read(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    is_turn = F.when(F.col("role") == "assistant", 1)
    return c.select(
        F.col("conv_id").alias("transcript_id"),
        F.col("turn").alias("ev"),
        "role",
        "text",
        F.when(F.col("role") == "assistant", F.coalesce(F.sum(is_turn).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("turn"),
    )


TL_SQL = """
  SELECT transcript_id, ev, ts, event_type, kind, lane, CASE WHEN lane = 'main' THEN lane_turn END AS turn, lane_turn,
    CASE WHEN k % 11 <> 10 THEN CAST(floor(value * 10) AS BIGINT) END AS input_tokens, k AS output_tokens,
    (k % 7) * 50 AS cache_read, (k % 4) * 25 AS cache_write,
    CASE lane WHEN 'main' THEN 'auditor' WHEN 'A' THEN 'target' END AS role, k
  FROM (
    SELECT *, CASE WHEN lane IS NOT NULL AND kind = 'model' THEN
      CAST(coalesce(sum(CASE WHEN kind = 'model' THEN 1 END) OVER (PARTITION BY transcript_id, lane ORDER BY ev ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) END AS lane_turn
    FROM (
      SELECT 'u' || user_id AS transcript_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ev, ts, event_type, value,
        CASE event_type WHEN 'error' THEN 'tool' WHEN 'signup' THEN 'compaction' ELSE 'model' END AS kind,
        CASE WHEN k IN (92, 97) THEN NULL WHEN k % 5 = 0 THEN 'A' WHEN k % 5 = 1 THEN 'B' ELSE 'main' END AS lane, k
      FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)))"""
SPAN_SQL = """
  SELECT transcript_id, lane AS span_id, min(ts) AS started_at, max(ts) AS ended_at, CAST(greatest(min(turns_before) - 1, 0) AS BIGINT) AS spawn_turn,
    CASE WHEN lane = 'B' THEN 'A' END AS parent_id
  FROM (SELECT *, coalesce(sum(CASE WHEN turn IS NOT NULL THEN 1 END) OVER (PARTITION BY transcript_id ORDER BY ev ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turns_before FROM tl)
  WHERE lane IN ('A', 'B') GROUP BY transcript_id, lane"""
PHASE_SQL = """
  SELECT transcript_id, turn, CASE WHEN k % 13 <> 12 THEN event_type END AS label,
    CASE k % 13 WHEN 12 THEN 'refusal' WHEN 11 THEN 'filled' ELSE 'judged' END AS basis,
    CASE k % 13 WHEN 12 THEN NULL WHEN 11 THEN 30 ELSE 50 + k % 50 END AS conf100
  FROM tl WHERE turn IS NOT NULL"""
BAL_SQL = """
  SELECT 'o' || (l_orderkey % 8) AS transcript_id, l_orderkey AS unit, 'm' || l_linenumber AS model, 0 AS roll,
    CASE WHEN NOT refused THEN flag END AS label, CASE WHEN NOT refused THEN conf10 END AS conf10, CASE WHEN refused THEN 'refusal' ELSE 'ok' END AS status,
    CAST(l_linenumber AS BIGINT) AS ord
  FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS flag, CAST(max(round(l_discount * 100)) AS BIGINT) AS conf10,
      l_linenumber = 7 AND min(l_linestatus) = 'O' AS refused
    FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
LAB_SQL = """
  SELECT doc_id AS unit, 'quality' AS model, CAST(quality AS VARCHAR) AS label FROM labels
  UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS VARCHAR) FROM labels"""
REV_SQL = """
  SELECT *, coalesce(verifier_label <> original_label AND verifier_conf100 >= 60, false) AS overturned
  FROM (SELECT 'o' || (o_orderkey % 8) AS transcript_id, o_orderkey AS unit,
      CASE o_orderpriority[1] WHEN '1' THEN 'low_confidence' WHEN '2' THEN 'low_agreement' WHEN '3' THEN 'wedge' ELSE 'random_sample' END AS trigger,
      o_orderstatus AS original_label,
      CASE WHEN o_custkey % 17 = 0 THEN NULL WHEN o_custkey % 5 = 0 THEN CASE o_orderstatus WHEN 'F' THEN 'O' WHEN 'O' THEN 'P' ELSE 'F' END ELSE o_orderstatus END AS verifier_label,
      40 + o_orderkey % 60 AS verifier_conf100
    FROM orders)"""
CONV_SQL = """
  SELECT conv_id AS transcript_id, turn AS ev, role, text,
    CASE WHEN role = 'assistant' THEN CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) END AS turn
  FROM conversations"""

#: In order of dependence.
PARTS = {"tl": TL_SQL, "span": SPAN_SQL, "phase": PHASE_SQL, "bal": BAL_SQL, "lab": LAB_SQL, "rev": REV_SQL, "conv": CONV_SQL}
NEEDS = {"span": ["tl"], "phase": ["tl"]}


def with_sql(body: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """body behind the adapters that it (or extra, further named parts in order) mentions."""
    extra = extra or {}
    text = body + " ".join(extra.values())
    used = [n for n in PARTS if re.search(rf"\b{n}\b", text)]
    used = [n for n in PARTS if n in used or any(n in NEEDS.get(u, []) for u in used)]
    parts = [f"{n} AS ({PARTS[n]})" for n in used] + [f"{n} AS ({sql})" for n, sql in extra.items()]
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(parts) + "\n" + body if parts else body
