"""Sharding by proportional stratified interleaving, in DataFrame functions only.

Rows of a source are put in a seeded random order; a row's fractional rank is (rank + 1/2) / rows of
its source. Sorting all rows by fractional rank spreads every source evenly, so equal cuts of that order
each hold the mixture of the whole. Shard sizes in rows differ by one at most.

No source is ranked in one task: a source's rows are dealt to BUCKETS ranges of the random key, ranked
in each range, and moved on by the rows of the ranges before. The global order is cut into ranges of
the fractional rank in the same way. Only ids, sizes and keys are shuffled, never texts.

Nulls: a null source is a source of its own; a null text has size 8 and crc32 0; a null doc_id takes part
in the order by its text. Equal rows may swap slots among themselves. An empty table gives no rows.
Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a source's random keys are cut into: hex digits of the key.
KEY_DIGITS = 3
#: Ranges that the fractional rank is cut into.
RANK_RANGES = 8192


def _offsets(df: DataFrame, by: list[str], over: str) -> DataFrame:
    """Rows before each range `over` of a group `by`, and rows of the group. At most one row a range."""
    counts = df.groupBy(*by, over).agg(F.count(F.lit(1)).alias("_here"))
    group = Window.partitionBy(*by) if by else Window.partitionBy()
    before = group.orderBy(over).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        *by, over, F.coalesce(F.sum("_here").over(before), F.lit(0)).alias("_before"), F.sum("_here").over(group).alias("_all")
    )


def interleave(docs: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, size, text_crc32, stratum, position (0-based, global) and total rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("stratum"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    known = F.coalesce(F.col("doc_id").cast("string"), F.concat_ws(":", F.lit("t"), "text_crc32", "size"))  # rows without an id spread by their texts
    key: Column = F.md5(F.concat_ws(":", F.lit(str(seed)), known).cast("binary"))
    slim = slim.withColumn("_key", key).withColumn("_range", F.substring("_key", 1, KEY_DIGITS))
    ties = ["_key", "doc_id", "text_crc32", "size"]
    ranked = slim.join(_offsets(slim, ["stratum"], "_range"), ["stratum", "_range"]).withColumn(
        "_rank", F.row_number().over(Window.partitionBy("stratum", "_range").orderBy(*ties)) - 1 + F.col("_before")
    )
    placed = ranked.select(
        "doc_id", "stratum", "size", "text_crc32", "_key", ((F.col("_rank") * 2 + 1) / (F.col("_all") * 2)).alias("_part")
    ).withColumn("_slice", F.floor(F.col("_part") * RANK_RANGES))
    order = Window.partitionBy("_slice").orderBy("_part", "stratum", *ties)
    return placed.join(_offsets(placed, [], "_slice"), "_slice").select(
        "doc_id", "size", "text_crc32", "stratum", (F.row_number().over(order) - 1 + F.col("_before")).alias("position"), F.col("_all").alias("total")
    )


def shard(docs: DataFrame, shards: int = 24, seed: int = 17) -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null under this law), stratum."""
    return (
        interleave(docs, seed)
        .withColumn("shard", F.expr(f"(position * {shards}) div total"))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            F.col("shard").cast("int").alias("shard"),
            (F.col("position") - F.expr(f"(shard * total + {shards - 1}) div {shards}")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "stratum",
        )
    )
