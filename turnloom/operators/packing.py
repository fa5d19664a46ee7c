"""Greedy interval packing of lanes (WIN-16), and matching that consumes rows (ING-09, ING-13)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_rows(starts: list[float], ends: list[float]) -> list[int]:
    """The first row whose last end lies before each start, in order of starts. A tree of least ends finds it in log(n) steps."""
    size = 1 << max(0, len(starts) - 1).bit_length()
    least = [float("-inf")] * (2 * size)  # a leaf a row; an empty row ends before everything
    out = []
    for a, b in zip(starts, ends, strict=True):
        at = 1
        while at < size:
            at = 2 * at if least[2 * at] < a else 2 * at + 1
        out.append(at - size)
        least[at] = b
        while at > 1:
            at //= 2
            least[at] = min(least[2 * at], least[2 * at + 1])
    return out


def pack(spans: DataFrame, footprint: float = 0.0) -> DataFrame:
    """WIN-16: row of each span: by label, in order of start, the first row whose last end lies before the start.

    An occupied span takes `footprint` at least. A transcript's spans of one label are one group: first fit looks at all spans before.
    """

    def packed(t: pa.Table) -> pa.Table:
        t = t.sort_by([("x0", "ascending"), ("span_id", "ascending")])
        starts = t.column("x0").to_pylist()
        rows = first_rows(starts, [max(b, a + footprint) for a, b in zip(starts, t.column("x1").to_pylist(), strict=True)])
        return t.select(["transcript_id", "label", "span_id"]).append_column("sub_row", pa.array(rows, pa.int32()))

    return spans.select("transcript_id", "label", "span_id", "x0", "x1").groupBy("transcript_id", "label").applyInArrow(packed, "transcript_id string, label string, span_id string, sub_row int")


def match_sends(sends: DataFrame, users: DataFrame) -> DataFrame:
    """ING-13: inbound messages matched with user turns of one text: the first unconsumed turn at or after, else an undated one.

    sends: transcript_id, text, ord, ts; users: transcript_id, text, ord, ts (or NULL). Adds user_ord, NULL if unmatched. Empty text
    matches nothing; a send without a stamp is before all. With f(i) dated turns before the i-th send of a text, that send takes the
    turn at place i + max over j <= i of f(j) - j: the turn after the one before it took, or the first late enough. So no group is folded.
    """
    keys = ["transcript_id", "text"]
    order = ["ts", "ord"]
    per = Window.partitionBy(*keys).orderBy(*order)
    mine = sends.select(*keys, "ord", F.coalesce("ts", F.lit(0)).alias("ts"))
    able = mine.filter("text <> ''")
    dated = users.filter("ts is not null and text <> ''").select(*keys, "ord", "ts")
    both = able.withColumn("_send", F.lit(1)).unionByName(dated.withColumn("_send", F.lit(0)))
    ahead = Window.partitionBy(*keys).orderBy("ts", F.desc("_send"), "ord").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("_f", F.sum(1 - F.col("_send")).over(ahead)).filter("_send = 1").withColumn("_i", F.row_number().over(per) - 1)
    placed = placed.withColumn("_p", F.col("_i") + F.max(F.col("_f") - F.col("_i")).over(per.rowsBetween(Window.unboundedPreceding, 0)))
    turns = dated.select(*keys, (F.row_number().over(per) - 1).alias("_p"), F.col("ord").alias("_turn"))
    found = placed.join(turns, [*keys, "_p"], "left")
    rest = found.filter("_turn is null").withColumn("_n", F.row_number().over(per))
    undated = users.filter("ts is null and text <> ''").select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy("ord")).alias("_n"), F.col("ord").alias("user_ord"))
    late = rest.join(undated, [*keys, "_n"], "left").select(*keys, "ord", "user_ord")
    none = mine.filter("text is null or text = ''").select(*keys, "ord", F.lit(None).cast("bigint").alias("user_ord"))
    return found.filter("_turn is not null").select(*keys, "ord", F.col("_turn").alias("user_ord")).unionByName(late).unionByName(none)


def pair_tools(events: DataFrame) -> DataFrame:
    """ING-09: tool ends paired with the latest open start of the same name in their session.

    events: session, ord, type (start or end), name. One row a start: session, name, start_ord, end_ord (NULL if never ended). Starts
    and ends are brackets: an end that finds none open goes, and of the others the next bracket at a start's depth is its end.
    """
    per = Window.partitionBy("session", "name").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    count = events.select("session", "ord", "type", "name").withColumn("_c", F.sum(F.when(F.col("type") == "start", 1).otherwise(-1)).over(per))
    depth = count.withColumn("_low", F.least(F.min("_c").over(per), F.lit(0)))
    before = Window.partitionBy("session", "name").orderBy("ord")
    useless = (F.col("type") != "start") & (F.col("_c") < F.coalesce(F.lag("_low").over(before), F.lit(0)))
    level = F.col("_c") - F.col("_low") + F.when(F.col("type") == "start", 0).otherwise(1)
    told = depth.withColumn("_useless", useless).filter("not _useless").withColumn("_level", level)
    after = Window.partitionBy("session", "name", "_level").orderBy("ord")
    ended = F.when(F.lead("type").over(after) != "start", F.lead("ord").over(after))
    return told.withColumn("end_ord", ended).filter("type = 'start'").select("session", "name", F.col("ord").alias("start_ord"), "end_ord")
