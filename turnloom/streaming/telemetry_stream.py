"""Telemetry as a stream: message dedup within a watermark, windowed spend, and running lane contexts.

The batch operators are the contract; these give the same rows for input that arrives in order, late rows
within the watermark included.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from turnloom.sources.telemetry import SCHEMA


def stream_lines(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-01 as a stream: objects of lines of the *.jsonl files that arrive in a folder."""
    text = spark.readStream.format("text").option("pathGlobFilter", "*.jsonl").load(folder)
    return text.withColumn("e", F.from_json("value", SCHEMA)).filter("e.type is not null").select("e.*")


def deduped(messages: DataFrame, key: list[str], stamp: str = "ts", late: str = "1 hour") -> DataFrame:
    """ING-03 as a stream: the first row of each key, as long as repeats come within `late`."""
    return messages.withWatermark(stamp, late).dropDuplicatesWithinWatermark(key)


def windowed_spend(turns: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Tokens by transcript and tumbling window; a window is final once the watermark has passed it."""
    return turns.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "transcript_id").agg(F.count(F.lit(1)).alias("turns"), F.sum("output_tokens").alias("output_tokens")).select("transcript_id", F.col("w.start").alias("window_start"), "turns", "output_tokens")


def running_contexts(turns: DataFrame) -> DataFrame:
    """WIN-01 as a stream: new work of each turn from the lane's last context, which is all the state there is.

    turns: transcript_id, lane, ev, input_tokens, output_tokens, cache_read, cache_write; a lane's rows arrive in order.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("ev")
        out = []
        for r in rows.itertuples():
            parts = [0 if pd.isna(x) else int(x) for x in (r.input_tokens, r.output_tokens, r.cache_read, r.cache_write)]
            if pd.isna(r.input_tokens) or not any(parts):
                out.append((key[0], key[1], r.ev, None, None))
                continue
            context = parts[0] + parts[3] + parts[2]
            out.append((key[0], key[1], r.ev, context, parts[0] + parts[1] + min(parts[3], max(0, context - last))))
            last = context
        state.update((last,))
        frame = pd.DataFrame(out, columns=["transcript_id", "lane", "ev", "context", "new_work"])
        yield frame.astype({"ev": "int64", "context": "Int64", "new_work": "Int64"})

    return turns.groupBy("transcript_id", "lane").applyInPandasWithState(step, "transcript_id string, lane string, ev long, context long, new_work long", "last long", "append", GroupStateTimeout.NoTimeout)
