"""Tag families of turns (FRM-17, FLT-07, JON-12, JON-13)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys and identity columns, and bookkeeping columns of judged tables, aren't families.
IGNORED = frozenset(["transcript_id", "turn", "item", "sample_id", "task_set", "epoch", "agent", "schema_version"])
RESERVED = frozenset(["answer", "confidence", "error", "explanation", "judge_agreement", "judge_models", "label_source", "model", "span_task", "span_task_source", "status", "verifier_model"])


def taggable(frame: DataFrame) -> list[str]:
    """FLT-07: the text columns that can be families."""
    return [f.name for f in frame.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in IGNORED | RESERVED and not f.name.startswith(("judge_", "verifier_"))]


def problems(layers: list[DataFrame], n_turns: DataFrame) -> DataFrame:
    """SET-06: rows that break a layer's contract: doubled keys, and turns outside the transcript's axis."""
    found = []
    for i, layer in enumerate(layers):
        keys = [c for c in ("transcript_id", "turn") if c in layer.columns]
        twice = layer.groupBy(*keys).count().filter("count > 1").select(*keys, F.lit(f"layer {i}: doubled").alias("reason"))
        found.append(twice if "transcript_id" in keys else twice.select(F.lit(None).cast("string").alias("transcript_id"), "turn", "reason"))
        if "transcript_id" in keys:
            outside = layer.join(n_turns, "transcript_id", "left").filter("turn < 0 or n_turns is null or turn >= n_turns")
            found.append(outside.select("transcript_id", "turn", F.lit(f"layer {i}: no such turn").alias("reason")))
    return reduce(lambda a, b: a.unionByName(b), found)


def wide(layers: list[DataFrame], n_turns: DataFrame, cut: bool = False) -> DataFrame:
    """FRM-17: one row a transcript and turn with all families; a layer without transcripts goes to each of them.

    A layer's families must be its own. cut: turns behind a transcript's end are left out rather than an error.
    """
    names = [c for layer in layers for c in taggable(layer)]
    if len(set(names)) < len(names):
        raise ValueError(f"families of several layers share a name: {sorted({n for n in names if names.count(n) > 1})}")
    whole = []
    for layer in layers:
        if "transcript_id" in layer.columns:
            own = layer
        elif cut:
            own = n_turns.select("transcript_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_turns") - 1)).alias("turn")).join(layer.withColumn("turn", F.col("turn").cast("bigint")), "turn")
        else:
            own = n_turns.select("transcript_id").crossJoin(layer)  # every row for every transcript is what it asks for
        whole.append(own.select("transcript_id", "turn", *taggable(layer)))
    return reduce(lambda a, b: a.join(b, ["transcript_id", "turn"], "full"), whole)
