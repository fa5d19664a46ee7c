"""Judge calls as data: members, prompts, answers and their cache (VOT-03..05, VOT-14..21)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.schema import CALL_STATUSES, CHUNK_TURNS, EVIDENCE_LINES


@dataclass(frozen=True)
class Member:
    """VOT-03: a judge model at one repeat."""

    model: str
    roll: int = 0


def members(models: list[str], k_rolls: int = 1) -> list[Member]:
    """VOT-03: each of several models once, or one model k times; both at once and repeated models are refused."""
    if not models:
        raise ValueError("name at least one judge model")
    if len(set(models)) < len(models):
        raise ValueError("a judge model is named twice: use k_rolls to repeat one")
    if len(models) > 1 and k_rolls > 1:
        raise ValueError("either several judge models or several rolls of one")
    if k_rolls < 1:
        raise ValueError("k_rolls must be 1 or more")
    return [Member(m) for m in models] if len(models) > 1 else [Member(models[0], r) for r in range(k_rolls)]


def verify_armed(n_models: int, verify: bool | None = None, share: float = 0.05) -> bool:
    """VOT-05: on for one model, off for several unless asked for, which is refused."""
    if not 0 <= share <= 1:
        raise ValueError("the share of spot checks must lie between 0 and 1")
    if verify and n_models > 1:
        raise ValueError("a review is for one judge model: several judges review each other")
    return n_models == 1 if verify is None else verify


def setup(models: list[str], k_rolls: int = 1, verify: bool = False, verifier: str | None = None) -> dict:
    """VOT-04: the judges' setup, stamped on each result."""
    kind = "cohort" if len(models) > 1 else "k_roll" if k_rolls > 1 else "solo"
    return {"regime": kind, "models": models, "n_models": len(models), "k_rolls": k_rolls, "verifier_armed": verify, "verifier_model": verifier if verify else None, "verifier_same_model": bool(verify and verifier in models)}


# ---- prompts -------------------------------------------------------------------------------------------------------------


def vocabulary_lines(vocabulary: DataFrame) -> DataFrame:
    """VOT-19: a surface's labels as lines in declared order."""
    line = F.concat(F.lit("- "), "label", F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(": "), "description")).otherwise(""))
    return vocabulary.groupBy("surface").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("t")))), lambda x: x["t"]), "\n").alias("lines"))


def chunks(digests: DataFrame, size: int = CHUNK_TURNS) -> DataFrame:
    """VOT-14, VOT-19: user prompts of `size` digest turns each. digests: transcript_id, turn, line."""
    i = F.row_number().over(Window.partitionBy("transcript_id").orderBy("turn")) - 1
    numbered = digests.withColumn("chunk", F.floor(i / size).cast("bigint"))
    line = F.concat(F.lit("Turn "), F.col("turn").cast("string"), F.lit(": "), "line")
    return numbered.groupBy("transcript_id", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("t")))), lambda x: x["t"]), "\n").alias("prompt"), F.min("turn").alias("first"), F.max("turn").alias("last"))


def evidence(phases: DataFrame, digests: DataFrame, cap: int = EVIDENCE_LINES) -> DataFrame:
    """VOT-17, VOT-19: the digest lines of each phase, at most `cap` of them with the middle left out."""
    from turnloom.functions.text import elide

    inside = phases.select("transcript_id", "phase_index", "turn_start", "turn_end").join(digests, "transcript_id").filter("turn between turn_start and turn_end")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"])
    return inside.groupBy("transcript_id", "phase_index").agg(lines.alias("_l")).select("transcript_id", "phase_index", F.array_join(elide("_l", cap), "\n").alias("evidence"))


def calls(prompts: DataFrame, who: list[Member], system: str) -> DataFrame:
    """One row a call: prompt_key, model, roll, system, prompt. The key is a hash of all that the answer depends on."""
    m = F.array(*[F.struct(F.lit(x.model).alias("model"), F.lit(x.roll).alias("roll")) for x in who])
    return prompts.select("*", F.explode(m).alias("_m")).select(*prompts.columns, "_m.model", "_m.roll").withColumn("system", F.lit(system)).withColumn("prompt_key", F.sha2(F.concat_ws("\x1f", "system", "prompt"), 256))


# ---- answers -------------------------------------------------------------------------------------------------------------


def answered(asked: DataFrame, cache: DataFrame, ask: Callable[[str, str, str, int], tuple[str | None, str]] | None = None) -> DataFrame:
    """VOT-18, VOT-21: answers of calls, from the cache table by (prompt_key, model, roll), else by `ask` in batches.

    ask(system, prompt, model, roll) gives (value, status); a failed call is asked once more. Write what was asked to
    the cache before it is used further: a retried task then finds the answers of the one that was lost.
    """
    keys = ["prompt_key", "model", "roll"]
    known = asked.join(cache.select(*keys, "value", "status"), keys, "left")
    if ask is None:
        return known.withColumn("status", F.coalesce("status", F.lit("no_answer")))
    missing = known.filter("status is null").drop("value", "status")
    schema = T.StructType([*missing.schema.fields, T.StructField("value", T.StringType()), T.StructField("status", T.StringType())])

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                value, status = ask(r["system"], r["prompt"], r["model"], r["roll"])
                if status not in ("ok", "refusal"):
                    value, status = ask(r["system"], r["prompt"], r["model"], r["roll"])
                out.append((value, status if status in CALL_STATUSES else "error"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string())], [*b.schema.names, "value", "status"])

    return known.filter("status is not null").select(*schema.names).unionByName(missing.mapInArrow(asking, schema))


SEGMENTS = "segments array<struct<turn_start:bigint,turn_end:bigint,phase:string,confidence:double,explanation:string>>"


def segments(answers: DataFrame, vocabulary: list[str]) -> DataFrame:
    """VOT-20: segments of answers that hold to the schema and the closed vocabulary."""
    each = answers.filter("status = 'ok'").withColumn("_v", F.from_json("value", SEGMENTS)).select("transcript_id", "chunk", "model", "roll", "first", "last", F.posexplode("_v.segments").alias("ord", "_s")).select("*", "_s.*").drop("_s")
    return each.filter(F.col("phase").isin(vocabulary) & F.col("turn_start").isNotNull() & F.col("turn_end").isNotNull())


def classified(answers: DataFrame, vocabulary: list[str]) -> DataFrame:
    """VOT-15, VOT-20: labels of single answers; one outside the vocabulary is no answer."""
    v = F.from_json("value", "label string, confidence double, explanation string")
    a = answers.withColumn("_v", v)
    ok = (F.col("status") == "ok") & F.col("_v.label").isin(vocabulary)
    return a.select("unit", "model", "roll", F.when(ok, F.col("_v.label")).alias("label"), F.when(ok, F.col("_v.confidence")).alias("confidence"), F.col("_v.explanation").alias("explanation"), F.when(ok, "ok").when(F.col("status") == "ok", "no_answer").otherwise(F.col("status")).alias("status"))


def narrated(phases: DataFrame, narratives: DataFrame) -> DataFrame:
    """VOT-16: headline and summary of each phase, by template where no narrative came."""
    made = F.format_string("%s, turns %s to %s", F.col("phase"), F.col("turn_start").cast("string"), F.col("turn_end").cast("string"))
    return phases.join(narratives, ["transcript_id", "phase_index"], "left").select(*phases.columns, F.coalesce("headline", made).alias("headline"), F.coalesce("summary", F.lit("")).alias("summary"), F.when(F.col("headline").isNull(), "no_narrative").otherwise("complete").alias("narration"))


def numbered_rules(rules: list[str]) -> str:
    return "\n".join(f"{i}. {r}" for i, r in enumerate(rules, 1))


def in_vocabulary(label: Column, words: list[str]) -> Column:
    return F.when(label.isin(words), label)
