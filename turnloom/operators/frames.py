"""Public tables from stored scanner results (FRM-*, PRJ-*, JON-02..03, SRT-01)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions import text as tx
from turnloom.schema import SCHEMA_VERSION, STORED_IDENTITY


def identity(results: DataFrame) -> list[Column]:
    """PRJ-01: the identity columns, from their stored names."""
    return [F.col(stored if stored in results.columns else name).alias(name) for name, stored in STORED_IDENTITY.items() if stored in results.columns or name in results.columns]


def stamped(frame: DataFrame) -> DataFrame:
    """PRJ-04: with the schema version."""
    return frame.withColumn("schema_version", F.lit(SCHEMA_VERSION))


def clean(results: DataFrame) -> DataFrame:
    """FLT-01: rows without a scan error."""
    return results.filter(F.coalesce(F.col("scan_error"), F.lit("")) == "") if "scan_error" in results.columns else results


def vocabulary(column: Column, words: list[str]) -> Column:
    """PRJ-05: values outside the vocabulary as NULL."""
    return F.when(column.isin(words), column)


def decoded(results: DataFrame, schema: str) -> DataFrame:
    """PRJ-02: the JSON value as a struct; text that isn't JSON is an error."""
    return results.withColumn("value", F.from_json("value", schema, {"mode": "FAILFAST"}))


def exploded(results: DataFrame, schema: str, field: str) -> DataFrame:
    """FRM-02, FRM-04..05, FRM-07: identity, pos and the fields of each element of a list in the value."""
    d = decoded(clean(results), schema)
    return d.select(*identity(d), F.posexplode(f"value.{field}").alias("pos", "_e")).select("*", "_e.*").drop("_e")


def exploded_twice(results: DataFrame, schema: str, outer: str, inner: str) -> DataFrame:
    """FRM-08, FRM-09: identity, both positions, and the fields of inner elements of outer ones, which come along as `outer`."""
    d = decoded(clean(results), schema)
    first = d.select(*identity(d), F.posexplode(f"value.{outer}").alias("outer_pos", "outer"))
    return first.select("*", F.posexplode(f"outer.{inner}").alias("pos", "_e")).select("*", "_e.*").drop("_e")


def review_columns(review: str) -> list[Column]:
    """PRJ-07: a nested review as flat columns."""
    r = F.col(review)
    done = r.isNotNull() & F.coalesce(r["status"] == "ok", F.lit(True)) & F.coalesce(F.trim(r["verifier_label"]) != "", F.lit(False))
    return [
        r.isNotNull().alias("verifier_selected"), done.alias("verifier_completed"), F.coalesce(r["overturned"], F.lit(False)).alias("overturned"),
        r["trigger"].alias("verifier_trigger"), r["status"].alias("verifier_status"), r["original_label"].alias("original_label"), r["verifier_label"].alias("verifier_label"), r["verifier_confidence"].alias("verifier_confidence"),
    ]


def judge_columns(judge: str) -> list[Column]:
    """PRJ-06: the judges' setup; a missing block is an error."""
    j = F.col(judge)
    need = lambda f: F.when(j.isNull(), F.raise_error(F.lit("a result without a judge block: scan again"))).otherwise(j[f])
    return [need("regime").alias("judge_regime"), need("n_models").alias("judge_n_models"), need("k_rolls").alias("judge_k_rolls"), need("verifier_armed").alias("judge_verifier_armed"), need("verifier_same_model").alias("judge_verifier_same_model"), F.nullif(F.array_join(need("models"), "+"), F.lit("")).alias("judge_models")]


def transcript_info(results: DataFrame, setup_schema: str) -> DataFrame:
    """FRM-01: one row a transcript; errored ones keep their run columns and have NULL setup facts."""
    run = [c for c in results.columns if c.startswith("transcript_") and c not in STORED_IDENTITY.values()]
    ok = F.coalesce("scan_error", F.lit("")) == ""
    d = results.withColumn("_v", F.when(ok, F.from_json("value", setup_schema)))
    task = F.coalesce(tx.null_if_blank("transcript_task_set"), tx.file_stem("transcript_source_uri")) if "transcript_source_uri" in results.columns else tx.null_if_blank("transcript_task_set")
    return stamped(d.select(*identity(results), task.alias("task_name"), *[F.col(c).alias(c.removeprefix("transcript_")) for c in run], "_v.*", tx.null_if_blank("scan_error").alias("scan_error")))


def spine(spans: DataFrame, activity: DataFrame, tokens: DataFrame) -> DataFrame:
    """FRM-10, JON-03: full outer join of what is known of lane spans."""
    keys = ["transcript_id", "span_id"]
    return spans.join(activity, keys, "full").join(tokens, keys, "full")


def subagents(known: DataFrame, judged: DataFrame) -> DataFrame:
    """FRM-10, JON-02, SRT-01: the spine with judge rows, either side alone too, ordered with NULLs last."""
    keys = ["transcript_id", "span_id"]
    both = known.join(judged, keys, "full")
    order = [F.asc_nulls_last(c) for c in ("anchor_turn", "started_at", "span_id") if c in both.columns]
    status = F.when(F.col("label").isNotNull(), "ok").otherwise(F.coalesce("status", F.lit("not_judged"))) if "status" in both.columns else F.when(F.col("label").isNotNull(), "ok").otherwise("not_judged")
    return both.withColumn("status", status).withColumn("position", F.row_number().over(Window.partitionBy("transcript_id").orderBy(*order)) - 1)


def definitions(rows: DataFrame) -> DataFrame:
    """FRM-12: the first definition of each label on each surface, by ord."""
    return rows.groupBy("surface", "label").agg(F.min_by(F.struct("description", "reserved"), "ord").alias("_d")).select("surface", "label", "_d.description", "_d.reserved")


def member_ballots(frame: DataFrame, unit: str, label: str | None = None) -> DataFrame:
    """FRM-15, FRM-11: ballots from a column `members` of a judged frame; the label may be renamed."""
    out = frame.select("transcript_id", unit, F.posexplode("members").alias("ord", "_m")).select("transcript_id", unit, "ord", "_m.*")
    return out.withColumnRenamed("label", label) if label else out


def turns_frame(results: DataFrame, schema: str) -> DataFrame:
    """FRM-13: results as one row a turn: of a list of turns, of a batch's items, or the item itself.

    schema has turns, items (both arrays of one struct) and item (that struct).
    """
    d = decoded(clean(results), schema)
    each = F.coalesce(F.col("value.turns"), F.col("value.items"), F.array("value.item"))
    return d.select(*identity(d), F.explode(each).alias("_e")).select("*", "_e.*").drop("_e")


def generic(results: DataFrame) -> DataFrame:
    """FRM-14: identity, and the value's top-level keys as a map of JSON texts."""
    ok = clean(results)
    return ok.select(*identity(ok), F.from_json("value", "map<string,string>").alias("value"))


def phases_table(results: DataFrame, schema: str, per_turn: DataFrame | None = None, views: DataFrame | None = None, spans: DataFrame | None = None) -> DataFrame:
    """FRM-06: one row a stitched phase: identity, position, its fields, the flattened review, the setup, the audit's counts, and what it spent.

    schema: phases (an array of structs with phase, turn_start, turn_end, ..., verifier), verifier, judge, cohort, narrator. The audit's counts are NULL
    where no verifier ran. Spend needs the dense map (per_turn) and the token views, delegation the sub-agent lanes; without them these columns are
    NULL, with an empty table of lanes the number of spawns is 0.
    """
    d = decoded(clean(results), schema)
    audit, ran = F.col("value.verifier"), F.coalesce(F.col("value.verifier.ran"), F.lit(False))
    counts = [F.when(ran, audit[f.name]).alias(f"verifier_{f.name}") for f in d.schema["value"].dataType["verifier"].dataType.fields if f.name.startswith("n_")]
    each = d.select(*identity(d), audit["verifier_model"].alias("verifier_model"), F.col("value.narrator.narrator_model").alias("narrator_model"), F.col("value.cohort.agreement.n_members").alias("n_members"), F.col("value.judge").alias("_judge"), *counts, F.posexplode("value.phases").alias("phase_index", "_p"))
    own = [f.name for f in each.schema["_p"].dataType.fields if f.name != "verifier"]
    flat = each.withColumn("_review", F.col("_p.verifier")).select(*[c for c in each.columns if c not in ("_p", "_judge")], *[F.col(f"_p.{c}").alias(c) for c in own], *review_columns("_review"), *judge_columns("_judge"))
    flat = flat.withColumn("phase_index", F.col("phase_index").cast("bigint"))
    keys = ["transcript_id", "phase_index"]
    none = F.lit(None).cast("bigint")
    if per_turn is not None and views is not None:
        turn = views.filter("turn is not null").groupBy("transcript_id", "turn").agg(F.sum("new_work").alias("_spend"))
        spent = per_turn.filter("phase_index is not null").join(turn, ["transcript_id", "turn"], "left").groupBy(*keys).agg(F.sum("_spend").alias("new_work_tokens"))
        flat = flat.join(spent, keys, "left")
    else:
        flat = flat.withColumn("new_work_tokens", none)
    if spans is None:
        return stamped(flat.withColumn("delegated_new_work_tokens", none).withColumn("n_subagents", none))
    lanes = spans.filter("lane_kind = 'subagent'").select(F.col("transcript_id").alias("_t"), "spawn_turn", F.col("new_work").alias("_spend"))
    inside = (F.col("transcript_id") == F.col("_t")) & F.col("spawn_turn").between(F.col("turn_start"), F.col("turn_end"))
    sent = flat.select(*keys, "turn_start", "turn_end").join(lanes, inside).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_subagents"), F.sum("_spend").alias("delegated_new_work_tokens"))
    return stamped(flat.join(sent, keys, "left").fillna(0, ["n_subagents"]))


def looked_up(frame: DataFrame, words: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """JON-14: the frame with what a lookup table says of a column's value, NULL where it says nothing. words: one row a value, under the key's name."""
    return frame.join(words.select(key, *columns), key, "left")


def by_position(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """JON-15: rows of two tables with one place in their group's order; the longer side's rest has NULLs."""
    w = Window.partitionBy(*keys).orderBy(order)
    place = lambda df: df.withColumn("position", F.row_number().over(w) - 1).drop(order)
    return place(left).join(place(right), [*keys, "position"], "full")


def last_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """SET-04: the last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
