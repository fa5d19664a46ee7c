"""Execution status and selection (STA-01..03, SEL-01, SRT-05, AGG-12, SET-06)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.shared import written

USAGE = "map<string,struct<input_tokens:bigint,output_tokens:bigint,total_tokens:bigint,input_tokens_cache_read:bigint,input_tokens_cache_write:bigint,reasoning_tokens:bigint,total_cost:double>>"


def usage(results: DataFrame) -> DataFrame:
    """AGG-12: usage by scanner and model; mandatory counts default to 0, optional ones stay NULL until one is reported."""
    each = results.select("scanner", F.explode(F.from_json("scan_model_usage", USAGE)).alias("model", "u"))
    zero = lambda c: F.sum(F.coalesce(F.col(f"u.{c}"), F.lit(0))).alias(c)
    return each.groupBy("scanner", "model").agg(zero("input_tokens"), zero("output_tokens"), zero("total_tokens"), F.sum("u.input_tokens_cache_read").alias("cache_read"), F.sum("u.input_tokens_cache_write").alias("cache_write"), F.sum("u.reasoning_tokens").alias("reasoning_tokens"), F.sum("u.total_cost").alias("total_cost"))


def usage_rollup(results: DataFrame) -> DataFrame:
    """STA-03: usage with totals by scanner and over all."""
    u = usage(results)
    return u.rollup("scanner", "model").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("reasoning_tokens").alias("reasoning_tokens"))


def coverage(results: DataFrame) -> DataFrame:
    """STA-01: transcripts scanned and completed, and distinct errors, by scanner."""
    bad = F.coalesce("scan_error", F.lit("")) != ""
    return results.groupBy("scanner").agg(
        F.count_distinct("transcript_id").alias("scanned"),
        (F.count_distinct("transcript_id") - F.count_distinct(F.when(bad, F.col("transcript_id")))).alias("completed"),
        F.count_distinct(F.when(bad, F.struct("transcript_id", "scan_error"))).alias("n_errors"),
    )


def build(results: DataFrame, requested: DataFrame) -> DataFrame:
    """STA-01, STA-02: for each requested scanner (scanner, total) its coverage; one without a table is said to be missing."""
    c = requested.join(coverage(results), "scanner", "left")
    scanned = F.least(F.coalesce("scanned", F.lit(0)), "total")
    return c.select(
        "scanner",
        "total",
        scanned.alias("scanned"),
        F.coalesce(F.least("completed", scanned), F.lit(0)).alias("completed"),
        F.coalesce("n_errors", F.lit(0)).alias("n_errors"),
        F.col("scanned").isNull().alias("never_attempted"),
        (F.col("total") - scanned).alias("missing"),
        (F.col("scanned").isNull() | (F.col("total") > scanned) | (F.coalesce("n_errors", F.lit(0)) > 0)).alias("has_failures"),
    )


def errors(results: DataFrame, cap: int = 300) -> DataFrame:
    """STA-03: distinct errors, cut."""
    return results.filter("coalesce(scan_error, '') <> ''").select("scanner", "transcript_id", F.substring("scan_error", 1, cap).alias("message")).distinct()


def earliest_success(runs: DataFrame) -> DataFrame:
    """SRT-05: of each sample the earliest successful epoch, else the earliest; a missing epoch counts as 1."""
    e = F.coalesce("epoch", F.lit(1))
    return runs.groupBy("sample_id").agg(F.min_by(e, F.struct(F.when(F.coalesce("success", F.lit(False)), 0).otherwise(1), e)).alias("epoch"))


def select_runs(runs: DataFrame, sample: str | None = None, epochs: list[int] | None = None) -> DataFrame:
    """SEL-01: the runs of one sample, in the epochs asked for, else in the earliest successful one; errors name what there is.

    runs: transcript_id, sample_id, task_set, epoch, success. Reads the run index only, which has one row a transcript.
    """
    names = [r["sample_id"] for r in runs.select("sample_id").distinct().orderBy("sample_id").limit(101).collect()]
    if sample is None and len(names) != 1:
        raise ValueError(f"name one sample of {names[:100]}")
    if sample is not None and sample not in names and runs.filter(F.col("sample_id") == sample).limit(1).count() == 0:
        raise ValueError(f"no sample {sample!r}: there are {names[:100]}")
    own = runs.filter(F.col("sample_id") == (sample or names[0])).withColumn("epoch", F.coalesce("epoch", F.lit(1)))
    twice = own.groupBy("task_set", "epoch").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"several runs of epoch {twice[0]['epoch']} of {twice[0]['task_set']}")
    if epochs is None:
        return own.join(earliest_success(own), ["sample_id", "epoch"], "left_semi")
    have = {r["epoch"] for r in own.select("epoch").distinct().collect()}
    if missing := sorted(set(epochs) - have):
        raise ValueError(f"no epoch {missing}: there are {sorted(have)}")
    return own.filter(F.col("epoch").isin(epochs))


def ordered(runs: DataFrame, ranges: int = 64) -> DataFrame:
    """SRT-03: transcripts by agent, sample and epoch. Ranges of that order are numbered each by itself and moved on by the rows of those before."""
    order = ["agent", "sample_id", "epoch", "transcript_id"]
    dealt = runs.select(*order).distinct().repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
    dealt = written(dealt, "ordered")  # so that a row's range doesn't change
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", before.alias("_before"))  # one row a range
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.join(F.broadcast(moved), "_range").withColumn("position", own + F.col("_before")).drop("_range", "_before")
