"""Agreement and reliability statistics (REL-01..18), in closed form over pre-aggregated counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.operators.frames import last_of
from turnloom.shared import written
from turnloom.schema import CI_MIN_N, LABEL_SOURCES, RELABEL_WARN, RELIABLE, SUSPICIOUS_K_ROLL, TENTATIVE, UNJUDGED_WARN, Z


def require(frame: DataFrame, columns: list[str], hint: str) -> None:
    """REL-18: missing columns are an error that names them and what to do."""
    missing = [c for c in columns if c not in frame.columns]
    if missing:
        raise ValueError(f"missing column(s) {', '.join(missing)}: {hint}")


def regime(frame: DataFrame) -> DataFrame:
    """REL-01: the judges' setup on the first judged row, with the verifier of any judged row; kind `none` if nothing is judged."""
    require(frame, ["judge_regime", "judge_models", "verifier_model", "ord"], "build the frame with judge setup columns")
    judged = frame.filter("judge_regime is not null")
    return judged.agg(F.min_by("judge_regime", "ord").alias("kind"), F.min_by("judge_models", "ord").alias("models"), F.max("verifier_model").alias("verifier_model")).select(
        F.coalesce("kind", F.lit("none")).alias("kind"), "models", "verifier_model", F.col("verifier_model").isNotNull().alias("verifier_on"), F.array_contains("models", F.col("verifier_model")).alias("verifier_same_model")
    )


def _counts(votes: DataFrame, unit: list[str], scope: list[str]) -> DataFrame:
    """Counts n of (unit, label); NULL units and labels don't count."""
    rated = votes.filter(F.col("label").isNotNull())
    for c in unit:
        rated = rated.filter(F.col(c).isNotNull())
    return rated.groupBy(*scope, *unit, "label").agg(F.count(F.lit(1)).alias("n"))


def _pairs(n: DataFrame, unit: list[str], scope: list[str]) -> DataFrame:
    """Per unit of two ratings at least their number m, and the sum of squares by label."""
    return n.groupBy(*scope, *unit).agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("q")).filter("m >= 2")


def agreement(votes: DataFrame, unit: list[str], scope: list[str] | None = None) -> DataFrame:
    """REL-02..05: n units, percent agreement, nominal alpha and AC1 of units with two ratings at least, one row a scope.

    alpha = 1 - (n-1) sum_u((m^2 - sum n_uc^2) / (m-1)) / (n^2 - sum N_c^2), NULL if its denominator is 0. AC1 takes chance from
    prevalence and is NULL below two labels. No matrix: two aggregations by unit, one by label.
    """
    scope = scope or []
    n = written(_counts(votes, unit, scope), "label-counts")  # both aggregations read it
    m = _pairs(n, unit, scope)
    by_label = n.join(m.select(*scope, *unit), [*scope, *unit], "left_semi").groupBy(*scope, "label").agg(F.sum("n").alias("c"))
    labels = by_label.groupBy(*scope).agg(F.count(F.lit(1)).alias("labels"), F.sum("c").alias("ratings"), F.sum(F.col("c") * F.col("c")).alias("cc"))
    pairs = m.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("n_units"), F.sum(F.col("q") - F.col("m")).alias("same"), F.sum(F.col("m") * (F.col("m") - 1)).alias("all"), F.sum((F.col("m") * F.col("m") - F.col("q")).cast("double") / (F.col("m") - 1)).alias("apart")
    )
    both = pairs.join(labels, scope) if scope else pairs.join(F.broadcast(labels))  # one row each
    r, cc, q = F.col("ratings"), F.col("cc"), F.col("labels")
    pa = F.col("same") / F.col("all")
    pe = (1 - cc / (r * r)) / (q - 1)
    return both.select(
        *scope,
        "n_units",
        pa.alias("percent"),
        F.when(r * r != cc, 1 - (r - 1) * F.col("apart") / (r * r - cc)).alias("alpha"),
        F.when(q >= 2, (pa - pe) / (1 - pe)).alias("ac1"),
    )


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """REL-11: bounds of the Wilson interval, within [0, 1]; NULL at n = 0."""
    p, some = k / n, n > 0
    middle, spread, below = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return F.when(some, F.greatest((middle - spread) / below, F.lit(0.0))), F.when(some, F.least((middle + spread) / below, F.lit(1.0)))


def rate(k: Column, n: Column, name: str) -> list[Column]:
    """A count of a number, their ratio (NULL at 0) and its interval."""
    low, high = wilson(k, n)
    return [k.alias(f"{name}_count"), n.alias(f"{name}_of"), F.when(n > 0, k / n).alias(f"{name}_rate"), low.alias(f"{name}_low"), high.alias(f"{name}_high")]


def mean_stat(values: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """REL-12: mean, half-width (from CI_MIN_N values on), minimum and number of the values that are numbers."""
    x = F.col(value).try_cast("double")
    return values.groupBy(*(by or [])).agg(
        F.avg(x).alias("mean"), F.when(F.count(x) >= CI_MIN_N, Z * F.stddev_samp(x) / F.sqrt(F.count(x))).alias("ci_half_width"), F.min(x).alias("minimum"), F.count(x).alias("n")
    )


def tiers(values: DataFrame, value: str, high: float = RELIABLE, low: float = TENTATIVE, by: list[str] | None = None) -> DataFrame:
    """REL-14: how many values are high, medium and low."""
    x = F.col(value)
    return values.groupBy(*(by or [])).agg(F.count_if(x >= high).alias("high"), F.count_if((x < high) & (x >= low)).alias("medium"), F.count_if(x < low).alias("low"), F.count(x).alias("n"))


def review_units(phases: DataFrame) -> DataFrame:
    """REL-06: the original reviews in phases' lists, one a transcript and original phase (the last written wins)."""
    each = phases.select("transcript_id", "phase_index", F.posexplode("verifier_reviews").alias("pos", "r")).select("transcript_id", "phase_index", "pos", "r.*")
    return completed(last_of(each, ["transcript_id", "original_phase_index"], ["phase_index", "pos"]).drop("pos", "phase_index"))


def completed(reviews: DataFrame) -> DataFrame:
    """A review is complete with a label that isn't blank and no status but ok."""
    ok = F.coalesce(F.col("status") == "ok", F.lit(True)) if "status" in reviews.columns else F.lit(True)
    return reviews.withColumn("completed", ok & F.coalesce(F.trim("verifier_label") != "", F.lit(False)))


def relabel_rate(reviews: DataFrame) -> DataFrame:
    """REL-08: overturned of completed reviews, over all (label NULL, overall true) and by original label."""
    done = reviews.filter("completed")
    k, n = F.sum(F.col("overturned").cast("bigint")), F.count(F.lit(1))
    both = done.select("overturned", F.explode(F.array(F.struct(F.lit(True).alias("overall"), F.lit(None).cast("string").alias("label")), F.struct(F.lit(False).alias("overall"), F.col("original_label").alias("label")))).alias("g"))
    by = both.filter("g.overall or g.label is not null").groupBy("g").agg(k.alias("_k"), n.alias("_n"))
    return by.select("g.*", *rate(F.col("_k"), F.col("_n"), "relabel"))


def spot_check(reviews: DataFrame) -> DataFrame:
    """REL-09: overturned of completed random-sample reviews."""
    r = reviews.filter("completed and trigger = 'random_sample'").agg(F.coalesce(F.sum(F.col("overturned").cast("bigint")), F.lit(0)).alias("_k"), F.count(F.lit(1)).alias("_n"))
    return r.select(*rate(F.col("_k"), F.col("_n"), "overturned"))


def member_coverage(votes: DataFrame, status: str, ok: str, reasons: list[str]) -> DataFrame:
    """REL-10: of what each member was asked, how much it produced, and why the rest is missing."""
    misses = [F.count_if(F.col(status) == r).alias(f"missed_{r}") for r in reasons]
    by = votes.groupBy("model", "roll").agg(F.count_if(F.col(status) == ok).alias("_k"), F.count(F.lit(1)).alias("_n"), *misses)
    return by.select("model", "roll", *rate(F.col("_k"), F.col("_n"), "produced"), *[f"missed_{r}" for r in reasons])


def provenance(decided: DataFrame, labels: list[str] | DataFrame) -> DataFrame:
    """REL-13: decided units by label source and label; every source and every label has a row."""
    spark = decided.sparkSession
    names = labels if isinstance(labels, DataFrame) else spark.createDataFrame([(x,) for x in labels], "label string")
    spine = names.select("label", F.explode(F.array(*map(F.lit, LABEL_SOURCES))).alias("label_source"))
    n = decided.groupBy("label", "label_source").agg(F.count(F.lit(1)).alias("n"))
    return spine.join(n, ["label", "label_source"], "left").fillna(0, ["n"])


def label_stats(decided: DataFrame, votes: DataFrame, reviews: DataFrame, unit: list[str], declared: DataFrame) -> DataFrame:
    """REL-07, JON-01, SET-05: per label (declared in order, then others by name) units, means, relabelled, spot checks, dissent.

    decided: unit, label, label_source, agreement, confidence. Units that the verifier decided don't count for dissent.
    declared: label, ord.
    """
    seen = decided.filter("label is not null").select("label").distinct().join(declared, "label", "left_anti").withColumn("ord", F.lit(1 << 30))
    spine = declared.select("label", "ord").unionByName(seen)
    own = decided.filter("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("agreement").alias("agreement"), F.avg("confidence").alias("confidence"))
    done = reviews.filter("completed").groupBy(F.col("original_label").alias("label")).agg(
        F.count(F.lit(1)).alias("reviewed"), F.sum(F.col("overturned").cast("bigint")).alias("relabelled"), F.count_if(F.col("trigger") == "random_sample").alias("spot_checked")
    )
    voted = decided.filter("label is not null and label_source <> 'verifier'").select(*unit, F.col("label").alias("_decided"))
    dissent = votes.filter("label is not null").join(voted, unit).groupBy("label").agg(F.count(F.lit(1)).alias("votes"), F.count_if(F.col("label") != F.col("_decided")).alias("minority"))
    counts = ["n", "reviewed", "relabelled", "spot_checked", "votes", "minority"]
    return spine.join(own, "label", "left").join(done, "label", "left").join(dissent, "label", "left").fillna(0, counts).withColumn("position", F.row_number().over(Window.orderBy("ord", "label")) - 1).drop("ord")


def flags(stats: DataFrame) -> DataFrame:
    """REL-15: metrics that pass a limit. stats: metric, value; metric one of k_roll, alpha, relabel, relabel_label, spot_check, unjudged."""
    m, v = F.col("metric"), F.col("value")
    level = (
        F.when((m == "k_roll") & ((v < RELIABLE) | (v > SUSPICIOUS_K_ROLL)), "amber")
        .when((m == "alpha") & (v < TENTATIVE), "red")
        .when((m == "alpha") & (v < RELIABLE), "amber")
        .when(m.isin("relabel", "relabel_label") & (v >= RELABEL_WARN), "amber")
        .when((m == "spot_check") & (v > 0), "red")
        .when((m == "unjudged") & (v >= UNJUDGED_WARN), "red")
        .when((m == "unjudged") & (v > 0), "amber")
    )
    return stats.withColumn("level", level).filter("level is not null")


def collection(units: DataFrame, ballots: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """REL-17, JON-10, SET-06: pooled reliability of transcripts of one setup and one vocabulary.

    units: transcript_id, unit, setup, n_members, label; ballots: transcript_id, unit, model, roll, label; vocabulary:
    transcript_id, label. A duplicate ballot is an error on its group's row.
    """
    own_scope = ["setup", "vocabulary"]
    words = vocabulary.groupBy("transcript_id").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("vocabulary"))
    group = units.select("transcript_id", "setup", "n_members").distinct().join(words, "transcript_id")
    seen = units.filter("label is not null").join(group.select("transcript_id", "vocabulary"), "transcript_id").groupBy("setup", "vocabulary").agg(
        F.count_distinct("transcript_id").alias("scope"), F.count(F.lit(1)).alias("seen"), F.sum("n_members").alias("expected")
    )
    own = ballots.filter("label is not null").join(units.filter("label is not null").select("transcript_id", "unit").distinct(), ["transcript_id", "unit"], "left_semi").join(group.select("transcript_id", *own_scope), "transcript_id")
    own = written(own.select(*own_scope, "transcript_id", "unit", "model", "roll", "label"), "own-ballots")
    once = own.groupBy("setup", "vocabulary", "transcript_id", "unit", "model", "roll").agg(F.count(F.lit(1)).alias("k"))
    n = once.groupBy("setup", "vocabulary").agg(F.sum("k").alias("ballots"), F.max("k").alias("_k"))
    stat = agreement(own, ["transcript_id", "unit"], ["setup", "vocabulary"])
    return seen.join(n, ["setup", "vocabulary"], "left").join(stat, ["setup", "vocabulary"], "left").withColumn("error", F.when(F.col("_k") > 1, "duplicate ballots")).drop("_k")


def setups(rows: DataFrame, columns: list[str]) -> DataFrame:
    """SET-03: the different setups, and the transcripts of each."""
    return rows.groupBy(*columns).agg(F.count_distinct("transcript_id").alias("transcripts"))


def entity_audit(units: DataFrame, votes: DataFrame, reviews: DataFrame, unit: list[str], declared: DataFrame, status: tuple[str, str, list[str]]) -> dict[str, DataFrame]:
    """REL-16: all statistics of one judged surface (phases, sub-agents or a layer) by name, and its flags.

    units: unit, label (NULL: no judgement), label_source, agreement, confidence, attempted; votes: unit, model, roll, label and the status column; reviews:
    completed, overturned, trigger, original_label; declared: label, ord; status: its column, the good value and the reasons of misses.
    """
    decided = units.filter("label is not null")
    out = {
        "agreement": agreement(votes, unit),
        "confidence": mean_stat(units, "confidence"),
        "k_roll": mean_stat(units, "agreement"),
        "tiers": tiers(units, "confidence"),
        "relabel": relabel_rate(reviews),
        "spot_check": spot_check(reviews),
        "labels": label_stats(decided, votes, reviews, unit, declared),
        "coverage": member_coverage(votes, *status),
        "provenance": provenance(decided, declared.select("label")),
    }
    tried = units.filter("attempted")
    unjudged = tried.agg((F.count_if(F.col("label").isNull()) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("value"))
    stats = [
        out["agreement"].select(F.lit("alpha").alias("metric"), F.col("alpha").alias("value")),
        out["relabel"].select(F.when(F.col("overall"), "relabel").otherwise("relabel_label").alias("metric"), F.col("relabel_rate").alias("value")),
        out["spot_check"].select(F.lit("spot_check").alias("metric"), F.col("overturned_rate").alias("value")),
        unjudged.select(F.lit("unjudged").alias("metric"), "value"),
    ]
    every = stats[0]
    for s in stats[1:]:
        every = every.unionByName(s)
    return out | {"flags": flags(every)}


def unauditable(name: str, frame: DataFrame, columns: list[str]) -> str | None:
    """REL-16: why a layer can't be audited, to be said in its block; None if it can."""
    missing = [c for c in columns if c not in frame.columns]
    return f"{name} can't be audited: it lacks {', '.join(missing)}" if missing else None
