"""Quality rules with host-level verdicts, in DataFrame and SQL functions only.

Each document gets base counts and base rules. Rule failures are aggregated by host (a column of the
caller's choice); a host's failure rate is shrunk towards the corpus by a beta prior that is itself fitted
to the hosts (method of moments), so a host of two documents isn't condemned by both. A host is rejected if the lower
end of its posterior (mean less SIGMAS standard deviations) lies beyond the middle between the prior's mean and 1:
whatever the corpus looks like, far more of the host's documents fail than of others, and there is evidence for it. The
verdict is joined back to the host's documents.

All counts of a text are one expression: its words are split once and bound to a lambda variable, so whatever the
optimiser inlines costs a constant factor, not one in proportion to the text. 5-word windows are hashed to 64 bits and compared
within the row; no row is exploded, so a document costs memory in proportion to its own length only. Hosts are
aggregated map-side.

Nulls: a null text has no words and fails the base rule; documents of a null host form one group.
Repeated rows are judged one by one. An empty table gives no rows. Further columns stay; in `base_counts` a column named like
a count gives way to it, `keep_good` returns all columns as they were; it writes them in between, so they must be of types that Parquet holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import BLANKS, broadcast_if_small, columns, written

#: Words of a window, the rule limits, and how far a host's posterior must lie beyond the limit.
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SIGMAS = 3.0
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_TRIM = "\\u0020\\u0009\\u000A\\u000B\\u000C\\u000D"
_SPLIT = f"[{BLANKS}]+".replace("\\", "\\\\")


def _let(value: str, name: str, body: str) -> str:
    """SQL: body with name bound to value, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


#: Words of windows found twice or more, of words w. Sorting (hash, start) puts equal windows side by side;
#: the covered words are then the union of the starts' ranges. Texts without equal windows are done after a look at the hashes.
_REPEATED = f"""CASE WHEN size(w) <= {WINDOW} THEN 0L ELSE """ + _let(
    f"slice(transform(w, (x, i) -> xxhash64(x, {', '.join(f'get(w, i + {k})' for k in range(1, WINDOW))})), 1, size(w) - {WINDOW - 1})",
    "h",
    "CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE "
    + _let(
        "sort_array(transform(h, (x, i) -> struct(x AS h, i AS i)))",
        "s",
        f"""aggregate(
          sort_array(transform(
            filter(s, (x, k) -> coalesce(get(s, k - 1).h = x.h, false) OR coalesce(get(s, k + 1).h = x.h, false)),
            x -> x.i)),
          struct(0L AS n, -1 AS upto),
          (a, i) -> struct(a.n + i + {WINDOW} - greatest(a.upto, i) AS n, i + {WINDOW} AS upto),
          a -> a.n)""",
    )
    + " END",
) + " END"


def _words() -> str:
    trimmed = f"trim(BOTH '{_TRIM}' FROM t)"
    return f"CASE WHEN {trimmed} = '' THEN CAST(array() AS array<string>) ELSE split({trimmed}, '{_SPLIT}', -1) END"


def _fails(words: str, repeated: str) -> str:
    return f"{words} < {MIN_WORDS} OR 100 * {repeated} > {MAX_REPEAT_PERCENT} * {words}"


def _of_text(text: str, told: str) -> Column:
    quoted = text.replace("`", "``")
    return F.expr(_let(f"coalesce(`{quoted}`, '')", "t", told))


def counts_of(text: str = "text") -> Column:
    """A struct of COUNTS (long) and base_failed of a text column."""
    lines = f"filter(split(t, '\\n', -1), x -> trim(BOTH '{_TRIM}' FROM x) <> '')"
    told = _let(
        _words(),
        "w",
        f"""named_struct('n_words', CAST(size(w) AS BIGINT), 'word_chars', CAST(length(array_join(w, '')) AS BIGINT),
          'n_symbols', CAST(length(regexp_replace(t, '[^{SYMBOLS}]+', '')) AS BIGINT),
          'n_dup_lines', {_let(lines, 'l', 'CAST(size(l) - size(array_distinct(l)) AS BIGINT)')}, 'n_repeat_words', CAST({_REPEATED} AS BIGINT))""",
    )
    judged = f"named_struct({', '.join(f"'{c}', c.{c}" for c in COUNTS)}, 'base_failed', {_fails('c.n_words', 'c.n_repeat_words')})"
    return _of_text(text, _let(told, "c", judged))


def failed_of(text: str = "text") -> Column:
    """base_failed of a text column, without the counts that it doesn't need."""
    return _of_text(text, _let(_words(), "w", f"CASE WHEN size(w) < {MIN_WORDS} THEN true ELSE {_let(_REPEATED, 'n', _fails('size(w)', 'n'))} END"))


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed."""
    own = [c for c in docs.columns if c not in (*COUNTS, "base_failed")]
    return docs.select(*columns(own), counts_of(text).alias("_counts")).select(*columns(own), "_counts.*")


def host_key(host: str) -> Column:
    return F.coalesce(F.concat(F.lit("h"), *columns([host])), F.lit("n"))


def host_verdicts(judged: DataFrame, sigmas: float = SIGMAS) -> DataFrame:
    """One row a host of rows with host_key and base_failed: host_key, host_docs, host_failed, host_rate (shrunk), host_low, host_rejected."""
    hosts = judged.groupBy("host_key").agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed"))
    # moments of the hosts' raw rates: mean m, variance v; what sampling alone would give is taken off v
    raw = F.col("host_failed") / F.col("host_docs")
    prior = (
        hosts.agg(
            (F.sum("host_failed") / F.sum("host_docs")).alias("m"),
            F.coalesce(F.var_samp(raw), F.lit(0.0)).alias("v"),
            F.avg(F.lit(1.0) / F.col("host_docs")).alias("inv"),
        )
        .withColumn("m", F.least(F.greatest("m", F.lit(1e-4)), F.lit(1 - 1e-4)))
        .withColumn("noise", F.col("m") * (1 - F.col("m")) * F.col("inv"))
        .withColumn("between", F.greatest(F.col("v") - F.col("noise"), F.lit(1e-6)))
        .withColumn("strength", F.least(F.greatest(F.col("m") * (1 - F.col("m")) / F.col("between") - 1, F.lit(1.0)), F.lit(1e4)))
        .select("m", "strength")
    )
    # prior has one row: an aggregate without keys
    weight = F.col("host_docs") + F.col("strength")
    shrunk = hosts.join(F.broadcast(prior)).withColumn("host_rate", (F.col("host_failed") + F.col("m") * F.col("strength")) / weight)
    low = F.col("host_rate") - sigmas * F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / (weight + 1))
    return shrunk.withColumn("host_low", low).select(
        "host_key", "host_docs", "host_failed", "host_rate", "host_low", (F.col("host_low") > (1 + F.col("m")) / 2).alias("host_rejected")
    )


def judge(docs: DataFrame, host: str = "source", text: str = "text", id_columns: tuple[str, ...] = ("doc_id",), sigmas: float = SIGMAS) -> DataFrame:
    """id columns, host, host_key, the base counts, base_failed, host_docs to host_rejected, and kept."""
    own = [*dict.fromkeys([*id_columns, host])]
    counted = written(docs.select(*columns(own), host_key(host).alias("host_key"), counts_of(text).alias("_counts")).select(*columns(own), "host_key", "_counts.*"), "quality-counts")
    verdicts = broadcast_if_small(host_verdicts(counted, sigmas), "host-verdicts", "host_key")
    return counted.join(verdicts, "host_key").withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def keep_good(docs: DataFrame, host: str = "source", text: str = "text", sigmas: float = SIGMAS) -> DataFrame:
    """The rows of docs that base rules and host verdicts keep, with docs' own columns."""
    # rows are written with their flag, so that each text is split once: a table of flags alone would need a key that repeated rows don't have
    told = written(docs.select(F.struct(*columns(docs.columns)).alias("_own"), host_key(host).alias("host_key"), failed_of(text).alias("base_failed")), "quality-flags")
    gone = broadcast_if_small(host_verdicts(told.select("host_key", "base_failed"), sigmas).filter("host_rejected").select("host_key"), "rejected-hosts", "host_key")
    return told.filter("not base_failed").join(gone, "host_key", "left_anti").select("_own.*")
