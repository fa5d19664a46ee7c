"""Scalar functions as column expressions (SCA-*, PRJ-*, FLT-03, EXT-08, EXT-14, EXT-18)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks as a regular expression that knows Unicode ones.
BLANK = r"(?U)\s"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    return F.regexp_replace(col(x), rf"^{BLANK}+|{BLANK}+$", "")


def label_key(x: Column | str) -> Column:
    """SCA-01: trimmed, lower-cased, runs of blanks as one underscore."""
    return F.regexp_replace(F.lower(strip(x)), rf"{BLANK}+", "_")


def is_label_key(x: Column | str) -> Column:
    return col(x) == label_key(x)


def clip(x: Column | str, cap: int) -> Column:
    """SCA-02: head and tail of cap // 2 and cap - cap // 2 characters, trimmed at the cut, around a mark that counts the rest; unchanged where that isn't shorter."""
    c, n = col(x), F.length(col(x))
    if cap <= 0:
        return F.when(c.isNotNull(), F.lit(""))
    head = F.regexp_replace(F.substring(c, 1, cap // 2), rf"{BLANK}+$", "")
    tail = F.regexp_replace(F.right(c, F.lit(cap - cap // 2)), rf"^{BLANK}+", "")
    mark = F.concat(F.lit("[... "), (n - F.length(head) - F.length(tail)).cast("string"), F.lit(" chars ...]"))
    cut = F.concat_ws(" ", F.nullif(head, F.lit("")), mark, F.nullif(tail, F.lit("")))
    return F.when((n <= cap) | (F.length(cut) >= n), c).otherwise(cut)


def flat(x: Column | str) -> Column:
    """SCA-03: runs of blanks as one space, none at the ends."""
    return F.regexp_replace(strip(x), rf"{BLANK}+", " ")


def half_width(x: Column | str) -> Column:
    """SCA-04: an aggregate: 1.96 sd / sqrt(n), 0 below two values."""
    return F.when(F.count(col(x)) < 2, F.lit(0.0)).otherwise(1.96 * F.stddev_samp(col(x)) / F.sqrt(F.count(col(x))))


def rounded_mean(x: Column | str) -> Column:
    """SCA-05: an aggregate: the mean to three places, NULL of nothing."""
    return F.round(F.avg(col(x)), 3)


def humanise(x: Column | str) -> Column:
    """SCA-06: underscores as spaces, the first letter a capital, the others small."""
    spaced = F.lower(F.replace(col(x), F.lit("_"), F.lit(" ")))
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 1 << 30))


def short_model(x: Column | str) -> Column:
    """SCA-07: a model's name without its provider."""
    return F.substring_index(col(x), "/", -1)


def member_display(model: Column | str, roll: Column | str, multi: Column) -> Column:
    return F.when(multi, F.concat(short_model(model), F.lit(" roll-"), col(roll).cast("string"))).otherwise(short_model(model))


def regime_text(kind: Column | str, models: Column | str, k_rolls: Column | str) -> Column:
    """SCA-08: a judge setup in words. models: an array."""
    k, m = col(kind), col(models)
    name = F.when(F.size(m) > 0, F.concat(F.lit(" ("), F.get(m, F.lit(0)), F.lit(")"))).otherwise("")
    return (
        F.when(k == "none", "no judge ran")
        .when(k == "cohort", F.concat(F.lit("cohort of "), F.size(m).cast("string"), F.lit(" models ("), F.array_join(m, ", "), F.lit(")")))
        .when(k == "k_roll", F.concat(F.lit("solo + k-rolls (k="), col(k_rolls).cast("string"), F.lit(")"), name))
        .otherwise(F.concat(F.lit("solo"), name))
    )


def two_places(x: Column | str) -> Column:
    """A number to two places; halves that a double holds exactly (eighths) go to the even neighbour."""
    return F.format_string("%.2f", F.when((col(x) * 8) % 1 == 0, F.bround(col(x).cast("double"), 2)).otherwise(col(x).cast("double")))


def mean_text(mean: Column | str, half: Column | str, least: Column | str, n: Column | str) -> Column:
    """SCA-08, SCA-19: a mean with its half-width, if known, its minimum and number of values."""
    spread = F.when(col(half).isNotNull(), F.concat(F.lit(" ± "), two_places(half))).otherwise("")
    said = F.concat(two_places(mean), spread, F.lit(" (min "), two_places(least), F.lit("), N = "), col(n).cast("string"))
    return F.when(col(mean).isNull() | (col(n) == 0), "no data").otherwise(said)


def threshold(raw: Column | str) -> Column:
    """SCA-09: a JSON compaction threshold: text, not finite, or not positive is NULL; whole numbers or over 1 are tokens, else a share."""
    text = F.trim(col(raw))
    number = F.when(text.rlike(r"^-?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?$"), text.try_cast("double"))
    whole = text.rlike(r"^-?[0-9]+$")
    return F.when(number > 0, F.struct(F.when(whole | (number > 1), number.cast("bigint")).alias("tokens"), F.when(~whole & (number <= 1), number).alias("share")))


def score_rows(score: Column | str) -> Column:
    """SCA-10: (name, value) entries of an object by name, or one entry named `score`."""
    m = F.from_json(col(score), "map<string,string>")
    entries = F.array_sort(F.map_entries(m))
    return F.when(F.trim(col(score)).startswith("{"), entries).when(col(score).isNotNull(), F.array(F.struct(F.lit("score").alias("key"), col(score).alias("value"))))


def duration_text(seconds: Column | str) -> Column:
    """SCA-11: whole seconds as hours and minutes, minutes and seconds, or seconds."""
    s = col(seconds).cast("bigint")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    minutes, left = F.floor(s / 60), s % 60
    hours = F.concat(F.floor(s / 3600).cast("string"), F.lit("h "), two(minutes % 60), F.lit("m"))
    return F.when(s.isNull(), "no data").when(s >= 3600, hours).when(s >= 60, F.concat(minutes.cast("string"), F.lit("m "), two(left), F.lit("s"))).otherwise(F.concat(s.cast("string"), F.lit("s")))


def tick_step(n: Column | str, most: int = 25) -> Column:
    """SCA-13: the least of 1, 2, 5, 10, ... that gives at most `most` ticks."""
    steps = [m * 10**e for e in range(9) for m in (1, 2, 5)]
    out = F.lit(steps[-1])
    for s in reversed(steps[:-1]):
        out = F.when(F.ceil(col(n) / s) <= most, F.lit(s)).otherwise(out)
    return out


def chart_width(n: Column | str) -> Column:
    return F.least(F.greatest(col(n) * 1.6, F.lit(1000.0)), F.lit(3000.0))


def preview(x: Column | str, cap: int = 60) -> Column:
    """SCA-14: the first cap characters, with an ellipsis if there are more."""
    return F.when(F.length(col(x)) > cap, F.concat(F.substring(col(x), 1, cap), F.lit("…"))).otherwise(col(x))


def flush_detail(kind: Column | str, source: Column | str, before: Column | str, after: Column | str, inferred: Column | str) -> Column:
    """SCA-15: what happened, and from what size to what, only if both are known."""
    sizes = F.when(
        col(before).isNotNull() & col(after).isNotNull(), F.concat(F.format_number(col(before), 0), F.lit(" → "), F.format_number(col(after), 0), F.when(col(inferred), " (inferred)").otherwise(""))
    )
    return F.concat_ws(" · ", F.concat_ws("/", col(kind), col(source)), sizes)


def viewer_link(base: str, location: Column | str, transcript: Column | str, event: Column | str | None = None) -> Column:
    """SCA-16: base64url location without padding, percent-encoded ids."""
    where = F.regexp_replace(F.translate(F.base64(col(location).cast("binary")), "+/", "-_"), "=+$", "")
    quoted = lambda c: F.replace(F.url_encode(col(c)), F.lit("+"), F.lit("%20"))
    link = F.concat(F.lit(base + "#/transcripts/"), where, F.lit("/"), quoted(transcript))
    return link if event is None else F.when(col(event).isNotNull(), F.concat(link, F.lit("?event="), quoted(event))).otherwise(link)


def lane_group(role: Column | str, label: Column | str, ran: Column) -> Column:
    """SCA-17: the role, else the label, else unclassified (if classification ran), else a generic name."""
    return F.coalesce(col(role), col(label), F.when(ran, "unclassified"), F.lit("sub-agents"))


def scramble_map(labels: list[str], seed: int, reserved: tuple[str, ...] = ("ops", "none_of_the_above")) -> dict[str, str]:
    """SCA-20: labels to neutral tokens in a seeded order; reserved labels stay."""
    import random

    own = [x for x in labels if x not in reserved]
    tokens = [f"label_{i}" for i in range(len(own))]
    random.Random(seed).shuffle(tokens)
    return dict(zip(own, tokens, strict=True)) | {x: x for x in labels if x in reserved}


def translated(x: Column | str, mapping: dict[str, str]) -> Column:
    """SCA-20: labels by a mapping, unknown ones as they are; with the inverse mapping it undoes the scramble."""
    if not mapping:
        return col(x)
    pairs = [F.lit(v) for kv in mapping.items() for v in kv]
    return F.coalesce(F.create_map(*pairs)[col(x)], col(x))


def null_if_blank(x: Column | str) -> Column:
    """PRJ-08: empty text as NULL."""
    return F.nullif(col(x), F.lit(""))


def display_cell(json: Column | str) -> Column:
    """PRJ-09: compact JSON of a container, NULL for an empty one; scalars as they are."""
    t = F.regexp_replace(F.trim(col(json)), r"^(\{\s*\}|\[\s*\])$", "")
    return F.nullif(t, F.lit(""))


def file_stem(uri: Column | str) -> Column:
    """PRJ-10: the name of a path without its last suffix."""
    return F.regexp_replace(F.regexp_extract(col(uri), r"([^/]*)/?$", 1), r"(?<=.)[.][^.]*$", "")


def first_input(ids: Column | str) -> Column:
    """PRJ-03: the first of a JSON list of ids, as text."""
    return F.get(F.from_json(col(ids), "array<string>"), F.lit(0))


def is_failed(x: Column | str, prefix: str = "[assistant turn failed") -> Column:
    """FLT-03: text that opens with the mark of a failed turn."""
    return F.startswith(F.lower(F.ltrim(col(x))), F.lit(prefix))


def answer_lines(answers: Column | str) -> Column:
    """EXT-08: a map of answers as `name: value` lines."""
    return F.array_join(F.transform(F.map_entries(col(answers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def readable(content: Column | str) -> Column:
    """EXT-18: text of readable reasoning blocks (their summary if redacted), flattened and joined."""
    kept = F.filter(col(content), lambda b: (b["type"] == "reasoning") & F.coalesce(b["summary"], b["text"]).isNotNull())
    return F.nullif(F.array_join(F.transform(kept, lambda b: flat(F.when(b["redacted"], b["summary"]).otherwise(b["text"]))), " "), F.lit(""))


def elide(lines: Column | str, cap: int) -> Column:
    """WIN-19: the first cap // 2 and the last cap - cap // 2 of an array of lines around a counted mark."""
    x, n = col(lines), F.size(col(lines))
    head, tail = cap // 2, cap - cap // 2
    cut = F.concat(F.slice(x, 1, head), F.array(F.concat(F.lit("[... "), (n - cap).cast("string"), F.lit(" turns elided ...]"))), F.slice(x, n - tail + 1, tail))
    return F.when(n <= cap, x).otherwise(cut)


def call_part(call: Column) -> Column:
    """EXT-14: a call as `[CALL] name(arguments)` with its result or error. call: function, arguments, result, error."""
    bare = lambda x: F.coalesce(x, F.lit(""))
    arguments = F.when(bare(call["arguments"]) != "", F.concat(F.lit("("), call["arguments"], F.lit(")"))).otherwise("")
    output = F.when((bare(call["result"]) != "") | call["error"], F.rtrim(F.concat(F.when(call["error"], " [ERROR] ").otherwise(" [RESULT] "), bare(call["result"])))).otherwise("")
    return F.concat(F.lit("[CALL] "), call["function"], arguments, output)


def digest_line(turn: Column, text: Column, reasoning: Column, calls: Column, replies: Column, goals: Column) -> Column:
    """EXT-14: one line of a turn: what it thought and said, its calls (bare names if nothing else is known of them), replies and delegations.

    calls: an array of structs as for `call_part`; replies and goals: arrays of text.
    """
    told = F.exists(calls, lambda c: (F.coalesce(c["arguments"], F.lit("")) != "") | (F.coalesce(c["result"], F.lit("")) != "") | c["error"])
    names = F.concat(F.lit("(tools: "), F.array_join(F.transform(calls, lambda c: c["function"]), ", "), F.lit(")"))
    parts = F.when(told, F.array_join(F.transform(calls, call_part), " ")).when(F.size(calls) > 0, names)
    marked = lambda mark, xs: F.nullif(F.array_join(F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(f"[{mark}] "), x)), " "), F.lit(""))
    thought = F.when(F.coalesce(reasoning, F.lit("")) != "", F.concat(F.lit("[THINKING] "), reasoning))
    line = F.concat_ws(" ", F.concat(turn.cast("string"), F.lit(":")), thought, F.nullif(text, F.lit("")), parts, marked("TARGET", replies), marked("DELEGATES", goals))
    return F.replace(line, F.lit("\n"), F.lit(" "))


def iso(stamp: Column | str) -> Column:
    """EXT-09: a stamp as ISO-8601 text with milliseconds, NULL of none."""
    return F.date_format(col(stamp), "yyyy-MM-dd'T'HH:mm:ss.SSS")


#: The ends and the middle of the colour ramps, the colour of no fact, and the inks on them.
RAMP_LOW, RAMP_MID, RAMP_HIGH = (212, 11, 35), (247, 247, 247), (16, 77, 106)
NEUTRAL, LIGHT_INK, DARK_INK, DARK_INK_LUMINANCE = "#f4f4f4", "#fff", "#212529", 0.0172


def _between(low: tuple[int, int, int], high: tuple[int, int, int], part: Column) -> list[Column]:
    return [F.bround(F.lit(float(a)) + F.lit(float(b - a)) * part, 0).cast("int") for a, b in zip(low, high, strict=True)]


def _rgb(channels: list[Column]) -> Column:
    return F.concat(F.lit("rgb("), F.concat_ws(",", *[c.cast("string") for c in channels]), F.lit(")"))


def health_colour(x: Column | str) -> Column:
    """SCA-12: a 0-1 value between red, pale and steel; the neutral colour of NULL."""
    v = F.greatest(F.least(col(x).cast("double"), F.lit(1.0)), F.lit(0.0))
    return F.when(col(x).isNull(), NEUTRAL).when(v < 0.5, _rgb(_between(RAMP_LOW, RAMP_MID, v / 0.5))).otherwise(_rgb(_between(RAMP_MID, RAMP_HIGH, (v - 0.5) / 0.5)))


def share_colour(x: Column | str) -> Column:
    """SCA-12: a share between pale and steel; the neutral colour of none."""
    v = F.least(col(x).cast("double"), F.lit(1.0))
    return F.when(col(x).isNull() | (v <= 0), NEUTRAL).otherwise(_rgb(_between(RAMP_MID, RAMP_HIGH, v)))


def ink(background: Column | str) -> Column:
    """SCA-12: of the light and the dark ink the one that contrasts more with a background (rgb(...) or #rrggbb)."""
    b = col(background)
    parts = F.split(F.regexp_replace(b, r"[^0-9,]", ""), ",")
    channel = lambda i: F.when(b.startswith("rgb("), F.get(parts, F.lit(i)).try_cast("int")).otherwise(F.conv(F.substring(b, 2 + 2 * i, 2), 16, 10).try_cast("int")) / 255
    linear = lambda s: F.when(s <= 0.03928, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))
    luminance = 0.2126 * linear(channel(0)) + 0.7152 * linear(channel(1)) + 0.0722 * linear(channel(2))
    return F.when(1.05 / (luminance + 0.05) > (luminance + 0.05) / (DARK_INK_LUMINANCE + 0.05), LIGHT_INK).otherwise(DARK_INK)
