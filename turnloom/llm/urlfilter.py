"""URL filters: pattern rules indexed by their rarest literal token, and longest-prefix rules.

A pattern is written with `*` (anything), `^` (a character outside [a-z0-9_.%-], or the end), a leading
`||` (at a host label) and a leading or trailing `|` (at the start or end); everything else is literal. A
literal run of letters and digits that a separator or an anchor bounds on both sides must occur in a
matching URL as a whole token, so a rule is filed under the one of its tokens that is rarest in the
URLs at hand, and its regular expression runs only on URLs that hold the token. Rules without such a token
are tried on every URL.

Nulls: a null URL, or one without `://`, has an empty host and path and no rule; the method allows it.
Empty tables give no rows; repeated rows are judged one by one; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import LOWER

#: Prefix rules of the contract: (verdict, host and path).
PREFIX_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
#: Words that name unwanted sites when they stand alone in a host label or at a hyphen.
UNWANTED = "ads adserver adult bet bets betting casino casinos cialis escort gambling lottery nude pharmacy pills poker porn slots torrent tracker viagra warez".split()
#: Pattern rules that judge what no prefix rule fits.
BLOCK_PATTERNS = ["||spam-farm.*^", "cheap-pills.", "/casino/", "-casino.", "/viagra^", "adserver.", "/ads/banner^", "||doubleclick.*^", "xxx-", "/warez/"]
BLOCK_PATTERNS += [p for w in UNWANTED for p in (f"||{w}.", f"||{w}-", f"||*-{w}.", f"||*-{w}-") if p not in BLOCK_PATTERNS]
#: Rules are broadcast in blocks of so many characters; each block is one pass within the same tasks.
BLOCK_CHARS = 16_000_000

_TOKEN = re.compile(r"[a-z0-9]+")
_PARTS = re.compile(r"://([^/?#]*)([^?#]*)", re.S)


def parts(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path of a URL; both empty if it is null or has no `://`."""
    found = _PARTS.search(url) if url is not None else None
    if not found:
        return "", ""
    return found[1].encode("utf-8", "surrogatepass").translate(LOWER).decode("utf-8", "surrogatepass"), found[2]


def pattern_regex(pattern: str) -> str:
    """The regular expression (on lower-cased URLs) that a pattern stands for."""
    body, start, end = pattern.lower(), "", ""
    if body.startswith("||"):
        body, start = body[2:], r"^[a-z][a-z0-9+.-]*://([^/?#]*[.])?"
    elif body.startswith("|"):
        body, start = body[1:], "^"
    if body.endswith("|"):
        body, end = body[:-1], "$"
    told = {"*": ".*", "^": r"([^a-z0-9_.%-]|$)"}
    return start + "".join(told.get(c) or re.escape(c) for c in body) + end


def pattern_tokens(pattern: str) -> list[str]:
    """Literal tokens that any matching URL must hold as whole tokens."""
    body = pattern.lower()
    anchored_start, anchored_end = body.startswith("|"), body.endswith("|")
    core = body.strip("|")
    out = []
    for m in _TOKEN.finditer(core):
        before = core[m.start() - 1] if m.start() else ("^" if anchored_start else "*")
        after = core[m.end()] if m.end() < len(core) else ("^" if anchored_end else "*")
        if before != "*" and after != "*":
            out.append(m[0])
    return out


class RuleIndex:
    """Pattern rules by rarest token; prefix rules by host."""

    def __init__(self, patterns: list[str], prefixes: list[tuple[str, str]], frequency: dict[str, int] | None = None):
        frequency = frequency or {}
        self.by_token: dict[str, list[tuple[str, re.Pattern]]] = defaultdict(list)
        self.always: list[tuple[str, re.Pattern]] = []
        for p in patterns:
            rule = (p, re.compile(pattern_regex(p), re.S))
            if tokens := pattern_tokens(p):
                self.by_token[min(tokens, key=lambda t: (frequency.get(t, 0), -len(t), t))].append(rule)
            else:
                self.always.append(rule)
        self.by_host: dict[str, list[tuple[str, str, str]]] = defaultdict(list)
        for verdict, rule in prefixes:
            host, slash, path = rule.partition("/")
            self.by_host[host].append((slash + path, rule, verdict))
        for rules in self.by_host.values():
            rules.sort(key=lambda r: (-len(r[0]), r[0]))

    def prefix(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest prefix rule that fits, and its verdict."""
        best = None
        at = host
        while at:
            for start, rule, verdict in self.by_host.get(at, ()):
                if path.startswith(start):
                    if best is None or len(rule) > len(best[0]):
                        best = (rule, verdict)
                    break
            at = at.partition(".")[2]
        return best

    def pattern(self, url: str | None) -> str | None:
        """The first pattern, in text order, that matches; only rules filed under the URL's tokens run."""
        if url is None:
            return None
        low = url.lower()
        tried = [r for t in set(_TOKEN.findall(low)) for r in self.by_token.get(t, ())]
        return min((p for p, rx in (*tried, *self.always) if rx.search(low)), default=None)


def token_frequency(urls: DataFrame, patterns: list[str], column: str = "url") -> dict[str, int]:
    """URLs that hold each literal token of the rules: at most one number a rule token."""
    wanted = sorted({t for p in patterns for t in pattern_tokens(p)})
    if not wanted:
        return {}
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.col(column)), F.lit("[a-z0-9]+"), F.lit(0)))
    told = urls.sparkSession.createDataFrame([(t,) for t in wanted], "t string")  # tokens of one block of rules
    found = urls.select(F.explode(tokens).alias("t")).join(F.broadcast(told), "t", "left_semi").groupBy("t").count()
    return {r["t"]: r["count"] for r in found.collect()}  # at most len(wanted) rows


def rule_blocks(patterns: list[str], prefixes: list[tuple[str, str]], chars: int) -> Iterator[tuple[list[str], list[tuple[str, str]]]]:
    """The rules in blocks of about so many characters; one empty block if there are none."""
    block: tuple[list, list] = ([], [])
    size = 0
    for k, rule in ((k, rule) for k, rules in enumerate((patterns, prefixes)) for rule in rules):
        if size >= chars:
            yield block
            block, size = ([], []), 0
        block[k].append(rule)
        size += len(rule) if k == 0 else len(rule[1])
    yield block


def judge_urls(
    pages: DataFrame,
    prefixes: list[tuple[str, str]] = PREFIX_RULES,
    patterns: list[str] = BLOCK_PATTERNS,
    id_column: str = "page_id",
    column: str = "url",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """id, host, path, rule (prefix rule or null), verdict (allow or block), pattern (that blocked, or null)."""
    kind = dict(pages.dtypes)[id_column]
    names = ["_id", "_url", "host", "path", "rule", "said", "pattern"]
    empty = F.lit(None).cast("string")
    found = pages.select(F.col(id_column).alias("_id"), F.col(column).alias("_url"), *(empty.alias(n) for n in names[2:]))
    for block in rule_blocks(patterns, prefixes, block_chars):
        shared = pages.sparkSession.sparkContext.broadcast((*block, token_frequency(pages, block[0], column)))

        def judged(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = RuleIndex(*shared.value)
            for b in batches:
                hosts, paths, rules, verdicts, hits = [], [], [], [], []
                for url, rule, said, hit in zip(*(b.column(k).to_pylist() for k in (1, 4, 5, 6)), strict=True):
                    host, path = parts(url)
                    found = index.prefix(host, path)
                    if found and (rule is None or len(found[0]) > len(rule)):
                        rule, said = found
                    if rule is None:
                        hit = min((h for h in (hit, index.pattern(url)) if h), default=None)
                    for to, x in zip((hosts, paths, rules, verdicts, hits), (host, path, rule, said, hit), strict=True):
                        to.append(x)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.string()) for x in (hosts, paths, rules, verdicts, hits))], names)

        found = found.mapInArrow(judged, f"_id {kind}, _url string, host string, path string, rule string, said string, pattern string")
    hit = F.when(F.col("rule").isNull(), F.col("pattern"))  # a rule decides before any pattern
    verdict = F.coalesce("said", F.when(hit.isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return found.select(F.col("_id").alias(id_column), "host", "path", "rule", verdict.alias("verdict"), hit.alias("pattern"))
