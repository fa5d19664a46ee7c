"""Quality rules, sharding and URL filters against plain Python."""

import hashlib
import random
import re
import statistics
import time
import zlib
from collections import Counter

import pytest

from turnloom.llm import quality, sharding, urlfilter

TEXTS = [
    None, "", "   \n\t ", "one two three", "a b c d e f g h i j a b c d e x a b c d e", "x " * 400,
    "line one\nline one\n\nline two\n \nline one", "é#è $%& <b>|</b> " * 3, "w" + " w" * 30000, "\x1ca b\x0bc\x0cd e",
]


def rows():
    rng = random.Random(5)
    out = [(i, t, "en", f"src{i % 3}" if i % 4 else None, 0) for i, t in enumerate(TEXTS)]
    for i in range(len(TEXTS), 120):
        out.append((i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(80))), "en", f"src{i % 3}", 0))
    return out + [out[3], (None, "a null id", None, None, None)]


def docs(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, "doc_id long, text string, lang string, source string, n_chars long").withColumnRenamed("n_chars", "n_words_extra")


def brute_counts(text):
    t = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), failed


def test_base_counts(spark):
    got = [tuple(r) for r in quality.base_counts(docs(spark)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()]
    assert Counter(got) == Counter((r[0], *brute_counts(r[1])) for r in rows())


def test_host_verdicts_reject_only_bad_hosts_with_evidence(spark):
    data = [(i, None, None, "bad", 0) for i in range(300)] + [(1000 + i, "good words " + " ".join(f"w{k}" for k in range(20)), None, f"s{i % 20}", 0) for i in range(2000)] + [(9000, None, None, "tiny", 0)]
    data += [(9999, " ".join(f"fine{k}" for k in range(20)), None, "bad", 0)]
    got = {r["doc_id"]: r for r in quality.judge(docs(spark, data)).collect()}
    assert len(got) == len(data)
    assert not got[9999]["kept"] and not got[9999]["base_failed"] and got[9999]["host_rejected"]
    assert not got[9000]["host_rejected"]
    assert all(got[i]["kept"] for i in range(1000, 3000))
    kept = quality.keep_good(docs(spark, data))
    assert kept.columns == docs(spark, []).columns
    assert {r["doc_id"] for r in kept.collect()} == set(range(1000, 3000))
    assert quality.judge(docs(spark, [])).count() == 0


def test_long_texts_are_split_once(spark):
    """The filter may repeat a text's counts, but never once a window."""
    long = " ".join(f"w{i % 19_990}" for i in range(20_000))
    data = [(1, long, None, "a", 0), (2, long + " end", None, "a", 0), (3, "word " * 20_000, None, "b", 0)]
    began = time.monotonic()
    kept = quality.keep_good(docs(spark, data))
    assert {r["doc_id"] for r in kept.collect()} == {1, 2}
    assert time.monotonic() - began < 60
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 6 and "sequence(" not in plan


def test_texts_are_split_once_for_hosts_and_rows(spark):
    kept = quality.keep_good(docs(spark))
    assert "split(" not in kept._jdf.queryExecution().optimizedPlan().toString()
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert got == Counter((r[0], r[1]) for r in rows() if not brute_counts(r[1])[-1])
    flags = docs(spark).select(quality.failed_of().alias("failed"), quality.counts_of().alias("counts"))
    assert flags.filter("not (failed <=> counts.base_failed)").count() == 0


def test_clashing_columns_come_back_as_they_were(spark):
    names = "doc_id long, text string, source string, n_words int, base_failed string, word_chars int, _w int, _h string, _lines int, _own int, _host int, host_key string, `a.b` int"
    data = [(1, " ".join(map(str, range(30))), "s", -7, "x", None, 5, "h", 6, 7, 8, "k", 9), (2, None, "s", -8, "y", 1, 5, "h", 6, 7, 8, "k", 9)]
    rows = spark.createDataFrame(data, names)
    kept = quality.keep_good(rows)
    assert kept.columns == rows.columns and [tuple(r) for r in kept.collect()] == data[:1]
    counted = quality.base_counts(rows)
    assert {r["doc_id"]: (r["n_words"], r["_w"], r["a.b"]) for r in counted.collect()} == {1: (30, 5, 9), 2: (0, 5, 9)}


def brute_verdicts(failed):
    """Shrunk rate and verdict by host, of {host: [whether each document failed]}."""
    n = {h: len(x) for h, x in failed.items()}
    bad = {h: sum(x) for h, x in failed.items()}
    m = min(max(sum(bad.values()) / sum(n.values()), 1e-4), 1 - 1e-4)
    raw = [bad[h] / n[h] for h in n]
    v = statistics.variance(raw) if len(raw) > 1 else 0.0
    between = max(v - m * (1 - m) * statistics.mean(1 / x for x in n.values()), 1e-6)
    k = min(max(m * (1 - m) / between - 1, 1), 1e4)
    rate = {h: (bad[h] + m * k) / (n[h] + k) for h in n}
    return {h: (r, r - 3 * (r * (1 - r) / (n[h] + k + 1)) ** 0.5 > (1 + m) / 2) for h, r in rate.items()}


def test_host_verdicts_equal_the_formula_and_change_rows(spark):
    rng = random.Random(4)
    fine = " ".join(f"x{k}" for k in range(20))
    shares = {"awful": 0.8, "poor": 0.45, None: 0.2, "good": 0.02, **{f"s{i}": 0.05 for i in range(9)}}
    data = [(i, fine if rng.random() >= shares[h] else "too short", None, h, 0) for i, h in enumerate(rng.choices(list(shares), k=3000))] + [(9000, "too short", None, "one", 0)]
    failed = {}
    for _, t, _, h, _ in data:
        failed.setdefault(h, []).append(t != fine)
    want = brute_verdicts(failed)
    assert {h for h, (_, gone) in want.items() if gone} == {"awful"}
    got = quality.judge(docs(spark, data)).collect()
    assert len(got) == len(data)
    for r in got:
        rate, gone = want[r["source"]]
        assert abs(r["host_rate"] - rate) < 1e-9 and r["host_rejected"] == gone and r["kept"] == (not gone and not r["base_failed"])
    kept = {r["doc_id"] for r in quality.keep_good(docs(spark, data)).collect()}
    assert kept == {i for i, t, _, h, _ in data if t == fine and h != "awful"} and any(t == fine and h == "awful" for _, t, _, h, _ in data)


def test_interleaving_law_and_mixture(spark):
    data = rows() + [(1000 + i, f"t{i}", "en", "hot" if i % 3 else f"s{i % 7}", 0) for i in range(900)]
    got = sharding.shard(docs(spark, data), 24).collect()
    assert len(got) == len(data)
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(24))
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    by = {}
    for i, t, *_ in data:
        by[i] = t
    for r in got:
        t = (by[r["doc_id"]] or "").encode()
        assert r["size"] == len(t) + 8 and r["text_crc32"] == zlib.crc32(t) and r["law"] == "rows" and r["grown_shard"] is None
    total = Counter(r["stratum"] for r in got)
    for (s, stratum), n in Counter((r["shard"], r["stratum"]) for r in got).items():
        assert abs(n - total[stratum] / 24) <= 1 + len(total) / 2  # a cut may fall within rows of one rank
    assert sharding.shard(docs(spark, [])).count() == 0


@pytest.mark.parametrize(
    "url,host,path,rule,verdict",
    [
        (None, "", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        ("http://A.Example.ORG/es/1?x", "a.example.org", "/es/1", "example.org/es/", "block"),
        ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://example.org/en/22", "example.org", "/en/22", "org/", "allow"),
        ("http://myexample.org/es/", "myexample.org", "/es/", "org/", "allow"),
        ("http://example.org", "example.org", "", None, "allow"),
        ("http://a.com/de/x#t", "a.com", "/de/x", "com/de/", "block"),
        ("http://www.cheap-pills.example.net/fr/", "www.cheap-pills.example.net", "/fr/", None, "block"),
        ("http://x.net/a/casino/b", "x.net", "/a/casino/b", None, "block"),
        ("http://x.net/casinos", "x.net", "/casinos", None, "allow"),
    ],
)
def test_url_verdicts(url, host, path, rule, verdict):
    index = urlfilter.RuleIndex(urlfilter.BLOCK_PATTERNS, urlfilter.PREFIX_RULES)
    assert urlfilter.parts(url) == (host, path)
    found = index.prefix(host, path)
    assert (found[0] if found else None) == rule
    assert (found[1] if found else "block" if index.pattern(url) else "allow") == verdict


def test_index_equals_running_every_rule():
    rng = random.Random(3)
    words = ["ads", "ad", "shop", "pills", "x1", "news", "a"]
    rules = ["".join(rng.choice(["||", "|", "", "*"]) + rng.choice(words) + rng.choice(["^", "*", "", "/", "-"]) + rng.choice([*words, ""]) + rng.choice(["", "|", "^"])) for _ in range(60)]
    index = urlfilter.RuleIndex(rules, [])
    every = [(p, re.compile(urlfilter.pattern_regex(p), re.S)) for p in rules]
    for _ in range(500):
        url = "http://" + "".join(rng.choice([*words, ".", "/", "-", "?"]) for _ in range(rng.randrange(8)))
        assert index.pattern(url) == min((p for p, rx in every if rx.search(url)), default=None), url


def test_url_table(spark):
    pages = spark.createDataFrame([(1, "http://a.com/fr/1", "x"), (1, "http://a.com/fr/1", "x"), (None, None, "y"), (3, "https://spam-farm.x.net/q", None)], "page_id long, url string, host string")
    got = Counter(tuple(r) for r in urlfilter.judge_urls(pages).collect())
    assert got == Counter({(1, "a.com", "/fr/1", "com/fr/", "allow", None): 2, (None, "", "", None, "allow", None): 1, (3, "spam-farm.x.net", "/q", None, "block", "||spam-farm.*^"): 1})
    assert urlfilter.judge_urls(pages.limit(0)).count() == 0


def test_long_rule_lists_run_in_blocks(spark):
    urls = ["http://a.com/fr/1", "http://x.org/es/casino/2", "http://casino-a.net/", "https://b.de/warez/1", None, "http://poker.b.net/x", "http://example.org/en/11"]
    pages = spark.createDataFrame([(i, u, "h", "s") for i, u in enumerate(urls)], "page_id long, url string, said string, _id string")
    whole = sorted(map(repr, urlfilter.judge_urls(pages).collect()))
    assert sorted(map(repr, urlfilter.judge_urls(pages, block_chars=200).collect())) == whole and len(whole) == len(urls)
    blocked = {r["page_id"] for r in urlfilter.judge_urls(pages, block_chars=400).collect() if r["verdict"] == "block"}
    assert blocked == {2, 3, 5, 6}


def test_ranks_and_cuts_equal_sorting_by_hand(spark):
    """The exact place of every row, hot sources, repeated and null ids included; the mixture of each shard is that of the whole."""
    rng = random.Random(6)
    data = [(i, f"text {i}" * rng.randrange(4), "en", "hot" if i % 3 else f"s{i % 7}", 0) for i in range(1200)]
    data += [(None, f"n{i}", "en", "hot", 0) for i in range(60)] + [(5, f"again {i}", "en", None, 0) for i in range(40)]
    rows = []
    for i, t, _, source, _ in data:
        raw = t.encode()
        rows.append((f"s{source}" if source is not None else "n", hashlib.md5(f"17:{f't:{zlib.crc32(raw)}:{len(raw) + 8}' if i is None else i}".encode()).hexdigest(), (i is not None, i or 0), zlib.crc32(raw), len(raw) + 8, i))
    total = Counter(r[0] for r in rows)
    rank, ranked = Counter(), []
    for r in sorted(rows, key=lambda r: (r[0], *r[1:5])):
        ranked.append(((rank[r[0]] * 2 + 1) / (total[r[0]] * 2), *r))
        rank[r[0]] += 1
    ranked.sort(key=lambda r: r[:6])
    want = Counter()
    slots = Counter()
    for place, r in enumerate(ranked):
        shard = place * 24 // len(ranked)
        want[r[6], r[5], r[4], shard, slots[shard]] += 1
        slots[shard] += 1
    got = sharding.shard(docs(spark, data), 24).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got) == want
    mixture = Counter((r["shard"], r["stratum"]) for r in got)
    for s in range(24):
        for stratum, n in total.items():
            # up to a cut each stratum is half a row off its share of the fraction, which is half a row of each stratum off
            assert abs(mixture[s, stratum] - n / 24) <= 1 + n * len(total) / len(ranked)
