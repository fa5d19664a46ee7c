"""The operators' queries over the driver tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.llm import decontaminate, extract, language, neardup, ngramlm, pieces, quality, sharding, toxicity, urlfilter
from turnloom.llm.common import table

QUERIES = {}
ORACLES = {}


def op1_decontamination(spark, sf_dir):
    return decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


ORACLES["op1_decontamination"] = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
phrase AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + 9], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
place AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS p
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM phrase))),
found AS (SELECT r, i, n, item_id FROM place JOIN phrase USING (n, p)),
hit AS (
  SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT r, i, n FROM found)) GROUP BY r),
ids AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS said FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(said, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN ids USING (r)
"""


def op2_lm_scoring(spark, sf_dir):
    return ngramlm.score(table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark, sf_dir):
    return neardup.components(table(spark, sf_dir, "documents"))


ORACLES["op3_minhash_near_dedup"] = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM doc WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
both_in AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM both_in JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
way AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM doc UNION SELECT reach.a, way.b FROM reach JOIN way ON reach.b = way.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, m AS component_id, doc_id = m AS kept
FROM doc LEFT JOIN n USING (doc_id) JOIN low ON low.a = doc.doc_id
"""


def op4_language_id(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark, sf_dir):
    rows = quality.judge(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 9).alias("host_rate"))


ORACLES["op5_quality_rules"] = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('h' || source, 'n') AS host, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
place AS (SELECT r, i, array_to_string(w[i : i + 4], ' ') AS p FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM doc)),
twice AS (SELECT r, unnest(range(i, i + 5)) AS k FROM place JOIN (SELECT r, p FROM place GROUP BY r, p HAVING count(*) > 1) USING (r, p)),
hit AS (SELECT r, count(DISTINCT k) AS n FROM twice GROUP BY r),
line AS (SELECT r, unnest(string_split(t, chr(10))) AS x FROM doc),
dup AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM line WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
counted AS (
  SELECT doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_repeat_words
  FROM doc LEFT JOIN dup USING (r) LEFT JOIN hit USING (r)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted),
host AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (base_failed) AS DOUBLE) AS bad FROM judged GROUP BY host),
moment AS (
  SELECT least(greatest(sum(bad) / sum(n), 1e-4), 1 - 1e-4) AS m, coalesce(var_samp(bad / n), 0) AS v, avg(1 / n) AS inv FROM host),
prior AS (SELECT m, least(greatest(m * (1 - m) / greatest(v - m * (1 - m) * inv, 1e-6) - 1, 1), 1e4) AS k FROM moment),
shrunk AS (SELECT host, n + k AS weight, (bad + m * k) / (n + k) AS rate, (1 + m) / 2 AS bound FROM host, prior),
verdict AS (SELECT host, rate, rate - 3 * sqrt(rate * (1 - rate) / (weight + 1)) > bound AS gone FROM shrunk)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT gone AS kept, round(rate, 9) AS host_rate
FROM judged JOIN verdict USING (host)
"""


def op6_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents")).drop("stratum")


# crc32 byte by byte, from a table that the reflected polynomial gives bit by bit
ORACLES["op6_sharding"] = r"""
WITH RECURSIVE bit AS (
  SELECT i AS byte, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bit WHERE k < 8),
crc AS (SELECT list(c ORDER BY byte) AS crc_of FROM bit WHERE k = 8),
raw AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS stratum, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size,
    xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: CAST('0x' || b AS BIGINT)),
      lambda c, b: xor(c >> 8, crc_of[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM documents, crc),
doc AS (SELECT *, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 't:' || text_crc32 || ':' || size)) AS key FROM raw),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY key, doc_id NULLS FIRST, text_crc32, size) - 1 AS rank, count(*) OVER (PARTITION BY stratum) AS n FROM doc),
placed AS (
  SELECT *, row_number() OVER (ORDER BY (rank * 2 + 1) / CAST(n * 2 AS DOUBLE), stratum, key, doc_id NULLS FIRST, text_crc32, size) - 1 AS position, count(*) OVER () AS total FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(position * 24 // total AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY position * 24 // total ORDER BY position) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed
"""


def op7_sentencepiece(spark, sf_dir):
    return pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_url_filters(spark, sf_dir):
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"))


def _listed(rows):
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)


ORACLES["op8_url_filters"] = rf"""
WITH prefix(verdict, rule) AS (VALUES {_listed(urlfilter.PREFIX_RULES)}),
pattern(pattern, re) AS (VALUES {_listed((p, urlfilter.pattern_regex(p)) for p in urlfilter.BLOCK_PATTERNS)}),
page AS (
  SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS url,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
fits AS (
  SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS said
  FROM page JOIN prefix ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, strpos(rule, '/')))
  GROUP BY r),
hits AS (SELECT r, min(pattern) AS pattern FROM page JOIN pattern ON regexp_matches(lower(url), re, 's') GROUP BY r)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN pattern IS NULL THEN 'allow' ELSE 'block' END) AS verdict, CASE WHEN rule IS NULL THEN pattern END AS pattern
FROM page LEFT JOIN fits USING (r) LEFT JOIN hits USING (r)
"""


def op9_toxicity(spark, sf_dir):
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_html_extraction(spark, sf_dir):
    return extract.extract(table(spark, sf_dir, "pages"))


for _f in (op1_decontamination, op2_lm_scoring, op3_minhash_near_dedup, op4_language_id, op5_quality_rules, op6_sharding, op7_sentencepiece, op8_url_filters, op9_toxicity, op10_html_extraction):
    QUERIES[_f.__name__] = _f
