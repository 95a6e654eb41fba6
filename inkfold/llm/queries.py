"""The queries of this package, over whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html_extract, language_id, line_dedup, ngram_join, packing, quality, sharding, suffix_dedup, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.passages(_table(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"))


def op4_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page.page_id", "page.url", "text", "n_chars")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc.doc_id", "n_lines", "n_dropped", F.sha2(F.encode("new_text", "UTF-8"), 256).alias("kept_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("row")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_length_buckets, op2_suffix_dedup, op3_ngram_jaccard, op4_minimax_shards, op5_html_text, op6_language_id, op7_toxicity, op8_line_dedup, op9_quality_rules, op10_decontamination)
}

ORACLE: dict[str, str] = {}

ORACLE["op3_ngram_jaccard"] = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s
  FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM reach WHERE reach.a = sets.doc_id), doc_id)) AS component_id
FROM sets
"""

ORACLE["op8_line_dedup"] = """
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
keyed AS (SELECT doc_id, lines, list_transform(lines, lambda l: translate(trim(l, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS keys FROM docs),
flat AS (SELECT doc_id, unnest(lines) AS line, unnest(keys) AS k, unnest(range(len(lines))) AS pos FROM keyed),
often AS (SELECT k, max(doc_id) AS last FROM flat WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT f.doc_id, f.line, f.pos, o.k IS NOT NULL AND f.doc_id <> o.last AS gone FROM flat f LEFT JOIN often o ON f.k = o.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

ORACLE["op4_minimax_shards"] = """
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, n::BIGINT) AS c FROM range(256) r(n))),
texts AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents),
hexed AS (SELECT text, hex(encode(text)) AS h, ('0x' || substr(md5(text), 1, 4))::INT AS unit FROM texts),
crcs AS (
  SELECT text, unit, xor(4294967295::BIGINT, list_reduce(
    list_transform(range(length(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT),
    lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295::BIGINT)) AS crc
  FROM hexed, crc_table),
docs AS (SELECT doc_id, octet_length(encode(c.text)) + 16 AS size, crc, unit FROM documents d JOIN crcs c ON coalesce(d.text, '') = c.text),
by_unit AS (SELECT unit, sum(size)::BIGINT AS size FROM docs GROUP BY unit),
listed AS (SELECT list(size ORDER BY unit) AS s, max(size) AS most, ceil(sum(size) / 40.0)::BIGINT AS mean FROM by_unit),
search AS (
  SELECT greatest(most, mean) AS lo, mean + most AS hi, s FROM listed
  UNION ALL
  SELECT CASE WHEN fits THEN lo ELSE mid + 1 END, CASE WHEN fits THEN mid ELSE hi END, s FROM (
    SELECT lo, hi, s, (lo + hi) // 2 AS mid,
      list_reduce(s, lambda a, x: CASE WHEN (a % 1099511627776) + x <= (lo + hi) // 2 THEN a + x ELSE (a // 1099511627776 + 1) * 1099511627776 + x END, 0::HUGEINT) // 1099511627776 < 40 AS fits
    FROM search WHERE lo < hi)),
capacity AS (SELECT min(hi) AS c FROM search WHERE lo >= hi),
numbered AS (SELECT unit, size, row_number() OVER (ORDER BY unit) AS k FROM by_unit),
walk AS (
  SELECT k, unit, size AS used, 0 AS shard FROM numbered WHERE k = 1
  UNION ALL
  SELECT n.k, n.unit, CASE WHEN w.used + n.size <= c THEN w.used + n.size ELSE n.size END, CASE WHEN w.used + n.size <= c THEN w.shard ELSE w.shard + 1 END
  FROM walk w JOIN numbered n ON n.k = w.k + 1, capacity)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY docs.unit, doc_id, size, crc) - 1 AS slot, NULL::INT AS grown_shard, c AS capacity
FROM docs JOIN walk ON docs.unit = walk.unit, capacity
"""

# The dynamic programme over all pairs of boundaries, a layer for each number of buckets.
ORACLE["op1_length_buckets"] = """
WITH RECURSIVE counted AS (
  SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::INT AS n FROM documents),
cut AS (SELECT doc_id, n, unnest(range(greatest(1, (n + 4095) // 4096)))::INT AS piece FROM counted),
pieces AS (SELECT doc_id, piece, piece * 4096 AS start, least(4096, n - piece * 4096) AS n_tokens FROM cut),
hist AS (SELECT greatest(1, n_tokens) AS l, count(*) AS c FROM pieces GROUP BY 1),
listed AS (SELECT count(*)::INT AS n, list(l ORDER BY l) AS l, list_concat([0], list(s ORDER BY l)) AS p FROM (SELECT l, sum(c) OVER (ORDER BY l)::BIGINT AS s FROM hist)),
layers AS (
  SELECT 0 AS k, list_transform(range(n + 1), lambda j: CASE WHEN j = 0 THEN 0 ELSE 1e15 END::DOUBLE) AS best, []::BIGINT[] AS back FROM listed
  UNION ALL
  SELECT k + 1, list_concat([1e15::DOUBLE], list_transform(range(1, n + 1), lambda j: list_min(list_transform(range(j), lambda i: best[i + 1] + (p[j + 1] - p[i + 1]) * l[j])))),
    list_concat([0::BIGINT], list_transform(range(1, n + 1), lambda j: list_position(list_transform(range(j), lambda i: best[i + 1] + (p[j + 1] - p[i + 1]) * l[j]),
      list_min(list_transform(range(j), lambda i: best[i + 1] + (p[j + 1] - p[i + 1]) * l[j]))) - 1))
  FROM layers, listed WHERE k < least(16, n)),
chosen AS (SELECT k, n FROM layers, listed WHERE k > 0 ORDER BY best[n + 1], k LIMIT 1),
walk AS (
  SELECT k, n::BIGINT AS j FROM chosen
  UNION ALL
  SELECT w.k - 1, y.back[w.j + 1] FROM walk w JOIN layers y ON y.k = w.k WHERE w.j > 0),
bounds AS (SELECT l[j] AS bound, (row_number() OVER (ORDER BY j) - 1)::INT AS bucket FROM walk, listed WHERE j > 0),
placed AS (SELECT p.*, (SELECT min(bound) FROM bounds WHERE bound >= p.n_tokens) AS bucket_len FROM pieces p),
numbered AS (
  SELECT placed.*, bucket, greatest(1, 65536 // bucket_len) AS fits, row_number() OVER (PARTITION BY bucket ORDER BY doc_id NULLS FIRST, piece, n_tokens) - 1 AS k
  FROM placed JOIN bounds ON bound = bucket_len)
SELECT doc_id, piece, start, n_tokens, bucket, bucket_len::INT AS bucket_len, k // fits AS batch, (k % fits)::INT AS row FROM numbered
"""

ORACLE["op2_suffix_dedup"] = """
WITH docs AS (
  SELECT DISTINCT doc_id, text, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
texts AS (SELECT text, any_value(w) AS w, min(doc_id) AS id, max(doc_id) AS other FROM docs GROUP BY text),
windows AS (SELECT id, pos, array_to_string(w[pos + 1 : pos + 50], ' ') AS gram FROM (SELECT id, w, unnest(range(len(w) - 49)) AS pos FROM texts WHERE len(w) >= 50)),
holders AS (SELECT gram, min(id) AS low, max(id) AS high FROM windows GROUP BY gram HAVING min(id) <> max(id)),
held AS (SELECT id, pos, CASE WHEN id = low THEN high ELSE low END AS partner FROM windows JOIN holders USING (gram)),
marked AS (SELECT *, CASE WHEN pos <= lag(pos) OVER (PARTITION BY id ORDER BY pos) + 50 THEN 0 ELSE 1 END AS new FROM held),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY pos) AS k FROM marked),
passages AS (SELECT id, min(pos) AS b, max(pos) + 50 AS e, arg_min(partner, pos) AS partner FROM numbered GROUP BY id, k)
SELECT id AS doc_id, b::BIGINT AS "begin", e::BIGINT AS "end", (e - b)::BIGINT AS n_words, partner FROM passages JOIN texts USING (id) WHERE other = id
UNION ALL
SELECT doc_id, 0, len(d.w), len(d.w), CASE WHEN doc_id = id THEN other ELSE id END FROM docs d JOIN texts USING (text) WHERE other <> id AND len(d.w) >= 50
"""

# The table's pages keep their text in an article element, in h1 and p elements with b and br inside; no tree and no score.
ORACLE["op5_html_text"] = """
WITH parts AS (
  SELECT page_id, url, list_transform(regexp_split_to_array(replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<br>', ' '), '</?(?:p|h1)>'),
    lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(x, '</?b>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g'))) AS blocks
  FROM pages),
joined AS (SELECT page_id, url, coalesce(array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10) || chr(10)), '') AS text FROM parts)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM joined
"""

# Every alignment in which enough tokens are alike is tried; no seed and no mask.
ORACLE["op10_decontamination"] = """
WITH toks AS (
  SELECT 'd' AS kind, doc_id AS id, hash(text) AS r, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, hash(text), list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') FROM benchmark),
kept AS (SELECT DISTINCT * FROM toks WHERE len(w) > 0),
each AS (SELECT kind, id, r, len(w) AS n, unnest(w) AS t, unnest(range(len(w))) AS pos FROM kept),
shifts AS (
  SELECT d.id AS doc_id, d.r, b.id AS item_id, b.r AS s, d.pos - b.pos AS shift
  FROM each d JOIN each b ON d.kind = 'd' AND b.kind = 'b' AND d.t = b.t
  GROUP BY ALL HAVING count(*) >= ceil(least(13, any_value(b.n)) * 80 / 100.0)),
hits AS (
  SELECT s.doc_id, s.r, s.item_id, s.shift, least(13, len(b.w)) AS n,
    list_transform(range(len(b.w)), lambda k: CASE WHEN k + s.shift >= 0 AND k + s.shift < len(d.w) AND d.w[k + s.shift + 1] = b.w[k + 1] THEN 1 ELSE 0 END) AS h
  FROM shifts s JOIN kept d ON d.kind = 'd' AND d.id = s.doc_id AND d.r = s.r JOIN kept b ON b.kind = 'b' AND b.id = s.item_id AND b.r = s.s),
best AS (SELECT *, list_max(list_transform(range(len(h) - n + 1), lambda k: list_sum(h[k + 1 : k + n]))) AS matched FROM hits),
good AS (SELECT * FROM best WHERE matched >= ceil(n * 80 / 100.0))
SELECT doc_id, item_id, matched::BIGINT AS n_matched, n::BIGINT AS n_tokens, shift::BIGINT AS doc_start
FROM good QUALIFY row_number() OVER (PARTITION BY doc_id, r, item_id ORDER BY matched DESC, n DESC, shift) = 1
"""
