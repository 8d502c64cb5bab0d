"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, licences, media, mixing, near, quality, suffix, urls, warc, wordscores
from tessera.llm.common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source's size and target and the words that the mix takes. Nulls, empty texts, ties and repeated rows: see ``mixing``."""
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as the archives give it back. Null payloads are empty, repeated rows are records of their own: see ``warc``."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what repeats cut out of its bytes. Null texts are empty, rows of one id go by text: see ``suffix``."""
    return suffix.removals(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with the rule that decides. Null URLs have empty hosts; equally long rules go by action, then string: see ``urls``."""
    return urls.judge(table(spark, sf_dir, "pages"), urls.rule_table(spark))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the places and labels of licences. Null texts have no words: see ``licences``."""
    return licences.scan(table(spark, sf_dir, "documents"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group. Texts without words link with nothing, null ids come last: see ``near``."""
    return near.classes(table(spark, sf_dir, "documents"), near.Near(shingle=3, percent=85, bands=36, rows=7))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with digests of its ids and of what they decode to. Null texts have no ids: see ``bpe``."""
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its stored image and the features read back. Null texts are empty: see ``media``."""
    return media.stored_features(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the losses of both models. Texts without words have null losses: see ``wordscores``."""
    return wordscores.difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its counts and verdicts. Null texts have no words, strata without labels no cutoff: see ``quality``."""
    return quality.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_warc_round_trip, op3_suffix_dedup, op4_url_filter, op5_license_scan, op6_minhash_near_dedup, op7_bpe_round_trip, op8_media_columns, op9_lm_scoring, op10_quality_rules)}

_URL_VALUES = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in urls.RULES)

SQL = {
    # Base32 takes 20 bits, five hex digits, at a time.
    "op2_warc_round_trip": r"""
WITH b AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS x FROM pages),
k AS (SELECT x, max(page_id) AS keeper, count(*) AS copies FROM b GROUP BY x),
d AS (SELECT x, string_agg(list_aggregate(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((bits >> s) & 31)::INT + 1, 1)), 'string_agg', ''), '' ORDER BY i) AS digest
      FROM (SELECT x, i, ('0x' || substr(x, 5 * i + 1, 5))::BIGINT AS bits FROM (SELECT x, unnest(range(0, 8)) AS i FROM k)) GROUP BY x)
SELECT page_id, octet_length(encode(html)) AS payload_bytes, digest AS payload_digest,
  CASE WHEN copies = 1 OR page_id IS NOT DISTINCT FROM keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN copies = 1 OR page_id IS NOT DISTINCT FROM keeper THEN NULL ELSE keeper END AS refers_to
FROM b JOIN k ON k.x = b.x JOIN d ON d.x = b.x
""",
    # Texts stand as hex digits, so that a byte is two characters, and are read in chunks of 256 windows. A run is a stretch of repeated windows that touch.
    "op3_suffix_dedup": rf"""
WITH t AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, coalesce(text, '')) AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT r, b, substr(h, 2 * b + 1, {2 * (256 + suffix.LENGTH - 1)}) AS c FROM (SELECT r, h, unnest(range(0, length(h) // 2 - {suffix.LENGTH - 1}, 256)) AS b FROM t WHERE length(h) >= {2 * suffix.LENGTH})),
p AS (SELECT r, b + i AS p, substr(c, 2 * i + 1, {2 * suffix.LENGTH}) AS v FROM (SELECT r, b, c, unnest(range(0, length(c) // 2 - {suffix.LENGTH - 1})) AS i FROM c)),
least AS (SELECT v, min({{'r': r, 'p': p}}) AS m FROM p GROUP BY v HAVING count(*) > 1),
again AS (SELECT r, p FROM p JOIN least ON p.v = least.v WHERE (r, p) <> (m.r, m.p)),
mark AS (SELECT r, p, coalesce(p > lag(p) OVER (PARTITION BY r ORDER BY p) + {suffix.LENGTH}, true)::INT AS new FROM again),
run AS (SELECT r, min(p) AS s, max(p) + {suffix.LENGTH} AS e FROM (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS g FROM mark) GROUP BY r, g),
gap AS (SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS b FROM run),
cut AS (SELECT t.r, sum(e - s) AS gone, count(*) AS n, max(e) AS last, string_agg(substr(h, 2 * b + 1, 2 * (s - b)), '' ORDER BY s) AS kept FROM gap JOIN t ON t.r = gap.r GROUP BY t.r)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM t LEFT JOIN cut ON cut.r = t.r
""",
    "op6_minhash_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, v FROM (
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS v FROM w WHERE len(w) >= 3
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 2)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM s a JOIN s b ON a.v = b.v AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_have >= 85 * (x.n + y.n - both_have)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT b, a FROM link UNION SELECT reach.a, l.b FROM reach JOIN (SELECT a, b FROM link UNION ALL SELECT b, a FROM link) l ON reach.b = l.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id, least(w.doc_id, coalesce(m, w.doc_id)) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN least ON a = w.doc_id
""",
    "op4_url_filter": rf"""
WITH rules(action, rule_host, rule_path) AS (VALUES {_URL_VALUES}),
u AS (SELECT row_number() OVER () AS i, page_id,
        translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
best AS (SELECT i, rule_host || rule_path AS rule, action,
        row_number() OVER (PARTITION BY i ORDER BY length(rule_host || rule_path) DESC, action DESC, rule_host || rule_path) AS n
      FROM u JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(action, '{urls.DEFAULT}') AS verdict FROM u LEFT JOIN best ON u.i = best.i AND n = 1
""",
    "op10_quality_rules": rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t,
        list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS v FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, v) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM dup) GROUP BY r),
f AS (SELECT w.r, doc_id, lang, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
          - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep ON w.r = rep.r),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
v AS (SELECT *, {quality.badness("//")} AS badness FROM b),
held AS (SELECT lang, doc_id, max(badness) AS badness FROM v WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY lang, doc_id),
size AS (SELECT lang, count(*) AS n FROM held GROUP BY lang HAVING count(*) * ln(1 - {quality.ALPHA_MILLE}::DOUBLE / 1000) <= ln({quality.DELTA!r}::DOUBLE)),
p AS (SELECT {quality.ALPHA_MILLE}::DOUBLE / 1000 AS a, {quality.DELTA!r}::DOUBLE / (SELECT count(*) FROM size) AS level),
tail AS (SELECT lang, n, k, list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(a) + (n - i) * ln(1 - a)))) AS t
      FROM (SELECT lang, n, unnest(range(0, n * {quality.ALPHA_MILLE} // 1000 + 1)) AS k FROM size), p),
most AS (SELECT lang, max(k) AS most FROM tail, p WHERE t <= level GROUP BY lang),
cell AS (SELECT lang, badness FROM held UNION SELECT lang, 1000 FROM size),
above AS (SELECT cell.lang, cell.badness, count(held.doc_id) AS above FROM cell LEFT JOIN held ON held.lang IS NOT DISTINCT FROM cell.lang AND held.badness > cell.badness GROUP BY ALL),
cut AS (SELECT above.lang, min(badness) AS cutoff FROM above JOIN most ON most.lang IS NOT DISTINCT FROM above.lang WHERE above <= most GROUP BY above.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(badness > cutoff, false) AS kept FROM v LEFT JOIN cut ON cut.lang IS NOT DISTINCT FROM v.lang
""",
}
