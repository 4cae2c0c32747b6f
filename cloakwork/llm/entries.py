"""The queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, htmltext, licenses, mixing, neighbours, pii, quality, rollups, simhash, toxicity
from .common import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.weighed(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.report(table(spark, sf_dir, "embeddings"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_toxicity": op2_toxicity,
    "op3_mixing": op3_mixing,
    "op4_simhash": op4_simhash,
    "op5_token_counts": op5_token_counts,
    "op6_quality": op6_quality,
    "op7_neighbours": op7_neighbours,
    "op8_licenses": op8_licenses,
    "op9_decontamination": op9_decontamination,
    "op10_pii": op10_pii,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_PIECES = r"[A-Za-z\x{80}-\x{10FFFF}]+|[0-9]{1,3}|[^A-Za-z0-9\x{80}-\x{10FFFF}\x20\x09-\x0D]"
_COUNTS = rf"""[
    {{'tokenizer': 'pieces-2', 'n_tokens': len(regexp_extract_all(TEXT, '{_PIECES}')), 'n_chars': length(TEXT)}},
    {{'tokenizer': 'words-1', 'n_tokens': len(regexp_extract_all(TEXT, '[^\x20\x09-\x0D]+')), 'n_chars': length(TEXT)}}]"""


_TEMPLATES = ", ".join(f"({t}, '{name}', '{' '.join(licenses.words_of(text))}')" for t, (name, text) in enumerate(licenses.templates_of()))

ORACLES = {
    "op9_decontamination": rf"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
grams AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
  FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
lens AS (SELECT DISTINCT n FROM grams),
wins AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM docs, lens, unnest(range(1, len(w) - n + 2)) AS u(i)),
found AS (SELECT doc_id, wins.n, i, item_id FROM wins JOIN grams USING (n, gram)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + n)) AS u(p) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op5_token_counts": f"""
WITH marks AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id),
texts AS (
  SELECT source, lang, CASE WHEN quality = 0 THEN regexp_replace(coalesce(text, ''), '[#$%&*@!|]+', '', 'g') ELSE coalesce(text, '') END AS t
  FROM documents LEFT JOIN marks USING (doc_id) WHERE coalesce(toxic, 0) <> 1),
counts AS (SELECT source, lang, unnest({_COUNTS.replace("TEXT", "t")}) AS c FROM texts)
SELECT source, lang, c.tokenizer AS tokenizer, CAST(count(*) AS BIGINT) AS n_docs,
  CAST(sum(c.n_tokens) AS BIGINT) AS n_tokens, CAST(sum(c.n_chars) AS BIGINT) AS n_chars
FROM counts GROUP BY ALL""",
    "op8_licenses": rf"""
WITH tpl AS (SELECT t, name, string_split(ws, ' ') AS w FROM (VALUES {_TEMPLATES}) AS v(t, name, ws)),
tg AS (SELECT DISTINCT t, w[i] || ' ' || w[i + 1] AS gram FROM tpl, unnest(range(1, len(w))) AS u(i)),
sizes AS (SELECT t, count(*) AS m FROM tg GROUP BY t),
known AS (SELECT t, name, len(w) AS words, m, ceil({licenses.LEAST} / (2 - {licenses.LEAST}) * m - 1e-9) AS need FROM tpl JOIN sizes USING (t)),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
pos AS (SELECT r, i, w[i] || ' ' || w[i + 1] AS gram FROM docs, unnest(range(1, len(w))) AS u(i)),
hits AS (SELECT r, t, i, gram FROM pos JOIN tg USING (gram)),
cand AS (SELECT r, t FROM hits JOIN known USING (t) GROUP BY r, t HAVING count(DISTINCT gram) >= any_value(need)),
starts AS (SELECT r, t, i AS s, words, m, name FROM hits SEMI JOIN cand USING (r, t) JOIN known USING (t)),
wins AS (
  SELECT r, t, s, any_value(name) AS name, any_value(words) AS words, any_value(m) AS m, count(DISTINCT p.gram) AS n,
    count(DISTINCT p.gram) FILTER (tg.gram IS NOT NULL) AS shared
  FROM starts JOIN pos p USING (r) LEFT JOIN tg USING (t, gram) WHERE p.i BETWEEN s AND s + words - 2 GROUP BY r, t, s),
best AS (
  SELECT *, 2.0 * shared / (n + m) AS dice FROM wins WHERE 2.0 * shared / (n + m) >= {licenses.LEAST} - 1e-12
  QUALIFY row_number() OVER (PARTITION BY r, t ORDER BY shared DESC, dice DESC, s) = 1),
stand AS (
  SELECT * FROM best x WHERE NOT EXISTS (
    SELECT 1 FROM best y WHERE y.r = x.r AND y.name <> x.name AND y.s < x.s + x.words AND x.s < y.s + y.words
      AND (y.shared > x.shared OR y.shared = x.shared AND (y.dice > x.dice OR y.dice = x.dice AND y.name < x.name)))),
each AS (
  SELECT r, count(DISTINCT name) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM stand GROUP BY r),
tops AS (SELECT r, name, dice, s FROM stand QUALIFY row_number() OVER (PARTITION BY r ORDER BY shared DESC, dice DESC, name, s) = 1)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_licenses, coalesce(names, '') AS licenses, name AS best_license,
  CAST(dice AS DOUBLE) AS best_dice, CAST(s - 1 AS BIGINT) AS best_at
FROM docs LEFT JOIN each USING (r) LEFT JOIN tops USING (r)""",
}
