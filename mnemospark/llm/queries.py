"""The registered query of each operator, with production parameters, over its whole table; their SQL where there is some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .bpe import encode_documents
from .chat import perspectives
from .common import table
from .divergence import source_divergence
from .html_extract import extract_main_text
from .line_dedup import line_dedup
from .lm_score import lm_scores
from .minhash import near_duplicates
from .packing import pack
from .periodic_runs import periodic_runs
from .quality_classifier import quality_scores
from .quality_rules import quality_rules
from .token_count import token_counts


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lm_scores(table(spark, sf_dir, "documents"))
    return df.select("doc_id", "n_words", F.round("lm_score", 6).alias("lm_score"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return df.select("doc_id", "held_out", "score", "predicted")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives(table(spark, sf_dir, "conversations"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op13_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_quality_rules,
        op3_lm_score,
        op4_token_counts,
        op5_quality_classifier,
        op6_bpe,
        op7_packing,
        op8_nearest,
        op9_chat,
        op10_minhash,
        op11_source_divergence,
        op12_periodic_runs,
        op13_html_extract,
    )
}

SQL: dict[str, str] = {
    "op11_source_divergence": r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
said AS (SELECT d, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS lang_n FROM said GROUP BY ALL HAVING count(DISTINCT d) >= 3),
n AS (SELECT lang, source, term, count(*) AS n FROM said JOIN kept USING (lang, term) GROUP BY ALL),
grp AS (SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(any_value(lang_total), 0) AS lang_total, coalesce(any_value(total), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang) USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM n GROUP BY ALL) USING (lang, source) GROUP BY lang, source),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // (total + v) AS p, 1 + 1000000000::HUGEINT * (lang_n + 1) // (lang_total + v) AS q
  FROM grp JOIN kept USING (lang) LEFT JOIN n USING (lang, source, term)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every
QUALIFY part = 'pair' OR rank <= 200
""",
    "op9_chat": r"""
WITH told AS (SELECT conv_id, turn, replace(CASE WHEN trim(coalesce(role, '')) = '' THEN 'unknown' ELSE lower(trim(role)) END, '<|', '< |') AS who,
  replace(coalesce(text, ''), '<|', '< |') AS said FROM conversations),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, who, said) - 1 AS place FROM told),
views AS (SELECT r.*, s.speaker, who = s.speaker AS train FROM ranked r JOIN (SELECT DISTINCT conv_id, who AS speaker FROM told WHERE who <> 'system') s ON r.conv_id IS NOT DISTINCT FROM s.conv_id),
parts AS (SELECT *, CASE WHEN train THEN '<|assistant|>' WHEN who = 'system' THEN '<|system|>' ELSE '<|user:' || who || '|>' END || chr(10) AS head, said || '<|end|>' || chr(10) AS body FROM views)
SELECT conv_id, speaker, place, CASE WHEN train THEN 'assistant' WHEN who = 'system' THEN 'system' ELSE 'user' END AS role, CASE WHEN NOT train AND who <> 'system' THEN who END AS name,
  head || body AS text, CAST(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker ORDER BY place) - length(body) AS BIGINT) AS start, length(body) AS length, train FROM parts
""",
    "op3_lm_score": r"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
total AS (SELECT sum(len(w)) AS words FROM docs),
tokens AS (SELECT d, doc_id, len(w) AS n_words, i, w[i] AS g1, CASE WHEN i > 1 THEN w[i - 1:i] END AS g2, CASE WHEN i > 2 THEN w[i - 2:i] END AS g3 FROM docs, unnest(range(1, len(w) + 1)) AS u(i)),
c1 AS (SELECT *, count(*) OVER (PARTITION BY g1) - count(*) OVER (PARTITION BY g1, d) AS n1 FROM tokens),
c2 AS (SELECT *, CASE WHEN g2 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY g2) - count(*) OVER (PARTITION BY g2, d) END AS n2 FROM c1),
c3 AS (SELECT *, CASE WHEN g3 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY g3) - count(*) OVER (PARTITION BY g3, d) END AS n3 FROM c2),
seen AS (SELECT *, lag(n1) OVER (PARTITION BY d ORDER BY i) AS p1, lag(n2) OVER (PARTITION BY d ORDER BY i) AS p2 FROM c3),
one AS (SELECT seen.*, CASE WHEN n1 > 0 THEN n1 / (words - n_words) ELSE 1 / (words - n_words + 1) END AS s1 FROM seen, total),
two AS (SELECT *, CASE WHEN i < 2 THEN s1 WHEN n2 > 0 THEN n2 / p1 ELSE 0.4 * s1 END AS s2 FROM one),
three AS (SELECT *, CASE WHEN i < 3 THEN s2 WHEN n3 > 0 THEN n3 / p2 ELSE 0.4 * s2 END AS s3 FROM two)
SELECT docs.doc_id, len(any_value(docs.w)) AS n_words, round(avg(log10(s3)), 6) AS lm_score FROM docs LEFT JOIN three USING (d) GROUP BY docs.d, docs.doc_id
""",
}
