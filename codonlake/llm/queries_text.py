"""Registered queries of the operators that classify or encode texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codonlake.llm import html_text, language, phrases, pieces, quality, toxicity
from codonlake.llm.shared import table


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.report(table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.report(table(spark, sf_dir, "documents"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mined(table(spark, sf_dir, "documents"))


def sentencepiece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same texts by the dealt method: the path of the best sum of the pieces' own scores."""
    return pieces.report(table(spark, sf_dir, "documents"), viterbi=True)


QUERIES = {"op4_toxicity": op4_toxicity, "op5_language_id": op5_language_id, "op7_html_text": op7_html_text, "op8_sentencepiece": op8_sentencepiece, "sentencepiece_viterbi": sentencepiece_viterbi, "op12_quality": op12_quality, "op13_phrases": op13_phrases}

OP13_SQL = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, words FROM (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS words
    FROM documents WHERE text IS NOT NULL)),
words AS (
  SELECT lang, piece, list_filter(regexp_split_to_array(words, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, 6) AS t(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
parts AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
inside AS (
  SELECT DISTINCT p.lang, array_to_string(p.w[i:i + m - 1], ' ') AS phrase, p.f
  FROM parts p, range(2, 5) AS t(m), range(1, 5) AS s(i) WHERE m < p.k AND i + m - 1 <= p.k),
kept AS (
  SELECT * FROM parts p WHERE NOT EXISTS (SELECT 1 FROM inside x WHERE x.lang = p.lang AND x.phrase = p.phrase AND 100 * x.f >= 100 * p.f)),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, n, j, (1000 * c.f * n) // (x.f * y.f) AS score
  FROM kept c JOIN totals USING (lang), range(1, 5) AS s(j), f x, f y
  WHERE j < c.k AND x.lang = c.lang AND y.lang = c.lang
    AND x.phrase = array_to_string(c.w[1:j], ' ') AND y.phrase = array_to_string(c.w[j + 1:], ' ')),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM low)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000"""
ORACLES: dict[str, str] = {"op13_phrases": OP13_SQL}
