"""Differences between the sources of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fernweft.llm.divergence import Audit, audit
from fernweft.tables import read_table

NAME = "op12_divergence"

ORACLE = """
WITH docs AS (
  SELECT row_number() OVER () AS nr, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS found
  FROM documents
), tokens AS (
  SELECT nr, lang, source, unnest(found) AS term FROM docs
), kept AS (
  SELECT lang, term FROM tokens GROUP BY lang, term HAVING count(DISTINCT nr) >= 30
), langs AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM tokens JOIN kept USING (lang, term) GROUP BY lang, source, term
), grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, l.v,
         sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS in_source,
         sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, k.term) AS in_lang,
         sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang) AS everything
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang)
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), shares AS (
  SELECT lang, source, term, n,
         1 + CAST(1000000000 * (n + 5) AS HUGEINT) // CAST(in_source + 5 * v AS HUGEINT) AS p,
         1 + CAST(1000000000 * (in_lang + 5) AS HUGEINT) // CAST(everything + 5 * v AS HUGEINT) AS q
  FROM grid
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(p.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM shares WHERE n > 0 AND p > q
)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 50
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"), Audit())
