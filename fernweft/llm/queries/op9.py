"""A mix of all documents by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fernweft.llm.mixing import Mix, plan_mix
from fernweft.tables import read_table

NAME = "op9_fair_mix"

ORACLE = """
WITH words AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS place
  FROM documents
), ranked AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source) AS rank
  FROM words GROUP BY source
), caps AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         3 * source_size AS cap, sum(source_size) OVER () AS budget
  FROM ranked
), levels AS (
  SELECT *, CAST(cap AS DOUBLE) / weight AS ratio FROM caps
), filled AS (
  SELECT *, CAST(budget - coalesce(sum(cap) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / CAST(sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM levels
), opened AS (
  SELECT ratio AS open_ratio, rank AS open_rank, level AS open_level FROM filled WHERE level <= ratio ORDER BY ratio, rank LIMIT 1
), goals AS (
  SELECT source, rank, source_size, CAST(budget AS BIGINT) AS budget,
         CASE WHEN open_rank IS NULL OR (ratio, rank) < (open_ratio, open_rank) THEN CAST(cap AS DOUBLE) ELSE open_level * weight END AS target
  FROM filled LEFT JOIN opened ON true
), lined AS (
  SELECT w.doc_id, w.source, w.size, g.source_size, g.target, g.rank, g.budget,
         row_number() OVER () AS nr,
         CAST(sum(w.size) OVER (PARTITION BY g.rank ORDER BY w.place, w.doc_id NULLS FIRST, w.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum
  FROM words w JOIN goals g ON w.source IS NOT DISTINCT FROM g.source
), queued AS (
  SELECT nr, size, budget, sum(size) OVER (ORDER BY CAST(source_size * epoch + cum AS DOUBLE) / target, rank, cum ROWS UNBOUNDED PRECEDING) AS served
  FROM lined, (SELECT unnest([0, 1, 2]) AS epoch) WHERE size > 0
), taken AS (
  SELECT nr, CAST(sum(size) AS BIGINT) AS taken FROM queued WHERE served <= budget GROUP BY nr
)
SELECT doc_id, source, size, source_size, target, coalesce(taken, 0) AS taken FROM lined LEFT JOIN taken USING (nr)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_mix(read_table(spark, sf_dir, "documents"), Mix(weights=(5, 2, 1), share=1.0, epochs=3))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "source")
