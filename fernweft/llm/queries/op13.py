"""Spellings in all documents, with planted errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fernweft.llm.variants import Spelling, group_spellings
from fernweft.tables import read_table

NAME = "op13_spellings"

ORACLE = """
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS keyed, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{C0}-\\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL
), crc AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
), hashed AS (
  SELECT run, n, xor(list_reduce(
           list_prepend(4294967295, list_transform(range(0, length(hex(encode(keyed))), 2), lambda i: CAST('0x' || substr(hex(encode(keyed)), i + 1, 2) AS BIGINT))),
           lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295) AS h
  FROM runs, crc
), spelled AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelled WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cut AS (
  SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN cut b ON a.word = b.rest
  UNION SELECT b.word, a.word, a.n FROM words a JOIN cut b ON a.word = b.rest
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word
), judged AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form, CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS root, form AS next FROM judged
  UNION ALL SELECT c.word, j.word, j.form FROM chain c JOIN judged j ON c.next = j.word
)
SELECT j.word, j.form, c.root, j.n, j.n_near, j.form_n FROM judged j JOIN chain c ON c.word = j.word AND c.next IS NULL
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(read_table(spark, sf_dir, "documents"), Spelling(misspell=31))
