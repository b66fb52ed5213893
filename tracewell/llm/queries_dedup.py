"""Queries op3 and op9 over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewell.llm.substrings import drop_repeats

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = drop_repeats(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewell.llm.jaccard import jaccard_join

    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_WORDS = r"""w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents)"""

OP3_SQL = f"""
WITH RECURSIVE {_WORDS}, s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS g FROM w
), u AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS m FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (SELECT a, b FROM c WHERE 5 * m >= 4 * (na + nb - m)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
k AS (SELECT doc_id, min(c) AS class_id FROM r GROUP BY doc_id), d AS (SELECT a AS doc_id, count(*) AS n_links FROM e GROUP BY a)
SELECT s.doc_id, class_id, CASE WHEN len(g) = 0 THEN s.doc_id ELSE min(s.doc_id) OVER (PARTITION BY g) END AS copy_id, coalesce(n_links, 0) AS n_links
FROM s JOIN k ON k.doc_id = s.doc_id LEFT JOIN d ON d.doc_id = s.doc_id
"""

OP9_SQL = f"""
WITH {_WORDS}, p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i:i + 19], ' ') ORDER BY doc_id, i) AS r FROM p),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM f WHERE r > 1),
pos AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
kept AS (SELECT pos.doc_id, string_agg(word, ' ' ORDER BY pos.j) AS t, count(*) AS n FROM pos ANTI JOIN gone ON pos.doc_id = gone.doc_id AND pos.j = gone.j GROUP BY pos.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""
