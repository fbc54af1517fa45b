"""Registered queries of the operators on conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codonlake.llm import prefix_trie
from codonlake.llm.shared import table


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_report(table(spark, sf_dir, "conversations"))


QUERIES = {"op11_prefix_trie": op11_prefix_trie}

OP11_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, r, x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(CAST(length(r) AS VARCHAR) || ':' || r || x)) - 1 AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
crc AS (
  SELECT c, c - c % 20 AS head, xor(list_reduce(
      list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda acc, v: CASE WHEN v >= 0 THEN xor(acc, v) WHEN acc % 2 = 1 THEN xor(acc >> 1, CAST(3988292384 AS BIGINT)) ELSE acc >> 1 END), CAST(4294967295 AS BIGINT)) % 4 AS h
  FROM (SELECT DISTINCT c FROM t)),
own AS (
  SELECT crc.c, 0 AS part, t.pos, t.r, t.x FROM crc JOIN t ON t.c = crc.head WHERE t.pos < crc.h
  UNION ALL SELECT crc.c, 1, t.pos, t.r, t.x FROM crc JOIN t ON t.c = crc.c WHERE t.pos >= crc.h),
numbered AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS i, r, x FROM own),
lists AS (SELECT crc.c, coalesce(list({'r': r, 'x': x} ORDER BY i) FILTER (WHERE i IS NOT NULL), []) AS s FROM crc LEFT JOIN numbered USING (c) GROUP BY crc.c),
pre AS (SELECT c, d, s[1:d] AS p, d = len(s) AS ends, CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(s[d].x, '[^\x20\x09-\x0D]+')) END AS w FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM lists)),
nodes AS (
  SELECT p, d, min(c) AS conv_id, count(*) AS n, min(w) AS w, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM pre GROUP BY p, d),
kids AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (p, d)),
sub AS (
  SELECT p[1:e] AS p, e AS d, sum((n - 1) * w) AS saved, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves
  FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM full_nodes) GROUP BY ALL)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(f.n AS BIGINT) AS n_convs, CAST(f.n_children AS BIGINT) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN sub USING (p, d) LEFT JOIN nodes up ON up.d = f.d - 1 AND up.p = f.p[1:f.d - 1]"""

ORACLES: dict[str, str] = {"op11_prefix_trie": OP11_SQL}
