"""DuckDB SQL of the llm queries that SQL can express."""

from __future__ import annotations

P1_FOUND = """
WITH pairs AS (
  SELECT f.fixture_id, r.feed_id, abs(epoch_us(f.match_date) - epoch_us(r.match_date)) AS d
  FROM fixture_list f JOIN match_feed r
    ON f.home_team_id = r.home_team_id AND f.away_team_id = r.away_team_id
   AND r.match_date BETWEEN f.match_date - INTERVAL 6 HOUR AND f.match_date + INTERVAL 6 HOUR)
SELECT fixture_id, arg_min(feed_id, (d, feed_id)) AS feed_id FROM pairs GROUP BY fixture_id
"""

P4_FOUND = """
WITH RECURSIVE keyed AS (
  SELECT object_type,
    left_provider || ':' || CAST(CAST(CAST(trim(left_object_id) AS DOUBLE) AS BIGINT) AS VARCHAR) AS a,
    right_provider || ':' || CAST(CAST(CAST(trim(right_object_id) AS DOUBLE) AS BIGINT) AS VARCHAR) AS b
  FROM id_links),
edges AS (
  SELECT object_type, a, b FROM keyed WHERE a IS NOT NULL AND b IS NOT NULL
  UNION SELECT object_type, b, a FROM keyed WHERE a IS NOT NULL AND b IS NOT NULL),
nodes AS (
  SELECT object_type, a AS n FROM keyed WHERE a IS NOT NULL UNION SELECT object_type, b FROM keyed WHERE b IS NOT NULL),
walk AS (
  SELECT object_type, n AS node_key, n AS g FROM nodes
  UNION
  SELECT e.object_type, e.b, w.g FROM walk w JOIN edges e ON e.object_type = w.object_type AND e.a = w.node_key AND w.g < e.b)
SELECT object_type, node_key, min(g) AS group_key FROM walk GROUP BY object_type, node_key
"""

# The texts in these tables that are no names, found by reading them; the operator has no such list.
P3_FOUND = r"""
WITH s AS (SELECT *, trim(lower(regexp_replace(regexp_replace(player_name,'[\p{Cf}\p{Cc}]','','g'),'[\s\p{Z}]+',' ','g'))) t0 FROM squad_versions WHERE person_id IS NOT NULL),
s2 as (select *, trim(regexp_replace(t0,'^<(.*)>$','\1')) t from s),
claims AS (
  SELECT person_id, version_id, data_provider, updated_at, 'player_name' AS field_name,
    coalesce(regexp_matches(t, '\p{L}') AND t NOT IN ('none', 'null', 'n/a', 'nn', 'xxx', 'tbc', 'unknown', 'unknown player', 'no name', '(no name)', 'test player', '-', '.', '???', '') AND NOT regexp_matches(t, '[0-9]'), FALSE) AS usable FROM s2
  UNION ALL SELECT person_id, version_id, data_provider, updated_at, 'birth_date', coalesce(year(try_strptime(trim(birth_date), '%Y-%m-%d')) BETWEEN 1971 AND 2010, FALSE) FROM s
  UNION ALL SELECT person_id, version_id, data_provider, updated_at, 'jersey_number', coalesce(regexp_full_match(trim(jersey_number), '0*[1-9][0-9]?'), FALSE) FROM s),
many AS (SELECT person_id FROM squad_versions WHERE person_id IS NOT NULL GROUP BY person_id HAVING count(*) >= 2)
SELECT person_id, field_name, version_id FROM (
  SELECT c.*, row_number() OVER (PARTITION BY person_id, field_name ORDER BY r.trust_rank NULLS LAST, updated_at DESC NULLS LAST, version_id DESC) AS n
  FROM claims c JOIN many USING (person_id) LEFT JOIN provider_ranks r USING (field_name, data_provider) WHERE usable) WHERE n = 1
"""

ORACLE = {"p1_found": P1_FOUND, "p3_found": P3_FOUND, "p4_found": P4_FOUND}
