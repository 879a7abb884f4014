"""SQL of the core's queries."""

from __future__ import annotations

from corpusloom.plans import corpus_queries, event_queries, index_queries, retrieval_queries, text_queries

_LINKS = """
links AS (
  SELECT 'run' AS node_kind, lower(trim(run_id)) AS id, nullif(lower(trim(arg_max(coalesce(parent_run_id, ''), ingested_at))), '') AS parent FROM runs WHERE trim(run_id) <> '' GROUP BY 1, 2
  UNION ALL
  SELECT 'call', lower(trim(trace_id)), nullif(lower(trim(arg_max(coalesce(parent_trace_id, ''), ingested_at))), '') FROM llm_calls WHERE trim(trace_id) <> '' GROUP BY 1, 2
),
tree AS (
  SELECT l.node_kind, l.id, l.id AS root_id, 0 AS depth, l.id AS path FROM links l LEFT JOIN links p ON p.node_kind = l.node_kind AND p.id = l.parent WHERE p.id IS NULL
  UNION ALL
  SELECT l.node_kind, l.id, t.root_id, t.depth + 1, t.path || '/' || l.id FROM tree t JOIN links l ON l.node_kind = t.node_kind AND l.parent = t.id
)
"""

_ORPHANS = """
refs AS (
  SELECT table_name, record_id, field, target, ref, min(ingested_at) OVER (PARTITION BY table_name, record_id) AS seen, min(ts) OVER (PARTITION BY table_name, record_id) AS first_ts FROM (
    SELECT 'artifacts' AS table_name, lower(trim(artifact_id)) AS record_id, 'run_id' AS field, 'runs' AS target, lower(trim(run_id)) AS ref, ingested_at, ts FROM artifacts
    UNION ALL SELECT 'artifacts', lower(trim(artifact_id)), 'trace_id', 'llm_calls', lower(trim(trace_id)), ingested_at, ts FROM artifacts
    UNION ALL SELECT 'retrieval_events', lower(trim(retrieval_id)), 'run_id', 'runs', lower(trim(run_id)), ingested_at, ts FROM retrieval_events
    UNION ALL SELECT 'retrieval_events', lower(trim(retrieval_id)), 'trace_id', 'llm_calls', lower(trim(trace_id)), ingested_at, ts FROM retrieval_events
  ) WHERE record_id <> ''
),
parents AS (
  SELECT target, ref, min(ingested_at) AS first_at, max(ingested_at) AS last_at FROM (
    SELECT 'runs' AS target, lower(trim(run_id)) AS ref, ingested_at FROM runs UNION ALL SELECT 'llm_calls', lower(trim(trace_id)), ingested_at FROM llm_calls
  ) GROUP BY 1, 2
),
pruned AS (SELECT lower(trim(table_name)) AS target, lower(trim(record_id)) AS ref, max(pruned_at) AS pruned_at FROM prune_log GROUP BY 1, 2),
orphans AS (
  SELECT DISTINCT table_name, record_id, field, strftime(first_ts AT TIME ZONE 'UTC', '%Y-%m') AS period,
    CASE WHEN pruned_at IS NOT NULL AND (last_at IS NULL OR last_at <= pruned_at) THEN 'deleted' WHEN first_at IS NULL THEN 'missing' WHEN first_at > seen THEN 'late' END AS reason
  FROM refs LEFT JOIN parents USING (target, ref) LEFT JOIN pruned USING (target, ref) WHERE ref <> ''
)
"""

SQL: dict[str, str] = {
    "p3_found": f"""
WITH RECURSIVE {_LINKS}
SELECT l.node_kind, l.id AS node_id, coalesce(t.root_id, '') AS root_id, coalesce(t.depth, -1)::INTEGER AS depth
FROM links l LEFT JOIN tree t ON t.node_kind = l.node_kind AND t.id = l.id WHERE l.parent IS NOT NULL""",
    "p3_hierarchy": f"""
WITH RECURSIVE {_LINKS},
sizes AS (SELECT node_kind, id, count(*) - 1 AS descendants FROM (SELECT node_kind, unnest(list_transform(range(1, len(ids) + 1), lambda i: array_to_string(ids[1:i], '/'))) AS spot, ids[-1] AS leaf FROM (SELECT node_kind, string_split(path, '/') AS ids FROM tree)) JOIN (SELECT node_kind AS k, id, path FROM tree) ON k = node_kind AND path = spot GROUP BY 1, 2)
SELECT t.node_kind, t.id AS node_id, t.root_id, t.depth::INTEGER AS depth, t.path, descendants FROM tree t JOIN sizes s ON s.node_kind = t.node_kind AND s.id = t.id""",
    "p3_cycles": f"""
WITH RECURSIVE {_LINKS},
walk AS (
  SELECT node_kind, id AS start, parent AS spot, 1 AS steps, least(id, parent) AS low FROM links l WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tree t WHERE t.node_kind = l.node_kind AND t.id = l.id)
  UNION ALL
  SELECT w.node_kind, w.start, l.parent, w.steps + 1, least(w.low, l.parent) FROM walk w JOIN links l ON l.node_kind = w.node_kind AND l.id = w.spot WHERE w.spot <> w.start AND w.steps < 1000
)
SELECT node_kind, start AS node_id, low AS cycle_id, steps AS length FROM walk WHERE spot = start""",
    "p4_found": f"WITH {_ORPHANS} SELECT table_name, record_id, field, reason, period FROM orphans WHERE reason IS NOT NULL",
    "p4_snapshot": f"WITH {_ORPHANS} SELECT table_name, field, reason, period, count(*) AS orphans FROM orphans WHERE reason IS NOT NULL GROUP BY ALL",
}
SQL |= retrieval_queries.SQL | event_queries.SQL | text_queries.SQL | corpus_queries.SQL | index_queries.SQL
