"""The data model's tables in DuckDB SQL, for the oracles."""

NOW = 1735689600

MEMORY = """memory AS (SELECT doc_id AS id, text, source AS scope, doc_id % 50 AS session,
  ['fact', 'habit', 'episode', 'scratch'][doc_id % 4 + 1] AS tier, ['critical', 'high', 'normal', 'low'][doc_id % 7 % 4 + 1] AS importance,
  1704067200 + doc_id * 3600 AS observed_at, doc_id % 11 AS access_count, doc_id % 97 = 0 AS pinned,
  CASE WHEN doc_id % 13 = 0 THEN 1704067200 + doc_id * 3600 + 2592000 END AS valid_to,
  CASE WHEN doc_id % 17 = 0 THEN 1735689600 END AS archived_at, lang FROM documents)"""

WITNESS = """witness AS (SELECT event_id AS id, user_id AS memory,
  CASE event_type WHEN 'purchase' THEN 'imperative' WHEN 'signup' THEN 'correction' WHEN 'error' THEN 'cost' WHEN 'view' THEN 'repetition' WHEN 'click' THEN 'distillation' END AS kind,
  CASE event_type WHEN 'purchase' THEN 'user-instruction' WHEN 'signup' THEN 'user-correction' WHEN 'error' THEN 'tool-observation' WHEN 'view' THEN 'external-content' WHEN 'click' THEN 'distiller-summary' END AS channel,
  CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'signup' THEN 0.8 WHEN 'error' THEN 0.5 WHEN 'view' THEN 0.25 WHEN 'click' THEN 0.3 END::DOUBLE AS weight,
  (event_id % 20)::VARCHAR AS session,
  CASE WHEN (json_extract_string(props, '$.k')::BIGINT) % 7 < 3 THEN 'ext:' || ((json_extract_string(props, '$.k')::BIGINT) % 7)::VARCHAR END AS domain,
  floor(epoch(ts))::BIGINT AS at, value FROM events)"""

TURN = """turn_ AS (SELECT conv_id AS session, turn AS cursor, role, text, conv_id * 100000 + turn * 60 AS at,
  ceil(strlen(coalesce(text, '')) / 4.0)::BIGINT AS tokens FROM conversations)"""

SLOT = """slot AS (SELECT o_orderkey AS id, o_custkey AS subject, o_orderpriority AS predicate, o_orderstatus AS object,
  floor(epoch(o_orderdate))::BIGINT AS valid_from, o_totalprice AS weight FROM orders)"""

TOOL = """tool_row AS (SELECT l_orderkey AS session, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate)::BIGINT AS cursor, l_returnflag AS tool, l_linestatus = 'F' AS ok,
  'run ' || (l_partkey % 50)::VARCHAR AS command, 'src/' || (l_suppkey % 3)::VARCHAR || '.rs' AS path,
  trunc(l_quantity * 40)::BIGINT AS tokens, trunc(l_extendedprice)::BIGINT AS ms FROM lineitem)"""

ACTION = """action_ AS (SELECT event_id AS id, user_id AS memory,
  CASE event_type WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'reverted' END AS outcome,
  CASE event_id % 3 WHEN 0 THEN 'proximal' WHEN 1 THEN 'structural' ELSE 'explicit' END AS attribution,
  floor(epoch(ts))::BIGINT AS at, value FROM events)"""
