"""DuckDB SQL for the registered queries."""

from __future__ import annotations

_DOC_TYPE = (
    "CASE event_type WHEN 'error' THEN 'syslog' WHEN 'signup' THEN 'ESLogs' ELSE 'applog' END"
)
_PLUGIN = "CASE WHEN user_id % 2 = 0 THEN 'linux' ELSE 'web' END"
_EPOCH = "CAST(epoch(date_trunc('second', {})) AS BIGINT)"
_TS = _EPOCH.format("ts")

_FIELDS = f"""
  CAST(user_id AS VARCHAR) AS node, {_DOC_TYPE} AS "_documentType", {_PLUGIN} AS "_plugin",
  CAST(event_id AS VARCHAR) AS pid, 'host' || (user_id % 10) AS host, event_type AS level,
  'evt' AS ident, ts AS time, 'app' || (user_id % 5) AS "_tag_appName", props AS message
"""

_LOGS = f"WITH logs AS (SELECT event_id, {_FIELDS}, {_TS} AS timestamp FROM events) "

# Rows in result order, numbered from 1.
_NUMBERED = (
    _LOGS
    + ", numbered AS (SELECT *, CAST(row_number() OVER (ORDER BY timestamp, event_id) AS BIGINT)"
    + ' AS "offset" FROM logs) '
)

_SEARCH = (
    "CAST(time AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' "
    "AND level = 'error' AND regexp_matches(message, '69|8')"
)
_SEARCHED = (
    _LOGS
    + ", found AS (SELECT *, CAST(row_number() OVER (ORDER BY timestamp, event_id) AS BIGINT)"
    + f' AS "offset" FROM logs WHERE {_SEARCH}) '
)

_PENDING = (
    _LOGS
    + """, jobs AS (SELECT * FROM (VALUES
  ('job_a', 0, DATE '2024-01-10', DATE '2024-01-12', 3600),
  ('job_b', 3, DATE '2024-01-08', DATE '2024-01-10', 21600),
  ('job_c', 8, DATE '2024-01-01', DATE '2024-01-31', 86400))
  AS j("jobId", saved, first_day, last_day, width)),
found AS (
  SELECT "jobId", width, event_id, level, timestamp, CAST(row_number() OVER (
         PARTITION BY "jobId" ORDER BY timestamp, event_id) AS BIGINT) AS "offset"
  FROM logs JOIN jobs ON CAST(time AS DATE) BETWEEN first_day AND last_day
       AND (saved % 2 = 1 OR level = 'error')
       AND regexp_matches(message, (saved % 10) || '|' || (saved % 37 + 60))
  WHERE saved IN (SELECT p_partkey FROM part)) """
)

_SHOWN = 'event_id, level, message, timestamp'

_DAILY = f"""WITH daily AS (
  SELECT CAST(day(ts) AS BIGINT) AS day, count(*) AS n,
         min({_TS}) AS first_ts, max({_TS}) AS last_ts
  FROM events GROUP BY 1),
index AS (
  SELECT *, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) - n AS first_offset,
         CAST(sum(n) OVER (ORDER BY day) AS BIGINT) - 1 AS last_offset FROM daily) """

# A slice of the stored result: positions counted from 0 inside the slice.
_SLICE = (
    _LOGS
    + ", slice AS (SELECT *, CAST(row_number() OVER (ORDER BY timestamp, event_id) AS BIGINT) - 1"
    + " AS position, count(*) OVER () AS total,"
    + " (SELECT greatest(100, count(*) // 8) FROM events) AS size FROM logs WHERE timestamp BETWEEN {} AND {}) "
)


def _rendered(column: str) -> str:
    return (
        f"CASE WHEN date_trunc('second', {column}) = {column} "
        f"THEN strftime({column}, '%Y-%m-%d %H:%M:%S') "
        f"ELSE strftime({column}, '%Y-%m-%d %H:%M:%S.%f') END"
    )


_ENVELOPES = f"""WITH messages AS (
  SELECT *, event_id % 31 = 0 AS broken, {_DOC_TYPE} AS doc_type,
         CASE WHEN event_id % 50 <> 0 THEN {_PLUGIN} END AS plugin FROM events),
routable AS (SELECT * FROM messages WHERE plugin IS NOT NULL),
landed AS (
  SELECT CASE WHEN NOT broken THEN CAST(user_id AS VARCHAR) END AS node,
         CASE WHEN NOT broken THEN CAST(event_id AS VARCHAR) END AS pid,
         CASE WHEN NOT broken THEN 'host' || (user_id % 10) END AS host,
         CASE WHEN NOT broken THEN event_type END AS level,
         CASE WHEN NOT broken THEN ts END AS time,
         CASE WHEN NOT broken THEN 'app' || (user_id % 5) END AS "_tag_appName",
         CASE WHEN NOT broken THEN props END AS message,
         doc_type AS "_documentType", plugin AS "_plugin", event_id
  FROM routable) """

_FROM_STORE = (
    _ENVELOPES
    + f"SELECT pid, level, message, {_EPOCH.format('time')} AS timestamp FROM landed "
    + "WHERE CAST(time AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' "
    + "AND level = 'error' AND regexp_matches(message, '69|8')"
)

_INDEXED = (
    _ENVELOPES
    + ", days AS (SELECT pid, level, message, " + _EPOCH.format("time") + " AS timestamp FROM landed "
    + "WHERE CAST(time AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-12') "
    + "SELECT 'text' AS kind, * FROM days "
    + "WHERE contains(message, 'k\": 69') OR contains(message, 'k\": 7}') "
    + "UNION ALL SELECT 'pattern', * FROM days "
    + "WHERE regexp_matches(message, '^\\{\"k\": (1|4)[0-3]+|k\": 99?\\}') "
    + "UNION ALL SELECT 'no text', * FROM days WHERE regexp_matches(message, '69|8')"
)

_SIGNATURES = """WITH signatures AS (
  SELECT p_partkey, 'sig_' || p_partkey AS "signatureId", p_brand AS plugin,
         CASE WHEN p_partkey % 2 = 0 THEN 'ERROR' ELSE '*' END AS "logLevel", p_type AS "docType",
         string_split(p_name, ' ') AS words, replace(p_name, ' ', ',') AS keywords FROM part) """


def _any_word(pattern: str) -> str:
    return f"EXISTS (SELECT 1 FROM unnest(words) AS u(w) WHERE regexp_matches(w, '{pattern}'))"


_STATUS = (
    "CASE WHEN {0} = 100 THEN 'COMPLETED' WHEN {0} BETWEEN 1 AND 99 THEN 'RUNNING' "
    "WHEN {0} = 0 THEN 'NOT STARTED' WHEN {0} = 999 THEN 'FAILED' ELSE 'UNKNOWN' END"
)


def _orders_between(first: str, last: str) -> str:
    return (
        f"SELECT o_orderkey, {_EPOCH.format('o_orderdate')} AS timestamp FROM orders "
        f"WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '{first}' AND DATE '{last}'"
    )


def all_oracles() -> dict[str, str]:
    return {
        "log_query": _LOGS + f"SELECT * FROM logs WHERE {_SEARCH}",
        "log_query_default_order": _LOGS
        + "SELECT * FROM logs WHERE level = 'view' "
        + "AND CAST(time AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'",
        "log_query_any_level": _LOGS
        + "SELECT * FROM logs WHERE CAST(time AS DATE) = DATE '2024-01-10' "
        + "AND regexp_matches(message, '1|2')",
        "log_query_with_app_filter": _LOGS
        + "SELECT * FROM logs WHERE CAST(time AS DATE) BETWEEN DATE '2024-01-10' "
        + "AND DATE '2024-01-12' AND \"_tag_appName\" = 'app3' AND \"_plugin\" = 'linux' "
        + "AND \"_documentType\" = 'syslog'",
        "calendar_range_cross_year": _orders_between("1996-11-15", "1998-02-05"),
        "calendar_range_adjacent_months": _orders_between("1996-01-10", "1996-02-20"),
        "calendar_range_one_day": _orders_between("1996-02-29", "1996-02-29"),
        "calendar_range_months_apart": _orders_between("1996-02-29", "1996-08-31"),
        "level_filter": "SELECT CAST(day(ts) AS INTEGER) AS day, count(*) AS n FROM events "
        "WHERE event_type = 'purchase' GROUP BY 1",
        "keyword_regex": "SELECT doc_id, lang, n_chars FROM documents "
        "WHERE regexp_matches(text, '[0-9]{3}-[0-9]{4}|@[a-z]+|^Then')",
        "keyword_literal": "SELECT doc_id, lang FROM documents WHERE contains(text, '(c)') "
        "OR contains(text, 'que.') OR contains(text, '$')",
        "histogram": _LOGS
        + "SELECT time_bucket(INTERVAL 1 HOUR, time) AS start, "
        + "time_bucket(INTERVAL 1 HOUR, time) + INTERVAL 1 HOUR AS \"end\", count(*) AS count, "
        + "CAST(epoch(time_bucket(INTERVAL 1 HOUR, time)) AS BIGINT) AS timestamp "
        + "FROM logs WHERE level = 'error' AND regexp_matches(message, '8') GROUP BY ALL",
        "histogram_by_day": _LOGS
        + "SELECT date_trunc('day', time)::TIMESTAMP AS start, "
        + "date_trunc('day', time)::TIMESTAMP + INTERVAL 1 DAY AS \"end\", count(*) AS count, "
        + "CAST(epoch(date_trunc('day', time)) AS BIGINT) AS timestamp FROM logs GROUP BY ALL",
        "result_stats": _LOGS + f"SELECT count(*) AS value FROM logs WHERE {_SEARCH}",
        "part_metadata": _DAILY
        + 'SELECT day, n AS count, first_ts AS "startTimestamp", '
        + 'last_ts AS "endTimestamp" FROM daily',
        "running_offset_index": _DAILY
        + 'SELECT day, first_ts AS "startTimestamp", last_ts AS "endTimestamp", '
        + 'first_offset AS "startOffset", last_offset AS "endOffset" FROM index',
        "part_overlap_clip": _DAILY
        + "SELECT day, greatest(first_ts, 1704848800) AS \"startTimestamp\", "
        + "least(last_ts, 1705022600) AS \"endTimestamp\" FROM index "
        + "WHERE last_ts >= 1704848800 AND first_ts <= 1705022600",
        "part_overlap_clip_by_offset": _DAILY
        + 'SELECT day, greatest(first_offset, 250) AS "startOffset", '
        + 'least(last_offset, 700) AS "endOffset" FROM index '
        + "WHERE last_offset >= 250 AND first_offset <= 700",
        "stored_result": _NUMBERED + f'SELECT {_SHOWN}, "offset" FROM numbered',
        "stored_part_totals": _LOGS
        + "SELECT count(*) AS n, min(timestamp) AS first_timestamp, "
        + "max(timestamp) AS last_timestamp FROM logs",
        "stored_parts_match_index": "SELECT count(*) AS n, true AS same FROM events",
        "named_parts_match_index": "SELECT true AS same",
        "offset_page": _NUMBERED
        + f'SELECT {_SHOWN}, "offset" FROM numbered WHERE "offset" BETWEEN 290 AND 610',
        "offset_page_of_shipments": "SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, "
        f"l_suppkey, l_quantity, {_EPOCH.format('l_shipdate')} AS timestamp, "
        "CAST(row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, "
        'l_suppkey, l_quantity) AS BIGINT) AS "offset" FROM lineitem) '
        'WHERE "offset" BETWEEN 2901 AND 4100',
        "time_slice": _LOGS
        + f"SELECT {_SHOWN} FROM logs WHERE timestamp BETWEEN 1704844800 AND 1705017600",
        "time_page": _SLICE.format(1704844800, 1705017600)
        + f'SELECT {_SHOWN}, position + 1 AS "offset", total FROM slice '
        + "WHERE position BETWEEN 10 AND 59",
        "saved_slice_page": _SLICE.format(1704844800, 1704844800 + 864000)
        + f'SELECT {_SHOWN}, position + 1 AS "offset", total FROM slice '
        + "WHERE position BETWEEN 94 AND 1399",
        "fixed_chunks": _SLICE.format(1704067200, 1706745599)
        + "SELECT position // size AS chunk_id, count(*) AS n, "
        + 'min(position) AS "startOffset", max(position) AS "endOffset", '
        + "min(timestamp) AS first_timestamp FROM slice GROUP BY 1",
        "chunk_index": _SLICE.format(1704067200, 1706745599)
        + "SELECT 'chunk_id=' || (position // size) AS \"partName\", "
        + 'min(position) AS "startOffset", max(position) AS "endOffset" FROM slice GROUP BY 1',
        "chunks_by_number": _SLICE.format(1704067200, 1706745599)
        + f"SELECT {_SHOWN}, position, position // size AS chunk_id FROM slice "
        + "WHERE position // size BETWEEN 1 AND 2",
        "browse_whole_result": _SEARCHED
        + f'SELECT event_id, level, {_rendered("time")} AS time, "offset", '
        + "count(*) OVER () AS total FROM found",
        "browse_by_time": _SEARCHED
        + ', slice AS (SELECT *, row_number() OVER (ORDER BY "offset") AS position, '
        + "count(*) OVER () AS total FROM found "
        + "WHERE timestamp BETWEEN 1704844800 AND 1704844800 + 43200) "
        + f'SELECT event_id, level, {_rendered("time")} AS time, '
        + 'CAST(position AS BIGINT) AS "offset", total FROM slice WHERE position BETWEEN 2 AND 9',
        "run_signature": _SEARCHED
        + "SELECT 'job_9' AS \"jobId\", 'LogQuery' AS type, count(*) AS \"totalRowCount\" "
        + "FROM found UNION ALL SELECT 'job_9', 'Histogram', "
        + "count(DISTINCT time_bucket(INTERVAL 1 HOUR, time)) FROM found",
        "run_signatures_shared": _PENDING
        + 'SELECT "jobId", event_id, level, timestamp, "offset" FROM found',
        "run_signatures_shared_histograms": _PENDING
        + ", buckets AS (SELECT \"jobId\", timestamp // width * width AS timestamp, count(*) AS count "
        + 'FROM found GROUP BY 1, 2) SELECT "jobId", count, timestamp, CAST(row_number() OVER ('
        + 'PARTITION BY "jobId" ORDER BY timestamp) AS BIGINT) AS "offset" FROM buckets',
        "run_signature_histogram": _SEARCHED
        + ", buckets AS (SELECT time_bucket(INTERVAL 1 HOUR, time) AS start, count(*) AS count "
        + "FROM found GROUP BY 1), numbered AS (SELECT *, "
        + 'CAST(row_number() OVER (ORDER BY start) AS BIGINT) AS "offset" FROM buckets) '
        + f'SELECT {_rendered("start")} AS start, {_rendered("(start + INTERVAL 1 HOUR)")} '
        + 'AS "end", count, CAST(epoch(start) AS BIGINT) AS timestamp, "offset" '
        + 'FROM numbered WHERE "offset" BETWEEN 3 AND 30',
        "stored_histogram": _LOGS
        + ", buckets AS (SELECT time_bucket(INTERVAL 6 HOUR, time) AS start, count(*) AS count "
        + "FROM logs GROUP BY 1) SELECT count, CAST(epoch(start) AS BIGINT) AS timestamp, "
        + 'CAST(row_number() OVER (ORDER BY start) AS BIGINT) AS "offset" FROM buckets',
        "decode_signatures": _SIGNATURES
        + 'SELECT "signatureId", "logLevel", CAST(len(words) AS BIGINT) AS n_keywords, '
        + "words[1] AS first_keyword FROM signatures",
        "signature_search": _SIGNATURES
        + 'SELECT "signatureId", plugin, "logLevel", "docType", keywords FROM signatures '
        + f"WHERE regexp_matches(\"signatureId\", '7$') OR {_any_word('^red$')}",
        "signature_search_by_keyword": _SIGNATURES
        + 'SELECT "signatureId", keywords FROM signatures '
        + f"WHERE {_any_word('^bo|ring')}",
        "signature_search_all": _SIGNATURES + 'SELECT "signatureId" FROM signatures',
        "signature_page": _SIGNATURES
        + ", found AS (SELECT \"signatureId\", row_number() OVER (ORDER BY "
        + "CASE WHEN regexp_matches(\"signatureId\", '5$') THEN 0 ELSE 1 END, p_partkey DESC) "
        + "AS place, count(*) OVER () AS total FROM signatures "
        + f"WHERE regexp_matches(\"signatureId\", '5$') OR {_any_word('red')}) "
        + 'SELECT "signatureId", total FROM found WHERE place BETWEEN 11 AND 60',
        "signature_page_deep": _SIGNATURES
        + ", found AS (SELECT \"signatureId\", row_number() OVER (ORDER BY "
        + "CASE WHEN regexp_matches(\"signatureId\", '5$') THEN 0 ELSE 1 END, p_partkey DESC) "
        + "AS place, count(*) OVER () AS total FROM signatures "
        + f"WHERE regexp_matches(\"signatureId\", '5$') OR {_any_word('red')}) "
        + 'SELECT "signatureId", total FROM found WHERE place >= total - 24',
        "signature_lookup": _SIGNATURES
        + 'SELECT "signatureId", plugin, "docType", keywords FROM signatures '
        + "WHERE \"signatureId\" = 'sig_42'",
        "run_signature_matches": "SELECT p_partkey FROM part WHERE regexp_matches(p_name, "
        "(SELECT replace(p_name, ' ', '|') FROM part WHERE p_partkey = 4))",
        "job_listing": "SELECT 'job_' || o_orderkey AS \"jobId\", "
        "'run ' || o_orderstatus || (o_orderkey % 10) AS \"jobName\", "
        'o_orderpriority AS "appName", o_orderkey % 1000 AS percentage, '
        f"{_STATUS.format('(o_orderkey % 1000)')} AS status, "
        f"{_STATUS.format('(o_orderkey % 101)')} AS histogram_status, "
        "'sig_' || o_custkey AS \"signatureId\", CAST(1704844800 AS BIGINT) AS \"startTime\", "
        "CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS n, "
        f"{_EPOCH.format('o_orderdate')} AS created FROM orders "
        "WHERE o_orderpriority = '2-HIGH' AND o_orderstatus IN ('F', 'O') "
        "AND o_orderkey % 10 <= 4",
        "job_status_counts": f"SELECT {_STATUS.format('(o_orderkey % 1000)')} AS status, "
        "count(*) AS n FROM orders GROUP BY 1",
        "job_stored_statistics": _LOGS
        + "SELECT 'job_' || o_orderkey AS \"jobId\", CASE WHEN o_orderkey % 3 = 0 THEN o_custkey "
        + "WHEN o_orderkey % 1000 <> 100 THEN NULL "
        + f"WHEN o_orderkey = 100 THEN (SELECT count(*) FROM logs WHERE {_SEARCH}) "
        + "WHEN o_orderkey = 1100 THEN (SELECT count(*) FROM logs) ELSE 0 END AS n FROM orders",
        "job_listing_with_statistics": _LOGS
        + "SELECT 'job_' || o_orderkey AS \"jobId\", CASE WHEN o_orderkey % 3 = 0 THEN o_custkey "
        + "WHEN o_orderkey % 1000 <> 100 THEN NULL "
        + f"WHEN o_orderkey = 100 THEN (SELECT count(*) FROM logs WHERE {_SEARCH}) ELSE 0 END AS n, "
        + "CASE WHEN o_orderkey % 101 <> 100 THEN NULL WHEN o_orderkey = 201 "
        + "THEN (SELECT count(DISTINCT timestamp // 3600) FROM logs) ELSE 0 END AS n_buckets "
        + "FROM orders",
        "envelope_parse": _ENVELOPES
        + 'SELECT doc_type AS "_documentType", plugin AS "_plugin", count(*) AS n, '
        + "count(*) AS messages, count(*) FILTER (WHERE plugin IS NULL) AS unroutable "
        + "FROM messages GROUP BY ALL",
        "distinct_routing_keys": _ENVELOPES
        + 'SELECT DISTINCT doc_type AS "_documentType", plugin AS "_plugin" FROM messages',
        "routed_split": _ENVELOPES
        + "SELECT branch, count(*) AS n FROM (SELECT CASE doc_type || '.' || plugin "
        + "WHEN 'syslog.linux' THEN 'syslog.linux' WHEN 'ESLogs.web' THEN 'ESLogs.web' "
        + "ELSE 'default' END AS branch FROM routable) GROUP BY 1",
        "routed_parse": _ENVELOPES
        + ", keyed AS (SELECT *, \"_documentType\" = 'ESLogs' AND \"_plugin\" = 'web' AS yarn "
        + "FROM landed) SELECT node, CASE WHEN NOT yarn THEN pid END AS pid, level, time, "
        + 'message, "_tag_appName", CASE WHEN NOT yarn THEN host END AS host, '
        + 'CAST(NULL AS VARCHAR) AS "yarnContainer", "_documentType", "_plugin" FROM keyed',
        "event_calendar": _ENVELOPES
        + "SELECT CAST(year(time) AS INTEGER) AS year, CAST(month(time) AS INTEGER) AS month, "
        + "CAST(day(time) AS INTEGER) AS day, count(*) AS n FROM landed GROUP BY ALL",
        "ingest_stream": _ENVELOPES
        + 'SELECT node, pid, level, time, message, "_tag_appName", "_documentType", "_plugin", '
        + "CAST(year(time) AS INTEGER) AS year, CAST(month(time) AS INTEGER) AS month, "
        + "CAST(day(time) AS INTEGER) AS day FROM landed",
        "ingest_layouts": _ENVELOPES
        + 'SELECT "_documentType", "_plugin", count(*) AS n, '
        + "CASE \"_documentType\" WHEN 'applog' THEN 'default' ELSE \"_documentType\" END "
        + "AS layout FROM landed GROUP BY ALL",
        "ingest_dead_letters": _ENVELOPES
        + 'SELECT doc_type AS "_documentType", plugin AS "_plugin", count(*) AS n, '
        + "count(*) AS kept FROM messages WHERE plugin IS NULL GROUP BY ALL",
        "ingest_malformed": _ENVELOPES
        + 'SELECT doc_type AS "_documentType", plugin AS "_plugin", count(*) AS n, '
        + "'not json' AS text FROM routable WHERE broken GROUP BY ALL",
        "ingest_replay": _ENVELOPES
        + 'SELECT "_documentType", count(*) AS n FROM landed GROUP BY 1',
        "rollup_histogram": _ENVELOPES
        + f"SELECT count(*) AS count, {_EPOCH.format('time')} // 7200 * 7200 AS timestamp "
        + "FROM landed WHERE CAST(time AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' "
        + "AND level = 'error' GROUP BY 2",
        "rollup_histogram_by_origin": _ENVELOPES
        + f"SELECT count(*) AS count, {_EPOCH.format('time')} // 86400 * 86400 AS timestamp "
        + "FROM landed WHERE CAST(time AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' "
        + "AND \"_tag_appName\" = 'app3' AND \"_plugin\" = 'linux' GROUP BY 2",
        "store_log_query": _FROM_STORE,
        "compacted_log_query": _FROM_STORE,
        "mixed_log_query": _FROM_STORE,
        "keyword_indexed": _INDEXED,
        "mixed_store_rows": _ENVELOPES
        + 'SELECT "_documentType", CAST(year(time) AS INTEGER) AS year, '
        + "CAST(month(time) AS INTEGER) AS month, CAST(day(time) AS INTEGER) AS day, "
        + "count(*) AS n, count(message) AS messages FROM landed GROUP BY ALL",
        "ingest_partial_batch": _ENVELOPES
        + ', states AS (SELECT \'before\' AS state, * FROM landed WHERE event_id % 2 = 0 '
        + "UNION ALL SELECT 'after' AS state, * FROM landed) "
        + 'SELECT state, "_documentType", count(*) AS n, count(message) AS messages '
        + "FROM states GROUP BY ALL",
        "rendered_times": f"SELECT event_id, {_rendered('ts')} AS time, "
        f"{_rendered('date_trunc(' + chr(39) + 'hour' + chr(39) + ', ts)')} AS start FROM events",
        "part_basename": "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS name FROM orders",
    }
