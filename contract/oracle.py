"""The same queries in SQL, for a run on the same Parquet tables by another engine."""

from __future__ import annotations

from contract.queries import CUT, CUTS, DELIVERIES, ORDER_CUTS, PIPELINE, SOURCE, YEAR

END = "TIMESTAMP '9999-12-31 00:00:00'"
JSON_TIME = "'%Y-%m-%dT%H:%M:%S.%f'"

EVENTS = f"""
e AS (
  SELECT CASE WHEN event_type = 'signup' THEN 'I' ELSE 'U' END AS op, ts AS event_ts, user_id AS customer_id,
         'customer_' || CAST(user_id AS VARCHAR) AS name, event_type AS status, ts AS updated_at,
         '{SOURCE}' AS source, event_id AS seq
  FROM events
)"""

MESSAGE = "op, event_ts, customer_id, name, status, updated_at, source, seq"
DIMENSION = "customer_id, name, status, business_key, hashdiff, effective_from, effective_to, is_current, updated_at"


def framed(*columns: str) -> str:
    parts = [f"coalesce(CAST(length({c}) AS VARCHAR) || ':' || {c}, '~')" for c in columns]
    return f"sha256({' || '.join(parts)})"


def staged(name: str, where: str) -> str:
    """The latest change per customer among some events."""
    return f"""
{name} AS (
  SELECT customer_id, name, status, updated_at, CAST(customer_id AS VARCHAR) AS business_key,
         {framed('name', 'status')} AS hashdiff
  FROM e WHERE {where}
  QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY updated_at DESC, seq DESC) = 1
)"""


def versions(source: str, key: str, tracked: tuple[str, ...], time: str, ties: tuple[str, ...], batch: str) -> str:
    """History from all changes: last per batch, drop repeats, next change ends the version."""
    descending = ", ".join(f"{c} DESC" for c in (time, *ties, *tracked))
    names = ", ".join((key, *tracked))
    return f"""
last_of_batch AS (
  SELECT {names}, {time}, CAST({key} AS VARCHAR) AS business_key, {framed(*tracked)} AS hashdiff
  FROM {source}
  QUALIFY row_number() OVER (PARTITION BY {key}, {batch} ORDER BY {descending}) = 1
), compared AS (
  SELECT *, lag(hashdiff) OVER (PARTITION BY {key} ORDER BY {time}) AS previous FROM last_of_batch
), changed AS (
  SELECT * FROM compared WHERE previous IS NULL OR previous <> hashdiff
), followed AS (
  SELECT *, lead({time}) OVER (PARTITION BY {key} ORDER BY {time}) AS following FROM changed
), dimension AS (
  SELECT {names}, business_key, hashdiff, {time} AS effective_from, coalesce(following, {END}) AS effective_to,
         following IS NULL AS is_current, {time}
  FROM followed
)"""


def event_versions(batch: str) -> str:
    return f"WITH {EVENTS}, {versions('e', 'customer_id', ('name', 'status'), 'updated_at', ('seq',), batch)}"


DAILY = event_versions("CAST(updated_at AS DATE)")
BY_CUTS = event_versions(
    f"CASE WHEN updated_at < TIMESTAMP '{CUTS[0]}' THEN 0 WHEN updated_at < TIMESTAMP '{CUTS[1]}' THEN 1 ELSE 2 END"
)
BY_CUT = event_versions(f"updated_at < TIMESTAMP '{CUT}'")
ORDER_VERSIONS = versions(
    "orders", "o_custkey", ("o_orderstatus", "o_orderpriority"), "o_orderdate", ("o_orderkey",), "o_orderdate"
)
LINE_VERSIONS = versions(
    "lineitem",
    "l_partkey",
    ("l_returnflag", "l_linestatus"),
    "l_shipdate",
    ("l_orderkey", "l_linenumber"),
    "l_shipdate",
)
ORDERS_BY_BATCH = versions(
    "orders",
    "o_custkey",
    ("o_orderstatus", "o_orderpriority"),
    "o_orderdate",
    ("o_orderkey",),
    " + ".join(f"CAST(o_orderdate >= TIMESTAMP '{cut}' AS INTEGER)" for cut in ORDER_CUTS),
)
LINES_BY_YEAR = versions(
    "lineitem", "l_partkey", ("l_returnflag", "l_linestatus"), "l_shipdate", ("l_orderkey", "l_linenumber"), "year(l_shipdate)"
)
BY_DELIVERY = event_versions(f"seq * {DELIVERIES} // ((SELECT max(seq) FROM e) + 1)")
WITH_DELETES = f"""WITH {EVENTS}, last_of_batch AS (
  SELECT customer_id, name, status, updated_at, CAST(customer_id AS VARCHAR) AS business_key,
         CASE WHEN status <> 'error' THEN {framed('name', 'status')} END AS hashdiff
  FROM e
  QUALIFY row_number() OVER (
    PARTITION BY customer_id, updated_at < TIMESTAMP '{CUTS[0]}', updated_at < TIMESTAMP '{CUTS[1]}'
    ORDER BY updated_at DESC, seq DESC) = 1
), compared AS (
  SELECT *, lag(hashdiff) OVER w AS previous, row_number() OVER w AS place FROM last_of_batch
  WINDOW w AS (PARTITION BY customer_id ORDER BY updated_at)
), followed AS (
  SELECT *, lead(updated_at) OVER (PARTITION BY customer_id ORDER BY updated_at) AS following
  FROM compared WHERE place = 1 OR previous IS DISTINCT FROM hashdiff
), dimension AS (
  SELECT customer_id, name, status, business_key, hashdiff, updated_at AS effective_from,
         coalesce(following, {END}) AS effective_to, following IS NULL AS is_current, updated_at
  FROM followed WHERE hashdiff IS NOT NULL
)"""
GOLD = """
SELECT CAST(effective_from AS DATE) AS day, status AS customer_status, count(DISTINCT customer_id) AS cnt
FROM {source} WHERE is_current GROUP BY 1, 2"""

AROUND_CUT = f"""WITH {EVENTS}, {staged('old', f"updated_at < TIMESTAMP '{CUT}'")},
{staged('new', f"updated_at >= TIMESTAMP '{CUT}'")}"""


def hashed(label: str) -> str:
    return f"CAST('0x' || substr(md5('7:{label}:' || CAST(o_orderkey AS VARCHAR)), 1, 15) AS BIGINT)"


def order_stage(where: str) -> str:
    return f"""
  SELECT o_custkey, o_orderstatus, o_orderpriority, o_orderdate, CAST(o_custkey AS VARCHAR) AS business_key,
         {framed('o_orderstatus', 'o_orderpriority')} AS hashdiff
  FROM orders WHERE {where}
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"""


def mart_by_mode() -> str:
    def mart(name: str, source: str) -> str:
        return f"""{name} AS (
  SELECT CAST(updated_at AS DATE) AS day, status AS customer_status, count(DISTINCT customer_id) AS cnt
  FROM {source} GROUP BY 1, 2)"""

    return f"""WITH {EVENTS}, {staged('old', f"updated_at < TIMESTAMP '{CUT}'")}, {staged('whole', 'TRUE')},
{mart('mart_before', 'old')}, {mart('mart_after', 'whole')}
SELECT day, customer_status, cnt, 'full' AS mode FROM mart_after
UNION ALL SELECT day, customer_status, cnt, 'partitions' FROM mart_after
UNION ALL SELECT day, customer_status, cnt, 'partitions' FROM mart_before
WHERE day NOT IN (SELECT day FROM mart_after)"""


ORACLE_SQL: dict[str, str] = {
    "cdc_generate": f"""
WITH drawn AS (
  SELECT o_orderkey AS seq, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS event_ts,
         {hashed('id')} % 200 + 1 AS customer_id,
         list_extract(['active', 'inactive', 'vip'], {hashed('status')} % 3 + 1) AS status,
         list_extract(['I', 'U'], {hashed('op')} % 2 + 1) AS op
  FROM orders
)
SELECT op, event_ts, customer_id, 'customer_' || CAST(customer_id AS VARCHAR) AS name, status,
       event_ts AS updated_at, 'demo-generator' AS source, seq
FROM drawn""",
    "cdc_to_json": f"""
WITH {EVENTS}
SELECT '{{"op":"' || op || '","event_ts":"' || strftime(event_ts, {JSON_TIME}) || '","customer_id":'
       || CAST(customer_id AS VARCHAR) || ',"name":"' || name || '","status":"' || status || '","updated_at":"'
       || strftime(updated_at, {JSON_TIME}) || '","source":"' || source || '","seq":' || CAST(seq AS VARCHAR)
       || '}}' AS value
FROM e""",
    "cdc_parse_json": f"WITH {EVENTS} SELECT {MESSAGE} FROM e",
    "cdc_parse_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events",
    "cdc_parse_timestamps": """
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE ts END AS parsed FROM events""",
    "cdc_rejects": """
WITH judged AS (
  SELECT CASE WHEN o_orderstatus = 'O' THEN 'accepted'
              WHEN o_orderpriority IN ('1-URGENT', '3-MEDIUM') THEN 'malformed'
              WHEN o_orderpriority = '2-HIGH' THEN 'null_message'
              WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'missing_customer_id'
              ELSE 'bad_updated_at' END AS reason, o_custkey
  FROM orders
)
SELECT reason, count(*) AS cnt,
       count(*) FILTER (WHERE reason NOT IN ('accepted', 'null_message')) AS raw_texts,
       CAST(sum(o_custkey) FILTER (WHERE reason = 'accepted') AS BIGINT) AS accepted_ids
FROM judged GROUP BY reason""",
    "bronze_by_day": "SELECT CAST(ts AS DATE) AS updated_day, count(*) AS cnt FROM events GROUP BY 1",
    "bronze_stream_ingest": f"WITH {EVENTS} SELECT {MESSAGE}, CAST(updated_at AS DATE) AS updated_day FROM e",
    "bronze_replay_proof": f"WITH {EVENTS} SELECT {MESSAGE} FROM e",
    "quarantine_replay": """
WITH judged AS (
  SELECT CASE WHEN o_orderstatus = 'O' THEN 'accepted'
              WHEN o_orderpriority IN ('1-URGENT', '3-MEDIUM') THEN 'malformed'
              WHEN o_orderpriority = '2-HIGH' THEN 'null_message'
              WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'missing_customer_id'
              ELSE 'missing_name' END AS reason, o_custkey
  FROM orders
)
SELECT reason, count(*) AS cnt, CAST(sum(o_custkey) FILTER (WHERE reason = 'accepted') AS BIGINT) AS ids
FROM judged GROUP BY reason""",
    "watermark_current": "SELECT event_type AS pipeline, max(ts) AS updated_at_gte FROM events GROUP BY 1",
    "watermark_of_pipeline": f"""
SELECT event_id AS seq, user_id AS customer_id, event_type AS status, ts AS updated_at FROM events
WHERE ts >= (SELECT max(ts) FROM events WHERE event_type = 'click' AND ts < TIMESTAMP '{CUT}')""",
    "scd2_history_batches": """
WITH e AS (
  SELECT event_id AS seq, user_id AS customer_id, 'customer_' || CAST(user_id AS VARCHAR) AS name, event_type AS status,
         CAST(date_trunc('day', ts) AS TIMESTAMP) AS updated_at, event_id // 150 AS batch
  FROM events
), last AS (
  SELECT *, CAST(customer_id AS VARCHAR) AS business_key, %s AS hashdiff FROM e
  QUALIFY row_number() OVER (PARTITION BY customer_id, batch ORDER BY updated_at DESC, seq DESC) = 1
), compared AS (
  SELECT *, lag(hashdiff) OVER w AS previous FROM last WINDOW w AS (PARTITION BY customer_id ORDER BY updated_at, seq)
), followed AS (
  SELECT *, lead(updated_at) OVER w AS following FROM compared WHERE previous IS NULL OR previous <> hashdiff
  WINDOW w AS (PARTITION BY customer_id ORDER BY updated_at, seq)
)
SELECT customer_id, name, status, business_key, hashdiff, updated_at AS effective_from,
       coalesce(following, %s) AS effective_to, following IS NULL AS is_current, updated_at
FROM followed""" % (framed("name", "status"), END),
    "watermark_advance": f"""
SELECT '{PIPELINE}' AS pipeline, max(ts) AS updated_at_gte FROM events WHERE ts < TIMESTAMP '{CUT}'
UNION ALL SELECT '{PIPELINE}', max(ts) FROM events WHERE ts >= TIMESTAMP '{CUT}'""",
    "incremental_read": f"""
SELECT event_id AS seq, user_id AS customer_id, event_type AS status, ts AS updated_at FROM events
WHERE ts >= (SELECT max(ts) FROM events WHERE ts < TIMESTAMP '{CUT}')""",
    "dedupe_latest": f"""
WITH {EVENTS} SELECT {MESSAGE} FROM e
QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY updated_at DESC, seq DESC) = 1""",
    "dedupe_latest_ties": """
SELECT * FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
    "scd2_stage": f"""
WITH {EVENTS}, {staged('new', 'TRUE')}
SELECT *, sha256(concat_ws('||', name, status)) AS hashdiff_compat FROM new""",
    "scd2_changed_keys": f"""
{AROUND_CUT} SELECT new.* FROM new JOIN old USING (business_key) WHERE new.hashdiff <> old.hashdiff""",
    "scd2_new_keys": f"""
WITH old AS ({order_stage("o_orderdate < TIMESTAMP '1996-01-01 00:00:00'")}
), new AS ({order_stage("o_orderdate >= TIMESTAMP '1996-01-01 00:00:00'")}
)
SELECT new.* FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.business_key = new.business_key)""",
    "scd2_merge_step": f"{BY_CUT} SELECT {DIMENSION} FROM dimension",
    "scd2_merge_source": f"""
{AROUND_CUT}, opened AS (
  SELECT customer_id, name, status, business_key, hashdiff, updated_at AS effective_from, {END} AS effective_to,
         TRUE AS is_current, updated_at
  FROM new
)
SELECT *, business_key AS merge_key FROM opened
UNION ALL
SELECT opened.*, NULL AS merge_key FROM opened JOIN old USING (business_key) WHERE opened.hashdiff <> old.hashdiff""",
    "scd2_incremental": f"{BY_CUTS} SELECT {DIMENSION} FROM dimension",
    "scd2_stream_upsert": f"{BY_CUTS} SELECT {DIMENSION} FROM dimension",
    "scd2_late_changes": f"WITH {ORDERS_BY_BATCH} SELECT * FROM dimension",
    "scd2_by_position": f"{BY_DELIVERY} SELECT {DIMENSION} FROM dimension",
    "scd2_deletes": f"""{WITH_DELETES}
SELECT {DIMENSION}, mode FROM dimension, (VALUES ('history'), ('merge'), ('stream')) AS m(mode)""",
    "lines_as_of": f"""WITH {LINES_BY_YEAR}
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_shipdate, l.l_quantity,
       CASE WHEN l.l_shipdate < d.effective_to THEN d.hashdiff END AS hashdiff,
       CASE WHEN l.l_shipdate < d.effective_to THEN d.effective_from END AS effective_from,
       CASE WHEN l.l_shipdate < d.effective_to THEN d.effective_to END AS effective_to
FROM lineitem l ASOF LEFT JOIN dimension d ON l.l_partkey = d.l_partkey AND l.l_shipdate >= d.effective_from""",
    "scd2_history_events": f"{DAILY} SELECT {DIMENSION} FROM dimension",
    "scd2_history_prereduced": f"{DAILY} SELECT {DIMENSION} FROM dimension",
    "scd2_history_orders": f"""
WITH {ORDER_VERSIONS}
SELECT * FROM dimension""",
    "scd2_history_lineitem": f"""
WITH {LINE_VERSIONS}
SELECT * FROM dimension""",
    "scd2_history_hot_keys": f"{event_versions('updated_at')} SELECT {DIMENSION} FROM dimension",
    "scd2_current": f"{DAILY} SELECT {DIMENSION} FROM dimension WHERE is_current",
    "gold_customer_daily": DAILY + GOLD.format(source="dimension"),
    "gold_partition_overwrite": mart_by_mode(),
    "mart_maintained": BY_CUTS + GOLD.format(source="dimension"),
    "gold_sorted_export": DAILY + GOLD.format(source="dimension"),
    "csv_lines_load": DAILY + GOLD.format(source="dimension"),
    "medallion_end_to_end": BY_CUT + GOLD.format(source="dimension"),
    "order_ties_end_to_end": f"""
WITH o AS (
  SELECT o_custkey AS customer_id, o_orderpriority AS name, o_orderstatus AS status,
         CAST(date_trunc('year', o_orderdate) AS TIMESTAMP) AS updated_at, o_orderkey AS seq
  FROM orders
), {versions('o', 'customer_id', ('name', 'status'), 'updated_at', ('seq',), f"updated_at < TIMESTAMP '{YEAR}'")}
SELECT {DIMENSION} FROM dimension""",
    "layers_by_name": f"""
{BY_CUT}, {staged('arrived', f"updated_at >= (SELECT max(updated_at) FROM e WHERE updated_at < TIMESTAMP '{CUT}')")}
SELECT 'silver' AS layer, CAST(effective_from AS DATE) AS day, status, count(*) AS cnt
FROM dimension GROUP BY 2, 3
UNION ALL SELECT 'gold', CAST(effective_from AS DATE), status, count(DISTINCT customer_id)
FROM dimension WHERE is_current GROUP BY 2, 3
UNION ALL SELECT 'staged', CAST(updated_at AS DATE), status, count(*) FROM arrived GROUP BY 2, 3""",
}
