"""The queries of `queries.py` as SQL for DuckDB, written independently of the Spark plans."""

from __future__ import annotations

from tidemark.functions.times import WHITE_SPACE
from tidemark.sources.views import START, TABLES, TODAY, YESTERDAY, VOLUME_BOUNDS

SECONDS = "%Y-%m-%d %H:%M:%S"
MICROS = "%Y-%m-%d %H:%M:%S.%f"
DAY_MS = 86_400_000
SINCE = 1_705_708_800_000  # 2024-01-20 UTC
SINCE_YESTERDAY = SINCE - DAY_MS
UPDATED_MS = 1_706_000_000_000

COLUMNS = {
    "region": "r_regionkey:i r_name:s",
    "nation": "n_nationkey:i n_name:s n_regionkey:i",
    "customer": "c_custkey:i c_name:s c_nationkey:i c_acctbal:d c_mktsegment:s",
    "supplier": "s_suppkey:i s_name:s s_nationkey:i s_acctbal:d",
    "part": "p_partkey:i p_name:s p_brand:s p_type:s p_size:i p_retailprice:d",
    "orders": "o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:d o_orderdate:t o_orderpriority:s",
    "lineitem": "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:d l_extendedprice:d "
                "l_discount:d l_tax:d l_returnflag:s l_linestatus:s l_shipdate:t",
    "events": "event_id:i ts:t user_id:i event_type:s value:d props:s",
    "documents": "doc_id:i text:s lang:s source:s n_chars:i",
    "pages": "page_id:i url:s html:s",
    "embeddings": "vec_id:i embedding:f label:i",
    "benchmark": "item_id:i text:s",
    "labels": "doc_id:i quality:i toxic:i",
    "conversations": "conv_id:i turn:i role:s text:s",
}

# A float printed with an exponent below a thousandth, as the JVM does.
_FLOAT = r"""CASE
  WHEN abs(x) >= 1e-3 OR x = 0 THEN regexp_replace(CAST(x AS VARCHAR), '\.0$', '')
  WHEN abs(x) >= 1e-4 THEN regexp_replace(
    regexp_replace(CAST(x AS VARCHAR), '0\.000(\d)(\d*)$', '\1.\2E-4'), '\.E', '.0E')
  ELSE regexp_replace(regexp_replace(upper(CAST(x AS VARCHAR)), '^(-?\d)E', '\1.0E'), 'E-0', 'E-') END"""

_VALUE = {
    "f": "'[' || array_to_string(list_transform({c}, lambda x: " + _FLOAT + "), ',') || ']'",
    "s": "CAST(to_json({c}) AS VARCHAR)",
    "i": "CAST({c} AS VARCHAR)",
    "d": "regexp_replace(CAST({c} AS VARCHAR), '\\.0$', '')",
    "t": "'\"' || substr(strftime({c}, '%Y-%m-%dT%H:%M:%S.%f'), 1, 23) || '\"'",
}


def row_json(columns: str) -> str:
    pairs = sorted(c.split(":") for c in columns.split())
    members = [
        f"'\"{name}\":' || coalesce({_VALUE[kind].format(c=name)}, 'null')" for name, kind in pairs
    ]
    return "'{' || " + " || ',' || ".join(members) + " || '}'"


def escaped(text: str) -> str:
    for char, escape in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e"),
                         ("(", "\\u2028"), (")", "\\u2029")):
        text = f"replace({text}, '{char}', '{escape}')"
    return text


def row_key(columns: str) -> str:
    return f"sha256({escaped(row_json(columns))})"


def _text_ts(ts: str, number: str) -> str:
    return (
        f"CASE WHEN {number} % 97 = 0 THEN NULL WHEN {number} % 101 = 0 THEN 'garbage' "
        f"WHEN {number} % 10 = 0 THEN strftime({ts}, '{SECONDS}') ELSE strftime({ts}, '{MICROS}') END"
    )


SRC_EVENTS = f"src_events AS (SELECT *, {_text_ts('ts', 'event_id')} AS \"DATETIMESTAMP\" FROM events)"
SRC_ORDERS = f"src_orders AS (SELECT *, {_text_ts('o_orderdate', 'o_orderkey')} AS \"DATETIMESTAMP\" FROM orders)"
SRC_EVENT_COLUMNS = COLUMNS["events"] + " DATETIMESTAMP:s"
SRC_EVENT_KEY = row_key(SRC_EVENT_COLUMNS)

_DOMAIN = "CASE event_type WHEN 'signup' THEN 'ledger_in' WHEN 'error' THEN 'ledger_na' ELSE 'erp' END"
_TIER = "CASE event_type WHEN 'click' THEN '1' WHEN 'view' THEN '2' WHEN 'purchase' THEN '?' ELSE '-' END"
_ENTRY = f"{_DOMAIN} AS domain, upper(event_type) AS view, 'tb_' || event_type AS \"table\", {_TIER} AS tier"

RAW_ROWS = f"""
raw_text AS (
  SELECT *, epoch_us(ts) // 1000 AS ms, CASE
    WHEN event_id % 89 = 0 THEN 'garbage'
    WHEN event_id % 83 = 0 THEN 'abcd-ef-gh tail'
    WHEN event_id % 79 = 0 THEN '2024-02-30 10:00:00'
    WHEN event_id % 73 = 0 THEN '2099-01-01 00:00:00'
    WHEN event_id % 7 = 0 THEN strftime(ts, '{MICROS}')
    WHEN event_id % 7 = 1 THEN '  ' || strftime(ts, '{SECONDS}')
    WHEN event_id % 7 = 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')
    WHEN event_id % 7 = 3 THEN strftime(ts, '%Y-%m-%d')
    WHEN event_id % 7 = 5 THEN strftime(ts, '%Y-%-m-%-d %-H:%-M:%-S') END AS ts_text
  FROM events),
raw_rows AS (
  SELECT {_ENTRY}, 'K' || event_id AS key, ms + (event_id % 3) * {DAY_MS} AS last_updated_time, ts_text,
    CASE WHEN ts_text IS NULL AND event_id % 7 = 6
      THEN CASE WHEN event_id % 2 = 0 THEN CAST(ms AS DOUBLE) ELSE CAST(ms // 1000 AS DOUBLE) END END AS ts_num,
    event_id
  FROM raw_text)"""

RAW_DUP = RAW_ROWS + """,
raw_dup AS (
  SELECT * FROM raw_rows UNION ALL SELECT * FROM raw_rows WHERE view = 'PURCHASE' AND event_id % 50 = 0)"""

_SPACES = " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE)
_DAY_RE = (
    r"^(\d{4})-(1[0-2]|0[1-9]|[1-9])-(3[01]|[12]\d|0[1-9]| [1-9]|[1-9])"
    r"((\s+|T|t)(2[0-3]|[01]\d|\d):([0-5]\d|\d):([0-5]\d|\d)(\.\d{1,6})?)?$"
)


def source_day(rows: str) -> str:
    """CTEs adding `source_day` to a raw rows CTE, as `dayed`."""
    return f"""
trimmed AS (SELECT *, trim(ts_text, {_SPACES}) AS t FROM {rows}),
cut AS (SELECT *, replace(substr(t, 1, 26), 'Z', '') AS u FROM trimmed),
shaped AS (SELECT *, regexp_matches(u, '{_DAY_RE}') AS fits,
  regexp_extract(u, '{_DAY_RE}', 1) || '-' || lpad(regexp_extract(u, '{_DAY_RE}', 2), 2, '0') || '-' ||
  lpad(trim(regexp_extract(u, '{_DAY_RE}', 3)), 2, '0') AS iso FROM cut),
dayed AS (SELECT * EXCLUDE (t, u, fits, iso), CASE
    WHEN ts_num IS NOT NULL THEN strftime(make_timestamp(CAST(
      CASE WHEN ts_num > 1e12 THEN ts_num / 1000 ELSE ts_num END * 1000000 AS BIGINT)), '%Y-%m-%d')
    WHEN t IS NULL OR t = '' THEN NULL
    WHEN fits AND TRY_CAST(iso AS DATE) IS NOT NULL THEN iso
    WHEN length(t) >= 10 AND substr(t, 5, 1) = '-' AND substr(t, 8, 1) = '-' THEN substr(t, 1, 10)
  END AS source_day FROM shaped)"""


CATALOG = f"""
catalog AS (
  SELECT DISTINCT {_ENTRY} FROM events
  UNION ALL SELECT 'erp', 'ABSENT', 'tb_absent', '3'
  UNION ALL SELECT 'erp', 'GONE', 'tb_gone', '2'
  UNION ALL SELECT 'ledger_in', 'LOCKED', 'tb_locked', '-'),
failures AS (
  SELECT 'tb_gone' AS "table", 'HTTP 404: no such table' AS message
  UNION ALL SELECT 'tb_locked', 'permission denied')"""


def table_stats(since: int = SINCE, today: str = TODAY) -> str:
    """CTEs ending in `stats`."""
    return f"""WITH {RAW_DUP}, {CATALOG}, {source_day('raw_dup')},
fresh AS (SELECT * FROM dayed WHERE last_updated_time >= {since}),
per_table AS (
  SELECT "table", count(*) AS rows_today, count(DISTINCT key) AS unique_keys,
    count(*) FILTER (WHERE source_day = '{today}') AS source_day_today,
    count(*) FILTER (WHERE source_day <> '{today}') AS source_day_before,
    count(*) FILTER (WHERE source_day IS NULL) AS source_day_missing
  FROM fresh GROUP BY ALL),
days AS (SELECT "table", coalesce(source_day, '<missing>') AS day, count(*) AS n FROM fresh GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY "table" ORDER BY n DESC, day) AS INTEGER) AS place FROM days),
top AS (SELECT "table", string_agg(day || '=' || n, ', ' ORDER BY place) AS top_source_days
  FROM ranked WHERE place <= 3 GROUP BY ALL),
stated AS (
  SELECT c.*, f.message, p.* EXCLUDE ("table"), t.top_source_days, CASE
      WHEN lower(f.message) LIKE '%not found%' OR f.message LIKE '%404%' THEN 'MISSING'
      WHEN f.message IS NOT NULL THEN 'ERROR'
      WHEN c."table" IN (SELECT "table" FROM raw_rows) THEN 'OK' ELSE 'MISSING' END AS status
  FROM catalog c LEFT JOIN failures f USING ("table") LEFT JOIN per_table p USING ("table")
    LEFT JOIN top t USING ("table")),
stats AS (
  SELECT domain, view, "table", tier, coalesce(rows_today, 0) AS rows_today,
    coalesce(unique_keys, 0) AS unique_keys, coalesce(source_day_today, 0) AS source_day_today,
    coalesce(source_day_before, 0) AS source_day_before,
    coalesce(source_day_missing, 0) AS source_day_missing, top_source_days, status,
    CASE WHEN status <> 'OK' THEN '' WHEN rows_today <> unique_keys THEN '!DUP_KEYS'
      WHEN rows_today > 0 AND source_day_before > source_day_today THEN '~re-upsert/catch-up'
      ELSE '' END AS flag,
    CASE WHEN status <> 'OK' THEN message END AS error
  FROM stated)"""


BY_DOMAIN = """
  SELECT domain, count(*) AS tables, count(*) FILTER (WHERE status = 'OK') AS ok,
    count(*) FILTER (WHERE status = 'MISSING') AS missing,
    count(*) FILTER (WHERE status = 'ERROR') AS errors,
    CAST(coalesce(sum(rows_today) FILTER (WHERE status = 'OK'), 0) AS BIGINT) AS upd_today,
    CAST(coalesce(sum(source_day_today) FILTER (WHERE status = 'OK'), 0) AS BIGINT) AS src_today,
    CAST(coalesce(sum(source_day_before) FILTER (WHERE status = 'OK'), 0) AS BIGINT) AS src_old,
    count(*) FILTER (WHERE flag = '!DUP_KEYS') AS dup_keys,
    count(*) FILTER (WHERE flag = '~re-upsert/catch-up') AS reupsert
  FROM stats GROUP BY domain"""

COUNTED = f"""WITH {RAW_ROWS},
expected AS (
  SELECT 'tb_' || event_type AS "table",
    count(*) + CASE event_type WHEN 'click' THEN 5 WHEN 'view' THEN -5 ELSE 0 END AS expected_rows
  FROM events GROUP BY event_type
  UNION ALL SELECT 'tb_absent', 7 UNION ALL SELECT 'tb_empty', 0),
counted AS (
  SELECT e."table" AS key, e.expected_rows, count(r.key) AS row_ingested
  FROM expected e LEFT JOIN raw_rows r ON r."table" = e."table" GROUP BY ALL),
report AS (
  SELECT *, row_ingested - expected_rows AS diff, CASE WHEN row_ingested = expected_rows THEN 'OK'
    WHEN row_ingested = 0 THEN 'EMPTY' WHEN row_ingested < expected_rows THEN 'MISSING'
    ELSE 'EXTRA' END AS status FROM counted)"""

_B = VOLUME_BOUNDS
VOLUMES = f"""
measured AS (
  SELECT l_returnflag AS f, year(l_shipdate) AS y, length(bin(CAST(floor(l_extendedprice) AS BIGINT))) AS b,
    count(*) AS n FROM lineitem GROUP BY ALL),
named AS (
  SELECT f || CAST(y AS VARCHAR) || 'S' || CAST(b AS VARCHAR) AS name,
    CASE WHEN f = 'A' AND b = 12 THEN NULL ELSE n END AS n FROM measured),
volumes AS (
  SELECT *, CASE WHEN n IS NULL THEN '?' WHEN n < {_B[0]} THEN '1' WHEN n < {_B[1]} THEN '2'
    WHEN n < {_B[2]} THEN '3' WHEN n < {_B[3]} THEN '4' ELSE '5' END AS tier FROM named)"""


def _rank(order: str) -> str:
    whens = " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(order))
    return f"CASE tier {whens} ELSE {len(order)} END"


SPLIT = f"""WITH RECURSIVE {VOLUMES},
queue AS (
  SELECT *, row_number() OVER (ORDER BY {_rank('54321?')}, coalesce(n, 0) DESC, name) AS rn FROM volumes),
fold AS (
  SELECT CAST(0 AS BIGINT) AS rn, '' AS tier, 0 AS c1, 0 AS c2, 0 AS c3,
    CAST(0 AS BIGINT) AS t1, CAST(0 AS BIGINT) AS t2, CAST(0 AS BIGINT) AS t3, 0 AS worker
  UNION ALL
  SELECT rn, tier, c1 + CAST(w = 1 AS INT), c2 + CAST(w = 2 AS INT), c3 + CAST(w = 3 AS INT),
    t1 + CASE WHEN w = 1 THEN n ELSE 0 END, t2 + CASE WHEN w = 2 THEN n ELSE 0 END,
    t3 + CASE WHEN w = 3 THEN n ELSE 0 END, w
  FROM (
    SELECT *, CASE WHEN (c1 < c2 OR (c1 = c2 AND t1 <= t2)) AND (c1 < c3 OR (c1 = c3 AND t1 <= t3)) THEN 1
      WHEN c2 < c3 OR (c2 = c3 AND t2 <= t3) THEN 2 ELSE 3 END AS w
    FROM (
      SELECT q.rn, q.tier, coalesce(q.n, 0) AS n, f.t1, f.t2, f.t3,
        CASE WHEN q.tier = f.tier THEN f.c1 ELSE 0 END AS c1,
        CASE WHEN q.tier = f.tier THEN f.c2 ELSE 0 END AS c2,
        CASE WHEN q.tier = f.tier THEN f.c3 ELSE 0 END AS c3
      FROM fold f JOIN queue q ON q.rn = f.rn + 1))),
assigned AS (SELECT q.name, q.tier, q.n, f.worker FROM queue q JOIN fold f USING (rn))"""

HISTORY = f"""
run_counts AS (
  SELECT strftime(make_timestamp(last_updated_time * 1000), '%Y-%m-%d') AS day, domain, count(*) AS upd_today
  FROM raw_rows GROUP BY ALL),
run_lines AS (SELECT DISTINCT day, date_diff('day', DATE '2024-01-01', CAST(day AS DATE)) AS d FROM run_counts),
run_history AS (
  SELECT d AS seq, day FROM run_lines
  UNION ALL SELECT d + 2000, day FROM run_lines WHERE day = '2024-01-18'
  UNION ALL SELECT d + 4000, day FROM run_lines WHERE day = '{TODAY}'),
previous AS (
  SELECT h.seq, h.day, c.domain, c.upd_today FROM run_history h JOIN run_counts c USING (day)
  WHERE h.seq = (SELECT max(seq) FROM run_history WHERE day <> '{TODAY}'))"""

_LATER = f"\"DATETIMESTAMP\" >= '{START}'"
_WELL = "regexp_full_match(\"DATETIMESTAMP\", '\\d{4}-\\d\\d-\\d\\d \\d\\d:\\d\\d:\\d\\d(\\.\\d{6})?')"


def _history_append() -> str:
    """Both runs in one statement: each under its own names."""
    def run(seq: int, since: int, today: str) -> str:
        return f"SELECT CAST({seq} AS BIGINT) AS seq, '{today}' AS day, domain, tables, upd_today, " \
            f"src_today, src_old FROM ({table_stats(since, today)} {BY_DOMAIN})"

    return run(1, SINCE_YESTERDAY, YESTERDAY) + " UNION ALL " + run(2, SINCE, TODAY)


def events_days() -> str:
    """CTE of the rows in the stored tables of `inspect_stored`: when stored, and the day of the field.

    Views and sign-ups are stored by their time, the others by loads: again from the first load's
    mark on, text that is no time once. The first sign-ups have no field.
    """
    return f"""
type_marks AS (SELECT event_type, max("DATETIMESTAMP") AS m FROM src_events
  WHERE ts < TIMESTAMP '{TODAY}' AND {_LATER} AND {_WELL} GROUP BY ALL),
stored AS (SELECT *, CASE WHEN event_type IN ('view', 'signup') OR NOT {_WELL} THEN ts >= TIMESTAMP '{TODAY}'
    ELSE "DATETIMESTAMP" >= m END AS fresh,
    CASE WHEN {_WELL} THEN substr("DATETIMESTAMP", 1, 10) END AS day
  FROM src_events LEFT JOIN type_marks USING (event_type) WHERE {_LATER})"""


def _line_columns(prefix: str = "") -> str:
    return ", ".join(f"{prefix}{c.split(':')[0]}" for c in COLUMNS["lineitem"].split())


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    events = f"WITH {SRC_EVENTS} "
    orders = f"WITH {SRC_ORDERS} "
    raw = f"WITH {RAW_ROWS} "
    dup = f"WITH {RAW_DUP} "
    volumes = f"WITH {VOLUMES} "

    as_text = f"* REPLACE (strftime({{}}, '{MICROS}') AS {{}})"
    sql["scan_view"] = events + f"SELECT {as_text.format('ts', 'ts')} FROM src_events"
    line_key = "l_orderkey || '_' || l_linenumber"
    sql["raw_upsert"] = f"""
WITH loads AS (
  SELECT {line_key} AS key, 0 AS load_id, {_line_columns()} FROM lineitem
  UNION ALL
  SELECT {line_key}, 1, {_line_columns().replace('l_quantity', 'l_quantity + 1')} FROM lineitem
  WHERE l_shipdate >= TIMESTAMP '2000-01-01'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY load_id DESC,
  {', '.join(c + ' DESC' for c in _line_columns().split(', '))}) AS rn FROM loads)
SELECT * EXCLUDE (rn) REPLACE (strftime(l_shipdate, '{MICROS}') AS l_shipdate) FROM ranked WHERE rn = 1"""
    sql["raw_upsert_stats"] = f"""
SELECT l_returnflag, count(*) AS rows_offered, count(DISTINCT {line_key}) AS keys_kept,
  count(*) - count(DISTINCT {line_key}) AS duplicate_rows FROM lineitem GROUP BY l_returnflag"""
    sql["state_advance"] = events + f""",
marks AS (SELECT event_type, max("DATETIMESTAMP") FILTER (WHERE {_WELL}) AS m FROM src_events
  WHERE "DATETIMESTAMP" < '2024-01-10' AND event_type <> 'signup' GROUP BY ALL),
batch AS (SELECT event_type, max("DATETIMESTAMP") AS b, max("DATETIMESTAMP") FILTER (WHERE {_WELL}) AS g
  FROM src_events WHERE "DATETIMESTAMP" >= '2024-01-10' GROUP BY ALL)
SELECT event_type AS query, greatest(coalesce(m, '{START}'), g) AS high_water,
  greatest(coalesce(m, '{START}'), b) AS high_water_literal FROM batch LEFT JOIN marks USING (event_type)"""
    sql["history_append"] = _history_append()
    sql["history_previous"] = raw + "," + HISTORY + " SELECT * FROM previous"

    sql["canonical_json"] = events + f"SELECT event_id, {row_json(SRC_EVENT_COLUMNS)} AS row_json FROM src_events"
    unicode = "replace(replace(replace(raw, '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e')"
    unicode = f"replace(replace({unicode}, chr(8232), '\\u2028'), chr(8233), '\\u2029')"
    sql["json_escape"] = f"""
WITH texts AS (
  SELECT 'pages' AS kind, page_id AS id, html AS raw FROM pages
  UNION ALL SELECT 'documents', doc_id, text FROM documents),
escaped AS (SELECT *, {escaped('raw')} AS t FROM texts)
SELECT kind, id, length(t) AS n_chars, sha256(t) AS digest, sha256({unicode}) AS digest_unicode FROM escaped"""
    sql["row_key_sha256"] = events + f"SELECT {SRC_EVENT_KEY} AS key, event_id FROM src_events"
    sql["row_key_tables"] = " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", {row_key(c)} AS key FROM {t}" for t, c in COLUMNS.items()
    )
    order_key = row_key(COLUMNS["orders"])
    sql["key_change_append"] = f"""
WITH changed AS (
  SELECT * REPLACE (CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice)
  FROM orders)
SELECT {order_key} AS key, o_orderkey FROM changed
WHERE {order_key} NOT IN (SELECT {order_key} FROM orders)"""
    sql["business_key"] = events + """
SELECT event_type || '_' || user_id || '_' || "DATETIMESTAMP" AS pk, event_id FROM src_events"""
    sql["single_column_key"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS "T_PK", * EXCLUDE (o_orderdate) FROM orders"""
    sql["business_key_dups"] = events + """,
keyed AS (SELECT event_type || '_' || user_id || '_' || substr("DATETIMESTAMP", 1, 10) AS key FROM src_events)
SELECT key, count(*) AS n FROM keyed GROUP BY key HAVING count(*) > 1 OR key IS NULL"""
    sql["derive_names"] = """
WITH ids AS (SELECT DISTINCT upper(replace(p_name, ' ', '')) AS id FROM part)
SELECT id, 'hub.stage.v_' || lower(id) || '_erp' AS view_name,
  'tb_' || substr(id, 1, 1) || lower(substr(id, 2)) || 'Erp' AS table_name,
  'extract-erp-' || id AS query_name FROM ids"""
    sql["parse_ts"] = raw + f"""
SELECT key, CASE WHEN regexp_full_match(ts_text, '\\d{{4}}-\\d\\d-\\d\\d \\d\\d:\\d\\d:\\d\\d(\\.\\d{{6}})?')
  THEN strftime(TRY_CAST(ts_text AS TIMESTAMP), '{MICROS}') END AS parsed FROM raw_rows"""
    sql["parse_source_day"] = raw + "," + source_day("raw_rows") + " SELECT key, source_day FROM dayed"
    sql["column_fallback"] = f"""
SELECT event_id, CASE WHEN event_id % 5 IN (0, 1) THEN strftime(ts, '{SECONDS}')
    WHEN event_id % 5 = 3 THEN CAST(1700000000 + event_id AS VARCHAR) END AS value,
  CASE WHEN event_id % 5 IN (0, 1) THEN strftime(ts, '%Y-%m-%d')
    WHEN event_id % 5 = 3 THEN strftime(make_timestamp((1700000000 + event_id) * 1000000), '%Y-%m-%d')
  END AS source_day FROM events"""

    sql["incremental_filter"] = events + f"SELECT event_id, event_type, \"DATETIMESTAMP\" FROM src_events WHERE {_LATER}"
    order_columns = "SELECT o_orderkey, o_custkey, \"DATETIMESTAMP\" FROM src_orders"
    sql["window_1y_timestamp"] = orders + f"""{order_columns}
WHERE TRY_CAST("DATETIMESTAMP" AS TIMESTAMP) >= TIMESTAMP '2001-01-01' - INTERVAL 1 YEAR"""
    sql["window_1y_string"] = orders + f"""{order_columns}
WHERE "DATETIMESTAMP" >= strftime(TIMESTAMP '2001-01-01' - INTERVAL 1 YEAR, '{SECONDS}')"""
    sql["full_load"] = orders + """
SELECT o_custkey || '_' || o_orderkey AS "PK", * EXCLUDE (o_orderdate) FROM src_orders"""
    sql["smoke_sample"] = events + f"""
SELECT {SRC_EVENT_KEY} AS key, event_id, event_type FROM src_events ORDER BY key LIMIT 10"""
    sql["key_projection"] = events + f"SELECT {SRC_EVENT_KEY} AS key, {as_text.format('ts', 'ts')} FROM src_events"
    sql["updated_since"] = raw + f"""
SELECT "table", key, last_updated_time FROM raw_rows WHERE last_updated_time >= {SINCE}"""
    sql["updated_since_zone"] = raw + f"""
SELECT "table", key, last_updated_time FROM raw_rows WHERE last_updated_time >= {SINCE} + 3 * 3600 * 1000"""
    sql["catalog_filter"] = f"""WITH {CATALOG}
SELECT * FROM catalog WHERE domain IN ('erp', 'ledger_in') AND (domain <> 'erp' OR tier IN ('1', '2', '?'))"""
    sql["single_table_filter"] = f"""WITH {CATALOG}
SELECT * FROM catalog WHERE "table" = 'tb_error'
UNION ALL SELECT 'custom', 'tb_nowhere', 'tb_nowhere', '-'
WHERE NOT EXISTS (SELECT 1 FROM catalog WHERE "table" = 'tb_nowhere')"""

    sql["count_view"] = "SELECT count(*) AS row_count FROM lineitem"
    counts = " UNION ALL ".join(
        f"SELECT {i} AS place, '{t}' AS label, count(*) AS n, 'OK' AS status FROM {t}" for i, t in enumerate(TABLES)
    )
    counts += " UNION ALL SELECT 14, 'no_such_file', NULL, 'missing_object'"
    counts += " UNION ALL SELECT 15, 'no_such_column', NULL, 'unresolved_column'"
    counts += " UNION ALL SELECT 16, 'damaged', NULL, 'other'"
    sql["count_many"] = f"SELECT label, CAST(n AS DOUBLE) AS n, status FROM ({counts})"
    sql["count_many_total"] = f"""
SELECT count(n) AS ok, count(*) AS targets, CAST(sum(n) AS BIGINT) AS total_rows,
  string_agg(label, ', ' ORDER BY place) FILTER (WHERE n IS NULL) AS failed FROM ({counts})"""
    sql["union_counts"] = COUNTED + " SELECT * FROM counted"
    stats = table_stats()
    sql["rows_updated"] = stats + ' SELECT "table", rows_today FROM per_table'
    sql["unique_keys"] = stats + ' SELECT "table", unique_keys FROM per_table'
    sql["source_age_split"] = stats + """
SELECT "table", source_day_today, source_day_before, source_day_missing FROM per_table"""
    sql["top_source_days"] = stats + ' SELECT "table", day, n, place FROM ranked WHERE place <= 3'
    sql["table_stats"] = stats + " SELECT * FROM stats"
    sql["summary_by_domain"] = stats + BY_DOMAIN
    sql["summary_by_tier"] = stats + """
SELECT tier, count(*) AS tables,
  CAST(coalesce(sum(rows_today) FILTER (WHERE status = 'OK'), 0) AS BIGINT) AS upd_today,
  CAST(coalesce(sum(source_day_today) FILTER (WHERE status = 'OK'), 0) AS BIGINT) AS src_today,
  CAST(coalesce(sum(source_day_before) FILTER (WHERE status = 'OK'), 0) AS BIGINT) AS src_old
FROM stats WHERE domain = 'erp' GROUP BY tier"""
    sql["run_totals"] = stats + """
SELECT count(*) AS tables, CAST(sum(rows_today) FILTER (WHERE status = 'OK') AS BIGINT) AS upd_today,
  count(*) FILTER (WHERE status <> 'OK') AS errors FROM stats"""
    sql["tier_volume_summary"] = volumes + """
SELECT tier, count(*) AS views, CAST(sum(n) AS DOUBLE) AS "rows",
  CAST(sum(n) AS DOUBLE) * 100 / (SELECT sum(n) FROM volumes) AS pct FROM volumes GROUP BY tier
UNION ALL SELECT 'total', count(n), CAST(sum(n) AS DOUBLE), 100 FROM volumes"""
    sql["volume_concentration"] = volumes + """
SELECT CAST(row_number() OVER w AS INTEGER) AS top, name, n,
  CAST(sum(n) OVER w AS DOUBLE) * 100 / (SELECT sum(n) FROM volumes) AS cum_pct
FROM volumes WHERE n IS NOT NULL
WINDOW w AS (ORDER BY n DESC, name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""

    sql["reconcile_status"] = COUNTED + " SELECT key, status FROM report"
    sql["reconcile_counts"] = COUNTED + " SELECT * FROM report"
    sql["ingest_flag"] = stats + " SELECT \"table\", flag FROM stats WHERE status = 'OK'"
    sql["table_status"] = stats + ' SELECT "table", status, error FROM stats'
    sql["tier_of_volume"] = volumes + "SELECT name, CAST(n AS DOUBLE) AS n, tier FROM volumes"
    sql["report_row_class"] = stats + """
SELECT "table", CASE WHEN status <> 'OK' THEN 'err' WHEN flag = '!DUP_KEYS' THEN 'warn'
  WHEN flag = '~re-upsert/catch-up' THEN 'catchup' ELSE '' END AS row_class FROM stats"""
    sql["error_class"] = """
WITH shaped AS (
  SELECT CASE event_id % 4 WHEN 0 THEN 'missing_object' WHEN 3 THEN 'other' ELSE 'unresolved_column' END AS error_class,
    CASE event_id % 4 WHEN 0 THEN '(''42P01'', ''no view v_' || user_id || ''')'
      WHEN 1 THEN '(''42703'', ''no column C' || user_id || ''')'
      WHEN 2 THEN '[UNRESOLVED_COLUMN.WITH_SUGGESTION] a column cannot be resolved'
      ELSE 'read timed out' END AS m
  FROM events)
SELECT error_class, count(*) AS n, min(m) AS example FROM shaped GROUP BY error_class"""

    sql["day_over_day_delta"] = f"""{stats}, {HISTORY}, by_domain AS ({BY_DOMAIN})
SELECT d.domain, d.upd_today, p.upd_today AS prev_upd,
  CASE WHEN p.upd_today IS NULL THEN '' ELSE printf('%+d', d.upd_today - p.upd_today) END AS delta
FROM by_domain d LEFT JOIN previous p USING (domain)"""
    sql["expected_vs_actual"] = COUNTED + """
SELECT key AS "table", expected_rows, row_ingested AS actual_rows FROM counted"""
    sql["catalog_x_rows"] = f"""WITH {RAW_ROWS}, {CATALOG},
counts AS (SELECT "table", count(*) AS n FROM raw_rows GROUP BY ALL)
SELECT CAST(row_number() OVER (ORDER BY domain, c."table") AS INTEGER) AS place, domain, view, c."table", tier,
  CAST(n AS DOUBLE) AS stored_rows
FROM catalog c LEFT JOIN counts USING ("table")"""
    sql["order_incremental"] = events + f"""
SELECT "DATETIMESTAMP", event_id, event_type FROM src_events WHERE {_LATER} ORDER BY 1, 2"""
    sql["order_reconcile"] = COUNTED + """
SELECT *, CAST(row_number() OVER (ORDER BY status, expected_rows DESC, key) AS INTEGER) AS place FROM report"""
    sql["tier_sort"] = volumes + f"""
SELECT tier, count(*) AS views, CAST(sum(n) AS DOUBLE) AS "rows", {_rank('12?345')} AS rank
FROM volumes GROUP BY tier"""
    queue = f"CAST(row_number() OVER (ORDER BY {_rank('1?2345')}, coalesce(n, 0), name) AS INTEGER)"
    sql["small_first_order"] = volumes + f"SELECT name, tier, CAST(n AS DOUBLE) AS n, {queue} AS queue_place FROM volumes"
    sql["union_all"] = dup + " UNION ALL ".join(
        f"SELECT domain, \"table\", key FROM raw_dup WHERE domain = '{d}'" for d in ("erp", "ledger_in", "ledger_na")
    )
    sql["merge_dedupe"] = f"""WITH {CATALOG}
SELECT * FROM catalog
UNION ALL SELECT DISTINCT 'erp', upper(source), 'tb_' || source, '?' FROM documents
WHERE 'tb_' || source NOT IN (SELECT "table" FROM catalog)"""
    sql["legacy_vs_live"] = """
WITH legacy AS (SELECT p_brand || '_' || p_type AS t, min(p_name) || ',' || max(p_name) AS k FROM part
  WHERE p_size <= 25 GROUP BY 1),
live AS (SELECT p_brand || '_' || p_type AS t, min(p_name) || ',' || max(p_name) AS k FROM part
  WHERE p_size >= 10 GROUP BY 1)
SELECT coalesce(a.t, b.t) AS "table", a.k AS legacy_key, b.k AS live_key,
  CASE WHEN b.t IS NULL THEN 'dropped' WHEN a.t IS NULL THEN 'added' WHEN a.k <> b.k THEN 'rekeyed'
    ELSE 'kept' END AS change FROM legacy a FULL JOIN live b ON a.t = b.t"""

    sql["balanced_split"] = SPLIT + " SELECT name, tier, CAST(n AS DOUBLE) AS n, worker FROM assigned"
    sql["split_summary"] = SPLIT + """
SELECT worker, tier, count(*) AS items, CAST(coalesce(sum(n), 0) AS BIGINT) AS "rows"
FROM assigned GROUP BY worker, tier
UNION ALL SELECT worker, 'total', count(*), CAST(sum(n) AS BIGINT) FROM assigned GROUP BY worker"""
    sql["split_order"] = SPLIT + f"""
SELECT worker, {queue.replace('OVER (', 'OVER (PARTITION BY worker ')} AS queue_place, name, tier FROM assigned"""

    loaded = f"SELECT {SRC_EVENT_KEY} AS key, event_id, \"DATETIMESTAMP\", ts FROM src_events WHERE {_LATER}"
    sql["stream_incremental_upsert"] = events + f"SELECT key, event_id, \"DATETIMESTAMP\" FROM ({loaded})"
    sql["catchup_then_delta"] = events + f""", loaded AS ({loaded}),
mark AS (SELECT max("DATETIMESTAMP") AS m FROM loaded WHERE ts < TIMESTAMP '{TODAY}' AND {_WELL})
SELECT key, event_id, CAST(CASE WHEN {_WELL} THEN "DATETIMESTAMP" >= m ELSE ts >= TIMESTAMP '{TODAY}' END
  AS BIGINT) AS load_id FROM loaded, mark"""
    sql["stream_bounded_files"] = events + f"""
SELECT key, event_id, CAST(ts < TIMESTAMP '{TODAY}' AS BIGINT) AS load_id FROM ({loaded})"""
    sql["repeat_loads"] = events + f""", loaded AS ({loaded}),
again AS (SELECT count(*) AS n FROM loaded
  WHERE "DATETIMESTAMP" = (SELECT max("DATETIMESTAMP") FROM loaded WHERE {_WELL}))
SELECT 0 AS load_id, count(*) AS n FROM loaded
UNION ALL SELECT 1, n FROM again UNION ALL SELECT 2, n FROM again"""
    sql["compact_then_replay"] = events + f""", loaded AS ({loaded}),
marks AS (SELECT max("DATETIMESTAMP") FILTER (WHERE ts < TIMESTAMP '{YESTERDAY}') AS m1,
  max("DATETIMESTAMP") FILTER (WHERE ts < TIMESTAMP '{TODAY}') AS m2 FROM loaded WHERE {_WELL})
SELECT key, event_id, CAST(CASE WHEN {_WELL} THEN CAST("DATETIMESTAMP" >= m1 AS INT) + CAST("DATETIMESTAMP" >= m2 AS INT)
  ELSE CAST(ts >= TIMESTAMP '{YESTERDAY}' AS INT) + CAST(ts >= TIMESTAMP '{TODAY}' AS INT) END AS BIGINT) AS load_id
FROM loaded, marks"""
    sql["replay_other_rows"] = """
SELECT CAST(event_id AS VARCHAR) AS key, event_type,
  CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 0 END AS attempt,
  CAST(CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 0 END AS BIGINT) AS load_id FROM events"""
    sql["replay_idempotent"] = events + f""", loaded AS ({loaded})
SELECT 'offered' AS "rows", 2 * count(*) AS n, {UPDATED_MS} AS first_update FROM loaded
UNION ALL SELECT 'kept', count(DISTINCT key), {UPDATED_MS + 1} FROM loaded"""
    sql["late_rows"] = events + f""",
arrived AS (SELECT *, ts + (event_id % 3) * INTERVAL 1 DAY AS arrival FROM src_events)
SELECT event_id, "DATETIMESTAMP" FROM arrived
WHERE arrival >= TIMESTAMP '2024-01-16' AND "DATETIMESTAMP" < (
  SELECT max("DATETIMESTAMP") FROM arrived WHERE arrival < TIMESTAMP '2024-01-16' AND {_WELL})"""
    stored = f"""WITH {SRC_EVENTS}, {CATALOG}, {events_days()}"""
    sql["inspect_stored"] = f"""{stored},
per_table AS (
  SELECT 'tb_' || event_type AS "table", count(*) FILTER (WHERE fresh) AS rows_today,
    count(*) FILTER (WHERE fresh AND day = '{TODAY}') AS source_day_today,
    count(*) FILTER (WHERE fresh AND day <> '{TODAY}') AS source_day_before,
    count(*) FILTER (WHERE fresh AND day IS NULL) AS source_day_missing FROM stored GROUP BY ALL)
SELECT domain, view, "table", tier, coalesce(rows_today, 0) AS rows_today, coalesce(rows_today, 0) AS unique_keys,
  coalesce(source_day_today, 0) AS source_day_today, coalesce(source_day_before, 0) AS source_day_before,
  coalesce(source_day_missing, 0) AS source_day_missing,
  CASE WHEN "table" = 'tb_locked' THEN 'ERROR' WHEN rows_today IS NULL THEN 'MISSING' ELSE 'OK' END AS status,
  CASE WHEN rows_today > 0 AND source_day_before > source_day_today THEN '~re-upsert/catch-up' ELSE '' END AS flag,
  "table" = 'tb_locked' AS failed
FROM catalog LEFT JOIN per_table USING ("table")"""
    sql["daily_inspection"] = f"""{stored},
counted AS (SELECT domain, count(event_id) FILTER (WHERE fresh) AS today, count(event_id) AS both_days
  FROM catalog LEFT JOIN stored ON "table" = 'tb_' || event_type GROUP BY domain)
SELECT domain, today AS upd_today, both_days AS prev_upd, printf('%+d', today - both_days) AS delta FROM counted"""
    sql["reconcile_stored"] = f"""{stored},
expected AS (
  SELECT 'tb_' || event_type AS key,
    count(*) + CASE event_type WHEN 'click' THEN 5 WHEN 'view' THEN -5 ELSE 0 END AS expected_rows
  FROM events GROUP BY event_type
  UNION ALL SELECT 'tb_absent', 7 UNION ALL SELECT 'tb_empty', 0 UNION ALL SELECT 'tb_locked', 3),
counted AS (SELECT key, expected_rows, count(event_id) AS row_ingested
  FROM expected LEFT JOIN stored ON key = 'tb_' || event_type GROUP BY ALL)
SELECT *, row_ingested - expected_rows AS diff, CASE WHEN row_ingested = expected_rows THEN 'OK'
  WHEN row_ingested = 0 THEN 'EMPTY' WHEN row_ingested < expected_rows THEN 'MISSING' ELSE 'EXTRA' END AS status,
  key = 'tb_locked' AS failed FROM counted"""
    ledger = f"""
SELECT 'events' AS query, 'success' AS status, count(*) AS "rows", NULL AS error_class
FROM src_events WHERE {_LATER}
UNION ALL SELECT 'orders', 'success', count(*), NULL FROM src_orders WHERE {_LATER}
UNION ALL SELECT 'absent', 'failure', NULL, 'missing_object'
UNION ALL SELECT 'nation', 'failure', NULL, 'unresolved_column'"""
    both = f"WITH {SRC_EVENTS}, {SRC_ORDERS}"
    sql["run_ledger"] = f"{both} SELECT * REPLACE (CAST(\"rows\" AS DOUBLE) AS \"rows\") FROM ({ledger})"
    sql["run_ledger_result"] = f"""{both}, ledger AS ({ledger})
SELECT count(*) AS queries, count(*) FILTER (WHERE status = 'success') AS succeeded,
  CAST(sum("rows") AS BIGINT) AS "rows",
  string_agg(query, ', ' ORDER BY query) FILTER (WHERE status = 'failure') AS failed,
  CASE WHEN bool_or(status = 'failure') THEN 'failure' ELSE 'success' END AS status FROM ledger"""
    smoke = " UNION ALL ".join(
        f"SELECT '{t}' AS query, 'success' AS status, CAST(count(*) AS DOUBLE) AS \"rows\", NULL AS error_class, "
        f"min(k) AS first_key, max(k) AS last_key FROM (SELECT {row_key(COLUMNS[t])} AS k FROM "
        f"(SELECT * FROM {t} ORDER BY {', '.join(c.split(':')[0] for c in COLUMNS[t].split() if c[-1] != 'f')} LIMIT 10))"
        for t in TABLES
    )
    sql["smoke_run"] = smoke + """
UNION ALL SELECT 'absent', 'failure', NULL, 'missing_object', NULL, NULL
UNION ALL SELECT 'no_such_column', 'failure', NULL, 'unresolved_column', NULL, NULL"""
    return sql
