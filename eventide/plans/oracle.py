"""SQL twins of the registered queries, for a second engine on the same tables.

Money is summed as integers at a fixed scale and rounded once, so both engines
must agree to the last digit.
"""

from __future__ import annotations

from ..operators.lineage import JOB_IO

ORACLE: dict[str, str] = {}


# --- arithmetic -------------------------------------------------------------
def half_up(num: str, den: str) -> str:
    """Integer ratio rounded half up, for non-negative operands."""
    return f"((2 * ({num}) + ({den})) // (2 * ({den})))"


def half_up_signed(num: str, den: str) -> str:
    return f"(sign({num}) * ((2 * abs({num}) + ({den})) // (2 * ({den}))))"


def half_even(num: str, den: str) -> str:
    q, r = f"(({num}) // ({den}))", f"(({num}) % ({den}))"
    return f"({q} + CASE WHEN 2 * {r} > ({den}) OR (2 * {r} = ({den}) AND {q} % 2 = 1) THEN 1 ELSE 0 END)"


def scaled(expr: str, digits: int) -> str:
    return f"(CAST({expr} AS DOUBLE) / {10 ** digits})"


def uid(expr: str) -> str:
    h = f"md5({expr})"
    return f"concat_ws('-', substr({h},1,8), substr({h},9,4), substr({h},13,4), substr({h},17,4), substr({h},21,12))"


def position(key: str, seed: int) -> str:
    return f"md5(CAST({key} AS VARCHAR) || '|{seed}')"


def picked(source: str, key: str, seed: int, fraction: float, where: str = "TRUE") -> str:
    """Hash positions in the sample of a share of the rows."""
    return f"""(SELECT h FROM (
        SELECT h, sum(c) OVER (ORDER BY h) - c AS before, sum(c) OVER () AS n FROM (
          SELECT {position(key, seed)} AS h, count(*) AS c FROM {source} WHERE {where} GROUP BY 1))
        WHERE before < greatest(1, CAST(floor(n * CAST({fraction} AS DOUBLE)) AS BIGINT)))"""


# --- shared inputs ----------------------------------------------------------
TRADES = """trades AS (
  SELECT concat(l_orderkey, '-', l_linenumber) AS trade_id, l_orderkey AS order_id, p_brand AS ticker,
         l_shipdate AS trade_time, CAST(round(l_extendedprice * 10000) AS BIGINT) AS p4,
         CAST(l_quantity AS BIGINT) AS quantity, bn.n_name AS buyer, sn.n_name AS seller,
         CAST(date_trunc('month', l_shipdate) AS DATE) AS business_date, l_returnflag AS returnflag,
         CAST(round(l_extendedprice * 10000) AS BIGINT) * CAST(l_quantity AS BIGINT) AS n4
  FROM lineitem JOIN part ON p_partkey = l_partkey
  JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
  JOIN nation bn ON bn.n_nationkey = c_nationkey
  JOIN supplier ON s_suppkey = l_suppkey JOIN nation sn ON sn.n_nationkey = s_nationkey)"""

INSTR = """instr AS (
  SELECT concat('SI-', o_orderkey, '-', n) AS instruction_id, concat(o_orderkey, '-', n) AS trade_id, n AS quantity,
         CAST(o_orderdate AS DATE) + 2 AS settlement_date,
         CASE o_orderstatus WHEN 'F' THEN 'MATCHED' WHEN 'P' THEN 'PENDING' ELSE 'FAILED' END AS status,
         CAST(round(o_totalprice * 10000) AS BIGINT) AS a4,
         CAST(date_trunc('month', o_orderdate) AS DATE) AS business_date
  FROM orders, (SELECT unnest(range(1, 8)) AS n) WHERE o_orderpriority <> '5-LOW')"""

RECON = f"""{TRADES}, {INSTR}, recon AS (
  SELECT t.*, i.instruction_id AS settlement_id, i.settlement_date, i.status AS settlement_status,
         i.quantity AS i_quantity, i.a4 AS i_a4,
         CASE WHEN i.status = 'MATCHED' THEN 'MATCHED' WHEN i.status <> 'MATCHED' THEN 'BREAK'
              ELSE 'MISSING_INSTRUCTION' END AS recon_status
  FROM trades t LEFT JOIN instr i ON i.trade_id = t.trade_id)"""

CLOSE = f"""{TRADES}, last_trade AS (
  SELECT ticker, business_date, p4 AS c4 FROM trades QUALIFY row_number() OVER (
    PARTITION BY ticker, business_date ORDER BY trade_time DESC, p4 DESC) = 1),
stats AS (
  SELECT ticker, business_date, count(*) AS trade_count, sum(quantity) AS daily_volume, sum(n4) AS n4
  FROM trades GROUP BY ticker, business_date),
closing AS (
  SELECT ticker, business_date, c4, trade_count, daily_volume, n4,
         {half_up('n4 * 100', 'daily_volume')} AS vwap6
  FROM last_trade JOIN stats USING (ticker, business_date))"""

_LEGS = """SELECT business_date, buyer AS pid, ticker, quantity AS signed, p4, 'B' AS side FROM trades WHERE {w}
  UNION ALL SELECT business_date, seller, ticker, -quantity, p4, 'S' FROM trades WHERE {w}"""

POS = f"""pos_legs AS ({_LEGS.format(w="returnflag <> 'R'")}),
pos_sums AS (
  SELECT business_date, pid, ticker, CAST(sum(signed) AS BIGINT) AS q,
         count(*) FILTER (side = 'B') AS nb, count(*) FILTER (side = 'S') AS ns,
         CAST(sum(p4) FILTER (side = 'B') AS HUGEINT) AS sb, CAST(sum(p4) FILTER (side = 'S') AS HUGEINT) AS ss
  FROM pos_legs GROUP BY ALL),
pos_mean AS (
  SELECT *, coalesce({half_up('sb * 10000', 'greatest(nb, 1)')}, 0) + coalesce({half_up('ss * 10000', 'greatest(ns, 1)')}, 0) AS m8,
         CAST(nb > 0 AS INT) + CAST(ns > 0 AS INT) AS sides FROM pos_sums),
pos AS (SELECT business_date, pid, ticker, q, {half_even('m8 * (3 - sides)', '20000')} AS a4 FROM pos_mean)"""

NET = f"""net_legs AS ({_LEGS.format(w='TRUE')}),
net AS (SELECT business_date, pid, ticker, CAST(sum(signed) AS BIGINT) AS q FROM net_legs GROUP BY ALL)"""

POSRECON = f"""{TRADES}, {POS}, {NET}, posrecon AS (
  SELECT p.pid, p.ticker, p.business_date, p.q AS declared, coalesce(n.q, 0) AS traded, p.q - coalesce(n.q, 0) AS diff,
         CASE WHEN abs(p.q - coalesce(n.q, 0)) < 1 THEN 'MATCHED' ELSE 'BREAK' END AS recon_status
  FROM pos p LEFT JOIN net n ON n.pid = p.pid AND n.ticker = p.ticker AND n.business_date = p.business_date)"""

SRC_TRADES = f"""{TRADES}, src AS (
  SELECT trade_id, CAST(trade_time AS DATE) AS trade_dt, ticker, buyer, seller, quantity, p4, n4, business_date,
         business_date + 2 AS settlement_dt,
         CASE returnflag WHEN 'R' THEN '' WHEN 'A' THEN 'OPEN' END AS status FROM trades)"""

DRVT = """drvt AS (
  SELECT concat('DP-', p_partkey) AS position_id, p_type AS participant_code, p_brand AS instrument_id,
         DATE '2024-01-01' + CAST(p_partkey % 30 AS INT) AS position_date,
         CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE 0 END AS long_qty,
         CASE WHEN p_partkey % 2 = 1 THEN p_size ELSE 0 END AS short_qty,
         CASE WHEN p_size <> 50 OR p_partkey % 30 >= 10 THEN p_retailprice END AS price FROM part)"""

CASH = """cash AS (
  SELECT concat('CP-', c_custkey) AS position_id, CAST(c_nationkey AS VARCHAR) AS participant_code,
         c_mktsegment AS ticker, DATE '2024-01-01' + CAST(c_custkey % 30 AS INT) AS position_date,
         CASE WHEN c_custkey % 30 < 15 AND c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 30 < 15 AND c_custkey % 7 = 0 THEN 0.0
              WHEN c_custkey % 2 = 0 THEN c_acctbal ELSE -c_acctbal END AS value, c_custkey FROM customer)"""

RUNS = """runs AS (
  SELECT event_id, ts, user_id, event_type, value AS duration_seconds,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         CAST(round(value * 1000000) AS BIGINT) AS v6,
         ['close_market_eod', 'reconcile_d1_positions', 'quality_gate_d1', 'publish_d1_reports'][user_id % 4 + 1] AS job_name,
         user_id % 4 + 1 AS position, CAST(ts AS DATE) AS business_date,
         concat('run-', user_id // 4, '-', strftime(ts, '%Y%m%d')) AS run_id,
         CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'success' WHEN 'signup' THEN 'retry'
              ELSE 'running' END AS status,
         value > [60.0, 90.0, 30.0, 60.0][user_id % 4 + 1] AS sla_miss FROM events)"""

MESSAGE = """CASE WHEN status = 'failed' THEN concat('[DQ-CASO-', k % 4 + 1, '] ',
  ['Duplicatas', 'Coluna nula', 'Soma zero', 'Diferença de contagem'][k % 4 + 1], ': ', k) END"""

DQ = f"""{TRADES.replace('trades AS', 'trades_dq AS')}, dq_ids AS (
  SELECT business_date, returnflag, trade_id, count(*) AS n, count(*) FILTER (quantity >= 50) AS big
  FROM trades_dq GROUP BY ALL),
dq_counts AS (
  SELECT business_date, returnflag, sum(n - 1) AS dups, sum(big) AS big, sum(n) AS total FROM dq_ids GROUP BY ALL),
dq AS (
  SELECT business_date, concat('run-', returnflag) AS run_id, check_name, check_type, 'raw_trades' AS target_table,
         severity, passed, CAST(CAST(actual AS BIGINT) AS VARCHAR) AS actual_value,
         {uid("concat_ws('-', returnflag, business_date, check_name)")} AS result_id,
         business_date + to_hours(CASE returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END) AS created_at
  FROM (SELECT *, 'duplicate_trades' AS check_name, 'uniqueness' AS check_type, 'critical' AS severity, dups <= 4 AS passed, dups AS actual FROM dq_counts
        UNION ALL SELECT *, 'large_quantity', 'reasonableness', 'warning', big <= 3, big FROM dq_counts
        UNION ALL SELECT *, 'row_count', 'completeness', 'critical', total >= 50, total FROM dq_counts))"""

DQ_LATEST = f"""{DQ}, newest AS (
  SELECT business_date, run_id FROM dq GROUP BY business_date, run_id
  QUALIFY row_number() OVER (PARTITION BY business_date ORDER BY max(created_at) DESC, run_id DESC) = 1),
latest AS (SELECT dq.* FROM dq JOIN newest USING (business_date, run_id))"""

EDGES = """edges AS (
  SELECT DISTINCT concat('job_', user_id) AS job, CASE event_type WHEN 'view' THEN 'input' ELSE 'output' END AS direction,
         'events' AS namespace,
         concat_ws('_', 'ds', CASE event_type WHEN 'view' THEN user_id // 2 ELSE user_id END,
                   CAST(json_extract_string(props, '$.k') AS BIGINT) % 3) AS name
  FROM events WHERE event_type IN ('view', 'purchase'))"""

# Trades left after a tenth was dropped by hash order.
DROPPED = f"""{TRADES}, kept AS (
  SELECT * FROM trades WHERE {position('trade_id', 7)} NOT IN {picked('trades', 'trade_id', 7, 0.10)})"""

RESULT = "check_name, check_type, target_table, severity, passed, expected_value, actual_value, details"


def result(name, kind, table, severity, passed, expected, actual, details) -> str:
    return (
        f"'{name}' AS check_name, '{kind}' AS check_type, '{table}' AS target_table, '{severity}' AS severity, "
        f"{passed} AS passed, {expected} AS expected_value, {actual} AS actual_value, {details} AS details"
    )


# --- A ----------------------------------------------------------------------
ORACLE["a1_read_slice"] = """SELECT o_orderkey, o_custkey, o_orderstatus FROM orders
WHERE o_orderdate >= DATE '1998-06-01' AND o_orderdate < DATE '1998-06-02'"""
ORACLE["a2_equal_depth_reads"] = """WITH o AS (SELECT o_orderkey, CASE WHEN o_custkey % 10 > 0 THEN o_custkey END AS k FROM orders),
lows AS (SELECT DISTINCT min(k) AS low FROM (SELECT k, ntile(12) OVER (ORDER BY k) AS tile FROM o WHERE k IS NOT NULL) GROUP BY tile),
cuts AS (SELECT low, row_number() OVER (ORDER BY low) - 1 AS part FROM lows)
SELECT part, count(*) AS "rows", count(*) FILTER (k IS NULL) AS without_key FROM (
  SELECT k, coalesce((SELECT max(part) FROM cuts WHERE low <= k), 0) AS part FROM o) GROUP BY part"""
ORACLE["a3_fallback_trades"] = f"""WITH {TRADES} SELECT trade_id, ticker, {scaled('n4', 4)} AS notional, quantity,
business_date AS trade_dt, CAST(NULL AS DATE) AS settlement_dt, seller AS counterparty_id, buyer AS trader_id,
CAST(NULL AS VARCHAR) AS desk_code, 'EXECUTED' AS status FROM trades"""
ORACLE["a4_fallback_drvt_positions"] = f"""WITH {TRADES}, {POS}
SELECT {uid("concat_ws('-', 'drvt', pid, ticker, business_date)")} AS position_id, ticker AS instrument_id,
pid AS participant_code, business_date AS position_date, greatest(q, 0) AS long_qty, abs(least(q, 0)) AS short_qty,
q AS net_qty, {scaled('a4', 4)} AS settlement_price, CAST(NULL AS DOUBLE) AS margin_value FROM pos"""
ORACLE["a5_fallback_cash_positions"] = f"""WITH {TRADES}, {POS}
SELECT {uid("concat_ws('-', 'cash', pid, ticker, business_date)")} AS position_id, ticker, pid AS participant_code,
business_date AS position_date, {scaled('greatest(q * a4, 0)', 4)} AS long_value,
{scaled('least(q * a4, 0)', 4)} AS short_value, {scaled('q * a4', 4)} AS net_value FROM pos"""
ORACLE["a6_first_available"] = f"""WITH {TRADES} SELECT 'mysql_fallback' AS dw_source, business_date AS trade_dt,
count(*) AS "rows" FROM trades GROUP BY ALL"""
_ORDERS = "SELECT o_orderkey, o_orderstatus, CAST(date_trunc('month', o_orderdate) AS DATE) AS business_date FROM orders"
ORACLE["a7_replace_slice"] = f"""SELECT * FROM ({_ORDERS}) WHERE business_date <> DATE '1999-01-01'
AND (business_date <> DATE '1998-06-01' OR o_orderstatus = 'F')"""
ORACLE["a7_versioned_slices"] = f"""SELECT *, 'all' AS table_name FROM ({_ORDERS})
WHERE business_date <> DATE '1995-03-01' AND (business_date <> DATE '1998-06-01' OR o_orderstatus = 'F')
UNION ALL SELECT *, 'open' FROM ({_ORDERS}) WHERE o_orderstatus = 'O' AND business_date <> DATE '1998-06-01'"""
ORACLE["a8_copy_table"] = f"SELECT * FROM ({_ORDERS}) WHERE business_date IN (DATE '1998-06-01', DATE '1998-07-01')"
ORACLE["a9_write_dq_results"] = f"""WITH {DQ}, covered AS (SELECT DISTINCT business_date FROM dq WHERE run_id = 'run-R')
SELECT business_date, run_id, check_name, severity, passed, actual_value FROM dq
WHERE run_id = 'run-R' OR business_date NOT IN (SELECT business_date FROM covered)
UNION ALL SELECT business_date, run_id, check_name, severity, passed, actual_value FROM dq WHERE run_id = 'run-A'"""
_G1 = f"""SELECT trade_id, ticker, {scaled('n4', 4)} AS notional, CAST(quantity AS DOUBLE) AS quantity,
business_date AS trade_dt, settlement_dt, buyer AS counterparty_id, seller AS trader_id,
substr(ticker, 1, 5) AS desk_code, status FROM src"""
ORACLE["a10_export_parquet"] = f"WITH {SRC_TRADES} SELECT *, 'oracle' AS dw_source FROM ({_G1}) WHERE trade_dt = DATE '1998-06-01'"
ORACLE["a11_export_csv"] = f"""WITH {CASH} SELECT position_id, ticker AS instrument_code,
CAST(CAST(value AS DECIMAL(22,6)) AS VARCHAR) AS settlement_value, CAST(position_date AS VARCHAR) AS business_date
FROM cash WHERE position_date = DATE '2024-01-05'"""
ORACLE["a12_append_run_history"] = f"""WITH {RUNS} SELECT run_id, business_date,
CASE WHEN count(*) FILTER (status = 'failed') = 0 THEN 'ended_ok' ELSE 'ended_not_ok' END AS status,
count(DISTINCT job_name) AS job_count, bool_or(job_name = 'publish_d1_reports') AS has_publish FROM runs GROUP BY run_id, business_date"""
ORACLE["a13_read_job_logs"] = f"""WITH {RUNS} SELECT CAST(event_id AS VARCHAR) AS trace_id, ts AS "timestamp", job_name, status,
duration_seconds, sla_miss FROM runs WHERE event_id % 10 > 1"""
ORACLE["a14_stream_job_logs"] = f"""WITH {RUNS} SELECT CAST(event_id AS VARCHAR) AS trace_id, ts AS "timestamp", job_name, status FROM runs"""
ORACLE["a15_upsert"] = f"""WITH {CLOSE}, old AS (
  SELECT *, {half_up('n4', 'daily_volume')} AS v4 FROM closing WHERE business_date < DATE '1998-06-01'),
new AS (SELECT *, {half_even('n4', 'daily_volume')} AS v4, {half_even('n4', 'daily_volume * 100')} AS v2
  FROM closing WHERE business_date >= DATE '1998-01-01')
SELECT coalesce(n.ticker, o.ticker) AS ticker, coalesce(n.business_date, o.business_date) AS business_date,
  CASE WHEN n.ticker IS NOT NULL THEN {scaled('n.v2', 2)} ELSE {scaled('o.c4', 4)} END AS closing_price,
  CAST(coalesce(n.daily_volume, o.daily_volume) AS BIGINT) AS daily_volume,
  {scaled('coalesce(n.v4, o.v4)', 4)} AS vwap, o.ticker IS NULL AS auction_flag
FROM old o FULL JOIN new n ON n.ticker = o.ticker AND n.business_date = o.business_date"""
ORACLE["a16_insert_missing"] = """SELECT c_custkey AS participant_code,
CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'trading' ELSE c_mktsegment END AS desk FROM customer"""
ORACLE["a17_split_valid"] = f"""WITH {SRC_TRADES}, judged AS (SELECT business_date AS trade_dt,
concat_ws(',', CASE WHEN n4 * (CASE WHEN quantity = 50 THEN 1000000000::HUGEINT ELSE 1 END) > 999999999999999999 THEN 'notional:type' END,
CASE WHEN status IS NULL OR status = '' THEN 'status:not_null' END) AS reasons FROM src)
SELECT trade_dt, CASE WHEN reasons = '' THEN 'good' ELSE 'rejected' END AS side, reasons, count(*) AS "rows" FROM judged GROUP BY ALL"""

# --- B ----------------------------------------------------------------------
ORACLE["b1_for_date"] = """SELECT o_orderkey, kind FROM orders, (VALUES ('timestamp'), ('text')) v(kind)
WHERE CAST(o_orderdate AS DATE) = DATE '1998-06-01'"""
ORACLE["b2_map_trades_g1"] = f"WITH {SRC_TRADES} {_G1}"
ORACLE["b3_map_trades_g2"] = f"""WITH {TRADES} SELECT trade_id, ticker,
CASE WHEN quantity < 49 THEN {scaled('n4', 4)} ELSE 0.0 END AS notional,
CASE WHEN quantity > 1 THEN quantity ELSE 0 END AS quantity, business_date AS trade_dt,
CAST(NULL AS DATE) AS settlement_dt, seller AS counterparty_id, buyer AS trader_id, CAST(NULL AS VARCHAR) AS desk_code,
'EXECUTED' AS status FROM trades"""
ORACLE["b4_map_drvt_positions"] = f"""WITH {DRVT} SELECT position_id, instrument_id, participant_code, position_date,
CAST(long_qty AS DOUBLE) AS long_qty, CAST(short_qty AS DOUBLE) AS short_qty, CAST(long_qty - short_qty AS DOUBLE) AS net_qty,
price AS settlement_price, price AS margin_value FROM drvt"""
_CASH_MAPPED = """SELECT position_id, ticker, participant_code, position_date,
CASE WHEN coalesce(value, 0) >= 0 THEN coalesce(value, 0) ELSE 0.0 END AS long_value,
CASE WHEN coalesce(value, 0) < 0 THEN value ELSE 0.0 END AS short_value, coalesce(value, 0.0) AS net_value FROM cash"""
ORACLE["b5_cash_sign_split"] = f"WITH {CASH} {_CASH_MAPPED}"
ORACLE["b6_row_hash"] = f"""WITH {SRC_TRADES} SELECT trade_id,
sha256(concat_ws('|', trade_id, CAST(business_date AS VARCHAR))) AS hash_g1,
sha256(concat_ws('|', trade_id, ticker, concat(n4 // 10000, '.', lpad(CAST(n4 % 10000 AS VARCHAR), 4, '0')), quantity, CAST(business_date AS VARCHAR))) AS hash_g2 FROM src"""
ORACLE["b6_hash_diff"] = f"""WITH {TRADES}, judged AS (SELECT business_date, trade_id, business_date >= DATE '1995-06-01' AS late, quantity FROM trades)
SELECT business_date, count(*) FILTER (NOT late OR quantity NOT IN (7, 9, 50)) AS unchanged, count(*) FILTER (late AND quantity = 50) AS updated,
count(*) FILTER (late AND quantity = 9) AS inserted, count(*) FILTER (late AND quantity IN (7, 9)) AS deleted,
bool_or(late AND quantity IN (7, 9, 50)) AS written FROM judged GROUP BY business_date"""
ORACLE["b7_add_audit"] = f"""WITH {CASH} SELECT position_id, TIMESTAMP '2024-02-01 00:00:00' AS dw_load_dt, 'oracle' AS dw_source,
sha256(concat(position_id, '|', CAST(position_date AS VARCHAR))) AS dw_row_hash FROM cash"""
ORACLE["b8_volume_category"] = """SELECT o_custkey, CASE WHEN v > 1000000 THEN 'HIGH' WHEN v > 100000 THEN 'MEDIUM' ELSE 'LOW' END AS volume_category
FROM (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,4))) AS v FROM orders GROUP BY 1)"""
ORACLE["b9_export_columns"] = f"""WITH {DRVT} SELECT position_id, instrument_id, participant_code, position_date,
CAST(long_qty AS DOUBLE) AS long_qty, CAST(short_qty AS DOUBLE) AS short_qty, CAST(long_qty - short_qty AS DOUBLE) AS net_qty,
price AS settlement_price, price AS margin_value, TIMESTAMP '2024-02-01 00:00:00' AS dw_load_dt, 'oracle' AS dw_source FROM drvt"""
ORACLE["b11_run_sql"] = f"""SELECT o_orderstatus, count(*) AS orders, {scaled('sum(CAST(round(o_totalprice * 10000) AS BIGINT))', 4)} AS total
FROM orders WHERE o_orderdate >= DATE '1998-06-01' GROUP BY 1"""
ORACLE["b12_active_participants"] = """SELECT c_name AS participant_code, 'some' AS "case" FROM customer WHERE c_acctbal > 5000
UNION ALL SELECT concat('PART', lpad(CAST(i AS VARCHAR), 3, '0')), 'none' FROM range(1, 11) t(i)"""

# --- C ----------------------------------------------------------------------
ORACLE["c1_settlement_recon"] = f"""WITH {RECON} SELECT trade_id, ticker, business_date, {scaled('p4', 4)} AS price, quantity,
settlement_id, settlement_date, settlement_status, recon_status, {scaled('n4', 4)} AS notional_value FROM recon"""
ORACLE["c1_frequent_keys"] = """SELECT l_suppkey AS k, count(*) AS n, TRUE AS within_error FROM lineitem GROUP BY 1
HAVING count(*) * 1500 > (SELECT count(*) FROM lineitem)"""
ORACLE["c3_position_recon"] = f"""WITH {POSRECON} SELECT pid AS participant_id, ticker, business_date, declared AS declared_quantity,
traded AS traded_net_qty, diff AS quantity_diff, recon_status FROM posrecon"""
ORACLE["c4_participant_exposure"] = f"""WITH {CLOSE}, {POS} SELECT p.pid AS participant_id, p.ticker, p.business_date,
p.q AS declared_quantity, CAST(0 AS BIGINT) AS traded_net_qty, p.q AS quantity_diff, 'BREAK' AS recon_status,
{scaled('c.c4', 4)} AS closing_price, {scaled('p.q * coalesce(c.c4, 0)', 4)} AS mark_to_market, {scaled('p.q * coalesce(c.c4, 0)', 4)} AS exposure_diff
FROM pos p LEFT JOIN closing c ON c.ticker = p.ticker AND c.business_date = p.business_date"""
ORACLE["c5_orphan_instructions"] = f"""WITH {TRADES}, {INSTR} SELECT instruction_id, trade_id, business_date, status FROM instr i
WHERE NOT EXISTS (SELECT 1 FROM trades t WHERE t.trade_id = i.trade_id AND t.business_date = i.business_date)"""
ORACLE["c6_rows_in"] = """SELECT o_orderkey, o_custkey,
CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50) THEN 'in' ELSE 'out' END AS side FROM orders"""
ORACLE["c7_net_positions_full_outer"] = f"""WITH {TRADES}, {NET} SELECT business_date, pid AS participant_id, ticker,
CAST(coalesce(sum(signed) FILTER (side = 'B'), 0) AS BIGINT) AS bought, CAST(-coalesce(sum(signed) FILTER (side = 'S'), 0) AS BIGINT) AS sold,
CAST(sum(signed) AS BIGINT) AS net_quantity FROM net_legs GROUP BY ALL"""
ORACLE["c8_cross_count"] = """SELECT CAST((SELECT count(*) FROM lineitem) * (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS BIGINT) AS cnt"""
_PARITY = f"""WITH {DROPPED}, parity AS (SELECT business_date, coalesce(s, 0) AS s, coalesce(t, 0) AS t FROM
(SELECT business_date, count(*) AS t FROM trades GROUP BY 1) FULL JOIN (SELECT business_date, count(*) AS s FROM kept GROUP BY 1) USING (business_date))"""
ORACLE["c9_row_count_parity"] = f"{_PARITY} SELECT business_date, s AS source_count, t AS target_count, s - t AS count_diff FROM parity"
ORACLE["c10_enrich_trades"] = f"""WITH {CLOSE} SELECT t.trade_id, t.ticker, t.business_date, {scaled('t.p4', 4)} AS price,
{scaled('c.c4', 4)} AS closing_price, {scaled(half_up_signed('CAST(t.p4 - c.c4 AS HUGEINT) * 1000000', 'c.c4'), 4)} AS price_vs_close_pct
FROM trades t LEFT JOIN closing c ON c.ticker = t.ticker AND c.business_date = t.business_date"""
ORACLE["c11_settlement_recon_detailed"] = f"""WITH {RECON} SELECT trade_id, settlement_id AS instruction_id, ticker,
quantity AS trade_quantity, i_quantity AS settlement_quantity, quantity = i_quantity AS quantity_match,
{scaled('n4', 4)} AS trade_amount, {scaled('i_a4', 4)} AS settlement_amount, n4 = i_a4 AS amount_match, recon_status, business_date FROM recon"""

# --- D ----------------------------------------------------------------------
ORACLE["d1_trade_stats"] = f"""WITH {CLOSE} SELECT ticker, business_date, trade_count, CAST(daily_volume AS BIGINT) AS daily_volume,
{scaled('vwap6', 6)} AS vwap, {scaled('n4', 4)} AS total_notional FROM closing"""
ORACLE["d2_close_by_vwap"] = f"""WITH {CLOSE} SELECT ticker, business_date, {scaled(half_even('n4', 'daily_volume * 100'), 2)} AS closing_price,
CAST(daily_volume AS BIGINT) AS daily_volume, {scaled(half_even('n4', 'daily_volume'), 4)} AS vwap FROM closing"""
ORACLE["d3_net_traded"] = f"WITH {TRADES}, {NET} SELECT business_date, pid AS participant_id, ticker, q AS traded_net_qty FROM net"
ORACLE["d4_participant_positions"] = f"""WITH {TRADES}, {POS} SELECT pid AS participant, ticker, business_date, q AS net_quantity,
{scaled('a4', 4)} AS avg_price FROM pos"""
_REPORT = f"""SELECT business_date, count(*) AS total_trades, count(*) FILTER (recon_status = 'MATCHED') AS matched_count,
count(*) FILTER (recon_status = 'BREAK') AS break_count, count(*) FILTER (recon_status = 'MISSING_INSTRUCTION') AS missing_count,
{scaled(half_up("10000 * count(*) FILTER (recon_status = 'MATCHED')", 'count(*)'), 2)} AS match_rate_pct,
{scaled("coalesce(sum(n4) FILTER (recon_status = 'BREAK'), 0)", 4)} AS break_notional, {scaled('sum(n4)', 4)} AS total_notional
FROM recon GROUP BY business_date"""
ORACLE["d5_settlement_report"] = f"WITH {RECON} {_REPORT}"
_IDS = "(SELECT business_date, trade_id, count(*) AS n FROM {t} GROUP BY ALL)"
ORACLE["d6_excess_duplicates"] = f"""WITH {TRADES} SELECT business_date, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM {_IDS.format(t='trades')} GROUP BY 1"""
ORACLE["d7_rows_minus_distinct"] = f"""WITH {TRADES} SELECT business_date,
count(*) - count(DISTINCT CASE WHEN quantity > 1 THEN trade_id END) AS duplicates FROM trades GROUP BY 1"""
ORACLE["d8_duplicate_keys"] = f"""WITH {TRADES} SELECT business_date, count(*) FILTER (n > 1) AS duplicates FROM {_IDS.format(t='trades')} GROUP BY 1"""
ORACLE["d10_dq_summary"] = f"""WITH {DQ} SELECT business_date, check_type, severity, count(*) AS checks_run,
count(*) FILTER (NOT passed) AS checks_failed FROM dq GROUP BY ALL"""
_GATE = """count(*) AS checks_run, count(*) FILTER (NOT passed) AS checks_failed,
count(*) FILTER (NOT passed AND severity = 'critical') AS critical_failures,
CASE WHEN count(*) FILTER (NOT passed AND severity = 'critical') = 0 THEN 'PASS' ELSE 'FAIL' END AS gate_status"""
ORACLE["d11_gate_status"] = f"WITH {DQ} SELECT business_date, run_id, {_GATE} FROM dq GROUP BY business_date, run_id"
_GAUGES = f"""WITH {SRC_TRADES}, {DRVT}, {CASH}, t AS (
  SELECT business_date, sum(n) AS n, sum(n - 1) AS d FROM {_IDS.format(t='src')} GROUP BY 1),
p AS (SELECT position_date AS business_date, count(*) AS n, count(*) FILTER (price IS NULL) AS nulls FROM drvt GROUP BY 1),
c AS (SELECT position_date AS business_date, count(*) AS n, count(*) FILTER (coalesce(value, 0) = 0) AS zeros,
  count(*) FILTER (value = 0) AS src_zeros FROM cash GROUP BY 1),
gauges AS (
  SELECT business_date, metric, CAST(v AS DOUBLE) AS value, tab AS table_name, db FROM (
  SELECT business_date, 'exchange.dw.trade_movements_loaded' AS metric, n AS v, 'dw_trade_movements' AS tab, 'sqlserver' AS db FROM t
  UNION ALL SELECT business_date, 'exchange.dw.trade_movements_destination_count', n, 'dw_trade_movements', 'sqlserver' FROM t
  UNION ALL SELECT business_date, 'exchange.dq.duplicate_trades', d, 'dw_trade_movements', 'sqlserver' FROM t
  UNION ALL SELECT business_date, 'exchange.dw.derivative_positions_loaded', n, 'dw_drvt_positions', 'sqlserver' FROM p
  UNION ALL SELECT business_date, 'exchange.dw.derivative_positions_destination_count', n, 'dw_drvt_positions', 'sqlserver' FROM p
  UNION ALL SELECT business_date, 'exchange.dq.null_settlement_price', nulls, 'dw_drvt_positions', 'sqlserver' FROM p
  UNION ALL SELECT business_date, 'exchange.dw.market_positions_loaded', n, 'dw_cash_positions', 'sqlserver' FROM c
  UNION ALL SELECT business_date, 'exchange.dw.cash_positions_destination_count', n, 'dw_cash_positions', 'sqlserver' FROM c
  UNION ALL SELECT business_date, 'exchange.dq.zero_sum_positions', zeros, 'dw_cash_positions', 'sqlserver' FROM c
  UNION ALL SELECT business_date, 'exchange.oracle.trade_mvmt_source_count', n, 'src_trade_movements', 'oracle' FROM t
  UNION ALL SELECT business_date, 'exchange.oracle.duplicate_trades_source_count', d, 'src_trade_movements', 'oracle' FROM t
  UNION ALL SELECT business_date, 'exchange.oracle.derivative_position_source_count', n, 'src_drvt_positions', 'oracle' FROM p
  UNION ALL SELECT business_date, 'exchange.oracle.cash_position_source_count', n, 'src_cash_positions', 'oracle' FROM c
  UNION ALL SELECT business_date, 'exchange.oracle.cash_zero_sum_source_count', src_zeros, 'src_cash_positions', 'oracle' FROM c))"""
ORACLE["d12_daily_gauges"] = f"{_GAUGES} SELECT * FROM gauges"

# --- E ----------------------------------------------------------------------
ORACLE["e1_last_trade"] = f"WITH {CLOSE} SELECT ticker, business_date, {scaled('c4', 4)} AS closing_price FROM last_trade"
ORACLE["e2_running_counts"] = f"""WITH {RUNS} SELECT event_id, job_name,
count(*) FILTER (status = 'success') OVER w AS ended_ok, count(*) FILTER (status = 'failed') OVER w AS ended_not_ok,
count(*) FILTER (sla_miss AND status IN ('success', 'failed')) OVER w AS sla_violations FROM runs
WINDOW w AS (PARTITION BY job_name ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"""
ORACLE["e3_last_value"] = f"""WITH {RUNS} SELECT user_id, k AS output_rows, ts FROM runs
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""
ORACLE["e4_latest_run"] = f"WITH {DQ_LATEST} SELECT business_date, run_id, check_name, passed, actual_value FROM latest"

# --- F, S -------------------------------------------------------------------
_SUMMARY = f"""{RUNS}, summary AS (SELECT run_id, business_date, count(*) FILTER (status = 'success') AS jobs_ok,
count(*) FILTER (status = 'failed') AS jobs_notok, count(*) AS total_rows, min(ts) AS started_at, max(ts) AS finished_at,
CASE WHEN count(*) FILTER (status = 'failed') = 0 THEN 'ended_ok' ELSE 'ended_not_ok' END AS status,
CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / 1000000 AS duration_seconds FROM runs GROUP BY run_id, business_date)"""
ORACLE["f1_recent_runs"] = f"WITH {_SUMMARY} SELECT run_id, finished_at, status FROM summary ORDER BY finished_at DESC, run_id DESC LIMIT 50"
ORACLE["f2_top_n"] = f"""WITH {RUNS} SELECT concat('u', user_id) AS "user", CAST(sum(k % 3) AS BIGINT) AS total_retries FROM runs
GROUP BY 1 ORDER BY total_retries DESC, "user" LIMIT 10"""
ORACLE["f3_offender_samples"] = f"""WITH {TRADES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY business_date ORDER BY trade_id, quantity) AS r
FROM trades WHERE quantity >= 50)
SELECT business_date, string_agg(concat('trade_id=', trade_id, ' quantity=', quantity), '; ' ORDER BY r) AS samples FROM ranked WHERE r <= 5 GROUP BY 1"""
ORACLE["f4_sample_rows"] = f"""SELECT o_orderkey, o_custkey, 'share' AS kind FROM orders WHERE {position('o_orderkey', 11)} IN {picked('orders', 'o_orderkey', 11, 0.05)}
UNION ALL (SELECT o_orderkey, o_custkey, 'rows' FROM orders ORDER BY {position('o_orderkey', 11)} LIMIT 20)"""
_EXTERNAL = f"""WITH {EDGES}, external_io AS (
(SELECT 'input' AS direction, namespace, name FROM edges WHERE direction = 'input'
 EXCEPT SELECT 'input', namespace, name FROM edges WHERE direction = 'output')
UNION ALL (SELECT 'output', namespace, name FROM edges WHERE direction = 'output'
 EXCEPT SELECT 'output', namespace, name FROM edges WHERE direction = 'input'))"""
ORACLE["s3_external_sketches"] = f"""{_EXTERNAL} SELECT count(*) FILTER (direction = 'input') AS n_in,
count(*) FILTER (direction = 'output') AS n_out, TRUE AS in_within, TRUE AS out_within FROM external_io"""
ORACLE["s3_external_io"] = f"{_EXTERNAL} SELECT * FROM external_io"

# --- H ----------------------------------------------------------------------
ORACLE["h1_substring"] = "SELECT p_partkey, substr(p_name, 1, 5) AS prefix FROM part"
ORACLE["h2_lpad_concat"] = """SELECT o_orderkey, concat('TRD-', strftime(o_orderdate, '%Y%m%d'), '-', lpad(CAST(o_orderkey AS VARCHAR), 8, '0')) AS trade_id FROM orders"""
ORACLE["h3_dates"] = """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS parsed, strftime(o_orderdate, '%Y-%m-%d') AS text, CAST(o_orderdate AS DATE) AS truncated FROM orders"""
ORACLE["h4_date_add"] = "SELECT o_orderkey, CAST(o_orderdate AS DATE) + 2 AS settles FROM orders"
ORACLE["h5_date_tag"] = "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS tag FROM orders"
ORACLE["h6_iso_millis"] = """SELECT event_id, concat(strftime(ts, '%Y-%m-%dT%H:%M:%S.'), lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0'), 'Z') AS utc,
concat(strftime(ts - INTERVAL 3 HOUR, '%Y-%m-%dT%H:%M:%S.'), lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0'), 'Z') AS shifted FROM events"""
_V = "(CAST(round(c_acctbal * 10000) AS BIGINT) - 50000000)"
ORACLE["h7_numeric"] = f"""SELECT c_custkey, {scaled(f'abs({_V})', 4)} AS abs_v, {scaled(f'greatest({_V}, 0)', 4)} AS greatest_v,
{scaled(f'least({_V}, 0)', 4)} AS least_v, {scaled(half_up_signed(_V, '1000'), 1)} AS round_v, c_custkey % 7 AS mod_v FROM customer"""
ORACLE["h8_null_functions"] = f"""WITH {CASH} SELECT position_id, nullif(value, 0) AS nullif_v, coalesce(nullif(value, 0), -1.0) AS coalesce_v,
coalesce(value, 0.0) AS nvl_v FROM cash"""
ORACLE["h9_case_when"] = """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'MATCHED' WHEN 'P' THEN 'BREAK' ELSE 'MISSING_INSTRUCTION' END AS label FROM orders"""
ORACLE["h10_casts"] = """SELECT event_id, value AS exact, CAST(user_id AS VARCHAR) AS text, CAST(TRY_CAST(event_type AS INT) AS BIGINT) AS bad_int,
CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"""
ORACLE["h11_hashes"] = f"""SELECT c_custkey, sha256(c_name) AS sha, {uid("concat_ws('-', c_name, c_mktsegment)")} AS id FROM customer"""
ORACLE["h12_uuid"] = "SELECT count(*) AS ids, count(*) AS distinct_ids, count(*) AS well_formed FROM orders"
_REFS = r"regexp_extract_all(text, '(?i)\b(?:FROM|JOIN)\s+([A-Za-z0-9_.]+)', 1)"
ORACLE["h13_referenced_tables"] = f"SELECT doc_id, array_to_string({_REFS}, ',') AS tables FROM documents"
ORACLE["h14_json"] = """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
concat('{"type":"', event_type, '","k":', json_extract_string(props, '$.k'), '}') AS doc FROM events"""
ORACLE["h15_tag_map"] = "SELECT event_id, 'last' AS job, concat('a:b:', user_id) AS url, CAST(2 AS BIGINT) AS tags FROM events"
ORACLE["h16_tail_text"] = "SELECT doc_id, right(text, 80) AS tail FROM documents"
ORACLE["h17_one_line"] = r"SELECT doc_id, substr(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), 1, 500) AS line FROM documents"

# --- I ----------------------------------------------------------------------
_D = "strftime(business_date, '%Y-%m-%d')"
_I1 = f"(SELECT business_date, CAST(sum(n - 1) AS BIGINT) AS n FROM {_IDS.format(t='src')} GROUP BY 1)"
ORACLE["i1_duplicate_trades"] = f"""WITH {SRC_TRADES} SELECT business_date, {result('caso1_duplicate_trades', 'uniqueness', 'dw_trade_movements', 'critical', 'n = 0', "'0'", 'CAST(n AS VARCHAR)', "CASE WHEN n > 0 THEN concat(n, ' duplicate trade_id rows found') ELSE 'No duplicates' END")} FROM {_I1}
UNION ALL SELECT business_date, {result('caso_1_duplicate_trade_mvmt', 'uniqueness', 'dw_trade_movements', 'critical', 'n = 0', "'0'", 'CAST(n AS VARCHAR)', f"concat('Duplicate trade_id count for ', {_D}, ': ', n, '. Source: src_trade_movements.')")} FROM {_I1}"""
ORACLE["i2_duplicate_ids"] = f"""WITH {TRADES}, ids AS {_IDS.format(t='trades')}, ranked AS (
SELECT *, row_number() OVER (PARTITION BY business_date ORDER BY trade_id) AS r FROM ids WHERE n > 1),
samples AS (SELECT business_date, string_agg(concat('trade_id=', trade_id), '; ' ORDER BY r) AS s FROM ranked WHERE r <= 5 GROUP BY 1),
counts AS (SELECT business_date, count(*) FILTER (n > 1) AS n FROM ids GROUP BY 1)
SELECT business_date, {result('trade_id_unique_per_date', 'uniqueness', 'raw_trades', 'critical', 'n = 0', "'0 duplicate trade_ids'", "concat(n, ' duplicate trade_ids')", f"concat('Found ', n, ' duplicate trade_id values for ', {_D}, CASE WHEN s IS NULL THEN '' ELSE ': ' || s END)")}
FROM counts LEFT JOIN samples USING (business_date)"""
_I3 = "(SELECT position_date AS business_date, count(*) FILTER (price IS NULL) AS n FROM drvt GROUP BY 1)"
ORACLE["i3_null_price"] = f"""WITH {DRVT} SELECT business_date, {result('caso2_null_settlement_price', 'completeness', 'dw_drvt_positions', 'critical', 'n = 0', "'0'", 'CAST(n AS VARCHAR)', "CASE WHEN n > 0 THEN concat(n, ' rows with NULL settlement_price') ELSE 'All prices populated' END")} FROM {_I3}
UNION ALL SELECT business_date, {result('caso_2_null_settlement_price', 'completeness', 'dw_drvt_positions', 'critical', 'n = 0', "'0'", 'CAST(n AS VARCHAR)', f"concat('Null settlement_price count for ', {_D}, ': ', n, '. Source: src_drvt_positions.')")} FROM {_I3}"""


def _found(name, kind, table, noun, found, source, bad):
    return (
        f"SELECT business_date, " + result(
            name, kind, table, "critical", "n = 0", f"'0 {noun}'", f"concat(n, ' {noun}')",
            f"concat('Found ', n, ' {found} for ', {_D})")
        + f" FROM (SELECT business_date, count(*) FILTER ({bad}) AS n FROM {source} GROUP BY 1)"
    )


ORACLE["i4_null_close"] = f"WITH {CLOSE} " + _found(
    "closing_price_not_null", "completeness", "raw_close_prices", "NULL closing prices",
    "tickers with NULL closing_price", "closing", "daily_volume <= 300")
ORACLE["i5_required_fields"] = f"WITH {TRADES} " + _found(
    "trades_required_fields_not_null", "completeness", "raw_trades", "rows with NULL required fields",
    "trades with NULL required fields", "trades", "quantity = 50")
_I6 = "(SELECT position_date AS business_date, count(*) FILTER (coalesce(value, 0) = 0) AS n FROM cash GROUP BY 1)"
ORACLE["i6_zero_sum"] = f"""WITH {CASH} SELECT business_date, {result('caso3_zero_sum_positions', 'consistency', 'dw_cash_positions', 'critical', 'n = 0', "'0'", 'CAST(n AS VARCHAR)', "CASE WHEN n > 0 THEN concat(n, ' positions with long_value + short_value = 0') ELSE 'No zero-sum positions' END")} FROM {_I6}
UNION ALL SELECT business_date, {result('caso_3_zero_sum_position', 'validity', 'dw_cash_positions', 'critical', 'n = 0', "'0'", 'CAST(n AS VARCHAR)', f"concat('Zero-sum positions for ', {_D}, ': ', n, ' rows where long_value + short_value = 0. Source: src_cash_positions.')")} FROM {_I6}"""
ORACLE["i7_source_zero_sum"] = f"WITH {CASH} SELECT position_date AS business_date, count(*) FILTER (value = 0) AS zero_sum FROM cash GROUP BY 1"
ORACLE["i8_source_duplicates"] = f"WITH {SRC_TRADES} SELECT business_date, n AS duplicates FROM {_I1}"
ORACLE["i9_row_count_equal"] = f"""{_PARITY} SELECT business_date, {result('rowcount_trades_oracle_vs_dw', 'completeness', 'dw_trade_movements', 'warning', 's = t', 'CAST(s AS VARCHAR)', 'CAST(t AS VARCHAR)', "concat('Oracle=', s, ', DW=', t)")} FROM parity"""
_SHARE = "CASE WHEN s > 0 THEN " + half_up("abs(s - t) * 10000", "s") + " ELSE 0 END"
ORACLE["i10_row_count_tolerance"] = f"""{_PARITY}, shares AS (SELECT *, {_SHARE} AS e2 FROM parity)
SELECT business_date, {result('caso_4_row_count_diff_mvmt', 'row_count', 'dw_trade_movements', 'warning', 's = 0 OR abs(s - t) * 100 <= s * 5', 'CAST(s AS VARCHAR)', 'CAST(t AS VARCHAR)', "concat('Source src_trade_movements: ', s, ' rows; DW dw_trade_movements: ', t, ' rows; diff=', e2 // 100, '.', lpad(CAST(e2 % 100 AS VARCHAR), 2, '0'), '%')")} FROM shares
UNION ALL SELECT business_date, {result('caso_4_row_count_diff_mvmt', 'row_count', 'dw_trade_movements', 'warning', 'TRUE', "'oracle_unavailable'", 'CAST(t AS VARCHAR)', "concat('Oracle unavailable; DW row count = ', t, '. Cannot compare against source src_trade_movements.')")} FROM parity"""
ORACLE["i11_overflow"] = f"""WITH {TRADES} SELECT business_date, {result('caso_5_overflow_notional', 'validity', 'dw_trade_movements', 'critical', 'n = 0', "'notional <= 99999999999999.9999 AND dw_source != fault_overflow'", 'CAST(n AS VARCHAR)', f"concat('Overflow check: ', n, ' rows violating DECIMAL(18,4) contract for ', {_D}, '. Source: src_trade_movements.')")}
FROM (SELECT business_date, count(*) FILTER (quantity = 49 OR (quantity = 50 AND n4::HUGEINT * 1000000000 > 999999999999999999)) AS n FROM trades GROUP BY 1)"""
ORACLE["i12_orphan_instructions"] = f"WITH {TRADES}, {INSTR} " + _found(
    "settlement_instructions_have_matching_trade", "consistency", "raw_settlement_instructions",
    "orphan settlement instructions", "settlement instructions without a matching trade",
    "(SELECT i.business_date, t.trade_id FROM instr i LEFT JOIN (SELECT DISTINCT trade_id, business_date FROM trades) t "
    "ON t.trade_id = i.trade_id AND t.business_date = i.business_date)", "trade_id IS NULL")
ORACLE["i13_trades_without_instruction"] = f"WITH {RECON} " + _found(
    "settlement_has_trade", "consistency", "settlement_recon", "trades without instruction",
    "trades without instruction", "recon", "recon_status = 'MISSING_INSTRUCTION'")
ORACLE["i14_positive_values"] = f"WITH {TRADES} " + _found(
    "trade_price_positive", "reasonableness", "raw_trades", "trades with price <= 0", "trades with non-positive price",
    "trades", "p4 <= 10000000") + " UNION ALL " + _found(
    "trade_quantity_positive", "reasonableness", "raw_trades", "trades with quantity <= 0",
    "trades with non-positive quantity", "trades", "quantity <= 1")
ORACLE["i15_volume_range"] = f"""WITH {CLOSE}, bad AS (SELECT *, row_number() OVER (PARTITION BY business_date ORDER BY ticker, daily_volume) AS r
FROM closing WHERE daily_volume NOT BETWEEN 400 AND 1200),
samples AS (SELECT business_date, string_agg(concat('ticker=', ticker, ' daily_volume=', daily_volume), '; ' ORDER BY r) AS s FROM bad WHERE r <= 5 GROUP BY 1),
counts AS (SELECT business_date, count(*) FILTER (daily_volume NOT BETWEEN 400 AND 1200) AS n FROM closing GROUP BY 1)
SELECT business_date, {result('daily_volume_in_range', 'reasonableness', 'raw_close_prices', 'warning', 'n = 0', "'All daily_volume between 400 and 1,200'", "concat(n, ' tickers outside range')", f"concat('Found ', n, ' tickers with daily_volume outside [400, 1200] for ', {_D}, CASE WHEN s IS NULL THEN '' ELSE ': ' || s END)")}
FROM counts LEFT JOIN samples USING (business_date)"""
ORACLE["i16_quality_table"] = f"""WITH {RECON}, ct AS (SELECT count(*) AS n FROM (SELECT DISTINCT ticker, business_date FROM trades)),
checks AS (
SELECT 'completeness' AS check_type, 'closing_price_not_null' AS check_name, CAST(0 AS BIGINT) AS failures, n AS total_rows FROM ct
UNION ALL SELECT 'uniqueness', 'trade_id_unique', count(*) - count(DISTINCT trade_id), count(*) FROM trades
UNION ALL SELECT 'consistency', 'settlement_has_trade', count(*) FILTER (recon_status = 'MISSING_INSTRUCTION'), count(*) FROM recon
UNION ALL SELECT 'reasonableness', 'price_positive', count(*) FILTER (p4 <= 0), count(*) FROM trades
UNION ALL SELECT 'reasonableness', 'quantity_positive', count(*) FILTER (quantity <= 0), count(*) FROM trades)
SELECT check_type, check_name, 'critical' AS severity, failures, total_rows, failures = 0 AS passed,
{scaled(half_up('(total_rows - failures) * 10000', 'total_rows'), 2)} AS pass_rate FROM checks"""
ORACLE["i17_timeliness"] = f"""WITH {RUNS} SELECT business_date, {result('timeliness_sla_check', 'timeliness', 'job_runs', 'info', 'n = 0', "'0 SLA misses'", "concat(n, ' SLA misses')", f"concat('Found ', n, ' of ', total, ' attempts over their SLA for ', {_D})")}
FROM (SELECT business_date, count(*) FILTER (sla_miss) AS n, count(*) AS total FROM runs GROUP BY 1)"""
ORACLE["i18_expect_sql"] = """WITH c AS (SELECT count(*) FILTER (o_orderdate >= DATE '1998-06-01') AS n, count(*) AS total FROM orders)
SELECT CAST(0 AS BIGINT) AS case_no, CASE WHEN n > 2 THEN 'success' ELSE 'failed' END AS status, n AS row_count, CAST(least(n, 3) AS BIGINT) AS sampled,
  CASE WHEN n <= 2 THEN concat('DQ check failed: row_count=', n, ', expected > 2') END AS error FROM c
UNION ALL SELECT 1, CASE WHEN n = 3 THEN 'success' ELSE 'failed' END, n, least(n, 3), CASE WHEN n <> 3 THEN concat('DQ check failed: row_count=', n, ', expected == 3') END FROM c
UNION ALL SELECT 2, 'failed', 1, 1, concat('DQ check failed: first cell=', total, ', expected == -1') FROM c
UNION ALL SELECT 3, 'success', n, least(n, 3), NULL FROM c"""
_ZERO_RULES = [
    ("raw_trades", r) for r in (
        "trade_id:not_null", "trade_id:length", "order_id:length", "ticker:not_null", "trade_time:not_null",
        "trade_time:type", "price:not_null", "price:type", "quantity:not_null", "quantity:type",
        "buyer_participant:not_null", "buyer_participant:length", "seller_participant:not_null",
        "seller_participant:length", "business_date:not_null", "business_date:type")
] + [
    ("raw_settlement_instructions", r) for r in (
        "instruction_id:not_null", "instruction_id:length", "trade_id:not_null", "trade_id:length",
        "settlement_date:not_null", "settlement_date:type", "quantity:not_null", "quantity:type", "amount:not_null",
        "amount:type", "business_date:not_null", "business_date:type")
] + [
    ("raw_close_prices", r) for r in (
        "ticker:not_null", "ticker:length", "business_date:not_null", "business_date:type", "closing_price:type",
        "daily_volume:type", "vwap:type", "auction_flag:type")
]
ORACLE["i19_contract"] = f"""WITH {TRADES}, {INSTR}, rules AS (
SELECT 'raw_trades' AS target_table, 'order_id:not_null' AS rule, count(*) FILTER (quantity = 50) AS failures FROM trades
UNION ALL SELECT 'raw_trades', 'ticker:length', count(*) FILTER (quantity = 1) FROM trades
UNION ALL SELECT 'raw_settlement_instructions', 'status:domain', count(*) FILTER (quantity = 7) FROM instr
UNION ALL SELECT 'raw_close_prices', 'ticker,business_date:unique', count(*) FROM (SELECT DISTINCT ticker, business_date FROM trades)
UNION ALL SELECT t, r, 0 FROM (VALUES {', '.join(f"('{t}', '{r}')" for t, r in _ZERO_RULES)}) v(t, r))
SELECT target_table, rule, failures, failures = 0 AS passed FROM rules"""
ORACLE["i20_all_in_one"] = f"""WITH {SRC_TRADES}, {DRVT}, {CASH}, a AS (SELECT * FROM {_I1}), b AS (SELECT * FROM {_I3}), c AS (SELECT * FROM {_I6}),
j AS (SELECT business_date, coalesce(a.n, 0) AS dups, coalesce(b.n, 0) AS nulls, coalesce(c.n, 0) AS zeros
FROM a FULL JOIN b USING (business_date) FULL JOIN c USING (business_date))
SELECT *, dups = 0 AND nulls = 0 AND zeros = 0 AS passed FROM j"""
ORACLE["i21_gate"] = f"WITH {DQ_LATEST} SELECT business_date, {_GATE} FROM latest GROUP BY business_date"
ORACLE["i22_publish_guard"] = f"""WITH {DQ_LATEST} SELECT business_date, count(*) FILTER (NOT passed AND severity = 'critical') AS failed_critical,
count(*) FILTER (NOT passed AND severity = 'critical') = 0 AS publish_allowed, 'latest' AS policy FROM latest GROUP BY 1
UNION ALL SELECT business_date, count(*) FILTER (NOT passed AND severity = 'critical'),
count(*) FILTER (NOT passed AND severity = 'critical') = 0, 'all' FROM dq GROUP BY 1"""

# --- J ----------------------------------------------------------------------
ORACLE["j1_close_prices"] = f"""WITH {CLOSE} SELECT ticker, business_date, {scaled('c4', 4)} AS closing_price, CAST(daily_volume AS BIGINT) AS daily_volume,
{scaled('vwap6', 6)} AS vwap, trade_count, {scaled('n4', 4)} AS total_notional, FALSE AS auction_flag FROM closing"""
ORACLE["j2_close_snapshot"] = f"""WITH {CLOSE} SELECT ticker, business_date, {scaled('c4', 4)} AS closing_price, CAST(daily_volume * 500 AS BIGINT) AS daily_volume,
{scaled('vwap6', 6)} AS vwap, trade_count, {scaled('n4', 4)} AS total_notional,
CASE WHEN daily_volume * 500 > 1000000 THEN 'HIGH' WHEN daily_volume * 500 > 100000 THEN 'MEDIUM' ELSE 'LOW' END AS volume_category FROM closing"""
ORACLE["j3_settlement_recon"] = f"""WITH {RECON} SELECT business_date, recon_status, settlement_status, count(*) AS "rows", {scaled('sum(n4)', 4)} AS notional
FROM recon GROUP BY business_date, recon_status, settlement_status"""
ORACLE["j4_position_recon"] = f"""WITH {POSRECON} SELECT business_date, recon_status, count(*) AS positions, CAST(sum(diff) AS BIGINT) AS total_diff
FROM posrecon GROUP BY ALL"""
ORACLE["j5_d1_settlement_report"] = ORACLE["d5_settlement_report"]
ORACLE["j6_participant_exposure_report"] = f"""WITH {POSRECON}, {CLOSE.removeprefix(TRADES + ', ')}
SELECT p.pid AS participant_id, p.ticker, p.business_date, declared AS declared_quantity, traded AS traded_net_qty, diff AS quantity_diff,
recon_status, {scaled('c.c4', 4)} AS closing_price, {scaled('declared * coalesce(c.c4, 0)', 4)} AS mark_to_market,
{scaled('diff * coalesce(c.c4, 0)', 4)} AS exposure_diff
FROM posrecon p LEFT JOIN closing c ON c.ticker = p.ticker AND c.business_date = p.business_date"""
ORACLE["j6_exposure_one_pass"] = ORACLE["j6_participant_exposure_report"]
ORACLE["j7_derive_instructions"] = f"""WITH {TRADES} SELECT {uid("concat_ws('-', 'instruction', trade_id, business_date)")} AS instruction_id, trade_id,
business_date + 2 AS settlement_date, buyer AS participant, ticker, quantity, {scaled('n4', 4)} AS amount, 'MATCHED' AS status, business_date FROM trades"""
ORACLE["j8_derive_positions"] = f"""WITH {TRADES}, {POS} SELECT {uid("concat_ws('-', 'position', pid, ticker, business_date)")} AS position_id, ticker,
pid AS participant, business_date, greatest(q, 0) AS long_qty, abs(least(q, 0)) AS short_qty, q AS net_qty, {scaled('a4', 4)} AS settlement_price,
{scaled('greatest(q, 0) * a4', 4)} AS long_value, {scaled('least(q, 0) * a4', 4)} AS short_value, {scaled('q * a4', 4)} AS net_value FROM pos"""
_STORED = f"{SRC_TRADES}, {DRVT}, {CASH}"
ORACLE["j9_load_tables"] = f"""WITH {_STORED}
SELECT 'dw_trade_movements' AS table_name, business_date, 'oracle' AS dw_source, count(*) AS "rows", {scaled('sum(n4)', 4)} AS measure FROM (SELECT * FROM src WHERE status IS NOT NULL) GROUP BY business_date
UNION ALL SELECT 'dw_drvt_positions', position_date, 'oracle', count(*), {scaled('sum(CAST(round(price * 10000) AS BIGINT))', 4)} FROM drvt GROUP BY position_date
UNION ALL SELECT 'dw_cash_positions', position_date, 'oracle', count(*), {scaled('sum(coalesce(CAST(round(value * 10000) AS BIGINT), 0))', 4)} FROM cash GROUP BY position_date"""
_TEXT4 = "CAST(CAST({} AS DECIMAL(18,4)) AS VARCHAR)"
ORACLE["j10_publish"] = f"""WITH {SRC_TRADES}, {DRVT}, {CASH}, stored AS (SELECT * FROM src WHERE status IS NOT NULL),
good_t AS (SELECT business_date FROM {_IDS.format(t='stored')} GROUP BY 1 HAVING sum(n - 1) = 0),
good_p AS (SELECT position_date FROM drvt GROUP BY 1 HAVING count(*) FILTER (price IS NULL) = 0),
good_c AS (SELECT position_date FROM cash GROUP BY 1 HAVING count(*) FILTER (coalesce(value, 0) = 0) = 0)
SELECT 'dw_trade_movements' AS table_name, trade_id AS id, {scaled('n4', 4)} AS measure, CAST(NULL AS VARCHAR) AS "text", business_date AS dt
FROM stored WHERE business_date IN (SELECT business_date FROM good_t)
UNION ALL SELECT 'dw_drvt_positions', position_id, CAST(price AS DOUBLE), NULL, position_date FROM drvt
WHERE position_date IN (SELECT position_date FROM good_p) AND position_date NOT IN (
  SELECT position_date FROM cash WHERE position_date NOT IN (SELECT position_date FROM good_c))
UNION ALL SELECT 'dw_cash_positions', position_id, CAST(net_value AS DOUBLE),
concat({_TEXT4.format('long_value')}, '|', {_TEXT4.format('short_value')}), position_date FROM ({_CASH_MAPPED})
WHERE position_date IN (SELECT position_date FROM good_c) AND position_date NOT IN (
  SELECT position_date FROM drvt WHERE position_date NOT IN (SELECT position_date FROM good_p))"""
ORACLE["j11_run_d1"] = f"""WITH {SRC_TRADES}, {DRVT}, {CASH}, stored AS (SELECT * FROM src WHERE status IS NOT NULL),
t AS (SELECT business_date, sum(n - 1) AS dups, sum(n) AS n FROM {_IDS.format(t='stored')} GROUP BY 1),
s AS (SELECT business_date, count(*) AS n FROM src GROUP BY 1),
p AS (SELECT position_date AS business_date, count(*) AS n, count(*) FILTER (price IS NULL) AS nulls FROM drvt GROUP BY 1),
c AS (SELECT position_date AS business_date, count(*) AS n, count(*) FILTER (coalesce(value, 0) = 0) AS zeros FROM cash GROUP BY 1),
checks AS (
  SELECT business_date, dups = 0 AS passed, TRUE AS critical FROM t
  UNION ALL SELECT business_date, coalesce(t.n, 0) = coalesce(s.n, 0), FALSE FROM t FULL JOIN s USING (business_date)
  UNION ALL SELECT business_date, nulls = 0, TRUE FROM p UNION ALL SELECT business_date, TRUE, FALSE FROM p
  UNION ALL SELECT business_date, zeros = 0, TRUE FROM c),
g AS (SELECT business_date, count(*) AS checks_run, count(*) FILTER (NOT passed) AS checks_failed,
  count(*) FILTER (NOT passed AND critical) AS critical_failures FROM checks GROUP BY 1)
SELECT business_date, checks_run, checks_failed, critical_failures, CASE WHEN critical_failures = 0 THEN 'PASS' ELSE 'FAIL' END AS gate_status,
CAST(coalesce(t.n, 0) AS BIGINT) AS dw_trade_movements_rows, coalesce(p.n, 0) AS dw_drvt_positions_rows, coalesce(c.n, 0) AS dw_cash_positions_rows,
critical_failures = 0 AS published FROM g LEFT JOIN t USING (business_date) LEFT JOIN p USING (business_date) LEFT JOIN c USING (business_date)"""
ORACLE["j11_run_d1_g2"] = f"""WITH {SRC_TRADES}, {DRVT}, {CASH}, stored AS (SELECT * FROM src),
t AS (SELECT business_date, sum(n - 1) AS dups, sum(n) AS n FROM {_IDS.format(t='stored')} GROUP BY 1),
s AS (SELECT business_date, count(*) AS n FROM src GROUP BY 1),
p AS (SELECT position_date AS business_date, count(*) AS n, count(*) FILTER (price IS NULL) AS nulls FROM drvt GROUP BY 1),
c AS (SELECT position_date AS business_date, count(*) AS n, count(*) FILTER (coalesce(value, 0) = 0) AS zeros FROM cash GROUP BY 1),
checks AS (
  SELECT business_date, dups = 0 AS passed, TRUE AS critical FROM t
  UNION ALL SELECT business_date, coalesce(t.n, 0) = coalesce(s.n, 0), TRUE FROM t FULL JOIN s USING (business_date)
  UNION ALL SELECT business_date, nulls = 0, TRUE FROM p UNION ALL SELECT business_date, TRUE, TRUE FROM p
  UNION ALL SELECT business_date, TRUE, TRUE FROM c UNION ALL SELECT business_date, TRUE, TRUE FROM t
  UNION ALL SELECT business_date, zeros = 0, TRUE FROM c),
g AS (SELECT business_date, count(*) AS checks_run, count(*) FILTER (NOT passed) AS checks_failed,
  count(*) FILTER (NOT passed AND critical) AS critical_failures FROM checks GROUP BY 1)
SELECT business_date, checks_run, checks_failed, critical_failures, CASE WHEN critical_failures = 0 THEN 'PASS' ELSE 'FAIL' END AS gate_status,
CAST(coalesce(t.n, 0) AS BIGINT) AS dw_trade_movements_rows, coalesce(p.n, 0) AS dw_drvt_positions_rows, coalesce(c.n, 0) AS dw_cash_positions_rows,
critical_failures = 0 AS published FROM g LEFT JOIN t USING (business_date) LEFT JOIN p USING (business_date) LEFT JOIN c USING (business_date)"""
ORACLE["j12_publish_reports"] = f"""WITH {POSRECON}, {INSTR}, r AS (SELECT t.business_date FROM trades t LEFT JOIN instr i ON i.trade_id = t.trade_id)
SELECT dt, 'settlement' AS report, CAST(1 AS BIGINT) AS "rows", n AS measure FROM (SELECT business_date AS dt, count(*) AS n FROM r GROUP BY 1)
UNION ALL SELECT business_date, 'exposure', count(*), CAST(sum(diff) AS BIGINT) FROM posrecon GROUP BY business_date"""

# --- K ----------------------------------------------------------------------
ORACLE["k1_parse_logs"] = f"""WITH {RUNS} SELECT CAST(event_id AS VARCHAR) AS trace_id, ts AS "timestamp", job_name AS ctm_job, business_date AS ctm_order_date,
run_id AS ctm_run_id, status AS job_status, sla_miss, duration_seconds FROM runs WHERE event_id % 10 <> 3"""


def _windows(length: int, pred: str, by: str, source: str = "runs") -> str:
    cols = f"{by}, " if by else ""
    return f"""SELECT window_start, window_start + INTERVAL {length} MINUTE AS window_end, {cols}count(*) AS hits FROM (
SELECT *, date_trunc('minute', ts) - to_minutes(i) AS window_start FROM {source}, (SELECT unnest(range(0, {length})) AS i) WHERE {pred}) GROUP BY ALL"""


ORACLE["k2_job_failures_5m"] = f"WITH {RUNS} " + _windows(5, "status = 'failed'", "job_name")
ORACLE["k3_sla_misses_10m"] = f"WITH {RUNS} " + _windows(10, "sla_miss", "job_name")
ORACLE["k4_gate_failures_10m"] = f"WITH {RUNS} " + _windows(10, "status = 'failed' AND job_name = 'quality_gate_d1'", "")
_ALERT = "['duplicates', 'null_column', 'zero_sum', 'row_count'][k % 4 + 1]"
ORACLE["k5_log_alerts_5m"] = f"WITH {RUNS}, alerts AS (SELECT ts, {_ALERT} AS alert FROM runs WHERE status = 'failed') " + _windows(5, "TRUE", "alert", "alerts")
ORACLE["k6_no_publish_30m"] = f"""WITH {RUNS}, spine AS (
SELECT unnest(generate_series(min(date_trunc('minute', ts)), max(date_trunc('minute', ts)), INTERVAL 1 MINUTE)) AS "at" FROM runs),
seen AS (SELECT DISTINCT date_trunc('minute', ts) + to_minutes(i) AS "at" FROM runs, (SELECT unnest(range(0, 30)) AS i)
WHERE job_name = 'publish_d1_reports' AND status = 'success')
SELECT "at" FROM spine WHERE "at" NOT IN (SELECT "at" FROM seen)"""
_MEAN = half_up("sum(v6)", "count(*)")
ORACLE["k7_threshold_alert"] = f"""WITH {RUNS} SELECT window_start, window_start + INTERVAL 5 MINUTE AS window_end, {scaled('m', 6)} AS mean_value,
CASE WHEN m > 60000000 THEN 'critical' WHEN m > 40000000 THEN 'warning' ELSE 'ok' END AS level
FROM (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, {_MEAN} AS m FROM runs GROUP BY 1)"""
ORACLE["k8_duration_by_job"] = f"""WITH {RUNS} SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, job_name,
{scaled(_MEAN, 6)} AS avg_duration FROM runs GROUP BY 1, 2, 3"""
ORACLE["k8_duration_p95"] = f"""WITH {RUNS} SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, job_name,
{scaled(_MEAN, 6)} AS avg_duration, quantile_disc(duration_seconds, 0.95) AS p_duration FROM runs GROUP BY 1, 2, 3"""
ORACLE["k8_quantile_sketches"] = f"""WITH {RUNS} SELECT job_name, date_trunc('day', ts) AS window_start, count(*) AS "rows",
TRUE AS p50_within, TRUE AS p95_within, TRUE AS p99_within FROM runs GROUP BY 1, 2"""
ORACLE["k9_outcome_by_job"] = f"""WITH {RUNS} SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, job_name,
count(*) FILTER (status = 'success') AS ended_ok, count(*) FILTER (status = 'failed') AS ended_not_ok FROM runs GROUP BY 1, 2, 3"""
ORACLE["k10_job_table"] = f"""WITH {RUNS} SELECT job_name, count(*) FILTER (status = 'success') AS ended_ok, count(*) FILTER (status = 'failed') AS ended_not_ok,
{scaled(_MEAN, 6)} AS avg_duration, arg_max(k, struct_pack(a := ts, b := event_id)) AS last_output_rows, max(k % 3) AS max_retries FROM runs GROUP BY 1"""
ORACLE["k11_pipeline_table"] = f"""WITH {_SUMMARY}, counted AS (SELECT *, count(*) FILTER (jobs_notok = 0) OVER w AS ok_counter,
count(*) FILTER (jobs_notok > 0) OVER w AS notok_counter, row_number() OVER (PARTITION BY business_date ORDER BY finished_at DESC, run_id DESC) AS r
FROM summary WINDOW w AS (ORDER BY finished_at, run_id ROWS UNBOUNDED PRECEDING))
SELECT business_date, max(ok_counter) FILTER (r = 1) AS last_ok, max(notok_counter) FILTER (r = 1) AS last_notok,
max(duration_seconds) FILTER (r = 1) AS last_duration, max(jobs_ok) AS max_jobs_ok, max(jobs_notok) AS max_jobs_notok FROM counted GROUP BY 1"""
ORACLE["k12_headline_kpis"] = f"""WITH {RUNS}, {DQ} SELECT count(*) AS executions, count(*) FILTER (status = 'success') AS ended_ok,
count(*) FILTER (status = 'failed') AS ended_not_ok, count(*) FILTER (sla_miss) AS sla_violations,
(SELECT count(*) FROM dq WHERE NOT passed) AS dq_failed FROM runs"""
ORACLE["k12_distinct_sketches"] = f"""WITH {RUNS} SELECT CAST(date_trunc('month', business_date) AS DATE) AS month,
count(DISTINCT run_id) AS exact_runs, count(DISTINCT user_id) AS exact_users, count(DISTINCT date_trunc('hour', ts)) AS exact_hours,
TRUE AS runs_within, TRUE AS users_within, TRUE AS hours_within FROM runs GROUP BY 1"""
_DAYS = "date_trunc('day', created_at) AS window_start, date_trunc('day', created_at) + INTERVAL 1 DAY AS window_end"
ORACLE["k13_check_failures_over_time"] = f"WITH {DQ} SELECT {_DAYS}, check_name, count(*) FILTER (NOT passed) AS failures FROM dq GROUP BY 1, 2, 3"
ORACLE["k13_check_detail"] = f"""WITH {DQ} SELECT check_name, target_table, severity, count(*) AS runs,
NOT arg_max(passed, struct_pack(a := created_at, b := result_id)) AS last_failed,
arg_max(actual_value, struct_pack(a := created_at, b := result_id)) AS last_value FROM dq GROUP BY 1, 2, 3"""
ORACLE["k13_failures_by_type"] = f"""WITH {DQ} SELECT check_type, count(*) FILTER (NOT passed) AS failures FROM dq GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""
ORACLE["k13_row_count_trend"] = f"""WITH {DQ} SELECT {_DAYS}, max(CAST(actual_value AS DOUBLE)) AS max_value FROM dq WHERE check_name = 'row_count' GROUP BY 1, 2"""
ORACLE["k14_pass_rate"] = f"""WITH {DQ}, r AS (SELECT count(*) AS total, count(*) FILTER (NOT passed) AS failed,
count(*) FILTER (NOT passed AND severity = 'critical') AS critical FROM dq GROUP BY business_date, run_id)
SELECT count(*) AS runs, {scaled(half_up('(sum(total) - sum(failed)) * 1000000', 'sum(total)'), 4)} AS pass_rate,
{scaled(half_up('sum(critical) * 10000', 'count(*)'), 4)} AS avg_critical_failures FROM r"""
ORACLE["k15_gauges_side_by_side"] = f"""{_GAUGES}, named AS (SELECT business_date, value, metric LIKE 'exchange.oracle.%' AS source,
CASE WHEN metric LIKE '%.trade_m%' THEN 'trades' WHEN metric LIKE '%.derivative_position%' THEN 'derivatives' ELSE 'cash' END AS measure FROM gauges
WHERE metric IN ('exchange.oracle.trade_mvmt_source_count', 'exchange.dw.trade_movements_destination_count', 'exchange.oracle.derivative_position_source_count',
'exchange.dw.derivative_positions_destination_count', 'exchange.oracle.cash_position_source_count', 'exchange.dw.cash_positions_destination_count'))
SELECT business_date, measure, max(value) FILTER (source) AS source_value, max(value) FILTER (NOT source) AS dw_value FROM named GROUP BY 1, 2"""
ORACLE["k16_running_totals_stream"] = f"""WITH {RUNS} SELECT job_name, count(*) FILTER (status = 'success') AS ended_ok,
count(*) FILTER (status = 'failed') AS ended_not_ok, count(*) FILTER (sla_miss) AS sla_violations FROM runs GROUP BY 1"""
_SILENT = f"""WITH {RUNS}, seen AS (SELECT DISTINCT date_trunc('minute', ts) AS m, job_name FROM runs
WHERE job_name = 'publish_d1_reports' AND status = 'success'),
gaps AS (SELECT job_name, m, lead(m) OVER (ORDER BY m) AS n FROM seen)"""
ORACLE["k6_stream_absence"] = f"""{_SILENT} SELECT job_name, m + INTERVAL 30 MINUTE AS overdue_at FROM gaps
WHERE n - m > INTERVAL 30 MINUTE"""
ORACLE["k17_renotifications"] = f"""WITH {RUNS}, seen AS (SELECT DISTINCT job_name, date_trunc('minute', ts) AS m FROM runs WHERE status = 'failed'),
marked AS (SELECT *, CASE WHEN m - lag(m) OVER w <= INTERVAL 120 MINUTE THEN 0 ELSE 1 END AS opened FROM seen WINDOW w AS (PARTITION BY job_name ORDER BY m)),
episodes AS (SELECT job_name, e, min(m) AS opened_at, max(m) AS last_seen FROM (
SELECT *, sum(opened) OVER (PARTITION BY job_name ORDER BY m) AS e FROM marked) GROUP BY 1, 2),
n AS (SELECT job_name, opened_at, unnest(generate_series(opened_at, last_seen, INTERVAL 60 MINUTE)) AS notify_at FROM episodes)
SELECT job_name, opened_at, notify_at, date_diff('hour', opened_at, notify_at) AS repeat,
CASE WHEN notify_at > opened_at THEN concat('ESCALATION: unresolved after ', date_diff('minute', opened_at, notify_at), ' minutes') ELSE 'ALERT' END AS text FROM n"""
ORACLE["k17_stream_renotify"] = f"""WITH {RUNS}, seen AS (SELECT DISTINCT job_name, date_trunc('minute', ts) AS m FROM runs WHERE status = 'failed'),
marked AS (SELECT *, CASE WHEN m - lag(m) OVER w <= INTERVAL 120 MINUTE THEN 0 ELSE 1 END AS opened FROM seen WINDOW w AS (PARTITION BY job_name ORDER BY m)),
episodes AS (SELECT job_name, e, min(m) AS opened_at, max(m) AS last_seen FROM (
SELECT *, sum(opened) OVER (PARTITION BY job_name ORDER BY m) AS e FROM marked) GROUP BY 1, 2),
n AS (SELECT job_name, opened_at, unnest(generate_series(opened_at, last_seen, INTERVAL 60 MINUTE)) AS notify_at FROM episodes)
SELECT job_name, opened_at, notify_at, date_diff('hour', opened_at, notify_at) AS repeat FROM n"""
_KIND = "CASE status WHEN 'success' THEN 'COMPLETE' WHEN 'failed' THEN 'FAIL' ELSE 'START' END"
ORACLE["k18_lineage_health"] = f"""WITH {RUNS} SELECT job_name, {_KIND} AS event_type, count(*) AS total, max(ts) AS last_seen FROM runs
WHERE ts > (SELECT max(ts) FROM runs) - INTERVAL 1440 MINUTE GROUP BY 1, 2"""
ORACLE["k19_run_summary"] = f"WITH {_SUMMARY} SELECT * FROM summary"
ORACLE["k20_first_failure"] = f"""WITH {RUNS} SELECT run_id, arg_min(job_name, position) AS first_failed_job, 4 - min(position) AS jobs_not_run
FROM runs WHERE status = 'failed' GROUP BY 1"""
ORACLE["k21_retry_accounting"] = f"""WITH {RUNS} SELECT run_id, job_name, count(*) AS attempts, max(k % 3) AS max_retries, arg_max(status, ts) AS final_status,
count(*) FILTER (sla_miss) AS attempts_over_sla, {scaled('sum(v6)', 6)} AS total_duration FROM runs GROUP BY 1, 2"""
ORACLE["k22_logs_for_run"] = f"""WITH {RUNS} SELECT event_id, ts, job_name, status, {MESSAGE} AS message FROM runs
WHERE run_id = (SELECT run_id FROM runs GROUP BY 1 ORDER BY count(*) DESC, run_id LIMIT 1)"""

# --- L ----------------------------------------------------------------------
_DECLARED = ", ".join(
    f"('{job}', '{side[:-1]}', '{ns}', '{name}')" for job, io in JOB_IO.items() for side in ("inputs", "outputs") for ns, name in io[side])
ORACLE["l1_lineage_edges"] = f"""WITH {RUNS}, seen AS (SELECT job_name AS job, count(*) AS runs FROM runs GROUP BY 1)
SELECT job, direction, namespace, name, runs FROM (VALUES {_DECLARED}) e(job, direction, namespace, name) FULL JOIN seen USING (job)"""
ORACLE["l1_observed_edges"] = f"WITH {EDGES} SELECT * FROM edges"
ORACLE["l2_external_io"] = f"{_EXTERNAL} SELECT direction, count(*) AS datasets FROM external_io GROUP BY 1"
ORACLE["l3_impact"] = f"""WITH RECURSIVE {EDGES},
hops AS (SELECT DISTINCT i.name AS a, o.name AS b FROM edges i JOIN edges o ON o.job = i.job AND i.direction = 'input' AND o.direction = 'output'),
down(name, depth) AS (SELECT b, 1 FROM hops WHERE a = 'ds_1_0' UNION SELECT b, depth + 1 FROM down JOIN hops ON a = name WHERE depth < 60),
up(name, depth) AS (SELECT a, 1 FROM hops WHERE b = 'ds_100_0' UNION SELECT a, depth + 1 FROM up JOIN hops ON b = name WHERE depth < 60)
SELECT 'downstream' AS direction, 'events' AS namespace, name, CAST(min(depth) AS BIGINT) AS depth FROM down WHERE name <> 'ds_1_0' GROUP BY name
UNION ALL SELECT 'upstream', 'events', name, min(depth) FROM up WHERE name <> 'ds_100_0' GROUP BY name"""
ORACLE["l4_sql_inputs"] = f"SELECT DISTINCT doc_id, unnest({_REFS}) AS table_name FROM documents"
_RUN_ID = uid("concat_ws('-', job_name, business_date, strftime(ts, '%Y%m%dT%H%M'))")
_PARENT = uid("concat_ws('-', 'd1_pipeline', business_date, strftime(ts, '%Y%m%dT%H'))")
ORACLE["l5_run_events"] = f"""WITH {RUNS} SELECT job_name, {_KIND} AS event_type, {_RUN_ID} AS run_id,
concat(strftime(ts, '%Y-%m-%dT%H:%M:%S.'), lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0'), 'Z') AS event_time, {_PARENT} AS parent_run_id,
CASE WHEN status = 'failed' THEN concat('error code ', k) END AS error,
['src_trade_movements', 'src_cash_positions', 'dw_cash_positions', 'dq_results'][position] AS first_input,
['dw_trade_movements', 'dw_cash_positions', 'dq_results', 'derivatives/dw_drvt_positions.parquet'][position] AS first_output,
CASE WHEN status = 'success' THEN k END AS row_count FROM runs"""
ORACLE["l6_run_ids"] = f"WITH {RUNS} SELECT event_id, {_RUN_ID} AS ol_run_id, {_PARENT} AS ol_parent_run_id FROM runs"

# --- M ----------------------------------------------------------------------
ORACLE["m1_duplicate_rows"] = f"""SELECT 'same' AS kind, o_orderkey AS trade_id, CAST(CASE WHEN o_orderkey IN (SELECT o_orderkey FROM orders ORDER BY {position('o_orderkey', 3)} LIMIT 4)
THEN 2 ELSE 1 END AS BIGINT) AS copies, o_custkey FROM orders
UNION ALL SELECT 'changed', o_orderkey, CASE WHEN hit THEN 2 ELSE 1 END, o_custkey + CASE WHEN hit THEN 1000000 ELSE 0 END FROM (
SELECT *, o_orderkey IN (SELECT o_orderkey FROM orders ORDER BY {position('o_orderkey', 4)} LIMIT 4) AS hit FROM orders)"""
ORACLE["m2_null_column"] = f"""WITH {DRVT} SELECT position_id, position_date,
CASE WHEN {position('position_id', 5)} IN {picked('drvt', 'position_id', 5, 0.05)} THEN NULL ELSE price END AS settlement_price, 'share' AS kind FROM drvt
UNION ALL SELECT position_id, position_date, CASE WHEN position_id IN (SELECT position_id FROM drvt ORDER BY 1 LIMIT 8) THEN NULL ELSE price END, 'first' FROM drvt"""
ORACLE["m3_zero_sum"] = f"""WITH {CASH} SELECT position_date, 'oracle' AS dw_source, count(*) AS "rows", count(*) FILTER (coalesce(value, 0) = 0) AS zero_sum FROM cash GROUP BY 1
UNION ALL SELECT DATE '2024-01-05', 'fault_injection', 5, 5
UNION ALL SELECT position_date, 'forced', count(*), count(*) FILTER (value = 0 OR position_id IN (SELECT position_id FROM cash ORDER BY 1 LIMIT 6)) FROM cash GROUP BY 1"""
ORACLE["m4_overflow"] = f"""WITH {TRADES} SELECT business_date, {result('caso_5_overflow_notional', 'validity', 'dw_trade_movements', 'critical', 'n = 0', "'notional <= 99999999999999.9999 AND dw_source != fault_overflow'", 'CAST(n AS VARCHAR)', f"concat('Overflow check: ', n, ' rows violating DECIMAL(18,4) contract for ', {_D}, '. Source: src_trade_movements.')")}
FROM (SELECT DISTINCT business_date, CASE WHEN business_date = DATE '1998-06-01' THEN 1 ELSE 0 END AS n FROM (SELECT business_date FROM trades UNION ALL SELECT DATE '1998-06-01'))"""
ORACLE["m5_drop_fraction"] = f"SELECT o_orderkey, o_orderdate FROM orders WHERE {position('o_orderkey', 7)} NOT IN {picked('orders', 'o_orderkey', 7, 0.10)}"
_TWO = f"(SELECT ticker FROM closing GROUP BY 1 ORDER BY {position('ticker', 2)} LIMIT 2)"
ORACLE["m6_null_close"] = f"""WITH {CLOSE} SELECT ticker, business_date, CASE WHEN ticker NOT IN {_TWO} THEN {scaled('c4', 4)} END AS closing_price,
CASE WHEN ticker NOT IN {_TWO} THEN {scaled('vwap6', 6)} END AS vwap FROM closing"""
_HEX = "'0123456789abcdef'"
_MOD3 = " + ".join(f"(instr({_HEX}, substr(h, {i + 1}, 1)) - 1) * {16 ** (7 - i)}" for i in range(8))
ORACLE["m7_late_settlement"] = f"""WITH {INSTR},
placed AS (SELECT instruction_id, settlement_date, status, business_date, {position('instruction_id', 9)} AS h FROM instr),
cut AS (SELECT max(h) AS c FROM (SELECT h FROM placed ORDER BY h LIMIT 50))
SELECT instruction_id, CASE WHEN h <= c THEN settlement_date + CAST(({_MOD3}) % 3 + 1 AS INT) ELSE settlement_date END AS settlement_date,
CASE WHEN h <= c THEN 'FAILED' ELSE status END AS status, business_date FROM placed, cut"""
ORACLE["m8_volume_spike"] = f"""WITH {TRADES}, pick AS (SELECT ticker FROM trades GROUP BY 1 ORDER BY {position('ticker', 6)} LIMIT 1),
template AS (SELECT p4, quantity FROM trades WHERE ticker = (SELECT ticker FROM pick) ORDER BY trade_id, order_id, p4, quantity, buyer, seller, trade_time LIMIT 1),
base AS (SELECT ticker, count(*) AS n, sum(quantity) AS q, sum(p4) AS p, count(DISTINCT order_id) AS o FROM trades GROUP BY 1)
SELECT ticker, CAST(CASE WHEN ticker = (SELECT ticker FROM pick) THEN 11 * n ELSE n END AS BIGINT) AS trades,
CAST(CASE WHEN ticker = (SELECT ticker FROM pick) THEN o + 10 * n ELSE o END AS BIGINT) AS orders,
CAST(q + CASE WHEN ticker = (SELECT ticker FROM pick) THEN 10 * n * (SELECT quantity FROM template) ELSE 0 END AS BIGINT) AS quantity,
{scaled('p + CASE WHEN ticker = (SELECT ticker FROM pick) THEN 10 * n * (SELECT p4 FROM template) ELSE 0 END', 4)} AS price FROM base"""
