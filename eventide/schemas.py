"""Table schemas, contracts and fixed values of the daily market pipeline."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# --- source layer -----------------------------------------------------------
SRC_TRADE_MOVEMENTS = (
    "trade_id string not null, trade_dt date not null, instrument_code string not null, "
    "buy_participant string, sell_participant string, quantity decimal(15,0) not null, "
    "closing_price decimal(18,6) not null, gross_value decimal(22,6), settlement_dt date, "
    "status string, business_date date not null, created_at timestamp"
)
SRC_DRVT_POSITIONS = (
    "position_id string not null, position_date date not null, participant_code string not null, "
    "instrument_code string not null, net_quantity decimal(15,0) not null, "
    "long_quantity decimal(15,0), short_quantity decimal(15,0), market_value decimal(22,6), "
    "business_date date not null, updated_at timestamp"
)
SRC_CASH_POSITIONS = (
    "position_id string not null, position_date date not null, participant_code string not null, "
    "instrument_code string not null, net_quantity decimal(15,0) not null, "
    "settlement_value decimal(22,6), business_date date not null"
)

# --- warehouse layer --------------------------------------------------------
AUDIT = "dw_load_dt timestamp not null, dw_source string not null, dw_row_hash string"
DW_TRADE_MOVEMENTS = (
    "trade_id string not null, ticker string not null, notional decimal(18,4) not null, "
    "quantity decimal(14,0) not null, trade_dt date not null, settlement_dt date, "
    "counterparty_id string, trader_id string, desk_code string, status string not null, " + AUDIT
)
DW_DRVT_POSITIONS = (
    "position_id string not null, instrument_id string not null, participant_code string not null, "
    "position_date date not null, long_qty decimal(14,4) not null, short_qty decimal(14,4) not null, "
    "net_qty decimal(14,4) not null, settlement_price decimal(18,6), margin_value decimal(18,4), " + AUDIT
)
DW_CASH_POSITIONS = (
    "position_id string not null, ticker string not null, participant_code string not null, "
    "position_date date not null, long_value decimal(18,4) not null, "
    "short_value decimal(18,4) not null, net_value decimal(18,4) not null, " + AUDIT
)
DQ_RESULTS = (
    "result_id string not null, run_id string not null, business_date date not null, "
    "check_name string not null, check_type string not null, target_table string not null, "
    "severity string not null, passed boolean not null, expected_value string, "
    "actual_value string, details string, created_at timestamp not null"
)

# --- raw layer --------------------------------------------------------------
RAW_TRADES = (
    "trade_id string not null, order_id string, ticker string not null, trade_time timestamp not null, "
    "price decimal(18,4) not null, quantity int not null, buyer_participant string, "
    "seller_participant string, business_date date not null"
)
RAW_ORDERS = (
    "order_id string not null, ticker string not null, side string not null, "
    "order_time timestamp not null, price decimal(18,4) not null, quantity int not null, "
    "participant string not null, business_date date not null"
)
RAW_CLOSE_PRICES = (
    "ticker string not null, business_date date not null, closing_price decimal(18,4), "
    "daily_volume bigint, vwap decimal(18,4), auction_flag boolean"
)
RAW_PARTICIPANT_POSITIONS = (
    "participant string not null, ticker string not null, business_date date not null, "
    "net_quantity int not null, avg_price decimal(18,4)"
)
RAW_SETTLEMENT_INSTRUCTIONS = (
    "instruction_id string not null, trade_id string not null, settlement_date date not null, "
    "participant string not null, ticker string not null, quantity int not null, "
    "amount decimal(18,4) not null, status string, business_date date not null"
)
PARTICIPANTS = (
    "participant_code string not null, participant_name string not null, "
    "participant_type string not null, desk string, account string, active boolean"
)

# --- telemetry --------------------------------------------------------------
JOB_LOG = (
    "timestamp timestamp, service string, env string, version string, pipeline string, "
    "component string, log_type string, trace_id string, span_id string, ctm_job string, "
    "ctm_order_date date, ctm_run_id string, job_name string, run_id string, business_date date, "
    "status string, duration_seconds double, retries int, sla_miss boolean, output_rows bigint, "
    "error string, message string, gate_status string, "
    "job struct<name:string,status:string>, sla struct<miss:boolean>, "
    "`dd.trace_id` string, `dd.span_id` string"
)
RUN_HISTORY = (
    "timestamp timestamp, service string, env string, version string, component string, "
    "log_type string, pipeline string, run_id string, ctm_run_id string, business_date date, "
    "ctm_order_date date, ctm_job string, status string, duration_seconds double, "
    "finished_at timestamp, job_count int, "
    "job_summary map<string,struct<status:string,duration_seconds:double>>"
)


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


# --- contracts --------------------------------------------------------------
@dataclass(frozen=True)
class Column:
    """What a table demands of one column."""

    name: str
    type: str
    required: bool = False
    max_length: int | None = None
    domain: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Contract:
    table: str
    columns: tuple[Column, ...]
    unique_key: tuple[str, ...] = field(default=())


TRADE_MOVEMENTS_CONTRACT = Contract(
    "dw_trade_movements",
    (
        Column("trade_id", "string", True, 36),
        Column("ticker", "string", True, 20),
        Column("notional", "decimal(18,4)", True),
        Column("quantity", "decimal(14,0)", True),
        Column("trade_dt", "date", True),
        Column("settlement_dt", "date"),
        Column("counterparty_id", "string", max_length=20),
        Column("trader_id", "string", max_length=20),
        Column("desk_code", "string", max_length=10),
        Column("status", "string", True, 20),
    ),
)
DRVT_POSITIONS_CONTRACT = Contract(
    "dw_drvt_positions",
    (
        Column("position_id", "string", True, 36),
        Column("instrument_id", "string", True, 36),
        Column("participant_code", "string", True, 20),
        Column("position_date", "date", True),
        Column("long_qty", "decimal(14,4)", True),
        Column("short_qty", "decimal(14,4)", True),
        Column("net_qty", "decimal(14,4)", True),
        Column("settlement_price", "decimal(18,6)"),
        Column("margin_value", "decimal(18,4)"),
    ),
)
CASH_POSITIONS_CONTRACT = Contract(
    "dw_cash_positions",
    (
        Column("position_id", "string", True, 36),
        Column("ticker", "string", True, 20),
        Column("participant_code", "string", True, 20),
        Column("position_date", "date", True),
        Column("long_value", "decimal(18,4)", True),
        Column("short_value", "decimal(18,4)", True),
        Column("net_value", "decimal(18,4)", True),
    ),
)
RAW_TRADES_CONTRACT = Contract(
    "raw_trades",
    (
        Column("trade_id", "string", True, 36),
        Column("order_id", "string", True, 36),
        Column("ticker", "string", True, 10),
        Column("trade_time", "timestamp", True),
        Column("price", "decimal(18,4)", True),
        Column("quantity", "int", True),
        Column("buyer_participant", "string", True, 20),
        Column("seller_participant", "string", True, 20),
        Column("business_date", "date", True),
    ),
)
RAW_ORDERS_CONTRACT = Contract(
    "raw_orders",
    (
        Column("order_id", "string", True, 36),
        Column("ticker", "string", True, 10),
        Column("side", "string", True, 4, ("BUY", "SELL")),
        Column("order_time", "timestamp", True),
        Column("price", "decimal(18,4)", True),
        Column("quantity", "int", True),
        Column("participant", "string", True, 20),
        Column("business_date", "date", True),
    ),
)
RAW_SETTLEMENTS_CONTRACT = Contract(
    "raw_settlement_instructions",
    (
        Column("instruction_id", "string", True, 36),
        Column("trade_id", "string", True, 36),
        Column("settlement_date", "date", True),
        Column("quantity", "int", True),
        Column("amount", "decimal(18,4)", True),
        Column("status", "string", False, None, ("PENDING", "MATCHED", "FAILED")),
        Column("business_date", "date", True),
    ),
)
CLOSE_PRICES_CONTRACT = Contract(
    "raw_close_prices",
    (
        Column("ticker", "string", True, 10),
        Column("business_date", "date", True),
        Column("closing_price", "decimal(18,4)"),
        Column("daily_volume", "bigint"),
        Column("vwap", "decimal(18,4)"),
        Column("auction_flag", "boolean"),
    ),
    unique_key=("ticker", "business_date"),
)

# --- fixed values -----------------------------------------------------------
# Export column lists of the three warehouse tables.
EXPORT_COLUMNS = {
    "dw_trade_movements": [
        "trade_id", "ticker", "notional", "quantity", "trade_dt", "settlement_dt",
        "counterparty_id", "trader_id", "desk_code", "status", "dw_load_dt", "dw_source",
    ],
    "dw_drvt_positions": [
        "position_id", "instrument_id", "participant_code", "position_date", "long_qty",
        "short_qty", "net_qty", "settlement_price", "margin_value", "dw_load_dt", "dw_source",
    ],
    "dw_cash_positions": [
        "position_id", "ticker", "participant_code", "position_date", "long_value",
        "short_value", "net_value", "dw_load_dt", "dw_source",
    ],
}
# Date column each warehouse table is partitioned by.
DATE_COLUMN = {
    "dw_trade_movements": "trade_dt",
    "dw_drvt_positions": "position_date",
    "dw_cash_positions": "position_date",
    "dq_results": "business_date",
}
# The four jobs in dependency order, with their SLA per attempt in seconds.
PIPELINE = "d1_pipeline"
JOB_SLA_SECONDS = {
    "close_market_eod": 600,
    "reconcile_d1_positions": 900,
    "quality_gate_d1": 300,
    "publish_d1_reports": 600,
}
# Row-count tolerance and volume range of the quality checks.
ROW_COUNT_TOLERANCE = 0.05
DAILY_VOLUME_RANGE = (100, 10_000_000)
# Largest value of DECIMAL(18,4), and the source label of injected overflow rows.
NOTIONAL_LIMIT = "99999999999999.9999"
OVERFLOW_SOURCE = "fault_overflow"
