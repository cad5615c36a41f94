"""Declared schemas of the stored tables."""

from __future__ import annotations

# Whose workbook a row comes from; the leading partition of every bronze table.
PROPERTY = "property_id"
DEFAULT_PROPERTY = "default"

CELLS = "file STRING, sheet STRING, sheet_no INT, row INT, col INT, value STRING"

# What the binary file source delivers per workbook.
FILES = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"

RAW_LEDGER = (
    "as_of_month STRING, month DATE, rent_base DOUBLE, collected DOUBLE, uncollected DOUBLE, "
    "leased_sqft DOUBLE, price_per_sf_yr DOUBLE, _file_md5 STRING, _ingested_at STRING"
)
RAW_EXPENSES = (
    "as_of_month STRING, month DATE, item STRING, actual DOUBLE, expense_category STRING, "
    "_file_md5 STRING, _ingested_at STRING"
)
RAW_LEASE = (
    "as_of_month STRING, suite_id STRING, building STRING, tenant STRING, sqft DOUBLE, "
    "rent_monthly DOUBLE, rent_annual DOUBLE, rent_psf_yr DOUBLE, is_vacant BOOLEAN, "
    "is_own_use BOOLEAN, _file_md5 STRING, _ingested_at STRING"
)
INGESTION_LOG = (
    "property_id STRING, file STRING, _file_md5 STRING, as_of_month STRING, arrived BIGINT, rows_ingested BIGINT, "
    "started_at TIMESTAMP, finished_at TIMESTAMP, status STRING, error STRING"
)
PIPELINE_RUNS = (
    "run_id STRING, run_timestamp TIMESTAMP, pipeline_name STRING, status STRING, "
    "records_processed BIGINT, duration_seconds DOUBLE, error_message STRING, metadata STRING"
)
QUALITY_CHECKS = (
    "check_id STRING, run_id STRING, check_timestamp TIMESTAMP, table_name STRING, "
    "check_type STRING, passed BOOLEAN, failure_count BIGINT, details STRING"
)

# Table name, bronze schema and the key a record is replaced by.
LEDGER_TABLE = "raw_dashboard_monthly"
EXPENSE_TABLE = "raw_expenses_monthly"
LEASE_TABLE = "raw_lease_rate_snapshot"
BRONZE = {
    LEDGER_TABLE: (f"{PROPERTY} STRING, {RAW_LEDGER}", ["as_of_month", "month"]),
    EXPENSE_TABLE: (f"{PROPERTY} STRING, {RAW_EXPENSES}", ["as_of_month", "month", "item"]),
    LEASE_TABLE: (f"{PROPERTY} STRING, {RAW_LEASE}", ["as_of_month", "suite_id"]),
}
STAGED = {
    LEDGER_TABLE: "stg_dashboard_monthly",
    EXPENSE_TABLE: "stg_expenses_monthly",
    LEASE_TABLE: "stg_lease_rate",
}
