"""Rule-driven checks: row rules, table tests, KPI rules, reconciliation, freshness.

Row rules are Column predicates evaluated in one pass over a table. Nothing is collected: failures are a DataFrame
with one row per broken rule and row, summaries combine before the shuffle.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leasemill import schemas
from leasemill.functions import vocabulary as V
from leasemill.functions.expressions import is_own_use, percentage

Keys = Sequence[str]


@dataclass(frozen=True)
class Rule:
    """A row breaks the rule where ``broken`` is true (null counts as kept)."""

    column: str
    check: str
    broken: Column
    severity: str = "error"


def not_null(column: str) -> Rule:
    return Rule(column, "not_null", F.col(column).isNull())


def at_least(column: str, low: float) -> Rule:
    return Rule(column, f"at_least_{low:g}", F.col(column).cast("double") < low)


def between(column: str, low: float, high: float) -> Rule:
    value = F.col(column).cast("double")
    return Rule(column, f"between_{low:g}_{high:g}", (value < low) | (value > high))


def accepted(column: str, values: Sequence[str]) -> Rule:
    return Rule(column, "accepted_values", F.col(column).isNotNull() & ~F.col(column).isin(list(values)))


def coercible(column: str, kind: str) -> Rule:
    return Rule(column, f"type_{kind}", F.col(column).isNotNull() & F.col(column).try_cast(kind).isNull())


def bronze_rules(table: str) -> list[Rule]:
    """Validation rules of a bronze table; extra columns are allowed."""
    audit = [not_null("_file_md5"), not_null("_ingested_at")]
    if table == schemas.LEDGER_TABLE:
        amounts = ["rent_base", "collected", "leased_sqft", "price_per_sf_yr"]
        return [
            not_null("as_of_month"),
            not_null("month"),
            coercible("month", "timestamp"),
            *[coercible(c, "double") for c in [*amounts, "uncollected"]],
            *[at_least(c, 0) for c in amounts],
            *audit,
        ]
    if table == schemas.EXPENSE_TABLE:
        return [
            not_null("as_of_month"),
            not_null("month"),
            coercible("month", "timestamp"),
            not_null("item"),
            coercible("actual", "double"),
            at_least("actual", 0),
            not_null("expense_category"),
            accepted("expense_category", V.EXPENSE_CATEGORIES),
            *audit,
        ]
    if table == schemas.LEASE_TABLE:
        amounts = ["sqft", "rent_monthly", "rent_annual", "rent_psf_yr"]
        return [
            not_null("as_of_month"),
            not_null("suite_id"),
            accepted("building", V.BUILDINGS),
            not_null("tenant"),
            *[coercible(c, "double") for c in amounts],
            *[at_least(c, 0) for c in amounts],
            not_null("is_vacant"),
            not_null("is_own_use"),
            *audit,
        ]
    raise ValueError(f"no rules for table {table}")


def failure_cases(df: DataFrame, table: str, rules: Sequence[Rule], row_key: Keys) -> DataFrame:
    """Every failing (row, column, check) with the offending value."""
    cases = F.array(
        *[
            F.when(
                r.broken,
                F.struct(
                    F.lit(r.column).alias("column"),
                    F.lit(r.check).alias("check"),
                    F.lit(r.severity).alias("severity"),
                    F.col(r.column).cast("string").alias("failure_case"),
                ),
            )
            for r in rules
        ]
    )
    key = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in row_key]).alias("row_key")
    return df.select(F.col("as_of_month"), key, F.explode(F.filter(cases, lambda c: c.isNotNull())).alias("c")).select(
        F.lit(table).alias("table_name"), "as_of_month", "row_key", "c.*"
    )


def check_summary(df: DataFrame, table: str, rules: Sequence[Rule], by: Keys = ("as_of_month",)) -> DataFrame:
    """Failure count and verdict per partition and rule, passing rules included."""
    counted = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.array(
            *[
                F.struct(
                    F.lit(r.column).alias("column"),
                    F.lit(r.check).alias("check"),
                    F.lit(r.severity).alias("severity"),
                    F.count_if(r.broken).alias("failure_count"),
                )
                for r in rules
            ]
        ).alias("r"),
    )
    return counted.select(F.lit(table).alias("table_name"), *by, "row_count", F.inline("r")).withColumn(
        "passed", F.col("failure_count") == 0
    )


def partition_verdicts(summaries: DataFrame) -> DataFrame:
    """Pass or fail per table and partition; only errors fail a partition, warnings do not."""
    hard = (F.col("severity") == "error") & (F.col("failure_count") > 0)
    whose = [c for c in (schemas.PROPERTY,) if c in summaries.columns]
    return summaries.groupBy("table_name", *whose, "as_of_month").agg(
        F.count_if(hard).alias("failed_checks"), (F.count_if(hard) == 0).alias("passed")
    )


def sound_rows(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows that break no error rule."""
    errors = [F.coalesce(r.broken, F.lit(False)) for r in rules if r.severity == "error"]
    return df.where(~functools.reduce(lambda a, b: a | b, errors, F.lit(False)))


def duplicates(df: DataFrame, key: Keys) -> DataFrame:
    """Key values that occur more than once."""
    known = functools.reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    return df.where(known).groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


# The declared model tests (model, column, test, accepted values).
MODEL_TESTS = [
    ("stg_dashboard_monthly", "as_of_month", "not_null", None),
    ("stg_dashboard_monthly", "month", "not_null", None),
    ("stg_dashboard_monthly", "rent_base", "not_null", None),
    ("stg_dashboard_monthly", "collected", "not_null", None),
    ("stg_dashboard_monthly", "leased_sqft", "not_null", None),
    ("stg_expenses_monthly", "as_of_month", "not_null", None),
    ("stg_expenses_monthly", "item", "not_null", None),
    ("stg_lease_rate", "as_of_month", "not_null", None),
    ("stg_lease_rate", "suite_id", "not_null", None),
    ("stg_lease_rate", "building", "accepted_values", ["A", "B"]),
    ("stg_lease_rate", "sqft", "not_null", None),
    ("dim_suite", "suite_id", "not_null", None),
    ("dim_suite", "suite_id", "unique", None),
    ("dim_tenant", "tenant_id", "not_null", None),
    ("dim_tenant", "tenant_id", "unique", None),
    ("fact_rent_monthly", "month", "not_null", None),
    ("fact_expense_monthly", "as_of_month", "not_null", None),
    ("fact_expense_monthly", "expense_category", "accepted_values", ["fixed", "variable", "other"]),
    ("prop_kpi_monthly", "as_of_month", "not_null", None),
    ("prop_kpi_monthly", "month", "not_null", None),
    ("building_kpi_monthly", "as_of_month", "not_null", None),
    ("building_kpi_monthly", "month", "not_null", None),
    ("building_kpi_monthly", "building", "accepted_values", ["A", "B"]),
    ("kpi_windows", "end_month", "not_null", None),
    ("kpi_windows", "window_size", "accepted_values", ["3m", "6m", "9m", "12m"]),
    ("snap_lease_rate_scd2", "suite_id", "not_null", None),
    ("dim_calendar_month", "month_id", "unique", None),
    ("dim_calendar_month", "month_id", "not_null", None),
]


def model_tests(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Run the declared tests of the given models: (model, column, test, failures, passed).

    not_null and accepted_values count rows and share one pass per model; unique counts values that repeat, within their
    property where the model has one.
    """
    results = []
    for model, df in frames.items():
        row_tests = [
            not_null(c) if test == "not_null" else accepted(c, values)
            for m, c, test, values in MODEL_TESTS
            if m == model and test != "unique"
        ]
        if row_tests:
            results.append(
                check_summary(df, model, row_tests, by=()).select(
                    F.lit(model).alias("model"), "column", F.col("check").alias("test"),
                    F.col("failure_count").alias("failures"),
                )
            )
        for m, column, test, _ in MODEL_TESTS:
            if m == model and test == "unique":
                whose = [k for k in (schemas.PROPERTY,) if k in df.columns]
                results.append(
                    duplicates(df, [*whose, column]).agg(F.count(F.lit(1)).alias("failures")).select(
                        F.lit(model).alias("model"), F.lit(column).alias("column"), F.lit("unique").alias("test"),
                        "failures",
                    )
                )
    union = functools.reduce(lambda a, b: a.unionByName(b), results)
    return union.withColumn("passed", F.col("failures") == 0)


def prop_kpi_rules(total_sqft: int | Column = V.TOTAL_SQFT) -> list[Rule]:
    total = total_sqft if isinstance(total_sqft, Column) else F.lit(total_sqft)
    expected = percentage(F.col("leased_sqft"), F.col("total_property_sqft"))
    return [
        Rule("total_property_sqft", "constant_total", F.col("total_property_sqft") != total),
        Rule(
            "occupancy_pct",
            "occupancy_formula",
            (F.col("leased_sqft") > 0) & (F.col("total_property_sqft") > 0)
            & (F.abs(F.col("occupancy_pct") - expected) >= 0.01),
        ),
        Rule("accounts_receivable", "equals_uncollected", F.col("accounts_receivable") != F.col("uncollected")),
        between("price_per_sf_yr", 1, 1000),
    ]


def rent_rules() -> list[Rule]:
    expected = percentage(F.col("collected"), F.col("rent_base"))
    return [
        Rule(
            "collection_rate_pct",
            "rate_formula",
            (F.col("rent_base") > 0) & (F.abs(F.col("collection_rate_pct") - expected) >= 0.01),
        ),
        between("collection_rate_pct", 0, 110),
    ]


def ledger_sanity_rules() -> list[Rule]:
    return [
        not_null("month"),
        *[at_least(c, 0) for c in ("rent_base", "collected", "uncollected", "leased_sqft", "price_per_sf_yr")],
        Rule("collected", "at_most_110_pct_of_base",
             F.col("collected").cast("double") > F.col("rent_base").cast("double") * 1.1, "warning"),
    ]


def lease_suite_rules(lease: DataFrame, keys: Keys = ()) -> DataFrame:
    """Per snapshot: suites that occur more than once, and suites in the owner's use that are not flagged as such."""
    grain = [*keys, "as_of_month"]
    suites = lease.groupBy(*grain, "suite_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(is_own_use(F.col("tenant"), F.col("suite_id")) & ~F.col("is_own_use")).alias("unflagged"),
    )
    return suites.groupBy(*grain).agg(
        F.count_if(F.col("suite_id").isNotNull() & (F.col("n") > 1)).alias("repeated_suites"), F.sum("unflagged").alias("unflagged_own_use")
    )


def lease_sanity_rules() -> list[Rule]:
    return [
        not_null("suite_id"),
        accepted("building", V.BUILDINGS),
        *[at_least(c, 0) for c in ("sqft", "rent_monthly", "rent_annual", "rent_psf_yr")],
        not_null("is_vacant"),
        not_null("is_own_use"),
    ]


def reconcile(left: DataFrame, right: DataFrame, key: Keys, values: Keys) -> DataFrame:
    """Rows that differ between two layers: missing on one side or unequal in a value (nulls are equal)."""
    renamed = right.select(*[F.col(k).alias(f"r_{k}") for k in key], *[F.col(v).alias(f"r_{v}") for v in values],
                           F.lit(True).alias("in_right"))
    both = left.select(*key, *values, F.lit(True).alias("in_left")).join(
        renamed,
        functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in key]),
        "full_outer",
    )
    unequal = [F.when(~F.col(v).eqNullSafe(F.col(f"r_{v}")), F.lit(v)) for v in values]
    status = (
        F.when(F.col("in_right").isNull(), "left_only")
        .when(F.col("in_left").isNull(), "right_only")
        .otherwise("unequal")
    )
    differing = F.filter(F.array(*unequal), lambda c: c.isNotNull())
    return both.select(
        *[F.coalesce(F.col(k), F.col(f"r_{k}")).alias(k) for k in key],
        status.alias("status"),
        F.concat_ws(",", differing).alias("differs"),
    ).where((F.col("status") != "unequal") | (F.col("differs") != ""))


def layer_totals(layers: Mapping[str, DataFrame], values: Keys) -> DataFrame:
    """Row count and exact sums of the same columns in every layer."""
    rows = [
        df.agg(
            F.count(F.lit(1)).alias("row_count"),
            *[F.sum(F.col(v).cast("decimal(28,2)")).cast("decimal(38,2)").alias(v) for v in values],
        ).select(F.lit(name).alias("layer"), "row_count", *values)
        for name, df in layers.items()
    ]
    return functools.reduce(lambda a, b: a.unionByName(b), rows)


def month_digests(df: DataFrame, key: Keys, values: Keys, month: str = "as_of_month") -> DataFrame:
    """(month, rows, total, mixed): digests of a layer's rows by month that do not depend on their order.

    Every row is hashed with its key and values; the hashes are summed and xor-ed, so tasks combine before the shuffle. Values that
    the layers hold in different types have to be given in one.
    """
    row = F.xxhash64(*key, *values)
    return df.groupBy(month).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(row.cast("decimal(38,0)")).alias("total"), F.bit_xor(row).alias("mixed"))


def reconcile_by_digest(left: DataFrame, right: DataFrame, key: Keys, values: Keys, month: str = "as_of_month") -> DataFrame:
    """What ``reconcile`` finds, joining only the months whose digests differ.

    Layers agree in most months. The months are a list bounded by the calendar, so they reach both layers as a partition filter.
    """
    def alike(df: DataFrame) -> DataFrame:
        return df.select(*key, *[F.col(c).cast("decimal(28,6)").alias(c) for c in values])

    a, b = month_digests(alike(left), key, values, month), month_digests(alike(right), key, values, month)
    same = functools.reduce(lambda x, y: x & y, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("rows", "total", "mixed")])
    differing = a.alias("l").join(b.alias("r"), F.col(f"l.{month}").eqNullSafe(F.col(f"r.{month}")), "full").where(~same)
    months = [r[0] for r in differing.select(F.coalesce(f"l.{month}", f"r.{month}")).distinct().collect()]
    inside = F.col(month).isin([m for m in months if m is not None])
    inside = inside | F.col(month).isNull() if None in months else inside
    return reconcile(left.where(inside), right.where(inside), key, values)


def freshness(tables: Mapping[str, DataFrame], month: str = "as_of_month") -> DataFrame:
    """Row count and newest month per table."""
    rows = [
        df.agg(
            F.count(F.lit(1)).alias("row_count"),
            (F.max(month) if month in df.columns else F.lit(None)).cast("string").alias("newest_month"),
        ).select(F.lit(name).alias("table_name"), "row_count", "newest_month")
        for name, df in tables.items()
    ]
    return functools.reduce(lambda a, b: a.unionByName(b), rows)


class ValidationError(RuntimeError):
    """Raised after all tables were checked when a table with hard failure has errors."""


def validate_bronze(tables: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(failure cases, summary) over all given bronze tables."""
    cases, summaries = [], []
    for name, df in tables.items():
        rules = bronze_rules(name)
        whose = [c for c in (schemas.PROPERTY,) if c in df.columns]
        cases.append(failure_cases(df, name, rules, [*whose, *schemas.BRONZE[name][1]]))
        summaries.append(check_summary(df, name, rules, [*whose, "as_of_month"]))
    union = functools.partial(functools.reduce, lambda a, b: a.unionByName(b))
    return union(cases), union(summaries)


def failed_tables(summary: DataFrame) -> list[str]:
    """Names of tables with errors; the rule tables bound the list."""
    failed = partition_verdicts(summary).where(~F.col("passed")).select("table_name").distinct()
    return sorted(r[0] for r in failed.collect())


def gate(summary: DataFrame, hard_fail: bool = True) -> list[str]:
    """Failed table names; raises after looking at every table when ``hard_fail``."""
    failed = failed_tables(summary)
    if failed and hard_fail:
        raise ValidationError("validation failed for " + ", ".join(failed))
    return failed
