"""Named reports as SQL table functions over the gold tables, for whoever works in SQL alone.

``register`` makes the gold tables visible as views and creates one function per report. Parameters are bound by the engine, so
no text is spliced, and a call is planned with the rest of its statement: ``SELECT * FROM revenue_trends('p1', 6)``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from leasemill.functions import vocabulary as V

# Name -> (parameters, the gold table, returned columns, body). The newest snapshot of a month counts, as in ``plans.reports``.
_NEWEST = "row_number() OVER (ORDER BY month DESC, as_of_month DESC)"
_FUNCTIONS = {
    "property_overview": (
        "property STRING", "prop_kpi_monthly",
        "month DATE, occupancy_pct DOUBLE, leased_sqft BIGINT, collected DECIMAL(18,2), collection_rate_pct DOUBLE, accounts_receivable DECIMAL(18,2)",
        f"""SELECT month, occupancy_pct, leased_sqft, collected, collection_rate_pct, accounts_receivable
            FROM (SELECT *, {_NEWEST} AS place FROM prop_kpi_monthly
                  WHERE property_id = property_overview.property AND month IS NOT NULL AND collected IS NOT NULL) WHERE place = 1""",
    ),
    "revenue_trends": (
        "property STRING, months INT DEFAULT 6", "fact_rent_monthly",
        "month DATE, rent_base DECIMAL(18,2), collected DECIMAL(18,2), uncollected DECIMAL(18,2), collection_rate_pct DOUBLE",
        f"""SELECT month, rent_base, collected, uncollected, collection_rate_pct
            FROM (SELECT *, {_NEWEST} AS place FROM fact_rent_monthly
                  WHERE property_id = revenue_trends.property AND month IS NOT NULL AND rent_base IS NOT NULL) WHERE place <= revenue_trends.months""",
    ),
    "building_comparison": (
        "property STRING", "building_kpi_monthly",
        "building STRING, month DATE, total_sqft BIGINT, occupied_sqft BIGINT, occupancy_pct DOUBLE, suite_count BIGINT",
        """SELECT building, month, total_sqft, occupied_sqft, occupancy_pct, suite_count
           FROM (SELECT *, rank() OVER (ORDER BY month DESC, as_of_month DESC) AS place FROM building_kpi_monthly
                 WHERE property_id = building_comparison.property AND month IS NOT NULL) WHERE place = 1""",
    ),
    "collection_analysis": (
        "property STRING", "fact_rent_monthly", "month DATE, rent_base DECIMAL(18,2), collected DECIMAL(18,2), status STRING",
        f"""SELECT month, rent_base, collected, CASE WHEN collection_rate_pct < {V.COLLECTION_GOOD_FROM} THEN '{V.BELOW_TARGET_LABEL}'
                   WHEN collection_rate_pct >= {V.COLLECTION_TARGET} THEN '{V.PERFECT_LABEL}' ELSE '{V.GOOD_LABEL}' END
            FROM fact_rent_monthly WHERE property_id = collection_analysis.property AND month IS NOT NULL AND rent_base IS NOT NULL""",
    ),
}


def register(spark: SparkSession, gold: Mapping[str, DataFrame]) -> list[str]:
    """Views of the given gold tables (with property_id), and the functions over those that are there; returns the functions' names."""
    for name, df in gold.items():
        df.createOrReplaceTempView(name)
    made = []
    for name, (parameters, table, columns, body) in _FUNCTIONS.items():
        if table in gold:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN {body}")
            made.append(name)
    return made
