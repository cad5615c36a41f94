"""The same results as plain SQL over the star-schema tables, for comparison in another engine.

Each entry is one statement. The shared pieces are common table expressions; a statement carries only the ones it
uses. Decimals are compared as doubles with six places and dates as text, like ``registry.present``.
"""

from __future__ import annotations

from leasemill.functions import vocabulary as V
from leasemill.sources.star import ITEM_ROWS


def _n(expr: str, name: str | None = None, places: int = 6) -> str:
    """A compared number: double, rounded, without a negative zero."""
    return f'ROUND(CAST({expr} AS DOUBLE), {places}) + 0.0 AS "{name or expr}"'


def _i(expr: str, name: str | None = None) -> str:
    return f'CAST({expr} AS BIGINT) AS "{name or expr}"'


def _within(rows: str, end_month: str) -> str:
    """Rows of the n months up to and with the end month."""
    months = f"date_diff('month', CAST({rows}.as_of_month || '-01' AS DATE), CAST({end_month} || '-01' AS DATE))"
    return f"{months} BETWEEN 0 AND n - 1"


def _d(expr: str, name: str | None = None) -> str:
    return f"strftime({expr}, '%Y-%m-%d') AS \"{name or expr}\""


def _cols(text: str = "", n: str = "", i: str = "", d: str = "", places: int = 6) -> str:
    parts = text.split() + [_n(c, places=places) for c in n.split()] + [_i(c) for c in i.split()]
    return ", ".join(parts + [_d(c) for c in d.split()])


def _cents(expr: str) -> str:
    return f"CAST({expr} AS DECIMAL(18,2))"


def _pct(n: str, d: str) -> str:
    return f"CASE WHEN {d} > 0 THEN CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE) * 100 ELSE 0 END"


def _ratio(n: str, d: str) -> str:
    return f"CASE WHEN {d} > 0 THEN CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE) ELSE 0 END"


def _month_no(month: str) -> str:
    return f"(year({month}) * 12 + month({month}))"


def _pieces(k: str) -> dict[str, tuple[str, tuple[str, ...]]]:
    """Name -> (SQL, pieces it needs). ``k`` is '' or 'property_id, '."""
    owner = "JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey" if k else ""
    who = "CAST(n_regionkey AS VARCHAR) AS property_id, " if k else ""
    using = "(property_id, as_of_month)" if k else "(as_of_month)"
    return {
        "ord": (f"""
            SELECT {who} o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS price,
                   strftime(o_orderdate, '%Y-%m') AS as_of_month
            FROM orders {owner}""", ()),
        "raw_ledger": (f"""
            SELECT {k} as_of_month, CAST(as_of_month || '-01' AS DATE) AS month,
                   CAST(base AS DOUBLE) AS rent_base, CAST(paid AS DOUBLE) AS collected,
                   CAST(base - paid AS DOUBLE) AS uncollected, CAST(area AS DOUBLE) AS leased_sqft,
                   CASE WHEN area > 0 THEN CAST(12 AS DOUBLE) * CAST(base AS DOUBLE) / CAST(area AS DOUBLE) ELSE 0 END
                       AS price_per_sf_yr
            FROM (SELECT {k} as_of_month, SUM(price) AS base,
                         COALESCE(SUM(CASE WHEN o_orderstatus <> 'O' THEN price END), 0) AS paid,
                         COALESCE(SUM(area), 0) AS area
                  FROM ord
                  LEFT JOIN (SELECT l_orderkey, SUM(CAST(l_quantity AS BIGINT)) AS area FROM lineitem
                             WHERE l_linestatus = 'F' GROUP BY l_orderkey) ON l_orderkey = o_orderkey
                  GROUP BY {k} as_of_month)""", ("ord",)),
        "raw_lease": (f"""
            SELECT {k} as_of_month, CAST(supplier AS VARCHAR) || building AS suite_id, building,
                   CASE WHEN ck % 10 = 0 THEN 'Vacant' WHEN ck % 10 = 1 THEN 'Owner Use'
                        ELSE 'Tenant ' || CAST(ck AS VARCHAR) END AS tenant,
                   CAST(area AS DOUBLE) AS sqft, CAST(rent AS DOUBLE) AS rent_monthly,
                   CAST(rent * 12 AS DOUBLE) AS rent_annual,
                   {_ratio("rent * 12", "area")} AS rent_psf_yr,
                   ck % 10 = 0 AS is_vacant, ck % 10 = 1 AS is_own_use
            FROM (SELECT {k} as_of_month, l_suppkey AS supplier,
                         CASE WHEN l_linestatus = 'F' THEN 'A' ELSE 'B' END AS building,
                         SUM(CAST(l_quantity AS BIGINT)) AS area,
                         SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS rent, MAX(o_custkey) AS ck
                  FROM lineitem JOIN ord ON o_orderkey = l_orderkey
                  GROUP BY {k} as_of_month, l_suppkey, CASE WHEN l_linestatus = 'F' THEN 'A' ELSE 'B' END)""",
            ("ord",)),
        "raw_expenses": (f"""
            SELECT {k} as_of_month, CAST(as_of_month || '-01' AS DATE) AS month, item,
                   CAST(ROUND(cost, 2) AS DOUBLE) AS actual,
                   CASE WHEN item IN ('MEDIUM', 'STANDARD') THEN 'fixed' WHEN item IN ('LARGE', 'PROMO') THEN 'variable'
                        ELSE 'other' END AS expense_category
            FROM (SELECT {k} as_of_month, p_type AS item,
                         CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)))
                              AS DECIMAL(24,4)) AS cost
                  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN ord ON o_orderkey = l_orderkey
                  GROUP BY {k} as_of_month, p_type)""", ("ord",)),
        "ledger": (f"""
            SELECT {k} as_of_month, month, {_cents("rent_base")} AS rent_base, {_cents("collected")} AS collected,
                   {_cents("uncollected")} AS uncollected, CAST(leased_sqft AS BIGINT) AS leased_sqft,
                   {_cents("price_per_sf_yr")} AS price_per_sf_yr
            FROM raw_ledger""", ("raw_ledger",)),
        "lease": (f"""
            SELECT {k} as_of_month, suite_id, building, tenant, CAST(sqft AS BIGINT) AS sqft,
                   {_cents("rent_monthly")} AS rent_monthly, {_cents("rent_annual")} AS rent_annual,
                   {_cents("rent_psf_yr")} AS rent_psf_yr, is_vacant, is_own_use
            FROM raw_lease""", ("raw_lease",)),
        "expenses": (f"""
            SELECT {k} as_of_month, month, item, {_cents("actual")} AS actual, expense_category
            FROM raw_expenses""", ("raw_expenses",)),
        "dim_suite": (f"SELECT DISTINCT {k} suite_id, building, sqft FROM lease", ("lease",)),
        "dim_tenant": (f"""
            SELECT DISTINCT {k} md5(tenant) AS tenant_id, tenant AS tenant_name, is_own_use FROM lease""", ("lease",)),
        "rent": (f"""
            SELECT {k} as_of_month, month, rent_base, collected, uncollected, leased_sqft, price_per_sf_yr,
                   {_pct("collected", "rent_base")} AS collection_rate_pct, collected + uncollected AS total_billed
            FROM ledger""", ("ledger",)),
        "expense": (f"""
            SELECT {k} as_of_month, month, expense_category, SUM(actual) AS total_actual, COUNT(*) AS line_item_count
            FROM expenses GROUP BY {k} as_of_month, month, expense_category""", ("expenses",)),
        "roster": (f"""
            SELECT {k} as_of_month, SUM(sqft) AS all_sqft,
                   SUM(CASE WHEN is_own_use THEN 0 ELSE sqft END) AS not_own_sqft,
                   SUM(CASE WHEN is_vacant THEN sqft ELSE 0 END) AS vacant_sqft,
                   SUM(CASE WHEN is_own_use THEN sqft ELSE 0 END) AS own_use_sqft,
                   SUM(CASE WHEN is_vacant OR is_own_use THEN 0 ELSE sqft END) AS revenue_sqft
            FROM lease GROUP BY {k} as_of_month""", ("lease",)),
        **{
            name: (f"""
            SELECT *, {_pct("leased_sqft", "effective_sqft")} AS occupancy_pct_excl_own_use,
                   {_ratio("collected", "effective_sqft")} AS collected_per_sf
            FROM (SELECT {k} as_of_month, month, rent_base, collected, uncollected, leased_sqft, price_per_sf_yr,
                         {_pct("collected", "rent_base")} AS collection_rate_pct, total_property_sqft,
                         {area} AS effective_sqft, vacant_sqft, own_use_sqft, revenue_sqft,
                         {_pct("leased_sqft", "total_property_sqft")} AS occupancy_pct,
                         uncollected AS accounts_receivable, 0 AS fixed_expenses, 0 AS variable_expenses,
                         0 AS total_expenses, collected AS noi_proto, CAST(100 AS DOUBLE) AS noi_margin_pct
                  FROM (SELECT l.*, CASE WHEN r.all_sqft IS NOT NULL THEN {V.TOTAL_SQFT} END AS total_property_sqft,
                               r.all_sqft, r.not_own_sqft, r.vacant_sqft, r.own_use_sqft, r.revenue_sqft
                        FROM ledger l
                        LEFT JOIN roster r USING {using}))""", ("ledger", "roster"))
            for name, area in (("prop", "all_sqft"), ("prop_x", "not_own_sqft"))
        },
        "split": (f"""
            SELECT {k} as_of_month, building, SUM(sqft) AS total_sqft,
                   SUM(CASE WHEN is_vacant THEN 0 ELSE sqft END) AS occupied_sqft,
                   SUM(CASE WHEN is_vacant OR is_own_use THEN 0 ELSE sqft END) AS revenue_sqft,
                   SUM(CASE WHEN is_vacant THEN sqft ELSE 0 END) AS vacant_sqft,
                   SUM(CASE WHEN is_own_use THEN sqft ELSE 0 END) AS own_use_sqft, COUNT(*) AS suite_count,
                   SUM(CASE WHEN is_vacant THEN 1 ELSE 0 END) AS vacant_count,
                   SUM(CASE WHEN is_own_use THEN 1 ELSE 0 END) AS own_use_count
            FROM lease WHERE building IN ('A', 'B') GROUP BY {k} as_of_month, building""", ("lease",)),
        **{
            name: (f"""
            SELECT {k} as_of_month, month, building, total_sqft, occupied_sqft,
                   {effective} AS effective_occupied_sqft, vacant_sqft, own_use_sqft, revenue_sqft,
                   {_pct("occupied_sqft", "total_sqft")} AS occupancy_pct,
                   {_pct(effective, "total_sqft")} AS occupancy_pct_excl_own_use,
                   suite_count, vacant_count, own_use_count
            FROM ledger JOIN split USING {using}""", ("ledger", "split"))
            for name, effective in (("bld", "occupied_sqft"), ("bld_x", "revenue_sqft"))
        },
        "win": (" UNION ALL ".join(f"""
            SELECT {k.replace("property_id", "p.property_id")} p.as_of_month AS end_month, '{size}m' AS window_size,
                   AVG(CAST(q.occupancy_pct AS DOUBLE)) AS avg_occupancy_pct,
                   AVG(CAST(q.collection_rate_pct AS DOUBLE)) AS avg_collection_rate_pct,
                   AVG(CAST(q.price_per_sf_yr AS DOUBLE)) AS avg_price_per_sf_yr,
                   SUM(q.collected) AS total_collected, SUM(q.rent_base) AS total_rent_base,
                   SUM(q.uncollected) AS total_uncollected, AVG(CAST(q.noi_proto AS DOUBLE)) AS avg_noi_proto,
                   AVG(CAST(q.noi_margin_pct AS DOUBLE)) AS avg_noi_margin_pct
            FROM prop p JOIN prop q ON q.month <= p.month AND q.month > p.month - INTERVAL {size} MONTH
                 {"AND q.property_id = p.property_id" if k else ""}
            GROUP BY ALL""" for size in V.WINDOW_SIZES), ("prop",)),
        "points": (f"""
            SELECT {k} metric, month, y,
                   CAST(ROUND(y * CASE WHEN metric = 'occupancy_pct' THEN 1000000 ELSE 100 END) AS HUGEINT) AS u,
                   CAST(CASE WHEN metric = 'occupancy_pct' THEN 1000000 ELSE 100 END AS DOUBLE) AS scale
            FROM (SELECT {k} month, 'occupancy_pct' AS metric, CAST(occupancy_pct AS DOUBLE) AS y FROM prop
                  UNION ALL SELECT {k} month, 'collected', CAST(collected AS DOUBLE) FROM prop
                  UNION ALL SELECT {k} month, 'noi_proto', CAST(noi_proto AS DOUBLE) FROM prop)""", ("prop",)),
        **_forecast_pieces(k, "points", ""),
        "yearly": ("SELECT year(month) AS year, * FROM points", ("points",)),
        **_forecast_pieces("year, ", "yearly", "_yearly"),
        "held": ("""
            SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY metric ORDER BY month DESC) AS back FROM points)
            WHERE back > 3""", ("points",)),
        **_forecast_pieces(k, "held", "_held"),
    }


def _forecast_pieces(k: str, points: str, suffix: str) -> dict[str, tuple[str, tuple[str, ...]]]:
    grain = f"{k} metric"
    return {
        f"pos{suffix}": (f"""
            SELECT *, u * n - total AS v, lag(u * n - total) OVER w AS v1
            FROM (SELECT *, COUNT(*) OVER (PARTITION BY {grain}) AS n,
                         CAST(SUM(u) OVER (PARTITION BY {grain}) AS HUGEINT) AS total,
                         ROW_NUMBER() OVER (PARTITION BY {grain} ORDER BY month) AS pos,
                         u - lag(u, 12) OVER (PARTITION BY {grain} ORDER BY month) AS change FROM {points})
            WHERE n >= 3 WINDOW w AS (PARTITION BY {grain} ORDER BY month)""", (points,)),
        f"fit{suffix}": (f"""
            SELECT {grain}, ANY_VALUE(n) AS n, ANY_VALUE(scale) AS scale, ANY_VALUE(total) AS total,
                   MAX(month) AS last_month, arg_max(v, month) AS v_last,
                   CAST(SUM(CASE WHEN n < 24 THEN v * v1 END) AS DOUBLE) AS crossed,
                   CAST(SUM(CASE WHEN n < 24 THEN v1 * v1 END) AS DOUBLE) AS lagged,
                   CAST(SUM(CASE WHEN n < 24 AND v1 IS NOT NULL THEN v * v END) AS DOUBLE) AS later,
                   SUM(change) AS c1, SUM(change * change) AS c2, COUNT(change) AS m
            FROM pos{suffix} GROUP BY {grain}""", (f"pos{suffix}",)),
        f"fc{suffix}": (f"""
            SELECT {grain}, horizon, CAST(last_month + to_months(CAST(horizon AS INTEGER)) AS DATE) AS forecast_month,
                   CASE WHEN n >= 24 THEN 'seasonal' ELSE 'autoregressive' END AS model, n AS n_points,
                   (mid - {V.Z80} * sigma) / scale AS p10, mid / scale AS p50, (mid + {V.Z80} * sigma) / scale AS p90
            FROM (SELECT *, CASE WHEN n >= 24 THEN season + CAST(c1 AS DOUBLE) / m
                                 ELSE CAST(total AS DOUBLE) / n + pow(phi, horizon) * (CAST(v_last AS DOUBLE) / n) END AS mid,
                         CASE WHEN n >= 24
                              THEN sqrt(greatest(CAST(c2 * m - c1 * c1 AS DOUBLE), 0.0) / (CAST(m AS DOUBLE) * (m - 1)))
                              ELSE sqrt(greatest(later - 2 * phi * crossed + phi * phi * lagged, 0.0)
                                        / (CAST(n AS DOUBLE) * n) / (n - 2)
                                        * CASE WHEN abs(phi) < 1 THEN (1 - pow(phi, 2 * horizon)) / (1 - phi * phi)
                                               ELSE horizon END) END AS sigma
                  FROM (SELECT f.*, h.horizon, s.season,
                               CASE WHEN lagged > 0 THEN crossed / lagged ELSE 0 END AS phi
                        FROM fit{suffix} f JOIN (SELECT UNNEST(range(1, 13)) AS horizon) h ON TRUE
                        LEFT JOIN (SELECT {grain}, pos - n + 12 AS horizon, CAST(u AS DOUBLE) AS season
                                   FROM pos{suffix}) s USING ({grain}, horizon)))""",
            (f"fit{suffix}", f"pos{suffix}")),
    }


def _sql(select: str, *uses: str, by_property: bool = False) -> str:
    pieces = _pieces("property_id, " if by_property else "")
    ordered: list[str] = []

    def need(name: str) -> None:
        if name in ordered:
            return
        for other in pieces[name][1]:
            need(other)
        ordered.append(name)

    for name in uses:
        need(name)
    ctes = ",\n".join(f"{name} AS ({pieces[name][0]})" for name in ordered)
    return f"WITH {ctes}\n{select}" if ordered else select


_LEDGER = _cols("as_of_month", "rent_base collected uncollected price_per_sf_yr", "leased_sqft", "month")
_PROP = _cols(
    "as_of_month",
    "rent_base collected uncollected price_per_sf_yr collection_rate_pct occupancy_pct occupancy_pct_excl_own_use "
    "collected_per_sf accounts_receivable noi_proto noi_margin_pct",
    "leased_sqft total_property_sqft effective_sqft vacant_sqft own_use_sqft fixed_expenses variable_expenses "
    "total_expenses",
    "month",
)
_BLD = _cols(
    "as_of_month building",
    "occupancy_pct occupancy_pct_excl_own_use",
    "total_sqft occupied_sqft effective_occupied_sqft vacant_sqft own_use_sqft suite_count vacant_count own_use_count",
    "month",
)
_LEASE = _cols(
    "as_of_month suite_id building tenant is_vacant is_own_use", "rent_monthly rent_annual rent_psf_yr", "sqft"
)
_SERIES = _cols(
    "as_of_month",
    "rent_base collected uncollected price_per_sf_yr collection_rate_pct occupancy_pct occupancy_pct_excl_own_use "
    "accounts_receivable noi_proto noi_margin_pct",
    "leased_sqft fixed_expenses variable_expenses total_expenses",
    "month",
)
_WIN = _cols(
    "end_month window_size",
    "avg_occupancy_pct avg_collection_rate_pct avg_price_per_sf_yr avg_noi_proto avg_noi_margin_pct total_collected "
    "total_rent_base total_uncollected",
)
_FC = _cols("metric model", "p10 p50 p90", "horizon n_points", "forecast_month", places=2)
_NEWEST = "month = (SELECT MAX(month) FROM prop)"


def _series(where: str, shown: str = "occupancy_pct", uses: str = "prop", by_property: bool = False) -> str:
    k = "property_id, " if by_property else ""
    return _sql(f"SELECT {k}{_SERIES}, {_n(shown, 'shown_occupancy_pct')} FROM {uses} WHERE {where}", uses,
                by_property=by_property)


def _last(n: int) -> str:
    return f"month >= (SELECT MAX(month) FROM prop) - INTERVAL {n - 1} MONTH"


def _scd(lease: str, checked: list[str], carried: str, keys: str = "suite_id", by_property: bool = False) -> str:
    """Version ranges by month places: a change, or a missed month, starts a version."""
    k = "property_id, " if by_property else ""
    part = "PARTITION BY property_id" if by_property else ""
    differs = " OR ".join(f"{c} IS DISTINCT FROM lag({c}) OVER w" for c in checked)
    join = "(property_id, as_of_month)" if by_property else "(as_of_month)"
    return f"""
        SELECT {keys}, version, MIN(as_of_month) AS valid_from, arg_max(next_month, place) AS valid_to_or_null,
               MAX(place) AS last_place, {", ".join(f"arg_min({c}, place) AS {c}" for c in carried.split())}
        FROM (SELECT *, SUM(CASE WHEN starts THEN 1 ELSE 0 END)
                            OVER (PARTITION BY {keys} ORDER BY place ROWS UNBOUNDED PRECEDING) AS version
              FROM (SELECT *, lag(place) OVER w IS NULL OR lag(place) OVER w < place - 1 OR {differs} AS starts
                    FROM {lease} JOIN (SELECT {k} as_of_month, ROW_NUMBER() OVER ({part} ORDER BY as_of_month) AS place,
                                              COALESCE(lead(as_of_month) OVER ({part} ORDER BY as_of_month), '') AS next_month
                                       FROM (SELECT DISTINCT {k} as_of_month FROM {lease})) USING {join}
                    WINDOW w AS (PARTITION BY {keys} ORDER BY place)))
        GROUP BY {keys}, version"""


_CHECKED = ["tenant", "rent_monthly", "rent_annual", "rent_psf_yr", "is_vacant", "is_own_use"]
_TO = "NULLIF(valid_to_or_null, '') AS valid_to, valid_to_or_null = '' AS is_current"


def _models() -> dict[str, str]:
    return {
        "staging_ledger": _sql(f"SELECT {_LEDGER} FROM ledger", "ledger"),
        "staging_expenses": _sql(
            f"SELECT {_cols('as_of_month item expense_category', 'actual', d='month')} FROM expenses", "expenses"),
        "staging_lease": _sql(f"SELECT {_LEASE} FROM lease", "lease"),
        "dim_suite": _sql(f"SELECT {_cols('suite_id building', i='sqft')} FROM dim_suite", "dim_suite"),
        "dim_suite_latest": _sql(f"""
            SELECT {_cols('suite_id building', i='sqft')}
            FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY suite_id
                                               ORDER BY as_of_month DESC, building DESC, sqft DESC) AS rn FROM lease)
            WHERE rn = 1""", "lease"),
        "dim_tenant": _sql("SELECT tenant_id, tenant_name, is_own_use FROM dim_tenant", "dim_tenant"),
        "dim_tenant_latest": _sql("""
            SELECT md5(tenant) AS tenant_id, tenant AS tenant_name, is_own_use
            FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY tenant ORDER BY as_of_month DESC, is_own_use DESC) AS rn
                  FROM lease) WHERE rn = 1""", "lease"),
        "dim_calendar": _sql(f"""
            SELECT strftime(month, '%Y-%m') AS month_id, {_d('month')}, {_i('year(month)', 'year')},
                   {_i('month(month)', 'month_of_year')}
            FROM (SELECT UNNEST(generate_series(MIN(month), MAX(month), INTERVAL 1 MONTH)) AS month FROM ledger)""",
            "ledger"),
        "fact_rent": _sql(f"SELECT {_LEDGER}, {_cols(n='collection_rate_pct total_billed')} FROM rent", "rent"),
        "fact_expense": _sql(
            f"SELECT {_cols('as_of_month expense_category', 'total_actual', 'line_item_count', 'month')} FROM expense",
            "expense"),
        "prop_kpi": _sql(f"SELECT {_PROP} FROM prop", "prop"),
        "prop_kpi_excl_own_use": _sql(f"SELECT {_PROP} FROM prop_x", "prop_x"),
        "prop_kpi_with_areas": _sql(f"""
            SELECT property_id, {_PROP} FROM (
              SELECT p.* REPLACE (CASE WHEN p.total_property_sqft IS NOT NULL THEN total_sqft END AS total_property_sqft,
                                  {_pct("CASE WHEN p.total_property_sqft IS NOT NULL THEN p.leased_sqft END", "total_sqft")} AS occupancy_pct)
              FROM prop p LEFT JOIN (SELECT property_id, MAX(leased_sqft) AS total_sqft FROM ledger WHERE property_id <> '3' GROUP BY property_id) a
              ON a.property_id = p.property_id)""", "prop", "ledger", by_property=True),
        "prop_kpi_by_property": _sql(f"SELECT property_id, {_PROP} FROM prop", "prop", by_property=True),
        "building_kpi": _sql(f"SELECT {_BLD} FROM bld", "bld"),
        "building_kpi_excl_own_use": _sql(f"SELECT {_BLD} FROM bld_x", "bld_x"),
        "building_kpi_by_property": _sql(f"SELECT property_id, {_BLD} FROM bld", "bld", by_property=True),
        "noi_monthly": _noi(),
        "noi_by_property": _noi(by_property=True),
        "kpi_windows": _sql(f"SELECT {_WIN} FROM win", "win"),
        "window_listing": _sql(f"SELECT {_WIN} FROM win", "win"),
        "kpi_windows_by_property": _sql(f"SELECT property_id, {_WIN} FROM win", "win", by_property=True),
        "kpi_windows_literal": _sql(" UNION ALL ".join(f"""
            SELECT p.as_of_month AS end_month, '{size}m' AS window_size,
                   {_n('AVG(p.occupancy_pct)', 'avg_occupancy_pct')},
                   {_n('AVG(p.collection_rate_pct)', 'avg_collection_rate_pct')},
                   {_n('AVG(CAST(p.price_per_sf_yr AS DOUBLE))', 'avg_price_per_sf_yr')},
                   {_n('SUM(p.collected)', 'total_collected')}, {_n('SUM(p.rent_base)', 'total_rent_base')},
                   {_n('SUM(p.uncollected)', 'total_uncollected')},
                   {_n('AVG(CAST(p.noi_proto AS DOUBLE))', 'avg_noi_proto')},
                   {_n('AVG(p.noi_margin_pct)', 'avg_noi_margin_pct')}
            FROM prop p JOIN prop p2 ON p2.as_of_month <= p.as_of_month
                 AND p2.as_of_month >= CAST(CAST(p.as_of_month || '-01' AS DATE) - INTERVAL {size} MONTH AS VARCHAR)
            GROUP BY p.as_of_month""" for size in V.WINDOW_SIZES), "prop"),
        "kpi_last_3m": _series(_last(3)),
        "kpi_last_6m": _series(_last(6)),
        "kpi_last_9m": _series(_last(9)),
        "kpi_last_12m": _series(_last(12), "occupancy_pct_excl_own_use"),
        "kpi_ytd": _series("month >= date_trunc('year', (SELECT MAX(month) FROM prop))"),
        "kpi_ytd_by_property": _series(
            "month >= date_trunc('year', (SELECT MAX(q.month) FROM prop q WHERE q.property_id = prop.property_id))",
            by_property=True),
        "kpi_all_months": _series("month IS NOT NULL"),
        "kpi_since": _sql(
            f"SELECT {_cols(n='occupancy_pct', d='month')} FROM prop WHERE month >= DATE '2001-03-01' - INTERVAL 6 MONTH",
            "prop"),
    }


def _noi(by_property: bool = False) -> str:
    k = "property_id, " if by_property else ""
    using = "(property_id, as_of_month)" if by_property else "(as_of_month)"

    def of(category: str) -> str:
        return f"COALESCE(SUM(CASE WHEN expense_category = '{category}' THEN total_actual END), 0)"

    return _sql(f"""
        SELECT {k}{_cols('as_of_month', 'collected fixed_expenses variable_expenses other_expenses', d='month')},
               {_n('fixed_expenses + variable_expenses', 'total_expenses')},
               {_n('collected - fixed_expenses - variable_expenses', 'noi')},
               {_n(_pct('(collected - fixed_expenses - variable_expenses)', 'collected'), 'noi_margin_pct')}
        FROM (SELECT {k} as_of_month, month, collected, COALESCE(f, 0) AS fixed_expenses,
                     COALESCE(v, 0) AS variable_expenses, COALESCE(o, 0) AS other_expenses
              FROM rent LEFT JOIN (SELECT {k} as_of_month, {of('fixed')} AS f, {of('variable')} AS v, {of('other')} AS o
                                   FROM expense GROUP BY {k} as_of_month) USING {using})""",
        "rent", "expense", by_property=by_property)


def _reports() -> dict[str, str]:
    newest_lease = "as_of_month = (SELECT MAX(as_of_month) FROM lease)"
    own_lease = "lease.as_of_month = (SELECT MAX(q.as_of_month) FROM lease q WHERE q.property_id = lease.property_id)"

    def own_newest(of: str) -> str:
        return f"{of}.month = (SELECT MAX(q.month) FROM {of} q WHERE q.property_id = {of}.property_id)"

    return {
        "r01_property_overview": _sql(f"""
            SELECT {_d('month')}, {_n('occupancy_pct', 'Occupancy %')}, {_i('leased_sqft', 'Leased SqFt')},
                   {_i('total_property_sqft', 'Total SqFt')}, {_n('collected', 'Revenue Collected')},
                   {_n('rent_base', 'Rent Base')}, {_n('collection_rate_pct', 'Collection Rate %')},
                   {_n('price_per_sf_yr', 'Price $/SF/Year')}, {_n('accounts_receivable', 'AR (Uncollected)')}
            FROM prop WHERE {_NEWEST}""", "prop"),
        "r02_revenue_trends": _sql(f"""
            SELECT {_d('month')}, {_n('rent_base', 'Rent Base')}, {_n('collected', 'Collected')},
                   {_n('uncollected', 'Uncollected')}, {_n('collection_rate_pct', 'Collection %')},
                   {_n('ROUND(CAST(collected AS DOUBLE) / CAST(rent_base AS DOUBLE) * 100, 2)', 'Collection Rate (Calc)')}
            FROM (SELECT * FROM rent ORDER BY month DESC LIMIT 6)""", "rent"),
        "r03_building_comparison": _sql(f"""
            SELECT building, {_i('total_sqft', 'Total SqFt')}, {_i('occupied_sqft', 'Occupied SqFt')},
                   {_n('ROUND(occupancy_pct, 2)', 'Occupancy %')}, {_i('suite_count', 'Total Suites')},
                   {_i('vacant_count', 'Vacant Suites')}, {_i('own_use_count', 'Own-Use Suites')},
                   {_i('revenue_sqft', 'Revenue SqFt')}
            FROM bld WHERE month = (SELECT MAX(month) FROM bld)""", "bld"),
        "r01_by_property": _sql(f"""
            SELECT property_id, {_d('month')}, {_n('occupancy_pct', 'Occupancy %')}, {_i('leased_sqft', 'Leased SqFt')},
                   {_i('total_property_sqft', 'Total SqFt')}, {_n('collected', 'Revenue Collected')},
                   {_n('rent_base', 'Rent Base')}, {_n('collection_rate_pct', 'Collection Rate %')},
                   {_n('price_per_sf_yr', 'Price $/SF/Year')}, {_n('accounts_receivable', 'AR (Uncollected)')}
            FROM prop WHERE {own_newest('prop')}""", "prop", by_property=True),
        "r02_by_property": _sql(f"""
            SELECT property_id, {_d('month')}, {_n('rent_base', 'Rent Base')}, {_n('collected', 'Collected')},
                   {_n('uncollected', 'Uncollected')}, {_n('collection_rate_pct', 'Collection %')},
                   {_n('ROUND(CAST(collected AS DOUBLE) / CAST(rent_base AS DOUBLE) * 100, 2)', 'Collection Rate (Calc)')}
            FROM rent WHERE (SELECT COUNT(*) FROM rent q WHERE q.property_id = rent.property_id AND q.month > rent.month) < 6""",
            "rent", by_property=True),
        "r03_by_property": _sql(f"""
            SELECT property_id, building, {_i('total_sqft', 'Total SqFt')}, {_i('occupied_sqft', 'Occupied SqFt')},
                   {_n('ROUND(occupancy_pct, 2)', 'Occupancy %')}, {_i('suite_count', 'Total Suites')},
                   {_i('vacant_count', 'Vacant Suites')}, {_i('own_use_count', 'Own-Use Suites')},
                   {_i('revenue_sqft', 'Revenue SqFt')}
            FROM bld WHERE {own_newest('bld')}""", "bld", by_property=True),
        "r07_by_property": _sql(f"""
            SELECT property_id, building AS "Building", {_i('occupied_sqft', 'Occupied SqFt')},
                   {_n('ROUND(est, 2)', 'Est. Revenue')}, {_n('ROUND(est / NULLIF(occupied_sqft, 0), 2)', 'Revenue per SqFt')}
            FROM (SELECT property_id, b.building, b.occupied_sqft, CAST(r.collected AS DOUBLE)
                         * ({_ratio('b.revenue_sqft', 'p.revenue_sqft')}) AS est
                  FROM (SELECT * FROM bld WHERE {own_newest('bld')}) b
                  JOIN rent r USING (property_id, as_of_month, month) JOIN prop p USING (property_id, as_of_month, month))""",
            "bld", "rent", "prop", by_property=True),
        "r08_by_property": _sql(f"""
            SELECT property_id, {_d('month', 'Report Month')}, {_n('ROUND(occupancy_pct, 1)', 'Occupancy %')},
                   {_i('leased_sqft', 'Leased SqFt')}, {_i('total_property_sqft', 'Total SqFt')},
                   {_n('collected', 'Revenue Collected')}, {_n('rent_base', 'Rent Base')},
                   {_n('ROUND(collection_rate_pct, 1)', 'Collection Rate %')}, {_n('accounts_receivable', 'AR')},
                   {_n('price_per_sf_yr', 'Avg $/SF/Year')}, {_i('a_sqft', 'Building A SqFt')}, {_i('b_sqft', 'Building B SqFt')},
                   {_i('suites', 'Total Suites')}, {_i('vacant', 'Vacant Suites')}
            FROM prop LEFT JOIN (
                SELECT property_id, month, MAX(CASE WHEN building = 'A' THEN occupied_sqft END) AS a_sqft,
                       MAX(CASE WHEN building = 'B' THEN occupied_sqft END) AS b_sqft, SUM(suite_count) AS suites,
                       SUM(vacant_count) AS vacant FROM bld GROUP BY property_id, month) USING (property_id, month)
            WHERE {own_newest('prop')}""", "prop", "bld", by_property=True),
        "r04_vacant_suites": _sql(f"""
            SELECT suite_id AS "Suite", building AS "Building", {_i('sqft', 'SqFt')},
                   {_n('COALESCE(mean_rate, 0)', 'Avg $/SF/Yr (Building)')}
            FROM lease LEFT JOIN (SELECT building, AVG(CAST(rent_psf_yr AS DOUBLE)) AS mean_rate
                                  FROM lease WHERE {newest_lease} GROUP BY building) USING (building)
            WHERE is_vacant AND {newest_lease}""", "lease"),
        "r04b_all_suites": _sql(
            f"""SELECT suite_id AS "Suite", building AS "Building", {_i('sqft', 'SqFt')} FROM dim_suite""", "dim_suite"),
        "r05_tenant_roster": _sql(f"""
            SELECT tenant_name AS "Tenant", CASE WHEN is_own_use THEN 'Own-Use' ELSE 'Leased' END AS "Status",
                   {_i('COUNT(*)', '# Suites')} FROM dim_tenant GROUP BY tenant_name, is_own_use""", "dim_tenant"),
        "r06_occupancy_history": _sql(f"""
            SELECT {_d('month')}, {_n('ROUND(occupancy_pct, 2)', 'Occupancy %')}, {_i('leased_sqft', 'Leased SqFt')},
                   {_i('total_property_sqft', 'Total SqFt')}, {_n('price_per_sf_yr', 'Avg $/SF/Year')}
            FROM prop""", "prop"),
        "r07_revenue_by_building": _sql(f"""
            SELECT building AS "Building", {_i('occupied_sqft', 'Occupied SqFt')},
                   {_n('ROUND(est, 2)', 'Est. Revenue')}, {_n('ROUND(est / NULLIF(occupied_sqft, 0), 2)', 'Revenue per SqFt')}
            FROM (SELECT b.building, b.occupied_sqft, CAST(r.collected AS DOUBLE)
                         * ({_ratio('b.revenue_sqft', 'p.revenue_sqft')}) AS est
                  FROM bld b JOIN rent r USING (as_of_month, month) JOIN prop p USING (as_of_month, month)
                  WHERE month = (SELECT MAX(month) FROM bld))""", "bld", "rent", "prop"),
        "r08_kpi_summary": _sql(f"""
            SELECT {_d('month', 'Report Month')}, {_n('ROUND(occupancy_pct, 1)', 'Occupancy %')},
                   {_i('leased_sqft', 'Leased SqFt')}, {_i('total_property_sqft', 'Total SqFt')},
                   {_n('collected', 'Revenue Collected')}, {_n('rent_base', 'Rent Base')},
                   {_n('ROUND(collection_rate_pct, 1)', 'Collection Rate %')}, {_n('accounts_receivable', 'AR')},
                   {_n('price_per_sf_yr', 'Avg $/SF/Year')},
                   {_i("(SELECT MAX(occupied_sqft) FROM bld WHERE building = 'A' AND bld.month = prop.month)", 'Building A SqFt')},
                   {_i("(SELECT MAX(occupied_sqft) FROM bld WHERE building = 'B' AND bld.month = prop.month)", 'Building B SqFt')},
                   {_i('(SELECT SUM(suite_count) FROM bld WHERE bld.month = prop.month)', 'Total Suites')},
                   {_i('(SELECT SUM(vacant_count) FROM bld WHERE bld.month = prop.month)', 'Vacant Suites')}
            FROM prop WHERE {_NEWEST}""", "prop", "bld"),
        "r09_collection_analysis": _sql(f"""
            SELECT {_d('month')}, {_n('rent_base', 'Rent Base')}, {_n('collected', 'Collected')},
                   {_n('uncollected', 'Uncollected')}, {_n('ROUND(collection_rate_pct, 1)', 'Collection %')},
                   CASE WHEN collection_rate_pct < 95 THEN '{V.BELOW_TARGET_LABEL}'
                        WHEN collection_rate_pct >= 100 THEN '{V.PERFECT_LABEL}' ELSE '{V.GOOD_LABEL}' END AS "Status"
            FROM rent""", "rent"),
        "r10a_high_value": _sql(f"""
            SELECT {_cols('suite_id building', i='sqft')}, {_n('sqft * 30.00', 'Potential Annual Revenue @ $30/SF')}
            FROM dim_suite WHERE sqft > 45""", "dim_suite"),
        "r10b_size_by_building": _sql(f"""
            SELECT building, {_i('COUNT(*)', 'Suite Count')}, {_n('ROUND(AVG(sqft), 0)', 'Avg SqFt')},
                   {_i('SUM(sqft)', 'Total SqFt')} FROM dim_suite GROUP BY building""", "dim_suite"),
        "r10c_year_month": _sql(f"""
            SELECT {_i('year(month)', 'year')}, {_i('month(month)', 'month_num')},
                   {_n('ROUND(AVG(occupancy_pct), 2)', 'Avg Occupancy %')},
                   {_n('ROUND(AVG(CAST(price_per_sf_yr AS DOUBLE)), 2)', 'Avg $/SF/Year')}
            FROM prop GROUP BY year(month), month(month)""", "prop"),
        "r11_parameterised": _sql(f"""
            SELECT {_cols('as_of_month', 'collected')} FROM rent WHERE as_of_month >= '1999-01' AND leased_sqft > 100""",
            "rent"),
        "r04_by_property": _sql(f"""
            SELECT property_id, suite_id AS "Suite", building AS "Building", {_i('sqft', 'SqFt')},
                   {_n('COALESCE(mean_rate, 0)', 'Avg $/SF/Yr (Building)')}
            FROM lease LEFT JOIN (SELECT property_id, building, CAST(SUM(rent_psf_yr) AS DOUBLE) / COUNT(rent_psf_yr) AS mean_rate
                                  FROM lease WHERE {own_lease} GROUP BY property_id, building) USING (property_id, building)
            WHERE is_vacant AND {own_lease}""", "lease", by_property=True),
        "r04b_by_property": _sql(
            f"""SELECT property_id, suite_id AS "Suite", building AS "Building", {_i('sqft', 'SqFt')} FROM dim_suite""", "dim_suite", by_property=True),
        "r05_by_property": _sql(f"""
            SELECT property_id, tenant_name AS "Tenant", CASE WHEN is_own_use THEN 'Own-Use' ELSE 'Leased' END AS "Status",
                   {_i('COUNT(*)', '# Suites')} FROM dim_tenant GROUP BY property_id, tenant_name, is_own_use""", "dim_tenant", by_property=True),
        "r06_by_property": _sql(f"""
            SELECT property_id, {_d('month')}, {_n('ROUND(occupancy_pct, 2)', 'Occupancy %')}, {_i('leased_sqft', 'Leased SqFt')},
                   {_i('total_property_sqft', 'Total SqFt')}, {_n('price_per_sf_yr', 'Avg $/SF/Year')}
            FROM prop""", "prop", by_property=True),
        "r09_by_property": _sql(f"""
            SELECT property_id, {_d('month')}, {_n('rent_base', 'Rent Base')}, {_n('collected', 'Collected')},
                   {_n('uncollected', 'Uncollected')}, {_n('ROUND(collection_rate_pct, 1)', 'Collection %')},
                   CASE WHEN collection_rate_pct < 95 THEN '{V.BELOW_TARGET_LABEL}'
                        WHEN collection_rate_pct >= 100 THEN '{V.PERFECT_LABEL}' ELSE '{V.GOOD_LABEL}' END AS "Status"
            FROM rent""", "rent", by_property=True),
        "r10a_by_property": _sql(f"""
            SELECT property_id, {_cols('suite_id building', i='sqft')}, {_n('sqft * 30.00', 'Potential Annual Revenue @ $30/SF')}
            FROM dim_suite WHERE sqft > 45""", "dim_suite", by_property=True),
        "r10b_by_property": _sql(f"""
            SELECT property_id, building, {_i('COUNT(*)', 'Suite Count')}, {_n('ROUND(AVG(sqft), 0)', 'Avg SqFt')},
                   {_i('SUM(sqft)', 'Total SqFt')} FROM dim_suite GROUP BY property_id, building""", "dim_suite", by_property=True),
        "r10c_by_property": _sql(f"""
            SELECT property_id, {_i('year(month)', 'year')}, {_i('month(month)', 'month_num')},
                   {_n('ROUND(AVG(occupancy_pct), 2)', 'Avg Occupancy %')},
                   {_n('ROUND(AVG(CAST(price_per_sf_yr AS DOUBLE)), 2)', 'Avg $/SF/Year')}
            FROM prop GROUP BY property_id, year(month), month(month)""", "prop", by_property=True),
        "latest_kpis_by_property": _sql(f"SELECT property_id, {_PROP} FROM prop WHERE {own_newest('prop')}", "prop", by_property=True),
        "kpi_since_by_property": _sql(f"""
            SELECT property_id, {_d('month')}, {_n('occupancy_pct')} FROM prop WHERE month >= DATE '2000-09-01'""", "prop", by_property=True),
        "latest_buildings_by_property": _sql(f"""
            SELECT property_id, {_cols('building', 'occupancy_pct', 'occupied_sqft')} FROM bld WHERE {own_newest('bld')}""", "bld", by_property=True),
        "tenant_suite_count_by_property": _sql(f"""
            SELECT property_id, tenant AS tenant_name, {_i('COUNT(DISTINCT suite_id)', 'suite_count')}
            FROM lease GROUP BY property_id, tenant""", "lease", by_property=True),
        "building_latest_by_property": _sql(f"""
            SELECT property_id, {_d('month')},
                   {_n("COALESCE(MAX(CASE WHEN building = 'A' THEN occupancy_pct END), 0)", 'building_a_pct')},
                   {_n("COALESCE(MAX(CASE WHEN building = 'B' THEN occupancy_pct END), 0)", 'building_b_pct')}
            FROM bld WHERE {own_newest('bld')} GROUP BY property_id, month""", "bld", by_property=True),
        "suite_status_by_property": _sql(f"""
            SELECT property_id, {_LEASE.split(', ', 1)[1]},
                   CASE WHEN is_own_use THEN 'Own-Use' WHEN is_vacant THEN 'Vacant' ELSE 'Leased' END AS status
            FROM lease WHERE {own_lease}""", "lease", by_property=True),
        "summary_cards_by_property": _sql(f"""
            SELECT property_id, {_n('occupancy_pct', 'occupancy')}, {_n('collected', 'monthly_revenue')},
                   {_n('price_per_sf_yr', 'price_per_sf')}, {_n('collection_rate_pct', 'collection_rate')},
                   {_n('noi_proto')}, {_n('noi_margin_pct')}, {_n('leased_sqft')},
                   {_i('total_suites')}, {_i('vacant_suites')}, {_i('own_use_suites')}, {_i('9917', 'total_sqft')}
            FROM (SELECT * FROM prop WHERE {own_newest('prop')}) JOIN (
              SELECT property_id, COUNT(*) AS total_suites, SUM(CASE WHEN is_vacant THEN 1 ELSE 0 END) AS vacant_suites,
                     SUM(CASE WHEN is_own_use THEN 1 ELSE 0 END) AS own_use_suites
              FROM lease WHERE {own_lease} GROUP BY property_id) USING (property_id)""", "prop", "lease", by_property=True),
        "latest_kpis": _sql(f"SELECT {_PROP} FROM prop WHERE {_NEWEST}", "prop"),
        "latest_buildings": _sql(f"""
            SELECT {_cols('building', 'occupancy_pct', 'occupied_sqft')} FROM bld
            WHERE month = (SELECT MAX(month) FROM bld)""", "bld"),
        "tenant_suite_count_by_window": _sql(f"""
            SELECT l.tenant, e.end_month, n || 'm' AS window_size, {_i('COUNT(DISTINCT l.suite_id)', 'suite_count')}
            FROM (SELECT DISTINCT as_of_month AS end_month FROM lease) e, (VALUES (3), (6), (9), (12)) w(n), lease l
            WHERE {_within('l', 'e.end_month')} GROUP BY ALL""", "lease"),
        "building_suite_count_by_window": _sql(f"""
            SELECT l.property_id, l.building, e.end_month, n || 'm' AS window_size, {_i('COUNT(DISTINCT l.suite_id)', 'suite_count')}
            FROM (SELECT DISTINCT property_id, as_of_month AS end_month FROM lease) e, (VALUES (3), (6), (9), (12)) w(n), lease l
            WHERE l.property_id = e.property_id AND {_within('l', 'e.end_month')} GROUP BY ALL""", "lease", by_property=True),
        "tenant_suite_count": _sql(f"""
            SELECT t.tenant_name, {_i('COUNT(DISTINCT s.suite_id)', 'suite_count')}
            FROM dim_tenant t JOIN lease s ON md5(s.tenant) = t.tenant_id GROUP BY t.tenant_name""",
            "dim_tenant", "lease"),
        "building_series": _sql(f"""
            SELECT {_BLD}, {_n('occupancy_pct', 'shown_occupancy_pct')} FROM bld
            WHERE month >= (SELECT MAX(month) FROM bld) - INTERVAL 5 MONTH""", "bld"),
        "building_latest": _sql(f"""
            SELECT {_d('month')},
                   {_n("COALESCE(MAX(CASE WHEN building = 'A' THEN occupancy_pct END), 0)", 'building_a_pct')},
                   {_n("COALESCE(MAX(CASE WHEN building = 'B' THEN occupancy_pct END), 0)", 'building_b_pct')}
            FROM bld WHERE month = (SELECT MAX(month) FROM bld) GROUP BY month""", "bld"),
        "building_last_rows": _sql(f"""
            SELECT {_BLD} FROM bld b
            WHERE month = (SELECT MAX(q.month) FROM bld q WHERE q.building = b.building)""", "bld"),
        "expense_stack": _sql(f"""
            SELECT as_of_month, {_d('month')}, {", ".join(
                _n(f"COALESCE(SUM(CASE WHEN expense_category = '{c}' THEN total_actual END), 0)", c)
                for c in V.EXPENSE_CATEGORIES)}
            FROM expense GROUP BY as_of_month, month""", "expense"),
        "expense_against_budget": _sql(f"""
            SELECT {_cols('as_of_month expense_category', 'total_actual total_budget')},
                   {_n('total_actual - total_budget', 'total_variance')},
                   {_n(_pct('total_actual', 'total_budget'), 'budget_adherence_pct')}
            FROM (SELECT *, CASE WHEN expense_category <> 'other' THEN total_actual * 2 END AS total_budget
                  FROM expense)""", "expense"),
        "suite_status": _sql(f"""
            SELECT {_LEASE.split(', ', 1)[1]},
                   CASE WHEN is_own_use THEN 'Own-Use' WHEN is_vacant THEN 'Vacant' ELSE 'Leased' END AS status
            FROM lease WHERE {newest_lease}""", "lease"),
        "summary_cards": _sql(f"""
            SELECT {_n('occupancy_pct', 'occupancy')}, {_n('collected', 'monthly_revenue')},
                   {_n('price_per_sf_yr', 'price_per_sf')}, {_n('collection_rate_pct', 'collection_rate')},
                   {_n('noi_proto')}, {_n('noi_margin_pct')}, {_n('leased_sqft')},
                   {_i(f'(SELECT COUNT(*) FROM lease WHERE {newest_lease})', 'total_suites')},
                   {_i(f'(SELECT COUNT(*) FROM lease WHERE is_vacant AND {newest_lease})', 'vacant_suites')},
                   {_i(f'(SELECT COUNT(*) FROM lease WHERE is_own_use AND {newest_lease})', 'own_use_suites')},
                   {_i('9917', 'total_sqft')}
            FROM prop WHERE {_NEWEST}""", "prop", "lease"),
        "portfolio_totals": _sql(f"""
            SELECT {_d('month')}, {_i('COUNT(DISTINCT building)', 'buildings')}, {_i('SUM(suite_count)', 'total_suites')},
                   {_i('SUM(suite_count) - SUM(vacant_count)', 'occupied_suites')},
                   {_n('MAX(collected)', 'total_revenue')},
                   {_n(_pct('(SUM(suite_count) - SUM(vacant_count))', 'SUM(suite_count)'), 'avg_occupancy_pct')}
            FROM bld JOIN rent USING (as_of_month, month) WHERE month = (SELECT MAX(month) FROM bld)
            GROUP BY month""", "bld", "rent"),
        **{name: _sql(f"""
            SELECT {k} {_d('MAX(month)', 'month')}, {_i('SUM(buildings)', 'buildings')}, {_i('SUM(suites)', 'total_suites')},
                   {_i('SUM(suites - vacant)', 'occupied_suites')}, {_n('SUM(collected)', 'total_revenue')},
                   {_n(_pct('SUM(suites - vacant)', 'SUM(suites)'), 'avg_occupancy_pct')}
            FROM (SELECT property_id, month, COUNT(*) AS buildings, SUM(suite_count) AS suites, SUM(vacant_count) AS vacant
                  FROM bld GROUP BY property_id, month) b
            JOIN rent USING (property_id, month)
            WHERE month = (SELECT MAX(q.month) FROM bld q WHERE q.property_id = b.property_id) {group}""",
                   "bld", "rent", by_property=True)
           for name, k, group in (("portfolio_totals_by_property", "property_id,", "GROUP BY property_id"), ("portfolio_totals_all", "", ""))},
        "last_12_points": _sql(f"""
            SELECT {_cols(n='collected occupancy_pct price_per_sf_yr', d='month')}
            FROM (SELECT * FROM prop ORDER BY month DESC LIMIT 12)""", "prop"),
        "vs_target": _sql(f"""
            SELECT {_cols('as_of_month', 'occupancy_pct collection_rate_pct', d='month')},
                   {_n('85', 'occupancy_target')}, {_n('occupancy_pct - 85', 'occupancy_gap')},
                   occupancy_pct - 85 >= 0 AS occupancy_met, {_n('100', 'collection_target')},
                   {_n('collection_rate_pct - 100', 'collection_gap')}, collection_rate_pct - 100 >= 0 AS collection_met
            FROM prop""", "prop"),
    }


def _forecasts() -> dict[str, str]:
    wide = ", ".join(
        _n(f"MAX(CASE WHEN metric = '{m}' THEN {p} END)", f"{m}_{p}", 2)
        for m in V.FORECAST_METRICS for p in ("p10", "p50", "p90"))
    return {
        "forecast_series": _sql(f"SELECT {_cols('metric', 'y', d='month')} FROM points", "points"),
        "forecast_model_choice": _sql(f"""
            SELECT metric, {_i('COUNT(*)', 'n')},
                   CASE WHEN COUNT(*) >= 24 THEN 'seasonal' ELSE 'autoregressive' END AS model
            FROM points GROUP BY metric HAVING COUNT(*) >= 3""", "points"),
        "forecast_long": _sql(f"SELECT {_FC} FROM fc", "fc"),
        "forecast_short": _sql(f"SELECT {_i('year')}, {_FC} FROM fc_yearly", "fc_yearly"),
        "forecast_horizons": _sql(f"SELECT {_FC} FROM fc WHERE horizon IN (3, 6, 9, 12)", "fc"),
        "forecast_wide": _sql(f"""
            SELECT strftime(forecast_month, '%Y-%m') AS forecast_month, {_i('horizon')}, {wide}
            FROM fc GROUP BY fc.forecast_month, horizon""", "fc"),
        "forecast_sink": _sql(f"""
            SELECT strftime(forecast_month, '%Y-%m') AS forecast_month, {_i('horizon')}, {wide}
            FROM fc GROUP BY fc.forecast_month, horizon""", "fc"),
        "forecast_selected": _selected(),
        "forecast_selected_short": _selected("year, "),
        "forecast_by_property": _sql(f"SELECT property_id, {_FC} FROM fc", "fc", by_property=True),
        "forecast_backtest": _sql(f"""
            SELECT metric, {_i('COUNT(*)', 'points')}, {_n('AVG(abs(p50 - y))', 'mae', 2)},
                   {_n('sqrt(AVG((p50 - y) * (p50 - y)))', 'rmse', 2)}
            FROM fc_held JOIN points p USING (metric) WHERE p.month = forecast_month GROUP BY metric""",
            "fc_held", "points"),
        "history_and_forecast": _sql(f"""
            SELECT metric, part, {_cols(n='value p10 p90', d='month', places=2)}
            FROM (SELECT month, metric, 'history' AS part, y AS value, NULL AS p10, NULL AS p90 FROM points
                  UNION ALL SELECT forecast_month, metric, 'forecast', p50, p10, p90 FROM fc)""", "points", "fc"),
    }


def _selected(k: str = "") -> str:
    """Every candidate run over every series by recursion, one month a step."""
    from leasemill.operators.smoothing import GRID, TESTED

    grain = f"{k}metric"
    grid = ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE, {p}::DOUBLE)" for i, (a, b, p) in enumerate(GRID))
    source = "(SELECT year(month) AS year, * FROM points)" if k else "points"
    return _sql(f"""
        , grid AS (SELECT * FROM (VALUES {grid}) AS g(candidate, alpha, beta, phi)),
        placed AS (
          SELECT {grain}, month, y, ROW_NUMBER() OVER w AS t, COUNT(*) OVER (PARTITION BY {grain}) AS n,
                 MAX(month) OVER (PARTITION BY {grain}) AS last_month, lag(y, 12) OVER w AS year_before
          FROM {source} WHERE y IS NOT NULL WINDOW w AS (PARTITION BY {grain} ORDER BY month)),
        fold AS (
          SELECT {grain}, candidate, t, n, y AS level, 0::DOUBLE AS trend, 0::DOUBLE AS sse FROM placed, grid WHERE t = 1 AND n >= 3
          UNION ALL
          SELECT {grain}, candidate, t, n, guess + alpha * miss, phi * trend + alpha * beta * miss,
                 sse + CASE WHEN t > n - least({TESTED}, n - 2) THEN miss * miss ELSE 0::DOUBLE END
          FROM (SELECT {", ".join("f." + c.strip() for c in grain.split(","))}, f.candidate, p.t, f.n, alpha, beta, phi, f.trend, f.sse, f.level + phi * f.trend AS guess,
                       p.y - (f.level + phi * f.trend) AS miss
                FROM fold f JOIN grid g ON g.candidate = f.candidate
                JOIN placed p ON p.t = f.t + 1 AND {" AND ".join(f"p.{c.strip()} = f.{c.strip()}" for c in grain.split(","))})),
        fits AS (
          SELECT {grain}, candidate, n, level, trend, sse / least({TESTED}, n - 2) AS mse FROM fold WHERE t = n
          UNION ALL
          SELECT {grain}, {len(GRID)}, n, 0, 0, SUM((y - year_before) * (y - year_before) ORDER BY t) / {TESTED}
          FROM placed WHERE n >= 24 AND t > n - {TESTED} GROUP BY {grain}, n),
        best AS (
          SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {grain} ORDER BY mse, candidate) AS place FROM fits) WHERE place = 1),
        steps AS (
          SELECT b.*, COALESCE(alpha, 0) AS alpha, COALESCE(beta, 0) AS beta, COALESCE(phi, 0) AS phi, h.h,
                 list_sum(list_transform(range(1, h.h + 1), lambda i: pow(COALESCE(phi, 0), i))) AS reach,
                 1 + COALESCE(list_sum(list_transform(range(1, h.h), lambda j:
                   pow(alpha + alpha * beta * list_sum(list_transform(range(1, j + 1), lambda i: pow(phi, i))), 2))), 0) AS factor
          FROM best b LEFT JOIN grid g ON g.candidate = b.candidate, (SELECT UNNEST(range(1, 13)) AS h) h),
        shown AS (
          SELECT {", ".join("s." + c.strip() for c in grain.split(","))}, h AS horizon, CAST(p.last_month + to_months(CAST(h AS INTEGER)) AS DATE) AS forecast_month,
                 CASE WHEN candidate = {len(GRID)} THEN 'seasonal' WHEN beta = 0 THEN 'level' WHEN phi < 1 THEN 'damped' ELSE 'trend' END AS model,
                 s.n AS n_points, sqrt(mse) AS tested_rmse, CASE WHEN candidate = {len(GRID)} THEN p.y ELSE level + reach * trend END AS mid,
                 {V.Z80} * sqrt(mse * CASE WHEN candidate = {len(GRID)} THEN 1 ELSE factor END) AS half
          FROM steps s JOIN placed p ON {" AND ".join(f"p.{c.strip()} = s.{c.strip()}" for c in grain.split(","))}
               AND p.t = CASE WHEN candidate = {len(GRID)} THEN s.n - 12 + h ELSE 1 END)
        SELECT {k.replace("year", _i("year"))} metric, model, {_i("horizon")}, {_i("n_points")}, {_d("forecast_month")}, {_n("tested_rmse", places=2)},
               {_n("mid - half", "p10", 2)}, {_n("mid", "p50", 2)}, {_n("mid + half", "p90", 2)} FROM shown""", "points").replace("WITH ", "WITH RECURSIVE ", 1)


def _history() -> dict[str, str]:
    carried = "as_of_month building tenant sqft rent_monthly rent_annual rent_psf_yr is_vacant is_own_use"
    return {
        "scd2_lease": _sql(f"""
            SELECT suite_id, building, tenant, is_vacant, is_own_use, as_of_month, valid_from, {_TO},
                   {_cols(n='rent_monthly rent_annual rent_psf_yr', i='sqft version')}
            FROM ({_scd('lease', _CHECKED, carried)})""", "lease"),
        "scd2_incremental": _sql(f"""
            SELECT property_id, suite_id, tenant, as_of_month, valid_from, {_TO}, {_cols(n='rent_monthly', i='sqft version')}
            FROM ({_scd('lease', _CHECKED, 'tenant rent_monthly sqft as_of_month', 'property_id, suite_id', True)})""",
            "lease", by_property=True),
        "scd2_status": _sql(f"""
            SELECT suite_id, tenant, is_vacant, {_i('version')}, valid_from, {_TO}
            FROM ({_scd('lease', ['tenant', 'is_vacant'], 'tenant is_vacant')})""", "lease"),
        "scd2_by_property": _sql(f"""
            SELECT property_id, suite_id, tenant, {_n('rent_monthly')}, {_i('version')}, valid_from, {_TO}
            FROM ({_scd('lease', _CHECKED, 'tenant rent_monthly', 'property_id, suite_id', True)})""",
            "lease", by_property=True),
        "scd2_hard_delete": _sql(f"""
            SELECT suite_id, {_i('version')}, valid_from, valid_to, returned_in
            FROM (SELECT *, lead(valid_from) OVER (PARTITION BY suite_id ORDER BY version) AS returned_in,
                         NULLIF(valid_to_or_null, '') AS valid_to
                  FROM ({_scd('lease', ['is_vacant'], 'is_vacant')}))
            WHERE valid_to IS NOT NULL AND (returned_in IS NULL OR returned_in > valid_to)""", "lease"),
        "latest_snapshot": _sql(
            f"SELECT {_LEASE} FROM lease WHERE as_of_month = (SELECT MAX(as_of_month) FROM lease)", "lease"),
        "latest_snapshot_by_property": _sql(f"""
            SELECT property_id, {_LEASE} FROM lease
            WHERE as_of_month = (SELECT MAX(q.as_of_month) FROM lease q WHERE q.property_id = lease.property_id)""",
            "lease", by_property=True),
        "incremental_new_months": _sql(f"SELECT {_LEDGER} FROM ledger WHERE as_of_month > '1999-06'", "ledger"),
        "gold_after_late_month": _sql(f"""
            SELECT property_id, {_WIN}, {_n('noi')} FROM win JOIN (
              SELECT property_id, as_of_month AS end_month, collected - COALESCE(spent, 0) AS noi FROM rent
              LEFT JOIN (SELECT property_id, as_of_month, SUM(total_actual) AS spent FROM expense WHERE expense_category IN ('fixed', 'variable')
                         GROUP BY ALL) USING (property_id, as_of_month)) USING (property_id, end_month)""",
            "win", "rent", "expense", by_property=True),
        "late_month": _sql(f"SELECT {_LEDGER} FROM ledger", "ledger"),
        "full_refresh": _sql(
            f"SELECT {_cols('as_of_month item expense_category', 'actual', d='month')} FROM expenses", "expenses"),
        "upsert_by_key": _sql(f"""
            SELECT as_of_month, suite_id, building, {_i('sqft')},
                   {_n("rent_monthly + CASE WHEN as_of_month LIKE '1997%' AND building = 'B' THEN 100 ELSE 0 END", 'rent_monthly')}
            FROM lease""", "lease"),
        "file_dedupe": _sql("""
            SELECT 'portfolio_' || as_of_month || '.xlsx' AS file, md5('portfolio_' || as_of_month || '.xlsx') AS _file_md5,
                   as_of_month
            FROM ledger WHERE as_of_month NOT IN (SELECT as_of_month FROM lease WHERE as_of_month < '1999-01')""",
            "ledger", "lease"),
    }


def _ingestion() -> dict[str, str]:
    month = "strftime(o_orderdate, '%Y-%m')"
    alias = """CASE WHEN p_size % 4 = 0 THEN {0} WHEN p_size % 4 = 1 THEN {1} WHEN p_size % 4 = 2 THEN {2}
               ELSE lower(p_name) END"""
    return {
        "partition_scan": _sql(f"""
            SELECT {_cols('as_of_month', 'rent_base collected uncollected leased_sqft price_per_sf_yr', d='month')}
            FROM raw_ledger WHERE as_of_month >= '2000-01'""", "raw_ledger"),
        "bronze_view": _sql(f"""
            SELECT as_of_month, expense_category, {_i('COUNT(*)', 'items')}, {_n('MAX(actual)', 'largest')}
            FROM raw_expenses GROUP BY as_of_month, expense_category""", "raw_expenses"),
        "partition_replace": _sql(f"""
            SELECT as_of_month, {_n('rent_base')},
                   {_n("CASE WHEN as_of_month LIKE '1996%' THEN rent_base ELSE collected END", 'collected')}
            FROM raw_ledger""", "raw_ledger"),
        "grid_ledger": _sql(f"""
            SELECT f.as_of_month, {_d('s.month', 'month')}, {_n('s.rent_base', 'rent_base')},
                   {_n("CASE WHEN month(s.month) = 1 AND s.as_of_month <> f.as_of_month THEN NULL ELSE s.collected END", 'collected')},
                   {_n('s.uncollected', 'uncollected')}, {_n('s.leased_sqft', 'leased_sqft')},
                   {_n('CAST(s.price_per_sf_yr AS DECIMAL(28,8))', 'price_per_sf_yr')}
            FROM raw_ledger f JOIN raw_ledger s ON year(s.month) = year(f.month) AND s.month <= f.month""",
            "raw_ledger"),
        "grid_expenses": _sql(f"""
            SELECT f.as_of_month, {_d('s.month', 'month')}, s.expense_category, {_n('s.actual', 'actual')},
                   COALESCE(own.item, CASE s.item WHEN 'MEDIUM' THEN 'Electricity' WHEN 'STANDARD' THEN 'Internet'
                       WHEN 'LARGE' THEN 'Repairs' WHEN 'PROMO' THEN 'Real Estate Agent'
                       WHEN 'SMALL' THEN 'Accrued Property tax' ELSE 'Other' END) AS item
            FROM raw_ledger f JOIN raw_expenses s ON year(s.month) = year(f.month) AND s.month <= f.month
            LEFT JOIN raw_expenses own ON own.as_of_month = f.as_of_month AND own.item = s.item""",
            "raw_ledger", "raw_expenses"),
        "grid_lease": _sql(f"""
            SELECT as_of_month, suite_id, building, tenant, is_vacant,
                   is_own_use OR lower(tenant || ' ' || suite_id) LIKE '%101b%' AS is_own_use,
                   {_cols(n='sqft rent_monthly rent_annual rent_psf_yr')} FROM raw_lease""", "raw_lease"),
        "sheet_pick": _sql("""
            SELECT 'portfolio_' || as_of_month || '.xlsx' AS file,
                   CASE WHEN as_of_month[6:7] < '07' THEN 'DASHBOARD old' ELSE 'My Dashboard' END AS sheet
            FROM raw_ledger""", "raw_ledger"),
        "sheet_outputs": _sql(f"""
            SELECT 'portfolio_' || l.as_of_month || '.xlsx' AS file, 'Dashboard_(2025)' AS sheet_safe,
                   {_i("7 + items + CASE WHEN l.as_of_month < '2000' THEN 1 ELSE 0 END", 'row_count')}
            FROM raw_ledger l JOIN (SELECT f.as_of_month, COUNT(DISTINCT s.item) AS items
                                    FROM raw_ledger f JOIN raw_expenses s
                                      ON year(s.month) = year(f.month) AND s.month <= f.month
                                    GROUP BY f.as_of_month) USING (as_of_month)
            UNION ALL
            SELECT 'portfolio_' || as_of_month || '.xlsx', 'Lease_Rate',
                   CAST(COUNT(*) + 2 + CASE WHEN as_of_month < '2000' THEN 1 ELSE 0 END AS BIGINT)
            FROM raw_lease GROUP BY as_of_month""", "raw_ledger", "raw_expenses", "raw_lease"),
        "alias_columns": f"""
            SELECT {_i('p_partkey')}, {alias.format("'tenant'", "'rent_monthly'", "'rent_psf_yr'")} AS lease_column,
                   {alias.format("'inquilino'", "'renta mensual'", "'price_per_sf_yr'")} AS ledger_column FROM part""",
        "alias_every_header": _every_alias(),
        "expense_sheet": _sql(f"""
            SELECT 'portfolio_' || as_of_month || '.xlsx' AS file, {_i("place + CASE WHEN odd THEN 4 ELSE 6 END", 'row')}, item,
                   CASE WHEN odd THEN 'Vendor ' || place ELSE NULL END AS vendor, {_n('actual')},
                   {_n('budget')}, {_n('CASE WHEN odd THEN -7 ELSE budget - actual END', 'variance')}
            FROM (SELECT as_of_month, item, month(month) % 2 = 1 AS odd, place, actual,
                         CASE WHEN place % 3 <> 0 THEN 1000 * place END AS budget
                  FROM raw_expenses JOIN (SELECT UNNEST([{', '.join(map(repr, ITEM_ROWS))}]) AS item,
                                                 UNNEST(range(0, 6)) AS place) USING (item))""", "raw_expenses"),
        "clean_rows": f"""
            SELECT o_orderpriority AS priority, {_i('o_orderkey', 'order_key')} FROM orders WHERE o_orderstatus <> 'P'""",
        "numeric_coerce": f"""
            SELECT {_i('o_orderkey')}, {_n('''CASE o_orderkey % 5 WHEN 0 THEN o_totalprice
                WHEN 3 THEN CAST(o_orderkey AS DOUBLE) * 100 WHEN 4 THEN -o_totalprice END''', 'value')} FROM orders""",
        "lease_flags": _sql("""
            SELECT as_of_month, suite_id, building, gap = 0 OR tenant = 'Vacant' AS is_vacant,
                   (gap <> 0 AND tenant = 'Owner Use') OR suite_id LIKE '%101B%' AS is_own_use
            FROM (SELECT *, (length(suite_id) + CAST(as_of_month[6:7] AS INTEGER)) % 3 AS gap FROM lease)""", "lease"),
        "as_of_month_detect": _sql(f"""
            SELECT CASE kind WHEN 2 THEN 'in/report_20' || strftime(month, '%y-%m') || '_final.xlsx'
                        ELSE 'in/upload ' || strftime(month, '%b%Y') || '.xlsx' END AS file,
                   CASE kind WHEN 2 THEN '20' || strftime(month, '%y-%m') WHEN 3 THEN '1999-12' ELSE as_of_month END
                       AS as_of_month,
                   CASE kind WHEN 0 THEN 'month_column' WHEN 1 THEN 'period_cell' WHEN 2 THEN 'file_name'
                        ELSE 'run_month' END AS rule
            FROM (SELECT *, {_month_no('month')} % 4 AS kind FROM raw_ledger)""", "raw_ledger"),
        "landing_path_parse": f"""
            SELECT 'raw/org' || o_custkey % 5 || '/b' || o_custkey % 3 || '/' || strftime(o_orderdate, '%Y/%m/%d') || '/'
                       || (1700000000 + o_orderkey) || '-book ' || o_orderkey || ending AS path,
                   'org' || o_custkey % 5 AS org_id, 'b' || o_custkey % 3 AS building_id,
                   {_d('o_orderdate', 'upload_date')}, {_i('1700000000 + o_orderkey', 'epoch')},
                   'book ' || o_orderkey || ending AS filename,
                   'bronze/org' || o_custkey % 5 || '/b' || o_custkey % 3 || '/' || strftime(o_orderdate, '%Y/%m/%d') || '/'
                       || (1700000000 + o_orderkey) || '-book ' || o_orderkey || '_Lease_Rate_A.parquet' AS converted
            FROM (SELECT *, CASE WHEN o_orderkey % 5 = 1 THEN '.xls' ELSE '.xlsx' END AS ending FROM orders)
            WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0""",
        "rent_psf": _sql(f"""
            SELECT as_of_month, suite_id, {_n(_ratio('rent_annual', 'CASE WHEN sqft % 7 <> 0 THEN sqft END'), 'rent_psf')}
            FROM lease""", "lease"),
        "ingest_counts": _sql(f"""
            SELECT as_of_month, {_i('COUNT(*)', 'suites')}, {_i('SUM(CASE WHEN is_vacant THEN 1 ELSE 0 END)', 'vacant')},
                   {_i('SUM(CASE WHEN is_own_use THEN 1 ELSE 0 END)', 'own_use')},
                   {", ".join(_i(f"COALESCE(ANY_VALUE({c}_n), 0)", c) for c in V.EXPENSE_CATEGORIES)}
            FROM raw_lease LEFT JOIN (SELECT as_of_month, {", ".join(
                f"SUM(CASE WHEN expense_category = '{c}' THEN 1 ELSE 0 END) AS {c}_n" for c in V.EXPENSE_CATEGORIES)}
                FROM raw_expenses GROUP BY as_of_month) USING (as_of_month)
            GROUP BY as_of_month""", "raw_lease", "raw_expenses"),
        "csv_round_trip": _sql(
            f"SELECT {_cols('as_of_month expense_category', 'total_actual', 'line_item_count', 'month')} FROM expense",
            "expense"),
        "csv_export": _sql(f"""
            SELECT 'prop_kpi_monthly' AS table_name, 'success' AS status, {_i('COUNT(*)', 'row_count')} FROM ledger
            UNION ALL SELECT 'broken', 'failed', 0
            UNION ALL SELECT 'fact_expense_monthly', 'success', COUNT(*) FROM expense""", "ledger", "expense"),
        "lake_copy": _sql(f"""
            SELECT 'raw_dashboard_monthly' AS table_name, as_of_month, {_i('COUNT(*)', 'row_count')} FROM raw_ledger
            GROUP BY as_of_month
            UNION ALL SELECT 'raw_lease_rate_snapshot', as_of_month, COUNT(*) FROM raw_lease GROUP BY as_of_month""",
            "raw_ledger", "raw_lease"),
        "stream_ingest_equals_batch": _sql(f"""
            SELECT as_of_month, suite_id, building, tenant, is_vacant,
                   is_own_use OR suite_id LIKE '%101B%' AS is_own_use,
                   {_cols(n='rent_monthly rent_annual rent_psf_yr', i='sqft')} FROM lease""", "lease"),
        "stream_two_properties": _sql(f"""
            SELECT b AS property_id, as_of_month, {_i('COUNT(*)', 'suites')},
                   {_n("SUM(CAST(rent_monthly AS DECIMAL(18,2)) * CASE WHEN b = 'org-b2' THEN 2 ELSE 1 END)", 'rent')}
            FROM raw_lease, (VALUES ('org-b1'), ('org-b2')) AS t(b) GROUP BY b, as_of_month""", "raw_lease"),
        "stream_replay": _sql(f"""
            SELECT l.as_of_month, 'success' AS status, {_i('1', 'entries')},
                   {_i('month(l.month) + spent', 'rows_ingested')}
            FROM raw_ledger l JOIN (SELECT f.as_of_month, COUNT(*) AS spent FROM raw_ledger f JOIN raw_expenses s
                                      ON year(s.month) = year(f.month) AND s.month <= f.month
                                    GROUP BY f.as_of_month) USING (as_of_month)
            UNION ALL SELECT as_of_month, 'skipped', 1, 0 FROM raw_ledger""", "raw_ledger", "raw_expenses"),
    }


def _flawed() -> str:
    return """
        SELECT as_of_month, suite_id, is_vacant, is_own_use, rent_monthly, rent_annual, rent_psf_yr,
               CASE WHEN area % 11 = 0 THEN -sqft ELSE sqft END AS sqft,
               CASE WHEN area % 13 = 0 THEN 'C' WHEN area % 17 = 0 THEN NULL ELSE building END AS building,
               CASE WHEN area % 19 = 0 AND as_of_month > '1998' THEN NULL ELSE tenant END AS tenant
        FROM (SELECT *, CAST(sqft AS BIGINT) AS area FROM raw_lease)"""


def _quality() -> dict[str, str]:
    flawed = f"({_flawed()})"
    building_broken = "building IS NOT NULL AND building NOT IN ('A', 'B')"
    amounts = ("sqft", "rent_monthly", "rent_annual", "rent_psf_yr")
    summary = [("building", "accepted_values", building_broken),
               *[(c, "not_null", f"{c} IS NULL") for c in ("as_of_month", "suite_id", "tenant", "is_vacant", "is_own_use")],
               *[(c, "type_double", "FALSE") for c in amounts], *[(c, "at_least_0", f"{c} < 0") for c in amounts],
               *[(c, "not_null", "FALSE") for c in ("_file_md5", "_ingested_at")]]

    def counted(table: str, column: str, check: str, broken: str, source: str, severity: str = "error",
                by: str = "as_of_month, ") -> str:
        group = "GROUP BY as_of_month" if by else ""
        return f"""
            SELECT '{table}' AS table_name, {by} {_i('COUNT(*)', 'row_count')}, '{column}' AS "column",
                   '{check}' AS "check", '{severity}' AS severity,
                   {_i(f'COALESCE(SUM(CASE WHEN {broken} THEN 1 ELSE 0 END), 0)', 'failure_count')},
                   COALESCE(SUM(CASE WHEN {broken} THEN 1 ELSE 0 END), 0) = 0 AS passed
            FROM {source} {group}"""

    cases = [("sqft", "at_least_0", "sqft < 0", None),
             ("building", "accepted_values", building_broken, "building"),
             ("tenant", "not_null", "tenant IS NULL", "NULL")]
    sqft_text = "CAST(CAST(sqft AS BIGINT) AS VARCHAR) || '.0'"
    rate = _pct("collected", "rent_base")
    occupancy = _pct("leased_sqft", "total_property_sqft")
    rules = [
        ("prop_kpi_monthly", "total_property_sqft", "constant_total", "FALSE", "prop", "error"),
        ("prop_kpi_monthly", "occupancy_pct", "occupancy_formula",
         f"leased_sqft > 0 AND total_property_sqft > 0 AND abs(occupancy_pct - ({occupancy})) >= 0.01", "prop", "error"),
        ("prop_kpi_monthly", "accounts_receivable", "equals_uncollected", "accounts_receivable <> uncollected", "prop",
         "error"),
        ("prop_kpi_monthly", "price_per_sf_yr", "between_1_1000", "price_per_sf_yr < 1 OR price_per_sf_yr > 1000", "prop",
         "error"),
        ("fact_rent_monthly", "collection_rate_pct", "rate_formula",
         f"rent_base > 0 AND abs(collection_rate_pct - ({rate})) >= 0.01", "rent", "error"),
        ("fact_rent_monthly", "collection_rate_pct", "between_0_110",
         "collection_rate_pct < 0 OR collection_rate_pct > 110", "rent", "error"),
        ("raw_dashboard_monthly", "month", "not_null", "month IS NULL", "raw_ledger", "error"),
        *[("raw_dashboard_monthly", c, "at_least_0", f"{c} < 0", "raw_ledger", "error")
          for c in ("rent_base", "collected", "uncollected", "leased_sqft", "price_per_sf_yr")],
        ("raw_dashboard_monthly", "collected", "at_most_110_pct_of_base",
         "collected > rent_base * CAST(1.1 AS DOUBLE)", "raw_ledger", "warning"),
        ("raw_lease_rate_snapshot", "suite_id", "not_null", "suite_id IS NULL", "raw_lease", "error"),
        ("raw_lease_rate_snapshot", "building", "accepted_values", building_broken, "raw_lease", "error"),
        *[("raw_lease_rate_snapshot", c, "at_least_0", f"{c} < 0", "raw_lease", "error")
          for c in ("sqft", "rent_monthly", "rent_annual", "rent_psf_yr")],
        ("raw_lease_rate_snapshot", "is_vacant", "not_null", "is_vacant IS NULL", "raw_lease", "error"),
        ("raw_lease_rate_snapshot", "is_own_use", "not_null", "is_own_use IS NULL", "raw_lease", "error"),
    ]
    return {
        "quality_failures": _sql(" UNION ALL ".join(f"""
            SELECT 'raw_lease_rate_snapshot' AS table_name, as_of_month, as_of_month || '|' || suite_id AS row_key,
                   '{column}' AS "column", '{check}' AS "check", 'error' AS severity,
                   CAST({value or sqft_text} AS VARCHAR) AS failure_case
            FROM {flawed} WHERE {broken}""" for column, check, broken, value in cases), "raw_lease"),
        "quality_summary": _sql(" UNION ALL ".join(
            counted("raw_lease_rate_snapshot", c, k, b, flawed) for c, k, b in summary), "raw_lease"),
        "quality_bronze_verdicts": _sql(f"""
            SELECT 'raw_lease_rate_snapshot' AS table_name, as_of_month, {_i('failed', 'failed_checks')},
                   failed = 0 AS passed
            FROM (SELECT as_of_month, MAX(CASE WHEN sqft < 0 THEN 1 ELSE 0 END)
                         + MAX(CASE WHEN {building_broken} THEN 1 ELSE 0 END)
                         + MAX(CASE WHEN tenant IS NULL THEN 1 ELSE 0 END) AS failed
                  FROM {flawed} GROUP BY as_of_month)
            UNION ALL SELECT 'raw_dashboard_monthly', as_of_month, 0, TRUE FROM raw_ledger
            UNION ALL SELECT DISTINCT 'raw_expenses_monthly', as_of_month, 0, TRUE FROM raw_expenses""",
            "raw_lease", "raw_ledger", "raw_expenses"),
        "quarantine_report": _sql(" UNION ALL ".join(f"""
            SELECT 'raw_lease_rate_snapshot' AS table_name, as_of_month, '{column}' AS "column", '{check}' AS "check",
                   {_i('COUNT(*)', 'cases')}
            FROM {flawed} WHERE {broken} GROUP BY as_of_month""" for column, check, broken, _ in cases), "raw_lease"),
        "check_log": _sql(f"""
            SELECT md5('run|' || table_name || '|' || as_of_month || '|' || "column" || '|' || "check") AS check_id,
                   'run' AS run_id, table_name, "check" AS check_type, passed, failure_count,
                   '{{"as_of_month":"' || as_of_month || '","column":"' || "column" || '","severity":"' || severity
                       || '","row_count":' || row_count || '}}' AS details
            FROM ({" UNION ALL ".join(counted("raw_lease_rate_snapshot", c, k, b, flawed) for c, k, b in summary)})""",
            "raw_lease"),
        "quality_type_coercion": " UNION ALL ".join(
            counted("orders", "amount", check, broken,
                    "(SELECT strftime(o_orderdate, '%Y-%m') AS as_of_month, o_orderkey FROM orders)")
            for check, broken in (("type_double", "o_orderkey % 6 = 0"), ("not_null", "FALSE"))),
        "quality_unique": _sql(f"""
            SELECT suite_id, {_i('COUNT(*)', 'copies')} FROM dim_suite GROUP BY suite_id HAVING COUNT(*) > 1""",
            "dim_suite"),
        "lease_suite_rules": _sql(f"""
            SELECT as_of_month, {_i("COUNT(CASE WHEN n > 1 THEN 1 END)", 'repeated_suites')}, {_i('SUM(unflagged)', 'unflagged_own_use')}
            FROM (SELECT as_of_month, suite_id, COUNT(*) AS n, SUM(CASE WHEN (own AND CAST(sqft AS BIGINT) % 13 = 0) OR (own AND NOT is_own_use)
                         THEN 1 ELSE 0 END) AS unflagged
                  FROM (SELECT *, lower(tenant || ' ' || suite_id) LIKE '%101b%' OR lower(tenant || ' ' || suite_id) LIKE '%owner use%' AS own FROM raw_lease
                        UNION ALL SELECT *, lower(tenant || ' ' || suite_id) LIKE '%101b%' OR lower(tenant || ' ' || suite_id) LIKE '%owner use%' FROM raw_lease
                        WHERE CAST(sqft AS BIGINT) % 11 = 0)
                  GROUP BY as_of_month, suite_id) GROUP BY as_of_month""", "raw_lease"),
        "quality_accepted_values": _sql(
            counted("stg_expenses_monthly", "expense_category", "accepted_values",
                    "expense_category NOT IN ('fixed', 'variable')", "expenses"), "expenses"),
        "quality_model_tests": _model_tests(),
        "quality_dimensions_by_property": _sql("""
            SELECT model, column_name AS "column", test, CAST(failures AS BIGINT) AS failures, failures = 0 AS passed FROM (
              SELECT 'dim_suite' AS model, 'suite_id' AS column_name, 'not_null' AS test, 0 AS failures
              UNION ALL SELECT 'dim_tenant', 'tenant_id', 'not_null', 0
              UNION ALL SELECT 'dim_suite', 'suite_id', 'unique', COUNT(*)
                FROM (SELECT property_id, suite_id FROM dim_suite GROUP BY ALL HAVING COUNT(*) > 1)
              UNION ALL SELECT 'dim_tenant', 'tenant_id', 'unique', COUNT(*)
                FROM (SELECT property_id, tenant_id FROM dim_tenant GROUP BY ALL HAVING COUNT(*) > 1))""",
            "dim_suite", "dim_tenant", by_property=True),
        "kpi_rules": _sql(" UNION ALL ".join(
            counted(t, c, k, b, source, severity, by="") for t, c, k, b, source, severity in rules),
            "prop", "rent", "raw_ledger", "raw_lease"),
        "reconcile_layers": _sql("""
            SELECT as_of_month, strftime(month, '%Y-%m-%d') AS month,
                   CASE WHEN as_of_month LIKE '1996%' THEN 'left_only' ELSE 'unequal' END AS status,
                   CASE WHEN as_of_month LIKE '1996%' THEN 'rent_base,collected,leased_sqft' ELSE 'collected' END AS differs
            FROM ledger WHERE as_of_month LIKE '1996%' OR (as_of_month LIKE '1999%' AND collected <> rent_base)""",
            "ledger"),
        "reconcile_by_digest": _sql("""
            SELECT as_of_month, strftime(month, '%Y-%m-%d') AS month,
                   CASE WHEN as_of_month LIKE '1996%' THEN 'left_only' ELSE 'unequal' END AS status,
                   CASE WHEN as_of_month LIKE '1996%' THEN 'rent_base,collected,leased_sqft' ELSE 'collected' END AS differs
            FROM ledger WHERE as_of_month LIKE '1996%' OR (as_of_month LIKE '1999%' AND collected <> rent_base)""",
            "ledger"),
        "published_tables": _sql(f"""
            , n AS (SELECT 'prop_kpi_monthly' AS table_name, COUNT(*) AS n FROM prop UNION ALL SELECT 'building_kpi_monthly', COUNT(*) FROM bld
                       UNION ALL SELECT 'dim_suite', COUNT(*) FROM dim_suite)
            SELECT table_name, step, status, {_i('n', 'row_count')} FROM (
              SELECT table_name, 'published' AS step, 'success' AS status, n FROM n UNION ALL SELECT 'broken', 'published', 'failed', 0
              UNION ALL SELECT table_name, 'copied', 'success', n FROM n UNION ALL SELECT table_name, 'verified', 'present', n FROM n
              UNION ALL SELECT 'fact_expense_monthly', 'verified', 'missing', NULL UNION ALL SELECT 'dim_tenant', 'verified', 'missing', NULL)""",
            "prop", "bld", "dim_suite"),
        "prop_kpi_bucketed": _sql(f"SELECT property_id, {_PROP} FROM prop", "prop", by_property=True),
        "sql_revenue_trends": _sql(f"""
            SELECT property_id, {_cols(n='rent_base collected uncollected collection_rate_pct', d='month')}
            FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY property_id ORDER BY month DESC) AS place FROM rent)
            WHERE (property_id = '1' AND place <= 6) OR (property_id = '3' AND place <= 9)""", "rent", by_property=True),
        "sql_building_comparison": _sql(f"""
            SELECT building, {_cols(n='occupancy_pct collected', i='total_sqft occupied_sqft suite_count', d='month')}
            FROM bld JOIN (SELECT property_id, month, collected FROM rent) USING (property_id, month)
            WHERE property_id = '2' AND month = (SELECT MAX(month) FROM bld WHERE property_id = '2')""", "bld", "rent", by_property=True),
        "recorded_writes": _sql(f"""
            SELECT source, {_i('n', 'row_count')}, {_i('c', 'column_count')}, 'snappy' AS compression FROM (
              SELECT 'raw_dashboard_monthly' AS source, COUNT(*) AS n, 7 AS c FROM raw_ledger
              UNION ALL SELECT 'raw_expenses_monthly', COUNT(*), 5 FROM raw_expenses
              UNION ALL SELECT 'raw_lease_rate_snapshot', COUNT(*), 10 FROM raw_lease)""", "raw_ledger", "raw_expenses", "raw_lease"),
        "sheet_tables": f"""
            SELECT 'book_' || n_regionkey AS file, {_i('c_custkey', 'Key')}, c_name AS "Name", {_n('ROUND(c_acctbal, 2)', 'Balance')},
                   lpad(c_custkey::VARCHAR, 9, '0') AS "Code", c_mktsegment AS column_5,
                   CASE WHEN c_custkey % 2 = 0 THEN c_custkey::VARCHAR ELSE 'odd' END AS "Key.1"
            FROM customer JOIN nation ON n_nationkey = c_nationkey""",
        "content_hashes": f"""
            SELECT {_i('n_nationkey')}, md5(n_name || chr(10)) AS _file_md5, {_i('length(n_name) + 1', 'length')} FROM nation""",
        "audit_columns": _sql(f"""
            SELECT as_of_month, md5('portfolio_' || as_of_month || '.xlsx') AS _file_md5, {_i('month(month)', 'rows')}, TRUE AS just_now
            FROM raw_ledger""", "raw_ledger"),
        "layer_totals": _sql(" UNION ALL ".join(f"""
            SELECT '{layer}' AS layer, {_i('COUNT(*)', 'row_count')},
                   {", ".join(_n(f"SUM(CAST({c} AS DECIMAL(28,2)))", c) for c in ("rent_base", "collected", "leased_sqft"))}
            FROM {source}""" for layer, source in (("bronze", "raw_ledger"), ("staging", "ledger"), ("mart", "rent"),
                                                   ("gold", "prop"))), "raw_ledger", "ledger", "rent", "prop"),
        "freshness_counts": _sql(f"""
            SELECT 'prop_kpi_monthly' AS table_name, {_i('COUNT(*)', 'row_count')}, MAX(as_of_month) AS newest_month FROM prop
            UNION ALL SELECT 'building_kpi_monthly', COUNT(*), MAX(as_of_month) FROM bld
            UNION ALL SELECT 'dim_suite', COUNT(*), NULL FROM dim_suite""", "prop", "bld", "dim_suite"),
    }


def _every_alias() -> str:
    """The vocabulary as a table of (place, canonical name per worksheet)."""
    wording = [*dict.fromkeys([*V.LEDGER_ALIASES, *V.EXPENSE_ALIASES, *V.LEASE_ALIASES]), "note"]
    rows = ", ".join(
        f"({i}, {', '.join(repr(aliases.get(w, w)) for aliases in (V.LEDGER_ALIASES, V.EXPENSE_ALIASES, V.LEASE_ALIASES))})"
        for i, w in enumerate(wording))
    return f"""
        SELECT {_i('p_partkey')}, ledger_column, expense_column, lease_column
        FROM part JOIN (VALUES {rows}) AS v(place, ledger_column, expense_column, lease_column)
             ON p_partkey % {len(wording)} = place"""


def _model_tests() -> str:
    """Only the two uniqueness tests can fail on these tables."""
    from leasemill.operators.quality import MODEL_TESTS

    rows = []
    for model, column, test, _ in MODEL_TESTS:
        failures = "0"
        if test == "unique" and model == "dim_suite":
            failures = "(SELECT COUNT(*) FROM (SELECT suite_id FROM dim_suite GROUP BY 1 HAVING COUNT(*) > 1))"
        if test == "unique" and model == "dim_tenant":
            failures = "(SELECT COUNT(*) FROM (SELECT tenant_id FROM dim_tenant GROUP BY 1 HAVING COUNT(*) > 1))"
        rows.append(f"""
            SELECT '{model}' AS model, '{column}' AS "column", '{test}' AS test, {_i(failures, 'failures')},
                   {failures} = 0 AS passed""")
    return _sql(" UNION ALL ".join(rows), "dim_suite", "dim_tenant")


def oracle_sql() -> dict[str, str]:
    return {**_models(), **_reports(), **_forecasts(), **_history(), **_ingestion(), **_quality()}
