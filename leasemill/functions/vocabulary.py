"""Words, labels, addresses and thresholds the pipeline has to agree on with its workbooks."""

from __future__ import annotations

# Month names as they appear in worksheet headers, January first.
MONTH_NAMES = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]

# Header cells that are labels, not months.
TARGET_LABELS = ["collection target", "target"]

# Patterns that choose a worksheet, first pattern first.
LEDGER_SHEET_PATTERNS = ["dashboard", "2025", "2026"]
LEASE_SHEET_PATTERNS = ["lease", "rate"]
EXPENSE_SHEET_PATTERNS = ["expense", "gastos", "budget"]

# Tenant wording that marks an empty suite.
VACANCY_PATTERNS = ["vacante", "vacant", "disponible", "available"]

# Tenant or suite wording that marks a suite used by the owner.
OWN_USE_PATTERNS = ["black label", "owner use", "uso propio", "101b"]

# Header wording (English and Spanish) per worksheet and the column it means.
LEDGER_ALIASES = {
    "mes": "month",
    "month": "month",
    "renta base": "rent_base",
    "rent base": "rent_base",
    "base rent": "rent_base",
    "cobrado": "collected",
    "collected": "collected",
    "no cobrado": "uncollected",
    "uncollected": "uncollected",
    "m2 rentados": "leased_sqft",
    "leased sqft": "leased_sqft",
    "sqft arrendado": "leased_sqft",
    "precio m2/año": "price_per_sf_yr",
    "price per sf/yr": "price_per_sf_yr",
    "$/sf/yr": "price_per_sf_yr",
}
EXPENSE_ALIASES = {
    "concepto": "item",
    "item": "item",
    "proveedor": "vendor",
    "vendor": "vendor",
    "real": "actual",
    "actual": "actual",
    "presupuesto": "budget",
    "budget": "budget",
    "varianza": "variance",
    "variance": "variance",
}
LEASE_ALIASES = {
    "suite": "suite_id",
    "suite_id": "suite_id",
    "edificio": "building",
    "building": "building",
    "inquilino": "tenant",
    "tenant": "tenant",
    "m2": "sqft",
    "sqft": "sqft",
    "renta mensual": "rent_monthly",
    "rent monthly": "rent_monthly",
    "monthly rent": "rent_monthly",
    "renta anual": "rent_annual",
    "rent annual": "rent_annual",
    "annual rent": "rent_annual",
    "renta $/m2/año": "rent_psf_yr",
    "rent psf yr": "rent_psf_yr",
    "$/sf/yr": "rent_psf_yr",
}

# The exact headers of the lease worksheet and the columns they fill.
LEASE_HEADERS = {
    "Suite": "suite_id",
    "Tenant": "tenant",
    "Sq Ft": "sqft",
    "Monthly Rent ($)": "rent_monthly",
    "Annual Rent ($)": "rent_annual",
}

# Worksheet addresses (1-based rows and columns).
LEDGER_HEADER_ROW = 29
LEDGER_METRIC_ROWS = {
    "rent_base": 30,
    "collected": 32,
    "uncollected": 33,
    "leased_sqft": 35,
    "price_per_sf_yr": 36,
}
FIRST_MONTH_COLUMN = 9
EXPENSE_HEADER_ROW = 40
EXPENSE_LABEL_COLUMN = 5
EXPENSE_MONTH_SLOTS = 12
LEASE_HEADER_ROW = 4
PERIOD_SEARCH_ROWS = 50

# Expense rows, the label used when the sheet has none, and the category.
EXPENSE_ITEMS = [
    (42, "Electricity", "fixed"),
    (43, "Internet", "fixed"),
    (44, "Yardi Breeze", "fixed"),
    (45, "Water", "fixed"),
    (46, "Pest Control", "fixed"),
    (47, "Supplies", "fixed"),
    (48, "Nexus trash disposal", "fixed"),
    (49, "Insurance", "fixed"),
    (50, "Property management", "fixed"),
    (53, "Repairs", "variable"),
    (54, "Real Estate Agent", "variable"),
    (55, "A/C Maintenance", "variable"),
    (56, "Bank Fees", "variable"),
    (57, "Light fixtures maintenance", "variable"),
    (60, "Accrued Property tax", "other"),
    (61, "Other", "other"),
    (66, "Management - RP", "other"),
    (67, "Other expenses", "other"),
    (68, "CAPEX", "other"),
]
EXPENSE_CATEGORIES = ["fixed", "variable", "other"]
BUILDINGS = ["A", "B"]

# Business constants.
TOTAL_SQFT = 9917
WINDOW_SIZES = (3, 6, 9, 12)
OCCUPANCY_TARGET = 85.0
COLLECTION_TARGET = 100.0
COLLECTION_GOOD_FROM = 95.0
WHAT_IF_RENT_PER_SQFT = 30.00
LARGE_SUITE_SQFT = 500

# Status wording shown in reports.
BELOW_TARGET_LABEL = "⚠️ Below Target"
PERFECT_LABEL = "✅ Perfect"
GOOD_LABEL = "✓ Good"

# Forecast settings. The band is the 80 % interval of a normal error.
FORECAST_METRICS = ("occupancy_pct", "collected", "noi_proto")
FORECAST_HORIZON = 12
MIN_POINTS = 3
SEASON = 12
SEASONAL_FROM = 24
Z80 = 1.2815515655446004
