"""The monthly run over changed months against a run over everything, with two properties."""

from pathlib import Path

from books import monthly_book
from test_ingest import landed_books

from leasemill.operators import distinct
from leasemill.plans import refresh

STOP = ["quality", "forecast", "export"]


def book(building: str, month: int, epoch: int = 1) -> str:
    return f"raw/o/{building}/2025/01/01/{epoch}-book_2025-{month:02d}.xlsx"


def landed(spark, folder: Path, books: dict):
    (folder / "x").mkdir(parents=True)
    for name in books:
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
    return landed_books(spark, folder, books)


def shown(run, table):
    df = run.read_gold(table)
    columns = sorted(c for c in df.columns if c not in ("ingested_at", "_ingested_at"))
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_changed_months_equal_a_build_of_everything(spark, tmp_path):
    root = str(tmp_path / "run")
    areas = spark.createDataFrame([("o-b1", 200), ("o-b2", 1000)], "property_id string, total_sqft bigint")
    first = {book(b, m): monthly_book(m, suites={"1A": ("Acme", 100, 200), "2B": (f"{b}{m // 2}", 50, 100 + m)}) for b in ("b1", "b2") for m in (1, 2, 4)}
    refresh.run_stages(refresh.Run(spark, root, landed(spark, tmp_path / "a", first), total_sqft=areas), skip=STOP)
    # A late March of one property, and a corrected January of the other, without its expenses and its second suite.
    later = {book("b1", 3): monthly_book(3), book("b2", 1, 9): monthly_book(1, rent=70000.0, expenses=False)}
    step = refresh.Run(spark, root, landed(spark, tmp_path / "b", later), total_sqft=areas)
    refresh.ingest(step)
    refresh.stage_tables(step)
    assert refresh.stale_months(step, refresh.BUILT) == ["2025-01", "2025-03"]
    refresh.build_models(step)
    assert refresh.stale_months(step, refresh.BUILT) == []
    tables = [*refresh.REACH, refresh.HISTORY, refresh.SETS, "dim_suite", "dim_tenant", "model_tests"]
    by_step = {t: shown(step, t) for t in tables}
    occupancy = {(r["property_id"], r["total_property_sqft"]) for r in step.read_gold("prop_kpi_monthly").collect()}
    assert occupancy == {("o-b1", 200), ("o-b2", 1000)}
    unique = [r["failures"] for r in step.read_gold("model_tests").where("model = 'dim_suite' AND test = 'unique'").collect()]
    assert unique == [0]
    by = [*refresh.KEYS, "tenant"]
    counted = distinct.counts_by_window(step.read_gold(refresh.SETS), by, refresh.KEYS, name="n")
    lease = step.read_gold("stg_lease_rate")
    own = distinct.words(lease, distinct.extend(None, lease, "suite_id", refresh.KEYS), "suite_id", [*by, "as_of_month"], refresh.KEYS)
    other = distinct.counts_by_window(own, by, refresh.KEYS, name="n")
    assert counted.count() > 0 and counted.exceptAll(other).isEmpty() and other.exceptAll(counted).isEmpty()

    whole = refresh.Run(spark, root, total_sqft=areas, full_refresh=True)
    refresh.build_models(whole)
    for table in tables:
        assert by_step[table] == shown(whole, table), table
    assert len(by_step[refresh.HISTORY]) > 4 and len(by_step["kpi_windows"]) == 7 * 4


def test_reach():
    assert refresh.months_from(["2024-12"], 1, 2) == ["2024-11", "2024-12", "2025-01", "2025-02"]
    assert refresh.months_from([], 1, 1) == []
