"""The stream's state: what it decides, what it remembers, and what it reads."""

import random

from books import monthly_book, workbook
from pyspark.sql import functions as F
from test_ingest import Feed, put

from leasemill import registry, schemas
from leasemill.sources import bronze, star
from leasemill.streaming import arrivals

SENT = "file string, _file_md5 string, property_id string, as_of_month string, arrived bigint, error string"


class Value:
    def __init__(self):
        self.kept = None

    def exists(self):
        return self.kept is not None

    def get(self):
        return self.kept

    def update(self, value):
        self.kept = value


class Map(dict):
    containsKey, removeKey = dict.__contains__, dict.pop

    def updateValue(self, key, value):
        self[key] = value

    def iterator(self):
        return iter(list(self.items()))


class Handle:
    """The state of one key in memory."""

    def getValueState(self, name, schema):
        return Value()

    def getMapState(self, name, key, value):
        return Map()


def decide(batches, known_seconds=10**9):
    """(file, role) of every arrival, batch by batch."""
    from pyspark.sql import Row

    state, out = {}, []
    for batch in batches:
        for key in dict.fromkeys((r[2], r[3]) for r in batch):
            if key not in state:
                state[key] = arrivals.latest_file(known_seconds)
                state[key].init(Handle())
            rows = [Row(**dict(zip(("file", "_file_md5", "property_id", "as_of_month", "arrived", "error"), r))) for r in batch if (r[2], r[3]) == key]
            out += [(r["file"], r["arrived"], r["role"]) for r in state[key].handleInputRows(key, iter(rows), None)]
    return sorted(out, key=repr)


def test_decides_as_the_log_does(spark):
    """Random arrivals in random batches: the same roles as from the files that each month holds."""
    rng = random.Random(4)
    batches = [[(f"f{b}-{i}", rng.choice("abc") + str(b % 2), rng.choice("pq"), rng.choice(["2025-01", "2025-02"]), rng.randrange(20), rng.choice([None, None, None, "bad"]))
                for i in range(rng.randrange(1, 7))] for b in range(12)]
    current, expected = {}, []
    for batch in batches:
        known = spark.createDataFrame([(*k, v) for k, v in current.items()],
                                      "property_id STRING, as_of_month STRING, known STRUCT<arrived: BIGINT, file: STRING, _file_md5: STRING>")
        for r in arrivals.roles(spark.createDataFrame(batch, SENT), known).collect():
            expected.append((r["file"], r["arrived"], r["role"]))
            if r["role"] == "take":
                current[(r["property_id"], r["as_of_month"])] = (r["arrived"], r["file"], r["_file_md5"])
    assert decide(batches) == sorted(expected, key=repr)


def test_a_file_that_is_sent_again_does_not_come_back(spark):
    """Its content was replaced meanwhile, and it now looks newer: a repeated event all the same, as long as it is remembered."""
    old, new = ("old", "h1", "p", "2025-01", 1, None), ("new", "h2", "p", "2025-01", 5, None)
    again = ("old", "h1", "p", "2025-01", 9, None)
    assert decide([[old], [new], [again]]) == [("new", 5, "take"), ("old", 1, "take"), ("old", 9, "skip")]
    assert decide([[old], [new], [again]], known_seconds=3) == [("new", 5, "take"), ("old", 1, "take"), ("old", 9, "take")]


def test_batches_read_their_own_files_only(spark, tmp_path, monkeypatch):
    """One parsed file per decision and no look at the log, however many files came before."""
    feed = Feed(spark, tmp_path)
    reads = []
    monkeypatch.setattr(arrivals, "read_log", lambda s, root, read=arrivals.read_log: reads.append(root) or read(s, root))

    def run():
        handle = arrivals.stream_workbooks(spark, str(feed.landing), feed.root, str(tmp_path / "checkpoint"), files_per_trigger=1, parsed_per_decision=1)
        handle.awaitTermination()
        return [p.numInputRows for p in handle.deciding.recentProgress if p.numInputRows], handle.deciding.recentProgress

    books = [monthly_book(1, suites={"1A": (f"T{n}", 1, 1)}) for n in range(2)]
    for n, content in enumerate(books):
        put(feed.landing, f"{n}-book_2025-01.xlsx", content)
    put(feed.landing, "5-book_2025-02.xlsx", workbook({"Notes": {(1, 1): "nothing"}}))
    counts, progress = run()
    assert counts == [1] * 3 and reads == []
    assert feed.lease("2025-01") == {"1A": "T1"}
    put(feed.landing, "6-copy_2025-01.xlsx", books[1])
    put(feed.landing, "7-book_2025-01.xlsx", monthly_book(1, suites={"1A": ("T7", 1, 1)}))
    counts, progress = run()
    # The log is named once, for the state of a stream that begins anew; this one goes on.
    assert counts == [1, 1] and len(reads) == 1
    assert progress[-1].stateOperators[0].numRowsTotal <= 2 * 2 + 5
    assert feed.lease("2025-01") == {"1A": "T7"}
    # Files of one second are taken up in any order; the last name wins.
    statuses = [s for _, s, _ in feed.log()]
    assert len(statuses) == 5 and statuses.count("failed") == 1 and statuses.count("skipped") in (1, 2)


def test_a_stream_with_a_new_checkpoint_begins_with_the_log(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    put(feed.landing / "raw/o/b/2025/03/05", "200-book_2025-03.xlsx", monthly_book(3, suites={"1A": ("Kept", 1, 2)}))
    feed.run()
    put(feed.landing / "raw/o/b/2025/03/04", "100-book_2025-03.xlsx", monthly_book(3, suites={"1A": ("Late", 1, 2)}))
    arrivals.stream_workbooks(spark, str(feed.landing), feed.root, str(tmp_path / "other")).awaitTermination()
    assert {r["tenant"] for r in bronze.read_bronze(spark, feed.root, schemas.LEASE_TABLE).collect()} == {"Kept"}
    assert sorted(s for _, s, _ in feed.log()) == ["skipped", "skipped", "success"]


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    """The steps of a batch that is done again find its log and stop."""
    feed = Feed(spark, tmp_path)
    put(feed.landing, "1-book_2025-01.xlsx", monthly_book(1))
    feed.run()
    before = feed.log()
    stream = next(p.name.removeprefix("stream=") for p in (tmp_path / "bronze" / "_ingestion_log").iterdir() if p.name.startswith("stream="))
    empty = spark.createDataFrame([], f"{arrivals._PARSED}, role STRING")
    arrivals._apply_to(feed.root, stream, None)(empty, 0)
    assert feed.log() == before and feed.lease("2025-01") == {"1A": "Acme"}


def test_arriving_cells_are_derived_once(spark, monkeypatch):
    """Every stream of the query lands stored cells; none joins lines and orders again."""
    landed = []
    monkeypatch.setattr(registry, "_stream_into", lambda spark, cells, root, staged: landed.append(cells))
    registry.stream_two_properties(spark, "/root/testdata/sf0.001")
    assert len(landed) == 3
    assert not any("lineitem" in f or "orders" in f for cells in landed for f in cells.inputFiles())


def test_months_of_a_year_are_derived_once(spark):
    """Ledger block, expense block and labels read the orders once each; the list of files comes with the rows."""
    plan = star.ledger_cells(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in line and "o_orderkey" in line for line in plan.splitlines()) == 3


def test_a_batch_reads_its_cells_four_times(spark, tmp_path):
    """The sheets, their first rows, the columns of the lease sheet and its body: nothing else goes over the landed cells."""
    cells = [("raw/o/b/2025/01/05/1-book_2025-01.xlsx", "Lease Rate", 2, row, col, str(row * col), "h") for row in range(5, 200) for col in (1, 4)]
    cells += [(*cells[0][:3], 4, 1, "Suite", "h"), (*cells[0][:3], 4, 4, "Sq Ft", "h")]
    path = str(tmp_path / "landed")
    spark.createDataFrame(cells, arrivals.LANDED_CELLS).coalesce(1).write.parquet(path)
    read = spark.sparkContext.accumulator(0)

    def count(row):
        read.add(1)
        return True

    counted = spark.read.schema(arrivals.LANDED_CELLS).parquet(path).where(F.udf(count, "boolean").asNondeterministic()("row"))
    root = str(tmp_path / "bronze")
    arrivals._parse_into(root, "s", lambda batch: batch)(counted, 0)
    assert spark.read.parquet(f"{arrivals.parsed_path(root, 's', schemas.LEASE_TABLE)}/batch=0").count() == 195
    assert read.value <= 4 * len(cells)


def test_a_month_below_the_first_rows_is_found(spark, tmp_path):
    """The value below a 'month' header may stand in any row; a lease sheet without suites is numbered in order."""
    feed = Feed(spark, tmp_path)
    put(feed.landing, "1-book_2025-01.xlsx", workbook({
        "Dashboard": {(29, 2): "Month", (900, 2): "2023-07-01"},
        "Lease": {(4, 1): "Suite", (4, 4): "Sq Ft", (4, 2): "Tenant", (90, 4): 30, (900, 9): "x", (800, 4): 10},
    }))
    feed.run()
    got = bronze.read_bronze(spark, feed.root, schemas.LEASE_TABLE).collect()
    assert {(r["as_of_month"], r["suite_id"], r["sqft"], r["tenant"]) for r in got} == {
        ("2023-07", "SUITE_1", 30.0, "Unknown"), ("2023-07", "SUITE_2", 10.0, "Unknown"), ("2023-07", "SUITE_3", None, "Unknown")}


def test_workbooks_are_dealt_before_they_are_named(spark, monkeypatch):
    """Each lies in one partition, and no hash goes through the shuffle."""
    landed = []
    monkeypatch.setattr(registry, "_stream_into", lambda spark, cells, root, staged: landed.append(cells))
    for query in (registry.stream_two_properties, registry.stream_ingest_equals_batch, registry.stream_replay):
        try:
            query(spark, "/root/testdata/sf0.001")
        except Exception:  # nothing was ingested
            pass
    assert len(landed) == 6
    for cells in landed:
        places = cells.select("file", F.spark_partition_id().alias("place")).distinct().groupBy("file").count()
        assert places.where("count > 1").isEmpty()
        plan = cells._jdf.queryExecution().optimizedPlan().toString()
        assert "md5" not in plan[plan.rindex("RepartitionByExpression"):]
