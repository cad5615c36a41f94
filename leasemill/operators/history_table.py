"""Type-2 history as a stored table that takes up one snapshot month at a time, in any order.

Versions are stored by the month that closes them (``closes``, 'open' while none does). A month m of a property stands between the
snapshot before it and the one after it. Taking it up, or replacing it, changes only versions that close after the month
before: m itself decides where a version ends and the next begins, up to the following month. So a new month reads the
open versions and its own rows, and a month that is k snapshots late reads what closed in those k months too; older history
is neither read nor written. A key that is missing from a snapshot is closed there.

Numbers of versions shift when a month comes late, so they are counted when the table is read.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leasemill.operators.history import CHECKED, versions
from leasemill.operators.incremental import last_sent, touched_months
from leasemill.sources.bronze import delete_partition, path_exists

OPEN = "open"
Keys = Sequence[str]


@dataclass
class HistoryTable:
    """The history below ``path``: versions by closing month, and the (keys, month) pairs it has taken up."""

    spark: SparkSession
    path: str
    unique_key: Keys = ("suite_id",)
    keys: Keys = ()
    checked: Keys = CHECKED

    @property
    def grain(self) -> list[str]:
        return [*self.keys, *self.unique_key]

    def _stored(self, name: str) -> DataFrame:
        """A table of the history with its declared schema, for it may be without a single partition."""
        schema = self.spark.read.parquet(f"{self.path}/schemas/{name}").schema
        path = f"{self.path}/{name}"
        return self.spark.read.schema(schema).option("basePath", path).parquet(path)

    def _versions(self) -> DataFrame:
        return self._stored("versions")

    def _months(self) -> DataFrame:
        return self._stored("months")

    def _write(self, df: DataFrame, name: str, by: str) -> None:
        df.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/schemas/{name}")
        df.write.mode("overwrite").partitionBy(by).parquet(f"{self.path}/{name}")

    def exists(self) -> bool:
        return path_exists(self.spark, f"{self.path}/months/_SUCCESS")

    def read(self) -> DataFrame:
        """All versions with their number, ``valid_from``, ``valid_to`` (null while open) and ``is_current``, as ``history.versions`` gives them."""
        self._recover()
        number = F.row_number().over(Window.partitionBy(*self.grain).orderBy("valid_from"))
        return self._versions().withColumn("version", number).withColumns(
            {"valid_to": F.when(F.col("closes") != OPEN, F.col("closes")), "is_current": F.col("closes") == OPEN}).drop("closes")

    def rebuild(self, snapshots: DataFrame) -> None:
        """All of the history anew from the snapshots of all months."""
        replayed = versions(snapshots, self.unique_key, self.keys, self.checked)
        stored = replayed.withColumn("closes", F.coalesce("valid_to", F.lit(OPEN))).drop("version", "valid_to", "is_current")
        delete_partition(self.spark, self.path, {"pending": "new"})
        months = snapshots.select(*self.keys, "as_of_month").distinct()
        if not self.keys:
            months = months.withColumn("taken", F.lit(True))
        self._write(stored, "versions", "closes")
        self._write(months, "months", "as_of_month")

    def take(self, month: str, snapshots: DataFrame) -> None:
        """Take up a month, or replace it. ``snapshots`` holds at least the rows of that month and of the one after it, as they are now.

        A property without rows in that month has no such snapshot (any more).
        """
        self._recover()
        found = snapshots.where(F.col("as_of_month") == month)
        new = last_sent(found, [*self.grain, "as_of_month"])
        places = self._places(month, new)
        bound = places.agg(F.min(F.coalesce("before", F.lit(""))), F.max("after")).first()
        if bound[0] is None:
            return
        reach = self._within_reach(bound[0])
        following = snapshots.where((F.col("as_of_month") > month) & (F.col("as_of_month") <= (bound[1] or "")))
        self._replace(month, merged(reach, new, last_sent(following, [*self.grain, "as_of_month"]), places, month, self.grain, self.keys, self.checked), bound[0], places)

    def _within_reach(self, before: str) -> DataFrame:
        """Versions that close after a month. A partition filter: older files are not read."""
        return self._versions().where((F.col("closes") > before) | (F.col("closes") == OPEN))

    def _places(self, month: str, new: DataFrame) -> DataFrame:
        """(keys, before, after, seen): the snapshots around the month of every property that has it, or had it."""
        known = self._months().select(*self.keys, "as_of_month")
        around = known.groupBy(*self.keys).agg(
            F.max(F.when(F.col("as_of_month") < month, F.col("as_of_month"))).alias("before"),
            F.min(F.when(F.col("as_of_month") > month, F.col("as_of_month"))).alias("after"),
            F.max(F.col("as_of_month") == month).alias("had"))
        if not self.keys:
            return around.withColumn("seen", F.lit(not new.isEmpty())).where("seen or had").drop("had")
        seen = new.select(*self.keys).distinct().withColumn("seen", F.lit(True))
        return around.join(seen, list(self.keys), "full").withColumn("seen", F.coalesce("seen", F.lit(False))).where(
            "seen or had").drop("had")

    # The new content is complete before anything is replaced; a run that stops in between is finished by the next one.

    def _replace(self, month: str, rows: DataFrame, after: str, places: DataFrame) -> None:
        pending = f"{self.path}/pending=new"
        names = [*rows.columns]
        rows.select(*names).write.mode("overwrite").parquet(f"{pending}/rows")
        seen = places.where("seen").select(*self.keys) if self.keys else places.where("seen").select(F.lit(True).alias("taken"))
        seen.write.mode("overwrite").parquet(f"{pending}/seen")
        self.spark.createDataFrame([(month, after)], "month STRING, after STRING").coalesce(1).write.mode("overwrite").parquet(f"{pending}/what")
        self._recover()

    def _recover(self) -> None:
        pending = f"{self.path}/pending=new"
        if not path_exists(self.spark, f"{pending}/what/_SUCCESS"):
            return
        month, after = self.spark.read.parquet(f"{pending}/what").first()
        rows = self.spark.read.parquet(f"{pending}/rows")
        held = touched_months(rows, "closes")
        there = touched_months(self._within_reach(after), "closes")
        writer = rows.hint("rebalance", "closes").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("closes").parquet(f"{self.path}/versions")
        for closes in set(there) - set(held):
            delete_partition(self.spark, f"{self.path}/versions", {"closes": closes})
        delete_partition(self.spark, f"{self.path}/months", {"as_of_month": month})
        seen = self.spark.read.parquet(f"{pending}/seen").withColumn("as_of_month", F.lit(month))
        seen.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("as_of_month").parquet(f"{self.path}/months")
        delete_partition(self.spark, self.path, {"pending": "new"})


def merged(reach: DataFrame, new: DataFrame, following: DataFrame, places: DataFrame, month: str, grain: Keys, keys: Keys,
           checked: Keys) -> DataFrame:
    """The versions of ``reach`` after a month has been taken up.

    ``reach`` holds all versions that close after the month before (of any property), ``new`` the month's rows, one per key,
    ``following`` at least those of the month after, ``places`` the properties concerned. Per key there are at most three versions that
    can change: the one that covers the month before, the one that covers the month after (perhaps the same), and what lies between.
    """
    carried = [c for c in new.columns if c not in grain]
    placed = _with_places(reach, places, keys)
    concerned = F.col("placed") & (F.col("before").isNull() | (F.col("closes") > F.col("before")) | (F.col("closes") == OPEN))
    past = F.col("after").isNotNull() & (F.col("valid_from") > F.col("after"))
    untouched = placed.where(~concerned | past).select(*reach.columns)
    near = placed.where(concerned & ~past)
    covers_before = F.col("before").isNotNull() & (F.col("valid_from") <= F.col("before"))
    covers_after = F.col("after").isNotNull() & ((F.col("closes") > F.col("after")) | (F.col("closes") == OPEN))
    version = F.struct(*carried, "valid_from", "closes")
    around = near.groupBy(*grain).agg(
        F.max(F.when(covers_before, version)).alias("a"), F.max(F.when(covers_after, version)).alias("b"))

    row = F.struct(*carried)
    mine = new.select(*grain, row.alias("m"))
    of_key = around.join(mine, list(grain), "full")
    spots = _with_places(of_key, places, keys)
    later = following.select(*grain, F.col("as_of_month").alias("after"), row.alias("x"))
    spots = spots.join(later, [*grain, "after"], "left")

    def same(p: Column, q: Column) -> Column:
        return p.isNotNull() & q.isNotNull() & functools.reduce(lambda x, y: x & y, [p[c].eqNullSafe(q[c]) for c in checked])

    def made(source: str, valid_from: Column, closes: Column) -> Column:
        return F.struct(*[F.col(source)[c].alias(c) for c in carried], valid_from.alias("valid_from"), closes.alias("closes"))

    a, b, m = F.col("a"), F.col("b"), F.col("m")
    seen, after, at = F.col("seen"), F.col("after"), F.lit(month)
    no_after = after.isNull()
    # What stands just before the following month: the month's own row, or where there is no such snapshot the version before.
    a_goes_on = a.isNotNull() & (~seen | same(a, m))
    m_begins = seen & m.isNotNull() & ~same(a, m)
    b_joins_a = a_goes_on & same(a, b)
    b_joins_m = m_begins & same(m, b)
    b_begins = b.isNotNull() & ~b_joins_a & ~b_joins_m
    end_of_b, end_before_b = b["closes"], F.when(no_after, F.lit(OPEN)).otherwise(after)
    end_of_a = F.when(~a_goes_on, at).when(b_joins_a, end_of_b).otherwise(end_before_b)
    end_of_m = F.when(b_joins_m, end_of_b).otherwise(end_before_b)
    # A version that now begins with the following month has that month's columns.
    from_x = F.when(b["valid_from"] == after, made("b", after, end_of_b)).otherwise(made("x", after, end_of_b))
    out = F.array(
        F.when(a.isNotNull(), made("a", a["valid_from"], end_of_a)),
        F.when(m_begins, made("m", at, end_of_m)),
        F.when(b_begins, from_x),
    )
    changed = spots.select(*grain, F.inline(F.filter(out, lambda v: v.isNotNull())))
    return untouched.unionByName(changed.select(*reach.columns))


def _with_places(df: DataFrame, places: DataFrame, keys: Keys) -> DataFrame:
    """Adds before, after, seen and whether the row's property is concerned."""
    marked = places.withColumn("placed", F.lit(True))
    if keys:
        # One short row per property, sent to the rows: dealt by property, all versions would go to as few tasks as there are properties.
        joined = df.join(F.broadcast(marked), list(keys), "left")
        return joined.withColumn("placed", F.coalesce("placed", F.lit(False)))
    # One row: the places of the only property.
    before, after, seen = (places.first() or (None, None, None))[:3]
    text = lambda v: F.lit(v).cast("string")
    return df.withColumns({"before": text(before), "after": text(after), "seen": F.lit(bool(seen)), "placed": F.lit(seen is not None)})
