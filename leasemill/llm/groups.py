"""Values of a group brought back to its rows, whatever share of the rows one group holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group with more than one in so many of all rows is hot; there cannot be more hot groups than this.
HOT = 1000


def joined(df: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """df with the columns of ``values(key, n, ...)``, which has one row for every key of df and its number of rows, ``n``.

    Null keys are one group. The values of hot groups, ``HOT`` rows at most, are broadcast, so the rows of a hot group stay where
    they are; the rest is joined by key, and no key of that rest holds more than a thousandth of the rows. ``df`` and ``values`` are
    read twice and should be tables. ``n`` is not among the result's columns.
    """
    total = values.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > total // HOT
    extra = [c for c in values.columns if c not in (key, "n")]
    named = values.select(F.col(key).alias("_key"), "n", *extra)
    few = F.broadcast(named.where(hot).drop("n"))
    same = F.col(key).eqNullSafe(F.col("_key"))
    left = df.join(F.broadcast(named.where(hot).select("_key")), same, "left_anti")
    stays = df.join(few, same).drop("_key")
    return stays.union(left.join(named.where(~hot).drop("n"), same).drop("_key"))
