"""Incremental loading: duplicate files, new months, keyed upserts, full refresh."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Keys = Sequence[str]

FILE_KEY = ["_file_md5", "as_of_month"]


def unseen(arrivals: DataFrame, stored: DataFrame, key: Keys = FILE_KEY) -> DataFrame:
    """Arrivals whose content and month are not stored yet, each content once (its first file name).

    Both sides collapse to distinct keys before the join, so a month with many rows costs one key per file.
    """
    known = stored.select(*key).distinct()
    rest = [c for c in arrivals.columns if c not in key]
    once = arrivals.groupBy(*key).agg(*([F.min(F.struct(*rest)).alias("first")] if rest else [F.count(F.lit(1))]))
    return (
        once.select(*key, *[F.col("first")[c].alias(c) for c in rest])
        .join(known, list(key), "left_anti")
        .select(*arrivals.columns)
    )


def newer_months(source: DataFrame, target: DataFrame, month: str = "as_of_month") -> DataFrame:
    """Rows of months after the target's newest month; everything when the target is empty.

    The bound is a scalar subquery, so a partitioned source reads only the new partitions.
    """
    newest = target.agg(F.coalesce(F.max(month), F.lit(""))).scalar()
    return source.where(F.col(month) > newest)


def touched_months(batch: DataFrame, month: str = "as_of_month") -> list[str]:
    """Distinct months of a batch. The calendar bounds the list, so it may come to the driver."""
    return sorted(r[0] for r in batch.select(month).distinct().collect() if r[0] is not None)


def upsert(target: DataFrame, batch: DataFrame, key: Keys) -> DataFrame:
    """Delete the target rows the batch has keys for, then add the batch."""
    keys_sent = batch.select(*key).distinct()
    return target.join(keys_sent, list(key), "left_anti").unionByName(batch, allowMissingColumns=True)


def last_sent(batch: DataFrame, key: Keys, order: Keys = ("ingested_at", "_file_md5")) -> DataFrame:
    """One row per key, the one ingested last; the file hash breaks ties."""
    rest = [c for c in batch.columns if c not in key]
    ranked = [*order, *[c for c in rest if c not in order]]
    return (
        batch.groupBy(*key)
        .agg(F.max(F.struct(*ranked)).alias("row"))
        .select(*key, *[F.col("row")[c].alias(c) for c in rest])
        .select(*batch.columns)
    )


def load(source: DataFrame, target: DataFrame | None, key: Keys, mode: str = "touched") -> DataFrame:
    """The table after a load.

    ``new_months``: only months after the target's newest one (a re-sent or late month is ignored).
    ``touched``: every month in the source, late or re-sent ones included.
    ``full``: the source alone.
    """
    if mode == "full" or target is None:
        return source
    if mode == "new_months":
        return upsert(target, newer_months(source, target), key)
    if mode == "touched":
        return upsert(target, source, key)
    raise ValueError(f"unknown load mode: {mode}")
