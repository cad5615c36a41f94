"""Type-2 history of lease snapshots, replayed month by month in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leasemill.operators.incremental import last_sent

Keys = Sequence[str]

# A new version starts when any of these differs from the month before.
CHECKED = ("tenant", "rent_monthly", "rent_annual", "rent_psf_yr", "is_vacant", "is_own_use")


def snapshot_months(snapshots: DataFrame, keys: Keys = ()) -> DataFrame:
    """Every snapshot month with its place in the sequence and the month that follows."""
    ordered = Window.partitionBy(*keys).orderBy("as_of_month")
    return (
        snapshots.select(*keys, "as_of_month")
        .distinct()
        .withColumns(
            {
                "month_place": F.row_number().over(ordered),
                "next_month": F.lead("as_of_month").over(ordered),
            }
        )
    )


def versions(
    snapshots: DataFrame,
    unique_key: Keys = ("suite_id",),
    keys: Keys = (),
    checked: Sequence[str] = CHECKED,
    close_missing: bool = True,
    one_row_per_month: bool = False,
    months: DataFrame | None = None,
) -> DataFrame:
    """Validity ranges per key: ``valid_from`` month, ``valid_to`` month (null while open), version number.

    A version carries the columns of the month it started in. With ``close_missing`` a key that is absent from a
    snapshot is closed at that snapshot, and starts a new version when it returns.

    Rows first collapse to one per key and month (skipped when the caller vouches for it), so a window group is at
    most as long as the calendar even if one key holds a large part of the rows. All windows share one partitioning
    and one sort; no aggregation follows. ``months`` may name a cheaper frame with the same months.
    """
    grain = [*keys, *unique_key]
    if not one_row_per_month:
        snapshots = last_sent(snapshots, [*grain, "as_of_month"])
    places = snapshot_months(months if months is not None else snapshots, keys)
    by_key = Window.partitionBy(*grain).orderBy("month_place")
    whole_key = by_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    # Without extra keys the month list is bounded by the calendar and can be broadcast whatever the data volume;
    # with keys it grows with the properties and the planner decides from its measured size.
    placed = snapshots.join(places if keys else F.broadcast(places), [*keys, "as_of_month"])
    starts = F.lag("month_place").over(by_key).isNull()
    for column in checked:
        starts = starts | ~F.col(column).eqNullSafe(F.lag(column).over(by_key))
    if close_missing:
        starts = starts | (F.lag("month_place").over(by_key) < F.col("month_place") - 1)
    marked = placed.withColumns(
        {
            "starts": starts,
            # The month after the row before: where the version before this one ends.
            "end_before": F.lag("next_month").over(by_key),
            "end_of_key": F.last("next_month").over(whole_key),
        }
    )
    opened = marked.where("starts")
    following = F.lead("end_before" if close_missing else "as_of_month").over(by_key)
    carried = [c for c in snapshots.columns if c not in grain]
    return opened.select(
        *grain,
        *carried,
        F.row_number().over(by_key).alias("version"),
        F.col("as_of_month").alias("valid_from"),
        (F.coalesce(following, F.col("end_of_key")) if close_missing else following).alias("valid_to"),
    ).withColumn("is_current", F.col("valid_to").isNull())


def hard_deletes(history: DataFrame, keys: Keys = ("suite_id",)) -> DataFrame:
    """Versions closed without a successor starting at that month: the key was missing from a snapshot."""
    ordered = Window.partitionBy(*keys).orderBy("version")
    followed = history.withColumn("returned_in", F.lead("valid_from").over(ordered))
    returned = F.col("returned_in")
    return followed.where(F.col("valid_to").isNotNull() & (returned.isNull() | (returned > F.col("valid_to"))))
