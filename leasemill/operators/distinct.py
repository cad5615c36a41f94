"""Distinct counts that merge: sets of values per month, kept as words of 64 bits, joined over any span of months.

Every distinct value has a number in a dictionary. A set is stored as one row per word, ``(word, bits)``, that holds 64
neighbouring numbers: a tenant's few suites take a row or two, a building's thousands one row for 64 of them. Words of different
months are joined by ``bit_or`` and counted by ``bit_count``, so a count over 12 months reads 12 months of words and not the rows
behind them, and is exact. Everything aggregates before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leasemill.functions import vocabulary as V
from leasemill.functions.expressions import first_of_month, month_number

Keys = Sequence[str]

#: Parts of a key's dictionary that are numbered apart, so that one large key is numbered by many tasks.
PARTS = 64
#: Numbers of a part come in runs of this length; runs of the parts alternate.
RUN = 64


def new_numbers(dictionary: DataFrame | None, rows: DataFrame, value: str, keys: Keys = ()) -> DataFrame:
    """Numbers (keys, value, number) for the values of ``rows`` that the dictionary lacks.

    Null values have no number, null keys are a key like any other. A part's new values follow its old ones in order of value.
    """
    found = rows.where(F.col(value).isNotNull()).select(*keys, value).distinct()
    part = F.pmod(F.xxhash64(value), F.lit(PARTS))
    if dictionary is not None:
        found = found.alias("n").join(dictionary.alias("d"), _same("n", "d", [*keys, value]), "left_anti")
    own = Window.partitionBy(*keys, "_part").orderBy(value)
    new = found.withColumn("_part", part).withColumn("_nth", F.row_number().over(own).cast("bigint") - 1)
    if dictionary is not None:
        # By the largest number, not by count: an append that was cut short may have left gaps.
        nth = F.floor(F.col("number") / (PARTS * RUN)) * RUN + F.col("number") % RUN
        used = dictionary.groupBy(*keys, part.alias("_part")).agg((F.max(nth) + 1).alias("_used"))
        new = new.alias("n").join(used.alias("d"), _same("n", "d", [*keys, "_part"]), "left").select(
            *[F.col(f"n.{c}") for c in (*keys, value, "_part")], (F.col("n._nth") + F.coalesce("d._used", F.lit(0))).alias("_nth"))
    run = F.floor(F.col("_nth") / RUN) * PARTS + F.col("_part")
    return new.select(*keys, value, (run * RUN + F.col("_nth") % RUN).cast("bigint").alias("number"))


def extend(dictionary: DataFrame | None, rows: DataFrame, value: str, keys: Keys = ()) -> DataFrame:
    """The dictionary (keys, value, number) with the values of ``rows`` that it lacks; numbers once given stay."""
    new = new_numbers(dictionary, rows, value, keys)
    return new if dictionary is None else dictionary.select(*keys, value, "number").unionByName(new)


def words(rows: DataFrame, dictionary: DataFrame, value: str, by: Keys, keys: Keys = ()) -> DataFrame:
    """The sets of ``value`` per ``by`` as rows (by, word, bits); values without a number are left out.

    ``keys`` are the dictionary's keys and should be among ``by``; then sets of different keys never share a word's meaning.
    """
    sets = rows.select(*by, value).distinct()
    extra = [c for c in by if c not in keys]
    joined = sets.alias("n").join(dictionary.alias("d"), _same("n", "d", [*keys, value])).select(
        *[F.col(f"n.{c}") for c in (*keys, *extra)], F.col("d.number").alias("number"))
    bit = F.expr("shiftleft(1L, CAST(number % 64 AS INT))")
    return joined.groupBy(*by, F.floor(F.col("number") / 64).alias("word")).agg(F.bit_or(bit).alias("bits"))


def counts(sets: DataFrame, by: Keys, name: str = "n_values") -> DataFrame:
    """The size of the union of the word rows of every ``by``."""
    return _counted(sets.groupBy(*by, "word").agg(F.bit_or("bits").alias("bits")), by, {name: F.col("bits")})


def _counted(joined: DataFrame, by: Keys, sizes: dict[str, Column]) -> DataFrame:
    return joined.groupBy(*by).agg(*[F.sum(F.bit_count(bits)).cast("bigint").alias(name) for name, bits in sizes.items()])


def counts_by_window(sets: DataFrame, by: Keys, keys: Keys = (), sizes: Sequence[int] = V.WINDOW_SIZES, month: str = "as_of_month",
                     name: str = "n_values") -> DataFrame:
    """Distinct values over the last n months: (by, end_month, window_size, name), for every month of the key and every ``by``
    with a value in the window.

    ``sets`` are word rows per ``by`` and month. End months are those that occur for the key; a missing month shrinks the
    windows over it. A word row goes to the end months that it reaches once, whatever the number of sizes, and only after the
    rows of a word have met: what is shuffled is the sets and their counts, not the rows they unfold to.
    """
    months = sets.select(*keys, month).distinct().select(
        *keys, F.col(month).alias("end_month"), month_number(first_of_month(F.col(month))).alias("_end"))
    reach = max(sizes)
    at = month_number(first_of_month(F.col(month)))
    # Dealt by word, so that a large set is shared out; a word has one row per month. The number of parts is given, because
    # adaptive execution would size them by the sets and not by the rows that these unfold to.
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sets.select(*by, "word", "bits", at.alias("_at")).repartition(parts, *by, "word")
    reached = dealt.select(*by, "word", "bits", "_at", F.explode(F.sequence("_at", F.col("_at") + (reach - 1))).alias("_end"))
    within = {f"_{n}": F.bit_or(F.when(F.col("_end") - F.col("_at") < n, F.col("bits"))) for n in sizes}
    joined = reached.groupBy(*by, "_end", "word").agg(*[bits.alias(c) for c, bits in within.items()])
    counted = _counted(joined, [*by, "_end"], {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in within})
    # One row per key and month on the other side: without keys the calendar, with keys the planner decides from its measured size.
    met = counted.alias("r").join((months if keys else F.broadcast(months)).alias("m"), _same("r", "m", [*keys, "_end"])).select(
        *[F.col(f"r.{c}") for c in (*by, *within)], F.col("m.end_month"))
    unfolded = F.array(*[F.struct(F.lit(f"{n}m").alias("window_size"), F.col(f"_{n}").alias(name)) for n in sizes])
    return met.select(*by, "end_month", F.inline(unfolded)).where(F.col(name) > 0)


def _same(a: str, b: str, columns: Keys) -> Column:
    on = F.lit(True)
    for c in columns:
        on = on & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return on
