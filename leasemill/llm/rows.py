"""Keeping whole rows of a table by keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("_row_id", "_row_text")


def with_keys(docs: DataFrame) -> DataFrame:
    """docs with two more columns that tell its rows apart: doc_id, and a digest of the text (null: its own)."""
    digest = F.coalesce(F.unhex(F.md5(F.encode("text", "UTF-8"))), F.lit(b""))
    return docs.withColumns({KEYS[0]: F.col("doc_id"), KEYS[1]: digest})


def only_once(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``with_keys(docs)`` whose keys are in ``keys(*KEYS, n)``, one of each; ``n`` says how many rows may have a key."""
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in KEYS]
    kept = keyed.alias("l").join(keys.select(*KEYS).alias("r"), on, "left_semi")
    repeated = keys.where("n > 1").select(*KEYS)
    if not repeated.isEmpty():
        single = kept.alias("l").join(repeated.alias("r"), on, "left_anti")
        kept = single.union(kept.alias("l").join(repeated.alias("r"), on, "left_semi").dropDuplicates(list(KEYS)))
    return kept.drop(*KEYS)
