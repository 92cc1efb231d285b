"""Joins whose large side may hold a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.session import shuffle_partitions


def salts_for(rows: DataFrame) -> int:
    """Parts of a key: a key of a third of the rows then takes no task more than a few average ones."""
    return min(256, max(8, shuffle_partitions(rows.sparkSession) // 10))


def salted_join(large: DataFrame, small: DataFrame, on: list[str], spread_by: str, how: str = "inner", salts: int | None = None) -> DataFrame:
    """Join on ``on`` with every key of ``large`` spread over ``salts`` parts.

    The part is a hash of ``spread_by``, a column of ``large`` that varies within
    a key; ``small``, unique or nearly so by key, is repeated once per part.
    ``how`` is inner or left.  Without ``salts`` their number follows the number
    of shuffle partitions (``salts_for``).
    """
    salts = salts or salts_for(large)
    spread = large.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(repeated, [*on, "_salt"], how).drop("_salt")
