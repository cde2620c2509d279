"""Per-key results where a few keys hold most rows."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stats_by_key(df: DataFrame, key: str, **aggregates: Column) -> DataFrame:
    """One row a key with ``n_rows`` and the given aggregates.

    The aggregates have to be algebraic (count, sum, min, max, avg): Spark then
    folds each partition into a hash table of mergeable states, which spills when
    full, and shuffles one state for a key and partition. A key with a third of
    all rows costs its reducer no more than one state for each map task.

    A null key is no key and has no row; an empty table gives an empty result;
    nulls in other columns are left out by the aggregates, as in SQL. Only the
    key and the aggregated columns are read. Results may have the names of other
    columns of the input, but not that of the key.
    """
    if key in {"n_rows", *aggregates}:
        raise ValueError(f"{key} is the key and the name of a result")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), *(c.alias(n) for n, c in aggregates.items()))


def heavy_keys(df: DataFrame, key: str, share: float = 0.03) -> DataFrame:
    """The stats of keys with more than ``share`` of the rows that have a key.

    The share is compared in whole numbers, so a key at the limit is left out
    whatever the rounding of doubles.
    """
    limit = Fraction(str(share)).limit_denominator(1_000_000)
    total = df.where(F.col(key).isNotNull()).agg(F.count(F.lit(1)).alias("total"))
    return stats_by_key(df, key).where(F.col("n_rows") * limit.denominator > total.scalar() * limit.numerator)
