"""Columns of the input that have the name of a new column."""

from __future__ import annotations

from pyspark.sql import DataFrame


def set_aside(df: DataFrame, new: set[str], keep: set[str] = frozenset()) -> DataFrame:
    """``df`` with each column named as one of ``new`` renamed to ``input_<name>``, or more ``input_`` if that exists too.

    Columns in ``keep`` are read under their own name and stay.
    """
    taken = set(df.columns)
    for name in df.columns:
        if name in new and name not in keep:
            other = f"input_{name}"
            while other in taken:
                other = f"input_{other}"
            taken.add(other)
            df = df.withColumnRenamed(name, other)
    return df
